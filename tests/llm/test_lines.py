import zlib

import numpy as np
import pytest

from llm_fixtures import frame, odd_rows, prose
from mediamatch.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=lines.LEAST):
    """(doc_id, n_lines, n_dropped, kept) of (doc_id, text) rows."""
    place = lambda doc: (doc is not None, doc or 0)
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(place(doc))
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if len(key(x)) < least or place(doc) == min(holders[key(x)])]
        out.append((doc, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(docs):
    rows = lines.kept_texts(docs, lines.keep_bitmaps(docs)).collect()
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in rows), key=repr)


def check(spark, rows, parts=3):
    assert found(frame(spark, [(d, t, None, None) for d, t in rows]).repartition(parts)) == brute(rows)


def test_repeated_lines(spark):
    rng = np.random.default_rng(5)
    pool = [*prose(1, 40, 8), "Short", "Ten chars!", "", "  Padded line here\t", "padded LINE here", "Éa bright line", "éa bright line"]
    rows = [(int(d), "\n".join(rng.choice(pool, rng.integers(0, 30)))) for d in rng.permutation(200)]
    check(spark, rows)


def test_a_line_that_most_documents_hold_is_dealt_to_many_tasks(spark):
    common = "this footer stands below nearly every page"
    rows = [(i, f"{text}\n{common}\n{common}") for i, text in enumerate(prose(2, 900, 12))]
    docs = frame(spark, [(d, t, None, None) for d, t in rows]).repartition(7)
    assert found(docs) == brute(rows)
    sizes = [r["n"] for r in lines.dropped_lines(docs).selectExpr("spark_partition_id() AS p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    twice = "a line of some length\nanother line of length"
    rows += [(7000, twice), (7000, twice), (7000, "a line of some length\n"), (None, twice), (7001, f"{twice}\n{twice}\r"), (9, "\n\n\n")]
    check(spark, rows)


def test_many_lines_in_one_text(spark):
    long = "\n".join(f"line number {i % 5000} of it" for i in range(60_000))
    check(spark, [(2, long), (1, "line number 17 of it"), (3, long[:100_000])])


def test_bitmap_and_empty_table(spark):
    docs = frame(spark, [(1, "first line here\nx", None, None), (2, "x\nfirst line here\ny", None, None)])
    rows = {r["doc_id"]: r for r in lines.keep_bitmaps(docs).collect()}
    assert (rows[2]["n_lines"], rows[2]["n_dropped"], zlib.decompress(rows[2]["keep"])) == (3, 1, bytes([0b101]))
    empty = frame(spark, [])
    assert found(empty) == []


@pytest.mark.parametrize("least", (1, 30))
def test_least_length(spark, least):
    rows = [(i, "\n".join(t.split()[:4])) for i, t in enumerate(prose(6, 40, 8))]
    docs = frame(spark, [(d, t, None, None) for d, t in rows])
    maps = lines.keep_bitmaps(docs, least=least)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in lines.kept_texts(docs, maps).collect()), key=repr)
    assert got == brute(rows, least)
