import re

import duckdb
import pytest

from llm_fixtures import frame, odd_rows, prose
from mediamatch.llm import licenses as lic
from mediamatch.llm.queries import LICENSE_WINDOWS_SQL


def pieces(own):
    return {" ".join(own[i : i + 5]) for i in range(max(len(own) - 4, 1))}


def brute(docs):
    out = {}
    for d, text in docs:
        own = re.findall(r"[^\W_]+", (text or "").lower())
        for begin in range(0, max(len(own) - 13, 0) + 1, lic.STRIDE):
            window = pieces(own[begin : begin + lic.WINDOW])
            for name, template in lic.TEMPLATES.items():
                known = pieces(lic.template_words(template))
                share = len(window & known) / len(known)
                if share >= lic.CONTAINMENT:
                    best, first, places = out.get((d, name), (0, begin, set()))
                    out[d, name] = (max(best, share), min(first, begin), places | {begin})
    return {(d, name, best, first, len(places)) for (d, name), (best, first, places) in out.items()}


def setting():
    base = prose(41, 12, 80)
    names = list(lic.TEMPLATES)
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(100 + i, base[i] + "\n" + lic.TEMPLATES[names[i % 4]] + "\n" + base[i + 1]) for i in range(11)]
    docs += [(200, lic.TEMPLATES["MIT"]), (201, " ".join(lic.TEMPLATES.values())), (202, "licensed under nothing at all, released by MIT")]
    docs += [(203, "this work is licensed under the gnu general public licence, version 3"), (204, lic.TEMPLATES["GPL-3.0"].replace(" ", "### "))]
    return docs + [(300, ("x " * 50 + lic.TEMPLATES["Apache-2.0"] + " ") * 200)]


def test_scan_matches_exact_containment(spark):
    docs = setting()
    got = lic.scan(frame(spark, [(d, t, None, None) for d, t in docs] + [r for r in odd_rows()])).collect()
    assert {tuple(r) for r in got} == brute(docs) and len(got) == len(brute(docs))


def test_bands_guarantee_retrieval():
    for text in lic.TEMPLATES.values():
        shingles = len(pieces(lic.template_words(text)))
        similarity = shingles / (lic.WINDOW - lic.SHINGLE + 1)
        assert (1 - similarity) ** lic.BANDS < 1e-4


def test_anchors_cover_every_shingle():
    anchors = set(lic.anchor_words(lic.TEMPLATES))
    assert all(anchors & set(p.split()) for t in lic.TEMPLATES.values() for p in pieces(lic.template_words(t)))


def test_empty_table_long_template_and_native_plan(spark):
    assert lic.scan(frame(spark, [])).collect() == []
    with pytest.raises(ValueError):
        lic.scan(frame(spark, []), templates={"long": "word " * 40})
    plan = lic.scan(frame(spark, [(1, "Released under the MIT License.", None, None)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_texts_and_usual_wordings(spark):
    base, docs, want = prose(43, 40, 80), [], set()
    for k, (name, text) in enumerate(lic.WORDINGS):
        docs.append((k, base[k] + "\n" + text + "\n" + base[k + 1], None, None))
        docs.append((100 + k, base[k] + "\n" + " ".join(text.split()[: len(text.split()) // 2]), None, None))
        want.add((k, name))
    got = {(r["doc_id"], r["license"]): r["containment"] for r in lic.scan(frame(spark, docs)).collect()}
    assert all(got.get(key) == 1.0 for key in want)
    assert {name for d, name in got if d >= 100} <= {"Apache-2.0", "MIT"}  # the statement in a header's first half
    words = [f"word{i}" for i in range(700)]
    whole = [(1, base[0] + " " + " ".join(words), None, None), (2, " ".join(words[:500]), None, None)]
    found = lic.scan(frame(spark, whole), templates={"own": " ".join(words)}).collect()
    assert [(r["doc_id"], r["containment"]) for r in found] == [(1, 1.0)]


def test_needed_words_are_in_every_large_enough_part():
    for _, text in lic.WORDINGS:
        known = pieces(lic.template_words(text))
        needed = set(lic.needed_words(text, lic.CONTAINMENT))
        assert sum(not needed & set(p.split()) for p in known) < lic.CONTAINMENT * len(known)


def test_sql_knows_every_template_and_window_width(spark):
    base = prose(47, 30, 60)
    docs = [(k, base[k] + " " + text + " " + base[k + 1], None, None) for k, (_, text) in enumerate(lic.WORDINGS)]
    docs += [(100 + k, text, None, None) for k, (_, text) in enumerate(lic.WORDINGS)]
    docs += [(200 + k, base[k] + " " + " ".join(text.split()[: len(text.split()) * 9 // 10]), None, None) for k, (_, text) in enumerate(lic.WORDINGS)]
    docs += [(300, " ".join(text for _, text in lic.WORDINGS), None, None), (301, "", None, None), (302, None, None, None)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", [row[:2] for row in docs])
    found = lic.scan(frame(spark, docs))
    want = db.execute(LICENSE_WINDOWS_SQL)
    assert [d[0] for d in want.description] == found.columns
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(want.fetchall()) and {r[1] for r in got} == {name for name, _ in lic.WORDINGS}
