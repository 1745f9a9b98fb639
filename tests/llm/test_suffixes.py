import numpy as np
import pytest

from llm_fixtures import frame, odd_rows, prose
from mediamatch.llm import suffixes


def brute(rows, length=100):
    """(key, n_bytes, n_removed, n_spans, kept) with `rows` in document order."""
    seen, out = set(), []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((key, len(data), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), kept))
    return out


def brute_factors(data, starts, group, length):
    out = []
    for i, s in enumerate(starts):
        best = 0
        for j, t in enumerate(starts):
            if t < s and group[i] == group[j]:
                k = 0
                while k < length and s + k < len(data) and data[s + k] == data[t + k]:
                    k += 1
                best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_longest_previous_factors(seed):
    rng = np.random.default_rng(seed)
    data = rng.integers(1, 3 + seed, 160).astype(np.uint8)
    data[80:120] = data[10:50]
    length = (100, 12, 9)[seed % 3]
    starts = np.arange(len(data) - length + 1)
    group = (starts >= len(starts) // (2 if seed % 2 else 10**6)).astype(int)
    want = brute_factors(data, starts, group, length)
    assert suffixes.longest_previous_factors(data, starts, group, length).tolist() == want
    if length == suffixes.LENGTH:
        assert suffixes.repeated_windows(data, starts, group).tolist() == [w >= length for w in want]


def test_equal_windows_choose_equal_anchors():
    a, b, c = (t.encode() for t in prose(4, 3, 120))
    shared = "".join(prose(9, 1, 60)).encode()
    texts = [a + shared + b, c + shared + a]
    data = np.frombuffer(b"".join(texts), np.uint8)
    text, first, size, anchor, run = suffixes.anchor_runs(data, np.array([0, len(texts[0]), len(data)]))
    assert size.sum() == sum(len(t) - 99 for t in texts)
    at = [dict() for _ in texts]
    for t, f, n, k in zip(text, first, size, anchor):
        at[t].update({texts[t][w : w + 100]: k for w in range(f, f + n)})
    common = set(at[0]) & set(at[1])
    assert common and all(at[0][w] == at[1][w] for w in common)
    assert len(set(anchor)) < len(text) <= len(data) // 20


def compare(spark, rows, order=None, parts=3):
    got = suffixes.deduplicate(frame(spark, [(d, t, None, None) for d, t in rows]).repartition(parts)).collect()
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got)
    want = brute(order or sorted(rows, key=lambda r: r[0]))
    assert got == sorted((str(k), *rest) for k, *rest in want)


def test_copies_passages_and_edits(spark):
    texts = prose(11, 30, 200)
    passage = prose(12, 1, 80)[0]
    rng = np.random.default_rng(3)
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i % 3]) for i in range(40)]
    rows += [(200 + i, texts[i][: 60 + i] + passage + texts[i][60 + i :]) for i in range(20)]
    for i in range(12):
        words = texts[i].split()
        words[rng.integers(len(words))] = "edit"
        rows.append((300 + i, " ".join(words)))
    rows += [(-7, passage * 3), (900, "ab" * 400), (901, "abc" * 300), (902, "ab" * 90 + "é" * 200)]
    compare(spark, rows)


def test_long_text_is_read_in_parts(spark, monkeypatch):
    passage = " ".join(prose(13, 40, 100))
    compare(spark, [(1, passage[:9000]), (2, "x" + passage[2000:] + passage[:5000])])
    data = passage.encode()
    monkeypatch.setattr(suffixes, "PART_BYTES", 500)
    import pyarrow as pa

    pieces = list(suffixes._parts(pa.array([passage])))
    assert len(pieces) == -(-len(data) // 500)
    assert sum(max(len(d) - 99, 0) for _, _, d, _ in pieces) == len(data) - 99


def test_odd_rows_repeated_ids_and_empty_table(spark):
    t = prose(14, 3, 80)
    got = suffixes.deduplicate(frame(spark, [*odd_rows(), (3, t[0], None, None), (3, t[0], None, None), (None, t[0], None, None)]))
    lengths = sorted((r["doc_id"] or -99, r["n_bytes"], r["n_removed"]) for r in got.collect() if r["n_bytes"] == len(t[0]))
    assert lengths == [(-99, len(t[0]), 0), (3, len(t[0]), len(t[0])), (3, len(t[0]), len(t[0]))]
    assert got.count() == len(odd_rows()) + 3
    assert suffixes.deduplicate(frame(spark, [])).collect() == []


def crowded_rows(n=120):
    """A phrase that is shorter than a window, one a little longer and a long one, each with other text around it."""
    rng = np.random.default_rng(5)
    words = [" ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(60)) for _ in range(2 * n)]
    short, middle, long = (t[:k] for t, k in zip(prose(21, 3, 120), (60, 115, 190)))
    return [(i, words[2 * i][:200] + (short, middle, long)[i % 3] + words[2 * i + 1][:150] + (middle if i % 5 == 0 else "")) for i in range(n)]


def test_crowded_anchors_are_taken_apart(spark):
    rows = crowded_rows()
    table = frame(spark, [(d, t, None, None) for d, t in rows]).repartition(3)
    got = suffixes.deduplicate(table, crowded=4).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in got)
    assert got == sorted(brute(rows)) and sum(r[2] for r in got) > 5000


def test_a_large_group_is_not_held(monkeypatch):
    import pyarrow as pa

    windows = [bytes([65 + i % 3]) * 100 for i in range(3)]
    rows = [(7, key, 0, windows[key % 3]) for key in range(4000)]
    names, kinds = ("anchor", "key", "first", "bytes"), (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    table = pa.table({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})
    sizes, compared = [], suffixes._compared
    monkeypatch.setattr(suffixes, "STREAM_ROWS", 100)
    monkeypatch.setattr(suffixes, "_compared", lambda t: sizes.append(t.num_rows) or compared(t))
    found = [r for b in suffixes._compare(iter(table.to_batches(max_chunksize=32))) for r in b.to_pylist()]
    assert max(sizes) < 200
    assert {r["key"] for r in found} == set(range(3, 4000))


def test_crowded_anchors_are_named_once():
    import pyarrow as pa

    anchor = np.repeat([1, 2, 3], [3, 40, 5])
    n = len(anchor)
    whole = suffixes._run_batch(anchor, np.arange(n), np.arange(n), np.zeros(n), np.ones(n, np.int64), False)
    batches = pa.Table.from_batches([whole]).to_batches(max_chunksize=7)
    out = pa.Table.from_batches(suffixes._settle(iter(batches), crowded=5)).to_pylist()
    assert [r["anchor"] for r in out if r["span"] == 0 and r["run"] == 0 and r["anchor"] != 1] == [2]


def test_crowded_anchors_do_not_shuffle_texts_again(spark):
    table = spark.createDataFrame(crowded_rows(), "doc_id long, text string")
    found = suffixes.deduplicate(table, crowded=4)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "_take_apart" in plan
    assert len([line for line in plan.splitlines() if "text#" in line and "Scan" in line]) == 1
