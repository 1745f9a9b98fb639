import random
import re
from itertools import combinations

from llm_fixtures import frame, odd_rows, prose
from mediamatch.llm import decontamination as dc


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    """The best place of every item, all places tried, without masks."""
    best = {}
    for d, text in docs:
        own = words(text)
        for item_id, item_text in items:
            item = words(item_text)
            for begin in range(-len(item), len(own)):
                matched = sum(1 for i, w in enumerate(item) if 0 <= begin + i < len(own) and own[begin + i] == w)
                if item and matched / len(item) >= dc.SIMILARITY:
                    found = (matched / len(item), matched, len(item))
                    best[d, item_id] = max(best.get((d, item_id), found), found)
    return {(d, item_id, matched, n, share) for (d, item_id), (share, matched, n) in best.items()}


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'?' AS words", "'?' AS doc_id", "'?' AS seed")


def substituted(text, share, rng):
    return " ".join("other" if rng.random() < share else w for w in text.split())


def setting():
    rng = random.Random(6)
    items = [(i, t) for i, t in enumerate(prose(31, 12, 40))] + [(90, "too short to count"), (91, None), (92, ""), (93, None)]
    base = prose(32, 30, 120)
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(100 + i, base[i] + " " + items[i][1].upper() + ", " + base[i + 1]) for i in range(12)]
    docs += [(200 + i, base[i] + " " + substituted(items[i][1], 0.1, rng) + " end") for i in range(12)]
    docs += [(300 + i, substituted(items[i][1], 0.3, rng)) for i in range(12)]
    docs += [(400 + i, items[i][1][: len(items[i][1]) // 2]) for i in range(4)]
    docs += [(500, (items[0][1] + " ") * 300), (501, "&&& ".join(items[1][1].split()))]
    return docs, items


def test_leaks_match_brute_force(spark):
    docs, items = setting()
    odd = odd_rows()
    got = dc.leaks(frame(spark, [(d, t, None, None) for d, t in docs] + odd), bench(spark, items)).collect()
    want = brute(docs, items)
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert {100 + i for i in range(12)} <= {d for d, *_ in want}


def test_join_that_shuffles_gives_the_same(spark, monkeypatch):
    docs, items = setting()
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    got = dc.leaks(frame(spark, [(d, t, None, None) for d, t in docs]), bench(spark, items)).collect()
    assert {tuple(r) for r in got} == brute(docs, items)


def test_decontaminate_keeps_clean_rows_and_columns(spark):
    docs, items = setting()
    leaking = {d for d, *_ in brute(docs, items)}
    rows = [(d, t, None, None) for d, t in docs] + odd_rows()
    rows += [(100, "same id, clean text", None, None), (None, items[0][1], None, None), (7, docs[7][1], None, None)]
    table = frame(spark, rows)
    out = dc.decontaminate(table, bench(spark, items))
    assert out.columns == table.columns
    want = sorted((str(d), str(t)) for d, t, *_ in rows if not (d in leaking and t != "same id, clean text") and t != items[0][1])
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == want


def test_empty_tables_and_native_plan(spark):
    docs, items = setting()
    none = bench(spark, items).limit(0)
    assert dc.leaks(frame(spark, []), bench(spark, items)).collect() == []
    assert dc.leaks(frame(spark, docs and [(1, docs[0][1], None, None)]), none).collect() == []
    found = dc.leaks(frame(spark, [(1, docs[0][1], None, None)]), bench(spark, items))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_masks_meet_every_permitted_substitution():
    # a longer item is a row of pieces of these lengths, one of which holds no more than its share
    for n in range(1, 2 * dc.WINDOW):
        span = min(n, dc.WINDOW)
        for k in range(n // 5 + 1):
            for gone in map(set, combinations(range(n), k)):
                windows = range(n - span + 1)
                assert any(all(at + o not in gone for o in mask) for mask in dc.masks_of(span) for at in windows), (n, gone)


def test_leaks_hold_all_of_plain_overlap(spark):
    items, docs = [], []
    rng = random.Random(8)
    for n in (1, 2, 4, 5, 6, 8, 9, 10, 11, 15, 16, 17, 18):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        places = list(combinations(range(n), n // 5))
        for gone in places if len(places) < 60 else rng.sample(places, 60):
            docs.append((len(docs), " ".join(["front", *("other" if i in gone else w for i, w in enumerate(item)), "end"])))
        docs.append((len(docs), " ".join("other" if i <= n // 5 else w for i, w in enumerate(item))))
    docs.append((len(docs), "東京都は日本の首都です。" * 2))
    items.append((100, "東京都は日本の首都です。"))

    def plain(text, item):
        own, item = words(text), words(item)
        return max(sum(0 <= b + i < len(own) and own[b + i] == w for i, w in enumerate(item)) for b in range(-len(item), len(own)))

    want = {(d, i, plain(text, item), len(words(item))) for d, text in docs for i, item in items}
    want = {r for r in want if r[2] / r[3] >= dc.SIMILARITY}
    got = dc.leaks(frame(spark, [(d, t, None, None) for d, t in docs]), bench(spark, items)).collect()
    assert {tuple(r)[:4] for r in got} == want and len(want) > 200


def test_places_and_texts_of_an_item_are_not_added_up(spark):
    a, b = ("red fox jumps over nine lazy dogs near the old stone bridge at dawn each cold winter day", "two large ships sail past seven green hills under a bright moon while many sailors sing very loud songs")
    half = " ".join(a.split()[:9]) + " , " + " ".join(b.split()[9:])
    apart = " ".join(a.split()[:9]) + " one two three four five six seven eight ten " + " ".join(a.split()[9:])
    docs = [(1, half), (2, apart), (3, f"so {a} end"), (4, " ".join(w if i % 7 else "x" for i, w in enumerate(b.split())))]
    items = [(8, a), (8, b)]
    got = {tuple(r) for r in dc.leaks(frame(spark, [(d, t, None, None) for d, t in docs]), bench(spark, items)).collect()}
    assert got == brute(docs, items) and {r[0] for r in got} == {3, 4}


def test_shuffled_rows_carry_no_words(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    docs, items = setting()
    found = dc.leaks(frame(spark, [(d, t, None, None) for d, t in docs]), bench(spark, items))
    plan = found._jdf.queryExecution().toString()
    plan = plan[plan.index("== Physical Plan ==") :].splitlines()
    by_seed = [i for i, line in enumerate(plan) if "Exchange hashpartitioning(seed" in line]
    assert by_seed and not any("words" in plan[i + 1] for i in by_seed)
