"""The pipeline against plain Python over the same rows."""

import re

import corpus_pipeline
from llm_fixtures import frame, odd_rows, prose
from mediamatch.llm import language, secrets
from test_decontamination import brute as brute_leaks
from test_packing import check_pieces
from test_simhash import brute_components, brute_fingerprint


def write(spark, folder, rows, items):
    docs = spark.createDataFrame([(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def setting():
    base = prose(61, 40, 200)
    items = [(i, t) for i, t in enumerate(prose(62, 6, 40))]
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i] + " tail", "en", "s1") for i in range(10)]
    rows += [(200 + i, base[20 + i] + " " + items[i][1], "en", "s2") for i in range(6)]
    rows += [(300 + i, f"{base[30 + i]} password=Own-{i}-9f83kq02mz {base[i]}", "en", f"s{i}") for i in range(5)]
    rows += [(400 + i, f"{base[i + 3]} {base[i + 9]} token=Shared-Example-12345678", "en", f"s{i}") for i in range(5)]
    odd = [(1000 + i, t, lang, s) for i, (_, t, lang, s) in enumerate(odd_rows())]
    return rows + odd, items


def brute(rows, items, model_accepts):
    kept = [r for r in rows if model_accepts(r[1])]
    label = brute_components([brute_fingerprint(t) for _, t, *_ in kept])
    first = {}
    for r, c in zip(kept, label):
        first[c] = min(first.get(c, r), r, key=lambda x: x[0])
    kept = list(first.values())
    leaking = {d for d, *_ in brute_leaks([(d, t) for d, t, *_ in kept], items)}
    kept = [r for r in kept if r[0] not in leaking]
    owners = {}
    for _, t, _, s in kept:
        for _, _, _, value in secrets.candidates(t):
            owners.setdefault(value, set()).add(s)
    out = {}
    for d, t, *_ in kept:
        for kind, start, stop, value in reversed(secrets.candidates(t)):
            if len(owners[value] - {None}) < secrets.EXAMPLE_OWNERS and not re.search(r"opaque", kind):
                t = t[:start] + f"<{kind}>" + t[stop:]
        out[d] = t
    return out


def test_run_matches_plain_python(spark, tmp_path):
    rows, items = setting()
    write(spark, tmp_path, rows, items)
    docs = frame(spark, rows, extra=False)
    model = language.fit(docs.where(~language.held_out("doc_id", language.FOLDS)))
    judged = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, model).collect()}
    by_text = {t: judged[d] for d, t, *_ in rows}
    want = brute(rows, items, lambda t: by_text[t][0] != "und" and by_text[t][1] >= corpus_pipeline.LEAST_SHARE)
    assert len(want) > 40 and any("<assign>" in t for t in want.values()) and any("Shared-Example" in t for t in want.values())
    check_pieces(corpus_pipeline.run(spark, str(tmp_path)).collect(), want)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    docs = frame(spark, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_clean_documents_stay(spark, tmp_path):
    rows = [(i, t, "en", "s1") for i, t in enumerate(prose(63, 30, 150))]
    write(spark, tmp_path, rows, [(1, prose(64, 1, 40)[0])])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == [(d, t) for d, t, *_ in rows]
