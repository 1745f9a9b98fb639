from datetime import datetime, timedelta

import pytest
from conftest import pairs_of
from pyspark.sql import functions as F

from mediamatch.operators import index as ix
from mediamatch.operators import relational as rel
from mediamatch.plans.store import IndexStore, VersionConflict, uninstall
from mediamatch.schema import Settings

AT = datetime(2024, 1, 1)


def base(spark):
    rows = [(i, f"{i:016x}", "image/png", 100 + i, f"hash{i}") for i in (1, 2, 3)]
    df = spark.createDataFrame(rows, "attachment_id long, phash string, mime_type string, file_size long, file_hash string")
    return ix.conform(df.withColumn("indexed_at", F.lit(AT)).withColumn("width", F.lit(640)).withColumn("color_vector", F.array(F.lit(0.5))))


def test_upsert_overwrites_supplied_columns_only(spark):
    changes = spark.createDataFrame([(2, "f" * 16), (9, "e" * 16)], "attachment_id long, phash string")
    got = pairs_of(ix.upsert(base(spark), changes), "attachment_id", "phash", "mime_type", "width", "error_code")
    assert got == [
        (1, f"{1:016x}", "image/png", 640, ""),
        (2, "f" * 16, "image/png", 640, ""),
        (3, f"{3:016x}", "image/png", 640, ""),
        (9, "e" * 16, "", 0, ""),
    ]
    # A supplied null is written, too.
    nulls = spark.createDataFrame([(1, None)], "attachment_id long, color_vector array<double>")
    assert ix.upsert(base(spark), nulls).where("attachment_id = 1").first()["color_vector"] is None
    # Only listed columns of an existing row change.
    two = spark.createDataFrame([(1, "a" * 16, 5)], "attachment_id long, phash string, file_size long")
    row = ix.upsert(base(spark), two, ["file_size"]).where("attachment_id = 1").first()
    assert (row["phash"], row["file_size"]) == (f"{1:016x}", 5)


def test_mark_failed_leaves_size_and_type(spark):
    bad = spark.createDataFrame([(2, "unfingerprintable"), (8, "unsupported_mime")], "attachment_id long, error_code string")
    rows = {r["attachment_id"]: r for r in ix.mark_failed(base(spark), bad).collect()}
    two = rows[2]
    assert (two["phash"], two["color_vector"], two["file_hash"], two["error_code"]) == ("", None, "", "unfingerprintable")
    assert (two["mime_type"], two["file_size"], two["width"]) == ("image/png", 102, 640)
    assert rows[8]["error_code"] == "unsupported_mime" and rows[8]["width"] == 0


def test_delete_and_counts(spark):
    keys = spark.createDataFrame([(1,), (77,)], "attachment_id long")
    assert pairs_of(ix.delete_keys(base(spark), keys), "attachment_id") == [(2,), (3,)]
    assert ix.deleted_count(base(spark), keys).first()["deleted"] == 1
    assert ix.deleted_count(base(spark), keys.where("attachment_id = 77")).first()["deleted"] == 0


def test_library_state(spark):
    media = spark.createDataFrame(
        [(1, "image/png", "attachment"), (2, "image/tiff", "attachment"), (3, "text/plain", "attachment"),
         (4, "image/png", "attachment"), (5, "image/tiff", "attachment"), (6, "image/png", "page")],
        "attachment_id long, mime_type string, post_type string",
    )
    index = ix.mark_failed(base(spark), spark.createDataFrame([(2, "unsupported_mime")], "attachment_id long, error_code string"))
    assert tuple(ix.library_counts(media, index).first()) == (4, 2, 1, 1)
    assert tuple(ix.library_counts(media.where("false"), index).first()) == (0, 2, 1, 0)
    assert pairs_of(ix.unindexed(media, index), "attachment_id") == [(4,), (5,)]
    assert pairs_of(ix.unindexed(media, index, ["image/png"]), "attachment_id") == [(4,)]
    assert ix.orphan_count(index, media.where("attachment_id > 1")).first()[0] == 1
    assert pairs_of(ix.delete_orphans(index, media.where("attachment_id > 1")), "attachment_id") == [(2,), (3,)]
    assert pairs_of(ix.failed(index), "attachment_id") == [(2,)] and ix.indexed(index).count() == 2
    assert pairs_of(ix.count_by_mime(media), "mime_type", "n") == [("image/png", 2), ("image/tiff", 2), ("text/plain", 1)]


def test_build_rows_records_failures(spark):
    media = spark.createDataFrame(
        [(1, "image/png", ("a" * 16, [1.0], [1.0]), 3, 4, 5, "h"), (2, "image/tiff", ("a" * 16, [1.0], [1.0]), 3, 4, 5, "h"),
         (3, "image/webp", None, -1, -1, 5, "h"), (4, None, None, None, None, None, None)],
        "attachment_id long, mime_type string, fingerprint struct<phash:string,color_vector:array<double>,edge_vector:array<double>>, "
        "width int, height int, file_size long, file_hash string",
    )
    got = pairs_of(ix.build_rows(media), "attachment_id", "error_code", "phash", "width", "file_hash", "mime_type")
    assert got == [
        (1, "", "a" * 16, 3, "h", "image/png"),
        (2, "unsupported_mime", "", 0, "", ""),
        (3, "unfingerprintable", "", 0, "", ""),
        (4, "unsupported_mime", "", 0, "", ""),
    ]


def test_latest_change_wins(spark):
    rows = [(1, AT, 5, "a"), (2, AT, 5, "b"), (0, datetime(2024, 1, 2), 6, "c"), (9, AT, 6, "d")]
    df = spark.createDataFrame(rows, "seq long, ts timestamp, attachment_id long, action string")
    assert pairs_of(ix.latest_per_key(df), "attachment_id", "action") == [(5, "b"), (6, "c")]


def test_guarded_changes(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "a long, b string")
    with pytest.raises(ValueError):
        ix.update_where(df, None, {"b": "z"})
    with pytest.raises(ValueError):
        ix.delete_where(df, None)
    assert pairs_of(ix.update_where(df, F.col("a") > 2, {"b": "z"}).where("b is not null"), "a", "b") == [(1, "x"), (3, "z")]
    assert pairs_of(ix.delete_where(df, F.col("b") == "x"), "a") == [(2,), (3,)]


def test_store_versions(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    assert store.versions() == [] and store.read().count() == 0
    first = store.write(base(spark), by_id=True)
    frozen = store.read(first)
    store.write(store.read().where("attachment_id > 1"))
    # A version without its commit marker is not seen.
    (tmp_path / "index" / "full-00000007-after-2").mkdir()
    assert store.versions() == [1, 2] and store.read().count() == 2 and frozen.count() == 3
    assert store.clear() == 2 and store.read().count() == 0 and store.versions() == [1, 2, 3]
    assert tuple(store.counts().first()) == (0, 0)


def deletes(spark, *rows):
    return spark.createDataFrame(list(rows), "attachment_id long, ts timestamp")


def size_of(folder):
    return sum(p.stat().st_size for p in folder.rglob("*.parquet"))


def test_delta_wins_and_is_as_small_as_the_change(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    many = ix.conform(spark.range(20000).select(F.col("id").alias("attachment_id"), F.md5(F.col("id").cast("string")).alias("file_hash")))
    first = store.write(many)
    one = ix.conform(spark.createDataFrame([(5, "new"), (99999, "fresh")], "attachment_id long, file_hash string"))
    second = store.append(one, deletes(spark, (6, AT)), batch_id=4)
    folder = next((tmp_path / "index").glob(f"delta-{second:08d}*"))
    assert size_of(folder) < size_of(tmp_path / "index" / f"full-{first:08d}-after-0") / 20
    now = {r["attachment_id"]: r["file_hash"] for r in store.read().where("attachment_id in (4, 5, 6, 99999)").collect()}
    assert now[5] == "new" and now[99999] == "fresh" and 6 not in now and len(now) == 3 and store.read().count() == 20000
    assert store.read(first).count() == 20000 and store.recorded(4) and not store.recorded(5)
    store.append(ix.conform(one.where("attachment_id = 5").withColumn("file_hash", F.lit("newer"))), deletes(spark))
    assert store.read().where("attachment_id = 5").first()["file_hash"] == "newer"
    store.compact()
    assert store.prune() == 3 and store.versions() == [4] and store.read().count() == 20000
    assert store.rows().where("deleted").count() == 1 and store.recorded(4) is False
    store.compact(forget_before=AT + timedelta(days=1))
    assert store.rows().where("deleted").count() == 0


def test_writers_do_not_overwrite_each_other(spark, tmp_path):
    store, other = (IndexStore(spark, str(tmp_path / "index")) for _ in range(2))
    store.write(base(spark))
    seen = store.newest()
    other.append(ix.conform(spark.createDataFrame([(77,)], "attachment_id long")), deletes(spark))
    store.write(base(spark), after=seen)  # made without the delta, which still applies
    assert store.read().where("attachment_id = 77").count() == 1
    with pytest.raises(VersionConflict):
        other.write(base(spark), after=seen)
    assert store.read().where("attachment_id = 77").count() == 1


def test_upsert_of_a_repeated_key_keeps_one_row(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (50, "c"), (50, "d")], "attachment_id long, file_hash string")
    got = ix.upsert(base(spark), twice).where("attachment_id in (1, 50)")
    assert pairs_of(got, "attachment_id", "file_hash") == [(1, "b"), (50, "d")]


def test_merge_built_is_one_join(spark):
    plan = ix.merge_built(base(spark), base(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1


def test_reindex_moves_no_pixels(spark, tmp_path, monkeypatch):
    from mediamatch.plans import indexing

    rows = [(i, "image/png", "attachment", 4, 4, 3, bytes(range(48)), 48, "h") for i in range(6)]
    images = spark.createDataFrame(
        rows, "attachment_id long, mime_type string, post_type string, width int, height int, n_channels int, data binary, file_size long, file_hash string"
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    try:
        for bound in (1000, 0):
            monkeypatch.setattr(indexing, "BROADCAST_IDS", bound)
            store = IndexStore(spark, str(tmp_path / f"index{bound}"))
            store.write(ix.conform(spark.createDataFrame([(1,), (2,)], "attachment_id long")))
            keep = store.append
            monkeypatch.setattr(
                store, "append", lambda built, none: plans.append(built._jdf.queryExecution().executedPlan().toString()) or keep(built, none)
            )
            assert tuple(indexing.reindex(store, images).first()) == (4, 4) and store.read().count() == 6
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if "Exchange hashpartitioning" in line:
                below = lines[i + 1]
                assert "data#" not in below, below


def numbers(spark):
    return spark.createDataFrame([(i, f"t{i % 3}") for i in range(1, 11)], "attachment_id long, b string")


def test_list_filters_and_paging(spark):
    df = numbers(spark)
    count = lambda d: d.count()
    assert count(rel.where_in(df, "b", [])) == 10 and count(rel.where_not_in(df, "b", [])) == 10
    assert count(rel.where_in(df, "b", ["t0"])) == 3 and count(rel.where_not_in(df, "b", ["t0"])) == 7
    assert count(rel.where_any(df, [])) == 10
    assert count(rel.where_any(df, [F.col("b") == "t0", F.col("attachment_id") == 1])) == 4
    assert count(rel.where_raw(df, "attachment_id > :a AND b = :b", a=5, b="t0")) == 2
    ordered = rel.order_by(df, ("attachment_id", "desc"))
    ids = lambda d: [r["attachment_id"] for r in d.collect()]
    assert ids(rel.paginate(ordered, 2, 3)) == [7, 6, 5] and ids(rel.paginate(ordered, 0, 0)) == [10]
    assert ids(rel.limit_offset(ordered, -1, -5)) == []
    assert ids(rel.rows_page(df, 0, 3)) == [10, 9, 8] and ids(rel.rows_page(df, 8, 3)) == [7, 6, 5]
    assert ids(rel.rows_page(df, 0, 0)) == [10] and len(ids(rel.rows_page(df, 0, 900))) == 10
    assert ids(rel.rows_page(df, 0, 9, rel.where_in(df, "b", ["t0"]).select("attachment_id"))) == [9, 6, 3]


def test_title_search(spark):
    media = spark.createDataFrame(
        [(1, "Red cat", "x/dog.png", "attachment", "inherit"), (2, "dog", "x/CAT.png", "attachment", "inherit"),
         (3, "cat", "cat.png", "attachment", "inherit"), (4, "cat", "cat.png", "page", "inherit"), (5, "bird", "b.png", "attachment", "inherit")],
        "attachment_id long, title string, filename string, post_type string, status string",
    )
    ids = lambda *a: [r["attachment_id"] for r in rel.search_titles(media, *a).collect()]
    assert ids("Cat") == [3, 1, 2] and ids("cat", 2) == [3, 1] and ids("") == [5, 3, 2, 1] and ids("zebra") == []


def test_date_range_ends(spark):
    df = spark.sql("select * from values (timestamp_ntz'2024-01-10 00:00:00'), (timestamp_ntz'2024-01-10 00:00:05'), (timestamp_ntz'2024-01-10 00:00:10') t(ts)")
    start = 1_704_844_800
    assert rel.where_date_range(df, "ts", start, start + 10).count() == 3
    assert rel.where_date_range(df, "ts", start, start + 10, inclusive=False).count() == 1


def test_last_change_of_a_key_wins_an_upsert(spark):
    index = ix.conform(spark.createDataFrame([(1, "a"), (2, "b")], "attachment_id long, phash string"))
    rows = [(1, "z", 9, 1), (1, "c", 2, 2), (3, "y", 5, 5), (3, "x", 5, 6)]
    changes = spark.createDataFrame(rows, "attachment_id long, phash string, file_size long, seq long")
    got = ix.upsert(index, changes)
    assert pairs_of(got, "attachment_id", "phash", "file_size") == [(1, "c", 2), (2, "b", 0), (3, "x", 5)]


def test_comparison_rows_without_order_are_a_narrow_scan(spark):
    index = ix.conform(spark.createDataFrame([(1, "a"), (2, "b")], "attachment_id long, phash string"))
    plain = ix.comparison_rows(index, newest_first=False)
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    assert pairs_of(plain, "attachment_id", "phash") == pairs_of(ix.comparison_rows(index), "attachment_id", "phash")


def test_uninstall_follows_the_settings(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.write(ix.conform(spark.createDataFrame([(1, "a")], "attachment_id long, phash string")))
    assert not uninstall(store, Settings(drop_on_uninstall=False)) and store.read().count() == 1
    assert uninstall(store) and store.versions() == [] and store.read().count() == 0
    assert not uninstall(store)


@pytest.mark.parametrize("name", ["reindex_everything", "reindex_remaining", "index_batches"])
def test_reindex_of_odd_documents_matches_its_sql(spark, tmp_path, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from oracle import compare

    texts = ["plain text", "", None, "\u0000", "more text", "\U0001f600"]
    rows = [(i, texts[i % 6], ("en", "fr", "de", None)[i % 4], f"src{i % 5}", i) for i in range(60)]
    rows += [(None, "no id", "en", "src1", 5), (None, "", "fr", "src2", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, 60, 7)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    db = duckdb.connect()
    for table in ("documents", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    ok, note = compare(spark, db, queries()[name], oracle_sql()[name], str(tmp_path))
    assert ok, note
