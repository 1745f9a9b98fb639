import random
from datetime import datetime, timedelta

import pytest
from conftest import pairs_of
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mediamatch.operators import index as ix
from mediamatch.plans.store import IndexStore
from mediamatch.schema import CHANGE_SCHEMA
from mediamatch.streaming.changes import Stalled
from mediamatch.streaming import ChangeStream, apply_changes, limit_requests, limit_stream

T0 = datetime(2024, 1, 1, 12)


def build(uploads):
    """Even ids are images, odd ids cannot be decoded."""
    ok = F.col("attachment_id") % 2 == 0
    vector = F.array(F.lit(1.0))
    print_ = F.struct(F.lit("a" * 16).alias("phash"), vector.alias("color_vector"), vector.alias("edge_vector"))
    rows = uploads.select("attachment_id", "ts", F.lit("image/png").alias("mime_type"), F.when(ok, print_).alias("fingerprint"))
    facts = rows.withColumns({"width": F.lit(1), "height": F.lit(1), "file_size": F.lit(1), "file_hash": F.lit("h")})
    return ix.build_rows(facts, F.col("ts"))


def change(seq, minute, attachment, action, probe=False):
    return (seq, T0 + timedelta(minutes=minute), attachment, action, probe)


CHANGES = [
    change(1, 1, 2, "upload"),
    change(2, 2, 4, "upload"),
    change(3, 3, 3, "upload"),
    change(4, 4, 2, "delete"),
    change(5, 5, 6, "upload", True),
    change(6, 6, 2, "upload"),
    change(7, 7, 4, "delete"),
    change(8, 8, 8, "upload"),
    change(9, 8, 8, "delete"),
    change(10, -60, 10, "delete"),
    change(11, 9, 12, "delete"),
]


def start_index(spark):
    rows = spark.createDataFrame([(10, "b" * 16), (12, "c" * 16)], "attachment_id long, phash string")
    return ix.conform(rows.withColumn("indexed_at", F.lit(T0)))


EXPECTED = [(2, "a" * 16, ""), (3, "", "unfingerprintable"), (10, "b" * 16, "")]


def test_changes_of_one_batch(spark):
    got = apply_changes(start_index(spark), spark.createDataFrame(CHANGES, CHANGE_SCHEMA), build)
    assert pairs_of(got, "attachment_id", "phash", "error_code") == EXPECTED


def test_stream_of_files_ends_like_one_batch(spark, tmp_path):
    for i in range(0, len(CHANGES), 3):
        spark.createDataFrame(CHANGES[i : i + 3], CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = IndexStore(spark, str(tmp_path / "index"))
    store.write(start_index(spark))
    stream = ChangeStream(store, build, str(tmp_path / "stats"))
    source = spark.readStream.schema(CHANGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.start(source, str(tmp_path / "progress")).awaitTermination()
    assert pairs_of(store.read(), "attachment_id", "phash", "error_code") == EXPECTED
    progress = stream.progress()
    assert progress.count() == 4 and progress.agg(F.sum("deleted")).first()[0] >= 2
    # A second run has nothing new and changes nothing.
    versions = store.versions()
    stream.start(source, str(tmp_path / "progress")).awaitTermination()
    assert store.versions() == versions


def test_batch_without_success_stops_the_stream(spark, tmp_path):
    bad = [change(1, 1, 3, "upload"), change(2, 2, 5, "upload")]
    spark.createDataFrame(bad, CHANGE_SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = IndexStore(spark, str(tmp_path / "index"))
    source = spark.readStream.schema(CHANGE_SCHEMA).parquet(str(tmp_path / "in"))
    with pytest.raises(StreamingQueryException, match="Stalled"):
        ChangeStream(store, build).start(source, str(tmp_path / "progress")).awaitTermination()
    # The failures were recorded; a restart finds them and goes on with what comes next.
    failed = [(3, "", "unfingerprintable"), (5, "", "unfingerprintable")]
    assert pairs_of(store.read(), "attachment_id", "phash", "error_code") == failed
    more = [change(3, 3, 2, "upload")]
    spark.createDataFrame(more, CHANGE_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ChangeStream(store, build).start(source, str(tmp_path / "progress")).awaitTermination()
    assert pairs_of(store.read(), "attachment_id", "phash", "error_code") == [(2, "a" * 16, ""), *failed]


def test_stalled_batch_keeps_its_deletes_and_is_not_applied_twice(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.write(start_index(spark))
    stream = ChangeStream(store, build)
    batch = spark.createDataFrame([change(1, 1, 3, "upload"), change(2, 2, 12, "delete")], CHANGE_SCHEMA)
    with pytest.raises(Stalled):
        stream.apply(batch, 0)
    want = [(3, "", "unfingerprintable"), (10, "b" * 16, "")]
    assert pairs_of(store.read(), "attachment_id", "phash", "error_code") == want
    versions = store.versions()
    stream.apply(batch, 0)
    assert store.versions() == versions


def test_late_changes_do_not_undo_newer_ones(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    stream = ChangeStream(store, build)
    late = [change(1, 3, 2, "upload"), change(2, 2, 4, "delete"), change(3, 1, 6, "upload")]
    early = [change(4, 9, 2, "delete"), change(5, 9, 4, "upload"), change(6, 9, 8, "upload")]
    for i, rows in enumerate((early, late)):
        stream.apply(spark.createDataFrame(rows, CHANGE_SCHEMA), i)
    assert pairs_of(store.read(), "attachment_id") == [(4,), (6,), (8,)]
    store.compact()
    stream.apply(spark.createDataFrame([change(7, 5, 2, "upload")], CHANGE_SCHEMA), 2)
    assert pairs_of(store.read(), "attachment_id") == [(4,), (6,), (8,)]


def files(spark, path, rows, schema=CHANGE_SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_streams_of_one_store_lose_no_batch(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    files(spark, tmp_path / "one", [change(1, 1, 2, "upload")])
    files(spark, tmp_path / "two", [change(2, 2, 4, "upload")])
    run = lambda source, progress: (
        ChangeStream(store, build, str(tmp_path / "stats"))
        .start(spark.readStream.schema(CHANGE_SCHEMA).parquet(str(tmp_path / source)), str(tmp_path / progress))
        .awaitTermination()
    )
    run("one", "a")
    run("two", "b")
    assert pairs_of(store.read(), "attachment_id") == [(2,), (4,)]
    assert ChangeStream(store, build, str(tmp_path / "stats")).progress().count() == 2
    # A new checkpoint reads everything again, without effect on what came later.
    files(spark, tmp_path / "two", [change(3, 9, 2, "delete")])
    run("two", "b")
    run("one", "c")
    assert pairs_of(store.read(), "attachment_id") == [(4,)]


def test_records_of_batches_survive_pruning(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    stream = ChangeStream(store, build)
    batches = [spark.createDataFrame([change(i, i, 2 * i, "upload")], CHANGE_SCHEMA) for i in range(4)]
    for i, name in ((0, "x"), (1, "x"), (0, "y")):
        stream.apply(batches[i], i, name)
    store.compact()
    assert store.prune() == 3
    versions = store.versions()
    for i, name in ((0, "x"), (1, "x"), (0, "y")):
        stream.apply(batches[i], i, name)
    assert store.versions() == versions
    stream.apply(batches[3], 1, "y")
    stream.apply(batches[2], 2, "x")
    store.compact()
    store.prune()
    assert [store.recorded(*a) for a in ((2, "x"), (3, "x"), (1, "y"), (2, "y"), (0, "z"))] == [True, False, True, False, False]
    assert pairs_of(store.read(), "attachment_id") == [(0,), (2,), (4,), (6,)]


def test_equal_times_follow_the_sequence(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    stream = ChangeStream(store, build)
    apply = lambda i, *rows: stream.apply(spark.createDataFrame(list(rows), CHANGE_SCHEMA), i)
    apply(0, change(8, 5, 2, "delete"), change(4, 5, 4, "upload"), change(9, 5, 6, "upload"))
    apply(1, change(3, 5, 2, "upload"), change(5, 5, 4, "delete"), change(7, 5, 6, "delete"))
    assert pairs_of(store.read(), "attachment_id") == [(6,)]
    store.compact()
    apply(2, change(6, 5, 2, "upload"), change(10, 5, 4, "upload"))
    assert pairs_of(store.read(), "attachment_id") == [(4,), (6,)]


def test_delta_between_read_and_write_is_kept(spark, tmp_path):
    store, other = (IndexStore(spark, str(tmp_path / "index")) for _ in range(2))
    store.write(start_index(spark))
    read = store.read()
    ChangeStream(other, build).apply(spark.createDataFrame([change(1, 1, 2, "upload")], CHANGE_SCHEMA), 0)
    store.write(read)
    assert pairs_of(store.read(), "attachment_id") == [(2,), (10,), (12,)]


def requests(seed, n=600):
    rng = random.Random(seed)
    out, at = [], {"busy": 0.0, "calm": 0.0, "odd": 0.0}
    for i in range(n):
        client = "busy" if rng.random() < 0.5 else rng.choice(["calm", "odd"])
        at[client] += rng.choice([0, 0, 0.2, 1, 7, 60, 61]) if client != "busy" else rng.choice([0, 0.1, 0.5, 3])
        out.append((i, T0 + timedelta(seconds=at[client]), client))
    return out


def verdicts(rows, cap):
    opened, used, out = {}, {}, []
    for i, ts, client in sorted(rows, key=lambda r: (r[1], r[0])):
        second = int(ts.timestamp() // 1)
        if client not in opened or second >= opened[client] + 60:
            opened[client], used[client] = second, 0
        used[client] += 1
        out.append((i, client, used[client] <= cap))
    return sorted(out)


SCHEMA = "event_id long, ts timestamp, client string"


@pytest.mark.parametrize("cap", [1, 3, 10, 60])
def test_rate_limit_batch(spark, cap):
    rows = requests(cap)
    got = limit_requests(spark.createDataFrame(rows, SCHEMA).repartition(5), cap)
    assert pairs_of(got, "event_id", "client", "allowed") == verdicts(rows, cap)


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(requests(4, 300), key=lambda r: (r[1], r[0]))
    for i in range(0, len(rows), 100):
        spark.createDataFrame(rows[i : i + 100], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        limit_stream(source, 5).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert pairs_of(got, "event_id", "client", "allowed") == verdicts(rows, 5)


def run_limiter(spark, tmp_path, batches, cap, lateness):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for rows in batches:
        files(spark, tmp_path / "in", rows, SCHEMA)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        limit_stream(source, cap, lateness=lateness).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    state = spark.read.format("statestore").option("stateVarName", "window").load(str(tmp_path / "progress"))
    return pairs_of(spark.read.parquet(str(tmp_path / "out")), "event_id", "client", "allowed", "late"), state.count()


def test_state_of_idle_clients_goes_and_late_requests_are_marked(spark, tmp_path):
    at = lambda i, second, client: (i, T0 + timedelta(seconds=second), client)
    batches = [
        [at(0, 0, "a"), at(1, 1, "a"), at(2, 2, "a"), at(3, 5, "b")],
        [at(4, 400, "c")],
        [at(5, 401, "c"), at(6, 30, "a"), at(7, 390, "c"), at(8, 395, "b")],
    ]
    got, held = run_limiter(spark, tmp_path, batches, 2, "30 seconds")
    assert [r for r in got if r[3]] == [(6, "a", False, True), (7, "c", False, True)]
    assert [(r[0], r[2]) for r in got if not r[3]] == [(0, True), (1, True), (2, False), (3, True), (4, True), (5, True), (8, True)]
    assert held == 2  # c and b; a is idle


def test_watermarked_stream_equals_batch_on_ordered_requests(spark, tmp_path):
    rows = sorted(requests(6, 400), key=lambda r: (r[1], r[0]))
    got, _ = run_limiter(spark, tmp_path, [rows[i : i + 100] for i in range(0, 400, 100)], 3, "5 seconds")
    assert [r[:3] for r in got] == verdicts(rows, 3) and not any(r[3] for r in got)
