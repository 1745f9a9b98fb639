"""Streaming operators run to the end of the given tables."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mediamatch.catalog import index as cx
from mediamatch.catalog import tables as t
from mediamatch.catalog.registry import query
from mediamatch.plans.store import IndexStore
from mediamatch.schema import UNFINGERPRINTABLE
from mediamatch.session import checkpointed, scratch_folder, ship_package
from mediamatch.streaming.changes import ChangeStream, Stalled
from mediamatch.streaming.rate_limit import limit_requests, limit_stream

CAP = 2

RATE_SQL = f"""WITH RECURSIVE request AS (
  SELECT event_id, ts, user_id::VARCHAR AS client, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events), walk AS (
  SELECT client, n, event_id, s AS opened, 1 AS used, s FROM request WHERE n = 1
  UNION ALL
  SELECT r.client, r.n, r.event_id, CASE WHEN r.s >= w.opened + 60 THEN r.s ELSE w.opened END,
         CASE WHEN r.s >= w.opened + 60 THEN 1 ELSE w.used + 1 END, r.s
  FROM walk w JOIN request r ON r.client = w.client AND r.n = w.n + 1)
SELECT event_id, client, used <= {CAP} AS allowed FROM walk"""


def _requests(events):
    return events.select("event_id", "ts", F.col("user_id").cast("string").alias("client"))


@query("rate_limit", "T5", RATE_SQL)
def rate_limit(spark, sf_dir):
    ship_package(spark)
    limited = limit_requests(_requests(t.table(spark, sf_dir, "events")), CAP)
    return limited.select("event_id", "client", "allowed")


SLICES = 4
_SLICE_SQL = f"""least({SLICES - 1}, floor({SLICES} * (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE /
  (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) + 1 FROM events)))::BIGINT"""


#: Rows of a file of the stream; a slice has as many files as it needs, two at least, and makes one micro-batch.
FILE_ROWS = 250_000


def _slice(micros, low, high):
    return F.least(F.lit(SLICES - 1), F.floor(SLICES * (micros - low).cast("double") / (high - low + 1)))


def _event_stream(spark, sf_dir, place, order=range(SLICES), events=None):
    """The events as a stream of a micro-batch for each slice of time, in this order."""
    events = t.table(spark, sf_dir, "events") if events is None else events
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    part = _slice(micros, low, high)
    sizes = {r["part"]: r["count"] for r in events.groupBy(part.cast("int").alias("part")).count().collect()}
    files = max(2, -(-max(sizes.values()) // FILE_ROWS))
    for number in order:
        # round robin gives each file rows, and the source takes files by time
        slices = events.where(part == number).repartition(min(files, sizes.get(number, 0)) or 1)
        slices.write.mode("append").parquet(f"{place}/events")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/events")


@query("rate_limit_stream", "T5", RATE_SQL)
def rate_limit_stream(spark, sf_dir):
    ship_package(spark)
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    with scratch_folder(spark, "rate-limit") as place:
        limited = limit_stream(_requests(_event_stream(spark, sf_dir, place)), CAP, lateness="10 minutes")
        (
            limited.writeStream.format("parquet")
            .option("path", f"{place}/verdicts")
            .option("checkpointLocation", f"{place}/progress")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
        return checkpointed(spark.read.parquet(f"{place}/verdicts").select("event_id", "client", "allowed"))


def _applied_stream(spark, sf_dir, place, build, order=range(SLICES)):
    store = IndexStore(spark, f"{place}/index")
    store.write(cx.base_index(spark, sf_dir))
    changes = cx.as_changes(_event_stream(spark, sf_dir, place, order))
    stream = ChangeStream(store, build, f"{place}/stats")
    stream.start(changes, f"{place}/progress").awaitTermination()
    return stream


# The changes of each slice of time, as the stream meets them; those older than the stored row have no effect.
_SLICED_SQL = f"""sliced AS (
  SELECT *, {_SLICE_SQL} AS batch FROM change WHERE NOT (action = 'upload' AND is_probe)
), last_of_batch AS (
  SELECT * FROM sliced WHERE ts >= TIMESTAMP '{cx.STAMP}' OR attachment_id NOT IN (SELECT attachment_id FROM base)
  QUALIFY row_number() OVER (PARTITION BY attachment_id, batch ORDER BY ts DESC, seq DESC) = 1
), lost AS (
  SELECT DISTINCT b.attachment_id FROM last_of_batch b JOIN last_change l USING (attachment_id)
  WHERE b.action = 'delete' AND b.batch < {_SLICE_SQL.replace('(ts)', '(l.ts)', 1)}
)"""


@query(
    "change_stream",
    "T1 T2 T3 W3 C8 C10",
    f"""WITH {cx.applied_sql(_SLICED_SQL, "attachment_id NOT IN (SELECT attachment_id FROM lost)")}
        SELECT {cx.SHOWN_SQL}, indexed_at FROM applied""",
)
def change_stream(spark, sf_dir):
    with scratch_folder(spark, "changes") as place:
        stream = _applied_stream(spark, sf_dir, place, cx.build_uploads(spark, sf_dir))
        return checkpointed(cx.shown(stream.store.read()))


@query(
    "change_stream_progress",
    "T6 T3 A13",
    f"""WITH {cx.BASE_SQL}, {cx.CHANGES_SQL}, {_SLICED_SQL}, seen AS (
          SELECT *, lag(action) OVER (PARTITION BY attachment_id ORDER BY batch) AS before FROM last_of_batch)
        SELECT b.range AS batch_id, count(*) FILTER (action = 'upload') AS done,
               count(*) FILTER (action = 'upload' AND lang <> 'es') AS succeeded,
               count(*) FILTER (action = 'delete' AND (before = 'upload' OR
                 (before IS NULL AND attachment_id IN (SELECT attachment_id FROM base)))) AS deleted
        FROM range({SLICES}) b LEFT JOIN seen ON batch = b.range LEFT JOIN documents ON doc_id = attachment_id GROUP BY 1""",
)
def change_stream_progress(spark, sf_dir):
    with scratch_folder(spark, "changes") as place:
        return checkpointed(_applied_stream(spark, sf_dir, place, cx.build_facts(spark, sf_dir)).progress().drop("stream", "stalled"))


#: The slice of time in which no upload can be indexed.
OUTAGE = 1


@query(
    "change_stream_stalled",
    "T4 T3 T6 A13",
    f"""WITH {cx.BASE_SQL}, {cx.CHANGES_SQL}, {_SLICED_SQL}, seen AS (
          SELECT *, lag(action) OVER (PARTITION BY attachment_id ORDER BY batch) AS before FROM last_of_batch
        ), applied AS (
          SELECT b.range AS batch_id, count(*) FILTER (action = 'upload') AS done,
                 count(*) FILTER (action = 'upload' AND lang <> 'es' AND batch <> {OUTAGE}) AS succeeded,
                 count(*) FILTER (action = 'delete' AND (before = 'upload' OR
                   (before IS NULL AND attachment_id IN (SELECT attachment_id FROM base)))) AS deleted
          FROM range({SLICES}) b LEFT JOIN seen ON batch = b.range LEFT JOIN documents ON doc_id = attachment_id GROUP BY 1)
        SELECT *, done > 0 AND succeeded = 0 AS stalled FROM applied
        WHERE batch_id <= coalesce((SELECT min(batch_id) FROM applied WHERE done > 0 AND succeeded = 0), {SLICES})""",
)
def change_stream_stalled(spark, sf_dir):
    """A stream that meets a slice without any success: it stops there, behind its record of the failures."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = t.table(spark, sf_dir, "events").agg(F.min(micros), F.max(micros)).first()
    facts = cx.build_facts(spark, sf_dir)

    def build(uploads):
        out = _slice(F.unix_micros("indexed_at"), low, high) == OUTAGE
        built = facts(uploads)
        return built.withColumns(
            {
                "error_code": F.when(out, UNFINGERPRINTABLE).otherwise(F.col("error_code")),
                **{c: F.when(~out, F.col(c)).otherwise(F.lit("")) for c in ("phash", "file_hash")},
            }
        )

    with scratch_folder(spark, "changes") as place:
        try:
            stream = _applied_stream(spark, sf_dir, place, build)
        except StreamingQueryException as stopped:
            if Stalled.__name__ not in str(stopped):
                raise
            stream = ChangeStream(IndexStore(spark, f"{place}/index"), build, f"{place}/stats")
        return checkpointed(stream.progress().drop("stream"))


@query(
    "change_stream_two_sources",
    "T1 T2 T6",
    f"""WITH {cx.BASE_SQL}, change AS (
          SELECT event_id AS seq, date_trunc('day', ts) AS ts, user_id AS attachment_id, value < 5 AS is_probe,
                 CASE event_type WHEN 'signup' THEN 'upload' WHEN 'error' THEN 'delete' END AS action FROM events
        ), last_change AS (
          SELECT * FROM change WHERE action IS NOT NULL AND NOT (action = 'upload' AND is_probe)
            AND (ts >= TIMESTAMP '{cx.STAMP}' OR attachment_id NOT IN (SELECT attachment_id FROM base))
          QUALIFY row_number() OVER (PARTITION BY attachment_id ORDER BY ts DESC, seq DESC) = 1)
        SELECT attachment_id, coalesce(strftime(l.ts, '%Y-%m-%d %H:%M:%S'), b.indexed_at) AS indexed_at
        FROM base b FULL JOIN last_change l USING (attachment_id) WHERE l.action IS DISTINCT FROM 'delete'""",
)
def change_stream_two_sources(spark, sf_dir):
    """Two streams of one store, the later half of the events first, and then the first stream once more from a new
    checkpoint; times are cut to days, so that changes of one time must follow their numbers across streams."""
    events = t.table(spark, sf_dir, "events")
    events = events.withColumn("ts", F.date_trunc("day", F.col("ts").cast("timestamp")))
    build = cx.build_facts(spark, sf_dir)
    with scratch_folder(spark, "changes") as place:
        store = IndexStore(spark, f"{place}/index")
        store.write(cx.base_index(spark, sf_dir))
        for run, rest in (("odd", 1), ("even", 0), ("again", 1)):
            own = events.where(F.col("event_id") % 2 == rest)
            source = _event_stream(spark, sf_dir, f"{place}/{run}", reversed(range(SLICES)), own)
            ChangeStream(store, build).start(cx.as_changes(source), f"{place}/{run}/progress").awaitTermination()
            store.compact()
            store.prune()
        return checkpointed(cx.shown(store.read()).select("attachment_id", "indexed_at"))


@query(
    "change_stream_late",
    "T2 C15",
    f"""WITH {cx.BASE_SQL}, {cx.CHANGES_SQL}
        SELECT attachment_id, coalesce(l.stamp, b.indexed_at) AS indexed_at FROM base b FULL JOIN (
          SELECT attachment_id, action, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM last_change
          WHERE ts >= TIMESTAMP '{cx.STAMP}' OR attachment_id NOT IN (SELECT attachment_id FROM base)) l USING (attachment_id)
        WHERE l.action IS DISTINCT FROM 'delete'""",
)
def change_stream_late(spark, sf_dir):
    """The slices in reverse order: a late upload does not undo a newer delete, nor a late delete a newer upload."""
    with scratch_folder(spark, "changes") as place:
        stream = _applied_stream(spark, sf_dir, place, cx.build_facts(spark, sf_dir), reversed(range(SLICES)))
        stream.store.compact()
        stream.store.prune()
        return checkpointed(cx.shown(stream.store.read()).select("attachment_id", "indexed_at"))
