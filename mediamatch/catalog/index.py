"""Index maintenance over documents and labels."""

from pyspark.sql import functions as F

from mediamatch.catalog import tables as t
from mediamatch.catalog.registry import query
from mediamatch.operators import index as ix
from mediamatch.plans.indexing import index_batch, index_images, reindex
from mediamatch.plans.store import IndexStore
from mediamatch.schema import ALLOWED_MIME, Settings
from mediamatch.session import checkpointed, scratch_folder, ship_package
from mediamatch.sources.text_images import text_as_image

STAMP = "2024-01-15 00:00:00"


def base_index(spark, sf_dir):
    """Labelled documents as index rows: byte facts without image features, so that nothing has to be decoded."""
    documents = t.table(spark, sf_dir, "documents").withColumn("file_hash", F.md5(F.col("text").cast("binary")))
    facts = documents.select(
        F.col("doc_id").alias("attachment_id"), F.substring("file_hash", 1, 16).alias("phash"), "file_hash", F.col("n_chars").alias("file_size")
    )
    ok = F.col("error_code") == ""
    rows = t.membership(spark, sf_dir).join(facts, "attachment_id")
    return ix.conform(
        rows.withColumn("phash", F.when(ok, F.col("phash")).otherwise(""))
        .withColumn("file_hash", F.when(ok, F.col("file_hash")).otherwise(""))
        .withColumn("mime_type", F.lit("image/jpeg"))
        .withColumn("width", F.lit(640))
        .withColumn("indexed_at", F.lit(STAMP).cast("timestamp"))
    )


BASE_SQL = f"""{t.MEDIA_SQL}, {t.MEMBERSHIP_SQL}, base AS (
  SELECT attachment_id, CASE WHEN error_code = '' THEN left(file_hash, 16) ELSE '' END AS phash,
         CASE WHEN error_code = '' THEN file_hash ELSE '' END AS file_hash, file_size, 'image/jpeg' AS mime_type, 640 AS width,
         error_code, '{STAMP}' AS indexed_at
  FROM membership JOIN media m USING (attachment_id))"""

SHOWN = ["attachment_id", "phash", "file_hash", "file_size", "mime_type", "width", "error_code"]
SHOWN_SQL = ", ".join(SHOWN)


def shown(index):
    return index.select(*SHOWN, F.date_format("indexed_at", "yyyy-MM-dd HH:mm:ss").alias("indexed_at"))


@query(
    "library_counts",
    "A3",
    f"""WITH {t.MEDIA_SQL}, {t.MEMBERSHIP_SQL}, c AS (
          SELECT (SELECT count(*) FROM media WHERE post_type = 'attachment' AND starts_with(mime_type, 'image/')) AS total,
                 (SELECT count(*) FROM membership WHERE error_code = '') AS indexed,
                 (SELECT count(*) FROM membership WHERE error_code <> '') AS failed)
        SELECT total, indexed, failed, greatest(0, total - indexed - failed) AS pending FROM c""",
)
def library_counts(spark, sf_dir):
    return ix.library_counts(t.media(spark, sf_dir), t.membership(spark, sf_dir))


@query(
    "attachments_by_type",
    "A4",
    f"""WITH {t.MEDIA_SQL} SELECT mime_type, count(*) AS n, starts_with(mime_type, 'image/') AS is_image
        FROM media WHERE post_type = 'attachment' GROUP BY mime_type""",
)
def attachments_by_type(spark, sf_dir):
    return ix.count_by_mime(t.media(spark, sf_dir)).withColumn("is_image", F.col("mime_type").startswith("image/"))


@query(
    "unindexed_images",
    "J3 U2",
    f"""WITH {t.MEDIA_SQL}, {t.MEMBERSHIP_SQL} SELECT attachment_id FROM media ANTI JOIN membership USING (attachment_id)
        WHERE post_type = 'attachment' AND mime_type IN ({", ".join(f"'{m}'" for m in ALLOWED_MIME)}) ORDER BY 1""",
)
def unindexed_images(spark, sf_dir):
    waiting = ix.unindexed(t.media(spark, sf_dir), t.membership(spark, sf_dir), ALLOWED_MIME)
    return waiting.select("attachment_id").orderBy("attachment_id")


@query(
    "unindexed_any_image",
    "J3 U2",
    f"""WITH {t.MEDIA_SQL}, {t.MEMBERSHIP_SQL} SELECT mime_type, count(*) AS n FROM media ANTI JOIN membership USING (attachment_id)
        WHERE post_type = 'attachment' AND starts_with(mime_type, 'image/') GROUP BY mime_type""",
)
def unindexed_any_image(spark, sf_dir):
    waiting = ix.unindexed(t.media(spark, sf_dir), t.membership(spark, sf_dir))
    return waiting.groupBy("mime_type").agg(F.count("*").alias("n"))


_LIVE_SQL = "SELECT attachment_id FROM media WHERE post_type = 'attachment'"


@query(
    "orphan_count",
    "J5",
    f"""WITH {t.MEDIA_SQL}, {t.MEMBERSHIP_SQL} SELECT count(*) AS orphans FROM membership
        WHERE attachment_id NOT IN ({_LIVE_SQL})""",
)
def orphan_count(spark, sf_dir):
    return ix.orphan_count(t.membership(spark, sf_dir), t.media(spark, sf_dir))


@query(
    "orphans_deleted",
    "J6",
    f"""WITH {t.MEDIA_SQL}, {t.MEMBERSHIP_SQL} SELECT attachment_id, error_code FROM membership
        WHERE attachment_id IN ({_LIVE_SQL})""",
)
def orphans_deleted(spark, sf_dir):
    return ix.delete_orphans(t.membership(spark, sf_dir), t.media(spark, sf_dir))


@query(
    "comparison_rows",
    "S4 F6 F7",
    f"""WITH {BASE_SQL} SELECT attachment_id, phash, '[' || (file_size / 2.0)::DOUBLE || ',' || file_size::DOUBLE || ']' AS vector_text
        FROM base WHERE error_code = ''""",
)
def comparison_rows(spark, sf_dir):
    from mediamatch.functions import decode_vector, encode_vector

    size = F.col("file_size").cast("double")
    base = base_index(spark, sf_dir)
    vectors = base.withColumn("color_vector", F.array(size / 2, size))
    # The vector is written as JSON text, read back, and written again.
    text = encode_vector(decode_vector(encode_vector("color_vector")))
    return ix.comparison_rows(vectors).select("attachment_id", "phash", text.alias("vector_text"))


@query(
    "duplicate_scan_rows",
    "S5",
    f"WITH {BASE_SQL} SELECT attachment_id, phash, file_hash FROM base WHERE error_code = ''",
)
def duplicate_scan_rows(spark, sf_dir):
    return ix.duplicate_rows(base_index(spark, sf_dir))


# Events as changes: a signup uploads, an error deletes the document numbered like the user.
def as_changes(events):
    action = F.when(F.col("event_type") == "signup", "upload").when(F.col("event_type") == "error", "delete")
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("attachment_id"),
        action.alias("action"),
        (F.col("value") < 5).alias("is_probe"),
    ).where(F.col("action").isNotNull())


def changes(spark, sf_dir):
    return as_changes(t.table(spark, sf_dir, "events"))


CHANGES_SQL = """change AS (
  SELECT event_id AS seq, ts, user_id AS attachment_id, CASE event_type WHEN 'signup' THEN 'upload' ELSE 'delete' END AS action,
         value < 5 AS is_probe
  FROM events WHERE event_type IN ('signup', 'error')), last_change AS (
  SELECT * FROM change WHERE NOT (action = 'upload' AND is_probe)
  QUALIFY row_number() OVER (PARTITION BY attachment_id ORDER BY ts DESC, seq DESC) = 1)"""


def _uploaded(spark, sf_dir, uploads):
    documents = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("attachment_id"),
        F.md5(F.col("text").cast("binary")).alias("file_hash"),
        F.col("n_chars").alias("file_size"),
        F.when(F.col("lang") == "es", "application/pdf").otherwise("image/png").alias("mime_type"),
        "text",
    )
    return uploads.select("attachment_id", "ts").join(documents, "attachment_id", "left")


def build_uploads(spark, sf_dir):
    """Index rows for uploaded documents: the text is decoded as an image and fingerprinted."""
    ship_package(spark)

    def build(uploads):
        pictures = text_as_image(_uploaded(spark, sf_dir, uploads)).drop("text")
        return index_images(pictures, F.col("ts"))

    return build


def build_facts(spark, sf_dir):
    """Index rows for uploaded documents, from byte facts alone."""

    def build(uploads):
        blank = F.lit(None).cast("array<double>")
        print_ = F.struct(F.substring("file_hash", 1, 16).alias("phash"), blank.alias("color_vector"), blank.alias("edge_vector"))
        facts = _uploaded(spark, sf_dir, uploads).drop("text").withColumn("fingerprint", print_)
        return ix.build_rows(facts.withColumn("width", F.lit(800)).withColumn("height", F.lit(600)), F.col("ts"))

    return build


def applied_sql(more: str = "", kept_if: str = "true") -> str:
    """The index after all changes; `kept_if` holds for the stored rows that a failed upload may lean on."""
    return f"""{BASE_SQL}, {t.PHASH_SQL}, {CHANGES_SQL}, {more + ", " if more else ""}kept AS (
  SELECT * FROM base WHERE attachment_id NOT IN
    (SELECT attachment_id FROM last_change WHERE action = 'delete' AND ts >= TIMESTAMP '{STAMP}') AND {kept_if}
), fresh AS (
  SELECT attachment_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS indexed_at, lang <> 'es' AS ok, md5(text) AS fresh_hash, phash AS fresh_print,
         w, n_chars
  FROM last_change JOIN documents ON doc_id = attachment_id JOIN hashed USING (attachment_id)
  JOIN (SELECT attachment_id, w FROM canvas) USING (attachment_id)
  WHERE action = 'upload' AND (ts >= TIMESTAMP '{STAMP}' OR attachment_id NOT IN (SELECT attachment_id FROM base))
), applied AS (
  SELECT coalesce(f.attachment_id, k.attachment_id) AS attachment_id,
         CASE WHEN f.attachment_id IS NULL THEN k.phash WHEN ok THEN fresh_print ELSE '' END AS phash,
         CASE WHEN f.attachment_id IS NULL THEN k.file_hash WHEN ok THEN fresh_hash ELSE '' END AS file_hash,
         CASE WHEN ok THEN n_chars ELSE coalesce(k.file_size, 0) END AS file_size,
         CASE WHEN ok THEN 'image/png' ELSE coalesce(k.mime_type, '') END AS mime_type,
         CASE WHEN ok THEN w ELSE coalesce(k.width, 0) END AS width,
         CASE WHEN f.attachment_id IS NULL THEN k.error_code WHEN ok THEN '' ELSE 'unsupported_mime' END AS error_code,
         coalesce(f.indexed_at, k.indexed_at) AS indexed_at
  FROM kept k FULL JOIN fresh f ON f.attachment_id = k.attachment_id
)"""


@query(
    "latest_change",
    "W3",
    f"""WITH {CHANGES_SQL} SELECT seq, attachment_id, action, is_probe FROM last_change""",
)
def latest_change(spark, sf_dir):
    counted = changes(spark, sf_dir).where(~((F.col("action") == "upload") & F.col("is_probe")))
    return ix.latest_per_key(counted).select("seq", "attachment_id", "action", "is_probe")


@query("changes_applied", "T1 T2 W3 C8 C9 C10", f"WITH {applied_sql()} SELECT {SHOWN_SQL}, indexed_at FROM applied")
def changes_applied(spark, sf_dir):
    from mediamatch.streaming.changes import apply_changes

    return shown(apply_changes(base_index(spark, sf_dir), changes(spark, sf_dir), build_uploads(spark, sf_dir)))


# A partial upsert: all English documents get a new size; those not in the index become rows with defaults.
@query(
    "index_upsert",
    "C8 F7",
    f"""WITH {BASE_SQL}, fresh AS (SELECT doc_id AS attachment_id, n_chars + 1 AS file_size FROM documents WHERE lang = 'en')
        SELECT coalesce(b.attachment_id, f.attachment_id) AS attachment_id, coalesce(phash, '') AS phash, coalesce(file_hash, '') AS file_hash,
               coalesce(f.file_size, b.file_size) AS file_size, coalesce(mime_type, '') AS mime_type, coalesce(width, 0) AS width,
               coalesce(error_code, '') AS error_code, CASE WHEN f.attachment_id IS NULL THEN indexed_at ELSE '2024-02-01 00:00:00' END AS indexed_at
        FROM base b FULL JOIN fresh f ON f.attachment_id = b.attachment_id""",
)
def index_upsert(spark, sf_dir):
    fresh = (
        t.table(spark, sf_dir, "documents")
        .where(F.col("lang") == "en")
        .select(
            F.col("doc_id").alias("attachment_id"),
            (F.col("n_chars") + 1).alias("file_size"),
            F.lit("2024-02-01 00:00:00").cast("timestamp").alias("indexed_at"),
        )
    )
    return shown(ix.upsert(base_index(spark, sf_dir), fresh))


@query(
    "index_mark_failed",
    "C9",
    f"""WITH {BASE_SQL}, bad AS (SELECT doc_id AS attachment_id FROM labels WHERE toxic = 1)
        SELECT attachment_id, CASE WHEN hit THEN '' ELSE phash END AS phash, CASE WHEN hit THEN '' ELSE file_hash END AS file_hash,
               file_size, mime_type, width, CASE WHEN hit THEN 'unfingerprintable' ELSE error_code END AS error_code,
               CASE WHEN hit THEN '2024-02-01 00:00:00' ELSE indexed_at END AS indexed_at
        FROM (SELECT *, attachment_id IN (SELECT attachment_id FROM bad) AS hit FROM base)""",
)
def index_mark_failed(spark, sf_dir):
    bad = (
        t.table(spark, sf_dir, "labels")
        .where(F.col("toxic") == 1)
        .select(F.col("doc_id").alias("attachment_id"), F.lit("unfingerprintable").alias("error_code"))
    )
    return shown(ix.mark_failed(base_index(spark, sf_dir), bad, F.lit("2024-02-01 00:00:00").cast("timestamp")))


@query(
    "index_delete",
    "C10",
    f"""WITH {BASE_SQL} SELECT {SHOWN_SQL}, indexed_at FROM base
        WHERE attachment_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def index_delete(spark, sf_dir):
    keys = t.table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("attachment_id"))
    return shown(ix.delete_keys(base_index(spark, sf_dir), keys))


@query(
    "index_deleted_count",
    "C10",
    f"""WITH {t.MEMBERSHIP_SQL} SELECT count(*) AS deleted FROM membership
        WHERE attachment_id IN (SELECT doc_id FROM documents WHERE lang = 'fr')""",
)
def index_deleted_count(spark, sf_dir):
    keys = t.table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("attachment_id"))
    return ix.deleted_count(t.membership(spark, sf_dir), keys)


@query("index_clear", "C11", "SELECT count(*) AS removed, 0::BIGINT AS remaining FROM labels")
def index_clear(spark, sf_dir):
    with scratch_folder(spark, "index") as place:
        store = IndexStore(spark, place)
        store.write(ix.conform(t.membership(spark, sf_dir)))
        removed = store.clear()
        return checkpointed(store.read().agg(F.lit(removed).cast("bigint").alias("removed"), F.count("*").alias("remaining")))


@query(
    "orders_guarded_update",
    "C12",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_totalprice > 200000 THEN 'O' ELSE o_orderstatus END AS o_orderstatus
       FROM orders""",
)
def orders_guarded_update(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    hit = (F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 200_000)
    return ix.update_where(orders, hit, {"o_orderstatus": "O"}).drop("o_totalprice")


@query("orders_guarded_delete", "C12", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderpriority = '5-LOW')")
def orders_guarded_delete(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders")
    return ix.delete_where(orders, F.col("o_orderpriority") == "5-LOW").select("o_orderkey", "o_orderstatus")


@query(
    "index_insert",
    "C13",
    f"""WITH {BASE_SQL} SELECT {SHOWN_SQL}, indexed_at FROM base UNION ALL
        SELECT attachment_id, '', file_hash, file_size, mime_type, 0, '', '{STAMP}' FROM media ANTI JOIN membership USING (attachment_id)""",
)
def index_insert(spark, sf_dir):
    documents = t.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("attachment_id"), F.md5(F.col("text").cast("binary")).alias("file_hash")
    )
    base = base_index(spark, sf_dir)
    new = t.media(spark, sf_dir).join(documents, "attachment_id").join(t.membership(spark, sf_dir), "attachment_id", "left_anti")
    return shown(ix.insert(base, ix.conform(new.withColumn("indexed_at", F.lit(STAMP).cast("timestamp")))))


@query(
    "batch_accounting",
    "A13",
    f"""WITH {BASE_SQL} SELECT m.parent_id = 0 AS batch, count(*) AS done, count(*) FILTER (error_code = '') AS succeeded
        FROM base JOIN media m USING (attachment_id) GROUP BY 1""",
)
def batch_accounting(spark, sf_dir):
    parents = t.media(spark, sf_dir).select("attachment_id", (F.col("parent_id") == 0).alias("batch"))
    return ix.batch_accounting(t.membership(spark, sf_dir).join(parents, "attachment_id"), "batch")


@query(
    "reindex_remaining",
    "C14 J3 C7 C13",
    f"""WITH {t.MEDIA_SQL}, {t.MEMBERSHIP_SQL} SELECT count(*) AS done, count(*) AS succeeded
        FROM media ANTI JOIN membership USING (attachment_id)
        WHERE post_type = 'attachment' AND mime_type IN ('image/jpeg', 'image/png')""",
)
def reindex_remaining(spark, sf_dir):
    with scratch_folder(spark, "index") as place:
        store = IndexStore(spark, place)
        store.write(base_index(spark, sf_dir))
        # The SQL counts every accepted document as indexed, so those without text are pictures, too.
        return checkpointed(reindex(store, t.images(spark, sf_dir, blank=True)))


_WAITING_SQL = """waiting AS (
  SELECT attachment_id, row_number() OVER (ORDER BY attachment_id) AS n FROM media ANTI JOIN membership USING (attachment_id)
  WHERE post_type = 'attachment' AND mime_type IN ('image/jpeg', 'image/png'))"""


@query(
    "index_batches",
    "T3 A13 J3 C7",
    f"""WITH {t.MEDIA_SQL}, {t.MEMBERSHIP_SQL}, {_WAITING_SQL}, batch AS (
          SELECT b.range AS batch, (SELECT count(*) FROM waiting) AS waiting FROM range(3) b)
        SELECT batch, greatest(0, least(25, waiting - 25 * batch)) AS done, greatest(0, least(25, waiting - 25 * batch)) AS succeeded,
               greatest(0, waiting - 25 * (batch + 1)) AS remaining,
               (SELECT max(attachment_id) FROM waiting WHERE n <= 25 * (batch + 1)) AS last_id
        FROM batch""",
)
def index_batches(spark, sf_dir):
    """Three bounded batches of the backlog, each behind the one before."""
    images = t.images(spark, sf_dir, blank=True)
    before = base_index(spark, sf_dir).select(ix.KEY)
    out = None
    with scratch_folder(spark, "index") as place:
        store = IndexStore(spark, place)
        store.write(base_index(spark, sf_dir))
        for batch in range(3):
            counted = index_batch(store, images, Settings(batch_size=25))
            last = store.read().join(before, ix.KEY, "left_anti").agg(F.max(ix.KEY).alias("last_id")).first()["last_id"]
            number = F.lit(batch).cast("long").alias("batch")
            row = checkpointed(counted.select(number, "done", "succeeded", "remaining", F.lit(last).cast("long").alias("last_id")))
            out = row if out is None else out.unionByName(row)
    return out


@query(
    "reindex_everything",
    "C14 C11 C7",
    f"""WITH {t.MEDIA_SQL} SELECT count(*) AS done, count(*) AS succeeded FROM media
        WHERE post_type = 'attachment' AND mime_type IN ('image/jpeg', 'image/png')""",
)
def reindex_everything(spark, sf_dir):
    with scratch_folder(spark, "index") as place:
        store = IndexStore(spark, place)
        store.write(base_index(spark, sf_dir))
        return checkpointed(reindex(store, t.images(spark, sf_dir, blank=True), everything=True))


@query(
    "frozen_version",
    "C15",
    f"""WITH {BASE_SQL} SELECT {SHOWN_SQL}, indexed_at FROM base""",
)
def frozen_version(spark, sf_dir):
    with scratch_folder(spark, "index") as place:
        store = IndexStore(spark, place)
        first = store.write(base_index(spark, sf_dir), by_id=True)
        frozen = store.read(first)
        store.write(frozen.where("error_code <> ''"))
        return checkpointed(shown(frozen))
