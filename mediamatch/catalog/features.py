"""Image features of the documents."""

from pyspark.sql import functions as F

from mediamatch.catalog import tables as t
from mediamatch.catalog.registry import query
from mediamatch.functions.hashes import hamming_hex
from mediamatch.operators import features as feat
from mediamatch.plans.indexing import index_images
from mediamatch.plans.probes import intake
from mediamatch.schema import ALLOWED_MIME, Settings
from mediamatch.sources.images import admit_probes


def _texts(column: str):
    """Vectors as text of whole millionths: one exact value per row to compare."""
    return F.array_join(F.transform(column, lambda v: F.round(v * 1_000_000).cast("bigint").cast("string")), " ").alias(column)


def _texts_sql(column: str) -> str:
    return f"array_to_string(list_transform({column}, lambda v: round(v * 1000000)::BIGINT), ' ') AS {column}"


@query("coefficient_block_hash", "I5 F9", f"WITH {t.BLOCKS_SQL} SELECT vec_id, phash FROM blocks")
def coefficient_block_hash(spark, sf_dir):
    return t.blocks(spark, sf_dir).select("vec_id", "phash")


@query(
    "document_dct",
    "I2 I4 X1",
    f"""WITH {t.MEDIA_SQL}, {t.PHASH_SQL} SELECT attachment_id, u * 8 + v AS position, round(d, 4) AS coefficient FROM dct""",
)
def document_dct(spark, sf_dir):
    rows = feat.with_features(t.images(spark, sf_dir), [feat.DCT])
    return rows.select("attachment_id", F.posexplode("dct").alias("position", "coefficient")).select(
        "attachment_id", F.col("position").cast("bigint").alias("position"), F.round("coefficient", 4).alias("coefficient")
    )


@query(
    "document_hash",
    "I2 I4 I5",
    f"WITH {t.MEDIA_SQL}, {t.PHASH_SQL} SELECT attachment_id, phash FROM hashed",
)
def document_hash(spark, sf_dir):
    return feat.with_features(t.images(spark, sf_dir), [feat.PHASH]).select("attachment_id", "phash")


@query(
    "document_fingerprint",
    "I2 I3 I4 I5 I6 I7 A10 A11 F7",
    f"""WITH {t.FINGERPRINT_SQL}
        SELECT attachment_id, phash, {_texts_sql('color_vector')}, {_texts_sql('edge_vector')} FROM printed""",
)
def document_fingerprint(spark, sf_dir):
    rows = feat.with_features(t.images(spark, sf_dir))
    return rows.select("attachment_id", "phash", _texts("color_vector"), _texts("edge_vector"))


def _digits_apart(n: int) -> str:
    pieces = [f"bit_count(xor(('0x' || substr(a, {at}, 8))::UBIGINT, ('0x' || substr(b, {at}, 8))::UBIGINT))" for at in range(1, n, 8)]
    return " + ".join(pieces)


@query(
    "long_hash_distance",
    "F1",
    f"""WITH digest AS (SELECT doc_id, md5(text) AS short, md5(text) || left(md5(text || 'x'), 8) AS long FROM documents),
        pair AS (SELECT x.doc_id, x.short AS a, y.short AS b, x.long AS c, y.long AS d FROM digest x JOIN digest y ON y.doc_id = x.doc_id + 1)
        SELECT doc_id, ({_digits_apart(32)})::INTEGER AS distance_32,
               (SELECT ({_digits_apart(40)})::INTEGER FROM (SELECT c AS a, d AS b)) AS distance_40,
               64 AS unequal FROM pair""",
)
def long_hash_distance(spark, sf_dir):
    """Bit distances of neighbouring documents' digests, longer than a 64-bit hash."""
    digest = lambda text: F.md5(text.cast("binary"))
    text = F.col("text")
    digests = t.table(spark, sf_dir, "documents").select(
        "doc_id", digest(text).alias("short"), F.concat(digest(text), F.substring(digest(F.concat(text, F.lit("x"))), 1, 8)).alias("long")
    )
    after = digests.select((F.col("doc_id") - 1).alias("doc_id"), F.col("short").alias("b"), F.col("long").alias("d"))
    return digests.join(after, "doc_id").select(
        "doc_id",
        hamming_hex("short", "b").alias("distance_32"),
        hamming_hex("long", "d").alias("distance_40"),
        hamming_hex("short", "d").alias("unequal"),
    )


def _capped_sql(width: str, height: str, edge: int, side: str) -> str:
    return f"""CASE WHEN greatest({width}, {height}) > {edge}
      THEN greatest(1, round({side} * {edge}.0::DOUBLE / greatest({width}, {height})))::BIGINT ELSE {side} END"""


@query(
    "working_sizes",
    "I1 I9",
    f"""WITH size AS (SELECT doc_id, n_chars AS w, greatest(1, n_chars // 3) AS h FROM documents),
       probe AS (SELECT doc_id, {_capped_sql('w', 'h', Settings().downscale_max, 'w')} AS pw,
                 {_capped_sql('w', 'h', Settings().downscale_max, 'h')} AS ph FROM size)
       SELECT doc_id, pw AS probe_width, ph AS probe_height, {_capped_sql('pw', 'ph', 512, 'pw')} AS width,
              {_capped_sql('pw', 'ph', 512, 'ph')} AS height FROM probe""",
)
def working_sizes(spark, sf_dir):
    """Sizes after probe intake, then after the working ceiling."""
    size = t.table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("n_chars").cast("int").alias("width"),
        F.greatest(F.lit(1), F.floor(F.col("n_chars") / 3)).cast("int").alias("height"),
    )
    probe = size.select("doc_id", feat.capped_size(F.col("width"), F.col("height"), Settings().downscale_max).alias("probe"))
    capped = feat.capped_size(F.col("probe.width"), F.col("probe.height"), feat.MAX_WORKING_EDGE)
    return probe.select("doc_id", "probe", capped.alias("size")).select(
        "doc_id",
        F.col("probe.width").cast("bigint").alias("probe_width"),
        F.col("probe.height").cast("bigint").alias("probe_height"),
        F.col("size.width").cast("bigint").alias("width"),
        F.col("size.height").cast("bigint").alias("height"),
    )


@query(
    "blank_fallback",
    "I8",
    f"""WITH {t.MEDIA_SQL}, {t.PHASH_SQL}
        SELECT attachment_id, CASE WHEN attachment_id % 2 = 0 THEN repeat('0', 16) ELSE phash END AS phash FROM hashed""",
)
def blank_fallback(spark, sf_dir):
    """Every other picture has lost its pixels behind an intact size: its features are blank, not missing."""
    lost = F.when(F.col("attachment_id") % 2 == 0, F.substring("data", 1, 1)).otherwise(F.col("data"))
    rows = t.images(spark, sf_dir).withColumn("data", lost)
    return feat.with_features(rows, [feat.PHASH]).select("attachment_id", "phash")


@query(
    "probe_admission",
    "S8 S2",
    f"""WITH {t.MEDIA_SQL}, probe AS (
          SELECT attachment_id, file_hash, file_size * 1000 AS file_size, mime_type, file_size AS width, 2 * file_size AS height FROM media)
        SELECT attachment_id, file_hash,
               CASE WHEN file_size > 10485760 THEN 'too_many_bytes'
                    WHEN mime_type NOT IN ({", ".join(f"'{m}'" for m in ALLOWED_MIME)}) THEN 'unsupported_mime'
                    WHEN width * height > 16777216 THEN 'too_many_pixels' END AS reject_reason FROM probe""",
)
def probe_admission(spark, sf_dir):
    documents = t.table(spark, sf_dir, "documents").withColumn("file_hash", F.md5(F.col("text").cast("binary")))
    media = t.media(spark, sf_dir).join(documents.select(F.col("doc_id").alias("attachment_id"), "file_hash"), "attachment_id")
    probes = media.select(
        "attachment_id",
        "file_hash",
        (F.col("file_size") * 1000).alias("file_size"),
        "mime_type",
        F.col("file_size").alias("width"),
        (2 * F.col("file_size")).alias("height"),
    )
    return admit_probes(probes).select("attachment_id", "file_hash", "reject_reason")


@query(
    "probe_intake",
    "I9 S8 S2",
    f"""WITH {t.MEDIA_SQL}, {t.PHASH_SQL}
        SELECT attachment_id, CASE WHEN NOT ok THEN 'unsupported_mime' END AS reject_reason, CASE WHEN ok THEN phash END AS phash
        FROM (SELECT *, mime_type IN ({", ".join(f"'{m}'" for m in ALLOWED_MIME)}) AS ok FROM media) JOIN hashed USING (attachment_id)""",
)
def probe_intake(spark, sf_dir):
    return intake(t.images(spark, sf_dir), processors=(feat.PHASH,)).select("attachment_id", "reject_reason", "phash")


@query(
    "index_from_images",
    "C7 S2 F12",
    f"""WITH {t.MEDIA_SQL}, {t.PHASH_SQL}
        SELECT attachment_id, CASE WHEN ok THEN phash ELSE '' END AS phash, CASE WHEN ok THEN w ELSE 0 END AS width,
               CASE WHEN ok THEN h ELSE 0 END AS height, CASE WHEN ok THEN mime_type ELSE '' END AS mime_type,
               CASE WHEN ok THEN file_size ELSE 0 END AS file_size, CASE WHEN ok THEN file_hash ELSE '' END AS file_hash,
               CASE WHEN ok THEN '' ELSE 'unsupported_mime' END AS error_code
        FROM (SELECT *, mime_type IN ('image/jpeg', 'image/png') AS ok FROM media)
        JOIN canvas USING (attachment_id) JOIN hashed USING (attachment_id)""",
)
def index_from_images(spark, sf_dir):
    rows = index_images(t.images(spark, sf_dir))
    return rows.select(
        "attachment_id",
        "phash",
        F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"),
        "mime_type",
        "file_size",
        "file_hash",
        "error_code",
    )
