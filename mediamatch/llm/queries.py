"""The registered queries of the corpus operators; each derives its digest columns from the operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import corpus_pipeline
from mediamatch.llm import decontamination, language, lattice, licenses, lines, neighbours, packing, quality, secrets, simhash, suffixes, tries, variants
from mediamatch.llm.frames import read

Query = Callable[[SparkSession, str], DataFrame]
BASE_KINDS = ("assign", "access", "hex")


def nearest_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    text = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"]))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    base_text = F.array_join(F.transform(base, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def n(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")

    return found.select(
        "doc_id",
        *(n("kind", kind) for kind in BASE_KINDS),
        F.sha2(base_text, 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
        *(n("verdict", verdict) for verdict in ("live", "shared", "example", "weak")),
        F.coalesce(F.array_max(F.col("spans.owners")), F.lit(0)).alias("most_owners"),
        F.coalesce(F.array_max(F.col("spans.repos")), F.lit(0)).alias("most_repos"),
    )


def license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LICENSES = [
    (name, licenses.window_of(len(licenses.template_words(text))), text)
    for name, text in (*licenses.TEMPLATES.items(), *licenses.WORDINGS)
]
LICENSE_WINDOWS_SQL = rf"""
WITH templates(license, width, text) AS (VALUES
  {", ".join(f"({_quoted(name)}, {width}, {_quoted(text)})" for name, width, text in _LICENSES)}
), template_words AS (
  SELECT license, width, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words FROM templates
), pieces AS (
  SELECT license, width, list_distinct(list_transform(range(greatest(len(words) - 4, 1)),
    lambda i: array_to_string(words[(i + 1)::INTEGER:(i + 5)::INTEGER], ' '))) AS pieces FROM template_words
), texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS words
  FROM documents WHERE text IS NOT NULL
), starts AS (
  SELECT doc_id, width, words, unnest(range(0, greatest(len(words) - (width - width // 4) - 1, 0) + 1, width // 4)) AS first_word
  FROM texts, (SELECT DISTINCT width FROM templates)
), windows AS (
  SELECT doc_id, width, first_word, words[(first_word + 1)::INTEGER:(first_word + width)::INTEGER] AS w FROM starts
), shingled AS (
  SELECT doc_id, width, first_word, list_transform(range(greatest(len(w) - 4, 1)),
    lambda i: array_to_string(w[(i + 1)::INTEGER:(i + 5)::INTEGER], ' ')) AS own FROM windows
), matched AS (
  SELECT doc_id, license, first_word, len(list_intersect(own, pieces))::DOUBLE / len(pieces) AS containment
  FROM shingled JOIN pieces USING (width)
)
SELECT doc_id, license, max(containment) AS containment, min(first_word) AS first_word, count(DISTINCT first_word) AS windows
FROM matched WHERE containment >= 0.8 GROUP BY doc_id, license
"""


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(read(spark, sf_dir, "documents"))


def language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.array_join("langs", "+").alias("langs"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicate(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def lattice_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(read(spark, sf_dir, "documents"))


def packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


BENCHMARK_LEAKS_SQL = r"""
WITH items AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS item FROM benchmark
), item_words AS (
  SELECT item_id, item, unnest(item) AS word, unnest(range(len(item))) AS place FROM items
), texts AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS words
  FROM documents WHERE text IS NOT NULL
), text_words AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM texts
), laid AS (
  SELECT doc_id, item_id, len(item) AS n, count(*) AS matched
  FROM text_words t JOIN item_words i USING (word) GROUP BY doc_id, item_id, item, t.place - i.place
)
SELECT doc_id, item_id, max(matched)::INTEGER AS matched, arg_max(n, matched::DOUBLE / n)::INTEGER AS item_words,
       max(matched::DOUBLE / n) AS similarity
FROM laid WHERE matched::DOUBLE / n >= 0.8 GROUP BY doc_id, item_id
"""


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    kept = lines.kept_texts(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


REPEATED_LINES_SQL = r"""
WITH texts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM texts
), keyed AS (
  SELECT doc_id, line, place,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM placed
), judged AS (
  SELECT doc_id, line, place, length(key) < 10 OR doc_id = min(doc_id) OVER (PARTITION BY key) AS stays FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (stays), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the first h turns of the conversation that opens the hundred, then the own turns behind the first h;
    h is crc32 of the id, modulo 6."""
    own = conversations.withColumn("opening", F.col("conv_id") - F.col("conv_id") % 100)
    first = conversations.select(F.col("conv_id").alias("opening"), F.slice("turns", 1, 5).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    none = F.array().cast(f"array<{tries.TURN}>")
    turns = F.concat(F.slice(F.coalesce("first", none), F.lit(1), h), F.slice("turns", h + 1, F.size("turns")))
    return own.join(first, "opening", "left").select("conv_id", turns.alias("turns"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.nodes(rebuilt(tries.sequences(read(spark, sf_dir, "conversations"))))


CONVERSATION_TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashed AS (
  SELECT conv_id, own, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
    lambda a, x: list_reduce([xor(a, x)] || range(8),
      lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)), 4294967295) % 6 AS h
  FROM turns
), built AS (
  SELECT a.conv_id, coalesce(b.own, [])[1:a.h] || a.own[(a.h + 1):] AS path
  FROM hashed a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
  SELECT conv_id, d AS depth, path[1:d] AS prefix, len(path) = d AS ends
  FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM built)
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY prefix, depth
), linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes p ON c.depth = p.depth + 1 AND p.prefix = c.prefix[1:(c.depth - 1)]
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), weighed AS (
  SELECT l.*, coalesce(n_children, 0) AS n_children, CASE WHEN l.depth = 0 THEN 0 ELSE (n_convs - 1) * length(prefix[l.depth].text) END AS saved
  FROM linked l LEFT JOIN children USING (conv_id, depth)
), below AS (
  SELECT prefix[1:d] AS prefix, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM weighed) GROUP BY ALL
)
SELECT conv_id, w.depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM weighed w JOIN below b ON w.depth = b.depth AND w.prefix = b.prefix
"""


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(variants.vocabulary(read(spark, sf_dir, "documents")))


SPELLING_VARIANTS_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL
), steps AS (
  SELECT list(list_reduce([b] || range(8), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) ORDER BY b) AS step
  FROM (SELECT unnest(range(256)) AS b)
), bytes AS (
  SELECT runs.*, hex(encode(coalesce(doc_id::VARCHAR, 'null') || ':' || run)) AS digits FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce([4294967295] || list_transform(range(length(digits) // 2), lambda i: ('0x' || digits[(2 * i + 1):(2 * i + 2)])::BIGINT),
    lambda a, b: xor(a >> 8, step[(xor(a, b) & 255) + 1])), 4294967295) AS h
  FROM bytes, steps
), spoiled AS (
  SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM spoiled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cuts AS (
  SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, c.n, w.word, w.n FROM cuts c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, w.n, c.word, c.n FROM cuts c JOIN words w ON c.rest = w.word
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS rank FROM pairs
), best AS (
  SELECT word, n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM ranked WHERE rank = 1
), chains AS (
  SELECT word, form AS root, 1 AS step FROM best WHERE form IS NOT NULL
  UNION ALL SELECT c.word, b.form, step + 1 FROM chains c JOIN best b ON c.root = b.word WHERE b.form IS NOT NULL
), ends AS (SELECT word, arg_max(root, step) AS root FROM chains GROUP BY word)
SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, w.word) AS root
FROM words w LEFT JOIN best USING (word) LEFT JOIN ends USING (word)
"""

QUERIES: dict[str, Query] = {
    "op1_nearest_embeddings": nearest_embeddings,
    "op2_secret_ownership": secret_ownership,
    "op3_license_windows": license_windows,
    "op4_simhash_components": simhash_components,
    "op5_language_mixture": language_mixture,
    "op6_quality_scores": quality_scores,
    "op7_repeated_bytes": repeated_bytes,
    "op8_lattice_scores": lattice_scores,
    "op9_packed_sequences": packed_sequences,
    "op10_benchmark_leaks": benchmark_leaks,
    "op11_repeated_lines": repeated_lines,
    "op12_conversation_trie": conversation_trie,
    "op13_spelling_variants": spelling_variants,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op3_license_windows": LICENSE_WINDOWS_SQL,
    "op10_benchmark_leaks": BENCHMARK_LEAKS_SQL,
    "op11_repeated_lines": REPEATED_LINES_SQL,
    "op12_conversation_trie": CONVERSATION_TRIE_SQL,
    "op13_spelling_variants": SPELLING_VARIANTS_SQL,
}
