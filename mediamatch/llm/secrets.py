"""Secret scan judged by corpus-wide ownership.

Patterns find candidate values in whole texts. The values travel as digests only: each is aggregated over
the corpus by distinct owners and distinct repositories. A value is widely held if it stands with at least
`widely_from` owners and as many repositories; that bound grows with the logarithm of the corpus' owners.

Verdicts: `example`, widely held, and made of words or too plain to be a credential; `shared`, widely held
but random, which may well be a key that leaked to several owners; `live`, looks like a credential and is
not widely held; `weak`, all others. Long mixed runs that no base pattern covers are reported only if live.

Digests are pre-aggregated to distinct (value, owner) and (value, repository) before they meet, so a value
in a third of all rows is one row per owner after the first stage; the way back is a join that adaptive
execution splits where a value is hot.

Defined results: a null text is empty and has no span; a null owner or repository is not counted; repeated
rows are judged row by row and add nothing to distinct counts; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mediamatch.llm.frames import filled, unused
from mediamatch.session import checkpointed

#: Order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "hosted", "signed", "opaque")
#: Least owners and repositories of a widely held value.
EXAMPLE_OWNERS = 3
#: Share of a value's characters that stand in small-letter runs of four or more, from which it is made of words.
WORDY = 0.3
LIVE_ENTROPY = 3.0
LIVE_LENGTH = 16
OPAQUE_ENTROPY = 4.0
ASSIGN = re.compile(
    "(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
LONG_RUN = re.compile("[A-Za-z0-9+/_=-]{24,}")
HOSTED_HINTS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xox", "glpat-")
HOSTED = re.compile("(?:gh[pousr]_|sk-|xox[abprs]-|glpat-)[A-Za-z0-9_-]{20,}", re.ASCII)
SIGNED = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", re.ASCII)
SMALL_RUN = re.compile("[a-z]{4,}")
SPAN = "array<struct<kind:string,start:int,stop:int,digest:string,looks_live:boolean,wordy:boolean>>"


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def looks_live(value: str) -> bool:
    return len(value) >= LIVE_LENGTH and any(c.isdigit() for c in value) and entropy(value) >= LIVE_ENTROPY


def wordy(value: str) -> bool:
    return sum(len(run) for run in SMALL_RUN.findall(value)) >= WORDY * len(value)


class Cover:
    """What stretches of a text a list of spans covers, merged, so that a text full of spans is asked quickly."""

    def __init__(self, spans: list[tuple[str, int, int, str]]) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []
        for start, stop in sorted((s[1], s[2]) for s in spans):
            if self.stops and start <= self.stops[-1]:
                self.stops[-1] = max(self.stops[-1], stop)
            else:
                self.starts.append(start)
                self.stops.append(stop)

    def meets(self, start: int, stop: int) -> bool:
        at = bisect_right(self.stops, start)
        return at < len(self.starts) and self.starts[at] < stop


def candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, stop, value) by start, then kind."""
    found: list[tuple[str, int, int, str]] = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    runs = list(LONG_RUN.finditer(text))
    for run in runs:
        found += [
            ("hex", run.start() + m.start(), run.start() + m.end(), m[0]) for m in HEX.finditer(run[0]) if m.end() - m.start() >= 32
        ]
    taken = Cover(found)
    for kind, pattern, hints in (("hosted", HOSTED, HOSTED_HINTS), ("signed", SIGNED, ("eyJ",))):
        if any(hint in text for hint in hints):
            found += [(kind, m.start(), m.end(), m[0]) for m in pattern.finditer(text)]
    for run in runs:
        value = run[0]
        mixed = re.search("[0-9]", value) and re.search("[a-z]", value) and re.search("[A-Z]", value)
        if mixed and entropy(value) >= OPAQUE_ENTROPY and not taken.meets(run.start(), run.end()):
            found.append(("opaque", run.start(), run.end(), value))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


def digest(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("digest", pa.string()), ("looks_live", pa.bool_()), ("wordy", pa.bool_())]
        )
    )
    for batch in batches:
        spans = [
            [
                {"kind": k, "start": a, "stop": b, "digest": digest(value), "looks_live": looks_live(value), "wordy": wordy(value)}
                for k, a, b, value in candidates(text.as_py())
            ]
            for text in filled(batch.column(3))
        ]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(spans, kind)], names=["doc_id", "owner", "repo", "spans"]
        )


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """One row per document: id, owner, repository and candidate spans."""
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        docs[owner_col].cast("string").alias("owner"),
        docs[repo_col].cast("string").alias("repo"),
        docs[text_col].alias("text"),
    )
    return rows.mapInArrow(_find, f"doc_id long, owner string, repo string, spans {SPAN}")


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repos): in how many distinct owners and repositories each value occurs."""
    values = found.select("owner", "repo", F.explode("spans.digest").alias("digest"))
    owners = values.select("digest", "owner").distinct().groupBy("digest").agg(F.count("owner").alias("owners"))
    repos = values.select("digest", "repo").distinct().groupBy("digest").agg(F.count("repo").alias("repos"))
    return owners.join(repos, "digest")


def widely_from(docs: DataFrame, owner_col: str = "source", least: int = EXAMPLE_OWNERS) -> int:
    """Owners, and repositories, that make a value widely held in this corpus: the base-2 logarithm of all its owners,
    `least` at least. A value of chance copies meets more owners in a corpus that has more of them."""
    owners = docs.agg(F.count_distinct(docs[owner_col].cast("string"))).first()[0]
    return max(least, math.ceil(math.log2(owners or 1)))


def _verdict(widely: int) -> Column:
    held = (F.col("owners") >= widely) & (F.col("repos") >= widely)
    plain = ~F.col("looks_live") | F.col("wordy")
    return (
        F.when(held & plain, "example").when(held, "shared").when(F.col("looks_live"), "live").otherwise("weak").alias("verdict")
    )


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """One row per document: id and spans (kind, start, stop, digest, owners, repos, verdict) in text order."""
    found = checkpointed(find(docs, id_col, text_col, owner_col, repo_col).withColumn("row", F.monotonically_increasing_id()))
    spans = found.where(F.size("spans") > 0).select("row", F.explode("spans").alias("s")).select("row", "s.*")
    verdict = _verdict(widely_from(docs, owner_col, example_owners))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("rank")
    judged = spans.join(ownership(found), "digest").select("row", "start", rank, "stop", "kind", "digest", "owners", "repos", verdict)
    judged = judged.where((F.col("kind") != "opaque") | (F.col("verdict") == "live"))
    listed = judged.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "stop", "kind", "digest", "owners", "repos", "verdict"))).alias("spans")
    )
    ids = found.select("row", "doc_id")
    kept = "array<struct<start:int,rank:int,stop:int,kind:string,digest:string,owners:bigint,repos:bigint,verdict:string>>"
    return ids.join(listed, "row", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(kept)).alias("spans")
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """The same rows and columns, with every secret but widely copied examples replaced by its kind in angle brackets.

    Random values are masked however many owners share them, but for long runs that no pattern names."""
    found = checkpointed(find(docs, id_col, text_col, owner_col, repo_col).where(F.size("spans") > 0))
    widely = widely_from(docs, owner_col)
    held = ownership(found).where((F.col("owners") >= widely) & (F.col("repos") >= widely))
    spans = found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.digest", "s.kind", "s.looks_live", "s.wordy")
    spared = spans.where(~F.col("looks_live") | F.col("wordy") | (F.col("kind") == "opaque")).select("doc_id", "digest").distinct()
    copied = spared.join(held.select("digest"), "digest", "left_semi")
    own_id, examples = unused(docs, "example_id"), unused(docs, "examples")
    per_doc = copied.groupBy(F.col("doc_id").alias(own_id)).agg(F.collect_set("digest").alias(examples))
    columns, kinds = docs.columns, docs.dtypes
    same = docs[id_col].cast("long").eqNullSafe(per_doc[own_id])
    joined = docs.join(per_doc, same, "left").select(*(docs[c] for c in columns), per_doc[examples])
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                None if text is None else masked(text, set(known or ()))
                for text, known in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist())
            ]
            arrays = list(batch.columns[: len(columns)])
            arrays[at] = pa.array(texts, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return joined.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in kinds))


def masked(text: str, examples: set[str]) -> str:
    """The text with its secrets replaced, overlapping spans as one."""
    out, at = [], 0
    for kind, start, stop, value in candidates(text):
        if digest(value) in examples or stop <= at:
            continue
        if kind == "opaque" and not looks_live(value):
            continue
        out += [text[at : max(start, at)], f"<{kind}>" if start >= at else ""]
        at = stop
    return "".join(out) + text[at:]
