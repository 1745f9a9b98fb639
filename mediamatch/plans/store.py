"""Index versions on shared storage: full versions, and deltas on top of them.

A full version holds the whole index, a delta only changed rows; deletions are rows too (tombstones with
the time of the delete), so a change that arrives late meets them. Reading takes the newest full version
and lets the newest delta row of each key win, so a change writes bytes in proportion to itself;
`compact` folds the deltas into a new full version.

A version counts once its commit marker exists, which Spark writes last: readers never see half a version,
and a scan keeps reading the version it started on. Numbers are claimed by creating a file that must not
exist yet, so no writer overwrites another. A full version names the number it was made from; later deltas
of other writers still apply on top of it, and of two full versions made from the same number the second
fails.

A stream's batch is known by the stream's id and the batch number, as every stream counts from 0. The record is the
delta's own name, so it is committed with the rows; before `prune` removes deltas it notes the last batch of their
streams in a file. Rows and tombstones keep the sequence number of their change, so of equal times the later
change counts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mediamatch.operators.index import KEY, conform
from mediamatch.schema import INDEX_SCHEMA, Settings
from mediamatch.session import file_system

_NAME = re.compile(r"(full|delta)-(\d+)-(?:after|batch)-(-?\d+)(?:-of-([\w.-]+))?$")
_DONE = re.compile(r"done-([\w.-]+)-upto-(\d+)$")
ROW_SCHEMA = T.StructType([*INDEX_SCHEMA.fields, T.StructField("deleted", T.BooleanType()), T.StructField("seq", T.LongType())])
DELTA_SCHEMA = T.StructType([*ROW_SCHEMA.fields, T.StructField("change", T.LongType())])
NO_BATCH = -1


class VersionConflict(RuntimeError):
    """Another writer made a full version from the same state."""


@dataclass(frozen=True)
class _Version:
    number: int
    full: bool
    tag: int  # of a full version the number it was made from, of a delta its batch
    path: str
    stream: str  # of a delta, where a stream wrote it


class IndexStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._seen: int | None = None  # the version last read

    def _listed(self, pattern: str) -> list[str]:
        files, path = file_system(self.spark, f"{self.root}/{pattern}")
        return [f.getPath().toString() for f in files.globStatus(path) or []]

    def _committed(self) -> list[_Version]:
        out = []
        for marker in self._listed("*/_SUCCESS"):
            place = marker.rsplit("/", 1)[0]
            if found := _NAME.search(place):
                out.append(_Version(int(found[2]), found[1] == "full", int(found[3]), place, found[4] or ""))
        return sorted(out, key=lambda v: v.number)

    def versions(self) -> list[int]:
        return [v.number for v in self._committed()]

    def newest(self) -> int:
        return (self.versions() or [0])[-1]

    def recorded(self, batch_id: int, stream: str = "") -> bool:
        """Whether this batch of the stream was committed; batches of a stream come in order. Deltas that name no stream
        are not remembered once `prune` has removed them."""
        noted = [_DONE.search(path) for path in self._listed(f"done-{stream}-upto-*")]
        upto = [int(m[2]) for m in noted if m and m[1] == stream]
        upto += [v.tag for v in self._committed() if not v.full and v.stream == stream]
        return max(upto, default=NO_BATCH) >= batch_id

    def _claim(self) -> int:
        taken = [int(p.rsplit("-", 1)[1]) for p in self._listed("claim-*")]
        number = max([self.newest(), *taken]) + 1
        while True:
            files, path = file_system(self.spark, f"{self.root}/claim-{number:08d}")
            if files.createNewFile(path):
                return number
            number += 1

    def rows(self, version: int | None = None) -> DataFrame:
        """The index of a version, the newest by default, with tombstones (column `deleted`)."""
        known = [v for v in self._committed() if version is None or v.number <= version]
        fulls = [v for v in known if v.full]
        base = fulls[-1] if fulls else None
        deltas = [v.path for v in known if not v.full and v.number > (base.tag if base else 0)]
        whole = (
            self.spark.read.schema(ROW_SCHEMA).parquet(base.path) if base else self.spark.createDataFrame([], ROW_SCHEMA)
        )
        if not deltas:
            return whole
        changed = self.spark.read.schema(DELTA_SCHEMA).parquet(*deltas)
        newest = changed.groupBy(KEY).agg(F.max_by(F.struct(*ROW_SCHEMA.names), "change").alias("row")).select("row.*")
        return whole.join(changed.select(KEY).distinct(), KEY, "left_anti").unionByName(newest)

    def read(self, version: int | None = None) -> DataFrame:
        """A frozen version, the newest by default; no rows where nothing was written yet."""
        self._seen = self.newest() if version is None else version
        return self.rows(self._seen).where(~F.col("deleted")).drop("deleted", "seq")

    def write(self, index: DataFrame, by_id: bool = False, after: int | None = None) -> int:
        """Write the next full version; returns its number.

        `after` is the version it was made from, by default the one that this store read last, or the newest if it read
        none: deltas that others commit meanwhile still apply on top. `by_id` range-partitions and sorts by attachment
        id so that keyset pages skip row groups; it costs one shuffle of the index.
        """
        if after is None:
            after = self.newest() if self._seen is None else self._seen
        rows = conform(index).withColumn("deleted", F.lit(False)).withColumn("seq", F.lit(None).cast("long"))
        return self._write_full(rows, by_id, after)

    def _write_full(self, rows: DataFrame, by_id: bool, after: int) -> int:
        number = self._claim()
        if by_id:
            rows = rows.repartitionByRange(KEY).sortWithinPartitions(KEY)
        place = f"{self.root}/full-{number:08d}-after-{after}"
        rows.write.mode("error").parquet(place)
        if any(v.full and after < v.number < number for v in self._committed()):
            files, path = file_system(self.spark, place)
            files.delete(path, True)
            raise VersionConflict(f"another full version was written after version {after}")
        self._seen = number
        return number

    def append(self, rows: DataFrame, deletes: DataFrame, batch_id: int = NO_BATCH, stream: str = "") -> int:
        """Write a delta of whole index rows and of tombstones (attachment_id, ts), one row for each key.

        Both may have the sequence number of their change in a column `seq`.
        """
        number = self._claim()

        def numbered(part: DataFrame, deleted: bool) -> DataFrame:
            seq = F.col("seq") if "seq" in part.columns else F.lit(None)
            return conform(part.withColumn("seq", seq.cast("long")).withColumn("deleted", F.lit(deleted)), ("deleted", "seq"))

        times = [KEY, F.col("ts").alias("indexed_at"), *(c for c in deletes.columns if c == "seq")]
        changed = numbered(rows, False).unionByName(numbered(deletes.select(*times), True))
        place = f"{self.root}/delta-{number:08d}-batch-{batch_id}" + (f"-of-{stream}" if stream else "")
        changed.withColumn("change", F.lit(number).cast("long")).write.mode("error").parquet(place)
        return number

    def delta(self, version: int) -> DataFrame:
        """The rows that one delta wrote, without tombstones."""
        place = next(v.path for v in self._committed() if v.number == version and not v.full)
        return self.spark.read.schema(DELTA_SCHEMA).parquet(place).where(~F.col("deleted")).drop("deleted", "seq", "change")

    def since(self, seen: int, upto: int) -> DataFrame:
        """Rows written after version `seen`, up to `upto`: those of the deltas, and of the last full version if it is newer."""
        known = [v for v in self._committed() if v.number <= upto]
        fulls = [v for v in known if v.full and v.number > seen]
        base = fulls[-1] if fulls else None
        deltas = [v.path for v in known if not v.full and v.number > (base.tag if base else seen)]
        out = self.spark.createDataFrame([], INDEX_SCHEMA)
        for schema, paths in ((ROW_SCHEMA, [base.path] if base else []), (DELTA_SCHEMA, deltas)):
            if paths:
                rows = self.spark.read.schema(schema).parquet(*paths).where(~F.col("deleted"))
                out = out.unionByName(rows.select(*INDEX_SCHEMA.names))
        return out

    def compact(self, forget_before=None) -> int:
        """Fold the deltas into a new full version; tombstones older than `forget_before` go."""
        after = self.newest()
        rows = self.rows(after)
        if forget_before is not None:
            rows = rows.where(~F.col("deleted") | (F.col("indexed_at") >= F.lit(forget_before)))
        return self._write_full(rows, False, after)

    def prune(self) -> int:
        """Remove versions that the newest full one replaces; returns how many. No reader may still use them."""
        known = self._committed()
        fulls = [v for v in known if v.full]
        old = [v for v in known if fulls and v.number < fulls[-1].number and (v.full or v.number <= fulls[-1].tag)]
        for stream in {v.stream for v in old if v.stream}:
            self._note(stream, max(v.tag for v in old if v.stream == stream))
        for v in old:
            files, path = file_system(self.spark, v.path)
            files.delete(path, True)
        return len(old)

    def _note(self, stream: str, batch_id: int) -> None:
        """Keep the record of a stream's batches up to this one."""
        before = [path for path in self._listed(f"done-{stream}-upto-*") if (m := _DONE.search(path)) and m[1] == stream]
        if any(int(_DONE.search(path)[2]) >= batch_id for path in before):
            return
        files, path = file_system(self.spark, f"{self.root}/done-{stream}-upto-{batch_id}")
        files.createNewFile(path)
        for old in before:
            files.delete(file_system(self.spark, old)[1], True)

    def clear(self) -> int:
        """Write an empty version; returns how many rows the one before held."""
        removed = self.read().count()
        self.write(self.spark.createDataFrame([], INDEX_SCHEMA))
        return removed

    def drop(self) -> bool:
        """Remove all versions and the record of the streams; whether there was anything."""
        files, path = file_system(self.spark, self.root)
        self._seen = None
        return files.delete(path, True)

    def counts(self) -> DataFrame:
        return self.read().agg(
            F.count_if(F.col("error_code") == "").alias("indexed"), F.count_if(F.col("error_code") != "").alias("failed")
        )


def uninstall(store: IndexStore, settings: Settings = Settings()) -> bool:
    """Remove the index where the settings ask for it (`drop_on_uninstall`); whether it was removed."""
    return settings.drop_on_uninstall and store.drop()
