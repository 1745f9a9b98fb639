"""Stored band index: the keys of all stored hashes, laid out for the join that a search makes.

A search meets stored hashes on (part, key) of a cover. Here those rows are kept in a table bucketed by just that, so a
batch of probes shuffles its own keys to the buckets and the stored side is read where it lies. Deltas of an index
store add the hashes they bring; a hash is stored once however many images carry it.

A key that very many hashes share is cut into cells of about `crowd` hashes. New hashes of a full key go to new cells,
so no stored row moves; probes visit all cells of a key. Nothing is dropped.

Keys and pairs of a probe batch travel, so the table is for batches that make few of them for the rows there are (`pays`);
a search compares larger ones with the index in blocks. Near pairs at 20 bits are a fixed share of all pairs, which no
layout of keys changes.

Hashes that left the index stay in the table. They cost a comparison and vanish in the join that leads from hashes to
images. The table is append-only and each append is one commit: a hash whose append failed is missing and comes with
the next one. One writer at a time may extend it.

Defined results: null hashes are left out; repeated hashes are stored once; an empty table meets nothing.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mediamatch.functions.hashes import hamming, hash_to_long
from mediamatch.operators.hamming_join import BROADCAST_KEYS, HOT_BUCKET, Cover, EqualBands, NearBands, choose_cover
from mediamatch.operators.search import searchable
from mediamatch.plans.store import IndexStore
from mediamatch.schema import SEARCH_HAMMING_CAP
from mediamatch.session import checkpointed, file_system

_PLACE = ["part", "key", "cell"]
_TABLE = re.compile(r"bands-(equal|near)-(\d+)-(\d+)-in-(\d+)$")
_KINDS = {"equal": EqualBands, "near": NearBands}
CELL_SCHEMA = "part long, key long, cells int"
#: Hashes and probes that the choice of a cover and of the number of buckets expects.
EXPECTED_HASHES = 10_000_000
EXPECTED_PROBES = 1_000
#: Keys and pairs of hashes that a batch may make for each probe and stored hash, and those that any batch may make. A key
#: travels once, a pair several times and with sketches.
KEYS_PER_ROW, LEAST_KEYS = 64, 1 << 24
PAIRS_PER_ROW, LEAST_PAIRS = 8, 1 << 22
#: Hashes of both sides of which the share of near pairs is taken.
SAMPLED_PROBES, SAMPLED_HASHES = 500, 2_000
#: Stored rows of one bucket that the number of buckets aims at.
BUCKET_ROWS = 2_000_000


class BandIndex:
    """Band rows below the folder `root`. A folder keeps the cover and buckets it was made with."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        distance: int = SEARCH_HAMMING_CAP,
        cover: Cover | None = None,
        buckets: int | None = None,
        crowd: int = HOT_BUCKET,
        expected: int = EXPECTED_HASHES,
    ):
        self.spark, self.root, self.crowd = spark, root.rstrip("/"), crowd
        made = [m for path in self._listed("bands-*") if (m := _TABLE.search(path))]
        if made:
            kind, far, bands, count = made[0].groups()
            self.cover, self.buckets = _KINDS[kind](int(far), int(bands)), int(count)
        else:
            self.cover = cover or choose_cover(distance, EXPECTED_PROBES, expected)
            stored = expected * len(self._parts())
            least = int(spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = buckets or max(least, -(-stored // BUCKET_ROWS))
        self.table = "bands_" + hashlib.sha256(self.root.encode()).hexdigest()[:24]
        self._open()

    def _parts(self) -> list[int]:
        if isinstance(self.cover, EqualBands):
            return [part for part, _ in self.cover.parts()]
        return list(range(self.cover.bands))

    def _listed(self, pattern: str) -> list[str]:
        files, path = file_system(self.spark, f"{self.root}/{pattern}")
        return sorted(f.getPath().toString() for f in files.globStatus(path) or [])

    def _open(self) -> None:
        """Name the folder in the session's catalog, which need not outlive the session."""
        kind = "equal" if isinstance(self.cover, EqualBands) else "near"
        place = f"{self.root}/bands-{kind}-{self.cover.distance}-{self.cover.bands}-in-{self.buckets}"
        files, path = file_system(self.spark, place)
        files.mkdirs(path)
        quoted = place.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (part BIGINT, key BIGINT, cell INT, bits BIGINT) USING parquet "
            f"CLUSTERED BY (part, key, cell) SORTED BY (part, key, cell) INTO {self.buckets} BUCKETS LOCATION '{quoted}'"
        )
        self.spark.catalog.refreshTable(self.table)

    def forget(self) -> None:
        """Take the name out of the session's catalog; the folder stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def hashes(self) -> DataFrame:
        """The stored hashes: every hash has one row of the first part."""
        return self.rows().where(F.col("part") == self._parts()[0]).select("bits")

    def cells(self) -> DataFrame:
        """(part, key, cells) of the keys that have more than one cell."""
        known = self._listed("cells-*/_SUCCESS")
        if not known:
            return self.spark.createDataFrame([], CELL_SCHEMA)
        return self.spark.read.schema(CELL_SCHEMA).parquet(known[-1].rsplit("/", 1)[0])

    def _visiting(self, keyed: DataFrame) -> DataFrame:
        """The rows (part, key, bits), once for each cell of their key."""
        cells = self.cells()
        if isinstance(self.cover, NearBands) and self.cover.key_count() <= BROADCAST_KEYS:
            cells = F.broadcast(cells)  # as many rows as there are keys at most
        every = F.explode(F.sequence(F.lit(0), F.coalesce("cells", F.lit(1)) - 1)).alias("cell")
        return keyed.join(cells, ["part", "key"], "left").select("part", "key", every, "bits")

    def _meeting(self, keyed: DataFrame, condition: Column, how: str) -> DataFrame:
        l, r = self._visiting(keyed).alias("l"), self.rows().alias("r")
        same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in _PLACE]
        return l.join(r, same[0] & same[1] & same[2] & condition, how)

    def _missing(self, hashes: DataFrame) -> DataFrame:
        """Those of the hashes that are not stored, looked up on the keys of the first part."""
        keyed = self.cover.emit(hashes, wide=False).where(F.col("part") == self._parts()[0])
        # not an equality, which would ask for buckets by `bits` too
        same = F.col("l.bits").bitwiseXOR(F.col("r.bits")) == 0
        stored = self._meeting(keyed, same & (F.col("r.part") == self._parts()[0]), "left_semi").select("bits")
        return hashes.join(stored, "bits", "left_anti")

    def extend(self, hashes: DataFrame) -> int:
        """Store the hashes (column `bits`) that are not stored yet; returns how many."""
        wanted = checkpointed(hashes.select("bits").where(F.col("bits").isNotNull()).distinct())
        fresh = checkpointed(self._missing(wanted))
        added = fresh.count()
        if not added:
            return 0
        rows = self.cover.emit(fresh, wide=False)
        new = rows.groupBy("part", "key").agg(F.count("*").alias("new"))
        held = self.rows().groupBy(*_PLACE).agg(F.count("*").alias("n")).groupBy("part", "key")
        held = held.agg(F.sum("n").alias("held"), (F.max("cell") + 1).alias("cells"))
        before, filled = F.coalesce("cells", F.lit(0)), F.coalesce("held", F.lit(0)) + F.col("new")
        grown = new.join(held, ["part", "key"], "left").select(
            "part", "key", before.alias("before"), F.greatest(before, F.ceil(filled / self.crowd).cast("int")).alias("cells")
        )
        grown = checkpointed(grown.where(F.col("cells") > 1))
        self._keep_cells(grown.select("part", "key", "cells"))
        # new cells where the key has grown beyond the old ones, else its last cell
        first = F.when(F.col("cells") > F.col("before"), F.col("before")).otherwise(F.col("cells") - 1)
        own = first + F.pmod(F.xxhash64("bits"), F.col("cells") - first).cast("int")
        placed = rows.join(grown, ["part", "key"], "left").select("part", "key", F.coalesce(own, F.lit(0)).alias("cell"), "bits")
        placed.repartition(self.buckets, *_PLACE).write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return added

    def _keep_cells(self, grown: DataFrame) -> None:
        """Written before the rows they announce: a cell without rows is only visited in vain."""
        if grown.isEmpty():
            return
        known = self._listed("cells-*/_SUCCESS")
        number = int(known[-1].rsplit("/", 2)[1].split("-")[1]) + 1 if known else 1
        cells = self.cells().unionByName(grown).groupBy("part", "key").agg(F.max("cells").alias("cells"))
        cells.write.mode("overwrite").parquet(f"{self.root}/cells-{number:08d}")

    def follow(self, store: IndexStore) -> int:
        """Add what the store has got since the last call; returns how many hashes are new.

        Deltas are read alone. A full version written since then is read whole, as it may hold any row.
        """
        marks = self._listed("follows-*")
        seen = max((int(path.rsplit("-", 1)[1]) for path in marks), default=0)
        newest = store.newest()
        if newest <= seen:
            return 0
        changed = store.since(seen, newest)
        added = self.extend(searchable(changed).select(hash_to_long("phash").alias("bits")))
        files, path = file_system(self.spark, f"{self.root}/follows-{newest:08d}")
        files.createNewFile(path)
        for old in marks:
            files.delete(file_system(self.spark, old)[1], True)
        return added

    def pairs(self, probes: DataFrame, distance: int | None = None) -> DataFrame:
        """(left_bits, right_bits, distance) of probe hashes (distinct, column `bits`) and stored hashes within `distance`."""
        far = self.cover.distance if distance is None else distance
        if far > self.cover.distance:
            raise ValueError(f"the band index holds pairs up to {self.cover.distance} bits, not {far}")
        difference = F.col("l.bits").bitwiseXOR(F.col("r.bits"))
        close = (F.bit_count(difference) <= far) & self.cover.first_met(F.col("l.part"), difference)
        return self._meeting(self.cover.emit(probes, wide=True), close, "inner").select(
            F.col("l.bits").alias("left_bits"),
            F.col("r.bits").alias("right_bits"),
            hamming("l.bits", "r.bits").cast("int").alias("distance"),
        )

    def pays(self, probes: DataFrame, distance: int) -> bool:
        """Whether the keys of these probe hashes (distinct, column `bits`) and their near pairs, judged by samples, are few."""
        sizes = probes.count(), self.hashes().count()
        if sizes[0] * self.cover.wide_keys() > max(LEAST_KEYS, KEYS_PER_ROW * sum(sizes)):
            return False
        most = max(LEAST_PAIRS, PAIRS_PER_ROW * sum(sizes))
        if sizes[0] * sizes[1] <= most:
            return True
        some = lambda rows, n: rows.orderBy(F.xxhash64("bits")).limit(n)
        q = some(probes, SAMPLED_PROBES).withColumnRenamed("bits", "own")
        pairs = q.crossJoin(F.broadcast(some(self.hashes(), SAMPLED_HASHES)))
        apart = F.bit_count(F.col("own").bitwiseXOR(F.col("bits")))
        near, of = pairs.agg(F.count_if(apart <= distance), F.count("*")).first()
        return near * sizes[0] * sizes[1] <= most * of

    def near(self, probes: DataFrame, stored: DataFrame, distance: int) -> DataFrame:
        """As the search asks for pairs; `stored`, the hashes of the index, are in the table already."""
        return self.pairs(probes, distance)
