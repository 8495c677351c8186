"""Copies of one keyed dataset, aligned by shared ordinals and compared through compressed presence bitmaps.

All copies are united in long form and grouped by key once, so every key gets one ordinal that all copies share. Each
run of CHUNK ordinals keeps one bitmap per copy and the copies' columns as vectors in ordinal order. AND-NOT of two
bitmaps gives the keys missing on one side; their AND drives the comparison of the aligned vectors.

An ordinal is the place of the key in the shuffle partition, used only inside the task that gave it, or comes from a
`Dictionary`: a table of keys and ordinals that is kept, and that later snapshots extend.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import Written, partitions

#: Ordinals per bitmap container.
CHUNK = 1 << 15
#: Copies aligned at once; more are taken in overlapping runs, so rows stay narrow.
WIDTH = 24


class Bitmap:
    """A set of ordinals below `size`, kept as the cheapest of a sorted list, runs, or packed bits."""

    __slots__ = ("data", "kind", "size")

    def __init__(self, present: np.ndarray):
        self.size = len(present)
        on = np.flatnonzero(present)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], present.astype(np.int8), [0]))))
        if len(edges) * 4 <= min(len(on) * 2, self.size // 8):
            self.kind, self.data = "runs", edges.astype(np.int32)
        elif len(on) * 2 <= self.size // 8:
            self.kind, self.data = "list", on.astype(np.uint16)
        else:
            self.kind, self.data = "bits", np.packbits(present)

    def members(self) -> np.ndarray:
        """The ordinals in the set, ascending."""
        if self.kind == "bits":
            return np.flatnonzero(np.unpackbits(self.data, count=self.size))
        if self.kind == "list":
            return self.data.astype(np.int64)
        a, b = self.data.reshape(-1, 2).T.astype(np.int64)
        n = b - a
        return np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())

    def has(self, at: np.ndarray) -> np.ndarray:
        """Which of the ordinals are in the set; nothing is unpacked."""
        if self.kind == "bits":
            return (self.data[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
        if self.kind == "runs":
            return np.searchsorted(self.data, at, "right") % 2 == 1
        i = np.searchsorted(self.data, at)
        return (i < len(self.data)) & (self.data[np.minimum(i, len(self.data) - 1)] == at) if len(self.data) else np.zeros(len(at), bool)

    def and_not(self, other: Bitmap) -> np.ndarray:
        m = self.members()
        return m[~other.has(m)]

    def both(self, other: Bitmap) -> np.ndarray:
        few, many = (self, other) if self.kind == "list" or other.kind == "bits" else (other, self)
        m = few.members()
        return m[many.has(m)]


class Dictionary:
    """Keys and their ordinals, dense from 0, in a folder that outlives the query.

    `extend` numbers the keys that are new, after all others; no key ever changes its ordinal. The table grows by one
    part for each extension. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str):
        self.spark, self.path, self.schema = spark, path, f"key {key_type}, ordinal bigint"

    def _parts(self) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(x.getPath().toString() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []

    def table(self) -> DataFrame | None:
        """key, ordinal; None if nothing is numbered yet. The parts are named one by one, so that plans over earlier and later states differ."""
        parts = self._parts()
        return self.spark.read.schema(self.schema).parquet(*parts) if parts else None

    def extend(self, rows: DataFrame, key: str) -> DataFrame:
        """The rows, one per key, with their ordinals as `_ord`; keys without one get one.

        Rows of a first extension keep their order and need no shuffle: a task's keys follow those of the tasks before
        it, of which only the numbers come to the driver. Later extensions join the table by key.
        """
        old = self.table()
        if old is None:
            fresh, size = rows, 0
        else:
            fresh, size = rows.join(old, rows[key] == old["key"], "left_anti"), old.agg(F.coalesce(F.max("ordinal") + 1, F.lit(0)).alias("n")).first()["n"]
        new = Written(fresh.withColumn("_m", F.monotonically_increasing_id()))
        part = F.shiftright("_m", 33)
        counts = sorted((r["p"], r["n"]) for r in new.df.groupBy(part.alias("p")).agg(F.max(F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n")).collect())
        firsts, at = [], size
        for p, n in counts:
            firsts.append((p, at))
            at += n
        # as many rows as tasks
        start = F.broadcast(self.spark.createDataFrame(firsts, "_p bigint, _first bigint"))
        told = new.df.withColumn("_p", part.cast("bigint")).join(start, "_p").withColumn("_ord", F.col("_first") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_first", "_m")
        told.select(F.col(key).alias("key"), F.col("_ord").alias("ordinal")).write.parquet(f"{self.path}/extension={len(self._parts()):06d}")
        if old is None:
            return told
        known = rows.join(old.select(F.col("key").alias(key), F.col("ordinal").alias("_ord")), key)
        return known.select(*told.columns).unionByName(told).repartition(partitions(self.spark), F.expr(f"_ord div {CHUNK}")).sortWithinPartitions("_ord")


def align(rows: DataFrame, key: str, copy: str, copies: list, fields: list[str]) -> DataFrame:
    """One row per key, with a struct of `fields` for each copy (null where the copy lacks the key).

    A key that one copy holds more than once counts once, with the greatest of its field tuples; this is combined
    before the shuffle, so a repeated key doesn't gather in one task.
    """
    s = F.struct(F.lit(True).alias("_in"), *[F.col(f) for f in fields])
    return rows.groupBy(key).agg(*[F.max(F.when(F.col(copy) == F.lit(c), s)).alias(f"_c{i}") for i, c in enumerate(copies)])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of one run of CHUNK ordinals, and the ordinals within it; without ordinals the rows' places are taken."""
    held: list[pa.RecordBatch] = []
    n, at = 0, 0

    def flush():
        t = pa.Table.from_batches(held)
        return t, t.column("_ord").to_numpy() % CHUNK if "_ord" in t.column_names else np.arange(t.num_rows)

    for b in batches:
        while b.num_rows:
            if "_ord" in b.schema.names:
                o = b.column("_ord").to_numpy() // CHUNK
                if held and o[0] != at:
                    yield flush()
                    held = []
                at = int(o[0])
                other = np.flatnonzero(o != at)
                size = int(other[0]) if len(other) else b.num_rows
            else:
                size = min(b.num_rows, CHUNK - n)
            held.append(b.slice(0, size))
            n += size
            b = b.slice(size)
            if n == CHUNK and "_ord" not in held[0].schema.names:
                yield flush()
                held, n = [], 0
    if held:
        yield flush()


def compare(aligned: DataFrame, key: str, pairs: list[tuple[int, int]], fields: list[str]) -> DataFrame:
    """Differences of each pair (old, new) of copies: pair, key, change ('only_old', 'only_new', 'differs'), field.

    field is '' but for 'differs', which has one row per field that differs; null equals only null. Where the rows have
    ordinals of a `Dictionary` (`_ord`), bitmaps and vectors are in their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ordinal in _chunks(batches):
            keys = t.column(key).combine_chunks()
            row = np.zeros(CHUNK, np.int64)  # of each ordinal
            row[ordinal] = np.arange(len(ordinal))
            used = {c for p in pairs for c in p}
            structs = {c: t.column(f"_c{c}").combine_chunks() for c in used}
            maps = {}
            for c in used:
                there = np.zeros(CHUNK, bool)
                there[ordinal] = structs[c].is_valid().to_numpy(zero_copy_only=False)
                maps[c] = Bitmap(there)
            out: dict[str, list] = {"pair": [], "key": [], "change": [], "field": []}

            def put(pair: int, at: np.ndarray, change: str, field: str) -> None:
                if len(at):
                    out["pair"].append(pa.repeat(pa.scalar(pair, pa.int32()), len(at)))
                    out["key"].append(keys.take(pa.array(row[at])))
                    out["change"].append(pa.repeat(pa.scalar(change), len(at)))
                    out["field"].append(pa.repeat(pa.scalar(field), len(at)))

            for i, (a, b) in enumerate(pairs):
                put(i, maps[a].and_not(maps[b]), "only_old", "")
                put(i, maps[b].and_not(maps[a]), "only_new", "")
                common = maps[a].both(maps[b])
                if not len(common):
                    continue
                at = pa.array(row[common])
                left, right = structs[a].take(at), structs[b].take(at)
                for f in fields:
                    x, y = pc.struct_field(left, f), pc.struct_field(right, f)
                    differs = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(x.is_null(), y.is_null()))
                    put(i, common[differs.to_numpy(zero_copy_only=False)], "differs", f)
            if out["pair"]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(out[c]) for c in out], schema=pa.schema([("pair", pa.int32()), ("key", keys.type), ("change", pa.string()), ("field", pa.string())]))

    kind = aligned.schema[key].dataType.simpleString()
    return aligned.mapInArrow(run, f"pair int, key {kind}, change string, field string")
