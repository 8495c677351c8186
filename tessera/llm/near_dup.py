"""Near-duplicate groups by b-bit MinHash.

Each record's word set gets HASHES minima. Bands of full minima give candidates; only the low BITS bits of each minimum
are kept, packed into longs, and a pair's similarity is estimated from the equal ones, corrected for those that are
equal by chance. A band row carries one long of single bits, so that most chance meetings end where they are met. Pairs
well below the threshold go; the rest are checked exactly, so no wrong pair is linked. A pair at a similarity of 0.75
is no candidate with a chance of 8 in 100,000, at 0.8 of 4 in 10 million; an estimate drops one with a chance of 3 in
10 million.

Buckets of any size take the same way. First each member is held against its bucket's least one, and the links found
so are checked. Then only those members of a bucket are held against each other that are not in one component yet, in
cells of bounded size spread over all tasks: what a hot bucket costs is the pairs of its members that are not connected
through its least one, each compared by one exclusive or.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.components import components
from tessera.session import Written, partitions

BANDS, ROWS, BITS = 48, 6, 2
HASHES = BANDS * ROWS
#: Single bits that travel with the band keys: of every HASHES / SHORT-th minimum.
SHORT = 64
#: Longs of a signature that travel to the cells, where members of a bucket are compared with each other.
WIDE = 4
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.0
#: Members of a bucket that a cell compares on either side. More members make more cells, not larger ones.
CELL = 2048

def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_601)
    return r.integers(1, 1 << 62, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 1 << 62, n, dtype=np.uint64)


def minima(values: np.ndarray, ends: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least hash of each run of `values` (runs end at `ends`, none is empty), by each function: runs x functions."""
    starts = ends[:-1]
    out = np.empty((len(starts), len(mul)), np.uint32)
    for j in range(len(mul)):
        h = values * mul[j] + add[j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x9E3779B97F4A7C15)
        out[:, j] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), starts)
    return out


def pack_bits(m: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, 64 // BITS of them in a long."""
    per = 64 // BITS
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(m), -1, per)
    shift = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, None, :]
    return np.bitwise_or.reduce(low << shift, axis=2).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, from its full minima."""
    k = np.zeros((len(m), BANDS), np.uint64)
    for r in range(ROWS):
        k = (k ^ m[:, r::ROWS].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        k ^= k >> np.uint64(32)
    return k.view(np.int64)


def least_equal(threshold: float, fields: int, bits: int = BITS) -> float:
    """The least share of equal fields that a pair at the threshold has, but for a chance in SLACK deviations."""
    chance = 1.0 / (1 << bits)
    expect = chance + (1 - chance) * threshold
    return expect - SLACK * (expect * (1 - expect) / fields) ** 0.5


def signatures(sets: DataFrame, key: str, hashes: str) -> DataFrame:
    """key, sig (packed low bits), short (one bit of SHORT minima) and bands (keys) of each non-empty set of 64-bit word hashes."""
    mul, add = _seeds(HASHES)
    shift = np.arange(SHORT, dtype=np.uint64)
    pick = (np.arange(SHORT) * HASHES // SHORT)[None, :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                lists = b.column(1)
                flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                ends = lists.offsets.to_numpy().astype(np.int64)
                m = minima(flat, ends - ends[0], mul, add)
                wide = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                short = np.bitwise_or.reduce((m[:, pick[0]] & np.uint32(1)).astype(np.uint64) << shift, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), wide(pack_bits(m)), pa.array(short), wide(band_keys(m))], names=["key", "sig", "short", "bands"])

    src = sets.where(F.size(hashes) > 0).select(F.col(key).alias("key"), F.col(hashes).alias("h"))
    return src.mapInArrow(run, f"key {sets.schema[key].dataType.simpleString()}, sig array<bigint>, short bigint, bands array<bigint>")


def _near(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Whether single-bit signatures are equal enough."""
    return np.bitwise_count((x ^ y).view(np.uint64)) <= SHORT - int(np.ceil(least_equal(threshold, SHORT, 1) * SHORT))


def _near_wide(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], threshold: float) -> np.ndarray:
    """The same by WIDE longs of the packed signatures."""
    fields = WIDE * 64 // BITS
    equal = np.zeros(len(x[0]), np.int64)
    for a, b in zip(x, y):
        d = (a ^ b).view(np.uint64)
        equal += 64 // BITS - np.bitwise_count((d | d >> np.uint64(1)) & np.uint64(0x5555555555555555))
    return equal >= int(np.ceil(least_equal(threshold, fields) * fields))


def stars(sigs: DataFrame, threshold: float) -> DataFrame:
    """Rows (bucket, a, b, near): each member b of a bucket but its least one, a; near if their bits may reach the threshold.

    Band rows are sorted by bucket and streamed, so a bucket is never held, however large.
    """
    bk = sigs.select("key", "short", F.posexplode("bands").alias("band", "bk")).select(F.xxhash64("band", "bk").alias("bucket"), "key", "short")
    bk = bk.repartition(partitions(sigs.sparkSession), "bucket").sortWithinPartitions("bucket", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = tuple(np.empty(0, np.int64) for _ in range(3))
        for b in batches:
            bucket, key, short = (np.concatenate((x, b.column(j).to_numpy(zero_copy_only=False))) for j, x in enumerate(lead))
            new = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(bucket)), 0))
            lead = tuple(x[first[-1] : first[-1] + 1] for x in (bucket, key, short))
            at = np.flatnonzero(~new)
            if len(at):
                a = first[at]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(key[a]), pa.array(key[at]), pa.array(_near(short[a], short[at], threshold))], names=["bucket", "a", "b", "near"])

    return bk.mapInArrow(run, "bucket bigint, a bigint, b bigint, near boolean")


def _across(met: DataFrame, told: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of members of one bucket that may reach the threshold and are in different components.

    `told` has key, sig and comp of each record. Members of a bucket are spread over parts of about CELL, and each
    two parts meet in a cell of their own.
    """
    members = met.select("bucket", F.col("b").alias("key")).unionByName(met.select("bucket", F.col("a").alias("key")).distinct())
    members = members.join(told, "key")
    open_ = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("n > 2 and c1 < c2")
    parts = F.ceil(F.col("n") / F.lit(CELL)).cast("bigint")
    rows = members.join(open_.select("bucket", parts.alias("parts")), "bucket").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
    cell = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    wide = [F.col("sig")[i].alias(f"w{i}") for i in range(WIDE)]
    rows = rows.select(cell.alias("cell"), "key", "comp", "part", (F.col("part") == F.col("other")).alias("own"), *wide)
    rows = rows.repartition(partitions(met.sparkSession), "cell").sortWithinPartitions("cell", "key")

    def compare(cell, key, comp, part, own, *sig) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        end = np.repeat(np.append(starts[1:], len(cell)), np.diff(np.append(starts, len(cell))))
        at, k = np.arange(len(cell)), 1
        while len(at := at[at + k < end[at]]):
            # a part by itself is compared in its own cell only
            x = at[(comp[at] != comp[at + k]) & ((part[at] != part[at + k]) | own[at])]
            x = x[_near_wide(tuple(w[x] for w in sig), tuple(w[x + k] for w in sig), threshold)]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[x], key[x + k])), pa.array(np.maximum(key[x], key[x + k]))], names=["a", "b"])
            k += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if held is not None:
                cols = [np.concatenate((h, c)) for h, c in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))  # the last cell may go on in the next batch
            if cut:
                yield from compare(*(c[:cut] for c in cols))
            held = [c[cut:] for c in cols]
        if held is not None:
            yield from compare(*held)

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _equal_share(a: str, b: str):
    """The share of equal low-bit fields of two packed signatures."""
    odd = int("01" * 32, 2)
    n = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))).bitwiseAND(F.lit(odd)))), F.lit(0), lambda s, v: s + v)
    return (F.lit(HASHES) - n) / F.lit(float(HASHES))


def verify(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets' similarity is at least the threshold: estimated first, then exactly."""
    side = lambda df, key, value: df.select(F.col("key").alias(key), F.col(value).alias(f"v{key}"))
    near = pairs.join(side(sigs, "a", "sig"), "a").join(side(sigs, "b", "sig"), "b").where(_equal_share("va", "vb") >= least_equal(threshold, HASHES)).select("a", "b")
    full = near.join(side(sets, "a", "words"), "a").join(side(sets, "b", "words"), "b")
    common = F.size(F.array_intersect("va", "vb"))
    return full.where(common >= F.lit(threshold) * (F.size("va") + F.size("vb") - common)).select("a", "b")


def similar_groups(sets: DataFrame, key: str, words: str, threshold: float) -> DataFrame:
    """(key, group, n_copies) of each record with a non-empty set: group is the least key of its group.

    `words` is an array of distinct words. Records are linked if their sets' Jaccard similarity is at least the
    threshold; a group is all records connected through links, and a record without links is a group of its own.
    Equal sets are one set from the start (n_copies of them), so that copies never form pairs. Null keys and null or
    empty sets are left out; repeated keys count once.
    """
    src = sets.select(F.col(key).alias("key"), F.sort_array(F.array_distinct(words)).alias("words")).where(F.col("key").isNotNull() & (F.size("words") > 0))
    src = src.groupBy("key").agg(F.max("words").alias("words")).withColumn("same", F.unhex(F.md5(F.array_join("words", "\x1f"))))
    src = Written(src)
    reps = src.df.groupBy("same").agg(F.min("key").alias("name"), F.count(F.lit(1)).alias("n_copies"), F.any_value("words").alias("words"))
    # numbers stand for the sets from here on; they are written once, so they stay the same
    reps = Written(reps.withColumn("key", F.monotonically_increasing_id()))
    sig = Written(signatures(reps.df.select("key", F.transform("words", lambda w: F.xxhash64(w)).alias("h")), "key", "h"))
    met = Written(stars(sig.df, threshold))
    first = met.df.where("near").select("a", "b").distinct()
    links = Written(verify(first, sig.df, reps.df, threshold))
    first_comp = components(links.df, "a", "b").select(F.col("node").alias("key"), "component")
    comp = Written(sig.df.select("key", "sig").join(first_comp, "key", "left").select("key", "sig", F.coalesce("component", "key").alias("comp")))
    more = _across(met.df, comp.df, threshold).join(first, ["a", "b"], "left_anti")
    extra = Written(verify(more, sig.df, reps.df, threshold))
    told = comp.df.select("key", F.col("comp").alias("c"))
    if extra.df.limit(1).count():
        # links between components join these, so the second search is over components only
        of = lambda side: told.select(F.col("key").alias(side), F.col("c").alias(f"c{side}"))
        joined = components(extra.df.join(of("a"), "a").join(of("b"), "b"), "ca", "cb").select(F.col("node").alias("c"), "component")
        told = told.join(joined, "c", "left").select("key", F.coalesce("component", "c").alias("c"))
    for t in (met, links, extra, sig):
        t.drop()
    told = reps.df.select("key", "same", "name", "n_copies").join(told, "key")
    least = told.groupBy("c").agg(F.min("name").alias("group"))
    return src.df.select("key", "same").join(told.join(least, "c").select("same", "group", "n_copies"), "same").select(F.col("key").alias(key), "group", "n_copies")
