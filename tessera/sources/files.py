"""Readers and writers of file formats, and of binary signal formats through the binary-file source."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, kind: str | None = None, schema: StructType | str | None = None, **options) -> DataFrame:
    """A table by format, told by the suffix unless given: parquet, orc, csv, tsv, json, text. Schemas are declared,
    not inferred, but for parquet and orc, which carry theirs."""
    kind = kind or path.rstrip("/").rsplit(".", 1)[-1].lower()
    r = spark.read.options(**options)
    if schema is not None:
        r = r.schema(schema)
    if kind in ("csv", "tsv"):
        return r.option("header", options.get("header", "true")).option("sep", "\t" if kind == "tsv" else options.get("sep", ",")).csv(path)
    if kind in ("json", "jsonl"):
        return r.json(path)
    if kind in ("txt", "text"):
        return r.text(path)
    return r.format(kind).load(path)


def read_folder(spark: SparkSession, root: str, pattern: str, schema: StructType | str | None = None, kind: str = "parquet") -> DataFrame:
    """All files under a folder whose name fits the pattern, with the columns user= and day= of their folders and
    the file each row came from. Filters on the folders' columns prune files."""
    r = spark.read.format(kind).option("pathGlobFilter", pattern)
    if schema is not None:
        r = r.schema(schema)
    return r.load(root).withColumn("source_file", F.input_file_name())


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """A snapshot: one parquet folder per table and one row of metadata for each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}.parquet")


def write_tiers(df: DataFrame, tier: str, tiers: list[str], root: str) -> None:
    """One snapshot per cumulative tier: each holds its own rows and those of the tiers before it."""
    for i, t in enumerate(tiers):
        df.where(F.col(tier).isin(tiers[: i + 1])).write.mode("overwrite").parquet(f"{root}/{t}.parquet")


def content_hash(df: DataFrame, cols: list[str], buckets: int = 256) -> DataFrame:
    """One hash of a table's rows whatever their order: rows are hashed, summed by bucket, and the sums hashed."""
    row = F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)
    h = df.select(row.alias("h")).withColumn("b", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    per = h.groupBy("b").agg(F.sum(F.conv(F.substring("h", 1, 15), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("b", "s", "n"))), lambda x: F.concat_ws(":", x["b"], x["s"], x["n"])), ","), 256).alias("hash"))


def array_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, min, max, mean and population deviation of each key's values."""
    return df.groupBy(key).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def array_slice(df: DataFrame, key: str, pos: str, text: str) -> DataFrame:
    """Rows of each key whose position is in a 'start:stop:step' slice; negative bounds count from the end."""
    parts = [int(p) if p.strip() else None for p in (text.split(":") + ["", ""])[:3]] if ":" in text else [int(text), int(text) + 1 if int(text) != -1 else None, None]
    start, stop, step = parts[0] or 0, parts[1], parts[2] or 1
    n = df.groupBy(key).agg((F.max(pos) + 1).alias("_n"))
    d = df.join(n, key)
    at = lambda v: F.lit(v) if v >= 0 else F.greatest(F.col("_n") + v, F.lit(0))
    d = d.where((F.col(pos) >= at(start)) & ((F.col(pos) < at(stop)) if stop is not None else F.lit(True)))
    return d.where((F.col(pos) - at(start)) % step == 0).drop("_n")


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """Arc lines 'a source target weight' of a DIMACS graph: source, target (from 0), weight. Other lines are left out."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value").rlike(r"^a\s+\d+\s+\d+\s+\S+$")).select(p.alias("p"))
    return lines.select((F.get("p", F.lit(1)).cast("bigint") - 1).alias("source"), (F.get("p", F.lit(2)).cast("bigint") - 1).alias("target"), F.get("p", F.lit(3)).cast("double").alias("weight"))


def fixed_width(spark: SparkSession, path: str, widths: list[int]) -> DataFrame:
    """Text in columns of fixed width as c0, c1, ..., trimmed; lines whose second column is no number are left out."""
    at, cols = 1, []
    for i, w in enumerate(widths):
        cols.append(F.trim(F.substring("value", at, w)).alias(f"c{i}"))
        at += w
    return spark.read.text(path).select(*cols).where(F.expr("try_cast(c1 AS DOUBLE) IS NOT NULL"))


def _binary(spark: SparkSession, path: str, decode, schema: str) -> DataFrame:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, c in zip(pdf["path"], pdf["content"]):
                out = decode(bytes(c))
                out.insert(0, "path", p)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, " + schema)


def decode_212(raw: bytes, channels: int = 2) -> pd.DataFrame:
    """Samples packed by twos of 12 bits into three bytes: channel, pos, value. An odd tail is left out."""
    b = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
    first = b[:, 0] | ((b[:, 1] & 0x0F) << 8)
    second = b[:, 2] | ((b[:, 1] & 0xF0) << 4)
    v = np.stack([first, second], axis=1).ravel()
    v = np.where(v > 2047, v - 4096, v)
    n = len(v) // channels * channels
    return pd.DataFrame({"channel": np.tile(np.arange(channels, dtype=np.int32), n // channels), "pos": np.repeat(np.arange(n // channels, dtype=np.int64), channels), "value": v[:n].astype(float)})


def read_212(spark: SparkSession, path: str, channels: int = 2) -> DataFrame:
    return _binary(spark, path, lambda raw: decode_212(raw, channels), "channel int, pos bigint, value double")


def decode_edf(raw: bytes) -> pd.DataFrame:
    """Signals of an EDF file: channel label, pos, seconds, value in physical units."""
    text = lambda a, n: raw[a : a + n].decode("latin-1").strip()
    head, records, seconds, ns = int(text(184, 8)), int(text(236, 8)), float(text(244, 8)), int(text(252, 4))
    at, fields = 256, {}
    for name, width in (("label", 16), ("transducer", 80), ("unit", 8), ("pmin", 8), ("pmax", 8), ("dmin", 8), ("dmax", 8), ("filter", 80), ("n", 8), ("rest", 32)):
        fields[name] = [text(at + i * width, width) for i in range(ns)]
        at += ns * width
    n = [int(x) for x in fields["n"]]
    data = np.frombuffer(raw[head:], "<i2")
    data = data[: len(data) // sum(n) * sum(n)].reshape(-1, sum(n))[: records if records >= 0 else None]
    out, start = [], 0
    for i in range(ns):
        d = data[:, start : start + n[i]].ravel().astype(float)
        start += n[i]
        lo, hi, dl, dh = (float(fields[k][i]) for k in ("pmin", "pmax", "dmin", "dmax"))
        out.append(pd.DataFrame({"channel": fields["label"][i], "pos": np.arange(len(d), dtype=np.int64), "t": np.arange(len(d)) * seconds / n[i], "value": lo + (d - dl) * (hi - lo) / (dh - dl)}))
    return pd.concat(out, ignore_index=True)


def read_edf(spark: SparkSession, path: str, start: float = 0.0, duration: float | None = None) -> DataFrame:
    d = _binary(spark, path, decode_edf, "channel string, pos bigint, t double, value double")
    return d.where((F.col("t") >= start) & (F.col("t") < (start + duration if duration is not None else float("inf"))))


def read_clocked_tsv(spark: SparkSession, path: str, skip: int, clock: str, zone: str) -> DataFrame:
    """A UTF-16 tab-separated export with `skip` lines before its header: columns as text, and at (UTC) from the
    column `clock`, whose '00:' in 12-hour times means 12. Times that don't read are left out."""
    raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "UTF-16").alias("value"))
    lines = raw.select(F.posexplode(F.split("value", r"\r?\n")).alias("_i", "_l")).where(F.length(F.trim("_l")) > 0)
    header = lines.where(F.col("_i") == skip).first()["_l"].split("\t")
    p = F.split("_l", "\t")
    d = lines.where(F.col("_i") > skip).select("_i", *[F.get(p, F.lit(i)).alias(h.strip()) for i, h in enumerate(header)])
    fixed = F.regexp_replace(F.col(clock), r"\b00:(\d\d:\d\d [AP]M)", "12:$1")
    at = F.try_to_timestamp(fixed, F.lit("M/d/yyyy h:mm:ss a"))
    return d.withColumn("at", F.to_utc_timestamp(at, zone)).where("at IS NOT NULL").drop("_i")
