"""Session set-up and lineage cutting."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that operators rely on; a cluster may override all but the time zone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks."""
    b = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    return b.config("spark.sql.shuffle.partitions", str(partitions or cpus)).getOrCreate()


_own: dict[str, str] = {}
#: Tables written and not dropped yet, by application.
_written: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without (tests); it gets a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Written:
    """A table written to the shared folder, which cuts the lineage; `drop` removes it once a later table replaces it."""

    def __init__(self, df: DataFrame, *partition_by: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/tessera-{uuid.uuid4().hex}"
        _written.setdefault(self.spark.sparkContext.applicationId, set()).add(self.path)
        w = df.write
        (w.partitionBy(*partition_by) if partition_by else w).parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)
        _written.get(self.spark.sparkContext.applicationId, set()).discard(self.path)


def clear(spark: SparkSession) -> int:
    """Removes all tables that this application's operators have written and that results may still be read from; gives their number."""
    paths = _written.pop(spark.sparkContext.applicationId, set())
    for p in paths:
        _delete(spark, p)
    return len(paths)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
