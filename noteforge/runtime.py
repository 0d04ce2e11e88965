"""Session settings and the shared scratch space."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one you are given."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("noteforge")
    settings = {
        **SESSION_CONF,
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        **conf,
    }
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_scratch")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path inside the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


PART_BYTES = 16 * 1024 * 1024  # of input, for a task that explodes it into rows
UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}


def dealt_by(df: DataFrame, key: str) -> DataFrame:
    """Hash ``df`` by ``key`` into parts of ``PART_BYTES`` or less of its files, however many files there are.

    Rows that are exploded after it take many times their bytes; parts that grow with the input would not hold them.
    """
    held = str(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")).lower().rstrip("b")
    split = int(held[:-1]) * UNITS[held[-1]] if held[-1:] in UNITS else int(held)
    parts = df.rdd.getNumPartitions() * max(1, -(-split // PART_BYTES))
    return df.repartition(parts, key) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(key)


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Like :func:`stage`, as a columnar table: for wide frames read many times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """The tables of one job in the shared folder, each removed as soon as nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.count = spark, scratch_path(spark, name), 0
        self.paths: dict[str, str] = {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as table ``name``, in place of an older one, which ``df`` may read."""
        old, self.count = self.paths.get(name), self.count + 1
        path = self.paths[name] = os.path.join(self.root, f"{name}-{self.count}")
        df.write.parquet(path)
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                self._delete(path)

    def keep_only(self, *names: str) -> None:
        self.remove(*[n for n in self.paths if n not in names])

    def _delete(self, path: str) -> None:
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
