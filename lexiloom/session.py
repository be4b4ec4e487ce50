"""Session and shared-folder helpers.

Intermediate results that cut a plan's lineage are written as Parquet below the
folder the cluster names in ``spark.checkpoint.dir``, so they outlive the loss of
any executor.  Only a local session without that setting gets a folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def get_session(app: str = "lexiloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is tested with."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set only for local sessions that name none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lexiloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    spark.sparkContext.setCheckpointDir(folder)
    return folder


_scopes: list[list[Scratch]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Drops, when left, the tables of all queries planned inside; their results must have been taken by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for scratch in _scopes.pop():
            scratch.close()


class Scratch:
    """Tables written for one query; superseded ones are dropped at once, the rest by ``close``, its scope or at exit."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.schemas: dict[str, StructType] = {}
        atexit.register(self.close)
        if _scopes:
            _scopes[-1].append(self)

    def write(self, df: DataFrame, name: str, by: str | None = None, row_group: int | None = None) -> DataFrame:
        """Write ``df`` as ``name``, in folders ``by`` a column if given, and return it read back, without its lineage.

        ``row_group`` bounds the bytes of a row group, for rows that are large.
        """
        out = df.write.mode("overwrite").option("compression", "zstd")
        if row_group:
            out = out.option("parquet.block.size", row_group)
        (out.partitionBy(by) if by else out).parquet(f"{self.root}/{name}")
        self.schemas[name] = df.schema
        return self.read([name])

    def write_counted(self, df: DataFrame, name: str, condition: Column | str) -> tuple[DataFrame, int]:
        """As ``write``, with the number of rows that meet the condition, counted on the way."""
        seen = Observation()
        met = F.expr(condition) if isinstance(condition, str) else condition
        out = self.write(df.observe(seen, F.count(F.when(met, 1)).alias("n")), name)
        return out, seen.get["n"]

    def read(self, names: list[str]) -> DataFrame:
        """Tables of one schema, read together; their footers are not inspected for it."""
        return self.spark.read.schema(self.schemas[names[0]]).parquet(*[f"{self.root}/{n}" for n in names])

    def drop(self, name: str = "") -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self.drop()
        except Exception:  # the session has ended already
            pass


def rows_within(df: DataFrame, bound: int) -> bool:
    """Whether ``df`` has at most ``bound`` rows; reads no further than that."""
    return df.limit(bound + 1).count() <= bound


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, ahead of work whose cost lies in the rows' number, not their bytes.

    Adaptive execution merges small partitions by bytes, which would leave a costly Python
    stage to one task; an explicit number of partitions is kept.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
