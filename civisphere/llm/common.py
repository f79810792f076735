"""What the operators of this subpackage share: scratch tables, Arrow batch
bounds and a distributed connected-components routine."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python. Texts can be long, so a
#: worker should never hold more than a few hundred of them at once.
ARROW_ROWS = 256


def bounded_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's Arrow batch size to ``rows``; a smaller one stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where neither the session nor its context names one and Spark runs in
    one local process (tests), a temporary folder stands in for it; on a
    cluster a machine's own folder would lose tables, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder; they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.serial = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the written table."""
        self.serial += 1
        path = f"{self.path}/{name}-{self.serial}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that ``save`` returned and nothing reads any more."""
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                jvm = self.spark._jvm
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Let Spark's cleaner delete shuffle files of finished jobs now."""
        gc.collect()
        self.spark._jvm.System.gc()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of ``edges(src, dst)`` (long ids) as ``(node, component)``.

    ``component`` is the smallest id of the component. Alternating large-star
    and small-star rounds (Kiveris et al. 2014): every round is two grouped
    minima and two equi-joins on the edge list, which never grows, and the
    number of rounds is logarithmic in practice. Each round is written to the
    shared folder. Nodes without an edge are not listed. Self-loops, repeated
    edges and nulls are ignored; no edges give no rows.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = scratch.save(e, "edges")
    seen = _digest(e)
    while seen[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        nxt = scratch.save(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        now = _digest(nxt)
        scratch.drop(e)
        e = nxt
        if now == seen or not now[0]:
            break
        seen = now
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
