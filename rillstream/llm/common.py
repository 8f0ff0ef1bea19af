"""Shared plumbing of the training-data operators: scratch tables in the shared folder,
a connected-components solver, and UTF-8 helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = "spark.checkpoint.dir"

#: Share of the driver's heap in use from which garbage is collected after a table: hash tables that a plan sent out are large
#: objects, which Java leaves until the heap has grown to its limit.
HEAP_SHARE = 0.35


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset (tests in local mode) a temporary folder is made and set.
    """
    here = spark.conf.get(_ROOT, None) or spark.sparkContext.getConf().get(_ROOT)
    if not here:
        here = "file://" + tempfile.mkdtemp(prefix="rill-shared-")
        spark.conf.set(_ROOT, here)
    return here.rstrip("/")


def quoted(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(df: DataFrame) -> DataFrame:
    """The columns as ``c0, c1, ...``, so that columns put beside them clash with none."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Rows of an Arrow batch that goes to a Python worker, where the session has Spark's own 10000: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """Return a worker's or the driver's free memory to the system: Python workers live on between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(task):
    """A batch function that gives its memory back when its task ends."""

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    A table that a later one replaces can be dropped at once; the rest goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rill-{what}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        heap = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        if heap.totalMemory() - heap.freeMemory() > HEAP_SHARE * heap.maxMemory():
            self.release()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def small(self, df: DataFrame, name: str, rows: int) -> DataFrame:
        """A table of about so many narrow rows, in as few files as hold a million each."""
        return self.table(df.coalesce(max(1, -(-rows // 1_000_000))), name)

    def drop(self, name: str) -> None:
        _delete(self.spark, self.path(name))

    def release(self) -> None:
        """Let Spark delete the shuffle files and broadcasts of plans that are no longer used; it does so when the driver collects garbage."""
        give_back()
        self.spark.sparkContext._jvm.System.gc()

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None and self.spark.sparkContext._gateway is not None:
            try:
                _delete(self.spark, self.root)
            except Exception:  # the JVM may have gone before the interpreter
                pass


def components(scratch: Scratch, links: DataFrame, name: str = "cc", rounds: int = 60) -> DataFrame:
    """Smallest node reachable from each node of an undirected link table.

    ``links`` has the columns ``a`` and ``b`` of one orderable type; null ends and loops are ignored. Returns
    ``node, root`` for the nodes that have a link. Alternates large-star and small-star steps: each shuffles at
    most the links that are left, pre-aggregates its minimum per node, and needs about log(n) rounds; no
    step collects links or nodes to the driver.
    """
    rows = links.count()
    edges = scratch.small(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0", rows)
    seen = None
    for k in range(1, rounds + 1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node's smaller neighbours, and itself, join its least neighbour
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
            .select("e.a", F.col("e.m").alias("b"))
            .where("a <> b")
            .distinct()
        )
        edges_next = scratch.small(small, f"{name}-{k}", rows)
        state = edges_next.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(f"{name}-{k - 1}")
        edges = edges_next
        if seen == tuple(state) or not state.n:
            break
        seen, rows = tuple(state), state.n
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
