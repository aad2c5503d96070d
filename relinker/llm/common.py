"""What the operators share: reading, cutting lineage, connected components."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they start where they find it."""
    root = Path(__file__).resolve().parents[2]
    found = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if root in {Path(p).resolve() for p in found if p} or getattr(spark.sparkContext, "relinker_sent", False):
        return
    package = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}/relinker", "zip", root, "relinker")
    spark.sparkContext.addPyFile(package)
    spark.sparkContext.relinker_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a folder that Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on one machine (a local master, as in tests) a local
    folder takes its place; on a cluster it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Paths, with the names of tables, that the innermost ``scratch`` block has to remove.
_made: ContextVar[list[tuple[str, str | None]] | None] = ContextVar("made", default=None)


def saved(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts the lineage: a lost executor costs its unfinished tasks, never what was
    saved. What is saved also stays the same, however often it is read. Within a
    ``scratch`` block it is removed when the block ends.
    """
    ship(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/step-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append((path, None))
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, column: str) -> DataFrame:
    """``saved`` as a table bucketed by a column, so that joins on it shuffle the other side only; in ``scratch`` blocks."""
    spark, name = df.sparkSession, f"step_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    _made.get().append((path, name))
    rows = df.repartition(parts(spark), column).write.option("compression", "zstd").option("path", path)
    rows.bucketBy(parts(spark), column).saveAsTable(name)
    return spark.table(name)


def remove(spark: SparkSession, path: str, name: str | None = None) -> None:
    """Delete a folder through the file system that it is in, and the table's entry that names it."""
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose ``saved`` tables go when it ends; what it yields saves a frame that stays.

    What stays belongs to the block around, if there is one.
    """
    mine: list[tuple[str, str | None]] = []
    outer = _made.get()
    token = _made.set(mine)

    def keep(df: DataFrame) -> DataFrame:
        inner = _made.set(outer)
        try:
            return saved(df)
        finally:
            _made.reset(inner)

    try:
        yield keep
    finally:
        _made.reset(token)
        for path, name in mine:
            remove(spark, path, name)


#: Bytes of texts that a Python worker gets at once.
BATCH = 4 << 20


@contextmanager
def arrow_batches(spark: SparkSession, most: int = BATCH) -> Iterator[None]:
    """A block whose jobs send about ``most`` bytes of rows (or one row) to a Python worker at once, unless the session sets a number.

    Spark's default is 10,000 rows or 64 MB, which the executor and the worker both
    hold, the latter as strings too.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name)


def parts(spark: SparkSession) -> int:
    """Partitions for an explicit deal."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just ``doc_id`` and ``text`` (null: empty), so no other column's name can clash."""
    ship(df.sparkSession)
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def lots(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes come to ``most`` together, or of one that is larger."""
    first = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


#: Edges up to which components are found in one task (a few MB), without a shuffle for each step.
SMALL_GRAPH = 100_000


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) for every node of ``links(a, b)``.

    In rounds, each node takes the smallest label of its neighbours' labels; the node
    that its old label names takes it too (hooking), and labels are followed a step
    further, so the rounds grow with the logarithm of the longest path, in whatever
    order its ids are. Each round is written to the shared folder (all are removed at
    the end); only whether something changed comes to the driver. A graph of up to
    ``SMALL_GRAPH`` edges, counted both ways, stays in one partition.
    """
    spark = links.sparkSession
    with scratch(spark) as keep:
        both = saved(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
        small = both.limit(SMALL_GRAPH + 1).count() <= SMALL_GRAPH
        held = (lambda df: df.coalesce(1)) if small else (lambda df: df)
        both = held(both)
        label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        label = held(saved(label.select("node", F.least("node", "m").alias("label"))))
        while True:
            upper = label.select(F.col("node").alias("label"), F.col("label").alias("upper"))
            far = held(saved(label.join(upper, "label")))
            least = both.join(far, both.b == far.node).groupBy("a").agg(F.min("upper").alias("m"))
            own = F.struct("node", F.least("upper", "m").alias("label"), F.col("label").alias("was"))
            hook = F.struct(F.col("label").alias("node"), F.col("m").alias("label"), F.lit(None).cast(far.schema["label"].dataType).alias("was"))
            offers = far.join(least, far.node == least.a).select(F.explode(F.array(own, hook)).alias("o")).select("o.*")
            label = held(saved(offers.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))))
            if not label.filter("label <> was").limit(1).count():
                return keep(label.select("node", F.col("label").alias("component")))
