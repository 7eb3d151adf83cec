"""Tables in the shared folder (see :mod:`quillon.storage`), and connected components over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.storage import clear, drop, keep, shared_dir  # noqa: F401

#: Bytes of a batch that goes to a Python worker: whole texts can be long, and a worker holds a batch several times over.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_DEFAULTS = ("67108864b", "67108864", "64MB", "64m", "-1", "-1b")


def lean(spark: SparkSession) -> None:
    """Lets the session's batches for Python workers have BATCH_BYTES, unless it has a bound of its own."""
    if spark.conf.get(_BATCH) in _DEFAULTS:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def give_back(spark: SparkSession) -> None:
    """Lets each executor's JVM collect its garbage, after which it gives free heap back to the system.

    A heap that has once grown to its bound otherwise stays so, and Python workers beside it lack that room. With a local
    master, where there are no executors, nothing is done.
    """
    if spark.sparkContext.master.split("[")[0] == "local":
        return
    # A task a core, so each executor has one; the expression isn't deterministic, so it is left to the tasks.
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc')").write.format("noop").mode("overwrite").save()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def same_columns(df: DataFrame) -> list:
    """All columns of ``df``, whatever they are called."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def each(parts: list):
    """The values of broadcasts one after another; where there are several, a worker lets each go before it loads the next."""
    for part in parts:
        yield part.value
        if len(parts) > 1:
            part.__dict__.pop("_value", None)


def least_by_hash(rows: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """``rows`` with ``r``, the rank by hash of ``key`` within ``group``, of the n first of each group.

    A histogram of the hashes' top bits says up to where the n lie, so no group, however large, is sorted in one task;
    only the few rows up to there are ranked. ``rows`` is read twice.
    """
    top = F.shiftrightunsigned(F.xxhash64(key), 48).cast("int")
    counts = rows.groupBy(group, top.alias("__top")).agg(F.count("*").alias("__n"))
    running = F.sum("__n").over(Window.partitionBy(group).orderBy("__top").rowsBetween(Window.unboundedPreceding, -1))
    ends = keep(counts.withColumn("__before", F.coalesce(running, F.lit(0))).where(F.col("__before") < n).groupBy(group).agg(F.max("__top").alias("__end")), "ends")
    near = rows.join(ends, group).where(F.shiftrightunsigned(F.xxhash64(F.col(key)), 48).cast("int") <= F.col("__end")).drop("__end")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(key), key))
    return near.withColumn("r", rank).where(F.col("r") <= n)


#: Edges, each of 16 bytes, of which one task finds the components by itself.
FEW_EDGES = 1 << 20


def _united(batches):
    """(node, root) of the edges that one task holds."""
    held = list(batches)
    if not held:
        return
    u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        live = root[a] != root[b]
        a, b = a[live], b[live]
    moved = root != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """Connected components of the undirected ``edges`` (a, b), of integers: rows (node, root), root the least node, itself left out.

    Up to ``few`` edges are one task's work; more take rounds, with the same result. A round alternates the large-star and
    small-star steps, each an aggregation and a join, and keeps its edges in the shared folder, until one changes
    nothing, which takes about the logarithm of the longest chain. Edges with a null end and loops are ignored; repeated edges count once; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = keep(pairs, "edges"), None
    if now.count() <= few:
        return keep(now.select(F.col("u").cast("long"), F.col("v").cast("long")).coalesce(1).mapInArrow(_united, "node long, root long"), "roots")
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).distinct()
        now, old = keep(small, "edges"), now
        drop(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
