"""Reachability in logarithmic rounds, and paths by pointers that double. What rounds share is written once to the folder all machines share."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: computed once, without its lineage; n_rows says how many. The files stay until drop_written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    _written.append(path)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at, out.n_rows = path, seen.get["rows"]
    return out


def drop_written(spark: SparkSession, *tables: DataFrame) -> int:
    """Delete what checkpointed has written: of the given tables, or of this whole process; returns how many folders."""
    gone = [t.written_at for t in tables] if tables else list(_written)
    for p in gone:
        _written.remove(p)
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


#: Times the edges that jumps may be, before they are doubled no more.
DENSE = 4


def reachable(seeds: DataFrame, edges: DataFrame, keys: list[str], depth: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, carry: all nodes that a seed reaches along edges (src to dst), the seeds included. Columns in carry go along.

    Round k adds what lies 2^k to 2^(k+1) - 1 edges away: the nodes found so far, moved by the pairs that are 2^k edges apart; these are
    then joined with themselves for the next round. Where edges branch so much that such pairs grow beyond DENSE times the edges,
    they double no more, and each round moves the newest nodes by the last ones. Each round writes its new nodes alone. It ends when
    a round adds none. Where a depth is given and nodes lie beyond it, that is an error: it then goes edge by edge.
    """
    cols = [*keys, "node", *carry]
    spark = seeds.sparkSession
    hop = checkpointed(edges.select(*keys, "src", "dst").distinct())
    most = None if depth is not None else DENSE * max(1, hop.n_rows)
    levels = [checkpointed(seeds.select(cols).distinct())]
    done, doubling = 0, depth is None
    while True:
        seen = reduce(DataFrame.unionByName, levels)
        start = seen if doubling else levels[-1]
        step = start.join(hop.withColumnRenamed("src", "node"), [*keys, "node"]).drop("node").withColumnRenamed("dst", "node").select(cols).distinct()
        new = checkpointed(step.join(seen, cols, "left_anti"))
        if not new.n_rows:
            drop_written(spark, new, hop)
            return seen
        if done == depth:
            raise RuntimeError(f"nodes are reached beyond {depth} rounds")
        done += 1
        levels.append(new)
        if doubling:
            twice = hop.withColumnRenamed("dst", "_mid").join(hop.withColumnRenamed("src", "_mid"), [*keys, "_mid"]).select(*keys, "src", "dst").distinct()
            twice = checkpointed(twice)
            if twice.n_rows <= most:
                drop_written(spark, hop)
                hop = twice
            else:
                doubling = False
                drop_written(spark, twice)


def pointer_paths(ends: DataFrame, pointers: DataFrame, keys: list[str], end: str = "end") -> DataFrame:
    """keys, end, node, back: the nodes on the way back from each end along pointers (node to parent), by the number of steps; the end itself is 0.

    pointers: at most one parent a node, and no circles. In round k a path of 2^k nodes gets the 2^k nodes before them, and pointers
    are joined with themselves: as many rounds as the logarithm of the longest path.
    """
    spark = ends.sparkSession
    jump = checkpointed(pointers.select(*keys, "node", "parent"))
    levels = [checkpointed(ends.select(*keys, F.col(end), F.col(end).alias("node"), F.lit(0).alias("back")).distinct())]
    reach = 1
    while True:
        so_far = reduce(DataFrame.unionByName, levels)
        new = checkpointed(so_far.join(jump, [*keys, "node"]).select(*keys, end, F.col("parent").alias("node"), (F.col("back") + reach).alias("back")))
        if not new.n_rows:
            drop_written(spark, new, jump)
            return so_far
        levels.append(new)
        further = jump.withColumnRenamed("parent", "_mid").join(jump.select(*keys, F.col("node").alias("_mid"), "parent"), [*keys, "_mid"]).select(*keys, "node", "parent")
        further = checkpointed(further)
        drop_written(spark, jump)
        jump, reach = further, 2 * reach
