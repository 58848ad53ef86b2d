"""Small helpers for jobs of several steps: tables in the shared folder, ranks without a single task, components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from codeloom.sources.shared import shared_folder


def settled(table: DataFrame, codec: str | None = None) -> DataFrame:
    """table, written as Parquet to the shared folder and read again, which cuts its lineage; codec packs it, if given.

    The files stay for the folder's owner to remove, or for `forget`: a lost executor costs no more than a task.
    """
    path = f"{shared_folder(table.sparkSession)}/codeloom-{uuid.uuid4().hex}"
    table.write.parquet(path, compression=codec)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def tidied(table: DataFrame, codec: str | None = None) -> DataFrame:
    """table, settled, and the shuffle files of what made it given back.

    Spark removes a shuffle's files once the driver's garbage collector has found its plan unused, which a job of many
    steps on a quiet driver would not see before its end.
    """
    out = settled(table, codec)
    gc.collect()
    table.sparkSession._jvm.System.gc()
    return out


def forget(*tables: DataFrame) -> None:
    """Remove the files of settled tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for name in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ranked(table: DataFrame, order: Column, name: str) -> DataFrame:
    """table with its rows numbered from 0 by order: a range sort, then a count of the ranges before.

    The ranges are as many as the shuffle partitions, whatever the size of the table.
    """
    ranges = settled(table.repartitionByRange(order).withColumn("range_no", F.spark_partition_id()))
    counts = ranges.groupBy("range_no").agg(F.count("*").alias("range_rows"))
    before = F.sum("range_rows").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("range_no", F.coalesce(before, F.lit(0)).alias("range_start"))
    within = F.row_number().over(Window.partitionBy("range_no").orderBy(order)) - 1
    numbered = ranges.join(counts, "range_no").withColumn(name, within + F.col("range_start"))
    return numbered.drop("range_no", "range_start")


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in links (a, b), both long and not null.

    Large-star and small-star steps in turn: each is one grouping by node, and their number grows with the logarithm of
    the longest chain. A step is a join on the node, so a hub is split like any skewed join.
    """
    edges = settled(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = small.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        seen = Observation()
        step = settled(step.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("all")))
        forget(edges)
        edges = step
        if seen.get == before or not seen.get["n"]:
            break
        before = seen.get
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (node, component), settled, with more links (a, b) between nodes, whether they are in it already or not."""
    if links.isEmpty():
        return members
    named = [members.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of")) for x in ("a", "b")]
    both = links.join(named[0], "a", "left").join(named[1], "b", "left")
    merged = components(both.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b")))
    fresh = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct()
    fresh = fresh.join(members, "node", "left_anti").withColumn("component", F.col("node"))
    merged = merged.select(F.col("node").alias("component"), F.col("component").alias("least"))
    out = members.unionByName(fresh).join(merged, "component", "left")
    return settled(out.select("node", F.coalesce("least", "component").alias("component")))
