"""Bounded closures over edge tables, and prefix joins as equi joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); one of our own only where unset and Spark runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """A Parquet table in the shared folder; it outlives executors and cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written(), once all that was read from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that a join may broadcast, and rows of a key below which it never does.
HOT_KEYS, HOT_ROWS = 1000, 1000


def join_by_share(rows: DataFrame, facts: DataFrame, on: list[str], total: int | None = None) -> DataFrame:
    """rows joined to facts (one row a key; column n: how many of the `total` rows have it), hot keys apart; n goes.

    Keys of over a thousandth of all rows, so at most HOT_KEYS, are broadcast, and their rows stay where they are; the
    others' rows meet their facts by a shuffle. Both tables are read twice, so they should be written ones.
    """
    total = rows.count() if total is None else total
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = facts.filter(F.col("n") > least).drop("n")
    met = rows.join(F.broadcast(hot), on)
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.filter(F.col("n") <= least).drop("n"), on)
    return met.unionByName(rest)


def closure(edges: DataFrame, roots: DataFrame, rounds: int) -> tuple[DataFrame, bool]:
    """root, node, depth of all nodes reached within `rounds` edges (src, dst), roots among them; whether it was cut.

    Each round joins the newest nodes to their edges, takes out those seen before, and writes what is new.
    """
    newest = written(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct(), "closure")
    seen = newest
    for depth in range(1, rounds + 1):
        step = newest.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        newest = written(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if newest.isEmpty():
            return seen, False
        seen = seen.unionByName(newest)
    left = newest.join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).join(seen, ["root", "node"], "left_anti")
    return seen, not left.isEmpty()


def longest_prefix(rows: DataFrame, prefixes: DataFrame, folders) -> DataFrame:
    """rows (id, path) with the longest of prefixes (prefix) above their path, or null.

    folders: a function of the path column that gives all its prefixes, so that the join is by equality.
    """
    above = rows.select("id", "path", F.explode(folders(F.col("path"))).alias("prefix"))
    best = above.join(prefixes.select("prefix").distinct(), "prefix").groupBy("id").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return rows.join(best, "id", "left")
