"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words: blank and \x09 to \x0D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a local one only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return str(path).rstrip("/")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where their path does not lead to it; sent once per session."""
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_shipped", False):
        return
    package = Path(__file__).resolve().parents[1].name
    context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package}", "zip", root, package))
    context._shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns the table: lineage ends here and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Maximal runs without blanks and \\x09-\\x0D. Only texts with rare blanks take the slower translate."""
    rare = text.contains("\t") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    plain = F.when(rare, F.translate(text, SPACES[1:], " " * 5)).otherwise(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.array_remove(F.split(plain, " ", -1), "")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables of one operator in the shared folder; those that are no longer read are deleted, so that disk follows the current step."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """materialize(), remembered."""
        path = scratch(self.spark, name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame, all_but: list[DataFrame] | None = None) -> None:
        """Deletes tables, or all but some. Only for tables that nothing still to be computed reads."""
        gone = [id(t) for t in tables] if all_but is None else [k for k in self.paths if k not in {id(t) for t in all_but}]
        for k in gone:
            if k in self.paths:
                remove(self.spark, self.paths.pop(k)[0])


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours by the file system that it lies in."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def unique_ids(df: DataFrame, name: str) -> bool:
    """Whether every row has an id and no two have the same."""
    return not df.groupBy(F.col(name).cast("long").alias("id")).count().where("id is null or count > 1").limit(1).count()


def numbered(df: DataFrame, id_: str, *others: str) -> DataFrame:
    """(key, id_, others): rows with a number of their own, in a table, so that it stays the same wherever the table is read."""
    return materialize(df.select(F.col(id_).cast("long").alias(id_), *others).withColumn("key", F.monotonically_increasing_id()), "numbered")


def reachable(edges: DataFrame, store: Scratch) -> DataFrame | None:
    """(v, c) for the ends of edges (a, b): the smallest vertex reachable, itself included; None without edges.

    Each round ties every vertex to its smallest neighbour, follows these ties to their ends by doubling, and contracts what is
    tied together: the next round sees only edges between different groups, each once, and at most half of the vertices.
    Rounds end in tables of the shared folder; superseded ones are deleted.
    """
    left = store.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ties = store.keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c")), "ties")
        while True:
            ends = ties.select(F.col("v").alias("c"), F.col("c").alias("end"))
            jumped = store.keep(ties.join(ends, "c").select("v", F.col("end").alias("c"), (F.col("end") != F.col("c")).alias("moved")), "ties")
            store.drop(ties)
            ties = jumped
            if not ties.where("moved").limit(1).count():
                break
        to = lambda old, new: ties.select(F.col("v").alias(old), F.col("c").alias(new))  # noqa: B023, E731  used before the next round
        step = left.join(to("a", "ca"), "a").join(to("b", "cb"), "b").where("ca <> cb")
        after = store.keep(step.select(F.greatest("ca", "cb").alias("a"), F.least("ca", "cb").alias("b")).distinct(), "edges")
        new = ties.select("v", "c") if labels is None else labels.withColumnRenamed("c", "was").join(to("was", "c"), "was", "left").select("v", F.coalesce("c", "was").alias("c"))
        new = store.keep(new, "labels")
        store.drop(left, ties, *([] if labels is None else [labels]))
        left, labels = after, new
    store.drop(left)
    return labels


def connected_components(vertices: DataFrame, edges: DataFrame, v: str = "id") -> DataFrame:
    """(v, component): the smallest vertex reachable over edges (a, b), itself included. Vertices without an edge never enter the loop."""
    labels = reachable(edges, Scratch(vertices.sparkSession))
    if labels is None:
        return vertices.withColumn("component", F.col(v))
    named = labels.select(F.col("v").alias(v), F.col("c").alias("component"))
    return vertices.join(named, v, "left").withColumn("component", F.coalesce("component", v))
