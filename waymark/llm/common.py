"""What the corpus operators share: tables, the shared scratch folder, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; each can be dropped once its successor is written."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._waymark_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(df._waymark_path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def spare(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def width(spark: SparkSession) -> int:
    """Tasks for work that is dealt out by number: the cluster's shuffle width."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def components(scratch: Scratch, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges(u long, v long): (id, root), root being the smallest id of the component.

    Rounds of neighbour minimum and pointer jumping. Each round is one join with the edges, one aggregate with
    map-side combine and one join of labels with labels; its result is written out, so that a lost executor costs
    one round. Only the number of changed labels reaches the driver. A hub is a skewed join key, which adaptive
    execution splits. Empty edges give no rows; self-loops and repeated edges are harmless.
    """
    both = scratch.write(
        edges.where("u is not null and v is not null")
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.u", "e.v")
        .distinct()
    )
    labels = scratch.write(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("root")).withColumn("was", F.col("id")))
    for _ in range(max_rounds):
        told = both.join(labels.select(F.col("id").alias("u"), "root").hint("merge"), "u").select(F.col("v").alias("id"), "root", F.lit(None).cast("long").alias("own"))
        least = scratch.write(told.unionByName(labels.select("id", "root", F.col("root").alias("own"))).groupBy("id").agg(F.min("root").alias("root"), F.max("own").alias("was")))
        up = least.select(F.col("id").alias("root"), F.col("root").alias("above"))
        after = scratch.write(least.join(up.hint("merge"), "root").select("id", F.least("root", "above").alias("root"), "was"))
        scratch.drop(labels, least)
        labels = after
        if not labels.where("root <> was").limit(1).count():
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    scratch.drop(both)
    return labels.select("id", "root")
