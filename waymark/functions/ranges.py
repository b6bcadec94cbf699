"""Running sums and ranks over whole tables, a range at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.rounds import written

#: Rows of a range, on average.
ROWS = 1_000_000


def running(df: DataFrame, by: list[str], order: list[str | Column], **sums: Column) -> DataFrame:
    """df with, for each of `sums`, its sum over the rows of the same `by` that come before in `order`.

    Rows are sampled into ranges of (by, order), so that a group of any size is spread over ranges; order has to end in
    what no two rows of a group share, or equal rows can't be told apart. Each range adds up its own rows. Of a range only
    the first group can have begun before, so what ranges carry over is at most a row for each, and is broadcast."""
    spark = df.sparkSession
    df = written(df.withColumns({f"__{n}": c.cast("long") for n, c in sums.items()}))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-df.count() // ROWS))
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = written(df.repartitionByRange(n, *by, *keys).withColumn("__range", F.spark_partition_id()))
    held = ranged.groupBy("__range", *by).agg(*(F.sum(f"__{n}").alias(f"__before_{n}") for n in sums))
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select("__range", *by, *(F.sum(f"__before_{n}").over(earlier).alias(f"__before_{n}") for n in sums)).where(" or ".join(f"__before_{n} is not null" for n in sums))
    carried = carried.toDF("__begun", *(f"__by_{c}" for c in by), *(f"__before_{n}" for n in sums))
    out = ranged.join(F.broadcast(carried), F.expr(" and ".join(["__range = __begun", *(f"{c} <=> __by_{c}" for c in by)])), "left")
    own = Window.partitionBy("__range", *by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    told = {n: F.coalesce(F.sum(f"__{n}").over(own), F.lit(0)) + F.coalesce(f"__before_{n}", F.lit(0)) for n in sums}
    return out.select("*", *(c.alias(n) for n, c in told.items())).select(*[c for c in df.columns if not c.startswith("__")], *sums)
