"""Mixing sources to target weights with hash-threshold histograms. Native DataFrame operations only.

A document's size is its number of words. Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share
all words; a source's target stops at three times its size and the excess is reshared by weight until none is above.
Each document of a source is taken floor(target / size of the source) times, and documents whose hash lies under the
source's threshold once more. The threshold is found without sorting documents: words are summed by source and hash
bucket, the bucket in which the budget runs out is the only one summed again by its next 12 bits, down to one hash
value; that one is taken if this brings the sum nearer to the budget.

Null texts have size 0 and are taken 0 times in words. A null source is a source of its own. Documents with the same
id and size share a hash and so one fate; repeated rows each count. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3
SEED = "mix-1"
BITS, STEP = 60, 12
#: Source tables up to this many rows are broadcast (64 bytes a row); larger ones are joined by a shuffle.
BROADCAST_ROWS = 50_000

KEY = ["s_nil", "s_key"]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with size, a 60-bit hash of (doc_id, size), and the source as a join key without nulls."""
    out = docs.withColumn("size", size_of(F.col("text")))
    text = F.concat_ws("|", F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string"))
    return out.withColumns({"h": F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long"), "s_nil": F.col("source").isNull(), "s_key": F.coalesce("source", F.lit(""))})


def targets(rows: DataFrame) -> DataFrame:
    """For each source: source_size, target, full copies, and the rest of the target as budget."""
    own = rows.groupBy(*KEY).agg(F.sum("size").alias("source_size"))
    every = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(*KEY))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(place - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    own = own.withColumn("w", weight.cast("long")).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    # fill by rising cap / weight: a source is capped if its cap lies under its share of what the earlier ones leave
    order = Window.orderBy(F.col("cap") / F.col("w"), *KEY)
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.sum("source_size").over(every) - (F.sum("cap").over(before) - F.col("cap"))
    open_w = F.sum("w").over(every) - (F.sum("w").over(before) - F.col("w"))
    own = own.withColumn("capped", left * F.col("w") > F.col("cap") * open_w)
    rest = F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    share = F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0)).over(every)
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(rest.cast("double") * F.col("w") / share)
    own = own.withColumn("target", target).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return own.select(*KEY, "source_size", "target", "full", (F.col("target") - F.col("full") * F.col("source_size")).alias("budget"))


def _with(rows: DataFrame, small: DataFrame, n: int, on: list[str]) -> DataFrame:
    return rows.join(F.broadcast(small) if n <= BROADCAST_ROWS else small.hint("merge"), on)


def thresholds(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, int]:
    """For each source of rows(s_nil, s_key, size, h): its target and threshold; and the number of sources."""
    state = scratch.write(targets(rows).withColumns({"bucket": F.lit(0).cast("long"), "before": F.lit(0).cast("long")}))
    n = state.count()
    for shift in range(BITS - STEP, -1, -STEP):
        inside = rows.withColumn("bucket", F.shiftright("h", shift + STEP))
        sums = _with(inside, state.select(*KEY, "bucket"), n, [*KEY, "bucket"]).groupBy(*KEY, F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("g"))
        order = Window.partitionBy(*KEY).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = _with(sums, state.drop("bucket"), n, KEY).withColumn("upto", F.col("before") + F.sum("g").over(order))
        # the first bucket that passes the budget, or else the last one
        over = F.col("upto") > F.col("budget")
        pick = F.struct((~over).alias("within"), F.when(over, F.col("bucket")).otherwise(-F.col("bucket")).alias("order"), "bucket", (F.col("upto") - F.col("g")).alias("before"), "g")
        best = sums.groupBy(*KEY, "source_size", "target", "full", "budget").agg(F.min(pick).alias("p"))
        last = scratch.write(best.select(*KEY, "source_size", "target", "full", "budget", "p.bucket", "p.before", "p.g"))
        state = last.drop("g")
    take = 2 * F.col("before") + F.col("g") <= 2 * F.col("budget")
    return scratch.write(last.select(*KEY, "source_size", "target", "full", F.col("bucket").alias("edge"), take.alias("edge_in"))), n


def _copies() -> Column:
    more = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("edge_in"))
    return F.when(F.col("size") == 0, 0).otherwise(F.col("full") + more.cast("long"))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it."""
    scratch = Scratch(spark)
    rows = scratch.write(keyed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text"))
    found, n = thresholds(scratch, rows)
    return _with(rows, found, n, KEY).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"), "source")


def mixed(spark, docs: DataFrame) -> DataFrame:
    """docs with each document as often as the mix takes it; documents without words once, as they cost nothing."""
    scratch = Scratch(spark)
    names = docs.columns
    found, n = thresholds(scratch, scratch.write(keyed(docs.select("doc_id", "source", "text")).select(*KEY, "size", "h")))
    wide = _with(keyed(docs.select(F.struct(*names).alias("__doc"), "doc_id", "source", "text")), found, n, KEY)
    times = F.when(F.col("size") == 0, 1).otherwise(_copies()).cast("int")
    return wide.where(times > 0).select("__doc", F.explode(F.array_repeat(F.lit(0), times))).select("__doc.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), k AS (
  SELECT *, CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(size AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM k GROUP BY source
), c AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total,
         sum(3 * source_size) OVER o - 3 * source_size AS cap_before, sum(w) OVER () - (sum(w) OVER o - w) AS open_w
  FROM s WINDOW o AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), f AS (
  SELECT *, (total - cap_before) * w > cap * open_w AS capped FROM c
), t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN CAST(cap AS DOUBLE)
              ELSE CAST(total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE) * w / CAST(sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS DOUBLE) END AS target
  FROM f
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS full_copies FROM t
), g AS (
  SELECT source, h, CAST(sum(size) AS BIGINT) AS g FROM k GROUP BY source, h
), u AS (
  SELECT source, h, g, CAST(sum(g) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - g AS before FROM g
)
SELECT k.doc_id, k.size, b.source_size, b.target,
       k.size * (b.full_copies + CASE WHEN 2 * u.before + u.g <= 2 * (b.target - b.full_copies * b.source_size) THEN 1 ELSE 0 END) AS taken,
       k.source
FROM k JOIN b ON k.source IS NOT DISTINCT FROM b.source JOIN u ON k.source IS NOT DISTINCT FROM u.source AND k.h = u.h
"""
