"""Rounds over edge tables: shortest paths, reachability, components, reference closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.rounds import written


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str = "cost", forbidden: DataFrame | None = None, used: DataFrame | None = None, penalty: float = 1.0, cap: int | None = None, rounds: int = 500) -> DataFrame:
    """edges(a, b, weight), sources(source) -> (source, node, cost, hops, path): the cheapest path to every reachable node
    in whole thousandths, ties to fewer hops, then to the lower path. Paths enter no forbidden(node), used(a, b) edges cost
    `penalty` times as much, and paths above the cap are not followed. Only nodes that improved are joined with the edges
    again; rounds go on until none does."""
    unit = edges.select("a", "b", F.col(weight).alias("w"))
    if used is not None:
        unit = unit.join(used.select("a", "b", F.lit(penalty).alias("more")).distinct(), ["a", "b"], "left").withColumn("w", F.col("w") * F.coalesce("more", F.lit(1.0)))
    if forbidden is not None:
        for end in ("a", "b"):
            unit = unit.join(forbidden.select(F.col("node").alias(end)).distinct(), end, "left_anti")
        sources = sources.join(forbidden.select(F.col("node").alias("source")).distinct(), "source", "left_anti")
    unit = written(unit.groupBy("a", "b").agg(F.floor(F.min("w") * 1000 + 0.5).alias("w")))
    best = written(sources.select("source", F.col("source").alias("node"), F.lit(0).cast("long").alias("cost"), F.lit(0).alias("hops"), F.array("source").alias("path"), F.lit(True).alias("fresh")))
    for hop in range(1, rounds + 1):
        far = F.col("cost") + F.col("w")
        told = best.where("fresh").join(unit.withColumnRenamed("a", "node").hint("merge"), "node").where(far <= cap if cap is not None else F.lit(True))
        told = told.select("source", F.col("b").alias("node"), far.alias("cost"), F.lit(hop).alias("hops"), F.concat("path", F.array("b")).alias("path"), F.lit(True).alias("fresh"))
        all_ = best.withColumn("fresh", F.lit(False)).unionByName(told)
        best = written(all_.groupBy("source", "node").agg(F.min(F.struct("cost", "hops", "path", "fresh")).alias("m")).select("source", "node", "m.cost", "m.hops", "m.path", "m.fresh"))
        if not best.where("fresh").limit(1).count():
            return best.select("source", "node", "cost", "hops", "path")
    raise RuntimeError(f"paths still improve after {rounds} rounds")


def path_status(pairs: DataFrame, paths: DataFrame, cap: int | None = None) -> DataFrame:
    """pairs(source, node) with cost and status: ok, over budget (a path above the cap), or unreachable."""
    found = pairs.join(paths.select("source", "node", "cost", "hops").hint("merge"), ["source", "node"], "left")
    over = F.col("cost") > cap if cap is not None else F.lit(False)
    return found.withColumn("status", F.when(F.col("cost").isNull(), "unreachable").when(over, "over budget").otherwise("ok"))


def _legs(stops: DataFrame, paths: DataFrame) -> DataFrame:
    """stops(tour_id, ord, node): each leg of a tour with its path."""
    w = Window.partitionBy("tour_id").orderBy("ord")
    legs = stops.select("tour_id", "ord", F.col("node").alias("source"), F.lead("node").over(w).alias("node")).where("node is not null")
    return legs.join(paths.hint("merge"), ["source", "node"], "left")


def route_cost(stops: DataFrame, paths: DataFrame) -> DataFrame:
    """Legs of each tour and the sum of their costs over the cheapest paths; null if any leg is missing."""
    whole = F.count("cost") == F.count("*")
    return _legs(stops, paths).groupBy("tour_id").agg(F.count("*").alias("legs"), F.when(whole, F.sum("cost")).alias("cost"))


def materialized_routes(stops: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The legs of each tour joined into one path of nodes, with its edges, totals, and how many legs are unreachable."""
    legs = written(_legs(stops, paths))
    hop = legs.where("path is not null").select("tour_id", F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path")).alias("b"))).alias("e")).select("tour_id", "e.a", "e.b")
    totals = written(hop).join(edges.select("a", "b", "duration_s", "distance_m").hint("merge"), ["a", "b"]).groupBy("tour_id").agg(F.count("*").alias("edges"), F.sum(F.floor(F.col("duration_s") + 0.5)).alias("duration_s"), F.sum(F.floor(F.col("distance_m") + 0.5)).alias("distance_m"))
    # a leg starts where the one before ends
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("path", F.array("source", "node")).alias("path")))), F.expr("cast(array() as array<bigint>)"), lambda out, leg: F.when(F.size(out) == 0, leg["path"]).otherwise(F.concat(out, F.slice(leg["path"], F.lit(2), F.size(leg["path"])))))
    routes = legs.groupBy("tour_id").agg(F.count("*").alias("legs"), F.count_if(F.col("path").isNull()).alias("unreachable"), joined.alias("path"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("edges", "duration_s", "distance_m")]
    return routes.join(totals.hint("merge"), "tour_id", "left").select("tour_id", "legs", "unreachable", "path", *zero)


def reachable(edges: DataFrame, start: DataFrame, rounds: int = 200) -> DataFrame:
    """Nodes reachable from any of start(node), with start itself."""
    seen = written(start.select("node").distinct())
    frontier = seen
    for _ in range(rounds):
        frontier = written(frontier.join(edges.select(F.col("a").alias("node"), "b"), "node").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        if not frontier.limit(1).count():
            return seen
        seen = written(seen.unionByName(frontier))
    raise RuntimeError(f"new nodes are still reached after {rounds} rounds")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node of each node's component, by neighbour minimum and pointer jumping."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    for _ in range(rounds):
        told = both.join(labels.select(F.col("node").alias("a"), "root"), "a").select(F.col("b").alias("node"), "root", F.lit(None).cast("long").alias("own"))
        near = written(told.unionByName(labels.withColumn("own", F.col("root"))).groupBy("node").agg(F.min("root").alias("root"), F.max("own").alias("was")))
        labels = written(near.join(near.select(F.col("node").alias("root"), F.col("root").alias("above")), "root").select("node", F.least("root", "above").alias("root"), "was"))
        if not labels.where("root <> was").limit(1).count():
            return labels.select("node", "root")
        labels = labels.select("node", "root")
    raise RuntimeError(f"components still change after {rounds} rounds")


def reference_closure(records: DataFrame, references: DataFrame, rounds: int = 10_000) -> DataFrame:
    """records(id, coarsened) that may be delivered, given their required references(id, ref): each must be delivered too,
    and none may be coarsened unless the record is itself. A record that loses one is withheld, and so on.

    What is withheld is peeled off: each round looks only at the records that were withheld in the round before and takes
    the references to them, so each reference is read once as part of a frontier. Records of a ring of references stay if
    nothing else takes them. Null references ask for nothing; null ids are not delivered; repeated rows count once."""
    held = written(records.where("id is not null").groupBy("id").agg(F.max(F.coalesce("coarsened", F.lit(False))).alias("coarsened")))
    asked = references.where("id is not null and ref is not null").select("id", "ref").distinct()
    own = asked.join(held.hint("merge"), "id")
    to = held.select(F.col("id").alias("ref"), F.col("coarsened").alias("ref_coarsened"))
    edges = written(own.join(to.hint("merge"), "ref", "left").select("id", "ref", (F.col("ref_coarsened").isNull() | (F.col("ref_coarsened") & ~F.col("coarsened"))).alias("unsafe")))
    frontier = written(edges.where("unsafe").select("id").distinct())
    gone = frontier
    edges = written(edges.groupBy("id", "ref").agg(F.max("unsafe").alias("unsafe")).where("not unsafe and id <> ref").select("id", "ref"))
    for _ in range(rounds):
        if not frontier.limit(1).count():
            return held.join(gone.hint("merge"), "id", "left_anti")
        told = edges.join(frontier.select(F.col("id").alias("ref")).hint("merge"), "ref", "left_semi").select("id").distinct()
        frontier = written(told.join(gone.hint("merge"), "id", "left_anti"))
        gone = gone.unionByName(frontier)
    raise RuntimeError(f"records are still withheld after {rounds} rounds")
