"""Near-duplicate embeddings: navigable small-world graphs per shard, exact cosine, components.

Every valid vector goes to a shard by a hash. Each shard builds a graph whose nodes are balls: a vector within half
the linking angle of a node joins its ball, so all members of a ball link with one another. The nodes of all shards
then query every shard for nodes near enough that their balls may link. From the angle d of two nodes and the balls'
radii r and s: if d + r + s is within the linking angle, every member of one links with every member of the other; if
d - r - s is beyond it, none does; otherwise the members are compared, block against block. So links are counted
exactly, and a thick group of copies costs as much as its balls, not its pairs.

Beams widen in two ways: a query whose beam ends while nodes are still near enough repeats with twice the width, and
an audit compares a sample of nodes with all nodes by brute force (a sample of 256, or up to 4,096 where near nodes are
rare; where these want too few pairs, also up to 4,096 nodes for which the search has found some); until its recall is
RECALL, all queries repeat with twice the width. Where no pair is wanted and none found, the width still doubles up to
UNSEEN before that is believed. A beam as wide as the shard reads all of it, so the last repeat misses nothing.

Cosines are in double precision on the original vectors. Null, zero and non-finite vectors link with nothing; only
vectors of one length link. Null ids take part and never name a component. Repeated rows are vectors of their own.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, components, table, width
from waymark.llm.hnsw import Graph
from waymark.llm.vectors import by_dimension, matrix, unit, valid

LEAST = 0.95
SHARDS, SHARD_ROWS = 4, 65_536
#: Nodes of the audit, and more of them until so many pairs are wanted.
BEAM, RECALL, AUDIT, WANTED = 16, 0.999, (256, 1_024, 4_096), 100
#: The beam that has to have found nothing where the audit has nothing to measure by.
UNSEEN = 128
#: Neighbours of a node (twice as many below) and candidates looked at when it joins.
NEIGHBOURS, CANDIDATES = 10, 32
#: Nodes that query a shard in one task, members of a ball that are compared in one row.
QUERIES, BLOCK = 65_536, 512
SLACK = 1e-6  # an arc cosine near 1 is off by some 3e-8; angles are decided without looking at members only beyond this


def _build(radius: float):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        x = unit(np.array(frame["embedding"].tolist(), np.float64))
        rows = frame["row"].to_numpy()
        graph = Graph(x.shape[1], NEIGHBOURS, CANDIDATES)
        node, _ = graph.insert(x, rows, radius)
        graph.near = []  # only needed to build
        lead = np.full(graph.n, -1, np.int64)
        cosine = np.einsum("ij,ij->i", x, graph.x[node])
        # a node is the first of its members
        for i in range(len(rows) - 1, -1, -1):
            lead[node[i]] = rows[i]
        out = pd.DataFrame({"dim": frame["dim"], "shard": frame["shard"], "row": rows, "ball": lead[node], "cosine": cosine, "graph": None})
        made = pd.DataFrame({"dim": frame["dim"][:1], "shard": frame["shard"][:1], "row": [None], "ball": [None], "cosine": [None], "graph": [pickle.dumps((graph, lead))]})
        return pd.concat([out.astype(object), made.astype(object)], ignore_index=True)

    return run


def _ask(least_angle: float, half: float, beam: int):
    def run(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "cosine": []}).astype({"a": int, "b": int, "cosine": float})]
        for blob in graphs["graph"]:
            graph, lead = pickle.loads(blob)
            for at in range(0, len(asked), 2_048):
                part = asked.iloc[at : at + 2_048]
                x = unit(np.array(part["embedding"].tolist(), np.float64))
                least = np.cos(np.minimum(np.pi, least_angle + half + part["radius"].to_numpy() + SLACK))
                who, node, cosine = graph.within(x, least, beam)
                a, b = part["ball"].to_numpy()[who.astype(int)], lead[node.astype(int)]
                keep = a != b
                out.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": np.clip(cosine[keep], -1, 1).astype(float)}))
        return pd.concat(out, ignore_index=True)

    return run


def _compare(least: float):
    """Rows of two blocks of members: each member's number of links in the other block."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [batch.column(c)[i].values for c in ("left", "right")]
                x = [unit(matrix(s.field("embedding"))) for s in sides]
                link = x[0] @ x[1].T >= least
                if link.any():
                    rows = [np.asarray(s.field("row"), np.int64) for s in sides]
                    n = [link.sum(axis=1), link.sum(axis=0)]
                    one = len(rows[0]) + len(rows[1])
                    a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(one, a)), pa.array(np.full(one, b)), pa.array(np.concatenate(rows)), pa.array(np.concatenate(n).astype(np.int64))], ["a", "b", "row", "n"])

    return run


def near_duplicates(scratch: Scratch, vectors: DataFrame, least: float = LEAST, shards: int | None = None) -> DataFrame:
    """vectors(vec_id, embedding) -> (vec_id, n_links, component_id, kept)."""
    spark = scratch.spark
    every = scratch.write(vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), valid().alias("fine")))
    fine = by_dimension(every.where("fine"))
    n = every.count()
    shards = shards or max(SHARDS, -(-n // SHARD_ROWS))
    angle = float(np.arccos(least))
    half = angle / 2 - 1e-6
    schema = "dim int, shard int, row long, ball long, cosine double, graph binary"
    dealt = fine.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")).select("dim", "shard", "row", "embedding")
    built = scratch.write(dealt.groupBy("dim", "shard").applyInPandas(_build(float(np.cos(half))), schema))
    member = built.where("graph is null").select("dim", "row", "ball", "cosine")
    graphs = built.where("graph is not null").select("dim", "shard", "graph")
    size = member.groupBy("dim", "ball").agg(F.count("*").alias("size"), F.acos(F.least(F.min("cosine"), F.lit(1.0))).alias("radius"))
    nodes = size.join(fine.select(F.col("row").alias("ball"), "embedding").hint("merge"), "ball")
    nodes = scratch.write(nodes)
    # every node asks every shard: the nodes are dealt to slots, and each (shard, slot) gets a copy of the shard's graph
    slots = max(3, -(-nodes.count() // QUERIES))
    copies = graphs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))).groupBy("dim", "shard", "slot")
    asking = nodes.withColumn("slot", F.pmod(F.xxhash64("ball"), F.lit(slots)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select("dim", "shard", "slot", "ball", "radius", "embedding")
    for most in AUDIT:
        sample = nodes.orderBy(F.xxhash64("ball", F.lit("audit")), "ball").limit(most).toPandas()
        want = scratch.write(nodes.mapInPandas(_audit(sample, angle), "a long, b long").distinct())
        n_want = want.count()
        if n_want >= WANTED or len(sample) < most:
            break
    beam, all_read = BEAM, len(sample) < most
    while True:
        found = copies.cogroup(asking.groupBy("dim", "shard", "slot")).applyInPandas(_ask(angle, half, beam), "a long, b long, cosine double")
        pairs = scratch.write(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")))
        if n_want < WANTED and not all_read:  # near nodes are rare: measured at nodes that have some
            met = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
            some = nodes.join(met.hint("merge"), "ball", "left_semi").select(*nodes.columns).orderBy(F.xxhash64("ball", F.lit("found")), "ball").limit(AUDIT[-1]).toPandas()
            want = scratch.write(want.unionByName(nodes.mapInPandas(_audit(some, angle), "a long, b long")).distinct())
            n_want = want.count()
        hit = want.join(pairs.hint("merge"), ["a", "b"], "left_semi").count()
        if hit >= RECALL * n_want and (n_want or all_read or beam >= min(n, UNSEEN)):
            break
        if beam >= n:
            raise RuntimeError(f"whole shards were read and {n_want - hit} of {n_want} audited pairs are missing")
        beam *= 2
    about = nodes.select("ball", "size", "radius")
    pairs = pairs.join(about.toDF("a", "size_a", "radius_a").hint("merge"), "a").join(about.toDF("b", "size_b", "radius_b").hint("merge"), "b")
    d, r = F.acos("cosine"), F.col("radius_a") + F.col("radius_b")
    told = F.when(d + r <= angle - SLACK, "all").when(d - r > angle + SLACK, "none").otherwise("some")
    pairs = scratch.write(pairs.withColumn("told", told).where("told <> 'none'"))
    whole = pairs.where("told = 'all'").select("a", "b", "size_a", "size_b")
    # members of balls that must be compared, in blocks
    some = pairs.where("told = 'some'").select("a", "b")
    met = some.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    blocks = member.select("row", "ball").join(met.hint("merge"), "ball").join(about.select("ball", "size").hint("merge"), "ball")
    blocks = blocks.withColumn("cut", F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / BLOCK))).join(fine.select("row", "embedding").hint("merge"), "row")
    blocks = scratch.write(blocks.groupBy("ball", "cut").agg(F.collect_list(F.struct("row", "embedding")).alias("members")))
    facing = some.join(blocks.select(F.col("ball").alias("a"), F.col("members").alias("left")).hint("merge"), "a").join(blocks.select(F.col("ball").alias("b"), F.col("members").alias("right")).hint("merge"), "b")
    counted = scratch.write(facing.repartition(width(spark)).mapInArrow(_compare(least), "a long, b long, row long, n long"))
    edges = whole.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(counted.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())
    roots = components(scratch, edges)
    outside = whole.select(F.col("a").alias("ball"), F.col("size_b").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("size_a").alias("n"))).groupBy("ball").agg(F.sum("n").alias("outside"))
    balls = about.join(outside.hint("merge"), "ball", "left").join(roots.withColumnRenamed("id", "ball").hint("merge"), "ball", "left")
    balls = scratch.write(balls.select("ball", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), F.coalesce("root", "ball").alias("root")))
    held = member.select("row", "ball").join(balls.hint("merge"), "ball").join(counted.groupBy("row").agg(F.sum("n").alias("more")).hint("merge"), "row", "left")
    held = scratch.write(every.select("row", "vec_id").join(held.hint("merge"), "row", "left").select("row", "vec_id", F.coalesce(F.col("links") + F.coalesce("more", F.lit(0)), F.lit(0)).alias("n_links"), F.coalesce("root", "row").alias("root")))
    least_id = scratch.write(held.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    out = held.join(least_id.hint("merge"), "root")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _audit(sample: pd.DataFrame, angle: float):
    """The pairs of sampled nodes and all nodes whose balls may link."""

    def run(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                own = sample[sample["dim"] == dim]
                if not len(own):
                    continue
                near = np.clip(unit(np.array(own["embedding"].tolist())) @ unit(np.array(part["embedding"].tolist())).T, -1, 1)
                i, j = np.nonzero(np.arccos(near) <= angle + own["radius"].to_numpy()[:, None] + part["radius"].to_numpy()[None])
                a, b = own["ball"].to_numpy()[i], part["ball"].to_numpy()[j]
                keep = a != b
                yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]})

    return run


def op2_near_vectors(spark, sf_dir: str) -> DataFrame:
    """Every vector's links, component, and whether it stays."""
    return near_duplicates(Scratch(spark), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
