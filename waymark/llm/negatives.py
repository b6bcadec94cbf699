"""Hard negatives by an inverted multi-index: rows of other labels that score just below an anchor's positives.

Index. A vector's components become floor(256 x); the first and the second half of the components have a codebook each,
learnt from a bounded sample, and a row's cell is its pair of nearest codewords. For each codeword the radius is the
greatest distance of any row in it. All rows are indexed; the cells of one first codeword are a shelf, stored in blocks
of some BLOCK rows.

Search. An anchor's score with a row of cell (i, j) is at most the sum of two half bounds, each the score with the
codeword plus the anchor half's length times the codeword's radius. A heap over both sorted codebooks visits cells by
falling sums, in rounds that ask for four times as many rows each. An anchor's positives are certified once the last of
them scores above the sum of the next cell. Its negatives lie in windows below each positive's score; cells whose least
possible score is above all windows are passed by, and a window is certified once its last negative scores above the
next cell's sum, or that sum is below the window. So results are those of a full scan, whatever the codebooks.

Each round writes what it asked for and the best so far. An anchor meets a block once; blocks are dealt out by
(shelf, block), anchors in parts within a shelf, so that a crowded shelf is many blocks of many tasks.

Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; rows that repeat
an id count as one, the one with the least label, then vector. Only vectors of one length have a score. Scores must fit
in 53 bits: larger components raise. Copies are rows of their own; an anchor may be a positive or a negative of another.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, table
from waymark.llm.vectors import by_dimension, matrix

ANCHORS, POSITIVES, NEGATIVES = 100, 5, 5
SCALE, LEAST_PERCENT = 256, 80
MOVED, LABELS = 7, 10
SAMPLE, MOST_CODES, PER_CELL = 16_384, 256, 64
BLOCK, PART = 4_096, 512
FIRST, MORE = 4_096, 4


def relabelled(vec_id, label):
    """The label that counts: of every seventh id the next one."""
    return F.when(vec_id % MOVED == 0, (label + 1) % LABELS).otherwise(label)


def codebook(x: np.ndarray, codes: int, seed: int = 13, rounds: int = 10) -> np.ndarray:
    """k-means on the sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), codes, replace=False)].astype(float)
    for _ in range(rounds):
        own = nearest(x, c)[0]
        n = np.bincount(own, minlength=codes)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest codeword and its distance."""
    own = (np.square(c).sum(1)[None] - 2 * x @ c.T).argmin(axis=1)
    return own, np.sqrt(np.square(x - c[own]).sum(axis=1))


class Codes:
    """Of one vector length: codebooks of both halves, their radii, and the rows of each cell."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.left.shape[1]
        return x[:, :h], x[:, h:]

    def bounds(self, x: np.ndarray, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and codeword the greatest (sign -1: least) score of the halves, rounded outwards."""
        out = []
        for half, codes, radii in zip(self.halves(x), (self.left, self.right), self.radii):
            reach = np.sqrt(np.square(half).sum(axis=1))[:, None] * radii[None]
            score = half @ codes.T
            out.append(score + sign * (reach + 1e-9 * (np.abs(score) + reach) + 1e-3))
        return tuple(out)


def visits(a: np.ndarray, b: np.ndarray):
    """Pairs (i, j) by falling a[i] + b[j], with the sum."""
    left, right = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap = [(-(a[left[0]] + b[right[0]]), 0, 0)]
    while heap:
        bound, p, q = heapq.heappop(heap)
        yield int(left[p]), int(right[q]), -bound
        if q + 1 < len(right):
            heapq.heappush(heap, (-(a[left[p]] + b[right[q + 1]]), p, q + 1))
        if not q and p + 1 < len(left):
            heapq.heappush(heap, (-(a[left[p + 1]] + b[right[0]]), p + 1, 0))


def least_of(score: int) -> int:
    """The least score in the window of a positive's."""
    return -(-LEAST_PERCENT * score // 100)


def _assigned(codes: dict[int, Codes]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                (i, r), (j, s) = (nearest(h, c) for h, c in zip(codes[int(d)].halves(matrix(part.column("x"))), (codes[int(d)].left, codes[int(d)].right)))
                for name, made in (("i", i.astype(np.int32)), ("j", j.astype(np.int32)), ("r", r), ("s", s)):
                    part = part.append_column(name, pa.array(made))
                yield part

    return run


BLOCKS = "dim int, i int, cut int, js binary, ids binary, labels binary, xs binary"
ASKED = "anchor_id long, dim int, label long, x array<long>, windows array<long>, seen int, next double, cells array<struct<i:int,js:binary>>"


def _stored(batches):
    """Blocks as binary columns, by id, so that of equal scores the first has the smaller id."""
    for batch in batches:
        made: list[list] = [[], [], [], []]
        for row in batch.column("rows"):
            rows = row.values
            ids = np.asarray(rows.field("vec_id"), np.int64)
            order = np.argsort(ids)
            for k, x in enumerate((np.asarray(rows.field("j"), np.int32), ids, np.asarray(rows.field("label"), np.int64), matrix(rows.field("x")).astype(np.int32))):
                made[k].append(x[order].tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dim", "i", "cut")), *(pa.array(m, pa.binary()) for m in made)], ["dim", "i", "cut", "js", "ids", "labels", "xs"])


def _asked(codes: dict[int, Codes], rows: int):
    """Each anchor's next cells: until they hold so many rows, or no window reaches further."""

    def of(own: Codes, a, b, low, windows, seen):
        cells: dict[int, list[int]] = {}
        held, floor, top = 0, min(map(least_of, windows), default=None), max(windows, default=None)
        for at, (i, j, bound) in enumerate(visits(a, b)):
            if at < seen:
                continue
            if floor is not None and bound < floor:
                break
            if held >= rows:
                return at, bound, cells
            if own.n[i, j] and not (top is not None and low[0][i] + low[1][j] > top):
                cells.setdefault(i, []).append(j)
                held += int(own.n[i, j])
        return at + 1, None, cells

    def run(batches):
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                own, x = codes[batch.column("dim")[k].as_py()], matrix(batch.column("x").slice(k, 1))
                a, b = own.bounds(x)
                low = [h[0] for h in own.bounds(x, -1)]
                out.append(of(own, a[0], b[0], low, batch.column("windows")[k].as_py() or [], batch.column("seen")[k].as_py()))
            rest = [batch.column(c) for c in ("anchor_id", "dim", "label", "x", "windows")]
            cells = [[{"i": i, "js": np.array(js, np.int32).tobytes()} for i, js in o[2].items()] for o in out]
            yield pa.RecordBatch.from_arrays([*rest, pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.float64()), pa.array(cells, pa.list_(pa.struct([("i", pa.int32()), ("js", pa.binary())])))], ["anchor_id", "dim", "label", "x", "windows", "seen", "next", "cells"])

    return run


def best(scores: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The places (row, column) of each row's k greatest kept scores, of equal ones the first columns."""
    if scores.shape[1] > k:
        scores = np.where(keep, scores, -np.inf)
        keep = keep & (scores >= np.partition(scores, -k, axis=1)[:, [-k]])
    r, c = np.nonzero(keep)
    order = np.lexsort((c, -scores[r, c], r))
    r, c = r[order], c[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    return r[place < k], c[place < k]


def _scored(mined: bool, k: int):
    """The best rows of a block for each anchor of a part: of its own label, or of others for each of its windows."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                asking = batch.column("anchors")[row].values
                anchor, own, x = np.asarray(asking.field("anchor_id"), np.int64), np.asarray(asking.field("label"), np.int64), matrix(asking.field("x"))
                js, ids, labels = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("js", np.int32), ("ids", np.int64), ("labels", np.int64)))
                xs = np.frombuffer(batch.column("xs")[row].as_py(), np.int32).reshape(len(ids), -1).astype(float)
                wanted = np.zeros((len(anchor), int(js.max()) + 1), bool)
                for r, cells in enumerate(asking.field("js")):
                    cells = np.frombuffer(cells.as_py(), np.int32)
                    wanted[r, cells[cells < wanted.shape[1]]] = True
                scores = x @ xs.T
                same = own[:, None] == labels[None]
                keep = wanted[:, js] & (same if not mined else ~same) & (anchor[:, None] != ids[None])
                if not mined:
                    r, c = best(scores, keep, k)
                    found = [(r, c, np.zeros(len(r), np.int64))]
                else:
                    found = []
                    windows = [w.as_py() for w in asking.field("windows")]
                    for at in range(max(map(len, windows))):
                        top = np.array([w[at] if at < len(w) else -1 for w in windows], np.int64)
                        r, c = best(scores, keep & (scores <= top[:, None]) & (scores >= -(-LEAST_PERCENT * top // 100)[:, None]), k)
                        found.append((r, c, top[r]))
                r, c, top = (np.concatenate(f) for f in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(anchor[r]), pa.array(top), pa.array(ids[c]), pa.array(scores[r, c].astype(np.int64))], ["anchor_id", "top", "vec_id", "score"])

    return run


class Index:
    """The multi-index of vectors(vec_id, label, embedding), written to the shared folder."""

    def __init__(self, scratch: Scratch, vectors: DataFrame):
        self.scratch, spark = scratch, scratch.spark
        wide = F.transform("embedding", lambda x: x.cast("double"))
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size("embedding") > 0)
        rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), wide.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("row"))
        rows = by_dimension(rows.select("vec_id", relabelled(F.col("vec_id"), F.col("row.label")).alias("label"), F.col("row.embedding").alias("embedding")))
        rows = rows.select("vec_id", "label", "dim", F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x)).alias("x"), F.array_max(F.transform("embedding", F.abs)).alias("size"))
        rows = scratch.write(rows)
        self.codes: dict[int, Codes] = {}
        self.anchors = 0
        for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max("size").alias("size")).collect():  # a row for each vector length
            if (SCALE * r["size"] + 1) ** 2 * r.dim >= 2**53:
                raise ValueError(f"components as large as {r['size']} give scores of more than 53 bits")
            n_codes = int(max(1, min(MOST_CODES, (r.n / PER_CELL) ** 0.5)))
            sample = rows.where(F.col("dim") == r.dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE if n_codes > 1 else 1, 1)).select("x").toPandas()
            x = np.array(sample["x"].tolist(), float)
            half = -(-r.dim // 2)
            self.codes[r.dim] = Codes(codebook(x[:, :half], n_codes), codebook(x[:, half:], n_codes))
        told = scratch.write(rows.select("vec_id", "label", "dim", "x").mapInArrow(_assigned(self.codes), "vec_id long, label long, dim int, x array<long>, i int, j int, r double, s double"))
        scratch.drop(rows)
        self.rows = told
        for own in self.codes.values():
            own.n, own.radii = np.zeros((len(own.left), len(own.right)), np.int64), (np.zeros(len(own.left)), np.zeros(len(own.right)))
        for c in told.groupBy("dim", "i", "j").agg(F.count("*").alias("n"), F.max("r").alias("r"), F.max("s").alias("s")).collect():  # at most MOST_CODES squared for each length
            own = self.codes[c.dim]
            own.n[c.i, c.j] = c.n
            own.radii[0][c.i], own.radii[1][c.j] = max(own.radii[0][c.i], c.r), max(own.radii[1][c.j], c.s)
        shelves = [(d, i, int(-(-n // BLOCK))) for d, own in self.codes.items() for i, n in enumerate(own.n.sum(axis=1))]
        self.shelves = spark.createDataFrame(shelves, "dim int, i int, cuts int")  # at most MOST_CODES rows for each length
        cut = told.join(F.broadcast(self.shelves), ["dim", "i"]).withColumn("cut", F.pmod(F.xxhash64("vec_id"), "cuts").cast("int"))
        self.blocks = scratch.write(cut.groupBy("dim", "i", "cut").agg(F.collect_list(F.struct("j", "vec_id", "label", "x")).alias("rows")).mapInArrow(_stored, BLOCKS))

    def round(self, asked: DataFrame, mined: bool, k: int) -> DataFrame:
        """(anchor_id, top, vec_id, score) from the cells that asked names."""
        told = asked.select("dim", "anchor_id", "label", "x", "windows", F.explode("cells").alias("cell")).select("dim", "cell.i", F.struct("anchor_id", "label", "x", "windows", "cell.js").alias("anchor"))
        parts = told.groupBy("dim", "i").agg(F.ceil(F.count("*") / PART).alias("parts"))  # a row for each shelf
        told = told.join(F.broadcast(parts), ["dim", "i"]).join(F.broadcast(self.shelves), ["dim", "i"])
        packed = told.groupBy("dim", "i", "cuts", F.pmod(F.xxhash64("anchor.anchor_id"), "parts").alias("part")).agg(F.collect_list("anchor").alias("anchors"))
        packed = packed.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        met = packed.join(self.blocks.hint("merge"), ["dim", "i", "cut"]).select("anchors", "js", "ids", "labels", "xs")
        return met.mapInArrow(_scored(mined, k), "anchor_id long, top long, vec_id long, score long")

    def certified(self, anchors: DataFrame, mined: bool, k: int) -> DataFrame:
        """For anchors(anchor_id, dim, label, x, windows): the k best of its label, or of others in each window, with their ranks."""
        scratch, rows, found, used = self.scratch, FIRST, None, []
        state = anchors.withColumn("seen", F.lit(0))
        while True:
            asked = scratch.write(state.mapInArrow(_asked(self.codes, rows), ASKED))
            got = self.round(asked, mined, k)
            got = got if found is None else got.unionByName(found.drop("rank"))
            order = Window.partitionBy("anchor_id", "top").orderBy(F.desc("score"), "vec_id")
            after = scratch.write(got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
            # a window is open if the next cell may hold what goes before its last row; without k rows, if it may hold any
            full = after.where(F.col("rank") == k).select("anchor_id", "top", F.col("score").alias("last"))
            windows = F.explode("windows" if mined else F.array(F.lit(0).cast("long"))).alias("top")
            left = asked.where("next is not null").select("anchor_id", "next", windows).join(full.hint("merge"), ["anchor_id", "top"], "left")
            left = left.where((F.col("last").isNull() | (F.col("last") <= F.col("next"))) & (F.lit(not mined) | (F.ceil(F.col("top") * LEAST_PERCENT / 100) <= F.col("next"))))
            left = left.groupBy("anchor_id").agg(F.collect_list("top").alias("windows"))
            state = scratch.write(asked.drop("windows", "next", "cells").join(left.hint("merge"), "anchor_id").select("anchor_id", "dim", "label", "x", "windows" if mined else F.lit(None).cast("array<long>").alias("windows"), "seen"))
            scratch.drop(asked, *used, *([found] if found is not None else []))
            found, used, rows = after, [state], rows * MORE
            if not state.limit(1).count():
                scratch.drop(state)
                return found


def hard_negatives(scratch: Scratch, vectors: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive."""
    index = Index(scratch, vectors)
    anchors = index.rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "dim", "label", "x", F.lit(None).cast("array<long>").alias("windows"))
    near = index.certified(anchors, False, positives).select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = near.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("windows"))
    mining = anchors.drop("windows").join(windows.hint("merge"), "anchor_id")
    mined = index.certified(mining.select("anchor_id", "dim", "label", "x", "windows"), True, negatives)
    mined = mined.select("anchor_id", F.col("top").alias("positive_score"), F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = near.join(mined.hint("merge"), ["anchor_id", "positive_score"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """The hard negatives of every hundredth vector's positives."""
    return hard_negatives(Scratch(spark), table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))


SQL = """
WITH f AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (
  SELECT vec_id, min({'label': label, 'e': e}) AS r FROM f GROUP BY vec_id
), v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (r.label + 1) % 10 ELSE r.label END AS label, list_transform(r.e, lambda x: floor(256 * x)) AS x FROM u
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
