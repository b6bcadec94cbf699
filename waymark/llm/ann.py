"""Approximate nearest neighbours by an adaptive dimension scan over an inverted file.

Index. Unit vectors are rotated by a random orthogonal matrix and assigned to the list of the nearest centroid; the
centroids come from a bounded sample (16 rows a list, SAMPLE to MOST_SAMPLE rows), every vector is indexed, and the
number of lists grows with the table, up to MOST_SAMPLE / 16. A list is cut into blocks of at most BLOCK vectors, each
stored once with its rotated vectors as column blocks of STEP dimensions beside the unit vectors. Lengths with few
vectors are one list, so that only lengths with more than PER_LIST vectors need a sample.

Search. Each query probes its nearest lists. Within a list the squared distance grows column block by column block;
after d of D dimensions the rotated partial distance, scaled by D/d, is an estimate of the whole, and a candidate is
abandoned once the test rejects that it can still beat the query's current k-th best: partial > threshold * d / D *
(1 + epsilon / sqrt(d))^2. Survivors are scored exactly, in double precision, on the original vectors.

The number of probed lists is not guessed: a sample of the queries is answered by brute force, and probes double until
the audit's recall is at least RECALL; once all lists are probed, epsilon doubles, until nothing is abandoned early;
if neighbours were still missing then, the search raises.

Queries are the rows whose id is divisible by EVERY, candidates all rows with another id (rows that repeat an id are
one query, of the smallest vector, and no candidates of it); nearness is the largest cosine, ties to the smaller id; a
query gets K neighbours, or all if there are fewer. Vectors that are null, zero or hold null or non-finite components
take no part, nor do null ids. Only vectors of one length are compared. Repeated rows are each a candidate. An empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, table
from waymark.llm.vectors import by_dimension, matrix, unit, valid

EVERY, K = 50, 5
LISTS, SAMPLE, MOST_SAMPLE, PER_LIST = 64, 8_192, 65_536, 4_096
STEP, EPSILON, NO_EPSILON = 16, 2.1, 64.0
#: Rotated vectors are stored in single precision; the tests allow for that.
ROUNDING = 1e-5
#: Queries of a task row and vectors of a block.
QUERIES, BLOCK = 1_024, 4_096
AUDIT, RECALL = 64, 0.97


@functools.lru_cache(8)
def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, lists: int, seed: int = 3, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on the sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 0, s / np.maximum(n, 1e-12), c)
    return c


def columns(rotated: np.ndarray) -> list[np.ndarray]:
    """Column blocks of STEP dimensions."""
    return [np.ascontiguousarray(rotated[:, d : d + STEP], np.float32) for d in range(0, rotated.shape[1], STEP)]


def scan(queries: list[np.ndarray], bound: np.ndarray, turned: list[np.ndarray], epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test abandons, of column blocks; bound: each query's current k-th best squared distance."""
    dim, d = sum(c.shape[1] for c in turned), 0
    n = len(turned[0])
    q, c = np.repeat(np.arange(len(queries[0])), n), np.tile(np.arange(n), len(queries[0]))
    part = np.zeros(len(q), np.float32)
    for at, (a, b) in enumerate(zip(queries, turned)):
        if at:
            part = part + np.square(a[q] - b[c]).sum(axis=1)
        else:
            part = (np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None] - 2 * a @ b.T).ravel()
        d += b.shape[1]
        slack = (1 + epsilon / np.sqrt(d)) ** 2 if d < dim else 1.0
        keep = part <= bound[q] * (d / dim) * slack + ROUNDING
        q, c, part = q[keep], c[keep], part[keep]
        if not len(q):
            break
    return q, c


class Best:
    """Each query's best k so far: scores descending, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, [np.zeros(0)] * n, [np.zeros(0, np.int64)] * n

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate((self.score[q], scores)), np.concatenate((self.id[q], ids))
        order = np.lexsort((i, -s))[: self.k]
        self.score[q], self.id[q] = s[order], i[order]

    def bound(self, q: int) -> float:
        return 2 - 2 * self.score[q][-1] + 1e-9 if len(self.score[q]) == self.k else np.inf


def _cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q, x)


def search_block(q_ids, q_units, q_turned, x_ids, x_units, x_turned, k: int, epsilon: float = EPSILON) -> Best:
    """The best k of one block for each query; turned are column blocks."""
    best = Best(len(q_ids), k)
    # a first few candidates give each query a bound
    head = min(len(x_ids), 4 * k)
    for i in range(len(q_ids)):
        other = x_ids[:head] != q_ids[i]
        best.add(i, _cosine(np.broadcast_to(q_units[i], x_units[:head][other].shape), x_units[:head][other]), x_ids[:head][other])
    for a in range(head, len(x_ids), 512):
        for b in range(0, len(q_ids), 256):
            bound = np.array([best.bound(i) for i in range(b, min(b + 256, len(q_ids)))])
            q, c = scan([t[b : b + 256] for t in q_turned], bound, [t[a : a + 512] for t in x_turned], epsilon)
            q, c = q + b, c + a
            keep = x_ids[c] != q_ids[q]
            q, c = q[keep], c[keep]
            if not len(q):
                continue
            scores = _cosine(q_units[q], x_units[c])
            cut = np.flatnonzero(np.diff(q)) + 1
            for qs, ss, cs in zip(np.split(q, cut), np.split(scores, cut), np.split(c, cut)):
                best.add(int(qs[0]), ss, x_ids[cs])
    return best


FOUND = "query_id long, vec_id long, score double"
BLOCKS = "dim int, list int, cut int, ids binary, units binary, turned array<binary>"


def _stored(batches):
    """Blocks of (vec_id, embedding) as ids, unit vectors and rotated column blocks."""
    for batch in batches:
        made: list[list] = [[], [], []]
        for row in range(batch.num_rows):
            x = batch.column("block")[row].values
            units = unit(matrix(x.field("embedding")))
            made[0].append(np.asarray(x.field("vec_id"), np.int64).tobytes())
            made[1].append(units.tobytes())
            made[2].append([t.tobytes() for t in columns(units @ rotation(units.shape[1]))])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("dim", "list", "cut")), pa.array(made[0], pa.binary()), pa.array(made[1], pa.binary()), pa.array(made[2], pa.list_(pa.binary()))], ["dim", "list", "cut", "ids", "units", "turned"])


def _search(k: int, epsilon: float):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                q = batch.column("queries")[row].values
                q_ids, q_units = np.asarray(q.field("id"), np.int64), unit(matrix(q.field("embedding")))
                x_ids = np.frombuffer(batch.column("ids")[row].as_py(), np.int64)
                x_units = np.frombuffer(batch.column("units")[row].as_py()).reshape(len(x_ids), -1)
                turned = [np.frombuffer(t, np.float32).reshape(len(x_ids), -1) for t in batch.column("turned")[row].as_py()]
                best = search_block(q_ids, q_units, columns(q_units @ rotation(q_units.shape[1])), x_ids, x_units, turned, k, epsilon)
                n = [len(i) for i in best.id]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate(best.id)), pa.array(np.concatenate(best.score))], ["query_id", "vec_id", "score"])

    return run


def _assign(centers: dict[int, np.ndarray], probes: int | None):
    """Adds list (the nearest) or lists (the `probes` nearest) to rows of (…, embedding, dim)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                x = unit(matrix(part.column("embedding")))
                near = x @ centers[int(d)].T if int(d) in centers else np.zeros((len(x), 1))
                if probes is None:
                    made = pa.array(near.argmax(axis=1).astype(np.int32))
                else:
                    n = min(probes, near.shape[1])
                    made = pa.array(list(np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)), pa.list_(pa.int32()))
                yield part.append_column("list" if probes is None else "lists", made)

    return run


class Index:
    """Blocks of the inverted file, written to the shared folder."""

    def __init__(self, scratch: Scratch, vectors: DataFrame, lists: int | None = None):
        self.scratch = scratch
        every = by_dimension(vectors.where(F.col("vec_id").isNotNull() & valid()).select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding")))
        counts = {r.dim: r["count"] for r in every.groupBy("dim").count().collect()}  # one row for each vector length
        self.centers = {}
        for dim, n in sorted(counts.items()):
            if n <= PER_LIST and not lists:
                continue  # one list
            # PER_LIST vectors to a list on average, LISTS at least, as many as the sample can tell apart at most
            wanted = lists or max(LISTS, n // PER_LIST)
            rows = every.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(max(SAMPLE, min(MOST_SAMPLE, 16 * wanted))).select("embedding").toArrow()
            x = unit(matrix(rows.column("embedding").combine_chunks()))
            self.centers[dim] = centroids(x, max(1, min(len(x) // 16 or 1, wanted)) if not lists else lists)
        self.dims = sorted(counts)
        schema = "vec_id long, embedding array<double>, dim int, list int"
        self.rows = scratch.write(every.mapInArrow(_assign(self.centers, None), schema))
        self.cuts = scratch.write(self.rows.groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cuts")))  # a row for each list
        cut = self.rows.join(F.broadcast(self.cuts), ["dim", "list"]).withColumn("cut", F.pmod(F.xxhash64("vec_id"), "cuts").cast("int"))
        self.blocks = scratch.write(cut.groupBy("dim", "list", "cut").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("block")).mapInArrow(_stored, BLOCKS))

    def search(self, queries: DataFrame, probes: int, epsilon: float = EPSILON, k: int = K) -> DataFrame:
        """queries(query_id, embedding, dim) -> (query_id, rank, vec_id, score)."""
        told = queries.mapInArrow(_assign(self.centers, probes), "query_id long, embedding array<double>, dim int, lists array<int>")
        told = told.select("query_id", "embedding", "dim", F.explode("lists").alias("list"))
        # parts of the queries of a list, as many as it has queries for; a block meets those of its own list only
        told = self.scratch.write(told)
        parts = told.groupBy("dim", "list").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))  # a row for each list
        told = told.join(F.broadcast(parts), ["dim", "list"]).join(F.broadcast(self.cuts), ["dim", "list"])
        packed = told.groupBy("dim", "list", "cuts", F.pmod(F.xxhash64("query_id"), "parts").alias("part")).agg(F.collect_list(F.struct(F.col("query_id").alias("id"), "embedding")).alias("queries"))
        packed = packed.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        pairs = packed.join(self.blocks.hint("merge"), ["dim", "list", "cut"]).select("queries", "ids", "units", "turned")
        found = pairs.mapInArrow(_search(k, epsilon), FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def queries(self, every: int = EVERY) -> DataFrame:
        """One query for each id that is divisible by `every` (of rows that repeat an id, the smallest vector)."""
        asked = self.rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("embedding"))
        return self.scratch.write(by_dimension(asked))

    def settings(self, queries: DataFrame, k: int = K, recall: float = RECALL, audit: int = AUDIT) -> tuple[int, float]:
        """The fewest probes, by doubling, whose recall on a sample of the queries is enough, and the epsilon."""
        if not self.dims:
            return 1, EPSILON
        asked = self.scratch.write(queries.orderBy(F.xxhash64("query_id", F.lit("audit")), "query_id").limit(audit))
        most = max((len(c) for c in self.centers.values()), default=1)
        asked_rows = asked.toPandas()
        exact = self.rows.mapInPandas(_brute(asked_rows, k), FOUND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        exact = self.scratch.write(exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        want = exact.count()
        probes, epsilon = min(most, 8), EPSILON
        while True:
            got = self.search(asked, probes, epsilon, k).join(exact, ["query_id", "vec_id"], "left_semi").count()
            if got >= recall * want:
                return probes, epsilon
            if probes >= most and epsilon > NO_EPSILON:
                raise RuntimeError(f"all lists were read and {want - got} of {want} audited neighbours are missing")
            if probes < most:
                probes = min(most, probes * 2)
            else:
                epsilon *= 2


def _brute(asked: pd.DataFrame, k: int):
    """The exact best k of each part of the table for the audit's queries."""

    def run(frames):
        best = Best(len(asked), k)
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                own = np.flatnonzero(asked["dim"].to_numpy() == dim)
                if not len(own):
                    continue
                q = unit(np.array(asked["embedding"].iloc[own].tolist()))
                near = q @ unit(np.array(part["embedding"].tolist())).T
                ids = part["vec_id"].to_numpy()
                for i, row in zip(own, near):
                    other = ids != asked["query_id"].iloc[i]
                    best.add(i, row[other], ids[other])
        yield pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), [len(x) for x in best.id]), "vec_id": np.concatenate([*best.id, np.zeros(0, np.int64)]), "score": np.concatenate([*best.score, np.zeros(0)])})

    return run


def op5_nearest(spark, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    index = Index(Scratch(spark), table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    if not index.dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.queries()
    return index.search(queries, *index.settings(queries))
