"""Document quality by a generalised additive model with pairwise interactions.

Each feature of the whole text has a lookup table over quantile bins, learnt by cyclic boosting: round after round,
feature after feature, a shallow tree is fitted to the residuals over the bins and added to the feature's table. Then
the pairs of features whose joint tables explain most of what is left get tables of their own, boosted the same way.
A score is the intercept plus table entries, through the logistic function; scoring is array lookups and additions.

Learnt from at most MAX_TRAIN labels (the smallest hashes of doc_id; at most twice as many rows where documents repeat a
doc_id), of which only the features reach the driver. Null and empty texts have defined features (zeros) and are scored. Without labels of both kinds the score is
the share of label 1 (0.5 without labels). Repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import table

MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 120, 0.15
THRESHOLD = 0.7

FEATURES = ("log_bytes", "upper", "digit", "symbol", "bar", "bang", "word_len", "word_dev", "distinct", "triples", "lines_again", "line_words", "stops", "odd_ends", "beyond_ascii", "short", "entropy", "letters")
_CLASS = np.zeros((256, 6))  # upper, lower, digit, space, plain punctuation, other byte
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b, 5 if _b >= 128 else 0 if "A" <= _c <= "Z" else 1 if "a" <= _c <= "z" else 2 if _c.isdigit() else 3 if _b in b" \t\n\r\v\f" else 4 if _c in ".,;:'\"-?()" else 5] = 1
_ASCII = np.arange(256) < 128
_ODD = re.compile(rb"[^\w\s.,;:'\"?()\x80-\xff-](?=\s|$)")


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.zeros(len(FEATURES))
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    upper, lower, digit, _space, plain, other = hist @ _CLASS
    beyond = hist[128:].sum()
    n, k = len(raw), len(words)
    sizes = np.fromiter(map(len, words), np.int64, k)
    ids = np.fromiter(map(hash, words), np.int64, k)
    distinct = len(np.unique(ids))
    if k >= 3:
        with np.errstate(over="ignore"):
            triple = ids[:-2] * np.int64(1_000_003) + ids[1:-1] * np.int64(8_191) + ids[2:]
        triples = len(np.unique(triple)) / (k - 2)
    else:
        triples = 1.0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = hist[hist > 0] / n
    letters = upper + lower
    return np.array([
        np.log1p(n), upper / max(letters, 1), digit / n, (other - beyond) / n, hist[124] / k, hist[33] / k, sizes.mean(), sizes.std(), distinct / k**0.9, triples,
        1 - len(set(lines)) / len(lines), np.log1p(k / len(lines)), hist[46] / k, len(_ODD.findall(raw)) / k, beyond / n, (sizes <= 3).mean(), -(p * np.log2(p)).sum(), (letters + beyond) / n,
    ])


@dataclass
class Model:
    intercept: float
    cuts: list = field(default_factory=list)  # per feature: bin edges
    tables: list = field(default_factory=list)  # per feature: scores by bin
    pairs: list = field(default_factory=list)  # (i, j, table over coarse bins)
    coarse: list = field(default_factory=list)  # per feature: bin -> coarse bin

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        if not self.cuts:
            return out
        bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        for f, t in enumerate(self.tables):
            out += t[bins[f]]
        for i, j, t in self.pairs:
            out += t[self.coarse[i][bins[i]], self.coarse[j][bins[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2, l2: float = 1.0, least: float = 2.0) -> np.ndarray:
    """Leaf values by bin of the best tree over ordered bins with gradient sums g and curvature sums h."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2), -1.0)
        at = int(np.argmax(gain))
        if gain[at] > g.sum() ** 2 / (h.sum() + l2):
            return np.concatenate((_tree(g[: at + 1], h[: at + 1], depth - 1, l2, least), _tree(g[at + 1 :], h[at + 1 :], depth - 1, l2, least)))
    return np.full(len(g), g.sum() / (h.sum() + l2))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A cut of the first feature, then a cut of the second on each side."""
    best, made = -1.0, None
    for cut in range(1, len(g)):
        sides = [_tree(g[s].sum(0), h[s].sum(0), 1) for s in (slice(None, cut), slice(cut, None))]
        gain = sum((t * g[s].sum(0)).sum() for t, s in zip(sides, (slice(None, cut), slice(cut, None))))
        if gain > best:
            best, made = gain, np.vstack([np.tile(sides[0], (cut, 1)), np.tile(sides[1], (len(g) - cut, 1))])
    return made


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """x rows of features, y 0/1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    model.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(model.cuts)]
    size = [len(c) + 1 for c in model.cuts]
    model.tables = [np.zeros(s) for s in size]
    model.coarse = [np.arange(s) * PAIR_BINS // max(s, PAIR_BINS) for s in size]
    z = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(len(size)):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[f], g, size[f]), np.bincount(bins[f], h, size[f]))
            model.tables[f] += step
            z += step[bins[f]]
    g, h = slopes()
    joint, gains = {}, []
    for i in range(len(size)):
        for j in range(i + 1, len(size)):
            at = model.coarse[i][bins[i]] * PAIR_BINS + model.coarse[j][bins[j]]
            gg, hh = (np.bincount(at, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
            gains.append((float((_pair_tree(gg, hh) * gg).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        joint[i, j] = (model.coarse[i][bins[i]] * PAIR_BINS + model.coarse[j][bins[j]], np.zeros((PAIR_BINS, PAIR_BINS)))
    for _ in range(ROUNDS // 4):
        for at, t in joint.values():
            g, h = slopes()
            gg, hh = (np.bincount(at, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
            step = RATE * _pair_tree(gg, hh)
            t += step
            z += step.ravel()[at]
    model.pairs = [(i, j, t) for (i, j), (_, t) in joint.items()]
    return model


def held_out(column: str = "doc_id", mod: int = 4, rest: int = 2):
    """Whether crc32(column as text) mod `mod` is `rest`; false for null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % mod == rest, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, mod: int, rest: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labels that are not held out, the smallest hashes of doc_id first; a doc_id that
    documents repeat has a row for each."""
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", mod, rest)).select("doc_id", F.col(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)  # at most 16 bytes x `most`
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")


def _featured(batches):
    for batch in batches:
        made = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(FEATURES))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(made), pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    rows = sample(docs, labels, "quality", most, 4, 2).mapInArrow(_featured, "doc_id long, y int, x array<double>").orderBy(F.xxhash64("doc_id"), "y", "x").limit(2 * most).collect()
    if not rows:
        return Model(0.0)
    return fit(np.array([r.x for r in rows]), np.array([r.y for r in rows], float))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with the score in a column that docs does not have."""
    from pyspark.sql import types as T

    def run(batches):
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(FEATURES))
            yield batch.append_column(column, pa.array(model.score(x)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op1_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score, and whether it was held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
