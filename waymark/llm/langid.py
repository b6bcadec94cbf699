"""Language identification by a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are read in windows of WINDOW bytes, each from a zero state in both directions; at every byte the
two states label the position with a probability for each language, and the document's probabilities are the mean over
all its bytes; of equally likely languages the first in order is taken. The network is trained in numpy by backpropagation through time with a label at every position.

Learnt from at most MAX_WINDOWS windows: about as many documents of each language, by the smallest hashes of doc_id,
each with one window at a hashed place of its text, or all of a shorter text (twice as many windows where doc_ids
repeat). Every language that has a text with any byte is learnt; the network has an output for each. Texts that are null or have no letter are `und` with score 0; so
is everything if there is no labelled text. Repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import table
from waymark.llm.quality import held_out

WINDOW, HIDDEN, MAX_WINDOWS = 64, 8, 6_000
STEPS, BATCH, RATE = 500, 128, 0.02
#: Windows that are read side by side.
SIDE = 1024


class Network:
    """Gates in the order update, reset, candidate; the two directions are the first axis of every array.

    Gates use tanh with halved inputs, 0.5 + 0.5 tanh(x / 2), which is the logistic function."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.h = langs, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
            "u": rng.normal(0, hidden**-0.5, (2, hidden, 2 * hidden)).astype(np.float32),
            "c": rng.normal(0, hidden**-0.5, (2, hidden, hidden)).astype(np.float32),
            "o": rng.normal(0, 0.3, (2, hidden, len(langs))).astype(np.float32),
            "b": np.zeros(len(langs), np.float32),
        }

    def states(self, both: np.ndarray, keep: bool):
        """both (2, steps, n): bytes as each direction reads them. Yields each step's states, or all that training needs."""
        h, p = self.h, self.p
        s = np.zeros((2, both.shape[2], h), p["u"].dtype)
        d = np.array([[0], [1]])
        for t in range(both.shape[1]):
            x = p["x"][d, both[:, t]]
            g = 0.5 + 0.5 * np.tanh(0.5 * (x[..., : 2 * h] + s @ p["u"]))
            z, r = g[..., :h], g[..., h:]
            rs = r * s
            c = np.tanh(x[..., 2 * h :] + rs @ p["c"])
            new = s + z * (c - s)
            yield (new, (s, z, r, rs, c)) if keep else new
            s = new

    def probabilities(self, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Sum over each window's bytes of the positions' probabilities; windows (n, steps), zero padded, the longest first."""
        n, steps = windows.shape
        at = np.maximum(lengths[:, None] - 1 - np.arange(steps)[None], 0)
        both = np.stack([windows.T, np.take_along_axis(windows, at, 1).T])
        logit = np.empty((2, n, steps, len(self.langs)), np.float32)
        for t, s in enumerate(self.states(both, False)):
            logit[:, :, t] = s @ self.p["o"]
        back = np.take_along_axis(logit[1], at[:, :, None], 1)  # the state that has read the bytes from the end down to t
        e = np.exp(np.clip(logit[0] + back + self.p["b"], -30, 30))
        e /= e.sum(axis=2, keepdims=True)
        e *= (np.arange(steps)[None] < lengths[:, None])[:, :, None]
        return e.sum(axis=1)

    def gradient(self, w: np.ndarray, y: np.ndarray, lengths: np.ndarray | None = None) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time; windows w (n, steps), zero padded
        beyond their lengths, and the language y of each."""
        p, h = self.p, self.h
        n, n_steps = w.shape
        lengths = np.full(n, n_steps) if lengths is None else lengths
        # where the direction from the end is after t bytes, which is also after how many bytes it is at t
        at = np.maximum(lengths[:, None] - 1 - np.arange(n_steps)[None], 0).T
        real = (np.arange(n_steps)[:, None] < lengths[None])[:, :, None]
        both = np.stack([w.T, np.take_along_axis(w.T, at, 0)])
        held = list(self.states(both, True))
        sf = np.stack([s[0] for s, _ in held])  # (t, n, h)
        sb = np.take_along_axis(np.stack([s[1] for s, _ in held]), at[:, :, None], 0)
        logit = sf @ p["o"][0] + sb @ p["o"][1] + p["b"]
        e = np.exp(logit - logit.max(-1, keepdims=True))
        e /= e.sum(-1, keepdims=True)
        e[:, np.arange(n), y] -= 1
        e *= real / lengths.sum()
        g = {k: np.zeros_like(a) for k, a in p.items()}
        g["b"] = e.sum((0, 1))
        g["o"][0], g["o"][1] = np.einsum("tnh,tnl->hl", sf, e), np.einsum("tnh,tnl->hl", sb, e)
        out = np.stack([e @ p["o"][0].T, np.take_along_axis(e @ p["o"][1].T, at[:, :, None], 0) * real], 1)  # (t, 2, n, h) as each direction reads
        ds = np.zeros((2, n, h), p["u"].dtype)
        d = np.array([[0], [1]])
        for t in range(n_steps - 1, -1, -1):
            s, z, r, rs, c = held[t][1]
            ds = ds + out[t]
            dc = ds * z * (1 - c * c)
            drs = dc @ p["c"].transpose(0, 2, 1)
            dg = np.concatenate([ds * (c - s) * z * (1 - z), drs * s * r * (1 - r)], -1)
            g["c"] += rs.transpose(0, 2, 1) @ dc
            g["u"] += s.transpose(0, 2, 1) @ dg
            np.add.at(g["x"], (d, both[:, t]), np.concatenate([dg, dc], -1))
            ds = ds * (1 - z) + drs * r + dg @ p["u"].transpose(0, 2, 1)
        return g

    def train(self, windows: np.ndarray, y: np.ndarray, lengths: np.ndarray | None = None, steps: int = STEPS, seed: int = 11) -> None:
        """windows (n, WINDOW), zero padded beyond their lengths; y the language of each."""
        rng, p = np.random.default_rng(seed), self.p
        m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(y), BATCH)
            g = self.gradient(windows[pick], y[pick], None if lengths is None else lengths[pick])
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            rate = RATE * min(1, 2 - 2 * step / (steps + 1))
            for k in p:
                a = g[k] / max(1.0, norm)
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.999 * v[k] + 0.001 * a * a
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (n, languages) over all bytes of each text; zeros for empty texts."""
        sizes = np.array([len(t) for t in texts], np.int64)
        out = np.zeros((len(texts), len(self.langs)))
        if not sizes.sum():
            return out
        raw = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        starts = np.cumsum(sizes) - sizes
        count = -(-sizes // WINDOW)
        of = np.repeat(np.arange(len(texts)), count)
        k = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        first = starts[of] + k * WINDOW
        size = np.minimum(WINDOW, sizes[of] - k * WINDOW)
        order = np.argsort(-size, kind="stable")
        for a in range(0, len(order), SIDE):
            own = order[a : a + SIDE]
            steps = int(size[own].max())
            got = self.probabilities(raw[first[own][:, None] + np.arange(steps)[None]], size[own])
            np.add.at(out, of[own], got)
        return out / np.maximum(sizes, 1)[:, None]


def _window(batches):
    for batch in batches:
        keep = []
        for i, (doc, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"))):
            raw = text.as_py().encode("utf-8", "surrogatepass")
            at = (int(doc.as_py()) * 2_654_435_761 >> 3) % max(1, len(raw) - WINDOW + 1)
            keep.append(raw[at : at + WINDOW])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(keep, pa.binary())], ["doc_id", "lang", "bytes"])


def train(docs: DataFrame, most: int = MAX_WINDOWS) -> Network | None:
    """None if there is nothing to learn from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (F.octet_length("text") > 0))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language, as the network has an output for each
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, most / len(counts) / n)).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    picked = known.where(place < share).select("doc_id", "lang", "text").mapInArrow(_window, "doc_id long, lang string, bytes binary")
    rows = picked.orderBy(F.xxhash64("doc_id"), "lang", "bytes").limit(2 * most).collect()
    langs = sorted(counts)
    net = Network(langs)
    if len(langs) > 1 and rows:
        raw = [bytes(r["bytes"]) for r in rows]
        net.train(np.array([np.frombuffer(x.ljust(WINDOW, b"\0"), np.uint8) for x in raw]), np.array([langs.index(r.lang) for r in rows]), np.array([len(x) for x in raw]))
    return net


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """docs with lang_pred and score, the pooled probability of lang_pred."""

    def run(batches):
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            speaks = [t is not None and any(map(str.isalpha, t)) for t in texts]
            raw = [t.encode("utf-8", "surrogatepass") if s and net else b"" for t, s in zip(texts, speaks)]
            names, scores, a = [], [], 0
            while a < len(raw):  # a few million bytes at a time
                b, total = a, 0
                while b < len(raw) and (b == a or total + len(raw[b]) < 4_000_000):
                    total += len(raw[b])
                    b += 1
                for p in net.documents(raw[a:b]) if net else np.zeros((b - a, 1)):
                    best = int(p.argmax())
                    names.append(net.langs[best] if p[best] > 0 else "und")
                    scores.append(float(min(1.0, p[best])))
                a = b
            yield batch.append_column("lang_pred", pa.array(names, pa.string())).append_column("score", pa.array(scores, pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def op8_language(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language, and whether it was held out from learning."""
    docs = table(spark, sf_dir, "documents")
    net = train(docs)
    return predicted(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
