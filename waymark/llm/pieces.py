"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

Encoding. A text gets a leading space, spaces become U+2581, and every way to write it in pieces of the vocabulary
(bytes for characters outside it) is a path of its lattice. No piece has U+2581 after another character, so the lattice
falls into words, each of which is built once for a batch of texts. A piece weighs 1 / (its rank + 50), as in Zipf's
law; a path's probability is its share of the total weight, and each edge's probability given its node follows from
the backward sums.

Sampling. A perturbed A-star search: the whole space has a Gumbel value; the path that attains it is drawn edge by
edge. What is left falls into regions, one for each edge of the path: the paths that agree before that edge and leave
it there. A region's largest Gumbel value is drawn truncated at its parent's; the best region is searched next, which
gives the next path, all distinct, in order of perturbed value. The value after the k-th path is the threshold, from
which each path's inclusion probability follows. Random numbers are hashes of the row's key, the path's number and the
place, so they do not depend on partitioning.

Decoding joins the pieces; it gives back the text exactly, whatever its characters.

Null and empty texts have one path, of no pieces. Texts with fewer paths than asked give those they have, each with
inclusion 1. A null key draws as key -1 does; repeated rows get the same paths. Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES = 2
ZIPF = 50.0
#: Characters of text whose lattices are built together.
BATCH_CHARS = 800_000
SPACE, STAND_IN = "▁", "\udfff"  # no text from Arrow holds a lone surrogate, so it can stand for a literal U+2581
WORDS = re.compile(SPACE + "+[^" + SPACE + "]*")
SLOTS = 19
FIXED = 1 << 32  # log probabilities are summed in these parts


@dataclass
class Vocabulary:
    """Pieces as bytes and log weights, and a trie as one hash table from (node, character) to node."""

    surface: list[bytes]
    weight: np.ndarray
    byte_id: np.ndarray
    letters: np.ndarray  # code point -> character number, 0 unknown
    keys: np.ndarray
    nexts: np.ndarray
    piece_at: np.ndarray  # node -> piece, -1 none
    longest: int
    alphabet: int

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        surface, byte_id, plain = [b""] * n, np.zeros(256, np.int64), []
        for i, name in enumerate(names):
            if m.is_byte(i):
                byte_id[int(name[3:5], 16)] = i
                surface[i] = bytes([int(name[3:5], 16)])
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                surface[i] = name.replace(SPACE, " ").encode()
                plain.append(i)
        weight = np.full(n, -np.log(n + ZIPF))
        weight[plain] = -np.log(np.arange(1, len(plain) + 1) + ZIPF)
        letters = np.zeros(0x110000, np.int32)
        for c in sorted({c for i in plain for c in names[i]}):
            letters[ord(c)] = letters.max() + 1
        size = int(letters.max()) + 1
        trie: dict[int, int] = {}
        ends: dict[int, int] = {}
        for i in plain:
            node = 0
            for c in names[i]:
                node = trie.setdefault(node * size + int(letters[ord(c)]), len(trie) + 1)
            ends[node] = i
        keys, nexts = np.full(1 << SLOTS, -1, np.int64), np.zeros(1 << SLOTS, np.int32)
        flat = np.array(list(trie.items()), np.int64)
        for (key, to), slot in zip(flat.tolist(), _slot(flat[:, 0]).tolist()):
            while keys[slot] >= 0:
                slot = (slot + 1) & ((1 << SLOTS) - 1)
            keys[slot], nexts[slot] = key, to
        piece_at = np.full(len(trie) + 1, -1, np.int32)
        piece_at[list(ends)] = list(ends.values())
        return cls(surface, weight, byte_id, letters, keys, nexts, piece_at, max(len(names[i]) for i in plain), size)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The next trie node of each, -1 if there is none."""
        key = node * self.alphabet + letter
        slot, out, open_ = _slot(key), np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(open_):
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.nexts[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << SLOTS) - 1)
        return out


def _slot(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def _mix(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit counters."""
    with np.errstate(over="ignore"):
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


class Lattice:
    """The lattices of some words; edges of one node lie together."""

    def __init__(self, v: Vocabulary, words: list[str]):
        self.v = v
        size = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = v.letters[points]
        of = np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size)
        self.first = ends - size + np.arange(len(words))  # start node of each word; each has one node more than letters
        self.last = ends + np.arange(len(words))
        stop = ends[of]
        here, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        starts, lengths, ids = [], [], []
        single = np.zeros(len(points), bool)
        for d in range(v.longest):
            node = v.step(node, letter[here + d].astype(np.int64))
            alive = node >= 0
            here, node = here[alive], node[alive]
            piece = v.piece_at[node]
            good = piece >= 0
            starts.append(here[good])
            lengths.append(np.full(len(starts[-1]), d + 1))
            ids.append(piece[good])
            if d == 0:
                single[starts[-1]] = True
            alive = here + d + 1 < stop[here]
            here, node = here[alive], node[alive]
            if not len(here):
                break
        odd = np.flatnonzero(~single)
        self.points = points
        starts.append(odd)
        lengths.append(np.ones(len(odd), np.int64))
        ids.append(np.full(len(odd), -1))
        # within a node the longest piece first: it is mostly the likeliest, so draws end early
        start, length, piece = (np.concatenate(x[::-1]) for x in (starts, lengths, ids))
        order = np.argsort(start, kind="stable")
        start, length, piece = start[order], length[order], piece[order]
        at = points[start]
        n_bytes = 1 + (at >= 0x80) + (at >= 0x800) + (at >= 0x10000)
        w = np.where(piece >= 0, v.weight[piece], n_bytes * v.weight[v.byte_id[0]])
        n_nodes = len(points) + len(words)
        self.piece, self.char = piece, start
        self.node = start + of[start]
        self.to = self.node + length
        self.ptr = np.searchsorted(self.node, np.arange(n_nodes + 1))
        self.count = np.diff(self.ptr)
        # backward sums, by distance from the word's end
        beta = np.zeros(n_nodes)
        far = np.zeros(n_nodes, np.int64)
        nodes = np.arange(len(points)) + of
        far[nodes] = stop - np.arange(len(points))
        by = nodes[np.argsort(far[nodes], kind="stable")]
        cut = np.searchsorted(far[by], np.arange(1, (int(size.max()) if len(size) else 0) + 2))
        for a, b in zip(cut, cut[1:]):
            own = by[a:b]
            count = self.count[own]
            base = np.cumsum(count) - count
            e = np.arange(count.sum()) + np.repeat(self.ptr[own] - base, count)
            val = w[e] + beta[self.to[e]]
            top = np.maximum.reduceat(val, base)
            beta[own] = top + np.log(np.add.reduceat(np.exp(val - np.repeat(top, count)), base))
        self.p = np.minimum(np.exp(w + beta[self.to] - beta[self.node]), 1.0)
        self.logp = w + beta[self.to] - beta[self.node]
        # sums in whole numbers, so that they do not depend on what else is in the batch
        part = np.rint(self.p * (1 << 40)).astype(np.int64)
        total = np.cumsum(part)
        self.upto = (total - (total - part)[self.ptr[self.node]]) / (1 << 40)

    def walk(self, node: np.ndarray, last: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges of one drawn path for each (node, last), one after the other, and whose they are; seed (uint64) is each walk's own."""
        active, step, who, edges = np.flatnonzero(node < last), 0, [], []
        at, last, seed = node[active], last[active], seed[active]
        while len(active):
            with np.errstate(over="ignore"):
                u = _mix(seed + np.uint64(step))
            e = self.ptr[at]
            stop = self.ptr[at + 1] - 1
            rest = np.flatnonzero((self.upto[e] < u) & (e < stop))
            while len(rest):
                e[rest] += 1
                rest = rest[(self.upto[e[rest]] < u[rest]) & (e[rest] < stop[rest])]
            who.append(active)
            edges.append(e)
            at = self.to[e]
            go = np.flatnonzero(at < last)
            active, at, last, seed = active[go], at[go], last[go], seed[go]
            step += 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(who)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(edges)[order], owner[order]

    def ids(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of the edges, and where each edge's begin (one entry more than edges)."""
        out = self.piece[path]
        odd = np.flatnonzero(out < 0)
        at = np.arange(len(path) + 1)
        if len(odd):
            x = self.points[self.char[path[odd]]]
            plain = x < 0x80
            out[odd[plain]] = self.v.byte_id[x[plain]]
            odd, x = odd[~plain], x[~plain]
            if len(odd):
                raw = [list((SPACE if c == ord(STAND_IN) else chr(c)).encode("utf-8")) for c in x.tolist()]
                count = np.ones(len(path), np.int64)
                count[odd] = list(map(len, raw))
                at = np.concatenate(([0], np.cumsum(count)))
                out = np.repeat(out, count)
                for o, r in zip(at[odd].tolist(), raw):
                    out[o : o + len(r)] = self.v.byte_id[r]
        return out, at


def _truncated(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Largest Gumbel values of regions of these log masses, given that they lie under bound."""
    with np.errstate(divide="ignore"):
        return mass - np.log(np.exp(np.minimum(mass - bound, 700)) - np.log(u))


class Search:
    """The search for several texts at once: words (n) of texts, whose word runs begin at `begin`; one key for each text."""

    def __init__(self, lattice: Lattice, words: np.ndarray, count: np.ndarray, keys: np.ndarray):
        self.lattice, self.words, self.n = lattice, words, len(count)
        self.text = np.repeat(np.arange(self.n), count)  # of each word
        self.place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
        with np.errstate(over="ignore"):
            self.seed = keys.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
        self.samples: list[dict] = []
        self.left: dict[tuple[int, int, int], set[int]] = {}

    def _seeds(self, n: int, text: np.ndarray, place: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self.seed[text] + np.uint64(n * 0x632BE59BD9B4E019 & (1 << 64) - 1) + place.astype(np.uint64) * np.uint64(1 << 20)

    def _add(self, path: np.ndarray, word: np.ndarray, value: np.ndarray, live: np.ndarray, after: np.ndarray) -> None:
        """A path for each text in live; regions exist after the edge number `after` of each, those before are the parent's."""
        lat, k = self.lattice, len(self.samples)
        text = self.text[word]
        begin = np.searchsorted(text, np.arange(self.n + 1))
        pos = np.arange(len(path)) - begin[text]
        p, logp = lat.p[path], lat.logp[path]
        total = np.concatenate(([0], np.cumsum(np.rint(logp * FIXED).astype(np.int64))))
        bound = np.full(len(path), -np.inf)
        own = np.flatnonzero((p < 1 - 1e-12) & (pos > after[text]))
        u = _mix(self._seeds(3 * k + 1, text[own], pos[own]))
        bound[own] = _truncated((total[own] - total[begin[text[own]]]) / FIXED + np.log1p(-p[own]), value[text[own]], u)
        self.samples.append({"path": path, "word": word, "text": text, "begin": begin, "pos": pos, "bound": bound, "taken": {}, "value": value, "live": live, "log_prob": (total[begin[1:]] - total[begin[:-1]]) / FIXED})

    def start(self) -> None:
        lat = self.lattice
        path, word = lat.walk(lat.first[self.words], lat.last[self.words], self._seeds(0, self.text, self.place))
        value = -np.log(-np.log(_mix(self._seeds(2, np.arange(self.n), np.zeros(self.n, np.int64)))))
        self._add(path, word, value, np.ones(self.n, bool), np.full(self.n, -1))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """For each text the largest value of its regions, and the path that the region leaves."""
        tops = []
        for s in self.samples:
            top = np.full(self.n, -np.inf)
            has = np.flatnonzero(np.diff(s["begin"]))
            if len(has):
                top[has] = np.maximum.reduceat(s["bound"], s["begin"][has])
            tops.append(top)
        tops = np.array(tops)
        return tops.max(axis=0), tops.argmax(axis=0)

    def more(self) -> None:
        """One more path for each text that has one."""
        lat, k = self.lattice, len(self.samples)
        value, parent = self.best()
        live = value > -np.inf
        at = np.full(self.n, -1)
        w = np.full(self.n, len(self.words))
        edge = np.full(self.n, -1)
        u = _mix(self._seeds(3 * k + 2, np.arange(self.n), np.full(self.n, 1)))
        u2 = _mix(self._seeds(3 * k + 2, np.arange(self.n), np.full(self.n, 2)))
        for t in np.flatnonzero(live).tolist():
            s = self.samples[parent[t]]
            a, b = s["begin"][t], s["begin"][t + 1]
            j = int(np.argmax(s["bound"][a:b]))
            old = int(s["path"][a + j])
            node = int(lat.node[old])
            out = self.left.setdefault((int(parent[t]), t, j), {old})
            others = [e for e in range(lat.ptr[node], lat.ptr[node + 1]) if e not in out]
            share = np.cumsum(lat.p[others])
            e = others[min(int(np.searchsorted(share, u[t] * share[-1])), len(others) - 1)]
            out.add(e)
            rest = float(sum(lat.p[x] for x in others if x != e))
            before = float(np.rint(lat.logp[s["path"][a : a + j]] * FIXED).sum()) / FIXED
            s["bound"][a + j] = _truncated(np.array([before + np.log(rest)]), value[t], u2[t : t + 1])[0] if rest > 1e-12 else -np.inf
            at[t], w[t], edge[t] = j, s["word"][a + j], e
        tail = np.flatnonzero(live[self.text] & (np.arange(len(self.words)) >= w[self.text]))
        starts = lat.first[self.words[tail]]
        split = np.flatnonzero(tail == w[self.text[tail]])
        starts[split] = lat.to[edge[self.text[tail[split]]]]
        path, who = lat.walk(starts, lat.last[self.words[tail]], self._seeds(3 * k, self.text[tail], self.place[tail]))
        parts = [(edge[live], w[live], np.flatnonzero(live) * 3 + 1), (path, tail[who], self.text[tail[who]] * 3 + 2)]
        for i, s in enumerate(self.samples):
            head = np.flatnonzero(live[s["text"]] & (parent[s["text"]] == i) & (s["pos"] < at[s["text"]]))
            parts.append((s["path"][head], s["word"][head], s["text"][head] * 3))
        path, word, key = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key, kind="stable")
        self._add(path[order], word[order], value, live, at)


def encode(v: Vocabulary, texts: list[str | None], keys: list[int], k: int = SAMPLES) -> list[list[tuple]]:
    """For each text its paths: (ids, log probability, perturbed value, inclusion probability)."""
    out: list[list[tuple]] = []
    a = 0
    while a < len(texts):
        b, total = a, 0
        seen: dict[str, int] = {}
        of: list[int] = []
        count = []
        while b < len(texts) and (b == a or total < BATCH_CHARS):
            t = texts[b]
            words = WORDS.findall(SPACE + t.replace(SPACE, STAND_IN).replace(" ", SPACE)) if t else []
            of += [seen.setdefault(w, len(seen)) for w in words]
            count.append(len(words))
            total += len(t or "")
            b += 1
        lattice = Lattice(v, list(seen))
        found = Search(lattice, np.array(of, np.int64), np.array(count, np.int64), np.array(keys[a:b], np.int64))
        found.start()
        for _ in range(k - 1):
            found.more()
        after = found.best()[0]
        ids = [lattice.ids(s["path"]) for s in found.samples]
        for t, n in enumerate(count):
            if not n:
                out.append([(np.zeros(0, np.int64), 0.0, 0.0, 1.0)])
                continue
            own = []
            for s, (flat, at) in zip(found.samples, ids):
                if s["live"][t]:
                    lp = float(s["log_prob"][t])
                    chance = 1.0 if after[t] == -np.inf else float(-np.expm1(-np.exp(min(700.0, lp - after[t]))))
                    own.append((flat[at[s["begin"][t]] : at[s["begin"][t + 1]]], lp, float(s["value"][t]), chance))
            out.append(own)
        a = b
    return out


def decode(v: Vocabulary, ids) -> str:
    return b"".join([v.surface[i] for i in ids])[1:].decode("utf-8")


def sampled(spark, docs: DataFrame, k: int = SAMPLES, model: str = MODEL) -> DataFrame:
    """(doc_id, rank, ids, log_prob, value, inclusion, round_trip) for each sampled path of each row of docs(doc_id, text)."""
    shipped = spark.sparkContext.broadcast(Vocabulary.load(model))
    names = ["doc_id", "rank", "ids", "log_prob", "value", "inclusion", "round_trip"]

    def run(batches):
        v = shipped.value
        for batch in batches:
            n = batch.num_rows
            for a in range(0, n, 256):
                part = batch.slice(a, 256)
                docs_, texts = part.column("doc_id"), [t.as_py() for t in part.column("text")]
                made = encode(v, texts, [-1 if d.as_py() is None else d.as_py() for d in docs_], k)
                count = [len(m) for m in made]
                flat = [x for m in made for x in m]
                size = np.cumsum([0] + [len(x[0]) for x in flat])
                ids = pa.ListArray.from_arrays(pa.array(size, pa.int32()), pa.array(np.concatenate([x[0] for x in flat]).astype(np.int32)))
                same = [decode(v, x[0].tolist()) == (t or "") for t, m in zip(texts, made) for x in m]
                yield pa.RecordBatch.from_arrays(
                    [docs_.take(pa.array(np.repeat(np.arange(len(texts)), count))), pa.array([r + 1 for m in made for r in range(len(m))], pa.int32()), ids, *(pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3)), pa.array(same)],
                    names,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, rank int, ids array<int>, log_prob double, value double, inclusion double, round_trip boolean")


def op7_pieces(spark, sf_dir: str) -> DataFrame:
    """Every document's sampled segmentations: their size and digest, probabilities, and whether they decode to the text."""
    out = sampled(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "rank", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "value", "inclusion", "round_trip")
