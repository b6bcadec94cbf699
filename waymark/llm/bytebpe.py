"""Byte-level BPE by dynamic programming over byte prefixes.

The merges of a byte string's prefix end in one token, and an encoding is right exactly if each two neighbouring tokens
are the merges of their own bytes. So for each prefix one last token is stored: the only token that ends there, is
itself what its bytes merge to, and may follow the last token of the prefix that it leaves. Encoding follows last
tokens from the end. Each match of the vocabulary's pattern is encoded apart; a match that is itself in the vocabulary
is that one token.

Two tokens may not meet if a merge across their border comes before the merges inside them: the parts at the border
live from the merge that makes them to the merge that takes them up, and of equal ranks the left one merges first.

Stored prefixes make edits cheap: bytes that are appended only add prefixes, and after an edit prefixes are made again
from the match before it until an old match border is met; what follows a border doesn't depend on what precedes it.

A null text is an empty one; an empty text has no tokens. Texts may be of any length; a match takes time in proportion
to its bytes. Repeated rows give repeated rows; extra columns pass through.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import spare, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Entries of a task's tables of words and of token pairs; a full table starts again.
KEPT = 300_000
#: Matches up to so many bytes are looked up before they are encoded.
SHORT = 48
NEVER = 1 << 60


class Written(dict):
    """A word's number of tokens, these in decimal, and the bytes that they decode to; made when first asked for."""

    def __init__(self, v: Vocabulary):
        self.v = v

    def __missing__(self, match: str) -> tuple[int, bytes, bytes]:
        v = self.v
        piece = match.encode()
        ids = v.followed(piece, [] if piece in v.ranks else v.prefixes(piece, []))
        found = len(ids), ",".join(map(str, ids)).encode(), v.decode(ids)
        if len(piece) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[match] = found
        return found


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self.matches = regex.compile(pattern)
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.steps, self.falls, self.found = self._automaton(ranks)
        self.longest = max(map(len, ranks), default=0)
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._borders: dict[tuple[int, bool], list[tuple[bytes, int]]] = {}
        # for each token whether it may follow another; what each state's tokens need at hand; states reached by falling
        self._meets: dict[int, dict[int, bool]] = {token: {} for token in self.bytes}
        self._n_meets = 0
        self._ends = [tuple((size, token, self._meets[token]) for size, token in tokens) for tokens in self.found]
        self._past: list[dict[int, int]] = [dict(to) for to in self.steps]
        self._words: dict[str, tuple] = {}
        self._written = Written(self)

    @staticmethod
    def _automaton(ranks: dict[bytes, int]) -> tuple[list[dict[int, int]], list[int], list[tuple[tuple[int, int], ...]]]:
        """States are beginnings of tokens, the longest that the bytes so far end in: the next states by byte, the state
        to fall back to, and the tokens (length, rank) that end here, the longest first."""
        steps, falls, found = [{}], [0], [()]
        for token, rank in ranks.items():
            at = 0
            for byte in token:
                at = steps[at].setdefault(byte, len(steps))
                if at == len(steps):
                    steps.append({})
                    falls.append(0)
                    found.append(())
            found[at] = ((len(token), rank),)
        level = list(steps[0].values())
        while level:
            below = []
            for at in level:
                found[at] += found[falls[at]]
                for byte, to in steps[at].items():
                    back = falls[at]
                    while back and byte not in steps[back]:
                        back = falls[back]
                    falls[to] = steps[back].get(byte, 0)
                    below.append(to)
            level = below
        return steps, falls, found

    @classmethod
    def load(cls, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}, pattern)

    def __reduce__(self):
        return Vocabulary, (self.ranks, self.pattern)

    def merged(self, piece: bytes, below: int = NEVER) -> list[bytes]:
        """piece by merges of rank under `below`, always the lowest one first and of equal ones the left one."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            rank, at = min(((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(NEVER, 0))
            if rank >= below:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def halves(self, token: int) -> tuple[int, int] | None:
        """What a token is merged from; itself twice for a byte, None if its bytes never merge to it."""
        if token not in self._halves:
            raw = self.bytes[token]
            parts = [raw, raw] if len(raw) == 1 else self.merged(raw, token)
            self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def border(self, token: int, last: bool) -> list[tuple[bytes, int]]:
        """The parts that are a token's last (or first) one in turn, from a byte on, each with the rank of the merge that ends it."""
        key = (token, last)
        if key not in self._borders:
            parts, ends = [], NEVER
            while True:
                parts.append((self.bytes[token], ends))
                if len(self.bytes[token]) == 1:
                    break
                token, ends = self.halves(token)[last], token
            self._borders[key] = parts[::-1]
        return self._borders[key]

    def meets(self, a: int, b: int) -> bool:
        """Whether b may follow a: the bytes of both merge to a and b."""
        found = self.halves(b) is not None
        if found:
            left, right = self.border(a, True), self.border(b, False)
            i = j = 0
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.ranks.get(x + y, NEVER)
                found = across == NEVER or across >= x_ends or across > y_ends
                if not found or x_ends == y_ends == NEVER:
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
        if self._n_meets >= KEPT:
            for met in self._meets.values():
                met.clear()
            self._n_meets = 0
        self._meets[b][a] = found
        self._n_meets += 1
        return found

    def prefixes(self, piece: bytes, last: list[int]) -> list[int]:
        """last, the tokens that end the first prefixes of piece (from the prefix of one byte on), with those of the others."""
        steps, ends = self.steps, self._ends
        begin, at, past = len(last), 0, self._past
        for end, byte in enumerate(piece[max(0, begin - self.longest) :], max(0, begin - self.longest)):
            to = past[at].get(byte)
            if to is None:
                to = at
                while to and byte not in steps[to]:
                    to = self.falls[to]
                to = past[at][byte] = steps[to].get(byte, 0)
            at = to
            if end < begin:
                continue
            for size, token, meets in ends[at]:
                if size <= end:
                    before = last[end - size]
                    right = meets.get(before)
                    if right is None:
                        right = self.meets(before, token)
                else:
                    right = self.halves(token) is not None
                if right:
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends the first {end + 1} bytes of {piece[: end + 1][-40:]!r}")
        return last

    def followed(self, piece: bytes, last: list[int]) -> list[int]:
        """The tokens of a match, by its prefixes' last tokens."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        out, end = [], len(piece)
        while end:
            out.append(last[end - 1])
            end -= len(self.bytes[out[-1]])
        return out[::-1]

    def word(self, match: str) -> tuple[int, ...]:
        found = self._words.get(match)
        if found is None:
            piece = match.encode()
            found = tuple(self.followed(piece, [] if piece in self.ranks else self.prefixes(piece, [])))
            if len(piece) <= SHORT:
                if len(self._words) >= KEPT:
                    self._words.clear()
                self._words[match] = found
        return found

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.word, self.matches.findall(text))))

    def written(self, text: str) -> tuple[int, bytes, bytes]:
        """How many tokens a text has, the tokens in decimal, joined by commas, and the bytes that they decode to. Words come
        again and again, so that a word's tokens are written and decoded once, as long as the table holds them."""
        told = list(map(self._written.__getitem__, self.matches.findall(text)))
        return sum(w[0] for w in told), b",".join([w[1] for w in told]), b"".join([w[2] for w in told])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Prefixes:
    """A text with the borders of its matches (in code points) and, for each match, its prefixes' last tokens."""

    def __init__(self, v: Vocabulary, text: str, ends: list[int] | None = None, last: list[list[int]] | None = None):
        self.v, self.text, self.ends, self.last = v, text, ends or [], last or []
        self.redone = 0  # prefixes that the last change made
        if ends is None:
            self.replace(0, 0, "")

    def replace(self, at: int, cut: int, put: str) -> None:
        """Puts `put` in place of `cut` code points from `at` on."""
        old_text, old_ends, old_last = self.text, self.ends, self.last
        self.text = old_text[:at] + put + old_text[at + cut :]
        # a match looks at most two code points beyond its end (a contraction, the end of white space)
        stays = bisect.bisect_right(old_ends, at - 3) if old_ends else 0
        begin, moved = (old_ends[stays - 1] if stays else 0), len(put) - cut
        self.ends, self.last, self.redone = old_ends[:stays], old_last[:stays], 0
        known = {end: i for i, end in enumerate(old_ends) if i >= stays}
        for m in self.v.matches.finditer(self.text, begin):
            if m.start() >= at + len(put) and (i := known.get(m.start() - moved)) is not None:
                self.ends += [e + moved for e in old_ends[i + 1 :]]
                self.last += old_last[i + 1 :]
                return
            piece = m[0].encode()
            # a match that begins where an old one did shares its prefixes up to the first other byte
            kept, i = [], bisect.bisect_right(old_ends, m.start())
            if m.start() <= at and i < len(old_ends) and (old_ends[i - 1] if i else 0) == m.start():
                was = old_text[m.start() : old_ends[i]].encode()
                same = next((k for k, (x, y) in enumerate(zip(piece, was)) if x != y), min(len(piece), len(was)))
                kept = old_last[i][:same]
            self.redone += len(piece) - len(kept)
            self.ends.append(m.end())
            self.last.append(self.v.prefixes(piece, list(kept)))

    def append(self, more: str) -> None:
        self.replace(len(self.text), 0, more)

    def ids(self) -> list[int]:
        begins = [0, *self.ends]
        return [t for a, b, last in zip(begins, self.ends, self.last) for t in self.v.followed(self.text[a:b].encode(), last)]


def _vocabulary(spark, path: str, pattern: str):
    return spark.sparkContext.broadcast(Vocabulary.load(path, pattern))  # as large as the vocabulary file


def _more(docs: DataFrame, made: dict[str, T.DataType], of):
    """docs with columns of made, which of(batch, row) gives for each row as a tuple; a name that is taken gets underscores."""
    kinds = dict(zip([spare(docs, n) for n in made], made.values()))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = [of(part, i) for i in range(part.num_rows)]
                for k, (name, kind) in enumerate(kinds.items()):
                    part = part.append_column(name, pa.array([r[k] for r in rows], ARROW[kind.simpleString()]))
                yield part

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())]))


INTS = T.ArrayType(T.IntegerType())
ARROW = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<array<int>>": pa.list_(pa.list_(pa.int32()))}


def encoded(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with ids, the tokens of column text."""
    shipped = _vocabulary(docs.sparkSession, path, pattern)
    return _more(docs, {"ids": INTS}, lambda batch, i: (shipped.value.encode(batch.column("text")[i].as_py() or ""),))


def decoded(docs: DataFrame, path: str = RANKS, ids: str = "ids") -> DataFrame:
    """docs with bytes, what column ids stands for (null for null)."""
    shipped = _vocabulary(docs.sparkSession, path, public_tokenizers.PATTERN)
    return _more(docs, {"bytes": T.BinaryType()}, lambda batch, i: (None if (x := batch.column(ids)[i].as_py()) is None else shipped.value.decode(x),))


def digested(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with n_tokens and the digests of the tokens and of what they decode to; tokens don't leave the task."""
    shipped = _vocabulary(docs.sparkSession, path, pattern)

    def of(batch, i):
        n, ids, raw = shipped.value.written(batch.column("text")[i].as_py() or "")
        return n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()

    return _more(docs, {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}, of)


def prefixed(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs with ends and last: the matches' borders and the last token of every byte prefix in them."""
    shipped = _vocabulary(docs.sparkSession, path, pattern)

    def of(batch, i):
        made = Prefixes(shipped.value, batch.column("text")[i].as_py() or "")
        return made.ends, made.last

    return _more(docs, {"ends": INTS, "last": T.ArrayType(INTS)}, of)


def edited(docs: DataFrame, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs(text, ends, last, at, cut, put) with new_text, new_ends, new_last, new_ids and redone, the prefixes made again.

    A null place is the end of the text, a null cut 0, a null put empty."""
    shipped = _vocabulary(docs.sparkSession, path, pattern)

    def of(batch, i):
        text, ends, last, at, cut, put = (batch.column(c)[i].as_py() for c in ("text", "ends", "last", "at", "cut", "put"))
        made = Prefixes(shipped.value, text or "", ends, last)
        made.replace(len(made.text) if at is None else at, cut or 0, put or "")
        return made.text, made.ends, made.last, made.ids(), made.redone

    return _more(docs, {"new_text": T.StringType(), "new_ends": INTS, "new_last": T.ArrayType(INTS), "new_ids": INTS, "redone": T.LongType()}, of)


def op12_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document's number of tokens and the digests of its tokens and of their bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digested(docs).select(F.col("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
