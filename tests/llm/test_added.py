"""Conversation repair, byte-level BPE and hard negatives, against plain versions, the library's encoding and SQL."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import functions as F

from waymark.llm import bytebpe, dialogs, negatives
from waymark.llm.common import Scratch

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"


# conversation repair


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(conv, turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    return out


def plain_repair(rows):
    """The best of all edits by (cost, audit), as a search over a heap."""
    seen, faults = set(), []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()), out
        name = "assistant" if state == "u" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, name[0], (*out, f"{name}:")))
        if i < len(rows):
            _, role, text = rows[i]
            more = faults[i] == "truncated"
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, name[0], (*out, f"{name}:{text}")))
                if role[:1] == name[0] or (not state and role[:1] == "s"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def in_order(rows):
    """Conversations by id, their rows by turn (nulls first), role, digest of the text."""
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest())):
        by.setdefault(conv, []).append((turn, role, text))
    return by


def test_repair_of_all_conversations(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in dialogs.op11_conversation_repair(spark, SF).select("conv_id", *REPORT).collect()}
    want = in_order(plain_damage(rows))
    assert got == {conv: plain_repair(want.get(conv, []))[0] for conv in {r[0] for r in rows}}


@pytest.mark.parametrize("bits", [2, 13])
def test_repair_of_odd_rows_and_cut_conversations(spark, monkeypatch, bits):
    monkeypatch.setattr(dialogs, "BITS", bits)
    rng = random.Random(bits)
    roles, texts = ["user", "assistant", "system", "", "ux", "tool"], ["Yes.", "no", "", " \t", "What? ", "Yes.", "a\nb!", "end", *(f"t{i}." for i in range(9))]
    rows = [(rng.choice([1, 1, 1, 2, 3, None, 2**60]), rng.choice([None, *range(40)]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(9, 0, "system", "A."), (9, 1, "user", "B."), (10, 5, "assistant", "Hello."), (11, 1, " ", " ")]
    df = spark.createDataFrame(rows, TURNS).withColumn("rank", F.lit(1))
    repair = dialogs.Repair(Scratch(spark), df)
    want = {conv: plain_repair(own) for conv, own in in_order(rows).items()}
    digests = {r[0]: r[1] for r in repair.digests().collect()}
    got = {r["conv_id"]: (*(r[n] for n in REPORT[:-1]), digests[r["conv_id"]]) for r in repair.reports().collect()}
    assert got == {conv: w[0] for conv, w in want.items()}
    turns = {}
    for r in repair.turns().orderBy("pos", "place").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert turns == {conv: list(w[1]) for conv, w in want.items() if w[1]}


def test_repair_of_conversations_cut_before_their_last_rows(spark, monkeypatch):
    monkeypatch.setattr(dialogs, "BITS", 2)
    rng = random.Random(11)
    rows = [(conv, turn, *(("user", "A.") if turn == 0 else rng.choice([("user", " "), ("user", "A."), ("assistant", "")]))) for conv in range(60) for turn in range(rng.randrange(1, 6))]
    df = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: tuple(r[n] for n in REPORT) for r in dialogs.reported(Scratch(spark), df, df.select("conv_id")).collect()}
    assert got == {conv: plain_repair(own)[0] for conv, own in in_order(rows).items()}


def test_repair_without_rows_and_with_nulls(spark):
    empty = spark.createDataFrame([], TURNS)
    assert dialogs.reported(Scratch(spark), empty, empty.select("conv_id")).count() == 0
    rows = [(1, None, None, None), (1, 2, "user", None), (None, None, "user", "Hi."), (None, 3, "assistant", "Ho.")]
    df = spark.createDataFrame(rows, TURNS)
    got = {r["conv_id"]: r for r in dialogs.reported(Scratch(spark), df, df.select("conv_id")).collect()}
    assert (got[1]["blank"], got[1]["audit"], got[1]["cost"], got[1]["repaired_sha256"]) == (2, "DD", 6, dialogs.EMPTY)
    assert (got[None]["audit"], got[None]["gaps"]) == ("KK", 0)
    gone = dialogs.reported(Scratch(spark), empty, df.select("conv_id")).collect()
    assert {(r["conv_id"], r["cost"], r["audit"], r["repaired_sha256"]) for r in gone} == {(c, 0, "", dialogs.EMPTY) for c in (1, None)}


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.Vocabulary.load()


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def some_texts(rng, n):
    for k in range(n):
        if k % 4 == 0:
            yield "".join(rng.choice("abcdeinrst  '\n") for _ in range(rng.randrange(80)))
        elif k % 4 == 1:
            yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), rng.randrange(0x3000, 0x9FFF), 0x1F600])) for _ in range(rng.randrange(50)))
        elif k % 4 == 2:
            yield rng.choice(["a", "ab", "the", "  ", "-", "=-", "é", "中文", "\x1c ", "\x85"]) * rng.randrange(1, 150)
        else:
            yield " ".join(rng.choice(["The", "don't", "WE'LL", "3.14", "1234567", "naïve", "x\t\ty", "\n\n", "<|endoftext|>"]) for _ in range(rng.randrange(20)))


def test_tokens_are_the_librarys(vocabulary, library):
    for text in some_texts(random.Random(5), 800):
        ids = vocabulary.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert vocabulary.decode(ids).decode() == text
    long = "ab" * 100_000
    assert vocabulary.encode(long) == library.encode_ordinary(long)


def test_a_vocabulary_whose_tokens_do_not_all_merge():
    ranks = {bytes([b]): b for b in range(256)} | {t: 256 + i for i, t in enumerate((b"ab", b"bc", b"abc", b"cd", b"xyz", b"bcd", b"aa", b"aaa", b"caa"))}
    v, library = bytebpe.Vocabulary(ranks), tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    assert v.halves(ranks[b"xyz"]) is None
    for _ in range(3_000):
        text = "".join(rng.choice("abcdxyz ") for _ in range(rng.randrange(14)))
        assert v.encode(text) == library.encode_ordinary(text), text


def test_appends_and_edits_make_few_prefixes_again(vocabulary, library):
    rng = random.Random(8)
    for text in some_texts(rng, 200):
        made = bytebpe.Prefixes(vocabulary, text)
        for _ in range(4):
            at = rng.randrange(len(made.text) + 1)
            made.replace(at, rng.randrange(min(5, len(made.text) - at) + 1), rng.choice(["", " ", "x", "'re", "\n\n", "the quick", "é"]))
            assert made.ids() == library.encode_ordinary(made.text)
        for more in ("e", "ll", " ", "\n", "ing"):
            made.append(more)
            assert made.ids() == library.encode_ordinary(made.text)
    made = bytebpe.Prefixes(vocabulary, "one two three " * 2_000)
    made.replace(9_000, 3, "four")
    assert 0 < made.redone < 60
    made.append("more")
    assert 0 < made.redone < 10
    made = bytebpe.Prefixes(vocabulary, "a" * 5_000)
    made.append("b")
    assert made.redone == 1


def test_bpe_over_tables(spark, vocabulary, library):
    texts = ["Hello there", None, "", "Hello there", "naïve 中文 \U0001f600" * 500]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = bytebpe.encoded(df)
    assert out.columns == ["doc_id", "text", "ids", "ids_"]
    rows = {r["doc_id"]: r for r in bytebpe.decoded(out, ids="ids_").collect()}
    for i, t in enumerate(texts):
        assert rows[i]["ids_"] == library.encode_ordinary(t or "") and bytes(rows[i]["bytes"]).decode() == (t or "")
    held = bytebpe.prefixed(df.drop("ids"))
    changed = held.withColumns({"at": F.when(F.col("doc_id") == 0, 5), "cut": F.when(F.col("doc_id") == 0, 1), "put": F.lit(" again")})
    for r in bytebpe.edited(changed).collect():
        want = "Hello againthere" if r["doc_id"] == 0 else (r["text"] or "") + " again"
        assert r["new_text"] == want and r["new_ids"] == library.encode_ordinary(want)
    assert bytebpe.encoded(df.limit(0)).count() == 0


def test_bpe_words_are_written_once_and_again_when_the_table_is_full(vocabulary, library, monkeypatch):
    texts = list(some_texts(random.Random(12), 60)) + ["", "a" * 200, "na\u00efve \u4e2d\u6587 " * 40]
    for kept in (bytebpe.KEPT, 5):
        monkeypatch.setattr(bytebpe, "KEPT", kept)
        v = bytebpe.Vocabulary(vocabulary.ranks, vocabulary.pattern)
        for text in texts + texts:
            ids = library.encode_ordinary(text)
            assert v.written(text) == (len(ids), ",".join(map(str, ids)).encode(), text.encode())
        assert len(v._written) <= kept


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in bytebpe.op12_byte_bpe(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        text, ids = r["text"] or "", library.encode_ordinary(r["text"] or "")
        assert got[r["doc_id"]]["n_tokens"] == len(ids)
        assert got[r["doc_id"]]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r["doc_id"]]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


# hard negatives


def test_hard_negatives_are_those_of_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = negatives.op13_hard_negatives(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(negatives.SQL).fetchall())
    assert con.sql(negatives.SQL).columns == got.columns


def test_windows_are_whole_with_small_rounds_copies_and_odd_rows(spark, monkeypatch):
    for name, value in (("FIRST", 16), ("BLOCK", 64), ("PART", 3), ("PER_CELL", 12), ("SAMPLE", 200)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 6)) + 3 * rng.normal(size=(12, 6))[rng.integers(0, 12, 900)]
    x[300:600] = x[0]  # a third are copies
    x[600:700] *= 0.0
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None, [1.0] * 6), (1001, 1, None), (1002, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1003, 2, [float("nan")] * 6), (1004, 2, [float("inf")] * 6), (1005, 2, []), (None, 1, [1.0] * 6)]
    rows += [(1100, 1, [0.5, 1.0]), (1101, 1, [0.5, 0.9]), (1102, 2, [0.4, 0.9]), (1103, 3, [0.0, 0.0])] + rows[:30]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("dim", F.lit("clash"))
    con = duckdb.connect()
    embeddings = df.drop("dim").toArrow()  # noqa: F841  read by name
    con.sql("create table embeddings as from embeddings")
    want = sorted(con.sql(negatives.SQL).fetchall())
    assert len(want) > 50
    assert sorted(map(tuple, negatives.hard_negatives(Scratch(spark), df.drop("dim")).collect())) == want


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    kind = "vec_id long, label int, embedding array<double>"
    assert negatives.hard_negatives(Scratch(spark), spark.createDataFrame([], kind)).count() == 0
    with pytest.raises(ValueError, match="53 bits"):
        negatives.hard_negatives(Scratch(spark), spark.createDataFrame([(0, 1, [1e9, 1.0])], kind))


def test_cells_come_by_falling_sums():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = list(negatives.visits(a, b))
    assert len({(i, j) for i, j, _ in got}) == 35
    assert [s for _, _, s in got] == sorted((a[:, None] + b[None]).ravel().tolist(), reverse=True)
