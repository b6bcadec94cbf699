import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.llm import linededup, mixing, simhash
from waymark.llm.common import Scratch, components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, fp string"


def docs_of(spark, texts, sources=None):
    rows = [(i if i % 7 else (None if i == 7 else i), t, "en", (sources or ["a", "b", None])[i % 3], None, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def texts(n=60, seed=1):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and anne bole cot dint élan fjord".split())
    base = [" ".join(word() for _ in range(rng.randint(1, 14))) for _ in range(12)]
    made = ["\n".join(rng.choice(base + ["", "  "]) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return [*made, None, "", " \n\t", made[0], made[0], "one", "x" * 50_000, "a b c " * 5_000]


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(20)] + [(3, 3)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        up[b] = a
    got = {r.id: r.root for r in components(Scratch(spark), spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in up}


def test_components_of_nothing(spark):
    assert components(Scratch(spark), spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block", [512, 3])
def test_simhash_links_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    near = [int(b) ^ sum(1 << int(x) for x in set(rng.integers(0, 62, rng.integers(0, 4)).tolist())) for b in base for _ in range(6)]
    fps = np.array(sorted({*map(int, base), *near, 0, -1}), dtype=np.int64)
    scratch = Scratch(spark)
    edges = simhash.links(scratch, spark.createDataFrame([(int(x),) for x in fps], "fp long"), block)
    got = {r.id: r.root for r in components(scratch, edges).collect()}
    u = fps.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None]) <= 3
    label = fps.copy()
    while True:
        new = np.where(near, label[None], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            break
        label = new
    assert {int(f): got.get(int(f), int(f)) for f in fps} == dict(zip(fps.tolist(), label.tolist()))


def test_fingerprint_against_a_plain_version():
    def plain(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        runs = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if runs else 0

    for text in ("", "A", "A b", "Über den ÄPFELN die Nacht", "a b c a b c a b c d", "x\u00a0y Z\tq\nw", *filter(None, texts(20))):
        assert simhash.fingerprint(text) == plain(text), text


def test_simhash_rows_and_stage(spark):
    docs = docs_of(spark, texts())
    out = simhash.deduplicated(spark, docs)
    assert out.columns == docs.columns
    rows = Scratch(spark).write(simhash.with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    named = simhash.near_duplicates(Scratch(spark), rows).collect()
    assert len(named) == docs.count()
    assert out.count() == len({r.component_id for r in named})
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    none = docs.limit(0)
    assert simhash.deduplicated(spark, none).count() == 0


def brute_lines(rows, least):
    """rows in order: for every run of lines with enough words that has an earlier copy, its lines."""
    seqs = [[(i, x.strip().encode().strip(), len(x.encode().split())) for i, x in enumerate((t or "").split("\n")) if x.encode().split()] for t in rows]
    seen, gone = set(), [set() for _ in rows]
    places = sorted((d, s) for d, q in enumerate(seqs) for s in range(len(q)))
    for d, s in places:
        q = seqs[d]
        for e in range(s + 1, min(len(q), s + 60) + 1):
            if sum(n for _, _, n in q[s:e]) < least:
                continue
            run = tuple(x for _, x, _ in q[s:e])
            if run in seen:
                gone[d] |= {i for i, _, _ in q[s:e]}
            seen.add(run)
    return gone


def test_line_dedup_against_brute_force(spark):
    made = [t for t in texts(40, 9)]
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(made)], "doc_id long, text string, __extra string").withColumnRenamed("__extra", "row")
    got = {r.doc_id: r for r in linededup.deduplicated(spark, docs).collect()}
    gone = brute_lines(made, linededup.MIN_WORDS)
    assert any(gone)
    for i, t in enumerate(made):
        want = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i])
        assert (got[i].text, got[i].n_removed, got[i].row) == (want, len(gone[i]), "e"), i


def test_line_dedup_odd_rows(spark):
    docs = docs_of(spark, [None, "", "one two three four five six seven eight nine ten"] * 5)
    out = linededup.deduplicated(spark, docs).collect()
    assert sorted((r.text is None, r.text, r.n_removed) for r in out if r.text) == [(False, "one two three four five six seven eight nine ten", 0)]
    assert sum(r.n_removed for r in out) == 4 and len(out) == 15
    assert linededup.deduplicated(spark, docs.limit(0)).count() == 0


def long_runs(seed):
    """Documents that share runs of 1 to 60 lines at odd places, with repeated lines, near copies and whole copies."""
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("alp bole cot dint fjord gorge".split()) for _ in range(rng.choice([1, 1, 2, 3, 11])))
    runs = [[line() for _ in range(rng.randint(1, 60))] for _ in range(8)]
    made = []
    for _ in range(40):
        parts = [line() for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            run = rng.choice(runs)
            at = rng.randrange(len(run))
            parts += run[at : at + rng.randint(1, 60)] + [f"own {rng.random()}"] * rng.randint(0, 1)
        made.append("\n".join(parts))
    near = made[3].split("\n")
    near[len(near) // 2] = "changed here"
    return [*made, made[3], "\n".join(near), made[5], "x\n" * 40, "x\n" * 55]


@pytest.mark.parametrize("seed", [1, 2])
def test_line_runs_of_all_lengths_against_brute_force(spark, seed):
    made = long_runs(seed)
    docs = spark.createDataFrame([(len(made) - i, t, "m") for i, t in enumerate(made)], "doc_id long, text string, __mine string")
    got = {r.doc_id: r for r in linededup.deduplicated(spark, docs).collect()}
    gone = brute_lines(made[::-1], linededup.MIN_WORDS)[::-1]
    assert sum(map(len, gone)) > 200
    for i, t in enumerate(made):
        assert got[len(made) - i].text == "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone[i]), i
        assert got[len(made) - i]["__mine"] == "m"


def test_ranks_are_those_of_the_suffix_array(spark):
    made = [t for t in long_runs(3) if t][:25]
    scratch = Scratch(spark)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(made)], "row long, doc_id long, text string")
    every = scratch.write(docs.mapInArrow(linededup._lines, linededup.LINES)).cache()
    ids = {r.row: list(zip(r.a, r.b)) for r in every.collect()}
    every_suffix = sorted((tuple(x[i:]), row, i) for row, x in ids.items() for i in range(len(x)))
    rank, at = {}, {}
    for n, (x, row, i) in enumerate(every_suffix):
        at.setdefault(x, n)
        rank[row, i] = at[x]
    lines, final = linededup.ranks(scratch, every.select("row", "a", "b"), 4)
    got = {(r.row, r.i): r["rank"] for r in final.collect()}
    firsts = [x[0] for x, _, _ in every_suffix]
    shared = {x for x in firsts if firsts.count(x) > 1}
    assert got == {(row, i): rank[row, i] for x, row, i in every_suffix if x[0] in shared}


def mix(spark, docs, tmp):
    docs.write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    return mixing.op10_mix_sources(spark, str(tmp)).toPandas()


def test_mixing_against_sql_and_targets(spark, tmp_path):
    rng = random.Random(2)
    made = [" ".join("w" for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "\x0b  "]
    docs = docs_of(spark, made, ["a", "a", None])
    got = mix(spark, docs, tmp_path)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(mixing.SQL).df()
    name = lambda x: None if pd.isna(x) else x
    key = lambda d: sorted(repr((None if pd.isna(r.doc_id) else int(r.doc_id), int(r.size_), int(r.source_size), round(float(r.target), 6), int(r.taken), name(r.source))) for r in d.rename(columns={"size": "size_"}).itertuples())
    assert key(got) == key(want)
    for _, own in got.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max()
    assert (got["taken"] <= 3 * got["size"]).all()


def test_mixing_caps_small_sources(spark, tmp_path):
    made = ["a b c"] * 3 + ["w " * 1000] * 6
    docs = spark.createDataFrame([(i, t, "small" if i < 3 else "tall") for i, t in enumerate(made)], "doc_id long, text string, source string")
    got = mix(spark, docs, tmp_path)
    assert set(got[got.source == "small"]["target"]) == {27.0} and set(got[got.source == "small"]["taken"]) == {9}
    assert set(got[got.source == "tall"]["target"]) == {5982.0}


def test_mixed_stage_repeats_documents(spark):
    docs = docs_of(spark, ["a b c"] * 3 + ["w " * 1000] * 6 + [None, ""], ["a", "b", None])
    out = mixing.mixed(spark, docs)
    assert out.columns == docs.columns
    assert out.where("text is null").count() == 1
    assert mixing.mixed(spark, docs.limit(0)).count() == 0
    assert out.withColumn("n", F.lit(1)).count() > 0
