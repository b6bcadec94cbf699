"""SimHash near-duplicates: segment popcounts, a grid range-join under Manhattan distance, exact verification.

Fingerprint. Words are runs of bytes other than space and 0x09-0x0D after lower-casing A-Z; each three-word shingle,
repeats included, is hashed with XXH64 (seed 42); a bit is set if more than half of the hashes set it.

Embedding. The 64 bits are cut into 32 segments of two bits; a fingerprint becomes its 32 segment popcounts, packed
into one long. The Manhattan distance of two embeddings is at most the Hamming distance of the fingerprints.

Range join. The segments are dealt to six groups. Within Manhattan distance 3 at most three groups differ, so at least
three agree: each fingerprint goes to the 20 grid cells that three groups span, and every linked pair meets in a cell.
Crowded cells are cut by total popcount (a further coordinate, in which linked pairs differ by 3 at most) and into
blocks of bounded size; each pair of blocks is a task row of its own. Pairs whose Manhattan distance over the groups'
bit counts is 3 at most are verified on the fingerprints.
Only a spanning forest of the links in a pair of blocks leaves the task, never all pairs of a group.

Null texts count as empty. Texts without words have fingerprint zero and link like any other. Null doc_ids take part;
a component of null doc_ids only has a null component_id. Repeated rows give repeated rows. An empty table gives none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, components, spare

SEED = 42
GROUPS = 6
DISTANCE = 3
#: Members of a block; a cell with more is cut.
BLOCK = 512


def fingerprint(text: str | None) -> int:
    """The fingerprint as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:-2].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[2:].tolist())), np.uint64, len(starts))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        total += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(len(part), 64).sum(axis=0, dtype=np.int32)
    bits = total * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, column: str = "fp") -> DataFrame:
    """docs with a long column: the fingerprint's 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            made = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
            yield batch.append_column(column, pa.array(made.view(np.int64)))

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())]))


def _masks(groups: int = GROUPS, equal: int = GROUPS - DISTANCE) -> list[int]:
    """For each choice of `equal` groups, the mask over the packed popcounts of their segments, signed."""
    bounds = [round(i * 32 / groups) for i in range(groups + 1)]
    own = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(bounds, bounds[1:])]
    return [(m := sum(c)) - (1 << 64) * (m >> 63) for c in itertools.combinations(own, equal)]


def _counts(fps: np.ndarray) -> np.ndarray:
    """The bit counts of each group of segments."""
    bounds = [2 * round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    return np.stack([np.bitwise_count(fps & np.uint64((1 << b) - (1 << a))) for a, b in zip(bounds, bounds[1:])]).astype(np.int8)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of a link with which of b: exact for those whose Manhattan distance, a lower bound, is within reach."""
    least = sum(np.abs(x[:, None] - y[None, :]) for x, y in zip(_counts(a), _counts(b)))
    near = np.zeros(least.shape, bool)
    i, j = np.nonzero(least <= DISTANCE)
    near[i, j] = np.bitwise_count(a[i] ^ b[j]) <= DISTANCE
    return near


def _forest(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what links within a (b None) or between a and b."""
    same = b is None
    b = a if same else b
    near = _near(a, b)
    if same:
        np.fill_diagonal(near, False)
    rows, cols = near.any(axis=1), near.any(axis=0)
    if not rows.any():
        return a[:0], a[:0]
    ra, cb = np.flatnonzero(rows), np.flatnonzero(cols)
    near, far = near[np.ix_(ra, cb)], np.int64(len(cb))
    label = np.arange(len(cb), dtype=np.int64)
    while True:
        of_row = np.where(near, label[None, :], far).min(axis=1)
        new = np.minimum(label, np.where(near, of_row[:, None], far).min(axis=0))
        if (new == label).all():
            break
        label = new
    u = np.concatenate((a[ra], b[cb]))
    v = np.concatenate((b[cb][of_row], b[cb][label]))
    return u[u != v], v[u != v]


def _verified(batches):
    for batch in batches:
        us, vs = [], []
        for row in batch.column(0):
            sides = [np.asarray(x, np.int64).view(np.uint64) for x in row.as_py()]
            u, v = _forest(sides[0], sides[1] if len(sides) > 1 else None)
            us.append(u.view(np.int64))
            vs.append(v.view(np.int64))
        if us:
            u, v = np.concatenate(us), np.concatenate(vs)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def links(scratch: Scratch, fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) over distinct fingerprints fps(fp) that connect exactly what Hamming links connect."""
    odd = F.lit(0x5555555555555555)
    low, high = F.col("fp").bitwiseAND(odd), F.shiftrightunsigned("fp", 1).bitwiseAND(odd)
    packed = F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))  # low + high in each two bits
    masks = _masks()
    cells = fps.select("fp", F.bit_count("fp").cast("int").alias("ones"), packed.alias("e")).select(
        "fp", "ones", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in masks])).alias("dim", "cell")
    )
    # written out, so that the join has an exchange of its own, whose crowded cells can be split
    crowd = scratch.write(cells.groupBy("dim", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    met = cells.join(crowd.hint("merge"), ["dim", "cell"])
    # a crowded cell: one more grid coordinate (total popcount in steps of four), then blocks within it
    met = met.select("dim", "cell", "fp", "n", F.when(F.col("n") > block, F.shiftright("ones", 2)).otherwise(-1).alias("ones"))
    met = met.withColumn("block", F.when(F.col("n") > block, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / (2 * block)))).otherwise(0).cast("int"))
    blocks = scratch.write(met.groupBy("dim", "cell", "ones", "block").agg(F.collect_list("fp").alias("fps"), F.first("n").alias("n")))
    held = blocks.where((F.col("n") > 1) & ((F.col("n") > block) | (F.size("fps") > 1)))
    alone = held.where(F.col("n") <= block).select(F.array("fps").alias("sides"))
    # in crowded cells each block meets each block at most one step away: both send a copy to the pair's key
    many = held.where(F.col("n") > block).withColumn("nb", F.ceil(F.col("n") / (2 * block)).cast("int"))
    sent = many.select(
        "dim", "cell", "ones", "block", "fps",
        F.explode(F.sequence(F.col("ones") - 1, F.col("ones") + 1)).alias("o2"), "nb",
    ).select("dim", "cell", "ones", "block", "fps", "o2", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("b2"))
    me, other = F.struct("ones", "block"), F.struct(F.col("o2").alias("ones"), F.col("b2").alias("block"))
    paired = (
        sent.select("dim", "cell", F.least(me, other).alias("low"), F.greatest(me, other).alias("high"), "fps")
        .groupBy("dim", "cell", "low", "high")
        .agg(F.collect_list("fps").alias("sides"))
        .where((F.size("sides") == 2) | (F.col("low") == F.col("high")))
        .select("sides")
    )
    found = scratch.write(alone.unionByName(paired).mapInArrow(_verified, "u long, v long"))
    return found


def near_duplicates(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """rows(doc_id, fp, ...) with component_id, the smallest doc_id of the component; rows must be a written table."""
    reps = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(scratch, links(scratch, reps.select("fp")))
    of = reps.join(found.withColumnRenamed("id", "fp").hint("merge"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = scratch.write(of)
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = scratch.write(of.join(least.hint("merge"), "root").select("fp", "component_id"))
    return rows.join(named.hint("merge"), "fp")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and component."""
    from waymark.llm.common import table

    scratch = Scratch(spark)
    rows = scratch.write(with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fp"))
    return near_duplicates(scratch, rows).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(spark, docs: DataFrame) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (nulls last; of repeated ids, any one)."""
    scratch = Scratch(spark)
    names = docs.columns
    fp, row = spare(docs, "fp"), spare(docs, "row")
    held = scratch.write(with_fingerprint(docs, fp).withColumn(row, F.monotonically_increasing_id()))
    slim = held.select(F.col("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row"))
    # a document's place in the order: nulls last, then its row
    slim = slim.withColumn("place", F.struct(F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), "row"))
    reps = scratch.write(slim.groupBy("fp").agg(F.min("place").alias("place")))
    found = components(scratch, links(scratch, reps.select("fp")))
    of = reps.join(found.withColumnRenamed("id", "fp").hint("merge"), "fp", "left").select("place", F.coalesce("root", "fp").alias("root"))
    kept = scratch.write(of.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row").alias(row)))
    return held.join(kept.hint("merge"), row, "left_semi").select(*names)
