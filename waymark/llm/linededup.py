"""Line deduplication: a suffix array over line-ID sequences by distributed prefix doubling; longest-common-prefix
intervals reveal the maximal repeated runs of lines, and later copies are deleted.

A text is its lines cut at line feeds; lines without words are left out of the sequence and never deleted. Line ids
are 128-bit hashes of the stripped lines, ranked in order.

Doubling. A suffix's rank is the number of suffixes that are smaller by their first h lines, and a suffix that ends
within them is smaller than one that goes on. Each round orders the suffixes of a class by the rank of what follows
their first h lines, and doubles h; a suffix alone in its class, or one that has ended, has its final rank. Rounds go
on until all have, so there are log2 of the longest repeated run, and only suffixes that share their first h lines with
another take part in a round.

Intervals. Suffixes in rank order (equal ones in order of place: doc_id, row, line) have longest common prefixes with
their neighbours. Where the lines before both are equal too, that prefix is one line shorter than that of the suffix
before (the runs' shifts); only for the others, where a maximal run begins, are lines compared. The deepest interval
that holds a suffix and an earlier one gives the longest run at that place that has an earlier copy: the least prefix on
the way to the nearest neighbour, up or down, of smaller place. The ordered table is cut into ranges; of each range only
the least places by depth are carried to the next ones.

A run counts as repeated if it has at least MIN_WORDS words; all its lines but those of the first copy go.

Null texts stay null, empty ones empty; null doc_ids come last in the order; of repeated rows one is the first. Runs
do not cross documents. Extra columns pass through. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import Scratch, spare, table, width

MIN_WORDS = 10
#: Lines that travel with a suffix; lines compared in the first round where more are equal, and the factor to the next.
AHEAD, SLICE, MORE = 4, 64, 16
#: Suffixes of a range, on average; a range is held in one task.
RANGE_ROWS = 1_000_000
#: A place is the document's number in order, and the line below these bits; a text with more lines than they hold raises.
LINE_BITS = 24

#: Documents that are cut into lines at once.
SOME = 500
LINES = "row long, doc_id long, lines array<int>, words array<int>, a array<long>, b array<long>"


def _lines(batches):
    """Of each document with words: the numbers, words and 128-bit hashes of its lines."""
    for batch in (whole.slice(a, SOME) for whole in batches for a in range(0, whole.num_rows, SOME)):
        cols: list[list] = [[] for _ in range(6)]
        for row, doc, text in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("row", "doc_id", "text"))):
            found = [(at, x.strip(), n) for at, x in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")) if (n := len(x.split()))]
            if found:
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for _, x, _ in found), ">i8").reshape(-1, 2)
                for c, v in zip(cols, (row.as_py(), doc.as_py(), [f[0] for f in found], [f[2] for f in found], digests[:, 0].astype(np.int64), digests[:, 1].astype(np.int64))):
                    c.append(v)
        types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["row", "doc_id", "lines", "words", "a", "b"])


def _running(sums: dict[str, str]):
    """Of a range in order: by name, the sum of a column over the rows before each."""

    def run(batches):
        total = dict.fromkeys(sums, 0)
        for batch in batches:
            made = []
            for name, c in sums.items():
                v = np.asarray(batch.column(batch.schema.get_field_index(c)), np.int64)
                made.append(pa.array(total[name] + np.cumsum(v) - v))
                total[name] += int(v.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *sums])

    return run


def _before(scratch: Scratch, df: DataFrame, keys: list[str], parts: int, **sums: str) -> DataFrame:
    """df, distinct in keys, with, by name, the sum of a column over all rows with smaller keys: within ranges of the keys
    first, then what all smaller ranges hold."""
    cut = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*cut.schema.fields, *(T.StructField(name, T.LongType()) for name in sums)])
    cut = scratch.write(cut.mapInArrow(_running(sums), schema))
    offset = cut.groupBy("part").agg(*[F.sum(c).alias(f"of_{name}") for name, c in sums.items()])  # a row for each range
    order = Window.orderBy("part")
    offset = offset.select("part", *[(F.sum(f"of_{name}").over(order) - F.col(f"of_{name}")).alias(f"of_{name}") for name in sums])
    return cut.join(F.broadcast(offset), "part").withColumns({name: F.col(name) + F.col(f"of_{name}") for name in sums}).drop(*[f"of_{name}" for name in sums], "part")


def _classes(scratch: Scratch, at: DataFrame, keys: list[str], rank, goes_on, parts: int) -> DataFrame:
    """Groups of at by keys: `new`, their rank (of keys and `before`, what is in smaller groups); open, if they have several
    members and go on; and next_start, the number of suffixes in open groups of smaller rank."""
    counted = at.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("open", (F.col("n") > 1) & goes_on)
    counted = counted.withColumn("held", F.when(F.col("open"), F.col("n")).otherwise(0))
    return _before(scratch, counted, keys, parts, before="n", next_start="held").select(*keys, rank.alias("new"), "open", "next_start")


def _pairs(h: int):
    """Open suffixes of each document: row, i, own rank, start of its class, and the rank h lines on (-1 where it ends)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for row, r, start in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("row", "r", "start"))):
                r, start = np.asarray(r.values), np.asarray(start.values)
                i = np.flatnonzero(start >= 0)
                nxt = np.concatenate((r[h:], np.full(min(h, len(r)), -1, np.int64)))
                for o, v in zip(out, (np.full(len(i), row.as_py()), i, r[i], start[i], nxt[i])):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o).astype(np.int64)) for o in out], ["row", "i", "r", "start", "next"])

    return run


def _updated(batches):
    """Ranks of documents with those of this round put in; start is -1 for suffixes that have their final rank."""
    for batch in batches:
        made: list[list] = [[], []]
        for r, news in zip(batch.column("r"), batch.column("news")):
            r, v = np.array(r.values), news.values
            i, start = np.asarray(v.field("i")), np.full(len(r), -1, np.int64)
            r[i] = np.asarray(v.field("r"))
            start[i] = np.asarray(v.field("start"))
            made[0].append(r)
            made[1].append(start)
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(m, pa.list_(pa.int64())) for m in made)], ["row", "r", "start"])


RANKS = "row long, r array<long>, start array<long>"


def ranks(scratch: Scratch, every: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """every(row, a, b: arrays) -> (row, r: array), the ranks by one line, and (row, i, rank), the final ranks of all suffixes
    whose first line is not unique."""
    at = every.select("row", F.posexplode(F.arrays_zip("a", "b")).alias("i", "h")).select("row", F.col("i").cast("long").alias("i"), "h.a", "h.b")
    first = _classes(scratch, at, ["a", "b"], F.col("before"), F.lit(True), parts)
    told = at.join(first.hint("merge"), ["a", "b"]).select("row", F.struct("i", F.col("new").alias("r"), F.when(F.col("open"), F.col("next_start")).otherwise(-1).alias("start")).alias("x"))
    rows = told.groupBy("row").agg(F.array_sort(F.collect_list("x")).alias("xs")).select("row", F.transform("xs", lambda x: x["r"]).alias("r"), F.transform("xs", lambda x: x["start"]).alias("start"))
    rows = lines = scratch.write(rows)
    final, h = [], 1
    while True:
        open_ = scratch.write(rows.mapInArrow(_pairs(h), "row long, i long, r long, start long, next long"))
        if not open_.limit(1).count():
            break
        groups = _classes(scratch, open_, ["r", "start", "next"], F.col("r") + F.col("before") - F.col("start"), F.col("next") >= 0, parts)
        news = scratch.write(open_.select("row", "i", "r", "next").join(groups.drop("start").hint("merge"), ["r", "next"]).select("row", "i", "new", F.when(F.col("open"), F.col("next_start")).otherwise(-1).alias("start")))
        final.append(news.where("start < 0").select("row", "i", F.col("new").alias("rank")))
        left = news.groupBy("row").agg(F.collect_list(F.struct("i", F.col("new").alias("r"), "start")).alias("news"), F.max("start").alias("most")).where("most >= 0")
        after = scratch.write(rows.select("row", "r").join(left.select("row", "news").hint("merge"), "row").mapInArrow(_updated, RANKS))
        scratch.drop(open_)
        if rows is not lines:
            scratch.drop(rows)
        rows, h = after, 2 * h
    out = lines.select("row", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("rank")).limit(0)
    for f in final:
        out = out.unionByName(f)
    return lines, out


SUFFIX = "rank long, row long, i long, rest long, place long, prev long, ahead array<long>"


def _suffixes(batches):
    """Ranked suffixes of each document with what their neighbours ask for: lines left, place, the line before and those ahead."""
    for batch in batches:
        out: list[list] = [[] for _ in range(7)]
        for row, order, r, xs in zip(*(batch.column(batch.schema.get_field_index(c)) for c in ("row", "order", "r", "xs"))):
            r, i, rank = np.asarray(r.values), np.asarray(xs.values.field("i")), np.asarray(xs.values.field("rank"))
            if len(r) >> LINE_BITS:
                raise ValueError(f"a text has {len(r)} lines, more than 2^{LINE_BITS}")
            padded = np.concatenate((r, np.full(AHEAD, -1, np.int64)))
            prev = np.where(i > 0, r[i - 1], -1)
            for o, v in zip(out, (rank, np.full(len(i), row.as_py()), i, len(r) - i, (order.as_py() << LINE_BITS) + i, prev)):
                o.append(v)
            out[6].append(padded[i[:, None] + np.arange(AHEAD)])
        if out[0]:
            flat = [pa.array(np.concatenate(o).astype(np.int64)) for o in out[:6]]
            ahead = np.concatenate(out[6])
            yield pa.RecordBatch.from_arrays([*flat, pa.ListArray.from_arrays(pa.array(np.arange(0, ahead.size + 1, AHEAD), pa.int32()), pa.array(ahead.ravel()))], [f.split()[0] for f in SUFFIX.split(", ")])


NEIGHBOUR = "part int, at long, row long, i long, place long, lcp long, other_row long, other_i long, rank long, rest long, prev long, ahead array<long>"
#: An lcp that follows from the suffix before, and one that asks for more lines.
SHIFT, ASK = -1, -2


def _neighbours(batches):
    """A range of suffixes in rank order: each with its prefix in common with the one above as far as the two tell; the first
    and last of the range keep what they carry, as the next range asks for it."""
    tables = list(batches)
    if not sum(b.num_rows for b in tables):
        return
    t = pa.Table.from_batches(tables)
    c = {n: np.asarray(t.column(n).combine_chunks()) for n in ("part", "rank", "row", "i", "rest", "place", "prev")}
    ahead = np.asarray(t.column("ahead").combine_chunks().flatten()).reshape(-1, AHEAD)
    lcp = np.zeros(len(ahead), np.int64)
    lcp[1:] = _told({k: v[1:] for k, v in c.items()}, ahead[1:], {k: v[:-1] for k, v in c.items()}, ahead[:-1])
    ends = np.zeros(len(ahead), bool)
    ends[[0, -1]] = True
    other = {k: np.concatenate((c[k][:1], c[k][:-1])) for k in ("row", "i")}
    keep = pa.array([list(a) if e else None for a, e in zip(ahead, ends)], pa.list_(pa.int64()))
    yield from pa.Table.from_arrays([pa.array(c["part"]), pa.array(np.arange(len(ahead))), *(pa.array(v) for v in (c["row"], c["i"], c["place"], lcp, other["row"], other["i"], c["rank"], c["rest"], c["prev"])), keep], [f.split()[0] for f in NEIGHBOUR.split(", ")]).to_batches(50_000)


def _told(x: dict, ahead_x: np.ndarray, y: dict, ahead_y: np.ndarray) -> np.ndarray:
    same = (ahead_x == ahead_y) & (ahead_x >= 0)
    known = np.where(same.all(axis=1), ASK, same.argmin(axis=1))
    shift = (x["prev"] >= 0) & (x["prev"] == y["prev"])
    return np.where(x["rank"] == y["rank"], np.where(shift, SHIFT, x["rest"]), np.where((known == ASK) & shift, SHIFT, known))


def _frontier(depths, places) -> list[tuple[int, int]]:
    """(depth, least place at this depth or deeper), deepest first, without those that a deeper one has already."""
    out: list[tuple[int, int]] = []
    for d, p in sorted(zip(depths, places), key=lambda x: (-x[0], x[1])):
        if d > 0 and (not out or p < out[-1][1]):
            out.append((int(d), int(p)))
    return out


def _edge(depth: np.ndarray, place: np.ndarray) -> list[tuple[int, int]]:
    """_frontier() of depths that fall."""
    low = np.minimum.accumulate(place)
    new = np.flatnonzero(np.concatenate(([True], low[1:] < low[:-1])) & (depth > 0))
    last = np.concatenate((depth[new][1:] != depth[new][:-1], [True])) if len(new) else np.zeros(0, bool)
    return list(zip(depth[new][last].tolist(), place[new][last].tolist()))


def _nearest(place: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of a range the prefix in common with the nearest one above of smaller place, -1 where there is none; and
    the least lcp from the range's start on, itself included."""
    best, stack = np.full(len(place), -1, np.int64), []  # (place, least lcp down to the top of the stack)
    for k, (p, d) in enumerate(zip(place.tolist(), lcp.tolist())):
        low = d
        while stack and stack[-1][0] > p:
            low = min(low, stack.pop()[1])
        if stack:
            best[k] = low
        stack.append((p, low))
    return best, np.minimum.accumulate(lcp)


SCANNED = "part int, row long, i long, place long, run long, up long, down long, summary binary"


def _scan(key, t):
    """A range in order: the longest run with an earlier copy as far as the range tells; how deep the ranges above and below
    could add to it (0: not); and the range's summary for them."""
    import pickle

    t = t.sort_by("at")
    c = {n: np.asarray(t.column(n).combine_chunks()) for n in ("row", "i", "place", "lcp")}
    place, lcp = c["place"], c["lcp"]
    above, up = _nearest(place, lcp)
    shifted = np.concatenate((lcp[1:], [1 << 40]))[::-1]  # downward: the prefix in common with the one below; open at the end
    below, down = (v[::-1] for v in _nearest(place[::-1], shifted))
    run = np.maximum(np.maximum(above, below), 0)
    up, down = np.where(above < 0, up, 0), np.where(below < 0, down, 0)
    inner = np.concatenate(([1 << 40], np.minimum.accumulate(lcp[1:]))) if len(lcp) > 1 else np.array([1 << 40])
    to_end = np.minimum.accumulate(np.concatenate(([1 << 40], lcp[:0:-1])))[::-1]
    summary = pickle.dumps((int(lcp[0]), int(lcp[1:].min(initial=1 << 40)), _edge(inner, place), _edge(to_end[::-1], place[::-1])))
    part = int(key[0].as_py())
    keep = (run > 0) | (up > 0) | (down > 0)
    n = int(keep.sum())
    rows = [np.full(n, part, np.int32), *(c[k][keep] for k in ("row", "i", "place")), run[keep], up[keep], down[keep]]
    last = [[part], [None], [None], [None], [None], [None], [None]]
    types = [pa.int32(), *[pa.int64()] * 6]
    cols = [pa.concat_arrays([pa.array(a, ty), pa.array(b, ty)]) for a, b, ty in zip(rows, last, types)]
    return pa.Table.from_arrays([*cols, pa.array([None] * n + [summary], pa.binary())], [f.split()[0] for f in SCANNED.split(", ")])


def _carried(summaries: list[tuple[int, bytes]]) -> dict[int, tuple[list, list, int]]:
    """For each range what the ranges above and below offer it: (depth, least place) by depth, and the first lcp of the next."""
    import pickle

    parts = [(p, *pickle.loads(s)) for p, s in sorted(summaries)]
    above, below, carry = {}, {}, []
    for part, first, least, _, to_end in parts:
        above[part] = carry
        both = _frontier(*zip(*to_end, *((min(d, first, least), p) for d, p in carry))) if to_end or carry else []
        carry = both
    carry, nxt = [], 0
    for part, first, least, inner, _ in reversed(parts):
        below[part] = (carry, nxt)
        both = [*inner, *((min(d, nxt, least), p) for d, p in carry)]
        carry, nxt = _frontier(*zip(*both)) if both else [], first
    return {p: (above[p], *below[p]) for p, *_ in parts}


def _resolve(carried: dict):
    def best(offers, depth, place):
        return max((min(d, depth) for d, p in offers if p < place), default=0)

    def run(batches):
        for batch in batches:
            part, place, runs, up, down = (batch.column(n).to_pylist() for n in ("part", "place", "run", "up", "down"))
            made = []
            for k in range(batch.num_rows):
                above, below, nxt = carried[part[k]]
                made.append(max(runs[k], best(above, up[k], place[k]) if up[k] else 0, best(below, min(down[k], nxt), place[k]) if down[k] else 0))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("i"), pa.array(made, pa.int64())], ["row", "i", "run"])

    return run


def _common(scratch: Scratch, asked: DataFrame, lines: DataFrame) -> DataFrame:
    """asked(row, i, other_row, other_i) of suffixes with AHEAD equal lines -> (row, i, lcp), by slices of their lines, longer
    each time, for those that are still equal."""
    off, size, done = AHEAD, SLICE, None
    while True:
        side = lambda s, row, i: F.struct(F.lit(s).alias("side"), F.col(row).alias("of"), F.col(i).alias("from"))
        ask = asked.select("row", "i", F.explode(F.array(side(0, "row", "i"), side(1, "other_row", "other_i"))).alias("s")).select("row", "i", "s.*")
        got = ask.join(lines.select(F.col("row").alias("of"), "r").hint("merge"), "of").select("row", "i", F.struct("side", F.slice("r", (F.col("from") + off + 1).cast("int"), F.lit(size)).alias("r")).alias("x"), "of", "from")
        met = got.groupBy("row", "i").agg(F.array_sort(F.collect_list("x")).alias("x"), F.max(F.when(F.col("x.side") == 1, F.struct("of", "from"))).alias("o"))
        equal = F.zip_with(F.col("x")[0]["r"], F.col("x")[1]["r"], lambda p, q: p.eqNullSafe(q))
        gap = F.array_position(equal, False)
        met = scratch.write(met.select("row", "i", F.col("o.of").alias("other_row"), F.col("o.from").alias("other_i"), F.when(gap > 0, gap - 1).otherwise(F.size(equal)).alias("same"), ((gap == 0) & (F.size(equal) == size)).alias("more")))
        found = met.where("not more").select("row", "i", (F.col("same") + off).cast("long").alias("lcp"))
        done = found if done is None else done.unionByName(found)
        asked = met.where("more").select("row", "i", "other_row", "other_i")
        if not asked.limit(1).count():
            return done
        off, size = off + size, size * MORE


def _lost(least: int):
    """The numbers of the lines of each document that lie in a later copy with enough words."""

    def run(batches):
        for batch in batches:
            rows, lost = [], []
            for row, lines, words, xs in zip(*(batch.column(n) for n in ("row", "lines", "words", "xs"))):
                i, n = np.asarray(xs.values.field("i")), np.asarray(xs.values.field("run"))
                upto = np.concatenate(([0], np.cumsum(np.asarray(words.values))))
                fine = upto[i + n] - upto[i] >= least
                edge = np.zeros(len(upto), np.int64)
                np.add.at(edge, i[fine], 1)
                np.add.at(edge, (i + n)[fine], -1)
                gone = np.asarray(lines.values)[np.cumsum(edge)[:-1] > 0]
                if len(gone):
                    rows.append(row.as_py())
                    lost.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(lost, pa.list_(pa.int32()))], ["row", "lines"])

    return run


def removed(scratch: Scratch, docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """docs(row, doc_id, text) -> (row, lines): the numbers of the lines that go, for rows that lose any."""
    parts = width(scratch.spark)
    every = scratch.write(docs.select("row", F.col("doc_id").cast("long"), "text").mapInArrow(_lines, LINES))
    lines, final = ranks(scratch, every.select("row", "a", "b"), parts)
    by = ["nil", "doc", "row"]
    placed = every.select(F.col("doc_id").isNull().alias("nil"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), "row", F.lit(1).alias("one"))
    order = _before(scratch, placed, by, parts, order="one").select("row", F.col("order").cast("long").alias("order"))
    ranked = final.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "rank"))).alias("xs"))
    suffixes = ranked.join(lines.select("row", "r").hint("merge"), "row").join(order.hint("merge"), "row").mapInArrow(_suffixes, SUFFIX)
    every_suffix = scratch.write(suffixes)
    ranges = max(parts, -(-every_suffix.count() // RANGE_ROWS))
    ranged = every_suffix.repartitionByRange(ranges, "rank", "place").sortWithinPartitions("rank", "place").withColumn("part", F.spark_partition_id())
    near = scratch.write(ranged.mapInArrow(_neighbours, NEIGHBOUR))
    # the first of each range and the last of the one above it: a row for each range
    carried = F.struct("row", "i", "rank", "rest", "prev", "ahead")
    ends = near.where("ahead is not null").groupBy("part").agg(F.min_by(carried, "at").alias("first"), F.max_by(carried, "at").alias("last"))
    ends = ends.select("first", F.lag("last").over(Window.orderBy("part")).alias("above")).where("above is not null").collect()
    told = [(e["first"]["row"], e["first"]["i"], e["above"]["row"], e["above"]["i"], int(_told({k: np.array([e["first"][k]]) for k in ("rank", "rest", "prev")}, np.array([e["first"]["ahead"]]), {k: np.array([e["above"][k]]) for k in ("rank", "prev")}, np.array([e["above"]["ahead"]]))[0])) for e in ends]
    joints = scratch.spark.createDataFrame(told, "row long, i long, joint_row long, joint_i long, joint_lcp long")
    near = near.select("part", "at", "row", "i", "place", "lcp", "other_row", "other_i").join(F.broadcast(joints), ["row", "i"], "left")
    near = scratch.write(near.select("part", "at", "row", "i", "place", F.coalesce("joint_lcp", "lcp").alias("lcp"), F.coalesce("joint_row", "other_row").alias("other_row"), F.coalesce("joint_i", "other_i").alias("other_i")))
    common = scratch.write(_common(scratch, near.where(F.col("lcp") == ASK).select("row", "i", "other_row", "other_i"), lines))
    whole = near.join(common.withColumnRenamed("lcp", "found").hint("merge"), ["row", "i"], "left").withColumn("lcp", F.coalesce("found", F.when(F.col("lcp") >= 0, F.col("lcp"))))
    # a prefix that follows from the suffix before: the last one known, shorter by a line for each step
    since = F.last(F.col("lcp") + F.col("i"), ignorenulls=True).over(Window.partitionBy("row").orderBy("i"))
    whole = whole.select("part", "at", "row", "i", "place", (since - F.col("i")).alias("lcp"))
    scanned = scratch.write(whole.groupBy("part").applyInArrow(_scan, SCANNED))
    carried = _carried([(r.part, r.summary) for r in scanned.where("summary is not null").select("part", "summary").collect()])  # a row for each range
    runs = scanned.where("summary is null").select("part", "row", "i", "place", "run", "up", "down").mapInArrow(_resolve(carried), "row long, i long, run long").where("run > 0")
    found = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("i", "run"))).alias("xs"))
    return scratch.write(every.select("row", "lines", "words").join(found.hint("merge"), "row").mapInArrow(_lost(least), "row long, lines array<int>"))


def deduplicated(spark, docs: DataFrame, least: int = MIN_WORDS, counts: bool = True) -> DataFrame:
    """docs without the later copies of repeated line runs; with counts also n_lines, n_removed (lines before, lines
    deleted), in place of columns of those names."""
    scratch = Scratch(spark)
    row, lost_lines = spare(docs, "row"), spare(docs, "lines")
    held = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = removed(scratch, held.select(F.col(row).alias("row"), "doc_id", "text"), least)
    wide = held.join(gone.select(F.col("row").alias(row), F.col("lines").alias(lost_lines)).hint("merge"), row, "left")
    if counts:
        wide = wide.withColumns({"n_lines": F.lit(0), "n_removed": F.lit(0)})
    schema = T.StructType([f for f in wide.schema.fields if f.name not in (row, lost_lines)])

    def run(batches):
        for batch in batches:
            texts, before, lost = [], [], []
            for text, lines in zip(batch.column("text"), batch.column(lost_lines)):
                text, gone = text.as_py(), set(lines.as_py() or ())
                cut = text.split("\n") if text is not None else []
                texts.append("\n".join(x for i, x in enumerate(cut) if i not in gone) if gone else text)
                before.append(len(cut))
                lost.append(len(gone))
            made = {"text": pa.array(texts, batch.schema.field("text").type)}
            if counts:
                made |= {"n_lines": pa.array(before, pa.int32()), "n_removed": pa.array(lost, pa.int32())}
            yield pa.RecordBatch.from_arrays([made[f] if f in made else batch.column(f) for f in schema.names], schema.names)

    return wide.mapInArrow(run, schema)


def op3_line_dedup(spark, sf_dir: str) -> DataFrame:
    """For every document: its lines, the lines deleted, and length and digest of what is left."""
    out = deduplicated(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), F.md5("text").alias("text_md5"))
