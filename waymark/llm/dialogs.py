"""Repair of conversation structure: the cheapest edits that give alternating turns, of equal ones the least audit.

Rows of a conversation, by turn (nulls first; rows of one turn by role, then by the SHA-256 of the text), are read by an
automaton whose states are the last role's initial: nothing yet, s, u, a. Keep costs 0 where the role's initial may
follow, rerole to the role that must follow 2, delete 3, insert an empty turn of the role that must follow 2; a truncated
row that is not deleted adds 1, blank and duplicate rows have to go. It ends before any row or after an assistant.

Costs to the end are made backwards, row by row, for all four states. Of the arcs that are on cheapest paths each node
keeps the least by prefix doubling: nodes are ranked by the first letter of their least audit, then by the first two,
four, eight; a node's rank at twice the length is that of its pair (its own rank, the rank of the node to which its
pointer leads), and pointers double along. A letter leads from a node to one node only, so a prefix fixes its node.
The path from the start is marked through the doubled pointers.

Conversations may be of any length. Rows are dealt out by ranges of (conversation, turn, ...), and each run of 8,192 rows
is a block, whatever conversations it cuts. Costs of a cut piece are a 4 x 4 table (from state, to state); the tables of
a conversation's pieces, a row for each block, give each piece the costs beyond it, and then the states in which it is
entered. Only the digest of a repaired conversation runs over its rows in one task, as a digest must, in bounded memory.

Null roles and texts are one space; null turns come first and are no turn when turns are counted; the rows of a null
conversation are a conversation. Repeated rows are duplicates. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import Scratch, table, width

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
BITS = 13  # rows of a block: 2 ** BITS
NEVER = 1 << 40
NO_ROLE, SYSTEM, USER, ASSISTANT = range(4)  # as an initial; as a state, 0 is the start
#: By state: what must follow. By initial and state: where keeping the row leads.
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEEP = np.full((4, 4), -1)
KEEP[SYSTEM, 0] = SYSTEM
KEEP[USER, [0, SYSTEM, ASSISTANT]] = USER
KEEP[ASSISTANT, USER] = ASSISTANT
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Costs after the last row, by state.
AFTER = np.array([0, 4, 2, 0])
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LETTERS = "DIKR"
EMPTY = hashlib.sha256(b"").hexdigest()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one fault in four rows, by crc32 of conv_id:turn."""
    at = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    hit, role, text = F.crc32(at) % 20, F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    out = rows.select("conv_id", "turn", hit.alias("hit"), F.when(hit == 4, "user").otherwise(role).alias("role"), F.when(hit == 1, "").when(hit == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"))
    copies = F.when(F.col("hit") == 0, 0).when(F.col("hit") == 3, 2).otherwise(1)
    return out.select("*", F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("hit", "copy")


class Block:
    """Consecutive rows as arrays, cut into pieces by conversation."""

    def __init__(self, rows: pa.StructArray, borders: bool = False):
        conv, turn = rows.field("conv_id"), rows.field("turn")
        null, value = np.asarray(conv.is_null()), np.asarray(conv.fill_null(0))
        first = np.r_[True, (null[1:] != null[:-1]) | (value[1:] != value[:-1])]
        piece = np.cumsum(first) - 1
        if borders:  # only the pieces that may go on in other blocks
            keep = np.flatnonzero((piece == 0) | (piece == piece[-1]))
            rows, conv, turn, first, piece = rows.take(pa.array(keep)), conv.take(pa.array(keep)), turn.take(pa.array(keep)), first[keep], np.minimum(piece[keep], 1)
        self.pos, code = np.asarray(rows.field("pos")), np.asarray(rows.field("code"))
        self.initial, self.fault = code & 3, code >> 2
        self.has_turn, self.turn = ~np.asarray(turn.is_null()), np.asarray(turn.fill_null(0))
        self.piece, self.begin = piece, np.flatnonzero(first)
        self.end = np.r_[self.begin[1:], len(piece)]
        self.conv = conv.take(pa.array(self.begin))
        self.n = len(self.begin)
        self.layer = np.arange(len(piece)) + piece  # of each row; a piece has one layer more than rows
        self.first_layer, self.last_layer = self.layer[self.begin], self.layer[self.end - 1] + 1
        self.gone, self.more = (self.fault == BLANK) | (self.fault == DUPLICATE), (self.fault == TRUNCATED).astype(np.int64)

    def arcs(self, rows: np.ndarray, beyond: np.ndarray) -> list[np.ndarray]:
        """Costs (row, state, ...) of deleting, keeping and reroling rows, given those beyond them."""
        shape = (len(rows), 1) + (1,) * (beyond.ndim - 2)
        more = np.where(self.gone[rows], NEVER, self.more[rows]).reshape(shape)
        to = KEEP[self.initial[rows]]
        kept = np.take_along_axis(beyond, np.maximum(to, 0).reshape(to.shape + (1,) * (beyond.ndim - 2)), 1)
        kept = np.where((to < 0).reshape(to.shape + (1,) * (beyond.ndim - 2)), NEVER, kept + more)
        return [beyond + 3, kept, beyond[:, NEXT] + 2 + more]

    def costs(self, right: np.ndarray) -> np.ndarray:
        """Costs to the end by layer and state; right: those after each piece, (piece, state) or with a further axis."""
        out = np.full((len(self.piece) + self.n, *right.shape[1:]), NEVER)
        out[self.last_layer] = right
        away = self.end[self.piece] - np.arange(len(self.piece))
        order = np.argsort(away, kind="stable")
        cuts = np.searchsorted(away[order], np.arange(1, away.max() + 2))
        for a, b in zip(cuts, cuts[1:]):
            rows = order[a:b]
            best = np.minimum.reduce(self.arcs(rows, out[self.layer[rows] + 1]))
            best[:, [USER, ASSISTANT]] = np.minimum(best[:, [USER, ASSISTANT]], best[:, [ASSISTANT, USER]] + 2)
            best[:, [0, SYSTEM]] = np.minimum(best[:, [0, SYSTEM]], best[:, [USER]] + 2)
            out[self.layer[rows]] = np.minimum(best, NEVER)
        return out

    def least(self, costs: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each node's letter on its least cheapest path (4: none) and its doubled pointers; closed: pieces after which no row comes."""
        n = costs.size
        letter_to = np.full((len(costs), 4, 4), -1)  # node's layer, state, letter -> node
        rows = np.arange(len(self.piece))
        at, here = self.layer, costs[self.layer]
        delete, keep, rerole = self.arcs(rows, costs[at + 1])
        below, state = (at[:, None] + 1) * 4, np.arange(4)[None]
        letter_to[at, :, 0] = np.where(delete == here, below + state, -1)
        letter_to[at, :, 2] = np.where(keep == here, below + np.maximum(KEEP[self.initial], 0), -1)
        letter_to[at, :, 3] = np.where(rerole == here, below + NEXT[None], -1)
        inserts = np.r_[at, self.last_layer[closed]]
        letter_to[inserts, :, 1] = np.where(costs[inserts][:, NEXT] + 2 == costs[inserts], inserts[:, None] * 4 + NEXT[None], -1)
        letter_to[costs >= NEVER] = -1
        to = letter_to.reshape(n, 4)
        some, own = (to >= 0).any(axis=1), np.arange(n)
        letter = np.where(some, (to >= 0).argmax(axis=1), 4)
        lead = np.where(some, to[own, np.minimum(letter, 3)], own)
        rank = np.where(some, letter + 1, 0)
        pointers = [lead]
        while (pointers[-1] != pointers[-1][pointers[-1]]).any():
            rank = np.unique(rank * (rank.max() + 1) + rank[pointers[-1]], return_inverse=True)[1]
            pointers.append(pointers[-1][pointers[-1]])
        # of each node's arcs the least by (letter, rank of where it leads) at the full length
        key = np.where(to >= 0, np.arange(4)[None] * (n + 1) + rank[np.maximum(to, 0)], 4 * (n + 1))
        return np.where(some, key.argmin(axis=1), 4), pointers

    def path(self, start: np.ndarray, letter: np.ndarray, pointers: list[np.ndarray], costs: np.ndarray) -> np.ndarray:
        """The nodes on the paths from start that have a letter, in order."""
        on = np.zeros(len(letter), bool)
        on[start] = True
        for lead in reversed(pointers):
            on[lead[on]] = True
        nodes = np.flatnonzero(on & (letter < 4))
        return nodes[np.lexsort((-costs.ravel()[nodes], nodes // 4))]  # inserts before one row lower the cost


def _tables(batches):
    """Of the pieces that may be cut: the cost table from each state to each."""
    for batch in batches:
        for k in range(batch.num_rows):
            b = Block(batch.column("rows")[k].values, True)
            right = np.full((b.n, 4, 4), NEVER)
            right[:, range(4), range(4)] = 0
            yield pa.RecordBatch.from_arrays([b.conv, pa.array([batch.column("block")[k].as_py()] * b.n), pa.array(np.arange(b.n) == b.n - 1), pa.array(b.costs(right)[b.first_layer].reshape(b.n, 16).tolist())], ["conv_id", "block", "tail", "costs"])


def _beyond(pieces: pa.Table) -> pa.Table:
    """A conversation's pieces, a row for each block: the costs after those that end their block."""
    right, out = AFTER, []
    for row in sorted(pieces.to_pylist(), key=lambda r: -r["block"]):
        if row["tail"]:
            out.append((row["block"], right.tolist(), right is AFTER))
        right = np.minimum((np.array(row["costs"]).reshape(4, 4) + right[None]).min(axis=1), NEVER)
    return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "right": pa.array([o[1] for o in out], pa.list_(pa.int64())), "closed": pa.array([o[2] for o in out], pa.bool_())})


def _solved(batch, k: int, borders: bool):
    b = Block(batch.column("rows")[k].values, borders)
    right, closed = np.tile(AFTER, (b.n, 1)), np.ones(b.n, bool)
    right[-1], closed[-1] = batch.column("right")[k].as_py(), batch.column("closed")[k].as_py()
    costs = b.costs(right)
    return b, costs, *b.least(costs, closed)


def _exits(batches):
    """Of the same pieces: the state after each from each state before it, and what it ends in."""
    for batch in batches:
        for k in range(batch.num_rows):
            b, _, _, pointers = _solved(batch, k, True)
            exits = pointers[-1].reshape(-1, 4)[b.first_layer] % 4
            turns = [int(t[h][-1]) if h.any() else None for t, h in ((b.turn[x:y], b.has_turn[x:y]) for x, y in zip(b.begin, b.end))]
            yield pa.RecordBatch.from_arrays([b.conv, pa.array([batch.column("block")[k].as_py()] * b.n), pa.array(np.arange(b.n) == 0), pa.array(exits.tolist(), pa.list_(pa.int32())), pa.array(b.initial[b.end - 1].astype(np.int32)), pa.array(turns, pa.int64())], ["conv_id", "block", "head", "exits", "initial", "turn"])


def _entries(pieces: pa.Table) -> pa.Table:
    """A conversation's pieces: the state, last initial and last turn before those that begin their block."""
    state, initial, turn, out = 0, None, None, []
    for row in sorted(pieces.to_pylist(), key=lambda r: r["block"]):
        if row["head"]:
            out.append((row["block"], state, initial, turn))
        state, initial = row["exits"][state], row["initial"]
        turn = turn if row["turn"] is None else row["turn"]
    return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate((("block", pa.int64()), ("state", pa.int32()), ("initial", pa.int32()), ("before", pa.int64())))})


FIXED = "conv_id long, block long, blank long, duplicate long, truncated long, illegal long, turns long, least_turn long, most_turn long, cost long, audit string, pos array<long>, edits array<string>"


def _fixed(batches):
    """Each piece's faults, cost, audit, and for each row its edit: roles inserted before it (u, a), what becomes of it
    (D, K, U and A: reroled), roles inserted after it."""
    for batch in batches:
        for k in range(batch.num_rows):
            b, costs, letter, pointers = _solved(batch, k, False)
            came = [batch.column(c)[k].as_py() for c in ("state", "initial", "before")]
            entry = np.zeros(b.n, np.int64)
            entry[0] = came[0]
            nodes = b.path(b.first_layer * 4 + entry, letter, pointers, costs)
            layer_piece = np.repeat(np.arange(b.n), b.end - b.begin + 1)
            letters, of = letter[nodes], layer_piece[nodes // 4]
            audit = np.frombuffer(LETTERS.encode(), np.uint8)[letters].tobytes().decode()
            cuts = np.searchsorted(of, np.arange(b.n + 1))
            put = NEXT[nodes % 4]
            mark = np.where(letters == 1, np.where(put == USER, "u", "a"), np.where(letters == 3, np.where(put == USER, "U", "A"), np.where(letters == 0, "D", "K")))
            row = np.minimum(nodes // 4 - of, b.end[of] - 1)  # inserts after the last row go with it
            marks, row_cuts = "".join(mark.tolist()), np.searchsorted(row, np.arange(len(b.piece) + 1))
            edits = [marks[x:y] for x, y in zip(row_cuts, row_cuts[1:])]
            out: dict[str, list] = {n: [] for n in ("blank", "duplicate", "truncated", "illegal", "turns", "least_turn", "most_turn", "cost", "audit", "pos", "edits")}
            bad = np.zeros(len(b.piece), np.int64)
            legal = np.zeros((4, 4), bool)
            legal[tuple(zip(*LEGAL))] = True
            bad[1:] = ~legal[b.initial[:-1], b.initial[1:]]
            bad[b.begin] = 0
            if came[1] is not None:
                bad[0] = not legal[came[1], b.initial[0]]
            for p, (x, y) in enumerate(zip(b.begin, b.end)):
                fault, turn = b.fault[x:y], b.turn[x:y][b.has_turn[x:y]]
                turns = 1 + int((turn[1:] != turn[:-1]).sum()) if len(turn) else 0
                if p == 0 and len(turn) and came[2] == turn[0]:
                    turns -= 1
                for n, v in zip(out, ((fault == BLANK).sum(), (fault == DUPLICATE).sum(), (fault == TRUNCATED).sum(), bad[x:y].sum(), turns, turn.min() if len(turn) else None, turn.max() if len(turn) else None, 0 if p == 0 and came[1] is not None else costs[b.first_layer[p], 0])):
                    out[n].append(None if v is None else int(v))
                out["audit"].append(audit[cuts[p] : cuts[p + 1]])
                out["pos"].append(b.pos[x:y])
                out["edits"].append(edits[x:y])
            kinds = {"audit": pa.string(), "pos": pa.list_(pa.int64()), "edits": pa.list_(pa.string())}
            yield pa.RecordBatch.from_arrays([b.conv, pa.array([batch.column("block")[k].as_py()] * b.n), *(pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items())], ["conv_id", "block", *out])


class Repair:
    """Rows (conv_id, turn, role, text) in order, and what becomes of them, written to the shared folder."""

    def __init__(self, scratch: Scratch, rows: DataFrame):
        spark = scratch.spark
        text = F.coalesce("text", F.lit(" "))
        rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("tie"), F.monotonically_increasing_id().alias("row"))
        order = ["conv_id", "turn", "role", "tie", "row"]
        self.rows = scratch.write(rows.repartitionByRange(width(spark), *order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("pos"), *order[:-1], "text"))
        firsts = self.rows.groupBy("conv_id", "role", "tie").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("is_first"))
        said = F.rtrim(F.col("text"), F.lit(BLANKS))
        initial = F.substring("role", 1, 1)
        told = self.rows.select("pos", "conv_id", "turn", F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(NO_ROLE).alias("initial"), (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(*ENDS)).alias("cut"))
        fault = F.when(F.col("blank"), BLANK).when(F.col("is_first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0)
        told = told.join(firsts.hint("merge"), "pos", "left").select("pos", "conv_id", "turn", (F.col("initial") + 4 * fault).alias("code"))
        blocks = scratch.write(told.groupBy(F.shiftright("pos", BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "conv_id", "turn", "code"))).alias("rows")))
        tables = blocks.mapInArrow(_tables, "conv_id long, block long, tail boolean, costs array<long>")
        beyond = tables.groupBy("conv_id").applyInArrow(_beyond, "block long, right array<long>, closed boolean")
        blocks_beyond = scratch.write(blocks.join(beyond.hint("merge"), "block"))
        exits = blocks_beyond.mapInArrow(_exits, "conv_id long, block long, head boolean, exits array<int>, initial int, turn long")
        entries = exits.groupBy("conv_id").applyInArrow(_entries, "block long, state int, initial int, before long")
        self.fixed = scratch.write(blocks_beyond.join(entries.hint("merge"), "block").mapInArrow(_fixed, FIXED))
        scratch.drop(blocks, blocks_beyond)

    def edits(self) -> DataFrame:
        """(conv_id, pos, edit) for every row."""
        return self.fixed.select("conv_id", F.explode(F.arrays_zip("pos", "edits")).alias("e")).select("conv_id", "e.pos", F.col("e.edits").alias("edit"))

    def turns(self) -> DataFrame:
        """The repaired conversations: (conv_id, pos, place, role, text) in order of pos and place, the place among a row's turns."""
        told = self.edits().select("pos", "edit").join(self.rows.select("pos", "conv_id", "role", "text").hint("merge"), "pos")
        told = told.select("conv_id", "pos", "role", "text", F.posexplode(F.split("edit", "")).alias("place", "mark")).where("mark not in ('', 'D')")
        role = F.when(F.lower("mark") == "u", "user").when(F.lower("mark") == "a", "assistant").otherwise(F.col("role"))
        return told.select("conv_id", "pos", "place", role.alias("role"), F.when(F.col("mark").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))

    def digests(self) -> DataFrame:
        """(conv_id, repaired_sha256) of role:text, joined by new lines; each conversation streams through one task."""
        nothing = F.lit(None).cast("string")
        lines = self.edits().select("conv_id", "pos", F.lit(0).alias("kind"), "edit", nothing.alias("role"), nothing.alias("text"))
        lines = lines.unionByName(self.rows.select("conv_id", "pos", F.lit(1).alias("kind"), nothing.alias("edit"), "role", "text"))
        return lines.repartition(width(self.rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos", "kind").mapInArrow(_digests, "conv_id long, repaired_sha256 string")

    def reports(self) -> DataFrame:
        """Faults, cost and audit of every conversation that has rows."""
        audit = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda p: p["audit"])).alias("audit")
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
        gaps = F.coalesce(F.max("most_turn") - F.min("least_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
        return self.fixed.groupBy("conv_id").agg(gaps, *sums, audit)


def _digests(batches):
    own, made, edit, first = None, None, "", True
    done: list[tuple] = []
    for batch in batches:
        for conv, kind, marks, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "edit", "role", "text"))):
            if made is None or conv != own:
                if made is not None:
                    done.append((own, made.hexdigest()))
                own, made, first = conv, hashlib.sha256(), True
            if kind == 0:
                edit = marks
                continue
            for mark in edit:
                if mark == "D":
                    continue
                line = ("user" if mark in "uU" else "assistant" if mark in "aA" else role) + ":" + ("" if mark in "ua" else text)
                made.update((line if first else "\n" + line).encode())
                first = False
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
        done = []
    if made is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), pa.array([made.hexdigest()])], ["conv_id", "repaired_sha256"])


def reported(scratch: Scratch, rows: DataFrame, every: DataFrame) -> DataFrame:
    """Report and digest of every conversation of `every`(conv_id); zeros and empty strings for those without rows."""
    repair = Repair(scratch, rows)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = repair.reports().withColumn("repaired_sha256", F.lit(None).cast("string"))
    for more in (repair.digests(), every.select(F.col("conv_id").cast("long")).distinct()):
        parts = parts.unionByName(more, allowMissingColumns=True)
    out = parts.groupBy("conv_id").agg(*(F.coalesce(F.max(n), F.lit(0)).cast("long").alias(n) for n in names), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(EMPTY)).alias("repaired_sha256"))
    return out


def op11_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return reported(Scratch(spark), damaged(rows), rows.select("conv_id"))
