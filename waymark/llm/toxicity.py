"""Toxicity by a weighted finite-state grammar over clauses.

Transducers read a line symbol by symbol (its words and punctuation marks) and are composed into a bimachine: a chain
that reads forward and one that reads its output backward.

  lexicon   word -> insult (with a learnt weight), threat, target, negation, reported speech, first person, or other
  negation  insult or threat within three words after a negation of the clause -> negated
  report    insult or threat after a verb of reporting in the sentence, or in the quotation that follows it; the verb
            of a first person ("I told you") reports nothing -> reported
  target    insult or threat after a target ("you", "du", ...) of the clause -> aimed
  report'   backward: what stands before a comma or a closing quotation mark and a verb of reporting -> reported
  target'   backward: insult or threat before a target of the clause -> aimed

Clauses end at commas, colons, brackets and quotation marks, sentences at full stops outside quotations, and all of
them at the line's end. The machine's output is the matches, each with its category and weight; a line without an
insult or a threat matches nothing, so only lines in which the lexicon hits are read. A document's score is a logistic
function of the sums of weight by category.

Learnt from at most MAX_TRAIN labelled rows (the smallest hashes of doc_id; twice as many where doc_ids repeat):
insults are words or word stems, chosen greedily until the toxic documents of the sample are covered, each weighing
its log odds; one that is common in clean documents too may count only where a document has it twice. Then the
categories' weights are learnt. Threats and reporting verbs are the fixed lists below with their regular
inflections, targets and negations fixed lists; apostrophes are read alike. Null and empty texts have the score of a
text without matches. Repeated rows give repeated rows; extra columns are ignored; without labels scores are 0.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import Scratch, table
from waymark.llm.quality import held_out, sample

MAX_TRAIN = 8_000
CANDIDATES, STEMS, SHORTEST, LONGEST = 600, 120, 4, 8
NEGATION_SPAN = 3
#: An insult's log odds less two standard errors must pass this.
SURE = 2.5

THREATS = "kill murder strangle hurt beat destroy shoot shot stab burn drown töten umbringen erschlagen erschießen zerstören tuer frapper brûler étrangler matar golpear quemar".split()
TARGETS = "you your yours you're u du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted vosotros".split()
NEGATIONS = "not no never isn't aren't wasn't weren't don't doesn't didn't won't can't cannot nicht kein keine nie pas jamais nunca jamás".split()
REPORTS = "said say call tell told write wrote claim quote shout yell reply answer report sagte sagen nannte schrieb schreiben behaupten dit dire disait appelait écrire crier dijo decir dice llamó escribió gritar".split()
FIRST = "i we ich wir je j'ai nous yo nosotros".split()
ENDINGS = {"en": ("e", "st", "est", "t", "et", "te", "ten", "end"), "er": ("e", "es", "ons", "ez", "ent", "é", "és", "ai", "erai", "era", "ant"), "ar": ("o", "as", "a", "amos", "an", "aré", "ará", "ado", "ando", "aron", "ó")}

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
SYMBOL = re.compile(r"""[^\W_]+(?:'[^\W_]+)*|["“”„«»]|[.!?]|[,;:()|]""")
MARKS = {**dict.fromkeys('"“”„«»', "quote"), **dict.fromkeys(".!?", "stop"), **dict.fromkeys(",;:()|", "cut")}
KINDS = ("bare", "aimed", "reported", "negated", "threat")
HELD = ("I", "T", "N", "R", "A", "AT")


def folded(text: str | None) -> str:
    return (text or "").lower().replace("’", "'")


def inflected(verb: str) -> set[str]:
    """The verb with its regular inflections, by its ending; English without one."""
    stem, end = verb[:-2], verb[-2:]
    if len(verb) > 4 and end in ENDINGS:
        more = {stem + e for e in ENDINGS[end]}
        return {verb, *more, "ge" + stem + "t"} if end == "en" else {verb, *more}
    twice = verb + verb[-1] if re.fullmatch(r".*[^aeiou][aeiou][bdgmnpt]", verb) else verb
    soft = verb[:-1] if verb.endswith("e") else twice
    return {verb, verb + "s", soft + "ed", soft + "ing"}


@dataclass
class Machine:
    """A transducer: step(state, symbol) -> (state, symbol). Symbols are (kind, (weight, stem) of a match)."""

    start: tuple
    step: object

    def compose(self, other: Machine) -> Machine:
        """This machine's output is the other's input."""

        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = other.step(state[1], out)
            return (a, b), out

        return Machine((self.start, other.start), step)

    def run(self, symbols) -> list[tuple]:
        state, out = self.start, []
        for symbol in symbols:
            state, made = self.step(state, symbol)
            out.append(made)
        return out


def _lexicon(weights: dict[str, float]) -> Machine:
    fixed = {m: (k, None) for m, k in MARKS.items()}
    for kind, words in (("say", REPORTS), ("T", THREATS)):
        fixed |= {w: (kind, (1.0, "")) for v in words for w in inflected(v)}
    fixed |= {w: (k, None) for k, ws in (("you", TARGETS), ("not", NEGATIONS), ("me", FIRST)) for w in ws}

    def step(state, word):
        if word in fixed:
            return state, fixed[word]
        for n in range(len(word), SHORTEST - 1, -1):
            if (w := weights.get(word[:n])) is not None:
                return state, ("I", (w, word[:n]))
        return state, ("", None)

    return Machine((), step)


def _negation(left, symbol):
    kind, w = symbol
    if kind in ("quote", "stop", "cut"):
        return 0, symbol
    if kind == "not":
        return NEGATION_SPAN, symbol
    if left and kind in ("I", "T"):
        return left - 1, ("N", w)
    return max(0, left - 1), symbol


def _report(state, symbol):
    """States: where ("", said, in a reported quotation, in another), words since a first person."""
    (where, me), (kind, w) = state, symbol
    if kind == "me":
        return (where, 0), symbol
    if kind == "say" and where in ("", "said"):
        return ("" if me <= 1 else "said", 9), symbol
    if kind == "quote":
        return ({"": "other", "said": "quoted"}.get(where, ""), 9), symbol
    if kind == "stop":
        return ("" if where == "said" else where, 9), symbol
    out = ("R", w) if where in ("said", "quoted") and kind in ("I", "T") else symbol
    return (where, min(9, me + 1)), out


def _report_after(state, symbol):
    """Reads backward. States: where, words since the verb of reporting; the verb must follow within four words."""
    (where, since), (kind, w) = state, symbol
    if kind == "say" and where in ("", "said", "told"):
        return ("said", 0), symbol
    if kind == "quote":
        return ("quoted" if where in ("said", "told") and since <= 4 else "other" if where in ("", "said", "told") else "", 9), symbol
    if kind == "stop":
        return (where if where in ("quoted", "other") else "", 9), symbol
    if kind == "cut":
        return ("told" if where == "said" and since <= 4 else where, since), symbol
    if kind == "me" and where == "said":
        return ("", 9), symbol
    out = ("R", w) if where in ("told", "quoted") and kind in ("I", "T", "A", "AT") else symbol
    return (where, min(9, since + 1)), out


def _target(seen, symbol):
    kind, w = symbol
    if kind in ("quote", "stop", "cut"):
        return False, symbol
    return (True, symbol) if kind == "you" else (seen, ("A" if kind == "I" else "AT", w) if seen and kind in ("I", "T") else symbol)


@dataclass
class Grammar:
    weights: dict[str, float]  # insult stem -> log odds
    needs: dict[str, int] = field(default_factory=dict)  # insult stem -> matches in a document from which it counts, 1 by default
    kinds: np.ndarray = field(default_factory=lambda: np.zeros(len(KINDS) + 1))  # by kind, then intercept

    def __post_init__(self):
        self._made = None

    def __getstate__(self):
        return {"weights": self.weights, "needs": self.needs, "kinds": self.kinds, "_made": None}

    def machinery(self):
        if self._made is None:
            hits = ahocorasick.Automaton()
            for w in {*self.weights, *(w for t in THREATS for w in inflected(t))}:
                hits.add_word(w, len(w))
            if len(hits):
                hits.make_automaton()
            forward = _lexicon(self.weights)
            for start, step in ((0, _negation), (("", 9), _report), (False, _target)):
                forward = forward.compose(Machine(start, step))
            backward = Machine(("", 9), _report_after).compose(Machine(False, _target))
            self._made = hits, forward, backward
        return self._made

    def matches(self, text: str | None) -> list[tuple]:
        """(kind, (weight, stem)) of every match in every line of the text."""
        hits, forward, backward = self.machinery()
        low = folded(text)
        out, done = [], -1
        if not len(hits):
            return out
        for end, size in hits.iter(low):
            begin = end - size + 1
            if begin < done or (begin and (low[begin - 1].isalnum() or low[begin - 1] == "_")):
                continue
            stop = low.find("\n", end)
            done = stop if stop >= 0 else len(low)
            read = forward.run(SYMBOL.findall(low, low.rfind("\n", 0, begin) + 1, done))
            out += [m for m in backward.run(read[::-1])[::-1] if m[0] in HELD]
        return out

    def sums(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(KINDS))
        found = self.matches(text)
        times = Counter(stem for _, (_, stem) in found)
        for kind, (w, stem) in found:
            if times[stem] < self.needs.get(stem, 1):
                continue
            out[("I", "A", "R", "N", "T").index({"AT": "T"}.get(kind, kind))] += w
            if kind == "AT":
                out[1] += w
        return np.log1p(out)

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums @ self.kinds[:-1] + self.kinds[-1], -30, 30)))


def _stems(text: str) -> set[str]:
    """Words and stems of the text, and again with " 2" those that it has twice."""
    times = Counter()
    for w, n in Counter(WORD.findall(folded(text))).items():
        for stem in {w[:k] for k in range(SHORTEST, LONGEST + 1) if len(w) >= k} | ({w} if len(w) < 24 else set()):
            times[stem] += n
    return {*times, *(f"{s} 2" for s, n in times.items() if n > 1)}


def _counted(batches):
    yes, no = Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch.column("text"), batch.column("y")):
            (yes if y.as_py() else no).update(_stems(text.as_py()))
    keys = [k for k in yes]
    for a in range(0, len(keys), 50_000):
        part = keys[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([yes[k] for k in part], pa.int64()), pa.array([no[k] for k in part], pa.int64())], ["stem", "yes", "no"])
    only = [k for k in no if k not in yes]
    for a in range(0, len(only), 50_000):
        part = only[a : a + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([no[k] for k in part], pa.int64())], ["stem", "yes", "no"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Grammar:
    rows = Scratch(docs.sparkSession).write(sample(docs, labels, "toxic", most, 5, 0).where("text is not null").dropDuplicates(["text", "y"]))
    n = {bool(r.y): r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        found = Grammar({})
        found.kinds[-1] = 30.0 if n.get(True) else -30.0
        return found
    odds = F.log((F.col("yes") + 0.5) / n[True]) - F.log((F.col("no") + 0.5) / n[False])
    counts = rows.mapInArrow(_counted, "stem string, yes long, no long").groupBy("stem").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    least = max(3, n[True] // 200)
    doubt = F.sqrt(1 / (F.col("yes") + 0.5) + 1 / (F.col("no") + 0.5))
    picked = counts.where(F.col("yes") >= least).withColumn("w", odds).where(F.col("w") - 2 * doubt > SURE)
    picked = picked.orderBy(F.desc(F.col("w") * F.col("yes")), F.desc(F.length("stem")), "stem").limit(CANDIDATES).collect()
    weight = {r.stem: float(r.w) for r in picked}

    def incidence(batches):
        for batch in batches:
            docs_, stems = [], []
            for doc, text, y in zip(batch.column("doc_id"), batch.column("text"), batch.column("y")):
                if y.as_py():
                    docs_.append(doc.as_py())
                    stems.append(sorted(s for s in _stems(text.as_py()) if s in weight))
            yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(stems, pa.list_(pa.string()))], ["doc_id", "stems"])

    by: dict[str, set] = defaultdict(set)
    for r in rows.mapInArrow(incidence, "doc_id long, stems array<string>").orderBy(F.xxhash64("doc_id"), "stems").limit(2 * most).collect():
        for s in r.stems:
            by[s].add(r.doc_id)
    chosen: dict[str, float] = {}
    left = {s: set(d) for s, d in by.items()}
    while left and len(chosen) < STEMS:
        # each stem must explain documents that the chosen ones leave, or hold in as many as they do
        best = max(left, key=lambda s: (len(left[s]), len(by[s]), len(s), s))
        if len(by[best]) < least:
            break
        own = left.pop(best)
        chosen[best] = weight[best]
        rest = {s: d - own for s, d in left.items()}
        akin = lambda s: any(a.startswith(b) or b.startswith(a) for a, b in ((s.split(" ")[0], c.split(" ")[0]) for c in chosen))
        left = {s: d for s, d in rest.items() if len(d) >= least or (len(by[s]) >= 8 * least and not akin(s))}
    found = Grammar({}, {})
    for s, w in chosen.items():
        stem, _, twice = s.partition(" ")
        if found.needs.get(stem, 2) > 1 or not twice:
            found.weights[stem], found.needs[stem] = w, 2 if twice else 1

    def summed(batches):
        for batch in batches:
            x = np.array([found.sums(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(KINDS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    got = rows.mapInArrow(summed, "doc_id long, y int, x array<double>").orderBy(F.xxhash64("doc_id"), "y", "x").limit(2 * most).collect()
    found.kinds = _logistic(np.array([r.x for r in got]), np.array([r.y for r in got], float))
    return found


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5) -> np.ndarray:
    """Weights, then intercept, by Newton's method. Kinds never seen keep the bare kind's weight, halved for negated and reported matches."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    pull = np.diag([l2] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        w = w + np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + pull, x1.T @ (y - p) - pull @ w)
    for k, part in ((1, 1.0), (2, 0.5), (3, 0.25), (4, 0.5)):
        if (x[:, k] > 0).sum() < 5:
            w[k] = part * w[0]
    return w


def scored(docs: DataFrame, grammar: Grammar, column: str = "score") -> DataFrame:
    """docs with the score in a column that docs does not have."""

    def run(batches):
        for batch in batches:
            x = np.array([grammar.sums(t.as_py()) for t in batch.column("text")]).reshape(batch.num_rows, len(KINDS))
            yield batch.append_column(column, pa.array(grammar.score(x)))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, and whether it was held out from learning."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = train(docs, table(spark, sf_dir, "labels"))
    return scored(docs, grammar).select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
