"""Text search by an inverted index, and evidence-aware ranking over entities as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import trigrams
from waymark.functions.rounds import written
from waymark.functions.sql import EARTH_ATAN2_M

#: The eight dimensions' weights.
WEIGHTS = {"distinctiveness": 0.22, "regional_uniqueness": 0.14, "evidence_quality": 0.2, "lower_prominence": 0.1, "route_compatibility": 0.12, "season_suitability": 0.08, "access_fit": 0.1, "itinerary_variety": 0.04}
LEAST_RELEVANCE = 0.16


def rounded(x: Column, digits: int = 3) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def _metres(lat1, lon1, lat2, lon2) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_ATAN2_M * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def relevance(name: Column, text: Column, query: Column, shared: Column, n_text: Column, n_query: Column) -> Column:
    """Of a text to a query, both in search form: 1 if the name is the query, 0.94 if it starts with it, 0.82 if the text holds
    it, else 0.62 of the share of words held and 0.38 of the Jaccard likeness of trigrams."""
    words = F.split(query, " ")
    cover = F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words)
    likeness = shared / (n_text + n_query - shared)
    return F.when(name == query, 1.0).when(F.startswith(name, query), 0.94).when(F.contains(text, query), 0.82).otherwise(cover * 0.62 + likeness * 0.38)


def _runs(text: Column, k: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (k - 1)))
    return F.when(F.length(text) >= k, F.transform(at, lambda i: text.substr(i, F.lit(k)))).otherwise(F.array())


#: Documents of a block and queries that are counted together.
BLOCK, CHUNK = 65_536, 256
#: So many queries, short strings, are broadcast.
FEW = 50_000


def _postings(key, docs):
    """Of a block: for each trigram of the padded texts, and each run of one and two characters, the documents that have it;
    under null each document's number of trigrams."""
    held: dict[str, list[int]] = {}
    sizes = np.zeros(docs.num_rows, np.int32)
    for at, text in zip(docs.column("local").to_pylist(), docs.column("text").to_pylist()):
        if text is None:
            continue
        padded = f"  {text}  "
        grams = {padded[i : i + 3] for i in range(len(padded) - 2)}
        sizes[at] = len(grams)
        for gram in grams | set(text) | {text[i : i + 2] for i in range(len(text) - 1)}:
            held.setdefault(gram, []).append(at)
    return pa.table({"block": pa.array([key[0].as_py()] * (len(held) + 1), pa.int64()), "gram": [*held, None], "at": [*(np.array(v, np.int32).tobytes() for v in held.values()), sizes.tobytes()]})


def _counted(least: float):
    """Pairs of a query and a document of a block whose greatest possible relevance is enough, and passes the query's mark.

    The trigrams in common are counted; a word, or the whole query, is taken to be held where all its runs are."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = np.frombuffer(batch.column("sizes")[k].as_py(), np.int32)
                asked: dict[int, dict] = {}
                for p in batch.column("postings")[k].values.to_pylist():
                    at = np.frombuffer(p["at"], np.int32)
                    for u in p["uses"]:
                        own = asked.setdefault(u["qn"], u | {"parts": {}})
                        part = own["parts"].setdefault((u["kind"], u["word"]), [u["need"], []])
                        part[1].append(at)
                for qn, own in asked.items():
                    counts = {key: (need, np.bincount(np.concatenate(lists), minlength=len(sizes))) for key, (need, lists) in own["parts"].items()}
                    shared = counts.get((0, 0), (0, np.zeros(len(sizes), np.int64)))[1]
                    words = sum((c == need for (kind, _), (need, c) in counts.items() if kind == 1), np.zeros(len(sizes), np.int64))
                    may = words / own["words"] * 0.62 + shared / np.maximum(sizes + own["trigrams"] - shared, 1) * 0.38
                    if (2, 0) in counts:
                        may = np.where(counts[2, 0][1] == counts[2, 0][0], 1.0, may)
                    may = may + 1e-6
                    if own["mark"] is None:  # the best of the block only
                        at = np.flatnonzero(may >= least)
                        at = at[np.argsort(-may[at], kind="stable")[: own["most"]]]
                    else:
                        at = np.flatnonzero(may >= max(least, own["mark"]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), qn)), pa.array(np.full(len(at), batch.column("block")[k].as_py())), pa.array(at.astype(np.int32)), pa.array(shared[at].astype(np.int32)), pa.array(sizes[at])], ["qn", "block", "local", "shared", "held"])

    return run


class Index:
    """An inverted index of docs(id, title, name, text, activity, lat, lon), name and text in search form, written in blocks."""

    def __init__(self, docs: DataFrame):
        d = written(docs.select("id", "title", "name", "text", "activity", "lat", "lon"))
        self.blocks = max(-(-d.count() // BLOCK), 4 * int(d.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
        d = d.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(self.blocks)))
        self.docs = written(d.withColumn("local", F.row_number().over(Window.partitionBy("block").orderBy("id", "title", "text")) - 1))
        self.postings = written(self.docs.select("block", "local", "text").groupBy("block").applyInArrow(_postings, "block long, gram string, at binary"))

    def candidates(self, q: DataFrame, least: float, most: int) -> DataFrame:
        """(qn, block, local, shared, held: trigrams in common and of the document) of q(qn, query, mark): for a query without a mark the `most` of each block that may be most
        relevant, else all that may be as relevant as the mark."""
        q = q.withColumns({"trigrams": F.size(trigrams(F.col("query"))), "words": F.size(F.split("query", " ")), "chunk": F.pmod(F.xxhash64("qn"), F.lit(-(-q.count() // CHUNK)))})
        runs = lambda x: F.array_distinct(F.when(F.length(x) < 3, F.array(x)).otherwise(_runs(x, 3)))
        word = q.select("*", F.posexplode(F.split("query", " ")).alias("word", "said")).withColumn("grams", runs(F.col("said"))).drop("said")
        parts = [(0, F.lit(0), trigrams(F.col("query")), q), (1, F.col("word"), F.col("grams"), word), (2, F.lit(0), runs(F.col("query")), q)]
        uses = None
        for kind, number, grams, df in parts:
            made = df.select("chunk", F.explode(grams).alias("gram"), F.struct("qn", F.lit(kind).alias("kind"), number.cast("int").alias("word"), F.size(grams).alias("need"), "trigrams", "words", F.col("mark").cast("double").alias("mark"), F.lit(most).alias("most")).alias("use"))
            uses = made if uses is None else uses.unionByName(made)
        uses = written(uses.groupBy("chunk", "gram").agg(F.collect_list("use").alias("uses")))
        met = uses.join(self.postings.where("gram is not null").hint("merge"), "gram").groupBy("chunk", "block").agg(F.collect_list(F.struct("at", "uses")).alias("postings"))
        heads = self.postings.where("gram is null").select("block", F.col("at").alias("sizes"))
        return written(met.join(heads.hint("merge"), "block").select("block", "sizes", "postings").mapInArrow(_counted(least), "qn long, block long, local int, shared int, held int"))

    def scored(self, q: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
        """(qn, id, title, relevance, distance_m) of the pairs that pass the query's filters."""
        asked = q.withColumnsRenamed({"lat": "qlat", "lon": "qlon", "activity": "wanted"}).withColumn("asked", F.size(trigrams(F.col("query"))))
        met = pairs.join(self.docs.hint("merge"), ["block", "local"]).join(F.broadcast(asked) if q.count() <= FEW else asked.hint("merge"), "qn")
        score = F.when(F.col("query") == "", 1.0).otherwise(relevance(F.col("name"), F.col("text"), F.col("query"), F.col("shared"), F.col("held"), F.col("asked")))
        met = met.withColumns({"relevance": rounded(score, 6), "distance_m": F.floor(_metres(F.col("qlat"), F.col("qlon"), F.col("lat"), F.col("lon")) + 0.5)})
        fine = (F.col("wanted").isNull() | (F.col("activity") == F.col("wanted"))) & (F.col("within_m").isNull() | F.coalesce(F.col("distance_m") <= F.col("within_m"), F.lit(False))) & (F.col("relevance") >= least)
        return met.where(fine).select("qn", "query_id", "id", "title", "relevance", "distance_m")

    def search(self, queries: DataFrame, least: float = LEAST_RELEVANCE, most: int | None = 200) -> DataFrame:
        """queries(query_id, query, lat, lon, within_m, activity), the query in search form -> each query's documents by
        relevance, distance (none last) and title, `most` at most (None: all).

        First the documents of each block that may be most relevant are scored; the relevance of the last of the best
        `most` of them marks what others must be able to reach, and only those are scored too. An empty query takes all
        documents, each with relevance 1. A null activity or distance of a query filters nothing."""
        q = written(queries.select("query_id", "query", "lat", "lon", "within_m", "activity").withColumn("qn", F.monotonically_increasing_id()))
        full, empty = q.where("query <> ''"), q.where("query = ''")
        order = Window.partitionBy("qn").orderBy(F.desc("relevance"), F.asc_nulls_last("distance_m"), "title", "id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order).cast("long")).where(F.lit(True) if most is None else F.col("rank") <= most)
        marked = full.withColumn("mark", F.lit(least))
        if most is not None and full.limit(1).count():
            first = best(self.scored(q, self.candidates(full.withColumn("mark", F.lit(None).cast("double")), least, most), least))
            marks = first.where(F.col("rank") == most).select("qn", F.col("relevance").alias("mark"))
            marked = written(full.join(marks.hint("merge"), "qn", "left").withColumn("mark", F.coalesce("mark", F.lit(least))))
        every = empty.select("qn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.blocks - 1).cast("long"))).alias("block")).join(self.docs.select("block", "local").hint("merge"), "block")
        pairs = every.select("qn", "block", "local", F.lit(0).alias("shared"), F.lit(0).alias("held"))
        if marked.limit(1).count():
            pairs = self.candidates(marked, least, 0).unionByName(pairs)
        return best(self.scored(q, pairs, least)).select("query_id", "rank", "id", "relevance", "distance_m")


def search(docs: DataFrame, queries: DataFrame, least: float = LEAST_RELEVANCE, most: int | None = 200) -> DataFrame:
    """Index(docs).search(queries)."""
    return Index(docs).search(queries, least, most)


@dataclass(frozen=True)
class Wish:
    """What a traveller asks for; empty fields ask for nothing."""

    activities: tuple[str, ...] = ()
    season: str | None = None
    modes: tuple[str, ...] = ()
    weights: dict = field(default_factory=lambda: WEIGHTS)
    hidden_only: bool = False
    technical: bool = False
    verified_access: bool = False


def _bounded(x: str, other: Column) -> Column:
    fine = F.col(x).isNotNull() & ~F.isnan(x)
    return F.when(fine, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(x)))).otherwise(other)


def _share(column: str, wanted: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(F.coalesce(column, F.expr("cast(array() as array<string>)")), F.array(*map(F.lit, wanted)))) / len(set(wanted))


def assess(entities: DataFrame, wish: Wish = Wish()) -> DataFrame:
    """entities(id, distinctiveness, uniqueness, evidence, confidence, prominence, variety, activities, seasons, modes, themes,
    flags, lane, legal, action, verification) with the eight dimensions, lane, exclusions, uncertainties, whether it is
    eligible, its score, and its three best reasons."""
    half, sixty = F.lit(0.5), F.lit(0.65)
    legal = F.coalesce("legal", F.lit("unknown"))
    fit = F.when(legal == "legal", 0.9).when(legal == "restricted", 0.58).otherwise(0.3)
    if wish.modes:
        share = _share("modes", wish.modes)
        fit = F.when(legal == "private", 0.0).when(legal == "unknown", share * 0.45).otherwise(share)
    season = sixty if not wish.season else F.when(F.size(F.coalesce("seasons", F.expr("cast(array() as array<string>)"))) == 0, 0.35).when(F.array_contains("seasons", wish.season), 1.0).otherwise(0.0)
    dims = {
        "distinctiveness": _bounded("distinctiveness", half),
        "regional_uniqueness": _bounded("uniqueness", half),
        "evidence_quality": _bounded("evidence", F.coalesce("confidence", F.lit(0.0))),
        "lower_prominence": 1 - _bounded("prominence", half),
        "route_compatibility": _share("activities", wish.activities) if wish.activities else sixty,
        "season_suitability": season,
        "access_fit": fit,
        "itinerary_variety": _bounded("variety", half),
    }
    d = entities.withColumn("d", F.struct(*[v.cast("double").alias(k) for k, v in dims.items()]))
    has = lambda flag: F.coalesce(F.array_contains("flags", flag), F.lit(False))
    theme = lambda t: F.coalesce(F.array_contains("themes", t), F.lit(False))
    critical = has("critical_access_unknown") | has("critical_condition_unknown")
    qualified = F.col("verification").isin("verified", "partially_verified") & (F.col("d.evidence_quality") >= 0.6) & (F.col("d.access_fit") >= 0.45) & (F.col("action") == "publish") & ~legal.isin("private", "unknown") & ~critical
    either = F.when(F.coalesce(qualified, F.lit(False)), "quieter_verified").otherwise("quieter_lead")
    lane = F.coalesce("lane", F.lit(""))
    d = d.withColumn("lane", F.when(lane == "quieter_lead", "quieter_lead").when((lane == "iconic") | theme("iconic"), "iconic").when((lane == "quieter_verified") | theme("hidden-gem"), either).otherwise("general"))
    obscure = (F.col("lane") != "quieter_verified") | (F.col("d.evidence_quality") < 0.6) | (F.col("d.distinctiveness") < 0.55) | (F.col("d.access_fit") < 0.45)
    told = lambda *rules: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules]))
    d = d.withColumn("exclusions", told(("withheld", F.col("action").isin("exclude", "redact")), ("private", legal == "private"), ("technical", has("technical_route") & F.lit(not wish.technical)), ("access not verified", ~legal.isin("legal", "restricted") & F.lit(wish.verified_access)), ("obscure only", obscure & F.lit(wish.hidden_only))))
    d = d.withColumn("uncertainties", told(("approximate", F.col("action") == "coarsen"), ("access unknown", legal == "unknown"), ("critical access unknown", has("critical_access_unknown")), ("weak evidence", F.col("d.evidence_quality") < 0.45), ("unverified lead", F.col("lane") == "quieter_lead")))
    weights = {**WEIGHTS, **wish.weights}
    total = sum((F.col(f"d.{k}") * w for k, w in weights.items()), F.lit(0.0)) / sum(weights.values()) if sum(weights.values()) else F.lit(0.0)
    score = total * F.when(legal == "unknown", 0.72).otherwise(1.0) * F.when(has("critical_condition_unknown"), 0.62).otherwise(1.0)
    place = {k: i for i, k in enumerate(dims)}
    listed = F.array(*[F.struct((-F.col(f"d.{k}")).alias("v"), F.lit(place[k]).alias("i"), F.lit(k).alias("k")) for k in dims])
    strong = F.filter(listed, lambda x: -x["v"] >= F.when(x["k"] == "lower_prominence", 0.7 if wish.hidden_only else 0.72).otherwise(0.7))
    reasons = F.transform(F.slice(F.array_sort(strong), 1, 3), lambda x: x["k"])
    return d.withColumns({"eligible": F.size("exclusions") == 0, "score": rounded(score), "reasons": reasons})


def ranked(assessed: DataFrame, most: int) -> DataFrame:
    """The eligible by score, confidence and title, `most` at most."""
    return assessed.where("eligible").orderBy(F.desc("score"), F.desc(F.coalesce("confidence", F.lit(0.0))), "title", "id").limit(most)


def discover(entities: DataFrame, found: DataFrame | None, wish: Wish, interest: str | None = None, minutes: float | None = None, most: int = 36) -> DataFrame:
    """Entities of discoverable types for a wish: of an interest (a theme or term that holds it), within a time budget where
    their duration is known, and among found(id, relevance) if there is a query; 0.82 of the score and 0.18 of the relevance."""
    e = entities.where(F.col("entity_type").isin("TrailRoute", "Place", "NaturalFeature", "ProtectedArea") & ~F.col("action").isin("exclude", "redact"))
    if wish.activities:
        e = e.where(F.arrays_overlap("activities", F.array(*map(F.lit, wish.activities))))
    if interest:
        e = e.where(F.exists(F.concat("themes", "terms"), lambda t: F.contains(F.lower(t), F.lit(interest.lower()))))
    if minutes:
        e = e.where(F.col("minutes").isNull() | (F.col("minutes") <= minutes))
    e = e.withColumn("relevance", F.lit(1.0)) if found is None else e.join(found.select("id", "relevance"), "id")
    a = assess(e, wish).where("eligible").withColumn("blended", rounded(F.col("score") * 0.82 + F.col("relevance") * 0.18))
    return a.orderBy(F.desc("blended"), "title", "id").limit(most)
