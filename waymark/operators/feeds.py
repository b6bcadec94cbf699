"""Feeds, names and histories: hints in texts, aliases, forecasts, typical days, what a map cluster holds, forbidden nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.columns import norm_text, without_marks
from waymark.functions.rounds import written

#: Month names in English, German, French and Italian.
MONTHS = {
    1: "january jan januar janvier gennaio",
    2: "february feb februar fevrier février febbraio",
    3: "march mar maerz märz mars marzo",
    4: "april apr avril aprile",
    5: "may mai maggio",
    6: "june jun juni juin giugno",
    7: "july jul juli juillet luglio",
    8: "august aug agosto aout août",
    9: "september sep sept septembre settembre",
    10: "october oct oktober okt octobre ottobre",
    11: "november nov novembre",
    12: "december dec dezember dez decembre décembre dicembre",
}
#: Words that begin a hint, words that may stand between, and words one of which must come next (none: any may), in the
#: order in which hints are tried. Words are folded to lower case.
HINTS = [
    ("predicted", "predicted expected estimated planned anticipated", "pass", "opening"),
    ("predicted", "öffnung oeffnung freigabe", "", ""),
    ("open-from", "open opened opens reopen reopens reopening", "", ""),
    ("open-from", "offen geöffnet geoeffnet öffnet oeffnet", "", "ab am voraussichtlich"),
    ("closed-until", "closed closure blocked shut", "", "until through till"),
    ("closed-until", "gesperrt sperre wintersperre", "voraussichtlich", "bis"),
]
#: A date is looked for among so many words, numbers and marks after a hint.
AHEAD = 24
TOKEN = r"\p{L}+|\d+|[^\s\p{L}\d]"


def _one_of(x: Column, words: str) -> Column:
    return F.coalesce(x.isin(*words.split()), F.lit(False))


def _said_after(tokens: Column, heads: str, between: str, then: str) -> Column:
    """The tokens after the first place where a rule's words stand; null where they don't."""

    def stands(i: Column) -> Column:
        head = _one_of(F.get(tokens, i), heads)
        if not then:
            return head
        next_ = _one_of(F.get(tokens, i + 1), then)
        return head & (next_ | (_one_of(F.get(tokens, i + 1), between) & _one_of(F.get(tokens, i + 2), then)) if between else next_)

    at = F.get(F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), stands), 0)
    return F.when(at.isNotNull(), F.slice(tokens, at + 2, AHEAD))


def _dates(said: Column) -> Column:
    """The dates in tokens as (form, at, day, month, year): numbers (2.5.2024), month first (May 2nd, 2024), day first (2. Mai)."""
    named = F.create_map(*[F.lit(x) for number, names in MONTHS.items() for name in names.split() for x in (name, number)])
    ordinal = "st nd rd th er"

    def number(i: Column, most: int) -> Column:
        token = F.get(said, i)
        return F.when(F.length(token) <= most, token.try_cast("int"))

    def year(i: Column) -> Column:
        return F.when(F.length(F.get(said, i)) == 4, F.get(said, i).try_cast("int"))

    def at(i: Column) -> Column:
        mark, month = _one_of(F.get(said, i + 1), ". / -"), lambda k: F.try_element_at(named, F.get(said, k))
        tail = i + 2 + _one_of(F.get(said, i + 2), ordinal).cast("int")
        month_first = F.struct(F.lit(1).alias("form"), i.alias("at"), number(i + 1, 2).alias("day"), month(i).alias("month"), F.coalesce(year(tail), F.when(F.get(said, tail) == ",", year(tail + 1))).alias("year"))
        gap = i + 1 + _one_of(F.get(said, i + 1), ordinal + " .").cast("int")
        day_first = F.struct(F.lit(2).alias("form"), i.alias("at"), number(i, 2).alias("day"), month(gap).alias("month"), year(gap + 1).alias("year"))
        numbers = F.struct(F.lit(0).alias("form"), i.alias("at"), F.when(mark, number(i, 2)).alias("day"), number(i + 2, 2).alias("month"), F.when(_one_of(F.get(said, i + 3), ". / -"), year(i + 4)).alias("year"))
        return F.array(numbers, month_first, day_first)

    found = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(said) - 1, F.lit(0))), at))
    return F.filter(found, lambda d: d["day"].between(1, 31) & d["month"].between(1, 12))


def hints(statuses: DataFrame) -> DataFrame:
    """statuses(id, info): what the text says of an opening in English or German: predicted, open-from or closed-until, with
    day, month and year; months may be French or Italian too. Rules are tried in order; one that no date follows is passed
    over. Of a date's forms the first that occurs is taken."""
    tokens = statuses.where("info is not null").select("id", F.regexp_extract_all(F.lower("info"), F.lit(TOKEN), F.lit(0)).alias("tokens")).where(F.size("tokens") > 0)
    tails = F.array(*[F.struct(F.lit(kind).alias("kind"), _said_after(F.col("tokens"), *words).alias("said")) for kind, *words in HINTS])
    tried = tokens.select("id", F.posexplode(tails).alias("at", "h")).where("h.said is not null").select("id", "at", "h.kind", F.array_min(_dates(F.col("h.said"))).alias("d"))
    first = tried.where("d is not null").groupBy("id").agg(F.min(F.struct("at", "kind", "d")).alias("h"))
    return first.select("id", "h.kind", "h.d.day", "h.d.month", "h.d.year")


#: Ends of names that say only what it is.
SUFFIXES = "pass joch sattel strasse hohenstrasse panoramastrasse alpenstrasse gipfelstrasse".split()


def aliases(name: Column) -> Column:
    """A name and its parts ("A / B", "A - B") as lower-case letters and digits, without marks and what stands in brackets;
    each also without an end that says only what it is, where more than two characters go before it."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(without_marks(name)), "ß", "ss"), r"\([^)]*\)", " ")
    parts = F.transform(F.array_append(F.split(plain, r"\s*/\s*|\s+-\s+"), plain), lambda p: F.regexp_replace(p, "[^a-z0-9]+", ""))

    def without(end: str) -> Column:
        return F.transform(parts, lambda p: F.when(F.endswith(p, F.lit(end)) & (F.length(p) > len(end) + 2), p.substr(F.lit(1), F.length(p) - len(end))))

    bare = [without(end) for end in SUFFIXES]
    return F.array_distinct(F.filter(F.concat(parts, *bare), lambda p: F.length(p) > 0))


def alias_alerts(alerts: DataFrame, passes: DataFrame, most_m: int = 200) -> DataFrame:
    """alerts(id, name, elev) to the passes(id, name, elev) that share an alias: the nearest in elevation (any, where one of the
    two has none), none more than most_m off; ties by id. Alerts of one name and elevation are looked up once, and an
    alias's elevations are laid out in order with the pass of each: the nearest are the ones before and after."""
    forms = written(alerts.select("name", "elev").distinct().withColumn("form", F.monotonically_increasing_id()))
    a = written(forms.select("form", "elev", F.explode(aliases(F.col("name"))).alias("alias")))
    p = passes.select("id", "elev", F.explode(aliases(F.col("name"))).alias("alias")).groupBy("alias", "elev").agg(F.min("id").alias("pass_id"))
    asked = a.select("alias", "elev").distinct().withColumn("pass_id", F.lit(None).cast(p.schema["pass_id"].dataType))
    both = p.unionByName(asked).withColumn("at", F.when(F.col("pass_id").isNotNull() & F.col("elev").isNotNull(), F.struct("elev", "pass_id")))
    own = Window.partitionBy("alias")
    low = F.last("at", ignorenulls=True).over(own.orderBy("elev").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    high = F.last("at", ignorenulls=True).over(own.orderBy(F.desc("elev")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    met = both.withColumns({"low": F.when(F.col("elev").isNotNull(), low), "high": F.when(F.col("elev").isNotNull(), high), "least": F.min("pass_id").over(own), "blank": F.min(F.when(F.col("elev").isNull(), F.col("pass_id"))).over(own)}).where("pass_id is null")
    beside = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("elev") - F.col(f"{c}.elev")).cast("double").alias("gap"), F.col(f"{c}.pass_id").alias("pass_id")))
    any_ = F.when(F.col("elev").isNull(), F.col("least")).otherwise(F.col("blank"))
    level = F.when(any_.isNotNull(), F.struct(F.lit(0.0).alias("gap"), any_.alias("pass_id")))
    told = met.select("alias", "elev", F.array_min(F.array_compact(F.array(beside("low"), beside("high"), level))).alias("b")).where("b is not null")
    x, y = a.alias("x"), told.alias("y")
    best = x.join(y.hint("merge"), F.expr("x.alias = y.alias and x.elev <=> y.elev")).groupBy("form").agg(F.min("b").alias("b")).where(F.col("b.gap").cast("long") <= most_m)
    found = written(forms.join(best.hint("merge"), "form").select(F.col("name").alias("f_name"), F.col("elev").alias("f_elev"), "b.pass_id", F.col("b.gap").cast("long").alias("gap")))
    each = alerts.join(found.hint("merge"), F.expr("name <=> f_name and elev <=> f_elev")).groupBy("id").agg(F.min(F.struct("gap", "pass_id")).alias("b"))
    return each.select("id", "b.pass_id", "b.gap")


def weather(etas: DataFrame, forecasts: DataFrame, within_s: int = 5_400) -> DataFrame:
    """etas(id, pass_id, at_s) with the hour of the pass's forecasts(pass_id, hour_s, code) nearest to it, within 90 minutes,
    the earlier of two, and its label. Each eta looks only into the hours around it."""
    hours = F.explode(F.transform(F.sequence(F.lit(-2), F.lit(2)), lambda d: (F.floor(F.col("at_s") / 3600) + d) * 3600)).alias("bucket")
    near = etas.select("id", "pass_id", "at_s", hours).join(forecasts.withColumn("bucket", F.floor(F.col("hour_s") / 3600) * 3600).hint("merge"), ["pass_id", "bucket"])
    gap = F.abs(F.col("hour_s") - F.col("at_s"))
    best = near.where(gap <= within_s).groupBy("id").agg(F.min(F.struct(gap.alias("gap"), "hour_s", "code")).alias("b"))
    c = F.col("b.code")
    label = F.when(c == 0, "sunny").when(c == 1, "partly cloudy").when(c == 2, "mostly cloudy").when(c == 3, "cloudy").when(c.between(45, 48), "fog").when(c.between(61, 67), "rain").when(c.between(51, 60), "light rain").when(c.between(71, 77), "snow").when(c.between(85, 86), "snow showers").when(c.between(80, 84), "showers").when(c.between(95, 99), "storm").otherwise("forecast")
    return best.select("id", "b.hour_s", "b.gap", label.alias("label"))


def typical_days(history: DataFrame, least: int = 3) -> DataFrame:
    """history(pass_id, year, open, close: dates): for passes with `least` full years or more the upper median of the days of
    the year of opening and closing (29 February counts as 1 March), as day and month of a common year, and the years."""
    before = F.array(*[F.lit(x) for x in (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)])
    doy = lambda d: F.element_at(before, F.month(d)) + F.dayofmonth(d)
    median = lambda c: F.element_at(F.sort_array(F.collect_list(c)), F.floor(F.count("*") / 2).cast("int") + 1)
    full = history.where("open is not null and close is not null").groupBy("pass_id").agg(F.count("*").alias("years"), median(doy("open")).alias("open_doy"), median(doy("close")).alias("close_doy"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    date = lambda d: F.date_add(F.lit("2001-01-01").cast("date"), F.least(F.lit(365), F.col(d)) - 1)
    return full.where(F.col("years") >= least).select("pass_id", "years", "open_doy", "close_doy", F.date_format(date("open_doy"), "MM-dd").alias("opens"), F.date_format(date("close_doy"), "MM-dd").alias("closes"), "first_year", "last_year")


#: Order of states where two are as frequent.
STATE_RANK = {"open": 1, "restricted": 2, "closed": 3, "unknown": -1}


def dominant_state(items: DataFrame) -> DataFrame:
    """items(cluster, state): each cluster's most frequent state; of equals the one of highest rank; unknown where it is null."""
    rank = F.create_map(*[F.lit(x) for kv in STATE_RANK.items() for x in kv])
    counted = items.groupBy("cluster", F.coalesce("state", F.lit("unknown")).alias("state")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", F.coalesce(F.try_element_at(rank, F.col("state")), F.lit(0)).alias("rank"), "state"))
    return counted.groupBy("cluster").agg(best.alias("b")).select("cluster", "b.state", "b.n")


def composition(items: DataFrame) -> DataFrame:
    """items(cluster, kind): the kinds shown for each cluster, most frequent first (ties by name), with their share: three from
    40 items on, four from ten, two of a single kind, else three at most."""
    counted = items.groupBy("cluster", "kind").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster")
    target = F.when(F.col("total") >= 40, 3).when(F.col("total") >= 10, 4).when(F.col("kinds") <= 1, 2).otherwise(F.least(F.lit(3), F.col("kinds")))
    placed = counted.withColumns({"total": F.sum("n").over(w), "kinds": F.count("*").over(w), "place": F.row_number().over(w.orderBy(F.desc("n"), "kind")).cast("long")})
    return placed.where(F.col("place") <= target).select("cluster", "kind", "n", "place", (F.floor(F.col("n") / F.col("total") * 1000 + 0.5) / 1000).alias("share"))


def barred(nodes: DataFrame, edges: DataFrame, forbidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, pass_id), edges(a, b), forbidden(pass_id): the nodes of forbidden passes, with their siblings (bases and summit
    of the same pass), and the edges that touch one."""
    out = nodes.join(forbidden.select("pass_id").distinct().hint("merge"), "pass_id", "left_semi").select("id", "pass_id")
    ids = out.select(F.col("id").alias("bar"))
    touched = edges.join(ids.withColumnRenamed("bar", "a"), "a", "left_semi").select("a", "b").union(edges.join(ids.withColumnRenamed("bar", "b"), "b", "left_semi").select("a", "b")).distinct()
    return out, touched


def jurisdictions(texts: DataFrame, words: DataFrame, regions: DataFrame) -> DataFrame:
    """texts(id, text) with the jurisdictions that words(word, jurisdiction) names in them, sorted, and the delivery regions of
    regions(jurisdiction, region); by single words of the text in search form."""
    said = texts.select("id", F.explode(F.array_distinct(F.split(norm_text(F.col("text")), " "))).alias("word"))
    found = said.join(words.hint("merge"), "word").select("id", "jurisdiction").distinct().join(regions.hint("merge"), "jurisdiction", "left")
    named = found.groupBy("id").agg(F.array_sort(F.collect_set("jurisdiction")).alias("j"), F.array_sort(F.collect_set("region")).alias("r"))
    return texts.select("id").join(named, "id", "left").select("id", F.coalesce(F.array_join("j", ","), F.lit("")).alias("jurisdictions"), F.coalesce(F.array_join("r", ","), F.lit("")).alias("regions"))


def viewport_cells(cells: DataFrame, west: float, south: float, east: float, north: float, zoom: int = 8, most_cells: int = 64, most_packages: int = 128, most_bytes: int = 8_000_000) -> DataFrame:
    """cells(x, y, packages, bytes) that meet a box (west > east crosses the date line), and whether all of them keep within
    64 cells, 128 packages and 8 MB; where they don't, none is to be loaded."""
    from math import asinh, floor, pi, radians, tan

    n = 2**zoom
    tx = lambda lon: max(0, min(n - 1, floor((lon + 180) / 360 * n)))
    ty = lambda lat: max(0, min(n - 1, floor((1 - asinh(tan(radians(max(-85.05112878, min(85.05112878, lat))))) / pi) / 2 * n)))
    x1, x2, y1, y2 = tx(west), tx(east), ty(north), ty(south)
    inside = F.col("x").between(x1, x2) if west <= east else (F.col("x") >= x1) | (F.col("x") <= x2)
    met = cells.where(inside & F.col("y").between(y1, y2))
    total = met.agg(F.count("*").alias("n"), F.sum("packages").alias("p"), F.sum("bytes").alias("b"))
    fits = F.coalesce((F.col("n") <= most_cells) & (F.col("p") <= most_packages) & (F.col("b") <= most_bytes), F.lit(True))
    return met.withColumn("one", F.lit(1)).join(F.broadcast(total.select(F.lit(1).alias("one"), fits.alias("fits"))), "one").select("x", "y", "packages", "bytes", "fits")  # one row
