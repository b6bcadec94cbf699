"""Projections of tours, places and passes into the documents and rows that others read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.spatial import distance_m


def _coordinate(lat: str, lon: str) -> Column:
    """A vertex in whole millionths of a degree, so that equal vertices are equal."""
    return F.struct(F.floor(F.col(lon) * 1e6 + 0.5).alias("x"), F.floor(F.col(lat) * 1e6 + 0.5).alias("y"))


def joined_segments(segments: DataFrame, touch_m: float = 30.0) -> DataFrame:
    """segments(tour_id, ord, line: array<struct<lat, lon>>): each tour's lines in order as one line without the vertices that
    joints share, and that line out and back; `whole` says whether all joints touch (within touch_m). The line of a tour
    with a gap is given too, as far as its first gap."""
    point = lambda p: F.struct(F.floor(p["lon"] * 1e6 + 0.5).alias("x"), F.floor(p["lat"] * 1e6 + 0.5).alias("y"))
    w = Window.partitionBy("tour_id").orderBy("ord")
    last, first = F.lag(F.element_at("line", -1)).over(w), F.element_at("line", 1)
    s = segments.where(F.size("line") > 0).withColumns({"last": last, "first": first})
    gap = F.col("last").isNotNull() & (distance_m(F.col("last.lat"), F.col("last.lon"), F.col("first.lat"), F.col("first.lon")) > touch_m)
    s = s.withColumn("gaps", F.sum(gap.cast("int")).over(w))
    parts = F.array_sort(F.collect_list(F.when(F.col("gaps") == 0, F.struct("ord", F.transform("line", point).alias("line")))))
    rows = s.groupBy("tour_id").agg(parts.alias("parts"), F.count("*").alias("segments"), (F.max("gaps") == 0).alias("whole"))
    empty = F.expr("cast(array() as array<struct<x:bigint,y:bigint>>)")

    def put(out, part):
        shared = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1)) == F.try_element_at(part["line"], F.lit(1)))
        return F.concat(out, F.when(shared, F.slice(part["line"], F.lit(2), F.size(part["line"]))).otherwise(part["line"]))

    rows = rows.withColumn("line", F.aggregate("parts", empty, put))
    back = F.slice(F.reverse("line"), F.lit(2), F.size("line"))
    return rows.select("tour_id", "segments", "whole", "line", F.concat("line", back).alias("out_and_back"))


def envelope(entities: DataFrame) -> DataFrame:
    """entities(id, key, entity_type, name, language, source, record, lon, lat, confidence, verification, action, observed) in the
    common envelope: names, geometry, assertions of name, geometry and type, quality, sensitivity and origin."""
    names = F.array(F.struct(F.coalesce("language", F.lit("und")).alias("language"), F.col("name").alias("value"), F.lit("primary").alias("kind")))
    one = lambda path, share: F.struct(F.concat("key", F.lit("#"), F.lit(path)).alias("id"), F.col("source").alias("source_id"), F.col("record").alias("source_record_id"), F.lit(path).alias("field_path"), F.floor(F.col("confidence") * share * 1000 + 0.5).alias("confidence_permille"), F.col("verification").alias("status"), F.col("observed").alias("observed_at"))
    return entities.select(
        "id", "key", "entity_type", names.alias("names"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
        F.array(one("/names", 1.0), one("/geometry", 0.9), one("/entityType", 0.8)).alias("assertions"),
        F.struct(F.col("confidence"), F.col("verification").alias("status"), F.col("observed").alias("assessed_at"), F.when(F.col("flag").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("flag")).alias("flags")).alias("quality"),
        F.struct("action", F.when(F.col("action") != "publish", "protected site").alias("reason")).alias("sensitivity"), F.array(F.struct(F.col("source").alias("source_id"), F.col("record").alias("record_id"))).alias("original_sources"),
    )


def graph_nodes(passes: DataFrame, bases: DataFrame, viewpoints: DataFrame, sights: DataFrame, junctions: DataFrame, heights: DataFrame, near_m: float = 3_000.0, offset: float = 0.06) -> DataFrame:
    """All nodes of the road graph: passes with their summit and two bases (given, or made west and east of the summit where
    none is), viewpoints of both sources within near_m merged into their pass, sights with dwell and scenic weight, and
    junctions. Elevations: the node's own, else heights(key, elev), else of a base 600 m below its pass."""
    side = lambda s, d: F.struct(F.lit(s).alias("side"), (F.col("lon") + d).alias("made_lon"))
    sides = passes.select("id", "lat", "lon", "elev", F.explode(F.array(side("A", -offset), side("B", offset))).alias("s")).select("id", "lat", "elev", "s.side", "s.made_lon")
    given = bases.select(F.col("pass_id").alias("id"), "side", F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    based = sides.join(given, ["id", "side"], "left").select(F.concat(F.lit("base:"), "id", "side").alias("key"), F.lit("pass-base").alias("kind"), F.coalesce("b_lat", "lat").alias("lat"), F.coalesce("b_lon", "made_lon").alias("lon"), F.lit(None).cast("double").alias("own"), (F.col("elev") - 600).cast("double").alias("guess"), F.lit(0).cast("long").alias("dwell_s"), F.lit(None).cast("long").alias("viewpoints"))
    v = viewpoints.join(passes.select(F.col("id").alias("pass_id"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")), "pass_id").where(distance_m("lat", "lon", "p_lat", "p_lon") <= near_m)
    seen = v.groupBy(F.col("pass_id").alias("id")).agg(F.count_distinct(_coordinate("lat", "lon")).alias("viewpoints"))
    top = passes.join(seen, "id", "left")
    rows = lambda df, prefix, kind, dwell, n, own: df.select(F.concat(F.lit(prefix), "id").alias("key"), F.lit(kind).alias("kind"), "lat", "lon", own.cast("double").alias("own"), F.lit(None).cast("double").alias("guess"), dwell.cast("long").alias("dwell_s"), n.cast("long").alias("viewpoints"))
    none, zero = F.lit(None), F.lit(0)
    all_ = rows(top, "pass:", "pass", zero, F.coalesce("viewpoints", zero), F.col("elev")).unionByName(rows(passes, "summit:", "pass-summit", zero, none, F.col("elev"))).unionByName(based)
    all_ = all_.unionByName(rows(sights, "poi:", "poi", 600 + F.col("size") * 60, none, none)).unionByName(rows(junctions, "junction:", "junction", zero, none, none))
    return all_.join(heights.withColumnRenamed("elev", "known"), "key", "left").select("key", "kind", "lat", "lon", F.coalesce("own", "known", "guess").alias("elev"), "dwell_s", "viewpoints")


def stable_ids(passes: DataFrame, digits: int = 6) -> DataFrame:
    """passes(id, slug, seed): the slug where one pass has it; where several do, with the first digits of a digest of each
    one's seed, and where even those agree, with the whole digest and an ordinal."""
    n = lambda *by: F.count("*").over(Window.partitionBy(*by))
    d = passes.withColumn("digest", F.md5("seed")).withColumn("same", n("slug"))
    d = d.withColumn("short", F.concat("slug", F.lit("-"), F.substring("digest", 1, digits))).withColumn("still", n("short"))
    order = F.row_number().over(Window.partitionBy("slug", "digest").orderBy("id"))
    last = F.concat("slug", F.lit("-"), "digest", F.when(order > 1, F.concat(F.lit("-"), order.cast("string"))).otherwise(""))
    return d.select("id", F.when(F.col("same") == 1, F.col("slug")).when(F.col("still") == 1, F.col("short")).otherwise(last).alias("stable"))


def route_facts(tours: DataFrame, facts: DataFrame) -> DataFrame:
    """tours(tour_id, straight_m, alpine) with the provider's facts(tour_id, distance_m, duration_s) where it has both, else the
    straight line at 55 km/h, 45 in the mountains."""
    fine = (F.col("distance_m") > 0) & (F.col("duration_s") > 0)
    j = tours.join(facts, "tour_id", "left").withColumn("given", F.coalesce(fine, F.lit(False)))
    hours = F.when(F.col("given"), F.col("duration_s") / 3600).otherwise(F.col("straight_m") / 1000 / F.when(F.col("alpine"), 45.0).otherwise(55.0))
    return j.select("tour_id", F.when(F.col("given"), "provider").otherwise("straight").alias("basis"), F.floor(F.when(F.col("given"), F.col("distance_m")).otherwise(F.col("straight_m")) + 0.5).alias("metres"), (F.floor(hours * 1000 + 0.5) / 1000).alias("hours"))


def display_stops(stops: DataFrame, places: DataFrame, tours: DataFrame, breaks: DataFrame, parts: int | None = None) -> DataFrame:
    """stops(tour_id, ord, place_id), tours(tour_id, closed, start_name, end_name), breaks(tour_id, position): the rows shown
    for each tour: its stops with their place's name (sentinels, places that are not there, are dropped), a start and an
    end for open tours, and breaks after the stop that they follow; numbered in order. All rows of a tour meet once, in one
    of `parts` partitions if they are given."""
    row = lambda role, at, name, category: (F.lit(role).alias("role"), at.cast("double").alias("at"), name.cast("string").alias("name"), category.cast("string").alias("category"))
    nil = F.lit(None)
    s = stops.join(places.select(F.col("id").alias("place_id"), "name", "category"), "place_id").select("tour_id", *row("stop", F.col("ord"), F.col("name"), F.col("category")))
    ends = F.inline(F.array(*[F.struct(*row(role, nil, F.col(f"{role}_name"), nil)) for role in ("start", "end")]))
    all_ = s.unionByName(tours.where("not closed").select("tour_id", ends)).unionByName(breaks.select("tour_id", *row("break", F.col("position"), nil, nil)))
    tour = Window.partitionBy("tour_id")
    own = F.when(F.col("role") == "stop", F.col("at"))
    span = (all_.repartition(parts, "tour_id") if parts else all_).withColumns({"low": F.min(own).over(tour), "high": F.max(own).over(tour)}).where("low is not null")
    at = F.when(F.col("role") == "start", F.col("low") - 1).when(F.col("role") == "end", F.col("high") + 1).when(F.col("role") == "break", F.least(F.greatest(F.col("at"), F.col("low")), F.col("high")) + 0.5).otherwise(F.col("at"))
    return span.withColumn("at", at).select("tour_id", "role", "name", "category", F.row_number().over(tour.orderBy("at", "role")).cast("long").alias("row"))


def waypoints(stops: DataFrame, implicit: DataFrame) -> DataFrame:
    """stops(tour_id, ord, place_id, pass_id, kind) and implicit(tour_id, pass_id, first: a position among the stops): ordered
    waypoints: entry, summit and exit of climbs, the parking of out-and-back passes, the stop itself otherwise, and passes
    that the way crosses by the way, after the stop at their position."""
    parts = F.when(F.col("kind") == "pass-climb", F.array(F.lit("entry"), F.lit("summit"), F.lit("exit"))).when(F.col("kind") == "pass-out-and-back", F.array(F.lit("parking"))).otherwise(F.array(F.lit("stop")))
    own = stops.select("tour_id", F.col("ord").cast("long").alias("ord"), F.lit(0).alias("late"), F.posexplode(parts).alias("sub", "part"), F.when(F.col("kind") == "connector", F.col("place_id")).otherwise(F.col("pass_id")).alias("ref"))
    more = implicit.select("tour_id", F.col("first").cast("long").alias("ord"), F.lit(1).alias("late"), F.lit(0).alias("sub"), F.lit("implicit").alias("part"), F.col("pass_id").alias("ref"))
    w = Window.partitionBy("tour_id").orderBy("ord", "late", "sub", "ref")
    return own.unionByName(more).select("tour_id", F.row_number().over(w).cast("long").alias("position"), "part", "ref")


def pass_features(passes: DataFrame, signals: list[str], steep: str = "elev") -> DataFrame:
    """passes(id, signals...): population z-scores of the signals (a constant one counts as spread 1), the scenic weight 0.25 +
    0.1 of their mean, from 0 to 0.5, the scenic score of ten times twice that, and themes by the strongest signals."""
    stats = passes.agg(*[F.avg(c).alias(f"m_{c}") for c in signals], *[F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"s_{c}") for c in signals])
    z = passes.withColumn("one", F.lit(1)).join(F.broadcast(stats.withColumn("one", F.lit(1))), "one")  # one row
    scores = {c: (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") for c in signals}
    r = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    z = z.select("id", *[r(F.coalesce(v, F.lit(0.0))).alias(f"z_{c}") for c, v in scores.items()])
    mean = sum((F.col(f"z_{c}") for c in signals), F.lit(0.0)) / len(signals)
    weight = r(F.least(F.lit(0.5), F.greatest(F.lit(0.0), 0.25 + 0.1 * mean)))
    themes = F.array_compact(F.array(*[F.when(F.col(f"z_{c}") >= 1, c) for c in signals]))
    return z.withColumns({"scenic_weight": weight, "scenic_score": F.floor(weight * 20 * 10 + 0.5) / 10, "themes": F.array_join(themes, ",")})


def pass_crossings(passes: DataFrame, bases: DataFrame, stops: DataFrame, summit_m: float = 1_500.0, gateway_m: float = 2_500.0) -> DataFrame:
    """Passes(id, lat, lon, open) that a tour truly crosses: a hit of its summit with hits of its two bases(pass_id, side, lat,
    lon) on opposite sides of it; planned ones are left out. Those that are not open block the tour, the others are met by
    the way. Hits are those of polyline_hits.

    Passes of the same three points (a system) cross the same tours. Systems go to the tours in blocks: where a tour is, its
    legs near a block's summits and both its sides are held against the systems. Passes are listed last, so nothing but the
    stops is shuffled, and they by tour only."""
    from waymark.functions.rounds import written
    from waymark.operators.legs import Spots, blocks_of, crossings
    from waymark.operators.spatial import CELLS, IDS, groups_of, with_next

    known = lambda df: df.where("id is not null and lat is not null and lon is not null")
    side = lambda s: known(bases.where(F.col("side") == s).select(F.col("pass_id").alias("id"), "lat", "lon")).select("id", F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}")).distinct()
    tops = known(passes).select("id", F.col("lat").alias("lat_S"), F.col("lon").alias("lon_S")).distinct()
    whole = written(tops.join(side("A").hint("merge"), "id").join(side("B").hint("merge"), "id"))
    several = whole.groupBy("id").count().where("count > 1").limit(1).count() > 0
    points = [f"{c}_{name}" for name in "SAB" for c in ("lat", "lon")]

    systems = written(whole.select(*points).distinct().withColumn("system", F.monotonically_increasing_id()))
    if several:
        open_ = whole.select("id", F.lit(None).cast("boolean").alias("open"), *points)
    else:
        open_ = whole.join(passes.select("id", "open").hint("merge"), "id")
    owners = written(open_.join(systems.hint("merge"), points).select("id", "open", "system"))
    verdict = F.when(F.col("open"), "implicit").otherwise("blocked").alias("verdict")
    owners = owners.select("id", "system", verdict)
    nth = F.row_number().over(Window.partitionBy("system", "verdict").orderBy("id"))
    members = written(owners.withColumn("part", F.floor((nth - 1) / IDS)).groupBy("system", "verdict", "part").agg(F.collect_list("id").alias("ids")).drop("part"))
    members = F.broadcast(members) if owners.count() <= 4 * CELLS else members.hint("merge")

    legs, hits = with_next(stops, "pass_id"), None
    kinds = dict(stops.dtypes)
    for t in groups_of(systems, *(f"lat_{name}" for name in "SAB")):
        at = {c: t[c].to_numpy() for c in t.column_names}
        blocks = blocks_of(*(at[c] for c in points), side_m=4 * summit_m)
        spots = [Spots(at[f"lat_{name}"], at[f"lon_{name}"], at[f"cos_lat_{name}"], reach, blocks) for name, reach in (("S", summit_m), ("A", gateway_m), ("B", gateway_m))]
        made = legs.mapInArrow(crossings(spots, [at["system"][m] for m in blocks], several), f"tour_id {kinds['tour_id']}, planned array<{kinds['pass_id']}>, system long, S long, A long, B long")
        hits = made if hits is None else hits.unionByName(made)
    position = lambda c: F.col(c).bitwiseAND((1 << 40) - 1)
    if several:  # of several places of a pass the nearest
        hits = hits.join(members, "system").select("tour_id", F.explode("ids").alias("id"), "S", "A", "B").groupBy("tour_id", "id").agg(*[F.min(c).alias(c) for c in "SAB"])
        across = (position("A") < position("S")) != (position("B") < position("S"))
        found = hits.where(across).join(stops.select("tour_id", F.col("pass_id").alias("id")).distinct(), ["tour_id", "id"], "left_anti").join(passes.select("id", "open"), "id")
        return found.select("tour_id", F.col("id").alias("pass_id"), (position("S") / 1000).alias("summit"), verdict)
    found = hits.join(members, "system").select("tour_id", "planned", (position("S") / 1000).alias("summit"), "verdict", F.explode("ids").alias("id"))
    return found.where(~F.array_contains("planned", F.col("id"))).select("tour_id", F.col("id").alias("pass_id"), "summit", "verdict")


def place_entities(places: DataFrame, cached: DataFrame) -> DataFrame:
    """places(id, name, kinds array, themes array, access array, score, minutes, protected) and cached(name, access, confidence):
    type, access modes of both, confidence (the cache's if it has one, else by score), lane, activities, and minutes."""
    j = places.join(cached.withColumnsRenamed({"access": "c_access", "confidence": "c_confidence"}), "name", "left")
    modes = F.array_sort(F.array_distinct(F.concat("access", F.when(F.col("c_access").isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.array("c_access")))))
    kind = F.when(F.col("protected"), "ProtectedArea").when(F.array_contains("kinds", "nature"), "NaturalFeature").otherwise("Place")
    lane = F.when(F.array_contains("themes", "iconic") | (F.col("score") >= 9), "iconic").when(F.array_contains("themes", "hidden-gem"), "quieter_lead")
    activity = {"nature": "hiking", "food": "eating", "museum": "visiting"}
    acts = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.array_contains("kinds", k), a) for k, a in activity.items()])))), ",")
    confidence = F.coalesce("c_confidence", F.least(F.lit(0.9), F.greatest(F.lit(0.36), F.col("score") / 10)))
    return j.select("id", kind.alias("entity_type"), F.array_join(modes, ",").alias("modes"), confidence.alias("confidence"), lane.alias("lane"), acts.alias("activities"), F.coalesce("minutes", F.lit(60)).cast("long").alias("minutes"))


def read_models(passes: DataFrame, curated: DataFrame, derived: DataFrame) -> DataFrame:
    """passes(id, name, elev, quality, confidence, bases) with the parts of its name ("A / B"), its signals, whether it can be
    planned with (a summit and both bases), and its links: curated(pass_id, rank, link) first, then derived(pass_id, rank,
    link), each link once."""
    parts = F.transform(F.split("name", "/"), lambda p: F.trim(p))
    all_ = curated.select("pass_id", F.lit(0).alias("tier"), "rank", "link").unionByName(derived.select("pass_id", F.lit(1).alias("tier"), "rank", "link"))
    first = all_.groupBy("pass_id", "link").agg(F.min(F.struct("tier", "rank")).alias("at"))
    links = first.groupBy(F.col("pass_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "link"))), lambda x: x["link"]), ",").alias("links"))
    signal = F.floor(F.col("quality") * F.coalesce("confidence", F.lit(0.5)) * 1000 + 0.5) / 1000
    return passes.join(links, "id", "left").select("id", F.element_at(parts, 1).alias("main_name"), F.try_element_at(parts, F.lit(2)).alias("other_name"), signal.alias("signal"), ((F.col("elev") > 0) & (F.col("bases") == 2)).alias("plannable"), F.coalesce("links", F.lit("")).alias("links"))
