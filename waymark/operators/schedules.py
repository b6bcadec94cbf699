"""Connections and journeys: schedules on local time, proofs in force, reasons for refusal, links and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.operators.spatial import distance_m, within

MODES = ("rail", "bus", "tram", "ferry", "boat", "cable_car", "gondola", "funicular", "cog_railway", "pickup")
#: Connection ends and points closer than this are one place.
SAME_PLACE_M = 250.0


def proven(uses: DataFrame, proofs: DataFrame) -> DataFrame:
    """uses(connection_id, day, ...) with proven: whether on that day a verified assertion about the connection's geometry
    of proofs(connection_id, field, status, observed, valid_until) is in force. One is, if of all observed by then the
    latest end is not before the day; so days of a connection are read in order once, and no use meets all proofs."""
    fine = (F.col("status") == "verified") & ((F.col("field") == "/geometry") | F.startswith("field", F.lit("/geometry/")))
    far = F.coalesce("valid_until", F.lit("9999-12-31").cast("date"))
    known = proofs.where(fine).groupBy("connection_id", F.col("observed").alias("day")).agg(F.max(far).alias("until"))
    days = uses.select("connection_id", "day").distinct()
    w = Window.partitionBy("connection_id").orderBy("day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = known.withColumn("asked", F.lit(False)).unionByName(days.select("connection_id", "day", F.lit(None).cast("date").alias("until"), F.lit(True).alias("asked")))
    held = both.withColumn("held", F.max("until").over(w)).where("asked").select("connection_id", "day", F.coalesce(F.col("held") >= F.col("day"), F.lit(False)).alias("proven"))
    return uses.join(held, ["connection_id", "day"])


def minutes(clock: Column) -> Column:
    """HH:MM as minutes of the day; null if it is not a clock time."""
    return F.when(clock.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$"), clock.substr(1, 2).cast("int") * 60 + clock.substr(4, 2).cast("int"))


def scheduled(uses: DataFrame, connections: DataFrame) -> DataFrame:
    """uses(connection_id, arrival) with the connection's fields, the local date of the arrival, and the first departure at
    or after it on that date, as minutes of the day; arrivals within a minute wait for the next full one."""
    found = uses.join(connections.withColumnRenamed("id", "connection_id").drop("lat", "lon", "lat2", "lon2"), "connection_id")
    full = F.timestamp_seconds(F.ceil(F.unix_seconds("arrival") / 60) * 60)
    local = F.from_utc_timestamp("arrival", F.coalesce("zone", F.lit("UTC")))
    boarding = F.from_utc_timestamp(full, F.coalesce("zone", F.lit("UTC")))
    minute = F.hour(boarding) * 60 + F.minute(boarding)
    times = F.transform("departures", minutes)
    strict = F.col("zone").isNotNull() & (F.size("departures") > 0) & F.forall(times, lambda t: t.isNotNull()) & (F.size(F.array_distinct(times)) == F.size(times))
    strict = strict & F.to_date(local).between(F.col("valid_from"), F.col("valid_until"))
    next_one = F.array_min(F.filter(times, lambda t: (t >= minute) & (F.to_date(boarding) == F.to_date(local))))
    return found.withColumns({"local_date": F.to_date(local), "on_schedule": F.coalesce(strict, F.lit(False)), "departure": F.when(strict, next_one)})


def usable(uses: DataFrame, connections: DataFrame, proofs: DataFrame) -> DataFrame:
    """Uses whose connection may be planned with on their day: a known mode, operating, published, verified and current
    quality without a critical flag, two different ends, a duration, a strict schedule valid on the local date, and a
    current verified assertion about its geometry. ok says so; fields of scheduled() stay."""
    all_ = proven(scheduled(uses, connections), proofs)
    ok = F.col("mode").isin(*MODES) & F.coalesce("operating", F.lit(False)) & (F.col("action") == "publish") & (F.col("verification") == "verified") & (F.col("freshness") == "current") & ~F.startswith(F.coalesce("flag", F.lit("")), F.lit("critical"))
    ok = ok & (F.col("minutes") > 0) & (F.col("end_a") != F.col("end_b")) & F.col("on_schedule") & F.col("proven")
    return all_.withColumn("ok", F.coalesce(ok, F.lit(False)))


def refusals(uses: DataFrame, connections: DataFrame, proofs: DataFrame) -> DataFrame:
    """Uses with the first reason why the connection can't take the traveller outward; null if it can."""
    all_ = proven(scheduled(uses, connections), proofs)
    code = (
        F.when(~F.col("mode").isin(*MODES), "invalid")
        .when(~F.col("direction").isin("outbound", "both"), "direction_invalid")
        .when(F.col("operating").isNull(), "operating_unknown")
        .when(~F.col("operating"), "not_operating")
        .when(F.col("zone").isNull(), "timezone_invalid")
        .when(~F.col("on_schedule"), "schedule_not_valid")
        .when(F.col("verification") != "verified", "unverified")
        .when((F.col("freshness") != "current") | F.startswith(F.coalesce("flag", F.lit("")), F.lit("critical")), "quality_not_current")
        .when(~F.col("proven"), "provenance_unverified")
        .when(F.col("departure").isNull(), "missed")
    )
    return all_.withColumn("code", code)


def chosen(refused: DataFrame) -> DataFrame:
    """refusals(): of each trip (tour_id, ord) the first that is not refused, and the reasons of those before it, in order."""
    first = F.min(F.when(F.col("code").isNull(), F.col("ord")))
    told = F.array_sort(F.collect_list(F.struct("ord", "code")))
    trips = refused.groupBy("tour_id").agg(first.alias("chosen"), told.alias("xs"))
    before = F.filter("xs", lambda x: x["code"].isNotNull() & (F.col("chosen").isNull() | (x["ord"] < F.col("chosen"))))
    return trips.select("tour_id", "chosen", F.array_join(F.transform(before, lambda x: x["code"]), ";").alias("reasons"))


def _ends(connections: DataFrame) -> DataFrame:
    """connections(id, direction, lat, lon, lat2, lon2): a row for each end."""
    end = lambda name, lat, lon: F.struct(F.lit(name).alias("end"), F.col(lat).alias("r_lat"), F.col(lon).alias("r_lon"))
    more = [c for c in connections.columns if c not in ("id", "lat", "lon", "lat2", "lon2")]
    return connections.select(F.col("id").alias("connection_id"), *more, F.explode(F.array(end("start", "lat", "lon"), end("end", "lat2", "lon2"))).alias("e")).select("connection_id", *more, "e.*")


def transport_links(points: DataFrame, connections: DataFrame, reach_m: float = SAME_PLACE_M) -> DataFrame:
    """points(id, lat, lon) with how many connections bring one there (outbound ones by their end, both ways by either) and
    how many take one back from there (return ones by their start, both ways by either)."""
    # points of a place see the same, and connections of one direction and the same ends count together
    same = connections.groupBy("direction", "lat", "lon", "lat2", "lon2").agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    near = within(points.select("lat", "lon").distinct(), _ends(same), reach_m)
    serves = (F.col("direction") == "both") | ((F.col("direction") == "outbound") & (F.col("end") == "end"))
    back = (F.col("direction") == "both") | ((F.col("direction") == "return") & (F.col("end") == "start"))
    once = near.groupBy("lat", "lon", "connection_id").agg(F.max("n").alias("n"), F.bool_or(serves).alias("serves"), F.bool_or(back).alias("back"))
    number = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    found = once.groupBy("lat", "lon").agg(number("serves").alias("outbound"), number("back").alias("inbound")).where("outbound + inbound > 0")
    return points.select("id", "lat", "lon").join(found.hint("merge"), ["lat", "lon"]).select("id", "outbound", "inbound")


def journey_options(routes: DataFrame, points: DataFrame, connections: DataFrame, reach_m: float = SAME_PLACE_M) -> DataFrame:
    """routes(id, lat, lon, lat2, lon2: start and end) with the modes of points(mode, lat, lon) at the start, sorted, and
    the way back: a loop, a connection that starts at the end, or the way one came if that is allowed (out_and_back)."""
    # places meet places: routes that start or end at one place have the same there
    modes = within(routes.select("lat", "lon").distinct(), points.select("mode", F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).distinct(), reach_m).groupBy("lat", "lon").agg(F.array_sort(F.collect_set("mode")).alias("modes"))
    back = _ends(connections.where("direction IN ('return', 'both')")).where("end = 'start' OR direction = 'both'").select("r_lat", "r_lon").distinct()
    returns = within(routes.select(F.col("lat2").alias("lat"), F.col("lon2").alias("lon")).distinct(), back, reach_m).select(F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).distinct().withColumn("served", F.lit(True))
    loop = F.floor(distance_m("lat", "lon", "lat2", "lon2") + 0.5) < 250
    way = F.when(loop, "loop").when(F.col("served"), "transport").when(F.col("retraced"), "out_and_back").otherwise("none")
    return routes.join(modes.hint("merge"), ["lat", "lon"], "left").join(returns.hint("merge"), ["lat2", "lon2"], "left").select("id", F.coalesce(F.array_join("modes", ","), F.lit("")).alias("modes"), way.alias("way_back"))
