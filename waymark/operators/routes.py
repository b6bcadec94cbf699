"""Tours: references, corridor suggestions, lunch, breaks, modes, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.rounds import written
from waymark.functions.sql import haversine, js_round
from waymark.operators import define

WALK = "(SELECT *, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM {stops} WINDOW w AS (PARTITION BY tour_id ORDER BY ord))"
STEP = f"CASE WHEN plon IS NULL THEN 0e0 ELSE {haversine('plat', 'plon', 'lat', 'lon')} END"
REFERENCE = f"(SELECT tour_id, ord, place_id, pass_id, lon, lat, kind, scenic, sum({STEP}) OVER r AS s_m, sum(duration_s) OVER r AS t_sec, sum(duration_s) OVER (PARTITION BY tour_id) AS total_s, kind = 'pass-climb' AS on_climb FROM {WALK} v WINDOW r AS (PARTITION BY tour_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"

win_cumulative_distance = define("win_cumulative_distance", "Running whole metres along each tour.", f"SELECT tour_id, ord, CAST(floor(s_m + 5e-1) AS BIGINT) AS metres FROM {REFERENCE} r")

win_route_reference = define("win_route_reference", "Distance, time rescaled to eight hours, and climb flag of each vertex.", f"SELECT tour_id, ord, CAST(floor(s_m + 5e-1) AS BIGINT) AS metres, {js_round('t_sec * 28800e0 / total_s', 1000)} AS t_sec, on_climb FROM {REFERENCE} r")

win_dedupe_vertices = define("win_dedupe_vertices", "Vertices more than a metre from the one before.", f"SELECT tour_id, ord FROM {WALK} v WHERE plon IS NULL OR {STEP} > 1e0")

win_downsample_line = define(
    "win_downsample_line", "The ends, the passes, and every third vertex of each tour.",
    "SELECT tour_id, ord FROM (SELECT tour_id, ord, kind, count(*) OVER (PARTITION BY tour_id) AS n FROM {stops}) s WHERE ord = 1 OR ord = n OR kind <> 'connector' OR ord % 3 = 0",
)

win_insertion_index = define(
    "win_insertion_index", "The stop after which a place at each tenth of the way belongs.",
    f"""SELECT tour_id, CAST(tenth AS BIGINT) AS tenth, CAST(greatest(1, max(CASE WHEN floor(s_m + 5e-1) <= floor(total_m * tenth / 10 + 5e-1) THEN ord ELSE 0 END)) AS BIGINT) AS insertion FROM (SELECT *, max(s_m) OVER (PARTITION BY tour_id) AS total_m, UNNEST(SEQ(1, 9)) AS tenth FROM {REFERENCE} r) q GROUP BY tour_id, tenth""",
)

def detour_budget(candidates: DataFrame, budget: float) -> DataFrame:
    """candidates(tour_id, poi, ord, detour, rank_score, score): greedy fill of the budget in rank order, skipping what
    does not fit. A fold over one tour's sorted candidates, which are as many as its stops; tours run side by side."""
    item = F.struct((-F.col("rank_score")).alias("a"), (-F.col("score")).alias("b"), F.col("detour").alias("c"), "ord", "poi")
    folded = candidates.groupBy("tour_id").agg(F.array_sort(F.collect_list(item)).alias("xs")).withColumn(
        "state",
        F.aggregate(
            "xs",
            F.struct(F.lit(0.0).alias("used"), F.expr("cast(array() as array<struct<ord:int,poi:bigint,kept:boolean>>)").alias("out")),
            lambda s, x: F.struct(
                F.when(s["used"] + x["c"] <= budget + 1e-9, s["used"] + x["c"]).otherwise(s["used"]).alias("used"),
                F.concat(s["out"], F.array(F.struct(x["ord"].alias("ord"), x["poi"].alias("poi"), (s["used"] + x["c"] <= budget + 1e-9).alias("kept")))).alias("out"),
            ),
        ),
    )
    return folded.select("tour_id", F.inline("state.out"))


def mmr(candidates: DataFrame, k: int, weight: float = 2.5) -> DataFrame:
    """candidates(tour_id, poi, ord, categories, rank_score, score, detour): k picks, each the best by score less weight times
    the largest Jaccard likeness of its categories to those of one picked; a fold over one tour's candidates."""
    item = F.struct((-F.col("rank_score")).alias("a"), (-F.col("score")).alias("b"), F.col("detour").alias("c"), "ord", "poi", "categories")
    one = "struct<a:double,b:double,c:double,ord:int,poi:bigint,categories:array<string>>"
    start = F.struct(F.col("xs").alias("pool"), F.expr(f"cast(array() as array<{one}>)").alias("out"))

    def likeness(x, y):
        either = F.size(F.array_union(x["categories"], y["categories"]))
        return F.when(either > 0, F.size(F.array_intersect(x["categories"], y["categories"])) / either).otherwise(0.0)

    def pick(s, _):
        like = lambda x: F.coalesce(F.array_max(F.transform(s["out"], lambda y: likeness(x, y))), F.lit(0.0)) * weight
        # a lambda's own variable is computed once, and not again for each of the pool
        best = F.array_min(F.transform(s["pool"], lambda x: F.struct(F.round(x["a"] + like(x), 9).alias("v"), x.alias("x"))))
        rest = lambda b: F.filter(s["pool"], lambda x: ~((x["ord"] == b["x"]["ord"]) & (x["poi"] == b["x"]["poi"])))
        picked = F.transform(F.array(best), lambda b: F.struct(rest(b).alias("pool"), F.concat(s["out"], F.array(b["x"])).alias("out")))
        return F.when(F.size(s["pool"]) == 0, s).otherwise(picked[0])

    # one of the k best is always left, and loses no more than the weight: what is farther behind them is never picked
    last = lambda xs: F.try_element_at(xs, F.least(F.size(xs), F.lit(k)))["a"] + abs(weight) + 1e-6
    near = F.transform(F.array(F.array_sort("xs")), lambda xs: F.filter(xs, lambda x: F.coalesce(x["a"] <= last(xs), F.lit(True))))[0]
    pools = candidates.groupBy("tour_id").agg(F.collect_list(item).alias("xs")).withColumn("xs", near)
    folded = pools.withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, pick))
    return folded.select("tour_id", F.posexplode("state.out").alias("at", "x")).select("tour_id", (F.col("at") + 1).cast("long").alias("place"), "x.ord", "x.poi")


def path_from_edges(edges: DataFrame) -> DataFrame:
    """edges(tour_id, ord, edge_id like "12->7"): the nodes of each tour's path in order, without immediate repeats."""
    ends = F.split("edge_id", "->")
    nodes = edges.select("tour_id", "ord", F.posexplode(F.transform(ends, lambda x: x.cast("long"))).alias("side", "node"))
    w = Window.partitionBy("tour_id").orderBy("ord", "side")
    fresh = nodes.withColumn("before", F.lag("node").over(w)).where("before is null or before <> node")
    return fresh.select("tour_id", F.row_number().over(w).cast("long").alias("position"), "node")


def implicit_passes(path: DataFrame, planned: DataFrame, passes: DataFrame) -> DataFrame:
    """Passes among the nodes of each tour's path(tour_id, position, node) that are not planned(tour_id, pass_id), and where
    the path first meets them."""
    on_path = path.join(passes.select(F.col("id").alias("node")).hint("merge"), "node").groupBy("tour_id", F.col("node").alias("pass_id")).agg(F.min("position").alias("first"))
    return on_path.join(planned.select("tour_id", "pass_id").distinct(), ["tour_id", "pass_id"], "left_anti").select("tour_id", "pass_id", "first")


agg_itinerary_totals = define("agg_itinerary_totals", "Distance and time of each tour by mode.", "SELECT tour_id, kind, CAST(sum(distance_m) AS BIGINT) AS metres, CAST(sum(duration_s) AS BIGINT) AS seconds, count(*) AS legs FROM {stops} GROUP BY tour_id, kind")

agg_budget_fit = define("agg_budget_fit", "Used and remaining budget, ratio, and whether it is within the target.", f"SELECT tour_id, {js_round('sum(duration_s) / 3600', 1000)} AS used_h, {js_round('8e0 - sum(duration_s) / 3600', 1000)} AS left_h, sum(duration_s) <= 28800 AS within, abs(sum(duration_s) - 7200) <= 1800 AS in_range FROM {{stops}} GROUP BY tour_id")

agg_tour_score = define("agg_tour_score", "Weighted score of each tour from its sums.", f"SELECT tour_id, {js_round('sum(CAST(floor(scenic * 1e6 + 5e-1) AS BIGINT)) / 1e6 * 12e-1 + count(DISTINCT place_id) * 5e-1 - sum(duration_s) / 36e2 * 3e-1 - (count(*) - count(DISTINCT pass_id)) * 75e-2', 1000)} AS score FROM {{stops}} GROUP BY tour_id")

agg_retrace_counts = define(
    "agg_retrace_counts", "Connectors used again in either direction, and stops left by the side they were entered.",
    """SELECT tour_id, CAST(sum(n) - count(*) AS BIGINT) AS retraced, CAST(sum(back) AS BIGINT) AS out_and_back FROM (SELECT tour_id, least(place_id, nxt) AS a, greatest(place_id, nxt) AS b, count(*) AS n, count_if(pass_id = before) AS back FROM (SELECT tour_id, place_id, pass_id, lead(place_id) OVER w AS nxt, lag(pass_id) OVER w AS before FROM {stops} WINDOW w AS (PARTITION BY tour_id ORDER BY ord)) l WHERE nxt IS NOT NULL GROUP BY tour_id, least(place_id, nxt), greatest(place_id, nxt)) p GROUP BY tour_id""",
)

agg_extras = define("agg_extras", "Stop, lunch and rest hours of each tour.", f"SELECT tour_id, {js_round('count(*) * 15 / 60e0', 1000)} AS stop_h, CASE WHEN sum(duration_s) > 14400 THEN 1e0 ELSE 0e0 END AS lunch_h, CAST(greatest(0, ceil(sum(duration_s) / 7200e0) - 1) AS DOUBLE) * 25e-2 AS rest_h FROM {{stops}} GROUP BY tour_id")

proj_route_modes = define(
    "proj_route_modes", "First and last place of each pass on each tour, and whether the pass is crossed or left as entered.",
    "SELECT tour_id, pass_id, min_by(place_id, ord) AS entry, max_by(place_id, ord) AS exit, CASE WHEN count(*) > 1 AND min_by(place_id, ord) <> max_by(place_id, ord) THEN 'traverse' ELSE 'out-and-back' END AS mode FROM {stops} GROUP BY tour_id, pass_id",
)

win_viewpoint_choice = define("win_viewpoint_choice", "Best viewpoint of each pass on a tour above the threshold, else the first stop.", "SELECT tour_id, pass_id, place_id, r = 1 AND scenic >= 25e-2 AS is_viewpoint FROM (SELECT *, row_number() OVER (PARTITION BY tour_id, pass_id ORDER BY CASE WHEN scenic >= 25e-2 THEN scenic ELSE 0 END DESC, ord) AS r FROM {stops}) s WHERE r = 1")

win_largest_remainder = define(
    "win_largest_remainder", "Ten shaping points of each tour, dealt to its legs by largest remainder, at most three each.",
    """SELECT tour_id, ord, CAST(least(3, base + CASE WHEN r <= 10 - used THEN 1 ELSE 0 END) AS BIGINT) AS points FROM (SELECT *, row_number() OVER (PARTITION BY tour_id ORDER BY share - base DESC, ord) AS r, sum(base) OVER (PARTITION BY tour_id) AS used FROM (SELECT tour_id, ord, floor(share) AS base, floor(share * 1e6) / 1e6 AS share FROM (SELECT tour_id, ord, distance_m * 10 / sum(distance_m) OVER (PARTITION BY tour_id) AS share FROM {stops}) a) b) c""",
)

win_line_curvature = define(
    "win_line_curvature", "Heading change of each tour per km, from the bearings of its legs.",
    f"""SELECT tour_id, count(*) AS turns, {js_round("sum(abs(turn)) / greatest(1e0, sum(floor(step_m + 5e-1)) / 1e3)", 1000)} AS per_km FROM (
        SELECT tour_id, step_m, atan2(sin(b - pb), cos(b - pb)) AS turn FROM (SELECT tour_id, step_m, b, lag(b) OVER (PARTITION BY tour_id ORDER BY ord) AS pb FROM (SELECT tour_id, ord, {STEP} AS step_m, atan2((lon - plon) * cos(radians(lat)), lat - plat) AS b FROM {WALK} v WHERE plon IS NOT NULL AND (plon <> lon OR plat <> lat)) x) y WHERE pb IS NOT NULL) z GROUP BY tour_id""",
)



def ranked(column: str, source: str = "{passes}", steps: int = 50) -> str:
    """source with mid_rank and place of a column in rising order: rows are counted by bucket of the value, then ranked
    within their bucket, so that no task sorts the whole table."""
    cell = f"CAST(floor({column} * {steps}) AS BIGINT)"
    return f"(SELECT x.*, b.before + rank() OVER (PARTITION BY x.cell ORDER BY x.{column}) + (count(*) OVER (PARTITION BY x.cell, x.{column}) - 1) / 2e0 AS mid_rank, b.before + row_number() OVER (PARTITION BY x.cell ORDER BY x.{column}, x.id) AS place FROM (SELECT *, {cell} AS cell FROM {source} z) x JOIN (SELECT {cell} AS cell, sum(count(*)) OVER (ORDER BY {cell}) - count(*) AS before FROM {source} z GROUP BY {cell}) b ON b.cell = x.cell)"


agg_spearman = define(
    "agg_spearman", "Rank correlation of quality and elevation by mid-ranks.",
    f"""SELECT floor(corr(q.mid_rank, e.mid_rank) * 1e6 + 5e-1) / 1e6 AS rho, count(*) AS n FROM {ranked("quality")} q JOIN {ranked("elev", steps=1)} e ON e.id = q.id""",
)

agg_quantile = define(
    "agg_quantile", "Interpolated quartile of prices by category: counted by range of the price, then ranked within the ranges that hold it.",
    "SELECT category, floor((lo + (hi - lo) * frac) * 1e6 + 5e-1) / 1e6 AS q3 FROM (SELECT category, max(CASE WHEN r = floor((n - 1) * 75e-2) + 1 THEN price END) AS lo, max(CASE WHEN r = least(n, floor((n - 1) * 75e-2) + 2) THEN price END) AS hi, max((n - 1) * 75e-2 - floor((n - 1) * 75e-2)) AS frac FROM (SELECT p.category, p.price, b.n, b.before + row_number() OVER (PARTITION BY p.category, p.cell ORDER BY p.price, p.id) AS r FROM (SELECT *, floor(price) AS cell FROM {places}) p JOIN (SELECT *, sum(m) OVER (PARTITION BY category) AS n, sum(m) OVER (PARTITION BY category ORDER BY cell) - m AS before FROM (SELECT category, floor(price) AS cell, count(*) AS m FROM {places} GROUP BY category, floor(price)) c) b ON b.category = p.category AND b.cell = p.cell WHERE b.before + b.m >= floor((b.n - 1) * 75e-2) + 1 AND b.before <= floor((b.n - 1) * 75e-2) + 2) s GROUP BY category) q",
)

agg_best_edge = define("agg_best_edge", "The cheapest edge of each undirected pair.", "SELECT least(a, b) AS low, greatest(a, b) AS high, min(cost) AS cost, count(*) AS n FROM {edges} GROUP BY least(a, b), greatest(a, b)")

graph_adjacency = define("graph_adjacency", "Degrees and the least cost for each metre of each node.", "SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, floor(min(c) * 1e9 + 5e-1) / 1e9 AS least_cost FROM (SELECT a AS node, 1 AS o, 0 AS i, cost / distance_m AS c FROM {edges} UNION ALL SELECT b, 0, 1, cost / distance_m FROM {edges}) e GROUP BY node")

agg_calibrate = define(
    "agg_calibrate", "Correlation of quality with elevation and the share of high passes in the top quarter, against thresholds.",
    """SELECT floor(corr(quality, elev) * 1e6 + 5e-1) / 1e6 AS r, floor(count_if(top AND elev > 2500) * 1e6 / nullif(count_if(elev > 2500), 0) + 5e-1) / 1e6 AS hero_share, count_if(top AND elev > 2500) * 2 >= count_if(elev > 2500) AS passed FROM (SELECT quality, elev, place > (SELECT floor(count(*) * 75e-2) FROM {passes}) AS top FROM RANKED_BY_QUALITY p) p""".replace("RANKED_BY_QUALITY", ranked("quality")),
)

proj_pass_edges = define(
    "proj_pass_edges", "Costed edges of each pass: climb, descent at 0.85, out-and-back at 1.6 with a margin.",
    """SELECT id, side, kind, floor(d * mult * (1e0 - scenic) * (CASE kind WHEN 'descent' THEN 85e-2 WHEN 'out-and-back' THEN 168e-2 ELSE 1e0 END) * 1e3 + 5e-1) / 1e3 AS cost FROM (SELECT id, side, kind, (elev - 600) * 1.5e0 AS d, CASE WHEN elev > 2000 THEN 85e-2 ELSE 9e-1 END AS mult, least(5e-1, greatest(0e0, quality / 2)) AS scenic FROM (SELECT *, UNNEST(ARR('climb', 'descent', 'out-and-back')) AS kind FROM (SELECT *, UNNEST(ARR('A', 'B')) AS side FROM {passes}) a) p) e""",
)

join_price_cache = define("join_price_cache", "Places with the price cached for their name, and names without one.", "SELECT p.id, c.price AS cached, c.price IS NULL AS missing FROM {places} p LEFT JOIN (SELECT name, min(price) AS price FROM {places} WHERE size > 45 GROUP BY name) c ON c.name = p.name")

join_price_refresh = define("join_price_refresh", "Prices after a refresh: only refreshable rows in the accepted currency change.", "SELECT p.id, CASE WHEN p.size % 2 = 0 AND c.currency = 'CHF' THEN c.amount ELSE p.price END AS price, p.size % 2 = 0 AND coalesce(c.currency = 'CHF', FALSE) AS refreshed FROM {places} p LEFT JOIN (SELECT id, price + 10 AS amount, currency FROM {places} WHERE size % 3 <> 0) c ON c.id = p.id")

proj_price_entity = define("proj_price_entity", "Price rows: kind, amount, currency fallback, confidence.", "SELECT id, CASE WHEN family = 'museum' THEN 'admission' WHEN family = 'food' THEN 'meal' ELSE 'parking' END AS kind, price AS amount, coalesce(currency, 'CHF') AS currency, CASE WHEN currency IS NULL THEN 3e-1 ELSE 7e-1 END AS confidence FROM {places} WHERE price > 0")

proj_parking_entity = define("proj_parking_entity", "Parking points: the cached position before the raw one.", "SELECT p.id, coalesce(c.lon, p.lon) AS lon, coalesce(c.lat, p.lat) AS lat, c.lon IS NOT NULL AS cached FROM {places} p LEFT JOIN (SELECT name, min(lon) AS lon, min(lat) AS lat FROM {places} WHERE size > 45 GROUP BY name) c ON c.name = p.name WHERE p.family <> 'food'")

proj_pass_entity = define("proj_pass_entity", "A natural feature for each pass and up to two gateways.", "SELECT 'pass:' || CAST(id AS STRING) AS id, 'NaturalFeature' AS entity_type, lon, lat FROM {passes} UNION ALL SELECT 'gate:' || CAST(id AS STRING) || ':' || side, 'AccessPoint', lon + CASE side WHEN 'A' THEN -6e-2 ELSE 6e-2 END, lat FROM (SELECT *, UNNEST(ARR('A', 'B')) AS side FROM {passes}) p WHERE NOT (side = 'B' AND closes IS NULL AND elev < 1000)")

proj_drive_entity = define("proj_drive_entity", "Drives of tours: number of waypoints, and loops whose ends are under 250 m apart.", f"SELECT tour_id, count(*) AS waypoints, count(*) > 2 AND CAST(floor({haversine('min_by(lat, ord)', 'min_by(lon, ord)', 'max_by(lat, ord)', 'max_by(lon, ord)')} + 5e-1) AS BIGINT) < 250 AS is_loop FROM {{stops}} GROUP BY tour_id")

win_leg_timeline = define("win_leg_timeline", "Start and end of each leg in seconds, with a five-minute transfer after each.", "SELECT tour_id, ord, CAST(t - duration_s + (ord - 1) * 300 AS BIGINT) AS starts, CAST(t + (ord - 1) * 300 AS BIGINT) AS ends FROM (SELECT tour_id, ord, duration_s, sum(duration_s) OVER (PARTITION BY tour_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM {stops}) s")

def _tours(stops: DataFrame, *aggregates: Column) -> DataFrame:
    """Tours with their first day and a digest of 256 bits of all their places in order."""
    route = F.transform(F.array_sort(F.collect_list(F.struct("ord", "place_id"))), lambda s: s["place_id"])
    tours = stops.groupBy("tour_id").agg(F.unix_date(F.min("day")).cast("long").alias("day"), route.alias("route"), *aggregates)
    return tours.withColumn("signature", F.sha2(F.to_json("route"), 256)).drop("route")


def _first_three(tours: DataFrame, same: list[str], best: list) -> DataFrame:
    """The best tour of each signature, then the three best of each day."""
    kept = tours.withColumn("s", F.row_number().over(Window.partitionBy(*same).orderBy(*best))).where("s = 1")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("day").orderBy(*best)).cast("long")).where("rank <= 3")


def alternatives(stops: DataFrame) -> DataFrame:
    """Distinct routes of each day, those of most stops first, three at most."""
    return _first_three(_tours(stops, F.count("*").alias("n")), ["day", "signature"], [F.desc("n"), "tour_id"]).select("day", "tour_id", "rank")


def tour_archive(stops: DataFrame) -> DataFrame:
    """The best tour of each route, then the three best of each day."""
    score = F.floor(F.sum(F.floor(F.col("scenic") * 1e6 + 0.5)) / 1e3 + 0.5) / 1e3  # whole numbers add up alike in any order
    return _first_three(_tours(stops, score.alias("score")), ["signature"], [F.desc("score"), "tour_id"]).select("day", "tour_id", "score", "rank")


def rest_assignment(stops: DataFrame, rests: int = 2) -> DataFrame:
    """Spreads rests evenly over each tour's stops: each to the nearest unused stop, better scenery on ties. A fold."""
    item = F.struct("ord", (-F.col("scenic")).alias("s"))
    listed = stops.groupBy("tour_id").agg(F.array_sort(F.collect_list(item)).alias("xs"), F.count("*").alias("n"))
    targets = F.transform(F.sequence(F.lit(1), F.lit(rests)), lambda i: i * (F.col("n") + 1) / (rests + 1))

    def place(used, target):
        free = F.filter("xs", lambda x: ~F.array_contains(used, x["ord"]))
        best = F.try_element_at(F.array_sort(F.transform(free, lambda x: F.struct(F.abs(x["ord"] - target).alias("d"), x["s"].alias("s"), x["ord"].alias("ord")))), F.lit(1))
        return F.when(F.size(free) > 0, F.concat(used, F.array(best["ord"]))).otherwise(used)

    chosen = F.aggregate(targets, F.expr("cast(array() as array<int>)"), place)
    return listed.select("tour_id", F.posexplode(chosen).alias("at", "ord")).select("tour_id", (F.col("at") + 1).cast("long").alias("rest"), "ord")


def waypoint_snap(track: DataFrame) -> DataFrame:
    """Waypoints (every stop's rounded position) to vertices of their own polyline, each not before the previous. A fold."""
    item = F.struct("ord", "lat", "lon")
    listed = track.groupBy("tour_id").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def snap(s, w):
        ahead = F.filter("xs", lambda x: x["ord"] >= s["at"])
        best = F.try_element_at(F.array_sort(F.transform(ahead, lambda x: F.struct((F.pow(x["lat"] - F.floor(w["lat"] * 10) / 10, 2) + F.pow(x["lon"] - F.floor(w["lon"] * 10) / 10, 2)).alias("d"), x["ord"].alias("ord")))), F.lit(1))
        return F.struct(best["ord"].alias("at"), F.concat(s["out"], F.array(best["ord"])).alias("out"))

    state = F.aggregate("xs", F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<int>)").alias("out")), snap)
    return listed.select("tour_id", F.posexplode(state["out"]).alias("at", "vertex")).select("tour_id", (F.col("at") + 1).cast("long").alias("waypoint"), "vertex")


def _hull(pts: list[tuple[float, float]], pad: float) -> tuple[int, float]:
    """Corner count and area of the padded hull of distinct, sorted points."""

    def half(points):
        out = []
        for p in points:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1]) if len(pts) > 2 else []
    if len(ring) < 3:
        (x1, y1), (x2, y2) = pts[0], pts[-1]
        if len(pts) == 1:
            ring = [(x1 - pad, y1), (x1, y1 - pad), (x1 + pad, y1), (x1, y1 + pad)]
        else:
            west, east, south, north = min(x1, x2) - pad, max(x1, x2) + pad, min(y1, y2) - pad, max(y1, y2) + pad
            ring = [(west, south), (east, south), (east, north), (west, north)]
    return len(ring), abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def zone_hulls(stops: DataFrame, pad: float = 0.002) -> DataFrame:
    """Padded convex hull of each tour's stops, as corner count and area; a diamond for one point, a rectangle for two or
    for points on a line. A tour's stops are a bounded group, gathered as one array; many tours go to Python at once."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            made = [_hull([(p["x"], p["y"]) for p in ps], pad) for ps in frame["ps"]]
            yield pd.DataFrame({"tour_id": frame["tour_id"], "corners": [m[0] for m in made], "area": [round(m[1], 9) for m in made]})

    point = F.struct(F.round("lon", 6).alias("x"), F.round("lat", 6).alias("y"))
    gathered = stops.groupBy("tour_id").agg(F.array_sort(F.collect_set(point)).alias("ps"))
    return gathered.mapInPandas(run, "tour_id long, corners long, area double")


def overlay_clusters(items: DataFrame, zoom: int = 8, radius: int = 64) -> DataFrame:
    """items(id, lon, lat, planned if there is one) in grid cells of world pixels with count and centroid; planned items
    stay single. Adjoining cells whose centroids are within 0.92 of the radius are joined, the closest first, where no
    item of the two clusters is then farther than 0.7 of the radius from the centre. Each round tries every link that
    comes before all others of both its clusters, which gives what trying them one by one would. Joins are merges: a
    broadcast would pass what is written in few bytes through the driver in each round."""
    size = 256 * 2**zoom
    x = (F.col("lon") + 180) / 360 * size
    s = F.sin(F.radians(F.greatest(F.lit(-85.05), F.least(F.lit(85.05), F.col("lat")))))
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * 3.141592653589793)) * size
    planned = F.coalesce("planned", F.lit(False)) if "planned" in items.columns else F.lit(False)
    placed = items.select("id", x.alias("x"), y.alias("y"), planned.alias("planned"))
    placed = placed.withColumns({"cx": F.floor(F.col("x") / radius), "cy": F.floor(F.col("y") / radius)}).withColumn("key", F.concat_ws(",", "cx", "cy"))
    cells = written(placed.where("not planned").groupBy("key", "cx", "cy").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.min("id").alias("first")))

    around = F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("cx"), (F.col("cy") + dy).alias("cy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]))
    mine = cells.select(F.col("key").alias("a"), (F.col("sx") / F.col("n")).alias("ax"), (F.col("sy") / F.col("n")).alias("ay"), around.alias("at")).select("a", "ax", "ay", "at.*")
    links = mine.join(cells.hint("merge"), ["cx", "cy"]).where("a < key").withColumn("d", F.hypot(F.col("ax") - F.col("sx") / F.col("n"), F.col("ay") - F.col("sy") / F.col("n"))).where(F.col("d") <= radius * 0.92)
    links = written(links.select("d", "a", F.col("key").alias("b"), F.col("a").alias("ra"), F.col("key").alias("rb")))

    linked = links.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    points = written(placed.where("not planned").join(linked.hint("merge"), "key", "left_semi").select("key", "x", "y"))
    lone = cells.join(linked.hint("merge"), "key", "left_anti").withColumn("root", F.col("key"))
    members = written(cells.join(linked.hint("merge"), "key", "left_semi").select("key", F.col("key").alias("root"), "n", "sx", "sy", "first"))
    place, sides = F.struct("d", "a", "b"), F.explode(F.array("ra", "rb"))
    while links.limit(1).count():
        least = links.select(sides.alias("root"), place.alias("least")).groupBy("root").agg(F.min("least").alias("least"))
        for end in ("ra", "rb"):
            least_of = least.select(F.col("root").alias(end), F.col("least").alias(f"least_{end}"))
            links_least = (links if end == "ra" else links_least).join(least_of.hint("merge"), end)
        ready = links_least.where((place == F.col("least_ra")) & (place == F.col("least_rb"))).select("a", "b", "ra", "rb", sides.alias("root"))
        both = Window.partitionBy("a", "b")
        sums = members.groupBy("root").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
        centred = ready.join(sums.hint("merge"), "root").withColumns({"mx": F.sum("sx").over(both) / F.sum("n").over(both), "my": F.sum("sy").over(both) / F.sum("n").over(both)})
        spread = centred.select("a", "b", "ra", "rb", "root", "mx", "my").join(members.select("root", "key").hint("merge"), "root").join(points.hint("merge"), "key")
        tried = written(spread.groupBy("a", "b", "ra", "rb").agg((F.max(F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))) <= radius * 0.7).alias("fits")))
        moved = tried.where("fits").select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("into"))
        members = written(members.join(moved.hint("merge"), "root", "left").select("key", F.coalesce("into", "root").alias("root"), "n", "sx", "sy", "first"))
        links = links.join(tried.select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        for end in ("ra", "rb"):
            links = links.join(moved.withColumnsRenamed({"root": end, "into": "into_" + end}).hint("merge"), end, "left").withColumn(end, F.coalesce("into_" + end, end))
        links = written(links.where("ra <> rb").select("d", "a", "b", "ra", "rb"))
    whole = members.unionByName(lone.select(*members.columns)).groupBy("root").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sy").alias("sy"))
    pixel = lambda v: F.floor(v + 0.5)
    groups = whole.select("first", "n", pixel(F.col("sx") / F.col("n")).alias("px"), pixel(F.col("sy") / F.col("n")).alias("py"))
    return groups.unionByName(placed.where("planned").select(F.col("id").alias("first"), F.lit(1).cast("long").alias("n"), pixel(F.col("x")).alias("px"), pixel(F.col("y")).alias("py")))


def retrace_overlap(stops: DataFrame, step_m: int = 200, near_m: float = 100.0, least_m: int = 800, buffer_m: float = 350.0) -> DataFrame:
    """Pairs of legs of one tour that run along each other for least_m or more. Tours are sampled every step_m of their
    length, a stop belongs to the leg after it; each pair of samples of two legs in the same or adjoining cells of 0.001
    degrees and within near_m counts step_m, but not within buffer_m of the stop that neighbours share. Legs are straight,
    so a leg never retraces itself. Samples are not all made: which ones of two legs can be in adjoining cells follows
    from linear inequalities, and only those are listed and tested exactly, for pairs that can have enough of them."""
    from waymark.operators.legs import REAL, WHOLE, Retraces
    from waymark.operators.spatial import distance_m, line_segments

    legs = line_segments(stops.where("tour_id is not null")).withColumn("length", distance_m("lat", "lon", "lat2", "lon2"))
    kinds = dict(stops.dtypes)
    ids = f"tour_id {kinds['tour_id']}, ord {kinds['ord']}, other {kinds['ord']}"
    steps = Retraces(step_m, near_m, least_m, buffer_m)
    pairs = legs.sortWithinPartitions("tour_id", "ord").mapInArrow(steps.pairs, ", ".join([ids, *(f"{c} long" for c in WHOLE), *(f"{c} double" for c in REAL)]))
    # what is left is dealt out anew: a pair of legs may list many samples, and pairs are few bytes
    pairs = pairs.repartition(4 * int(stops.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "tour_id", "ord", "other")
    return pairs.mapInArrow(steps.counts, f"{ids}, metres long")
