"""Queries over drives, lunch, breaks, the corridor and connections, and plain SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.rounds import written
from waymark.functions.sql import EARTH_KM, haversine
from waymark.operators import drives, routes, schedules

H = haversine
HAV = haversine("p.lat", "p.lon", "v.lat", "v.lon", EARTH_KM).replace("6371e0", "6371e3")


def nearest_sql(reach: float, cond: str, track: str = "{track}") -> str:
    """The nearest vertex of each tour to each sight as a plain inequality join; the latitude box only spares DuckDB work."""
    return f"""SELECT tour_id, id, ord, m FROM (SELECT v.tour_id, p.id, v.ord, floor({HAV} + 5e-1) AS m, row_number() OVER (PARTITION BY v.tour_id, p.id ORDER BY floor({HAV} + 5e-1), v.ord) AS r
        FROM {{sights}} p JOIN {track} v ON abs(p.lat - v.lat) <= {reach / 110e3:.4f} AND {HAV} <= {reach:.0f} WHERE {cond}) k WHERE r = 1"""


SEG = """seg AS (SELECT *, start_s + duration_s AS end_s FROM (SELECT *, coalesce(sum(duration_s) OVER p, 0) AS start_s, coalesce(sum(duration_s + dwell_s) OVER p, 0) AS clock_s, coalesce(sum(CASE WHEN dwell_s >= 900 THEN 1 ELSE 0 END) OVER p, 0) AS segment
    FROM {drive_edges} WINDOW p AS (PARTITION BY tour_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) e)"""
METRICS = f"""{SEG}, met AS (SELECT tour_id, segment, count(*) AS legs, min(ord) AS first_ord, min(clock_s) AS clock_s, sum(duration_s) AS duration_s, sum(distance_m) AS distance_m, floor(sum(floor(scenic * 100 + 5e-1) * duration_s) / (100 * sum(duration_s)) * 1e6 + 5e-1) / 1e6 AS scenic,
    floor(sum(floor(straight * 100 + 5e-1) * duration_s) / (100 * sum(duration_s)) * 1e6 + 5e-1) / 1e6 AS straight, floor(sum(floor(curvature * 100 + 5e-1) * duration_s) / (100 * sum(duration_s)) * 1e6 + 5e-1) / 1e6 AS curvature, floor(sum(gain_m) / greatest(1e-3, sum(distance_m) / 1000) * 1e3 + 5e-1) / 1e3 AS gain_per_km,
    floor(coalesce(sum(distance_m) FILTER (road_class IN ('motorway', 'trunk')), 0) / sum(distance_m) * 1e6 + 5e-1) / 1e6 AS motorway_share FROM seg GROUP BY tour_id, segment)"""
LOAD = f"""{METRICS}, cut AS (SELECT *, unnest(range(CAST(ceil(duration_s / 600) AS BIGINT))) AS chunk FROM met), timed AS (SELECT *, least(600, duration_s - 600 * chunk) AS chunk_s, 600 * chunk + least(600, duration_s - 600 * chunk) AS done FROM cut),
    clocked AS (SELECT *, CAST(floor((28800 + clock_s + done) / 60) AS BIGINT) % 1440 AS minute, chunk_s / 60 * straight * (1 - scenic) AS boredom, chunk_s / 60 * curvature * greatest(0, gain_per_km - 30) / 100 AS effort FROM timed),
    loads AS (SELECT tour_id, segment, chunk, chunk_s, floor((first_ord + legs * done / duration_s) * 1e3 + 5e-1) / 1e3 AS position, floor(boredom * 1e3 + 5e-1) / 1e3 AS boredom, floor(effort * 1e3 + 5e-1) / 1e3 AS effort, floor((boredom + effort + 4e-1 * greatest(0, 1 - abs(minute - 870) / 75) + 2e-1 * greatest(0, 1 - abs(minute - 1020) / 60)) * 1e3 + 5e-1) / 1e3 AS load FROM clocked)"""
CURVE = f"""{SEG}, tours AS (SELECT tour_id, sum(duration_s) AS total, list_extract(list_sort(list(scenic)), CAST(floor((count(*) - 1) * 9e-1) AS INT) + 1) AS threshold FROM seg GROUP BY tour_id),
    marks AS (SELECT *, row_number() OVER (PARTITION BY tour_id ORDER BY t) - 1 AS step FROM (SELECT tour_id, total, threshold, unnest(range(0, CAST(greatest(1, total) AS BIGINT), 300)) AS t FROM tours UNION ALL SELECT tour_id, total, threshold, CAST(total AS BIGINT) FROM tours) m),
    here AS (SELECT m.tour_id, m.step, m.t, m.threshold, first(s.scenic ORDER BY s.ord) FILTER (m.t BETWEEN s.start_s AND s.end_s) AS scenic, bool_or(s.gain_m >= 800 AND m.t BETWEEN s.end_s AND s.end_s + 2700) AS tired FROM marks m JOIN seg s ON s.tour_id = m.tour_id GROUP BY m.tour_id, m.step, m.t, m.threshold),
    curve AS (SELECT tour_id, step, t AS t_sec, floor(greatest(0, exp(-5e-1 * pow((480 + floor(t / 60) - 750) / 30, 2)) + greatest(0, least(1, (t / 3600 - 4) / 2)) * 55e-2 + CASE WHEN tired THEN 3e-1 ELSE 0 END + CASE WHEN scenic >= threshold THEN -2e-1 ELSE 0 END) * 1e4 + 5e-1) / 1e4 AS need FROM here)"""
LUNCH = f"""{CURVE}, top AS (SELECT tour_id, max(need) AS peak, arg_max(step, (need, -step)) AS at, arg_max(t_sec, (need, -step)) AS peak_s FROM curve GROUP BY tour_id),
    low AS (SELECT c.tour_id, t.at, max(c.step) FILTER (c.step < t.at AND c.need < t.peak / 2) AS before, min(c.step) FILTER (c.step > t.at AND c.need < t.peak / 2) AS after FROM curve c JOIN top t ON t.tour_id = c.tour_id GROUP BY c.tour_id, t.at),
    win AS (SELECT c.tour_id, min(c.t_sec) AS from_s, max(c.t_sec) AS to_s, max(t.peak_s) AS peak_s FROM curve c JOIN low l ON l.tour_id = c.tour_id AND c.step > coalesce(l.before, -1) AND c.step < coalesce(l.after, 1000000) JOIN top t ON t.tour_id = c.tour_id GROUP BY c.tour_id)"""
FOOD = f"""{LUNCH}, span AS (SELECT v.*, w.from_s, w.to_s, w.peak_s FROM {{track}} v JOIN win w ON w.tour_id = v.tour_id AND v.t_sec BETWEEN w.from_s AND w.to_s),
    food AS (SELECT n.tour_id, n.id AS poi, n.ord, CAST(n.m AS BIGINT) AS metres, floor(n.m / 500 * 2 * 100 + 5e-1) / 100 AS detour_min, abs(s.t_sec - s.peak_s) / 60 AS drift_min, s.t_sec, s.from_s, s.to_s, s.scenic, p.lat, p.lon, p.score, p.categories FROM ({nearest_sql(8000, "p.family = 'food'", "span")}) n JOIN span s ON s.tour_id = n.tour_id AND s.ord = n.ord JOIN {{sights}} p ON p.id = n.id)"""
AVG = "floor({} * 1000 + 5e-1)"
ZONES = f"""{FOOD}, link AS (SELECT a.tour_id, a.poi AS a, b.poi AS b FROM food a JOIN food b ON b.tour_id = a.tour_id AND {H("a.lat", "a.lon", "b.lat", "b.lon")} <= 4000), reach(tour_id, poi, seen) AS (SELECT tour_id, poi, poi FROM food UNION SELECT r.tour_id, r.poi, l.b FROM reach r JOIN link l ON l.tour_id = r.tour_id AND l.a = r.seen),
    zone AS (SELECT tour_id, poi, min(seen) AS zone FROM reach GROUP BY tour_id, poi), zoned AS (SELECT f.*, z.zone FROM food f JOIN zone z ON z.tour_id = f.tour_id AND z.poi = f.poi),
    mix AS (SELECT tour_id, zone, k, count(*) AS n, sum(count(*)) OVER (PARTITION BY tour_id, zone) AS total FROM (SELECT tour_id, zone, unnest(categories) AS k FROM zoned) c GROUP BY tour_id, zone, k),
    ent AS (SELECT tour_id, zone, CASE WHEN count(*) <= 1 THEN 0 ELSE floor(sum(-n / total * ln(n / total)) / ln(count(*)) * 1e6 + 5e-1) / 1e6 END AS entropy FROM mix GROUP BY tour_id, zone),
    climax AS (SELECT tour_id, arg_max(end_s, (floor(scenic * 100 + 5e-1) + CASE WHEN kind = 'pass-climb' THEN 25 ELSE 0 END, -end_s)) AS climax_s FROM seg GROUP BY tour_id),
    agg AS (SELECT tour_id, zone, count(*) AS n, {", ".join(f"sum({AVG.format(x)}) / count(*) / 1000 AS {a}" for x, a in (("lat", "lat"), ("lon", "lon"), ("least(1, greatest(0, score / 5))", "quality"), ("scenic", "scenic"), ("detour_min", "detour"), ("drift_min", "drift"), ("t_sec", "t")))}, min(from_s) AS from_s, min(to_s) AS to_s,
        CASE WHEN bool_and(list_has_any(categories, ['alpine-hut', 'mountain-hut'])) THEN 'mountain-hut' WHEN bool_and(list_has_any(categories, ['restaurant', 'cafe'])) THEN 'valley' ELSE 'hidden' END AS vibe FROM zoned GROUP BY tour_id, zone),
    told AS (SELECT a.*, e.entropy, a.t BETWEEN c.climax_s + 1800 AND c.climax_s + 2700 AS rest FROM agg a JOIN ent e USING (tour_id, zone) JOIN climax c USING (tour_id))
  SELECT tour_id, zone, n, floor(lat * 1e3 + 5e-1) / 1e3 AS lat, floor(lon * 1e3 + 5e-1) / 1e3 AS lon, floor((12e-1 * ln(1 + n) + 9e-1 * quality + 35e-2 * entropy + 45e-2 * scenic - 6e-2 * detour - 1e-2 * drift + CASE WHEN rest THEN 7e-1 ELSE 0 END) * 1e3 + 5e-1) / 1e3 AS score, entropy,
    CAST(floor(greatest(0, t + detour * 30 - greatest(to_s - from_s, 60) / 2) + 5e-1) AS BIGINT) AS arrive_from_s, CAST(floor(greatest(0, t + detour * 30 + greatest(to_s - from_s, 60) / 2) + 5e-1) AS BIGINT) AS arrive_to_s, vibe, CASE WHEN rest THEN 'post-climax' END AS role FROM told"""
CORRIDOR = f"""near AS ({nearest_sql(1500, "p.score >= 5")}), cor AS (SELECT k.tour_id, k.id AS poi, k.ord, floor(k.m / 1e3 * (CASE WHEN t.on_climb THEN 17e-1 ELSE 14e-1 END) * 2 / 50e0 * 60 * 1e3 + 5e-1) / 1e3 AS detour, p.score, CAST(floor(t.t_sec / 3600) AS BIGINT) AS bucket, list_contains(p.categories, 'viewpoint') AS hit
    FROM near k JOIN {{track}} t ON t.tour_id = k.tour_id AND t.ord = k.ord JOIN {{sights}} p ON p.id = k.id WHERE NOT EXISTS (SELECT 1 FROM {{track}} o WHERE o.tour_id = k.tour_id AND o.place_id = k.id)),
  ranked AS (SELECT *, floor((score + CASE WHEN hit THEN 2 ELSE 0 END - detour * 3e-2) * 1e3 + 5e-1) / 1e3 AS rank_score FROM cor WHERE detour <= 30),
  tiered AS (SELECT *, CASE WHEN detour <= 4 AND score >= 7 THEN 'auto' WHEN detour <= 20 AND score >= 6 THEN 'suggestion' ELSE 'drawer' END AS tier, row_number() OVER (PARTITION BY tour_id ORDER BY rank_score DESC, score DESC, detour, ord, poi) AS place FROM ranked)"""
PROVEN = "EXISTS (SELECT 1 FROM {proofs} f WHERE f.connection_id = u.connection_id AND f.status = 'verified' AND (f.field = '/geometry' OR f.field LIKE '/geometry/%') AND f.observed <= u.day AND (f.valid_until IS NULL OR f.valid_until >= u.day))"
USED = f"""days AS (SELECT u.connection_id, u.day, {PROVEN} AS proven FROM (SELECT DISTINCT connection_id, day FROM {{uses}}) u),
    used AS (SELECT u.*, c.*, d.proven, u.arrival_s + CASE c.zone WHEN 'Asia/Tokyo' THEN 32400 WHEN 'Asia/Kolkata' THEN 19800 ELSE 0 END AS here FROM {{uses}} u JOIN {{connections}} c ON c.id = u.connection_id JOIN days d ON d.connection_id = u.connection_id AND d.day = u.day),
    timed AS (SELECT *, DATE '1970-01-01' + CAST(floor(here / 86400) AS INT) AS local_date, ceil(here / 60) * 60 AS board, list_transform(list_filter(departures, lambda x: regexp_matches(x, '^([01][0-9]|2[0-3]):[0-5][0-9]$')), lambda x: CAST(x[1:2] AS INT) * 60 + CAST(x[4:5] AS INT)) AS times FROM used),
    strict AS (SELECT *, zone IS NOT NULL AND len(times) = len(departures) AND len(list_distinct(times)) = len(times) AND local_date BETWEEN valid_from AND valid_until AS on_schedule, list_min(list_filter(times, lambda x: x * 60 >= board - floor(here / 86400) * 86400)) AS nxt FROM timed),
    coded AS (SELECT *, CASE WHEN on_schedule THEN nxt END AS departure, CASE WHEN mode NOT IN ('rail', 'bus', 'ferry', 'gondola', 'boat') THEN 'invalid' WHEN direction = 'return' THEN 'direction_invalid' WHEN operating IS NULL THEN 'operating_unknown' WHEN NOT operating THEN 'not_operating' WHEN zone IS NULL THEN 'timezone_invalid' WHEN NOT on_schedule THEN 'schedule_not_valid'
        WHEN verification <> 'verified' THEN 'unverified' WHEN freshness <> 'current' OR coalesce(flag, '') LIKE 'critical%' THEN 'quality_not_current' WHEN NOT proven THEN 'provenance_unverified' WHEN nxt IS NULL THEN 'missed' END AS code FROM strict)"""
ENDS = "ends AS (SELECT id AS c, direction, 'start' AS e, lat, lon FROM {connections} UNION ALL SELECT id, direction, 'end', lat2, lon2 FROM {connections})"


def metrics(t):
    return drives.segment_metrics(drives.segmented(t.drive_edges))


def curve(t):
    return drives.hunger_curve(drives.segmented(t.drive_edges))


def windows(t):
    return written(drives.lunch_windows(curve(t)))


def food(t, found=None):
    return drives.lunch_candidates(t.sights, t.track, found if found is not None else windows(t))


def zones(t, found=None):
    found = found if found is not None else windows(t)
    return drives.lunch_zones(drives.lunch_spots(t.sights, t.track, found), drives.segmented(t.drive_edges))


def tiered(t):
    return drives.tiers(drives.ranked_corridor(t.sights, t.track, themes=("viewpoint",)))


def breaks_due(t, m):
    return drives.breaks(written(drives.load_curve(m)))


def deserts(t):
    found = windows(t)
    return drives.lunch_deserts(found, drives.fed_tours(t.sights, t.track, found), t.track)


def stops_of_breaks(t):
    m = written(metrics(t))
    return drives.break_candidates(t.sights, written(breaks_due(t, m)), m, t.track, "family").select("tour_id", "number", "poi", "total", "kind", "seconds")


def picks(t):
    return drives.left_over(drives.ranked_corridor(t.sights, t.track, themes=("viewpoint",), least=drives.SUGGEST[1]))


def enriched(t):
    """The chain for every tour: corridor, lunch, breaks, and the families that its places share with its persona."""
    found, m = windows(t), written(metrics(t))
    parts = [
        drives.tier_counts(t.sights, t.track),
        zones(t, found).groupBy("tour_id").agg(F.count("*").alias("zones"), F.max("score").alias("best_zone")),
        breaks_due(t, m).groupBy("tour_id").agg(F.count("*").alias("breaks")),
        t.stops.join(t.places.select(F.col("id").alias("place_id"), "family"), "place_id").groupBy("tour_id").agg(F.count_distinct("family").alias("families")),
    ]
    tours = t.track.select("tour_id").distinct()
    for p in parts:
        tours = tours.join(written(p).hint("merge"), "tour_id", "left")
    return tours.select("tour_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("auto", "suggestions", "zones", "breaks", "families")], "best_zone")


def used(t):
    return t.uses.withColumn("arrival", F.timestamp_seconds("arrival_s"))


BUILT = {
    "win_segments_by_stop": (lambda t: metrics(t).selectExpr("tour_id", "segment", "legs", "duration_s AS seconds"), f"WITH {METRICS} SELECT tour_id, CAST(segment AS BIGINT) AS segment, legs, CAST(duration_s AS BIGINT) AS seconds FROM met"),
    "agg_segment_metrics": (
        lambda t: metrics(t).select("tour_id", "segment", "scenic", "straight", "curvature", "gain_per_km", "motorway_share", "main_road"),
        f"WITH {METRICS}, road AS (SELECT tour_id, segment, road_class, sum(distance_m) AS m FROM seg GROUP BY ALL) SELECT m.tour_id, CAST(m.segment AS BIGINT) AS segment, scenic, straight, curvature, gain_per_km, motorway_share, (SELECT first(r.road_class ORDER BY r.m DESC, r.road_class) FROM road r WHERE r.tour_id = m.tour_id AND r.segment = m.segment) AS main_road FROM met m",
    ),
    "win_route_profile": (
        lambda t: drives.route_profile(drives.segmented(t.drive_edges)),
        f"WITH {CURVE} SELECT s.tour_id, s.ord, CAST(s.start_s AS BIGINT) AS start_s, CAST(s.end_s AS BIGINT) AS end_s, s.gain_m AS gain, s.scenic >= t.threshold AS scenic_leg FROM seg s JOIN tours t ON t.tour_id = s.tour_id",
    ),
    "win_load_curve": (lambda t: drives.load_curve(metrics(t)).select("tour_id", "segment", "chunk", "position", "boredom", "effort", "load"), f"WITH {LOAD} SELECT tour_id, CAST(segment AS BIGINT) AS segment, chunk, position, boredom, effort, load FROM loads"),
    "win_break_detection": (lambda t: breaks_due(t, metrics(t)), None),
    "break_candidates": (stops_of_breaks, None),
    "join_poi_density": (
        lambda t: drives.segment_density(t.sights, drives.segmented(t.drive_edges), t.track),
        f"""WITH {SEG}, ends AS (SELECT tour_id, segment, min(ord) AS a, max(ord) AS b, greatest(sum(distance_m), 1) / 1000 AS km FROM seg GROUP BY tour_id, segment), spot AS (SELECT e.tour_id, e.segment, v.lat, v.lon FROM ends e JOIN {{track}} v ON v.tour_id = e.tour_id AND v.ord IN (e.a, e.b)),
          got AS (SELECT v.tour_id, v.segment, count(DISTINCT p.id) AS n FROM spot v JOIN {{sights}} p ON abs(p.lat - v.lat) <= 455e-4 AND {H("v.lat", "v.lon", "p.lat", "p.lon")} <= 5000 GROUP BY v.tour_id, v.segment) SELECT e.tour_id, CAST(e.segment AS BIGINT) AS segment, coalesce(g.n, 0) AS places, floor(coalesce(g.n, 0) / e.km * 1e3 + 5e-1) / 1e3 AS density FROM ends e LEFT JOIN got g ON g.tour_id = e.tour_id AND g.segment = e.segment""",
    ),
    "win_hunger_curve": (curve, f"WITH {CURVE} SELECT tour_id, step, t_sec, need FROM curve"),
    "win_lunch_window": (lambda t: windows(t), f"WITH {LUNCH} SELECT * FROM win"),
    "lunch_candidates": (lambda t: food(t).select("tour_id", "poi", "ord", "metres", "detour_min", "drift_min"), f"WITH {FOOD} SELECT tour_id, poi, ord, metres, detour_min, drift_min FROM food"),
    "lunch_deserts": (
        deserts,
        f"WITH {FOOD} SELECT w.tour_id, w.from_s, w.to_s, (SELECT first(s.place_id ORDER BY s.ord) FROM span s WHERE s.tour_id = w.tour_id) AS from_place, (SELECT last(s.place_id ORDER BY s.ord) FROM span s WHERE s.tour_id = w.tour_id) AS to_place FROM win w WHERE NOT EXISTS (SELECT 1 FROM food f WHERE f.tour_id = w.tour_id)",
    ),
    "agg_lunch_zone": (zones, f"WITH RECURSIVE {ZONES}"),
    "corridor_candidates": (lambda t: drives.ranked_corridor(t.sights, t.track).select("tour_id", "poi", "ord", F.col("detour").alias("detour_min")), f"WITH {CORRIDOR} SELECT tour_id, poi, ord, detour AS detour_min FROM ranked"),
    "top_corridor_tiers": (lambda t: tiered(t).select("tour_id", "ord", "poi", "rank_score", "tier", "place"), f"WITH {CORRIDOR} SELECT tour_id, ord, poi, rank_score, tier, place FROM tiered"),
    "win_hour_fairness": (
        lambda t: drives.hour_fairness(tiered(t).where("tier = 'auto'")).select("tour_id", "ord", "poi", "kept"),
        f"WITH {CORRIDOR} SELECT tour_id, ord, poi, row_number() OVER (PARTITION BY tour_id, bucket ORDER BY rank_score DESC, score DESC, detour, ord, poi) <= 1 AS kept FROM tiered WHERE tier = 'auto'",
    ),
    "win_detour_budget": (lambda t: routes.detour_budget(drives.hour_fairness(tiered(t).where("tier = 'auto'"), 2).where("kept"), 4.0), None),
    "win_mmr_topk": (lambda t: routes.mmr(picks(t), 3), None),
    "route_enrichment_chain": (enriched, None),
    "proj_path_from_edges": (
        lambda t: routes.path_from_edges(t.tour_edges),
        "WITH n AS (SELECT tour_id, ord * 2 AS o, CAST(split_part(edge_id, '->', 1) AS BIGINT) AS node FROM {tour_edges} UNION ALL SELECT tour_id, ord * 2 + 1, CAST(split_part(edge_id, '->', 2) AS BIGINT) FROM {tour_edges}), f AS (SELECT *, lag(node) OVER (PARTITION BY tour_id ORDER BY o) AS before FROM n) SELECT tour_id, row_number() OVER (PARTITION BY tour_id ORDER BY o) AS position, node FROM f WHERE before IS DISTINCT FROM node",
    ),
    "join_implicit_passes": (
        lambda t: routes.implicit_passes(routes.path_from_edges(t.tour_edges), t.stops.where("kind <> 'connector'"), t.passes.where("seasonal")),
        "WITH p AS (SELECT tour_id, ord, pass_id, lag(pass_id) OVER (PARTITION BY tour_id ORDER BY ord) AS before, count(*) OVER (PARTITION BY tour_id) AS n FROM {stops}), q AS (SELECT tour_id, pass_id, row_number() OVER (PARTITION BY tour_id ORDER BY ord) AS position FROM p WHERE n > 1 AND before IS DISTINCT FROM pass_id) SELECT q.tour_id, q.pass_id, min(position) AS first FROM q WHERE EXISTS (SELECT 1 FROM {passes} s WHERE s.id = q.pass_id AND s.seasonal) AND NOT EXISTS (SELECT 1 FROM {stops} o WHERE o.tour_id = q.tour_id AND o.pass_id = q.pass_id AND o.kind <> 'connector') GROUP BY q.tour_id, q.pass_id",
    ),
    "plan_connection_ok": (
        lambda t: schedules.usable(used(t), t.connections, t.proofs).select("tour_id", "ord", F.col("ok").alias("usable")),
        f"WITH {USED} SELECT tour_id, ord, coalesce(mode IN ('rail', 'bus', 'ferry', 'gondola', 'boat') AND coalesce(operating, FALSE) AND action = 'publish' AND verification = 'verified' AND freshness = 'current' AND coalesce(flag, '') NOT LIKE 'critical%' AND minutes > 0 AND end_a <> end_b AND on_schedule AND proven, FALSE) AS usable FROM strict",
    ),
    "win_next_departure": (lambda t: schedules.scheduled(used(t), t.connections).select("tour_id", "ord", "departure"), f"WITH {USED} SELECT tour_id, ord, departure FROM coded"),
    "join_choose_transport": (
        lambda t: schedules.chosen(schedules.refusals(used(t), t.connections, t.proofs)),
        f"WITH {USED}, first AS (SELECT tour_id, min(ord) FILTER (code IS NULL) AS chosen FROM coded GROUP BY tour_id) SELECT f.tour_id, f.chosen, coalesce(string_agg(c.code, ';' ORDER BY c.ord) FILTER (c.code IS NOT NULL AND (f.chosen IS NULL OR c.ord < f.chosen)), '') AS reasons FROM first f JOIN coded c ON c.tour_id = f.tour_id GROUP BY f.tour_id, f.chosen",
    ),
    "join_transport_links": (
        lambda t: schedules.transport_links(t.entities.where("entity_type = 'AccessPoint'"), t.connections),
        f"WITH {ENDS}, near AS (SELECT DISTINCT a.id, b.c, b.direction, b.e FROM (SELECT * FROM {{entities}} WHERE entity_type = 'AccessPoint') a JOIN ends b ON {H('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 250), u AS (SELECT id, count(DISTINCT c) FILTER (direction = 'both' OR (direction = 'outbound' AND e = 'end')) AS outbound, count(DISTINCT c) FILTER (direction = 'both' OR (direction = 'return' AND e = 'start')) AS inbound FROM near GROUP BY id) SELECT * FROM u WHERE outbound + inbound > 0",
    ),
    "join_journey_options": (
        lambda t: schedules.journey_options(t.walks, t.entities.where("entity_type = 'AccessPoint' AND legal = 'legal' AND action = 'publish'"), t.connections),
        f"""WITH {ENDS}, m AS (SELECT w.id, list_sort(list(DISTINCT a.mode)) AS modes FROM {{walks}} w JOIN {{entities}} a ON a.entity_type = 'AccessPoint' AND a.legal = 'legal' AND a.action = 'publish' AND {H("w.lat", "w.lon", "a.lat", "a.lon")} <= 250 GROUP BY w.id), b AS (SELECT DISTINCT w.id FROM {{walks}} w JOIN ends e ON ((e.direction = 'return' AND e.e = 'start') OR e.direction = 'both') AND {H("w.lat2", "w.lon2", "e.lat", "e.lon")} <= 250)
          SELECT w.id, coalesce(array_to_string(m.modes, ','), '') AS modes, CASE WHEN floor({H("w.lat", "w.lon", "w.lat2", "w.lon2")} + 5e-1) < 250 THEN 'loop' WHEN b.id IS NOT NULL THEN 'transport' WHEN w.retraced THEN 'out_and_back' ELSE 'none' END AS way_back FROM {{walks}} w LEFT JOIN m ON m.id = w.id LEFT JOIN b ON b.id = w.id""",
    ),
}
