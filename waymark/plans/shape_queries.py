"""Queries of feeds, projections, readers and sinks, and plain SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import columns
from waymark.functions.sql import haversine
from waymark.operators import feeds, shapes
from waymark.sources import readers, sinks

H = haversine


def segment_lines(t):
    """Each stop and the next as a line with a vertex between; lines of some tours stop short of the next one."""
    from pyspark.sql import Window

    w = Window.partitionBy("tour_id").orderBy("ord")
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    s = t.stops.withColumns({"lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)}).where("lat2 is not null")
    end = F.when((F.col("tour_id") % 10 == 0) & (F.col("ord") == 2), F.col("lat2") + 0.01).otherwise(F.col("lat2"))
    return s.select("tour_id", "ord", F.array(point(F.col("lat"), F.col("lon")), point((F.col("lat") + F.col("lat2")) / 2, (F.col("lon") + F.col("lon2")) / 2), point(end, F.col("lon2"))).alias("line"))


def registries(t):
    """A registry document for each region, an odd version among them; objects keyed by name; hourly arrays."""
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title")))).alias("rows"))
    registry = n.select(F.col("r_name").alias("name"), F.to_json(F.struct(F.when(F.col("r_name") == "ASIA", "2.0.0").otherwise("1.0.0").alias("schemaVersion"), F.col("rows").alias("sources"))).alias("text"))
    p = t.places.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("id").cast("string"), F.struct("price", "size"))))).alias("m"))
    keyed = p.select(F.col("category").alias("name"), F.to_json("m").alias("text"))
    h = t.statuses.groupBy("pass_id").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("xs"))
    hourly = h.select(F.col("pass_id").cast("string").alias("name"), F.to_json(F.struct(F.struct(F.transform("xs", lambda x: x["id"].cast("string")).alias("time"), F.transform("xs", lambda x: x["value"]).alias("temperature")).alias("hourly"))).alias("text"))
    return registry, keyed, hourly


def nested(t):
    registry, keyed, hourly = registries(t)
    one = readers.registry_rows(registry, "sources", "id:bigint,title:string").select(F.lit("registry").alias("kind"), F.col("id").cast("string").alias("key"), F.lit(None).cast("double").alias("value"))
    two = readers.keyed_rows(keyed, "price:double,size:bigint").select(F.lit("keyed").alias("kind"), "key", F.col("price").alias("value"))
    three = readers.hourly_rows(hourly, {"temperature": "double"}).select(F.lit("hourly").alias("kind"), F.col("time").alias("key"), F.col("temperature").alias("value"))
    return one.unionByName(two).unionByName(three)


def chunks(t):
    """Matrix chunks of the edges' sources by eights against all targets, sent twice: the second time some values are missing, others new."""
    targets = t.edges.agg(F.array_sort(F.collect_set("b")).alias("targets"))
    e = t.edges.groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("b", "duration_s"))).alias("m"))
    lines = e.withColumn("one", F.lit(1)).join(F.broadcast(targets.withColumn("one", F.lit(1))), "one")  # one row
    sent = lines.withColumn("number", F.explode(F.array(F.lit(1), F.lit(2))))
    value = lambda b: F.when((F.col("number") == 2) & ((F.col("a") + b) % 4 == 0), None).otherwise(F.try_element_at("m", b) + F.when(F.col("number") == 2, 1000).otherwise(0))
    rows = sent.select("number", F.floor(F.col("a") / 8).alias("chunk"), "a", "targets", F.transform("targets", value).alias("line"))
    packed = rows.groupBy("number", "chunk", "targets").agg(F.array_sort(F.collect_list(F.struct("a", "line"))).alias("xs"))
    return packed.select("number", F.transform("xs", lambda x: x["a"]).alias("sources"), "targets", F.transform("xs", lambda x: x["line"]).alias("durations"))


def card_pages(t):
    """A page for each pass with a card for each of its readings."""
    cls = F.concat(F.lit("pass-card "), F.when(F.col("state") == "open", "is-open").when(F.col("state") == "closed", "is-closed").otherwise(""), F.when(F.col("source") == "alert", " alert").otherwise(""))
    body = F.concat(F.lit('<span class="state"><b>'), F.when(F.col("state") == "restricted", "Restricted").when(F.col("state") == "open", "offen").otherwise("?"), F.lit('</b></span><span class="elev">'), (F.col("id") % 3000).cast("string"), F.lit(' m</span><span class="note">'), "info", F.lit("</span>"))
    card = F.concat(F.lit('<article class="'), cls, F.lit('" data-slug="s'), F.col("id").cast("string"), F.lit('">'), body, F.lit("</article>"))
    return t.statuses.groupBy(F.col("pass_id").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", card.alias("c")))), lambda x: x["c"]), "\n").alias("html"))


def exports(t):
    gate = t.sql(_export_gate())
    routes = gate.join(t.entities.select("id", "name"), "id")
    v = t.stops.select(F.col("tour_id").alias("id"), "ord", "lon", "lat")
    n = t.assertions.select(F.col("entity_id").alias("id"), "source_id").distinct().join(t.sources.select(F.col("id").alias("source_id"), F.col("name").alias("attribution"), "disposition"), "source_id").where("disposition = 'approved'").select("id", "source_id", "attribution", F.lit("by").alias("licence"))
    out = sinks.route_exports(routes, v, n)
    back = F.from_json("document", "struct<type:string,geometry:struct<type:string,coordinates:array<array<double>>>,properties:struct<id:bigint,sourceNotices:array<struct<source_id:bigint>>>>")
    d = out.withColumn("d", back)
    return d.select("id", F.size("d.geometry.coordinates").cast("long").alias("vertices"), F.size("d.properties.sourceNotices").cast("long").alias("notices"), F.element_at("d.geometry.coordinates", 1)[0].alias("lon"), F.element_at("d.geometry.coordinates", -1)[1].alias("lat"))


def _export_gate() -> str:
    from waymark.operators.governance import export_gate

    return export_gate.text


def enveloped(t):
    e = t.entities.selectExpr("*", "concat('entity:', id) AS key", "CASE WHEN id % 2 = 0 THEN 'en' END AS language", "host AS source", "concat('r', id) AS record")
    return shapes.envelope(e).select("id", "key", F.col("names")[0]["language"].alias("language"), F.size("assertions").cast("long").alias("assertions"), F.array_join(F.transform("assertions", lambda a: F.concat_ws("=", a["field_path"], a["confidence_permille"].cast("string"))), ",").alias("confidences"), F.size("quality.flags").cast("long").alias("flags"), "sensitivity.reason", F.col("original_sources")[0]["record_id"].alias("record"))


def joined(t):
    j = shapes.joined_segments(segment_lines(t))
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ","))
    return j.select("tour_id", "segments", "whole", F.size("line").cast("long").alias("vertices"), F.size("out_and_back").cast("long").alias("both_ways"), text("line").alias("digest"))


def hashed(t):
    rows = t.entities.select("id", F.struct(F.struct("nation", "activity").alias("z"), F.col("id").alias("id"), F.array("legal", "action").alias("list"), F.col("lane").alias("lane")).alias("record"))
    return rows.select("id", columns.canonical_hash("record", rows.schema["record"].dataType).alias("hash"))


def barred(t):
    nodes = t.road_nodes.selectExpr("id", "cast(floor(id / 3) as bigint) AS pass_id")
    edges = t.pass_edges.where("b > 0").select("a", "b")
    out, touched = feeds.barred(nodes, edges, t.closed_passes)
    return out.selectExpr("'node' AS kind", "id AS a", "pass_id AS b").unionByName(touched.selectExpr("'edge' AS kind", "a", "b"))


Z = "floor(({0} - (SELECT avg({0}) FROM {{pass_signals}})) / (SELECT CASE WHEN stddev_pop({0}) = 0 THEN 1 ELSE stddev_pop({0}) END FROM {{pass_signals}}) * 1e6 + 5e-1) / 1e6"
MONTH_STARTS = "[0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]"
BUILT = {
    "status_hint_extract": (lambda t: feeds.hints(t.notes), "SELECT id, kind, day, month, CASE WHEN style IN (1, 2) THEN year END AS year FROM {notes} WHERE kind <> 'none'"),
    "join_alias_alerts": (
        lambda t: feeds.alias_alerts(t.alerts, t.named_passes),
        """WITH named AS (SELECT 'a' AS who, id, elev, lower(strip_accents(name)) AS name FROM {alerts} UNION ALL SELECT 'p', id, elev, lower(strip_accents(name)) FROM {named_passes}), part AS (SELECT who, id, elev, unnest(list_append(regexp_split_to_array(name, '\\s*/\\s*|\\s+-\\s+'), name)) AS p FROM named),
          plain AS (SELECT who, id, elev, regexp_replace(p, '[^a-z0-9]+', '', 'g') AS p FROM part), form AS (SELECT * FROM plain UNION SELECT who, id, elev, p[:length(p) - length(e)] FROM plain, unnest(['pass', 'joch', 'sattel', 'strasse', 'hohenstrasse', 'panoramastrasse', 'alpenstrasse', 'gipfelstrasse']) u(e) WHERE ends_with(p, e) AND length(p) > length(e) + 2)
          SELECT id, pass_id, gap FROM (SELECT a.id, b.id AS pass_id, CAST(coalesce(abs(a.elev - b.elev), 0) AS BIGINT) AS gap, row_number() OVER (PARTITION BY a.id ORDER BY coalesce(abs(a.elev - b.elev), 0), b.id) AS r FROM form a JOIN form b ON a.who = 'a' AND b.who = 'p' AND a.p = b.p AND a.p <> '') k WHERE r = 1 AND gap <= 200""",
    ),
    "join_asof_weather": (
        lambda t: feeds.weather(t.etas, t.forecasts),
        """SELECT id, hour_s, gap, CASE WHEN code = 0 THEN 'sunny' WHEN code = 1 THEN 'partly cloudy' WHEN code = 2 THEN 'mostly cloudy' WHEN code = 3 THEN 'cloudy' WHEN code BETWEEN 45 AND 48 THEN 'fog' WHEN code BETWEEN 51 AND 60 THEN 'light rain' WHEN code BETWEEN 61 AND 67 THEN 'rain' WHEN code BETWEEN 71 AND 77 THEN 'snow' WHEN code BETWEEN 80 AND 84 THEN 'showers' WHEN code IN (85, 86) THEN 'snow showers' WHEN code BETWEEN 95 AND 99 THEN 'storm' ELSE 'forecast' END AS label
          FROM (SELECT e.id, f.hour_s, f.code, abs(f.hour_s - e.at_s) AS gap, row_number() OVER (PARTITION BY e.id ORDER BY abs(f.hour_s - e.at_s), f.hour_s) AS r FROM {etas} e JOIN {forecasts} f ON f.pass_id = e.pass_id AND abs(f.hour_s - e.at_s) <= 5400) k WHERE r = 1""",
    ),
    "agg_history_median": (
        lambda t: feeds.typical_days(t.history),
        f"""WITH d AS (SELECT pass_id, year, {MONTH_STARTS}[CAST(month(open) AS INT)] + day(open) AS o, {MONTH_STARTS}[CAST(month(close) AS INT)] + day(close) AS c FROM {{history}} WHERE open IS NOT NULL AND close IS NOT NULL), m AS (SELECT pass_id, count(*) AS years, CAST(list_sort(list(o))[CAST(floor(count(*) / 2) AS INT) + 1] AS INT) AS open_doy, CAST(list_sort(list(c))[CAST(floor(count(*) / 2) AS INT) + 1] AS INT) AS close_doy, min(year) AS first_year, max(year) AS last_year FROM d GROUP BY pass_id)
          SELECT pass_id, years, open_doy, close_doy, strftime(DATE '2001-01-01' + open_doy - 1, '%m-%d') AS opens, strftime(DATE '2001-01-01' + close_doy - 1, '%m-%d') AS closes, first_year, last_year FROM m WHERE years >= 3""",
    ),
    "agg_dominant_status": (
        lambda t: feeds.dominant_state(t.clustered),
        "SELECT cluster, state, n FROM (SELECT cluster, state, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, CASE state WHEN 'open' THEN 1 WHEN 'restricted' THEN 2 WHEN 'closed' THEN 3 ELSE -1 END DESC) AS r FROM {clustered} GROUP BY cluster, state) k WHERE r = 1",
    ),
    "agg_cluster_composition": (
        lambda t: feeds.composition(t.clustered.selectExpr("cluster", "concat(kind, ':', state) AS kind")),
        "WITH c AS (SELECT cluster, kind || ':' || state AS kind, count(*) AS n FROM {clustered} GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, kind) AS place, sum(n) OVER (PARTITION BY cluster) AS total, count(*) OVER (PARTITION BY cluster) AS kinds FROM c) SELECT cluster, kind, n, place, floor(n / total * 1000 + 5e-1) / 1000 AS share FROM k WHERE place <= CASE WHEN total >= 40 THEN 3 WHEN total >= 10 THEN 4 WHEN kinds <= 1 THEN 2 ELSE least(3, kinds) END",
    ),
    "flt_forbidden_passes": (
        barred,
        "WITH f AS (SELECT pass_id FROM {closed_passes}), n AS (SELECT id, CAST(floor(id / 3) AS BIGINT) AS pass_id FROM {road_nodes} WHERE CAST(floor(id / 3) AS BIGINT) IN (SELECT pass_id FROM f)) SELECT 'node' AS kind, id AS a, pass_id AS b FROM n UNION ALL SELECT DISTINCT 'edge', a, b FROM {pass_edges} WHERE b > 0 AND (a IN (SELECT id FROM n) OR b IN (SELECT id FROM n))",
    ),
    "proj_jurisdictions": (
        lambda t: feeds.jurisdictions(t.region_texts, t.place_words, t.delivery),
        "WITH s AS (SELECT DISTINCT id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS word FROM {region_texts}), f AS (SELECT s.id, w.jurisdiction, d.region FROM s JOIN {place_words} w ON w.word = s.word LEFT JOIN {delivery} d ON d.jurisdiction = w.jurisdiction), g AS (SELECT id, array_to_string(list_sort(list(DISTINCT jurisdiction)), ',') AS j, array_to_string(list_sort(list(DISTINCT region) FILTER (region IS NOT NULL)), ',') AS r FROM f GROUP BY id) SELECT t.id, coalesce(j, '') AS jurisdictions, coalesce(r, '') AS regions FROM {region_texts} t LEFT JOIN g ON g.id = t.id",
    ),
    "flt_viewport_cells": (
        lambda t: feeds.viewport_cells(t.cell_packages, 170.0, -20.0, -170.0, 20.0),
        "WITH m AS (SELECT * FROM {cell_packages} WHERE (x >= 248 OR x <= 7) AND y BETWEEN 113 AND 142) SELECT x, y, packages, bytes, (SELECT count(*) <= 64 AND sum(packages) <= 128 AND sum(bytes) <= 8000000 FROM m) AS fits FROM m",
    ),
    "src_nested_json": (
        nested,
        "SELECT 'registry' AS kind, CAST(n_nationkey AS VARCHAR) AS key, CAST(NULL AS DOUBLE) AS value FROM {nation} JOIN {region} ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA' UNION ALL SELECT 'keyed', CAST(id AS VARCHAR), price FROM {places} UNION ALL SELECT 'hourly', CAST(id AS VARCHAR), value FROM {statuses}",
    ),
    "src_matrix_chunks": (
        lambda t: readers.matrix_pairs(chunks(t), t.edges.where("duration_s < 1000").selectExpr("b AS a", "a AS b", "distance_m AS duration_s")),
        "WITH m AS (SELECT a, b, CASE WHEN (a + b) % 4 = 0 THEN duration_s ELSE duration_s + 1000 END AS d FROM {edges}), s AS (SELECT b AS a, a AS b, distance_m AS d FROM {edges} WHERE duration_s < 1000) SELECT coalesce(m.a, s.a) AS a, coalesce(m.b, s.b) AS b, coalesce(m.d, s.d) AS duration_s, CASE WHEN m.a IS NOT NULL THEN 'measured' ELSE 'seed' END AS basis FROM m FULL JOIN s ON s.a = m.a AND s.b = m.b",
    ),
    "src_html_feed": (
        lambda t: readers.status_cards(card_pages(t)),
        "SELECT pass_id AS page, row_number() OVER (PARTITION BY pass_id ORDER BY id) - 1 AS position, 's' || CAST(id AS VARCHAR) AS slug, CASE WHEN source = 'alert' THEN 'alert' ELSE 'status' END AS kind, state, CAST(id % 3000 AS INT) AS elev, info AS note FROM {statuses}",
    ),
    "sink_route_export": (
        exports,
        "WITH g AS (SELECT * FROM (EXPORT_GATE) x WHERE code IS NULL), n AS (SELECT a.entity_id AS id, count(DISTINCT a.source_id) AS n FROM {assertions} a JOIN {sources} s ON s.id = a.source_id AND s.disposition = 'approved' GROUP BY a.entity_id) SELECT g.id, count(*) AS vertices, coalesce(max(n.n), 0) AS notices, arg_min(v.lon, v.ord) AS lon, arg_max(v.lat, v.ord) AS lat FROM g JOIN {stops} v ON v.tour_id = g.id LEFT JOIN n ON n.id = g.id GROUP BY g.id",
    ),
    "proj_envelope": (
        enveloped,
        "SELECT id, 'entity:' || CAST(id AS VARCHAR) AS key, CASE WHEN id % 2 = 0 THEN 'en' ELSE 'und' END AS language, CAST(3 AS BIGINT) AS assertions, '/names=' || CAST(CAST(floor(confidence * 1000 + 5e-1) AS BIGINT) AS VARCHAR) || ',/geometry=' || CAST(CAST(floor(confidence * 9e-1 * 1000 + 5e-1) AS BIGINT) AS VARCHAR) || ',/entityType=' || CAST(CAST(floor(confidence * 8e-1 * 1000 + 5e-1) AS BIGINT) AS VARCHAR) AS confidences, CAST(CASE WHEN flag IS NULL THEN 0 ELSE 1 END AS BIGINT) AS flags, CASE WHEN action <> 'publish' THEN 'protected site' END AS reason, 'r' || CAST(id AS VARCHAR) AS record FROM {entities}",
    ),
    "proj_join_segments": (
        joined,
        """WITH s AS (SELECT tour_id, ord, lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM {stops} WINDOW w AS (PARTITION BY tour_id ORDER BY ord)), l AS (SELECT *, CASE WHEN tour_id % 10 = 0 AND ord = 2 THEN lat2 + 1e-2 ELSE lat2 END AS stop FROM s WHERE lat2 IS NOT NULL), b AS (SELECT *, bool_or(tour_id % 10 = 0 AND ord = 3) OVER (PARTITION BY tour_id) AS gap FROM l),
            p AS (SELECT tour_id, ord, k, CASE k WHEN 1 THEN lat WHEN 2 THEN (lat + lat2) / 2 ELSE stop END AS y, CASE k WHEN 1 THEN lon WHEN 2 THEN (lon + lon2) / 2 ELSE lon2 END AS x FROM (SELECT *, unnest([1, 2, 3]) AS k FROM b WHERE NOT (gap AND ord >= 3)) q), i AS (SELECT tour_id, ord, k, CAST(floor(x * 1e6 + 5e-1) AS BIGINT) AS x, CAST(floor(y * 1e6 + 5e-1) AS BIGINT) AS y FROM p),
            d AS (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM i WINDOW v AS (PARTITION BY tour_id ORDER BY ord, k)), j AS (SELECT tour_id, count(*) AS vertices, md5(string_agg(CAST(x AS VARCHAR) || ' ' || CAST(y AS VARCHAR), ',' ORDER BY ord, k)) AS digest FROM d WHERE NOT (k = 1 AND px IS NOT NULL AND px = x AND py = y) GROUP BY tour_id)
          SELECT j.tour_id, c.n AS segments, NOT c.gap AS whole, j.vertices, 2 * j.vertices - 1 AS both_ways, j.digest FROM j JOIN (SELECT tour_id, count(*) AS n, bool_or(gap) AS gap FROM b GROUP BY tour_id) c ON c.tour_id = j.tour_id""",
    ),
    "proj_graph_nodes": (
        lambda t: shapes.graph_nodes(t.passes, t.raw_bases, t.raw_viewpoints, t.places, t.junction_rows, t.known_heights),
        f"""WITH v AS (SELECT r.pass_id, count(DISTINCT (CAST(floor(r.lon * 1e6 + 5e-1) AS BIGINT), CAST(floor(r.lat * 1e6 + 5e-1) AS BIGINT))) AS n FROM {{raw_viewpoints}} r JOIN {{passes}} p ON p.id = r.pass_id WHERE {H("r.lat", "r.lon", "p.lat", "p.lon")} <= 3000 GROUP BY r.pass_id)
          SELECT 'pass:' || CAST(id AS VARCHAR) AS key, 'pass' AS kind, lat, lon, CAST(elev AS DOUBLE) AS elev, CAST(0 AS BIGINT) AS dwell_s, coalesce(v.n, 0) AS viewpoints FROM {{passes}} LEFT JOIN v ON v.pass_id = id
          UNION ALL SELECT 'summit:' || CAST(id AS VARCHAR), 'pass-summit', lat, lon, CAST(elev AS DOUBLE), 0, NULL FROM {{passes}}
          UNION ALL SELECT 'base:' || CAST(p.id AS VARCHAR) || k.side, 'pass-base', CASE WHEN p.id % 3 = 0 THEN p.lat + 1e-3 ELSE p.lat END, CASE k.side WHEN 'A' THEN p.lon - 6e-2 ELSE p.lon + 6e-2 END, CAST(p.elev - 600 AS DOUBLE), 0, NULL FROM {{passes}} p CROSS JOIN (SELECT unnest(['A', 'B']) AS side) k
          UNION ALL SELECT 'poi:' || CAST(id AS VARCHAR), 'poi', lat, lon, CASE WHEN size % 2 = 0 THEN 400e0 + size * 20 END, 600 + size * 60, NULL FROM {{places}} UNION ALL SELECT 'junction:' || CAST(id AS VARCHAR), 'junction', lat, lon, NULL, 0, NULL FROM {{junction_rows}}""",
    ),
    "proj_stable_pass_ids": (
        lambda t: shapes.stable_ids(t.slugged),
        "WITH a AS (SELECT id, slug, md5(seed) AS d FROM {slugged}) SELECT id, CASE WHEN (SELECT count(*) FROM a b WHERE b.slug = a.slug) = 1 THEN slug WHEN (SELECT count(*) FROM a b WHERE b.slug = a.slug AND left(b.d, 6) = left(a.d, 6)) = 1 THEN slug || '-' || left(d, 6) ELSE slug || '-' || d || CASE WHEN (SELECT count(*) FROM a b WHERE b.slug = a.slug AND b.d = a.d AND b.id < a.id) = 0 THEN '' ELSE '-' || CAST(1 + (SELECT count(*) FROM a b WHERE b.slug = a.slug AND b.d = a.d AND b.id < a.id) AS VARCHAR) END END AS stable FROM a",
    ),
    "proj_merge_route_facts": (
        lambda t: shapes.route_facts(t.straight_tours, t.provider_facts),
        "SELECT t.tour_id, CASE WHEN f.distance_m > 0 AND f.duration_s > 0 THEN 'provider' ELSE 'straight' END AS basis, CAST(CASE WHEN f.distance_m > 0 AND f.duration_s > 0 THEN f.distance_m ELSE t.straight_m END AS BIGINT) AS metres, floor(CASE WHEN f.distance_m > 0 AND f.duration_s > 0 THEN f.duration_s / 3600 WHEN t.alpine THEN t.straight_m / 45000 ELSE t.straight_m / 55000 END * 1000 + 5e-1) / 1000 AS hours FROM {straight_tours} t LEFT JOIN {provider_facts} f ON f.tour_id = t.tour_id",
    ),
    "proj_tour_stops": (
        lambda t: shapes.display_stops(t.stops.where("place_id % 17 <> 0 or ord > 1"), t.places.where("size <> 13"), t.open_tours, t.tour_breaks, t.parts("lineitem")),
        """WITH s AS (SELECT s.tour_id, CAST(s.ord AS DOUBLE) AS at_, 'stop' AS role, p.name, p.category FROM {stops} s JOIN {places} p ON p.id = s.place_id AND p.size <> 13 WHERE s.place_id % 17 <> 0 OR s.ord > 1), m AS (SELECT tour_id, min(at_) AS low, max(at_) AS high FROM s GROUP BY tour_id),
            a AS (SELECT * FROM s UNION ALL SELECT t.tour_id, m.low - 1, 'start', t.start_name, NULL FROM {open_tours} t JOIN m ON m.tour_id = t.tour_id WHERE NOT t.closed UNION ALL SELECT t.tour_id, m.high + 1, 'end', t.end_name, NULL FROM {open_tours} t JOIN m ON m.tour_id = t.tour_id WHERE NOT t.closed UNION ALL SELECT b.tour_id, least(greatest(b.position, m.low), m.high) + 5e-1, 'break', NULL, NULL FROM {tour_breaks} b JOIN m ON m.tour_id = b.tour_id)
          SELECT tour_id, role, name, category, row_number() OVER (PARTITION BY tour_id ORDER BY at_, role) AS row FROM a""",
    ),
    "proj_tour_waypoints": (
        lambda t: shapes.waypoints(t.stops, t.implicit),
        """WITH w AS (SELECT tour_id, ord, 0 AS late, 0 AS sub, 'entry' AS part, pass_id AS ref FROM {stops} WHERE kind = 'pass-climb' UNION ALL SELECT tour_id, ord, 0, 1, 'summit', pass_id FROM {stops} WHERE kind = 'pass-climb' UNION ALL SELECT tour_id, ord, 0, 2, 'exit', pass_id FROM {stops} WHERE kind = 'pass-climb' UNION ALL SELECT tour_id, ord, 0, 0, 'parking', pass_id FROM {stops} WHERE kind = 'pass-out-and-back' UNION ALL SELECT tour_id, ord, 0, 0, 'stop', place_id FROM {stops} WHERE kind = 'connector' UNION ALL SELECT tour_id, first, 1, 0, 'implicit', pass_id FROM {implicit})
          SELECT tour_id, row_number() OVER (PARTITION BY tour_id ORDER BY ord, late, sub, ref) AS position, part, ref FROM w""",
    ),
    "agg_pass_features": (
        lambda t: shapes.pass_features(t.pass_signals, ["elev", "quality", "peaks", "waters"]),
        f"WITH z AS (SELECT id, {Z.format('elev')} AS z_elev, {Z.format('quality')} AS z_quality, {Z.format('peaks')} AS z_peaks, {Z.format('waters')} AS z_waters FROM {{pass_signals}}), w AS (SELECT *, floor(least(5e-1, greatest(0, 25e-2 + 1e-1 * (z_elev + z_quality + z_peaks + z_waters) / 4)) * 1e6 + 5e-1) / 1e6 AS scenic_weight FROM z) SELECT *, floor(scenic_weight * 20 * 10 + 5e-1) / 10 AS scenic_score, concat_ws(',', CASE WHEN z_elev >= 1 THEN 'elev' END, CASE WHEN z_quality >= 1 THEN 'quality' END, CASE WHEN z_peaks >= 1 THEN 'peaks' END, CASE WHEN z_waters >= 1 THEN 'waters' END) AS themes FROM w",
    ),
    "join_pass_crossings": (lambda t: shapes.pass_crossings(t.open_passes, t.bases, t.stops), None),
    "proj_place_entity": (
        lambda t: shapes.place_entities(t.place_rows, t.cached_places),
        """SELECT p.id, CASE WHEN p.protected THEN 'ProtectedArea' WHEN list_contains(p.kinds, 'nature') THEN 'NaturalFeature' ELSE 'Place' END AS entity_type, array_to_string(list_sort(list_distinct(list_concat(p.access, CASE WHEN c.access IS NULL THEN [] ELSE [c.access] END))), ',') AS modes, coalesce(c.confidence, least(9e-1, greatest(36e-2, p.score / 10))) AS confidence,
            CASE WHEN list_contains(p.themes, 'iconic') OR p.score >= 9 THEN 'iconic' WHEN list_contains(p.themes, 'hidden-gem') THEN 'quieter_lead' END AS lane, concat_ws(',', CASE WHEN list_contains(p.kinds, 'food') THEN 'eating' END, CASE WHEN list_contains(p.kinds, 'nature') THEN 'hiking' END, CASE WHEN list_contains(p.kinds, 'museum') THEN 'visiting' END) AS activities, CAST(coalesce(p.minutes, 60) AS BIGINT) AS minutes FROM {place_rows} p LEFT JOIN {cached_places} c ON c.name = p.name""",
    ),
    "proj_read_models": (
        lambda t: shapes.read_models(t.model_passes, t.curated_links, t.derived_links),
        """WITH l AS (SELECT pass_id, 0 AS tier, rank, link FROM {curated_links} UNION ALL SELECT pass_id, 1, rank, link FROM {derived_links}), f AS (SELECT *, row_number() OVER (PARTITION BY pass_id, link ORDER BY tier, rank) AS r FROM l), g AS (SELECT pass_id, string_agg(link, ',' ORDER BY tier, rank, link) AS links FROM f WHERE r = 1 GROUP BY pass_id)
          SELECT p.id, trim(string_split(p.name, '/')[1]) AS main_name, trim(string_split(p.name, '/')[2]) AS other_name, floor(p.quality * coalesce(p.confidence, 5e-1) * 1000 + 5e-1) / 1000 AS signal, p.elev > 0 AND p.bases = 2 AS plannable, coalesce(g.links, '') AS links FROM {model_passes} p LEFT JOIN g ON g.pass_id = p.id""",
    ),
    "fn_canonical_hash": (
        hashed,
        """SELECT id, sha256('{"id":' || CAST(id AS VARCHAR) || ',"lane":' || coalesce('"' || lane || '"', 'null') || ',"list":["' || legal || '","' || action || '"],"z":{"activity":"' || activity || '","nation":' || CAST(nation AS VARCHAR) || '}}') AS hash FROM {entities}""",
    ),
}
BUILT["sink_route_export"] = (exports, BUILT["sink_route_export"][1].replace("EXPORT_GATE", _export_gate()))
