"""Adapters: the inputs of the operators, derived from the driver's tables by SQL that Spark and DuckDB repeat exactly.

Each adapter is a SELECT; {name} stands for a base table or another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from waymark.functions.sql import duckdb_dialect, spark_dialect, tile_x, tile_y

BASE = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())


def lon(k: str) -> str:
    return f"(55e-1 + ((({k} % 29) * 7919) % 8500) / 1e3 + (({k} * 31) % 9) / 1e3)"


def lat(k: str) -> str:
    return f"(44e0 + ((({k} % 29) * 104729) % 3800) / 1e3 + (({k} * 17) % 11) / 1e3)"


def world_lon(k: str) -> str:
    return f"((({k} * 7919) % 36000) / 1e2 - 180e0)"


def world_lat(k: str) -> str:
    return f"((({k} * 104729) % 17000) / 1e2 - 85e0)"


ADAPTERS = {
    "places": f"""SELECT p_partkey AS id, p_name AS name, p_type AS category, p_brand AS theme, CAST(p_size % 11 AS DOUBLE) AS score,
        {lon("p_partkey")} AS lon, {lat("p_partkey")} AS lat, p_retailprice AS price, p_size AS size,
        CASE WHEN p_size % 5 = 0 THEN 'CHF' WHEN p_size % 5 = 1 THEN 'EUR' WHEN p_size % 5 = 2 THEN 'JPY' ELSE NULL END AS currency,
        CASE WHEN p_type = 'ECONOMY' THEN 'food' WHEN p_type = 'STANDARD' THEN 'museum' ELSE 'nature' END AS family FROM {{part}}""",
    "passes": f"""SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, 800 + (s_suppkey * 37) % 2200 AS elev, {lon("s_suppkey")} AS lon, {lat("s_suppkey")} AS lat,
        (s_acctbal + 1e3) / 11e3 AS quality, s_suppkey % 4 = 0 AS seasonal, CASE WHEN s_suppkey % 3 = 0 THEN 10 + CAST(s_suppkey % 3 AS INT) ELSE NULL END AS closes, CASE WHEN s_suppkey % 3 = 0 THEN 3 + CAST(s_suppkey % 4 AS INT) ELSE NULL END AS opens,
        CASE WHEN s_suppkey % 5 < 2 THEN 1 + (s_suppkey * 53) % 180 ELSE NULL END AS open_day, CASE WHEN s_suppkey % 5 < 2 THEN 250 + (s_suppkey * 29) % 100 ELSE NULL END AS close_day FROM {{supplier}}""",
    "entities": f"""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'TrailRoute' WHEN 1 THEN 'Place' WHEN 2 THEN 'AccessPoint' ELSE 'NaturalFeature' END AS entity_type,
        'Entity ' || CAST(o_custkey AS STRING) AS name, {lon("o_orderkey")} AS lon, {lat("o_orderkey")} AS lat, {world_lon("o_orderkey")} AS wlon, {world_lat("o_orderkey")} AS wlat,
        CASE o_orderkey % 5 WHEN 0 THEN 'legal' WHEN 1 THEN 'restricted' WHEN 2 THEN 'unknown' WHEN 3 THEN 'private' ELSE 'legal' END AS legal,
        CASE o_orderkey % 11 WHEN 0 THEN 'coarsen' WHEN 1 THEN 'redact' WHEN 2 THEN 'exclude' ELSE 'publish' END AS action,
        CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'partially_verified' ELSE 'unverified' END AS verification,
        ((o_orderkey * 37) % 101) / 1e2 AS confidence, ((o_orderkey * 53) % 101) / 1e2 AS distinctiveness, ((o_orderkey * 71) % 101) / 1e2 AS uniqueness,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE ((o_orderkey * 41) % 101) / 1e2 END AS evidence, ((o_orderkey * 29) % 101) / 1e2 AS prominence,
        CASE o_orderkey % 7 WHEN 0 THEN 'iconic' WHEN 1 THEN 'quieter_verified' WHEN 2 THEN 'quieter_lead' ELSE NULL END AS lane,
        CASE o_orderkey % 8 WHEN 0 THEN 'critical_access_unknown' WHEN 1 THEN 'critical_condition_unknown' WHEN 2 THEN 'technical_route' ELSE NULL END AS flag,
        CASE o_orderkey % 3 WHEN 0 THEN 'hiking' WHEN 1 THEN 'driving' ELSE 'cycling' END AS activity, CASE o_orderkey % 4 WHEN 0 THEN 'summer' WHEN 1 THEN 'winter' WHEN 2 THEN NULL ELSE 'autumn' END AS season,
        CASE o_orderkey % 3 WHEN 0 THEN 'car' WHEN 1 THEN 'train' ELSE 'bus' END AS mode, CAST(o_custkey % 25 AS INT) AS nation, o_totalprice AS bytes, o_orderkey % 13 AS ref_back, CAST(o_orderdate AS DATE) AS observed, o_custkey AS host FROM {{orders}}""",
    "assertions": """SELECT l_orderkey AS entity_id, l_linenumber AS idx, l_suppkey AS source_id, l_partkey AS record_id, l_discount * 10 AS confidence, CAST(l_shipdate AS DATE) AS observed,
        CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'R' THEN 'disputed' ELSE 'unverified' END AS status, l_linestatus AS line_status FROM {lineitem}""",
    "sources": """SELECT s_suppkey % 2 = 0 AS media_use, s_suppkey AS id, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'lead_only' WHEN 2 THEN 'link_only' ELSE 'blocked' END AS disposition,
        CASE WHEN s_acctbal < 0 THEN 'paid' ELSE 'free' END AS cost, s_suppkey % 6 <> 5 AS display_allowed, s_nationkey AS nation FROM {supplier} WHERE s_suppkey % 9 <> 8""",
    "jurisdictions": "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region, n_nationkey % 5 <> 4 AS in_scope FROM {nation}",
    "stops": f"""SELECT l_orderkey AS tour_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS INT) AS ord, l_partkey AS place_id, l_suppkey AS pass_id,
        {lon("l_partkey")} AS lon, {lat("l_partkey")} AS lat, 300e0 + l_quantity * 60 AS duration_s, 500e0 + l_quantity * 400 AS distance_m, l_discount * 5 AS scenic, CAST(l_shipdate AS DATE) AS day,
        CASE l_returnflag WHEN 'A' THEN 'connector' WHEN 'R' THEN 'pass-climb' ELSE 'pass-out-and-back' END AS kind,
        CASE CAST(l_quantity AS INT) % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'tertiary' ELSE 'track' END AS road_class FROM {{lineitem}}""",
    "statuses": """SELECT event_id AS id, user_id AS pass_id, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'view' THEN 'open' WHEN 'click' THEN 'restricted' WHEN 'error' THEN 'closed' ELSE 'unknown' END AS state, value,
        CASE WHEN event_id % 3 = 0 THEN 'live' WHEN event_id % 3 = 1 THEN 'alert' ELSE 'estimate' END AS source, props,
        CASE WHEN event_type = 'error' THEN 'closed until ' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') || '.' || lpad(CAST(1 + event_id % 12 AS STRING), 2, '0') || '.'
             WHEN event_type = 'click' THEN 'Ab ' || CAST(1 + event_id % 28 AS STRING) || '. Mai offen' ELSE 'no news' END AS info FROM {events}""",
    "edges": """SELECT l_suppkey AS a, CAST(o_custkey % 25 AS BIGINT) AS b, min(l_quantity * 60) AS duration_s, min(l_quantity * 900) AS distance_m, min(l_extendedprice / 1e3) AS cost FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_suppkey <> o_custkey % 25 GROUP BY l_suppkey, o_custkey % 25""",
    "sights": f"""SELECT p_partkey AS id, p_name AS name, CAST(p_size % 11 AS DOUBLE) AS score, CASE WHEN p_type = 'ECONOMY' THEN 'food' WHEN p_type = 'STANDARD' THEN 'museum' ELSE 'nature' END AS family, ARR(CASE WHEN p_type = 'ECONOMY' THEN 'food' WHEN p_type = 'STANDARD' THEN 'museum' ELSE 'nature' END, CASE p_size % 5 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'cafe' WHEN 2 THEN 'mountain-hut' WHEN 3 THEN 'viewpoint' ELSE 'village' END) AS categories, {world_lon("p_partkey")} AS lon, {world_lat("p_partkey")} AS lat FROM {{part}}""",
    "track": f"""SELECT tour_id, ord, pass_id AS place_id, kind = 'pass-climb' AS on_climb, scenic, duration_s, {world_lon("place_id")} + 4e-3 AS lon, {world_lat("place_id")} + 2e-3 AS lat, sum(duration_s) OVER (PARTITION BY tour_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t_sec FROM {{stops}}""",
    "bases": "SELECT id AS pass_id, side, lat, CASE side WHEN 'A' THEN lon - 6e-2 ELSE lon + 6e-2 END AS lon, lat AS lat2, lon AS lon2 FROM (SELECT *, UNNEST(ARR('A', 'B')) AS side FROM {passes}) b",
    "road_nodes": "SELECT id * 3 AS id, 'pass' AS kind, 'pass:' || CAST(id AS STRING) AS key, lat, lon FROM {passes} UNION ALL SELECT pass_id * 3 + CASE side WHEN 'A' THEN 1 ELSE 2 END, 'pass-base', 'base:' || CAST(pass_id AS STRING) || side, lat, lon FROM {bases}",
    "base_points": "SELECT pass_id * 2 + CASE side WHEN 'A' THEN 0 ELSE 1 END AS id, pass_id, lat, lon FROM {bases}",
    "measured": "SELECT a * 2 AS a, b * 2 + 1 AS b, duration_s FROM {edges} WHERE b > 0",
    "roads": f"""SELECT p_partkey AS id, {lon("p_partkey")} - (p_size % 8) * 1e-2 AS lon, {lat("p_partkey")} AS lat, CASE p_size % 6 WHEN 0 THEN 'motorway' WHEN 1 THEN 'trunk' WHEN 2 THEN 'primary' WHEN 3 THEN 'secondary' WHEN 4 THEN 'tertiary' ELSE 'track' END AS class FROM {{part}}""",
    "features": f"""SELECT p_partkey AS id, {lon("p_partkey")} + (p_size % 10) * 2e-2 AS lon, {lat("p_partkey")} AS lat, CASE p_size % 7 WHEN 0 THEN 'peak' WHEN 1 THEN 'glacier' WHEN 2 THEN 'water' WHEN 3 THEN 'viewpoint' WHEN 4 THEN 'open' WHEN 5 THEN 'closed' ELSE 'parking' END AS kind FROM {{part}}""",
    "ends": """SELECT tour_id AS id, final, CASE tour_id % 3 WHEN 0 THEN 'pass:' || CAST(pass_id AS STRING) WHEN 1 THEN CAST(place_id AS STRING) ELSE NULL END AS ref, lat, lon + (tour_id % 5) * 3e-1 AS lon FROM (
        SELECT *, FALSE AS final FROM {stops} WHERE ord = 1 UNION ALL SELECT tour_id, ord, place_id, pass_id, lon, lat, duration_s, distance_m, scenic, day, kind, road_class, TRUE FROM (SELECT *, max(ord) OVER (PARTITION BY tour_id) AS top FROM {stops}) t WHERE ord = top) e""",
    "loose_refs": """SELECT tour_id * 10 + ord AS id, CASE place_id % 4 WHEN 0 THEN 'entity:' || CAST(tour_id AS STRING) WHEN 1 THEN CAST(place_id AS STRING) WHEN 2 THEN 'ENTITY ' || CAST(place_id AS STRING) || '!' ELSE 'Nowhere ' || CAST(place_id AS STRING) END AS ref, lat, lon FROM {stops}""",
    "tour_nodes": "SELECT tour_id, ord, pass_id % 25 AS node FROM {stops}",
    "drive_edges": """SELECT tour_id, ord, CAST(duration_s AS BIGINT) AS duration_s, CAST(distance_m AS BIGINT) AS distance_m, scenic, (place_id % 11) / 1e1 AS straight, (place_id % 7) / 1e1 AS curvature, CAST((place_id % 9) * 150 AS BIGINT) AS gain_m,
        CAST(CASE WHEN kind = 'pass-out-and-back' THEN 600 + (place_id % 3) * 600 ELSE 0 END AS BIGINT) AS dwell_s, road_class, kind FROM {stops}""",
    "tour_edges": "SELECT tour_id, ord, CAST(pass_id AS STRING) || '->' || CAST(nxt AS STRING) AS edge_id FROM (SELECT tour_id, ord, pass_id, lead(pass_id) OVER (PARTITION BY tour_id ORDER BY ord) AS nxt FROM {stops}) e WHERE nxt IS NOT NULL",
    "connections": f"""SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN 'rail' WHEN 1 THEN 'bus' WHEN 2 THEN 'ferry' WHEN 3 THEN 'gondola' WHEN 4 THEN 'boat' ELSE 'taxi' END AS mode, CASE s_suppkey % 3 WHEN 0 THEN 'outbound' WHEN 1 THEN 'return' ELSE 'both' END AS direction,
        CASE s_suppkey % 11 WHEN 0 THEN FALSE WHEN 1 THEN NULL ELSE TRUE END AS operating, CASE WHEN s_suppkey % 13 = 0 THEN 'coarsen' ELSE 'publish' END AS action, CASE WHEN s_suppkey % 7 = 0 THEN 'unverified' ELSE 'verified' END AS verification, CASE WHEN s_suppkey % 10 = 0 THEN 'stale' ELSE 'current' END AS freshness,
        CASE WHEN s_suppkey % 17 = 0 THEN 'critical_condition_unknown' END AS flag, CAST(CASE WHEN s_suppkey % 19 = 0 THEN 0 ELSE 10 + s_suppkey % 50 END AS INT) AS minutes, s_suppkey AS end_a, CASE WHEN s_suppkey % 23 = 0 THEN s_suppkey ELSE s_suppkey + 1 END AS end_b,
        CASE WHEN s_suppkey % 29 = 0 THEN NULL WHEN s_suppkey % 4 = 0 THEN 'Asia/Tokyo' WHEN s_suppkey % 4 = 1 THEN 'Asia/Kolkata' ELSE 'UTC' END AS zone, ARR('0' || CAST(5 + s_suppkey % 4 AS STRING) || ':15', '12:' || CAST(10 + s_suppkey % 50 AS STRING), CASE WHEN s_suppkey % 31 = 0 THEN '25:00' ELSE '18:40' END) AS departures,
        DATE '1995-06-01' AS valid_from, CASE WHEN s_suppkey % 2 = 0 THEN DATE '2001-12-31' ELSE DATE '1999-12-31' END AS valid_until, {lon("s_suppkey")} AS lon, {lat("s_suppkey")} AS lat, {lon("s_suppkey")} - 6e-2 AS lon2, {lat("s_suppkey")} AS lat2 FROM {{supplier}}""",
    "proofs": """SELECT l_suppkey AS connection_id, CASE l_linenumber % 3 WHEN 0 THEN '/geometry' WHEN 1 THEN '/geometry/coordinates' ELSE '/schedule' END AS field, CASE l_returnflag WHEN 'A' THEN 'verified' ELSE 'unverified' END AS status, CAST(l_shipdate AS DATE) AS observed,
        CASE WHEN l_linenumber = 3 AND l_partkey % 50 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS valid_until FROM {lineitem}""",
    "uses": "SELECT tour_id, ord, pass_id AS connection_id, day, CAST(EPOCH_DAY(day) AS BIGINT) * 86400 + 18000 + CAST(sum(duration_s) OVER (PARTITION BY tour_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS arrival_s FROM {stops}",
    "walks": "SELECT id, lat, lon, CASE WHEN id % 3 = 0 THEN lat ELSE lat + (id % 5) * 1e-3 END AS lat2, CASE WHEN id % 3 = 0 THEN lon ELSE lon - 6e-2 END AS lon2, id % 2 = 0 AS retraced FROM {entities} WHERE entity_type = 'TrailRoute'",
    "records": """SELECT id, CASE WHEN id % 113 = 0 THEN 'Thing' ELSE entity_type END AS entity_type, CASE WHEN id % 89 = 0 THEN '-' || CAST(id AS STRING) ELSE 'entity:' || CAST(id AS STRING) END AS key, CASE WHEN id % 83 = 0 THEN '' ELSE 'N' || CAST(nation AS STRING) END AS jurisdiction, wlon AS lon, wlat AS lat, CASE WHEN id % 71 = 0 THEN confidence + 1 ELSE confidence END AS confidence,
        verification, CASE WHEN id % 67 = 0 THEN NULL ELSE observed END AS assessed, CASE WHEN id % 103 = 0 THEN 'hide' ELSE action END AS action, CASE WHEN id % 11 = 0 AND id % 2 = 0 THEN NULL ELSE 'wildlife' END AS reason, flag, CASE WHEN id % 5 = 0 THEN 1 + id % 100 END AS authority,
        CASE WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN wlon WHEN id % 7 = 2 THEN wlon + 400 ELSE floor(wlon * 10) / 10 END AS public_lon, CASE WHEN id % 7 = 1 THEN wlat ELSE floor(wlat * 10) / 10 END AS public_lat FROM {entities}""",
    "names": """SELECT id AS entity_id, k AS idx, CASE k WHEN 2 THEN CASE WHEN id % 59 = 0 THEN 'x1' ELSE 'ja-Latn' END ELSE 'en' END AS language, CASE WHEN id % 97 = 0 AND k = 2 THEN ' ' WHEN k = 3 THEN upper(name) WHEN k = 2 THEN name || ' two' ELSE name END AS value,
        CASE k WHEN 1 THEN CASE WHEN id % 53 = 0 THEN 'official' ELSE 'primary' END WHEN 2 THEN CASE WHEN id % 61 = 0 THEN 'nick' ELSE 'romanized' END ELSE 'alternate' END AS kind FROM (SELECT *, UNNEST(SEQ(CAST(1 AS BIGINT), 1 + id % 3)) AS k FROM {entities}) e WHERE id % 101 <> 0""",
    "positions": "SELECT id AS entity_id, k AS ord, wlon + CASE WHEN k IN (1, 2) THEN 1e-2 WHEN k = 4 AND id % 31 = 0 THEN 1e-3 ELSE 0e0 END AS lon, wlat + CASE WHEN k IN (2, 3) THEN 1e-2 ELSE 0e0 END + CASE WHEN id % 41 = 0 THEN 2e2 ELSE 0e0 END AS lat FROM (SELECT *, UNNEST(SEQ(0, 4)) AS k FROM {entities} WHERE entity_type = 'NaturalFeature') e WHERE NOT (id % 37 = 0 AND k > 2)",
    "bounds": "SELECT 'N' || CAST(n_nationkey AS STRING) AS jurisdiction, -170e0 + n_nationkey AS west, 175e0 AS east, -80e0 AS south, 84e0 AS north FROM {nation}",
    "evidence": """SELECT l_orderkey AS entity_id, CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE l_suppkey END AS source_id, CASE l_linenumber WHEN 1 THEN '/names' WHEN 2 THEN '/geometry' WHEN 3 THEN '/geometry/coordinates' WHEN 4 THEN CASE WHEN l_partkey % 17 = 0 THEN 'names' ELSE '/legacy/n' END ELSE '/quality' END AS field,
        CASE l_partkey % 11 WHEN 0 THEN 'verified_official' WHEN 1 THEN 'official_unverified' WHEN 2 THEN 'authoritative' WHEN 3 THEN 'community' WHEN 4 THEN 'field_report' WHEN 5 THEN 'derived' WHEN 6 THEN 'estimated' WHEN 7 THEN 'imported' WHEN 8 THEN 'survey' WHEN 9 THEN 'sensor' ELSE 'rumour' END AS kind,
        CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'R' THEN 'disputed' ELSE CASE WHEN l_partkey % 29 = 0 THEN 'guessed' ELSE 'unverified' END END AS status, CASE WHEN l_partkey % 43 = 0 THEN 15e-1 ELSE l_discount * 10 END AS confidence FROM {lineitem}""",
    "trails": """SELECT id, CASE WHEN id % 47 = 0 THEN 'Point' ELSE 'LineString' END AS geometry, CASE id % 5 WHEN 0 THEN 'generated' WHEN 1 THEN 'scenic_drive' WHEN 2 THEN CASE WHEN id % 79 = 0 THEN 'wild' ELSE 'established' END ELSE 'established' END AS nature, CASE WHEN id % 73 = 0 THEN NULL ELSE activity END AS activity,
        CASE id % 4 WHEN 0 THEN 'loop' WHEN 1 THEN 'out_and_back' WHEN 2 THEN 'point_to_point' ELSE 'star' END AS shape, CASE WHEN id % 6 = 0 THEN 'partial' ELSE 'complete' END AS completeness, CASE WHEN id % 61 = 0 THEN NULL ELSE 'suitable' END AS navigation, EPOCH_DAY(observed) + 60 AS planned_day FROM {entities} WHERE entity_type = 'TrailRoute' OR id % 10 = 1""",
    "media": """SELECT l_orderkey AS entity_id, l_linenumber AS idx, l_suppkey AS source_id, 'https://x.example/' || CAST(l_partkey AS STRING) AS url, CASE WHEN l_partkey % 19 = 0 THEN ' ' ELSE 'p' END AS page_url, CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE 'c' END AS creator, 'by' AS licence_id, CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE 'u' END AS licence_url, '4.0' AS licence_version,
        CASE WHEN l_partkey % 31 = 0 THEN '' ELSE 'a' END AS attribution, CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 'none' END AS modifications, CASE WHEN l_returnflag = 'N' THEN 'pending' ELSE 'approved' END AS review, CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS reviewed, l_partkey % 43 <> 0 AS display, l_partkey % 47 <> 0 AS commercial_use, l_linestatus = 'F' AS redistribution, CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE TRUE END AS may_modify FROM {lineitem} WHERE l_linenumber <= 3""",
    "members": "SELECT id, nation, CAST(id % 7 AS INT) AS shard, CAST(floor(bytes) AS BIGINT) AS bytes FROM {entities} WHERE action = 'publish'",
    "delivered": "SELECT nation, shard, CAST(sum(bytes) AS BIGINT) AS bytes, md5(CAST(sum(bytes) AS STRING) || ':' || CAST(count(*) AS STRING)) AS hash FROM {members} WHERE NOT (nation = 3 AND shard = 2) GROUP BY nation, shard",
    "shards": """SELECT nation, shard, jurisdiction, declared, CASE WHEN nation = 5 AND shard = 1 THEN bytes + 1 ELSE bytes END AS bytes, CASE WHEN nation = 6 AND shard = 0 THEN 'x' ELSE hash END AS hash FROM (SELECT nation, shard, 'N' || CAST(nation AS STRING) AS jurisdiction, CAST(CASE WHEN nation = 4 THEN 6 WHEN nation = 8 AND shard = 1 THEN 8 ELSE 7 END AS INT) AS declared, CAST(sum(bytes) AS BIGINT) AS bytes, md5(CAST(sum(bytes) AS STRING) || ':' || CAST(count(*) AS STRING)) AS hash FROM {members} WHERE NOT (nation = 7 AND shard = 3) GROUP BY nation, shard) s
        UNION ALL SELECT nation, shard, 'N9', CAST(7 AS INT), CAST(sum(bytes) AS BIGINT), 'y' FROM {members} WHERE nation = 9 AND shard = 4 GROUP BY nation, shard""",
    "pass_edges": """SELECT id AS pass_id, side, kind, id * 3 + CASE side WHEN 'A' THEN 1 ELSE 2 END AS a, CASE WHEN id % 23 = 0 THEN -1 ELSE id * 3 END AS b, d * CASE kind WHEN 'out-and-back' THEN CASE WHEN id % 13 = 0 THEN 9e-1 ELSE 2e0 END ELSE 1e0 END AS distance_m, CASE WHEN id % 19 = 0 THEN NULL ELSE d * CASE kind WHEN 'descent' THEN 85e-2 WHEN 'out-and-back' THEN CASE WHEN id % 29 = 0 THEN 5e-1 ELSE 168e-2 END ELSE 1e0 END END AS cost
        FROM (SELECT id, side, kind, (elev - 600) * 15e-1 AS d FROM (SELECT *, UNNEST(ARR('climb', 'descent', 'out-and-back')) AS kind FROM (SELECT *, UNNEST(ARR('A', 'B')) AS side FROM {passes}) a) k) e WHERE NOT (id % 17 = 0 AND side = 'B' AND kind = 'descent')""",
    "raw_nodes": "SELECT CASE WHEN id % 90 = 0 THEN NULL ELSE id END AS id, CASE WHEN id % 50 = 0 THEN 'mystery' ELSE kind END AS kind, CASE WHEN id % 70 = 0 THEN 1e2 ELSE lat END AS lat, lon FROM {road_nodes} UNION ALL SELECT id, kind, lat, lon FROM {road_nodes} WHERE id % 40 = 0",
    "raw_edges": "SELECT a, b FROM {pass_edges} UNION ALL SELECT a, a FROM {pass_edges} WHERE a % 45 = 1",
    "declared_stats": "SELECT 3 * count(*) AS nodes, 6 * count(*) AS edges FROM {passes}",
    "conditions": """SELECT l_orderkey AS entity_id, l_partkey % 9 <> 0 AS active, CASE l_partkey % 6 WHEN 0 THEN 'closed' WHEN 1 THEN 'forbidden' WHEN 2 THEN 'expired' ELSE 'open' END AS state, CASE l_suppkey % 8 WHEN 0 THEN 'trail_closure' WHEN 1 THEN 'fire' WHEN 2 THEN 'avalanche' ELSE 'weather' END AS kind, CASE l_linenumber % 3 WHEN 0 THEN 'high' ELSE 'low' END AS severity, l_linestatus = 'F' AS blocking, l_partkey % 33 = 0 AS unsafe,
        CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS valid_from, CASE WHEN l_partkey % 14 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) END AS valid_until FROM {lineitem}""",
    "safety": """SELECT id, CASE id % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'seasonal' WHEN 2 THEN CASE WHEN id % 10 = 2 THEN 'scheduled' ELSE 'live' END ELSE CASE WHEN id % 9 = 3 THEN 'expired' ELSE 'live' END END AS state, verification, CASE WHEN id % 15 = 0 THEN 'expired' WHEN id % 8 = 0 THEN 'stale' ELSE 'current' END AS freshness, now_s, now_s - (id % 90) * 3600 AS checked_s,
        CASE WHEN id % 3 = 0 THEN now_s + (id % 5 - 3) * 86400 END AS own_from, CASE WHEN id % 3 = 1 THEN now_s + (id % 5 - 1) * 86400 END AS own_until FROM (SELECT id, verification, (CAST(EPOCH_DAY(observed) AS BIGINT) + 60) * 86400 AS now_s FROM {entities}) e""",
    "safety_windows": """SELECT l_orderkey AS record_id, l_suppkey AS source_id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(EPOCH_DAY(CAST(l_shipdate AS DATE)) AS BIGINT) * 86400 END AS from_s, CASE WHEN l_partkey % 3 = 0 THEN (CAST(EPOCH_DAY(CAST(l_shipdate AS DATE)) AS BIGINT) + CAST(l_quantity AS INT)) * 86400 END AS until_s, CAST(NULL AS BIGINT) AS observed_s FROM {lineitem}""",
    "inventory": "SELECT 'places' AS input, name FROM {places} UNION ALL SELECT 'passes', name FROM {passes} UNION ALL SELECT 'entities', name FROM {entities}",
    "price_cache": "SELECT DISTINCT name FROM {places} WHERE size > 40 UNION SELECT DISTINCT name FROM {entities} WHERE id % 2 = 0 UNION SELECT 'Nobody ' || CAST(id AS STRING) FROM {passes} WHERE id % 10 = 0",
    "cell_copies": f"""SELECT id AS entity_id, x, y, CASE WHEN id % 31 = 0 AND k = 1 THEN 'changed' ELSE name END AS hash FROM (SELECT *, {tile_x("wlon")} + CAST(k AS INT) AS x, {tile_y("wlat")} AS y FROM (SELECT *, UNNEST(SEQ(0, 1)) AS k FROM {{entities}}) e) c""",
    "viewport": f"SELECT x, y FROM (SELECT CAST(x AS INT) AS x, UNNEST(SEQ(60, 190)) AS y FROM (SELECT UNNEST(SEQ(0, 255)) AS x) a) b WHERE x >= 250 OR x <= 5",
    "finds": """SELECT e.*, e.name AS title, (e.id * 83 % 101) / 1e2 AS variety, ARR(e.activity, CASE WHEN e.id % 2 = 0 THEN 'walking' ELSE 'swimming' END) AS activities, CASE WHEN e.season IS NULL THEN NULL ELSE ARR(e.season) END AS seasons, ARR(e.mode, 'foot') AS modes, CASE WHEN e.flag IS NULL THEN NULL ELSE ARR(e.flag) END AS flags,
        CASE e.id % 9 WHEN 0 THEN ARR('iconic') WHEN 1 THEN ARR('hidden-gem', 'lakes') ELSE ARR('lakes') END AS themes, ARR(lower(e.entity_type)) AS terms, CASE WHEN e.id % 4 = 0 THEN NULL ELSE CAST(e.id * 7 % 600 AS DOUBLE) END AS minutes FROM {entities} e""",
    "search_documents": "SELECT id, name AS title, lower(name) AS name, lower(name || ' ' || entity_type || ' ' || activity || ' ' || coalesce(season, '')) AS text, activity, lat, lon FROM {entities}",
    "search_queries": f"""SELECT n_nationkey AS query_id, CASE n_nationkey % 6 WHEN 0 THEN 'entity ' || CAST(n_nationkey * 7 + 12 AS STRING) WHEN 1 THEN 'entitty ' || CAST(n_nationkey * 5 + 100 AS STRING) WHEN 2 THEN CAST(n_nationkey + 3 AS STRING) || ' trailroute hiking' WHEN 3 THEN 'autumn cyclng' WHEN 4 THEN '' ELSE 'nothing like it' END AS query,
        46e0 AS lat, 75e-1 + n_nationkey * 1e-1 AS lon, CASE WHEN n_nationkey % 3 = 0 THEN 200e3 END AS within_m, CASE WHEN n_nationkey % 4 = 0 THEN 'hiking' END AS activity FROM {{nation}}""",
    "ranked_passes": f"SELECT *, floor(12742e3 * asin(sqrt(pow(sin(radians(lat - 46e0) / 2), 2) + cos(radians(46e0)) * cos(radians(lat)) * pow(sin(radians(lon - 8e0) / 2), 2))) / 1e3 + 5e-1) AS metres FROM {{passes}}",
    "ranked_nodes": "SELECT 'junction' AS kind, 0 AS cls, n_nationkey AS id, 0e0 AS worth, 0 AS cell FROM {nation} UNION ALL SELECT 'poi', CASE WHEN score >= 9 THEN 1 ELSE 3 END, id, score, CAST(score AS INT) FROM {places} UNION ALL SELECT 'pass', 2, id, quality, CAST(floor(quality * 50) AS INT) FROM {passes}",
    "node_cap": "SELECT 300 AS cap FROM {region} WHERE r_regionkey = 0",
    "starts": "SELECT n_nationkey AS start_id, 1 + n_nationkey % 9 AS node, 2e3 + n_nationkey * 500 AS budget FROM {nation}",
    "pinned_tags": "SELECT o.o_custkey AS user_id, p.family AS tag, count(*) AS n FROM {orders} o JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey JOIN {places} p ON p.id = l.l_partkey GROUP BY o.o_custkey, p.family",
    "priors": "SELECT c_mktsegment AS persona, count(*) / 1e9 AS prior FROM {customer} GROUP BY c_mktsegment",
    "user_context": "SELECT c_custkey AS user_id, CASE c_custkey % 3 WHEN 0 THEN 'winter' WHEN 1 THEN 'summer' END AS context FROM {customer}",
    "context_boosts": "SELECT 'winter' AS context, 'BUILDING' AS persona, 3e-1 AS boost FROM {region} WHERE r_regionkey = 0 UNION ALL SELECT 'summer', 'MACHINERY', 4e-1 FROM {region} WHERE r_regionkey = 0",
    "closed_passes": "SELECT DISTINCT id AS pass_id FROM {passes} WHERE closes IS NOT NULL AND elev > 2000",
    "required_refs": """SELECT id, CASE WHEN id % 3 = 0 THEN CAST(floor(id / 3) AS BIGINT) END AS ref FROM {entities} UNION ALL SELECT id, CAST(floor(id / 5) AS BIGINT) + 1 FROM {entities} WHERE id % 5 = 1
        UNION ALL SELECT id, CASE WHEN id % 40 = 7 THEN id + 3 ELSE id - 3 END FROM {entities} WHERE id % 40 IN (7, 10)""",
    "closure_rules": "SELECT id AS pass_id, 'no' AS value, closes AS from_month, opens AS to_month FROM {passes} WHERE closes IS NOT NULL UNION ALL SELECT id, CASE WHEN id % 2 = 0 THEN 'destination' ELSE 'closed' END, 7, 8 FROM {passes} WHERE id % 7 = 1 UNION ALL SELECT id, 'private', 5, CAST(NULL AS INT) FROM {passes} WHERE id % 7 = 2",
    "seasons": "SELECT id AS pass_id, open_day AS open_doy, close_day AS close_doy FROM {passes} WHERE open_day IS NOT NULL",
    "readings": "SELECT id, pass_id, ts, source, state, CASE WHEN state = 'closed' THEN 'closed-until' END AS hint_kind, CASE WHEN state = 'closed' THEN CAST(1 + id % 28 AS INT) END AS hint_day, CASE WHEN state = 'closed' THEN CAST(1 + id % 12 AS INT) END AS hint_month, CAST(NULL AS INT) AS hint_year FROM {statuses} WHERE id % 9 < 4",
    "asked_days": "SELECT p.id AS pass_id, DATE '2024-01-20' AS today, DATE '2024-01-20' + d AS day, d AS days FROM (SELECT id, UNNEST(ARR(0, 20, 31, 32, 90, 200)) AS d FROM {passes}) p",
    "trip_stops": "SELECT s.tour_id, s.ord, s.pass_id, p.name, DATE '2024-01-20' AS today, s.day + 9862 AS day FROM {stops} s JOIN {passes} p ON p.id = s.pass_id",
    "linked_records": """SELECT id, name, action, CASE id % 8 WHEN 0 THEN 'TrailRoute' WHEN 1 THEN 'AccessPoint' WHEN 2 THEN 'TransportConnection' WHEN 3 THEN 'TrailSegment' WHEN 4 THEN 'Hazard' WHEN 5 THEN 'Condition' WHEN 6 THEN 'Restriction' ELSE 'PermitRequirement' END AS entity_type,
        CASE WHEN id % 3 = 0 THEN ARR(id - id % 8, id - id % 8 + 8, id + 1) WHEN id % 3 = 1 THEN ARR(id - id % 8, id - id % 8) END AS linkedEntityIds,
        ARR(id + 9, id + 1, id + 1, id * 2 + 1) AS accessPointIds, CASE WHEN id % 5 > 0 THEN ARR(id + 2) END AS transportConnectionIds, ARR(id * 7, id * 3) AS priceIds, CASE WHEN id % 16 = 0 THEN ARR(id + 16, id + 8) END AS stageIds,
        CASE WHEN id % 24 = 0 THEN ARR(id + 24) END AS variantIds, ARR(id + 11, id + 3, id + 19) AS segmentIds, CASE WHEN id % 2 = 0 THEN ARR(id + 6) END AS restrictionRefs, ARR(id + 12, id + 4) AS hazardRefs,
        CASE WHEN id % 7 = 0 THEN ARR(id + 5, id + 6) END AS conditionRefs, CASE WHEN id % 9 > 3 THEN ARR(id + 15) END AS permitRequirementIds, ARR(id + 40) AS openingScheduleIds FROM {entities}""",
    "planned_routes": """SELECT id, CAST(observed AS TIMESTAMP) AS at, CASE WHEN id % 23 = 0 THEN ' Closed' WHEN id % 29 = 0 THEN 'private' WHEN id % 31 = 0 THEN 'unsafe' ELSE 'open' END AS access_state, CASE WHEN id % 7 = 0 THEN 'unverified' WHEN id % 77 = 1 THEN NULL ELSE 'verified' END AS verification, CASE WHEN id % 9 = 0 THEN 'stale' ELSE 'current' END AS freshness,
        CASE WHEN id % 41 = 0 THEN NULL WHEN id % 13 = 0 THEN CAST(observed + 3 AS TIMESTAMP) ELSE CAST(observed AS TIMESTAMP) END AS assessed_at, CASE WHEN id % 37 = 0 THEN NULL WHEN id % 12 = 0 THEN ARR('critical_condition_unknown') WHEN id % 12 = 4 THEN ARR('parking_fee_unknown', 'official_centerline') WHEN id % 60 = 8 THEN ARR('rockfall_hazard') WHEN id % 60 = 20 THEN ARR('bridge_access_unknown') ELSE ARR('official_centerline') END AS flags, id % 8 = 0 AS sensitive FROM {entities} WHERE entity_type = 'TrailRoute'""",
    "route_notices": "SELECT l_orderkey AS route_id, l_partkey * 10 + l_linenumber AS id, l_linenumber AS position, CASE WHEN l_linenumber % 3 = 0 THEN 'restriction' ELSE 'condition' END AS source, l_partkey % 9 <> 0 AS active, CASE l_partkey % 16 WHEN 0 THEN 'closed' WHEN 1 THEN 'forbidden' WHEN 2 THEN 'expired' ELSE 'open' END AS state, CASE l_suppkey % 11 WHEN 0 THEN 'trail_closure' WHEN 1 THEN 'fire' WHEN 2 THEN 'safety' WHEN 3 THEN 'private_land' ELSE 'weather' END AS kind, CASE l_linenumber % 3 WHEN 0 THEN 'high' ELSE 'low' END AS severity, CASE l_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS blocking, l_partkey % 33 = 0 AS unsafe, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) END AS valid_from, CASE WHEN l_partkey % 14 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) * 5 AS TIMESTAMP) END AS valid_until FROM {lineitem}",
    "notes": """SELECT id, kind, day, month, year, CASE kind WHEN 'predicted' THEN CASE id % 2 WHEN 0 THEN 'Predicted opening: ' ELSE 'Status: voraussichtliche Öffnung ' END WHEN 'open-from' THEN CASE id % 3 WHEN 0 THEN 'Pass opens on ' WHEN 1 THEN 'reopens again from ' ELSE 'Offen ab ' END WHEN 'closed-until' THEN CASE id % 2 WHEN 0 THEN 'Closed until ' ELSE 'Wintersperre bis ' END ELSE 'Road works, single lane ' END
        || CASE style WHEN 0 THEN CAST(day AS STRING) || '.' || CAST(month AS STRING) || '.' WHEN 1 THEN lpad(CAST(day AS STRING), 2, '0') || '/' || lpad(CAST(month AS STRING), 2, '0') || '/' || CAST(year AS STRING) WHEN 2 THEN en || ' ' || CAST(day AS STRING) || 'th, ' || CAST(year AS STRING) ELSE CAST(day AS STRING) || '. ' || de END AS info, style
        FROM (SELECT id, CAST(1 + id % 28 AS INT) AS day, CAST(1 + id % 12 AS INT) AS month, CAST(2020 + id % 5 AS INT) AS year, id % 4 AS style, CASE id % 5 WHEN 0 THEN 'predicted' WHEN 1 THEN 'open-from' WHEN 2 THEN 'closed-until' WHEN 3 THEN 'open-from' ELSE 'none' END AS kind,
            CASE id % 12 WHEN 0 THEN 'January' WHEN 1 THEN 'Feb' WHEN 2 THEN 'March' WHEN 3 THEN 'April' WHEN 4 THEN 'May' WHEN 5 THEN 'June' WHEN 6 THEN 'July' WHEN 7 THEN 'August' WHEN 8 THEN 'Sept' WHEN 9 THEN 'October' WHEN 10 THEN 'November' ELSE 'Dec' END AS en, CASE id % 12 WHEN 0 THEN 'Januar' WHEN 1 THEN 'Februar' WHEN 2 THEN 'März' WHEN 3 THEN 'April' WHEN 4 THEN 'Mai' WHEN 5 THEN 'Juni' WHEN 6 THEN 'Juli' WHEN 7 THEN 'August' WHEN 8 THEN 'September' WHEN 9 THEN 'Oktober' WHEN 10 THEN 'November' ELSE 'Dezember' END AS de FROM {statuses}) s""",
    "named_passes": "SELECT id, elev, CASE id % 4 WHEN 0 THEN 'Alpha ' || CAST(id % 40 AS STRING) || ' Pass / Beta ' || CAST(id AS STRING) WHEN 1 THEN 'Col Gamma ' || CAST(id % 25 AS STRING) ELSE 'Delta-' || CAST(id % 30 AS STRING) || ' Joch' END AS name FROM {passes}",
    "alerts": "SELECT user_id AS id, CASE user_id % 3 WHEN 0 THEN 'ALPHA ' || CAST(user_id % 44 AS STRING) WHEN 1 THEN 'Còl Gamma ' || CAST(user_id % 25 AS STRING) || ' - East' ELSE 'Nothing/Delta ' || CAST(user_id % 33 AS STRING) || ' pass' END AS name, CASE WHEN user_id % 7 = 0 THEN NULL ELSE 800 + (user_id * 37) % 2200 END AS elev FROM {users}",
    "etas": "SELECT id, pass_id, CAST(floor(EPOCH_US(ts) / 1e6) AS BIGINT) AS at_s FROM {statuses} WHERE state = 'open'",
    "forecasts": "SELECT pass_id, hour_s, CAST(max(code) AS INT) AS code FROM (SELECT pass_id, CAST(floor(EPOCH_US(ts) / 36e8) AS BIGINT) * 3600 AS hour_s, id % 100 AS code FROM {statuses} WHERE state <> 'open') s GROUP BY pass_id, hour_s",
    "history": "SELECT pass_id, CAST(EXTRACT(YEAR FROM day) AS INT) AS year, min(CASE WHEN EXTRACT(MONTH FROM day) < 7 THEN day END) AS open, max(CASE WHEN EXTRACT(MONTH FROM day) >= 7 THEN day END) AS close FROM {stops} WHERE place_id % 20 = 0 GROUP BY pass_id, CAST(EXTRACT(YEAR FROM day) AS INT)",
    "clustered": f"SELECT CAST({tile_x('lon', 10)} AS BIGINT) * 4096 + {tile_y('lat', 10)} AS cluster, s.state, s.source AS kind FROM {{statuses}} s JOIN {{passes}} p ON p.id = s.pass_id",
    "region_texts": "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Near ' || n_name || ', in the hills' WHEN 1 THEN n_name || ' / ' || r_name WHEN 2 THEN lower(r_name) || ' border' ELSE 'somewhere' END AS text FROM {orders} JOIN {nation} ON n_nationkey = o_custkey % 25 JOIN {region} ON r_regionkey = n_regionkey",
    "place_words": "SELECT lower(n_name) AS word, n_name AS jurisdiction FROM {nation} UNION ALL SELECT lower(r_name), r_name FROM {region}",
    "delivery": "SELECT n_name AS jurisdiction, r_name AS region FROM {nation} JOIN {region} ON r_regionkey = n_regionkey",
    "cell_packages": f"SELECT x, y, count(*) AS packages, CAST(sum(b) AS BIGINT) AS bytes FROM (SELECT {tile_x('wlon')} AS x, {tile_y('wlat')} AS y, CAST(floor(bytes) AS BIGINT) AS b FROM {{entities}}) e GROUP BY x, y",
    "raw_bases": "SELECT pass_id, side, lat + 1e-3 AS lat, lon FROM {bases} WHERE pass_id % 3 = 0",
    "raw_viewpoints": "SELECT pass_id, lat, lon FROM (SELECT p.id AS pass_id, p.lat + (k % 3) * 1e-2 AS lat, p.lon + (k % 2) * 3e-2 AS lon FROM (SELECT *, UNNEST(SEQ(0, 5)) AS k FROM {passes}) p) v",
    "junction_rows": f"SELECT n_nationkey AS id, {lon('n_nationkey')} AS lon, {lat('n_nationkey')} AS lat FROM {{nation}}",
    "known_heights": "SELECT 'poi:' || CAST(id AS STRING) AS key, 400e0 + size * 20 AS elev FROM {places} WHERE size % 2 = 0",
    "slugged": "SELECT id, 'pass-' || CAST(nation AS STRING) || '-' || CAST(elev % 10 AS STRING) AS slug, 'seed' || CAST(CASE WHEN id % 7 = 0 THEN 0 ELSE id END AS STRING) AS seed FROM {passes}",
    "straight_tours": "SELECT tour_id, CAST(sum(CAST(distance_m AS BIGINT)) AS DOUBLE) AS straight_m, bool_or(kind = 'pass-climb') AS alpine FROM {stops} GROUP BY tour_id",
    "provider_facts": "SELECT id AS tour_id, CASE WHEN id % 3 = 0 THEN NULL ELSE floor(bytes) END AS distance_m, CASE WHEN id % 5 = 0 THEN 0e0 ELSE floor(bytes / 20) END AS duration_s FROM {entities}",
    "open_tours": "SELECT id AS tour_id, id % 2 = 0 AS closed, 'from ' || name AS start_name, 'to ' || activity AS end_name FROM {entities}",
    "tour_breaks": "SELECT tour_id, ord + 4e-1 AS position FROM {stops} WHERE place_id % 9 = 0",
    "implicit": "SELECT tour_id, pass_id + 1 AS pass_id, ord AS first FROM {stops} WHERE place_id % 13 = 0",
    "pass_signals": "SELECT id, CAST(elev AS DOUBLE) AS elev, quality, CAST(id * 7 % 13 AS DOUBLE) AS peaks, 1e0 AS waters FROM {passes}",
    "open_passes": "SELECT id, lat, lon, closes IS NULL AS open FROM {passes}",
    "place_rows": "SELECT id, name, ARR(family, lower(category)) AS kinds, CASE WHEN size % 7 = 0 THEN ARR('iconic') WHEN size % 7 = 1 THEN ARR('hidden-gem') ELSE ARR('lake') END AS themes, CASE WHEN size % 2 = 0 THEN ARR('car', 'foot') ELSE ARR('foot') END AS access, score, CASE WHEN size % 5 = 0 THEN NULL ELSE size * 3 END AS minutes, size % 11 = 0 AS protected FROM {places}",
    "cached_places": "SELECT name, CASE WHEN max(size) > 25 THEN 'train' END AS access, CASE WHEN max(size) % 3 = 0 THEN NULL ELSE 75e-2 END AS confidence FROM {places} WHERE size > 20 GROUP BY name",
    "model_passes": "SELECT id, CASE WHEN id % 2 = 0 THEN name || ' / Other ' || CAST(id AS STRING) ELSE name END AS name, elev, quality, CASE WHEN id % 3 = 0 THEN NULL ELSE 8e-1 END AS confidence, CASE WHEN id % 10 = 0 THEN 1 ELSE 2 END AS bases FROM {passes}",
    "curated_links": "SELECT id AS pass_id, 1 AS rank, 'drive:' || CAST(id % 9 AS STRING) AS link FROM {passes} WHERE id % 2 = 0",
    "derived_links": "SELECT a AS pass_id, CAST(b AS INT) AS rank, 'drive:' || CAST(b % 9 AS STRING) AS link FROM {edges} WHERE b < 4",
    "users": "SELECT c_custkey AS user_id, c_mktsegment AS persona, c_acctbal AS balance, c_nationkey AS nation FROM {customer}",
}


def resolve(query: str) -> str:
    """query with adapters written out; base tables stay {name}."""
    for _ in range(6):
        query = re.sub(r"\{([a-z]\w*)\}", lambda m: "{" + m[1] + "}" if m[1] in BASE else "(" + ADAPTERS[m[1]].replace("{{", "{").replace("}}", "}") + ")", query)
    return query


def oracle(query: str) -> str:
    """The DuckDB text of a query over adapters and base tables."""
    return re.sub(r"\{([a-z]\w*)\}", r"\1", duckdb_dialect(resolve(query)))


#: Rows of a base table for each task, on average, where it is dealt out by a key.
ROWS = 250_000


class Tables:
    """Base tables and adapters of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._rows = spark, sf_dir, {}

    def parts(self, name: str) -> int:
        """Partitions for what is made of a base table. Adaptive execution would merge them by the bytes that are shuffled,
        which windows, sorts and generators widen many times afterwards."""
        if name not in self._rows:
            self._rows[name] = getattr(self, name).count()
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-self._rows[name] // ROWS))

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in ADAPTERS:
            return self.sql("SELECT * FROM {" + name + "}")
        raise AttributeError(name)

    def sql(self, query: str) -> DataFrame:
        ordered = re.search(r"\bord\b|SELECT \* FROM", query)
        query = resolve(query)
        used = {n: getattr(self, n) for n in re.findall(r"\{([a-z]\w*)\}", query)}
        if ordered and "PARTITION BY l_orderkey" in query:  # stops in order: a tour's work goes on where they are numbered
            used["lineitem"] = used["lineitem"].repartition(self.parts("lineitem"), "l_orderkey")
        return self.spark.sql(spark_dialect(query), **used)
