"""Records of the place catalogue: rules that each must keep, rights and sensitivity, packages and their identity."""

from waymark.functions.sql import haversine
from waymark.operators import define

#: What each field may hold.
TYPES = "'TrailRoute', 'Place', 'AccessPoint', 'NaturalFeature', 'ProtectedArea', 'TransportConnection', 'Condition', 'Price'"
NAME_KINDS = "'primary', 'official', 'alternate', 'translated', 'romanized', 'historic'"
EVIDENCE_KINDS = "'verified_official', 'official_unverified', 'authoritative', 'community', 'field_report', 'derived', 'estimated', 'imported', 'survey', 'sensor'"
STATES = "'verified', 'partially_verified', 'unverified', 'disputed', 'expired'"
TRANSPORT = "'ferry', 'bus', 'rail', 'tram', 'cable_car', 'gondola', 'funicular', 'cog_railway', 'boat', 'pickup'"
OUTSIDE = "lon IS NULL OR lat IS NULL OR isnan(lon) OR isnan(lat) OR abs(lon) > 180 OR abs(lat) > 90"

val_entity_common = define(
    "val_entity_common", "Violations of the common rules (identity, names, geometry, provenance, quality, sensitivity), one row for each record and rule.",
    f"""SELECT id, rule, count(*) AS n FROM (
        SELECT id, 'type unsupported' AS rule FROM {{records}} WHERE entity_type IS NULL OR entity_type NOT IN ({TYPES})
        UNION ALL SELECT id, 'key not readable' FROM {{records}} WHERE NOT coalesce(REGEX_HAS(key, '^[A-Za-z0-9][A-Za-z0-9:._-]+$') AND length(key) BETWEEN 3 AND 160, FALSE)
        UNION ALL SELECT id, 'jurisdiction missing' FROM {{records}} WHERE jurisdiction IS NULL OR jurisdiction = ''
        UNION ALL SELECT r.id, 'names missing' FROM {{records}} r WHERE NOT EXISTS (SELECT 1 FROM {{names}} n WHERE n.entity_id = r.id)
        UNION ALL SELECT entity_id, 'name blank' FROM {{names}} WHERE value IS NULL OR trim(value) = ''
        UNION ALL SELECT entity_id, 'language tag' FROM {{names}} WHERE NOT coalesce(REGEX_HAS(language, '^([A-Za-z][A-Za-z][A-Za-z]?(-[A-Za-z0-9]+)*|und)$'), FALSE)
        UNION ALL SELECT entity_id, 'name kind' FROM {{names}} WHERE kind IS NULL OR kind NOT IN ({NAME_KINDS})
        UNION ALL SELECT entity_id, 'name repeated' FROM (SELECT entity_id, row_number() OVER (PARTITION BY entity_id, lower(language), lower(trim(value)) ORDER BY idx) AS r FROM {{names}}) d WHERE r > 1
        UNION ALL SELECT entity_id, 'no primary name' FROM {{names}} GROUP BY entity_id HAVING count_if(kind = 'primary') = 0
        UNION ALL SELECT entity_id, 'position invalid' FROM {{positions}} WHERE {OUTSIDE}
        UNION ALL SELECT entity_id, 'ring short' FROM {{positions}} GROUP BY entity_id HAVING count(*) < 4
        UNION ALL SELECT entity_id, 'ring open' FROM {{positions}} GROUP BY entity_id HAVING count(*) >= 4 AND (abs(min_by(lon, ord) - max_by(lon, ord)) > 1e-8 OR abs(min_by(lat, ord) - max_by(lat, ord)) > 1e-8)
        UNION ALL SELECT p.entity_id, 'outside the jurisdiction' FROM (SELECT entity_id, min(lon) AS west, max(lon) AS east, min(lat) AS south, max(lat) AS north FROM {{positions}} GROUP BY entity_id) p JOIN {{records}} r ON r.id = p.entity_id JOIN {{bounds}} b ON b.jurisdiction = r.jurisdiction WHERE p.west < b.west OR p.east > b.east OR p.south < b.south OR p.north > b.north
        UNION ALL SELECT r.id, 'no assertion' FROM {{records}} r WHERE NOT EXISTS (SELECT 1 FROM {{evidence}} a WHERE a.entity_id = r.id)
        UNION ALL SELECT entity_id, 'assertion without source' FROM {{evidence}} WHERE source_id IS NULL
        UNION ALL SELECT entity_id, 'assertion pointer' FROM {{evidence}} WHERE field IS NULL OR field NOT LIKE '/%'
        UNION ALL SELECT entity_id, 'evidence kind' FROM {{evidence}} WHERE kind IS NULL OR kind NOT IN ({EVIDENCE_KINDS})
        UNION ALL SELECT entity_id, 'assertion state' FROM {{evidence}} WHERE status IS NULL OR status NOT IN ({STATES})
        UNION ALL SELECT entity_id, 'assertion confidence' FROM {{evidence}} WHERE confidence < 0 OR confidence > 1
        UNION ALL SELECT id, 'quality confidence' FROM {{records}} WHERE confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1
        UNION ALL SELECT id, 'quality state' FROM {{records}} WHERE verification IS NULL OR verification NOT IN ({STATES})
        UNION ALL SELECT id, 'quality not dated' FROM {{records}} WHERE assessed IS NULL
        UNION ALL SELECT id, 'sensitivity action' FROM {{records}} WHERE action IS NULL OR action NOT IN ('publish', 'coarsen', 'redact', 'exclude')
        UNION ALL SELECT id, 'sensitivity without reason' FROM {{records}} WHERE action <> 'publish' AND reason IS NULL
    ) v GROUP BY id, rule""",
)

val_entity_types = define(
    "val_entity_types", "Violations of the rules of routes, access points and connections; established routes have no gap over 50 km between vertices.",
    f"""SELECT kind, id, rule FROM (
        SELECT 'route' AS kind, id, 'geometry is no line' AS rule FROM {{trails}} WHERE geometry NOT IN ('LineString', 'MultiLineString')
        UNION ALL SELECT 'route', id, 'nature' FROM {{trails}} WHERE nature IS NULL OR nature NOT IN ('established', 'generated', 'scenic_drive')
        UNION ALL SELECT 'route', id, 'no activity' FROM {{trails}} WHERE activity IS NULL
        UNION ALL SELECT 'route', id, 'shape' FROM {{trails}} WHERE shape IS NULL OR shape NOT IN ('loop', 'out_and_back', 'point_to_point', 'network', 'stage')
        UNION ALL SELECT 'route', id, 'established but incomplete' FROM {{trails}} WHERE nature = 'established' AND completeness <> 'complete'
        UNION ALL SELECT 'route', id, 'navigation not explicit' FROM {{trails}} WHERE navigation IS NULL
        UNION ALL SELECT 'route', t.id, 'gap' FROM {{trails}} t JOIN (SELECT tour_id, max({haversine("plat", "plon", "lat", "lon")}) AS gap FROM (SELECT tour_id, lon, lat, lag(lon) OVER w AS plon, lag(lat) OVER w AS plat FROM {{stops}} WINDOW w AS (PARTITION BY tour_id ORDER BY ord)) g WHERE plon IS NOT NULL GROUP BY tour_id) s ON s.tour_id = t.id WHERE t.nature = 'established' AND t.completeness = 'complete' AND s.gap > 50e3
        UNION ALL SELECT 'access', id, 'no mode' FROM {{entities}} WHERE entity_type = 'AccessPoint' AND mode IS NULL
        UNION ALL SELECT 'access', id, 'legal access not explicit' FROM {{entities}} WHERE entity_type = 'AccessPoint' AND (legal IS NULL OR legal NOT IN ('legal', 'restricted', 'private', 'unknown'))
        UNION ALL SELECT 'connection', id, 'mode' FROM {{connections}} WHERE mode IS NULL OR mode NOT IN ({TRANSPORT})
        UNION ALL SELECT 'connection', id, 'not two ends' FROM {{connections}} WHERE end_a IS NULL OR end_b IS NULL
        UNION ALL SELECT 'connection', id, 'ends equal' FROM {{connections}} WHERE end_a = end_b
        UNION ALL SELECT 'connection', id, 'direction' FROM {{connections}} WHERE direction NOT IN ('outbound', 'return', 'both')
        UNION ALL SELECT 'connection', id, 'zone blank' FROM {{connections}} WHERE trim(zone) = ''
    ) v""",
)

RIGHTS = ("url", "page_url", "creator", "licence_id", "licence_url", "licence_version", "attribution", "modifications")
ALLOWED = ("display", "commercial_use", "redistribution", "may_modify")
MISSING = ", ".join([f"CASE WHEN {f} IS NULL OR trim({f}) = '' THEN '{f}' END" for f in RIGHTS] + ["CASE WHEN review IS NULL OR review <> 'approved' THEN 'review' END", "CASE WHEN reviewed IS NULL THEN 'reviewed' END"] + [f"CASE WHEN NOT coalesce({p}, FALSE) THEN '{p}' END" for p in ALLOWED])
JUDGED_MEDIA = f"(SELECT m.entity_id, m.idx, concat_ws(',', CASE WHEN s.id IS NULL OR s.disposition <> 'approved' OR NOT s.media_use THEN 'source' END, {MISSING}) AS missing FROM {{media}} m LEFT JOIN {{sources}} s ON s.id = m.source_id)"

gov_media_rights = define("gov_media_rights", "Media whose rights are incomplete: an approved media source, eight texts, review and its date, four permissions; with what is missing.", f"SELECT entity_id, idx, missing FROM {JUDGED_MEDIA} m WHERE missing <> ''")

TOUCHED = "(SELECT entity_id, source_id FROM {assertions} UNION SELECT id, authority FROM {records} WHERE authority IS NOT NULL)"
gov_publication = define(
    "gov_publication", "Records with the media stripped for rights, the label of an unverified lead, and whether they are withheld because a source that they touch is not approved.",
    f"""SELECT r.id, coalesce(m.stripped, 0) AS media_stripped, coalesce(m.kept, 0) AS media_kept, coalesce(g.leads, 0) > 0 AS labelled_lead, coalesce(g.unapproved, 0) > 0 AS withheld, coalesce(g.unapproved, 0) AS unapproved FROM {{records}} r
        LEFT JOIN (SELECT entity_id, count_if(missing <> '') AS stripped, count_if(missing = '') AS kept FROM {JUDGED_MEDIA} j GROUP BY entity_id) m ON m.entity_id = r.id
        LEFT JOIN (SELECT t.entity_id, count_if(coalesce(s.disposition, 'unknown') <> 'approved') AS unapproved, count_if(s.disposition IN ('lead_only', 'link_only')) AS leads FROM {TOUCHED} t LEFT JOIN {{sources}} s ON s.id = t.source_id GROUP BY t.entity_id) g ON g.entity_id = r.id""",
)

gov_withheld_by_source = define(
    "gov_withheld_by_source", "How many records each source that is not approved withholds; sources that no registry knows are listed by their id.",
    f"SELECT t.source_id, coalesce(s.disposition, 'unknown') AS disposition, count(*) AS records FROM {TOUCHED} t LEFT JOIN {{sources}} s ON s.id = t.source_id WHERE coalesce(s.disposition, 'unknown') <> 'approved' GROUP BY t.source_id, coalesce(s.disposition, 'unknown')",
)

gov_sensitivity = define(
    "gov_sensitivity", "Outcomes by action, failing closed: a record to be coarsened is withheld if its public position is missing, invalid or the exact one, and one with an unknown action always.",
    """SELECT action, outcome, count(*) AS n FROM (
        SELECT coalesce(action, 'none') AS action, CASE WHEN action = 'publish' THEN 'published' WHEN action = 'exclude' THEN 'withheld: excluded' WHEN action = 'redact' THEN 'withheld: redacted' WHEN coalesce(action, '') <> 'coarsen' THEN 'withheld: policy invalid'
            WHEN public_lon IS NULL OR public_lat IS NULL THEN 'withheld: no public position' WHEN abs(public_lon) > 180 OR abs(public_lat) > 90 THEN 'withheld: public position invalid' WHEN public_lon = lon AND public_lat = lat THEN 'withheld: public position exact' ELSE 'coarsened' END AS outcome FROM {records}
    ) o GROUP BY action, outcome""",
)

proj_coarsen = define(
    "proj_coarsen", "Coarsened records: the public position, geometry confidence of 0.2 at most, the flag added to those there are, private fields gone, and assertions about geometry, legacy fields or the public position without their values.",
    """SELECT r.id, r.public_lon AS lon, r.public_lat AS lat, least(coalesce(r.confidence, 2e-1), 2e-1) AS geometry_confidence, GLUE(SORTED(CASE WHEN r.flag IS NULL THEN ARR('coarsened_for_sensitivity') ELSE ARR(r.flag, 'coarsened_for_sensitivity') END), ',') AS flags, coalesce(a.assertions, 0) AS assertions, coalesce(a.blanked, 0) AS blanked FROM {records} r
        LEFT JOIN (SELECT entity_id, count(*) AS assertions, count_if(field = '/geometry' OR field LIKE '/geometry/%' OR field = '/legacy' OR field LIKE '/legacy/%' OR field LIKE '/sensitivity/publicGeometry%') AS blanked FROM {evidence} GROUP BY entity_id) a ON a.entity_id = r.id
        WHERE r.action = 'coarsen' AND r.public_lon IS NOT NULL AND abs(r.public_lon) <= 180 AND abs(r.public_lat) <= 90 AND NOT (r.public_lon = r.lon AND r.public_lat = r.lat)""",
)

val_build_budgets = define(
    "val_build_budgets", "Bytes of the manifest, the spatial index, the largest package, and the initial load, against their budgets.",
    """SELECT name, bytes, budget, bytes <= budget AS fits FROM (
        SELECT 'manifest' AS name, CAST(sum(400 + length(jurisdiction)) AS BIGINT) AS bytes, CAST(64000 AS BIGINT) AS budget FROM {shards}
        UNION ALL SELECT 'spatial index', CAST(count(*) * 220 AS BIGINT), CAST(2000000 AS BIGINT) FROM (SELECT DISTINCT nation, shard FROM {shards}) c
        UNION ALL SELECT 'largest package', max(bytes), CAST(2500000 AS BIGINT) FROM {shards}
        UNION ALL SELECT 'initial load', CAST(sum(400 + length(jurisdiction)) + count(*) * 220 + 8000000 AS BIGINT), CAST(10064000 AS BIGINT) FROM {shards}
    ) b""",
)

val_shard_identity = define(
    "val_shard_identity", "Regions whose shards are not 0 to n-1 of one declared count, or whose bytes, hashes or copies disagree with what was delivered.",
    """SELECT nation, rule FROM (
        SELECT nation, 'count declared differently' AS rule FROM {shards} GROUP BY nation HAVING count(DISTINCT declared) > 1
        UNION ALL SELECT nation, 'shards incomplete' FROM {shards} GROUP BY nation HAVING min(shard) <> 0 OR count(DISTINCT shard) <> max(shard) + 1 OR max(declared) <> count(DISTINCT shard)
        UNION ALL SELECT DISTINCT s.nation, 'bytes differ' FROM {shards} s JOIN {delivered} d ON d.nation = s.nation AND d.shard = s.shard WHERE d.bytes <> s.bytes
        UNION ALL SELECT DISTINCT s.nation, 'hash differs' FROM {shards} s JOIN {delivered} d ON d.nation = s.nation AND d.shard = s.shard WHERE d.hash <> s.hash
        UNION ALL SELECT DISTINCT s.nation, 'not delivered' FROM {shards} s WHERE NOT EXISTS (SELECT 1 FROM {delivered} d WHERE d.nation = s.nation AND d.shard = s.shard)
        UNION ALL SELECT nation, 'copies conflict' FROM (SELECT nation, shard FROM {shards} GROUP BY nation, shard HAVING count(DISTINCT hash) > 1) c GROUP BY nation
    ) v""",
)

sink_manifest = define(
    "sink_manifest", "One row for each package as written: bounds, jurisdictions, counts by type, complete routes, sources, bytes and hash.",
    """SELECT m.nation, m.shard, count(*) AS n, min(e.wlon) AS west, max(e.wlon) AS east, min(e.wlat) AS south, max(e.wlat) AS north, SORTED(array_agg(DISTINCT e.mode)) AS modes, count_if(e.entity_type = 'TrailRoute') AS routes, count_if(e.entity_type = 'Place') AS places, count_if(e.entity_type = 'AccessPoint') AS access_points,
        count_if(e.entity_type = 'TrailRoute' AND e.verification = 'verified' AND e.flag IS NULL) AS complete_routes, max(s.sources) AS sources, max(d.bytes) AS bytes, max(d.hash) AS hash
      FROM {members} m JOIN {entities} e ON e.id = m.id JOIN {delivered} d ON d.nation = m.nation AND d.shard = m.shard LEFT JOIN (SELECT m.nation, m.shard, count(DISTINCT a.source_id) AS sources FROM {members} m JOIN {assertions} a ON a.entity_id = m.id GROUP BY m.nation, m.shard) s ON s.nation = m.nation AND s.shard = m.shard GROUP BY m.nation, m.shard""",
)

val_graph_invariants = define(
    "val_graph_invariants", "Passes that lack one of their six edges, whose out-and-back is not dearer and longer than the traverse, or whose edges have unknown ends or no finite cost.",
    """SELECT pass_id, rule FROM (
        SELECT p.id AS pass_id, 'edges missing' AS rule FROM {passes} p LEFT JOIN {pass_edges} e ON e.pass_id = p.id GROUP BY p.id HAVING count(DISTINCT e.side || e.kind) <> 6
        UNION ALL SELECT o.pass_id, 'out-and-back not dearer' FROM (SELECT pass_id, min(cost) AS cost FROM {pass_edges} WHERE kind = 'out-and-back' GROUP BY pass_id) o JOIN (SELECT pass_id, sum(cost) / 2 AS cost FROM {pass_edges} WHERE kind <> 'out-and-back' GROUP BY pass_id) t ON t.pass_id = o.pass_id WHERE NOT o.cost > t.cost
        UNION ALL SELECT o.pass_id, 'out-and-back not longer' FROM (SELECT pass_id, min(distance_m) AS d FROM {pass_edges} WHERE kind = 'out-and-back' GROUP BY pass_id) o JOIN (SELECT pass_id, sum(distance_m) / 2 AS d FROM {pass_edges} WHERE kind <> 'out-and-back' GROUP BY pass_id) t ON t.pass_id = o.pass_id WHERE NOT o.d > t.d
        UNION ALL SELECT DISTINCT e.pass_id, 'end unknown' FROM {pass_edges} e WHERE NOT EXISTS (SELECT 1 FROM {road_nodes} n WHERE n.id = e.a) OR NOT EXISTS (SELECT 1 FROM {road_nodes} n WHERE n.id = e.b)
        UNION ALL SELECT DISTINCT pass_id, 'cost not finite' FROM {pass_edges} WHERE cost IS NULL OR isnan(cost) OR NOT cost > 0
    ) v""",
)

val_graph_nodes_edges = define(
    "val_graph_nodes_edges", "Faults of a graph document: ids missing or repeated, bad coordinates, unknown kinds, passes without both bases, self-loops, repeated keys, ends that no node has, and declared counts that differ.",
    f"""SELECT rule, subject, count(*) AS n FROM (
        SELECT 'id missing' AS rule, 'node' AS subject FROM {{raw_nodes}} WHERE id IS NULL
        UNION ALL SELECT 'id repeated', CAST(id AS STRING) FROM (SELECT id FROM {{raw_nodes}} WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1) d
        UNION ALL SELECT 'coordinate', CAST(id AS STRING) FROM {{raw_nodes}} WHERE {OUTSIDE}
        UNION ALL SELECT 'kind', kind FROM {{raw_nodes}} WHERE kind NOT IN ('pass', 'pass-base', 'pass-summit', 'poi', 'junction')
        UNION ALL SELECT 'base missing', CAST(p.id AS STRING) FROM {{raw_nodes}} p LEFT JOIN {{raw_nodes}} b ON b.kind = 'pass-base' AND floor(b.id / 3) = floor(p.id / 3) WHERE p.kind = 'pass' GROUP BY p.id HAVING count(DISTINCT b.id) < 2
        UNION ALL SELECT 'self-loop', CAST(a AS STRING) FROM {{raw_edges}} WHERE a = b
        UNION ALL SELECT 'key repeated', CAST(a AS STRING) || '->' || CAST(b AS STRING) FROM (SELECT a, b FROM {{raw_edges}} GROUP BY a, b HAVING count(*) > 1) d
        UNION ALL SELECT 'end unknown', CAST(e.b AS STRING) FROM {{raw_edges}} e WHERE NOT EXISTS (SELECT 1 FROM {{raw_nodes}} n WHERE n.id = e.b)
        UNION ALL SELECT 'node count', CAST(s.nodes AS STRING) FROM {{declared_stats}} s JOIN (SELECT count(*) AS n FROM {{raw_nodes}}) c ON c.n <> s.nodes
        UNION ALL SELECT 'edge count', CAST(s.edges AS STRING) FROM {{declared_stats}} s JOIN (SELECT count(*) AS n FROM {{raw_edges}}) c ON c.n <> s.edges
    ) v GROUP BY rule, subject""",
)

plan_route_available = define(
    "plan_route_available", "Whether each route can be planned at its time: closed, restricted or unsafe by the conditions that are active then, in that order.",
    """SELECT r.id, CASE WHEN bool_or(coalesce(c.state = 'closed' OR c.kind IN ('road_closure', 'trail_closure', 'seasonal_gate'), FALSE)) THEN 'closed' WHEN bool_or(coalesce(c.state IN ('forbidden', 'private'), FALSE)) THEN 'restricted'
          WHEN bool_or(coalesce(c.unsafe OR (c.blocking AND c.severity IN ('high', 'extreme')) OR (c.blocking AND c.kind IN ('fire', 'avalanche', 'flood', 'volcanic', 'emergency')), FALSE)) THEN 'unsafe' ELSE 'available' END AS availability
        FROM {trails} r LEFT JOIN {conditions} c ON c.entity_id = r.id AND c.active AND c.state <> 'expired' AND (c.valid_from IS NULL OR EPOCH_DAY(c.valid_from) <= r.planned_day) AND (c.valid_until IS NULL OR EPOCH_DAY(c.valid_until) >= r.planned_day) GROUP BY r.id""",
)

#: A record's own window first, then that of all its assertions, then what allows it to be current.
safety_temporal_status = define(
    "safety_temporal_status", "expired, scheduled, current or unknown of each safety record at its time, by its own window and state, its assertions' windows, verification, and readings within 72 hours and five minutes ahead.",
    """SELECT id, CASE WHEN own_until < now_s OR state = 'expired' OR verification = 'expired' OR freshness = 'expired' THEN 'expired' WHEN own_from > now_s OR state = 'scheduled' THEN 'scheduled'
          WHEN n > 0 AND bounded = n AND ended = n THEN 'expired' WHEN n > 0 AND bounded = n AND ahead = n THEN 'scheduled'
          WHEN (state = 'live' OR (state = 'seasonal' AND (own_from IS NOT NULL OR own_until IS NOT NULL OR running > 0))) AND verification IN ('verified', 'partially_verified') AND freshness = 'current' AND oldest >= now_s - 259200 AND newest <= now_s + 300 AND (bounded = 0 OR running > 0) THEN 'current' ELSE 'unknown' END AS temporal FROM (
        SELECT s.id, s.state, s.verification, s.freshness, s.own_from, s.own_until, s.now_s, count(a.source_id) AS n, count_if(a.from_s IS NOT NULL OR a.until_s IS NOT NULL) AS bounded, count_if(a.until_s < s.now_s) AS ended, count_if(a.from_s > s.now_s) AS ahead, count_if((a.from_s IS NOT NULL OR a.until_s IS NOT NULL) AND coalesce(a.from_s, s.now_s) <= s.now_s AND coalesce(a.until_s, s.now_s) >= s.now_s) AS running,
            least(min(s.checked_s), coalesce(min(a.observed_s), min(s.checked_s))) AS oldest, greatest(max(s.checked_s), coalesce(max(a.observed_s), max(s.checked_s))) AS newest
        FROM {safety} s LEFT JOIN {safety_windows} a ON a.record_id = s.id GROUP BY s.id, s.state, s.verification, s.freshness, s.own_from, s.own_until, s.now_s) w""",
)

src_inventory_counts = define(
    "src_inventory_counts", "Records of each input with how many keys the price cache holds, and cached keys that no input has.",
    """SELECT input, count(*) AS n, count_if(c.name IS NOT NULL) AS matched, count_if(c.name IS NULL) AS unmatched FROM {inventory} i LEFT JOIN {price_cache} c ON c.name = i.name GROUP BY input
       UNION ALL SELECT 'cache without input', count(*), CAST(0 AS BIGINT), count(*) FROM {price_cache} c WHERE NOT EXISTS (SELECT 1 FROM {inventory} i WHERE i.name = c.name)""",
)

join_viewport_entities = define(
    "join_viewport_entities", "Entities of the cells of a viewport, copies merged across cells; ids whose copies differ are marked.",
    "SELECT c.entity_id AS id, count(*) AS copies, count(DISTINCT c.hash) AS versions, count(DISTINCT c.hash) > 1 AS conflicting FROM {cell_copies} c JOIN {viewport} v ON v.x = c.x AND v.y = c.y GROUP BY c.entity_id",
)
