"""Validation, rights and sensitivity rules, and the reports over them."""

from waymark.functions.sql import haversine
from waymark.operators import define

val_export_notices = define(
    "val_export_notices", "Notices against assertions by (entity, source): missing, unexpected or duplicate.",
    """SELECT coalesce(a.entity_id, n.entity_id) AS entity_id, coalesce(a.source_id, n.source_id) AS source_id,
        CASE WHEN n.source_id IS NULL THEN 'missing' WHEN a.source_id IS NULL THEN 'unexpected' ELSE 'duplicate' END AS verdict
      FROM (SELECT DISTINCT entity_id, source_id FROM {assertions} WHERE status = 'verified') a
      FULL OUTER JOIN (SELECT entity_id, source_id, count(*) AS n FROM {assertions} WHERE line_status = 'F' GROUP BY entity_id, source_id) n
        ON a.entity_id = n.entity_id AND a.source_id = n.source_id
      WHERE a.source_id IS NULL OR n.source_id IS NULL OR n.n > 1""",
)

val_unknown_refs = define(
    "val_unknown_refs", "Source ids of assertions and jurisdiction ids of entities that no registry knows.",
    """SELECT entity_id, 'source' AS kind, source_id AS ref FROM (SELECT DISTINCT entity_id, source_id FROM {assertions}) a WHERE NOT EXISTS (SELECT 1 FROM {sources} s WHERE s.id = a.source_id)
       UNION ALL SELECT id, 'jurisdiction', CAST(nation AS BIGINT) FROM {entities} e WHERE NOT EXISTS (SELECT 1 FROM {jurisdictions} j WHERE j.id = e.nation AND j.in_scope)""",
)

gov_record_rules = define(
    "gov_record_rules", "Paid, blocked, use-not-approved and unknown-source violations, distinct per record.",
    """SELECT DISTINCT entity_id, rule FROM (
        SELECT a.entity_id, CASE WHEN s.id IS NULL THEN 'source not registered' WHEN s.disposition = 'blocked' THEN 'source blocked' WHEN s.cost = 'paid' THEN 'paid source' WHEN NOT s.display_allowed THEN 'use not approved' END AS rule
        FROM {assertions} a LEFT JOIN {sources} s ON s.id = a.source_id
    ) r WHERE rule IS NOT NULL""",
)

flt_flags = define("flt_planning_flags", "Entities whose flags block planning.", "SELECT id, flag FROM {entities} WHERE flag LIKE 'critical%' OR flag = 'technical_route'")

plan_access_safe = define("plan_access_safe", "Access points usable for a mode.", "SELECT id, mode FROM {entities} WHERE entity_type = 'AccessPoint' AND legal IN ('legal', 'restricted') AND verification <> 'unverified' AND (flag IS NULL OR flag <> 'critical_access_unknown') AND action = 'publish'")

export_gate = define(
    "export_gate", "The first code why a route may not be exported; null if it may.",
    """SELECT e.id, CASE WHEN e.legal = 'private' THEN 'access_private' WHEN e.action <> 'publish' THEN 'geometry_withheld' WHEN coalesce(p.n, 0) = 0 THEN 'no_provenance' WHEN p.newest < EPOCH_DAY(e.observed) - 365 THEN 'provenance_stale' WHEN e.confidence < 3e-1 THEN 'confidence_low' END AS code
      FROM {entities} e LEFT JOIN (SELECT entity_id, count_if(status = 'verified') AS n, max(EPOCH_DAY(observed)) AS newest FROM {assertions} GROUP BY entity_id) p ON p.entity_id = e.id WHERE e.entity_type = 'TrailRoute'""",
)

agg_quality_report = define(
    "agg_quality_report", "Completeness and flag counts in one pass.",
    """SELECT count(*) AS n, count_if(confidence >= 6e-1) AS n_good, count_if(evidence IS NULL) AS n_no_evidence, count_if(legal = 'unknown') AS n_access_unknown, count_if(flag IS NOT NULL) AS n_flagged, CAST(floor(avg(confidence) * 1e3 + 5e-1) AS BIGINT) AS confidence_permille FROM {entities}""",
)

agg_counts = define(
    "agg_counts", "Keyed counts of flags, types, access and verification.",
    """SELECT kind, value, count(*) AS n FROM (SELECT 'flag' AS kind, flag AS value FROM {entities} WHERE flag IS NOT NULL UNION ALL SELECT 'type', entity_type FROM {entities} UNION ALL SELECT 'legal', legal FROM {entities} UNION ALL SELECT 'verification', verification FROM {entities}) k GROUP BY kind, value""",
)

agg_coverage_report = define(
    "agg_coverage_report", "Records, routes and complete routes by jurisdiction, zeros kept.",
    """SELECT j.id, j.name, count(e.id) AS records, count_if(e.entity_type = 'TrailRoute') AS routes, count_if(e.entity_type = 'TrailRoute' AND e.verification = 'verified' AND e.flag IS NULL) AS complete
      FROM {jurisdictions} j LEFT JOIN {entities} e ON e.nation = j.id AND e.legal <> 'private' GROUP BY j.id, j.name""",
)

agg_release_notice = define("agg_release_notice", "Distinct records and assertions by source.", "SELECT s.id, s.name, count(DISTINCT a.entity_id) AS records, count(*) AS assertions FROM {sources} s JOIN {assertions} a ON a.source_id = s.id WHERE s.disposition = 'approved' GROUP BY s.id, s.name")

agg_bounds = define("agg_bounds", "Bounding boxes by nation.", "SELECT nation, min(wlon) AS west, max(wlon) AS east, min(wlat) AS south, max(wlat) AS north FROM {entities} GROUP BY nation")

agg_dedupe_stable_id = define(
    "agg_dedupe_stable_id", "Equal records collapse by id; ids with conflicting content are marked.",
    "SELECT tour_id, place_id, count(*) AS copies, count(DISTINCT CAST(duration_s AS BIGINT)) > 1 AS conflicting FROM {stops} GROUP BY tour_id, place_id",
)

proj_map_features = define(
    "proj_map_features", "Routes and points by rank, at most 100 of each nation and class, with how many were cut.",
    """SELECT id, nation, class, rank, total FROM (
        SELECT id, nation, class, CAST(row_number() OVER (PARTITION BY nation, class ORDER BY confidence DESC, id) AS BIGINT) AS rank, count(*) OVER (PARTITION BY nation, class) AS total
        FROM (SELECT id, nation, confidence, CASE WHEN entity_type = 'TrailRoute' THEN 'route' ELSE 'point' END AS class FROM {entities}) c
    ) r WHERE rank <= 100""",
)

sink_redirects = define("sink_redirects", "Old id to canonical id, only where the target is delivered.", "SELECT r.id AS old_id, r.ref_back AS target FROM {entities} r WHERE r.action = 'redact' AND EXISTS (SELECT 1 FROM {entities} d WHERE d.id = r.ref_back AND d.action = 'publish')")

set_union_except = define(
    "set_union_except", "Union of two adapters, minus superseded ids, the better record of each id.",
    """SELECT id, origin, confidence FROM (
        SELECT id, origin, confidence, row_number() OVER (PARTITION BY id ORDER BY confidence DESC, origin) AS r FROM (
          SELECT id, 'registry' AS origin, confidence FROM {entities} UNION ALL SELECT entity_id, 'feed', max(confidence) FROM {assertions} WHERE status = 'verified' GROUP BY entity_id
        ) u WHERE NOT EXISTS (SELECT 1 FROM {sources} s WHERE s.id = u.id AND s.disposition = 'blocked')
    ) k WHERE r = 1""",
)
