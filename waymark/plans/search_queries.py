"""Queries of search and discovery, and plain SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions.sql import haversine_atan2
from waymark.operators import discovery, search
from waymark.operators.search import Wish

WISH = Wish(activities=("hiking", "walking"), season="summer", modes=("train", "foot"))


def _assessed(weights: str) -> str:
    """The assessment for WISH written out."""
    return f"""(SELECT *, floor(total * (CASE WHEN legal = 'unknown' THEN 72e-2 ELSE 1 END) * (CASE WHEN flag = 'critical_condition_unknown' THEN 62e-2 ELSE 1 END) * 1e3 + 5e-1) / 1e3 AS score,
        action NOT IN ('exclude', 'redact') AND legal <> 'private' AND coalesce(flag, '') <> 'technical_route' AS eligible,
        CASE WHEN lane = 'quieter_lead' THEN 'quieter_lead' WHEN lane = 'iconic' OR list_contains(themes, 'iconic') THEN 'iconic' WHEN lane = 'quieter_verified' OR list_contains(themes, 'hidden-gem') THEN CASE WHEN verification <> 'unverified' AND ev >= 6e-1 AND fit >= 45e-2 AND action = 'publish' AND legal NOT IN ('private', 'unknown') AND coalesce(flag, '') NOT LIKE 'critical%' THEN 'quieter_verified' ELSE 'quieter_lead' END ELSE 'general' END AS chosen
      FROM (SELECT *, {weights} AS total FROM (SELECT *, coalesce(evidence, confidence) AS ev, CASE WHEN legal = 'private' THEN 0 WHEN legal = 'unknown' THEN share * 45e-2 ELSE share END AS fit FROM (
        SELECT *, len(list_intersect(modes, ['train', 'foot'])) / 2 AS share, len(list_intersect(activities, ['hiking', 'walking'])) / 2 AS route, CASE WHEN seasons IS NULL THEN 35e-2 WHEN list_contains(seasons, 'summer') THEN 1 ELSE 0 END AS in_season FROM {{finds}}) a) b) c)"""


USUAL = "(distinctiveness * 22e-2 + uniqueness * 14e-2 + ev * 2e-1 + (1 - prominence) * 1e-1 + route * 12e-2 + in_season * 8e-2 + fit * 1e-1 + variety * 4e-2)"
OWN = "((distinctiveness * 22e-2 + uniqueness * 14e-2 + ev * 2e-1 + (1 - prominence) * 1e-1 + route * 12e-2 + in_season * 8e-2 + fit * 1e-1 + variety * 5e-1) / 146e-2)"
RELEVANT = """CASE WHEN query = '' THEN 1e0 WHEN name = query THEN 1e0 WHEN starts_with(name, query) THEN 94e-2 WHEN contains(text, query) THEN 82e-2
    ELSE len(list_filter(string_split(query, ' '), lambda x: contains(text, x))) / len(string_split(query, ' ')) * 62e-2 + len(list_intersect(qt, dt)) / (len(qt) + len(dt) - len(list_intersect(qt, dt))) * 38e-2 END"""
GRAMS = "list_distinct(list_transform(generate_series(1, length({0}) + 2), lambda i: substr('  ' || {0} || '  ', i, 3)))"
SEARCH = f"""WITH d AS (SELECT *, {GRAMS.format('text')} AS dt FROM {{search_documents}}), q AS (SELECT query_id, query, lat AS qlat, lon AS qlon, within_m, activity AS wanted, {GRAMS.format('query')} AS qt FROM {{search_queries}}),
    s AS (SELECT query_id, id, title, floor(({RELEVANT}) * 1e6 + 5e-1) / 1e6 AS relevance, CAST(floor({haversine_atan2("qlat", "qlon", "lat", "lon")} + 5e-1) AS BIGINT) AS distance_m, within_m FROM d JOIN q ON wanted IS NULL OR wanted = activity)
  SELECT query_id, rank, id, relevance, distance_m FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, distance_m, title, id) AS rank FROM s WHERE relevance >= 16e-2 AND (within_m IS NULL OR distance_m <= within_m)) r WHERE rank <= 200"""


def discovered(t):
    found = search.search(t.search_documents, t.search_queries.where("query_id = 0").withColumns({"within_m": F.lit(None).cast("double"), "activity": F.lit(None).cast("string")}), most=None)
    return search.discover(t.finds, found, WISH, interest="lake", minutes=400.0).select("id", "blended", "score", "relevance")


BUILT = {
    "top_search": (lambda t: search.search(t.search_documents, t.search_queries), SEARCH),
    "top_discovery": (
        lambda t: search.ranked(search.assess(t.finds, Wish(WISH.activities, WISH.season, WISH.modes, {"itinerary_variety": 0.5})), 1000).select("id", "lane", "score"),
        f"SELECT id, chosen AS lane, score FROM {_assessed(OWN)} a WHERE eligible ORDER BY score DESC, confidence DESC, name, id LIMIT 1000",
    ),
    "discovery_reasons": (
        lambda t: search.assess(t.finds, WISH).where("eligible").select("id", "lane", "score", F.posexplode_outer("reasons").alias("at", "dimension")).select("id", "lane", "score", F.coalesce(F.col("at") + 1, F.lit(0)).alias("place"), "dimension"),
        f"""WITH a AS (SELECT * FROM {_assessed(USUAL)} x WHERE eligible), d AS (SELECT id, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS i, unnest([distinctiveness, uniqueness, ev, 1 - prominence, route, in_season, fit, variety]) AS v, unnest(['distinctiveness', 'regional_uniqueness', 'evidence_quality', 'lower_prominence', 'route_compatibility', 'season_suitability', 'access_fit', 'itinerary_variety']) AS k FROM a),
          r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, i) AS r FROM d WHERE v >= CASE k WHEN 'lower_prominence' THEN 72e-2 ELSE 7e-1 END) SELECT a.id, a.chosen AS lane, a.score, CAST(coalesce(r.r, 0) AS INT) AS place, r.k AS dimension FROM a LEFT JOIN r ON r.id = a.id AND r.r <= 3""",
    ),
    "top_discover": (
        discovered,
        f"""WITH d AS (SELECT *, {GRAMS.format('text')} AS dt FROM {{search_documents}}), q AS (SELECT query, {GRAMS.format('query')} AS qt FROM {{search_queries}} WHERE query_id = 0), s AS (SELECT id, floor(({RELEVANT}) * 1e6 + 5e-1) / 1e6 AS relevance FROM d CROSS JOIN q)
          SELECT a.id, floor((a.score * 82e-2 + s.relevance * 18e-2) * 1e3 + 5e-1) / 1e3 AS blended, a.score, s.relevance FROM {_assessed(USUAL)} a JOIN s ON s.id = a.id AND s.relevance >= 16e-2 WHERE eligible AND entity_type <> 'AccessPoint' AND (activity IN ('hiking', 'walking') OR a.id % 2 = 0) AND list_contains(themes, 'lakes') AND (minutes IS NULL OR minutes <= 400) ORDER BY 2 DESC, title, a.id LIMIT 36""",
    ),
    "top_tour_candidates": (
        lambda t: discovery.top_tour_candidates(starts=t.starts, reach=_reach(t), passes=t.passes),
        None,
    ),
}


def _reach(t):
    from waymark.operators.graph import shortest_paths

    return shortest_paths(t.edges, t.starts.select(F.col("node").alias("source")).distinct()).select("source", "node", "cost")
