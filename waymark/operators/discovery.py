"""Search, evidence-aware ranking, intent and list orders."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.ranges import running
from waymark.functions.sql import clamp, haversine_atan2, js_round
from waymark.operators import define

STATUS_RANK, QUALITY_CELL = "CASE WHEN closes IS NULL THEN 2 ELSE 0 END", "CAST(floor(quality * 50) AS BIGINT)"
ACCESS_FIT = "CASE WHEN legal = 'legal' THEN 9e-1 WHEN legal = 'restricted' THEN 58e-2 ELSE 3e-1 END"

ASSESS = f"""SELECT *, {js_round("total * (CASE WHEN legal = 'unknown' THEN 72e-2 ELSE 1e0 END) * (CASE WHEN coalesce(flag, '') = 'critical_condition_unknown' THEN 62e-2 ELSE 1e0 END)", 1000)} AS score,
        CASE WHEN lane = 'quieter_lead' THEN 'quieter_lead' WHEN lane = 'iconic' THEN 'iconic'
             WHEN lane = 'quieter_verified' THEN CASE WHEN verification IN ('verified', 'partially_verified') AND ev >= 6e-1 AND fit >= 45e-2 AND action = 'publish' AND legal NOT IN ('private', 'unknown') AND coalesce(flag, '') NOT LIKE 'critical%' THEN 'quieter_verified' ELSE 'quieter_lead' END
             ELSE 'general' END AS chosen_lane,
        action NOT IN ('exclude', 'redact') AND legal <> 'private' AND coalesce(flag, '') <> 'technical_route' AS eligible
      FROM (SELECT *, (distinctiveness * 22e-2 + uniqueness * 14e-2 + ev * 2e-1 + (1e0 - prominence) * 1e-1 + 65e-2 * 12e-2 + season_fit * 8e-2 + fit * 1e-1 + 5e-1 * 4e-2) / 1e0 AS total
            FROM (SELECT *, coalesce(evidence, confidence) AS ev, {ACCESS_FIT} AS fit, CASE WHEN season IS NULL THEN 35e-2 WHEN season = 'summer' THEN 1e0 ELSE 0e0 END AS season_fit FROM {{entities}}) d) t"""

LANED = f"(SELECT nation, id, chosen_lane AS lane, score, confidence, CASE WHEN chosen_lane = 'quieter_verified' AND score >= 55e-2 THEN 1 ELSE 0 END AS kind, CAST(floor(score * 200) AS BIGINT) AS cell FROM ({ASSESS}) a WHERE eligible)"
win_interleave_lanes = define(
    "win_interleave_lanes", "One quieter item after every three ordinary ones within a nation, a quarter of all at most, the rest after them. Ranks count rows by score first; places follow from ranks.",
    f"""SELECT nation, id, lane, CAST(CASE WHEN kind = 0 THEN r + least(floor((r - 1) / 3), put) WHEN r <= put THEN r * 4 ELSE ordinary + r END AS BIGINT) AS position FROM (
        SELECT l.nation, l.id, l.lane, l.kind, b.before + row_number() OVER (PARTITION BY l.nation, l.kind, l.cell ORDER BY l.score DESC, l.confidence DESC, l.id) AS r, n.ordinary, least(n.quieter, greatest(1, floor((n.ordinary + n.quieter) / 4)), floor(n.ordinary / 3)) AS put FROM {LANED} l
          JOIN (SELECT nation, kind, cell, sum(count(*)) OVER (PARTITION BY nation, kind ORDER BY cell DESC) - count(*) AS before FROM {LANED} c GROUP BY nation, kind, cell) b ON b.nation = l.nation AND b.kind = l.kind AND b.cell = l.cell
          JOIN (SELECT nation, count_if(kind = 0) AS ordinary, count_if(kind = 1) AS quieter FROM {LANED} c GROUP BY nation) n ON n.nation = l.nation) p""",
)

top_map_entities = define(
    "top_map_entities", "Evidence order with stable ties, one row for each host.",
    """SELECT host, id, verification FROM (SELECT host, id, verification, row_number() OVER (PARTITION BY host ORDER BY CASE verification WHEN 'verified' THEN 0 WHEN 'partially_verified' THEN 1 ELSE 2 END, confidence DESC, id) AS r FROM {entities}) m WHERE r = 1""",
)

proj_tags = define(
    "proj_tags", "Expanded, distinct tags of each place.",
    """SELECT DISTINCT id, tag FROM (SELECT id, lower(category) AS tag FROM {places} UNION ALL SELECT id, lower(theme) FROM {places} UNION ALL SELECT id, x.t FROM {places} p JOIN (SELECT 'food' AS family, 'indulgence' AS t UNION ALL SELECT 'food', 'rest' UNION ALL SELECT 'museum', 'heritage' UNION ALL SELECT 'nature', 'outdoors') x ON x.family = p.family) k""",
)

WEIGHTS = "(SELECT 'BUILDING' AS persona, 'food' AS tag, 6e-1 AS w UNION ALL SELECT 'BUILDING', 'museum', 9e-1 UNION ALL SELECT 'MACHINERY', 'nature', 8e-1 UNION ALL SELECT 'HOUSEHOLD', 'food', 1e0 UNION ALL SELECT 'HOUSEHOLD', 'nature', 4e-1 UNION ALL SELECT 'AUTOMOBILE', 'museum', 3e-1 UNION ALL SELECT 'FURNITURE', 'nature', 5e-1)"

top_intent_score = define(
    "top_intent_score", "For each customer the five places whose family weight times value, less dismissals, is highest.",
    f"""SELECT user_id, id, value, CAST(r AS BIGINT) AS rank FROM (SELECT user_id, id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, id) AS r FROM (
        SELECT u.user_id, l.place_id AS id, {js_round("w.w * max(p.score) - 2e-1 * (count(*) - 1)", 1000000)} AS value FROM {{users}} u JOIN {WEIGHTS} w ON w.persona = u.persona JOIN {{orders}} o ON o.o_custkey = u.user_id JOIN {{stops}} l ON l.tour_id = o.o_orderkey JOIN {{places}} p ON p.id = l.place_id AND p.family = w.tag GROUP BY u.user_id, l.place_id, w.w) v) k WHERE r <= 5""",
)

win_serendipity = define(
    "win_serendipity", "For each customer one visited place outside the family that fits best, of the highest score.",
    f"""SELECT user_id, id, score FROM (SELECT u.user_id, p.id, p.score, row_number() OVER (PARTITION BY u.user_id ORDER BY p.score DESC, p.id) AS r FROM {{users}} u JOIN {{orders}} o ON o.o_custkey = u.user_id JOIN {{stops}} l ON l.tour_id = o.o_orderkey JOIN {{places}} p ON p.id = l.place_id
        WHERE NOT EXISTS (SELECT 1 FROM {WEIGHTS} w WHERE w.persona = u.persona AND w.tag = p.family)) k WHERE r = 1""",
)

set_overlap = define(
    "set_overlap", "Families that a customer's tours share with the persona's: overlap and Jaccard.",
    f"""SELECT v.user_id, count_if(w.tag IS NOT NULL) AS overlap, {js_round("count_if(w.tag IS NOT NULL) / (count(*) + max(v.n_tags) - count_if(w.tag IS NOT NULL))", 1000000)} AS jaccard FROM (
        SELECT DISTINCT u.user_id, u.persona, p.family, t.n_tags FROM {{users}} u JOIN {{orders}} o ON o.o_custkey = u.user_id JOIN {{stops}} l ON l.tour_id = o.o_orderkey JOIN {{places}} p ON p.id = l.place_id JOIN (SELECT persona, count(*) AS n_tags FROM {WEIGHTS} x GROUP BY persona) t ON t.persona = u.persona) v
      LEFT JOIN {WEIGHTS} w ON w.persona = v.persona AND w.tag = v.family GROUP BY v.user_id""",
)

flt_poi_layer = define("flt_poi_layer", "Sights of a family, above the larger of slider and preset threshold, in a price range.", "SELECT id, category, score FROM {places} WHERE family IN ('food', 'nature') AND score >= greatest(4, 5) AND price BETWEEN 900 AND 1500 AND theme <> 'Brand#1'")

flt_preset_union = define("flt_preset_union", "Union of active presets by category: themes, lowest score, largest count.", "SELECT category, SORTED(array_agg(DISTINCT theme)) AS themes, min(score) AS min_score, max(size) AS max_size FROM {places} WHERE size % 2 = 0 GROUP BY category")

agg_theme_coverage = define(
    "agg_theme_coverage", "Share of the requested families that a tour covers, and distinct families of five.",
    """SELECT s.tour_id, count(DISTINCT CASE WHEN p.family IN ('food', 'museum') THEN p.family END) / 2e0 AS requested, count(DISTINCT p.family) / 5e0 AS variety FROM {stops} s JOIN {places} p ON p.id = s.place_id GROUP BY s.tour_id""",
)

agg_category_entropy = define(
    "agg_category_entropy", "Normalised Shannon entropy of each tour's families.",
    f"""SELECT tour_id, CASE WHEN count(*) = 1 THEN 0e0 ELSE {js_round("-sum(n / t * ln(n / t)) / ln(count(*))", 1000000)} END AS entropy FROM (SELECT tour_id, family, CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY tour_id) AS DOUBLE) AS t FROM (SELECT s.tour_id, p.family, count(*) AS n FROM {{stops}} s JOIN {{places}} p ON p.id = s.place_id GROUP BY s.tour_id, p.family) c) d GROUP BY tour_id""",
)

agg_photo_sample = define(
    "agg_photo_sample", "Every tenth place of a category in name order, so a sample spans the list; counted by the name's first letters, then ranked within them.",
    "SELECT p.category, p.id FROM (SELECT category, id, substr(name, 1, 3) AS cell, row_number() OVER (PARTITION BY category, substr(name, 1, 3) ORDER BY name, id) AS r FROM {places}) p JOIN (SELECT category, substr(name, 1, 3) AS cell, sum(count(*)) OVER (PARTITION BY category ORDER BY substr(name, 1, 3)) - count(*) AS before FROM {places} GROUP BY category, substr(name, 1, 3)) b ON b.category = p.category AND b.cell = p.cell WHERE (b.before + p.r) % 10 = 1",
)



def rank_poi_ids(places: DataFrame) -> DataFrame:
    """places(id, name, score) with their ordinal by falling score, then name, over all; ties by id."""
    ranked = running(places.select("id", "name", "score"), [], [F.desc("score"), "name", "id"], before=F.lit(1))
    return ranked.select("id", (F.col("before") + 1).alias("ordinal"))


#: Orders of pass lists, each with ties by id: over passes(name, elev, quality, closes, nation, seasonal, metres).
ORDERS = {"name": "name", "elevation": "-elev", "quality": "-quality", "category": "CASE WHEN seasonal THEN 1 ELSE 0 END", "region": "nation", "distance": "metres", "status": "CASE WHEN closes IS NULL THEN 0 ELSE 1 END"}


def list_positions(passes: DataFrame) -> DataFrame:
    """The places of passes in each of seven list orders. Ranges of (order, key, id) count their rows, so that no task sorts
    a whole list, even one in which all keys are equal."""
    keys = [F.struct(F.lit(how).alias("how"), (F.lit(0.0) if how == "name" else F.expr(key).cast("double")).alias("k"), (F.col("name") if how == "name" else F.lit("")).alias("t")) for how, key in ORDERS.items()]
    keyed = passes.select("id", F.explode(F.array(*keys)).alias("x")).select("id", "x.*")
    return running(keyed, ["how"], ["k", "t", "id"], before=F.lit(1)).select("how", "id", (F.col("before") + 1).alias("position"))


top_pass_priority = define(
    "top_pass_priority", "Nodes within a cap: all junctions, then the best places up to their share, then the best passes in what is left; counted first, so that no task sorts all nodes.",
    """SELECT kind, id FROM (SELECT c.kind, c.id, c.cls, c.n_before + row_number() OVER (PARTITION BY c.cls, c.cell ORDER BY c.worth DESC, c.id) AS place FROM (SELECT n.*, b.n_before FROM {ranked_nodes} n JOIN (SELECT cls, cell, sum(count(*)) OVER (ORDER BY cls, cell DESC) - count(*) AS n_before FROM {ranked_nodes} GROUP BY cls, cell) b ON b.cls = n.cls AND b.cell = n.cell) c) p JOIN {node_cap} k ON p.place <= k.cap""",
)

top_tour_candidates = define(
    "top_tour_candidates", "From each start the passes by reward times affordability: half the budget less the way there, as a share of it; those that can't be reached and left again within the budget are out; the ten best.",
    """SELECT start_id, id, value, CAST(r AS BIGINT) AS rank FROM (SELECT start_id, id, value, row_number() OVER (PARTITION BY start_id ORDER BY value DESC, id) AS r FROM (
        SELECT s.start_id, p.id, floor(p.quality * (1e0 - 2e0 * t.cost / s.budget) * 1e6 + 5e-1) / 1e6 AS value FROM {starts} s JOIN {reach} t ON t.source = s.node JOIN {passes} p ON p.id = t.node WHERE t.cost * 2 <= s.budget AND p.id <> s.node) v) k WHERE r <= 10""",
)

agg_infer_intent = define(
    "agg_infer_intent", "Posterior over personas from each customer's tags, the season's context and the prior: softmax of summed weights; its entropy, whether it is ambiguous (the two best within 0.15), and each persona's place.",
    f"""SELECT user_id, persona, {js_round("p", 1000000)} AS probability, CAST(r AS BIGINT) AS place, {js_round("-sum(p * ln(p)) OVER (PARTITION BY user_id)", 1000000)} AS entropy, first_p - coalesce(second_p, 0e0) < 15e-2 AS ambiguous FROM (
        SELECT *, max(CASE WHEN r = 1 THEN p END) OVER (PARTITION BY user_id) AS first_p, max(CASE WHEN r = 2 THEN p END) OVER (PARTITION BY user_id) AS second_p FROM (
        SELECT user_id, persona, p, row_number() OVER (PARTITION BY user_id ORDER BY floor(p * 1e9 + 5e-1) DESC, persona) AS r FROM (
        SELECT user_id, persona, exp(s) / sum(exp(s)) OVER (PARTITION BY user_id) AS p FROM (
            SELECT t.user_id, r.persona, sum(coalesce(w.w, 0e0) * t.n) / max(t.total) + max(r.prior) + max(coalesce(c.boost, 0e0)) AS s FROM (SELECT user_id, tag, n, sum(n) OVER (PARTITION BY user_id) AS total FROM {{pinned_tags}}) t CROSS JOIN {{priors}} r LEFT JOIN {WEIGHTS} w ON w.tag = t.tag AND w.persona = r.persona LEFT JOIN {{user_context}} u ON u.user_id = t.user_id LEFT JOIN {{context_boosts}} c ON c.context = u.context AND c.persona = r.persona GROUP BY t.user_id, r.persona
        ) s ) q ) x ) y""",
)
