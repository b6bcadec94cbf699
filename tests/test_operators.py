"""Operators on small literal inputs."""

import hashlib
import json
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.functions import columns, ranges
from waymark.operators import drives, feeds, graph, links, planning, routes, schedules, search, shapes, spatial
from waymark.operators import records as records_
from waymark.operators import status as status_
from waymark.operators.status import status_rules
from waymark.sources import readers, sinks


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture(scope="module")
def candidates(spark):
    data = [(1, 10, 1, 3.0, 9.0, 9.0, ["a", "x"]), (1, 11, 2, 2.5, 8.0, 8.0, ["a", "x"]), (1, 12, 3, 1.0, 7.0, 7.0, ["b"]), (1, 13, 4, 5.0, 6.0, 6.0, ["a", "c"]), (2, 10, 1, 9.0, 1.0, 1.0, [])]
    return spark.createDataFrame(data, "tour_id long, poi long, ord int, detour double, rank_score double, score double, categories array<string>")


def test_detour_budget_skips_what_does_not_fit(candidates):
    got = rows(routes.detour_budget(candidates, 4.0), "tour_id", "poi", "kept")
    assert got == [(1, 10, True), (1, 11, False), (1, 12, True), (1, 13, False), (2, 10, False)]


def test_mmr_prefers_other_families(candidates):
    got = rows(routes.mmr(candidates, 3), "tour_id", "place", "poi")
    # 11 is the same as 10 and loses 2.5, 13 shares one of three categories and loses 0.83
    assert got == [(1, 1, 10), (1, 2, 12), (1, 3, 11), (2, 1, 10)]
    assert rows(routes.mmr(candidates, 3, 5.0), "tour_id", "place", "poi") == [(1, 1, 10), (1, 2, 12), (1, 3, 13), (2, 1, 10)]


LEGS = "tour_id long, ord int, duration_s long, distance_m long, scenic double, straight double, curvature double, gain_m long, dwell_s long, road_class string, kind string"


def legs(spark, *rows_):
    return spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows_)], LEGS)


def plain_breaks(chunks, threshold):
    """The rules one chunk after the other."""
    out, load, since, gap, segment = [], 0.0, 0, 10**9, None
    for seg, chunk, value, seconds in chunks:
        if seg != segment:
            segment, load, since = seg, 0.0, 0
        load, since, gap = load + value, since + seconds, gap + seconds
        if since > 2400 and gap >= 2400 and load > threshold + 1e-9:
            out.append((seg, chunk))
            load, since, gap = 0.0, 0, 0
    return out


def test_breaks_by_load_stops_and_cool_down(spark):
    import random

    rng = random.Random(6)
    data = {t: [(s, c, round(rng.random() * 2, 3), rng.choice([600, 600, 600, 240])) for s in range(rng.randint(1, 3)) for c in range(rng.randint(1, 14))] for t in range(40)}
    chunks = spark.createDataFrame([(t, *x, 0.0) for t, xs in data.items() for x in xs], "tour_id long, segment long, chunk long, load double, chunk_s long, position double")
    for persona, threshold in (("default", 3.5), ("family", 2.5)):
        got = rows(drives.breaks(chunks, persona), "tour_id", "segment", "chunk")
        assert got == sorted((t, *x) for t, xs in data.items() for x in plain_breaks(xs, threshold)) and got


def test_short_stays_do_not_cut_a_segment(spark):
    e = legs(spark, (1200, 9000, 0.5, 0.5, 0.1, 100, 600, "primary", "connector"), (600, 3000, 0.2, 0.1, 0.0, 0, 900, "motorway", "connector"), (1800, 20000, 0.1, 0.9, 0.2, 900, 0, "motorway", "pass-climb"))
    m = {r.segment: r for r in drives.segment_metrics(drives.segmented(e)).collect()}
    assert [(m[s].legs, m[s].duration_s, m[s].clock_s) for s in (0, 1)] == [(2, 1800, 0), (1, 1800, 3300)]
    assert m[0].scenic == 0.4 and m[0].motorway_share == 0.25 and m[0].main_road == "primary" and m[1].gain_per_km == 45.0
    c = rows(drives.load_curve(drives.segment_metrics(drives.segmented(e))), "segment", "chunk", "position", "boredom", "effort")
    # 10 minutes x 0.366667 straight x 0.6, and 10 x 0.2 x (45 - 30) / 100
    assert c[0] == (0, 0, 1.667, 2.2, 0.0) and c[3] == (1, 0, 3.333, 8.1, 0.3) and len(c) == 6
    assert drives.load_curve(drives.segment_metrics(drives.segmented(e.limit(0)))).count() == 0


def test_hunger_peaks_at_noon_and_falls_on_scenic_legs(spark):
    e = legs(spark, (14400, 1000, 0.1, 0.0, 0.0, 0, 0, "primary", "connector"), (3600, 1000, 0.05, 0.0, 0.0, 900, 0, "primary", "connector"), (3600, 1000, 0.9, 0.0, 0.0, 0, 0, "primary", "connector"))
    seg = drives.segmented(e)
    curve = {r.t_sec: r.need for r in drives.hunger_curve(seg).collect()}
    want = lambda t, more: round(max(0, math.exp(-0.5 * ((480 + t // 60 - 750) / 30) ** 2) + min(1, max(0, (t / 3600 - 4) / 2)) * 0.55 + more), 4)
    assert curve[0] == want(0, 0) == 0.0 and curve[16200] == want(16200, 0) and curve[18300] == want(18300, 0.3 - 0.2) and curve[21600] == want(21600, -0.2)
    w = drives.lunch_windows(drives.hunger_curve(seg)).first()
    # the climb ends at 18,000 s; the first leg is scenic, which keeps it under half of the peak
    assert w.peak_s == 18000 and w.from_s == 14700 and w.to_s > w.peak_s


def test_connections_need_a_schedule_and_a_proof_in_force(spark):
    base = {"id": 1, "mode": "rail", "direction": "both", "operating": True, "action": "publish", "verification": "verified", "freshness": "current", "flag": None, "minutes": 20, "end_a": 1, "end_b": 2, "zone": "Europe/Zurich", "departures": ["08:05", "23:50"], "valid_from": "2024-01-01", "valid_until": "2024-12-31"}
    odd = [{}, {"mode": "taxi"}, {"direction": "return"}, {"operating": None}, {"operating": False}, {"zone": None}, {"departures": ["8:05"]}, {"valid_until": "2024-06-30"}, {"verification": "disputed"}, {"flag": "critical_access_unknown"}, {}]
    schema = "id long, mode string, direction string, operating boolean, action string, verification string, freshness string, flag string, minutes int, end_a long, end_b long, zone string, departures array<string>, valid_from string, valid_until string, lat double, lon double, lat2 double, lon2 double"
    c = spark.createDataFrame([tuple({**base, **o, "id": i}.values()) + (0.0,) * 4 for i, o in enumerate(odd)], schema).withColumns({k: F.col(k).cast("date") for k in ("valid_from", "valid_until")})
    proofs = spark.createDataFrame([(i, "/geometry/coordinates" if i != 10 else "/names", "verified", "2024-07-01", "2024-07-03") for i in range(11)], "connection_id long, field string, status string, observed string, valid_until string").withColumns({k: F.col(k).cast("date") for k in ("observed", "valid_until")})
    at = lambda d, t: spark.createDataFrame([(1, i, i, d, f"{d} {t}") for i in range(11)], "tour_id long, ord int, connection_id long, day string, arrival string").withColumns({"day": F.col("day").cast("date"), "arrival": F.col("arrival").cast("timestamp")})
    codes = {r.ord: (r.code, r.departure) for r in schedules.refusals(at("2024-07-02", "06:05:01"), c, proofs).collect()}  # 08:05:01 in Zurich
    assert codes[0] == (None, 23 * 60 + 50)
    assert [codes[i][0] for i in range(1, 11)] == ["invalid", "direction_invalid", "operating_unknown", "not_operating", "timezone_invalid", "schedule_not_valid", "schedule_not_valid", "unverified", "quality_not_current", "provenance_unverified"]
    assert schedules.refusals(at("2024-07-02", "06:05:00"), c, proofs).where("ord = 0").first().departure == 8 * 60 + 5
    assert schedules.refusals(at("2024-07-04", "06:00:00"), c, proofs).where("ord = 0").first().code == "provenance_unverified"
    assert schedules.refusals(at("2024-07-02", "21:55:00"), c, proofs).where("ord = 0").first().code == "missed"
    best = schedules.chosen(schedules.refusals(at("2024-07-02", "06:00:00").where("ord > 0"), c, proofs)).first()
    assert best.chosen is None and best.reasons.startswith("invalid;direction_invalid;")


def metres(a, b):
    p, q, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
    return math.floor(2 * 6_371_000 * math.asin(min(1, math.sqrt(h))) + 0.5)


def test_nearest_goes_as_far_as_it_must(spark):
    rng = random.Random(8)
    nodes = [(i, 46 + rng.random(), 8 + rng.random()) for i in range(60)] + [(90, -45.0, 179.9), (91, 89.9, 10.0), (92, -90.0, 0.0)]
    nodes += [(100 + i, 46.5, 8.5) for i in range(30)] + [(200 + i, rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(200)]
    pts = [(i, 46 + rng.random(), 8 + rng.random()) for i in range(20)] + [(50, -44.0, -179.9), (51, 10.0, -60.0), (52, 90.0, 0.0), (53, 46.5, 8.5), (54, 46.5, 8.5), (55, 0.0, 180.0), (56, 0.0, -180.0)]
    pts += [(60 + i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(100)]
    df = lambda x: spark.createDataFrame(x, "id long, lat double, lon double")
    odd = [(900, None, 8.0), (901, 46.0, None), (None, 46.1, 8.1)]
    want = sorted((p[0], r + 1, n[0]) for p in pts for r, n in enumerate(sorted(nodes, key=lambda n: (metres(p, n), n[0]))[:3]))
    got = spatial.nearest(df(pts + odd), df(nodes + odd[:2]), 3).withColumnRenamed("r_id", "node").where("id is not null")
    assert rows(got, "id", "rank", "node") == want
    few = df(nodes[:2])
    assert rows(spatial.nearest(df(pts[:30]), few, 5), "id", "r_id") == sorted((p[0], n[0]) for p in pts[:30] for n in nodes[:2])
    near = spatial.nearest(df(pts), df(nodes), 3, most_m=300_000.0)
    assert rows(near, "id", "r_id") == sorted((p[0], n[0]) for p in pts for n in sorted(nodes, key=lambda n: (metres(p, n), n[0]))[:3] if metres(p, n) <= 300_000)
    assert spatial.nearest(df(pts), df([]), 3).count() == spatial.nearest(df([]), df(nodes), 3).count() == 0


def test_nearest_of_other_kinds_and_own_numbers(spark):
    rng = random.Random(9)
    pts = [(i, i // 3, 46 + rng.random() * rng.choice([0.01, 1, 20]), 8 + rng.random(), rng.randrange(1, 6)) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, kind long, lat double, lon double, want long")
    plain = lambda p: sorted((q for q in pts if q[1] != p[1]), key=lambda q: (metres((0, *p[2:4]), (0, *q[2:4])), q[0]))[: p[4]]
    want = sorted((p[0], r + 1, q[0]) for p in pts for r, q in enumerate(plain(p)))
    assert rows(spatial.nearest(df, df.drop("want"), None, apart="kind"), "id", "rank", "r_id") == want


def test_paths_avoid_what_is_forbidden_and_dear(spark):
    import heapq
    import random

    rng = random.Random(9)
    e = {(rng.randrange(40), rng.randrange(40)): rng.randrange(1, 9000) for _ in range(160)}
    df = spark.createDataFrame([(a, b, w / 1000) for (a, b), w in e.items()], "a long, b long, cost double")
    bad, used = {3, 7}, {(a, b) for a, b in e if (a + b) % 5 == 0}
    sources = spark.createDataFrame([(0,), (1,), (3,)], "source long")

    def dijkstra(s):
        best, heap = {}, [(0, 0, (s,), s)]
        while heap:
            d, h, path, n = heapq.heappop(heap)
            if n in best:
                continue
            best[n] = (d, h)
            for (a, b), w in e.items():
                if a == n and b not in bad and a != b:
                    heapq.heappush(heap, (d + w * (2 if (a, b) in used else 1), h + 1, (*path, b), b))
        return best

    got = graph.shortest_paths(df, sources, forbidden=spark.createDataFrame([(x,) for x in bad], "node long"), used=spark.createDataFrame(list(used), "a long, b long"), penalty=2.0)
    assert rows(got, "source", "node", "cost", "hops") == sorted((s, n, *v) for s in (0, 1) for n, v in dijkstra(s).items())
    assert all(r.path[0] == r.source and r.path[-1] == r.node and len(r.path) == r.hops + 1 for r in got.collect())
    near = graph.shortest_paths(df, sources, cap=4000)
    assert near.where("cost > 4000").count() == 0
    pairs = spark.createDataFrame([(0, n) for n in range(40)], "source long, node long")
    told = {r.node: r.status for r in graph.path_status(pairs, graph.shortest_paths(df, sources), 4000).collect()}
    assert set(told.values()) == {"ok", "over budget", "unreachable"} or len(set(told.values())) >= 2


def test_routes_join_their_legs(spark):
    e = spark.createDataFrame([(1, 2, 1.0, 10.0, 100.0), (2, 3, 1.0, 20.0, 200.0)], "a long, b long, cost double, duration_s double, distance_m double")
    stops = spark.createDataFrame([(1, 1, 1), (1, 2, 3), (1, 3, 3), (2, 1, 1), (2, 2, 9)], "tour_id long, ord int, node long")
    paths = graph.shortest_paths(e, spark.createDataFrame([(1,), (3,)], "source long"))
    assert rows(graph.route_cost(stops, paths).na.fill(-1), "tour_id", "legs", "cost") == [(1, 2, 2000), (2, 1, -1)]
    r = {x.tour_id: x for x in graph.materialized_routes(stops, paths, e).collect()}
    assert (list(r[1].path), r[1].edges, r[1].duration_s, r[1].distance_m) == ([1, 2, 3], 2, 30, 300) and r[2].unreachable == 1


def test_search_equals_a_full_scan(spark):
    import random

    rng = random.Random(10)
    word = lambda: rng.choice(["alp", "see", "furka", "grimsel", "pass", "b", "hut", "wald"])
    docs = [(i, f"T{i}", " ".join(word() for _ in range(rng.randint(1, 3))), rng.choice(["hike", "bike"])) for i in range(80)]
    asked = [(0, "furka pass"), (1, "grimsle"), (2, "b"), (3, ""), (4, "zzz qqq"), (5, "see alp hut"), (6, "forka pas")]
    grams = lambda t: {f"  {t}  "[i : i + 3] for i in range(len(t) + 2)}

    def score(q, t):
        if not q or q == t:
            return 1.0
        if t.startswith(q):
            return 0.94
        if q in t:
            return 0.82
        a, b = grams(q), grams(t)
        return sum(w in t for w in q.split(" ")) / len(q.split(" ")) * 0.62 + len(a & b) / len(a | b) * 0.38

    d = spark.createDataFrame([(i, t, x, x, a, 46.0, 8.0) for i, t, x, a in docs], "id long, title string, name string, text string, activity string, lat double, lon double")
    q = spark.createDataFrame([(i, x, None, None, None, None) for i, x in asked], "query_id long, query string, lat double, lon double, within_m double, activity string")
    got = {(r.query_id, r.id): r.relevance for r in search.search(d, q).collect()}
    want = {(i, j): score(x, t) for i, x in asked for j, _, t, _ in docs if score(x, t) >= 0.16}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in got)


def test_hidden_discovery_needs_more_than_obscurity(spark):
    schema = "id long, title string, distinctiveness double, uniqueness double, evidence double, confidence double, prominence double, variety double, activities array<string>, seasons array<string>, modes array<string>, themes array<string>, flags array<string>, lane string, legal string, action string, verification string"
    base = (0.9, 0.8, 0.9, 0.8, 0.1, 0.5, ["hiking"], ["summer"], ["train"], [], [], "quieter_verified", "legal", "publish", "verified")
    put = lambda i, **kw: (i, f"t{i}", *[kw.get(n.split()[0], v) for n, v in zip(schema.split(", ")[2:], base)])
    e = spark.createDataFrame([put(1), put(2, evidence=0.2, distinctiveness=0.3), put(3, legal="unknown"), put(4, legal="private"), put(5, action="redact"), put(6, flags=["technical_route"])], schema)
    a = {r.id: r for r in search.assess(e, search.Wish(hidden_only=True)).collect()}
    assert [a[i].eligible for i in range(1, 7)] == [True, False, False, False, False, False]
    assert a[2].lane == "quieter_lead" and "unverified lead" in a[2].uncertainties and a[4].exclusions[0] == "private"
    whole = 0.9 * 0.22 + 0.8 * 0.14 + 0.9 * 0.2 + 0.9 * 0.1 + 0.65 * 0.12 + 0.65 * 0.08 + 0.9 * 0.1 + 0.5 * 0.04
    assert a[1].score == round(whole, 3) and list(a[1].reasons) == ["distinctiveness", "evidence_quality", "lower_prominence"]
    assert search.assess(e, search.Wish(technical=True)).where("id = 6").first().eligible


def test_hints_in_two_languages(spark):
    texts = {
        "Closed until 15.05.2025": ("closed-until", 15, 5, 2025),
        "Voraussichtliche Öffnung: 3. Mai": ("predicted", 3, 5, None),
        "The road reopens again on June 7th, 2024": ("open-from", 7, 6, 2024),
        "Gesperrt bis Ende Winter": None,
        "open": None,
        "Expected opening: soon. Open from 2/6": ("predicted", 2, 6, None),
        "Expected pass opening\nabout 12 avril": ("predicted", 12, 4, None),
        "Wintersperre voraussichtlich bis 1er août 2023": ("closed-until", 1, 8, 2023),
        "Blocked till 31/12-2024 then 1.1.": ("closed-until", 31, 12, 2024),
        "Offen voraussichtlich ab 20 maerz": ("open-from", 20, 3, None),
        "Offen im Sommer 3. Mai": None,
        "Closed for works until 3 May": None,
        "shut through février 9": ("closed-until", 9, 2, None),
        "Opens 99/99, on maggio 4": ("open-from", 4, 5, None),
        "Geöffnet am 5 settembre 2022 (Closed until 1.1.)": ("open-from", 1, 1, None),
        "reopened 2024": None,
    }
    df = spark.createDataFrame([*enumerate(texts), (99, None), (98, "")], "id long, info string")
    got = {r.id: (r.kind, r.day, r.month, r.year) for r in feeds.hints(df).collect()}
    assert got == {i: w for i, w in enumerate(texts.values()) if w}


def test_aliases_of_names(spark):
    names = ["Berninapass", "Alpha Pass / Bêta-Joch - Gamma (old road)", "Passo", "Großer Sattel", "Xy Alpenstrasse", None]
    got = [set(r.a or ()) for r in spark.createDataFrame([(n,) for n in names], "n string").select(feeds.aliases(F.col("n")).alias("a")).collect()]
    assert got[:4] == [{"berninapass", "bernina"}, {"alphapass", "alpha", "betajoch", "beta", "gamma", "alphapassbetajochgamma"}, {"passo"}, {"grossersattel", "grosser"}]
    assert got[4] == {"xyalpenstrasse", "xyalpen"} and got[5] == set()


def test_record_rules_on_known_faults(spark):
    records = spark.createDataFrame([(1, "Place", "entity:1", "CH", 0.5, "verified", "2024-01-01", "publish", None), (2, "Thing", "-x", "", 1.5, "odd", None, "hide", None), (3, "Place", "entity:3", "CH", 0.5, "verified", "2024-01-01", "redact", None)], "id long, entity_type string, key string, jurisdiction string, confidence double, verification string, assessed string, action string, reason string")
    names = spark.createDataFrame([(1, 1, "en", "A", "primary"), (2, 1, "x1", " ", "nick"), (3, 1, "de", "Über", "alternate"), (3, 2, "DE", "über ", "alternate")], "entity_id long, idx int, language string, value string, kind string")
    positions = spark.createDataFrame([(1, i, *p) for i, p in enumerate([(7.0, 46.0), (8.0, 46.0), (8.0, 47.0), (7.0, 46.0)])] + [(2, 0, 200.0, 0.0), (3, 0, 0.0, 0.0), (3, 1, 0.0, 1.0), (3, 2, 1.0, 1.0), (3, 3, 1.0, 0.0)], "entity_id long, ord int, lon double, lat double")
    bounds = spark.createDataFrame([("CH", 5.0, 11.0, 45.0, 48.0)], "jurisdiction string, west double, east double, south double, north double")
    evidence = spark.createDataFrame([(1, 5, "/names", "survey", "verified", 0.5), (2, None, "names", "rumour", "guessed", 2.0)], "entity_id long, source_id long, field string, kind string, status string, confidence double")
    got = rows(records_.val_entity_common(records=records, names=names, positions=positions, bounds=bounds, evidence=evidence), "id", "rule")
    assert {r for i, r in got if i == 1} == set()
    assert {r for i, r in got if i == 2} == {"type unsupported", "key not readable", "jurisdiction missing", "name blank", "language tag", "name kind", "no primary name", "position invalid", "ring short", "assertion without source", "assertion pointer", "evidence kind", "assertion state", "assertion confidence", "quality confidence", "quality state", "quality not dated", "sensitivity action", "sensitivity without reason"}
    assert {r for i, r in got if i == 3} == {"name repeated", "no primary name", "ring open", "outside the jurisdiction", "no assertion", "sensitivity without reason"}


def test_adapters_run_apart(spark):
    fine = lambda: spark.createDataFrame([(1, "x")], "id long, name string")

    def broken():
        raise ValueError("no feed")

    got, failed = readers.isolated(spark, {"a": fine, "b": broken, "c": lambda: fine().drop("name")}, "id bigint, name string")
    assert rows(got, "adapter", "id") == [("a", 1)] and [r.adapter for r in failed.collect()] == ["b", "c"]
    with pytest.raises(RuntimeError):
        readers.isolated(spark, {"b": broken}, "id bigint")


def test_segments_join_and_turn_back(spark):
    line = lambda *ps: [{"lat": a, "lon": o} for a, o in ps]
    s = spark.createDataFrame([(1, 1, line((46.0, 8.0), (46.1, 8.0))), (1, 2, line((46.1, 8.0), (46.2, 8.1))), (2, 1, line((46.0, 8.0), (46.1, 8.0))), (2, 2, line((46.3, 8.0), (46.4, 8.0))), (3, 1, line((46.0, 8.0)))], "tour_id long, ord int, line array<struct<lat:double,lon:double>>")
    got = {r.tour_id: r for r in shapes.joined_segments(s).collect()}
    assert [p.y for p in got[1].out_and_back] == [46_000_000, 46_100_000, 46_200_000, 46_100_000, 46_000_000] and got[1].whole
    assert not got[2].whole and len(got[2].line) == 2 and len(got[3].out_and_back) == 1


def test_crossings_need_both_gateways_on_opposite_sides(spark):
    stops = spark.createDataFrame([(1, 1, 90, 46.0, 7.9), (1, 2, 91, 46.0, 8.1), (2, 1, 90, 46.0, 7.9), (2, 2, 91, 46.0, 8.0), (2, 3, 92, 46.0, 7.9), (3, 1, 5, 46.0, 7.9), (3, 2, 91, 46.0, 8.1)], "tour_id long, ord int, pass_id long, lat double, lon double")
    p = spark.createDataFrame([(5, 46.001, 8.0, False)], "id long, lat double, lon double, open boolean")
    b = spark.createDataFrame([(5, "A", 46.0, 7.94), (5, "B", 46.0, 8.06)], "pass_id long, side string, lat double, lon double")
    assert rows(shapes.pass_crossings(p, b, stops), "tour_id", "pass_id", "verdict") == [(1, 5, "blocked")]
    assert shapes.pass_crossings(p.withColumn("open", F.lit(True)), b, stops).first().verdict == "implicit"


def test_crossings_are_found_by_block_and_equal_those_of_single_hits(spark, monkeypatch):
    import random

    from waymark.operators import spatial

    rng = random.Random(4)
    sites = [(46.0 + rng.random(), 7.0 + rng.random() * 2) for _ in range(12)]
    near = lambda: [x + rng.uniform(-0.01, 0.01) for x in rng.choice(sites)]
    stops = spark.createDataFrame([(t, o, rng.randrange(60), *near()) for t in range(300) for o in range(1, 5)], "tour_id long, ord int, pass_id long, lat double, lon double")
    spots = [near() for _ in range(20)]  # passes of one place
    tops = [(i, *spots[i % 20], i % 3 > 0) for i in range(60)]
    sides = [(i, side, la, lo + d) for i, la, lo, _ in tops for side, d in (("A", -0.06), ("B", 0.06))]
    for tops_, sides_ in ((tops, sides), (tops + [(1, *spots[7], True)], sides + [(2, "A", *spots[5])])):
        p = spark.createDataFrame(tops_ + [(None, 46.0, 8.0, True), (99, None, 8.0, True)], "id long, lat double, lon double, open boolean")
        b = spark.createDataFrame(sides_, "pass_id long, side string, lat double, lon double")
        lines = spatial.line_segments(stops)
        hits = lambda q, m, name: {(r.tour_id, r.id): r.position for r in spatial.polyline_hits(q, lines, m).collect()}
        top = hits(p.select("id", "lat", "lon"), 1_500.0, "top")
        a, z = (hits(b.where(F.col("side") == s).select(F.col("pass_id").alias("id"), "lat", "lon"), 2_500.0, s) for s in "AB")
        planned = {(r.tour_id, r.pass_id) for r in stops.collect()}
        want = sorted((k[0], k[1], top[k], "implicit" if o else "blocked") for k in top if k in a and k in z and k not in planned and (a[k] < top[k]) != (z[k] < top[k]) for i, _, _, o in tops_ if i == k[1])
        assert len(want) > 20
        with monkeypatch.context() as m:  # nothing is listed by pass
            m.setattr(spatial, "polyline_hits", None)
            assert rows(shapes.pass_crossings(p, b, stops), "tour_id", "pass_id", "summit", "verdict") == want


def test_crossings_shuffle_the_stops_alone_and_go_by_groups_of_systems(spark, monkeypatch):
    import random

    from waymark.operators import spatial

    rng = random.Random(6)
    sites = [(46.0 + rng.random() / 2, 7.0 + rng.random()) for _ in range(12)]
    near = lambda: [x + rng.uniform(-0.01, 0.01) for x in rng.choice(sites)]
    stops = spark.createDataFrame([(t, o, rng.choice([None, rng.randrange(60)]), *near()) for t in range(200) for o in range(1, rng.choice([2, 4, 9]))], "tour_id long, ord int, pass_id long, lat double, lon double")
    tops = [(i, *near(), i % 3 > 0) for i in range(60)]
    p = spark.createDataFrame(tops, "id long, lat double, lon double, open boolean")
    b = spark.createDataFrame([(i, side, la, lo + d) for i, la, lo, _ in tops for side, d in (("A", -0.06), ("B", 0.06))], "pass_id long, side string, lat double, lon double")
    lines = [tuple(r) for r in spatial.line_segments(stops).collect()]
    hits = [{h[:2]: h[3] for h in plain_hits([(i, la, lo + d) for i, la, lo, _ in tops], [(t, o, (y, x), (y2, x2)) for t, o, y, x, y2, x2 in lines], reach)} for d, reach in ((0, 1_500.0), (-0.06, 2_500.0), (0.06, 2_500.0))]
    planned = {(r.pass_id, r.tour_id) for r in stops.collect()}
    s, a, z = hits
    want = sorted((k[1], k[0], s[k], "implicit" if tops[k[0]][3] else "blocked") for k in s if k in a and k in z and k not in planned and (a[k] < s[k]) != (z[k] < s[k]))
    assert len(want) > 20 and any(k in planned and k in a and k in z and (a[k] < s[k]) != (z[k] < s[k]) for k in s)
    made = shapes.pass_crossings(p, b, stops)
    assert rows(made, *made.columns) == want
    plan = shapes.pass_crossings(p, b, stops)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan
    monkeypatch.setattr(spatial, "CELLS", 20)
    made = shapes.pass_crossings(p, b, stops)
    assert rows(made, *made.columns) == want and made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") >= 3


def test_links_and_options_meet_places_and_not_their_copies(spark, monkeypatch):
    from waymark.operators import schedules

    seen, plain = [], schedules.within

    def within(left, right, *more):
        seen.append((left.count(), right.count()))
        return plain(left, right, *more)

    monkeypatch.setattr(schedules, "within", within)
    points = spark.createDataFrame([(i, 46.0, 8.0, "bus" if i % 2 else "car") for i in range(40)] + [(90, 10.0, 8.0, "bus")], "id long, lat double, lon double, mode string")
    links = spark.createDataFrame([(i, ("both", "outbound", "return")[i % 3], 46.0, 8.0, 46.0, 8.001 if i % 2 else 9.0) for i in range(30)], "id long, direction string, lat double, lon double, lat2 double, lon2 double")
    assert rows(schedules.transport_links(points, links), "id", "outbound", "inbound") == [(i, 15, 20) for i in range(40)]
    routes = spark.createDataFrame([(i, 46.0, 8.0, 46.0, 8.0 if i % 2 else 9.0, True) for i in range(20)] + [(50, 10.0, 8.0, 20.0, 8.0, True)], "id long, lat double, lon double, lat2 double, lon2 double, retraced boolean")
    assert rows(schedules.journey_options(routes, points, links), "id", "modes", "way_back") == [(i, "bus,car", "loop" if i % 2 else "transport") for i in range(20)] + [(50, "bus", "out_and_back")]
    assert max(max(x) for x in seen) <= 12


def test_packages_refuse_what_cannot_fit(spark):
    items = spark.createDataFrame([("r", i, json.dumps({"id": i, "x": "y" * n})) for i, n in enumerate([40, 50, 30])], "region string, id long, document string")
    got = {r.shard: r for r in sinks.packages(items, 270).collect()}
    head = '{"schemaVersion":"1.0.0","artifactType":"region-package","regionId":"r","shardIndex":%d,"shardCount":2,"entities":['
    documents = [head % 0 + ",".join(json.dumps({"id": i, "x": "y" * n}) for i, n in ((0, 40), (1, 50))) + "]}", head % 1 + json.dumps({"id": 2, "x": "y" * 30}) + "]}"]
    assert {k: (r.n, r.bytes, r.hash) for k, r in got.items()} == {k: (2 - k, len(d), hashlib.sha256(d.encode()).hexdigest()) for k, d in enumerate(documents)}
    with pytest.raises(ValueError, match="record 1 "):
        sinks.packages(items, 180)


def greedy(sizes, budget):
    shard, used, held, out = 0, 0, 0, []
    for b in sizes:
        if held and used + b > budget:
            shard, used, held = shard + 1, 0, 0
        used, held = used + b, held + 1
        out.append(shard)
    return out


def test_shards_are_those_of_the_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 150)
    rng = random.Random(7)
    one = [(None, i if i < 900 else 10**9 + i, rng.choice([0, 1, 5, 30, 99, 100, 101, 250])) for i in range(1_000)]  # clustered ids, one region of nearly all rows
    few = [("s", i * i, rng.randrange(1, 60)) for i in range(40)]
    got = {(r.region, r.id): (r.shard, r.oversized) for r in sinks.byte_shards(spark.createDataFrame(one + few, "region string, id long, bytes long"), 100).collect()}
    for part in (one, few):
        assert [got[r, i] for r, i, _ in part] == [(s, b > 100) for s, (_, _, b) in zip(greedy([b for *_, b in part], 100), part)]
    assert sinks.byte_shards(spark.createDataFrame([], "region string, id long, bytes long"), 100).count() == 0


def test_running_sums_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranges, "ROWS", 20)
    rows_ = [(k, i, (i * 7) % 5) for k in (None, "a", "b") for i in range(200 if k == "a" else 7)]
    df = spark.createDataFrame(rows_, "k string, i long, x long")
    got = {(r.k, r.i): (r.n, r.s) for r in ranges.running(df, ["k"], ["i"], n=F.lit(1), s=F.col("x")).collect()}
    assert got == {(k, i): (i, sum((j * 7) % 5 for j in range(i))) for k, i, _ in rows_}
    total = {r.i: r.n for r in ranges.running(df.where("k = 'a'"), [], [F.desc("i")], n=F.lit(1)).collect()}
    assert total == {i: 199 - i for i in range(200)}


def test_rests_are_spread(spark):
    stops = spark.createDataFrame([(1, i, 0.1 * (i == 4)) for i in range(1, 6)] + [(2, 1, 0.0)], "tour_id long, ord int, scenic double")
    assert rows(routes.rest_assignment(stops, 2), "tour_id", "rest", "ord") == [(1, 1, 2), (1, 2, 4), (2, 1, 1)]


def test_hulls_of_few_points(spark):
    pts = [(1, 0.0, 0.0)] + [(2, x, y) for x, y in [(0.0, 0.0), (1.0, 0.0)]] + [(3, x, y) for x, y in [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (1.0, 1.0)]]
    got = {r.tour_id: (r.corners, r.area) for r in routes.zone_hulls(spark.createDataFrame(pts, "tour_id long, lon double, lat double")).collect()}
    assert got[1][0] == 4 and got[2][0] == 4 and got[3] == (4, 4.0)


def test_grid_join_meets_everything_within_reach(spark):
    import itertools
    import random

    rng = random.Random(3)
    pts = [(i, rng.uniform(-84, 84), rng.choice([-179.99, 179.99, rng.uniform(-180, 180), 10 + rng.random()])) for i in range(250)]
    pts += [(300 + i, 60 + rng.random() * 0.05, 20 + rng.random() * 0.1) for i in range(60)]

    def metres(a, b):
        p, q, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    for reach in (1_500.0, 40_000.0):
        got = {(r.id, r.r_id) for r in spatial.within(df, df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns]), reach).collect()}
        want = {(a[0], b[0]) for a, b in itertools.product(pts, pts) if metres(a, b) <= reach}
        assert got == want


def test_near_duplicates_need_name_type_and_distance(spark):
    data = [(1, "A", "x", 46.0, 8.0), (2, "a", "x", 46.001, 8.0), (3, "A", "y", 46.0, 8.0), (4, "A", "x", 46.01, 8.0), (5, "A", "x", 46.0, 8.0)]
    df = spark.createDataFrame(data, "id long, name string, category string, lat double, lon double")
    assert rows(spatial.near_duplicates(df), "a", "b", "metres") == [(1, 2, 111), (1, 5, 0), (2, 5, 111)]


def test_polyline_hit_is_fractional(spark):
    line = spark.createDataFrame([(1, 1, 46.0, 8.0, 46.0, 8.1)], "tour_id long, ord int, lat double, lon double, lat2 double, lon2 double")
    point = spark.createDataFrame([(9, 46.001, 8.025), (8, 47.0, 8.0)], "id long, lat double, lon double")
    assert rows(spatial.polyline_hits(point, line, 500.0), "id", "metres", "position") == [(9, 111, 1.25)]


def test_surroundings_meet_places_and_not_their_copies(spark):
    p = spark.createDataFrame([(i, 46.0, 8.0) for i in range(50)] + [(60, None, 8.0)], "id long, lat double, lon double")
    kinds = ["peak", "peak", "open", "closed", "closed", "parking"]
    f = spark.createDataFrame([(100 + i, k, 46.001, 8.0) for i, k in enumerate(kinds * 20)], "id long, kind string, lat double, lon double")
    got = spatial.surroundings(p, f, 8_000.0)
    assert rows(got, *got.columns) == [*((i, 40, 0, 0, 0, 0.333, 105, 111) for i in range(50)), (60, 0, 0, 0, 0, None, None, None)]
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [lat") + text.count("Aggregate [r_lat") >= 2


def test_points_of_one_place_are_linked_through_its_least_id(spark):
    from waymark.operators import graph

    df = spark.createDataFrame([(i, 46.0, 8.0) for i in range(30)] + [(i, 46.0, 8.01) for i in range(30, 60)] + [(70, 47.0, 8.0)], "id long, lat double, lon double")
    edges = spatial.proximity(df, 1_000.0)
    assert edges.count() == 62
    assert sorted(tuple(r) for r in graph.components(edges).collect()) == [*((i, 0) for i in range(60)), (70, 70)]


def test_polyline_hits_are_made_once_for_a_place_and_reduced_there(spark):
    line = spark.createDataFrame([(1, 1, 46.0, 8.0, 46.0, 8.1), (1, 2, 46.0, 8.1, 46.0, 8.0), (2, 1, 46.3, 8.0, 46.3, 9.0)], "tour_id long, ord int, lat double, lon double, lat2 double, lon2 double")
    point = spark.createDataFrame([(9, 46.001, 8.025), (7, 46.001, 8.025), (7, 46.001, 8.025), (6, 46.302, 8.5), (6, 46.301, 8.75), (None, 46.0, 8.0)], "id long, lat double, lon double")
    hits = spatial.polyline_hits(point, line, 500.0)
    assert rows(hits, "id", "tour_id", "metres", "position") == [(6, 2, 111, 1.75), (7, 1, 111, 1.25), (9, 1, 111, 1.25)]
    assert "Window" not in hits._jdf.queryExecution().executedPlan().toString()


def plain_hits(points, legs, reach):
    """Every point against every cut of every leg: the least whole metres, and of those the first place."""

    def metres(p, q):
        a, b, d = math.radians(p[0]), math.radians(q[0]), math.radians(q[1] - p[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    best = {}
    for tour, ord_, p, q in legs:
        n = max(1, math.ceil(metres(p, q) / (2 * reach)))
        at = lambda f: (p[0] + (q[0] - p[0]) * f, p[1] + (q[1] - p[1]) * f)  # noqa: E731, B023
        for i, lat, lon in points:
            for turn in (-360, 0, 360):
                c = math.cos(math.radians(lat))
                for k in range(n):
                    (y, x), (y2, x2) = at(k / n), at((k + 1) / n)
                    dx, dy = (x2 - x) * c, y2 - y
                    t = max(0.0, min(1.0, ((lon + turn - x) * c * dx + (lat - y) * dy) / max(dx * dx + dy * dy, 1e-300)))
                    off = math.floor(metres((lat, lon), (y + dy * t, x + (x2 - x) * t)) + 0.5)
                    if off <= reach:
                        best[i, tour] = min(best.get((i, tour), (1e9,)), (off, math.floor((ord_ + (k + t) / n) * 1000 + 0.5) / 1000))
    return sorted((*k, *v) for k, v in best.items())


@pytest.mark.parametrize("reach", [1_500.0, 60_000.0])
def test_hits_of_tracks_equal_plain_ones_and_meet_no_points_in_a_join(spark, monkeypatch, reach):
    import random

    rng = random.Random(11)
    wide = reach / 1_500
    sites = [(46.0, 8.0), (46.2 + wide / 50, 8.3), (0.0, 179.99), (-0.01, -179.99), (78.0, 15.0), (44.0, 5.5)]
    near = lambda s: (s[0] + rng.uniform(-0.02, 0.02) * wide, min(180.0, max(-180.0, s[1] + rng.uniform(-0.02, 0.02) * wide)))
    tours = {t: [near(rng.choice(sites[:2] if t % 2 else sites[2:4] if t % 3 else sites[4:])) for _ in range(n)] for t, n in enumerate([1, 2, 5, 9, 60, 3, 7, 4])}
    tours[8] = [(44.0, 5.5), (47.8, 14.0)]
    sides = [(t, o + 1, *p) for t, line in tours.items() for o, p in enumerate(line)]
    spots = [(i, *near(s)) for i, s in enumerate(sites * 8)] + [(90, 44.0 - 3.8 * 1.46e-3 * wide, 5.5 - 8.5 * 1.46e-3 * wide)]
    points = spark.createDataFrame([*spots, (91, *spots[0][1:]), (None, 46.0, 8.0), (92, None, 8.0)], "id long, lat double, lon double")
    stops = spark.createDataFrame([*sides, (3, 100, None, None)], "tour_id long, ord int, lat double, lon double")
    legs = [(t, o + 1, *pair) for t, line in tours.items() for o, pair in enumerate(zip(line, line[1:])) if abs(pair[0][1] - pair[1][1]) < 350]
    whole = stops.where("lat is not null").join(spark.createDataFrame([(t, o) for t, o, *_ in legs], "tour_id long, ord int"), ["tour_id", "ord"])
    want = plain_hits([*spots, (91, *spots[0][1:])], legs, reach)
    assert len(want) > 80 and any(i == 90 for i, *_ in want)
    segments = spark.createDataFrame([(t, o, *p, *q) for t, o, p, q in legs], "tour_id long, ord int, lat double, lon double, lat2 double, lon2 double")
    assert whole.count() == len(legs) and rows(spatial.polyline_hits(points, segments, reach), "id", "tour_id", "metres", "position") == want
    inland = [h for h in want if h[1] % 2 or h[1] == 8]
    monkeypatch.setattr(spatial, "CELLS", 10)  # places go in several groups
    hits = spatial.track_hits(points, stops.where("tour_id % 2 = 1 or tour_id = 8"), reach)
    assert rows(hits, "id", "tour_id", "metres", "position") == inland
    monkeypatch.undo()
    plan = spatial.track_hits(points, stops, reach)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "cy" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_road_classes_meet_places_once(spark):
    sides = spark.createDataFrame([(i, "A", 46.0, 8.0, 46.0, 8.05) for i in range(20)], "pass_id long, side string, lat double, lon double, lat2 double, lon2 double")
    roads = spark.createDataFrame([(i, "track" if i % 3 else "trunk", 46.001, 8.02) for i in range(30)], "id long, class string, lat double, lon double")
    got = spatial.road_classes(sides, roads)
    assert rows(got, *got.columns) == [(i, "A", 30, "track", True) for i in range(20)]
    assert rows(got, *got.columns) == rows(spatial.dominant_class(spatial.road_geometry(sides, roads)), *got.columns)


def test_region_by_crossings(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (1.0, 1.0), (0.0, 2.0)]
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.0, 1.8), (3, 3.0, 1.0)], "id long, lon double, lat double")
    assert rows(spatial.in_region(pts, square), "id") == [(1,)]


def test_closure_rules_wrap_the_year(spark):
    p = spark.createDataFrame([(1, 2500, 11, 4, None, None), (2, 1000, None, None, None, None), (3, 2300, None, None, None, None)], "id long, elev int, closes int, opens int, open_day int, close_day int")
    got = {(r.id, r.month): r.state for r in status_rules(passes=p).collect()}
    assert [got[1, m] for m in (10, 11, 12, 4, 5)] == ["open", "closed", "closed", "closed", "open"]
    assert got[2, 1] == "open" and got[3, 5] == "closed" and got[3, 6] == "open"


def test_shortest_paths_components_and_closure(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 1, 1.0), (7, 8, 1.0)], "a long, b long, cost double")
    src = spark.createDataFrame([(1,)], "source long")
    assert rows(graph.shortest_paths(e, src), "node", "cost", "hops") == [(1, 0, 0), (2, 1000, 1), (3, 2000, 2)]
    assert rows(graph.components(e), "node", "root") == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert rows(graph.reachable(e, spark.createDataFrame([(2,)], "node long")), "node") == [(1,), (2,), (3,)]


def test_byte_shards_respect_the_budget(spark):
    items = spark.createDataFrame([("r", i, b) for i, b in enumerate([40, 50, 30, 200, 10])], "region string, id long, bytes long")
    got = rows(sinks.byte_shards(items, 100), "id", "shard", "oversized")
    assert got == [(0, 0, False), (1, 0, False), (2, 1, False), (3, 2, True), (4, 3, False)]


def test_scalars(spark):
    df = spark.createDataFrame([("Crème  Brûlée’s №1", 1), (None, 2), ("", 3)], "text string, id int")
    got = dict(rows(columns.normalized(df, "text").where("text is not null"), "id", "normalized"))
    assert got == {1: "creme brulees no1", 3: ""}
    hashes = [r.h for r in spark.createDataFrame([("",), ("a",), ("foobar",)], "s string").select(columns.fnv1a(F.col("s")).alias("h")).collect()]
    assert [int(h, 36) for h in hashes[1:]] == [0xE40C292C, 0xBF9CF968]


def test_embedded_array_tolerates_comments_and_commas(spark):
    text = '/* a */ const ITEMS = [ // list\n {"n": "x", "v": 1}, /* b */ {"n": "y", "v": 2,},\n];'
    got = readers.embedded_array(spark.createDataFrame([("f", text)], "asset string, text string"), "n:string,v:int")
    assert rows(got, "asset", "n", "v") == [("f", "x", 1), ("f", "y", 2)]


def test_snapshot_needs_its_digest(spark):
    made = spark.createDataFrame([("good", '{"features":[{"id":1},{"id":2}]}'), ("bad", '{"features":[{"id":3}]}')], "name string, j string")
    files = made.select("name", F.col("j").cast("binary").alias("content"), F.when(F.col("name") == "good", F.sha2("j", 256)).otherwise("0").alias("sha256"))
    assert rows(readers.pinned_snapshot(files, "id:bigint"), "name", "id") == [("good", 1), ("good", 2)]


def plain_retraces(tours, step=200, near=100.0, least=800, buffer=350.0):
    """Every sample of every leg against every other."""

    def metres(p, q):
        a, b, d = math.radians(p[0]), math.radians(q[0]), math.radians(q[1] - p[1])
        h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(d / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    out = {}
    for tour, line in tours.items():
        at = [0.0]
        for p, q in zip(line, line[1:]):
            at.append(at[-1] + metres(p, q))
        samples, leg = [], 0
        for k in range(int(at[-1] // step) + 1):
            while leg < len(line) - 2 and at[leg + 1] <= k * step:
                leg += 1
            f = (k * step - at[leg]) / (at[leg + 1] - at[leg])
            samples.append((leg, k * step, *(u + (v - u) * f for u, v in zip(line[leg], line[leg + 1]))))
        for i, (a, m, *p) in enumerate(samples):
            for b, n, *q in samples[i + 1 :]:
                if a == b or any(abs(math.floor(u / 0.001) - math.floor(v / 0.001)) > 1 for u, v in zip(p, q)):
                    continue
                if b - a == 1 and min(abs(m - at[b]), abs(n - at[b])) <= buffer:
                    continue
                if metres(p, q) <= near:
                    out[tour, a + 1, b + 1] = out.get((tour, a + 1, b + 1), 0) + step
    return sorted((*k, m) for k, m in out.items() if m >= least)


def test_retraces_equal_all_pairs_of_samples(spark):
    import random

    rng = random.Random(5)
    tours = {
        1: [(46.0, 8.0), (46.1, 8.1), (46.0003, 8.0)],  # out and back
        2: [(46.0, 8.0), (46.0, 8.018), (46.003, 8.02), (46.0004, 8.017), (46.0004, 8.001)],  # legs under two km, out of phase
        3: [(46.0, 8.0), (46.05, 8.05), (46.05, 8.0), (46.0, 8.05)],  # a crossing alone
        4: [(46.0, 8.0), (46.0, 8.0075), (46.0, 8.0)],  # short of 800 m beyond the buffer
        5: [(46.0, 8.0), (46.0, 8.0), (46.08, 8.0), (46.08, 8.0009), (46.0, 8.0009), (46.0, 8.0009)],  # along a meridian, legs without length
        6: [(46.0, 8.0), (46.0, 8.1), (46.001, 8.1), (46.001, 8.0), (46.0001, 8.03), (46.0001, 8.08)],
    }
    for tour in range(7, 37):
        ends = [(46 + rng.choice([0, 0.03, 0.06]), 8 + rng.choice([0, 0.04, 0.08])) for _ in range(3)]
        tours[tour] = [(p[0] + rng.uniform(-0.001, 0.001), p[1] + rng.uniform(-0.001, 0.001)) for p in (rng.choice(ends) for _ in range(rng.randrange(2, 8)))]
    stops = spark.createDataFrame([(t, i + 1, *p) for t, line in tours.items() for i, p in enumerate(line)], "tour_id long, ord int, lat double, lon double")
    want = plain_retraces(tours)
    assert {t for t, *_ in want} > {1, 2, 5, 6} and not {3, 4} & {t for t, *_ in want}
    assert rows(routes.retrace_overlap(stops), "tour_id", "ord", "other", "metres") == want


def test_pairs_of_legs_are_dealt_out_before_their_samples_are_listed(spark):
    stops = spark.createDataFrame([(1, 1, 46.0, 8.0), (1, 2, 46.1, 8.1)], "tour_id long, ord int, lat double, lon double")
    plan = routes.retrace_overlap(stops)._jdf.queryExecution().executedPlan().toString().replace("#", " ")
    assert "REPARTITION_BY_NUM" in plan


def test_legs_of_a_tour_meet_without_a_join_and_only_where_enough_samples_can(spark):
    import random

    import numpy as np
    import pyarrow as pa

    from waymark.operators import legs

    rng = random.Random(8)
    corners = [(46 + a * 0.05, 8 + b * 0.05) for a in range(3) for b in range(3)]
    tours = {t: [(p[0] + rng.uniform(-0.002, 0.002), p[1] + rng.uniform(-0.002, 0.002)) for p in (rng.choice(corners) for _ in range(n))] for t, n in enumerate([2, 90, 1, 30, 7, 7])}
    stops = spark.createDataFrame([(t, i + 1, *p) for t, line in tours.items() for i, p in enumerate(line)] + [(None, 1, 46.0, 8.0), (None, 2, 46.1, 8.0), (None, 3, 46.0, 8.0)], "tour_id long, ord int, lat double, lon double")
    want = plain_retraces({t: line for t, line in tours.items() if len(line) > 1})
    assert len(want) > 50
    for size in ("7", "10000"):  # tours go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert rows(routes.retrace_overlap(stops), "tour_id", "ord", "other", "metres") == want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Join" not in routes.retrace_overlap(stops)._jdf.queryExecution().executedPlan().toString()

    ids = [1, 1, 1, 2, 3, 3, 3, 3, 4]
    for size in range(1, 10):
        for least in range(1, 10):
            told = list(legs.whole_tours([pa.record_batch({"tour_id": ids[k : k + size]}) for k in range(0, 9, size)], least))
            assert sum((t["tour_id"].to_pylist() for t, _ in told), []) == ids
            assert [t["tour_id"].to_pylist()[a] for t, starts in told for a in starts] == [1, 2, 3, 4]
    assert [(s.start, s.stop) for s in legs.slices(np.array([3, 3, 9, 1, 1]), 4)] == [(0, 1), (1, 2), (2, 4), (4, 5)]

    line = [(46.0, 8.0), (46.2, 8.0), (46.2, 8.2), (46.0, 8.2001), (46.1, 8.1), (46.0, 8.01), (46.2, 8.0001)]
    made = pa.record_batch({"tour_id": [1] * 6, "ord": list(range(1, 7)), **{c: [p[k % 2] for p in line[k // 2 : 6 + k // 2]] for k, c in enumerate(("lat", "lon", "lat2", "lon2"))}, "length": [legs.metres(*p, *q) for p, q in zip(line, line[1:])]})
    pairs = [(r["ord"], r["other"]) for b in legs.Retraces(200, 100.0, 800, 350.0).pairs([made]) for r in b.to_pylist()]
    assert pairs == [(1, 6)]  # of fifteen, of which most touch


def plain_clusters(items, radius=64, size=65536):
    """Links of adjoining cells tried one by one, the closest first."""
    cells, out = {}, []
    for i, x, y, planned in items:
        if planned:
            out.append((i, 1, int(x + 0.5), int(y + 0.5)))
        else:
            cells.setdefault((int(x // radius), int(y // radius)), []).append((i, x, y))
    key = lambda c: f"{c[0]},{c[1]}"
    centre = lambda ps: (sum(p[1] for p in ps) / len(ps), sum(p[2] for p in ps) / len(ps))
    links = [(math.dist(centre(cells[c]), centre(cells[d])), key(c), key(d)) for c in cells for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (d := (c[0] + dx, c[1] + dy)) in cells and key(c) < key(d)]
    owner, groups = {key(c): key(c) for c in cells}, {key(c): list(ps) for c, ps in cells.items()}
    for d, a, b in sorted(links):
        a, b = sorted((owner[a], owner[b]))
        if d > radius * 0.92 or a == b:
            continue
        both = groups[a] + groups[b]
        if all(math.dist(centre(both), p[1:]) <= radius * 0.7 for p in both):
            groups[a] = both
            del groups[b]
            owner = {k: a if v == b else v for k, v in owner.items()}
    return sorted(out + [(min(p[0] for p in ps), len(ps), *(int(v + 0.5) for v in centre(ps))) for ps in groups.values()])


def test_clusters_merge_across_every_border(spark):
    import random

    rng = random.Random(7)
    items = [(1, 255.0, 1000.0, False), (2, 257.0, 1000.0, False), (3, 256.5, 1001.0, True)]  # the border of cells 3 and 4
    items += [(10 + i, 2000.0 + 40 * i, 3000.0, False) for i in range(12)]  # a chain that must not become one
    items += [(100 + i, 9000 + rng.uniform(0, 900), 9000 + rng.uniform(0, 900), i % 25 == 0) for i in range(150)]
    rng.shuffle(items)
    made = [(i, x / 65536 * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * y / 65536)))), planned) for i, x, y, planned in items]
    got = rows(routes.overlay_clusters(spark.createDataFrame(made, "id long, lon double, lat double, planned boolean")), "first", "n", "px", "py")
    want = plain_clusters(items)
    assert (1, 2, 256, 1000) in got and (3, 1) in [r[:2] for r in got]
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert all(abs(u - v) <= 1 for g, w in zip(got, want) for u, v in zip(g, w))


def test_routes_are_told_apart_by_all_their_places(spark):
    tours = {1: [2, 5, 9], 2: [2, 6, 8], 3: [9, 5, 2], 4: [2, 5, 9], 5: [100, 2, 11]}  # equal sums, least places and counts; 4 repeats 1
    scenic = {1: 1.0, 2: 3.0, 3: 2.0, 4: 4.0, 5: 0.5}
    data = [(t, i + 1, p, scenic[t] / 3, "2024-05-02" if t == 5 else "2024-05-01") for t, ps in tours.items() for i, p in enumerate(ps)]
    stops = spark.createDataFrame(data, "tour_id long, ord int, place_id long, scenic double, day string").withColumn("day", F.col("day").cast("date"))
    assert rows(routes.alternatives(stops), "day", "rank", "tour_id") == [(19844, 1, 1), (19844, 2, 2), (19844, 3, 3), (19845, 1, 5)]
    assert rows(routes.tour_archive(stops), "day", "rank", "tour_id", "score") == [(19844, 1, 4, 4.0), (19844, 2, 2, 3.0), (19844, 3, 3, 2.0), (19845, 1, 5, 0.5)]


def test_streamed_breaks_against_plain_rules(spark, tmp_path):
    import random

    from waymark.streaming import status

    rng = random.Random(11)
    data = [(i % 5, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", i, rng.uniform(-10, 60)) for i in range(400)]
    df = spark.createDataFrame(data, "pass_id long, ts string, event_id long, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = rows(spark.read.parquet(status._run(status.breaks_due(stream), "append")), "pass_id", "number", "event_id")
    want = []
    for key in range(5):
        total, since, number = 0.0, 0, 0
        for k, _, event, value in data:
            if k != key:
                continue
            total, since = total + value, since + 1
            if total > 120 and since >= 4:
                number += 1
                want.append((key, number, event))
                total, since = 0.0, 0
    assert got == sorted(want) and len(want) > 20


def test_withheld_records_take_those_that_ask_for_them(spark):
    records = spark.createDataFrame([(i, i in (20, 21, 22)) for i in [*range(1, 10), 20, 21, 22, 23, 30, 31, 32, 40, 41]] + [(1, False), (None, False)], "id long, coarsened boolean")
    references = [(2, 1), (3, 2), (3, 1), (4, 99), (5, 4), (5, 1), (6, 5), (7, 7), (8, None)]
    references += [(21, 20), (23, 20)]  # only what is coarsened itself may ask for what is coarsened
    references += [(30, 31), (31, 32), (32, 30)]  # a ring stays
    references += [(40, 41), (41, 40), (41, 6)]  # unless something takes one of it
    got = graph.reference_closure(records, spark.createDataFrame(references, "id long, ref long"))
    assert rows(got, "id") == [(i,) for i in (1, 2, 3, 7, 8, 9, 20, 21, 22, 30, 31, 32)]
    assert graph.reference_closure(records.limit(0), spark.createDataFrame(references, "id long, ref long")).count() == 0


def test_a_chain_of_withheld_records(spark):
    n = 30
    records = spark.range(n).selectExpr("id", "false AS coarsened")
    chain = spark.range(1, n).selectExpr("id", "id - 1 AS ref")
    assert graph.reference_closure(records, chain).count() == n
    assert graph.reference_closure(records.where("id > 0"), chain).count() == 0


def test_pairs_of_places_are_told_apart(spark):
    stops = spark.createDataFrame([(1, i, p, i) for i, p in enumerate([1, 2_000_001, 2, 1_000_001])] + [(2, i, p, 5) for i, p in enumerate([1, 2, 1, 2])], "tour_id long, ord int, place_id long, pass_id long")
    assert rows(routes.agg_retrace_counts(stops=stops), "tour_id", "retraced", "out_and_back") == [(1, 0, 0), (2, 2, 2)]


def test_positions_when_all_keys_are_equal(spark, monkeypatch):
    from waymark.operators import discovery

    monkeypatch.setattr(ranges, "ROWS", 30)
    passes = spark.range(100).selectExpr("id", "'same' AS name", "2000 AS elev", "0.5D AS quality", "cast(null as int) AS closes", "1 AS nation", "false AS seasonal", "7.0D AS metres")
    got = discovery.list_positions(passes).groupBy("id").agg(F.min("position").alias("a"), F.max("position").alias("b"), F.count("*").alias("n"))
    assert rows(got, "id", "a", "b", "n") == [(i, i + 1, i + 1, 7) for i in range(100)]


def known(spark, asked, rules=(), histories=(), readings=()):
    """pass_status() of (pass_id, today, day) as pass_id -> (state, basis); passes 1 to 9 lie at 1,000 m, others at 2,500 m."""
    frame = lambda rows_, kind: spark.createDataFrame(list(rows_), kind)
    passes = frame([(i, 1_000 if i < 10 else 2_500) for i in range(1, 30)], "id long, elev int")
    asked = frame([(i, p, t, d) for i, (p, t, d) in enumerate(asked)], "k long, pass_id long, today string, day string").withColumns({"today": F.to_date("today"), "day": F.to_date("day")})
    readings = frame([(i, *r[:4], *(r[4] if len(r) > 4 else (None,) * 4)) for i, r in enumerate(readings)], "id long, pass_id long, ts string, source string, state string, hint_kind string, hint_day int, hint_month int, hint_year int").withColumn("ts", F.to_timestamp("ts"))
    out = status_.pass_status(asked, passes, frame(rules, "pass_id long, value string, from_month int, to_month int"), frame(histories, "pass_id long, open_doy int, close_doy int"), readings)
    return [(r.state, r.basis) for r in out.orderBy("k").collect()]


def test_status_of_a_day_goes_by_precedence(spark):
    day = "2024-11-20"
    asked = [(p, day, day) for p in (1, 10, 11, 12, 13, 14, 15)]
    rules = [(11, "no", 11, 5), (12, "no", 11, 5), (13, "destination", 1, 12), (14, "no", 11, 5)]
    histories = [(13, 150, 290), (14, 150, 350), (15, 300, 30)]
    readings = [(12, "2024-11-01 10:00", "alert", "restricted"), (12, "2024-11-21 10:00", "live", "open"), (14, "2024-11-19 08:00", "alert", "unknown"), (11, "2024-11-20 23:00", "live", "open"), (11, "2024-11-20 23:00", "live", "restricted")]
    want = [("open", "elevation"), ("closed", "elevation"), ("restricted", "live"), ("restricted", "alert"), ("closed", "history"), ("closed", "rule"), ("open", "history")]
    assert known(spark, asked, rules, histories, readings) == want


def test_status_of_a_later_day(spark):
    today = "2024-03-01"
    hint = lambda kind, d, m, y=None: (kind, d, m, y)
    asked = [(10, today, "2024-04-01"), (10, today, "2024-04-02"), (11, today, "2024-06-30"), (12, today, "2024-06-30"), (13, today, "2024-05-15"), (13, today, "2024-05-16"), (13, today, "2024-06-20"), (14, today, "2024-03-09"), (15, today, "2024-03-09"), (16, today, "2024-12-31"), (17, "2024-03-10", "2024-03-01"), (99, today, today)]
    rules = [(11, "no", 11, 5), (16, "closed", 12, 1)]
    histories = [(12, 170, 300)]
    readings = [(10, "2024-02-28", "live", "closed"), (13, "2024-02-28", "live", "closed", hint("closed-until", 15, 5)), (14, "2024-02-28", "live", "closed", hint("open-from", 9, 3)), (15, "2024-02-28", "live", "restricted", hint("open-from", 1, 2)), (17, "2024-03-05", "alert", "closed")]
    want = [("closed", "assumed-unchanged"), ("closed", "elevation"), ("open", "rule"), ("open", "history"), ("closed", "opening-hint"), ("open", "opening-hint"), ("open", "elevation"), ("open", "opening-hint"), ("restricted", "assumed-unchanged"), ("closed", "rule"), ("closed", "alert")]
    assert known(spark, asked, rules, histories, readings) == want


def test_layers_and_warnings_of_statuses(spark):
    stops = spark.createDataFrame([(1, i, f"P{i}", "closed" if i % 2 else "open", "rule" if i < 3 else "elevation", i >= 3, 0.1 * i) for i in range(14)], "tour_id long, ord int, name string, state string, basis string, estimated boolean, quality double")
    assert rows(status_.tour_warnings(stops), "tour_id", "n", "named") == [(1, 7, "P1;P3;P5;P7;P9")]
    assert rows(status_.pass_layer(stops, ["open"], 0.15, 0.75), "ord") == [(2,), (8,), (10,), (12,)]
    assert rows(status_.pass_layer(stops, ["open"], 0.15, None), "ord") == [(2,)]


def linked(spark, *rows_):
    """Records of (id, type, linked ids, own lists by field)."""
    kinds = ", ".join(f"{f} array<string>" for f in links.OPTIONAL)
    return spark.createDataFrame([(i, kind, f"name {i}", back, *(lists.get(f) for f in links.OPTIONAL)) for i, kind, back, lists in rows_], f"id string, entity_type string, name string, linkedEntityIds array<string>, {kinds}")


def test_references_to_what_is_not_delivered_go(spark):
    records = linked(spark, ("a", "TrailRoute", None, {"stageIds": ["c", "x", "b", "c", None], "priceIds": [], "hazardRefs": ["x"]}), ("b", "Place", None, {}))
    got = {r.id: r for r in links.pruned(records, spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "id string")).collect()}
    assert got["a"].stageIds == ["c", "b", "c"] and got["a"].priceIds == [] and got["a"].hazardRefs == [] and got["a"].variantIds is None
    assert all(got["b"][f] is None for f in links.OPTIONAL) and got["a"].name == "name a"


def test_routes_get_what_they_name_and_what_links_to_them(spark):
    records = linked(
        spark,
        ("r1", "TrailRoute", ["r2"], {"accessPointIds": ["p9", "gone", "p1", "p9"], "hazardRefs": ["p1"]}),
        ("r2", "TrailRoute", None, {}),
        ("p1", "AccessPoint", ["r1", "r2", "r1"], {}), ("p3", "AccessPoint", ["r1"], {}), ("p2", "AccessPoint", ["r1", None], {}), ("p9", "Place", ["r1"], {}),
        ("h1", "Hazard", ["r2", "p1"], {}), ("q1", "PermitRequirement", ["r2"], {}), ("s1", "TrailSegment", ["nowhere"], {}),
    )
    got = {r.id: r for r in links.attached(records, "name", "entity_type").collect()}
    assert set(got) == {"r1", "r2"}
    ids = {route: {f: [x.id for x in r[f]] for f in links.ATTACHED if r[f]} for route, r in got.items()}
    assert ids == {"r1": {"accessPoints": ["p9", "p1", "p2", "p3"], "hazards": ["p1"]}, "r2": {"accessPoints": ["p1"], "hazards": ["h1"], "permitRequirements": ["q1"]}}
    assert got["r1"].accessPoints[0].name == "name p9" and got["r1"].conditions == []


NOTICE = "route_id long, id long, position int, source string, active boolean, state string, kind string, severity string, blocking boolean, unsafe boolean, valid_from string, valid_until string"


def blocked(spark, route, *notices):
    """The code and notice of one route at 2026-07-01 10:00, which is fine but for what is given."""
    fine = {"access_state": "open", "verification": "verified", "freshness": "current", "assessed_at": "2026-06-01 00:00:00", "flags": ["official_centerline"], "sensitive": False} | route
    r = spark.createDataFrame([(1, "2026-07-01 10:00:00", *fine.values())], "id long, at string, access_state string, verification string, freshness string, assessed_at string, flags array<string>, sensitive boolean").withColumns({"at": F.to_timestamp("at"), "assessed_at": F.to_timestamp("assessed_at")})
    blank = {"source": "condition", "active": True, "state": None, "kind": None, "severity": None, "blocking": None, "unsafe": None, "valid_from": None, "valid_until": None}
    n = spark.createDataFrame([(1, 100 + i, i, *(blank | x).values()) for i, x in enumerate(notices)], NOTICE).withColumns({c: F.to_timestamp(c) for c in ("valid_from", "valid_until")})
    found = planning.route_blockers(r, n).first()
    return found.code, found.notice_id


@pytest.mark.parametrize(
    ("route", "notices", "want"),
    [
        ({}, [], (None, None)),
        ({"verification": "partially_verified", "access_state": "closed"}, [], ("route_unverified", None)),
        ({"flags": None}, [], ("route_quality_invalid", None)),
        ({"flags": ["slope_danger"], "freshness": "stale"}, [], ("unsafe_condition", None)),
        ({"freshness": "stale"}, [], ("route_quality_not_current", None)),
        ({"flags": ["parking_hours_unknown", "bridge_access_unknown"]}, [], ("route_quality_not_current", None)),
        ({"assessed_at": "2026-07-02 00:00:00"}, [], ("route_quality_invalid", None)),
        ({"assessed_at": None}, [], ("route_quality_invalid", None)),
        ({"access_state": " Private "}, [{"state": "closed"}], ("active_restriction", None)),
        ({}, [{"state": "open"}, {"kind": "trail_closure"}], ("route_closed", 101)),
        ({}, [{"state": "closed", "valid_until": "2026-07-01 09:59:59"}, {"state": "closed", "valid_from": "2026-07-01 10:00:01"}, {"state": "closed", "active": False}, {"state": "expired", "kind": "trail_closure"}], (None, None)),
        ({}, [{"state": "closed", "valid_from": "2026-07-01 10:00:00", "valid_until": "2026-07-01 10:00:00"}], ("route_closed", 100)),
        ({}, [{"kind": "avalanche"}, {"kind": "avalanche", "blocking": True}], ("unsafe_condition", 101)),
        ({}, [{"source": "restriction", "blocking": True}, {"severity": "extreme", "blocking": True}], ("unsafe_condition", 101)),
        ({}, [{"source": "restriction", "state": "closed", "blocking": False}], (None, None)),
        ({}, [{"source": "restriction", "kind": "private_land"}], ("active_restriction", 100)),
        ({}, [{"source": "restriction", "kind": "safety", "unsafe": True}], ("unsafe_condition", 100)),
        ({"flags": ["critical_condition_unknown"], "sensitive": True}, [], ("critical_condition_unknown", None)),
        ({"flags": ["critical_condition_unknown"]}, [], (None, None)),
    ],
)
def test_what_blocks_a_route(spark, route, notices, want):
    assert blocked(spark, route, *notices) == want


def test_stops_are_dealt_out_by_rows(spark, monkeypatch):
    from waymark.plans import tables

    t = tables.Tables(spark, "/root/testdata/sf0.001")
    want = rows(t.stops, "tour_id", "ord", "place_id")
    monkeypatch.setattr(tables, "ROWS", 300)
    small = tables.Tables(spark, "/root/testdata/sf0.001")
    per_task = small.stops.groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.max("count")).first()
    assert per_task[0] >= 15 and per_task[1] < 900 and rows(small.stops, "tour_id", "ord", "place_id") == want
    assert small.stops.rdd.getNumPartitions() == small.parts("lineitem") == -(-len(want) // 300)
    op = routes.agg_retrace_counts.text
    assert small.sql(op).rdd.getNumPartitions() == small.parts("lineitem") and rows(small.sql(op), "tour_id", "retraced") == rows(t.sql(op), "tour_id", "retraced")


def test_rows_shown_for_tours_meet_once(spark):
    from waymark.operators import shapes

    stops = spark.createDataFrame([(1, 1, 10), (1, 2, 99), (1, 3, 11), (2, 1, 10), (3, 1, 99)], "tour_id long, ord int, place_id long")
    places = spark.createDataFrame([(10, "ten", "c"), (11, "eleven", None)], "id long, name string, category string")
    tours = spark.createDataFrame([(1, False, "from", "to"), (2, True, "from", "to"), (3, False, "from", "to"), (4, None, "from", "to")], "tour_id long, closed boolean, start_name string, end_name string")
    breaks = spark.createDataFrame([(1, 1.4), (1, 9.0), (2, -5.0), (3, 1.0), (9, 1.0)], "tour_id long, position double")
    got = shapes.display_stops(stops, places, tours, breaks, 7)
    want = [(1, "start", "from"), (1, "stop", "ten"), (1, "break", None), (1, "stop", "eleven"), (1, "break", None), (1, "end", "to"), (2, "stop", "ten"), (2, "break", None)]
    assert [(r.tour_id, r.role, r.name) for r in got.orderBy("tour_id", "row").collect()] == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(tour_id" in plan.replace("#", " ").replace("tour_id ", "tour_id") and plan.count("REPARTITION_BY_NUM") == 1


def test_alerts_meet_the_elevations_of_an_alias_and_not_its_passes(spark):
    rng = random.Random(5)
    names = ["Alpha Pass", "Beta / Alpha", "Gamma - Beta", "Gammá", "none"]
    some = lambda n: [(i, rng.choice(names), rng.choice([None, *range(500, 2500, 37)])) for i in range(n)]
    alerts, passes = some(300), some(60)
    schema = "id long, name string, elev int"
    forms = {r.name: set(r.a) for r in spark.createDataFrame([(n,) for n in names], "name string").select("name", feeds.aliases(F.col("name")).alias("a")).collect()}
    want = []
    for i, name, elev in alerts:
        near = [(0 if elev is None or e is None else abs(elev - e), p) for p, n, e in passes if forms[n] & forms[name]]
        if near and min(near)[0] <= 200:
            want.append((i, *reversed(min(near))))
    got = feeds.alias_alerts(spark.createDataFrame(alerts, schema), spark.createDataFrame(passes, schema))
    assert rows(got, "id", "pass_id", "gap") == want and len(want) > 100
    # half a billion pairs of one alias: one row for each alert, without listing the pairs
    many = spark.range(22_000).selectExpr("id", "'Alpha' AS name", "cast(1000 + id % 900 as int) AS elev")
    assert feeds.alias_alerts(many, many).where("gap = 0 and pass_id = id % 900").count() == 22_000


def test_passes_of_the_same_bases_are_one_class(spark):
    rng = random.Random(6)
    spots = [(46 + rng.randrange(12) / 50, 7 + rng.randrange(12) / 50) for _ in range(25)] + [(None, 7.0), (10.0, 179.99), (10.0, -179.99)]
    bases = [(i, *rng.choice(spots)) for i in range(70) for _ in range(i % 3)]
    df = spark.createDataFrame(bases, "pass_id long, lat double, lon double")
    pairs = df.crossJoin(df.selectExpr("pass_id AS b", "lat AS lat2", "lon AS lon2")).where("pass_id < b").withColumn("m", spatial.distance_m("lat", "lon", "lat2", "lon2")).where("m <= 5000")
    want = pairs.groupBy(F.col("pass_id").alias("a"), "b").agg(F.min(F.floor(F.col("m") + 0.5)).alias("metres"))
    assert rows(spatial.shared_gateways(df), "a", "b", "metres") == rows(want, "a", "b", "metres") and want.count() > 50


def test_needs_for_lunch_against_each_leg_looked_through(spark):
    rng = random.Random(8)
    legs = [(t, i + 1, rng.choice([0, 300, 450, 900, 4000]), rng.choice([0, 900]), round(rng.random(), 1), rng.choice([0, 799, 800, 1200])) for t in range(60) for i in range(1 + t % 7)]
    edges = spark.createDataFrame(legs, "tour_id long, ord int, duration_s long, dwell_s long, scenic double, gain_m long")
    want = []
    for t in range(60):
        at, es = 0, []
        for _, _, d, _, scenic, gain in legs[sum(1 + x % 7 for x in range(t)) :][: 1 + t % 7]:
            es.append((at, at + d, scenic, gain))
            at += d
        threshold = sorted(e[2] for e in es)[math.floor((len(es) - 1) * 0.9)]
        for step, s in enumerate([*range(0, max(at, 1), 300), at]):
            here = next(e for e in es if e[0] <= s <= e[1])
            need = math.exp(-0.5 * ((480 + s // 60 - 750) / 30.0) ** 2) + max(0.0, min(1.0, (s / 3600 - 4) / 2)) * 0.55
            need += 0.3 if any(e[3] >= 800 and e[1] <= s <= e[1] + 2700 for e in es) else 0.0
            want.append((t, step, s, math.floor(max(0.0, need + (-0.2 if here[2] >= threshold else 0.0)) * 10**4 + 0.5) / 10**4))
    curve = drives.hunger_curve(drives.segmented(edges))
    assert rows(curve, "tour_id", "step", "t_sec", "need") == sorted(want)
    assert "lambda" not in curve._jdf.queryExecution().optimizedPlan().toString()  # samples are rows, legs are not looked through for each


def test_places_around_a_position_are_found_once(spark):
    rng = random.Random(9)
    spots = [(10 + rng.randrange(40) / 100, 20 + rng.randrange(40) / 100) for _ in range(20)] + [(10.0, 179.99), (10.0, -179.99)]
    places = [(i, 5.0, ["restaurant"], "food" if i < 3 else "nature", *rng.choice(spots)) for i in range(40)]
    track = [(t, o, 900.0 * o, 0, 0.0, *rng.choice(spots)) for t in range(30) for o in range(1, 4)]
    p = spark.createDataFrame(places, "id long, score double, categories array<string>, family string, lat double, lon double")
    v = spark.createDataFrame(track, "tour_id long, ord int, t_sec double, place_id long, scenic double, lat double, lon double")
    far = v.crossJoin(p.selectExpr("id", "family", "lat AS r_lat", "lon AS r_lon")).withColumn("m", spatial.distance_m("lat", "lon", "r_lat", "r_lon"))
    segments = v.selectExpr("tour_id", "ord", "0L AS segment", "1000L AS distance_m").unionByName(v.limit(0).selectExpr("tour_id", "ord", "0L AS segment", "1000L AS distance_m"))
    want = {r.tour_id: r.n for r in far.where("m <= 5000 and ord <> 2").groupBy("tour_id").agg(F.count_distinct("id").alias("n")).collect()}
    got = {r.tour_id: r.places for r in drives.segment_density(p, segments, v).collect()}
    assert got == {t: want.get(t, 0) for t in range(30)} and any(want.values())
    windows = v.select("tour_id").distinct().selectExpr("tour_id", "900L AS from_s", "1800L AS to_s", "900L AS peak_s")
    fed = drives.fed_tours(p, v, windows)
    assert rows(fed, "tour_id") == rows(drives.lunch_candidates(p, v, windows).select("tour_id").distinct(), "tour_id") and 0 < fed.count() < 30


def test_clusters_pass_nothing_through_the_driver(spark, monkeypatch):
    plans, own = [], routes.written

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return own(df)

    monkeypatch.setattr(routes, "written", kept)
    items = spark.range(3_000).selectExpr("id", "7 + (id * 37 % 101) / 40 AS lon", "46 + (id * 53 % 97) / 40 AS lat")
    got = routes.overlay_clusters(items)
    assert got.agg(F.sum("n")).first()[0] == 3_000 and len(plans) > 5 and not any("Broadcast" in p for p in plans)


def test_lunch_zones_take_places_of_a_position_at_once(spark, monkeypatch):
    rng = random.Random(12)
    spots = [(46 + rng.randrange(60) / 200, 8 + rng.randrange(60) / 200) for _ in range(25)]
    kinds = [["food", "restaurant"], ["food", "cafe", "cafe"], ["food", "mountain-hut"], [], None]
    places = [(i, rng.choice([None, 2.0, 4.0, 9.0]), rng.choice(kinds), "food" if i % 7 else "nature", *rng.choice(spots)) for i in range(200)]
    track = [(t, o, 900 * o, round(rng.random(), 1), *rng.choice(spots)) for t in range(20) for o in range(1, 5)]
    p = spark.createDataFrame(places, "id long, score double, categories array<string>, family string, lat double, lon double")
    v = spark.createDataFrame(track, "tour_id long, ord int, t_sec long, scenic double, lat double, lon double")
    windows = v.select("tour_id").distinct().selectExpr("tour_id", "900L AS from_s", "2700L AS to_s", "1800L AS peak_s")
    segments = v.selectExpr("tour_id", "scenic", "'connector' AS kind", "t_sec AS end_s")
    one, each = drives.lunch_spots(p, v, windows), drives.lunch_candidates(p, v, windows)
    names = ("tour_id", "zone", "n", "lat", "lon", "score", "entropy", "arrive_from_s", "arrive_to_s", "vibe", "role")
    got = drives.lunch_zones(one, segments)
    assert sorted(map(str, rows(got, *names))) == sorted(map(str, rows(drives.lunch_zones(each, segments), *names))) and got.count() > 20
    assert one.groupBy("tour_id", "lat", "lon").count().where("count > 1").count() == 0 and one.count() * 3 < each.count() == one.agg(F.sum("n")).first()[0]
    # components of each array equal a plain search, wherever the pairs are cut
    monkeypatch.setattr(drives, "PAIRS", 50)
    arrays = [[rng.choice(spots) for _ in range(rng.choice([0, 1, 2, 9, 20]))] for _ in range(30)]
    found = drives._roots(4_000.0).func(*(pa.array([[x[k] for x in xs] for xs in arrays], pa.list_(pa.float64())) for k in (0, 1))).to_pylist()
    for xs, roots in zip(arrays, found, strict=True):
        want = list(range(len(xs)))
        for _ in xs:
            want = [min(want[j] for j, y in enumerate(xs) if 2 * 6371e3 * math.asin(math.sqrt(math.sin(math.radians(y[0] - x[0]) / 2) ** 2 + math.cos(math.radians(x[0])) * math.cos(math.radians(y[0])) * math.sin(math.radians(y[1] - x[1]) / 2) ** 2)) <= 4000) for x in xs]
        assert roots == want


def test_corridor_counts_and_leftovers_equal_those_of_all_tiers(spark):
    rng = random.Random(13)
    spots = [(46 + rng.randrange(40) / 1000, 8 + rng.randrange(40) / 1000) for _ in range(12)]
    places = [(i, float(rng.randrange(11)), rng.choice([["food", "cafe"], ["nature", "viewpoint"], ["museum"]]), *rng.choice(spots)) for i in range(150)]
    track = [(t, o, 1500 * o, bool(o % 2), rng.randrange(200), *rng.choice(spots)) for t in range(15) for o in range(1, 5)]
    p = spark.createDataFrame(places, "id long, score double, categories array<string>, lat double, lon double")
    v = spark.createDataFrame(track, "tour_id long, ord int, t_sec long, on_climb boolean, place_id long, lat double, lon double")
    own = {(t[0], t[4]) for t in track}
    ranked = drives.ranked_corridor(p, v, themes=("viewpoint",))
    assert ranked.count() > 100 and not own & set(rows(ranked, "tour_id", "poi"))
    told = drives.tiers(ranked)
    want = told.groupBy("tour_id").agg(F.count_if(F.col("tier") == "auto").alias("auto"), F.count_if(F.col("tier") == "suggestion").alias("suggestions"))
    assert rows(drives.tier_counts(p, v), "tour_id", "auto", "suggestions") == rows(want, "tour_id", "auto", "suggestions")
    kept = drives.hour_fairness(told.where("tier = 'auto'"))
    left = rows(kept.where("not kept"), "tour_id", "poi") + rows(told.where("tier = 'suggestion'"), "tour_id", "poi")
    few = drives.left_over(drives.ranked_corridor(p, v, themes=("viewpoint",), least=6.0))
    assert rows(few, "tour_id", "poi") == sorted(left)
    picked, pool = {}, {}
    for r in few.collect():
        pool.setdefault(r.tour_id, []).append(r)
    for t, xs in pool.items():
        for place in range(1, 4):
            like = lambda x: max([len({*x.categories} & {*y.categories}) / len({*x.categories} | {*y.categories}) for y in picked.get(t, [])], default=0.0)
            left = [x for x in xs if x not in picked.get(t, [])]
            if left:
                picked.setdefault(t, []).append(min(left, key=lambda x: (round(-x.rank_score + like(x) * 2.5, 9), -x.rank_score, -x.score, x.detour, x.ord, x.poi)))
    assert rows(routes.mmr(few, 3), "tour_id", "place", "poi") == sorted((t, i + 1, x.poi) for t, xs in picked.items() for i, x in enumerate(xs))
