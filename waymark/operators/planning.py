"""Whether a route can be planned for a moment: ordered rules over its record and the notices that are in force then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quality flags that block planning, and those that only advise.
BLOCKING_FLAGS = (
    "access_unknown border_conditions_unknown conditions_unknown critical_access_unknown critical_condition_unknown generalized_geometry generalized_position legal_access_unknown not_navigation_grade operation_unknown overview_geometry_only"
    " parking_rules_unknown reservation_status_unknown route_geometry_missing schedule_unknown sensitivity_not_assessed stopping_permission_unknown transport_schedule_unknown transport_stop_unknown"
).split()
ADVISORY_FLAGS = "current_conditions_require_local_verification current_road_status_requires_local_verification official_centerline parking_capacity_unknown parking_centroid_not_surveyed parking_fee_unknown parking_hours_unknown source_geometry_surveyed_2016".split()
#: Words of a flag that tell of danger, of age, of something unknown, and what must not be unknown.
UNSAFE_WORDS = "unsafe danger hazard closed closure blocked prohibited".split()
OLD_WORDS = "stale expired unverified conflict".split()
UNKNOWN_WORDS = "unknown unverified".split()
SENSITIVE_WORDS = "legal access stopping operation schedule transport condition conditions avalanche fire flood hazard reservation sensitivity navigation geometry".split()
#: Kinds of condition that close a route, and those that make it unsafe where they block.
CLOSING_KINDS = ("road_closure", "trail_closure", "seasonal_gate")
DANGEROUS_KINDS = ("fire", "avalanche", "flood", "volcanic", "emergency")
CRITICAL = "critical_condition_unknown"


def _holds(flag: Column, words: list[str]) -> Column:
    return F.arrays_overlap(F.split(flag, "_"), F.array(*map(F.lit, words)))


def _folded(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def unsafe_flag(flag: Column) -> Column:
    return _holds(_folded(flag), UNSAFE_WORDS)


def blocking_flag(flag: Column) -> Column:
    """Whether a quality flag forbids planning: a known one, or by its words; advice never does."""
    f = _folded(flag)
    return (f != "") & ~f.isin(*ADVISORY_FLAGS) & (f.isin(*BLOCKING_FLAGS) | unsafe_flag(f) | _holds(f, OLD_WORDS) | (_holds(f, UNKNOWN_WORDS) & _holds(f, SENSITIVE_WORDS)))


def notice_code() -> Column:
    """What an active notice(source, state, kind, severity, blocking, unsafe) says against a route; null for nothing. Of
    restrictions those that do not block say nothing, and any that blocks says at least that access is restricted."""
    state, kind = _folded(F.col("state")), _folded(F.col("kind"))
    blocks, is_unsafe = F.coalesce("blocking", F.lit(False)), F.coalesce("unsafe", F.lit(False))
    danger = is_unsafe | (blocks & (_folded(F.col("severity")).isin("high", "extreme") | kind.isin(*DANGEROUS_KINDS)))
    condition = F.when((state == "closed") | kind.isin(*CLOSING_KINDS), "route_closed").when(state.isin("forbidden", "private"), "active_restriction").when((state == "unsafe") | danger, "unsafe_condition")
    restriction = F.when(F.col("blocking") == F.lit(False), None).when(state == "closed", "route_closed").when((state == "unsafe") | ((kind == "safety") & danger), "unsafe_condition").when(blocks | state.isin("forbidden", "private") | (kind == "private_land"), "active_restriction")
    return F.when(F.col("source") == "condition", condition).otherwise(restriction)


def in_force(at: Column) -> Column:
    """Of notices(active, state, valid_from, valid_until): whether they hold at a moment; open ends hold for ever."""
    return F.coalesce("active", F.lit(True)) & (F.coalesce("state", F.lit("")) != "expired") & F.coalesce(at >= F.col("valid_from"), F.lit(True)) & F.coalesce(at <= F.col("valid_until"), F.lit(True))


def route_blockers(routes: DataFrame, notices: DataFrame) -> DataFrame:
    """routes(id, at, access_state, verification, freshness, assessed_at, flags, sensitive) with code and notice_id: the first
    reason why a route can't be planned at its time, and the notice that gives it; null for those that can.

    Rules in order: the record's quality, its access state, conditions and then restrictions of notices(route_id, id,
    position, source, active, state, kind, severity, blocking, unsafe, valid_from, valid_until) that are in force, by
    position, then an unknown critical condition of a safety-sensitive route. Only what each rule finds is grouped, and
    the least by order is kept before the shuffle, so a route with any number of notices is no burden to one task."""
    r = routes.select("id", "at", "access_state", "verification", "freshness", "assessed_at", "flags", "sensitive")
    state = _folded(F.col("access_state"))
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    old = F.exists(flags, lambda f: (f != CRITICAL) & blocking_flag(f))
    of_record = [
        ("route_unverified", 0, ~F.coalesce(F.col("verification") == "verified", F.lit(False))),
        ("route_quality_invalid", 1, F.col("flags").isNull()),
        ("unsafe_condition", 2, F.exists(flags, unsafe_flag)),
        ("route_quality_not_current", 3, ~F.coalesce(F.col("freshness") == "current", F.lit(False)) | old),
        ("route_quality_invalid", 4, F.coalesce(F.col("assessed_at") > F.col("at"), F.lit(True))),
        ("route_closed", 5, state == "closed"),
        ("active_restriction", 6, state.isin("forbidden", "private")),
        ("unsafe_condition", 7, state == "unsafe"),
        (CRITICAL, 10, F.array_contains(flags, CRITICAL) & F.coalesce("sensitive", F.lit(False))),
    ]
    nothing = F.lit(None).cast("long")
    found = [F.when(holds, F.struct(F.lit(order).alias("rule"), F.lit(0).cast("long").alias("position"), nothing.alias("notice_id"), F.lit(code).alias("code"))) for code, order, holds in of_record]
    own = r.select("id", F.array_min(F.array_compact(F.array(*found))).alias("first")).where("first is not null")
    said = notices.withColumn("__code", notice_code()).where("__code is not null").select(F.col("route_id").alias("id"), F.col("id").alias("notice_id"), "position", "source", "active", "state", "valid_from", "valid_until", "__code")
    met = r.select("id", "at").join(said.hint("merge"), "id").where(in_force(F.col("at")))
    of_notice = F.struct(F.when(F.col("source") == "condition", 8).otherwise(9).alias("rule"), F.col("position").cast("long").alias("position"), F.col("notice_id").cast("long").alias("notice_id"), F.col("__code").alias("code"))
    first = own.unionByName(met.select("id", of_notice.alias("first"))).groupBy("id").agg(F.min("first").alias("first"))
    return routes.join(first.hint("merge"), "id", "left").select(*routes.columns, F.col("first.code").alias("code"), F.col("first.notice_id").alias("notice_id"))
