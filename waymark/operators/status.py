"""Pass status: rules, histories, projections, alerts and the feeds' precedence."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.sql import haversine
from waymark.operators import define

IN_RANGE = "CASE WHEN {a} <= {b} THEN m BETWEEN {a} AND {b} ELSE m >= {a} OR m <= {b} END"
SEASON_FROM = "CASE WHEN elev < 1300 THEN 1 WHEN elev < 1700 THEN 4 WHEN elev < 2100 THEN 5 ELSE 6 END"
SEASON_TO = "CASE WHEN elev < 1300 THEN 12 WHEN elev < 1700 THEN 11 ELSE 10 END"
RULE = f"CASE WHEN closes IS NULL THEN NULL WHEN {IN_RANGE.format(a='closes', b='opens')} THEN 'closed' ELSE 'open' END"
ELEVATION = f"CASE WHEN m BETWEEN {SEASON_FROM} AND {SEASON_TO} THEN 'open' ELSE 'closed' END"
#: Every pass in every month.
PASS_MONTHS = "(SELECT *, UNNEST(SEQ(1, 12)) AS m FROM {passes})"

status_rules = define(
    "status_rules", "Status of every pass in every month: closure rule (ranges wrap the year), else season by elevation.",
    f"SELECT id, CAST(m AS BIGINT) AS month, coalesce({RULE}, {ELEVATION}) AS state, closes IS NULL AS estimated FROM {PASS_MONTHS} p",
)

flt_season_closed = define("flt_season_closed", "Passes of each nation above 1,700 m, closed from November to April, and how many are open.", f"SELECT nation, CAST(m AS BIGINT) AS month, count_if((m >= 11 OR m <= 4) AND elev > 1700) AS closed, count_if(NOT ((m >= 11 OR m <= 4) AND elev > 1700)) AS open FROM {PASS_MONTHS} p GROUP BY nation, m")

flt_seasonal_edges = define("flt_seasonal_edges", "Stops whose summer-only edge may be used on the day, 15 May to 31 October.", "SELECT tour_id, ord FROM {stops} WHERE kind = 'connector' OR EXTRACT(MONTH FROM day) * 100 + EXTRACT(DAY FROM day) BETWEEN 515 AND 1031")

history_status = define(
    "history_status", "Historical state of each pass on each month's first day, from typical open and close days.",
    f"SELECT id, CAST(m AS BIGINT) AS month, CASE WHEN open_day <= close_day THEN (m - 1) * 30 + 1 BETWEEN open_day AND close_day ELSE (m - 1) * 30 + 1 >= open_day OR (m - 1) * 30 + 1 <= close_day END AS is_open FROM {PASS_MONTHS} p WHERE open_day IS NOT NULL",
)

LATEST = "(SELECT pass_id, max_by(state, ARR(EPOCH_US(ts), id)) AS state, max_by(source, ARR(EPOCH_US(ts), id)) AS source, max(EPOCH_US(ts)) AS seen FROM {statuses} GROUP BY pass_id)"

#: Days for which a reading is taken to hold, or an announced opening to be near.
HORIZON = 31
CLOSURES = ("no", "private", "closed")


def _month_within(month: Column, first: Column, last: Column) -> Column:
    return F.when(first <= last, month.between(first, last)).otherwise((month >= first) | (month <= last))


def rule_states(asked: DataFrame, rules: DataFrame, day: str) -> DataFrame:
    """asked(pass_id, ...) with rule_state: by closure rules(pass_id, value, from_month, to_month) closed in any of their months,
    which may wrap the year, else open; null without one."""
    # a row for each pass: the months in which it is closed
    months = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.when(_month_within(m, F.col("from_month"), F.col("to_month")), m))
    shut = rules.where(F.col("value").isin(*CLOSURES) & F.col("from_month").isNotNull() & F.col("to_month").isNotNull()).select("pass_id", F.explode(months).alias("m"))
    by_pass = shut.groupBy("pass_id").agg(F.collect_set("m").alias("__shut"))
    told = asked.join(by_pass.hint("merge"), "pass_id", "left")
    return told.withColumn("rule_state", F.when(F.col("__shut").isNotNull(), F.when(F.array_contains("__shut", F.month(day)), "closed").otherwise("open"))).drop("__shut")


def elevation_state(elev: Column, day: Column) -> Column:
    """The season that is usual at an elevation."""
    month = F.month(day)
    first = F.when(elev < 1300, 1).when(elev < 1700, 4).when(elev < 2100, 5).otherwise(6)
    last = F.when(elev < 1300, 12).when(elev < 1700, 11).otherwise(10)
    return F.when(month.between(first, last), "open").otherwise("closed")


def history_state(day: Column) -> Column:
    """Of typical days of the year open_doy and close_doy, which may wrap the year; null without them."""
    doy = F.dayofyear(day)
    within = F.when(F.col("open_doy") <= F.col("close_doy"), doy.between(F.col("open_doy"), F.col("close_doy"))).otherwise((doy >= F.col("open_doy")) | (doy <= F.col("close_doy")))
    return F.when(F.col("open_doy").isNotNull() & F.col("close_doy").isNotNull(), F.when(within, "open").otherwise("closed"))


def _readings_as_of(asked: DataFrame, readings: DataFrame) -> DataFrame:
    """asked(pass_id, today) with the last live and the last alert reading up to the end of each day. Readings become one row
    for each pass, source and day first, so that what is looked through for a pass are days and not readings."""
    day = F.to_date("ts").alias("today")
    reading = F.struct("state", "hint_kind", "hint_day", "hint_month", "hint_year")
    last = lambda source: F.max_by(F.when(F.col("source") == source, reading), F.when(F.col("source") == source, F.struct("ts", "id"))).alias(source)
    daily = readings.where(F.col("source").isin("live", "alert")).groupBy("pass_id", day).agg(last("live"), last("alert")).withColumn("__asks", F.lit(False))
    both = daily.unionByName(asked.select("pass_id", "today").distinct().withColumn("__asks", F.lit(True)), allowMissingColumns=True)
    so_far = Window.partitionBy("pass_id").orderBy("today", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.select("pass_id", "today", "__asks", F.last("live", True).over(so_far).alias("live"), F.last("alert", True).over(so_far).alias("alert")).where("__asks").drop("__asks")


def pass_status(asked: DataFrame, passes: DataFrame, rules: DataFrame, histories: DataFrame, readings: DataFrame) -> DataFrame:
    """asked(pass_id, today, day, ...) with state, basis, estimated: the status of a pass on a day as known today.

    passes(id, elev); rules(pass_id, value, from_month, to_month); histories(pass_id, open_doy, close_doy); readings(id,
    pass_id, ts, source, state, hint_kind, hint_day, hint_month, hint_year), of which the last one of a source counts.
    Today (and before) a live reading goes before an alert that says anything, then a closure rule, then history, then
    the elevation's season. For a later day an announced opening (hint) decides, up to 31 days after it; then today's
    rule; then a live state that is known, for 31 days; then rule, history and elevation of that day. A hint without a
    year means the day's year; an open-from date that has passed today says nothing. Unknown passes give nothing."""
    known = asked.join(passes.select(F.col("id").alias("pass_id"), F.col("elev").alias("__elev")).hint("merge"), "pass_id")
    known = known.join(histories.select("pass_id", "open_doy", "close_doy").hint("merge"), "pass_id", "left")
    known = known.join(_readings_as_of(asked, readings).hint("merge"), ["pass_id", "today"], "left")
    known = rule_states(rule_states(known, rules, "today").withColumnRenamed("rule_state", "__rule_today"), rules, "day").withColumnRenamed("rule_state", "__rule_day")
    live, alert = F.col("live.state"), F.when(F.col("alert.state") != "unknown", F.col("alert.state"))
    first = lambda day, rule: (F.col(rule), history_state(F.col(day)), elevation_state(F.col("__elev"), F.col(day)))
    rule, history, season = first("today", "__rule_today")
    now = F.coalesce(live, alert, rule, history, season)
    now_basis = F.when(live.isNotNull(), "live").when(alert.isNotNull(), "alert").when(rule.isNotNull(), "rule").when(history.isNotNull(), "history").otherwise("elevation")
    said = F.when(live.isNotNull(), F.col("live")).otherwise(F.when(alert.isNotNull(), F.col("alert")))
    date = F.expr("try_make_timestamp(coalesce(__said.hint_year, year(day)), __said.hint_month, __said.hint_day, 0, 0, 0)").cast("date")
    known = known.withColumns({"__now": now, "__basis": now_basis, "__said": said}).withColumn("__date", date)
    past = F.datediff("day", "__date")
    kind = F.col("__said.hint_kind")
    opened = F.when(kind == "closed-until", past > 0).otherwise(past >= 0)
    hinted = F.when(F.col("__date").isNotNull() & ~((kind == "open-from") & (F.col("__date") < F.col("today"))) & ~(opened & (past > HORIZON)), F.when(opened, "open").otherwise("closed"))
    rule, history, season = first("day", "__rule_day")
    ahead = F.datediff("day", "today")
    unchanged = F.when((F.col("__basis") == "live") & F.col("__now").isin("open", "restricted", "closed") & (ahead <= HORIZON), F.col("__now"))
    of_rule = F.when(F.col("__basis") == "rule", rule)
    state = F.when(ahead <= 0, F.col("__now")).otherwise(F.coalesce(hinted, of_rule, unchanged, rule, history, season))
    basis = F.when(ahead <= 0, F.col("__basis")).when(hinted.isNotNull(), "opening-hint").when(of_rule.isNotNull(), "rule").when(unchanged.isNotNull(), "assumed-unchanged").when(rule.isNotNull(), "rule").when(history.isNotNull(), "history").otherwise("elevation")
    out = known.withColumns({"state": state, "basis": basis})
    return out.select(*asked.columns, "state", "basis", F.col("basis").isin("history", "elevation", "assumed-unchanged").alias("estimated"))


def pass_layer(statuses: DataFrame, states: list[str], least_quality: float = 0.0, estimates: float | None = 0.0) -> DataFrame:
    """Of pass_status(), with quality, what a map layer shows: the wanted states from a quality on, estimated ones from a
    quality of their own on (None: not at all)."""
    fine = F.lit(False) if estimates is None else F.col("quality") >= estimates
    return statuses.where(F.col("state").isin(*states) & (F.col("quality") >= least_quality) & (~F.col("estimated") | fine))


def tour_warnings(stops: DataFrame, most: int = 5) -> DataFrame:
    """Of pass_status() of stops(tour_id, ord, name): for each tour how many lie on passes that are closed on their day, and
    the first of their names."""
    shut = stops.where("state = 'closed'").withColumn("__nth", F.row_number().over(Window.partitionBy("tour_id").orderBy("ord")))
    names = F.array_sort(F.collect_list(F.when(F.col("__nth") <= most, F.struct("__nth", "name"))))
    return shut.groupBy("tour_id").agg(F.count("*").alias("n"), F.array_join(F.transform(names, lambda x: x["name"]), ";").alias("named"))


stream_twin_latest = define("status_latest", "Latest status of each pass, live rows older than a day marked stale.", f"SELECT pass_id, state, source, seen, source = 'live' AND seen < (SELECT max(EPOCH_US(ts)) FROM {{statuses}}) - 864e8 AS stale FROM {LATEST} l")
