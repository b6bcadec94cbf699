"""References between records: lists cut to what is delivered, and records nested into those that they belong to.

Both work on one long table of (record, field, place, reference), joined once with the records that are referred to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lists of references that a record may lose.
OPTIONAL = ("accessPointIds", "transportConnectionIds", "priceIds", "stageIds", "variantIds", "segmentIds", "restrictionRefs", "hazardRefs", "conditionRefs", "permitRequirementIds", "openingScheduleIds")
#: What a route gets attached, from which of its lists, and of which type if they link to it themselves.
ATTACHED = {
    "accessPoints": ("accessPointIds", "AccessPoint"),
    "transportConnections": ("transportConnectionIds", "TransportConnection"),
    "trailSegments": ("segmentIds", "TrailSegment"),
    "hazards": ("hazardRefs", "Hazard"),
    "conditions": ("conditionRefs", "Condition"),
    "restrictions": ("restrictionRefs", "Restriction"),
    "permitRequirements": ("permitRequirementIds", "PermitRequirement"),
}
ROUTE = "TrailRoute"


def references(records: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(id, field, at, ref) for each reference in the lists of records; fields: by the field's name the list's column."""
    lists = F.array(*[F.struct(F.lit(name).alias("field"), F.col(column).alias("refs")) for name, column in fields.items()])
    long = records.select("id", F.explode(lists).alias("x")).select("id", "x.field", F.posexplode("x.refs").alias("at", "ref"))
    return long.where("ref is not null")


def _of(field: str, held: str) -> Column:
    """The entries of a field among held, arrays of (field, at, ...), in order."""
    return F.array_sort(F.filter(F.coalesce(F.col(held), F.array()), lambda x: x["field"] == field))


def pruned(records: DataFrame, delivered: DataFrame, fields: tuple[str, ...] = OPTIONAL) -> DataFrame:
    """records(id, lists...) in which the lists hold references to delivered(id) only, in their order. Null lists stay null,
    others may become empty; records need ids of their own."""
    kept = references(records, {f: f for f in fields}).join(delivered.select(F.col("id").alias("ref")).distinct().hint("merge"), "ref", "left_semi")
    held = kept.groupBy("id").agg(F.collect_list(F.struct("field", "at", "ref")).alias("__kept"))  # as many as the record held itself
    out = records.join(held.hint("merge"), "id", "left")
    return out.withColumns({f: F.when(F.col(f).isNotNull(), F.transform(_of(f, "__kept"), lambda x: x["ref"])) for f in fields}).select(*records.columns)


def children(records: DataFrame) -> DataFrame:
    """(parent, field, at, child) of records(id, entity_type, linkedEntityIds, lists...): what each route's lists name, in their
    order, then the records of the seven types that link to the route, in order of id; each child once in a field."""
    routes = records.where(F.col("entity_type") == ROUTE)
    own = references(routes, {name: column for name, (column, _) in ATTACHED.items()}).select(F.col("id").alias("parent"), "field", F.col("at").cast("long").alias("at"), F.col("ref").alias("child"))
    field = F.create_map(*[F.lit(x) for name, (_, kind) in ATTACHED.items() for x in (kind, name)])
    back = records.where(F.col("entity_type").isin(*[kind for _, kind in ATTACHED.values()])).select(F.explode(F.array_distinct("linkedEntityIds")).alias("parent"), field[F.col("entity_type")].alias("field"), F.lit(1 << 40).alias("at"), F.col("id").alias("child"))
    back = back.where("parent is not null and child is not null").join(routes.select(F.col("id").alias("parent")).distinct().hint("merge"), "parent", "left_semi")
    return own.unionByName(back.select("parent", "field", "at", "child")).groupBy("parent", "field", "child").agg(F.min("at").alias("at"))


def attached(records: DataFrame, *document: str) -> DataFrame:
    """Every route of records with seven lists of children, each a struct of id and the document's columns; names that no
    record has are left out. A route is one row, so it must hold what belongs to it; children() is the same as rows."""
    known = records.select(F.col("id").alias("child"), F.struct("id", *document).alias("doc"))
    met = children(records).join(known.hint("merge"), "child")
    held = met.groupBy(F.col("parent").alias("id")).agg(F.collect_list(F.struct("field", "at", "child", "doc")).alias("__held"))
    routes = records.where(F.col("entity_type") == ROUTE).join(held.hint("merge"), "id", "left")
    return routes.withColumns({name: F.transform(_of(name, "__held"), lambda x: x["doc"]) for name in ATTACHED}).select(*records.columns, *ATTACHED)
