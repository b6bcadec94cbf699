"""Writing packages, tables and route exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.ranges import running
from waymark.functions.rounds import new_path, written


def byte_shards(items: DataFrame, budget: int | Column) -> DataFrame:
    """items(region, id, bytes), ids unique in a region, with shard and oversized: each shard takes items in order of id as
    long as they fit in the budget (a number, or a column that is equal in a region); an item over it has a shard of its
    own, marked.

    Running byte sums give every item the first one that would not fit in a shard that begins with it. From each region's
    first item these pointers lead from shard to shard; round by round they double, and the shards found so far find as
    many more. So a region may be all rows, and ids may lie as they like."""
    room = budget if isinstance(budget, Column) else F.lit(budget)
    items = items.select("region", "id", F.col("bytes").cast("long").alias("bytes"), room.cast("long").alias("room"))
    items = written(running(items, ["region"], ["id"], n=F.lit(1), begins=F.col("bytes")))
    # item ends and budget ends on one line: how many items end before or where the budget of a shard from here does
    ends = items.select("region", "n", (F.col("begins") + F.col("bytes")).alias("at"), F.lit(0).alias("kind"))
    marks = ends.unionByName(items.select("region", "n", (F.col("begins") + F.col("room")).alias("at"), F.lit(1).alias("kind")))
    told = running(marks, ["region"], ["at", "kind", "n"], ended=F.when(F.col("kind") == 0, 1).otherwise(0)).where("kind = 1")
    pointers = written(told.select("region", "n", F.greatest("ended", F.col("n") + 1).alias("to")))
    starts, step = written(items.where("n = 0").select("region", "n", F.lit(0).cast("long").alias("shard"))), 1
    while True:
        s, p = starts.alias("s"), pointers.alias("p")
        more = written(s.join(p.hint("merge"), F.expr("s.region <=> p.region and s.n = p.n")).select("s.region", F.col("p.to").alias("n"), (F.col("s.shard") + step).alias("shard")))
        if not more.limit(1).count():
            break
        starts = written(starts.unionByName(more))
        q = pointers.alias("q")
        pointers = written(p.join(q.hint("merge"), F.expr("p.region <=> q.region and p.to = q.n")).select("p.region", "p.n", "q.to"))
        step *= 2
    i, s = items.alias("i"), starts.select("region", "n").alias("s")
    marked = i.join(s.hint("merge"), F.expr("i.region <=> s.region and i.n = s.n"), "left").select("i.*", F.col("s.n").isNotNull().cast("int").alias("new"))
    out = running(marked, ["region"], ["n"], shards=F.col("new"))
    return out.select("region", "id", "bytes", (F.col("shards") + F.col("new") - 1).alias("shard"), (F.col("bytes") > F.col("room")).alias("oversized"))


def _head(index: str, count: str) -> Column:
    """A package document up to its entities."""
    known = F.to_json(F.struct(F.lit("1.0.0").alias("schemaVersion"), F.lit("region-package").alias("artifactType"), F.col("region").alias("regionId"), F.col(index).alias("shardIndex"), F.col(count).alias("shardCount")))
    return F.concat(known.substr(F.lit(1), F.length(known) - 1), F.lit(',"entities":['))


def packages(items: DataFrame, budget: int) -> DataFrame:
    """items(region, id, document): the records' JSON, packed in order of id into documents of at most budget bytes, their
    own. Each document is written to its region's partition; returned are region, shard, n, hash (SHA-256), bytes. A record
    that no document can hold is an error, before anything is written.

    While packing, a document's head is taken as long as it can get: with as many shards as the region has records."""
    total = items.groupBy("region").agg(F.count("*").alias("most")).alias("t")
    sized = items.alias("i").join(total.hint("merge"), F.expr("i.region <=> t.region")).select("i.*", "most", (F.col("most") - 1).alias("last"))
    room = F.lit(budget) - F.octet_length(_head("last", "most")) - 1  # without "]}" and with a comma that the last record lacks
    sharded = written(byte_shards(sized.withColumns({"bytes": F.octet_length("document") + 1, "room": room}), F.col("room")))
    if worst := sharded.where("oversized").select("region", "id", "bytes").limit(1).collect():
        raise ValueError(f"record {worst[0].id} of region {worst[0].region} can't fit in a package of {budget} bytes")
    s, i = sharded.alias("s"), items.alias("i")
    held = s.join(i.hint("merge"), F.expr("s.region <=> i.region and s.id = i.id")).select("s.region", "s.shard", "s.id", "i.document")
    counts = sharded.groupBy("region").agg((F.max("shard") + 1).alias("shards")).alias("c")
    listed = held.groupBy("region", "shard").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("id", "document"))).alias("records")).alias("l")
    told = listed.join(counts.hint("merge"), F.expr("l.region <=> c.region")).select("l.*", "shards")
    document = F.concat(_head("shard", "shards"), F.array_join(F.transform("records", lambda r: r["document"]), ","), F.lit("]}"))
    path, spark = new_path(items.sparkSession), items.sparkSession
    made = told.select("region", "shard", "n", document.alias("document"))
    made.write.partitionBy("region").parquet(path)
    back = spark.read.schema(made.select("shard", "n", "document", "region").schema).parquet(path)
    return back.select("region", "shard", "n", F.sha2("document", 256).alias("hash"), F.octet_length("document").cast("long").alias("bytes"))


def stable_table(df: DataFrame, *order: str) -> DataFrame:
    """Writes df range-partitioned and sorted, and reads it again."""
    path = new_path(df.sparkSession)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def gpx(stops: DataFrame) -> DataFrame:
    """stops(tour_id, ord, lon, lat, name): one GPX document for each tour, names escaped."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace("name", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    degrees = lambda c: F.format_string("%.6f", F.col(c))
    point = F.concat(F.lit('<rtept lat="'), degrees("lat"), F.lit('" lon="'), degrees("lon"), F.lit('"><name>'), safe, F.lit("</name></rtept>"))
    listed = stops.groupBy("tour_id").agg(F.array_sort(F.collect_list(F.struct("ord", point.alias("p")))).alias("ps"), F.count("*").alias("n"))
    return listed.select("tour_id", "n", F.concat(F.lit("<gpx><rte>"), F.array_join(F.transform("ps", lambda p: p["p"]), ""), F.lit("</rte></gpx>")).alias("document"))




def route_exports(routes: DataFrame, vertices: DataFrame, notices: DataFrame) -> DataFrame:
    """One GeoJSON document for each of routes(id, name, code) that the export gate lets pass (code is null), with its
    vertices(id, ord, lon, lat) in order and the notices(id, source_id, attribution, licence) of its sources."""
    line = vertices.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "lon", "lat"))), lambda v: F.array(v["lon"], v["lat"])).alias("coordinates"))
    told = notices.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("source_id", "attribution", "licence"))).alias("notices"))
    allowed = routes.where("code is null").select("id", "name").join(line, "id").join(told, "id", "left")
    geometry = F.struct(F.lit("LineString").alias("type"), "coordinates")
    properties = F.struct("id", "name", F.coalesce("notices", F.expr("cast(array() as array<struct<source_id:bigint,attribution:string,licence:string>>)")).alias("sourceNotices"))
    document = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties")))
    return allowed.select("id", F.size("coordinates").alias("vertices"), F.coalesce(F.size("notices"), F.lit(0)).alias("notices"), document.alias("document"))
