"""Reading text assets, nested JSON, pinned snapshots and HTML feeds as tables."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def isolated(spark: SparkSession, adapters: dict, schema: str) -> tuple[DataFrame, DataFrame]:
    """Runs each adapter (a function without arguments that returns a DataFrame) apart: the union of the records of those that
    have the fields of the schema, by adapter, and a table of the others with what they raised. Refuses if all fail. Only
    plans are tested here; rows that fail later fail their job, as they would anywhere."""
    wanted = T.StructType.fromDDL(schema)
    records, failures = None, []
    for name, run in adapters.items():
        try:
            made = run().select(F.lit(name).alias("adapter"), *[F.col(f.name).cast(f.dataType) for f in wanted])
        except (PySparkException, OSError, ValueError, TypeError) as why:
            failures.append((name, type(why).__name__))
            continue
        records = made if records is None else records.unionByName(made)
    if records is None:
        raise RuntimeError("every adapter failed; nothing is replaced")
    return records, spark.createDataFrame(failures, "adapter string, error string")


def embedded_array(assets: DataFrame, schema: str, variable: str = "ITEMS") -> DataFrame:
    """assets(asset, text): the array literal assigned to a variable, comments and trailing commas tolerated; one row an element."""
    body = F.regexp_extract("text", rf"(?s){variable}\s*=\s*(\[.*\])\s*;", 1)
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)/\*.*?\*/|(?m)//[^\n]*$", ""), r",(\s*[\]}])", "$1")
    return assets.select("asset", F.inline(F.from_json(body, f"array<struct<{schema}>>")))


def pinned_snapshot(files: DataFrame, feature: str) -> DataFrame:
    """files(name, content, sha256): features of the files whose digest is the pinned one; others give no rows."""
    fine = files.where(F.sha2("content", 256) == F.col("sha256"))
    return fine.select("name", F.inline(F.from_json(F.col("content").cast("string"), f"struct<features:array<struct<{feature}>>>")["features"]))


def graph_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents(graph, text): node and edge tables of versioned road graphs, with kinds filled in."""
    schema = "struct<version:int,nodes:array<struct<id:bigint,kind:string>>,edges:array<struct<a:bigint,b:bigint,kind:string>>>"
    parsed = documents.select("graph", F.from_json("text", schema).alias("g")).where("g.version = 1")
    nodes = parsed.select("graph", F.inline("g.nodes")).withColumn("kind", F.coalesce("kind", F.lit("junction")))
    edges = parsed.select("graph", F.inline("g.edges")).withColumn("kind", F.coalesce("kind", F.lit("connector")))
    return nodes, edges


def html_links(pages: DataFrame) -> DataFrame:
    """pages(page_id, html): one row for each link of a list item."""
    card = r'<li><a href="([^"]*)">([^<]*)</a></li>'
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(card), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(card), F.lit(2)).alias("label"))
    return pages.select("page_id", F.posexplode(both).alias("position", "card")).select("page_id", F.col("position").cast("long").alias("position"), "card.href", "card.label")


def registry_rows(documents: DataFrame, array: str, schema: str, version: str = "1.0.0") -> DataFrame:
    """documents(name, text): the rows of a registry's array, of documents of that version only."""
    parsed = documents.select("name", F.from_json("text", f"struct<schemaVersion:string,{array}:array<struct<{schema}>>>").alias("d"))
    return parsed.where(F.col("d.schemaVersion") == version).select("name", F.inline(F.col(f"d.{array}")))


def keyed_rows(documents: DataFrame, schema: str) -> DataFrame:
    """documents(name, text): the entries of an object keyed by name, with their key."""
    return documents.select("name", F.explode(F.map_entries(F.from_json("text", f"map<string,struct<{schema}>>"))).alias("e")).select("name", "e.key", "e.value.*")


def hourly_rows(documents: DataFrame, fields: dict[str, str]) -> DataFrame:
    """documents(name, text): {"hourly": {"time": [...], field: [...]}} as one row for each hour."""
    names = {"time": "string", **fields}
    d = documents.select("name", F.from_json("text", "struct<hourly:struct<" + ",".join(f"{n}:array<{t}>" for n, t in names.items()) + ">>").alias("d"))
    return d.select("name", F.inline(F.arrays_zip(*[F.col(f"d.hourly.{n}").alias(n) for n in names])))


def matrix_pairs(chunks: DataFrame, seed: DataFrame) -> DataFrame:
    """chunks(number, sources array, targets array, durations array<array>) and seed(a, b, duration_s) -> one pair table: of
    values that are there, that of the latest chunk wins, else the seed's."""
    cell = chunks.select("number", "sources", "targets", F.posexplode("durations").alias("i", "line")).select("number", "i", "sources", "targets", F.posexplode("line").alias("j", "duration_s"))
    told = cell.select(F.col("sources")[F.col("i")].alias("a"), F.col("targets")[F.col("j")].alias("b"), "number", "duration_s").where("duration_s is not null")
    last = told.groupBy("a", "b").agg(F.max_by("duration_s", "number").alias("measured"))
    both = last.join(seed, ["a", "b"], "full")
    return both.select("a", "b", F.coalesce("measured", "duration_s").alias("duration_s"), F.when(F.col("measured").isNotNull(), "measured").otherwise("seed").alias("basis"))


def status_cards(pages: DataFrame) -> DataFrame:
    """pages(page, html): one row for each card `<article class="pass-card ..." data-slug="...">` with its state by class or
    text, elevation and note; alerts are cards of class alert."""
    card = r'(?s)<article class="([^"]*)" data-slug="([^"]*)">(.*?)</article>'
    zipped = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(card), F.lit(i)).alias(n) for i, n in ((1, "classes"), (2, "slug"), (3, "body"))])
    c = pages.select("page", F.posexplode(zipped).alias("at", "c")).select("page", F.col("at").cast("long").alias("position"), "c.*")
    text = lambda cls: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("body", rf'<span class="{cls}">(.*?)</span>', 1), "<[^>]*>", "")), F.lit(""))
    word = F.lower(F.coalesce(text("state"), F.lit("")))
    state = F.when(F.contains("classes", F.lit("is-open")) | word.rlike("^(open|offen)"), "open").when(F.contains("classes", F.lit("is-closed")) | word.rlike("^(closed|gesperrt)"), "closed").when(word.rlike("^(restricted|eingeschr)"), "restricted").otherwise("unknown")
    return c.select("page", "position", "slug", F.when(F.contains("classes", F.lit("alert")), "alert").otherwise("status").alias("kind"), state.alias("state"), F.regexp_extract(F.coalesce(text("elev"), F.lit("")), "([0-9]+)", 1).try_cast("int").alias("elev"), text("note").alias("note"))
