"""Running one SQL text over DataFrames, and SQL expressions that operators share."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: Three earth models: metres with atan2, metres with asin, kilometres.
EARTH_ATAN2_M, EARTH_M, EARTH_KM = 6_371_008.8, 6_371_000.0, 6_371.0


def sql(query: str, **frames: DataFrame) -> DataFrame:
    """query with {name} standing for the frame of that name."""
    spark = next(iter(frames.values())).sparkSession
    used = {k: v for k, v in frames.items() if "{" + k + "}" in query}
    return spark.sql(spark_dialect(query), **used)


#: Names that the two dialects spell differently: Spark's, DuckDB's.
SPELLINGS = {
    "count_if(": ("count_if(", "count(1) FILTER (WHERE "),
    "ARR(": ("array(", "list_value("),
    "LEN(": ("size(", "len("),
    "HAS(": ("array_contains(", "list_contains("),
    "SORTED(": ("array_sort(", "list_sort("),
    "GLUE(": ("array_join(", "array_to_string("),
    "ROW_OF(": ("struct(", "row("),
    "UNNEST(": ("explode(", "unnest("),
    "SEQ(": ("sequence(", "generate_series("),
    "EPOCH_DAY(": ("unix_date(", "datediff('day', DATE '1970-01-01', "),
    "EPOCH_US(": ("unix_micros(", "epoch_us("),
    "AT(": ("try_element_at(", "list_extract("),
    "SPLIT_ON(": ("split(", "string_split("),
    "JSON_AT(": ("get_json_object(", "json_extract_string("),
    "REGEX_HAS(": ("regexp_like(", "regexp_matches("),
    "REGEX_PICK(": ("regexp_extract(", "regexp_extract("),
}


def spark_dialect(query: str) -> str:
    return _spell(query, 0)


def duckdb_dialect(query: str) -> str:
    return _spell(query, 1)


def _spell(query: str, which: int) -> str:
    for name, both in SPELLINGS.items():
        query = re.sub(r"\b" + re.escape(name), lambda m: both[which], query)
    return query


def half_chord(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """sin^2 of half the central angle."""
    return f"(pow(sin(radians(({lat2}) - ({lat1})) / 2e0), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lon2}) - ({lon1})) / 2e0), 2))"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str, radius: float = EARTH_M) -> str:
    return f"(2e0 * {radius!r} * asin(sqrt(least(1e0, {half_chord(lat1, lon1, lat2, lon2)}))))".replace("6371000.0", "6371e3").replace("6371.0", "6371e0")


def haversine_atan2(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = half_chord(lat1, lon1, lat2, lon2)
    return f"(2e0 * 63710088e-1 * atan2(sqrt({h}), sqrt(1e0 - {h})))"


def planar_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Flat-earth metres around the first point."""
    return f"(6371e3 * sqrt(pow(radians(({lon2}) - ({lon1})) * cos(radians({lat1})), 2) + pow(radians(({lat2}) - ({lat1})), 2)))"


def js_round(x: str, scale: float = 1) -> str:
    """Halves go up, as in JavaScript."""
    return f"(floor(({x}) * {scale:.0e} + 5e-1) / {scale:.0e})"


def whole(x: str) -> str:
    return f"CAST(floor(({x}) + 5e-1) AS BIGINT)"


def clamp(x: str, low: str = "0e0", high: str = "1e0") -> str:
    """A missing or non-finite value becomes the minimum."""
    return f"(CASE WHEN ({x}) IS NULL OR isnan({x}) THEN {low} ELSE least({high}, greatest({low}, {x})) END)"


def tile_x(lon: str, zoom: int = 8) -> str:
    n = 2**zoom
    return f"CAST(least({n - 1}, greatest(0, floor((({lon}) + 180e0) / 360e0 * {n}))) AS INT)"


def tile_y(lat: str, zoom: int = 8) -> str:
    n = 2**zoom
    sane = f"least(8505112878e-8, greatest(-8505112878e-8, {lat}))"
    return f"CAST(least({n - 1}, greatest(0, floor((1e0 - ln(tan(radians({sane})) + 1e0 / cos(radians({sane}))) / pi()) / 2e0 * {n}))) AS INT)"
