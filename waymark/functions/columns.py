"""Scalar functions over columns: normalised text, stable ids, trigrams, hashes."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def without_marks(texts: pa.Array) -> pa.Array:
    """Compatibility decomposition without combining marks, a batch at once; Spark has no built-in for it."""
    return pc.replace_substring_regex(pc.utf8_normalize(texts, form="NFKD"), r"\p{M}", "")


def norm_text(text: Column) -> Column:
    """Search form: no marks, lower case, no apostrophes, letters and digits between single spaces."""
    plain = F.regexp_replace(F.lower(without_marks(text)), "[’'`]", "")
    return F.trim(F.regexp_replace(plain, r"[^\p{L}\p{N}]+", " "))


def normalized(df: DataFrame, column: str) -> DataFrame:
    """df with the search form of a column. Row by row in Arrow batches: a distinct and a join back would shuffle every
    text twice to spare the work of repeated ones."""
    return df.withColumn("normalized", norm_text(F.col(column)))


def slug(text: Column) -> Column:
    made = F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " +", "-")
    return F.when(made == "", "unnamed").otherwise(made)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over code points, in base 36."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    state = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: F.pmod(h.bitwiseXOR(c) * F.lit(16777619), F.lit(1 << 32)))
    return F.lower(F.conv(state.cast("string"), 10, 36))


def stable_id(namespace: str, source: Column) -> Column:
    return F.concat(F.lit(namespace + ":"), F.substring(slug(source), 1, 72), F.lit(":"), fnv1a(F.concat_ws("|", F.lit(namespace), source)))


def trigrams(text: Column) -> Column:
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: padded.substr(i, F.lit(3))))


def canonical_json(column: str, schema: T.DataType) -> Column:
    """A column as JSON with the keys of all objects in order, at every depth; null fields are kept."""

    def ordered(c: Column, t: T.DataType) -> Column:
        if isinstance(t, T.StructType):
            fields = [ordered(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)]
            return F.when(c.isNotNull(), F.struct(*fields))
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: ordered(x, t.elementType))
        return c

    return F.to_json(ordered(F.col(column), schema), {"ignoreNullFields": "false"})


def canonical_hash(column: str, schema: T.DataType) -> Column:
    return F.sha2(canonical_json(column, schema), 256)
