"""Documents of any shape as tables of their values, keyed by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.sources.shared import written


def _kind(value: Column) -> Column:
    name = F.regexp_extract(F.schema_of_variant(value), r"^[A-Z_]+", 0)
    return (
        F.when(name == "OBJECT", "object").when(name == "ARRAY", "list").when(name == "STRING", "text").when(name == "BOOLEAN", "flag").when(name == "VOID", "null")
        .when(name.isin("DATE", "TIMESTAMP", "TIMESTAMP_NTZ"), "date").when(name.isin("TINYINT", "SMALLINT", "INT", "BIGINT"), "integer").otherwise("number")
    )


def _told(value: Column, kind: Column) -> tuple[Column, Column]:
    """The text and the number of a value."""
    plain, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
    return F.when(kind == "number", C.number_text(number)).otherwise(plain).alias("text"), F.when(kind.isin("integer", "number"), number).alias("number")


def values(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """The keys, path, kind (object, list, text, integer, number, date, flag, null), text and number of every value at any depth.

    Paths are names and places in lists (from 0), joined by dots; the document itself has none and isn't among them, and what
    stands under a name with a dot or without a character has no path. A number's text is plain, as `C.number_text` writes
    it; an object's or a list's is its JSON. `document` is a variant column; a null document has no values.

    One level is taken apart at a time, until none has members, so the depth needn't be known, and a level is a table.
    """
    spark, found = rows.sparkSession, None
    level = rows.select(*keys, F.lit("").alias("path"), F.col(document).alias("value")).filter("value is not null")
    while True:
        inside = level.lateralJoin(spark.tvf.variant_explode(F.col("value").outer()))
        # a member of an object has a key, one of a list has none
        under = F.when(F.col("path") == "", F.lit("")).otherwise(F.concat("path", F.lit(".")))
        columns = [F.col(k) for k in keys]
        named = inside.toDF(*keys, "path", "_parent", "pos", "key", "value")
        named = named.filter(F.col("key").isNull() | ((F.col("key") != "") & ~F.col("key").contains(".")))
        named = named.select(*columns, F.concat(under, F.coalesce("key", F.col("pos").cast("string"))).alias("path"), "value")
        level = written(named, "values")
        kinds = level.withColumn("kind", _kind(F.col("value")))
        here = kinds.select(*columns, "path", "kind", *_told(F.col("value"), F.col("kind")))
        found = here if found is None else found.unionByName(here)
        level = kinds.filter("kind in ('object', 'list')").select(*keys, "path", "value")
        if level.isEmpty():
            return found


def statements(rows: DataFrame, keys: list[str], document: str) -> DataFrame:
    """The keys and statement: 'path = value.' of every text, number and date under names alone; lists, flags and nulls say
    nothing."""
    said = values(rows, keys, document).filter(F.col("kind").isin("text", "integer", "number", "date"))
    named = said.filter(~F.col("path").rlike(r"(^|\.)\d+(\.|$)"))
    return named.select(*keys, F.concat("path", F.lit(" = "), "text", F.lit(".")).alias("statement"))


def at_path(found: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """`asked` (the keys and path) with text and number of the value there; null where there is none. `found`: as `values`."""
    return asked.join(found.select(*keys, "path", "kind", "text", "number"), [*keys, "path"], "left")


def reached(document: Column, path: Column) -> Column:
    """The value of a document (a variant) at a path, as a variant: the path's names are followed one by one, whatever their number,
    and nothing else of the document is taken apart. Paths are as in `values`; null where nothing stands there."""
    def step(value: Column, part: Column) -> Column:
        named = F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), part)
        placed = F.get(F.try_variant_get(value, "$", "array<variant>"), part.try_cast("int"))
        return F.when(part == "", None).otherwise(F.coalesce(named, F.when(part.rlike(r"^(0|[1-9]\d*)$"), placed)))

    return F.aggregate(F.split(path, r"\."), document, step)


def fields(rows: DataFrame, document: str, path: str, name: str) -> DataFrame:
    """`rows` with the struct `name` (kind, text, number) of what stands at a row's path of its document."""
    found = rows.withColumn(name, reached(F.col(document), F.col(path)))
    found = found.withColumn(name, F.struct(F.col(name).alias("value"), F.when(F.col(name).isNotNull(), _kind(F.col(name))).alias("kind")))
    value, kind = F.col(f"{name}.value"), F.col(f"{name}.kind")
    return found.withColumn(name, F.struct(kind.alias("kind"), *_told(value, kind), value.alias("value")))


def members(value: Column) -> Column:
    """The texts of the members of a list that are plain values."""
    told = lambda v: F.when(~_kind(v).isin("object", "list"), F.when(_kind(v) == "number", _told(v, _kind(v))[0]).otherwise(F.try_variant_get(v, "$", "string")))
    return F.array_compact(F.transform(F.try_variant_get(value, "$", "array<variant>"), told))
