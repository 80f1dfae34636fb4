"""Growing an append-only source: read a delivered file, validate it whole, append it as the next load, keep the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.functions import columns as C

GENESIS = "0" * 64
_CASTS = {"string": "string", "number": "double", "probability": "double", "integer": "bigint", "boolean": "boolean", "date": "date"}
EXAMPLES = 5


def read_delivered(spark: SparkSession, path: str, kind: str, columns: list[str]) -> DataFrame:
    """A delivered file as text cells, so that a bad cell is counted and not silently lost."""
    if kind == "csv":
        return spark.read.schema(", ".join(f"{c} string" for c in columns)).option("header", True).option("enforceSchema", False).csv(path)
    if kind == "json":
        return spark.read.schema(", ".join(f"{c} string" for c in columns)).json(path)
    if kind == "parquet":
        return spark.read.parquet(path).select(*(F.col(c).cast("string").alias(c) for c in columns))
    raise ValueError(f"not a file format that is admitted: {kind}")


def typed(rows: DataFrame, table: R.Table) -> DataFrame:
    """Text cells in their declared types; what doesn't parse is null."""
    return rows.select(*(F.col(c).try_cast(_CASTS[table.columns[c].kind]).alias(c) for c in rows.columns))


def _bad_type(name: str, kind: str) -> Column:
    cell = F.col(name)
    if kind == "string":
        return F.lit(False)
    bad = cell.try_cast(_CASTS[kind]).isNull()
    if kind == "integer":
        bad = bad | (cell.try_cast("bigint") != cell.try_cast("double"))
    return cell.isNotNull() & bad


def rules(columns: list[str], table: R.Table, today: str) -> list[tuple[str, str, Column, Column]]:
    """(code, column, condition on a row, example) of every rule but the duplicate check."""
    out = []
    for name in columns:
        c, cell = table.columns[name], F.col(name)
        value = cell.try_cast(_CASTS[c.kind])
        required = name in table.grain or name in table.required
        if required:
            out.append(("missing_required", name, cell.isNull(), cell))
        out.append(("invalid_type", name, _bad_type(name, c.kind), cell))
        if c.kind == "string" and required:
            out.append(("blank_string", name, F.trim(cell) == "", cell))
        if c.least is not None:
            out.append(("below_minimum", name, value < c.least, cell))
        if c.most is not None:
            out.append(("above_maximum", name, value > c.most, cell))
        allowed = c.allowed or {"portfolio": R.PORTFOLIOS, "jurisdiction": R.JURISDICTIONS}.get(name, ())
        if allowed:
            out.append(("not_allowed", name, ~value.isin(*allowed), cell))
    cutoff, seen = F.col("data_cutoff_date").try_cast("date"), F.col("observation_date").try_cast("date")
    out.append(("cutoff_before_observation", "data_cutoff_date", cutoff < seen, F.col("data_cutoff_date")))
    out.append(("future_data_cutoff", "data_cutoff_date", cutoff > F.lit(today).cast("date"), F.col("data_cutoff_date")))
    return out


_RANGE = ("below_minimum", "above_maximum", "not_allowed")
_ORDER = ("cutoff_before_observation", "future_data_cutoff")


def validate(rows: DataFrame, table: R.Table, today: str) -> DataFrame:
    """(code, name, n): every rule that some row breaks. One pass counts all rules; the duplicate check is one more.

    Range checks of a column that has a bad type are skipped, and the order of dates is checked only if all types parse.
    """
    known = [c for c in rows.columns if c in table.columns]
    checks = rules(known, table, today)
    counted = rows.agg(F.count(F.lit(1)).alias("all"), *(F.count_if(when).alias(f"r{i}") for i, (_, _, when, _) in enumerate(checks)))
    bad = {name: F.col(f"r{i}") for i, (code, name, _, _) in enumerate(checks) if code == "invalid_type"}
    all_parse = sum(bad.values(), F.lit(0)) == 0
    cells = []
    for i, (code, name, _, _) in enumerate(checks):
        applies = bad[name] == 0 if code in _RANGE else all_parse if code in _ORDER else F.lit(True)
        cells.append(F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), F.when(applies, F.col(f"r{i}")).alias("n")))
    cells += [F.struct(F.lit("undeclared_columns").alias("code"), F.lit(c).alias("name"), F.lit(1).cast("long").alias("n")) for c in rows.columns if c not in table.columns]
    cells.append(F.struct(F.lit("no_rows").alias("code"), F.lit("").alias("name"), F.when(F.col("all") == 0, F.lit(1).cast("long")).alias("n")))
    found = counted.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("n > 0")
    return found.unionByName(duplicate_grain(rows, table).select(F.lit("duplicate_grain").alias("code"), F.lit("").alias("name"), "n").filter("n > 0"))


def duplicate_grain(rows: DataFrame, table: R.Table) -> DataFrame:
    """How many grain keys occur more than once."""
    return rows.groupBy(*table.grain).agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1).alias("n"))


def examples(rows: DataFrame, table: R.Table, today: str) -> DataFrame:
    """At most five values of each broken rule, the least ones by text."""
    cells = [F.when(when, F.struct(F.lit(code).alias("code"), F.lit(name).alias("name"), F.coalesce(value, F.lit("null")).alias("value"))) for code, name, when, value in rules([c for c in rows.columns if c in table.columns], table, today)]
    broken = rows.select(F.explode(F.array_compact(F.array(*cells))).alias("x")).select("x.*").distinct()
    n = F.row_number().over(Window.partitionBy("code", "name").orderBy("value"))
    return broken.withColumn("n", n).filter(F.col("n") <= EXAMPLES)


def restated(rows: DataFrame, source: DataFrame, grain: tuple[str, ...]) -> DataFrame:
    """Distinct grain keys of a file that the source has already, compared as text."""
    text = lambda df: df.select(*(F.col(c).cast("string").alias(c) for c in grain)).distinct()
    return text(rows).join(text(source), list(grain), "left_semi")


def window(rows: DataFrame) -> DataFrame:
    day = lambda c: F.col(c).try_cast("date")
    return rows.agg(F.min(day("observation_date")).alias("first_date"), F.max(day("observation_date")).alias("last_date"), F.max(day("data_cutoff_date")).alias("last_cutoff"))


def append_load(rows: DataFrame, table: R.Table, path: str, load_id: int) -> int:
    """Write a validated file as one load's partition and count it again; a rerun replaces its own partition only."""
    good = typed(rows, table).withColumn("load_id", F.lit(load_id).cast("long"))
    good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id").parquet(path)
    return rows.sparkSession.read.parquet(path).filter(F.col("load_id") == load_id).count()


def seed(rows: DataFrame, table: R.Table, path: str) -> None:
    """Stamp an existing table as load 1; refuses to overwrite one, or to start with a column missing."""
    lacking = [c for c in table.columns if c != "load_id" and c not in rows.columns]
    if lacking:
        raise ValueError(f"columns missing: {lacking}")
    rows.withColumn("load_id", F.lit(1).cast("long")).write.mode("errorifexists").partitionBy("load_id").parquet(path)


def ledger(rows: DataFrame) -> DataFrame:
    """One row a load: its rows, its window, its last cutoff."""
    return rows.groupBy("load_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("observation_date").alias("first_date"), F.max("observation_date").alias("last_date"), F.max("data_cutoff_date").alias("last_cutoff"))


def chained(previous: Column, text: Column) -> Column:
    """The hash of a load: of canonical JSON with its entries and the hash before."""
    return F.sha2(F.concat(F.lit('{"entries": ['), text, F.lit('], "previous": "'), previous, F.lit('"}')), 256)


def load_texts(entries: DataFrame) -> DataFrame:
    """One row a load: its entries (a table each, in order of name) as canonical JSON. `entries`: load_id, table_name,
    file_sha256, row_count."""
    one = F.concat(F.lit('{"file_sha256": "'), "file_sha256", F.lit('", "row_count": '), F.col("row_count").cast("string"), F.lit(', "table_name": "'), "table_name", F.lit('"}'))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("table_name", one.alias("text")))), lambda x: x["text"])
    return entries.groupBy("load_id").agg(F.concat_ws(", ", listed).alias("text"))


def chain(entries: DataFrame) -> DataFrame:
    """Every load with the hash of the one before and its own. A ledger has one row a load, so a fold over it is small."""
    steps = F.array_sort(F.collect_list(F.struct("load_id", "text")))
    first = F.array(F.struct(F.lit(0).cast("long").alias("load_id"), F.lit("").alias("prev_hash"), F.lit(GENESIS).alias("chain_hash")))

    def link(acc: Column, x: Column) -> Column:
        before = F.element_at(acc, -1)["chain_hash"]
        return F.concat(acc, F.array(F.struct(x["load_id"].cast("long").alias("load_id"), before.alias("prev_hash"), chained(before, x["text"]).alias("chain_hash"))))

    folded = load_texts(entries).agg(F.aggregate(steps, first, link).alias("chain"))
    return folded.select(F.explode("chain").alias("x")).select("x.*").filter("load_id > 0")


def broken_links(stored: DataFrame, entries: DataFrame) -> DataFrame:
    """Loads whose stored hashes don't follow from the entries and the hash before."""
    order = Window.orderBy("load_id")  # a ledger has one row a load
    before = F.coalesce(F.lag("chain_hash").over(order), F.lit(GENESIS))
    rows = stored.join(load_texts(entries), "load_id").withColumn("before", before)
    return rows.filter((F.col("prev_hash") != F.col("before")) | (F.col("chain_hash") != chained(F.col("before"), F.col("text")))).select("load_id")


def watermark(chained: DataFrame) -> DataFrame:
    return chained.agg(F.max("load_id").alias("load_id"), F.max_by("chain_hash", "load_id").alias("chain_hash"))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of every file below a path."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def unseen_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose bytes aren't in the ledger yet."""
    return found.join(known.select("sha256"), "sha256", "left_anti")


def export_month(rows: DataFrame, month: str) -> DataFrame:
    return rows.filter(F.col("observation_date") == F.lit(month).cast("date")).drop("load_id")


def null_counts(rows: DataFrame) -> DataFrame:
    """(name, n) of the columns that have nulls."""
    counted = rows.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in rows.columns))).alias("x")).select("x.*").filter("n > 0")


def validate_result(rows: DataFrame, table: R.Table, portfolio: str, jurisdiction: str, as_of: str, date_from: str, date_to: str, most: int) -> DataFrame:
    """(code, n): where a fetched result breaks its approved contract. One pass."""
    day = lambda x: F.lit(x).cast("date")
    checks = {
        "portfolio_mismatch": F.col("portfolio") != portfolio, "jurisdiction_mismatch": F.col("jurisdiction") != jurisdiction,
        "missing_required": F.greatest(*(F.col(c).isNull() for c in table.grain if c in rows.columns)), "point_in_time_breach": F.col("data_cutoff_date") > day(as_of),
        "date_out_of_range": ~F.col("observation_date").between(day(date_from), day(date_to)),
    }
    for name in rows.columns:
        c = table.columns.get(name)
        if c is None or c.kind in ("string", "date", "boolean"):
            continue
        bad = ~C.finite(F.col(name).cast("double")) & F.col(name).isNotNull()
        if c.least is not None:
            bad = bad | (F.col(name) < c.least)
        if c.most is not None:
            bad = bad | (F.col(name) > c.most)
        if c.allowed:
            bad = bad | ~F.col(name).isin(*c.allowed)
        checks[f"invalid_field:{name}"] = bad
    counted = rows.agg(F.count(F.lit(1)).alias("all"), F.count_distinct(F.struct(*(c for c in table.grain if c in rows.columns))).alias("keys"), *(F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in checks.items()))
    cells = [F.struct(F.lit(k).alias("code"), F.col(f"`{k}`").alias("n")) for k in checks]
    cells.append(F.struct(F.lit("duplicate_grain").alias("code"), (F.col("all") - F.col("keys")).alias("n")))
    cells.append(F.struct(F.lit("truncated").alias("code"), F.when(F.col("all") > most, F.col("all") - most).otherwise(0).alias("n")))
    return counted.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("n > 0")
