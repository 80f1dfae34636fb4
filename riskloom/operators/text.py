"""Text corpus jobs: pages without headers, tables, sections by heading, packing, chunks with their lineage and pages.

Lines are rows, numbered within their document; sections, paragraphs and offsets are windows over a document's lines, and
everything after them is partitioned by document, too, so that a corpus is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.sources.shared import written

# Sizes of chunks and of headers, in characters or shares, and what a heading looks like.
TARGET, MAXIMUM, MINIMUM = 2800, 4000, 120
REPEAT_SHARE, LEAST_PAGES, LINE_CHARS = 0.6, 3, 120
NUMBERED = r"(?U)^\s{0,3}(\d+(?:\.\d+){0,3})\.?\s+(\S.*)$"
MARKED = r"(?U)^\s{0,3}(#{1,6})\s+(\S.*)$"
LEVELS = 6
LINE_END = "\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]"
_WHITE = r"[\s\x1c-\x1f]"
#: Units of text that one step of packing takes before it closes its list.
RUN = 512


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"(?U)^{_WHITE}+|{_WHITE}+$", "")


def lines(docs: DataFrame, *keys: str) -> DataFrame:
    """The keys (doc_id, if none is named), at (from 0), line, and size (characters up to the next line)."""
    ends = F.regexp_extract_all("text", F.lit(LINE_END), F.lit(0))
    pairs = F.arrays_zip(F.split("text", LINE_END, -1).alias("line"), ends.alias("end"))
    rows = docs.select(*(keys or ("doc_id",)), F.posexplode(pairs).alias("at", "x"))
    size = F.length("x.line") + F.coalesce(F.length("x.end"), F.lit(0))
    return rows.select(*(keys or ("doc_id",)), "at", F.col("x.line").alias("line"), size.cast("long").alias("size"))


def line_key(line: Column) -> Column:
    """A line by what doesn't vary from page to page."""
    return F.regexp_replace(stripped(F.regexp_replace(line, rf"(?U){_WHITE}+", " ")), r"(?U)\d+", "#")


def repeated_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, key, pages): short lines on at least 0.6 of a document's pages (two at least), from three pages on.
    `pages`: doc_id, page, text."""
    own = stripped(F.col("line"))
    keyed = lines(pages, "doc_id", "page").filter((F.length(own) > 0) & (F.length(own) <= LINE_CHARS)).select("doc_id", "page", line_key(F.col("line")).alias("key"))
    every = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("all_pages")).filter(F.col("all_pages") >= LEAST_PAGES)
    found = keyed.groupBy("doc_id", "key").agg(F.count_distinct("page").alias("pages")).join(every, "doc_id")
    return found.filter(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("all_pages") * REPEAT_SHARE))).select("doc_id", "key", "pages")


def without_repeated_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text): every page without the lines that repeated_lines finds, whatever their length; the others are
    put together again in order. Blank lines stay."""
    rows = lines(pages, "doc_id", "page").withColumn("key", line_key(F.col("line")))
    kept = rows.join(repeated_lines(pages).select("doc_id", "key", F.lit(True).alias("again")), ["doc_id", "key"], "left")
    kept = kept.withColumn("kept", F.col("again").isNull() | (stripped(F.col("line")) == ""))
    listed = kept.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("at", "line")))).alias("l"))
    return listed.select("doc_id", "page", stripped(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("text"))


def table_rows(header: Column, cells: Column) -> Column:
    """'head: cell | ...', empty cells left out; a cell without a head stands alone."""
    head = lambda i: F.trim(F.coalesce(F.get(header, i), F.lit("")))
    named = F.transform(cells, lambda c, i: F.when(F.trim(c) != "", F.when(head(i) != "", F.concat(head(i), F.lit(": "), F.trim(c))).otherwise(F.trim(c))))
    return F.array_join(F.array_compact(named), " | ")


def _heading(line: Column) -> tuple[Column, Column, Column]:
    """Number ('' for a marked heading), label and depth of a heading; the depth of any other line is null."""
    number, marks = F.regexp_extract(line, NUMBERED, 1), F.regexp_extract(line, MARKED, 1)
    title = stripped(F.when(number != "", F.regexp_extract(line, NUMBERED, 2)).otherwise(F.regexp_extract(line, MARKED, 2)))
    label = F.when(number != "", F.concat(number, F.lit(" "), title)).otherwise(title)
    depth = F.when(number != "", F.size(F.split(number, r"\."))).when(marks != "", F.length(marks))
    return number, label, depth


def sectioned(docs: DataFrame) -> DataFrame:
    """Lines with the section that they stand in: section (headings so far), section_id, path, and offset (characters before
    the line). `docs`: doc_id, text.

    A heading takes from the stack of open ones those of its own depth or deeper. What is left under it is, for each lesser
    depth, the last heading of that depth, if none of a still lesser depth came after it: six running maxima.
    """
    number, label, depth = _heading(F.col("line"))
    rows = lines(docs).withColumns({"number": number, "label": label, "depth": depth})
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda d: F.max(F.when(F.col("depth") == d, F.struct("at", "label"))).over(so_far)
    rows = rows.withColumns({f"_{d}": last(d) for d in range(1, LEVELS + 1)})
    rows = rows.withColumns({
        "section": F.count("depth").over(so_far),
        "_number": F.max(F.when(F.col("depth").isNotNull(), F.struct("at", "number"))).over(so_far)["number"],
        "offset": F.sum("size").over(so_far) - F.col("size"),
    })
    at = lambda d: F.coalesce(F.col(f"_{d}.at"), F.lit(-1))
    above = lambda d: F.greatest(F.lit(-1), F.lit(-1), *(at(i) for i in range(1, d)))
    path = F.array_compact(F.array(*(F.when(at(d) > above(d), F.col(f"_{d}.label")) for d in range(1, LEVELS + 1))))
    rows = rows.withColumn("path", path)
    section_id = F.when(F.coalesce("_number", F.lit("")) != "", F.col("_number")).otherwise(F.array_join("path", " / "))
    return rows.select("doc_id", "at", "line", "section", section_id.alias("section_id"), "path", "offset", F.col("depth").isNotNull().alias("heading"))


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, section_id, path, text of all sections that have a text."""
    body = F.array_sort(F.collect_list(F.when(~F.col("heading"), F.struct("at", "line"))))
    found = sectioned(docs).groupBy("doc_id", "section").agg(F.first("section_id").alias("section_id"), F.first("path").alias("path"), body.alias("l"))
    text = stripped(F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return found.select("doc_id", "section", "section_id", "path", text.alias("text")).filter("text <> ''")


def json_text(text: Column) -> Column:
    """A text as JSON, with nothing escaped but quotes, backslashes and control characters."""
    names = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    text = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        text = F.replace(text, F.lit(chr(code)), F.lit("\\" + names.get(code, f"u{code:04x}")))
    return F.concat(F.lit('"'), text, F.lit('"'))


def occurrence(rows: DataFrame) -> DataFrame:
    """The n-th time that a document has a heading path, and the key made of both. `rows`: doc_id, section, path."""
    n = F.row_number().over(Window.partitionBy("doc_id", "path").orderBy("section"))
    path = F.array_join(F.transform("path", json_text), ", ")
    key = F.substring(F.sha2(F.concat(F.lit("[["), path, F.lit("], "), F.col("occurrence").cast("string"), F.lit("]")), 256), 1, 24)
    return rows.withColumn("occurrence", n).withColumn("section_key", key)


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, section, section_id, path, n (running number in the section), offset and text: runs of lines that aren't blank."""
    rows = sectioned(docs).withColumn("blank", F.col("heading") | (stripped(F.col("line")) == ""))
    n = F.count_if("blank").over(Window.partitionBy("doc_id", "section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("n", n).filter("not blank").groupBy("doc_id", "section", "n")
    found = kept.agg(F.first("section_id").alias("section_id"), F.first("path").alias("path"), F.min("offset").alias("offset"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    white = F.length(F.regexp_extract(text, rf"(?U)^{_WHITE}*", 0))
    return found.select("doc_id", "section", "section_id", "path", "n", (F.col("offset") + white).alias("offset"), stripped(text).alias("text"))


def units(rows: DataFrame, most: int = MAXIMUM) -> DataFrame:
    """Paragraphs as units of packing: doc_id, section, n, i, grp, offset, text. A paragraph over the maximum is cut after a full stop or
    a semicolon; its pieces share a group of their own (all others: -1)."""
    over = F.length("text") > most
    between = rf"(?U)(?<=[.;]){_WHITE}+"
    cut = F.arrays_zip(F.split("text", between, -1).alias("text"), F.regexp_extract_all("text", F.lit(between), F.lit(0)).alias("gap"))
    pieces = F.when(over, cut).otherwise(F.array(F.struct(F.col("text").alias("text"), F.lit("").alias("gap"))))
    found = rows.select("doc_id", "section", "n", "offset", F.when(over, F.col("n")).otherwise(-1).alias("grp"), F.posexplode(pieces).alias("i", "x"))
    size = F.length("x.text") + F.coalesce(F.length("x.gap"), F.lit(0))
    before = Window.partitionBy("doc_id", "section", "n").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return found.select("doc_id", "section", "n", "i", "grp", (F.col("offset") + F.coalesce(F.sum(size).over(before), F.lit(0))).alias("offset"), F.col("x.text").alias("text"))


def packed(rows: DataFrame, target: int = TARGET) -> DataFrame:
    """doc_id, section, part, offset, text: units joined greedily up to the target, paragraphs by a blank line, pieces of one by
    a space; pieces and paragraphs aren't joined with each other. `rows`: as `units` gives them.

    The fold is over one section; it closes a list of parts every `RUN` units, so that its cost follows the text.
    """
    unit = F.struct("n", "i", "grp", "offset", "text")
    listed = rows.groupBy("doc_id", "section").agg(F.array_sort(F.collect_list(unit)).alias("u"))
    part = "array<struct<offset:bigint,text:string>>"
    made = lambda acc: F.array(F.struct(acc["offset"].alias("offset"), acc["text"].alias("text")))

    def state(done: Column, text: Column, offset: Column, grp: Column) -> Column:
        return F.struct(done.alias("done"), text.alias("text"), offset.cast("long").alias("offset"), grp.cast("int").alias("grp"))

    def add(acc: Column, u: Column) -> Column:
        joint = F.when(u["grp"] < 0, F.lit("\n\n")).otherwise(F.lit(" "))
        fits = (acc["grp"] == u["grp"]) & (F.length(acc["text"]) + F.length(u["text"]) + F.length(joint) <= target)
        return (
            F.when(acc["text"] == "", state(acc["done"], u["text"], u["offset"], u["grp"]))
            .when(fits, state(acc["done"], F.concat(acc["text"], joint, u["text"]), acc["offset"], acc["grp"]))
            .otherwise(state(F.concat(acc["done"], made(acc)), u["text"], u["offset"], u["grp"]))
        )

    def add_run(acc: Column, run: Column) -> Column:
        own = F.aggregate(run, state(F.array().cast(part), acc["text"], acc["offset"], acc["grp"]), add)
        return F.struct(F.concat(acc["done"], F.array(own["done"])).alias("done"), own["text"].alias("text"), own["offset"].alias("offset"), own["grp"].alias("grp"))

    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.lit("").alias("text"), F.lit(0).cast("long").alias("offset"), F.lit(-1).alias("grp"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("u") - 1) / RUN)), lambda r: F.slice("u", (r * RUN + 1).cast("int"), RUN))
    parts = F.aggregate(runs, start, add_run, lambda acc: F.flatten(F.concat(acc["done"], F.array(made(acc)))))
    return listed.select("doc_id", "section", F.posexplode(parts).alias("part", "p")).select("doc_id", "section", "part", "p.offset", "p.text")


def chunk_corpus(docs: DataFrame) -> DataFrame:
    """Chunks of every document: doc_id, chunk (running number), section_id, section_key, path, chunk_index (in its section),
    offset, text, content_hash. A small part of a section without an id joins the chunk before it. `docs`: doc_id, text."""
    found = written(paragraphs(docs), "paragraphs")
    keys = occurrence(found.groupBy("doc_id", "section").agg(F.first("section_id").alias("section_id"), F.first("path").alias("path")))
    parts = packed(units(found)).join(keys, ["doc_id", "section"])
    order = Window.partitionBy("doc_id").orderBy("section", "part")
    small = (F.length("text") < MINIMUM) & (F.col("section_id") == "")
    parts = parts.withColumn("begins", (~small | (F.row_number().over(order) == 1)).cast("int"))
    parts = parts.withColumn("chunk", (F.sum("begins").over(order) - 1).cast("int"))
    listed = F.array_sort(F.collect_list(F.struct("section", "part", "section_id", "section_key", "path", "offset", "text")))
    chunks = parts.groupBy("doc_id", "chunk").agg(listed.alias("p"))
    first = lambda n: F.element_at("p", 1)[n].alias("chunk_index" if n == "part" else n)
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    return chunks.select("doc_id", "chunk", *map(first, ("section_id", "section_key", "path", "part", "offset")), text.alias("text")).withColumn("content_hash", F.sha2("text", 256))


def chunk_id(document_id: Column, version: Column) -> Column:
    return F.concat(F.lit("v2:"), document_id, F.lit("@"), version, F.lit(":"), F.col("section_key"), F.lit(":"), F.col("chunk_index").cast("string"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, text: the pages of each document in order, with a blank line between them. `pages`: doc_id, page, text."""
    listed = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return listed.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))


def page_starts(pages: DataFrame) -> DataFrame:
    """doc_id, page, offset of each page's first character in joined_pages."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select("doc_id", "page", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("long").alias("offset"))


def pages_of(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """doc_id, chunk, page: the page that a chunk starts on. Page starts and chunks are merged by offset, and the last page is
    carried along, so that neither is paired with the other. `chunks`: doc_id, chunk, offset."""
    none = lambda kind: F.lit(None).cast(kind)
    marks = starts.select("doc_id", "offset", F.lit(0).alias("kind"), "page", none("int").alias("chunk"))
    rows = marks.unionByName(chunks.select("doc_id", F.col("offset").cast("long").alias("offset"), F.lit(1).alias("kind"), none(starts.schema["page"].dataType).alias("page"), F.col("chunk").cast("int").alias("chunk")))
    order = Window.partitionBy("doc_id").orderBy("offset", "kind", "page").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("page", F.last("page", ignorenulls=True).over(order)).filter("kind = 1").select("doc_id", "chunk", "page")
