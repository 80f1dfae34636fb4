"""A corpus pipeline of operators from riskloom.llm.

Five stages over `documents`, each written as Parquet and read again as the next one's input:

1. language: documents without a letter, or far from every language's profile, go;
2. toxicity: documents that are predicted to be toxic go;
3. near_duplicates: of each group of linked documents (five-word shingles, similarity 0.8), the one with the smallest doc_id stays;
4. mix: each source's documents are taken as often as its share of words asks for;
5. encode: byte-level BPE; the number of ids, and digests of the ids and of the decoded bytes.

Defined cases, of every stage: a null text, or one without a letter, goes in `language`; a null doc_id belongs to no group
and stays; rows of one doc_id with different, unlinked texts all stay; a row that repeats a doc_id of the same component
goes, and of ties the first row by all columns stays; a null source is a source of its own; very long texts go through
whole; columns beyond those of `documents` pass through all stages but the last, also where an operator adds a column of
the same name; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm import bpe, jaccard, langid, mixing, toxicity
from riskloom.llm.common import materialise, table, temporary
from riskloom.llm.queries import BPE_FILE

#: A text this far from all profiles is in none of their languages; ordinary ones lie above twice as much.
LEAST_LANGUAGE_SCORE = 0.2
#: Near copies share this percentage of their shingles of so many words; op10_jaccard's own query has other values.
DUPLICATE_PERCENT, DUPLICATE_WORDS = 80, 5
#: Removed ids up to which they are broadcast (8 bytes each); beyond, documents and ids are joined by key.
BROADCAST_IDS = 2_000_000


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """The columns that an operator reads, beside all others in one struct, so that what it adds can't clash with them; and
    the columns of `docs` made of it again."""
    rest = [c for c in docs.columns if c not in names]
    packed = docs.select(*names, F.struct(F.lit(0).alias("_none"), *(F.col(f"`{c}`") for c in rest)).alias("_row"))
    return packed, [F.col(c) if c in names else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: near enough to one of the profiles, which are learned from what isn't held out."""
    profiles = langid.learn(docs.filter(~langid.held_out(F.col("doc_id"))))
    packed, columns = _aside(docs, "text")
    judged = langid.identify(packed, profiles)
    return judged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted to be toxic, by a model of the labelled ones."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    packed, columns = _aside(docs, "text")
    return toxicity.score(packed, model).filter("predicted = 0").select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    found = materialise(jaccard.linked_rows(docs, DUPLICATE_PERCENT, DUPLICATE_WORDS), "duplicates")
    twice = found.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count()
    if twice:
        return _one_of_each(docs, found)
    gone = found.filter("doc_id <> component_id").select("doc_id")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(docs.columns)


def _one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row that stays of each component where ids repeat: of its least id, the first by its whole content. Rows of one
    id in different components stay apart; without words, rows of one id and text are the same document."""
    components = found.filter("fp is not null").select(F.col("fp").alias("_fp"), F.col("root").alias("_root"), F.col("component_id").alias("_head")).distinct()
    packed, columns = _aside(docs, "doc_id", "text")
    keyed = jaccard.fingerprints(packed.filter("doc_id is not null"), DUPLICATE_WORDS).withColumnRenamed("fp", "_fp")
    heads = keyed.join(components, "_fp", "left").filter("_fp is null or doc_id = _head").withColumn("_blank", F.when(F.col("_fp").isNull(), F.col("text")))
    order = Window.partitionBy("doc_id", "_root", "_blank").orderBy("text", "_row")
    kept = heads.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(columns)
    return kept.unionByName(docs.filter("doc_id is null"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sizes = materialise(mixing.sized(docs.select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    packed, columns = _aside(docs, "doc_id", "text", "source")
    taken = mixing.apply_mix(packed, mixing.plan_mix(sizes)).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, as their number and digests."""
    return bpe.encode(docs.select("doc_id", "text"), bpe.read_ranks(public_tokenizers.path(BPE_FILE)), public_tokenizers.PATTERN)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]

#: SQL can express neither the language nor the toxicity stage; tests/llm holds each stage against a direct version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What stages write on their way is deleted, but for the last one's input."""
    docs = table(spark, sf_dir, "documents")
    with temporary(spark) as keep_last:
        for name, stage in STAGES[:-1]:
            with temporary(spark) as keep:
                docs = keep(materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        keep_last(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
