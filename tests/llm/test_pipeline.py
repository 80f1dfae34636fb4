"""Each stage of the pipeline against a direct version, on the smallest data with some planted documents."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as pipeline
from riskloom.llm import bpe, mixing
from tests.llm.test_jaccard import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(10**6, None, "en", "src0", 0), (10**6 + 1, "12 34 !!", "en", "src0", 8), (10**6 + 2, given.first().text, "en", "src1", 1), (10**6 + 3, given.first().text + " more", "en", "src1", 1)]
    return given.union(spark.createDataFrame(more, given.schema)).cache()


def test_stages_are_named_and_ordered():
    assert [n for n, _ in pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "mix", "encode"]


def test_language_keeps_texts(spark, docs):
    kept = pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    gone = {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {10**6, 10**6 + 1}


def test_toxicity_drops_rows_only(spark, docs):
    kept = pipeline.toxic(spark, docs, SF)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    assert kept.count() >= 0.7 * docs.count()


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    kept = pipeline.near_duplicates(spark, docs, SF)
    want = {c for _, n, c in brute([(r.doc_id, r.text) for r in docs.collect()]) if n} | {10**6}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == docs.columns


def brute_five(rows):
    """Each document's least linked id, by all pairs of five-word sets at 0.8."""
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b) > 0:
                group = [group[j] if g == group[i] else g for g in group]
    return {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if group[j] == group[i]) for i in range(len(rows))}


def test_near_duplicates_take_five_words_and_four_fifths(spark):
    rnd = random.Random(11)
    rows = []
    for _ in range(30):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(6, 90))]
        for _ in range(4):
            x = list(base)
            for _ in range(rnd.randint(0, 2)):
                x[rnd.randrange(len(x))] = f"w{rnd.randrange(500)}"
            rows.append((len(rows), " ".join(x)))
    least = brute_five(rows)
    assert {i for i, c in least.items() if i == c} != {c for _, _, c in brute(rows)}  # the operator's own setting differs here
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_near_duplicates_with_repeated_ids(spark, docs):
    twice = docs.union(docs.limit(5))
    ids = [r.doc_id for r in pipeline.near_duplicates(spark, twice, SF).collect()]
    assert len(ids) == len(set(ids))


def test_near_duplicates_keep_unlinked_texts_of_a_repeated_id(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(30))
    rows = [(1, text("a")), (2, text("a") + " end"), (2, text("b")), (2, text("c")), (3, text("c")), (3, text("c")), (4, text("b")), (5, ""), (5, " "), (5, ""), (None, text("a"))]
    kept = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    want = [(1, text("a")), (2, text("b")), (2, text("c")), (5, ""), (5, " "), (None, text("a"))]
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, want)) and kept.columns == ["doc_id", "text"]


def test_mix_takes_each_document_as_often_as_the_operator_says(spark, docs):
    kept = Counter(r.doc_id for r in pipeline.mix(spark, docs, SF).collect())
    for r in mixing.mix_documents(docs).collect():
        assert kept[r.doc_id] * r.size == r.taken


def test_encode(spark, docs):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in pipeline.encode(spark, docs, SF).collect():
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stages_on_an_empty_table_and_on_clashing_columns(spark, docs):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    odd = given.limit(30).selectExpr("*", "1 as score", "2 as predicted", "'x' as lang_pred", "3 as size", "4 as copies", "5 as fp", "6 as component_id", "7 as n_tokens")
    odd = odd.union(odd.selectExpr(*(c if c != "text" else "null as text" for c in odd.columns)))
    for stage in (pipeline.language, pipeline.toxic, pipeline.near_duplicates, pipeline.mix):
        none = stage(spark, given.limit(0), SF)
        assert none.count() == 0 and none.columns == given.columns
        kept = stage(spark, odd, SF)
        assert kept.columns == odd.columns and kept.exceptAll(odd if stage is not pipeline.mix else odd.union(odd).union(odd)).count() == 0
    assert pipeline.encode(spark, given.limit(0), SF).count() == 0


def test_run_goes_through_all_stages(spark):
    out = pipeline.run(spark, SF)
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 0
