"""Queries of retrieval and text jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import registry as R
from riskloom.catalog import query
from riskloom.functions import columns as C
from riskloom.operators import quality as Q
from riskloom.operators import ranking as N
from riskloom.operators import retrieval as V
from riskloom.sources.shared import written
from riskloom.sources.views import Tables

_CONTEXTS = "SELECT * FROM (VALUES (1, 'credit_analyst', 'SAMA', DATE '2022-06-30', CAST(NULL AS VARCHAR(12))), (2, 'regulator_liaison', 'SAMA', DATE '2023-06-30', 'retail'), (3, 'senior_credit_officer', 'CBUAE', DATE '2022-06-30', 'sme'), (4, 'visitor', 'SAMA', DATE '2023-06-30', 'sme')) AS c(context_id, role, jurisdiction, as_of, portfolio)"
_STARTS = "SELECT doc_id, document_id AS target, effective_from FROM policy_docs WHERE approval_status = 'approved' UNION ALL SELECT doc_id, supersedes_document_id, effective_from FROM policy_docs WHERE approval_status = 'approved' AND supersedes_document_id IS NOT NULL"
_WINDOWS = f"""
SELECT doc_id, document_id, document_version, jurisdiction, approval_status, confidentiality_level, allowed_roles, portfolios, effective_from, declared_to, supersedes_document_id,
  CASE WHEN cut IS NOT NULL AND (declared_to IS NULL OR cut < declared_to) THEN cut ELSE declared_to END AS effective_to, CASE WHEN cut IS NOT NULL AND (declared_to IS NULL OR cut < declared_to) THEN later END AS superseded_by
FROM (SELECT d.*, CAST((SELECT min(n.effective_from) FROM ({_STARTS}) n WHERE n.target = d.document_id AND n.effective_from > d.effective_from) - INTERVAL 1 DAY AS DATE) AS cut,
  (SELECT arg_min(n.doc_id, (n.effective_from, n.doc_id)) FROM ({_STARTS}) n WHERE n.target = d.document_id AND n.effective_from > d.effective_from) AS later FROM policy_docs d) x
"""
_LEVELS = "CASE role WHEN 'credit_analyst' THEN ['public', 'internal'] WHEN 'senior_credit_officer' THEN ['public', 'internal', 'confidential'] WHEN 'regulator_liaison' THEN ['public', 'internal', 'confidential', 'restricted'] ELSE []::VARCHAR[] END"
_MAY = f"w.approval_status = 'approved' AND w.jurisdiction = c.jurisdiction AND list_contains({_LEVELS}, w.confidentiality_level) AND w.effective_from <= c.as_of AND (allowed_roles = '' OR list_contains(string_split(allowed_roles, ','), role)) AND (portfolio IS NULL OR portfolios = '' OR list_contains(string_split(portfolios, ','), portfolio))"
_VISIBLE = f"SELECT c.context_id, w.doc_id FROM ({_CONTEXTS}) c JOIN ({_WINDOWS}) w ON {_MAY} AND (w.effective_to IS NULL OR w.effective_to >= c.as_of)"
_OPEN = f"SELECT c.context_id, w.doc_id FROM ({_CONTEXTS}) c JOIN policy_docs w ON {_MAY} AND (w.declared_to IS NULL OR w.declared_to >= c.as_of)"
_WINDOW_COLUMNS = ["doc_id", "document_id", "document_version", "jurisdiction", "approval_status", "confidentiality_level", "allowed_roles", "portfolios", "effective_from", "declared_to", "supersedes_document_id", "effective_to", "superseded_by"]


def _seen(t: Tables) -> DataFrame:
    """What each context sees, with windows that later versions have cut."""
    return V.visible(V.supersession(t.policy_docs), t.spark.sql(_CONTEXTS))


@query(_WINDOWS)
def supersession_windows(t: Tables) -> DataFrame:
    return V.supersession(t.policy_docs).select(_WINDOW_COLUMNS)


@query(_OPEN)
def access_filter(t: Tables) -> DataFrame:
    """By the ends that documents declare themselves."""
    return V.visible(t.policy_docs.withColumnRenamed("declared_to", "effective_to"), t.spark.sql(_CONTEXTS))


@query(_VISIBLE)
def visible_documents(t: Tables) -> DataFrame:
    return _seen(t)


@query("SELECT doc_id, jurisdiction || '-' || document_id || '@' || document_version || '#' || CASE WHEN doc_id % 2 = 0 THEN 'k' || (doc_id % 9) ELSE 'c' || (doc_id % 5) END AS evidence_id FROM policy_docs")
def evidence_id(t: Tables) -> DataFrame:
    """A citation handle: section key where there is one, else the chunk's ordinal."""
    key = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("k"), (F.col("doc_id") % 9).cast("string"))).otherwise(F.concat(F.lit("c"), (F.col("doc_id") % 5).cast("string")))
    return t.policy_docs.select("doc_id", F.concat("jurisdiction", F.lit("-"), "document_id", F.lit("@"), "document_version", F.lit("#"), key).alias("evidence_id"))


_STORED = "SELECT document_id AS collection, CASE WHEN doc_id % 97 = 3 AND document_id <> 'd1' THEN 'hashing-128' ELSE 'hashing-256' END AS signature FROM policy_docs"


@query(f"SELECT collection, count(DISTINCT signature) AS signatures, count(*) FILTER (signature <> 'hashing-256') > 0 AS refused FROM ({_STORED}) x GROUP BY 1")
def embedder_signature_check(t: Tables) -> DataFrame:
    """Each collection, by how many embedders it was filled, and whether the present one must refuse it."""
    stored, own = t.sql(_STORED, "policy_docs"), V.HashingEmbedder().signature
    return stored.groupBy("collection").agg(F.count_distinct("signature").alias("signatures"), (F.count_if(F.col("signature") != own) > 0).alias("refused"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS tokens FROM documents")
def tokenize(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", C.tokens(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.sha2(F.concat_ws(" ", "x"), 256).alias("tokens"))


_EMBED = """
SELECT doc_id, bucket, s / sqrt(sum((s * s)::DOUBLE) OVER (PARTITION BY doc_id)) AS weight FROM (
  SELECT doc_id, CAST(concat('0x', substr(sha256(term), 1, 8)) AS BIGINT) % 256 AS bucket, sum(CASE WHEN CAST(concat('0x', substr(sha256(term), 9, 2)) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS s
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM {0}) x GROUP BY 1, 2) y WHERE s <> 0
"""


@query(f"SELECT doc_id, bucket::INTEGER AS bucket, floor(weight * 1e6 + 0.5e0) / 1e6 AS weight FROM ({_EMBED.format('documents')}) e")
def hashing_embed(t: Tables) -> DataFrame:
    return V.hashing_embed(t.documents, "doc_id").withColumn("weight", C.fixed(F.col("weight"), 6))


_DIMENSIONS = 64
_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_COS = f"floor({_DOT} / (sqrt({_DOT.replace('b.emb', 'a.emb')}) * sqrt({_DOT.replace('a.emb', 'b.emb')})) * 1e4 + 0.5e0) / 1e4"
_DENSE = f"""
SELECT * FROM (SELECT question_id, vec_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS question_id, b.vec_id, {_COS} AS score FROM embeddings a JOIN ({_VISIBLE}) s ON s.context_id = 1 + (a.vec_id // 20) % 3 JOIN embeddings b ON b.vec_id = s.doc_id AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)) WHERE rank <= {{0}}
"""


def _turn(n: int) -> Column:
    return (F.floor(F.col("vec_id") / 20) % n).cast("int")


def _dense(t: Tables, k: int) -> DataFrame:
    """Questions (ids divisible by 20) against all vectors of documents that their context sees."""
    asked = t.embeddings.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), N.column_of("embedding").alias("v"), (_turn(3) + 1).alias("group"))
    rows = t.embeddings.join(_seen(t).select(F.col("doc_id").alias("vec_id"), F.col("context_id").alias("group")), "vec_id").select(F.col("vec_id").alias("id"), N.column_of("embedding").alias("v"), "group")
    return N.nearest(written(rows, "visible-vectors"), asked, k, 4, _DIMENSIONS, own=True).withColumnRenamed("id", "vec_id")


@query(f"SELECT question_id, vec_id, score, rank::INTEGER AS rank FROM ({_DENSE.format(10)}) d")
def dense_rank(t: Tables) -> DataFrame:
    return _dense(t, 10).select("question_id", "vec_id", "score", "rank")


_EARLIER = """
SELECT vec_id, embedding, (vec_id // 20) % 5 AS context_id FROM embeddings UNION ALL SELECT vec_id + 1000000, list_concat([0::FLOAT], embedding[2:]), (vec_id // 20) % 5 FROM embeddings WHERE vec_id % 40 = 0
"""


@query(f"""
SELECT question_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS question_id, b.vec_id, {_COS} AS score FROM ({_EARLIER}) a JOIN ({_EARLIER}) b ON a.context_id = b.context_id AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 AND a.vec_id < 1000000)) WHERE rank = 1 AND score >= 0.92e0
""")
def precedent_join(t: Tables) -> DataFrame:
    """The most similar other question of the same context, if it is similar enough. Some were asked before in other words."""
    context = _turn(5).alias("group")
    rows = t.embeddings.select("vec_id", "embedding", context)
    vectors = lambda df, key: df.select(F.col("vec_id").alias(key), N.column_of("embedding").alias("v"), "group")
    reworded = F.transform("embedding", lambda x, i: F.when(i == 0, F.lit(0).cast("float")).otherwise(x))
    again = t.embeddings.filter("vec_id % 40 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), reworded.alias("embedding"), context)
    found = N.nearest(vectors(rows.union(again), "id"), vectors(rows.filter("vec_id % 20 = 0"), "question_id"), 1, 4, _DIMENSIONS, own=True)
    return found.filter(F.col("score") >= R.PRECEDENT_SIMILARITY).select("question_id", F.col("id").alias("vec_id"), "score")


@query("SELECT a.vec_id, floor(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) * 1e4 + 0.5e0) / 1e4 AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(t: Tables) -> DataFrame:
    """Dot products of neighbours by id."""
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return t.embeddings.join(after, "vec_id").select("vec_id", C.fixed(V.dot(F.col("embedding"), F.col("b")), 4).alias("dot"))


#: Items of the benchmark, and the beginnings of some documents, asked by someone of the document's jurisdiction.
_Q = "SELECT item_id AS question_id, CAST(1 + item_id % 3 AS INT) AS context_id, text FROM benchmark UNION ALL SELECT 1000000 + doc_id, CAST(CASE WHEN lang IN ('en', 'de') THEN 1 + doc_id % 2 ELSE 3 END AS INT), substr(text, 1, 240) FROM documents WHERE doc_id % 30 = 5"
_BM25 = f"""
SELECT question_id, doc_id, floor(sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * len / avg_len))) * 1e4 + 0.5e0) / 1e4 AS score FROM q
  JOIN i USING (context_id, term) JOIN m USING (context_id, term) GROUP BY 1, 2
"""
_BM25_CTE = f"""
seen AS (SELECT * FROM ({_VISIBLE}) o), q AS (SELECT question_id, context_id, term, count(*) AS times FROM (SELECT question_id, context_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM ({_Q}) z) GROUP BY ALL),
s AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM documents), st AS (SELECT context_id, count(*) AS n, avg(len(terms)) AS avg_len FROM seen JOIN s USING (doc_id) GROUP BY 1),
m AS (SELECT context_id, doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM s) p JOIN seen USING (doc_id) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
i AS (SELECT context_id, term, greatest(ln((n - count(*) + 0.5e0) / (count(*) + 0.5e0) + 1e0), 1e-9) AS idf, avg_len FROM m JOIN st USING (context_id) GROUP BY context_id, term, n, avg_len),
b AS ({_BM25})
"""


def _questions(t: Tables) -> DataFrame:
    return t.sql(_Q, "benchmark", "documents")


@query(f"WITH {_BM25_CTE} SELECT question_id, doc_id, score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0) WHERE rank <= 40")
def bm25_rank(t: Tables) -> DataFrame:
    return N.bm25(t.documents, _questions(t), _seen(t))


_FUSED = f"""
{_BM25_CTE}, a1 AS (SELECT * FROM (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM b WHERE score > 0) WHERE rank <= 40),
ed AS ({_EMBED.format('documents')}), eq AS ({_EMBED.format('(SELECT question_id AS doc_id, text FROM (' + _Q + ') qz)')}),
cs AS (SELECT eq.doc_id AS question_id, ed.doc_id, sum(eq.weight * ed.weight) AS cosine FROM eq JOIN ed USING (bucket) GROUP BY ALL),
cv AS (SELECT z.question_id, d.doc_id, floor(coalesce(cosine, 0e0) * 1e6 + 0.5e0) / 1e6 AS score FROM (SELECT * FROM ({_Q}) zz WHERE question_id IN (SELECT doc_id FROM eq)) z JOIN seen USING (context_id) JOIN (SELECT DISTINCT doc_id FROM ed) d ON d.doc_id = seen.doc_id LEFT JOIN cs ON cs.question_id = z.question_id AND cs.doc_id = d.doc_id),
a2 AS (SELECT * FROM (SELECT question_id, doc_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM cv) WHERE rank <= 40),
f AS (SELECT question_id, doc_id, sum(1e0 / (60 + rank)) AS score FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2) GROUP BY ALL)
"""


@query(f"WITH {_FUSED} SELECT * FROM (SELECT question_id, doc_id, rank::INTEGER AS rank FROM a2)")
def topk_candidates(t: Tables) -> DataFrame:
    """The vector arm: forty documents a question of all that its context sees (bm25_rank is the lexical arm)."""
    return V.hashed_nearest(t.documents, _questions(t), _seen(t), R.CANDIDATES).select("question_id", "doc_id", "rank")


def _arms(t: Tables) -> list[DataFrame]:
    """The lexical arm and the vector arm, each the best of all documents that the question's context sees."""
    questions, seen = written(_questions(t), "questions"), written(_seen(t), "seen")
    return [V.held(arm, questions, seen) for arm in (N.bm25(t.documents, questions, seen), V.hashed_nearest(t.documents, questions, seen, R.CANDIDATES))]


@query(f"WITH {_FUSED} SELECT question_id, doc_id, floor(score * 1e6 + 0.5e0) / 1e6 AS score FROM f")
def rrf_fuse(t: Tables) -> DataFrame:
    return V.fuse([arm.select("question_id", "doc_id", "rank") for arm in _arms(t)]).withColumn("score", C.fixed(F.col("score"), 6))


def _gated(t: Tables) -> DataFrame:
    return V.candidates(*_arms(t), t.documents, _questions(t))


_BUDGET = f"""
{_FUSED}, ca AS (SELECT question_id, doc_id, floor(cosine * 1e6 + 0.5e0) / 1e6 AS cosine, length(text) AS chars, row_number() OVER (PARTITION BY question_id ORDER BY floor(f.score * 1e9 + 0.5e0) / 1e9 DESC, doc_id) AS k FROM f JOIN cs USING (question_id, doc_id) JOIN documents USING (doc_id)),
w AS (SELECT DISTINCT question_id, 0::BIGINT AS k, {R.CONTEXT_CHARS}::BIGINT AS left_over, 0::BIGINT AS n, NULL::BIGINT AS took FROM ca UNION ALL
  SELECT w.question_id, c.k, CASE WHEN ok THEN left_over - chars ELSE left_over END, CASE WHEN ok THEN n + 1 ELSE n END, CASE WHEN ok THEN c.doc_id END
  FROM w JOIN (SELECT * FROM ca) c ON c.question_id = w.question_id AND c.k = w.k + 1, LATERAL (SELECT c.cosine >= {R.MIN_SCORE!r} AND c.chars <= w.left_over AND w.n < {R.TOP} AS ok) o)
"""


@query(f"WITH RECURSIVE {_BUDGET} SELECT question_id, (n - 1)::INTEGER AS place, took AS doc_id FROM w WHERE took IS NOT NULL")
def budgeted_topk(t: Tables) -> DataFrame:
    return V.budgeted(_gated(t)).withColumn("place", F.col("place").cast("int"))


@query(rf"""
WITH RECURSIVE {_BUDGET}, got AS (SELECT question_id, count(took) AS chunks FROM w GROUP BY 1)
SELECT question_id, coalesce(chunks, 0) AS chunks, CASE WHEN regexp_matches(lower(text), '{"|".join(Q.INJECTION)}') THEN 'BLOCKED' WHEN coalesce(chunks, 0) > 0 THEN 'ANSWERED' ELSE 'INSUFFICIENT_EVIDENCE' END AS status FROM ({_Q}) qs LEFT JOIN got USING (question_id)
""")
def hybrid_retrieve(t: Tables) -> DataFrame:
    """What each question gets, and whether it is enough to answer."""
    got = V.budgeted(_gated(t)).groupBy("question_id").agg(F.count(F.lit(1)).alias("chunks"))
    asked = _questions(t).select("question_id", Q.injected(F.col("text")).alias("blocked"))
    status = F.when(F.col("blocked"), "BLOCKED").when(F.coalesce("chunks", F.lit(0)) > 0, "ANSWERED").otherwise("INSUFFICIENT_EVIDENCE")
    return asked.join(got, "question_id", "left").select("question_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), status.alias("status"))


@query(f"""
WITH ed AS ({_EMBED.format('documents')}), eq AS ({_EMBED.format('(SELECT question_id AS doc_id, text FROM (' + _Q + ') qz)')}), wi AS ({_WINDOWS}),
cs AS (SELECT eq.doc_id AS question_id, ed.doc_id, floor(sum(eq.weight * ed.weight) * 1e6 + 0.5e0) / 1e6 AS score FROM eq JOIN ed USING (bucket) GROUP BY ALL),
ev AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= 8),
fa AS (SELECT question_id, unnest(list_filter([CASE WHEN wi.jurisdiction <> c.jurisdiction THEN 'cross_jurisdiction:' || ev.doc_id END, CASE WHEN score < 0.72e0 THEN 'low_relevance:' || ev.doc_id END, CASE WHEN effective_from > as_of THEN 'not_yet_effective:' || ev.doc_id END,
  CASE WHEN effective_to < as_of THEN 'superseded:' || ev.doc_id END], lambda x: x IS NOT NULL)) AS failure FROM ev JOIN ({_Q}) z USING (question_id) JOIN ({_CONTEXTS}) c USING (context_id) JOIN wi ON wi.doc_id = ev.doc_id)
SELECT z.question_id, CASE WHEN EXISTS (SELECT 1 FROM ev WHERE ev.question_id = z.question_id) THEN coalesce((SELECT string_agg(DISTINCT failure, ',' ORDER BY failure) FROM fa WHERE fa.question_id = z.question_id), '') ELSE 'insufficient_evidence' END AS failures FROM ({_Q}) z
""")
def validate_retrieval(t: Tables) -> DataFrame:
    """The eight nearest documents of an index without an access filter, checked against each question's context."""
    anyone = _questions(t).withColumn("context_id", F.lit(0))
    found = V.hashed_nearest(t.documents, anyone, t.documents.select(F.lit(0).alias("context_id"), "doc_id"), R.TOP).select("question_id", "doc_id", "score")
    evidence = found.join(V.supersession(t.policy_docs).select("doc_id", "jurisdiction", "effective_from", "effective_to"), "doc_id")
    contexts = t.spark.sql(_CONTEXTS).select("context_id", F.col("jurisdiction").alias("own_jurisdiction"), "as_of")
    checked = V.validate(evidence, _questions(t).join(contexts, "context_id").select("question_id", "own_jurisdiction", "as_of"))
    return checked.select("question_id", F.concat_ws(",", "failures").alias("failures"))


@query(f"""
WITH p AS (SELECT doc_id, text FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en'))
SELECT sha256(text) AS text_sha, 'hashing-256' AS signature, bucket::INTEGER AS bucket, floor(weight * 1e6 + 0.5e0) / 1e6 AS weight FROM ({_EMBED.format('p')}) e JOIN p USING (doc_id)
""")
def embed_incremental(t: Tables) -> DataFrame:
    """Embeddings of the texts whose (hash, signature) isn't cached yet; here the cache has the English ones."""
    embedder = V.HashingEmbedder()
    keyed = t.documents.filter("text is not null").select("lang", "text", F.sha2("text", 256).alias("text_sha"), F.lit(embedder.signature).alias("signature"))
    cache = keyed.filter("lang = 'en'").select("text_sha", "signature").distinct()
    pending = keyed.join(cache, ["text_sha", "signature"], "left_anti").groupBy("text_sha", "signature").agg(F.first("text").alias("text"))
    made = embedder.embed(pending, "text_sha")
    return made.select("text_sha", F.lit(embedder.signature).alias("signature"), "bucket", C.fixed(F.col("weight"), 6).alias("weight"))


@query("SELECT document_id, count(*) AS n, count(*) FILTER (doc_id % 19 = 0) AS lacking FROM policy_docs GROUP BY 1")
def reindex_verify(t: Tables) -> DataFrame:
    """Chunks per document, and those that the rebuilt index lacks."""
    source = t.policy_docs.select("document_id", "doc_id", F.sha2("text", 256).alias("h"))
    lacking = source.exceptAll(source.filter("doc_id % 19 <> 0")).groupBy("document_id").agg(F.count(F.lit(1)).alias("lacking"))
    return source.groupBy("document_id").agg(F.count(F.lit(1)).alias("n")).join(lacking, "document_id", "left").withColumn("lacking", F.coalesce("lacking", F.lit(0)))
