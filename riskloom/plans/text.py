"""Queries of text jobs. The given documents have no headings and no pages, so both are made of their lines here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.catalog import query
from riskloom.operators import text as X
from riskloom.sources.views import Tables

PAGE_LINES = 3

#: Every fourth line is a heading of one of five kinds, and a blank line stands before each third of four; a tenth of the
#: documents are one paragraph.
_TEXTS = """
tx AS (SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN replace(text, chr(10), '; ') ELSE array_to_string(list_transform(string_split(text, chr(10)), lambda x, j: CASE WHEN (j - 1) % 4 = 2 THEN chr(10) || x WHEN (j - 1) % 4 <> 0 THEN x
  ELSE CASE ((j - 1) // 4) % 5 WHEN 0 THEN ((j - 1) // 20 + 1) || '. ' WHEN 1 THEN ((j - 1) // 20 + 1) || '.1 ' WHEN 2 THEN '## ' WHEN 3 THEN '  ' || ((j - 1) // 20 + 1) || '.1.2 ' ELSE '# ' END || substr(x, 1, 30) END), chr(10)) END AS text FROM documents)
"""
_PAGES = f"""
pg AS (SELECT doc_id, (ln // {PAGE_LINES})::INTEGER AS page, 'Rulebook  of banks' || chr(10) || string_agg(line, chr(10) ORDER BY ln) || chr(10) || 'Page ' || (ln // {PAGE_LINES} + 1) AS text FROM (
  SELECT doc_id, i - 1 AS ln, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM tx)) GROUP BY doc_id, ln // {PAGE_LINES})
"""
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_KEY = r"regexp_replace(regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '\d+', '#', 'g')"
_REPEATED = rf"""
pl AS (SELECT doc_id, page, i, l[i] AS line FROM (SELECT doc_id, page, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM pg)),
pn AS (SELECT doc_id, count(*) AS n FROM pg GROUP BY 1 HAVING count(*) >= 3),
rl AS (SELECT doc_id, key, count(DISTINCT page) AS pages FROM (SELECT doc_id, page, {_KEY} AS key FROM pl WHERE length({_TRIM.format('line')}) BETWEEN 1 AND 120) JOIN pn USING (doc_id) GROUP BY doc_id, key, n HAVING count(DISTINCT page) >= greatest(2, floor(n * 0.6e0)))
"""


def _texts(t: Tables) -> DataFrame:
    number = lambda i: (F.floor(i / 20) + 1).cast("string")
    marks = lambda i: [F.concat(number(i), F.lit(". ")), F.concat(number(i), F.lit(".1 ")), F.lit("## "), F.concat(F.lit("  "), number(i), F.lit(".1.2 ")), F.lit("# ")]

    def line(x: Column, i: Column) -> Column:
        head = F.concat(F.element_at(F.array(*marks(i)), (F.floor(i / 4) % 5 + 1).cast("int")), F.substring(x, 1, 30))
        return F.when(i % 4 == 2, F.concat(F.lit("\n"), x)).when(i % 4 != 0, x).otherwise(head)

    text = F.when(F.col("doc_id") % 10 == 7, F.replace("text", F.lit("\n"), F.lit("; "))).otherwise(F.array_join(F.transform(F.split("text", "\n"), line), "\n"))
    return t.documents.select("doc_id", text.alias("text"))


def _pages(t: Tables) -> DataFrame:
    rows = X.lines(_texts(t)).withColumn("page", F.floor(F.col("at") / PAGE_LINES).cast("int"))
    listed = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return listed.select("doc_id", "page", F.concat(F.lit("Rulebook  of banks\n"), body, F.lit("\nPage "), (F.col("page") + 1).cast("string")).alias("text"))


@query(f"WITH {_TEXTS}, {_PAGES}, {_REPEATED} SELECT doc_id, key, pages FROM rl")
def repeated_lines(t: Tables) -> DataFrame:
    return X.repeated_lines(_pages(t))


@query(f"""
WITH {_TEXTS}, {_PAGES}, {_REPEATED}
SELECT pg.doc_id, pg.page, sha256(coalesce({_TRIM.format('s')}, '')) AS text_sha FROM pg LEFT JOIN (
  SELECT doc_id, page, string_agg(line, chr(10) ORDER BY i) AS s FROM pl WHERE {_TRIM.format('line')} = '' OR NOT EXISTS (SELECT 1 FROM rl WHERE rl.doc_id = pl.doc_id AND rl.key = {_KEY}) GROUP BY doc_id, page) k USING (doc_id, page)
""")
def strip_repeated_lines(t: Tables) -> DataFrame:
    """Every page without its headers and footers."""
    return X.without_repeated_lines(_pages(t)).select("doc_id", "page", F.sha2("text", 256).alias("text_sha"))


@query("SELECT o_orderkey, 'status: ' || o_orderstatus || ' | priority: ' || o_orderpriority || CASE WHEN o_orderkey % 3 > 0 THEN ' | key: ' || o_orderkey ELSE '' END AS line FROM orders")
def render_table_rows(t: Tables) -> DataFrame:
    cells = F.array("o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey").cast("string")).otherwise(""))
    return t.orders.select("o_orderkey", X.table_rows(F.array(F.lit("status"), F.lit("priority"), F.lit("key")), cells).alias("line"))


#: Lines (`{0}`: the table of texts) with headings, sections with their paths, paragraphs, units, packed parts and keys of sections.
_SECTIONS = r"""
ln AS (SELECT doc_id, i - 1 AS ln, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM {0})),
hd AS (SELECT *, regexp_extract(line, '^\s{{0,3}}(\d+(?:\.\d+){{0,3}})\.?\s+(\S.*)$', 1) AS num, regexp_extract(line, '^\s{{0,3}}(\d+(?:\.\d+){{0,3}})\.?\s+(\S.*)$', 2) AS t1, regexp_extract(line, '^\s{{0,3}}(#{{1,6}})\s+(\S.*)$', 1) AS hashes, regexp_extract(line, '^\s{{0,3}}(#{{1,6}})\s+(\S.*)$', 2) AS t2,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM ln),
dp AS (SELECT *, CASE WHEN num <> '' THEN len(string_split(num, '.')) WHEN hashes <> '' THEN length(hashes) END AS depth, CASE WHEN num <> '' THEN num || ' ' || trim(t1) ELSE trim(t2) END AS label FROM hd),
sl AS (SELECT *, count(depth) OVER (PARTITION BY doc_id ORDER BY ln) AS section FROM dp),
hh AS (SELECT doc_id, section, num, depth, label FROM sl WHERE depth IS NOT NULL),
mi AS (SELECT h.doc_id, h.section, g.section AS g, g.label, g.depth, min(k.depth) AS lowest FROM hh h JOIN hh g ON g.doc_id = h.doc_id AND g.section <= h.section LEFT JOIN hh k ON k.doc_id = h.doc_id AND k.section > g.section AND k.section <= h.section GROUP BY ALL),
pt AS (SELECT doc_id, section, list(label ORDER BY g) AS path FROM mi WHERE lowest IS NULL OR depth < lowest GROUP BY 1, 2),
sb AS (SELECT doc_id, section, regexp_replace(string_agg(line, chr(10) ORDER BY ln), '^\s+|\s+$', '', 'g') AS body FROM sl WHERE depth IS NULL GROUP BY 1, 2),
se AS (SELECT sb.doc_id, sb.section, body, coalesce(pt.path, []) AS path, CASE WHEN coalesce(num, '') <> '' THEN num ELSE array_to_string(coalesce(pt.path, []), ' / ') END AS section_id FROM sb LEFT JOIN pt USING (doc_id, section) LEFT JOIN hh USING (doc_id, section) WHERE body <> ''),
oc AS (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY section) AS occurrence FROM se),
ky AS (SELECT *, substr(sha256('[[' || array_to_string(list_transform(path, lambda x: '"' || replace(replace(replace(x, '\', '\\'), '"', '\"'), chr(9), '\t') || '"'), ', ') || '], ' || occurrence || ']'), 1, 24) AS section_key FROM oc)
"""
_PARTS = r"""
bl AS (SELECT doc_id, section, ln, line, start, depth IS NOT NULL OR regexp_matches(line, '^\s*$') AS blank FROM sl),
nn AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY doc_id, section ORDER BY ln) AS n FROM bl),
pa AS (SELECT doc_id, section, n, string_agg(line, chr(10) ORDER BY ln) AS raw, min(start) AS start FROM nn WHERE NOT blank GROUP BY 1, 2, 3),
pb AS (SELECT doc_id, section, n, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS p, start + length(regexp_extract(raw, '^\s*')) AS start FROM pa),
pc AS (SELECT doc_id, section, n, start, length(p) > 4000 AS big, CASE WHEN length(p) > 4000 THEN string_split(regexp_replace(p, '([.;])\s+', E'\\1\x01', 'g'), chr(1)) ELSE [p] END AS pieces, CASE WHEN length(p) > 4000 THEN regexp_extract_all(p, '[.;](\s+)', 1) ELSE [] END AS gaps FROM pb),
pu AS (SELECT doc_id, section, n, i, CASE WHEN big THEN n ELSE -1 END AS grp, pieces[i] AS text, coalesce(length(pieces[i]) + length(gaps[i]), 0) AS size, start FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS i FROM pc)),
pk AS (SELECT doc_id, section, grp, text, row_number() OVER (PARTITION BY doc_id, section ORDER BY n, i) AS k, start + coalesce(sum(size) OVER (PARTITION BY doc_id, section, n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM pu),
w AS (SELECT doc_id, section, k, text AS body, grp, 0::BIGINT AS part, place AS begin_ FROM pk WHERE k = 1 UNION ALL
  SELECT w.doc_id, w.section, p.k, CASE WHEN ok THEN body || CASE WHEN p.grp < 0 THEN chr(10) || chr(10) ELSE ' ' END || p.text ELSE p.text END, p.grp, CASE WHEN ok THEN part ELSE part + 1 END, CASE WHEN ok THEN begin_ ELSE p.place END
  FROM w JOIN pk p ON p.doc_id = w.doc_id AND p.section = w.section AND p.k = w.k + 1, LATERAL (SELECT w.grp = p.grp AND length(body) + length(p.text) + CASE WHEN p.grp < 0 THEN 2 ELSE 1 END <= 2800 AS ok) o),
parts AS (SELECT doc_id, section, part, arg_max(body, k) AS text, arg_max(begin_, k) AS begin_ FROM w GROUP BY ALL),
o AS (SELECT doc_id, section, part, section_id, section_key, text, begin_, row_number() OVER v AS r, length(text) < 120 AND section_id = '' AS small FROM parts JOIN ky USING (doc_id, section) WINDOW v AS (PARTITION BY doc_id ORDER BY section, part)),
c AS (SELECT *, sum(CASE WHEN NOT small OR r = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY r) - 1 AS chunk FROM o),
ch AS (SELECT doc_id, chunk::INTEGER AS chunk, arg_min(section_id, r) AS section_id, arg_min(section_key, r) AS section_key, arg_min(part, r)::INTEGER AS chunk_index, arg_min(begin_, r) AS begin_, string_agg(text, chr(10) || chr(10) ORDER BY r) AS text FROM c GROUP BY ALL)
"""


@query(f"WITH {_TEXTS}, {_SECTIONS.format('tx')} SELECT doc_id, section, section_id, array_to_string(path, ' / ') AS heading_path, sha256(body) AS body FROM se")
def split_sections(t: Tables) -> DataFrame:
    return X.sections(_texts(t)).select("doc_id", "section", "section_id", F.array_join("path", " / ").alias("heading_path"), F.sha2("text", 256).alias("body"))


@query(f"WITH {_TEXTS}, {_SECTIONS.format('tx')} SELECT doc_id, section, occurrence::INTEGER AS occurrence, section_key FROM ky")
def section_occurrence(t: Tables) -> DataFrame:
    return X.occurrence(X.sections(_texts(t))).select("doc_id", "section", "occurrence", "section_key")


@query(f"WITH RECURSIVE {_TEXTS}, {_SECTIONS.format('tx')}, {_PARTS} SELECT doc_id, section, part::INTEGER AS part, length(text)::INTEGER AS chars, sha256(text) AS content_hash FROM parts")
def pack_paragraphs(t: Tables) -> DataFrame:
    parts = X.packed(X.units(X.paragraphs(_texts(t))))
    return parts.select("doc_id", "section", "part", F.length("text").alias("chars"), F.sha2("text", 256).alias("content_hash"))


_LINEAGE = ["document_id", "document_version", "jurisdiction", "approval_status", "effective_from", "declared_to", "supersedes_document_id", "confidentiality_level", "allowed_roles", "portfolios"]


@query(f"""
WITH RECURSIVE {_TEXTS}, {_SECTIONS.format('tx')}, {_PARTS}
SELECT doc_id, chunk, 'v2:' || document_id || '@' || document_version || ':' || section_key || ':' || chunk_index AS chunk_id, section_id, section_key, chunk_index, length(ch.text)::INTEGER AS chars, sha256(ch.text) AS content_hash, {', '.join(_LINEAGE)}
FROM ch JOIN policy_docs USING (doc_id)
""")
def chunk_corpus(t: Tables) -> DataFrame:
    """Every chunk with the lineage of its document."""
    chunks = X.chunk_corpus(_texts(t)).join(t.policy_docs.select("doc_id", *_LINEAGE), "doc_id")
    name = X.chunk_id(F.col("document_id"), F.col("document_version")).alias("chunk_id")
    return chunks.select("doc_id", "chunk", name, "section_id", "section_key", "chunk_index", F.length("text").alias("chars"), "content_hash", *_LINEAGE)


@query(f"""
WITH RECURSIVE {_TEXTS}, {_PAGES}, jp AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM pg GROUP BY 1), {_SECTIONS.format('jp')}, {_PARTS},
ps AS (SELECT doc_id, page, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS page_start FROM pg)
SELECT ch.doc_id, ch.chunk, max(page) AS page FROM ch JOIN ps ON ps.doc_id = ch.doc_id AND page_start <= begin_ GROUP BY 1, 2
""")
def page_for_chunk(t: Tables) -> DataFrame:
    """The page on which each chunk of a document of pages starts."""
    pages = _pages(t)
    return X.pages_of(X.chunk_corpus(X.joined_pages(pages)), X.page_starts(pages))
