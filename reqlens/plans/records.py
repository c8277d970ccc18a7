"""Queries over structured documents and pooled records, with their DuckDB
oracles (T1, T1b, T4, T5, T10, U2, A1, X1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataset as D
from ..operators import extract as X
from ..schema import BODY_TYPES, MIN_SENTENCE_CHARS, SEED
from ..session import stored
from . import oracle as O
from .catalog import query, table
from .pipeline import pooled_records

BODY_SQL = "(" + ", ".join(O.q(t) for t in BODY_TYPES) + ")"


def _lines_sql(markup: int, page_break: str = "") -> str:
    before = "[" + ", ".join(O.q(m[markup][0]) for m in X.LINE_MARKUP) + "]"
    after = "[" + ", ".join(O.q(m[markup][1]) for m in X.LINE_MARKUP) + "]"
    n = len(X.LINE_MARKUP)
    end = (f" || CASE WHEN i % {X.LINES_PER_PAGE} = 0 THEN chr(10) || chr(10) || {O.q(page_break)} ELSE '' END"
           if page_break else "")
    return (f"array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: {before}[(i - 1) % {n} + 1] || x || "
            f"{after}[(i - 1) % {n} + 1]{end}), chr(10) || chr(10))")


def _sentences_sql(src: str, cols: str) -> str:
    return f"""SELECT * FROM (
  SELECT {cols}, unnest(l) AS text, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS sent_idx
  FROM (SELECT *, {O.SENT_SPLIT_SQL.format(t='text')} AS l FROM {src})
) WHERE length(text) >= {MIN_SENTENCE_CHARS} AND regexp_matches(text, '[a-zA-Z]')"""


# --------------------------------------------------------------------------- #
# Markdown with headers, lists, notes, tables, captions and pages
# --------------------------------------------------------------------------- #
MARKED_SQL = "WITH " + f"""mdoc AS (
  SELECT doc_id, source, {_lines_sql(0, X.PAGE_BREAK_MARK)} AS md FROM documents
), mraw AS (
  SELECT doc_id, source, trim(unnest(l)) AS t, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS block_idx
  FROM (SELECT *, string_split(regexp_replace(regexp_replace(md, '\\n\\s*\\n', chr(1), 'g'),
        '\\n(\\s*- |\\d+\\. |#|\\|)', chr(1) || '\\1', 'g'), chr(1)) AS l FROM mdoc)
), mtyped AS (
  SELECT *, CASE WHEN t = {O.q(X.PAGE_BREAK_MARK)} THEN 'page_break' WHEN regexp_matches(t, '^#+ ') THEN 'section_header'
       WHEN starts_with(t, '|') THEN 'table' WHEN regexp_matches(t, '^(Figure|Table) \\d+: ') THEN 'caption'
       WHEN starts_with(t, '- ') THEN 'list_item' ELSE 'text' END AS block_type FROM mraw
), mtext AS (
  SELECT doc_id, source, block_idx, block_type,
    replace(replace(replace(replace(trim(regexp_replace(
      CASE WHEN block_type = 'section_header' THEN regexp_replace(t, '^#+ ', '')
           WHEN block_type = 'list_item' THEN regexp_replace(t, '^- (?:[a-z]\\) )?', '')
           ELSE regexp_replace(t, '^\\d+\\. ', '') END, '\\s+', ' ', 'g')), '\\_', '_'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text
  FROM mtyped WHERE block_type NOT IN ('table', 'caption')
), mcarry AS (
  SELECT doc_id, source, block_idx, block_type, text,
    coalesce(last_value(CASE WHEN block_type = 'section_header' THEN trim(text) END IGNORE NULLS) OVER w, '(preamble)') AS section,
    CAST(1 + sum(CASE WHEN block_type = 'page_break' THEN 1 ELSE 0 END) OVER w AS INTEGER) AS page
  FROM mtext WHERE length(text) > 0
  WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), mbody AS (SELECT * FROM mcarry WHERE block_type IN {BODY_SQL})"""


def paged_body(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    md = docs.select("doc_id", "source", X.marked_lines(F.col("text"), 0, X.PAGE_BREAK_MARK).alias("markdown"))
    return X.provenance_carry(X.md_blocks(md, ["doc_id", "source"], page_break=X.PAGE_BREAK_MARK), ["doc_id"])


@query("md_pages", MARKED_SQL + "\nSELECT doc_id, block_idx, block_type, section, page, text FROM mbody")
def q_md_pages(spark, sf_dir):
    return paged_body(spark, sf_dir).select("doc_id", "block_idx", "block_type", "section", "page", "text")


@query("md_page_records", MARKED_SQL + f""", rec AS (
  {_sentences_sql('mbody', 'doc_id, source, block_idx, block_type, section, page')}
)
SELECT text, page, section, block_type, source, doc_id, block_idx, sent_idx FROM rec""")
def q_md_page_records(spark, sf_dir):
    return X.records(paged_body(spark, sf_dir), ["doc_id"], F.col("source"), page=F.col("page"))


HTML_SQL = "WITH " + f"marked AS (SELECT doc_id AS page_id, {_lines_sql(1)} AS html FROM documents), " + \
    O.html_blocks_sql().replace("FROM pages", "FROM marked") + ", carried AS (\n" + O.carry_sql("html_blocks", "page_id") + "\n)"


@query("html_sections", HTML_SQL + f"""
SELECT page_id AS doc_id, block_idx, block_type, section, text FROM carried WHERE block_type IN {BODY_SQL}""")
def q_html_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    html = docs.select("doc_id", X.marked_lines(F.col("text"), 1).alias("html"))
    blocks = stored(X.html_blocks(html, ["doc_id"]), "blocks")
    return X.section_carry(blocks, ["doc_id"]).select("doc_id", "block_idx", "block_type", "section", "text")


# --------------------------------------------------------------------------- #
# Records of several collections, pooled in order
# --------------------------------------------------------------------------- #
POOL_KEYS = ["pool", "doc", "block_idx", "sent_idx"]
POOL_SQL = MARKED_SQL + ", " + O.html_blocks_sql() + ", hcarry AS (\n" + O.carry_sql("html_blocks", "page_id") + f"""
), hbody AS (
  SELECT c.*, p.url AS source, CAST(NULL AS INTEGER) AS page FROM (SELECT * FROM hcarry WHERE block_type IN {BODY_SQL}) c
  JOIN pages p ON p.page_id = c.page_id
), prec AS (
  SELECT 0 AS pool, doc_id AS doc, block_idx, sent_idx, text, page, section, block_type, source FROM (
    {_sentences_sql('mbody', 'doc_id, source, block_idx, block_type, section, page')})
  UNION ALL
  SELECT 1, page_id, block_idx, sent_idx, text, page, section, block_type, source FROM (
    {_sentences_sql('hbody', 'page_id, source, block_idx, block_type, section, page')})
), pfirst AS (
  SELECT * FROM prec QUALIFY row_number() OVER (PARTITION BY text ORDER BY pool, doc, block_idx, sent_idx) = 1
)"""


def pool(spark, sf_dir):
    """Records of ``documents`` as paged Markdown, then of ``pages`` as HTML."""
    docs = X.records(paged_body(spark, sf_dir), ["doc_id"], F.col("source"), page=F.col("page"))
    pages = table(spark, sf_dir, "pages")
    blocks = stored(X.html_blocks(pages.select("page_id", F.col("url").alias("source"), "html"), ["page_id", "source"]), "blocks")
    web = X.records(X.section_carry(blocks, ["page_id"]), ["page_id"], F.col("source"))
    return pooled_records([docs.withColumnRenamed("doc_id", "doc"), web.withColumnRenamed("page_id", "doc")])


@query("pooled_records", POOL_SQL + """
SELECT pool, doc, block_idx, sent_idx, text, page, section, block_type, source FROM pfirst""")
def q_pooled_records(spark, sf_dir):
    """All records of the pool, each text once, where it first occurs."""
    # the records are read twice, for the first of each text and for its row
    return D.dedup_first_by(stored(pool(spark, sf_dir), "records"), POOL_KEYS).select(
        *POOL_KEYS, "text", "page", "section", "block_type", "source")


POOL_MD5 = f"md5('{SEED}:' || pool || ':' || doc || ':' || block_idx || ':' || sent_idx)"


@query("pooled_splits", POOL_SQL + f""", plab AS (
  SELECT *, {O.label_sql()} AS label FROM (
    SELECT * REPLACE ([{', '.join(O.q(c) for c in X.CUE_PREFIXES)}][CAST((doc * 7 + sent_idx) % {len(X.CUE_PREFIXES)} AS INTEGER) + 1] || text AS text)
    FROM pfirst)
), """ + O.split_ctes("p", "plab", "label", POOL_MD5, ", ".join(POOL_KEYS)) + """
SELECT pool, doc, block_idx, sent_idx, label, split FROM psplit""")
def q_pooled_splits(spark, sf_dir):
    """Labels and splits of the pooled records, keyed by their place in the
    pool; cue prefixes stand in for the modal phrases that the texts lack."""
    r = q_pooled_records(spark, sf_dir)
    cued = r.withColumn("text", F.concat(X.cue_prefix(F.col("doc"), F.col("sent_idx")), F.col("text")))
    # the split ranks keys and labels only, so the texts aren't stored and moved with them
    labels = D.with_labels(cued).select(*POOL_KEYS, "label")
    return D.stratified_split(labels, POOL_KEYS).select(*POOL_KEYS, "label", "split")
