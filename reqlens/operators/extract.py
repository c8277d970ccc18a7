"""Document → blocks → sentence records.

Blocks are produced by ``posexplode(split(...))`` over one string column and
classified with ``CASE`` expressions; sentences by a second ``posexplode``.
Both stay in whole-stage codegen.  Section carry-forward is done with a
two-level (chunked) scan so one huge document does not become one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse_ws, keep_fragment, split_sentences
from ..schema import BODY_TYPES, DOC_EXTENSIONS, HEADER_TYPES, MIN_SENTENCE_CHARS, PREAMBLE
from .rank import ordered_number

# --------------------------------------------------------------------------- #
# Sentences
# --------------------------------------------------------------------------- #


def sentences(df: DataFrame, key_cols: list[str], text_col: str = "text",
              keep_cols: list[str] | None = None, fragment_filter: bool = True,
              min_chars: int = MIN_SENTENCE_CHARS, protect_abbrev: bool = False) -> DataFrame:
    """One row per sentence: keys, ``sent_idx`` (0-based position among the
    block's sentences, before filtering) and ``text``."""
    keep_cols = keep_cols or []
    s = df.select(*key_cols, *keep_cols,
                  F.posexplode(split_sentences(F.col(text_col), protect_abbrev))
                  .alias("sent_idx", "_s"))
    s = s.filter(F.length("_s") > 0)
    if fragment_filter:
        s = s.filter(keep_fragment(F.col("_s"), min_chars))
    return s.select(*key_cols, *keep_cols, F.col("sent_idx").cast("long").alias("sent_idx"),
                    F.col("_s").alias("text"))


# Fixed cue prefixes that turn sentences of the stock tables into a labeled
# corpus (position m = (doc_id*7 + sent_idx) % 25; 15..24 add nothing).
CUE_PREFIXES = (
    "The host shall not ", "It may not ", "This cannot ", "Data shall ", "It must ",
    "It is required to ", "It should ", "It is recommended that ", "It may ",
    "An optional ", "It can optionally ", "maybe ", "Marshall ", "It SHALL NOT ",
    "may may ", "", "", "", "", "", "", "", "", "", "",
)


def cue_prefix(doc_id: Column, sent_idx: Column) -> Column:
    m = ((doc_id * 7 + sent_idx) % len(CUE_PREFIXES)).cast("int")
    return F.element_at(F.array(*[F.lit(p) for p in CUE_PREFIXES]), m + 1)


def cued_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_idx, text) with a modal cue prefixed to most sentences."""
    s = sentences(documents, ["doc_id"])
    return s.select("doc_id", "sent_idx",
                    F.concat(cue_prefix(F.col("doc_id"), F.col("sent_idx")), F.col("text")).alias("text"))


#: Type of a block that starts a new page, and the marker that says so in Markdown.
PAGE_BREAK = "page_break"
PAGE_BREAK_MARK = "<!-- page break -->"

# --------------------------------------------------------------------------- #
# Section carry-forward (skew-safe)
# --------------------------------------------------------------------------- #


def carry_forward(df: DataFrame, part_cols: list[str], order_col: str, value: Column,
                  out: str, default: str | None = None, chunk: int = 4096) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row within
    ``part_cols`` ordered by ``order_col``.

    Level 1 aggregates the last value of every chunk of ``chunk`` consecutive
    rows (a small table), level 2 windows within (partition, chunk) only.
    """
    d = df.withColumn("_v", value).withColumn("_chunk", F.floor(F.col(order_col) / chunk).cast("long"))
    # one row per (partition, chunk): the chunk's last non-null value
    chunk_last = (d.groupBy(*part_cols, "_chunk")
                   .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order_col))).alias("_lv")))
    w_chunks = (Window.partitionBy(*part_cols).orderBy("_chunk")
                .rowsBetween(Window.unboundedPreceding, -1))
    carry_in = chunk_last.select(*part_cols, "_chunk",
                                 F.last("_lv", ignorenulls=True).over(w_chunks).alias("_in"))
    w_rows = (Window.partitionBy(*part_cols, "_chunk").orderBy(order_col)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fallback = F.lit(default) if default is not None else F.lit(None)
    res = (d.join(carry_in, [*part_cols, "_chunk"])
            .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(w_rows),
                                        F.col("_in"), fallback)))
    return res.drop("_v", "_chunk", "_in")


def provenance_carry(blocks: DataFrame, doc_cols: list[str], order_col: str = "block_idx", chunk: int = 4096) -> DataFrame:
    """Body blocks with ``section`` (as in ``section_carry``) and ``page``: one
    more than the page breaks before them in their document.

    Both come from one two-level pass: per chunk of consecutive blocks its last
    header and its number of breaks, carried into the next chunks, and a window
    within each chunk.  The blocks are stored first, since both levels read
    them and extraction is the costly part."""
    from ..session import stored
    header = F.when(F.col("block_type").isin(*HEADER_TYPES), F.trim(F.col("text")))
    d = stored(blocks.select("*", header.alias("_v"), (F.col("block_type") == PAGE_BREAK).cast("long").alias("_p"),
                             F.floor(F.col(order_col) / chunk).cast("long").alias("_chunk")), "blocks")
    chunks = d.groupBy(*doc_cols, "_chunk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order_col))).alias("_lv"), F.sum("_p").alias("_np"))
    before = Window.partitionBy(*doc_cols).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*doc_cols, "_chunk", F.last("_lv", ignorenulls=True).over(before).alias("_in"),
                            F.coalesce(F.sum("_np").over(before), F.lit(0)).alias("_pages"))
    within = (Window.partitionBy(*doc_cols, "_chunk").orderBy(order_col)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (d.join(carried, [*doc_cols, "_chunk"])
            .withColumn("section", F.coalesce(F.last("_v", ignorenulls=True).over(within), F.col("_in"), F.lit(PREAMBLE)))
            .withColumn("page", (F.col("_pages") + F.sum("_p").over(within) + 1).cast("int"))
            .filter(F.col("block_type").isin(*BODY_TYPES)).drop("_v", "_p", "_chunk", "_in", "_pages"))


def first_page(prov: Column) -> Column:
    """The page of a block from its provenance, an array of structs with
    ``page_no``: that of the first entry, null without one."""
    return F.get(prov, F.lit(0)).getField("page_no").cast("int")


def section_carry(blocks: DataFrame, doc_cols: list[str], order_col: str = "block_idx") -> DataFrame:
    """Body blocks with ``section`` = nearest preceding header of the same
    document, ``(preamble)`` before the first; headers and other labels drop."""
    is_header = F.col("block_type").isin(*HEADER_TYPES)
    with_sec = carry_forward(blocks, doc_cols, order_col,
                             F.when(is_header, F.trim(F.col("text"))), "section", PREAMBLE)
    return with_sec.filter(F.col("block_type").isin(*BODY_TYPES))


def records(body_blocks: DataFrame, doc_cols: list[str], source: Column,
            page: Column | None = None, protect_abbrev: bool = False) -> DataFrame:
    """Sentence records (text, page, section, block_type, source) plus the
    ordering keys, from body blocks that already carry ``section``."""
    extra = [] if "source" in doc_cols else [source.alias("source")]
    b = body_blocks.select(*doc_cols, "block_idx", "block_type", "section", *extra,
                           (page if page is not None else F.lit(None)).cast("int").alias("page"),
                           "text")
    keep = ["block_type", "section", "page"] + ([] if "source" in doc_cols else ["source"])
    s = sentences(b, [*doc_cols, "block_idx"], keep_cols=keep, protect_abbrev=protect_abbrev)
    others = [c for c in doc_cols if c != "source"]
    return s.select("text", "page", "section", "block_type", "source", *others, "block_idx", "sent_idx")


# --------------------------------------------------------------------------- #
# Markdown blocks
# --------------------------------------------------------------------------- #
MD_BLOCK_SPLIT = r"\n(?:\s*\n|(?=\s*- |\d+\. |#|\|))"


def md_blocks(df: DataFrame, key_cols: list[str], md_col: str = "markdown", page_break: str | None = None) -> DataFrame:
    """Markdown → (keys, block_idx, block_type, text); tables and captions
    dropped, list markers and note numbers stripped, entities unescaped.
    Blocks equal to ``page_break``, if given, become type ``page_break``."""
    b = df.select(*key_cols, F.posexplode(F.split(F.col(md_col), MD_BLOCK_SPLIT)).alias("block_idx", "_b"))
    t = F.trim(F.col("_b"))
    btype = (F.when(t == F.lit(page_break), PAGE_BREAK)
              .when(t.startswith("#") & t.rlike(r"^#+ "), "section_header")
              .when(t.startswith("|"), "table")
              .when((t.startswith("Figure ") | t.startswith("Table ")) & t.rlike(r"^(Figure|Table) \d+: "), "caption")
              .when(t.startswith("- "), "list_item")
              .otherwise("text"))
    body = (F.when(btype == "section_header", F.regexp_replace(t, r"^#+ ", ""))
             .when(btype == "list_item", F.regexp_replace(t, r"^- (?:[a-z]\) )?", ""))
             # an anchored pattern is still tried at every place, so the first character is asked before
             .otherwise(F.when(F.substring(t, 1, 1).between("0", "9"), F.regexp_replace(t, r"^\d+\. ", "")).otherwise(t)))
    text = unescape_md(collapse_ws(body))
    return (b.select(*key_cols, F.col("block_idx").cast("long").alias("block_idx"),
                     btype.alias("block_type"), text.alias("text"))
             .filter((F.length("text") > 0) & F.col("block_type").isin("section_header", "list_item", "text", PAGE_BREAK)))


def unescape_md(c: Column) -> Column:
    c = F.replace(c, F.lit("\\_"), F.lit("_"))
    c = F.replace(c, F.lit("&lt;"), F.lit("<"))
    c = F.replace(c, F.lit("&gt;"), F.lit(">"))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


def markdown_from_lines(title: Column, text: Column) -> Column:
    """Markdown document: a level-1 header, then one paragraph per line."""
    return F.concat(F.lit("# "), title, F.lit("\n\n"), F.regexp_replace(text, "\n", "\n\n"))


#: Markup of a text's lines in turn, so that every block type occurs: (Markdown, HTML) before and after the line.
LINE_MARKUP = ((("## ", ""), ("<h2>", "</h2>")), (("", ""), ("<p>", "</p>")), (("- ", ""), ("<ul><li>", "</li></ul>")),
               (("1. ", ""), ("<div>", "</div>")), (("| ", " |"), ("<footer>", "</footer>")),
               (("- a) ", ""), ("<li class=x>", "</li>")), (("Table 1: ", ""), ("<!-- ", " -->")), (("", ""), ("<P>", "<br/>")))
LINES_PER_PAGE = 3


def marked_lines(text: Column, markup: int, page_break: str = "") -> Column:
    """The lines of a text, each in the markup of its turn, as one document;
    every LINES_PER_PAGE lines ``page_break`` follows, if given."""
    turns = F.array(*[F.struct(F.lit(m[markup][0]).alias("a"), F.lit(m[markup][1]).alias("b")) for m in LINE_MARKUP])

    def line(x, i):
        m = F.get(turns, i % F.lit(len(LINE_MARKUP)))
        out = F.concat(m["a"], x, m["b"])
        if not page_break:
            return out
        return F.when(i % F.lit(LINES_PER_PAGE) == F.lit(LINES_PER_PAGE - 1), F.concat(out, F.lit(f"\n\n{page_break}"))).otherwise(out)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n\n")


# --------------------------------------------------------------------------- #
# HTML blocks
# --------------------------------------------------------------------------- #
# Fixed tag sets of the HTML block recipe.
HTML_DROP_ELEMENTS = ("script", "style", "nav", "footer", "head")
HTML_BLOCK_TAGS = ("p", "div", "br", "article", "ul", "ol", "body", "html", "li",
                   "h1", "h2", "h3", "h4", "h5", "h6")


def html_blocks(df: DataFrame, key_cols: list[str], html_col: str = "html") -> DataFrame:
    """HTML → (keys, block_idx, block_type, text).  Comments and non-content
    elements are removed, block tags become split markers, other tags are
    deleted, entities unescaped.  Unbalanced tags are harmless."""
    h = F.regexp_replace(F.col(html_col), r"(?s)<!--.*?-->", " ")
    for tag in HTML_DROP_ELEMENTS:
        h = F.regexp_replace(h, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    h = F.regexp_replace(h, r"(?i)<h[1-6](?:\s[^>]*)?>", "\u0001H\u0002")
    h = F.regexp_replace(h, r"(?i)<li(?:\s[^>]*)?>", "\u0001L\u0002")
    tags = "|".join(HTML_BLOCK_TAGS)
    h = F.regexp_replace(h, rf"(?i)</?(?:{tags})(?:\s[^>]*)?/?>", "\u0001T\u0002")
    h = F.regexp_replace(h, r"<[^>]*>", "")
    b = df.select(*key_cols, F.posexplode(F.split(h, "\u0001")).alias("block_idx", "_b"))
    kind = F.regexp_extract("_b", "^([HLT])\u0002", 1)
    btype = (F.when(kind == "H", "section_header").when(kind == "L", "list_item").otherwise("text"))
    text = unescape_html(collapse_ws(F.regexp_replace("_b", "^[HLT]\u0002", "")))
    return (b.select(*key_cols, F.col("block_idx").cast("long").alias("block_idx"),
                     btype.alias("block_type"), text.alias("text"))
             .filter(F.length("text") > 0))


def unescape_html(c: Column) -> Column:
    c = F.replace(c, F.lit("&lt;"), F.lit("<"))
    c = F.replace(c, F.lit("&gt;"), F.lit(">"))
    c = F.replace(c, F.lit("&quot;"), F.lit('"'))
    return F.replace(c, F.lit("&amp;"), F.lit("&"))


# --------------------------------------------------------------------------- #
# Document discovery (raw folder)
# --------------------------------------------------------------------------- #


def discover_documents(spark, raw_dir: str, extensions=DOC_EXTENSIONS) -> DataFrame:
    """Files directly in ``raw_dir`` with a known extension (case-insensitive),
    with ``doc_ord`` = rank of the path.  Raises if there are none."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "false")
             .load(raw_dir)
             .select("path", "content",
                     F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
             .filter(F.col("ext").isin(*extensions)))
    names = files.select("path")
    if names.isEmpty():
        raise FileNotFoundError(f"{raw_dir} holds no file of the types {', '.join(extensions)}")
    return (files.join(ordered_number(names, "path", "doc_ord"), "path")
                 .withColumn("source", F.regexp_extract("path", r"([^/]+)$", 1)))
