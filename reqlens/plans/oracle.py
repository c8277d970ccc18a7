"""DuckDB oracle SQL for the query catalogue.

The oracle is an independent formulation of each query for the correctness
gate: DuckDB's regex engine (RE2) has no lookaround and ASCII ``\\s``/``\\b``,
so each text rule has its own equivalent form here.  Fragments are generated
from the same fixed constants (lexicon, cue prefixes) as the Spark side.
"""
from __future__ import annotations

import re

from ..operators.extract import CUE_PREFIXES, HTML_BLOCK_TAGS, HTML_DROP_ELEMENTS
from ..functions.text import FEATURE_WORDS
from ..schema import DEFAULT_LEXICON, LABELS, MASK_TOKEN, PREAMBLE, SEED

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(s: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", s)


def label_sql(col: str = "text") -> str:
    parts = []
    for cls, phrases in DEFAULT_LEXICON.rules:
        pat = "[^a-z](?:" + "|".join(rx(p) for p in phrases) + ")[^a-z]"
        parts.append(f"WHEN regexp_matches(' ' || lower({col}) || ' ', {q(pat)}) THEN {q(cls)}")
    return "CASE " + " ".join(parts) + f" ELSE {q(DEFAULT_LEXICON.schema.default)} END"


def label_id_sql(col: str = "label") -> str:
    return "CAST(CASE " + " ".join(f"WHEN {col} = {q(l)} THEN {i}" for i, l in enumerate(LABELS)) + " END AS INTEGER)"


def mask_sql(col: str = "text") -> str:
    out = col
    for p in DEFAULT_LEXICON.mask_phrases():
        pat = "(^|[^a-zA-Z])(?i:" + rx(p) + ")($|[^a-zA-Z])"
        for _ in range(2):
            out = f"regexp_replace({out}, {q(pat)}, {q(chr(92) + '1' + MASK_TOKEN + chr(92) + '2')}, 'g')"
    return out


def feature_sql(col: str = "text") -> str:
    wc = f"len(regexp_extract_all({col}, '[^\\s]+'))"
    cols = [
        f"CAST(length({col}) AS BIGINT) AS char_len",
        f"CAST({wc} AS BIGINT) AS word_count",
        f"round(length(regexp_replace({col}, '\\s+', '', 'g')) / greatest({wc}, 1), 6) AS avg_word_len",
        f"CAST(len(regexp_extract_all({col}, '\\p{{Nd}}')) AS BIGINT) AS num_digits",
        f"CAST(len(list_filter(regexp_extract_all({col}, '{W}+'), lambda x: regexp_full_match(x, '[A-Z]{{2,}}'))) AS BIGINT) AS num_acronyms",
    ]
    for name, words in FEATURE_WORDS.items():
        pat = f"(?i)(^|{NW})(?:" + "|".join(rx(w) for w in words) + f")($|{NW})"
        cols.append(f"CAST(regexp_matches({col}, {q(pat)}) AS BIGINT) AS {name}")
    return ",\n       ".join(cols)


FEATURE_NAMES = ("char_len", "word_count", "avg_word_len", "num_digits", "num_acronyms",
                 *FEATURE_WORDS.keys())

# --------------------------------------------------------------------------- #
# Common table expressions
# --------------------------------------------------------------------------- #
SENT_SPLIT_SQL = (r"string_split(regexp_replace(trim(regexp_replace({t}, '\s+', ' ', 'g')), "
                  r"'([.;:])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1))")


def cte_sentences(filtered: bool = True) -> str:
    cond = "length(text) > 0"
    if filtered:
        cond += " AND length(text) >= 15 AND regexp_matches(text, '[a-zA-Z]')"
    return f"""sent_raw AS (
  SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS sent_idx
  FROM (SELECT doc_id, {SENT_SPLIT_SQL.format(t='text')} AS l FROM documents)
), sent AS (
  SELECT doc_id, CAST(sent_idx AS BIGINT) AS sent_idx, text FROM sent_raw WHERE {cond}
)"""


def cte_cued() -> str:
    lst = "[" + ", ".join(q(p) for p in CUE_PREFIXES) + "]"
    return cte_sentences() + f""", cued AS (
  SELECT doc_id, sent_idx, {lst}[CAST((doc_id * 7 + sent_idx) % {len(CUE_PREFIXES)} AS INTEGER) + 1] || text AS text
  FROM sent
), lab AS (
  SELECT doc_id, sent_idx, text, {label_sql()} AS label FROM cued
), labeled AS (
  SELECT doc_id, sent_idx, text, label, {label_id_sql()} AS label_id FROM lab
)"""


def cte_features() -> str:
    return cte_cued() + f""", feats AS (
  SELECT doc_id, sent_idx, label, label_id,
       {feature_sql()}
  FROM labeled
)"""


def key_md5(seed: int = SEED) -> str:
    return f"md5('{seed}:' || doc_id || ':' || sent_idx)"


def cte_split() -> str:
    """Exact stratified 3-way split (both stages stratified)."""
    return cte_cued() + f""", cnt AS (
  SELECT label, count(*) AS c FROM labeled GROUP BY label
), a1 AS (
  SELECT label, c, (c * n_keep) // n AS fl, (c * n_keep) % n AS fr, n_keep
  FROM cnt, (SELECT sum(c) AS n, sum(c) - CAST(ceil(round(sum(c) * 0.2, 9)) AS BIGINT) AS n_keep FROM cnt) t
), q1 AS (
  SELECT label, c, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, c, label) <= n_keep - sum(fl) OVER () THEN 1 ELSE 0 END AS q1
  FROM a1
), a2 AS (
  SELECT label, q1, (q1 * n_keep) // n AS fl, (q1 * n_keep) % n AS fr, n_keep
  FROM q1, (SELECT sum(q1) AS n, sum(q1) - CAST(ceil(round(sum(q1) * (0.1::DOUBLE / 0.8::DOUBLE), 9)) AS BIGINT) AS n_keep FROM q1) t
), q2 AS (
  SELECT label, q1, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, q1, label) <= n_keep - sum(fl) OVER () THEN 1 ELSE 0 END AS q2
  FROM a2
), ranked AS (
  SELECT l.*, row_number() OVER (PARTITION BY l.label ORDER BY {key_md5()}, doc_id, sent_idx) AS r
  FROM labeled l
), splitted AS (
  SELECT r.doc_id, r.sent_idx, r.text, r.label, r.label_id,
         CASE WHEN r.r > q.q1 THEN 'test' WHEN r.r <= q.q2 THEN 'train' ELSE 'val' END AS split
  FROM ranked r JOIN q2 q ON r.label = q.label
)"""


def html_blocks_sql() -> str:
    h = "html"
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in HTML_DROP_ELEMENTS:
        h = f"regexp_replace({h}, {q(f'(?is)<{tag}(?:[ \\t\\n\\r\\f][^>]*)?>.*?</{tag}[ \\t\\n\\r\\f]*>')}, ' ', 'g')"
    h = f"regexp_replace({h}, '(?i)<h[1-6](?:\\s[^>]*)?>', chr(1) || 'H' || chr(2), 'g')"
    h = f"regexp_replace({h}, '(?i)<li(?:\\s[^>]*)?>', chr(1) || 'L' || chr(2), 'g')"
    tags = "|".join(HTML_BLOCK_TAGS)
    h = f"regexp_replace({h}, '(?i)</?(?:{tags})(?:\\s[^>]*)?/?>', chr(1) || 'T' || chr(2), 'g')"
    h = f"regexp_replace({h}, '<[^>]*>', '', 'g')"
    body = "regexp_replace(b, '^[HLT]' || chr(2), '')"
    text = f"trim(regexp_replace({body}, '\\s+', ' ', 'g'))"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, {q(a)}, {q(b)})"
    kind = "regexp_extract(b, '^([HLT])' || chr(2), 1)"
    return f"""hb_raw AS (
  SELECT page_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS block_idx
  FROM (SELECT page_id, string_split({h}, chr(1)) AS l FROM pages)
), hblocks AS (
  SELECT page_id, CAST(block_idx AS BIGINT) AS block_idx,
         CASE {kind} WHEN 'H' THEN 'section_header' WHEN 'L' THEN 'list_item' ELSE 'text' END AS block_type,
         {text} AS text
  FROM hb_raw
), html_blocks AS (
  SELECT * FROM hblocks WHERE length(text) > 0
)"""


def carry_sql(src: str, part: str) -> str:
    return f"""SELECT *, coalesce(last_value(CASE WHEN block_type IN ('section_header', 'title') THEN trim(text) END IGNORE NULLS)
         OVER (PARTITION BY {part} ORDER BY block_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {q(PREAMBLE)}) AS section
  FROM {src}"""


def md_blocks_sql() -> str:
    md = r"'# ' || source || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10))"
    split = (f"string_split(regexp_replace(regexp_replace({md}, '\\n\\s*\\n', chr(1), 'g'), "
             f"'\\n(\\s*- |\\d+\\. |#|\\|)', chr(1) || '\\1', 'g'), chr(1))")
    t = "trim(b)"
    btype = (f"CASE WHEN regexp_matches({t}, '^#+ ') THEN 'section_header' "
             f"WHEN starts_with({t}, '|') THEN 'table' "
             f"WHEN regexp_matches({t}, '^(Figure|Table) \\d+: ') THEN 'caption' "
             f"WHEN starts_with({t}, '- ') THEN 'list_item' ELSE 'text' END")
    return f"""mb_raw AS (
  SELECT doc_id, unnest(l) AS b, generate_subscripts(l, 1) - 1 AS block_idx
  FROM (SELECT doc_id, {split} AS l FROM documents)
), mb_typed AS (
  SELECT doc_id, CAST(block_idx AS BIGINT) AS block_idx, {btype} AS block_type, {t} AS t FROM mb_raw
), mb_text AS (
  SELECT doc_id, block_idx, block_type,
    CASE WHEN block_type = 'section_header' THEN regexp_replace(t, '^#+ ', '')
         WHEN block_type = 'list_item' THEN regexp_replace(t, '^- (?:[a-z]\\) )?', '')
         ELSE regexp_replace(t, '^\\d+\\. ', '') END AS b
  FROM mb_typed
), md_blocks AS (
  SELECT doc_id, block_idx, block_type,
    replace(replace(replace(replace(trim(regexp_replace(b, '\\s+', ' ', 'g')), '\\_', '_'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS text
  FROM mb_text
  WHERE block_type IN ('section_header', 'list_item', 'text')
), md_nonempty AS (
  SELECT * FROM md_blocks WHERE length(text) > 0
)"""


# --------------------------------------------------------------------------- #
# Generic split / TF-IDF / Naive Bayes fragments
# --------------------------------------------------------------------------- #


def split_ctes(p: str, src: str, label: str, md5_expr: str, order_cols: str) -> str:
    """``{p}split``: src rows + ``split`` (both stages stratified)."""
    return f"""{p}cnt AS (
  SELECT {label} AS label, count(*) AS c FROM {src} GROUP BY {label}
), {p}a1 AS (
  SELECT label, c, (c * n_keep) // n AS fl, (c * n_keep) % n AS fr, n_keep
  FROM {p}cnt, (SELECT sum(c) AS n, sum(c) - CAST(ceil(round(sum(c) * 0.2, 9)) AS BIGINT) AS n_keep FROM {p}cnt) t
), {p}q1 AS (
  SELECT label, c, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, c, label) <= n_keep - sum(fl) OVER () THEN 1 ELSE 0 END AS q1
  FROM {p}a1
), {p}a2 AS (
  SELECT label, q1, (q1 * n_keep) // n AS fl, (q1 * n_keep) % n AS fr, n_keep
  FROM {p}q1, (SELECT sum(q1) AS n, sum(q1) - CAST(ceil(round(sum(q1) * (0.1::DOUBLE / 0.8::DOUBLE), 9)) AS BIGINT) AS n_keep FROM {p}q1) t
), {p}q2 AS (
  SELECT label, q1, fl + CASE WHEN row_number() OVER (ORDER BY fr DESC, q1, label) <= n_keep - sum(fl) OVER () THEN 1 ELSE 0 END AS q2
  FROM {p}a2
), {p}ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.{label} ORDER BY {md5_expr}, {order_cols}) AS _r FROM {src} s
), {p}split AS (
  SELECT r.* EXCLUDE (_r), CASE WHEN r._r > q.q1 THEN 'test' WHEN r._r <= q.q2 THEN 'train' ELSE 'val' END AS split
  FROM {p}ranked r JOIN {p}q2 q ON r.{label} = q.label
)"""


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({text})), '{W}{W}+')"


def grams_sql(k: str, ngram_hi: int) -> str:
    """n-grams over a token-list *column* ``k``."""
    if ngram_hi == 1:
        return k
    return f"list_concat({k}, list_transform(range(1, len({k})), lambda j: {k}[j] || ' ' || {k}[j + 1]))"


def tf_ctes(p: str, src: str, keys: list[str], text: str, ngram_hi: int, sublinear: bool) -> str:
    ks = ", ".join(keys)
    tfw = "1 + ln(count(*))" if sublinear else "CAST(count(*) AS DOUBLE)"
    return f"""{p}k AS (
  SELECT {ks}, {tokens_sql(text)} AS k FROM {src}
), {p}g AS (
  SELECT {ks}, unnest({grams_sql('k', ngram_hi)}) AS term FROM {p}k
), {p}tf AS (
  SELECT {ks}, term, CAST(count(*) AS BIGINT) AS tf, {tfw} AS tf_w FROM {p}g GROUP BY {ks}, term
)"""


def tfidf_ctes(p: str, train: str, apply: str, keys: list[str], text: str, ngram_hi: int,
               sublinear: bool, min_df, max_df) -> str:
    """``{p}vocab`` (term, df, idf) fitted on ``train``; ``{p}w`` (keys, term,
    weight) for every row of ``apply``."""
    ks = ", ".join(keys)
    lo = str(min_df) if isinstance(min_df, int) else f"{float(min_df)} * n"
    hi = str(max_df) if isinstance(max_df, int) else f"{float(max_df)} * n"
    return tf_ctes(p + "tr", train, keys, text, ngram_hi, sublinear) + ", " + \
        tf_ctes(p + "ap", apply, keys, text, ngram_hi, sublinear) + f""", {p}n AS (
  SELECT CAST(count(*) AS DOUBLE) AS n FROM {train}
), {p}vocab AS (
  SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT term, count(*) AS df FROM {p}trtf GROUP BY term), {p}n
  WHERE df <= {hi} AND df >= {lo}
), {p}w0 AS (
  SELECT a.{keys[0]}{''.join(', a.' + k for k in keys[1:])}, a.term, a.tf_w * v.idf AS w FROM {p}aptf a JOIN {p}vocab v ON a.term = v.term
), {p}w AS (
  SELECT {ks}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {ks})) AS weight FROM {p}w0
)"""


def nb_ctes(p: str, train: str, apply: str, keys: list[str], y: str, yord: str) -> str:
    """Multinomial NB on ``{p}w``/``{p}vocab``: ``{p}scores`` (keys, cls,
    ord, score) for every row of ``apply``; classes = those in ``train``."""
    ks = ", ".join(keys)
    on = " AND ".join(f"w.{k} = t.{k}" for k in keys)
    return f"""{p}classes AS (
  SELECT DISTINCT {y} AS cls, {yord} AS ord FROM {train}
), {p}fc AS (
  SELECT t.{y} AS cls, w.term, sum(w.weight) AS s FROM {p}w w JOIN {train} t ON {on} GROUP BY t.{y}, w.term
), {p}grid AS (
  SELECT v.term, c.cls, coalesce(fc.s, 0) AS s FROM {p}vocab v CROSS JOIN {p}classes c
  LEFT JOIN {p}fc fc ON fc.term = v.term AND fc.cls = c.cls
), {p}tot AS (
  SELECT cls, sum(s) AS tot FROM {p}grid GROUP BY cls
), {p}vsize AS (
  SELECT CAST(count(*) AS DOUBLE) AS vs FROM {p}vocab
), {p}lp AS (
  SELECT g.term, g.cls, ln((g.s + 1) / (t.tot + vs)) AS lp FROM {p}grid g JOIN {p}tot t ON g.cls = t.cls, {p}vsize
), {p}prior AS (
  SELECT {y} AS cls, ln(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM {train})) AS lprior FROM {train} GROUP BY {y}
), {p}sc AS (
  SELECT {', '.join('w.' + k for k in keys)}, lp.cls, sum(w.weight * lp.lp) AS s FROM {p}w w JOIN {p}lp lp ON w.term = lp.term
  GROUP BY {', '.join('w.' + k for k in keys)}, lp.cls
), {p}scores AS (
  SELECT {', '.join('a.' + k for k in keys)}, c.cls, c.ord, coalesce(sc.s, 0) + pr.lprior AS score
  FROM {apply} a CROSS JOIN {p}classes c
  LEFT JOIN {p}sc sc ON {' AND '.join(f'sc.{k} = a.{k}' for k in keys)} AND sc.cls = c.cls
  JOIN {p}prior pr ON pr.cls = c.cls
), {p}pred AS (
  SELECT {ks}, cls AS p FROM (
    SELECT {ks}, cls, row_number() OVER (PARTITION BY {ks} ORDER BY round(score, 6) DESC, ord) AS rn FROM {p}scores
  ) WHERE rn = 1
)"""


def eval_ctes(p: str, pred: str, classes: str) -> str:
    """From ``pred`` (y, p) and a class list CTE (cls): ``{p}conf``,
    ``{p}pc`` (per class) and ``{p}summary`` (metric, value)."""
    return f"""{p}c0 AS (
  SELECT y, p, count(*) AS cnt FROM {pred} GROUP BY y, p
), {p}conf AS (
  SELECT a.cls AS y, b.cls AS p, CAST(coalesce(c0.cnt, 0) AS BIGINT) AS cnt
  FROM {classes} a CROSS JOIN {classes} b LEFT JOIN {p}c0 c0 ON c0.y = a.cls AND c0.p = b.cls
), {p}pc0 AS (
  SELECT c.cls AS class,
    (SELECT sum(cnt) FROM {p}conf WHERE y = c.cls AND p = c.cls) AS tp,
    (SELECT sum(cnt) FROM {p}conf WHERE y = c.cls) AS support,
    (SELECT sum(cnt) FROM {p}conf WHERE p = c.cls) AS predicted
  FROM {classes} c
), {p}pc AS (
  SELECT class, support, predicted,
    CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
    CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM {p}pc0
), {p}pcf AS (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM {p}pc
), {p}summary AS (
  SELECT 'accuracy' AS metric, (SELECT sum(cnt) FILTER (WHERE y = p) / sum(cnt) FROM {p}conf) AS value
  UNION ALL SELECT 'macro_f1_present', avg(f1) FILTER (WHERE support > 0 OR predicted > 0) FROM {p}pcf
  UNION ALL SELECT 'macro_f1_all', avg(f1) FROM {p}pcf
  UNION ALL SELECT 'macro_precision_all', avg(precision) FROM {p}pcf
  UNION ALL SELECT 'macro_recall_all', avg(recall) FROM {p}pcf
  UNION ALL SELECT 'weighted_precision', sum(precision * support) / sum(support) FROM {p}pcf
  UNION ALL SELECT 'weighted_recall', sum(recall * support) / sum(support) FROM {p}pcf
  UNION ALL SELECT 'weighted_f1', sum(f1 * support) / sum(support) FROM {p}pcf
)"""


def curve_ctes(p: str, scores: str) -> str:
    """From ``scores`` (y, class, score): ``{p}cum`` with running counts."""
    return f"""{p}g AS (
  SELECT class, score, sum(CASE WHEN y = class THEN 1 ELSE 0 END) AS pos, sum(CASE WHEN y = class THEN 0 ELSE 1 END) AS neg
  FROM {scores} GROUP BY class, score
), {p}t AS (
  SELECT class, sum(pos) AS np, sum(neg) AS nn FROM {p}g GROUP BY class HAVING sum(pos) > 0
), {p}cum AS (
  SELECT g.*, t.np, t.nn,
    sum(pos) OVER (PARTITION BY g.class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
    sum(neg) OVER (PARTITION BY g.class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
  FROM {p}g g JOIN {p}t t ON g.class = t.class
)"""


# --------------------------------------------------------------------------- #
# Naive Bayes over many training sets, in long form
# --------------------------------------------------------------------------- #


def variant_nb_ctes(p: str, rows: str, train: str, score: str, keys: list[str], y: str, yord: str, ngram_hi: int,
                    sublinear: bool, max_df: float) -> str:
    """``{p}f1`` (v, part, macro_f1): NB on TF-IDF refitted for every v of
    ``train`` (v, keys) and scored on ``score`` (v, part, keys)."""
    ks = ", ".join(keys)

    def on(a, b):
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)

    def of(a):
        return ", ".join(f"{a}.{k}" for k in keys)

    return tf_ctes(p, rows, keys, "text", ngram_hi, sublinear) + f""", {p}tn AS (
  SELECT v, CAST(count(*) AS DOUBLE) AS n FROM {train} GROUP BY v
), {p}vocab AS (
  SELECT d.v, term, ln((1 + n) / (1 + df)) + 1 AS idf
  FROM (SELECT t.v, x.term, count(*) AS df FROM {p}tf x JOIN {train} t ON {on('x', 't')} GROUP BY t.v, x.term) d
  JOIN {p}tn m ON m.v = d.v WHERE df <= {max_df} * n
), {p}all AS (
  SELECT DISTINCT v, {ks} FROM (SELECT v, {ks} FROM {train} UNION ALL SELECT v, {ks} FROM {score})
), {p}w AS (
  SELECT v, {ks}, term, w / sqrt(sum(w * w) OVER (PARTITION BY v, {ks})) AS weight
  FROM (SELECT a.v, {of('a')}, x.term, x.tf_w * o.idf AS w FROM {p}all a JOIN {p}tf x ON {on('a', 'x')}
        JOIN {p}vocab o ON o.v = a.v AND o.term = x.term)
), {p}ty AS (
  SELECT t.v, {of('t')}, r.{y} AS cls, r.{yord} AS ord FROM {train} t JOIN {rows} r ON {on('t', 'r')}
), {p}prior AS (
  SELECT c.v, cls, any_value(ord) AS ord, ln(count(*) / any_value(n)) AS lprior FROM {p}ty c JOIN {p}tn m ON m.v = c.v
  GROUP BY c.v, cls
), {p}fc AS (
  SELECT w.v, t.cls, w.term, sum(w.weight) AS s FROM {p}w w JOIN {p}ty t ON t.v = w.v AND {on('t', 'w')}
  GROUP BY w.v, t.cls, w.term
), {p}den AS (
  SELECT c.v, c.cls, coalesce(s, 0) + size AS den FROM {p}prior c
  JOIN (SELECT v, count(*) AS size FROM {p}vocab GROUP BY v) z ON z.v = c.v
  LEFT JOIN (SELECT v, cls, sum(s) AS s FROM {p}fc GROUP BY v, cls) f ON f.v = c.v AND f.cls = c.cls
), {p}lp AS (
  SELECT o.v, o.term, d.cls, ln((coalesce(f.s, 0) + 1) / den) AS lp FROM {p}vocab o JOIN {p}den d ON d.v = o.v
  LEFT JOIN {p}fc f ON f.v = o.v AND f.term = o.term AND f.cls = d.cls
), {p}sum AS (
  SELECT w.v, {of('w')}, l.cls, sum(w.weight * l.lp) AS s FROM {p}w w JOIN {p}lp l ON l.v = w.v AND l.term = w.term
  GROUP BY w.v, {of('w')}, l.cls
), {p}pred AS (
  SELECT q.v, q.part, r.{y} AS y, c.cls AS p FROM {score} q JOIN {rows} r ON {on('q', 'r')} JOIN {p}prior c ON c.v = q.v
  LEFT JOIN {p}sum s ON s.v = q.v AND s.cls = c.cls AND {on('s', 'q')}
  QUALIFY row_number() OVER (PARTITION BY q.v, q.part, {of('q')} ORDER BY round(coalesce(s.s, 0) + c.lprior, 6) DESC, c.ord) = 1
), {p}per AS (
  SELECT v, part, c, sum(s) AS s, sum(g) AS g, sum(t) AS t FROM (
    SELECT v, part, y AS c, 1 AS s, 0 AS g, CASE WHEN y = p THEN 1 ELSE 0 END AS t FROM {p}pred
    UNION ALL SELECT v, part, p, 0, 1, 0 FROM {p}pred) GROUP BY v, part, c
), {p}f1 AS (
  SELECT v, part, round(avg(2.0 * t / (s + g)), 6) AS macro_f1 FROM {p}per GROUP BY v, part
)"""
