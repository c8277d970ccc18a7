"""Column expressions for sentence text.

Everything here returns a ``pyspark.sql.Column`` built from JVM built-ins, so
it stays inside whole-stage codegen and works unchanged on a streaming
DataFrame.  Python's ``re`` is Unicode-aware by default and Java's is not, so
the character classes below are written out explicitly (built once from
``unicodedata`` by rule) instead of relying on ``\\s``/``\\w``/``\\b``.
"""
from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_LEXICON, MASK_TOKEN, MIN_SENTENCE_CHARS, LabelSchema, Lexicon


def _jclass(codepoints) -> str:
    """Java regex character class body for a sorted iterable of code points."""
    ranges: list[list[int]] = []
    for cp in codepoints:
        if ranges and ranges[-1][1] == cp - 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    parts = []
    for a, b in ranges:
        parts.append(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}")
    return "".join(parts)


@lru_cache(maxsize=None)
def whitespace_class() -> str:
    """Python's notion of whitespace (``str.isspace``), incl. U+001C..U+001F."""
    return "[" + _jclass(cp for cp in range(0x3001) if chr(cp).isspace()) + "]"


@lru_cache(maxsize=None)
def odd_whitespace() -> str:
    """Whitespace other than U+0020."""
    return "[" + _jclass(cp for cp in range(0x3001) if chr(cp).isspace() and cp != 0x20) + "]"


@lru_cache(maxsize=None)
def combining_class() -> str:
    """Characters with a non-zero canonical combining class (what an accent
    strip removes after NFKD decomposition)."""
    return "[" + _jclass(cp for cp in range(sys.maxunicode + 1)
                         if unicodedata.combining(chr(cp))) + "]"


# Every combining character is a mark; the JVM may not know the newest ones yet.
# Asked first, it spares all other characters the long class.
MAYBE_COMBINING = r"(?=[\p{M}\p{Cn}])"
# None is below U+0300, and most lie in the block that begins there: one range
# spares plain text the look-behind, and a short class most marks the long one.
COMBINING_BLOCK = r"[\x{300}-\x{34E}\x{350}-\x{36F}]"


@lru_cache(maxsize=None)
def combining() -> str:
    """Pattern of one combining character."""
    # the look-behind counts UTF-16 units, so one character beyond U+FFFF needs the room of two
    return (r"[\x{300}-\x{10FFFF}](?<=" + COMBINING_BLOCK + "|(?:" + MAYBE_COMBINING + combining_class() + "){1,2})")


# Python ``\w`` = letters, numbers and underscore.
WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEFORE = r"(?<![\p{L}\p{N}_])"
NOT_WORD_AFTER = r"(?![\p{L}\p{N}_])"

# Sentence boundary: after . ; or : and whitespace, before an ASCII capital or
# digit.  (The abbreviation guard of the original splitter never fires, so the
# parity splitter has none; ``protect_abbrev`` adds a working one.)
# The space comes first, so the look-behind runs at spaces only.
SENT_SPLIT = r" (?<=[.;:] )(?=[A-Z0-9])"
# The default of ``protect_abbrev``: short forms that a capital or number often follows.
ABBREVIATIONS = ("approx.", "cf.", "ch.", "e.g.", "Eq.", "Fig.", "i.e.", "No.", "Ref.", "Sec.", "vs.")


def _lit(s: str) -> str:
    return "\\Q" + s + "\\E"


def collapse_ws(c: Column) -> Column:
    """Runs of whitespace → one space, then strip."""
    return F.trim(F.regexp_replace(c, whitespace_class() + "+", " "))


def split_sentences(c: Column, protect_abbrev: bool = False) -> Column:
    """Array of sentences of a block (whitespace collapsed first)."""
    pattern = SENT_SPLIT
    if protect_abbrev:
        guard = "".join(f"(?<!{NOT_WORD_BEFORE}{_lit(a)})" for a in ABBREVIATIONS)
        pattern = guard + pattern
    return F.split(collapse_ws(c), pattern)


def keep_fragment(c: Column, min_chars: int = MIN_SENTENCE_CHARS) -> Column:
    """Fragment filter: at least ``min_chars`` characters and an ASCII letter."""
    return (F.length(c) >= min_chars) & c.rlike("[a-zA-Z]")


# --------------------------------------------------------------------------- #
# Weak labels and masking
# --------------------------------------------------------------------------- #
def class_pattern(phrases) -> str:
    return "(?<![a-z])(?:" + "|".join(_lit(p) for p in phrases) + ")(?![a-z])"


def _any_contained(c: Column, words) -> Column:
    return reduce(Column.__or__, [F.contains(c, F.lit(w)) for w in words], F.lit(False))


def label_expr(c: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """First class (in rule order) with any phrase bounded by non-[a-z]."""
    low = F.lower(c)
    out = None
    for cls, phrases in lexicon.rules:
        # the phrase's bytes are looked for first, which spares most rows the pattern
        cond = _any_contained(low, phrases) & low.rlike(class_pattern(phrases))
        out = F.when(cond, F.lit(cls)) if out is None else out.when(cond, F.lit(cls))
    default = F.lit(lexicon.schema.default)
    return default if out is None else out.otherwise(default)


def label_id_expr(label: Column, schema: LabelSchema | None = None) -> Column:
    schema = schema or LabelSchema()
    m = F.create_map(*[x for i, lab in enumerate(schema.labels) for x in (F.lit(lab), F.lit(i))])
    return m[label].cast("int")


def _quote_replacement(s: str) -> str:
    return s.replace("\\", "\\\\").replace("$", "\\$")


def mask_expr(c: Column, lexicon: Lexicon = DEFAULT_LEXICON, token: str = MASK_TOKEN) -> Column:
    """Replace each phrase (class order, longest first), case-insensitively and
    bounded by non-letters, by ``token``.  Sequential, so overlapping custom
    lexicons behave like the one-phrase-at-a-time original."""
    out = c
    rep = _quote_replacement(token)
    phrases = lexicon.mask_phrases()
    for p in phrases:
        out = F.regexp_replace(out, "(?iu)(?<![a-zA-Z])" + _lit(p) + "(?![a-zA-Z])", rep)
    # one combined test first: rows without any cue skip the replace chain
    any_cue = "(?iu)(?<![a-zA-Z])(?:" + "|".join(_lit(p) for p in phrases) + ")(?![a-zA-Z])"
    return F.when(c.rlike(any_cue), out).otherwise(c)


# --------------------------------------------------------------------------- #
# Engineered features (10 numeric columns)
# --------------------------------------------------------------------------- #
FEATURES = ("char_len", "word_count", "avg_word_len", "num_digits", "num_acronyms",
            "has_negation", "has_ref", "has_shall_must", "has_should", "has_may")

# Fixed word lists of the engineered indicator features.
FEATURE_WORDS = {
    "has_negation": ("not",),
    "has_ref": ("refer", "section", "figure"),
    "has_shall_must": ("shall", "must", "required"),
    "has_should": ("should",),
    "has_may": ("may", "optional", "can"),
}


# The characters beyond ASCII that the JVM takes for ASCII letters if case is ignored: i, i, s and k.
CASED_AS_ASCII = ("\u0130", "\u0131", "\u017f", "\u212a")


def _word_flag(c: Column, words) -> Column:
    pat = "(?iu)" + NOT_WORD_BEFORE + "(?:" + "|".join(_lit(w) for w in words) + ")" + NOT_WORD_AFTER
    ascii_only = F.length(c) == F.octet_length(c)
    # bytes are looked for first, which spares most rows the pattern; null stays null
    maybe = _any_contained(F.lower(c), words) | (~ascii_only & _any_contained(c, CASED_AS_ASCII))
    return F.when(~maybe, F.lit(0)).otherwise(c.rlike(pat).cast("int"))


def _has_odd_whitespace(c: Column) -> Column:
    return c.rlike(odd_whitespace())


def word_count_expr(c: Column) -> Column:
    ws = whitespace_class()
    counted = F.regexp_count(c, F.lit("[^" + ws[1:-1] + "]+")).cast("int")
    # words that single spaces part are one more than the spaces
    uneven = (c == F.lit("")) | c.startswith(" ") | c.endswith(" ") | F.contains(c, F.lit("  ")) | _has_odd_whitespace(c)
    spaces = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(uneven, counted).otherwise((spaces + 1).cast("int"))


def _chars_in_words(c: Column) -> Column:
    return F.length(F.when(_has_odd_whitespace(c), F.regexp_replace(c, whitespace_class() + "+", ""))
                    .otherwise(F.replace(c, F.lit(" "), F.lit(""))))


def _digit_count(c: Column) -> Column:
    some = c.rlike(r"\p{Nd}")
    return F.when(~some, F.lit(0)).otherwise(F.regexp_count(c, F.lit(r"\p{Nd}"))).cast("int")


def _acronym_count(c: Column) -> Column:
    some = c.rlike("[A-Z][A-Z]")
    counted = F.regexp_count(c, F.lit("(?=[A-Z][A-Z])" + NOT_WORD_BEFORE + "[A-Z]{2,}" + NOT_WORD_AFTER))
    return F.when(~some, F.lit(0)).otherwise(counted).cast("int")


def feature_columns(c: Column) -> dict[str, Column]:
    wc = word_count_expr(c)
    cols = {
        "char_len": F.length(c).cast("int"),
        "word_count": wc,
        "avg_word_len": (_chars_in_words(c) / F.greatest(wc, F.lit(1))).cast("double"),
        "num_digits": _digit_count(c),
        "num_acronyms": _acronym_count(c),
    }
    for name, words in FEATURE_WORDS.items():
        cols[name] = _word_flag(c, words)
    return cols


# --------------------------------------------------------------------------- #
# Vectorizer preprocessing: lower-case, strip accents, tokens, n-grams
# --------------------------------------------------------------------------- #
def fold_accents(c: Column) -> Column:
    """NFKD decomposition (ICU, JVM-side) minus combining marks; ASCII rows
    skip the work entirely (CASE is lazy)."""
    decomposed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), c, F.lit(True))
    return F.when(F.length(c) != F.octet_length(c),
                  F.regexp_replace(decomposed, combining(), "")).otherwise(c)


def tokens_expr(c: Column, lowercase: bool = True, strip_accents: bool = True) -> Column:
    """Tokens of two or more word characters (the default vectorizer pattern)."""
    t = F.lower(c) if lowercase else c
    if strip_accents:
        t = fold_accents(t)
    return F.regexp_extract_all(t, F.lit(WORD + "{2,}"), 0)


def ngrams_expr(tok: Column, ngram_range=(1, 1)) -> Column:
    """Word n-grams joined by one space: all n in range, over the token list.
    Built with ``zip_with`` over shifted slices, so no lambda re-evaluates
    ``tok``; pass a column reference, not an expression."""
    lo, hi = ngram_range
    size = F.size(tok)
    parts = []
    prev = tok
    for n in range(1, hi + 1):
        if n > 1:
            m = F.greatest(size - (n - 1), F.lit(0))
            prev = F.zip_with(F.slice(prev, 1, m), F.slice(tok, n, m),
                              lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= lo:
            parts.append(prev)
    return parts[0] if len(parts) == 1 else F.concat(*parts)
