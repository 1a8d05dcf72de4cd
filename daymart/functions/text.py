"""Text expressions: token estimate, clean-up, names, term matching, keywords.

All row-local built-ins over the whole text; nothing here shuffles or leaves the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import as_col

# The CJK block counted as Chinese characters.
CJK_CLASS = "[\\x{4e00}-\\x{9fff}]"

# Clean-up applies from this many characters on.
CLEAN_MIN_CHARS = 500

# Name endings and dotted parts that mark file or URL noise.
NOISE_SUFFIXES = ("aliyuncs.com", "aliyuncs", "mydocs.oss", "oss-cn-", "oss.")
NOISE_PARTS = (
    "aliyuncs", "mydocs", "aliyun", "aliyuncs.com", "oss", "oss-cn", "www", "http", "https", "com", "cn",
    "net", "org", "png", "jpg", "jpeg", "gif", "pdf", "xlsx", "csv", "html", "json",
)

# Stop tokens and shortest length for identifier anchors.
IDENT_STOP = ("select", "from", "where", "group", "order", "left", "cast", "round")
IDENT_PATTERN = r"(?U)\b([a-z][a-z0-9_]{3,})\b"


def count_matches(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(as_col(text), F.lit(pattern))


def est_tokens(text: Column | str) -> Column:
    """int(1.5 * CJK + 0.25 * other), as exact integer arithmetic; NULL and '' give 0."""
    c = F.coalesce(as_col(text), F.lit(""))
    cjk = count_matches(c, CJK_CLASS).cast("bigint")
    return F.floor((cjk * 5 + F.length(c)) / 4).cast("bigint")


def clean_text(text: Column | str, min_chars: int = CLEAN_MIN_CHARS) -> Column:
    """Drop images and tags, fold runs of rules and blank lines.

    Texts of less than ``min_chars`` characters stay as they are; 0 cleans all.
    """
    c = as_col(text)
    out = F.regexp_replace(c, r"(?d)!\[.*?\]\(.*?\)", "")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    out = F.regexp_replace(out, r"(?dm)(^---\s*\n){3,}", "---\n\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.when(F.length(c) < min_chars, c).otherwise(out)


def unescape_md(text: Column | str) -> Column:
    r"""Undo Markdown escapes such as ``\_`` and ``\=``."""
    return F.regexp_replace(as_col(text), r"\\([_\-=`*~])", "$1")


def is_noise(name: Column | str) -> Column:
    """File names and URL parts that are no table names."""
    low = F.lower(as_col(name))
    ends = F.lit(False)
    for s in NOISE_SUFFIXES:
        ends = ends | low.endswith(s) | low.contains("." + s)
    return ends | F.arrays_overlap(F.split(low, r"\."), F.array(*[F.lit(p) for p in NOISE_PARTS]))


def normalised_sha(text: Column | str) -> Column:
    """SHA-256 after trimming and folding runs of blank lines."""
    trimmed = F.regexp_replace(as_col(text), r"^\s+|\s+$", "")
    return F.sha2(F.regexp_replace(trimmed, r"\n{3,}", "\n\n"), 256)


def term_pattern(term: str) -> str:
    """Regex of one term: word boundary around terms with Latin letters, else substring."""
    quoted = re.escape(term)
    return rf"(?iU)\b{quoted}\b" if re.search("[A-Za-z]", term) else quoted


def term_hit(term: Column | str, text: Column | str) -> Column:
    """The same rule for terms held in a column: the boundary form is a padded regex."""
    t, x = as_col(term), as_col(text)
    quoted = F.regexp_replace(t, r"([\\\[\](){}.*+?^$|\-])", r"\\$1")
    bounded = F.concat(F.lit(r"(?iU)\b"), quoted, F.lit(r"\b"))
    return F.when(t.rlike("[A-Za-z]"), F.regexp_like(x, bounded)).otherwise(F.contains(x, t))


def lines_of(text: Column | str) -> Column:
    """Array of lines; a trailing line break opens no extra line."""
    c = F.regexp_replace(as_col(text), r"(\r\n|\r|\n)$", "")
    return F.split(c, r"\r\n|\r|\n")


def keywords(text: Column | str) -> Column:
    """Distinct lower-case ASCII words of two letters or more, and CJK bigrams."""
    low = F.lower(as_col(text))
    words = F.filter(F.regexp_extract_all(low, F.lit("([a-z]+)"), 1), lambda w: F.length(w) >= 2)
    return F.array_distinct(F.concat(words, cjk_bigrams(low)))


def cjk_bigrams(text: Column | str) -> Column:
    """Adjacent pairs inside runs of CJK characters."""
    runs = F.regexp_extract_all(as_col(text), F.lit(f"({CJK_CLASS}{{2,}})"), 1)
    return F.flatten(
        F.transform(
            runs,
            lambda r: F.transform(
                F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))
            ),
        )
    )


def match_units(text: Column | str) -> Column:
    """What a keyword can equal inside a text: its whole words and its CJK bigrams.

    A Latin keyword matches on word boundaries, so a hit is equality with a whole word;
    a CJK keyword is a bigram, so a hit is equality with a bigram. This turns term
    matching into an equi-join.
    """
    low = F.lower(F.coalesce(as_col(text), F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"(?U)(\w+)"), 1)
    return F.array_distinct(F.concat(words, cjk_bigrams(low)))


def substrings(text: Column | str, lengths: Column | str) -> Column:
    """Distinct substrings of the lengths in an array column, for substring hits as an equi-join.

    Linear in the text: one pass per wanted length.
    """
    low = F.lower(F.coalesce(as_col(text), F.lit("")))

    def windows(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1)))
        return F.when(F.length(low) >= n, F.transform(starts, lambda i: F.substring(low, i, n))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.flatten(F.transform(as_col(lengths), windows)))


def identifiers(text: Column | str) -> Column:
    """Distinct lower-case identifiers of four characters or more, stop tokens removed."""
    found = F.regexp_extract_all(F.lower(as_col(text)), F.lit(IDENT_PATTERN), 1)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(s) for s in IDENT_STOP]))


def missing_terms(text: Column | str, required: Iterable[str]) -> Column:
    """Required terms that do not occur, in the order they were required."""
    want = F.array(*[F.lit(r) for r in required])
    return F.filter(want, lambda r: ~F.contains(as_col(text), r))
