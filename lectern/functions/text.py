"""Column expressions for words, tokens, sentences and paragraphs.

Java's ``\\w`` and ``\\s`` are ASCII unless told otherwise, so the classes are spelled out here once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that define a word, a blank and a sentence end.
BLANK = r"[\s\x1c-\x1f]"
TOKEN = r"[\p{L}\p{N}_]+"
SENTENCE_END = rf"(?U)(?<=[.!?]){BLANK}+"
UNEVEN_BLANKS = rf"(?U)[\s\x1c-\x1f&&[^ ]]{BLANK}*| {BLANK}+"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"


def strip(c: Column) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    return F.regexp_replace(c, rf"(?U)^{BLANK}+|{BLANK}+$", "")


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(r"(?U)[^\s\x1c-\x1f]")


def words(c: Column) -> Column:
    """Whitespace-separated words, no blanks."""
    return F.filter(F.split(c, rf"(?U){BLANK}+"), lambda w: w != "")


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def distinct_tokens(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def sentences(c: Column) -> Column:
    """Stripped sentences; blank pieces are dropped.

    A split takes all blanks behind a sentence end, so stripping the whole text once strips every sentence.
    """
    return F.filter(F.split(strip(c), SENTENCE_END), lambda s: s != "")


def paragraphs(c: Column, pattern: str = r"\n{2,}") -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda p: p != "")


def collapse(c: Column) -> Column:
    """Whitespace runs to one space, ends stripped; the many single spaces are not touched."""
    return strip(F.regexp_replace(c, UNEVEN_BLANKS, " "))


def excerpt(c: Column, length: int = 320) -> Column:
    return F.substring(collapse(c), 1, length)


def clip(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters with a trailing ellipsis when longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def strip_control(content: Column) -> Column:
    """Latin-1 decode of raw bytes with control characters removed."""
    return F.regexp_replace(F.decode(content, "ISO-8859-1"), CONTROL, "")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every letter run, lower-case the rest.

    ``initcap`` capitalises after blanks only; here a letter after ``-``, ``+`` or a digit counts too.
    """
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def contains_any(c: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for n in needles:
        hit = hit | F.contains(c, F.lit(n))
    return hit


def first_match(c: Column, rules: list[tuple[list[str], str]], default: str) -> Column:
    """Ordered substring rules: the first rule with a needle inside ``c`` names the result."""
    out = None
    for needles, result in rules:
        hit = contains_any(c, needles)
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(default))
