"""Text scalars as Columns; no UDF. Nulls count as empty texts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from headlight.functions.lexicons import BOILERPLATE, NOISE, STOPWORDS

SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
#: \b between ASCII word characters only.
EDGE_L, EDGE_R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def ascii_edges(pattern: str) -> str:
    """A pattern with \\b written for ASCII words: before a word character or group it opens, else it closes."""
    head, *rest = pattern.split(r"\b")
    out = head
    for x in rest:
        opens = bool(x) and x[0] not in "|)"
        out += (EDGE_L if opens else EDGE_R) + x
    return out


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " "))


def clamp(c: Column, low: int = 0, high: int = 100) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits; what white space is does not matter, as no other character is in a token."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), "")


def bind(value: Column, use) -> Column:
    """use(value) with value computed once, also within lambdas, where nothing else shares a common expression."""
    return F.transform(F.array(value), use)[0]


def listed(words: list[str]) -> str:
    """Words as literals of one expression: as Columns each would cost several calls to the JVM."""
    return ", ".join(f"'{w}'" for w in words)


def content_set(toks: Column) -> Column:
    """Distinct tokens that are no stop words, by first occurrence."""
    return F.array_except(toks, F.expr(f"array({listed(STOPWORDS)})"))


def content_bag(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~t.isin(STOPWORDS))


def sanitize(c: Column) -> Column:
    return normalize_space(F.regexp_replace(normalize_space(c), r"[{}\[\]\"]+", " "))


LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def count_of(c: Column, characters: str) -> Column:
    """How many characters of c are among these."""
    return F.length(c) - F.length(F.translate(c, characters, ""))


def is_noisy(c: Column) -> Column:
    n = F.greatest(F.length(c), F.lit(1))
    marks = lambda low: sum((F.contains(low, F.lit(x)).cast("int") for x in NOISE), F.lit(0)) >= 2
    # Most texts have none of the markers: one search for any of them comes before the thirteen.
    marked = bind(F.lower(c), lambda low: low.rlike("|".join(NOISE)) & marks(low))
    return (F.length(c) == 0) | (count_of(c, '{}[]"=:;,_') / n > 0.12) | (count_of(c, LETTERS) / n < 0.45) | marked


def is_readable(c: Column) -> Column:
    """c: sanitized text."""
    words = F.split(c, " ")
    return (F.length(c) >= 60) & ~is_noisy(c) & ~F.lower(c).rlike(BOILERPLATE) & (F.size(words) >= 10) & (F.size(F.filter(words, lambda w: F.length(w) > 20)) <= 2)


def numeric_claims(c: Column) -> Column:
    return F.regexp_count(c, F.lit(rf"{EDGE_L}[0-9]+(?:\.[0-9]+)?%?{EDGE_R}"))


def numeric_claims_both(head: Column, body: Column) -> Column:
    return F.regexp_count(F.concat(head, F.lit(" "), F.substring(body, 1, 1800)), F.lit(rf"{EDGE_L}[0-9]+(?:[.,][0-9]+)?{EDGE_R}"))


def read_minutes(words: Column, even: bool = False) -> Column:
    return F.greatest(F.lit(1), (F.bround if even else F.round)(words / 220).cast("int"))


def snippet(body: Column) -> Column:
    return F.coalesce(F.nullif(F.substring(normalize_space(body), 1, 300), F.lit("")), F.lit("Body text was unavailable."))


def snippet_dots(body: Column) -> Column:
    """The second engine's: 420 characters, and dots where the body is longer."""
    return F.concat(F.substring(normalize_space(body), 1, 420), F.when(F.length(body) > 420, "...").otherwise(""))


def word_count(c: Column) -> Column:
    """Runs of Unicode word characters: letters, numerals of any kind and the underscore."""
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}_]+"))


def gauge_offset(score: Column) -> Column:
    """The part of a circle of radius 52 that a score leaves open."""
    return F.lit(2 * math.pi * 52) * (1 - clamp(score) / 100)


def fixed(c: Column, digits: int = 3, even: bool = False) -> Column:
    """A number with so many places, rounded by its exact binary value; ties go up, or to the even digit as the second engine has it.

    (Java's formatting rounds the shortest decimal form instead.) The product's rounding error is had by splitting the factor.
    """
    scale, x = 10**digits, F.abs(c.cast("double"))
    high = F.lit(134_217_729.0) * x - (F.lit(134_217_729.0) * x - x)
    error = high * scale - x * scale + (x - high) * scale
    whole = F.floor(x * scale)
    part = x * scale - whole
    tie = (whole % 2 == 1) if even else F.lit(True)
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & tie)))
    n = whole + up.cast("long")
    return F.concat(F.when(c < 0, "-").otherwise(""), F.floor(n / scale).cast("string"), F.lit("."), F.lpad((n % scale).cast("string"), digits, "0"))


def yes_no(c: Column) -> Column:
    return F.when(c, "Yes").otherwise("No")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
