"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a mass before CO.
MASS_CO = r"(?<![A-Za-z])((?:M[tT]|[kKgG][tT]|[tT])?CO)"
BM25_WORD = "[a-z0-9]+"
WORD_SPLIT = r"(?U)\s+"


def normalize_co2(text: Column) -> Column:
    """`text` with CO2e brought together where rendering split it, by four rewrites in fixed order."""
    t = F.regexp_replace(text, r"(?iU)CO\s+2\s+eq", "CO2eq")
    t = F.regexp_replace(t, r"(?iU)CO\s+2\s+e", "CO2e")
    t = F.regexp_replace(t, r"(?iU)COe\s*q?\s*2", "CO2e")
    t = F.regexp_replace(t, r"(?iU)" + MASS_CO + r"([^\n]*)\n\s*(2eq?)", "$1\u0001$3\u0002$2")
    t = F.regexp_replace(t, "\u00012[eE][qQ]\u0002", "2eq")
    t = F.regexp_replace(t, "\u00012[eE]\u0002", "2e")
    return F.regexp_replace(t, r"(?U)" + MASS_CO + r"e([^\n]*)\n\s*2(?=\s*\n)", r"$1\2e$2")


def split_sentences(text: Column) -> Column:
    """Array of sentences by the plain rule: a blank after . ! or ? and before an ASCII capital or a bracket."""
    parts = F.split(text, r"(?U)(?<=[.!?])\s+(?=[A-Z(])")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")


def bm25_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({BM25_WORD})"), F.lit(1))


def tokens(text: Column) -> Column:
    """Distinct lower-case words parted by white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), WORD_SPLIT), lambda s: s != ""))


def keywords(queries: Column) -> Column:
    """Distinct lower-case words of more than three ASCII letters of all queries."""
    words = F.flatten(F.transform(queries, lambda q: F.regexp_extract_all(F.lower(q), F.lit("([a-z]+)"), F.lit(1))))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 3))


def keyword_share(line: Column, words: Column) -> Column:
    """Share of `words` that occur anywhere in the lower-case `line`."""
    hits = F.size(F.filter(words, lambda w: F.contains(line, w)))
    return hits / F.greatest(F.size(words), F.lit(1))


def heading_text(text: Column) -> Column:
    """Lower-case lines of a page that begin with #, joined by blanks; empty for NULL."""
    heads = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(r"(?U)^\s*#"))
    return F.lower(F.array_join(heads, " "))


def holds_any(haystack: Column, needles: Column) -> Column:
    """Whether any of `needles`, lower-cased, is in `haystack`; false for NULL needles."""
    return F.coalesce(F.exists(needles, lambda n: F.contains(haystack, F.lower(n))), F.lit(False))


def header_string(headers: Column, rows: Column) -> Column:
    """Non-blank headers and first cells of the first five rows, joined by ` | `."""
    firsts = F.transform(F.slice(F.coalesce(rows, F.array().cast("array<array<string>>")), 1, 5), lambda r: F.get(r, 0))
    parts = F.concat(F.coalesce(headers, F.array().cast("array<string>")), firsts)
    return F.array_join(F.filter(parts, lambda c: c.isNotNull() & (c != "")), " | ")
