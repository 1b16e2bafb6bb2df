"""Scalar text functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words of the classic Lucene analyser.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not",
    "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
WORD = r"[\p{L}\p{N}_]{2,}"
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"


def search_terms(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-cased words of two or more letters, digits or underscores, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop_words)) if stop_words else found


def tokens(text: Column) -> Column:
    """The default tokenizer: runs of word characters, or one other visible character."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def casefold(text: Column) -> Column:
    """Lower case with ß as ss (the one full folding that occurs in the data)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def canonical(text: Column) -> Column:
    """White space collapsed, trimmed, case-folded."""
    return casefold(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalize(text: Column) -> Column:
    """No-break spaces to spaces, soft hyphens and zero-width spaces dropped, blanks collapsed, blank lines collapsed, trimmed."""
    out = F.replace(text, F.lit(" "), F.lit(" "))
    out = F.regexp_replace(out, "[­​]", "")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" *\n *", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{2,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def iso_date(text: Column) -> Column:
    """ISO form of a date written in one of four ways; any other text is passed through."""
    clean = F.trim(text)
    forms = ("yyyy-MM-dd", "MMMM d, yyyy", "MM/dd/yyyy", "yyyyMMdd")
    shapes = (r"^\d{4}-\d{2}-\d{2}$", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", r"^\d{2}/\d{2}/\d{4}$", r"^\d{8}$")
    tried = [F.when(clean.rlike(s), F.date_format(F.try_to_timestamp(clean, F.lit(f)), "yyyy-MM-dd")) for f, s in zip(forms, shapes)]
    return F.coalesce(*tried, text)


def token_overlap(expected: Column, actual: Column) -> Column:
    """Share of the expected token set found in the actual one; 1 if nothing is expected."""
    want = F.array_distinct(expected)
    return F.when(F.size(want) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(want, actual)) / F.size(want))


def ordered_digest(items: Column, position: Column) -> Column:
    """SHA-256 of the collected items in order of position, each ended by a line break (an aggregate)."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), items.alias("v")))), lambda x: x["v"])
    return F.sha2(F.concat(F.array_join(ordered, "\n"), F.lit("\n")), 256)
