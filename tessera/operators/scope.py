"""Query scope: companies named, global and enumeration cues, and the scope class, as expressions over a query column."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import casefold

# Tickers with their aliases, cues for global questions, and patterns of open list questions.
COMPANY_ALIASES = {
    "AUR": ["aurora innovation", "aurora", "aurora driver"],
    "TSLA": ["tesla"],
    "MBLY": ["mobileye", "eyeq", "mobileye drive"],
    "GOOGL": ["alphabet", "google", "waymo"],
    "GM": ["general motors", "gm"],
    "F": ["ford motor company", "ford"],
    "NVDA": ["nvidia"],
    "QCOM": ["qualcomm", "snapdragon digital chassis", "snapdragon"],
    "APTV": ["aptiv"],
    "OUST": ["ouster"],
}
GLOBAL_CUES = ["other companies", "other strategies", "the others", "competitors", "the rest", "across the companies", "across the industry", "which companies", "who is most", "who is more"]
ENUMERATION_CUES = [r"\bwhich companies\b", r"\bwhat companies\b", r"\bwhich firms\b", r"\bwhat firms\b", r"\bwho (?:offers|operates|develops|provides|uses|builds|sells)\b"]

_EDGE, _END = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def companies(query: Column, aliases: dict[str, list[str]] = COMPANY_ALIASES) -> Column:
    """Tickers named by an alias (whole words) or as a ticker of 2 to 5 letters in any case, in the order of the dimension."""
    text = casefold(F.coalesce(query, F.lit("")))
    words = F.transform(F.filter(F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: w.rlike("^[A-Za-z]{2,5}$")), lambda w: F.upper(w))
    named = []
    for ticker, names in aliases.items():
        hit = text.rlike(_EDGE + "(?:" + "|".join(map(re.escape, names)) + ")" + _END)
        if 2 <= len(ticker) <= 5 and ticker.isascii() and ticker.isalpha():
            hit = hit | F.array_contains(words, ticker.upper())
        named.append(F.when(hit, F.lit(ticker)))
    return F.array_compact(F.array(*named))


def scope(query: Column, found: Column, cues: list[str] = GLOBAL_CUES, enumeration: list[str] = ENUMERATION_CUES) -> Column:
    """enumeration before global cues (anchored_global with companies, else global) before the number of companies."""
    text = casefold(F.coalesce(query, F.lit("")))
    lists = F.coalesce(query, F.lit("")).rlike("(?i)" + "|".join(enumeration))
    cue = F.lit(False)
    for c in cues:
        cue = cue | F.contains(text, F.lit(c))
    n = F.size(found)
    return F.when(lists, "enumeration").when(cue & (n > 0), "anchored_global").when(cue, "global").when(n == 1, "single_company").when(n > 1, "explicit_subset").otherwise("global")


def with_scope(queries: DataFrame, query: str, aliases: dict[str, list[str]] = COMPANY_ALIASES, cues: list[str] = GLOBAL_CUES, enumeration: list[str] = ENUMERATION_CUES) -> DataFrame:
    """Adds `companies` (array) and `scope`."""
    out = queries.withColumn("companies", companies(F.col(query), aliases))
    return out.withColumn("scope", scope(F.col(query), F.col("companies"), cues, enumeration))
