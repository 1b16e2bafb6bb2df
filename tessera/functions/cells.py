"""What a table cell holds: one grammar of patterns, read by Python (table engine) and by Spark's regex functions (queries)."""

from __future__ import annotations

import html
import re
import unicodedata
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, kinds and the patterns of values in filings.
CURRENCIES = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
MISSING = "—–-"
NUMERIC_KINDS = {"missing_numeric", "numeric_scalar", "numeric_range", "percentage", "percentage_range", "year", "year_range", "date", "duration"}
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
MONTH = "(?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec)"
YEAR = r"(?:19|20)\d{2}"
SCALAR = rf"[$€£¥]?\s*[+-]?\s*(?:{NUMBER}|\(\s*{NUMBER}\s*\))\s*%?"
DATE = rf"(?:\d{{1,2}}/\d{{1,2}}/{YEAR}|{YEAR}-\d{{2}}-\d{{2}}|{MONTH}\.?\s+\d{{1,2}},?\s+{YEAR})"
DURATION = r"\d+(?:\.\d+)?\s*(?:days?|months?|years?)?(?:\s*(?:-|to)\s*\d+(?:\.\d+)?\s*)?(?:days?|months?|years?)"
FILE_NUMBER = r"\d{3}-\d{5,}"
DOTTED = r"\d{1,3}(?:\.\d{1,4})+[A-Za-z+*†‡-]*"
PAGE = r"(?:[A-Za-z]{1,3}-\d{1,3}|\d{1,3})"
MISSING_TEXT = r"(?:n/?a|n\.?m\.?|not\s+meaningful|not\s+applicable)"
SUFFIX = r"(?:[*†‡]+|\(\d+\))"
TIGHT_RANGE = rf"[$€£¥]?\s*[+-]?\s*{NUMBER}(?:\s*%)?-[$€£¥]?{NUMBER}\s*%?"
RANGE = rf"(?:(?:{SCALAR})\s+(?:-|to)\s+(?:{SCALAR})|{TIGHT_RANGE})"
PLUS_MINUS = rf"\+/-\s*([$€£¥]?\s*{NUMBER})(?:\s*(bps?))?"


_BLANKS, _LINES = re.compile(r"[ \t]+"), re.compile(r"\n\s*\n+")


def normalize(text: str | None) -> str:
    """Entities, NFC, no-break spaces, soft hyphens and zero-width spaces, runs of blanks and of blank lines."""
    if not text:
        return ""
    if text.isascii() and "&" not in text:
        out = _BLANKS.sub(" ", text) if "  " in text or "\t" in text else text
        return (_LINES.sub("\n\n", out) if "\n" in out else out).strip()
    out = unicodedata.normalize("NFC", html.unescape(text))
    out = out.replace("\xa0", " ").replace("­", "").replace("​", "")
    return _LINES.sub("\n\n", _BLANKS.sub(" ", out)).strip()


@dataclass
class Cell:
    text: str
    kind: str = "text"
    numeric_value: float | None = None
    range_start: float | None = None
    range_end: float | None = None
    currency: str | None = None
    scale: str | None = None
    percent: bool = False
    accounting_negative: bool = False
    missing: bool = False
    footnote: str | None = None
    candidates: list[str] = field(default_factory=list)
    reason: str = "text_fallback"


def _full(pattern: str, text: str) -> re.Match | None:
    return re.fullmatch(pattern, text, re.IGNORECASE)


def scalar(text: str) -> dict | None:
    """Value, currency, percent and accounting sign of a single number."""
    if not _full(SCALAR, text):
        return None
    digits = re.search(NUMBER, text)
    inside = "(" in text
    value = float(digits.group().replace(",", ""))
    sign = -1 if inside or "-" in text[: digits.start()] else 1
    return {"numeric_value": sign * value, "currency": CURRENCIES.get(text[0]), "percent": text.endswith("%"), "accounting_negative": inside}


def _ends(text: str) -> tuple[dict, dict, str, str] | None:
    """Both numbers of a range `a - b`, `a to b` or `a-b`."""
    spaced = re.fullmatch(r"(.+?)\s+(?:-|to)\s+(.+)", text, re.IGNORECASE)
    tight = spaced or re.fullmatch(r"(.+?\d%?)-(?=[$€£¥]?\d)(.+)", text)
    if not tight:
        return None
    left, right = tight.group(1).strip(), tight.group(2).strip()
    a, b = scalar(left), scalar(right)
    return (a, b, left, right) if a and b else None


def analyze(raw: str | None) -> Cell:
    """The kind of a cell's text (a shared object; `refine` gives a new one). Short texts, which repeat, are analysed once a process."""
    return _analyzed(raw) if raw is not None and len(raw) <= 48 else _analyze(raw)


@lru_cache(maxsize=1 << 15)
def _analyzed(raw: str) -> Cell:
    return _analyze(raw)


def _analyze(raw: str | None) -> Cell:
    """The first rule that fits decides."""
    text = normalize(raw)
    plain = re.sub("[−–—]", "-", text)
    cell = Cell(text)

    def found(kind: str, reason: str, **values) -> Cell:
        cell.kind, cell.reason = kind, reason
        cell.candidates = [kind, *[c for c in cell.candidates if c != kind]]
        for k, v in values.items():
            setattr(cell, k, v)
        return cell

    tight = text.replace(" ", "")
    if not text:
        return found("empty", "empty")
    if text in set(MISSING):
        return found("missing_numeric", "missing_marker", missing=True)
    if _full(MISSING_TEXT, text):
        return found("missing_numeric", "textual_missing_marker", missing=True)
    if text in CURRENCIES:
        return found("currency_marker", "currency_marker", currency=CURRENCIES[text])
    if text == "%":
        return found("percent_marker", "percent_marker", percent=True)
    if re.fullmatch(f"[{MISSING}]%", tight):
        return found("percentage", "missing_percent_value", percent=True, missing=True)
    if re.fullmatch(f"[$€£¥][{MISSING}]", tight):
        return found("missing_numeric", "currency_missing_value", currency=CURRENCIES[text[0]], missing=True)
    if re.fullmatch("[*†‡]+", text):
        return found("footnote_marker", "footnote_marker", footnote=text)
    if _full(DATE, plain):
        return found("date", "date_grammar")
    if re.fullmatch(FILE_NUMBER, plain):
        return found("exhibit_or_file_identifier", "sec_file_number")
    if _full(DURATION, plain):
        numbers = [float(x) for x in re.findall(r"\d+(?:\.\d+)?", plain)]
        return found("duration", "duration" if len(numbers) == 1 else "duration_range", **({"numeric_value": numbers[0]} if len(numbers) == 1 else {"range_start": numbers[0], "range_end": numbers[1]}))
    body = plain
    tail = re.search(SUFFIX + "$", plain)
    if tail and tail.start() and "/" not in plain[: tail.start()]:
        body, cell.footnote = plain[: tail.start()].rstrip(), tail.group()
    around = _full(PLUS_MINUS, body)
    if around:
        one = scalar(re.sub(r"\s", "", around.group(1)))
        reach = abs(one["numeric_value"])
        return found("numeric_range", "symmetric_sensitivity_range", range_start=-reach, range_end=reach, currency=one["currency"], scale="basis_points" if around.group(2) else None)
    if "/" in body:
        a, b = (scalar(x.strip()) for x in body.split("/", 1))
        if a and b:
            return found("numeric_range", "paired_sensitivity_values", range_start=a["numeric_value"], range_end=b["numeric_value"], currency=a["currency"] or b["currency"])
    if re.fullmatch(DOTTED, plain):
        cell.candidates.append("exhibit_or_file_identifier")
    one = scalar(body)
    if one:
        if _full(PAGE, plain):
            cell.candidates.append("exhibit_or_file_identifier")
        if re.fullmatch(SUFFIX, text):
            cell.candidates.append("footnote_marker")
        kind = "percentage" if one["percent"] else "year" if re.fullmatch(YEAR, body) else "numeric_scalar"
        return found(kind, "accounting_scalar" if one["accounting_negative"] else "numeric_scalar", **one)
    ends = _ends(body)
    if ends:
        a, b, left, right = ends
        percent = a["percent"] or b["percent"]
        years = all(re.fullmatch(YEAR, x.lstrip("$€£¥ ")) for x in (left, right))
        kind = "percentage_range" if percent else "year_range" if years else "numeric_range"
        return found(kind, "typed_range", range_start=a["numeric_value"], range_end=b["numeric_value"], currency=a["currency"] or b["currency"], percent=percent)
    if _full(PAGE, plain):
        cell.candidates.append("exhibit_or_file_identifier")
    cell.candidates.append("text")
    return cell


def refine(cell: Cell, header: str = "", stable_prefix: bool = False) -> Cell:
    """An identifier column (by its header or a stable prefix) decides what a number alone leaves open."""
    words = normalize(header).casefold()
    if "exhibit_or_file_identifier" in cell.candidates and (stable_prefix or any(w in words for w in ("exhibit", "file number", "page"))):
        return replace(cell, kind="exhibit_or_file_identifier")
    return cell


def is_numeric(text: str) -> bool:
    return analyze(text).kind in NUMERIC_KINDS


def kind(text: Column) -> Column:
    """The kind of a cell as an expression (texts already normalized); the same ladder as `analyze`."""
    plain = F.regexp_replace(F.trim(text), "[−–—]", "-")
    suffix = F.regexp_extract(plain, rf"^(.+?)\s*{SUFFIX}$", 1)
    body = F.when((suffix != "") & ~F.contains(suffix, F.lit("/")), F.trim(suffix)).otherwise(plain)
    full = lambda c, p: c.rlike(f"^(?i:{p})$")
    scalar_ = f"(?:{SCALAR})"
    range_ = RANGE
    return (
        F.when(F.trim(text) == "", "empty")
        .when(full(F.trim(text), f"[{MISSING}]|{MISSING_TEXT}"), "missing_numeric")
        .when(full(plain, "[$€£¥]"), "currency_marker")
        .when(plain == "%", "percent_marker")
        .when(full(plain, r"-\s*%"), "percentage")
        .when(full(plain, r"[$€£¥]\s*-"), "missing_numeric")
        .when(full(plain, "[*†‡]+"), "footnote_marker")
        .when(full(plain, DATE), "date")
        .when(full(plain, FILE_NUMBER), "exhibit_or_file_identifier")
        .when(full(plain, DURATION), "duration")
        .when(full(body, PLUS_MINUS), "numeric_range")
        .when(full(body, rf"{scalar_}\s*/\s*{scalar_}"), "numeric_range")
        .when(full(body, SCALAR) & F.endswith(body, F.lit("%")), "percentage")
        .when(full(body, YEAR), "year")
        .when(full(body, SCALAR), "numeric_scalar")
        .when(full(body, range_) & F.contains(body, F.lit("%")), "percentage_range")
        .when(full(body, rf"[$€£¥]?\s*{YEAR}(?:\s+(?:-|to)\s+|-)[$€£¥]?\s*{YEAR}"), "year_range")
        .when(full(body, range_), "numeric_range")
        .otherwise("text")
    )
