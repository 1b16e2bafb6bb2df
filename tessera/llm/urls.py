"""URL filter: host and path rules first, then a character language-model ratio.

URLs that an `allow` or `block` rule decides are the accepted and rejected training sets. Per
class a variable-order Markov model (contexts of 0 to 3 characters) with Witten-Bell smoothing
gives the probability of every character of host + path; the mean of the log ratio over the
characters is the score. The threshold comes from held-out rule URLs: the point between both
class means, weighted by their spreads. All of it is DataFrame expressions: n-grams are
exploded, counted with partial aggregation and joined back by gram.

Characters outside a-z, 0-9 and .-/_%~ count as one class, so there are 45 of them with the
marks for start and end, and a gram of 4 is a number below 45**4 (4.1 million). The gram table is
broadcast whatever the number of URLs: a number and a ratio a gram, 24 bytes a row and 32 in the
hashed relation, at most 230 MB if every gram there can be occurs (the check data have 10,000).
A URL's grams are looked up and summed in the task that read it; one row a URL is shuffled.

Null urls, or urls without `://`, have an empty host and path; they are scored as the empty
string. Without training URLs of both classes every undecided URL is allowed. Repeated rows
are all returned; equal urls get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, stored

RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
ORDER = 4
ALPHABET = "^$*abcdefghijklmnopqrstuvwxyz0123456789.-/_%~"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first `://`, and the path up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^([^?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null: none). Of equally long rules the longer host wins, then block."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0].find("/"), r[1] == "block")):
        at = text.find("/") if "/" in text else len(text)
        fits = ((host == text[:at]) | F.endswith(host, F.lit("." + text[:at]))) & F.startswith(path, F.lit(text[at:]))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def grams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row (keys, gram) for each character of host + path and the end mark, with the ORDER - 1 characters before it, as a number to the base of the alphabet."""
    text = F.concat(F.lit("^" * (ORDER - 1)), F.regexp_replace(F.concat("host", "path"), r"[^a-z0-9.\-/_%~]", "*"), F.lit("$"))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    listed = rows.withColumn("codes", codes)
    number = lambda i: sum((F.get("codes", i + j) * len(ALPHABET) ** (ORDER - 1 - j) for j in range(1, ORDER)), F.get("codes", i) * len(ALPHABET) ** (ORDER - 1))
    return listed.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), F.size("codes") - ORDER), number)).alias("gram"))


def gram_model(counted: DataFrame) -> DataFrame:
    """(gram, ratio): log P(last | others, accepted) - log P(last | others, rejected), Witten-Bell from order 0 up.

    `counted` has a row for each gram of all URLs: gram, a and r (its training counts, 0 if unseen).
    """
    classes, base = ("a", "r"), len(ALPHABET)
    out = None
    for k in range(1, ORDER + 1):  # the last k characters of a gram, the k - 1 before the last as their context
        own = counted.groupBy((F.col("gram") % base**k).alias("g")).agg(*[F.sum(c).alias(c) for c in classes])
        own = own.withColumn("ctx", F.floor(F.col("g") / base).cast("int"))
        sums = own.groupBy("ctx").agg(*[F.sum(c).alias(f"n_{c}") for c in classes], *[F.count_if(F.col(c) > 0).alias(f"t_{c}") for c in classes])
        own = own.join(sums, "ctx")
        if out is None:
            own = own.select("g", *classes, "n_a", "t_a", "n_r", "t_r", *[F.lit(1 / base).alias(f"q_{c}") for c in classes])
        else:
            own = own.withColumn("low", F.col("g") % base ** (k - 1)).join(out.withColumnRenamed("g", "low"), "low")
        p = lambda c: F.when(F.col(f"n_{c}") == 0, F.col(f"q_{c}")).otherwise((F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}")))
        out = own.select("g", *[p(c).alias(f"q_{c}") for c in classes])
    return out.select(F.col("g").alias("gram"), (F.log("q_a") - F.log("q_r")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", held_out: int = 5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (mean log ratio a character; positive: more like the accepted URLs)."""
    host, path = host_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("said", said)
    fold = F.conv(F.substring(F.md5(F.concat("host", "path").cast("binary")), 1, 8), 16, 10).cast("long") % held_out == 0
    rows = rows.withColumn("use", F.when(F.col("said").isNull(), "none").when(fold, "tune").when(F.col("said") == "allow", "a").otherwise("r"))
    counted = stored(grams(rows, ["use"]).groupBy("gram").agg(F.count_if(F.col("use") == "a").alias("a"), F.count_if(F.col("use") == "r").alias("r")), "grams")
    model = stored(gram_model(counted), "gram-model")
    keys = ["page_id", "host", "path", "rule", "said", "use"]
    # the grams of a row are summed in the task that made them; `copies` counts the rows that repeat all keys
    scored = (
        grams(rows.withColumn("chars_n", F.length(F.concat("host", "path")) + 1), [*keys, "chars_n"])
        .join(F.broadcast(model), "gram", "left")  # at most 45**4 rows of two numbers
        .groupBy(*keys, "chars_n")
        .agg(F.avg(F.coalesce("ratio", F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n"))
    )
    scored = stored(scored, "url-scores")
    tune = scored.filter("use = 'tune'").groupBy("said").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("spread")).collect()  # two rows
    cut = _threshold({r.said: (r["mean"], r.spread) for r in tune})
    copies = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.col("n") / F.col("chars_n")).cast("int"))))
    verdict = F.coalesce("said", F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", copies.alias("copy")).drop("copy")


def _threshold(found: dict[str, tuple[float, float]]) -> float:
    """Between the held-out class means, nearer to the tighter class; -inf (all allowed) unless both classes occur."""
    if len(found) < 2:
        return float("-inf")
    (a, sa), (r, sr) = found["allow"], found["block"]
    return (a * sr + r * sa) / (sa + sr) if sa + sr > 0 else (a + r) / 2
