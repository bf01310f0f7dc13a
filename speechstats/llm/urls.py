"""URL filter: given rules first, gradient-boosted trees on lexical features for the URLs that no rule fits.

Labelled URLs are those that a rule decides.  Trees learn on a bounded sample of them (the ``TRAIN`` with the smallest
hash of the URL) from length, depth, digits, entropy, parameters and the block rates of the host's suffixes and of the
path's first part; these rates are counted over all labelled URLs and smoothed (what fewer than ``SMOOTH`` of
them have takes the overall rate).  While trees learn, a URL's rates leave out the fold that it is in
(``FOLDS`` by the hash of its host), as a host's own labels would stand for it.  A URL is blocked if its probability is
over one half.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule, and goes to the trees; with no
or one label among the labelled URLs everything without a rule gets that label (``allow`` without any); repeated rows are
judged one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .common import stored

# Fixed values: (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
TRAIN, SMOOTH, FOLDS = 20_000, 20.0, 5
FEATURES = ["url_chars", "host_chars", "path_chars", "labels", "depth", "digit_ratio", "entropy", "params", "param_chars", "dashes", "fragment", "secure", "last_suffix", "two_suffix", "first_part"]
#: Columns that have a rate, and its name.
RATED = {"suffix_1": "last_suffix", "suffix_2": "two_suffix", "segment": "first_part"}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    rest = F.when(F.contains("url", F.lit("://")), F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def with_rules(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (the longest that fits, else null) and ruling (its verdict)."""

    def fits(rule: tuple[str, str, str]) -> Column:
        _, host, path = rule
        return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))

    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    pick = lambda value: functools.reduce(lambda out, r: F.when(fits(r), F.lit(value(r))).otherwise(out), reversed(longest), F.lit(None).cast("string"))
    return pages.withColumn("rule", pick(lambda r: r[1] + r[2])).withColumn("ruling", pick(lambda r: r[0]))


def with_features(pages: DataFrame) -> DataFrame:
    """Adds the lexical features and the two suffixes."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    chars = F.split(url, "")
    share = lambda c: (n - F.length(F.replace(url, c, F.lit("")))) / n
    entropy = F.when(n == 0, 0.0).otherwise(F.aggregate(F.filter(F.array_distinct(chars), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.split("host", r"\.")
    count = lambda text, pattern: F.size(F.split(text, pattern)) - 1
    return pages.withColumns(
        {
            "url_chars": n.cast("double"),
            "host_chars": F.length("host").cast("double"),
            "path_chars": F.length("path").cast("double"),
            "labels": F.size(names).cast("double"),
            "depth": count(F.col("path"), "/").cast("double"),
            "digit_ratio": F.coalesce(F.try_divide(F.length(F.regexp_replace(url, "[^0-9]", "")), n), F.lit(0.0)),
            "entropy": entropy,
            "params": F.when(query == "", 0.0).otherwise((count(query, "&") + 1).cast("double")),
            "param_chars": F.length(query).cast("double"),
            "dashes": count(F.col("host"), "-").cast("double"),
            "fragment": F.contains(url, F.lit("#")).cast("double"),
            "secure": F.startswith(url, F.lit("https")).cast("double"),
            "segment": F.regexp_extract("path", "^/([^/]*)", 1),
            "suffix_1": F.element_at(names, -1),
            "suffix_2": F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), "."),
        }
    )


def _rates(known: DataFrame, column: str, prior: float, name: str) -> DataFrame:
    """Each value of ``column`` that ``SMOOTH`` labelled URLs have, with its smoothed block rate (first) and the rates without each fold, as an array."""
    inside = [F.col("fold") == k for k in range(FOLDS)]
    sums = known.groupBy(column).agg(
        F.sum("y").alias("y"), F.count("*").alias("n"), *(F.sum(F.when(c, F.col("y")).otherwise(0.0)).alias(f"y{k}") for k, c in enumerate(inside)), *(F.count_if(c).alias(f"n{k}") for k, c in enumerate(inside))
    )
    rate = lambda y, n: (y + SMOOTH * prior) / (n + SMOOTH)
    own = [rate(F.col("y") - F.col(f"y{k}"), F.col("n") - F.col(f"n{k}")) for k in range(FOLDS)]
    return sums.filter(F.col("n") >= SMOOTH).select(column, F.array(rate(F.col("y"), F.col("n")), *own).alias(name))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, keys: tuple[str, ...] = ("page_id",), learn: Column | None = None) -> DataFrame:
    """``keys``, host, path, rule, verdict and probability (the trees') of every row.

    ``learn``: a condition on ``keys`` and url; of the labelled URLs only those that meet it are counted and learned from.
    """
    rows = with_features(with_rules(parts(pages.select(*keys, "url")), rules))
    rows = rows.withColumn("known", F.col("ruling").isNotNull() & F.coalesce(F.lit(True) if learn is None else learn, F.lit(False)))
    rows = rows.withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int"))
    known = rows.filter("known").withColumn("y", (F.col("ruling") == "block").cast("double"))
    counts = known.agg(F.count("*").alias("n"), F.sum("y").alias("y")).first()
    prior = (counts.y or 0.0) / counts.n if counts.n else 0.0
    for column, name in RATED.items():
        # These are few beside URLs; Spark weighs their table's size when it picks the join.
        rows = rows.join(stored(_rates(known, column, prior, f"{name}_rates"), "rates"), column, "left")
    rate = lambda name, at: F.coalesce(F.get(f"{name}_rates", at), F.lit(prior))
    sample = rows.filter("known").withColumns({x: rate(x, F.col("fold") + 1) for x in RATED.values()})
    sample = sample.orderBy(F.xxhash64("url"), *keys).limit(TRAIN)
    rows = rows.withColumns({x: rate(x, F.lit(0)) for x in RATED.values()})
    sample = stored(sample.select(*FEATURES, (F.col("ruling") == "block").cast("double").alias("y")), "urls")
    fitted = boosting.fit(sample, FEATURES, "y")
    chance = boosting.probability(fitted, lambda k: F.col(FEATURES[k])) if fitted else F.lit(prior)
    judged = rows.withColumn("probability", chance)
    verdict = F.coalesce("ruling", F.when(F.col("probability") > 0.5, "block").otherwise("allow"))
    return judged.select(*keys, "host", "path", "rule", verdict.alias("verdict"), "probability")
