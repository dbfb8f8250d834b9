"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the addresses no rule decides."""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardline.session import stage_table

#: (verdict, host and path); a rule fits the host and its subdomains if the path starts with the rule's.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Distinct addresses with a known verdict that the trees are fitted on, at most: those with the smallest hash. Rates cover all rows.
TRAIN_ROWS = 20_000
TREES, DEPTH = 20, 4
FEATURES = ["length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "dots", "dashes", "fragment", "longest_part", "suffix_rate", "suffix_weight", "domain_rate", "domain_weight"]


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path; both empty without ``://``."""
    host = F.translate(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(F.regexp_extract("url", r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit("")))


def with_rule(pages: DataFrame, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """Adds rule and ruling of the longest rule that fits (of equal ones the first); both null if none does."""
    rule, ruling = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) & F.col("path").startswith(slash + rest)
        rule, ruling = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruling)
    return pages.withColumn("rule", rule).withColumn("ruling", ruling)


def with_lexical(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    n = F.length(url)
    chars = F.split(url, "(?!^)")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    entropy = F.log(n.cast("double")) - F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * F.log(c)) / n
    parts = F.split("path", "/")
    return pages.select(
        "*", n.cast("double").alias("length"), F.length("host").cast("double").alias("host_length"), (F.size(parts) - 1).cast("double").alias("depth"),
        F.when(n > 0, F.regexp_count(url, F.lit("[0-9]")) / n).otherwise(0.0).alias("digit_ratio"), F.when(n > 0, entropy).otherwise(0.0).alias("entropy"),
        F.regexp_count(url, F.lit(r"[?&][^=&#]+=")).cast("double").alias("parameters"), F.regexp_count(F.col("host"), F.lit(r"\.")).cast("double").alias("dots"),
        F.regexp_count(url, F.lit("-")).cast("double").alias("dashes"), F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.coalesce(F.array_max(F.transform(parts, F.length)), F.lit(0)).cast("double").alias("longest_part"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"), F.regexp_extract("host", r"([^.]*\.[^.]*)$", 1).alias("domain"),
    )


def _with_rates(rows: DataFrame, rates: dict[str, DataFrame], base: float) -> DataFrame:
    for key, table in rates.items():
        rows = rows.join(table, key, "left").fillna({f"{key}_rate": base, f"{key}_weight": 0.0})
    return rows


def url_verdicts(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, most: int = TRAIN_ROWS) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): (page_id, host, path, rule, verdict, block_score).

    The addresses that a rule decides are the labelled ones: trees learn from ``most`` distinct ones of them at most,
    together with how often suffix and domain are blocked in all labelled rows, and judge the rest (``block_score`` >= 0.5 blocks). If the
    labelled rows have one verdict only, it is everyone's; without any, all is allowed. A null address, or one without
    ``://``, has an empty host and path and no rule. Repeated rows are judged alike; other columns are ignored.
    """
    rows = with_lexical(with_rule(with_parts(pages.select("page_id", "url")), rules))
    known = rows.where("rule is not null").withColumn("label", (F.col("ruling") == "block").cast("double"))
    # a repeated address weighs by its rows in the rates and stands once in the sample
    every = known.groupBy("suffix", "domain").agg(F.count("*").alias("rows"), F.sum("label").alias("blocked"))
    every = stage_table(every, "counts")
    n, blocked = every.agg(F.sum("rows"), F.sum("blocked")).first()
    if not n or blocked in (0, n):
        score = rows.withColumn("block_score", F.lit(1.0 if n and blocked else 0.0))
    else:
        base = blocked / n
        rates = {
            key: every.groupBy(key).agg(((F.sum("blocked") + 10 * base) / (F.sum("rows") + 10)).alias(f"{key}_rate"), F.log1p(F.sum("rows").cast("double")).alias(f"{key}_weight"))
            for key in ("suffix", "domain")
        }
        rates = {k: stage_table(v, "rates") for k, v in rates.items()}
        turn = F.md5(F.concat(F.lit("url:"), F.col("url")).cast("binary"))
        distinct = known.select("url", "label", "suffix", "domain", *FEATURES[:10]).dropDuplicates(["url"])
        sample = stage_table(distinct.orderBy(turn, "url").limit(most), "labelled")
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features")
        fit = stage_table(_with_rates(sample, rates, base).select("label", *FEATURES), "fit")
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1, maxMemoryInMB=64).fit(vectors.transform(fit).select("features", "label"))
        score = trees.transform(vectors.transform(_with_rates(rows, rates, base))).withColumn("block_score", vector_to_array("probability")[1])
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return score.select("page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "block_score")
