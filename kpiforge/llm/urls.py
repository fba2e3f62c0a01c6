"""URL filter: path rules, then logistic regression on hashed character n-grams (DataFrame functions only).

Rules decide the URLs they fit. A bounded sample of those decided URLs is the small labelled
table that the model learns from: host and path are cut into character n-grams, hashed, and a
logistic regression gives the verdict for every URL without a rule.

Defined cases: a null URL or one without ``://`` has empty host and path and gets the model's
verdict for them; without labelled URLs the verdict is ``allow``; with one kind of label, that kind.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import staged

Rule = tuple[str, str, str]  # verdict, host, path

#: Rules of the production query.
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host with A-Z in lower case, path without query and fragment)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule], verdict: bool) -> Column:
    """The longest rule (its text, or its verdict) that fits host or a parent domain and the path's start."""
    out = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit(kind if verdict else h + p)).otherwise(out)
    return out


def ngrams(text: Column, n: int, mark: str) -> Column:
    """Character n-grams of ``^text$``, each with a mark of the field it comes from."""
    s = F.concat(F.lit("^"), text, F.lit("$"))
    last = F.length(s) - (n - 1)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(s, i, n)))
    return grams


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url",
               max_labelled: int = 4_000, n: int = 4, features: int = 1 << 14) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (model's probability, null for ruled URLs).

    ``max_labelled`` bounds the labelled table: the distinct ruled (host, path) with the smallest hashes.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    parts = staged(parts.select("*", matching_rule(F.col("host"), F.col("path"), rules, False).alias("rule"),
                                matching_rule(F.col("host"), F.col("path"), rules, True).alias("ruled")), "url-parts")
    hashing = HashingTF(numFeatures=features, binary=True, inputCol="grams", outputCol="features")
    grams = F.concat(ngrams(F.col("host"), n, "h:"), ngrams(F.col("path"), n, "p:"))

    labelled = (parts.where(F.col("rule").isNotNull()).groupBy("host", "path")
                .agg(F.max("ruled").alias("ruled"))
                .orderBy(F.xxhash64("host", "path"), "host", "path").limit(max_labelled))
    train = staged(labelled.select(grams.alias("grams"), (F.col("ruled") == "block").cast("double").alias("label")),
                   "url-labels")
    kinds = [r["label"] for r in train.select("label").distinct().collect()]  # at most two rows
    if len(kinds) < 2:
        score = F.lit(kinds[0] if kinds else 0.0)
        scored = parts.withColumn("score", score)
    else:
        model = LogisticRegression(maxIter=60, regParam=0.005, standardization=False).fit(hashing.transform(train))
        scored = (model.transform(hashing.transform(parts.withColumn("grams", grams)))
                  .withColumn("score", vector_to_array("probability")[1]))
    own = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"),
                         F.when(F.col("rule").isNull(), F.col("score")).alias("block_score"))
