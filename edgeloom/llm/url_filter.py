"""URL filter: rules first, then a logistic regression on hashed character n-grams of host and path.

The labelled table is small: a bounded, seeded choice of the URLs that a rule decides, labelled by that rule (or any
table of url and label a caller has). Training and scoring run on Spark's own ML on the JVM.

Defined results: a null url or one without `://` has an empty host and path, no rule, and is judged by the method like
any other; repeated rows are judged each; if the labelled URLs hold one verdict only, that is the verdict of the
method, and without any it is `allow`. Very long URLs are split into characters once, so work grows with their length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import ascii_lower, column

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """`text` is a host, then a path from its first slash; it fits the host and its subdomains."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


# The rules asked for.
RULES = (
    Rule(ALLOW, "org/"),
    Rule(BLOCK, "example.org/es/"),
    Rule(BLOCK, "example.org/en/1"),
    Rule(ALLOW, "com/fr/"),
    Rule(BLOCK, "com/de/"),
)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(_part(url, 1))


def path_of(url: Column) -> Column:
    return _part(url, 2)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text of the longest rule that fits; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first: outermost
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, rule.text).otherwise(found)
    return found


def rule_verdict(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    verdict = F.lit(None).cast("string")
    for r in rules:
        verdict = F.when(rule == r.text, r.verdict).otherwise(verdict)
    return verdict


def grams(text: Column, mark: str, n: int) -> Column:
    """Character n-grams of a text with its ends marked, each with the mark of its part."""

    def of(signs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(signs)), lambda i: i + (n - 1) <= F.size(signs))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), *[F.element_at(signs, i + k) for k in range(n)]))

    # A list in a list: the text is split once and bound to a name, not split again for each n-gram.
    signs = F.split(F.concat(F.lit("^"), text, F.lit("$")), "")
    return F.element_at(F.transform(F.array(signs), of), 1)


def features(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    return F.concat(*[grams(part, mark, n) for part, mark in ((host, "h:"), (path, "p:")) for n in sizes])


def labelled_urls(urls: DataFrame, max_rows: int = 4000, seed: int = 11) -> DataFrame:
    """At most `max_rows` different URLs that a rule decides, chosen by a seeded hash: host, path, label."""
    known = urls.filter(F.col("rule").isNotNull()).select("host", "path", rule_verdict(F.col("rule")).alias("verdict"))
    return (
        known.withColumn("at", F.xxhash64(F.lit(seed), "host", "path"))
        .distinct()
        .orderBy("at", "host", "path")
        .limit(max_rows)
        .select("host", "path", (F.col("verdict") == ALLOW).cast("double").alias("label"))
    )


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    labelled: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    n_features: int = 4096,
    max_rows: int = 4000,
) -> DataFrame:
    """The rows of `pages` with host, path, rule and verdict, in place of columns of these names."""
    clash = {"host", "path", "rule", "verdict"}
    link = column(pages, url)
    # The row itself travels as one column, so its names clash with none of the model's.
    row = F.struct(*[column(pages, c).alias(c) for c in pages.columns if c not in clash])
    urls = pages.select(row.alias("row"), host_of(link).alias("host"), path_of(link).alias("path"))
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    small = labelled_urls(urls, max_rows) if labelled is None else labelled
    hashing = HashingTF(numFeatures=n_features, inputCol="grams", outputCol="hashed")
    train = hashing.transform(small.withColumn("grams", features(F.col("host"), F.col("path")))).select("hashed", "label").cache()
    labels = {r.label for r in train.select("label").distinct().collect()}  # at most two
    decided = rule_verdict(F.col("rule"), rules)
    if len(labels) < 2:
        only = BLOCK if labels == {0.0} else ALLOW
        return urls.select("row.*", "host", "path", "rule", F.coalesce(decided, F.lit(only)).alias("verdict"))
    model = LogisticRegression(featuresCol="hashed", labelCol="label", predictionCol="says", maxIter=30, regParam=0.01).fit(train)
    train.unpersist()
    marked = hashing.transform(urls.withColumn("grams", features(F.col("host"), F.col("path"))))
    says = F.when(F.col("says") == 1.0, ALLOW).otherwise(BLOCK)
    return model.transform(marked).select("row.*", "host", "path", "rule", F.coalesce(decided, says).alias("verdict"))
