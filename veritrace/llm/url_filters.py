"""URL filters: allow and block rules, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from pathlib import Path

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER

FEATURES = 1 << 16
LENGTHS = (3, 4, 5)
#: Share of pages that are to be blocked, as expected beforehand: the labelled table has about as many of either, the web has not.
BLOCK_SHARE = 1 / 3

#: Fixed values: (verdict, host/path) of rules.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

#: The labelled table: a label (block, allow) and a url in each line.
LABELLED = Path(__file__).with_name("labelled_urls.tsv")


def labelled_urls(spark: SparkSession, path: Path = LABELLED) -> DataFrame:
    """The small labelled table: url, label (1: block). It is a file of the package, read where the session is."""
    rows = [line.split("\t") for line in path.read_text(encoding="utf-8").splitlines() if line]
    return spark.createDataFrame([(url, float(label == "block")) for label, url in rows], "url string, label double")


def host_of(url: Column) -> Column:
    """After the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; '' without one or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to "?", "#" or the end; '' where there is no host."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column) -> Column:
    """Runs of LENGTHS characters of a text between marks of its begin and end."""
    padded = F.concat(F.lit("^"), text, F.lit("$"))

    def runs(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(runs, LENGTHS))


def _with_features(urls: DataFrame) -> DataFrame:
    """What stands in a host is the same feature where it stands in a path, so each learns from the other."""
    hashing = HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True)
    return hashing.transform(urls.withColumn("grams", F.array_union(_grams(F.col("host")), _grams(F.col("path")))))


def train(labelled: DataFrame, block_share: float = BLOCK_SHARE) -> LogisticRegressionModel:
    """Fit on a table of url and label (1: block); its size is that of a hand-made list. Both labels must occur.

    Rows weigh as if block_share of them were to be blocked, so that a url that tells nothing is allowed.
    """
    n, n_block = labelled.agg(F.count("*"), F.sum("label")).first()
    weight = F.when(F.col("label") == 1, block_share * n / n_block).otherwise((1 - block_share) * n / (n - n_block))
    urls = labelled.select("label", weight.alias("weight"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # n-grams are not scaled by their spread: that would make the rarest of a small table the heaviest
    fit = LogisticRegression(maxIter=60, regParam=0.003, standardization=False, featuresCol="features", labelCol="label", weightCol="weight")
    return fit.fit(_with_features(urls))


def _rule(rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (of equally long ones the least), as struct(verdict, rule); else null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = rule.partition("/")
        whole = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits.append(F.when(whole & F.col("path").startswith(slash + path), F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<verdict:string,rule:string>")


def judge_urls(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Judge every url.

    pages: page_id, url; other columns are ignored. A rule "host/path" fits its host and all
    its subdomains if the url's path starts with "/path"; the longest rule that fits wins. Where
    none fits, the model decides (block at a probability of 0.5). Returns one row per input row:
    page_id, host, path, rule (null where the model decided), verdict, probability (the
    model's, of block). A null url, or one without "://", has an empty host and path, fits no
    rule and is judged by the model on the empty strings. Repeated rows and null ids stay.
    """
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    scored = model.transform(_with_features(urls)).withColumn("probability", vector_to_array("probability")[1]).withColumn("fit", _rule(rules))
    learned = F.when(F.col("probability") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", learned).alias("verdict"), "probability")
