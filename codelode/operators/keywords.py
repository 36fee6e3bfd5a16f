"""Keywords, inverted index and inverse document frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codelode.functions import fixed
from codelode.functions.text import any_of, is_stop_word, words


def top_keywords(docs: DataFrame, keys: list[str], text: str, n: int = fixed.FILE_KEYWORDS) -> DataFrame:
    """(keys, keyword, tf, rank) by frequency, ties by first occurrence."""
    each = docs.select(*keys, F.posexplode(words(F.col(text))).alias("_at", "keyword")).where(~is_stop_word(F.col("keyword")))
    counted = each.groupBy(*keys, "keyword").agg(F.count("*").alias("tf"), F.min("_at").alias("_at"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("tf"), "_at"))
    return counted.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= n).drop("_at")


def query_terms(docs: DataFrame, query: str, n: int = fixed.QUERY_KEYWORDS) -> DataFrame:
    """Keywords of a query: at most n rows, hence fit for broadcast."""
    one = docs.sparkSession.createDataFrame([(0, query)], "q int, query string")
    return top_keywords(one, ["q"], "query", n).select("keyword")


def inverted_index(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keyword, keys) without repetition."""
    return top_keywords(docs, keys, text).select("keyword", *keys)


def idf(total: Column, df: Column) -> Column:
    """A03."""
    return F.ln((total - df + 0.5) / (df + 0.5) + 1)


def postings_of(docs: DataFrame, keys: list[str], text: str, terms: DataFrame, n: int = fixed.FILE_KEYWORDS) -> DataFrame:
    """J01 where no index is stored: index rows of the query's terms, ten at most and broadcast.

    Only texts that hold one of the terms can have it as a keyword; the others aren't taken apart. df comes from these rows
    alone.
    """
    wanted = [r["keyword"] for r in terms.collect()]
    some = docs.where(any_of(F.lower(F.col(text)), tuple(wanted))) if wanted else docs.where(F.lit(False))
    return top_keywords(some, keys, text, n).select("keyword", *keys).where(F.col("keyword").isin(*wanted) if wanted else F.lit(False))


def stored_postings(index: DataFrame, terms: list[str]) -> DataFrame:
    """The rows of a stored index for the terms of a query; the values reach the scan as a filter."""
    return index.where(F.col("keyword").isin(*terms)) if terms else index.where(F.lit(False))


def idf_scores(postings: DataFrame, keys: list[str], total: DataFrame) -> DataFrame:
    """(keys, score), the sum of idf over the terms; total is one row with n."""
    df = postings.groupBy("keyword").agg(F.count("*").alias("df"))
    weight = df.crossJoin(F.broadcast(total)).select("keyword", idf(F.col("n"), F.col("df")).alias("w"))  # ten rows by one
    return postings.join(F.broadcast(weight), "keyword").groupBy(*keys).agg(F.sum("w").alias("score"))


def ranked(scores: DataFrame, key: str, k: int = fixed.TOP_FILES) -> DataFrame:
    """The k best with a score of LEAST_SCORE or more; ties by key."""
    kept = scores.where(F.col("score") >= fixed.LEAST_SCORE)
    return kept.orderBy(F.desc("score"), key).limit(k)
