"""Hybrid ranking, context packing, literal search and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codelode.functions import fixed
from codelode.functions.text import chunk_header, plain_lines
from codelode.functions.vector import dot

from .keywords import idf_scores, postings_of, query_terms, ranked


def symbol_scores(symbols: DataFrame, query: str) -> DataFrame:
    """Five points for each place where a symbol of the query's words is defined, whatever its case."""
    words = symbols.sparkSession.createDataFrame([(w,) for w in sorted(set(query.lower().split()))], "word string")
    hits = symbols.join(F.broadcast(words), F.lower("name") == F.col("word"))
    return hits.groupBy("rel_path").agg((F.count("*") * F.lit(float(fixed.SYMBOL_BOOST))).alias("score"))


def vector_hits(vectors: DataFrame, query: DataFrame, key: list[str], k: int = fixed.VECTOR_HITS) -> DataFrame:
    """The k rows most similar to the one vector q of the query frame, by dot product; ties by key."""
    scored = vectors.crossJoin(F.broadcast(query.limit(1))).select(*key, dot(F.col("vector"), F.col("q")).alias("sim"))
    return scored.orderBy(F.desc("sim"), *key).limit(k)


def vector_scores(hits: DataFrame, path: str = "rel_path") -> DataFrame:
    """Three times the similarity of each hit above the gate."""
    return hits.where(F.col("sim") > fixed.VECTOR_GATE).select(F.col(path).alias("rel_path"), (F.col("sim") * F.lit(float(fixed.VECTOR_BOOST))).alias("score"))


def hybrid_scores(texts: DataFrame, symbols: DataFrame, query: str, hits: DataFrame | None = None) -> DataFrame:
    """Contributions of keywords, symbols and vectors, added up by file."""
    total = texts.agg(F.count("*").alias("n"))
    parts = idf_scores(postings_of(texts, ["rel_path"], "text", query_terms(texts, query)), ["rel_path"], total)
    return combined(parts, symbols, query, hits)


def combined(parts: DataFrame, symbols: DataFrame, query: str, hits: DataFrame | None = None) -> DataFrame:
    """Scores of the keywords with those of symbols and vectors."""
    parts = parts.unionByName(symbol_scores(symbols, query))
    if hits is not None:
        parts = parts.unionByName(vector_scores(hits))
    return parts.groupBy("rel_path").agg(F.sum("score").alias("score"))


def relevant_files(texts: DataFrame, symbols: DataFrame, query: str, hits: DataFrame | None = None, k: int = fixed.TOP_FILES) -> DataFrame:
    return ranked(hybrid_scores(texts, symbols, query, hits), "rel_path", k)


def search_lines(texts: DataFrame, keys: list[str], query: str, k: int = fixed.SEARCH_HITS) -> DataFrame:
    """Lines that contain the query, whatever its case, the first k by key and line. Literal, never a pattern."""
    some = texts.where(F.contains(F.lower("text"), F.lit(query.lower())))
    each = some.select(*keys, F.posexplode(plain_lines(F.col("text"))).alias("_at", "_line"))
    found = each.where(F.contains(F.lower("_line"), F.lit(query.lower())))
    return found.select(*keys, (F.col("_at") + 1).cast("bigint").alias("line"), F.trim("_line").alias("content")).orderBy(*keys, "line").limit(k)


def _fold(chunks: Column, budget: int) -> Column:
    """W04 over array<struct<file_rank, chunk_index, part>>, sorted: in a file stop at the first part over the budget, go on with the next file."""
    start = F.struct(F.lit(0).alias("used"), F.lit(-1).alias("stopped"), F.array().cast("array<string>").alias("parts"))

    def step(acc, x):
        size = F.length(x["part"])
        skip = (acc["stopped"] == x["file_rank"]) | (acc["used"] >= budget)
        over = acc["used"] + size > budget
        return (
            F.when(skip, acc)
            .when(over, F.struct(acc["used"].alias("used"), x["file_rank"].alias("stopped"), acc["parts"].alias("parts")))
            .otherwise(F.struct((acc["used"] + size).alias("used"), acc["stopped"].alias("stopped"), F.concat(acc["parts"], F.array(x["part"])).alias("parts")))
        )

    return F.aggregate(chunks, start, step)


def packed_context(top: DataFrame, chunks: DataFrame, group: list[str], budget: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """(group, used, parts, context) from the chunks of ranked files (group, rel_path, file_rank).

    Chunks are limited to those of the few top files before they are collected.
    """
    head = chunk_header(F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("symbol_name"))
    part = F.concat(head, F.lit("\n"), F.col("content"))
    rows = chunks.join(top, "rel_path").where("content is not null").select(*group, "file_rank", "chunk_index", part.alias("part"))
    sorted_ = F.array_sort(F.collect_list(F.struct("file_rank", "chunk_index", "part")))
    folded = rows.groupBy(*group).agg(sorted_.alias("c")).select(*group, _fold(F.col("c"), budget).alias("f"))
    return folded.select(*group, F.col("f.used").alias("used"), F.size("f.parts").alias("parts"), F.array_join("f.parts", "\n\n").alias("context"))


def running_context(rows: DataFrame, group: list[str], order: list[str], size: Column, budget: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """The longest prefix whose sizes add up to the budget at most."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def confidence_inputs(scores: DataFrame, terms: DataFrame, total: DataFrame, hits: DataFrame) -> DataFrame:
    """One row with the number of ranked files, the ratio of the best score to the greatest possible, and symbol hits."""
    kept = scores.where(F.col("score") >= fixed.LEAST_SCORE).agg(F.count("*").alias("ranked"), F.coalesce(F.max("score"), F.lit(0.0)).alias("top"))
    one = kept.crossJoin(terms.agg(F.count("*").alias("terms"))).crossJoin(total).crossJoin(hits.agg(F.count("*").alias("hits")))  # one row each
    most = F.when(F.col("n") > 0, F.col("terms") * F.ln(F.col("n") + 1) + 5).otherwise(F.lit(1.0))
    return one.select("hits", "ranked", "top", (F.col("top") / most).alias("ratio"))


def prefix_matches(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose path begins with a folder's name, whatever its case. The folders are those of one decision (three at most)."""
    return files.join(F.broadcast(folders), F.lower("rel_path").startswith(F.lower("folder")))
