"""Reading the tables of a corpus: the valid row of each key, and the text of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep_last(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Of the rows of a key the first in that order; a partial and a final limit, no whole group in memory."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def valid_files(spark: SparkSession, folder: str) -> DataFrame:
    """The latest scan of every file, with its suffix from the path."""
    from codelode.functions.text import suffix

    rows = table(spark, folder, "files")
    order = [F.desc_nulls_last(c) for c in ("scanned_at", "size_bytes", "last_modified", "extension")]
    return keep_last(rows, ["project_id", "rel_path"], *order).withColumn("ext", F.lower(suffix(F.col("rel_path"))))


def valid_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk once."""
    return keep_last(table(spark, folder, "chunks"), ["chunk_id"], F.desc_nulls_last("ingested_at"))


def file_texts(chunks: DataFrame) -> DataFrame:
    """(project_id, rel_path, text), contents in order joined by line feeds; null where every content is.

    Rows of a chunk_id may be repeated: the latest counts. One shuffle of the contents does both; a task holds one file's rows.
    """
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "ingested_at", "content")))
    once = F.filter("rows", lambda x, i: ~F.get("rows", i + 1)["chunk_id"].eqNullSafe(x["chunk_id"]) | x["chunk_id"].isNull())
    text = F.array_join(F.transform(once, lambda x: x["content"]), "\n")
    return (
        chunks.groupBy("project_id", "rel_path")
        .agg(rows.alias("rows"), F.count("content").alias("n"))
        .select("project_id", "rel_path", F.when(F.col("n") > 0, text).alias("text"))
    )


def valid_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "symbols").distinct()


def valid_imports(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "file_imports").distinct()
