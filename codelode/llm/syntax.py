"""Problem 4: files whose text is not valid for the language of their suffix.

Each text becomes a token stream; memoised partial derivatives of the language's grammar run over it. The first token
without a derivative is where the file breaks; a derivative that isn't nullable at the end means it was cut off.

Defined results: files with null content are no cases and in no rate; an empty text is valid where the grammar has the
empty sentence (not in JSON); a suffix without a grammar is always valid; repeated rows of a chunk count once. Files of a
suffix that has a grammar by the table of kinds, but none here, can't be judged: they are left out with a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_texts, suffix
from .grammars import TOKENS, check

CHECKED = "project_id string, rel_path string, lang_name string, fault string, line_no int"


def checked(chunks: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every file whose suffix has a grammar: fault is null for valid ones, else unexpected or truncated with its line."""
    missing = [r[0] for r in kinds.where("has_grammar").select(F.lower("extension").alias("e")).where(~F.col("e").isin(*TOKENS)).distinct().orderBy("e").limit(9).collect()]
    if missing:
        warnings.warn(f"files without a grammar here are not judged: {', '.join(missing)}", stacklevel=2)
    per = kinds.where("has_grammar").select(F.lower("extension").alias("_ext"), "lang_name").where(F.col("_ext").isin(*TOKENS)).dropDuplicates(["_ext"])
    known = chunks.withColumn("_ext", suffix(F.col("rel_path"))).join(per.select("_ext"), "_ext", "left_semi")
    texts = file_texts(known).where("text is not null").withColumn("_ext", suffix(F.col("rel_path"))).join(per, "_ext")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults, lines = [], []
            for ext, text in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found = check(text, ext)
                faults.append(found and found[0])
                lines.append(found and text.count("\n", 0, found[1]) + 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(faults, pa.string()), pa.array(lines, pa.int32())], names=["project_id", "rel_path", "lang_name", "fault", "line_no"])

    return texts.select("project_id", "rel_path", "lang_name", "_ext", "text").mapInArrow(run, CHECKED)


def invalid_files(chunks: DataFrame, kinds: DataFrame) -> DataFrame:
    return checked(chunks, kinds).where("fault is not null")


def invalid_rates(chunks: DataFrame, kinds: DataFrame) -> DataFrame:
    """(project_id, lang_name, files, invalid, rate)."""
    return (
        checked(chunks, kinds)
        .groupBy("project_id", "lang_name")
        .agg(F.count("*").alias("files"), F.count("fault").alias("invalid"))
        .withColumn("rate", F.col("invalid") / F.col("files"))
    )
