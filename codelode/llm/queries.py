"""The pN_ queries: each problem's operator, with production parameters, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import credentials, handwritten, lookalike, neighbours, packing, spans, splitting, syntax, tokens
from .common import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, sf_dir, "chunk_vectors"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_chunks(table(spark, sf_dir, "chunk_vectors"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks")).select("project_id", "rel_path").distinct()


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "files"), table(spark, sf_dir, "chunks"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.boundary_lines(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "split_limits"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "split_limits"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_files(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "file_kinds")).select("project_id", "rel_path")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_rates(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "file_kinds"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.sharing_chunks(table(spark, sf_dir, "chunks"))


def p5_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_share(table(spark, sf_dir, "chunks"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.chunk_classes(table(spark, sf_dir, "chunks"))


def p5_class_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.class_pairs(table(spark, sf_dir, "chunks"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.credential_lines(table(spark, sf_dir, "chunks"))


def p6_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.masked_contents(table(spark, sf_dir, "chunks"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf_dir, "documents"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_budgets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking(table(spark, sf_dir, "documents"))


def p9_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.consistent_texts(table(spark, sf_dir, "documents"))


def p9_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.form_classes(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_neighbours, p2_found, p2_reasons, p3_found, p3_pieces, p4_found, p4_rates, p5_found, p5_share, p5_classes, p5_class_pairs, p6_found, p6_masked, p7_ids, p8_packed, p9_found, p9_forms, p9_classes]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
