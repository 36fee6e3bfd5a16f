"""The comprehensive report: every part is aggregated by project, then joined on the project alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codelode.functions import fixed
from codelode.operators import analytics as A
from codelode.operators import code as C
from codelode.operators import manifests as N


def _listed(rows: DataFrame, column: str, name: str, order: str | None = None) -> DataFrame:
    """Values of a project as one array: of the fixed lists of the report, or cut to a number by rank before."""
    item = F.struct(F.col(order or column).alias("o"), F.col(column).alias("v"))
    return rows.groupBy("project_id").agg(F.transform(F.array_sort(F.collect_set(item)), lambda x: x["v"]).alias(name))


def project_rows(files: DataFrame, chunks: DataFrame, symbols: DataFrame, imports: DataFrame, texts: DataFrame) -> DataFrame:
    measures = A.file_measures(files, chunks, symbols)
    most = measures.groupBy("project_id").agg(F.max("symbols").alias("most_symbols"))
    arch = A.architectures(files).groupBy("project_id").agg(F.max_by("pattern", F.struct("score", "pattern")).alias("pattern"))
    infra = A.infrastructure(files)
    place = F.row_number().over(W.partitionBy("project_id").orderBy("priority", "rel_path"))
    entries = C.entry_points(texts).withColumn("o", place).where(F.col("o") <= fixed.REPORT_ENTRIES)
    rows = A.totals(measures).join(most, "project_id", "left").join(A.test_counts(files).withColumnRenamed("label", "test_label"), "project_id", "left").join(arch, "project_id", "left")
    for part in (
        _listed(N.framework_hints(texts), "framework", "frameworks"),
        _listed(infra.where("category = 'ci_cd'"), "name", "ci_cd"),
        _listed(infra.where("category = 'containerization'"), "name", "containers"),
        _listed(entries, "rel_path", "entries", "o"),
        _listed(A.fan_in(imports), "target_path", "top_connected", "rank"),
        _listed(A.languages(files), "ext", "languages", "rank"),
    ):
        rows = rows.join(part, "project_id", "left")
    none = F.array().cast("array<string>")
    for c in ("frameworks", "ci_cd", "containers", "entries", "top_connected", "languages"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    return rows
