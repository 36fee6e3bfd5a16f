"""Aggregates of a project's report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codelode.functions import fixed
from codelode.functions.text import file_name, folders, human_size, is_test_file, language, module_of, ratio_label


def file_measures(files: DataFrame, chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(project_id, rel_path, ext, size_bytes, lines, symbols): one row for each file, the base of the reports."""
    key = ["project_id", "rel_path"]
    lines = chunks.groupBy(*key).agg(F.coalesce(F.max("end_line"), F.lit(0)).alias("lines"))
    names = symbols.groupBy(*key).agg(F.countDistinct("name").alias("symbols"))
    rows = files.select(*key, "ext", F.coalesce("size_bytes", F.lit(0)).alias("size_bytes")).join(lines, key, "left").join(names, key, "left")
    return rows.fillna(0, ["lines", "symbols"])


def languages(files: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent suffixes of each project."""
    counted = files.where("ext <> ''").groupBy("project_id", "ext").agg(F.count("*").alias("files"))
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("files"), "ext"))
    return counted.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def directory_counts(files: DataFrame) -> DataFrame:
    """Files by first and second path element and by the first alone (second null), in one rollup."""
    parts = F.split("rel_path", "/")
    rows = files.select("project_id", parts[0].alias("top"), F.get(parts, F.lit(1)).alias("sub"))
    both = rows.groupBy("project_id", "top").agg(F.count("*").alias("files")).withColumn("sub", F.lit(None).cast("string"))
    deep = rows.where("sub is not null").groupBy("project_id", "top", "sub").agg(F.count("*").alias("files"))
    return both.unionByName(deep)


def totals(measures: DataFrame) -> DataFrame:
    """A10."""
    return measures.groupBy("project_id").agg(
        F.count("*").alias("total_files"), F.sum("lines").alias("total_lines"), F.sum("size_bytes").alias("total_size_bytes"), F.sum("symbols").alias("total_symbols")
    )


def language_lines(measures: DataFrame, k: int = 10) -> DataFrame:
    """Lines by language with their share in thousandths, the k largest of each project."""
    by = measures.groupBy("project_id", "ext").agg(F.sum("lines").alias("lines"))
    all_ = W.partitionBy("project_id")
    rank = F.row_number().over(all_.orderBy(F.desc("lines"), "ext"))
    share = F.when(F.sum("lines").over(all_) > 0, F.expr("cast(lines * 1000 div sum(lines) over (partition by project_id) as bigint)")).otherwise(F.lit(0).cast("bigint"))
    return by.withColumn("permille", share).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).withColumn("language", language(F.col("ext")))


def top_files(measures: DataFrame, by: str, k: int = 5) -> DataFrame:
    """The k largest of each project by one measure; ties by path."""
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc(by), "rel_path"))
    return measures.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("project_id", "rank", "rel_path", by)


def fan_in(imports: DataFrame, k: int = 10) -> DataFrame:
    """The k files of each project that most edges lead to."""
    counted = imports.where("target_path is not null").groupBy("project_id", "target_path").agg(F.count("*").alias("imported_by"))
    rank = F.row_number().over(W.partitionBy("project_id").orderBy(F.desc("imported_by"), "target_path"))
    return counted.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)


def test_counts(files: DataFrame) -> DataFrame:
    """A13, P30."""
    rows = files.groupBy("project_id").agg(
        F.count_if(is_test_file(F.col("rel_path"))).alias("test_files"), F.count_if(~is_test_file(F.col("rel_path"))).alias("source_files")
    )
    ratio = F.when(F.col("source_files") > 0, F.col("test_files") * 100.0 / F.col("source_files")).otherwise(F.lit(0.0))
    return rows.withColumn("label", ratio_label(ratio))


def architectures(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(project_id, pattern, score, confidence): matching folders and two points for each marker file."""
    listing = files if listing is None else listing
    dirs = files.select("project_id", F.explode(folders(F.col("rel_path"))).alias("dir"))
    wanted = sorted({d for _, ds, _ in fixed.ARCHITECTURES for d in ds})
    have = dirs.where(F.col("dir").isin(*wanted)).groupBy("project_id").agg(F.collect_set("dir").alias("dirs"))
    names = sorted({m for *_, ms in fixed.ARCHITECTURES for m in ms})
    marks = listing.where(F.col("rel_path").isin(*names)).groupBy("project_id").agg(F.collect_set("rel_path").alias("marks"))
    both = have.join(marks, "project_id", "full")
    none = F.array().cast("array<string>")
    scores = []
    for name, ds, ms in fixed.ARCHITECTURES:
        n = F.size(F.array_intersect(F.coalesce("dirs", none), F.array(*map(F.lit, ds)))) if ds else F.lit(0)
        s = F.when((n >= 2) | (F.lit(len(ds) <= 2) & (n >= 1)), n).otherwise(F.lit(0))
        if ms:
            s = s + 2 * F.size(F.array_intersect(F.coalesce("marks", none), F.array(*map(F.lit, ms))))
        scores.append(F.struct(F.lit(name).alias("pattern"), s.alias("score")))
    each = both.select("project_id", F.explode(F.array(*scores)).alias("s")).select("project_id", "s.pattern", "s.score").where("score > 0")
    return each.withColumn("confidence", F.when(F.col("score") >= 3, "high").when(F.col("score") >= 2, "medium").otherwise("low"))


def infrastructure(listing: DataFrame) -> DataFrame:
    """(project_id, category, name) of marker files and folders; a folder is there if a path begins with it."""
    rules = F.array(*(F.struct(F.lit(m.rstrip("/")).alias("m"), F.lit(c).alias("category"), F.lit(n).alias("name")) for m, c, n in fixed.INFRASTRUCTURE))
    path = F.col("rel_path")
    hits = F.filter(rules, lambda r: (path == r["m"]) | path.startswith(F.concat(r["m"], F.lit("/"))))
    return listing.select("project_id", F.explode(hits).alias("r")).select("project_id", "r.category", "r.name").distinct()


def workflows(listing: DataFrame) -> DataFrame:
    """(project_id, category, name): how many workflows each project has, where it has some."""
    rows = listing.where(F.col("rel_path").rlike(r"^\.github/workflows/[^/]*\.ya?ml$")).groupBy("project_id").agg(F.countDistinct("rel_path").alias("n"))
    return rows.select("project_id", F.lit("ci_cd_detail").alias("category"), F.concat(F.col("n").cast("string"), F.lit(" workflow(s)")).alias("name"))


def connected_symbols(top: DataFrame, symbols: DataFrame, k: int = 8) -> DataFrame:
    """The files that most edges lead to, each with its first k symbols by line."""
    few = symbols.join(top.select("project_id", F.col("target_path").alias("rel_path")), ["project_id", "rel_path"], "left_semi")
    rank = F.row_number().over(W.partitionBy("project_id", "rel_path").orderBy("line", "name"))
    some = few.select("project_id", "rel_path", "name", "line").distinct().withColumn("r", rank).where(F.col("r") <= k)
    names = some.groupBy("project_id", F.col("rel_path").alias("target_path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("symbols"))
    return top.join(names, ["project_id", "target_path"], "left").withColumn("symbols", F.coalesce("symbols", F.array().cast("array<string>")))


def representative_files(measures: DataFrame, imports: DataFrame, k: int = 3) -> DataFrame:
    """The k best files of each module by symbols, name, fan-in and size."""
    edges = imports.where("target_path is not null").groupBy("project_id", F.col("target_path").alias("rel_path")).agg(F.count("*").alias("edges"))
    name = file_name(F.col("rel_path"))
    score = (
        F.col("symbols") * 2.0
        + F.when(name.isin(*fixed.REPRESENTATIVE_NAMES), 20.0).otherwise(0.0)
        + F.coalesce("edges", F.lit(0)) * 3.0
        + F.when(F.lower(name).startswith("readme"), 15.0).otherwise(0.0)
        + F.least(F.col("size_bytes") / 1024.0, F.lit(10.0))
    )
    rows = measures.join(edges, ["project_id", "rel_path"], "left").withColumn("score", score).withColumn("module", module_of(F.col("rel_path")))
    rank = F.row_number().over(W.partitionBy("project_id", "module").orderBy(F.desc("score"), "rel_path"))
    return rows.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select("project_id", "module", "rank", "rel_path", "score")


def module_edges(imports: DataFrame) -> DataFrame:
    """Distinct edges between different modules."""
    rows = imports.where("target_path is not null").select("project_id", module_of(F.col("source_path")).alias("module"), module_of(F.col("target_path")).alias("imports"))
    return rows.where("module <> imports").distinct()


def insights(one: DataFrame) -> DataFrame:
    """(project_id, insight) sentences from one row of measures for each project.

    Expects total_files, total_lines, pattern, frameworks, test_files, test_label, ci_cd, containers, entries and most_symbols.
    """
    n, lines = F.col("total_files"), F.col("total_lines")
    size = (
        F.when(n < 10, F.concat(F.lit("Small project with "), n.cast("string"), F.lit(" files")))
        .when(n < 50, F.concat(F.lit("Medium-sized project: "), n.cast("string"), F.lit(" files")))
        .when(n < 200, F.concat(F.lit("Substantial project: "), n.cast("string"), F.lit(" files")))
        .otherwise(F.concat(F.lit("Large codebase: "), n.cast("string"), F.lit(" files")))
    )
    average = F.when(n > 0, F.expr("cast(total_lines div total_files as bigint)"))
    said = F.array(
        size,
        F.when(F.col("pattern").isNotNull(), F.concat(F.lit("Architecture: "), "pattern")),
        F.when(F.size("frameworks") > 0, F.concat(F.lit("Tech stack: "), F.array_join("frameworks", ", "))),
        F.when(F.col("test_files") > 0, F.concat(F.lit("Test coverage: "), "test_label")).otherwise(F.lit("No test files detected")),
        F.when(F.size("ci_cd") > 0, F.concat(F.lit("CI/CD: "), F.array_join("ci_cd", ", "))),
        F.when(F.size("containers") > 0, F.concat(F.lit("Containerized with "), F.array_join("containers", ", "))),
        F.when(F.size("entries") > 0, F.concat(F.lit("Entry points: "), F.array_join(F.slice("entries", 1, 3), ", "))),
        F.when(average > 300, F.concat(F.lit("Average file length is "), average.cast("string"), F.lit(" lines")))
        .when(lines > 0, F.concat(F.lit("Clean file sizes averaging "), average.cast("string"), F.lit(" lines per file"))),
        F.when(F.col("most_symbols") > 20, F.concat(F.lit("Most complex file has "), F.col("most_symbols").cast("string"), F.lit(" symbols"))),
    )
    return one.select("project_id", F.explode(F.array_compact(said)).alias("insight"))


def size_label(measures: DataFrame) -> DataFrame:
    return measures.withColumn("size_human", human_size(F.col("size_bytes")))
