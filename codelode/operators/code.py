"""Symbols, chunks, imports and categories of source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions import fixed
from codelode.functions.text import file_name, has_segment, imports_in, is_test_file, lines, suffix, symbol_on

KEY = ["project_id", "rel_path"]


def extract_symbols(texts: DataFrame, extractor=None) -> DataFrame:
    """(key, name, type, line) of every line with a definition; narrow, no join with the patterns.

    extractor (X02): an object with suffixes and a method symbols(texts) of this result; it serves its suffixes instead.
    """
    ext = F.lower(suffix(F.col("rel_path")))
    if extractor is not None:
        theirs = ext.isin(*extractor.suffixes)
        return extract_symbols(texts.where(~theirs)).unionByName(extractor.symbols(texts.where(theirs)))
    each = texts.where(ext.isin(*fixed.SYMBOL_PATTERNS)).select(*KEY, ext.alias("_ext"), F.posexplode(lines(F.col("text"))).alias("_at", "_line"))
    once = F.explode(F.array_compact(F.array(symbol_on(F.col("_line"), F.col("_ext")))))  # a filter would have the patterns run twice
    found = each.select(*KEY, "_at", once.alias("_s"))
    return found.select(*KEY, F.substring_index("_s", " ", -1).alias("name"), F.substring_index("_s", " ", 1).alias("type"), (F.col("_at") + 1).alias("line"))


def chunk_texts(texts: DataFrame, symbols: DataFrame, longest: int = fixed.CHUNK_LINES) -> DataFrame:
    """(key, chunk_index, start_line, end_line, content, symbol_name) cut at symbols.

    Without symbols one chunk of the first PLAIN_LINES lines; else a header before the first symbol and one chunk for each,
    up to the line before the next and at most `longest` lines. The symbols of a file meet its text once; all the rest
    happens within the row.
    """
    marks = symbols.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("line", "name"))).alias("_marks"))
    body = texts.where("text is not null").select(*KEY, lines(F.col("text")).alias("_lines"))
    n, m = F.size("_lines"), F.col("_marks")
    span = lambda first, last, name: F.struct(first.cast("int").alias("start_line"), last.cast("int").alias("end_line"), name.alias("symbol_name"))
    none = F.lit(None).cast("string")

    def at(mark: Column, k: Column) -> Column:
        after = F.get(m, k + 1)["line"]
        return span(mark["line"], F.least(F.coalesce(after - 1, n), mark["line"] + longest - 1, n), mark["name"])

    plain = F.array(span(F.lit(1), F.least(n, F.lit(fixed.PLAIN_LINES)), none))
    header = F.when(m[0]["line"] > 1, F.array(span(F.lit(1), m[0]["line"] - 1, none))).otherwise(F.slice(plain, 1, 0))
    spans = F.when(m.isNull(), plain).otherwise(F.concat(header, F.transform(m, at)))
    content = lambda s: F.array_join(F.slice("_lines", s["start_line"], F.greatest(F.lit(0), s["end_line"] - s["start_line"] + 1)), "\n")
    whole = F.transform(spans, lambda s: F.struct(s["start_line"].alias("start_line"), s["end_line"].alias("end_line"), content(s).alias("content"), s["symbol_name"].alias("symbol_name")))
    rows = body.join(marks, KEY, "left").select(*KEY, F.posexplode(whole).alias("chunk_index", "_c"))
    return rows.select(*KEY, "chunk_index", "_c.start_line", "_c.end_line", "_c.content", "_c.symbol_name")


def extract_imports(texts: DataFrame) -> DataFrame:
    """(key, imported_name, at) in order of sight."""
    ext = F.lower(suffix(F.col("rel_path")))
    return texts.select(*KEY, F.posexplode(imports_in(F.col("text"), ext)).alias("at", "imported_name"))


def _normalised(path: Column) -> Column:
    """A path without "." and with ".." resolved."""
    step = lambda acc, x: (
        F.when((x == "") | (x == "."), acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    )
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame, normalise: bool = False) -> DataFrame:
    """target_path of each import, the first candidate that is a file of the project; null means outside.

    Without normalise a path with ".." never resolves; with it, it does.
    """
    ext = F.lower(suffix(F.col("rel_path")))
    name = F.col("imported_name")
    python = F.transform(F.array(*map(F.lit, fixed.PY_TARGETS)), lambda s: F.concat(F.replace(name, F.lit("."), F.lit("/")), s))
    base = F.regexp_extract("rel_path", r"^(.*)/[^/]*$", 1)
    joined = F.concat(F.when(base == "", F.lit("")).otherwise(F.concat(base, F.lit("/"))), name)
    plain = F.array_join(F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != ".")), "/")
    script = F.transform(F.array(*map(F.lit, fixed.SCRIPT_TARGETS)), lambda s: F.concat(_normalised(joined) if normalise else plain, s))
    candidates = F.when(ext == ".py", python).when(name.startswith("."), script).otherwise(F.array().cast("array<string>"))
    each = imports.select("project_id", "rel_path", "imported_name", F.posexplode(candidates).alias("_order", "target_path"))
    hit = each.join(files.select("project_id", F.col("rel_path").alias("target_path")), ["project_id", "target_path"])
    best = hit.groupBy("project_id", "rel_path", "imported_name").agg(F.min_by("target_path", "_order").alias("target_path"))
    return imports.join(best, ["project_id", "rel_path", "imported_name"], "left").select("project_id", F.col("rel_path").alias("source_path"), "imported_name", "target_path")


def categories(symbols: DataFrame) -> DataFrame:
    """(key, symbol_name, category, detail); a symbol may have several."""
    path, low = F.col("rel_path"), F.lower("name")
    ends = lambda names: low.rlike("(?:" + "|".join(names) + ")$")
    test = has_segment(path, fixed.TEST_DIRS) | F.lower(path).startswith("test_") | F.contains(F.lower(path), F.lit(".test.")) | F.contains(F.lower(path), F.lit(".spec."))
    found = F.array(
        F.when(has_segment(path, fixed.DTO_DIRS) | ends(fixed.DTO_NAMES), F.lit("dto")),
        F.when(test, F.lit("test")),
        F.when(has_segment(path, fixed.SERVICE_DIRS) | ends(("service",)), F.lit("service")),
        F.when(has_segment(path, fixed.CONFIG_DIRS), F.lit("config")),
        F.when(has_segment(path, fixed.MIDDLEWARE_DIRS), F.lit("middleware")),
    )
    return symbols.select(*KEY, F.col("name").alias("symbol_name"), F.explode(F.array_compact(found)).alias("category"), F.concat(F.lit("type="), "type").alias("detail"))


def route_categories(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """P15r: in files that define routes every function is one, else the first symbol stands for the file."""
    text = F.col("text")
    says = F.lit(False)
    for pattern in fixed.ROUTE_TEXTS:
        says = says | F.coalesce(text.rlike(pattern), F.lit(False))
    files = texts.where(has_segment(F.col("rel_path"), fixed.ROUTE_DIRS) | says).select(*KEY)
    mine = symbols.join(files, KEY, "left_semi")
    functions = mine.where(F.col("type").isin("function", "method"))
    each = functions.select(*KEY, F.col("name").alias("symbol_name"), F.lit("route").alias("category"), F.concat(F.lit("line="), F.coalesce("line", F.lit(0)).cast("string")).alias("detail"))
    rest = mine.join(functions.select(*KEY).distinct(), KEY, "left_anti")
    first = rest.groupBy(*KEY).agg(F.min_by("name", F.struct("line", "name")).alias("symbol_name"))
    return each.unionByName(first.select(*KEY, "symbol_name", F.lit("route").alias("category"), F.lit("file-level").alias("detail")))


def entry_points(texts: DataFrame) -> DataFrame:
    """(key, priority, description): file names in the order of the list, then guarded Python scripts."""
    name = file_name(F.col("rel_path"))
    rules = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(k).alias("priority"), F.lit(d).alias("description")) for k, (n, d) in enumerate(fixed.ENTRY_POINTS)))
    named = texts.select(*KEY, F.explode(F.filter(rules, lambda r: r["n"] == name)).alias("r")).select(*KEY, "r.priority", "r.description")
    guarded = texts.where(F.col("rel_path").endswith(".py") & F.contains("text", F.lit("__name__")) & F.contains("text", F.lit("__main__")))
    last = guarded.join(named.select(*KEY), KEY, "left_anti").select(*KEY, F.lit(len(fixed.ENTRY_POINTS)).alias("priority"), F.lit(fixed.GUARDED_SCRIPT).alias("description"))
    return named.unionByName(last)


def test_frameworks(first_chunks: DataFrame) -> DataFrame:
    """(project_id, framework) named in the first chunks of test files; rows of (key, text)."""
    rules = F.map_from_entries(F.array(*(F.struct(F.lit(e), F.array(*map(F.lit, names))) for e, names in fixed.TEST_FRAMEWORKS.items())))
    ext = F.lower(suffix(F.col("rel_path")))
    names = F.filter(F.coalesce(F.element_at(rules, ext), F.array().cast("array<string>")), lambda n: F.contains(F.lower("text"), n))
    return first_chunks.where(is_test_file(F.col("rel_path"))).select("project_id", F.explode(names).alias("framework")).distinct()
