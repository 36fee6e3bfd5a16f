import pytest
from codelode.functions import text as T
from pyspark.sql import functions as F


def values(spark, rows, make, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, v {kind}")
    return [r[0] for r in df.select("k", make(F.col("v")).alias("o")).orderBy("k").select("o").collect()]


def test_human_size(spark):
    assert values(spark, [0, 500, 2048, 1048576, 1536, 2304, 2355, 5 * 1024**3, 3 * 1024**4], T.human_size, "bigint") == ["0 B", "500 B", "2.0 KB", "1.0 MB", "1.5 KB", "2.2 KB", "2.3 KB", "5.0 GB", "3.0 TB"]


def test_slug_and_id(spark):
    assert values(spark, ["/a/My Project", "x"], T.slug) == ["my-project", "x"]
    assert values(spark, ["/a/My Project"], T.project_id)[0].startswith("my-project_") and len(values(spark, ["/a/b"], T.project_id)[0]) == 14


def test_lines(spark):
    odd = "a\r\nb\rc\x0bd\x0ce" + chr(0x85) + "f" + chr(0x2028) + "g\n"
    assert values(spark, ["a\nb\n", "a", "", odd, "\n\n", None], T.lines) == [["a", "b"], ["a"], [], list("abcdefg"), ["", ""], None]
    assert values(spark, ["a\nb\n"], T.plain_lines) == [["a", "b", ""]]


def test_suffix(spark):
    assert values(spark, ["a/b.py", "a/.env", "a.b/c", "x.tar.gz", "Makefile", ".env.example"], T.suffix) == [".py", "", "", ".gz", "", ".example"]


@pytest.mark.parametrize(
    ("url", "name"),
    [("https://github.com/a/b", "a/b"), ("http://www.github.com/a/b.git", "a/b"), ("github.com/a/b/", "a/b"), ("a/b", "a/b"), (" a.x/b-c ", "a.x/b-c"), ("https://other.com/a/b", None), ("x", None), ("", None), ("a/b/c", None)],
)
def test_repository(spark, url, name):
    assert values(spark, [url], T.repository) == [name]
    from codelode.sources.repo import parse

    assert parse(url) == name


def test_comments_and_numbers(spark):
    assert values(spark, ["a\n\n  // c\n# d\n * e\n/* f\n  b"], T.without_comments) == ["a\n  b"]
    assert values(spark, ["x\ny"], T.numbered) == ["   1 | x\n   2 | y"]


def test_questions(spark):
    q = ["How many routes are there?", "give an account of models", "What is this project?", "where is login"]
    assert values(spark, q, T.is_aggregate_question) == [True, True, False, False]
    assert values(spark, q, T.is_overview_question) == [False, False, True, False]
    assert values(spark, q, T.category_asked_for) == ["route", "dto", None, None]


def test_labels(spark):
    assert values(spark, [90.0, 50.0, 30.0, 1.0, 0.0], T.ratio_label, "double") == ["Strong", "Good", "Moderate", "Low", "None detected"]
    assert values(spark, [".py", ".tsx", ".zig"], T.language) == ["Python", "React TSX", "ZIG"]
    paths = ["tests/a.py", "a/test_b.py", "a/b.test.ts", "a/b_test.go", "a/b.py", "latest/a.py"]
    assert values(spark, paths, T.is_test_file) == [True, True, True, True, False, False]
    assert values(spark, ["a/b", "c"], T.module_of) == ["a", "."]


def test_replacement_share_and_fences(spark):
    bad = chr(0xFFFD)
    assert values(spark, [bad + "abc", "", "abc"], T.replacement_share) == [0.25, 0.0, 0.0]
    assert values(spark, ['x\n```json\n{"a": 1}\n```\ny', "none"], T.fenced) == ['{"a": 1}', ""]


def test_confidence(spark):
    rows = [(1, 1, 0.0, "high"), (0, 1, 0.2, "high"), (0, 3, 0.08, "high"), (0, 1, 0.05, "medium"), (0, 2, 0.0, "medium"), (0, 1, 0.01, "low"), (1, 0, 0.0, "low")]
    df = spark.createDataFrame(rows, "h int, r int, q double, want string")
    assert all(x["got"] == x["want"] for x in df.select("want", T.confidence(F.col("h"), F.col("r"), F.col("q")).alias("got")).collect())


def test_every_symbol_pattern_needs_its_literal():
    got = {p: T.needed_literal(p) for ps in T.fixed.SYMBOL_PATTERNS.values() for p, _ in ps}
    assert got[r"const (?P<name>\w+)\s*=\s*(async\s*)?\("] == "const" and got[r"^(async\s+)?fn\s+(?P<name>\w+)\s*[(<]"] == "fn"
    assert got[r"^[\w\s\*]+\s+(?P<name>\w+)\s*\([^;]"] == "(" and got[r"\brecord\s+(?P<name>\w+)\s*[\s({]"] == "record"
    assert set(got.values()) == {"def", "async", "class", "function", "const", "interface", "type", "func", "struct", "(", "enum", "record", "delegate", "pub", "fn", "trait", "impl", "module"}
