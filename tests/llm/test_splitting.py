import random

from codelode.llm.boundaries import boundaries
from codelode.llm.splitting import boundary_lines, cut, pieces


def lines(text, ext):
    return [k + 1 for k, _ in boundaries(text, ext)]


def test_python():
    text = 'import a\n\n# about f\n@d(\n    1,\n)\ndef f():\n    s = """\ndef no():\n"""\n    def inner(): pass\n\n\nclass C:\n    def m(self): pass\n\nasync def g():\n    pass\n'
    assert lines(text, ".py") == [1, 3, 14, 17]


def test_scripts():
    text = "import a;\n\n/**\n * f\n */\nexport function f() {\n  const t = `\nfunction no() {}\n`;\n  const r = /[\"'({]+x/;\n}\n\nconst g = async (a, b = (1)) => {\n};\nconst v = [1];\n// c\nclass C {\n  m() {}\n}\n"
    assert lines(text, ".js") == [1, 3, 13, 16]
    assert lines("interface A<T> {}\n\nexport const f = (a: number, b: string): Map<string, number> => {\n};\ntype X = 1;\n", ".ts") == [1, 3]


def test_go_java_shell():
    assert lines("package p\n\n// T\ntype T struct {\n}\n\nfunc (s *T) M() {\n\tx := `\nfunc no() {}\n`\n}\n\nfunc f() {}\n", ".go") == [1, 3, 7, 13]
    java = 'package a;\n\n/** C */\npublic class C {\n    private int x = 1;\n\n    // m\n    @Override\n    public List<String> m(int a) {\n        if (x > 1) { call(a); }\n        return new Foo() { };\n    }\n\n    C(int y) { }\n}\n'
    assert lines(java, ".java") == [1, 3, 7, 14]
    assert lines("#!/bin/sh\n\nf() {\n  cat <<EOF\ng() {\nEOF\n}\n\n# h\nfunction h {\n}\n", ".sh") == [1, 3, 9]


def test_markdown_yaml_other():
    assert lines("# A\ntext\n```sh\n# no\n```\n## B\n<!--\n# no\n-->\nC\n===\n", ".md") == [1, 6, 10]
    assert lines('a:\n  b: 1\n# c\n"c d": 2\n- x\ne: |\n  f: 1\n', ".yaml") == [1, 3, 6]
    assert lines("{\n}\n", ".json") == [1]


def test_cut_is_whole_and_within_the_limit():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab \n") for _ in range(rng.randrange(1, 400)))
        starts = [0, *(k + 1 for k, c in enumerate(text) if c == "\n")]
        marks = sorted({0, *rng.sample(starts, min(4, len(starts)))})
        limit, overlap = rng.randrange(1, 60), rng.randrange(0, 30)
        found = cut(text, marks, starts, limit, overlap)
        assert "".join(text[b:c] for _, b, c in found) == text
        assert all(c - a <= limit and 0 <= b - a <= overlap for a, b, c in found)


def test_operator(spark):
    body = "\n".join(f"def f{k}():\n    return {k}\n" for k in range(300))
    rows = [(1, "a/x.py", body, 11, "s"), (1, "a/x.py", body, 11, "s"), (2, "a/y.py", "short", 1, None), (3, "a/z.PY", "x" * 5000, None, None), (4, None, body, 1, None), (5, "a/n.py", None, 1, None), (6, "a/e.md", "", 1, None), (7, "a/q.zzz", body, 1, None)]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, rel_path string, content string, start_line int, symbol_name string").selectExpr("*", "'x' as extension", "0 as max_chars", "1 as piece")
    limits = spark.createDataFrame([(".py", 3000, 200), (".py", 3000, 200), (".md", None, 1)], "extension string, max_chars int, overlap_chars int")
    got = {tuple(r) for r in boundary_lines(chunks, limits).collect()}
    assert got == {(1, 1 + 3 * k) for k in range(300)} | {(3, 1)}
    out = sorted((r for r in pieces(chunks, limits).collect() if r["chunk_id"] == 1), key=lambda r: r["piece"])
    assert "".join(r["content"][r["repeated_chars"] :] for r in out) == body and out[0]["start_line"] == 11 and all(len(r["content"]) <= 3000 for r in out)
    assert out[1]["symbol_name"].startswith("f")
    assert boundary_lines(chunks.limit(0), limits).count() == 0


def test_pieces_begin_at_the_boundaries_found_on_the_test_tables(spark):
    import os
    from bisect import bisect_right

    import pytest
    from codelode.llm.common import suffix, table

    at = "/root/testdata/sf0.01"
    if not os.path.isdir(at):
        pytest.skip("no test tables here")
    chunks, limits = table(spark, at, "chunks"), table(spark, at, "split_limits")
    found, texts = {}, {}
    for r in boundary_lines(chunks, limits).collect():
        found.setdefault(r["chunk_id"], []).append(r["line_no"])
    most = {r["extension"]: r["max_chars"] for r in limits.collect()}
    for r in chunks.where("content is not null").select("chunk_id", "content", suffix(chunks["rel_path"]).alias("e")).collect():
        texts[r["chunk_id"]] = (r["content"], most.get(r["e"]))
    got = {}
    for r in pieces(chunks, limits).collect():
        got.setdefault(r["chunk_id"], []).append(r)
    assert set(got) == set(found) and len(got) > 30
    for key, rows in got.items():
        text, limit = texts[key]
        lines = [0, *(k + 1 for k, c in enumerate(text) if c == "\n")]
        marks = sorted(lines[n - 1] for n in found[key])
        new, before = 0, None
        for r in sorted(rows, key=lambda r: r["piece"]):
            assert len(r["content"]) <= limit
            if before is not None:
                k = bisect_right(marks, before[0] + limit) - 1
                assert marks[k] <= before[1] or new == marks[k]  # the last boundary that the piece before could reach
            before = (new - r["repeated_chars"], new)
            new += len(r["content"]) - r["repeated_chars"]
        assert new == len(text)
