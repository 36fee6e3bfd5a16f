import math
import random

import pytest
from codelode.functions import fixed
from codelode.operators import analytics as A
from codelode.operators import code as C
from codelode.operators import keywords as K
from codelode.operators import maintenance as M
from codelode.operators import manifests as N
from codelode.operators import retrieval as R
from fixture_code import FILES, texts
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def base(spark):
    t = texts(spark).persist()
    return t, C.extract_symbols(t).persist()


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_keywords(spark):
    docs = spark.createDataFrame([(1, "get_user_name getUserName the of beta beta alpha alpha"), (2, ""), (3, None), (4, "the with if")], "d int, text string")
    got = {}
    for r in sorted(K.top_keywords(docs, ["d"], "text").collect(), key=lambda r: (r["d"], r["rank"])):
        got.setdefault(r["d"], []).append(r["keyword"])
    assert got == {1: ["beta", "alpha", "get", "user", "name", "getusername"]}


def test_idf_against_plain_python(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for k in range(40)]
    df = spark.createDataFrame(docs, "d int, text string")
    terms = K.query_terms(df, "alpha gamma unknown")
    total = df.agg(F.count("*").alias("n"))
    got = {r["d"]: r["score"] for r in K.idf_scores(K.postings_of(df, ["d"], "text", terms), ["d"], total).collect()}
    want = {}
    for w in ("alpha", "gamma"):
        having = [k for k, t in docs if w in t.split()]
        for k in having:
            want[k] = want.get(k, 0) + math.log((40 - len(having) + 0.5) / (len(having) + 0.5) + 1)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_symbols(base):
    got = {}
    for r in base[1].collect():
        got.setdefault(r["rel_path"], set()).add((r["name"], r["type"], r["line"]))
    assert got["app/store.py"] == {("Store", "class", 4), ("load", "function", 5), ("save", "function", 8)}
    assert got["web/index.ts"] == {("Shape", "interface", 3), ("Name", "type", 4), ("View", "class", 5), ("run", "function", 6), ("go", "function", 7)}
    assert got["svc/main.go"] == {("Server", "type", 5), ("Runner", "interface", 8), ("Start", "function", 11), ("main", "function", 14)}
    assert ("find", "function", 4) in got["svc/services/UserService.java"] and ("lookup", "function", 5) in got["svc/services/UserService.java"]
    assert got["odd/ends.py"] == {("f", "function", 2), ("C", "class", 4)}
    assert "README.md" not in got and "empty.py" not in got


def test_symbols_by_syntax_tree(base):
    from codelode.plugins import PythonSymbols

    got = {(r["rel_path"], r["name"], r["line"]) for r in C.extract_symbols(base[0], PythonSymbols()).collect()}
    assert {("app/store.py", "save", 8), ("svc/main.go", "Start", 11)} <= got


def test_repeated_and_late_chunks(spark):
    from codelode.sources.tables import file_texts

    rows = [("p", "f", 1, 11, "b", 1), ("p", "f", 0, 10, "old", 1), ("p", "f", 0, 10, "a", 2), ("p", "f", 1, 11, "b", 1), ("p", "g", 0, 12, None, 1), ("p", "h", 0, 13, "x", None), ("p", "h", 0, 13, "y", 5), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "project_id string, rel_path string, chunk_index int, chunk_id bigint, content string, ingested_at int")
    assert {r["rel_path"]: r["text"] for r in file_texts(df).collect()} == {"f": "a\nb", "g": None, "h": "y", None: None}


def test_chunks(base):
    got = {}
    for r in C.chunk_texts(*base).collect():
        got.setdefault(r["rel_path"], []).append(r)
    store = sorted(got["app/store.py"], key=lambda r: r["chunk_index"])
    assert [(r["start_line"], r["end_line"], r["symbol_name"]) for r in store] == [(1, 3, None), (4, 4, "Store"), (5, 7, "load"), (8, 9, "save")]
    assert "\n".join(r["content"] for r in store) == FILES["app/store.py"].rstrip("\n")
    assert [(r["start_line"], r["end_line"]) for r in got["long/plain.txt"]] == [(1, 200)]
    assert [(r["start_line"], r["end_line"]) for r in got["long/body.py"]] == [(1, 60)]


def test_imports(base):
    found = C.extract_imports(base[0]).drop("at")
    plain = {(r["source_path"], r["imported_name"]): r["target_path"] for r in C.resolve_imports(found, base[0]).collect()}
    assert plain[("src/main.py", "app.store")] == "app/store.py" and plain[("src/main.py", "os")] is None and plain[("src/main.py", ".local")] is None
    assert plain[("app/store.py", "app.models.order")] == "app/models/order.py"
    assert plain[("web/index.ts", "./util")] == "web/util.ts" and plain[("svc/main.go", "fmt")] is None and plain[("svc/services/UserService.java", "java.util.List")] is None
    extra = base[0].select("project_id", F.lit("app/x.ts").alias("rel_path")).limit(1)
    both = base[0].select("project_id", "rel_path").unionByName(extra)
    assert {(r["imported_name"]): r["target_path"] for r in C.resolve_imports(found, both).where("source_path = 'web/index.ts'").collect()}["../app/x"] is None
    assert {(r["imported_name"]): r["target_path"] for r in C.resolve_imports(found, both, normalise=True).where("source_path = 'web/index.ts'").collect()}["../app/x"] == "app/x.ts"


def test_categories(base):
    got = {(r["rel_path"], r["symbol_name"], r["category"]) for r in C.categories(base[1]).collect()}
    assert {("app/models/order.py", "OrderModel", "dto"), ("svc/services/UserService.java", "UserService", "service"), ("tests/test_store.py", "test_load", "test"), ("config/settings.py", "configure", "config"), ("web/util.test.ts", "check", "test")} <= got
    routes = {(r["rel_path"], r["symbol_name"], r["detail"]) for r in C.route_categories(*base).collect()}
    assert ("api/routes.py", "list_orders", "line=2") in routes and all(p.split("/")[0] in ("api",) for p, *_ in routes)


def test_entry_points_and_frameworks(base):
    t = base[0]
    got = {r["rel_path"]: r["description"] for r in C.entry_points(t).collect()}
    assert got["src/main.py"] == "Python main entry point" and got["web/index.ts"] == "TypeScript entry point" and got["svc/main.go"] == "Go main entry point"
    assert rows(C.test_frameworks(t)) == {("p", "jest"), ("p", "pytest")}
    assert rows(N.framework_hints(t)) == {("p", "React"), ("p", "Flask"), ("p", "Pytest"), ("p", "Gin"), ("p", "Serde")}
    assert {(r["manager"], r["name"], r["development"]) for r in N.dependencies(t).collect()} == {
        ("pip", "flask", False), ("pip", "pytest", False), ("pip", "foo~", False), ("npm", "react", False), ("npm", "left", False), ("npm", "jest", True), ("go", "github.com/gin-gonic/gin", False), ("bundler", "rails", False), ("cargo", "serde", False),
    }
    only = t.where("rel_path = 'pyproject.toml'")
    assert {(r["manager"], r["name"]) for r in N.dependencies(only).collect()} == {("pip", "django"), ("pip", "x")}
    assert N.description(t.where("rel_path = 'README.md'")).first()["description"] == "A tool that keeps orders."


def test_architecture_and_infrastructure(base):
    got = {r["pattern"]: (r["score"], r["confidence"]) for r in A.architectures(base[0]).collect()}
    assert got["MVC (Model-View-Controller)"] == (3, "high") and got["Microservices / Multi-service"] == (4, "high")
    assert got["Layered Architecture"] == (2, "medium")
    found = {(r["category"], r["name"]) for r in A.infrastructure(base[0]).collect()}
    assert {("containerization", "Docker"), ("containerization", "Docker Compose"), ("ci_cd", "GitHub Actions"), ("build", "Make"), ("quality", "Python Project Config")} == found
    none = base[0].where("rel_path = 'README.md'")
    assert A.architectures(none).count() == 0


def test_totals(spark):
    files = spark.createDataFrame([("p", "a.py", ".py", 500), ("p", "b.py", ".py", 200)], "project_id string, rel_path string, ext string, size_bytes bigint")
    chunks = spark.createDataFrame([("p", "a.py", 10), ("p", "a.py", 30), ("p", "b.py", None)], "project_id string, rel_path string, end_line int")
    symbols = spark.createDataFrame([("p", "a.py", "x"), ("p", "a.py", "y"), ("p", "b.py", "z")], "project_id string, rel_path string, name string")
    m = A.file_measures(files, chunks, symbols)
    assert tuple(A.totals(m).first()) == ("p", 2, 30, 700, 3)
    assert [r["rel_path"] for r in A.top_files(m, "size_bytes").orderBy("rank").collect()] == ["a.py", "b.py"]
    tests = A.test_counts(spark.createDataFrame([("p", "tests/a.py"), ("p", "b.py"), ("q", "c.py")], "project_id string, rel_path string"))
    assert rows(tests) == {("p", 1, 1, "Strong"), ("q", 0, 1, "None detected")}
    edges = spark.createDataFrame([("p", "a", "t"), ("p", "b", "t"), ("p", "c", None)], "project_id string, source_path string, target_path string")
    assert rows(A.fan_in(edges)) == {("p", "t", 2, 1)}


def fold(parts, budget):
    used, out, stopped = 0, [], set()
    for f, _, p in sorted(parts):
        if f in stopped or used >= budget:
            continue
        if used + len(p) > budget:
            stopped.add(f)
            continue
        used += len(p)
        out.append(p)
    return used, out


def test_context_fold_against_plain_python(spark):
    rng = random.Random(9)
    for _ in range(5):
        chunks = [(f"f{f}", c, "x" * rng.randrange(1, 400)) for f in range(4) for c in range(rng.randrange(1, 6))]
        df = spark.createDataFrame(chunks, "rel_path string, chunk_index int, content string").withColumns({"start_line": F.lit(1), "end_line": F.lit(2), "symbol_name": F.lit(None).cast("string"), "g": F.lit(1)})
        top = spark.createDataFrame([(f"f{f}", f) for f in range(4)], "rel_path string, file_rank int")
        row = R.packed_context(top, df, ["g"], budget=900).first()
        parts = [(int(p[1:]), c, f"=== {p} [lines 1-2] ===\n{t}") for p, c, t in chunks]
        used, out = fold(parts, 900)
        assert (row["used"], row["parts"], row["context"]) == (used, len(out), "\n\n".join(out))


def test_search_is_literal(spark):
    docs = spark.createDataFrame([("a", "x.*y\nX.*Y \nxzy"), ("b", None), ("c", "(")], "k string, text string")
    assert [tuple(r) for r in R.search_lines(docs, ["k"], "x.*Y").collect()] == [("a", 1, "x.*y"), ("a", 2, "X.*Y")]
    assert R.search_lines(docs, ["k"], "(").count() == 1


def test_hybrid(spark, base):
    got = [r["rel_path"] for r in R.relevant_files(base[0], base[1], "Where does Store load orders").collect()]
    assert got[0] == "app/store.py"
    scores = {r["rel_path"]: r["score"] for r in R.symbol_scores(base[1], "STORE main").collect()}
    assert scores == {"app/store.py": 5.0, "src/main.py": 5.0, "svc/main.go": 5.0}


def test_maintenance(spark):
    old = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0), ("c", None, 1.0)], "p string, s int, m double")
    new = spark.createDataFrame([("a", 1, 1.0), ("c", None, 2.0), ("d", 1, 0.5)], "p string, s int, m double")
    assert rows(M.snapshot_diff(old, new, ["p"], ["s", "m"])) == {("b", "deleted"), ("c", "changed"), ("d", "added")}
    assert rows(M.deleted(old, new, ["p"])) == {("b",)}
    assert rows(M.purge(old, new, ["p"]).select("p")) == {("b",)}
    log = spark.createDataFrame([("s", k, f"q{k}", f"a{k}") for k in range(10)], "session_id string, turn_index bigint, question string, answer string")
    assert [r["turn_index"] for r in M.tail(log, "session_id", 3).orderBy("turn_index").collect()] == [7, 8, 9]
    assert M.next_turn(log, "session_id").first()["next_turn"] == 10
    assert M.history_block(log, "session_id", 2).first()["block"] == "Q: q8\nA: a8\n\nQ: q9\nA: a9"
    chosen = spark.createDataFrame([("c", 0)], "p string, o int")
    all_ = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "p string, o int")
    assert [r["p"] for r in M.complete_ranking(chosen, all_, "p", "o").orderBy("position").collect()] == ["c", "a", "b"]
    up = M.upsert(spark.createDataFrame([("a", 1, "x")], "k string, o int, v string"), spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string"), ["k"], "o")
    assert rows(up) == {("a", 2, "y"), ("b", 1, "z")}


def test_insights(spark):
    cols = "project_id string, total_files bigint, total_lines bigint, pattern string, frameworks array<string>, test_files bigint, test_label string, ci_cd array<string>, containers array<string>, entries array<string>, most_symbols bigint"
    small = ("s", 5, 50, None, [], 0, "None detected", [], [], [], 1)
    large = ("l", 250, 100_000, "MVC", ["React"], 3, "Low", ["Jenkins"], ["Docker"], ["a", "b", "c", "d"], 30)
    got = {}
    for r in A.insights(spark.createDataFrame([small, large], cols)).collect():
        got.setdefault(r["project_id"], []).append(r["insight"])
    assert got["s"] == ["Small project with 5 files", "No test files detected", "Clean file sizes averaging 10 lines per file"]
    assert got["l"][0] == "Large codebase: 250 files" and "Entry points: a, b, c" in got["l"] and "Average file length is 400 lines" in got["l"] and len(got["l"]) == 9
    assert fixed.SCHEMA_VERSION == 7
