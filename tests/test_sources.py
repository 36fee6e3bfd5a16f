import os

import pytest
from codelode.operators.catalog import latest, resolve, without
from codelode.sources.store import Store, decoded_value, legacy_rows
from codelode.sources.tree import decoded, inside, list_tree, read_texts
from codelode.streaming.watch import Watchers, _Changes
from fixture_code import FILES, write


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "project"
    root.mkdir()
    write(root)
    return root


def test_scan(spark, tree):
    got = {r["rel_path"]: r for r in list_tree(spark, str(tree)).collect()}
    want = {k for k, v in FILES.items() if v} | {"docker-compose.yml", ".github/workflows/ci.yml", "requirements.txt", "package.json", "Cargo.toml", "pyproject.toml", "bin.py", ".env.example"}
    assert set(got) == want
    assert got["app/store.py"]["extension"] == ".py" and got["app/store.py"]["size_bytes"] == len(FILES["app/store.py"])
    texts = {r["rel_path"]: r for r in read_texts(list_tree(spark, str(tree))).collect()}
    assert texts["bin.py"]["error"] == "binary_file" and texts["bin.py"]["content"] == "" and texts["app/store.py"]["content"] == FILES["app/store.py"]
    every = {r["rel_path"] for r in list_tree(spark, str(tree), every=True).collect()}
    assert {"Dockerfile", "Makefile", "Gemfile", "go.mod"} <= every
    with pytest.raises(Exception, match="no such folder"):
        list_tree(spark, str(tree / "none")).collect()


def test_decoding():
    assert decoded(b"abc") == ("abc", False, None) and decoded(b"a" * 60_000)[:2] == ("a" * 50_000, True)
    assert decoded(b"a\xffb")[0] == "ab" and decoded(b"x" * 9000 + b"\0")[2] is None and decoded((chr(0xFFFD) * 5 + "abc").encode())[2] == "binary_file"


def test_paths(tmp_path):
    (tmp_path / "a").mkdir()
    assert inside(str(tmp_path / "a"), str(tmp_path)) and not inside("/etc", str(tmp_path)) and not inside(str(tmp_path) + "x", str(tmp_path))


def folders(tmp_path, table="keyword_files", project="p_1"):
    return [d for d in os.listdir(tmp_path / f"store/{table}/project_id={project}") if d.startswith("v-")]


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", grace=0)
    rows = spark.createDataFrame([("k", "a.py"), ("k2", "b.py")], "keyword string, rel_path string")
    s.write("keyword_files", "p_1", rows)
    s.write("keyword_files", "p_2", rows.limit(1))
    assert s.get("keyword_files", "p_1").count() == 2 and s.get("keyword_files", "p_2").count() == 1 and s.read("keyword_files", "p_3") is None
    s.write("keyword_files", "p_1", s.get("keyword_files", "p_1").limit(1))  # a table may be made from its version before
    assert s.get("keyword_files", "p_1").count() == 1
    s.append("keyword_files", "p_1", rows)
    assert s.get("keyword_files", "p_1").count() == 3
    assert len(folders(tmp_path)) == 2  # the version before is gone once the time of grace is over
    assert s.delete("p_1") and not s.delete("p_1") and s.get("keyword_files", "p_1").count() == 0
    assert s.projects().count() == 0


def test_a_reader_keeps_its_version(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("k", "a.py"), ("k2", "b.py")], "keyword string, rel_path string")
    s.write("keyword_files", "p_1", rows)
    before = s.get("keyword_files", "p_1")  # a plan, not run yet
    for n in (1, 0):
        s.write("keyword_files", "p_1", rows.limit(n))
    assert before.count() == 2 and s.get("keyword_files", "p_1").count() == 0


def test_a_crash_between_steps_leaves_the_version_before(spark, tmp_path, monkeypatch):
    s = Store(spark, f"file://{tmp_path}/store", grace=0)
    rows = spark.createDataFrame([("k", "a.py")], "keyword string, rel_path string")
    other = spark.createDataFrame([("q", "said")], "key string, value string")
    s.publish("p_1", {"keyword_files": rows, "semantic_summary": other})

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # staged, not published
        m.setattr(Store, "_commit", crash)
        with pytest.raises(RuntimeError):
            s.publish("p_1", {"keyword_files": rows.limit(0), "semantic_summary": other.limit(0)})
    assert s.get("keyword_files", "p_1").count() == 1 and s.get("semantic_summary", "p_1").count() == 1
    (tmp_path / "store/manifests/project_id=p_1/000000000002.json").write_text('{"keyword_fi')  # half written
    assert s.get("keyword_files", "p_1").count() == 1
    s.write("keyword_files", "p_1", rows.union(rows))
    assert s.get("keyword_files", "p_1").count() == 2 and s.get("semantic_summary", "p_1").count() == 1


def test_two_writers_lose_nothing(spark, tmp_path):
    a, b = (Store(spark, f"file://{tmp_path}/store") for _ in range(2))
    rows = spark.createDataFrame([("k", "a.py")], "keyword string, rel_path string")
    said = spark.createDataFrame([("q", "said")], "key string, value string")
    once, numbers = [], Store._numbers

    def raced(self, project):
        found = numbers(self, project)
        if self is a and not once:
            once.append(1)
            b.write("semantic_summary", project, said)  # between a's look at the numbers and its own manifest
        return found

    Store._numbers = raced
    try:
        a.append("keyword_files", "p_1", rows)
    finally:
        Store._numbers = numbers
    assert a.get("keyword_files", "p_1").count() == 1 and a.get("semantic_summary", "p_1").count() == 1


def test_growing_tables_are_folded(spark, tmp_path, monkeypatch):
    from codelode.sources import store

    monkeypatch.setattr(store, "FOLD", 3)
    s = Store(spark, f"file://{tmp_path}/store", grace=0)
    for k in range(7):
        s.append("semantic_summary", "p_1", spark.createDataFrame([(str(k), "v")], "key string, value string"))
    assert s.get("semantic_summary", "p_1").count() == 7 and len(s.tables("p_1")["semantic_summary"]) <= 3


def test_values_and_legacy(spark, tmp_path):
    assert decoded_value('{"a": 1}') == {"a": 1} and decoded_value("plain") == "plain" and decoded_value(None) is None
    at = tmp_path / "old.json"
    at.write_text('{"file_index": {"a.py": {"symbols": ["x"], "keywords": ["k"], "size_bytes": 3}}}')
    assert [tuple(r) for r in legacy_rows(spark, str(at)).collect()] == [("a.py", ["x"], ["k"], 3)]


def test_catalogue(spark):
    p = spark.createDataFrame([("a_1", "a", "/x/a", 1.0), ("b_2", "b", "/x/b", 2.0), ("c_3", "a_1", "/x/c", None)], "project_id string, slug string, project_root string, indexed_at double")
    assert resolve(p, "a").first()["project_id"] == "a_1" and resolve(p, "/x/b").first()["project_id"] == "b_2" and resolve(p, "a_1").first()["project_id"] == "c_3" and resolve(p, "zz").first() is None
    assert latest(p).first()["project_id"] == "b_2" and without(p, "b").count() == 2 and without(p, "zz").count() == 3


def test_changes_as_a_stream(spark, tree, tmp_path):
    seen = []
    w = Watchers(spark, str(tmp_path / "state"))

    def once():
        seen.clear()
        w.start(str(tree), lambda b: seen.extend((r["op"], r["rel_path"]) for r in b.collect()), once=True).awaitTermination(60)

    once()
    assert ("upsert", "app/store.py") in seen and all(op == "upsert" for op, _ in seen)
    (tree / "app/store.py").write_text("def changed(): pass\n")
    (tree / "views/b.py").unlink()
    (tree / "new.py").write_text("x = 1\n")
    once()
    assert set(seen) == {("upsert", "app/store.py"), ("delete", "views/b.py"), ("upsert", "new.py")}
    (snapshots,) = (tmp_path / "state").glob("*/snapshots")
    reader = _Changes(str(tree), str(snapshots))
    again = [list(reader.readBetweenOffsets({"version": 1}, {"version": 2})) for _ in range(2)]
    assert again[0] == again[1] and {(op, p) for p, op, _ in again[0]} == set(seen)  # a batch asked for again is the same
    once()
    assert seen == [] and w.active() == [] and w.stop(str(tree)) and not w.stop(str(tree))
