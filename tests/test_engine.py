import json
import os

import pytest
from codelode.engine import Engine
from codelode.plugins import HashingEmbedder, StreamEvent, ask_where, json_from_text, rerank, streamed, with_retry
from fixture_code import FILES, write


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("work") / "My Shop"
    root.mkdir()
    write(root)
    engine = Engine(spark, f"file://{tmp_path_factory.mktemp('store')}", embedder=HashingEmbedder(64))
    return engine, root, engine.index_project(str(root))


def test_index(indexed):
    engine, root, result = indexed
    assert result["project_id"].startswith("my-shop_") and result["files"] >= 15 and result["symbols"] > 15 and result["chunks"] > 20
    assert engine.resolve() == engine.resolve("my-shop") == engine.resolve(str(root)) == result["project_id"] and engine.resolve("other") is None
    assert engine.list_projects().count() == 1 and engine.enrichment_status() == "complete"
    paths = [r["rel_path"] for r in engine.list_project_files().collect()]
    assert paths == sorted(paths) and "app/store.py" in paths and "bin.py" not in paths
    got = engine.get_file_content("app/store.py")
    assert got["content"] == FILES["app/store.py"] and got["line_count"] == FILES["app/store.py"].count("\n") + 1 and "Store" in got["symbols"] and got["extension"] == ".py" and got["chunks_count"] > 0 and got["keywords"]
    assert engine.get_file_content("none")["available_files"] == paths[:20]
    with pytest.raises(LookupError):
        engine.list_project_files("unknown")


def test_search_and_ranking(indexed):
    engine = indexed[0]
    hits = engine.search_code("CLASS store")
    assert hits["matches"] == [{"rel_path": "app/store.py", "line": 4, "content": "class Store:"}] and not hits["truncated"]
    found = engine.find_relevant_files("how does Store save a key")
    assert found["files"][0] == "app/store.py" and found["confidence"] == "high" and found["symbol_hits"][0]["name"] in ("Store", "save")
    context = engine.retrieve_context("how does Store save a key")["context"]
    assert "=== app/store.py [lines" in context and "[Symbol `Store` defined in app/store.py" in context and len(context) < 26_000
    text = engine.read_files(["app/store.py", "long/plain.txt", "app/store.py", "none"], budget=600)
    assert text.count("=== FILE: app/store.py") == 1 and "... (truncated)" in text and "   4 | class Store:" in text


def test_reports(indexed):
    engine = indexed[0]
    r = engine.project_report()
    assert r["description"] == "A tool that keeps orders." and "React" in r["frameworks"] and r["architecture"][0]["pattern"].startswith(("MVC", "Micro"))
    assert {x["name"] for x in r["infrastructure"]} >= {"Docker", "GitHub Actions"} and r["tests"]["test_files"] == 2 and r["tests"]["frameworks"] == ["jest", "pytest"]
    assert any(d["name"] == "flask" for d in r["external_dependencies"]) and r["entry_points"][0]["rel_path"].endswith("main.py") and len(r["insights"]) >= 5
    assert r["top_connected_files"][0]["target_path"] in ("app/store.py", "web/util.ts", "app/models/order.py")
    assert engine.query_categories("test")["rows"].count() >= 2 and engine.query_categories()["categories"]["test"]["files"] >= 1 and engine.query_imports("src/main.py")["internal"] == 1
    assert engine.project_overview()["modules"] and engine.project_overview()["summary"]["purpose"]
    assert {"category": "ci_cd_detail", "name": "1 workflow(s)"} in r["infrastructure"]
    top = {x["target_path"]: x["symbols"] for x in r["top_connected_files"]}
    assert top["app/store.py"][0] == "Store" and all(len(v) <= 8 for v in top.values())


def test_questions_and_sessions(indexed):
    engine = indexed[0]
    a = engine.answer("where is the store loaded", session="s1")
    assert "app/store.py" in a["relevant_files"] and a["context_chars"] > 0
    engine.answer("how many routes are there", session="s1")
    assert [t["turn_index"] for t in engine.session_history("s1")] == [0, 1] and engine.session_history("s2") == []
    assert not engine.navigate("give me an overview").needs_code
    assert engine.folder_files(["APP"], engine.resolve()) == ["app/store.py", "app/models/order.py"]


def test_searches_read_the_stored_index(indexed):
    engine = indexed[0]
    scores, *_ = engine._scores("how does Store save a key", engine.resolve())
    plan = scores._jdf.queryExecution().optimizedPlan().toString() + scores._jdf.queryExecution().executedPlan().toString()
    assert "/texts/" not in plan and "text#" not in plan and "keyword_files" in plan and "PushedFilters: [In(keyword" in plan


class Scripted:
    """A model that answers by what it is asked for."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def complete(self, system, user, schema=None, max_tokens=2048):
        self.asked.append(user)
        if schema and "target_files" in schema:
            return json.dumps({"needs_code": True, "target_files": ["app/store.py"], "target_folders": []})
        if schema and "order" in schema:
            return json.dumps({"order": [1, 0]})
        return self.answers.pop(0)

    def stream(self, system, user):
        yield from ('{"answer": "It saves', ' [1]", "citations": [{"file": "app/store.py", "start_line": 4}]}')


def test_answers_with_citations(indexed):
    engine = indexed[0]
    first = {"answer": "more", "citations": [], "needs_more_context": True, "additional_files": ["src/main.py"]}
    second = {"answer": "It saves [1]", "citations": [{"file": "app/store.py", "start_line": 4, "end_line": 9, "symbol": "Store"}, {"file": "x"}], "relevant_files": ["src/main.py"], "confidence": "high", "follow_up": ["How?"]}
    model, engine.model = engine.model, Scripted(json.dumps(first), json.dumps(second))
    try:
        a = engine.answer("how does the store save")
        assert a["answer"] == "It saves [1]" and a["confidence"] == "high" and a["follow_up"] == ["How?"] and a["relevant_files"] == ["app/store.py", "src/main.py"]
        assert a["citations"] == [{"file": "app/store.py", "start_line": 4, "end_line": 9, "symbol": "Store", "snippet": ""}]
        assert "=== FILE: src/main.py" in engine.model.asked[-1]
        events = list(engine.stream_answer("how does the store save", session="streamed"))
        assert [e.type for e in events] == ["chunk", "chunk", "done"] and events[-1].content == "It saves [1]" and events[-1].metadata["chunks"] == 2
        assert events[-1].metadata["citations"][0]["end_line"] is None and engine.session_history("streamed")[0]["answer"] == "It saves [1]"
        plain = engine.retrieve_context("how does Store save a key")["context"]
        ordered = engine.retrieve_reranked("how does Store save a key")["context"]
        assert ordered.split("\n")[0] != plain.split("\n")[0] and len(ordered) < 26_000 and "[Symbol `Store` defined in" in ordered
    finally:
        engine.model = model
    whole = list(engine.stream_answer("where is the store loaded"))
    assert [e.type for e in whole] == ["chunk", "done"] and whole[-1].metadata["confidence"] in ("high", "medium", "low")


def test_summaries_have_their_parts(spark, indexed, tmp_path):
    _, root, _ = indexed

    class Summing:
        def complete(self, system, user, schema=None, max_tokens=2048):
            if "Module " in user[:7]:
                return json.dumps({"purpose": "keeps orders", "key_patterns": ["repository"], "domain_concepts": ["order"], "key_abstractions": ["Store"]})
            assert "Module dependencies:" in user and "Total files:" in user and "README:" in user
            return json.dumps({"purpose": "a shop", "architecture": "layers", "key_patterns": ["repository"]})

    engine = Engine(spark, f"file://{tmp_path}/store", model=Summing())
    engine.index_project(str(root), background=True)
    engine.enriching.join(120)
    over = engine.project_overview()
    assert engine.enrichment_status() == "complete" and over["summary"]["architecture"] == "layers" and json.loads(over["summary"]["key_patterns"]) == ["repository"]
    assert over["modules"][0]["key_abstractions"] == ["Store"] and "=== MODULES ===" in engine.summary_context()


def test_update_and_delete(spark, indexed, tmp_path):
    _, root, _ = indexed
    engine = Engine(spark, f"file://{tmp_path}/store", embedder=HashingEmbedder(16))
    engine.index_project(str(root))
    assert engine.update_index(str(root)) == {"updated": [], "deleted": []}
    extra, old = root / "app/extra.py", os.stat(root / "app/store.py")
    extra.write_text("import app.store\n\ndef added(): pass\n")
    os.utime(extra, (1, 1))  # an old time stamp doesn't hide a new file
    (root / "views/b.py").unlink()
    try:
        assert engine.update_index(str(root)) == {"updated": ["app/extra.py"], "deleted": ["views/b.py"]}
        assert engine.search_code("def added")["matches"] and not engine.search_code("def show")["matches"]
        assert engine.query_imports("app/extra.py")["internal"] == 1
        assert engine.store.get("embeddings", engine.resolve()).where("rel_path = 'app/store.py'").count() > 0
    finally:
        extra.unlink()
        (root / "views/b.py").write_text(FILES["views/b.py"])
    engine.watch(str(root), once=True).awaitTermination(120)
    assert engine.search_code("def show")["matches"] and not engine.search_code("def added")["matches"]
    assert engine.delete_project("my-shop") and not engine.delete_project("my-shop") and root.exists() and old.st_size


def test_json_from_text():
    assert json_from_text('{"a": 1}') == {"a": 1} and json_from_text('x\n```json\n{"a": 2}\n```') == {"a": 2} and json_from_text('so {"a": {"b": 3}} it is') == {"a": {"b": 3}}
    assert json_from_text("nothing") is None and json_from_text("") is None and json_from_text('{"a": ') is None


def test_retry_stream_and_rerank():
    waits, calls = [], []

    def busy():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("429 too many")
        return "ok"

    assert with_retry(busy, sleep=waits.append) == "ok" and waits == [5.0, 10.0]
    with pytest.raises(ValueError):
        with_retry(lambda: (_ for _ in ()).throw(ValueError("other")))
    events = list(streamed(["a", "b"]))
    assert [e.type for e in events] == ["chunk", "chunk", "done"] and events[-1].content == "ab" and isinstance(events[0], StreamEvent)

    def failing():
        yield "a"
        raise RuntimeError("gone")

    assert [e.type for e in streamed(failing())] == ["chunk", "error"]

    class Fixed:
        def __init__(self, said):
            self.said = said

        def complete(self, *_, **__):
            return self.said

    assert rerank(Fixed('{"order": [2, 9, 0, 2]}'), "q", [{}, {}, {}]) == [2, 0, 1] and rerank(Fixed("no"), "q", [{}, {}]) == [0, 1]
    n = ask_where(Fixed('{"needs_code": true, "target_files": ["a","b","c","d","e","f","g","h","i"]}'), "q", "m")
    assert len(n.target_files) == 8 and ask_where(Fixed("no"), "q", "m") is None
