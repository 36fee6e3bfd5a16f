import json

import pytest
from codelode.llm.handwritten import why

SOURCES = {"sources": [f"src/part_{k}.ts" for k in range(400)], "sourcesContent": ['export const a = "}";\n' * 300], "names": []}


@pytest.mark.parametrize(
    ("value", "reason"),
    [
        ({"version": 3} | SOURCES | {"mappings": "AAAA;AACA"}, "source_map"),
        ({"file": "a.js"} | SOURCES | {"mappings": "AAAA", "version": 3}, "source_map"),
        ({"version": 3, "sections": [{"offset": {"line": 0, "column": 0}, "map": {"version": 3} | SOURCES | {"mappings": "AAAA"}}]}, "source_map"),
        ({"version": 3, "index": {"mappings": {"title": "text"}}}, ""),
        ({"version": 3, "mappings": {"title": "text"}}, ""),
    ],
)
def test_maps_of_any_size(value, reason):
    assert why("a/q.json", json.dumps(value)) == reason
    assert why("a/q.json", json.dumps(value, indent=2)) == reason
