import random

import pytest
from codelode.llm.handwritten import copies_of, not_handwritten, shingles, why

CODE = "import a\n\ndef f(x):\n    y = compute(x, 3)\n    return [z for z in y if z > 4]\n\n\nclass C:\n    def m(self):\n        log.info('some text here')\n        return self.v\n"
MIN = '!function(){"use strict";' + "".join(f"function a{k}(b,c){{return b?c:d{k}(b,'e')}}var f{k}=g[{k}]||{{h:{k}}};" for k in range(30)) + "}()"


@pytest.mark.parametrize(
    ("path", "text", "reason"),
    [
        ("a/b.py", "# Code generated by x-tool. DO NOT EDIT.\n" + CODE, "generated"),
        ("a/b.py", "# SPDX-License-Identifier: X\n# <auto-generated>\n#   tool 3.1\n# </auto-generated>\n" + CODE, "generated"),
        ("a/b.py", "# Writes the DO NOT EDIT banner into output files.\n" + CODE, ""),
        ("a/b.py", "# Builds generated clients; edit freely.\n" + CODE, ""),
        ("a/b.py", "# Writes generated stubs; maintained by hand.\n" + CODE, ""),
        ("a/b.py", CODE + "# Code generated by x-tool. DO NOT EDIT.\n", ""),
        ("vendor/x/b.py", CODE, "third_party"),
        ("src/vendored_list.py", CODE, ""),
        ("a/b.js", "/* @license x 1.2.3\n * Copyright (c) the x contributors\n */\nfunction f() {}\n", "third_party"),
        ("lib/package-lock.json", "{}", "lock_file"),
        ("a/q.json", '{\n  "lockfileVersion": 2,\n  "packages": {}\n}', "lock_file"),
        ("a/q.json", '{"version":3,"sources":["a.ts"],"names":[],"mappings":"AAAA"}', "source_map"),
        ("a/x.min.js", None, "minified"),
        ("a/x.js", MIN, "minified"),
        ("lib/minify/x.py", CODE, ""),
        ("a/t.py", "X = [\n" + "    1, 2, 3, 4, 5, -6.5, 0x7f,\n" * 40 + "]\n", "data"),
        ("a/t.py", CODE * 6 + "X = [\n    1, 2, 3, 4,\n]\n", ""),
        ("a/p.py", "import q\n\n\n" + "\n\n\n".join(f"def get_a_{k}(msg):\n    return msg._fields[{k}].decode({k * 7}, 'n{k}')" for k in range(8)) + "\n", "generated"),
        ("a/p.py", "_LR_ACTION = [\n    1, 2,\n]\n" + CODE, "generated"),
        ("a/b_pb2.py", CODE, "generated"),
        ("a/b.py", None, ""),
        ("a/b.py", "", ""),
        ("", "x", ""),
    ],
)
def test_reasons(path, text, reason):
    assert why(path, text) == reason


def test_similarity_join_is_exact(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(10)]
    texts = []
    for b in base:
        for edits in (0, 2, 5, 9, 30):
            t = list(b)
            for _ in range(edits):
                t[rng.randrange(len(t))] = "new" + str(rng.randrange(99))
            texts.append(" ".join(["licence terms apply to all of these files now and then"] + t))
    rows = [(bytes([k]), shingles(t).tolist()) for k, t in enumerate(texts)]
    known, others = rows[::7], [r for k, r in enumerate(rows) if k % 7]
    frame = lambda r: spark.createDataFrame(r + r[:3], "digest binary, shingles array<bigint>")
    want = {bytes(d) for d, s in others for _, t in known if len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.8}
    got = {bytes(r["digest"]) for r in copies_of(frame(known), frame(others)).collect()}
    assert got == want and want


def test_operator(spark):
    lib = "\n".join(f"def helper_{k}(value, other):\n    result = transform_{k}(value) + {k}\n    return combine(result, other)" for k in range(0, 60, 2))
    patched = lib.replace("helper_30(", "helper_x(", 1)
    rows = [
        (1, "p", "vendor/l/a.py", 0, lib), (2, "q", "src/copy.py", 0, patched[:800]), (3, "q", "src/copy.py", 1, patched[801:]), (3, "q", "src/copy.py", 1, patched[801:]), (4, "q", "src/own.py", 0, CODE),
        (5, "q", "src/ghost.py", 0, lib), (6, "q", "src/null.py", 0, None), (7, None, None, None, None), (8, "r", "src/same.py", 0, lib), (9, "r", "big.py", 0, CODE * 2000),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id bigint, project_id string, rel_path string, chunk_index int, content string").selectExpr("*", "timestamp'2024-01-01 00:00:00' as ingested_at", "'x' as digest", "'y' as reason", "'z' as text", "1 as n")
    names = [(p, r) for _, p, r, *_ in rows if r != "src/ghost.py"] + [("s", "x/yarn.lock"), ("s", "x/plain.py"), ("q", "src/copy.py"), (None, None)]
    files = spark.createDataFrame(names, "project_id string, rel_path string").selectExpr("*", "'e' as extension", "1 as size_bytes", "'d' as digest")
    got = {tuple(r) for r in not_handwritten(files, chunks).collect()}
    assert got == {("p", "vendor/l/a.py", "third_party"), ("q", "src/copy.py", "copy"), ("r", "src/same.py", "copy"), ("s", "x/yarn.lock", "lock_file")}
    assert not_handwritten(files.limit(0), chunks).count() == 0
    assert {tuple(r) for r in not_handwritten(files, chunks.limit(0)).collect()} == {("p", "vendor/l/a.py", "third_party"), ("s", "x/yarn.lock", "lock_file")}


def test_many_forms_and_many_copies_need_few_comparisons(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    base = [rng.choice(words) for _ in range(200)]

    def form(n):
        t = list(base)
        t[rng.randrange(200)] = f"patched{n}"
        return shingles(" ".join(t)).tolist()

    far = lambda: shingles(" ".join(base[:100] + [rng.choice(words) for _ in range(100)])).tolist()
    schema = "digest binary, shingles array<bigint>"
    known = [(bytes([1, k]), form(k)) for k in range(12)] + [(bytes([4, k]), far()) for k in range(12)]
    others = [(bytes([2, k]), form(100 + k)) for k in range(12)] + [(bytes([3, k]), far()) for k in range(5)]
    want = {d for d, s in others for _, t in known if len(set(s) & set(t)) / len(set(s) | set(t)) >= 0.8}
    assert {bytes(r["digest"]) for r in copies_of(spark.createDataFrame(known, schema), spark.createDataFrame(others, schema)).collect()} == want and len(want) >= 12
