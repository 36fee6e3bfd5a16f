import random

import numpy as np
import pytest
from codelode.llm import spans
from codelode.llm.spans import FingerprintIndex, chunk_classes, class_pairs, fingerprints, shared_share, shared_windows, sharing_chunks, sliding_min, text_prints

T = "timestamp'2024-01-0{} 00:00:00'"


def noise(rng, n, alphabet="abcdefghijklmnop \n"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_sliding_min():
    rng = np.random.default_rng(1)
    for n, w in ((1, 1), (10, 3), (100, 7), (64, 64)):
        a = rng.integers(0, 1000, n).astype(np.uint64)
        assert sliding_min(a, w).tolist() == [a[i : i + w].min() for i in range(n - w + 1)]


def test_texts_that_share_a_span_share_a_fingerprint():
    rng = random.Random(5)
    for _ in range(40):
        span = noise(rng, 300, "ab é漢😀")
        a, b = noise(rng, rng.randrange(200)) + span + noise(rng, rng.randrange(200)), noise(rng, rng.randrange(200)) + span
        of, prints = fingerprints([a, "short", b])
        assert set(prints[of == 0]) & set(prints[of == 2]) and 1 not in of


def test_stretches():
    rng = random.Random(6)
    span = noise(rng, 400)
    a, b = "x" * 10 + span + "y", "z" * 50 + span
    assert shared_windows(a, b) == ([[10, 410]], [[50, 450]])
    assert shared_windows(span[:299], span) == ([], []) and shared_windows(span[:350] + "!" + span[350:], span[:200] + "?" + span[200:]) == ([], [])


def brute(rows, span=300):
    grams = {}
    for key, text in rows:
        for i in range(len(text or "") - span + 1):
            grams.setdefault(text[i : i + span], set()).add(key)
    return {(a, b) for ks in grams.values() for a in ks for b in ks if a < b}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    shared = [noise(rng, 330) for _ in range(6)]
    out = [(k, noise(rng, rng.randrange(400)) + rng.choice(shared) + noise(rng, rng.randrange(400))) for k in range(20)]
    out += [(100 + k, out[k][1]) for k in range(3)] + [(200, "q" * 5000), (201, "q" * 299), (202, "q" * 300), (203, None), (204, ""), (205, shared[0][:299])]
    return out


def frame(spark, rows):
    df = spark.createDataFrame([(k, t, k % 3) for k, t in rows], "chunk_id bigint, content string, d int")
    return df.selectExpr("chunk_id", "content", "case when d = 0 then null else timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, d) end as ingested_at", "'x' as text", "1 as print", "2 as batch", "3 as first", "4 as a")


def test_pairs_against_brute_force(spark, rows):
    df = frame(spark, rows + rows[:5])  # repeated rows
    assert {tuple(r) for r in sharing_chunks(df).collect()} == brute(rows)


def test_share_of_each_chunk(spark, rows):
    got = {r["chunk_id"]: r for r in shared_share(frame(spark, rows + rows[:2])).collect()}
    assert len(got) == len(rows)
    texts = dict(rows)
    for key, r in got.items():
        text, mask = texts[key] or "", set()
        others = {t[i : i + 300] for k, t in rows if k != key and t for i in range(len(t) - 299)}
        for i in range(len(text) - 299):
            if text[i : i + 300] in others:
                mask.update(range(i, i + 300))
        assert r["chars"] == len(text) and r["shared_chars"] == len(mask), key


def test_150_equal_chunks_give_all_pairs(spark):
    text = noise(random.Random(8), 400)
    rows = [(k, text) for k in range(150)] + [(200 + k, text + "!") for k in range(3)]
    df = frame(spark, rows)
    assert {tuple(r) for r in sharing_chunks(df).collect()} == brute(rows) and len(brute(rows)) == 153 * 152 // 2
    got = {tuple(r) for r in chunk_classes(df).collect()}
    assert got == {(k, 0, 150, 1) for k in range(150)} | {(k, 200, 3, 1) for k in range(200, 203)}
    assert [tuple(r) for r in class_pairs(df).collect()] == [(0, 200)]


def test_blocks_leave_no_pair_out(spark, monkeypatch):
    from codelode.llm import common

    monkeypatch.setattr(common, "BLOCK", 7)
    text = noise(random.Random(9), 350)
    rows = [(k, text) for k in range(40)] + [(100 + k, "?" + text) for k in range(25)]
    assert {tuple(r) for r in sharing_chunks(frame(spark, rows)).collect()} == brute(rows)


def test_a_print_of_many_texts_is_grouped_by_windows(spark, monkeypatch):
    monkeypatch.setattr(spans, "HOT", 5)
    rng = random.Random(10)
    header, cut = noise(rng, 310), noise(rng, 200)
    rows = [(k, header + noise(rng, rng.randrange(100, 300))) for k in range(20)] + [(30 + k, noise(rng, 50) + cut + noise(rng, 200)) for k in range(20)] + [(60, noise(rng, 20) + header + cut)]
    df = frame(spark, rows)
    assert {tuple(r) for r in sharing_chunks(df).collect()} == brute(rows)
    texts = dict(rows)
    for r in shared_share(df).collect():
        others, text, mask = {t[i : i + 300] for k, t in rows if k != r["chunk_id"] for i in range(len(t) - 299)}, texts[r["chunk_id"]], set()
        for i in range(len(text) - 299):
            if text[i : i + 300] in others:
                mask.update(range(i, i + 300))
        assert r["shared_chars"] == len(mask)


def prints_of(spark, rows):
    df = frame(spark, rows)
    return text_prints(spans._prepared(df).selectExpr("text", "content", "0 as batch"))


def test_an_index_goes_on_where_it_was_left(spark, rows, tmp_path):
    path, texts = f"file://{tmp_path}/index", [r for r in rows if r[1]]
    pairs = set()
    for part in (texts[:8], texts[8:15], texts[15:18], texts[18:]):
        met, _ = FingerprintIndex(spark, path, fan=3).append(prints_of(spark, part))  # opened anew for each batch
        pairs |= {(bytes(r["a"]), bytes(r["b"])) for r in met.collect()}
    whole, _ = FingerprintIndex(spark).append(prints_of(spark, texts))
    assert pairs == {(bytes(r["a"]), bytes(r["b"])) for r in whole.collect()}
    index = FingerprintIndex(spark, path)
    assert index.version == 4 and [level for level, _ in index.runs] == [1, 0]
    index.vacuum()
    assert index.table(index.runs[0][1]).count() > 0


def test_history_is_not_shuffled(spark, rows):
    index = FingerprintIndex(spark, fan=9)
    for part in (rows[:10], rows[10:20]):
        index.append(prints_of(spark, part))
    (_, old), (_, new) = index.runs
    assert "Exchange" not in index.met(new, old)._jdf.queryExecution().executedPlan().toString()


def test_empty(spark, rows):
    none = frame(spark, rows).limit(0)
    assert sharing_chunks(none).count() == 0 and shared_share(none).count() == 0
