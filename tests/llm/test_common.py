import pytest
from codelode.llm import common
from pyspark.sql import functions as F


def test_prefilter_keeps_all_wanted_and_drops_most(spark):
    rows = spark.range(20_000).select(F.col("id").alias("k"), F.md5(F.col("id").cast("string")).alias("v"), F.lit(1).alias("_p"))
    wanted = spark.range(0, 20_000, 200).select(F.md5(F.col("id").cast("string")).alias("w"))
    kept = {r["k"] for r in common.possibly_in(rows.drop("_p"), "v", wanted, "w").collect()}
    assert set(range(0, 20_000, 200)) <= kept and len(kept) < 150
    assert common.possibly_in(rows.drop("_p"), "v", wanted.limit(0), "w").count() == 0


def test_stored_rows_outlive_their_plan(spark):
    df = common.stored(spark.range(5), "five")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


@pytest.mark.parametrize(("path", "want"), [("a/b.py", ".py"), ("a/.env", ""), ("a.b/c", ""), ("X.PY", ".py"), ("a/b.min.js", ".js")])
def test_suffix(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(common.suffix(F.col("p"))).first()[0] == want


def test_nothing_outside_imports_this_subpackage():
    import re
    from pathlib import Path

    root = Path(common.__file__).resolve().parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert not re.search(r"codelode\.llm|from \.llm|from \.\.llm", f.read_text()), f


def test_a_session_without_a_shared_folder_gets_one_of_its_own():
    from types import SimpleNamespace

    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(applicationId="none", master="local[4]"))
    a, b = common.shared_dir(bare, "x"), common.shared_dir(bare, "x")
    assert a != b and a.rsplit("/", 1)[0] == b.rsplit("/", 1)[0] and a.startswith("file://")
    bare.sparkContext.master = "spark://h:7077"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(bare, "x")


def test_clean_up_deletes_what_was_written(spark):
    import os

    common.stored(spark.range(3), "gone")
    mine = list(common._WRITTEN[spark.sparkContext.applicationId])
    assert common.clean_up(spark) == len(mine) and not any(os.path.exists(p.removeprefix("file://")) for p in mine)
    assert common.clean_up(spark) == 0
