"""Files of two invented projects beside the tables, so that the queries of manifests, markers and entry points have rows.

The queries that use them run over the whole tables and these files together, in Spark and in SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions.text import suffix

from .registry import CHUNKS, FILES, escaped

ROWS = [
    ("inline-shop", path, text)
    for path, text in (
        ("package.json", '{"name": "shop", "dependencies": {"react": "^18.2.0", "express": "4"}, "devDependencies": {"jest": "29"}}'),
        ("requirements.txt", "# needed\nflask==2.0\nrequests>=2\n-r more.txt\n\npytest\n"),
        ("pyproject.toml", '[project]\nname = "shop"\ndependencies = ["ignored>=1"]\n'),
        ("Gemfile", "source 'https://gems.example'\ngem 'rails'\ngem \"pg\", '~> 1'\n"),
        ("main.py", "import app\n\napp.run()\n"),
        ("tools/fill.py", "def fill():\n    pass\n\n\nif __name__ == '__main__':\n    fill()\n"),
        ("web/server.ts", "export const port = 80\n"),
        ("src/controllers/order.py", "class OrderController:\n    pass\n"),
        ("src/models/order.py", "class Order:\n    pass\n"),
        ("src/views/order.py", "def show():\n    pass\n"),
        ("tests/test_order.py", "import pytest\nfrom hypothesis import given\n"),
        ("web/order.spec.ts", "import { test } from 'vitest'\n"),
        ("Dockerfile", "FROM scratch\n"),
        ("docker-compose.yml", "services: {}\n"),
        (".github/workflows/ci.yml", "on: push\n"),
        (".github/workflows/release.yaml", "on: push\n"),
        ("k8s/app.yml", "kind: Deployment\n"),
    )
] + [
    ("inline-lib", path, text)
    for path, text in (
        ("pyproject.toml", '[project]\nname = "lib"\ndependencies = [\n  "numpy>=1",\n  "typing[extra]",\n]\n'),
        ("Cargo.toml", '[package]\nname = "lib"\nversion = "1"\n\n[dependencies]\nserde = "1"\ntokio-util = "0.7"\n'),
        ("go.mod", "module lib\n\nrequire (\n\tgithub.com/gin-gonic/gin v1.9.1\n\tgolang.org/x/net v0.1.0\n)\n"),
        ("packages/core/lib.rs", "#[test]\nfn works() {}\n"),
        ("apps/run/main.go", "package main\n"),
        ("nx.json", "{}\n"),
        (".gitlab-ci.yml", "stages: []\n"),
    )
]

INVENTED = "invented(project_id, rel_path, content) as (values " + ", ".join(f"('{p}', '{r}', '{escaped(t)}')" for p, r, t in ROWS) + ")"
_FILES = (
    FILES.replace("files_v as (", "files_0 as (")
    + """,
files_v as (select * from files_0 union all by name select project_id, rel_path, cast(length(content) as bigint) as size_bytes, lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) as ext from invented)"""
)
_CHUNKS = (
    CHUNKS.replace("chunks_v as (", "chunks_0 as (")
    + """,
chunks_v as (select * from chunks_0 union all by name select project_id, rel_path, cast(0 as int) as chunk_index, cast(1 as int) as start_line, cast(len(string_split(content, chr(10))) - 1 as int) as end_line, content from invented)"""
)


def sql(text: str) -> str:
    """A query's text over the tables and the invented files."""
    return "with " + INVENTED + ", " + text.removeprefix("with ").replace(FILES, _FILES).replace(CHUNKS, _CHUNKS)


def rows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROWS, "project_id string, rel_path string, content string")


def with_files(files: DataFrame) -> DataFrame:
    more = rows(files.sparkSession).select("project_id", "rel_path", F.length("content").cast("bigint").alias("size_bytes"), F.lower(suffix(F.col("rel_path"))).alias("ext"))
    return files.unionByName(more, allowMissingColumns=True)


def with_chunks(chunks: DataFrame) -> DataFrame:
    lines = (F.size(F.split("content", "\n")) - 1).alias("end_line")
    more = rows(chunks.sparkSession).select("project_id", "rel_path", F.lit(0).alias("chunk_index"), F.lit(1).alias("start_line"), lines, "content")
    return chunks.unionByName(more, allowMissingColumns=True)


def with_texts(texts: DataFrame) -> DataFrame:
    return texts.unionByName(rows(texts.sparkSession).withColumnRenamed("content", "text"))
