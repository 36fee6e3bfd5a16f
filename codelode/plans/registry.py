"""Registry of queries: a callable of (spark, folder) and, where SQL can say the same, its text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def listed(words) -> str:
    """Words as a SQL list of strings."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def escaped(pattern: str) -> str:
    return pattern.replace("'", "''")


#: The valid row of each key, and the text of each file, for the SQL texts.
FILES = """
files_v as (
  select *, lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) as ext from files
  qualify row_number() over (partition by project_id, rel_path order by scanned_at desc nulls last, size_bytes desc nulls last, last_modified desc nulls last, extension desc nulls last) = 1
)"""
CHUNKS = """
chunks_v as (select * from chunks qualify row_number() over (partition by chunk_id order by ingested_at desc nulls last) = 1)"""
TEXTS = (
    CHUNKS
    + """,
texts as (
  select project_id, rel_path, string_agg(content, chr(10) order by chunk_index, chunk_id) as text,
    lower(regexp_extract(regexp_extract(rel_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1)) as ext
  from chunks_v group by project_id, rel_path
)"""
)
LINE_ENDS = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{0085}\\x{2028}\\x{2029}]"
LINES = (
    TEXTS
    + f""",
parts as (select project_id, rel_path, ext, regexp_split_to_array(text, '{LINE_ENDS}') as p from texts where text is not null),
lines as (select project_id, rel_path, ext, case when p[-1] = '' then p[:-2] else p end as ls from parts)"""
)
