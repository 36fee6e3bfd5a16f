"""Persistence of an index: immutable folders, numbered manifests; tables are partitioned by project."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.functions import fixed
from codelode.sources.tables import keep_last

#: Tables of the store and their columns besides project_id.
SCHEMAS = {
    "files": "rel_path string, extension string, size_bytes bigint, last_modified double",
    "listing": "rel_path string, extension string, size_bytes bigint, last_modified double",
    "texts": "rel_path string, text string",
    "chunks": "rel_path string, chunk_index int, start_line int, end_line int, content string, symbol_name string",
    "symbols": "rel_path string, name string, type string, line int",
    "keyword_files": "keyword string, rel_path string",
    "file_imports": "source_path string, imported_name string, target_path string",
    "symbol_categories": "rel_path string, symbol_name string, category string, detail string",
    "embeddings": "rel_path string, chunk_index int, vector array<float>",
    "module_summaries": "module_path string, summary string, key_patterns array<string>, domain_concepts array<string>, key_abstractions array<string>",
    "semantic_summary": "key string, value string",
    "catalogue": "project_id string, slug string, project_root string, repo_url string, schema_version int, file_count int, indexed_at double, entered bigint",
    "sessions": "session_id string, turn_index bigint, question string, answer string, relevant_files array<string>, created_at double",
    "status": "state string, at double",
}
SORTED = {"keyword_files": "keyword"}  # tables that are read by few values of a column
ALL = "_all"  # the project under which tables of all projects are kept
FOLD = 32  # folders of a growing table that are folded into one


class Store:
    """Tables in immutable folders; for each project, numbered manifests that name the folders of its current tables.

    A manifest is created once, under a number that nobody else has, and never changed: publishing several tables is one
    step, and a manifest that a crash left half written can't be parsed and counts as none. Folders that no manifest names
    any more are deleted once the manifest that last named them is older than the grace time, so that plans made from it
    still find their files. Tables that grow by rows (sessions, the catalogue of projects) get one more folder for each
    addition, and are folded into one from time to time.
    """

    def __init__(self, spark: SparkSession, root: str, grace: float = 3600.0):
        self.spark, self.root, self.grace = spark, root.rstrip("/"), grace
        jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(self.conf)

    def _names(self, at: str) -> list:
        p = self.path(at)
        return list(self.fs.listStatus(p)) if self.fs.exists(p) else []

    def _manifests(self, project: str) -> str:
        return f"{self.root}/manifests/project_id={project}"

    def _numbers(self, project: str) -> list[tuple[int, float]]:
        """(number, time in seconds) of a project's manifests, in order."""
        found = ((s.getPath().getName(), s.getModificationTime() / 1000) for s in self._names(self._manifests(project)))
        return sorted((int(n.removesuffix(".json")), at) for n, at in found if n.endswith(".json"))

    def _manifest(self, project: str, number: int) -> dict[str, list[str]] | None:
        p = self.path(f"{self._manifests(project)}/{number:012d}.json")
        try:
            stream = self.fs.open(p)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        except Exception:  # noqa: BLE001  (gone, or half written)
            return None

    def tables(self, project: str) -> dict[str, list[str]]:
        """Folders of each current table: those of the last manifest that is whole."""
        for number, _ in reversed(self._numbers(project)):
            found = self._manifest(project, number)
            if found is not None:
                return found
        return {}

    def _commit(self, project: str, change: Callable[[dict[str, list[str]]], dict[str, list[str]]]) -> None:
        """Apply a change to the current manifest; again on top of theirs where someone else was faster."""
        for _ in range(50):
            numbers = self._numbers(project)
            after = change(self.tables(project))
            at = self.path(f"{self._manifests(project)}/{(numbers[-1][0] if numbers else 0) + 1:012d}.json")
            try:
                stream = self.fs.create(at, False)
            except Exception as e:  # noqa: BLE001
                if self.fs.exists(at):
                    continue
                raise e
            stream.write(json.dumps(after).encode())
            stream.close()
            self.vacuum(project)
            return
        raise OSError(f"the manifest of {project} couldn't be written")

    def _stage(self, table: str, project: str, rows: DataFrame) -> str:
        """Write rows to a folder of their own; nobody sees them until a manifest names it."""
        version = f"v-{time.time_ns()}-{uuid.uuid4().hex[:6]}"
        columns = [c.split()[0] for c in SCHEMAS[table].split(", ")]
        rows = rows.select(*columns)
        if table in SORTED:  # statistics of the files' row groups let a reader of few keys skip the rest
            rows = rows.repartitionByRange(SORTED[table]).sortWithinPartitions(SORTED[table])
        rows.write.parquet(f"{self.root}/{table}/project_id={project}/{version}")
        return version

    def publish(self, project: str, tables: dict[str, DataFrame]) -> None:
        """Replace several tables of a project in one step."""
        staged = {table: [self._stage(table, project, rows)] for table, rows in tables.items()}
        self._commit(project, lambda now: now | staged)

    def write(self, table: str, project: str, rows: DataFrame) -> None:
        self.publish(project, {table: rows})

    def append(self, table: str, project: str, rows: DataFrame) -> None:
        """Add rows; what is there isn't read, but for the folding of FOLD folders into one."""
        one = self._stage(table, project, rows)
        self._commit(project, lambda now: now | {table: [*now.get(table, []), one]})
        many = self.tables(project).get(table, [])
        if len(many) >= FOLD:
            folded = self._stage(table, project, self._folders(table, project, many).coalesce(1))
            self._commit(project, lambda now: now | {table: [folded, *(f for f in now.get(table, []) if f not in many)]})

    def vacuum(self, project: str) -> None:
        """Delete manifests beyond the grace time, and folders that neither a kept manifest nor a write under way needs."""
        numbers, now = self._numbers(project), time.time()
        kept = [n for k, (n, _) in enumerate(numbers) if k + 1 == len(numbers) or now - numbers[k + 1][1] <= self.grace]
        if len(kept) == len(numbers):
            return
        named: dict[str, set[str]] = {}
        for n in kept:
            for table, folders in (self._manifest(project, n) or {}).items():
                named.setdefault(table, set()).update(folders)
        for table in SCHEMAS:
            for s in self._names(f"{self.root}/{table}/project_id={project}"):
                name = s.getPath().getName()
                if name.startswith("v-") and name not in named.get(table, ()) and now - s.getModificationTime() / 1000 > self.grace:
                    self.fs.delete(s.getPath(), True)
        for n, _ in numbers:
            if n not in kept:
                self.fs.delete(self.path(f"{self._manifests(project)}/{n:012d}.json"), False)

    def _folders(self, table: str, project: str, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(*(f"{self.root}/{table}/project_id={project}/{f}" for f in folders))

    def read(self, table: str, project: str) -> DataFrame | None:
        """The current rows, lazily; None if the project has no such table. Only this project's folders are listed."""
        folders = self.tables(project).get(table)
        return self._folders(table, project, folders) if folders else None

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], SCHEMAS[table])

    def get(self, table: str, project: str) -> DataFrame:
        found = self.read(table, project)
        return self.empty(table) if found is None else found

    def register(self, project: str, row: DataFrame) -> None:
        """Enter a project in the catalogue: one table for all projects, the last row of each counts."""
        full = row.select(F.lit(project).alias("project_id"), "slug", "project_root", "repo_url", "schema_version", "file_count", "indexed_at")
        self.append("catalogue", ALL, full.withColumn("entered", F.lit(time.time_ns())))

    def projects(self) -> DataFrame:
        """The catalogue; projects of another schema version are left out, to be indexed anew."""
        rows = keep_last(self.get("catalogue", ALL), ["project_id"], F.desc("entered"))
        return rows.where(F.col("schema_version") == fixed.SCHEMA_VERSION).drop("entered")

    def delete(self, project: str) -> bool:
        """Drop a project from the catalogue, and its folders in the store; the sources are never touched."""
        if not self.projects().where(F.col("project_id") == project).isEmpty():
            none = self.empty("catalogue").select("slug", "project_root", "repo_url", "schema_version", "file_count", "indexed_at")
            self.register(project, self.spark.createDataFrame([(None,) * 6], none.schema))
        found = False
        for at in (self._manifests(project), *(f"{self.root}/{table}/project_id={project}" for table in SCHEMAS)):
            if self.fs.exists(self.path(at)):
                found = self.fs.delete(self.path(at), True) or found
        return found


def decoded_value(value: str):
    """JSON where it is, else the text itself."""
    try:
        return json.loads(value)
    except (TypeError, ValueError):
        return value


def legacy_rows(spark: SparkSession, path: str) -> DataFrame:
    """Files of an index that was kept as one JSON document: (rel_path, symbols, keywords)."""
    raw = spark.read.text(path, wholetext=True)
    files = F.from_json(F.get_json_object("value", "$.file_index"), "map<string, struct<symbols:array<string>,keywords:array<string>,size_bytes:bigint>>")
    return raw.select(F.explode(files).alias("rel_path", "f")).select("rel_path", "f.symbols", "f.keywords", "f.size_bytes")
