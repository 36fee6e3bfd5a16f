"""Changes of a source tree as a stream: a snapshot at each trigger, upserts and deletions between two of them."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from codelode.sources.tree import walk

CHANGES = "rel_path string, op string, at double"
QUIET_SECONDS = 2


class _Changes(SimpleDataSourceStreamReader):
    """The offset names a snapshot kept in a folder beside the checkpoint, not the listing itself.

    A snapshot holds the time it was taken, so that reading between two offsets again gives the very same rows. The folder
    may be on any file system that pyarrow knows by its address, and has to be shared where the driver may move.
    """

    def __init__(self, root: str, state: str):
        self.root, self.state = root, state

    def _place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.state) if "://" in self.state else (fs.LocalFileSystem(), self.state)

    def _listing(self) -> dict[str, list]:
        return {rel: [size, at] for _, rel, _, size, at in walk(self.root, self.root)}

    def _save(self, version: int, listing: dict, at: float) -> None:
        files, base = self._place()
        files.create_dir(base, recursive=True)
        with files.open_output_stream(f"{base}/.{version}.tmp") as f:
            f.write(json.dumps({"at": at, "files": listing}).encode())
        files.move(f"{base}/.{version}.tmp", f"{base}/{version}.json")

    def _load(self, version: int) -> dict:
        files, base = self._place()
        name = f"{base}/{version}.json"
        if files.get_file_info(name).type == fs.FileType.NotFound:
            return {"at": 0.0, "files": {}}
        with files.open_input_stream(name) as f:
            return json.loads(f.read())

    def initialOffset(self):
        return {"version": 0}

    def _between(self, a: dict, b: dict):
        old, new, at = a["files"], b["files"], b["at"]
        gone = [(p, "delete", at) for p in sorted(old.keys() - new.keys())]
        return gone + [(p, "upsert", at) for p in sorted(new) if old.get(p) != new[p]]

    def read(self, start):
        before, now = self._load(start["version"]), {"at": time.time(), "files": self._listing()}
        rows = self._between(before, now)
        if not rows:
            return iter([]), start
        version = start["version"] + 1
        self._save(version, now["files"], now["at"])
        return iter(rows), {"version": version}

    def readBetweenOffsets(self, start, end):
        return iter(self._between(self._load(start["version"]), self._load(end["version"])))

    def commit(self, end):
        """The snapshot of the end and the one before it stay: a batch may be asked for again."""
        files, base = self._place()
        for info in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            name = info.base_name
            if name.endswith(".json") and name[:-5].isdigit() and int(name[:-5]) < end["version"] - 1:
                files.delete_file(info.path)


class TreeChanges(DataSource):
    """Format "tree_changes" with the options path and state."""

    @classmethod
    def name(cls):
        return "tree_changes"

    def schema(self):
        return CHANGES

    def simpleStreamReader(self, schema):
        return _Changes(os.path.realpath(self.options["path"]), self.options["state"])


def changes(spark: SparkSession, root: str, state: str) -> DataFrame:
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("path", root).option("state", state).load()


class Watchers:
    """Running watches by root; starting one twice is one watch."""

    def __init__(self, spark: SparkSession, state: str):
        self.spark, self.state = spark, state
        self.queries: dict[str, StreamingQuery] = {}

    def start(self, root: str, on_change: Callable[[DataFrame], None], once: bool = False) -> StreamingQuery:
        root = os.path.realpath(root)
        running = self.queries.get(root)
        if running is not None and running.isActive:
            return running
        name = hashlib.sha256(root.encode()).hexdigest()[:16]

        def each(batch: DataFrame, _: int) -> None:
            if not batch.isEmpty():
                on_change(batch)

        writer = changes(self.spark, root, f"{self.state}/{name}/snapshots").writeStream.foreachBatch(each).option("checkpointLocation", f"{self.state}/{name}/checkpoint")
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{QUIET_SECONDS} seconds")
        self.queries[root] = writer.start()
        return self.queries[root]

    def stop(self, root: str) -> bool:
        running = self.queries.pop(os.path.realpath(root), None)
        if running is None:
            return False
        running.stop()
        return True

    def active(self) -> list[str]:
        return sorted(r for r, q in self.queries.items() if q.isActive)
