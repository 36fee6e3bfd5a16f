"""Source trees: a batch source that lists files, and readers of their texts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codelode.functions import fixed

LISTED = "path string, rel_path string, extension string, size_bytes bigint, last_modified double"


def supported(name: str) -> bool:
    """By the last suffix; `.env.example` by its whole name."""
    return PurePosixPath(name).suffix in fixed.SUPPORTED_SUFFIXES or name == ".env.example"


def inside(path: str, root: str) -> bool:
    """Whether a path, links resolved, lies below the root."""
    real, base = os.path.realpath(path), os.path.realpath(root)
    return real == base or real.startswith(base.rstrip(os.sep) + os.sep)


def walk(folder: str, root: str, every: bool = False) -> Iterator[tuple[str, str, str, int, float]]:
    """Regular files of a supported suffix, 1 to MAX_FILE_BYTES bytes, in folders that aren't ignored; no links.

    every: also files that aren't indexed, for probes of marker files.
    """
    for at, dirs, names in os.walk(folder, followlinks=False):
        dirs[:] = sorted(d for d in dirs if d not in fixed.IGNORED_DIRS and not os.path.islink(os.path.join(at, d)))
        for name in sorted(names):
            path = os.path.join(at, name)
            if os.path.islink(path) or not (every or supported(name)) or not inside(path, root):
                continue
            try:
                stat = os.stat(path)
            except OSError:
                continue
            if os.path.isfile(path) and (every or 0 < stat.st_size <= fixed.MAX_FILE_BYTES):
                yield path, os.path.relpath(path, root).replace(os.sep, "/"), PurePosixPath(name).suffix, stat.st_size, stat.st_mtime


class _Folder(InputPartition):
    def __init__(self, path: str | None):
        super().__init__(path)


class _TreeReader(DataSourceReader):
    """One partition for each first-level folder and one for the files at the root, so that a large tree is walked in parallel."""

    def __init__(self, root: str, every: bool):
        self.root, self.every = root, every

    def partitions(self):
        if not os.path.exists(self.root):
            raise FileNotFoundError(f"no such folder: {self.root}")
        if not os.path.isdir(self.root):
            raise NotADirectoryError(f"not a folder: {self.root}")
        with os.scandir(self.root) as found:
            folders = sorted(e.path for e in found if e.is_dir(follow_symlinks=False) and e.name not in fixed.IGNORED_DIRS)
        return [_Folder(None), *map(_Folder, folders)]

    def read(self, partition):
        if partition.value is not None:
            yield from walk(partition.value, self.root, self.every)
            return
        for row in walk(self.root, self.root, self.every):
            if "/" in row[1]:
                return  # os.walk gives the root's own files first
            yield row


class TreeSource(DataSource):
    """Format "source_tree" with the option path, and every=true for all files."""

    @classmethod
    def name(cls):
        return "source_tree"

    def schema(self):
        return LISTED

    def reader(self, schema):
        return _TreeReader(os.path.realpath(self.options["path"]), self.options.get("every", "false") == "true")


def list_tree(spark: SparkSession, root: str, every: bool = False) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("path", os.path.realpath(root)).option("every", str(every).lower()).load()


def decoded(data: bytes, longest: int = fixed.READ_CHARS) -> tuple[str, bool, str | None]:
    """(text, truncated, error). A NUL in the first SNIFF_BYTES or too much that can't be read means binary."""
    if b"\0" in data[: fixed.SNIFF_BYTES]:
        return "", False, "binary_file"
    text = data.decode("utf-8", "ignore")
    cut = text[:longest]
    if cut and cut.count(chr(0xFFFD)) > 0.1 * len(cut):
        return "", False, "binary_file"
    return cut, len(text) > longest, None


TEXTS = "rel_path string, content string, truncated boolean, error string"


def read_texts(listing: DataFrame, longest: int = fixed.READ_CHARS) -> DataFrame:
    """The text of every listed file; errors come as a column, not as a failure. Reads where the task runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, rel in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with open(path, "rb") as f:
                        rows.append((rel, *decoded(f.read(), longest)))
                except OSError as e:
                    rows.append((rel, "", False, type(e).__name__))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.string())],
                names=["rel_path", "content", "truncated", "error"],
            )

    return listing.select("path", "rel_path").mapInArrow(run, TEXTS)
