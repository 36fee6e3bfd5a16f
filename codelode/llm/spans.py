"""Problem 5: long exact spans shared between chunks.

Windows of SPAN characters are winnowed: of the GRAM-character hashes in a window the smallest is kept, so any span of SPAN
characters leaves the same fingerprint in every text it stands in. Fingerprints live in a log-structured index: immutable
runs sorted by hash; a new batch is merge-joined with the runs and with itself, the pairs are verified on the texts, the
batch becomes a run of its own, and runs of like size are compacted into one. An index can be kept in a folder for
batches to come.

Equal contents form one class (by their md5); only classes are fingerprinted and compared, whatever the number of copies.
A fingerprint that more than HOT texts have (a licence header) isn't compared pair by pair: its texts are grouped by the
exact windows of SPAN characters around it, which is linear in the texts; windows with the same texts count once.

The operators here write, count and collect before they return a DataFrame: they run when they are built.

Defined results: null contents and those shorter than SPAN share nothing; repeated rows of a chunk count once; repetition
within a chunk is no case; characters are code points; nothing is normalised.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import block_pairs, listed, possibly_in, read_text, removed, shared_dir, stored, write_text

SPAN, GRAM = 300, 180
HOT = 50  # texts with one print that are compared pair by pair; more of them are grouped by their exact windows
BATCHES = 3  # the corpus enters the index in so many batches by time of ingestion

BASE = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 17)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b)])) for b in (BASE, BACK)]
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def window_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of so many characters; equal windows have equal hashes wherever they stand."""
    up, down = _powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.add.accumulate(_mixed(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
    return _mixed((sums[size:] - sums[:-size]) * down[: len(codes) - size + 1])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    n = len(a)
    pad = -n % w
    b = np.concatenate([a, np.full(pad, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(b, axis=1).ravel()
    behind = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def fingerprints(texts: list[str], span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(index of the text, fingerprint), distinct; texts are hashed together in blocks."""
    of, prints, block, size = [], [], [], 0

    def flush() -> None:
        if not block:
            return
        codes = [points(texts[i]) for i in block]
        lows = sliding_min(window_hashes(np.concatenate(codes), gram), span - gram + 1)
        at = 0
        for i, c in zip(block, codes, strict=True):
            mine = np.unique(lows[at : at + len(c) - span + 1])
            of.append(np.full(len(mine), i))
            prints.append(mine)
            at += len(c)
        block.clear()

    for i, t in enumerate(texts):
        if len(t) >= span:
            block.append(i)
            size += len(t)
            if size > 200_000:
                flush()
                size = 0
    flush()
    if not of:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(of), np.concatenate(prints).view(np.int64)


def shared_windows(a: str, b: str, span: int = SPAN) -> tuple[list[list[int]], list[list[int]]]:
    """Stretches [begin, end) of a and of b made of windows of that length that stand in both; compared character by character."""
    if len(a) < span or len(b) < span:
        return [], []
    ha, hb = window_hashes(points(a), span), window_hashes(points(b), span)
    common, ia, ib = np.intersect1d(ha, hb, return_indices=True)
    equal = [a[i : i + span] == b[j : j + span] for i, j in zip(ia, ib, strict=True)]
    common = common[np.array(equal, dtype=bool)]
    if not len(common):
        return [], []

    def stretches(h: np.ndarray) -> list[list[int]]:
        at = np.flatnonzero(np.isin(h, common))
        cut = np.flatnonzero(np.diff(at) > span)
        return [[int(x), int(y) + span] for x, y in zip(at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])], strict=True)]

    return stretches(ha), stretches(hb)


class FingerprintIndex:
    """Log-structured index in a folder: immutable runs of (print, text, n), and manifests that name the valid ones.

    A run is bucketed and sorted by print, n is the number of its texts with that print. All runs of an index have the same
    number of buckets, so a batch that is written as a run of its own meets older runs bucket by bucket: history is neither
    shuffled nor rewritten, but for the compaction of runs of one level. Each append ends with a new manifest, created under
    the next number and never changed; who opens the folder later, in another session too, goes on from the last one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, fan: int = 2, buckets: int | None = None):
        self.spark, self.fan, self.path = spark, fan, (path or shared_dir(spark, "index")).rstrip("/")
        self.version, self.runs = 0, []
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for name in sorted(listed(spark, self.path)):
            if name.startswith("manifest-") and name.endswith(".json"):
                last = json.loads(read_text(spark, f"{self.path}/{name}"))
                self.version, self.buckets, self.runs = last["version"], last["buckets"], [tuple(r) for r in last["runs"]]

    def table(self, run: str) -> DataFrame:
        """A run as a bucketed table; entered in the session's catalogue where it isn't yet."""
        if not self.spark.catalog.tableExists(run):
            place = f"{self.path}/{run}".replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE {run} (print BIGINT, text BINARY, n BIGINT) USING parquet "
                f"CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{place}'"
            )
        return self.spark.table(run)

    def _write(self, rows: DataFrame) -> str:
        run = f"run_{uuid.uuid4().hex}"
        placed = rows.select("print", "text").repartition(self.buckets, "print").dropDuplicates(["print", "text"])
        counted = placed.withColumn("n", F.count("*").over(W.partitionBy("print")))
        counted.write.bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.path}/{run}").saveAsTable(run)
        return run

    def met(self, run: str, old: str) -> DataFrame:
        """(print, x, y, nx, ny): texts of a run beside those of an older one that have the same print. No exchange."""
        return self.table(run).toDF("print", "x", "nx").join(self.table(old).toDF("print", "y", "ny").hint("merge"), "print").where("x <> y")

    def append(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The batch becomes a run. Comes out: pairs (a < b) of texts with a common print, at least one of them in the batch;
        and (print, text) of the prints that more than HOT texts have, whose pairs are left out."""
        run = self._write(batch)
        within = self.table(run).where(F.col("n") <= HOT)
        pairs = within.toDF("print", "x", "nx").join(within.toDF("print", "y", "ny").hint("merge"), "print").where("x < y").select("x", "y")
        hot = self.table(run).where(F.col("n") > HOT).select("print")
        new = self.table(run).groupBy("print").agg(F.first("n").alias("nx"))
        for _, old in self.runs:
            met = self.met(run, old).where(F.col("nx") + F.col("ny") <= HOT)
            pairs = pairs.unionByName(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
            both = new.join(self.table(old).groupBy("print").agg(F.first("n").alias("ny")).hint("merge"), "print")
            hot = hot.unionByName(both.where(F.col("nx") + F.col("ny") > HOT).select("print"))
        found = stored(pairs.distinct().toDF("a", "b"), "pairs")
        hot = stored(hot.distinct(), "hot")
        members = [self.table(r).join(hot, "print", "left_semi").select("print", "text") for r in (run, *(r for _, r in self.runs))]
        members = stored(reduce(DataFrame.unionByName, members).distinct(), "members")
        self.runs.append((0, run))
        self._compact()
        self.version += 1
        write_text(self.spark, f"{self.path}/manifest-{self.version:08d}.json", json.dumps({"version": self.version, "buckets": self.buckets, "runs": self.runs}))
        return found, members

    def _compact(self) -> None:
        """Merge the runs of a level once there are fan of them; what was in two runs stands in the merged one once.

        The runs merged stay where they are for those who read by an older manifest, until vacuum.
        """
        level = 0
        while any(r[0] >= level for r in self.runs):
            same = [r for r in self.runs if r[0] == level]
            if len(same) >= self.fan:
                merged = reduce(DataFrame.unionByName, [self.table(r) for _, r in same])
                self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, self._write(merged))]
            level += 1

    def vacuum(self) -> None:
        """Delete the runs that the last manifest doesn't name; for when nobody reads by an older one."""
        kept = {r for _, r in self.runs}
        for name in listed(self.spark, self.path):
            if name.startswith("run_") and name not in kept:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                removed(self.spark, f"{self.path}/{name}")


def _prepared(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.length("content") >= SPAN).select("chunk_id", "content", "ingested_at", F.unhex(F.md5("content")).alias("text"))


def text_prints(rows: DataFrame) -> DataFrame:
    """(print, text, batch) of every row of (text, content, batch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = part.column(0)
                first: dict[bytes, int] = {}
                for i, k in enumerate(keys.to_pylist()):
                    first.setdefault(k, i)  # copies within a batch of rows are hashed once
                index = np.fromiter(first.values(), dtype=np.int64)
                texts = part.column(1).take(pa.array(index)).to_pylist()
                of, prints = fingerprints(texts)
                rows = pa.array(index[of] if len(of) else np.zeros(0, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(prints), keys.take(rows), part.column(2).take(rows)], names=["print", "text", "batch"])

    return rows.select("text", "content", "batch").mapInArrow(run, "print bigint, text binary, batch int")


def verified(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(a, b, sa, sb): pairs of texts that share a span, with the shared stretches of both."""
    needed = pairs.select(F.col("a").alias("text")).unionByName(pairs.select(F.col("b").alias("text"))).distinct()
    needed = stored(needed, "needed")
    texts = possibly_in(_prepared(chunks).select("text", "content"), "text", needed, "text").join(needed, "text", "left_semi").groupBy("text").agg(F.first("content").alias("content"))
    texts = stored(texts, "texts")
    both = pairs.join(texts.toDF("a", "ca"), "a").join(texts.toDF("b", "cb"), "b").select("a", "b", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared_windows(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array([i for i, f in enumerate(found) if f[0]], pa.int64())
            kind = pa.list_(pa.list_(pa.int32()))
            sides = [pa.array([f[k] for f in found if f[0]], kind) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), *sides], names=["a", "b", "sa", "sb"])

    return both.mapInArrow(run, "a binary, b binary, sa array<array<int>>, sb array<array<int>>")


def hot_windows(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """(window, text, start): the windows of SPAN characters around the members' prints, by a digest of their characters."""
    of = members.groupBy("text").agg(F.collect_set("print").alias("prints"))
    texts = possibly_in(_prepared(chunks).select("text", "content"), "text", of, "text").groupBy("text").agg(F.first("content").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, content, prints in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                grams = window_hashes(points(content), GRAM).view(np.int64)
                spots = np.flatnonzero(np.isin(grams, np.array(prints, dtype=np.int64)))
                starts = np.unique((spots[:, None] - np.arange(SPAN - GRAM + 1)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts <= len(content) - SPAN)]
                names = [hashlib.blake2b(content[i : i + SPAN].encode("utf-8", "surrogatepass"), digest_size=16).digest() for i in starts.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([key] * len(names), pa.binary()), pa.array(starts, pa.int32())], names=["window", "text", "start"])

    return texts.join(of, "text").select("text", "content", "prints").mapInArrow(run, "window binary, text binary, start int")


def sharing_texts(chunks: DataFrame, batches: int = BATCHES, index: FingerprintIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """Different texts that share a span, by way of the index: (a, b, sa, sb) by pairs with the shared stretches of both, and
    (window, text, start) of the windows that several of more than HOT texts have."""
    rows = _prepared(chunks)
    cuts = chunks.agg(F.percentile_approx(F.col("ingested_at").cast("timestamp").cast("double"), [k / batches for k in range(1, batches)])).first()[0] or []
    when = F.coalesce(F.col("ingested_at").cast("timestamp").cast("double"), F.lit(0.0))
    batch = sum(((when > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    path = shared_dir(chunks.sparkSession, "prints")
    text_prints(rows.withColumn("batch", batch)).distinct().write.partitionBy("batch").parquet(path)
    prints = chunks.sparkSession.read.schema("print bigint, text binary, batch int").parquet(path)
    index, pairs, members = index or FingerprintIndex(chunks.sparkSession), [], []
    for k in range(batches):
        met, hot = index.append(prints.where(F.col("batch") == k))
        pairs.append(met)
        members.append(hot)
    found = stored(verified(reduce(DataFrame.unionByName, pairs).distinct(), chunks), "sharing")
    members = reduce(DataFrame.unionByName, members).distinct()
    if members.isEmpty():
        return found, chunks.sparkSession.createDataFrame([], "window binary, text binary, start int")
    windows = stored(hot_windows(members, chunks), "windows")
    several = windows.groupBy("window").agg(F.min("text").alias("x"), F.max("text").alias("y")).where("x <> y").select("window")
    return found, stored(windows.join(several, "window", "left_semi"), "hot_windows")


def text_pairs(found: DataFrame, windows: DataFrame) -> DataFrame:
    """(a, b), a < b: every two different texts that share a span, once."""
    each = windows.select("window", "text").distinct()
    sets = each.groupBy("window").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(text))").alias("s"), F.expr("bit_xor(xxhash64(text, 1))").alias("t"))
    sets = sets.groupBy("n", "s", "t").agg(F.min("window").alias("window"))  # windows of the same texts count once
    own = sets.select(F.col("window").alias("a"), F.col("window").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    member = each.join(sets.select("window", "n"), "window").select(F.col("window").alias("text"), F.col("text").alias("id"), "n")
    hot = block_pairs(own, member).toDF("a", "b")
    return found.select("a", "b").unionByName(hot).distinct()


def classes(chunks: DataFrame) -> DataFrame:
    """(text, chunk_id, first, n): the rows of each text, its first chunk and their number."""
    rows = _prepared(chunks).select("text", "chunk_id").distinct()
    per = rows.groupBy("text").agg(F.min("chunk_id").alias("first"), F.count("chunk_id").alias("n"))
    return rows.join(per, "text")


def sharing_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: all chunks that share a span of SPAN characters or more.

    All pairs come out, however many copies a text has; they are formed block by block. For the classes behind them
    see chunk_classes and class_pairs.
    """
    pairs = text_pairs(*sharing_texts(chunks))
    member = stored(classes(chunks), "classes")
    per = member.select("text", "n").distinct()
    a, b = (per.toDF(s, f"n_{s}") for s in "ab")
    own = per.where("n > 1").select(F.col("text").alias("a"), F.col("text").alias("b"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    sized = pairs.join(a, "a").join(b, "b").select("a", "b", "n_a", "n_b").unionByName(own)
    return block_pairs(sized, member.select("text", F.col("chunk_id").alias("id"), "n")).toDF("chunk_id_a", "chunk_id_b").distinct()


def class_pairs(chunks: DataFrame) -> DataFrame:
    """(class_a, class_b), a < b: different texts that share a span, each by the least chunk_id it stands in."""
    pairs = text_pairs(*sharing_texts(chunks))
    first = classes(chunks).select("text", "first").distinct()
    named = pairs.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b")
    return named.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct()


def chunk_classes(chunks: DataFrame) -> DataFrame:
    """(chunk_id, class_id, copies, links): each chunk of SPAN characters or more with the least chunk of the same text, the
    number of chunks of that text, and the number of other texts that share a span with it."""
    pairs = text_pairs(*sharing_texts(chunks))
    links = pairs.select(F.col("a").alias("text")).unionByName(pairs.select(F.col("b").alias("text"))).groupBy("text").agg(F.count("*").alias("links"))
    return classes(chunks).join(links, "text", "left").select("chunk_id", F.col("first").alias("class_id"), F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))


def shared_share(chunks: DataFrame) -> DataFrame:
    """(chunk_id, chars, shared_chars, share): how much of every chunk stands in another one."""
    found, windows = sharing_texts(chunks)
    sides = found.select(F.col("a").alias("text"), F.explode("sa").alias("s")).unionByName(found.select(F.col("b").alias("text"), F.explode("sb").alias("s")))
    hot = windows.select("text", F.col("start").alias("x"), (F.col("start") + SPAN).alias("y"))
    spans = sides.select("text", F.col("s")[0].alias("x"), F.col("s")[1].alias("y")).unionByName(hot).distinct()
    before = F.max("y").over(W.partitionBy("text").orderBy("x", "y").rowsBetween(W.unboundedPreceding, -1))
    covered = spans.withColumn("top", F.coalesce(before, F.lit(0))).groupBy("text").agg(F.sum(F.greatest(F.lit(0), F.col("y") - F.greatest("x", "top"))).alias("covered"))
    rows = chunks.select("chunk_id", F.coalesce(F.length("content"), F.lit(0)).alias("chars"), F.when(F.length("content") >= SPAN, F.unhex(F.md5("content"))).alias("text")).distinct()
    copies = classes(chunks).where("n > 1").select("text").distinct().withColumn("copied", F.lit(True))
    shared = F.when(F.col("copied"), F.col("chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("int")
    return (
        rows.join(covered, "text", "left").join(copies, "text", "left")
        .select("chunk_id", "chars", shared.alias("shared_chars"))
        .withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0)))
    )
