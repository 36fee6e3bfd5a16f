"""Shared helpers of the training-data operators: table access, checkpoint folder, file assembly."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.sources.tables import file_texts  # noqa: F401  (the operators take it from here)

TOKENIZER_DIR = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: dict[str, str] = {}  # folders of sessions without the setting, by application


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a local one only where that setting is absent and Spark runs in one process.

    On a cluster without the setting every machine would write to a folder of its own, so that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        key = spark.sparkContext.applicationId
        if key not in _LOCAL:
            at = tempfile.mkdtemp(prefix="codelode-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
            _LOCAL[key] = f"file://{at}"
        base = _LOCAL[key]
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


_WRITTEN: dict[str, list[str]] = {}  # folders handed out, by application


def clean_up(spark: SparkSession) -> int:
    """Delete what the operators wrote to the shared folder in this session; for when their results have been used or written.

    What comes out of an operator may read these folders lazily, so nothing is deleted before. The number of folders comes out.
    """
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        removed(spark, path)
    return len(paths)


def stored(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write once to the shared folder, read back. Survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark, what)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it doesn't exist."""
    fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _files(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file under a name that must be new; written aside and renamed, so that nobody reads half of it."""
    fs, at = _files(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    stream.write(text.encode())
    stream.close()
    if not fs.rename(aside, at):
        fs.delete(aside, False)
        raise FileExistsError(path)


def removed(spark: SparkSession, path: str) -> None:
    fs, at = _files(spark, path)
    fs.delete(at, True)


BLOCK = 1_000  # rows of a group that are paired in one key


def block_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(x, y), x < y: each two members (text, id, n) of the groups paired in (a, b, n_a, n_b); a group paired with itself has a = b.

    Groups fall into blocks of about BLOCK members by a hash, and blocks are joined with blocks, so that no key has more than
    BLOCK times BLOCK pairs, however large a group is. Members without id are in no pair.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    at = members.where("id is not null").select("text", "id", F.pmod(F.xxhash64("id"), blocks("n")).cast("int").alias("block"))
    spread = pairs.withColumn("i", F.explode(F.sequence(F.lit(0), blocks("n_a") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), blocks("n_b") - 1)))
    spread = spread.where("a <> b or i <= j").select("a", "b", "i", "j")
    both = spread.join(at.toDF("a", "id_a", "i"), ["a", "i"]).join(at.toDF("b", "id_b", "j"), ["b", "j"])
    both = both.where("id_a <> id_b and (a <> b or i < j or id_a < id_b)")
    return both.select(F.least("id_a", "id_b").alias("x"), F.greatest("id_a", "id_b").alias("y"))


def pieces(rows: int, per_piece: int) -> int:
    return max(1, math.ceil(rows / per_piece))


def suffix(path: Column) -> Column:
    """Suffix of the file name with its dot, lower case; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


BUCKET_BITS = 32_768  # bits of one bitmap of Spark's bitmap functions
FILTER_BITS = 1 << 23  # one megabyte altogether, whatever the input


def possibly_in(rows: DataFrame, column: str, wanted: DataFrame, wanted_column: str) -> DataFrame:
    """Rows whose key may be among the wanted ones: all that are, few others. For thinning out before a shuffle.

    The filter is a bitmap of FILTER_BITS over hashes of the keys; only it is broadcast, so its size doesn't grow with the data.
    """
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)).cast("bigint")
    bits = (
        wanted.select(spot(F.col(wanted_column)).alias("_p"))
        .groupBy(F.expr(f"_p div {BUCKET_BITS}").alias("_bucket"))
        .agg(F.bitmap_construct_agg(F.col("_p") % BUCKET_BITS).alias("_bits"))
    )
    at = rows.withColumn("_p", spot(F.col(column))).withColumn("_bucket", F.expr(f"_p div {BUCKET_BITS}"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_p % {BUCKET_BITS}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return at.join(F.broadcast(bits), "_bucket").where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_p % 8 as int))")) != 0).drop("_p", "_bucket", "_bits")


def most_frequent(counts: DataFrame, n: str, kept: int) -> DataFrame:
    """The rows of the highest counts, at most kept of them; rows of about equal counts (within 3 %) stay or go together.

    A histogram of the counts' logarithms, of some thousand rows at most, gives the least count that stays, so nothing is
    sorted and what a caller collects is bounded by kept, whatever the number of partitions.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 24)
    steps = sorted(((r["s"], r["c"]) for r in counts.where(F.col(n) > 0).groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, taken = None, 0
    for s, c in steps:
        if taken + c > kept:
            break
        least, taken = s, taken + c
    if least is None:
        return counts.where(F.lit(False))
    return counts.where((F.col(n) > 0) & (step >= F.lit(least)))
