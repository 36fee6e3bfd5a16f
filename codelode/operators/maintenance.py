"""Incremental maintenance: snapshot differences, upserts, purging; and session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from codelode.sources.tables import keep_last


def deleted(index: DataFrame, listing: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the index that the listing no longer has."""
    return index.select(*keys).distinct().join(listing.select(*keys).distinct(), keys, "left_anti")


def changed_since(listing: DataFrame, since: Column) -> DataFrame:
    return listing.where(F.col("last_modified") > since)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, change): added, deleted or changed; what has an old time stamp but is new counts as added."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change is not null")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Union of both with the last row of each key."""
    return keep_last(base.unionByName(changes), keys, F.desc_nulls_last(order))


def keep_first(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """W08."""
    return keep_last(rows, keys, *(F.asc_nulls_last(c) for c in order))


def purge(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without those of the keys gone."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def next_turn(log: DataFrame, session: str) -> DataFrame:
    """The turn that a session's next entry gets."""
    return log.groupBy(session).agg((F.coalesce(F.max("turn_index"), F.lit(-1)) + 1).alias("next_turn"))


def tail(log: DataFrame, session: str, n: int) -> DataFrame:
    """The last n turns of each session; order by turn_index to read them in time."""
    rank = F.row_number().over(W.partitionBy(session).orderBy(F.desc("turn_index")))
    return log.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def history_block(log: DataFrame, session: str, n: int = 3) -> DataFrame:
    """(session, block): the last n turns as one text, oldest first."""
    rows = tail(log, session, n).select(session, F.struct("turn_index", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("t")).alias("s"))
    texts = F.transform(F.array_sort(F.collect_list("s")), lambda x: x["t"])  # n entries at most
    return rows.groupBy(session).agg(F.array_join(texts, "\n\n").alias("block"))


def complete_ranking(chosen: DataFrame, all_: DataFrame, key: str, order: str) -> DataFrame:
    """The chosen keys in their order, then the missing ones in theirs: (key, position)."""
    rest = all_.join(chosen, key, "left_anti").select(key, F.lit(1).alias("_p"), F.col(order).alias("_o"))
    both = chosen.select(key, F.lit(0).alias("_p"), F.col(order).alias("_o")).unionByName(rest)
    return both.select(key, F.row_number().over(W.orderBy("_p", "_o", key)).alias("position"))
