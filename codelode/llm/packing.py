"""Problem 8: filling containers of fixed capacity with the texts of documents, measured in tokens.

Method: bin completion. Around the largest text left the undominated fillings of its container are enumerated, larger sizes
first; a branch is cut as soon as its waste can't fall below what is still allowed, and all containers together may waste
no more than the number of containers asked for leaves. Containers whose followers fail are undone and filled otherwise.
Best-fit decreasing is the incumbent; the search asks for the least possible number of containers first, then for numbers
in between, each time with ALL_NODES search nodes; where they are used up, the incumbent stands. Work is split into groups
of bounded size by a hash of the row, so that nothing is collected whole: each group leaves at most its last containers
partly empty, and these are packed once more across groups.

Defined results: a text longer than the capacity is cut into full containers and one rest, which is packed like a
text; null and empty texts have no tokens and come out with a null container; repeated rows are packed each on its own.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
import random
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored
from .tokens import token_counts

GROUP = 4096  # texts that one task packs together
NODES = 600  # search nodes for the fillings of one container
ALL_NODES = 400_000  # search nodes for all containers of a group, for each number of containers asked for
ROUNDS = 40  # times that containers are undone and searched again
FILLINGS = 8  # fillings of a container that are kept, those of least waste
MOST_BUDGETS = 100  # kinds of containers in one call
FULL_ENOUGH = 0.98  # containers of a group at least this full are final; the others are packed again across groups


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices by container."""
    bins: list[list[int]] = []
    rooms: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_right(rooms, (sizes[i] - 1, 1 << 60))
        if at < len(rooms):
            room, b = rooms.pop(at)
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        if room > sizes[i]:
            insort(rooms, (room - sizes[i], b))
    return bins


def least_containers(sizes: list[int], capacity: int) -> int:
    """No packing has fewer containers: sizes above a threshold's complement stand alone, those over half one to a container,
    and what the latter leave must take the sizes from the threshold up to half."""
    desc = sorted(sizes, reverse=True)
    sums = [0, *accumulate(desc)]
    over = lambda x: bisect_left(desc, -x, key=lambda v: -v)  # how many are larger than x
    half, best = over(capacity // 2), -(-sums[-1] // capacity)
    for least in sorted({v for v in desc if 2 * v <= capacity}):
        alone, down_to = over(capacity - least), bisect_right(desc, -least, key=lambda v: -v)
        room = (half - alone) * capacity - (sums[half] - sums[alone])
        best = max(best, half + max(0, -(-(sums[down_to] - sums[half] - room) // capacity)))
    return max(best, half)


class Budget:
    """Search nodes left, and what was cut off, for the whole search of a group."""

    def __init__(self, nodes: int):
        self.left, self.bounded, self.dominated, self.undone = nodes, 0, 0, 0


def dominated(chosen: list[int], waste: int, values: list[int], counts: dict[int, int]) -> bool:
    """Whether one text that is left could take the place of one or two of the chosen: whatever else is packed, that is no worse."""
    for k, x in enumerate(chosen):
        if k and chosen[k - 1] == x:
            continue
        at = bisect_right(values, x)
        while at < len(values) and values[at] <= x + waste:
            if counts[values[at]] > 0:
                return True
            at += 1
    for i in range(len(chosen)):
        for j in range(i + 1, len(chosen)):
            two = chosen[i] + chosen[j]
            at = bisect_left(values, two)
            while at < len(values) and values[at] <= two + waste:
                if counts[values[at]] > 0:
                    return True
                at += 1
    return False


def completions(values: list[int], counts: dict[int, int], room: int, slack: int, budget: Budget, nodes: int = NODES, most: int = FILLINGS) -> list[tuple[int, list[int]]]:
    """(waste, sizes): undominated fillings of room out of counts (values ascending) that waste at most slack, least waste first.

    Larger sizes come first; a branch is cut as soon as all that is small enough to follow can't bring its waste down to slack.
    The search for one container ends with nodes used up or most fillings without waste found.
    """
    below = [0]  # sums of all texts up to a size
    for v in values:
        below.append(below[-1] + v * counts[v])
    found: list[tuple[int, list[int]]] = []
    left = min(nodes, budget.left)
    full = 0
    smallest = next((v for v in values if counts[v]), 1)

    def visit(high: int, room: int, chosen: list[int]) -> None:
        nonlocal left, full
        at = min(bisect_right(values, room), high)
        leaf = True
        while at > 0 and left > 0 and full < most:
            at -= 1
            v = values[at]
            if counts[v] == 0:
                continue
            if room - below[at + 1] > slack:
                budget.bounded += 1
                return  # smaller ones fill even less
            if room - v > slack and room - v < smallest:  # nothing fits into what v would leave
                budget.bounded += 1
                at = bisect_right(values, room - smallest, 0, at)
                continue
            left -= 1
            leaf = False
            counts[v] -= 1
            chosen.append(v)
            visit(at + 1 if counts[v] else at, room - v, chosen)
            chosen.pop()
            counts[v] += 1
        if leaf and room <= slack:
            if dominated(chosen, room, values, counts):
                budget.dominated += 1
            else:
                found.append((room, list(chosen)))
                full += room == 0

    before = left
    visit(len(values), room, [])
    budget.left -= before - left + 1
    found.sort(key=lambda f: (f[0], len(f[1]), [-v for v in f[1]]))
    return found[:most]


def complete(sizes: dict[int, int], capacity: int, target: int, budget: Budget) -> tuple[list[list[int]], bool]:
    """(containers of sizes (size -> number), whether they hold all), target at most; else the most that held together.

    Depth first over containers: the largest text left opens one, its fillings are tried in turn, least waste first; a
    container whose followers fail is undone. All containers together may waste no more than target times capacity leaves.
    """
    counts = dict(sizes)
    slack = target * capacity - sum(v * n for v, n in counts.items())
    if slack < 0:
        return [], False
    most: list[list[int]] = []
    levels: list[tuple[list[int], list[tuple[int, list[int]]], int]] = []  # values, fillings not tried yet, slack
    bins: list[list[int]] = []
    values = sorted(counts)
    while values:
        largest = values[-1]
        counts[largest] -= 1
        levels.append((values, completions(values, counts, capacity - largest, slack, budget)[::-1], slack))
        counts[largest] += 1
        if not levels[-1][1] and len(bins) > len(most):
            most = list(bins)
        while levels and not levels[-1][1]:
            levels.pop()
            if bins and len(bins) > len(levels) - 1 and levels:
                budget.undone += 1
                for v in bins.pop():
                    counts[v] += 1
        if not levels or budget.left <= 0:
            return (most if len(most) > len(bins) else list(bins)), False
        values, fillings, slack = levels[-1]
        waste, chosen = fillings.pop()
        bins.append([values[-1], *chosen])
        for v in bins[-1]:
            counts[v] -= 1
        slack -= waste
        values = [v for v in values if counts[v]]
    return bins, True


def repaired(sizes: Counter, bins: list[list[int]], capacity: int, target: int, budget: Budget) -> list[list[int]] | None:
    """All sizes in target containers, from a search that ended with some left: containers are undone and searched again
    together with what is left, other ones each time, more as it goes on; None if that never succeeds."""
    rng = random.Random(len(sizes) * 31 + target)
    for round_ in range(ROUNDS):
        if budget.left <= 0:
            return None
        undone = set(rng.sample(range(len(bins)), min(len(bins), 8 + round_ % 12)))
        budget.undone += len(undone)
        kept = [b for k, b in enumerate(bins) if k not in undone]
        rest = sizes - Counter(v for b in kept for v in b)
        part = Budget(min(budget.left, ALL_NODES // ROUNDS))
        before = part.left
        found, whole = complete(rest, capacity, target - len(kept), part)
        budget.left -= before - part.left
        if whole:
            return kept + found
        if len(found) + len(kept) > len(bins):
            bins = kept + found
    return None


def pack(sizes: list[int], capacity: int, nodes: int = ALL_NODES, budget: Budget | None = None) -> list[list[int]]:
    """Containers of indices; sizes are 1 to capacity. Best-fit decreasing is the first incumbent; bin completion is asked for
    the least number of containers there can be, then for numbers between that and the incumbent's."""
    best = best_fit(sizes, capacity)
    least, counts = least_containers(sizes, capacity), Counter(sizes)
    target = least
    while least < len(best):
        tried = budget or Budget(nodes)
        found, whole = complete(counts, capacity, target, Budget(min(tried.left, nodes // 2)) if budget is None else tried)
        if not whole:
            found = repaired(counts, found, capacity, target, tried)
        if found is None:
            least = target + 1
        else:
            where: dict[int, list[int]] = {}
            for i in range(len(sizes) - 1, -1, -1):
                where.setdefault(sizes[i], []).append(i)
            best = [[where[v].pop() for v in b] for b in found]
        target = (least + len(best)) // 2
    return best


SCHEMA = "budget_name string, capacity_tokens int, doc_id bigint, piece int, token_start bigint, token_end bigint, tokens bigint, grp bigint, container string, used bigint"


def _packer(tag: str):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("token_start", "ascending")])
        sizes = table.column("tokens").to_pylist()
        container, used, group = [""] * len(sizes), [0] * len(sizes), table.column("grp")[0].as_py()
        for b, items in enumerate(pack(sizes, table.column("capacity_tokens")[0].as_py())):
            total = sum(sizes[i] for i in items)
            for i in items:
                container[i], used[i] = f"{tag}{group}-{b}", total
        for name, values, kind in (("container", container, pa.string()), ("used", used, pa.int64())):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values, kind))
        return table

    return run


def packed(docs: DataFrame, budgets: DataFrame, *, path: str | None = None, group: int = GROUP) -> DataFrame:
    """(budget_name, capacity_tokens, doc_id, piece, token_start, token_end, tokens, container)."""
    sizes = stored(token_counts(docs, path=path), "token-counts")
    capacities = budgets.where("capacity_tokens > 0").groupBy("budget_name").agg(F.min("capacity_tokens").alias("c")).orderBy("budget_name").limit(MOST_BUDGETS + 1).collect()
    if len(capacities) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    names = [F.struct(F.lit(r["budget_name"]).cast("string").alias("budget_name"), F.lit(r["c"]).cast("int").alias("capacity_tokens")) for r in capacities]
    each = sizes.select("*", F.explode(F.array(*names))).select("doc_id", "tokens", "col.*") if names else sizes.selectExpr("doc_id", "tokens", "'' as budget_name", "1 as capacity_tokens").limit(0)
    cut = F.expr("transform(sequence(0, cast((tokens - 1) div capacity_tokens as int)), k -> k)")
    items = (
        each.where("tokens > 0")
        .withColumn("piece", F.explode(cut))
        .withColumn("token_start", F.col("piece").cast("bigint") * F.col("capacity_tokens"))
        .withColumn("token_end", F.least(F.col("token_start") + F.col("capacity_tokens"), F.col("tokens")))
        .withColumn("tokens", F.col("token_end") - F.col("token_start"))
    )
    groups = pieces(sizes.count(), group)
    cols = [c.split()[0] for c in SCHEMA.split(", ")]
    first = (
        items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
        .withColumn("container", F.lit("")).withColumn("used", F.lit(0).cast("bigint"))
        .select(*cols)
        .groupBy("budget_name", "grp")
        .applyInArrow(_packer("a"), SCHEMA)
    )
    first = stored(first, "packed")
    final = F.col("used") >= F.col("capacity_tokens") * F.lit(FULL_ENOUGH)
    rest = first.where(~final)
    regroups = pieces(rest.count(), 4 * group)
    second = (
        rest.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(regroups)))
        .groupBy("budget_name", "grp")
        .applyInArrow(_packer("b"), SCHEMA)
    )
    out = ["budget_name", "capacity_tokens", "doc_id", "piece", "token_start", "token_end", "tokens", "container"]
    none = each.where("tokens <= 0 or tokens is null").select(
        "budget_name", "capacity_tokens", "doc_id", F.lit(0).alias("piece"),
        F.lit(0).cast("bigint").alias("token_start"), F.lit(0).cast("bigint").alias("token_end"),
        F.lit(0).cast("bigint").alias("tokens"), F.lit(None).cast("string").alias("container"),
    )
    return first.where(final).select(out).unionByName(second.select(out)).unionByName(none)


def fill_report(placed: DataFrame) -> DataFrame:
    """Containers and share of room used by budget."""
    return (
        placed.where("container is not null")
        .groupBy("budget_name", "capacity_tokens")
        .agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
        .withColumn("filled", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
    )
