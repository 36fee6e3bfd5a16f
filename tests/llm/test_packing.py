import random
from collections import Counter

from codelode.llm.packing import Budget, best_fit, complete, completions, dominated, fill_report, least_containers, pack, packed


def test_completions_are_undominated_and_within_the_waste_allowed():
    values, counts = [3, 5, 8, 13], {3: 2, 5: 1, 8: 1, 13: 1}
    budget = Budget(1000)
    assert completions(values, counts, 11, 11, budget) == [(0, [8, 3])]  # 5 + 3 + 3 is dominated: 8 could stand for 5 + 3
    assert counts == {3: 2, 5: 1, 8: 1, 13: 1}


def test_dominance():
    assert dominated([4], 2, [4, 5], {4: 0, 5: 1})  # 5 could stand for 4
    assert dominated([3, 2], 0, [2, 3, 5], {2: 0, 3: 0, 5: 1})  # 5 could stand for both
    assert not dominated([4], 2, [4, 7], {4: 0, 7: 1}) and not dominated([4], 2, [4, 5], {4: 0, 5: 0})


def test_pruning_is_counted():
    budget = Budget(10_000)
    completions([10, 20, 30, 40, 50], {10: 1, 20: 1, 30: 1, 40: 1, 50: 1}, 90, 0, budget)
    assert budget.bounded > 0 and budget.dominated > 0 and budget.left > 9_000


def test_least_containers():
    assert least_containers([6, 6, 6], 10) == 3 and least_containers([5, 5, 5, 5], 10) == 2 and least_containers([7, 4, 4], 10) == 2 and least_containers([], 10) == 0
    rng = random.Random(4)
    for _ in range(50):
        sizes = [rng.randrange(1, 20) for _ in range(9)]
        assert -(-sum(sizes) // 20) <= least_containers(sizes, 20) <= len(pack(sizes, 20))


def test_containers_are_undone():
    rng = random.Random(11)
    solved = 0
    for _ in range(30):
        sizes = []
        for _ in range(6):
            a = rng.randrange(1, 30)
            sizes += [a, 40 - a - (b := rng.randrange(1, 40 - a)), b]
        budget = Budget(200_000)
        bins, whole = complete(Counter(sizes), 40, 6, budget)
        solved += whole
        assert not whole or sorted(v for b in bins for v in b) == sorted(sizes)
    assert solved == 30


def test_triples_that_fill_every_container():
    rng, sizes = random.Random(0), []
    for _ in range(400):
        a = rng.randrange(100, 500)
        b = rng.randrange(100, min(500, 901 - a))
        sizes += [a, b, 1000 - a - b]
    rng.shuffle(sizes)
    assert len(best_fit(sizes, 1000)) > 400 and len(pack(sizes, 1000)) == 400


def test_never_worse_than_best_fit_and_never_over_capacity():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.choice([50, 97, 512])
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 80))]
        bins = pack(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert len(bins) <= len(best_fit(sizes, capacity))


def test_beats_best_fit_where_it_can():
    # best fit decreasing needs three: 6 + 3, 5 + 4, then 2 and 2 have no room together with them
    sizes, capacity = [6, 5, 4, 3, 2, 2], 11
    assert len(pack(sizes, capacity)) == 2


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' as container", "0 as piece", "1 as grp", "2 as used")


def test_texts_are_divided_only_if_they_exceed_the_capacity(spark):
    word = " apple"
    rows = [(1, word * 300), (2, word * 40), (3, None), (4, ""), (5, word * 64), (5, word * 64), (2**60 + 1, word)]
    budgets = spark.createDataFrame([("a", 64), ("a", 64), ("b", 1000), ("bad", None), ("zero", 0)], "budget_name string, capacity_tokens int")
    out = packed(_docs(spark, rows), budgets).collect()
    for name, capacity in (("a", 64), ("b", 1000)):
        mine = [r for r in out if r["budget_name"] == name]
        load = {}
        for r in mine:
            if r["container"] is not None:
                load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
        assert max(load.values()) <= capacity
        assert sum(r["tokens"] for r in mine if r["doc_id"] == 1) == 300
        assert all(len([r for r in mine if r["doc_id"] == d]) == n for d, n in ((2, 1), (3, 1), (4, 1), (5, 2), (2**60 + 1, 1)))
        assert {r["container"] for r in mine if r["doc_id"] in (3, 4)} == {None}
    assert {r["budget_name"] for r in out} == {"a", "b"}
    report = {r["budget_name"]: r["filled"] for r in fill_report(packed(_docs(spark, rows), budgets)).collect()}
    assert 0 < report["a"] <= 1


def test_empty_tables(spark):
    none = _docs(spark, [(1, "x")]).limit(0)
    budgets = spark.createDataFrame([("a", 64)], "budget_name string, capacity_tokens int")
    assert packed(none, budgets).count() == 0
    assert packed(_docs(spark, [(1, "x")]), budgets.limit(0)).count() == 0


def test_groups_are_packed_again_across_each_other(spark):
    rows = [(k, " apple" * (k % 30 + 1)) for k in range(400)]
    budgets = spark.createDataFrame([("a", 64)], "budget_name string, capacity_tokens int")
    one = packed(_docs(spark, rows), budgets, group=50)
    assert one.count() == 400
    assert fill_report(one).first()["filled"] > 0.95
