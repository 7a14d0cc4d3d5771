"""Itemsets level by level, and rules of sets of any size."""

import random
from itertools import combinations

import pytest

from custspark.operators import basket, itemsets


def brute_itemsets(baskets, support):
    sets = {}
    for b in baskets:
        items = sorted({x for x in b or [] if x is not None})
        for k in range(1, len(items) + 1):
            for c in combinations(items, k):
                sets[c] = sets.get(c, 0) + 1
    return {c: n for c, n in sets.items() if n / len(baskets) >= support}


@pytest.fixture(scope="module")
def baskets():
    """Every basket holds the hot item; some are empty or null, hold nulls or repeats."""
    rng = random.Random(3)
    out = [["hot", *(f"i{int(rng.paretovariate(0.7)) % 30}" for _ in range(rng.randint(0, 7)))] for _ in range(600)]
    return out + [[], None, [None, "i1", "i1"], ["i1", "i2", "i3", "i4", "i5", "hot"]] * 5


@pytest.mark.parametrize("support,small", [(0.03, False), (0.01, True), (1.0, False), (0.0, False)])
def test_bitmap_itemsets(spark, baskets, monkeypatch, support, small):
    if small:  # few buckets, so pairs collide; many blocks and chunks
        monkeypatch.setattr(itemsets, "BUCKETS", 16)
        monkeypatch.setattr(itemsets, "BLOCK_BYTES", 1)
        monkeypatch.setattr(itemsets, "CHUNK", 7)
        monkeypatch.setattr(itemsets, "_PAIRS", 5)
    rows = baskets if support else [b[:4] if b else b for b in baskets]
    df = spark.createDataFrame([(b,) for b in rows], "items array<string>").repartition(3)
    got = itemsets.frequent_itemsets(df, support).collect()
    want = brute_itemsets(rows, support)
    assert {tuple(r["items"]): r["freq"] for r in got} == want and len(got) == len(want)
    assert all(abs(r["support"] - r["freq"] / len(rows)) < 1e-12 for r in got)


def test_bitmap_itemsets_equal_fp_growth(spark, baskets):
    df = spark.createDataFrame([(sorted({x for x in b or [] if x}),) for b in baskets], "items array<string>")
    rows = lambda d: sorted((tuple(r["items"]), r["freq"]) for r in d.collect())
    assert rows(itemsets.frequent_itemsets(df, 0.02)) == rows(basket.frequent_itemsets(df, 0.02))
    assert {len(i) for i, _ in rows(itemsets.frequent_itemsets(df, 0.02, max_size=2))} == {1, 2}


def test_itemsets_of_nothing(spark):
    none = spark.createDataFrame([], "items array<string>")
    assert itemsets.frequent_itemsets(none, 0.1).count() == 0
    blank = spark.createDataFrame([(None,), ([],)], "items array<string>")
    assert itemsets.frequent_itemsets(blank, 0.1).count() == 0


def test_a_hot_item_is_spread_over_the_blocks(spark):
    """No task holds an item's baskets: its bitmap lies in every block."""
    df = spark.range(1000).selectExpr("array(1, 2) as ids").repartition(4)
    blocks = itemsets.bitmap_blocks(df, n_items=8 * itemsets.BLOCK_BYTES // 100).collect()
    assert len(blocks) >= 10 and all(list(b["items"]) == [1, 2] for b in blocks)


def _table(spark, support):
    rows = [(list(c), s) for c, s in support.items()]
    return spark.createDataFrame(rows, "items array<string>, support double")


def test_rules_of_forty_items(spark):
    """A set of 40 items, of which only single items are frequent enough as consequents."""
    z = [f"i{k:02}" for k in range(40)]
    support = {tuple(z): 0.1}
    for k in range(40):
        support[tuple(x for x in z if x != z[k])] = 0.1 if k < 3 else 0.9
        support[z[k],] = 0.95
    for a, b in combinations(range(3), 2):
        support[tuple(x for i, x in enumerate(z) if i not in (a, b))] = 0.11 if (a, b) == (0, 1) else 0.5
    rules = basket.association_rules(_table(spark, support | {(z[0], z[1]): 0.5}), 0.8).collect()
    got = {(len(r["antecedents"]), tuple(r["consequents"])) for r in rules}
    assert got == {(39, (z[0],)), (39, (z[1],)), (39, (z[2],)), (38, (z[0], z[1])), (38, (z[0],)), (38, (z[1],))}


def test_grown_rules_equal_masked_rules(spark, baskets, monkeypatch):
    df = spark.createDataFrame([(sorted({x for x in b or [] if x}),) for b in baskets], "items array<string>")
    its = basket.frequent_itemsets(df, 0.01).cache()
    assert its.selectExpr("max(size(items))").first()[0] >= 4
    for confidence in (0.0, 0.6):
        rows = lambda: sorted((tuple(r["antecedents"]), tuple(r["consequents"]), round(r["lift"], 9), round(r["zhangs_metric"], 9))
                              for r in basket.association_rules(its, confidence).collect())
        masked = rows()
        monkeypatch.setattr(basket, "MASK_ITEMS", 2)
        assert rows() == masked and masked
        monkeypatch.undo()


def test_brand_orders_take_tasks_by_their_lines(spark, monkeypatch):
    """Many lines are joined and counted by more tasks than the session's width, with the same rows."""
    from custspark.sources import adapters
    from custspark.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    want = sorted(adapters.brand_orders(t).collect())
    monkeypatch.setattr(adapters, "TASK_LINES", 500)
    got = adapters.brand_orders(t)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [o_custkey" in plan and f", {-(-t.lineitem.count() // 500)}" in plan
    assert sorted(got.collect()) == want
