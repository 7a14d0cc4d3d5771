"""Market baskets: baskets, frequent itemsets, association rules.

Baskets are sorted string arrays (one row per order), never a pivoted
order x item matrix.  Frequent itemsets come from Spark ML's parallel
FP-growth, or level by level from :mod:`.itemsets`.  Spark's own ``associationRules`` only emits one-item
consequents, so rules with every antecedent / consequent split are built
here: each small itemset explodes into its proper non-empty subsets
(bit masks), a large one grows its consequents item by item as far as the confidence allows, and two equi-joins on the sorted item arrays fetch the
supports of both sides.  The number of rules is bounded by the frequent
itemsets, not by the order lines.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import items_text
from ..session import cut_lineage

RULE_COLUMNS = ["antecedents", "consequents", "antecedent_support", "consequent_support", "support",
                "confidence", "lift", "representativity", "leverage", "conviction", "zhangs_metric",
                "jaccard", "certainty", "kulczynski"]


def baskets(lines: DataFrame, order_col: str = "Order_ID", item_col: str = "Department_Name",
            out: str = "items") -> DataFrame:
    """B1: one sorted, duplicate-free item array per order.  Null items are
    dropped first, so orders holding only nulls vanish (as a pandas
    group-by would).  ``collect_set`` merges map-side and is bounded by the
    item vocabulary of one order."""
    return (lines.where(F.col(item_col).isNotNull())
            .groupBy(order_col).agg(F.array_sort(F.collect_set(F.col(item_col).cast("string"))).alias(out)))


def flagged_baskets(lines: DataFrame, order_col: str, item_col: str, flag_col: str,
                    out: str = "items") -> DataFrame:
    """Per order the items whose flag is set (e.g. re-ordered).  Orders
    without any flagged item stay, with an empty basket, because they still
    count in the support denominator."""
    item = F.when(F.col(flag_col) > 0, F.col(item_col).cast("string"))
    return lines.groupBy(order_col).agg(F.array_sort(F.collect_set(item)).alias(out))


def frequent_itemsets(basket_df: DataFrame, min_support: float, items_col: str = "items",
                      num_partitions: int | None = None) -> DataFrame:
    """B2: ``(items, freq, support)`` with ``support >= min_support`` where
    support = freq / number of baskets (empty baskets included).  FP-growth
    runs with a hair lower threshold and the exact ratio test is applied
    after, so a float rounding in ``ceil(minSupport * n)`` cannot drop an
    itemset that sits exactly on the threshold."""
    # the baskets feed FP-growth and the basket count; checkpointed once so
    # the order-line joins behind them run a single time
    basket_df = cut_lineage(basket_df.select(items_col))
    fp = FPGrowth(itemsCol=items_col, minSupport=max(min_support - 1e-9, 0.0), minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(basket_df)
    n = basket_df.agg(F.count(F.lit(1))).scalar()
    # the mined itemsets are an RDD that would be mined again on every use;
    # they are few, so they are checkpointed once to the shared folder
    its = cut_lineage(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq")))
    return its.withColumn("support", F.col("freq") / n).where(F.col("support") >= F.lit(min_support))


#: Larger itemsets take their rules level by level, as 2**n masks grow too many.
MASK_ITEMS = 12


def _split(items: Column, mask: Column, keep: int) -> Column:
    # bit i of the mask says whether item i goes to the antecedent side
    def bit(x, i):
        return (mask.bitwiseAND(F.pow(F.lit(2), i).cast("int")) != 0) == F.lit(keep == 1)
    return F.filter(items, bit)


def _masked_rules(sets: DataFrame) -> DataFrame:
    """``(antecedents, consequents, sAC)``: every split of the sets, from bit masks."""
    z = sets.select("items", F.col("support").alias("sAC"),
                    F.explode(F.sequence(F.lit(1), F.pow(F.lit(2), F.size("items")).cast("int") - F.lit(2))).alias("mask"))
    return z.select(_split(F.col("items"), F.col("mask"), 1).alias("antecedents"),
                    _split(F.col("items"), F.col("mask"), 0).alias("consequents"), "sAC")


def _grown_rules(sets: DataFrame, support: DataFrame, min_confidence: float, largest: int) -> DataFrame | None:
    """The splits of the sets that reach ``min_confidence``.  Consequents grow by one item at a time, each by items behind its last:
    moving an item from the antecedent to the consequent never raises the confidence, so a consequent that fails is
    not grown."""
    antecedent = support.withColumnsRenamed({"items": "antecedents", "support": "sA"})
    grown = sets.select("items", F.col("support").alias("sAC"), F.array().cast("array<string>").alias("consequents"))
    out = None
    for _ in range(largest - 1):
        behind = F.filter("items", lambda x: F.coalesce(x > F.try_element_at(F.col("consequents"), F.lit(-1)), F.lit(True)))
        longer = grown.select("items", "sAC", "consequents", F.explode(behind).alias("_x"))
        longer = longer.select("items", "sAC", F.array_append("consequents", F.col("_x")).alias("consequents"))
        longer = longer.where(F.size("consequents") < F.size("items")).withColumn("antecedents", F.array_except("items", "consequents"))
        grown = cut_lineage(longer.join(antecedent, "antecedents").where(F.col("sAC") / F.col("sA") >= F.lit(min_confidence)).drop("sA"))
        if grown.isEmpty():
            break
        part = grown.select("antecedents", "consequents", "sAC")
        out = part if out is None else out.unionByName(part)
    return out


def association_rules(itemsets: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Every rule A -> C with A, C non-empty, disjoint, A u C frequent,
    with the standard rule measures (conviction is +inf at confidence 1;
    zhang and certainty are 0 where their denominators vanish).  Itemsets are sorted arrays, and with a set its subsets are there
    (a rule whose antecedent or consequent is missing is left out)."""
    sup = itemsets.select("items", "support")
    largest = itemsets.agg(F.max(F.size("items"))).first()[0] or 0
    z = _masked_rules(itemsets.where((F.size("items") >= 2) & (F.size("items") <= MASK_ITEMS)))
    if largest > MASK_ITEMS:
        grown = _grown_rules(itemsets.where(F.size("items") > MASK_ITEMS), sup, min_confidence, largest)
        z = z if grown is None else z.unionByName(grown)
    r = (z.join(sup.withColumnsRenamed({"items": "antecedents", "support": "sA"}), "antecedents")
         .join(sup.withColumnsRenamed({"items": "consequents", "support": "sC"}), "consequents"))
    sA, sC, sAC = F.col("sA"), F.col("sC"), F.col("sAC")
    conf = sAC / sA
    lev = sAC - sA * sC
    zden = F.greatest(sAC * (F.lit(1.0) - sA), sA * (sC - sAC))
    rules = r.select(
        "antecedents", "consequents", sA.alias("antecedent_support"), sC.alias("consequent_support"),
        sAC.alias("support"), conf.alias("confidence"), (conf / sC).alias("lift"),
        F.lit(1.0).alias("representativity"), lev.alias("leverage"),
        F.when(conf >= 1.0, F.lit(float("inf"))).otherwise((F.lit(1.0) - sC) / (F.lit(1.0) - conf))
        .alias("conviction"),
        F.when(zden == 0, F.lit(0.0)).otherwise(lev / zden).alias("zhangs_metric"),
        (sAC / (sA + sC - sAC)).alias("jaccard"),
        F.when(sC >= 1.0, F.lit(0.0)).otherwise((conf - sC) / (F.lit(1.0) - sC)).alias("certainty"),
        (F.lit(0.5) * (sAC / sA + sAC / sC)).alias("kulczynski"))
    return rules.where(F.col("confidence") >= F.lit(min_confidence))


def mine_rules(lines: DataFrame, min_support: float = 0.05, min_confidence: float = 0.4,
               min_lift: float = 1.3, order_col: str = "Order_ID", item_col: str = "Department_Name"):
    """Baskets -> itemsets -> rules with confidence and lift thresholds,
    lift-descending.  Returns ``(rules, itemsets, baskets)``; ``rules`` is
    an empty frame with the full schema when nothing passes."""
    b = baskets(lines, order_col, item_col)
    its = frequent_itemsets(b, min_support)
    rules = association_rules(its, min_confidence).where(F.col("lift") >= F.lit(min_lift))
    return rules.orderBy(F.desc("lift")), its, b


def rank_rules(rules: DataFrame) -> list[Column]:
    """T2 total order for rules: A -> C and C -> A share a lift, so ties are
    certain; confidence and the item texts break them."""
    return [F.desc("lift"), F.desc("confidence"), F.asc(items_text("antecedents")),
            F.asc(items_text("consequents"))]


def top_rules(rules: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` strongest rules (take-ordered, n rows per partition)."""
    return rules.orderBy(*rank_rules(rules)).limit(n)


def rules_as_text(rules: DataFrame) -> DataFrame:
    """item arrays as ``'a, b'`` texts and a ``'a -> b'`` label."""
    return rules.withColumns({"rule": F.concat_ws(" -> ", items_text("antecedents"), items_text("consequents")),
                              "antecedents": items_text("antecedents"),
                              "consequents": items_text("consequents")})


def rule_network(rules: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Edges antecedent item -> consequent item of the top ``n`` rules.
    Re-adding an edge overwrites its weight and rules arrive strongest
    first, so the weakest lift of a pair wins (``min``).  Node weights are
    the summed incoming lift; nodes without incoming edges get 0."""
    top = top_rules(rules, n)
    edges = (top.select(F.explode("antecedents").alias("src"), "consequents", "lift")
             .select("src", F.explode("consequents").alias("dst"), "lift")
             .groupBy("src", "dst").agg(F.min("lift").alias("weight")))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    incoming = edges.groupBy(F.col("dst").alias("node")).agg(F.sum("weight").alias("in_weight"))
    node_w = nodes.join(incoming, "node", "left").na.fill(0.0, ["in_weight"])
    return edges, node_w


def rule_summary(rules: DataFrame) -> DataFrame:
    """Count and ranges / means of support, confidence and lift."""
    aggs = [F.count(F.lit(1)).alias("rules")]
    for c in ("support", "confidence", "lift"):
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}")]
    return rules.agg(*aggs)


def reorder_rate(lines: DataFrame, by: str, flag: str = "Was_Product_Reordered") -> DataFrame:
    """Share of re-ordered lines per group (a null is no group)."""
    return lines.where(F.col(by).isNotNull()).groupBy(by).agg(F.avg(flag).alias("reorder_rate"), F.count(F.lit(1)).alias("lines"))


def reorder_rate_of(counts: DataFrame, by: str) -> DataFrame:
    """B9 from counts of ``lines`` and ``reorders``."""
    return (counts.where(F.col(by).isNotNull()).groupBy(by)
            .agg((F.sum("reorders") / F.sum("lines")).alias("reorder_rate"), F.sum("lines").alias("lines")))


def require_basket_columns(df: DataFrame, cols=("Order_ID", "Customer_ID", "Department_Name")) -> DataFrame:
    """The input rule of the basket page, plus ``Order_ID`` which the
    engine needs; rows with gaps in them are dropped."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df.na.drop(how="any", subset=list(cols))
