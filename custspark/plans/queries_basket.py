"""Registered queries: market baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import items_text
from ..operators import basket, itemsets
from ..sources import adapters
from .catalog import query, round_doubles

# item = part type (6 items): thresholds that give rules on this data
TYPE_SUPPORT, TYPE_CONFIDENCE, TYPE_LIFT = 0.05, 0.4, 0.9
# item = brand (25 items) at the original default thresholds: no rule passes
DEFAULT_SUPPORT, DEFAULT_CONFIDENCE, DEFAULT_LIFT = 0.05, 0.4, 1.3

_BASKETS_SQL = """b as (select Order_ID, list_sort(list_distinct(list(Department_Name))) as items
      from {src} where Department_Name is not null group by 1)"""

_ITEMSETS_SQL = """
n as (select count(*) as n from b),
sub as (select Order_ID, items, unnest(range(1, (1 << len(items)))) as m from b),
its as (select list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) as items, count(*) as freq
        from sub group by 1),
freq as (select items, freq, freq / (select n from n) as support from its
         where freq / (select n from n) >= {sup})"""

_RULES_SQL = """
z as (select items, support as sAC, unnest(range(1, (1 << len(items)) - 1)) as m from freq where len(items) >= 2),
r as (select list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) as a,
             list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0) as c, sAC from z),
rules as (select r.a, r.c, fa.support as sA, fc.support as sC, r.sAC from r
          join freq fa on fa.items = r.a join freq fc on fc.items = r.c),
m as (select array_to_string(a, ', ') as antecedents, array_to_string(c, ', ') as consequents,
        sA as antecedent_support, sC as consequent_support, sAC as support, sAC / sA as confidence,
        sAC / sA / sC as lift, cast(1.0 as double) as representativity, sAC - sA * sC as leverage,
        case when sAC / sA >= 1 then 'inf'::double else (1 - sC) / (1 - sAC / sA) end as conviction,
        case when greatest(sAC * (1 - sA), sA * (sC - sAC)) = 0 then 0.0
             else (sAC - sA * sC) / greatest(sAC * (1 - sA), sA * (sC - sAC)) end as zhangs_metric,
        sAC / (sA + sC - sAC) as jaccard,
        case when sC >= 1 then 0.0 else (sAC / sA - sC) / (1 - sC) end as certainty,
        0.5 * (sAC / sA + sAC / sC) as kulczynski
      from rules)"""

_RULE_DOUBLES = ["antecedent_support", "consequent_support", "support", "confidence", "lift",
                 "representativity", "leverage", "conviction", "zhangs_metric", "jaccard", "certainty",
                 "kulczynski"]


def _r(cols):
    return ", ".join(f"round({c}, 9) as {c}" for c in cols)


def _type_rules(t):
    rules, its, b = basket.mine_rules(adapters.basket_lines(t), TYPE_SUPPORT, TYPE_CONFIDENCE, TYPE_LIFT)
    return rules, its, b


@query("baskets", sql="with " + _BASKETS_SQL.format(src="a_basket_lines") +
       " select Order_ID, array_to_string(items, ', ') as items, cast(len(items) as integer) as n_items from b")
def baskets(t):
    """B1: one sorted item list per order (part types)."""
    b = basket.baskets(adapters.basket_lines(t))
    return b.select("Order_ID", items_text("items").alias("items"), F.size("items").alias("n_items"))


@query("frequent_itemsets", sql="with " + _BASKETS_SQL.format(src="a_basket_lines") + "," +
       _ITEMSETS_SQL.format(sup=TYPE_SUPPORT) +
       " select array_to_string(items, ', ') as items, freq, round(support, 9) as support from freq")
def frequent_itemsets(t):
    """B2: itemsets of part types with support >= 0.05 (FP-growth)."""
    its = basket.frequent_itemsets(basket.baskets(adapters.basket_lines(t)), TYPE_SUPPORT)
    return round_doubles(its.select(items_text("items").alias("items"), "freq", "support"), 9)


@query("association_rules", sql="with " + _BASKETS_SQL.format(src="a_basket_lines") + "," +
       _ITEMSETS_SQL.format(sup=TYPE_SUPPORT) + "," + _RULES_SQL +
       f" select antecedents, consequents, {_r(_RULE_DOUBLES)} from m"
       f" where confidence >= {TYPE_CONFIDENCE} and lift >= {TYPE_LIFT}")
def association_rules(t):
    """All rules (multi-item consequents too) with every measure."""
    rules, _, _ = _type_rules(t)
    return round_doubles(basket.rules_as_text(rules).drop("rule"), 9)


@query("rules_default_thresholds", sql="with " + _BASKETS_SQL.format(
    src="(select op.Order_ID, d.Department_Name from a_order_products op join a_products p on op.Product_ID = p.Product_ID "
        "join a_departments d on p.Department_ID = d.Department_ID)") + "," +
       _ITEMSETS_SQL.format(sup=DEFAULT_SUPPORT) + "," + _RULES_SQL +
       f" select antecedents, consequents, {_r(_RULE_DOUBLES)} from m"
       f" where confidence >= {DEFAULT_CONFIDENCE} and lift >= {DEFAULT_LIFT}")
def rules_default_thresholds(t):
    """B5 at the default thresholds on brand baskets: an empty, fully typed result."""
    lines = (adapters.order_items(t).join(adapters.products(t), "Product_ID")
             .join(adapters.departments(t), "Department_ID").select("Order_ID", "Department_Name"))
    rules, _, _ = basket.mine_rules(lines, DEFAULT_SUPPORT, DEFAULT_CONFIDENCE, DEFAULT_LIFT)
    return round_doubles(basket.rules_as_text(rules).drop("rule"), 9)


@query("top_rules", sql="with " + _BASKETS_SQL.format(src="a_basket_lines") + "," +
       _ITEMSETS_SQL.format(sup=TYPE_SUPPORT) + "," + _RULES_SQL +
       " select antecedents, consequents, round(support, 9) as support, round(confidence, 9) as confidence,"
       " round(lift, 9) as lift from m"
       f" where confidence >= {TYPE_CONFIDENCE} and lift >= {TYPE_LIFT}"
       " order by lift desc, confidence desc, antecedents, consequents limit 10")
def top_rules(t):
    """The ten strongest rules (cross-sell list)."""
    rules, _, _ = _type_rules(t)
    top = basket.top_rules(rules, 10)
    return round_doubles(basket.rules_as_text(top).select("antecedents", "consequents", "support",
                                                          "confidence", "lift"), 9)


_TOP10 = (" top as (select a, c, sAC / sA / sC as lift, sAC / sA as confidence from rules"
          f" where sAC / sA >= {TYPE_CONFIDENCE} and sAC / sA / sC >= {TYPE_LIFT}"
          " order by lift desc, confidence desc, array_to_string(a, ', '), array_to_string(c, ', ') limit 10),"
          " edges as (select src, dst, min(lift) as weight from"
          " (select unnest(a) as src, c, lift from top), (select 1) x, lateral (select unnest(c) as dst) group by 1, 2)")


@query("rule_network", sql="with " + _BASKETS_SQL.format(src="a_basket_lines") + "," +
       _ITEMSETS_SQL.format(sup=TYPE_SUPPORT) + "," + _RULES_SQL + "," + _TOP10 +
       " select src, dst, round(weight, 9) as weight from edges")
def rule_network(t):
    """Item-to-item edges of the ten strongest rules."""
    rules, _, _ = _type_rules(t)
    edges, _ = basket.rule_network(rules, 10)
    return round_doubles(edges, 9)


@query("rule_node_weights", sql="with " + _BASKETS_SQL.format(src="a_basket_lines") + "," +
       _ITEMSETS_SQL.format(sup=TYPE_SUPPORT) + "," + _RULES_SQL + "," + _TOP10 +
       ", nodes as (select src as node from edges union select dst from edges)"
       " select n.node, round(coalesce(sum(e.weight), 0.0), 9) as in_weight from nodes n"
       " left join edges e on e.dst = n.node group by n.node")
def rule_node_weights(t):
    """Summed incoming lift per item node."""
    rules, _, _ = _type_rules(t)
    _, nodes = basket.rule_network(rules, 10)
    return round_doubles(nodes, 9)


@query("rule_summary", sql="with " + _BASKETS_SQL.format(src="a_basket_lines") + "," +
       _ITEMSETS_SQL.format(sup=TYPE_SUPPORT) + "," + _RULES_SQL +
       " select count(*) as rules, " + ", ".join(
           f"round(min({c}), 9) as min_{c}, round(max({c}), 9) as max_{c}, round(avg({c}), 9) as mean_{c}"
           for c in ("support", "confidence", "lift")) +
       f" from m where confidence >= {TYPE_CONFIDENCE} and lift >= {TYPE_LIFT}")
def rule_summary(t):
    """How many rules and the ranges of their measures."""
    rules, _, _ = _type_rules(t)
    return round_doubles(basket.rule_summary(rules), 9)


@query("reordered_baskets", sql="""
with b as (select op.Order_ID, list_sort(list_distinct(list(case when op.Was_Product_Reordered > 0 then d.Department_Name end)
             filter (where op.Was_Product_Reordered > 0))) as items
           from a_order_products op join a_products p on op.Product_ID = p.Product_ID
           join a_departments d on p.Department_ID = d.Department_ID group by 1),""" +
       _ITEMSETS_SQL.replace("unnest(range(1, (1 << len(items))))", "unnest(range(1, (1 << coalesce(len(items), 0))))")
       .format(sup=0.01) +
       " select array_to_string(items, ', ') as items, freq, round(support, 9) as support from freq")
def reordered_baskets(t):
    """Itemsets of re-ordered brands; orders without re-orders stay in N."""
    lines = adapters.brand_orders(t)
    b = basket.flagged_baskets(lines, "Order_ID", "Department_Name", "Was_Product_Reordered")
    its = basket.frequent_itemsets(b, 0.01)
    return round_doubles(its.select(items_text("items").alias("items"), "freq", "support"), 9)


@query("reorder_rate", sql="""
select d.Department_Name, round(avg(op.Was_Product_Reordered), 9) as reorder_rate, count(*) as lines
from a_order_products op join a_products p on op.Product_ID = p.Product_ID
join a_departments d on p.Department_ID = d.Department_ID group by 1""")
def reorder_rate(t):
    """Share of re-ordered lines per department."""
    return round_doubles(basket.reorder_rate_of(adapters.brand_purchases(t), "Department_Name"), 9)


@query("reorder_rate_by_customer", sql="""
select o.Customer_ID, round(avg(op.Was_Product_Reordered), 9) as reorder_rate, count(*) as lines
from a_order_products op join a_orders o on op.Order_ID = o.Order_ID group by 1""")
def reorder_rate_by_customer(t):
    """Share of re-ordered lines per customer."""
    return round_doubles(basket.reorder_rate_of(adapters.brand_purchases(t), "Customer_ID"), 9)


@query("frequent_itemsets_bitmap", sql="with " + _BASKETS_SQL.format(src="a_basket_lines") + "," +
       _ITEMSETS_SQL.format(sup=TYPE_SUPPORT) +
       " select array_to_string(items, ', ') as items, freq, round(support, 9) as support from freq")
def frequent_itemsets_bitmap(t):
    """B2: the same itemsets of part types, level by level from pair buckets and bitmaps."""
    its = itemsets.frequent_itemsets(basket.baskets(adapters.basket_lines(t)), TYPE_SUPPORT)
    return round_doubles(its.select(items_text("items").alias("items"), "freq", "support"), 9)


#: Re-ordered products: too many for a support of 1 %, so one order in ten thousand counts.
PRODUCT_SUPPORT, PRODUCT_LIFT = 0.0001, 1.0


@query("reordered_product_rules", sql="""
with b as (select Order_ID, coalesce(list_sort(list_distinct(list(cast(Product_ID as varchar)) filter (where Was_Product_Reordered > 0))), []) as items
           from a_order_products group by 1),""" + _ITEMSETS_SQL.format(sup=PRODUCT_SUPPORT) + "," + _RULES_SQL +
       " select antecedents, consequents, round(support, 9) as support, round(confidence, 9) as confidence,"
       f" round(lift, 9) as lift from m where lift >= {PRODUCT_LIFT}"
       " order by lift desc, confidence desc, antecedents, consequents limit 10")
def reordered_product_rules(t):
    """The ten rules of the largest lift between products that were re-ordered in one order."""
    b = basket.flagged_baskets(adapters.order_products(t), "Order_ID", "Product_ID", "Was_Product_Reordered")
    rules = basket.association_rules(itemsets.frequent_itemsets(b, PRODUCT_SUPPORT)).where(F.col("lift") >= PRODUCT_LIFT)
    top = basket.rules_as_text(basket.top_rules(rules, 10))
    return round_doubles(top.select("antecedents", "consequents", "support", "confidence", "lift"), 9)
