"""Registered queries: segments, features, metrics and models.

Two kinds:
* exact, with SQL twins: statistics on a fixed cluster assignment
  (``Customer_ID % 4``) and metrics of the closed-form churn / value
  scores, so every formula is checked without a learner in the loop;
* learner-backed (k-means, trees, search, contributions): no SQL twin,
  checked by row counts and unit tests.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import scalar as fx
from ..operators import drivers, features, metrics, models, prep, scoring, segments, whatif
from ..sources import adapters, io
from . import customer360 as c360
from .catalog import query, round_doubles


def _customers(t):
    return c360.segmentation_features(c360.customer_360_materialized(t))


def _fixed_segments(t):
    """Customers with a fixed 4-way assignment and greedy names, plus the
    eco label of the green source (class and score stand in for the
    green models' predictions)."""
    df = _customers(t).withColumn("KMeans_Segment", (F.col("Customer_ID") % 4).cast("int"))
    df = segments.label_segments(df)
    g = adapters.green(t).select("Customer_ID", fx.eco_label("Green_Purchase_Made", "Green_Consumption_Score")
                                 .alias("Eco_Segment"))
    return df.join(g, "Customer_ID", "left")


_C360_FEATS = """(select *, Total_Orders_This_Month * Total_Amount_Spent / 1000.0 as Purchase_Intensity,
  Days_Since_Last_Order as Recency, Total_Amount_Spent / (Total_Orders_This_Month + 1.0) as Avg_Spend_Per_Order,
  cast(Customer_ID % 4 as int) as KMeans_Segment from a_customer360)"""

_NAMES_SQL = f"""
st as (select KMeans_Segment, avg(Total_Amount_Spent) as spend, avg(Recency) as recency,
         avg(Total_Orders_This_Month) as orders from {_C360_FEATS} group by 1),
n1 as (select KMeans_Segment from st order by orders desc, KMeans_Segment limit 1),
r1 as (select * from st where KMeans_Segment not in (select KMeans_Segment from n1)),
n2 as (select KMeans_Segment from r1 order by recency desc, KMeans_Segment limit 1),
r2 as (select * from r1 where KMeans_Segment not in (select KMeans_Segment from n2)),
n3 as (select KMeans_Segment from r2 order by spend desc, KMeans_Segment limit 1),
names as (select KMeans_Segment, '{segments.TRAINING_NAMES[0]}' as Segment_Label from n1
  union all select KMeans_Segment, '{segments.TRAINING_NAMES[1]}' from n2
  union all select KMeans_Segment, '{segments.TRAINING_NAMES[2]}' from n3
  union all select KMeans_Segment, '{segments.TRAINING_NAMES[3]}' from r2
    where KMeans_Segment not in (select KMeans_Segment from n3)),
seg as (select c.*, names.Segment_Label, case when g.Green_Purchase_Made = 1 and round_even(g.Green_Consumption_Score, 2) >= 0.7 then 'Eco_Warrior'
          when g.Green_Purchase_Made = 1 and round_even(g.Green_Consumption_Score, 2) >= 0.4 then 'Eco_Conscious'
          else 'Low_Interest' end as Eco_Segment
        from {_C360_FEATS} c join names on c.KMeans_Segment = names.KMeans_Segment
        left join a_green g on c.Customer_ID = g.Customer_ID)"""


@query("cluster_names", sql="with " + _NAMES_SQL + " select * from names")
def cluster_names(t):
    """Greedy names for a fixed 4-way assignment."""
    df = _customers(t).withColumn("KMeans_Segment", (F.col("Customer_ID") % 4).cast("int"))
    return segments.name_clusters(segments.segment_stats(df))


@query("segment_stats", sql="with " + _NAMES_SQL + """
select Segment_Label, count(Customer_ID) as Count, round(avg(Total_Amount_Spent), 6) as Total_Amount_Spent,
  round(avg(Days_Since_Last_Order), 6) as Days_Since_Last_Order, round(avg(Satisfaction_Score), 6) as Satisfaction_Score,
  round(avg(Total_Orders_This_Month), 6) as Total_Orders_This_Month,
  round(count(*) * 100.0 / (select count(*) from seg), 6) as Share_Pct from seg group by 1""")
def segment_stats(t):
    """A10: segment sizes, shares and means."""
    return round_doubles(segments.segment_summary(_fixed_segments(t)), 6)


_XTAB_SQL = """xt as (select Segment_Label, count(*) filter (where Eco_Segment = 'Eco_Conscious') as Eco_Conscious,
  count(*) filter (where Eco_Segment = 'Eco_Warrior') as Eco_Warrior,
  count(*) filter (where Eco_Segment = 'Low_Interest') as Low_Interest from seg where Eco_Segment is not null group by 1)"""


@query("eco_crosstab", sql="with " + _NAMES_SQL + "," + _XTAB_SQL + " select * from xt")
def eco_crosstab(t):
    """Segment x eco class counts."""
    return segments.eco_crosstab(_fixed_segments(t))


@query("eco_strength", sql="with " + _NAMES_SQL + "," + _XTAB_SQL + """
select *, Eco_Warrior + Eco_Conscious + Low_Interest as Total_Eco,
  round(case when Eco_Warrior + Eco_Conscious + Low_Interest > 0 then (2 * Eco_Warrior + Eco_Conscious - 2 * Low_Interest)
        / (Eco_Warrior + Eco_Conscious + Low_Interest) else 0.0 end, 9) as Eco_Strength,
  round((case when Eco_Warrior + Eco_Conscious + Low_Interest > 0 then (2 * Eco_Warrior + Eco_Conscious - 2 * Low_Interest)
        / (Eco_Warrior + Eco_Conscious + Low_Interest) else 0.0 end + 1) / 3 * 100, 9) as Eco_Strength_Pct from xt""")
def eco_strength(t):
    """Eco strength index and percent per segment."""
    return round_doubles(segments.eco_strength(segments.eco_crosstab(_fixed_segments(t))), 9)


@query("kpi_row", sql="with " + _NAMES_SQL + """
select round(avg(Customer_Live_Time_Value), 6) as avg_cltv, round(sum(Total_Amount_Spent), 4) as revenue,
  round(avg(Total_Orders_This_Month), 6) as avg_orders, round(avg(Days_Since_Last_Order), 6) as avg_recency,
  round(avg(Satisfaction_Score), 6) as avg_satisfaction, count(distinct Segment_Label) as segments,
  count(*) as customers from seg""")
def kpi_row(t):
    """Whole-table KPIs."""
    k = segments.kpi_row(_fixed_segments(t))
    return k.withColumns({"avg_cltv": F.round("avg_cltv", 6), "revenue": F.round("revenue", 4),
                          "avg_orders": F.round("avg_orders", 6), "avg_recency": F.round("avg_recency", 6),
                          "avg_satisfaction": F.round("avg_satisfaction", 6)})


@query("green_kpis", sql="select " + ", ".join(
    f"round(avg({c}){' / 10.0' if c == 'Cultural_Eco_Alignment' else ''}, 6) as avg_{c}"
    for c in segments.GREEN_KPI_COLUMNS) + ", round(avg(Green_Consumption_Score) * 100.0, 6) as avg_green_score_pct from a_green")
def green_kpis(t):
    """Mean green attitudes and score."""
    return round_doubles(segments.green_kpis(adapters.green(t)), 6)


@query("eco_label", sql="""
select Customer_ID, case when Green_Purchase_Made = 1 and round_even(Green_Consumption_Score, 2) >= 0.7 then 'Eco_Warrior'
  when Green_Purchase_Made = 1 and round_even(Green_Consumption_Score, 2) >= 0.4 then 'Eco_Conscious' else 'Low_Interest' end as Eco_Segment,
  round_even(Green_Consumption_Score * 100, 1) as Green_Score_Pct from a_green""")
def eco_label(t):
    """eco label (score rounded first) and score percent."""
    g = adapters.green(t)
    return g.select("Customer_ID", fx.eco_label("Green_Purchase_Made", "Green_Consumption_Score").alias("Eco_Segment"),
                    fx.eco_score_pct("Green_Consumption_Score").alias("Green_Score_Pct"))


_DB_SQL = f"""
with x as (select KMeans_Segment as c, Purchase_Intensity as a, Recency as b, Avg_Spend_Per_Order as d from {_C360_FEATS}),
cent as (select c, avg(a) as ma, avg(b) as mb, avg(d) as md from x group by 1),
sp as (select x.c, avg(sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb) + (d - md) * (d - md))) as s
       from x join cent on x.c = cent.c group by 1),
cs as (select cent.*, sp.s from cent join sp on cent.c = sp.c),
r as (select i.c, max((i.s + j.s) / sqrt((i.ma - j.ma) * (i.ma - j.ma) + (i.mb - j.mb) * (i.mb - j.mb) + (i.md - j.md) * (i.md - j.md))) as r
      from cs i join cs j on i.c <> j.c group by 1)
select round(avg(r), 6) as davies_bouldin from r"""


@query("davies_bouldin", sql=_DB_SQL)
def davies_bouldin(t):
    """M9: Davies-Bouldin index of a fixed assignment on the three features."""
    df = _customers(t).withColumn("KMeans_Segment", (F.col("Customer_ID") % 4).cast("int"))
    vec = VectorAssembler(inputCols=segments.SEGMENT_FEATURES, outputCol="features").transform(df)
    return round_doubles(segments.davies_bouldin(vec), 6)


@query("silhouette_euclidean", sql=f"""
with x as (select Customer_ID, KMeans_Segment as c, Purchase_Intensity as a, Recency as b, Avg_Spend_Per_Order as d from {_C360_FEATS}),
m as (select q.Customer_ID, q.c as own, x.c, sum(sqrt((q.a - x.a) * (q.a - x.a) + (q.b - x.b) * (q.b - x.b) + (q.d - x.d) * (q.d - x.d))) as s, count(*) as n
      from x q join x on true where q.Customer_ID % 100 = 0 group by 1, 2, 3),
ab as (select Customer_ID, own, max(case when c = own and n > 1 then s / (n - 1) end) as a, min(case when c <> own then s / n end) as b from m group by 1, 2)
select Customer_ID, cast(own as int) as cluster, round(a, 6) as a, round(b, 6) as b,
  round(case when b is null then null when a is null then 0.0 else (b - a) / greatest(a, b) end, 6) as silhouette from ab""")
def silhouette_euclidean(t):
    """M8: Euclidean silhouette of every hundredth customer against all customers, for a fixed assignment."""
    df = _customers(t).withColumn("KMeans_Segment", (F.col("Customer_ID") % 4).cast("int"))
    vec = VectorAssembler(inputCols=segments.SEGMENT_FEATURES, outputCol="features").transform(df)
    out = segments.euclidean_silhouette(vec, F.col("Customer_ID") % 100 == 0)
    return round_doubles(out.withColumnRenamed("id", "Customer_ID"), 6)


@query("saved_preparation", sql="""
select Customer_ID, round(2.0 * (cast(Average_Cash_Back as double) - q[2]) / (q[3] - q[1]), 9) as Average_Cash_Back,
  round(0.5 * (cast(Loyalty_Engagement_Score as double) - r[2]) / (r[3] - r[1]), 9) as Loyalty_Engagement_Score
from a_customer360, (select quantile_cont(cast(Average_Cash_Back as double), [0.25, 0.5, 0.75]) as q,
  quantile_cont(cast(Loyalty_Engagement_Score as double), [0.25, 0.5, 0.75]) as r from a_customer360)""")
def saved_preparation(t):
    """M2 + M3 + M5 + S5: gaps filled, exact robust scaling and weights, fitted as one pipeline, saved, loaded and applied."""
    df = c360.customer_360_materialized(t)
    cols = ["Average_Cash_Back", "Loyalty_Engagement_Score"]
    names = {s: [f"{c}{s}" for c in cols] for s in ("_filled", "_scaled", "_weighed")}
    fitted = Pipeline(stages=[prep.MedianFill(inputCols=cols, outputCols=names["_filled"]),
                              prep.ExactRobustScaler(inputCols=names["_filled"], outputCols=names["_scaled"]),
                              prep.FeatureWeights(inputCols=names["_scaled"], outputCols=names["_weighed"], weights=[2.0, 0.5])]).fit(df)
    out = _saved(t, fitted).transform(df).select("Customer_ID", *[F.col(f"{c}_weighed").alias(c) for c in cols])
    return round_doubles(out, 9)


def _saved(t, model):
    """The model, saved in the shared folder and loaded again."""
    from ..session import scratch_path
    path = scratch_path(t.spark, "model")
    io.save_model(model, path)
    return io.load_pipeline_model(path)


@query("saved_segmentation")
def saved_segmentation(t):
    """M4-M6 + S5: the whole segmentation (gaps, transform, weights, k-means) as one saved object, loaded and applied."""
    df = _customers(t)
    return _saved(t, segments.segmentation_pipeline().fit(df)).transform(df).select("Customer_ID", "KMeans_Segment")


@query("robust_scale", sql="""
select Customer_ID, round((cast(Average_Cash_Back as double) - q[2]) / (q[3] - q[1]), 9) as Average_Cash_Back,
  round((cast(Loyalty_Engagement_Score as double) - r[2]) / (r[3] - r[1]), 9) as Loyalty_Engagement_Score
from a_customer360, (select quantile_cont(cast(Average_Cash_Back as double), [0.25, 0.5, 0.75]) as q,
  quantile_cont(cast(Loyalty_Engagement_Score as double), [0.25, 0.5, 0.75]) as r from a_customer360)""")
def robust_scale(t):
    """M2: (x - median) / IQR with exact quartiles."""
    df = features.robust_scale(c360.customer_360_materialized(t), ["Average_Cash_Back", "Loyalty_Engagement_Score"])
    return round_doubles(df.select("Customer_ID", "Average_Cash_Back", "Loyalty_Engagement_Score"), 9)


_YJ = {"Recency": 0.5, "Avg_Spend_Per_Order": -0.25}


@query("yeo_johnson_apply", sql="""
with y as (select Customer_ID, (pow(cast(Recency as double) + 1, 0.5) - 1) / 0.5 as Recency_yj,
  case when Avg_Spend_Per_Order >= 0 then (pow(Avg_Spend_Per_Order + 1, -0.25) - 1) / -0.25
       else -(pow(-Avg_Spend_Per_Order + 1, 2.25) - 1) / 2.25 end as Avg_Spend_Per_Order_yj from """ + _C360_FEATS + """)
select Customer_ID, round((Recency_yj - avg(Recency_yj) over ()) / stddev_pop(Recency_yj) over (), 9) as Recency_yj,
  round((Avg_Spend_Per_Order_yj - avg(Avg_Spend_Per_Order_yj) over ()) / stddev_pop(Avg_Spend_Per_Order_yj) over (), 9)
    as Avg_Spend_Per_Order_yj from y""")
def yeo_johnson_apply(t):
    """M4: Yeo-Johnson with fixed lambdas, standardised."""
    df = features.apply_yeo_johnson(_customers(t), _YJ)
    return round_doubles(df.select("Customer_ID", "Recency_yj", "Avg_Spend_Per_Order_yj"), 9)


# --- metrics of the closed-form scores ---------------------------------------------

def _scored(t):
    s = whatif.linear_scorer(c360.customer_360_materialized(t))
    return s.withColumn("pred", fx.threshold("_churn_prob"))


_SCORE_SQL = """(select Customer_ID, Churn, Customer_Live_Time_Value,
  least(greatest(0.15 + 0.2 * cast(Complain_Count_In_Last_Month as double) + 0.001 * cast(Days_Since_Last_Order as double)
    - 0.05 * cast(Satisfaction_Score as double) - 0.001 * cast(Average_Cash_Back as double), 0.0), 1.0) as p,
  0.05 * cast(Total_Amount_Spent as double) + 0.5 * cast(Loyalty_Engagement_Score as double)
    + case when coalesce(trim(cast(Total_Subscriptions as varchar)) = '1', false) then 0.0 else 500.0 end as v
  from a_customer360)"""


@query("confusion", sql=f"""
with s as (select cast(Churn as double) as label, cast(p > 0.5 as double) as prediction from {_SCORE_SQL}),
g as (select * from (values (0.0::double), (1.0::double)) a(label), (values (0.0::double), (1.0::double)) b(prediction))
select g.label, g.prediction, count(s.label) as count from g left join s on g.label = s.label and g.prediction = s.prediction
group by 1, 2""")
def confusion(t):
    """Confusion counts of the churn score at 0.5."""
    return metrics.confusion(_scored(t), "Churn", "pred")


@query("classification_report", sql=f"""
with s as (select cast(Churn as double) as label, cast(p > 0.5 as double) as prediction from {_SCORE_SQL}),
c as (select cls, count(*) filter (where label = cls and prediction = cls) as tp, count(*) filter (where label = cls) as support,
        count(*) filter (where prediction = cls) as pred_n from s, (values (0.0), (1.0)) k(cls) group by cls),
m as (select cls, support, case when pred_n > 0 then tp / pred_n else 0.0 end as precision,
        case when support > 0 then tp / support else 0.0 end as recall from c),
f as (select *, case when precision + recall > 0 then 2.0 * precision * recall / (precision + recall) else 0.0 end as f1 from m),
acc as (select sum(tp) * 1.0 / sum(support) as a, cast(sum(support) as bigint) as n from c)
select cast(cls as varchar) as class, round(precision, 9) as precision, round(recall, 9) as recall, round(f1, 9) as f1, support from f
union all select 'accuracy', round(a, 9), round(a, 9), round(a, 9), n from acc
union all select 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), cast(sum(support) as bigint) from f
union all select 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
  round(sum(f1 * support) / sum(support), 9), cast(sum(support) as bigint) from f""")
def classification_report(t):
    """Precision / recall / F1 per class and averages."""
    return round_doubles(metrics.classification_report(_scored(t), "Churn", "pred"), 9)


@query("roc_auc", sql=f"""
with s as (select p as s, sum(case when Churn = 1 then 1 else 0 end) as pos, sum(case when Churn = 1 then 0 else 1 end) as neg
           from {_SCORE_SQL} group by 1),
c as (select *, sum(neg) over (order by s rows between unbounded preceding and current row) as neg_cum from s)
select round(sum(pos * (neg_cum - neg + neg * 0.5)) / (sum(pos) * sum(neg)), 9) as auc,
  cast(sum(pos) as bigint) as positives, cast(sum(neg) as bigint) as negatives from c""")
def roc_auc(t):
    """Exact ROC AUC of the churn score."""
    return round_doubles(metrics.roc_auc(_scored(t), "Churn", "_churn_prob"), 9)


@query("regression_report", sql=f"""
with s as (select ln(1 + Customer_Live_Time_Value) as y, ln(1 + v) as p from {_SCORE_SQL}),
e as (select y, p, exp(y) - 1 as ey, exp(p) - 1 as ep from s),
m as (select avg(y) as my, avg(ey) as my2 from e)
select round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) as r2_log, round(avg(abs(y - p)), 6) as mae_log,
  round(1 - sum((ey - ep) * (ey - ep)) / sum((ey - my2) * (ey - my2)), 6) as r2,
  round(avg(abs(ey - ep)), 6) as mae from e, m""")
def regression_report(t):
    """R^2 and MAE of the value score on log and original scales."""
    s = whatif.linear_scorer(c360.customer_360_materialized(t)).select(
        F.log1p("Customer_Live_Time_Value").alias("y"), F.log1p("_cltv").alias("p"))
    return round_doubles(metrics.regression_report(s, "y", "p", log_target=True), 6)


_FIRST, _LAST = segments.TRAINING_NAMES[0], segments.TRAINING_NAMES[3]
_SCORED_SQL = "with " + _NAMES_SQL + f""",
scored as (select seg.Customer_ID, seg.KMeans_Segment, case seg.Segment_Label when '{_FIRST}' then '{_LAST}' when '{_LAST}' then '{_FIRST}'
    else seg.Segment_Label end as Segment_Label, cast(g.Green_Purchase_Made as double) as Pred_Green_Class,
    g.Green_Consumption_Score as Pred_Green_Score, case when g.Green_Purchase_Made = 1 and g.Green_Consumption_Score >= 0.7 then 'Eco_Warrior'
      when g.Green_Purchase_Made = 1 and g.Green_Consumption_Score >= 0.4 then 'Eco_Conscious' else 'Low_Interest' end as Eco_Segment,
    cast(s.p > 0.5 as double) as Predicted_Churn, round(s.v, 6) as Predicted_CLTV
  from seg join a_green g on seg.Customer_ID = g.Customer_ID join {_SCORE_SQL} s on seg.Customer_ID = s.Customer_ID)"""


def _fixed_scores(t):
    """The scored table with formulas in place of the models."""
    df = _customers(t).join(adapters.green(t), "Customer_ID", "left")
    linear = lambda d: whatif.linear_scorer(d)
    return scoring.score_customers(
        df, segment=lambda d: d.withColumn("KMeans_Segment", (F.col("Customer_ID") % 4).cast("int")),
        green=lambda d: d.withColumns({"Pred_Green_Class": F.col("Green_Purchase_Made").cast("double"),
                                       "Pred_Green_Score": F.col("Green_Consumption_Score")}),
        churn=lambda d: linear(d).withColumn("Predicted_Churn", fx.threshold("_churn_prob")).drop("_churn_prob", "_cltv"),
        value=lambda d: linear(d).withColumn("Predicted_CLTV", F.col("_cltv")).drop("_churn_prob", "_cltv"))


@query("scored_customers", sql=_SCORED_SQL + " select * from scored")
def scored_customers(t):
    """M10/F6/M13/M14 on one row per customer, with fixed formulas in place of the models."""
    return _fixed_scores(t).select("Customer_ID", *scoring.SCORE_COLUMNS).withColumn("Predicted_CLTV", F.round("Predicted_CLTV", 6))


@query("prediction_counts", sql=_SCORED_SQL + """
select Segment_Label, Predicted_Churn, count(*) as customers,
  round(count(*) * 100.0 / sum(count(*)) over (partition by Segment_Label), 9) as share_pct from scored group by 1, 2""")
def prediction_counts(t):
    """Predicted churn classes per segment, as counts and shares."""
    return round_doubles(scoring.prediction_counts(_fixed_scores(t)), 9)


# --- learner-backed (rows-only) ----------------------------------------------------


@query("kmeans_segments")
def kmeans_segments(t):
    """M6 + M10: k-means (k=4) on the transformed, weighted features, named."""
    vec, _ = segments.segment_input(_customers(t))
    _, assigned = segments.kmeans_segments(vec, 4)
    return segments.label_segments(assigned).select("Customer_ID", "KMeans_Segment", "Segment_Label")


@query("k_sweep")
def k_sweep(t):
    """M7/M8/M9: silhouette, Davies-Bouldin and cost for k = 2..8."""
    vec, _ = segments.segment_input(_customers(t))
    return segments.k_sweep(vec, range(2, 9))


@query("pca_2d")
def pca_2d(t):
    """Two principal components of the segmentation features."""
    vec, _ = segments.segment_input(_customers(t))
    return segments.pca_2d(vec).select("Customer_ID", "PCA1", "PCA2")


def _churn_data(t):
    df = c360.customer_360_materialized(t)
    return models.class_weights(df, "Churn")


# Days_Since_Last_Order defines the test label, so it is left out here
_CHURN_SPEC = models.ModelSpec(models.CHURN_CATS, [c for c in models.CHURN_NUMS if c != "Days_Since_Last_Order"],
                               "Churn")
_CLTV_SPEC = models.ModelSpec(models.CLTV_CATS, models.CLTV_NUMS, "log_cltv")


@query("churn_scores")
def churn_scores(t):
    """Churn probability per customer (gradient-boosted trees)."""
    df = _churn_data(t)
    model = models.churn_model(df, _CHURN_SPEC)
    return model.transform(df).select("Customer_ID", "Churn", F.col("p1").alias("churn_probability"))


@query("cltv_scores")
def cltv_scores(t):
    """Predicted lifetime value (log1p target, expm1 back)."""
    df = c360.customer_360_materialized(t).withColumn("log_cltv", F.log1p("Customer_Live_Time_Value"))
    model = models.value_model(df, _CLTV_SPEC)
    return model.transform(df).select("Customer_ID", "Customer_Live_Time_Value",
                                      F.expm1("prediction").alias("Predicted_CLTV"))


@query("green_scores")
def green_scores(t):
    """Green class and score for rows with complete inputs; eco label."""
    g = adapters.green(t)
    clf, reg = models.green_pipelines()
    train = g.na.drop(subset=models.GREEN_NUMS)
    cm, rm = clf.fit(train), reg.fit(train)
    scored, _ = models.score_valid_rows(g, cm, models.GREEN_NUMS, "Customer_ID",
                                        {"Pred_Green_Class": F.col("Pred_Green_Class")})
    scored2, _ = models.score_valid_rows(g, rm, models.GREEN_NUMS, "Customer_ID",
                                         {"Pred_Green_Score": F.col("Pred_Green_Score")})
    out = scored.join(scored2.select("Customer_ID", "Pred_Green_Score"), "Customer_ID")
    return out.select("Customer_ID", "Pred_Green_Class", "Pred_Green_Score",
                      fx.eco_label("Pred_Green_Class", "Pred_Green_Score").alias("Eco_Segment"))


@query("score_customers")
def score_customers(t):
    """M6-M18 together: k-means segment, eco label, predicted churn and value of every customer."""
    from ..session import cut_lineage
    df = cut_lineage(_customers(t).join(adapters.green(t), "Customer_ID", "left"))
    clf, reg = models.green_pipelines()
    known = df.na.drop(subset=models.GREEN_NUMS)
    churn = models.churn_model(models.class_weights(df, "Churn"), _CHURN_SPEC)
    value = models.value_model(df.withColumn("log_cltv", F.log1p("Customer_Live_Time_Value")), _CLTV_SPEC)
    scored = scoring.score_customers(
        df, scoring.kmeans_step(), scoring.green_step(clf.fit(known), reg.fit(known)),
        scoring.churn_step(churn, [*_CHURN_SPEC.cats, *_CHURN_SPEC.nums]), scoring.value_step(value, [*_CLTV_SPEC.cats, *_CLTV_SPEC.nums]))
    return scored.select("Customer_ID", *scoring.SCORE_COLUMNS)


@query("random_search")
def random_search(t):
    """Ten settings of the churn grid by F1, on five stratified folds."""
    return models.churn_search(_churn_data(t), _CHURN_SPEC)[1]


@query("value_search")
def value_search(t):
    """Fifteen settings of the value grid by absolute error, on five folds."""
    df = c360.customer_360_materialized(t).withColumn("log_cltv", F.log1p("Customer_Live_Time_Value"))
    return models.value_search(df, _CLTV_SPEC)[1]


@query("top_drivers")
def top_drivers(t):
    """The eight strongest churn drivers by mean |contribution|."""
    df = _churn_data(t)
    model = models.churn_model(df, _CHURN_SPEC)
    return drivers.top_boosted_drivers(df, model, 8)


@query("churn_by_segment")
def churn_by_segment(t):
    """Predicted churn share per (fixed) segment, from the churn model."""
    df = _churn_data(t)
    model = models.churn_model(df, _CHURN_SPEC)
    seg = _fixed_segments(t).select("Customer_ID", "Segment_Label")
    scored = model.transform(df).select("Customer_ID", F.col("prediction").alias("Predicted_Churn")).join(seg, "Customer_ID")
    return scored.groupBy("Segment_Label").agg(F.avg("Predicted_Churn").alias("churn_rate"),
                                                F.count(F.lit(1)).alias("customers"))


@query("segment_eco_lookup", sql="with " + _NAMES_SQL + "," + _XTAB_SQL + """,
sm as (select Segment_Label, count(Customer_ID) as Count, avg(Total_Amount_Spent) as Total_Amount_Spent,
  avg(Days_Since_Last_Order) as Days_Since_Last_Order, avg(Satisfaction_Score) as Satisfaction_Score,
  avg(Total_Orders_This_Month) as Total_Orders_This_Month from seg group by 1)
select sm.Segment_Label, sm.Count, round(sm.Total_Amount_Spent, 6) as Total_Amount_Spent,
  round(sm.Days_Since_Last_Order, 6) as Days_Since_Last_Order, round(sm.Satisfaction_Score, 6) as Satisfaction_Score,
  round(sm.Total_Orders_This_Month, 6) as Total_Orders_This_Month,
  coalesce(xt.Eco_Conscious, 0) as Eco_Conscious, coalesce(xt.Eco_Warrior, 0) as Eco_Warrior,
  coalesce(xt.Low_Interest, 0) as Low_Interest,
  round(coalesce((case when xt.Eco_Warrior + xt.Eco_Conscious + xt.Low_Interest > 0
        then (2 * xt.Eco_Warrior + xt.Eco_Conscious - 2 * xt.Low_Interest) / (xt.Eco_Warrior + xt.Eco_Conscious + xt.Low_Interest)
        else 0.0 end + 1) / 3 * 100, 0.0), 9) as Eco_Strength_Pct
from sm left join xt on sm.Segment_Label = xt.Segment_Label""")
def segment_eco_lookup(t):
    """A10 + A11 + A12 joined on the segment label, gaps as 0 (J9): the
    segment / eco lookup table of the training step."""
    from ..operators.joins import join_summaries
    seg = _fixed_segments(t)
    summary = segments.segment_summary(seg).drop("Share_Pct")
    eco = segments.eco_strength(segments.eco_crosstab(seg)).select(
        "Segment_Label", "Eco_Conscious", "Eco_Warrior", "Low_Interest", "Eco_Strength_Pct")
    out = join_summaries(summary, eco, "Segment_Label")
    return out.withColumns({c: F.round(c, 6) for c in ["Total_Amount_Spent", "Days_Since_Last_Order",
                                                        "Satisfaction_Score", "Total_Orders_This_Month"]}
                           ).withColumn("Eco_Strength_Pct", F.round("Eco_Strength_Pct", 9))


@query("whatif_model_scenario")
def whatif_model_scenario(t):
    """The scenario re-scored by the trained churn and value models.  The
    customer table and the scored baseline are each read many times (two
    fits, two scorings, lever statistics), so both are checkpointed."""
    from ..session import cut_lineage
    df = c360.customer_360_materialized(t)
    churn_model = models.churn_model(models.class_weights(df, "Churn"), _CHURN_SPEC)
    cltv_model = models.value_model(df.withColumn("log_cltv", F.log1p("Customer_Live_Time_Value")), _CLTV_SPEC)
    scorer = whatif.model_scorer(churn_model, cltv_model)
    base = cut_lineage(whatif.with_baseline(df, scorer))
    sim = whatif.simulate(base, whatif.Levers(cashback=10, support=20, price=5, subscription=30), scorer)
    return whatif.whatif_kpis(sim)


def _holdout(t, label: str):
    """The parts of the customer table; written once, as fits and reports read them many times."""
    from ..operators import sampling
    from ..session import cut_lineage
    df = c360.customer_360_materialized(t)
    split = sampling.stratified_split(df.select("Customer_ID", label), "Customer_ID", label, 0.2)
    parts = cut_lineage(df.join(split.select("Customer_ID", "split"), "Customer_ID"))
    return parts.where(F.col("split") == "train"), parts.where(F.col("split") == "test")


@query("churn_holdout_report")
def churn_holdout_report(t):
    """W7 + M13 + M19/M21: churn model fitted on the 80 % part, judged on the
    stratified 20 % hold-out (per-class report plus ROC AUC)."""
    from ..session import cut_lineage
    train, test = _holdout(t, "Churn")
    model = models.churn_model(models.class_weights(train, "Churn"), _CHURN_SPEC)
    scored = cut_lineage(model.transform(test).select("Churn", "prediction", "p1"))
    report = metrics.classification_report(scored, "Churn", "prediction")
    auc = metrics.roc_auc(scored, "Churn", "p1").select(F.col("auc"))
    return report.withColumn("roc_auc", auc.scalar())


@query("cltv_holdout_report")
def cltv_holdout_report(t):
    """W7 + M14 + M22: value model on the log1p target, R^2 and MAE on the
    hold-out, on the log and the original scale."""
    train, test = _holdout(t, "Churn")
    lab = lambda d: d.withColumn("log_cltv", F.log1p("Customer_Live_Time_Value"))
    model = models.value_model(lab(train), _CLTV_SPEC)
    scored = model.transform(lab(test))
    return metrics.regression_report(scored, "log_cltv", "prediction", log_target=True)


@query("green_holdout_report")
def green_holdout_report(t):
    """W7 + M15 + M19/M21/M22: green class and score trees fitted on the 80 % part, judged on the stratified 20 % hold-out
    (per-class report, ROC AUC, and R^2 and MAE of the score)."""
    from ..operators import sampling
    from ..session import cut_lineage
    g = cut_lineage(adapters.green(t).na.drop(subset=models.GREEN_NUMS))
    split = sampling.stratified_split(g.select("Customer_ID", "Green_Purchase_Made"), "Customer_ID", "Green_Purchase_Made", 0.2)
    parts = cut_lineage(g.join(split.select("Customer_ID", "split"), "Customer_ID"))
    train, test = parts.where(F.col("split") == "train"), parts.where(F.col("split") == "test")
    clf, reg = models.green_pipelines()
    classed = cut_lineage(clf.fit(train).transform(test).select("Green_Purchase_Made", "Pred_Green_Class",
                                                                vector_to_array("green_probability")[1].alias("p1")))
    report = metrics.classification_report(classed, "Green_Purchase_Made", "Pred_Green_Class")
    fit = metrics.regression_report(reg.fit(train).transform(test), "Green_Consumption_Score", "Pred_Green_Score")
    auc = metrics.roc_auc(classed, "Green_Purchase_Made", "p1").select("auc")
    return report.withColumns({"roc_auc": auc.scalar(), "score_r2": fit.select("r2").scalar(), "score_mae": fit.select("mae").scalar()})


@query("value_drivers")
def value_drivers(t):
    """The eight strongest drivers of the value model."""
    df = c360.customer_360_materialized(t).withColumn("log_cltv", F.log1p("Customer_Live_Time_Value"))
    return drivers.top_boosted_drivers(df, models.value_model(df, _CLTV_SPEC), 8)


@query("green_drivers")
def green_drivers(t):
    """The eight strongest drivers of the green purchase class."""
    g = adapters.green(t).na.drop(subset=models.GREEN_NUMS)
    model = models.green_pipelines()[0].fit(g)
    names = models.feature_slot_names(model, models.GREEN_CATS, models.GREEN_NUMS)
    return drivers.top_drivers(model.transform(g), model.stages[-1], names, 8)
