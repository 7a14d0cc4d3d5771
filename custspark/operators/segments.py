"""Customer segmentation.

K-means runs as Spark ML's k-means|| on a cached feature vector.  Cluster
statistics, names and eco-profile summaries work on the k-row stats table
(bounded by k).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ECO_CONSCIOUS, ECO_WARRIOR, LOW_INTEREST
from ..session import cut_lineage
from . import features as fe
from . import prep

SEGMENT_FEATURES = ["Purchase_Intensity", "Recency", "Avg_Spend_Per_Order"]
# Feature weights and the four segment names.
SEGMENT_WEIGHTS = {"Purchase_Intensity": 1.0, "Recency": 1.5, "Avg_Spend_Per_Order": 3.0}
FREQUENT_LOYAL = "Frequent Loyal Customers"
AT_RISK = "At-Risk Customers"
HIGH_VALUE = "High-Value Customers"
VALUE_SEEKING = "Value Seeking Customers"
# training names: most orders -> loyal, ..., rest -> value seeking;
# the dashboard swaps the first and the last name
TRAINING_NAMES = (FREQUENT_LOYAL, AT_RISK, HIGH_VALUE, VALUE_SEEKING)
DASHBOARD_NAMES = (VALUE_SEEKING, AT_RISK, HIGH_VALUE, FREQUENT_LOYAL)


def segment_input(df: DataFrame, medians: dict | None = None) -> tuple[DataFrame, dict]:
    """P9 + M4 + M5: fill features with (training) medians, Yeo-Johnson with
    fitted lambdas, standardise, weight, assemble.  Returns the frame with a
    ``features`` vector and the medians used.

    The input is checkpointed first: the lambda search and k-means read it
    many times, and each read would otherwise re-run the whole customer
    plan.  The medians are three numbers, fetched once (the saved model
    parameters of P9)."""
    base = cut_lineage(df)
    if medians is None:
        from .quantiles import medians as exact_medians
        medians = {c: (v if v is not None else 0.0) for c, v in exact_medians(base, SEGMENT_FEATURES).items()}
    filled = base.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in SEGMENT_FEATURES})
    lambdas = fe.fit_yeo_johnson(filled, SEGMENT_FEATURES)
    yj = fe.apply_yeo_johnson(filled, lambdas)
    w = fe.weight_features(yj, {f"{c}_yj": v for c, v in SEGMENT_WEIGHTS.items()})
    vec = VectorAssembler(inputCols=[f"{c}_yj" for c in SEGMENT_FEATURES], outputCol="features").transform(w)
    return cut_lineage(vec), medians


def kmeans_segments(vec: DataFrame, k: int = 4, seed: int = 42, max_iter: int = 20):
    """M6: k-means|| with a fixed seed; returns (model, frame with
    ``KMeans_Segment``)."""
    km = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="KMeans_Segment")
    model = km.fit(vec)
    return model, model.transform(vec)


def silhouette(assigned: DataFrame, cluster_col: str = "KMeans_Segment") -> float:
    """M8: Spark's silhouette (squared Euclidean form, O(n k), no pairs)."""
    return ClusteringEvaluator(featuresCol="features", predictionCol=cluster_col,
                               distanceMeasure="squaredEuclidean").evaluate(assigned)


#: Rows of a part and anchors of a slice that meet in a task.
SILHOUETTE_ROWS, SILHOUETTE_ANCHORS = 16_384, 2_048


def euclidean_silhouette(assigned: DataFrame, anchors: Column, id_col: str = "Customer_ID", cluster_col: str = "KMeans_Segment",
                         features_col: str = "features") -> DataFrame:
    """M8: the Euclidean silhouette ``(b - a) / max(a, b)`` of every row that ``anchors`` marks, against all rows:
    ``(id, cluster, a, b, silhouette)``, where ``a`` is the mean distance to the other rows of its cluster and ``b`` the least mean
    distance to another cluster (0 for the only row of a cluster, null where there is one cluster).  Rows lie in parts and anchors in slices of bounded size; a task measures a slice against a part and
    returns a sum for each anchor and cluster, no pair."""
    rows = cut_lineage(assigned.select(F.col(id_col).alias("id"), F.col(cluster_col).cast("int").alias("c"), vector_to_array(features_col).alias("x"),
                                       F.coalesce(anchors, F.lit(False)).alias("anchor")).where("c is not null").withColumn("row", F.monotonically_increasing_id()))
    n, n_anchors = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    parts, slices = max(1, -(-n // SILHOUETTE_ROWS)), max(1, -(-n_anchors // SILHOUETTE_ANCHORS))
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    deal = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    left = rows.where("anchor").select("row", "x", deal(slices).alias("s"), every(parts, "p"))
    right = rows.select("x", "c", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(parts)).cast("int").alias("p"), every(slices, "s"))

    def run(key, some: pa.Table, held: pa.Table) -> pa.Table:
        if not some.num_rows or not held.num_rows:
            return pa.schema([("row", pa.int64()), ("c", pa.int32()), ("d", pa.float64()), ("n", pa.int64())]).empty_table()
        matrix = lambda t: np.stack(t["x"].to_numpy())
        a, b, c = matrix(some), matrix(held), held["c"].to_numpy()
        order = np.argsort(c, kind="stable")
        kinds, first, size = np.unique(c[order], return_index=True, return_counts=True)
        b = b[order]
        out = np.zeros((len(a), len(kinds)))
        for at in range(0, len(a), 32):
            d = np.sqrt(((a[at:at + 32, None, :] - b[None, :, :]) ** 2).sum(axis=2))
            out[at:at + 32] = np.add.reduceat(d, first, axis=1)
        return pa.Table.from_arrays([pa.array(np.repeat(some["row"].to_numpy(), len(kinds))), pa.array(np.tile(kinds.astype(np.int32), len(a))),
                                     pa.array(out.reshape(-1)), pa.array(np.tile(size, len(a)))], ["row", "c", "d", "n"])

    sums = (left.groupBy("s", "p").cogroup(right.groupBy("s", "p")).applyInArrow(run, "row long, c int, d double, n long")
            .groupBy("row", "c").agg(F.sum("d").alias("d"), F.sum("n").alias("n")))
    joined = sums.join(rows.where("anchor").select("row", "id", F.col("c").alias("own")), "row")
    own = F.col("c") == F.col("own")
    ab = joined.groupBy("row", "id", "own").agg(F.max(F.when(own, F.try_divide("d", F.col("n") - 1))).alias("a"), F.min(F.when(~own, F.col("d") / F.col("n"))).alias("b"))
    score = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("a").isNull(), 0.0).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return ab.select("id", F.col("own").alias("cluster"), "a", "b", score.alias("silhouette"))


def segmentation_pipeline(k: int = 4, seed: int = 42) -> Pipeline:
    """P9 + M4 + M5 + M6 as one object to fit, save and load: gaps take the training medians, features are transformed, standardised and
    weighed, and customers clustered."""
    steps = {s: [f"{c}{s}" for c in SEGMENT_FEATURES] for s in ("_filled", "_yj", "_weighed")}
    return Pipeline(stages=[
        prep.MedianFill(inputCols=list(SEGMENT_FEATURES), outputCols=steps["_filled"]),
        prep.YeoJohnson(inputCols=steps["_filled"], outputCols=steps["_yj"]),
        prep.FeatureWeights(inputCols=steps["_yj"], outputCols=steps["_weighed"], weights=[float(SEGMENT_WEIGHTS[c]) for c in SEGMENT_FEATURES]),
        VectorAssembler(inputCols=steps["_weighed"], outputCol="features"),
        KMeans(k=k, seed=seed, maxIter=20, featuresCol="features", predictionCol="KMeans_Segment")])


def davies_bouldin(assigned: DataFrame, cluster_col: str = "KMeans_Segment",
                   features_col: str = "features") -> DataFrame:
    """M9: Davies-Bouldin index, exact, in three aggregates: centroids,
    mean distance of members to their centroid, then per cluster the worst
    (s_i + s_j) / d_ij.  The k centroids travel as one array (a scalar
    subquery) exploded next to each cluster row: k x k rows, no join."""
    x = assigned.select(F.col(cluster_col).alias("c"), vector_to_array(features_col).alias("x"))
    dim = len(assigned.select(features_col).first()[0]) if assigned.take(1) else 0
    cent = x.groupBy("c").agg(F.array(*[F.avg(F.col("x")[i]) for i in range(dim)]).alias("mu"))
    j = x.join(cent, "c")
    dist = F.sqrt(F.aggregate(F.zip_with("x", "mu", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    spread = j.groupBy("c").agg(F.avg(dist).alias("s"), F.first("mu").alias("mu"))
    allc = spread.agg(F.collect_list(F.struct("c", "s", "mu")).alias("a")).scalar()
    pairs = spread.select("c", "s", "mu", F.explode(allc).alias("o")).where(F.col("o.c") != F.col("c"))
    d = F.sqrt(F.aggregate(F.zip_with(F.col("mu"), F.col("o.mu"), lambda a, b: (a - b) * (a - b)),
                           F.lit(0.0), lambda s, v: s + v))
    worst = pairs.groupBy("c").agg(F.max((F.col("s") + F.col("o.s")) / d).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def k_sweep(vec: DataFrame, ks: Sequence[int] = range(2, 9), seed: int = 42) -> DataFrame:
    """M7: for each k the silhouette (Spark's squared-Euclidean form, named so),
    the exact Davies-Bouldin index and the k-means cost.
    The feature frame is cached once for the sweep; each k is a Spark job,
    the result is a k-row table."""
    vec = vec.select("features").cache()
    rows = []
    try:
        for k in ks:
            model, assigned = kmeans_segments(vec, k, seed)
            db = davies_bouldin(assigned).first()[0]
            rows.append((int(k), float(silhouette(assigned)), float(db), float(model.summary.trainingCost)))
    finally:
        vec.unpersist()
    return vec.sparkSession.createDataFrame(
        rows, "k int, silhouette_sq_euclidean double, davies_bouldin double, cost double")


def segment_stats(assigned: DataFrame, cluster_col: str = "KMeans_Segment") -> DataFrame:
    """Cluster means used for naming (k rows)."""
    return assigned.groupBy(cluster_col).agg(F.avg("Total_Amount_Spent").alias("spend"),
                                             F.avg("Recency").alias("recency"),
                                             F.avg("Total_Orders_This_Month").alias("orders"))


def name_clusters(stats: DataFrame, cluster_col: str = "KMeans_Segment",
                  names: Sequence[str] = TRAINING_NAMES) -> DataFrame:
    """Greedy names: the cluster with most orders gets ``names[0]``;
    of the rest, the highest recency ``names[1]``; of the rest, the highest
    spend ``names[2]``; all others ``names[3]``.  Ties go to the lower
    cluster id.  The k rows travel as one array, so the table is aggregated once."""
    def best(rest, metric):
        ranked = F.transform(rest, lambda c: F.struct(c[metric].alias("m"), (-c[cluster_col]).alias("t"),
                                                      c[cluster_col].alias("c")))
        return F.array_max(ranked)["c"]

    def without(rest, taken):
        return F.filter(rest, lambda c: c[cluster_col] != F.col(taken))

    k = stats.agg(F.collect_list(F.struct(cluster_col, "orders", "recency", "spend")).alias("all")).withColumn("rest", F.col("all"))
    for i, metric in enumerate(("orders", "recency", "spend")):
        k = k.withColumn(f"n{i}", best(F.col("rest"), metric))
        k = k.withColumn("rest", without("rest", f"n{i}"))
    rows = k.select("n0", "n1", "n2", F.explode("all").alias("c")).select("n0", "n1", "n2", F.col(f"c.{cluster_col}").alias(cluster_col))
    label = F.lit(names[3])
    for i in (2, 1, 0):
        label = F.when(F.col(cluster_col) == F.col(f"n{i}"), F.lit(names[i])).otherwise(label)
    return rows.select(cluster_col, label.alias("Segment_Label"))


def label_segments(assigned: DataFrame, cluster_col: str = "KMeans_Segment",
                   names: Sequence[str] = TRAINING_NAMES) -> DataFrame:
    """M10 applied: join the k-row name table back (AQE broadcasts it)."""
    return assigned.join(name_clusters(segment_stats(assigned, cluster_col), cluster_col, names),
                         cluster_col, "left")


def segment_summary(df: DataFrame, seg: str = "Segment_Label") -> DataFrame:
    """A10: per segment count, share of all customers and mean spend,
    recency, satisfaction and orders."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(seg).agg(F.count("Customer_ID").alias("Count"),
                                F.avg("Total_Amount_Spent").alias("Total_Amount_Spent"),
                                F.avg("Days_Since_Last_Order").alias("Days_Since_Last_Order"),
                                F.avg("Satisfaction_Score").alias("Satisfaction_Score"),
                                F.avg("Total_Orders_This_Month").alias("Total_Orders_This_Month"))
            .withColumn("Share_Pct", F.col("Count") * F.lit(100.0) / total))


def eco_crosstab(df: DataFrame, seg: str = "Segment_Label", eco: str = "Eco_Segment") -> DataFrame:
    """Segment x eco class counts, the three classes as columns (0 when
    absent).  ``-`` in class names reads as ``_`` first."""
    e = F.regexp_replace(F.col(eco), "-", "_")
    return (df.where(F.col(eco).isNotNull()).withColumn(eco, e)
            .groupBy(seg).pivot(eco, [ECO_CONSCIOUS, ECO_WARRIOR, LOW_INTEREST])
            .agg(F.count("Customer_ID")).na.fill(0, [ECO_CONSCIOUS, ECO_WARRIOR, LOW_INTEREST]))


def eco_strength(crosstab: DataFrame) -> DataFrame:
    """E = (2 W + C - 2 L) / total (0 for an empty row) and the percent
    (E + 1) / 3 * 100, which lies in [-33.3, 100]."""
    w, c, l = F.col(ECO_WARRIOR), F.col(ECO_CONSCIOUS), F.col(LOW_INTEREST)
    total = w + c + l
    e = F.when(total > 0, (F.lit(2) * w + c - F.lit(2) * l) / total).otherwise(F.lit(0.0))
    return crosstab.withColumns({"Total_Eco": total, "Eco_Strength": e,
                                 "Eco_Strength_Pct": (e + F.lit(1)) / F.lit(3) * F.lit(100)})


def kpi_row(df: DataFrame, seg: str = "Segment_Label") -> DataFrame:
    """Whole-table KPIs in one aggregate."""
    return df.agg(F.avg("Customer_Live_Time_Value").alias("avg_cltv"),
                  F.sum("Total_Amount_Spent").alias("revenue"),
                  F.avg("Total_Orders_This_Month").alias("avg_orders"),
                  F.avg("Days_Since_Last_Order").alias("avg_recency"),
                  F.avg("Satisfaction_Score").alias("avg_satisfaction"),
                  F.countDistinct(seg).alias("segments"),
                  F.count(F.lit(1)).alias("customers"))


GREEN_KPI_COLUMNS = ["Cultural_Eco_Alignment", "Emotional_Guilt_Score", "Emotional_Pride_Score",
                     "Social_Influence_Score", "Green_Knowledge_Level", "Time_Spent_on_Green_Products",
                     "Clicks_on_Green_Products", "Previous_Green_Purchases"]


def green_kpis(df: DataFrame, score: str = "Green_Consumption_Score") -> DataFrame:
    """Means of the attitude columns (alignment on a 0-1 scale, /10)
    and the mean green score in percent (x100)."""
    aggs = [(F.avg(c) / F.lit(10.0) if c == "Cultural_Eco_Alignment" else F.avg(c)).alias(f"avg_{c}")
            for c in GREEN_KPI_COLUMNS]
    return df.agg(*aggs, (F.avg(score) * F.lit(100.0)).alias("avg_green_score_pct"))


def pca_2d(vec: DataFrame, features_col: str = "features") -> DataFrame:
    """First two principal components.  Spark's PCA does not centre
    when projecting, so the features are centred first."""
    centred = StandardScaler(inputCol=features_col, outputCol="_centred", withMean=True, withStd=False) \
        .fit(vec).transform(vec)
    model = PCA(k=2, inputCol="_centred", outputCol="_pca").fit(centred)
    arr = vector_to_array("_pca")
    return model.transform(centred).withColumns({"PCA1": arr[0], "PCA2": arr[1]}).drop("_centred", "_pca")
