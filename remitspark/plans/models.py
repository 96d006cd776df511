"""Queries of the isolation forest, the search builder, and the last assemblies."""

from pyspark.sql import functions as F

from remitspark.operators import drift as K
from remitspark.operators import forest
from remitspark.operators.search import Search
from remitspark.plans.customers import DRIFT, VEC, asked, features, samples
from remitspark.plans.streams import drain, ended
from remitspark.registry import query
from remitspark.sources.scratch import shared_folder
from remitspark.sources.streams import event_stream
from remitspark.streaming import tables as S
from remitspark.streaming import sliding as D
from remitspark.streaming import windows as N

FEATURES = ["n", "minutes_silent", "discount_rate", "quarantines", "spend_7d"]


@query("ml_02_isolation_forest")
def ml_02(v):
    model = forest.fit(features(v), FEATURES, row_id="customer_id")
    return model.select("tree", F.size("nodes").cast("long").alias("n_nodes"))


@query("ml_03_batch_score")
def ml_03(v):
    """Features are made once and saved: the model is fitted on them and they are scored."""
    folder = shared_folder(v.spark, "features")
    features(v).write.parquet(folder)
    t = v.spark.read.parquet(folder)
    return forest.score(t, forest.fit(t, FEATURES, row_id="customer_id"), FEATURES).select("customer_id", F.round("model_score", 6).alias("model_score"), F.lit("forest-1").alias("model_version"))


@query("udf_02_model_score")
def udf_02(v):
    t = v.event.select("event_id", F.col("amount").cast("double").alias("amount"), F.col("discount").cast("double").alias("discount"))
    return forest.score(t, forest.fit(t, ["amount", "discount"], row_id="event_id"), ["amount", "discount"]).select("event_id", F.round("model_score", 6).alias("model_score"))


@query("udf_03_two_sample_ks", f"WITH {DRIFT} SELECT feature, d FROM ks")
def udf_03(v):
    return K.ks_statistic(samples(v)).select("feature", "d")


@query("udf_04_search_pipeline", f"WITH {VEC.format(x='')} SELECT query_id, vec_id, score, CAST(r2 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r2 FROM top WHERE rank <= 40 AND label % 2 = 0 AND score >= 0.1) WHERE r2 <= 4")
def udf_04(v):
    e = v.table("embeddings")
    s = Search(e).nearest(asked(e), 40).where(F.col("label") % 2 == 0).at_least(0.1)
    return s.limit(4).select("query_id", "vec_id", "score", "rank")


@query("set_03_union_of_hits", f"WITH {VEC.format(x='')}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label < 5 ORDER BY score DESC, vec_id) AS r2 FROM top) WHERE r2 <= 5), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r3 FROM u) SELECT query_id, vec_id, score FROM g WHERE r3 <= 5")
def set_03(v):
    """Two indexes (labels below 5, and the rest) searched apart, their hits ranked together."""
    e = v.table("embeddings")
    parts = [Search(e).prefilter(c).nearest(asked(e), 5) for c in (F.col("label") < 5, F.col("label") >= 5)]
    return Search.merged(*parts).limit(5).select("query_id", "vec_id", "score")


@query("prj_03_streaming_summary", "SELECT event_id, customer_type, array_to_string(promotions, ',') AS promotions, home_state AS service_state FROM ev LEFT JOIN cust USING (customer_id)")
def prj_03(v):
    s = v.customer.select("customer_id", F.struct("customer_type", "promotions", F.col("home_state").alias("service_state")).alias("customer_summary"))
    t = v.event.join(s, "customer_id", "left")
    return t.select("event_id", "customer_summary.customer_type", F.array_join("customer_summary.promotions", ",").alias("promotions"), "customer_summary.service_state")


@query("prj_04_case_customer_snapshot", "SELECT case_id, coalesce(name, 'unknown') AS name, customer_type, coalesce(len(promotions), 0) AS n_promotions FROM cases LEFT JOIN cust USING (customer_id)")
def prj_04(v):
    t = v.case.join(v.customer, "customer_id", "left")
    n = F.coalesce(F.size(F.transform("promotions", lambda p: F.upper(p))), F.lit(0))
    return t.select("case_id", F.coalesce("name", F.lit("unknown")).alias("name"), "customer_type", F.when(F.col("promotions").isNull(), 0).otherwise(n).cast("long").alias("n_promotions"))


@query("enr_07_full_transaction", """WITH l AS (SELECT transaction_id, sum(line_total) AS subtotal, sum(discount) AS discount, count(*) AS lines FROM items GROUP BY 1)
  SELECT t.transaction_id, t.customer_id, customer_type, 'cyc_' || t.customer_id || '_' || strftime(ts, '%Y%m') AS cycle_id, CAST(coalesce(subtotal, total) AS DOUBLE) AS subtotal, CAST(coalesce(discount, 0) AS DOUBLE) AS discount,
  coalesce(lines, 0) AS lines, txn_state IS NOT NULL AND txn_state IS DISTINCT FROM home_state AS away, 3 AS schema_version FROM txn t LEFT JOIN l USING (transaction_id) LEFT JOIN cust c ON c.customer_id = t.customer_id""")
def enr_07(v):
    l = v.items.groupBy("transaction_id").agg(F.sum("line_total").alias("subtotal"), F.sum("discount").alias("discount"), F.count("*").alias("lines"))
    t = v.txn.join(l, "transaction_id", "left").join(v.customer, "customer_id", "left")
    return t.select(
        "transaction_id", "customer_id", "customer_type", F.concat(F.lit("cyc_"), "customer_id", F.lit("_"), F.date_format("ts", "yyyyMM")).alias("cycle_id"),
        F.coalesce("subtotal", "total").cast("double").alias("subtotal"), F.coalesce("discount", F.lit(0)).cast("double").alias("discount"), F.coalesce("lines", F.lit(0)).alias("lines"),
        (F.col("txn_state").isNotNull() & ~F.col("txn_state").eqNullSafe(F.col("home_state"))).alias("away"), F.lit(3).alias("schema_version"),
    )


@query("src_05_history_scan", "WITH h AS (SELECT customer_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY 1, 2) SELECT 'history' AS origin, * FROM h UNION ALL SELECT 'computed', * FROM h WHERE day >= '2024-01-29'")
def src_05(v):
    """Feature history from its folder if there is one, else computed from the events: both ways."""
    from remitspark.sources.history import history_or

    day = F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day")
    fresh = lambda: v.event.groupBy("customer_id", day).agg(F.count("*").alias("n"))
    folder = shared_folder(v.spark, "history")
    computed = history_or(v.spark, folder, fresh)  # nothing there yet
    computed.write.parquet(folder)
    nothing = lambda: computed.where("false")
    read = history_or(v.spark, folder, nothing)
    return read.select(F.lit("history").alias("origin"), "customer_id", "day", "n").unionByName(computed.where("day >= '2024-01-29'").withColumn("origin", F.lit("computed")))


def _trailing(length, hop, what):
    """SQL: of each customer the window that ends with the step of the newest event."""
    return f"SELECT customer_id, {what} FROM (SELECT *, (CAST(floor(epoch(max(ts) OVER (PARTITION BY customer_id))) AS BIGINT) // {hop} + 1) * {hop} AS e FROM ev) WHERE epoch(ts) >= e - {length} GROUP BY 1"


def _windows(length, hop, delay):
    return f"SELECT customer_id, count(*) AS c FROM ({ended(length, hop, delay)}) GROUP BY 1"


@query("fea_02_window_history", f"""WITH a AS ({_trailing(86400, 300, 'count(*) AS n, CAST(sum(amount) AS DOUBLE) AS spend')}), b AS ({_trailing(604800, 1800, 'count(*) AS n, CAST(sum(discount) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0) AS rate')}),
  k AS (SELECT c_custkey AS customer_id FROM customer), h AS ({_windows(86400, 300, '30 MINUTE')}), i AS ({_windows(604800, 1800, '1 HOUR')})
  SELECT k.customer_id, a.n AS txn_count_24h, a.spend AS spend_24h, b.n AS txn_count_7d, b.rate AS discount_rate_7d, CASE WHEN a.n IS NOT NULL THEN 'spark_batch' END AS computed_via, coalesce(h.c, 0) AS history_24h, coalesce(i.c, 0) AS history_7d
  FROM k LEFT JOIN a USING (customer_id) LEFT JOIN b USING (customer_id) LEFT JOIN h USING (customer_id) LEFT JOIN i USING (customer_id)""")
def fea_02(v):
    """24-hour windows each five minutes and 7-day windows each half hour, from state kept by customer. Windows go to the
    history, by customer bucket and as runs of windows alike (``Sliding.each_window`` lays them out), once they are closed; the window that ends with a customer's newest event updates the
    online table with every micro-batch, which never gains rows."""
    online = S.SnapshotTable(v.spark, shared_folder(v.spark, "online"), "customer_id long, txn_count_24h long, spend_24h double, txn_count_7d long, discount_rate_7d double, quality struct<computed_via:string,confidence:double>, latest timestamp", ["customer_id"])
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in online.types.fields[1:]]
    online.apply(lambda old: v.customer.select("customer_id", *none), 0)
    quality = F.struct(F.lit("spark_batch").alias("computed_via"), F.lit(0.95).alias("confidence"))
    t = None
    for length, step, delay, names, name in ((86400, 300, 1800, ("txn_count_24h", "spend_24h"), "history_24h"), (604800, 1800, 3600, ("txn_count_7d", "discount_rate_7d"), "history_7d")):
        folder = shared_folder(v.spark, f"history_{step}")
        w = D.Sliding(v.spark, shared_folder(v.spark, "sliding"), length, step, delay)

        def closed(batch, w=w, folder=folder):
            rows = w.closed(batch).withColumn("customer_bucket", F.abs(F.hash("customer_id")) % 32)
            rows.repartition("customer_bucket").write.mode("overwrite").partitionBy("customer_bucket").parquet(f"{folder}/batch_={batch}")

        def each(df, batch, w=w, names=names, closed=closed):
            w.apply(df, batch)
            closed(batch)
            value = F.col("amount") if names[1] == "spend_24h" else F.col("discount_rate")
            new = N.with_rate(w.latest()).select("customer_id", F.col("n").alias(names[0]), value.cast("double").alias(names[1]), quality.alias("quality"), F.col("last_end").alias("latest"))
            online.apply(S.update_latest(new, ["customer_id"], "latest"), batch, names[0])

        drain(v, event_stream(v.spark, v.dir, None), each)
        w.close()
        closed(w.last)
        runs = v.spark.read.schema("customer_id long, first_end timestamp, last_end timestamp").parquet(folder)
        windows = runs.groupBy("customer_id").agg(F.sum(D.number(step)).alias(name))
        t = windows if t is None else t.join(windows, "customer_id", "full")
    t = online.read().join(S.merged(t), "customer_id", "left")
    return t.select("customer_id", "txn_count_24h", "spend_24h", "txn_count_7d", "discount_rate_7d", "quality.computed_via", F.coalesce("history_24h", F.lit(0)).alias("history_24h"), F.coalesce("history_7d", F.lit(0)).alias("history_7d"))
