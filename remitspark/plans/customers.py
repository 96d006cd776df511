"""Queries of customer analytics, features, drift, retrieval, data quality, migration and training sets."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.functions import stats as S
from remitspark.operators import cases as C
from remitspark.operators import people
from remitspark.operators import drift as K
from remitspark.operators.joins import as_of_join
from remitspark.operators.search import Search, completions, near_names, top_k
from remitspark.plans.relational import LAB, PUR, error_labels, purchases
from remitspark.registry import query
from remitspark.sources.scratch import shared_folder
from remitspark.streaming.split import split_by
from remitspark.streaming.tables import SnapshotTable, merged
from remitspark.views import AS_OF_EVENTS, AS_OF_ORDERS, clock, seconds, stamp


def T(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


NOW = f"TIMESTAMP '{AS_OF_EVENTS}'"


@query("cus_02_transaction_pattern", f"WITH b AS (SELECT * FROM txn WHERE ts >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 365 DAY), c AS (SELECT customer_id, charge_code, count(*) AS n, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, charge_code) AS rn FROM b JOIN items USING (transaction_id) GROUP BY 1, 2), k AS (SELECT customer_id, list_aggregate(list(charge_code ORDER BY rn), 'string_agg', ',') AS top_codes FROM c WHERE rn <= 3 GROUP BY 1) SELECT b.customer_id, count(*) AS n, CAST(sum(total) AS DOUBLE) / count(*) AS mean, round(stddev_pop(CAST(total AS DOUBLE)), 4) AS std, {T('min(ts)')} AS first_at, {T('max(ts)')} AS last_at, max(top_codes) AS top_codes FROM b LEFT JOIN k ON k.customer_id = b.customer_id GROUP BY 1")
def cus_02(v):
    b = v.bill.where(F.col("ts") >= clock(AS_OF_ORDERS) - F.expr("INTERVAL 365 DAYS"))
    w = W.partitionBy("customer_id").orderBy(F.desc("n"), "charge_code")
    codes = b.select("transaction_id", "customer_id").join(v.items.select("transaction_id", "charge_code"), "transaction_id").groupBy("customer_id", "charge_code").agg(F.count("*").alias("n"))
    top = codes.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("rn", "charge_code"))).alias("x"))
    g = b.groupBy("customer_id").agg(F.count("*").alias("n"), (F.sum("total").cast("double") / F.count("*")).alias("mean"), F.round(F.stddev_pop(F.col("total").cast("double")), 4).alias("std"), stamp(F.min("ts"), "first_at"), stamp(F.max("ts"), "last_at"))
    return g.join(top.select("customer_id", F.array_join(F.transform("x", lambda e: e["charge_code"]), ",").alias("top_codes")), "customer_id", "left")


FEAT = f"""feat AS (SELECT customer_id, count(*) AS n, (floor(epoch({NOW})) - floor(epoch(max(ts)))) / 60.0::DOUBLE AS minutes_silent, coalesce(CAST(sum(discount) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0), 0) AS discount_rate,
  count(*) FILTER (WHERE merchant_id = 'error') AS quarantines, CAST(coalesce(sum(amount) FILTER (WHERE ts >= {NOW} - INTERVAL 7 DAY), 0) AS DOUBLE) AS spend_7d, count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 1 HOUR) AS n_1h, count(*) FILTER (WHERE ts >= {NOW} - INTERVAL 1 DAY) AS n_24h, CAST(coalesce(sum(amount) FILTER (WHERE ts >= {NOW} - INTERVAL 1 DAY), 0) AS DOUBLE) AS spend_24h FROM ev GROUP BY 1)"""


def features(v):
    e, since = v.event, lambda x: F.col("ts") >= clock(AS_OF_EVENTS) - F.expr(f"INTERVAL {x}")
    return e.groupBy("customer_id").agg(
        F.count("*").alias("n"), (seconds(clock(AS_OF_EVENTS), F.max("ts")) / 60.0).alias("minutes_silent"),
        F.coalesce(F.try_divide(F.sum("discount").cast("double"), F.sum("amount").cast("double")), F.lit(0.0)).alias("discount_rate"),
        F.count_if(F.col("merchant_id") == "error").alias("quarantines"), F.coalesce(F.sum(F.when(since("7 DAYS"), F.col("amount"))), F.lit(0)).cast("double").alias("spend_7d"),
        F.count_if(since("1 HOUR")).alias("n_1h"), F.count_if(since("1 DAY")).alias("n_24h"),
        F.coalesce(F.sum(F.when(since("1 DAY"), F.col("amount"))), F.lit(0)).cast("double").alias("spend_24h"),
    )


@query("fea_07_missing_writers", f"WITH {FEAT} SELECT customer_id, n_1h, n_24h, discount_rate, quarantines, minutes_silent FROM feat")
def fea_07(v):
    return features(v).select("customer_id", "n_1h", "n_24h", "discount_rate", "quarantines", "minutes_silent")


@query("fea_08_spend_ratio", f"WITH {FEAT} SELECT customer_id, spend_7d / nullif(CAST(package_value AS DOUBLE), 0) AS ratio FROM feat JOIN cust USING (customer_id)")
def fea_08(v):
    return features(v).join(v.customer, "customer_id").select("customer_id", F.try_divide("spend_7d", F.col("package_value").cast("double")).alias("ratio"))


@query("fea_09_freshness", f"WITH a AS (SELECT customer_id, CAST(floor(epoch({NOW})) - floor(epoch(max(ts))) AS BIGINT) AS age FROM ev GROUP BY 1), l AS (SELECT * FROM a ORDER BY age, customer_id LIMIT 200), o AS (SELECT age, row_number() OVER (ORDER BY age) AS rn, count(*) OVER () AS n FROM l) SELECT round(quantile_cont(CAST(age AS DOUBLE), 0.5), 4) AS median, max(CASE WHEN rn = CAST(ceil(0.95 * n) AS BIGINT) THEN age END) AS p95, max(age) AS oldest, count(*) FILTER (WHERE age <= 36000) / count(*)::DOUBLE AS fresh_share FROM o")
def fea_09(v):
    a = v.event.groupBy("customer_id").agg(seconds(clock(AS_OF_EVENTS), F.max("ts")).alias("age")).orderBy("age", "customer_id").limit(200)
    g = a.agg(F.round(F.percentile("age", 0.5), 4).alias("median"), F.max("age").alias("oldest"), (F.count_if(F.col("age") <= 36000) / F.count("*").cast("double")).alias("fresh_share"))
    return g.crossJoin(F.broadcast(S.nearest_rank(a, "age", [], 0.95, "ceiling", "p95")))  # one row each


@query("fea_10_staleness", f"SELECT c_custkey AS customer_id, coalesce(floor(epoch({NOW})) - floor(epoch(max(ts))) > 7200, true) AS is_stale FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1")
def fea_10(v):
    last = v.event.groupBy("customer_id").agg(F.max("ts").alias("at"))
    return v.customer.join(last, "customer_id", "left").select("customer_id", F.coalesce(seconds(clock(AS_OF_EVENTS), F.col("at")) > 7200, F.lit(True)).alias("is_stale"))


@query("fea_06_latest_snapshot", f"WITH {FEAT} SELECT customer_id, name, coalesce(n, 0) AS txn_count, coalesce(spend_7d, 0) AS spend_7d FROM cust LEFT JOIN feat USING (customer_id)")
def fea_06(v):
    return v.customer.join(features(v), "customer_id", "left").select("customer_id", "name", F.coalesce("n", F.lit(0)).alias("txn_count"), F.coalesce("spend_7d", F.lit(0.0)).alias("spend_7d"))


#: Features that are shown, with their unit.
UNITS = {
    "txn_count_5m": "count", "txn_count_1h": "count", "txn_count_24h": "count", "txn_count_7d": "count", "txn_count_total": "count", "quarantine_count_30d": "count",
    "amount_sum_5m": "myr", "spend_24h_myr": "myr", "spend_7d_myr": "myr", "package_value_myr": "myr", "discount_rate_7d": "ratio", "spend_to_package_ratio": "ratio",
}
SPANS = {"5m": "5 MINUTE", "1h": "1 HOUR", "24h": "1 DAY", "7d": "7 DAY", "30d": "30 DAY"}


def sql_latest():
    n = lambda k, more="": f"CAST(count(*) FILTER (WHERE ts >= {NOW} - INTERVAL {SPANS[k]} {more}) AS DOUBLE)"
    s = lambda k, c="amount": f"CAST(coalesce(sum({c}) FILTER (WHERE ts >= {NOW} - INTERVAL {SPANS[k]}), 0) AS DOUBLE)"
    made = {f"txn_count_{k}": n(k) for k in ("5m", "1h", "24h", "7d")} | {"txn_count_total": "CAST(count(*) AS DOUBLE)", "quarantine_count_30d": n("30d", "AND merchant_id = 'error'"), "amount_sum_5m": s("5m"), "spend_24h_myr": s("24h"), "spend_7d_myr": s("7d"), "package_value_myr": "CAST(any_value(package_value) AS DOUBLE)", "discount_rate_7d": f"{s('7d', 'discount')} / nullif({s('7d')}, 0)", "spend_to_package_ratio": f"{s('7d')} / nullif(CAST(any_value(package_value) AS DOUBLE), 0)"}
    each = " UNION ALL ".join(f"SELECT '{k}' AS name, '{u}' AS unit, {k} AS value, updated_at, customer_id FROM g" for k, u in UNITS.items())
    return f"WITH g AS (SELECT customer_id, max(ts) AS updated_at, {', '.join(f'{x} AS {k}' for k, x in made.items())} FROM ev LEFT JOIN cust USING (customer_id) GROUP BY 1), u AS ({each}) SELECT name, unit, arg_max(value, (updated_at, customer_id)) AS latest, {T('max(updated_at)')} AS updated_at FROM u WHERE value IS NOT NULL GROUP BY 1, 2"


@query("fea_11_latest_per_feature", sql_latest())
def fea_11(v):
    """Of each feature the value of the customer that was updated last (ties: the largest id), nulls passed over."""
    since = lambda k: F.col("ts") >= clock(AS_OF_EVENTS) - F.expr(f"INTERVAL {SPANS[k]}")
    n = lambda k: F.count_if(since(k)).cast("double")
    s = lambda k, c="amount": F.coalesce(F.sum(F.when(since(k), F.col(c))), F.lit(0)).cast("double")
    g = v.event.groupBy("customer_id").agg(
        F.max("ts").alias("updated_at"), *[n(k).alias(f"txn_count_{k}") for k in ("5m", "1h", "24h", "7d")], F.count("*").cast("double").alias("txn_count_total"), F.count_if(since("30d") & (F.col("merchant_id") == "error")).cast("double").alias("quarantine_count_30d"),
        s("5m").alias("amount_sum_5m"), s("24h").alias("spend_24h_myr"), s("7d").alias("spend_7d_myr"), F.try_divide(s("7d", "discount"), s("7d")).alias("discount_rate_7d"),
    ).join(v.customer.select("customer_id", F.col("package_value").cast("double").alias("package_value_myr")), "customer_id", "left")
    g = g.withColumn("spend_to_package_ratio", F.try_divide("spend_7d_myr", "package_value_myr"))
    order = F.struct("updated_at", "customer_id")
    latest = g.agg(*[F.max(F.when(F.col(k).isNotNull(), F.struct(order.alias("at"), F.col(k).alias("value")))).alias(k) for k in UNITS])  # one row
    rows = latest.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(u).alias("unit"), F.col(k).alias("x")) for k, u in UNITS.items()])).alias("r")).where("r.x is not null")
    return rows.select("r.name", "r.unit", F.col("r.x.value").alias("latest"), stamp("r.x.at.updated_at", "updated_at"))


@query("fea_04_pull_through", "WITH o AS (SELECT customer_id, event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE amount END AS a, ts FROM ev) SELECT customer_id, CAST(arg_max(a, (ts, event_id)) FILTER (WHERE a IS NOT NULL) AS DOUBLE) AS last_amount FROM o GROUP BY 1")
def fea_04(v):
    a = F.when(F.col("event_id") % 3 != 0, F.col("amount"))
    t = v.event.withColumn("a", a)
    return t.groupBy("customer_id").agg(F.max_by("a", F.when(F.col("a").isNotNull(), F.struct("ts", "event_id"))).cast("double").alias("last_amount"))


@query("fea_05_quality_patch", f"WITH {FEAT} SELECT customer_id, least(greatest(n / 60.0::DOUBLE, 0), 1) AS confidence, CASE WHEN n_24h = 0 THEN 'n_24h' ELSE '' END AS missing FROM feat")
def fea_05(v):
    return features(v).select("customer_id", F.least(F.greatest(F.col("n") / F.lit(60.0), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.when(F.col("n_24h") == 0, "n_24h").otherwise("").alias("missing"))


CHURN = f"""opn AS (SELECT customer_id, count(*) AS open_cases FROM cases WHERE status IN ('open', 'under_review') GROUP BY 1),
  subs AS (SELECT customer_id, count(*) FILTER (WHERE txn_type = 'subscription_charge' AND status = 'pending') AS idle_subs, count(*) FILTER (WHERE txn_type = 'subscription_charge' AND status <> 'pending') AS live_subs, count(*) FILTER (WHERE txn_type = 'ppv_charge' AND ts >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 365 DAY) AS recent_ppv FROM txn GROUP BY 1),
  known AS (SELECT c.customer_id, package_value, len(promotions) AS n_promos, minutes_silent, quarantines, discount_rate, coalesce(spend_24h, 0) AS spend_24h, coalesce(n, 0) AS recent, coalesce(open_cases, 0) AS open_cases, coalesce(idle_subs, 0) AS idle_subs, coalesce(live_subs, 0) AS live_subs, coalesce(recent_ppv, 0) AS recent_ppv, spend_7d / nullif(CAST(package_value AS DOUBLE), 0) AS ratio
    FROM cust c LEFT JOIN feat USING (customer_id) LEFT JOIN opn USING (customer_id) LEFT JOIN subs USING (customer_id)),
  drv AS (SELECT *, list_filter([CASE WHEN minutes_silent > 20160 THEN {{'n': 'no_txn_in_14d', 'w': 40}} WHEN minutes_silent > 10080 THEN {{'n': 'no_txn_in_7d', 'w': 20}} END, CASE WHEN ratio > 0 AND ratio < 0.30::DOUBLE THEN {{'n': 'low_package_utilisation', 'w': 15}} END, CASE WHEN quarantines >= 3 THEN {{'n': 'recent_quarantines', 'w': 15}} END,
    CASE WHEN open_cases >= 2 THEN {{'n': 'multiple_open_cases', 'w': 10}} END, CASE WHEN idle_subs >= 1 THEN {{'n': 'inactive_subscription', 'w': 10}} END, CASE WHEN discount_rate > 0.25::DOUBLE THEN {{'n': 'high_discount_dependency', 'w': 5}} END], lambda x: x IS NOT NULL) AS hits FROM known),
  told AS (SELECT *, CASE WHEN len(hits) = 0 AND recent = 0 THEN [{{'n': 'no_recent_activity', 'w': 30}}] ELSE hits END AS d FROM drv),
  churn AS (SELECT *, least(100, coalesce(list_sum(list_transform(d, lambda x: x.w)), 0)) / 100.0::DOUBLE AS score, array_to_string(list_transform(d, lambda x: x.n), ',') AS drivers FROM told)"""
BAND = "CASE WHEN score >= 0.65 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END"


def churn(v):
    """Every customer with the drivers of churn and their score; who has none and no activity either gets one for that."""
    opened = v.case.where(F.col("status").isin("open", "under_review")).groupBy("customer_id").agg(F.count("*").alias("open_cases"))
    kind = F.col("txn_type")
    sub = kind == "subscription_charge"
    year = F.col("ts") >= clock(AS_OF_ORDERS) - F.expr("INTERVAL 365 DAYS")
    bills = v.bill.groupBy("customer_id").agg(F.count_if(sub & (F.col("status") == "pending")).alias("idle_subs"), F.count_if(sub & (F.col("status") != "pending")).alias("live_subs"), F.count_if((kind == "ppv_charge") & year).alias("recent_ppv"))
    t = v.customer.join(features(v), "customer_id", "left").join(opened, "customer_id", "left").join(bills, "customer_id", "left")
    t = t.na.fill(0, ["open_cases", "idle_subs", "live_subs", "recent_ppv", "spend_24h"]).withColumn("recent", F.coalesce("n", F.lit(0))).withColumn("ratio", F.try_divide("spend_7d", F.col("package_value").cast("double")))
    return people.churn_score(t)


@query("cus_03_churn_score", f"WITH {FEAT}, {CHURN} SELECT customer_id, score, {BAND} AS band, drivers FROM churn")
def cus_03(v):
    return churn(v).select("customer_id", "score", people.churn_band(F.col("score")).alias("band"), F.array_join("drivers", ",").alias("drivers"))


@query("cus_04_next_best_offers", f"""WITH {FEAT}, {CHURN}, o AS (SELECT customer_id, list_filter([CASE WHEN score >= 0.65 THEN {{'p': 1, 'k': 1, 'o': 'retention_discount', 'u': CAST(round(package_value * 2.55, 2) AS DECIMAL(18,2))}} END, CASE WHEN ratio > 0.85::DOUBLE AND package_value > 0 THEN {{'p': CASE WHEN score >= 0.65 THEN 3 ELSE 2 END, 'k': 2, 'o': 'upgrade', 'u': CAST(round(package_value * 0.30, 2) AS DECIMAL(18,2))}} END,
    CASE WHEN recent_ppv >= 3 THEN {{'p': 3, 'k': 3, 'o': 'addon', 'u': CAST(15 AS DECIMAL(18,2))}} END, CASE WHEN live_subs = 0 THEN {{'p': 4, 'k': 4, 'o': 'winback', 'u': CAST(0 AS DECIMAL(18,2))}} END, CASE WHEN score < 0.35 AND spend_24h > 100 AND n_promos = 0 THEN {{'p': 5, 'k': 5, 'o': 'loyalty_perk', 'u': CAST(25 AS DECIMAL(18,2))}} END], lambda x: x IS NOT NULL) AS x FROM churn)
  SELECT customer_id, array_to_string(list_transform(list_sort(x), lambda e: e.p || ':' || e.o || ':' || e.u), ',') AS offers FROM o""")
def cus_04(v):
    shown = F.transform("offers", lambda o: F.concat_ws(":", o["priority"].cast("string"), o["offer"], o["uplift"].cast("string")))
    return people.with_offers(churn(v)).select("customer_id", F.array_join(shown, ",").alias("offers"))


@query("cus_07_marketing_funnel", "SELECT event_id % 6 AS campaign, count(*) FILTER (WHERE merchant_id = 'view') AS views, count(*) FILTER (WHERE merchant_id = 'click') AS clicks, count(*) FILTER (WHERE merchant_id = 'purchase') AS purchases, CAST(sum(CASE WHEN merchant_id = 'purchase' THEN amount ELSE 0 END) AS DOUBLE) AS revenue FROM ev GROUP BY 1")
def cus_07(v):
    is_ = lambda k: F.count_if(F.col("merchant_id") == k)
    return v.event.groupBy((F.col("event_id") % 6).alias("campaign")).agg(is_("view").alias("views"), is_("click").alias("clicks"), is_("purchase").alias("purchases"), F.sum(F.when(F.col("merchant_id") == "purchase", F.col("amount")).otherwise(0)).cast("double").alias("revenue"))


@query("cus_10_revenue_by_entity", "WITH m AS (SELECT entity, strftime(ts, '%Y') AS y, sum(total) AS s FROM txn JOIN cust USING (customer_id) GROUP BY 1, 2) SELECT entity, CAST(sum(s) AS DOUBLE) AS revenue, list_aggregate(list(CAST(s AS VARCHAR) ORDER BY y), 'string_agg', '|') AS trend FROM m GROUP BY 1")
def cus_10(v):
    m = v.bill.join(v.customer.select("customer_id", "entity"), "customer_id").groupBy("entity", F.date_format("ts", "yyyy").alias("y")).agg(F.sum("total").alias("s"))
    g = m.groupBy("entity").agg(F.sum("s").cast("double").alias("revenue"), F.array_sort(F.collect_list(F.struct("y", "s"))).alias("x"))
    return g.select("entity", "revenue", F.array_join(F.transform("x", lambda e: e["s"].cast("string")), "|").alias("trend"))


@query("cus_11_entity_health", f"WITH {FEAT}, {CHURN}, e AS (SELECT entity, count(*) AS subscribers, CAST(sum(c.package_value) AS DOUBLE) AS mrr, round(avg(score), 6) AS churn FROM cust c LEFT JOIN churn USING (customer_id) GROUP BY 1) SELECT entity, subscribers, mrr, churn, CASE WHEN churn >= 0.5 THEN 'critical' WHEN churn >= 0.25 THEN 'watch' ELSE 'healthy' END AS health FROM e")
def cus_11(v):
    t = v.customer.join(churn(v).select("customer_id", "score"), "customer_id", "left")
    g = t.groupBy("entity").agg(F.count("*").alias("subscribers"), F.sum("package_value").cast("double").alias("mrr"), F.round(F.avg("score"), 6).alias("churn"))
    return g.withColumn("health", S.band(F.col("churn"), [(0.5, "critical"), (0.25, "watch")], "healthy"))


@query("cus_12_split_by_type", "SELECT customer_id, customer_type, customer_type = 'commercial' AND parent_no = 0 AS is_parent FROM cust")
def cus_12(v):
    """Customers in a table for each type, and an index that says which, all under one version; read back through the index."""
    out = split_customers(v)
    sides = [out.table(k).select("customer_id", "is_parent") for k in ("residential", "commercial")]
    return out.table("index").select("customer_id", "customer_type").join(sides[0].unionByName(sides[1]), "customer_id").select("customer_id", "customer_type", "is_parent")


@query("cus_12_split_consistency", "SELECT 'residential' AS side, count(*) AS n, 0 AS strays FROM cust WHERE customer_type = 'residential' UNION ALL SELECT 'commercial', count(*), 0 FROM cust WHERE customer_type = 'commercial' UNION ALL SELECT 'index', count(*), 0 FROM cust")
def cus_12_check(v):
    """Rows of each output, and how many have no counterpart: none."""
    return split_customers(v).check("customer_id", "customer_type")


def split_customers(v):
    t = v.customer.withColumn("is_parent", (F.col("customer_type") == "commercial") & (F.col("parent_no") == 0))
    return split_by(t, "customer_type", ["residential", "commercial"], "customer_id", shared_folder(v.spark, "split"))


@query("cus_13_outlet_distribution", "WITH o AS (SELECT customer_id, parent_no, sum(total) AS r FROM cust JOIN txn USING (customer_id) WHERE customer_type = 'commercial' GROUP BY 1, 2) SELECT customer_id, parent_no, CAST(r AS DOUBLE) AS revenue, CAST(r AS DOUBLE) / CAST(sum(r) OVER (PARTITION BY parent_no) AS DOUBLE) AS share FROM o QUALIFY row_number() OVER (ORDER BY r DESC, customer_id) <= 10")
def cus_13(v):
    o = v.bill.join(v.customer.where("customer_type = 'commercial'").select("customer_id", "parent_no"), "customer_id").groupBy("customer_id", "parent_no").agg(F.sum("total").alias("r"))
    o = o.withColumn("all", F.sum("r").over(W.partitionBy("parent_no"))).orderBy(F.desc("r"), "customer_id").limit(10)
    return o.select("customer_id", "parent_no", F.col("r").cast("double").alias("revenue"), (F.col("r").cast("double") / F.col("all").cast("double")).alias("share"))


@query("cus_14_fill_missing", "SELECT customer_id, CASE WHEN len(promotions) = 0 THEN 'PROMO_DEFAULT' ELSE promotions[1] END AS promotion, len(promotions) = 0 AS filled FROM cust")
def cus_14(v):
    empty = F.size("promotions") == 0
    return v.customer.select("customer_id", F.when(empty, "PROMO_DEFAULT").otherwise(F.get("promotions", 0)).alias("promotion"), empty.alias("filled"))


@query("cus_16_embedding_freshness", f"WITH m AS (SELECT customer_id, min(ts) AS made_at FROM ev GROUP BY 1) SELECT vec_id, len(embedding) AS dim, {T('made_at')} AS made_at, CAST(floor((floor(epoch({NOW})) - floor(epoch(made_at))) / 86400) AS BIGINT) AS age_days, embedding IS NULL OR made_at IS NULL OR floor(epoch({NOW})) - floor(epoch(made_at)) > 29 * 86400 AS is_stale FROM embeddings LEFT JOIN m ON m.customer_id = vec_id")
def cus_16(v):
    """Vectors made when their customer was first seen; stale without a vector, without that time, or over 29 days old."""
    made = v.event.groupBy(F.col("customer_id").alias("vec_id")).agg(F.min("ts").alias("made_at"))
    age = seconds(clock(AS_OF_EVENTS), F.col("made_at"))
    stale = F.col("embedding").isNull() | F.col("made_at").isNull() | (age > 29 * 86400)
    t = v.table("embeddings").join(made, "vec_id", "left")
    return t.select("vec_id", F.size("embedding").cast("long").alias("dim"), stamp("made_at", "made_at"), F.floor(age / 86400).alias("age_days"), stale.alias("is_stale"))


@query("cus_17_array_element_edit", "SELECT case_id, array_to_string(list_transform(rules, lambda r: CASE WHEN r = 'velocity_anomaly' THEN r || ':dismissed' ELSE r || ':active' END), ',') AS edited FROM cases")
def cus_17(v):
    rows = F.transform("rules", lambda r: F.struct(r.alias("id"), F.lit("active").alias("status")))
    edited = F.transform(rows, lambda x: F.when(x["id"] == "velocity_anomaly", x.withField("status", F.lit("dismissed"))).otherwise(x))
    return v.case.select("case_id", F.array_join(F.transform(edited, lambda x: F.concat(x["id"], F.lit(":"), x["status"])), ",").alias("edited"))


# drift
DRIFT = f"""smp AS (SELECT merchant_id AS feature, CAST(amount AS DOUBLE) AS value, ts >= {NOW} - INTERVAL 7 DAY AS cur FROM ev), tie AS (SELECT feature, value, count(*) FILTER (WHERE cur) AS a, count(*) FILTER (WHERE NOT cur) AS b FROM smp GROUP BY 1, 2),
  cdf AS (SELECT feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature) AS na, sum(b) OVER (PARTITION BY feature) AS nb FROM tie WINDOW w AS (PARTITION BY feature ORDER BY value)),
  ks AS (SELECT feature, CAST(max(na) AS BIGINT) AS n_current, CAST(max(nb) AS BIGINT) AS n_baseline, max(abs(CAST(ca AS DOUBLE) / CAST(na AS DOUBLE) - CAST(cb AS DOUBLE) / CAST(nb AS DOUBLE))) AS d FROM cdf GROUP BY 1)"""


def samples(v):
    return v.event.select(F.col("merchant_id").alias("feature"), F.col("amount").cast("double").alias("value"), (F.col("ts") >= clock(AS_OF_EVENTS) - F.expr("INTERVAL 7 DAYS")).alias("is_current"))


def level(d):
    return f"CASE WHEN {d} >= 0.40 THEN 'alert' WHEN {d} >= 0.20 THEN 'warn' WHEN {d} >= 0.10 THEN 'watch' ELSE 'none' END"


@query("drf_01_ks_statistic", f"WITH {DRIFT} SELECT feature, n_current, n_baseline, d FROM ks")
def drf_01(v):
    return K.ks_statistic(samples(v))


P = "list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * exp(-2.0::DOUBLE * k * k * power((sqrt(n_current::DOUBLE * n_baseline / (n_current + n_baseline)) + 0.12::DOUBLE + 0.11::DOUBLE / sqrt(n_current::DOUBLE * n_baseline / (n_current + n_baseline))) * d, 2))))"


@query("drf_02_ks_p_value", f"WITH {DRIFT} SELECT feature, round(greatest(0, least(1, 2 * {P})), 6) AS p FROM ks")
def drf_02(v):
    return K.ks_statistic(samples(v)).select("feature", F.round(K.ks_p_value(F.col("d"), F.col("n_current").cast("double"), F.col("n_baseline").cast("double")), 6).alias("p"))


#: Drift of known size: of the k-th event type the current amounts are raised by k times 8 %.
SHIFTED = DRIFT.replace("smp AS (SELECT merchant_id AS feature, CAST(amount AS DOUBLE) AS value,", "smp AS (SELECT merchant_id AS feature, CAST(amount * (100 + CASE WHEN ts >= {NOW} - INTERVAL 7 DAY THEN 8 * list_position(['click','error','purchase','signup','view'], merchant_id) ELSE 0 END) AS DOUBLE) AS value,".replace("{NOW}", NOW))


def shifted(v):
    current = F.col("ts") >= clock(AS_OF_EVENTS) - F.expr("INTERVAL 7 DAYS")
    k = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("merchant_id"))
    value = (F.col("amount") * (F.lit(100) + F.when(current, 8 * k).otherwise(0))).cast("double")
    return v.event.select(F.col("merchant_id").alias("feature"), value.alias("value"), current.alias("is_current"))


@query("drf_03_severity", f"WITH {SHIFTED} SELECT feature, round(d, 9) AS d, {level('d')} AS severity FROM ks")
def drf_03(v):
    return K.ks_statistic(shifted(v)).select("feature", F.round("d", 9).alias("d"), K.severity(F.col("d")).alias("severity"))


CONS = "cons AS (SELECT event_type AS feature, count(DISTINCT user_id) % 3 AS consumers FROM events GROUP BY 1)"


def consumers(v):
    return v.event.groupBy(F.col("merchant_id").alias("feature")).agg((F.count_distinct("customer_id") % 3).alias("consumers"))


@query("drf_04_recommended_action", f"WITH {SHIFTED}, {CONS} SELECT feature, CASE WHEN d >= 0.40 AND consumers > 0 THEN 'alert_oncall' WHEN d >= 0.20 THEN 'investigate' ELSE 'monitor' END AS action FROM ks JOIN cons USING (feature)")
def drf_04(v):
    t = K.ks_statistic(shifted(v)).join(consumers(v), "feature")
    return t.select("feature", K.recommended_action(K.severity(F.col("d")), F.col("consumers")).alias("action"))


#: Ten daily ticks; the current sample is three days, the baseline the thirty before it. Of the k-th event type the current
#: amounts are raised by 3 k percent for each day of the tick's place in its week, so that severities move.
DAYS = 10
TICKS = f"""tk AS (SELECT i, {NOW} - to_days(CAST({DAYS} - 1 - i AS INTEGER)) AS tick FROM range({DAYS}) r(i)), smp AS (SELECT merchant_id AS feature, tick, ts >= tick - INTERVAL 3 DAY AS cur, CAST(amount * (100 + CASE WHEN ts >= tick - INTERVAL 3 DAY THEN 3 * (i % 7) * list_position(['click','error','purchase','signup','view'], merchant_id) ELSE 0 END) AS DOUBLE) AS value FROM ev JOIN tk ON ts < tick AND ts >= tick - INTERVAL 33 DAY),
  tie AS (SELECT feature, tick, value, count(*) FILTER (WHERE cur) AS a, count(*) FILTER (WHERE NOT cur) AS b FROM smp GROUP BY 1, 2, 3),
  cdf AS (SELECT feature, tick, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY feature, tick) AS na, sum(b) OVER (PARTITION BY feature, tick) AS nb FROM tie WINDOW w AS (PARTITION BY feature, tick ORDER BY value)),
  ks AS (SELECT feature, tick, CAST(max(na) AS BIGINT) AS n_current, CAST(max(nb) AS BIGINT) AS n_baseline, CASE WHEN max(na) = 0 OR max(nb) = 0 THEN 0 ELSE max(abs(CAST(ca AS DOUBLE) / nullif(CAST(na AS DOUBLE), 0) - CAST(cb AS DOUBLE) / nullif(CAST(nb AS DOUBLE), 0))) END AS d FROM cdf GROUP BY 1, 2),
  tick AS (SELECT *, {level('d')} AS severity FROM ks)"""


def days():
    import datetime as dt

    end = dt.datetime.fromisoformat(AS_OF_EVENTS)
    return [str(end - dt.timedelta(days=DAYS - 1 - i)) for i in range(DAYS)]


def daily(v, ticks=None):
    """Samples of each event type at each tick."""
    t = K.at_ticks(v.event.select(F.col("merchant_id").alias("feature"), "amount", "ts"), ticks or days(), "ts", 3, 30)
    first = F.lit(days()[0]).cast("timestamp_ntz")
    place = F.datediff("tick", first) % 7
    k = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("feature"))
    return t.select("feature", "tick", "is_current", (F.col("amount") * (F.lit(100) + F.when(F.col("is_current"), 3 * place * k).otherwise(0))).cast("double").alias("value"))


def severities(v, ticks=None):
    return K.ks_statistic(daily(v, ticks), also=("tick",)).withColumn("severity", K.severity(F.col("d")))


@query("drf_05_severity_progression", f"WITH {TICKS}, l AS (SELECT *, lag(severity) OVER (PARTITION BY feature ORDER BY tick) AS prev FROM tick) SELECT feature, strftime(tick, '%Y-%m-%d') AS day, prev AS from_sev, severity AS to_sev FROM l WHERE prev IS DISTINCT FROM severity")
def drf_05(v):
    """Two runs of five ticks each; the second goes on from the entries that the first has appended."""
    table = shared_folder(v.spark, "progression")
    read = v.spark.read.schema("feature string, tick timestamp_ntz, severity string, before string")
    history = v.spark.createDataFrame([], "feature string, tick timestamp_ntz, severity string, before string")
    for run in (days()[:5], days()[5:]):
        K.progression(history, severities(v, run)).write.mode("append").parquet(table)
        history = read.parquet(table)
    return history.select("feature", F.date_format("tick", "yyyy-MM-dd").alias("day"), F.col("before").alias("from_sev"), F.col("severity").alias("to_sev"))


SIDE = ", ".join(f"round({f}, 4) AS {c}_{n}" for c, g in (("mean", "avg(value) FILTER (WHERE {x})"), ("std", "stddev_samp(value) FILTER (WHERE {x})"), ("p50", "quantile_cont(value, 0.5) FILTER (WHERE {x})"), ("p95", "quantile_cont(value, 0.95) FILTER (WHERE {x})")) for n, x in (("current", "cur"), ("baseline", "NOT cur")) for f in [g.replace("{x}", x)])


@query("drf_06_drift_rows", f"WITH {TICKS}, m AS (SELECT feature, tick, {SIDE} FROM smp GROUP BY 1, 2) SELECT feature, strftime(tick.tick, '%Y-%m-%d') AS day, n_current, n_baseline, round(d, 9) AS d, severity, m.* EXCLUDE (feature, tick) FROM tick JOIN m USING (feature, tick)")
def drf_06(v):
    """Sizes, gap and severity, and mean, deviation, median and 95th percentile of both samples, of every tick in one job."""
    t = K.drift_rows(daily(v))
    sides = [F.round(f"{c}_{n}", 4).alias(f"{c}_{n}") for c in ("mean", "std", "p50", "p95") for n in ("current", "baseline")]
    return t.select("feature", F.date_format("tick", "yyyy-MM-dd").alias("day"), "n_current", "n_baseline", F.round("d", 9).alias("d"), "severity", *sides)


@query("drf_07_latest_snapshot", f"WITH {TICKS} SELECT feature, arg_max(severity, tick) AS latest, arg_max(severity, tick) <> 'none' AS drifting, bool_or(arg_max(severity, tick) <> 'none') OVER () AS any_drift FROM tick GROUP BY 1")
def drf_07(v):
    """Each feature's latest severity, and whether any feature drifts."""
    t = severities(v).groupBy("feature").agg(F.max_by("severity", "tick").alias("latest")).withColumn("drifting", F.col("latest") != "none")
    return t.crossJoin(t.agg(F.bool_or("drifting").alias("any_drift")))  # one row


NAMED = """named AS (SELECT DISTINCT merchant_id AS feature, customer_id % 6 AS k FROM ev WHERE merchant_id <> 'view'), last AS (SELECT feature, max(tick) AS tick, arg_max(d, tick) AS d, arg_max(severity, tick) AS severity FROM tick GROUP BY 1),
  who AS (SELECT l.feature, l.d, l.severity, count(k) AS n, count(k) FILTER (WHERE k % 3 = 0) AS rules, coalesce(string_agg('reader_' || k, ',' ORDER BY k), '') AS names FROM last l LEFT JOIN named USING (feature) GROUP BY 1, 2, 3)"""


def named(v):
    """Who reads a feature, by remainders of its customers: rules, models and some whose kind is not noted; views are read by nobody."""
    k = F.col("customer_id") % 6
    kind = F.when(k % 3 == 0, "rule").when(k % 3 == 1, "model")
    reader = F.struct(F.concat(F.lit("reader_"), k).alias("name"), kind.alias("type"))
    return v.event.where("merchant_id <> 'view'").groupBy(F.col("merchant_id").alias("feature")).agg(F.collect_set(reader).alias("consumers"))  # six at most


@query("drf_08_top_drifting", f"WITH {TICKS}, {NAMED}, wrote AS (SELECT merchant_id AS feature, count(DISTINCT customer_id) AS users FROM ev GROUP BY 1) SELECT feature, round(d, 9) AS d, severity, CASE WHEN n > 0 THEN n ELSE coalesce(users, 0) END AS concerned FROM who LEFT JOIN wrote USING (feature) ORDER BY who.d DESC, feature LIMIT 4")
def drf_08(v):
    """By the last tick; a feature without readers concerns the customers that have values of it."""
    wrote = v.event.groupBy(F.col("merchant_id").alias("feature")).agg(F.count_distinct("customer_id").alias("n"))
    return K.top_drifting(severities(v), named(v), wrote, 4).withColumn("d", F.round("d", 9))


@query("drf_09_impact", f"WITH {TICKS}, {NAMED} SELECT feature, n - rules AS models, rules, names, CASE WHEN severity = 'alert' AND n > 0 THEN 'alert_oncall' WHEN severity IN ('alert', 'warn') THEN 'investigate' ELSE 'monitor' END AS action FROM who")
def drf_09(v):
    return K.impact(severities(v), named(v)).withColumn("names", F.array_join("names", ","))


@query("drf_10_history", f"WITH {TICKS} SELECT feature, strftime(tick, '%Y-%m-%d') AS day, round(d, 9) AS d, severity FROM tick WHERE tick >= {NOW} - INTERVAL 7 DAY")
def drf_10(v):
    """A week of ticks, ascending."""
    t = severities(v).where(F.col("tick") >= clock(AS_OF_EVENTS) - F.expr("INTERVAL 7 DAYS")).orderBy("feature", "tick")
    return t.select("feature", F.date_format("tick", "yyyy-MM-dd").alias("day"), F.round("d", 9).alias("d"), "severity")


@query("drf_11_promotion_gate", f"WITH {TICKS}, {CONS}, l AS (SELECT feature, arg_max(severity, tick) AS latest FROM tick GROUP BY 1) SELECT feature, latest, latest = 'alert' AND consumers > 0 AS blocked FROM l JOIN cons USING (feature)")
def drf_11(v):
    """A model is not promoted while a feature that it reads is on alert."""
    l = severities(v).groupBy("feature").agg(F.max_by("severity", "tick").alias("latest"))
    return l.join(consumers(v), "feature").select("feature", "latest", ((F.col("latest") == "alert") & (F.col("consumers") > 0)).alias("blocked"))


@query("drf_12_mean_shift", f"WITH {DRIFT}, m AS (SELECT feature, avg(value) FILTER (WHERE cur) AS a, avg(value) FILTER (WHERE NOT cur) AS b FROM smp GROUP BY 1) SELECT feature, CASE WHEN b = 0 THEN 'became active' WHEN abs(a - b) / b < 0.05 THEN 'flat' WHEN abs(a - b) / b < 0.2 THEN 'moderate' ELSE 'ratio' END AS shift FROM m")
def drf_12(v):
    m = samples(v).groupBy("feature").agg(F.avg(F.when(F.col("is_current"), F.col("value"))).alias("a"), F.avg(F.when(~F.col("is_current"), F.col("value"))).alias("b"))
    r = F.try_divide(F.abs(F.col("a") - F.col("b")), F.col("b"))
    return m.select("feature", F.when(F.col("b") == 0, "became active").when(r < 0.05, "flat").when(r < 0.2, "moderate").otherwise("ratio").alias("shift"))


# retrieval and text
def cents(c):
    return f"(({c}) // 100) || '.' || lpad(CAST(({c}) % 100 AS VARCHAR), 2, '0')"


def in_cents(c):
    """Cents as text with two places."""
    return F.concat(F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def whole_cents(c):
    return F.floor(c * 100).cast("long")


def joined(parts, most, sep="; "):
    return F.array_join(F.slice(parts, 1, most), sep)


LINES = f"""li AS (SELECT *, CAST(floor(line_total * 100) AS BIGINT) AS lc, CAST(floor(quantity) AS BIGINT) AS q, CAST(floor(discount * 100) AS BIGINT) AS dc FROM items),
  tl AS (SELECT transaction_id, count(*) AS n, CAST(sum(lc) AS BIGINT) AS lc, CAST(sum(dc) AS BIGINT) AS dc, list_aggregate(list_sort(list(DISTINCT charge_code)), 'string_agg', ', ') AS codes,
  list_aggregate(list_slice(list(charge_code || ' x' || q || ' @' || {cents('lc // greatest(q, 1)')} || '=' || {cents('lc')} ORDER BY line_no, product_ref, merchant_id, lc), 1, 8), 'string_agg', '; ') AS lines,
  list_aggregate(list_slice(list('PROMO_' || (product_ref % 3) || ':percent=' || {cents('dc')} ORDER BY line_no, product_ref, merchant_id, lc) FILTER (WHERE dc > 0), 1, 6), 'string_agg', '; ') AS discounts FROM li GROUP BY 1)"""


def told_lines(v):
    """Per transaction: lines (at most 8), discounts (at most 6), codes and sums as text; a transaction has few lines."""
    t = v.items.select("transaction_id", "line_no", "product_ref", "merchant_id", "charge_code", whole_cents(F.col("line_total")).alias("lc"), F.floor("quantity").cast("long").alias("q"), whole_cents(F.col("discount")).alias("dc"))
    unit = F.floor(F.col("lc") / F.greatest(F.col("q"), F.lit(1)))
    line = F.concat("charge_code", F.lit(" x"), "q", F.lit(" @"), in_cents(unit), F.lit("="), in_cents(F.col("lc")))
    promo = F.when(F.col("dc") > 0, F.concat(F.lit("PROMO_"), F.col("product_ref") % 3, F.lit(":percent="), in_cents(F.col("dc"))))
    g = t.groupBy("transaction_id").agg(
        F.count("*").alias("n"), F.sum("lc").alias("lc"), F.sum("dc").alias("dc"), F.array_join(F.array_sort(F.collect_set("charge_code")), ", ").alias("codes"),
        F.array_sort(F.collect_list(F.struct("line_no", "product_ref", "merchant_id", "lc", line.alias("line"), promo.alias("promo")))).alias("x"),
    )
    promos = F.filter(F.transform("x", lambda e: e["promo"]), lambda p: p.isNotNull())
    return g.select("transaction_id", "n", "lc", "dc", "codes", joined(F.transform("x", lambda e: e["line"]), 8).alias("lines"), joined(promos, 6).alias("discounts"))


TOLD = f"""{LINES}, told AS (SELECT c.*, tl.n, codes, tl.lines, coalesce(discounts, '') AS discounts, coalesce(tl.dc * 2 > tl.lc, false) AS anomaly, k.customer_type, k.lifetime_quarantine_count AS prior, t.txn_type,
  list_aggregate(list_transform(c.rules, lambda r: r || ' (amount=' || {cents('CAST(floor(c.amount * 100) AS BIGINT)')} || ', lines=' || coalesce(tl.n, 0) || ', severity=' || severity || ', type=' || t.txn_type || ')'), 'string_agg', '; ') AS told_rules
  FROM cases c LEFT JOIN tl ON tl.transaction_id = c.case_id LEFT JOIN cust k USING (customer_id) LEFT JOIN txn t ON t.transaction_id = c.case_id)"""


def told(v):
    """Cases with all that their texts say; evidence is at most four pairs a rule."""
    t = v.case.join(told_lines(v).withColumnRenamed("transaction_id", "case_id"), "case_id", "left").join(merged(v.customer.select("customer_id", "customer_type", F.col("lifetime_quarantine_count").alias("prior"))), "customer_id", "left")
    t = t.join(merged(v.bill.select(F.col("transaction_id").alias("case_id"), "txn_type")), "case_id")
    pairs = F.array(F.concat(F.lit("amount="), in_cents(whole_cents(F.col("amount")))), F.concat(F.lit("lines="), F.coalesce("n", F.lit(0))), F.concat(F.lit("severity="), "severity"), F.concat(F.lit("type="), "txn_type"), F.concat(F.lit("status="), "status"))
    rules = F.array_join(F.transform("rules", lambda r: F.concat(r, F.lit(" ("), joined(pairs, 4, ", "), F.lit(")"))), "; ")
    return t.withColumns({"told_rules": rules, "anomaly": F.coalesce(F.col("dc") * 2 > F.col("lc"), F.lit(False)), "discounts": F.coalesce("discounts", F.lit(""))})


def part(label, c):
    """The labelled text where there is any."""
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.concat(F.lit(label), c))


def sql_part(label, c):
    return f"CASE WHEN coalesce(length({c}), 0) > 0 THEN '{label}' || {c} END"


@query("txt_01_case_text", f"WITH {TOLD} SELECT case_id, concat_ws(' | ', 'case of a ' || coalesce(customer_type, 'unknown') || ' customer, ' || coalesce(prior, 0) || ' earlier', 'severity ' || severity, {sql_part('rules ', 'told_rules')}, 'a ' || txn_type || ' of ' || {cents('CAST(floor(amount * 100) AS BIGINT)')} || CASE WHEN anomaly THEN ', discounted by more than half' ELSE '' END, {sql_part('codes ', 'codes')}, {sql_part('lines ', 'lines')}, {sql_part('discounts ', 'discounts')}, 'disposition ' || coalesce(disposition, 'open')) AS text FROM told")
def txt_01(v):
    head = F.concat(F.lit("case of a "), F.coalesce("customer_type", F.lit("unknown")), F.lit(" customer, "), F.coalesce("prior", F.lit(0)), F.lit(" earlier"))
    amount = F.concat(F.lit("a "), "txn_type", F.lit(" of "), in_cents(whole_cents(F.col("amount"))), F.when(F.col("anomaly"), ", discounted by more than half").otherwise(""))
    text = F.concat_ws(" | ", head, F.concat(F.lit("severity "), "severity"), part("rules ", F.col("told_rules")), amount, part("codes ", F.col("codes")), part("lines ", F.col("lines")), part("discounts ", F.col("discounts")), F.concat(F.lit("disposition "), F.coalesce("disposition", F.lit("open"))))
    return told(v).select("case_id", text.alias("text"))


HISTORY_TEXT = f"SELECT case_id, concat_ws(' | ', 'resolved case of a ' || coalesce(customer_type, 'unknown') || ' customer', 'severity ' || severity, 'final disposition ' || disposition, {sql_part('rules ', 'told_rules')}, {sql_part('codes ', 'codes')}, {sql_part('lines ', 'lines')}, {sql_part('discounts ', 'discounts')}, 'resolution: closed ' || CASE WHEN resolved_at IS NULL THEN 'at once' ELSE 'after ' || CAST(floor((floor(epoch(resolved_at)) - floor(epoch(created_at))) / 86400) AS BIGINT) || ' days' END) AS text FROM told WHERE disposition IS NOT NULL"


@query("txt_02_history_text", f"WITH {TOLD} {HISTORY_TEXT}")
def txt_02(v):
    days = F.floor(seconds(F.col("resolved_at"), F.col("created_at")) / 86400)
    closed = F.concat(F.lit("resolution: closed "), F.when(F.col("resolved_at").isNull(), "at once").otherwise(F.concat(F.lit("after "), days, F.lit(" days"))))
    text = F.concat_ws(" | ", F.concat(F.lit("resolved case of a "), F.coalesce("customer_type", F.lit("unknown")), F.lit(" customer")), F.concat(F.lit("severity "), "severity"), F.concat(F.lit("final disposition "), "disposition"), part("rules ", F.col("told_rules")), part("codes ", F.col("codes")), part("lines ", F.col("lines")), part("discounts ", F.col("discounts")), closed)
    return told(v).where("disposition is not null").select("case_id", text.alias("text"))


VALUE = "value AS (SELECT customer_id, CAST(floor(sum(total) * 100) AS BIGINT) AS ltv, count(*) AS bills, max(txn_type) AS last_type FROM txn GROUP BY 1)"
BANDED = "CASE WHEN ltv >= 2000000 THEN 'platinum' WHEN ltv >= 800000 THEN 'gold' WHEN ltv >= 200000 THEN 'silver' ELSE 'bronze' END"
OPEN = "open_cases AS (SELECT customer_id, count(*) AS n_open FROM cases WHERE status = 'open' GROUP BY 1)"


@query("txt_03_customer_text", f"WITH {FEAT}, {CHURN}, {VALUE}, {OPEN}, x AS (SELECT c.customer_id, concat_ws(' | ', c.customer_type || ' customer ' || name, 'in ' || home_state, 'of ' || entity, 'segment ' || segment, {sql_part('promotions ', 'array_to_string(promotions, chr(44))')}, 'package ' || {cents('CAST(floor(c.package_value * 100) AS BIGINT)')}, 'life-time value ' || {cents('coalesce(ltv, 0)')} || ' (' || {BANDED.replace('ltv >=', 'coalesce(ltv, 0) >=')} || ') in ' || coalesce(bills, 0) || ' bills', 'churn ' || CASE WHEN score IS NULL THEN 'unknown' WHEN score >= 0.645 THEN 'high' WHEN score >= 0.345 THEN 'medium' ELSE 'low' END, CASE WHEN n_open > 0 THEN n_open || ' open cases' END, 'earlier quarantines ' || lifetime_quarantine_count) AS text FROM cust c LEFT JOIN value USING (customer_id) LEFT JOIN churn ON churn.customer_id = c.customer_id LEFT JOIN open_cases o ON o.customer_id = c.customer_id) SELECT customer_id, text, length(text) < 200 AS thin FROM x")
def txt_03(v):
    """What the customer index holds; a text under 200 characters is thin."""
    value = v.bill.groupBy("customer_id").agg(whole_cents(F.sum("total")).alias("ltv"), F.count("*").alias("bills"))
    opened = v.case.where("status = 'open'").groupBy("customer_id").agg(F.count("*").alias("n_open"))
    t = v.customer.join(value, "customer_id", "left").join(churn(v).select("customer_id", "score"), "customer_id", "left").join(opened, "customer_id", "left")
    ltv = F.coalesce("ltv", F.lit(0))
    risk = F.when(F.col("score").isNull(), "unknown").otherwise(S.band(F.col("score"), [(0.645, "high"), (0.345, "medium")], "low"))
    text = F.concat_ws(
        " | ", F.concat("customer_type", F.lit(" customer "), "name"), F.concat(F.lit("in "), "home_state"), F.concat(F.lit("of "), "entity"), F.concat(F.lit("segment "), "segment"), part("promotions ", F.array_join("promotions", ",")),
        F.concat(F.lit("package "), in_cents(whole_cents(F.col("package_value")))), F.concat(F.lit("life-time value "), in_cents(ltv), F.lit(" ("), S.ltv_band(ltv / 100), F.lit(") in "), F.coalesce("bills", F.lit(0)), F.lit(" bills")),
        F.concat(F.lit("churn "), risk), F.when(F.col("n_open") > 0, F.concat("n_open", F.lit(" open cases"))), F.concat(F.lit("earlier quarantines "), "lifetime_quarantine_count"),
    )
    return t.select("customer_id", text.alias("text"), (F.char_length(text) < 200).alias("thin"))


VEC = "top AS (SELECT a.vec_id AS query_id, b.vec_id, b.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id {x} WHERE a.vec_id % 50 = 0)"


def asked(e):
    """The stated queries: vectors whose id is divisible by 50."""
    return e.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


@query("txt_04_vector_top_k", f"WITH {VEC.format(x='AND b.label <> 3')} SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 5")
def txt_04(v):
    """With a filter before the search: label 3 is no candidate."""
    e = v.table("embeddings")
    return top_k(asked(e), e.where("label <> 3"), 5).select("query_id", "vec_id", "score", F.col("place").cast("int").alias("rank"))


@query("txt_05_threshold", f"WITH {VEC.format(x='')} SELECT query_id, vec_id, score FROM top WHERE rank <= 20 AND score >= 0.2")
def txt_05(v):
    e = v.table("embeddings")
    return Search(e).nearest(asked(e), 20).at_least(0.2).limit(20).select("query_id", "vec_id", "score")


@query("txt_06_filtered_search", """WITH m AS (SELECT e.vec_id, embedding, customer_type, entity, package_value >= 2000 AS valued FROM embeddings e JOIN cust ON customer_id = e.vec_id),
  p AS (SELECT a.vec_id AS query_id, b.vec_id, b.customer_type, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM m a JOIN m b ON a.vec_id <> b.vec_id AND b.entity = a.entity AND b.valued WHERE a.vec_id % 50 = 0),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id, customer_type ORDER BY score DESC, vec_id) AS r FROM p), u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM t WHERE r <= 4)
  SELECT query_id, vec_id, customer_type, score, CAST(place AS INTEGER) AS rank FROM u WHERE place <= 4""")
def txt_06(v):
    """Customers' vectors in two indexes, residential and commercial, searched apart with filters on entity (the asking
    customer's) and value tier; hits of both are one ranking, cut to the limit."""
    m = v.table("embeddings").join(v.customer.select(F.col("customer_id").alias("vec_id"), "customer_type", "entity", (F.col("package_value") >= 2000).alias("valued")), "vec_id")
    parts = [Search(m).prefilter((F.col("customer_type") == kind) & F.col("valued")).nearest(asked(m), 4, ("entity",)) for kind in ("residential", "commercial")]
    return Search.merged(*parts).limit(4).select("query_id", "vec_id", "customer_type", "score", "rank")


NAMED = "asking AS (SELECT customer_id AS query_id, name FROM cust WHERE customer_id % 50 = 0)"


@query("txt_07_fuzzy_name", f"WITH {NAMED} SELECT query_id, customer_id, 'name' AS how, levenshtein(a.name, c.name) AS distance FROM asking a JOIN cust c ON levenshtein(a.name, c.name) <= 1 UNION ALL SELECT query_id, customer_id, 'typed', NULL FROM asking a JOIN cust c ON starts_with(c.name, substr(a.name, 1, 17)) UNION ALL SELECT query_id, customer_id, 'id', NULL FROM asking JOIN cust ON customer_id = query_id")
def txt_07(v):
    """Names within one edit of a name asked for, names that begin as typed so far (17 letters), and the exact id."""
    q = v.customer.where("customer_id % 50 = 0").select(F.col("customer_id").alias("query_id"), "name")
    none = F.lit(None).cast("long").alias("distance")
    near = near_names(q, v.customer).select("query_id", "customer_id", F.lit("name").alias("how"), F.col("distance").cast("long").alias("distance"))
    typed = completions(q.select("query_id", F.substring("name", 1, 17).alias("typed")), v.customer).select("query_id", "customer_id", F.lit("typed").alias("how"), none)
    exact = q.join(v.customer.select("customer_id"), F.col("query_id") == F.col("customer_id")).select("query_id", "customer_id", F.lit("id").alias("how"), none)
    return near.unionByName(typed).unionByName(exact)


# quality, migration, training
@query("dq_01_required_fields", "SELECT 'txn' AS tbl, count(*) FILTER (WHERE merchant_id IS NULL) AS no_merchant, count(*) FILTER (WHERE customer_id IS NULL) AS no_customer, count(*) AS n FROM txn")
def dq_01(v):
    return v.txn.agg(F.count_if(F.col("merchant_id").isNull()).alias("no_merchant"), F.count_if(F.col("customer_id").isNull()).alias("no_customer"), F.count("*").alias("n")).select(F.lit("txn").alias("tbl"), "*")


@query("dq_02_domains", "SELECT count(*) FILTER (WHERE status NOT IN ('settled','open','pending')) AS bad_status, count(*) FILTER (WHERE total < 0 OR total > 400000) AS bad_total FROM txn")
def dq_02(v):
    return v.bill.agg(F.count_if(~F.col("status").isin("settled", "open", "pending")).alias("bad_status"), F.count_if((F.col("total") < 0) | (F.col("total") > 400000)).alias("bad_total"))


@query("dq_03_array_constraints", "SELECT count(*) FILTER (WHERE len(rules) = 0) AS empty_rules, count(*) FILTER (WHERE len(list_filter(rules, lambda r: NOT r LIKE '%\\_%' ESCAPE '\\')) > 0) AS bad_names FROM cases")
def dq_03(v):
    return v.case.agg(F.count_if(F.size("rules") == 0).alias("empty_rules"), F.count_if(~F.forall("rules", lambda r: r.contains("_"))).alias("bad_names"))


@query("dq_04_unique_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_04(v):
    return v.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


MIGRATED = f"""k AS (SELECT customer_id, customer_type, lifetime_quarantine_count AS prior FROM cust WHERE customer_id % 11 <> 0), x AS (SELECT c.*, k.customer_type, k.prior, k.customer_id IS NOT NULL AS known, case_id % 4 = 0 AS was_new,
  CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 ELSE 0.25 END::DOUBLE AS w, CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 240 WHEN 'medium' THEN 1440 ELSE 4320 END AS minutes FROM cases c LEFT JOIN k USING (customer_id)),
  y AS (SELECT *, round_even(0.55::DOUBLE * w + 0.30::DOUBLE * least(1.0::DOUBLE, CAST(amount AS DOUBLE) / 5000.0::DOUBLE) + 0.10::DOUBLE * least(1.0::DOUBLE, CAST(prior AS DOUBLE) / 5.0::DOUBLE) + 0.05::DOUBLE * CAST(customer_type = 'commercial' AS INTEGER), 4) AS score FROM x)"""


@query("mig_01_case_upgrade", f"""WITH {MIGRATED} SELECT case_id, CASE WHEN was_new THEN 3 WHEN known THEN 3 ELSE 2 END AS schema_version, CASE WHEN NOT was_new AND known THEN score END AS priority_score,
  CASE WHEN NOT was_new AND known THEN CASE WHEN score >= 0.85 THEN 'P0' WHEN score >= 0.65 THEN 'P1' WHEN score >= 0.40 THEN 'P2' ELSE 'P3' END END AS priority_band,
  CASE WHEN NOT was_new AND known THEN strftime(created_at + to_minutes(minutes), '%Y-%m-%d %H:%M:%S') END AS sla_target, CASE WHEN NOT was_new AND known THEN 'open' || CASE WHEN status = 'resolved' THEN '>resolved' ELSE '' END END AS life,
  CASE WHEN NOT was_new AND known AND status = 'resolved' THEN strftime(resolved_at, '%Y-%m-%d %H:%M:%S') END AS ended_at FROM y""")
def mig_01(v):
    """A stored table with rows of two versions: three of four are of the older one and are upgraded where the customer is
    known; rows of this version (here: bare ones) stay as they are."""
    table, _ = migrated(v)
    t = table.read()
    stops = F.array_join(F.transform("lifecycle", lambda e: e["to_status"]), ">")
    ended = F.when(F.size("lifecycle") > 1, F.date_format(F.element_at("lifecycle", -1)["at"], "yyyy-MM-dd HH:mm:ss"))
    return t.select("case_id", "schema_version", "priority_score", "priority_band", stamp("sla_target", "sla_target"), F.when(F.col("lifecycle").isNotNull(), stops).alias("life"), ended.alias("ended_at"))


def migrated(v, runs=1):
    """The table after so many runs, and what each run told."""
    table = SnapshotTable(v.spark, shared_folder(v.spark, "cases"), C.CURRENT, ["case_id"])
    rows = v.case.withColumn("schema_version", F.when(F.col("case_id") % 4 == 0, 3).otherwise(2))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.types.fields if f.name not in rows.columns]
    table.apply(lambda old: rows.select("*", *none).select(*old.columns), 0)
    known = v.customer.where("customer_id % 11 <> 0").select("customer_id", "customer_type", F.col("lifetime_quarantine_count").alias("prior"))
    return table, [C.upgrade_step(table, known, k) for k in range(runs)]


@query("mig_01_upgrade_counts", f"WITH {MIGRATED}, c AS (SELECT count(*) FILTER (WHERE NOT was_new) AS s, count(*) FILTER (WHERE NOT was_new AND known) AS u FROM y) SELECT 1 AS run, unnest(['scanned', 'upgraded', 'skipped_unknown_customer']) AS outcome, unnest([s, u, s - u]) AS n FROM c UNION ALL SELECT 2, unnest(['scanned', 'upgraded', 'skipped_unknown_customer']), unnest([s - u, 0, s - u]) FROM c")
def mig_01_counts(v):
    """What two runs tell: the second finds only what the first could not upgrade."""
    _, told = migrated(v, 2)
    return told[0].withColumn("run", F.lit(1)).unionByName(told[1].withColumn("run", F.lit(2)))


@query("ml_01_training_set", f"WITH {LAB}, {PUR}, {FEAT} SELECT row_id, label, seen_id, n, discount_rate FROM (SELECT lab.*, pur.seen_id FROM lab ASOF LEFT JOIN pur ON lab.customer_id = pur.customer_id AND lab.label_at >= pur.seen_at) p JOIN feat f ON f.customer_id = p.customer_id")
def ml_01(v):
    pit = as_of_join(error_labels(v), purchases(v), ["customer_id"], "label_at", "seen_at", ["seen_id"])
    return pit.join(features(v), "customer_id").select("row_id", "label", "seen_id", "n", "discount_rate")


SCORED = "s AS (SELECT CAST(amount > 100 AS INTEGER) AS y, CAST(discount AS DOUBLE) AS s FROM ev WHERE discount IS NOT NULL), g AS (SELECT s, count(*) AS n, sum(y) AS p FROM s GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY s) AS c, sum(p) OVER (ORDER BY s) AS cp, CAST(sum(p) OVER () AS DOUBLE) AS tp, CAST(sum(n) OVER () AS DOUBLE) AS tn FROM g)"


@query("ml_04_roc_auc", f"WITH {SCORED} SELECT round((CAST(sum(p * (c - (n - 1) / 2.0::DOUBLE)) AS DOUBLE) - max(tp) * (max(tp) + 1) / 2) / (max(tp) * (max(tn) - max(tp))), 6) AS auc, round(sum(p / tp * ((tp - cp + p) / (tn - c + n))), 6) AS average_precision FROM r")
def ml_04(v):
    """How well the discount tells large amounts."""
    t = v.event.select((F.col("amount") > 100).cast("int").alias("y"), F.col("discount").cast("double").alias("s"))
    return S.ranking_quality(t, "y", "s").select(*[F.round(c, 6).alias(c) for c in ("auc", "average_precision")])
