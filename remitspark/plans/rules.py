"""Queries of the quarantine rules, batch forms."""

from pyspark.sql import functions as F

from remitspark.functions.stats import interpolated
from remitspark.operators import rules as R
from remitspark.registry import query
from remitspark.sources.scratch import shared_folder
from remitspark.views import AS_OF_EVENTS, AS_OF_ORDERS, clock, stamp

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def billed(v):
    """Transactions with what the rules look at: customer's promotions and home, discounts, splits, lock-in."""
    more = [F.sum("discount").alias("discount"), F.array_sort(F.collect_set("product_ref")).alias("purchased")]  # a transaction has few lines
    t = v.txn_with(*more).withColumnRenamed("total", "amount").join(v.customer, "customer_id", "left")
    k = F.col("transaction_id")
    cents = lambda c: c.cast("decimal(18,2)")
    return t.withColumns({
        "lock_in": k % 4 == 0, "billed_delta": (k % 10).cast("decimal(18,2)"), "gross": F.col("amount"),
        "earned": F.when(k % 6 != 0, cents(F.col("amount") * F.lit("0.4").cast("decimal(2,1)"))),
        "unearned": cents(F.col("amount") - cents(F.col("amount") * F.lit("0.4").cast("decimal(2,1)"))) + (k % 2).cast("decimal(18,2)"),
        "mid_cycle": F.dayofmonth("ts") > 14, "proration": F.when(k % 8 != 0, (k % 120).cast("decimal(18,2)")), "expected_proration": F.lit("100").cast("decimal(18,2)"),
    })


BILLED = """billed AS (SELECT t.* EXCLUDE (total), t.total AS amount, l.discount, l.purchased, c.promotions, c.home_state,
  t.transaction_id % 4 = 0 AS lock_in, CAST(t.transaction_id % 10 AS DECIMAL(18,2)) AS billed_delta, t.total AS gross,
  CASE WHEN t.transaction_id % 6 <> 0 THEN CAST(t.total * CAST(0.4 AS DECIMAL(2,1)) AS DECIMAL(18,2)) END AS earned,
  CAST(t.total - CAST(t.total * CAST(0.4 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS DECIMAL(18,2)) + CAST(t.transaction_id % 2 AS DECIMAL(18,2)) AS unearned,
  day(t.ts) > 14 AS mid_cycle, CASE WHEN t.transaction_id % 8 <> 0 THEN CAST(t.transaction_id % 120 AS DECIMAL(18,2)) END AS proration
  FROM txn t LEFT JOIN (SELECT transaction_id, sum(discount) AS discount, list_sort(list(DISTINCT product_ref)) AS purchased FROM items GROUP BY 1) l USING (transaction_id)
  LEFT JOIN cust c USING (customer_id))"""


@query("rul_01_discount_mismatch", f"WITH {BILLED} SELECT transaction_id, customer_id, CAST(discount AS DOUBLE) AS discount FROM billed WHERE discount > 100 AND len(promotions) = 0")
def rul_01(v):
    return R.discount_mismatch(billed(v), 100).select("transaction_id", "customer_id", F.col("discount").cast("double").alias("discount"))


@query("rul_02_velocity_anomaly", f"""SELECT customer_id, merchant_id, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total, {TS.format('min(ts)')} AS first_at
  FROM ev WHERE ts >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 259200 SECOND GROUP BY 1, 2 HAVING count(*) > 3""")
def rul_02(v):
    hits = R.velocity_anomaly(v.event, clock(AS_OF_EVENTS), 259200, 3)
    return hits.select("customer_id", "merchant_id", "n", F.col("total").cast("double").alias("total"), stamp("first_at", "first_at"))


#: Days of history that outliers of the rule set are judged by.
LOOKBACK = 1500
SINCE = f"ts >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL {LOOKBACK} DAY"


@query("rul_03_amount_outlier", """SELECT transaction_id, customer_id, CAST(total AS DOUBLE) AS amount, n_before, round(mean_before, 4) AS mean_before FROM (
  SELECT *, count(total) OVER w AS n_before, avg(CAST(total AS DOUBLE)) OVER w AS mean_before, coalesce(stddev_samp(CAST(total AS DOUBLE)) OVER w, 0) AS std_before
  FROM txn WINDOW w AS (PARTITION BY customer_id ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  WHERE n_before >= 5 AND abs(CAST(total AS DOUBLE) - mean_before) > 2 * std_before""")
def rul_03(v):
    """Every transaction against all of its customer's earlier ones; the rule set judges by a lookback."""
    hits = R.amount_outlier(v.bill.withColumnRenamed("total", "amount"), 2.0, minimum_history=5)
    return hits.select("transaction_id", "customer_id", F.col("amount").cast("double").alias("amount"), "n_before", F.round("mean_before", 4).alias("mean_before"))


ENTITLED = "ent AS (SELECT customer_id, list_sort(list(DISTINCT product_ref)) AS entitled FROM txn JOIN items USING (transaction_id) WHERE status = 'settled' GROUP BY 1)"


@query("rul_04_entitlement_mismatch", f"""WITH {BILLED}, {ENTITLED} SELECT transaction_id, customer_id, len(list_filter(purchased, lambda x: NOT list_contains(coalesce(entitled, []), x))) AS n_missing
  FROM billed LEFT JOIN ent USING (customer_id) WHERE txn_type = 'ppv_charge' AND len(list_filter(purchased, lambda x: NOT list_contains(coalesce(entitled, []), x))) > 0""")
def rul_04(v):
    found = R.entitlement_mismatch(billed(v).where("txn_type = 'ppv_charge'").join(entitled(v), "customer_id", "left"))
    return found.select("transaction_id", "customer_id", F.size("missing").cast("long").alias("n_missing"))


@query("rul_05_geographic_anomaly", f"WITH {BILLED} SELECT transaction_id, customer_id, txn_state, home_state FROM billed WHERE txn_state IS NOT NULL AND txn_state IS DISTINCT FROM home_state")
def rul_05(v):
    return R.geographic_anomaly(billed(v)).select("transaction_id", "customer_id", "txn_state", "home_state")


@query("rul_06_duplicate_transaction", """SELECT customer_id, merchant_id, count(*) AS n FROM ev GROUP BY 1, 2
  HAVING count(*) > 1 AND floor(epoch(max(ts))) - floor(epoch(min(ts))) <= 1209600""")
def rul_06(v):
    return R.duplicate_transaction(v.event, 1209600, ("customer_id", "merchant_id")).select("customer_id", "merchant_id", "n")


@query("rul_07_termination_fee_check", f"WITH {BILLED} SELECT transaction_id, customer_id, CAST(amount AS DOUBLE) AS amount FROM billed WHERE txn_type = 'termination_fee' AND amount >= 50 AND (lock_in OR abs(coalesce(billed_delta,0)) > 5)")
def rul_07(v):
    return R.termination_fee_check(billed(v), 50, 5).select("transaction_id", "customer_id", F.col("amount").cast("double").alias("amount"))


@query("rul_08_unearned_earned", f"WITH {BILLED} SELECT transaction_id, txn_type, earned IS NULL AS split_missing FROM billed WHERE txn_type IN ('subscription_charge','addon_charge','addon_purchase') AND (earned IS NULL OR unearned IS NULL OR abs(earned + unearned - gross) > 0.5)")
def rul_08(v):
    return R.unearned_earned_segregation(billed(v)).select("transaction_id", "txn_type", F.col("earned").isNull().alias("split_missing"))


@query("rul_09_double_charge", f"""SELECT merchant_id, product_ref, count(*) AS n, len(list(DISTINCT charge_code)) AS n_codes FROM items WHERE charge_code IN ('CC_PPV_DIRECT','CC_BUNDLE_PPV')
  GROUP BY 1, 2 HAVING count(*) >= 2 AND len(list(DISTINCT charge_code)) >= 2 AND floor(epoch(max(shipped_at))) - floor(epoch(min(shipped_at))) <= 31536000""")
def rul_09(v):
    hits = R.double_charge_multi_code(v.items.withColumnRenamed("shipped_at", "ts"), ("CC_PPV_DIRECT", "CC_BUNDLE_PPV"), ("merchant_id", "product_ref"), 31536000)
    return hits.select("merchant_id", "product_ref", "n", F.size("codes").cast("long").alias("n_codes"))


@query("rul_10_proration_check", f"WITH {BILLED} SELECT transaction_id, CAST(proration AS DOUBLE) AS proration FROM billed WHERE mid_cycle AND (proration IS NULL OR abs(proration - 100) > 0.05 * 100)")
def rul_10(v):
    return R.proration_check(billed(v)).select("transaction_id", F.col("proration").cast("double").alias("proration"))


SAMPLE = 1000


@query("rul_11_backtest", f"""WITH {BILLED}, latest AS (SELECT * FROM billed ORDER BY ts DESC, transaction_id LIMIT {SAMPLE}), h AS (SELECT * FROM latest WHERE txn_state IS NOT NULL AND txn_state IS DISTINCT FROM home_state),
  f AS (SELECT * FROM h ORDER BY ts DESC, transaction_id LIMIT 50)
  SELECT 'geographic_anomaly' AS rule_type, {SAMPLE} AS sample_size, (SELECT count(*) FROM h) AS hit_count, (SELECT count(*) FROM h) / {SAMPLE}.0::DOUBLE AS hit_rate, (SELECT list_aggregate(list(CAST(transaction_id AS VARCHAR) ORDER BY ts DESC, transaction_id), 'string_agg', ',') FROM f) AS hits""")
def rul_11(v):
    """A rule on the latest transactions: hits, their share of the sample asked for, the first 50, newest first."""
    latest = billed(v).orderBy(F.desc("ts"), "transaction_id").limit(SAMPLE)
    t = R.backtest(latest, R.Rule("geographic_anomaly"), SAMPLE)
    return t.select("rule_type", "sample_size", "hit_count", "hit_rate", F.array_join(F.transform("hits", lambda x: x.cast("string")), ",").alias("hits"))


def rule_set():
    """One rule of each type; the proration rule is in shadow, a second discount rule is switched off."""
    return [
        R.Rule("discount_mismatch", {"min_discount": 100}), R.Rule("geographic_anomaly"), R.Rule("proration_check", mode="shadow"), R.Rule("amount_outlier", {"multiplier": 2.0, "minimum_history": 5, "lookback_days": LOOKBACK, "as_of": clock(AS_OF_ORDERS)}),
        R.Rule("entitlement_mismatch"), R.Rule("termination_fee_check", {"min_amount": 50, "delta_tolerance": 5}), R.Rule("unearned_earned_segregation"), R.Rule("discount_mismatch", enabled=False),
        R.Rule("velocity_anomaly", {"as_of": clock(AS_OF_ORDERS), "window_seconds": 200 * 86400, "max_transactions": 1, "group_by": ("customer_id",)}),
        R.Rule("duplicate_transaction", {"window_seconds": 30 * 86400, "fields": ("customer_id", "status")}),
        R.Rule("double_charge_multi_code", {"codes": ("CC_PPV_DIRECT", "CC_BUNDLE_PPV"), "match": ("merchant_id", "product_ref"), "window_seconds": 31536000}),
    ]


def entitled(v):
    """Products that a customer has settled."""
    settled = v.bill.where("status = 'settled'").join(v.items.select("transaction_id", "product_ref"), "transaction_id")
    return settled.groupBy("customer_id").agg(F.collect_set("product_ref").alias("entitled"))


def hits(v):
    """The rule set over transactions that are put together once and saved: lines are read for them, and for double charges."""
    folder = shared_folder(v.spark, "billed")
    billed(v).write.parquet(folder)
    t = v.spark.read.parquet(folder)
    settled = t.where("status = 'settled'").select("customer_id", F.explode("purchased").alias("p"))
    own = settled.groupBy("customer_id").agg(F.collect_set("p").alias("entitled"))
    return R.run_rules(t.join(own, "customer_id", "left"), rule_set(), v.items.withColumnRenamed("shipped_at", "ts"), lean=t)


HITS = f"""{BILLED}, {ENTITLED}, hist AS (SELECT *, count(x) OVER w AS n_before, avg(x) OVER w AS mean_before, coalesce(stddev_samp(x) OVER w, 0) AS std_before
  FROM (SELECT *, CASE WHEN {SINCE} THEN CAST(amount AS DOUBLE) END AS x FROM billed) LEFT JOIN ent USING (customer_id) WINDOW w AS (PARTITION BY customer_id ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  hits AS (SELECT 'discount_mismatch' AS rule_type, 'active' AS mode, transaction_id, customer_id FROM hist WHERE discount > 100 AND len(promotions) = 0
  UNION ALL SELECT 'geographic_anomaly', 'active', transaction_id, customer_id FROM hist WHERE txn_state IS NOT NULL AND txn_state IS DISTINCT FROM home_state
  UNION ALL SELECT 'proration_check', 'shadow', transaction_id, customer_id FROM hist WHERE mid_cycle AND (proration IS NULL OR abs(proration - 100) > 5)
  UNION ALL SELECT 'amount_outlier', 'active', transaction_id, customer_id FROM hist WHERE {SINCE} AND n_before >= 5 AND abs(x - mean_before) > 2 * std_before
  UNION ALL SELECT 'entitlement_mismatch', 'active', transaction_id, customer_id FROM hist WHERE len(list_filter(purchased, lambda x: NOT list_contains(coalesce(entitled, []), x))) > 0
  UNION ALL SELECT 'termination_fee_check', 'active', transaction_id, customer_id FROM hist WHERE txn_type = 'termination_fee' AND amount >= 50 AND (lock_in OR abs(coalesce(billed_delta, 0)) > 5)
  UNION ALL SELECT 'unearned_earned_segregation', 'active', transaction_id, customer_id FROM hist WHERE txn_type IN ('subscription_charge','addon_charge','addon_purchase') AND (earned IS NULL OR unearned IS NULL OR abs(earned + unearned - gross) > 0.5)
  UNION ALL SELECT 'velocity_anomaly', 'active', NULL, customer_id FROM billed WHERE ts >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 200 DAY GROUP BY customer_id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_transaction', 'active', NULL, customer_id FROM billed GROUP BY customer_id, status HAVING count(*) > 1 AND floor(epoch(max(ts))) - floor(epoch(min(ts))) <= 2592000
  UNION ALL SELECT 'double_charge_multi_code', 'active', NULL, NULL FROM items WHERE charge_code IN ('CC_PPV_DIRECT','CC_BUNDLE_PPV') GROUP BY merchant_id, product_ref
    HAVING count(*) >= 2 AND len(list(DISTINCT charge_code)) >= 2 AND floor(epoch(max(shipped_at))) - floor(epoch(min(shipped_at))) <= 31536000)"""


@query("udf_01_run_rules", f"WITH {HITS} SELECT rule_type, mode, transaction_id, customer_id FROM hits")
def udf_01(v):
    return hits(v)


@query("rul_12_hits_to_cases", f"WITH {HITS} SELECT 'case_' || transaction_id AS case_id, customer_id, list_aggregate(list_sort(list(rule_type)), 'string_agg', ',') AS rules, count(*) AS n_rules, CASE WHEN count(*) >= 3 THEN 'critical' WHEN count(*) = 2 THEN 'high' ELSE 'medium' END AS severity FROM hits WHERE mode = 'active' AND transaction_id IS NOT NULL GROUP BY transaction_id, customer_id")
def rul_12(v):
    g = hits(v).where("mode = 'active' and transaction_id is not null").groupBy("transaction_id", "customer_id").agg(F.array_sort(F.collect_list("rule_type")).alias("r"))
    n = F.size("r")
    sev = F.when(n >= 3, "critical").when(n == 2, "high").otherwise("medium")
    return g.select(F.concat(F.lit("case_"), "transaction_id").alias("case_id"), "customer_id", F.array_join("r", ",").alias("rules"), n.cast("long").alias("n_rules"), sev.alias("severity"))


@query("rul_13_rule_version_diff", """WITH ver AS (SELECT customer_id, ts, transaction_id, txn_type, status FROM txn),
  d AS (SELECT *, lag(txn_type) OVER w AS old_type, lag(status) OVER w AS old_status, row_number() OVER w AS rn FROM ver WINDOW w AS (PARTITION BY customer_id ORDER BY ts, transaction_id)),
  e AS (SELECT *, CASE WHEN rn > 1 AND (txn_type IS DISTINCT FROM old_type OR status IS DISTINCT FROM old_status) THEN 1 ELSE 0 END AS changed FROM d)
  SELECT customer_id, transaction_id, (rn > 1 AND txn_type IS DISTINCT FROM old_type)::INT + (rn > 1 AND status IS DISTINCT FROM old_status)::INT AS n_changed,
  CAST(1 + sum(changed) OVER (PARTITION BY customer_id ORDER BY ts, transaction_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS version FROM e""")
def rul_13(v):
    """Versions of a record: fields that changed since the one before; the version counts changes only."""
    from pyspark.sql import Window as W

    w = W.partitionBy("customer_id").orderBy("ts", "transaction_id")
    t = v.bill.select("customer_id", "ts", "transaction_id", "txn_type", "status").withColumn("rn", F.row_number().over(w))
    diffs = [F.when((F.col("rn") > 1) & ~F.col(c).eqNullSafe(F.lag(c).over(w)), F.struct(F.lit(c).alias("field"), F.lag(c).over(w).alias("old"), F.col(c).alias("new"))) for c in ("txn_type", "status")]
    t = t.withColumn("d0", diffs[0]).withColumn("d1", diffs[1]).withColumn("changes", F.filter(F.array("d0", "d1"), lambda x: x.isNotNull()))
    n = F.size("changes")
    version = 1 + F.sum((n > 0).cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0))
    return t.select("customer_id", "transaction_id", n.alias("n_changed"), version.alias("version"))


@query("rul_14_rule_performance", f"""WITH x AS (SELECT unnest(rules) AS rule_type, * EXCLUDE (rules), TIMESTAMP '{AS_OF_ORDERS}' - created_at AS age FROM cases), r AS (SELECT *, age <= INTERVAL 30 DAY AS recent, disposition = 'true_positive' AS tp, disposition = 'false_positive' AS fp FROM x),
  d AS (SELECT rule_type, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE fp) AS fp FROM r WHERE recent GROUP BY 1, 2), t AS (SELECT rule_type, list_aggregate(list(day || ':' || n || ':' || fp ORDER BY day), 'string_agg', ',') AS trend FROM d GROUP BY 1),
  g AS (SELECT rule_type, count(*) AS hits_total, count(*) FILTER (WHERE age <= INTERVAL 1 DAY) AS hits_24h, count(*) FILTER (WHERE age <= INTERVAL 7 DAY) AS hits_7d, count(*) FILTER (WHERE recent) AS hits_30d, {TS.format('max(created_at)')} AS last_hit,
  coalesce(count(*) FILTER (WHERE recent AND tp) / nullif(count(disposition) FILTER (WHERE recent), 0)::DOUBLE, 0) AS tp_rate_30d, coalesce(count(*) FILTER (WHERE recent AND fp) / nullif(count(disposition) FILTER (WHERE recent), 0)::DOUBLE, 0) AS fp_rate_30d,
  round(coalesce(quantile_cont(CAST(floor(epoch(resolved_at)) - floor(epoch(created_at)) AS BIGINT) / 60.0::DOUBLE, 0.5), 0), 4) AS median_minutes, CAST(coalesce(sum(amount) FILTER (WHERE recent AND tp), 0) AS DOUBLE) AS protected_30d, CAST(12 * count(*) FILTER (WHERE recent AND fp) AS DOUBLE) AS fp_cost_30d,
  CAST(coalesce(sum(amount) FILTER (WHERE recent AND tp), 0) - 12 * count(*) FILTER (WHERE recent AND fp) AS DOUBLE) AS net_30d FROM r GROUP BY 1)
  SELECT g.*, coalesce(trend, '') AS trend FROM g LEFT JOIN t USING (rule_type)""")
def rul_14(v):
    """Hits over four spans, rates, time to resolve, money protected against the cost of false alarms, and 30 days of
    hits and false alarms by day."""
    t = v.case.withColumn("rule_type", F.explode("rules"))
    since = lambda days: F.col("created_at") >= clock(AS_OF_ORDERS) - F.expr(f"INTERVAL {days} DAYS")
    tp, fp, recent = F.col("disposition") == "true_positive", F.col("disposition") == "false_positive", since(30)
    judged = F.count(F.when(recent, F.col("disposition"))).cast("double")
    rate = lambda x: F.coalesce(F.try_divide(F.count_if(recent & x).cast("double"), judged), F.lit(0.0))
    protected = F.coalesce(F.sum(F.when(recent & tp, F.col("amount"))), F.lit(0))
    cost = F.count_if(recent & fp) * 12
    minutes = interpolated(t.withColumn("m", (F.unix_timestamp("resolved_at") - F.unix_timestamp("created_at")) / 60.0), "m", ["rule_type"], {"median_minutes": 0.5})
    g = t.groupBy("rule_type").agg(
        F.count("*").alias("hits_total"), *[F.count_if(since(d)).alias(n) for d, n in ((1, "hits_24h"), (7, "hits_7d"), (30, "hits_30d"))], stamp(F.max("created_at"), "last_hit"), rate(tp).alias("tp_rate_30d"), rate(fp).alias("fp_rate_30d"),
        protected.cast("double").alias("protected_30d"), cost.cast("double").alias("fp_cost_30d"), (protected - cost).cast("double").alias("net_30d"),
    )
    days = t.where(recent).groupBy("rule_type", F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(fp).alias("fp"))
    trend = days.groupBy("rule_type").agg(F.array_sort(F.collect_list(F.concat_ws(":", "day", "n", "fp"))).alias("x")).select("rule_type", F.array_join("x", ",").alias("trend"))  # at most 31 days a rule
    g = g.join(minutes.drop("n"), "rule_type", "left").withColumn("median_minutes", F.round(F.coalesce("median_minutes", F.lit(0.0)), 4))
    return g.join(trend, "rule_type", "left").withColumn("trend", F.coalesce("trend", F.lit("")))


@query("rul_15_ab_comparison", """SELECT CASE WHEN customer_id % 100 < 30 THEN 'shadow' ELSE 'active' END AS arm, count(*) AS n_cases, count(DISTINCT customer_id) AS customers,
  count(*) FILTER (WHERE disposition = 'true_positive') AS tp, CAST(sum(amount) AS DOUBLE) AS amount FROM cases GROUP BY 1""")
def rul_15(v):
    arm = F.when(F.col("customer_id") % 100 < 30, "shadow").otherwise("active")
    return v.case.groupBy(arm.alias("arm")).agg(F.count("*").alias("n_cases"), F.count_distinct("customer_id").alias("customers"), F.count_if(F.col("disposition") == "true_positive").alias("tp"), F.sum("amount").cast("double").alias("amount"))
