"""Queries of projections, filters, joins, aggregates, windows, sorts, sets and scalar functions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.functions import stats as S
from remitspark.operators.joins import as_of_join, cycle_join, first_match
from remitspark.registry import query
from remitspark.views import AS_OF_EVENTS, AS_OF_ORDERS, clock, seconds, stamp


def T(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


D = lambda c, n: F.col(c).cast("double").alias(n)


@query("src_04_table_scan", "SELECT case_id, customer_id, disposition FROM cases WHERE disposition IS NOT NULL")
def src_04(v):
    return v.case.where("disposition is not null").select("case_id", "customer_id", "disposition")


@query("src_06_filtered_find", f"SELECT transaction_id, {T('ts')} AS ts FROM txn WHERE status = 'open' AND total > 1000 ORDER BY ts DESC, transaction_id LIMIT 40 OFFSET 20")
def src_06(v):
    return v.bill.where("status = 'open' and total > 1000").orderBy(F.desc("ts"), "transaction_id").offset(20).limit(40).select("transaction_id", stamp("ts", "ts"))


@query("prj_01_rename_compute_drop", "SELECT transaction_id, customer_id AS payer, CAST(total AS DOUBLE) AS amount_myr, 'batch' AS channel, status = 'settled' AS is_settled FROM txn")
def prj_01(v):
    t = v.bill.withColumnRenamed("customer_id", "payer").withColumns({"amount_myr": F.col("total").cast("double"), "channel": F.lit("batch"), "is_settled": F.col("status") == "settled"})
    return t.select("transaction_id", "payer", "amount_myr", "channel", "is_settled")


@query("prj_02_customer_summary", "SELECT customer_id, customer_type, promotions[1] AS first_promotion, len(promotions) AS n_promotions, home_state AS service_state, CASE WHEN customer_type = 'commercial' THEN entity END AS commercial_entity FROM cust")
def prj_02(v):
    return v.customer.select("customer_id", "customer_type", F.get("promotions", 0).alias("first_promotion"), F.size("promotions").cast("long").alias("n_promotions"), F.col("home_state").alias("service_state"), F.when(F.col("customer_type") == "commercial", F.col("entity")).alias("commercial_entity"))


@query("prj_05_transaction_summary", "SELECT transaction_id, list_aggregate(list_slice(list(product_ref ORDER BY line_no, product_ref, merchant_id, line_total, shipped_at), 1, 5), 'string_agg', ',') AS first_items, count(*) AS n_items, CAST(sum(line_total * tax_rate) AS DOUBLE) AS tax FROM items GROUP BY 1")
def prj_05(v):
    row = F.struct("line_no", "product_ref", "merchant_id", "line_total", "shipped_at")
    g = v.items.groupBy("transaction_id").agg(F.array_sort(F.collect_list(row)).alias("its"), F.sum(F.col("line_total") * F.col("tax_rate")).alias("tax"))
    return g.select("transaction_id", F.array_join(F.transform(F.slice("its", 1, 5), lambda i: i["product_ref"].cast("string")), ",").alias("first_items"), F.size("its").cast("long").alias("n_items"), D("tax", "tax"))


@query("prj_06_recent_transaction_embed", f"SELECT transaction_id, {T('ts')} AS ts, txn_type, CAST(total AS DOUBLE) AS total_myr, status, merchant_id, txn_state FROM txn WHERE ts >= TIMESTAMP '2001-01-01'")
def prj_06(v):
    t = v.txn.where(F.col("ts") >= clock("2001-01-01 00:00:00"))
    return t.select("transaction_id", stamp("ts", "ts"), "txn_type", D("total", "total_myr"), "status", "merchant_id", "txn_state")


@query("prj_07_open_case_embed", "SELECT case_id, list_aggregate(list_sort(list_distinct(rules)), 'string_agg', ',') AS rule_types, severity FROM cases WHERE status <> 'resolved' AND len(rules) > 0")
def prj_07(v):
    return v.case.where("status <> 'resolved' and size(rules) > 0").select("case_id", F.array_join(F.array_sort(F.array_distinct("rules")), ",").alias("rule_types"), "severity")


@query("prj_08_live_feed", "WITH q AS (SELECT DISTINCT case_id FROM cases WHERE len(rules) >= 2), f AS (SELECT transaction_id, charge_code FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY line_no, product_ref, merchant_id, line_total, shipped_at) rn FROM items) WHERE rn = 1) SELECT t.transaction_id, f.charge_code, CASE WHEN q.case_id IS NOT NULL THEN 'quarantined' ELSE 'clean' END AS feed_status FROM txn t LEFT JOIN f USING (transaction_id) LEFT JOIN q ON q.case_id = t.transaction_id")
def prj_08(v):
    first = v.items.groupBy("transaction_id").agg(F.min(F.struct("line_no", "product_ref", "merchant_id", "line_total", "shipped_at", "charge_code")).alias("f"))
    hit = v.case.where(F.size("rules") >= 2).select(F.col("case_id").alias("transaction_id"), F.lit(True).alias("hit"))
    t = v.bill.select("transaction_id").join(first, "transaction_id", "left").join(hit, "transaction_id", "left")
    return t.select("transaction_id", F.col("f.charge_code").alias("charge_code"), F.when(F.col("hit"), "quarantined").otherwise("clean").alias("feed_status"))


@query("prj_09_lean_projection", "SELECT customer_id, name, customer_type, entity FROM cust")
def prj_09(v):
    return v.customer.select("customer_id", "name", "customer_type", "entity")


@query("prj_10_stale_mask", "SELECT customer_id, name, 0::BIGINT AS n_recent, CAST(NULL AS DOUBLE) AS spend_24h, 'nightly' AS lag_source FROM cust")
def prj_10(v):
    t = v.customer.withColumn("recent", F.array().cast("array<bigint>")).withColumn("spend_24h", F.lit(None).cast("double"))
    return t.select("customer_id", "name", F.size("recent").cast("long").alias("n_recent"), "spend_24h", F.lit("nightly").alias("lag_source"))


@query("prj_11_related_case_row", "SELECT case_id, coalesce(rules[1], 'unknown') AS headline_rule, severity, status FROM cases")
def prj_11(v):
    return v.case.select("case_id", F.coalesce(F.get("rules", 0), F.lit("unknown")).alias("headline_rule"), "severity", "status")


@query("prj_12_canonical_features", "SELECT customer_id, coalesce(n, 0) AS txn_count, CAST(NULL AS DOUBLE) AS model_score FROM cust LEFT JOIN (SELECT customer_id, count(*) AS n FROM ev GROUP BY 1) USING (customer_id)")
def prj_12(v):
    counts = v.event.groupBy("customer_id").agg(F.count("*").alias("n"))
    return v.customer.join(counts, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("txn_count"), F.lit(None).cast("double").alias("model_score"))


@query("prj_13_preview", "SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 237) || '...' ELSE text END AS excerpt, least(greatest((n_chars - 500) / 4000.0::DOUBLE, 0), 1) AS score FROM documents")
def prj_13(v):
    excerpt = F.when(F.char_length("text") > 240, F.concat(F.substring("text", 1, 237), F.lit("..."))).otherwise(F.col("text"))
    return v.table("documents").select("doc_id", excerpt.alias("excerpt"), F.least(F.greatest((F.col("n_chars") - 500) / F.lit(4000.0), F.lit(0.0)), F.lit(1.0)).alias("score"))


@query("flt_01_comparison", "SELECT transaction_id FROM txn WHERE txn_type IN ('refund','ppv_charge') AND total >= 1000 AND total < 200000 AND status <> 'open'")
def flt_01(v):
    return v.bill.where(F.col("txn_type").isin("refund", "ppv_charge") & (F.col("total") >= 1000) & (F.col("total") < 200000) & (F.col("status") != "open")).select("transaction_id")


@query("flt_02_existence", "SELECT transaction_id, coalesce(txn_state, 'none') AS state FROM txn WHERE merchant_id IS NULL OR txn_state IS NOT NULL")
def flt_02(v):
    return v.txn.where(F.col("merchant_id").isNull() | F.col("txn_state").isNotNull()).select("transaction_id", F.coalesce("txn_state", F.lit("none")).alias("state"))


@query("flt_03_array_any", "SELECT case_id FROM cases WHERE list_contains(rules, 'geographic_anomaly')")
def flt_03(v):
    return v.case.where(F.exists("rules", lambda r: r == "geographic_anomaly")).select("case_id")


@query("flt_04_expression", "SELECT case_id FROM cases WHERE (severity = 'critical' OR amount > 300000) AND NOT (status = 'resolved' AND resolved_at < created_at + INTERVAL 30 DAY)")
def flt_04(v):
    fast = (F.col("status") == "resolved") & (F.col("resolved_at") < F.col("created_at") + F.expr("INTERVAL 30 DAYS"))
    return v.case.where(((F.col("severity") == "critical") | (F.col("amount") > 300000)) & ~fast).select("case_id")


@query("flt_05_type_coercion", "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) AS brand_no FROM part WHERE TRY_CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) IS NOT NULL")
def flt_05(v):
    n = F.expr("try_cast(replace(p_brand, 'Brand#', '') as double)")
    return v.table("part").withColumn("brand_no", n).where("brand_no is not null").select("p_partkey", "brand_no")


def case_queue(case, status=None, severity=None, rule=None, band=None):
    """Optional filters of the case queue, combined."""
    for c, x in (("status", status), ("severity", severity)):
        if x is not None:
            case = case.where(F.col(c) == x)
    if rule is not None:
        case = case.where(F.array_contains("rules", rule))
    return case if band is None else case.where(band)


@query("flt_06_case_queue", "SELECT case_id FROM cases WHERE status = 'open' AND severity = 'high' AND list_contains(rules, 'velocity_anomaly')")
def flt_06(v):
    return case_queue(v.case, "open", "high", "velocity_anomaly").select("case_id")


@query("flt_07_time_window", f"SELECT event_id FROM ev WHERE ts >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{AS_OF_EVENTS}'")
def flt_07(v):
    days = max(1, min(7, 365))
    return v.event.where((F.col("ts") >= clock(AS_OF_EVENTS) - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") < clock(AS_OF_EVENTS))).select("event_id")


@query("flt_08_rule_filter", "SELECT c_custkey AS rule_id, c_mktsegment AS rule_type FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0 AND c_nationkey < 13")
def flt_08(v):
    rules = v.table("customer").select(F.col("c_custkey").alias("rule_id"), F.col("c_mktsegment").alias("rule_type"), (F.col("c_acctbal") > 0).alias("enabled"), F.when(F.col("c_nationkey") < 13, "active").otherwise("shadow").alias("mode"))
    return rules.where((F.col("rule_type") == "MACHINERY") & F.col("enabled") & (F.col("mode") == "active")).select("rule_id", "rule_type")


@query("join_01_enrich_left", "SELECT event_id, home_state, customer_type FROM ev LEFT JOIN cust USING (customer_id)")
def join_01(v):
    return v.event.join(v.customer, "customer_id", "left").select("event_id", "home_state", "customer_type")


@query("join_02_enrich_inner", "SELECT transaction_id, home_state FROM txn JOIN cust USING (customer_id) WHERE customer_type = 'commercial'")
def join_02(v):
    return v.bill.join(v.customer.where("customer_type = 'commercial'"), "customer_id").select("transaction_id", "home_state")


@query("join_03_two_table_lookup", "SELECT customer_id, CASE WHEN customer_type = 'residential' OR customer_id % 4 = 0 THEN 'residential' ELSE 'commercial' END AS found_in FROM cust")
def join_03(v):
    res = v.customer.where("customer_type = 'residential' or customer_id % 4 = 0").select("customer_id", "name")
    com = v.customer.where("customer_type = 'commercial'").select("customer_id", "name", "entity")
    return first_match([("residential", res), ("commercial", com)], "customer_id").select("customer_id", "found_in")


@query("join_04_context_after_topk", "WITH top AS (SELECT case_id, customer_id, amount FROM cases ORDER BY amount DESC, case_id LIMIT 50) SELECT case_id, CAST(amount AS DOUBLE) AS amount, name, home_state FROM top LEFT JOIN cust USING (customer_id)")
def join_04(v):
    top = v.case.orderBy(F.desc("amount"), "case_id").limit(50)
    return top.join(v.customer, "customer_id", "left").select("case_id", D("amount", "amount"), "name", "home_state")


def month_cycles(txn):
    start = F.date_trunc("month", "ts").cast("timestamp_ntz")
    return txn.select("customer_id", start.alias("cycle_start")).distinct().withColumn("cycle_end", (F.col("cycle_start") + F.expr("INTERVAL 1 MONTH")))


@query("join_05_range_on_cycle", f"SELECT transaction_id, {T("date_trunc('month', ts)")} AS cycle_start FROM txn WHERE status = 'settled'")
def join_05(v):
    return cycle_join(v.bill.where("status = 'settled'"), month_cycles(v.bill)).select("transaction_id", stamp("cycle_start", "cycle_start"))


def error_labels(v):
    return v.event.where("merchant_id = 'error'").select("customer_id", F.col("ts").alias("label_at"), F.col("event_id").alias("row_id"), (F.col("amount") > 100).cast("int").alias("label"))


def purchases(v, kind="purchase"):
    return v.event.where(F.col("merchant_id") == kind).groupBy("customer_id", "ts").agg(F.max("event_id").alias("seen_id")).withColumnRenamed("ts", "seen_at")


LAB = "lab AS (SELECT customer_id, ts AS label_at, event_id AS row_id, CAST(amount > 100 AS INTEGER) AS label FROM ev WHERE merchant_id = 'error')"
PUR = "pur AS (SELECT customer_id, ts AS seen_at, max(event_id) AS seen_id FROM ev WHERE merchant_id = 'purchase' GROUP BY 1, 2)"
CLK = "clk AS (SELECT customer_id, ts AS clicked_at, max(event_id) AS click_id FROM ev WHERE merchant_id = 'click' GROUP BY 1, 2)"


@query("join_06_as_of_inner", f"WITH {LAB}, {PUR} SELECT row_id, label, seen_id FROM lab ASOF JOIN pur ON lab.customer_id = pur.customer_id AND lab.label_at >= pur.seen_at")
def join_06(v):
    return as_of_join(error_labels(v), purchases(v), ["customer_id"], "label_at", "seen_at", ["seen_id"], "inner").select("row_id", "label", "seen_id")


@query("join_07_as_of_chained", f"WITH {LAB}, {PUR}, {CLK} SELECT lab.row_id, pur.seen_id, clk.click_id FROM lab ASOF LEFT JOIN pur ON lab.customer_id = pur.customer_id AND lab.label_at >= pur.seen_at ASOF LEFT JOIN clk ON lab.customer_id = clk.customer_id AND lab.label_at >= clk.clicked_at")
def join_07(v):
    one = as_of_join(error_labels(v), purchases(v), ["customer_id"], "label_at", "seen_at", ["seen_id"])
    clicks = purchases(v, "click").withColumnsRenamed({"seen_at": "clicked_at", "seen_id": "click_id"})
    return as_of_join(one, clicks, ["customer_id"], "label_at", "clicked_at", ["click_id"]).select("row_id", "seen_id", "click_id")


@query("join_08_training_join", f"WITH {LAB}, onl AS (SELECT customer_id, min(ts) AS updated_at, count(*) AS n_online FROM ev WHERE merchant_id = 'signup' GROUP BY 1), {PUR}, pit AS (SELECT lab.*, pur.seen_id FROM lab ASOF LEFT JOIN pur ON lab.customer_id = pur.customer_id AND lab.label_at >= pur.seen_at) SELECT row_id, label, coalesce(seen_id, n_online) AS feature FROM pit JOIN onl USING (customer_id) WHERE updated_at <= label_at")
def join_08(v):
    pit = as_of_join(error_labels(v), purchases(v), ["customer_id"], "label_at", "seen_at", ["seen_id"])
    online = v.event.where("merchant_id = 'signup'").groupBy("customer_id").agg(F.min("ts").alias("updated_at"), F.count("*").alias("n_online"))
    return pit.join(online, "customer_id").where("updated_at <= label_at").select("row_id", "label", F.coalesce("seen_id", "n_online").alias("feature"))


@query("join_09_warm_start", f"WITH {LAB}, onl AS (SELECT customer_id, max(ts) AS updated_at, count(*) AS n_online FROM ev WHERE merchant_id = 'signup' GROUP BY 1) SELECT row_id, label, n_online FROM lab JOIN onl USING (customer_id) WHERE updated_at <= label_at")
def join_09(v):
    online = v.event.where("merchant_id = 'signup'").groupBy("customer_id").agg(F.max("ts").alias("updated_at"), F.count("*").alias("n_online"))
    return error_labels(v).join(online, "customer_id").where("updated_at <= label_at").select("row_id", "label", "n_online")


@query("join_10_latest_before_cutoff", "SELECT customer_id, max_by(event_id, (ts, event_id)) AS snapshot FROM ev WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1")
def join_10(v):
    return v.event.where(F.col("ts") <= clock("2024-01-20 00:00:00")).groupBy("customer_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("snapshot"))


@query("join_11_not_entitled", "WITH ent AS (SELECT DISTINCT customer_id, product_ref FROM txn JOIN items USING (transaction_id) WHERE status = 'settled') SELECT DISTINCT t.customer_id, i.product_ref FROM txn t JOIN items i USING (transaction_id) WHERE t.status = 'pending' AND NOT EXISTS (SELECT 1 FROM ent e WHERE e.customer_id = t.customer_id AND e.product_ref = i.product_ref)")
def join_11(v):
    bought = v.bill.join(v.items.select("transaction_id", "product_ref"), "transaction_id").select("customer_id", "product_ref", "status")
    ent = bought.where("status = 'settled'").select("customer_id", "product_ref")
    return bought.where("status = 'pending'").join(ent, ["customer_id", "product_ref"], "left_anti").select("customer_id", "product_ref").distinct()


@query("join_12_catalog_validation", "SELECT transaction_id, line_no, product_ref, merchant_id, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN p_size > 45 THEN 'deprecated' ELSE 'ok' END AS verdict FROM items LEFT JOIN part ON p_partkey = product_ref WHERE p_partkey IS NULL OR p_size > 45")
def join_12(v):
    catalog = v.table("part").select(F.col("p_partkey").alias("product_ref"), (F.col("p_size") > 45).alias("deprecated"))
    t = v.items.join(catalog, "product_ref", "left").where("deprecated is null or deprecated")
    return t.select("transaction_id", "line_no", "product_ref", "merchant_id", F.when(F.col("deprecated").isNull(), "unknown").otherwise("deprecated").alias("verdict"))


@query("join_13_unknown_keys", "SELECT c_custkey AS customer_id FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
def join_13(v):
    return v.customer.join(v.event.select("customer_id"), "customer_id", "left_anti").select("customer_id")


@query("join_14_related_cases", "SELECT case_id, related_id FROM (SELECT a.case_id, b.case_id AS related_id, row_number() OVER (PARTITION BY a.case_id ORDER BY b.created_at DESC, b.case_id) AS rn FROM cases a JOIN cases b ON a.customer_id = b.customer_id AND a.case_id <> b.case_id WHERE a.status = 'open' AND a.severity = 'critical') WHERE rn <= 3")
def join_14(v):
    a = v.case.where("status = 'open' and severity = 'critical'").select("case_id", "customer_id")
    b = v.case.select(F.col("case_id").alias("related_id"), "customer_id", "created_at")
    w = W.partitionBy("case_id").orderBy(F.desc("created_at"), "related_id")
    return a.join(b, "customer_id").where("case_id <> related_id").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("case_id", "related_id")


@query("join_15_prior_window_stats", "SELECT event_id, n, CASE WHEN n >= 3 THEN m END AS mean_30d FROM (SELECT event_id, count(*) OVER w AS n, CAST(sum(amount) OVER w AS DOUBLE) / (count(*) OVER w) AS m FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM ev) WINDOW w AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING))")
def join_15(v):
    w = W.partitionBy("customer_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-2592000, -1)
    t = v.event.select("event_id", F.count("*").over(w).alias("n"), F.try_divide(F.sum("amount").over(w).cast("double"), F.count("*").over(w).cast("double")).alias("m"))
    return t.select("event_id", "n", F.when(F.col("n") >= 3, F.col("m")).alias("mean_30d"))


@query("join_16_hierarchy_rollup", "SELECT parent_no, count(DISTINCT customer_id) AS outlets, CAST(coalesce(sum(total), 0) AS DOUBLE) AS revenue FROM cust LEFT JOIN txn USING (customer_id) WHERE customer_type = 'commercial' GROUP BY 1")
def join_16(v):
    spend = v.bill.groupBy("customer_id").agg(F.sum("total").alias("s"))
    t = v.customer.where("customer_type = 'commercial'").join(spend, "customer_id", "left")
    return t.groupBy("parent_no").agg(F.count_distinct("customer_id").alias("outlets"), F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("revenue"))


@query("agg_01_group", "SELECT txn_type, status, count(*) AS n, CAST(sum(total) AS DOUBLE) AS total, CAST(min(total) AS DOUBLE) AS lo, CAST(max(total) AS DOUBLE) AS hi, CAST(sum(total) AS DOUBLE) / count(*) AS mean FROM txn GROUP BY 1, 2")
def agg_01(v):
    s = F.sum("total").cast("double")
    return v.bill.groupBy("txn_type", "status").agg(F.count("*").alias("n"), s.alias("total"), F.min("total").cast("double").alias("lo"), F.max("total").cast("double").alias("hi"), (s / F.count("*")).alias("mean"))


@query("agg_02_sample_deviation", f"SELECT customer_id, count(*) AS n, round(avg(CAST(total AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST(total AS DOUBLE)), 4) AS std FROM txn WHERE ts >= TIMESTAMP '{AS_OF_ORDERS}' - INTERVAL 900 DAY GROUP BY 1")
def agg_02(v):
    x = F.col("total").cast("double")
    return v.bill.where(F.col("ts") >= clock(AS_OF_ORDERS) - F.expr("INTERVAL 900 DAYS")).groupBy("customer_id").agg(F.count("*").alias("n"), F.round(F.avg(x), 4).alias("mean"), F.round(F.stddev_samp(x), 4).alias("std"))


@query("agg_03_population_deviation", "SELECT customer_id, count(t.transaction_id) AS n, coalesce(round_even(stddev_pop(CAST(total AS DOUBLE)), 4), 0) AS std FROM cust LEFT JOIN (SELECT * FROM txn WHERE status = 'pending') t USING (customer_id) GROUP BY 1")
def agg_03(v):
    t = v.bill.where("status = 'pending'").groupBy("customer_id").agg(F.count("*").alias("n"), F.bround(F.stddev_pop(F.col("total").cast("double")), 4).alias("std"))
    return v.customer.join(t, "customer_id", "left").select("customer_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("std", F.lit(0.0)).alias("std"))


@query("agg_04_collect", "SELECT customer_id, list_aggregate(list_sort(list(DISTINCT txn_type)), 'string_agg', ',') AS types, list_aggregate(list(transaction_id ORDER BY transaction_id), 'string_agg', ',') AS ids FROM txn GROUP BY 1")
def agg_04(v):
    g = v.bill.groupBy("customer_id").agg(F.array_sort(F.collect_set("txn_type")).alias("types"), F.array_sort(F.collect_list("transaction_id")).alias("ids"))
    return g.select("customer_id", F.array_join("types", ",").alias("types"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("agg_05_conditional_count", "SELECT severity, count(*) FILTER (WHERE status = 'open') AS n_open, count(*) FILTER (WHERE disposition = 'true_positive') AS n_true FROM cases GROUP BY 1")
def agg_05(v):
    return v.case.groupBy("severity").agg(F.count_if(F.col("status") == "open").alias("n_open"), F.count_if(F.col("disposition") == "true_positive").alias("n_true"))


@query("agg_06_first_last", "SELECT customer_id, min_by(event_id, (ts, event_id)) AS first_id, max_by(event_id, (ts, event_id)) AS last_id FROM ev GROUP BY 1")
def agg_06(v):
    by = F.struct("ts", "event_id")
    return v.event.groupBy("customer_id").agg(F.min_by("event_id", by).alias("first_id"), F.max_by("event_id", by).alias("last_id"))


@query("agg_07_two_level", f"WITH h AS (SELECT merchant_id, date_trunc('day', ts) AS d, sum(amount) AS a FROM ev GROUP BY 1, 2) SELECT merchant_id, CAST(sum(a) AS DOUBLE) AS total, count(*) AS days, list_aggregate(list(CAST(a AS VARCHAR) ORDER BY d), 'string_agg', '|') AS trend FROM h GROUP BY 1")
def agg_07(v):
    day = v.event.groupBy("merchant_id", F.date_trunc("day", "ts").alias("d")).agg(F.sum("amount").alias("a"))
    g = day.groupBy("merchant_id").agg(F.sum("a").cast("double").alias("total"), F.count("*").alias("days"), F.array_sort(F.collect_list(F.struct("d", "a"))).alias("x"))
    return g.select("merchant_id", "total", "days", F.array_join(F.transform("x", lambda e: e["a"].cast("string")), "|").alias("trend"))


@query("agg_08_unpivot_latest", "WITH w AS (SELECT customer_id, max(ts) AS seen, CAST(sum(amount) AS DOUBLE) AS spend, CAST(count(*) AS DOUBLE) AS txns FROM ev GROUP BY 1), u AS (SELECT customer_id, seen, 'spend' AS name, spend AS value FROM w UNION ALL SELECT customer_id, seen, 'txns', txns FROM w) SELECT name, arg_max(value, (seen, customer_id)) AS latest, count(*) AS n FROM u GROUP BY 1")
def agg_08(v):
    w = v.event.groupBy("customer_id").agg(F.max("ts").alias("at"), F.sum("amount").cast("double").alias("spend"), F.count("*").cast("double").alias("txns"))
    u = w.unpivot(["customer_id", "at"], ["spend", "txns"], "name", "value").where("value is not null")
    return u.groupBy("name").agg(F.max_by("value", F.struct("at", "customer_id")).alias("latest"), F.count("*").alias("n"))


@query("agg_09_explode_group", "SELECT rule, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM (SELECT unnest(rules) AS rule, amount FROM cases) GROUP BY 1")
def agg_09(v):
    return v.case.select(F.explode("rules").alias("rule"), "amount").groupBy("rule").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount"))


RES = "res AS (SELECT severity, CAST(floor(epoch(resolved_at)) - floor(epoch(created_at)) AS BIGINT) // 60 AS minutes FROM cases WHERE resolved_at IS NOT NULL)"


def resolution(v):
    return v.case.where("resolved_at is not null").select("severity", F.floor(seconds(F.col("resolved_at"), F.col("created_at")) / 60).alias("minutes"))


@query("agg_10_percentiles", f"WITH {RES}, o AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY minutes) rn, count(*) OVER (PARTITION BY severity) n FROM res) SELECT severity, max(CASE WHEN rn = CAST(ceil(0.5 * n) AS BIGINT) THEN minutes END) AS p50, max(CASE WHEN rn = CAST(ceil(0.95 * n) AS BIGINT) THEN minutes END) AS p95 FROM o GROUP BY 1")
def agg_10(v):
    p = F.percentile_approx("minutes", [0.5, 0.95], 1_000_000)
    return resolution(v).groupBy("severity").agg(p.alias("p")).select("severity", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))


@query("agg_11_exact_percentiles", "SELECT merchant_id, round(quantile_cont(CAST(amount AS DOUBLE), 0.5), 4) AS p50, round(quantile_cont(CAST(amount AS DOUBLE), 0.95), 4) AS p95, round(quantile_cont(CAST(amount AS DOUBLE), 0.99), 4) AS p99 FROM ev GROUP BY 1")
def agg_11(v):
    t = S.interpolated(v.event, "amount", ["merchant_id"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return t.select("merchant_id", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


@query("agg_12_quantile_conventions", """WITH o AS (SELECT merchant_id, CAST(amount AS DOUBLE) AS x, row_number() OVER (PARTITION BY merchant_id ORDER BY amount) AS rn, count(*) OVER (PARTITION BY merchant_id) AS n FROM ev)
  SELECT merchant_id, max(CASE WHEN rn - 1 = least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) THEN x END) AS q_truncated, max(CASE WHEN rn - 1 = CAST(ceil(0.95 * n) AS BIGINT) - 1 THEN x END) AS q_ceiling,
  max(CASE WHEN rn - 1 = greatest(0, least(n - 1, CAST(floor(n * 0.95) AS BIGINT) - 1)) THEN x END) AS q_live, max(CASE WHEN rn - 1 = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN x END) AS q_nearest FROM o GROUP BY 1""")
def agg_12(v):
    t = v.event.select("merchant_id", F.col("amount").cast("double").alias("x"))
    return S.nearest_ranks(t, "x", ["merchant_id"], {f"q_{c}": (0.95, c) for c in S.CONVENTIONS})


@query("agg_13_distribution", """WITH o AS (SELECT merchant_id, CAST(amount AS DOUBLE) AS x, row_number() OVER (PARTITION BY merchant_id ORDER BY amount) AS rn, count(*) OVER (PARTITION BY merchant_id) AS n FROM ev)
  SELECT merchant_id, max(n) AS n, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, min(x) AS lo, max(CASE WHEN rn - 1 = least(n - 1, CAST(floor(0.25 * n) AS BIGINT)) THEN x END) AS p25,
  max(CASE WHEN rn - 1 = least(n - 1, CAST(floor(0.75 * n) AS BIGINT)) THEN x END) AS p75, max(x) AS hi FROM o GROUP BY 1""")
def agg_13(v):
    x = v.event.select("merchant_id", F.col("amount").cast("double").alias("x"))
    g = x.groupBy("merchant_id").agg(F.count("x").alias("n"), F.round(F.avg("x"), 4).alias("mean"), F.round(F.stddev_pop("x"), 4).alias("std"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    return g.join(S.nearest_ranks(x, "x", ["merchant_id"], {"p25": (0.25, "truncated"), "p75": (0.75, "truncated")}), "merchant_id")


@query("agg_14_conditional_ratio", "SELECT customer_id, CAST(sum(discount) AS DOUBLE) / nullif(CAST(sum(amount) AS DOUBLE), 0) AS discount_rate FROM ev GROUP BY 1")
def agg_14(v):
    return v.event.groupBy("customer_id").agg(F.try_divide(F.sum("discount").cast("double"), F.sum("amount").cast("double")).alias("discount_rate"))


@query("agg_15_frequency_breakdown", "SELECT coalesce(disposition, 'none') AS disposition, severity, count(*) AS n, count(*) FILTER (WHERE status <> 'resolved') AS n_open FROM cases GROUP BY 1, 2")
def agg_15(v):
    return v.case.groupBy(F.coalesce("disposition", F.lit("none")).alias("disposition"), "severity").agg(F.count("*").alias("n"), F.count_if(F.col("status") != "resolved").alias("n_open"))


@query("agg_16_top_values", "SELECT merchant_id, product_ref, n FROM (SELECT merchant_id, product_ref, count(*) AS n, row_number() OVER (PARTITION BY merchant_id ORDER BY count(*) DESC, product_ref) AS rn FROM items GROUP BY 1, 2) WHERE rn <= 3")
def agg_16(v):
    w = W.partitionBy("merchant_id").orderBy(F.desc("n"), "product_ref")
    return v.items.groupBy("merchant_id", "product_ref").agg(F.count("*").alias("n")).withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


@query("agg_17_array_sum", "SELECT transaction_id, CAST(sum(line_total - discount) AS DOUBLE) AS net FROM items GROUP BY 1")
def agg_17(v):
    g = v.items.groupBy("transaction_id").agg(F.collect_list(F.struct("line_total", "discount")).alias("its"))
    net = F.aggregate(F.transform("its", lambda i: (i["line_total"] - i["discount"]).cast("decimal(20,4)")), F.lit(0).cast("decimal(20,4)"), lambda a, x: (a + x).cast("decimal(20,4)"))
    return g.select("transaction_id", net.cast("double").alias("net"))


@query("agg_18_time_buckets", f"SELECT {T("date_trunc('hour', ts)")} AS bucket, count(*) AS n FROM ev WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def agg_18(v):
    t = v.event.where((F.col("ts") >= clock("2024-01-10 00:00:00")) & (F.col("ts") < clock("2024-01-12 00:00:00")))
    return t.groupBy(stamp(F.date_trunc("hour", "ts"), "bucket")).agg(F.count("*").alias("n"))


@query("win_01_running_before", "SELECT event_id, count(*) OVER w AS n, CAST(sum(amount) OVER w AS DOUBLE) AS spent FROM ev WINDOW w AS (PARTITION BY customer_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def win_01(v):
    w = W.partitionBy("customer_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    return v.event.select("event_id", F.count("*").over(w).alias("n"), F.sum("amount").over(w).cast("double").alias("spent"))


@query("win_02_latest_per_key", "SELECT customer_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, event_id DESC) rn FROM ev) WHERE rn = 1")
def win_02(v):
    w = W.partitionBy("customer_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return v.event.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("customer_id", "event_id")


@query("win_03_trailing_range", "SELECT event_id, count(*) OVER w AS n_day FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM ev) WINDOW w AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)")
def win_03(v):
    w = W.partitionBy("customer_id").orderBy(F.unix_timestamp("ts")).rangeBetween(-86400, 0)
    return v.event.select("event_id", F.count("*").over(w).alias("n_day"))


@query("win_04_previous_state", "SELECT case_id, prev, CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> severity THEN 1 ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY created_at, case_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS changes FROM (SELECT *, lag(severity) OVER (PARTITION BY customer_id ORDER BY created_at, case_id) AS prev FROM cases)")
def win_04(v):
    w = W.partitionBy("customer_id").orderBy("created_at", "case_id")
    t = v.case.withColumn("prev", F.lag("severity").over(w))
    return t.select("case_id", "prev", F.sum(F.when(F.col("prev").isNotNull() & (F.col("prev") != F.col("severity")), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("changes"))


@query("win_05_centred_mean", "WITH d AS (SELECT merchant_id, date_trunc('day', ts) AS d, count(*) AS n FROM ev GROUP BY 1, 2) SELECT merchant_id, strftime(d, '%Y-%m-%d') AS day, round(avg(n) OVER (PARTITION BY merchant_id ORDER BY d ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM d")
def win_05(v):
    d = v.event.groupBy("merchant_id", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"))
    w = W.partitionBy("merchant_id").orderBy("d").rowsBetween(-2, 2)
    return d.select("merchant_id", F.date_format("d", "yyyy-MM-dd").alias("day"), F.round(F.avg("n").over(w), 6).alias("smooth"))


@query("win_06_trend_label", "WITH m AS (SELECT customer_id, date_trunc('month', ts) AS m, sum(total) AS s FROM txn GROUP BY 1, 2), e AS (SELECT DISTINCT customer_id, first_value(s) OVER w AS a, last_value(s) OVER w AS b FROM m WINDOW w AS (PARTITION BY customer_id ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT customer_id, CASE WHEN b > a * 1.05 THEN 'rising' WHEN b < a * 0.95 THEN 'falling' ELSE 'flat' END AS trend FROM e")
def win_06(v):
    m = v.bill.groupBy("customer_id", F.date_trunc("month", "ts").alias("m")).agg(F.sum("total").alias("s"))
    g = m.groupBy("customer_id").agg(F.min_by("s", "m").alias("a"), F.max_by("s", "m").alias("b"))
    up, down = (F.lit(x).cast("decimal(3,2)") for x in ("1.05", "0.95"))
    return g.select("customer_id", F.when(F.col("b") > F.col("a") * up, "rising").when(F.col("b") < F.col("a") * down, "falling").otherwise("flat").alias("trend"))


@query("top_01_sort_skip_limit", "SELECT case_id, CAST(amount AS DOUBLE) AS amount FROM cases ORDER BY amount DESC, created_at DESC, case_id LIMIT 25 OFFSET 25")
def top_01(v):
    return v.case.orderBy(F.desc("amount"), F.desc("created_at"), "case_id").offset(25).limit(25).select("case_id", D("amount", "amount"))


@query("top_02_most_recent", "SELECT transaction_id FROM txn ORDER BY ts DESC, transaction_id LIMIT 500")
def top_02(v):
    return v.bill.orderBy(F.desc("ts"), "transaction_id").limit(500).select("transaction_id")


@query("top_03_capped_list", "SELECT customer_id, list_aggregate(list(event_id ORDER BY ts DESC, event_id DESC), 'string_agg', ',') AS recent FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, event_id DESC) rn FROM ev) WHERE rn <= 50 GROUP BY 1")
def top_03(v):
    w = W.partitionBy("customer_id").orderBy(F.desc("ts"), F.desc("event_id"))
    t = v.event.withColumn("rn", F.row_number().over(w)).where("rn <= 50").groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("rn", "event_id"))).alias("x"))
    return t.select("customer_id", F.array_join(F.transform("x", lambda e: e["event_id"].cast("string")), ",").alias("recent"))


@query("top_04_last_n_push", "WITH o AS (SELECT customer_id, event_id, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, event_id DESC) rn FROM ev WHERE merchant_id IN ('error','click')) SELECT customer_id, count(*) AS kept, min(event_id) AS oldest FROM o WHERE rn <= 20 GROUP BY 1")
def top_04(v):
    """The last 20 of two histories: rows beyond the 20th are dropped before anything is gathered."""
    w = W.partitionBy("customer_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = v.event.where(F.col("merchant_id").isin("error", "click")).withColumn("rn", F.row_number().over(w)).where("rn <= 20")
    return last.groupBy("customer_id").agg(F.count("*").alias("kept"), F.min("event_id").alias("oldest"))


@query("top_05_top_by_metric", "SELECT merchant_id, CAST(sum(line_total) AS DOUBLE) AS revenue FROM items GROUP BY 1 ORDER BY sum(line_total) DESC, merchant_id LIMIT 10")
def top_05(v):
    return v.items.groupBy("merchant_id").agg(F.sum("line_total").alias("r")).orderBy(F.desc("r"), "merchant_id").limit(10).select("merchant_id", D("r", "revenue"))


@query("top_06_categorical_order", "SELECT severity, n, row_number() OVER (ORDER BY list_position(['critical','high','medium','low'], severity)) AS place FROM (SELECT severity, count(*) AS n FROM cases GROUP BY 1)")
def top_06(v):
    order = F.array_position(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), F.col("severity"))
    return v.case.groupBy("severity").agg(F.count("*").alias("n")).select("severity", "n", F.row_number().over(W.orderBy(order)).cast("long").alias("place"))


@query("top_07_sample_rows", "SELECT transaction_id FROM txn ORDER BY md5(CAST(transaction_id AS VARCHAR)), transaction_id LIMIT 1000")
def top_07(v):
    return v.bill.orderBy(F.md5(F.col("transaction_id").cast("string").cast("binary")), "transaction_id").limit(1000).select("transaction_id")


@query("set_01_union_regroup", "WITH u AS (SELECT customer_type, entity, package_value FROM cust WHERE customer_type = 'residential' UNION ALL SELECT customer_type, entity, package_value FROM cust WHERE customer_type = 'commercial'), p AS (SELECT entity, customer_type, CAST(sum(package_value) AS DOUBLE) / count(*) AS m, count(*) AS n FROM u GROUP BY 1, 2) SELECT entity, CAST(sum(n) AS BIGINT) AS n, round(avg(m), 6) AS mean_of_means FROM p GROUP BY 1")
def set_01(v):
    sides = [v.customer.where(F.col("customer_type") == k).select("customer_type", "entity", "package_value") for k in ("residential", "commercial")]
    p = sides[0].unionByName(sides[1], allowMissingColumns=True).groupBy("entity", "customer_type").agg((F.sum("package_value").cast("double") / F.count("*")).alias("m"), F.count("*").alias("n"))
    return p.groupBy("entity").agg(F.sum("n").alias("n"), F.round(F.avg("m"), 6).alias("mean_of_means"))


@query("set_02_alert_feed", f"SELECT kind, id, stamped FROM (SELECT 'breach' AS kind, case_id AS id, {T('created_at')} AS stamped FROM cases WHERE severity = 'critical' UNION ALL SELECT 'drift', event_id, {T('ts')} FROM ev WHERE merchant_id = 'error') ORDER BY stamped DESC, kind, id LIMIT 50")
def set_02(v):
    a = v.case.where("severity = 'critical'").select(F.lit("breach").alias("kind"), F.col("case_id").alias("id"), stamp("created_at", "stamped"))
    b = v.event.where("merchant_id = 'error'").select(F.lit("drift").alias("kind"), F.col("event_id").alias("id"), stamp("ts", "stamped"))
    return a.unionByName(b).orderBy(F.desc("stamped"), "kind", "id").limit(50)


@query("set_04_array_sets", "SELECT case_id, len(list_distinct(list_concat(rules, ['velocity_anomaly']))) AS n_union, len(list_filter(rules, lambda x: x <> 'velocity_anomaly')) AS n_except FROM cases")
def set_04(v):
    other = F.array(F.lit("velocity_anomaly"))
    return v.case.select("case_id", F.size(F.array_union("rules", other)).cast("long").alias("n_union"), F.size(F.array_except("rules", other)).cast("long").alias("n_except"))


@query("fn_01_math", "SELECT transaction_id, round_even(sqrt(CAST(total AS DOUBLE)), 4) AS root, floor(CAST(total AS DOUBLE) / 7) AS whole, least(greatest(CAST(total AS DOUBLE) - 100000, 0), 50000) AS clamped, round(exp(-CAST(total AS DOUBLE) / 100000), 9) AS decay FROM txn")
def fn_01(v):
    x = F.col("total").cast("double")
    return v.bill.select("transaction_id", F.bround(F.sqrt(x), 4).alias("root"), F.floor(x / 7).cast("double").alias("whole"), F.least(F.greatest(x - 100000, F.lit(0.0)), F.lit(50000.0)).alias("clamped"), F.round(F.exp(-x / 100000), 9).alias("decay"))


@query("fn_02_conditional", "SELECT transaction_id, CASE status WHEN 'settled' THEN 1 WHEN 'open' THEN 2 ELSE 0 END AS code, coalesce(merchant_id, -1) AS merchant FROM txn")
def fn_02(v):
    return v.txn.select("transaction_id", F.when(F.col("status") == "settled", 1).when(F.col("status") == "open", 2).otherwise(0).alias("code"), F.coalesce("merchant_id", F.lit(-1)).alias("merchant"))


@query("fn_03_array", "SELECT case_id, len(rules) AS n, rules[1] AS first_rule, len(list_filter(rules, lambda r: r LIKE '%anomaly')) AS anomalies, list_contains(rules, 'discount_mismatch') AS discount FROM cases")
def fn_03(v):
    return v.case.select("case_id", F.size("rules").cast("long").alias("n"), F.get("rules", 0).alias("first_rule"), F.size(F.filter("rules", lambda r: r.like("%anomaly"))).cast("long").alias("anomalies"), F.array_contains("rules", "discount_mismatch").alias("discount"))


@query("fn_04_date", f"SELECT case_id, {T("date_trunc('day', created_at)")} AS day, CAST(year(created_at) AS INTEGER) AS y, CAST(month(created_at) AS INTEGER) AS m, strftime(created_at, '%Y-%m') AS ym, CAST(day(last_day(created_at)) AS INTEGER) AS days, CAST(floor(epoch(resolved_at)) - floor(epoch(created_at)) AS BIGINT) AS secs FROM cases")
def fn_04(v):
    c = F.col("created_at")
    return v.case.select("case_id", stamp(F.date_trunc("day", c), "day"), F.year(c).alias("y"), F.month(c).alias("m"), F.date_format(c, "yyyy-MM").alias("ym"), F.dayofmonth(F.last_day(c)).alias("days"), seconds(F.col("resolved_at"), c).alias("secs"))


@query("fn_05_string", "SELECT customer_id, 'cyc_' || customer_id || '_x' AS key, upper(substr(lower(segment),1,1)) || substr(lower(segment),2) AS title, printf('%.2f', CAST(package_value AS DOUBLE)) AS shown FROM cust")
def fn_05(v):
    return v.customer.select("customer_id", F.concat(F.lit("cyc_"), "customer_id", F.lit("_x")).alias("key"), F.initcap("segment").alias("title"), F.format_string("%.2f", F.col("package_value").cast("double")).alias("shown"))


@query("fn_06_map", "SELECT user_id AS customer_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def fn_06(v):
    m = F.from_json("props", "map<string,string>")
    return v.table("events").select(F.col("user_id").alias("customer_id"), "event_id", m[F.lit("k")].cast("int").alias("k"))


@query("fn_07_hash_bucket")
def fn_07(v):
    return v.event.select("event_id", (F.abs(F.hash("customer_id")) % 32).alias("customer_bucket"))


@query("fn_08_bands", "SELECT customer_id, CASE WHEN package_value >= 20000 THEN 'platinum' WHEN package_value >= 8000 THEN 'gold' WHEN package_value >= 2000 THEN 'silver' ELSE 'bronze' END AS ltv, CASE WHEN (customer_id % 100) / 100.0 >= 0.80 THEN 'critical' WHEN (customer_id % 100) / 100.0 >= 0.55 THEN 'high' WHEN (customer_id % 100) / 100.0 >= 0.25 THEN 'medium' ELSE 'low' END AS churn, CASE WHEN (customer_id % 50) / 50.0 >= 0.67 THEN 'high' WHEN (customer_id % 50) / 50.0 >= 0.34 THEN 'medium' ELSE 'low' END AS cross_sell FROM cust")
def fn_08(v):
    return v.customer.select("customer_id", S.ltv_band(F.col("package_value")).alias("ltv"), S.churn_band((F.col("customer_id") % 100) / 100.0).alias("churn"), S.cross_sell_band((F.col("customer_id") % 50) / 50.0).alias("cross_sell"))
