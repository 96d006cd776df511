"""Queries of the customer record: trends, engagement, refresh, CRM snapshots.

Over the test tables a marketing touch is an event (sent; opened unless it is a sign-up or an error; clicked if a click or a
purchase; converted if a purchase), a support ticket a case, the minutes viewed the quantity of pay-per-view lines, and each
bill comes with an extract of the customer from the CRM, taken a day later.
"""

from pyspark.sql import functions as F

from remitspark.operators import customer360 as R
from remitspark.registry import query
from remitspark.sources.scratch import shared_folder
from remitspark.streaming.tables import SnapshotTable
from remitspark.views import AS_OF_EVENTS, AS_OF_ORDERS, clock, stamp


def T(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


NOW = f"TIMESTAMP '{AS_OF_EVENTS}'"
VIEWED = "CC_PPV_DIRECT", "CC_BUNDLE_PPV"
TRENDS = """spine AS (SELECT customer_id, customer_type, TIMESTAMP '2001-08-01' - to_months(CAST(k AS INTEGER)) AS m FROM cust, range(12) r(k)), seen AS (SELECT transaction_id, sum(quantity) AS q FROM items WHERE charge_code IN ('CC_PPV_DIRECT', 'CC_BUNDLE_PPV') GROUP BY 1),
  monthly AS (SELECT customer_id, date_trunc('month', ts) AS m, sum(total) AS s, sum(q) AS q, count(*) FILTER (WHERE txn_type = 'ppv_charge') AS ppv FROM txn LEFT JOIN seen USING (transaction_id) WHERE status = 'settled' GROUP BY 1, 2),
  trend AS (SELECT s.customer_id, s.customer_type, s.m, coalesce(g.s, 0) AS spend, round(coalesce(CAST(q AS DOUBLE), 0) / 60.0::DOUBLE, 2) AS hours, coalesce(ppv, 0) AS ppv, sum(coalesce(g.s, 0)) OVER (PARTITION BY s.customer_id) AS ltv FROM spine s LEFT JOIN monthly g ON g.customer_id = s.customer_id AND g.m = s.m)"""
RATES = """tick AS (SELECT customer_id, count(*) AS n, count(*) FILTER (WHERE status = 'resolved') AS r FROM cases GROUP BY 1), touch AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'email' ELSE 'sms' END AS channel, merchant_id IN ('view', 'click', 'purchase') AS opened, merchant_id IN ('click', 'purchase') AS clicked, merchant_id = 'purchase' AS converted FROM ev),
  mk AS (SELECT customer_id, count(*) AS n, count(*) FILTER (WHERE opened) AS o, count(*) FILTER (WHERE clicked) AS c FROM touch GROUP BY 1),
  rates AS (SELECT k.customer_id, coalesce(r / t.n::DOUBLE, 0) AS support_response_rate, coalesce(o / mk.n::DOUBLE, 0) AS marketing_open_rate, coalesce(c / mk.n::DOUBLE, 0) AS marketing_click_rate FROM cust k LEFT JOIN tick t ON t.customer_id = k.customer_id LEFT JOIN mk ON mk.customer_id = k.customer_id)"""


def bills(v):
    minutes = v.items.where(F.col("charge_code").isin(*VIEWED)).groupBy("transaction_id").agg(F.sum("quantity").alias("viewing_minutes"))
    return v.bill.join(minutes, "transaction_id", "left")


def touches(v):
    kind = F.col("merchant_id")
    at = lambda minutes, *kinds: F.when(kind.isin(*kinds), F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
    channel = F.when(F.col("event_id") % 2 == 0, "email").otherwise("sms")
    return v.event.select("customer_id", channel.alias("channel"), F.col("ts").alias("sent_at"), at(1, "view", "click", "purchase").alias("opened_at"), at(2, "click", "purchase").alias("clicked_at"), at(5, "purchase").alias("converted_at"))


def tickets(v):
    return v.case.select("customer_id", "status")


@query("cus_01_monthly_trends", f"WITH {TRENDS} SELECT customer_id, strftime(m, '%Y-%m') AS month, CAST(spend AS DOUBLE) AS spend, hours AS viewing_hours, ppv, CAST(ltv AS DOUBLE) AS ltv FROM trend")
def cus_01(v):
    t = R.by_month(R.trends(v.customer.select("customer_id"), bills(v), clock(AS_OF_ORDERS)), clock(AS_OF_ORDERS))
    return t.select("customer_id", "month", F.col("spend").cast("double").alias("spend"), F.col("hours").alias("viewing_hours"), "ppv", F.col("ltv").cast("double").alias("ltv"))


@query("cus_05_engagement", f"WITH {RATES} SELECT * FROM rates")
def cus_05(v):
    return R.engagement(v.customer.select("customer_id"), tickets(v), touches(v))


@query("cus_06_channel_rates", f"WITH {RATES} SELECT customer_id, channel, count(*) AS total_sent, count(*) FILTER (WHERE opened) / count(*)::DOUBLE AS open_rate, count(*) FILTER (WHERE clicked) / count(*)::DOUBLE AS ctr, count(*) FILTER (WHERE converted) / count(*)::DOUBLE AS conversion_rate, {T('max(CASE WHEN converted THEN ts + INTERVAL 5 MINUTE WHEN clicked THEN ts + INTERVAL 2 MINUTE WHEN opened THEN ts + INTERVAL 1 MINUTE END)')} AS last_engaged FROM touch GROUP BY 1, 2")
def cus_06(v):
    return R.channel_rates(touches(v)).withColumn("last_engaged", stamp("last_engaged_at", "x")).drop("last_engaged_at")


@query("cus_08_cooldown_gate", f"WITH asked AS (SELECT customer_id + (event_id % 5) * 500 AS customer_id, bool_or(merchant_id = 'purchase') AS forced FROM ev GROUP BY 1), last AS (SELECT customer_id, max(ts) AS at_ FROM ev GROUP BY 1), o AS (SELECT a.customer_id, forced, CASE WHEN c.customer_id IS NULL THEN 'not_found' WHEN NOT forced AND coalesce(floor(epoch({NOW})) - floor(epoch(at_)) < 21600, false) THEN 'skipped' ELSE 'computed' END AS outcome FROM asked a LEFT JOIN cust c ON c.customer_id = a.customer_id LEFT JOIN last l ON l.customer_id = a.customer_id) SELECT outcome, forced, count(*) AS n FROM o GROUP BY 1, 2")
def cus_08(v):
    """Requests name customers that are there and others; a purchase forces; a customer was last computed when last seen."""
    asked = v.event.select((F.col("customer_id") + F.col("event_id") % 5 * 500).alias("customer_id"), (F.col("merchant_id") == "purchase").alias("force"))
    state = v.event.select("customer_id", F.col("ts").alias("computed_at"))
    return R.refresh_outcomes(asked, v.customer, state, clock(AS_OF_EVENTS)).groupBy("outcome", "forced").agg(F.count("*").alias("n"))


def nights(v):
    """Commercial customers first; all four hours later, when those have not cooled down."""
    table = SnapshotTable(v.spark, shared_folder(v.spark, "record"), R.RECORD, ["customer_id"])
    runs = [(v.customer.where("customer_type = 'commercial'"), "2001-08-02 00:00:00"), (v.customer, "2001-08-02 04:00:00")]
    return table, [R.nightly(table, who, bills(v), tickets(v), touches(v), at, batch) for batch, (who, at) in enumerate(runs)]


@query("cus_09_nightly_360", f"WITH {TRENDS}, {RATES}, sums AS (SELECT customer_id, any_value(customer_type) AS customer_type, max(ltv) AS ltv, sum(hours) AS hours, CAST(sum(ppv) AS BIGINT) AS ppv FROM trend GROUP BY 1) SELECT s.customer_id, customer_type, CAST(ltv AS DOUBLE) AS ltv, round(hours, 2) AS viewing_hours, ppv, support_response_rate, marketing_open_rate, marketing_click_rate, CASE customer_type WHEN 'commercial' THEN '2001-08-02 00:00:00' ELSE '2001-08-02 04:00:00' END AS computed_at FROM sums s JOIN rates USING (customer_id)")
def cus_09(v):
    """The stored records after two runs."""
    table, _ = nights(v)
    hours, ppv = F.aggregate("hours", F.lit(0.0), lambda a, x: a + x), F.aggregate("ppv", F.lit(0).cast("long"), lambda a, x: a + x)
    return table.read().select("customer_id", "customer_type", F.col("ltv").cast("double").alias("ltv"), F.round(hours, 2).alias("viewing_hours"), ppv.alias("ppv"), *R.RATES, stamp("computed_at", "computed_at"))


@query("cus_09_nightly_counts", "SELECT 1 AS run, customer_type, count(*) AS scanned, count(*) AS updated, CAST(0 AS BIGINT) AS skipped FROM cust WHERE customer_type = 'commercial' GROUP BY 2 UNION ALL SELECT 2, customer_type, count(*), count(*) FILTER (WHERE customer_type = 'residential'), count(*) FILTER (WHERE customer_type = 'commercial') FROM cust GROUP BY 2")
def cus_09_counts(v):
    """What each of the two runs scanned, updated and skipped, by type of customer."""
    _, runs = nights(v)
    first, second = [t.withColumn("run", F.lit(k)) for k, t in enumerate(runs, 1)]
    return first.unionByName(second)


FIELDS = ("segment", "home_state", "package_value", "promotions")


def crm_snapshots(v):
    """An extract of the customer with each bill: promotions by number, entitlements by what the bill holds, some fields left out."""
    key = F.col("transaction_id")
    codes = v.items.groupBy("transaction_id").agg(F.array_sort(F.collect_set("charge_code")).alias("entitlements"))  # three codes
    lost = lambda n, c: F.when(key % n != 0, F.col(c)).alias(c)
    who = v.customer.select("customer_id", "segment", "home_state", "package_value")
    promo = F.when(key % 5 != 0, F.when(key % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("PROMO_"), key % 3))))
    t = v.bill.join(who, "customer_id").join(codes, "transaction_id", "left")
    return t.select("customer_id", key.alias("snapshot_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("snapshot_at"), (key % 7 * 14400).alias("lag_seconds"), promo.alias("promotions"), "entitlements", lost(6, "segment"), lost(10, "home_state"), lost(9, "package_value"))


CRM = """codes AS (SELECT transaction_id, list_sort(list(DISTINCT charge_code)) AS ent FROM items GROUP BY 1),
  snap AS (SELECT customer_id, transaction_id AS snapshot_id, ts + INTERVAL 1 DAY AS snapshot_at, (transaction_id % 7) * 14400 AS lag, CASE WHEN transaction_id % 5 <> 0 THEN CASE WHEN transaction_id % 4 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['PROMO_' || (transaction_id % 3)] END END AS promo, ent,
    list_filter([CASE WHEN transaction_id % 6 = 0 OR segment IS NULL THEN 'segment' END, CASE WHEN transaction_id % 10 = 0 OR home_state IS NULL THEN 'home_state' END, CASE WHEN transaction_id % 9 = 0 OR package_value IS NULL THEN 'package_value' END, CASE WHEN transaction_id % 5 = 0 THEN 'promotions' END], lambda x: x IS NOT NULL) AS missing FROM txn JOIN cust USING (customer_id) LEFT JOIN codes USING (transaction_id)),
  cur AS (SELECT c.customer_id, promotions, coalesce(list(DISTINCT charge_code) FILTER (WHERE charge_code IS NOT NULL), []) AS ent FROM cust c LEFT JOIN txn t ON t.customer_id = c.customer_id AND ts >= TIMESTAMP '2000-08-02' LEFT JOIN items USING (transaction_id) GROUP BY 1, 2),
  hit AS (SELECT c.case_id, c.customer_id, c.created_at, s.* EXCLUDE (customer_id), row_number() OVER (PARTITION BY c.case_id ORDER BY s.snapshot_at DESC NULLS LAST, s.snapshot_id DESC) AS rn FROM cases c LEFT JOIN snap s ON s.customer_id = c.customer_id AND s.snapshot_at <= c.created_at),
  j AS (SELECT h.*, list_sort(list_filter(coalesce(k.promotions, []), lambda x: NOT list_contains(coalesce(promo, []), x))) AS ap, list_sort(list_filter(coalesce(promo, []), lambda x: NOT list_contains(coalesce(k.promotions, []), x))) AS rp, list_sort(list_filter(coalesce(k.ent, []), lambda x: NOT list_contains(coalesce(h.ent, []), x))) AS ae, list_sort(list_filter(coalesce(h.ent, []), lambda x: NOT list_contains(coalesce(k.ent, []), x))) AS re FROM hit h LEFT JOIN cur k USING (customer_id) WHERE rn = 1)"""


@query("cus_15_crm_diff", f"""WITH {CRM} SELECT case_id, customer_id, snapshot_id, CASE WHEN snapshot_id IS NOT NULL THEN array_to_string(ap, ',') END AS added_promotions, CASE WHEN snapshot_id IS NOT NULL THEN array_to_string(rp, ',') END AS removed_promotions, CASE WHEN snapshot_id IS NOT NULL THEN array_to_string(ae, ',') END AS added_entitlements, CASE WHEN snapshot_id IS NOT NULL THEN array_to_string(re, ',') END AS removed_entitlements,
  CASE WHEN snapshot_id IS NOT NULL THEN len(ap) + len(rp) + len(ae) + len(re) END AS delta_count, CASE WHEN snapshot_id IS NULL THEN NULL WHEN len(ap) + len(ae) > 0 THEN 'would_have_caused_quarantine' ELSE 'normal' END AS delta_severity, CAST(floor((floor(epoch(created_at)) - floor(epoch(snapshot_at))) / 3600) AS BIGINT) AS staleness_hours, (floor(epoch(created_at)) - floor(epoch(snapshot_at))) >= 25 * 3600 AS is_stale,
  CASE WHEN snapshot_id IS NULL THEN NULL WHEN lag >= 86400 THEN 'critical' WHEN lag >= 21600 THEN 'high' WHEN lag >= 3600 THEN 'medium' ELSE 'low' END AS lag_band, CASE WHEN snapshot_id IS NOT NULL THEN array_to_string(missing, ',') END AS fields_missing, CASE WHEN snapshot_id IS NOT NULL THEN round(1 - len(missing) / 4.0::DOUBLE, 4) END AS completeness FROM j""")
def cus_15(v):
    """Each case against the customer's last extract before it: what has changed to now (lists of the last year)."""
    year = v.bill.where(F.col("ts") >= clock(AS_OF_ORDERS) - F.expr("INTERVAL 365 DAYS")).select("transaction_id", "customer_id")
    codes = v.items.select("transaction_id", "charge_code").join(year, "transaction_id").groupBy("customer_id").agg(F.collect_set("charge_code").alias("entitlements"))  # three codes
    now = v.customer.select("customer_id", "promotions").join(codes, "customer_id", "left")
    cases = v.case.select(F.col("case_id").alias("row_id"), "customer_id", F.col("created_at").alias("at"))
    t = R.crm_diff(cases, crm_snapshots(v), now, FIELDS)
    lists = [c for c in t.columns if c.startswith(("added_", "removed_")) or c == "fields_missing"]
    return t.withColumnRenamed("row_id", "case_id").withColumns({c: F.array_join(c, ",") for c in lists})


@query("cus_18_monthly_value", "WITH f AS (SELECT customer_id, product_ref, line_total, row_number() OVER (PARTITION BY customer_id, product_ref ORDER BY ts DESC, transaction_id DESC, line_no DESC, line_total DESC) AS rn FROM items JOIN txn USING (transaction_id) WHERE charge_code = 'CC_SUBSCRIPTION_BASE') SELECT customer_id, count(*) AS n_subscriptions, CAST(sum(line_total) AS DOUBLE) AS monthly_value FROM f WHERE rn = 1 GROUP BY 1")
def cus_18(v):
    lines = v.items.where("charge_code = 'CC_SUBSCRIPTION_BASE'").select("transaction_id", "product_ref", "line_no", F.col("line_total").alias("fee"))
    t = R.monthly_value(lines.join(v.bill.select("transaction_id", "customer_id", "ts"), "transaction_id"))
    return t.select("customer_id", "n_subscriptions", F.col("monthly_value").cast("double").alias("monthly_value"))
