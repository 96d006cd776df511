"""Queries of cases, operations metrics and cycles."""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from remitspark.functions.stats import interpolated, nearest_ranks
from remitspark.operators import cases as C
from remitspark.operators import signals as G
from remitspark.operators.joins import cycle_join
from remitspark.operators.search import top_k
from remitspark.plans.customers import HISTORY_TEXT, TOLD, txt_02
from remitspark.registry import query
from remitspark.sources.scratch import shared_folder
from remitspark.streaming.tables import SnapshotTable, merged, update_latest
from remitspark.views import AS_OF_EVENTS, AS_OF_ORDERS, clock, seconds, stamp


def T(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


NOW = f"TIMESTAMP '{AS_OF_ORDERS}'"
SCORE = """scored AS (SELECT c.*, k.customer_type, k.lifetime_quarantine_count AS prior, round_even(0.55::DOUBLE * CASE severity WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.75::DOUBLE WHEN 'medium' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END
  + 0.30::DOUBLE * least(1.0::DOUBLE, CAST(amount AS DOUBLE) / 500000.0::DOUBLE) + 0.10::DOUBLE * least(1.0::DOUBLE, CAST(k.lifetime_quarantine_count AS DOUBLE) / 5.0::DOUBLE) + 0.05::DOUBLE * CAST(k.customer_type = 'commercial' AS INTEGER), 4) AS score,
  created_at + to_minutes(CASE severity WHEN 'critical' THEN 30 WHEN 'high' THEN 240 WHEN 'medium' THEN 1440 ELSE 4320 END) AS target FROM cases c LEFT JOIN cust k USING (customer_id))"""


def scored(v):
    t = v.case.join(v.customer.select("customer_id", "customer_type", F.col("lifetime_quarantine_count").alias("prior")), "customer_id", "left")
    score = C.priority_score("severity", F.col("amount") / 100, F.col("prior"), F.col("customer_type") == "commercial")
    return t.withColumn("score", score).withColumn("target", C.sla_target(F.col("created_at"), "severity"))


AT_RISK = "CAST(amount * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


@query("cas_01_priority", f"""WITH {SCORE}, d AS (SELECT *, {AT_RISK} AS at_risk FROM scored) SELECT case_id, score, CASE WHEN score >= 0.85 THEN 'P0' WHEN score >= 0.65 THEN 'P1' WHEN score >= 0.40 THEN 'P2' ELSE 'P3' END AS band,
  concat_ws(',', 'severity:' || severity, CASE WHEN at_risk >= 1000 THEN 'amount_at_risk:' || at_risk END, CASE WHEN prior >= 2 THEN 'repeat_offender:' || prior END, CASE WHEN customer_type = 'commercial' THEN 'commercial_account' END) AS drivers FROM d""")
def cas_01(v):
    """At risk is a hundredth of a case's amount."""
    drivers = C.priority_drivers("severity", (F.col("amount") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(18,2)"), F.col("prior"), F.col("customer_type") == "commercial")
    return scored(v).select("case_id", "score", C.priority_band(F.col("score")).alias("band"), F.array_join(drivers, ",").alias("drivers"))


@query("cas_02_sla_target", f"WITH {SCORE} SELECT case_id, {T('target')} AS target FROM scored")
def cas_02(v):
    return scored(v).select("case_id", stamp("target", "target"))


def even_cents(mills):
    """SQL: thousandths to cents, halves to the even cent."""
    return f"CAST(({mills}) // 10 + CASE WHEN ({mills}) % 10 > 5 OR (({mills}) % 10 = 5 AND (({mills}) // 10) % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100"


STAKE = "CAST(amount * 100 AS BIGINT) * CASE WHEN severity IN ('critical','high') THEN 8 ELSE 5 END"


@query("cas_03_revenue_impact", f"WITH x AS (SELECT case_id, {even_cents(STAKE)} AS at_stake FROM cases) SELECT case_id, at_stake, CAST(round((at_stake - 12) * 100) AS DOUBLE) / 100 AS net FROM x")
def cas_03(v):
    stake, net = C.revenue_impact(F.col("amount"), F.col("severity"))
    return v.case.select("case_id", stake.cast("double").alias("at_stake"), net.cast("double").alias("net"))


@query("cas_04_lifecycle", f"SELECT case_id, 1 + CAST(status <> 'open' AS INTEGER) AS events, CASE WHEN status = 'open' THEN 'open' ELSE 'open>' || status END AS path, status IN ('open','under_review') AS may_resolve FROM cases")
def cas_04(v):
    event = lambda at, a, b: F.struct(at.alias("at"), a.alias("from_status"), b.alias("to_status"))
    first = F.array(event(F.col("created_at"), F.lit(None).cast("string"), F.lit("open")))
    t = v.case.withColumn("lifecycle", F.when(F.col("status") == "open", first).otherwise(F.concat(first, F.array(event(F.coalesce("resolved_at", "created_at"), F.lit("open"), F.col("status"))))))
    return t.select("case_id", F.size("lifecycle").alias("events"), F.array_join(F.transform("lifecycle", lambda e: e["to_status"]), ">").alias("path"), C.transition(F.col("status"), "resolved").alias("may_resolve"))


@query("cas_05_sla_tick", f"WITH {SCORE} SELECT case_id, target < {NOW} AS is_breached, CASE WHEN target < {NOW} THEN {T(NOW)} END AS breached_at, (floor(epoch(target)) - floor(epoch({NOW}))) / 60.0::DOUBLE AS minutes_to_breach FROM scored WHERE status <> 'resolved'")
def cas_05(v):
    t = scored(v).where("status <> 'resolved'").withColumns(C.sla_tick(clock(AS_OF_ORDERS), F.col("target"), F.lit(None).cast("timestamp_ntz")))
    return t.select("case_id", "is_breached", stamp("breached_at", "breached_at"), "minutes_to_breach")


@query("cas_06_sla_sweep", f"WITH {SCORE} SELECT count(*) AS scanned, count(*) FILTER (WHERE target < {NOW}) AS newly_breached FROM scored WHERE status <> 'resolved'")
def cas_06(v):
    t = scored(v).where("status <> 'resolved'").withColumns(C.sla_tick(clock(AS_OF_ORDERS), F.col("target"), F.lit(None).cast("timestamp_ntz")))
    return t.agg(F.count("*").alias("scanned"), F.count_if("is_breached").alias("newly_breached"))


@query("cas_07_open_case", f"WITH {SCORE} SELECT 'case_' || case_id AS id, customer_type, severity, {T('target')} AS target, len(rules) AS n_rules, 'open' AS status FROM scored WHERE status = 'open' AND len(rules) > 0")
def cas_07(v):
    t = scored(v).where("status = 'open' and size(rules) > 0")
    return t.select(F.concat(F.lit("case_"), "case_id").alias("id"), "customer_type", "severity", stamp("target", "target"), F.size("rules").cast("long").alias("n_rules"), F.lit("open").alias("status"))


@query("cas_08_disposition", f"""WITH {TOLD}, x AS ({HISTORY_TEXT}) SELECT c.case_id, CASE WHEN disposition IN ('true_positive', 'false_positive') THEN 'resolved' WHEN status = 'open' THEN 'open' ELSE 'under_review' END AS next_status, CASE WHEN c.disposition IS NOT NULL THEN 'analyst_' || customer_id % 7 END AS archived_by, text AS archive_text FROM cases c LEFT JOIN x USING (case_id)""")
def cas_08(v):
    """Stored open cases, decided on: those judged are resolved and archived with their history text, those someone looks at
    go under review, the rest stay open."""
    cases = SnapshotTable(v.spark, shared_folder(v.spark, "decided"), C.DECIDED, ["case_id"])
    archive = SnapshotTable(v.spark, shared_folder(v.spark, "archive"), C.ARCHIVED, ["case_id"])
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in cases.types}
    cases.apply(lambda old: v.bill.select(F.col("transaction_id").alias("case_id")).withColumns({k: x for k, x in nothing.items() if k != "case_id"}).withColumn("status", F.lit("open")).select(*old.columns), 0)
    decided = v.case.where("status <> 'open'").select("case_id", F.coalesce("disposition", F.lit("needs_more_info")).alias("disposition"), F.concat(F.lit("analyst_"), F.col("customer_id") % 7).alias("analyst"), F.array_join("rules", ",").alias("notes"), F.coalesce("resolved_at", "created_at").alias("at"))
    C.dispose(cases, archive, decided, txt_02(v), 1)
    kept = archive.read().select("case_id", F.col("analyst").alias("archived_by"), F.col("text").alias("archive_text"))
    return cases.read().select("case_id", F.col("status").alias("next_status")).join(merged(kept), "case_id", "left")


@query("cas_09_counts_by_severity", f"SELECT severity, count(*) AS n, count(*) / 90.0::DOUBLE AS per_day FROM cases WHERE created_at >= {NOW} - INTERVAL 90 DAY GROUP BY 1")
def cas_09(v):
    t = v.case.where(F.col("created_at") >= clock(AS_OF_ORDERS) - F.expr("INTERVAL 90 DAYS"))
    return t.groupBy("severity").agg(F.count("*").alias("n"), (F.count("*") / F.lit(90.0)).alias("per_day"))


@query("cas_10_resolution_velocity", "WITH r AS (SELECT severity, CAST(floor(epoch(resolved_at)) - floor(epoch(created_at)) AS BIGINT) / 60.0::DOUBLE AS m FROM cases WHERE resolved_at IS NOT NULL) SELECT severity, count(*) AS n, round(quantile_cont(m, 0.5), 4) AS median, round(quantile_cont(m, 0.95), 4) AS p95 FROM r GROUP BY 1")
def cas_10(v):
    t = v.case.where("resolved_at is not null").select("severity", (seconds(F.col("resolved_at"), F.col("created_at")) / 60.0).alias("m"))
    g = interpolated(t, "m", ["severity"], {"median": 0.5, "p95": 0.95})
    return g.select("severity", "n", F.round("median", 4).alias("median"), F.round("p95", 4).alias("p95"))


@query("cas_11_what_changed", f"WITH {SCORE} SELECT kind, id FROM (SELECT 'sla_breach' AS kind, case_id AS id, created_at AS t FROM scored WHERE status = 'open' AND target < {NOW} UNION ALL SELECT 'drift_alert', event_id, ts FROM ev WHERE merchant_id = 'error' AND amount > 150) ORDER BY t DESC, kind, id LIMIT 50")
def cas_11(v):
    a = scored(v).where((F.col("status") == "open") & (F.col("target") < clock(AS_OF_ORDERS))).select(F.lit("sla_breach").alias("kind"), F.col("case_id").alias("id"), F.col("created_at").alias("t"))
    b = v.event.where("merchant_id = 'error' and amount > 150").select(F.lit("drift_alert").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("t"))
    return a.unionByName(b).orderBy(F.desc("t"), "kind", "id").limit(50).select("kind", "id")


@query("cas_12_rule_frequency", f"SELECT rule_type, count(*) AS n, count(DISTINCT customer_id) AS customers FROM (SELECT unnest(rules) AS rule_type, customer_id FROM cases WHERE created_at >= {NOW} - INTERVAL 7 DAY) GROUP BY 1")
def cas_12(v):
    t = v.case.where(F.col("created_at") >= clock(AS_OF_ORDERS) - F.expr("INTERVAL 7 DAYS")).select(F.explode("rules").alias("rule_type"), "customer_id")
    return t.groupBy("rule_type").agg(F.count("*").alias("n"), F.count_distinct("customer_id").alias("customers"))


#: A case's vector is the one with its id. History: cases with a disposition; hits: cosine to six places, the case itself left out.
HISTORY = """pairs AS (SELECT q.case_id AS query_id, h.case_id AS vec_id, q.status, q.disposition AS mine, h.disposition, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
  FROM cases q JOIN embeddings a ON a.vec_id = q.case_id JOIN cases h ON h.case_id <> q.case_id AND h.disposition IS NOT NULL JOIN embeddings b ON b.vec_id = h.case_id),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM pairs)"""


def similar_history(v, asked, k):
    """(query_id, vec_id, score, place, disposition): the k past cases most like each case of ``asked``."""
    e = v.table("embeddings").select("vec_id", "embedding")
    past = v.case.where("disposition is not null").select(F.col("case_id").alias("vec_id"), "disposition")
    queries = asked.select(F.col("case_id").alias("query_id")).join(e.withColumnRenamed("vec_id", "query_id"), "query_id")
    return top_k(queries, e.join(past, "vec_id"), k).join(past, "vec_id")


@query("cas_13_usefulness", f"WITH {HISTORY} SELECT vec_id AS shown, count(*) AS times_shown, count(*) FILTER (WHERE mine = disposition) AS useful, count(*) FILTER (WHERE mine <> disposition) AS not_useful FROM near WHERE place <= 3 AND mine IS NOT NULL GROUP BY 1")
def cas_13(v):
    """Each judged case had three past cases shown: how often those were shown, and how often they were right."""
    judged = v.case.where("disposition is not null")
    t = similar_history(v, judged, 3).join(judged.select(F.col("case_id").alias("query_id"), F.col("disposition").alias("mine")), "query_id")
    return t.groupBy(F.col("vec_id").alias("shown")).agg(F.count("*").alias("times_shown"), F.count_if(F.col("mine") == F.col("disposition")).alias("useful"), F.count_if(F.col("mine") != F.col("disposition")).alias("not_useful"))


@query("cas_14_classification", "SELECT case_id, CASE WHEN len(rules) >= 3 OR severity = 'critical' THEN 'complex' WHEN len(rules) = 2 THEN 'moderate' ELSE 'simple' END AS complexity, CASE WHEN amount > 250000 THEN 'strong' WHEN amount > 50000 THEN 'medium' ELSE 'weak' END AS evidence, (len(rules) >= 3 OR severity = 'critical') AND NOT list_contains(rules, 'duplicate_transaction') AS deep_path FROM cases")
def cas_14(v):
    n = F.size("rules")
    hard = (n >= 3) | (F.col("severity") == "critical")
    return v.case.select(
        "case_id", F.when(hard, "complex").when(n == 2, "moderate").otherwise("simple").alias("complexity"),
        F.when(F.col("amount") > 250000, "strong").when(F.col("amount") > 50000, "medium").otherwise("weak").alias("evidence"), (hard & ~F.exists("rules", lambda r: r == "duplicate_transaction")).alias("deep_path"),
    )


@query("cas_15_disposition_vote", f"""WITH {HISTORY}, g AS (SELECT query_id AS case_id, count(*) AS n, count(*) FILTER (WHERE disposition = 'true_positive') AS tp, count(*) FILTER (WHERE disposition = 'false_positive') AS fp FROM near WHERE place <= 5 AND status = 'open' GROUP BY 1),
  w AS (SELECT *, least(1.0::DOUBLE, n / 5.0::DOUBLE) AS weight, n < 2 AS thin, tp * 10 >= n * 7 AS for_tp, fp * 10 >= n * 7 AS for_fp FROM g)
  SELECT case_id, n, tp, fp, CASE WHEN thin THEN 'prior' WHEN for_tp THEN 'true_positive' WHEN for_fp THEN 'false_positive' ELSE 'needs_more_info' END AS vote, weight,
  round(CASE WHEN thin THEN 0.6::DOUBLE ELSE 0.6::DOUBLE * (1 - weight) + CASE WHEN for_tp THEN 0.85::DOUBLE WHEN for_fp THEN 0.75::DOUBLE ELSE 0.5::DOUBLE END * weight END, 2) AS confidence FROM w""")
def cas_15(v):
    """Dispositions of the five past cases most like an open one. Seven in ten of a kind decide; the prior confidence of
    0.6 gives way to what the vote says as more cases are found. Fewer than two leave the prior alone."""
    found = similar_history(v, v.case.where("status = 'open'"), 5)
    g = found.groupBy(F.col("query_id").alias("case_id")).agg(F.count("*").alias("n"), F.count_if(F.col("disposition") == "true_positive").alias("tp"), F.count_if(F.col("disposition") == "false_positive").alias("fp"))
    return g.select("case_id", "n", "tp", "fp", *C.vote(F.col("tp"), F.col("fp"), F.col("n"), 0.6))


@query("cas_16_trace_summary", """WITH e AS (SELECT conv_id, turn, role AS node, text IS NULL OR text ILIKE '%error%' OR turn % 7 = 6 AS failed, CASE WHEN conv_id % 4 <> 0 AND turn % 5 <> 4 THEN length(text) END AS ms FROM conversations), f AS (SELECT conv_id, node, min(turn) AS t FROM e WHERE node <> '' GROUP BY 1, 2),
  p AS (SELECT conv_id, list_aggregate(list(node ORDER BY t, node), 'string_agg', '>') AS path, count(*) AS nodes FROM f GROUP BY 1) SELECT conv_id, path, coalesce(nodes, 0) AS nodes, count(*) AS steps, count(*) FILTER (WHERE failed) AS errors, CAST(sum(ms) AS BIGINT) AS total_ms FROM e LEFT JOIN p USING (conv_id) GROUP BY 1, 2, 3""")
def cas_16(v):
    """Of each trace the nodes in the order of their first step, the steps that failed, and the time of those that tell one; null
    where none does. Steps are turns, their time the length of what was said."""
    failed = F.col("text").isNull() | F.col("text").ilike("%error%") | (F.col("turn") % 7 == 6)
    ms = F.when((F.col("conv_id") % 4 != 0) & (F.col("turn") % 5 != 4), F.char_length("text"))
    e = v.table("conversations").select("conv_id", "turn", F.col("role").alias("node"), failed.alias("failed"), ms.alias("ms"))
    by_node = e.groupBy("conv_id", "node").agg(F.min("turn").alias("t"), F.count("*").alias("n"), F.count_if("failed").alias("errors"), F.sum("ms").alias("ms"))
    named = F.filter(F.array_sort(F.collect_list(F.struct("t", "node"))), lambda x: x["node"] != "")  # the different nodes of a trace
    g = by_node.groupBy("conv_id").agg(named.alias("x"), F.sum("n").alias("steps"), F.sum("errors").alias("errors"), F.sum("ms").alias("total_ms"))
    path = F.when(F.size("x") > 0, F.array_join(F.transform("x", lambda n: n["node"]), ">"))
    return g.select("conv_id", path.alias("path"), F.size("x").cast("long").alias("nodes"), "steps", "errors", "total_ms")


CUTOFF = "1998-01-01 00:00:00"


@query("cas_17_before_after", f"""WITH b AS (SELECT customer_id, count(*) FILTER (WHERE ts < TIMESTAMP '{CUTOFF}') AS stale_n, count(*) AS live_n, arg_max(transaction_id, (ts, transaction_id)) FILTER (WHERE ts < TIMESTAMP '{CUTOFF}') AS stale_latest, arg_max(transaction_id, (ts, transaction_id)) AS live_latest FROM txn GROUP BY 1),
  c AS (SELECT customer_id, count(*) FILTER (WHERE created_at >= TIMESTAMP '{CUTOFF}' AND len(rules) > 0) AS would_quarantine, avg((floor(epoch(resolved_at)) - floor(epoch(created_at))) / 60.0::DOUBLE) FILTER (WHERE created_at < TIMESTAMP '{CUTOFF}') AS before, avg((floor(epoch(resolved_at)) - floor(epoch(created_at))) / 60.0::DOUBLE) FILTER (WHERE created_at >= TIMESTAMP '{CUTOFF}') AS after FROM cases GROUP BY 1)
  SELECT customer_id, stale_n, live_n, stale_latest, live_latest, coalesce(would_quarantine, 0) AS would_quarantine, round(before, 4) AS minutes_before, round(after, 4) AS minutes_after FROM b LEFT JOIN c USING (customer_id)""")
def cas_17(v):
    """What a nightly copy would show of a customer against what is there now: bills, the latest of them, what would be
    quarantined since, and minutes to resolve cases of before and since."""
    old, at = (lambda c: F.col(c) < clock(CUTOFF)), F.struct("ts", "transaction_id")
    b = v.bill.groupBy("customer_id").agg(
        F.count_if(old("ts")).alias("stale_n"), F.count("*").alias("live_n"), F.max(F.when(old("ts"), at))["transaction_id"].alias("stale_latest"), F.max(at)["transaction_id"].alias("live_latest"),
    )
    minutes, before = seconds(F.col("resolved_at"), F.col("created_at")) / 60.0, old("created_at")
    c = v.case.groupBy("customer_id").agg(F.count_if(~before & (F.size("rules") > 0)).alias("would_quarantine"), F.avg(F.when(before, minutes)).alias("a"), F.avg(F.when(~before, minutes)).alias("z"))
    t = b.join(c, "customer_id", "left")
    return t.select("customer_id", "stale_n", "live_n", "stale_latest", "live_latest", F.coalesce("would_quarantine", F.lit(0)).alias("would_quarantine"), F.round("a", 4).alias("minutes_before"), F.round("z", 4).alias("minutes_after"))


@query("cas_18_analyst_override", f"""WITH o AS (SELECT *, CASE WHEN amount > 200000 THEN 'true_positive' ELSE 'false_positive' END AS assist FROM cases WHERE disposition IS NOT NULL) SELECT severity, count(*) AS n, count(*) FILTER (WHERE assist <> disposition) AS overridden, count(*) FILTER (WHERE assist <> disposition) / count(*)::DOUBLE AS disagreement, {T('max(resolved_at) FILTER (WHERE assist <> disposition)')} AS last_at,
  arg_max('analyst_' || customer_id % 7, (resolved_at, case_id)) FILTER (WHERE assist <> disposition AND resolved_at IS NOT NULL) AS last_by FROM o GROUP BY 1""")
def cas_18(v):
    """What analysts decided against the assistant is recorded on the case, beside what the assistant said, which stays: a
    keyed update of the table of closed cases. From it, how often they disagree."""
    record = "struct<analyst:string,disposition:string,reason:string,at:timestamp_ntz>"
    assist = F.when(F.col("amount") > 200000, "true_positive").otherwise("false_positive")
    closed = v.case.where("disposition is not null")
    table = SnapshotTable(v.spark, shared_folder(v.spark, "overrides"), f"case_id long, severity string, assist string, override {record}", ["case_id"])
    table.apply(lambda old: closed.select("case_id", "severity", assist.alias("assist"), F.lit(None).cast(record).alias("override")), 0)
    note = F.struct(F.concat(F.lit("analyst_"), F.col("customer_id") % 7).alias("analyst"), "disposition", F.array_join("rules", ",").alias("reason"), F.col("resolved_at").alias("at"))
    against = closed.where(assist != F.col("disposition")).select("case_id", note.alias("override"), F.col("resolved_at").alias("at"))
    table.apply(update_latest(against, ["case_id"], "at"), 1)
    has = F.col("override").isNotNull()
    last = F.max(F.when(F.col("override.at").isNotNull(), F.struct("override.at", "case_id", "override.analyst")))
    t = table.read().groupBy("severity").agg(F.count("*").alias("n"), F.count_if(has).alias("overridden"), last.alias("x"))
    return t.select("severity", "n", "overridden", (F.col("overridden") / F.col("n").cast("double")).alias("disagreement"), stamp("x.at", "last_at"), F.col("x.analyst").alias("last_by"))


@query("ops_01_minute_rate", f"SELECT {T("date_trunc('minute', ts)")} AS minute, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS value, count(*) FILTER (WHERE merchant_id = 'error') AS quarantined FROM ev GROUP BY 1")
def ops_01(v):
    return v.event.groupBy(stamp(F.date_trunc("minute", "ts"), "minute")).agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("value"), F.count_if(F.col("merchant_id") == "error").alias("quarantined"))


LIVE = "max(CASE WHEN rn - 1 = greatest(0, least(n - 1, CAST(floor(n * {p}) AS BIGINT) - 1)) THEN amount END)"
SAMPLES = f"o AS (SELECT date_trunc('hour', ts) AS seen, CAST(amount AS DOUBLE) AS amount, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY amount) AS rn, count(*) OVER (PARTITION BY date_trunc('hour', ts)) AS n FROM ev), samples AS (SELECT seen, max(n) AS n, max(n) / 3600.0::DOUBLE AS tps, {LIVE.format(p=0.5)} AS p50, {LIVE.format(p=0.99)} AS p99, CASE WHEN max(n) >= 18 THEN 'burst' WHEN max(n) >= 8 THEN 'steady' ELSE 'idle' END AS mode FROM o GROUP BY 1)"
RUNS = "r AS (SELECT *, seen - to_hours(CAST(row_number() OVER (ORDER BY seen) AS INTEGER)) AS run FROM samples WHERE mode = 'burst')"


def samples(v):
    """Each hour's number and rate of events, median and 99th percentile of their amounts, and what mode that is."""
    t = v.event.select(F.date_trunc("hour", "ts").alias("at"), F.col("amount").cast("double").alias("x"))
    ranks = nearest_ranks(t, "x", ["at"], {"p50": (0.5, "live"), "p99": (0.99, "live")})
    g = t.groupBy("at").agg(F.count("*").alias("n")).join(ranks, "at", "left")
    n = F.col("n")
    return g.withColumns({"tps": n / F.lit(3600.0), "mode": F.when(n >= 18, "burst").when(n >= 8, "steady").otherwise("idle")})


def burst_runs(hours):
    """Runs of hours in burst mode that follow each other, a row a run; a sample an hour, so few rows."""
    b = hours.where("mode = 'burst'").groupBy(F.session_window("at", "61 minutes").alias("w")).agg(F.array_sort(F.collect_list(F.struct("at", "n", "p99"))).alias("x"))
    peak = F.array_max(F.transform("x", lambda e: e["n"]))
    near = F.size(F.filter("x", lambda e: e["n"] * 10 >= F.col("peak") * 9))
    t = b.select(F.get("x", 0)["at"].alias("started_at"), F.element_at("x", -1)["at"].alias("last_at"), "x", peak.alias("peak"), F.size("x").cast("long").alias("n_samples"))
    total = F.aggregate("x", F.lit(0).cast("long"), lambda a, e: a + e["n"])
    return t.select(
        "started_at", "last_at", "n_samples", "peak", (total / F.col("n_samples")).alias("mean"), F.array_max(F.transform("x", lambda e: e["p99"])).alias("p99_max"), (near / F.col("n_samples")).alias("near_peak"),
        F.size(F.filter("x", lambda e: e["p99"] > 200)).cast("long").alias("breaches"), seconds(F.col("last_at"), F.col("started_at")).alias("duration_s"),
    )


@query("ops_02_system_sample", f"WITH {SAMPLES} SELECT {T('seen')} AS recorded_at, n, tps, p50, p99, mode FROM samples")
def ops_02(v):
    return samples(v).select(stamp("at", "recorded_at"), "n", "tps", "p50", "p99", "mode")


@query("ops_03_burst_status", f"WITH {SAMPLES}, {RUNS}, g AS (SELECT run, max(n) AS peak FROM r GROUP BY 1), b AS (SELECT r.*, peak, min(seen) OVER (PARTITION BY run) AS s, max(seen) OVER (PARTITION BY run) AS e FROM r JOIN g USING (run)) SELECT {T('s')} AS started_at, CASE WHEN (SELECT arg_max(mode, seen) FROM samples) <> 'burst' THEN {T('e')} END AS ended_at, count(*) AS n_samples, max(peak) AS peak, CAST(sum(n) AS DOUBLE) / count(*) AS mean, max(p99) AS p99_max, count(*) FILTER (WHERE n * 10 >= peak * 9) / count(*)::DOUBLE AS near_peak, count(*) FILTER (WHERE p99 > 200) AS breaches, CAST(epoch(e) - epoch(s) AS BIGINT) AS duration_s FROM b GROUP BY s, e ORDER BY s DESC LIMIT 1")
def ops_03(v):
    """The latest run of hours in burst mode; it has ended if the last hour is no burst."""
    hours = samples(v)
    mode = hours.agg(F.max_by("mode", "at").alias("mode"))  # one row
    latest = burst_runs(hours).orderBy(F.desc("started_at")).limit(1).crossJoin(mode)
    rest = [c for c in latest.columns if c not in ("started_at", "last_at", "mode")]
    return latest.select(stamp("started_at", "started_at"), F.when(F.col("mode") != "burst", stamp("last_at", "x")).alias("ended_at"), *rest)


@query("ops_04_recent_samples", f"WITH {SAMPLES}, {RUNS}, w AS (SELECT s.*, run FROM samples s LEFT JOIN r USING (seen) WHERE s.seen >= TIMESTAMP '{AS_OF_EVENTS}' - INTERVAL 2 DAY) SELECT count(*) AS n, list_aggregate(list_sort(list(DISTINCT mode)), 'string_agg', ',') AS modes, arg_max(mode, seen) AS current_mode, count(DISTINCT run) AS burst_runs FROM w")
def ops_04(v):
    """Modes of the last two days' samples, the current one, and how many runs of bursts fall into them."""
    hours, since = samples(v), clock(AS_OF_EVENTS) - F.expr("INTERVAL 2 DAYS")
    runs = burst_runs(hours).where(F.col("last_at") >= since).agg(F.count("*").alias("burst_runs"))
    r = hours.where(F.col("at") >= since).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("mode")), ",").alias("modes"), F.max_by("mode", "at").alias("current_mode"))
    return r.crossJoin(runs)  # one row each


@query("enr_01_totals_from_items", "SELECT transaction_id, CAST(sum(line_total) AS DOUBLE) AS subtotal, CAST(sum(discount) AS DOUBLE) AS discount, CAST(greatest(sum(line_total) - sum(discount), 0) * CAST(0.06 AS DECIMAL(3,2)) AS DOUBLE) AS tax FROM items GROUP BY 1")
def enr_01(v):
    net = F.greatest(F.sum("line_total") - F.sum("discount"), F.lit(0))
    return v.items.groupBy("transaction_id").agg(F.sum("line_total").cast("double").alias("subtotal"), F.sum("discount").cast("double").alias("discount"), (net * F.lit("0.06").cast("decimal(3,2)")).cast("double").alias("tax"))


@query("enr_02_stateless_signals", """WITH l AS (SELECT transaction_id, CAST(sum(line_total) AS DOUBLE) AS subtotal, CAST(sum(discount) AS DOUBLE) AS discount FROM items GROUP BY 1)
  SELECT transaction_id, CASE WHEN subtotal > 0 THEN round(discount / subtotal, 4) ELSE 0 END AS discount_pct, len(promotions) > 0 AS promo_active, customer_id % 3 <> 0 AND TIMESTAMP '1996-01-01' + to_months(CAST(customer_id % 60 AS INTEGER)) > ts AS lock_in, txn_type = 'ppv_charge' AND customer_id % 4 = 0 AS first_ppv,
  CASE WHEN txn_state IS NOT NULL AND txn_state IS DISTINCT FROM home_state THEN 1500 ELSE 0 END AS distance_km, CASE WHEN txn_type = 'termination_fee' AND package_value > 0 THEN round(CAST(total AS DOUBLE) / CAST(package_value AS DOUBLE), 4) END AS fee_pct FROM txn LEFT JOIN l USING (transaction_id) JOIN cust USING (customer_id)""")
def enr_02(v):
    """Two customers of three have an active subscription, locked in for up to five years from 1996; three of four are entitled
    to something; leaving costs what the package is worth."""
    key = F.col("customer_id")
    until = F.add_months(F.lit("1996-01-01").cast("date"), (key % 60).cast("int")).cast("timestamp_ntz")
    who = v.customer.select("customer_id", "home_state", "promotions", F.array(F.struct(F.when(key % 3 != 0, "active").otherwise("ended").alias("status"), until.alias("lock_in_end"))).alias("subscriptions"), F.when(key % 4 != 0, F.array(F.lit("base"))).alias("entitlements"), F.col("package_value").alias("termination_fee"))
    t = v.txn_with(F.sum("line_total").alias("subtotal"), F.sum("discount").alias("discount")).join(who, "customer_id")
    return G.stateless(t).select("transaction_id", "discount_pct", "promo_active", "lock_in", "first_ppv", "distance_km", "fee_pct")


@query("enr_03_batch_totals", "SELECT t.transaction_id, CAST(coalesce(s.net, t.total) AS DOUBLE) AS total, s.net IS NULL AS fallback FROM txn t LEFT JOIN (SELECT transaction_id, sum(line_total - discount + line_total * tax_rate) AS net FROM items GROUP BY 1) s USING (transaction_id)")
def enr_03(v):
    s = v.items.groupBy("transaction_id").agg(F.sum(F.col("line_total") - F.col("discount") + F.col("line_total") * F.col("tax_rate")).alias("net"))
    return v.bill.join(s, "transaction_id", "left").select("transaction_id", F.coalesce("net", "total").cast("double").alias("total"), F.col("net").isNull().alias("fallback"))


@query("enr_04_batch_signals", """WITH l AS (SELECT transaction_id, sum(line_total) AS subtotal, sum(discount) AS discount FROM items GROUP BY 1), t AS (SELECT txn.*, CAST(floor(epoch(ts)) AS BIGINT) AS s, subtotal, discount, home_state, package_value FROM txn LEFT JOIN l USING (transaction_id) LEFT JOIN cust USING (customer_id)),
  w AS (SELECT *, avg(CAST(total AS DOUBLE)) OVER (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING) AS mean, count(*) FILTER (WHERE txn_type = 'ppv_charge') OVER (PARTITION BY customer_id ORDER BY ts, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ppv, min(ts) OVER (PARTITION BY customer_id) AS since, count(*) OVER (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 300 PRECEDING AND CURRENT ROW) AS velocity FROM t)
  SELECT transaction_id, round(coalesce((CAST(total AS DOUBLE) - mean) / nullif(mean, 0) * 100, 0), 2) AS vs_mean_30d, round(coalesce(CAST(coalesce(discount, 0) AS DOUBLE) / nullif(CAST(coalesce(subtotal, total) AS DOUBLE), 0) * 100, 0), 2) AS discount_pct, ppv = 0 AND txn_type = 'ppv_charge' AS first_ppv, ts < since + INTERVAL 24 MONTH AS lock_in,
  CASE WHEN home_state IS NULL OR home_state IS NOT DISTINCT FROM txn_state THEN 0.0 ELSE 200.0 END::DOUBLE AS distance_km, velocity, CASE WHEN txn_type = 'termination_fee' THEN round(CAST(total AS DOUBLE) / nullif(CAST(package_value AS DOUBLE), 0) * 100, 2) END AS fee_pct FROM w""")
def enr_04(v):
    """Signals of stored transactions: percent off the customer's mean of 30 days before, discount of the subtotal in percent,
    first pay-per-view, within 24 months of the first bill, distance from home, bills in five minutes, fee against the
    package's worth."""
    by = W.partitionBy("customer_id")
    span = by.orderBy(F.unix_timestamp("ts"))
    before = by.orderBy("ts", "transaction_id").rowsBetween(W.unboundedPreceding, -1)
    ppv = F.col("txn_type") == "ppv_charge"
    t = v.txn_with(F.sum("line_total").alias("subtotal"), F.sum("discount").alias("discount")).join(v.customer.select("customer_id", "home_state", "package_value"), "customer_id", "left")
    t = t.withColumns({"mean": F.avg(F.col("total").cast("double")).over(span.rangeBetween(-2592000, -1)), "ppv": F.coalesce(F.sum(ppv.cast("int")).over(before), F.lit(0)), "since": F.min("ts").over(by), "velocity": F.count("*").over(span.rangeBetween(-300, 0))})
    number = lambda c: F.col(c).cast("double")
    percent = lambda a, b: F.try_divide(a, b) * 100
    off = percent(number("total") - F.col("mean"), F.col("mean"))
    cut = percent(F.coalesce("discount", F.lit(0)).cast("double"), F.coalesce("subtotal", "total").cast("double"))
    home = F.col("home_state").isNull() | F.col("home_state").eqNullSafe(F.col("txn_state"))
    return t.select(
        "transaction_id", F.round(F.coalesce(off, F.lit(0.0)), 2).alias("vs_mean_30d"), F.round(F.coalesce(cut, F.lit(0.0)), 2).alias("discount_pct"), ((F.col("ppv") == 0) & ppv).alias("first_ppv"), (F.col("ts") < F.col("since") + F.expr("INTERVAL 24 MONTHS")).alias("lock_in"),
        F.when(home, 0.0).otherwise(200.0).alias("distance_km"), "velocity", F.when(F.col("txn_type") == "termination_fee", F.round(percent(number("total"), number("package_value")), 2)).alias("fee_pct"),
    )


@query("enr_05_cycle_id", f"""WITH c AS (SELECT DISTINCT customer_id, date_trunc('month', ts - INTERVAL 14 DAY) + INTERVAL 14 DAY AS s FROM txn WHERE customer_id % 2 = 0 AND month(ts - INTERVAL 14 DAY) % 2 = 1), j AS (SELECT t.*, s FROM txn t LEFT JOIN c ON c.customer_id = t.customer_id AND t.ts >= s AND t.ts < s + INTERVAL 1 MONTH)
  SELECT transaction_id, CASE WHEN s IS NOT NULL THEN 'bc_' || customer_id || '_' || strftime(s, '%Y%m%d') ELSE 'cyc_' || customer_id || '_' || strftime(ts, '%Y%m') END AS cycle_id, CASE WHEN s IS NOT NULL THEN 'covering' ELSE 'made' END AS origin, {T("coalesce(s, date_trunc('month', ts))")} AS cycle_start, CAST(date_diff('day', coalesce(s, date_trunc('month', ts)), coalesce(s, date_trunc('month', ts)) + INTERVAL 1 MONTH) AS INTEGER) AS days FROM j""")
def enr_05(v):
    """The stored cycle that covers a transaction (here: of some customers and months, from the 15th on), else the calendar
    month."""
    start = F.date_trunc("month", F.col("ts") - F.expr("INTERVAL 14 DAYS"))
    stored = v.bill.where((F.col("customer_id") % 2 == 0) & (F.month(start) % 2 == 1)).select("customer_id", (start + F.expr("INTERVAL 14 DAYS")).alias("cycle_start")).distinct()
    stored = stored.withColumn("cycle_end", F.col("cycle_start") + F.expr("INTERVAL 1 MONTH"))
    covering = cycle_join(v.bill, stored).select("transaction_id", "cycle_start")
    t = v.bill.join(covering, "transaction_id", "left")
    known, begin = F.col("cycle_start").isNotNull(), F.coalesce("cycle_start", F.date_trunc("month", "ts"))
    name = F.when(known, F.concat_ws("_", F.lit("bc"), "customer_id", F.date_format("cycle_start", "yyyyMMdd"))).otherwise(F.concat_ws("_", F.lit("cyc"), "customer_id", F.date_format("ts", "yyyyMM")))
    return t.select("transaction_id", name.alias("cycle_id"), F.when(known, "covering").otherwise("made").alias("origin"), stamp(begin, "cycle_start"), F.datediff(begin + F.expr("INTERVAL 1 MONTH"), begin).alias("days"))


@query("enr_06_primary_entity", "SELECT customer_id, coalesce(CASE WHEN customer_id % 3 = 0 THEN NULL ELSE entity END, segment) AS primary_entity FROM cust")
def enr_06(v):
    listed = F.when(F.col("customer_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("entity"))
    profiles = F.create_map("segment", F.lit(1.0))
    return v.customer.select("customer_id", F.coalesce(F.get(listed, 0), F.map_keys(profiles)[0]).alias("primary_entity"))


#: Transactions of a bucket at most, and from how many on it counts as nearly full.
CAP, ALARM = 500, 480


def buckets(bills, cap=CAP, alarm=ALARM):
    """Transactions of a customer and cycle in buckets of at most ``cap``, in order of time, with their counters."""
    w = W.partitionBy("customer_id", "cycle").orderBy("ts", "transaction_id")
    t = bills.withColumn("bucket", F.floor((F.row_number().over(w) - 1) / cap))
    name = F.concat_ws("_", F.lit("bkt"), "customer_id", "cycle", F.col("bucket") + 1)
    g = t.groupBy("customer_id", "cycle", "bucket").agg(F.count("*").alias("n"), F.count_if(F.col("txn_type") == "ppv_charge").alias("ppv"), F.sum("total").alias("total"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))
    return g.withColumns({"bucket_id": name, "near_cap": F.col("n") >= alarm})


@query("enr_08_commercial_buckets", f"SELECT 'bkt_' || customer_id || '_' || cycle || '_' || CAST((rn - 1) // {CAP} + 1 AS BIGINT) AS bucket_id, customer_id, cycle, count(*) AS n, count(*) >= {ALARM} AS near_cap, count(*) FILTER (WHERE txn_type = 'ppv_charge') AS ppv, CAST(sum(total) AS DOUBLE) AS total FROM (SELECT *, strftime(ts, '%Y%m') AS cycle, row_number() OVER (PARTITION BY customer_id, strftime(ts, '%Y%m') ORDER BY ts, transaction_id) rn FROM txn JOIN cust USING (customer_id) WHERE customer_type = 'commercial') GROUP BY customer_id, cycle, (rn - 1) // {CAP}")
def enr_08(v):
    bills = v.bill.join(v.customer.where("customer_type = 'commercial'").select("customer_id"), "customer_id").withColumn("cycle", F.date_format("ts", "yyyyMM"))
    return buckets(bills).select("bucket_id", "customer_id", "cycle", "n", "near_cap", "ppv", F.col("total").cast("double").alias("total"))


@query("enr_09_rolling_signals", f"""WITH e AS (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 5 AS BIGINT) END AS v0, CASE WHEN event_id % 4 = 0 THEN (event_id % 100) / 100.0::DOUBLE END AS r0 FROM ev), f AS (SELECT customer_id, s // 300 * 300 + 300 AS e, count(*) AS n FROM e GROUP BY 1, 2),
  h AS (SELECT *, count(*) OVER w AS m, CAST(sum(amount) OVER w AS DOUBLE) / count(*) OVER w AS mean FROM e WINDOW w AS (PARTITION BY customer_id ORDER BY s RANGE BETWEEN 2592000 PRECEDING AND 1 PRECEDING)),
  j AS (SELECT h.*, f.n AS vel FROM h ASOF LEFT JOIN f ON f.customer_id = h.customer_id AND f.e <= h.s), k AS (SELECT *, coalesce(v0, vel) AS v1, coalesce(r0, CASE WHEN m >= 3 AND mean > 0 THEN round((CAST(amount AS DOUBLE) - mean) / mean, 4) END) AS r1 FROM j)
  SELECT event_id, v1 AS velocity_5m, r1 AS vs_mean_30d, (v0 IS NULL AND v1 IS NOT NULL) OR (r0 IS NULL AND r1 IS NOT NULL) AS stamped FROM k""")
def enr_09(v):
    """Events of which some came with one signal or both; the rest are stamped."""
    e, key = v.event, F.col("event_id")
    rows = e.select(key.alias("row_id"), "customer_id", "ts", "amount", F.when(key % 3 == 0, key % 5).alias("velocity_5m"), F.when(key % 4 == 0, key % 100 / 100.0).alias("vs_mean_30d"), F.lit(None).cast("timestamp_ntz").alias("computed_at"))
    window_end = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 300) * 300 + 300).cast("timestamp_ntz")
    features = e.groupBy("customer_id", window_end.alias("window_end")).agg(F.count("*").alias("n"))
    t = G.stamped(rows, features, e.select("customer_id", "ts", "amount"), clock(AS_OF_EVENTS))
    return t.select(F.col("row_id").alias("event_id"), "velocity_5m", "vs_mean_30d", F.col("computed_at").isNotNull().alias("stamped"))


@query("enr_10_mark_quarantined", "SELECT t.transaction_id, c.case_id IS NOT NULL AS quarantined FROM txn t LEFT JOIN (SELECT case_id FROM cases WHERE len(rules) >= 2) c ON c.case_id = t.transaction_id")
def enr_10(v):
    hit = v.case.where(F.size("rules") >= 2).select(F.col("case_id").alias("transaction_id"), F.array("case_id").alias("case_ids"))
    return v.bill.join(hit, "transaction_id", "left").select("transaction_id", F.col("case_ids").isNotNull().alias("quarantined"))


@query("cyc_01_trailing_cycles", f"SELECT customer_id, 'cyc_' || customer_id || '_' || strftime(TIMESTAMP '2001-08-01' - to_months(CAST(k AS INTEGER)), '%Y%m') AS cycle_id, CASE WHEN k = 0 THEN 'open' ELSE 'billed' END AS status FROM cust, range(6) r(k)")
def cyc_01(v):
    t = v.customer.select("customer_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    start = F.add_months(F.lit("2001-08-01").cast("date"), -F.col("k"))
    return t.select("customer_id", F.concat(F.lit("cyc_"), "customer_id", F.lit("_"), F.date_format(start, "yyyyMM")).alias("cycle_id"), F.when(F.col("k") == 0, "open").otherwise("billed").alias("status"))


@query("cyc_02_cycle_counters", "SELECT customer_id, strftime(ts, '%Y%m') AS cycle, count(*) AS n, CAST(sum(total) AS DOUBLE) AS total FROM txn GROUP BY 1, 2")
def cyc_02(v):
    return v.bill.groupBy("customer_id", F.date_format("ts", "yyyyMM").alias("cycle")).agg(F.count_distinct("transaction_id").alias("n"), F.sum("total").cast("double").alias("total"))


@query("cyc_03_status_timeline", "SELECT customer_id, strftime(ts, '%Y%m') AS cycle, list_aggregate(list(status ORDER BY ts, transaction_id), 'string_agg', '>') AS timeline, arg_max(status, (ts, transaction_id)) AS current_status FROM txn GROUP BY 1, 2")
def cyc_03(v):
    g = v.bill.groupBy("customer_id", F.date_format("ts", "yyyyMM").alias("cycle")).agg(F.array_sort(F.collect_list(F.struct("ts", "transaction_id", "status"))).alias("x"))
    return g.select("customer_id", "cycle", F.array_join(F.transform("x", lambda e: e["status"]), ">").alias("timeline"), F.element_at("x", -1)["status"].alias("current_status"))


#: Revenue categories by the kind of a transaction; the rest is other.
CATEGORIES = {"subscription": ("subscription_charge",), "addons": ("addon_charge", "addon_purchase"), "ppv": ("ppv_charge",), "fees": ("termination_fee",)}
CYCLE_SQL = """c AS (SELECT customer_id, strftime(ts, '%Y%m') AS cycle, sum(total) AS billed, coalesce(sum(total) FILTER (WHERE txn_type = 'subscription_charge'), 0) AS subscription, coalesce(sum(total) FILTER (WHERE txn_type IN ('addon_charge', 'addon_purchase')), 0) AS addons,
  coalesce(sum(total) FILTER (WHERE txn_type = 'ppv_charge'), 0) AS ppv, coalesce(sum(total) FILTER (WHERE txn_type = 'termination_fee'), 0) AS fees, coalesce(sum(total) FILTER (WHERE txn_type = 'refund'), 0) AS other FROM txn GROUP BY 1, 2),
  p AS (SELECT *, lag(billed) OVER w AS expected, lag(cycle) OVER w AS previous_cycle, lag(subscription) OVER w AS e0, lag(addons) OVER w AS e1, lag(ppv) OVER w AS e2, lag(fees) OVER w AS e3, lag(other) OVER w AS e4 FROM c WINDOW w AS (PARTITION BY customer_id ORDER BY cycle)),
  d AS (SELECT *, [{'f': 'subscription', 'd': subscription - e0}, {'f': 'addons', 'd': addons - e1}, {'f': 'ppv', 'd': ppv - e2}, {'f': 'fees', 'd': fees - e3}, {'f': 'other', 'd': other - e4}] AS x FROM p)"""


@query("cyc_04_expected_vs_billed", f"""WITH {CYCLE_SQL} SELECT customer_id, cycle, CAST(billed AS DOUBLE) AS billed, CAST(subscription AS DOUBLE) AS subscription, CAST(addons AS DOUBLE) AS addons, CAST(ppv AS DOUBLE) AS ppv, CAST(fees AS DOUBLE) AS fees, CAST(other AS DOUBLE) AS other, previous_cycle, CAST(expected AS DOUBLE) AS expected,
  CAST(billed - expected AS DOUBLE) AS delta, round(CAST(billed - expected AS DOUBLE) / nullif(CAST(expected AS DOUBLE), 0) * 100, 6) AS percent,
  CASE WHEN expected IS NOT NULL THEN array_to_string(list_transform(list_slice(list_sort(list_transform(list_filter(x, lambda e: e.d <> 0), lambda e: {{'k': -abs(e.d), 'f': e.f, 'd': e.d}})), 1, 3), lambda e: e.f || ':' || CAST(e.d AS VARCHAR)), ',') END AS drivers FROM d""")
def cyc_04(v):
    """A cycle by revenue category, against the customer's cycle before it as what was to be expected: difference, percent, and
    the three categories that move it most."""
    kind = lookup_category(F.col("txn_type"))
    names = [*CATEGORIES, "other"]
    t = v.bill.select("customer_id", F.date_format("ts", "yyyyMM").alias("cycle"), kind.alias("category"), "total")
    g = t.groupBy("customer_id", "cycle").pivot("category", names).agg(F.sum("total")).na.fill(0, names)
    g = g.withColumn("billed", reduce(lambda a, b: a + b, [F.col(n) for n in names]))
    w = W.partitionBy("customer_id").orderBy("cycle")
    before = {n: F.lag(n).over(w) for n in [*names, "billed", "cycle"]}
    g = g.withColumns({f"{n}_was": c for n, c in before.items()})
    moves = F.filter(F.array(*[F.struct((-F.abs(F.col(n) - F.col(f"{n}_was"))).alias("k"), F.lit(n).alias("f"), (F.col(n) - F.col(f"{n}_was")).cast("decimal(18,2)").alias("d")) for n in names]), lambda e: e["d"] != 0)
    drivers = F.array_join(F.transform(F.slice(F.array_sort(moves), 1, 3), lambda e: F.concat(e["f"], F.lit(":"), e["d"].cast("string"))), ",")
    delta = F.col("billed") - F.col("billed_was")
    as_number = [F.col(n).cast("double").alias(n) for n in ("billed", *names)]
    percent = F.round(F.try_divide(delta.cast("double"), F.col("billed_was").cast("double")) * 100, 6)
    return g.select("customer_id", "cycle", *as_number, F.col("cycle_was").alias("previous_cycle"), F.col("billed_was").cast("double").alias("expected"), delta.cast("double").alias("delta"), percent.alias("percent"), F.when(F.col("billed_was").isNotNull(), drivers).alias("drivers"))


def lookup_category(kind):
    """The revenue category of a kind of transaction."""
    out = F.lit("other")
    for name, kinds in CATEGORIES.items():
        out = F.when(kind.isin(*kinds), name).otherwise(out)
    return out


#: Charge code, revenue category, general-ledger account.
CATALOG = [("CC_SUBSCRIPTION_BASE", "subscription", "4000-SUB"), ("CC_PPV_DIRECT", "ppv", "4100-PPV-DIRECT"), ("CC_BUNDLE_PPV", "ppv", "4110-PPV-BUNDLE")]


@query("cyc_05_charge_code_rollup", f"""WITH g AS (SELECT charge_code, category, gl_account, count(*) FILTER (WHERE shipped_at >= {NOW} - INTERVAL 30 DAY) AS usage_30d, count(*) AS usage_total, count(DISTINCT transaction_id) AS txns, sum(line_total) AS revenue FROM items JOIN (VALUES {', '.join(map(str, CATALOG))}) c(charge_code, category, gl_account) USING (charge_code) GROUP BY 1, 2, 3)
  SELECT charge_code, category, gl_account, usage_30d, usage_total, txns, CAST(revenue AS DOUBLE) AS revenue, CAST(revenue AS DOUBLE) / nullif(CAST(sum(revenue) OVER (PARTITION BY category) AS DOUBLE), 0) AS category_share FROM g""")
def cyc_05(v):
    """Use and revenue of each charge code, with its category and account, and its share of the category."""
    catalog = v.spark.createDataFrame(CATALOG, "charge_code string, category string, gl_account string")
    recent = F.col("shipped_at") >= clock(AS_OF_ORDERS) - F.expr("INTERVAL 30 DAYS")
    g = v.items.groupBy("charge_code").agg(F.count_if(recent).alias("usage_30d"), F.count("*").alias("usage_total"), F.count_distinct("transaction_id").alias("txns"), F.sum("line_total").alias("revenue"))
    all_ = F.sum("revenue").over(W.partitionBy("category")).cast("double")  # a row a code
    t = g.join(F.broadcast(catalog), "charge_code")  # three rows
    return t.withColumn("category_share", F.try_divide(F.col("revenue").cast("double"), all_)).withColumn("revenue", F.col("revenue").cast("double"))
