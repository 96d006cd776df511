"""Case scoring, service levels, revenue and lifecycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severity weights, minutes to resolve, priority bands.
SEVERITY = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
TARGET_MINUTES = {"critical": 30, "high": 240, "medium": 1440, "low": 4320}
BANDS = [(0.85, "P0"), (0.65, "P1"), (0.40, "P2")]


def lookup(c: str, table: dict, default) -> Column:
    out = None
    for k, x in table.items():
        out = F.when(F.col(c) == k, x) if out is None else out.when(F.col(c) == k, x)
    return out.otherwise(default)


def priority_score(severity: str, amount: Column, prior: Column, commercial: Column) -> Column:
    """0.55 severity + 0.30 amount (full at 5000) + 0.10 earlier cases (full at 5) + 0.05 commercial, 4 places."""
    part = lambda x, full: F.least(F.lit(1.0), x.cast("double") / full)
    return F.bround(0.55 * lookup(severity, SEVERITY, 0.25) + 0.30 * part(amount, 5000.0) + 0.10 * part(prior, 5.0) + 0.05 * commercial.cast("int"), 4)


def priority_drivers(severity: str, amount: Column, prior: Column, commercial: Column) -> Column:
    """What a score came from, in this order: severity, an amount of 1000 or more, two earlier cases or more, a commercial account."""
    told = [F.concat(F.lit("severity:"), F.col(severity)), F.when(amount >= 1000, F.concat(F.lit("amount_at_risk:"), amount.cast("decimal(18,2)"))), F.when(prior >= 2, F.concat(F.lit("repeat_offender:"), prior)), F.when(commercial, F.lit("commercial_account"))]
    return F.array_compact(F.array(*told))


def priority_band(score: Column) -> Column:
    from remitspark.functions.stats import band

    return band(score, BANDS, "P3")


def sla_target(created: Column, severity: str) -> Column:
    return created + F.make_dt_interval(mins=lookup(severity, TARGET_MINUTES, 4320))


def sla_tick(as_of: Column, target: Column, breached_at: Column) -> dict[str, Column]:
    """Minutes to the target and the breach stamp, which is set once."""
    left = (F.unix_timestamp(target) - F.unix_timestamp(as_of)) / 60.0
    return {"minutes_to_breach": left, "is_breached": left < 0, "breached_at": F.coalesce(breached_at, F.when(left < 0, as_of))}


def revenue_impact(amount: Column, severity: Column, ops_cost: float = 12.0) -> tuple[Column, Column]:
    """Revenue at stake (0.8 of the amount when severe, else 0.5) and what is left after the cost of a case, in decimals,
    half cents to the even cent."""
    share = F.when(severity.isin("critical", "high"), F.lit("0.8").cast("decimal(2,1)")).otherwise(F.lit("0.5").cast("decimal(2,1)"))
    at_stake = share * amount.cast("decimal(18,2)")
    return F.bround(at_stake, 2), F.bround(at_stake - F.lit(str(ops_cost)).cast("decimal(10,2)"), 2)


#: Which status may follow which.
LEGAL = {"open": ("under_review", "resolved"), "under_review": ("resolved", "open"), "resolved": ()}


def transition(current: Column, to: str) -> Column:
    """Whether a case may move on to ``to``."""
    return current.isin(*[a for a, b in LEGAL.items() if to in b])


def vote(tp: Column, fp: Column, n: Column, base: float) -> list[Column]:
    """Vote, weight and confidence from the dispositions of n retrieved cases, blended with a prior confidence."""
    weight = F.least(F.lit(1.0), n / F.lit(5.0))
    thin, for_tp, for_fp = n < 2, tp * 10 >= n * 7, fp * 10 >= n * 7
    says = F.when(thin, "prior").when(for_tp, "true_positive").when(for_fp, "false_positive").otherwise("needs_more_info")
    level = F.when(for_tp, 0.85).when(for_fp, 0.75).otherwise(0.5)
    return [says.alias("vote"), weight.alias("weight"), F.round(F.when(thin, base).otherwise(base * (1 - weight) + level * weight), 2).alias("confidence")]


#: The version of a case row that ``upgraded`` makes, and statuses that end a case.
VERSION, TERMINAL = 3, ("resolved", "dismissed")
CURRENT = (
    "case_id long, customer_id long, severity string, amount decimal(18,2), status string, disposition string, created_at timestamp_ntz, resolved_at timestamp_ntz, rules array<string>, "
    "schema_version int, customer_type string, priority_score double, priority_band string, sla_target timestamp_ntz, at_stake decimal(18,2), net decimal(18,2), "
    "lifecycle array<struct<at:timestamp_ntz,actor:string,from_status:string,to_status:string,note:string>>"
)


def upgraded(old: DataFrame, customers: DataFrame) -> DataFrame:
    """Case rows of older versions as rows of this one: priority, service level, revenue at stake, and a life that begins with
    the case and, where it has ended, ends when it did, not when it was upgraded. customers(customer_id, customer_type, prior).
    Rows of unknown customers are left out."""
    t = old.join(customers, "customer_id")
    score = priority_score("severity", F.col("amount"), F.coalesce("prior", F.lit(0)), F.col("customer_type") == "commercial")
    stake, net = revenue_impact(F.col("amount"), F.col("severity"))
    ended = F.col("status").isin(*TERMINAL)
    event = lambda at, actor, a, b, note: F.struct(at.alias("at"), F.lit(actor).alias("actor"), F.lit(a).cast("string").alias("from_status"), b.alias("to_status"), note.alias("note"))
    life = F.array(event(F.col("created_at"), "backfill", None, F.lit("open"), F.array_join("rules", ",")), F.when(ended, event(F.col("resolved_at"), "analyst", "open", F.col("status"), F.col("disposition"))))
    at_end = lambda c: F.when(ended, F.col(c)).alias(c)
    return t.select(
        "case_id", "customer_id", "severity", "amount", "status", at_end("disposition"), "created_at", at_end("resolved_at"), "rules", F.lit(VERSION).alias("schema_version"), "customer_type",
        score.alias("priority_score"), priority_band(score).alias("priority_band"), sla_target(F.col("created_at"), "severity").alias("sla_target"), stake.alias("at_stake"), net.alias("net"), F.array_compact(life).alias("lifecycle"),
    )


def upgrade_step(table, customers: DataFrame, batch: int, writer: str = "upgrade") -> DataFrame:
    """Upgrade the rows of a stored table that are of an older version, and tell (outcome, n) of all rows scanned: upgraded,
    skipped_unknown_customer. The table holds rows of both versions side by side, those of the older one with nulls in what
    it lacks; rows of this version are not scanned, so that a second run upgrades none."""
    from remitspark.streaming.tables import replace_by_key

    spark = table.spark
    old = table.read().where(F.coalesce("schema_version", F.lit(0)) < VERSION)
    new = upgraded(old.select("case_id", "customer_id", "severity", "amount", "status", "disposition", "created_at", "resolved_at", "rules"), customers)
    scanned, done = old.count(), new.count()
    if done:
        table.apply(replace_by_key(new, ["case_id"]), batch, writer)
    return spark.createDataFrame([("scanned", scanned), ("upgraded", done), ("skipped_unknown_customer", scanned - done)], "outcome string, n long")


#: A case as decided on, and as it is kept for retrieval.
DECIDED = "case_id long, status string, disposition string, analyst string, notes string, resolved_at timestamp_ntz"
ARCHIVE_VERSION = 4
ARCHIVED = f"{DECIDED}, schema_version int, text string"


def dispose(cases, history, decisions: DataFrame, texts: DataFrame, batch: int, writer: str = "disposition") -> None:
    """Put analysts' decisions on the stored cases, and the cases that this resolves into the archive with their text.

    Both are snapshot tables by case_id, of ``DECIDED`` and ``ARCHIVED`` rows. decisions(case_id, disposition, analyst, notes, at),
    texts(case_id, text). True and false positives resolve a case, anything else (null too) puts it under review and leaves the
    archive as it is. Of several decisions on a case the latest counts (ties: the largest by all columns); decisions on unknown cases
    change nothing. The archive is written first, so a batch that fails between the two is completed by running it again.
    What both tables get is worked out once and saved, as a table goes through its new rows several times."""
    from remitspark.sources.scratch import shared_folder
    from remitspark.streaming.tables import merged, replace_by_key

    def saved(df: DataFrame) -> DataFrame:
        df.write.parquet(folder := shared_folder(df.sparkSession, "batch"))
        return df.sparkSession.read.schema(df.schema).parquet(folder)

    latest = decisions.groupBy("case_id").agg(F.max(F.struct("at", "disposition", "analyst", "notes")).alias("d"))
    ends = F.coalesce(F.col("d.disposition").isin("true_positive", "false_positive"), F.lit(False))
    status = F.when(ends, "resolved").otherwise("under_review").alias("status")
    rows = saved(latest.join(merged(cases.read().select("case_id")), "case_id").select("case_id", status, "d.disposition", "d.analyst", "d.notes", F.when(ends, F.col("d.at")).alias("resolved_at")))
    kept = saved(rows.where(F.col("status") == "resolved").join(merged(texts.select("case_id", "text")), "case_id", "left").withColumn("schema_version", F.lit(ARCHIVE_VERSION)))
    history.apply(replace_by_key(kept, ["case_id"]), batch, writer)
    cases.apply(replace_by_key(rows, ["case_id"]), batch, writer)
