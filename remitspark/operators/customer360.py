"""A customer's record: monthly trends and value, engagement, refresh under a cooldown, differences to snapshots of a CRM.

Nulls: a bill, ticket or touch without customer or time counts for nobody; a missing amount counts as 0; who has no bills,
tickets or touches has zeros, not nulls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitspark.functions.stats import band
from remitspark.operators.joins import as_of_join

#: Months of a trend, types of bills that are pay-per-view, hours between two computations.
MONTHS = 12
PPV = ("ppv_charge", "ppv_purchase")
COOLDOWN_HOURS = 6
RATES = ("support_response_rate", "marketing_open_rate", "marketing_click_rate")
#: Lag of a snapshot's source in seconds from which it is of a band; hours after which a field is stale.
LAG_BANDS = [(86400, "critical"), (21600, "high"), (3600, "medium")]
STALE_HOURS = 24


def month_starts(as_of: Column, months: int = MONTHS) -> Column:
    """The first days of so many months up to that of ``as_of``, oldest first."""
    last = F.trunc(as_of, "month")
    return F.sequence(F.add_months(last, -(months - 1)), last, F.expr("INTERVAL 1 MONTH"))


def trends(customers: DataFrame, bills: DataFrame, as_of: Column, months: int = MONTHS) -> DataFrame:
    """Each row of customers with ``spend`` (decimal), ``hours`` (2 places) and ``ppv`` as arrays of a number a month, oldest
    first, zero where nothing was settled, and ``ltv``, the sum of spend.

    bills(customer_id, ts, status, txn_type, total, viewing_minutes). All months are summed side by side in one aggregation,
    which a task does for its rows before it shuffles one row a customer; no month is exploded.
    """
    back = (F.year(as_of) - F.year("ts")) * 12 + F.month(as_of) - F.month("ts")
    t = bills.where(F.col("status") == "settled").withColumn("place_", F.lit(months - 1) - back).where(F.col("place_").between(0, months - 1))
    zero = F.lit(0).cast("decimal(28,2)")

    def each(x: Column) -> Column:
        return F.array(*[F.sum(F.when(F.col("place_") == k, x)) for k in range(months)])

    g = t.groupBy("customer_id").agg(
        each(F.coalesce(F.col("total"), F.lit(0).cast("decimal(18,2)"))).alias("spend_"), each(F.col("viewing_minutes")).alias("minutes_"), each(F.col("txn_type").isin(*PPV).cast("long")).alias("ppv_")
    )
    none = lambda x: F.array_repeat(x, months)
    j = customers.join(g, "customer_id", "left").withColumns({
        "spend": F.coalesce(F.transform("spend_", lambda x: F.coalesce(x.cast("decimal(28,2)"), zero)), none(zero)),
        "hours": F.coalesce(F.transform("minutes_", lambda x: F.round(F.coalesce(x.cast("double"), F.lit(0.0)) / 60.0, 2)), none(F.lit(0.0))),
        "ppv": F.coalesce(F.transform("ppv_", lambda x: F.coalesce(x, F.lit(0).cast("long"))), none(F.lit(0).cast("long"))),
    }).drop("spend_", "minutes_", "ppv_")
    return j.withColumn("ltv", F.aggregate("spend", zero, lambda a, x: (a + x).cast("decimal(28,2)")))


def by_month(t: DataFrame, as_of: Column, months: int = MONTHS) -> DataFrame:
    """Trends as a row a month: customer_id, month (yyyy-MM), spend, hours, ppv, ltv."""
    zipped = F.arrays_zip(month_starts(as_of, months).alias("at"), "spend", "hours", "ppv")
    x = t.select("customer_id", "ltv", F.explode(zipped).alias("x"))
    return x.select("customer_id", F.date_format("x.at", "yyyy-MM").alias("month"), "x.spend", "x.hours", "x.ppv", "ltv")


def engagement(customers: DataFrame, tickets: DataFrame, touches: DataFrame) -> DataFrame:
    """Each row of customers with the shares of its support tickets that were resolved and of its marketing touches that were
    opened and clicked; 0 where there are none. tickets(customer_id, status), touches(customer_id, opened_at, clicked_at)."""
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n).cast("double"), F.col(of).cast("double")), F.lit(0.0))
    t = tickets.groupBy("customer_id").agg(F.count("*").alias("tickets_"), F.count_if(F.col("status") == "resolved").alias("resolved_"))
    m = touches.groupBy("customer_id").agg(F.count("*").alias("touches_"), F.count("opened_at").alias("opened_"), F.count("clicked_at").alias("clicked_"))
    made = dict(zip(RATES, (share("resolved_", "tickets_"), share("opened_", "touches_"), share("clicked_", "touches_"))))
    j = customers.join(t, "customer_id", "left").join(m, "customer_id", "left")
    return j.withColumns(made).drop("tickets_", "resolved_", "touches_", "opened_", "clicked_")


def channel_rates(touches: DataFrame) -> DataFrame:
    """By customer and channel: total_sent, shares of what was sent that was opened, clicked and led to a sale, and the last
    time of any of these (null: never). touches(customer_id, channel, opened_at, clicked_at, converted_at)."""
    rate = lambda c, name: (F.count(c) / F.count("*").cast("double")).alias(name)
    return touches.groupBy("customer_id", "channel").agg(
        F.count("*").alias("total_sent"), rate("opened_at", "open_rate"), rate("clicked_at", "ctr"), rate("converted_at", "conversion_rate"), F.max(F.greatest("opened_at", "clicked_at", "converted_at")).alias("last_engaged_at"),
    )


def cooled_down(computed_at: Column, now: Column, hours: int = COOLDOWN_HOURS) -> Column:
    """Computed less than so many hours ago; never computed is not cooled down."""
    return F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(computed_at) < hours * 3600, F.lit(False))


def refresh_outcomes(requests: DataFrame, customers: DataFrame, state: DataFrame, now: Column, hours: int = COOLDOWN_HOURS) -> DataFrame:
    """One row a requested customer: ``forced`` if any of its requests was, and ``outcome``: not_found, skipped (cooldown, not
    forced) or computed. requests(customer_id, force), state(customer_id, computed_at). A request without an id is not_found."""
    asked = requests.groupBy("customer_id").agg(F.coalesce(F.bool_or("force"), F.lit(False)).alias("forced"))
    known = customers.select("customer_id").distinct().withColumn("known_", F.lit(True))
    last = state.groupBy("customer_id").agg(F.max("computed_at").alias("computed_at"))
    t = asked.join(known, "customer_id", "left").join(last, "customer_id", "left")
    outcome = F.when(F.col("known_").isNull(), "not_found").when(~F.col("forced") & cooled_down(F.col("computed_at"), now, hours), "skipped").otherwise("computed")
    return t.select("customer_id", "forced", outcome.alias("outcome"))


#: What the nightly job keeps of a customer.
RECORD = (
    "customer_id long, customer_type string, ltv decimal(28,2), spend array<decimal(28,2)>, hours array<double>, ppv array<bigint>, "
    "support_response_rate double, marketing_open_rate double, marketing_click_rate double, computed_at timestamp_ntz"
)


def nightly(table, customers: DataFrame, bills: DataFrame, tickets: DataFrame, touches: DataFrame, now: str, batch: int, hours: int = COOLDOWN_HOURS) -> DataFrame:
    """Compute trends and engagement anew for the customers that have not cooled down and put them into the table (a
    ``SnapshotTable`` of ``RECORD`` by customer_id); tells (customer_type, scanned, updated, skipped).

    A row of customers without an id is skipped. Bills, tickets and touches of others than those due are dropped by a
    semi-join before they are summed up. A batch that is run again after its table was published changes nothing."""
    from remitspark.streaming.tables import replace_by_key

    at = F.lit(now).cast("timestamp_ntz")
    state = table.read().select("customer_id", "computed_at")
    t = customers.select("customer_id", "customer_type").join(state, "customer_id", "left")
    is_due = F.col("customer_id").isNotNull() & ~cooled_down(F.col("computed_at"), at, hours)
    due = t.where(is_due).select("customer_id", "customer_type")
    only = lambda x: x.join(due.select("customer_id"), "customer_id", "left_semi")
    new = engagement(trends(due, only(bills), at), only(tickets), only(touches)).withColumn("computed_at", at)
    seen = t.groupBy("customer_type").agg(F.count("*").alias("scanned"), F.count_if(is_due).alias("updated"), F.count_if(~is_due).alias("skipped")).collect()  # a row a type
    table.apply(replace_by_key(new, ["customer_id"]), batch, "nightly")
    return table.spark.createDataFrame([tuple(r) for r in seen], "customer_type string, scanned long, updated long, skipped long")


def crm_diff(cases: DataFrame, snapshots: DataFrame, current: DataFrame, fields: Sequence[str], lists: Sequence[str] = ("promotions", "entitlements")) -> DataFrame:
    """What the CRM's last snapshot before a case got wrong.

    cases(row_id, customer_id, at), snapshots(customer_id, snapshot_id, snapshot_at, lag_seconds, each of ``lists`` and
    ``fields``), current(customer_id, each of ``lists``). A row a case: the snapshot (null: none before it), what each list has
    gained (added_) and lost (removed_) since, sorted; ``delta_count`` of all, and ``delta_severity``: what the customer holds by
    now but not in the snapshot would have caused a quarantine; whole ``staleness_hours``, the source's ``lag_band``, the fields
    that are missing and ``completeness`` (share of fields present, 4 places). A null list is an empty one.
    """
    seen = list(dict.fromkeys(["snapshot_id", "lag_seconds", *lists, *fields]))  # a list may be one of the fields
    t = as_of_join(cases, snapshots, ["customer_id"], "at", "snapshot_at", seen)
    now = current.select("customer_id", *[F.col(c).alias(f"now_{c}") for c in lists])
    j = t.join(now, "customer_id", "left")
    found = F.col("snapshot_id").isNotNull()
    held = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    less = lambda a, b: F.when(found, F.array_sort(F.array_except(held(F.col(a)), held(F.col(b)))))
    made = {f"added_{c}": less(f"now_{c}", c) for c in lists} | {f"removed_{c}": less(c, f"now_{c}") for c in lists}
    missing = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    j = j.withColumns(made).withColumn("fields_missing", F.when(found, missing))
    total = lambda names: sum((F.size(n) for n in names), F.lit(0)).cast("long")
    gained = total([f"added_{c}" for c in lists])
    hours = F.floor((F.unix_timestamp("at") - F.unix_timestamp("snapshot_at")) / 3600)
    return j.select(
        "row_id", "customer_id", "snapshot_id", *made, F.when(found, total(made)).alias("delta_count"), F.when(found & (gained > 0), "would_have_caused_quarantine").when(found, "normal").alias("delta_severity"),
        hours.alias("staleness_hours"), (hours > STALE_HOURS).alias("is_stale"), F.when(found, band(F.coalesce("lag_seconds", F.lit(0)), LAG_BANDS, "low")).alias("lag_band"),
        "fields_missing", F.round(1 - F.size("fields_missing") / float(len(fields)), 4).alias("completeness"),
    )


def monthly_value(subscriptions: DataFrame) -> DataFrame:
    """By customer: how many products it subscribes to and the sum of their fees, each as last billed (ties: the largest by
    transaction, line and fee). subscriptions(customer_id, product_ref, ts, transaction_id, line_no, fee)."""
    order = F.struct("ts", "transaction_id", "line_no", "fee")
    last = subscriptions.groupBy("customer_id", "product_ref").agg(F.max(order).alias("x"))
    return last.groupBy("customer_id").agg(F.count("*").alias("n_subscriptions"), F.sum("x.fee").alias("monthly_value"))
