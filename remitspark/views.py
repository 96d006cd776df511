"""The billing domain over the driver's tables: one DataFrame and one SQL text for each view.

Money is decimal inside operators, so that sums do not depend on their order, and double where a query ends.
Clocks are fixed: no operator asks for the current time.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF_EVENTS = "2024-01-31 00:00:00"
AS_OF_ORDERS = "2001-08-02 00:00:00"


def money(c: str, scale: int = 2):
    return F.col(c).cast(f"decimal(18,{scale})")


def as_double(*names: str):
    return [F.col(n).cast("double").alias(n) for n in names]


def clock(text: str):
    return F.lit(text).cast("timestamp_ntz")


def stamp(c, name: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def seconds(later, earlier):
    """Whole seconds between two times."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def items(self) -> DataFrame:
        code = F.when(F.col("l_returnflag") == "A", "CC_PPV_DIRECT").when(F.col("l_returnflag") == "R", "CC_BUNDLE_PPV").otherwise("CC_SUBSCRIPTION_BASE")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("transaction_id"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("product_ref"),
            F.col("l_suppkey").alias("merchant_id"), money("l_quantity").alias("quantity"), money("l_extendedprice").alias("line_total"),
            (money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")).cast("decimal(18,4)").alias("discount"),
            F.col("l_tax").cast("decimal(4,2)").alias("tax_rate"), code.alias("charge_code"), F.col("l_shipdate").alias("shipped_at"),
        )

    @cached_property
    def bill(self) -> DataFrame:
        """Transactions without what their lines say: no line is read for it."""
        kind = F.element_at(F.array(*map(F.lit, ("ppv_charge", "subscription_charge", "addon_charge", "termination_fee", "refund"))), F.substring("o_orderpriority", 1, 1).cast("int"))
        status = F.when(F.col("o_orderstatus") == "F", "settled").when(F.col("o_orderstatus") == "O", "open").otherwise("pending")
        return self.table("orders").select(
            F.col("o_orderkey").alias("transaction_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("ts"),
            money("o_totalprice").alias("total"), kind.alias("txn_type"), status.alias("status"),
        )

    @cached_property
    def txn(self) -> DataFrame:
        """Transactions with merchant and state of their first line and the number of lines."""
        return self.txn_with()

    def txn_with(self, *more: Column) -> DataFrame:
        """``txn`` with further aggregates of a transaction's lines, from one pass over the lines."""
        first = self.items.groupBy("transaction_id").agg(F.min(F.struct("line_no", "product_ref", "merchant_id", "line_total", "shipped_at")).alias("f"), F.count("*").alias("n_items"), *more)
        state = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("merchant_id"), F.col("n_name").alias("txn_state"))
        t = self.bill.join(first, "transaction_id", "left").withColumn("merchant_id", F.col("f.merchant_id")).drop("f")
        return t.join(state, "merchant_id", "left").withColumn("n_items", F.coalesce("n_items", F.lit(0)))

    @cached_property
    def customer(self) -> DataFrame:
        c, n, r = self.table("customer"), self.table("nation"), self.table("region")
        t = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        key = F.col("c_custkey")
        return t.select(
            key.alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
            F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), "commercial").otherwise("residential").alias("customer_type"),
            F.col("n_name").alias("home_state"), F.col("r_name").alias("entity"),
            F.when(key % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("PROMO_"), key % 3))).alias("promotions"),
            (key % 7).cast("int").alias("lifetime_quarantine_count"), F.abs(money("c_acctbal")).alias("package_value"), (key % 10).alias("parent_no"),
        )

    @cached_property
    def event(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("decimal(6,0)")
        return self.table("events").select(
            "event_id", F.col("user_id").alias("customer_id"), F.col("event_type").alias("merchant_id"), "ts", money("value").alias("amount"),
            (money("value") * k * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(18,5)").alias("discount"),
        )

    @cached_property
    def case(self) -> DataFrame:
        o = self.table("orders")
        sev = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low", "low"))), F.substring("o_orderpriority", 1, 1).cast("int"))
        shipped = self.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("last_ship"))
        key = F.col("o_orderkey")
        t = o.join(shipped, "o_orderkey", "left")
        rules = F.filter(
            F.array(
                F.when(F.col("o_totalprice") > 250000, "amount_outlier"), F.when(key % 2 == 0, "velocity_anomaly"),
                F.when(key % 3 == 0, "discount_mismatch"), F.when(key % 5 == 0, "geographic_anomaly"), F.when(key % 7 == 1, "duplicate_transaction"),
            ),
            lambda x: x.isNotNull(),
        )
        closed = F.col("o_orderstatus") == "F"
        return t.select(
            key.alias("case_id"), F.col("o_custkey").alias("customer_id"), sev.alias("severity"), money("o_totalprice").alias("amount"),
            F.when(closed, "resolved").when(F.col("o_orderstatus") == "O", "open").otherwise("under_review").alias("status"),
            F.when(closed & (key % 3 == 0), "true_positive").when(closed, "false_positive").alias("disposition"),
            F.col("o_orderdate").alias("created_at"), F.when(closed, F.col("last_ship")).alias("resolved_at"), rules.alias("rules"),
        )


#: The same views as SQL, in order of need.
SQL_VIEWS = {
    "items": """SELECT l_orderkey AS transaction_id, l_linenumber AS line_no, l_partkey AS product_ref, l_suppkey AS merchant_id,
      CAST(l_quantity AS DECIMAL(18,2)) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS line_total,
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4)) AS discount,
      CAST(l_tax AS DECIMAL(4,2)) AS tax_rate,
      CASE l_returnflag WHEN 'A' THEN 'CC_PPV_DIRECT' WHEN 'R' THEN 'CC_BUNDLE_PPV' ELSE 'CC_SUBSCRIPTION_BASE' END AS charge_code,
      l_shipdate AS shipped_at FROM lineitem""",
    "first_item": """SELECT transaction_id, merchant_id, n_items FROM (SELECT transaction_id, merchant_id,
      count(*) OVER (PARTITION BY transaction_id) AS n_items,
      row_number() OVER (PARTITION BY transaction_id ORDER BY line_no, product_ref, merchant_id, line_total, shipped_at) AS rn FROM items) WHERE rn = 1""",
    "txn": """SELECT f.merchant_id, o_orderkey AS transaction_id, o_custkey AS customer_id, o_orderdate AS ts, CAST(o_totalprice AS DECIMAL(18,2)) AS total,
      CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'ppv_charge' WHEN '2' THEN 'subscription_charge' WHEN '3' THEN 'addon_charge' WHEN '4' THEN 'termination_fee' ELSE 'refund' END AS txn_type,
      CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'open' ELSE 'pending' END AS status,
      coalesce(f.n_items, 0) AS n_items, n_name AS txn_state
      FROM orders LEFT JOIN first_item f ON f.transaction_id = o_orderkey LEFT JOIN supplier ON s_suppkey = f.merchant_id LEFT JOIN nation ON n_nationkey = s_nationkey""",
    "cust": """SELECT c_custkey AS customer_id, c_name AS name, c_mktsegment AS segment,
      CASE WHEN c_mktsegment IN ('MACHINERY','BUILDING') THEN 'commercial' ELSE 'residential' END AS customer_type,
      n_name AS home_state, r_name AS entity,
      CASE WHEN c_custkey % 5 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['PROMO_' || (c_custkey % 3)] END AS promotions,
      CAST(c_custkey % 7 AS INTEGER) AS lifetime_quarantine_count, abs(CAST(c_acctbal AS DECIMAL(18,2))) AS package_value, c_custkey % 10 AS parent_no
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "ev": """SELECT event_id, user_id AS customer_id, event_type AS merchant_id, ts, CAST(value AS DECIMAL(18,2)) AS amount,
      CAST(CAST(value AS DECIMAL(18,2)) * CAST(json_extract_string(props, '$.k') AS DECIMAL(6,0)) * CAST(0.001 AS DECIMAL(4,3)) AS DECIMAL(18,5)) AS discount FROM events""",
    "cases": """SELECT o_orderkey AS case_id, o_custkey AS customer_id,
      CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity,
      CAST(o_totalprice AS DECIMAL(18,2)) AS amount,
      CASE o_orderstatus WHEN 'F' THEN 'resolved' WHEN 'O' THEN 'open' ELSE 'under_review' END AS status,
      CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'true_positive' WHEN o_orderstatus = 'F' THEN 'false_positive' END AS disposition,
      o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN last_ship END AS resolved_at,
      list_filter([CASE WHEN o_totalprice > 250000 THEN 'amount_outlier' END, CASE WHEN o_orderkey % 2 = 0 THEN 'velocity_anomaly' END,
        CASE WHEN o_orderkey % 3 = 0 THEN 'discount_mismatch' END, CASE WHEN o_orderkey % 5 = 0 THEN 'geographic_anomaly' END,
        CASE WHEN o_orderkey % 7 = 1 THEN 'duplicate_transaction' END], lambda x: x IS NOT NULL) AS rules
      FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
}


def with_views(sql: str) -> str:
    """The statement with every view in front; DuckDB drops those it does not use."""
    import re

    used = {k for k in SQL_VIEWS if re.search(rf"\b{k}\b", sql)}
    if "txn" in used:
        used |= {"items", "first_item"}
    if "first_item" in used:
        used.add("items")
    ctes = ", ".join(f"{k} AS ({q})" for k, q in SQL_VIEWS.items() if k in used)
    body = sql.strip()
    if not ctes:
        return body
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
