"""A mirror of open cases, folded from changes in whatever order and batches they arrive.

A change of a case has a number that orders the case's changes, and is an insert, an edit of the status, or the end. A
sequential replay would add the case at its insert and count it for the customer's lifetime, set the status at an edit if the
case is there, and remove it at the end; an edit or end of a case that is not there does nothing. The state that this leaves
needs three facts a case, each a smallest or largest number, so that batches can be folded in any order and one batch twice:
the insert, the last edit, and the last end. A case is open if its insert has no later end; its status is that of the last
edit behind the insert, else the insert's.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitspark.streaming import tables as S

FACT = "struct<seq:bigint,status:string,at:timestamp_ntz>"
STATE = f"case_id long, customer_id long, opened {FACT}, edited {FACT}, ended long"


def facts(changes: DataFrame) -> DataFrame:
    """STATE rows of changes(case_id, customer_id, seq, kind, status, at); kind is insert, edit or end."""
    fact = F.struct(F.col("seq").cast("long").alias("seq"), "status", "at")
    kind = lambda k: F.col("kind") == k
    return folded(changes.select("case_id", "customer_id", F.when(kind("insert"), fact).alias("opened"), F.when(kind("edit"), fact).alias("edited"), F.when(kind("end"), F.col("seq").cast("long")).alias("ended")))


def folded(state: DataFrame) -> DataFrame:
    """One row a case from rows of several changes or batches."""
    return state.groupBy("case_id").agg(F.max("customer_id").alias("customer_id"), F.min("opened").alias("opened"), F.max("edited").alias("edited"), F.max("ended").alias("ended"))


def mirrored(table: S.SnapshotTable) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a batch of changes into the table of STATE, which is cut by case."""

    def each(df: DataFrame, batch: int) -> None:
        new = facts(df)
        table.apply(S.on(new, lambda old: folded(old.unionByName(new))), batch)

    return each


def cases(state: DataFrame) -> DataFrame:
    """case_id, customer_id, opened_at, open, status of every case that was inserted."""
    there = state.where("opened is not null")
    edited = F.col("edited.seq") > F.col("opened.seq")
    is_open = F.coalesce(F.col("ended") < F.col("opened.seq"), F.lit(True))
    return there.select("case_id", "customer_id", F.col("opened.at").alias("opened_at"), is_open.alias("open"), F.when(edited, F.col("edited.status")).otherwise(F.col("opened.status")).alias("status"))


def by_customer(state: DataFrame) -> DataFrame:
    """Of each customer how many cases there were and are, how many are under review, and the first and last open one."""
    live = lambda c: F.when(F.col("open"), c)
    return cases(state).groupBy("customer_id").agg(
        F.count("*").alias("lifetime"), F.count_if("open").alias("open_cases"), F.count_if(F.col("open") & (F.col("status") == "under_review")).alias("under_review"),
        F.min(live(F.col("case_id"))).alias("oldest"), F.max(live(F.struct("opened_at", "case_id")))["case_id"].alias("newest"),
    )
