"""Ordered folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import folds
from tidemill.plans.calendar import instants
from tidemill.plans.registry import query
from tidemill.session import table

RANKED = "e AS (SELECT o_custkey, o_orderdate AS at_, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN 3 WHEN '3-MEDIUM' THEN 2 WHEN '4-NOT SPECIFIED' THEN 1 ELSE 0 END AS rank FROM orders)"
FOLD = f"""
WITH RECURSIVE {RANKED}, n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY at_, o_orderkey) AS i FROM e),
f AS (SELECT o_custkey, i, o_orderkey, rank AS s, CASE WHEN rank = 4 THEN -1 ELSE rank END AS p, true AS changed FROM n WHERE i = 1
  UNION ALL SELECT n.o_custkey, n.i, n.o_orderkey, CASE WHEN n.rank = 4 THEN CASE WHEN f.s IN (3, 4) THEN f.s ELSE 4 END WHEN f.s = 4 THEN CASE WHEN n.rank > f.p THEN n.rank ELSE f.s END WHEN n.rank > f.s THEN n.rank ELSE f.s END,
    CASE WHEN n.rank = 4 THEN f.p WHEN f.s = 4 THEN greatest(n.rank, f.p) WHEN n.rank > f.s THEN greatest(f.p, n.rank) ELSE f.p END,
    f.s <> CASE WHEN n.rank = 4 THEN CASE WHEN f.s IN (3, 4) THEN f.s ELSE 4 END WHEN f.s = 4 THEN CASE WHEN n.rank > f.p THEN n.rank ELSE f.s END WHEN n.rank > f.s THEN n.rank ELSE f.s END
  FROM f JOIN n ON n.o_custkey = f.o_custkey AND n.i = f.i + 1)
"""


def ranked(spark, sf_dir):
    p = F.col("o_orderpriority")
    rank = F.when(p == "1-URGENT", 4).when(p == "2-HIGH", 3).when(p == "3-MEDIUM", 2).when(p == "4-NOT SPECIFIED", 1).otherwise(0)
    return table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderkey", rank.alias("rank"))


@query(FOLD + "SELECT o_custkey, arg_max(s, i)::INT AS status, max(i)::INT AS n FROM f GROUP BY o_custkey")
def status_fold(spark, sf_dir):
    return folds.status_of(ranked(spark, sf_dir), "o_custkey", ["at", "o_orderkey"], "rank").select("o_custkey", "status", "n")


@query(FOLD + "SELECT o_custkey, o_orderkey, s::INT AS status, changed FROM f")
def status_changes(spark, sf_dir):
    return folds.status_changes(ranked(spark, sf_dir), "o_custkey", ["at", "o_orderkey"], "rank").select("o_custkey", "o_orderkey", "status", "changed")


@query(f"WITH {RANKED} SELECT o_custkey, arg_min(o_orderkey, (at_, o_orderkey)) AS first_order, arg_max(o_orderkey, (at_, o_orderkey)) AS last_order, min(rank)::INT AS best_tier, max(at_) < TIMESTAMP '1998-06-01' AS quiet FROM e GROUP BY 1")
def evidence_record(spark, sf_dir):
    at = F.struct("at", "o_orderkey")
    return ranked(spark, sf_dir).groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("first_order"), F.max_by("o_orderkey", at).alias("last_order"), F.min("rank").alias("best_tier"), (F.max("at") < "1998-06-01").alias("quiet"))


@query("""
WITH RECURSIVE n AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, event_id, i, ts AS anchor FROM n WHERE i = 1 UNION ALL SELECT n.user_id, n.event_id, n.i, CASE WHEN epoch_us(n.ts) - epoch_us(w.anchor) <= 43200000000 THEN w.anchor ELSE n.ts END FROM w JOIN n ON n.user_id = w.user_id AND n.i = w.i + 1)
SELECT user_id, event_id, epoch_us(anchor)::BIGINT AS anchor FROM w
""")
def anchored_windows(spark, sf_dir):
    out = folds.anchored_windows(instants(spark, sf_dir), "user_id", ["event_id"], "ts", 12 * 3600)
    return out.select("user_id", "event_id", F.unix_micros("anchor").alias("anchor"))
