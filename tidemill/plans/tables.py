"""Versioned tables: what each version holds, and what compaction leaves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.plans.registry import query
from tidemill.scratch import new_path
from tidemill.session import table
from tidemill.sources.snapshots import Snapshots, compact

SCHEMA = "part string, id long, day date, status string, cents long"


def order_rows(spark, sf_dir):
    """Orders by month."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("day"), F.col("o_orderstatus").alias("status"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return o.withColumn("part", F.date_format("day", "yyyy-MM"))


@query("""
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS part, o_orderkey AS id, round(o_totalprice * 100)::BIGINT AS cents FROM orders), m AS (SELECT part, min(id) AS least FROM o GROUP BY 1),
v AS (SELECT 1 AS version, part, cents FROM o UNION ALL SELECT 2, part, cents + CASE WHEN id % 2 = 0 AND part < '1996' THEN 1 ELSE 0 END FROM o UNION ALL SELECT 3, part, cents + CASE WHEN id % 2 = 0 AND part < '1996' THEN 1 ELSE 0 END FROM o WHERE part NOT LIKE '%-12')
SELECT version, part, count(*) AS n, sum(cents)::BIGINT AS cents FROM v GROUP BY ALL
""")
def table_versions(spark, sf_dir):
    """Three versions of a table; a write of the same rows in another order between them makes none."""
    t = Snapshots(spark, new_path(spark, "versions"), SCHEMA)
    rows = order_rows(spark, sf_dir)
    changed = rows.withColumn("cents", F.col("cents") + F.when((F.col("id") % 2 == 0) & (F.col("part") < "1996"), 1).otherwise(0))
    made = [t.commit(rows), t.commit(rows.orderBy("cents")), t.commit(changed), t.commit(rows.limit(0), [p for p in t.parts() if p.endswith("-12")])]
    if made != [1, None, 2, 3]:
        raise RuntimeError(f"versions {made}")
    every = [t.read(v).select(F.lit(v).alias("version"), "part", "cents") for v in t.versions()]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("version", "part").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("""
WITH o AS (SELECT o_orderkey AS id, o_orderdate::DATE AS day, o_orderstatus AS status, strftime(o_orderdate, '%Y') AS year FROM orders),
c AS (SELECT DISTINCT year FROM o WHERE id % 700 = 3 AND year < '1995'), last AS (SELECT max(day) AS top FROM o),
d AS (SELECT year, (year || '-12-31')::DATE + 90 < top AS due FROM o, last GROUP BY year, top)
SELECT CASE WHEN due AND year NOT IN (SELECT year FROM c) THEN year ELSE strftime(day, '%Y-%m') END AS part, count(*) + count(*) FILTER (id % 700 = 3 AND year < '1995') AS n FROM o JOIN d USING (year) GROUP BY 1
""")
def table_compaction(spark, sf_dir):
    """Months merged into years that are over for 90 days; years in which an order has two contents are refused."""
    t = Snapshots(spark, new_path(spark, "compaction"), SCHEMA)
    rows = order_rows(spark, sf_dir)
    other = rows.where((F.col("id") % 700 == 3) & (F.col("part") < "1995")).withColumn("status", F.lit("?"))
    t.commit(rows.unionByName(other))
    top = rows.agg(F.max("day")).first()[0]
    compact(t, "id", "day", "yyyy", F.lit(top), 90)
    return t.read().groupBy("part").agg(F.count("*").alias("n"))


#: What query indexed_search asks for.
ASKED = ("The der", "zzzz", "anders con", "Là")


@query(f"""
WITH d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')) AS w FROM documents),
q AS (SELECT asked, unnest(string_split(strip_accents(lower(asked)), ' ')) AS t FROM (VALUES {', '.join(f"('{a}')" for a in ASKED)}) v(asked)), n AS (SELECT asked, count(*) AS n FROM q GROUP BY 1),
h AS (SELECT asked, doc_id, count(*) AS hit FROM q, d WHERE len(list_filter(w, lambda x: starts_with(x, t) OR (starts_with(t, x) AND length(x) >= length(t) * 0.6))) > 0 GROUP BY ALL)
SELECT asked, doc_id AS id FROM h JOIN n USING (asked) WHERE hit = n
""")
def indexed_search(spark, sf_dir):
    """Documents that answer each of some texts, from an index of all of them."""
    from tidemill.sources import search_index

    root = new_path(spark, "index")
    search_index.build(table(spark, sf_dir, "documents"), "doc_id", "text", root, 32)
    found = [search_index.search(spark, root, a).select(F.lit(a).alias("asked"), "id") for a in ASKED]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
