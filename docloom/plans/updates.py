"""Queries of updates: each gives the table as it is after them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import updates as up
from docloom.plans.registry import query
from docloom.plans.tables import nested_orders
from docloom.session import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '0-NONE' ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey,
    CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice, strftime(CASE WHEN o_orderstatus = 'P' THEN greatest(o_orderdate, TIMESTAMP '1997-01-01') ELSE o_orderdate END, '%Y-%m-%d') AS day FROM orders""")
def upd_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields set, unset, increased and raised to a least value (M-01)."""
    changes = {"o_orderpriority": up.set_to(F.lit("0-NONE")), "o_custkey": up.unset(), "o_totalprice": up.increased(F.lit(10)), "o_orderdate": up.greatest(F.lit("1997-01-01").cast("timestamp_ntz"))}
    out = up.update(_orders(spark, sf_dir), F.col("o_orderstatus") == "P", changes)
    return out.select("o_orderkey", "o_orderpriority", "o_custkey", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


_FLAGS = "SELECT o_orderkey, o_orderstatus, coalesce(list(l_returnflag) FILTER (l_returnflag IS NOT NULL), []) AS flags FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"


@query(f"""SELECT o_orderkey, array_to_string(list_sort(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN list_contains(f, 'N') THEN f ELSE list_append(f, 'N') END ELSE flags END), '') AS flags
    FROM (SELECT *, list_append(list_filter(flags, lambda x: x <> 'R'), 'X') AS f FROM ({_FLAGS}))""")
def upd_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements pulled, pushed, and added unless they are there (M-01)."""
    docs = nested_orders(spark, sf_dir).select("o_orderkey", "o_orderstatus", F.transform("lines", lambda x: x["l_returnflag"]).alias("flags"))
    final = F.col("o_orderstatus") == "F"
    for change in (up.pulled(lambda x: x == "R"), up.pushed(F.lit("X")), up.added(F.lit("N"))):
        docs = up.update(docs, final, {"flags": change})
    return docs.select("o_orderkey", F.array_join(F.sort_array("flags"), "").alias("flags"))


@query("""SELECT l_orderkey AS o_orderkey, round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END), 2) AS none, round(sum(CASE WHEN l_returnflag = 'R' AND r = 1 THEN l_quantity + 100 ELSE l_quantity END), 2) AS first
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def upd_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of all matching elements changed, and of the first one (M-02)."""
    docs = nested_orders(spark, sf_dir).where(F.size("lines") > 0).withColumn("more", F.col("lines"))
    docs = up.update_elements(docs, "lines", lambda x: x["l_returnflag"] == "R", {"l_quantity": up.set_to(F.lit(0.0))})
    docs = up.update_elements(docs, "more", lambda x: x["l_returnflag"] == "R", {"l_quantity": up.increased(F.lit(100))}, first_only=True)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x["l_quantity"]), 2)
    return docs.select("o_orderkey", total("lines").alias("none"), total("more").alias("first"))


@query("SELECT o_orderkey, o_totalprice AS amount, o_orderpriority AS priority, o_orderstatus FROM orders")
def upd_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields moved into a struct, and out of it under new names (M-03)."""
    docs = up.moved_into(_orders(spark, sf_dir).select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"), ["o_totalprice", "o_orderpriority"], "detail")
    return up.moved_out(docs, "detail", {"o_totalprice": "amount", "o_orderpriority": "priority"}).select("o_orderkey", "amount", "priority", "o_orderstatus")


@query("""SELECT doc_id, coalesce(quality, toxic, n_chars % 2) AS quality, least(n_chars, 500) AS shortest FROM documents LEFT JOIN labels USING (doc_id)""")
def upd_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing values taken from other fields, and values held under a limit (M-04)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    docs = up.backfilled(docs, "quality", F.col("toxic"), F.col("n_chars") % 2)
    return up.update(docs, F.lit(True), {"n_chars": up.least(F.lit(500))}).select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("n_chars").alias("shortest"))


_VERSIONS = "SELECT o_orderkey, o_custkey AS lineage, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w IS NULL AS is_current, o_orderstatus FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docloom.operators.views import versions

    return versions(_orders(spark, sf_dir), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", F.col("o_custkey").alias("lineage"), "previous", "is_current", "o_orderstatus")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderkey ELSE lineage END AS lineage, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE previous END AS previous, o_orderstatus = 'P' OR is_current AS is_current FROM ({_VERSIONS})""")
def upd_lineage_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows taken out of their lineages (M-11)."""
    return up.reset_lineages(_versions(spark, sf_dir), F.col("o_orderstatus") == "P", "o_orderkey").drop("o_orderstatus")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN lineage ELSE o_orderkey % 100 END AS kept, o_orderkey % 100 AS forced FROM ({_VERSIONS})""")
def upd_lineage_approved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new lineage for all but approved rows, and for those too (M-16)."""
    rows, approved = _versions(spark, sf_dir), F.col("o_orderstatus") == "F"
    new = F.col("o_orderkey") % 100
    return rows.select("o_orderkey", up.relabelled(rows, new, approved).alias("kept"), up.relabelled(rows, new, approved, overwrite=True).alias("forced"))


@query("""SELECT o_orderkey, array_to_string(list_sort(CASE WHEN o_orderstatus = 'F' THEN list_concat(old, list_filter(new, lambda x: NOT list_contains(old, x))) ELSE new END), '|') AS tags
    FROM (SELECT o_orderkey, o_orderstatus, coalesce(list(DISTINCT l_partkey::VARCHAR) FILTER (l_quantity <= 25), []) AS old, coalesce(list(DISTINCT l_partkey::VARCHAR) FILTER (l_quantity > 25), []) AS new FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)""")
def upd_tag_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New tags added to approved ones, or put in their place (M-12)."""
    docs = nested_orders(spark, sf_dir)
    tags = lambda test: F.array_distinct(F.transform(F.filter("lines", test), lambda x: x["l_partkey"].cast("string")))
    merged = up.merged_tags(tags(lambda x: x["l_quantity"] <= 25), tags(lambda x: x["l_quantity"] > 25), F.col("o_orderstatus") == "F")
    return docs.select("o_orderkey", F.array_join(F.sort_array(merged), "|").alias("tags"))


@query("SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN o_custkey END AS o_custkey FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON c_custkey = o_custkey")
def upd_disable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to disabled parents set to null (M-14)."""
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0")
    return up.without_references(_orders(spark, sf_dir).select("o_orderkey", "o_custkey"), "o_custkey", gone, "c_custkey")


@query("""SELECT CASE WHEN o.o_orderkey IS NULL THEN 'missing' WHEN o_orderstatus = 'O' THEN 'refused' ELSE 'ok' END AS result, count(*) AS n FROM lineitem l LEFT JOIN orders o ON o.o_orderkey = l.l_orderkey * 2 WHERE l_linenumber = 1 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(*) = 1) GROUP BY 1""")
def upd_bulk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of many changes went through, were refused or found no row (M-15)."""
    first = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.min("l_returnflag").alias("o_orderpriority")).where("n = 1")
    changes = first.select((F.col("l_orderkey") * 2).alias("o_orderkey"), "o_orderpriority")
    _, results = up.bulk_update(_orders(spark, sf_dir), changes, "o_orderkey", "o_orderpriority", F.col("o_orderstatus") != "O")
    return results.groupBy("result").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN c.k IS NOT NULL AND o_orderstatus <> 'O' THEN 'new' ELSE o_orderpriority END AS o_orderpriority FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') c ON c.k = o_orderkey""")
def upd_bulk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after many changes, of which some rows allow none (M-07, M-15)."""
    changes = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("o_orderpriority", F.lit("new"))
    done, _ = up.bulk_update(_orders(spark, sf_dir), changes, "o_orderkey", "o_orderpriority", F.col("o_orderstatus") != "O")
    return done.select("o_orderkey", "o_orderpriority")


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def upd_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of children of each parent, counted anew (A-11)."""
    return up.child_counts(table(spark, sf_dir, "customer").select("c_custkey"), _orders(spark, sf_dir), "c_custkey", "o_custkey", "n_orders")


@query("""SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 WHEN o_totalprice < 5000 THEN NULL ELSE o_custkey END AS k FROM orders) ON k = c_custkey GROUP BY 1""")
def upd_counts_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those numbers kept up to date when children change their parents (A-11)."""
    orders = _orders(spark, sf_dir)
    before = up.child_counts(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", "n_orders")
    new = F.when(F.col("o_orderstatus") == "P", F.col("o_custkey") + 1).when(F.col("o_totalprice") < 5000, F.lit(None)).otherwise(F.col("o_custkey"))
    return up.counts_after(before, "c_custkey", "n_orders", orders.select(F.col("o_custkey").alias("old"), new.alias("new")), "old", "new")
