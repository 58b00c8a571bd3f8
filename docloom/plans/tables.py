"""Queries of the table-query language, over parts, orders and orders with their lines nested in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import table_query as tq
from docloom.operators.predicates import compile_predicate
from docloom.operators.views import first_per_group, latest_per_key, nest, single_element_view, unwind_merge, versions
from docloom.plans.registry import query
from docloom.session import table

LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"]


def nested_orders(spark: SparkSession, sf_dir: str, lines: str = "true", orders: str = "true") -> DataFrame:
    """Orders with the array ``lines`` of their lines. Conditions on both reach the scans; what they let go is not nested."""
    kept = table(spark, sf_dir, "lineitem").select(*LINES).where(lines)
    parents = table(spark, sf_dir, "orders").where(orders)
    if orders != "true":
        kept = kept.join(parents.select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    return nest(parents, kept, "o_orderkey", "l_orderkey", "lines", "l_linenumber")


def _ids(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns)


_SITE_FILTERS = [tq.Filter("o_orderstatus", "eq", value=["F", "O"]), tq.Filter("l_quantity", "gte", "number", 10)]
_SITE_SQL = """SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    WHERE l_suppkey = 3 AND o_orderstatus IN ('F', 'O') AND l_quantity >= 10"""


def _site_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = nested_orders(spark, sf_dir, lines="l_suppkey = 3")  # of the elements no others are merged
    docs = docs.where(tq.path_predicate(docs.schema, "lines.l_suppkey", lambda c: c == 3))
    return tq.where_all(unwind_merge(docs, "lines", lambda x: x["l_suppkey"] == 3), _SITE_FILTERS)


@query(f"{_SITE_SQL} ORDER BY l_quantity DESC, o_orderkey, l_linenumber LIMIT 50")
def site_doc_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines merged over their orders, filtered, sorted and paged (P-05, F-20, O-02)."""
    rows = _site_rows(spark, sf_dir).select("o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey", "l_quantity")
    return rows.orderBy(*tq.sort_keys(rows, [("l_quantity", -1), ("o_orderkey", 1)], "l_linenumber")).limit(tq.PAGE)


@query(f"SELECT count(*) AS total FROM ({_SITE_SQL})")
def site_doc_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of rows of that table (A-03)."""
    return _site_rows(spark, sf_dir).agg(F.count("*").alias("total"))


def _filter_query(name: str, source: str, key: str, filters: list[tq.Filter], condition: str, doc: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tq.where_all(table(spark, sf_dir, source), filters).select(key)

    run.__doc__ = doc
    query(f"SELECT {key} FROM {source} WHERE {condition}", name)(run)


for _row in (
    ("flt_contains", "part", "p_partkey", [tq.Filter("p_type", "contains", value="Nom")], "p_type ILIKE '%nom%'", "F-05"),
    ("flt_not_contains", "part", "p_partkey", [tq.Filter("p_type", "notContains", value="mo")], "NOT coalesce(p_type ILIKE '%mo%', false)", "F-06"),
    ("flt_starts", "part", "p_partkey", [tq.Filter("p_name", "startsWith", value="SMALL r")], "lower(p_name) LIKE 'small r%'", "F-07"),
    ("flt_ends", "customer", "c_custkey", [tq.Filter("c_name", "endsWith", value="7")], "c_name LIKE '%7'", "F-08"),
    ("flt_eq_list", "orders", "o_orderkey", [tq.Filter("o_orderpriority", "eq", value=["1-URGENT", "5-LOW"])], "o_orderpriority IN ('1-URGENT', '5-LOW')", "F-09"),
    ("flt_neq", "orders", "o_orderkey", [tq.Filter("o_orderstatus", "neq", value="O")], "o_orderstatus IS DISTINCT FROM 'O'", "F-11"),
    ("flt_notinlist", "orders", "o_orderkey", [tq.Filter("o_orderstatus", "notinlist", value=["O", "P"])], "NOT coalesce(o_orderstatus IN ('O', 'P'), false)", "F-13"),
    ("flt_cmp", "orders", "o_orderkey", [tq.Filter("o_totalprice", "gt", "number", 1000), tq.Filter("o_totalprice", "lte", "number", 50000)], "o_totalprice > 1000 AND o_totalprice <= 50000", "F-16, F-20"),
    ("flt_dates", "orders", "o_orderkey", [tq.Filter("o_orderdate", "after", "date", "1996-01-01"), tq.Filter("o_orderdate", "beforeOrOn", "date", "1997-06-30")], "o_orderdate > TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1997-06-30'", "F-17"),
    ("flt_inrange", "part", "p_partkey", [tq.Filter("p_size", "inrange", "number", {"start": 5, "end": 20})], "p_size BETWEEN 5 AND 20", "F-18"),
    ("flt_notinrange", "part", "p_partkey", [tq.Filter("p_size", "notinrange", "number", {"start": 5, "end": 20})], "p_size > 20 OR p_size < 5", "F-19"),
    ("flt_text", "documents", "doc_id", [tq.Filter("text", "textcontains", value="thereas und")], "len(list_intersect(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), ['thereas', 'und'])) > 0", "F-03"),
    ("flt_text_not", "documents", "doc_id", [tq.Filter("text", "textnotContains", value='"of the"')], "NOT coalesce(contains(lower(text), 'of the'), false)", "F-04"),
    ("flt_inactive", "orders", "o_orderkey", [tq.Filter("o_orderstatus", "contains", value=None), tq.Filter("o_orderstatus", "neq", value="")], "o_orderstatus IS NOT NULL", "F-02: a filter without a value is dropped"),
):
    _filter_query(*_row)

_NESTED = "SELECT o_orderkey FROM orders o WHERE "


def _nested_query(name: str, predicate: dict, condition: str, doc: str, lines: str = "true") -> None:
    """``lines`` holds for all elements that the predicate can be true for; the others are not nested."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = nested_orders(spark, sf_dir, lines)
        return docs.where(compile_predicate(docs.schema, predicate)).select("o_orderkey")

    run.__doc__ = doc
    query(_NESTED + condition, name)(run)


_LINE = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND {})"
_nested_query("flt_any_element", {"lines.l_suppkey": 3}, _LINE.format("l_suppkey = 3"), "F-26: any element", "l_suppkey = 3")
_nested_query("flt_no_element", {"lines.l_returnflag": {"$ne": "R"}}, "NOT " + _LINE.format("l_returnflag = 'R'"), "F-24: no element", "l_returnflag = 'R'")
_nested_query("flt_same_element", {"lines": {"$elemMatch": {"l_returnflag": "R", "l_quantity": {"$gt": 40}}}}, _LINE.format("l_returnflag = 'R' AND l_quantity > 40"), "F-23: one element for both", "l_returnflag = 'R' AND l_quantity > 40")
_nested_query("flt_array_size", {"lines": {"$not": {"$size": 0}}, "o_orderstatus": {"$in": ["F", "P"]}}, "o_orderstatus IN ('F', 'P') AND " + _LINE.format("true"), "F-25")
_nested_query("flt_or", {"$or": [{"lines.l_quantity": {"$gte": 50}}, {"o_totalprice": {"$lt": 2000}}]}, "(" + _LINE.format("l_quantity >= 50") + " OR o_totalprice < 2000)", "J-17: a union of predicates", "l_quantity >= 50")


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, list_sort(list_distinct(list(l_returnflag))) AS flags FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE flags = ['A', 'R']""")
def flt_leq_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality with a whole array (F-10)."""
    docs = nested_orders(spark, sf_dir)
    docs = docs.withColumn("flags", F.sort_array(F.array_distinct(F.transform("lines", lambda x: x["l_returnflag"]))))
    return tq.where_all(docs, [tq.Filter("flags", "leq", value=["A", "R"])]).select("o_orderkey")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def flt_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label (F-14)."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return tq.where_all(rows, [tq.Filter("quality", "empty", "number")]).select("doc_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def flt_not_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label (F-15)."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return tq.where_all(rows, [tq.Filter("quality", "notEmpty", "number", "x")]).select("doc_id")


@query("""SELECT o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), '|' ORDER BY r) AS numbers
    FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey) WHERE r <= 3 GROUP BY 1""")
def proj_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three elements of an array (P-02)."""
    docs = nested_orders(spark, sf_dir).where(F.size("lines") > 0)
    numbers = F.transform(F.slice("lines", 1, 3), lambda x: x["l_linenumber"].cast("string"))
    return docs.select("o_orderkey", F.array_join(numbers, "|").alias("numbers"))


@query("""SELECT o_orderkey, l_linenumber, l_quantity FROM (SELECT o_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS r
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 5) WHERE r = 1""")
def single_location_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with its first line of one supplier (P-06, P-07)."""
    view = single_element_view(nested_orders(spark, sf_dir, lines="l_suppkey = 5"), "lines", lambda x: x["l_suppkey"] == 5)
    return view.select("o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey, l_linenumber, s_name, n_name, r_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey
    LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus = 'P'""")
def doc_view_denorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the names of their supplier, nation and region (J-01)."""
    docs = nested_orders(spark, sf_dir, orders="o_orderstatus = 'P'")
    rows = unwind_merge(docs, "lines")
    rows = rows.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("o_orderkey", "l_linenumber", "s_name", "n_name", "r_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_task_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of the customers that a task lists (J-02)."""
    tasks = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.collect_set("c_custkey").alias("ids")).where("c_mktsegment = 'BUILDING'")
    return table(spark, sf_dir, "orders").join(tasks.select(F.explode("ids").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def anti_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order (J-20)."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@query("""SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next, lead(o_orderkey) OVER w IS NULL AS is_current
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's previous and next version in its customer's lineage (J-05, W-02, W-03)."""
    return versions(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_orderkey", "previous", "next", "is_current")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def first_per_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest event (W-01, W-07)."""
    return first_per_group(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type = 'error') WHERE r = 1""")
def latest_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's newest error, by an aggregate (J-18)."""
    rows = latest_per_key(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", "ts", ["event_id"])
    return rows.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "event_id")


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey LIMIT 20 OFFSET 40""")
def sorted_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of twenty by a sort specification (O-01, O-02, O-03)."""
    return tq.page(table(spark, sf_dir, "orders"), tq.sort_spec(["-o_orderpriority", "o_totalprice"]), "o_orderkey", 40, 20).select("o_orderkey")
