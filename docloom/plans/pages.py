"""Queries of rendered templates and of dates as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import date_rows
from docloom.operators import type_classifier
from docloom.operators.templates import Lookup, Part, Template, Value, rendered
from docloom.plans.registry import query
from docloom.session import table

_ORDER_PAGE = Template(
    (
        Part("Status", "orders", "values", (("Priority", Value("o_orderpriority", prefix="Priority: ")), ("Day", Value("o_orderdate", "date"))), ("o_orderkey",), single=True),
        Part("Parts", "lines", "list", (("Name", Value("p_name")), ("Brand", Value("p_brand"))), ("l_linenumber", "l_partkey"), (Lookup("parts", "l_partkey", "p_partkey"),)),
        Part("Lines", "lines", "table", (("Line", Value("l_linenumber")), ("Part", Value("l_partkey"))), ("l_linenumber", "l_partkey")),
        Part("By flag", "lines", "group", (("Line", Value("l_linenumber")), ("Supplier", Value("l_suppkey"))), ("l_linenumber", "l_partkey"), by="l_returnflag"),
    )
)
_ROW = "'<tr><td>' || l_linenumber || '</td><td>' || {} || '</td></tr>'"
_HEAD = "<table><thead><tr><th>Line</th><th>{}</th></tr></thead><tbody>"


@query(f"""WITH g AS (SELECT l_orderkey, l_returnflag, string_agg({_ROW.format("l_suppkey")}, '' ORDER BY l_linenumber, l_partkey, {_ROW.format("l_suppkey")}) AS b FROM lineitem GROUP BY 1, 2), h AS (SELECT l_orderkey, string_agg('<h3>' || l_returnflag || '</h3>{_HEAD.format("Supplier")}' || b || '</tbody></table>', '' ORDER BY l_returnflag) AS b FROM g GROUP BY 1),
    l AS (SELECT l_orderkey, string_agg('<li>' || coalesce(p_name, 'N/A') || ' - ' || coalesce(p_brand, 'N/A') || '</li>', '' ORDER BY l_linenumber, l_partkey, '<li>' || coalesce(p_name, 'N/A') || ' - ' || coalesce(p_brand, 'N/A') || '</li>') AS p, string_agg({_ROW.format("l_partkey")}, '' ORDER BY l_linenumber, l_partkey, {_ROW.format("l_partkey")}) AS t FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT o_orderkey, '<html><body><h2>Status</h2><p>Priority: ' || o_orderpriority || '</p><p>' || strftime(o_orderdate, '%m/%d/%Y') || '</p><h2>Parts</h2>' || coalesce('<ul>' || p || '</ul>', '<p>N/A</p>') || '<h2>Lines</h2>' || coalesce('{_HEAD.format("Part")}' || t || '</tbody></table>', '<p>N/A</p>') || '<h2>By flag</h2>' || coalesce(h.b, '<p>N/A</p>') || '</body></html>' AS html
    FROM orders LEFT JOIN l ON l.l_orderkey = o_orderkey LEFT JOIN h ON h.l_orderkey = o_orderkey""")
def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every order, with a list by a lookup, a table and groups (G-26)."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    sources = {"orders": orders, "lines": lines, "parts": table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")}
    return rendered(orders, "o_orderkey", _ORDER_PAGE, sources)


@query("""WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders WHERE o_orderdate IS NOT NULL)
    SELECT o_orderkey, label, CAST(d AS VARCHAR) AS day FROM o CROSS JOIN (VALUES ('published_date'), ('effective_date'), ('identified')) AS l(label)""")
def date_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled dates of each order's note, by a table function in SQL (X-36)."""
    date_rows.register(spark)
    notes = table(spark, sf_dir, "orders").where("o_orderdate IS NOT NULL").select("o_orderkey", F.concat(F.lit("posted "), F.date_format("o_orderdate", "MM/dd/yyyy")).alias("note"))
    return spark.sql("SELECT o_orderkey, label, CAST(day AS STRING) AS day FROM {notes}, LATERAL labelled_dates(note, '2024-06-01')", notes=notes)


@query()
def doc_type_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's type by its label or else by a classifier that learns from the labelled ones; languages stand for types (X-34)."""
    docs = table(spark, sf_dir, "documents")
    return type_classifier.types_told(docs, "doc_id", "lang", "text", type_classifier.fit(docs, "lang", "text"))
