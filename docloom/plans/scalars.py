"""Queries of column functions: digests, headers, selectors, numbers, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalar as fn
from docloom.functions.doc_types import RULES, TypeRule, type_of, type_sql
from docloom.plans.registry import query
from docloom.session import table, tasks_for


@query("""SELECT page_id, md5(html) AS bytes, md5(trim(url) || html) AS both, CASE WHEN page_id % 2 = 0 THEN md5(regexp_replace(html, '[ \\t\\n\\r\\f\\v]+', '', 'g')) ELSE md5(html) END AS own FROM pages""")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of bytes, of text with bytes, and by kind of document (X-02, X-03, X-04)."""
    html, kind = F.col("html"), F.when(F.col("page_id") % 2 == 0, "html").otherwise("pdf")
    return table(spark, sf_dir, "pages").select("page_id", F.md5("html").alias("bytes"), fn.content_digest(F.col("url"), html.cast("binary")).alias("both"), fn.document_digest(kind, html, html.cast("binary")).alias("own"))


@query("SELECT o_orderkey, array_to_string(list_filter([nullif(o_orderstatus, 'F'), '', o_orderpriority], lambda x: x IS NOT NULL AND x <> ''), '|') AS kept, strftime(date_trunc('day', o_orderdate + INTERVAL 7 HOUR), '%Y-%m-%d %H:%M') AS day FROM orders")
def compacted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists without empty values, and times at midnight (X-08, X-21)."""
    values = F.array(F.nullif(F.col("o_orderstatus"), F.lit("F")), F.lit(""), F.col("o_orderpriority"))
    day = fn.naive_date(F.col("o_orderdate") + F.expr("INTERVAL 7 HOURS"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(fn.compacted(values), "|").alias("kept"), F.date_format(day, "yyyy-MM-dd HH:mm").alias("day"))


@query("""SELECT n_nationkey, 'a[href$=".pdf"], a[href$=".x' || n_nationkey || '"], a[href*="' || n_name || '"]' AS href, 'input[type="hidden"][value$=".pdf"]' AS hidden,
    CASE WHEN n_nationkey % 4 = 0 THEN '//a' WHEN n_nationkey % 4 = 1 THEN '//a[@id]' WHEN n_nationkey % 4 = 2 THEN '//a[contains(@id, ''' || n_name || ''')]' ELSE '//*[@id=''' || n_name || ''']' END AS path FROM nation""")
def selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors and paths from extensions, keywords and attributes (X-23, X-24)."""
    key, name = F.col("n_nationkey"), F.col("n_name")
    href = fn.href_selector(F.array(F.lit("pdf"), F.concat(F.lit("x"), key.cast("string"))), F.array(name))
    path = fn.xpath(F.when(key % 4 != 3, "a"), F.when(key % 4 != 0, "id"), F.when(key % 4 > 1, name), key % 4 == 2)
    return table(spark, sf_dir, "nation").select("n_nationkey", href.alias("href"), fn.hidden_selector(F.array(F.lit("pdf"))).alias("hidden"), path.alias("path"))


_HEADER = """CASE page_id % 3 WHEN 0 THEN 'attachment; filename="list ' || page_id || '.xlsx"' WHEN 1 THEN 'inline; filename=a.tar' ELSE 'inline' END"""


@query(f"""SELECT page_id, nullif(regexp_extract({_HEADER}, 'filename=["'']?([^"'';]+)', 1), '') AS name,
    coalesce(CASE WHEN regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '\\.([^./]+)$', 1) = 'html' THEN 'html' END, CASE WHEN page_id % 3 = 0 THEN 'xlsx' END, CASE WHEN page_id % 2 = 0 THEN 'pdf' END) AS ext FROM pages""")
def guessed_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's extension by url, header or content type (X-25, X-26)."""
    header, kind = F.expr(_HEADER), F.when(F.col("page_id") % 2 == 0, "application/pdf; charset=utf-8").otherwise("image/png")
    return table(spark, sf_dir, "pages").select("page_id", fn.disposition_name(header).alias("name"), fn.guessed_extension(F.col("url"), header, kind).alias("ext"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%m/%d/%Y') END AS day, coalesce(o_orderkey % 5 <> 0 AND o_orderdate > TIMESTAMP '1997-06-01', false) AS later FROM orders""")
def exported_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text in another form, and whether they are to come (X-27, X-28)."""
    text = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    return table(spark, sf_dir, "orders").select("o_orderkey", fn.us_date(text).alias("day"), fn.is_after(text, F.lit("1997-06-01").cast("timestamp")).alias("later"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10000 WHEN c_custkey % 3 = 1 THEN c_custkey END AS id, CASE WHEN c_custkey % 3 < 2 THEN c_name || ' | ' || c_custkey END AS label FROM customer""")
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids out of text and their labels (X-50, X-51)."""
    key, medical = F.col("c_custkey"), F.col("c_custkey") % 3 == 0
    own = fn.group_id(F.when(key % 3 == 2, F.concat(key.cast("string"), F.lit("x"))).otherwise(F.concat(F.lit(" "), key.cast("string"))), medical)
    return table(spark, sf_dir, "customer").select("c_custkey", own.alias("id"), fn.display_label(F.col("c_name"), own, medical).alias("label"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS made FROM orders""")
def object_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time at which an object id was made (X-52)."""
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    made = F.concat(F.lower(F.lpad(F.hex(seconds), 8, "0")), F.lit("0123456789abcdef"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(fn.object_time(F.when(F.col("o_orderkey") % 7 != 0, made).otherwise("none")), "yyyy-MM-dd HH:mm:ss").alias("made"))


@query("""SELECT p_partkey, p_brand = 'Brand#11' AND p_size % 2 = 0 AS same, md5('{"brand":"' || p_brand || '","size":' || p_size || '}') AS digest FROM part WHERE p_brand IS NOT NULL AND p_size IS NOT NULL""")
def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that agree but for their name and score, and a digest of a record's JSON (X-42, X-48)."""
    part = table(spark, sf_dir, "part").where("p_brand IS NOT NULL AND p_size IS NOT NULL")
    a = F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), (F.col("p_size") % 2).alias("odd"))
    b = F.struct(F.lit("other").alias("name"), F.lit("Brand#11").alias("brand"), F.lit(0).alias("odd"))
    config = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return part.select("p_partkey", fn.same_record(a, b, ["name", "brand", "odd"]).alias("same"), fn.config_digest(config).alias("digest"))


_GROUPS = {"small": ("the", "and the"), "german": ("und", "in der"), "french": ("de la", "le")}
_TEXT_WORDS = "' ' || array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' '"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join("CASE WHEN " + " OR ".join(f"contains(w, ' {p} ')" for p in phrases) + f" THEN '{name}' END" for name, phrases in _GROUPS.items()) + f"], lambda x: x IS NOT NULL), '|') AS groups FROM (SELECT doc_id, {_TEXT_WORDS} AS w FROM documents)")
def keyword_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of words and phrases that texts hold (X-41)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(fn.keyword_groups(F.col("text"), _GROUPS), "|").alias("groups"))


@query("""SELECT p_partkey, p_name || ' 0.5 MG tablet' AS one, p_name || ' extended release 10|' || p_name || ' extended release 20mg' AS many FROM part WHERE NOT regexp_matches(p_name, '[0-9]')""")
def drug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drug names in one spelling, and the names that one stands for (X-45)."""
    name = F.col("p_name")
    one, many = F.concat(name, F.lit("  .5 MG\tTabs")), F.concat(name, F.lit(" ER 10/20mg"))
    # a small file is read by one task, and there is much work for each row
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition(4 * tasks_for(spark, 0), "p_partkey")
    return part.where(~F.col("p_name").rlike("[0-9]")).select("p_partkey", fn.drug_name(one).alias("one"), F.array_join(fn.drug_names(many), "|").alias("many"))


_GUESS = (TypeRule("Covered Treatment List", (("covered treatment",),)), *RULES)


@query(f"""SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'Medical Coverage Status' ELSE replace(coalesce({type_sql("replace(url, '/fr/', '-covered-treatment-')", _GUESS)}, 'Not Applicable'), 'Covered Treatment List', 'Medical Coverage List') END AS type FROM pages""")
def guessed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's type: that of searchable pages, the first rule's, or none; an old name under its new one (X-34)."""
    kind = F.coalesce(type_of(F.replace("url", F.lit("/fr/"), F.lit("-covered-treatment-")), _GUESS), F.lit("Not Applicable"))
    kind = F.when(kind == "Covered Treatment List", "Medical Coverage List").otherwise(kind)
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 10 == 0, "Medical Coverage Status").otherwise(kind).alias("type"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS spaces, trim(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS scrubbed FROM documents")
def scrubbed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with single spaces, and with nothing but letters and digits (X-11)."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.normalized_spaces(F.col("text")).alias("spaces"), fn.scrubbed(F.col("text")).alias("scrubbed"))


@query("""WITH c AS (SELECT CAST(p_partkey % 600 AS VARCHAR) AS code, min(p_partkey) AS k FROM part GROUP BY 1), g AS (SELECT substr(code, 1, 2) AS prefix, arg_min(code, k) AS code, count(*) AS n FROM c GROUP BY 1)
    SELECT CASE WHEN n > 1 THEN '0' || substr(code, 1, 2) || 'X' WHEN length(code) = 2 THEN '0' || code || 'x' WHEN length(code) = 3 THEN '0' || code ELSE code END AS label, n FROM g""")
def prefix_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes grouped by their first two letters, shown by the first one under a label of the group (A-20)."""
    codes = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 600).cast("string").alias("code")).agg(F.min("p_partkey").alias("k"))
    groups = codes.groupBy(F.substring("code", 1, 2).alias("prefix")).agg(F.min_by("code", "k").alias("code"), F.count("*").alias("n"))
    return groups.select(fn.prefix_label(F.col("code"), F.col("n") > 1).alias("label"), "n")


@query("""SELECT o_orderkey, c_mktsegment || o_orderpriority AS by_all, c_mktsegment || regexp_replace(o_orderpriority, '[0-9]-', '', 'g') AS by_rest, c_mktsegment || split_part(o_orderpriority, '-', 1) AS up_to FROM orders JOIN customer ON c_custkey = o_custkey""")
def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of lineages to learn from: a base with a link's text, without its year, or up to a mark (G-21)."""
    base, text = F.coalesce("c_mktsegment", F.lit("")), F.coalesce("o_orderpriority", F.lit(""))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    keys = {"by_all": text, "by_rest": F.regexp_replace(text, "[0-9]-", ""), "up_to": F.split_part(text, F.lit("-"), F.lit(1))}
    return rows.select("o_orderkey", *[F.concat(base, k).alias(name) for name, k in keys.items()])


@query("""WITH n AS (SELECT l_orderkey % 100 AS doc, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'N') AS u, count(*) AS t FROM lineitem GROUP BY 1)
    SELECT doc, t AS total, round(a / t, 6) AS added, round(r / t, 6) AS removed, round(u / t, 6) AS changed FROM n""")
def tag_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which share of a document's tags was added, removed and changed (A-12, A-13)."""
    share = lambda s: F.round(F.count_if(F.col("l_returnflag") == s) / F.count("*"), 6)
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("doc"))
    return rows.agg(F.count("*").alias("total"), share("A").alias("added"), share("R").alias("removed"), share("N").alias("changed"))
