"""Queries of the valid-time schema, loads and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalar as fn
from docloom.operators import stats, temporal
from docloom.plans.registry import query
from docloom.session import table


def plan_benefits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as benefit facts: benefit by return flag, controller by supplier, lives by quantity, channel by order priority."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    benefit = F.when(F.col("l_returnflag") == "R", "pharmacy").otherwise("medical")
    return lines.select(F.col("l_suppkey").alias("controller_id"), F.substring("o_orderpriority", 1, 1).alias("channel"), benefit.alias("benefit"), F.col("l_quantity").cast("long").alias("lives"), F.col("l_linestatus").alias("kind"), "l_shipdate")


_FACTS = """SELECT l_suppkey AS controller_id, substr(o_orderpriority, 1, 1) AS channel, CASE WHEN l_returnflag = 'R' THEN 'pharmacy' ELSE 'medical' END AS benefit,
    CAST(l_quantity AS BIGINT) AS lives, l_linestatus AS kind, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


@query(f"""WITH f AS ({_FACTS}) SELECT controller_id, channel, s_name AS name,
    CAST(coalesce(sum(lives) FILTER (kind = 'O' AND benefit = 'medical'), 0) AS BIGINT) AS medical_lives, CAST(coalesce(sum(lives) FILTER (kind = 'O' AND benefit = 'pharmacy'), 0) AS BIGINT) AS pharmacy_lives,
    CAST(coalesce(sum(lives) FILTER (benefit = 'medical'), 0) AS BIGINT) AS medical_total, CAST(coalesce(sum(lives) FILTER (benefit = 'pharmacy'), 0) AS BIGINT) AS pharmacy_total
    FROM f LEFT JOIN supplier ON s_suppkey = controller_id WHERE controller_id <> -1 GROUP BY 1, 2, 3 HAVING count(*) FILTER (kind = 'O') > 0""")
def lives_by_controller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of lives by controller and channel, of the chosen facts and of all (A-05)."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("controller_id"), F.col("s_name").alias("name"))
    out = temporal.lives_by_controller(plan_benefits(spark, sf_dir), F.col("kind") == "O", names)
    return out.select("controller_id", "channel", "name", "medical_lives", "pharmacy_lives", "medical_total", "pharmacy_total")


@query("SELECT count(*) AS n FROM (SELECT l_shipdate AS s, l_shipdate + INTERVAL 90 DAY AS e FROM lineitem) WHERE s <= TIMESTAMP '1996-06-01' AND TIMESTAMP '1996-06-01' < e")
def asof_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that are valid on a day (J-07)."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("start_date"), (F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")).alias("end_date"))
    return temporal.as_of(lines, F.lit("1996-06-01").cast("timestamp_ntz")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, l_orderkey, l_linenumber FROM orders JOIN lineitem ON l_suppkey = o_custkey AND l_shipdate <= o_orderdate AND o_orderdate < l_shipdate + INTERVAL 90 DAY""")
def asof_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the intervals of their key that hold their date (J-07)."""
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), "o_orderdate")
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("key"), F.col("l_shipdate").alias("start_date"), (F.col("l_shipdate") + F.expr("INTERVAL 90 DAYS")).alias("end_date"))
    return temporal.as_of_join(points, spans, "key", "o_orderdate", "start_date", "end_date").select("o_orderkey", "l_orderkey", "l_linenumber")


@query("SELECT c_custkey AS id, coalesce(s_name, c_name) AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey AND s_acctbal > 0")
def controller_priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name from the first of two dimensions that has the id (J-06)."""
    customer = table(spark, sf_dir, "customer")
    first = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    second = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return temporal.priority_lookup(customer.select(F.col("c_custkey").alias("id")), "id", first, second, "name")


@query("""WITH j AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p_size > 10 THEN p_size END AS m, CASE WHEN p_size % 2 = 0 THEN p_size END AS p FROM lineitem JOIN part ON p_partkey = l_partkey)
    SELECT l_orderkey, l_linenumber, 'medical' AS benefit, CAST(m AS INTEGER) AS ump_id, l_suppkey AS controller_id FROM j WHERE m IS NOT NULL
    UNION ALL SELECT l_orderkey, l_linenumber, 'pharmacy', CAST(p AS INTEGER), l_suppkey FROM j WHERE p IS NOT NULL""")
def plan_benefit_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans joined to formularies, a row for each benefit that has both ids (J-08)."""
    plans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("formulary_id"), F.col("l_suppkey").alias("c1"), F.col("l_suppkey").alias("c2"))
    forms = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("formulary_id"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("m"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("p"))
    rows = temporal.expand_benefits(plans, forms, {"medical": "m,c1", "pharmacy": "p,c2"})
    return rows.select("l_orderkey", "l_linenumber", "benefit", "ump_id", "controller_id")


@query("SELECT DISTINCT l_linenumber - 1 AS level FROM lineitem WHERE l_linenumber <> 1")
def payer_ids_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct ids of a level, without null and 0 (A-04)."""
    return temporal.ids_of_level(table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") - 1).alias("level")), "level")


@query("""WITH old AS (SELECT o_orderkey AS id, o_orderstatus AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 5 <> 0),
    new AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 7 <> 0),
    j AS (SELECT old.id AS i, new.id AS k, old.a AS oa, old.b AS ob, new.a AS na, new.b AS nb, old.a IS NOT DISTINCT FROM new.a AND old.b IS NOT DISTINCT FROM new.b AS same FROM old FULL JOIN new ON old.id = new.id)
    SELECT i AS id, oa AS a, ob AS b, '1970-01-01' AS start_date, CASE WHEN same AND k IS NOT NULL THEN '2038-01-01' ELSE '2020-05-01' END AS end_date FROM j WHERE i IS NOT NULL
    UNION ALL SELECT k, na, nb, '2020-05-01', '2038-01-01' FROM j WHERE k IS NOT NULL AND NOT (i IS NOT NULL AND same)""")
def scd2_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery loaded over a dimension: unchanged, changed, vanished and new rows (M-08, J-09)."""
    orders = table(spark, sf_dir, "orders")
    span = [F.lit("1970-01-01").cast("timestamp_ntz").alias("start_date"), F.lit(temporal.OPEN_END).cast("timestamp_ntz").alias("end_date")]
    old = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"), *span)
    new = orders.where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("a"), F.col("o_orderpriority").alias("b"))
    out = temporal.scd2_load(old, new, "id", ["a", "b"], F.lit("2020-05-01").cast("timestamp_ntz"))
    return out.select("id", "a", "b", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("start_date", "end_date")])


_RUNS = "SELECT user_id, ts, event_id % 50 AS found, event_id % 7 AS new FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND event_type <> 'error'"
_DAILY = f"""SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(sum(new) AS BIGINT) AS created, CAST(sum(found - new) AS BIGINT) AS updated, CAST(sum(found) AS BIGINT) AS total
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, found DESC, new DESC) AS r FROM ({_RUNS})) WHERE r = 1 GROUP BY 1"""


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", "ts", (F.col("event_id") % 50).alias("found"), (F.col("event_id") % 7).alias("new"))
    return stats.daily_stats(runs, F.lit("2024-01-05").cast("timestamp_ntz"), "user_id", "ts", "found", "new")


@query(_DAILY)
def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents found by day of each site's newest run (A-01)."""
    return _daily(spark, sf_dir)


@query(f"""SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(created, 0) AS created, coalesce(updated, 0) AS updated, coalesce(total, 0) AS total
    FROM (SELECT unnest(range(DATE '2024-01-05', DATE '2024-01-31', INTERVAL 1 DAY)) AS d) LEFT JOIN ({_DAILY}) s ON s.day = strftime(d, '%Y-%m-%d')""")
def daily_stats_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a row for every day (A-02)."""
    return stats.fill_days(_daily(spark, sf_dir), "2024-01-05", "2024-01-30")


@query("""SELECT md5(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', '', 'g')) AS checksum, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of white-space-free texts that several documents share (A-06, X-01)."""
    return stats.duplicates(table(spark, sf_dir, "documents"), fn.text_digest(F.col("text")))


@query("SELECT l_suppkey, string_agg(CAST(n AS VARCHAR), '|' ORDER BY n) AS lines FROM (SELECT DISTINCT l_suppkey, l_linenumber AS n FROM lineitem) GROUP BY 1")
def sites_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's set of ids (A-07)."""
    out = stats.ids_by_key(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_linenumber")
    return out.select("l_suppkey", F.array_join(F.col("ids").cast("array<string>"), "|").alias("lines"))


_QUEUES = {
    "urgent": ("o_orderpriority = '1-URGENT'", lambda: F.col("o_orderpriority") == "1-URGENT"),
    "open": ("o_orderstatus = 'O'", lambda: F.col("o_orderstatus") == "O"),
    "late": ("o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1996-01-01'", lambda: (F.col("o_orderstatus") == "P") & (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"))),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS queue, count(*) AS n FROM orders WHERE {v[0]}" for k, v in _QUEUES.items()))
def saved_queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each saved queue holds, in one pass (F-37, A-10)."""
    return stats.counts_in_one_pass(table(spark, sf_dir, "orders"), {k: v[1]() for k, v in _QUEUES.items()})


_CHANGES = """SELECT o_orderkey, path, op, value, prev FROM (SELECT o_orderkey, '/status' AS path, CASE WHEN o_orderstatus IS NULL THEN 'add' WHEN b IS NULL THEN 'remove' ELSE 'replace' END AS op, b AS value, o_orderstatus AS prev
    FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderstatus END AS b FROM orders)) WHERE value IS DISTINCT FROM prev"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    new = F.when(F.col("o_orderkey") % 4 == 0, "Z").when(F.col("o_orderkey") % 9 == 0, None).otherwise(F.col("o_orderstatus"))
    return stats.changed_fields(orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority"), orders.select("o_orderkey", new.alias("status"), "o_orderpriority"), "o_orderkey", ["status", "o_orderpriority"])


@query(_CHANGES)
def json_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that differ between two versions (X-46, M-13)."""
    return _changes(spark, sf_dir).select("o_orderkey", "path", "op", "value", "prev")


@query(f"SELECT path, count(*) AS n, count(DISTINCT o_orderkey) AS targets FROM ({_CHANGES}) WHERE regexp_matches(path, '^/status') GROUP BY 1")
def changelog_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the changes whose path fits (A-08)."""
    return _changes(spark, sf_dir).where(F.col("path").rlike("^/status")).groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("targets"))


@query("""SELECT o_orderkey, strftime(date_trunc('day', coalesce(greatest(s, CASE WHEN o_orderstatus = 'O' THEN o_orderdate END), o_orderdate)), '%Y-%m-%d') AS day
    FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) FILTER (l_returnflag = 'R') AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def final_effective_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest of a document's dates, or its first collection (A-16, X-22)."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("s"))
    rows = table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left")
    none = F.lit(None).cast("timestamp_ntz")
    day = fn.final_effective_date(F.col("s"), none, F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate")), F.col("o_orderdate"))
    return rows.select("o_orderkey", F.date_format(day, "yyyy-MM-dd").alias("day"))


@query("""WITH parts AS (SELECT doc_id, length(unnest(string_split(text, chr(10)))) AS size FROM documents)
    SELECT doc_id, parts, mean, median, mode FROM (SELECT doc_id, count(*) AS parts, round(avg(size), 4) AS mean, median(size) AS median FROM parts GROUP BY 1)
    JOIN (SELECT doc_id, CAST(size AS INTEGER) AS mode FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, size) AS r FROM parts GROUP BY 1, 2) WHERE r = 1) USING (doc_id)""")
def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and most common length of a document's lines (A-19)."""
    out = stats.part_stats(table(spark, sf_dir, "documents"), "doc_id", F.split("text", "\n"))
    return out.select("doc_id", "parts", F.round("mean", 4).alias("mean"), "median", "mode")


@query("SELECT substr(lower(p_type), 1, 2) AS prefix, count(*) AS n, min(lower(p_type)) AS first FROM part WHERE length(p_type) >= 2 GROUP BY 1")
def prefix_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by their first letters (A-20, A-22)."""
    return stats.prefix_groups(table(spark, sf_dir, "part"), F.col("p_type"), 2)


_SCORED = "SELECT quality AS label, (n_chars % 1000) / 1000.0 AS score FROM labels JOIN documents USING (doc_id)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 1000) / 1000.0).alias("score"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("label"), "score")


@query(f"""WITH s AS (SELECT label, CAST(score AS DOUBLE) AS score FROM ({_SCORED})), g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY 1),
    c AS (SELECT p, q, coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM g)
    SELECT CAST(sum(p) AS BIGINT) AS positives, CAST(sum(q) AS BIGINT) AS negatives, round(sum(p * (b + q / 2)) / (sum(p) * sum(q)), 6) AS auc FROM c""")
def eval_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area under the curve, by ranks (A-23)."""
    return stats.auc(_scored(spark, sf_dir), "label", "score").withColumn("auc", F.round("auc", 6))


@query(f"""WITH s AS (SELECT label, CAST(floor(CAST(score AS DOUBLE) * 100) AS INTEGER) AS step FROM ({_SCORED})), t AS (SELECT unnest(range(0, 101)) AS cut),
    f AS (SELECT cut, 2.0 * sum(label) / (count(*) + (SELECT sum(label) FROM s)) AS f1 FROM t JOIN s ON step >= cut GROUP BY 1)
    SELECT round(cut / 100.0, 4) AS cut, round(f1, 6) AS f1 FROM f ORDER BY f1 DESC, cut LIMIT 1""")
def eval_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold of the best F1 (A-23)."""
    return stats.best_f1(_scored(spark, sf_dir), "label", "score").select(F.round("cut", 4).alias("cut"), F.round("f1", 6).alias("f1"))
