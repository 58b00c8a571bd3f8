"""Queries of states, queues, schedules and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalar as fn
from docloom.operators import lifecycle
from docloom.plans.registry import query
from docloom.session import table
from docloom.streaming import heartbeats

_NOW = "2024-01-20 12:00:00"


@query("""WITH d AS (SELECT doc_id, quality, n_chars, DATE '2024-01-20' - CAST(n_chars % 4000 AS INTEGER) AS day FROM documents LEFT JOIN labels USING (doc_id)),
    h AS (SELECT doc_id, list_filter([CASE WHEN coalesce(quality < 1, true) THEN 'DOC_TYPE' END, CASE WHEN day < DATE '2019-01-20' THEN 'EFFECTIVE_DATE' END, CASE WHEN n_chars > 3000 THEN 'IDENTIFIED_DATES' END, CASE WHEN n_chars % 3 = 0 THEN 'LINEAGE' END], lambda x: x IS NOT NULL) AS r FROM d)
    SELECT doc_id, CASE WHEN len(r) > 0 THEN 'QUEUED' ELSE 'APPROVED' END AS status, array_to_string(r, '|') AS holds FROM h""")
def approval_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' review state and what holds it (T-12, T-13)."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    day = F.date_sub(F.lit("2024-01-20").cast("date"), (F.col("n_chars") % 4000).cast("int"))
    confidence = F.when(F.col("n_chars") % 3 == 0, 0.5).otherwise(1.0)
    holds = lifecycle.hold_reasons(F.col("quality"), F.lit(1), day, F.when(F.col("n_chars") > 3000, 11).otherwise(1), confidence, F.lit("2024-01-20").cast("date"))
    rows = docs.withColumn("r", holds)
    return rows.select("doc_id", lifecycle.assessed(F.lit("PENDING"), F.col("r")).alias("status"), F.array_join("r", "|").alias("holds"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN c THEN 'content' END, CASE WHEN c OR d THEN 'date' END, CASE WHEN c OR t THEN 'doc_type' END, CASE WHEN c OR t OR g THEN 'tag' END], lambda x: x IS NOT NULL), '|') AS stages
    FROM (SELECT doc_id, n_chars % 5 = 0 AS c, n_chars % 3 = 0 AS d, n_chars % 7 = 0 AS t, n_chars % 2 = 0 AS g FROM documents)""")
def stage_dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages that each document has to go through again (T-14)."""
    own = F.struct(*[F.when(F.col("n_chars") % n == 0, "1").otherwise("2").alias(name) for name, n in (("content", 5), ("date", 3), ("doc_type", 7), ("tag", 2))])
    docs = table(spark, sf_dir, "documents").select("doc_id", own.alias("own"))
    return docs.select("doc_id", F.array_join(lifecycle.stale_stages(F.col("own"), dict.fromkeys(("content", "date", "doc_type", "tag"), "2")), "|").alias("stages"))


_CRON = "CASE c_custkey % 4 WHEN 0 THEN '* * * * *' WHEN 1 THEN '0 12 * * *' WHEN 2 THEN '0 12 20 1 6' ELSE '30 * * * *' END"


@query(f"""SELECT c_custkey FROM (SELECT *, string_split({_CRON}, ' ') AS f, ['0', '12', '20', '1', '6'] AS t FROM customer)
    WHERE list_bool_and(list_transform(range(1, 6), lambda i: f[i] = '*' OR f[i] = t[i])) AND c_acctbal > 0 AND c_custkey % 10 <> 0""")
def cron_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites to collect at a time: due by cron, enabled and not running (X-29, F-32)."""
    now = F.lit(_NOW).cast("timestamp_ntz")
    none = F.lit(None).cast("timestamp_ntz")
    urls = F.array(F.struct(F.when(F.col("c_acctbal") > 0, "ACTIVE").otherwise("INACTIVE").alias("status")))
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site_id"), F.expr(_CRON).alias("cron"), F.lit(False).alias("disabled"), F.lit("AUTOMATED").alias("method"), urls.alias("urls"), none.alias("hold"), none.alias("last_run"))
    running = sites.where("site_id % 10 = 0").select("site_id")
    return lifecycle.eligible_sites(sites, running, now).select(F.col("site_id").alias("c_custkey"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0 ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 1")
def lock_take_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of a queue that nobody holds (T-06, O-04)."""
    now = F.lit(_NOW).cast("timestamp_ntz")
    later, before = F.lit("2024-01-21").cast("timestamp_ntz"), F.lit("2024-01-01").cast("timestamp_ntz")
    lock = F.struct(F.lit("q").alias("queue"), F.lit("u").alias("user"), F.when(F.col("o_orderkey") % 3 == 0, later).otherwise(before).alias("expires"))
    items = table(spark, sf_dir, "orders").withColumn("locks", F.array(lock))
    return lifecycle.take_next(items, "q", now, [F.col("o_orderpriority"), F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'v' ELSE 'u' END AS holder FROM orders""")
def lock_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who holds an item after a user's attempt on it (T-06)."""
    now, later, before = (F.lit(x).cast("timestamp_ntz") for x in (_NOW, "2024-01-21", "2024-01-01"))
    lock = F.struct(F.lit("q").alias("queue"), F.lit("v").alias("user"), F.when(F.col("o_orderkey") % 3 == 0, later).otherwise(before).alias("expires"))
    locks = lifecycle.with_lock(F.array(lock), "q", "u", now, later)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(locks, F.lit(0))["user"].alias("holder"))


@query(f"""SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS seen FROM events WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY 1 HAVING max(ts) < TIMESTAMP '{_NOW}' - INTERVAL 60 MINUTE""")
def hung_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks whose last heartbeat is more than an hour old (F-33, F-34)."""
    now = F.lit(_NOW).cast("timestamp_ntz")
    tasks = table(spark, sf_dir, "events").where(F.col("ts") <= now).groupBy("user_id").agg(F.max("ts").alias("seen")).withColumn("status", F.lit("IN_PROGRESS"))
    return lifecycle.silent_tasks(tasks, now, 60, "seen").select("user_id", F.date_format("seen", "yyyy-MM-dd HH:mm:ss").alias("seen"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'DONE' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 'DONE' FROM orders WHERE o_orderkey % 20 = 0""")
def upsert_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table with changes over them (M-06, M-07)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changes = orders.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("DONE").alias("status"))
    return lifecycle.upsert(orders.where("o_orderkey % 5 <> 0"), changes, "o_orderkey")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heartbeats by hour, as a stream that takes all that is there (T-08, T-09)."""
    from docloom.session import shared_path

    source = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out, checkpoint, place = (shared_path(spark, f"heartbeat-{x}") for x in ("out", "state", "in"))
    # a stream reads folders, so the one file is written into one; a last event closes all windows
    last = source.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(None).cast("string").alias("event_type"), "ts")
    source.select("event_type", "ts").write.parquet(f"{place}/1")
    last.write.parquet(f"{place}/2")
    stream = spark.readStream.schema("event_type string, ts timestamp").option("maxFilesPerTrigger", 1000).parquet(f"{place}/*")
    counts = heartbeats.windowed_counts(stream, "ts", "event_type", late="1 minute")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.schema("start timestamp, event_type string, n long").parquet(out).where("event_type IS NOT NULL")
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS kind, concat_ws('-', 'Order', CAST(o_custkey AS VARCHAR), o_orderstatus) AS grp FROM orders")
def mapped_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes mapped to names, and a task's group id (M-05, X-49, X-53)."""
    names = F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open"))
    return table(spark, sf_dir, "orders").select("o_orderkey", names[F.col("o_orderstatus")].alias("kind"), F.concat_ws("-", F.lit("Order"), F.col("o_custkey").cast("string"), "o_orderstatus").alias("grp"))


@query("SELECT a.o_orderkey, b.o_orderkey AS newer, round(CASE WHEN greatest(a.o_totalprice, b.o_totalprice) > 0 THEN 1 - abs(a.o_totalprice - b.o_totalprice) / greatest(a.o_totalprice, b.o_totalprice) ELSE 1 END, 6) AS ratio FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def size_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the sizes of two neighbours are (X-40)."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    b = a.select(F.col("o_orderkey").alias("newer"), (F.col("o_orderkey") - 1).alias("_k"), F.col("x").alias("y"))
    return a.join(b, F.col("o_orderkey") == F.col("_k")).select("o_orderkey", "newer", F.round(fn.size_ratio(F.col("x"), F.col("y")), 6).alias("ratio"))
