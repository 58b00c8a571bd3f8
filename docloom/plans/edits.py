"""Queries over whole edit scripts, their sections and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import textdiff
from docloom.plans.registry import query
from docloom.session import table

_TOKENS = "list_filter(list_transform(regexp_extract_all({}, '[^ \\t\\n\\v\\f\\r]*[ \\t\\n\\v\\f\\r]|[^ \\t\\n\\v\\f\\r]+$'), lambda t: regexp_replace(lower(t), '[ \\t\\n\\v\\f\\r]', ' ', 'g')), lambda t: trim(t) <> '')"
#: Whole scripts in SQL. ``l`` has a row of the table of common lengths for each word of the newer text, from the last; ``s`` walks it
#: from the first: ``stop`` is the next word of the older text that is kept or may not go.
_SCRIPT = f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT x.conv_id, x.turn, {_TOKENS.format("x.text")} AS a, {_TOKENS.format("y.text")} AS b FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1),
    l AS (SELECT conv_id, turn, CAST(len(b) + 1 AS BIGINT) AS j, list_transform(range(len(a) + 1), lambda i: CAST(0 AS BIGINT)) AS row FROM d
        UNION ALL SELECT conv_id, turn, j - 1, list_reverse(list_reduce(list_concat([[CAST(0 AS BIGINT)]], list_transform(list_reverse(range(1, len(a) + 1)), lambda i: [CASE WHEN a[i] = b[j - 1] THEN row[i + 1] + 1 ELSE row[i] END])), lambda p, x: list_append(p, greatest(p[-1], x[1]))))
        FROM l JOIN d USING (conv_id, turn) WHERE j > 1),
    r AS MATERIALIZED (SELECT * FROM l),
    s AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS j, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS stop, false AS kept FROM d
        UNION ALL SELECT conv_id, turn, j, stop + CASE WHEN kept THEN 1 ELSE 0 END, stop, kept FROM (SELECT *, stop <= len(a) AND a[stop] = b[j] IS TRUE AS kept FROM (
            SELECT s.conv_id, s.turn, s.j + 1 AS j, d.a, d.b, list_filter(range(s.i, len(d.a) + 2), lambda k: k > len(d.a) OR d.a[k] = d.b[s.j + 1] OR r.row[k] > r.row[k + 1])[1] AS stop
            FROM s JOIN d USING (conv_id, turn) JOIN r ON r.conv_id = s.conv_id AND r.turn = s.turn AND r.j = s.j + 1 WHERE s.j < len(d.b)))),
    w AS (SELECT *, lag(i, 1, 1) OVER (PARTITION BY conv_id, turn ORDER BY j) AS low FROM s),
    t AS (SELECT conv_id, turn, j, 1 AS part, -1 AS kind, unnest(a[low:stop - 1]) AS token, unnest(range(len(a[low:stop - 1]))) AS n FROM w JOIN d USING (conv_id, turn) WHERE j > 0
        UNION ALL SELECT conv_id, turn, j, 2, CASE WHEN kept THEN 0 ELSE 1 END, b[j], 0 FROM w JOIN d USING (conv_id, turn) WHERE j > 0
        UNION ALL SELECT conv_id, turn, len(b) + 1, 1, -1, unnest(a[last:]), unnest(range(len(a[last:]))) FROM (SELECT conv_id, turn, arg_max(i, j) AS last FROM s GROUP BY 1, 2) JOIN d USING (conv_id, turn)),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY j, part, n) AS pos FROM t),
    g AS (SELECT *, sum(CASE WHEN (kind = 0) IS DISTINCT FROM (before = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS region FROM (SELECT *, lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before FROM o)),
    script AS (SELECT conv_id, turn, region, kind, string_agg(token, '' ORDER BY pos) AS text FROM g GROUP BY 1, 2, 3, 4)
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next one of its conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return turns.join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("newer")), ["conv_id", "turn"])


@query(f"""{_SCRIPT} SELECT d.conv_id, d.turn, coalesce(string_agg(kind || ':' || text, '|' ORDER BY region, kind), '') AS script FROM d LEFT JOIN script USING (conv_id, turn) GROUP BY 1, 2""")
def turn_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole least edit script over words from each turn to the next (G-04)."""
    told = F.array_join(F.transform("s", lambda x: F.concat(x["kind"].cast("string"), F.lit(":"), x["text"])), "|")
    return _turns(spark, sf_dir).select("conv_id", "turn", textdiff.word_script("text", "newer").alias("s")).select("conv_id", "turn", told.alias("script"))


@query(f"""{_SCRIPT}, k AS (SELECT *, len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS words FROM script),
    p AS (SELECT *, sum(CASE WHEN kind < 1 THEN length(text) ELSE 0 END) OVER v AS end_a, sum(CASE WHEN kind > -1 THEN length(text) ELSE 0 END) OVER v AS end_b, sum(CASE WHEN kind < 1 THEN words ELSE 0 END) OVER v AS word_a, sum(CASE WHEN kind > -1 THEN words ELSE 0 END) OVER v AS word_b FROM k WINDOW v AS (PARTITION BY conv_id, turn ORDER BY region, kind))
    SELECT conv_id, turn, kind, text, CAST(CASE kind WHEN 1 THEN end_b ELSE end_a END AS INTEGER) AS char_end, CAST(CASE kind WHEN 1 THEN word_b ELSE word_a END - words AS INTEGER) AS word_start, CAST(CASE kind WHEN 1 THEN word_b ELSE word_a END AS INTEGER) AS word_end, count(*) OVER (PARTITION BY conv_id, turn, kind, text) > 1 AS repeated FROM p WHERE kind <> 0""")
def turn_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of the sections in which a turn differs from the next, by characters and words (G-05)."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.explode(textdiff.changed_sections("text", "newer")).alias("s"))
    rows = rows.select("conv_id", "turn", "s.kind", "s.text", "s.repeated", F.explode(F.arrays_zip("s.char_spans", "s.word_spans")).alias("p"))
    return rows.select("conv_id", "turn", "kind", "text", F.col("p.char_spans.end").alias("char_end"), F.col("p.word_spans.start").alias("word_start"), F.col("p.word_spans.end").alias("word_end"), "repeated")
