"""Queries that search by indexes: words and phrases by a text index, names by their trigrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import language_profiles
from docloom.operators.sparse_join import nearest_names
from docloom.operators.text_index import write_index
from docloom.plans.registry import query
from docloom.session import checkpointed, shared_path, table

_WORDS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_STEM = "CASE WHEN regexp_matches({0}, '[^e]{{2,}}ies$') THEN regexp_replace({0}, 'ies$', 'y') WHEN regexp_matches({0}, '(ss|x|ch|sh)es$') THEN regexp_replace({0}, 'es$', '') WHEN regexp_matches({0}, '...(ing|ed)$') THEN regexp_replace({0}, '(ing|ed)$', '') WHEN regexp_matches({0}, '..[^su]s$') THEN regexp_replace({0}, 's$', '') ELSE {0} END"
_STEMS = f"list_transform({_WORDS}, lambda w: {_STEM.format('w')})"


def _search(spark: SparkSession, sf_dir: str, asked: str) -> DataFrame:
    index = write_index(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), shared_path(spark, "text-index"))
    return index.search(spark, asked)


@query(f"SELECT DISTINCT doc_id FROM documents WHERE len(list_intersect({_STEMS}, ['thereas', 'the', 'ther'])) > 0 AND NOT list_contains({_STEMS}, 'und')")
def idx_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a stem of one of the query's words, by an index, and without another (F-03, F-04)."""
    return _search(spark, sf_dir, "thereased The thering -und")


@query(f"""WITH w AS (SELECT DISTINCT doc_id, ' ' || array_to_string({_STEMS}, ' ') || ' ' AS t FROM documents) SELECT DISTINCT doc_id FROM w WHERE contains(t, ' of the ') AND doc_id NOT IN (SELECT doc_id FROM w WHERE contains(t, ' the of ') AND doc_id IS NOT NULL) AND doc_id IS NOT NULL""")
def idx_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one phrase and without another, by the places of an index (F-03, F-04)."""
    return _search(spark, sf_dir, '"of the" -"the of"')


_NAMES = "SELECT DISTINCT lower(trim({0})) AS t FROM part WHERE trim({0}) <> ''"
_GRAMS = "list_transform(range(1, length(t) + 1), lambda i: substr(' ' || t || ' ', i, 3))"


@query(f"""WITH i AS ({_NAMES.format("p_name || ' ' || p_brand || ' ' || p_size")}), q AS ({_NAMES.format("p_name || ' ' || p_size")}), g AS (SELECT t, g, count(*) AS tf FROM (SELECT t, unnest({_GRAMS}) AS g FROM i) GROUP BY 1, 2), h AS (SELECT t, g, count(*) AS tf FROM (SELECT t, unnest({_GRAMS}) AS g FROM q) GROUP BY 1, 2),
    d AS (SELECT g, ln((SELECT count(*) + 1 FROM i) / (count(*) + 1.0)) + 1 AS idf FROM g GROUP BY 1), z AS (SELECT ln((SELECT count(*) + 1 FROM i) / 1.0) + 1 AS idf),
    x AS (SELECT t, g, tf * coalesce(d.idf, z.idf) AS w FROM h LEFT JOIN d USING (g) CROSS JOIN z), y AS (SELECT t, g, tf * d.idf AS w FROM g JOIN d USING (g)),
    s AS (SELECT x.t AS query, y.t AS item, sum(x.w * y.w) AS dot FROM x JOIN y USING (g) GROUP BY 1, 2), n AS (SELECT t, sqrt(sum(w * w)) AS n FROM x GROUP BY 1), m AS (SELECT t, sqrt(sum(w * w)) AS m FROM y GROUP BY 1),
    c AS (SELECT query, item, dot / n / m AS score FROM s JOIN n ON n.t = query JOIN m ON m.t = item WHERE dot / n / m >= 0.5)
    SELECT query, item, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, item) AS r FROM c) WHERE r <= 20""")
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty items nearest to each name and size by the cosine of their trigrams (O-07)."""
    part = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    queries, items = (part.select(F.concat_ws(" ", "p_name", *more, size).alias("text")) for more in ((), ("p_brand",)))
    return nearest_names(queries, items).select("query", "item", F.round("score", 6).alias("score"))


_PLAIN = "' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}]+', ' ', 'g')) || ' '"
_LETTERS = "list_filter(list_concat(" + ", ".join(f"list_transform(range(1, length(p) - {n - 2}), lambda i: substr(p, i, {n}))" for n in (1, 2, 3)) + "), lambda g: trim(g) <> '')"


@query(f"""WITH p AS (SELECT doc_id, lang, {_PLAIN} AS p FROM documents), g AS (SELECT doc_id, lang, unnest({_LETTERS}) AS gram FROM p),
    k AS (SELECT lang, gram, rank FROM (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, gram) - 1 AS rank FROM g WHERE lang IS NOT NULL GROUP BY 1, 2) WHERE rank < 200),
    o AS (SELECT doc_id, gram, rank FROM (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, gram) - 1 AS rank FROM g GROUP BY 1, 2) WHERE rank < 200),
    m AS (SELECT doc_id, k.lang, sum(200 - abs(o.rank - k.rank)) AS near FROM o JOIN k USING (gram) GROUP BY 1, 2), n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY 1),
    b AS (SELECT doc_id, lang, near FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, lang) AS r FROM m) WHERE r = 1)
    SELECT DISTINCT d.doc_id, b.lang, round(200 - near / n, 6) AS distance FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN n USING (doc_id)""")
def text_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's language by its distance to the profiles of the labelled texts (X-30)."""
    docs = table(spark, sf_dir, "documents")
    known = checkpointed(language_profiles.profiles(docs, "lang", "text"))
    return language_profiles.detected(docs, "doc_id", "text", known).select("doc_id", "lang", F.round("distance", 6).alias("distance"))
