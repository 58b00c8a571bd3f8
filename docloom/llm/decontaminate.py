"""Operator 1, benchmark decontamination: spaced-seed hashing in DataFrame functions only.

A mask is a short row of token positions of which some count and the others are ignored. Every position of every text
gives one hash for each mask; equal hashes of a training text and a benchmark item are hits. Around each hit the item is
laid over the text, and the window of ``WINDOW`` tokens around it with the most equal tokens decides. The masks hit every window of
13 tokens in which at most two tokens were substituted (``tests/llm`` counts them all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import without, written

MASKS = ("11010111", "11110000101", "111011001")
#: Tokens of a window, and how many of them may differ. An item shorter than the window must stand there whole.
WINDOW, SUBSTITUTIONS = 13, 2
#: Benchmarks of up to so many tokens are sent to every task; larger ones are shuffled. A token has three seeds, each with
#: the hashes of the 25 tokens around it: under 1 kB a token, 50 MB in all.
BROADCAST_TOKENS = 50_000
#: Bits for each opening and seed of a larger benchmark in the bitmaps that are sent in their place (8 bytes a token in all), and
#: up to how many tokens; beyond that every position is shuffled. A bitmap lets one key in so many pass that is not there.
BITS, BITMAP_TOKENS = 16, 50_000_000
#: Bits of one row of a bitmap (fixed by Spark's bitmap functions).
ROW_BITS = 32_768
#: Positions of a document that one row holds, beside the tokens around them.
STRIP = 16


def tokens(text: Column) -> Column:
    """The runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda t: F.xxhash64(t))


def _seeds(hashes: Column, at: Column) -> Column:
    """One hash for each mask that starts at ``at`` (from 0)."""
    kept = [[i for i, c in enumerate(mask) if c == "1"] for mask in MASKS]
    return F.array(*[F.xxhash64(F.lit(n), *[F.get(hashes, at + i) for i in own]) for n, own in enumerate(kept)])


def _seed_places(hashes: Column) -> Column:
    """The positions at which the shortest mask still fits."""
    shortest = min(map(len, MASKS))
    return F.when(F.size(hashes) >= shortest, F.sequence(F.lit(0), F.size(hashes) - shortest))


def _opening(hashes: Column, at: Column) -> Column:
    """One hash of the tokens that all masks begin with."""
    shared = next(i for i in range(min(map(len, MASKS))) if any(mask[i] != "1" for mask in MASKS))
    return F.xxhash64(*[F.get(hashes, at + i) for i in range(shared)])


def _bit(key: str, bits: int) -> tuple[Column, Column]:
    """The row of the bitmap that a key's bit is in, and the bit's place there."""
    place = F.pmod(F.col(key), F.lit(bits))
    return F.floor(place / ROW_BITS).alias("_row"), (place % ROW_BITS)


def _bitmap(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """_row, _bits: a bit for each key, in rows of 4 kB."""
    row, bit = _bit(key, bits)
    return keys.groupBy(row).agg(F.bitmap_construct_agg(bit).alias("_bits"))


def _possible(rows: DataFrame, key: str, bitmap: DataFrame, bits: int) -> DataFrame:
    """The rows whose key's bit is set; all whose key is there are among them."""
    row, bit = _bit(key, bits)
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    own = rows.withColumn("_row", row).join(F.broadcast(bitmap), "_row")
    return own.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("_row", "_bits")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """One row per leaked pair: doc_id, item_id, window_matched, window_tokens, n_tokens (of the item), doc_start.

    ``docs`` has doc_id and text, ``benchmark`` item_id and text; nothing else is read. Null and empty texts, and items
    shorter than the shortest mask, leak nowhere. Rows of one doc_id or one item_id count as one document or item, a null
    id as an id. Of several places the one with the most equal tokens in a window counts, then the first; doc_start is the
    token of the document over which the item's first token lies, below 0 if the item starts before it. Empty tables give
    an empty table.

    Documents are cut into strips of ``STRIP`` positions with the tokens around them, so that a row's size does not grow
    with its text. Only positions whose first tokens open a benchmark seed go on to be hashed under all masks; of a benchmark that is
    too large to be sent, bitmaps of its openings and seeds are, and only positions that pass both are shuffled.
    """
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("_item")).where(F.size("_item") >= min(map(len, MASKS)))
    n_tokens = items.agg(F.sum(F.size("_item"))).first()[0] or 0
    send = F.broadcast if n_tokens <= BROADCAST_TOKENS else (lambda df: df)
    margin = window - 1
    places = items.select("item_id", "_item", F.explode(_seed_places(F.col("_item"))).alias("_pos"))
    low = F.greatest(F.col("_pos") - margin, F.lit(0))
    around = F.slice("_item", low + 1, F.col("_pos") + margin + 1 - low)  # no windows but those around the seed are looked at
    seeds = places.select("item_id", "_pos", F.size("_item").alias("_size"), (F.col("_pos") - low).alias("_lead"), around.alias("_around"), F.explode(_seeds(F.col("_item"), F.col("_pos"))).alias("_seed"))
    openings = places.select(_opening(F.col("_item"), F.col("_pos")).alias("_opening")).distinct()

    length = STRIP + 2 * margin
    strips = F.when(
        F.size("_doc") > 0,
        F.transform(
            F.sequence(F.lit(0), F.size("_doc") - 1, F.lit(STRIP)),
            lambda at: F.struct(at.alias("at"), F.slice("_doc", F.greatest(at - margin, F.lit(0)) + 1, length + F.least(at - margin, F.lit(0))).alias("near")),
        ),
    )
    # explode_outer: no filter is inferred from it, which would tokenise every text twice
    probes = docs.select("doc_id", _hashes(F.col("text")).alias("_doc"))
    probes = probes.select("doc_id", F.explode_outer(strips).alias("_strip"))
    first, near = F.col("_strip.at"), F.col("_strip.near")
    probes = probes.select("doc_id", first.alias("_first"), near.alias("_near"), F.explode_outer(F.array(*map(F.lit, range(STRIP)))).alias("_k"))
    inner = F.col("_k") + F.least(F.col("_first"), F.lit(margin))
    probes = probes.select("doc_id", (F.col("_first") + F.col("_k")).alias("_at"), "_near", inner.alias("_inner"), _opening(F.col("_near"), inner).alias("_opening"))
    if BROADCAST_TOKENS < n_tokens <= BITMAP_TOKENS:  # few positions pass both bitmaps, and only those are shuffled
        bits = -(-BITS * n_tokens // ROW_BITS) * ROW_BITS
        probes = _possible(probes, "_opening", _bitmap(openings, "_opening", bits), bits)
        probes = probes.withColumn("_seed", F.explode(_seeds(F.col("_near"), F.col("_inner"))))
        probes = _possible(probes, "_seed", _bitmap(seeds.select("_seed"), "_seed", 3 * bits), 3 * bits)
    else:
        probes = probes.join(send(openings), "_opening", "left_semi")
        probes = probes.withColumn("_seed", F.explode(_seeds(F.col("_near"), F.col("_inner"))))
    hits = probes.join(send(seeds), "_seed")

    # the item's tokens around the seed, laid over the strip's; the best window of them decides
    place = F.col("_inner") - F.col("_lead")
    equal = F.transform("_around", lambda x, j: F.coalesce(F.get("_near", F.when(place + j >= 0, place + j)) == x, F.lit(False)).cast("int"))
    width = F.least(F.lit(window), F.col("_size"))
    hits = hits.select("doc_id", "item_id", (F.col("_at") - F.col("_pos")).alias("_shift"), equal.alias("_equal"), width.alias("_width"), "_size")
    sums = F.transform(F.sequence(F.lit(1), F.size("_equal") - F.col("_width") + 1), lambda i: F.aggregate(F.slice("_equal", i, F.col("_width")), F.lit(0), lambda n, x: n + x))
    hits = hits.select("doc_id", "item_id", "_shift", F.array_max(sums).alias("_matched"), "_width", "_size")
    leaks = hits.where(F.col("_matched") >= F.col("_width") - F.when(F.col("_width") < window, 0).otherwise(substitutions))
    best = leaks.groupBy("doc_id", "item_id").agg(F.max(F.struct("_matched", (-F.col("_shift")).alias("_before"), "_width", "_size")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b._matched").alias("window_matched"), F.col("b._width").alias("window_tokens"), F.col("b._size").alias("n_tokens"), (-F.col("b._before")).alias("doc_start"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark passage; all columns and other rows stay.

    Rows of one doc_id are one document; those of a null one are told apart by their texts.
    """
    text = lambda df: F.when(df["doc_id"].isNull(), F.md5(df["text"]))
    own = docs.select(F.struct(docs["doc_id"].alias("id"), text(docs).alias("text")).alias("doc_id"), docs["text"])
    leaked = written(find_leaks(own, benchmark, window, substitutions).select("doc_id.id", "doc_id.text").distinct(), "leaked")
    return without(docs, leaked, docs["doc_id"].eqNullSafe(leaked["id"]) & text(docs).eqNullSafe(leaked["text"]))


def oracle_sql(window: int = WINDOW, substitutions: int = SUBSTITUTIONS) -> str:
    """DuckDB SQL for ``find_leaks``: all equal tokens of documents and items by shift, without seeds."""
    shortest = min(map(len, MASKS))
    tokens_ = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
    return f"""
    WITH d AS (SELECT doc_id, unnest(t) AS t, unnest(range(0, len(t))) AS i FROM (SELECT doc_id, {tokens_} AS t FROM documents)),
    b AS (SELECT item_id, len(t) AS n, unnest(t) AS t, unnest(range(0, len(t))) AS j FROM (SELECT item_id, {tokens_} AS t FROM benchmark) WHERE len(t) >= {shortest}),
    m AS (SELECT doc_id, item_id, n, least(n, {window}) AS width, i - j AS shift, j FROM d JOIN b USING (t)),
    w AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY j RANGE BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS matched FROM m),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) AS r FROM w WHERE matched >= width - CASE WHEN width < {window} THEN 0 ELSE {substitutions} END)
    SELECT doc_id, item_id, CAST(matched AS INTEGER) AS window_matched, CAST(width AS INTEGER) AS window_tokens, CAST(n AS INTEGER) AS n_tokens, CAST(shift AS INTEGER) AS doc_start FROM r WHERE r = 1
    """
