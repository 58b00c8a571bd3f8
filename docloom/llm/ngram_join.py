"""Operator 9, n-gram Jaccard join: a grouped prefix join.

1. Every text becomes its set of word shingles; equal sets are one class, however many copies there are.
2. One document stands for each class. Blocks of them ask in how many classes each of their shingles occurs (``keycounts``).
   The order of a class's shingles is by that count, rarest first. Two sets of a similarity of t or more share one of their
   first n - ceil(t n) + 1 shingles; those in one class only cannot be shared, so most classes have no prefix left to index.
3. Classes with the same prefix and size are one group. Groups that share a prefix shingle are paired with that shingle's
   leader first, verified and linked, and so with a few more leaders; then only groups of different components are paired with each other. Sizes, the
   shared shingle's positions and, for groups of one class, bitmaps of the sets filter the pairs: the bits in which two
   bitmaps differ are no more than the shingles in which their sets do. Members of the groups left are verified on their
   whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import BROADCAST_IDS, without, written
from docloom.llm.components import components
from docloom.llm.keycounts import ASK_DDL, Layout, no_stats, totals
from docloom.llm.wordhash import let_go, mix, text_slices, word_hashes

#: Bytes of text in one block, and behind one bucket of the shingles' counts.
BLOCK_BYTES = 8 << 20
#: Bits of a shingle's hash that are counted and indexed. Shingles that share them count as often as they do together, in
#: every class alike; so they change the order of shingles, and what is verified, but no link.
PRINT_BITS = 48
#: Text bytes whose shingles a task holds at once.
SLICE_BYTES = 4 << 20
#: Pairs whose sets a task holds at once.
PAIR_ROWS = 256
#: Further leaders of a shingle that groups meet before all of different components are paired.
LEADERS = 8
#: 64-bit words of a set's bitmap.
BITMAP_WORDS = 8


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; the whole sequence where there are fewer words; none without words."""
    words, counts = word_hashes(texts)
    salts = mix(np.arange(1, width + 1, dtype=np.uint64))
    long = mix(words[: max(0, len(words) - width + 1)] ^ salts[0])
    for i in range(1, width):
        long = mix(long * np.uint64(3) + (words[i : len(words) - width + 1 + i] ^ salts[i]))
    at = 0
    for n in counts:
        if n >= width:
            yield np.unique(long[at : at + n - width + 1])
        else:
            short = np.full(int(n > 0), n, np.uint64)
            for w in words[at : at + n]:
                short = mix(short * np.uint64(5) + w)
            yield short
        at += n


def class_key(found: np.ndarray) -> int:
    """A 64-bit key of a set, over all its members and its size."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(found).sum(dtype=np.uint64) * np.uint64(7) + np.uint64(len(found))], np.uint64))[0].astype(np.int64))


def bitmap(found: np.ndarray) -> list[int]:
    """Each member turns one bit over."""
    size = 64 * BITMAP_WORDS
    turned = np.bincount((found % np.uint64(size)).astype(np.int64), minlength=size) & 1
    return np.packbits(turned.astype(np.uint8)).view(np.int64).tolist()


def _classes(width: int):
    def run(batches):
        let_go()
        for batch in text_slices(batches, SLICE_BYTES):
            sets = list(shingle_sets(batch.column("text"), width))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(map(class_key, sets), pa.int64())],
                names=["doc_id", "n_shingles", "cls"],
            )

    return run


def _block(table: pa.Table, width: int) -> dict[int, np.ndarray]:
    """The sets of the classes that a block stands for, by key. Rows with a class name the documents to take them from."""
    cls = table.column("cls")
    named = table.filter(pc.is_valid(cls))
    wanted = set(zip(named.column("doc_id").to_pylist(), named.column("cls").to_pylist(), strict=True))
    docs = table.filter(pc.is_null(cls))
    docs = docs.filter(pc.is_in(docs.column("doc_id"), named.column("doc_id").combine_chunks()))
    own = {}
    for part in text_slices(docs.select(["doc_id", "text"]).combine_chunks().to_batches(), SLICE_BYTES):
        for doc_id, found in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text"), width), strict=True):
            if (doc_id, key := class_key(found)) in wanted:
                own[key] = found
    return dict(sorted(own.items()))


def _prints(sets: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of the sets, and their prints."""
    every = np.concatenate([*sets.values(), np.empty(0, np.uint64)])
    return every, every >> np.uint64(64 - PRINT_BITS)


def _ask(width: int, layout: Layout):
    """The prints of a block, with the number of its classes that hold each."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(_prints(_block(table, width))[1], return_counts=True)
        return layout.asked(keys, counts, table.column("block")[0].as_py())

    return run


_PREFIX = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("n_alone", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def _prefixes(width: int, percent: int, layout: Layout):
    """Each class's indexed shingles in their order, as prints; classes with none are left out."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return _PREFIX.empty_table()
        sets = _block(table, width)
        every, prints = _prints(sets)
        seen = layout.answered(answers)[0][np.unique(prints, return_inverse=True)[1]]
        which = np.repeat(np.arange(len(sets)), [len(x) for x in sets.values()])
        n = np.bincount(which, minlength=len(sets))
        shared = seen > 1
        every, prints, seen, which = every[shared], prints[shared], seen[shared], which[shared]
        order = np.lexsort((every, seen, which))
        n_shared = np.bincount(which, minlength=len(sets))
        alone = n - n_shared
        kept = np.clip(n + (-percent * n // 100) + 1 - alone, 0, n_shared)  # of n - ceil(t n) + 1, those that others have
        starts = np.cumsum(n_shared) - n_shared
        has = kept > 0
        at = np.concatenate([np.arange(s, s + k) for s, k in zip(starts[has], kept[has], strict=True)] or [np.empty(0, np.int64)])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(kept[has])), pa.int32()), pa.array(prints[order[at]].astype(np.int64)))
        return pa.table([pa.array(np.array(list(sets), np.int64)[has]), pa.array(n[has]), pa.array(alone[has]), lists], schema=_PREFIX)

    return run


def _whole_sets(width: int):
    def run(batches):
        for batch in text_slices(batches, SLICE_BYTES):
            sets = {class_key(s): s for s in shingle_sets(batch.column("text"), width)}
            columns = [pa.array(list(sets), pa.int64()), pa.array([s.tobytes() for s in sets.values()], pa.binary()), pa.array([bitmap(s) for s in sets.values()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["cls", "members", "bits"])

    return run


def _similar(percent: int):
    def run(batches):
        for batch in (whole.slice(at, PAIR_ROWS) for whole in batches for at in range(0, len(whole), PAIR_ROWS)):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _needed(n: Column, m: Column, percent: int) -> Column:
    """The common shingles that sets of n and m need: ceil(t / (1 + t) (n + m))."""
    return F.ceil((n + m) * percent / F.lit(100 + percent))


def _fits(percent: int, positions: bool = True) -> Column:
    """Whether sizes, a shared shingle's positions and bitmaps (if there are any) let two groups be similar."""
    n, m = F.col("n"), F.col("m")
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    left = F.least(n - F.col("at"), m - F.col("at_m"))
    differ = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("bits_m", F.lit(i)))) for i in range(BITMAP_WORDS)), F.lit(0))
    alike = F.coalesce(differ <= n + m - 2 * _needed(n, m, percent), F.lit(True))
    return sizes & alike & (left >= _needed(n, m, percent)) if positions else sizes & alike


def join_ngrams(docs: DataFrame, width: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) for every row of ``docs`` (doc_id, text).

    Two rows are linked when 100 |a & b| >= percent |a | b| of their shingle sets. Null, empty and blank texts have no
    shingles and no links. Rows that share a doc_id count as linked. A row with a null doc_id takes no part: its
    component_id is null. Other columns are not read; an empty table gives an empty table. Sets are compared by 64-bit
    hashes of their shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(docs.mapInArrow(_classes(width), "doc_id long, n_shingles long, cls long"), "shingle-classes")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // BLOCK_BYTES))
    layout = Layout(n_blocks, n_blocks, PRINT_BITS)

    # one document stands for each class; texts and the classes to read from them meet in blocks, in one exchange
    first = rows.where("doc_id is not null AND n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.where("doc_id is not null").select("doc_id", "text", F.lit(None).cast("long").alias("cls"))
    both = texts.unionByName(first.select("doc_id", F.lit(None).cast("string").alias("text"), "cls"))
    blocks = both.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(n_blocks)))
    answers = totals(blocks.groupBy("block").applyInArrow(_ask(width, layout), ASK_DDL), layout, no_stats)
    prefixes = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_prefixes(width, percent, layout), "cls long, n long, n_alone long, prefix array<long>")
    prefixes = written(prefixes, "prefixes")

    links = _links(docs, rows, prefixes, width, percent)
    same_id = rows.where("n_shingles > 0").groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a <> b").select("a", "b")
    found = components(links.unionByName(same_id))
    own = rows.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first_id"))
    own = own.join(found, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cls"))
    least = own.groupBy("root").agg(F.min("first_id").alias("component_id"))
    labels = own.select("cls", "root").join(least, "root").select("cls", "component_id")
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(labels, "cls", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), alone).alias("component_id"))


def _links(docs: DataFrame, rows: DataFrame, prefixes: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (a, b) between classes, enough of them that every link's ends are connected."""
    # groups: the same prefix, size and number of shingles before it
    grouped = prefixes.withColumn("grp", F.xxhash64("prefix", "n", "n_alone"))
    groups = grouped.groupBy("grp").agg(F.count("*").alias("k"), F.min("cls").alias("first"), F.first("n").alias("n"), F.first("n_alone").alias("n_alone"), F.first("prefix").alias("prefix"))
    entries = groups.select("grp", "k", "first", "n", "n_alone", F.posexplode("prefix").alias("i", "token"))
    shared = entries.groupBy("token").agg(F.count("*").alias("groups")).where("groups > 1").select("token")
    # a group of several keeps its first token, at which members of different roots meet, even if no other group has it
    inner = entries.where("k > 1 AND i = 0").select("token")
    entries = written(entries.join(shared.unionByName(inner).distinct(), "token"), "prefix-index")
    several = groups.where("k > 1").select("grp")
    members = grouped.join(entries.select("grp").unionByName(several).distinct(), "grp", "left_semi").select("grp", "cls")
    members = written(members, "group-members")
    sets = written(_sets_of(docs, rows, members, width), "shingle-sets")

    # a group of one class has its bitmap; bands of sizes: similar sets are in the same or in neighbouring ones
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    bits = sets.select(F.col("cls").alias("first"), "bits")
    entries = entries.join(bits, "first").select("token", "grp", "first", "n", (F.col("i") + F.col("n_alone")).alias("at"), "n_alone", band.alias("band"), F.when(F.col("k") == 1, F.col("bits")).alias("bits"))
    entries = written(entries, "entries")

    # every group against the leaders of its shingles: those with the fewest shingles that no other class has
    leaders = entries.groupBy("token", "band").agg(F.min(F.struct("n_alone", F.xxhash64("first").alias("h"), "first", "n", "bits")).alias("l"))
    leaders = leaders.select("token", _three_bands().alias("band"), F.col("l.first").alias("b"), F.col("l.n").alias("m"), F.col("l.bits").alias("bits_m"))
    met = entries.join(leaders, ["token", "band"]).where((F.col("first") != F.col("b")) & _fits(percent, positions=False)).select("grp", F.col("first").alias("a"), "b")
    # and the members of a group against its first
    inside = members.join(members.groupBy("grp").agg(F.min("cls").alias("a")), "grp").where("a <> cls").select("a", F.col("cls").alias("b"))
    tried = written(_pair(met.select("a", "b").unionByName(inside)), "leader-pairs")
    links = written(_verified(tried, sets, percent), "leader-links")

    # once more, groups of different components against other leaders of their shingles, picked by several hashes
    _, left = _left_entries(entries, members, links, several, bits)
    left = left.drop("bits").join(bits, "first")
    leaders = left.groupBy("token", "band").agg(F.array(*[F.min(F.struct(F.xxhash64("first", F.lit(i)).alias("h"), "first", "root", "n", "bits")) for i in range(LEADERS)]).alias("l"))
    leaders = leaders.select("token", F.inline("l"), "band").select("token", _three_bands().alias("band"), F.col("first").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("bits").alias("bits_m"))
    met = left.join(leaders, ["token", "band"]).where((F.col("root") != F.col("other")) & _fits(percent, positions=False)).select(F.col("first").alias("a"), "b")
    more = written(_pair(met).join(tried, ["a", "b"], "left_anti"), "more-pairs")
    links = written(links.unionByName(_verified(more, sets, percent)), "more-links")
    tried = tried.unionByName(more)

    # what is left: groups of different components, each against every other
    now, left = _left_entries(entries, members, links, several, bits)
    other = left.select("token", _three_bands().alias("band"), F.col("grp").alias("grp_m"), F.col("root").alias("other"), F.col("n").alias("m"), F.col("at").alias("at_m"), F.col("bits").alias("bits_m"))
    met = left.join(other, ["token", "band"]).where((F.col("root") < F.col("other")) & _fits(percent)).select("grp", "root", "grp_m", "other").distinct()
    one = now.join(bits.withColumnRenamed("first", "cls"), "cls").select("grp", "root", F.col("cls").alias("a"), "bits")
    two = one.select(F.col("grp").alias("grp_m"), F.col("root").alias("other"), F.col("a").alias("b"), F.col("bits").alias("bits_m"))
    sizes = groups.select("grp", "n")
    met = met.join(sizes, "grp").join(sizes.select(F.col("grp").alias("grp_m"), F.col("n").alias("m")), "grp_m")
    fresh = met.join(one, ["grp", "root"]).join(two, ["grp_m", "other"]).where(_fits(percent, positions=False)).select("a", "b")
    fresh = written(_pair(fresh).join(tried, ["a", "b"], "left_anti"), "pairs")
    return links.unionByName(written(_verified(fresh, sets, percent), "pair-links"))


def _left_entries(entries: DataFrame, members: DataFrame, links: DataFrame, several: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every class's root by the links so far, and the entries of shingles that groups of several roots share.

    A group whose members have several roots stands in each, with the least class of that root as ``first``.
    """
    now = members.join(components(links), F.col("cls") == F.col("node"), "left").select("grp", "cls", F.coalesce("component", "cls").alias("root"))
    roots = now.groupBy("grp", "root").agg(F.count("*").alias("k"), F.min("cls").alias("first"))
    left = entries.drop("first").join(roots.drop("k"), "grp")
    # where one class of a large group has a root of its own, its bitmap filters as that of a group of one class does
    single = roots.where("k = 1").join(several, "grp", "left_semi").join(bits.withColumnRenamed("bits", "own_bits"), "first").select("grp", "root", "own_bits")
    left = left.join(single, ["grp", "root"], "left").withColumn("bits", F.coalesce("bits", "own_bits")).drop("own_bits")
    spread = left.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    return now, written(left.join(spread, "token"), "left-entries")


def _three_bands() -> Column:
    return F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))


def _pair(pairs: DataFrame) -> DataFrame:
    """Distinct pairs with the smaller class first."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _sets_of(docs: DataFrame, rows: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """cls, members: the whole sets of the classes in ``members``, each read from one of its documents."""
    ids = rows.join(members.select("cls").distinct(), "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    ids = written(ids, "set-ids")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    whole = docs.join(ids, "doc_id", "left_semi").mapInArrow(_whole_sets(width), "cls long, members binary, bits array<long>")
    return whole.dropDuplicates(["cls"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar(percent), "a long, b long")


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of similar ones, that of the smallest doc_id.

    Documents with a null id or without words are in no group and stay. Of rows that share a doc_id one stays, that of the
    smallest hash of its columns. All columns stay; an empty table gives an empty table.
    """
    joined = written(join_ngrams(docs, width, percent), "ngram-join")
    kept = without(docs, written(joined.where("doc_id <> component_id").select("doc_id").distinct(), "copies"), "doc_id")
    again = written(joined.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if again.isEmpty():
        return kept
    rows = kept.join(again, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("_row"), F.col("doc_id").alias("_id"))
    own = [F.col(f"_row.`{c}`") for c, kind in kept.dtypes if "map<" not in kind and "variant" not in kind]
    one = rows.groupBy("_id").agg(F.min_by("_row", F.xxhash64(*own)).alias("_row")).select("_row.*")
    return without(kept, again, "doc_id").unionByName(one)


def oracle_sql(width: int = 3, percent: int = 90) -> str:
    """DuckDB SQL for ``join_ngrams``: pairs by common shingles, and their components by recursion."""
    lowered = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({lowered}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(w[i:i + {width - 1}], ' ')) WHEN len(w) > 0 THEN [len(w) || ':' || array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), k AS (SELECT g FROM s GROUP BY 1 HAVING count(*) > 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (SELECT * FROM s SEMI JOIN k USING (g)) a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT u.b, r.low FROM r JOIN u ON u.a = r.node),
    l AS (SELECT node, min(low) AS low FROM r GROUP BY 1)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.low AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN l ON l.node = d.doc_id
    """
