"""The queries of the operators, each over its whole table, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import chat_format, conversation_repair, decontaminate, language_id, license_scan, lm_score, mixing, ngram_join, packing, token_alignment, token_file, url_filter, vector_tree
from docloom.llm.base import new_dir, table

#: Blocks of each source in a period of the mix; sources that are not named have a block each.
MIX_WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}
#: The url rules (fixed values): host and path, and what they say.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Pattern rules for urls that no host rule fits.
URL_PATTERNS = (("*/ads/*", "block"), ("*/login^", "block"), ("*/tracker/*", "block"))


def tokenizer_path() -> str:
    """The file of the byte-level tokenizer, where the executor has it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_tokenizer_path() -> str:
    """The file of the tokenizer with word ends, where the executor has it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model_path() -> str:
    """The file of the sentence-piece model, where the executor has it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fold(n: int) -> Column:
    """The fold of a document: the CRC-32 of its id as text, modulo ``n``."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, with the item and the place."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids written as token segments, and read back."""
    segments = token_file.write_tokens(table(spark, sf_dir, "documents"), new_dir(spark, "tokens"), tokenizer_path)
    return token_file.read_tokens(segments, digest=True)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mix of all sources."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, MIX_WEIGHTS).select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_position")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learnt from two folds of three."""
    docs = table(spark, sf_dir, "documents")
    network = language_id.fit(docs, F.coalesce(fold(3) != 1, F.lit(False)))
    return language_id.identify(docs, network).select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability, learnt from four folds of five."""
    return lm_score.score_texts(table(spark, sf_dir, "documents"), fold(5) == 1)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all documents."""
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_vector_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return vector_tree.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    rules = [url_filter.host_rule(*r) for r in URL_RULES] + [url_filter.pattern_rule(*r) for r in URL_PATTERNS]
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set size and component of similar documents."""
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that imitates control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(more)))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids in as few sequences of 2048 as best fit and local search find."""
    return packing.pack(packing.cut_documents(table(spark, sf_dir, "documents"), word_tokenizer_path))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens by two tokenizers, with the groups that both cut and the counts of their links."""
    return token_alignment.align_documents(table(spark, sf_dir, "documents"), (tokenizer_path, piece_model_path))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations damaged, with their faults, cheapest edits and repaired turns."""
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_token_file, op3_mix_sources, op4_language_id, op5_lm_score, op6_license_scan, op7_vector_tree, op8_url_filter, op9_ngram_join, op10_chat_format, op11_best_fit_packing, op12_token_alignment, op13_conversation_repair)
}
_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The url filter in SQL: host rules by their suffix and prefix, then the patterns' regular expressions.
_URL_SQL = f"""
    WITH p AS (SELECT page_id, {_LOWERED.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT rule, split_part(rule, '/', 1) AS h, substr(rule, strpos(rule, '/')) AS f, verdict FROM (VALUES {", ".join(f"('{r}', '{v}')" for r, v in URL_RULES)}) AS v(rule, verdict)),
    b AS (SELECT page_id, max(struct_pack(n := length(rule), rule := rule, verdict := verdict)) AS b FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f) GROUP BY 1)
    SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, CASE WHEN regexp_matches(host || path, '(?i)/ads/|/login(^|$|[^a-z0-9])|/tracker/') THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN b USING (page_id)
"""
ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.oracle_sql(),
    "op3_mix_sources": mixing.oracle_sql(MIX_WEIGHTS),
    "op6_license_scan": license_scan.oracle_sql(),
    "op8_url_filter": _URL_SQL,
    "op9_ngram_join": ngram_join.oracle_sql(),
    "op10_chat_format": chat_format.oracle_sql(),
    "op13_conversation_repair": conversation_repair.oracle_sql(),
}
