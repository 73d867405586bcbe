"""One query for each operator of this subpackage over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, embed_dedup, html_text, langid, license_scan, line_dedup, minhash, oracles, packing, periodic, quality, substring, vector_codes
from weftline.llm.common import read

_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.load_ranks(docs, _RANKS)
    ids = bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.digests(bpe.decode(ids, ranks, public_tokenizers.PATTERN))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack(docs, bpe.load_ranks(docs, _RANKS), public_tokenizers.PATTERN, capacity=2048, added=bpe.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    judged = quality.judge(quality.with_counts(docs).drop("text"))
    c = F.col("counts")
    return judged.select("doc_id", *[c[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], quality.base_failed(c).alias("base_failed"), "kept")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read(spark, sf_dir, "embeddings"), cosine=0.9)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))


def op8_every_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op8_line_dedup, with runs of one line too."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.remove(docs, window=1).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("kept_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove(docs, width=50).select("doc_id", "n_words", "n_removed", F.sha2("clean_text_words", 256).alias("kept_sha256"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.scan(read(spark, sf_dir, "documents")))


def with_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with the periodic tails that the contract of op11 gives to a tenth of the texts."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")
    h, n = F.crc32(F.col("doc_id").cast("string")), F.nullif(F.size("w"), F.lit(0))
    at, lap = F.col("g") % n, F.lit(1) + F.floor((n - F.col("g") % n) / (3 + F.col("g") % 8))
    tailed = F.transform("w", lambda x, i: F.when(i < F.col("at"), x).otherwise(F.get("w", (F.col("at") + (i - F.col("at")) % F.col("lap")).cast("int"))))
    src = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g"))
    src = src.select("doc_id", "text", "w", at.alias("at"), lap.alias("lap"))
    return src.select("doc_id", F.when(F.size("w") > 0, F.array_join(tailed, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.summary(periodic.collapse(with_tails(docs)))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books, places = vector_codes.train(vectors)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books, places))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_digest(books)).alias("codebooks_sha256"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_best_fit_packing, op3_chat_format, op4_quality_rules, op5_embedding_near_dedup, op6_language_id, op7_minhash_near_dedup, op8_line_dedup, op8_every_line, op9_substring_dedup, op10_license_scan, op11_periodic_runs, op12_html_extraction, op13_vector_codes)}

ORACLE_SQL: dict[str, str] = {"op4_quality_rules": oracles.OP4, "op8_line_dedup": oracles.OP8, "op8_every_line": oracles.OP8_EVERY_LINE, "op9_substring_dedup": oracles.OP9}
