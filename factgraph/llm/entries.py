"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm import audio, html, langid, lattice, lm, ngram_join, oracles, packing, quality, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: str, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(n))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "stratum", "failed")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = lm.vocabulary(docs)
    return lm.score_documents(docs, lm.train(docs, words), words)


def op6_sentencepiece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = lattice.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), checked=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.ngram_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.where(fold("doc_id", 4) != 2), labels.where(fold("doc_id", 4) != 2))
    out = toxicity.score_toxicity(docs, model)
    worst = F.get("offending", F.lit(0))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "n_sentences", worst["start"].alias("worst_start"), worst["end"].alias("worst_end"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(fold("doc_id", 3) != 1))
    return langid.identify(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    media = audio.encode_wav(docs, "data").select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), "media")
    out = audio.audio_features(media, keep=("doc_id", "n_bytes", "media"))
    size = F.octet_length("payload")
    return out.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -64, 64)).cast("long").alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
        "n_frames", F.crc32("tensors").alias("tensors_crc32"), F.size("segments").alias("n_segments"),
    )


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_suffix_array_dedup, op3_best_fit_packing, op4_lm_scoring, op5_html_main_text, op6_sentencepiece_lattice, op7_ngram_jaccard_join, op8_toxicity, op9_language_id, op10_audio_features)}
#: The other operators use trained models, tokenizers or media, which SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op2_suffix_array_dedup": oracles.REPEATS, "op7_ngram_jaccard_join": oracles.GROUPS}
