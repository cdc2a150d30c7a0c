"""The registered queries of the corpus operators and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm import audio, chat, decontaminate, huffman, line_dedup, ngram_join, oracles, packing, quality, shuffle, toxicity
from orebody.llm.common import table


def held_out():
    """True for the rows whose labels the toxicity field must not learn from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op1_toxic_span_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = toxicity.train(docs, table(spark, sf_dir, "labels"), held_out())
    found = toxicity.tag(docs, field)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"), "spans")


def op2_co_training_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False)


def op4_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.read_token_files(*huffman.write_token_files(table(spark, sf_dir, "documents")), keep_ids=False)


def op5_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffle.digests(table(spark, sf_dir, "documents"))


def op6_suffix_automaton_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_winnowing_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: runs and words removed as later repeats, and checks of what stays."""
    cut = line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("text", F.lit(""))
    return cut.select("doc_id", "removed_runs", "removed_words", F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(table(spark, sf_dir, "documents"))


def op9_chat_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_chats(turns)).drop("valid")


def op10_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"), k=3, percent=90)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxic_span_crf, op2_co_training_quality, op3_order_preserving_packing, op4_huffman_token_files, op5_external_shuffle, op6_suffix_automaton_decontamination, op7_winnowing_line_dedup, op8_telephony_audio, op9_chat_state_machine, op10_t_occurrence_join, pipeline)}

ORACLES = {"op6_suffix_automaton_decontamination": oracles.DECONTAMINATION, "op7_winnowing_line_dedup": oracles.LINES, "op9_chat_state_machine": oracles.CHAT, "op10_t_occurrence_join": oracles.JOIN}
