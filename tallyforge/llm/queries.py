"""The queries op1 to op13 over the whole tables, each a thin digest of its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, line_dedup, near_dedup, ranked, sharding, simhash, spelling, token_files, toxicity
from .common import stage, staging_dir, table
from .pieces import digest_documents
from .secrets import scan_secrets


def public_path(name: str) -> str:
    """Where this machine keeps a public tokenizer's file, by default."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.write_shards(table(spark, sf_dir, "documents"), staging_dir(spark, "shards"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_files(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = staging_dir(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, tokenizer_path or public_path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, path, digest=True)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "threshold", F.col("toxic_rejected").alias("rejected"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, e, g = ("f1", "f2"), ("e1", "e2"), ("g1", "g2")
    prints = stage(simhash.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text")), "prints")
    out = simhash.count_near(prints, F.col("doc_id") % 20 == 0)
    return out.select("doc_id", "n_chars", "edited_sha256", simhash.shown(*f).alias("fingerprint"), simhash.shown(*e).alias("edited_fingerprint"), simhash.likeness(f, e).alias("near_edited"), simhash.likeness(f, g).alias("near_next"), "n_near")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = chat.as_events(chat.with_probe(table(spark, sf_dir, "conversations")))
    formatted = stage(chat.render(chat.fold(log)), "chat")
    return chat.digest(chat.read_back(formatted))


def op8_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path or public_path("piece_bpe_32k.model"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.judged(decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("secret_spans").alias("spans"))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_dir(spark, "index")
    ranked.write_index(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return ranked.search(ranked.read_index(spark, path), table(spark, sf_dir, "benchmark"), "item_id")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    lost = runs.select(spelling.with_losses(F.col("word"), F.col("doc_id")).alias("word"))
    return spelling.variants(stage(spelling.counted(lost), "words"))


def op13_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path or public_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op3_token_files": op3_token_files,
        "op2_toxicity": op2_toxicity,
        "op4_simhash": op4_simhash,
        "op5_line_dedup": op5_line_dedup,
        "op6_near_dedup": op6_near_dedup,
        "op7_chat": op7_chat,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_decontaminate": op9_decontaminate,
        "op10_secrets": op10_secrets,
        "op11_ranked": op11_ranked,
        "op12_spelling": op12_spelling,
        "op13_bpe": op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_dedup.ORACLE, "op7_chat": chat.ORACLE, "op11_ranked": ranked.ORACLE, "op12_spelling": spelling.ORACLE}
