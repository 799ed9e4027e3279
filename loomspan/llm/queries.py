"""The queries opN_<name> over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, attribution, chat, langid, media, mixing, packing, pii, simhash, token_files
from .common import save, shared_path, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.read_chats(chat.format_chats(rows.unionByName(own))))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = save(spark, media.store(table(spark, sf_dir, "documents")), "media", compression="zstd")
    kept = save(spark, media.tensors(stored), "media-tensors", compression="zstd")
    return media.checksums(stored).join(media.described(kept), "row").drop("row")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.train(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    token_files.write(spark, table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.checksums(token_files.read(spark, path))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(spark, docs, texts=False).select("doc_id", "size", "source_size", "target", "taken")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = langid.train(docs)
    found = langid.identify(docs.select("doc_id", langid.held_out().alias("held_out"), "text"), net)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [x for k, x in globals().items() if k.startswith("op") and k[2].isdigit()]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat.SQL, "op8_mixing": mixing.SQL}
