"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embeddings, fim, html, langid, minhash, oracle, secrets, sharding, suffix_dedup, toxicity, whitening


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _share(column: str, by: int) -> F.Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.dedup(_read(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs, learn_from="crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", (_share("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=2)


TRICKY = r"\### Assistant: </turn> ok"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    two = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text")
    )
    back = chat.read_back(chat.format_windows(turns.unionByName(two)))
    lines = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    model = html.train(pages)
    return html.main_text(pages.select("page_id", "url", "html"), model).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"), of("model"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"), learn_from="crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (_share("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_matches(docs, _read(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.covered_words(F.col("matches")).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size("matches") > 0).alias("contaminated"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_read(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_read(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_read(spark, sf_dir, "embeddings"), components=8)


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_langid": op2_langid, "op3_minhash": op3_minhash, "op4_chat": op4_chat, "op5_embeddings": op5_embeddings, "op6_bpe": op6_bpe, "op7_html": op7_html, "op8_secrets": op8_secrets, "op9_toxicity": op9_toxicity, "op10_decontaminate": op10_decontaminate, "op11_sharding": op11_sharding, "op12_fim": op12_fim, "op13_whitening": op13_whitening}

ORACLE_SQL: dict[str, str] = oracle.SQL
