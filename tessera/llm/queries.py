"""The queries opN_ over the whole tables. Each derives its columns from what the operator returns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lang_id, line_dedup, lm_score, ngram_join, packing, quotation, secret_scan, url_filter, weighted_sampling
from .common import table

#: The vocabulary that op5 packs by.
TOKENIZER = "word_bpe_49k.json"
#: Fixed rules of op7.
URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
#: Host labels whose pages make the list of op7.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(lm_score.remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    scored = lm_score.score(table(spark, sf_dir, "documents"), ~held_out & F.col("doc_id").isNotNull())
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "train_types", "base_score", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove(table(spark, sf_dir, "documents")).select("doc_id", "source", "text", "n_removed")


def op3_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = F.coalesce(lang_id.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = lang_id.fit(docs.where(lang_id.remainder(F.col("doc_id"), 5) != 0))
    return lang_id.predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    base = F.filter("secrets", lambda s: s.kind.isin([k[0] for k in secret_scan.BASE]))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda field, value: F.size(F.filter("secrets", lambda s: s[field] == value)).cast("long")
    of_kind = {f"n_{k[0]}": count("kind", k[0]) for k in secret_scan.BASE}
    verdicts = {f"n_{v}": count("verdict", v) for v in ("live", "example", "weak")}
    return found.select("doc_id", *(c.alias(n) for n, c in of_kind.items()), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), *(c.alias(n) for n, c in verdicts.items()))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_filter.rules_table(spark, URL_RULES), url_filter.hosts_with(pages, LISTED_LABELS))
    return judged.select("page_id", "host", "path", "rule", "verdict", "canonical_url", "listed")


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.link(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "clean_text", "n_quotes", "n_linked", "parent_turn", "thread_root", "depth")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op10_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.neighbours(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("key", "doc_id")


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_line_dedup, op3_lang_id, op4_decontaminate, op5_packing, op6_secret_scan, op7_url_filter, op8_quotation_linking, op9_ngram_join, op10_weighted_sampling)}
