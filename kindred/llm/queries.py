"""The operators over the driver's tables, with production parameters, as named queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import ann, decontaminate, lines, packing, pii, quality, shards, simhash, substrings, urls
from kindred.llm import shared as S

#: Rules of op2: action and host/path.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(table(spark, sf_dir, "documents"), length=100, keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10)
    return out.select("doc_id", "_lines.n_lines", "_lines.n_dropped", lines.sha256_hex(F.col("_lines.kept")).alias("kept_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), END_ID, 4096)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op9_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = shards.write(table(spark, sf_dir, "documents"), S.new_folder(spark, "ids"), tokenizer_path(), END_ID)
    return shards.read(spark, files, with_ids=False)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), tile=5, coverage=0.8)
    spans = F.array_join(F.transform("tiles", lambda t: F.concat_ws(":", t["doc_at"], t["item_at"], t["words"])), ",")
    return found.select("doc_id", "item_id", "item_words", "covered", "coverage", "n_tiles", spans.alias("tiles"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_url_filter, op3_simhash, op4_pii, op5_ann, op6_line_dedup, op7_packing, op8_quality, op9_token_shards, op10_decontaminate, pipeline)
}
