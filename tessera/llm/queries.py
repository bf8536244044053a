"""The thin queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.code_compression import compress, digest
from tessera.llm.common import shared_path, table
from tessera.llm.cross_polytope import nearest
from tessera.llm.language import fit_languages, held_out, identify_languages
from tessera.llm.mixing import mix_sources
from tessera.llm.ngram_join import Join, ngram_jaccard_join
from tessera.llm.oracles import CODES, DIVERGENCE, MIXING, NGRAM_JOIN
from tessera.llm.packing import pack_documents
from tessera.llm.quality_rules import divergence_rules
from tessera.llm.quality_rules_model import fit_quality, score_quality
from tessera.llm.rank_array import decode_documents, encode_documents
from tessera.llm.token_files import read_token_files, write_token_files
from tessera.llm.toxicity import fit_toxicity, score_toxicity
from tessera.llm.whitening import whiten
from tessera.llm.wrappers import extract_pages


def op1_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), Join(width=4, percent=85))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    nearest_id, cosine = F.get("neighbours", 0).alias("nearest_id"), F.get("cosines", 0).alias("nearest_cosine")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("neighbours").alias("n_neighbours"), nearest_id, cosine)


def op5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).drop("host")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_languages(docs, fit_languages(docs))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", F.concat_ws(",", "languages").alias("language_set"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    manifest = write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, manifest, with_ids=False).drop("frame_bytes", "dictionary")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    found = decode_documents(encode_documents(table(spark, sf_dir, "documents"), tokenizer), tokenizer)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_divergence_rules": op1_divergence_rules,
        "op2_ngram_join": op2_ngram_join,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_wrappers": op5_wrappers,
        "op6_language_id": op6_language_id,
        "op7_mixing": op7_mixing,
        "op8_cross_polytope": op8_cross_polytope,
        "op9_token_files": op9_token_files,
        "op10_quality": op10_quality,
        "op11_rank_array": op11_rank_array,
        "op12_whitening": op12_whitening,
        "op13_code_compression": op13_code_compression,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_divergence_rules": DIVERGENCE, "op2_ngram_join": NGRAM_JOIN, "op7_mixing": MIXING, "op13_code_compression": CODES}
