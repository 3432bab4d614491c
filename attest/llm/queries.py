"""The operators as queries over the given tables, each beside the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.decontaminate import HITS_SQL, hits
from attest.llm.importance import RESAMPLED_SQL, resampled
from attest.llm.language_model import score_texts
from attest.llm.licences import LICENCES_SQL, licences, url_path
from attest.llm.merkle import MANIFEST_SQL, folded, manifest, path_digest, tampered
from attest.llm.mixing import Mix
from attest.llm.near_dedup import near_duplicates
from attest.llm.neighbours import neighbours
from attest.llm.quality import quality
from attest.llm.run_index import remove_shared
from attest.llm.substrings import remove_repeats
from attest.llm.token_files import read_tokens, with_crc32, write_tokens
from attest.llm.toxicity import toxicity
from attest.queries.registry import Query, Tables

QUERIES: dict[str, Query] = {"pipeline": Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = Query(lambda spark, folder: function(Tables(spark, folder)), sql)
        return function

    return register


@query("op1_licence_scan", LICENCES_SQL)
def op1_licence_scan(t: Tables) -> DataFrame:
    """Pages as files, a folder's licence being stated by its index pages, whose address ends with a slash; and documents, without a path."""
    index = F.coalesce(F.col("url").rlike(r"^[a-z]+://[^?#]+/([?#].*)?$"), F.lit(False))
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), url_path(F.col("url")).alias("path"), index.alias("states"), F.col("html").alias("text"))
    documents = t.documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("path"), F.lit(False).alias("states"), "text")
    files = pages.unionByName(documents).withColumn("file", F.struct("kind", "id"))
    return licences(files, F.col("path"), F.col("states"), "file", "text").select("file.*", "path", "licence", "score", "how", "licence_path")


@query("op3_near_dedup")
def op3_near_dedup(t: Tables) -> DataFrame:
    return near_duplicates(t.documents).select("doc_id", "fingerprint", "component_id")


@query("op4_decontamination", HITS_SQL)
def op4_decontamination(t: Tables) -> DataFrame:
    found = hits(t.documents, t.benchmark)
    ids = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"), "contaminated"
    )


@query("op8_token_files")
def op8_token_files(t: Tables) -> DataFrame:
    path = write_tokens(t.documents, public_tokenizers.path("word_bpe_49k.json"))
    return with_crc32(read_tokens(t.spark, path)).withColumnRenamed("key", "doc_id")


@query("op6_mixing")
def op6_mixing(t: Tables) -> DataFrame:
    return Mix(t.documents).taken().select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op2_quality_classifier")
def op2_quality_classifier(t: Tables) -> DataFrame:
    return quality(t.documents, t.labels).drop("print")


@query("op7_substring_dedup")
def op7_substring_dedup(t: Tables) -> DataFrame:
    return remove_repeats(t.documents)


@query("op5_language_model")
def op5_language_model(t: Tables) -> DataFrame:
    return score_texts(t.documents)


@query("op9_run_index")
def op9_run_index(t: Tables) -> DataFrame:
    return remove_shared(t.documents)


@query("op10_nearest_neighbours")
def op10_nearest_neighbours(t: Tables) -> DataFrame:
    return neighbours(t.embeddings, F.col("vec_id") % 20 == 0)


@query("op11_merkle_manifest", MANIFEST_SQL)
def op11_merkle_manifest(t: Tables) -> DataFrame:
    found = manifest(t.documents, also={"tampered": tampered()})
    fold = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), fold.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_importance_resampling", RESAMPLED_SQL)
def op12_importance_resampling(t: Tables) -> DataFrame:
    return resampled(t.documents, t.benchmark).select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_toxicity")
def op13_toxicity(t: Tables) -> DataFrame:
    return toxicity(t.documents, t.labels).drop("clause")
