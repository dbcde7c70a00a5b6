"""One registered query per operator, over the driver tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kindred.llm import (boundaries, bpestream, collocations, contentsort, fairmix, hardneg, hilbert,
                         jaccardjoin, jumphash, onebit, pseudonyms, toxicity, warc)
from kindred.llm.common import table
from kindred.llm.tokens import vocabulary_path
from kindred.session import scratch_path, ship_package


def op1_elias_fano_token_files(spark, sf):
    import uuid
    ship_package(spark)
    path = scratch_path(spark, f"token-files-{uuid.uuid4().hex}")
    boundaries.write_token_files(table(spark, sf, "documents", "doc_id", "text"), path,
                                 vocabulary_path("byte_bpe_50k.json"))
    return boundaries.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_feistel_pseudonyms(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text", "lang", "source", "n_chars")
    return pseudonyms.pseudonymise(docs, "a key that its owner keeps") \
        .select("doc_id", "text", "n_values", "kinds")


def op3_content_sort(spark, sf):
    return contentsort.exact_groups(table(spark, sf, "documents", "doc_id", "text"))


def op4_warc_transactions(spark, sf):
    ship_package(spark)
    got = warc.round_trip(table(spark, sf, "pages", "page_id", "url", "html"), payloads=False)
    return got.select("page_id", F.col("answer.payload_bytes").alias("payload_bytes"),
                      F.col("answer.payload_digest").alias("payload_digest"), "record_type", "refers_to")


def op5_jump_hash_shards(spark, sf):
    ship_package(spark)
    return jumphash.assign_shards(table(spark, sf, "documents", "doc_id", "text"), 24)


def op6_jaccard_regions(spark, sf):
    ship_package(spark)
    return jaccardjoin.near_components(table(spark, sf, "documents", "doc_id", "text")) \
        .select("doc_id", "n_shingles", "component_id")


def op7_nearest_labelled(spark, sf):
    ship_package(spark)
    docs = table(spark, sf, "documents", "doc_id", "text")
    index, read = toxicity.fit_and_read(docs, table(spark, sf, "labels", "doc_id", "toxic"))
    return toxicity.score_read(read, index).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "evidence")


def op8_hilbert_packing(spark, sf):
    ship_package(spark)
    return hilbert.pack(table(spark, sf, "documents", "doc_id", "text"), vocabulary_path("word_bpe_49k.json"))


def op9_one_bit_codes(spark, sf):
    ship_package(spark)
    vectors = table(spark, sf, "embeddings", "vec_id", "embedding")
    index, centres = onebit.build_index(vectors)
    return onebit.search(index, centres, vectors.where("vec_id % 100 = 0"))


def op10_fair_queueing(spark, sf):
    return fairmix.fair_mix(table(spark, sf, "documents", "doc_id", "text", "source")) \
        .select("doc_id", "size", "source_size", "target", "taken", "finish", "mix_start")


def op11_streaming_bpe(spark, sf):
    ship_package(spark)
    path = vocabulary_path("byte_bpe_50k.json")
    ids = bpestream.encode_texts(table(spark, sf, "documents", "doc_id", "text"), path, keep=["doc_id"])
    return bpestream.decode_ids(ids, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_phrase_streams(spark, sf):
    ship_package(spark)
    return collocations.collocations(table(spark, sf, "documents", "text", "lang"))


def op13_residue_negatives(spark, sf):
    ship_package(spark)
    vectors = table(spark, sf, "embeddings", "vec_id", "embedding", "label") \
        .withColumn("label", F.expr("if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hardneg.mine(vectors, "vec_id % 50 = 0")


QUERIES = {f.__name__: f for f in (
    op1_elias_fano_token_files, op2_feistel_pseudonyms, op3_content_sort, op4_warc_transactions,
    op5_jump_hash_shards, op6_jaccard_regions, op7_nearest_labelled, op8_hilbert_packing,
    op9_one_bit_codes, op10_fair_queueing, op11_streaming_bpe, op12_phrase_streams, op13_residue_negatives)}
