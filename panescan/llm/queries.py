"""The registered queries of the operators, over the whole given tables."""

from __future__ import annotations

import public_tokenizers

from panescan.llm import best_fit, bpe, collocations, embedding_dedup, exact_dedup, lexical_search, minhash_dedup, packing, secret_scan, sharding, substring_dedup, toxicity, url_filter
from panescan.llm.common import table
from panescan.session import ship_package

QUERIES: dict = {}
SQL: dict = {}


def byte_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return fn

    return register


@query("op1_bpe_round_trip")
def op1(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), byte_vocabulary())


@query("op2_secret_scan")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


@query("op3_toxicity")
def op3(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query("op4_substring_dedup", substring_dedup.SQL)
def op4(spark, sf_dir):
    return substring_dedup.repeat_digests(table(spark, sf_dir, "documents"))


@query("op5_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), word_vocabulary(), with_ids=False)


@query("op6_exact_dedup", exact_dedup.SQL)
def op6(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op7_url_filter")
def op7(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op8_sharding")
def op8(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op9_minhash_dedup", minhash_dedup.SQL)
def op9(spark, sf_dir):
    return minhash_dedup.near_documents(table(spark, sf_dir, "documents"))


@query("op10_embedding_dedup", embedding_dedup.SQL)
def op10(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_collocations", collocations.SQL)
def op11(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query("op12_best_fit")
def op12(spark, sf_dir):
    return best_fit.pack(table(spark, sf_dir, "documents"), word_vocabulary(), ids=False)


@query("op13_lexical_search", lexical_search.SQL)
def op13(spark, sf_dir):
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
