"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import decontaminate, divergence, embeddings, language, licenses, mixing, oracles, rans, search, sentencepiece, sharding, simhash, toxicity, warc
from threadloom.llm.shared import held_out, small_rows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece.load(_tokenizer("piece_bpe_32k.model"))
    return sentencepiece.encode(_table(spark, sf_dir, "documents"), model)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.fit(docs))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_table(spark, sf_dir, "embeddings"), min_cos=0.95)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"), least_bytes=100)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op9_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(_tokenizer("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return rans.write_and_read(_table(spark, sf_dir, "documents"), definition, end_id=2)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.predict(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=10, most_terms=10)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), share=1.5, weights=(5, 2, 1), most_epochs=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_licenses": op3_licenses,
    "op4_decontaminate": op4_decontaminate,
    "op5_embeddings": op5_embeddings,
    "op6_warc": op6_warc,
    "op7_sharding": op7_sharding,
    "op8_language": op8_language,
    "op9_rans": op9_rans,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_search": op12_search,
    "op13_mixing": op13_mixing,
}

#: Trained models, XXH64, CRC-32 and file formats are beyond SQL; these operators are not.
ORACLES: dict[str, str] = {
    "op5_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 sound AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NOT NULL AND isfinite(x))) = len(e) AND len(list_filter(e, lambda x: x <> 0)) > 0),
 links AS (SELECT x.vec_id AS id, y.vec_id AS nbr FROM sound x JOIN sound y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.95),
 comp(id, c) USING KEY (id) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.nbr, min(x.c) FROM comp x JOIN links l ON l.id = x.id JOIN recurring.comp r ON r.id = l.nbr WHERE x.c < r.c GROUP BY l.nbr)
 SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN comp ON comp.id = vec_id LEFT JOIN (SELECT id, count(*) AS n FROM links GROUP BY 1) k ON k.id = vec_id""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
 f AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY 1)
 SELECT page_id, n AS payload_bytes, p.digest AS payload_digest, CASE WHEN n >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM p LEFT JOIN f ON f.digest = p.digest AND n >= 100""",
    "op11_divergence": oracles.DIVERGENCE,
    "op12_search": oracles.SEARCH,
    "op13_mixing": oracles.MIXING,
}
