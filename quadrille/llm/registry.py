"""Queries of this folder for the driver, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, mixing, neardup, pieces, quality, secrets, substrings, tokenfile, topk, toxicity
from .common import table


def vocabulary_path(file: str) -> str:
    """Vocabulary files are never copied here; the installed folder of public tokenizers has them."""
    import public_tokenizers

    return public_tokenizers.path(file)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn_rules(quality.labelled(docs, table(spark, sf_dir, "labels")))
    return quality.judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_digest(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))


#: Target weights of the query: by name, and 1 for every other source.
WEIGHTS = {"src0": 4.0, "src1": 2.0}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"), WEIGHTS)
    return found.select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "place", "text")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "flagged")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    return found.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"), F.array_max("starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "score",
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode(table(spark, sf_dir, "documents"), pieces.Vocabulary.load(vocabulary_path("piece_bpe_32k.model")))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_top_k": op2_top_k,
    "op7_sentencepiece": op7_sentencepiece,
    "op3_toxicity": op3_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_license_scan": op6_license_scan,
    "op9_substring_dedup": op9_substring_dedup,
    "op8_token_shards": op8_token_shards,
    "op10_quality_rules": op10_quality_rules,
    "op4_simhash_dedup": op4_simhash_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op1_source_mixing": """
        WITH sized AS (SELECT source, sum(coalesce(length(text), 0) + 1)::DOUBLE AS size, max(CASE source WHEN 'src0' THEN 4.0 WHEN 'src1' THEN 2.0 ELSE 1.0 END)::DOUBLE AS weight FROM documents GROUP BY source),
        rated AS (SELECT source, weight / sum(weight) OVER () * sum(size) OVER () / size AS rate FROM sized),
        steps AS (SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 24)::BIGINT + 1)) AS k FROM rated),
        cdf AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS c FROM steps),
        draws AS (SELECT doc_id, source, text, ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
        times AS (SELECT d.doc_id, d.source, d.text, count(*) AS n FROM draws d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u GROUP BY ALL),
        copies AS (SELECT doc_id, source, unnest(range(1, n + 1))::INTEGER AS copy, text FROM times)
        SELECT doc_id, source, copy, ('0x' || substr(md5('0:place:' || doc_id || ':' || copy), 1, 13))::BIGINT AS place, text FROM copies
    """,
    "op2_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
        scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2]))::BIGINT AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        listed AS (SELECT doc_id, list_transform(range(0, greatest(len(w) - 19, 0)), lambda s: array_to_string(w[s + 1 : s + 20], ' ')) AS k FROM d),
        windows AS (SELECT doc_id, unnest(k) AS k, unnest(range(0, len(k))) AS s FROM listed),
        firsts AS (SELECT k, min(doc_id::HUGEINT * 1000000000 + s) AS place FROM windows GROUP BY k HAVING count(*) > 1),
        later AS (SELECT doc_id, s FROM windows JOIN firsts USING (k) WHERE doc_id::HUGEINT * 1000000000 + s > place),
        gone AS (SELECT DISTINCT doc_id, s + o AS i FROM later, (SELECT unnest(range(0, 20)) AS o)),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
    """,
}
