"""The registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import bpe, bytecnn, exact_dedup, knn, licenses, minhash, mixing, sharding, suffixes, toxicity
from wavemill.plans.runtime import ship, table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    first = F.try_element_at("uses", F.lit(1)).getField("position")
    return (
        rows.withColumn("first_position", F.floor(first))
        .orderBy(F.coalesce(first, F.lit(0.0)), "doc_id")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS place
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS most
  FROM totals),
leveled AS (
  SELECT *, most / weight AS room,
         (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM totals)
          - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
         / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
goals AS (
  SELECT source, source_size,
         least(most, coalesce((SELECT min(level) FROM leveled WHERE level <= room AND room = (SELECT min(room) FROM leveled WHERE level <= room)) * weight, most)) AS target
  FROM leveled),
placed AS (
  SELECT s.*, g.source_size, g.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * ((start + size / 2.0::DOUBLE < target)::INT + (start + source_size + size / 2.0::DOUBLE < target)::INT))::BIGINT AS taken
FROM placed
"""


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("matches", lambda m: ~m["template"])
    first = F.transform("base", lambda m: m["first_word"])
    score = F.when(F.exists("matches", lambda m: m["template"]), 1.0).when(F.size("matches") > 0, 0.5).otherwise(0.0)
    return found.withColumn("base", base).select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        licenses.joined(F.col("base")).alias("base_labels"),
        licenses.joined(F.col("matches")).alias("labels"),
        score.alias("score"),
    )


def _op2_sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM placed WHERE array_to_string(w[i:i + {len(p.split()) - 1}], ' ') = '{p}'"
        for p, label in licenses.PHRASES.items()
    )
    templates = " UNION ALL ".join(
        f"SELECT doc_id, '{label}' AS label FROM worded WHERE regexp_matches(' ' || array_to_string(w, ' '), '{licenses.as_pattern(t)}')"
        for label, t in licenses.TEMPLATES.items()
    )
    return rf"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE array_to_string(w, ' ') LIKE '%license%'),
base AS ({phrases}),
bases AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id),
templates AS ({templates}),
alls AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(s) AS score
  FROM (SELECT doc_id, label, 0.5::DOUBLE AS s FROM base UNION ALL SELECT doc_id, label, 1.0::DOUBLE FROM templates) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0) AS n_base, lo AS first_word, hi AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.score, 0.0::DOUBLE) AS score
FROM worded d LEFT JOIN bases b ON b.doc_id = d.doc_id LEFT JOIN alls a ON a.doc_id = d.doc_id
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(table(spark, sf_dir, "documents"))


OP3 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
placed AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS i FROM worded WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_id l ON l.a = d.doc_id
"""


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn(table(spark, sf_dir, "embeddings"), knn.divisible(50))


OP5 = """
WITH parts AS (
  SELECT vec_id, generate_subscripts(embedding, 1) AS i, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM embeddings),
scores AS (
  SELECT q.vec_id AS query_id, d.vec_id, sum(q.x * d.x)::BIGINT AS score
  FROM parts q JOIN parts d ON q.i = d.i AND q.vec_id <> d.vec_id AND q.vec_id % 50 = 0 GROUP BY q.vec_id, d.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("row_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP6 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda key: id_remainder(key, 5) != 0)
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    scored = toxicity.score(docs, weights)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def vocabulary() -> str:
    """Where the public byte-level BPE vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, vocabulary(), decoded="decoded"))


def id_remainder(key: Column, n: int) -> Column:
    """crc32 of an id as text, modulo ``n``."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(n))


def quality_network(spark: SparkSession, docs: DataFrame, sf_dir: str) -> bytecnn.Network:
    return bytecnn.fit(docs, table(spark, sf_dir, "labels"), lambda key: id_remainder(key, 4) != 2)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = bytecnn.score(docs, quality_network(spark, docs, sf_dir))
    held_out = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_rows(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "map_version",
    )


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        "op1_mixing": op1_mixing,
        "op2_licenses": op2_licenses,
        "op3_minhash": op3_minhash,
        "op4_suffixes": op4_suffixes,
        "op5_knn": op5_knn,
        "op6_exact_dedup": op6_exact_dedup,
        "op7_toxicity": op7_toxicity,
        "op8_bpe": op8_bpe,
        "op9_quality": op9_quality,
        "op10_sharding": op10_sharding,
    }
    return {name: _shipped(query) for name, query in named.items()}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op2_licenses": _op2_sql(), "op3_minhash": OP3, "op5_knn": OP5, "op6_exact_dedup": OP6}
