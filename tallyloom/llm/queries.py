"""The queries opN_<name> of this package and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import crc32_text, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import similarity_classes

    return similarity_classes(_table(spark, sf_dir, "documents"))


def tokenizer() -> str:
    """Path of the 50k byte-level BPE vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_hidden_markov_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hmm_lm import score

    return score(_table(spark, sf_dir, "documents"), crc32_text(F.col("doc_id")) % 7 == 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = crc32_text(F.col("doc_id")) % 3 == 1
    model = quality.fit(quality.with_labels(docs, labels.where(~held_out), "quality"))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), tokenizer())


def op4_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, dropped (line numbers, joined by commas)."""
    from . import line_dedup

    docs = _table(spark, sf_dir, "documents")
    gone = line_dedup.dropped_lines(docs).withColumnRenamed("doc_id", "gone_id")
    counted = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    out = counted.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(_table(spark, sf_dir, "pages"))


def op8_kmeans_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kmeans_tree import search

    return search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files named <source>/<lang>/<doc_id>: doc_id, path, license, score, origin, source_path, a row per row of documents."""
    from .license_scan import scan

    docs = _table(spark, sf_dir, "documents")
    parts = (F.replace(F.coalesce(c, F.lit("-")), F.lit("/"), F.lit("_")) for c in (F.col("source"), F.col("lang"), F.col("doc_id").cast("string")))
    files = docs.select("doc_id", F.concat_ws("/", *parts).alias("path"), "text")
    found = scan(files)
    return files.select("doc_id", "path").join(found, "path").select("doc_id", "path", "license", "score", "origin", F.col("source").alias("source_path"))


def op10_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    found = round_trip(_table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import taken_words

    return taken_words(_table(spark, sf_dir, "documents"))


def op13_orchard_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .orchard import cluster

    return cluster(_table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if re.match(r"op\d+_", name)}


_WARC_SQL = """
with p as (select page_id, coalesce(html, '') as h, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as holder from p where n >= 1000 group by d)
select page_id, n as payload_bytes, p.d as payload_digest,
       case when holder is null or holder = page_id then 'response' else 'revisit' end as record_type,
       case when holder <> page_id then holder end as refers_to
from p left join g on p.d = g.d and n >= 1000
"""


def _k_means_sql(k: int = 16, rounds: int = 3) -> str:
    """Every vector against every centroid, round by round."""
    parts = [
        f"""kept as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda v: cast(floor(64 * cast(v as double)) as bigint)) as x from embeddings
where len(embedding) = 64 and len(list_filter(embedding, lambda v: v is not null and isfinite(v) and abs(floor(64 * cast(v as double))) < {1 << 26})) = 64)""",
        f"c0 as materialized (select row_number() over (order by h, x) - 1 as c, x as ctr from (select sha256('1:' || coalesce(cast(vec_id as varchar), '')) as h, x from kept order by h, x limit {k}))",
    ]
    for n in range(rounds + 1):
        parts.append(f"d{n} as (select r, vec_id, x, c, list_sum(list_transform(range(1, 65), lambda i: (x[i] - ctr[i]) * (x[i] - ctr[i]))) as d from kept cross join c{n})")
        parts.append(f"a{n} as materialized (select r, vec_id, x, arg_min(c, (d, c)) as c, min(d) as d from d{n} group by r, vec_id, x)")
        if n < rounds:
            parts.append(f"m{n} as (select c, i, cast(floor(cast(sum(v) as double) / count(*)) as bigint) as m from (select c, unnest(x) as v, unnest(range(1, 65)) as i from a{n}) group by c, i)")
            parts.append(f"c{n + 1} as materialized (select c, coalesce(m, ctr) as ctr from c{n} left join (select c, list(m order by i) as m from m{n} group by c) using (c))")
    return "with " + ",\n".join(parts) + f"""
select vec_id, cast(c as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by c) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
       sha256(array_to_string(ctr, ',')) as centroid_sha256 from a{rounds} join c{rounds} using (c)"""


def oracle_sql() -> dict[str, str]:
    return {"op10_warc_round_trip": _WARC_SQL, "op13_orchard_clustering": _k_means_sql()}
