"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, exact_dedup, licenses, lm, mixing, ngram_join, packing, quality, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"), folder)
    return warc.read_warc(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), packing.public_tokenizer("byte_bpe_50k.json"))


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_warc": op1_warc,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_source_mix": op6_source_mix,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_license_scan": op3_license_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_toxicity": op8_toxicity,
    "op9_hnsw_neighbours": op9_hnsw_neighbours,
    "op10_quality": op10_quality,
}

ORACLES = {
    "op5_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
        g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
        select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
        from n join g on n.t = g.t
    """,
    "op6_source_mix": r"""
        with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
        s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
        w as (select *, [5.0, 2.0, 1.0][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)]::double as weight from s),
        o as (select *, row_number() over (order by 3 * source_size / weight, source nulls last) as k,
                coalesce(sum(3 * source_size) over (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as held,
                sum(weight) over (order by 3 * source_size / weight, source nulls last rows between current row and unbounded following) as weighed,
                sum(source_size) over () as total from w),
        l as (select min_by((total - held) / weighed, k) as level from o where (total - held) / weighed <= 3 * source_size / weight),
        t as (select source, source_size, case when weight * level >= 3 * source_size then cast(3 * source_size as double) else weight * level end as target from w, l),
        r as (select source, source_size, target, case when source_size > 0 then target / source_size else 0 end as rate from t),
        j as (select d.doc_id, d.source, d.size, r.source_size, r.target, r.rate, k,
                floor(r.rate) + case when cast('0x' || substr(md5('mix:' || (k // 4) || ':' || coalesce(cast(d.doc_id as varchar), 'null')), 1 + 8 * (k % 4), 8) as ubigint) / 4294967296.0::double < r.rate - floor(r.rate) then 1 else 0 end as copies
              from d join r on d.source is not distinct from r.source, range(16) as seeds(k)),
        m as (select source, k, abs(cast(sum(size * copies) as double) - any_value(target)) as miss from j group by source, k),
        b as (select source, k from (select source, k, row_number() over (partition by source order by miss, k) as place from m) where place = 1)
        select j.doc_id, j.size, j.source_size, j.target, cast(j.size * j.copies as bigint) as taken
        from j join b on j.source is not distinct from b.source and j.k = b.k
    """,
}
