"""Registered queries: the library's operators over alignment-shaped projections of the star-schema tables.

Reads come from ``lineitem``, genes from ``part``; both projections are in integer
arithmetic that Spark and DuckDB share.  Each query has the same relation in
DuckDB SQL, written apart from the operators it checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stratalign.functions import cigar as cg, flags as fl, sequences
from stratalign.functions.numeric import logistic_curve
from stratalign.operators import intervals as iv, sequences as sq
from stratalign.plans import complexity, counting as ct, coverage as cv, gene_body as gb, pairs as pr, statistics as st
from stratalign.sources import gtf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_READS = """
SELECT l_orderkey AS qname, CAST(l_suppkey % 5 AS INT) AS tid,
       l_partkey * 40 + (l_orderkey % 40) AS pos, 20 + CAST(l_quantity AS BIGINT) AS len,
       CAST(ROUND(l_discount * 100) AS BIGINT) * 6 AS mapq,
       CASE WHEN l_linenumber % 4 = 0 THEN 2 ELSE 1 END AS nh,
       (1 + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END
          + CASE WHEN l_linenumber % 2 = 1 THEN 64 ELSE 128 END
          + CASE WHEN l_linenumber = 7 THEN 256 ELSE 0 END
          + CASE WHEN CAST(ROUND(l_tax * 100) AS BIGINT) = 8 THEN 512 ELSE 0 END
          + CASE WHEN l_linestatus = 'F' AND l_returnflag <> 'A' THEN 1024 ELSE 0 END
          + CASE WHEN CAST(ROUND(l_tax * 100) AS BIGINT) = 7 THEN 4 ELSE 0 END) AS flag,
       CASE WHEN l_linenumber % 3 = 0 THEN 60 + l_partkey % 300 ELSE 0 END AS intron,
       l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln
FROM lineitem
"""
_GENES = """
SELECT p_partkey AS gene_id, CAST(p_partkey % 5 AS INT) AS tid, p_partkey * 40 AS s,
       p_partkey * 40 + 60 + p_size * 4 AS e,
       CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, p_type AS biotype
FROM part
"""
#: What tells reads apart, as one number: the keys and the length of a line in mixed radix.
_RID = "((((qname * 262144 + pk) * 16384 + sk) * 8 + ln) * 64 + len - 20)"
_WITH = f"""
WITH r AS (SELECT *, {_RID} AS rid FROM ({_READS}) x),
     g AS ({_GENES}),
     b AS (SELECT rid, qname, ln, flag, mapq, nh, tid, pos AS s, CASE WHEN intron = 0 THEN pos + len ELSE pos + 15 END AS e FROM r
           UNION ALL
           SELECT rid, qname, ln, flag, mapq, nh, tid, pos + 15 + intron, pos + len + intron FROM r WHERE intron > 0),
     cr AS (SELECT * FROM r WHERE flag & 2564 = 0),
     bg AS (SELECT DISTINCT b.rid, g.gene_id, g.biotype, g.strand FROM b JOIN g ON b.tid = g.tid AND b.s < g.e AND g.s < b.e WHERE b.flag & 2564 = 0),
     k AS (SELECT rid, count(*) AS n, min(gene_id) AS gene_id FROM bg GROUP BY rid),
     hit AS (SELECT cr.*, coalesce(k.n, 0) AS n, k.gene_id FROM cr LEFT JOIN k ON cr.rid = k.rid)
"""


class Tables:
    """The projections as DataFrames.  rid tells reads apart by the keys themselves, of any size, in the order of the
    SQL's number, which holds orders below 2^22 and parts below 2^18."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        def read(name: str) -> DataFrame:
            return spark.read.parquet(f"{sf_dir}/{name}.parquet")

        self.spark, self.read = spark, read
        self.reads = self._sql(read("lineitem"), "lineitem", _READS).withColumn("rid", F.when(F.expr("qname + pk + sk + ln + len").isNotNull(), F.struct("qname", "pk", F.expr("(sk * 8 + ln) * 64 + len - 20").alias("line"))))
        self.genes = self._sql(read("part"), "part", _GENES).withColumn("chrom", F.col("tid"))

    def _sql(self, df: DataFrame, name: str, text: str) -> DataFrame:
        return self.spark.sql(text.replace(f"FROM {name}", "FROM {source}"), source=df)

    @property
    def blocks(self) -> DataFrame:
        r = self.reads
        first = F.struct(F.col("pos").alias("s"), (F.col("pos") + F.when(F.col("intron") == 0, F.col("len")).otherwise(15)).alias("e"))
        second = F.struct((F.col("pos") + 15 + F.col("intron")).alias("s"), (F.col("pos") + F.col("len") + F.col("intron")).alias("e"))
        both = F.explode(F.when(F.col("intron") > 0, F.array(first, second)).otherwise(F.array(first)))
        return r.select("rid", "qname", "ln", "flag", "mapq", "nh", "tid", F.col("tid").alias("chrom"), both.alias("x")).select("*", "x.*").drop("x")

    @property
    def counted(self) -> DataFrame:
        return self.reads.filter(fl.counting(False))

    @property
    def hits(self) -> DataFrame:
        return ct.sole_genes(self.blocks.filter(fl.counting(False)), self.genes, ["rid", "flag", "nh"])

    @property
    def gene_sets(self) -> DataFrame:
        return ct.gene_hits(self.blocks.filter(fl.counting(False)), self.genes, ["rid", "qname", "ln", "flag", "nh"])


def query(name: str, oracle: str | None, shared: bool = True):
    """Registers a function of Tables with its SQL; shared: the common projections stand before the SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = (_WITH + oracle) if shared else oracle
        return f

    return register


def _r(c: str | F.Column, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


# --- gene counting -------------------------------------------------------------------------------------------

_MATRIX = """, c AS (SELECT gene_id, count(*) AS am, count(*) FILTER (WHERE flag & 1024 = 0) AS fm, count(*) FILTER (WHERE nh = 1) AS au,
       count(*) FILTER (WHERE nh = 1 AND flag & 1024 = 0) AS fu FROM hit WHERE n = 1 GROUP BY gene_id),
     m AS (SELECT g.gene_id, g.e - g.s AS length, coalesce(am, 0) AS all_multi, coalesce(fm, 0) AS filt_multi, coalesce(au, 0) AS all_unique,
       coalesce(fu, 0) AS filt_unique, (SELECT count(*) FROM cr)::double AS total FROM g LEFT JOIN c ON g.gene_id = c.gene_id)
"""


def _matrix(t: Tables) -> DataFrame:
    total = t.counted.agg(F.count("*").cast("double").alias("total"))
    genes = t.genes.select("gene_id", (F.col("e") - F.col("s")).alias("length"))
    return ct.dup_matrix(ct.gene_counts(t.hits), genes, total.scalar())


@query("dup_matrix", _MATRIX + """SELECT gene_id, length, all_multi, filt_multi, all_unique, filt_unique,
  round(CASE WHEN all_multi > 0 THEN (all_multi - filt_multi) / all_multi::double END, 6) AS dup_rate_multi, all_multi - filt_multi AS dups_per_id_multi,
  round(all_multi * (1000.0::double / length), 6) AS rpk_multi, round(all_multi * (1000.0::double / length) * (1e6 / total), 6) AS rpkm_multi,
  round(CASE WHEN all_unique > 0 THEN (all_unique - filt_unique) / all_unique::double END, 6) AS dup_rate, all_unique - filt_unique AS dups_per_id,
  round(all_unique * (1000.0::double / length), 6) AS rpk, round(all_unique * (1000.0::double / length) * (1e6 / total), 6) AS rpkm FROM m""")
def dup_matrix(t: Tables) -> DataFrame:
    doubles = {c: _r(F.nanvl(c, F.lit(None).cast("double"))) for c in ("dup_rate", "dup_rate_multi")} | {c: _r(c) for c in ("rpk", "rpkm", "rpk_multi", "rpkm_multi")}
    return _matrix(t).withColumns(doubles)


@query("dup_matrix_stats", _MATRIX + """SELECT count(*) AS regions, count(*) FILTER (WHERE all_unique > 0) AS covered,
  count(*) FILTER (WHERE all_unique = 0 OR all_unique > filt_unique) AS with_duplication FROM m""")
def dup_matrix_stats(t: Tables) -> DataFrame:
    return _matrix(t).agg(F.count("*").alias("regions"), F.count_if(F.col("all_unique") > 0).alias("covered"), F.count_if((F.col("dup_rate") > 0) | F.isnan("dup_rate")).alias("with_duplication"))


@query("fragment_status", """SELECT count(*) AS fragments, count(*) FILTER (WHERE n = 1) AS assigned, count(*) FILTER (WHERE n > 1) AS ambiguous, count(*) FILTER (WHERE n = 0) AS no_features FROM hit""")
def fragment_status(t: Tables) -> DataFrame:
    n = F.col("n")
    return t.hits.agg(F.count("*").alias("fragments"), F.count_if(n == 1).alias("assigned"), F.count_if(n > 1).alias("ambiguous"), F.count_if(n == 0).alias("no_features"))


_STATUS = "CASE WHEN nh > 1 THEN 'multimapping' WHEN n = 0 THEN 'no_features' WHEN n = 1 THEN 'assigned' ELSE 'ambiguous' END"


@query("read_status", f"SELECT {_STATUS} AS status, count(*) AS reads FROM hit GROUP BY 1")
def read_status(t: Tables) -> DataFrame:
    return ct.read_status(t.hits).groupBy("status").agg(F.count("*").alias("reads"))


@query("gene_reads", f"SELECT gene_id, count(*) AS reads FROM hit WHERE {_STATUS} = 'assigned' GROUP BY 1")
def gene_reads(t: Tables) -> DataFrame:
    return ct.read_status(t.hits).filter("status = 'assigned'").groupBy("gene_id").agg(F.count("*").alias("reads"))


@query("stranded_hits", """, h AS (SELECT bg.rid, bg.gene_id FROM bg JOIN cr ON bg.rid = cr.rid
  WHERE ((cr.flag & 16 = 0) = (cr.flag & 64 <> 0)) = (bg.strand = '-')) SELECT gene_id, count(*) AS reads FROM h GROUP BY 1""")
def stranded_hits(t: Tables) -> DataFrame:
    hits = ct.gene_hits(t.blocks.filter(fl.counting(False)), t.genes, ["rid", "flag"], "reverse", True)
    return hits.select(F.explode("genes").alias("gene_id")).groupBy("gene_id").agg(F.count("*").alias("reads"))


_BIOTYPE = """, bt AS (SELECT hit.rid, count(DISTINCT bg.biotype) AS n_types, min(bg.biotype) AS biotype FROM hit LEFT JOIN bg ON hit.rid = bg.rid WHERE hit.nh = 1 GROUP BY hit.rid)
"""


@query("biotype_status", _BIOTYPE + "SELECT CASE WHEN n_types = 0 THEN 'no_features' WHEN n_types = 1 THEN 'assigned' ELSE 'ambiguous' END AS status, count(*) AS reads FROM bt GROUP BY 1")
def biotype_status(t: Tables) -> DataFrame:
    return ct.biotype_status(t.gene_sets, t.genes).groupBy("status").agg(F.count("*").alias("reads"))


def _biotype_counts(t: Tables) -> DataFrame:
    return ct.biotype_status(t.gene_sets, t.genes).filter("status = 'assigned' and size(biotypes) = 1").groupBy(F.col("biotypes")[0].alias("biotype")).agg(F.count("*").alias("reads"))


@query("biotype_counts", _BIOTYPE + "SELECT biotype, count(*) AS reads FROM bt WHERE n_types = 1 GROUP BY 1 ORDER BY 2 DESC, 1")
def biotype_counts(t: Tables) -> DataFrame:
    return _biotype_counts(t).orderBy(F.col("reads").desc(), "biotype")


@query("rrna_pct", _BIOTYPE + "SELECT round(100.0::double * count(*) FILTER (WHERE biotype LIKE '%BRASS') / count(*), 6) AS rrna_pct FROM bt WHERE n_types = 1")
def rrna_pct(t: Tables) -> DataFrame:
    return _biotype_counts(t).agg(_r(F.sum(F.when(F.col("biotype").endswith("BRASS"), F.col("reads")).otherwise(0)) / F.sum("reads") * 100).alias("rrna_pct"))


@query("dup_check", "SELECT count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 4 = 0 AND flag & 1024 <> 0) AS duplicates, count(*) FILTER (WHERE flag & 4 = 0) > 0 AND count(*) FILTER (WHERE flag & 4 = 0 AND flag & 1024 <> 0) = 0 AS fails FROM r")
def dup_check(t: Tables) -> DataFrame:
    return st.duplicate_check(t.reads)


@query("fit_intercept_slope", None)
def fit_intercept_slope(t: Tables) -> DataFrame:
    intercept, slope = ct_fit(t)
    return t.spark.createDataFrame([(intercept, slope)], "intercept double, slope double")


def ct_fit(t: Tables) -> tuple[float, float]:
    from stratalign.functions.numeric import logistic_fit

    return logistic_fit(_matrix(t).select("rpk", "dup_rate"))


@query("rpkm_threshold", _MATRIX + "SELECT round(min(all_unique * (1000.0::double / length)), 6) AS rpk FROM m WHERE all_unique * (1000.0::double / length) * (1e6 / total) >= 10.0")
def rpkm_threshold(t: Tables) -> DataFrame:
    return _matrix(t).agg(_r(F.min(F.when(F.col("rpkm") >= 10.0, F.col("rpk")))).alias("rpk"))


@query("rpk_quantile_bins", _MATRIX + """, q AS (SELECT quantile_cont(rpk, [0.2, 0.4, 0.6, 0.8]::double[]) AS cut FROM (SELECT all_unique * (1000.0::double / length) AS rpk FROM m)),
  x AS (SELECT all_unique * (1000.0::double / length) AS rpk, dups FROM (SELECT *, all_unique - filt_unique AS dups FROM m))
  SELECT CASE WHEN rpk < cut[1] THEN 0 WHEN rpk < cut[2] THEN 1 WHEN rpk < cut[3] THEN 2 WHEN rpk < cut[4] THEN 3 ELSE 4 END AS bin, count(*) AS genes, sum(dups)::bigint AS dups FROM x, q GROUP BY 1""")
def rpk_quantile_bins(t: Tables) -> DataFrame:
    matrix = _matrix(t)
    return sq.quantile_bins(matrix, "rpk", [0.2, 0.4, 0.6, 0.8]).groupBy("bin").agg(F.count("*").alias("genes"), F.sum("dups_per_id").alias("dups"))


@query("expr_hist", _MATRIX + "SELECT floor(log10(all_unique * (1000.0::double / length)) * 4)::bigint AS bin, count(*) AS genes FROM m WHERE all_unique > 0 GROUP BY 1")
def expr_hist(t: Tables) -> DataFrame:
    return _matrix(t).filter("rpk > 0").groupBy(F.floor(F.log10("rpk") * 4).alias("bin")).agg(F.count("*").alias("genes"))


@query("gene_length", """, x AS (SELECT *, max(e) OVER (PARTITION BY biotype, tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM g),
  y AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY biotype, tid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM x),
  z AS (SELECT biotype, tid, i, max(e) - min(s) AS l FROM y GROUP BY ALL) SELECT biotype, tid, sum(l)::bigint AS bases FROM z GROUP BY ALL""")
def gene_length(t: Tables) -> DataFrame:
    return iv.bases(iv.merge(t.genes, ["biotype", "tid"]), ["biotype", "tid"])


# --- counters and histograms ---------------------------------------------------------------------------------

_CLASS = "CASE WHEN flag & 512 <> 0 THEN 'qc_failed' WHEN flag & 1024 <> 0 THEN 'duplicate' WHEN flag & 256 <> 0 THEN 'non_primary' WHEN flag & 4 <> 0 THEN 'unmapped' WHEN mapq < 30 THEN 'non_unique' ELSE 'unique' END"


@query("bam_stat", f""", c AS (SELECT *, {_CLASS} AS class FROM r) SELECT count(*) AS total, count(*) FILTER (WHERE class = 'qc_failed') AS qc_failed,
  count(*) FILTER (WHERE class = 'duplicate') AS duplicates, count(*) FILTER (WHERE class = 'non_primary') AS non_primary, count(*) FILTER (WHERE class = 'unmapped') AS unmapped,
  count(*) FILTER (WHERE class = 'non_unique') AS non_unique, count(*) FILTER (WHERE class = 'unique') AS "unique", count(*) FILTER (WHERE class = 'unique' AND flag & 64 <> 0) AS read_1,
  count(*) FILTER (WHERE class = 'unique' AND flag & 128 <> 0) AS read_2, count(*) FILTER (WHERE class = 'unique' AND flag & 16 = 0) AS forward,
  count(*) FILTER (WHERE class = 'unique' AND flag & 16 <> 0) AS reverse, count(*) FILTER (WHERE class = 'unique' AND intron > 0) AS spliced, count(*) FILTER (WHERE class = 'unique' AND intron = 0) AS non_spliced FROM c""")
def bam_stat(t: Tables) -> DataFrame:
    return st.bam_stat(t.reads.withColumn("spliced", F.col("intron") > 0)).drop("proper_pairs")


@query("flagstat", """SELECT count(*) AS total, count(*) FILTER (WHERE flag & 256 <> 0) AS secondary, count(*) FILTER (WHERE flag & 2048 <> 0) AS supplementary,
  count(*) FILTER (WHERE flag & 1024 <> 0 AND flag & 512 = 0) AS duplicates, count(*) FILTER (WHERE flag & 3328 = 1024) AS primary_duplicates, count(*) FILTER (WHERE flag & 4 = 0) AS mapped, count(*) FILTER (WHERE flag & 2304 = 0) AS primary_reads,
  count(*) FILTER (WHERE flag & 2308 = 0) AS primary_mapped, count(*) FILTER (WHERE flag & 2304 = 0 AND flag & 1 <> 0) AS paired, count(*) FILTER (WHERE flag & 2304 = 0 AND flag & 65 = 65) AS read1,
  count(*) FILTER (WHERE flag & 2304 = 0 AND flag & 129 = 129) AS read2, count(*) FILTER (WHERE flag & 2304 = 0 AND flag & 3 = 3) AS properly_paired,
  count(*) FILTER (WHERE flag & 2304 = 0 AND flag & 13 = 1) AS both_mapped, count(*) FILTER (WHERE flag & 2304 = 0 AND flag & 13 = 9) AS singletons FROM r""")
def flagstat(t: Tables) -> DataFrame:
    return st.flagstat(t.reads)


@query("idxstats", """, h AS (SELECT tid, max(pos + len + intron) AS length FROM r GROUP BY tid UNION ALL SELECT 99, 1000) SELECT h.tid, h.length, count(r.rid) FILTER (WHERE flag & 4 = 0) AS mapped, count(r.rid) FILTER (WHERE flag & 4 <> 0) AS unmapped FROM h LEFT JOIN r ON h.tid = r.tid GROUP BY ALL""")
def idxstats(t: Tables) -> DataFrame:
    header = t.reads.groupBy("tid").agg(F.max(F.col("pos") + F.col("len") + F.col("intron")).alias("length"))
    header = header.unionByName(t.spark.sql("select 99 as tid, 1000L as length"))
    return st.idxstats(t.reads, header).filter("tid is not null")


@query("length_sums", """SELECT sum(len)::bigint AS total, sum(CASE WHEN flag & 128 = 0 THEN len END)::bigint AS first_total, sum(CASE WHEN flag & 128 <> 0 THEN len END)::bigint AS last_total,
  sum(CASE WHEN flag & 4 = 0 THEN len END)::bigint AS mapped, sum(CASE WHEN flag & 1024 <> 0 THEN len END)::bigint AS duplicated, max(len) AS longest,
  max(CASE WHEN flag & 128 = 0 THEN len END) AS longest_first, max(CASE WHEN flag & 128 <> 0 THEN len END) AS longest_last FROM r WHERE flag & 2304 = 0""")
def length_sums(t: Tables) -> DataFrame:
    return st.length_sums(t.reads)


@query("mapq_hist", "SELECT mapq, count(*) AS reads FROM r WHERE flag & 3844 = 0 GROUP BY 1")
def mapq_hist(t: Tables) -> DataFrame:
    return st.histogram(t.reads.filter(fl.clear(fl.SECONDARY | fl.SUPPLEMENTARY | fl.UNMAPPED | fl.QC_FAIL | fl.DUPLICATE)), "mapq")


@query("read_length_hist", "SELECT CASE WHEN flag & 128 <> 0 THEN 'last' ELSE 'first' END AS fragment, len, count(*) AS reads FROM r WHERE flag & 2304 = 0 GROUP BY ALL")
def read_length_hist(t: Tables) -> DataFrame:
    which = F.when(fl.has(fl.READ2), "last").otherwise("first").alias("fragment")
    return t.reads.filter(fl.primary()).groupBy(which, "len").agg(F.count("*").alias("reads"))


@query("gc_step_hist", """, x AS (SELECT (intron + mapq) % (len + 1) AS gc, len FROM r WHERE flag & 2304 = 0), ev AS (SELECT gc * 199 // len AS bin, 1 AS step FROM x UNION ALL SELECT (gc + 1) * 199 // len, -1 FROM x),
  s AS (SELECT bin, sum(step) AS step FROM ev GROUP BY 1), c AS (SELECT bin, sum(step) OVER (ORDER BY bin)::bigint AS reads FROM s), l AS (SELECT *, lag(reads, 1, 0) OVER (ORDER BY bin) AS prev FROM c) SELECT bin, reads FROM l WHERE reads <> prev""")
def gc_step_hist(t: Tables) -> DataFrame:
    gc = (F.col("intron") + F.col("mapq")) % (F.col("len") + 1)
    return sq.changes(sq.step_histogram(t.reads.filter(fl.primary()).select(gc.alias("gc"), "len"), "gc", "len", 199), "bin", "reads")


@query("base_composition", """, d AS (SELECT lower(text) AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT unnest(range(1, length(t) + 1)) AS cycle, t FROM d)
  SELECT cycle, CASE WHEN substr(t, cycle::int, 1) IN ('a', 'c', 'g', 't') THEN substr(t, cycle::int, 1) ELSE 'n' END AS base, count(*) AS n FROM c GROUP BY ALL""")
def base_composition(t: Tables) -> DataFrame:
    sequences = t.read("documents").filter("text is not null").select(F.lower("text").alias("seq"))
    return st.base_composition(sequences)


@query("quality_by_cycle", """, d AS (SELECT text AS t FROM documents WHERE text IS NOT NULL), c AS (SELECT unnest(range(1, length(t) + 1)) AS cycle, t FROM d)
  SELECT cycle, least(unicode(substr(t, cycle::int, 1)) - 33, 63)::int AS quality, count(*) AS n FROM c WHERE unicode(substr(t, cycle::int, 1)) >= 33 GROUP BY ALL""")
def quality_by_cycle(t: Tables) -> DataFrame:
    return st.quality_by_cycle(t.read("documents").filter("text is not null").select(F.col("text").alias("qual")))


@query("seq_dup_hist", "SELECT times, count(*) AS sequences FROM (SELECT text, count(*) AS times FROM documents GROUP BY text) GROUP BY times", shared=False)
def seq_dup_hist(t: Tables) -> DataFrame:
    return sq.count_of_counts(t.read("documents"), ["text"], "sequences")


@query("pos_dup_hist", "SELECT times, count(*) AS positions FROM (SELECT tid, pos, len, intron, count(*) AS times FROM r WHERE flag & 516 = 0 AND mapq >= 30 GROUP BY ALL) GROUP BY times")
def pos_dup_hist(t: Tables) -> DataFrame:
    return sq.count_of_counts(t.reads.filter(fl.duplication_reads(30)), ["tid", "pos", "len", "intron"], "positions")


@query("indel_hist", "SELECT kind, len, count(*) AS n FROM (SELECT CASE WHEN ln % 2 = 0 THEN 'I' ELSE 'D' END AS kind, 1 + pk % 7 AS len FROM r WHERE flag & 260 = 0) GROUP BY ALL")
def indel_hist(t: Tables) -> DataFrame:
    ops = F.array(F.struct((1 + F.col("pk") % 7).alias("len"), F.when(F.col("ln") % 2 == 0, "I").otherwise("D").alias("op")))
    return st.indel_histogram(t.reads.filter(fl.clear(fl.UNMAPPED | fl.SECONDARY)).withColumn("ops", ops))


@query("insert_size_hist", """, p AS (SELECT qname, min(pos) AS a, max(pos + len) AS z, min(CASE WHEN flag & 16 = 0 THEN pos END) AS f, min(CASE WHEN flag & 16 <> 0 THEN pos END) AS v FROM r WHERE flag & 2308 = 0 GROUP BY qname, (ln + 1) // 2, tid HAVING count(*) = 2)
  SELECT least(z - a, 8000) AS size, count(*) AS total, count(*) FILTER (WHERE f < v) AS inward, count(*) FILTER (WHERE f > v) AS outward, count(*) FILTER (WHERE f IS NULL OR v IS NULL OR f = v) AS other FROM p GROUP BY 1""")
def insert_size_hist(t: Tables) -> DataFrame:
    kept = t.reads.filter(fl.primary() & fl.clear(fl.UNMAPPED)).withColumn("pair", F.expr("(ln + 1) div 2"))
    return pr.insert_sizes(kept, ["qname", "pair", "tid"])


@query("insert_size_bulk", """, h AS (SELECT len, count(*) AS n FROM r WHERE flag & 2304 = 0 GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY len) / sum(n) OVER ()::double AS upto FROM h), l AS (SELECT *, lag(upto, 1, 0.0) OVER (ORDER BY len) AS prev FROM c)
  SELECT len, n FROM l WHERE prev <= 0.9""")
def insert_size_bulk(t: Tables) -> DataFrame:
    return sq.main_bulk(t.reads.filter(fl.primary()).groupBy("len").agg(F.count("*").alias("n")), "len", "n", 0.9)


# --- intervals -----------------------------------------------------------------------------------------------

_ISLANDS = """, i1 AS (SELECT *, max(e) OVER (PARTITION BY tid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM g),
  i2 AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM i1),
  isl AS (SELECT tid, min(s) AS s, max(e) AS e FROM i2 GROUP BY tid, i)
"""


def _islands(t: Tables) -> DataFrame:
    return iv.merge(t.genes, ["tid"])


@query("region_merge", _ISLANDS + "SELECT tid, s, e FROM isl")
def region_merge(t: Tables) -> DataFrame:
    return _islands(t)


@query("region_bases", _ISLANDS + "SELECT tid, sum(e - s)::bigint AS bases FROM isl GROUP BY tid")
def region_bases(t: Tables) -> DataFrame:
    return iv.bases(_islands(t), ["tid"])


@query("region_subtract", """, ev AS (SELECT tid, s AS ap, 1 AS a, 0 AS x FROM g WHERE strand = '+' UNION ALL SELECT tid, e, -1, 0 FROM g WHERE strand = '+' UNION ALL SELECT tid, s, 0, 1 FROM g WHERE strand = '-' UNION ALL SELECT tid, e, 0, -1 FROM g WHERE strand = '-'),
  s1 AS (SELECT tid, ap, sum(a) AS a, sum(x) AS x FROM ev GROUP BY ALL), s2 AS (SELECT tid, ap AS s, lead(ap) OVER w AS e, sum(a) OVER w AS a, sum(x) OVER w AS x FROM s1 WINDOW w AS (PARTITION BY tid ORDER BY ap)),
  s3 AS (SELECT tid, s, e, CASE WHEN lag(e) OVER (PARTITION BY tid ORDER BY s) = s THEN 0 ELSE 1 END AS fresh FROM s2 WHERE a > 0 AND x = 0), s4 AS (SELECT *, sum(fresh) OVER (PARTITION BY tid ORDER BY s) AS i FROM s3) SELECT tid, min(s) AS s, max(e) AS e FROM s4 GROUP BY tid, i""")
def region_subtract(t: Tables) -> DataFrame:
    return iv.subtract(t.genes.filter("strand = '+'"), t.genes.filter("strand = '-'"), ["tid"])


@query("coverage_hist", """, ev AS (SELECT tid, s AS ap, 1 AS d FROM b WHERE flag & 260 = 0 UNION ALL SELECT tid, e, -1 FROM b WHERE flag & 260 = 0), s1 AS (SELECT tid, ap, sum(d) AS d FROM ev GROUP BY ALL),
  s2 AS (SELECT tid, ap, lead(ap) OVER w AS nx, sum(d) OVER w AS depth FROM s1 WINDOW w AS (PARTITION BY tid ORDER BY ap)) SELECT depth::bigint AS depth, sum(nx - ap)::bigint AS positions FROM s2 WHERE depth > 0 AND nx IS NOT NULL GROUP BY 1""")
def coverage_hist(t: Tables) -> DataFrame:
    return iv.depth_histogram(t.blocks.filter(fl.clear(fl.UNMAPPED | fl.SECONDARY)), ["tid"], tile=10_000)


@query("read_distribution", """, m AS (SELECT rid, tid, s + (e - s) // 2 AS p FROM b WHERE flag & 1796 = 0), h AS (SELECT DISTINCT m.rid, m.p, g.strand FROM m JOIN g ON m.tid = g.tid AND g.s < m.p AND m.p < g.e),
  f AS (SELECT m.rid, m.p, max(h.strand = '+')::int AS plus, max(h.strand = '-')::int AS minus FROM m LEFT JOIN h ON m.rid = h.rid AND m.p = h.p GROUP BY ALL)
  SELECT CASE WHEN plus = 1 THEN 'plus' WHEN minus = 1 THEN 'minus' ELSE 'intergenic' END AS region, count(*) AS tags FROM f GROUP BY 1""")
def read_distribution(t: Tables) -> DataFrame:
    tags = t.blocks.filter(fl.usable()).select("rid", "tid", F.expr("s + (e - s) div 2").alias("p"))
    regions = t.genes.select(F.when(F.col("strand") == "+", "plus").otherwise("minus").alias("region"), "tid", "s", "e")
    return cv.region_tags(tags, regions, ["plus", "minus"], ["tid"], "intergenic", ["rid", "p"])


@query("strandedness", """, u AS (SELECT * FROM r WHERE flag & 1796 = 0 AND mapq >= 30), j AS (SELECT u.rid, u.flag, string_agg(DISTINCT g.strand, ':' ORDER BY g.strand) AS strands FROM u JOIN g ON u.tid = g.tid AND g.s < u.pos + u.len + u.intron AND g.e > u.pos GROUP BY ALL)
  SELECT (CASE WHEN flag & 64 <> 0 THEN '1' ELSE '2' END) || (CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END) || strands AS key, count(*) AS reads FROM j GROUP BY 1""")
def strandedness(t: Tables) -> DataFrame:
    spans = t.reads.filter(fl.usable(30)).select("rid", "flag", "tid", F.col("pos").alias("s"), (F.col("pos") + F.col("len") + F.col("intron")).alias("e"))
    return cv.strand_classes(spans, t.genes, ["tid"])


@query("gene_enclosure", """, x AS (SELECT b.rid, g.gene_id, count(DISTINCT b.s) FILTER (WHERE g.s <= b.s AND b.e <= g.e) AS inside FROM b JOIN g ON b.tid = g.tid AND b.s < g.e AND g.s < b.e WHERE b.flag & 2820 = 0 AND b.nh = 1 GROUP BY ALL),
  n AS (SELECT rid, count(*) AS blocks FROM b GROUP BY rid) SELECT x.gene_id, count(*) AS reads FROM x JOIN n ON x.rid = n.rid WHERE x.inside = n.blocks GROUP BY 1""")
def gene_enclosure(t: Tables) -> DataFrame:
    return cv.enclosing_genes(t.blocks.filter(fl.gene_body_reads()), t.genes, ["tid"]).groupBy("gene_id").agg(F.count("*").alias("reads"))


@query("read_origin", """, u AS (SELECT DISTINCT rid FROM b WHERE flag & 2820 = 0 AND nh = 1), x AS (SELECT b.rid, b.s, max(CASE WHEN g.s <= b.s AND b.e <= g.e THEN 1 ELSE 0 END) AS inside FROM b JOIN g ON b.tid = g.tid AND b.s < g.e AND g.s < b.e GROUP BY ALL),
  y AS (SELECT u.rid, coalesce(min(x.inside), -1) AS inside FROM u LEFT JOIN x ON u.rid = x.rid GROUP BY u.rid) SELECT CASE inside WHEN 1 THEN 'exonic' WHEN 0 THEN 'overlapping' ELSE 'intergenic' END AS origin, count(*) AS reads FROM y GROUP BY 1""")
def read_origin(t: Tables) -> DataFrame:
    return cv.read_origin(t.blocks.filter(fl.gene_body_reads()), t.genes, ["tid"])


@query("ssp_votes", """SELECT count(*) FILTER (WHERE (flag & 16 = 0) = (g.strand = '+')) AS same, count(*) FILTER (WHERE (flag & 16 = 0) <> (g.strand = '+')) AS opposite FROM b JOIN g ON b.tid = g.tid AND g.s <= b.s AND b.e <= g.e WHERE b.flag & 2820 = 0 AND b.nh = 1""")
def ssp_votes(t: Tables) -> DataFrame:
    met = iv.containment_join(t.blocks.filter(fl.gene_body_reads()), t.genes.select("tid", "s", "e", "strand"), ["tid"]).filter("enclosed")
    same = fl.clear(fl.REVERSE) == (F.col("r_strand") == "+")
    return met.agg(F.count_if(same).alias("same"), F.count_if(~same).alias("opposite"))


@query("intron_touch", """, i AS (SELECT tid, s + 10 AS s, s + 40 AS e FROM g) SELECT count(*) AS reads FROM (SELECT DISTINCT b.rid FROM b WHERE flag & 2820 = 0 AND EXISTS (SELECT 1 FROM i WHERE i.tid = b.tid AND i.s <= b.e AND i.e >= b.s))""")
def intron_touch(t: Tables) -> DataFrame:
    introns = t.genes.select("tid", (F.col("s") + 10).alias("s"), (F.col("s") + 40).alias("e"))
    met = iv.overlap_join(t.blocks.filter(fl.clear(2820)), introns, ["tid"], closed=True, how="left_semi", row=["rid", "s"])
    return met.agg(F.count_distinct("rid").alias("reads"))


# --- junctions -----------------------------------------------------------------------------------------------

_JUNCTIONS = """, j AS (SELECT rid, qname, pk, sk, ln, tid, pos + 15 AS s, pos + 15 + intron AS e FROM r WHERE intron >= 50 AND flag & 1796 = 0 AND mapq >= 30),
  kn AS (SELECT DISTINCT tid, e AS p FROM g), jc AS (SELECT tid, s, e, count(*) AS reads, (EXISTS (SELECT 1 FROM kn WHERE kn.tid = j.tid AND kn.p = j.s))::int AS ks, (EXISTS (SELECT 1 FROM g WHERE g.tid = j.tid AND g.s = j.e))::int AS ke FROM j GROUP BY ALL),
  jk AS (SELECT *, CASE ks + ke WHEN 2 THEN 'annotated' WHEN 1 THEN 'partial_novel' ELSE 'complete_novel' END AS class FROM jc)
"""


def _junctions(t: Tables) -> DataFrame:
    events = t.reads.filter(fl.usable(30) & (F.col("intron") >= 50)).select("rid", "qname", "pk", "sk", "ln", "tid", (F.col("pos") + 15).alias("s"), (F.col("pos") + 15 + F.col("intron")).alias("e"))
    return events


@query("junctions", _JUNCTIONS + "SELECT tid, s, e, reads FROM jk")
def junctions(t: Tables) -> DataFrame:
    return _junctions(t).groupBy("tid", "s", "e").agg(F.count("*").alias("reads"))


def _classified(t: Tables) -> DataFrame:
    return cv.classify_junctions(junctions(t), t.genes.select("tid", F.col("e").alias("s")), t.genes.select("tid", F.col("s").alias("e")), ["tid"])


@query("junction_class", _JUNCTIONS + "SELECT tid, s, e, class FROM jk")
def junction_class(t: Tables) -> DataFrame:
    return _classified(t).select("tid", "s", "e", "class")


@query("junction_classes_total", _JUNCTIONS + "SELECT class, count(*) AS junctions, sum(reads)::bigint AS events FROM jk GROUP BY 1")
def junction_classes_total(t: Tables) -> DataFrame:
    return _classified(t).groupBy("class").agg(F.count("*").alias("junctions"), F.sum("reads").alias("events"))


@query("junction_saturation", _JUNCTIONS + """, o AS (SELECT tid, s, e, row_number() OVER (ORDER BY (qname * 7919 + ln * 104729 + pk) % 1000003, rid) AS rn, count(*) OVER () AS total FROM j), f AS (SELECT tid, s, e, min(rn) AS first, any_value(total) AS total FROM o GROUP BY ALL)
  SELECT p.pct::int AS pct, count(*) FILTER (WHERE first <= total * pct // 100) AS junctions FROM f, (SELECT unnest([5, 25, 50, 75, 100]) AS pct) p GROUP BY 1""")
def junction_saturation(t: Tables) -> DataFrame:
    order = ((F.col("qname") * 7919 + F.col("ln") * 104729 + F.col("pk")) % 1000003, F.col("rid"))
    return sq.saturation(_junctions(t), ["tid", "s", "e"], order, [5, 25, 50, 75, 100], "junctions")


@query("junction_tolerance", _JUNCTIONS + "SELECT count(*) AS junctions, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM kn WHERE kn.tid = jk.tid AND kn.p BETWEEN jk.s - 1 AND jk.s + 1)) AS near FROM jk")
def junction_tolerance(t: Tables) -> DataFrame:
    near = iv.tolerance_flag(junctions(t), t.genes.select("tid", F.col("e").alias("s")), ["tid"], "s", 1, "near")
    return near.agg(F.count("*").alias("junctions"), F.count_if("near").alias("near"))


@query("junction_motifs", _JUNCTIONS + "SELECT motif, events FROM (SELECT (s % 4) * 4 + e % 4 AS motif, count(*) AS events FROM j GROUP BY 1) ORDER BY events DESC, motif LIMIT 11")
def junction_motifs(t: Tables) -> DataFrame:
    return sq.top(_junctions(t).groupBy(((F.col("s") % 4) * 4 + F.col("e") % 4).alias("motif")).agg(F.count("*").alias("events")), "events", ["motif"], 11)


# --- pairs ---------------------------------------------------------------------------------------------------

_MATES = """, p AS (SELECT qname, (ln + 1) // 2 AS pair, count(*) FILTER (WHERE flag & 64 <> 0) AS n1, count(*) FILTER (WHERE flag & 64 = 0) AS n2 FROM cr GROUP BY ALL)
"""


def _paired(t: Tables) -> DataFrame:
    return pr.mates(t.counted.withColumn("pair", F.expr("(ln + 1) div 2")), ["qname", "pair"])


@query("fragment_pairs", _MATES + "SELECT count(*) FILTER (WHERE n1 > 0 AND n2 > 0) AS pairs, count(*) FILTER (WHERE n1 = 0 OR n2 = 0) AS singletons FROM p")
def fragment_pairs(t: Tables) -> DataFrame:
    return _paired(t).agg(F.count_if("matched").alias("pairs"), F.count_if(~F.col("matched")).alias("singletons"))


@query("unmatched_mates", _MATES + "SELECT qname, pair FROM p WHERE n1 = 0 OR n2 = 0")
def unmatched_mates(t: Tables) -> DataFrame:
    return _paired(t).filter("not matched").select("qname", "pair")


@query("mate_pair_inner", _MATES + "SELECT qname, pair FROM p WHERE n1 > 0 AND n2 > 0")
def mate_pair_inner(t: Tables) -> DataFrame:
    return _paired(t).filter("matched").select("qname", "pair")


@query("pair_gene_vote", """, m AS (SELECT qname, (ln + 1) // 2 AS pair, flag & 64 <> 0 AS first, bg.gene_id FROM cr JOIN bg ON cr.rid = bg.rid), v AS (SELECT qname, pair, gene_id, max(first)::int + max(NOT first)::int AS score FROM m GROUP BY ALL),
  w AS (SELECT *, max(score) OVER (PARTITION BY qname, pair) AS best FROM v) SELECT qname, pair, count(*) AS genes, min(gene_id) AS least FROM w WHERE score = best GROUP BY ALL""")
def pair_gene_vote(t: Tables) -> DataFrame:
    hits = t.gene_sets.withColumn("pair", F.expr("(ln + 1) div 2"))
    sides = hits.groupBy("qname", "pair").agg(*[F.array_distinct(F.flatten(F.collect_list(F.when(side, F.col("genes"))))).alias(n) for n, side in (("one", fl.has(fl.READ1)), ("two", fl.clear(fl.READ1)))])
    voted = sides.withColumn("genes", ct.vote("one", "two")).filter("size(genes) > 0")
    return voted.select("qname", "pair", F.size("genes").cast("long").alias("genes"), F.array_min("genes").alias("least"))


@query("fragment_freq_of_freq", """, f AS (SELECT qname, tid, min(pos) AS a, max(pos + len + intron) AS z FROM r WHERE flag & 2304 = 0 GROUP BY qname, (ln + 1) // 2, tid), c AS (SELECT tid, a // 50 AS a, z // 50 AS z, count(*) AS j FROM f GROUP BY ALL) SELECT j, count(*) AS n_j FROM c GROUP BY 1""")
def fragment_freq_of_freq(t: Tables) -> DataFrame:
    return complexity.frequency_of_frequencies(_fragments(t), ["tid", "a", "z"])


def _fragments(t: Tables) -> DataFrame:
    kept = t.reads.filter(fl.complexity_reads()).withColumn("pair", F.expr("(ln + 1) div 2"))
    spans = kept.groupBy("qname", "pair", "tid").agg(F.min("pos").alias("a"), F.max(F.col("pos") + F.col("len") + F.col("intron")).alias("z"))
    return spans.select("tid", F.expr("a div 50").alias("a"), F.expr("z div 50").alias("z"))


@query("good_toulmin_2x", """, f AS (SELECT qname, tid, min(pos) AS a, max(pos + len + intron) AS z FROM r WHERE flag & 2304 = 0 GROUP BY qname, (ln + 1) // 2, tid), c AS (SELECT count(*) AS j FROM f GROUP BY tid, a // 50, z // 50), h AS (SELECT j, count(*) AS n FROM c GROUP BY 1)
  SELECT sum(n)::bigint AS "distinct", sum(j * n)::bigint AS total, sum(CASE WHEN j % 2 = 1 THEN n ELSE -n END)::bigint AS gain FROM h""")
def good_toulmin_2x(t: Tables) -> DataFrame:
    return complexity.good_toulmin(fragment_freq_of_freq(t))


@query("lc_extrap", None)
def lc_extrap(t: Tables) -> DataFrame:
    curve = complexity.estimate([(r["j"], r["n_j"]) for r in fragment_freq_of_freq(t).collect()], step=20_000, maximum=400_000, bootstraps=20)
    return t.spark.createDataFrame([tuple(map(float, x)) for x in curve], "total double, expected double, lower double, upper double")


_INNER = """, pq AS (SELECT qname * 4 + (ln + 1) // 2 - 1 AS mates, min(rid) AS id1, max(rid) AS id2 FROM r WHERE flag & 2308 = 0 GROUP BY 1 HAVING count(*) = 2 AND count(DISTINCT ln) = 2),
  d0 AS (SELECT pq.mates, x.tid AS t1, y.tid AS t2, least(x.pos + x.len + x.intron, y.pos + y.len + y.intron) AS a, greatest(x.pos, y.pos) AS z FROM pq JOIN r x ON x.rid = pq.id1 JOIN r y ON y.rid = pq.id2),
  d1 AS (SELECT *, CASE WHEN t1 = t2 THEN z - a END AS dist FROM d0)
"""


def _inner(t: Tables) -> DataFrame:
    """Lines 1 and 2, 3 and 4, 5 and 6 of an order are mates."""
    kept = t.reads.filter(fl.primary() & fl.clear(fl.UNMAPPED)).withColumn("end", F.col("pos") + F.col("len") + F.col("intron"))
    return pr.inner_distances(kept.withColumn("mates", F.expr("qname * 4 + (ln + 1) div 2 - 1")), "mates")


@query("inner_distance", _INNER + _ISLANDS + """, q AS (SELECT mates, t1 AS tid, a AS s, z AS e FROM d1 WHERE dist > 0), x AS (SELECT q.mates, sum(least(q.e, isl.e) - greatest(q.s, isl.s))::bigint AS bases FROM q JOIN isl ON q.tid = isl.tid AND q.s < isl.e AND isl.s < q.e GROUP BY 1) SELECT q.mates, q.e - q.s AS dist, coalesce(bases, 0) AS exonic FROM q LEFT JOIN x ON q.mates = x.mates""")
def inner_distance(t: Tables) -> DataFrame:
    gaps = _inner(t).filter("dist > 0").select("mates", "tid", F.col("a").alias("s"), F.col("z").alias("e"), "dist")
    return gaps.join(iv.bases_within(gaps, _islands(t), ["tid"], "mates"), "mates", "left").select("mates", "dist", F.coalesce("bases", F.lit(0)).alias("exonic"))


@query("inner_distance_class", _INNER + "SELECT CASE WHEN dist IS NULL THEN 'sameChrom=No' WHEN dist > 0 THEN 'apart' ELSE 'readPairOverlap' END AS class, count(*) AS pairs FROM d1 GROUP BY 1")
def inner_distance_class(t: Tables) -> DataFrame:
    return _inner(t).groupBy(F.when(F.col("dist").isNull(), "sameChrom=No").when(F.col("dist") > 0, "apart").otherwise("readPairOverlap").alias("class")).agg(F.count("*").alias("pairs"))


@query("inner_distance_hist", _INNER + """, bins AS (SELECT unnest(range(-20000, 20000, 2500)) AS lo) SELECT lo, count(d1.mates) AS pairs FROM bins LEFT JOIN d1 ON dist > lo AND dist <= lo + 2500 GROUP BY 1""")
def inner_distance_hist(t: Tables) -> DataFrame:
    return pr.distance_histogram(_inner(t), -20000, 20000, 2500)


@query("inner_distance_mean", _INNER + "SELECT round(avg(dist::double), 6) AS mean, median(dist::double) AS median, round(stddev_samp(dist::double), 6) AS sd FROM d1 WHERE dist IS NOT NULL")
def inner_distance_mean(t: Tables) -> DataFrame:
    d = F.col("dist").cast("double")
    return _inner(t).agg(_r(F.avg(d)).alias("mean"), F.median(d).alias("median"), _r(F.stddev_samp(d)).alias("sd"))


@query("pair_cap", _INNER + "SELECT mates, dist FROM d1 ORDER BY mates LIMIT 100")
def pair_cap(t: Tables) -> DataFrame:
    """The sampling operator: the first pairs in scan order."""
    return _inner(t).select("mates", "dist").orderBy("mates").limit(100)


# --- coverage by transcript ----------------------------------------------------------------------------------

_TIN = """, gp AS (SELECT gene_id, tid, slot, s + slot * 10 AS p FROM g, (SELECT unnest(range(0, 30)) AS slot) x WHERE s + slot * 10 < e),
  cv AS (SELECT gp.gene_id, gp.slot, count(b.rid) AS depth FROM gp LEFT JOIN b ON gp.tid = b.tid AND b.s <= gp.p AND gp.p < b.e AND b.flag & 1796 = 0 GROUP BY ALL),
  ti AS (SELECT gene_id, count(*) AS slots, sum(depth) AS total, sum(CASE WHEN depth > 0 THEN depth * ln(depth::double) ELSE 0 END) AS ent FROM cv GROUP BY 1),
  ts AS (SELECT gene_id, CASE WHEN total > 0 THEN 100 * exp(ln(total::double) - ent / total) / slots ELSE 0.0::double END AS tin FROM ti)
"""


def _grid(t: Tables) -> DataFrame:
    return cv.sampling_grid(t.genes.select("gene_id", "tid", "s", "e"), 10, 30)


def _slots(t: Tables) -> DataFrame:
    return cv.slot_depth(_grid(t), t.blocks.filter(fl.usable()).select("tid", "s", "e"), ["tid"], "gene_id")


@query("tin_positions", _TIN + "SELECT gene_id, slot::int AS slot, p FROM gp")
def tin_positions(t: Tables) -> DataFrame:
    return _grid(t).select("gene_id", "slot", "p")


@query("tin_coverage", _TIN + "SELECT gene_id, slot::int AS slot, depth FROM cv")
def tin_coverage(t: Tables) -> DataFrame:
    return _slots(t)


@query("tin_score", _TIN + "SELECT gene_id, round(tin, 6) AS tin FROM ts")
def tin_score(t: Tables) -> DataFrame:
    return cv.integrity(_slots(t), "gene_id").withColumn("tin", _r("tin"))


@query("tin_summary", _TIN + "SELECT round(avg(tin), 6) AS mean, round(median(tin), 6) AS median, round(stddev_pop(tin), 6) AS sd FROM ts WHERE tin > 0")
def tin_summary(t: Tables) -> DataFrame:
    return cv.integrity(_slots(t), "gene_id").filter("tin > 0").agg(_r(F.avg("tin")).alias("mean"), _r(F.median("tin")).alias("median"), _r(F.stddev_pop("tin")).alias("sd"))


_DEPTH = """, seg AS (SELECT g.gene_id, greatest(b.s, g.s) - g.s AS s, least(b.e, g.e) - g.s AS e FROM b JOIN g ON b.tid = g.tid AND b.s < g.e AND g.s < b.e WHERE b.flag & 1796 = 0),
  ev AS (SELECT gene_id, s AS ap, 1 AS d FROM seg UNION ALL SELECT gene_id, e, -1 FROM seg), e1 AS (SELECT gene_id, ap, sum(d) AS d FROM ev GROUP BY ALL),
  td AS (SELECT gene_id, ap AS s, lead(ap) OVER w AS e, sum(d) OVER w AS depth FROM e1 WINDOW w AS (PARTITION BY gene_id ORDER BY ap)),
  tx AS (SELECT gene_id, s, e, depth FROM td WHERE depth > 0 AND e IS NOT NULL),
  mc AS (SELECT g.gene_id, g.e - g.s AS length, coalesce(sum(depth * (tx.e - tx.s)), 0)::double / (g.e - g.s) AS mean FROM g LEFT JOIN tx ON g.gene_id = tx.gene_id GROUP BY g.gene_id, g.e, g.s)
"""


def _tx_depth(t: Tables) -> DataFrame:
    return cv.transcript_depth(t.blocks.filter(fl.usable()).select("tid", "s", "e"), t.genes.select("gene_id", "tid", "s", "e"), ["tid"], "gene_id")


def _means(t: Tables) -> DataFrame:
    return cv.mean_coverage(_tx_depth(t), t.genes.select("gene_id", (F.col("e") - F.col("s")).alias("length")), "gene_id")


@query("tx_depth", _DEPTH + "SELECT gene_id, s, e, depth::bigint AS depth FROM tx")
def tx_depth(t: Tables) -> DataFrame:
    return _tx_depth(t)


@query("mean_cov_hist", _DEPTH + "SELECT least(floor(mean), 50)::bigint AS bin, count(*) AS transcripts FROM mc GROUP BY 1")
def mean_cov_hist(t: Tables) -> DataFrame:
    return _means(t).groupBy(F.least(F.floor("mean"), F.lit(50)).cast("long").alias("bin")).agg(F.count("*").alias("transcripts"))


@query("coverage_profile", _DEPTH + """, pos AS (SELECT tx.gene_id, unnest(range(tx.s, tx.e)) AS o, depth FROM tx) SELECT (o // ((length + 99) // 100))::bigint AS bin, sum(depth)::bigint AS depth FROM pos JOIN mc ON pos.gene_id = mc.gene_id GROUP BY 1""")
def coverage_profile(t: Tables) -> DataFrame:
    return cv.coverage_profile(_tx_depth(t), _means(t), "gene_id")


@query("prime_bias", _DEPTH + """, pos AS (SELECT tx.gene_id, unnest(range(tx.s, tx.e)) AS o, depth FROM tx), top AS (SELECT * FROM mc WHERE mean >= 1 ORDER BY mean DESC, gene_id LIMIT 200),
  bi AS (SELECT top.gene_id, coalesce(sum(CASE WHEN o < 30 THEN depth END), 0)::double / 30 / any_value(mean) AS five, coalesce(sum(CASE WHEN o >= length - 30 THEN depth END), 0)::double / 30 / any_value(mean) AS three FROM top JOIN pos ON top.gene_id = pos.gene_id GROUP BY 1)
  SELECT round(median(five), 6) AS five_prime, round(median(three), 6) AS three_prime FROM bi""")
def prime_bias(t: Tables) -> DataFrame:
    top = sq.top(_means(t).filter("mean >= 1"), "mean", ["gene_id"], 200)
    return cv.prime_bias(_tx_depth(t), top, "gene_id", 30).agg(_r(F.median("five")).alias("five_prime"), _r(F.median("three")).alias("three_prime"))


@query("high_low_tiers", _DEPTH + """, u AS (SELECT mean, min(gene_id) AS gene_id FROM mc WHERE mean > 0 GROUP BY mean), o AS (SELECT *, row_number() OVER (ORDER BY mean) AS up, row_number() OVER (ORDER BY mean DESC) AS down FROM u)
  SELECT gene_id, up <= 50 AS low, down <= 50 AS high FROM o WHERE up <= 50 OR down <= 50""")
def high_low_tiers(t: Tables) -> DataFrame:
    return sq.tiers(_means(t).filter("mean > 0"), "mean", "gene_id", 50)


@query("best_transcript", _DEPTH + "SELECT tid, arg_max(gene_id, (mean, gene_id)) AS gene_id FROM (SELECT mc.*, g.tid FROM mc JOIN g ON mc.gene_id = g.gene_id) WHERE length >= 100 GROUP BY tid")
def best_transcript(t: Tables) -> DataFrame:
    means = _means(t).join(t.genes.select("gene_id", "tid"), "gene_id").filter("length >= 100")
    return sq.best_per_group(means, ["tid"], ["mean", "gene_id"], "gene_id")


@query("annotation_introns", "SELECT biotype, tid, pe AS s, s AS e FROM (SELECT *, lag(e) OVER (PARTITION BY biotype, tid ORDER BY s, e) AS pe FROM g) WHERE pe < s")
def annotation_introns(t: Tables) -> DataFrame:
    return cv.introns(t.genes, ["biotype", "tid"])


@query("thick_range", """SELECT biotype, arg_max(s, (gene_id)) AS start, arg_max(e, (gene_id)) AS stop FROM g WHERE strand = '+' GROUP BY 1""")
def thick_range(t: Tables) -> DataFrame:
    return sq.last_by(t.genes.filter("strand = '+'"), ["biotype"], "gene_id", {"start": "s", "stop": "e"})


@query("chrom_mapping", "SELECT coalesce(m.name, 'chr' || r.tid) AS chrom, count(*) AS reads FROM r LEFT JOIN (VALUES (0, 'one'), (1, 'two')) m(tid, name) ON r.tid = m.tid GROUP BY 1")
def chrom_mapping(t: Tables) -> DataFrame:
    return st.map_names(t.reads, {"0": "one", "1": "two"}, "chr", "tid").groupBy("chrom").agg(F.count("*").alias("reads"))


# --- filters, CIGAR walks and report parts -------------------------------------------------------------------

# Mate flags for the predicates that need them: the mate of a read on reference 3 is not mapped.
_FLAGGED = """, fr AS (SELECT *, flag | (CASE WHEN tid = 3 THEN 8 ELSE 0 END) AS fl, CASE WHEN pk % 2 = 0 THEN '+' WHEN pk % 3 = 0 THEN '-' ELSE '.' END AS gs FROM r)
"""


def _flagged(t: Tables) -> DataFrame:
    strand = F.when(F.col("pk") % 2 == 0, "+").when(F.col("pk") % 3 == 0, "-").otherwise(".")
    return t.reads.withColumns({"flag": F.col("flag").bitwiseOR(F.when(F.col("tid") == 3, fl.MATE_UNMAPPED).otherwise(0)), "gs": strand})


@query("read_filters", _FLAGGED + """SELECT count(*) FILTER (WHERE fl & 2564 = 0) AS counting, count(*) FILTER (WHERE fl & 2564 = 0 AND fl & 1 = 1) AS counting_paired, count(*) FILTER (WHERE fl & 2304 = 0) AS primary_reads,
  count(*) FILTER (WHERE fl & 1796 = 0) AS usable, count(*) FILTER (WHERE fl & 1796 = 0 AND mapq >= 30) AS usable_unique, count(*) FILTER (WHERE fl & 516 = 0 AND mapq >= 30) AS duplication,
  count(*) FILTER (WHERE fl & 1804 = 0 AND fl & 1 = 1 AND mapq >= 30) AS inner_distance, count(*) FILTER (WHERE fl & 772 = 0) AS integrity, count(*) FILTER (WHERE fl & 2304 = 0 AND tid >= 0) AS complexity,
  count(*) FILTER (WHERE fl & 2820 = 0 AND nh <= 1) AS gene_body, count(*) FILTER (WHERE nh > 1) AS multi FROM fr""")
def read_filters(t: Tables) -> DataFrame:
    each = {"counting": fl.counting(False), "counting_paired": fl.counting(True), "primary_reads": fl.primary(), "usable": fl.usable(), "usable_unique": fl.usable(30), "duplication": fl.duplication_reads(30), "inner_distance": fl.inner_distance_reads(30), "integrity": fl.integrity_reads(), "complexity": fl.complexity_reads(), "gene_body": fl.gene_body_reads(), "multi": fl.is_multi()}
    return _flagged(t).agg(*[F.count_if(c).alias(n) for n, c in each.items()])


@query("strand_rules", _FLAGGED + """, w AS (SELECT gs, (fl & 16 = 0) = (fl & 64 <> 0) AS fragment_plus, (fl & 16 = 0) = (fl & 1 = 0 OR fl & 64 <> 0) AS body_plus, (fl & 16 = 0) AS read_plus FROM fr)
  SELECT gs, count(*) FILTER (WHERE gs = '.' OR (gs = '+') = fragment_plus) AS forward_paired, count(*) FILTER (WHERE gs = '.' OR (gs = '+') <> fragment_plus) AS reverse_paired, count(*) FILTER (WHERE gs = '.' OR (gs = '+') = read_plus) AS forward_single,
  count(*) FILTER (WHERE gs <> '.' AND (gs = '+') = body_plus) AS body_forward, count(*) FILTER (WHERE gs <> '.' AND (gs = '+') <> body_plus) AS body_reverse FROM w GROUP BY gs""")
def strand_rules(t: Tables) -> DataFrame:
    gs = F.col("gs")
    each = {"forward_paired": fl.strand_matches("forward", gs, True), "reverse_paired": fl.strand_matches("reverse", gs, True), "forward_single": fl.strand_matches("forward", gs, False), "body_forward": fl.gene_body_strand_matches("forward", gs), "body_reverse": fl.gene_body_strand_matches("reverse", gs)}
    return _flagged(t).groupBy("gs").agg(*[F.count_if(c).alias(n) for n, c in each.items()])


# A read of every line: c clipped bases, a matched, then by the line an insertion, a deletion or an intron of k, then b matched.
_WALKED = """, cw AS (SELECT rid, tid, pos, flag, ln, 1 + sk % 5 AS c, 10 + pk % 20 AS a, 10 + sk % 30 AS b, 1 + pk % 60 AS k, CASE ln % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'I' ELSE 'D' END AS op FROM r),
  cg AS (SELECT *, c || 'S' || a || 'M' || k || op || b || 'M' AS cigar, CASE WHEN op = 'I' THEN 0 ELSE k END AS gap FROM cw)
"""


def _walked(t: Tables) -> DataFrame:
    r = t.reads.withColumns({"c": 1 + F.col("sk") % 5, "a": 10 + F.col("pk") % 20, "b": 10 + F.col("sk") % 30, "k": 1 + F.col("pk") % 60, "op": F.when(F.col("ln") % 3 == 0, "N").when(F.col("ln") % 3 == 1, "I").otherwise("D")})
    r = r.withColumn("cigar", F.concat(F.col("c"), F.lit("S"), F.col("a"), F.lit("M"), F.col("k"), F.col("op"), F.col("b"), F.lit("M")))
    return r.withColumn("ops", cg.parse(F.col("cigar")))


@query("cigar_lengths", _WALKED + """SELECT op, sum(a + b + CASE WHEN op = 'I' THEN k ELSE 0 END)::bigint AS aligned, sum(CASE WHEN op = 'N' THEN k ELSE 0 END)::bigint AS intron, sum(pos + a + gap + b)::bigint AS ends, count(*) FILTER (WHERE op = 'N') AS spliced FROM cg GROUP BY op""")
def cigar_lengths(t: Tables) -> DataFrame:
    ops = F.col("ops")
    return _walked(t).groupBy("op").agg(F.sum(cg.query_aligned_length(ops)).alias("aligned"), F.sum(cg.intron_bases(ops)).alias("intron"), F.sum(cg.reference_end(ops, F.col("pos"))).alias("ends"), F.count_if(cg.is_spliced(ops)).alias("spliced"))


def _numbered(t: Tables) -> DataFrame:
    """Walked reads with the SQL's number as rid: a long, or a decimal where a number does not fit, as then in the whole
    column."""
    r = _walked(t)
    tried = F.expr("try_add(try_multiply(try_add(try_multiply(try_add(try_multiply(try_add(try_multiply(qname, 262144L), pk), 16384L), sk), 8L), ln), 64L), len - 20)")
    if r.filter(F.col("rid").isNotNull() & tried.isNull()).isEmpty():
        return r.withColumn("rid", F.expr(_RID))
    return r.withColumn("rid", F.expr(_RID.replace("qname", "cast(qname as decimal(38, 0))")).cast("decimal(38, 0)"))


@query("cigar_blocks", _WALKED + """, bl AS (SELECT rid, pos AS s, pos + a AS e FROM cg UNION ALL SELECT rid, pos + a + gap, pos + a + gap + b FROM cg) SELECT rid, s, e FROM bl""")
def cigar_blocks(t: Tables) -> DataFrame:
    return _numbered(t).select("rid", F.explode(cg.blocks(F.col("ops"), F.col("pos"))).alias("x")).select("rid", "x.s", "x.e")


@query("cigar_introns", _WALKED + "SELECT tid, pos + a AS s, pos + a + k AS e, count(*) AS reads FROM cg WHERE op = 'N' GROUP BY ALL")
def cigar_introns(t: Tables) -> DataFrame:
    found = _walked(t).select("tid", F.explode(cg.blocks(F.col("ops"), F.col("pos"), cg.INTRONS)).alias("x"))
    return found.groupBy("tid", F.col("x.s").alias("s"), F.col("x.e").alias("e")).agg(F.count("*").alias("reads"))


@query("junction_sites", _WALKED + "SELECT tid, c + a AS seq_pos, pos + a AS s, pos + a + k AS e, count(*) AS reads FROM cg WHERE op = 'N' GROUP BY ALL")
def junction_sites(t: Tables) -> DataFrame:
    found = _walked(t).select("tid", F.explode(cg.junction_sites(F.col("ops"), F.col("pos"))).alias("x"))
    return found.groupBy("tid", F.col("x.seq_pos").alias("seq_pos"), F.col("x.s").alias("s"), F.col("x.e").alias("e")).agg(F.count("*").alias("reads"))


@query("indel_cycles", _WALKED + """, x AS (SELECT op, k, c + a AS cy, c + a + b + CASE WHEN op = 'I' THEN k ELSE 0 END AS n, flag & 16 <> 0 AS rev, flag & 64 <> 0 AS first FROM cg WHERE op <> 'N'),
  y AS (SELECT op, first, CASE WHEN rev THEN n - cy - (CASE WHEN op = 'I' THEN k ELSE 1 END) + 1 WHEN op = 'I' THEN cy + 1 ELSE cy END AS cycle FROM x)
  SELECT cycle, count(*) FILTER (WHERE op = 'I' AND first) AS insertions_first, count(*) FILTER (WHERE op = 'I' AND NOT first) AS insertions_last, count(*) FILTER (WHERE op = 'D' AND first) AS deletions_first, count(*) FILTER (WHERE op = 'D' AND NOT first) AS deletions_last FROM y GROUP BY cycle""")
def indel_cycles(t: Tables) -> DataFrame:
    read_bases = F.col("c") + F.col("a") + F.col("b") + F.when(F.col("op") == "I", F.col("k")).otherwise(0)
    return st.indel_cycles(_walked(t).withColumn("len", read_bases))


@query("template_sizes", """, w AS (SELECT flag, pk, sk, ln, CASE WHEN sk % 7 = 0 THEN 0 ELSE (sk * 37 % 9000) * (CASE WHEN ln % 2 = 0 THEN 1 ELSE -1 END) END AS tlen, tid, sk % 5 AS mtid, pk * 40 AS p1, pk * 40 + sk % 3 - 1 AS p2, ln % 4 >= 2 AS mrev FROM r WHERE flag & 2308 = 0),
  o AS (SELECT least(abs(tlen), 8000) AS size, CASE WHEN (flag & 16 <> 0) = mrev THEN 'other' WHEN p1 = p2 THEN 'inward' WHEN sign(p2 - p1) * (CASE WHEN flag & 64 <> 0 THEN 1 ELSE -1 END) = (CASE WHEN flag & 64 <> 0 THEN 1 ELSE -1 END) * (CASE WHEN flag & 16 = 0 THEN 1 ELSE -1 END) THEN 'inward' ELSE 'outward' END AS orientation FROM w WHERE tlen <> 0 OR tid = mtid)
  SELECT size, count(*) AS total, count(*) FILTER (WHERE orientation = 'inward') AS inward, count(*) FILTER (WHERE orientation = 'outward') AS outward, count(*) FILTER (WHERE orientation = 'other') AS other FROM o GROUP BY size""")
def template_sizes(t: Tables) -> DataFrame:
    signed = F.when(F.col("sk") % 7 == 0, 0).otherwise((F.col("sk") * 37 % 9000) * F.when(F.col("ln") % 2 == 0, 1).otherwise(-1))
    mates = t.reads.withColumns({"tlen": signed, "mtid": (F.col("sk") % 5).cast("int"), "pos": F.col("pk") * 40, "mpos": F.col("pk") * 40 + F.col("sk") % 3 - 1, "flag": F.col("flag").bitwiseOR(F.when(F.col("ln") % 4 >= 2, fl.MATE_REVERSE).otherwise(0))})
    return st.template_sizes(mates)


@query("base_totals", "SELECT base, count(*) AS n FROM (SELECT unnest(string_split(lower(text), '')) AS base FROM documents WHERE text IS NOT NULL) WHERE base IN ('a', 'c', 'g', 't') GROUP BY base", shared=False)
def base_totals(t: Tables) -> DataFrame:
    composition = st.base_composition(t.read("documents").filter("text is not null").select(F.lower("text").alias("seq")))
    return composition.filter("base <> 'n'").groupBy("base").agg(F.sum("n").cast("long").alias("n"))


@query("quality_mean", "SELECT count(*) AS bases, round(avg(unicode(q) - 33), 6) AS mean FROM (SELECT unnest(string_split(text, '')) AS q FROM documents WHERE text IS NOT NULL) WHERE unicode(q) BETWEEN 33 AND 126", shared=False)
def quality_mean(t: Tables) -> DataFrame:
    by_cycle = st.quality_by_cycle(t.read("documents").filter("text is not null").select(F.col("text").alias("qual")), most=94).filter("quality < 94")
    return by_cycle.agg(F.sum("n").cast("long").alias("bases"), _r(F.sum(F.col("quality") * F.col("n")) / F.sum("n")).alias("mean"))


@query("start_in_transcript", "SELECT gene_id, count(DISTINCT pos) AS starts FROM g JOIN r ON r.tid = g.tid AND g.s <= r.pos AND r.pos < g.e WHERE r.flag & 772 = 0 GROUP BY gene_id")
def start_in_transcript(t: Tables) -> DataFrame:
    return cv.distinct_starts(t.reads.filter(fl.integrity_reads()).select("tid", F.col("pos").alias("p")), t.genes.select("gene_id", "tid", "s", "e"), ["tid"], "gene_id")


@query("known_junction_events", _JUNCTIONS + """, ki AS (SELECT DISTINCT tid, s + 15 AS s, s + 15 + 60 + gene_id % 300 AS e FROM g) SELECT (ki.s IS NOT NULL) AS known, count(*) AS events FROM j LEFT JOIN ki ON j.tid = ki.tid AND j.s = ki.s AND j.e = ki.e GROUP BY 1""")
def known_junction_events(t: Tables) -> DataFrame:
    known = t.genes.select("tid", (F.col("s") + 15).alias("s"), (F.col("s") + 75 + F.col("gene_id") % 300).alias("e"))
    return cv.mark_known(_junctions(t), known, ["tid", "s", "e"]).groupBy("known").agg(F.count("*").alias("events"))


@query("depth_percentiles", """, gd AS (SELECT biotype, list_sort(list(e - s)) AS d, count(*) AS n FROM g GROUP BY biotype), x AS (SELECT biotype, d, n, p, p * (n + 1) / 100.0::double AS cy FROM gd, (SELECT unnest([10, 25, 50, 75, 90]) AS p))
  SELECT biotype, p::int AS p, round(CASE WHEN cy < 1 THEN d[1] WHEN cy >= n THEN d[n] ELSE d[floor(cy)::int] + (cy - floor(cy)) * (d[floor(cy)::int + 1] - d[floor(cy)::int]) END, 6) AS value FROM x""")
def depth_percentiles(t: Tables) -> DataFrame:
    return sq.percentiles_p(t.genes.select("biotype", (F.col("e") - F.col("s")).cast("double").alias("d")), ["biotype"], "d", [10, 25, 50, 75, 90]).withColumn("value", _r("value"))


@query("gtf_attributes", """SELECT p_partkey AS gene_id, nullif(p_brand, '') AS brand, cast(p_size AS varchar) AS size, NULL::varchar AS absent FROM part""", shared=False)
def gtf_attributes(t: Tables) -> DataFrame:
    line = F.format_string('gene_id "G%s"; brand "%s"; p_size %s; absent "";', F.col("p_partkey"), F.col("p_brand"), F.col("p_size"))
    found = t.read("part").select("p_partkey", line.alias("attributes"))
    return found.select(F.col("p_partkey").alias("gene_id"), gtf.attribute("brand").alias("brand"), gtf.attribute("p_size").alias("size"), gtf.attribute("absent").alias("absent"))


@query("sequence_functions", """SELECT p_partkey AS id, reverse(translate(upper(p_name), 'ACGTN', 'TGCAN')) AS complement, list_reduce(list_prepend(0::bigint, [unicode(c)::bigint FOR c IN string_split(p_name, '')]), lambda x, y: (x * 31 + y) % 4294967296) AS hash FROM part""", shared=False)
def sequence_functions(t: Tables) -> DataFrame:
    return t.read("part").select(F.col("p_partkey").alias("id"), sequences.reverse_complement(F.upper("p_name")).alias("complement"), sequences.java_hash(F.col("p_name")).alias("hash"))


@query("scientific", "SELECT p_partkey AS id, printf('%.6e', p_retailprice / 7) AS e, printf('%.1f', p_retailprice / 7) AS one FROM part", shared=False)
def scientific(t: Tables) -> DataFrame:
    x = F.col("p_retailprice") / 7
    return t.read("part").select(F.col("p_partkey").alias("id"), F.format_string("%.6e", x).alias("e"), F.format_string("%.1f", x).alias("one"))


@query("dup_curve", _MATRIX + """, lo AS (SELECT log10(min(all_unique * (1000.0::double / length))) AS a, log10(max(all_unique * (1000.0::double / length))) AS z FROM m WHERE all_unique > 0)
  SELECT k::int AS k, round(100 / (1 + exp(-(-2.5 + 0.75 * (a + (z - a) * k / 100.0::double)))), 6) AS percent FROM lo, (SELECT unnest(range(0, 101)) AS k)""")
def dup_curve(t: Tables) -> DataFrame:
    """The logistic curve at log-spaced expressions, for given coefficients."""
    ends = _matrix(t).filter("rpk > 0").agg(F.log10(F.min("rpk")).alias("a"), F.log10(F.max("rpk")).alias("z"))
    x = F.col("a") + (F.col("z") - F.col("a")) * F.col("k") / 100
    return ends.select("a", "z", F.explode(F.sequence(F.lit(0), F.lit(100))).alias("k")).select("k", _r(logistic_curve(x, -2.5, 0.75) * 100).alias("percent"))


# --- fragments over genes ------------------------------------------------------------------------------------

# Reads of two in three suppliers are proper pairs with the other line of their order's pair.
_FRAGMENTS = """, gbr AS (SELECT *, sk % 3 <> 0 AS proper FROM r WHERE flag & 2820 = 0 AND nh <= 1),
  pb AS (SELECT CASE WHEN x.proper THEN 'p' || (x.qname * 4 + (x.ln + 1) // 2) ELSE 'r' || x.rid END AS frag, x.proper, x.rid, x.flag, b.tid, b.s, b.e FROM gbr x JOIN b ON x.rid = b.rid),
  wf AS (SELECT frag, count(*) AS blocks, count(DISTINCT rid) AS reads FROM pb GROUP BY frag, proper HAVING NOT proper OR count(DISTINCT rid) = 2),
  bx AS (SELECT pb.frag, pb.rid, pb.flag, pb.s, g.gene_id, g.strand, g.s <= pb.s AND pb.e <= g.e AS enclosed, (g.strand = '+') = ((pb.flag & 16 = 0) = (pb.flag & 64 <> 0)) AS fits FROM pb JOIN g ON pb.tid = g.tid AND pb.s < g.e AND g.s < pb.e),
  og AS (SELECT wf.frag, wf.reads, wf.blocks, bx.gene_id, count(*) FILTER (WHERE enclosed) AS inside, count(*) FILTER (WHERE enclosed AND fits) AS inside_fitting, coalesce(bool_or(NOT enclosed), false) AS crossed FROM wf LEFT JOIN bx ON wf.frag = bx.frag GROUP BY ALL),
  oi AS (SELECT DISTINCT pb.frag FROM pb JOIN g ON pb.tid = g.tid AND g.s + 10 <= pb.e AND g.s + 40 >= pb.s),
  oc AS (SELECT og.frag, og.reads, count(*) FILTER (WHERE inside = blocks) AS genes, count(*) FILTER (WHERE inside_fitting = blocks) AS genes_fitting, bool_or(crossed) AS crossed FROM og GROUP BY ALL),
  od AS (SELECT oc.*, oi.frag IS NOT NULL AS intron FROM oc LEFT JOIN oi ON oc.frag = oi.frag)
"""


def _fragment_blocks(t: Tables) -> DataFrame:
    kept = t.reads.filter(fl.gene_body_reads()).select("rid", "qname", "ln", (F.col("sk") % 3 != 0).alias("proper"))
    frag = F.when(F.col("proper"), F.concat(F.lit("p"), F.expr("qname * 4 + (ln + 1) div 2"))).otherwise(F.concat(F.lit("r"), F.col("rid").cast("string")))
    return t.blocks.drop("qname", "ln").join(kept.withColumn("frag", frag), "rid")


def _introns(t: Tables) -> DataFrame:
    return t.genes.select("chrom", (F.col("s") + 10).alias("s"), (F.col("s") + 40).alias("e"))


def _origin_sql(genes: str) -> str:
    return f"""SELECT CASE WHEN {genes} = 1 THEN 'exonic' WHEN {genes} > 1 THEN 'ambiguous' WHEN intron THEN 'intronic' ELSE 'intergenic' END AS origin, sum(reads)::bigint AS reads, count(*) FILTER (WHERE crossed) AS crossed FROM od GROUP BY 1"""


def _origins(t: Tables, protocol: str) -> DataFrame:
    found = gb.assign(_fragment_blocks(t), t.genes, _introns(t), protocol)
    return found.groupBy("origin").agg(F.sum("reads").alias("reads"), F.count_if("crossed").alias("crossed"))


@query("fragment_origin", _FRAGMENTS + _origin_sql("genes"))
def fragment_origin(t: Tables) -> DataFrame:
    return _origins(t, "unstranded")


@query("fragment_origin_stranded", _FRAGMENTS + _origin_sql("genes_fitting"))
def fragment_origin_stranded(t: Tables) -> DataFrame:
    return _origins(t, "forward")


@query("fragment_origin_totals", _FRAGMENTS + """SELECT coalesce(sum(reads) FILTER (WHERE genes = 1), 0)::bigint AS exonic, coalesce(sum(reads) FILTER (WHERE genes > 1), 0)::bigint AS ambiguous, coalesce(sum(reads) FILTER (WHERE genes = 0 AND intron), 0)::bigint AS intronic,
  coalesce(sum(reads) FILTER (WHERE genes = 0 AND NOT intron), 0)::bigint AS intergenic, coalesce(sum(reads) FILTER (WHERE genes = 0), 0)::bigint AS no_feature, count(*) FILTER (WHERE crossed) AS overlapping_exon FROM od""")
def fragment_origin_totals(t: Tables) -> DataFrame:
    return gb.origins(gb.assign(_fragment_blocks(t), t.genes, _introns(t)))


@query("fragment_strand_votes", _FRAGMENTS + """SELECT count(*) FILTER (WHERE v) AS forward, count(*) FILTER (WHERE NOT v) AS reverse FROM (SELECT ((flag & 16 <> 0) = (strand = '-')) = (flag & 64 <> 0) AS v FROM bx JOIN wf ON bx.frag = wf.frag WHERE enclosed)""")
def fragment_strand_votes(t: Tables) -> DataFrame:
    return gb.strand_votes(_fragment_blocks(t), t.genes)


@query("whole_fragments", _FRAGMENTS + "SELECT reads, count(*) AS fragments, sum(blocks)::bigint AS blocks FROM wf GROUP BY reads")
def whole_fragments(t: Tables) -> DataFrame:
    return gb.whole_fragments(_fragment_blocks(t)).groupBy("reads").agg(F.count("*").alias("fragments"), F.sum("blocks").alias("blocks"))


@query("gene_body_counters", """SELECT count(*) FILTER (WHERE flag & 4 <> 0) AS not_aligned, count(*) FILTER (WHERE flag & 4 = 0 AND nh > 1) AS non_unique, count(*) FILTER (WHERE flag & 260 = 256) AS secondary, count(*) FILTER (WHERE flag & 260 = 0) AS "primary",
  count(*) FILTER (WHERE flag & 260 = 0 AND flag & 65 = 65) AS "left", count(*) FILTER (WHERE flag & 260 = 0 AND flag & 129 = 129) AS "right", count(*) FILTER (WHERE flag & 260 = 0 AND flag & 3 = 3) AS proper, count(*) FILTER (WHERE flag & 2820 = 0) AS reads FROM r""")
def gene_body_counters(t: Tables) -> DataFrame:
    return gb.alignment_counters(t.reads)


_SITES = _WALKED + """, js AS (SELECT tid, pos + 1 + c + a AS first, pos + 1 + c + a + k AS last, substr(repeat('ACGGT', 30), c + a - 1, 2) || '/' || substr(repeat('ACGGT', 30), c + a + 1, 2) AS motif FROM cg WHERE op = 'N'),
  kp AS (SELECT DISTINCT tid, unnest([s + 25, e + 1]) AS p FROM g)
"""


def _sites(t: Tables) -> DataFrame:
    return gb.junctions(_walked(t).withColumn("seq", F.repeat(F.lit("ACGGT"), 30)))


@query("junction_event_classes", _SITES + """, x AS (SELECT (EXISTS (SELECT 1 FROM kp WHERE kp.tid = js.tid AND abs(kp.p - js.first) <= 1))::int + (EXISTS (SELECT 1 FROM kp WHERE kp.tid = js.tid AND abs(kp.p - js.last) <= 1))::int AS n FROM js)
  SELECT count(*) AS events, count(*) FILTER (WHERE n = 2) AS known, count(*) FILTER (WHERE n = 1) AS partly, count(*) FILTER (WHERE n = 0) AS novel FROM x""")
def junction_event_classes(t: Tables) -> DataFrame:
    known = gb.known_positions(t.genes.select("tid", (F.col("s") + 25).alias("s"), "e"), ["tid"])
    return gb.junction_events(_sites(t), known, ["tid"])


@query("junction_motif_shares", _SITES + "SELECT motif, events, round(events * 100.0::double / (SELECT count(*) FROM js), 6) AS percent FROM (SELECT motif, count(*) AS events FROM js GROUP BY motif) ORDER BY events DESC, motif LIMIT 11")
def junction_motif_shares(t: Tables) -> DataFrame:
    return gb.motif_shares(_sites(t)).withColumn("percent", _r("percent"))
