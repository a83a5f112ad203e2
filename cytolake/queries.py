"""The registry of queries over the driver's tables, and their SQL.

Each query applies one operator to stand-ins made of whole tables (plans/standins.py). Doubles are rounded to six places
on both sides, since engines add in different orders. Model operators have no SQL; tests hold them to brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import fold, site_type, strip_extension, strip_suffix, wilson, z_of
from .operators import continuous, distributions, durations, intervals, models, reads, significance, sites
from .plans import standins as s
from .sources import files, ranges, sam
from .streaming import mates
from .tables import settled, shared_folder

QUERIES: dict = {}
ORACLE: dict = {}
SAMPLES = (1, 2, 3, 4, 5, 6, 7)


def _r(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded. Values that may lie on a half of the last place are rounded to ten places before, here and in the SQL."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return add


_Z = z_of(sites.ALPHA)
_LEVEL = "CAST(n_meth AS DOUBLE) / n_reads"


def _bound(sign: str, p: str = "n_meth", n: str = "n_reads", z: float = _Z) -> str:
    level, n = f"(CAST({p} AS DOUBLE) / {n})", f"CAST({n} AS DOUBLE)"
    return f"(({level} + {z * z!r} / (2 * {n})) {sign} {z!r} * sqrt({level} * (1 - {level}) / {n} + {z * z!r} / (4 * {n} * {n}))) / (1 + {z * z!r} / {n})"


_LOW, _HIGH = f"greatest(0.0, {_bound('-')})", f"least(1.0, {_bound('+')})"


# -- sites ---------------------------------------------------------------------------------------------------

_SYMMETRIC = f"""WITH {s.SITES}, m AS (
  SELECT *, coalesce(strand = '+' AND lead(strand) OVER w = '-' AND lead(pos) OVER w = pos + 1, false) AS a,
         coalesce(strand = '-' AND lag(strand) OVER w = '+' AND lag(pos) OVER w = pos - 1, false) AS b,
         lead(n_reads) OVER w AS r2, lead(n_meth) OVER w AS m2
  FROM sites WINDOW w AS (PARTITION BY chrom ORDER BY pos, strand))
SELECT chrom, pos, context, n_reads + CASE WHEN a THEN r2 ELSE 0 END AS n_reads, n_meth + CASE WHEN a THEN m2 ELSE 0 END AS n_meth, a AS paired FROM m WHERE NOT b"""


@query(_SYMMETRIC)
def symmetric_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sites.symmetric(s.sites(spark, sf_dir))


@query(f"""WITH {s.SITES}, t AS (SELECT chrom, pos, strand, CASE WHEN pos % 3 = 0 THEN context || 'x' ELSE context END AS context, n_reads, n_meth FROM sites), m AS (
  SELECT *, coalesce(strand = '+' AND lead(strand) OVER w = '-' AND lead(pos) OVER w = pos + 1, false) AS a,
         coalesce(strand = '-' AND lag(strand) OVER w = '+' AND lag(pos) OVER w = pos - 1, false) AS b,
         lead(n_reads) OVER w AS r2, lead(n_meth) OVER w AS m2, lead(context) OVER w AS c2
  FROM t WINDOW w AS (PARTITION BY chrom ORDER BY pos, strand)), o AS (
  SELECT chrom, pos, CASE WHEN a AND c2 LIKE '%x' AND context NOT LIKE '%x' THEN context || 'x' ELSE context END AS context, n_reads + CASE WHEN a THEN r2 ELSE 0 END AS n_reads, n_meth + CASE WHEN a THEN m2 ELSE 0 END AS n_meth, a AS paired
  FROM m WHERE NOT b)
SELECT * FROM o WHERE context NOT LIKE '%x'""")
def symmetric_sites_with_mut(spark, sf_dir):
    marked = s.sites(spark, sf_dir).withColumn("context", F.when(F.col("pos") % 3 == 0, F.concat("context", F.lit("x"))).otherwise(F.col("context")))
    return sites.symmetric(marked, mutated=False)


@query(f"""WITH {s.SITES}, t AS (SELECT context, n_reads, n_meth, CASE WHEN n_reads > 0 THEN {_LEVEL} END AS level, CASE WHEN n_reads > 0 THEN {_LOW} > 0.5 ELSE false END AS up, CASE WHEN n_reads > 0 THEN {_HIGH} < 0.5 ELSE false END AS down FROM sites),
g AS (SELECT coalesce(context, 'cytosines') AS context, count(*) AS total_sites, CAST(count(*) FILTER (n_reads > 0) AS BIGINT) AS sites_covered, max(n_reads) AS max_depth, CAST(0 AS BIGINT) AS mutations,
  CAST(sum(n_meth) AS BIGINT) AS total_c, CAST(sum(n_reads - n_meth) AS BIGINT) AS total_t, CAST(sum(n_reads) AS BIGINT) AS coverage, count(*) FILTER (up) AS called_meth, count(*) FILTER (down) AS called_unmeth, sum(level) AS lv
  FROM t GROUP BY GROUPING SETS ((context), ()))
SELECT context, total_sites, sites_covered, max_depth, mutations, total_c, total_t, coverage, called_meth, called_unmeth, round(coverage / total_sites, 6) AS mean_depth, round(coverage / sites_covered, 6) AS mean_depth_covered,
  round(lv / sites_covered, 6) AS mean_meth, round(total_c / coverage, 6) AS mean_meth_weighted, round(called_meth / (called_meth + called_unmeth), 6) AS fractional_meth FROM g""")
def levels_by_context(spark, sf_dir):
    return _r(sites.levels(s.sites(spark, sf_dir)))


@query(f"WITH {s.SITES} SELECT chrom, pos, strand, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM sites WHERE n_reads > 0")
def wilson_calls(spark, sf_dir):
    low, high = wilson("n_meth", "n_reads", sites.ALPHA)
    return _r(s.sites(spark, sf_dir).where("n_reads > 0").select("chrom", "pos", "strand", low.alias("low"), high.alias("high")))


_ROI = f"""WITH {s.SITES}, {s.REGIONS}, hits AS (
  SELECT r.*, n_reads, n_meth, CASE WHEN n_reads > 0 THEN {_LOW} > 0.5 ELSE false END AS up, CASE WHEN n_reads > 0 THEN {_HIGH} < 0.5 ELSE false END AS down
  FROM regions r JOIN sites s ON s.chrom = r.chrom AND pos >= start AND pos < "end"), f AS (
  SELECT chrom, start, "end", name, count(*) AS n_sites, count(*) FILTER (n_reads > 0) AS n_covered, CAST(sum(n_meth) AS BIGINT) AS n_meth, CAST(sum(n_reads) AS BIGINT) AS n_reads, count(*) FILTER (up) AS called_meth, count(*) FILTER (down) AS called_unmeth
  FROM hits GROUP BY ALL)
"""


@query(_ROI + "SELECT *, round(CAST(n_meth AS DOUBLE) / n_reads, 6) AS level FROM f WHERE n_reads > 0")
def roi_stats(spark, sf_dir):
    return _r(sites.roi_stats(s.sites(spark, sf_dir), s.regions(spark, sf_dir)))


@query(_ROI + """SELECT chrom, start, "end", name, coalesce(n_sites, 0) AS n_sites, coalesce(n_covered, 0) AS n_covered, coalesce(n_meth, 0) AS n_meth, coalesce(n_reads, 0) AS n_reads, coalesce(called_meth, 0) AS called_meth, coalesce(called_unmeth, 0) AS called_unmeth,
  CASE WHEN n_reads > 0 THEN round(CAST(n_meth AS DOUBLE) / n_reads, 6) END AS level FROM regions LEFT JOIN f USING (chrom, start, "end", name)""")
def roi_stats_all_regions(spark, sf_dir):
    return _r(sites.roi_stats(s.sites(spark, sf_dir), s.regions(spark, sf_dir), all_regions=True))


@query(f"""WITH {s.SITES}, {s.CROSSING} SELECT * FROM sites s WHERE EXISTS (SELECT 1 FROM crossing r WHERE r.chrom = s.chrom AND s.pos >= r.start AND s.pos < r."end")""")
def select_sites(spark, sf_dir):
    return sites.select_sites(s.sites(spark, sf_dir), s.crossing(spark, sf_dir))


@query(f"WITH {s.SITES} SELECT * FROM sites")
def merge_counts_sum(spark, sf_dir):
    return sites.merge_sum(s.samples(spark, sf_dir))


@query("WITH " + s.SAMPLES + " SELECT chrom, pos, strand, " + ", ".join(f"CAST(coalesce(sum(n_reads) FILTER (sample = {k}), 0) AS BIGINT) AS s{k}_r, CAST(coalesce(sum(n_meth) FILTER (sample = {k}), 0) AS BIGINT) AS s{k}_m" for k in SAMPLES) + " FROM samples GROUP BY ALL")
def merge_counts_table(spark, sf_dir):
    return sites.merge_table(s.samples(spark, sf_dir), SAMPLES)


@query("WITH " + s.SAMPLES + " SELECT chrom, pos, strand, " + ", ".join(f"round(max({_LEVEL}) FILTER (sample = {k} AND n_reads > 20), 6) AS s{k}" for k in SAMPLES) + " FROM samples GROUP BY ALL")
def merge_fraction_table(spark, sf_dir):
    return _r(sites.merge_fraction(s.samples(spark, sf_dir), SAMPLES, 20))


def _tracks(spark, sf_dir):
    t = s.sites(spark, sf_dir)
    return [t.where(F.col("strand") == x).select("chrom", F.expr("pos div 2").alias("start"), F.col("n_reads").alias("value")) for x in "+-"]


@query(f"""WITH {s.SITES}, a AS (SELECT chrom, pos // 2 AS start, n_reads AS v FROM sites WHERE strand = '+'), b AS (SELECT chrom, pos // 2 AS start, n_reads AS v FROM sites WHERE strand = '-')
SELECT chrom, start, coalesce(a.v, 0) AS a, coalesce(b.v, 0) AS b FROM a FULL JOIN b USING (chrom, start)""")
def outer_merge_tracks(spark, sf_dir):
    return sites.outer_merge(*_tracks(spark, sf_dir))


def _index(spark, sf_dir):
    p = s.table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(F.concat(F.lit("chr"), (key % 5).cast("string")).alias("chrom"), (2 * key).alias("pos"), F.concat(F.lit("to"), (key % 3).cast("string")).alias("to_chrom"), F.expr("p_partkey div 2 + 1").alias("to_pos"), F.when(key % 2 == 0, "+").otherwise("-").alias("to_strand"), key.alias("line"))


_INDEX = "idx AS (SELECT 'chr' || CAST(p_partkey % 5 AS VARCHAR) AS chrom, 2 * p_partkey AS pos, 'to' || CAST(p_partkey % 3 AS VARCHAR) AS to_chrom, p_partkey // 2 + 1 AS to_pos, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS to_strand FROM part)"
_LIFTED = f"""WITH {s.SITES}, {_INDEX}, lifted AS (
  SELECT to_chrom AS chrom, to_pos - CASE WHEN to_strand = '-' THEN 1 ELSE 0 END AS pos, '+' AS strand, context, n_reads, n_meth FROM sites JOIN idx USING (chrom, pos))
"""


def _lifted(spark, sf_dir):
    return sites.liftover(s.sites(spark, sf_dir), _index(spark, sf_dir), plus_strand=True)


@query(_LIFTED + "SELECT * FROM lifted")
def liftover(spark, sf_dir):
    return _lifted(spark, sf_dir)


@query(f"WITH {s.SITES}, {_INDEX} SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.chrom = s.chrom AND i.pos = s.pos)")
def unlifted_anti(spark, sf_dir):
    return sites.unlifted(s.sites(spark, sf_dir), _index(spark, sf_dir))


@query(_LIFTED + "SELECT chrom, pos, strand, min(context) AS context, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(n_meth) AS BIGINT) AS n_meth FROM lifted GROUP BY chrom, pos, strand")
def lift_collapse(spark, sf_dir):
    return sites.lift_filter(_lifted(spark, sf_dir))


@query(_LIFTED + "SELECT chrom, pos, strand, min(context) AS context, CAST(sum(n_reads) AS BIGINT) AS n_reads, CAST(sum(n_meth) AS BIGINT) AS n_meth FROM lifted GROUP BY chrom, pos, strand HAVING count(*) = 1")
def lift_unique(spark, sf_dir):
    return sites.lift_filter(_lifted(spark, sf_dir), unique=True)


@query(f"WITH {s.SITES} SELECT chrom, pos, strand, round(abs(1 - 2 * {_LEVEL}), 6) AS folded FROM sites WHERE n_reads > 0")
def partial_fold(spark, sf_dir):
    return _r(s.sites(spark, sf_dir).where("n_reads > 0").select("chrom", "pos", "strand", fold(F.col("n_meth") / F.col("n_reads")).alias("folded")))


@query(f"""WITH {s.SITES}, o AS (SELECT chrom, greatest(0, (pos + 99) // 100 - 1) AS bin, sum(n_reads) AS r, sum(n_meth) AS m FROM sites GROUP BY ALL),
e AS (SELECT chrom, min(bin) FILTER (r > 0) AS lo, max(bin) AS hi FROM o GROUP BY chrom), d AS (SELECT chrom, unnest(range(lo, hi + 1)) AS bin FROM e)
SELECT chrom, bin, CAST(coalesce(r, 0) AS BIGINT) AS n_reads, CAST(coalesce(m, 0) AS BIGINT) AS n_meth, bin * 100 AS start, (bin + 1) * 100 AS "end" FROM d LEFT JOIN o USING (chrom, bin)""")
def fixed_bins_dense(spark, sf_dir):
    return sites.bins(s.sites(spark, sf_dir), 100)


_NEED = sites.reads_for_interval()


@query(f"""WITH {s.SITES}, c AS (SELECT CAST(unnest([10, 20, 50, 100, 200]) AS BIGINT) AS size), b AS (SELECT size, chrom, greatest(0, (pos + size - 1) // size - 1) AS bin, sum(n_reads) AS r FROM sites, c GROUP BY ALL HAVING sum(n_reads) > 0)
SELECT size, count(*) AS n_covered, count(*) FILTER (r >= {_NEED}) AS n_pass, round(count(*) FILTER (r >= {_NEED}) / count(*), 6) AS share FROM b GROUP BY size""")
def bin_size_pass_fraction(spark, sf_dir):
    return _r(sites.bin_size_pass(s.sites(spark, sf_dir), [10, 20, 50, 100, 200], _NEED))


@query(f"WITH {s.COLLAPSED} SELECT chrom, pos, CAST(sum(n_reads) OVER w AS BIGINT) AS reads_upto, CAST(sum(n_meth) OVER w AS BIGINT) AS meth_upto FROM collapsed WINDOW w AS (PARTITION BY chrom ORDER BY pos)")
def cumulative_coverage(spark, sf_dir):
    return sites.cumulative(s.collapsed(spark, sf_dir)).select("chrom", "pos", "reads_upto", "meth_upto")


@query(f"""WITH {s.COLLAPSED}, p AS (SELECT a.chrom, a.pos, b.n_reads AS r, b.n_meth AS m, 1 - power((b.pos - a.pos) / 51.0, 2) AS w FROM collapsed a JOIN collapsed b ON a.chrom = b.chrom AND b.pos BETWEEN a.pos - 50 AND a.pos + 50)
SELECT chrom, pos, round(sum(w * m) / sum(w * r), 6) AS smooth FROM p GROUP BY ALL""")
def smoothed_levels(spark, sf_dir):
    return _r(sites.smoothed(s.collapsed(spark, sf_dir), 50).select("chrom", "pos", "smooth"))


def _probes(spark, sf_dir):
    e = s.table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("g"), F.col("label").cast("string")).alias("sample"), F.posexplode("embedding").alias("k", "v")).select("sample", F.concat(F.lit("chr"), (F.col("k") % 5).cast("string")).alias("chrom"), F.col("k").cast("bigint").alias("pos"), F.round(F.col("v").cast("double"), 4).alias("value"))


@query(f"""WITH {s.REGIONS}, flat AS (SELECT 'g' || CAST(label AS VARCHAR) AS sample, unnest(range(0, len(embedding))) AS k, unnest(embedding) AS v FROM embeddings),
probes AS (SELECT sample, 'chr' || CAST(k % 5 AS VARCHAR) AS chrom, k AS pos, round(CAST(v AS DOUBLE), 4) AS value FROM flat)
SELECT sample, name, count(*) AS n_probes, round(avg(value), 6) AS mean FROM probes p JOIN regions r ON p.chrom = r.chrom AND pos >= start AND pos < "end" GROUP BY ALL""")
def probe_feature_means(spark, sf_dir):
    return _r(sites.probe_means(_probes(spark, sf_dir), s.regions(spark, sf_dir)))


# -- intervals -----------------------------------------------------------------------------------------------

_UNION = """u0 AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM crossing),
u1 AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM u0),
merged AS (SELECT chrom, min(start) AS start, max("end") AS "end", count(*) AS n FROM u1 GROUP BY chrom, k)"""


@query(f"WITH {s.CROSSING}, {_UNION} SELECT * FROM merged")
def interval_union(spark, sf_dir):
    return intervals.union(s.crossing(spark, sf_dir))


_GAPS = """tails AS (SELECT chrom, max("end") + 50 AS t FROM crossing GROUP BY chrom), g AS (
  SELECT chrom, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY start), 0) AS start, start AS "end" FROM (SELECT chrom, start, "end" FROM merged UNION ALL SELECT chrom, t, t FROM tails)),
gaps AS (SELECT * FROM g WHERE start < "end")"""


@query(f"WITH {s.CROSSING}, {_UNION}, {_GAPS} SELECT * FROM gaps")
def interval_complement(spark, sf_dir):
    r = s.crossing(spark, sf_dir)
    return intervals.complement(r, r.groupBy("chrom").agg((F.max("end") + 50).alias("end")))


@query(f"""WITH {s.CROSSING}, {s.REGIONS}, {_UNION}, far AS (SELECT chrom, start, "end" FROM merged UNION ALL SELECT chrom, 1000000000, 1000000000 FROM (SELECT DISTINCT chrom FROM regions UNION SELECT DISTINCT chrom FROM crossing)),
g AS (SELECT chrom, coalesce(lag("end") OVER (PARTITION BY chrom ORDER BY start), 0) AS gs, start AS ge FROM far),
own AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM regions),
own1 AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM own), a AS (SELECT chrom, min(start) AS start, max("end") AS "end" FROM own1 GROUP BY chrom, k)
SELECT a.chrom, greatest(a.start, gs) AS start, least(a."end", ge) AS "end" FROM a JOIN g ON a.chrom = g.chrom AND a.start < ge AND gs < a."end" AND gs < ge""")
def interval_difference(spark, sf_dir):
    return intervals.difference(s.regions(spark, sf_dir), s.crossing(spark, sf_dir))


@query(f"""WITH {s.CROSSING}, {s.REGIONS} SELECT a.chrom, a.start AS a_start, a."end" AS a_end, a.name AS a_name, b.start AS b_start, b."end" AS b_end, b.name AS b_name
FROM regions a JOIN crossing b ON a.chrom = b.chrom AND a.start < b."end" AND b.start < a."end" """)
def interval_overlaps(spark, sf_dir):
    return intervals.overlaps(s.regions(spark, sf_dir), s.crossing(spark, sf_dir))


@query(f"""WITH {s.CROSSING}, ev AS (SELECT chrom, start AS x, 1 AS d FROM crossing UNION ALL SELECT chrom, "end", -1 FROM crossing), st AS (SELECT chrom, x, sum(d) AS d FROM ev GROUP BY ALL),
sw AS (SELECT chrom, x AS start, lead(x) OVER w AS "end", CAST(sum(d) OVER (PARTITION BY chrom ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM st WINDOW w AS (PARTITION BY chrom ORDER BY x)) SELECT * FROM sw WHERE depth > 0""")
def interval_overlap_fragments(spark, sf_dir):
    return intervals.fragments(s.crossing(spark, sf_dir))


_SEGMENTS = s.STEPS + """, j AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 86400 THEN 0 ELSE 1 END AS new FROM steps WINDOW w AS (PARTITION BY chrom ORDER BY pos)),
seg AS (SELECT chrom, pos, id, value, event_type, sum(new) OVER (PARTITION BY chrom ORDER BY pos RANGE UNBOUNDED PRECEDING) AS segment FROM j)"""


@query(f'WITH {_SEGMENTS} SELECT chrom, CAST(segment AS BIGINT) AS segment, min(pos) AS start, max(pos) AS "end", count(*) AS n FROM seg GROUP BY chrom, segment')
def desert_segments(spark, sf_dir):
    return intervals.segment_by_gap(s.steps(spark, sf_dir), 86400).groupBy("chrom", "segment").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {s.COLLAPSED}, b AS (SELECT *, 2 * n_meth < n_reads AS low, sum(CASE WHEN 2 * n_meth < n_reads THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM collapsed)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n, round(sum(1 - CAST(n_meth AS DOUBLE) / n_reads), 6) AS score FROM b WHERE low GROUP BY chrom, k""")
def state_islands(spark, sf_dir):
    return _r(intervals.domains(s.collapsed(spark, sf_dir).where("n_reads > 0"), 2 * F.col("n_meth") < F.col("n_reads"), ("chrom",), 1 - F.col("n_meth") / F.col("n_reads")))


@query(f"""WITH {s.CROSSING}, {_UNION}, e AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY chrom ORDER BY start) > 5 THEN 1 ELSE 0 END AS new FROM merged), f AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT chrom, min(start) AS start, max("end") AS "end", min(n) AS score, count(*) AS n FROM f GROUP BY chrom, k""")
def merge_within_gap(spark, sf_dir):
    return intervals.merge_near(intervals.union(s.crossing(spark, sf_dir)).withColumnRenamed("n", "score"), 5)


# -- significance --------------------------------------------------------------------------------------------

_P = "p AS (SELECT chrom, pos, (CAST((meth_a * 31 + unmeth_b * 17 + pos * 7) % 1000 AS DOUBLE) + 1) / 100000.0 AS p, meth_a, unmeth_a, meth_b, unmeth_b FROM two_groups)"


def _pvalues(spark, sf_dir):
    x = ((F.col("meth_a") * 31 + F.col("unmeth_b") * 17 + F.col("pos") * 7) % 1000).cast("double")
    return s.two_groups(spark, sf_dir).withColumn("p", (x + 1) / 100000.0)


_BH = "r AS (SELECT *, least(1.0, p * count(*) OVER () / rank_) AS raw FROM (SELECT *, count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS rank_ FROM p)), q AS (SELECT *, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING) AS q FROM r)"


@query(f"WITH {s.TWO_GROUPS}, {_P}, {_BH} SELECT chrom, pos, p, round(q, 9) AS q FROM q")
def bh_fdr(spark, sf_dir):
    return significance.bh(_pvalues(spark, sf_dir)).select("chrom", "pos", "p", F.round("q", 9).alias("q"))


@query(f"""WITH {s.TWO_GROUPS}, {_P}, o AS (SELECT p, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM p), f AS (SELECT min(p) AS first FROM o WHERE p >= 0.01 * i / n)
SELECT coalesce(max(first), max(p)) AS cutoff FROM p, f""")
def stepup_cutoff(spark, sf_dir):
    return significance.stepup_cutoff(_pvalues(spark, sf_dir), 0.01)


@query(f"""WITH {s.TWO_GROUPS}, o AS (SELECT chrom, pos, CAST(meth_a AS DOUBLE) AS score FROM two_groups), z AS (SELECT CAST(meth_b AS DOUBLE) AS score, count(*) AS n FROM two_groups GROUP BY ALL)
SELECT o.chrom, o.pos, o.score, round(coalesce((SELECT sum(n) FROM z WHERE z.score > o.score), 0) / (SELECT sum(n) FROM z), 6) AS p FROM o""")
def empirical_pvalue(spark, sf_dir):
    t = s.two_groups(spark, sf_dir)
    return _r(significance.empirical_p(t.select("chrom", "pos", F.col("meth_a").cast("double").alias("score")), t.select(F.col("meth_b").cast("double").alias("score"))).select("chrom", "pos", "score", "p"))


@query(f"""WITH {s.COLLAPSED}, b AS (SELECT (b.pos - a.pos - 2) // 10 AS bin, a.n_meth % 97 AS x, b.n_meth % 97 AS y FROM collapsed a JOIN collapsed b ON a.chrom = b.chrom AND b.pos - a.pos BETWEEN 2 AND 101),
t AS (SELECT bin, count(*) AS n, CAST(sum(x) AS DOUBLE) AS sx, CAST(sum(y) AS DOUBLE) AS sy, CAST(sum(x * x) AS DOUBLE) AS sxx, CAST(sum(y * y) AS DOUBLE) AS syy, CAST(sum(x * y) AS DOUBLE) AS sxy FROM b GROUP BY bin)
SELECT bin, n, round(CASE WHEN n > 1 AND (n * sxx - sx * sx) * (n * syy - sy * sy) > 0 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0.0 END, 6) AS corr FROM t""")
def distance_bin_corr(spark, sf_dir):
    return _r(significance.distance_correlation(s.collapsed(spark, sf_dir), F.col("n_meth") % 97, 2, 102, 10))


@query(f"WITH {s.COLLAPSED} SELECT chrom, pos, n_reads, n_meth, count(*) OVER w AS n_near, CAST(sum(n_reads) OVER w AS BIGINT) AS near_sum FROM collapsed WINDOW w AS (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING)")
def band_neighbours(spark, sf_dir):
    return significance.band_neighbours(s.collapsed(spark, sf_dir), 40)


def _lc(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


_DIFF = "d AS (SELECT chrom, pos, meth_a, unmeth_a, meth_b, unmeth_b, CAST(meth_b + 1 AS DOUBLE) AS ma, CAST(unmeth_b + 1 AS DOUBLE) AS ua, CAST(meth_a + 1 AS DOUBLE) AS mb, CAST(unmeth_a + 1 AS DOUBLE) AS ub FROM two_groups)"
_SUM = f"x AS (SELECT *, unnest(range(CAST(greatest(0, mb - ua) AS BIGINT), CAST(mb AS BIGINT))) AS k FROM d), sc AS (SELECT chrom, pos, meth_a, unmeth_a, meth_b, unmeth_b, least(1.0, sum(exp({_lc('(mb + ub - 1)', 'k')} + {_lc('(ma + ua - 1)', '(ma + mb - 1 - k)')} - {_lc('(ma + ua + mb + ub - 2)', '(ma + mb - 1)')}))) AS score FROM x GROUP BY ALL)"


@query(f"WITH {s.TWO_GROUPS}, {_DIFF}, {_SUM} SELECT chrom, pos, meth_a, unmeth_a, meth_b, unmeth_b, round(coalesce(score, 0.0), 6) AS score FROM d LEFT JOIN sc USING (chrom, pos, meth_a, unmeth_a, meth_b, unmeth_b)")
def methdiff_exact(spark, sf_dir):
    return _r(significance.methdiff(s.two_groups(spark, sf_dir)))


@query(f"""WITH {s.TWO_GROUPS}, {s.REGIONS}, {_P} SELECT r.chrom, r.start, r."end", count(p.pos) AS n_sites, count(*) FILTER (p.p < 0.005) AS n_sig FROM regions r LEFT JOIN p ON p.chrom = r.chrom AND p.pos >= r.start AND p.pos < r."end" GROUP BY ALL""")
def dmr_counts(spark, sf_dir):
    return significance.dmr_counts(s.regions(spark, sf_dir), _pvalues(spark, sf_dir).withColumn("score", F.col("p")), 0.005)


@query(f"""WITH {s.TWO_GROUPS}, {_P}, i AS (SELECT *, p < 0.005 AS ok, sum(CASE WHEN p < 0.005 THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM p)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n, count(*) FILTER (p < 0.005) AS n_sig, round(CAST(sum(meth_a) AS DOUBLE) / sum(meth_a + unmeth_a) - CAST(sum(meth_b) AS DOUBLE) / sum(meth_b + unmeth_b), 6) AS diff FROM i WHERE ok GROUP BY chrom, k""")
def significant_islands(spark, sf_dir):
    t = _pvalues(spark, sf_dir).withColumns({"q": F.col("p"), "cov_a": F.col("meth_a") + F.col("unmeth_a"), "cov_b": F.col("meth_b") + F.col("unmeth_b")})
    return _r(significance.significant_islands(t, 0.005))


# -- reads ---------------------------------------------------------------------------------------------------

_PAIRS = s.EPIREADS + """, two AS (SELECT chrom, cpg, states, unnest(range(0, length(states) - 1)) AS i FROM epireads), st AS (SELECT chrom, cpg + i AS cpg, substr(states, CAST(i + 1 AS INTEGER), 2) AS s FROM two),
pairs AS (SELECT chrom, cpg, count(*) FILTER (s = 'CC') AS cc, count(*) FILTER (s = 'CT') AS ct, count(*) FILTER (s = 'TC') AS tc, count(*) FILTER (s = 'TT') AS tt FROM st WHERE s IN ('CC', 'CT', 'TC', 'TT') GROUP BY chrom, cpg)"""


@query(f"WITH {_PAIRS} SELECT * FROM pairs")
def pair_state_table(spark, sf_dir):
    return reads.pair_states(s.epireads(spark, sf_dir))


@query(f"""WITH {_PAIRS}, k AS (SELECT *, unnest(range(greatest(0, cc - tt), least(cc + ct, cc + tc) + 1)) AS j FROM pairs),
w AS (SELECT chrom, cpg, cc, ct, tc, tt, {_lc('(cc + ct)', 'j')} + {_lc('(tc + tt)', '(cc + tc - j)')} AS l, {_lc('(cc + ct)', 'cc')} + {_lc('(tc + tt)', 'tc')} AS h, {_lc('(cc + ct + tc + tt)', '(cc + tc)')} AS t FROM k)
SELECT chrom, cpg, cc, ct, tc, tt, round(round(least(1.0, sum(exp(l - t)) FILTER (l <= h + 1e-9)), 10), 6) AS p FROM w GROUP BY ALL""")
def fisher_pairs(spark, sf_dir):
    return _r(_r(reads.pair_states(s.epireads(spark, sf_dir)).withColumn("p", significance.fisher("cc", "ct", "tc", "tt")), 10))


_BASES = s.GENOME + """, g AS (SELECT chrom, seq, unnest(range(0, length(seq))) AS pos FROM genome),
gb AS (SELECT chrom, pos, substr(seq, CAST(pos + 1 AS INTEGER), 1) AS b, CASE WHEN pos > 1 THEN substr(seq, CAST(pos - 1 AS INTEGER), 1) END AS b2, CASE WHEN pos > 0 THEN substr(seq, CAST(pos AS INTEGER), 1) END AS b1,
  nullif(substr(seq, CAST(pos + 2 AS INTEGER), 1), '') AS a1, nullif(substr(seq, CAST(pos + 3 AS INTEGER), 1), '') AS a2 FROM g),
cyt AS (SELECT chrom, pos, CASE b WHEN 'C' THEN '+' ELSE '-' END AS strand,
  CASE WHEN b = 'C' THEN CASE WHEN a1 = 'G' THEN 'CpG' WHEN a1 IN ('A', 'C', 'T') AND a2 IN ('A', 'C', 'T') THEN 'CHH' WHEN a1 IN ('A', 'T') AND a2 = 'G' THEN 'CXG' ELSE 'CCG' END
       ELSE CASE WHEN b1 = 'C' THEN 'CpG' WHEN b1 IN ('A', 'G', 'T') AND b2 IN ('A', 'G', 'T') THEN 'CHH' WHEN b1 IN ('A', 'T') AND b2 = 'C' THEN 'CXG' ELSE 'CCG' END END AS context
  FROM gb WHERE b IN ('C', 'G'))"""


@query(f"WITH {_BASES} SELECT * FROM cyt")
def context_tags(spark, sf_dir):
    return reads.cytosines(s.genome(spark, sf_dir))


@query(f"WITH {_BASES} SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS cpg FROM gb WHERE b = 'C' AND a1 = 'G'")
def cpg_ordinal(spark, sf_dir):
    return reads.cpg_index(s.genome(spark, sf_dir))


_READS = s.ALIGNED + """, rb AS (SELECT read, chrom, strand, start, length(seq) AS n, seq, unnest(range(0, length(seq))) AS i FROM aligned),
rbase AS (SELECT read, chrom, strand, CASE WHEN strand = '+' THEN start + i ELSE start + n - 1 - i END AS pos, i, substr(seq, CAST(i + 1 AS INTEGER), 1) AS base FROM rb)"""


@query(f"""WITH {_BASES}, {_READS.replace(s.GENOME + ", ", "")}, c AS (SELECT chrom, pos, {", ".join(f"count(*) FILTER (strand = '{x}' AND base = '{b}') AS {n}{b}" for x, n in (("+", "p"), ("-", "n")) for b in "CTG")}, count(*) FILTER (strand = '+' AND base <> 'N') AS pa, count(*) FILTER (strand = '-' AND base <> 'N') AS na FROM rbase GROUP BY ALL)
SELECT chrom, pos, strand, CASE WHEN 2 * coalesce(CASE strand WHEN '+' THEN nG ELSE pG END, 0) < coalesce(CASE strand WHEN '+' THEN na ELSE pa END, 0) THEN context || 'x' ELSE context END AS context,
  coalesce(CASE strand WHEN '+' THEN pC + pT ELSE nC + nT END, 0) AS n_reads, coalesce(CASE strand WHEN '+' THEN pC ELSE nC END, 0) AS n_meth FROM cyt LEFT JOIN c USING (chrom, pos)""")
def pileup(spark, sf_dir):
    return reads.pileup(s.aligned(spark, sf_dir), s.genome(spark, sf_dir))


@query(f"""WITH {_BASES}, {_READS.replace(s.GENOME + ", ", "")}, h AS (SELECT i + 1 AS base, strand, rbase.base AS b FROM rbase JOIN cyt USING (chrom, pos, strand) WHERE rbase.base <> 'N' AND context <> 'CpG' AND i < 1000),
t AS (SELECT base, count(*) FILTER (strand = '+' AND b = 'C') AS p_unconv, count(*) FILTER (strand = '+' AND b = 'T') AS p_conv, count(*) FILTER (strand = '-' AND b = 'C') AS n_unconv, count(*) FILTER (strand = '-' AND b = 'T') AS n_conv, count(*) FILTER (b NOT IN ('C', 'T')) AS errors FROM h GROUP BY base)
SELECT *, round(p_conv / nullif(p_conv + p_unconv, 0), 6) AS p_rate, round(n_conv / nullif(n_conv + n_unconv, 0), 6) AS n_rate, round((p_conv + n_conv) / nullif(p_conv + n_conv + p_unconv + n_unconv, 0), 6) AS rate, round(errors / nullif(errors + p_conv + n_conv + p_unconv + n_unconv, 0), 6) AS error_rate FROM t""")
def conversion_by_position(spark, sf_dir):
    return _r(reads.conversion(s.aligned(spark, sf_dir), s.genome(spark, sf_dir)))


@query("""SELECT CAST(l_linenumber AS BIGINT) AS base, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS conv, CAST(sum(CAST(l_quantity AS BIGINT) + l_suppkey % 7) AS BIGINT) AS total, CAST(sum(l_partkey % 3) AS BIGINT) AS errors,
  round(CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) / sum(CAST(l_quantity AS BIGINT) + l_suppkey % 7), 6) AS rate, round(CAST(sum(l_partkey % 3) AS DOUBLE) / sum(l_partkey % 3 + CAST(l_quantity AS BIGINT) + l_suppkey % 7), 6) AS error_rate FROM lineitem GROUP BY l_linenumber""")
def merge_rates(spark, sf_dir):
    q = F.col("l_quantity").cast("bigint")
    return _r(reads.merge_rates(s.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("base"), q.alias("conv"), (q + F.col("l_suppkey") % 7).alias("total"), (F.col("l_partkey") % 3).alias("errors"))))


def _mapped(spark, sf_dir):
    return s.table(spark, sf_dir, "lineitem").select(F.concat("l_orderkey", F.lit("."), "l_linenumber").alias("read"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 5).cast("string")).alias("chrom"), (F.col("l_partkey") % 997).alias("start"), F.when(F.col("l_returnflag") == "A", "+").otherwise("-").alias("strand"), F.repeat(F.lit("A"), (F.col("l_linenumber") % 3 + 1).cast("int")).alias("seq"))


_MAPPED = "mapped AS (SELECT 'chr' || CAST(l_suppkey % 5 AS VARCHAR) AS chrom, l_partkey % 997 AS start, l_partkey % 997 + l_linenumber % 3 + 1 AS \"end\", CASE WHEN l_returnflag = 'A' THEN '+' ELSE '-' END AS strand, l_linenumber % 3 + 1 AS size FROM lineitem)"


@query(f'WITH {_MAPPED} SELECT chrom, start, "end", strand, max(size) AS size, count(*) AS n FROM mapped GROUP BY chrom, start, "end", strand')
def dedup_reads(spark, sf_dir):
    return reads.dedup_reads(_mapped(spark, sf_dir)).select("chrom", "start", "end", "strand", F.length("seq").alias("size"), "n")


@query(f'WITH {_MAPPED}, c AS (SELECT count(*) AS copies FROM mapped GROUP BY chrom, start, "end", strand) SELECT copies, count(*) AS n FROM c GROUP BY copies')
def dup_histogram(spark, sf_dir):
    return reads.dup_histogram(_mapped(spark, sf_dir))


def _ends(spark, sf_dir):
    b = s.bases(spark, sf_dir)
    return b.select("read", F.col("seq").alias("seq1"), F.when(F.col("read") % 3 == 0, F.translate("seq", "TG", "CA")).otherwise(F.reverse("seq")).alias("seq2"))


_ENDS = s.BASES + ", ends AS (SELECT read, seq AS seq1, CASE WHEN read % 3 = 0 THEN translate(seq, 'TG', 'CA') ELSE reverse(seq) END AS seq2 FROM bases)"
_SAME = """i AS (SELECT read, seq1, seq2, unnest(range(1, length(seq1) + 1)) AS k FROM ends), ab AS (SELECT read, substr(seq1, CAST(k AS INTEGER), 1) AS a, substr(seq2, CAST(k AS INTEGER), 1) AS b FROM i),
same AS (SELECT read, count(*) FILTER (a = b OR a = 'T' AND b = 'C' OR a = 'G' AND b = 'A') / count(*) AS same FROM ab GROUP BY read)"""


@query(f"WITH {_ENDS}, {_SAME} SELECT read, round(same, 6) AS same, same > 0.95 AS hairpin FROM same")
def hairpin_filter(spark, sf_dir):
    return _r(reads.hairpins(_ends(spark, sf_dir)).select("read", "same", "hairpin"))


@query(f"WITH {_ENDS}, {_SAME} SELECT count(*) AS n, CAST(sum(CASE WHEN same > 0.95 THEN 1 ELSE 0 END) AS BIGINT) AS n_hairpin, round(avg(same) FILTER (same > 0.95), 6) AS mean_bad, round(avg(same) FILTER (same <= 0.95), 6) AS mean_good FROM same")
def hairpin_summary(spark, sf_dir):
    return _r(reads.hairpin_stats(_ends(spark, sf_dir)))


def _n(c: str, b: str) -> str:
    return f"(length({c}) - length(replace({c}, '{b}', '')))"


@query(f"""WITH {_ENDS}, t AS (SELECT count(*) AS n, CAST(sum(CASE WHEN {_n('seq1', 'T')} > {_n('seq1', 'A')} AND {_n('seq2', 'A')} > {_n('seq2', 'T')} THEN 1 ELSE 0 END) AS BIGINT) AS n_rich FROM ends)
SELECT n, n_rich, round(n_rich / n, 6) AS share, CASE WHEN n_rich / n >= 0.8 THEN 'original' WHEN n_rich / n <= 0.2 THEN 'pbat' WHEN n_rich / n BETWEEN 0.4 AND 0.6 THEN 'random' ELSE 'inconclusive' END AS protocol FROM t""")
def protocol_guess(spark, sf_dir):
    return _r(reads.guess_protocol(_ends(spark, sf_dir)))


@query(f"""WITH {s.EPIREADS}, e AS (SELECT chrom, cpg, states, unnest(range(0, length(states))) AS i FROM epireads), lv AS (SELECT chrom, cpg + i AS cpg, avg(CASE substr(states, CAST(i + 1 AS INTEGER), 1) WHEN 'C' THEN 1.0 ELSE 0.0 END) AS level FROM e WHERE substr(states, CAST(i + 1 AS INTEGER), 1) <> 'N' GROUP BY ALL),
win AS (SELECT chrom, cpg, states, unnest(range(greatest(0, cpg - 3), cpg + length(states))) AS w FROM epireads), pt AS (SELECT chrom, w, greatest(w, cpg) - w AS o, substr(states, CAST(greatest(w, cpg) - cpg + 1 AS INTEGER), CAST(least(w + 4, cpg + length(states)) - greatest(w, cpg) AS INTEGER)) AS s, count(*) AS n FROM win GROUP BY ALL),
k AS (SELECT p.*, unnest(range(0, 16)) AS k FROM pt p SEMI JOIN (SELECT DISTINCT chrom, unnest([cpg - 3, cpg - 2, cpg - 1, cpg]) AS w FROM lv) USING (chrom, w)),
pr AS (SELECT k.chrom, k.w, k.k, k.n, {" * ".join(f"(CASE WHEN {i} >= o AND {i} < o + length(s) AND substr(s, CAST({i} - o + 1 AS INTEGER), 1) <> 'N' THEN CASE WHEN (substr(s, CAST({i} - o + 1 AS INTEGER), 1) = 'C') = ((k.k >> {i}) % 2 = 1) THEN 1.0 ELSE 0.0 END ELSE CASE WHEN (k.k >> {i}) % 2 = 1 THEN coalesce(l{i}.level, 0.5) ELSE 1 - coalesce(l{i}.level, 0.5) END END)" for i in range(4))} AS p
  FROM k {" ".join(f"LEFT JOIN lv l{i} ON l{i}.chrom = k.chrom AND l{i}.cpg = k.w + {i}" for i in range(4))}),
st AS (SELECT chrom, w, k, sum(p * n) AS p, sum(n) AS n FROM pr GROUP BY ALL)
SELECT chrom, w AS "window", CAST(max(n) AS BIGINT) AS n_reads, round(sum(CASE WHEN p > 0 THEN -(p / n) * log2(p / n) ELSE 0.0 END) / 4, 6) AS entropy FROM st GROUP BY chrom, w""")
def sliding_entropy(spark, sf_dir):
    return _r(reads.entropy(s.epireads(spark, sf_dir)))


# -- sites, further --------------------------------------------------------------------------------------------

_SIDES = s.SAMPLES + """, a AS (SELECT chrom, pos // 2 * 2 AS pos, CAST(sum(n_reads) AS BIGINT) AS r, CAST(sum(n_meth) AS BIGINT) AS m FROM samples WHERE sample % 2 = 1 GROUP BY ALL), b AS (SELECT chrom, pos // 2 * 2 AS pos, CAST(sum(n_reads) AS BIGINT) AS r, CAST(sum(n_meth) AS BIGINT) AS m FROM samples WHERE sample % 2 = 0 GROUP BY ALL)"""


def _sides(spark, sf_dir):
    t = s.samples(spark, sf_dir).withColumn("pos", F.expr("pos div 2 * 2"))
    return [t.where(F.col("sample") % 2 == k).groupBy("chrom", "pos").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth")) for k in (1, 0)]


@query(f"WITH {_SIDES} SELECT chrom, pos, a.m AS meth_a, a.r - a.m AS unmeth_a, b.m AS meth_b, b.r - b.m AS unmeth_b FROM a JOIN b USING (chrom, pos) WHERE a.r > 0 AND b.r > 0")
def paired_sites(spark, sf_dir):
    return sites.paired(*_sides(spark, sf_dir))


@query(f"WITH {_SIDES} SELECT concat_ws(chr(9), chrom, pos, '+', 'CpG', a.m % 7, a.m, a.r - a.m, b.m, b.r - b.m) AS line FROM a JOIN b USING (chrom, pos) WHERE a.r > 0 AND b.r > 0")
def methdiff_rows(spark, sf_dir):
    both = sites.paired(*_sides(spark, sf_dir))
    return sites.methdiff_rows(both.withColumns({"strand": F.lit("+"), "context": F.lit("CpG"), "score": F.col("meth_a") % 7}))


@query(f"WITH {s.COLLAPSED} SELECT chrom, pos, n_reads AS r0, n_reads % 5 AS r1, n_meth AS m0, n_meth % 5 AS m1 FROM collapsed")
def lock_step(spark, sf_dir):
    t = s.collapsed(spark, sf_dir)
    other = t.select("chrom", "pos", (F.col("n_reads") % 5).alias("n_reads"), (F.col("n_meth") % 5).alias("n_meth"))
    return sites.lock_step(t, other).select("chrom", "pos", F.col("reads")[0].alias("r0"), F.col("reads")[1].alias("r1"), F.col("meth")[0].alias("m0"), F.col("meth")[1].alias("m1"))


@query(f"WITH {s.SITES} SELECT chrom, greatest(0, (pos + 99) // 100 - 1) AS bin, count(*) AS n, round(least(0.99, greatest(0.01, avg({_LEVEL}))), 6) AS level FROM sites WHERE n_reads > 0 GROUP BY ALL")
def array_bins(spark, sf_dir):
    return _r(sites.array_bins(s.sites(spark, sf_dir).where("n_reads > 0").select("chrom", "pos", (F.col("n_meth") / F.col("n_reads")).alias("meth")), 100))


@query(f"""WITH {s.SITES}, c AS (SELECT CAST(unnest(range(10, 200, 10)) AS BIGINT) AS size), b AS (SELECT size, chrom, greatest(0, (pos + size - 1) // size - 1) AS bin, sum(n_reads) AS r FROM sites, c GROUP BY ALL HAVING sum(n_reads) > 0),
x AS (SELECT size, count(*) FILTER (r >= {sites.reads_for_interval(0.8, 1 - 0.8)}) / count(*) AS share FROM b GROUP BY size) SELECT coalesce(min(size) FILTER (share >= 0.999), 200) AS size FROM x""")
def bin_size(spark, sf_dir):
    return sites.bin_size(s.sites(spark, sf_dir), 10, 200, 10, share=0.999)


@query(_ROI + """SELECT chrom, start, "end", concat_ws(':', name, n_sites, n_covered, n_meth, n_reads) AS name, round(CAST(n_meth AS DOUBLE) / n_reads, 6) AS score FROM f WHERE n_reads > 0""")
def roi_names(spark, sf_dir):
    return _r(sites.roi_names(sites.roi_stats(s.sites(spark, sf_dir), s.regions(spark, sf_dir))))


@query(f"""WITH {s.CROSSING}, {_UNION} SELECT chrom, start, "end", 'R' || (row_number() OVER (ORDER BY chrom, start) - 1) AS name FROM merged""")
def numbered_names(spark, sf_dir):
    return sites.numbered_names(intervals.union(s.crossing(spark, sf_dir)).select("chrom", "start", "end"), "R")


@query(f"""WITH {s.CROSSING}, {_UNION}, m AS (SELECT chrom, start, "end", 'R' || start AS name FROM merged), e AS (SELECT *, CASE WHEN start - lag("end") OVER (PARTITION BY chrom ORDER BY start) > 5 THEN 1 ELSE 0 END AS new FROM m), f AS (SELECT *, sum(new) OVER (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT chrom, min(start) AS start, max("end") AS "end", string_agg(name, '' ORDER BY start) AS name FROM f GROUP BY chrom, k""")
def merge_with_names(spark, sf_dir):
    r = intervals.union(s.crossing(spark, sf_dir)).select("chrom", "start", "end", F.lit(0).alias("score"), F.concat(F.lit("R"), F.col("start").cast("string")).alias("name"))
    return intervals.merge_near(r, 5, names=True).select("chrom", "start", "end", "name")


@query(f"WITH {s.SAMPLES} SELECT chrom, row_number() OVER (ORDER BY chrom) - 1 AS k FROM (SELECT DISTINCT chrom FROM samples)")
def chromosome_order(spark, sf_dir):
    t = s.samples(spark, sf_dir)
    of = [t.where(F.col("sample") == k).select("chrom", F.substr("chrom", F.lit(4)).cast("int").alias("at")) for k in (1, 2)]
    return spark.createDataFrame(list(enumerate(sites.chromosome_order(of))), "k long, chrom string").select("chrom", "k")


@query(f"""WITH {s.SITES} SELECT count(*) FILTER (context = 'CpG') AS cpg, count(*) FILTER (context IN ('CXG', 'CCG')) AS chg, count(*) FILTER (context <> 'CpG') AS ch, count(*) AS all_sites FROM sites""")
def site_types(spark, sf_dir):
    marked = s.sites(spark, sf_dir).withColumn("context", F.concat("context", F.when(F.col("pos") % 2 == 0, "x").otherwise("")))
    return marked.agg(*[F.sum(site_type(F.col("context"), k).cast("bigint")).alias(n) for k, n in (("CpG", "cpg"), ("CHG", "chg"), ("CH", "ch"), ("all", "all_sites"))])


@query(r"""SELECT p_partkey, CASE WHEN length(p_name) > 3 THEN left(p_name, length(p_name) - 3) ELSE p_name END AS stripped, regexp_replace('x' || p_partkey || '.tar.gz', '\.[^.]*$', '') AS base FROM part""")
def stripped_names(spark, sf_dir):
    path = F.concat(F.lit("/some/dir.d/x"), F.col("p_partkey").cast("string"), F.lit(".tar.gz"))
    return s.table(spark, sf_dir, "part").select("p_partkey", strip_suffix(F.col("p_name"), 3).alias("stripped"), strip_extension(path).alias("base"))


@query(f"""WITH {s.COLLAPSED}, p AS (SELECT a.chrom, a.pos, a.n_reads, b.pos - a.pos AS d, b.n_reads AS r, b.n_meth AS m, 1 - power((b.pos - a.pos) / 51.0, 2) AS w FROM collapsed a JOIN collapsed b ON a.chrom = b.chrom AND b.pos BETWEEN a.pos - 50 AND a.pos + 50),
t AS (SELECT chrom, pos, sum(w * r) AS s0, sum(w * r * d) AS s1, sum(w * r * d * d) AS s2, sum(w * m) AS t0, sum(w * m * d) AS t1 FROM p GROUP BY ALL)
SELECT chrom, pos, round(CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-9 THEN least(1.0, greatest(0.0, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1))) ELSE t0 / s0 END, 6) AS smooth FROM t""")
def local_linear(spark, sf_dir):
    return _r(sites.local_linear(s.collapsed(spark, sf_dir), 50).select("chrom", "pos", "smooth"))


# -- reads, further --------------------------------------------------------------------------------------------


@query(f"""WITH {_MAPPED}, c AS (SELECT count(*) AS copies FROM mapped GROUP BY chrom, start, "end", strand)
SELECT CAST(sum(copies) AS BIGINT) AS reads_in, count(*) AS reads_out, CAST(sum(copies) - count(*) AS BIGINT) AS removed, round((sum(copies) - count(*)) / sum(copies), 6) AS share, round(avg(copies) FILTER (copies > 1), 6) AS copies_of_duplicated FROM c""")
def dup_rates(spark, sf_dir):
    return _r(reads.dup_rates(_mapped(spark, sf_dir)))


@query(f"""WITH {_ENDS}, {_SAME}, f AS (SELECT * FROM same ORDER BY read LIMIT 50) SELECT count(*) AS n, count(*) FILTER (same > 0.95) AS n_hairpin, round(count(*) FILTER (same > 0.95) / count(*), 6) AS share, count(*) FILTER (same > 0.95) / count(*) > 0.1 AS needed FROM f""")
def hairpin_check(spark, sf_dir):
    return _r(reads.hairpin_check(_ends(spark, sf_dir), 50))


_PATTERNS = f"""{_BASES}, idx AS (SELECT chrom, pos, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS cpg FROM gb WHERE b = 'C' AND a1 = 'G'), {_READS.replace(s.GENOME + ", ", "")},
st AS (SELECT r.read, r.chrom, i.cpg, CASE WHEN r.base IN ('C', 'T') THEN r.base ELSE 'N' END AS s FROM rbase r JOIN idx i ON i.chrom = r.chrom AND i.pos = r.pos - CASE r.strand WHEN '+' THEN 0 ELSE 1 END),
er AS (SELECT read, chrom, min(cpg) AS cpg, string_agg(s, '' ORDER BY cpg) AS states FROM st GROUP BY ALL HAVING count(*) FILTER (s <> 'N') > 0)"""


@query(f"WITH {_PATTERNS} SELECT * FROM er")
def read_states(spark, sf_dir):
    return reads.epireads(s.aligned(spark, sf_dir), s.genome(spark, sf_dir))


@query(f"""WITH {_PATTERNS} SELECT a.chrom, start, start + length(seq) AS "end", strand, coalesce(states, '') AS states, count(*) AS n FROM aligned a LEFT JOIN er ON er.read = a.read AND er.chrom = a.chrom GROUP BY ALL""")
def dedup_patterns(spark, sf_dir):
    return reads.dedup_patterns(s.aligned(spark, sf_dir), s.genome(spark, sf_dir)).drop("read")


_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"


@query(f"WITH {s.RECORDS} SELECT qname, flag, rname, pos, CASE WHEN flag & 16 <> 0 THEN {_RC} ELSE seq END AS seq, CASE WHEN k % 2 = 0 THEN 'NM:i:1,XR:Z:CT,CV:A:T' ELSE 'NM:i:1,XR:Z:GA,CV:A:A' END AS tags FROM records")
def standardized_bsmap(spark, sf_dir):
    return reads.standardized(s.records(spark, sf_dir), "bsmap").select("qname", "flag", "rname", "pos", "seq", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {s.RECORDS} SELECT 'r' || k AS qname, flag, rname, pos, CASE WHEN flag & 16 <> 0 THEN {_RC} ELSE seq END AS seq, CASE WHEN k % 2 = 0 THEN 'NM:i:1,CV:A:T' ELSE 'NM:i:1,CV:A:A' END AS tags FROM records")
def standardized_bismark(spark, sf_dir):
    return reads.standardized(s.records(spark, sf_dir), "bismark").select("qname", "flag", "rname", "pos", "seq", F.array_join("tags", ",").alias("tags"))


@query(f"""WITH {s.RECORDS}, std AS (SELECT 'r' || k AS qname, flag, pos, k, CASE WHEN flag & 16 <> 0 THEN {_RC} ELSE seq END AS seq FROM records)
SELECT qname, CASE WHEN k % 2 = 1 THEN xor(flag, 16) ELSE flag END AS flag, pos, CASE WHEN k % 2 = 1 THEN {_RC} ELSE seq END AS seq, 'NM:i:1,CV:A:T' AS tags FROM std""")
def conversion_flipped(spark, sf_dir):
    return reads.conversion_flipped(reads.standardized(s.records(spark, sf_dir), "bismark")).select("qname", "flag", "pos", "seq", F.array_join("tags", ",").alias("tags"))


_SECOND = "reverse(translate(reverse(translate(s2, 'ACGT', 'TGCA')), 'ACGT', 'TGCA'))"


@query(f"""WITH {s.RECORDS}, g AS (SELECT 'r' || k AS name, pos, other - pos AS head, other + 30 - pos AS size, s1, s2 FROM ends)
SELECT name AS qname, pos, CASE WHEN head >= 20 THEN 'gap' WHEN head >= 0 THEN 'overlap' ELSE 'dovetail' END AS kind, size,
  CASE WHEN head = 20 THEN '50M' WHEN head > 20 THEN '20M' || (head - 20) || 'N30M' WHEN head >= 0 THEN (head + 30) || 'M' ELSE least(20, size) || 'M' END AS cigar,
  CASE WHEN head >= 20 THEN s1 || {_SECOND} WHEN head >= 0 THEN left(s1, CAST(head AS INTEGER)) || {_SECOND} ELSE left(s1, CAST(least(20, size) AS INTEGER)) END AS seq FROM g""")
def merged_records(spark, sf_dir):
    std = reads.standardized(s.records(spark, sf_dir), "bismark")
    return reads.merged_records(std, suffix=0).select("qname", "pos", "kind", F.col("size").cast("bigint").alias("size"), "cigar", "seq")


# -- models ----------------------------------------------------------------------------------------------------

_ISLANDS = """SELECT *, sum(CASE WHEN (pos // 40) % 4 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM {t}"""


# the planted domains are what a model that works finds; none of the null's is as long
@query(f"""WITH {s.PLANTED}, b AS ({_ISLANDS.format(t="planted")}), d AS (SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n, round(sum(1 - CAST(n_meth AS DOUBLE) / n_reads), 4) AS score, CAST(0 AS DOUBLE) AS p FROM b WHERE (pos // 40) % 4 = 1 GROUP BY chrom, k)
SELECT *, 'HYPO' || (row_number() OVER (ORDER BY chrom, start) - 1) AS name FROM d""")
def hmr_domains(spark, sf_dir):
    return _r(models.hypomethylated_regions(s.planted(spark, sf_dir), desert=60), 4)


@query(f"""WITH {s.PLANTED_TWO}, covered AS (SELECT * FROM planted_two WHERE r0 > 0 OR r1 > 0), b AS ({_ISLANDS.format(t="covered")}), d AS (SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n, round(sum(CASE WHEN r0 > 0 THEN 1 - CAST(m0 AS DOUBLE) / r0 ELSE 0 END + CASE WHEN r1 > 0 THEN 1 - CAST(m1 AS DOUBLE) / r1 ELSE 0 END) / 2, 4) AS score, CAST(0 AS DOUBLE) AS p FROM b WHERE (pos // 40) % 4 = 1 GROUP BY chrom, k)
SELECT *, 'HYPO' || (row_number() OVER (ORDER BY chrom, start) - 1) AS name FROM d""")
def hmr_rep_domains(spark, sf_dir):
    return _r(models.hypomethylated_regions(s.planted(spark, sf_dir, replicates=True), desert=60, replicates=2), 4)


def _planted_bins(spark, sf_dir):
    return s.planted(spark, sf_dir).select("chrom", "pos", "n_reads", "n_meth")


@query(f"""WITH {s.PLANTED}, b AS ({_ISLANDS.format(t="planted")}), d AS (SELECT chrom, min(pos) - 2 AS start, max(pos) AS "end", CAST(count(*) AS DOUBLE) AS score, 1 AS n FROM b WHERE (pos // 40) % 4 = 1 GROUP BY chrom, k)
SELECT *, 'PMD' || (row_number() OVER (ORDER BY chrom, start) - 1) AS name FROM d""")
def pmd_domains(spark, sf_dir):
    return _r(models.partial_domains(sites.bins(_planted_bins(spark, sf_dir), 2), 2), 4)


@query()
def pmd_boundaries(spark, sf_dir):
    t = _planted_bins(spark, sf_dir)
    return _r(models.partial_domains(sites.bins(t, 2), 2, sites=t), 4)


@query()
def pmd_rep_domains(spark, sf_dir):
    t = s.planted(spark, sf_dir, replicates=True)
    bin_ = F.greatest(F.lit(0), F.expr("(pos + 1) div 2") - 1)
    two = t.groupBy("chrom", bin_.alias("bin")).agg(*[F.array(F.sum(F.col(c)[0]), F.sum(F.col(c)[1])).alias(c) for c in ("reads", "meth")])
    return _r(models.partial_domains(two, 2, replicates=2), 4)


@query()
def hypermr_domains(spark, sf_dir):
    return _r(models.hyper_domains(s.planted(spark, sf_dir), desert=60), 4)


@query()
def transition_scores(spark, sf_dir):
    rows = models.observations(s.planted(spark, sf_dir), 60)
    model = models.Hmm((0.5, 0.5), ((0.9, 0.1), (0.1, 0.9)), (((2.0, 20.0),), ((20.0, 2.0),)), (0, 1))
    return _r(models.decode(rows, model).select("chrom", "pos", "into", "out_of"), 4)


@query()
def amr_windows(spark, sf_dir):
    return _r(models.amr_windows(s.epireads(spark, sf_dir)), 4)


@query()
def amr_regions(spark, sf_dir):
    return _r(models.amrs(models.amr_windows(s.epireads(spark, sf_dir))), 4)


def _ordinals(spark, sf_dir):
    """A place for each CpG ordinal of the stand-in epireads."""
    reach = s.epireads(spark, sf_dir).groupBy("chrom").agg(F.max(F.col("cpg") + F.length("states")).alias("n"))
    return reach.select("chrom", F.explode(F.sequence(F.lit(0), F.col("n") + 10)).alias("cpg")).select("chrom", "cpg", (7 * F.col("cpg") + F.col("cpg") % 3).alias("pos"))


@query()
def amr_base_pairs(spark, sf_dir):
    return _r(models.amr_regions(models.amr_windows(s.epireads(spark, sf_dir)), _ordinals(spark, sf_dir), gap=100), 4)


@query(f"""WITH {s.EPIREADS} SELECT chrom, 7 * cpg + cpg % 3 AS start, 7 * (cpg + length(states)) + (cpg + length(states)) % 3 AS "end", states FROM epireads""")
def ordinals_to_base_pairs(spark, sf_dir):
    r = s.epireads(spark, sf_dir).select("chrom", F.col("cpg").alias("start"), (F.col("cpg") + F.length("states")).alias("end"), "states")
    return models.to_base_pairs(r, _ordinals(spark, sf_dir))

@query()
def amr_given_regions(spark, sf_dir):
    r = s.table(spark, sf_dir, "part").select(F.concat(F.lit("chr"), (F.col("p_partkey") % 3).cast("string")).alias("chrom"), (8 * F.expr("p_partkey div 3")).alias("start"), (8 * F.expr("p_partkey div 3") + 8).alias("end"))
    return _r(models.amr_test(s.epireads(spark, sf_dir), r), 4)


@query(f"""WITH {s.BASES}, m AS (SELECT read // 2 AS pair, 'g' AS chrom, read % 2 * 50 + read % 7 AS start, seq FROM bases), p AS (SELECT pair, count(*) AS k FROM m GROUP BY pair)
SELECT CASE WHEN k = 2 THEN 2 ELSE 1 END AS mates, count(DISTINCT pair) AS pairs FROM m JOIN p USING (pair) GROUP BY ALL""")
def mate_merge_counts(spark, sf_dir):
    b = s.bases(spark, sf_dir)
    m = b.select(F.concat(F.expr("read div 2"), F.lit("/"), F.col("read") % 2).alias("name"), F.lit("g").alias("chrom"), (F.col("read") % 2 * 50 + F.col("read") % 7).alias("start"), F.lit("+").alias("strand"), "seq")
    return reads.merge_mates(m, longest=1 << 40).groupBy("mates").agg(F.countDistinct("pair").alias("pairs"))


@query(f"""WITH {s.COLLAPSED} SELECT chrom, pos, n_reads, n_meth, CASE WHEN lag(chrom) OVER w IS NOT NULL THEN pos - lag(pos) OVER w END AS gap FROM collapsed WINDOW w AS (PARTITION BY chrom ORDER BY pos)""")
def site_distances(spark, sf_dir):
    return sites.distances(s.collapsed(spark, sf_dir)).select("chrom", "pos", "n_reads", "n_meth", "gap")


def _designed(spark, sf_dir):
    t = s.samples(spark, sf_dir).withColumn("pos", F.expr("pos div 2 * 2")).groupBy("chrom", "pos", "sample").agg(F.sum("n_reads").alias("n_reads"), F.sum("n_meth").alias("n_meth"))
    rows = t.groupBy("chrom", "pos").agg(F.collect_list(F.struct("sample", "n_reads", "n_meth")).alias("counts"))
    return models.regression(rows, {k: (1, int(k > 3)) for k in SAMPLES}, 1)


@query()
def regression_pvalues(spark, sf_dir):
    return _r(_designed(spark, sf_dir), 4)


@query()
def adjusted_pvalues(spark, sf_dir):
    rows = settled(_designed(spark, sf_dir).select("chrom", "pos", "p"))
    corr = significance.distance_correlation(rows.where("p >= 0"), significance.probit(1 - F.col("p")), 1, 41, 10)
    return _r(significance.adjusted(rows, corr, 40, 10).select("combined_p", "chrom", "pos", "p", "q"), 4)


_TOL = "1e-10"


def _snap(x: str) -> str:
    return f"CASE WHEN {x} <= 2 * {_TOL} THEN 0.0 WHEN {x} >= 1 - 2 * {_TOL} THEN 1.0 ELSE {x} END"


def _apart(value: str, a: str, b: str) -> str:
    z, n = z_of(0.05), f"({a} + {b})"
    p = f"({a} / {n})"
    half = f"{z!r} * sqrt({p} * (1 - {p}) / {n} + {z * z!r} / (4 * {n} * {n}))"
    mid, scale = f"({p} + {z * z!r} / (2 * {n}))", f"(1 + {z * z!r} / {n})"
    return f"CASE WHEN {n} > 0 AND {value} < least(1.0, ({mid} + {half}) / {scale}) AND {value} > greatest(0.0, ({mid} - {half}) / {scale}) THEN 0 ELSE 1 END"


# expectation-maximisation as a recursive query
@query(f"""WITH RECURSIVE {s.ASSAYS}, c AS (SELECT *, (h + g > 0)::INT + (t + u > 0)::INT + (m + l > 0)::INT > 1 AS enough, h + g > 0 AND t + u > 0 AND m + l > 0 AND h / nullif(h + g, 0) + m / nullif(m + l, 0) + u / nullif(t + u, 0) = 1 AS sure FROM assays),
s0 AS (SELECT *, m / (m + l + {_TOL}) + {_TOL} AS a, h / (h + g + {_TOL}) + {_TOL} AS b, u / (t + u + {_TOL}) + {_TOL} AS d FROM c WHERE enough AND NOT sure),
em AS (SELECT chrom, pos, h, g, t, u, m, l, a / (a + b + d) AS p, b / (a + b + d) AS q, 0 AS k, 1.0::DOUBLE AS moved FROM s0
  UNION ALL SELECT chrom, pos, h, g, t, u, m, l, p2, greatest({_TOL}, least(q1, 1 - {_TOL} - p2)), k + 1, greatest(abs(p2 - p), abs(greatest({_TOL}, least(q1, 1 - {_TOL} - p2)) - q)) FROM (
    SELECT *, greatest({_TOL}, least(p1, 1 - 2 * {_TOL})) AS p2, (h + t - ot) / (h + u + t - ot + g - og) * (1 - p1) AS q1 FROM (
      SELECT *, (m + ot + og) / (h + g + t + u + m + l) AS p1 FROM (SELECT *, t * p / (p + q) AS ot, g * p / (1 - q) AS og FROM em WHERE moved > {_TOL} AND k <= 500)))),
f AS (SELECT chrom, pos, arg_max(p, k) AS p, arg_max(q, k) AS q FROM em GROUP BY chrom, pos), r AS (SELECT c.*, {_snap("f.p")} AS pm, {_snap("f.q")} AS ph, {_snap("(1 - f.p - f.q)")} AS pu FROM c JOIN f USING (chrom, pos))
SELECT chrom, pos, round(pm, 4) AS pm, round(ph, 4) AS ph, round(pu, 4) AS pu, CAST({_apart("ph", "h", "g")} + {_apart("pm", "m", "l")} + {_apart("pu", "u", "t")} AS BIGINT) AS conflicts FROM r
UNION ALL SELECT chrom, pos, CASE WHEN sure THEN round(m / (m + l), 4) END, CASE WHEN sure THEN round(h / (h + g), 4) END, CASE WHEN sure THEN round(u / (t + u), 4) END, CASE WHEN sure THEN 0 END FROM c WHERE NOT enough OR sure""")
def mlml_levels(spark, sf_dir):
    return _r(models.joint_levels(s.assays(spark, sf_dir)), 4)


def _two_sql(x: str, y: str, v: str, w: str, names: tuple) -> str:
    """SQL of joint_levels_two(): names are the shares of the first assay, the second, and the rest."""
    return f"""WITH RECURSIVE {s.ASSAYS}, c AS (SELECT chrom, pos, {x} AS x, {y} AS y, {v} AS v, {w} AS w, {x} + {y} > 0 AND {v} + {w} > 0 AS enough FROM assays),
d AS (SELECT *, CASE WHEN enough THEN x / (x + y) END AS a, CASE WHEN enough THEN v / (v + w) END AS b FROM c), s0 AS (SELECT *, {_TOL} + a AS p0, {_TOL} + b AS q0 FROM d WHERE a + b > 1),
s1 AS (SELECT *, greatest({_TOL}, (1 - {_TOL}) * p0 / (p0 + q0)) AS p FROM s0),
em AS (SELECT chrom, pos, x, y, v, w, p, greatest({_TOL}, 1 - p - {_TOL}) AS q, 0 AS k, 1.0::DOUBLE AS moved FROM s1
  UNION ALL SELECT chrom, pos, x, y, v, w, p2, greatest({_TOL}, least(q1, 1 - {_TOL} - p2)), k + 1, greatest(abs(p2 - p), abs(greatest({_TOL}, least(q1, 1 - {_TOL} - p2)) - q)) FROM (
    SELECT *, greatest({_TOL}, least(x / (x + y - e) * (1 - q1), 1 - 2 * {_TOL})) AS p2 FROM (SELECT *, (v + e) / (x + y + v + w) AS q1 FROM (SELECT *, y * q / (1 - p) AS e FROM em WHERE moved > {_TOL} AND k <= 500)))),
f AS (SELECT chrom, pos, arg_max(p, k) AS p, arg_max(q, k) AS q FROM em GROUP BY chrom, pos),
r AS (SELECT d.*, {_snap("f.p")} AS {names[0]}, {_snap("f.q")} AS {names[1]}, {_snap("(1 - f.p - f.q)")} AS {names[2]} FROM d JOIN f USING (chrom, pos)),
o AS (SELECT chrom, pos, pm, ph, pu, {_apart(names[0], "x", "y")} + {_apart(names[1], "v", "w")} AS conflicts FROM r
  UNION ALL SELECT chrom, pos, pm, ph, pu, CASE WHEN enough THEN 0 END FROM (SELECT *, a AS {names[0]}, b AS {names[1]}, 1 - a - b AS {names[2]} FROM d WHERE NOT enough OR a + b <= 1))
SELECT chrom, pos, round(pm, 4) + 0.0 AS pm, round(ph, 4) + 0.0 AS ph, round(pu, 4) + 0.0 AS pu, CAST(conflicts AS BIGINT) AS conflicts FROM o"""


@query(_two_sql("h", "g", "u", "t", ("ph", "pu", "pm")))
def mlml_tab_bisulfite(spark, sf_dir):
    return _r(models.joint_levels_two(s.assays(spark, sf_dir), "oxidative"), 4)


@query(_two_sql("u", "t", "m", "l", ("pu", "pm", "ph")))
def mlml_bisulfite_oxidative(spark, sf_dir):
    return _r(models.joint_levels_two(s.assays(spark, sf_dir), "tab"), 4)


@query(_two_sql("m", "l", "h", "g", ("pm", "ph", "pu")))
def mlml_oxidative_tab(spark, sf_dir):
    return _r(models.joint_levels_two(s.assays(spark, sf_dir), "bisulfite"), 4)


@query(f"""WITH {s.TWO_GROUPS}, k AS (SELECT *, unnest(range(greatest(0, meth_a - unmeth_b), least(meth_a + unmeth_a, meth_a + meth_b) + 1)) AS j FROM two_groups),
w AS (SELECT chrom, pos, meth_a, unmeth_a, {_lc('(meth_a + unmeth_a)', 'j')} + {_lc('(meth_b + unmeth_b)', '(meth_a + meth_b - j)')} AS l, {_lc('(meth_a + unmeth_a)', 'meth_a')} + {_lc('(meth_b + unmeth_b)', 'meth_b')} AS h, {_lc('(meth_a + unmeth_a + meth_b + unmeth_b)', '(meth_a + meth_b)')} AS t FROM k),
f AS (SELECT chrom, pos, meth_a AS n_meth, meth_a + unmeth_a AS n_reads, least(1.0, sum(exp(l - t)) FILTER (l <= h + 1e-9)) AS p FROM w GROUP BY ALL) SELECT chrom, pos, round(round(p, 10), 6) AS p, round(round({_LOW}, 10), 6) AS low, round(round({_HIGH}, 10), 6) AS high FROM f""")
def fisher_sql(spark, sf_dir):
    """The kernels from SQL."""
    significance.register(spark)
    s.two_groups(spark, sf_dir).createOrReplaceTempView("two_groups_of_sites")
    return _r(_r(spark.sql(f"SELECT chrom, pos, fisher_2x2(meth_a, unmeth_a, meth_b, unmeth_b) AS p, wilson_lo(meth_a, meth_a + unmeth_a, {_Z!r}) AS low, wilson_hi(meth_a, meth_a + unmeth_a, {_Z!r}) AS high FROM two_groups_of_sites"), 10))


# -- files, streams, groups and further models -------------------------------------------------------------------


@query(f"""WITH {s.GENOME}, p AS (SELECT chrom, seq, unnest(range(0, (length(seq) - 1) // 4096 + 1)) AS piece FROM genome)
SELECT chrom, CAST(piece AS INTEGER) AS piece, CASE WHEN piece > 0 THEN 2 ELSE 0 END AS before,
  substr(seq, CAST(greatest(1, piece * 4096 - 1) AS INTEGER), CAST(CASE WHEN piece > 0 THEN 4100 ELSE 4098 END AS INTEGER)) AS seq FROM p""")
def genome_pieces(spark, sf_dir):
    """The genome written as FASTA, with lines of 70 bases, and read again by byte ranges of a megabyte."""
    path = f"{shared_folder(spark)}/fasta-{uuid.uuid4().hex}"
    lines = F.regexp_replace("seq", "(.{1,70})", "$1\n")
    s.genome(spark, sf_dir).select(F.concat(F.lit(">"), "chrom", F.lit(" made of a text\n"), lines).alias("value")).write.text(path)
    return files.read_genome(spark, path, size=1 << 20).withColumn("seq", F.col("seq").cast("string"))


@query(f"WITH {s.BASES} SELECT count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS n_bases, CAST(sum(CASE WHEN seq LIKE 'A%' THEN 1 ELSE 0 END) AS BIGINT) AS n_a, min(read) AS first, max(read) AS last FROM bases")
def fastq_records(spark, sf_dir):
    """Reads written as FASTQ, with qualities of @ and +, and read again by byte ranges."""
    path = f"{shared_folder(spark)}/fastq-{uuid.uuid4().hex}"
    qualities = F.translate("seq", "ACGT", "@+I!")
    s.bases(spark, sf_dir).select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("read").cast("string"), F.lit(" x")), "seq", F.lit("+"), qualities).alias("value")).write.text(path)
    t = ranges.fastq_records(spark, path, size=1 << 20)
    good = t.where(F.translate("seq", "ACGT", "@+I!") == F.col("qual"))
    return good.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("n_bases"), F.sum(F.col("seq").startswith("A").cast("bigint")).alias("n_a"), F.min(F.col("name").cast("bigint")).alias("first"), F.max(F.col("name").cast("bigint")).alias("last"))


@query(f"WITH {s.RECORDS} SELECT qname, flag, rname, pos, seq FROM records")
def sam_round_trip(spark, sf_dir):
    """Records written as SAM with a header, and read again."""
    path = f"{shared_folder(spark)}/sam-{uuid.uuid4().hex}"
    sam.write_sam(s.records(spark, sf_dir), path, sam.with_program(["@HD\tVN:1.6"], "query"))
    return sam.read_records(spark, path).select("qname", "flag", "rname", "pos", "seq")


@query(ORACLE["merged_records"])
def streamed_mates(spark, sf_dir):
    """merged_records of the records as a stream, in several micro-batches; a last record moves the time on."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    std = reads.standardized(s.records(spark, sf_dir), "bismark").select("qname", "flag", "rname", "pos", "cigar", "rnext", "pnext", "seq", "tags")
    # within 20 seconds of the epoch's second day: a stream's watermark begins at the epoch
    timed = std.withColumn("ts", F.timestamp_millis(F.lit(86_400_000) + F.pmod(F.hash("qname", "flag"), F.lit(20_000))))
    timed.repartition(6).write.parquet(f"{path}/in/a")
    last = std.limit(1).withColumns({"qname": F.lit("last"), "rname": F.lit("none"), "ts": F.timestamp_millis(F.lit(10**9))})
    last.write.parquet(f"{path}/in/b")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        source = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(f"{path}/in")
        out = mates.streamed_mates(source, wait=60_000, late="1 hour", suffix=0).where("rname <> 'none'")
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(store, before)
    return spark.read.schema(out.schema).parquet(f"{path}/out").select("qname", "pos", "kind", F.col("size").cast("bigint").alias("size"), "cigar", "seq")


@query(f"""WITH {s.REGIONS}, {s.CROSSING}, first AS (SELECT x.name AS item, x.start AS item_start, x."end" AS item_end, x.chrom, min(struct_pack(a := r.start, b := r."end", c := r.name)) AS r
  FROM crossing x JOIN regions r ON x.chrom = r.chrom AND x.start < r."end" AND r.start < x."end" GROUP BY ALL),
held AS (SELECT chrom, r.a AS start, r.b AS "end", r.c AS name, min(item_start) AS low, max(item_end) AS high, count(*) AS n FROM first GROUP BY ALL)
SELECT g.chrom, least(g.start, coalesce(low, g.start)) AS start, greatest(g."end", coalesce(high, g."end")) AS "end", g.name, coalesce(n, 0) AS n FROM regions g LEFT JOIN held h ON g.chrom = h.chrom AND g.start = h.start AND g."end" = h."end" AND g.name = h.name""")
def region_clusters(spark, sf_dir):
    regions = s.regions(spark, sf_dir)
    return intervals.adjusted_regions(regions, intervals.clustered(s.crossing(spark, sf_dir), regions))


# choices of signs by their rank sums, one rank after another; and the normal distribution's upper tail from the series of its density
_SIGNED = """ways(n, w, c) AS (SELECT 0, 0, CAST(1 AS DOUBLE) UNION ALL (WITH more AS (SELECT n + 1 AS n, w, c FROM ways WHERE n < 30 UNION ALL SELECT n + 1, w + n + 1, c FROM ways WHERE n < 30) SELECT n, w, sum(c) FROM more GROUP BY n, w)),
upto AS (SELECT n, w, sum(c) OVER (PARTITION BY n ORDER BY w) / pow(2, n) AS f FROM ways)"""


@query(f"""WITH RECURSIVE {s.TWO_GROUPS}, {_SIGNED}, d AS (SELECT chrom, pos // 40 AS block, CAST(meth_a AS DOUBLE) / (meth_a + unmeth_a) - CAST(meth_b AS DOUBLE) / (meth_b + unmeth_b) AS d FROM two_groups),
k AS (SELECT chrom, block, d, (rank() OVER (PARTITION BY chrom, block ORDER BY abs(d)) + rank() OVER (PARTITION BY chrom, block ORDER BY abs(d)) + count(*) OVER (PARTITION BY chrom, block, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
g AS (SELECT chrom, block, count(*) AS n, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_greater, CAST(sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_greater, CAST(sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_less FROM k GROUP BY chrom, block),
a AS (SELECT b.chrom, b.block, coalesce(n, 0) AS n, coalesce(n_greater, 0) AS n_greater, coalesce(w_greater, 0.0) AS w_greater, coalesce(w_less, 0.0) AS w_less FROM (SELECT DISTINCT chrom, block FROM d) b LEFT JOIN g ON b.chrom = g.chrom AND b.block = g.block)
SELECT chrom, block, a.n, n_greater, w_greater, w_less, round(CASE WHEN a.n = 0 THEN 1 ELSE 1 - u.f END, 6) AS p_greater, round(CASE WHEN a.n = 0 THEN 1 ELSE 1 - v.f END, 6) AS p_less
FROM a LEFT JOIN upto u ON u.n = a.n AND u.w = CAST(floor(greatest(w_greater - 1, 0)) AS INTEGER) LEFT JOIN upto v ON v.n = a.n AND v.w = CAST(floor(greatest(w_less - 1, 0)) AS INTEGER)""")
def signed_rank_tests(spark, sf_dir):
    level = lambda x: F.col(f"meth_{x}").cast("double") / (F.col(f"meth_{x}") + F.col(f"unmeth_{x}"))
    t = s.two_groups(spark, sf_dir).select("chrom", F.expr("pos div 40").alias("block"), level("a").alias("a"), level("b").alias("b"))
    return _r(distributions.paired_tests(t, ["chrom", "block"], "a", "b").drop("sign_greater", "sign_less"))


@query(f"""WITH {s.SAMPLES}, r AS (SELECT chrom, CAST(n_reads AS DOUBLE) AS v, CAST(n_meth + 1 AS DOUBLE) AS w, CAST(1 + sample % 3 AS DOUBLE) AS s FROM samples)
SELECT chrom, sum(w) AS total, round(sum(w * v) / sum(w * s), 6) AS poisson, round(sum(w * (v / s)) / sum(w), 6) AS exponential, round(sum(w) / sum(w * (v / s)), 6) AS geometric, round(sum(w * (v / s)) / sum(w) / 500, 6) AS binomial FROM r GROUP BY chrom""")
def weighted_fits(spark, sf_dir):
    """The families whose weighted fits are quotients of sums."""
    t = s.samples(spark, sf_dir)
    fit = lambda family, **o: distributions.fit_family(t, family, ["chrom"], "n_reads", F.col("n_meth") + 1, 1 + F.col("sample") % 3, **o)
    out = fit("poisson").withColumnRenamed("mean", "poisson")
    for family, name in (("exponential", "mean"), ("geometric", "p"), ("binomial", "p")):
        out = out.join(fit(family, trials=500).select("chrom", F.col(name).alias(family)), "chrom")
    return _r(out)


@query()
def shape_fits(spark, sf_dir):
    """The families whose fits need steps; tests hold them to be the likeliest."""
    t = s.samples(spark, sf_dir).where("n_reads > 0")
    level = (F.col("n_meth") + 0.5) / (F.col("n_reads") + 1)
    fit = lambda family, c, names: distributions.fit_family(t.withColumn("x", c), family, ["chrom"], "x", "n_reads").select("chrom", *names)
    out = fit("gamma", F.col("n_reads"), ["shape", "scale"]).join(fit("beta", level, ["alpha", "beta"]), "chrom")
    return _r(out.join(fit("negative_binomial", F.col("n_reads"), ["mean", "overdispersion"]), "chrom"), 4)


@query(f"""WITH {s.COLLAPSED}, c AS (SELECT chrom, pos, (pos // 40) % 4 AS k, sum(CASE WHEN (pos // 40) % 2 = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS i FROM collapsed)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n, round(CAST(count(*) * CASE WHEN k = 1 THEN 0.6 ELSE -0.6 END AS DOUBLE), 4) AS score, CASE WHEN k = 1 THEN 'gain' ELSE 'loss' END AS state FROM c WHERE k % 2 = 1 GROUP BY chrom, i, k""")
def duration_domains(spark, sf_dir):
    t = s.changed(spark, sf_dir)
    model, _ = durations.train(t, gap=60)
    return _r(durations.changed_domains(durations.decode(t, model, gap=60), t).drop("post"), 4)


@query()
def duration_domains_scored(spark, sf_dir):
    """Domains with an empirical p-value from random windows, those below the rate's cutoff."""
    t = s.changed(spark, sf_dir)
    model, _ = durations.train(t, gap=60, iterations=5)
    found = durations.changed_domains(durations.decode(t, model, gap=60), t)
    return _r(durations.significant(settled(durations.scored_by_windows(found, t)), 0.05), 4)


@query()
def duration_domains_ranked(spark, sf_dir):
    """Domains with the signed-rank test's p-value, those below the rate's cutoff."""
    t = s.changed(spark, sf_dir)
    model, _ = durations.train(t, gap=60, iterations=5)
    found = durations.changed_domains(durations.decode(t, model, gap=60), t)
    return _r(durations.significant(settled(durations.scored_by_ranks(found, t)), 0.05), 4)


@query(f"""WITH {s.PLANTED}, b AS ({_ISLANDS.format(t="planted")})
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS n, CAST(count(*) AS DOUBLE) AS score FROM b WHERE (pos // 40) % 4 = 1 GROUP BY chrom, k""")
def rate_domains(spark, sf_dir):
    """Runs of the low state of the continuous-time model that have more than one site: the planted domains."""
    t = s.planted(spark, sf_dir)
    model, _ = continuous.train(t, desert=60)
    found = continuous.decode(t, model, desert=60)
    return intervals.domains(found, F.col("state") == 0).where("n > 3").drop("segment")


@query(ORACLE["pmd_domains"])
def array_domains(spark, sf_dir):
    """The planted domains from levels alone, as an array has them."""
    t = s.planted(spark, sf_dir).where("n_reads > 0")
    return _r(models.array_partial_domains(t.select("chrom", "pos", (F.col("n_meth") / F.col("n_reads")).alias("meth")), 2), 4)


@query()
def pmd_auto(spark, sf_dir):
    """Domains with a bin size by coverage."""
    return _r(models.partial_domains_of(_planted_bins(spark, sf_dir), 2, 100, 2), 4)
