"""Queries over charts, scores, reports, exploration tables and the whole analysis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from quietband.functions.vectors import norm, subtract
from quietband.operators import charts, explore, report, scoring, spectral
from quietband.operators.feature_graph import correlation_edges
from quietband.plans.analysis import run_analysis
from quietband.plans.inputs import (
    CHART_IDS,
    CHART_SQL,
    EMBED_D,
    EMBED_SQL,
    NORM_SQL,
    ORDER_COLS,
    PATH_COLS,
    PAIRS_SQL,
    PATH_SQL,
    SCORE_BANDS,
    SCORE_SQL,
    STD_SQL,
    cells,
    charted_points,
    embedding_points,
    order_charts,
    order_points,
    order_table,
    path_graph,
    r,
    rounded,
    shared_folder,
    stored_order_points,
)
from quietband.plans.registry import query
from quietband.session import cut_lineage

AXIS = np.array([[1.0], [1.0], [1.0], [0.0], [0.0]]) / np.sqrt(3)
BASES = {c: AXIS for c in CHART_IDS}
IDENTITY = np.eye(5)
N_BANDS = len(SCORE_BANDS)


# --- charts --------------------------------------------------------------------------------------


# k-means has no closed form; that every order is in exactly one region has.
@query("partition_regions", f"WITH {PATH_SQL} SELECT count(*) AS points, count(*) AS ids, true AS in_range FROM gft")
def partition_regions_query(spark, sf_dir):
    points = cut_lineage(order_points(spark, sf_dir, PATH_COLS))
    rotated = spectral.gft(points, spectral.fit_basis(path_graph(spark), 3))
    regions = charts.partition_regions(rotated, "id", 1)
    limit = charts.chart_count(rotated.count())
    return regions.agg(
        F.count("*").alias("points"),
        F.count_distinct("id").alias("ids"),
        ((F.min("region") == 0) & (F.max("region") < limit)).alias("in_range"),
    )


@query(
    "split_region",
    f"WITH {CHART_SQL} SELECT count(*) AS points, count(*) AS ids, CAST(2 AS BIGINT) AS halves FROM cpts WHERE chart_id = 1",
)
def split_region_query(spark, sf_dir):
    halves = charts.split_region(charted_points(spark, sf_dir).where("chart_id = 1"), "id")
    return halves.agg(
        F.count("*").alias("points"),
        F.count_distinct("id").alias("ids"),
        F.count_distinct("half").alias("halves"),
    )


# Boundary rows are as many as the quota asks for and the outside neighbours allow.
@query(
    "expand_region",
    f"""WITH {PAIRS_SQL}, u AS (SELECT id, CAST(label % 3 AS INTEGER) AS unit FROM emb),
outside AS (SELECT DISTINCT a.unit, rk.neighbor FROM rk JOIN u a ON a.id = rk.query JOIN u b ON b.id = rk.neighbor
  WHERE rk.rank < {charts.OVERLAP_NEIGHBORS} AND a.unit <> b.unit),
sizes AS (SELECT unit, count(*) AS n FROM u GROUP BY unit),
wide AS (SELECT unit, count(*) AS m FROM outside GROUP BY unit)
SELECT unit, 'core' AS role, n AS count FROM sizes UNION ALL
SELECT unit, 'boundary', least(m, greatest(1, CAST(floor(n * 0.2) AS BIGINT))) FROM sizes JOIN wide USING (unit)""",
)
def expand_region_query(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    core = points.select("id", (F.col("label") % 3).cast("int").alias("unit"))
    pairs = charts.row_neighbors(points.select("id", "features"), "id")
    return charts.expand_region(core, pairs, "id").groupBy("unit", "role").count()


QUALITY_SQL = """CASE WHEN 1 - s < 0.05 THEN 'excellent' WHEN 1 - s < 0.15 THEN 'good'
  WHEN 1 - s < 0.3 THEN 'acceptable' WHEN 1 - s < 0.5 THEN 'poor' ELSE 'divergent' END"""


ALIGN_ORDER, ALIGN_SIGNS = [3, 0, 4, 1, 2], [1, -1, -1, 1, -1]


@query(
    "align_basis",
    "SELECT i, 0.0::DOUBLE AS gap, CAST(o AS BIGINT) AS column, 1.0::DOUBLE AS score FROM (VALUES "
    + ", ".join(f"({i}, {ALIGN_ORDER.index(i)})" for i in range(5)) + ") AS t(i, o)",
)
def align_basis_query(spark, sf_dir):
    """Eigenvectors of the orders' correlations, shuffled and with other signs, find back to themselves."""
    edges = correlation_edges(order_points(spark, sf_dir))
    reference = spectral.fit_basis(edges, 5).vectors
    shuffled = reference[:, ALIGN_ORDER] * ALIGN_SIGNS
    # Values tell where each column came from.
    found = charts.align_basis(shuffled, np.arange(5.0), reference)
    corner = np.abs(found.vectors) - np.abs(reference)  # full bases agree up to a reflection
    rows = [(i, float(np.abs(corner[:, i]).max()), int(found.values[i]), found.score) for i in range(5)]
    return rounded(spark.createDataFrame(rows, "i int, gap double, column long, score double"))


@query(
    "alignment_quality",
    f"""WITH a AS (SELECT o_orderkey AS id, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS s FROM orders)
SELECT {QUALITY_SQL} AS quality, s < 0.5 AS divergent, count(*) AS orders FROM a GROUP BY 1, 2""",
)
def alignment_quality_query(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    score = F.col("o_totalprice") / orders.agg(F.max("o_totalprice")).scalar()
    return (
        orders.select(score.alias("s"))
        .select(
            charts.alignment_quality(F.col("s")).alias("quality"),
            charts.is_divergent(F.col("s")).alias("divergent"),
        )
        .groupBy("quality", "divergent")
        .agg(F.count("*").alias("orders"))
    )


CODES = ", ".join(f"{r(f'(x0 + x1 + x2) / 3' if i < 3 else '0.0::DOUBLE')} AS x{i}" for i in range(5))


@query("chart_coordinates", f"WITH {CHART_SQL} SELECT id, {r('(x0 + x1 + x2) / sqrt(3)')} AS c0, {CODES} FROM cpts")
def chart_coordinates_query(spark, sf_dir):
    coded = scoring.chart_coordinates(charted_points(spark, sf_dir), BASES)
    decoded = scoring.chart_decode(coded, BASES)
    return rounded(decoded.select("id", *cells("coordinates", 1, "c"), *cells("decoded", 5)))


def _neighbouring_pairs(spark, sf_dir):
    """Distances of every order to the next one by key, under the order's priority."""
    points = charted_points(spark, sf_dir)
    following = points.select((F.col("id") - 1).alias("id"), F.col("features").alias("next"))
    gap = subtract(F.col("features"), F.col("next"))
    along = sum((F.get(F.col("gap"), F.lit(i)) for i in range(3)), F.lit(0.0)) / np.sqrt(3)
    return cut_lineage(
        points.join(following, "id")
        .withColumn("gap", gap)
        .select("chart_id", norm(F.col("gap")).alias("ambient"), F.abs(along).alias("chart"))
    )


PAIRS_CTE = f"""{CHART_SQL}, gaps AS (SELECT a.chart_id, """ + ", ".join(f"a.x{i} - b.x{i} AS g{i}" for i in range(5)) + """
  FROM cpts a JOIN cpts b ON b.id = a.id + 1),
pairs AS (SELECT chart_id, sqrt(g0*g0 + g1*g1 + g2*g2 + g3*g3 + g4*g4) AS ambient, abs(g0 + g1 + g2) / sqrt(3) AS chart
  FROM gaps)"""


@query(
    "injectivity",
    f"""WITH {PAIRS_CTE}, ranked AS (SELECT chart_id,
  rank() OVER (PARTITION BY chart_id ORDER BY ambient) + (count(*) OVER (PARTITION BY chart_id, ambient) - 1) / 2.0 AS ra,
  rank() OVER (PARTITION BY chart_id ORDER BY chart) + (count(*) OVER (PARTITION BY chart_id, chart) - 1) / 2.0 AS rc
  FROM pairs)
SELECT chart_id, round(corr(ra, rc), 3) + 0.0 AS injectivity FROM ranked GROUP BY chart_id""",
)
def injectivity_query(spark, sf_dir):
    return rounded(charts.injectivity(_neighbouring_pairs(spark, sf_dir)), 3)


@query(
    "continuity",
    f"""WITH {PAIRS_CTE}, q AS (SELECT chart_id, chart / ambient AS ratio FROM pairs WHERE ambient >= 1e-12)
SELECT chart_id, quantile_cont(ratio, 0.99) < 100 * quantile_cont(ratio, 0.5) AS continuous FROM q GROUP BY chart_id""",
)
def continuity_query(spark, sf_dir):
    return charts.continuity(_neighbouring_pairs(spark, sf_dir)).select(
        F.col("chart_id").cast("long").alias("chart_id"), "continuous"
    )


# The residual of a linear chart has no part along the chart.
@query("tangent_share", f"WITH {CHART_SQL} SELECT DISTINCT chart_id, 0.0::DOUBLE AS tangent_share FROM cpts")
def tangent_share_query(spark, sf_dir):
    return rounded(scoring.tangent_share(charted_points(spark, sf_dir), BASES))


CHART_SCORES_SQL = f"""{CHART_SQL}, memb AS (SELECT id, chart_id FROM cpts WHERE x0 > -1.2
  UNION SELECT id, 6 FROM cpts WHERE x1 > 0.5 UNION SELECT id, 7 FROM cpts WHERE x2 > 0.5),
cs AS (SELECT chart_id, 0.5 + avg(x4) AS alignment_score FROM cpts GROUP BY chart_id
  UNION ALL SELECT 6, 0.5::DOUBLE UNION ALL SELECT 7, 0.5::DOUBLE)"""


def _overlapping_members(spark, sf_dir):
    """Orders belong to their priority's chart; large ones to charts 6 and 7 as well."""
    points = charted_points(spark, sf_dir).select("id", "chart_id", *cells("features", 5))
    members = (
        points.where("x0 > -1.2")
        .select("id", "chart_id")
        .unionByName(points.where("x1 > 0.5").select("id", F.lit(6).alias("chart_id")))
        .unionByName(points.where("x2 > 0.5").select("id", F.lit(7).alias("chart_id")))
    )
    scores = points.groupBy("chart_id").agg((0.5 + F.avg("x4")).alias("alignment_score"))
    extra = spark.createDataFrame([(6, 0.5), (7, 0.5)], "chart_id int, alignment_score double")
    return points.select("id"), members, scores.unionByName(extra)


@query(
    "primary_chart",
    f"""WITH {CHART_SCORES_SQL}, b AS (SELECT id, memb.chart_id, row_number() OVER (PARTITION BY id
  ORDER BY alignment_score DESC, memb.chart_id) AS rn FROM memb JOIN cs ON memb.chart_id = cs.chart_id)
SELECT cpts.id AS id, coalesce(b.chart_id, 0) AS chart_id FROM cpts LEFT JOIN b ON b.id = cpts.id AND rn = 1""",
)
def primary_chart_query(spark, sf_dir):
    return rounded(charts.primary_chart(*_overlapping_members(spark, sf_dir), "id"))


@query(
    "chart_overlaps",
    f"""WITH {CHART_SCORES_SQL} SELECT a.chart_id AS chart_i, b.chart_id AS chart_j, a.id AS id
  FROM memb a JOIN memb b ON a.id = b.id AND a.chart_id < b.chart_id""",
)
def chart_overlaps_query(spark, sf_dir):
    return rounded(charts.chart_overlaps(_overlapping_members(spark, sf_dir)[1], "id"))


@query(
    "coverage",
    f"""WITH {CHART_SCORES_SQL}, c AS (SELECT count(DISTINCT id) AS covered FROM memb)
SELECT covered, (SELECT count(*) FROM cpts) AS points, round(covered / (SELECT count(*) FROM cpts), 6) + 0.0 AS coverage FROM c""",
)
def coverage_query(spark, sf_dir):
    points, members, _ = _overlapping_members(spark, sf_dir)
    return rounded(charts.coverage(points, members, "id"))


MEAN_SQL = f"""{EMBED_SQL}, u AS (SELECT label, generate_subscripts(v, 1) AS k, unnest(v) AS x FROM emb),
m AS (SELECT label, k, avg(x) AS m FROM u GROUP BY label, k),
l AS (SELECT label, sqrt(sum(m * m)) AS len FROM m GROUP BY label)"""


@query(
    "tangent_variation",
    f"""WITH {MEAN_SQL}, d AS (SELECT a.label, abs(sum(a.m * b.m)) / max(la.len * lb.len) AS c
  FROM m a JOIN m b ON a.k = b.k AND b.label = a.label + 1 JOIN l la ON la.label = a.label JOIN l lb ON lb.label = b.label
  GROUP BY a.label) SELECT {r('avg(acos(c))')} AS variation FROM d""",
)
def tangent_variation_query(spark, sf_dir):
    """Angle between the mean directions of consecutive labels."""
    means = (
        embedding_points(spark, sf_dir)
        .groupBy("label")
        .agg(F.array(*[F.avg(F.get("features", F.lit(k))) for k in range(EMBED_D)]).alias("m"))
        .orderBy("label")
        .collect()
    )
    bases = [np.array(row["m"])[:, None] for row in means]
    value = charts.tangent_variation([b / np.linalg.norm(b) for b in bases])
    return rounded(spark.createDataFrame([(value,)], "variation double"))


def _atlas(spark, sf_dir):
    basis = spectral.fit_basis(path_graph(spark), 3)
    points = stored_order_points(spark, sf_dir, PATH_COLS)
    spectrum = spectral.analyze_fourier(points, None, basis=basis)
    regions = points.select("id").join(order_charts(spark, sf_dir), "id")
    regions = regions.select("id", (F.col("chart_id") - 1).alias("region"))
    return charts.build_atlas(spectrum.coefficients, "id", spectrum, 2, regions=regions)


@query("build_atlas")
def build_atlas_query(spark, sf_dir):
    found = _atlas(spark, sf_dir)
    return found.charts_df(spark).select(
        "chart_id", "alignment_score", "quality", "injectivity", "distortion", "score"
    )


@query(
    "build_atlas_invariants",
    f"""WITH {CHART_SQL}, n AS (SELECT count(*) AS n FROM cpts)
SELECT n AS points, n AS assigned, n AS in_charts, true AS members_covered, true AS charts_numbered, true AS gates_passed FROM n""",
)
def build_atlas_invariants(spark, sf_dir):
    """Every order has one chart, sizes add up, coverage counts members, and all charts passed their gates."""
    found = _atlas(spark, sf_dir)
    numbers = [c.chart_id for c in found.charts]
    assigned = found.assignments.agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids")).first()
    sizes = found.assignments.where(F.col("chart_id").isin(numbers)).groupBy("chart_id").count()
    covered, members = found.coverage.first(), found.members.select("id").distinct().count()
    gates = all(
        c.injectivity >= charts.INJECTIVITY_GATE and 0 <= c.score <= 1 and 0 <= c.alignment_score <= 1 + 1e-9
        for c in found.charts
    )
    row = (
        covered["points"], assigned["ids"] if assigned["rows"] == assigned["ids"] else -1,
        sizes.agg(F.sum("count")).first()[0], covered["covered"] == members, numbers == list(range(len(numbers))), gates,
    )
    return spark.createDataFrame(
        [row],
        "points long, assigned long, in_charts long, members_covered boolean, charts_numbered boolean, gates_passed boolean",
    )


# --- scores ------------------------------------------------------------------------------------------


@query("reconstruct", f"WITH {CHART_SQL} SELECT id, {CODES} FROM cpts")
def reconstruct_query(spark, sf_dir):
    rebuilt = scoring.reconstruct(charted_points(spark, sf_dir), BASES)
    return rounded(rebuilt.select("id", *cells("reconstruction", 5)))


@query("normal_residuals", f"WITH {NORM_SQL} SELECT id, " + ", ".join(f"{r(f'r{i}')} AS x{i}" for i in range(5)) + " FROM res")
def normal_residuals_query(spark, sf_dir):
    left = scoring.normal_residuals(charted_points(spark, sf_dir), BASES)
    return rounded(left.select("id", *cells("residual", 5)))


def _normed(spark, sf_dir):
    points = charted_points(spark, sf_dir)
    return scoring.band_norms(points, BASES, IDENTITY, SCORE_BANDS).drop("features")


@query("band_norms", f"WITH {NORM_SQL} SELECT id, {r('n0')} AS n0, {r('n1')} AS n1 FROM norms")
def band_norms_query(spark, sf_dir):
    return rounded(_normed(spark, sf_dir).select("id", *cells("norms", 2, "n")))


@query(
    "expected_residuals",
    f"""WITH {NORM_SQL} SELECT chart_id, 0 AS band, {r('m0')} AS mean, {r('v0')} AS var, n FROM expd
  UNION ALL SELECT chart_id, 1, {r('m1')}, {r('v1')}, n FROM expd""",
)
def expected_residuals_query(spark, sf_dir):
    return rounded(scoring.expected_residuals(_normed(spark, sf_dir)))


def _scored(spark, sf_dir, weights=None):
    normed = _normed(spark, sf_dir)
    return scoring.score_points(normed, scoring.expected_residuals(normed), weights)


@query("band_zscore", f"WITH {SCORE_SQL} SELECT id, chart_id, {r('z0')} AS z0, {r('z1')} AS z1 FROM zs")
def band_zscore_query(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("id", "chart_id", *cells("z", 2, "z")))


@query("aggregate_score", f"WITH {SCORE_SQL} SELECT id, {r('score')} AS score FROM sc")
def aggregate_score_query(spark, sf_dir):
    return rounded(_scored(spark, sf_dir).select("id", "score"))


@query("aggregate_score_weighted", f"WITH {SCORE_SQL} SELECT id, {r('0.75 * abs(z0) + 0.25 * abs(z1)')} AS score FROM sc")
def aggregate_score_weighted(spark, sf_dir):
    return rounded(_scored(spark, sf_dir, [3.0, 1.0]).select("id", "score"))


EVENT_MAD_SQL = """WITH m AS (SELECT median(value) AS m FROM events)
SELECT round(m + 3 * 1.4826 * median(abs(value - m)), 6) + 0.0 AS threshold FROM events CROSS JOIN m GROUP BY m"""


@query("mad_threshold", EVENT_MAD_SQL)
def mad_threshold_query(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("value")
    found = scoring.mad_thresholds(events, {"value": F.col("value")})
    return rounded(spark.createDataFrame([(found["value"],)], "threshold double"))


TIES_MAD_SQL = """WITH v AS (SELECT l_linenumber % 2 AS odd, l_discount AS discount FROM lineitem),
m AS (SELECT median(odd) AS mo, median(discount) AS md FROM v)
SELECT round(mo + 3 * 1.4826 * median(abs(odd - mo)), 6) + 0.0 AS odd,
  round(md + 3 * 1.4826 * median(abs(discount - md)), 6) + 0.0 AS discount
FROM v CROSS JOIN m GROUP BY mo, md"""


@query("mad_threshold_ties", TIES_MAD_SQL)
def mad_threshold_ties_query(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    columns = {"odd": F.col("l_linenumber") % 2, "discount": F.col("l_discount")}
    found = scoring.mad_thresholds(lines, columns)
    return rounded(spark.createDataFrame([(found["odd"], found["discount"])], "odd double, discount double"))


@query("percentile_threshold", f"SELECT {r('quantile_cont(value, 0.99)')} AS threshold FROM events")
def percentile_threshold_query(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("value")
    found = scoring.percentile_thresholds(events, {"value": F.col("value")})
    return rounded(spark.createDataFrame([(found["value"],)], "threshold double"))


@query(
    "multiple_testing",
    f"WITH {SCORE_SQL} SELECT 0 AS band, {r('t0')} AS threshold FROM thr UNION ALL SELECT 1, {r('t1')} FROM thr",
)
def multiple_testing_query(spark, sf_dir):
    limits, _ = scoring.thresholds_for(cut_lineage(_scored(spark, sf_dir)), N_BANDS)
    return rounded(spark.createDataFrame(list(enumerate(limits)), "band int, threshold double"))


def _flagged(spark, sf_dir):
    return scoring.detect_anomalies(charted_points(spark, sf_dir), BASES, IDENTITY, SCORE_BANDS)


@query("flag", f"WITH {SCORE_SQL} SELECT id, f0, f1, is_anomaly FROM fl")
def flag_query(spark, sf_dir):
    return _flagged(spark, sf_dir).select("id", *cells("flags", 2, "f"), "is_anomaly")


@query(
    "detect_anomalies",
    f"WITH {SCORE_SQL} SELECT chart_id, count(*) AS points, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM fl GROUP BY chart_id",
)
def detect_anomalies_query(spark, sf_dir):
    counted = _flagged(spark, sf_dir).groupBy("chart_id").agg(
        F.count("*").alias("points"), F.count_if("is_anomaly").alias("anomalies")
    )
    return rounded(counted)


# --- report -------------------------------------------------------------------------------------------


@query(
    "per_point_table",
    f"""WITH {SCORE_SQL} SELECT id, {r('score')} AS overall_score, is_anomaly, {r('z0')} AS band_0_score,
  {r('z1')} AS band_1_score, CASE WHEN abs(z0) >= abs(z1) THEN 'band_0' ELSE 'band_1' END AS top_anomalous_band FROM fl""",
)
def per_point_table_query(spark, sf_dir):
    return rounded(report.per_point_table(_flagged(spark, sf_dir), "id", N_BANDS))


TYPES_SQL = """count(*) FILTER (WHERE is_anomaly AND f0 <> f1) AS spectral, CAST(0 AS BIGINT) AS partial,
  count(*) FILTER (WHERE is_anomaly AND f0 AND f1) AS "global" """


@query("type_distribution", f"WITH {SCORE_SQL} SELECT {TYPES_SQL} FROM fl")
def type_distribution_query(spark, sf_dir):
    return report.type_distribution(_flagged(spark, sf_dir), N_BANDS)


@query(
    "top_anomalies",
    f"""WITH {SCORE_SQL} SELECT id, {r('score')} AS overall_score, is_anomaly,
  concat_ws('|', CASE WHEN f0 THEN '0' END, CASE WHEN f1 THEN '1' END) AS flagged_bands,
  {r('z0')} AS band_0, {r('z1')} AS band_1 FROM fl WHERE is_anomaly ORDER BY score DESC, id LIMIT 10""",
)
def top_anomalies_query(spark, sf_dir):
    top = report.top_anomalies(_flagged(spark, sf_dir), "id", N_BANDS)
    return rounded(
        top.select(
            "id",
            "overall_score",
            "is_anomaly",
            F.array_join(F.col("flagged_bands").cast("array<string>"), "|").alias("flagged_bands"),
            F.col("band_scores")["band_0"].alias("band_0"),
            F.col("band_scores")["band_1"].alias("band_1"),
        )
    )


SUMMARY_SQL = f"""count(*) AS total_points, count(*) FILTER (WHERE is_anomaly) AS total_anomalies,
  {r('count(*) FILTER (WHERE is_anomaly) / count(*)')} AS anomaly_rate, {r('avg(score)')} AS mean_score,
  {r('stddev_pop(score)')} AS std_score, {r('max(score)')} AS max_score,
  count(*) FILTER (WHERE f0) AS band_0_anomaly_count, count(*) FILTER (WHERE f1) AS band_1_anomaly_count"""


@query("statistical_summary", f"WITH {SCORE_SQL} SELECT {SUMMARY_SQL} FROM fl")
def statistical_summary_query(spark, sf_dir):
    return rounded(report.statistical_summary(_flagged(spark, sf_dir), N_BANDS))


@query("summary_row", f"WITH {SCORE_SQL} SELECT {SUMMARY_SQL}, {TYPES_SQL} FROM fl")
def summary_row_query(spark, sf_dir):
    return rounded(report.summary_row(report.generate_report(_flagged(spark, sf_dir), "id", N_BANDS)))


@query(
    "report_json",
    f"""WITH {SCORE_SQL}, s AS (SELECT {SUMMARY_SQL}, {TYPES_SQL} FROM fl)
SELECT total_points, total_anomalies, max_score, spectral, "global",
  (SELECT id FROM fl WHERE is_anomaly ORDER BY score DESC, id LIMIT 1) AS worst FROM s""",
)
def report_json_query(spark, sf_dir):
    path = shared_folder(spark)
    report.write_report_json(report.generate_report(_flagged(spark, sf_dir), "id", N_BANDS), path)
    fields = {
        "total_points": ("$.summary.total_points", "long"),
        "total_anomalies": ("$.summary.total_anomalies", "long"),
        "max_score": ("$.summary.max_score", "double"),
        "spectral": ("$.type_distribution.spectral", "long"),
        "global": ("$.type_distribution.global", "long"),
        "worst": ("$.top_anomalies[0].id", "long"),
    }
    document = spark.read.text(path)
    return rounded(
        document.select(
            *[F.get_json_object("value", p).cast(t).alias(n) for n, (p, t) in fields.items()]
        )
    )


@query(
    "report_csv",
    f"WITH {SCORE_SQL} SELECT id, {r('score')} AS overall_score, is_anomaly FROM fl",
)
def report_csv_query(spark, sf_dir):
    path = shared_folder(spark)
    report.write_report_csv(report.generate_report(_flagged(spark, sf_dir), "id", N_BANDS), path)
    table = spark.read.option("header", True).schema(
        "id long, overall_score double, is_anomaly boolean, band_0_score double, band_1_score double, top_anomalous_band string"
    ).csv(path)
    return rounded(table.select("id", "overall_score", "is_anomaly"))


# --- exploration ----------------------------------------------------------------------------------------

# Embeddings as coefficients; every fifth vector is flagged, labels under 3 are clusters.
SPACE_SQL = f"""{EMBED_SQL}, sp AS (SELECT id, v, abs(v[1]) * 10 AS score, id % 5 = 0 AS is_anomaly,
  CASE WHEN label < 3 THEN label ELSE -1 END AS cluster FROM emb),
u AS (SELECT generate_subscripts(v, 1) - 1 AS k, unnest(v) AS x FROM sp),
pw AS (SELECT k, avg(x * x) AS power FROM u GROUP BY k),
ax AS (SELECT k, row_number() OVER (ORDER BY k) AS p FROM (SELECT k FROM pw WHERE k > 0 ORDER BY power DESC, k LIMIT 3)),
ch AS (SELECT (SELECT k FROM ax WHERE p = 1) + 1 AS a, (SELECT k FROM ax WHERE p = 2) + 1 AS b, (SELECT k FROM ax WHERE p = 3) + 1 AS c),
rw AS (SELECT sp.*, v[a] AS p, v[b] AS q, v[c] AS s FROM sp CROSS JOIN ch),
st AS (SELECT avg(p) AS mp, stddev_pop(p) AS sp, avg(q) AS mq, stddev_pop(q) AS sq, avg(s) AS ms, stddev_pop(s) AS ss FROM rw),
xyz AS (SELECT id, v, score, is_anomaly, (p - mp) / st.sp AS x, (q - mq) / sq AS y, (s - ms) / ss AS z,
  CASE WHEN NOT is_anomaly THEN 'normal' WHEN cluster >= 0 THEN 'cluster' ELSE 'isolated' END AS klass,
  CASE WHEN is_anomaly AND cluster >= 0 THEN cluster END AS cluster_id FROM rw CROSS JOIN st),
cen AS (SELECT cluster_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM xyz WHERE klass = 'cluster' GROUP BY cluster_id),
nd AS (SELECT cen.cluster_id AS cluster_id, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz)) AS d
  FROM xyz CROSS JOIN cen WHERE klass = 'normal'),
near AS (SELECT cluster_id, avg(d) AS mean_near FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY d) AS rn
  FROM nd) WHERE rn <= 20 GROUP BY cluster_id),
nm AS (SELECT avg(x) AS nx, avg(y) AS ny, avg(z) AS nz FROM xyz WHERE klass = 'normal'),
spr AS (SELECT avg(sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny) + (z - nz) * (z - nz))) AS spread
  FROM xyz CROSS JOIN nm WHERE klass = 'normal'),
kp AS (SELECT klass, cluster_id, generate_subscripts(v, 1) - 1 AS k, unnest(v) AS w FROM xyz),
cp AS (SELECT cluster_id, k, avg(w * w) AS pc FROM kp WHERE klass = 'cluster' GROUP BY cluster_id, k),
np AS (SELECT k, avg(w * w) AS pn FROM kp WHERE klass = 'normal' GROUP BY k),
dv AS (SELECT cluster_id, k, row_number() OVER (PARTITION BY cluster_id ORDER BY k) AS p FROM
  (SELECT cluster_id, cp.k AS k, row_number() OVER (PARTITION BY cluster_id ORDER BY abs(pc - pn) DESC, cp.k) AS rn
   FROM cp JOIN np ON cp.k = np.k) WHERE rn <= 3),
own AS (SELECT id, xyz.cluster_id, v[d1.k + 1] AS a, v[d2.k + 1] AS b, v[d3.k + 1] AS c FROM xyz
  JOIN dv d1 ON d1.cluster_id = xyz.cluster_id AND d1.p = 1 JOIN dv d2 ON d2.cluster_id = xyz.cluster_id AND d2.p = 2
  JOIN dv d3 ON d3.cluster_id = xyz.cluster_id AND d3.p = 3 WHERE klass = 'cluster'),
os AS (SELECT cluster_id, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc
  FROM own GROUP BY cluster_id)"""


def _space(spark, sf_dir):
    points = embedding_points(spark, sf_dir)
    return points.select(
        "id",
        F.col("features").alias("coeffs"),
        (F.abs(F.get("features", F.lit(0))) * 10).alias("score"),
        (F.col("id") % 5 == 0).alias("is_anomaly"),
        F.when(F.col("label") < 3, F.col("label")).otherwise(-1).alias("cluster"),
    )


def _positions(spark, sf_dir):
    space = _space(spark, sf_dir)
    power = spectral.mean_power(space, d=EMBED_D)
    axes = [row["k"] for row in explore.top3_axes(power).collect()]
    return explore.classify_points(explore.project_3d(space, axes))


@query("top3_axes", f"WITH {SPACE_SQL} SELECT k FROM ax")
def top3_axes_query(spark, sf_dir):
    return rounded(explore.top3_axes(spectral.mean_power(_space(spark, sf_dir), d=EMBED_D)))


# Axes through the centre keep the cloud centred at the origin, up to floating point dust.
@query("project_3d", f"WITH {SPACE_SQL} SELECT id, {r('x', 5)} AS x, {r('y', 5)} AS y, {r('z', 5)} AS z FROM xyz")
def project_3d_query(spark, sf_dir):
    return rounded(_positions(spark, sf_dir).select("id", "x", "y", "z"), 5)


@query("classify_points", f"WITH {SPACE_SQL} SELECT id, klass, CAST(coalesce(cluster_id, -1) AS BIGINT) AS cluster_id FROM xyz")
def classify_points_query(spark, sf_dir):
    found = explore.classify_points(_space(spark, sf_dir)).select("id", "klass", "cluster_id")
    return rounded(found.na.fill({"cluster_id": -1}))


@query(
    "cluster_overlap",
    f"""WITH {SPACE_SQL} SELECT near.cluster_id AS cluster_id, {r('mean_near')} AS mean_near, {r('spread')} AS spread,
  mean_near < 1.5 * (spread + 1e-9) AS overlaps FROM near CROSS JOIN spr""",
)
def cluster_overlap_query(spark, sf_dir):
    return rounded(explore.cluster_overlap(_positions(spark, sf_dir)))


@query("divergent_axes", f"WITH {SPACE_SQL} SELECT cluster_id, string_agg(CAST(k AS VARCHAR), '|' ORDER BY k) AS axes FROM dv GROUP BY cluster_id")
def divergent_axes_query(spark, sf_dir):
    axes = explore.divergent_axes(_positions(spark, sf_dir))
    return rounded(axes.withColumn("axes", F.array_join(F.col("axes").cast("array<string>"), "|")))


# All points are centred on the origin; clusters move 2.5 units from it. Only the shape of a
# cluster is compared, as the direction of a zero vector is not defined.
@query(
    "reproject_cluster",
    f"""WITH {SPACE_SQL} SELECT id, own.cluster_id AS cluster_id, round((a - ma) / sa, 5) + 0.0 AS x,
  round((b - mb) / sb, 5) + 0.0 AS y, round((c - mc) / sc, 5) + 0.0 AS z FROM own JOIN os ON own.cluster_id = os.cluster_id""",
)
def reproject_cluster_query(spark, sf_dir):
    points = _positions(spark, sf_dir)
    moved = explore.reproject_cluster(points, explore.divergent_axes(points), "id")
    centre = Window.partitionBy("cluster_id")
    return rounded(
        moved.select("id", "cluster_id", *[(F.col(a) - F.avg(a).over(centre)).alias(a) for a in "xyz"]), 5
    )


@query(
    "point_detail",
    f"""WITH {SCORE_SQL}, k AS (SELECT id FROM fl ORDER BY score DESC, id LIMIT 1)
SELECT fl.id AS id, {r('score')} AS overall_score, is_anomaly,
  CASE WHEN f0 AND f1 THEN 'global' WHEN f0 OR f1 THEN 'spectral' END AS anomaly_type, {r('z0')} AS z0, {r('z1')} AS z1,
  CASE WHEN abs(z0) >= abs(z1) THEN 'band_0' ELSE 'band_1' END AS top_anomalous_band, fl.chart_id AS chart_id,
  {r('x0')} AS lines, {r('x4')} AS tax FROM fl JOIN k ON fl.id = k.id JOIN pts ON pts.id = fl.id""",
)
def point_detail_query(spark, sf_dir):
    points = charted_points(spark, sf_dir)
    scores = scoring.detect_anomalies(points, BASES, IDENTITY, SCORE_BANDS)
    worst = scores.orderBy(F.desc("score"), "id").first()["id"]
    known = spark.createDataFrame([(c, 1.0) for c in CHART_IDS], "chart_id int, alignment_score double")
    detail = explore.point_detail(
        scores.join(points.select("id", "features"), "id"), known, "id", worst, ORDER_COLS
    )
    return rounded(
        detail.select(
            "id", "overall_score", "is_anomaly", "anomaly_type", *cells("band_scores", 2, "z"),
            "top_anomalous_band", "chart_id", F.col("values")["lines"].alias("lines"), F.col("values")["tax"].alias("tax"),
        )
    )


@query(
    "cluster_detail",
    f"""WITH {SPACE_SQL} SELECT cluster, count(*) AS size, {r('avg(score)')} AS mean_score, {r('max(score)')} AS max_score
  FROM sp GROUP BY cluster""",
)
def cluster_detail_query(spark, sf_dir):
    return rounded(explore.cluster_detail(_space(spark, sf_dir)))


@query(
    "project",
    f"""WITH {SPACE_SQL} SELECT xyz.id AS id, klass, CAST(coalesce(xyz.cluster_id, -1) AS BIGINT) AS cluster_id,
  CASE WHEN klass = 'cluster' AND mean_near < 1.5 * (spread + 1e-9) THEN 0.0 ELSE round(x, 5) + 0.0 END AS x,
  coalesce(klass = 'cluster' AND mean_near < 1.5 * (spread + 1e-9), false) AS reprojected
  FROM xyz LEFT JOIN near ON near.cluster_id = xyz.cluster_id CROSS JOIN spr""",
)
def project_query(spark, sf_dir):
    space = _space(spark, sf_dir)
    found = explore.project(
        space.select("id", "coeffs"), "id", space.select("id", "score", "is_anomaly"), space.select("id", "cluster")
    )
    x = F.when(~F.col("reprojected"), F.col("x")).otherwise(0.0).alias("x")
    points = found.points.na.fill({"cluster_id": -1})
    return rounded(points.select("id", "klass", "cluster_id", x, "reprojected"), 5)


# --- the whole analysis -----------------------------------------------------------------------------------


@query("run_analysis")
def run_analysis_query(spark, sf_dir):
    result = run_analysis(order_table(spark, sf_dir), "id", ORDER_COLS)
    return report.summary_row(result.report)


PER_POINT = ["points", "coefficients", "assignments", "band_norms", "scores"]


@query(
    "run_analysis_stages",
    f"""WITH {STD_SQL}, n AS (SELECT count(*) AS n FROM pts)
SELECT unnest({[*PER_POINT, "report"]}) AS item, n AS rows, n AS ids FROM n
UNION ALL SELECT unnest(['column_names', 'mean_power', 'basis']), {len(ORDER_COLS)}, 0
UNION ALL SELECT unnest(['flags off threshold', 'summary off flags', 'types beyond flags', 'charts off summary']), 0, 0""",
)
def run_analysis_stages(spark, sf_dir):
    """Stage tables of a whole run read back: every order once, flags as the threshold says, reports that add up."""
    folder = shared_folder(spark)
    result = run_analysis(order_table(spark, sf_dir), "id", ORDER_COLS, stage_dir=folder)
    stage = lambda name: spark.read.parquet(f"{folder}/{name}")
    rows = []
    for name, table in [*[(n, stage(n)) for n in PER_POINT], ("report", result.report.table)]:
        rows.append((name, *table.agg(F.count("*"), F.count_distinct("id")).first()))
    rows += [(n, stage(n).count(), 0) for n in ("column_names", "mean_power", "basis")]
    scores = stage("scores")
    limit = scoring.mad_thresholds(scores, {"score": F.col("score")})["score"]
    flagged = scores.where("is_anomaly").count()
    rows.append(("flags off threshold", scores.where(F.col("is_anomaly") != (F.col("score") > limit)).count(), 0))
    told = report.summary_row(result.report).first()
    rows.append(("summary off flags", abs(told["total_anomalies"] - flagged), 0))
    rows.append(("types beyond flags", max(0, told["spectral"] + told["partial"] + told["global"] - flagged), 0))
    rows.append(("charts off summary", abs(stage("charts").count() - result.summary["n_charts"]), 0))
    return spark.createDataFrame(rows, "item string, rows long, ids long")
