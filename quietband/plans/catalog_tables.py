"""Queries over sources, profiling, normalisation, feature graphs and edge tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietband.operators import feature_graph as fg
from quietband.operators import graph, normalize, profile
from quietband.plans.inputs import (
    CHART_SQL,
    FOREST_SQL,
    ORDER_COLS,
    RAW_SQL,
    STD_SQL,
    SUPPLY_SQL,

    charted_points,
    geography_forest,
    order_points,
    order_table,
    purchase_graph,
    r,
    region_ring,
    rounded,
    shared_folder,
    supply_graph,
    table,
)
from quietband.plans.registry import query
from quietband.session import cut_lineage
from quietband.sources.dataset import numeric_matrix, read_dataset, write_dataset
from quietband.sources.delimited import read_delimited, read_tsv
from quietband.sources.names import clean_column_names
from quietband.sources.query import read_query

PART_SQL = """SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size,
  round(p_retailprice, 6) + 0.0 AS p_retailprice FROM part"""


def _delimited(df, suffix: str, sep: str) -> str:
    """Write a folder of delimited files, one per partition, and name it like a file."""
    folder = shared_folder(df.sparkSession) + suffix
    df.write.options(header=True, sep=sep, escape='"').csv(folder)
    return folder


# --- sources -------------------------------------------------------------------------------


@query("read_delimited", PART_SQL)
def read_delimited_query(spark, sf_dir):
    return rounded(read_delimited(spark, _delimited(table(spark, sf_dir, "part"), ".csv", ";")))


QUOTED_SQL = PART_SQL.replace(
    "p_name,", """'the "' || p_name || '"' || chr(10) || 'second; line' AS p_name,"""
)


@query("read_delimited_quoted", QUOTED_SQL)
def read_delimited_quoted_query(spark, sf_dir):
    """Names with quotes, separators and line breaks, written as other programs write them."""
    named = F.concat(F.lit('the "'), "p_name", F.lit('"\nsecond; line'))
    part = table(spark, sf_dir, "part").withColumn("p_name", named)
    return rounded(read_delimited(spark, _delimited(part, ".csv", ";")))


@query("read_tsv", PART_SQL)
def read_tsv_query(spark, sf_dir):
    return rounded(read_tsv(spark, _delimited(table(spark, sf_dir, "part"), ".tab", "\t")))


@query(
    "clean_column_names",
    """SELECT s_suppkey AS supp_key, s_name AS col_1, CAST(s_nationkey AS BIGINT) AS supp_key_1,
  round(s_acctbal, 6) + 0.0 AS col_3 FROM supplier""",
)
def clean_column_names_query(spark, sf_dir):
    named = table(spark, sf_dir, "supplier").toDF(" Supp Key ", "Unnamed: 1", "SUPP KEY", " ")
    return rounded(clean_column_names(named))


@query(
    "read_query",
    """SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
  FROM orders GROUP BY o_orderpriority""",
)
def read_query_query(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("quietband_orders")
    return read_query(
        spark,
        """SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total
           FROM quietband_orders GROUP BY o_orderpriority;""",
        max_rows=500_000,
    )


@query("dataset_round_trip", PART_SQL)
def dataset_round_trip(spark, sf_dir):
    path = shared_folder(spark)
    write_dataset(table(spark, sf_dir, "part"), path)
    return rounded(read_dataset(spark, path))


@query(
    "numeric_matrix",
    """SELECT p_name AS p_name, CAST(nullif(p_size, 7) AS DOUBLE) AS p_size,
  round(CASE WHEN p_size = 7 THEN NULL ELSE p_retailprice END, 6) + 0.0 AS p_retailprice
  FROM part WHERE p_size <> 7""",
)
def numeric_matrix_query(spark, sf_dir):
    gaps = table(spark, sf_dir, "part").select(
        "p_name",
        F.nullif("p_size", F.lit(7)).alias("p_size"),
        F.when(F.col("p_size") == 7, float("nan")).otherwise(F.col("p_retailprice")).alias("p_retailprice"),
    )
    return rounded(numeric_matrix(gaps, keep=["p_name"]))


# --- profiling -----------------------------------------------------------------------------


def _gappy_part(spark, sf_dir):
    """Parts with missing sizes, blank brands, NaN prices and a constant column."""
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_brand") == "Brand#2", "").otherwise(F.col("p_brand")).alias("p_brand"),
        F.nullif("p_size", F.lit(11)).alias("p_size"),
        F.when(F.col("p_size") == 3, float("nan")).otherwise(F.col("p_retailprice")).alias("p_retailprice"),
        F.lit(1).alias("p_flag"),
    )


GAPPY_SQL = """gp AS (SELECT p_partkey, CASE WHEN p_brand = 'Brand#2' THEN '' ELSE p_brand END AS p_brand,
  nullif(p_size, 11) AS p_size, CASE WHEN p_size = 3 THEN NULL ELSE p_retailprice END AS p_retailprice,
  1 AS p_flag FROM part)"""


def _info_sql(position, name, kind, missing):
    return f"""SELECT {position} AS position, '{name}' AS name, '{kind}' AS kind, {kind == 'numeric'} AS is_numeric,
  CAST(count(*) FILTER (WHERE {missing}) AS BIGINT) AS missing_count,
  round(100.0 * count(*) FILTER (WHERE {missing}) / count(*), 2) AS missing_pct,
  (SELECT string_agg(CAST({name} AS VARCHAR), '|' ORDER BY p_partkey) FROM
    (SELECT * FROM gp WHERE {name} IS NOT NULL ORDER BY p_partkey LIMIT 5)) AS samples FROM gp"""


@query(
    "column_info",
    "WITH "
    + GAPPY_SQL
    + " "
    + " UNION ALL ".join(
        [
            _info_sql(0, "p_partkey", "numeric", "p_partkey IS NULL"),
            _info_sql(1, "p_brand", "string", "p_brand IS NULL OR p_brand = ''"),
            _info_sql(2, "p_size", "numeric", "p_size IS NULL"),
            _info_sql(3, "p_retailprice", "numeric", "p_retailprice IS NULL"),
            _info_sql(4, "p_flag", "numeric", "p_flag IS NULL"),
        ]
    ),
)
def column_info_query(spark, sf_dir):
    info = profile.column_info(_gappy_part(spark, sf_dir), "p_partkey")
    return rounded(info.withColumn("samples", F.array_join("samples", "|")))


@query(
    "preview",
    "WITH "
    + GAPPY_SQL
    + """ SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce(p_brand, '—') AS p_brand,
  coalesce(CAST(p_size AS VARCHAR), '—') AS p_size, coalesce(CAST(p_retailprice AS VARCHAR), '—') AS p_retailprice,
  CAST(p_flag AS VARCHAR) AS p_flag FROM gp ORDER BY gp.p_partkey LIMIT 100""",
)
def preview_query(spark, sf_dir):
    return profile.preview(_gappy_part(spark, sf_dir), "p_partkey", 100)


GAPS_SQL = """(count(*) FILTER (WHERE p_size IS NULL) + count(*) FILTER (WHERE p_retailprice IS NULL))
  * 100.0 / (5 * count(*))"""


@query("missing_percentage", f"WITH {GAPPY_SQL} SELECT {r(GAPS_SQL)} AS missing_pct FROM gp")
def missing_percentage_query(spark, sf_dir):
    return rounded(profile.missing_percentage(_gappy_part(spark, sf_dir)))


@query(
    "duplicate_rows",
    """SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM
  (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_tax)""",
)
def duplicate_rows_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return profile.duplicate_rows(lines.select("l_quantity", "l_discount", "l_tax"))


@query("constant_columns", "SELECT 'p_flag' AS name FROM part HAVING count(*) > 0")
def constant_columns_query(spark, sf_dir):
    return profile.constant_columns(_gappy_part(spark, sf_dir))


@query(
    "suitability",
    """SELECT p_brand, count(*) AS n_rows,
  round(1.0 - (CASE WHEN count(*) < 100 THEN 0.4 ELSE 0 END) - 0.1
    - (CASE WHEN 100.0 * count(*) FILTER (WHERE p_size < 10) / count(*) > 10 THEN 0.1 ELSE 0 END), 3) + 0.0
    AS suitability_score,
  CASE WHEN count(*) < 100 THEN (CASE WHEN 100.0 * count(*) FILTER (WHERE p_size < 10) / count(*) > 10
    THEN 'needs_attention' ELSE 'needs_attention' END) ELSE 'ready' END AS suitability_level
  FROM part GROUP BY p_brand""",
)
def suitability_query(spark, sf_dir):
    stats = (
        table(spark, sf_dir, "part")
        .groupBy("p_brand")
        .agg(F.count("*").alias("n_rows"), F.count_if(F.col("p_size") < 10).alias("duplicate_rows"))
        .withColumns({"n_numeric": F.lit(3), "missing_pct": F.lit(5.0), "n_constant": F.lit(0)})
    )
    return rounded(
        profile.suitability(stats).select("p_brand", "n_rows", "suitability_score", "suitability_level")
    )


@query(
    "profile",
    "WITH "
    + GAPPY_SQL
    + f""", st AS (SELECT count(*) AS n, {GAPS_SQL} AS miss FROM gp)
SELECT n AS n_rows, 5 AS n_columns, 4 AS n_numeric, 1 AS n_non_numeric, round(miss, 2) + 0.0 AS missing_pct,
  'p_flag' AS constant_columns, CAST(0 AS BIGINT) AS duplicate_rows,
  round(1.0 - 0.05 - (CASE WHEN n < 100 THEN 0.4 ELSE 0 END)
    - (CASE WHEN miss > 10 THEN 0.3 WHEN miss > 1 THEN 0.1 ELSE 0 END), 3) + 0.0 AS suitability_score,
  CASE WHEN n < 100 THEN 'needs_attention' ELSE 'ready' END AS suitability_level FROM st""",
)
def profile_query(spark, sf_dir):
    row = profile.profile(_gappy_part(spark, sf_dir)).drop("warnings")
    return rounded(row.withColumn("constant_columns", F.array_join("constant_columns", "|")))


@query(
    "validate",
    f"""WITH {RAW_SQL}, d AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS dup FROM
  (SELECT count(*) AS c FROM raw GROUP BY lines, qty, price, disc, tax))
SELECT count(*) AS n_samples, CAST(5 AS BIGINT) AS n_features, 0.0::DOUBLE AS missing_pct, max(dup) AS duplicate_count,
  '' AS constant_dims, count(*) >= 50 AS enough_samples,
  round(1.0 - 0.2 * max(dup) / count(*), 6) + 0.0 AS suitability_score FROM raw CROSS JOIN d""",
)
def validate_query(spark, sf_dir):
    row = profile.validate(order_table(spark, sf_dir), ORDER_COLS)
    return rounded(row.withColumn("constant_dims", F.array_join(F.col("constant_dims").cast("array<string>"), "|")))


@query(
    "impute_zero",
    f"WITH {GAPPY_SQL} SELECT p_partkey, CAST(coalesce(p_size, 0) AS DOUBLE) AS p_size, "
    "round(coalesce(p_retailprice, 0), 6) + 0.0 AS p_retailprice FROM gp",
)
def impute_zero_query(spark, sf_dir):
    filled = profile.impute_zero(_gappy_part(spark, sf_dir), ["p_size", "p_retailprice"])
    return rounded(filled.select("p_partkey", "p_size", "p_retailprice"))


# --- normalisation ---------------------------------------------------------------------------

Z = ", ".join(f"{r(f'x{i}')} AS {c}" for i, c in enumerate(ORDER_COLS))


@query("standardize", f"WITH {STD_SQL} SELECT id, {Z} FROM pts")
def standardize_query(spark, sf_dir):
    return rounded(normalize.standardize(order_table(spark, sf_dir), ORDER_COLS)[0])


@query(
    "standardize_with_gaps",
    f"""WITH {GAPPY_SQL}, m AS (SELECT avg(p_size) AS ms, stddev_pop(p_size) AS ss, avg(p_retailprice) AS mp,
  stddev_pop(p_retailprice) AS sp FROM gp)
SELECT p_partkey, round((p_size - ms) / ss, 6) + 0.0 AS p_size,
  round((p_retailprice - mp) / sp, 6) + 0.0 AS p_retailprice, 0.0::DOUBLE AS p_flag FROM gp CROSS JOIN m""",
)
def standardize_with_gaps(spark, sf_dir):
    scaled, _ = normalize.standardize(
        _gappy_part(spark, sf_dir).drop("p_brand"), ["p_size", "p_retailprice", "p_flag"]
    )
    # NaN stays NaN; shown as NULL so that both engines compare alike.
    return rounded(scaled.withColumn("p_retailprice", F.nanvl("p_retailprice", F.lit(None))))


@query(
    "inverse_standardize",
    f"WITH {RAW_SQL} SELECT id, " + ", ".join(f"{r(c, 5)} AS {c}" for c in ORDER_COLS) + " FROM raw",
)
def inverse_standardize_query(spark, sf_dir):
    scaled, params = normalize.standardize(order_table(spark, sf_dir), ORDER_COLS)
    return rounded(normalize.inverse_standardize(scaled, params), 5)


@query("ingest", f"WITH {STD_SQL} SELECT id, {Z} FROM pts")
def ingest_query(spark, sf_dir):
    return rounded(normalize.ingest(order_table(spark, sf_dir), "id", ORDER_COLS)[0])


# --- feature graphs ----------------------------------------------------------------------------

CORR_PAIRS = [(i, j) for i in range(5) for j in range(i + 1, 5)]
CORR_SQL = (
    STD_SQL
    + ", ce AS ("
    + " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, abs(corr(x{i}, x{j})) AS weight FROM pts" for i, j in CORR_PAIRS
    )
    + ")"
)


def _edge_rows(edges, digits=6):
    return rounded(edges.select("i", "j", "weight"), digits)


@query("correlation_edges", f"WITH {CORR_SQL} SELECT i, j, {r('weight')} AS weight FROM ce")
def correlation_edges_query(spark, sf_dir):
    return _edge_rows(fg.correlation_edges(order_points(spark, sf_dir)))


def _mi_sql(bins: int) -> str:
    cuts = ", ".join(
        f"quantile_cont(x{c}, {b / bins}) AS q{c}_{b}" for c in range(5) for b in range(1, bins)
    )
    binned = ", ".join(
        " + ".join(f"CAST(x{c} > q{c}_{b} AS INTEGER)" for b in range(1, bins)) + f" AS b{c}"
        for c in range(5)
    )
    pairs = " UNION ALL ".join(
        f"""SELECT {i} AS i, {j} AS j, sum(c / n * ln(c * n / (ca * cb))) AS mi FROM (SELECT c,
  sum(c) OVER () AS n, sum(c) OVER (PARTITION BY b{i}) AS ca, sum(c) OVER (PARTITION BY b{j}) AS cb
  FROM (SELECT b{i}, b{j}, CAST(count(*) AS DOUBLE) AS c FROM bin GROUP BY b{i}, b{j}))"""
        for i, j in CORR_PAIRS
    )
    return f"""{STD_SQL}, cut AS (SELECT {cuts} FROM pts), bin AS (SELECT {binned} FROM pts CROSS JOIN cut),
mi AS ({pairs})"""


@query(
    "mutual_information_edges",
    f"WITH {_mi_sql(fg.MI_BINS)} SELECT i, j, round(greatest(mi, 0) / (SELECT max(mi) FROM mi), 6) + 0.0 AS weight FROM mi",
)
def mutual_information_edges_query(spark, sf_dir):
    return _edge_rows(fg.mutual_information_edges(cut_lineage(order_points(spark, sf_dir))))


THREE = ["lines", "disc", "tax"]
PARTIAL_SQL = (
    STD_SQL
    + """, c3 AS (SELECT corr(x0, x3) AS a, corr(x0, x4) AS b, corr(x3, x4) AS c FROM pts),
pc AS (SELECT 0 AS i, 1 AS j, abs(a - b * c) / sqrt((1 - b * b) * (1 - c * c)) AS weight FROM c3
  UNION ALL SELECT 0, 2, abs(b - a * c) / sqrt((1 - a * a) * (1 - c * c)) FROM c3
  UNION ALL SELECT 1, 2, abs(c - a * b) / sqrt((1 - a * a) * (1 - b * b)) FROM c3),
cc AS (SELECT 0 AS i, 1 AS j, abs(a) AS weight FROM c3 UNION ALL SELECT 0, 2, abs(b) FROM c3
  UNION ALL SELECT 1, 2, abs(c) FROM c3)"""
)


@query("partial_correlation_edges", f"WITH {PARTIAL_SQL} SELECT i, j, {r('weight')} AS weight FROM pc")
def partial_correlation_edges_query(spark, sf_dir):
    points = order_points(spark, sf_dir, THREE)
    return _edge_rows(fg.partial_correlation_edges(points, method="inverse"))


# With a penalty above the correlations of the third column one pair is left, whose solution is closed.
LASSO_PENALTY = 0.3


@query(
    "partial_correlation_edges_lasso",
    f"""WITH {STD_SQL}, c AS (SELECT abs(corr(x1, x2)) - {LASSO_PENALTY} AS w, abs(corr(x1, x3)) AS a, abs(corr(x2, x3)) AS b FROM pts)
SELECT 0 AS i, 1 AS j, {r('w')} AS weight FROM c
UNION ALL SELECT 0, 2, 0.0::DOUBLE FROM c WHERE a <= {LASSO_PENALTY}
UNION ALL SELECT 1, 2, 0.0::DOUBLE FROM c WHERE b <= {LASSO_PENALTY}""",
)
def partial_correlation_lasso_query(spark, sf_dir):
    points = order_points(spark, sf_dir, ["qty", "price", "disc"])
    return _edge_rows(fg.partial_correlation_edges(points, penalty=LASSO_PENALTY))


@query(
    "combine_graphs",
    f"""WITH {PARTIAL_SQL} SELECT i, j, round(sum(weight) / 2, 6) + 0.0 AS weight
  FROM (SELECT * FROM pc UNION ALL SELECT * FROM cc) GROUP BY i, j""",
)
def combine_graphs_query(spark, sf_dir):
    points = order_points(spark, sf_dir, THREE)
    graphs = [fg.correlation_edges(points), fg.partial_correlation_edges(points, method="inverse")]
    return _edge_rows(fg.combine_graphs(graphs))


LIMIT_SQL = "avg(weight) + 1.5 * stddev_pop(weight)"


@query("adaptive_edge_threshold", f"WITH {CORR_SQL} SELECT {r(LIMIT_SQL)} AS threshold FROM ce")
def adaptive_edge_threshold_query(spark, sf_dir):
    return rounded(fg.adaptive_edge_threshold(fg.correlation_edges(order_points(spark, sf_dir))))


@query(
    "threshold_graph",
    f"""WITH {CORR_SQL} SELECT i, j, {r('weight')} AS weight FROM ce
  WHERE weight >= (SELECT {LIMIT_SQL} FROM ce)""",
)
def threshold_graph_query(spark, sf_dir):
    edges = fg.correlation_edges(order_points(spark, sf_dir))
    return _edge_rows(fg.threshold_graph(edges, fg.adaptive_edge_threshold(edges)))


@query(
    "validate_graph",
    f"""WITH {SUPPLY_SQL} SELECT count(*) FILTER (WHERE b.i IS NULL) = 0 AS symmetric,
  count(*) FILTER (WHERE a.weight < 0) = 0 AS non_negative, count(*) FILTER (WHERE a.i = a.j) = 0 AS zero_diagonal
  FROM adj a LEFT JOIN adj b ON a.i = b.j AND a.j = b.i AND a.weight = b.weight""",
)
def validate_graph_query(spark, sf_dir):
    return fg.validate_graph(graph.both_directions(supply_graph(spark, sf_dir)))


@query(
    "validate_one_way_graph",
    "SELECT false AS symmetric, true AS non_negative, true AS zero_diagonal FROM lineitem HAVING count(*) > 0",
)
def validate_one_way_graph(spark, sf_dir):
    return fg.validate_graph(supply_graph(spark, sf_dir))


@query(
    "graph_stats",
    f"""WITH {FOREST_SQL}, c AS (SELECT count(*) AS n, (SELECT count(*) FROM region) AS k FROM tree)
SELECT n - k AS n_edges, round(2.0 * (n - k) / (n * (n - 1)), 9) + 0.0 AS density, k AS n_components,
  round(2.0 * (n - k) / n, 9) + 0.0 AS avg_degree FROM c""",
)
def graph_stats_query(spark, sf_dir):
    return rounded(fg.graph_stats(*geography_forest(spark, sf_dir)), 9)


# Two columns: correlation |r|, scaled information 1, penalised partial correlation |r| - 0.01.
@query(
    "build_feature_graph",
    f"""WITH {STD_SQL} SELECT 0 AS i, 1 AS j,
  round((abs(corr(x0, x1)) + 1 + greatest(abs(corr(x0, x1)) - 0.01, 0)) / 3, 4) + 0.0 AS weight FROM pts""",
)
def build_feature_graph_query(spark, sf_dir):
    points = cut_lineage(order_points(spark, sf_dir, ["lines", "qty"]))
    return _edge_rows(fg.build_feature_graph(points).edges, 4)


@query("build_feature_graph_wide")
def build_feature_graph_wide(spark, sf_dir):
    return _edge_rows(fg.build_feature_graph(cut_lineage(order_points(spark, sf_dir))).edges)


@query(
    "region_feature_graph",
    f"""WITH {CHART_SQL}, g AS (SELECT chart_id, covar_pop(x0, x1) AS c, var_pop(x0) AS a, var_pop(x1) AS b
  FROM cpts GROUP BY chart_id)
SELECT CAST(chart_id AS BIGINT) AS chart_id, 0 AS i, 1 AS j,
  round((abs(c) / sqrt(a * b) + 1 + greatest(abs(c) - 0.01, 0) / sqrt(a * b)) / 3, 4) + 0.0 AS weight FROM g""",
)
def region_feature_graph_query(spark, sf_dir):
    points = cut_lineage(charted_points(spark, sf_dir, ["lines", "qty"]))
    return rounded(fg.region_feature_graph(points, "chart_id"), 4)


# --- edge tables -------------------------------------------------------------------------------


@query("degrees", f"WITH {SUPPLY_SQL} SELECT node, {r('degree')} AS degree FROM deg")
def degrees_query(spark, sf_dir):
    return rounded(graph.degrees(supply_graph(spark, sf_dir)))


@query(
    "laplacian",
    f"""WITH {SUPPLY_SQL} SELECT node AS i, node AS j, degree AS value FROM deg
  UNION ALL SELECT i, j, -weight FROM adj""",
)
def laplacian_query(spark, sf_dir):
    return graph.laplacian(supply_graph(spark, sf_dir))


@query(
    "normalized_laplacian",
    f"""WITH {SUPPLY_SQL} SELECT node AS i, node AS j, 1.0::DOUBLE AS value FROM deg
  UNION ALL SELECT adj.i, adj.j, round(-weight / sqrt(a.degree * b.degree), 6) + 0.0
  FROM adj JOIN deg a ON a.node = adj.i JOIN deg b ON b.node = adj.j""",
)
def normalized_laplacian_query(spark, sf_dir):
    return rounded(graph.normalized_laplacian(supply_graph(spark, sf_dir)))


@query("connected_components", f"WITH {FOREST_SQL} SELECT node, region AS component FROM tree")
def connected_components_query(spark, sf_dir):
    return graph.connected_components(*geography_forest(spark, sf_dir))


@query(
    "shortest_paths",
    f"""WITH {FOREST_SQL} SELECT node, round(CASE WHEN region = 1 THEN dist ELSE -1 END, 6) + 0.0 AS distance
  FROM tree""",
)
def shortest_paths_query(spark, sf_dir):
    edges, nodes = geography_forest(spark, sf_dir)
    found = graph.shortest_paths(edges, nodes, 1)
    far = F.col("distance") == float("inf")
    return rounded(found.withColumn("distance", F.when(far, -1.0).otherwise(F.col("distance"))))


@query(
    "graph_diameter",
    """WITH k AS (SELECT count(*) AS n FROM region)
SELECT round(max(1.0 + a.n_nationkey / 10.0 + 1.0 + b.n_nationkey / 10.0
  + 2.0 * least(abs(a.n_regionkey - b.n_regionkey), n - abs(a.n_regionkey - b.n_regionkey))), 6) + 0.0 AS diameter
  FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey CROSS JOIN k""",
)
def graph_diameter_query(spark, sf_dir):
    value = graph.graph_diameter(*region_ring(spark, sf_dir))
    return rounded(spark.createDataFrame([(value,)], "diameter double"))


@query(
    "clustering_coefficient",
    """WITH l AS (SELECT l_partkey AS p, l_suppkey + 10000000000 AS s, l_orderkey + 20000000000 AS o FROM lineitem),
e AS (SELECT p AS i, s AS j FROM l UNION SELECT s, o FROM l UNION SELECT p, o FROM l),
a AS (SELECT i, j FROM e UNION SELECT j, i FROM e),
d AS (SELECT i AS node, count(*) AS k FROM a GROUP BY i),
t AS (SELECT x.i AS u, x.j AS v, y.j AS w FROM e x JOIN e y ON x.j = y.i JOIN e z ON z.i = x.i AND z.j = y.j),
tn AS (SELECT node, count(*) AS t FROM (SELECT u AS node FROM t UNION ALL SELECT v FROM t UNION ALL SELECT w FROM t)
  GROUP BY node)
SELECT round(avg(CASE WHEN k > 1 THEN 2.0 * coalesce(t, 0) / (k * (k - 1)) ELSE 0 END), 9) + 0.0
  AS clustering_coefficient FROM d LEFT JOIN tn ON d.node = tn.node""",
)
def clustering_coefficient_query(spark, sf_dir):
    return rounded(graph.clustering_coefficient(purchase_graph(spark, sf_dir)), 9)
