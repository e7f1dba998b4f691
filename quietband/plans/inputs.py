"""Point sets and graphs derived from the benchmark tables, for Spark and for SQL.

Every Spark function here has a twin SQL fragment (a chain of common table
expressions), so that registered queries and their oracles start from the same
rows.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietband.functions.vectors import feature_array
from quietband.operators.normalize import standardize
from quietband.session import cut_lineage, ensure_checkpoint_dir

ORDER_COLS = ["lines", "qty", "price", "disc", "tax"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder next to the checkpoints, visible to all executors."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/out-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, widen integers: the form in which results are compared."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("double", "float"):
            column = F.round(column.cast("double"), digits) + F.lit(0.0)
        elif kind in ("int", "smallint", "tinyint"):
            column = column.cast("long")
        columns.append(column.alias(name))
    return df.select(*columns)


def cells(array: str, count: int, prefix: str = "x") -> list[Column]:
    """The entries of an array as columns ``x0, x1, ..``."""
    return [F.get(F.col(array), F.lit(i)).alias(f"{prefix}{i}") for i in range(count)]


def r(expression: str, digits: int = 6) -> str:
    """SQL twin of ``rounded`` for one expression."""
    return f"round({expression}, {digits}) + 0.0"


# --- orders as points: five numbers per order ------------------------------------------


def order_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five numbers per order. The few lines of an order are added in the order of their values,
    so that equal orders get equal sums however their lines are spread over partitions."""
    lines = table(spark, sf_dir, "lineitem")
    parts = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    listed = lines.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.count("*").cast("double").alias("lines"),
        F.sort_array(F.collect_list(F.struct(*parts))).alias("parts"),
    )
    qty, price, disc, tax = (F.array_compact(F.col(f"parts.{p}")) for p in parts)

    def total(values: Column) -> Column:
        return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda a, b: a + b))

    return listed.select(
        "id",
        "lines",
        total(qty).alias("qty"),
        total(price).alias("price"),
        (total(disc) / F.size(disc)).alias("disc"),
        (total(tax) / F.size(tax)).alias("tax"),
    )


def order_points(spark: SparkSession, sf_dir: str, columns=ORDER_COLS) -> DataFrame:
    """``(id, features)``, standardised."""
    scaled, _ = standardize(order_table(spark, sf_dir).select("id", *columns), list(columns))
    return scaled.select("id", feature_array(columns).alias("features"))


def stored_order_points(spark: SparkSession, sf_dir: str, columns=ORDER_COLS) -> DataFrame:
    """``order_points`` for many steps: the lines are read and grouped once, what follows reads written tables."""
    raw = cut_lineage(order_table(spark, sf_dir).select("id", *columns))
    scaled, _ = standardize(raw, list(columns))
    return cut_lineage(scaled.select("id", feature_array(columns).alias("features")))


def order_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, chart_id)``: the number of each order's priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("chart_id"),
    )


def charted_points(spark: SparkSession, sf_dir: str, columns=ORDER_COLS) -> DataFrame:
    """Order points with the number of their priority as chart."""
    return order_points(spark, sf_dir, columns).join(order_charts(spark, sf_dir), "id")


RAW_SQL = """raw AS (
  SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS lines, sum(l_quantity) AS qty,
         sum(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax
  FROM lineitem GROUP BY l_orderkey)"""

STD_SQL = (
    RAW_SQL
    + ", mom AS (SELECT "
    + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(ORDER_COLS))
    + " FROM raw), pts AS (SELECT id, "
    + ", ".join(f"({c} - m{i}) / s{i} AS x{i}" for i, c in enumerate(ORDER_COLS))
    + " FROM raw CROSS JOIN mom)"
)

CHART_SQL = (
    STD_SQL
    + """, cpts AS (SELECT pts.*, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS chart_id
  FROM pts JOIN orders ON o_orderkey = pts.id)"""
)

# --- a fixed path graph over three columns and its eigenbasis ---------------------------

PATH_COLS = ["lines", "qty", "price"]
PATH_EDGES = [(0, 1, 1.0), (1, 2, 1.0)]
S2, S3, S6 = math.sqrt(2), math.sqrt(3), math.sqrt(6)


def path_graph(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PATH_EDGES, "i int, j int, weight double")


# Eigenvalues 0, 1, 3; the sign rule makes the largest entry of each vector positive.
PATH_SQL = (
    STD_SQL
    + """, gft AS (SELECT id, (x0 + x1 + x2) / sqrt(3) AS c0, (x0 - x2) / sqrt(2) AS c1,
  (2 * x1 - x0 - x2) / sqrt(6) AS c2 FROM pts)"""
)

# --- scored orders: fixed chart and identity basis --------------------------------------

SCORE_BANDS = [(0, 2), (3, 4)]
CHART_IDS = [1, 2, 3, 4, 5]

NORM_SQL = (
    CHART_SQL
    + """, res AS (SELECT id, chart_id, x0 - (x0 + x1 + x2) / 3 AS r0, x1 - (x0 + x1 + x2) / 3 AS r1,
  x2 - (x0 + x1 + x2) / 3 AS r2, x3 AS r3, x4 AS r4 FROM cpts),
norms AS (SELECT id, chart_id, sqrt(r0 * r0 + r1 * r1 + r2 * r2) AS n0,
  sqrt(r3 * r3 + r4 * r4) AS n1 FROM res),
expd AS (SELECT chart_id, avg(n0) AS m0, var_pop(n0) AS v0, avg(n1) AS m1, var_pop(n1) AS v1,
  count(*) AS n FROM norms GROUP BY chart_id)"""
)
SCORE_SQL = (
    NORM_SQL
    + """, zs AS (SELECT id, norms.chart_id, (n0 - m0) / sqrt(v0) AS z0, (n1 - m1) / sqrt(v1) AS z1
  FROM norms JOIN expd ON norms.chart_id = expd.chart_id),
sc AS (SELECT *, greatest(abs(z0), abs(z1)) AS score FROM zs),
med AS (SELECT median(score) AS ms, median(abs(z0)) AS m0, median(abs(z1)) AS m1 FROM sc),
thr AS (SELECT ms + 3 * 1.4826 * median(abs(score - ms)) AS ts,
  (m0 + 3 * 1.4826 * median(abs(abs(z0) - m0))) * (ln(2) + 1) AS t0,
  (m1 + 3 * 1.4826 * median(abs(abs(z1) - m1))) * (ln(2) + 1) AS t1
  FROM sc CROSS JOIN med GROUP BY ms, m0, m1),
fl AS (SELECT sc.*, score > ts AS is_anomaly, abs(z0) > t0 AS f0, abs(z1) > t1 AS f1
  FROM sc CROSS JOIN thr)"""
)


# --- graphs over keys -------------------------------------------------------------------

SUPPLIER_BASE = 10_000_000_000
ORDER_BASE = 20_000_000_000


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and suppliers, weighted by the number of line items they share."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("i"), (F.col("l_suppkey") + SUPPLIER_BASE).alias("j"))
        .agg(F.count("*").cast("double").alias("weight"))
    )


SUPPLY_SQL = f"""e AS (SELECT l_partkey AS i, l_suppkey + {SUPPLIER_BASE} AS j,
  CAST(count(*) AS DOUBLE) AS weight FROM lineitem GROUP BY 1, 2),
adj AS (SELECT i, j, weight FROM e UNION ALL SELECT j, i, weight FROM e),
deg AS (SELECT i AS node, sum(weight) AS degree FROM adj GROUP BY i)"""


def geography_forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers hang on nations, nations on regions: edges and nodes."""
    nation, customer, supplier, region = (
        table(spark, sf_dir, t) for t in ("nation", "customer", "supplier", "region")
    )
    n = F.col("n_nationkey").cast("long") + 1000
    edges = (
        nation.select(
            F.col("n_regionkey").cast("long").alias("i"),
            n.alias("j"),
            (1.0 + F.col("n_nationkey") / 10.0).alias("weight"),
        )
        .unionByName(
            customer.select(
                (F.col("c_nationkey").cast("long") + 1000).alias("i"),
                (F.col("c_custkey") + SUPPLIER_BASE).alias("j"),
                (1.0 + F.col("c_custkey") % 7).alias("weight"),
            )
        )
        .unionByName(
            supplier.select(
                (F.col("s_nationkey").cast("long") + 1000).alias("i"),
                (F.col("s_suppkey") + ORDER_BASE).alias("j"),
                (2.0 + F.col("s_suppkey") % 5).alias("weight"),
            )
        )
    )
    ends = edges.select(F.explode(F.array("i", "j")).alias("node"))
    nodes = ends.unionByName(region.select(F.col("r_regionkey").cast("long").alias("node"))).distinct()
    return edges, nodes


FOREST_SQL = f"""nat AS (SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(n_nationkey AS BIGINT) + 1000 AS node,
  1.0 + n_nationkey / 10.0 AS dist FROM nation),
leaf AS (SELECT CAST(c_nationkey AS BIGINT) + 1000 AS parent, c_custkey + {SUPPLIER_BASE} AS node,
    1.0 + c_custkey % 7 AS w FROM customer
  UNION ALL SELECT CAST(s_nationkey AS BIGINT) + 1000, s_suppkey + {ORDER_BASE}, 2.0 + s_suppkey % 5 FROM supplier),
tree AS (SELECT CAST(r_regionkey AS BIGINT) AS region, CAST(r_regionkey AS BIGINT) AS node, 0.0 AS dist FROM region
  UNION ALL SELECT region, node, dist FROM nat
  UNION ALL SELECT region, leaf.node, dist + w FROM leaf JOIN nat ON leaf.parent = nat.node)"""


def region_ring(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nations hang on their region; regions form a ring with edges of length 2."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    size = region.count()
    edges = nation.select(
        F.col("n_regionkey").cast("long").alias("i"),
        (F.col("n_nationkey").cast("long") + 1000).alias("j"),
        (1.0 + F.col("n_nationkey") / 10.0).alias("weight"),
    ).unionByName(
        region.select(
            F.col("r_regionkey").cast("long").alias("i"),
            ((F.col("r_regionkey") + 1) % size).cast("long").alias("j"),
            F.lit(2.0).alias("weight"),
        )
    )
    nodes = edges.select(F.explode(F.array("i", "j")).alias("node")).distinct()
    return edges, nodes


def purchase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item links its part, supplier and order with each other."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("p"),
        (F.col("l_suppkey") + SUPPLIER_BASE).alias("s"),
        (F.col("l_orderkey") + ORDER_BASE).alias("o"),
    )
    pairs = F.array(*[F.struct(F.col(a).alias("i"), F.col(b).alias("j")) for a, b in ("ps", "so", "po")])
    return lines.select(F.explode(pairs).alias("e")).select("e.i", "e.j", F.lit(1.0).alias("weight"))


# --- embeddings -------------------------------------------------------------------------

EMBED_D = 64


def embedding_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, features, label)``."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label"
    )


EMBED_SQL = "emb AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
# All pairs with their squared distance; the oracle may be quadratic, the engine may not.
PAIRS_SQL = (
    EMBED_SQL
    + """, prs AS (SELECT a.id AS query, b.id AS neighbor,
  list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS sq
  FROM emb a CROSS JOIN emb b),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sq, neighbor) - 1 AS rank FROM prs)"""
)
