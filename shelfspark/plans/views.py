"""Catalogue-shaped views over the supplied star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.grouping import top_per_group
from shelfspark.session import tune


class Catalogue:
    """Lazy views; every property is a fresh plan over the Parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows are dealt over all cores, for work that costs much per row.

        A scan has no more tasks than row groups: a million short rows can be one.
        """
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 4 * self.spark.sparkContext.defaultParallelism)
        return self.table(name).repartition(tasks)

    @property
    def store(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            key.alias("store_id"), F.concat(F.lit("store-"), key.cast("string")).alias("slug"),
            F.col("s_name").alias("name"), (key % 20 != 0).alias("active"), (key % 3 != 1).alias("verified"))

    @property
    def location(self) -> DataFrame:
        key = F.col("s_suppkey")
        branches = (
            self.table("supplier")
            .join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("b", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        )
        return branches.select(
            (key * 10 + F.col("b")).alias("location_id"), key.alias("store_id"), F.col("n_name").alias("city"),
            ((F.col("b") != 2) | (key % 7 != 0)).alias("active"),
            (F.lit(45.4) + ((key * 37 + F.col("b") * 13) % 310).cast("double") / 100).alias("latitude"),
            (F.lit(26.4) + ((key * 53 + F.col("b") * 29) % 420).cast("double") / 100).alias("longitude"))

    @property
    def product(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.table("part").select(
            key.alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"),
            F.col("p_type").alias("category_slug"), F.col("p_retailprice").cast("decimal(14,2)").alias("price"),
            F.when(key % 3 == 0, F.concat(F.lit("484"), F.lpad((key % 400).cast("string"), 10, "0"))).alias("ean"),
            F.when(key % 4 == 1, F.concat(F.lit("M"), (key % 90).cast("string"))).alias("mpn"),
            F.when(key % 5 == 2, F.concat(F.lit("S"), (key % 70).cast("string"))).alias("sku"))

    @property
    def obs(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("store_id"),
            F.col("l_orderkey").alias("seq1"), F.col("l_linenumber").alias("seq2"),
            F.col("l_shipdate").alias("seen_at"),
            F.col("l_extendedprice").cast("decimal(14,2)").alias("price"),
            (F.floor(F.col("l_extendedprice") / 20000) * 20000).cast("decimal(14,2)").alias("band_price"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.when(F.col("l_returnflag") == "R", "OUT_OF_STOCK").when(F.col("l_quantity") <= 10, "LOW_STOCK")
            .otherwise("IN_STOCK").alias("stock_status"))

    @property
    def offer(self) -> DataFrame:
        newest = [F.col(c).desc() for c in ("seen_at", "seq1", "seq2")]
        return top_per_group(self.obs, ["product_id", "store_id"], newest).select(
            "product_id", "store_id", (F.col("product_id") * 100000 + F.col("store_id")).alias("offer_id"),
            "price", "band_price", "quantity", "stock_status", F.col("seen_at").alias("last_seen_at"))

    @property
    def availability(self) -> DataFrame:
        p, l = F.col("product_id"), F.col("location_id")
        turn, stock = (p + l) % 5, ((p * 7 + l) % 30).cast("int")
        rows = self.offer.join(self.location.select("store_id", "location_id"), "store_id")
        return rows.select(
            "offer_id", "location_id",
            F.when(turn == 0, 0).when(turn == 1, F.lit(None)).otherwise(stock).cast("int").alias("quantity"),
            F.when(turn == 0, "OUT_OF_STOCK").when(turn == 1, "UNKNOWN").when(turn == 2, "PREORDER")
            .otherwise(F.when(stock <= 10, "LOW_STOCK").otherwise("IN_STOCK")).alias("stock_status"),
            F.expr("last_seen_at - (INTERVAL 1 DAY) * CAST((product_id + location_id) % 9 AS INT)").alias("last_seen_at"))

    @property
    def run(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            F.col("event_id").alias("run_id"), (F.col("user_id") % 100).alias("store_id"),
            F.col("ts").alias("started_at"),
            F.when(kind == "error", "FAILED").when(kind == "signup", "PARTIAL").when(kind == "view", "RUNNING")
            .otherwise("SUCCESS").alias("status"),
            F.floor("value").cast("int").alias("products_found"))

    @property
    def category(self) -> DataFrame:
        """Regions are roots, nations their children."""
        roots = self.table("region").select(
            F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("category_id"),
            F.lower("r_name").alias("slug"), F.col("r_name").alias("name_ru"), F.lit(None).cast("string").alias("parent_id"))
        leaves = self.table("nation").select(
            F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("category_id"),
            F.lower("n_name").alias("slug"), F.col("n_name").alias("name_ru"),
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id"))
        return roots.unionByName(leaves)


# The same views as SQL text, for the comparison engine.
VIEWS_SQL = {
    "fx_store": """SELECT s_suppkey AS store_id, 'store-' || CAST(s_suppkey AS STRING) AS slug, s_name AS name,
        s_suppkey % 20 <> 0 AS active, s_suppkey % 3 <> 1 AS verified FROM supplier""",
    "fx_location": """SELECT s_suppkey * 10 + b AS location_id, s_suppkey AS store_id, n_name AS city,
        b <> 2 OR s_suppkey % 7 <> 0 AS active,
        CAST(45.4 AS DOUBLE) + CAST((s_suppkey * 37 + b * 13) % 310 AS DOUBLE) / 100 AS latitude,
        CAST(26.4 AS DOUBLE) + CAST((s_suppkey * 53 + b * 29) % 420 AS DOUBLE) / 100 AS longitude
        FROM supplier JOIN nation ON s_nationkey = n_nationkey CROSS JOIN (VALUES (0), (1), (2)) AS br(b)""",
    "fx_product": """SELECT p_partkey AS product_id, p_name AS title, p_brand AS brand, p_type AS category_slug,
        CAST(p_retailprice AS DECIMAL(14,2)) AS price,
        CASE WHEN p_partkey % 3 = 0 THEN '484' || lpad(CAST(p_partkey % 400 AS STRING), 10, '0') END AS ean,
        CASE WHEN p_partkey % 4 = 1 THEN 'M' || CAST(p_partkey % 90 AS STRING) END AS mpn,
        CASE WHEN p_partkey % 5 = 2 THEN 'S' || CAST(p_partkey % 70 AS STRING) END AS sku FROM part""",
    "fx_obs": """SELECT l_partkey AS product_id, l_suppkey AS store_id, l_orderkey AS seq1, l_linenumber AS seq2,
        l_shipdate AS seen_at, CAST(l_extendedprice AS DECIMAL(14,2)) AS price,
        CAST(floor(l_extendedprice / 20000) * 20000 AS DECIMAL(14,2)) AS band_price, CAST(l_quantity AS INT) AS quantity,
        CASE WHEN l_returnflag = 'R' THEN 'OUT_OF_STOCK' WHEN l_quantity <= 10 THEN 'LOW_STOCK' ELSE 'IN_STOCK' END AS stock_status
        FROM lineitem""",
    "fx_offer": """SELECT product_id, store_id, product_id * 100000 + store_id AS offer_id, price, band_price, quantity,
        stock_status, seen_at AS last_seen_at
        FROM (SELECT *, row_number() OVER (PARTITION BY product_id, store_id ORDER BY seen_at DESC, seq1 DESC, seq2 DESC) AS rn
        FROM fx_obs) t WHERE rn = 1""",
    "fx_availability": """SELECT o.offer_id, l.location_id,
        CASE WHEN (o.product_id + l.location_id) % 5 = 0 THEN 0 WHEN (o.product_id + l.location_id) % 5 = 1 THEN NULL
            ELSE CAST((o.product_id * 7 + l.location_id) % 30 AS INT) END AS quantity,
        CASE (o.product_id + l.location_id) % 5 WHEN 0 THEN 'OUT_OF_STOCK' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'PREORDER'
            ELSE CASE WHEN (o.product_id * 7 + l.location_id) % 30 <= 10 THEN 'LOW_STOCK' ELSE 'IN_STOCK' END END AS stock_status,
        o.last_seen_at - (INTERVAL 1 DAY) * CAST((o.product_id + l.location_id) % 9 AS INT) AS last_seen_at
        FROM fx_offer o JOIN fx_location l ON o.store_id = l.store_id""",
    "fx_run": """SELECT event_id AS run_id, user_id % 100 AS store_id, ts AS started_at,
        CASE event_type WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'PARTIAL' WHEN 'view' THEN 'RUNNING' ELSE 'SUCCESS' END AS status,
        CAST(floor(value) AS INT) AS products_found FROM events""",
    "fx_category": """SELECT 'r' || r_regionkey AS category_id, lower(r_name) AS slug, r_name AS name_ru,
        CAST(NULL AS VARCHAR) AS parent_id FROM region
        UNION ALL SELECT 'n' || n_nationkey, lower(n_name), n_name, 'r' || n_regionkey FROM nation""",
}
_NEEDS = {"fx_offer": ("fx_obs",), "fx_availability": ("fx_obs", "fx_offer", "fx_location")}


def with_views(sql: str, *views: str) -> str:
    """Prefix a query with the views it reads, dependencies first."""
    order: list[str] = []
    for view in views:
        for name in (*_NEEDS.get(view, ()), view):
            if name not in order:
                order.append(name)
    body = ",\n".join(f"{name} AS ({VIEWS_SQL[name]})" for name in order)
    text = sql.strip()
    if not body:
        return text
    return f"WITH {body},\n{text[5:]}" if text[:5].upper() == "WITH " else f"WITH {body}\n{text}"
