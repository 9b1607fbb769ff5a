"""Deterministic rasters, stacks and catalogs over relational tables: stand-ins that both engines define alike. They aren't photographs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt over the session's shuffle partitions: a table that is small as a file is read by one task, however dear its rows are."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame of WIDTH columns (frame_id, x, y, r, g, b) from orders."""
    v = "CAST(round(o_totalprice * 100) AS BIGINT)"
    o = table(spark, sf_dir, "orders").where("o_orderkey IS NOT NULL")
    return o.select(F.lit(0).alias("frame_id"), F.expr(f"o_orderkey % {WIDTH}").alias("x"), F.expr(f"o_orderkey div {WIDTH}").alias("y"), *[F.expr(f"({v} % {m}) / {m - 1}e0").alias(c) for c, m in zip("rgb", (997, 991, 983))])


PIXELS = f"(SELECT 0 AS frame_id, o_orderkey % {WIDTH} AS x, o_orderkey // {WIDTH} AS y, " + ", ".join(f"(CAST(round(o_totalprice * 100) AS BIGINT) % {m}) / {m - 1}e0 AS {c}" for c, m in zip("rgb", (997, 991, 983))) + " FROM orders)"
PIXEL_COLUMNS = ("frame_id", "x", "y", "r", "g", "b")
HEIGHT = f"(SELECT max(o_orderkey) // {WIDTH} + 1 FROM orders)"


def height(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] // WIDTH + 1


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A burst: several samples (stack_id, x, y, seq, r, g, b) of each pixel from lineitem; seq orders a pixel's samples by all their values."""
    li = table(spark, sf_dir, "lineitem")
    rgb = [F.expr("l_quantity / 50e0").alias("r"), F.expr("(CAST(round(l_extendedprice * 100) AS BIGINT) % 991) / 990e0").alias("g"), F.expr("l_discount * 10e0").alias("b")]
    df = li.select(F.lit(0).alias("stack_id"), F.expr(f"l_orderkey % {WIDTH}").alias("x"), F.expr(f"l_orderkey div {WIDTH}").alias("y"), *rgb)
    from pyspark.sql import Window as W

    return df.withColumn("seq", F.row_number().over(W.partitionBy("x", "y").orderBy("r", "g", "b")))


SAMPLES = f"(SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY r, g, b) AS seq FROM (SELECT 0 AS stack_id, l_orderkey % {WIDTH} AS x, l_orderkey // {WIDTH} AS y, l_quantity / 50e0 AS r, (CAST(round(l_extendedprice * 100) AS BIGINT) % 991) / 990e0 AS g, l_discount * 10e0 AS b FROM lineitem))"


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A photo catalog (uri, name, rating, pick_status, capture_date, bytes) from documents and labels."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    d = d.join(l, "doc_id", "left")
    ext = F.expr("element_at(array('dng', 'JPG', 'arw', 'tif', 'NEF'), CAST(doc_id % 5 AS INT) + 1)")
    return d.select("doc_id", F.concat(F.lit("content://"), F.col("doc_id").cast("string")).alias("uri"), F.concat(F.lit("IMG_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("name"), F.expr("CAST(coalesce(quality, 0) * 3 + coalesce(toxic, 0) AS INT)").alias("rating"), F.expr("CASE WHEN quality = 1 THEN 'PICKED' WHEN quality = 0 THEN 'REJECTED' ELSE 'NONE' END").alias("pick_status"), F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('2024/01/', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) END").alias("capture_date"), F.col("n_chars").alias("bytes"))


CATALOG = """(SELECT doc_id, 'content://' || doc_id AS uri, 'IMG_' || doc_id || '.' || list_extract(['dng', 'JPG', 'arw', 'tif', 'NEF'], doc_id % 5 + 1) AS name,
  CAST(coalesce(quality, 0) * 3 + coalesce(toxic, 0) AS INTEGER) AS rating, CASE WHEN quality = 1 THEN 'PICKED' WHEN quality = 0 THEN 'REJECTED' ELSE 'NONE' END AS pick_status,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE '2024/01/' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS capture_date, n_chars AS bytes
  FROM documents LEFT JOIN labels USING (doc_id))"""
