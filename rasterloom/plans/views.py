"""The driver's tables as images, and the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8x8 grey images: vec_id, y, x, v (double)."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("p", "v"))
    return e.select("vec_id", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def px_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.least(F.greatest(F.floor((F.col("v") + 1) * 127.5), F.lit(0)), F.lit(255)).cast("int")
    return px_embed(spark, sf_dir).withColumn("v", v)


def px_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 3k, 3k+1 and 3k+2 as blue, green and red of image k; incomplete images go."""
    at = lambda k: F.max(F.when(F.col("vec_id") % 3 == k, F.col("v")))
    px = px_byte(spark, sf_dir).withColumn("image_id", F.floor(F.col("vec_id") / 3))
    out = px.groupBy("image_id", "y", "x").agg(at(0).alias("b"), at(1).alias("g"), at(2).alias("r"))
    return out.where("b is not null and g is not null and r is not null")


def px_bgra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As px_rgb, with alpha made from the position: a quarter is clear, a quarter opaque."""
    a = F.when(F.col("x") < 2, 0).when(F.col("x") > 5, 255).otherwise(F.col("x") * 30 + F.col("y") * 10)
    return px_rgb(spark, sf_dir).withColumn("a", a)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-pixel frames: user_id, frame_no, v (byte)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    v = F.least(F.floor(F.col("value") / 2), F.lit(255)).cast("int")
    return read(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("frame_no"), v.alias("v"))


def px_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sixteen vectors as frames of one animation, in four levels so that pixels repeat."""
    px = px_byte(spark, sf_dir)
    return px.select(F.floor(F.col("vec_id") / 16).alias("image_id"), (F.col("vec_id") % 16).cast("int").alias("frame_no"), "y", "x", F.floor(F.col("v") / 16).cast("int").alias("v"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sizes with settings that go through every mode, anchor and kind of crop."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k / n) % len(values) + 1).cast("int"))
    return p.select(
        k.alias("id"),
        (F.col("p_size") * 40).cast("int").alias("image_w"),
        F.greatest(F.floor(F.col("p_retailprice") % 997), F.lit(1)).cast("int").alias("image_h"),
        pick(1, 0, 100, 333, 1000, 37).alias("width"),
        pick(5, 0, 100, 150, 2000).alias("height"),
        pick(20, "crop", "max", "stretch", "pad", "contain").alias("mode"),
        pick(3, "center", "left", "right").alias("anchor_x"),
        pick(7, "top", "center", "bottom").alias("anchor_y"),
        pick(2, 0, 0, 10, 0, 5000).alias("crop_x"),
        pick(2, 0, 0, 20, 0, 0).alias("crop_y"),
        pick(2, 0, 30, 0, 50, 10).alias("crop_w"),
        pick(2, 0, 40, -3, 50, 10).alias("crop_h"),
        pick(11, 0, 0, 100).alias("basis_w"),
        pick(13, 0, 100, 50).alias("basis_h"),
    )


SQL = {
    "px": """px AS (SELECT vec_id, (p // 8)::INT AS y, (p % 8)::INT AS x, v::DOUBLE AS v
 FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS p FROM embeddings))""",
    "pb": "pb AS (SELECT vec_id, y, x, least(greatest(floor((v + 1) * 127.5::DOUBLE), 0), 255)::INT AS v FROM px)",
    "rgb": """rgb AS (SELECT * FROM (SELECT vec_id // 3 AS image_id, y, x, max(CASE WHEN vec_id % 3 = 0 THEN v END) AS b,
 max(CASE WHEN vec_id % 3 = 1 THEN v END) AS g, max(CASE WHEN vec_id % 3 = 2 THEN v END) AS r FROM pb GROUP BY ALL)
 WHERE b IS NOT NULL AND g IS NOT NULL AND r IS NOT NULL)""",
    "bgra": "bgra AS (SELECT *, CASE WHEN x < 2 THEN 0 WHEN x > 5 THEN 255 ELSE x * 30 + y * 10 END AS a FROM rgb)",
    "fr": """fr AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS frame_no,
 least(floor(value / 2), 255)::INT AS v FROM events)""",
    "pf": "pf AS (SELECT vec_id // 16 AS image_id, (vec_id % 16)::INT AS frame_no, y, x, (v // 16)::INT AS v FROM pb)",
}
_NEEDS = {"pb": ("px",), "rgb": ("px", "pb"), "bgra": ("px", "pb", "rgb"), "pf": ("px", "pb")}


def sql(view: str, body: str) -> str:
    """``body`` after the common table expressions that ``view`` needs."""
    return "WITH " + ",\n".join(SQL[v] for v in (*_NEEDS.get(view, ()), view)) + "\n" + body
