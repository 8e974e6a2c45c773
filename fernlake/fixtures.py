"""Detection tables made from the driver's order tables, for Spark and, as text, for SQL.

Boxes and scores come from integers, so every engine computes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.runtime import table

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus"
_WIDTH = "case o_orderkey % 3 when 0 then 640 when 1 then 1024 else 2048 end"
_HEIGHT = "case o_orderkey % 3 when 0 then 480 when 1 then 768 else 1536 end"
_BOX = {"x": "cast((l_partkey * 37) % 400 as double)", "y": "cast((l_suppkey * 53) % 300 as double)", "w": "cast(40 + l_quantity as double)", "h": "cast(40 + (l_partkey * l_linenumber) % 50 as double)"}
_SHIFTED = {"x1": ("x", "l_suppkey % 61 - 30"), "y1": ("y", "l_partkey % 61 - 30"), "x2": ("x + w", "l_suppkey % 61 - 30"), "y2": ("y + h", "l_partkey % 61 - 30")}


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # numbered by the image's name, so that what groups by image next finds an image's lines together
    named = table(spark, sf_dir, "lineitem").withColumn("image_id", F.col("l_orderkey").cast("string")).repartition("image_id")
    numbered = named.withColumn("rn", F.expr(f"row_number() over (partition by image_id order by {_LINE_ORDER})"))
    return numbered.select("image_id", "l_partkey", "l_suppkey", "l_linenumber", "rn", *[F.expr(e).alias(c) for c, e in _BOX.items()])


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey as string) as image_id", "concat('img_', o_orderkey, '.jpg') as file_name", f"{_WIDTH} as width", f"{_HEIGHT} as height")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr("image_id", "cast(rn - 1 as int) as gt_idx", "x", "y", "w", "h", "l_partkey % 22 as category_id")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations(spark, sf_dir).selectExpr("image_id", "gt_idx", "x as x1", "y as y1", "x + w as x2", "y + h as y2", "category_id")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_partkey % 22 as id").distinct().selectExpr("id", "concat('class_', id) as name")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = {"own": "(l_partkey + l_suppkey) % 10 < 8", "pred_idx": "cast(2 * (rn - 1) as int)", **{c: f"{a} + {s}" for c, (a, s) in _SHIFTED.items()}, "score": "((l_partkey * 31 + l_suppkey * 17) % 1000) / 1000D"}
    close = {"own": "l_linenumber % 3 = 0", "pred_idx": "cast(2 * (rn - 1) + 1 as int)", "x1": "x + 3", "y1": "y + 3", "x2": "x + w + 3", "y2": "y + h + 3", "score": "((l_partkey * 13 + l_suppkey * 7) % 1000) / 1000D"}
    both = ", ".join(f"struct({', '.join(f'{e} as {c}' for c, e in one.items())})" for one in (near, close))
    return _lines(spark, sf_dir).select("image_id", F.expr(f"inline(array({both}))")).filter("own").drop("own")


def encodings(spark: SparkSession, sf_dir: str, bits: int = 64) -> DataFrame:
    """Sign bits of the first ``bits`` components, the first the most significant."""
    fold = f"aggregate(slice(embedding, 1, {bits}), 0L, (h, x) -> shiftleft(h, 1) | if(x > 0, 1L, 0L))"
    return table(spark, sf_dir, "embeddings").selectExpr("concat('vec_', vec_id, '.jpg') as file_name", f"{fold} as hash")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("concat('img_', o_orderkey, '.jpg') as file_name", "format_string('group_%06d', o_custkey) as group_id")


SQL_LINES = f"""lines as (
  select *, {", ".join(f"{e} as {c}" for c, e in _BOX.items())}
  from (select *, row_number() over (partition by l_orderkey order by {_LINE_ORDER}) as rn from lineitem))"""
SQL_IMAGES = f"images as (select cast(o_orderkey as varchar) as image_id, 'img_' || o_orderkey || '.jpg' as file_name, {_WIDTH} as width, {_HEIGHT} as height from orders)"
SQL_ANNOTATIONS = f"{SQL_LINES}, annotations as (select cast(l_orderkey as varchar) as image_id, cast(rn - 1 as int) as gt_idx, x, y, w, h, l_partkey % 22 as category_id from lines)"
SQL_TRUTHS = f"{SQL_ANNOTATIONS}, truths as (select image_id, gt_idx, x as x1, y as y1, x + w as x2, y + h as y2, category_id from annotations)"
SQL_PREDICTIONS = f"""predictions as (
  select cast(l_orderkey as varchar) as image_id, cast(2 * (rn - 1) as int) as pred_idx, {", ".join(f"{a} + {s} as {c}" for c, (a, s) in _SHIFTED.items())}, ((l_partkey * 31 + l_suppkey * 17) % 1000) / 1000.0::double as score
  from lines where (l_partkey + l_suppkey) % 10 < 8
  union all
  select cast(l_orderkey as varchar), cast(2 * (rn - 1) + 1 as int), x + 3, y + 3, x + w + 3, y + h + 3, ((l_partkey * 13 + l_suppkey * 7) % 1000) / 1000.0::double
  from lines where l_linenumber % 3 = 0)"""
SQL_GROUPS = "groups as (select 'img_' || o_orderkey || '.jpg' as file_name, printf('group_%06d', o_custkey) as group_id from orders)"
SQL_CATEGORIES = "categories as (select distinct l_partkey % 22 as id, 'class_' || l_partkey % 22 as name from lineitem)"


def sql_encodings(bits: int) -> str:
    """The same hashes as unsigned numbers."""
    weights = " + ".join(f"case when embedding[{i + 1}] > 0 then (1::hugeint << {bits - 1 - i}) else 0::hugeint end" for i in range(bits))
    return f"encodings as (select 'vec_' || vec_id || '.jpg' as file_name, {weights} as hash from embeddings)"
