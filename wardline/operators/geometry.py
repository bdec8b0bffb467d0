"""Boxes and grids of a screen as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dims
from .latest import few

COLUMNS, CELL_COLUMNS, CELL_ROWS = 2, 4, 5


def scaled(x: Column, ratio: Column) -> Column:
    return F.bround(x * ratio, 0).cast("int")


def grid(spark, width: int, height: int, header: int = 0, columns: int = COLUMNS) -> DataFrame:
    """The equal split of a screen: a box of each bed and vital (dense, beds by vitals)."""
    beds, vitals = dims.bed_dim(spark).withColumnRenamed("ord", "bi"), dims.vital_dim(spark).select("vital", F.col("ord").alias("vi"))
    rows = -(-len(dims.BEDS) // columns)
    w, h = width // columns, (height - header) // rows
    cells = beds.crossJoin(F.broadcast(vitals))  # 6 x 20 fixed rows
    cells = cells.withColumns({"bx": (F.col("bi") % columns) * w, "by": F.floor(F.col("bi") / columns) * h + header, "row": F.floor(F.col("vi") / CELL_COLUMNS), "col": F.col("vi") % CELL_COLUMNS})
    cw, ch = w // CELL_COLUMNS, h // CELL_ROWS
    return cells.select("bed", "vital", "row", "col", (F.col("bx") + F.col("col") * cw).alias("x1"), (F.col("by") + F.col("row") * ch).alias("y1")).withColumns({"x2": F.col("x1") + cw, "y2": F.col("y1") + ch})


def inset(df: DataFrame, pixels: int, width: int, height: int) -> DataFrame:
    """Boxes drawn in on all sides and clipped to the frame; those with nothing left are dropped."""
    cut = {"x1": F.greatest(F.lit(0), F.col("x1") + pixels), "y1": F.greatest(F.lit(0), F.col("y1") + pixels), "x2": F.least(F.lit(width), F.col("x2") - pixels), "y2": F.least(F.lit(height), F.col("y2") - pixels)}
    return df.withColumns(cut).where("x2 > x1 and y2 > y1")


def widened(df: DataFrame, vitals: list[str], ratio: float, width: int) -> DataFrame:
    extra = F.when(F.col("vital").isin(vitals), F.bround((F.col("x2") - F.col("x1")) * ratio, 0).cast("int")).otherwise(0)
    return df.withColumn("x2", F.least(F.lit(width), F.col("x2") + extra))


def nearest_rectangle(boxes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target box the candidate of least L1 distance, the first of equals. ``targets`` is a table of screens: few by nature."""
    sides = ("left", "top", "width", "height")
    distance = sum(F.abs(F.col(s) - F.col(f"t_{s}")) for s in sides)
    renamed = targets.select("idx", *[F.col(s).alias(f"t_{s}") for s in sides])
    return boxes.crossJoin(few(renamed)).groupBy("box").agg(F.min_by("idx", F.struct(distance.alias("d"), F.col("idx"))).alias("idx"), F.min(distance).alias("distance"))


def evenly(first: Column, last: Column, n: Column) -> Column:
    """``n`` places from the first to the last, both included; one place is the first."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: first + (last - first) * F.coalesce(F.try_divide(i, n - 1), F.lit(0.0)))
