"""Recognised text boxes of a page as a table: columns and rows by their centres, cells by nearness.

A page's few boxes are one row's array, over which the centres are folded; pages are dealt out by key, once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gap_centres(values: Column, gap: float) -> Column:
    """Centres of clusters on a line: values in rising order; each either opens a cluster, if it is further than
    ``gap`` from the latest centre, or moves that centre to the middle between them."""
    empty = F.array().cast("array<double>")

    def step(found: Column, value: Column) -> Column:
        latest = F.try_element_at(found, F.lit(-1))
        apart = latest.isNull() | (value - latest > gap)
        return F.when(apart, F.array_append(found, value)).otherwise(F.array_append(F.slice(found, 1, F.size(found) - 1), (latest + value) / 2))

    return F.aggregate(F.array_sort(values), empty, step)


def nearest_centre(centres: Column, value: Column) -> Column:
    """The place, from 0, of the centre nearest to a value; of equally near ones the first."""
    away = F.transform(centres, lambda c: F.abs(c - value))
    return (F.array_position(away, F.array_min(away)) - 1).cast("int")


def grid(boxes: DataFrame, column_gap: float = 30.0, row_gap: float = 16.0) -> DataFrame:
    """(page, row_no, column_no, text, n_boxes, confidence) from (page, text, x1, y1, x2, y2, confidence)."""
    middle = lambda a, b: F.transform("boxes", lambda box: (box[a] + box[b]) / 2)
    pages = boxes.groupBy("page").agg(F.collect_list(F.struct("y1", "x1", "text", "y2", "x2", "confidence")).alias("boxes"))
    pages = pages.withColumn("columns", gap_centres(middle("x1", "x2"), column_gap)).withColumn("rows", gap_centres(middle("y1", "y2"), row_gap))
    placed = pages.select("page", "columns", "rows", F.explode("boxes").alias("box"))
    x, y = (F.col("box.x1") + F.col("box.x2")) / 2, (F.col("box.y1") + F.col("box.y2")) / 2
    cells = placed.select("page", nearest_centre(F.col("rows"), y).alias("row_no"), nearest_centre(F.col("columns"), x).alias("column_no"), "box")
    words = F.transform(F.array_sort(F.collect_list("box")), lambda box: box["text"])
    return cells.groupBy("page", "row_no", "column_no").agg(F.array_join(words, " ").alias("text"), F.count("*").cast("int").alias("n_boxes"), F.avg("box.confidence").alias("confidence"))


def cell_above(boxes: DataFrame, cells: DataFrame) -> DataFrame:
    """(page, box_no, cell_no): for boxes (page, box_no, cx, cy) the last cell (page, cell_no, column_no, x1, x2, y1) at or above
    their middle in a column that spans it, of equally near ones that of the smallest number. Boxes under no cell have no row.

    Boxes meet a page's columns, which are few, and not its cells: cells and boxes of a column are put in one order by
    their height, once, and each box takes the cell that came last."""
    columns = cells.groupBy("page", "column_no").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
    own = boxes.join(columns, "page").where((F.col("cx") >= F.col("x1")) & (F.col("cx") <= F.col("x2")))
    marks = own.select("page", "column_no", F.col("cy").alias("y"), F.lit(1).alias("late"), "box_no", F.lit(None).cast(cells.schema["cell_no"].dataType).alias("cell_no"))
    both = marks.unionByName(cells.select("page", "column_no", F.col("y1").alias("y"), F.lit(0).alias("late"), F.lit(None).cast(boxes.schema["box_no"].dataType).alias("box_no"), "cell_no"))
    order = W.partitionBy("page", "column_no").orderBy("y", "late", F.desc("cell_no")).rowsBetween(W.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("late") == 0, F.struct("y", (-F.col("cell_no")).alias("back"))), ignorenulls=True).over(order)
    found = both.withColumn("seen", seen).where("late = 1 AND seen IS NOT NULL")
    return found.groupBy("page", "box_no").agg(F.max("seen").alias("seen")).select("page", "box_no", (-F.col("seen.back")).alias("cell_no"))
