"""Layout of a page from its boxes (I29): skew, rows, blocks, and the cells of each block's grid.

A box is (page, box, x0, y0, x1, y1, x2, y2): its upper left, upper right and lower left corner, y downwards. Everything
is windows over the boxes of a page; pages are independent. No join: boxes that come dealt by page are not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: In heights of a page's median box: how far a box's middle may lie below its row's first one; the gap that ends a block.
SAME_ROW, BLOCK_GAP = 0.6, 1.6
#: The share of a column that a box has to cover to be in it, and its width relative to the column's from which it counts as one cell.
COVERS = 0.5


def page_skew(boxes: DataFrame) -> DataFrame:
    """(page, skew): degrees by which the page is turned clockwise: the median angle of the boxes' upper edges."""
    angle = F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    return boxes.groupBy("page").agg(F.median(angle).alias("skew"))


def straightened(boxes: DataFrame) -> DataFrame:
    """The boxes turned back by their page's skew: page, box, skew, left, right, top, bottom."""
    angle = F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")))
    turned = boxes.withColumn("skew", F.median(angle).over(W.partitionBy("page")))
    cos, sin = F.cos(F.radians("skew")), F.sin(F.radians("skew"))
    x = lambda k: F.col(f"x{k}") * cos + F.col(f"y{k}") * sin
    y = lambda k: F.col(f"y{k}") * cos - F.col(f"x{k}") * sin
    return turned.select("page", "box", "skew", x(0).alias("left"), x(1).alias("right"), y(0).alias("top"), y(2).alias("bottom"))


def _numbered(rows: DataFrame, begins: Column, order: W, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(F.when(begins, 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("int") - 1)


def page_rows(boxes: DataFrame) -> DataFrame:
    """Boxes with ``row`` and ``block`` of their page from 0 down, and ``nth`` in the row from the left.

    A row goes on as long as the middles of its boxes, sorted, follow each other within ``SAME_ROW`` heights; a block
    ends where the empty space below a row is over ``BLOCK_GAP`` heights.
    """
    flat = straightened(boxes).withColumn("middle", (F.col("top") + F.col("bottom")) / 2)
    rows = flat.withColumn("height", F.median(F.col("bottom") - F.col("top")).over(W.partitionBy("page")))
    down = W.partitionBy("page").orderBy("middle", "left", "box")
    before = F.lag("middle").over(down)
    rows = _numbered(rows.withColumn("__new", before.isNull() | (F.col("middle") - before > SAME_ROW * F.col("height"))), F.col("__new"), down, "row").drop("__new")
    own, by_row = W.partitionBy("page", "row"), W.partitionBy("page").orderBy("row")
    rows = rows.withColumn("nth", (F.row_number().over(own.orderBy("left", "box")) - 1).cast("int"))
    above = F.max("bottom").over(by_row.rangeBetween(W.unboundedPreceding, -1))
    rows = rows.withColumns({"__top": F.min("top").over(own), "__above": above})
    begins = (F.col("nth") == 0) & (F.col("__above").isNull() | (F.col("__top") - F.col("__above") > BLOCK_GAP * F.col("height")))
    block = F.count_if(begins).over(by_row.rangeBetween(W.unboundedPreceding, 0)) - 1
    return rows.withColumn("block", block.cast("int")).drop("__top", "__above")


def page_cells(boxes: DataFrame) -> DataFrame:
    """Boxes with row, block, ``column`` and ``span`` (columns covered) in their block's grid.

    A block's columns are the stretches that the boxes of its fullest rows take, joined where they overlap: a box
    that spans columns stands in a row with fewer boxes, so it doesn't join them. A box belongs to each column of
    which it covers half, or else to the nearest one.
    """
    rows = page_rows(boxes)
    in_row = F.count("*").over(W.partitionBy("page", "row"))
    counted = rows.withColumn("__n", in_row)
    full = counted.withColumn("__most", F.max("__n").over(W.partitionBy("page", "block"))).where("__n = __most")
    across = W.partitionBy("page", "block").orderBy("left", "right", "box")
    seen = F.max("right").over(across.rowsBetween(W.unboundedPreceding, -1))
    columns = _numbered(full.withColumn("__new", seen.isNull() | (F.col("left") >= seen)), F.col("__new"), across, "column")
    columns = columns.groupBy("page", "block", "column").agg(F.min("left").alias("__l"), F.max("right").alias("__r"))
    grid = columns.groupBy("page", "block").agg(F.array_sort(F.collect_list(F.struct("column", F.col("__l").alias("l"), F.col("__r").alias("r")))).alias("grid"))
    told = rows.join(grid, ["page", "block"])
    overlap = lambda c: F.least(F.col("right"), c["r"]) - F.greatest(F.col("left"), c["l"])
    # of a wider column than itself a box needs half of its own width
    within = F.filter("grid", lambda c: overlap(c) >= COVERS * F.least(c["r"] - c["l"], F.col("right") - F.col("left")))
    middle = (F.col("left") + F.col("right")) / 2
    nearest = F.array_min(F.transform("grid", lambda c: F.struct(F.abs((c["l"] + c["r"]) / 2 - middle).alias("d"), c["column"].alias("column"))))["column"]
    told = told.withColumn("__in", within).withColumn("column", F.coalesce(F.get("__in", F.lit(0))["column"], nearest))
    return told.withColumn("span", F.greatest(F.size("__in"), F.lit(1))).drop("__in", "grid")


def page_layout(boxes: DataFrame) -> DataFrame:
    """(page, skew, boxes, rows, blocks, tables): a table is a block of at least two rows and two columns."""
    cells = page_cells(boxes)
    grids = cells.groupBy("page", "block").agg(F.count_distinct("row").alias("r"), (F.max(F.col("column") + F.col("span"))).alias("c"), F.count("*").alias("n"), F.first("skew").alias("skew"))
    return grids.groupBy("page").agg(F.first("skew").alias("skew"), F.sum("n").alias("boxes"), F.sum("r").alias("rows"), F.count("*").alias("blocks"), F.count(F.when((F.col("r") >= 2) & (F.col("c") >= 2), 1)).alias("tables"))
