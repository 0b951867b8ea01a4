"""Tables of a page layout as text: cells, and the side columns that a table finder leaves out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import reading_order
from ..functions import text as X


def table_regions(tables: DataFrame, rows: DataFrame, cells: DataFrame, lines: DataFrame) -> DataFrame:
    """(page, table_id, text, x0, y0, x1, y1): each table's rows as lines of cells joined by bars, and the box they cover.

    tables (page, table_id, x0, y0, x1, y1), rows (table_id, row, y0, y1), cells
    (table_id, row, col, text), lines (page, line, x0, y0, x1, y1, text).  A line of
    at most 100 characters whose middle lies in a row's height, left or right of the
    table, belongs to the row, if that side has such lines on half of the rows, two
    at least.  A row that is Arabic by 45 % is repaired cell by cell and read from
    the right.  Tables without any text are left out.
    """
    box = ("x0", "y0", "x1", "y1")
    t = tables.select("page", "table_id", *[F.col(c).alias(f"t{c}") for c in box])
    r = rows.select("table_id", "row", F.col("y0").alias("ry0"), F.col("y1").alias("ry1")).join(t, "table_id")
    near = lines.where(F.length("text") <= 100).join(r, "page").where(((F.col("y0") + F.col("y1")) / 2).between(F.col("ry0"), F.col("ry1")))
    side = F.when(F.col("x1") <= F.col("tx0") + 2, "left").when(F.col("x0") >= F.col("tx1") - 2, "right")
    beside = near.withColumn("side", side).where("side IS NOT NULL").select("table_id", "row", "side", "line", "text", *box)
    on = beside.groupBy("table_id", "side").agg(F.count_distinct("row").alias("on"))
    size = cells.groupBy("table_id").agg(F.count_distinct("row").alias("n"))
    known = on.join(size, "table_id").where(F.col("on") >= F.greatest(F.lit(2), F.floor((F.col("n") + 1) / 2))).select("table_id", "side")
    extra = beside.join(known, ["table_id", "side"])
    text = F.translate(F.trim(F.coalesce("text", F.lit(""))), "\n", " ")
    place = {"left": 0, "right": 2}
    parts = cells.select("table_id", "row", F.lit(1).alias("at"), F.col("col").alias("k"), text.alias("text")).unionByName(
        extra.select("table_id", "row", F.when(F.col("side") == "left", place["left"]).otherwise(place["right"]).alias("at"), F.col("line").alias("k"), text.alias("text"))
    )
    whole = parts.groupBy("table_id", "row").agg(F.array_sort(F.collect_list(F.struct("at", "k", "text"))).alias("cells"))
    joined = F.array_join(F.transform("cells", lambda c: c["text"]), " ")
    turned = F.reverse(F.transform("cells", lambda c: F.when((c["at"] == 1) & (X.arabic_ratio(c["text"]) >= 0.65), F.reverse(c["text"])).otherwise(reading_order.repaired_cell(c["text"]))))
    read = F.when(X.arabic_ratio(joined) >= 0.45, turned).otherwise(F.transform("cells", lambda c: c["text"]))
    said = whole.select("table_id", "row", read.alias("said")).where(F.exists("said", lambda c: c != ""))
    body = said.groupBy("table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", F.array_join("said", " | ").alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    more = extra.groupBy("table_id").agg(F.min("x0").alias("ex0"), F.min("y0").alias("ey0"), F.max("x1").alias("ex1"), F.max("y1").alias("ey1"))
    grown = [(F.least if c.endswith("0") else F.greatest)(f"t{c}", F.coalesce(f"e{c}", f"t{c}")).alias(c) for c in box]
    return body.join(t, "table_id").join(more, "table_id", "left").select("page", "table_id", "text", *grown)


def prose_lines(lines: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines whose middle lies in no table's box."""
    r = regions.select("page", *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = ((F.col("x0") + F.col("x1")) / 2).between(F.col("rx0"), F.col("rx1")) & ((F.col("y0") + F.col("y1")) / 2).between(F.col("ry0"), F.col("ry1"))
    gone = lines.join(r, "page").where(inside).select("page", "line").distinct()
    return lines.join(gone, ["page", "line"], "left_anti")

