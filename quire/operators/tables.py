"""Tables of books: where cells stand, how wide columns are, tables as text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import escape_cell
from .sequences import scan


def placed_cells(cells: DataFrame, by: list[str], row: str = "row", col: str = "col", colspan: str = "colspan", rowspan: str = "rowspan") -> DataFrame:
    """cells with `grid_col`, the column where each stands once the spans of cells before it are taken into account.

    Cells of a table stream in order past the columns that spans from above still take.
    """

    def make():
        taken: dict[int, int] = {}  # column: first row that is free again
        now, at = None, 0

        def step(r: int, wide: int | None, high: int | None):
            nonlocal now, at
            if r != now:
                now, at = r, 0
            while taken.get(at, 0) > r:
                at += 1
            here, wide, high = at, max(wide or 1, 1), max(high or 1, 1)
            for c in range(here, here + wide):
                taken[c] = max(taken.get(c, 0), r + high)
            at += wide
            return [(here,)]

        return step

    return scan(cells, by, [row, col], [row, colspan, rowspan], make, "grid_col int")


def column_count(placed: DataFrame, by: list[str], colspan: str = "colspan") -> DataFrame:
    """Columns of each table of placed cells."""
    return placed.groupBy(*by).agg(F.max(F.col("grid_col") + F.greatest(F.coalesce(F.col(colspan), F.lit(1)), F.lit(1))).alias("columns"))


def most_cells(cells: DataFrame, by: list[str], row: str = "row") -> DataFrame:
    """The number of cells of each table's longest row."""
    return cells.groupBy(*by, row).agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("columns"))


def column_widths(cells: DataFrame, by: list[str], text: str, col: str = "col") -> DataFrame:
    """Characters of the longest text in each column."""
    return cells.groupBy(*by, col).agg(F.max(F.length(text)).alias("width"))


def fitted_widths(placed: DataFrame, by: list[str], need: str, width: float, row: str = "row", colspan: str = "colspan") -> DataFrame:
    """Widths of the columns of tables of placed cells that are `width` wide: by, widths, scale.

    Cells in order: what a cell needs beyond the columns that it spans is shared among these. Columns that
    nothing asks for get an even part. Too wide a table shrinks, what is left is shared.
    """
    cell = F.struct(F.col(row).alias("row"), F.col("grid_col").alias("col"), F.greatest(F.coalesce(F.col(colspan), F.lit(1)), F.lit(1)).alias("span"), F.col(need).cast("double").alias("need"))
    t = placed.groupBy(*by).agg(F.array_sort(F.collect_list(cell)).alias("cells"))  # a table

    def fit(cells: list[dict]) -> tuple[list[float], float]:
        n = max(c["col"] + c["span"] for c in cells)
        least = [0.0] * n
        for c in cells:
            spanned = range(c["col"], min(c["col"] + c["span"], n))
            more = (c["need"] or 0.0) - sum(least[i] for i in spanned)
            if more > 0:
                for i in spanned:
                    least[i] += more / c["span"]
        least = [x if x > 0 else width / n for x in least]
        total = sum(least)
        scale = min(width / total, 1.0)
        return [x * scale if scale < 1 else x + (width - total) / n for x in least], scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fit(c) for c in batch.column("cells").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(b) for b in by), pa.array([m[0] for m in made], pa.list_(pa.float64())), pa.array([m[1] for m in made], pa.float64())], [*by, "widths", "scale"])

    schema = T.StructType([*(t.schema[b] for b in by), *T.StructType.fromDDL("widths array<double>, scale double")])
    return t.mapInArrow(run, schema)


def _lines(cells: DataFrame, by: list[str], text: Column, row: str, col: str) -> DataFrame:
    """Rows of cells as arrays, ragged ones as they are, with the table's number of columns."""
    t = cells.groupBy(*by, row).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(col).alias("c"), text.alias("t")))), lambda x: x.t).alias("cells"))
    return t.withColumn("columns", F.max(F.size("cells")).over(Window.partitionBy(*by)))


def aligned(cells: DataFrame, by: list[str], text: str, row: str = "row", col: str = "col", gap: str = "  ") -> DataFrame:
    """Tables in columns of spaces: by, content."""
    widths = column_widths(cells, by, text, col)
    t = cells.join(widths, [*by, col]).withColumn("__padded", F.rpad(F.coalesce(F.col(text), F.lit("")), F.col("width"), F.lit(" ")))
    lines = _lines(t, by, F.col("__padded"), row, col).withColumn("line", F.rtrim(F.array_join("cells", gap)))
    return _joined(lines, by, row)


def piped(cells: DataFrame, by: list[str], text: str, row: str = "row", col: str = "col") -> DataFrame:
    """Markdown tables: by, content. The first row is the head; short rows are filled."""
    lines = _lines(cells, by, escape_cell(F.coalesce(F.col(text), F.lit(""))), row, col)
    filled = F.concat(F.col("cells"), F.array_repeat(F.lit(""), F.col("columns") - F.size("cells")))
    line = F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("columns").cast("int")), " | "), F.lit(" |"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(row)) == 1
    return _joined(lines.withColumn("line", F.when(first, F.concat(line, F.lit("\n"), rule)).otherwise(line)), by, row)


def _joined(lines: DataFrame, by: list[str], row: str) -> DataFrame:
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), "line"))), lambda x: x.line), "\n").alias("content"))
