"""Trees: tables of contents, paths, subtree texts. Subtrees are intervals of pre-order numbers where those exist."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequences import scan


#: Entries of lower levels than this stand beside each other, whatever their levels.
TOP = 2


def toc_parents(df: DataFrame, level: str, by: list[str], order: str, shape: str = "normal") -> DataFrame:
    """The order value of each entry's parent, null for roots.

    Entries stream past a stack of those that enclose the next one. An entry of the same level replaces the
    last one, one of a lower level all that aren't below it. One of a higher level goes under the last one,
    unless it is of a level below TOP (so a book's title encloses no chapters). flat: no entry goes under
    another. old_kindle: there is one level of nesting.
    """
    barrier = {"normal": None, "flat": 1, "old_kindle": 1}[shape]

    def make():
        stack: list[tuple[int, object]] = []
        last = None

        def step(n: int, at):
            nonlocal last, stack
            if last is not None:
                if n > last and (n < TOP or shape == "flat" or (barrier is not None and len(stack) > barrier)) or n == last:
                    stack = stack[:-1]
                elif n < last:
                    while stack and stack[-1][0] >= n:
                        stack.pop()
            parent, last = stack[-1][1] if stack else None, n
            stack = [*stack, (n, at)]
            return [(parent,)]

        return step

    return scan(df, by, [order], [level, order], make, f"parent {df.schema[order].dataType.simpleString()}")


def enclosing(df: DataFrame, by: list[str], opens: Column, seq: str = "seq", last: str = "last_seq", name: str = "inside") -> DataFrame:
    """The seq of the nearest row around each row for which `opens` holds, null without one."""

    def make():
        stack: list[tuple[int, int]] = []

        def step(at: int, end: int | None, opening: bool | None):
            while stack and stack[-1][1] < at:
                stack.pop()
            inside = stack[-1][0] if stack else None
            if opening:
                stack.append((at, at if end is None else end))
            return [(inside,)]

        return step

    return scan(df, by, [seq], [seq, last, opens], make, f"{name} long")


def nav_depth(entries: DataFrame, by: list[str], order: str, parent: str) -> DataFrame:
    """Depth of the deepest entry of each group, roots at 1. Entries come after their parents."""

    def make():
        depths: dict = {}

        def step(at, up):
            depths[at] = 1 if up is None else depths.get(up, 0) + 1
            return [(depths[at],)]

        return step

    return scan(entries, by, [order], [order, parent], make, "depth int").groupBy(*by).agg(F.max("depth").alias("depth"))


def attached(entries: DataFrame, by: list[str], order: str, parent: str, titled: str) -> DataFrame:
    """Entries without a title go under the last titled one of the same parent before them, if any: column `parent`."""
    w = Window.partitionBy(*by, parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col(titled), F.col(order))).over(w)
    return entries.withColumn("__last", last).withColumn(parent, F.when(~F.col(titled), F.coalesce("__last", parent)).otherwise(F.col(parent))).drop("__last")


def promoted(entries: DataFrame, by: list[str], order: str, parent: str, kept: str, most: int = 100) -> DataFrame:
    """Entries that are kept, with their level; what isn't kept hands its children to its parent. Parents come before children."""

    def make():
        above: dict = {}  # for each entry: the kept one at or above it, and its level

        def step(at, up, keep):
            near = above.get(up, (None, 0))
            above[at] = (at, near[1] + 1) if keep else near
            return [(near[0], near[1] + 1)] if keep else []

        return step

    return scan(entries, by, [order], [order, parent, kept], make, f"{parent} {entries.schema[order].dataType.simpleString()}, level int")


def paths(df: DataFrame, id: str, parent: str, name: str, separator: str = " -> ") -> DataFrame:
    """Path of names from the root and depth of each node, level by level in one recursive query, for any number of nodes.

    Trees deeper than the session's spark.sql.cteRecursionLevelLimit are an error.
    """
    spark, view = df.sparkSession, f"paths_{uuid.uuid4().hex}"
    df.select(F.col(id).alias("id"), F.col(parent).alias("parent"), F.col(name).cast("string").alias("name")).createOrReplaceTempView(view)
    try:
        return spark.sql(f"""
        WITH RECURSIVE t(id, depth, path) AS (
          SELECT id, 0, name FROM {view} WHERE parent IS NULL
          UNION ALL SELECT c.id, t.depth + 1, concat(t.path, '{separator}', c.name) FROM {view} c JOIN t ON c.parent = t.id)
        SELECT id AS `{id}`, depth, concat('[', path, ']') AS path FROM (SELECT * FROM t LIMIT ALL)""")
    finally:
        spark.catalog.dropTempView(view)


def subtree_text(nodes: DataFrame, roots: DataFrame, by: list[str], separator: str = " ") -> DataFrame:
    """Text of each root's subtree in order: by, root, text. Nodes: by, seq, text; roots: by, seq, last_seq. Roots without text have no row.

    Both sides stream in order, past a stack of open roots with their pieces; a mark at each group's end closes what is open.
    """
    r = roots.select(*by, "seq", F.lit(0).alias("side"), F.col("last_seq").alias("last"), F.lit(None).cast("string").alias("text"))
    t = nodes.where(F.coalesce("text", F.lit("")) != "").select(*by, "seq", F.lit(1).alias("side"), F.lit(None).cast("long").alias("last"), "text")
    marks = roots.select(*by).distinct().select(*by, F.lit((1 << 63) - 1).alias("seq"), F.lit(2).alias("side"), F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("text"))

    def make():
        stack: list[tuple[int, int, list[str]]] = []

        def step(at: int, side: int, last: int | None, piece: str | None):
            out = []
            while stack and stack[-1][1] < at:
                root, _, pieces = stack.pop()
                if pieces:
                    out.append((root, separator.join(pieces)))
            if side == 0:
                stack.append((at, at if last is None else last, []))
            elif side == 1:
                for _, _, pieces in stack:
                    pieces.append(piece)
            return out

        return step

    return scan(r.unionByName(t).unionByName(marks), by, ["seq", "side"], ["seq", "side", "last", "text"], make, "root long, text string").select(*by, "root", "text")


def unique_ids(df: DataFrame, id: str, by: list[str], order: list[str]) -> DataFrame:
    """Each id once in its group, column unique_id: one that is taken gets -1, -2, ... with the first number that isn't."""

    def make():
        taken: set[str] = set()

        def step(name: str):
            new, n = name, 0
            while new in taken:
                n += 1
                new = f"{name}-{n}"
            taken.add(new)
            return [(new,)]

        return step

    return scan(df, by, order, [id], make, "unique_id string")
