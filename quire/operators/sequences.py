"""Ordered operators: numbering, positions, pages, spans, chunks. Windows share one shuffle on `by`."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Characters after which a line may break, beside white space.
BREAKS = "-–—,.;:!?)]}»\"'/"
_BOUNDARY = re.compile("[\t-\r \x85\xa0  -     　" + re.escape(BREAKS) + "]")


def page_ends(text: str, size: int) -> list[int]:
    """Ends of pages of `size` characters, each moved back to just after its last boundary unless that is its first character."""
    ends, at, n = [], 0, len(text)
    while n - at >= size:
        end = at + size
        for i in range(end - 1, at, -1):
            if _BOUNDARY.match(text, i):
                end = i + 1
                break
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def page_split(df: DataFrame, text: str, size: int, keys: list[str]) -> DataFrame:
    """One row for each page: keys, page, start, n_chars, marked (whether a page marker follows).

    Splitting is sequential within a text, so each text is one call; texts spread over the tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, page, start, length, marked = [], [], [], [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                a = 0
                for k, b in enumerate(page_ends(t or "", size)):
                    of.append(i)
                    page.append(k + 1)
                    start.append(a)
                    length.append(b - a)
                    a = b
                    marked.append(len(t) - start[-1] >= size)
            ix = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(ix) for k in keys), pa.array(page, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(marked, pa.bool_())], [*keys, "page", "start", "n_chars", "marked"])

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, F.col(text).alias("__text")).mapInArrow(run, f"{kinds}, page int, start long, n_chars long, marked boolean")


#: Values of the first order column in a block of a two-level sum.
BLOCK = 4096


def scan(df: DataFrame, by: list[str], order: list, inputs: list, make: Callable, added: str) -> DataFrame:
    """df with columns `added`, for what can only be told in order: sorted rows of a group stream past a state.

    make() gives a function of the inputs' values that is called for each row of a group in order and
    returns what to add, one tuple for each row to come out. Only the state is held, never the group.
    """
    names = [f.name for f in T.StructType.fromDDL(added)]
    kinds = [to_arrow_type(f.dataType) for f in T.StructType.fromDDL(added)]
    keys, at = [f"__k{i}" for i in range(len(by))], [f"__v{i}" for i in range(len(inputs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            rows, made = [], []
            values = zip(*(batch.column(c).to_pylist() for c in at), strict=True) if at else ((),) * batch.num_rows
            for i, (key, value) in enumerate(zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), values, strict=True)):
                if key != now:
                    now, step = key, make()
                for out in step(*value):
                    rows.append(i)
                    made.append(out)
            columns = zip(*made, strict=True) if made else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(rows, pa.int64())), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["row", *names])

    t = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), *((c if isinstance(c, Column) else F.col(c)).alias(k) for c, k in zip(inputs, at, strict=True)), *((c if isinstance(c, Column) else F.col(c)).alias(f"__o{i}") for i, c in enumerate(order)))
    t = t.repartition(*keys).sortWithinPartitions(*keys, *(f"__o{i}" for i in range(len(order)))).drop(*(f"__o{i}" for i in range(len(order))))
    t = t.mapInArrow(run, T.StructType([t.schema["row"], *T.StructType.fromDDL(added)]))
    return t.select(*(F.col(f"row.`{c}`") for c in df.columns if c not in names), *names)


def prefix_sum(df: DataFrame, value: str, by: list[str], order: list[str], name: str = "start") -> DataFrame:
    """Sum of the values before each row in its group.

    If the first order column is a whole number the sum has two levels, blocks of BLOCK of its values and
    rows within a block, so that a group with most rows is spread over many tasks.
    """
    before = lambda *keys: Window.partitionBy(*by, *keys)
    none = F.lit(0)
    if not isinstance(df.schema[order[0]].dataType, T.IntegralType):
        w = before().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(w), none).cast("long"))
    t = df.withColumn("__block", F.coalesce(F.floor(F.col(order[0]) / BLOCK), F.lit(-(1 << 62))))
    sums = t.groupBy(*by, "__block").agg(F.sum(value).alias("__sum"))
    along = before().orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*(F.col(b).alias(f"__by{i}") for i, b in enumerate(by)), F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(along), none).alias("__base"))
    within = before("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("__local", F.coalesce(F.sum(value).over(within), none))
    on = F.col("__block") == F.col("__b")
    for i, b in enumerate(by):
        on = on & F.col(b).eqNullSafe(F.col(f"__by{i}"))
    return t.join(sums, on).select(*df.columns, (F.col("__base") + F.col("__local")).cast("long").alias(name))


def running_pages(df: DataFrame, length: str, size: int, by: list[str], order: list[str]) -> DataFrame:
    """The page on which each row starts, from 1 on."""
    return prefix_sum(df, length, by, order).withColumn("page", (F.floor(F.col("start") / size) + 1).cast("long"))


def position_map(df: DataFrame, length: str, by: list[str], order: list[str]) -> DataFrame:
    """Position of each element and, at the end of each group, a sentinel row with null order columns."""
    at = prefix_sum(df, length, by, order, "pid").select(*by, *order, "pid", F.col(length).cast("long").alias("length"))
    end = df.groupBy(*by).agg(F.sum(length).cast("long").alias("pid")).select(*by, *(F.lit(None).cast(df.schema[o].dataType).alias(o) for o in order), "pid", F.lit(0).cast("long").alias("length"))
    return at.unionByName(end)


def location_map(df: DataFrame, length: str, by: list[str], order: list[str], every: int = 40) -> DataFrame:
    """One row for each multiple of `every` positions: by, order, location, offset in the element."""
    t = prefix_sum(df, length, by, order, "pid").where(F.col(length) > 0)
    first, last = F.ceil(F.col("pid") / every) * every, F.col("pid") + F.col(length) - 1
    t = t.where(first <= last).withColumn("at", F.explode(F.sequence(first, last, F.lit(every).cast("long"))))
    return t.select(*by, *order, (F.col("at") / every + 1).cast("long").alias("location"), (F.col("at") - F.col("pid")).cast("long").alias("offset"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """The value of right's latest row at or before each left row's time, null without one.

    Both sides go through one window as one table, so there is one shuffle and no join of ranges.
    Right rows of one time go by value, the highest counts.
    """
    cols = left.columns
    marked = left.select(F.struct(*cols).alias("__row"), *by, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    marked = marked.unionByName(right.select(F.lit(None).cast(marked.schema["__row"].dataType).alias("__row"), *by, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v")))
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("as_of", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select("__row.*", "as_of")


def merged_spans(df: DataFrame, start: str, end: str, by: list[str], order: list[str]) -> DataFrame:
    """Spans that overlap become one: by, group, start, end, n."""
    w = Window.partitionBy(*by).orderBy(start, *order)
    t = df.withColumn("__max", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    t = t.withColumn("__new", F.when(F.col("__max").isNull() | (F.col(start) > F.col("__max")), 1).otherwise(0)).withColumn("group", F.sum("__new").over(w))
    return t.groupBy(*by, "group").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def gaps(df: DataFrame, totals: DataFrame, start: str, end: str, by: list[str], total: str) -> DataFrame:
    """Stretches of 0..total that no span of a group covers: before, between and after its spans, or all of it.

    totals: by, total. Groups of no length have no gaps.
    """
    ends = totals.where(F.col(total) > 0).select(*by, F.col(total).cast("long").alias("__start"), F.col(total).cast("long").alias("__end"), F.lit(1).alias("__last"))
    spans = df.select(*by, F.col(start).cast("long").alias("__start"), F.col(end).cast("long").alias("__end"), F.lit(0).alias("__last"))
    w = Window.partitionBy(*by).orderBy("__last", "__start", "__end").rowsBetween(Window.unboundedPreceding, -1)
    t = spans.join(totals.where(F.col(total) > 0).select(*by), by, "left_semi").union(ends)
    t = t.withColumn("__covered", F.greatest(F.lit(0).cast("long"), F.coalesce(F.max("__end").over(w), F.lit(0).cast("long"))))
    return t.where(F.col("__start") > F.col("__covered")).select(*by, F.col("__covered").alias("gap_start"), F.col("__start").alias("gap_end"))


def outer_spans(df: DataFrame, start: str, length: str, style: str, link: str, by: list[str]) -> DataFrame:
    """Of spans at one place one: that with a link, else that with the longest style, else the first style. Numbered from the outer ones in."""
    pick = [F.col(link).isNull().cast("int"), -F.length(F.coalesce(style, F.lit(""))), F.col(style), F.col(link)]
    t = best_row(df, [*by, start, length], pick)
    return t.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(start, F.desc(length))))


def best_row(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, the first in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def byte_chunks(df: DataFrame, text: str, size: int, by: list[str], order: list[str]) -> DataFrame:
    """Number of the chunk of at most `size` bytes into which each row goes, and its offset; no row is split.

    Filling is sequential in a group; sorted rows stream through with the filled bytes in hand.
    """
    cols = [*by, *order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunk, used = object(), 0, 0
        for batch in batches:
            chunks, offsets = [], []
            for *key, n in zip(*(batch.column(c).to_pylist() for c in [*by, "__n"]), strict=True):
                if key != now:
                    now, chunk, used = key, 0, 0
                if used and used + n > size:
                    chunk, used = chunk + 1, 0
                chunks.append(chunk)
                offsets.append(used)
                used += n
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), pa.array(chunks, pa.int64()), pa.array(offsets, pa.int64())], [*cols, "chunk", "offset"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in cols)
    t = df.select(*cols, F.coalesce(F.octet_length(text), F.lit(0)).alias("__n"))
    return t.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, f"{kinds}, chunk long, offset long")


def numbered(df: DataFrame, value: str, name: str) -> DataFrame:
    """Distinct values with their rank, from 1 on, in two levels: blocks of values, then values in a block.

    Blocks are thousands of whole numbers or strings with the same first three characters; one task sees a
    row for each block.
    """
    whole = isinstance(df.schema[value].dataType, T.IntegralType)
    block = F.floor(F.col(value) / BLOCK) if whole else F.substring(value, 1, 3)
    t = df.select(value).distinct().withColumn("__block", block)
    counts = t.groupBy("__block").agg(F.count("*").alias("__n"))
    along = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    counts = counts.select("__block", F.coalesce(F.sum("__n").over(along), F.lit(0)).alias("__base"))
    t = t.withColumn("__local", F.row_number().over(Window.partitionBy("__block").orderBy(value)))
    return t.join(counts, "__block").select(value, (F.col("__base") + F.col("__local")).alias(name))


def labels(df: DataFrame, body: str, order: list[str]) -> DataFrame:
    """Notes with the number of their body and their own in it, label `body.note`."""
    w = Window.partitionBy(body).orderBy(*order)
    return df.withColumn("note_no", F.row_number().over(w)).join(numbered(df, body, "body_no"), body).withColumn("label", F.concat_ws(".", F.col("body_no").cast("string"), F.col("note_no").cast("string")))


def page_flow(df: DataFrame, text: str, size: int, by: list[str], order: list[str], forced: str | None = None) -> DataFrame:
    """Rows (df's columns, page, at, n_chars, marked): texts of a group cut into pages by one counter that runs on through them.

    A page ends at the last boundary after the chunk's first character, else where it is full; what stands
    after that boundary counts for the next page. forced: rows before which a page begins anyway.
    """

    def make():
        counter, pages = 0, 0

        def step(t: str | None, new: bool | None):
            nonlocal counter, pages
            if new:
                counter, pages = 0, pages + 1
            t, out, at, boundary, pos = t or "", [], 0, -1, 0
            while pos < len(t):
                if _BOUNDARY.match(t, pos):
                    boundary = pos
                counter, pos = counter + 1, pos + 1
                if counter >= size:
                    cut = boundary + 1 if boundary > at else pos
                    counter = pos - cut
                    out.append((pages, at, cut - at, True))
                    pages, at, boundary = pages + 1, cut, -1
            if at < len(t):
                out.append((pages, at, len(t) - at, False))
            return out

        return step

    return scan(df, by, order, [F.col(text), F.col(forced) if forced else F.lit(False)], make, "page long, at long, n_chars long, marked boolean")


def approximate_pages(df: DataFrame, text: str, length: str, new: str, size: int, by: list[str], order: list[str]) -> DataFrame:
    """Where pages of `size` characters start: by, order, offset, page.

    A page that is full ends after the last boundary behind the first character that it has of the element, else
    where it is full. A row that begins a section ends the page before it. Elements without text count by their
    length, one character at least.
    """

    def make():
        page, used = 1, 0

        def step(t: str | None, n: int | None, begins: bool | None):
            nonlocal page, used
            if begins and used:
                page, used = page + 1, 0
            n = len(t) if t else max(n or 0, 1)
            out, at = [], 0
            while at < n:
                if not used:
                    out.append((at, page))
                end = min(n, at + size - used)
                used += end - at
                if used >= size:
                    cut = next((i for i in range(end, at + 1, -1) if _BOUNDARY.match(t, i - 1)), end) if t else end
                    at, used, page = cut, 0, page + 1
                else:
                    at = end
            return out

        return step

    return scan(df, by, order, [text, length, new], make, "offset long, page long").select(*by, *order, "offset", "page")


def ordinals(df: DataFrame, by: list[str], paragraph: str, order: list[str]) -> DataFrame:
    """Number of each paragraph in its book and of each sentence in its paragraph, both from 1 on."""
    p = Window.partitionBy(*by).orderBy(paragraph)
    return df.withColumn("paragraph_no", F.dense_rank().over(p)).withColumn("sentence_no", F.row_number().over(Window.partitionBy(*by, paragraph).orderBy(*order)))


def page_labels(refs: DataFrame, by: list[str], page: str, target: str, order: list[str]) -> DataFrame:
    """References with the number of their target on the page, counted from 1 in order of its first reference there."""
    first = refs.groupBy(*by, page, target).agg(F.min(F.struct(*order)).alias("__first"))
    first = first.withColumn("label", F.row_number().over(Window.partitionBy(*by, page).orderBy("__first"))).drop("__first")
    return refs.join(first, [*by, page, target])


def reading_queue(refs: DataFrame, nested: DataFrame, by: list[str], source: str, target: str, order: list[str], most: int = 20) -> DataFrame:
    """Notes in order of their first reference, those that only notes refer to after them, by round: by, target, round, n.

    refs: by, target, order (references in the text); nested: by, source, target, order (references in the
    notes). Each round adds the notes that the one before refers to and that aren't queued yet; more rounds than
    `most` with anything to add are an error.
    """
    queue = refs.groupBy(*by, target).agg(F.min(F.struct(*order)).alias("__at")).withColumn("round", F.lit(0))
    w = lambda: Window.partitionBy(*by).orderBy("__at")
    queue = queue.select(*by, target, "round", F.row_number().over(w()).cast("long").alias("n"))
    last = queue
    for k in range(1, most + 2):
        more = nested.select(*by, F.col(source).alias("__from"), target, *order).join(last.select(*by, F.col(target).alias("__from"), F.col("n").alias("__n")), [*by, "__from"])
        more = more.groupBy(*by, target).agg(F.min(F.struct("__n", *order)).alias("__at")).join(queue.select(*by, target), [*by, target], "left_anti")
        size = queue.groupBy(*by).agg(F.max("n").alias("__base"))
        more = more.withColumn("n", F.row_number().over(w())).join(size, by).select(*by, target, F.lit(k).alias("round"), (F.col("__base") + F.col("n")).cast("long").alias("n"))
        if more.isEmpty():
            return queue
        if k > most:
            raise ValueError(f"notes refer to notes through more than {most} rounds")
        queue, last = queue.union(more), more
    return queue
