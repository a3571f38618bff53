"""Ids, links and what they refer to. A book's rows share `by` columns, the unit of every shuffle here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import broken_link_text, image_ending, is_font_type, is_image_type, link_class, resource_filename
from .sequences import BLOCK, as_of, prefix_sum

def hrefs(df: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """One row for each link in order: keys, pos, href. A generator after the scan, without a shuffle."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit('<a [^>]*href="([^"]*)"'), 1)).alias("pos", "href"))


#: References in one row of an index.
PART = 10_000


def reverse_index(links: DataFrame, target: str, order: list[str], by: list[str] = (), most: int = PART) -> DataFrame:
    """For each target: number of references and their places in order; a target with more than about `most` has several rows, by `part`."""
    n = links.groupBy(*by, target).agg(F.count("*").alias("n_refs"))
    ref = F.struct(*order)
    part = F.pmod(F.xxhash64(*order), F.ceil(F.col("n_refs") / most)).cast("int")
    t = links.join(n, [*by, target]).select(*by, target, "n_refs", part.alias("part"), ref.alias("ref"))
    return t.groupBy(*by, target, "n_refs", "part").agg(F.array_sort(F.collect_list("ref")).alias("refs"))


def places(links: DataFrame, target: str, order: list[str], by: list[str] = ()) -> DataFrame:
    """For each target one row: number of references and their places in order as one text, null if none has all of its values.

    If the first order column is a whole number, blocks of BLOCK of its values become texts first, so that
    only these meet in one task.
    """
    whole = isinstance(links.schema[order[0]].dataType, T.IntegralType)
    t = links.withColumn("__block", F.floor(F.col(order[0]) / BLOCK) if whole else F.lit(0).cast("long"))
    ref = F.when(F.concat(*order).isNotNull(), F.struct(*order))
    text = lambda r: F.array_join(F.array(*(r[o].cast("string") for o in order)), "/")
    t = t.groupBy(*by, target, "__block").agg(F.count("*").alias("__n"), F.array_join(F.transform(F.array_sort(F.collect_list(ref)), text), " ").alias("__text"))
    part = F.when(F.col("__text") != "", F.struct("__block", "__text"))
    t = t.groupBy(*by, target).agg(F.sum("__n").alias("n_refs"), F.array_sort(F.collect_list(part)).alias("__parts"))
    return t.select(*by, target, "n_refs", F.when(F.size("__parts") > 0, F.array_join("__parts.__text", " ")).alias("places"))


def id_index(nodes: DataFrame, id: str, order: str, by: list[str], last: bool = True) -> DataFrame:
    """The node of each id: the last one with it, or the first. Blank ids are left out."""
    t = nodes.where(F.coalesce(F.trim(id), F.lit("")) != "")
    row = F.struct(*(c for c in nodes.columns if c not in (*by, id)))
    pick = (F.max_by if last else F.min_by)(row, F.col(order))
    return t.groupBy(*by, id).agg(pick.alias("node"))


def broken(links: DataFrame, ids: DataFrame, target: str, id: str, by: list[str] = ()) -> DataFrame:
    """Links without a target: an anti join."""
    on = [links[b] == ids[b] for b in by] + [links[target] == ids[id]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return links.join(ids, cond, "left_anti")


def repaired(links: DataFrame, ids: DataFrame, by: list[str]) -> DataFrame:
    """links (by, seq, href, text) with `kind` and the text that replaces a broken one. Repeating it changes nothing."""
    known = ids.select(*by, F.col("xml_id").alias("__target")).distinct().withColumn("__known", F.lit(True))
    t = links.withColumn("kind", link_class(F.col("href"))).withColumn("__target", F.regexp_replace("href", "^#", "")).join(known, [*by, "__target"], "left")
    bad = F.col("kind").isin("empty", "broken") | ((F.col("kind") == "internal") & F.col("__known").isNull())
    return t.select(*(c for c in links.columns if c not in ("href", "text")), F.when(bad, None).otherwise(F.col("href")).alias("href"), F.when(bad, broken_link_text(F.col("__target"), F.col("text"), F.col("kind"))).otherwise(F.col("text")).alias("text"), "kind", bad.alias("was_broken"))


def referenced(rows: DataFrame, refs: DataFrame, on: list[str], always: Column | None = None) -> DataFrame:
    """Rows that something refers to (a semi join), and those that stay always."""
    if always is None:
        return rows.join(refs, on, "left_semi")
    return rows.where(~always).join(refs, on, "left_semi").unionByName(rows.where(always))


def first_seen(df: DataFrame, value: Column, order: list[str], by: list[str] = ()) -> DataFrame:
    """Distinct values, each with the place where it stands first. Partial aggregation before the shuffle."""
    return df.select(*by, value.alias("value"), F.struct(*order).alias("__at")).groupBy(*by, "value").agg(F.min("__at").alias("__at")).select(*by, "value", "__at.*")


def unused_ids(rows: DataFrame, existing: DataFrame, order: list[str], by: list[str], number: str = "number") -> DataFrame:
    """Give the k-th row of each group the k-th positive number that `existing` (by, number) does not hold.

    The first n + m numbers of a group hold n free ones if m are taken, so the rest is an anti join
    and a rank on either side.
    """
    n = rows.groupBy(*by).agg(F.count("*").alias("__n"))
    m = existing.groupBy(*by).agg(F.count_distinct(number).alias("__m"))
    some = n.join(m, by, "left").select(*by, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n") + F.coalesce("__m", F.lit(0)))).alias("number"))
    free = some.join(existing.select(*by, F.col(number).cast("long").alias("number")), [*by, "number"], "left_anti")
    free = free.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("number")))
    ranked = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.join(free, [*by, "__k"]).drop("__k")


def backlinks(refs: DataFrame, target: str, order: list[str]) -> DataFrame:
    """References with their ordinal for a target and the id ref-<target>-<ordinal>."""
    w = Window.partitionBy(target).orderBy(*order)
    return refs.withColumn("n", F.row_number().over(w)).withColumn("ref_id", F.concat_ws("-", F.lit("ref"), F.col(target).cast("string"), F.col("n").cast("string")))


def first_match(rows: DataFrame, rules: DataFrame, fields: list[str], order: str) -> DataFrame:
    """rows with the other columns of the first rule in order whose fields all equal theirs, whatever their case; "*" and "" match anything.

    Rules go by the fields that they leave open. For each such pattern one rule is left of those that ask for the
    same, so each is an equi-join that keeps every row as it is; the first of what a row found counts.
    """
    rest = [c for c in rules.columns if c not in fields]
    is_open = [F.coalesce(F.col(f), F.lit("")).isin("*", "") for f in fields]
    r = rules.select(F.array(*is_open).alias("__open"), *(F.lower(f).alias(f"__r{i}") for i, f in enumerate(fields)), F.struct(F.col(order).alias("__order"), *(F.col(c).alias(c) for c in rest)).alias("__rule"))
    t, found = rows, []
    for k, (pattern,) in enumerate(r.select("__open").distinct().sort("__open").collect()):  # at most 2 ** fields
        asked = [i for i, o in enumerate(pattern) if not o]
        keys = [f"__r{i}" for i in asked]
        one = r.where(F.col("__open") == F.array(*map(F.lit, pattern))).groupBy(*keys).agg(F.min_by("__rule", F.col("__rule.__order")).alias(f"__m{k}"))
        if asked:
            on = F.lower(rows[fields[asked[0]]]) == one[keys[0]]
            for i in asked[1:]:
                on = on & (F.lower(rows[fields[i]]) == one[f"__r{i}"])
            t = t.join(one, on, "left").drop(*keys)
        else:  # one rule, the same for every row
            kind, rule = one.schema[f"__m{k}"].dataType, one.first()[0]
            t = t.withColumn(f"__m{k}", F.struct(*(F.lit(rule[f.name]).cast(f.dataType).alias(f.name) for f in kind)))
        found.append(F.col(f"__m{k}"))
    best = F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull())) if len(found) > 1 else found[0] if found else None
    if best is None:
        return rows.select("*", *(F.lit(None).cast(rules.schema[c].dataType).alias(c) for c in rest))
    return t.withColumn("__best", best).select(*rows.columns, *(F.col(f"__best.{c}").alias(c) for c in rest))


def missing_images(binaries: DataFrame, ids: DataFrame, broken: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Broken picture links (book_id, ...) pointed at a stand-in, column `href`, and one stand-in for each book that needs one.

    Its id is not-found-N with the first N that no id of the book has. binaries and ids: book_id, and id or xml_id.
    """
    number = lambda c: F.regexp_extract(F.col(c), "^not-found-(0|[1-9][0-9]{0,8})$", 1)
    taken = ids.select("book_id", number("xml_id").alias("n")).union(binaries.select("book_id", number("id").alias("n"))).where("n <> ''").groupBy("book_id").agg(F.collect_set(F.col("n").cast("int")).alias("taken"))
    need = broken.select("book_id").distinct().join(taken, "book_id", "left")
    all_ = F.coalesce("taken", F.array().cast("array<int>"))
    free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(all_)), all_))
    need = need.select("book_id", F.concat(F.lit("not-found-"), free.cast("string")).alias("id"))
    pointed = broken.drop("href").join(need.select("book_id", F.concat(F.lit("#"), "id").alias("href")), "book_id")
    return pointed, need.withColumn("mime", F.lit("image/svg+xml"))


def first_file(rows: DataFrame, by: list[str], id: str, file: str, order: list[str]) -> DataFrame:
    """The file in which each id stands first: by, id, file."""
    return rows.where(F.coalesce(F.trim(id), F.lit("")) != "").groupBy(*by, id).agg(F.min_by(F.col(file), F.struct(*order)).alias(file))


def filed_links(links: DataFrame, files: DataFrame, by: list[str], file: str) -> DataFrame:
    """Links (by, file, href): #id becomes file#id where the id stands in another file; unknown ids stay."""
    t = files.select(*by, F.concat(F.lit("#"), F.col("xml_id")).alias("href"), F.col(file).alias("__to"))
    return links.join(t, [*by, "href"], "left").withColumn("href", F.when(F.col("__to") != F.col(file), F.concat("__to", "href")).otherwise(F.col("href"))).select(*links.columns)


def link_targets(links: DataFrame, by: list[str]) -> DataFrame:
    """Ids that links refer to, each once."""
    return links.where(F.startswith("href", F.lit("#")) & (F.length("href") > 1)).select(*by, F.substring("href", 2, 1 << 30).alias("xml_id")).distinct()


def anchors(ids: DataFrame, targets: DataFrame, by: list[str], eid: str) -> DataFrame:
    """Ids with an element that something refers to."""
    return ids.where(F.col(eid) > 0).join(targets, [*by, "xml_id"], "left_semi")


def position_index(items: DataFrame, by: list[str], eid: str, length: str, order: list[str]) -> DataFrame:
    """Start and length of each element's first item: by, eid, pid, length. Items without length take one place."""
    t = prefix_sum(items.withColumn("__n", F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(1)).cast("long")), "__n", by, order, "pid")
    return t.groupBy(*by, eid).agg(F.min_by(F.struct("pid", F.col("__n").alias("length")), F.struct(*order)).alias("at")).select(*by, eid, "at.pid", "at.length")


def positions_of(refs: DataFrame, index: DataFrame, by: list[str], eid: str, offset: str) -> DataFrame:
    """Position of each reference (by, eid, offset) in the index, its offset kept within the element; unknown elements are left out."""
    at = F.greatest(F.lit(0), F.least(F.coalesce(F.col(offset), F.lit(0)), F.col("__length") - 1))
    return refs.join(index.select(*by, eid, F.col("pid").alias("__start"), F.col("length").alias("__length")), [*by, eid]).select(*refs.columns, (F.col("__start") + at).cast("long").alias("pid"))


def located(refs: DataFrame, pages: DataFrame, by: list[str], every: int = 40) -> DataFrame:
    """References (by, pid) with their location and the page that begins last at or before them. pages: by, pid, page."""
    return as_of(refs, pages, by, "pid", "page").withColumn("location", (F.floor(F.col("pid") / every) + 1).cast("long")).withColumnRenamed("as_of", "page")


def shown_backlinks(refs: DataFrame, anchor_pages: DataFrame, link_pages: DataFrame, by: list[str], ref: str) -> DataFrame:
    """Backlinks but those on the page to which they lead. Both tables: by, ref, page; the first page of each counts."""
    first = lambda t, name: t.groupBy(*by, ref).agg(F.min("page").alias(name))
    t = refs.join(first(anchor_pages, "__there"), [*by, ref], "left").join(first(link_pages, "__here"), [*by, ref], "left")
    same = (F.col("__there") == F.col("__here")) & (F.col("__there") > 0)
    return t.where(~F.coalesce(same, F.lit(False))).select(*refs.columns)


def first_with(rows: DataFrame, known: DataFrame, list_: str, key: str, value: str) -> DataFrame:
    """rows with the value of the first entry of a list that `known` (key, value) has, null without one."""
    t = rows.withColumn("__row", F.monotonically_increasing_id())
    hit = t.select("__row", F.posexplode(list_).alias("__at", key)).join(known.select(key, value), key).groupBy("__row").agg(F.min_by(F.col(value), F.col("__at")).alias(value))
    return t.join(hit, "__row", "left").drop("__row")


def kept_or_all(rows: DataFrame, used: DataFrame, on: list[str]) -> DataFrame:
    """Rows that are used; all of them if nothing was told about use."""
    return rows if used.isEmpty() else rows.join(used.select(*on).distinct(), on, "left_semi")


def usage(rows: DataFrame, name: str, fragment: str, kind: str) -> DataFrame:
    """For each name: how often it is used directly and in events, and the fragments that do, in order, by kind."""
    t = rows.groupBy(name, kind, fragment).agg(F.count("*").alias("n"))
    side = lambda k: F.array_sort(F.collect_list(F.when(F.col(kind) == k, F.col(fragment))))
    total = lambda k: F.coalesce(F.sum(F.when(F.col(kind) == k, F.col("n"))), F.lit(0)).cast("long")
    return t.groupBy(name).agg(total("direct").alias("n_direct"), total("event").alias("n_event"), side("direct").alias("direct"), side("event").alias("events"))


def unlisted(names: DataFrame, name: str, known: DataFrame) -> DataFrame:
    """Distinct names that no table of known ones has."""
    return names.select(name).distinct().join(known.select(name), name, "left_anti")


def file_numbers(rows: DataFrame, by: list[str], id: str, mime: str, order: list[str]) -> DataFrame:
    """Pictures, the first of each id, with a file name img00001.ending in order."""
    t = rows.where(is_image_type(F.col(mime)))
    t = t.withColumn("__n", F.row_number().over(Window.partitionBy(*by, id).orderBy(*order))).where("__n = 1").drop("__n")
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return t.withColumn("file", F.concat(F.lit("images/img"), F.lpad(n.cast("string"), 5, "0"), F.lit("."), image_ending(F.col(mime))))


def resources(urls: DataFrame, binaries: DataFrame, by: list[str]) -> DataFrame:
    """Addresses of style sheets (by, url) with where they lead: an embedded file (kind embedded; file under fonts/ or other/), a file beside the book (kind file), nothing.

    binaries: by, id, mime. What leads out of the book's folder or to no name leads to nothing.
    """
    known = binaries.select(*by, F.concat(F.lit("#"), "id").alias("url"), "mime")
    t = urls.join(known, [*by, "url"], "left")
    name = resource_filename(F.col("url"))
    here = F.startswith("url", F.lit("#"))
    outside = F.col("url").rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:|/)") | F.array_contains(F.split("url", "/"), "..")
    kind = F.when(here & F.col("mime").isNotNull(), "embedded").when(~here & ~outside & (name != ""), "file")
    file = F.when(kind == "embedded", F.concat(F.when(is_font_type(F.col("mime")), "fonts/").otherwise("other/"), name)).when(kind == "file", name)
    return t.select(*urls.columns, "mime", kind.alias("kind"), file.alias("file"))


def joined_media(items: DataFrame, media: DataFrame, on: str) -> DataFrame:
    """Items with the key of the medium at their location, for those that have one."""
    return items.join(media.select(on, F.col("id").alias("media_id")), on)
