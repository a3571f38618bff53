"""Style sheets as a table of rules, and their cascade."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values
from ..operators.links import first_match
from ..operators.sequences import scan

RULES = "sheet_id string, ord int, media string, selector string, element string, class string, pseudo string, ancestor string, property string, value string, number double, unit string, error string"

_SIMPLE = re.compile(r"^([A-Za-z][\w-]*|\*)?(?:\.([\w-]+))?(?:::?([a-z-]+))?$")
_MEASURE = re.compile(r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))([A-Za-z%]*)$")
#: Properties that rules without an element or class may set: they travel with the plan.
MOST = 1000
#: Pseudo-elements that selectors may have.
PSEUDO = frozenset(("before", "after", "first-letter", "first-line"))


def blocks(css: str) -> Iterator[tuple[str, str, str]]:
    """(media, selector or at-rule, body) in order; comments go, closers without an opener are skipped."""
    css = re.sub(r"/\*.*?(\*/|\Z)", " ", css, flags=re.S)

    def walk(text: str, media: str) -> Iterator[tuple[str, str, str]]:
        at = 0
        while m := re.compile(r"[{};]").search(text, at):
            head = text[at : m.start()].strip()
            at = m.end()
            if m[0] == ";" and head.startswith("@import"):
                yield media, "@import", head[7:].strip()
            if m[0] != "{":
                continue
            depth, end = 1, at
            while depth and (n := re.compile(r"[{}]").search(text, end)):
                depth, end = depth + (1 if n[0] == "{" else -1), n.end()
            body = text[at : end - 1 if not depth else len(text)]
            at = end if not depth else len(text)
            if head.startswith("@media"):
                yield from walk(body, head[6:].strip())
            else:
                yield media, head, body

    return walk(css, "")


def declarations(body: str) -> list[tuple[str, str]]:
    out = []
    for part in re.split(r";(?![^(]*\))", body):
        name, colon, value = part.partition(":")
        if colon and name.strip():
            out.append((name.strip().lower(), re.sub(r"\s*!important$", "", " ".join(value.split()))))
    return out


def rule_rows(sheet: str, css: str) -> list[dict]:
    rows, n = [], 0
    for media, head, body in blocks(css or ""):
        if head == "@import":
            rows.append({"sheet_id": sheet, "ord": n, "media": media, "selector": "@import", "property": "url", "value": re.sub(r"^url\(|\)$|[\"']", "", body)})
            n += 1
            continue
        for selector in [head] if head.startswith("@") else [s.strip() for s in head.split(",")]:
            *above, last = selector.replace(">", " > ").split() or [""]
            m = None if selector.startswith("@") or re.search(r"[+~\[\]#]", selector) else _SIMPLE.match(last)
            known = {"sheet_id": sheet, "ord": n, "media": media, "selector": selector}
            if selector.startswith("@font-face"):
                pass
            elif m and last and (m[3] is None or m[3] in PSEUDO):
                known |= {"element": m[1], "class": m[2], "pseudo": m[3], "ancestor": " ".join(above) or None}
            else:
                known["error"] = "unsupported selector"
            for name, value in declarations(body):
                measure = _MEASURE.match(value)
                rows.append(known | {"property": name, "value": value, "number": float(measure[1]) if measure else None, "unit": measure[2].lower() if measure else None})
            n += 1
    return rows


def rules(sheets: DataFrame) -> DataFrame:
    """sheets: sheet_id, css. One row for each declaration, in order."""
    kinds = pa.schema([(n, pa.int32() if t == "int" else pa.float64() if t == "double" else pa.string()) for n, t in (x.split() for x in RULES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for s, c in zip(batch.column("sheet_id").to_pylist(), batch.column("css").to_pylist(), strict=True) for r in rule_rows(s, c)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return sheets.select(F.col("sheet_id").cast("string"), "css").mapInArrow(run, RULES)


def media_applies(media: str, kind: str, features: frozenset[str] = frozenset()):
    """Whether a media query holds for a medium and its features: terms joined by `and`, `not` before one negates it."""
    query = F.trim(F.lower(F.col(media)))
    terms = F.split(query, r"\s+and\s+")
    have = F.array(*(F.lit(x) for x in sorted({kind, "all", *features})))
    holds = F.forall(terms, lambda t: F.when(t.startswith("not "), ~F.array_contains(have, F.substr(t, F.lit(5)))).otherwise(F.array_contains(have, t)))
    return (F.coalesce(query, F.lit("")) == "") | holds


def cascade(elements: DataFrame, css: DataFrame, keys: list[str]) -> DataFrame:
    """For each element (keys, element, classes) and property the value that wins: class over element, later over earlier.

    The rules of a sheet are a small table, joined by its two kinds of simple selectors on equal names.
    """
    r = css.where("error IS NULL AND ancestor IS NULL AND pseudo IS NULL AND property IS NOT NULL AND selector NOT LIKE '@%'").select("ord", F.col("element").alias("__e"), F.col("class").alias("__c"), "property", "value")
    # rules with a class meet elements by it, others by the element's name, so no key gathers all elements
    e = elements.select(*keys, F.lower("element").alias("element"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))
    by_class = e.select(*keys, "element", F.explode("classes").alias("__c")).join(r.where("__c IS NOT NULL"), "__c").where("__e IS NULL OR __e = '*' OR lower(__e) = element")
    plain = r.where("__c IS NULL").withColumn("__e", F.lower("__e"))
    named = e.join(plain.where("__e <> '*'").withColumnRenamed("__e", "element"), "element").select(*keys, "element", F.lit(None).cast("string").alias("__c"), "ord", F.col("element").alias("__e"), "property", "value")
    every = plain.where("__e IS NULL OR __e = '*'").groupBy("property").agg(F.max_by(F.struct("ord", "value"), "ord").alias("r")).select("property", "r.*").limit(MOST + 1).collect()
    if len(every) > MOST:
        raise ValueError(f"more than {MOST} properties for any element")
    all_ = F.array(*(F.struct(F.lit(x["property"]).alias("property"), F.lit(x["ord"]).alias("ord"), F.lit(x["value"]).alias("value")) for x in every)) if every else F.array().cast("array<struct<property:string,ord:int,value:string>>")
    every = e.select(*keys, "element", F.explode(all_).alias("r")).select(*keys, "element", F.lit(None).cast("string").alias("__c"), "r.ord", F.lit("*").alias("__e"), "r.property", "r.value")
    t = by_class.select(*keys, "element", "__c", "ord", "__e", "property", "value").unionByName(named).unionByName(every)
    t = t.withColumn("__weight", (F.col("__c").isNotNull()).cast("int") * 10 + F.coalesce(F.col("__e") != "*", F.lit(False)).cast("int"))
    w = Window.partitionBy(*keys, "property").orderBy(F.desc("__weight"), F.desc("ord"))
    return t.withColumn("__n", F.row_number().over(w)).where("__n = 1").select(*keys, "property", "value")


#: Shorthands of four sides, and properties that children have from their parents.
SIDES = {"margin": "margin-{}", "padding": "padding-{}", "border-width": "border-{}-width", "border-style": "border-{}-style", "border-color": "border-{}-color"}
INHERITED = ("color", "font-family", "font-size", "font-style", "font-variant", "font-weight", "hyphens", "letter-spacing", "line-height", "list-style-type", "orphans", "text-align", "text-indent", "text-transform", "visibility", "white-space", "widows", "word-spacing")
#: Styles that enclose others and have nothing from them, and endings of names that tell a style's parent.
WRAPPERS = ("epigraph", "poem", "stanza", "cite", "annotation", "footnote", "section", "image", "vignette", "emptyline", "body-title", "chapter-title", "section-title", "footnote-body", "main-body", "other-body", "poem-title", "stanza-title", "footnote-title", "toc-title")
VARIANTS = ("-first", "-next", "-break")


def longhands(css: DataFrame) -> DataFrame:
    """Rules with shorthands of sides, borders and backgrounds in their parts, automatic margins resolved; other declarations as they are."""
    keep = [c for c in css.columns if c not in ("property", "value", "number", "unit")]
    entry = lambda k, v: F.struct(k.alias("property"), v.alias("value"))
    value, name = F.col("value"), F.col("property")
    sides = values.box_sides(value)
    plan = F.when(F.lit(False), F.array(entry(name, value)))
    for short, form in SIDES.items():
        plan = plan.when(name == short, F.array(*(entry(F.lit(form.format(s)), sides[s]) for s in ("top", "right", "bottom", "left"))))
    parts = values.border_parts(value)
    border = F.filter(F.array(*(entry(F.lit(f"border-{k}"), parts[c]) for k, c in (("style", "line"), ("color", "color"), ("width", "width")))), lambda x: x.value.isNotNull())
    colors = F.filter(F.split(value, r"\s+"), lambda x: values.color(x).isNotNull())
    fill = F.when(F.size(colors) > 0, F.array(entry(F.lit("background-color"), F.element_at(colors, 1)))).otherwise(F.array().cast("array<struct<property:string,value:string>>"))
    plan = plan.when(name == "border", border).when(name == "background", fill).otherwise(F.array(entry(name, value)))
    t = css.select(*keep, F.explode(plan).alias("x")).select(*keep, "x.property", "x.value")
    # automatic margins: none above and below; at the sides they align the box
    return t.withColumn("value", F.when((F.col("value") == "auto") & F.col("property").isin("margin-top", "margin-bottom"), "0em").otherwise(F.col("value")))


def aligned_boxes(styles: DataFrame, keys: list[str]) -> DataFrame:
    """Styles (keys, property, value) with box-align in place of automatic margins at the sides; a box-align of their own stays."""
    auto = F.col("value") == "auto"
    side = lambda s: F.bool_or(auto & (F.col("property") == f"margin-{s}"))
    t = styles.groupBy(*keys).agg(side("left").alias("l"), side("right").alias("r"), F.bool_or(F.col("property") == "box-align").alias("own"))
    made = t.where("(l OR r) AND NOT own").select(*keys, F.lit("box-align").alias("property"), F.when(F.col("l") & F.col("r"), "center").when(F.col("l"), "right").otherwise("left").alias("value"))
    return styles.where(~(auto & F.col("property").isin("margin-left", "margin-right"))).select(*keys, "property", "value").unionByName(made)


def selected(css: DataFrame, selector: str) -> DataFrame:
    """Rules outside media blocks with exactly this selector."""
    return css.where((F.coalesce("media", F.lit("")) == "") & (F.col("selector") == selector))


def page_breaks(css: DataFrame) -> DataFrame:
    """sheet_id, depth, breaks: whether titles of sections (.section-title-h2 to h6) begin a page; depth 0: titles of bodies (.body-title). The last rule counts."""
    depth = F.when(F.col("class") == "body-title", 0).otherwise(F.regexp_extract("class", "^section-title-h([2-6])$", 1).try_cast("int"))
    t = css.where("class IS NOT NULL AND error IS NULL").withColumn("depth", depth).where("depth IS NOT NULL")
    says = F.when(F.col("property") == "page-break-before", F.lower("value") == "always")
    rules_ = t.groupBy("sheet_id", "depth", "ord").agg(F.max(says).alias("says"))
    # a rule for sections that says nothing of breaks counts as no; one for bodies doesn't count
    rules_ = rules_.where("depth > 0 OR says IS NOT NULL").withColumn("says", F.coalesce("says", F.lit(False)))
    return rules_.groupBy("sheet_id", "depth").agg(F.max_by("says", "ord").alias("breaks"))


def registered(defs: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """Definitions (by, name, property, value) with one value for each property: the last one."""
    return defs.groupBy(*by, name, "property").agg(F.max_by("value", F.struct(*order)).alias("value"))


def inferred_parents(names: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """Names with the style that they vary or end in, if there is one: chapter-header-first has chapter-header's, x-subtitle subtitle's. Wrappers have none."""
    wraps = lambda c: c.isin(*WRAPPERS) | c.startswith("section-title-wrap-h")
    base = F.regexp_replace(name, "(" + "|".join(VARIANTS) + ")$", "")
    variant = F.when((base != F.col(name)) & (base != "") & ~wraps(base), base)
    ending = F.when(F.col(name).rlike(".-subtitle$"), F.lit("subtitle"))
    known = names.select(*by, name).distinct()
    k = lambda c: known.select(*by, F.col(name).alias(c), F.lit(True).alias(f"has_{c}"))
    t = names.withColumn("variant", variant).withColumn("ending", ending).join(k("variant"), [*by, "variant"], "left").join(k("ending"), [*by, "ending"], "left")
    parent = F.when(~wraps(F.col(name)), F.when(F.col("has_variant"), F.col("variant")).when(F.col("has_ending"), F.col("ending")))
    return t.select(*names.columns, parent.alias("parent"))


def inherited(defs: DataFrame, parents: DataFrame, by: list[str], most: int = 20) -> DataFrame:
    """Definitions with what their parents say and they don't: by, name, property, value. parents: by, name, parent.

    Parents are followed one step a round; unknown ones end a chain, and so do circles, after `most` rounds.
    """
    out = defs.select(*by, "name", "property", "value", F.lit(0).alias("far"))
    up = parents.where("parent IS NOT NULL").select(*by, "name", "parent")
    chain = up
    for far in range(1, most + 1):
        if chain.isEmpty():
            break
        more = chain.join(defs.select(*by, F.col("name").alias("parent"), "property", "value"), [*by, "parent"]).select(*by, "name", "property", "value", F.lit(far).alias("far"))
        out = out.unionByName(more)
        chain = chain.join(up.select(*by, F.col("name").alias("parent"), F.col("parent").alias("__next")), [*by, "parent"]).select(*by, "name", F.col("__next").alias("parent")).where("parent <> name")
    return out.groupBy(*by, "name", "property").agg(F.min_by("value", "far").alias("value"))


def interned(styles: DataFrame, by: list[str], name: str, dropped: list[str] = ()) -> DataFrame:
    """Styles (by, name, property, value) that say the same get one key: by, name, style, properties. Dropped properties and an automatic height don't count."""
    t = styles.where(~F.col("property").isin(list(dropped)) & ~((F.col("property") == "height") & (F.col("value") == "auto")))
    t = t.groupBy(*by, name).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("property", "value")))).alias("properties"))
    return t.withColumn("style", F.substring(F.sha2(values.signature(F.col("properties")), 256), 1, 12))


def used(styles: DataFrame, uses: DataFrame, on: list[str]) -> DataFrame:
    """Styles that something uses."""
    return styles.join(uses.select(*on).distinct(), on, "left_semi")


def resolved(elements: DataFrame, css: DataFrame, by: list[str], most: int = 10_000) -> DataFrame:
    """elements (by, seq, last_seq, element, classes) with `properties` and `delta`, what each has beyond its parent's.

    An element has its parent's inherited properties, then those of its own element, of its classes in order, of
    rules for a child of its parent (a>b), of rules for descendants of anything around it, later rules after
    earlier ones. A font size in em or percent multiplies the parent's. Elements stream past a stack of
    those around them; a sheet has `most` declarations at most, else an error, so its rules travel with the task.
    """
    rows = css.where("error IS NULL AND pseudo IS NULL AND property IS NOT NULL AND selector NOT LIKE '@%'").select("ord", "element", "class", "ancestor", "selector", "property", "value").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} declarations")
    table: dict[tuple[str, str], list[tuple[int, str, str]]] = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        own = ("." + r["class"]) if r["class"] else (r["element"] or "*").lower()
        above = (r["ancestor"] or "").split()
        key = (">" + above[-2] if above[-1:] == [">"] and len(above) > 1 else above[-1] if above else "", own)
        table.setdefault(key, []).append((r["element"] or "", r["property"], r["value"]))
    passed = frozenset(INHERITED)

    def scaled(old: str | None, new: str) -> str:
        a, b = _MEASURE.match(old or ""), _MEASURE.match(new)
        if not a or not b or b[2].lower() not in ("em", "%"):
            return new
        factor = float(b[1]) * (1 if b[2].lower() == "em" else 0.01)
        return f"{round(float(a[1]) * factor, 6):g}{a[2]}"

    def make():
        stack: list[tuple[int, str, list[str], dict[str, str]]] = []

        def step(seq: int, last: int | None, tag: str | None, classes: list[str] | None):
            while stack and stack[-1][0] < seq:
                stack.pop()
            tag, classes = (tag or "").lower(), classes or []
            parent = {k: v for k, v in stack[-1][3].items() if k in passed} if stack else {}
            now = dict(parent)

            def apply(key: tuple[str, str]) -> None:
                for only, name, value in table.get(key, ()):
                    if not only or only == "*" or only.lower() == tag:
                        now[name] = scaled(now.get(name), value) if name == "font-size" else value

            own = [*(["*", tag] if tag else ["*"]), *(f".{c}" for c in classes)]
            for name in own:
                apply(("", name))
            if stack:
                for name in own:
                    for around in [*(f".{c}" for c in stack[-1][2]), stack[-1][1]]:
                        apply((f">{around}", name))
            for _, around_tag, around_classes, _ in stack:
                for around in [*(f".{c}" for c in around_classes), around_tag]:
                    for name in own:
                        apply((around, name))
            stack.append((seq if last is None else last, tag, classes, now))
            return [(sorted(now.items()), sorted((k, v) for k, v in now.items() if parent.get(k) != v))]

        return step

    pairs = "array<struct<property:string,value:string>>"
    t = scan(elements, by, ["seq"], ["seq", "last_seq", "element", "classes"], lambda: _as_structs(make()), f"properties {pairs}, delta {pairs}")
    return t


def _as_structs(step):
    named = lambda xs: [{"property": k, "value": v} for k, v in xs]
    return lambda *x: [(named(a), named(b)) for a, b in step(*x)]


def collapsed_blocks(blocks_: DataFrame, by: list[str], order: str, above: str, below: str) -> DataFrame:
    """Blocks with the space between each and the one before it: their margins there collapsed; the first has its own."""
    w = Window.partitionBy(*by).orderBy(order)
    before = F.lag(below).over(w)
    return blocks_.withColumn("space", F.when(before.isNull(), F.col(above)).otherwise(values.collapsed_margin(F.col(above), before)))


def candidates(css: DataFrame) -> DataFrame:
    """Declarations with the keys under which a table of conversions may know them: row (of css, in order), tag, attr, value, unit.

    With and without the element, with the value and without, with the unit itself, as any unit, and as a color if it is one.
    """
    units = F.concat(F.array(F.coalesce("unit", F.lit("")), F.lit("special_unit")), F.when(values.color(F.col("value")).isNotNull(), F.array(F.lit("color_unit"))).otherwise(F.array().cast("array<string>")))
    tags = F.when(F.col("element").isNotNull(), F.array(F.lit(""), F.col("element"))).otherwise(F.array(F.lit("")))
    t = css.where("property IS NOT NULL").withColumn("unit_key", F.explode(units)).withColumn("tag_key", F.explode(tags))
    return t.withColumn("value_key", F.explode(F.array("value", F.lit("")))).select(*css.columns, F.col("tag_key").alias("key_tag"), F.col("property").alias("key_attr"), F.col("value_key").alias("key_value"), F.col("unit_key").alias("key_unit"))


def mapped(css: DataFrame, conversions: DataFrame, keys: list[str]) -> DataFrame:
    """Declarations with what the table of conversions makes of them: the most special entry that knows one. conversions: tag, attr, value, unit, to_property, to_value (null: the declaration's own)."""
    c = conversions.select(F.col("tag").alias("key_tag"), F.col("attr").alias("key_attr"), F.col("value").alias("key_value"), F.col("unit").alias("key_unit"), "to_property", "to_value")
    special = F.struct((F.col("key_tag") != "").cast("int"), (F.col("key_value") != "").cast("int"), (~F.col("key_unit").isin("special_unit", "color_unit")).cast("int"), F.col("to_property"))
    t = candidates(css).join(c, ["key_tag", "key_attr", "key_value", "key_unit"])
    best = t.groupBy(*keys, "property").agg(F.max_by(F.struct("to_property", F.coalesce("to_value", "value").alias("value")), special).alias("best"))
    return best.select(*keys, "property", "best.to_property", "best.value")


def ignorable(css: DataFrame, known: list[str], patterns: DataFrame) -> DataFrame:
    """Declarations but those that a pattern (tag, style, value, unit; * for any) says to ignore; known properties and shorthands always stay."""
    stay = F.col("property").isin([*known, *SIDES, "border", "background", "font"])
    t = css.withColumn("__tag", F.coalesce("element", F.lit(""))).withColumn("__unit", F.coalesce("unit", F.lit("")))
    p = patterns.select(F.col("tag").alias("__tag"), F.col("style").alias("property"), "value", F.col("unit").alias("__unit"), F.lit(1).alias("__at"), F.lit(True).alias("__hit"))
    hit = first_match(t, p, ["__tag", "property", "value", "__unit"], "__at")
    return hit.where(stay | F.col("__hit").isNull()).select(*css.columns)
