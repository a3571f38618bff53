"""Text templates over rows: {{ actions }} with fields, variables, pipelines, conditions and loops.

A template is parsed once in a task and run for each row, in Arrow batches. What a template may say: .Field.Sub,
$name := value and $name = value, literals, calls (name a b), pipelines (a | name b), if / else if / else, with, range,
end, and "-" beside a brace, which trims white space there. The functions are FUNCTIONS.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ACTION = re.compile(r"(?s)(\s*)\{\{(-\s)?(.*?)(\s-)?\}\}(\s*)")
_TOKEN = re.compile(r"""\s*("(?:[^"\\]|\\.)*"|`[^`]*`|:=|[()|=]|[^\s()|"`]+)""")
_ESCAPE = {"n": "\n", "t": "\t", '"': '"', "\\": "\\"}


def _truth(x) -> bool:
    return bool(x)


def _text(x) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, (list, tuple)):
        return "[" + " ".join(map(_text, x)) + "]"
    return str(x)


def _printf(form: str, *args) -> str:
    values = [a if isinstance(a, (int, float)) else _text(a) for a in args]
    return re.sub(r"%v", "%s", form) % tuple(values)


FUNCTIONS: dict[str, Callable] = {
    "len": len, "not": lambda x: not _truth(x), "and": lambda *x: next((v for v in x if not _truth(v)), x[-1]), "or": lambda *x: next((v for v in x if _truth(v)), x[-1]),
    "eq": lambda a, *b: any(a == x for x in b), "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b,
    "index": lambda x, *at: _indexed(x, at), "print": lambda *x: "".join(map(_text, x)), "printf": _printf,
    "upper": lambda s: _text(s).upper(), "lower": lambda s: _text(s).lower(), "title": lambda s: _text(s).title(), "trim": lambda s: _text(s).strip(), "trimAll": lambda c, s: s.strip(c),
    "trimPrefix": lambda p, s: s.removeprefix(p), "trimSuffix": lambda p, s: s.removesuffix(p), "replace": lambda a, b, s: s.replace(a, b), "trunc": lambda n, s: s[:n] if n >= 0 else s[n:],
    "substr": lambda a, b, s: s[a:b], "contains": lambda p, s: p in s, "hasPrefix": lambda p, s: s.startswith(p), "hasSuffix": lambda p, s: s.endswith(p), "repeat": lambda n, s: s * n,
    "cat": lambda *x: " ".join(_text(v) for v in x if v is not None), "join": lambda sep, x: sep.join(map(_text, x)), "splitList": lambda sep, s: s.split(sep), "quote": lambda s: f'"{s}"', "squote": lambda s: f"'{s}'",
    "first": lambda x: x[0] if x else None, "last": lambda x: x[-1] if x else None, "rest": lambda x: x[1:], "initial": lambda x: x[:-1], "list": lambda *x: list(x), "has": lambda v, x: v in x, "uniq": lambda x: list(dict.fromkeys(x)),
    "default": lambda d, x=None: x if _truth(x) else d, "empty": lambda x: not _truth(x), "coalesce": lambda *x: next((v for v in x if _truth(v)), None), "ternary": lambda a, b, c: a if c else b,
    "add": lambda *x: sum(x), "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: int(a / b), "mod": lambda a, b: a % b, "int": lambda x: int(x or 0), "max": max, "min": min, "toString": _text,
}


def _indexed(x, at):
    for i in at:
        x = x[i] if isinstance(x, (list, tuple)) else (x or {}).get(i)
    return x


class Template:
    """A parsed template."""

    def __init__(self, text: str):
        self.parts = _parts(text)
        self.body, at = self._block(0, ())
        if at < len(self.parts):
            raise ValueError("an end without a beginning")

    def _block(self, at: int, until: tuple[str, ...]) -> tuple[list, int]:
        out: list = []
        while at < len(self.parts):
            kind, value = self.parts[at]
            if kind == "text":
                out.append(("text", value))
                at += 1
                continue
            word = value[0] if value else ""
            if word in until:
                return out, at
            if word in ("if", "with", "range"):
                branches, other = [], None
                condition = value[1:]
                while True:
                    body, at = self._block(at + 1, ("end", "else"))
                    if at >= len(self.parts):
                        raise ValueError(f"{word} without an end")
                    branches.append((condition, body))
                    tail = self.parts[at][1]
                    if tail[0] == "end":
                        break
                    if tail[1:2] in (["if"], ["with"]):
                        condition = tail[2:]
                        continue
                    other, at = self._block(at + 1, ("end",))
                    if at >= len(self.parts):
                        raise ValueError(f"{word} without an end")
                    break
                out.append((word, branches, other or []))
                at += 1
            elif word in ("end", "else"):
                return out, at
            else:
                if value:
                    out.append(("value", value))
                at += 1
        return out, at

    def render(self, data: dict) -> str:
        out: list[str] = []
        self._run(self.body, data, {"$": data}, out)
        return "".join(out)

    def _run(self, block: list, dot, names: dict, out: list[str]) -> None:
        for item in block:
            kind = item[0]
            if kind == "text":
                out.append(item[1])
            elif kind == "value":
                tokens = item[1]
                if len(tokens) > 2 and tokens[0].startswith("$") and tokens[1] in (":=", "="):
                    _assign(names, tokens[0], _pipeline(tokens[2:], dot, names), tokens[1] == ":=")
                else:
                    out.append(_text(_pipeline(tokens, dot, names)))
            elif kind == "range":
                (condition, body), other = item[1][0], item[2]
                targets: list[str] = []
                if ":=" in condition:
                    k = condition.index(":=")
                    targets, condition = [t.rstrip(",") for t in condition[:k] if t != ","], condition[k + 1 :]
                items = _pipeline(condition, dot, names) or []
                for i, x in enumerate(items):
                    inner = {"": names}
                    for t, v in zip(targets, (i, x) if len(targets) == 2 else (x,), strict=False):
                        inner[t] = v
                    self._run(body, x, inner, out)
                if not items:
                    self._run(other, dot, {"": names}, out)
            else:
                for condition, body in item[1]:
                    inner = {"": names}
                    if len(condition) > 2 and condition[1] == ":=":
                        value = inner[condition[0]] = _pipeline(condition[2:], dot, names)
                    else:
                        value = _pipeline(condition, dot, names)
                    if _truth(value):
                        self._run(body, value if kind == "with" else dot, inner, out)
                        break
                else:
                    self._run(item[2], dot, {"": names}, out)


def _assign(names: dict, name: str, value, new: bool) -> None:
    scope = names
    while not new and name not in scope:
        if "" not in scope:
            raise ValueError(f"{name} isn't declared")
        scope = scope[""]
    scope[name] = value


def _parts(text: str) -> list[tuple[str, object]]:
    out, at, trim = [], 0, False
    for m in _ACTION.finditer(text):
        before = text[at : m.start()] + ("" if m[2] else m[1])
        out.append(("text", before.lstrip() if trim else before))
        action = m[3].strip()
        if not action.startswith("/*"):
            out.append(("action", _tokens(action)))
        trim, at = bool(m[4]), m.end() if m[4] else m.end() - len(m[5])
    rest = text[at:]
    out.append(("text", rest.lstrip() if trim else rest))
    return [p for p in out if p[0] == "action" or p[1]]


def _tokens(action: str) -> list[str]:
    out, at = [], 0
    while at < len(action):
        m = _TOKEN.match(action, at)
        if not m:
            raise ValueError(f"{action[at:]!r} isn't understood")
        # a field right after a closing parenthesis belongs to it
        out.append(f")>{m[1]}" if m[1][0] == "." and out and out[-1] == ")" and m.start(1) == m.start() else m[1])
        at = m.end()
    return out


def _pipeline(tokens: list[str], dot, names: dict):
    depth, stages = 0, [[]]
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "|" and not depth:
            stages.append([])
        else:
            stages[-1].append(t)
    value, piped = None, []
    for stage in stages:
        value = _call(stage, dot, names, piped)
        piped = [value]
    return value


def _call(tokens: list[str], dot, names: dict, piped: list):
    terms, at = [], 0
    while at < len(tokens):
        if tokens[at] == "(":
            depth, end = 1, at + 1
            while depth:
                depth += (tokens[end] == "(") - (tokens[end] == ")")
                end += 1
            value, at = _pipeline(tokens[at + 1 : end - 1], dot, names), end
            if at < len(tokens) and tokens[at].startswith(")>"):
                value, at = _field(value, tokens[at][2:]), at + 1
            terms.append(("value", value))
        else:
            terms.append(("token", tokens[at]))
            at += 1
    kind, head = terms[0]
    if kind == "token" and head in FUNCTIONS:
        return FUNCTIONS[head](*(v if k == "value" else _term(v, dot, names) for k, v in terms[1:]), *piped)
    if len(terms) > 1 or piped:
        raise ValueError(f"{head} isn't a function")
    return head if kind == "value" else _term(head, dot, names)


def _field(value, path: str):
    for name in path.split(".")[1:]:
        if name:
            value = value.get(name) if isinstance(value, dict) else None
    return value


def _term(token: str, dot, names: dict):
    if token[0] == '"':
        return re.sub(r"\\(.)", lambda m: _ESCAPE.get(m[1], m[1]), token[1:-1])
    if token[0] == "`":
        return token[1:-1]
    if re.fullmatch(r"[+-]?\d+", token):
        return int(token)
    if re.fullmatch(r"[+-]?\d*\.\d+", token):
        return float(token)
    if token in ("true", "false", "nil"):
        return {"true": True, "false": False, "nil": None}[token]
    if token[0] == ".":
        return dot if token == "." else _field(dot, token)
    if token[0] == "$":
        name, _, path = token.partition(".")
        scope = names
        while name not in scope:
            if "" not in scope:
                raise ValueError(f"{name} isn't declared")
            scope = scope[""]
        return _field(scope[name], f".{path}") if path else scope[name]
    if token in FUNCTIONS:
        return FUNCTIONS[token]()
    raise ValueError(f"{token} isn't known")


@lru_cache(maxsize=64)
def parsed(text: str) -> Template:
    return Template(text)


def expanded(df: DataFrame, template: str, values: dict[str, Column], name: str, default: Column | None = None) -> DataFrame:
    """df with the template's text for each row, over `values`. Where it fails or gives nothing but white space the default counts.

    A template that can't be parsed is an error at once, unless there is a default. A field that isn't there is empty.
    """
    try:
        parsed(template)
    except ValueError:
        if default is None:
            raise
        return df.withColumn(name, default)
    strict = default is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for data in batch.column("data").to_pylist():
                try:
                    text = parsed(template).render(data)
                except Exception:
                    if strict:
                        raise
                    text = None
                made.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(made, pa.string())], ["row", "made"])

    t = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.struct(*(c.alias(k) for k, c in values.items())).alias("data"))
    t = t.mapInArrow(run, T.StructType([t.schema["row"], T.StructField("made", T.StringType())]))
    made = F.col("made") if strict else F.coalesce(F.nullif(F.trim("made"), F.lit("")), F.lit(None))
    t = t.select(*(F.col(f"row.`{c}`") for c in df.columns if c != name), made.alias(name))
    return t if strict else t.withColumn(name, F.coalesce(name, default))


def metadata_values(context: str, form: str) -> dict[str, Column]:
    """Fields of a book's metadata for templates, over a table of books."""
    authors = F.transform("people", lambda p: F.struct(*(F.coalesce(p[c], F.lit("")).alias(n) for c, n in (("first", "FirstName"), ("middle", "MiddleName"), ("last", "LastName"), ("nickname", "Nickname")))))
    series = F.transform("series", lambda s: F.struct(s["name"].alias("Name"), F.coalesce(s["number"].try_cast("int"), F.lit(0)).alias("Number"), F.coalesce(s["parent"], F.lit(-1)).alias("Parent")))
    source = F.regexp_replace(F.regexp_extract("book_id", "([^/!]*)$", 1), r"[.][^.]*$", "")
    text = lambda c: F.coalesce(c, F.lit(""))
    date = F.coalesce(F.date_format("date", "yyyy-MM-dd"), "date_display")
    return {"Context": F.lit(context), "Format": F.lit(form), "Title": text("title"), "Series": series, "Language": text("lang"), "Date": text(date), "Authors": authors, "SourceFile": source, "BookID": text("id"), "Genres": F.col("genres")}


def output_names(books: DataFrame, template: str, form: str) -> DataFrame:
    """books with `name`, by a template over their metadata; the source's name where that gives none."""
    source = F.regexp_replace(F.regexp_extract("book_id", "([^/!]*)$", 1), r"[.][^.]*$", "")
    return expanded(books, template, metadata_values("output_name_template", form), "name", source)


def person_names(people: DataFrame, template: str, form: str, index: str, default: Column) -> DataFrame:
    """people (first, middle, last, nickname and their index) with `name`; the default where the template gives none."""
    text = lambda c: F.coalesce(c, F.lit(""))
    values = {"Context": F.lit("author_name_template"), "Format": F.lit(form), "Index": F.col(index), "FirstName": text("first"), "MiddleName": text("middle"), "LastName": text("last"), "Nickname": text("nickname")}
    return expanded(people, template, values, "name", default)


def note_labels(notes: DataFrame, template: str, form: str) -> DataFrame:
    """notes (body_number, note_no, body_title, title) with `label`."""
    text = lambda c: F.coalesce(c, F.lit(""))
    return expanded(notes, template, {"Context": F.lit("label_template"), "Format": F.lit(form), "BodyNumber": F.col("body_number"), "NoteNumber": F.col("note_no"), "BodyTitle": text("body_title"), "NoteTitle": text("title")}, "label")


#: Fixed value: the text of a backlink without a usable template.
BACKLINK = "[<]"


def backlink_texts(refs: DataFrame, template: str, values: dict[str, Column]) -> DataFrame:
    """refs with `text`, by a template over `values`; a fixed text where it fails or is blank."""
    if not template.strip():
        return refs.withColumn("text", F.lit(BACKLINK))
    return expanded(refs, template.strip(), {"Context": F.lit("backlink_template")} | values, "text", F.lit(BACKLINK))
