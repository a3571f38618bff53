"""Operator 1, chat formatting in budgeted windows with a loss mask.

A turn weighs the tokens of its formatted text. Prefix sums of these weights along a
conversation choose the spans: a turn of more than half a span stands alone, the others go by the
half-span in which they start, so no span of several turns exceeds its budget and every turn lies in one span.
A window is: the conversation's first turn if it is a system turn, whatever it weighs, the turns
before the span that fit into HISTORY, the span. Only assistant turns of the span itself are under
the loss mask; what is repeated is masked, so each assistant text is a target once. A single turn
beyond the budget is alone in its span, whole.

Prefix sums have two levels, blocks of BLOCK turn numbers and turns within a block, so one
conversation with a third of all rows spreads over many tasks; only its blocks' sums meet.

Template: `### role: text</turn>\\n` for each turn. Inside roles and texts a backslash precedes
each backslash, `###` and `</turn>` (in roles also each colon), so parsing gives back what was
formatted.

Null role or text counts as empty. A null conv_id is a conversation of its own, null turns come
first, turns of one number go by role and text, repeated rows are repeated turns. A system turn that
isn't first is an ordinary turn. Turns that share a block of numbers (all null ones do) are put in order
by one task, which spills. A very long turn is formatted whole. An empty table gives no windows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import library_encoder, tokenizer_path
from .common import plan_size, shared_folder, slices, written

SPAN, HISTORY = 1024, 512
BLOCK = 256
TARGET = "assistant"

_ESCAPED = re.compile(r"\\|###|</turn>")
_ESCAPED_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)", re.S)
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)
_END = re.compile(r"\\(?:\\|###|</turn>)|</turn>")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str, bool]]) -> tuple[str, list[tuple[int, int]]]:
    """Text of turns (role, text, whether it is a target), and code-point spans under the loss mask."""
    out, at, spans = [], 0, []
    for role, text, target in turns:
        head = f"### {_ESCAPED_ROLE.sub(lambda m: chr(92) + m[0], role)}: "
        body = _ESCAPED.sub(lambda m: chr(92) + m[0], text)
        if target:
            spans.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, "</turn>\n"]
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(out), spans


def parse_turns(text: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    out, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        end = head.end()
        while (m := _END.search(text, end))[0] != "</turn>":
            end = m.end()
        out.append((unescaped(head[1]), unescaped(text[head.end() : m.start()])))
        at = m.end() + 1
    return out


def weighed(turns: DataFrame, tokenizer: str) -> DataFrame:
    """key, conv_id, turn, role, text and n, the tokens of each formatted turn."""
    t = turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            formatted = [format_turns([(role, text, False)])[0] for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
            _, counts = library_encoder(tokenizer).encode(pa.array(formatted, pa.string()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(counts)], [*part.schema.names, "n"])

    return t.mapInArrow(run, "key string, conv_id long, turn long, role string, text string, n long")


def placed(turns: DataFrame, tokenizer: str, folder: str, block: int = BLOCK) -> DataFrame:
    """key, conv_id, turn, role, text, n (weight) and start (weights before it in its conversation)."""
    t = written(weighed(turns, tokenizer), folder, "weighed", plan_size(turns))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62))))
    along = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = t.groupBy("key", "block").agg(F.sum("n").alias("s")).select("key", "block", F.coalesce(F.sum("s").over(along), F.lit(0)).alias("base"))
    within = Window.partitionBy("key", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("local", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["key", "block"])
    return t.select("key", "conv_id", "turn", "role", "text", "n", (F.col("base") + F.col("local")).alias("start"))


def chat_windows(turns: DataFrame, span: int = SPAN, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """Windows: key, conv_id, start, n_repeated (turns), formatted, loss (code-point spans)."""
    half = span // 2
    t = placed(turns, tokenizer or tokenizer_path(), shared_folder(turns.sparkSession, "chat"))
    end = F.col("start") + F.col("n")
    own = 2 * F.floor(F.col("start") / half) + (F.col("n") > half).cast("long")
    is_system = (F.col("start") == 0) & (F.col("role") == "system")
    t = t.withColumn("end", end).withColumn("span", own).withColumn("is_system", is_system)
    later = F.when(F.col("end") <= F.col("start") + history, F.sequence(2 * F.floor(F.col("end") / half), 2 * F.floor((F.col("start") + history) / half) + 1))
    later = F.when(~F.col("is_system"), later)
    spans = F.concat(F.array(F.struct(F.col("span"), F.lit(True).alias("own"))), F.coalesce(F.transform(later, lambda s: F.struct(s.alias("span"), F.lit(False).alias("own"))), F.array().cast("array<struct<span:bigint,own:boolean>>")))
    rows = t.select("key", "conv_id", F.explode(spans).alias("s"), F.struct("start", "end", "role", "text").alias("turn"))
    groups = rows.select("key", "conv_id", "s.span", F.struct("turn.start", "s.own", "turn.end", "turn.role", "turn.text").alias("turn"))
    groups = groups.groupBy("key", "span").agg(
        F.first("conv_id").alias("conv_id"),
        F.min(F.when(F.col("turn.own"), F.col("turn.start"))).alias("first"),
        F.sort_array(F.collect_list("turn")).alias("turns"),  # a span and its history: bounded by their budgets
    )
    groups = groups.where("first IS NOT NULL").withColumn("turns", F.expr(f"filter(turns, x -> x.own OR (x.start >= first - {history} AND x.end <= first))"))
    heads = t.where("is_system").select("key", F.col("text").alias("system"))
    groups = groups.join(heads, "key", "left").select("key", "conv_id", "first", F.when(F.col("first") > 0, F.col("system")).alias("system"), F.expr("transform(turns, x -> struct(x.role, x.text, x.own))").alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "system"):
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                repeated, texts, loss = [], [], []
                for head, turns in zip(part.column("system").to_pylist(), part.column("turns").to_pylist(), strict=True):
                    all_ = [("system", head, False)] if head is not None else []
                    all_ += [(x["role"], x["text"], x["own"] and x["role"] == TARGET) for x in turns]
                    text, spans = format_turns(all_)
                    repeated.append((head is not None) + sum(not x["own"] for x in turns))
                    texts.append(text)
                    loss.append([{"start": a, "end": b} for a, b in spans])
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("conv_id"), part.column("first"), pa.array(repeated, pa.int32()), pa.array(texts, pa.string()), pa.array(loss, kind)], ["key", "conv_id", "start", "n_repeated", "formatted", "loss"])

    return groups.mapInArrow(run, "key string, conv_id long, start long, n_repeated int, formatted string, loss array<struct<start:long,end:long>>")


def read_back(windows: DataFrame) -> DataFrame:
    """Digests of each conversation's turns and targets, parsed from its windows in order.

    A digest over a whole conversation is sequential, so its windows stream through one task, which
    holds one window at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row():
            return [conv], [n], [turns.hexdigest()], [loss_chars], [loss.hexdigest()], [chars]

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        now = None
        for batch in batches:
            done = [[] for _ in names]
            for key, conv_id, repeated, text, spans in zip(*(batch.column(c).to_pylist() for c in ("key", "conv_id", "n_repeated", "formatted", "loss")), strict=True):
                if key != now:
                    if now is not None:
                        done = [x + y for x, y in zip(done, row(), strict=True)]
                    now, conv, n, loss_chars, chars, turns, loss = key, conv_id, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in parse_turns(text)[repeated:]:
                    turns.update(f"{role}\n{said}\n".encode())
                    n += 1
                for s in spans:
                    said = unescaped(text[s["start"] : s["end"]])
                    loss.update(said.encode())
                    loss_chars += len(said)
                chars += len(text)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(done, kinds, strict=True)], names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row(), kinds, strict=True)], names)

    return windows.repartition("key").sortWithinPartitions("key", "start").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and one with control strings; digests read back from the windows."""
    said = "\\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"), F.lit(said).alias("text"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(chat_windows(turns.union(own)))
