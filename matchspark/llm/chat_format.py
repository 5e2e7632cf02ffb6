"""Chat formatting by prefix-target expansion.

``format_turns`` writes every turn as one segment of its conversation's text:
``opening + escaped text + closing``, where opening and closing name the role.
Control strings inside a text are broken by an escape character, so that no
text can imitate the template and every segment can be read back exactly.

``examples`` explodes each conversation into one example for every assistant
turn: all preceding segments are its context and only that reply is trainable.
An example is the prefix of its conversation that ends with the reply, so it is
a row of references into the segments: how many it takes, how many characters
they have, and which of these train. ``with_text`` writes the prefixes out where
they are wanted; ``read_back`` resolves the references and undoes the template.

A conversation is one group: its offsets are running sums, and a digest of its
turns can only be taken in order. Both are streams over sorted rows that keep
one row in memory, so a conversation of any length takes time, not memory.

Defined results. Null text: empty. Null role: empty, not trainable. Turns are
ordered by turn (null first), then role, then text, so ties and repeated rows
have one order and repeated rows stay. A null conv_id is a conversation of its
own. Further columns are not read. An empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.llm._tables import keep, table

ESC = "\x1b"
#: Control strings of the template; ESC after the first character breaks one.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[REPLY]", "[ROLE]", "[/ROLE]")
ASSISTANT = "assistant"
_OPEN = {"user": "<s>[INST] ", "system": "<s>[SYS] ", ASSISTANT: "<s>[REPLY] "}
_CLOSE = {"user": " [/INST]</s>", "system": " [/SYS]</s>", ASSISTANT: "</s>"}
_BREAK = "(" + "|".join(sorted({regex.escape(x[0]) for x in CONTROLS})) + ")(" + "|".join(regex.escape(x[1:]) for x in CONTROLS) + ")"
#: A segment: its role's opening, the escaped text, the closing.
_SEGMENT = regex.compile(r"<s>(?:\[INST\] (?P<user>.*?) \[/INST\]|\[SYS\] (?P<system>.*?) \[/SYS\]|\[REPLY\] (?P<assistant>.*?)|\[ROLE\] (?P<role>.*?) \[/ROLE\](?P<other>.*?))</s>", regex.DOTALL)


def escape(text: Column) -> Column:
    """Reversible: ESC becomes ESC e, and ESC b breaks control strings."""
    return F.regexp_replace(F.replace(text, F.lit(ESC), F.lit(f"{ESC}e")), _BREAK, f"$1{ESC}b$2")


def unescape(text: str) -> str:
    return text.replace(f"{ESC}b", "").replace(f"{ESC}e", ESC)


def _by_role(role: Column, marks: dict[str, str], other: Column) -> Column:
    out = other
    for name, mark in marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, segment, head (characters before the text in the segment), body (characters of the escaped text), trainable."""
    role = F.coalesce("role", F.lit(""))
    text = F.coalesce("text", F.lit(""))
    body = escape(text)
    head = _by_role(role, _OPEN, F.concat(F.lit("<s>[ROLE] "), escape(role), F.lit(" [/ROLE]")))
    return turns.select(
        "conv_id", "turn", role.alias("role"), head.alias("_head"), body.alias("_body"), _by_role(role, _CLOSE, F.lit("</s>")).alias("_tail"),
    ).select(
        "conv_id", "turn", "role", F.concat("_head", "_body", "_tail").alias("segment"), F.length("_head").alias("head"), F.length("_body").alias("body"), (F.col("role") == ASSISTANT).alias("trainable"),
    )


def _order(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}turn").asc_nulls_first(), F.col(f"{prefix}role"), F.col(f"{prefix}segment")]


def placed(segments: DataFrame) -> DataFrame:
    """Every segment with its place: n_context, how many stand before it, and context_chars, how long those are."""
    before = Window.partitionBy("conv_id").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    counted = segments.withColumn("n_context", F.count(F.lit(1)).over(before)).withColumn("context_chars", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)))
    return counted.select("conv_id", "turn", "role", "segment", "head", "body", "trainable", "n_context", "context_chars")


def examples(placed_: DataFrame) -> DataFrame:
    """One row for each assistant turn: the n_context segments before it and its own are the example's first example_chars
    characters, of which [loss_start, loss_start + loss_chars) train."""
    return placed_.where("trainable").select(
        "conv_id", "turn", "n_context", (F.col("context_chars") + F.col("head")).alias("loss_start"), F.col("body").cast("long").alias("loss_chars"), (F.col("context_chars") + F.length("segment")).alias("example_chars"),
    )


def with_text(segments: DataFrame, found: DataFrame) -> DataFrame:
    """The examples with their texts written out. Quadratic in a conversation's turns, as such a training file is."""
    whole = segments.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "segment"))), lambda x: x["segment"]), "").alias("_whole"))
    joined = found.alias("e").join(whole.withColumnRenamed("conv_id", "_conv"), F.expr("conv_id <=> _conv"))
    return joined.withColumn("text", F.substr("_whole", F.lit(1), F.col("example_chars").cast("int"))).drop("_conv", "_whole")


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("not a segment of this template")
    kind = m.lastgroup
    if kind == "other":
        return unescape(m["role"]), unescape(m["other"])
    return kind, unescape(m[kind])


def read_back(placed_: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each conversation: n_turns, turns_sha256 and formatted_chars, read from its segments in order, and n_examples, loss_chars and loss_sha256, read from its examples.

    An example follows the last segment that it takes, and what it trains on is
    cut out of that one; an example that reaches elsewhere is an error.
    """
    kind = placed_.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "n_examples", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, state, last = None, None, ""

        def close() -> None:
            if state is not None:
                out.append((now, state[0], state[1].hexdigest(), state[2], state[3], state[4].hexdigest(), state[5]))

        def flushed(id_type: pa.DataType) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 7, kinds)], names)
            out.clear()
            return batch

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, segment, at, start, chars, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, 0, hashlib.sha256(), 0]
                if start is None:
                    role, text = read_segment(segment)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[5] += len(segment)
                    last, begin = segment, at
                    continue
                if end != state[5] or start < begin:
                    raise ValueError("an example that does not end with the segment before it")
                masked = unescape(last[start - begin : start - begin + chars])
                state[2] += 1
                state[3] += len(masked)
                state[4].update(masked.encode())
            if len(out) > 5000:
                yield flushed(id_type)
        close()
        if id_type is not None:
            yield flushed(id_type)

    none = lambda t: F.lit(None).cast(t)
    rows = placed_.select("conv_id", "n_context", "segment", "context_chars", none("long").alias("loss_start"), none("long").alias("loss_chars"), none("long").alias("example_chars"))
    rows = rows.unionByName(found.select("conv_id", "n_context", none("string").alias("segment"), none("long").alias("context_chars"), "loss_start", "loss_chars", "example_chars"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "n_context", F.col("loss_start").asc_nulls_first())
    return dealt.select("conv_id", "segment", "context_chars", "loss_start", "loss_chars", "example_chars").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, n_examples long, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(ASSISTANT).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    segments = keep(placed(format_turns(turns.unionByName(own))), "segments")
    return read_back(segments, keep(examples(segments), "examples"))


QUERIES = {"op3_chat_format": op3_chat_format}
ORACLE_SQL: dict[str, str] = {}
