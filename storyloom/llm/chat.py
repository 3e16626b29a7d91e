"""Conversations as training text by a chat template, in files of JSON lines, with the spans that carry the loss."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.shared import bounded, shared_dir, written
from storyloom.llm.templates import Template

#: Strings that models read as control, which a text may hold by chance.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
CHAT = (
    "<s>{% for m in messages %}<|im_start|>{{ m.role | header }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|im_end|>\n{% endfor %}</s>"
)
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)
SLICE_BITS = 12
OUT = "conv_id long, slot long, place long, several boolean, text string, spans array<struct<s:long,e:long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(x: str | None) -> str:
    """Backslashes doubled, and one put after the first character of each control string, which is none then."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", (x or "").replace("\\", "\\\\"))


def header(x: str | None) -> str:
    """As ``escape``, with a backslash before newlines, as a header ends at the first without one."""
    return escape(x).replace("\n", "\\\n")


def unescape(x: str) -> str:
    return re.sub(r"\\(.)", r"\1", x, flags=re.S) if "\\" in x else x


def chat_template(source: str = CHAT) -> Template:
    return Template(source, {"escape": escape, "header": header})


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``most`` characters of text (a column named text, if there is one)."""
    at = schema.get_field_index("text")
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += 100 + (len(r[at]) if at >= 0 else 0)
        if size > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def format_chats(turns: DataFrame, source: str = CHAT, slice_bits: int = SLICE_BITS, folder: str | None = None, most_sent: int = 500_000) -> DataFrame:
    """The turns as formatted text, written as gzipped JSON lines to ``folder`` (by default a new one in the shared folder)
    and read from there: conv_id, slot, place (of the turn in its conversation), several, text, spans (s, e: code points of
    ``text`` under the loss mask).

    Turns of a conversation stand by turn, equal ones by role and text, null ones first. A conversation goes in slices of
    2 ** slice_bits turn numbers, each sorted and rendered one turn after the other by one task; a slice knows its place by
    the counts of the slices, so neither a long conversation nor a slice is held in memory. Null roles and texts are empty; a
    null conv_id is a conversation; repeated rows are turns each; other columns are left out; no rows give no lines.
    """
    spark = turns.sparkSession
    bounded(spark)
    slot = F.coalesce(F.shiftright(F.col("turn").cast("long"), slice_bits), F.lit(-(1 << 62)))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), slot.alias("slot"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id")
    counts = rows.groupBy("conv_id", "slot").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(w.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(counts.withColumns({"start": before, "final": F.max("slot").over(w) == F.col("slot"), "first": F.min("slot").over(w) == F.col("slot")}).where("NOT (first AND final)").select("conv_id", "slot", "start", "final"))
    many = starts.count()  # slices of conversations of several, a few dozen bytes each
    on = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.slot") == F.col("b.slot"))
    if many:
        placed = rows.alias("a").join((F.broadcast(starts) if many <= most_sent else starts).alias("b"), on, "left").select("a.conv_id", "a.slot", "turn", "role", "text", "start", F.coalesce("final", F.lit(True)).alias("final"))
    else:
        placed = rows.select("conv_id", "slot", "turn", "role", "text", F.lit(None).cast("long").alias("start"), F.lit(True).alias("final"))
    ordered = placed.repartition("conv_id", "slot").sortWithinPartitions("conv_id", "slot", "turn", "role", "text").drop("turn")
    schema = pa.schema([("conv_id", pa.int64()), ("slot", pa.int64()), ("place", pa.int64()), ("several", pa.bool_()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])

    def render(batches):
        template = chat_template(source)

        def made():
            key, place = None, 0
            rows = _rows(batches)
            row = next(rows, None)
            while row is not None:
                after = next(rows, None)
                conv, slot, role, text, start, final = row
                if key != (conv, slot):
                    key, place = (conv, slot), start or 0
                last = final and (after is None or after[:2] != key)
                out, spans = template.turn({}, {"role": role, "text": text}, place, last)
                yield conv, slot, place, start is not None, out, [{"s": s, "e": e} for s, e in spans]
                place, row = place + 1, after

        yield from _batches(made(), schema)

    path = folder or f"{shared_dir(spark)}/chats-{uuid.uuid4().hex}"
    ordered.mapInArrow(render, OUT).write.option("compression", "gzip").json(path)
    return read_chats(spark, path)


def read_chats(spark, path: str) -> DataFrame:
    """The lines that ``format_chats`` wrote. A gzipped file is read by one task, in order."""
    return spark.read.schema(OUT).option("maxStringLen", 2**31 - 1).json(path)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of formatted text."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]


def chat_digests(lines: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, from the formatted lines.

    The turns are parsed from the text and the loss from its spans. A conversation of one slice stands in one file, in order,
    and is digested as it is read. Only the lines of conversations of several slices are shuffled; a digest needs a
    conversation's lines one after the other, in one task, which holds one line at a time.
    """
    kinds = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def digest(batches):
        def made():
            key, at, state = None, 0, None
            for conv, place, text, spans in _rows(batches):
                if state is None or place == 0 or key != conv:
                    if state is not None:
                        yield key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                    key, at, state = conv, 0, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if place != at:
                    raise RuntimeError(f"line {place} of conversation {conv} where line {at} was due")
                at += 1
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    said = unescape(text[span["s"] : span["e"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if state is not None:
                yield key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from _batches(made(), pa.schema(kinds))

    bounded(lines.sparkSession)
    needed = ["conv_id", "place", "text", "spans"]
    whole = lines.where("NOT several").select(needed).mapInArrow(digest, DIGEST)
    sliced = lines.where("several").select(needed).repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(digest, DIGEST)
    return whole.union(sliced)
