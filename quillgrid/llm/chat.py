"""Chat formatting: conversations become one string each, with a mask of the text to train on.

Relational formatting with Spark expressions only: the turns of a conversation are collected as structs and sorted,
adjacent turns of one role are merged into blocks of an array, and the marked blocks are concatenated. A conversation is
one string in the result, so its turns meet in one row by definition; `collect_list` spills nothing else.

The mask is a list of places in the string, (start, length) in code points: one for each turn of a trained role, its text
without any mark. What is read back for training is cut out of the string at those places.

Reversible: inside roles and texts `&` becomes `&amp;` and `<|`, which begins every mark, becomes `&lt;|`.

Cases: null text or role is empty; turns are ordered by turn, then role, then text (null turns first), so ties and
repeated rows have one result; each row without conv_id is a conversation of its own; very long texts and conversations of
very many turns are formatted whole, in time that grows with their length; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """The marks. Each begins with `<|`, which no escaped text holds."""

    start: str = "<|start|>"
    text: str = "<|text|>"
    next: str = "<|next|>"
    end: str = "<|end|>\n"
    trained: tuple[str, ...] = ("assistant",)


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


_PIECE = "array<struct<text:string,loss:boolean>>"
#: Pieces summed or cut at a time: appending to one long array, or cutting from the start of one long string, for each
#: piece would take quadratic time.
STEP = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once; inside a lambda an expression would be computed for each element."""
    return F.transform(F.array(value), use)[0]


def _in_steps(pieces: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(pieces) / STEP).cast("int") - 1), lambda i: F.slice(pieces, i * STEP + 1, F.lit(STEP)))


def _blocks(t: Column) -> Column:
    """Sorted turns as (role, texts): adjacent turns of one role together."""
    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))

    def block(s: Column) -> Column:
        ends = F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(t)))
        return F.zip_with(s, ends, lambda a, b: F.struct(F.get(t, a)["role"].alias("role"), F.transform(F.slice(t, a + 1, b - a), lambda x: x["text"]).alias("texts")))

    return _let(starts, block)


def _places(pieces: Column) -> Column:
    """Start and length of the pieces under the mask, in the string that all pieces make."""
    none = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def one(a: Column, x: Column) -> Column:
        n = F.length(x["text"]).cast("long")
        here = F.array(F.struct(a["at"].alias("start"), n.alias("length")))
        return F.struct((a["at"] + n).alias("at"), F.when(x["loss"], F.concat(a["out"], here)).otherwise(a["out"]).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), one)
        return _let(inner, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<struct<start:bigint,length:bigint>>>").alias("out"))
    return F.flatten(F.aggregate(_in_steps(pieces), first, step)["out"])


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, and mask: (start, length) of each text of a trained role in `formatted`.

    Adjacent turns of one role merge into a block; `template.next` stands between their texts.
    """
    t = template
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    # rows without conv_id are not one conversation
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    sorted_turns = turns.select("conv_id", alone.alias("alone"), row.alias("row")).groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("row")).alias("t"))

    def written(b: Column) -> Column:
        loss = b["role"].isin(*t.trained)
        mark = lambda m: F.struct(m.alias("text"), F.lit(False).alias("loss"))
        opening = F.concat(F.lit(t.start), escape(b["role"]), F.lit(t.text))
        texts = F.transform(b["texts"], lambda x, i: F.array(mark(F.when(i == 0, opening).otherwise(F.lit(t.next))), F.struct(escape(x).alias("text"), loss.alias("loss"))))
        return F.array_append(F.flatten(texts), mark(F.lit(t.end)))

    pieces = sorted_turns.select("conv_id", _let(F.col("t"), _blocks).alias("b")).select("conv_id", F.flatten(F.transform("b", written)).cast(_PIECE).alias("pieces"))
    return pieces.select("conv_id", F.array_join(F.transform("pieces", lambda s: s["text"]), "").alias("formatted"), _let(F.col("pieces"), _places).alias("mask"))


def _cut(text: Column, mask: Column) -> Column:
    """The parts of a text at (start, length) places in order."""

    def parts(some: Column) -> Column:
        first, last = F.element_at(some, 1), F.element_at(some, -1)
        window = F.substring(text, first["start"].cast("int") + 1, (last["start"] + last["length"] - first["start"]).cast("int"))
        return _let(window, lambda w: F.transform(some, lambda p: F.substring(w, (p["start"] - first["start"]).cast("int") + 1, p["length"].cast("int"))))

    return F.when(F.size(mask) > 0, F.flatten(F.transform(_in_steps(mask), parts))).otherwise(F.array().cast("array<string>"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, turns (role, text) and trained (the unescaped texts under the mask, joined), read from the output."""
    t = template

    def turns_of(block: Column) -> Column:
        halves = F.split(F.substring(block, len(t.start) + 1, 2**31 - 1), _literal(t.text))
        texts = lambda h: F.transform(F.split(h[1], _literal(t.next)), lambda x: F.struct(unescape(h[0]).alias("role"), unescape(x).alias("text")))
        return _let(halves, texts)

    blocks = F.split("formatted", _literal(t.end))
    return formatted.select(
        "conv_id",
        "formatted",
        _let(blocks, lambda b: F.flatten(F.transform(F.slice(b, 1, F.size(b) - 1), turns_of))).alias("turns"),
        F.array_join(F.transform(_cut(F.col("formatted"), F.col("mask")), unescape), "").alias("trained"),
    )


def _literal(mark: str) -> str:
    """A regular expression for exactly this mark."""
    return "\\Q" + mark + "\\E"
