r"""Chat formatting with Spark expressions only.

A block is a maximal run of adjacent turns of one role::

    <|im_start|>ROLE
    TEXT<|im_next|>TEXT<|im_end|>

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\|``; a line break in a role
becomes ``<\n|``. So no text can forge a mark, and :func:`read_back` gives every turn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, NEXT, END = "<|im_start|>", "<|im_next|>", "<|im_end|>\n"


def _swap(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    return _swap(_swap(c, "\\", "\\\\"), "<|", "<\\|")


def unescape(c: Column) -> Column:
    return _swap(_swap(_swap(c, "<\\n|", "\n"), "<\\|", "<|"), "\\\\", "\\")


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def sums_before(numbers: Column, chunk: int = 128) -> Column:
    """For each number of an array the sum of those before it: sums of whole chunks, and of the
    rest, so that an array of 100,000 takes seconds (an accumulator that grows is copied each time)."""

    def of(all_: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / chunk).cast("int")), lambda c: _sum(F.slice(all_, c * chunk + 1, F.lit(chunk))))
        whole = lambda k: F.floor(k / chunk).cast("int")
        before = lambda sums: F.transform(all_, lambda _, k: _sum(F.slice(sums, F.lit(1), whole(k))) + _sum(F.slice(all_, whole(k) * chunk + 1, k % chunk)))
        return _let(chunks, before)

    return _let(numbers, of)


def merge_turns(turns: Column) -> Column:
    """A sorted array of turns as blocks: adjacent turns of one role become one, with all their texts."""

    def blocks(starts: Column) -> Column:
        def block(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(turns))
            return F.struct(F.get(turns, s).role.alias("role"), F.transform(F.slice(turns, s + 1, end - s), lambda x: x.text).alias("texts"))

        return F.transform(starts, block)

    opens = F.filter(F.sequence(F.lit(0), F.size(turns) - 1), lambda i: (i == 0) | (F.get(turns, i).role != F.get(turns, i - 1).role))
    return _let(opens, blocks)


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), _swap(escape(role), "\n", "<\\n|"), F.lit("\n"))


def _written(block: Column) -> Column:
    return F.concat(_head(block.role), F.array_join(F.transform(block.texts, escape), NEXT), F.lit(END))


def _spans(blocks: Column, learn: str) -> Column:
    """Where the texts of the role ``learn`` stand in all blocks, written one after the other."""

    def block(b: Column, before: Column) -> Column:
        sizes = F.transform(b.texts, lambda t: F.char_length(escape(t)))
        start = before + F.char_length(_head(b.role)) + 1
        span = lambda size, at: F.struct((start + at).alias("start"), size.alias("length"))
        learned = _let(sizes, lambda z: F.zip_with(z, sums_before(F.transform(z, lambda n: n + len(NEXT))), span))
        return F.when(b.role == learn, learned).otherwise(F.array().cast("array<struct<start:int,length:int>>"))

    return F.flatten(F.zip_with(blocks, sums_before(F.transform(blocks, lambda b: F.char_length(_written(b)))), block))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` holds start (from 1) and length, in code points of ``formatted``, of each text
    of the role ``learn``. Turns sort by ``turn`` (nulls first), then role, then text; repeated
    rows stay as turns of their own. A null role or text counts as empty, rows with a null
    ``conv`` make one conversation, other columns are not read, and no rows give no rows.

    The turns of a conversation are gathered once, as one array of structs, sorted and merged in
    it: one exchange by conversation. A conversation is a row, so it has to fit in a task.
    """
    turns = F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    chats = rows.groupBy(F.col(f"`{conv}`").alias("conv")).agg(F.sort_array(F.collect_list(turns)).alias("turns"))
    chats = chats.select("conv", merge_turns(F.col("turns")).alias("blocks"))
    return chats.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("blocks", _written), "").alias("formatted"),
        _spans(F.col("blocks"), learn).alias("loss_spans"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, F.size(F.split(formatted, r"<\|im_start\|>")))

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(block, F.char_length(role) + 2, F.char_length(block) - F.char_length(role) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_next\|>"), lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column, chunk: int = 4096) -> Column:
    """All text under the loss mask, unescaped. Spans are cut from chunks, as finding a place in a
    long text takes time in proportion to it."""

    def of(chunks: Column) -> Column:
        def cut(s: Column) -> Column:
            first = F.floor((s.start - 1) / chunk).cast("int")
            last = F.floor((s.start + s.length - 2) / chunk).cast("int")
            held = F.array_join(F.slice(chunks, first + 1, last - first + 1), "")
            return unescape(F.substr(held, (s.start - 1) % chunk + 1, s.length))

        return F.array_join(F.transform(spans, cut), "")

    places = F.sequence(F.lit(0), F.floor(F.char_length(formatted) / chunk).cast("int"))
    return _let(F.transform(places, lambda c: F.substr(formatted, c * chunk + 1, F.lit(chunk))), of)
