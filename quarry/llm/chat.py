r"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns
of the same role are merged by array aggregation, and the pieces concatenated::

    [INST] user [/INST]first text[+]second text</s>[INST] assistant [/INST]answer</s>

``[INST]`` opens a block, ``[/INST]`` ends its role, ``[+]`` stands between the
texts of merged turns, ``</s>`` closes the block. A null role has a block without
a role (``[INST][/INST]``).

Escaping: inside texts and roles, every control string gets a backslash after its
first character, and one that already has backslashes there gets one more
(``</s>`` becomes ``<\/s>``, ``<\/s>`` becomes ``<\\/s>``); all other text stays as
it is. Control strings begin with ``[`` or ``<`` and hold neither later, so none
can arise across a seam, and reading back is exact for every text.

``loss`` lists the spans of the formatted string that count in the loss, as start
and length in UTF-8 bytes (bytes are cut without a scan from the start, so reading
all spans is linear): the texts of assistant turns, without marks.

Size: a conversation is one row of the result, as its digests are taken over the
whole of it; a task holds one conversation at a time (at most 2 GB, Spark's limit
for a value). Conversations are dealt by id, texts cross the network once.

Edge cases: a null text is empty; null roles are a role of their own; turns order
by (turn, role, text), nulls first, so ties and repeated rows have a fixed order
and all stay; a null ``conv_id`` is a conversation of its own; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, NAMED, JOINT, CLOSE = "[INST]", "[/INST]", "[+]", "</s>"
LEARNED = "assistant"
_TAILS = "|".join(re.escape(c[1:]) for c in (OPEN, NAMED, JOINT, CLOSE))
_CHUNK = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*)({_TAILS})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*)({_TAILS})", r"$1$2$3")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(values: Column) -> Column:
    """For each entry the sum of those before it; sums of chunks first, so the work stays near linear."""
    def chunks(v):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _CHUNK).cast("int")),
                           lambda c: F.slice(v, c * _CHUNK + 1, F.lit(_CHUNK)))

    def within(part, base):
        return F.transform(part, lambda _, k: base + _sum(F.slice(part, F.lit(1), k)))

    def spread(parts, sums):
        return F.flatten(F.transform(parts, lambda part, i: _let(
            _sum(F.slice(sums, F.lit(1), i)), lambda base: within(part, base))))

    return _let(values, lambda v: _let(chunks(v), lambda parts: _let(
        F.transform(parts, _sum), lambda sums: spread(parts, sums))))


def collect_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turns``: the sorted structs (turn, role, text) of each conversation."""
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(
        "turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("one"))
    return given.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def merge_turns(turns: Column) -> Column:
    """Blocks ``(role, texts)``: the texts of each run of adjacent turns of one role."""
    def blocks(t, starts):
        return F.transform(starts, lambda at, j: F.struct(
            F.get(t, at)["role"].alias("role"),
            F.transform(F.slice(t, at + 1, F.coalesce(F.get(starts, j + 1), F.size(t)) - at),
                        lambda one: one["text"]).alias("texts")))

    return _let(turns, lambda t: _let(
        F.filter(F.sequence(F.lit(0), F.size(t) - 1),
                 lambda i: (i == 0) | ~F.get(t, i)["role"].eqNullSafe(F.get(t, i - 1)["role"])),
        lambda starts: blocks(t, starts)))


def _rendered(blocks: Column) -> Column:
    """Each block's head, and its texts escaped."""
    return F.transform(blocks, lambda b: F.struct(
        F.concat(F.lit(OPEN), F.coalesce(F.concat(F.lit(" "), escape(b["role"]), F.lit(" ")), F.lit("")),
                 F.lit(NAMED)).alias("head"),
        b["role"].eqNullSafe(F.lit(LEARNED)).alias("learned"),
        F.transform(b["texts"], escape).alias("bodies")))


def _spans(rendered: Column) -> Column:
    """Byte spans of the learned texts."""
    def parts(b, j):
        return F.transform(b["bodies"], lambda body, k: F.struct(
            (F.when(k > 0, F.lit(len(JOINT))).otherwise(
                F.octet_length(b["head"]) + F.when(j > 0, F.lit(len(CLOSE))).otherwise(F.lit(0)))
             ).cast("long").alias("skip"),
            F.octet_length(body).cast("long").alias("length"), b["learned"].alias("learned")))

    def placed(p):
        ahead = _before(F.transform(p, lambda x: x["skip"] + x["length"]))
        return F.zip_with(p, ahead, lambda x, a: F.struct(
            (a + x["skip"]).alias("start"), x["length"].alias("length"), x["learned"].alias("learned")))

    every = _let(F.flatten(F.transform(rendered, parts)), placed)
    return F.transform(F.filter(every, lambda s: s["learned"]), lambda s: F.struct(s["start"], s["length"]))


def format_chats(rows: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss, n_blocks`` of the conversations ``rows(conv_id, turn, role, text)``."""
    rendered = (collect_turns(rows).select("conv_id", merge_turns(F.col("turns")).alias("blocks"))
                .select("conv_id", _rendered(F.col("blocks")).alias("rendered")))
    text = F.array_join(F.transform("rendered", lambda b: F.concat(
        b["head"], F.array_join(b["bodies"], JOINT), F.lit(CLOSE))), "")
    return rendered.select("conv_id", text.alias("formatted"), _spans(F.col("rendered")).alias("loss"),
                           F.size("rendered").cast("long").alias("n_blocks"))


def read_turns(formatted: Column) -> Column:
    """The turns ``(role, text)`` of a formatted conversation, merged ones apart again."""
    def block(b):
        return _let(F.locate(NAMED, b), lambda cut: _turns_of(
            F.substring(b, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1),
            F.substring(b, cut + len(NAMED), F.length(b))))

    def _turns_of(head, body):
        role = F.when(head != "", unescape(F.substring(head, F.lit(2), F.length(head) - 2)))
        return F.transform(F.split(body, re.escape(JOINT), -1),
                           lambda text: F.struct(role.alias("role"), unescape(text).alias("text")))

    return F.flatten(_let(F.split(formatted, re.escape(CLOSE), -1), lambda parts: F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1), block)))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return _let(formatted.cast("binary"), lambda data: F.array_join(F.transform(loss, lambda s: unescape(
        F.substring(data, (s["start"] + 1).cast("int"), s["length"].cast("int")).cast("string"))), ""))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of what ``format_chats`` gave, read back from it."""
    read = chats.select("conv_id", "n_blocks", read_turns(F.col("formatted")).alias("turns"),
                        read_loss(F.col("formatted"), F.col("loss")).alias("learned"),
                        F.length("formatted").cast("long").alias("formatted_chars"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(
        F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars", "n_blocks")


def with_probe(rows: DataFrame) -> DataFrame:
    """``rows`` and conversation -7, both of whose turns consist of control strings."""
    said = F.lit(CLOSE + OPEN + " ok " + NAMED)
    turn = F.col("id").alias("turn")
    probe = rows.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), turn, F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"),
        said.alias("text"))
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(probe)
