"""Relational chat formatting: turns to one marked string and back, with Spark expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Marks of the template, and the strings that other templates treat as control.

    ``guard`` goes into a control string found inside a text, after its first character; a string that already
    holds guards gets one more, so reading back takes exactly one away.
    """

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    part: str = "<|im_part|>"
    end: str = "<|im_end|>"
    foreign: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|eot_id|>")
    guard: str = "~"

    def _slots(self, guards: str) -> str:
        """Pattern of the place after the first character of each control string, holding ``guards``."""
        words = sorted({self.start, self.sep, self.part, self.end, *self.foreign}, key=lambda w: (-len(w), w))
        g = _q(self.guard)
        return "|".join(f"(?<={_q(w[0])}){guards}(?={g}*{_q(w[1:])})" for w in words)

    def _may_hold(self, text: Column) -> Column:
        """Whether a text has any character that a control string begins with; few have, and the others need no pattern."""
        first = sorted({w[0] for w in (self.start, self.sep, self.part, self.end, *self.foreign)})
        out = F.contains(text, F.lit(first[0]))
        for c in first[1:]:
            out = out | F.contains(text, F.lit(c))
        return out

    def escape(self, text: Column) -> Column:
        return F.when(self._may_hold(text), F.regexp_replace(text, self._slots(""), self.guard)).otherwise(text)

    def unescape(self, text: Column) -> Column:
        return F.when(self._may_hold(text), F.regexp_replace(text, self._slots(_q(self.guard)), "")).otherwise(text)


def _q(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in text)


def format_conversations(
    rows: DataFrame, template: ChatTemplate = ChatTemplate(), loss_roles: tuple[str, ...] = ("assistant",),
    conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` string, ``loss_spans`` array of (start, length).

    Turns are sorted by ``turn``; rows that tie go by role, then text, and repeated rows stay. Adjacent turns of
    one role share one block, their texts divided by the part mark, so no boundary is lost. Spans count code
    points from 0 in ``formatted`` and cover the escaped texts of the loss roles, without any mark. Null text and
    null role count as empty, a null turn sorts first, null conversation ids form one conversation. An empty
    table gives no row; extra columns are ignored. A conversation becomes one string, so it must fit one row.
    """
    t = template
    cols = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    near = cols.withColumns({"k": F.row_number().over(w), "before": F.lag("role").over(w)})
    opened = F.concat(F.when(F.col("before").isNull(), F.lit("")).otherwise(F.lit(t.end)), F.lit(t.start), t.escape(F.col("role")), F.lit(t.sep))
    parts = near.select("conv_id", "k", "role", F.when(F.col("before") == F.col("role"), F.lit(t.part)).otherwise(opened).alias("head"), t.escape(F.col("text")).alias("body"))
    parts = parts.withColumns({"h": F.char_length("head").cast("long"), "b": F.char_length("body").cast("long")})
    upto = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("start", F.sum(F.col("h") + F.col("b")).over(upto) - F.col("b"))
    piece = F.struct("k", F.concat("head", "body").alias("s"), F.when(F.col("role").isin(*loss_roles), F.struct("start", F.col("b").alias("length"))).alias("span"))
    got = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("ps"))
    return got.select(
        "conv_id", F.concat(F.array_join(F.transform("ps", lambda p: p["s"]), ""), F.lit(t.end)).alias("formatted"),
        F.filter(F.transform("ps", lambda p: p["span"]), lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Inverse of the format: array of (role, text) structs, one per row that went in."""
    t = template
    blocks = F.filter(F.split(formatted, _q(t.end)), lambda b: b != "")
    opened = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(t.start) + 1)), _q(t.sep)))
    return F.flatten(F.transform(opened, lambda b: F.transform(F.split(F.get(b, F.lit(1)), _q(t.part)), lambda p: F.struct(
        t.unescape(F.get(b, F.lit(0))).alias("role"), t.unescape(p).alias("text")))))


_CHUNK = 2048


def loss_texts(formatted: Column, spans: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """Texts under the loss mask, unescaped, in order.

    The string is cut into chunks once and each span taken from its own, so a long conversation takes time in proportion to its length.
    """
    chunks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))

    def cut(cs: Column, s: Column) -> Column:
        first = F.floor(s["start"] / _CHUNK).cast("int")
        n = F.floor((s["start"] + s["length"]) / _CHUNK).cast("int") - first + 1
        return F.substr(F.array_join(F.slice(cs, first + 1, n), ""), (s["start"] - first * _CHUNK + 1).cast("int"), s["length"].cast("int"))

    # a one-element array binds the chunks, so that they are made once
    return F.flatten(F.transform(F.array(chunks), lambda cs: F.transform(spans, lambda s: template.unescape(cut(cs, s)))))


def digest(convs: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Lengths and digests of formatted conversations, all taken from the output itself."""
    back = convs.select("conv_id", "formatted", read_back(F.col("formatted"), template).alias("turns"),
                        F.array_join(loss_texts(F.col("formatted"), F.col("loss_spans"), template), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
