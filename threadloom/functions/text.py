"""Text primitives with one meaning in every engine: white space, strip, words, lines, ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 29 code points of Python white space, and line ends, as bodies of regex classes.
WS_BODY = r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_BODY}]"
WORD = f"[^{WS_BODY}]+"
LINE_END = r"\r\n|[\x0a-\x0d\x1c-\x1e\x{85}\x{2028}\x{2029}]"

EOS_ID = 2
PAD_ID = 0


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WS}+|{WS}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{WS}+\z", "")


def norm_text(c: Column) -> Column:
    """Stripped text; null, empty and blank are one class, the empty text."""
    return F.coalesce(strip(c), F.lit(""))


def normalize_id(c: Column) -> Column:
    """Stripped id without one trailing ``.0``; null becomes the empty id."""
    return F.regexp_replace(norm_text(c), r"\.0\z", "")


def words(c: Column) -> Column:
    """Runs of anything but white space. The text is divided at the gaps, which takes a third of the time of finding the runs."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"{WS}+"), "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", " "))


def lines(c: Column) -> Column:
    """Lines as ``str.splitlines`` gives them: a line end at the very end opens no further line."""
    parts = F.split(F.coalesce(c, F.lit("")), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def code_line(c: Column) -> Column:
    """Right-stripped line with tabs as four blanks; the indent stays."""
    return F.replace(rstrip(c), F.lit("\t"), F.lit("    "))


def token_id(word: Column) -> Column:
    """Engine-neutral id of a word: the first seven hex digits of its md5."""
    return F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int")


def token_ids(c: Column) -> Column:
    """Default tokenizer: one id for each word."""
    return F.transform(words(c), token_id)


def token_count(c: Column) -> Column:
    """Number of ``words``."""
    return F.size(words(c))


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of ``phrase``, which must not be empty."""
    gone = F.replace(text, phrase, F.lit(""))
    return ((F.char_length(text) - F.char_length(gone)) / F.char_length(phrase)).cast("int")


def phrase_token(phrase: Column) -> Column:
    return F.concat(F.lit("<|ng:"), F.substring(F.sha1(phrase), 1, 16), F.lit("|>"))


def wrap_start_stop(c: Column) -> Column:
    """``<s>…</s>`` around stripped text; empty stays empty."""
    s = norm_text(c)
    return F.when(s == "", "").otherwise(F.concat(F.lit("<s>"), s, F.lit("</s>")))


def format_eta(seconds: Column) -> Column:
    """``HH:MM:SS`` of whole, non-negative seconds."""
    s = F.greatest(F.floor(seconds), F.lit(0)).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours = F.floor(s / 3600)
    return F.concat(F.when(hours < 100, two(hours)).otherwise(hours.cast("string")), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60))


def safe_name(c: Column) -> Column:
    """Name for a folder: anything but letters and numbers of any script, ``-``, ``_``, ``.`` becomes ``_``; ``model`` for null and empty text."""
    return F.when(F.coalesce(c, F.lit("")) == "", "model").otherwise(F.regexp_replace(c, r"[^\p{L}\p{N}\-_.]", "_"))


def run_dir_name(c: Column, at: Column) -> Column:
    """Folder of a run: its safe name and the local time that it began at."""
    return F.concat(safe_name(c), F.lit("_"), F.date_format(at, "yyyy-MM-dd_HH-mm-ss"))


# the same primitives as SQL text for the engine that checks queries

SQL_WS = WS
SQL_WORD = WORD


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_norm(x: str) -> str:
    return f"coalesce({sql_strip(x)}, '')"


def sql_words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '{WORD}')"


def sql_token(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 7))::BIGINT"
