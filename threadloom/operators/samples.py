"""Chat samples from chains, role blocks, templates and whole-turn packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import EOS_ID, norm_text, strip, token_id, token_ids, words

#: Role markers of the chat format and the mask of prompt labels.
ROLE_MARKS = {"system": "<|System|>", "user": "<|Benutzer|>", "assistant": "<|Assistentin|>"}
#: Headings of the sectioned format, and the marks around a text.
SECTIONS = {"system": "[SYSTEM]", "user": "[USER]", "assistant": "[ASSISTANT]"}
BOS, EOS = "<s>", "</s>"
MASKED = -100


def turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_sample(chains: DataFrame) -> DataFrame:
    """``system, turns, target_answer`` of each chain.

    The system text is the root's. A row's user turn is its context and user text, two lines, if it has a user
    text; answers above the target are assistant turns; the target's answer stands by itself.
    """
    said = lambda r: F.when(r["Kontext"] != "", F.concat(r["Kontext"], F.lit("\n"), r["Benutzer"])).otherwise(r["Benutzer"])
    both = F.flatten(F.transform("chain", lambda r, i: F.array(
        F.when(r["Benutzer"] != "", turn("user", said(r))),
        F.when((r["Assistentin"] != "") & (i < F.size("chain") - 1), turn("assistant", r["Assistentin"])))))
    return chains.select(
        *[c for c in chains.columns if c != "chain"], F.element_at("chain", 1)["system"].alias("system"),
        F.filter(both, lambda t: t.isNotNull()).alias("turns"), F.element_at("chain", -1)["Assistentin"].alias("target_answer"))


def cap_history(turns: Column, most: int | None) -> Column:
    """The last ``most`` messages; all for None."""
    return turns if most is None else F.slice(turns, F.greatest(F.size(turns) - most + 1, F.lit(1)), most)


def role_block(role: Column, content: Column, eos: str = EOS) -> Column:
    """Marked block of a role; an unknown role gives the bare content."""
    mark = None
    for r, m in ROLE_MARKS.items():
        mark = F.when(role == r, m) if mark is None else mark.when(role == r, m)
    return F.when(role.isin(*ROLE_MARKS), F.concat(mark, strip(content), F.lit(eos))).otherwise(strip(content))


def prompt_blocks(max_history: int | None = None) -> Column:
    """Texts of a sample's prompt: system, capped turns, then the mark that opens the answer."""
    system = F.when(F.col("system") != "", F.array(role_block(F.lit("system"), F.col("system")))).otherwise(F.array().cast("array<string>"))
    said = F.transform(cap_history(F.col("turns"), max_history), lambda t: role_block(t["role"], t["content"]))
    return F.concat(system, said, F.array(F.lit(ROLE_MARKS["assistant"])))


def pack(df: DataFrame, window: int, prompt_loss: bool = False, blocks: str = "blocks", answer: str = "answer") -> DataFrame:
    """Adds ``input_ids, labels, seq_len, kept_blocks, masked, skipped`` to rows with id arrays ``blocks`` and ``answer``.

    The answer must fit; blocks are added from the last one backwards while they fit, empty ones are passed over,
    and the first that doesn't fit ends it. A row with any block above the window is skipped. ``skipped`` is null
    or the reason. Only lengths go through the fold; ids are sliced afterwards.
    """
    if window <= 0:
        raise ValueError("the window must be positive")
    size = F.size(answer)
    reason = F.when(size > window, "answer").when(F.exists(blocks, lambda b: F.size(b) > window), "block")
    step = lambda acc, n: F.when(acc["stop"] | (acc["used"] + n > window), F.struct(acc["used"].alias("used"), F.lit(True).alias("stop"), acc["n"].alias("n"))).otherwise(
        F.struct((acc["used"] + n).alias("used"), F.lit(False).alias("stop"), (acc["n"] + 1).alias("n")))
    kept = F.aggregate(F.reverse(F.filter(F.transform(blocks, lambda b: F.size(b)), lambda n: n > 0)), F.struct(size.alias("used"), F.lit(False).alias("stop"), F.lit(0).alias("n")), step, lambda a: a["n"])
    out = df.withColumn("skipped", reason).withColumn("kept_blocks", F.when(F.col("skipped").isNull(), kept))
    full = F.filter(blocks, lambda b: F.size(b) > 0)
    prompt = F.when(F.col("kept_blocks") == 0, F.array().cast("array<int>")).otherwise(F.flatten(F.slice(full, F.size(full) - F.col("kept_blocks") + 1, F.greatest(F.col("kept_blocks"), F.lit(1)))))
    out = out.withColumn("_prompt", F.when(F.col("skipped").isNull(), prompt))
    masked = F.lit(0) if prompt_loss else F.size("_prompt")
    labels = F.concat("_prompt", answer) if prompt_loss else F.concat(F.array_repeat(F.lit(MASKED), F.size("_prompt")), F.col(answer))
    ok = F.col("skipped").isNull()
    return out.withColumns({
        "input_ids": F.when(ok, F.concat("_prompt", answer)), "labels": F.when(ok, labels),
        "seq_len": F.when(ok, F.size("_prompt") + F.size(answer)), "masked": F.when(ok, masked)}).drop("_prompt")


def pack_chat(samples: DataFrame, window: int, max_history: int | None = None, prompt_loss: bool = False, tokens=token_ids) -> DataFrame:
    """Tokenised and packed chat samples; blocks are tokenised one by one. A blank answer is the end id alone."""
    target = strip(F.col("target_answer"))
    rows = samples.withColumn("blocks", F.transform(prompt_blocks(max_history), tokens)).withColumn("answer", F.concat(tokens(target), F.array(F.lit(EOS_ID))))
    out = pack(rows, window, prompt_loss)
    return out.drop("blocks", "answer")


def pack_plain(docs: DataFrame, window: int, text: str = "text", tokens=None, eos: int = EOS_ID) -> DataFrame:
    """Tokenised plain texts: blank ones are left out, longer ones than the window skipped, labels equal the ids.

    A text of one token gets the end id; ``input_ids``, ``labels``, ``seq_len`` are added. ``tokens`` makes ids of a text column, the
    default tokenizer's for None: then ids are made of the words that were counted, and only where they are read. Words (or ids)
    leave a generator of one row, so that filters and what reads them share one evaluation.
    """
    once = lambda c, name: rows.select("*", F.explode(F.array(c)).alias(name))
    rows = docs
    if tokens is None:
        rows = once(words(F.col(text)), "_w")
        ids = F.transform("_w", token_id)
    else:
        rows = once(norm_text(F.col(text)), "_t").where("_t != ''")
        rows = once(tokens(F.col("_t")), "_w")
        ids = F.col("_w")
    n = F.size("_w")
    rows = rows.where((n <= window) & (n > 0 if tokens is None else F.lit(True)))
    ids = F.when(n < 2, F.concat(ids, F.array(F.lit(eos)))).otherwise(ids)
    out = rows.withColumn("seq_len", n + (n < 2).cast("int")).withColumn("input_ids", ids).withColumn("labels", F.col("input_ids"))
    return out.drop("_w", "_t")


# -- templates ------------------------------------------------------------------


def alternates(messages: Column) -> Column:
    """Whether a chat template accepts the messages: system only in front, user and assistant each in its place.

    After an optional leading system message users stand first, third and so on and assistants between them; a role that the
    template doesn't know is passed over, but takes a place. No messages are accepted.
    """
    lead = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False)).cast("int")
    odd = lambda m, i: ((m["role"] == "system") & (i > 0)) | ((m["role"] == "user") & ((i + lead) % 2 == 1)) | ((m["role"] == "assistant") & ((i + lead) % 2 == 0))
    return F.forall(F.transform(messages, lambda m, i: F.coalesce(odd(m, i), F.lit(False))), lambda x: ~x)


def render(messages: Column, mode: str = "chat", prompt: bool = False, eos: str = EOS, bos: str = BOS) -> Column:
    """Messages in a template: ``plain`` (each content and a line end), ``instruct`` (headed sections) or role blocks for any other mode.

    Contents are stripped in role blocks only; roles that a template doesn't know add nothing there or to sections. Chat gives null
    for messages that it doesn't accept (``alternates``).
    """
    joined = lambda part: F.array_join(F.transform(messages, part), "")
    mode = mode.strip().lower()
    if mode == "plain":
        return joined(lambda m: F.concat(m["content"], F.lit("\n")))
    if mode == "instruct":
        head = lambda m: F.element_at(F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair]), m["role"])
        text = F.concat(F.lit(f"{bos}\n"), joined(lambda m: F.when(m["role"].isin(*SECTIONS), F.concat(head(m), F.lit("\n"), m["content"], F.lit("\n"))).otherwise("")))
        return F.concat(text, F.lit(SECTIONS["assistant"] + "\n")) if prompt else text
    out = joined(lambda m: F.when(m["role"].isin(*ROLE_MARKS), role_block(m["role"], m["content"], eos)).otherwise(""))
    out = F.concat(out, F.lit(ROLE_MARKS["assistant"])) if prompt else out
    return F.when(alternates(messages), out)


def conversation_only(messages: Column) -> Column:
    """User and assistant messages with lower-case roles."""
    low = F.transform(messages, lambda m: F.struct(F.lower(m["role"]).alias("role"), m["content"].alias("content")))
    return F.filter(low, lambda m: m["role"].isin("user", "assistant"))


def system_of(messages: Column) -> Column:
    """Content of the first system message, or null."""
    return F.get(F.filter(messages, lambda m: F.lower(m["role"]) == "system"), F.lit(0))["content"]


def inference_prompt(messages: Column, system: Column, mode: str = "chat") -> Column:
    """Rendered prompt: a blank last assistant message goes, the stripped system text comes first, the answer's mark last.

    Null for messages that the chat template doesn't accept; without any message the mark alone.
    """
    last = F.get(messages, F.size(messages) - 1)
    blank = F.coalesce((last["role"] == "assistant") & (norm_text(last["content"]) == ""), F.lit(False))
    trimmed = F.slice(messages, 1, F.greatest(F.size(messages) - blank.cast("int"), F.lit(0)))
    head = F.array(F.struct(F.lit("system").alias("role"), strip(system).alias("content")))
    return render(F.when(norm_text(system) != "", F.concat(head, trimmed)).otherwise(trimmed), mode, prompt=True)


def attention_mask(ids: Column, pad: int | None, eos: int | None, unk: int | None) -> Column:
    """1 for every id but the pad id; a missing pad id, or one that is the end id, gives way to the unknown one, else to the end id, else to 0."""
    if pad is None or pad == eos:
        pad = unk if unk is not None else eos or 0
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def preview(system: Column, turns: Column, answer: Column, most: int = 4000) -> Column:
    """Readable text of a sample, at most ``most`` characters: headed parts with a blank line between, no head for an empty system text.

    The short form has 4,000 characters, the full one 20,000.
    """
    part = lambda head, text: F.concat(F.lit("["), head, F.lit("]\n"), text)
    parts = F.concat(
        F.when(F.coalesce(system, F.lit("")) != "", F.array(part(F.lit("SYSTEM"), system))).otherwise(F.array().cast("array<string>")),
        F.transform(turns, lambda t: part(F.upper(t["role"]), t["content"])), F.array(part(F.lit("TARGET_ASSISTANT"), answer)))
    return F.substring(F.array_join(parts, "\n\n"), 1, most)
