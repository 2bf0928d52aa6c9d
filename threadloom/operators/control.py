"""Small queries over run logs, status events, requests and catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import norm_text, rstrip, wrap_start_stop

RING, TAIL = 8_000, 200


def retained(log: DataFrame, ring: int = RING, line_id: str = "line_id") -> DataFrame:
    """The newest ``ring`` lines; ids are gapless."""
    top = log.agg(F.max(line_id).alias("_top"))
    return log.join(F.broadcast(top)).where(F.col(line_id) > F.col("_top") - ring).drop("_top")


def tail(log: DataFrame, n: int = TAIL, line_id: str = "line_id") -> DataFrame:
    return log.orderBy(F.desc(line_id)).limit(n)


def since(log: DataFrame, cursor: int, ring: int = RING, line_id: str = "line_id") -> DataFrame:
    """Lines after the cursor; all that are retained if the cursor has left the ring."""
    return retained(log, ring, line_id).where(F.col(line_id) > cursor)


def last_known(events: DataFrame, key: str, order: str, plain: list[str], truthy: list[str] = ()) -> DataFrame:
    """Last value of each field by key: null never replaces a value; in ``truthy`` fields zero and empty text don't either."""
    pick = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order)))
    solid = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != "") & (F.coalesce(F.try_to_number(F.col(c).cast("string"), F.lit("999999999999")), F.lit(1)) != 0), F.col(order)))
    return events.groupBy(key).agg(*[pick(c).alias(c) for c in plain], *[solid(c).alias(c) for c in truthy])


def union_in_order(sources: list[DataFrame], key: str) -> DataFrame:
    """``key, priority``: each key once, with the first source that has it."""
    out = None
    for i, df in enumerate(sources):
        part = df.select(F.col(key)).where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("priority", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(key).agg(F.min("priority").alias("priority"))


def latest_valid(files: DataFrame, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """The newest folder that holds ``merged/config.json`` or ``config.json``; the merged model if it has both."""
    rx = r"^(.*?)/(merged/)?config\.json$"
    got = files.where(F.col(path).rlike(rx)).select(F.regexp_extract(path, rx, 1).alias("folder"), (F.regexp_extract(path, rx, 2) != "").alias("merged"), F.col(mtime).alias("mtime"))
    one = got.groupBy("folder").agg(F.max("mtime").alias("mtime"), F.max("merged").alias("merged"))
    return one.orderBy(F.desc("mtime"), "folder").limit(1).select(F.when(F.col("merged"), F.concat("folder", F.lit("/merged"))).otherwise(F.col("folder")).alias("model_dir"))


def with_config(runs: DataFrame, configs: DataFrame, key: str = "run") -> DataFrame:
    """Runs by name with their configuration, ``{}`` where it is missing or broken."""
    return runs.join(configs.select(key, "config"), key, "left").withColumn("config", F.coalesce("config", F.lit("{}"))).orderBy(key)


def flatten_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One text a row: ``column: value`` lines between start and stop marks; null values stay empty, nested ones become JSON."""
    parts = []
    for f in df.schema.fields:
        if columns is not None and f.name not in columns:
            continue
        nested = f.dataType.typeName() in ("struct", "array", "map")
        value = F.to_json(F.col(f.name)) if nested else F.when(F.col(f.name), "True").otherwise("False") if f.dataType.typeName() == "boolean" else F.col(f.name).cast("string")
        parts.append(F.concat(F.lit(f"{f.name}: "), F.coalesce(value, F.lit(""))))
    return df.select("*", wrap_start_stop(F.concat_ws("\n", *parts)).alias("text_flat"))


#: Sampling settings that stand for null, and the lowest ones allowed.
SAMPLING_DEFAULTS = {"temperature": 0.0, "top_p": 1.0, "top_k": 40, "repetition_penalty": 1.1}
LEAST_TEMPERATURE, LEAST_PENALTY = 1e-5, 0.01


def sanitize_sampling(requests: DataFrame) -> DataFrame:
    """Sampling settings made safe, as ``safe_*`` columns and ``do_sample``; missing input columns count as null.

    Without a temperature above 0 decoding is greedy: temperature 0, ``top_p`` 1, ``top_k`` 0, no sampling whatever is asked for. Else
    ``top_p`` outside (0, 1] is 1, ``top_k`` at least 0, and sampling is on unless ``do_sample`` says no. ``max_new_tokens`` is at least 1.
    """
    given = lambda c, kind: F.col(c).cast(kind) if c in requests.columns else F.lit(None).cast(kind)
    t, p, k, rp = (F.coalesce(given(c, "int" if c == "top_k" else "double"), F.lit(v)) for c, v in SAMPLING_DEFAULTS.items())
    on = t > 0
    return requests.withColumns({
        "safe_temperature": F.when(on, F.greatest(t, F.lit(LEAST_TEMPERATURE))).otherwise(F.lit(0.0)),
        "safe_top_p": F.when(on & (p > 0) & (p <= 1), p).otherwise(F.lit(1.0)), "safe_top_k": F.when(on, F.greatest(k, F.lit(0))).otherwise(F.lit(0)),
        "safe_repetition_penalty": F.greatest(rp, F.lit(LEAST_PENALTY)), "safe_max_new": F.greatest(F.coalesce(given("max_new_tokens", "int"), F.lit(1)), F.lit(1)),
        "do_sample": on & F.coalesce(given("do_sample", "boolean"), F.lit(True))})


def stopped(text: Column, stops: list[str]) -> Column:
    """Whether any stop string occurs."""
    return F.exists(F.array(*[F.lit(s) for s in stops]), lambda s: F.contains(text, s)) if stops else F.lit(False)


def usage(prompts: DataFrame, key: str, order: str, prompt_ids: str, answer_ids: str) -> DataFrame:
    """Token counts of a request; of several prompts only the last one's count."""
    last = F.max_by(F.struct(F.size(prompt_ids).alias("prompt_tokens"), F.size(answer_ids).alias("completion_tokens")), order)
    return prompts.groupBy(key).agg(last.alias("u")).select(key, "u.*", (F.col("u.prompt_tokens") + F.col("u.completion_tokens")).alias("total_tokens"))


def gpu_stats(text: DataFrame, value: str = "value", host: str = "host") -> DataFrame:
    """``host, gpu, name, util, mem_used, mem_total`` from headerless lines ``util, total, used, name`` of each host.

    ``line_no`` gives a host's order. One broken line (not four fields, or a field that is no whole number) and the host reports no GPU at all.
    """
    f = F.split(F.col(value), ",")
    num = lambda i: F.expr(f"try_cast(trim(get(f, {i})) as int)")
    rows = text.select(F.col(host).alias("host"), "line_no", f.alias("f")).select("host", "line_no", F.size("f").alias("n"), num(0).alias("util"), num(1).alias("mem_total"), num(2).alias("mem_used"), F.trim(F.get("f", F.lit(3))).alias("name"))
    ok = F.coalesce((F.col("n") == 4) & F.col("util").isNotNull() & F.col("mem_total").isNotNull() & F.col("mem_used").isNotNull(), F.lit(False))
    own = Window.partitionBy("host")
    got = rows.withColumn("whole", F.min(ok).over(own)).withColumn("gpu", F.row_number().over(own.orderBy("line_no")) - 1)  # a host has a few GPUs
    return got.where("whole").select("host", "gpu", "name", "util", "mem_used", "mem_total")


def pumped(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of a process as its log takes them: empty ones left out, then without white space behind."""
    return lines.where(F.regexp_replace(line, r"\n+\z", "") != "").withColumn(line, rstrip(F.col(line)))


def record_fields(records: DataFrame, schema: str, defaults: dict, value: str = "value") -> DataFrame:
    """Fields of JSON records by a fixed schema; a missing, null or broken one has its default."""
    got = records.withColumn("_r", F.from_json(F.col(value), schema))
    return got.withColumns({c: F.coalesce(F.col(f"_r.{c}"), F.lit(v)) for c, v in defaults.items()}).drop("_r")


def final_state(runs: DataFrame) -> DataFrame:
    """``state`` of ended runs: stopped on request, finished on exit code 0, else failed."""
    return runs.withColumn("state", F.when(F.col("stop_requested"), "stopped").when(F.col("exit_code") == 0, "finished").otherwise("failed"))


def visible_lines(log: DataFrame) -> DataFrame:
    """What reaches the console: everything of rank 0, only errors of the others."""
    return log.where((F.col("rank") == 0) | (F.col("level") == "ERROR"))


#: Names of the linear modules that adapters go to, and those taken if a model has none of them.
ADAPTED = (
    "q_proj", "k_proj", "v_proj", "o_proj", "gate_proj", "up_proj", "down_proj", "query", "key", "value", "dense", "fc1", "fc2", "wq", "wk", "wv", "wo",
)
ADAPTED_BY_DEFAULT = ("q_proj", "k_proj", "v_proj", "o_proj")


def lora_targets(modules: DataFrame, name: str = "module", linear: str = "is_linear") -> DataFrame:
    """``leaf``: distinct last names of the linear modules that adapters go to, compared without case, or the default ones."""
    leaf = F.element_at(F.split(F.col(name), r"\."), -1)
    own = modules.where(F.col(linear)) if linear in modules.columns else modules
    got = own.select(leaf.alias("leaf")).where(F.lower("leaf").isin(*ADAPTED)).distinct()
    some = got.agg(F.sort_array(F.collect_set("leaf")).alias("s"))  # at most as many as there are spellings of the names
    return some.select(F.explode(F.when(F.size("s") > 0, F.col("s")).otherwise(F.array(*[F.lit(x) for x in ADAPTED_BY_DEFAULT]))).alias("leaf"))


def epoch_loss(losses: DataFrame) -> DataFrame:
    """Mean loss of each epoch; an epoch without a counted batch has 0."""
    got = losses.groupBy("epoch").agg(F.sum("loss").alias("s"), F.count("loss").alias("n"))
    return got.select("epoch", (F.coalesce("s", F.lit(0.0)) / F.greatest(F.col("n"), F.lit(1))).alias("mean_loss"))


def across_ranks(values: DataFrame, key: str = "step") -> DataFrame:
    """What all ranks agree on for each step: the mean value, and whether any of them wants to stop."""
    return values.groupBy(key).agg(F.avg("value").alias("mean_value"), F.bool_or("stop").alias("any_stop"))


def decode_preview(batches: DataFrame, vocabulary: DataFrame, ids: str = "input_ids", mask: str = "attention_mask", key: str = "global_idx") -> DataFrame:
    """Readable text of each sample of a batch: padding cut off by the mask, ids looked up, unknown ids as ``?``, words joined by blanks."""
    real = batches.select(F.col(key).alias("k"), F.slice(F.col(ids), 1, F.aggregate(mask, F.lit(0), lambda a, x: a + x)).alias("x"))
    each = real.select("k", F.posexplode("x").alias("pos", "id")).join(vocabulary.select("id", "word"), "id", "left")
    words = F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("word", F.lit("?")).alias("w")))), lambda s: s["w"])
    return each.groupBy("k").agg(F.array_join(words, " ").alias("preview")).withColumnRenamed("k", key)


def batch_previews(decoded: DataFrame, batch: str = "batch", pos: str = "pos", text: str = "preview") -> DataFrame:
    """``batch, preview, preview_full``: the texts of each batch in order with a rule between, cut to 4,000 and 20,000 characters."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, text))), lambda s: s[text]), "\n\n---\n\n")
    return decoded.groupBy(batch).agg(whole.alias("w")).select(batch, F.substring("w", 1, 4000).alias("preview"), F.substring("w", 1, 20_000).alias("preview_full"))


def merge_sources(records: DataFrame, key: str, order: str, plain: list[str], truthy: list[str] = (), rank: str = "source_rank") -> DataFrame:
    """Last value of each field by key over records of several sources that are merged one after the other.

    Sources of one ``order`` count by ``rank``, the last of them last; null never replaces a value, in ``truthy`` fields zero and empty text don't either.
    """
    return last_known(records.withColumn("_at", F.struct(F.col(order), F.col(rank))), key, "_at", plain, truthy)
