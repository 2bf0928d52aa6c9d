"""Named queries of the engine over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import control, ngrams, samples, schedule, shards, threads
from threadloom.operators.ordinal import with_ordinal
from threadloom.plans import harness
from threadloom.sources import csv_ranges
from threadloom.sources import tables as S
from threadloom.sources.store import scratch, written
from threadloom.streaming import follow, jobs, status

WINDOW, SHARD = 1024, 200
MINED = ngrams.NgramConfig(use_ngrams=True, max_samples=None, max_tokens_per_text=None)
PLAN = schedule.LrPlan(base=2e-4, total_steps=200, warmup_steps=20, kind="cosine", floor=0.05)

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """Plain texts in order: ``seq`` counts the non-blank ones by doc_id."""
    rows = S.table(spark, d, "documents").select("doc_id", X.norm_text(F.col("text")).alias("text")).where("text != ''")
    return with_ordinal(rows, ["doc_id"])


def _threads(spark: SparkSession, d: str) -> DataFrame:
    return S.thread_rows(S.table(spark, d, "conversations"))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return samples.chat_sample(threads.chains(_threads(spark, d)))


def _ids(c: str, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def plain_pack_lengths(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    return samples.pack_plain(docs, WINDOW).select("doc_id", "seq_len")


def plain_token_ids(spark, d):
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    got = samples.pack_plain(docs, WINDOW)
    return got.select("doc_id", F.md5(_ids("input_ids")).alias("ids_md5"))


def column_scan_lengths(spark, d):
    return S.column_scan(S.table(spark, d, "conversations")).select(F.char_length("text").alias("n")).groupBy("n").agg(F.count("*").alias("rows"))


def csv_documents(spark, d):
    """Documents written as CSV, with all their line ends, commas and quotes, and read again in byte ranges."""
    docs = S.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang"))
    keys, path = ["doc_id", F.md5("text"), "lang"], scratch(spark, "csv")
    docs.repartitionByRange(*keys).sortWithinPartitions(*keys).write.csv(path, header=True, quoteAll=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    got = csv_ranges.read_csv(spark, path)
    return got.select("_rowidx", F.col("doc_id").try_cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.coalesce("lang", F.lit("")).alias("lang"))


def squeezed_text(spark, d):
    return S.table(spark, d, "documents").select("doc_id", F.md5(X.squeeze(F.col("text"))).alias("squeezed_md5"), F.size(X.lines(F.col("text"))).cast("long").alias("n_lines"))


def thread_rows(spark, d):
    return _threads(spark, d).drop("Kontext")


def thread_root_depth(spark, d):
    rows = threads.normalise_rows(_threads(spark, d))
    got = threads.ancestors(threads.last_by_id(rows))
    return got.select("id", F.element_at("path", 1).alias("root"), (F.size("path") - 1).alias("depth"))


def thread_chains(spark, d):
    got = threads.chains(_threads(spark, d))
    return got.select("id", "root", "depth", F.array_join("path", ">").alias("path"), "thread_first")


def example_counts(spark, d):
    chat = threads.candidates(threads.normalise_rows(_threads(spark, d))).agg(F.count("*").alias("n")).select(F.lit("chat").alias("mode"), "n")
    plain = S.column_scan(S.table(spark, d, "documents")).agg(F.count("*").alias("n")).select(F.lit("plain").alias("mode"), "n")
    return chat.unionByName(plain)


def training_texts(spark, d):
    return threads.chains(_threads(spark, d)).select("id", F.md5(threads.training_text()).alias("text_md5"))


def chat_samples(spark, d):
    s = _samples(spark, d)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["content"])), "|")
    return s.select("id", "system", F.size("turns").alias("n_turns"), F.md5(said).alias("turns_md5"), F.md5("target_answer").alias("answer_md5"))


def role_blocks(spark, d):
    c = S.table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.md5(samples.role_block(F.col("role"), F.col("text"))).alias("block_md5"))


def history_cap(spark, d):
    s = _samples(spark, d)
    kept = samples.cap_history(F.col("turns"), 2)
    return s.select("id", F.size(kept).alias("n_kept"), F.array_join(F.transform(kept, lambda t: t["role"]), ",").alias("roles"))


def chat_render(spark, d):
    m = S.messages(S.table(spark, d, "conversations"))
    return m.select("conv_id", F.md5(samples.render(F.col("messages"))).alias("chat_md5"), F.md5(samples.render(F.col("messages"), "plain")).alias("plain_md5"), F.md5(samples.render(F.col("messages"), "instruct", prompt=True)).alias("instruct_md5"))


def role_violations(spark, d):
    m = S.messages(S.table(spark, d, "conversations"))
    return m.agg(F.count("*").alias("n"), F.count_if(~samples.alternates(F.col("messages"))).alias("violations"))


def first_preview(spark, d):
    s = _samples(spark, d).orderBy("thread_first", "depth", "_rowidx").limit(1)
    parts = F.col("system"), F.col("turns"), F.col("target_answer")
    return s.select("id", samples.preview(*parts).alias("preview"), samples.preview(*parts, 20_000).alias("preview_full"))


def all_previews(spark, d):
    parts = F.col("system"), F.col("turns"), F.col("target_answer")
    return _samples(spark, d).select("id", F.md5(samples.preview(*parts, 20_000)).alias("preview_md5"))


def inference_prompts(spark, d):
    m = S.messages(S.table(spark, d, "conversations"))
    got = samples.inference_prompt(samples.conversation_only(F.col("messages")), samples.system_of(F.col("messages")))
    return m.select("conv_id", F.md5(got).alias("prompt_md5"))


def inference_masks(spark, d):
    ids = F.transform(X.token_ids(F.col("text")), lambda x: x % 50)
    c = S.table(spark, d, "conversations").select("conv_id", "turn", ids.alias("ids"))
    return c.select("conv_id", "turn", F.md5(_ids(samples.attention_mask(F.col("ids"), 2, 2, 3), "")).alias("mask_md5"), F.md5(_ids(samples.attention_mask(F.col("ids"), None, 7, None), "")).alias("plain_md5"))


def _packed(spark, d, window=96, **kw):
    return samples.pack_chat(_samples(spark, d), window, **kw)


def pack_whole_turns(spark, d):
    got = _packed(spark, d)
    return got.select("id", "seq_len", "kept_blocks", "masked", F.coalesce("skipped", F.lit("")).alias("skipped_reason"))


def pack_skip_summary(spark, d):
    return _packed(spark, d).groupBy(F.coalesce("skipped", F.lit("packed")).alias("reason")).agg(F.count("*").alias("n"))


def pack_prompt_loss(spark, d):
    got = _packed(spark, d, prompt_loss=True).where("skipped is null")
    return got.select("id", F.size("labels").alias("n_labels"), "masked", F.md5(_ids("labels")).alias("labels_md5"))


def pack_label_digest(spark, d):
    got = _packed(spark, d).where("skipped is null")
    return got.select("id", F.md5(_ids("labels")).alias("labels_md5"), F.md5(_ids("input_ids")).alias("ids_md5"))


def sample_signature(spark, d):
    got = _packed(spark, d, window=256).where("skipped is null")
    return got.select("id", shards.signature(F.col("input_ids"), F.col("labels")).alias("signature"))


def _ordered(spark, d):
    """Plain samples in buffered order, as lengths alone."""
    docs = samples.pack_plain(S.table(spark, d, "documents").select("doc_id", "text"), WINDOW)
    return shards.buffered_order(shards.number_kept(docs.select("doc_id", "seq_len"), ["doc_id"]), SHARD)


def _ordered_samples(spark, d):
    """Plain samples with their ids, written once and named by ``uid``, and their buffered order by it, which no id goes through."""
    docs = samples.pack_plain(S.table(spark, d, "documents").select("doc_id", "text"), WINDOW)
    docs = written(docs.select("doc_id", "seq_len", "input_ids").withColumn("uid", F.monotonically_increasing_id()), "samples")
    ordered = shards.buffered_order(shards.number_kept(docs.select("uid", "doc_id", "seq_len"), ["doc_id"]), SHARD)
    return docs.select("uid", "input_ids", F.col("input_ids").alias("labels")), ordered


def buffered_sort_order(spark, d):
    return _ordered(spark, d).select("doc_id", "seq", "buffer", "global_idx", "shard_idx")


def followed_shards(spark, d):
    """Shards of a streaming producer, read by a following stream that is at work at the same time."""
    out, sink = scratch(spark, "producer"), scratch(spark, "followed")
    docs = S.table(spark, d, "documents").select("doc_id", "text")
    source = jobs.follow(spark, f"{d}/documents.parque[t]", docs.schema)  # a pattern, since a stream takes no single file by its name
    jobs.produce_shards(source, out, scratch(spark, "cp"), WINDOW, shard_size=SHARD, order="doc_id").awaitTermination()
    stream = follow.follow_shards(spark, out, "doc_id long, seq_len int, global_idx long, shard_idx long")
    query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", scratch(spark, "cp")).trigger(processingTime="1 second").start()
    jobs.ShardProducer(out, WINDOW, SHARD, order="doc_id").finish(spark, docs.schema)
    follow.until_done(query, spark, out)
    return spark.read.schema(stream.schema).parquet(sink)


def shard_manifest(spark, d):
    return shards.manifest(_ordered(spark, d), SHARD)


def similarity_sort_order(spark, d):
    """Packed chat samples in thread order, buffers sorted by length, then by signature."""
    got = _packed(spark, d, window=256).where("skipped is null")
    kept = shards.number_kept(got.select("id", "thread_first", "depth", "_rowidx", "seq_len", "input_ids", "labels"), ["thread_first", "depth", "_rowidx"])
    return shards.buffered_order(kept, 100, by_similarity=True).select("id", "seq", "global_idx", "shard_idx")


def shard_write_read(spark, d):
    """The manifest of shards that were written and read again."""
    path = scratch(spark, "shards")
    shards.write_shards(_ordered(spark, d), path)
    return shards.manifest(spark.read.parquet(path).withColumn("shard_idx", F.col("shard_idx").cast("long")), SHARD)


def rank_partition(spark, d):
    got = _ordered(spark, d)
    return shards.of_rank(got, 2, 1, 2, 1).select("global_idx", "doc_id")


def padded_batches(spark, d):
    docs, ordered = _ordered_samples(spark, d)
    got = shards.padded(shards.padded_lengths(ordered, 8, "global_idx").join(docs, "uid"))
    return got.select("global_idx", "batch", "padded_len", F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"), F.size("labels").alias("n_labels"), F.size("input_ids").alias("n_ids"))


def epoch_batches(spark, d):
    """What the second worker of the first of two ranks reads in its third epoch, as padded batches of four."""
    docs, ordered = _ordered_samples(spark, d)
    got = shards.padded(shards.epoch(ordered, world=2, rank=0, batch_size=4, epoch=2, workers=2, worker=1).join(docs, "uid"))
    ones = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return got.select("pos", "batch", "shard_idx", "global_idx", "doc_id", "padded_len", ones.alias("n_real"), F.md5(_ids("input_ids")).alias("ids_md5"), F.md5(_ids("labels")).alias("labels_md5"))


def bucketed_shuffle_hash(spark, d):
    return shards.shuffled_hash(_ordered(spark, d), 42, 0).select("shard_idx", "global_idx", "bucket", "order_in_shard")


def bucketed_shuffle_exact(spark, d):
    return shards.shuffled_exact(_ordered(spark, d), 0)


def _mined(spark, d):
    """Texts to mine; without a limit on their number any name of a text does, so they aren't numbered in order."""
    rows = S.table(spark, d, "documents").select(X.norm_text(F.col("text")).alias("text")).where("text != ''")
    return ngrams.scan(rows.withColumn("seq", F.monotonically_increasing_id()), MINED)


def _raw(spark, d):
    """The same texts as they are; mining strips them where it divides them."""
    return S.table(spark, d, "documents").select("text").withColumn("seq", F.monotonically_increasing_id())


def ngram_counts(spark, d):
    return ngrams.repeated(_raw(spark, d), MINED)


def code_lines(spark, d):
    return ngrams.counts(ngrams.code_lines(_mined(spark, d), MINED), MINED.code_line_min_count)


def code_line_topk(spark, d):
    return code_lines(spark, d).orderBy(F.desc("cnt"), F.desc(F.char_length("phrase")), "phrase").limit(MINED.code_line_top_k)


def phrase_stats(spark, d):
    return ngrams.phrase_stats(_raw(spark, d), MINED, raw=True)


UNTRACKED = replace(MINED, track_saved_samples=False)


def phrase_hits(spark, d):
    return ngrams.phrase_stats(_raw(spark, d), UNTRACKED, raw=True).drop("saved_samples")


def phrase_scores(spark, d):
    return ngrams.phrase_scores(_raw(spark, d), UNTRACKED)


def phrase_scores_saved(spark, d):
    return ngrams.scored(ngrams.phrase_stats(_raw(spark, d), MINED, raw=True), MINED)


def ngram_select(spark, d):
    chosen = ngrams.select_best(phrase_scores_saved(spark, d), MINED)
    return spark.createDataFrame([(i, p, k, s) for i, (p, k, s) in enumerate(chosen)], "rank int, phrase string, kind string, score double")


def phrase_conflicts(spark, d):
    """Conflicting pairs among the kinds of parts, each with two of its neighbours' words; a few dozen phrases."""
    kinds = S.table(spark, d, "part").select(F.lower(F.concat_ws(" ", "p_type", "p_brand", F.lit("of"), "p_type")).alias("phrase")).union(S.table(spark, d, "part").select(F.lower("p_type")))
    top = kinds.distinct().orderBy("phrase").withColumn("g", ngrams.gist(F.col("phrase")))
    pairs = top.join(F.broadcast(top.select(F.col("phrase").alias("other"), F.col("g").alias("h"))), F.col("phrase") < F.col("other"))
    return pairs.where(ngrams.conflict(F.col("g"), F.col("h"), MINED.conflict_overlap_ratio)).select("phrase", "other")


def ngram_tokens(spark, d):
    top = code_line_topk(spark, d).withColumn("pos", F.col("cnt") * 1000)
    return ngrams.tokens_of(top).select("token", "phrase")


def vocabulary_extension(spark, d):
    docs = S.table(spark, d, "nation").select(F.col("n_name").alias("token"), F.col("n_nationkey").cast("long").alias("id"))
    new = S.table(spark, d, "region").select(F.col("r_name").alias("token"), F.col("r_regionkey").alias("pos"))
    both = new.unionByName(docs.select("token", (F.col("id") + 100).cast("int").alias("pos")))
    return ngrams.extend_vocabulary(docs, both)


def tokenizer_preparation(spark, d):
    known = S.table(spark, d, "nation").select(F.when(F.col("n_nationkey") == 3, "<|System|>").otherwise(F.col("n_name")).alias("token"), F.col("n_nationkey").alias("id"))
    return ngrams.prepare_vocabulary(known)


def scan_cap(spark, d):
    return ngrams.scan_count(_docs(spark, d), ngrams.NgramConfig(max_samples=150))


def lr_curve(spark, d):
    return schedule.lr_curve(spark, PLAN).select("step", F.round("scale", 9).alias("scale"))


def lr_running_min(spark, d):
    got = schedule.running_min(schedule.lr_curve(spark, PLAN), PLAN.warmup_steps)
    return got.select("step", F.round(F.col("applied") * 1e6, 6).alias("applied_micro"))


def step_estimate(spark, d):
    n = S.table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("samples"))
    got = schedule.step_estimate(n.withColumns({"world": F.lit(2), "batch": F.lit(1), "accumulation": F.lit(8), "epochs": F.lit(3.0), "max_steps": F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 120)}))
    return got.select("o_orderstatus", "samples", "per_epoch", "steps")


def projected_samples(spark, d):
    e = S.table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("seen"), (F.col("user_id") % 45).alias("tokenized"), F.lit(1000).cast("long").alias("estimate"))
    got = schedule.projected(e.withColumn("total", F.when(F.col("event_id") % 7 == 0, F.col("event_id"))))
    return got.select("event_id", "projected", "source")


def scheduler_extension(spark, d):
    e = S.table(spark, d, "events").select("event_id", F.col("user_id").alias("total"), (F.col("event_id") == 300).alias("done"))
    return schedule.extend_only(e, "event_id").select("event_id", "planned")


def scheduler_updates(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 200).alias("current_steps"), (F.col("o_custkey") % 200 + F.col("o_orderkey") % 7 - 3).alias("proposed_steps"))
    return schedule.min_change(o).select("o_orderkey", F.round("relative_change", 9).alias("relative_change"), "should_update")


def token_throughput(spark, d):
    e = S.table(spark, d, "events").select(F.col("event_id").alias("step"), F.lit(1024).alias("seq"), F.lit(2).alias("batch"), F.lit(8).alias("accumulation"), (F.col("user_id") % 4 + 1).alias("world"))
    return schedule.token_throughput(e).select("step", "tokens_per_step", "tokens_so_far")


def epoch_tail(spark, d):
    e = S.table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 91).alias("batches"), F.lit(8).alias("accumulation"), (F.col("c_custkey") % 2 + 1).alias("world"))
    return schedule.epoch_steps(e).select("c_custkey", "epoch_steps")


def _log(spark, d):
    e = S.table(spark, d, "events")
    return e.select(F.col("event_id").alias("line_id"), F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("line"))


def log_tail(spark, d):
    return control.tail(_log(spark, d))


def log_since(spark, d):
    return control.since(_log(spark, d), 9_800)


def ring_retention(spark, d):
    return control.retained(_log(spark, d))


def visible_lines(spark, d):
    e = S.table(spark, d, "events").select("event_id", (F.col("user_id") % 4).alias("rank"), F.when(F.col("event_type") == "purchase", "ERROR").otherwise("INFO").alias("level"))
    return control.visible_lines(e)


def status_last_non_null(spark, d):
    e = S.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("phase"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 4).alias("step"))
    return control.last_known(e, "user_id", "event_id", ["phase"], ["step"])


def replayed_status(spark, d):
    """Clicks replayed as a stream in order of arrival: each client's last time and last known click, kind and props, late rows included."""
    clicks = S.table(spark, d, "clicks").select("client_id", "ts", "click_id", "kind", "props", "arrived_at")
    path, sink, steps = scratch(spark, "arrivals"), scratch(spark, "status"), 4
    parts = max(steps, int(spark.conf.get("spark.sql.shuffle.partitions")))
    clicks.repartitionByRange(parts, "arrived_at").write.parquet(path)
    merged = status.merge_status(jobs.follow(spark, path, clicks.schema, -(-parts // steps)), "client_id", "ts", ["click_id", "kind", "props"])
    keep = lambda df, i: df.write.mode("overwrite").parquet(f"{sink}/batch={i}")
    merged.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    told = spark.read.schema(merged.schema.add("batch", "long")).parquet(sink)
    last = told.groupBy("client_id").agg(F.max_by(F.struct("ts", "click_id", "kind", "props"), "batch").alias("s")).select("client_id", "s.*")
    return last.select("client_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_ts"), "click_id", "kind", "props")


def ordered_dedup_union(spark, d):
    a = S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"))
    b = S.table(spark, d, "part").select(F.col("p_type").alias("name"))
    c = S.table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"))
    return control.union_in_order([a, b, c], "name")


def latest_valid_model(spark, d):
    o = S.table(spark, d, "orders")
    files = o.select(F.concat(F.lit("models/m"), (F.col("o_custkey") % 50).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "/merged/config.json").when(F.col("o_orderkey") % 3 == 1, "/config.json").otherwise("/notes.txt")).alias("path"), F.col("o_orderkey").alias("mtime"))
    return control.latest_valid(files)


def runs_with_config(spark, d):
    runs = S.table(spark, d, "nation").select(F.col("n_name").alias("run"))
    configs = S.table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("run"), F.concat(F.lit('{"id": '), F.col("n_nationkey").cast("string"), F.lit("}")).alias("config"))
    return control.with_config(runs, configs)


def row_flatten_text(spark, d):
    c = S.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return control.flatten_rows(c).select("c_custkey", "text_flat")


def eta_format(spark, d):
    return S.table(spark, d, "events").select("event_id", X.format_eta(F.col("event_id") * 37 - 50).alias("eta"))


def run_dir_names(spark, d):
    name = F.when(F.col("p_partkey") % 5 > 0, F.concat_ws("/", F.lit("größe_模"), "p_name", "p_brand")).otherwise("")
    at = F.expr("timestamp_ntz'2023-11-14 22:13:20' + make_dt_interval(0, 0, 0, p_partkey)")
    return S.table(spark, d, "part").select("p_partkey", X.run_dir_name(name, at).alias("dir_name"))


def id_normalise(spark, d):
    raw = F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 2 == 0, ".0 ").otherwise(".0.0"))
    return S.table(spark, d, "customer").select("c_custkey", X.normalize_id(raw).alias("norm_id"))


def sampling_clamp(spark, d):
    some = lambda k, c: F.when(F.col("p_partkey") % k > 0, c)
    p = S.table(spark, d, "part").select(
        "p_partkey", some(5, (F.col("p_size") - 10) / 10.0).alias("temperature"), some(7, F.col("p_size") / 40.0).alias("top_p"), some(3, F.col("p_size") - 25).alias("top_k"),
        (F.col("p_size") - 5).alias("max_new_tokens"), some(4, (F.col("p_size") - 3) / 8.0).alias("repetition_penalty"), some(2, F.col("p_size") > 20).alias("do_sample"))
    return control.sanitize_sampling(p).select("p_partkey", "do_sample", "safe_temperature", "safe_top_p", "safe_top_k", "safe_repetition_penalty", "safe_max_new")


def stop_strings(spark, d):
    return S.table(spark, d, "conversations").select("conv_id", "turn", control.stopped(F.col("text"), ["the end", "tion."]).alias("stopped"))


def usage_counts(spark, d):
    c = S.table(spark, d, "conversations").select("conv_id", "turn", X.token_ids(F.col("text")).alias("p"), X.token_ids(F.col("text")).alias("a"))
    return control.usage(c, "conv_id", "turn", "p", "a")


def gpu_lines(spark, d):
    used = F.when(F.col("n_nationkey") == 5, "n/a").otherwise("1024")
    n = S.table(spark, d, "nation").select(F.col("n_regionkey").alias("host"), F.col("n_nationkey").alias("line_no"), F.concat_ws(", ", (F.col("n_nationkey") * 4).cast("string"), F.lit("24576"), used, F.concat(F.lit("GPU "), "n_name")).alias("value"))
    return control.gpu_stats(n)


def pumped_lines(spark, d):
    return control.pumped(S.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))).select("doc_id", F.md5("line").alias("line_md5"))


def record_fields(spark, d):
    e = S.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 11 == 0, "{broken").when(F.col("event_id") % 7 == 0, '{"k": null}').when(F.col("event_id") % 5 == 0, "{}").otherwise(F.col("props")).alias("value"))
    return control.record_fields(e, "k long, name string", {"k": -1, "name": "none"}).select("event_id", F.col("k").cast("long").alias("k"), "name")


def event_times(spark, d):
    e = S.table(spark, d, "events")
    return e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("local"))


def final_states(spark, d):
    o = S.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 == 0).alias("stop_requested"), (F.col("o_custkey") % 3).alias("exit_code"))
    return control.final_state(o).groupBy("state").agg(F.count("*").alias("n"))


def lora_targets(spark, d):
    names = ["q_proj", "K_proj", "lm_head", "dense", "norm", "fc1", "wq", "embed", "down_proj", "value"]
    leaf = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    return control.lora_targets(S.table(spark, d, "part").select(F.concat(F.lit("model.layers."), F.col("p_size").cast("string"), F.lit("."), leaf).alias("module"), (leaf != "dense").alias("is_linear")))


def lora_defaults(spark, d):
    return control.lora_targets(S.table(spark, d, "part").select(F.concat(F.lit("model."), F.replace("p_type", F.lit(" "), F.lit("."))).alias("module")))


def producer_counters(spark, d):
    got = _packed(spark, d)
    return got.agg(F.count("*").alias("seen"), F.count_if(F.col("skipped").isNull()).alias("tokenized"), F.count_if(F.col("skipped").isNotNull()).alias("skipped_n"))


def epoch_losses(spark, d):
    e = S.table(spark, d, "events").select((F.col("event_id") % 10).alias("epoch"), F.when(F.col("event_id") % 3 != 0, (F.col("user_id") % 16) / 8.0).alias("loss"))
    return control.epoch_loss(e).select("epoch", F.round("mean_loss", 9).alias("mean_loss"))


def rank_reduction(spark, d):
    e = S.table(spark, d, "events").select(F.floor(F.col("event_id") / 4).alias("step"), (F.col("user_id") % 64).cast("double").alias("value"), (F.col("user_id") % 9 == 0).alias("stop"))
    return control.across_ranks(e)


def _decoded(spark, d):
    """Texts that went through ids of a vocabulary of all words, each with an id of its own, and back."""
    c = S.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("global_idx"), "conv_id", X.words(F.col("text")).alias("w"))
    vocabulary = with_ordinal(c.select(F.explode("w").alias("word")).distinct(), ["word"], "id")
    coded = c.select("global_idx", "conv_id", F.posexplode("w").alias("pos", "word")).join(vocabulary, "word")
    rows = coded.groupBy("global_idx", "conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda s: s["id"]).alias("ids"))
    b = rows.select("global_idx", "conv_id", F.concat("ids", F.array(F.lit(0).cast("long"))).alias("input_ids"), F.concat(F.transform("ids", lambda x: F.lit(1)), F.array(F.lit(0))).alias("attention_mask"))
    return control.decode_preview(b, vocabulary).select("global_idx", F.floor(F.col("global_idx") / 1000).alias("conv_id"), "preview")


def decode_previews(spark, d):
    return _decoded(spark, d).select("global_idx", F.md5("preview").alias("preview_md5"))


def batch_previews(spark, d):
    got = control.batch_previews(_decoded(spark, d), "conv_id", "global_idx")
    return got.select("conv_id", F.md5("preview").alias("preview_md5"), F.md5("preview_full").alias("full_md5"))


def status_sources(spark, d):
    """Records of three sources an event time, merged in the order of the sources."""
    e = S.table(spark, d, "events").select("user_id", (F.col("event_id") - F.col("event_id") % 3).alias("at"), (F.col("event_id") % 3).alias("source_rank"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("phase"), (F.col("event_id") % 5).alias("step"))
    return control.merge_sources(e, "user_id", "at", ["phase"], ["step"])


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    plain_pack_lengths, plain_token_ids, column_scan_lengths, csv_documents, squeezed_text, thread_rows, thread_root_depth, thread_chains, example_counts,
    training_texts, chat_samples, role_blocks, history_cap, chat_render, role_violations, first_preview, all_previews, inference_prompts, inference_masks, pack_whole_turns,
    pack_skip_summary, pack_prompt_loss, pack_label_digest, sample_signature, buffered_sort_order, followed_shards, shard_manifest, shard_write_read, similarity_sort_order, rank_partition, padded_batches,
    epoch_batches, bucketed_shuffle_hash, bucketed_shuffle_exact, ngram_counts, code_lines, code_line_topk, phrase_stats, phrase_hits, phrase_scores, phrase_scores_saved, ngram_select, phrase_conflicts, ngram_tokens,
    vocabulary_extension, tokenizer_preparation, scan_cap, lr_curve, lr_running_min, step_estimate, projected_samples, scheduler_extension, scheduler_updates, token_throughput, epoch_tail,
    log_tail, log_since, ring_retention, visible_lines, status_last_non_null, replayed_status, ordered_dedup_union, latest_valid_model, runs_with_config,
    row_flatten_text, eta_format, run_dir_names, id_normalise, sampling_clamp, stop_strings, usage_counts, gpu_lines, pumped_lines, record_fields, event_times, final_states, lora_targets, lora_defaults,
    producer_counters, epoch_losses, rank_reduction, decode_previews, batch_previews, status_sources)} | harness.QUERIES
