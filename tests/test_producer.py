"""Streaming shards against the batch order, restarts and repeats; sinks."""

import csv
import glob
import json
import random

from pyspark.sql import functions as F

from threadloom.operators import ngrams, samples, shards
from threadloom.sources import sinks, tables
from threadloom.streaming import jobs

SCHEMA = "k long, text string"


def test_stream_gives_the_shards_of_the_batch_job(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30)))) for i in range(1400)]
    out, told, steps = str(tmp_path / "out"), str(tmp_path / "p.json"), []
    listener = jobs.ProgressListener(lambda *a: steps.append(a))
    spark.streams.addListener(listener)
    for a, b in ((0, 500), (500, 1100), (1100, 1400)):  # a new stream each time, as after a restart
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.produce_shards(jobs.follow(spark, str(tmp_path / "in"), SCHEMA, 1), out, str(tmp_path / "cp"), 24, told, shard_size=100, order="k").awaitTermination()
        n = json.loads(open(told).read())
        assert n["seen_samples"] == b and n["num_shards_written"] == n_whole(rows[:b])
    last = spark.createDataFrame(rows[1100:], SCHEMA)
    again = jobs.ShardProducer(out, 24, 100, order="k", progress=told)
    again(last, 2)  # the third micro-batch once more
    assert json.loads(open(told).read()) | {"updated_at": 0} == n | {"updated_at": 0}
    meta = again.finish(spark, SCHEMA, {"template_mode": "plain"})
    kept = shards.number_kept(samples.pack_plain(spark.createDataFrame(rows, SCHEMA), 24), ["k"])
    want = {(r["shard_idx"], r["global_idx"], r["k"]) for r in shards.buffered_order(kept, 100).select("shard_idx", "global_idx", "k").collect()}
    got = [(r["shard_idx"], r["global_idx"], r["k"]) for r in spark.read.parquet(f"{out}/shards").select("shard_idx", "global_idx", "k").collect()]
    assert len(got) == len(want) and set(got) == want
    assert (meta["total_samples"], meta["seen_samples"], meta["num_shards"]) == (len(want), 1400, -(-len(want) // 100))
    assert json.loads(open(told).read())["done"] and json.loads(open(f"{out}/producer_done.json").read()) == {"done": True}
    spark.streams.removeListener(listener)


def n_whole(rows):
    kept = sum(0 < len(t.split()) <= 24 for _, t in rows)
    return kept // 512 * 512 // 100


def test_sinks(spark, tmp_path):
    sinks.write_preview(str(tmp_path / "p.json"), "x" * 5000)
    assert {k: len(v) for k, v in json.loads((tmp_path / "p.json").read_text()).items()} == {"preview": 4000, "preview_full": 5000}
    sinks.write_preview(str(tmp_path / "p.json"), None, "y" * 30_000)
    assert {k: len(v) for k, v in json.loads((tmp_path / "p.json").read_text()).items()} == {"preview": 0, "preview_full": 20_000}
    sinks.write_status(str(tmp_path / "s.json"), {"step": 1})
    sinks.write_run_config(str(tmp_path / "run"), {"gradient_checkpointing": True, "max_history_turns": 3}, "cpu", 2, True, True)
    worker, train = (json.loads((tmp_path / "run" / f"{n}_config.json").read_text()) for n in ("worker", "train"))
    assert worker["ddp_static_graph"] is False and train["effective_ddp_enabled"] and train["effective_max_history_turns"] == 3
    sinks.write_template_info(str(tmp_path / "run"), {}, "t", {"pad_token": "<|pad|>"}, "none", 4)
    assert json.loads((tmp_path / "run" / "template_info.json").read_text())["skipped_samples"] == 4
    df = spark.createDataFrame([(1, 'say "hi",\nyou'), (2, None), (3, "")], "a int, b string").coalesce(1)
    path = sinks.import_dataset(df, f"file://{tmp_path}", "org/set:v1")
    assert path.endswith(sinks.import_name("org/set:v1", "train", ["a", "b"])) and "hf_org__set_v1_train_text_" in path
    assert sinks.import_dataset(df.limit(0), f"file://{tmp_path}", "org/set:v1") == path  # what is there stays
    text = open(glob.glob(path.removeprefix("file://") + "/part-*")[0], newline="").read()
    assert text.startswith('"text"') and list(csv.reader(text.splitlines(keepends=True)))[1:] == [['<s>a: 1\nb: say "hi",\nyou</s>'], ["<s>a: 2\nb:</s>"], ["<s>a: 3\nb:</s>"]]
    assert sinks.hardware(spark)["num_cpus"] >= 1


def test_vocabulary_and_progress(spark):
    df = spark.createDataFrame([("a", 7), ("<|System|>", 9)], "token string, id int")
    assert sorted(tuple(r) for r in ngrams.prepare_vocabulary(df).collect()) == sorted([("a", 7), ("<|System|>", 9), ("<|pad|>", 10), ("<|Benutzer|>", 11), ("<|Assistentin|>", 12)])
    assert ngrams.prepare_vocabulary(df, pad=None).count() == 4
    assert ngrams.reported(600, 4000) == [1, 250, 500] and ngrams.reported(600, 300) == [1, 250, 300] and ngrams.reported(0, 5) == []


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("1", "a")], "id string, Assistentin string")
    assert tables.has_column(df, "id") and not tables.has_column(df, "ID2")
    assert tables.is_threaded(df, "chat") and not tables.is_threaded(df, "plain") and not tables.is_threaded(df.drop("id"), "dialogplus")
    for i, text in enumerate(['{"step": 3, "eta": "x"}', '{"step": 4}', "{broken", '{"eta": null, "more": 1}']):
        (tmp_path / f"r{i}.json").write_text(text)
    got = {tuple(r) for r in tables.read_json(spark, f"file://{tmp_path}/*.json", "step int, eta string", {"step": 0, "eta": ""}).collect()}
    assert got == {(3, "x"), (4, ""), (0, "")}
    listed = tables.list_files(spark, f"file://{tmp_path}", ".JSON").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in listed] == ["r0.json", "r1.json", "r2.json", "r3.json"] and listed[0]["size"] == 23
    ngrams.save_state({"version": 4, "tokens": ["ä"]}, str(tmp_path / "state" / "s.json"))
    assert json.loads((tmp_path / "state" / "s.json").read_text()) == {"version": 4, "tokens": ["ä"]}


def test_two_forms_of_conflict(spark):
    rng = random.Random(9)
    v = ["a", "ab", "b", "c", "d", "e f"]
    pairs = [(" ".join(rng.choice(v) for _ in range(rng.randrange(0, 6))), " ".join(rng.choice(v) for _ in range(rng.randrange(0, 6)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(ngrams.conflict(ngrams.gist(F.col("a")), ngrams.gist(F.col("b")), 0.8)).collect()]
    assert got == [ngrams.conflicts(a, b, 0.8) for a, b in pairs]


def test_log_cursor_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(i, f"l{i}") for i in range(20)], "line_id long, line string").write.parquet(str(tmp_path / "log"))
    jobs.log_lines(jobs.follow(spark, str(tmp_path / "log"), "line_id long, line string"), 16).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["line_id"] for r in spark.table("lines").collect()) == [17, 18, 19]
