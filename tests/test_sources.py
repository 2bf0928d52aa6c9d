"""Readers, sinks, control queries, templates and streams on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from threadloom.operators import control, samples, schedule
from threadloom.plans import dataset
from threadloom.sources import json_files, tables
from threadloom.streaming import jobs


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,parent_id,Benutzer,Assistentin\n1,,"two\nlines, ""quoted""",a\n\n2,1,plain "inside",b,extra\n3\n', encoding="utf-8")
    rows = tables.with_file_order(tables.read_csv(spark, str(path))).orderBy("_rowidx").collect()
    assert [r["_rowidx"] for r in rows] == [0, 1, 2]
    assert rows[0]["Benutzer"] == 'two\nlines, "quoted"' and rows[1]["Benutzer"] == 'plain "inside"' and rows[2]["Assistentin"] is None


def test_build_shards_from_threads_and_text(spark, tmp_path):
    rows = spark.createDataFrame([(0, "1", "", "", "hello there", "", "fine thanks"), (1, "2", "1", "", "more", "", "yes"), (2, "3", "1", "", "x", "", " ")], "_rowidx long, id string, parent_id string, system string, Benutzer string, Kontext string, Assistentin string")
    got = dataset.build_shards(rows, str(tmp_path / "a"), 100, window=32)
    assert [tuple(r) for r in got.collect()] == [(0, 0, 2)]
    plain = spark.createDataFrame([(i, f"w{i} a b") for i in range(5)] + [(9, " ")], "_rowidx long, text string")
    assert [tuple(r) for r in dataset.build_shards(plain, str(tmp_path / "b"), 100, window=32).collect()] == [(0, 0, 5)]


def test_json(tmp_path):
    path = str(tmp_path / "x" / "s.json")
    json_files.atomic_json(path, {"a": 1})
    assert json_files.read_json(path) == {"a": 1} and json_files.read_json(path + "no") is None
    (tmp_path / "bad.json").write_text("{")
    assert json_files.read_json(str(tmp_path / "bad.json")) is None
    assert json_files.coerce_config({"save_dir": "o", "resume": 1, "zzz": 2}, ("output_dir", "resume")) == {"output_dir": "o"}
    c = json_files.normalise_config({"chunk_size": 64, "tokenized_shard_size": 5})
    assert (c["max_seq_length"], c["tokenized_shard_size"], c["max_history_turns"]) == (64, 100, None)
    assert json_files.cache_key({"a": 1, "shuffle": True}) != json_files.cache_key({"a": 1, "shuffle": False})


def test_log_and_flatten(spark):
    log = spark.range(5, 10).select(F.col("id").alias("line_id"))
    since = lambda c: sorted(r[0] for r in control.since(log, c, ring=8000).collect())
    assert (since(3), since(7), since(9)) == ([5, 6, 7, 8, 9], [8, 9], [])
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert [r["text_flat"] for r in control.flatten_rows(df).collect()] == ["<s>a: 1\nb:</s>", "<s>a: 2\nb: x</s>"]


def test_templates(spark):
    m = "array<struct<role:string,content:string>>"
    ok, bad = [("system", "s"), ("user", " u "), ("assistant", "")], [("user", "u"), ("user", "v")]
    rows = spark.createDataFrame([(ok,), (bad,)], f"m {m}").select(
        samples.render(F.col("m")), samples.inference_prompt(samples.conversation_only(F.col("m")), samples.system_of(F.col("m"))), samples.alternates(F.col("m"))).collect()
    assert rows[0][0] == "<|System|>s</s><|Benutzer|>u</s><|Assistentin|></s>" and rows[0][1] == "<|System|>s</s><|Benutzer|>u</s><|Assistentin|>"
    assert rows[1][0] is None and rows[1][2] is False


def test_schedule(spark):
    lr = [r["scale"] for r in schedule.lr_curve(spark, schedule.LrPlan(total_steps=10, warmup_steps=4)).orderBy("step").collect()]
    assert lr[0] == 0.25 and lr[3] == 1.0
    assert abs(schedule.lr_curve(spark, schedule.LrPlan(total_steps=10, floor=0.05)).where("step = 5").first()["scale"] - 0.5) < 1e-12
    df = spark.createDataFrame([(1000, 2, 1, 8, 3.0, m) for m in (None, 0, 7)], "samples int, world int, batch int, accumulation int, epochs double, max_steps int")
    assert [r["steps"] for r in schedule.step_estimate(df).collect()] == [189, 1, 7]
    cases = [(1000, 45, 50, None), (1000, 0, 50, None), (1000, 0, 0, None), (1000, 45, 50, 0), (1000, 45, 50, 33), (1, 1, 5, None), (0, 1, 1, None)]
    p = spark.createDataFrame(cases, "estimate long, tokenized long, seen long, total long")
    assert [tuple(r) for r in schedule.projected(p).select("projected", "source").collect()] == [
        (900, "progress"), (1000, "estimate"), (1000, "estimate"), (1000, "estimate"), (33, "meta"), (1, "estimate"), (1, "estimate")]
    short = [r["scale"] for r in schedule.lr_curve(spark, schedule.LrPlan(total_steps=4, warmup_steps=9, kind="linear")).orderBy("step").collect()]
    assert short[:4] == [1 / 3, 2 / 3, 1.0, 1.0] and short[4] == 0.0
    part = [r["scale"] for r in schedule.lr_curve(spark, schedule.LrPlan(total_steps=10, kind="linear", decay_factor=0.25)).orderBy("step").collect()]
    assert part[:4] == [1.0, 1 - 1 / 3, 1 - 2 / 3, 0.0]  # a span of 2.5 steps is one of 3
    assert schedule.lr_curve(spark, schedule.LrPlan(total_steps=1, warmup_steps=3)).first()["scale"] == 1.0


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a b c"), (2, " "), (3, "d e f g h")], "k long, text string").write.parquet(str(src))
    stream = jobs.follow(spark, str(src), "k long, text string")
    jobs.produce_shards(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 4, str(tmp_path / "p.json")).awaitTermination()
    assert json.loads((tmp_path / "p.json").read_text())["skipped_samples"] == 2
    assert jobs.ShardProducer(str(tmp_path / "out"), 4).finish(spark, "k long, text string")["num_shards"] == 1
    assert spark.read.parquet(str(tmp_path / "out" / "shards")).select("k").collect()[0][0] == 1
    ev = tmp_path / "ev"
    spark.createDataFrame([("r", 1, "x", None), ("r", 2, None, "5"), ("q", 3, "y", None)], "run string, ord long, phase string, step string").write.parquet(str(ev))
    merged = jobs.merge_status(jobs.follow(spark, str(ev), "run string, ord long, phase string, step string"), "run", "ord", ["phase", "step"])
    merged.writeStream.format("memory").queryName("merged").outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("merged").collect()} == {("r", 2, "x", "5"), ("q", 3, "y", None)}


def test_entry_without_the_llm_folder(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("threadloom.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    saved = {k: v for k, v in sys.modules.items() if k == "corpus_pipeline" or k.startswith("threadloom.llm")}
    for k in saved:
        del sys.modules[k]
    import threadloom

    monkeypatch.delattr(threadloom, "llm", raising=False)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    try:
        e = importlib.reload(__spark_entry__)
        assert "pack_whole_turns" in e.queries() and not any(k.startswith("op") and k[2].isdigit() for k in e.queries()) and "pipeline" not in e.oracle_sql()
    finally:
        monkeypatch.undo()
        sys.modules.update(saved)
        importlib.reload(__spark_entry__)


@pytest.mark.parametrize("n", [0, 1, 700])
def test_ordinal(spark, n):
    from threadloom.operators.ordinal import with_ordinal

    df = spark.range(n).select((F.col("id") * 37 % 1001).alias("k"))
    got = {r["k"]: r["seq"] for r in with_ordinal(df, ["k"]).collect()}
    assert got == {k: i for i, k in enumerate(sorted(i * 37 % 1001 for i in range(n)))}
