"""Rules of templates, sampling, mining and previews, with values worked out by hand."""

import random
from collections import Counter

from pyspark.sql import functions as F

from threadloom.functions import text as X
from threadloom.operators import control, ngrams, samples, shards
from threadloom.operators.ordinal import with_ordinal

MSGS = "m array<struct<role:string,content:string>>"


def test_templates(spark):
    rows = [([("system", " s "), ("user", "u"), ("assistant", "a")],), ([("user", "u"), ("tool", "x"), ("user", "v")],), ([("user", "u"), ("user", "v")],), ([("user", "u"), ("system", "s")],), ([],)]
    df = spark.createDataFrame(rows, MSGS).coalesce(1)
    m = F.col("m")
    got = [tuple(r) for r in df.select(samples.render(m, "plain"), samples.render(m, "instruct", prompt=True), samples.render(m, "dialogplus"), samples.alternates(m)).collect()]
    assert got == [
        (" s \nu\na\n", "<s>\n[SYSTEM]\n s \n[USER]\nu\n[ASSISTANT]\na\n[ASSISTANT]\n", "<|System|>s</s><|Benutzer|>u</s><|Assistentin|>a</s>", True),
        ("u\nx\nv\n", "<s>\n[USER]\nu\n[USER]\nv\n[ASSISTANT]\n", "<|Benutzer|>u</s><|Benutzer|>v</s>", True),
        ("u\nv\n", "<s>\n[USER]\nu\n[USER]\nv\n[ASSISTANT]\n", None, False), ("u\ns\n", "<s>\n[USER]\nu\n[SYSTEM]\ns\n[ASSISTANT]\n", None, False), ("", "<s>\n[ASSISTANT]\n", "", True)]


def test_inference_prompt(spark):
    df = spark.createDataFrame([([("user", "u"), ("assistant", " ")], " s "), ([], "s"), ([], None), ([("assistant", "")], " "), ([("assistant", "a")], None)], MSGS + ", s string").coalesce(1)
    got = [r[0] for r in df.select(samples.inference_prompt(F.col("m"), F.col("s"))).collect()]
    assert got == ["<|System|>s</s><|Benutzer|>u</s><|Assistentin|>", "<|System|>s</s><|Assistentin|>", "<|Assistentin|>", "<|Assistentin|>", None]


def test_preview(spark):
    df = spark.createDataFrame([("", [("user", "u")], "a"), ("s", [], "a" * 5000)], "system string, turns array<struct<role:string,content:string>>, answer string").coalesce(1)
    got = [tuple(r) for r in df.select(samples.preview(F.col("system"), F.col("turns"), F.col("answer")), samples.preview(F.col("system"), F.col("turns"), F.col("answer"), 20_000)).collect()]
    assert got[0] == ("[USER]\nu\n\n[TARGET_ASSISTANT]\na",) * 2
    assert got[1][1] == "[SYSTEM]\ns\n\n[TARGET_ASSISTANT]\n" + "a" * 5000 and got[1][0] == got[1][1][:4000]


def test_sampling(spark):
    df = spark.createDataFrame([(None,) * 6, (0.7, 0.0, -1, 0, 0.0, None), (1e-9, 0.5, 3, 9, 1.3, False), (-1.0, 0.5, 3, 9, None, True)], "temperature double, top_p double, top_k int, max_new_tokens int, repetition_penalty double, do_sample boolean").coalesce(1)
    got = [tuple(r) for r in control.sanitize_sampling(df).select("do_sample", "safe_temperature", "safe_top_p", "safe_top_k", "safe_repetition_penalty", "safe_max_new").collect()]
    assert got == [(False, 0.0, 1.0, 0, 1.1, 1), (True, 0.7, 1.0, 0, 0.01, 1), (False, 1e-5, 0.5, 3, 1.3, 9), (False, 0.0, 1.0, 0, 1.1, 9)]


def test_gpus(spark):
    lines = [("a", 1, "37, 24576, 1024, NVIDIA X"), ("a", 2, "0, 24576, 3, NVIDIA Y"), ("b", 1, "n/a, 1, 2, Z"), ("b", 2, "1, 2, 3, Z"), ("c", 1, "1, 2, 3, Z, 4"), ("d", 1, "")]
    got = {tuple(r) for r in control.gpu_stats(spark.createDataFrame(lines, "host string, line_no int, value string")).collect()}
    assert got == {("a", 0, "NVIDIA X", 37, 1024, 24576), ("a", 1, "NVIDIA Y", 0, 3, 24576)}


def test_adapted_modules(spark):
    df = spark.createDataFrame([("a.Q_Proj", True), ("b.q_proj", True), ("c.dense", False), ("c.lm_head", True)], "module string, is_linear boolean")
    assert {r[0] for r in control.lora_targets(df).collect()} == {"Q_Proj", "q_proj"}
    assert [r[0] for r in control.lora_targets(df.where("module like 'c%'")).collect()] == ["q_proj", "k_proj", "v_proj", "o_proj"]
    assert control.lora_targets(df.limit(0)).count() == 4


def test_folder_names(spark):
    df = spark.createDataFrame([("größe/模 1",), ("",), (None,)], "n string").coalesce(1)
    assert [r[0] for r in df.select(X.run_dir_name(F.col("n"), F.expr("timestamp_ntz'2024-02-03 04:05:06'"))).collect()] == ["größe_模_1_2024-02-03_04-05-06", "model_2024-02-03_04-05-06", "model_2024-02-03_04-05-06"]


def test_mining_validity(spark):
    texts = ["    # only a remark here", "# a remark in front", "<|ng:abc def ghi jkl mno", "<|ng:abc def ghi jkl|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    cfg = ngrams.NgramConfig(max_samples=None, max_n=4, min_words=3, min_chars=8)
    lines = {r["phrase"] for r in ngrams.code_lines(ngrams.scan(df, cfg), cfg).collect()}
    assert lines == {"# a remark in front", "<|ng:abc def ghi jkl mno"}  # an indented remark is no code; a prefix alone is no token
    got = {r["phrase"] for r in ngrams.phrases(ngrams.scan(df, cfg), cfg).collect()}
    assert {"<|ng:abc def ghi", "<|ng:abc def ghi jkl"} <= got and "<|ng:abc def ghi jkl|>" not in got
    assert min(len(p.split()) for p in got) == 3


def test_state_totals(spark):
    line = "value = compute(alpha, beta)"
    df = spark.createDataFrame(list(enumerate([line, line, "some other words that repeat", "some other words that repeat"])), "seq long, text string")
    cfg = ngrams.NgramConfig(use_ngrams=True, max_n=4)
    state = ngrams.build_state(spark, df, cfg)
    stats = ngrams.phrase_stats(ngrams.scan(df, cfg), cfg).collect()
    phrases, lines = sum(r["p_cnt"] >= 2 for r in stats), sum(r["l_cnt"] >= 2 for r in stats)
    s = state["stats"]
    assert (s["candidate_count"], s["code_line_candidate_count"]) == (phrases + lines, lines) and lines == 1
    both = {(r["phrase"], r["kind"]): r["score"] for r in ngrams.scored(ngrams.phrase_stats(ngrams.scan(df, cfg), cfg), cfg).collect()}
    assert s["estimated_total_savings"] == sum(both.get((p, "code"), both.get((p, "phrase"))) for p in state["phrases"])
    assert line in state["phrases"] and s["selected_code_line_count"] == 1 and s["estimated_saved_samples"] == 0
    assert (ngrams.NgramConfig().eval_samples, ngrams.NgramConfig().add_batch) == (512, 64)


def test_selection_in_small_batches(spark):
    rng = random.Random(3)
    v = [f"w{i}" for i in range(30)]
    rows = {(" ".join(rng.choice(v) for _ in range(rng.randrange(1, 6))), rng.choice(["phrase", "code"])): float(rng.randrange(1, 9)) for _ in range(400)}
    cand = spark.createDataFrame([(p, k, s) for (p, k), s in rows.items()], "phrase string, kind string, score double")
    for cfg in (ngrams.NgramConfig(target_fit=1.0), ngrams.NgramConfig(top_k=7), ngrams.NgramConfig(target_fit=0.2, prefer_longest_match=False), ngrams.NgramConfig(budgeted=False, top_k=0)):
        long = cfg.prefer_longest_match
        order = sorted(rows, key=lambda x: (-rows[x], *((-len(x[0]), -len(x[0].split())) if long else ()), x[0], x[1] == "code"))
        goal, reached, chosen = cfg.target_fit * sum(rows.values()), 0.0, []
        for p, k in order:
            if any(ngrams.conflicts(p, c, 0.8) for c, _, _ in chosen):
                continue
            chosen.append((p, k, rows[p, k]))
            reached += rows[p, k]
            if len(chosen) >= max(1, cfg.top_k) or cfg.budgeted and reached >= goal:
                break
        assert ngrams.select_best(cand, cfg, batch=16) == chosen
    assert ngrams.select_best(cand.limit(0)) == []


def test_conflicts():
    assert ngrams.conflicts("foo bar", "xfoo barx", 0.8) and ngrams.conflicts("a b", "a b", 0.8)
    assert ngrams.conflicts("a b c d e", "a b c d f", 0.8) and not ngrams.conflicts("a b c d e", "a b c f g", 0.8)
    assert not ngrams.conflicts("", "a", 0.8) and not ngrams.conflicts(" ", " ", 0.0)


def test_exact_shuffle_equals_a_plain_model(spark):
    rng = random.Random(1)
    lengths = [rng.randrange(2, 40) for _ in range(150)]
    df = spark.createDataFrame([(i // 100, i, n) for i, n in enumerate(lengths)], "shard_idx long, global_idx long, seq_len int")
    for epoch in (0, 3):
        got = {(r["shard_idx"], r["global_idx"]): r["order_in_shard"] for r in shards.shuffled_exact(df, epoch).collect()}
        for shard, ids in ((0, range(100)), (1, range(100, 150))):
            draw = random.Random((epoch + 1) * 1_000_003 + shard)
            left, groups = sorted(ids, key=lambda i: (lengths[i], i)), []
            while left:
                groups.append(left[: min(64, max(8, len(ids)))])
                del left[: len(groups[-1])]
            for g in groups:
                draw.shuffle(g)
            draw.shuffle(groups)
            assert [i for g in groups for i in g] == sorted(ids, key=lambda i: got[shard, i])


def test_positions_of_repeated_keys(spark):
    rng = random.Random(2)
    keys = [7] * 3000 + [rng.randrange(100) for _ in range(3000)] + [None] * 5
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int").repartition(5)
    rows = sorted(with_ordinal(df, ["k"]).collect(), key=lambda r: r["seq"])
    assert [r["seq"] for r in rows] == list(range(len(keys))) and Counter(r["i"] for r in rows).most_common(1)[0][1] == 1
    assert [r["k"] for r in rows] == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert with_ordinal(df.limit(0), ["k"]).count() == 0
