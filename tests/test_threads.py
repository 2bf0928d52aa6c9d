"""Hand-worked thread forests, and random ones against a plain walk."""

import random


from threadloom.operators import samples, threads

COLS = "_rowidx long, id string, parent_id string, system string, Benutzer string, Kontext string, Assistentin string"


def forest(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], COLS)


def paths(df):
    return {r["_rowidx"]: (list(r["path"]), r["root"], r["depth"]) for r in threads.chains(df).collect()}


def test_branch_unknown_parent_and_ids(spark):
    rows = [("1", None, "", "u1", "", "a1"), (" 2.0 ", "1.0", "", "u2", "", "a2"), ("3", "1", "", "u3", "", "a3"), ("5", "99", "", "u5", "", "a5"), ("6", "5", "", "u6", "", " ")]
    assert paths(forest(spark, rows)) == {0: (["1"], "1", 0), 1: (["1", "2"], "1", 1), 2: (["1", "3"], "1", 1), 3: (["5"], "5", 0)}


def test_unanswered_ancestor_and_context(spark):
    rows = [("1", "", "sys", "u1", "c1", ""), ("2", "1", "other", "u2", "", "a2"), ("3", "2", "", "", "c3", "a3")]
    got = {r["id"]: r for r in samples.chat_sample(threads.chains(forest(spark, rows))).collect()}
    assert got["2"]["system"] == "sys"
    assert [tuple(t) for t in got["2"]["turns"]] == [("user", "c1\nu1"), ("user", "u2")]
    assert [tuple(t) for t in got["3"]["turns"]] == [("user", "c1\nu1"), ("user", "u2"), ("assistant", "a2")]
    assert got["3"]["target_answer"] == "a3"


def test_repeated_id_and_cycle(spark):
    rows = [("1", "", "", "first", "", "x"), ("1", "", "", "last", "", "y"), ("2", "1", "", "u", "", "z"), ("8", "9", "", "u", "", "p"), ("9", "8", "", "u", "", "q"), ("7", "8", "", "u", "", "r"), ("4", "4", "", "u", "", "s")]
    df = forest(spark, rows)
    got = {r["_rowidx"]: [c["Benutzer"] for c in r["chain"]] for r in threads.chains(df).collect()}
    assert got == {0: ["first"], 1: ["last"], 2: ["last", "u"]}
    assert {r["id"] for r in threads.cyclic_targets(df).collect()} == {"8", "9", "7", "4"}


def test_random_forests(spark):
    rng = random.Random(4)
    rows = [(str(i), str(rng.randrange(i)) if i and rng.random() < 0.8 else "", "", f"u{i}", "", "a" if rng.random() < 0.8 else "") for i in range(120)]
    parent = {r[0]: r[1] for r in rows}
    want = {}
    for i, r in enumerate(rows):
        if r[5]:
            way, x = [], r[0]
            while x:
                way.append(x)
                x = parent[x]
            want[i] = (way[::-1], way[-1], len(way) - 1)
    assert paths(forest(spark, rows)) == want


def test_empty(spark):
    df = forest(spark, [])
    assert threads.chains(df).count() == 0
    assert threads.cyclic_targets(df).count() == 0
