"""Redirect equivalence against union-find, and rules against a plain model."""

import random
import re
import time

from pyspark.sql import functions as F

from threadloom.llm import chat_format, url_filter

PAGE = "page_id long, url string, html string, verdict string, node string, component string"


def split(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else None


def test_alias_chains_hubs_and_allow_over_block(spark):
    rng = random.Random(9)
    hosts = ["a.org", "b.org", "www.example.com", "example.com", "x.example.net", "news.net", "c.io"]
    paths = ["/", "/en/1", "/es/2", "/fr/3", "/p?q=1", "/p?q=2"]
    name = lambda: f"http://{rng.choice(hosts)}{rng.choice(paths)}&n={rng.randrange(60)}" if rng.random() < 0.7 else f"https://s{rng.randrange(90)}.org/p{rng.randrange(3)}"
    canon = '<link rel="canonical" href="{}">'
    rows = []
    for k in range(40):  # a chain of pages, each naming the next
        rows.append((f"http://chain.org/{k}", canon.format(f"/{k + 1}")))
    rows.append(("http://chain.org/40", canon.format("http://news.net/es/9")))
    rows += [(f"http://hub{k}.org/", canon.format("http://hub.org/")) for k in range(300)]  # a hub with a third of all pages
    rows += [("http://hub.org/", canon.format("http://example.com/en/blocked")), ("http://hub7.org/x", canon.format("http://hub7.org/"))]
    rows += [("http://hub8.org/", canon.format("http://www.example.com/en/ok"))]  # allows the whole hub
    rows += [(u := name(), canon.format(name()) if rng.random() < 0.5 else "<p>") for _ in range(400)]
    rows += [(None, canon.format("http://a.org/")), ("nothing", canon.format("http://a.org/")), ("http://lone.org", None), ("http://lone.org", None)]
    df = spark.createDataFrame([(i, u, h, "v", "n", "c") for i, (u, h) in enumerate(rows)], PAGE)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def node(url):
        host, path = split(url)
        query = re.search(r"\?[^#]*", url.split("://", 1)[1][len(host) :])
        return host + (path or "/") + (query[0] if query else "")

    for u, h in rows:
        if u and h and "://" in u and "href" in h:
            to = re.search('href="([^"]*)"', h)[1].replace("&amp;", "&")
            to = to if "://" in to else f"http://{split(u)[0]}{to}"
            parent[find(node(u))] = find(node(to))
    votes = {}
    for x in list(parent):
        r = ruled(*split("x://" + x))
        if r:
            votes.setdefault(find(x), set()).add(r[1])
    want = []
    for i, (u, _) in enumerate(rows):
        host, path = split(u)
        r, verdict = ruled(host, path), "allow"
        if r:
            verdict = r[1]
        elif u and "://" in u and node(u) in parent and votes.get(find(node(u)), set()) == {"block"}:
            verdict = "block"
        want.append((i, host, path, r and r[0], verdict))
    got = url_filter.judge_urls(df)
    assert sorted(tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()) == want
    by = {r["page_id"]: (r["verdict"], r["verdict_source"]) for r in got.collect()}
    assert by[0] == ("block", "alias") and by[41] == ("allow", "alias")  # the chain's far end blocks its start; the hub is allowed over a block
    assert url_filter.judge_urls(df.limit(0)).count() == 0


def test_a_conversation_of_many_turns(spark):
    n = 4000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é</s> "), F.col("id").cast("string"), F.repeat(F.lit(" 🙂w"), 40)).alias("text"))
    began = time.time()
    out = chat_format.format_conversations(df)
    r = out.select(chat_format.loss_texts(F.col("formatted"), F.col("loss_spans")).alias("x"), F.size(chat_format.read_back(F.col("formatted"))).alias("n")).first()
    assert list(r["x"]) == [f"é</s> {i}" + " 🙂w" * 40 for i in range(1, n, 2)] and r["n"] == n
    assert time.time() - began < 30
