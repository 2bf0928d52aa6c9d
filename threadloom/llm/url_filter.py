"""URL rules with redirect equivalence, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm._store import connected_components

#: Rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What a server sees of a URL: host, path and query. Scheme and fragment don't tell pages apart; null without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)?", 1)
    path = path_of(url)
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (verdict, rule), or null.

    A rule fits its host and every subdomain if the path starts with the rule's. Of equally long rules the one
    with the longer host wins, then allow.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0]))
    out = None
    for verdict, h, p in order:
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        got = F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Alias edges (``src``, ``dst`` URLs) that pages state: canonical links and refresh redirects.

    Targets may be absolute, protocol-relative, root-relative or relative to the page's folder. A page without
    URL, markup or such a tag gives no edge.
    """
    tag = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'>\s]+)"""
    hop = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'>\s]+)"""
    src = pages.select(F.col(url).alias("src"), F.col(html).alias("html")).where(F.col("src").isNotNull() & F.col("html").rlike(r"(?i)canonical|refresh"))
    to = src.select("src", F.explode(F.array(F.regexp_extract("html", tag, 1), F.regexp_extract("html", hop, 1))).alias("to")).where("to != ''")
    to = to.withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    scheme = F.regexp_extract("src", r"^([^:/]*)://", 1)
    base = F.concat(scheme, F.lit("://"), host_of(F.col("src")))
    folder = F.regexp_extract(path_of(F.col("src")), r"(?s)^(.*/)", 1)
    dst = (
        F.when(F.instr("to", "://") > 0, F.col("to"))
        .when(F.startswith("to", F.lit("//")), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.startswith("to", F.lit("/")), F.concat(base, F.col("to")))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), F.col("to")))
    )
    return to.select("src", dst.alias("dst"))


def judge_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Verdict of every row of ``pages``: ``page_id, host, path, rule, verdict, verdict_source``.

    A URL that a rule fits gets that rule's verdict. Else the verdict comes from its class of aliases, the
    connected component over canonical links, refresh redirects and the optional ``redirects`` (``src``, ``dst``):
    allow if a rule allows any alias, else block if a rule blocks one, else allow. Aliases that are no row of
    ``pages`` count too. Repeated rows stay; null URLs have empty host and path and are allowed; an empty table
    gives no row; other columns are ignored.
    """
    links = page_links(pages, url, html)
    if redirects is not None:
        links = links.unionByName(redirects.select("src", "dst"))
    at = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    at = at.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    at = at.withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    comp = connected_components(links.select(node_of(F.col("src")).alias("u"), node_of(F.col("dst")).alias("v")))
    # each alias is judged once, from its own address
    seen = comp.withColumn("full", F.concat(F.lit("x://"), F.col("node")))
    seen = seen.withColumn("own", rule_of(host_of(F.col("full")), path_of(F.col("full")), rules))
    voted = seen.groupBy("component").agg(
        F.max(F.coalesce(F.col("own.verdict") == "allow", F.lit(False))).alias("allowed"),
        F.max(F.coalesce(F.col("own.verdict") == "block", F.lit(False))).alias("blocked"),
    )
    told = comp.join(voted, "component").select("node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("by_alias"))
    # rows that a rule settles, and URLs without a host, look nothing up: a key of their own keeps them from meeting in one partition
    nowhere = F.concat(F.lit("!"), F.xxhash64("page_id", "url").cast("string"))
    out = at.withColumn("node", F.coalesce(F.when(F.col("own").isNull(), node_of(F.col("url"))), nowhere)).join(told, "node", "left")
    return out.select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", "by_alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("by_alias").isNotNull(), "alias").otherwise("default").alias("verdict_source"),
    )
