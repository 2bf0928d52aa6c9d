"""Queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import chat_format, collocations, line_dedup, media, minhash, packing, piece_transducer, quality, row_pattern, simhash, topk_search, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality.score_documents(docs.select("doc_id", "text", "lang", "source", "n_chars"), model)
    return scored.select("doc_id", "quality_score", "accepted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.digest_documents(_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_digest(line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), window=4096, end_id=1)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, net)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit(said).alias("text")),
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("assistant").alias("role"), F.lit(said).alias("text")),
    )).alias("r")).select("r.*")
    return chat_format.digest(chat_format.format_conversations(rows.unionByName(extra)))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"), k=20, query_modulus=20, scale=64.0)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables hold no pictures, so each vector is drawn as one
    return media.image_copies(media.draw_vectors(_table(spark, sf_dir, "embeddings")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op12_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return row_pattern.digest(row_pattern.match_rows(_table(spark, sf_dir, "clicks"), row_pattern.CLICK_PATTERN))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(_table(spark, sf_dir, "documents"))


#: The control strings of the chat template, with the guards they may hold, for SQL engines without look-around.
_CTRL = r"<~*\|im_(start|sep|part|end)\|>|<~*/?s>|\[~*/?INST\]|<~*</?SYS>>|<~*\|(endoftext|eot_id)\|>"

OP1_SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rhost, rpath) AS (VALUES ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')),
fit AS (
  SELECT h.page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM h JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS verdict_source
FROM h LEFT JOIN (SELECT * FROM fit WHERE k = 1) f ON h.page_id = f.page_id
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (SELECT key FROM often)) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (SELECT key FROM often)), '')) AS kept_sha256
FROM k GROUP BY rid, doc_id
"""

OP8_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (
  SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AND row_number() OVER w > 1 AS joined,
         length(text) + len(regexp_extract_all(text, '{_CTRL}')) AS body, length(role) + len(regexp_extract_all(role, '{_CTRL}')) AS head
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN joined THEN length('<|im_part|>') ELSE head + length('<|im_start|><|im_sep|><|im_end|>') END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


# A run of falling rows ends before the first row that doesn't fall, a run of rising ones likewise. The rows of a match are then known but
# for the last: the row behind the rising run if it is a click of enough cents, else the run's last click, which has the most cents.
OP12_SQL = """
WITH c AS (
  SELECT *, CASE WHEN value IS NOT NULL AND isfinite(value) THEN CAST(floor(100 * value + 0.5) AS BIGINT) END AS cents
  FROM (SELECT DISTINCT * FROM clicks) WHERE client_id IS NOT NULL AND ts IS NOT NULL),
o AS (
  SELECT client_id, click_id, cents, kind, row_number() OVER w AS rn, lag(cents) OVER w AS pc, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 300000000, false) AS soon
  FROM c WINDOW w AS (PARTITION BY client_id ORDER BY ts, click_id)),
f AS (
  SELECT *, coalesce(soon AND cents < pc AND kind <> 'error', false) AS d, coalesce(soon AND cents > pc AND kind <> 'error', false) AS u, coalesce(soon AND cents IS NOT NULL AND kind = 'click', false) AS p FROM o),
g AS (
  SELECT *, coalesce(min(CASE WHEN NOT d THEN rn END) OVER (PARTITION BY client_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1 + max(rn) OVER (PARTITION BY client_id)) AS past_d,
    coalesce(min(CASE WHEN NOT u THEN rn END) OVER (PARTITION BY client_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1 + max(rn) OVER (PARTITION BY client_id)) AS past_u,
    max(CASE WHEN p THEN rn END) OVER (PARTITION BY client_id ORDER BY rn) AS last_p,
    sum(coalesce(cents, 0)) OVER (PARTITION BY client_id ORDER BY rn) AS upto FROM f),
a AS (SELECT client_id, rn, click_id, cents, upto, past_d FROM g WHERE cents IS NOT NULL AND past_d > rn + 1),
b AS (SELECT a.*, h.past_u FROM a JOIN g h ON h.client_id = a.client_id AND h.rn = a.past_d - 1 WHERE h.past_u > a.past_d),
m AS (
  SELECT b.*, CASE WHEN e.p AND e.cents >= b.cents THEN e.rn WHEN i.last_p >= b.past_d + 1 AND k.cents >= b.cents THEN k.rn END AS over
  FROM b LEFT JOIN g e ON e.client_id = b.client_id AND e.rn = b.past_u JOIN g i ON i.client_id = b.client_id AND i.rn = b.past_u - 1
  LEFT JOIN g k ON k.client_id = b.client_id AND k.rn = i.last_p)
SELECT m.client_id, row_number() OVER (PARTITION BY m.client_id ORDER BY m.rn) AS match_no, m.click_id AS first_id, z.click_id AS last_id, z.rn - m.rn + 1 AS n_rows,
  CAST(z.upto - m.upto + m.cents AS BIGINT) AS sum_cents, sha256('A' || repeat('D', m.past_d - m.rn - 1) || repeat('U', z.rn - m.past_d) || 'P') AS labels_sha256
FROM m JOIN g z ON z.client_id = m.client_id AND z.rn = m.over
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) ks(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
cuts AS (
  SELECT lang, k, phrase, f AS a, c, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS left_part, array_to_string(string_split(phrase, ' ')[c + 1:], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, k)) AS c FROM f WHERE k >= 2)),
s AS (
  SELECT x.lang, x.k, x.phrase, x.a, x.c, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * x.a * x.a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = x.left_part JOIN f r ON r.lang = x.lang AND r.phrase = x.right_part),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, part, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS part FROM f WHERE k = 3) GROUP BY ALL),
kept AS (SELECT one.* FROM one LEFT JOIN inside i ON i.lang = one.lang AND i.part = one.phrase WHERE one.k = 3 OR i.f IS NULL OR 100 * i.f < 50 * one.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_line_dedup": op5_line_dedup,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_toxicity": op7_toxicity,
        "op8_chat_format": op8_chat_format,
        "op9_topk_search": op9_topk_search,
        "op10_media": op10_media,
        "op11_simhash": op11_simhash,
        "op12_row_pattern": op12_row_pattern,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op5_line_dedup": OP5_SQL, "op8_chat_format": OP8_SQL, "op9_topk_search": OP9_SQL, "op12_row_pattern": OP12_SQL, "op13_collocations": OP13_SQL}
