"""SQL that an independent engine runs against the named queries."""

from __future__ import annotations

from threadloom.functions.text import WS, sql_norm, sql_token, sql_words
from threadloom.operators.ngrams import CODE_PATTERNS, CODE_SYMBOLS
from threadloom.plans import harness
from threadloom.plans.queries import PLAN, SHARD, WINDOW

_DOCS = f"""docs AS (
  SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM (SELECT doc_id, {sql_norm('text')} AS text FROM documents) WHERE text <> '')"""
_PLAIN = f"""docs0 AS (SELECT doc_id, {sql_norm('text')} AS text FROM documents),
plain AS (
  SELECT doc_id, CASE WHEN len(ids) < 2 THEN list_append(ids, 2) ELSE ids END AS ids
  FROM (SELECT doc_id, list_transform({sql_words('text')}, lambda w: {sql_token('w')}) AS ids FROM docs0 WHERE text <> '') WHERE len(ids) <= {WINDOW})"""
_THREADS = """turns AS (
  SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS n0 FROM conversations),
numbered AS (SELECT conv_id, role, text, CASE WHEN role = 'system' AND n0 = 0 THEN 1 ELSE n0 END AS n FROM turns),
rows0 AS (
  SELECT conv_id, CAST(n AS BIGINT) AS n, min(text) FILTER (role = 'system') AS system, min(text) FILTER (role = 'user') AS u, min(text) FILTER (role = 'assistant') AS a
  FROM numbered WHERE n > 0 GROUP BY conv_id, n),
threads AS (
  SELECT row_number() OVER (ORDER BY conv_id, n) - 1 AS _rowidx, CAST(conv_id * 1000 + n AS VARCHAR) AS id,
         CASE WHEN n > 1 THEN CAST(conv_id * 1000 + n - 1 AS VARCHAR) ELSE '' END AS parent_id, coalesce(system, '') AS system, coalesce(u, '') AS u, coalesce(a, '') AS a
  FROM rows0)"""
_NORM = f"norm AS (SELECT _rowidx, id, parent_id, {sql_norm('system')} AS system, {sql_norm('u')} AS u, {sql_norm('a')} AS a FROM threads)"
_PATHS = """paths(id, path) AS (
  SELECT id, [id] FROM norm WHERE parent_id = '' OR parent_id NOT IN (SELECT id FROM norm)
  UNION ALL SELECT c.id, list_append(p.path, c.id) FROM norm c JOIN paths p ON c.parent_id = p.id)"""
_SAMPLES = """steps AS (
  SELECT t.id, t._rowidx, p.path, u.i, r.u, r.a, r.system FROM norm t JOIN paths p ON t.id = p.id, LATERAL (SELECT unnest(p.path) AS sid, generate_subscripts(p.path, 1) AS i) u JOIN norm r ON r.id = u.sid WHERE t.a <> ''),
said AS (
  SELECT id, 2 * i AS k, 'user' AS role, u AS content FROM steps WHERE u <> ''
  UNION ALL SELECT id, 2 * i + 1, 'assistant', a FROM steps WHERE a <> '' AND i < len(path)),
samples AS (
  SELECT t.id, t._rowidx, r.system, t.a AS answer, coalesce(s.roles, []) AS roles, coalesce(s.texts, []) AS texts
  FROM norm t JOIN paths p ON p.id = t.id JOIN norm r ON r.id = p.path[1]
  LEFT JOIN (SELECT id, list(role ORDER BY k) AS roles, list(content ORDER BY k) AS texts FROM said GROUP BY id) s ON s.id = t.id WHERE t.a <> '')"""
_ALL = f"WITH RECURSIVE {_THREADS}, {_NORM}, {_PATHS}, {_SAMPLES}"
_MARK = "CASE {r} WHEN 'system' THEN '<|System|>' WHEN 'user' THEN '<|Benutzer|>' WHEN 'assistant' THEN '<|Assistentin|>' END"


def _block(r: str, c: str) -> str:
    return f"(CASE WHEN {r} IN ('system','user','assistant') THEN {_MARK.format(r=r)} || {sql_norm(c)} || '</s>' ELSE {sql_norm(c)} END)"


def _toks(x: str) -> str:
    return f"list_transform({sql_words(x)}, lambda w: {sql_token('w')})"


def _pack(window: int) -> str:
    """Blocks in reverse, the number kept by running sums: a block stays while everything after it and itself fits."""
    return f"""{_ALL}, blocks AS (
  SELECT id, 0 AS k, {_block("'system'", 'system')} AS b FROM samples WHERE system <> ''
  UNION ALL SELECT id, i, {_block('roles[i]', 'texts[i]')} FROM samples, LATERAL (SELECT unnest(range(1, len(roles) + 1)) AS i) g
  UNION ALL SELECT id, 1000000, '<|Assistentin|>' FROM samples),
tb AS (SELECT id, k, {_toks('b')} AS ids FROM blocks),
ta AS (SELECT id, list_append({_toks('answer')}, 2) AS aids FROM samples),
run AS (
  SELECT tb.id, k, ids, len(ids) AS n, sum(len(ids)) OVER (PARTITION BY tb.id ORDER BY k DESC) + len(aids) AS used, max(len(ids)) OVER (PARTITION BY tb.id) AS longest
  FROM tb JOIN ta ON tb.id = ta.id WHERE len(ids) > 0),
kept AS (
  SELECT id, count(*) FILTER (used <= {window}) AS kept, coalesce(sum(n) FILTER (used <= {window}), 0) AS masked, max(longest) AS longest,
         coalesce(flatten(list(ids ORDER BY k) FILTER (used <= {window})), []) AS prompt FROM run GROUP BY id),
packed AS (
  SELECT ta.id, aids, prompt, kept, masked, CASE WHEN len(aids) > {window} THEN 'answer' WHEN longest > {window} THEN 'block' ELSE '' END AS reason FROM ta JOIN kept ON ta.id = kept.id)"""


_PACK = _pack(96)
_ORDER = f"""{_PLAIN}, kept AS (SELECT doc_id, len(ids) AS seq_len, row_number() OVER (ORDER BY doc_id) - 1 AS seq FROM plain),
ord0 AS (SELECT *, seq // 512 AS buffer FROM kept),
ordered AS (
  SELECT doc_id, seq, seq_len, buffer, buffer * 512 + row_number() OVER (PARTITION BY buffer ORDER BY seq_len, seq) - 1 AS global_idx,
         (buffer * 512 + row_number() OVER (PARTITION BY buffer ORDER BY seq_len, seq) - 1) // {SHARD} AS shard_idx FROM ord0)"""
_SCAN = f"""{_DOCS}, scanned AS (SELECT seq, text, {sql_words('text')} AS w FROM docs)"""
_PHRASES = f"""{_SCAN}, cut AS (SELECT seq, len(w) AS len, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM scanned),
starts AS (SELECT seq, len, list(word) OVER (PARTITION BY seq ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS g FROM cut),
grams AS (SELECT seq, len, array_to_string(g[1:k], ' ') AS phrase FROM starts, (SELECT unnest(range(2, 13)) AS k) ks WHERE k <= len(g)),
ph AS (SELECT seq, phrase, count(*) AS n, first(len) AS len FROM grams WHERE length(phrase) BETWEEN 16 AND 384 AND NOT (starts_with(phrase, '<|ng:') AND ends_with(phrase, '|>')) GROUP BY seq, phrase)"""
_RX = [rx.replace("'", "''") for rx, _ in CODE_PATTERNS]
_DETECT = " OR ".join([f"regexp_matches(phrase, '{CODE_SYMBOLS}')", f"starts_with(phrase, '#')", "starts_with(phrase, '//')"] + [f"regexp_matches(phrase, '{rx}')" for rx in _RX])
_LINES = f"""raw AS (
  SELECT seq, len(w) AS len, unnest(regexp_split_to_array(text, '\\r\\n|[\\x0a-\\x0d\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS raw FROM scanned),
code0 AS (SELECT seq, len, replace(regexp_replace(raw, '{WS}+$', ''), chr(9), '    ') AS phrase FROM raw),
cl AS (SELECT seq, phrase, count(*) AS n, first(len) AS len FROM code0 WHERE length(phrase) BETWEEN 12 AND 384 AND ({_DETECT}) AND NOT (starts_with(phrase, '<|ng:') AND ends_with(phrase, '|>')) GROUP BY seq, phrase)"""
_STATS = f"""{_PHRASES}, {_LINES},
per AS (
  SELECT seq, phrase, sum(pn) AS pn, sum(ln) AS ln, max(len) AS len FROM (
    SELECT seq, phrase, n AS pn, 0 AS ln, len FROM ph UNION ALL SELECT seq, phrase, 0, n, len FROM cl) GROUP BY seq, phrase),
tot AS (
  SELECT phrase, sum(pn) AS p_cnt, sum(ln) AS l_cnt, count(*) FILTER (len > 1024) AS oversize_hits, count(*) FILTER (len >= 921) AS near_limit_hits
  FROM per GROUP BY phrase HAVING sum(pn) >= 2 OR sum(ln) >= 2),
stats AS (
  SELECT tot.phrase, CAST(p_cnt AS BIGINT) AS p_cnt, CAST(l_cnt AS BIGINT) AS l_cnt, oversize_hits, near_limit_hits, CAST(p_cnt + l_cnt AS BIGINT) AS cnt
  FROM tot)"""
# a phrase stands in a text at most as often as its length fits in, which spares most texts the search
_SAVED = f"""big AS (SELECT seq, len(w) AS len, length(text) AS chars FROM scanned WHERE len(w) > 1024),
few AS MATERIALIZED (
  SELECT k.phrase, seq, big.len, len({sql_words('k.phrase')}) - 1 AS gain
  FROM (SELECT phrase FROM stats WHERE oversize_hits > 0) k JOIN per USING (phrase) JOIN big USING (seq)
  WHERE len({sql_words('k.phrase')}) > 1 AND big.len - (len({sql_words('k.phrase')}) - 1) * greatest(1, big.chars // length(k.phrase)) <= 1024),
saved AS (
  SELECT phrase, count(*) AS saved_samples FROM few JOIN scanned USING (seq)
  WHERE few.len - gain * greatest(1, (length(text) - length(replace(text, phrase, ''))) // length(phrase)) <= 1024 GROUP BY phrase)"""
_FACTOR = "CASE " + " ".join(f"WHEN regexp_matches(phrase, '{rx.replace(chr(39), chr(39) * 2)}') THEN CAST({f} AS DOUBLE) * CAST(1.2 AS DOUBLE)" for rx, f in CODE_PATTERNS) + " ELSE 1.0::DOUBLE END"
_CURVE = f"""curve AS (
  SELECT step, CASE WHEN step < {PLAN.warmup_steps} THEN (step + 1)::DOUBLE / {PLAN.warmup_steps}
    ELSE greatest({PLAN.floor}::DOUBLE, 0.5::DOUBLE * (1 + cos(3.141592653589793::DOUBLE * least(1.0::DOUBLE, (step - {PLAN.warmup_steps})::DOUBLE / {PLAN.total_steps - PLAN.warmup_steps})))) END AS scale
  FROM range({PLAN.total_steps + 1}) t(step))"""
_MSGS = "m AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id)"
#: System only in front; users first, third, ... behind it and assistants between; a role that isn't known takes a place and says nothing.
_VALID = "(list_bool_and(list_transform(roles, lambda x, i: NOT (x = 'system' AND i > 1) AND NOT (x = 'user' AND (i + CAST(roles[1] = 'system' AS INTEGER)) % 2 = 0) AND NOT (x = 'assistant' AND (i + CAST(roles[1] = 'system' AS INTEGER)) % 2 = 1))))"
_SAID = "list_transform(list_zip(roles, texts), lambda z: CASE z[1] WHEN 'system' THEN '[SYSTEM]' WHEN 'user' THEN '[USER]' WHEN 'assistant' THEN '[ASSISTANT]' END || chr(10) || z[2] || chr(10))"
_PREVIEW = """array_to_string(list_concat(CASE WHEN system <> '' THEN ['[SYSTEM]' || chr(10) || system] ELSE [] END,
  list_transform(list_zip(roles, texts), lambda z: '[' || upper(z[1]) || ']' || chr(10) || z[2]), ['[TARGET_ASSISTANT]' || chr(10) || answer]), chr(10) || chr(10))"""

ORACLES: dict[str, str] = {
    "plain_pack_lengths": f"WITH {_PLAIN} SELECT doc_id, CAST(len(ids) AS INTEGER) AS seq_len FROM plain",
    "plain_token_ids": f"WITH {_PLAIN} SELECT doc_id, md5(array_to_string(ids, ',')) AS ids_md5 FROM plain",
    "column_scan_lengths": f"SELECT CAST(length(t) AS INTEGER) AS n, count(*) AS rows FROM (SELECT {sql_norm('text')} AS t FROM conversations) WHERE t <> '' GROUP BY 1",
    "squeezed_text": f"""SELECT doc_id, md5({sql_norm(f"regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')")}) AS squeezed_md5,
      CAST(len(regexp_split_to_array(coalesce(text, ''), '\\r\\n|[\\x0a-\\x0d\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) - CASE WHEN regexp_matches(coalesce(text, ''), '[\\x0a-\\x0d\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]$') OR coalesce(text, '') = '' THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM documents""",
    "thread_rows": f"WITH {_THREADS} SELECT _rowidx, id, parent_id, system, u AS Benutzer, a AS Assistentin FROM threads",
    "thread_root_depth": f"WITH RECURSIVE {_THREADS}, {_NORM}, {_PATHS} SELECT id, path[1] AS root, CAST(len(path) - 1 AS INTEGER) AS depth FROM paths",
    "thread_chains": f"""WITH RECURSIVE {_THREADS}, {_NORM}, {_PATHS} SELECT t.id, path[1] AS root, CAST(len(path) - 1 AS INTEGER) AS depth, array_to_string(path, '>') AS path, min(_rowidx) OVER (PARTITION BY path[1]) AS thread_first
      FROM norm t JOIN paths p ON t.id = p.id WHERE a <> ''""",
    "example_counts": f"WITH {_THREADS}, {_NORM} SELECT 'chat' AS mode, count(*) AS n FROM norm WHERE a <> '' UNION ALL SELECT 'plain', count(*) FROM documents WHERE {sql_norm('text')} <> ''",
    "training_texts": f"""{_ALL} SELECT id, md5(array_to_string(list_filter(flatten([[min(system) FILTER (i = 1)], flatten(list([u, a] ORDER BY i))]), lambda x: x <> ''), chr(10))) AS text_md5 FROM steps GROUP BY id""",
    "chat_samples": f"{_ALL} SELECT id, system, CAST(len(roles) AS INTEGER) AS n_turns, md5(array_to_string(list_transform(list_zip(roles, texts), lambda z: z[1] || ':' || z[2]), '|')) AS turns_md5, md5(answer) AS answer_md5 FROM samples",
    "role_blocks": f"SELECT conv_id, turn, md5({_block('role', 'text')}) AS block_md5 FROM conversations",
    "history_cap": f"{_ALL} SELECT id, CAST(least(2, len(roles)) AS INTEGER) AS n_kept, array_to_string(roles[greatest(1, len(roles) - 1):], ',') AS roles FROM samples",
    "chat_render": f"""WITH {_MSGS} SELECT conv_id, CASE WHEN {_VALID} THEN md5(array_to_string(list_transform(list_zip(roles, texts), lambda z: {_block('z[1]', 'z[2]')}), '')) END AS chat_md5,
      md5(array_to_string(list_transform(texts, lambda t: t || chr(10)), '')) AS plain_md5, md5('<s>' || chr(10) || array_to_string({_SAID}, '') || '[ASSISTANT]' || chr(10)) AS instruct_md5 FROM m""",
    "role_violations": f"WITH {_MSGS} SELECT count(*) AS n, count(*) FILTER (NOT {_VALID}) AS violations FROM m",
    "first_preview": f"{_ALL} SELECT id, substr({_PREVIEW}, 1, 4000) AS preview, substr({_PREVIEW}, 1, 20000) AS preview_full FROM samples ORDER BY _rowidx LIMIT 1",
    "inference_prompts": f"""WITH {_MSGS}, h AS (
      SELECT conv_id, list_filter(list_zip(roles, texts), lambda z: z[1] IN ('user', 'assistant')) AS z, list_filter(list_zip(roles, texts), lambda z: z[1] = 'system')[1][2] AS sys FROM m)
      SELECT conv_id, CASE WHEN list_bool_and(list_transform(z, lambda x, i: x[1] = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) THEN
        md5(CASE WHEN coalesce(sys, '') <> '' THEN '<|System|>' || {sql_norm('sys')} || '</s>' ELSE '' END || array_to_string(list_transform(z, lambda x: {_block('x[1]', 'x[2]')}), '') || '<|Assistentin|>') END AS prompt_md5 FROM h""",
    "inference_masks": f"""SELECT conv_id, turn, md5(array_to_string(list_transform({sql_words('text')}, lambda w: CASE WHEN {sql_token('w')} % 50 = 3 THEN 0 ELSE 1 END), '')) AS mask_md5,
      md5(array_to_string(list_transform({sql_words('text')}, lambda w: CASE WHEN {sql_token('w')} % 50 = 7 THEN 0 ELSE 1 END), '')) AS plain_md5 FROM conversations""",
    "pack_whole_turns": f"""{_PACK} SELECT id, CASE WHEN reason = '' THEN CAST(len(aids) + masked AS INTEGER) END AS seq_len, CASE WHEN reason = '' THEN CAST(kept AS INTEGER) END AS kept_blocks,
      CASE WHEN reason = '' THEN CAST(masked AS INTEGER) END AS masked, reason AS skipped_reason FROM packed""",
    "pack_skip_summary": f"{_PACK} SELECT CASE WHEN reason = '' THEN 'packed' ELSE reason END AS reason, count(*) AS n FROM packed GROUP BY 1",
    "pack_prompt_loss": f"{_PACK} SELECT id, CAST(len(prompt) + len(aids) AS INTEGER) AS n_labels, CAST(0 AS INTEGER) AS masked, md5(array_to_string(list_concat(prompt, aids), ',')) AS labels_md5 FROM packed WHERE reason = ''",
    "pack_label_digest": f"""{_PACK} SELECT id, md5(array_to_string(list_concat(list_transform(prompt, lambda x: -100), aids), ',')) AS labels_md5, md5(array_to_string(list_concat(prompt, aids), ',')) AS ids_md5 FROM packed WHERE reason = ''""",
    "sample_signature": f"""{_pack(256)}, e AS (SELECT id, unnest(prompt[1:128]) AS x FROM packed WHERE reason = '')
      SELECT p.id, coalesce(CAST(xor(bit_xor((x * 2654435761) & 4294967295), count(*)) AS BIGINT), 0) AS signature FROM packed p JOIN e ON e.id = p.id WHERE reason = '' GROUP BY p.id""",
    "buffered_sort_order": f"WITH {_ORDER} SELECT doc_id, seq, buffer, global_idx, shard_idx FROM ordered",
    "followed_shards": f"WITH {_ORDER} SELECT doc_id, CAST(seq_len AS INTEGER) AS seq_len, global_idx, shard_idx FROM ordered",
    "shard_manifest": f"WITH {_ORDER} SELECT shard_idx, shard_idx * {SHARD} AS global_start, count(*) AS num_samples FROM ordered GROUP BY shard_idx",
    "rank_partition": f"WITH {_ORDER} SELECT global_idx, doc_id FROM ordered WHERE global_idx % 4 = 3",
    "padded_batches": f"""WITH {_ORDER}, b AS (SELECT global_idx, global_idx // 8 AS batch, seq_len, CAST(ceil(max(seq_len) OVER (PARTITION BY global_idx // 8) / 8.0) * 8 AS INTEGER) AS padded_len FROM ordered)
      SELECT global_idx, batch, padded_len, CAST(seq_len AS INTEGER) AS n_real, padded_len AS n_labels, padded_len AS n_ids FROM b""",
    "bucketed_shuffle_hash": f"""WITH {_ORDER}, b AS (
      SELECT *, (row_number() OVER (PARTITION BY shard_idx ORDER BY seq_len, global_idx) - 1) // greatest(8, least(64, count(*) OVER (PARTITION BY shard_idx))) AS bucket FROM ordered)
      SELECT shard_idx, global_idx, bucket, row_number() OVER (PARTITION BY shard_idx ORDER BY md5(concat_ws(':', '42', '0', shard_idx, bucket)), md5(concat_ws(':', '42', '0', shard_idx, global_idx, bucket)), global_idx) - 1 AS order_in_shard FROM b""",
    "epoch_batches": f"""WITH {_ORDER}, b AS (
      SELECT *, (row_number() OVER (PARTITION BY shard_idx ORDER BY seq_len, global_idx) - 1) // greatest(8, least(64, count(*) OVER (PARTITION BY shard_idx))) AS bucket FROM ordered),
      o AS (SELECT *, row_number() OVER (PARTITION BY shard_idx ORDER BY md5(concat_ws(':', '42', '2', shard_idx, bucket)), md5(concat_ws(':', '42', '2', shard_idx, global_idx, bucket)), global_idx) AS k FROM b),
      r AS (SELECT *, row_number() OVER (ORDER BY shard_idx, k) - 1 AS pos FROM o WHERE global_idx % 4 = 2),
      p AS (SELECT *, pos // 4 AS batch, CAST(ceil(max(seq_len) OVER (PARTITION BY pos // 4) / 8.0) * 8 AS INTEGER) AS padded_len FROM r)
      SELECT pos, batch, shard_idx, global_idx, p.doc_id, padded_len, CAST(seq_len AS INTEGER) AS n_real, md5(array_to_string(list_concat(ids, list_transform(range(seq_len, padded_len), lambda x: 0)), ',')) AS ids_md5,
        md5(array_to_string(list_concat(ids, list_transform(range(seq_len, padded_len), lambda x: -100)), ',')) AS labels_md5 FROM p JOIN plain USING (doc_id)""",
    "ngram_counts": f"WITH {_PHRASES} SELECT phrase, CAST(sum(n) AS BIGINT) AS cnt FROM ph GROUP BY phrase HAVING sum(n) >= 2",
    "code_lines": f"WITH {_SCAN}, {_LINES} SELECT phrase, CAST(sum(n) AS BIGINT) AS cnt FROM cl GROUP BY phrase HAVING sum(n) >= 2",
    "code_line_topk": f"WITH {_SCAN}, {_LINES} SELECT phrase, CAST(sum(n) AS BIGINT) AS cnt FROM cl GROUP BY phrase HAVING sum(n) >= 2 ORDER BY cnt DESC, length(phrase) DESC, phrase LIMIT 400",
    "phrase_hits": f"WITH {_STATS} SELECT * FROM stats",
    "phrase_scores": f"""WITH {_STATS}, s AS (
      SELECT *, CAST((len({sql_words('phrase')}) - 1) * (cnt - 1) AS DOUBLE) AS base FROM stats),
      t AS (SELECT *, base + 4.0::DOUBLE * oversize_hits + 1.5::DOUBLE * near_limit_hits AS score FROM s),
      top AS (SELECT * FROM t WHERE l_cnt >= 2 ORDER BY l_cnt DESC, length(phrase) DESC, phrase LIMIT 400)
      SELECT phrase, 'phrase' AS kind, score FROM t WHERE base > 0 AND p_cnt >= 2 UNION ALL SELECT phrase, 'code', score * 1.35::DOUBLE * ({_FACTOR}) FROM top WHERE base > 0""",
    "ngram_tokens": f"""WITH {_SCAN}, {_LINES}, top AS (SELECT phrase, sum(n) AS cnt FROM cl GROUP BY phrase HAVING sum(n) >= 2 ORDER BY cnt DESC, length(phrase) DESC, phrase LIMIT 400)
      SELECT DISTINCT '<|ng:' || substr(sha1({sql_norm('phrase')}), 1, 16) || '|>' AS token, {sql_norm('phrase')} AS phrase FROM top""",
    "vocabulary_extension": "SELECT r_name AS token, CAST((SELECT max(n_nationkey) FROM nation) + row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS id FROM region",
    "tokenizer_preparation": """SELECT CASE n_nationkey WHEN 3 THEN '<|System|>' ELSE n_name END AS token, CAST(n_nationkey AS BIGINT) AS id FROM nation
      UNION ALL SELECT unnest(['<|pad|>', '<|Benutzer|>', '<|Assistentin|>']), unnest([1, 2, 3]) + (SELECT max(n_nationkey) FROM nation)""",
    "scan_cap": f"SELECT CAST(least(count(*), 151) AS BIGINT) AS scanned_samples FROM documents WHERE {sql_norm('text')} <> ''",
    "lr_curve": f"WITH {_CURVE} SELECT step, round(scale, 9) AS scale FROM curve",
    "lr_running_min": f"""WITH {_CURVE} SELECT step, round(CASE WHEN step >= {PLAN.warmup_steps} THEN min(CASE WHEN step >= {PLAN.warmup_steps} THEN scale * {PLAN.base}::DOUBLE END) OVER (ORDER BY step) ELSE scale * {PLAN.base}::DOUBLE END * 1e6::DOUBLE, 6) AS applied_micro FROM curve""",
    "step_estimate": """WITH e AS (SELECT o_orderstatus, count(*) AS samples, CAST(greatest(1, ceil(ceil(count(*) / 2.0) / 8.0)) AS BIGINT) AS per_epoch FROM orders GROUP BY 1)
      SELECT o_orderstatus, samples, per_epoch, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 120 ELSE CAST(ceil(per_epoch * 3.0) AS BIGINT) END AS steps FROM e""",
    "projected_samples": """WITH p AS (SELECT event_id, user_id % 50 AS seen, user_id % 45 AS tok, CASE WHEN event_id % 7 = 0 THEN event_id END AS total FROM events),
      r AS (SELECT *, CASE WHEN total IS NULL AND seen > 0 AND tok > 0 THEN CAST(round_even(1000.0::DOUBLE * (tok::DOUBLE / seen::DOUBLE), 0) AS BIGINT) ELSE 0 END AS share FROM p)
      SELECT event_id, CAST(greatest(1, CASE WHEN coalesce(total, 0) > 0 THEN total WHEN share > 0 THEN share ELSE 1000 END) AS BIGINT) AS projected,
      CASE WHEN coalesce(total, 0) > 0 THEN 'meta' WHEN share > 0 THEN 'progress' ELSE 'estimate' END AS source FROM r""",
    "scheduler_extension": "SELECT event_id, max(CASE WHEN event_id <= 300 THEN user_id END) OVER (ORDER BY event_id) AS planned FROM events",
    "token_throughput": "SELECT event_id AS step, 1024 * 2 * 8 * (user_id % 4 + 1) AS tokens_per_step, 1024 * 2 * 8 * (user_id % 4 + 1) * event_id AS tokens_so_far FROM events",
    "epoch_tail": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 + 1 > 1 THEN floor((c_custkey % 91) / 8.0) ELSE ceil((c_custkey % 91) / 8.0) END AS BIGINT) AS epoch_steps FROM customer",
    "log_tail": "SELECT event_id AS line_id, event_type || ' ' || user_id AS line FROM events ORDER BY event_id DESC LIMIT 200",
    "log_since": "SELECT event_id AS line_id, event_type || ' ' || user_id AS line FROM events WHERE event_id > greatest(9800, (SELECT max(event_id) - 8000 FROM events))",
    "ring_retention": "SELECT event_id AS line_id, event_type || ' ' || user_id AS line FROM events WHERE event_id > (SELECT max(event_id) - 8000 FROM events)",
    "visible_lines": "SELECT event_id, user_id % 4 AS rank, CASE WHEN event_type = 'purchase' THEN 'ERROR' ELSE 'INFO' END AS level FROM events WHERE user_id % 4 = 0 OR event_type = 'purchase'",
    "status_last_non_null": """SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 3 = 0) AS phase, arg_max(event_id % 4, event_id) FILTER (event_id % 5 <> 0 AND event_id % 4 <> 0) AS step FROM events GROUP BY user_id""",
    "ordered_dedup_union": "SELECT name, CAST(min(p) AS INTEGER) AS priority FROM (SELECT c_mktsegment AS name, 0 AS p FROM customer UNION ALL SELECT p_type, 1 FROM part) GROUP BY name",
    "latest_valid_model": """WITH f AS (SELECT 'models/m' || (o_custkey % 50) AS folder, o_orderkey % 3 = 0 AS merged, o_orderkey AS mtime FROM orders WHERE o_orderkey % 3 < 2)
      SELECT CASE WHEN bool_or(merged) THEN folder || '/merged' ELSE folder END AS model_dir FROM f GROUP BY folder ORDER BY max(mtime) DESC, folder LIMIT 1""",
    "runs_with_config": """SELECT n_name AS run, CASE WHEN n_regionkey = 1 THEN '{"id": ' || n_nationkey || '}' ELSE '{}' END AS config FROM nation""",
    "row_flatten_text": "SELECT c_custkey, '<s>c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_nationkey: ' || c_nationkey || chr(10) || 'c_mktsegment: ' || c_mktsegment || '</s>' AS text_flat FROM customer",
    "eta_format": "SELECT event_id, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS eta FROM (SELECT event_id, greatest(event_id * 37 - 50, 0) AS s FROM events)",
    "run_dir_names": r"""SELECT p_partkey, CASE WHEN p_partkey % 5 > 0 THEN regexp_replace('größe_模/' || p_name || '/' || p_brand, '[^\p{L}\p{N}\-_.]', '_', 'g') ELSE 'model' END || '_' ||
      strftime(TIMESTAMP '2023-11-14 22:13:20' + to_seconds(p_partkey), '%Y-%m-%d_%H-%M-%S') AS dir_name FROM part""",
    "id_normalise": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE c_custkey::VARCHAR || '.0' END AS norm_id FROM customer",
    "sampling_clamp": """WITH p AS (
      SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 > 0 THEN (p_size - 10)::DOUBLE / 10.0::DOUBLE END, 0.0::DOUBLE) AS t, coalesce(CASE WHEN p_partkey % 7 > 0 THEN p_size::DOUBLE / 40.0::DOUBLE END, 1.0::DOUBLE) AS p,
        coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_size - 25 END, 40) AS k, coalesce(CASE WHEN p_partkey % 4 > 0 THEN (p_size - 3)::DOUBLE / 8.0::DOUBLE END, 1.1::DOUBLE) AS rp, p_size - 5 AS n,
        coalesce(CASE WHEN p_partkey % 2 > 0 THEN p_size > 20 END, true) AS wish FROM part)
      SELECT p_partkey, t > 0 AND wish AS do_sample, CASE WHEN t > 0 THEN greatest(t, 1e-5::DOUBLE) ELSE 0.0::DOUBLE END AS safe_temperature, CASE WHEN t > 0 AND p > 0 AND p <= 1 THEN p ELSE 1.0::DOUBLE END AS safe_top_p,
        CAST(CASE WHEN t > 0 THEN greatest(k, 0) ELSE 0 END AS INTEGER) AS safe_top_k, greatest(rp, 0.01::DOUBLE) AS safe_repetition_penalty, CAST(greatest(n, 1) AS INTEGER) AS safe_max_new FROM p""",
    "stop_strings": "SELECT conv_id, turn, contains(text, 'the end') OR contains(text, 'tion.') AS stopped FROM conversations",
    "usage_counts": f"""WITH u AS (SELECT conv_id, turn, len({sql_words('text')}) AS p, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
      SELECT conv_id, CAST(p AS INTEGER) AS prompt_tokens, CAST(p AS INTEGER) AS completion_tokens, CAST(2 * p AS INTEGER) AS total_tokens FROM u WHERE k = 1""",
    "gpu_lines": """SELECT n_regionkey AS host, 'GPU ' || n_name AS name, n_nationkey * 4 AS util, 1024 AS mem_used, 24576 AS mem_total, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INTEGER) AS gpu FROM nation
      WHERE n_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_nationkey = 5)""",
    "final_states": "SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'stopped' WHEN o_custkey % 3 = 0 THEN 'finished' ELSE 'failed' END AS state, count(*) AS n FROM orders GROUP BY 1",
    "lora_targets": """SELECT DISTINCT leaf FROM (SELECT ['q_proj', 'K_proj', 'lm_head', 'dense', 'norm', 'fc1', 'wq', 'embed', 'down_proj', 'value'][p_partkey % 10 + 1] AS leaf FROM part) WHERE leaf IN ('q_proj', 'K_proj', 'fc1', 'wq', 'down_proj', 'value')""",
    "producer_counters": f"{_PACK} SELECT count(*) AS seen, count(*) FILTER (reason = '') AS tokenized, count(*) FILTER (reason <> '') AS skipped_n FROM packed",
    "epoch_losses": "SELECT event_id % 10 AS epoch, round(coalesce(sum((user_id % 16)::DOUBLE / 8.0::DOUBLE) FILTER (event_id % 3 <> 0), 0) / greatest(1, count(*) FILTER (event_id % 3 <> 0)), 9) AS mean_loss FROM events GROUP BY 1",
    "rank_reduction": "SELECT event_id // 4 AS step, avg((user_id % 64)::DOUBLE) AS mean_value, bool_or(user_id % 9 = 0) AS any_stop FROM events GROUP BY 1",
    "decode_previews": f"SELECT conv_id * 1000 + turn AS global_idx, md5(array_to_string({sql_words('text')}, ' ')) AS preview_md5 FROM conversations WHERE len({sql_words('text')}) > 0",
    "all_previews": f"{_ALL} SELECT id, md5(substr({_PREVIEW}, 1, 20000)) AS preview_md5 FROM samples",
    "scheduler_updates": """WITH o AS (SELECT o_orderkey, o_custkey % 200 AS c, o_custkey % 200 + o_orderkey % 7 - 3 AS p FROM orders)
      SELECT o_orderkey, round(abs(p - c)::DOUBLE / greatest(1, c)::DOUBLE, 9) AS relative_change, p <> c AND abs(p - c)::DOUBLE / greatest(1, c)::DOUBLE >= 0.05::DOUBLE AS should_update FROM o""",
    "lora_defaults": "SELECT unnest(['q_proj', 'k_proj', 'v_proj', 'o_proj']) AS leaf",
    "batch_previews": f"""WITH p AS (SELECT conv_id, string_agg(array_to_string({sql_words('text')}, ' '), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn) AS w FROM conversations WHERE len({sql_words('text')}) > 0 GROUP BY conv_id)
      SELECT conv_id, md5(substr(w, 1, 4000)) AS preview_md5, md5(substr(w, 1, 20000)) AS full_md5 FROM p""",
    "csv_documents": """SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, '')), coalesce(lang, '')) - 1 AS _rowidx, doc_id,
      md5(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5, coalesce(lang, '') AS lang FROM documents""",
    "replayed_status": """WITH c AS (SELECT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
        i AS (SELECT client_id, click_id FROM c WHERE click_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, click_id DESC) = 1),
        k AS (SELECT client_id, kind FROM c WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, kind DESC) = 1),
        p AS (SELECT client_id, props FROM c WHERE props IS NOT NULL QUALIFY row_number() OVER (PARTITION BY client_id ORDER BY ts DESC, props DESC) = 1),
        t AS (SELECT client_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts FROM c GROUP BY client_id)
        SELECT client_id, last_ts, click_id, kind, props FROM t LEFT JOIN i USING (client_id) LEFT JOIN k USING (client_id) LEFT JOIN p USING (client_id)""",
    "status_sources": """SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 4 > 0) AS phase, arg_max(event_id % 5, event_id) FILTER (event_id % 5 <> 0) AS step FROM events GROUP BY user_id""",
    "phrase_stats": f"WITH {_STATS}, {_SAVED} SELECT stats.*, coalesce(saved_samples, 0) AS saved_samples FROM stats LEFT JOIN saved USING (phrase)",
    "phrase_scores_saved": f"""WITH {_STATS}, {_SAVED}, s AS (
      SELECT stats.*, coalesce(saved_samples, 0) AS sv, CAST((len({sql_words('phrase')}) - 1) * (cnt - 1) AS DOUBLE) AS base FROM stats LEFT JOIN saved USING (phrase)),
      t AS (SELECT *, base + 4.0::DOUBLE * oversize_hits + 1.5::DOUBLE * near_limit_hits + 8.0::DOUBLE * sv AS score FROM s),
      top AS (SELECT * FROM t WHERE l_cnt >= 2 ORDER BY l_cnt DESC, length(phrase) DESC, phrase LIMIT 400)
      SELECT phrase, 'phrase' AS kind, score FROM t WHERE base > 0 AND p_cnt >= 2 UNION ALL SELECT phrase, 'code', score * 1.35::DOUBLE * ({_FACTOR}) FROM top WHERE base > 0""",
    "shard_write_read": f"WITH {_ORDER} SELECT shard_idx, shard_idx * {SHARD} AS global_start, count(*) AS num_samples FROM ordered GROUP BY shard_idx",
    "similarity_sort_order": f"""{_pack(256)}, e AS (SELECT id, unnest(prompt[1:128]) AS x FROM packed WHERE reason = ''),
      g AS (SELECT id, xor(bit_xor((x * 2654435761) & 4294967295), count(*)) AS sig FROM e GROUP BY id),
      k AS (SELECT p.id, len(aids) + masked AS n, coalesce(sig, 0) AS sig, row_number() OVER (ORDER BY s._rowidx) - 1 AS seq FROM packed p JOIN samples s ON s.id = p.id LEFT JOIN g ON g.id = p.id WHERE reason = ''),
      o AS (SELECT id, seq, seq // 512 * 512 + row_number() OVER (PARTITION BY seq // 512 ORDER BY n, sig, seq) - 1 AS global_idx FROM k)
      SELECT id, seq, global_idx, global_idx // 100 AS shard_idx FROM o""",
    "phrase_conflicts": f"""WITH top AS (SELECT lower(p_type || ' ' || p_brand || ' of ' || p_type) AS phrase FROM part UNION SELECT lower(p_type) FROM part),
      w AS (SELECT phrase, array_to_string({sql_words('phrase')}, ' ') AS j, list_distinct({sql_words('phrase')}) AS b FROM top)
      SELECT x.phrase, y.phrase AS other FROM w x JOIN w y ON x.phrase < y.phrase
      WHERE len(x.b) > 0 AND len(y.b) > 0 AND (contains(x.j, y.j) OR contains(y.j, x.j) OR len(list_intersect(x.b, y.b))::DOUBLE / least(len(x.b), len(y.b)) >= 0.8::DOUBLE)""",
    "pumped_lines": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
      SELECT doc_id, md5(regexp_replace(line, '{WS}+$', '')) AS line_md5 FROM l WHERE line <> ''""",
    "record_fields": """SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 OR event_id % 5 = 0 THEN -1 ELSE coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) END AS k, 'none' AS name FROM events""",
    "event_times": "SELECT event_id, epoch_us(ts) AS micros, strftime(ts, '%Y-%m-%d %H:%M:%S') AS local FROM events",
} | harness.ORACLES
