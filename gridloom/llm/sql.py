"""DuckDB SQL for the queries that SQL can express."""

OP10 = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, replace(text, '\', '\\') AS doubled FROM given
), marked AS (
  SELECT *, length(regexp_replace(doubled, '(<\||\|>|</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1~', 'g')) AS n FROM escaped
), stepped AS (
  SELECT *, lag(role) OVER w AS before, row_number() OVER w - 1 AS pos, lead(role) OVER w IS NULL AS last
  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), judged AS (
  SELECT *, CASE WHEN role = 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN role = 'assistant' THEN before = 'user' WHEN role = 'system' THEN before IS NULL ELSE false END AS ok
  FROM stepped
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<||></s>') + length(role) + n)::BIGINT AS formatted_chars,
  coalesce(bool_and(ok), false) AND coalesce(bool_or(last AND role = 'assistant'), false) AS valid,
  (min(pos) FILTER (NOT ok))::INT AS first_bad
FROM judged GROUP BY conv_id
"""

OP1 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, f.key IS NOT NULL AND k.doc_id <> f.max_doc AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

#: Sources, caps and the queue follow the contract; positions are the closed form of the integrated schedules.
OP2 = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighed AS (SELECT *, rank % 3 + 1 AS weight FROM sources),
-- one round after another, cap every source that is above three times its size
rounds AS (
  SELECT 0 AS round, [rank] AS ranks, rank, source_size, weight, false AS capped FROM weighed
  UNION ALL
  SELECT round + 1, ranks, rank, source_size, weight,
    capped OR weight * (sum(source_size) OVER () - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER ())
      > 3 * source_size * sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()
  FROM rounds WHERE round < (SELECT count(*) FROM weighed)
), ended AS (SELECT * FROM rounds WHERE round = (SELECT max(round) FROM rounds)),
plan AS (
  SELECT w.source, w.rank, w.source_size, CASE WHEN e.capped THEN (3 * w.source_size)::DOUBLE
    ELSE (w.weight * ((SELECT sum(source_size) FROM ended) - (SELECT coalesce(sum(3 * source_size), 0) FROM ended WHERE capped)))::DOUBLE
      / (SELECT sum(weight) FROM ended WHERE NOT capped) END AS target
  FROM weighed w JOIN ended e USING (rank)
), queued AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.rank, md5(s.doc_id::VARCHAR) AS hash,
    CASE WHEN p.source_size > 0 THEN floor(p.target / p.source_size)::INT ELSE 0 END AS epochs,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id ROWS UNBOUNDED PRECEDING) - s.size AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
), fitted AS (
  SELECT *, target - epochs * source_size AS part, before + size <= target - epochs * source_size AND target - epochs * source_size > 0 AS fits FROM queued
), lacking AS (
  SELECT *, part - coalesce(sum(size) FILTER (fits) OVER (PARTITION BY rank), 0) AS lack FROM fitted
), chosen AS (
  SELECT rank, arg_min(doc_id, (abs(size - lack), hash, doc_id)) AS last FROM lacking WHERE NOT fits AND abs(size - lack) < lack GROUP BY rank
), counted AS (
  SELECT l.*, least(epochs + CASE WHEN fits OR c.last IS NOT NULL THEN 1 ELSE 0 END, 3)::INT AS copies
  FROM lacking l LEFT JOIN chosen c ON l.rank = c.rank AND l.doc_id = c.last
)
, shared AS (
  SELECT *, least(before / greatest(target, 1.0::DOUBLE), 1.0::DOUBLE) AS share FROM counted
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies,
  CASE WHEN copies = 0 THEN NULL WHEN share >= 1 THEN 1.0::DOUBLE
    WHEN rank % 3 = 0 THEN least(2 * share / (1.5::DOUBLE + sqrt(greatest(2.25::DOUBLE - 2 * share, 0))), 1.0::DOUBLE)
    WHEN rank % 3 = 1 THEN least(2 * share / (1.0::DOUBLE + sqrt(1.0::DOUBLE)), 1.0::DOUBLE)
    WHEN share < 0.3125 THEN least(2 * share / (0.25::DOUBLE + sqrt(0.0625::DOUBLE + 3 * share)), 0.5::DOUBLE)
    ELSE least(0.5::DOUBLE + 2 * (share - 0.3125::DOUBLE) / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 3 * (share - 0.3125::DOUBLE))), 1.0::DOUBLE) END AS first_position
FROM shared
"""

PII_BASE = r"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
  len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+){3}'), lambda m:
    len(list_filter(string_split(m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR right(p, 3)::INT > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d:
    len(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(len(d)), lambda k:
      (d[len(d) - k])::INT * (1 + k % 2) - CASE WHEN k % 2 = 1 AND (d[len(d) - k])::INT > 4 THEN 9 ELSE 0 END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: len(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM given
"""

#: Shards from 0 with their exact sizes under the law ``rows``, and that slots are gapless; sizes and checksums of all rows.
SHARDING = r"""
WITH rows AS (SELECT (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size FROM documents), total AS (SELECT count(*) AS n, sum(size)::BIGINT AS bytes FROM rows)
SELECT s::INT AS shard, (n // 16 + CASE WHEN s < n % 16 THEN 1 ELSE 0 END)::BIGINT AS n_rows, 0::BIGINT AS first_slot,
  (n // 16 + CASE WHEN s < n % 16 THEN 1 ELSE 0 END - 1)::BIGINT AS last_slot, (n // 16 + CASE WHEN s < n % 16 THEN 1 ELSE 0 END)::BIGINT AS n_slots, bytes AS all_bytes
FROM total, range(0, 16) AS r(s) WHERE n // 16 + CASE WHEN s < n % 16 THEN 1 ELSE 0 END > 0
"""

ORACLES = {"pii_base_counts": PII_BASE, "sharding_sizes": SHARDING, "op1_line_dedup": OP1, "op2_mixing": OP2, "op10_chat": OP10}
