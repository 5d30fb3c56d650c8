"""SQL for the queries that SQL can express, in DuckDB's dialect. It follows the contracts, not the operators."""

from __future__ import annotations

from . import chat, quality

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_TEST_WORDS = rf"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_POSITIONS = "LATERAL (SELECT unnest(range(1, {} + 1)) AS i)"


def _quality() -> str:
    rules = {r: (top, bottom, strict, lenient) for r, (top, bottom, strict, lenient) in quality.SOFT.items()}
    over = lambda r, limit: f"({rules[r][1]} > 0 AND {rules[r][0]} > CAST({rules[r][2 + limit]} AS DOUBLE) * {rules[r][1]})"
    fails = ", ".join(f"CAST(count(*) FILTER ({over(r, 0)}) AS DOUBLE) AS f_{r}" for r in rules)
    sums = ", ".join(f"sum(f_{r}) AS s_{r}, sum(f_{r} * f_{r} / n) AS q_{r}" for r in rules)
    between = {r: f"(q_{r} - s_{r} * s_{r} / total - (hosts - 1) * (s_{r} / total) * (1 - s_{r} / total)) / nullif(total - squares / total, 0)" for r in rules}
    weights = ", ".join(f"CASE WHEN {b} > 0 THEN least({quality.MOST_PRIOR}, greatest({quality.LEAST_PRIOR}, (s_{r} / total) * (1 - s_{r} / total) / ({b}) - 1)) ELSE {quality.MOST_PRIOR} END AS w_{r}" for r, b in between.items())
    bad = ", ".join(f"(f_{r} + (s_{r} / total) * w_{r}) / (n + w_{r}) >= {quality.BAD_RATE} AS bad_{r}" for r in rules)
    broken = " OR ".join(f"{over(r, 1)} OR ({over(r, 0)} AND bad_{r})" for r in rules)
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY r),
windows AS (SELECT r, i, w[i:i + 4] AS win FROM d, {_POSITIONS.format("greatest(len(w) - 4, 0)")}),
often AS (SELECT r, win FROM windows GROUP BY r, win HAVING count(*) > 1),
repeats AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM windows JOIN often USING (r, win)) GROUP BY r),
m AS (SELECT r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines FROM d LEFT JOIN line_counts USING (r) LEFT JOIN repeats USING (r)),
hosts AS (SELECT source, count(*) AS n, {fails} FROM m GROUP BY source),
t AS (SELECT CAST(count(*) AS DOUBLE) AS hosts, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n * n) AS DOUBLE) AS squares, {sums} FROM hosts),
p AS (SELECT *, {weights} FROM t),
verdicts AS (SELECT source, n, {bad} FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, n AS host_docs,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT ({broken}) AS kept
FROM m JOIN verdicts v ON m.source IS NOT DISTINCT FROM v.source"""


def _chat() -> str:
    controls = "|".join("".join(f"\\{c}" if c in "[]\\" else c for c in x) for x in sorted(chat.CONTROLS, key=len, reverse=True))
    longer = lambda c: rf"length(regexp_replace({c}, '(\\|{controls})', '\1#', 'g'))"
    frame = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in chat.MARKS.items())
    other = f"{len('[ROLE]') + len('[/ROLE]') + len('</s>')} + {longer('role')}"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum({longer('text')} + CASE role {frame} ELSE {other} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


_WARC = """WITH p AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, url, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f"""

_DECONTAMINATION = f"""WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_TEST_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win FROM b, {_POSITIONS.format("greatest(len(w) - 12, 1)")} WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TEST_WORDS} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT r, i, size, array_to_string(w[i:i + size - 1], ' ') AS win FROM d, sizes, {_POSITIONS.format("greatest(len(w) - size + 1, 0)")}),
m AS (SELECT r, i, size, item FROM dw JOIN bw USING (size, win)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM m) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
  coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)"""

_LINES = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
l AS (SELECT r, doc_id, i, l[i] AS line, {_LOWER.format(f"trim(l[i], {_WHITE})")} AS key FROM d, {_POSITIONS.format("len(l)")}),
f AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
j AS (SELECT l.*, coalesce(doc_id IS NULL OR doc_id < keeper, false) AND keeper IS NOT NULL AS gone FROM l LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r, doc_id"""

_SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
windows AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS win FROM d, {_POSITIONS.format("greatest(len(w) - 49, 0)")}),
firsts AS (SELECT win, min(doc_id) AS first FROM windows GROUP BY win),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS i FROM windows JOIN firsts USING (win) WHERE first < doc_id),
words AS (SELECT r, i, w[i] AS word FROM d, {_POSITIONS.format("len(w)")}),
kept AS (SELECT w.r, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS text FROM words w LEFT JOIN gone g ON w.r = g.r AND w.i = g.i GROUP BY w.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""


#: Of pages like those of the provided table, whose main text is their article element; the operator infers it.
_ARTICLES = r"""WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS article FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(article, '</?(?:p|h1|br)>'), lambda x: regexp_replace(replace(regexp_replace(x, '<[^>]+>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g')) AS l FROM p),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(l, lambda x: trim(regexp_replace(x, '[\s\p{Z}]+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t"""
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"""
_LM_BASE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_CRC32} % 10 = 0 AS held_out, list_concat(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), ['']) AS w FROM documents),
tokens AS (SELECT r, doc_id, held_out, unnest(w) AS token FROM d),
counts AS (SELECT token, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY token),
n AS (SELECT CAST(coalesce(sum(c), 0) AS BIGINT) AS n, count(*) AS v FROM counts)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, CAST(round(1000 * sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1))))) AS BIGINT) AS base_milli
FROM tokens LEFT JOIN counts USING (token), n GROUP BY r, doc_id, held_out"""

#: The same water level, and documents in the order of their hashes instead of thresholds on these.
_MIX = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
  CAST('0x' || substr(md5(concat_ws(chr(31), CAST(doc_id AS VARCHAR), source, text)), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS others, row_number() OVER before AS k
  FROM s WINDOW before AS (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, others FROM o WHERE CAST(w AS DOUBLE) * rest / others <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(CAST(w AS DOUBLE) * level.rest / level.others, CAST(3 * source_size AS DOUBLE)) AS target FROM s, level),
c AS (SELECT d.r, d.doc_id, d.size, source_size, target, least(floor(target / nullif(source_size, 0)), 3) AS full_copies,
  sum(size) OVER (PARTITION BY d.source ORDER BY h, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS below FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, copies
FROM (SELECT *, CAST(coalesce(full_copies, 0) + CASE WHEN size > 0 AND target - full_copies * source_size - below >= size / 2.0 THEN 1 WHEN size = 0 AND target - full_copies * source_size > below THEN 1 ELSE 0 END AS BIGINT) AS copies FROM c)"""

def _crc_table() -> list[int]:
    """What a CRC-32 register of one byte becomes after eight bits, by its polynomial."""
    table = list(range(256))
    for _ in range(8):
        table = [c >> 1 ^ (0xEDB88320 if c & 1 else 0) for c in table]
    return table


def _spelling(every: int = 97) -> str:
    """Near words by what is left of them without a code point: of one length at one place, or the word itself."""
    raw = "flatten(list_transform(regexp_extract_all(id || ':' || w, '.'), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {raw}), lambda a, x: xor(CAST({_crc_table()}[(xor(a, x) & 255) + 1] AS BIGINT), a >> 8)), 4294967295)"
    return rf"""WITH RECURSIVE d AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, {_LOWER.format("coalesce(text, '')")} AS t FROM documents),
runs AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(t, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM d) GROUP BY id, w),
h AS (SELECT w, n, {crc} AS h FROM runs),
written AS (SELECT CASE WHEN h % {every} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM h),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS v FROM words, {_POSITIONS.format("length(word)")}),
shorter AS (SELECT DISTINCT l.word, l.n, w.word AS other, w.n AS m FROM less l JOIN words w ON l.v = w.word),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b USING (i, v) WHERE a.word <> b.word UNION ALL SELECT word, other, m FROM shorter UNION ALL SELECT other, word, n FROM shorter),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS k FROM near),
formed AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word AND k = 1),
led AS (SELECT word, coalesce(form, word) AS top, 0 AS steps FROM formed UNION ALL SELECT led.word, f.form, steps + 1 FROM led JOIN formed f ON led.top = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(top, steps) AS root FROM led GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)"""

#: All inner products with the anchors; sums of whole doubles under 2 ** 53 are exact.
_NEGATIVES = """WITH q AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM q a JOIN q b ON a.id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.r, p.k, p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.r, p.k ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON p.r = s.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    """XXH64, piece ids and the lattice have no counterpart in SQL; tests hold those queries against plain versions."""
    return {
        "op1_quality_rules": _quality(), "op2_chat_format": _chat(), "op3_html_extraction": _ARTICLES, "op5_warc": _WARC, "op6_decontamination": _DECONTAMINATION, "op8_line_dedup": _LINES, "op9_substring_dedup": _SUBSTRINGS, "op11_mixing": _MIX, "op12_spelling": _spelling(), "op13_hard_negatives": _NEGATIVES, "lm_base": _LM_BASE,
    }
