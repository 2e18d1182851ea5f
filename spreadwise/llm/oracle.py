"""DuckDB SQL of the operators that SQL can express, over the same whole tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ALNUM = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP1 = f"""WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win SEMI JOIN again USING (h)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS x FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP10 = f"""WITH d AS (SELECT doc_id, {ALNUM} AS ws FROM documents), b AS (SELECT item_id, {ALNUM} AS ws FROM benchmark),
item AS (SELECT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS h
    FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM item),
win AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS h
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, win.n, i, item_id FROM win JOIN item ON win.n = item.n AND win.h = item.h),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS t
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

# crc32 of an ASCII string, bit by bit; repairs walk the finite automaton of (s?(ua)+)?: 0 nothing, 1 s, 2 u, 3 a
_CRC = ("xor(list_reduce(list_prepend(4294967295::UBIGINT, [ord(c)::UBIGINT for c in string_split({0}, '')]), lambda acc, b: list_reduce(list_prepend("
        "xor(acc, b), [0::UBIGINT for i in range(8)]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END)), 4294967295::UBIGINT)")
OP11 = f"""WITH RECURSIVE base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT conv_id, turn, role, text, {_CRC.format('k')} % 20 AS k FROM base),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE k <> 0),
numbered AS (SELECT conv_id, turn, role, text, row_number() OVER c AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
    left(lag(role) OVER c, 1) || left(role, 1) AS pair FROM damaged
    WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faults AS (SELECT conv_id, turn, role, text, p, pair, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM numbered),
ins(f, t, c, piece, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (0, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []),
    (1, 2, 2, 'I', ['user:']), (1, 3, 4, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 2, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 2, 'I', ['user:'])),
tok(f, x, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
edit(letter, c, x, role) AS (VALUES ('K', 0, '', ''), ('R', 2, 'u', 'user'), ('R', 2, 'a', 'assistant')),
option AS (SELECT ins.f, tok.t, ins.c + edit.c AS c, ins.piece || edit.letter AS piece, ins.lines, tok.x, edit.role
    FROM ins JOIN tok ON tok.f = ins.t JOIN edit ON edit.x IN ('', tok.x)),
walk AS (SELECT conv_id, 0::BIGINT AS p, 0 AS state, struct_pack(cost := 0, audit := '', lines := []::VARCHAR[]) AS best FROM (SELECT DISTINCT conv_id FROM damaged)
  UNION ALL
  SELECT conv_id, p, state, min(best) FROM (
    SELECT w.conv_id, r.p, o.t AS state, struct_pack(cost := w.best.cost + o.c + CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END,
        audit := w.best.audit || o.piece, lines := list_append(w.best.lines || o.lines, CASE WHEN o.role = '' THEN r.role ELSE o.role END || ':' || r.text)) AS best
    FROM walk w JOIN faults r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.p = w.p + 1 AND r.fault NOT IN ('blank', 'duplicate')
    JOIN option o ON o.f = w.state AND (o.role <> '' OR o.x = left(r.role, 1))
    UNION ALL
    SELECT w.conv_id, r.p, w.state, struct_pack(cost := w.best.cost + 3, audit := w.best.audit || 'D', lines := w.best.lines)
    FROM walk w JOIN faults r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.p = w.p + 1) GROUP BY conv_id, p, state),
counts AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM faults GROUP BY conv_id),
done AS (SELECT w.conv_id, min(struct_pack(cost := w.best.cost + i.c, audit := w.best.audit || i.piece, lines := w.best.lines || i.lines)) AS best
    FROM walk w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.p JOIN ins i ON i.f = w.state AND i.t IN (0, 3) GROUP BY w.conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
    coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM e.conv_id"""

OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS ts FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, {ALNUM} AS ts FROM benchmark),
item AS (SELECT DISTINCT q, item_id, t FROM (SELECT q, item_id, unnest(ts) AS t FROM b)),
s AS (SELECT count(*) AS n, CAST(sum(len(ts)) AS BIGINT) AS l FROM d WHERE len(ts) > 0),
p AS (SELECT r, doc_id, t, m, count(*) AS tf FROM (SELECT r, doc_id, unnest(ts) AS t, 50 + (50 * len(ts) * n) // l AS m FROM d, s WHERE len(ts) > 0)
    WHERE t IN (SELECT t FROM item) GROUP BY r, doc_id, t, m),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, n),
score AS (SELECT q, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
    FROM item JOIN w USING (t) JOIN p USING (t) GROUP BY q, item_id, r, doc_id HAVING score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score) WHERE rank <= 50"""

_WINDOWS = ("win AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)), "
            "again AS (SELECT doc_id, h FROM win GROUP BY doc_id, h HAVING count(*) > 1), "
            "rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM win JOIN again USING (doc_id, h)) GROUP BY doc_id)")
QUALITY = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents), {_WINDOWS},
counts AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM w LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts"""
LM = f"""WITH d AS (SELECT doc_id, {_CRC.format("CAST(doc_id AS VARCHAR)")} % 7 = 2 AS held_out, list_append(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS ws FROM documents),
word AS (SELECT doc_id, held_out, unnest(ws) AS x FROM d),
known AS (SELECT x, count(*) AS c FROM word WHERE NOT held_out GROUP BY x),
total AS (SELECT CAST(sum(c) AS BIGINT) AS n, count(*) AS v FROM known)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, max(n) AS train_tokens,
    round(sum(log10((coalesce(c, 0) + 1) / CAST(n + v + 1 AS DOUBLE))), 4) AS base_score
FROM word LEFT JOIN known USING (x), total GROUP BY doc_id, held_out"""
_DIGITS = "regexp_replace({0}, '[^0-9]', '', 'g')"
_LUHN = ("list_sum(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({0}), CAST(i AS INTEGER), 1) AS INTEGER) "
         "ELSE (CAST(substr(reverse({0}), CAST(i AS INTEGER), 1) AS INTEGER) * 2) // 10 + (CAST(substr(reverse({0}), CAST(i AS INTEGER), 1) AS INTEGER) * 2) % 10 END)) % 10 = 0")
PERSONAL = f"""SELECT doc_id, CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
    CAST(len(list_filter(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: TRY_CAST(p AS HUGEINT) IS NULL OR CAST(p AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
    CAST(len(list_filter(list_filter(list_transform(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+'), lambda m: {_DIGITS.format('m')}), lambda m: length(m) BETWEEN 13 AND 19), lambda m: {_LUHN.format('m')})) AS BIGINT) AS n_card,
    CAST(len(list_filter(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]'), lambda m: length({_DIGITS.format('m')}) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""

SQL = {"quality_base_counts": QUALITY, "lm_base_scores": LM, "personal_data_base_counts": PERSONAL, "op13_ranked_search": OP13, "op1_substring_dedup": OP1, "op10_decontaminate": OP10, "op11_conversation_repair": OP11}
