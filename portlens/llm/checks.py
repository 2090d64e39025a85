"""Check SQL, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

# The word lists and limits of the quality rules.
_MENU = (
    "home", "about", "about us", "contact", "contact us", "login", "log in", "logout", "log out", "sign in", "sign up", "menu", "search", "next",
    "previous", "back", "share", "sitemap", "read more", "skip to content", "subscribe", "help", "faq",
)
_PHRASES = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "cookie settings", "we use cookies", "accept cookies",
    "accept all cookies", "enable javascript", "licensed under", "licenced under", "copyright (c)", "copyright ©", "click here to", "lorem ipsum",
)
_ENDINGS = ".!?:;,)]\"'…”’»。！？"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), spelled AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '{_WORD}') AS words FROM docs
), windows AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM spelled)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), lines AS (
  SELECT r, line, regexp_extract_all(line, '{_WORD}') AS lw FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
), bodies AS (
  SELECT r, line, len(lw) AS n, array_to_string(lw, ' ') AS body, length(array_to_string(lw, '')) AS solid FROM lines WHERE len(lw) > 0
), facts AS (
  SELECT *, length(body) - length(regexp_replace(body, '[!-/:-@\[-`{{-~]', '', 'g')) AS marks,
    length(body) - length(regexp_replace(body, '[|»›•·]', '', 'g')) AS bars FROM bodies
), judged AS (
  SELECT *, (100 * marks > 20 * solid AND solid > 3)
    OR (n >= 12 AND NOT contains({_text(_ENDINGS)}, right(body, 1)))
    OR (bars >= 2 AND 4 * bars >= n - bars)
    OR (n <= 3 AND rtrim(lower(body), '.:!') IN ({", ".join(map(_text, _MENU))}))
    OR {" OR ".join(f"contains(lower(body), {_text(p)})" for p in _PHRASES)} AS fails
  FROM facts
), by_line AS (
  SELECT r, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN fails THEN solid ELSE 0 END) AS lost FROM judged GROUP BY r
), measured AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM spelled LEFT JOIN repeated USING (r) LEFT JOIN by_line USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * lost <= 30 * word_chars AS kept
FROM measured
"""


def _escape(value: str) -> str:
    for mark in ("[INST]", "[/INST]", "<s>", "</s>"):
        value = f"replace({value}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return value


CHAT = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, contains(role || text, '\') AS deep,
    contains(text, '</s>') OR contains(role, '</s>') OR contains(role, ' [/INST]') AS broken FROM turns
), written AS (
  SELECT *, CASE WHEN deep THEN {_escape(r"replace(role || text, '\', '\\')")} WHEN broken THEN {_escape("role")} || {_escape("text")}
    ELSE role || text END AS body FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + length('[INST]  [/INST]</s>'))::BIGINT AS formatted_chars
FROM written GROUP BY conv_id
"""

LINES = """
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), windows AS (
  SELECT r, doc_id, text, i, [lines[i], lines[i + 1], lines[i + 2]] AS w
  FROM (SELECT *, unnest(range(1, len(lines) - 1)) AS i FROM docs)
), later AS (
  SELECT r, i FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, text, i) > 1
), gone AS (
  SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM later
), kept AS (
  SELECT r, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT r, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM docs)
  ANTI JOIN gone USING (r, i) GROUP BY r
), removed AS (
  SELECT r, count(*) AS n FROM gone GROUP BY r
)
SELECT docs.doc_id, CASE WHEN removed.n IS NULL THEN docs.text ELSE coalesce(kept.text, '') END AS text,
  coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(removed.n, 0)::BIGINT AS n_removed
FROM docs LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""

PHRASES = r"""
WITH spelled AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w != '') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), places AS (
  SELECT lang, ws[i] AS x, ws[i + 1] AS y, ws[i + 2] AS z FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM spelled)
), ones AS (
  SELECT lang, x AS g, count(*) AS f FROM places GROUP BY ALL
), twos AS (
  SELECT lang, x || ' ' || y AS g, x, y, count(*) AS f FROM places WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), threes AS (
  SELECT lang, x || ' ' || y || ' ' || z AS g, x, x || ' ' || y AS xy, y || ' ' || z AS yz, z, count(*) AS f FROM places WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), cuts AS (
  SELECT t.lang, t.g, 2 AS k, t.f AS a, 1 AS c, p.f AS l, q.f AS r FROM twos t JOIN ones p ON p.lang = t.lang AND p.g = x JOIN ones q ON q.lang = t.lang AND q.g = y
  UNION ALL
  SELECT t.lang, t.g, 3, t.f, 1, p.f, q.f FROM threes t JOIN ones p ON p.lang = t.lang AND p.g = t.x JOIN twos q ON q.lang = t.lang AND q.g = yz
  UNION ALL
  SELECT t.lang, t.g, 3, t.f, 2, p.f, q.f FROM threes t JOIN twos p ON p.lang = t.lang AND p.g = xy JOIN ones q ON q.lang = t.lang AND q.g = z
), scored AS (
  SELECT *, (1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1
), longer AS (
  SELECT lang, g, max(f) AS most FROM (SELECT lang, xy AS g, f FROM threes UNION ALL SELECT lang, yz, f FROM threes) GROUP BY lang, g
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer m USING (lang, g) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, score FROM kept
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM ones GROUP BY lang
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
LEAKS = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(len(ws), 10) AS k, array_to_string(ws[i:i + 9], ' ') AS w FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT k FROM windows
), places AS (
  SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM docs), sizes WHERE i + k - 1 <= len(ws)
), hits AS (
  SELECT r, places.k, i, item FROM places JOIN windows USING (w) WHERE windows.k = places.k
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, k, i FROM hits)) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

SQL = {"op3_quality": QUALITY, "op9_chat": CHAT, "op10_line_dedup": LINES, "op11_decontaminate": LEAKS, "op13_collocations": PHRASES}
