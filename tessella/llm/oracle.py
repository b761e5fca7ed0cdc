"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tessella.llm import quality as q
from tessella.llm import shares as q2


def _top(groups: str, keys: str, n: int, out: str) -> str:
    return f"""WITH each AS (SELECT {keys}, edit_id, MAX(added) AS added FROM ({groups}) WHERE added IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY {keys} ORDER BY added DESC, edit_id) AS INTEGER) AS rank_in_group FROM each)
SELECT {out} FROM ranked WHERE rank_in_group <= {n}"""


_P6 = {"menu_page_id": "menuitem", "cityName": "wikipedia"}


def _p6_share(field: str, table: str) -> str:
    return f"""SELECT '{field}' AS field_name, CAST("{field}" AS VARCHAR) AS key_value FROM {table} WHERE "{field}" IS NOT NULL
GROUP BY "{field}" HAVING COUNT(*) * 100 >= (SELECT COUNT("{field}") FROM {table})"""


def _p6_top(field: str, table: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT '{field}' AS field_name, CAST("{field}" AS VARCHAR) AS key_value, COUNT(*) AS n FROM {table}
WHERE "{field}" IS NOT NULL GROUP BY "{field}" ORDER BY n DESC, "{field}" LIMIT {k})"""


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _p9_figures() -> str:
    words = ", ".join(map(_quote, q.WORDS))
    stops = ", ".join(map(_quote, q.STOP))
    return f"""WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_quote(q.INVISIBLE)}, '', 'g') AS t FROM documents),
tokens AS (SELECT doc_id, w, regexp_replace(lower(w), {_quote(q.EDGES)}, '', 'g') AS bare
  FROM (SELECT doc_id, unnest(regexp_extract_all(t, {_quote(q.TOKEN)})) AS w FROM texts)),
flags AS (SELECT doc_id, w, bare, regexp_matches(bare, {_quote(q.PLAIN)}) AS plain,
  list_has_any(string_split_regex(bare, {_quote(q.PIECES)}), [{words}]) AS common FROM tokens),
by_word AS (SELECT doc_id, COUNT(*) AS n_words, SUM(length(w)) AS n_letters, COUNT(*) FILTER (regexp_matches(w, '\\pL')) AS lettered,
  COUNT(*) FILTER (plain) AS plain, COUNT(*) FILTER (plain AND common) AS common, COUNT(DISTINCT CASE WHEN bare IN ({stops}) THEN bare END) AS stops
  FROM flags GROUP BY doc_id),
tops AS (SELECT doc_id, MAX(n) AS top, COUNT(*) AS kinds FROM (SELECT doc_id, bare, COUNT(*) AS n FROM tokens GROUP BY ALL) GROUP BY doc_id),
lines AS (SELECT doc_id, line, regexp_matches(line, {_quote(q.SENTENCE_END)}) AS ends, regexp_matches(line, {_quote(q.BULLET)}) AS bullet,
  regexp_matches(line, {_quote(q.ELLIPSIS_END)}) AS dots, len(regexp_extract_all(line, {_quote(q.TOKEN)})) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\\pZ\\s]')),
by_line AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (ends) AS ends, COUNT(*) FILTER (dots) AS dots, COUNT(*) FILTER (bullet) AS bullets,
  COUNT(*) FILTER (bullet AND NOT ends) AS items, coalesce(SUM(n) FILTER (bullet AND NOT ends), 0) AS item_words FROM lines GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_lines, 0) AS n_lines, coalesce(CAST(n_letters AS DOUBLE) / n_words, 0) AS mean_word_length,
  coalesce(CAST(len(regexp_extract_all(t, {_quote(q.SYMBOLS)})) AS DOUBLE) / n_words, 0) AS symbol_ratio,
  coalesce(CAST(lettered AS DOUBLE) / n_words, 0) AS letter_word_share, coalesce(CAST(plain AS DOUBLE) / n_words, 0) AS plain_word_share,
  coalesce(CAST(common AS DOUBLE) / n_words, 0) AS common_word_share, coalesce(stops, 0) AS n_stop_words, coalesce(CAST(top AS DOUBLE) / n_words, 0) AS top_word_share,
  coalesce(CAST(kinds AS DOUBLE) / n_words, 0) AS distinct_word_share,
  coalesce(CAST(ends AS DOUBLE) / n_lines, 0) AS final_punctuation_share, coalesce(CAST(dots AS DOUBLE) / n_lines, 0) AS ellipsis_line_share,
  coalesce(CAST(bullets AS DOUBLE) / n_lines, 0) AS bullet_line_share, coalesce(CAST(item_words AS DOUBLE) / n_words, 0) AS item_word_share,
  coalesce(CAST(item_words AS DOUBLE) / nullif(items, 0), 0) AS words_per_item
FROM texts LEFT JOIN by_word USING (doc_id) LEFT JOIN tops USING (doc_id) LEFT JOIN by_line USING (doc_id)"""


def _p9_failed(rules: dict[str, str]) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items()) + ")"


def oracle_sql() -> dict[str, str]:
    by_city = "SELECT substr(timestamp, 1, 10) AS edit_day, channel, cityName AS city_name, edit_id, added FROM wikipedia WHERE cityName IS NOT NULL"
    shares = ", ".join(f"({p}::DOUBLE)" for p in q2.SHARES)
    p2 = """SELECT 'price' AS field_name, CAST(menu_page_id AS VARCHAR) AS group_key, price AS value FROM menuitem
UNION ALL SELECT 'menu_page_id', NULL, CAST(menu_page_id AS DOUBLE) FROM menuitem UNION ALL SELECT 'added', channel, CAST(added AS DOUBLE) FROM wikipedia"""
    day, page, edit_day = "strftime(created_at, '%Y-%m-%d')", "CAST(menu_page_id AS VARCHAR)", "substr(timestamp, 1, 10)"
    p4 = " UNION ALL ".join(
        f"""SELECT '{field}' AS field_name, '{grouping}' AS grouping, {d} AS day, {k} AS group_key, COUNT(DISTINCT "{field}") AS n_exact, TRUE AS within
FROM {table} WHERE "{field}" IS NOT NULL GROUP BY 1, 2, 3, 4"""
        for field, grouping, table, d, k in (
            ("id", "day", "menuitem", day, "CAST(NULL AS VARCHAR)"),
            ("id", "page", "menuitem", "CAST(NULL AS VARCHAR)", page),
            ("menu_page_id", "day", "menuitem", day, "CAST(NULL AS VARCHAR)"),
            ("countryName", "day", "wikipedia", edit_day, "CAST(NULL AS VARCHAR)"),
            ("countryName", "channel", "wikipedia", "CAST(NULL AS VARCHAR)", "channel"),
            ("countryName", "day and channel", "wikipedia", edit_day, "channel"),
        )
    )
    months = "strftime(created_at, '%Y-%m')"
    sketched = f"""SELECT 'price by month' AS case_name, {months} AS group_key, price AS value FROM menuitem
UNION ALL SELECT 'pages', NULL, CAST(menu_page_id AS DOUBLE) FROM menuitem UNION ALL SELECT 'added by channel', channel, CAST(added AS DOUBLE) FROM wikipedia
UNION ALL SELECT 'days merged', channel, CAST(added AS DOUBLE) FROM wikipedia
UNION ALL SELECT 'anonymous taken out', channel, CAST(added AS DOUBLE) FROM wikipedia WHERE NOT coalesce("isAnonymous", FALSE)"""
    days = """SELECT DISTINCT 'id' AS field_name, CAST(created_at AS DATE) AS day, CAST(id AS VARCHAR) AS v FROM menuitem WHERE id IS NOT NULL
UNION SELECT 'menu_page_id', CAST(created_at AS DATE), CAST(menu_page_id AS VARCHAR) FROM menuitem WHERE menu_page_id IS NOT NULL
UNION SELECT 'countryName', CAST(substr(timestamp, 1, 10) AS DATE), "countryName" FROM wikipedia WHERE "countryName" IS NOT NULL"""
    overlaps = f"""WITH v AS ({days}), n AS (SELECT field_name, day, COUNT(*) AS n FROM v GROUP BY ALL),
b AS (SELECT x.field_name, x.day, COUNT(*) AS b FROM v x JOIN v y ON x.field_name = y.field_name AND x.v = y.v AND y.day = x.day + 1 GROUP BY ALL)
SELECT n.field_name, COUNT(*) AS n_pairs, CAST(SUM(n.n + m.n - coalesce(b.b, 0)) AS BIGINT) AS sum_union, CAST(SUM(coalesce(b.b, 0)) AS BIGINT) AS sum_both, TRUE AS as_stated
FROM n JOIN n m ON n.field_name = m.field_name AND m.day = n.day + 1 LEFT JOIN b ON b.field_name = n.field_name AND b.day = n.day GROUP BY n.field_name"""
    figures = f"SELECT * FROM ({_p9_figures()})"
    return {
        "p2_checked": f"""SELECT field_name, group_key, share, COUNT(*) AS n_exact, TRUE AS within FROM ({p2}), (VALUES {shares}) AS s(share)
WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2, 3""",
        "p2_sketched": f"""SELECT case_name, group_key, share, COUNT(*) AS n_exact, TRUE AS within, TRUE AS sketched FROM ({sketched}), (VALUES {shares}) AS s(share)
WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY 1, 2, 3""",
        "p4_checked": p4,
        "p4_sketched": f"""SELECT field_name, "grouping", COUNT(*) AS n_groups, CAST(SUM(n_exact) AS BIGINT) AS n_exact, TRUE AS sketched, TRUE AS as_stated FROM ({p4}) GROUP BY 1, 2""",
        "p4_overlaps_checked": overlaps,
        "p8_checked": """SELECT t.source, COUNT(d.doc_id) FILTER (length(d.text) > 0) AS n_documents, TRUE AS near_share, TRUE AS repeats_kept
FROM source_targets t LEFT JOIN documents d ON d.source = t.source AND t.target_share > 0 AND coalesce(t.max_repeats, 1) > 0 GROUP BY t.source""",
        "p9_figures": f"SELECT *, {_p9_failed({**q.PUBLISHED, **q.RUNNING})} AS failed FROM ({figures})",
        "p9_found": f"SELECT doc_id FROM ({figures}) WHERE {_p9_failed(q.RUNNING)} <> ''",
        "p5_found": _top(by_city, "edit_day, channel, city_name", 3, "edit_day, channel, city_name, edit_id"),
        "p5_by_channel": _top("SELECT channel, edit_id, added FROM wikipedia", "channel", 100, "channel, edit_id, added, rank_in_group"),
        "p6_found": " UNION ALL ".join(_p6_share(f, t) for f, t in _P6.items()),
        "p6_top_200": " UNION ALL ".join(_p6_top(f, t, 200) for f, t in _P6.items()),
    }
