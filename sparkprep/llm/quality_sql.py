"""The quality query as DuckDB SQL: written from the rule, with its numbers spelled out, not from the operator's parameters."""

from __future__ import annotations

RATES = """symbol_rate n_symbols n_words 10000 16
bang_rate n_bangs n_words 10000 16
upper_rate n_upper word_chars 10000 16
dup_line_rate n_dup_lines n_lines 10000 5
repeat_rate n_repeat_words n_words 60000 16"""


def quality_sql() -> str:
    rules = [x.split() for x in RATES.splitlines()]
    rates = ", ".join(f"(10000 * {a} // greatest({b}, 1))::BIGINT AS {name}" for name, a, b, *_ in rules)
    cells = " UNION ALL ".join(f"SELECT lang, source, '{name}' AS metric, {name} AS v FROM rated WHERE NOT base_failed" for name in [r[0] for r in rules] + ["n_words", "word_chars", "n_lines"])
    of = lambda metric, q: f"max(CASE WHEN metric = '{metric}' THEN q{q} END)"
    wide = ", ".join(f"{of(name, 75)} + {spreads} * greatest({of(name, 75)} - {of(name, 25)}, {one} // greatest({of(size, 50)}, 1)) AS {name}" for name, _, size, one, spreads in rules)
    pick = ", ".join(f"CASE WHEN a.n >= 100 THEN a.{name} WHEN a.n IS NOT NULL AND b.n >= 100 THEN b.{name} WHEN a.n IS NOT NULL THEN c.{name} END AS {name}_limit" for name, *_ in rules)
    over = " OR ".join(f"coalesce({name} > {name}_limit, false)" for name, *_ in rules)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM d),
e AS (SELECT r, unnest(words) AS a, unnest(range(len(words))) AS p FROM w),
t AS (SELECT r, p, a, lead(a, 1) OVER q AS b, lead(a, 2) OVER q AS c FROM e WINDOW q AS (PARTITION BY r ORDER BY p)),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM t WHERE c IS NOT NULL),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
measured AS (SELECT w.r, doc_id, lang, source, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(replace(text, '!', '')) AS n_bangs FROM w LEFT JOIN dup ON dup.r = w.r LEFT JOIN rep ON rep.r = w.r),
rated AS (SELECT *, {rates}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
cells AS ({cells}),
fine AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS n FROM cells GROUP BY ALL),
levels AS (SELECT 0 AS level, lang, source, metric, bucket, n FROM fine UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM fine GROUP BY lang, metric, bucket UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM fine GROUP BY metric, bucket),
ranks AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM levels),
quartiles AS (SELECT level, lang, source, metric, any_value(total) AS total, min(CASE WHEN upto * 100 >= total * 25 THEN bucket END) AS q25, min(CASE WHEN upto * 100 >= total * 50 THEN bucket END) AS q50, min(CASE WHEN upto * 100 >= total * 75 THEN bucket END) AS q75 FROM ranks GROUP BY level, lang, source, metric),
wide AS (SELECT level, lang, source, max(total) AS n, {wide} FROM quartiles GROUP BY level, lang, source),
joined AS (SELECT m.*, {pick} FROM rated m
  LEFT JOIN wide a ON a.level = 0 AND a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
  LEFT JOIN wide b ON b.level = 1 AND b.lang IS NOT DISTINCT FROM m.lang LEFT JOIN wide c ON c.level = 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {over}) AS kept, {", ".join(r[0] for r in rules)}, {", ".join(f"{r[0]}_limit::BIGINT AS {r[0]}_limit" for r in rules)} FROM joined"""
