"""The mixing query, where each document has one source, as DuckDB SQL.

With one source for each pattern the cheapest flow takes each source's rounded target, so the SQL needs no flow. Targets:
in the order of room for weight, a source is full if the share left for it is over its room.
"""

from __future__ import annotations

from sparkprep.llm.mixing import MAX_COPIES, SEED, WEIGHTS


def mixing_sql() -> str:
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % " + f"{len(WEIGHTS)} " + " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS)) + " END"
    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '-{SEED}'), 1, 15) AS BIGINT) AS r FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, {weight} AS weight, sum(source_size) OVER () AS total FROM s),
o AS (SELECT *, {MAX_COPIES} * source_size AS room, sum({MAX_COPIES} * source_size) OVER q - {MAX_COPIES} * source_size AS before, sum(weight) OVER () - sum(weight) OVER q + weight AS weights
  FROM w WINDOW q AS (ORDER BY {MAX_COPIES} * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, (total - before) * weight > weights * room AS is_full FROM o),
l AS (SELECT coalesce(sum(CASE WHEN is_full THEN room END), 0) AS gone, coalesce(sum(CASE WHEN NOT is_full THEN weight END), 0) AS free FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN room ELSE (total - gone) * weight / free END::DOUBLE AS target FROM f, l),
p AS (SELECT *, round_even(target, 0)::BIGINT // greatest(source_size, 1) AS copies, round_even(target, 0)::BIGINT % greatest(source_size, 1) AS rest FROM t),
u AS (SELECT d.source, r, doc_id, sum(size)::BIGINT AS size FROM d GROUP BY d.source, r, doc_id HAVING sum(size) > 0),
c AS (SELECT u.*, p.rest, sum(u.size) OVER (PARTITION BY u.source ORDER BY r, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM u JOIN p ON p.source IS NOT DISTINCT FROM u.source WHERE p.rest > 0),
g AS (SELECT *, upto <= rest AS chosen, rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY source), 0) AS gap FROM c),
b AS (SELECT *, CASE WHEN NOT chosen AND abs(size - gap) < gap THEN row_number() OVER (PARTITION BY source, chosen ORDER BY abs(size - gap), r, doc_id) END AS place FROM g),
m AS (SELECT source, doc_id FROM b WHERE chosen OR place = 1)
SELECT d.doc_id, d.size, p.source_size, p.target, d.size * (p.copies + CASE WHEN m.source IS NOT DISTINCT FROM d.source AND m.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS taken
FROM d JOIN p ON p.source IS NOT DISTINCT FROM d.source LEFT JOIN m ON m.source IS NOT DISTINCT FROM d.source AND m.doc_id = d.doc_id"""
