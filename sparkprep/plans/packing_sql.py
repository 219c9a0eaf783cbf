"""First fit decreasing as DuckDB SQL: one row after the other, with the room of all bins as a list."""

from __future__ import annotations


def first_fit_sql(capacity: int) -> str:
    """A WITH clause that ends in fitted(id, length, bin): documents by their words, longest first, equal lengths by a keyed hash."""
    return f"""
WITH RECURSIVE sizes AS (SELECT doc_id AS id, CAST(len(string_split(text, ' ')) AS BIGINT) AS length FROM documents),
ordered AS (SELECT *, row_number() OVER (ORDER BY length DESC, md5(id || '-rank'), id) AS k FROM sizes),
steps AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS length, CAST(-1 AS BIGINT) AS bin, CAST([] AS BIGINT[]) AS room
  UNION ALL
  SELECT k, id, length, bin, CASE WHEN bin >= len(room) THEN list_append(room, greatest({capacity} - length, 0)) ELSE list_transform(room, lambda r, i: CASE WHEN i = bin + 1 THEN r - length ELSE r END) END
  FROM (SELECT o.k, o.id, o.length, s.room, CAST(coalesce(list_position(list_transform(s.room, lambda r: r >= o.length), true), len(s.room) + 1) - 1 AS BIGINT) AS bin FROM steps s JOIN ordered o ON o.k = s.k + 1)),
fitted AS (SELECT id, length, bin FROM steps WHERE k > 0)"""
