"""The sharding query as DuckDB SQL, written from the rule: CRC-32 byte by byte, six rounds, and walks until a row returns."""

from __future__ import annotations


def rounds(source: str) -> str:
    """(row_, n, a, b, p) with ``p`` moved by the six rounds of the network."""
    drawn = "CAST('0x' || substr(md5({} || '-{}-42'), 1, 13) AS BIGINT)"
    found = f"SELECT row_, n, a, b, p // b AS l, p % b AS r FROM {source}"
    for k in range(6):
        moved = f"(l + {drawn.format('r', k)} % a) % a AS l, r" if k % 2 == 0 else f"l, (r + {drawn.format('l', k)} % b) % b AS r"
        found = f"SELECT row_, n, a, b, {moved} FROM ({found})"
    return f"SELECT row_, n, a, b, l * b + r AS p FROM ({found})"


def sharding_sql() -> str:
    return f"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(steps[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32 FROM d, t),
o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_, count(*) OVER () AS n FROM c),
g AS (SELECT DISTINCT row_, n, row_ AS p, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a, CAST(ceil(n / (floor(sqrt(n - 1)) + 1)) AS BIGINT) AS b FROM o),
w AS ({rounds("g")} UNION ALL {rounds("(SELECT * FROM w WHERE p >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(p % 8 AS INTEGER) AS shard, p // 8 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM o JOIN w ON w.row_ = o.row_ AND w.p < w.n"""
