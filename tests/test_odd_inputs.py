"""Queries against their SQL on values that the small tables don't hold."""

import struct

import duckdb
import numpy as np

from sparkprep.plans import ORACLES, QUERIES


def wanted(name, **tables):
    held = duckdb.connect()
    for table, folder in tables.items():
        held.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    return held.sql(ORACLES[name]).fetchall()


def test_references_without_semicolons_and_white_space_beyond_ascii(spark, tmp_path):
    wide = "     　"
    texts = ["a &amp b &amp", "cut &quo", "&notit; &eacute; &amp;amp;lt; &amp;amp;amp;gt;", f"{wide} a{wide}b \n{wide}", "\x0b a\x0b\x0b \t\n\f\r b\x85 \x1c", "&amp;#39;x&#39; &lt;&gt;&quot;&copy;&middot;", "  a ﻿", " ", "", None]
    spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    have = QUERIES["text_clean"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, have)) == sorted(wanted("text_clean", pages=tmp_path))


def test_rounded_embeddings_to_the_bit(spark, tmp_path):
    """Negative values that round to zero, halves in binary, values without a neighbour and arrays without values."""
    rnd = np.random.default_rng(5)
    near = (rnd.integers(-40, 40, 400) + 0.5) / 1e6
    odd = [-8.9e-08, 8.9e-08, -5e-07, 5e-07, 0.0078125, -0.0234375, 1.0078125, 0.0, 1.0, -3e38, 3e38, float("inf"), -float("inf"), float("nan"), 16777217.0, None]
    rows = [odd, near.tolist(), (near + 1).tolist(), rnd.normal(0, 0.1, 2000).tolist(), [], None]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    bits = lambda a: a and [x if x is None or x != x else struct.pack("<d", x) for x in a]
    plain = lambda rows: sorted(repr((i, bits(stored), bits(loaded))) for i, stored, loaded in rows)
    have = QUERIES["tensor_zero_centred"](spark, str(tmp_path)).select("vec_id", "stored", "loaded").collect()
    assert plain(have) == plain(wanted("tensor_zero_centred", embeddings=tmp_path))
