from sparkprep.plans import QUERIES


def test_histogram_reaches_the_longest_document(spark, tmp_path):
    spark.createDataFrame([(1, "a b"), (2, "x " * 20002 + "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.length: r.n for r in QUERIES["pack_histogram"](spark, str(tmp_path)).collect()}
    assert len(found) == 20004 and {k: n for k, n in found.items() if n} == {2: 1, 20003: 1}
