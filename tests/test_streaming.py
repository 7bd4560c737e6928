from tagweave.streaming import missing_as_they_come


def test_each_document_once(spark, tmp_path):
    nodes = spark.createDataFrame([("V-101",), (None,)], "tag string")
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id string, full_text string").write.mode("append").parquet(str(tmp_path / "in"))
    out = []
    for batch in ([("a", "Open V-101 and P-12.")], [("b", "P-12 again, T-33"), ("c", None)]):
        docs(*batch)
        stream = spark.readStream.schema("doc_id string, full_text string").parquet(str(tmp_path / "in"))
        missing_as_they_come(stream, nodes, str(tmp_path / "state"), str(tmp_path / "out")).awaitTermination(60)
        out.append(sorted((r.doc_id, r.tag) for r in spark.read.parquet(str(tmp_path / "out")).collect()))
    assert out == [[("a", "P-12")], [("a", "P-12"), ("b", "P-12"), ("b", "T-33")]]
