from strataform.llm import ann, queries


def test_all_vectors_are_searched_as_thoroughly_as_probes(spark, tmp_path, monkeypatch):
    spark.createDataFrame([("m", "r", 2, True)], "model_id string, revision string, dims int, is_current boolean").write.parquet(f"{tmp_path}/embedding_spaces.parquet")
    rows = [("m", "r", f"c{i}", [1.0, float(i)]) for i in range(4)]
    spark.createDataFrame(rows, "model_id string, revision string, chunk_id string, embedding array<float>").write.parquet(f"{tmp_path}/snapshot_vectors.parquet")
    spark.createDataFrame([("c1",)], "chunk_id string").write.parquet(f"{tmp_path}/probe_vectors.parquet")
    seen, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda x, rows, asked, probes, **more: seen.append(probes) or fit(x, rows, asked, probes, **more))
    queries.p2_neighbours(spark, str(tmp_path))
    queries.p2_found(spark, str(tmp_path))
    assert seen == [ann.PROBES, ann.PROBES]
