import corpus_pipeline


def test_stages_take_effect(spark):
    long_text = " ".join(f"word{i % 37}x{i % 11}" for i in range(120))
    rows = [(0, "the same text here", "en"), (1, "the  same text here", "en"), (2, long_text, "en"), (3, long_text + " more", "en"), (4, "12 34", "en"), (5, None, "en"), (6, 'key token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" here', "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
        assert docs.columns == columns
        kept.append(sorted(r["doc_id"] for r in docs.collect()))
    assert kept == [[0, 1, 2, 3, 6], [0, 2, 3, 6], [0, 2, 6], [0, 2, 6]]
    assert "04dbebab" not in {r["doc_id"]: r["text"] for r in docs.collect()}[6]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 3
