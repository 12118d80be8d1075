import corpus_pipeline as cp


def test_stages_feed_each_other(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    n = [docs.count()]
    rows = docs
    for _, stage in cp.STAGES[:-1]:
        rows = stage(spark, rows, d)
        assert rows.columns == docs.columns
        rows = cp.written(rows, "test-stage")
        assert rows.exceptAll(docs).isEmpty()
        n.append(rows.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0
    out = cp.run(spark, d).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in rows.collect()}
    out.sort(key=lambda r: r.doc_id)
    at = 0
    for r in out:
        assert r.start == at
        at += r.n_tokens


def test_empty_and_odd_rows(spark):
    d = "/root/testdata/sf0.001"
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int, p string"
    odd = [(None, None, None, None, None, 1, "x"), (1, "", "en", None, 0, 2, None), (1, "", "en", None, 0, 2, None), (2, "one two " * 3000, None, "s", 1, 1, "")]
    for rows in ([], odd):
        df = spark.createDataFrame(rows, schema)
        for _, stage in cp.STAGES:
            out = stage(spark, df, d)
            assert stage is cp.tokens or out.columns == df.columns
            assert out.count() <= len(rows)
