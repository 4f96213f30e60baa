"""The pipeline, stage by stage, against its operators' results by brute force."""

import corpus_pipeline
from pyspark.sql import functions as F

from lakesift.llm import mixing, toxicity
from tests.llm.test_texts import slow_components, slow_fingerprint, toxic_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    rows = toxic_rows(900)
    texts = {i: t for i, t, _ in rows}
    extra = {1000 + k: texts[k] for k in range(0, 900, 9)} | {2000: "", 2001: None}
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", None if t is None else len(t)) for i, t in (texts | extra).items()], DOCS)
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, folder).write.parquet(f"{folder}/{k}")
        now = spark.read.parquet(f"{folder}/{k}")
        seen.append(now)
        if k < 3:
            assert now.columns == docs.columns
    model = toxicity.fit(docs, labels)
    clean = {r["doc_id"] for r in toxicity.with_score(docs, model).where("score < 0.7").collect()}
    assert {r["doc_id"] for r in seen[0].collect()} == clean
    harmless = {i for i, _, y in rows if not y}
    harmless |= {i for i in extra if i >= 2000 or i - 1000 in harmless}
    assert len(clean ^ harmless) <= 0.03 * len(texts | extra)
    left = sorted(seen[0].collect(), key=lambda r: r["doc_id"])
    group = slow_components([slow_fingerprint(r["text"]) for r in left])
    assert sorted(r["doc_id"] for r in seen[1].collect()) == sorted(left[g]["doc_id"] for g in set(group))
    taken = {r["doc_id"]: round(r["taken"] / r["size"]) for r in mixing.mix(seen[1]).collect() if r["size"]}
    counts = {r["doc_id"]: r["count"] for r in seen[2].groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}
    assert seen[3].count() == seen[2].count()
    assert corpus_pipeline.run(spark, folder).count() == seen[3].count()


def test_odd_tables(spark, tmp_path):
    """No rows; null sources, ids and texts, repeated rows, one very long text, and columns whose names the stages use themselves."""
    names = ["_md5", "_size", "_position", "_id", "_copies", "_words", "row", "digest", "score", "position", "root", "id", "label", "terms"]
    rows = toxic_rows(120)
    plain = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    odd = [(None, "no id here", "en", None, 10), (500, None, None, None, None), (501, "", "en", "s1", 0), plain[4], plain[4], (502, "lang words " * 60_000, "de", "hot", 660_000)]
    for name, docs in (("empty", []), ("odd", plain + odd)):
        folder = f"{tmp_path}/{name}"
        df = spark.createDataFrame(docs, DOCS)
        df = df.withColumns({c: F.lit(f"kept {c}") for c in names})
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 0, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
            stage(spark, now, folder).write.parquet(f"{folder}/{k}")
            now = spark.read.parquet(f"{folder}/{k}")
            assert now.columns == df.columns
            assert {tuple(r) for r in now.select(*names).distinct().collect()} <= {tuple(f"kept {c}" for c in names)}
        left = [r["doc_id"] for r in now.collect()]
        assert corpus_pipeline.STAGES[3][1](spark, now, folder).count() == len(left)
        assert (left == []) == (name == "empty") and 500 not in left and 501 not in left
        if name == "odd":
            assert 502 in left and None in left
