import numpy as np
import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark, tmp_path):
    from test_llm import LOW, VOCAB, brute_contamination, brute_near

    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(VOCAB, 80)) for _ in range(120)]
    for i in range(0, 120, 4):
        texts[i] = "you IDIOT moron " + texts[i]
    texts[11], texts[13] = texts[9].upper(), texts[9]
    texts[15] = texts[17][:-3] + " end"
    items = [(1, " ".join(texts[21].split()[5:40])), (2, "short item")]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(500, None, None, None, None), (501, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = {r[0]: r[1] for r in rows}
    seen = []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, spark.read.parquet(str(tmp_path / ("documents.parquet" if not k else f"{k - 1}"))), str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        got = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / str(k))).collect()}
        if name == "toxicity":
            assert not any(i % 4 == 0 for i in got if i < 500) and {500, 501} <= set(got) and len(got) > 85
            left = {i: left[i] for i in got}
        elif name == "exact_dedup":
            keep = {(t or "").translate(LOW): i for i, t in sorted(left.items())}
            left = {i: left[i] for i in keep.values()}
        elif name == "near_dedup":
            ids = sorted(left)
            comp = brute_near([left[i] for i in ids], 5, 80)
            left = {ids[i]: left[ids[i]] for i, (n, c) in comp.items() if i == c or not n}
        elif name == "decontamination":
            ids = sorted(left)
            bad = brute_contamination([left[i] for i in ids], items)
            left = {ids[i]: left[ids[i]] for i, v in bad.items() if not v[3]}
        assert set(got) == set(left), name
        if k < 4:
            assert spark.read.parquet(str(tmp_path / str(k))).columns == docs.columns
        else:
            assert all(r.lossless for r in got.values())
        seen.append(len(got))
    assert seen == sorted(seen, reverse=True) and len(set(seen[:4])) == 4
    assert pipeline.run(spark, str(tmp_path)).count() == seen[-1]
