"""The corpus pipeline: what each stage keeps, and the whole run over a small folder."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from samples import DOCS, prose, rows  # noqa: E402

from orderloom.llm import private_data, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("corpus"))
    texts = []
    for k in range(160):
        w = prose(k, 60 + k % 90).split()
        if k % 8 == 0:
            for j in range(5, len(w), 15):
                w[j] = toxicity.INSULTS[j % 5]
        texts.append(" ".join(w))
    texts += [texts[1], texts[3] + " tail", "call +1 (499) 555-6503 or jo@mail.example.com, " + prose(999, 40), None, ""]
    spark.createDataFrame(rows(texts, None, ["abc"[k % 3] for k in range(len(texts))]), DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 8 == 0)) for k in range(160)], "doc_id long, quality int, toxic int").write.parquet(
        f"{where}/labels.parquet")
    return where


def test_stages_and_run(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept[-1], folder)
        assert out.columns == columns
        kept.append(corpus_pipeline.written(out, "t"))
    ids = [sorted(r.doc_id for r in k.select("doc_id").collect()) for k in kept]
    clean = [k for k in ids[0] if not (k < 160 and k % 8 == 0)]
    assert ids[1] == clean
    assert ids[2] == [k for k in clean if k not in (160, 161)]
    assert ids[3] == ids[2]
    masked = {r.doc_id: r.text for r in kept[3].collect()}
    assert masked[162].startswith("call [PHONE] or [EMAIL], ") and masked[1] == prose(1, 61)
    assert not any(private_data.base_spans(t or "") for t in masked.values())
    assert set(ids[4]) <= set(ids[3])
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == set(ids[4])
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 1


def test_driver_entry_has_the_pipeline():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "private_data", "curriculum_mix", "packing"]
