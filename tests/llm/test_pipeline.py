"""The stages one by one against what their operators say, and the whole."""

import corpus_pipeline as P
from corpusloom.llm import decontaminate, jaccard_join, quality, toxicity
from corpusloom.llm.common import read
from corpusloom.llm.sentencepiece_codec import Codec, Pieces

WHERE = "/root/testdata/sf0.01"


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = read(spark, WHERE, "documents")
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_copies", "decontamination", "sentencepiece"]
    one = P.drop_toxic(spark, docs, WHERE)
    bad = toxicity.scored(docs, toxicity.fit(docs, read(spark, WHERE, "labels"))).filter("toxic")
    assert ids(one) == sorted(set(ids(docs)) - set(ids(bad))) and one.columns == docs.columns
    two = P.drop_poor(spark, one, WHERE)
    _, w, b = quality.fit(one)
    assert ids(two) == ids(quality.scored(one, w, b).filter("quality >= 0.5")) and two.columns == docs.columns
    three = P.drop_near_copies(spark, two, WHERE)
    assert ids(three) == sorted({r.component_id for r in jaccard_join.linked_components(two, 5, 80).collect()}) and three.columns == docs.columns
    four = P.drop_contaminated(spark, three, WHERE)
    leaks = decontaminate.search(three, read(spark, WHERE, "benchmark")).filter("size(_spans) > 0")
    assert ids(four) == sorted(set(ids(three)) - set(ids(leaks))) and four.columns == docs.columns


def test_run(spark):
    rows, given = P.run(spark, WHERE).collect(), {r.doc_id: r for r in read(spark, WHERE, "documents").collect()}
    codec = Codec(Pieces.load())
    assert 0 < len(rows) < len(given)
    import numpy as np

    for r in rows:
        assert r.text == given[r.doc_id].text and codec.decode(np.array(r.token_ids, np.int32)) == r.text


def test_awkward_rows(spark, awkward, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in (awkward, awkward.limit(0)):
        docs = rows
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == rows.columns
        assert P.STAGES[-1][1](spark, docs, str(tmp_path)).count() <= rows.count()
