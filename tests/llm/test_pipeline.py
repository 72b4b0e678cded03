"""Every stage of the pipeline on its own input, against brute force."""

import corpus_pipeline
from tidemark.llm import decontamination, jaccard, mixing, queries, toxicity

from ..conftest import SF
from .test_jaccard import expected


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near duplicates", "benchmark decontamination", "source mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    inputs = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, inputs[-1], SF).write.parquet(f"{tmp_path}/{i}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(x.columns == docs.columns for x in inputs[:-1])
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in inputs]
    rows = [[(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in inputs[:-1]]

    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.5").collect()}

    _, up, sets = expected(rows[1], 5, 80, 100)
    groups: dict = {}
    for i, (k, _) in enumerate(rows[1]):
        groups.setdefault(up[i] if sets[i] else ("empty", k), []).append(k)
    assert ids[2] == {min(g) for g in groups.values()} and len(rows[2]) == len(groups)

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert ids[3] == {r.doc_id for r in decontamination.report(decontamination.scan(inputs[2], bench)).where("NOT contaminated").collect()}

    goal = {r.source: r.target for r in mixing.mix(inputs[3]).select("source", "target").distinct().collect()}
    words: dict = {}
    for r in inputs[4].collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.encode().split())
    assert abs(sum(words.values()) - sum(goal.values())) < 0.15 * sum(goal.values())

    last = inputs[5].collect()
    assert sorted((r.doc_id, r.text) for r in last) == sorted(rows[4]) and set(docs.columns) < set(inputs[5].columns)
    assert len(last) == len(rows[4]) and {r.shard for r in last} <= set(range(16))
    for k in range(16):
        own = sorted(r.slot for r in last if r.shard == k)
        assert own == list(range(len(own)))


def test_run_gives_the_same(spark):
    a, b = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and len(a) > 0


def test_names():
    names = sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names) and jaccard.CELL_GRAMS > 0
