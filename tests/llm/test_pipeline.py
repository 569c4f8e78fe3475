"""The whole pipeline against plain versions of its stages, each on its own input."""

import corpus_pipeline
from gridsmith.llm import decontaminate, packing, pii, toxicity

from .test_jaccard import plain as plain_components


def test_stages_take_effect(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("labels", "benchmark"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        before, docs_out = docs, spark.read.parquet(str(tmp_path / name))
        rows = {r.doc_id: r for r in before.collect()}
        if name == "toxicity":
            wanted = {r.doc_id for r in toxicity.score_toxicity(before, labels).collect() if not r.predicted}
            assert {r.doc_id for r in docs_out.collect()} == wanted and wanted < set(rows)
        elif name == "near_copies":
            wanted = {i for i, (_, c) in plain_components([(i, r.text) for i, r in rows.items()]).items() if i == c}
            assert {r.doc_id for r in docs_out.collect()} == wanted
        elif name == "decontamination":
            index = decontaminate.Benchmark([(r.item_id, r.text) for r in bench.collect()])
            assert {r.doc_id for r in docs_out.collect()} == {i for i, r in rows.items() if not index.covers(r.text or "", decontaminate.COVERAGE)}
        elif name == "personal_data":
            got = {r.doc_id: r for r in docs_out.collect()}
            found = {r.doc_id: r.spans for r in pii.pii_report(before).collect()}
            assert set(got) == set(rows)
            for i, spans in found.items():
                assert (got[i].text == rows[i].text) == (spans == "") and got[i].n_chars == len(got[i].text)
        if name != "packing":
            assert docs_out.dtypes == before.dtypes
            docs = docs_out
        else:
            packed = docs_out.collect()
            assert {r.doc_id for r in packed} == set(rows)
            room = {}
            for r in packed:
                room[r.sequence_id] = room.get(r.sequence_id, 0) + r.length
            assert max(room.values()) <= packing.CAPACITY
        kept[name] = docs_out.count()
    assert kept["near_copies"] >= kept["decontamination"] == kept["personal_data"] > 0
    assert [len(n) for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
