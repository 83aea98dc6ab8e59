import corpus_pipeline
from feedloom.llm import queries
from feedloom.llm.packing import pack
from llm_help import make, prose  # noqa: F401


def test_stages_are_those_ordered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]
    assert [n for n in queries.QUERIES if n.startswith("op")] == sorted((n for n in queries.QUERIES if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))


def test_each_stage_takes_effect(spark, make, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    text = prose(3, 200)
    extra = [(5000, "", "en", "src0"), (5001, "12 34", "en", "src0")] + [(6000 + k, text + f" tail{k}", "en", "src1") for k in range(3)]
    docs = docs.unionByName(make(extra))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = out
        docs = out
    ids = {r.doc_id for r in kept["language_id"].collect()}
    assert not {5000, 5001} & ids and {6000, 6001, 6002} <= ids
    lines = [x for r in kept["line_dedup"].collect() for x in r.text.split("\n") if x.strip(" ")]
    assert len(lines) == len(set(lines))
    assert kept["simhash_dedup"].count() < kept["line_dedup"].count()
    assert all(r.n_chars == len(r.text) for r in kept["line_dedup"].collect())
    mixed = kept["mixing"].collect()
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in kept["simhash_dedup"].collect()}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert last.agg({"length": "sum"}).first()[0] == pack(docs).agg({"length": "sum"}).first()[0]


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    assert out.count() and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
