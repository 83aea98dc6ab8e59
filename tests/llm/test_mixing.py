import pytest
from pyspark.sql import functions as F

from feedloom.llm.mixing import mix, mixed_documents, targets, uniform
from llm_help import make, prose  # noqa: F401


def brute_targets(sizes):
    """Water-filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    out = {s: 0.0 for s in names}
    rest, active = 1.5 * sum(sizes.values()), set(names)
    while active and rest > 1e-9:
        total = sum(weight[s] for s in active)
        over = {s for s in active if rest * weight[s] / total >= 2 * sizes[s]}
        if not over:
            for s in active:
                out[s] = rest * weight[s] / total
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
            rest -= out[s]
        active -= over
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 5000, "c": 300, "é": 70, "z": 1, None: 900}, {"x": 0, "y": 3}, {"only": 7}, {None: 0}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in targets(table).collect()}
    assert found == pytest.approx(brute_targets(sizes))


def brute_copies(rows, plan):
    """Copies by sorting each source by its keys."""
    out = {}
    for source, (size, target) in plan.items():
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: (r["key"], r["row"]))
        epochs = int(target // size) if size else 0
        rest, at = target - epochs * size, 0
        for r in own:
            extra = r["size"] > 0 and rest > 0 and at + r["size"] / 2 <= rest
            out[r["row"]] = epochs + bool(extra)
            at += r["size"]
    return out


def sample(make):
    rows = [(k, prose(k, 1 + 7 * k % 130), "en", "s%d" % (k % 4 if k % 3 else 0)) for k in range(400)]
    return make(rows + [(900, None, "en", None), (901, "", "en", "s1"), (902, "tail words here", "en", None), (5, rows[5][1], "en", rows[5][3])] * 2)


def test_copies_are_those_of_sorted_sources(make):
    docs = sample(make).coalesce(3)
    out = [r.asDict() for r in mix(docs, weight=F.lit(1.0)).collect()]
    texts = {r.row: r for r in docs.withColumn("row", F.monotonically_increasing_id()).withColumn(
        "key", 1 - F.exp(F.log(uniform(F.col("doc_id"), F.col("text"))))).select("row", "key").collect()}
    for r in out:
        r["key"] = texts[r["row"]].key
    plan = {r["source"]: (r["source_size"], r["target"]) for r in out}
    assert {r["row"]: r["copies"] for r in out if r["size"]} == {k: v for k, v in brute_copies(out, plan).items() if next(r for r in out if r["row"] == k)["size"]}
    assert all(r["copies"] <= 2 for r in out)
    for source, (size, target) in plan.items():
        taken = sum(r["copies"] * r["size"] for r in out if r["source"] == source)
        assert abs(taken - target) <= max(r["size"] for r in out if r["source"] == source) / 2 + 1e-6


def test_better_documents_come_first(make):
    docs = make([(k, "w " * 10, "en", "ab"[k % 2]) for k in range(2000)]).withColumn("q", F.when(F.col("doc_id") < 1000, 4.0).otherwise(0.5))
    out = mix(docs, weight=F.col("q"), share=0.5).select("doc_id", "copies").collect()
    good = sum(r.copies for r in out if r.doc_id < 1000)
    assert good > 2 * sum(r.copies for r in out if r.doc_id >= 1000)


def test_reruns_and_orders_agree(make):
    docs = sample(make).filter("doc_id < 400")
    one = mix(docs.coalesce(1)).groupBy("doc_id").agg(F.sum("copies")).collect()
    two = mix(docs.repartition(7)).groupBy("doc_id").agg(F.sum("copies")).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_documents_are_repeated(make):
    docs = sample(make).withColumn("copies", F.lit("x")).withColumn("time", F.lit(0)).withColumn("row", F.lit("r"))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    wanted = mix(docs).agg(F.sum("copies")).first()[0]
    assert out.count() == wanted
    assert mixed_documents(docs.limit(0)).count() == 0 and mix(docs.limit(0)).count() == 0
