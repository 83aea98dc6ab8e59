import random

import pytest
from pyspark.sql import functions as F

from feedloom.llm.language_id import (accepted_documents, domain_of, evidence, fit, host_of, identify, language_code, markup_language,
                                      markup_text, suffix_of, trained)
from llm_help import make  # noqa: F401

WORDS = {"en": "the of and that with this from have thing which", "de": "der und nicht ein schön über straße auch ich", "fr": "le les une être déjà où avec pour dans ça"}


def said(language, seed, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[language].split()) for _ in range(n)) + "."


def corpus():
    rows = []
    for k in range(300):
        language = ("en", "de", "fr")[k % 3]
        rows.append((k, said(language, k, 2 + k % 40), language, "host%d" % (k % 3 if k % 2 else 7)))
    return rows


def test_held_out_accuracy_of_the_text_alone(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = trained(docs.filter("doc_id % 2 = 0"))
    rest = docs.filter("doc_id % 2 = 1").collect()
    logs, _ = evidence([d.text for d in rest], model)
    right = sum(model.classes[k] == d.lang for k, d in zip(logs.argmax(axis=1), rest))
    assert right >= 0.97 * len(rest)


def test_clean_documents_stay(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = accepted_documents(docs)
    assert kept.columns == docs.columns and kept.count() >= docs.filter("length(text) > 0").count() * 0.99


def test_scores_do_not_depend_on_neighbours():
    model = fit([said(k, 1) for k in WORDS], list(WORDS))
    texts = ["", None, "the", "\n.\n", said("de", 5), "1234 !!", said("fr", 7, 5000), "ß", "中文字"]
    together = evidence(texts, model)[0]
    for k, t in enumerate(texts):
        assert together[k] == pytest.approx(evidence([t], model)[0][0], abs=1e-3)


def test_odd_rows_have_defined_answers(make):
    rows = corpus() + [(900, None, "en", "host7"), (901, "", None, None), (902, "123 ...", "de", "host1"), (903, said("de", 3), None, None),
                       (904, said("fr", 4), "xx-unknown!", "host7"), (0, rows0 := corpus()[0][1], "en", "host7"), (None, rows0, "en", "host7"), (905, "qzx wvk jjq xxz qqk zzw kkj vvx", None, None)]
    docs = make(rows).withColumn("host", F.lit(1)).withColumn("likelihood", F.lit(2)).withColumn("grams", F.lit(3))
    out = {r.doc_id: r for r in identify(docs, "doc_id", "text", F.col("source"), F.col("lang")).collect()}
    assert {k for k in (900, 901, 902) if out[k].accepted} == set() and out[901].language == "und"
    assert (out[903].language, out[904].language) == ("de", "fr") and out[None].language == "en"
    right = sum(out[k].language == rows[k][2] for k in range(300))
    assert right >= 297 and identify(docs, "doc_id", "text", F.col("source"), F.col("lang")).count() == len(rows)
    kept = accepted_documents(docs)
    assert kept.columns == docs.columns and not kept.filter("doc_id in (900, 901, 902)").count()
    assert identify(docs.limit(0), "doc_id", "text", F.col("source"), F.col("lang")).count() == 0
    assert accepted_documents(docs.limit(0)).count() == 0


def test_hosts_tell_short_texts(make):
    rows = [(k, said("fr", k, 20), None, "a.example.fr") for k in range(200)] + [(k + 500, said("de", k, 20), None, "b.example.de") for k in range(200)]
    model = fit([said(k, s, 40) for k in WORDS for s in range(5)], [k for k in WORDS for _ in range(5)])
    rows += [(1000, "zug", None, "a.example.fr"), (1001, "zug", None, "b.example.de")]
    docs = make(rows)
    found = {r.doc_id: r for r in identify(docs, "doc_id", "text", F.col("source"), F.col("lang"), model).collect()}
    assert found[1000].language == "fr" and found[1001].language == "de"


def test_addresses_and_markup(spark):
    from conftest import values

    assert values(spark, host_of(F.lit("HTTPS://u:p@Blog.Example.DE:8080/x?y#z")), host_of(F.lit("/x")), domain_of(F.lit("a.b.c")), suffix_of(F.lit("x.de")), suffix_of(F.lit("src1")),
                  suffix_of(F.lit("10.0.0.1"))) == ("blog.example.de", None, "b.c", "de", None, None)
    assert values(spark, language_code(F.lit(" EN-us ")), language_code(F.lit("english!")), language_code(F.lit(None).cast("string"))) == ("en", None, None)
    html = "<!doctype html><HTML class=x lang='fr-CA'><script>var t='<p>';</script><p>bon<b>jour</b></p><!-- <p>x</p> -->"
    assert values(spark, markup_language(F.lit(html)), F.trim(F.regexp_replace(markup_text(F.lit(html)), " +", " "))) == ("fr-CA", "bon jour")
