"""Language identification by Bayesian evidence fusion.

Evidence of a row: its text (character trigrams under one multinomial model per language, and one of noise, in which
all trigrams are alike), the declared language, the address suffix, and where it comes from. The last is a prior that
is smoothed along the hierarchy host, registered domain, all rows; its counts, like those of declared languages
and suffixes, are sums of the text model's posteriors by grouped aggregation over all rows, so a host of any size is added
up before the shuffle. The log terms add up; the most likely class wins, and a row is rejected if that is noise, if it
is not likely enough, or if the row has no letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from feedloom.llm.storage import free_name, quoted, saved

TRAINING_ROWS = 1500
BUCKETS = 1 << 16
EFFECTIVE = 200.0
NOISE = 0.01
HOST_WEIGHT = 20.0
DOMAIN_WEIGHT = 50.0
ACCEPT = 0.5
CHUNK = 1 << 20
UNKNOWN = "und"


@dataclass
class TextModel:
    """Log probabilities of hashed trigrams per language; the last class is noise."""

    languages: list[str]
    logs: np.ndarray

    @property
    def classes(self) -> list[str]:
        return [*self.languages, UNKNOWN]


def _units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points of the texts, two blanks before each; where each text starts."""
    lowered = ["  " + (t or "").lower() + " " for t in texts]
    data = np.frombuffer("".join(lowered).encode("utf-32-le"), "<u4")
    starts = np.cumsum([0, *(len(t) for t in lowered)])
    return data, starts


_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)])


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigram that ends at each place (from the third), and which of them have a letter in the middle."""
    letter = np.where(data < len(_LETTER), _LETTER[np.minimum(data, len(_LETTER) - 1)], True)
    plain = np.where(letter, data, 32).astype(np.uint32)
    mixed = plain[:-2] * np.uint32(0x9E3779B1) ^ plain[1:-1] * np.uint32(0x85EBCA77) ^ plain[2:] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0x27D4EB2F) >> np.uint32(16)).astype(np.int32), letter[1:-1]


def fit(texts: list[str], labels: list[str]) -> TextModel:
    """A model of the labels' languages, each with the same prior; smoothing by half a trigram."""
    languages = sorted(set(labels))
    counts = np.full((len(languages) + 1, BUCKETS), 0.5)
    for k, language in enumerate(languages):
        for text in (t for t, label in zip(texts, labels) if label == language):
            grams, used = _trigrams(_units([text])[0])
            counts[k] += np.bincount(grams[used], minlength=BUCKETS)
    return TextModel(languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def score(texts: list[str | None], model: TextModel) -> tuple[np.ndarray, np.ndarray]:
    """Mean log probability of each text's trigrams under each class, and their number."""
    means, numbers = [], []
    low = 0
    while low < len(texts):
        high, size = low, 0
        while high < len(texts) and (high == low or size + len(texts[high] or "") <= CHUNK):
            size += len(texts[high] or "")
            high += 1
        data, starts = _units(texts[low:high])
        grams, used = _trigrams(data)
        # no trigram with a letter in the middle reaches into the next text, which begins with two blanks
        cuts = starts[:-1]
        n = np.add.reduceat(used.astype(np.int64), cuts)
        sums = np.stack([np.add.reduceat(np.where(used, logs[grams], 0.0), cuts) for logs in model.logs], axis=1)
        means.append(sums / np.maximum(n, 1)[:, None])
        numbers.append(n)
        low = high
    if not means:
        return np.empty((0, len(model.logs))), np.empty(0, np.int64)
    return np.concatenate(means), np.concatenate(numbers)


def evidence(texts: list[str | None], model: TextModel) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods per class. Neighbouring trigrams depend on each other: n of them count as n / (1 + n / EFFECTIVE)."""
    means, n = score(texts, model)
    return means * (n / (1 + n / EFFECTIVE))[:, None], n


def trained(rows: DataFrame, text: str = "text", label: str = "lang", bound: int = TRAINING_ROWS) -> TextModel:
    """Fit on at most `bound` labelled rows with text: those of the smallest hashes of text and label.

    Their hashes are found first; only the chosen rows' texts come to the driver.
    """
    labelled = rows.select(quoted(text).alias("text"), quoted(label).alias("label")).filter("label is not null and text <> ''")
    order = labelled.withColumn("h", F.xxhash64("text", "label")).select("h").distinct().orderBy("h").limit(bound)
    last = order.agg(F.max("h").alias("h")).first().h
    if last is None:
        return fit([], [])
    chosen = labelled.filter(F.xxhash64("text", "label") <= last).dropDuplicates(["text", "label"]).collect()
    chosen = sorted((r.label, r.text) for r in chosen)
    return fit([t for _, t in chosen], [label for label, _ in chosen])


def with_evidence(rows: DataFrame, model: TextModel, text: str, keep: list[str], name: str = "likelihood") -> DataFrame:
    """The columns `keep` of `rows`, `name` (log likelihood per class) and `grams` (their number; see `free_name`)."""
    spark = rows.sparkSession
    number = free_name(rows, "grams")
    shared = spark.sparkContext.broadcast(model)  # BUCKETS numbers per language
    schema = rows.select(*[quoted(c) for c in keep]).schema.add(name, ArrayType(DoubleType())).add(number, "long")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                logs, n = evidence(part.column(0).to_pylist(), shared.value)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, logs.size + 1, logs.shape[1]), pa.int32()), pa.array(logs.ravel().astype(np.float64)))
                columns = [*part.columns[1:], lists, pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*keep, name, number])

    source = quoted(text).alias(free_name(rows, "text_of"))
    return rows.select(source, *[quoted(c) for c in keep]).mapInArrow(compute, schema)


def host_of(url: Column) -> Column:
    """Lower-case host of an address, null if it has none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(host, F.lit(""))


def domain_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    """Last label of a host with several, if it is of letters only."""
    return F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})$", 1), F.lit(""))


def language_code(declared: Column) -> Column:
    """Primary subtag of a declared language, null if it is not one."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)


def markup_text(html: Column) -> Column:
    """Text between tags, without scripts, styles and comments."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


@dataclass
class Priors:
    """Tables of log probabilities per class: by host, and by declared language and suffix."""

    host: DataFrame
    declared: DataFrame
    suffix: DataFrame
    overall: list[float]


def priors(evidence_rows: DataFrame, model: TextModel) -> Priors:
    """Grouped aggregation of the text posteriors of all rows (columns likelihood, host, declared, suffix)."""
    size = len(model.classes)
    start = F.array(*[F.lit(float(np.log(p))) for p in _flat(size)])
    soft = evidence_rows.withColumn("p", _softmax_of(F.zip_with("likelihood", start, lambda a, b: a + b)))
    parts = soft.select("host", "declared", "suffix", *[F.col("p")[k].alias(f"p{k}") for k in range(size)])
    sums = [F.sum(f"p{k}").alias(f"p{k}") for k in range(size)]
    again = [F.sum(f"p{k}").alias(f"p{k}") for k in range(size)]
    by_all = saved(parts.groupBy("host", "declared", "suffix").agg(*sums), "evidence")
    total = by_all.agg(*again).first()
    counts = [float(x or 0.0) for x in total] if total else [0.0] * size
    n = sum(counts)
    overall = [(c + 1.0) / (n + size) for c in counts]

    def smoothed(table: DataFrame, weight: float, parent: list[Column]) -> list[Column]:
        own = sum((F.col(f"p{k}") for k in range(size)), F.lit(0.0))
        return [((F.col(f"p{k}") + weight * parent[k]) / (own + F.lit(weight))).alias(f"q{k}") for k in range(size)]

    hosts = by_all.filter("host is not null").groupBy("host").agg(*again).withColumn("domain", domain_of(F.col("host")))
    domains = hosts.groupBy("domain").agg(*again)
    domains = domains.select("domain", *smoothed(domains, DOMAIN_WEIGHT, [F.lit(x) for x in overall]))
    parents = domains.select("domain", *[F.col(f"q{k}").alias(f"r{k}") for k in range(size)])
    hosts = hosts.join(parents, "domain")
    hosts = hosts.select("host", *smoothed(hosts, HOST_WEIGHT, [F.col(f"r{k}") for k in range(size)]))
    host = hosts.select("host", F.array(*[F.log(f"q{k}") for k in range(size)]).alias("host_log"))

    def likelihoods(column: str) -> DataFrame:
        """log P(value | class), each value with one more row in every class."""
        found = by_all.filter(F.col(column).isNotNull()).groupBy(column).agg(*again)
        whole = found.agg(F.count(F.lit(1)).alias("values"), *again).first()  # as many numbers as classes
        return found.select(column, F.array(*[
            F.log((F.col(f"p{k}") + 1.0) / F.lit(float(whole[f"p{k}"] or 0.0) + whole["values"]))
            for k in range(size)
        ]).alias(f"{column}_log"))

    return Priors(saved(host, "hosts"), saved(likelihoods("declared"), "declared"), saved(likelihoods("suffix"), "suffix"), overall)


def _flat(size: int) -> list[float]:
    return [*[(1 - NOISE) / max(1, size - 1)] * (size - 1), NOISE if size > 1 else 1.0]


def _softmax_of(logs: Column) -> Column:
    top = F.array_max(logs)
    total = F.aggregate(logs, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logs, lambda x: F.exp(x - top) / total)


def decided(evidence_rows: DataFrame, found: Priors, model: TextModel, accept: float = ACCEPT) -> DataFrame:
    """Adds language, probability and accepted to rows with likelihood, grams, host, declared and suffix."""
    nothing = F.array(*[F.lit(0.0)] * len(model.classes))
    overall = F.array(*[F.lit(float(np.log(p))) for p in found.overall])
    rows = (
        evidence_rows.join(found.host, "host", "left").join(found.declared, "declared", "left").join(found.suffix, "suffix", "left")
    )

    def add(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y)

    logs = add(add("likelihood", F.coalesce("host_log", overall)), add(F.coalesce("declared_log", nothing), F.coalesce("suffix_log", nothing)))
    names = F.array(*[F.lit(c) for c in model.classes])
    rows = rows.withColumn("posterior", _softmax_of(logs))
    best = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    rows = rows.withColumn("probability", F.round(F.array_max("posterior"), 6))
    rows = rows.withColumn("language", F.when(F.col("grams") > 0, best).otherwise(F.lit(UNKNOWN)))
    accepted = (F.col("language") != UNKNOWN) & (F.col("probability") >= accept)
    return rows.withColumn("accepted", accepted).drop("host_log", "declared_log", "suffix_log", "posterior")


def identify(
    rows: DataFrame, key: str, text: str, host: Column, declared: Column, model: TextModel | None = None,
    accept: float = ACCEPT,
) -> DataFrame:
    """(key, language, probability, accepted) of every row.

    Null or empty texts and texts without letters are `und` and rejected, whatever else speaks for them. A null host,
    suffix or declared language is no evidence. Repeated rows get the same answer each. Without labelled rows
    there is no language to tell, and all rows are rejected; an empty table gives no rows.
    """
    model = trained(rows.select(quoted(text).alias("text"), language_code(declared).alias("lang"))) if model is None else model
    plain = rows.select(quoted(key).alias(key), quoted(text).alias("text"), host.alias("host"), language_code(declared).alias("declared"), suffix_of(host).alias("suffix"))
    scored = saved(with_evidence(plain, model, "text", [key, "host", "declared", "suffix"]), "likelihoods")
    return decided(scored, priors(scored, model), model, accept).select(quoted(key), "language", "probability", "accepted")


def accepted_documents(
    docs: DataFrame, text: str = "text", host: str = "source", declared: str = "lang", model: TextModel | None = None,
    accept: float = ACCEPT,
) -> DataFrame:
    """The accepted rows of `docs` with all their columns."""
    row = free_name(docs, "row")
    stored = docs.withColumn(row, F.monotonically_increasing_id())
    stored = saved(stored, "identified")
    found = identify(stored, row, text, quoted(host), quoted(declared), model, accept)
    return stored.join(found.filter("accepted").select(row), row, "left_semi").select(*[quoted(c) for c in docs.columns])


def op10(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return identify(docs, "doc_id", "text", F.col("source"), F.col("lang"))


def pages(spark, folder: str) -> DataFrame:
    """The same over web pages: text of the markup, its declared language, host and address suffix."""
    found = spark.read.parquet(f"{folder}/pages.parquet").select(
        "page_id", markup_text(F.col("html")).alias("text"), host_of(F.col("url")).alias("host"),
        markup_language(F.col("html")).alias("declared"))
    return identify(found, "page_id", "text", F.col("host"), F.col("declared"))
