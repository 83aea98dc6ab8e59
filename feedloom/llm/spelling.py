"""Spelling variants of words by permuterm rotations.

A word with an end mark has one rotation for each of its places. A rotation without its last character stands for the word
with that character skipped: two words that differ in one replaced character share such a key, and a word that lacks
one character of another has that key as one of its whole rotations. So all rotations are sorted once, and words that are near stand
side by side below one key. A key holds one whole word at most, and one word per letter of the alphabet with a skipped one, so a group
is bounded by the alphabet whatever the table; each member is told the number of its partners and the best one, never all pairs.

Words are numbered by frequency first, so that sorting, grouping and choosing handle numbers; the number of a word is its place in the
order of largest count, then smallest code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import quoted, saved

LETTER = "[A-Za-zÀ-ÿ]"
END = "\u0001"
SHORTEST = 7
LEAST = 2
FACTOR = 10
LONG_KEY = 200
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def runs(docs: DataFrame, text: str = "text", shortest: int = SHORTEST) -> Column:
    """Maximal runs of letters of at least `shortest` code points, A-Z lower-cased; none for a null text."""
    found = F.regexp_extract_all(quoted(text), F.lit(f"({LETTER}{{{shortest},}})"), F.lit(1))
    return F.transform(found, lambda run: F.translate(run, CAPITALS, CAPITALS.lower()))


def damaged(run: Column, doc_id: Column) -> Column:
    """The run without one code point where 31 divides the crc32 of `<doc_id>:<run>`; a null id counts as empty."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "UTF-8"))
    place = (h % F.length(run)).cast("int")
    shorter = F.concat(F.substring(run, F.lit(1), place), F.substring(run, place + 2, F.length(run)))
    return F.when(h % 31 == 0, shorter).otherwise(run)


def count_words(words: DataFrame, word: str = "word", shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of the words of at least `shortest` code points that occur `least` times or more; one row per occurrence comes in."""
    kept = words.select(quoted(word).alias("word")).filter(F.length("word") >= shortest)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def numbered(words: DataFrame) -> DataFrame:
    """(rank, word, n): ranks rise in the order of n descending, then word by code points; they are not gapless."""
    order = [F.desc("n"), F.asc("word")]
    placed = words.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(placed.select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "spelling_words")


def _key(text: Column) -> Column:
    """Rotations of usual length are sorted as they are, longer ones by a digest, so that a row stays small."""
    return F.when(F.length(text) <= LONG_KEY, text).otherwise(F.concat(F.lit("#"), F.md5(text)))


def rotations(ranked: DataFrame) -> DataFrame:
    """(key, rank, kind): whole rotations (0), and rotations with the last character skipped (1; 2 for a character equal to
    the one before it, whose loss gives the same word once more)."""
    marked, length = F.concat(F.col("word"), F.lit(END)), F.length("word")
    placed = ranked.select("rank", marked.alias("marked"), length.alias("size"), F.explode(F.sequence(F.lit(0), length)).alias("at"))
    head, whole = F.substring("marked", F.lit(1), F.col("at")), F.substring("marked", F.col("at") + 1, F.col("size") + 1)
    skipped = F.substring("marked", F.col("at") + 2, F.col("size") + 1)
    here, before = F.substring("marked", F.col("at") + 1, F.lit(1)), F.substring("marked", F.col("at"), F.lit(1))
    repeats = (F.col("at") > 0) & (here == before)
    keys = F.array(
        F.struct(_key(F.concat(whole, head)).alias("key"), F.lit(0).alias("kind")),
        F.when(F.col("at") < F.col("size"), F.struct(_key(F.concat(skipped, head)).alias("key"), F.when(repeats, 2).otherwise(1).alias("kind"))),
    )
    return placed.select("rank", F.explode(F.array_compact(keys)).alias("k")).select("k.key", "rank", "k.kind")


def near_words(ranked: DataFrame) -> DataFrame:
    """(rank, n_near, best): number of words that differ by one inserted, deleted or replaced code point, and the least rank of them.

    Words with such a partner only. Each pair of words meets below exactly one key.
    """
    in_order = rotations(ranked).repartitionByRange("key").sortWithinPartitions("key")
    groups = in_order.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "kind"))).alias("all"))
    groups = groups.filter(F.size("all") > 1).select(
        "all", F.filter("all", lambda m: m["kind"] > 0).alias("cut"), F.filter("all", lambda m: m["kind"] == 0).alias("whole"),
    )
    groups = groups.withColumn("firsts", F.filter("cut", lambda m: m["kind"] == 1))

    def first(members: Column, at: int = 0) -> Column:
        return F.get(members, F.lit(at))["rank"]

    told = groups.select(F.explode("all").alias("m"), "cut", "whole", "firsts").select(F.col("m.rank").alias("rank"), F.col("m.kind").alias("kind"), "cut", "whole", "firsts")
    other = F.when(first(F.col("cut")) == F.col("rank"), first(F.col("cut"), 1)).otherwise(first(F.col("cut")))
    partners = told.select(
        "rank",
        F.when(F.col("kind") == 0, F.size("firsts"))
        .otherwise(F.size("cut") - 1 + F.when(F.col("kind") == 1, F.size("whole")).otherwise(0)).cast("long").alias("k"),
        F.when(F.col("kind") == 0, first(F.col("firsts")))
        .when(F.col("kind") == 1, F.least(other, first(F.col("whole")))).otherwise(other).alias("best"),
    )
    return partners.filter(F.col("k") > 0).groupBy("rank").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(rank, root) from (rank, form): follows forms to the last by doubling. Counts rise along a chain, so there are no circles."""
    step = forms.select("rank", F.col("form").alias("root"))
    while True:
        ahead = step.select(F.col("rank").alias("root"), F.col("root").alias("next"))
        joined = saved(step.join(ahead, "root", "left").select("rank", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        step = joined.select("rank", "root")
        if joined.filter("moved").isEmpty():
            return step


def spelling_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a table (word, n) of distinct words.

    A word's form is its near word of largest n, ties going to the smallest in code-point order, if that n is at least
    `factor` (2 or more) times its own; root follows forms to the last. An empty table gives an empty result. Words must not hold the
    character U+0001. The rotations of a word take the square of its length in characters to write, so a word of 100000 letters keeps
    a core busy for about a minute; nothing of it is cut.
    """
    if factor < 2:
        raise ValueError("with a factor below 2 forms could run in a circle")
    ranked = numbered(words)
    near = saved(near_words(ranked), "spelling_near")
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    told = ranked.join(near, "rank", "left").join(best, "best", "left")
    is_form = F.coalesce(F.col("form_n") >= F.col("n") * factor, F.lit(False))
    told = saved(
        told.select("rank", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), *[F.when(is_form, F.col(c)).alias(c) for c in ("best", "form", "form_n")]),
        "spelling_forms",
    )
    roots = _roots(told.filter("best IS NOT NULL").select("rank", F.col("best").alias("form")))
    names = ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word"))
    followed = told.join(roots, "rank", "left").join(names, "root", "left")
    return followed.select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, folder: str) -> DataFrame:
    """Variants among the words of all `documents`; null texts hold none, repeated rows count again, further columns are not read."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = docs.select("doc_id", F.explode(runs(docs)).alias("run"))
    counted = count_words(found.select(damaged(F.col("run"), F.col("doc_id")).alias("word")))
    return spelling_variants(saved(counted, "spelling_counts"))


OP11_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce([b::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda a, _z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(b))
), found AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id,
    translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), long_runs AS (
  SELECT id, run, count(*) AS times FROM found WHERE length(run) >= 7 GROUP BY id, run
), bytes AS (
  SELECT run, times, hex(encode(id || ':' || run)) AS x FROM long_runs
), hashed AS (
  SELECT run, times, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM bytes, crc
), damaged AS (
  SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
), cuts AS (
  SELECT word, n, length(word) AS size, place, substr(word, 1, place::INT - 1) || substr(word, place::INT + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) u(place)
), pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION SELECT c.word, w.word FROM cuts c JOIN words w ON w.word = c.rest
  UNION SELECT w.word, c.word FROM cuts c JOIN words w ON w.word = c.rest
), near AS (
  SELECT a AS word, b AS other, w.n AS other_n, row_number() OVER (PARTITION BY a ORDER BY w.n DESC, b) AS place, count(*) OVER (PARTITION BY a) AS n_near
  FROM pairs JOIN words w ON w.word = b
), forms AS (
  SELECT w.word, w.n, coalesce(p.n_near, 0)::BIGINT AS n_near, CASE WHEN p.other_n >= 10 * w.n THEN p.other END AS form, CASE WHEN p.other_n >= 10 * w.n THEN p.other_n END AS form_n
  FROM words w LEFT JOIN near p ON p.word = w.word AND p.place = 1
), chain AS (
  SELECT word, word AS last, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain c JOIN forms f ON f.word = c.last WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(last, step) AS root FROM chain GROUP BY word
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM forms f JOIN roots r ON r.word = f.word
"""
