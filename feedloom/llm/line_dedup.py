"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union-find over lines.

DataFrame operations only. A line's shingles are hashed once; the signature's k-th value is the minimum of hash XOR
mask k, which any element of the union takes with the same chance, as for k hash functions. Lines of every length take
their minima over all shingles, so lines of any two lengths are compared by the same rule. Equal lines
are one row from the start (pre-aggregated before the shuffle), so a line's frequency never matters.

Lines that share a band are candidates. Each meets the first line of its bucket; after that only lines that are not
connected yet have to meet, so a large group of copies needs little more. In a bucket of at most SMALL_BUCKET lines they meet
all others. In a larger one they meet over rare shingles: a line of n shingles stands under its first n - ceil(0.8 n) + 1 ones,
those first that the fewest of the bucket's lines share, and two lines whose similarity is 0.8 or more have one of these in common, at
places that leave room for their overlap. How many share a shingle is told by SAMPLE lines of the bucket; any order
finds the same links, so the sample only decides how many other pairs are met. No bucket is capped. Lines under one shingle first
meet its first line, then the first that is not connected to that one, then all that are still unconnected. Links are pairs with
an exact Jaccard similarity of 0.8 or more.

Each line that shares a band has a sketch of 64 * SKETCH bits, one set by each shingle. Bits that differ are at most as many as shingles that
differ, so a pair with too many of them is below the threshold for certain; the others are compared by their sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.bloom import block_count, blocked_filter, possible
from feedloom.llm.components import components
from feedloom.llm.storage import discard, free_name, quoted, saved

SHINGLE = 8
BANDS = 7
ROWS = 3
SIMILARITY = 0.8
SMALL_BUCKET = 16
SAMPLE = 16
SKETCH = 16
GOLDEN = 0x9E3779B97F4A7C15


def _mask(k: int) -> int:
    """Masks whose leading bits differ, so that minima come from different hashes: multiples of the golden ratio."""
    value = (k + 1) * GOLDEN % (1 << 64)
    return value - (1 << 64) if value >= 1 << 63 else value


def _count(units: str, shingle: int) -> str:
    return f"greatest(1, cast(octet_length({units}) / 2 as int) - {shingle - 1})"


def _piece(units: str, at: str, shingle: int) -> str:
    return f"xxhash64(substring({units}, 2 * {at} - 1, {2 * shingle}))"


def shingle_set(line: Column, shingle: int = SHINGLE) -> Column:
    """Distinct hashes of a line's shingles of UTF-16 units; a shorter line is one shingle."""

    def of(units: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length(units) - (2 * shingle - 1)), F.lit(2))
        return F.transform(places, lambda i: F.xxhash64(F.substring(units, i, 2 * shingle)))

    return F.array_distinct(_bound(F.encode(line, "UTF-16BE"), of))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(docs: DataFrame, text: str, doc_id: str, row: str) -> DataFrame:
    """(row, doc_id, pos, h1, h2): every line of every text; blank lines have no hashes, a null text has one row."""
    lines = docs.select(
        quoted(row).alias("row"), quoted(doc_id).alias("doc_id"),
        F.posexplode_outer(F.split(quoted(text), "\n")).alias("pos", "line"))
    shown = F.when(F.trim("line") != "", F.col("line"))
    return lines.select("row", "doc_id", "pos", *_hashes(shown))


def _hashes(line: Column) -> tuple[Column, Column]:
    """128 bits that stand for a line; null for null."""
    return (F.when(line.isNotNull(), F.xxhash64(line)).alias("h1"),
            F.when(line.isNotNull(), F.xxhash64(F.lit("line"), line)).alias("h2"))


def _lines(docs: DataFrame, text: str) -> DataFrame:
    line = F.explode(F.split(quoted(text), "\n")).alias("line")
    return docs.select(line).filter(F.trim("line") != "").select("line", *_hashes(F.col("line")))


def _hashed(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, h): the hash of every shingle of `line`; n of them, repeats included."""
    units = lines.select(*keys, F.encode("line", "UTF-16BE").alias("units"))
    places = units.withColumn("n", F.expr(_count("units", SHINGLE))).select(
        *keys, "units", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))
    return places.select(*keys, "n", F.expr(_piece("units", "i", SHINGLE)).alias("h"))


def signatures(docs: DataFrame, text: str) -> DataFrame:
    """(id, h1, h2, bands) of every different line that is not blank.

    Equal lines meet as lines, so that each is hashed once and its minima need no shuffle of their own."""
    different = _lines(docs, text).groupBy("h1", "h2").agg(F.max("line").alias("line"))
    minima = _hashed(different, "h1", "h2").groupBy("h1", "h2").agg(*[
        F.min(F.col("h").bitwiseXOR(F.lit(_mask(k)))).alias(f"m{k}") for k in range(BANDS * ROWS)])
    bands = F.array(*[
        F.xxhash64(F.lit(b), *[F.col(f"m{b * ROWS + r}") for r in range(ROWS)]) for b in range(BANDS)])
    return minima.select(F.monotonically_increasing_id().alias("id"), "h1", "h2", bands.alias("bands"))


def sketches(texts: DataFrame) -> DataFrame:
    """(id, n, s0..) of lines (id, line): n places of shingles, s0.. their sketch."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    word = F.expr(f"pmod(h >> 6, {SKETCH})")
    sketch = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(SKETCH)]
    return _hashed(texts, "id").groupBy("id").agg(F.max("n").alias("n"), *sketch)


def _named(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose id stands in the stored pairs (a, b), and few others: only these need to be shuffled."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    blocks = block_count(ids.count())
    return possible(rows, blocked_filter(ids, blocks, "id"), blocks, "id")


def _verified(pairs: DataFrame, lines: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lines have a Jaccard similarity of at least SIMILARITY."""

    def sketched(side: str) -> DataFrame:
        return lines.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", *(f"s{k}" for k in range(SKETCH)))])

    apart = sum((F.bit_count(F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b"))) for k in range(SKETCH)), F.lit(0))
    # of sizes x + y, (1 - s) / (1 + s) may differ; places are as many as shingles or more, and a rounded product loses none
    bound = (1 + SIMILARITY) * apart <= (1 - SIMILARITY) * (F.col("n_a") + F.col("n_b")) + 1e-6
    met = saved(pairs, "pairs")
    lines = _named(lines, met)
    near = saved(met.join(sketched("a"), "a").join(sketched("b"), "b").filter(bound).select("a", "b"), "near")
    discard(met)
    texts = _named(texts, near)
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("line_b"))
    both = near.join(left, "a").join(right, "b")
    sets = F.struct(shingle_set(F.col("line_a")).alias("x"), shingle_set(F.col("line_b")).alias("y"))
    sizes = _bound(sets, lambda s: F.struct(
        F.size(F.array_intersect(s["x"], s["y"])).alias("common"), (F.size(s["x"]) + F.size(s["y"])).alias("both")))
    return both.filter(_bound(sizes, lambda n: n["common"] >= SIMILARITY * (n["both"] - n["common"]))).select("a", "b")


def _rooted(members: DataFrame, links: DataFrame) -> DataFrame:
    """`members`, stored, with the component `root` of their id."""
    roots = components(links, "a", "b").select(F.col("node").alias("id"), "root")
    named = members.drop("root").join(roots, "id", "left")
    return saved(named.withColumn("root", F.coalesce("root", "id")), "placed")


def _rare_shingles(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(band, id, root, h, left, size): each line under its first shingles; `left` of its `size` shingles stand from h on."""
    by_chance = Window.partitionBy("band").orderBy(F.xxhash64("id", "band"), "id")
    drawn = members.select("band", "id", F.row_number().over(by_chance).alias("k")).filter(F.col("k") <= SAMPLE)
    told = drawn.join(texts, "id").select("band", F.explode(shingle_set(F.col("line"))).alias("h"))
    common = told.groupBy("band", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    common = common.groupBy("band").agg(F.sort_array(F.collect_list(F.struct("c", "h")))["h"].alias("common"))  # of SAMPLE lines
    sets = members.select("band", "id", "root").join(common, "band", "left").join(texts, "id").select(
        "band", "id", "root", F.coalesce("common", F.expr("cast(array() as array<bigint>)")).alias("common"),
        shingle_set(F.col("line")).alias("set"))
    order = _bound(F.struct("set", "common"), lambda s: F.concat(
        F.sort_array(F.array_except(s["set"], s["common"])), F.array_intersect(s["common"], s["set"])))
    size = F.size("ordered")
    first = F.slice("ordered", 1, (size - F.ceil(SIMILARITY * size - 1e-6) + 1).cast("int"))
    return sets.select("band", "id", "root", order.alias("ordered")).select(
        "band", "id", "root", size.alias("size"), F.posexplode(first).alias("pos", "h")).select(
        "band", "id", "root", "h", (F.col("size") - F.col("pos")).alias("left"), "size")


def _room(left: Column, size: Column, other_left: Column, other_size: Column) -> Column:
    """Whether two lines may be similar whose first common shingle leaves so many to each."""
    return F.least(left, other_left) >= SIMILARITY / (1 + SIMILARITY) * (size + other_size) - 1e-6


def _pairs(met: DataFrame, x: str = "id", y: str = "other") -> DataFrame:
    return met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _with_first(under: DataFrame, rows: DataFrame) -> DataFrame:
    """Pairs of unconnected lines of `rows` and the first line of `under` with the same shingle."""
    first = under.groupBy("band", "h").agg(F.min(F.struct("id", "root", "left", "size")).alias("first"))
    met = rows.join(first, ["band", "h"]).filter(F.col("root") != F.col("first.root"))
    met = met.filter(_room(F.col("left"), F.col("size"), F.col("first.left"), F.col("first.size")))
    return _pairs(met.select("id", F.col("first.id").alias("other")))


def _apart(under: DataFrame) -> DataFrame:
    """Rows that are not connected to the first line under their shingle."""
    first = under.groupBy("band", "h").agg(F.min_by("root", "id").alias("first_root"))
    return under.join(first, ["band", "h"]).filter("root <> first_root").drop("first_root")


def _all_unconnected(under: DataFrame) -> DataFrame:
    """Pairs of lines of different components under one shingle."""
    other = under.select("band", "h", *[F.col(c).alias(f"{c}_2") for c in ("id", "root", "left", "size")])
    both = under.join(other, ["band", "h"]).filter((F.col("id") < F.col("id_2")) & (F.col("root") != F.col("root_2")))
    return _pairs(both.filter(_room(F.col("left"), F.col("size"), F.col("left_2"), F.col("size_2"))), "id", "id_2")


def line_links(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(id, h1, h2) of the different lines, stored, and links (a, b) between their ids."""
    signed = saved(signatures(docs, text), "signed")
    dealt = signed.select("id", F.explode("bands").alias("band"))
    sizes = dealt.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = saved(dealt.join(sizes, "band"), "members")
    # only lines that share a band are compared: only these need their text and a sketch
    lines = saved(signed.select("id", "h1", "h2"), "lines")
    discard(signed)
    met = saved(members.select("id").distinct().join(lines, "id"), "met")
    blocks = block_count(met.count())
    near = possible(_lines(docs, text), blocked_filter(met, blocks, "h1"), blocks, "h1")
    texts = saved(near.join(met, ["h1", "h2"]).groupBy("id").agg(F.max("line").alias("line")), "texts")
    sketched = saved(sketches(texts), "sketched")
    discard(met)

    def verified(pairs: DataFrame) -> DataFrame:
        return saved(_verified(pairs, sketched, texts), "links")

    # every member meets the first of its bucket; lines of one component need not meet each other
    first = members.groupBy("band").agg(F.min("id").alias("other"))
    links = verified(_pairs(members.join(first, "band").filter("id <> other")))

    placed = _rooted(members.filter("n > 2"), links)
    discard(members)
    first = placed.groupBy("band").agg(F.min_by("root", "id").alias("first_root"))
    left = saved(placed.join(first, "band").filter("root <> first_root").drop("first_root"), "left")
    small = left.filter(F.col("n") <= SMALL_BUCKET).select("band", "id", "root")
    other = placed.filter(F.col("n") <= SMALL_BUCKET).select("band", F.col("id").alias("other"), F.col("root").alias("root_2"))
    pairs = _pairs(small.join(other, "band").filter("root <> root_2"))
    large = left.filter(F.col("n") > SMALL_BUCKET).select("band").distinct()
    under = saved(_rare_shingles(placed.join(large, "band", "left_semi"), texts), "under")
    several = under.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = saved(under.join(several, ["band", "h"], "left_semi"), "shared")
    discard(under)

    links = links.unionByName(verified(pairs.unionByName(_with_first(shared, shared)).distinct()))
    discard(placed, left)
    for step in (lambda rows: _with_first(_apart(rows), rows), _all_unconnected):
        rows = _rooted(shared, links)
        several = rows.groupBy("band", "h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
        still = saved(rows.join(several, ["band", "h"], "left_semi"), "shared")
        discard(rows, shared)
        shared, links = still, links.unionByName(verified(step(still)))
    discard(shared, texts, sketched)
    return lines, links


def line_classes(docs: DataFrame, occ: DataFrame, text: str) -> DataFrame:
    """(row, pos, first_doc_id) of every line to remove: all but the first of its class by (doc_id, row, pos).

    `occ` are the stored occurrences of the same rows.
    """
    lines, links = line_links(docs, text)
    roots = components(links, "a", "b").withColumnRenamed("node", "id")
    keys = lines.select("id", "h1", "h2")
    ends = keys.select(F.col("id").alias("root"), F.col("h1").alias("c1"), F.col("h2").alias("c2"))
    renamed = saved(roots.filter("id <> root").join(keys, "id").join(ends, "root").select("h1", "h2", "c1", "c2"), "classes")
    shown = occ.filter("h1 is not null")
    classed = shown.join(renamed, ["h1", "h2"], "left").select(
        "row", "doc_id", "pos", F.coalesce("c1", "h1").alias("c1"), F.coalesce("c2", "h2").alias("c2"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")
    firsts = classed.groupBy("c1", "c2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    firsts = firsts.select("c1", "c2", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), F.col("first.pos").alias("first_pos"))
    again = classed.select("row", "pos", "c1", "c2").join(firsts, ["c1", "c2"])
    return again.filter("row <> first_row or pos <> first_pos").select("row", "pos", "first_doc_id")


def duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, n_lines, removed): per row of `docs` the numbers of the lines to remove, from 0, ascending.

    Blank lines and null texts have nothing to remove. Equal and similar lines of one text count like those of two.
    A null doc_id comes after all others, ties go by row. An empty table gives no rows.
    """
    row = free_name(docs, "row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    occ = saved(occurrences(numbered, text, doc_id, row), "occurrences")
    return _per_row(occ, line_classes(docs, occ, text))


def _per_row(occ: DataFrame, again: DataFrame) -> DataFrame:
    removed = again.groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("removed"))  # lines of one text
    rows = occ.groupBy("row", "doc_id").agg(F.count("pos").alias("n_lines"))
    none = F.expr("cast(array() as array<int>)")
    return rows.join(removed, "row", "left").select("row", "doc_id", "n_lines", F.coalesce("removed", none).alias("removed"))


def drop_duplicate_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: str | None = None) -> DataFrame:
    """`docs` with all columns and the first line of each class left; a text may end up empty, no row goes.

    `length` names a column to set to the number of characters that are left.
    """
    row, gone = free_name(docs, "row"), free_name(docs, "removed")
    stored = saved(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    occ = saved(occurrences(stored, text, doc_id, row), "occurrences")
    again = line_classes(stored, occ, text)
    removed = saved(again.groupBy(F.col("row").alias(row)).agg(F.collect_set("pos").alias(gone)), "removed")
    discard(occ)  # and the shuffles of lines are gone before the texts are shuffled
    kept = F.array_join(
        F.filter(F.split(quoted(text), "\n"), lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    left = F.when(F.col(gone).isNull(), quoted(text)).otherwise(kept)
    out = stored.join(removed, row, "left")
    columns = [left.alias(c) if c == text else quoted(c) for c in docs.columns]
    if length is not None:
        columns = [F.length(left).cast(docs.schema[c].dataType).alias(c) if c == length else x for c, x in zip(docs.columns, columns)]
    return out.select(*columns)


def op1(spark, folder: str) -> DataFrame:
    found = duplicate_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")
