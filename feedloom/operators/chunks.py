"""Sections, oversize splitting and greedy packing under a word budget, all inside the row of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import (
    SPACE, cjk_chars, mixed_words, plain_words, split_words, trim_space, weighted, words_beside_cjk,
)

SECTION_BREAK = r"\n(?=#{1,6}[ \t])"
SENTENCE_END = rf"([.!?。！？])[{SPACE}]+"
SENTENCE_BREAK = rf"(?<=[.!?。！？])[{SPACE}]+"
MARK = "\x01"  # stands for the space after a sentence


def chunk_starts(words: Column, budget: int) -> Column:
    """1-based positions where a new chunk starts. A fragment above the budget stands alone. The state holds chunk
    starts only, so the cost is linear in the fragments."""

    def step(acc: Column, w: Column) -> Column:
        full = (acc["at"] > 1) & (acc["used"] + w > budget)
        return F.struct(
            F.when(full, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(full, w).otherwise(acc["used"] + w).alias("used"), (acc["at"] + 1).alias("at"),
        )

    zero = F.struct(
        F.array(F.lit(1)).alias("starts"), F.lit(0).cast("bigint").alias("used"), F.lit(1).alias("at")
    )
    return F.when(F.size(words) > 0, F.aggregate(words, zero, step, lambda acc: acc["starts"])).otherwise(
        F.array().cast("array<int>")
    )


def chunk_pack(
    rows: DataFrame, key: str, fragments: str, budget: int, joiner: str = "\n\n", words: str | None = None
) -> DataFrame:
    """One row per chunk of the ordered fragments (an array column) of each row; `words` names an array of their sizes,
    which are counted when it is not given."""
    sizes = F.col(words) if words else F.transform(fragments, lambda f: plain_words(f))
    counted = rows.select(key, F.col(fragments).alias("_f"), sizes.alias("_w"))
    packed = counted.withColumn("_s", chunk_starts(F.col("_w"), budget))

    def chunk(start: Column, i: Column) -> Column:
        size = F.coalesce(F.get(F.col("_s"), i + 1), F.size("_f") + 1) - start
        used = F.slice("_w", start, size)
        return F.struct(
            i.alias("chunk_no"), size.alias("fragments"),
            F.aggregate(used, F.lit(0).cast("bigint"), lambda a, w: a + w).alias("words"),
            trim_space(F.array_join(F.slice("_f", start, size), joiner)).alias("text"),
        )

    return packed.select(key, F.size("_s").alias("chunk_count"), F.inline(F.transform("_s", chunk)))


def section_split(rows: DataFrame, key: str, markdown: str, budget: int) -> DataFrame:
    """Heading-led sections in order; a section within the budget stays whole."""
    parts = F.split(F.col(markdown), SECTION_BREAK)
    sections = rows.select(key, F.posexplode(parts).alias("section_no", "text"))
    counted = sections.withColumn("words", mixed_words(F.col("text")))
    return counted.withColumn("fits", F.col("words") <= budget)


def counted(text: Column) -> Column:
    """A text with its counts. Counts of parts add up to those of the parts joined by white space, so no text is counted
    again after joining."""
    return F.struct(text.alias("t"), words_beside_cjk(text).alias("w"), cjk_chars(text).alias("c"))


def size_of(part: Column) -> Column:
    return weighted(part["w"], part["c"])


def _joined(parts: Column, joiner: str) -> Column:
    def total(field: str) -> Column:
        return F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a + p[field])

    text = F.array_join(F.transform(parts, lambda p: p["t"]), joiner)
    return F.struct(text.alias("t"), total("w").alias("w"), total("c").alias("c"))


def _pack_parts(parts: Column, joiner: str, budget: int) -> Column:
    """Greedy runs of counted parts, each joined to one part."""

    def runs(counted_parts: Column) -> Column:
        starts = chunk_starts(F.transform(counted_parts, lambda p: size_of(p)), budget)
        return F.transform(F.array(starts), lambda at: F.transform(at, lambda start, i: _joined(
            F.slice(counted_parts, start, F.coalesce(F.get(at, i + 1), F.size(counted_parts) + 1) - start), joiner)))

    return F.flatten(F.flatten(F.transform(F.array(parts), runs)))


def _word_runs(block: Column, budget: int) -> Column:
    return F.flatten(F.transform(F.array(split_words(block)), lambda ws: F.transform(
        F.sequence(F.lit(1), F.size(ws), F.lit(budget)), lambda i: counted(F.array_join(F.slice(ws, i, budget), " "))
    )))


def oversize_pieces(block: Column, budget: int) -> Column:
    """Pieces of a counted block: itself when it fits, else runs of lines, of sentences, or of words."""
    lines = F.split(block["t"], "\n")
    # A replacement keeps its compiled pattern, and one character splits without a pattern. Texts that hold the mark
    # itself take the slower way.
    marked = F.split(F.regexp_replace(block["t"], SENTENCE_END, f"$1{MARK}"), MARK)
    parts = F.when(F.contains(block["t"], F.lit(MARK)), F.split(block["t"], SENTENCE_BREAK)).otherwise(marked)
    sentences = F.filter(parts, lambda s: s != "")

    def by_sentence(found: Column) -> Column:
        packed = _pack_parts(F.transform(found, lambda x: counted(x)), " ", budget)
        return F.when(F.size(found) > 1, packed).otherwise(_word_runs(block["t"], budget))

    return (
        F.when(size_of(block) <= budget, F.array(block))
        .when(F.size(lines) > 1, _pack_parts(F.transform(lines, lambda x: counted(x)), "\n", budget))
        .otherwise(F.flatten(F.transform(F.array(sentences), by_sentence)))
    )


def oversize_split(rows: DataFrame, key: str, block: str, budget: int) -> DataFrame:
    sized = rows.withColumn(block, counted(F.col(block)))
    pieces = sized.select(*[c for c in rows.columns if c != block], F.posexplode(oversize_pieces(F.col(block), budget)).alias("piece_no", "_p"))
    return pieces.withColumns({"text": F.col("_p.t"), "words": size_of(F.col("_p"))}).drop("_p")


def markdown_chunks(rows: DataFrame, key: str, markdown: str, budget: int) -> DataFrame:
    """Sections kept whole where they fit, other blocks split, then packed into chunks within the budget."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(markdown), F.lit("")), "^\\x{FEFF}", ""), "\r\n?", "\n")
    blocks = F.filter(F.split(clean, r"\n[ \t]*\n\s*"), lambda b: trim_space(b) != "")
    tidy = rows.select(key, F.array_join(blocks, "\n\n").alias("_text"))
    sections = F.filter(F.split("_text", r"\n\n(?=#{1,6}[ \t])"), lambda s: s != "")
    sized = tidy.withColumn("_sections", F.transform(sections, lambda s: F.transform(F.split(s, "\n\n"), lambda b: counted(b))))

    def pieces(section: Column) -> Column:
        size = F.aggregate(section, F.lit(0).cast("bigint"), lambda a, b: a + size_of(b))
        split = F.flatten(F.transform(section, lambda b: oversize_pieces(b, budget)))
        return F.when(size <= budget, F.array(_joined(section, "\n\n"))).otherwise(split)

    cut = sized.withColumn("_pieces", F.flatten(F.transform("_sections", pieces)))
    parts = cut.select(key, F.transform("_pieces", lambda p: p["t"]).alias("_texts"), F.transform("_pieces", lambda p: size_of(p)).alias("_sizes"))
    return chunk_pack(parts, key, "_texts", budget, words="_sizes")


def assemble_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """Texts of documents whose chunks are all there, in order; an incomplete set gives an error, never a part."""
    # A chunk that arrived many times folds to one row first, so a document brings no more rows than it has chunks.
    once = chunks.groupBy(key, "chunk_no").agg(F.max("chunk_count").alias("chunk_count"), F.min("text").alias("text"))
    whole = once.groupBy(key).agg(
        F.max("chunk_count").alias("expected"), F.count(F.lit(1)).alias("present"),
        F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("_parts"),
    )
    complete = F.col("present") == F.col("expected")
    text = F.array_join(F.transform("_parts", lambda p: trim_space(p["text"])), "\n\n")
    return whole.select(
        key, "expected", "present", F.when(complete, text).alias("text"),
        F.when(~complete, F.lit("incomplete chunks")).alias("error"),
    )
