"""Secret scans with a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query: every match contains, for each clause, all trigrams of one of
its alternatives. The index has the posting (trigram, text) for the trigrams that some rule asks for, in ASCII
lower case; a text stands there as 128 bits of hash, once for all its copies. Postings are intersected by adding up the
trigrams of a text as bits before the shuffle. Texts that satisfy a rule's query are verified with its expression; a
rule without a mandatory trigram scans all texts. DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import free_name, quoted, saved

Clause = frozenset[frozenset[str]]
MOST_STRINGS = 32
WORD_BITS = 62


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regular expression, and the least length of one of its groups (0: the match)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def expression(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # a run is matched whole, so shorter runs need no mention
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i:i + 3] for i in range(len(text) - 2))


def _strings(node: tuple) -> set[str] | None:
    """All strings a part of an expression can match, lower-cased, if they are few; None otherwise."""
    kind, value = node
    if kind is sre.LITERAL:
        return {chr(value).lower()}
    if kind is sre.IN:
        found: set[str] = set()
        for what, item in value:
            if what is sre.LITERAL:
                found.add(chr(item).lower())
            elif what is sre.RANGE and item[1] - item[0] < MOST_STRINGS:
                found |= {chr(c).lower() for c in range(item[0], item[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is sre.SUBPATTERN:
        return _sequence_strings(value[3])
    if kind is sre.BRANCH:
        every = [_sequence_strings(branch) for branch in value[1]]
        return None if any(x is None for x in every) else set().union(*every)
    if kind is sre.MAX_REPEAT and value[1] == 1:
        inner = _sequence_strings(value[2])
        return None if inner is None else inner | ({""} if value[0] == 0 else set())
    return None


def _sequence_strings(nodes) -> set[str] | None:
    made = {""}
    for node in nodes:
        few = _strings(node)
        if few is None or len(made) * len(few) > MOST_STRINGS:
            return None
        made = {a + b for a in made for b in few}
    return made


def _clause(strings: set[str]) -> Clause | None:
    """One alternative per string; None (no demand) if a string is shorter than a trigram."""
    sets = {trigrams(s) for s in strings}
    if frozenset() in sets:
        return None
    return frozenset(s for s in sets if not any(t < s for t in sets))


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses that every match satisfies; an empty list asks for a full scan."""
    return _demands(list(sre_parser.parse(pattern)))


def _demands(nodes: list[tuple]) -> list[Clause]:
    clauses: list[Clause] = []
    run: set[str] = {""}

    def end(strings: set[str]) -> None:
        if (clause := _clause(strings)) is not None and clause not in clauses:
            clauses.append(clause)

    for node in nodes:
        few = _strings(node)
        if few is not None and len(run) * len(few) <= MOST_STRINGS:
            run = {a + b for a in run for b in few}
            continue
        end(run)
        run = few if few is not None else {""}
        if few is None:
            kind, value = node
            if kind is sre.SUBPATTERN:
                clauses += [c for c in _demands(list(value[3])) if c not in clauses]
            elif kind is sre.MAX_REPEAT and value[0] >= 1:
                clauses += [c for c in _demands(list(value[2])) if c not in clauses]
    end(run)
    return clauses


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def postings(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """(gram, k1, k2): the texts that contain each wanted trigram; `texts` has a column text without nulls.

    The lower-cased text is searched as a whole; a cheap test for any of the wanted trigrams' first letters is not needed.
    """
    low = texts.select(*_text_key(F.col("text")), _ascii_lower(F.col("text")).alias("low"))
    found = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(n)) for n, g in enumerate(wanted)]))
    return low.select("k1", "k2", F.explode(found).alias("gram"))


def candidates(index: DataFrame, wanted: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(k1, k2, rules): the numbers of the indexed rules whose query a text satisfies."""
    words = -(-len(wanted) // WORD_BITS)
    bits = [
        F.bit_or(F.when(F.floor(F.col("gram") / WORD_BITS) == w, F.call_function(
            "shiftleft", F.lit(1).cast("long"), F.pmod(F.col("gram"), F.lit(WORD_BITS)).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"b{w}")
        for w in range(words)
    ]
    held = index.groupBy("k1", "k2").agg(*bits)

    def holds(grams: frozenset[str]) -> Column:
        every = F.lit(True)
        for w in range(words):
            mask = sum(1 << (n % WORD_BITS) for n, g in enumerate(wanted) if g in grams and n // WORD_BITS == w)
            if mask:
                every = every & (F.col(f"b{w}").bitwiseAND(F.lit(mask)) == mask)
        return every

    fits = []
    for n, rule in enumerate(rules):
        clauses = trigram_query(rule.pattern)
        if clauses:
            every = F.lit(True)
            for clause in clauses:
                some = F.lit(False)
                for grams in clause:
                    some = some | holds(grams)
                every = every & some
            fits.append(F.when(every, F.lit(n)))
    return held.select("k1", "k2", F.array_compact(F.array(*fits)).alias("rules")).filter(F.size("rules") > 0)


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """Leftmost matches that do not overlap, as (start, rule, end) in code points; too short ones are left out at last."""
    expression = F.lit(rule.expression)
    whole, between = F.regexp_extract_all(text, expression, 0), F.split(text, rule.expression, -1)
    parts = F.arrays_zip(F.transform(between, F.length).alias("b"), F.transform(whole, F.length).alias("w"),
                         F.transform(F.regexp_extract_all(text, expression, rule.group), F.length).alias("g"))
    kind = "struct<at:int,found:array<struct<start:int,rule:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rule:int,end:int>>").alias("found")).cast(kind)

    def step(state: Column, part: Column) -> Column:
        low = state["at"] + part["b"]
        high = low + F.coalesce(part["w"], F.lit(0))
        span = F.struct(low.alias("start"), F.lit(number).alias("rule"), high.alias("end"))
        good = part["w"].isNotNull() & (part["g"] >= rule.least)
        found = F.when(good, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        return F.struct(high.alias("at"), found.alias("found")).cast(kind)

    return F.aggregate(parts, start, step, lambda state: state["found"])


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "spans") -> DataFrame:
    """`docs` with `name`: array of (start, rule, end), by start, then rule, of all secrets of the whole text.

    `rule` is the place in `rules`; offsets are code points, the end exclusive. A null or empty text has none; repeated
    rows get the same spans each, and an empty table gives no rows. Names of columns may clash with none used here.
    """
    whole = F.coalesce(quoted(text), F.lit(""))
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({g for clauses in queries for clause in clauses for grams in clause for g in grams})
    index = saved(postings(docs.select(whole.alias("text")), wanted), "postings")
    found = saved(candidates(index, wanted, rules), "candidates")
    k1, k2, held = free_name(docs, "k1"), free_name(docs, "k2"), free_name(docs, "rules")
    found = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("rules").alias(held))
    keys = _text_key(whole)
    rows = docs.withColumns({k1: keys[0], k2: keys[1]}).join(found, [k1, k2], "left")
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    parts = []
    for n, rule in enumerate(rules):
        chosen = F.coalesce(F.array_contains(held, n), F.lit(False)) if queries[n] else F.lit(True)
        parts.append(F.when(chosen & whole.rlike(rule.expression), rule_spans(whole, rule, n)).otherwise(none))
    spans = F.array_sort(F.flatten(F.array(*parts)))
    return rows.select(*[quoted(c) for c in docs.columns], spans.alias(name))


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op3(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = scan(docs)

    def count(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == n)).cast("long")

    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))
    return found.select(
        "doc_id", *[count(n).alias(f"n_{r.kind}") for n, r in enumerate(BASE_RULES)],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
