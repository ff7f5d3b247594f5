"""Secret scan with a trigram inverted index; DataFrame functions only on the main path.

Each rule's regular expression yields a Boolean query over trigrams: alternatives, of which one
must have all its trigrams in a text that the rule can match. The index lists, for each trigram
that some query needs, the texts that hold it. Intersecting those lists gives each rule's
candidates, and the expression itself then verifies them. A rule without a mandatory trigram is
run over every text.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of one group of a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules, then the rules added here, in the order that ties follow.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_password", r"://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)
RULES = BASE + ADDED

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
MOST = 64


def _both(a: Query, b: Query) -> Query:
    joined = {x | y for x in a for y in b}
    least = frozenset(x for x in joined if not any(y < x for y in joined))
    return least if len(least) <= MOST else min(a, b, key=lambda q: (frozenset() in q, len(q)))


def _trigrams(words: set[str]) -> Query:
    return _both(frozenset(frozenset(w[i:i + 3] for i in range(len(w) - 2)) for w in words), ANY)


def _literals(item) -> set[str] | None:
    """All strings that an item matches, in lower case, if they are few; else None."""
    kind, value = item
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN:
        chars: set[str] = set()
        for k, v in value:
            if k is op.LITERAL:
                chars.add(chr(v).lower())
            elif k is op.RANGE and v[1] - v[0] < 8:
                chars.update(chr(c).lower() for c in range(v[0], v[1] + 1))
            else:
                return None
        return chars if len(chars) <= 8 else None
    if kind is op.SUBPATTERN:
        return _product(value[3])
    if kind is op.BRANCH:
        parts = [_product(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind is op.MAX_REPEAT and value[1] == 1:
        part = _product(value[2])
        return None if part is None else part | ({""} if value[0] == 0 else set())
    return None


def _product(items) -> set[str] | None:
    words = {""}
    for item in items:
        part = _literals(item)
        if part is None or len(words) * len(part) > MOST:
            return None
        words = {w + p for w in words for p in part}
    return words


def _query(items) -> Query:
    found, words = ANY, {""}
    for item in items:
        part = _literals(item)
        if part is not None and len(words) * len(part) <= MOST:
            words = {w + p for w in words for p in part}
            continue
        found, words = _both(found, _trigrams(words)), {""}
        kind, value = item
        if part is not None:
            words = part
        elif kind is op.SUBPATTERN:
            found = _both(found, _query(value[3]))
        elif kind is op.BRANCH:
            found = _both(found, _both(frozenset().union(*(_query(p) for p in value[1])), ANY))
        elif kind is op.MAX_REPEAT and value[0] > 0:
            found = _both(found, _query(value[2]))
    return _both(found, _trigrams(words))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, in lower case, that a match needs; ``{{}}`` if it needs none."""
    return _query(_parser.parse(pattern))


def postings(texts: DataFrame, key: str, text: str, trigrams: list[str]) -> DataFrame:
    """The index: one line ``trigram, key`` for each needed trigram that a text holds."""
    wanted = F.array(*[F.lit(t) for t in trigrams])
    # The one-element array binds the lower-cased text once for all look-ups.
    held = F.transform(F.array(F.lower(F.col(text))), lambda s: F.filter(wanted, lambda t: F.contains(s, t)))[0]
    return texts.select(F.explode(held).alias("trigram"), F.col(key))


def candidates(index: DataFrame, key: str, queries: dict[str, Query]) -> DataFrame:
    """``key`` and the rules whose query its text fulfils, from the intersected postings."""
    lines = [
        (t, rule, number, 1 << bit, (1 << len(alternative)) - 1)
        for rule, query in queries.items()
        for number, alternative in enumerate(sorted(map(sorted, query)))
        for bit, t in enumerate(alternative)
    ]
    asked = index.sparkSession.createDataFrame(lines, "trigram string, rule string, alternative int, bit long, all long")
    return (
        index.join(F.broadcast(asked), "trigram").groupBy(key, "rule", "alternative", "all")
        .agg(F.bit_or("bit").alias("bits")).filter(F.col("bits") == F.col("all"))
        .groupBy(key).agg(F.collect_set("rule").alias("rules"))
    )


SPAN = "struct<start:int,no:int,stop:int,kind:string>"


def _matches(text: Column, no: int, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule, in code points; short groups are dropped."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern, -1).alias("before"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("group"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + F.length(part["before"])
        stop = begin + F.coalesce(F.length(part["hit"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(no).alias("no"), stop.alias("stop"), F.lit(rule.kind).alias("kind"))
        fits = F.length(part["group"]) >= rule.least
        return F.struct(stop.alias("at"), F.when(fits, F.concat(done["out"], F.array(span.cast(SPAN)))).otherwise(done["out"]).alias("out"))

    found = F.aggregate(parts, start, step, lambda done: done["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_secrets(docs: DataFrame, text: str, rules: tuple[Rule, ...] = RULES, out: str = "spans") -> DataFrame:
    """``docs`` with the array ``out`` of spans ``start, no, stop, kind`` of every whole text.

    Spans are ordered by start, then by the rules' order; start and stop are code points, stop
    exclusive; spans of different rules may overlap. Null and empty texts have none; very long
    texts are searched whole; an empty table stays empty; other columns pass through, and a
    column named ``out`` is replaced. Texts meet the index by a 64-bit hash: equal texts share
    their entry, and a chance collision only adds a candidate, which verification settles.
    A text that very many rows repeat is one key of a plain equi-join, which Spark splits.
    """
    if len({r.kind for r in rules}) < len(rules):
        raise ValueError("each rule needs a kind of its own")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    scanned = {k for k, q in queries.items() if frozenset() in q}
    queries = {k: q for k, q in queries.items() if k not in scanned}
    kept = [F.col(f"`{c}`") for c in docs.columns if c != out]
    keyed = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", F.xxhash64("text"))
    if queries:
        needed = sorted({t for q in queries.values() for a in q for t in a})
        chosen = candidates(postings(keyed, "key", "text", needed), "key", queries)
        keyed = keyed.join(chosen, "key", "left")
    else:
        keyed = keyed.withColumn("rules", F.array().cast("array<string>"))
    none = F.array().cast(f"array<{SPAN}>")
    found = [
        _matches(F.col("text"), i, r) if r.kind in scanned
        else F.when(F.array_contains("rules", r.kind), _matches(F.col("text"), i, r)).otherwise(none)
        for i, r in enumerate(rules)
    ]
    return keyed.select("row.*", F.array_sort(F.concat(*found)).alias(out))
