"""Secret scan over a trigram inverted index, with built-in functions only.

Each rule's regular expression is parsed once on the driver and turned into a
Boolean query of trigrams that every match must contain (lower case). The index
holds postings (trigram, doc_id) of the trigrams that some query uses. Postings
are intersected for each document, the candidates fetch their text, and the
regular expression verifies them. A rule without a mandatory trigram is run on
every text.

Spans come from splitting a text at the matches: gap and match lengths add up to
positions in code points. Matches that fail a rule's length test are dropped
after matching, so they still use up their characters.

Defined results: NULL text is empty; NULL doc_ids share their postings (a
superset, verified on each text); repeated rows repeat their result; texts of any
length are scanned whole; other columns are carried by ``scan`` if asked for.
"""

from __future__ import annotations

import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surtscope.llm.common import materialise
from surtscope.operators.fences import computed_once


@dataclass(frozen=True)
class Rule:
    """``pattern`` in the syntax that Java and Python share; ``group`` of a match
    must have ``least`` characters. ``ignore_case`` is for ASCII letters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False
    base: bool = True

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


#: The patterns of the three base kinds.
RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=12,
        ignore_case=True,
    ),
    Rule("access", "(AKIA[A-Z0-9]+)", least=18),
    Rule("hex", "([0-9a-f]+)", least=16),
    Rule("pem", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", base=False),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})", base=False),
)

#: Trigrams of one literal string that a query asks for at most.
_PER_LITERAL = 4
_MANY_STRINGS = 16
_ALWAYS: tuple = ("all",)


def _and(parts: list[tuple]) -> tuple:
    parts = [p for p in parts if p != _ALWAYS]
    if not parts:
        return _ALWAYS
    return parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list[tuple]) -> tuple:
    if not parts or _ALWAYS in parts:
        return _ALWAYS
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> tuple:
    """Any of the strings occurs."""
    choices = []
    for s in sorted(strings):
        grams = list(dict.fromkeys(s[k : k + 3] for k in range(len(s) - 2)))[:_PER_LITERAL]
        choices.append(_and([("tri", g) for g in grams]))
    return _or(choices)


def _walk(items) -> tuple[set[str] | None, tuple]:
    """(all strings the items can match, or None; query that a match fulfils)."""
    run: set[str] | None = {""}
    whole, queries = True, []

    def close() -> None:
        nonlocal run, whole
        queries.append(_of_strings(run))
        run, whole = {""}, False

    for op, value in items:
        op = str(op)
        strings: set[str] | None = None
        query = _ALWAYS
        if op == "LITERAL":
            strings = {chr(value).lower()}
        elif op == "SUBPATTERN":
            strings, query = _walk(value[3])
        elif op == "BRANCH":
            found = [_walk(branch) for branch in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
            query = _or([q for _, q in found])
        elif op == "MAX_REPEAT":
            low, high, sub = value
            inner, query = _walk(sub)
            if (low, int(high)) == (0, 1) and inner is not None and len(inner) == 1:
                strings = inner | {""}
            if low == 0:
                query = _ALWAYS
        if strings is not None and len(strings) * len(run) <= _MANY_STRINGS:
            run = {a + b for a in run for b in strings}
        else:
            close()
            queries.append(query)
    if whole:
        return run, _of_strings(run)
    queries.append(_of_strings(run))
    return None, _and(queries)


def trigram_query(rule: Rule) -> tuple:
    """The rule's Boolean query: ('tri', t), ('and', ...), ('or', ...) or ('all',)."""
    return _walk(parser.parse(rule.pattern))[1]


def query_trigrams(query: tuple) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(query_trigrams(q) for q in query[1:])) if query != _ALWAYS else set()


def build_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id) of the given trigrams, stored sorted by trigram."""
    body = F.lower(F.coalesce("text", F.lit("")))
    low = computed_once(docs.select("doc_id", "text"), {"low": body})
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)))
    postings = low.select("doc_id", F.explode(present).alias("trigram"))
    return materialise(postings.sortWithinPartitions("trigram"), "trigram-index")


def _holds(query: tuple, has) -> Column:
    if query[0] == "tri":
        return has(query[1])
    parts = [_holds(q, has) for q in query[1:]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


def candidates(index: DataFrame, queries: dict[str, tuple], trigrams: list[str]) -> DataFrame:
    """(doc_id, one boolean column for each rule) where some query holds.

    Postings of a document meet as bits, so the intersection combines before its
    shuffle and no posting list gathers in one task.
    """
    chunks = [trigrams[k : k + 62] for k in range(0, len(trigrams), 62)]
    masks = []
    for n, chunk in enumerate(chunks):
        bit = F.lit(0).cast("long")
        for k, t in enumerate(chunk):
            bit = F.when(F.col("trigram") == t, F.lit(1 << k).cast("long")).otherwise(bit)
        masks.append(F.bit_or(bit).alias(f"bits{n}"))
    place = {t: (f"bits{n}", 1 << k) for n, chunk in enumerate(chunks) for k, t in enumerate(chunk)}
    has = lambda t: F.col(place[t][0]).bitwiseAND(F.lit(place[t][1]).cast("long")) != 0
    flags = {name: _holds(q, has) for name, q in queries.items()}
    seen = index.groupBy("doc_id").agg(*masks).select("doc_id", *(c.alias(f"may_{n}") for n, c in flags.items()))
    any_of = F.lit(False)
    for name in queries:
        any_of = any_of | F.col(f"may_{name}")
    return seen.where(any_of)


_SPANS = "array<struct<start:bigint,ord:int,end:bigint>>"


def _spans(rule: Rule, order: int, body: Column) -> Column:
    """Spans of the rule's matches that are long enough."""
    pattern = rule.java
    if rule.kind == "hex":  # runs are maximal, so shorter ones need not be cut out
        pattern = f"([0-9a-f]{{{rule.least},}})"
    matches = F.regexp_extract_all(body, F.lit(pattern), F.lit(0))
    gaps = F.split(body, pattern, -1)
    pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    part = (lambda m: m) if rule.group == 0 else (lambda m: F.regexp_extract(m, pattern, rule.group))

    def step(a: Column, x: Column) -> Column:
        start = a["pos"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.array(F.struct(start.cast("long").alias("start"), F.lit(order).alias("ord"), end.cast("long").alias("end")))
        out = F.when(F.length(part(x["m"])) >= rule.least, F.concat(a["out"], span)).otherwise(a["out"])
        return F.struct(end.cast("long").alias("pos"), out.cast(_SPANS).alias("out"))

    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(_SPANS).alias("out"))
    return F.aggregate(pairs, zero, step, lambda a: a["out"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, carried columns, secrets): secrets is a sorted array of
    (start, ord, end), where ord is the rule's place in ``rules``."""
    queries = {r.kind: trigram_query(r) for r in rules}
    indexed = {k: q for k, q in queries.items() if q != _ALWAYS}
    frame = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__body"), *(F.col(c).alias(f"__{c}") for c in carry))
    if indexed:
        trigrams = sorted(set().union(*(query_trigrams(q) for q in indexed.values())))
        found = candidates(build_index(docs, trigrams), indexed, trigrams).withColumnRenamed("doc_id", "__id")
        frame = frame.join(found, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    parts = []
    for k, rule in enumerate(rules):
        spans = _spans(rule, k, F.col("__body"))
        parts.append(F.when(F.col(f"may_{rule.kind}"), spans).otherwise(F.array().cast(_SPANS)) if rule.kind in indexed else spans)
    out = computed_once(frame, {"secrets": F.array_sort(F.concat(*parts))})
    return out.select("doc_id", F.col("__body").alias("text"), *(F.col(f"__{c}").alias(c) for c in carry), "secrets")


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans."""
    found = scan(docs, rules)
    base = [k for k, r in enumerate(rules) if r.base]

    def count(k: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["ord"] == k)).cast("long").alias(f"n_{rules[k].kind}")

    return found.select(
        "doc_id",
        *(count(k) for k in base),
        F.sha2(_listed(F.filter("secrets", lambda s: s["ord"].isin(base)), rules), 256).alias("base_sha256"),
        _listed(F.col("secrets"), rules).alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span, overlapping ones together, replaced by ``mark``."""
    zero = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = s["start"] >= a["pos"]
        between = F.substring(text, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int"))
        return F.struct(
            F.greatest(a["pos"], s["end"]).alias("pos"),
            F.when(new, F.concat(a["out"], between, F.lit(mark))).otherwise(a["out"]).alias("out"),
        )

    rest = lambda a: F.concat(a["out"], F.substring(text, (a["pos"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, zero, step, rest))
