"""Secret scans over a trigram inverted index.

Each rule's regular expression is parsed and turned into a Boolean trigram query: literal runs give the AND of their trigrams,
alternatives an OR, anything else nothing. The index holds, for every trigram that some query names, the documents whose
lower-cased text contains it. Postings are intersected per document, which leaves the candidates of each rule; only they are searched by
the rule itself. A rule without a mandatory trigram (hexadecimal runs) searches every text. DataFrame functions only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gapweave.llm import common
from gapweave.plans.storage import materialize


@dataclass(frozen=True)
class Rule:
    """``kind`` names the spans; a match counts if group ``group`` has ``least`` characters; base rules have a count column."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The three base rules as given, then two formats of published key types.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)

Query = frozenset  # of frozensets of trigrams: an OR of ANDs; the empty AND is always true


def _trigrams(words: set[str]) -> Query:
    return frozenset(frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words)


def _and(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b)


def trigram_query(pattern: str) -> Query:
    """OR of ANDs of trigrams (lower case) that any match must contain; ``{frozenset()}`` if nothing is mandatory."""
    from re import _parser

    everything: Query = frozenset([frozenset()])

    def exact(items) -> set[str] | None:
        """All strings that a sequence can match, if these are few literals."""
        out = {""}
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                part = {chr(arg).lower()}
            elif name == "IN" and len(arg) <= 16 and all(str(x[0]) == "LITERAL" for x in arg):
                part = {chr(x[1]).lower() for x in arg}
            elif name == "SUBPATTERN":
                part = exact(arg[3])
            elif name == "BRANCH":
                subs = [exact(x) for x in arg[1]]
                part = None if any(s is None for s in subs) else set().union(*subs)
            elif name == "MAX_REPEAT" and arg[1] == 1 and (sub := exact(arg[2])) is not None:
                part = sub | {""} if arg[0] == 0 else sub
            else:
                return None
            if part is None or len(out) * len(part) > 64:
                return None
            out = {x + y for x in out for y in part}
        return out

    def walk(items) -> Query:
        found, run = everything, {""}

        def close() -> None:
            nonlocal found, run
            found, run = _and(found, _trigrams(run)), {""}

        for item in items:
            part = exact([item])
            if part is not None and len(run) * len(part) <= 64:
                run = {x + y for x in run for y in part}
                continue
            close()
            op, arg = item
            name = str(op)
            if part is not None:
                run = part
            elif name == "SUBPATTERN":
                found = _and(found, walk(arg[3]))
            elif name == "BRANCH":
                found = _and(found, frozenset().union(*[walk(x) for x in arg[1]]))
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                found = _and(found, walk(arg[2]))
        close()
        return frozenset(q for q in found if not any(o < q for o in found))

    return walk(_parser.parse(pattern))


def _key(df: DataFrame) -> Column:
    """Rows of one id share postings: a superset of each one's candidates, and the search itself is exact."""
    return F.coalesce(F.concat(F.lit("i"), df["doc_id"].cast("string")), F.lit("null"))


def build_index(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(trigram, key)``: the postings of every trigram that a rule's query names."""
    named = sorted({t for r in rules for q in trigram_query(r.pattern) for t in q})
    low = docs.select(_key(docs).alias("key"), F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    if not named:
        return low.where("false").select(F.lit("").alias("trigram"), "key")
    has = F.filter(F.array(*[F.lit(t) for t in named]), lambda t: F.contains(F.col("low"), t))
    return low.select("key", F.explode(has).alias("trigram")).select("trigram", "key")


def candidates(index: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(key, kinds)``: documents on the intersected postings of at least one rule. At most one posting per named trigram meets for a document."""
    per_doc = index.groupBy("key").agg(F.collect_set("trigram").alias("_has"))
    kinds = []
    for r in rules:
        query = trigram_query(r.pattern)
        if frozenset() not in query:
            any_of = [reduce(lambda a, b: a & b, [F.array_contains("_has", t) for t in sorted(q)]) for q in sorted(query, key=sorted)]
            kinds.append(F.when(reduce(lambda a, b: a | b, any_of), F.lit(r.kind)))
    if not kinds:
        return per_doc.where("false").select("key", F.array().cast("array<string>").alias("kinds"))
    return per_doc.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end, size) of a rule's matches, code points: lengths of what lies between matches add up to their places."""
    between = F.split(text, rule.pattern, -1)
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,size:int>>").alias("out"))
    steps = F.arrays_zip(between.alias("b"), found.alias("m"), part.alias("p"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.char_length(x["b"])
        end = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        one = F.struct(start.alias("start"), end.alias("end"), F.coalesce(F.char_length(x["p"]), F.lit(0)).alias("size"))
        return F.struct(end.alias("pos"), F.when(x["m"].isNotNull() & (one["size"] >= rule.least), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _numbered(spans: Column, rule: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(rule).alias("rule"), x["end"].alias("end")))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """All rows and columns of ``docs`` plus ``spans``: array of (start, kind, end) by start, then rule order; ``kind`` is the rule's name.

    NULL text is searched as empty; an empty table gives an empty result; equal ids share candidates but each row is searched by itself.
    A column of ``docs`` named ``spans`` is replaced.
    """
    rest = [c for c in docs.columns if c.lower() != "spans"]
    k, kinds, per = (common.unique_name(docs, n) for n in ("_key", "_kinds", "_per"))
    index = materialize(build_index(docs, rules), "secret-postings")
    cand = materialize(candidates(index, rules), "secret-candidates").withColumnsRenamed({"key": k, "kinds": kinds})
    rows = docs.withColumn(k, _key(docs)).join(cand, k, "left")
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<struct<start:int,end:int,size:int>>")
    every = []
    for at, r in enumerate(rules):
        needs_all = frozenset() in trigram_query(r.pattern)
        ask = F.lit(True) if needs_all else F.coalesce(F.array_contains(kinds, r.kind), F.lit(False))
        own = F.when(ask & text.rlike(r.pattern), _spans(text, r)).otherwise(none)
        every.append(_numbered(own, at))
    rows = rows.withColumn(per, F.array_sort(F.concat(*every)))
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform(per, lambda x: F.struct(x["start"].alias("start"), F.get(names, x["rule"]).alias("kind"), x["end"].alias("end")))
    return rows.select(*[F.col(f"`{c}`") for c in rest], spans.alias("spans"))


def redact(scanned: DataFrame) -> Column:
    """The text with every span (overlapping ones as one) replaced by ``[SECRET]``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        out = F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0))), F.lit("[SECRET]"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, out).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, 2147483647)))
    return F.when(F.size("spans") > 0, done).otherwise(F.col("text"))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document: counts and digest of the base rules, and all spans."""
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in RULES if r.base]))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_line(base), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


_RULE_ROWS = ", ".join(f"({i}, '{r.kind}', {r.group}, {r.least}, {str(r.base).lower()})" for i, r in enumerate(RULES))
_BY_RULE = " UNION ALL ".join(
    f"""SELECT n, {i} AS rule, string_split_regex(t, {p}) AS between, regexp_extract_all(t, {p}, 0) AS found, regexp_extract_all(t, {p}, {r.group}) AS part FROM d"""
    for i, r in enumerate(RULES) for p in ["'" + r.pattern.replace("'", "''") + "'"])
OP7_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
    rules(rule, kind, grp, least, base) AS (VALUES {_RULE_ROWS}),
    m AS (SELECT n, rule, unnest(range(1, len(found) + 1)) AS i, between, found, part FROM ({_BY_RULE}) WHERE len(found) > 0),
    p AS (SELECT n, rule, i, length(part[i]) AS size, length(found[i]) AS ml,
        sum(length(between[i]) + length(found[i])) OVER (PARTITION BY n, rule ORDER BY i) AS stop FROM m),
    s AS (SELECT n, rule, kind, base, stop - ml AS start, kind || ':' || (stop - ml)::BIGINT || ':' || stop::BIGINT AS line FROM p JOIN rules USING (rule) WHERE size >= least),
    g AS (SELECT n, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
        string_agg(line, ',' ORDER BY start, rule) FILTER (base) AS b, string_agg(line, ',' ORDER BY start, rule) AS every FROM s GROUP BY n)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
    sha256(coalesce(b, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN g USING (n)
"""
