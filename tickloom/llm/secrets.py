"""Secret scans through a trigram inverted index.

Each rule is a regular expression. From it a Boolean query over trigrams (of the A-Z lower-cased text) is derived: an OR
of ANDs that every match must satisfy. Only the trigrams that some rule needs are indexed: a posting (trigram, document)
for each one that a document's whole text holds. A rule's candidates are the documents whose postings meet all trigrams
of one of its ANDs; only they run its expression. A rule without mandatory trigrams runs on every document.

Everything is DataFrame expressions. Spans are code points, end exclusive: the pieces between the matches and the matches
themselves add up to the places.

Defined results: a null text is the empty text; repeated ids are told apart only when verified, so each row has its own
spans; null ids are joined as equal; very long texts are searched whole; an empty table gives no rows. A posting is one small row, and postings are intersected by partial aggregation, so
neither a common trigram nor a common document id gathers rows in one task.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, free_names, only, quoted

#: Literal strings followed at once, and ANDs of a query, before a query is weakened (a weaker query only adds candidates).
MOST_STRINGS, MOST_CLAUSES = 32, 24


@dataclass(frozen=True)
class SecretRule:
    kind: str
    pattern: str
    #: A match whose group of this number is shorter than ``least`` is dropped.
    group: int = 0
    least: int = 0


#: The contract's kinds in order, then the kinds that the method adds.
BASE = (
    SecretRule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 18),
    # A run that is too short holds no long enough one, so the least length may stand in the pattern.
    SecretRule("hex", r"[0-9a-f]{16,}", 0, 16),
)
ADDED = (
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[0-9A-Za-z_-]{35}"),
    SecretRule("stripe", r"[rs]k_(?:live|test)_[0-9a-zA-Z]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED

Clauses = tuple[frozenset[str], ...]
#: The query that every text satisfies.
ANY: Clauses = (frozenset(),)


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _tidy(clauses: set[frozenset[str]]) -> Clauses:
    """Without ANDs that a smaller one implies."""
    return tuple(sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted))


def _both(a: Clauses, b: Clauses) -> Clauses:
    joined = _tidy({x | y for x, y in product(a, b)})
    return joined if len(joined) <= MOST_CLAUSES else min(a, b, key=lambda q: (q == ANY, len(q)))


def _of_strings(strings: set[str]) -> Clauses:
    return _tidy({_trigrams(s) for s in strings})


def _letters(members: list) -> set[str] | None:
    """The lower-cased characters of a small class."""
    found: set[str] = set()
    for op, value in members:
        if op is kinds.LITERAL:
            found.add(chr(value).lower())
        elif op is kinds.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _strings(node: tuple) -> set[str] | None:
    """All strings that one item of a parsed expression matches, if they are few."""
    op, value = node
    if op is kinds.LITERAL:
        return {chr(value).lower()}
    if op is kinds.IN:
        return _letters(value)
    if op is kinds.SUBPATTERN:
        return _sequence_strings(value[3])
    if op is kinds.BRANCH:
        parts = [_sequence_strings(p) for p in value[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is kinds.MAX_REPEAT and value[1] != kinds.MAXREPEAT and value[1] <= 4:
        once = _sequence_strings(value[2])
        if once is None:
            return None
        out = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(sorted(once), repeat=n)}
        return out if len(out) <= MOST_STRINGS else None
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        found = _strings(node)
        if found is None or len(found) * len(out) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, found)}
    return out


def _query(nodes) -> Clauses:
    """The query of a sequence: that of each longest stretch of known strings, and that of what lies between."""
    whole, held = ANY, {""}
    for node in nodes:
        found = _strings(node)
        if found is not None and len(found) * len(held) <= MOST_STRINGS:
            held = {a + b for a, b in product(held, found)}
            continue
        whole, held = _both(whole, _of_strings(held)), found or {""}
        if found is None:
            op, value = node
            if op is kinds.SUBPATTERN:
                whole = _both(whole, _query(value[3]))
            elif op is kinds.BRANCH:
                whole = _both(whole, _tidy({c for p in value[1] for c in _query(p)}))
            elif op is kinds.MAX_REPEAT and value[0] > 0:
                whole = _both(whole, _query(value[2]))
    return _both(whole, _of_strings(held))


def trigram_query(pattern: str) -> Clauses:
    """An OR of ANDs of trigrams that the lower-cased text of every match satisfies; ``ANY`` if none is mandatory."""
    clauses = _query(parser.parse(pattern))
    return ANY if frozenset() in clauses else clauses


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, doc_id): which documents hold which of these trigrams."""
    low = ascii_lower(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", low.alias("low")).select("doc_id", F.explode(F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains("low", t))).alias("trigram"))


def candidates(held: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """(doc_id, kinds): the rules whose query a document's postings satisfy."""
    spark = held.sparkSession
    rows = [(kind, i, t, 1 << k, (1 << len(clause)) - 1) for kind, clauses in queries.items() for i, clause in enumerate(clauses) for k, t in enumerate(sorted(clause))]
    clauses = spark.createDataFrame(rows, "kind string, clause int, trigram string, bit long, every long")
    met = held.join(F.broadcast(clauses), "trigram").groupBy("doc_id", "kind", "clause", "every").agg(F.bit_or("bit").alias("bits"))
    return met.where(F.col("bits") == F.col("every")).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


def _spans(found: Column, between: Column, kept: Column | None, least: int) -> Column:
    """Spans of the matches, from the matches and the pieces between them."""
    step = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("gap"), F.coalesce(F.length(m), F.lit(0)).alias("len")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))
    walked = F.aggregate(
        step, start,
        lambda acc, s: F.struct((acc["at"] + s["gap"] + s["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["len"]).alias("end")))).alias("out")),
        lambda acc: acc["out"],
    )
    spans = F.slice(walked, F.lit(1), F.size(found))
    if kept is not None:
        pairs = F.filter(F.arrays_zip(spans.alias("span"), kept.alias("held")), lambda p: F.length(p["held"]) >= least)
        spans = F.transform(pairs, lambda p: p["span"])
    elif least:
        spans = F.filter(spans, lambda s: s["end"] - s["start"] >= least)
    return F.when(F.size(found) > 0, spans).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))


def _labelled(spans: Column, place: int, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, out: str = "secret_spans") -> DataFrame:
    """Adds ``out`` to documents: array of (start, place of the rule, end, kind), by start and then rule order.

    All other columns pass through (an older ``out`` is replaced); helper columns take names that the table does not have.
    """
    docs = docs.drop(out)
    kept = quoted(docs)
    text, known, kinds_, *names = free_names(docs, "text", "id", "kinds", *[f"{part}_{rule.kind}" for rule in rules for part in "mbg"])
    matches, between, groups = (dict(zip([rule.kind for rule in rules], names[i::3], strict=True)) for i in range(3))
    found = docs.withColumn(text, F.coalesce("text", F.lit("")))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: clauses for kind, clauses in queries.items() if clauses != ANY}
    trigrams = sorted({t for clauses in indexed.values() for clause in clauses for t in clause})
    if indexed:
        some = candidates(postings(only(docs, "doc_id", "text"), trigrams), indexed).select(F.col("doc_id").alias(known), F.col("kinds").alias(kinds_))
        found = found.join(some, found["doc_id"].eqNullSafe(some[known]), "left")
    # A document that is no candidate of a rule gives it no text: the expression sees null and stops.
    for rule in rules:
        on = F.col(text) if rule.kind not in indexed else F.when(F.array_contains(kinds_, rule.kind), F.col(text))
        found = found.withColumn(matches[rule.kind], F.regexp_extract_all(on, F.lit(rule.pattern), F.lit(0)))
    for rule in rules:
        held = F.when(F.size(matches[rule.kind]) > 0, F.col(text))
        found = found.withColumn(between[rule.kind], F.split(held, rule.pattern, -1))
        if rule.group:
            found = found.withColumn(groups[rule.kind], F.regexp_extract_all(held, F.lit(rule.pattern), F.lit(rule.group)))
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(F.col(matches[rule.kind]), F.col(between[rule.kind]), F.col(groups[rule.kind]) if rule.group else None, rule.least)
        parts.append(_labelled(spans, i, rule.kind))
    return found.select(*kept, F.array_sort(F.concat(*parts)).alias(out))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """Documents, all columns, with every span of the text replaced by ``mark``; overlapping spans are replaced as one. A null text stays null."""
    spans, merged_ = free_names(docs, "spans", "merged")
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    last = lambda acc: F.element_at(acc, -1)
    merged = F.aggregate(
        spans, empty,
        lambda acc, s: F.when((F.size(acc) > 0) & (last(acc)["end"] > s["start"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    found = scan(docs, rules, spans).withColumn(merged_, F.when(F.size(spans) > 0, merged).otherwise(empty))
    built = F.aggregate(
        merged_, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)),
    )
    text = F.when(F.size(spans) > 0, built).otherwise(F.col("text"))
    return found.select(*[text.alias("text") if name == "text" else column for name, column in zip(docs.columns, quoted(docs), strict=True)])


def op5_query(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = scan(only(docs, "doc_id", "text"))
    n = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("secret_spans", lambda s: s["place"] < len(BASE))
    return found.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("secret_spans")).alias("spans"))


def op5_sql() -> str:
    """The same by running every rule on every text."""
    quoted = lambda s: s.replace("'", "''")
    parts = []
    for i, rule in enumerate(RULES):
        length = "len(g[i])" if rule.group else "len(m[i])"
        parts.append(f"""select doc_id, '{rule.kind}' as kind, {i} as place, s.a as a, s.b as b from (
  select doc_id, unnest(list_transform(list_filter(range(1, len(m) + 1), lambda i: {length} >= {rule.least}), lambda i: {{
    'a': list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0),
    'b': list_sum(list_transform(p[1:i], lambda x: len(x))) + list_sum(list_transform(m[1:i], lambda x: len(x)))}})) as s
  from (select doc_id, regexp_extract_all(t, '{quoted(rule.pattern)}', 0) as m, regexp_extract_all(t, '{quoted(rule.pattern)}', {rule.group}) as g,
    string_split_regex(t, '{quoted(rule.pattern)}') as p from d))""")
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
s as ({" union all ".join(parts)}),
l as (select doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access,
  count(*) filter (where kind = 'hex') as n_hex,
  string_agg(kind || ':' || cast(a as bigint) || ':' || cast(b as bigint), ',' order by a, place) filter (where place < {len(BASE)}) as base,
  string_agg(kind || ':' || cast(a as bigint) || ':' || cast(b as bigint), ',' order by a, place) as every from s group by doc_id)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans from d left join l using (doc_id)
"""
