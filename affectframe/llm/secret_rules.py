"""Secrets in texts, found through a trigram index.

From each rule's pattern a Boolean query over trigrams is derived: what every match must
hold. The index has postings (trigram, id) for the trigrams that the rules ask for, in the
texts' lower-case form. Postings are intersected by counting them for each id and clause;
the rows that remain are verified with the pattern itself. A rule that no trigram is
mandatory for reads all texts.

All work on rows is done by DataFrame functions; Python sees the rules only.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _parser as patterns

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affectframe.constants import BROADCAST_BYTES
from affectframe.llm.common import stored
from affectframe.session import new_dir
from affectframe.tables import is_bounded, literal_table


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The kinds that are asked for, in their order.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    # Runs of one class are matched whole, so their least length can stand in the pattern.
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

# Further kinds with well-known marks.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{15,}"),
)

RULES = BASE_RULES + MORE_RULES

# A literal with more alternatives than this is cut where it stands.
_MAX_EXACT = 64

Clauses = frozenset  # of clauses, each a frozenset of trigrams; one clause at least must hold


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any(a: Clauses, b: Clauses) -> Clauses:
    return a | b


def _all(a: Clauses, b: Clauses) -> Clauses:
    return frozenset(x | y for x in a for y in b)


def trigram_query(pattern: str) -> Clauses:
    """What a text must hold, in lower case, to match: any clause, all trigrams of it.

    A clause without trigrams means that nothing is mandatory.
    """
    nothing = frozenset([frozenset()])

    def of(strings: set[str]) -> Clauses:
        return frozenset(_grams(s) for s in strings) or nothing

    def sequence(items) -> tuple[set[str] | None, Clauses]:
        """The strings it stands for, if they are few; and a query for it."""
        query, run, whole = nothing, {""}, True
        for item in items:
            strings, inner = single(*item)
            if strings is not None and len(run) * len(strings) <= _MAX_EXACT:
                run = {a + b for a in run for b in strings}
                continue
            query, run, whole = _all(_all(query, of(run)), inner), {""}, False
        return (run if whole else None), _all(query, of(run))

    def single(op, value) -> tuple[set[str] | None, Clauses]:
        name = str(op)
        if name == "LITERAL":
            return {chr(value).lower()}, nothing
        if name == "AT":
            return {""}, nothing
        if name == "IN":
            if all(str(o) == "LITERAL" for o, _ in value):
                return {chr(v).lower() for _, v in value}, nothing
            return None, nothing
        if name == "SUBPATTERN":
            return sequence(value[-1])
        if name == "BRANCH":
            found = [sequence(branch) for branch in value[1]]
            if all(strings is not None for strings, _ in found):
                return set().union(*(strings for strings, _ in found)), nothing
            query = found[0][1]
            for _, other in found[1:]:
                query = _any(query, other)
            return None, query
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = value
            strings, inner = sequence(body)
            if most == 1 and least == 0 and strings is not None:
                return strings | {""}, nothing
            if least == 0:
                return None, nothing
            return None, inner if strings is None else of(strings)
        return None, nothing

    strings, query = sequence(patterns.parse(pattern))
    query = query if strings is None else of(strings)
    # A clause that holds all of another one asks for more without ruling anything out.
    return frozenset(c for c in query if not any(other < c for other in query))


def build_postings(texts: DataFrame, grams: Sequence[str]) -> DataFrame:
    """``gram`` (its place in the list) and ``id`` of each trigram that a text holds.

    Stored in one folder for each trigram, so that a query reads what it asks for. A
    trigram that most texts hold is written by many tasks.
    """
    lowered = texts.select("id", F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[
        F.when(F.contains(F.col("low"), F.lit(gram)), F.lit(number)) for number, gram in enumerate(grams)
    ]))
    postings = lowered.select("id", F.explode(held).alias("gram"))
    path = new_dir(texts.sparkSession, "postings")
    postings.hint("rebalance", "gram").write.partitionBy("gram").parquet(path)
    return texts.sparkSession.read.schema(postings.schema).parquet(path)


def candidates(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame | None:
    """``id, rules`` (places in the list): texts that may match, for rules with a query."""
    queries = {n: trigram_query(rule.pattern) for n, rule in enumerate(rules)}
    queries = {n: q for n, q in queries.items() if all(q)}
    grams = sorted(set().union(*(clause for q in queries.values() for clause in q)))
    if not grams:
        return None
    place = {gram: number for number, gram in enumerate(grams)}
    postings = build_postings(texts, grams)
    clauses = [(n, clause) for n, q in queries.items() for clause in sorted(q, key=sorted)]
    asked = literal_table(
        texts.sparkSession,
        [(place[gram], n, c, len(clause)) for c, (n, clause) in enumerate(clauses) for gram in clause],
        T.StructType.fromDDL("gram int, rule int, clause int, needed int"),
    )
    # The rules' own few trigrams: their number is known before any text is read.
    matched = postings.join(F.broadcast(asked), "gram").groupBy("id", "clause").agg(
        F.count("*").alias("held"), F.first("needed").alias("needed"), F.first("rule").alias("rule")
    )
    # Rows that share an id may fill a clause together; such a text is verified in vain.
    whole = matched.filter("held >= needed").groupBy("id").agg(F.collect_set("rule").alias("rules"))
    return stored(whole, "candidates")


def spans_of(text: Column, rule: Rule, kind: int) -> Column:
    """Spans ``start, kind, end`` (code points, end exclusive) of a rule's matches."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    # What stands before each match; a last piece stands behind the last.
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    zipped = F.zip_with(
        matches, F.slice(pieces, F.lit(1), F.size(matches)),
        lambda match, before: F.struct(match.alias("match"), before.alias("before")),
    )
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    walked = F.aggregate(
        zipped, F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda done, x: F.struct(
            (done["at"] + x["before"] + F.length(x["match"])).alias("at"),
            F.concat(done["spans"], F.array(F.struct(
                (done["at"] + x["before"]).alias("start"), F.lit(kind).alias("kind"),
                (done["at"] + x["before"] + F.length(x["match"])).alias("end"), x["match"].alias("match"),
            ))).alias("spans"),
        ),
        lambda done: done["spans"],
    )

    def enough(span: Column) -> Column:
        part = F.regexp_extract(span["match"], rule.pattern, rule.group) if rule.group else span["match"]
        return F.length(part) >= rule.least

    kept = F.filter(walked, enough)
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def listed(spans: Column, kinds: Sequence[str]) -> Column:
    names = F.array(*[F.lit(k) for k in kinds])
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return F.array_join(texts, ",")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES
) -> DataFrame:
    """``id, spans`` of each document: ``array<struct<start, kind, end>>`` by start, then kind.

    ``kind`` is a rule's place in the list. Matches of a rule are leftmost and do not
    overlap; those that fail its length are dropped afterwards. Defined cases: a null
    text is empty and has no spans; a document with a null id is always verified, and so
    is each row of an id that several rows share; an empty table gives an empty one.
    Other columns are not looked at.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = candidates(texts, rules)
    queried = [all(trigram_query(rule.pattern)) for rule in rules]
    if found is None:
        flagged = texts.withColumn("rules", F.array().cast("array<int>"))
    else:
        found = F.broadcast(found) if is_bounded(found, BROADCAST_BYTES) else found
        flagged = texts.join(found, "id", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    columns = []
    for n, rule in enumerate(rules):
        spans = spans_of(F.col("text"), rule, n)
        if queried[n]:
            may = F.col("id").isNull() | F.coalesce(F.array_contains("rules", n), F.lit(False))
            spans = F.when(may, spans).otherwise(none)
        columns.append(spans)
    return flagged.select("id", F.array_sort(F.concat(*columns)).alias("spans"))


def digests(spans: DataFrame, rules: Sequence[Rule] = RULES, base: int = len(BASE_RULES)) -> DataFrame:
    """``id``, a count for each base kind, the hash of the base spans, and all spans as text."""
    kinds = [rule.kind for rule in rules]

    def of(n: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("bigint")

    own = F.filter("spans", lambda s: s["kind"] < base)
    return spans.select(
        "id", *[of(n).alias(f"n_{kinds[n]}") for n in range(base)],
        F.sha2(listed(own, kinds), 256).alias("base_sha256"),
        listed(F.col("spans"), kinds).alias("spans"),
    )


def brute_spans(text: str | None, rules: Sequence[Rule] = RULES) -> list[tuple[int, int, int]]:
    """The same spans of one text, without an index."""
    found = []
    for n, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m.group(rule.group)) >= rule.least:
                found.append((m.start(), n, m.end()))
    return sorted(found)


def oracle(rules: Sequence[Rule] = RULES, base: int = len(BASE_RULES)) -> str:
    """DuckDB SQL for :func:`digests` over ``documents`` with different ids, the ids as ``doc_id``."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    found = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS kind, {quoted(r.kind)} AS name, regexp_extract_all(body, {quoted(r.pattern)}) AS hits, "
        f"regexp_split_to_array(body, {quoted(r.pattern)}) AS pieces FROM bodies"
        for n, r in enumerate(rules)
    )
    long_enough = " ".join(
        f"WHEN {n} THEN length(regexp_extract(hit, {quoted(r.pattern)}, {r.group})) >= {r.least}" for n, r in enumerate(rules)
    )
    counts = ", ".join(f"count(*) FILTER (kind = {n}) AS n_{r.kind}" for n, r in enumerate(rules[:base]))
    columns = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules[:base])
    written = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({found}),
numbered AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found WHERE len(hits) > 0),
placed AS (
  SELECT doc_id, kind, name, hits[i] AS hit,
         (list_sum(list_transform(pieces[1:i], lambda x: length(x)))
          + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM numbered
),
kept AS (SELECT *, start + length(hit) AS stop FROM placed WHERE CASE kind {long_enough} END),
digests AS (
  SELECT doc_id, {counts}, {written} FILTER (kind < {base}) AS base, {written} AS spans FROM kept GROUP BY doc_id
)
SELECT doc_id, {columns}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM bodies LEFT JOIN digests USING (doc_id)
"""
