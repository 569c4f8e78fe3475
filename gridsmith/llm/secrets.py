"""Secret scans over a trigram inverted index (native: Column expressions and joins only).

Every rule's regular expression is parsed, and a Boolean query over the
trigrams that any match must hold is derived from it: an AND of clauses, each
an OR of trigram sets. One pass over each text writes the index, a row
(trigram, document key) for each of the rules' trigrams that the text holds.
Queries are run on the index alone: posting lists meet by document key, an
option holds where all of its trigrams' lists do, a clause where one of its
options does, a rule where all of its clauses do. Only these candidates meet the
rule's regular expression; a rule without mandatory trigrams scans every text.

A document's key is a hash of its id and text, so rows that share a key by
chance only make more candidates. Candidates whose number is measured and small
are broadcast to the texts; more of them are joined by a shuffle.

Defined results: a null text counts as empty; an empty text, or an empty
table, gives no spans (base_sha256 is then that of the empty string). Texts of
any length are scanned whole. Repeated rows give a row each, and a null doc_id
is kept. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsmith.llm.common import cut, id_and_text
from gridsmith.llm.spans import count_kind, find_spans, joined

Clause = frozenset[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """keep: which matches count, as a Column predicate and as DuckDB SQL over the match m."""

    kind: str
    pattern: str
    keep: Callable[[Column], Column] = field(default=lambda hit: F.lit(True))
    keep_sql: str = "true"


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: The first three are the base kinds, in the order that ties take.
RULES = [
    Rule("assign", ASSIGN, lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8, f"length(regexp_extract(m, '{ASSIGN.replace(chr(39), chr(39) * 2)}', 2)) >= 8"),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("vcs_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
]
BASE = 3
_MOST = 64
#: Up to so many candidate keys (of 16 bytes) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def trigram_query(pattern: str) -> list[Clause]:
    """The clauses, all of which a text with a match satisfies in lower case. No clause: nothing is mandatory."""
    clauses: list[Clause] = []

    def flush(strings: set[str]) -> None:
        sets = frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
        if sets and all(sets):
            clauses.append(frozenset(s for s in sets if not any(other < s for other in sets)))

    def exact(node) -> set[str] | None:
        """All strings that the parsed part can match, in lower case, or None if they are many."""
        out = {""}
        for op, arg in node:
            name = str(op)
            if name == "LITERAL":
                new: set[str] | None = {chr(arg).lower()}
            elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
                codes = [c for k, v in arg for c in ([v] if str(k) == "LITERAL" else range(v[0], v[1] + 1))]
                new = {chr(c).lower() for c in codes} if len(codes) <= 8 else None
            elif name == "SUBPATTERN":
                new = exact(arg[-1])
            elif name == "BRANCH":
                each = [exact(x) for x in arg[1]]
                new = None if None in each else set().union(*each)
            elif name == "MAX_REPEAT" and arg[1] == 1:
                new = exact(arg[2])
                new = new | {""} if new is not None and arg[0] == 0 else new
            else:
                new = None
            if new is None or len(out) * len(new) > _MOST:
                return None
            out = {a + b for a in out for b in new}
        return out

    def walk(node) -> None:
        run = {""}
        for item in node:
            new = exact([item])
            if new is not None and len(run) * len(new) <= _MOST:
                run = {a + b for a in run for b in new}
                continue
            flush(run)
            run = {""}
            name, arg = str(item[0]), item[1]
            if new is not None:
                run = new
            elif name == "SUBPATTERN":
                walk(arg[-1])
            elif name == "MAX_REPEAT" and arg[0] >= 1:
                walk(arg[2])
        flush(run)

    walk(re._parser.parse(pattern))
    return sorted(clauses, key=str)


def _grams(rules: list[Rule]) -> list[str]:
    return sorted({g for r in rules for clause in trigram_query(r.pattern) for option in clause for g in option})


def gram_pattern(rules: list[Rule]) -> str:
    """A pattern that stands, without using characters up, before each of the rules' trigrams; they are group 1. A tree by characters, so most places fail at the first."""
    tree: dict[str, dict[str, list[str]]] = {}
    for a, b, c in _grams(rules):
        tree.setdefault(a, {}).setdefault(b, []).append(c)
    one = re.escape
    thirds = lambda b, cs: one(b) + (one(cs[0]) if len(cs) == 1 else f"(?:{'|'.join(map(one, cs))})")
    seconds = [f"{one(a)}(?:{'|'.join(thirds(b, cs) for b, cs in bs.items())})" for a, bs in tree.items()]
    return f"(?=[{''.join(map(one, tree))}])(?=({'|'.join(seconds)}))"


def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def trigram_postings(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The index: (trigram, key), one row for each of the rules' trigrams that a text holds."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(gram_pattern(rules)), F.lit(1)))
    return id_and_text(docs).select(_key().alias("key"), F.explode(held).alias("trigram"))


def query_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules' Boolean queries as rows: how many trigrams an option has, how many clauses a rule."""
    rows = []
    for k, rule in enumerate(rules, 1):
        clauses = trigram_query(rule.pattern)
        for c, clause in enumerate(clauses):
            for o, option in enumerate(sorted(clause, key=sorted)):
                rows += [F.struct(*map(F.lit, (g, k, c, o, len(option), len(clauses)))) for g in sorted(option)]
    kind = "array<struct<trigram:string,rule:int,clause:int,option:int,grams:int,clauses:int>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(kind)))


def candidates(postings: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """key and the rules (an array) whose trigram queries the key's postings satisfy.

    The queries' rows are fixed by the rules and broadcast; a posting list is
    dealt by document, so a trigram that most texts hold is no hot key.
    """
    asked = F.broadcast(query_table(postings.sparkSession, rules))
    lists = postings.distinct().repartition("key").join(asked, "trigram")
    options = lists.groupBy("key", "rule", "clauses", "clause", "option", "grams").agg(F.count("*").alias("n")).where(F.col("n") == F.col("grams"))
    clauses = options.groupBy("key", "rule", "clauses").agg(F.countDistinct("clause").alias("n")).where(F.col("n") == F.col("clauses"))
    return clauses.groupBy("key").agg(F.collect_set("rule").alias("rules"))


def scan_secrets(docs: DataFrame, rules: list[Rule] = RULES, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """doc_id and found: the spans (start, kind, stop, hit) of all rules; kinds are numbered from 1 in the rules' order."""
    chosen = cut(candidates(trigram_postings(docs, rules), rules))
    few = chosen.limit(broadcast_keys + 1).count() <= broadcast_keys
    frame = id_and_text(docs).withColumn("key", _key())
    met = frame.join(F.broadcast(chosen) if few else chosen, "key", "left")
    each = []
    for k, r in enumerate(rules, 1):
        free = not trigram_query(r.pattern)
        # A full scan first looks whether there is any match: most texts hold none.
        when = F.col("text").rlike(r.pattern) if free else F.coalesce(F.array_contains("rules", k), F.lit(False))
        each.append(find_spans(F.col("text"), r.pattern, k, r.keep, when))
    return met.select("doc_id", F.concat(*each).alias("found"))


def secrets_report(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """The digest that op6 returns; the first three rules are the base kinds."""
    kinds = [r.kind for r in rules]
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] <= BASE)
    return scan_secrets(docs, rules).select(
        "doc_id",
        *[count_kind(found, k).alias(f"n_{kinds[k - 1]}") for k in range(1, BASE + 1)],
        F.sha2(joined(base, kinds), 256).alias("base_sha256"),
        joined(found, kinds).alias("spans"),
    )


def secrets_sql(rules: list[Rule] = RULES) -> str:
    """The same rows by plain full scans, for DuckDB."""
    each = []
    for k, r in enumerate(rules, 1):
        pattern = r.pattern.replace("'", "''")
        each.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, m, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM "
            f"(SELECT doc_id, unnest(range(len(gaps))) AS i, unnest(gaps) AS g, unnest(list_concat(hits, [NULL])) AS m FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits FROM d))"
        )
    kept = " OR ".join(f"(k = {k} AND {r.keep_sql})" for k, r in enumerate(rules, 1))
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (" + " UNION ALL ".join(each) + f"), s AS (SELECT doc_id, k, kind, kind || ':' || (stop - length(m)) || ':' || stop AS one, stop - length(m) AS start FROM a WHERE m IS NOT NULL AND ({kept})), "
        "p AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex, string_agg(one, ',' ORDER BY start, k) FILTER (k <= 3) AS base, string_agg(one, ',' ORDER BY start, k) AS spans FROM s GROUP BY doc_id) "
        "SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN p USING (doc_id)"
    )
