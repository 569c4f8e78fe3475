"""Personal data by weak supervision (native: Column expressions only).

1. Candidates: spans of strict patterns (the base kinds, which always stay) and
   of looser ones (which must earn their place).
2. Labelers vote on every candidate, each for (1), against (-1) or not at all
   (0): the pattern's strictness, a gazetteer, the words before it, its edges.
3. Expectation-maximisation over the counts of vote patterns estimates each
   labeler's reliability and every pattern's probability. There are at most
   `kinds * 3^labelers * 4` patterns, whatever the size of the corpus, so only
   that table of counts comes to the driver.
4. Those probabilities are the soft labels of a logistic span classifier over
   kind, votes and length, applied as a Column expression. Loose candidates
   that it scores at 0.5 or more, and that overlap no base span, are added.

Defined results: a null text counts as empty; an empty text or table gives no
spans; texts of any length are scanned whole; repeated rows give a row each;
further columns are ignored, and kept by `redact` whatever their names. Without
any candidate the classifier is undefined and adds nothing. Of spans that start
together the kind listed first comes first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsmith.llm.common import cut, id_and_text
from gridsmith.llm.spans import count_kind, find_spans, joined

KINDS = ["email", "ip", "card", "phone", "id_number", "masked_email", "local_phone", "person"]
BASE = 4
VOTERS = 4
LENGTHS = [8, 14, 20]

#: A match starts where its run of characters does, or where the last match ended: no text is tried twice from within a run.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
ID_NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
MASKED_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[A-Za-z]{2,24}"
LOCAL_PHONE = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
PERSON = rf"(?<![\p{{L}}])(?:{TITLES})\.?\x20\p{{Lu}}[\p{{L}}'-]{{1,30}}(?:\x20\p{{Lu}}[\p{{L}}'-]{{1,30}})?"

TLDS = ["com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "au"]
CALLING = ["1", "33", "34", "39", "41", "43", "44", "49", "52", "61", "81", "86", "91"]
CUES = "mail|tel|phone|fon|call|contact|kontakt|address|adresse|card|karte|carte|tarjeta|ip|host|server|ssn|social|name|dear|from|by|von|von der|de la part"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    ordered = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.reverse(digits).substr(i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(ordered, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _ip_ok(hit: Column) -> Column:
    return hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$")


def _card_ok(hit: Column) -> Column:
    digits = _digits(hit)
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def _phone_ok(hit: Column) -> Column:
    return F.length(_digits(hit)).between(9, 15)


def _found(text: Column) -> Column:
    yes = lambda hit: F.lit(True)
    rules = [
        (EMAIL, yes, F.contains(text, F.lit("@"))),
        (IP, _ip_ok, text.rlike(r"[0-9]\.[0-9]")),
        (CARD, _card_ok, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}")),
        (PHONE, _phone_ok, F.contains(text, F.lit("+"))),
        (ID_NUMBER, yes, text.rlike(r"[0-9]-[0-9]{2}-[0-9]")),
        (MASKED_EMAIL, yes, text.rlike(r"[\[(](?:at|AT)[\])]")),
        (LOCAL_PHONE, yes, text.rlike(r"[0-9][\x20.-][0-9]{4}")),
        (PERSON, yes, text.rlike(rf"(?:{TITLES})\.?\x20")),
    ]
    return F.concat(*[find_spans(text, pattern, k, keep, when) for k, (pattern, keep, when) in enumerate(rules, 1)])


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def _votes(text: Column, s: Column) -> Column:
    """The labelers' votes on the span s."""
    kind, hit = s["kind"], F.lower(s["hit"])
    strict = _vote(kind <= BASE, (kind == 7) & (F.length(_digits(hit)) != 10))
    number = kind.isin(3, 5)
    gazetteer = (
        F.when(kind.isin(1, 6), _vote(F.regexp_extract(hit, r"([a-z]+)$", 1).isin(TLDS), F.regexp_extract(hit, r"([a-z]+)$", 1) == ""))
        .when(kind == 2, _vote(hit.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[0-4][0-9])\."), hit.rlike(r"^0")))
        .when(kind == 4, _vote(hit.rlike(rf"^\+(?:{'|'.join(CALLING)})"), hit.rlike(r"^\+0")))
        .when(number, _vote(hit.rlike(r"^[3-6]"), hit.rlike(r"^(?:000|666|9)")))
        .when(kind == 7, _vote(hit.rlike(r"^\(?[2-9]"), hit.rlike(r"^\(?[01]")))
        .otherwise(0)
    )
    begin = F.greatest(s["start"] - 24, F.lit(0))
    before = F.lower(text.substr((begin + 1).cast("int"), (s["start"] - begin).cast("int")))
    context = _vote(before.rlike(rf"(?:{CUES})[^a-z]{{0,12}}$"), before.rlike(r"(?:no|nr|ref|version|order|sku|isbn)[^a-z]{0,6}$"))
    edges = F.concat(F.when(s["start"] == 0, " ").otherwise(text.substr(s["start"].cast("int"), F.lit(1))), text.substr((s["stop"] + 1).cast("int"), F.lit(1)))
    edge = _vote(edges.rlike(r"^[\s(\[<\"':,;|][\s)\]>\"':,;.!?|]?$"), edges.rlike(r"[\p{L}\p{N}_]"))
    return F.array(strict, gazetteer, context, edge)


def _length_class(s: Column) -> Column:
    n = s["stop"] - s["start"]
    return sum((F.when(n > at, 1).otherwise(0) for at in LENGTHS), F.lit(0))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and found: an array of candidate spans with their votes and length class."""
    named = id_and_text(docs).withColumn("found", _found(F.col("text")))
    return named.select("doc_id", _voted("text", "found").alias("found"))


def _voted(text: str, found: str) -> Column:
    return F.transform(
        F.col(found),
        lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), _votes(F.col(text), s).alias("votes"), _length_class(s).alias("length_class")),
    )


@dataclass(frozen=True)
class SpanModel:
    """reliability[voter][class][vote + 1], from the EM; the rest are the classifier's weights."""

    reliability: list
    kind: list[float]
    vote: list
    length: list[float]

    def score(self, s: Column) -> Column:
        pick = lambda values, at: F.element_at(F.array(*[F.lit(float(v)) for v in values]), at)
        z = pick(self.kind, s["kind"]) + pick(self.length, s["length_class"] + 1)
        for v in range(VOTERS):
            z = z + pick(self.vote[v], F.element_at(s["votes"], v + 1) + 2)
        return 1 / (1 + F.exp(-z))


def fit(found: DataFrame, rounds: int = 40, steps: int = 300) -> SpanModel | None:
    """EM over the counts of vote patterns, then the classifier on its soft labels; None without candidates."""
    one = found.select(F.explode("found").alias("s"))
    counts = one.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.length_class").alias("length_class")).count().collect()
    rows = sorted((r["kind"], tuple(r["votes"]), r["length_class"], r["count"]) for r in counts)
    if not rows:
        return None
    post = [min(0.95, max(0.05, 0.5 + 0.2 * sum(v))) for _, v, _, _ in rows]
    theta: list = []
    for _ in range(rounds):
        theta = [[[1.0] * 3 for _ in range(2)] for _ in range(VOTERS)]
        prior = {k: [1.0, 1.0] for k in range(1, len(KINDS) + 1)}
        for (kind, votes, _, n), p in zip(rows, post, strict=True):
            for c, weight in ((0, n * (1 - p)), (1, n * p)):
                prior[kind][c] += weight
                for v in range(VOTERS):
                    theta[v][c][votes[v] + 1] += weight
        theta = [[[x / sum(of) for x in of] for of in each] for each in theta]
        new = []
        for kind, votes, _, _ in rows:
            both = [math.log(prior[kind][c]) + sum(math.log(theta[v][c][votes[v] + 1]) for v in range(VOTERS)) for c in (0, 1)]
            new.append(1 / (1 + math.exp(min(700.0, both[0] - both[1]))))
        post = new
    kinds, length, vote = [0.0] * len(KINDS), [0.0] * (len(LENGTHS) + 1), [[0.0] * 3 for _ in range(VOTERS)]
    weights = [math.log1p(n) for _, _, _, n in rows]
    total = sum(weights)
    for step in range(steps):
        rate = 4.0 / (1 + step / 100)
        grads = [0.0] * len(kinds), [0.0] * len(length), [[0.0] * 3 for _ in range(VOTERS)]
        for (k, votes, size, _), p, n in zip(rows, post, weights, strict=True):
            z = kinds[k - 1] + length[size] + sum(vote[v][votes[v] + 1] for v in range(VOTERS))
            g = n / total * (p - 1 / (1 + math.exp(-max(-500.0, min(500.0, z)))))
            grads[0][k - 1] += g
            grads[1][size] += g
            for v in range(VOTERS):
                grads[2][v][votes[v] + 1] += g
        kinds = [w + rate * (g - 1e-4 * w) for w, g in zip(kinds, grads[0], strict=True)]
        length = [w + rate * (g - 1e-4 * w) for w, g in zip(length, grads[1], strict=True)]
        vote = [[w + rate * (g - 1e-4 * w) for w, g in zip(a, b, strict=True)] for a, b in zip(vote, grads[2], strict=True)]
    return SpanModel(theta, kinds, vote, length)


def accepted(found: Column, model: SpanModel | None) -> Column:
    """Base spans, and those loose ones that the classifier takes and that overlap no base span."""
    base = F.filter(found, lambda s: s["kind"] <= BASE)
    if model is None:
        return base
    loose = F.filter(found, lambda s: (s["kind"] > BASE) & (model.score(s) >= 0.5))
    clear = F.filter(loose, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return F.concat(base, clear)


def pii_report(docs: DataFrame) -> DataFrame:
    """The digest that op7 returns. The texts are scanned once: the candidates are written and read again."""
    found = cut(candidates(docs))
    spans = found.select("doc_id", accepted(F.col("found"), fit(found)).alias("spans"))
    base = F.filter(F.col("spans"), lambda s: s["kind"] <= BASE)
    return spans.select(
        "doc_id",
        *[count_kind(F.col("spans"), k).alias(f"n_{KINDS[k - 1]}") for k in range(1, BASE + 1)],
        F.sha2(joined(base, KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every accepted span replaced by its kind in brackets; n_chars follows the new text.

    Overlapping spans count as one, named after the first. Other columns stay
    as they are. The texts are scanned once to fit and once to replace.
    """
    found = cut(candidates(docs).where(F.size("found") > 0))
    model = fit(found)
    # The table's own columns go by number meanwhile, so that none clashes with a name of ours.
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = {c: n for c, n in zip(docs.columns, names, strict=True)}
    body = F.col("body")
    scanned = docs.toDF(*names).withColumn("body", F.coalesce(F.col(place["text"]), F.lit(""))).withColumn("found", _found(body))
    spans = scanned.withColumn("voted", _voted("body", "found")).withColumn("spans", F.array_sort(accepted(F.col("voted"), model)))
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    piece = lambda a, b: body.substr((a + 1).cast("int"), (b - a).cast("int"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(s["stop"].alias("at"), F.concat(acc["out"], piece(acc["at"], s["start"]), F.element_at(kinds, s["kind"])).alias("out"))).otherwise(
        F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), acc["out"].alias("out"))
    )
    whole = F.aggregate(F.col("spans"), start, step, lambda acc: F.concat(acc["out"], piece(acc["at"], F.length(body).cast("bigint"))))
    text = F.when(F.size("spans") > 0, whole).otherwise(F.col(place["text"]))
    out = spans.withColumn("cleaned", text)
    new = {c: F.col(n) for c, n in place.items()} | {"text": F.col("cleaned")}
    if "n_chars" in place:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("cleaned")).otherwise(F.col(place["n_chars"])).cast("bigint")
    return out.select(*[new[c].alias(c) for c in docs.columns])
