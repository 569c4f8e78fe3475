import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsmith.llm import pii, queries, secrets

KEY = "AKIA" + "Q7" * 8
ROWS = [
    (1, f'password="abcd1234" token:short secret = {KEY} API-KEY api_key:"{"f0" * 20}"'), (2, None), (3, ""), (4, "token=token:longenough1 Passwd : x"), (5, f"\U0001f600é {KEY} {'0123456789abcdef' * 2} AKIASHORT"),
    (6, "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1" * 18 + " xoxb-1234567890-ab"), (7, "nothing here"), (7, "nothing here"), (8, "secret:" + "k" * 50_000), (9, "a" * 100_000),
    (10, "mail bob.smith+x@mail.example.com a@b.co_x@y.org z@@k a@b@c.d"), (11, "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4 192.168.000255.1 1.2.3"), (12, "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559"),
    (13, "call +1 (626) 555-1234 or +12 or +49 30 123456 78901234567 tel 626-555-1234"), (14, "Dear Mr. John Smith, contact bob [at] site [dot] com ssn: 123-45-6789"), (15, "9" * 60_000), (16, "1 " * 20_000), (17, "@" * 5000 + "a.b" * 2000),
]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in ROWS], "doc_id long, text string, found int, kind string").repartition(3)


def digest(spans, kinds):
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def base_secrets(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]


def luhn(x):
    return sum(d - 9 if (d := int(c) * (1 + i % 2)) > 9 else d for i, c in enumerate(reversed(x))) % 10 == 0


def base_pii(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+" if len(t) > 9000 else r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    if len(t) < 9000:
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_secrets_hold_the_base_and_more(frame):
    kinds = [r.kind for r in secrets.RULES]
    got = sorted(secrets.secrets_report(frame).collect(), key=lambda r: r.doc_id)
    for r, (i, t) in zip(got, ROWS, strict=True):
        base = base_secrets(t or "")
        assert r.doc_id == i and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(digest(base, kinds).encode()).hexdigest()
        if i == 6:
            assert [s.split(":")[0] for s in r.spans.split(",")] == ["pem", "vcs_token", "hex", "chat_token"]
        elif i < 6:
            assert r.spans == digest(base, kinds)


def test_trigram_queries():
    of = {r.kind: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert of["access"] == [frozenset({frozenset({"aki", "kia"})})] and of["hex"] == []
    assert frozenset({"tok", "oke", "ken"}) in of["assign"][0]
    assert secrets.trigram_query("a|bcd") == [] and secrets.trigram_query("(ab)?cdef+") != []


def test_postings_are_the_trigrams_that_texts_hold(spark, frame):
    grams = secrets._grams(secrets.RULES)
    key = frame.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    rows = {(r.trigram, r.doc_id) for r in secrets.trigram_postings(frame).join(key, "key").collect()}
    assert rows == {(g, i) for i, t in ROWS for g in grams if g in (t or "").lower()}
    every = spark.createDataFrame([(1, " ".join(grams)), (2, "".join(grams))], "doc_id long, text string")
    assert {r.n for r in secrets.trigram_postings(every).groupBy("key").agg(F.countDistinct("trigram").alias("n")).collect()} == {len(grams)}


def test_candidates_are_those_of_the_boolean_queries(frame):
    key = frame.select("doc_id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    got = {(r.doc_id, k) for r in secrets.candidates(secrets.trigram_postings(frame)).join(key, "key").collect() for k in r.rules}
    holds = lambda t, q: all(any(all(g in t for g in option) for option in clause) for clause in q)
    queries_of = [(k, q) for k, r in enumerate(secrets.RULES, 1) if (q := secrets.trigram_query(r.pattern))]
    assert got == {(i, k) for i, t in ROWS for k, q in queries_of if holds((t or "").lower(), q)} and got


def test_candidates_joined_by_a_shuffle_give_the_same_spans(frame):
    one, two = (sorted(map(str, secrets.scan_secrets(frame, broadcast_keys=n).collect())) for n in (100_000, 0))
    assert one == two


def test_pii_holds_the_base_and_more(frame):
    got = sorted(pii.pii_report(frame).collect(), key=lambda r: r.doc_id)
    for r, (i, t) in zip(got, ROWS, strict=True):
        base = base_pii(t or "")
        assert r.doc_id == i and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in base) for x in range(4))
        assert r.base_sha256 == hashlib.sha256(digest(base, pii.KINDS).encode()).hexdigest()
        if base:
            assert set(digest(base, pii.KINDS).split(",")) <= set(r.spans.split(","))
    assert any("id_number" in r.spans for r in got)


def test_native_queries_hold_no_python(spark, frame, sf_dir):
    for report in (secrets.secrets_report(frame), pii.redact(frame.limit(3))):
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_redaction(spark):
    rows = spark.createDataFrame([(1, "to a@b.co, +1 626 555 1234!", 9), (2, None, None), (3, "", 0), (4, "plain", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(rows).collect()}
    assert got == {1: ("to [EMAIL], [PHONE]!", 20), 2: (None, None), 3: ("", 0), 4: ("plain", 5)}


def test_redaction_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([("a@b.co", "one", [1], "x", "y", 1)], "text string, found string, spans array<int>, __text string, body string, doc_id long")
    out = pii.redact(rows)
    assert out.dtypes == rows.dtypes and tuple(out.first()) == ("[EMAIL]", "one", [1], "x", "y", 1)


def plain_em(rows, rounds):
    """Two-class EM with independent labelers, a document-free version on repeated patterns."""
    votes = np.array([v for _, v, _, _ in rows]) + 1
    kind, n = np.array([k for k, *_ in rows]), np.array([c for *_, c in rows], float)
    post = np.clip(0.5 + 0.2 * (votes - 1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        both = np.stack([1 - post, post])
        theta = np.ones((pii.VOTERS, 2, 3))
        prior = np.ones((len(pii.KINDS) + 1, 2))
        for c in (0, 1):
            np.add.at(prior[:, c], kind, n * both[c])
            for v in range(pii.VOTERS):
                np.add.at(theta[v, c], votes[:, v], n * both[c])
        theta /= theta.sum(2, keepdims=True)
        joint = np.log(prior[kind]) + sum(np.log(theta[v][:, votes[:, v]]).T for v in range(pii.VOTERS))
        post = 1 / (1 + np.exp(joint[:, 0] - joint[:, 1]))
    return theta


def test_reliabilities_are_those_of_a_plain_em_and_added_spans_those_of_the_classifier(frame):
    found = pii.candidates(frame)
    held = [(r.doc_id, s) for r in found.collect() for s in r.found]
    counts = Counter((s.kind, tuple(s.votes), s.length_class) for _, s in held)
    model = pii.fit(found)
    assert np.allclose(model.reliability, plain_em(sorted((*k, n) for k, n in counts.items()), 40))
    score = lambda s: model.kind[s.kind - 1] + model.length[s.length_class] + sum(model.vote[v][s.votes[v] + 1] for v in range(pii.VOTERS))
    base = [(i, s) for i, s in held if s.kind <= pii.BASE]
    clear = [(i, s) for i, s in held if s.kind > pii.BASE and score(s) >= 0 and not any(i == j and b.start < s.stop and s.start < b.stop for j, b in base)]
    want = sorted((i, s.start, s.kind, s.stop) for i, s in base + clear)
    got = found.select("doc_id", F.explode(pii.accepted(F.col("found"), model)).alias("s")).collect()
    assert clear and sorted((r.doc_id, r.s.start, r.s.kind, r.s.stop) for r in got) == want


def test_empty_tables(frame):
    assert secrets.secrets_report(frame.limit(0)).count() == pii.pii_report(frame.limit(0)).count() == pii.redact(frame.limit(0)).count() == 0


def test_op6_gives_its_sql_rows(spark, sf_dir):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duck.sql(queries.SQL["op6_secret_scans"]).fetchall()
    assert sorted(tuple(r) for r in queries.QUERIES["op6_secret_scans"](spark, sf_dir).collect()) == sorted(want)
