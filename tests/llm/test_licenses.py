import random
import re

from gridsmith.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]
LONG = {t.label: " ".join(w.decode() for w in t.words) for t in licenses.TEMPLATES if not t.base}


def plain(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = sorted((i, label) for phrase, label in PHRASES for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase)
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def test_base_places_are_all_found(spark, documents, texts):
    rows = [*texts, (500, "MIT-License mit license; General public LICENSE, Apache, license apache licenseé"), (501, "a" * 10 + " " + "mit license " * 300), (502, None), (502, None)]
    frame = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, score int")
    got = licenses.scan_licenses(frame).collect()
    want = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(want[r.doc_id]), r
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert licenses.scan_licenses(documents.limit(0)).count() == 0


def plain_labels(text):
    """Every template at every place of its key phrase, give or take two words, by comparing all words."""
    w = licenses.words_of(text)
    out, best = {x for x in plain(text)[4].split(",") if x}, 0.0
    best = 1.0 if out else 0.0
    for t in licenses.TEMPLATES:
        key_at = next(i for i in range(len(t.words)) if t.words[i : i + len(t.key)] == t.key)
        for p in range(len(w)):
            if not t.base and tuple(w[p : p + len(t.key)]) == t.key:
                for shift in range(p - key_at - 2, p - key_at + 3):
                    same = [x for q, x in enumerate(t.words) if 0 <= shift + q < len(w) and w[shift + q] == x]
                    if len(set(same)) >= 3:
                        out.add(t.label)
                        best = max(best, len(same) / len(t.words))
    return ",".join(sorted(out)), best


def test_labels_are_those_of_a_plain_search(spark):
    r = random.Random(3)
    long = list(LONG.values())
    changed = [" ".join(w if r.random() > 0.1 else r.choice(["the", "software", w + "x", ""]) for w in text.split()) for text in long * 3]
    mixed = [" ".join(r.sample(long, 3)) + " mit license " + " ".join(r.choice(["cc", "by", "nc", "free", "x"]) for _ in range(40)) for _ in range(10)]
    rows = list(enumerate(["head words " + text.replace("software", "program", 1) + " tail" for text in long] + changed + mixed + ["", "cc by nc"]))
    got = {x.doc_id: (x.labels, x.score) for x in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        labels, score = plain_labels(text)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-12, text
    for k, (label, text) in enumerate(LONG.items()):
        assert label in got[k][0].split(",") or "software" in " ".join(x.decode() for t in licenses.TEMPLATES if t.label == label for x in t.key), label
        assert licenses.Scanner(10, {}).scan(licenses.words_of(text))[2] == 1.0


def test_the_mandatory_phrase_is_needed():
    scanner = licenses.Scanner(10, {})
    words = licenses.words_of(LONG["bsd"].replace("binary forms", "other forms"))
    assert scanner.scan(words)[1] == []


def test_a_file_of_many_licenses_keeps_them_all():
    for frequencies in ({}, {w: 1 + i % 50 for i, w in enumerate(licenses.VOCABULARY)}):
        scanner = licenses.Scanner(100, frequencies)
        for names in (["mit", "isc", "bsd", "mpl"], ["mit", "mpl", "epl", "cc"], list(LONG)):
            _, labels, score = scanner.scan(licenses.words_of(" and also ".join(LONG[x] for x in names)))
            assert set(names) <= set(labels) and score == 1.0


def test_short_creative_commons_notices():
    scanner = licenses.Scanner(10, {})
    assert [scanner.scan(licenses.words_of(f"text under {x} 4.0"))[1] for x in ("CC BY-NC", "CC-BY-SA", "cc by-nc-nd", "CC mail by NC")] == [["cc"], ["cc"], ["cc"], []]
