import hashlib
import random
import re
import time
from collections import Counter

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mensura.llm.pii import AGAINST, BASE, CONTEXT, IBAN_LENGTHS, KINDS, LABELERS, WIDE, classifier, found, joined, op7_pii, pii_spans, reliabilities

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


def check(rows, texts):
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (texts[r["doc_id"]], want, r["spans"])
        assert [r[f"n_{k}"] for k in BASE] == [sum(w.startswith(k + ":") for w in want) for k in BASE]
        assert set(want) <= set(r["spans"].split(",")) | {""}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


@given(st.lists(st.lists(st.sampled_from(["1", "4111111111111111", "25", ".", "@", "a.b", "+", "-", " ", "é𝒳", "(", "com", "x_", "192.168.0.300", "+1 (555) 555-0100"]), max_size=14).map("".join), min_size=40, max_size=40))
@settings(max_examples=4, deadline=None)
def test_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii_spans(df).select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
    check(rows.collect(), dict(enumerate(texts)))


def test_added_spans(spark):
    text = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and call (415) 555-0123 or SSN 123-45-6789 by Dr. Anna Smith'
    rows = [(i, text) for i in range(30)] + [(99, "plain words, version 3.11, page 200-10-2000x")]
    got = {r["doc_id"]: r["spans"] for r in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined("spans").alias("spans")).collect()}
    assert {s.split(":")[0] for s in got[0].split(",")} >= {"secret", "phone", "ssn", "name"}
    assert got[99] == ""


def test_reliabilities():
    post, tables = reliabilities({"yyy": 400, "n--": 500, "yy-": 80, "nn".ljust(3, "n"): 20})
    assert post["yyy"] > 0.9 > 0.1 > post["n--"]
    assert all(t["y"][0] > t["y"][1] for t in tables)


def test_corners(spark):
    rows = [(1, None, "a"), (2, "", "a"), (2, "", "a"), (None, "a" * 200000, "b"), (4, "1 " * 60000, "b"), (5, "1.1.1.1 " * 3000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r["doc_id"] or 0, r["n_ip"], len(r["spans"])) for r in pii_spans(df).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 0, 0), (2, 0, 0), (4, 0, 0), (5, 3000, 3000)]
    assert pii_spans(df.limit(0)).count() == 0


def test_names_with_accents(spark):
    """Whole names in German, French and Spanish, also where accents are signs of their own."""
    names = ["Herr Müller", "Frau Schäfer", "Sra. Núñez", "Mme Élodie Lefèvre", "Dr. A\u0301ngel Pe\u0301rez", "Mr Smith"]
    rows = [(i, f"gestern schrieb {n}, und {n} kam") for i, n in enumerate(names)] + [(99, "éMr Smith, Herr müller")]
    extra = {r["doc_id"]: [(c["start"], c["stop"]) for c in r["extra"] if c["kind"] == "name"] for r in found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, n in enumerate(names):
        assert extra[i] == [(16, 16 + len(n)), (22 + len(n), 22 + 2 * len(n))], n
    assert extra[99] == []


def plain_iban(value):
    bare = value.replace(" ", "")
    return IBAN_LENGTHS.get(bare[:2]) == len(bare) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def all_plainly(texts):
    """Base and added spans of each text, by plain loops: candidates, votes, features, the classifier of all their counts."""
    has = lambda p, x: regex.search(p, x) is not None
    base, extra = {}, {}
    for k, text in texts.items():
        text = text or ""
        base[k] = [(KINDS.index(s.split(":")[0]), *map(int, s.split(":")[1:])) for s in brute(text)]
        extra[k] = []
        for kind, (pattern, _, strict, gazetteer, cues) in WIDE.items():
            for m in regex.finditer(pattern, text):
                if any(a < m.end() and m.start() < b for _, a, b in base[k]):
                    continue
                x, ctx = m[0], text[max(0, m.start() - CONTEXT) : m.start()]
                votes = ("y" if has(strict, x) and (kind != "iban" or plain_iban(x)) else "n") + ("y" if has(gazetteer, x) else "-") + ("y" if has(cues, ctx) else "n" if has(AGAINST, ctx) else "-")
                edge = "w" if has("[A-Za-z0-9]", ctx[-1:]) else "s" if has("[#$%&*]", ctx[-1:]) else "o"
                digits = 4 * len(re.sub("[^0-9]", "", x)) // len(x)
                features = (f"kind={kind}", f"{kind} length={min(4, len(x) // 8)}", f"{kind} digits={digits}", f"before={edge}")
                extra[k].append((KINDS.index(kind), m.start(), m.end(), votes, features))
    cells = Counter((c[3], c[4]) for cs in extra.values() for c in cs)
    weights = classifier([(v, list(f), n) for (v, f), n in cells.items()])

    def sure(votes, features):
        return weights[""] + sum(weights.get(f, 0.0) for f in (*features, *(f"{a}={v}" for a, v in zip(LABELERS, votes, strict=True)))) > 0

    return {k: ",".join(f"{KINDS[i]}:{a}:{b}" for i, a, b in sorted(base[k] + [c[:3] for c in extra[k] if sure(*c[3:])])) for k in texts}


def test_added_spans_against_plain_loops(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["spans"] for r in op7_pii(spark, sf).collect()}
    assert got == all_plainly(texts)
    assert sum(s.startswith("secret") or ",secret" in s for s in got.values()) > 5


def test_overlaps(spark):
    """Candidates beside, within and around base spans, in texts of many of both."""
    texts = {1: "+1 415 555 0123 (415) 555-0123 a [at] b.com x@y.org 123-45-6789 10.1.2.3 " * 40, 2: "token = abcdefabcdef123456@x.com secret=1.2.3.4aaaaaaaaaaaaaaa 4111111111111111 078-05-1120 " * 30, 3: "password: " + "f" * 615, 4: "m" * 70 + "(at)mail.example.org"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii_spans(df).select("doc_id", joined("spans").alias("spans")).collect()}
    assert got == all_plainly(texts)
    extra = {r["doc_id"]: [(c["start"], c["stop"]) for c in r["extra"]] for r in found(df).collect()}
    assert extra[3] == [(0, 625)] and extra[4] == [(0, 90)]  # whole, however long


def test_many_matches(spark):
    """200,000 base spans and as many candidates in one text."""
    text = "1.2.3.4 078-05-1120 " * 200_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii_spans(df).select("n_ip", F.size("spans").alias("n")).first()
    assert (r["n_ip"], r["n"]) == (200_000, 400_000)
    assert time.time() - began < 60


def test_secrets_and_names_go_whole(spark):
    texts = {
        1: ("token=eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abc-def_ghi then", "token=eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abc-def_ghi"),
        2: ("set password: hunter2secret!more$stuff99 now", "password: hunter2secret!more$stuff99"),
        3: ("api_key='ab/cd+ef==gh12345678' ok", "api_key='ab/cd+ef==gh12345678'"),
        4: ("Dear Dr. Anna Maria Schmidt, hello", "Dr. Anna Maria Schmidt"),
        5: ("gestern kam Frau Müller-Lüdenscheid an", "Frau Müller-Lüdenscheid"),
        6: ("then Mr. Patrick O'Brien's car", "Mr. Patrick O'Brien"),
        7: ("von Prof. Ursula von der Leyen gesagt", "Prof. Ursula von der Leyen"),
        8: ("Mme Jeanne d'Arc. Then", "Mme Jeanne"),
    }
    rows = found(spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")).collect()
    got = {r["doc_id"]: [texts[r["doc_id"]][0][c["start"] : c["stop"]] for c in r["extra"] if c["kind"] in ("secret", "name")] for r in rows}
    assert got == {k: [want] for k, (_, want) in texts.items()}


def test_account_numbers_by_checksum(spark):
    good = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NO9386011117947"]
    bad = ["DE89 3704 0044 0532 0130 01", "GB82WEST1234569876543", "XX1420041010050500013M02606"]
    rows = [(i, f"to {v} x") for i, v in enumerate(good + bad)]
    votes = {r["doc_id"]: [c["votes"][0] for c in r["extra"] if c["kind"] == "iban"] for r in found(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [votes[i] for i in range(len(good))] == [["y"]] * 4
    assert all(v != ["y"] for i, v in votes.items() if i >= len(good))


def test_gazetteers_are_a_parameter(spark):
    df = spark.createDataFrame([(1, "so Mr Zebulon said")], "doc_id long, text string")
    vote = lambda **g: found(df, **g).first()["extra"][0]["votes"][1]
    assert vote() == "-" and vote(gazetteers={"name": ["Zebulon"]}) == "y"


def test_recall_and_precision_of_added_spans(spark):
    """Planted among prose and look-alikes: what share of added spans is found, and what share of those found was planted."""
    draw = random.Random(8)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))

    def account():
        body = digits(18)
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    make = {
        "iban": lambda: f"the account {account()}",
        "name": lambda: f"signed by Dr. {draw.choice(['Anna', 'Thomas', 'Marie'])} {draw.choice(['Maria Schmidt', 'Müller-Lüdenscheid', 'Dubois'])}",
        "phone": lambda: f"call ({draw.choice(['415', '212', '303'])}) 555-{digits(4)}",
        "secret": lambda: f"config token = {''.join(draw.choice('0123456789abcdef') for _ in range(32))}",
        "ssn": lambda: f"social security {draw.randint(100, 600)}-{draw.randint(10, 99)}-{draw.randint(1000, 9999)}",
    }
    decoys = [lambda: f"order DE{digits(20)}", lambda: f"version 9{digits(2)}-00-{digits(4)}", lambda: f"page 100.200.{digits(4)}", lambda: "see article Mr Then"]
    rows, planted = [], {}
    for i in range(400):
        kind = draw.choice(list(make)) if i % 2 else None
        what = make[kind]() if kind else draw.choice(decoys)()
        rows.append((i, f"words before that are plain and {what} and words after it"))
        planted[i] = kind
    got = {r["doc_id"]: {s.split(":")[0] for s in r["spans"].split(",") if s} for r in pii_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", joined("spans").alias("spans")).collect()}
    hits = sum(k in got[i] for i, k in planted.items() if k)
    false = sum(len(got[i] - {k}) for i, k in planted.items())
    assert hits / sum(k is not None for k in planted.values()) >= 0.95 and hits / (hits + false) >= 0.9, (hits, false)
