"""Personal data, sharding and mixing against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing, pii, sharding

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def noisy(seed, n=300):
    r = random.Random(seed)
    bits = ["a@b.co", ".", "_", "x@y", "@", "1.2.3.4", "256.1.1.1", "0001.02.3.255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "-", " ", "é", "🙂", "12", "7", "%", "\n", "com", "..", "a@b.c_c@d.ee", "000000000000000000000", "5555555555554444"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(0, 25))) for _ in range(n)]


TEXTS = [None, "", "1" * 50_000, "a" * 50_000 + "@", "a.b" * 20_000 + "@c" + ".d" * 20_000, "+1" + "2-" * 30_000, *noisy(3)]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame([(i if i != 1 else None, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    rows = pii.find_pii(df).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = base_spans(TEXTS[1 if r.doc_id is None else r.doc_id])
        assert [(s.kind, s.start, s.end) for s in r.found if s.kind in BASE] == want
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_added_kinds_and_redaction(spark):
    text = 'Pay to IBAN DE89 3704 0044 0532 0130 00 BIC X. SSN 123-45-6789, id 987-65-4321. é token = "9b0b3c6a43eb78aa99cbd7049c572391" call (555) 123-4567 GB82WEST12345698765433 a@b.co'
    far = " filler" * 20
    df = spark.createDataFrame([(1, text.replace(", id", far + ", id"), 5), (2, "plain words only", 6), (3, None, 7)], "doc_id long, text string, n long")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    whole = text.replace(", id", far + ", id")
    assert [(s.kind, whole[s.start : s.end]) for s in got[1].found] == [("email", "a@b.co"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("phone_local", "(555) 123-4567"), ("secret", "9b0b3c6a43eb78aa99cbd7049c572391")]
    assert got[2].spans == got[3].spans == ""
    masked = {r.doc_id: r for r in pii.redact_pii(df).collect()}
    assert masked[1].text == 'Pay to IBAN <IBAN> BIC X. SSN <SSN>' + far + ', id 987-65-4321. é token = "<SECRET>" call <PHONE_LOCAL> GB82WEST12345698765433 <EMAIL>'
    assert masked[2].text == "plain words only" and masked[3].text is None and masked[3].n == 7


def leaf(rows, limit):
    """doc -> (depth, bytes) by splitting buckets one bit at a time."""
    out = {}

    def split(items, depth):
        size = sum(n for _, _, n in items)
        if size <= limit or depth == 48 or len(items) == 1:
            out.update({i: (depth, size) for i, _, _ in items})
            return
        for bit in (0, 1):
            part = [x for x in items if (x[1] >> (47 - depth)) & 1 == bit]
            if part:
                split(part, depth + 1)

    split(rows, 0)
    return out


@pytest.mark.parametrize("limit", [1, 200, 5000, 10**9])
def test_shards_match_brute_force(spark, limit):
    r = random.Random(5)
    texts = ["é" * r.randrange(0, 60) for _ in range(300)] + [None, "", "x" * 900]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, h int")
    want = leaf([(i, int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16), len((t or "").encode())) for i, t in enumerate(texts)], limit)
    rows = sharding.shard_documents(df, limit=limit).collect()
    assert {x.doc_id: (x.depth, x.shard_bytes) for x in rows} == want and len(rows) == len(texts)
    for x in rows:
        assert x.shard == format(int(hashlib.md5(str(x.doc_id).encode()).hexdigest()[:12], 16), "048b")[: x.depth]


def test_repeated_ids_are_dealt_out(spark):
    df = spark.createDataFrame([(7, "x" * 10)] * 500 + [(None, "y" * 30)] * 20 + [(8, "z" * 5)], "doc_id long, text string").repartition(5)
    rows = sharding.shard_documents(df, limit=100).collect()
    held = defaultdict(int)
    for x in rows:
        held[x.shard] += x.n_bytes
    assert len(rows) == 521 and max(held.values()) <= 100
    assert all(held[x.shard] == x.shard_bytes for x in rows)


def test_large_texts_under_one_id_stay_within_the_limit(spark):
    sizes = [49, 60, 51, 50, 1, 99, 100, 150, 0, 30, 30, 30, 50, 50]
    df = spark.createDataFrame([(7, "x" * n) for n in sizes], "doc_id long, text string").repartition(3)
    rows = sharding.shard_documents(df, limit=100).collect()
    held = Counter()
    for x in rows:
        held[x.shard] += x.n_bytes
    assert sorted(x.n_bytes for x in rows) == sorted(sizes) and all(held[x.shard] == x.shard_bytes for x in rows)
    assert sorted(n for n in held.values() if n > 100) == [150]


def poisson(rate, u):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def unit(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)


@pytest.mark.parametrize("salted", [False, True])
def test_copies_match_brute_force(spark, monkeypatch, salted):
    if salted:
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    rows = [(i, "abcd", "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(900, None, None), (901, "zz", None), (None, "q", "hot"), (902, "w", "tiny")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, copy int")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    got = mixing.mix_sources(df, size=size, keep=["doc_id", "source"]).collect()
    have = Counter()
    for _, t, s in rows:
        have[s] += len(t or "")
    weight = {s: math.sqrt(n) for s, n in have.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(have.values()) / have[s] for s in have}
    want = []
    for i, _, s in rows:
        i = "null" if i is None else i
        parts = max(1, math.ceil(rate[s] / 8))
        n = sum(poisson(rate[s] / parts, unit(f"17:{i}:{j}")) for j in range(1, parts + 1))
        want += [(str(i), s, c, int(hashlib.md5(f"shuffle 17:{i}:{c}".encode()).hexdigest()[:15], 16)) for c in range(1, n + 1)]
    assert sorted(("null" if x.doc_id is None else str(x.doc_id), x.source or "", x.copy, x.shuffle_key) for x in got) == sorted((a, b or "", c, d) for a, b, c, d in want)
    assert [x.shuffle_key for x in got] == sorted(x.shuffle_key for x in got)


def test_given_weights_and_empty_tables(spark):
    df = spark.createDataFrame([(i, "a" if i < 500 else "b") for i in range(1000)], "doc_id long, source string")
    got = Counter(r.source for r in mixing.mix_sources(df, weights={"a": 3.0, "c": 1.0}).collect())
    assert set(got) == {"a"} and 900 < got["a"] < 1100  # the weights of sources that occur
    assert mixing.mix_sources(df.limit(0)).count() == 0
    none = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard_documents(none).count() == pii.find_pii(none).count() == 0
