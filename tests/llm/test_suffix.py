import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from foliant.llm import suffix


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base, period = text(30), text(120), "ab" * 150
    out = [None, "", "short", "x" * 900, period, period + "c", base, base, base[:400], base[100:]]
    for _ in range(25):
        w = base.split(" ")
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = word()
        out.append(" ".join(w))
    for _ in range(25):
        cut = r.randrange(0, 60)
        out.append(text(r.randrange(0, 40)) + passage[cut : len(passage) - r.randrange(0, 60)] + text(r.randrange(0, 40)))
    return out


@pytest.mark.parametrize(("length", "split"), [(100, 2000), (64, 2), (400, 1)])
def test_removed_bytes_match_brute_force(spark, monkeypatch, length, split):
    monkeypatch.setattr(suffix, "SPLIT_STRETCHES", split)
    monkeypatch.setattr(suffix, "SORT_BLOCK", 3000)
    monkeypatch.setattr(suffix, "PIECE", 1000)
    texts = corpus(length)
    ids = [None if i == 8 else 30 if i in (30, 31) else i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, ["c"] * len(ids))), "doc_id long, text string, crc string").repartition(5)
    got = [tuple(r) for r in suffix.remove_repeats(df, length=length).drop("kept").collect()]
    want = [(i, *x) for i, x in zip(ids, brute(texts, length))]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_suffix_sort_orders_and_extends():
    r = random.Random(1)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(3000)).encode() + b"a" * 200, np.uint8)
    starts = np.array(sorted(r.sample(range(3000), 700)))
    bucket = np.sort(np.array([r.randrange(5) for _ in starts]))
    order = suffix.suffix_sort(data, starts, bucket, 50)
    body = data.tobytes()
    want = sorted(range(len(starts)), key=lambda i: (bucket[i], body[starts[i] : starts[i] + 50], i))
    assert order.tolist() == want


def test_empty(spark):
    assert suffix.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_group_without_equal_strings():
    bodies = [b"a" * 40 + bytes([i]) * 60 + b"z" * 40 for i in (65, 66)]
    found = suffix.repeated_starts(bodies, np.zeros(2, np.int64), np.array([10, 10]), np.array([20, 20]), 100)
    assert found.shape == (0, 2)


def test_ids_of_text_and_texts_with_one_crc(spark):
    # Two texts under one null id that share a crc32 keep their own removals.
    r = random.Random(4)
    body = lambda: "".join(r.choice("abcdefghijklmnop ") for _ in range(460))
    head, seen = body(), {}
    while True:
        text = head + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
        other = seen.setdefault(zlib.crc32(text.encode()), text)
        if other != text:
            break
    shared = body()
    rows = [(None, other + shared), (None, text + body()), ("x", shared), ("x", body()), ("y", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix.remove_repeats(df).collect())
    assert got == sorted((str(k), *v) for (k, _), v in zip(rows, brute([t for _, t in rows], 400), strict=True))


def test_very_long_text(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh ij") for _ in range(1_300_000))
    part = long[700_000:700_900]
    rows = [(1, long), (2, "before " + part + " behind")]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and 900 <= got[1][0] <= 906
