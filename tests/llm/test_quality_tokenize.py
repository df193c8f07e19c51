import collections
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.llm import quality, tokenize

TEXTS = [None, "", " ", "\n\n", "a", " a  b ", "a▁b ▁▁c", "é\tñ\n x　y", "no breaks" * 50, "\x00 \x01", "🙂 🙂\n🙂"]


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if count[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(inside) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed


def made(seed):
    r = random.Random(seed)
    vocab = ["the", "a", "é", "#x", "of", "und", "b|c", "token"]
    return [("\n" if r.random() < 0.2 else " ").join(r.choice(vocab) for _ in range(r.randrange(0, 200))) * r.choice([1, 1, 2]) for _ in range(60)]


@pytest.fixture(scope="module")
def texts():
    return TEXTS + made(1) + ["x y\n"] * 2 + ["word " * 30000, "z" * 2_000_000]


def test_quality_counts_match_brute_force(spark, texts):
    df = spark.createDataFrame([(i if i != 3 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = [tuple(r) for r in quality.score_quality(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    assert sorted(got, key=str) == sorted(((i if i != 3 else None, *brute_quality(t)) for i, t in enumerate(texts)), key=str)


def test_quality_verdict_and_passthrough(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(1, good), (2, "spam line here\n" * 40), (3, good + " ### $$$" * 40), (4, None), (1, good)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.kept) for r in quality.score_quality(df).collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    left = quality.score_quality(df.withColumnRenamed("doc_id", "kept"), id_col="kept", passthrough=True)
    assert left.columns == ["kept", "text"] and sorted(map(tuple, left.collect())) == [(1, good), (1, good)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.score_quality(df).count() == tokenize.encode_documents(df).count() == 0


def test_tokens_match_the_library(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenize.default_model())
    short = [t for t in texts if len(t or "") < 200_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(short)], "doc_id long, text string, ids string")
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.ids_sha256, r.decoded, r.decoded_sha256) for r in tokenize.encode_documents(df).collect()}
    for i, t in enumerate(short):
        ids = sp.encode(t or "")
        back = sp.decode(ids)
        assert got[i] == (len(ids), ids, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), back, hashlib.sha256(back.encode()).hexdigest())


encoder = tokenize.ChunkEncoder(tokenize.load_model(), table_words=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab e▁ \n\té　🙂ﬁÉ0.,́")), max_size=40), max_size=5))
def test_encoder_is_exact(batch):
    assert encoder.separable
    assert encoder.encode(batch) == [encoder.library.encode(t) for t in batch]
