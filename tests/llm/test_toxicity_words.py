"""Both dictionaries are trained on whole texts; windows hold several words."""

import random
import zlib

import numpy as np
import zstandard

from foliant.llm import toxicity


def corpus(marks, seed=3, toxic=24, ordinary=120):
    rng = random.Random(seed)
    names = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(150)]
    plain = lambda n: [rng.choice(names) for _ in range(n)]
    return [" ".join([*plain(40), rng.choice(marks), *plain(40)]) for _ in range(toxic)], [" ".join(plain(80)) for _ in range(ordinary)]


def test_words_and_phrases_of_few_toxic_rows_are_learned():
    marks = ["wretch", "worthlessling", "crawl back under your stone"]
    toxic, ordinary = corpus(marks, ordinary=460)
    ordinary, unseen = ordinary[:400], ordinary[400:]
    scorer = toxicity.Scorer(*toxicity.dictionaries(toxic, ordinary))
    saving = lambda text: max(scorer.saving(w) for w in toxicity.windows(text))
    assert all(saving(f"{ordinary[-1][:200]} {m} {ordinary[-2][:100]}") >= 2 for m in marks)
    assert np.mean([saving(t) >= 2 for t in unseen]) < 0.2


def test_windows_hold_every_word():
    for n in (1, 7, 8, 9, 12, 13, 40):
        words = [f"w{i}" for i in range(n)]
        found = [w.decode().split() for w in toxicity.windows(" \n".join(words))]
        assert sorted({w for x in found for w in x}) == sorted(words) and max(map(len, found)) <= toxicity.WINDOW
        assert all(any(words[i : i + 4] == x[j : j + 4] for x in found for j in range(len(x))) for i in range(max(0, n - 3)))
    assert toxicity.windows("") == toxicity.windows(" \t") == []
    assert max(len(w) for w in toxicity.windows("x" * 100_000)) <= 12 * 65 + 1


def test_ordinary_windows_are_compressed_once(monkeypatch):
    toxic, ordinary = corpus(["wretch"])
    scorer = toxicity.Scorer(*toxicity.dictionaries(toxic, ordinary))
    plain, again = scorer.plain, []

    class Counted:
        def compress(self, window):
            again.append(window)
            return plain.compress(window)

    scorer.plain = Counted()
    texts = [*ordinary, *toxic[:6], "", ordinary[0], "\x00 " * 40, "word " * 500]
    rows = scorer.features(texts)
    cuts = [toxicity.windows(t) for t in texts]
    different = {w for c in cuts for w in c}
    assert 0 < len(again) == len(set(again)) < len(different) / 3
    full = {w: len(plain.compress(w)) - len(scorer.marked.compress(w)) for w in different}
    assert sum(full[w] != 0 for w in different - set(again)) <= len(different) / 200
    for c, row in zip(cuts, rows, strict=True):
        saved = [full[w] if w in again else 0 for w in c] or [0]
        counts = [sum(s >= k for s in saved) for k in toxicity.STEPS]
        n = len(saved)
        assert np.allclose(row, [*np.log1p(counts), *(100 * k / n for k in counts), max(saved), np.log(n), sum(s < 0 for s in saved) / n])
    assert scorer.features([]).shape == (0, rows.shape[1])
    monkeypatch.setattr(toxicity, "HELD_CHARS", 2_000)
    monkeypatch.setattr(toxicity, "HELD_WINDOWS", 3)
    assert (scorer.features(texts) == rows).all()


def test_scores_match_a_plain_scorer(spark):
    toxic, ordinary = corpus(["wretch"], toxic=40)
    rows = [*((i, t, 1) for i, t in enumerate(toxic)), *((1000 + i, t, 0) for i, t in enumerate(ordinary)), (5000, "x " * 30_000 + "wretch", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    usable = lambda k: zlib.crc32(str(k).encode()) % 4 != 2
    order = {r.doc_id: n for n, r in enumerate(docs.orderBy(toxicity.F.xxhash64("doc_id"), "doc_id").collect())}
    learn = sorted((r for r in rows if r[2] is not None and usable(r[0])), key=lambda r: order[r[0]])
    model = toxicity.train([r[1] for r in learn if r[2]], [r[1] for r in learn if not r[2]])

    def compressed(content, window):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(toxicity.LEVEL, dict_size=len(content), source_size=64, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        d.precompute_compress(compression_params=p)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(window))

    def score(text):
        words = text.lower().split()
        cuts = [" " + " ".join(words[i : i + 12]) + " " for i in range(0, max(1, len(words) - 4), 8)]
        saved = [compressed(bytes(8 + len(model.toxic)) + model.ordinary, w.encode()) - compressed(bytes(8) + model.toxic + model.ordinary, w.encode()) for w in cuts]
        n = len(saved)
        counts = [sum(s >= k for s in saved) for k in (1, 2, 3, 4, 5)]
        x = [*(np.log(1 + c) for c in counts), *(100 * c / n for c in counts), max(saved), np.log(n), sum(s < 0 for s in saved) / n]
        return 1 / (1 + np.exp(-(np.array(x) - model.mean) / model.scale @ model.weights[:-1] - model.weights[-1]))

    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, labels).collect()}
    for k, text, _ in [*rows[::9]]:
        assert abs(got[k] - score(text)) < 1e-9
    assert len(got) == len(rows)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1_000)
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT_BYTES", 300)
    docs = spark.createDataFrame([(1, f"copy {i} " * 20) for i in range(50)] + [(2, "y" * 301)] + [(10 + i, "z" * 290) for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), *((10 + i, 1) for i in range(9))], "doc_id long, toxic int")
    toxic, ordinary = toxicity.sample_labelled(docs, labels, "doc_id", "text", "toxic", toxicity.F.lit(True), {1: 100, 0: 100})
    assert ordinary == [] and 1 < len(toxic) and sum(map(len, toxic)) <= 1_000 and sum(t.startswith("copy") for t in toxic) <= 1
