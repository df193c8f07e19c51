import math
import random
from collections import Counter

import corpus_pipeline
import sentencepiece
from test_minhash import shingles
from test_native import BASE, base_spans, poisson, unit
from test_quality_tokenize import brute_quality

from foliant.llm import tokenize


def made():
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(120):
        text = " ".join(word() for _ in range(r.randrange(25, 90)))
        if i % 5 == 0:
            text += " write to a.b@mail.example.com now"
        rows.append([i, text, "en", f"s{i % 3}", len(text)])
    rows += [[200 + i, rows[i][1] + " tail", "en", "s9", 0] for i in range(30)]
    rows += [[300, "too short", "en", "s0", 9], [301, None, None, None, None], [302, "again and again this line here\n" * 30, "en", "s0", 1], [303, " ".join(f"{word()}###" for _ in range(50)), "en", "s1", 1]]
    return [tuple(x) for x in rows]


def brute(rows):
    kept = [x for x in rows if not brute_quality(x[1])[5] and x[0] not in (302, 303)]
    sets = {x[0]: shingles(x[1]) for x in kept}
    kept = [x for x in kept if not any(y < x[0] and 100 * len(sets[y] & sets[x[0]]) >= 80 * len(sets[y] | sets[x[0]]) for y in sets)]
    clean = []
    for k, text, _, source, _ in kept:
        for kind, a, b in sorted((s for s in base_spans(text)), key=lambda s: -s[1]):
            text = f"{text[:a]}<{kind.upper()}>{text[b:]}"
        clean.append((k, text, source))
    have = Counter()
    for _, text, source in clean:
        have[source] += len(text)
    total, roots = sum(have.values()), sum(math.sqrt(n) for n in have.values())
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenize.default_model())
    out = []
    for k, text, source in clean:
        rate = math.sqrt(have[source]) / roots * total / have[source]
        ids = sp.encode(text)
        out += [(k, len(ids), tuple(ids))] * poisson(rate, unit(f"17:{k}:1"))
    return out


def test_run_matches_brute_force(spark, tmp_path):
    assert BASE
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in got) == sorted(brute(rows))


def test_stages_keep_the_columns(spark):
    df = spark.createDataFrame(made(), "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (df, df.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, "")
            assert docs.dtypes == df.dtypes
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_stages_keep_clashing_columns(spark):
    names = "doc_id long, text string, lang string, source string, n_chars long, copy string, shuffle_key string, kept string, `a.b` string"
    rows = [(i, f"{'word ' * 3}{' '.join(f'w{i}x{k}' for k in range(30))}", "en", "s", 1, f"c{i}", "k", "z", "d") for i in range(40)]
    rows += [(50, None, None, None, None, None, None, None, None), (51, "", "en", "s", 0, "", "", "", "")]
    df = spark.createDataFrame(rows, names)
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == df.columns
    assert all(r["copy"] == f"c{r.doc_id}" for r in docs.collect()) and docs.count()


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
