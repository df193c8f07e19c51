import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import components, minhash


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    out = []
    for i, (k, _) in enumerate(rows):
        named = [x for x in groups[find(i)] if x is not None]
        least = min(named) if named else None
        out.append((k, len(sets[i]), least, k == least))
    return out


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "the", "The"]
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A B C D E"]
    for size in (30, 80, 200, 400):
        for _ in range(4):
            base = [r.choice(vocab) for _ in range(size)]
            for _ in range(12):
                copy = list(base)
                for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, size // 20])):
                    copy[r.randrange(size)] = r.choice(vocab)
                texts.append(" ".join(copy).upper() if r.random() < 0.1 else "\t".join(copy))
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return [(None, texts[20]), (None, "alone among the null ids"), (5000, texts[21]), (5000, texts[21]), (5000, "other text under this id"), *rows]


@pytest.mark.parametrize(("percent", "split"), [(85, 4_000_000), (80, 1)])
def test_groups_match_brute_force(spark, monkeypatch, percent, split):
    monkeypatch.setattr(minhash, "GROUP_ELEMENTS", split)
    rows = corpus(percent)
    df = spark.createDataFrame([(k, t, 0) for k, t in rows], "doc_id long, text string, n long").repartition(6)
    got = sorted((tuple(r) for r in minhash.near_duplicates(df, percent=percent).collect()), key=str)
    assert got == sorted(brute(rows, percent), key=str)


def test_long_texts_and_keeping_one(spark):
    long = " ".join(f"t{i % 9973}x{i // 9973}" for i in range(60_000))
    rows = [(3, long), (1, long + " end"), (2, "short text here"), (2, "short text here"), (4, None), (9, "short TEXT here")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, rep string")
    kept = minhash.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert minhash.keep_one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(200)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(150)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_loose_copies_give_no_more_links_than_members():
    """Sets that differ in one or two places from a lead: the components are those of all pairs, by at most one link a member."""
    import numpy as np

    r = random.Random(11)
    for percent in (80, 85, 92):
        base = list(range(100))
        sets = []
        for k in range(260):
            s = set(base)
            for _ in range(r.choice([1, 1, 2, 3])):
                at = r.randrange(96)
                s -= set(range(at, at + 5))
                s |= {1000 * k + at + j + 1000 for j in range(5)} if r.random() < 0.5 else {500 + at + j for j in range(5)}
            sets.append(s)
        size, both = np.array([len(s) for s in sets]), np.array([len(s & set(base)) for s in sets])
        linked = lambda a, b: 100 * len(a & b) >= percent * len(a | b)  # noqa: B023, E731
        start = [-1 if linked(s, set(base)) else i for i, s in enumerate(sets)]
        _, root = np.unique(start, return_inverse=True)

        def components(pairs):
            top = {i: i for i in start}

            def find(i):
                while top[i] != i:
                    i = top[i]
                return i

            for i, j in pairs:
                top[find(start[i])] = find(start[j])  # noqa: B023
            return [find(i) for i in start]  # noqa: B023

        everything = components([(i, j) for i in range(len(sets)) for j in range(i) if linked(sets[i], sets[j])])
        diffs = [np.array(sorted(s ^ set(base)), np.int64) for s in sets]
        found = minhash.member_links(root, size, len(base), both, diffs, percent)
        got = components(found)
        same = lambda x: [x.index(v) for v in x]
        assert same(got) == same(everything) and len(found) < len(sets)
        assert all(linked(sets[i], sets[j]) for i, j in found)


def _counting(monkeypatch):
    """Names of the tables that components and near_duplicates write from now on."""
    names = []
    for module in (components, minhash):
        monkeypatch.setattr(module, "written", lambda df, name, f=module.written: names.append(name) or f(df, name))
    return names


def test_star_components_take_one_table(spark, monkeypatch):
    """Links that are stars already are not worked over again; chains and shared children are."""
    names = _counting(monkeypatch)
    stars = [(1, x) for x in range(10, 40)] + [(x, 2) for x in range(50, 60)] + [(1, 10), (7, 7)]
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {1: 1, 2: 2} | {x: 1 for x in range(10, 40)} | {x: 2 for x in range(50, 60)}
    assert names == ["links"]
    for edges in ([(1, 2), (2, 3)], [(1, 3), (2, 3)]):
        got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {1: 1, 2: 1, 3: 1}
    assert components.connected_components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


def test_tables_with_one_reader_are_not_written(spark, monkeypatch):
    """Each file written to a local folder starts a process beside the executor, so a step with one reader has none."""
    names = _counting(monkeypatch)
    rows = corpus(5)
    got = sorted((tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()), key=str)
    assert got == sorted(brute(rows, 80), key=str)
    assert not {"entries", "members"} & set(names)
