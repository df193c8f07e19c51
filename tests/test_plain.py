"""Re-ranking and page gathering against plain Python, on made rows."""

import random

from foliant.functions.dialect import SPARK
from foliant.operators import answer, retrieve
from foliant.operators.steps import run_steps


def ranked(rows, strict):
    """(chunk, branch) in order, from (chunk, place, contents score, score)."""
    if strict is not None:
        return [(strict, "strict")]
    first = sorted((x for x in rows if x[2] >= 16), key=lambda x: (-x[2], -x[3], x[1]))[:8]
    others = sorted((x for x in rows if x not in first), key=lambda x: (-x[3], x[1]))
    if not first:
        return [(x[0], "default") for x in others[:8]]
    return [(x[0], "contents") for x in first + others[: max(8 - len(first), 1)]]


def test_branches_and_cutoffs(spark):
    r = random.Random(3)
    near, titled, want = [], [], {}
    for q in range(120):
        n, share = r.choice([0, 1, 5, 8, 9, 12, 20]), r.choice([0, 0, 0.2, 0.5, 1])
        rows = [(1000 * q + i, i, r.choice([16, 20, 54]) if r.random() < share else r.choice([0, 15]), float(r.choice([1, 2, 3, 3, 7]))) for i in range(n)]
        strict = r.choice(rows)[0] if rows and r.random() < 0.2 else None
        near += [(q, *x) for x in rows]
        titled += [(q, strict)] if strict is not None else []
        if ranked(rows, strict):
            want[q] = ranked(rows, strict)
    steps = [s for s in retrieve.reranked(SPARK) if s[0] in ("ordered", "parted", "filled", "retrieved")]
    tables = {
        "scored": spark.createDataFrame(near, "question_id long, chunk_id long, place int, toc_score int, score double"),
        "strict_best": spark.createDataFrame(titled, "question_id long, chunk_id long"),
    }
    got = {}
    for x in run_steps(spark, steps, "SELECT question_id, chunk_id, idx, branch FROM retrieved", tables).orderBy("question_id", "idx").collect():
        assert x.idx == len(got.setdefault(x.question_id, []))
        got[x.question_id].append((x.chunk_id, x.branch))
    assert got == want and any(len(v) == 9 for v in got.values())


def gathered(seed, chunks):
    """Ids of the chunks that continue the seed's section, from chunks (id, page, section, text) of its source."""
    _, start, title, content = seed
    general = lambda s: s.lower().startswith("general (page ")
    rows = sorted((c for c in chunks if c[1] >= start), key=lambda c: (c[1], general(c[2]), c[0]))
    at = next((i for i, c in enumerate(rows) if c[1] == start and (c[2].lower() == title.lower() or c[3] == content)), None)
    found, last = [seed[0]], start
    for c in rows[at + 1 :] if at is not None else []:
        if c[1] == start:
            continue
        if c[1] - last > 1 or not general(c[2]) and c[2].lower() != title.lower():
            break
        found.append(c[0])
        last = c[1]
    return found


def test_pages_are_gathered_until_they_break(spark):
    r = random.Random(8)
    best, chunks, want = [], [], {}
    for q in range(150):
        source, own = f"s{q}", []
        for i in range(r.randrange(1, 12)):
            page = r.randrange(0, 7)
            own.append((100 * q + i, page, r.choice(["Alpha", "ALPHA", "Beta", f"General (page {page})", f"General (page {page})"]), r.choice(["one", f"text {i}"])))
        chunk = r.choice(own)
        title = r.choice([chunk[2], "Alpha", "Gamma"])
        best.append((q, "w", source, chunk[0], chunk[1], title, chunk[3], chunk[3]))
        chunks += [("w", source, *c) for c in own] + [("other", source, 100 * q + 99, chunk[1] + 1, "Alpha", "not here")]
        want[q] = gathered((chunk[0], chunk[1], title, chunk[3]), own)
    tables = {
        "best": spark.createDataFrame(best, "question_id long, workspace_id string, source string, chunk_id long, page long, title string, page_content string, body string"),
        "chunks": spark.createDataFrame(chunks, "workspace_id string, source string, chunk_id long, page long, section string, page_content string"),
    }
    got = {}
    for x in run_steps(spark, answer.gathered(SPARK), "SELECT question_id, chunk_id, ord FROM refs", tables).orderBy("question_id", "ord").collect():
        got.setdefault(x.question_id, []).append(x.chunk_id)
    assert got == want and max(map(len, got.values())) > 3
