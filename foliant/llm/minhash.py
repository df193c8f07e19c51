"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join.

1. Each text becomes the set of hashes of its five-word shingles. Equal sets are one class
   (most copies end here), so only different sets meet below.
2. A class has a signature of SYMBOLS b-bit minima. It is split into CHUNKS chunks. Two
   signatures that differ in at most MAX_DISTANCE symbols differ in at most one symbol in
   some chunk (pigeonhole); every class is entered once for each chunk and each symbol of it
   left out, so such a pair shares an entry: none is missed.
3. In each entry every class is measured against the entry's smallest class, its lead, on full
   sets: their sizes, and the shingles that only one of them has (its difference). Sets that
   confirm a link join components.
4. Members of one lead that are still in different components are decided on exact differences:
   for members i and j of a lead of L shingles, with d shingles of the lead missing and r others,
   w = 100 d + percent r, they link exactly if
   ``w_i + w_j <= (100 - percent) L + (100 + percent) x`` where x is what their differences
   share. With x = 0 both are linked to the lead already, so a pair that matters shares some
   difference: only members that meet in the rare-first prefixes of their differences are
   compared, inside the task, where components join at once. At most one link for each member
   is returned, so no row stands for a pair. A lead whose members' differences exceed
   GROUP_ELEMENTS is dealt over tasks by the elements of the prefixes.

At a similarity of 0.85 a linked pair differs in 4.8 of 32 symbols on average and in more
than MAX_DISTANCE with a chance of 3.5e-6; at 0.8, 1.4e-4.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import bytehash as bh
from foliant.llm.components import connected_components
from foliant.sources.scratch import dropped, written

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
SYMBOLS = 32
CHUNKS = 8
WIDTH = SYMBOLS // CHUNKS
#: Errors allowed in a chunk, by leaving that many symbols out.
CHUNK_ERRORS = 1
MAX_DISTANCE = CHUNKS * (CHUNK_ERRORS + 1) - 1
#: Elements of the differences of a lead's members that one task takes; more are dealt out by element.
GROUP_ELEMENTS = 4_000_000
#: Pairs of members are compared in runs of about this many elements.
PAIR_ELEMENTS = 2_000_000
#: Ids to join are broadcast up to this many bytes, with ROW_BYTES added for each; more are shuffled.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 24

_U = np.uint64
_MULTIPLIER = bh.mix(np.arange(1, SYMBOLS + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)
_OFFSET = bh.mix(np.arange(1, SYMBOLS + 1, dtype=_U) * _U(0x9FB21C651E98DF25))


def shingle_sets(part: bh.TextSlice, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than ``size`` words are one shingle, no words none."""
    data = bh.LOWER[part.data]
    w = bh.words(data, part.offsets)
    seq = bh.PrefixHash(bh.PrefixHash(data).span(w.start, w.stop))
    grams = seq.windows(size)
    whole = seq.span(w.offsets[:-1], w.offsets[1:])
    out = []
    for row, (a, b) in enumerate(zip(w.offsets[:-1], w.offsets[1:], strict=True)):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        else:
            out.append(whole[row : row + 1] if b > a else whole[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(rows, SYMBOLS) of 16-bit symbols; all sets must be non-empty."""
    values = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for i in range(SYMBOLS):
        least = np.minimum.reduceat((values ^ _OFFSET[i]) * _MULTIPLIER[i], at)
        out[:, i] = bh.mix(least) >> _U(48)
    return out


def _entries(sig: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH) keys: the chunk, the symbol left out, and the others."""
    s = sig.astype(_U)
    keys = []
    for c in range(CHUNKS):
        for out in range(WIDTH):
            key = np.full(len(s), c * WIDTH + out, _U)
            for i in range(WIDTH):
                if i != out:
                    key = (key << _U(16)) | s[:, c * WIDTH + i]
            keys.append(key)
    return np.array(keys).T


def _as_symbols(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, fp, sig) of each row: set size, 128-bit fingerprint of the set, signature; the last two null for an empty set."""
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bh.text_slices(batch.column(1)):
                sets = shingle_sets(part)
                filled = [i for i, s in enumerate(sets) if len(s)]
                fp: list[bytes | None] = [None] * len(sets)
                sig: list[bytes | None] = [None] * len(sets)
                if filled:
                    for i, s in zip(filled, signatures([sets[i] for i in filled]), strict=True):
                        sig[i] = s.tobytes()
                        fp[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], names=["id", "n", "fp", "sig"])

    return base.mapInArrow(work, f"id {base.schema['id'].dataType.simpleString()}, n long, fp binary, sig binary")


def _sets_of(df: DataFrame, id_col: str, text_col: str, ids: DataFrame) -> DataFrame:
    """(fp, shingles) of the texts of the given ids, one row for each set."""
    few = _is_small(ids, "rep")
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    base = base.join(F.broadcast(ids) if few else ids, base["id"].eqNullSafe(ids["rep"]), "left_semi").select("t")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bh.text_slices(batch.column(0)):
                sets = [s for s in shingle_sets(part) if len(s)]
                if sets:
                    fp = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))], names=["fp", "shingles"])

    return base.mapInArrow(work, "fp binary, shingles array<long>").dropDuplicates(["fp"])


def _is_small(ids: DataFrame, column: str) -> bool:
    """Whether a column of ids is small enough to be broadcast, by its bytes."""
    held = ids.agg(F.sum(F.octet_length(F.coalesce(F.col(column).cast("string"), F.lit(""))) + ROW_BYTES)).first()[0]
    return (held or 0) <= BROADCAST_BYTES


def _joined_sets(pairs: DataFrame, classes: DataFrame, df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[DataFrame]]:
    """``pairs`` (a, na, b, nb) with the shingles of both as sa and sb, and the tables to drop when they are read."""
    pairs = written(pairs, "pairs")
    needed = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    ids = written(classes.join(needed, "fp", "left_semi").select("rep"), "needed")
    sets = written(_sets_of(df, id_col, text_col, ids), "sets")
    joined = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("sb")), "b")
    return joined.select("a", "na", "b", "nb", "sa", "sb"), [pairs, ids, sets]


def _linked(percent: int):
    return 100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, lead b) with their intersection and the shingles that only one of the two has."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            both, diff = [], []
            for i in range(part.num_rows):
                x, lead = (np.asarray(part.column(c)[i].values) for c in (4, 5))
                one = np.setxor1d(x, lead, assume_unique=True)
                both.append((len(x) + len(lead) - len(one)) // 2)
                diff.append(one.tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(both, pa.int64()), pa.array(diff, pa.binary())], names=["a", "na", "b", "nb", "both", "diff"])


def _least_shared(weight: np.ndarray, lead_size: np.ndarray, percent: int) -> np.ndarray:
    """What a member's difference shares at least with that of a partner whose link still matters.

    A partner of a member that is linked to the lead is not, so the pair's weights exceed
    ``(100 - percent) L``. A partner of another member has a difference that can hold x elements
    only with a weight of ``percent / 100 * (w - (100 - percent) L)`` or more.
    """
    over = weight - (100 - percent) * lead_size
    return np.where(over <= 0, weight // (100 + percent) + 1, np.maximum(1, -(-over // 100)))


class _Groups:
    """Components of a task's members; joining two is remembered as a link."""

    def __init__(self, labels: np.ndarray):
        self.root = np.arange(int(labels.max()) + 1 if len(labels) else 0)
        self.labels = labels

    def of(self, rows: np.ndarray) -> np.ndarray:
        return self.root[self.labels[rows]]

    def join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Joins the components of rows x and y pairwise; the positions of pairs that joined two."""
        new, parent = [], self.root
        for k, (a, b) in enumerate(zip(self.labels[x].tolist(), self.labels[y].tolist(), strict=True)):
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                new.append(k)
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        return np.array(new, np.int64)


def member_links(root: np.ndarray, size: np.ndarray, lead_size: int, both: np.ndarray, diffs: list[np.ndarray], percent: int, prefixes: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links (pairs of rows) that join the components of one lead's members as far as all their links would.

    ``prefixes``, where given, are the elements to meet by; else each difference's elements
    but the last ``least shared - 1``, from those that fewest members have on.
    """
    missing, other = lead_size - both, size - both
    weight = 100 * missing + percent * other
    count = np.array([len(x) for x in diffs])
    owner = np.repeat(np.arange(len(diffs)), count)
    _, code, often = np.unique(np.concatenate(diffs), return_inverse=True, return_counts=True)
    held = np.sort(owner * len(often) + code)  # the differences, for looking up
    begin = np.concatenate([[0], np.cumsum(count)])
    if prefixes is None:
        order = np.lexsort((code, often[code], owner))
        rank = np.arange(len(owner)) - begin[owner]
        within = rank < (count - _least_shared(weight, np.full(len(weight), lead_size), percent) + 1)[owner]
        who, what = owner[within], code[order][within]
    else:
        who = np.repeat(np.arange(len(diffs)), [len(x) for x in prefixes])
        _, what = np.unique(np.concatenate(prefixes), return_inverse=True)
    by = np.lexsort((weight[who], what))
    who, what = who[by], what[by]
    first = np.concatenate([[True], what[1:] != what[:-1]]) if len(what) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(what)), 0))
    groups, links, step = _Groups(root), [], 0
    at = np.arange(len(what))
    while True:
        # Each list's member number ``step`` meets those behind it that are in other components.
        at = at[at > start[at] + step]
        if not len(at):
            return links
        x, y = who[start[at] + step], who[at]
        apart = groups.of(x) != groups.of(y)
        if step % 8 == 7:  # lists that are in one component are done
            mixed = np.zeros(len(what) + 1, bool)
            now = groups.of(who)
            mixed[start[now != now[start]]] = True
            at, apart, x, y = (v[mixed[start[at]]] for v in (at, apart, x, y))
        x, y = x[apart], y[apart]
        if len(x):
            pairs = np.unique(np.minimum(x, y) * len(diffs) + np.maximum(x, y))
            x, y = pairs // len(diffs), pairs % len(diffs)
            # The fewer elements are looked up among the more.
            swap = count[x] > count[y]
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            cut = np.cumsum(count[x]) // PAIR_ELEMENTS
            for k in np.unique(cut):
                i, j = x[cut == k], y[cut == k]
                still = groups.of(i) != groups.of(j)
                i, j = i[still], j[still]
                if not len(i):
                    continue
                n = count[i]
                pair = np.repeat(np.arange(len(i)), n)
                element = code[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[i][pair]]
                key = j[pair] * len(often) + element
                place = np.minimum(np.searchsorted(held, key), len(held) - 1)
                shared = np.bincount(pair[held[place] == key], minlength=len(i))
                linked = np.flatnonzero(weight[i] + weight[j] <= (100 - percent) * lead_size + (100 + percent) * shared)
                for k2 in linked[groups.join(i[linked], j[linked])] if len(linked) else ():
                    links.append((int(i[k2]), int(j[k2])))
        step += 1


def _decided(percent: int):
    """Links among the members of each lead, from rows sorted by lead and part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, ["b", "sub"]):
            _, root = np.unique(np.array(rows.column("root").to_pylist(), object), return_inverse=True)
            if root.max() == 0:
                continue
            size, both = rows.column("na").to_numpy(), rows.column("both").to_numpy()
            diffs = [np.frombuffer(x, np.int64) for x in rows.column("diff").to_pylist()]
            prefixes = None
            if rows.column("prefix").null_count == 0:
                prefixes = [np.array(x, np.int64) for x in rows.column("prefix").to_pylist()]
            links = member_links(root, size, rows.column("nb")[0].as_py(), both, diffs, percent, prefixes)
            if links:
                x, y = (pa.array(v) for v in zip(*links, strict=True))
                yield pa.RecordBatch.from_arrays([rows.column("a").take(x), rows.column("a").take(y)], names=["a", "b"])

    return work


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(b, a, n, most, element) rows of differences; ``most`` is how many of them stand in the prefix."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            diffs = [np.frombuffer(x, np.int64) for x in part.column(2).to_pylist()]
            again = pa.array(np.repeat(np.arange(len(diffs)), [len(x) for x in diffs]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(again), part.column(1).take(again), part.column(3).take(again), part.column(4).take(again), pa.array(np.concatenate(diffs))], names=["b", "a", "most", "parts", "element"])


def _dealt(members: DataFrame, big: DataFrame, percent: int) -> DataFrame:
    """The members of leads with many elements, once for each part of the elements by which they meet.

    The elements that fewest members of the lead have come first. ``big`` is (b, parts).
    """
    few = members.join(big, "b")
    missing, other = F.col("nb") - F.col("both"), F.col("na") - F.col("both")
    weight = 100 * missing + percent * other
    over = weight - (100 - percent) * F.col("nb")
    least = F.when(over <= 0, F.floor(weight / (100 + percent)) + 1).otherwise(F.greatest(F.lit(1), F.ceil(over / 100)))
    rows = few.select("b", "a", "diff", (missing + other - least + 1).cast("long").alias("most"), "parts")
    rows = rows.mapInArrow(_elements, "b binary, a binary, most long, parts long, element long")
    often = rows.groupBy("b", "element").agg(F.count("*").alias("often")).where("often > 1")
    order = Window.partitionBy("b", "a").orderBy(F.coalesce("often", F.lit(1)), "element")
    met = rows.join(often, ["b", "element"], "left").withColumn("rank", F.row_number().over(order)).where("rank <= most and often is not null")
    met = met.groupBy("b", "a", (F.pmod(F.xxhash64("element"), F.col("parts")) + 1).alias("sub")).agg(F.collect_list("element").alias("prefix"))
    return members.join(met, ["b", "a"]).select("b", "sub", "a", "na", "nb", "both", "diff", "root", "prefix")


def _grouped(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of rows sorted by ``by``, one at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
        start = 0
        for i, k in enumerate(keys):
            if k != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, start, last = [], i, k
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Groups of documents linked, directly or in steps, by a similarity of ``percent`` or more.

    Returns one row per input row: ``id_col``, n_shingles, component_id (smallest id of the
    group), kept (the id is that smallest one). Words are case-folded in ASCII. A null or
    empty text, or one without words, has no shingle and no link. Rows that repeat an id
    with other text are documents of their own under the same id. A null id never names a
    group unless all its ids are null; component_id is null then, and the row is kept. Other
    columns are not read.
    """
    rows = written(sketch(df, id_col, text_col), "sketches")
    filled = rows.where(F.col("fp").isNotNull())
    classes = written(filled.groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    entries = classes.select("fp", "n", "sig").mapInArrow(_enter, "fp binary, n long, key long")
    least = entries.groupBy("key").agg(F.min(F.struct("fp", "n")).alias("lead"), F.max("fp").alias("most")).where(F.col("lead.fp") != F.col("most"))
    shared = entries.join(least.select("key", "lead"), "key").select("fp", "n", "lead")
    star = shared.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("lead.fp").alias("b"), F.col("lead.n").alias("nb")).where("a != b").distinct()
    joined, spent = _joined_sets(star, classes, df, id_col, text_col)
    measured = written(joined.mapInArrow(_measured, "a binary, na long, b binary, nb long, both long, diff binary"), "measured")
    dropped(*spent)
    links = measured.where(_linked(percent)).select("a", "b")
    roots = written(connected_components(links), "roots")

    rooted = measured.join(roots, measured["a"] == roots["node"], "left").withColumn("root", F.coalesce("root", "a")).drop("node")
    split = rooted.groupBy("b").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum(F.octet_length("diff") / 8).cast("long").alias("held")).where("low != high")
    split = written(split.select("b", F.when(F.col("held") > GROUP_ELEMENTS, F.ceil(4 * F.col("held") / GROUP_ELEMENTS)).cast("long").alias("parts")), "split")
    members = rooted.join(split.select("b"), "b", "left_semi").select("b", F.lit(0).cast("long").alias("sub"), "a", "na", "nb", "both", "diff", "root", F.lit(None).cast("array<long>").alias("prefix"))
    big = split.where("parts is not null")
    groups = members
    if not big.isEmpty():
        members = written(members, "members")
        groups = members.join(big.select("b"), "b", "left_anti").unionByName(_dealt(members.drop("sub", "prefix"), big, percent))
    decided = groups.repartition("b", "sub").sortWithinPartitions("b", "sub", "a").mapInArrow(_decided(percent), "a binary, b binary")
    more = written(decided, "confirmed")
    if not more.isEmpty():
        stars = roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        roots = written(connected_components(stars.unionByName(more)), "roots")

    named = classes.select("fp", "rep").join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least_id = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "root").select(F.col("fp").alias("class"), "component_id")
    out = rows.join(named, rows["fp"] == named["class"], "left")
    component = F.when(F.col("fp").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            keys = _entries(_as_symbols(part.column(2)))
            again = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(again), part.column(1).take(again), pa.array(keys.ravel().view(np.int64))], names=["fp", "n", "key"])


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """The input's rows without near-duplicates: of each group the row with the smallest id stays.

    Rows that repeat a kept id are one document; one of them stays.
    """
    kept = near_duplicates(df, id_col, text_col, percent).where("kept").select(F.col(id_col).alias("__kept_id")).distinct()
    kept = written(kept, "kept")
    few = _is_small(kept, "__kept_id")
    out = df.join(F.broadcast(kept) if few else kept, _same(df[id_col], kept["__kept_id"]), "left_semi")
    repeated = df.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1")
    if repeated.isEmpty():
        return out
    named, unnamed = out.where(F.col(id_col).isNotNull()), out.where(F.col(id_col).isNull())
    return named.dropDuplicates([id_col]).unionByName(unnamed)


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
