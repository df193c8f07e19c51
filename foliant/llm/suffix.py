"""Removal of long repeated byte strings by a hash-compared suffix sort.

Every start of a LENGTH-byte string has an anchor: the start inside it whose GRAM bytes have
the smallest hash. Equal strings have equal anchors at equal distance, so only suffixes that
share both can agree on LENGTH bytes. Neighbouring starts with one anchor form a stretch,
one for about a hundred bytes of text, and stretches are what is shuffled:

1. Stretches that agree byte for byte (by a cryptographic hash) are counted together, first in
   each batch, then by anchor. All strings of a stretch that occurs twice repeat.
2. Where one anchor has several different stretches, one text of each is fetched and their
   suffixes are sorted: prefix polynomial hashes give the hash of any substring at once, a
   binary search over them the common extension of two suffixes, so a comparison takes
   logarithmic time; runs are merged bottom-up. Neighbours in order that agree on LENGTH
   bytes repeat. Agreement is then verified on the bytes.
3. Each document's repeated strings are joined back to its text and cut out.

An anchor with more than SPLIT_STRETCHES different stretches (a passage quoted very often) is
dealt by slices of the distance and, within a slice, by a hash of the bytes that all strings
of the slice hold, so no task has to take all of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import bytehash as bh
from foliant.sources.scratch import dropped, written

LENGTH = 400
SALT = 16
SPLIT_STRETCHES = 2_000
SLICE = 25
#: Suffixes that are sorted at once.
SORT_BLOCK = 100_000
#: Longest piece of a text that is scanned at once.
PIECE = 1 << 19

_U = np.uint64
_POSITION = _U((1 << 20) - 1)


def stretches(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor) of all stretches, as positions in ``data``; no string crosses a row."""
    gram = length // 2
    span = length - gram + 1  # starts of grams in a string
    firsts, lasts, anchors = [], [], []
    for base in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[base : base + PIECE + length - 1]
        h = bh.PrefixHash(piece).windows(gram)
        key = (h & ~_POSITION) | np.arange(len(h), dtype=_U)
        count = len(piece) - length + 1
        if count <= 0:
            continue
        held = np.concatenate([key, np.full(-len(key) % span, ~_U(0))]).reshape(-1, span)
        ahead = np.minimum.accumulate(held, 1).ravel()
        behind = np.minimum.accumulate(held[:, ::-1], 1)[:, ::-1].ravel()
        anchor = (np.minimum(behind[:count], ahead[span - 1 : span - 1 + count]) & _POSITION).astype(np.int64) + base
        start = np.arange(base, base + count)
        row = np.searchsorted(offsets, start, "right") - 1
        valid = start + length <= offsets[row + 1]
        start, anchor, row = start[valid], anchor[valid], row[valid]
        new = np.ones(len(start), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        firsts.append(start[at])
        lasts.append(start[np.append(at[1:], len(start)) - 1] if len(at) else start[:0])
        anchors.append(anchor[at])
    if not firsts:
        none = np.zeros(0, np.int64)
        return none, none, none
    return np.concatenate(firsts), np.concatenate(lasts), np.concatenate(anchors)


def _stretch_rows(batch: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, anchor hash, stretch hash, location) of a batch's stretches; location packs first start, anchor and last start."""
    for part in bh.text_slices(batch.column(2)):
        first, last, anchor = stretches(part.data, part.offsets, length)
        if not len(first):
            continue
        gram = length // 2
        body, digest = part.data.tobytes(), hashlib.blake2b
        row = np.searchsorted(part.offsets, first, "right") - 1
        ahash = np.empty(len(first), np.int64)
        for base in np.unique(first // PIECE * PIECE):  # hashes of anchors, a piece at a time
            here = first // PIECE * PIECE == base
            h = bh.PrefixHash(part.data[base : base + PIECE + length - 1])
            ahash[here] = h.span(anchor[here] - base, anchor[here] - base + gram).view(np.int64)
        inside = anchor - first
        shash = np.frombuffer(b"".join(digest(body[a : b + length], digest_size=8, salt=d.to_bytes(8, "little")).digest() for a, b, d in zip(first.tolist(), last.tolist(), inside.tolist(), strict=True)), np.int64)
        own = first - part.offsets[row]
        yield row + part.first, ahash, shash, (own << 32) | (inside << 16) | (last - first)


def _counted(length: int):
    """Stretches of a batch with their number and one place of each."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_stretch_rows(batch, length))
            if not found:
                continue
            row, ahash, shash, place = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((shash, ahash))
            a, s = ahash[order], shash[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(order)))
            one = order[at]
            rows = pa.array(row[one])
            yield pa.RecordBatch.from_arrays([pa.array(a[at]), pa.array(s[at]), pa.array(count), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place[one])], names=["anchor", "stretch", "n", "id", "digest", "place"])

    return work


def _placed(length: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ahash, shash, place in _stretch_rows(batch, length):
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(ahash), pa.array(shash), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(place)], names=["anchor", "stretch", "id", "digest", "place"])

    return work


def _small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, where they become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _fetch(length: int):
    """Bytes of the wanted stretches of each document; those of a crowded anchor by slice and core."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out: list[tuple] = []
            for text, key, digest, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode()
                for w in wanted:
                    first, inside, more = w["place"] >> 32, (w["place"] >> 16) & 0xFFFF, w["place"] & 0xFFFF
                    anchor = first + inside
                    ranges = [(first, first + more, 0)]
                    if w["kinds"] > SPLIT_STRETCHES:
                        ranges = []
                        for k in range((inside - more) // SLICE, inside // SLICE + 1):  # distances k * SLICE to (k + 1) * SLICE - 1
                            near, far = anchor - k * SLICE, anchor - (k + 1) * SLICE + 1
                            core = hashlib.blake2b(data[near : far + length], digest_size=8, salt=k.to_bytes(8, "little")).digest()
                            ranges.append((max(first, far), min(first + more, near), int.from_bytes(core, "little", signed=True)))
                    out += [(w["anchor"], sub, w["stretch"], w["n"], key, digest, a, anchor - a, b - a, data[a : b + length]) for a, b, sub in ranges]
                    if len(out) >= 4096:
                        yield _as_batch(out, batch.column(1).type)
                        out = []
            if out:
                yield _as_batch(out, batch.column(1).type)

    def _as_batch(out: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [id_type, pa.binary()] + [pa.int64()] * 3 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["anchor", "sub", "stretch", "n", "id", "digest", "first", "inside", "more", "body"])

    return work


def common_extension(h: bh.PrefixHash, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Length, up to ``most``, on which the suffixes at x and y agree, by binary search over prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), most)
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = h.span(x, x + mid) == h.span(y, y + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _less(h: bh.PrefixHash, data: np.ndarray, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Whether the first ``most`` bytes at x sort before those at y; equal strings are not less."""
    out = np.zeros(len(x), bool)
    differ = np.flatnonzero(h.span(x, x + most) != h.span(y, y + most))
    e = common_extension(h, x[differ], y[differ], most - 1)
    out[differ] = data[x[differ] + e] < data[y[differ] + e]
    return out


def suffix_sort(data: np.ndarray, starts: np.ndarray, bucket: np.ndarray, most: int, h: bh.PrefixHash | None = None) -> np.ndarray:
    """Order of ``starts`` by bucket (must be ascending), then by the ``most`` bytes from each; stable.

    A bottom-up mergesort: an element's place in the merged run is its own rank plus its rank
    in the other run, found by binary search with hash comparisons, for all runs at once.
    """
    h = h or bh.PrefixHash(data)
    order = np.arange(len(starts))
    begin = np.searchsorted(bucket, bucket)  # first position of each bucket
    end = np.searchsorted(bucket, bucket, "right")
    width = 1
    largest = int((end - begin).max()) if len(starts) else 0
    while width < largest:
        at = np.arange(len(order))
        rank = at - begin
        run = rank // width
        other = begin + np.where(run % 2 == 0, run + 1, run - 1) * width
        low, high = np.minimum(other, end), np.minimum(other + width, end)
        base, from_right = low.copy(), run % 2 == 1
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            mid = (low[todo] + high[todo]) // 2
            mine, theirs = starts[order[todo]], starts[order[mid]]
            # Elements of the left run go before equal ones of the right run.
            right = from_right[todo]
            goes_on = np.where(right, ~_less(h, data, mine, theirs, most), _less(h, data, theirs, mine, most))
            low[todo] = np.where(goes_on, mid + 1, low[todo])
            high[todo] = np.where(goes_on, high[todo], mid)
        pair = begin + run // 2 * 2 * width
        place = pair + (rank - run * width) + (low - base)
        after = np.empty_like(order)
        after[place] = order
        order = after
        width *= 2
    return order


def repeated_starts(bodies: list[bytes], group: np.ndarray, inside: np.ndarray, more: np.ndarray, length: int) -> np.ndarray:
    """(stretch, start) rows of starts, as distances from a stretch's first, whose strings another stretch of its group holds."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(b) for b in bodies])[:-1]])
    h = bh.PrefixHash(data)
    stretch = np.repeat(np.arange(len(bodies)), more + 1)
    start = np.arange(len(stretch)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    distance = inside[stretch] - start
    order = np.lexsort((distance, group[stretch]))
    stretch, start, distance = stretch[order], start[order], distance[order]
    bucket = np.cumsum(np.append(0, (np.diff(group[stretch]) != 0) | (np.diff(distance) != 0)))[: len(stretch)]
    shared = bh.duplicated(bucket.astype(_U))
    stretch, start, bucket = stretch[shared], start[shared], bucket[shared]
    at = base[stretch] + start
    order = suffix_sort(data, at, bucket, length, h)
    stretch, start, bucket, at = stretch[order], start[order], bucket[order], at[order]
    twins = np.flatnonzero((bucket[1:] == bucket[:-1]) & (h.span(at[1:], at[1:] + length) == h.span(at[:-1], at[:-1] + length)))
    # Verify on the bytes: runs of starts on which the same two stretches agree, each run at once.
    a, b, s = stretch[twins], stretch[twins + 1], start[twins]
    by = np.lexsort((s, b, a))
    a, b, s, twins = a[by], b[by], s[by], twins[by]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (s[1:] != s[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(a))[: len(heads)]
    sure = np.ones(len(a), bool)
    body = data.tobytes()
    for i, j in zip(heads, tails, strict=True):
        x, y, n = int(at[twins[i]]), int(at[twins[i] + 1]), int(j - i) - 1 + length
        if body[x : x + n] != body[y : y + n]:
            sure[i:j] = [body[u : u + length] == body[v : v + length] for u, v in zip(at[twins[i:j]], at[twins[i:j] + 1], strict=True)]
    twins = twins[sure]
    hit = np.zeros(len(at), bool)
    hit[twins] = hit[twins + 1] = True
    return np.stack([stretch[hit], start[hit]], 1)


def _ranges(found: np.ndarray) -> np.ndarray:
    """(stretch, first, last) of runs of consecutive starts."""
    if not len(found):
        return np.zeros((0, 3), np.int64)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 1)
    at = np.flatnonzero(new)
    return np.stack([found[at, 0], found[at, 1], found[np.append(at[1:], len(found)) - 1, 1]], 1)


def _compare(length: int):
    """Repeated starts of stretches that occur once, from rows sorted by anchor and sub."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 1024)
                at += part.num_rows
                held.append(part)
                size += part.num_rows
                if size >= 1024:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    key = _group_keys(rows)
                    whole = int(np.searchsorted(key, key[-1]))  # all groups but the last are complete
                    if whole:
                        yield from _solve(rows.slice(0, whole), length)
                    rest = rows.slice(whole)
                    held, size = [rest], rest.num_rows if whole else 0
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()
            if rows:
                yield from _solve(rows[0], length)

    return work


def _group_keys(rows: pa.RecordBatch) -> np.ndarray:
    a, s = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    return np.cumsum(np.append(0, (np.diff(a) != 0) | (np.diff(s) != 0)))


def _solve(rows: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    group = _group_keys(rows)
    inside, more = rows.column("inside").to_numpy(), rows.column("more").to_numpy()
    alone = ~bh.duplicated(group.astype(_U))
    once = rows.column("n").to_numpy() == 1
    bodies = rows.column("body").to_pylist()
    first = rows.column("first").to_numpy()
    at = 0
    while at < len(group):
        stop = at + 1
        total = more[at] + 1
        while stop < len(group) and (group[stop] == group[stop - 1] or total + more[stop] + 1 <= SORT_BLOCK):
            total += more[stop] + 1
            stop += 1
        use = np.flatnonzero(~alone[at:stop]) + at
        # Distances are independent of each other: a large group goes through in slices of them.
        step = max(1, int(SORT_BLOCK * (length // 2 + 1) // max(total, 1)))
        for low in range(0, length // 2 + 1, step) if total > SORT_BLOCK else [None]:
            if low is None:
                mine, skip, part_inside, part_more = use, np.zeros(len(use), np.int64), inside[use], more[use]
            else:
                skip = np.maximum(0, inside[use] - (low + step - 1))
                last = np.minimum(more[use], inside[use] - low)
                some = skip <= last
                mine, skip, last = use[some], skip[some], last[some]
                part_inside, part_more = inside[mine] - skip, last - skip
            if not len(mine):
                continue
            found = _ranges(repeated_starts([bodies[i][k : k + m + length] for i, k, m in zip(mine, skip, part_more, strict=True)], group[mine], part_inside, part_more, length))
            own = mine[found[:, 0]]
            found, shift, own = found[once[own]], skip[found[:, 0]][once[own]], own[once[own]]
            taken = pa.array(own)
            yield pa.RecordBatch.from_arrays([rows.column("id").take(taken), rows.column("digest").take(taken), pa.array(first[own] + shift + found[:, 1]), pa.array(first[own] + shift + found[:, 2])], names=["id", "digest", "low", "high"])
        at = stop


def _cut(length: int):
    """Removes the strings at the given starts from each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out: list[tuple] = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data = (text or "").encode()
                spans: list[list[int]] = []
                for r in sorted((r["low"], r["high"]) for r in ranges or []):
                    if spans and r[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r[1] + length)
                    else:
                        spans.append([r[0], r[1] + length])
                bounds = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string(), pa.binary()], strict=True))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return work


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Cut out of whole texts, as UTF-8 bytes, all strings of ``length`` bytes that start elsewhere too.

    Returns one row per input row: ``id_col``, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256, kept (the remaining bytes; cutting may split a character). Strings are
    judged on the input; the first occurrence goes too. A null or empty text, or one shorter
    than ``length``, keeps all its bytes. Repeated rows are documents of their own, so long
    ones lose all. Ids may repeat or be null. Other columns are not read.
    """
    if not 16 <= length <= 65_536:
        raise ValueError("length must be between 16 and 65536")
    docs = df.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("digest"), F.col(text_col).cast("string").alias("t"))
    key = f"id {docs.schema['id'].dataType.simpleString()}"
    long = docs.where(F.octet_length("t") >= length)
    counted = long.mapInArrow(_counted(length), f"anchor long, stretch long, n long, {key}, digest binary, place long")
    dealt = counted.withColumn("salt", F.pmod("stretch", F.lit(SALT))).repartition("anchor", "salt")
    kinds = dealt.groupBy("anchor", "salt", "stretch").agg(F.sum("n").alias("n"), F.min(F.struct("id", "digest", "place")).alias("one"))
    sums = kinds.groupBy("anchor", "salt").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    anchors = sums.groupBy("anchor").agg(F.sum("n").alias("all"), F.sum("kinds").alias("kinds")).where("all > 1").select("anchor", "kinds", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    kinds = written(kinds.join(anchors, ["anchor", "salt"]).select("anchor", "stretch", "n", "kinds", "one.*"), "stretches")

    often = kinds.where("n > 1").select("anchor", "stretch")
    places = long.mapInArrow(_placed(length), f"anchor long, stretch long, {key}, digest binary, place long")
    first = F.call_function("shiftright", F.col("place"), F.lit(32))
    repeated = places.join(often, ["anchor", "stretch"], "left_semi").select("id", "digest", first.alias("low"), (first + F.col("place").bitwiseAND(0xFFFF)).alias("high"))
    ranges = _per_document(repeated)
    ranges = written(ranges, "repeated")

    wanted = kinds.where("kinds > 1").groupBy("id", "digest").agg(F.collect_list(F.struct("anchor", "stretch", "n", "kinds", "place")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"id": "id2", "digest": "digest2"})
    same = lambda d, o: d["id"].eqNullSafe(o["id2"]) & (d["digest"] == o["digest2"])
    bodies = long.join(wanted, same(long, wanted)).select("t", "id", "digest", "wanted").mapInArrow(_fetch(length), f"anchor long, sub long, stretch long, n long, {key}, digest binary, first long, inside long, more long, body binary")
    compared = bodies.repartition("anchor", "sub").sortWithinPartitions("anchor", "sub", "stretch", "id", "digest", "first")
    once = written(_per_document(compared.mapInArrow(_compare(length), f"{key}, digest binary, low long, high long")), "compared")

    found = ranges.unionByName(once).groupBy("id", "digest").agg(F.flatten(F.collect_list("ranges")).alias("ranges")).withColumnsRenamed({"id": "id2", "digest": "digest2"})
    cut = docs.join(found, same(docs, found), "left").select("id", "t", "ranges").mapInArrow(_cut(length), f"{key}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return cut.withColumnRenamed("id", id_col)


def _per_document(places: DataFrame) -> DataFrame:
    """Ranges of starts by document; their number is bounded by the document's length."""
    return places.distinct().groupBy("id", "digest").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
