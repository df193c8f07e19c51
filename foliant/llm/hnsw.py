"""Near-duplicate embeddings: hierarchical navigable small-world graphs by shard.

Equal vectors of a label are one node. Nodes of a label are dealt to shards of about
SHARD_ROWS; each shard gets a graph, and every node queries its own shard and half of the
others (a pair of shards is searched from one side, so each pair of nodes is seen once). A beam
search finds the way; from nodes over the threshold a flood over the graph then widens the
beam to all that are linked to the query, however many. Sampled queries are audited against
all nodes of the shard: below TARGET_RECALL the beam is doubled and the block searched again,
up to a beam that covers the shard. Cosines are confirmed in double precision. A task returns
a count and a local component for each node it saw, never all pairs.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.components import connected_components
from foliant.sources.scratch import written

MIN_COSINE = 0.93
SHARD_ROWS = 8192
LINKS = 16  # links that a new node picks
SLOTS = 48  # links that a node can hold
FIXED = 6  # of its own first picks, which later links never displace
BUILD_BEAM = 48
BEAM = 48
TARGET_RECALL = 0.995
AUDITS = 64
#: The flood also passes nodes that miss the threshold by this much.
SLACK = 0.05
QUERY_BLOCK = 512
#: Vectors that travel to another shard's graph in one row.
ASK_BLOCK = 2048


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: none) and cosines of the best ``beam`` nodes found for each query, best first.

    All queries move in step: each round every query opens its ``wide`` best unopened nodes.
    """
    n, slots = len(vectors), links.shape[1]
    seen = np.zeros((len(queries), n), bool)
    ids = np.full((len(queries), beam), -1, np.int64)
    sims = np.full((len(queries), beam), -np.inf, np.float32)
    opened = np.zeros((len(queries), beam), bool)
    fresh, rows = starts, np.arange(len(queries))
    while True:
        # Each id once a row, and none that the row has seen.
        fresh = np.sort(fresh, axis=1)
        good = fresh >= 0
        good[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
        good &= ~seen[rows[:, None], np.maximum(fresh, 0)]
        at, column = np.nonzero(good)
        node = fresh[at, column]
        seen[rows[at], node] = True
        got = np.full(fresh.shape, -np.inf, np.float32)
        got[at, column] = np.einsum("ij,ij->i", queries[rows[at]], vectors[node])
        all_sims = np.concatenate([sims[rows], got], 1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        sims[rows] = np.take_along_axis(all_sims, order, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], np.where(good, fresh, -1)], 1), order, 1)
        opened[rows] = np.take_along_axis(np.concatenate([opened[rows], ~good], 1), order, 1)
        shut = opened[rows] | (ids[rows] < 0)
        rows = rows[~shut.all(1)]
        if not len(rows):
            return ids, sims
        shut = opened[rows] | (ids[rows] < 0)
        best = np.argsort(shut, axis=1, kind="stable")[:, :wide]
        usable = ~np.take_along_axis(shut, best, 1)
        opened[rows[:, None], best] |= usable
        fresh = np.where(usable[:, :, None], links[ids[rows[:, None], best]], -1).reshape(len(rows), best.shape[1] * slots)



def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (best first), those nearer to the row's node than to one already kept; then the nearest of the rest."""
    rows, width = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    kept = np.zeros(ids.shape, bool)
    for c in range(width):
        rival = np.where(kept, between[:, c], -np.inf).max(1)
        kept[:, c] = (ids[:, c] >= 0) & (sims[:, c] > rival) & (kept.sum(1) < keep)
    order = np.argsort(np.where(ids < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(ids, order, 1)


@dataclass
class Hnsw:
    vectors: np.ndarray  # unit, double, most levels first
    layers: list[tuple[int, np.ndarray]]  # (nodes, links) of each layer, densest first; a layer holds the first nodes

    @classmethod
    def build(cls, vectors: np.ndarray, levels: np.ndarray) -> Hnsw:
        """``levels`` must not rise; node i is in layers 0 to levels[i]."""
        graph = cls(vectors, [])
        near = vectors.astype(np.float32)
        layers: list[tuple[int, np.ndarray]] = []
        for level in range(int(levels[0]) if len(levels) else 0, -1, -1):
            n = int((levels >= level).sum())
            links, count = np.full((n, SLOTS), -1, np.int64), np.zeros(n, np.int64)
            weight = np.full((n, SLOTS), np.inf, np.float32)
            at = 0
            while at < n:
                stop = min(n, at + min(max(64, at), QUERY_BLOCK))
                fresh = near[at:stop]
                among = fresh @ fresh.T
                np.fill_diagonal(among, -np.inf)
                first = np.argsort(-among, axis=1, kind="stable")[:, :LINKS]
                ids, sims = first + at, np.take_along_axis(among, first, 1)
                ids = np.where(np.isfinite(sims), ids, -1)
                if at:
                    starts = graph._starts(layers, near, fresh, at)
                    old, old_sims = beam_search(near[:at], links[:at], fresh, starts, BUILD_BEAM)
                    ids, sims = np.concatenate([ids, old], 1), np.concatenate([sims, old_sims], 1)
                order = np.argsort(-sims, axis=1, kind="stable")
                ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
                picked = _diverse(near, ids, sims, LINKS)
                width = picked.shape[1]
                links[at:stop, :width] = picked
                count[at:stop] = (picked >= 0).sum(1)
                have = picked >= 0
                weight[at:stop, :width][have] = np.einsum("ij,ij->i", near[np.arange(at, stop).repeat(have.sum(1))], near[picked[have]])
                weight[at:stop, :FIXED] = np.inf
                cls._link_back(links, weight, count, np.arange(at, stop).repeat(have.sum(1)), picked[have], near)
                at = stop
            layers.insert(0, (n, links))
        graph.layers = layers
        return graph

    @staticmethod
    def _link_back(links: np.ndarray, weight: np.ndarray, count: np.ndarray, source: np.ndarray, target: np.ndarray, near: np.ndarray) -> None:
        """Add source to the links of target; a full node swaps its farthest free link for a nearer one."""
        sims = np.einsum("ij,ij->i", near[source], near[target])
        order = np.lexsort((-sims, target))
        source, target, sims = source[order], target[order], sims[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        for r in range(int(rank.max()) + 1 if len(rank) else 0):
            now = rank == r
            t, s, w = target[now], source[now], sims[now]
            known = (links[t] == s[:, None]).any(1)
            t, s, w = t[~known], s[~known], w[~known]
            full = count[t] >= SLOTS
            slot = np.where(full, np.argmin(weight[t], 1), np.minimum(count[t], SLOTS - 1))
            put = ~full | (weight[t, slot] < w)
            links[t[put], slot[put]] = s[put]
            weight[t[put], slot[put]] = w[put]
            count[t[~full]] += 1

    @staticmethod
    def _starts(layers: list[tuple[int, np.ndarray]], near: np.ndarray, queries: np.ndarray, limit: int) -> np.ndarray:
        """Entry points into the layer under ``layers``, found from the top down."""
        starts = np.zeros((len(queries), 1), np.int64)
        for n, links in reversed(layers):
            starts, _ = beam_search(near[:n], links, queries, starts, 8)
            starts = np.where(starts >= 0, starts, starts[:, :1])
        return np.minimum(starts, limit - 1)

    def search(self, queries: np.ndarray, floor: float, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float | None]:
        """(query, node) of all found pairs with a cosine of ``floor`` or more, and the audited recall (None where no audited query has a link).

        ``own`` are the queries' nodes where they are in this graph; they are not paired with themselves.
        """
        near = self.vectors.astype(np.float32)
        found, audited = [], []
        for at in range(0, len(queries), QUERY_BLOCK):
            block = queries[at : at + QUERY_BLOCK]
            mine = None if own is None else own[at : at + QUERY_BLOCK]
            audits = max(1, AUDITS * len(block) // max(1, len(queries)))
            while True:
                # Where the audited queries have no link, as is common across shards, more are audited.
                pick = np.unique(np.linspace(0, len(block) - 1, audits).astype(int))
                truth = block[pick] @ self.vectors.T >= floor
                if mine is not None:
                    truth[np.arange(len(pick)), mine[pick]] = False
                if truth.any() or audits >= min(AUDITS, len(block)):
                    break
                audits = min(2 * audits, AUDITS, len(block))
            beam = BEAM
            while True:
                hit = self._block(near, block, floor, beam, mine)
                if mine is not None:
                    hit[np.arange(len(block)), mine] = False
                recall = float((hit[pick] & truth).sum() / truth.sum()) if truth.any() else None
                if recall is None or recall >= TARGET_RECALL or beam >= len(self.vectors):
                    break
                beam = min(2 * beam, len(self.vectors))
            if recall is not None:
                audited.append(recall)
            q, node = np.nonzero(hit)
            found.append((q + at, node))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), None
        return np.concatenate([q for q, _ in found]), np.concatenate([n for _, n in found]), min(audited, default=None)

    def _block(self, near: np.ndarray, block: np.ndarray, floor: float, beam: int, own: np.ndarray | None) -> np.ndarray:
        """(queries, nodes) bool: pairs found and confirmed."""
        n, links = self.layers[0]
        if beam >= n:
            return block @ self.vectors.T >= floor
        queries = block.astype(np.float32)
        starts = self._starts(self.layers[1:], near, queries, n)
        if own is not None:
            starts = np.concatenate([starts, own[:, None]], 1)
        ids, sims = beam_search(near, links, queries, starts, beam)
        hit, seen = np.zeros((len(block), n), bool), np.zeros((len(block), n), bool)
        at, column = np.nonzero((ids >= 0) & (sims >= floor - SLACK))
        node = ids[at, column]
        seen[at, node] = True
        while len(at):
            hit[at, node] = np.einsum("ij,ij->i", block[at], self.vectors[node]) >= floor
            after = links[node]
            here = np.repeat(at, after.shape[1])
            after = after.ravel()
            new = (after >= 0) & ~seen[here, np.maximum(after, 0)]
            key = np.unique(here[new] * n + after[new])
            at, node = key // n, key % n
            seen[at, node] = True
            near_enough = np.einsum("ij,ij->i", block[at], self.vectors[node]) >= floor - SLACK
            at, node = at[near_enough], node[near_enough]
        return hit


def _unit(values: pa.ListArray) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for a vector that links with nothing."""
    out: list[np.ndarray | None] = []
    for i in range(len(values)):
        row = values[i]
        x = None if not row.is_valid or row.values.null_count else row.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if x is None or not len(x) or not np.isfinite(x).all() or not x.any():
            out.append(None)
            continue
        x = x / np.abs(x).max()
        out.append(x / np.sqrt(x @ x))
    return out


def _nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, node, vec): node names equal vectors of a label; null for vectors without links."""
    base = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_pylist()
            raw = [None if x is None or label is None else x.tobytes() for x, label in zip(_unit(batch.column(2)), labels, strict=True)]
            node = [None if r is None else hashlib.blake2b(f"{label}:".encode() + r, digest_size=16).digest() for r, label in zip(raw, labels, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(raw, pa.binary())], names=["id", "label", "node", "vec"])

    return base.mapInArrow(work, f"id {base.schema['id'].dataType.simpleString()}, label string, node binary, vec binary")


def _level(node: bytes) -> int:
    """A geometric level: each next one has a sixteenth of the nodes."""
    bits = int.from_bytes(node[-8:], "little")
    level = 0
    while level < 8 and bits & 15 == 0:
        bits >>= 4
        level += 1
    return level


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    nodes = list(pdf["node"])
    order = sorted(range(len(nodes)), key=lambda i: (-_level(nodes[i]), nodes[i]))
    vectors = np.array([np.frombuffer(pdf["vec"].iloc[i], np.float64) for i in order])
    graph = Hnsw.build(vectors, np.array([_level(nodes[i]) for i in order]))
    asked = {"nodes": [nodes[i] for i in order], "copies": pdf["copies"].to_numpy()[order]}
    blocks = [pickle.dumps({"vectors": vectors[at : at + ASK_BLOCK], **{k: v[at : at + ASK_BLOCK] for k, v in asked.items()}}) for at in range(0, len(nodes), ASK_BLOCK)]
    place = {c: pdf[c].iloc[0] for c in ("label", "dim", "shard")}
    return pd.DataFrame([{**place, "block": -1, "body": pickle.dumps({"graph": graph, **asked})}, *({**place, "block": i, "body": x} for i, x in enumerate(blocks))])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index linked to each of n, by repeated minimum over links."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _searched(floor: float):
    """Links found in each graph by its own nodes and by the blocks of vectors that follow it.

    Rows come sorted by graph; a graph comes before the blocks that ask it, so one graph and
    one block are held at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                asked = pickle.loads(batch.column(1)[i].as_py())
                if same:
                    index = asked
                queries = index["graph"].vectors if same else asked["vectors"]
                q, node, recall = index["graph"].search(queries, floor, np.arange(len(queries)) if same else None)
                n = len(index["nodes"])
                names = index["nodes"] if same else [*index["nodes"], *asked["nodes"]]
                if same:
                    # Found from either side: count the pair once for each.
                    both = np.unique(np.concatenate([q * n + node, node * n + q]))
                    a, b = both // n, both % n
                    links = np.bincount(a, weights=index["copies"][b], minlength=n)
                else:
                    a, b = q + n, node
                    links = np.concatenate([np.bincount(node, weights=asked["copies"][q], minlength=n), np.bincount(q, weights=index["copies"][node], minlength=len(queries))])
                root = _roots(len(names), a, b)
                some = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in some], pa.binary()), pa.array([names[root[k]] for k in some], pa.binary()), pa.array(links[some].astype(np.int64)), pa.array([recall] * len(some), pa.float64())], names=["node", "root", "links", "recall"])

    return work


def _asks(shards: Column) -> Column:
    """The shards that a shard's vectors are sent to: of each pair of shards one asks the other, each about as often."""
    other = lambda t: ((t < F.col("shard")) & ((t + F.col("shard")) % 2 == 0)) | ((t > F.col("shard")) & ((t + F.col("shard")) % 2 == 1))
    return F.filter(F.sequence(F.lit(0), shards - 1), other)


def near_duplicate_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links between vectors of one label with a cosine of ``min_cosine`` or more.

    Returns one row per input row: ``id_col``, n_links (other rows linked directly),
    component_id (smallest id reachable), kept, recall (lowest audited recall of the searches
    that linked it; null without links or audited ones). Rows with a null label, or a vector that is null,
    empty, zero or holds nulls or non-finite numbers, have no link and are their own component.
    Vectors of different lengths never link. Repeated rows count as links of each other. A
    null id names a component only if all its ids are null. Other columns are not read.
    """
    rows = written(_nodes(df, id_col, vector_col, label_col), "vectors")
    nodes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(F.first("label").alias("label"), F.first("vec").alias("vec"), F.min("id").alias("rep"), F.count("*").alias("copies"))
    nodes = written(nodes.withColumn("dim", F.octet_length("vec") / 8), "nodes").withColumn("dim", F.col("dim").cast("int"))
    shards = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = nodes.join(shards, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    built = dealt.select("label", "dim", "shard", "node", "vec", "copies").groupBy("label", "dim", "shard").applyInPandas(_build_shard, "label string, dim int, shard int, block int, body binary")
    built = written(built, "graphs")
    # A graph travels once, to its own task; from other shards only blocks of vectors follow it.
    graphs = built.where("block < 0").select("label", "dim", "shard", F.lit(-1).alias("asker"), "block", "body")
    asking = built.where("block >= 0").join(shards, ["label", "dim"]).select("label", "dim", F.explode(_asks(F.col("shards"))).alias("target"), F.col("shard").alias("asker"), "block", "body")
    rows_in = graphs.unionByName(asking.withColumnRenamed("target", "shard"))
    order = ["label", "dim", "shard", "asker", "block"]
    dealt_in = rows_in.repartition("label", "dim", "shard").sortWithinPartitions(*order).select((F.col("asker") < 0).alias("same"), "body")
    found = written(dealt_in.mapInArrow(_searched(min_cosine), "node binary, root binary, links long, recall double"), "found")

    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "linked")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("recall").alias("recall"))
    named = nodes.select("node", "rep", "copies").join(counts, "node", "left")
    named = named.join(roots, named["node"] == roots["linked"], "left").withColumn("root", F.coalesce("root", "node"))
    named = written(named.select("node", "rep", "copies", "links", "recall", "root"), "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select(F.col("node").alias("name"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", "recall")
    out = rows.select("id", "node").join(named, rows["node"] == named["name"], "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "recall")
