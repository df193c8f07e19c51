"""Extendible hashing of documents into shards under a byte limit.

A directory is indexed by the leading bits of a document's hash. A bucket that is over the
limit splits on its next bit; others stay. Sizes are summed over whole prefixes on the map
side, so a round shuffles at most ``2 ** (ROUND_BITS * (round + 1))`` sums, and only rounds
that still hold oversized buckets run. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.scratch import written

SHARD_BYTES = 4 << 20
#: Bits of the hash that the directory can use.
HASH_BITS = 48
ROUND_BITS = 8


def key_hash(key: Column) -> Column:
    """The first HASH_BITS bits of the MD5 of a key's text, as a long; a null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", h, F.lit(HASH_BITS) - depth)


def directory(rows: DataFrame, limit: int) -> list[tuple[int, DataFrame]]:
    """Tables (bits, cell, depth, bytes) of each round: the leaf that holds each cell, for cells that have one.

    ``rows`` has h and n_bytes. A cell is a prefix of ``bits`` bits; depth is the length of
    the shortest prefix of it whose documents fit the limit; a bucket of one document is not
    split, and at HASH_BITS the leaf is final, whatever its size.
    """
    out: list[tuple[int, DataFrame]] = []
    pending = rows
    low = 0
    while low <= HASH_BITS:
        bits = min(low + ROUND_BITS - 1, HASH_BITS)
        cells = pending.groupBy(_prefix(F.col("h"), bits).alias("cell")).agg(F.sum("n_bytes").alias("n"), F.count("*").alias("docs"))
        levels = cells.select("cell", "n", "docs", F.explode(F.sequence(F.lit(low), F.lit(bits))).alias("depth"))
        levels = levels.withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth")))
        bucket = Window.partitionBy("depth", "bucket")
        sized = levels.withColumn("bytes", F.sum("n").over(bucket)).withColumn("rows", F.sum("docs").over(bucket))
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == HASH_BITS)
        found = sized.groupBy("cell").agg(F.min(F.when(fits, F.struct("depth", "bytes"))).alias("leaf"))
        found = written(found.select("cell", "leaf.depth", "leaf.bytes"), "directory")
        out.append((bits, found))
        left = found.where(F.col("depth").isNull()).select("cell")
        if left.isEmpty():
            break
        pending = pending.withColumn("cell", _prefix(F.col("h"), bits)).join(left, "cell", "left_semi").drop("cell")
        low = bits + 1
    return out


def shard_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """Give every document a shard of at most ``limit`` bytes of text.

    Returns one row per input row: ``id_col``, n_bytes, depth, shard (the leaf's bits as
    text, with ``+k`` for the k-th part of a leaf that no bit can split and ``+textN`` for a large
    text of it), shard_bytes. A null
    or empty text has 0 bytes. A single text over the limit has a shard of its own. Rows that
    repeat an id share a hash, so a hot id ends in a leaf of HASH_BITS bits; its rows are
    dealt out there by running size, a partition at a time, so no task gathers them. Other
    columns are not read. An empty table gives an empty result.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = df.select(F.col(id_col).alias("id"), key_hash(F.col(id_col)).alias("h"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    rows = written(rows, "hashed")
    dirs = directory(rows, limit)
    placed = rows
    for i, (bits, found) in enumerate(dirs):
        hit = found.where(F.col("depth").isNotNull()).select(F.col("cell").alias(f"cell{i}"), F.col("depth").alias(f"depth{i}"), F.col("bytes").alias(f"bytes{i}"))
        placed = placed.join(hit, _prefix(F.col("h"), bits) == F.col(f"cell{i}"), "left")
    pick = lambda name: F.coalesce(*(F.col(f"{name}{i}") for i in range(len(dirs))))
    placed = placed.select("id", "h", "n_bytes", pick("depth").alias("depth"), pick("bytes").alias("shard_bytes"))
    name = F.substring(F.lpad(F.bin("h"), HASH_BITS, "0"), F.lit(1), F.col("depth").cast("int"))
    placed = placed.withColumn("shard", name)
    if dirs[-1][0] == HASH_BITS:
        placed = _deal_out(placed, limit)
    return placed.select(F.col("id").alias(id_col), "n_bytes", F.col("depth").cast("int").alias("depth"), "shard", "shard_bytes")


def _deal_out(placed: DataFrame, limit: int) -> DataFrame:
    """Split leaves of HASH_BITS bits that are over the limit into parts by running size.

    A text of more than half the limit is a part of its own. Another row's part is fixed by the
    bytes before it in its leaf; a part closes at half the limit, so with its last row it holds
    no more than the limit. Only a single text over the limit exceeds it.
    """
    hot = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit)
    rows = written(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    half = max(1, limit // 2)
    over = rows.where(hot & (F.col("n_bytes") <= half)).withColumn("part", F.call_function("shiftright", F.col("at"), F.lit(33)))
    sums = over.groupBy("shard", "part").agg(F.sum("n_bytes").alias("own"))
    before = sums.select("shard", "part", (F.sum("own").over(Window.partitionBy("shard").orderBy("part")) - F.col("own")).alias("before"))
    run = F.sum("n_bytes").over(Window.partitionBy("shard", "part").orderBy("at")) - F.col("n_bytes")
    dealt = over.withColumn("run", run).join(before, ["shard", "part"]).withColumn("k", F.floor((F.col("before") + F.col("run")) / half))
    parts = dealt.groupBy("shard", "k").agg(F.sum("n_bytes").alias("part_bytes"))
    dealt = dealt.join(parts, ["shard", "k"]).withColumn("shard_bytes", F.col("part_bytes")).withColumn("shard", F.concat("shard", F.lit("+"), F.col("k").cast("string")))
    large = rows.where(hot & (F.col("n_bytes") > half)).withColumn("shard", F.concat("shard", F.lit("+text"), F.col("at").cast("string"))).withColumn("shard_bytes", F.col("n_bytes"))
    return rows.where(~hot).drop("at").unionByName(dealt.select(*placed.columns)).unionByName(large.select(*placed.columns))


def sql(limit: int = SHARD_BYTES) -> str:
    """The same shards in DuckDB SQL, for tables without repeated ids."""
    return f"""
WITH d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HASH_BITS // 4}))::BIGINT AS h, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
sized AS (SELECT depth, h >> ({HASH_BITS} - depth) AS bucket, sum(n_bytes)::BIGINT AS bytes, count(*) AS docs FROM d, (SELECT unnest(generate_series(0, {HASH_BITS}))::INT AS depth) GROUP BY 1, 2),
leaf AS (SELECT d.doc_id, d.h, d.n_bytes, min(s.depth) AS depth, min_by(s.bytes, s.depth) AS shard_bytes
         FROM d JOIN sized s ON d.h >> ({HASH_BITS} - s.depth) = s.bucket WHERE s.bytes <= {limit} OR s.docs = 1 OR s.depth = {HASH_BITS} GROUP BY ALL)
SELECT doc_id, n_bytes, depth::INT AS depth, substr(lpad(bin(h), {HASH_BITS}, '0'), 1, depth::INT) AS shard, shard_bytes FROM leaf"""
