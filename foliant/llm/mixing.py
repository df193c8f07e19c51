"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the corpus over its own size. A
document's number of copies is the Poisson quantile of a uniform number hashed from seed and
id, so it depends on nothing else and any executor finds the same one. Copies are then
shuffled globally by a hashed key. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rate above this is drawn as the sum of independent Poisson numbers with rates up to it.
RATE_PART = 8.0
#: A Poisson number of rate RATE_PART is below this but for a chance under 1e-30.
QUANTILES = 64
#: Rates of at most so many sources are broadcast; more are joined by salted source.
BROADCAST_SOURCES = 20_000
SALT = 64
TEMPERATURE = 0.5
SEED = 17


def _unit(text: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(df: DataFrame, source_col: str, size: Column, weights: dict[str, float] | None = None, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """(source, rate): mean copies of each document.

    The output is to be ``epochs`` times as large as the input, dealt to sources by
    ``weights`` (sources not named get none) or, without them, by their size to the power
    ``temperature``. ``size`` is a document's size.
    """
    sizes = df.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("size")).where("size > 0")
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(temperature))))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        named = sizes.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "named string, weight double")
        sizes = sizes.join(named, F.col("source").eqNullSafe(F.col("named")), "left").select("source", "size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    # One row of totals, whatever the number of sources.
    total = sizes.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    return sizes.crossJoin(F.broadcast(total)).select("source", F.coalesce(F.col("weight") / F.nullif(F.col("all_weight"), F.lit(0.0)) * F.col("all_size") * float(epochs) / F.col("size"), F.lit(0.0)).alias("rate"))


def _with_quantiles(rates: DataFrame) -> DataFrame:
    """Adds parts (Poisson numbers to sum) and cdf (array of QUANTILES cumulative chances of one)."""
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / RATE_PART)).cast("int")
    step = F.col("rate") / F.col("parts")

    def add(acc: Column, k: Column) -> Column:
        p = acc["p"] * step / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(acc["cdf"][F.size(acc["cdf"]) - 1] + p)).alias("cdf"))

    start = F.struct(F.exp(-step).alias("p"), F.array(F.exp(-step)).alias("cdf"))
    return rates.withColumn("parts", parts).withColumn("cdf", F.aggregate(F.sequence(F.lit(1), F.lit(QUANTILES)), start, add, lambda acc: acc["cdf"]))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE,
    epochs: float = 1.0,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """Copies of documents in their target mix, in a global random order.

    Returns the columns ``keep`` (all of the input's by default) of each copy, with copy
    (1, 2, ...) and shuffle_key (long; the rows' order). A null source is a source of its
    own. A document of size 0 still gets copies if its source has a rate. Repeated rows are
    drawn alike, as they have the same id; a null id counts as the text ``null``. An empty
    table gives an empty result. Input columns may have any names.
    """
    names = df.columns if keep is None else keep
    size = F.lit(1) if size is None else size
    rates = _with_quantiles(source_rates(df, source_col, size, weights, temperature, epochs)).select(*(F.col(c).alias(f"__mix_{c}") for c in ("source", "parts", "cdf")))
    id_text = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    docs = df.select(*(F.col(f"`{c}`").alias(f"__doc_{i}") for i, c in enumerate(names)), id_text.alias("__mix_id"), F.col(source_col).alias("__mix_own"))
    same = F.col("__mix_own").eqNullSafe(F.col("__mix_source"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        docs = docs.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        docs = docs.withColumn("__mix_deal", F.pmod(F.crc32("__mix_id"), F.lit(SALT)).cast("int")).join(salted, same & (F.col("__mix_deal") == F.col("__mix_salt")))
    draw = lambda j: _unit(F.concat_ws(":", F.lit(str(seed)), F.col("__mix_id"), j.cast("string")))
    drawn = F.transform(F.sequence(F.lit(1), F.col("__mix_parts")), draw)
    one = lambda u: F.size(F.filter(F.col("__mix_cdf"), lambda c: c <= u))
    copies = F.aggregate(drawn, F.lit(0), lambda n, u: n + one(u))
    docs = docs.withColumn("__mix_n", copies).where("__mix_n > 0").drop("__mix_cdf").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_n").cast("long"))))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"shuffle {seed}"), F.col("__mix_id"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    out = docs.select(*(c for c in docs.columns if c.startswith("__doc_")), "copy", key.alias("shuffle_key")).orderBy("shuffle_key")
    own = {"copy", "shuffle_key"} & set(names)
    if own:
        return out.drop(*own).toDF(*names, *(c for c in ("copy", "shuffle_key") if c not in own))
    return out.toDF(*names, "copy", "shuffle_key")


def sql(temperature: float = TEMPERATURE, seed: int = SEED) -> str:
    """The same copies in DuckDB SQL."""
    return f"""
WITH s AS (SELECT source, sum(coalesce(strlen(text), 0))::DOUBLE AS size FROM documents GROUP BY 1 HAVING size > 0),
r AS (SELECT source, pow(size, {temperature}) / sum(pow(size, {temperature})) OVER () * sum(size) OVER () / size AS rate FROM s),
p AS (SELECT source, rate, greatest(1, ceil(rate / {RATE_PART}))::BIGINT AS parts FROM r),
c AS (SELECT source, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
      FROM p, (SELECT unnest(generate_series(0, {QUANTILES})) AS k)),
d AS (SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null') AS id FROM documents),
u AS (SELECT doc_id, source, id, ('0x' || substr(md5('{seed}:' || id || ':' || j), 1, 13))::BIGINT / {float(1 << 52)} AS u
      FROM (SELECT d.*, unnest(generate_series(1, p.parts)) AS j FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)),
n AS (SELECT doc_id, source, id, sum((SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u))::BIGINT AS n FROM u GROUP BY 1, 2, 3)
SELECT doc_id, source, copy, ('0x' || substr(md5('shuffle {seed}:' || id || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM (SELECT doc_id, source, id, unnest(generate_series(1, n)) AS copy FROM n WHERE n > 0)"""
