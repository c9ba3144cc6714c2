"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate, target share over present share.  A uniform number hashed from the
document's id and a seed is put through the inverted Poisson distribution of that mean; the document is repeated
as often as the result says, and the copies are dealt out in the order of another hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A Poisson number of a larger mean is the sum of independent ones of at most this mean.
LARGEST_MEAN = 16.0
#: Terms of the cumulated distribution kept: at mean 16 what lies beyond is under 2**-53.
TERMS = 72
#: Copies made by one step of the second explode.
BLOCK = 1000
#: A table of rates of up to this many rows may be broadcast.
BROADCAST_ROWS = 100_000


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of `parts`."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, temperature: float, epochs: float) -> DataFrame:
    """(source, draws, cdf): into how many draws the mean of a source is split, and the distribution of one draw.

    Shares are measured in characters over all rows.  With `weights` None a source weighs its characters to the power
    `temperature`; a source that `weights` does not name weighs nothing."""
    chars = F.sum(F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long"))
    sizes = docs.groupBy("source").agg(chars.cast("double").alias("chars"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.when(F.col("chars") > 0, F.pow("chars", F.lit(float(temperature)))).otherwise(0.0))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
        sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))
    sizes = sizes.join(F.broadcast(total))  # one row
    rate = F.lit(float(epochs)) * F.col("weight") / F.col("all_weight") * F.col("all_chars") / F.col("chars")
    sizes = sizes.withColumn("rate", F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), rate).otherwise(0.0))
    sizes = sizes.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / LARGEST_MEAN)).cast("int"))
    mean = F.col("rate") / F.col("draws")
    start = F.struct(F.lit(0.0).alias("sum"), F.exp(-mean).alias("term"), F.array().cast("array<double>").alias("cdf"))

    def add(state: Column, k: Column) -> Column:
        reached = state["sum"] + state["term"]
        return F.struct(reached.alias("sum"), (state["term"] * mean / k).alias("term"), F.concat(state["cdf"], F.array(reached)).alias("cdf"))

    cdf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, add, lambda s: s["cdf"])
    return sizes.select("source", "rate", "draws", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: Mapping[str, float] | None = None, *, temperature: float = 0.5, epochs: float = 1.0, seed: str = "mix", marks: bool = True) -> DataFrame:
    """Every column of `docs` (doc_id, text, source, ...) and copy_no, shuffle_key: each row as often as its Poisson
    number says, in an order hashed over all rows.

    The number depends only on the doc_id, the seed and the source's rate, so a rerun or a lost executor gives the
    same rows, and rows that agree in doc_id and source are repeated equally often.  A null doc_id is hashed as "null"; a null
    source is a source of its own; null texts have no characters; a source without characters has rate 0.  An empty
    table gives an empty one.  Columns called copy_no or shuffle_key are replaced (without `marks` none are added and they pass
    through); others pass through."""
    kept = [c for c in docs.columns if not marks or c.lower() not in ("copy_no", "shuffle_key")]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("source").alias("source"))
    rates = source_rates(docs, weights, temperature, epochs)
    # Sources are few as a rule; where they are not, the join is a shuffle that adaptive execution splits.
    few = len(rates.select("source").limit(BROADCAST_ROWS + 1).take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS
    rates = rates.select(F.col("source").alias("of"), "draws", "cdf")
    joined = packed.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col("of")))

    def inverse(draw: Column) -> Column:
        # the cumulated terms rise, so the number drawn is how many of them lie at or under the uniform number
        number = uniform(F.lit(seed), F.col("doc_id"), draw)
        # (bound to a one-element array, so that it is hashed once and not for every term)
        return F.transform(F.array(number), lambda u: F.size(F.filter(F.col("cdf"), lambda c: c <= u)))[0].cast("long")

    count = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0).cast("long"), lambda acc, d: acc + inverse(d))
    counted = joined.select("row", "doc_id", count.alias("n")).where("n > 0")
    blocks = counted.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {BLOCK}"))))
    last = F.least(F.col("n"), (F.col("block") + 1) * BLOCK)
    copies = blocks.withColumn("copy_no", F.explode(F.sequence(F.col("block") * BLOCK + 1, last)))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("copy_no").cast("string")).cast("binary"))
    dealt = copies.select("row", "copy_no", key.alias("shuffle_key"))
    dealt = dealt.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return dealt.select("row.*", "copy_no", "shuffle_key") if marks else dealt.select("row.*")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


SQL = f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS chars FROM documents GROUP BY source),
weighed AS (SELECT *, CASE WHEN chars > 0 THEN sqrt(chars) ELSE 0 END AS weight FROM sizes),
rated AS (SELECT source, CASE WHEN chars > 0 THEN weight / sum(weight) OVER () * sum(chars) OVER () / chars ELSE 0 END AS rate FROM weighed),
drawn AS (SELECT *, greatest(1, ceil(rate / {LARGEST_MEAN}))::BIGINT AS draws FROM rated),
terms AS (SELECT source, draws, k, CASE WHEN rate = 0 THEN (k = 0)::INT ELSE exp(-rate / draws + k * ln(rate / draws) - lgamma(k + 1)) END AS term
  FROM drawn, range({TERMS}) r(k)),
cumulated AS (SELECT source, draws, k, sum(term) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
tables AS (SELECT source, any_value(draws) AS draws, list(c ORDER BY k) AS cdf FROM cumulated GROUP BY source),
rows AS (SELECT *, row_number() OVER () AS row FROM documents),
hashed AS (SELECT d.*, t.cdf, unnest(range(1, draws + 1)) AS draw FROM rows d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
numbers AS (SELECT row, doc_id, text, lang, source, n_chars,
  len(list_filter(cdf, lambda c: c <= ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || draw), 1, 13))::BIGINT / 4503599627370496.0)) AS x FROM hashed),
counted AS (SELECT row, doc_id, text, lang, source, n_chars, sum(x)::BIGINT AS n FROM numbers GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, copy_no,
  md5('mix/order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy_no FROM counted)
"""
