"""Mixing sources to target weights, in DataFrame functions alone.

Tokens (words) are summed per source; a source's repetition rate is its target over its size; each
document is emitted floor(rate) times, and once more with the rate's fraction as its chance. These coins are drawn systematically, so that a source's
words come near its target however few its documents are: in the order of size, then of a hash of doc_id, text and the seed, document p (from 0) gets its copy
where floor(p * fraction + start) steps up, from a start in [0, 1) that is a hash of the source and the seed. Of neighbours in size a fixed share is taken, so the words taken
are within the largest document of the target.

Targets: the sources, by code point with null last, weigh 5, 2, 1 and again; together they share all words;
a target stops at ``LIMIT`` times its source's size, and what is over goes to the others by weight until
none is above. That is min(LIMIT * size, level * weight) at the one level where the targets sum to
all words, found by sorting the sources by LIMIT * size / weight. A source without words has target 0.
Null texts have size 0. Rows that repeat doc_id and text stand side by side in that order, and differ by one copy at most; which of them gets it makes no
difference. An empty table gives an empty one; very long texts are counted whole; columns other than doc_id, text and source are kept by ``mixed`` and ignored by
``rated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, n_words, named

WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"
#: Pieces of the coin's range in which rows of a source and size are ranked apart.
CELLS = 256


def coin(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A number in [0, 1) from 48 bits of a hash."""
    whose = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(whose.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """source, source_size -> with target. One row per source is all that these windows sort."""
    place = F.pmod(F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1, F.lit(len(weights)))
    by_cap = Window.orderBy((limit * F.col("source_size")) / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy()
    full = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
        .withColumn("cap", limit * F.col("source_size"))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("others", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("total", F.sum("source_size").over(everything))
        # The level if just the sources before this one are at their limit; the first that holds is the one.
        .withColumn("holds", F.col("cap") * F.col("others") >= (F.col("total") - F.col("before")) * F.col("weight"))
        .withColumn("level", F.min(F.when(F.col("holds"), F.struct((F.col("cap") / F.col("weight")).alias("at"), (F.col("total") - F.col("before")).alias("rest"), F.col("others")))).over(everything))
    )
    share = F.col("weight") * F.col("level.rest") / F.col("level.others")
    return full.select("source", "source_size", F.least(F.col("cap").cast("double"), share).alias("target"))


def rated(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every row; texts are read once and do not move."""
    rows = df.select("doc_id", "source", n_words(F.col("text")).alias("size"), coin(seed=seed).alias("coin"))
    return _with_copies(rows, weights, limit, seed).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _start(source: Column, seed: str) -> Column:
    whose = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(whose.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _with_copies(rows: DataFrame, weights: tuple[int, ...], limit: int, seed: str) -> DataFrame:
    """rows (source, size, coin) with source_size, target, copies.

    Rows are placed by counts of cells (source, size, a piece of the coin's range) and a rank inside the cell, so no source's rows
    meet in one task, and of a source in one task only its cells' counts: as many as its different sizes, times ``CELLS`` at most. Rows are dealt once, by their cell.
    """
    sizes = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, limit).withColumnRenamed("source", "of_source")
    rows = rows.withColumn("cell", F.floor(F.col("coin") * CELLS).cast("int"))
    counts = rows.groupBy("source", "size", "cell").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("source").orderBy("size", "cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*(F.col(c).alias(f"of_{c}") for c in ("source", "size", "cell")), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    same = F.col("source").eqNullSafe(F.col("of_source"))
    placed = rows.join(counts, same & (F.col("size") == F.col("of_size")) & (F.col("cell") == F.col("of_cell"))).drop("of_source", "of_size", "of_cell")
    inside = F.row_number().over(Window.partitionBy("source", "size", "cell").orderBy("coin")) - 1
    placed = placed.withColumn("place", (F.col("before") + inside).cast("double")).drop("before", "cell")
    joined = placed.join(sizes, same).drop("of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    fraction, start = rate - F.floor(rate), _start(F.col("source"), seed)
    extra = F.floor((F.col("place") + 1) * fraction + start) - F.floor(F.col("place") * fraction + start)
    return joined.withColumn("copies", (F.floor(rate) + extra).cast("long")).drop("place")


def mixed(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, seed: str = SEED) -> DataFrame:
    """df's rows, each as often as the mix takes it, with df's columns."""
    row, = fresh(df, "row")
    rows = df.select(F.struct(*named(df)).alias(row), "source", n_words(F.col("text")).alias("size"), coin(seed=seed).alias("coin"))
    out = _with_copies(rows, weights, limit, seed).where(F.col("copies") > 0)
    return out.select(row, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(f"{row}.*")


SQL = f"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS coin
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sizes),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others,
    sum(source_size) OVER () AS total
  FROM weighed),
level AS (
  SELECT CAST(total - before AS DOUBLE) AS rest, CAST(others AS DOUBLE) AS others FROM filled
  WHERE cap * others >= (total - before) * weight ORDER BY cap / weight LIMIT 1),
targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), CAST(weight AS DOUBLE) * level.rest / level.others) AS target FROM filled, level)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM (
  SELECT doc_id, size, source_size, target, CAST(floor(rate) + floor((place + 1) * (rate - floor(rate)) + start) - floor(place * (rate - floor(rate)) + start) AS BIGINT) AS copies FROM (
    SELECT r.doc_id, r.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / t.source_size END AS rate,
      CAST(row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.coin) - 1 AS DOUBLE) AS place,
      CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(r.source, '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656.0 AS start
    FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source))
"""
