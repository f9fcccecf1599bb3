"""Mixing of sources to target weights, in Spark's own functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, MOST_REPEATS, SEED = (5, 2, 1), 1.5, 2.0, 42
#: Tables of sources up to this many rows are sent to every executor; longer ones are joined by shuffle.
SENT_SOURCES = 50_000


#: Bits of a draw, and by how many at once the place of the last extra copy is looked for.
DRAW_BITS, STEP_BITS = 52, 13


def _draw():
    """13 hexadecimal digits of a hash of the seed and doc_id (of the text where it is null), as a whole number below 2**52."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words; null text: 0) and draw, a number from a hash of doc_id (of the text where it is null)."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _draw().alias("draw"))


def with_limits(rates: DataFrame, sized: DataFrame) -> DataFrame:
    """rates with limit: documents whose draw is below it are taken once more.

    With the documents of a source in the order of their draws, the limit is where
    the extra copies' words come nearest to the words that whole copies leave open. The
    draws are uniform, so the limit lies about the rate's fraction of their range,
    and that is a document's chance of one more copy; but words taken miss the
    target by half of one document at most, instead of by chance. It is found by
    sums over ranges of draws, 2**STEP_BITS ranges of a source a step, each step
    within the range where the one before it passed the words wanted.
    """
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    state = written(rates.select(F.col("source").alias("__source"), wanted.alias("wanted"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before")).filter("wanted > 0"), "limits")
    for bits in range(DRAW_BITS - STEP_BITS, -1, -STEP_BITS):
        met = sized.join(state, sized.source.eqNullSafe(state["__source"]) & (F.shiftright("draw", bits + STEP_BITS) == F.col("prefix")))
        sums = met.groupBy("__source", F.shiftright("draw", bits).alias("range")).agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"), F.first("before").alias("start"))
        rising = Window.partitionBy("__source").orderBy("range")
        sums = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        last = sums.filter("before < wanted").withColumn("__later", F.row_number().over(Window.partitionBy("__source").orderBy(F.col("range").desc()))).filter("__later = 1")
        state = written(last.select("__source", "wanted", F.col("range").alias("prefix"), "before", "words"), "limits")
    limit = F.col("prefix") + (F.col("before") + F.col("words") / 2 < F.col("wanted")).cast("long")
    return rates.join(state.select("__source", limit.alias("limit")), rates.source.eqNullSafe(F.col("__source")), "left").select(*rates.columns, F.coalesce("limit", F.lit(0)).cast("long").alias("limit"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, target, rate: one row a source.

    Sources in code point order, null last, have the weights in turn. With the
    sources ordered by the level at which each reaches its limit, those before
    some place stand at their limits and the rest share what is left by weight;
    that place is where the shared level is no longer above the limit.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * most)
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    full = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levels = ranked.withColumn("level", (F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum("most").over(full), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")), ignorenulls=True).over(all_rows)
    target = F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    rates = written(rates.withColumnsRenamed({c: f"__{c}" for c in rates.columns}), "rates")
    if rates.count() <= SENT_SOURCES:
        rates = F.broadcast(rates)
    return rows.join(rates, rows.source.eqNullSafe(F.col("__source")))


def _copies(draw):
    return (F.floor("__rate") + (draw < F.col("__limit")).cast("int")).cast("int")


def _rates(sized: DataFrame, how: dict) -> DataFrame:
    return with_limits(written(source_targets(sized, **how), "targets"), sized)


def mix_plan(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken (size times copies).

    A document is taken floor(rate) times and once more if its draw is below its
    source's limit, so never more than the repeat limit; draws depend on doc_id and the
    seed alone, and repeated rows are taken alike. A source without words has rate
    0. Extra columns are ignored; an empty table gives no rows.
    """
    sized = written(sizes(docs), "sizes")
    rated = _with_rates(sized, _rates(sized, how)).withColumn("copies", _copies(F.col("draw")))
    return rated.select("doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """Every row of docs as often as its plan says, with the columns of docs.

    Null and empty texts have size 0 and are taken as often as their source's rate
    says; a null source is a source; an empty table gives no rows. Columns of docs may
    have any other names.
    """
    rates = _rates(written(sizes(docs), "sizes"), how)
    rated = _with_rates(docs.withColumn("__draw", _draw()), rates).withColumn("__copies", _copies(F.col("__draw")))
    return rated.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), F.col("__copies")))).select(*docs.columns)


def mix_sql(weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> str:
    """The plan of mix_plan over the table documents, for DuckDB."""
    case = " ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(weights))
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 13))::BIGINT AS draw
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, source_size * {most}::DOUBLE AS most,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} {case} END::DOUBLE AS weight
  FROM totals),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * {share}::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
chosen AS (SELECT arg_min(level, most / weight) AS level FROM levels WHERE level * weight <= most),
rates AS (
  SELECT source, source_size, least(most, coalesce((SELECT level FROM chosen), 'inf'::DOUBLE) * weight) AS target,
    CASE WHEN source_size > 0 THEN least(most, coalesce((SELECT level FROM chosen), 'inf'::DOUBLE) * weight) / source_size ELSE 0 END AS rate
  FROM levels),
drawn AS (
  SELECT rates.source, draw, sum(size) AS words, any_value(target - floor(rate) * source_size) AS wanted
  FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source GROUP BY rates.source, draw),
passed AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + words / 2 < wanted AS more FROM drawn)
SELECT doc_id, size, source_size, target, size * (floor(rate) + more::INT)::BIGINT AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source JOIN passed ON sized.source IS NOT DISTINCT FROM passed.source AND sized.draw = passed.draw"""
