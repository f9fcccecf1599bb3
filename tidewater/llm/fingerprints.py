"""Bottom-k sketches of five-word pieces, in Spark's own functions.

A sketch is the k least distinct 64-bit hashes of a text's pieces, ascending.
Sketches of parts merge into the sketch of the whole; resemblance, containment
and the number of distinct pieces are estimated from sketches alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, SIZE = 128, 5
WHITE = "[\\x20\\x09-\\x0D]+"
#: Ranges of doc_id that neighbours are looked up in: about this many rows each, and this many ranges at most.
RANGE_ROWS, RANGES, FAN = 2000, 4096, 64


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = SIZE) -> DataFrame:
    """Adds column `name`. Fewer than `size` words are one piece; a null or empty text has no pieces."""
    words, hashes = f"__{name}_words", f"__{name}_hashes"
    df = df.withColumn(words, F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WHITE), lambda w: w != ""))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w))).drop(words)
    h = F.col(hashes)
    pieces = F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(size)]))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<long>"))
    return df.withColumn(name, F.slice(F.sort_array(F.array_distinct(pieces)), 1, k)).drop(hashes)


def merged(a, b, k: int = K) -> Column:
    """Sketch of the union of what two sketches were made from."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a, b, k: int = K) -> Column:
    """Estimated share of common pieces among all of two texts; 1 for two texts without pieces."""
    union = merged(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), union)) / F.size(union)).cast("double")


def distinct_pieces(a, k: int = K) -> Column:
    """Estimated number of distinct pieces; exact below k."""
    greatest = F.element_at(a, -1) / F.lit(2.0**64) + F.lit(0.5)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((F.lit(k) - 1) / greatest)


def containment(a, b, k: int = K) -> Column:
    """Estimated share of a's pieces that b has too; 1 where a has none."""
    r = resemblance(a, b, k)
    both = distinct_pieces(a, k) + distinct_pieces(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r * both / (r + 1) / distinct_pieces(a, k)))


def merge_sketches(df: DataFrame, by: list[str], name: str, k: int = K) -> DataFrame:
    """One sketch a group. Each hash is a row and only the k least of a group go on, so no group is ever one large value."""
    rows = df.select(*by, F.explode(name).alias("hash")).distinct()
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).filter(F.col("n") <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias(name))


def as_text(sketch) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _ranges(ids: DataFrame) -> list[int]:
    """Upper ends of ranges of the ids, each an id that occurs, the last the greatest."""
    n = ids.count()
    if not n:
        return []
    many = max(1, min(RANGES, n // RANGE_ROWS))
    ends = ids.agg(F.percentile_approx("at", [(i + 1) / many for i in range(many)], 20 * RANGES), F.max("at")).first()
    return sorted({*ends[0], ends[1]})


def beside_next(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) with next_text, the text of the next doc_id; after the last comes the first.

    No window spans the table: rows are dealt to ranges of doc_id, and the last
    row of a range is looked at again as the head of the range after it. Rows of
    one doc_id follow each other by text; null doc_ids come first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("at"))
    ends = _ranges(rows.select("at"))
    if not ends:
        return rows.withColumns({"range": F.lit(0), "head": F.lit(True), "own": F.lit(True), "next_text": F.lit("")}).limit(0)
    whole = F.array(*[F.lit(x).cast("long") for x in ends])
    coarse = F.array(*[F.lit(x).cast("long") for x in ends[FAN - 1 :: FAN]]) if len(ends) >= FAN else F.array().cast("array<long>")
    rows = rows.withColumn("block", F.size(F.filter(coarse, lambda e: e < F.col("at"))))
    rows = rows.withColumn("range", F.col("block") * FAN + F.size(F.filter(F.slice(whole, F.col("block") * FAN + 1, FAN), lambda e: e < F.col("at"))))
    last = F.get(whole, F.col("range")) == F.col("at")
    slot = lambda r, head, own: F.struct(r.cast("int").alias("range"), F.lit(head).alias("head"), F.lit(own).alias("own"))
    slots = F.when(last, F.array(slot(F.col("range"), False, False), slot((F.col("range") + 1) % len(ends), True, True))).otherwise(F.array(slot(F.col("range"), False, True)))
    dealt = rows.select("doc_id", "text", "at", F.explode(slots).alias("slot")).select("doc_id", "text", "at", "slot.*")
    return dealt.withColumn("next_text", F.lead("text").over(_order()))


def _order():
    return Window.partitionBy("range").orderBy(F.col("head").desc(), "at", "text")


def fingerprint_with_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """For each row its sketch, that of its text with the second half replaced, and that of the next document.

    doc_id, n_chars, edited_sha256, sketch, edited_sketch, next_sketch. A null text
    is empty. Of a text of n code points the last floor(n / 2) give way to the
    first as many (or all) of the next document's text. A table of one row is its
    own next. Repeated rows follow one another; extra columns are ignored; an
    empty table gives no rows.
    """
    paired = with_sketch(beside_next(docs), "text", "sketch", k).withColumn("next_sketch", F.lead("sketch").over(_order())).filter("own")
    length = F.char_length("text")
    half = F.floor(length / 2).cast("int")
    edited = paired.withColumn("edited", F.concat(F.substring("text", F.lit(1), length - half), F.substring("next_text", F.lit(1), half)))
    out = with_sketch(edited.withColumn("n_chars", length.cast("long")).withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "edited_sketch", k)
    return out.select("doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch", "next_sketch")
