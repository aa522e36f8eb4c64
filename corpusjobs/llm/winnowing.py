"""Operator 12: document fingerprints by winnowing, in DataFrame functions alone.

Every run of `gram` code points of a text is hashed as it slides along the text; of each `window` successive hashes the
smallest is kept, the rightmost of equal ones, with its place. So two texts that share gram + window - 1 code points or
more share a hash, wherever these stand.

Texts are cut into chunks of `CHUNK` code points that overlap by what a window needs, so work and memory of a row grow
with its length alone. A window's choice depends on its own code points only. So the fingerprint of a text whose end is
replaced follows from that of the text, that of what is put there, and the windows over the seam, see spliced().

The next document comes from one exchange of the texts: documents fall into ranges of doc_id, whose bounds are quantiles
that Spark counts, and the first row of a range is also sent to the range before it. Ranges number `MOST_RANGES` at most;
each is sorted, which may spill, and none meets the driver.

Defined cases: a null text counts as empty and has the empty fingerprint; a text shorter than gram is one gram, one with
fewer than `window` grams has one window; two empty fingerprints have likeness 1, one of them 0. Documents follow each
other by descending doc_id, null ids last; rows of one doc_id by their texts' hash, so each repeated row is followed by
the next copy; a single row is followed by itself. Very long texts are taken whole; an empty table gives no rows; columns
besides doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

GRAM, WINDOW = 16, 16
CHUNK, CHUNK_BITS = 2048, 12  # a chunk's places, its overlap included, fit in the bits
PLACE_BITS = 32  # of an entry: its hash of 31 bits stands above its place
RANGE_BYTES, MOST_RANGES, RANGES_A_PARTITION = 4 << 20, 1 << 16, 4

def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _long(n: int) -> Column:
    return F.lit(n).cast("long")


def _keys(text: Column, gram: int) -> Column:
    """A number for each gram of a chunk, smaller for smaller hashes and, of equal ones, for later places."""
    grams = F.when(F.char_length(text) >= gram, F.regexp_extract_all(text, F.lit("(?s)(?=(.{%d}))." % gram), 1)).when(F.char_length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(g), 33), CHUNK_BITS).bitwiseOR(_long((1 << CHUNK_BITS) - 1) - i))


def _least(keys: Column, window: int) -> Column:
    """At each place the least key of the window that begins there, by doubling; windows at the end are shorter."""

    def doubled(now: Column, size: int) -> Column:
        step = min(size, window - size)
        if not step:
            return now
        both = F.zip_with(now, F.slice(now, step + 1, 1 << CHUNK_BITS), lambda x, y: F.least(x, y))  # least() passes over nulls
        return both if size + step == window else _let(both, lambda more: doubled(more, size + step))

    return doubled(keys, 1)


def _chosen(keys: Column, window: int, partial: Column) -> Column:
    """The keys that windows choose, in order of their places; too few for a window are one where partial holds."""
    n = F.size(keys)
    windows = F.greatest(n - window + 1, F.when(partial & (n > 0), 1).otherwise(0))
    return F.array_distinct(F.slice(_least(keys, window), F.lit(1), windows))


def _entries(keys: Column, shift: Column) -> Column:
    """Entries of keys, with places counted from shift."""
    last = _long((1 << CHUNK_BITS) - 1)
    return F.transform(keys, lambda k: F.shiftleft(F.shiftright(k, CHUNK_BITS), PLACE_BITS) + (shift + last - k.bitwiseAND(last)))


def hash_of(entry: Column) -> Column:
    return F.shiftright(entry, PLACE_BITS)


def place_of(entry: Column) -> Column:
    return entry.bitwiseAND(_long((1 << PLACE_BITS) - 1))


def _once(entries: Column) -> Column:
    """Entries in order of their places, where neighbours may be equal, each once."""
    return _let(entries, lambda own: F.filter(own, lambda e, i: (i == 0) | (e != F.get(own, i - 1))))


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The chosen hashes of a text that isn't null with their places (code points from 0), as numbers, by place.

    Windows choose later and later places, so chunks repeat at most the last choice of the one before.
    """
    reach = gram + window - 2
    chunks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), 0)

    def of(chunks: Column) -> Column:
        longer = F.zip_with(chunks, F.slice(chunks, 2, 1 << 30), lambda a, b: F.concat(a, F.left(F.coalesce(b, F.lit("")), F.lit(reach))))
        one = F.size(chunks) == 1
        return F.flatten(F.transform(longer, lambda c, i: _let(_keys(c, gram), lambda k: _entries(_chosen(k, window, one), i.cast("long") * CHUNK))))

    return _once(_let(chunks, of))


def spliced(own: Column, own_chars: Column, kept: Column, other: Column, other_chars: Column, taken: Column, seam: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The fingerprint of the first `kept` code points of a text and then the first `taken` of another one.

    own and other are both texts' fingerprints; seam is the last gram + window - 2 code points of the first part, or all,
    with as many of the second. An entry stays if the first window that chooses it lies in the part. That window ends with
    the entry, if its hash isn't above that of the entry before, and else begins as that one leaves.
    """
    t = gram + window - 1

    def inside(entries: Column, chars: Column, most: Column) -> Column:
        last = most - gram  # where the part's last gram stands

        def stays(e: Column, i: Column) -> Column:
            before = F.get(entries, i - 1)
            soon = F.when(i == 0, last >= window - 1).otherwise((hash_of(e) <= hash_of(before)) | (place_of(before) + window <= last))
            return (place_of(e) <= last - window) | (place_of(e) <= last) & soon

        return F.when(chars >= t, F.filter(entries, stays)).otherwise(F.array().cast("array<bigint>"))

    over = _let(_keys(seam, gram), lambda k: _entries(_chosen(k, window, kept + taken < t), F.greatest(kept - (t - 1), F.lit(0)).cast("long")))
    return _once(F.concat(inside(own, own_chars, kept), over, F.transform(inside(other, other_chars, taken), lambda e: e + kept)))


def likeness(a: Column, b: Column) -> Column:
    """Hashes that two fingerprints share by those of either."""
    both = F.size(F.array_union(F.transform(a, hash_of), F.transform(b, hash_of)))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(F.transform(a, hash_of), F.transform(b, hash_of))) / F.greatest(both, F.lit(1)))


def shown(entries: Column) -> Column:
    """A fingerprint as text: each entry in hexadecimal, its place in the last eight digits and its hash before them."""
    return F.array_join(F.transform(entries, lambda e: F.hex(e)), " ")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars and entries of each document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", F.char_length("text").cast("long").alias("n_chars"), winnow(F.col("text"), gram, window).alias("entries"))


def _bounds(rows: DataFrame, ranges: int) -> list:
    """Ascending bounds of about equal ranges of doc_id."""
    if ranges < 2:
        return []
    told = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
    return sorted(set(told or []))


def _range_of(key: Column, bounds: list, kind: str) -> Column:
    """The number of bounds above the key, so later ranges follow earlier ones by descending key; nulls come last."""
    if not bounds:
        return F.lit(0)
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    literal = lambda own: F.array(*map(F.lit, own)).cast(f"array<{kind}>")
    full = F.size(F.filter(literal([g[0] for g in groups]), lambda b: b <= key))  # groups that begin at or below the key
    rest = F.size(F.filter(F.coalesce(F.get(F.array(*map(literal, groups)), full - 1), literal([])), lambda b: b <= key))
    below = F.greatest(full - 1, F.lit(0)) * wide + rest
    return F.when(key.isNull(), len(bounds) + 1).otherwise(len(bounds) - below)


def with_next(docs: DataFrame, make: Callable[[DataFrame], DataFrame], range_bytes: int = RANGE_BYTES) -> DataFrame:
    """docs (doc_id, text) with the columns that make() adds, and a struct `next` of all columns of the following document.

    make() runs once for each row, after the exchange.
    """
    kind = dict(docs.dtypes)["doc_id"]
    key = "doc_id" if kind in ("tinyint", "smallint", "int", "bigint", "double", "float") else "order"
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if key == "order":
        raise TypeError(f"doc_id must be a number, not {kind}")
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = min(MOST_RANGES, max(size // range_bytes, partitions * RANGES_A_PARTITION) + 1)
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("range", _range_of(F.col("doc_id"), _bounds(rows, n), kind))
    firsts = rows.groupBy("range").agg(F.max(F.struct("doc_id", "h")).alias("first")).orderBy("range").collect()  # MOST_RANGES + 1 at most
    told = [(r["range"], firsts[i - 1]["range"], r["first"]["doc_id"], r["first"]["h"]) for i, r in enumerate(firsts)]
    starts = docs.sparkSession.createDataFrame(told, f"range int, before int, first_id {kind}, first_h long")
    sent = rows.join(F.broadcast(starts), "range")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    own = F.struct(F.col("range"), F.lit(False).alias("guest"))
    sent = sent.select("doc_id", "text", "h", F.explode(F.when(is_first, F.array(own, F.struct(F.col("before").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array(own))).alias("at"))
    sent = sent.select("doc_id", "text", "h", "at.range", "at.guest").repartition(max(partitions, n // RANGES_A_PARTITION), "range")
    order = [F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("h").desc()]
    made = make(sent.sortWithinPartitions("range", *order))
    add = [c for c in made.columns if c not in ("h", "range", "guest")]
    following = F.lead(F.struct(*add)).over(Window.partitionBy("range").orderBy(*order))
    return made.withColumn("next", following).filter(~F.col("guest")).select(*add, "next")


def edited(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_text, entries, edited_entries and next_entries of each document.

    The edited text: the last half of a text's code points, rounded down, gives way to the first as many of the next one.
    """
    t = gram + window - 1
    rows = with_next(docs, lambda d: d.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("entries", winnow(F.col("text"), gram, window)), range_bytes)
    half = F.floor(F.col("n_chars") / 2)
    rows = rows.withColumn("kept", F.col("n_chars") - half).withColumn("taken", F.least(half, F.col("next.n_chars")))
    rows = rows.withColumn("head", F.left("text", F.col("kept").cast("int"))).withColumn("tail", F.left("next.text", F.col("taken").cast("int")))
    seam = F.concat(F.right("head", F.lit(t - 1)), F.left("tail", F.lit(t - 1)))
    both = spliced(F.col("entries"), F.col("n_chars"), F.col("kept"), F.col("next.entries"), F.col("next.n_chars"), F.col("taken"), seam, gram, window)
    return rows.select("doc_id", "n_chars", F.concat("head", "tail").alias("edited_text"), "entries", both.alias("edited_entries"), F.col("next.entries").alias("next_entries"))


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = lambda other: likeness(F.col("entries"), F.col(other))
    return edited(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), shown(F.col("entries")).alias("fingerprint"), shown(F.col("edited_entries")).alias("edited_fingerprint"),
        near("edited_entries").alias("near_edited"), near("next_entries").alias("near_next"),
    )
