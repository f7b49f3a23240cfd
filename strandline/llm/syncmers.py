"""Fingerprints of texts by closed syncmers, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A k-mer has K bytes; its inner substrings have S, so that WINDOW of them lie in one. Every WINDOW k-mers in a row hold an anchor.
K, S = 24, 9
WINDOW = K - S + 1
#: Texts are searched in blocks of about so many bytes. Blocks overlap by K - 1 bytes, so the cuts change nothing.
BLOCK = 1 << 16
_BITS = 1 << 24


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once and not again for each element of an array inside."""
    return F.get(F.transform(F.array(value), use), 0)


def _block_anchors(block: Column, before: Column) -> Column:
    """Anchors of one block of bytes; `before` bytes of the text precede it."""
    n = F.octet_length(block) - K + 1

    def minima(hashes: Column, reach: int = 1) -> Column:
        """The smallest of the WINDOW hashes from each place on, WINDOW being a power of two."""
        if reach == WINDOW:
            return hashes
        return _let(F.transform(hashes, lambda x, i: F.least(x, F.get(hashes, i + reach))), lambda wider: minima(wider, 2 * reach))

    def anchors(hashes: Column) -> Column:
        def at_an_edge(least: Column, i: Column) -> Column:
            return F.when((i < n) & ((least == F.get(hashes, i)) | (least == F.get(hashes, i + (WINDOW - 1)))), i)

        found = F.filter(F.transform(minima(hashes), at_an_edge), lambda i: i.isNotNull())
        return F.transform(found, lambda i: (before + i).cast("bigint") * _BITS + F.shiftright(F.crc32(F.substring(block, i + 1, F.lit(K))), 8))

    hashes = F.transform(F.sequence(F.lit(1), n + WINDOW - 1), lambda i: F.crc32(F.substring(block, i, F.lit(S))))
    return F.when(n > 0, _let(hashes, anchors)).otherwise(F.array().cast("array<bigint>"))


def anchors(text: Column) -> Column:
    """The closed syncmers of a text's UTF-8 bytes in order, each as position * 2^24 + the upper 24 bits of the k-mer's crc32.

    A k-mer is one if the smallest crc32 of its inner substrings is met at its first or its last; whether it is one depends on
    its own bytes alone. Null and texts shorter than a k-mer have none.
    """
    data = F.coalesce(text, F.lit("")).cast("binary")

    def blocks(whole: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.octet_length(whole) - K, F.lit(0)), F.lit(BLOCK))
        return F.flatten(F.transform(starts, lambda s: _let(F.substring(whole, s + 1, F.lit(BLOCK + K - 1)), lambda b: _block_anchors(b, s))))

    return _let(data, blocks)


def _position(anchor: Column) -> Column:
    return F.shiftright(anchor, 24)


def joined_anchors(head: Column, head_anchors: Column, tail: Column, tail_anchors: Column) -> Column:
    """The anchors of head || tail, where head_anchors and tail_anchors are those of any texts that begin with head and tail.

    As an anchor depends on its own bytes alone, only the K - 1 bytes on both sides of the seam are searched again.
    """
    cut, more = F.octet_length(head), F.octet_length(tail)
    left = F.least(cut, F.lit(K - 1))
    seam = F.concat(F.substring(head.cast("binary"), cut - left + 1, left), F.substring(tail.cast("binary"), F.lit(1), F.lit(K - 1)))
    own = F.filter(head_anchors, lambda x: _position(x) + K <= cut)
    over = _let(seam, lambda b: _block_anchors(b, cut - left))
    moved = F.filter(tail_anchors, lambda x: _position(x) + K <= more)
    return F.concat(own, over, F.transform(moved, lambda x: x + cut.cast("bigint") * _BITS))


def links(found: Column, text: Column) -> Column:
    """What fingerprints are compared by: each anchor with its distance to the next (0 for the last), hash * 2^8 + distance.

    Distances between neighbours stay when a passage moves, so equal links are anchors at matching positions. A text without
    anchors has one link, made of its whole bytes.
    """
    whole = F.shiftright(F.crc32(F.coalesce(text, F.lit("")).cast("binary")), 8) * 256

    def each(x: Column, i: Column) -> Column:
        distance = F.coalesce(_position(F.get(found, i + 1)) - _position(x), F.lit(0))
        return (x % _BITS) * 256 + F.least(distance, F.lit(255))

    return F.when(F.size(found) > 0, F.transform(found, each)).otherwise(F.array(whole))


def fingerprint(of: Column) -> Column:
    """Links as text, eight hex digits each."""
    return F.array_join(F.transform(of, lambda x: F.lpad(F.hex(x), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of distinct links that two texts have in common: twice the common ones by the sum of both, 0 to 1."""
    return F.size(F.array_intersect(a, b)) * 2 / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))


def with_next(rows: DataFrame, key: str, text: str, rows_per_range: int = 64, most_ranges: int = 1 << 16) -> DataFrame:
    """rows (key, text) in ranges of keys, `_range` descending with them, so that every row's successor by descending key is in its range.

    Range j begins with the j-th bound; the row at the bound closes the range before, as a `_guest`, and the row of the largest key
    closes the last. Bounds are keys of a hashed sample of at most about most_ranges rows, looked up in an array.
    """
    every = max(rows_per_range, -(-rows.count() // most_ranges))
    sampled = F.when(F.pmod(F.xxhash64("k"), F.lit(every)) == 0, F.col("k"))
    fitted = rows.select(F.col(key).alias("k")).agg(F.max("k").alias("top"), F.sort_array(F.collect_set(sampled), asc=False).alias("b")).first()
    bound = F.lit(np.array(fitted["b"], np.int64))
    steps = F.array(*[F.lit(1 << p) for p in reversed(range(most_ranges.bit_length() + 2))])

    def bounds_from(k: Column, b: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= F.size(b)) & (F.get(b, n + step - 1) >= k), n + step).otherwise(n))

    n = F.when(F.col(key).isNull(), F.size(bound)).otherwise(bounds_from(F.col(key), bound))
    placed = rows.withColumn("_n", n).withColumn("_last", F.size(bound)).withColumn("_first", F.col(key).eqNullSafe(F.lit(fitted["top"]))).withColumn("_at_bound", (F.col("_n") > 0) & (F.get(bound, F.col("_n") - 1) == F.col(key)))
    here = F.struct(F.col("_n").alias("range"), F.lit(False).alias("guest"))
    closes = F.when(F.col("_at_bound"), F.struct((F.col("_n") - 1).alias("range"), F.lit(True).alias("guest")))
    again = F.when(F.col("_first"), F.struct((F.col("_last")).alias("range"), F.lit(True).alias("guest")))
    places = F.filter(F.array(here, closes, again), lambda x: x.isNotNull())
    return placed.select(key, text, F.explode(places).alias("_p")).select(key, text, F.col("_p.range").alias("_range"), F.col("_p.guest").alias("_guest"))


def fingerprint_documents(docs: DataFrame, rows_per_range: int = 64) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the first floor(n_chars / 3) code points of the next document (by descending doc_id; the first, after the
    last) in place of its own last ones. Texts are shuffled once, by ranges of doc_id; anchors of the edited text come from those of
    the two texts and of the seam.

    Null texts are empty. An empty text has one link, as any other without anchors, so two of them are alike (1.0) and an empty and
    another text aren't (0.0). Repeated ids follow each other by descending text; null ids come last, and if all are null, each is followed by
    the next text. A table of one row is followed by itself. Other columns are ignored.
    """
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("_turn"), F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    placed = with_next(whole, "doc_id", "text", rows_per_range)
    # a guest stands behind all rows of its range, also where the largest key closes the range it is in
    by_range = placed.withColumn("_turn", F.col("_guest").cast("int"))
    w = Window.partitionBy("_range").orderBy(*order)
    # anchors are found behind the shuffle, which moves texts alone; the second window finds its rows dealt and sorted
    paired = by_range.withColumn("_next", F.lead("text").over(w)).withColumn("_anchors", anchors(F.col("text")))
    rows = paired.withColumn("_next_anchors", F.lead("_anchors").over(w)).where("NOT _guest")
    n = F.char_length("text")
    cut = rows.withColumn("n_chars", n.cast("bigint")).withColumn("_third", F.floor(n / 3).cast("int"))
    parts = cut.withColumn("_head", F.left("text", F.col("n_chars").cast("int") - F.col("_third"))).withColumn("_tail", F.left("_next", F.col("_third")))
    edited = parts.withColumn("_edited", F.concat("_head", "_tail")).withColumn("_edited_anchors", joined_anchors(F.col("_head"), F.col("_anchors"), F.col("_tail"), F.col("_next_anchors")))
    linked = edited.select("doc_id", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), links(F.col("_anchors"), F.col("text")).alias("a"), links(F.col("_edited_anchors"), F.col("_edited")).alias("e"), links(F.col("_next_anchors"), F.col("_next")).alias("x"))
    return linked.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("e")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("x")).alias("near_next"))
