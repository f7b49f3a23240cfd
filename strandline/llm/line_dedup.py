"""Line dedup by content-defined chunks of lines, on DataFrame functions only.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends, so inserted or removed lines
shift no other boundary; a long line is always a chunk of its own. Chunks met again anywhere are removed
but for their first place, after their bytes were compared with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint")


def words(line: Column) -> Column:
    """Spaces and one more; an empty line has none."""
    return F.when(F.length(line) == 0, 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _marked(rows: DataFrame, text: str, long_words: int) -> DataFrame:
    """Adds `_lines`, their `_hashes` and whether each is `_long`."""
    lines = rows.withColumn("_lines", F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))
    return lines.withColumn("_hashes", F.transform("_lines", line_hash)).withColumn("_long", F.transform("_lines", lambda x: words(x) >= long_words))


def _ends(i: Column, every: int) -> Column:
    """Whether a boundary follows line i of `_marked`."""
    before = F.when(i > 0, F.get("_hashes", i - 1)).otherwise(F.lit(0))
    rolled = (before * 31 + F.get("_hashes", i)) % every
    return (i == F.size("_long") - 1) | F.get("_long", i) | F.get("_long", i + 1) | (rolled == 0)


def with_chunks(rows: DataFrame, text: str, every: int, long_words: int) -> DataFrame:
    """Adds `_chunks`: an array of (pos, n_lines, n_words, chunk), each the lines up to the next boundary; joined by newlines they are the text.

    A boundary follows a line if the rolling hash of it and the line before is divisible by `every`, and stands on both
    sides of a line of long_words words or more.
    """
    marks = _marked(rows, text, long_words)
    cuts = marks.withColumn("_cuts", F.filter(F.sequence(F.lit(0), F.size("_hashes") - 1), lambda i: _ends(i, every)))

    def chunk(end: Column, k: Column) -> Column:
        start = F.when(k > 0, F.get("_cuts", k - 1) + 1).otherwise(F.lit(0))
        own = F.slice("_lines", start + 1, end - start + 1)
        n_words = F.aggregate(own, F.lit(0), lambda a, x: a + words(x))
        return F.struct(k.cast("int").alias("pos"), (end - start + 1).alias("n_lines"), n_words.alias("n_words"), F.array_join(own, "\n").alias("chunk"))

    return cuts.withColumn("_chunks", F.transform("_cuts", chunk)).drop("_lines", "_hashes", "_long", "_cuts")


def _met_before(each: DataFrame, name: str) -> DataFrame:
    """The rows of each (_id, _key, pos, chunk and more) whose chunk occurs before, with an equal text: in a row of smaller id or earlier in the same row."""
    counts = each.withColumn("h1", F.xxhash64("chunk")).withColumn("h2", F.xxhash64(F.lit(0x51ED27), F.col("chunk")))
    again = counts.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("_id").alias("first_id")).where("n > 1").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first_id")
    return _copies_of_first(stage(counts.join(again, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).select(*counts.columns, "first_id"), name))


def _copies_of_first(repeated: DataFrame) -> DataFrame:
    """Rows (_id, _key, pos, chunk, h1, h2, first_id and more) that have the text of the first place of their hashes and aren't that place."""
    place = F.min(F.struct("pos", "_key", "chunk")).alias("first")
    firsts = repeated.where(F.col("_id") == F.col("first_id")).groupBy(F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(place)
    at_first = (F.col("_id") == F.col("first_id")) & (F.col("pos") == F.col("first.pos")) & (F.col("_key") == F.col("first._key"))
    return repeated.join(firsts, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where((F.col("chunk").cast("binary") == F.col("first.chunk").cast("binary")) & ~F.coalesce(at_first, F.lit(False)))


def _of_rows(rows: DataFrame, found: DataFrame, most: int, others: bool) -> DataFrame:
    """rows (_id, _key and more) with the columns of found (p_id, p_key and more, unique); with `others` also the rest, with NULLs.

    If found has at most `most` rows its keys are broadcast, and only the rows that have one are shuffled; else all are.
    """
    at = F.col("_id").eqNullSafe(F.col("p_id")) & (F.col("_key") == F.col("p_key"))
    more = [c for c in found.columns if c not in ("p_id", "p_key")]
    if found.count() > most:
        return rows.join(found, at, "left" if others else "inner").select(*rows.columns, *more)
    keys = F.broadcast(found.select("p_id", "p_key"))
    own = rows.join(keys, at, "left_semi").join(found, at).select(*rows.columns, *more)
    if not others:
        return own
    return own.unionByName(rows.join(keys, at, "left_anti").select(*rows.columns, *(F.lit(None).cast(found.schema[c].dataType).alias(c) for c in more)))


def dedup_passages(docs: DataFrame, every: int = 2, long_words: int = 16, least_lines: int = 2, least_words: int = 12, text: str = "text", id_col: str = "doc_id", most: int = 4_000_000) -> DataFrame:
    """(row, text, n_lines, n_removed): as dedup_lines, but what is counted are all pairs of neighbouring lines, and chunks of one line.

    Pairs overlap and depend on no neighbour, so a repeated passage goes up to its first and last line wherever it stands; whatever
    dedup_lines removes goes too, as the pairs of a chunk that is met again are. Runs of such lines that follow one another are
    removed under the same limits. The first place of each line stays. n_lines and n_removed count lines. Where at most `most` rows
    have repeated lines (about 40 bytes each are broadcast), texts without any are not shuffled.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_key"))
    plain = rows.select("_id", "_key", F.col(f"row.`{text}`").alias("_text"))
    marks = _marked(plain, "_text", long_words)
    at = F.sequence(F.lit(0), F.size("_lines") - 1)

    def item(i: Column, n: int) -> Column:
        chunk = F.array_join(F.slice("_lines", i + 1, n), "\n")
        return F.struct(i.alias("pos"), F.lit(n).alias("n"), F.xxhash64(chunk).alias("h1"), F.xxhash64(F.lit(0x51ED27), chunk).alias("h2"))

    pairs = F.transform(F.filter(at, lambda i: i < F.size("_lines") - 1), lambda i: item(i, 2))
    alone = F.transform(F.filter(at, lambda i: _ends(i, every) & ((i == 0) | _ends(i - 1, every))), lambda i: item(i, 1))
    each = marks.select("_id", "_key", F.explode_outer(F.concat(pairs, alone)).alias("c")).select("_id", "_key", "c.*")
    # hashes alone say what is met again; then the texts of those places are fetched from their rows, and compared
    again = each.groupBy("h1", "h2").agg(F.count("*").alias("_n"), F.min("_id").alias("first_id")).where("_n > 1").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "first_id")
    same = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))
    places = each.join(again, same).groupBy(F.col("_id").alias("p_id"), F.col("_key").alias("p_key")).agg(F.collect_set(F.struct("pos", "n", "h1", "h2", "first_id")).alias("_places"))
    found = _of_rows(plain, stage(places, "repeated-places"), most, False).withColumn("_lines", F.split(F.coalesce("_text", F.lit("")), "\n", -1))
    found = found.select("_id", "_key", "_lines", F.explode_outer("_places").alias("c"))
    own = F.slice("_lines", F.col("c.pos") + 1, F.col("c.n"))
    repeated = stage(found.select("_id", "_key", "c.pos", "c.h1", "c.h2", "c.first_id", F.transform(own, words).alias("sizes"), F.array_join(own, "\n").alias("chunk")), "repeated-lines")
    gone = _copies_of_first(repeated)
    # several items cover a line; equal rows count a place once
    lines = gone.select("_id", "_key", "pos", F.posexplode("sizes").alias("k", "n_words")).select("_id", "_key", (F.col("pos") + F.col("k")).alias("pos"), "n_words").distinct()
    run = F.col("pos") - F.row_number().over(Window.partitionBy("_id", "_key").orderBy("pos"))
    whole_run = Window.partitionBy("_id", "_key", "_run")
    sized = lines.withColumn("_run", run).withColumn("_l", F.count("*").over(whole_run)).withColumn("_w", F.sum("n_words").over(whole_run))
    enough = ((F.col("_l") >= least_lines) & (F.col("_w") >= least_words)) | (F.col("_w") >= long_words)
    by_row = sized.where(enough).groupBy(F.col("_id").alias("p_id"), F.col("_key").alias("p_key")).agg(F.collect_set("pos").alias("gone"))
    joined = _of_rows(rows, stage(by_row, "removed-lines"), most, True)
    before = F.col(f"row.`{text}`")
    split = F.split(before, "\n", -1)
    kept = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    done = F.struct(F.when(F.col("gone").isNull(), before).otherwise(kept).alias("text"), F.coalesce(F.size(split), F.lit(0)).cast("bigint").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))
    # a generator, as in dedup_lines
    return joined.select("row", F.explode_outer(F.array(done)).alias("_done")).select("row", "_done.*")


def dedup_lines(docs: DataFrame, every: int = 2, long_words: int = 16, least_lines: int = 2, least_words: int = 12, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(row, text, n_chunks, n_removed): row is a struct of all columns of docs as they were, text what is left.

    A chunk is met again if it occurs before, in a row of smaller id or earlier in the same row. Of such chunks, runs that
    follow one another are removed if together they have least_lines lines and least_words words, or long_words words;
    single short lines stay. The first place always stays. A null text stays null, an empty one empty; if every chunk
    goes the text is empty. Null ids come last and give no first place; rows that repeat id and text share their decision.

    Chunks are counted by two 64-bit hashes without their text; only repeated ones are shuffled with it. A chunk that a third
    of all rows has is one combined row in the count, and a key that adaptive execution splits in the joins.
    """
    # the row key tells rows apart that share an id
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text)).alias("_key"))
    whole = F.col(f"row.`{text}`").alias("_text")
    chunked = with_chunks(rows.select("_id", "_key", whole), "_text", every, long_words)
    # the arrays are never empty; an inner explode would have their size computed in a pushed filter, once per line
    each = chunked.select("_id", "_key", F.explode_outer("_chunks").alias("c")).select("_id", "_key", "c.*")
    gone = _met_before(each, "repeated-chunks")
    # runs of consecutive chunks; equal rows count a place once
    places = gone.select("_id", "_key", "pos", "n_lines", "n_words").distinct()
    run = F.col("pos") - F.row_number().over(Window.partitionBy("_id", "_key").orderBy("pos"))
    whole_run = Window.partitionBy("_id", "_key", "_run")
    sized = places.withColumn("_run", run).withColumn("_l", F.sum("n_lines").over(whole_run)).withColumn("_w", F.sum("n_words").over(whole_run))
    enough = ((F.col("_l") >= least_lines) & (F.col("_w") >= least_words)) | (F.col("_w") >= long_words)
    by_row = sized.where(enough).groupBy(F.col("_id").alias("g_id"), F.col("_key").alias("g_key")).agg(F.collect_set("pos").alias("gone"))
    joined = rows.join(by_row, F.col("_id").eqNullSafe(F.col("g_id")) & (F.col("_key") == F.col("g_key")), "left")
    back = with_chunks(joined.select("row", "gone", whole), "_text", every, long_words)
    kept = F.array_join(F.transform(F.filter("_chunks", lambda c: ~F.array_contains("gone", c["pos"])), lambda c: c["chunk"]), "\n")
    text_left = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(kept)
    n_chunks = F.when(F.col("_text").isNull(), 0).otherwise(F.size("_chunks")).cast("bigint")
    done = F.struct(text_left.alias("text"), n_chunks.alias("n_chunks"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"))
    # a generator, so that filters on the result aren't pushed down with the chunking copied into them
    return back.select("row", F.explode_outer(F.array(done)).alias("_done")).select("row", "_done.*")
