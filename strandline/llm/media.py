"""Chroma audio fingerprints and their alignment.

Frames of a recording are reduced to twelve pitch classes; filters over that image, taken from an integral image, give two bits
each, and sixteen of them one packed 32-bit integer per frame. Two recordings align where many of their integers
are equal at one offset; the share of differing bits there says how alike they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Fixed values of this design: each filter's kind, first pitch class, height and width in frames, and the two thresholds between its four levels.
#: Kinds: 0 whole area, 1 lower minus upper half, 2 left minus right half, 3 diagonal quarters, 4 middle minus outer thirds of the rows, 5 middle minus outer thirds of the columns.
FILTERS = tuple((kind, low, high, width) for kind, low, high, width in (
    (1, 0, 12, 4), (1, 0, 6, 4), (1, 6, 6, 4), (1, 3, 6, 4),
    (2, 0, 4, 8), (2, 4, 4, 8), (2, 8, 4, 8), (2, 0, 12, 4),
    (3, 0, 6, 8), (3, 6, 6, 8), (3, 3, 6, 8), (3, 0, 12, 8),
    (4, 0, 9, 4), (4, 3, 9, 4), (5, 0, 6, 9), (5, 6, 6, 9),
))
LEVELS = (-0.15, 0.0, 0.15)
GRAY = np.array([0, 1, 3, 2], np.uint32)
WIDEST = max(w for *_, w in FILTERS)
#: Cells to a unit of a filter's value, a power of two, in which fit_levels counts.
GRID = 1 << 12


def chroma(signal: np.ndarray, rate: int, window: int, hop: int) -> np.ndarray:
    """Frames x 12: spectral energy by pitch class (A = 0) between 55 Hz and half the rate, each frame of unit length. Shorter signals than a window have no frame."""
    if len(signal) < window:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(signal.astype(float), window)[::hop] * np.hanning(window)
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
    hertz = np.fft.rfftfreq(window, 1 / rate)
    heard = hertz >= 55
    pitch = np.round(12 * np.log2(hertz[heard] / 55)).astype(int) % 12
    out = np.zeros((len(frames), 12))
    loud = power[:, heard]
    for p in range(12):
        out[:, p] = loud[:, pitch == p].sum(1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(length > 1e-9, out / np.maximum(length, 1e-9), 0.0)


def filter_values(image: np.ndarray) -> np.ndarray:
    """Each filter's value at each frame that the widest one fits at: filters x frames."""
    count = len(image) - WIDEST + 1
    if count <= 0:
        return np.zeros((len(FILTERS), 0))
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    whole = np.ascontiguousarray(whole.T)

    def area(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return whole[p1, t1 : t1 + count] - whole[p1, t0 : t0 + count] - whole[p0, t1 : t1 + count] + whole[p0, t0 : t0 + count]

    out = np.zeros((len(FILTERS), count))
    for row, (kind, low, high, width) in zip(out, FILTERS, strict=True):
        mid_t, mid_p, third_t, third_p, top = width // 2, low + high // 2, width // 3, high // 3, low + high
        if kind == 0:
            a, b = area(0, width, low, top), np.zeros(count)
        elif kind == 1:
            a, b = area(0, width, low, mid_p), area(0, width, mid_p, top)
        elif kind == 2:
            a, b = area(0, mid_t, low, top), area(mid_t, width, low, top)
        elif kind == 3:
            a = area(0, mid_t, low, mid_p) + area(mid_t, width, mid_p, top)
            b = area(0, mid_t, mid_p, top) + area(mid_t, width, low, mid_p)
        elif kind == 4:
            a = area(0, width, low + third_p, low + 2 * third_p)
            b = area(0, width, low, low + third_p) + area(0, width, low + 2 * third_p, top)
        else:
            a = area(third_t, 2 * third_t, low, top)
            b = area(0, third_t, low, top) + area(2 * third_t, width, low, top)
        row[:] = np.log((1 + a) / (1 + b))
    return out


def packed(image: np.ndarray, levels: np.ndarray | None = None) -> np.ndarray:
    """One unsigned 32-bit integer for each frame that the widest filter fits at: two bits of each filter, by its own three levels or LEVELS."""
    values = filter_values(image)
    out = np.zeros(values.shape[1], np.uint32)
    for value, cuts in zip(values, np.tile(LEVELS, (len(FILTERS), 1)) if levels is None else levels, strict=True):
        out = (out << np.uint32(2)) | GRAY[np.digitize(value, cuts)]
    return out


def fit_levels(recordings: DataFrame, rate: int = 2000, window: int = 512, hop: int = 128, pcm: str = "pcm", id_col: str = "recording_id") -> np.ndarray:
    """Filters x 3: the quartiles of each filter's values over all frames of all recordings, so that its two bits split frames evenly and unlike recordings differ in half of all bits.

    Values are counted in cells of 1 / GRID; a level is the lower edge of its quartile's cell, so the values on both sides of it are counted exactly.
    A task sends a count for each cell it met and the driver gets one row per filter, both bounded by the grid. Repeated recordings
    count each time; those with null ids, which are alike with nothing, don't. Without frames there are the fixed LEVELS.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # frames are of unit length, so no value is beyond log(1 + WIDEST * sqrt(12)) < 4
        counts, row = np.zeros((len(FILTERS), 8 * GRID), np.int64), np.arange(len(FILTERS))[:, None]
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py() or b""
                values = filter_values(chroma(np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate, window, hop))
                np.add.at(counts, (row, np.floor(values * GRID).astype(np.int64) + 4 * GRID), 1)
        of, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(cell - 4 * GRID), pa.array(counts[of, cell])], names=["filter", "cell", "n"])

    cells = recordings.where(F.col(id_col).isNotNull()).select(pcm).mapInArrow(run, "filter bigint, cell bigint, n bigint").groupBy("filter", "cell").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("filter")
    seen = cells.select("filter", "cell", F.sum("n").over(own.orderBy("cell")).alias("upto"), F.sum("n").over(own).alias("whole"))
    cuts = seen.groupBy("filter").agg(*[F.min(F.when(4 * F.col("upto") >= k * F.col("whole"), F.col("cell"))).alias(f"q{k}") for k in (1, 2, 3)])
    found = sorted(tuple(r) for r in cuts.collect())
    return np.array([r[1:] for r in found]) / GRID if found else np.tile(LEVELS, (len(FILTERS), 1))


def fingerprint(recordings: DataFrame, rate: int = 2000, window: int = 512, hop: int = 128, pcm: str = "pcm", id_col: str = "recording_id", skip: int = 0, levels: np.ndarray | None = None) -> DataFrame:
    """(recording_id, frames, fingerprint): packed integers as array<bigint>. pcm is binary, 16-bit little-endian mono; its first `skip` samples are left out. levels: see fit_levels; prints are comparable if they share them.

    A null, empty or short recording has an empty fingerprint; an odd last byte is ignored; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = []
            for data in batch.column(1).to_pylist():
                data = data or b""
                prints.append(packed(chroma(np.frombuffer(data[: len(data) // 2 * 2], "<i2")[skip:], rate, window, hop), levels).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) for p in prints], pa.int64()), pa.array(prints, pa.list_(pa.int64()))], names=[id_col, "frames", "fingerprint"])

    kind = recordings.schema[id_col].dataType.simpleString()
    return recordings.select(id_col, pcm).mapInArrow(run, f"`{id_col}` {kind}, frames bigint, fingerprint array<bigint>")


def _voters(flat: np.ndarray, offsets: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, recording and frame of each integer that votes: the first of a run, with another one `gap` frames later if gap > 0."""
    flat, sizes = flat.astype(np.uint64), np.diff(offsets)
    of = np.repeat(np.arange(len(sizes)), sizes)
    t = np.arange(len(flat)) - offsets[:-1][of]
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (t[1:] == 0)
    at = np.flatnonzero(first & (t + gap < sizes[of]))
    # two unsigned 32-bit integers as one key
    return (flat[at] << np.uint64(32)) ^ flat[at + gap] if gap else flat[at], of[at], t[at]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def best_offsets(base: tuple[np.ndarray, np.ndarray], asking: list[tuple[np.ndarray, np.ndarray]], own: np.ndarray, least_votes: int, most_errors: float, least_overlap: int, gap: int, least_share: float = 0.0, most: int = 1 << 21) -> tuple[np.ndarray, ...]:
    """Query, match, half, offset, votes, overlap and bit error of the pairs of a tile that are kept.

    base and each phase of asking are all integers and the offset of each recording (one more than there are recordings); own is
    a query's place in base or negative. About `most` votes are held at a time.
    """
    n, span = len(base[1]) - 1, int(max(np.diff(o).max(initial=0) for _, o in (base, *asking))) + 1
    key, of, at = _voters(*base, gap)
    order = np.argsort(key, kind="stable")
    key, of, at = key[order], of[order], at[order]
    phases = [_voters(flat, offsets, gap) for flat, offsets in asking]
    q_key, q_of, q_at = (np.concatenate(x) for x in zip(*phases))
    half = np.repeat(np.arange(len(phases)), [len(p[0]) for p in phases])
    order = np.argsort(q_of, kind="stable")
    q_key, q_of, q_at, half = q_key[order], q_of[order], q_at[order], half[order]
    start = np.searchsorted(key, q_key, "left")
    count = np.searchsorted(key, q_key, "right") - start
    ends, total = np.searchsorted(q_of, np.arange(len(own)), "right"), np.concatenate([[0], np.cumsum(count)])
    found, k, begin = [], 0, 0
    while k < len(own):
        # whole queries, as many as make about `most` votes
        stop = max(k + 1, int(np.searchsorted(total[ends], total[begin] + most, "right")))
        part = slice(begin, ends[stop - 1])
        k, begin = stop, ends[stop - 1]
        hit = _spread(start[part], count[part])
        asks, phase, frame = (np.repeat(x[part], count[part]) for x in (q_of, half, q_at))
        other = own[asks] != of[hit]
        pair = (asks * n + of[hit]) * 2 + phase
        vote = np.sort((pair * (2 * span) + at[hit] - frame + span)[other])
        edge = np.flatnonzero(np.diff(vote, prepend=-1))
        votes = np.diff(edge, append=len(vote))
        vote, votes = vote[edge][votes >= least_votes], votes[votes >= least_votes]
        offset, phase, pair = vote % (2 * span) - span, vote // (2 * span) % 2, vote // (4 * span)
        order = np.lexsort((phase, offset, np.abs(offset), -votes, pair))
        order = order[np.flatnonzero(np.diff(pair[order], prepend=-1))]
        q, m, phase, offset, votes = pair[order] // n, pair[order] % n, phase[order], offset[order], votes[order]
        q_from, m_from = np.maximum(0, -offset), np.maximum(0, offset)
        q_size = np.choose(phase, [np.diff(o)[q] for _, o in asking])
        m_size = np.diff(base[1])[m]
        overlap = np.minimum(q_size - q_from, m_size - m_from)
        keep = (overlap >= max(least_overlap, 1)) & (overlap >= least_share * np.minimum(q_size, m_size))
        q, m, phase, offset, votes, overlap, q_from, m_from = (x[keep] for x in (q, m, phase, offset, votes, overlap, q_from, m_from))
        error = np.zeros(len(q))
        for p, (flat, offsets) in enumerate(asking):
            own_phase = np.flatnonzero(phase == p)
            for i in range(0, len(own_phase), 1 << 13):
                x = own_phase[i : i + (1 << 13)]
                a = flat[_spread(offsets[:-1][q[x]] + q_from[x], overlap[x])]
                b = base[0][_spread(base[1][:-1][m[x]] + m_from[x], overlap[x])]
                bits = np.bitwise_count(a ^ b).astype(np.int64)
                error[x] = np.add.reduceat(bits, np.cumsum(overlap[x]) - overlap[x]) / (32 * overlap[x])
        found.append([x[error <= most_errors] for x in (q, m, phase, offset, votes, overlap, error)])
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 6 + (np.zeros(0),)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of a column of lists, and the offset of each row; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return pc.list_flatten(column).to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def align(prints: DataFrame, is_query: str, least_votes: int = 3, most_errors: float = 0.25, least_overlap: int = 16, gap: int = 0, id_col: str = "recording_id", shifted: DataFrame | None = None, tile_frames: int = 400_000, least_share: float = 0.0) -> DataFrame:
    """(query_id, match_class, match_id, offset, votes, overlap, bit_error) between queries and the classes of equal fingerprints.

    With gap > 0 an integer votes together with that of `gap` frames later: both must be equal. That keeps chance votes, which
    grow with queries times recordings, rare in large tables; a match then needs unchanged stretches of gap + 1 frames.
    A class of recordings with equal fingerprints is compared once, as its smallest id; match_id is that. For each pair with
    an equal integer the offset with the most votes wins (ties: the smaller absolute offset, then the smaller); the pair is kept if it has
    least_votes there, the two overlap in least_overlap frames and in least_share of the shorter one, and at most most_errors of the bits differ. Runs of one
    integer vote once, by their first frame. Empty fingerprints and null ids take no part.

    shifted: fingerprints of the queries taken half a hop later. They vote too, as recordings whose starts differ by half a hop
    have few equal integers; a column half says whether the row's offset is between these (1: the true offset is half a hop less).

    Queries and classes are dealt into blocks of about tile_frames frames; each pair of blocks is a task that counts its votes
    and tests its best offsets, so votes are never shuffled.
    """
    known = prints.where(f"`{id_col}` IS NOT NULL AND size(fingerprint) > 0").select(F.col(id_col).alias("id"), "fingerprint", F.sha2(F.array_join("fingerprint", ",").cast("binary"), 256).alias("class"))
    classes = stage(known.groupBy("class").agg(F.min("id").alias("match_id")), "classes")
    whole = stage(known.join(classes.withColumnRenamed("class", "c"), (F.col("id") == F.col("match_id")) & (F.col("class") == F.col("c"))).select("match_id", "fingerprint").distinct(), "class-prints")
    asked = known.where(is_query.replace(id_col, "id"))
    if shifted is not None:
        later = shifted.where(f"`{id_col}` IS NOT NULL").select(F.col(id_col).alias("s_id"), F.col("fingerprint").alias("later"))
        asked = asked.join(later, F.col("id") == F.col("s_id"), "left").drop("s_id")
    else:
        asked = asked.withColumn("later", F.lit(None).cast("array<bigint>"))
    # queries with both prints equal ask once, as their smallest id
    both_prints = F.sha2(F.concat_ws(";", "class", F.array_join("later", ",")).cast("binary"), 256)
    asked = stage(asked.withColumn("ask", both_prints).dropDuplicates(["id", "ask"]), "asked")
    firsts = stage(asked.groupBy("ask").agg(F.min("id").alias("q")), "asks")
    own_class = classes.select(F.col("class").alias("c"), F.col("match_id").alias("own"))
    asking = asked.join(firsts.withColumnRenamed("ask", "a"), (F.col("ask") == F.col("a")) & (F.col("id") == F.col("q"))).join(own_class, F.col("class") == F.col("c")).select("ask", "q", "own", F.col("fingerprint").alias("qf"), "later")
    asking = stage(asking, "asking")

    def blocks(df: DataFrame, c: str) -> int:
        return -(-(df.agg(F.sum(F.size(c))).first()[0] or 0) // tile_frames) or 1

    n_base, n_asking = blocks(whole, "fingerprint"), blocks(asking, "qf")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = whole.select(F.pmod(F.xxhash64("match_id"), F.lit(n_base)).cast("int").alias("b"), each(n_asking).alias("a"), "match_id", "fingerprint")
    right = asking.select(each(n_base).alias("b"), F.pmod(F.xxhash64("ask"), F.lit(n_asking)).cast("int").alias("a"), "ask", "own", "qf", "later")
    names = ["ask", "match_id", "half", "offset", "votes", "overlap", "bit_error"]

    def tile(base: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asks = base.column("match_id"), queries.column("ask")
        own = pc.fill_null(pc.index_in(queries.column("own"), value_set=ids.combine_chunks()), -1).to_numpy()
        q, m, *rest = best_offsets(_flat(base.column("fingerprint")), [_flat(queries.column(c)) for c in ("qf", "later")], own.astype(np.int64), least_votes, most_errors, least_overlap, gap, least_share)
        return pa.table([asks.take(pa.array(q)), ids.take(pa.array(m)), *(pa.array(x) for x in rest)], names=names)

    kind = whole.schema["match_id"].dataType.simpleString()
    schema = f"ask string, match_id {kind}, half bigint, offset bigint, votes bigint, overlap bigint, bit_error double"
    kept = left.groupBy("b", "a").cogroup(right.groupBy("b", "a")).applyInArrow(tile, schema)
    size, zero = F.size("qf").cast("bigint"), F.lit(0).cast("bigint")
    own = asking.select("ask", F.col("own").alias("match_id"), zero.alias("half"), zero.alias("offset"), size.alias("votes"), size.alias("overlap"), F.lit(0.0).alias("bit_error"))
    query = asked.select(F.col("id").alias("query_id"), "ask")
    half = ["half"] if shifted is not None else []
    return query.join(kept.unionByName(own), "ask").select("query_id", "match_id", "offset", *half, "votes", "overlap", F.round("bit_error", 6).alias("bit_error"))


def find_alike(recordings: DataFrame, asked: DataFrame, is_query: str, hop: int = 128, least_share: float = 0.5) -> DataFrame:
    """align of all recordings with those of `asked` (the recordings that is_query names), at whole hops and half a hop later.

    Two recordings are alike if they agree over half of the shorter one at least: melodies that share no more than their ends
    do so by chance. The filters' levels are fitted to all recordings. Null, empty and short recordings are alike with nothing, repeated ones are one class.
    """
    levels = fit_levels(recordings, hop=hop)
    prints = stage(fingerprint(recordings, hop=hop, levels=levels), "fingerprints")
    return align(prints, is_query, shifted=fingerprint(asked, hop=hop, skip=hop // 2, levels=levels), least_share=least_share)


def covers(vectors: DataFrame, group: int = 4, own: int = 16, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id, vector): rows of `group` neighbouring ids as versions of one melody, for tables in which no vectors are alike.

    A row takes the components of its group's first vector (the smallest id with one, then the least vector), but for one in `own`, chosen by a
    hash of its id and the place, which stay its own. Null vectors and rows with null ids stay as they are; other columns are left out.
    """
    rows = vectors.select(id_col, vector)
    first = rows.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).groupBy(F.expr(f"`{id_col}` div {group}").alias("_g")).agg(F.min(F.struct(id_col, vector)).alias("_first"))
    both = rows.join(first, F.expr(f"`{id_col}` div {group}") == F.col("_g"), "left")
    base = F.col("_first").getField(vector)
    mixed = F.transform(vector, lambda x, k: F.when(F.pmod(F.xxhash64(id_col, k), F.lit(own)) == 0, x).otherwise(F.coalesce(F.get(base, k), x)))
    return both.select(id_col, mixed.alias(vector))


def sonify(vectors: DataFrame, rate: int = 2000, seconds: float = 0.096, notes: int = 36, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(recording_id, pcm): a melody per vector, for tables without sound. Component k sets the pitch of note k; a hash of the vector gives a few notes before, so like vectors start at different times and equal ones are equal.

    Null components count as 0; a null vector has null pcm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = int(rate * seconds)
        t = np.arange(size) / rate
        fade = np.minimum(1, np.minimum(np.arange(size), np.arange(size)[::-1]) / 12)
        bank = np.stack([fade * (np.sin(2 * np.pi * 110 * 2 ** (p / 12) * t) + 0.4 * np.sin(2 * np.pi * 220 * 2 ** (p / 12) * t)) for p in range(notes)]) * 9000
        for batch in batches:
            sounds = []
            for v in batch.column(1).to_pylist():
                if v is None:
                    sounds.append(None)
                    continue
                x = np.nan_to_num(np.array([0.0 if c is None else c for c in v], float), posinf=0, neginf=0)
                pitch = np.clip(np.floor((np.clip(x, -0.35, 0.35) + 0.35) / 0.7 * notes), 0, notes - 1).astype(int)
                digest = hashlib.md5(x.tobytes()).digest()
                lead = [b % notes for b in digest[1 : 1 + digest[0] % 5]]
                sounds.append(bank[[*lead, *pitch.tolist()]].ravel().astype("<i2").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sounds, pa.binary())], names=["recording_id", "pcm"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector).mapInArrow(run, f"recording_id {kind}, pcm binary")
