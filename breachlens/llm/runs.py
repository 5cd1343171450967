"""Periodic runs of words: tiles per octave of the period, boundary Z-functions inside each, fragments stitched by document and period."""

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .common import as_bytes, byte_slices, mixed, text_groups, window_hashes, word_hashes

#: The shortest run that counts, in words.
LEAST = 12
#: Words of a tile besides its overlaps: at least this, and eight times the octave's shortest period.
CORE = 1024
#: Tiles of documents with more words are dealt over the tasks of the cluster.
SPREAD = 100_000
#: From this period on boundaries are ``period`` words apart and looked at only where windows of ``_GRAM`` words repeat.
_FAR, _GRAM = 32, 16

_TILED = "key binary, octave int, low long, first long, past long, tile array<int>"
_FOUND = "key binary, period long, begin long, end long"
_RUN = "array<struct<start: long, length: long, period: long>>"


def z_values(s: list) -> list[int]:
    """For each position, how many words from there on are those at the beginning."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def _prime_factors(n):
    found, d = [], 2
    while d * d <= n:
        if n % d == 0:
            found.append(d)
            while n % d == 0:
                n //= d
        d += 1
    return [*found, n] if n > 1 else found


def near_fragments(tile: np.ndarray, periods) -> list[tuple[int, int, int]]:
    """(period, begin, end) of the stretches with one of the short ``periods`` in a tile, at least twice the period long and with no smaller one.

    Here every word is a boundary; the Z-values of all of them for one period are the run lengths of equal words at that distance.
    """
    out, equal = [], {}

    def at(period):
        if period not in equal:
            equal[period] = np.concatenate([[0], np.cumsum(tile[:-period] == tile[period:])])
        return equal[period]

    for p in periods:
        if 2 * p > len(tile):
            break
        same = tile[:-p] == tile[p:]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        for begin, end in zip(turns[0::2].tolist(), turns[1::2].tolist(), strict=True):
            if end - begin >= p and not any(at(p // d)[begin + p - p // d] - at(p // d)[begin] == p - p // d for d in _prime_factors(p)):
                out.append((p, begin, end + p))
    return out


def far_fragments(tile: np.ndarray, shortest: int, anchors) -> list[tuple[int, int, int]]:
    """The same for periods from ``shortest`` up to twice that, from the Z-functions on both sides of each boundary in ``anchors``.

    Boundaries are ``shortest`` apart, so one of them stands in the first period of every run. What follows a boundary and what
    stands a period later agree for ``ahead`` words, what comes before both for ``back`` words; together they must be a period at least.
    Then one of the two is ``_GRAM`` words or more, so a boundary whose neighbouring windows do not repeat at such a distance is passed over.
    """
    grams = window_hashes(mixed(tile.astype(np.uint64)), _GRAM) if len(tile) >= _GRAM else np.empty(0, np.uint64)
    reach, out = np.arange(shortest, 2 * shortest), []
    for b in anchors:
        hit = False
        for at in (b, b - _GRAM):
            if not hit and 0 <= at < len(grams):
                hit = bool((grams[at + shortest : at + 2 * shortest] == grams[at]).any())
        if not hit:
            continue
        z = z_values(tile[b : b + 4 * shortest].tolist())
        low = max(0, b - 2 * shortest)
        pattern = tile[low:b][::-1].tolist()
        past = min(len(tile), b + 2 * shortest)
        back = z_values([*pattern, -1, *tile[low:past][::-1].tolist()])
        ahead = np.array([z[p] if p < len(z) else 0 for p in reach.tolist()])
        # The word before ``b + p`` is at this place of what was searched.
        places = len(pattern) + 1 + past - b - reach
        behind = np.array([back[x] if len(pattern) < x < len(back) else 0 for x in places.tolist()])
        for i in np.flatnonzero((ahead + behind >= reach) & (b + reach <= len(tile))).tolist():
            p = shortest + i
            if not any(z[p // d] >= p - p // d for d in _prime_factors(p)):
                out.append((p, b - int(behind[i]), b + p + int(ahead[i])))
    return _joined(out)


def _joined(fragments):
    """Fragments of one period that share at least a period of words are one."""
    out = []
    for p, begin, end in sorted(fragments):
        if out and out[-1][0] == p and begin <= out[-1][2] - p:
            out[-1] = (p, out[-1][1], max(end, out[-1][2]))
        else:
            out.append((p, begin, end))
    return out


def _split(width, repetitive):
    """Documents in which a window of ``width`` words occurs twice, with codes of their words, or the others, with their words in order."""

    def split(batches):
        for batch in byte_slices(batches, 1):
            texts = as_bytes(batch.column(1))
            picked, words_of, codes_of, keys = [], [], [], []
            for first, last in text_groups(texts):
                hashes, counts = word_hashes(texts[first:last])
                ends = np.cumsum(counts)
                for row, begin, end in zip(range(first, last), ends - counts, ends, strict=True):
                    windows = np.sort(window_hashes(hashes[begin:end], width)) if end - begin > width else hashes[:0]
                    if bool((windows[1:] == windows[:-1]).any()) != repetitive:
                        continue
                    picked.append(row)
                    words = texts[row].split()
                    words_of.append(b" ".join(words))
                    if repetitive:
                        code = {}
                        codes_of.append(np.array([code.setdefault(x, len(code)) for x in words], np.int32))
                        identity = str(batch.column(0)[row].as_py()).encode()
                        keys.append(hashlib.blake2b(identity + b"\0" + words_of[-1], digest_size=16).digest())
            columns = [batch.column(0).take(pa.array(picked, pa.int64())), pa.array(words_of, pa.binary()).cast(pa.string())]
            if repetitive:
                columns += [pa.array(keys, pa.binary()), pa.array(codes_of, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "key", "codes"][: len(columns)])

    return split


def tiles(coded: DataFrame) -> DataFrame:
    """(key, octave, low, first, past, tile) from (key, codes): per octave of the period overlapping stretches of the codes.

    A tile of the octave of periods from B up to 2B holds the boundaries from ``first`` up to ``past``, 2B words before the first
    and 4B words behind the last of them; ``low`` is the place of its first word.
    """
    n = F.size("codes")
    octaves = F.sequence(F.lit(0), F.floor(F.log2((n / 2).cast("double")) + 1e-9).cast("int"))
    base = F.expr("shiftleft(1, octave)")
    core = F.greatest(F.lit(8) * base, F.lit(CORE))
    spread = coded.filter(n >= 2).select("key", "codes", F.explode(octaves).alias("octave"))
    placed = spread.filter(F.lit(2) * base <= n).select("key", "codes", "octave", F.explode(F.sequence(F.lit(0), n - 1, core)).alias("first"))
    low = F.greatest(F.lit(0), F.col("first") - F.lit(2) * base)
    past = F.least(n, F.col("first") + core)
    high = F.least(n, F.col("first") + core + F.lit(4) * base)
    return placed.select(
        "key", "octave", low.cast("long").alias("low"), F.col("first").cast("long").alias("first"), past.cast("long").alias("past"),
        F.slice("codes", low + 1, high - low).alias("tile"),
    )


def _solve(batches):
    schema = pa.schema([("key", pa.binary()), ("period", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        key, octave, low, first, past = (batch.column(i).to_pylist() for i in range(5))
        values, ends = batch.column(5).flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *[len(x) for x in batch.column(5)]])
        rows = []
        for i in range(batch.num_rows):
            tile, shortest = values[ends[i] : ends[i + 1]], 1 << octave[i]
            if shortest < _FAR:
                found = near_fragments(tile, range(shortest, 2 * shortest))
            else:
                begin = -(-first[i] // shortest) * shortest
                found = far_fragments(tile, shortest, range(begin - low[i], past[i] - low[i], shortest))
            rows += [(key[i], p, low[i] + a, low[i] + b) for p, a, b in found]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def stitched(fragments: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, start, length, period), one row per run, from fragments of them (key, period, begin, end).

    Two fragments belong to one run if they share at least a period of words; different runs of one period share less.
    """
    along = Window.partitionBy("key", "period").orderBy("begin", "end")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col("begin") > before - F.col("period")), 1).otherwise(0)
    numbered = fragments.withColumn("_opens", opens).withColumn("_run", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("key", "period", "_run").agg(F.min("begin").alias("start"), F.max("end").alias("end"))
    length = F.col("end") - F.col("start")
    return joined.select("key", "start", length.alias("length"), "period").filter(F.col("length") >= F.greatest(F.lit(least), 2 * F.col("period")))


def _collapse(batches):
    for batch in byte_slices(batches, 1):
        out = []
        for words, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = words.split(" ") if words else []
            dropped = np.zeros(len(words) + 1, np.int64)
            for run in runs or []:
                dropped[run["start"] + run["period"]] += 1
                dropped[run["start"] + run["length"]] -= 1
            out.append(" ".join(x for x, gone in zip(words, np.cumsum(dropped).tolist(), strict=False) if not gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.string())], names=["doc_id", "runs", "collapsed"])


def periodic_runs(documents: DataFrame, *, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, runs, collapsed) per row: every run of words, ordered by start and period, and the text without the repeats.

    A run is a longest stretch of at least ``least`` words and twice its smallest period (words that many places apart are equal);
    of it ``collapsed`` keeps the first period. Words are split at space and \\x09-\\x0D and compared byte by byte.

    A run implies a window of half of ``least`` words that occurs twice, so texts without one are done at once. The others are cut into
    tiles for every octave of the period, each tile is solved alone, and fragments meet by document and period. Only fragments, runs and the words of
    repetitive documents are shuffled; tiles of documents of more than ``SPREAD`` words are dealt over all tasks.
    Null and empty texts have no runs and collapse to an empty text. Ids may be null or repeated: every row is a document of its own.
    An empty table gives no rows.
    """
    kind, width = dict(documents.dtypes)[id_col], -(-least // 2)
    if width < 1:
        raise ValueError("a run has at least one word")
    texts = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    plain = texts.mapInArrow(_split(width, False), f"doc_id {kind}, words string")
    repetitive = staged(texts.mapInArrow(_split(width, True), f"doc_id {kind}, words string, key binary, codes array<int>"), "runs-words")
    coded = repetitive.select("key", "codes")
    short = tiles(coded.filter(F.size("codes") <= SPREAD))
    long = tiles(coded.filter(F.size("codes") > SPREAD)).repartition("key", "octave", "first")
    found = short.mapInArrow(_solve, _FOUND).unionByName(long.mapInArrow(_solve, _FOUND))
    runs = stitched(found, least).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs"))
    joined = repetitive.select("doc_id", "words", "key").join(runs, "key", "left")
    none = F.coalesce("runs", F.array().cast(_RUN)).alias("runs")
    collapsed = joined.select("doc_id", "words", none).mapInArrow(_collapse, f"doc_id {kind}, runs {_RUN}, collapsed string")
    return collapsed.unionByName(plain.select("doc_id", F.array().cast(_RUN).alias("runs"), F.col("words").alias("collapsed")))


def extended(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): one document in ten, by the hash of its id, repeats its own words from some place on; the others stay as they are."""
    hashed = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (hashed % 10 == 0).alias("_chosen"), F.floor(hashed / 10).alias("_g"))
    cut = rows.withColumn("_w", F.when(F.col("_chosen"), F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)")))
    sized = cut.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    period = sized.withColumn("_p", F.lit(1) + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)))
    repeated = F.expr("array_join(transform(sequence(0, _n - 1), i -> element_at(_w, cast(1 + if(i >= _a, _a + (i - _a) % _p, i) as int))), ' ')")
    return period.select("doc_id", F.when(F.col("_n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run (then the first, then that of smallest period) and digests of all runs and of the collapsed text, from ``periodic_runs``."""
    ranked = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = found.withColumn("_best", F.array_max(ranked))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    length, period = F.col("_best")["length"], -F.col("_best")["period"]
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best")["start"]).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
