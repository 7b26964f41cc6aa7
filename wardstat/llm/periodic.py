"""Detection of periodic runs of words, by recursive frequency splitting and a lag scan.

A run is a maximal stretch of words with smallest period q whose length is at least ``LEAST_POWER``
times q and at least ``LEAST_WORDS`` words. Each word of a run occurs in it at least ``LEAST_POWER``
times. So a word that occurs less often within a segment is in no run of it and splits the segment;
what is left is counted again, until nothing splits any more. Few words of prose survive.

The lag scan then looks at the surviving segments. Scanning all lags would cost the square of a
segment, so lags are taken by size: for lags from B/2 + 1 to B, the distance from each block of B
words to its next occurrence is the only lag that can be a period there. In a run of period q <= B
every block's next occurrence is exactly q words on, because a block at least as long as a primitive
period meets itself only at its multiples; so the runs are the stretches of equal distance. Blocks
are numbered exactly, block 2B by the numbers of its two halves: there is no hashing, and a
segment of n words costs O(n log n) for each of its O(log n) sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import schema_of, whole_rows
from wardstat.session import ship_code

#: Least length of a run in words and in periods.
LEAST_WORDS, LEAST_POWER = 6, 4

#: Bytes of text after which a batch goes back to Spark.
OUT_BYTES = 8 << 20


def surviving_segments(ids: np.ndarray, least: int = LEAST_POWER, shortest: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that recursive splitting leaves, in order, and the number of their segment.

    ``ids`` numbers the words of one text. Within a segment every word occurs at least ``least``
    times; segments are stretches of consecutive words, at least ``shortest`` long.
    """
    done_places, done_segments, settled = [], [], 0
    places, segments = np.arange(len(ids)), np.zeros(len(ids), np.int64)
    while len(places):
        # Occurrences of each word within its segment.
        _, inverse, counts = np.unique(segments * len(ids) + ids[places], return_inverse=True, return_counts=True)
        frequent = counts[inverse] >= least
        split = np.zeros(int(segments[-1]) + 1, bool)
        split[segments[~frequent]] = True
        # Segments without a rare word are settled and not counted again.
        stable = ~split[segments]
        if stable.any():
            numbers = np.unique(segments[stable], return_inverse=True)[1]
            done_places.append(places[stable])
            done_segments.append(numbers + settled)
            settled += int(numbers[-1]) + 1
        keep = frequent & ~stable
        places, segments = places[keep], segments[keep]
        if not len(places):
            break
        first = np.ones(len(places), bool)
        first[1:] = (np.diff(places) > 1) | (np.diff(segments) != 0)
        segments = np.cumsum(first) - 1
        long = np.bincount(segments)[segments] >= shortest
        places, segments = places[long], segments[long]
        if len(segments):
            segments = np.unique(segments, return_inverse=True)[1]
    if not done_places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    places, segments = np.concatenate(done_places), np.concatenate(done_segments)
    order = np.argsort(places)
    places, segments = places[order], segments[order]
    # Segments lie apart, so each is one stretch: number them in order of place.
    return places, np.cumsum(np.diff(segments, prepend=segments[0]) != 0)


def lag_scan(ids: np.ndarray, places: np.ndarray, segments: np.ndarray, least: int = LEAST_POWER, shortest: int = LEAST_WORDS) -> np.ndarray:
    """All runs of the segments as rows (start, length, period), by start and then period."""
    found = []
    if len(places):
        ends = np.cumsum(np.bincount(segments))[segments]  # index after the segment's last word
        sizes = np.bincount(segments)[segments]
        # Number of the block of B words that begins at each index; -1 where none does.
        block = np.unique(segments * (int(ids.max()) + 1) + ids[places], return_inverse=True)[1]
        size, at = 1, np.arange(len(places))
        while len(at):
            number = block[at]
            order = np.argsort(number, kind="stable")
            same = number[order][1:] == number[order][:-1]
            distance = np.zeros(len(at), np.int64)
            distance[order[:-1][same]] = np.diff(at[order])[same]
            fits = np.where((2 * distance > size) & (distance <= size), distance, 0)
            # Stretches of consecutive indices with one distance.
            begin = np.ones(len(at), bool)
            begin[1:] = (np.diff(at) != 1) | (np.diff(fits) != 0)
            heads = np.flatnonzero(begin)
            lengths = np.diff(np.append(heads, len(at)))
            period = fits[heads]
            length = lengths - 1 + size + period
            good = (period > 0) & (length >= np.maximum(shortest, least * period))
            found.append(np.stack([places[at[heads[good]]], length[good], period[good]], axis=1))
            # The next size needs both halves of a block, and segments with room for longer periods.
            repeated = np.zeros(len(at), bool)
            repeated[order[1:][same]] = True
            repeated[order[:-1][same]] = True
            live = np.full(len(block), -1)
            live[at[repeated]] = number[repeated]
            at = at[repeated]
            at = at[(at + 2 * size <= ends[at]) & (sizes[at] >= least * (size + 1))]
            at = at[live[at + size] >= 0]
            if len(at):
                pairs = live[at].astype(np.int64) * (int(live.max()) + 1) + live[at + size]
                block = np.full(len(block), -1)
                block[at] = np.unique(pairs, return_inverse=True)[1]
            size *= 2
    if not found:
        return np.empty((0, 3), np.int64)
    runs = np.concatenate(found).astype(np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence among the distinct words."""
    numbers = {word: k for k, word in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))


def find_runs(words: list[bytes]) -> np.ndarray:
    """All runs of one text as rows (start, length, period), by start and then period."""
    if len(words) < LEAST_WORDS:
        return np.empty((0, 3), np.int64)
    ids = word_numbers(words)
    if np.bincount(ids).max() < LEAST_POWER:
        return np.empty((0, 3), np.int64)
    return lag_scan(ids, *surviving_segments(ids))


def best_run(runs: np.ndarray) -> tuple[int, int, int]:
    """The run with the greatest exact length/period; ties go to the smallest start, then period."""
    best = tuple(map(int, runs[0]))
    for start, length, period in runs[1:].tolist():
        if length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def collapsed_words(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def periodic_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with the periodic runs of its text.

    Returns struct ``row`` (the row's own columns, under their own names), ``n_words``, ``runs`` (array
    of start, length and period in words, by start and then period), ``best`` (the run with the
    greatest length/period; ties go to the smallest start, then period; null without runs) and
    ``collapsed`` (the text with one period left of every run, words joined by one space).

    Words are the stretches between ASCII white space. A null text has no words and so neither runs nor
    collapsed words, like an empty one. Texts are read whole; one of n words costs memory in
    proportion to n and time in proportion to n log n for each doubling of the longest period. Rows
    are independent, so repeated rows give the same result each, the table is not shuffled, and an empty
    table gives an empty result.
    """
    ship_code(docs.sparkSession)
    packed = whole_rows(docs)
    place = docs.columns.index(text_col)
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def as_structs(runs: np.ndarray) -> pa.StructArray:
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, k])) for k in range(3)], fields=list(run_type))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [place])
            first = 0
            while first < batch.num_rows:
                counts, runs, best, collapsed, held = [], [], [], [], 0
                while first + len(counts) < batch.num_rows and held < OUT_BYTES:
                    text = texts[first + len(counts)].as_py() or ""
                    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space
                    found = find_runs(words)
                    counts.append(len(words))
                    runs.append(found)
                    best.append(dict(zip(("start", "length", "period"), best_run(found))) if len(found) else None)
                    collapsed.append(collapsed_words(words, found).decode("utf-8", "surrogatepass"))
                    held += len(collapsed[-1])
                offsets = np.cumsum([0] + [len(r) for r in runs])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(counts)),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), as_structs(np.concatenate(runs))),
                        pa.array(best, run_type),
                        pa.array(collapsed, pa.string()),
                    ],
                    names=["row", "n_words", "runs", "best", "collapsed"],
                )
                first += len(counts)

    run = "struct<start:bigint,length:bigint,period:bigint>"
    return packed.mapInArrow(task, schema_of(packed.schema["row"], f"n_words long, runs array<{run}>, best {run}, collapsed string"))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` where a tenth of the texts is made periodic, in DataFrame functions.

    With h the CRC-32 of the decimal id and g = floor(h / 10), texts with h % 10 = 0 repeat the p words
    from word a = g % n on to their end, p = 1 + floor((n - a) / (3 + g % 8)). Rows without id or
    without words stay as they are.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    words = F.filter(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    g = F.floor(h / 10)
    n = F.size("_words").cast("long")
    a = F.when(n > 0, g % F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - F.col("_a")) / (3 + g % 8))
    marked = docs.withColumn("_words", F.when(h % 10 == 0, words)).withColumn("_a", a).withColumn("_p", p)
    head = F.slice("_words", 1, F.col("_a").cast("int"))
    period = F.slice("_words", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    times = F.ceil((n - F.col("_a")) / F.col("_p")).cast("int")
    whole = F.slice(F.concat(head, F.flatten(F.array_repeat(period, times))), F.lit(1), n.cast("int"))
    text = F.when(F.col("_a").isNotNull(), F.concat_ws(" ", whole)).otherwise(F.col(f"`{text_col}`"))
    return marked.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of :func:`periodic_runs`, one row per document."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        F.col("row")[id_col].alias(id_col),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda line: F.concat(line, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
