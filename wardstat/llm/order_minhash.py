"""Near duplicates by Order MinHash and banded alignment.

A text is its sequence of five-word shingles. Each of several hash functions picks the smallest
few occurrence-labelled shingles and keeps them in text order; several such sketches make a band.
Texts that share a band are candidates, and an alignment of their shingle sequences decides. The
similarity is M / (a + b - M), with M the shingles that an alignment matches in order and a, b the
lengths; it reaches 0.8 only inside a band around the diagonal, to which the alignment is confined.

Equal word sequences are one node of the graph. A bucket of candidates is first compared as a star:
all members with its smallest one. In buckets whose members are not connected by that, the members
outside the largest class meet all others, in pieces of bounded size: every two pieces meet once and
bring their sequences along. There a pair of different classes is judged by the shingles it has in
common and its alignment, and only links that join two classes leave the task. So
every pair of a bucket is either in one class already or judged, and no list of pairs is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import (
    WORD_BYTE, column, flat_text, gram_hashes, mix, schema_of, span_hashes, steps, whole_rows, word_spans, written,
)
from wardstat.session import ship_code

WORDS, SIMILARITY = 5, 0.8
#: Sketches per band, bands, and shingles per sketch. A pair of similarity 0.8 misses a sketch with
#: a chance of about 0.37 and all bands with one of about 0.002.
ROWS, BANDS, PICKS = 2, 13, 2
#: Members of a bucket in one piece, and bytes of their sequences.
PIECE, PIECE_BYTES = 512, 16 << 20

_MULTIPLIERS = np.random.default_rng(7).integers(1 << 62, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array, size: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, rows, and per step the shingle hashes with their rows relative to the first."""
    data, offsets = flat_text(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    for first, last in steps(offsets):
        part = offsets[first : last + 1]
        body, part = data[part[0] : part[-1]], part - part[0]
        starts, ends, rows = word_spans(body, part, WORD_BYTE)
        yield first, last - first, *gram_hashes(span_hashes(body, starts, ends), rows, size)


def occurrences(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often the same shingle came before in its row."""
    order = np.lexsort((hashes, rows))
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    place = np.arange(len(h))
    count = np.empty(len(h), np.int64)
    count[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return count


def labelled_by_occurrence(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The hashes with repetitions within a row told apart."""
    again = occurrences(hashes, rows)
    repeated = again > 0
    labelled = hashes.copy()
    with np.errstate(over="ignore"):
        labelled[repeated] = mix(hashes[repeated] + again[repeated].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return labelled


def banded(values: np.ndarray) -> np.ndarray:
    """The bands of each row of sketches."""
    total = np.zeros((len(values), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            total = mix(total * np.uint64(37) + values[:, r::ROWS])
    return total


def sketches(hashes: np.ndarray, rows: np.ndarray, picks: int = PICKS) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and for each its ROWS * BANDS sketches."""
    if not len(hashes):
        return np.empty(0, np.int64), np.empty((0, len(_MULTIPLIERS)), np.uint64)
    labelled = labelled_by_occurrence(hashes, rows)
    with np.errstate(over="ignore"):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        sizes = np.diff(np.r_[starts, len(rows)])
        out = np.empty((len(starts), len(_MULTIPLIERS)), np.uint64)
        top = np.uint64(0xFFFFFFFFFFFFFFFF)
        for k, factor in enumerate(_MULTIPLIERS):
            values = labelled * factor
            values ^= values >> np.uint64(29)
            chosen = np.full((len(starts), picks), len(rows), np.int64)
            for pick in range(picks):
                least = np.minimum.reduceat(values, starts)
                hit = np.flatnonzero(values == np.repeat(least, sizes))
                owner = np.searchsorted(starts, hit, side="right") - 1
                first = np.r_[True, owner[1:] != owner[:-1]]
                hit, owner = hit[first], owner[first]
                real = least[owner] != top
                chosen[owner[real], pick] = hit[real]
                values[hit] = top
            chosen.sort(axis=1)
            total = np.zeros(len(starts), np.uint64)
            padded = np.r_[labelled, np.uint64(1)]
            for pick in range(picks):
                total = mix(total * np.uint64(31) + padded[chosen[:, pick]])
            out[:, k] = total
    return rows[starts], out


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two shingle sequences, 0 where it is below ``least``.

    Bit-parallel alignment: one bit per place of ``a``; matches outside the band are masked, which
    loses none that an alignment of the wanted similarity could use.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m) - 1e-9:
        return 0.0
    symbols, coded = np.unique(np.concatenate([a, b]), return_inverse=True)
    in_a, in_b = np.bincount(coded[:n], minlength=len(symbols)), np.bincount(coded[n:], minlength=len(symbols))
    shared = int(np.minimum(in_a, in_b).sum())
    if shared < least * (n + m - shared) - 1e-9:
        return 0.0
    # Indels that an alignment may have: n + m - 2M with M = least / (1 + least) * (n + m).
    width = int((n + m) * (1.0 - 2.0 * least / (1.0 + least)) + 1e-9) + 1
    places: dict[int, int] = {}
    for i, s in enumerate(coded[:n].tolist()):
        places[s] = places.get(s, 0) | (1 << i)
    full, band = (1 << n) - 1, (1 << (2 * width + 1)) - 1
    state = full
    for j, s in enumerate(coded[n:].tolist()):
        match = places.get(s)
        if match is None:
            continue
        match &= band << (j - width) if j >= width else band >> (width - j)
        used = state & match
        state = ((state + used) | (state - used)) & full
    matched = n - state.bit_count()
    similarity = matched / (n + m - matched)
    return similarity if similarity >= least - 1e-9 else 0.0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): label is the smallest node it is connected to.

    Large-star and small-star steps in turn: each only aggregates minima per node and joins them
    back, so a node with any number of neighbours is never gathered.
    """
    current = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = state(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("b").alias("node")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def _signatures(docs: DataFrame, text_col: str) -> DataFrame:
    packed = whole_rows(docs)
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, slot = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = pc.struct_field(batch.column(0), [place])
            bands = np.zeros((batch.num_rows, BANDS), np.uint64)
            whole, counts = [b""] * batch.num_rows, [0] * batch.num_rows
            has, keys = np.zeros(batch.num_rows, bool), [b""] * batch.num_rows
            for first, rows, hashes, owners in shingles(texts):
                cuts = np.searchsorted(owners, np.arange(rows + 1))
                for k in range(rows):
                    keys[first + k] = hashes[cuts[k] : cuts[k + 1]].tobytes()
                    counts[first + k] = int(cuts[k + 1] - cuts[k])
                found, values = sketches(hashes, owners)
                for row, sketch in zip(found.tolist(), values):
                    whole[first + row] = sketch.tobytes()
                bands[first + found] = banded(values)
                has[first + found] = True
            # A text without words is only ever equal to the same text.
            raw = [b"" if h else (t.as_py() or "").encode() for h, t in zip(has, texts)]
            digests = [blake2b(k + b"|" + r, digest_size=16).digest() for k, r in zip(keys, raw)]
            lists = [row.view(np.int64).tolist() if h else [] for row, h in zip(bands, has)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(digests, pa.binary()), pa.array([part] * batch.num_rows, pa.int64()),
                    pa.array(range(slot, slot + batch.num_rows), pa.int64()), pa.array(lists, pa.list_(pa.int64())),
                    pa.array(whole, pa.binary()), pa.array(counts, pa.int64()),
                ],
                names=["row", "content", "part", "slot", "bands", "sketch", "shingles"],
            )
            slot += batch.num_rows

    schema = schema_of(packed.schema["row"], "content binary, part long, slot long, bands array<long>, sketch binary, shingles long")
    return written(packed.mapInArrow(work, schema), "order-minhash")


def _sequences(texts: DataFrame) -> DataFrame:
    """(node, sequence): the shingle hashes of each (node, text), in text order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, rows, hashes, owners in shingles(column(batch, "text")):
                cuts = np.searchsorted(owners, np.arange(rows + 1))
                out += [hashes[cuts[k] : cuts[k + 1]].tobytes() for k in range(rows)]
            yield pa.RecordBatch.from_arrays([column(batch, "node"), pa.array(out, pa.binary())], names=["node", "sequence"])

    return written(texts.mapInArrow(work, "node long, sequence binary"), "candidate-sequences")


def _verified(pairs: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with their similarity, 0 where it is below ``least``."""
    left = sequences.select(F.col("node").alias("a"), F.col("sequence").alias("sequence_a"))
    right = sequences.select(F.col("node").alias("b"), F.col("sequence").alias("sequence_b"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                aligned(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), least)
                for x, y in zip(column(batch, "sequence_a"), column(batch, "sequence_b"))
            ]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "a"), column(batch, "b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"]
            )

    return pairs.join(left, "a").join(right, "b").mapInArrow(work, "a long, b long, similarity double")


def _links(pieces: np.ndarray, band: int, nodes: np.ndarray, classes: np.ndarray, sketch: np.ndarray, sequences: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links of one meeting that join different classes: within its one piece, or between its two.

    A pair is judged in the meeting of the first band that it shares.
    """
    sizes = np.array([len(s) for s in sequences])
    starts = np.cumsum(sizes) - sizes
    bands = banded(sketch)
    low = pieces.min()
    inside = low == pieces.max()
    labelled = labelled_by_occurrence(np.concatenate(sequences), np.repeat(np.arange(len(nodes)), sizes))
    coded = np.unique(labelled, return_inverse=True)[1]
    present, links = np.zeros(int(coded.max()) + 1, bool), []
    for i in np.flatnonzero(pieces == low):
        rest = np.arange(i + 1, len(nodes)) if inside else np.flatnonzero(pieces != low)
        rest = rest[classes[rest] != classes[i]]
        rest = rest[np.minimum(sizes[rest], sizes[i]) >= least * np.maximum(sizes[rest], sizes[i]) - 1e-9]
        rest = rest[(bands[rest] == bands[i]).argmax(axis=1) == band]
        if not len(rest):
            continue
        # An alignment never matches more shingles than the two texts have in common.
        own = coded[starts[i] : starts[i] + sizes[i]]
        present[own] = True
        first, last = rest[0], rest[-1]
        found = np.r_[0, np.cumsum(present[coded[starts[first] : starts[last] + sizes[last]]])]
        begin = starts[rest] - starts[first]
        common = found[begin + sizes[rest]] - found[begin]
        present[own] = False
        enough = common >= least * (sizes[i] + sizes[rest] - common) - 1e-9
        for j in rest[enough][np.argsort(-common[enough], kind="stable")]:
            if classes[i] != classes[j] and aligned(sequences[i], sequences[j], least):
                links.append((int(nodes[i]), int(nodes[j])))
                classes[classes == classes[j]] = classes[i]
    return links


def _meetings(members: DataFrame, nodes: DataFrame, sequences: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that join what the stars have left in different classes."""
    told = _labelled(members, labels, "node").withColumnRenamed("label_node", "label").join(nodes.select("node", "sketch", "shingles"), "node")
    classes = told.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), (8 * F.sum("shingles")).alias("bytes"))
    n, size = F.sum("n"), F.sum("bytes")
    # The star has judged the only pair of a bucket of two.
    open_ = classes.groupBy("bucket").agg(
        F.max(F.struct("n", "bytes", "label")).alias("top"), n.alias("n"), size.alias("bytes"), F.count(F.lit(1)).alias("classes")
    ).where("classes > 1 AND n > 2")

    def pieces(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / PIECE), F.ceil(size / PIECE_BYTES)).cast("int")

    # Written before the join, so that adaptive execution can split a large bucket there.
    open_ = open_.select(
        "bucket", F.col("top.label").alias("main"), pieces(F.col("top.n"), F.col("top.bytes")).alias("inner"),
        pieces(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("outer"),
    )
    dealt = told.join(written(open_, "open-buckets"), "bucket").join(sequences, "node")
    # Outer pieces, numbered from 0, meet all pieces; those of the largest class meet the outer ones.
    home, deal = F.col("label") == F.col("main"), F.xxhash64("node")
    own = F.when(home, F.col("outer") + F.pmod(deal, F.col("inner"))).otherwise(F.pmod(deal, F.col("outer"))).cast("int")
    last = F.when(home, F.col("outer")).otherwise(F.col("outer") + F.col("inner")) - 1
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    dealt = dealt.select(
        F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"),
        "band", "own", "node", "label", "sketch", "sequence",
    )

    def meet(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        own, node, label = (table.column(c).to_numpy().copy() for c in ("own", "node", "label"))
        sketch = np.frombuffer(b"".join(v.as_py() for v in table.column("sketch")), np.uint64).reshape(len(node), -1)
        whole = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("sequence")]
        found = _links(own, table.column("band")[0].as_py(), node, label, sketch, whole, least)
        a, b = (np.array([link[k] for link in found], np.int64) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            ids = column(batch, "meeting").to_numpy()
            cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
            for start, stop in zip(cuts, [*cuts[1:], len(ids)]):
                if held and ids[start] != last:
                    yield meet(held)
                    held = []
                last = ids[start]
                held.append(batch.slice(start, stop - start))
        if held:
            yield meet(held)

    return dealt.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with its class.

    ``class_id`` is the smallest id of the class, ``class_size`` its rows, and ``kept`` marks the one
    row that stays (smallest id, null ids last). Texts with equal words are one text. Texts without
    words, empty and null ones among them, are in a class only with rows of the same text. Of wholly
    equal rows one stays. Texts are compared whole, however long, and the rows' own columns stay inside
    ``row``, so their names cannot clash. An empty table gives an empty result.
    """
    ship_code(docs.sparkSession)
    rows = _signatures(docs, text_col)
    ident = F.col("row").getField(id_col)
    rank = F.struct(ident.isNull().alias("missing"), ident.alias("id"), "part", "slot")
    # The smallest row of each content, combined before the exchange.
    nodes = rows.groupBy("content").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("bands", "sketch", "shingles")])
    nodes = written(nodes.select("*", F.monotonically_increasing_id().alias("node")), "contents")
    buckets = nodes.select("node", F.posexplode("bands").alias("band", "value"))
    # What joins back to the members is written first, so that adaptive execution can split a large bucket.
    shared = written(buckets.groupBy("band", "value").agg(F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"), "shared-buckets")
    members = buckets.join(shared, ["band", "value"]).select(F.xxhash64("band", "value").alias("bucket"), "band", "node")
    members = written(members, "buckets")
    chosen = members.select("node").distinct().join(nodes.select("node", "content", "best"), "node")
    where = chosen.select("node", F.col("best.part").alias("part"), F.col("best.slot").alias("slot"))
    texts = _sequences(
        rows.select(F.col("row").getField(text_col).alias("text"), "part", "slot").join(where, ["part", "slot"]).select("node", "text")
    )

    centres = written(members.groupBy("bucket").agg(F.min("node").alias("centre")), "centres")
    stars = members.join(centres, "bucket").where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    tried = written(_verified(stars, texts, similarity), "alignments").where("similarity > 0").select("a", "b")
    labels = written(components(tried), "labels")
    later = written(_meetings(members, nodes, texts, labels, similarity), "links")
    if not later.isEmpty():
        labels = written(components(tried.unionByName(later)), "labels")

    named = _labelled(nodes.select("node", "content", "best", "n"), labels, "node")
    classes = named.groupBy("label_node").agg(F.min("best").alias("keep"), F.sum("n").alias("class_size"))
    told = named.join(classes, "label_node").select("content", "keep", "class_size")
    return rows.select("row", "content", "part", "slot").join(told, "content").select(
        "row",
        F.col("keep.id").alias("class_id"),
        "class_size",
        ((F.col("part") == F.col("keep.part")) & (F.col("slot") == F.col("keep.slot"))).alias("kept"),
    )


def _labelled(df: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``df`` with the class of its column ``name``; a node without links is its own class."""
    told = labels.select(F.col("node").alias(name), F.col("label").alias("found"))
    return df.join(told, name, "left").withColumn(f"label_{name}", F.coalesce("found", name)).drop("found")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with the columns of ``docs``."""
    return near_duplicates(docs, id_col, text_col).where("kept").select("row.*")
