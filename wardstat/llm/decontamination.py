"""Benchmark passages in documents by SimHash windows and exact verification.

Windows have the size of an item, in words. Their SimHash is looked up in a multi-index: the 64
bits are cut into four blocks, and a fingerprint within the radius differs by at most a quarter of
it in some block, so listing each item under all block values that near finds every item within
the radius. Exact weighted similarity of the five-word shingles then decides.

Only windows are hashed whose shingles found in any item weigh at least the wanted share of the
window: no other window can reach the similarity with a single item.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardstat.llm.common import schema_of, whole_rows, written
from wardstat.llm.order_minhash import SIMILARITY, WORDS, shingles
from wardstat.session import ship_code

#: Differing bits at most; one less than a multiple of the blocks, so that the guarantee is tight.
RADIUS = 19
BLOCKS, BLOCK_BITS = 4, 16
#: Items that one pass over the documents looks for; its index has a size bound by this.
ITEMS_PER_PASS = 1000


def fingerprints(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of each window of weighted shingles, from running sums per bit."""
    bits = ((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2.0 - 1.0
    sums = np.zeros((len(hashes) + 1, 64))
    np.cumsum(bits * weights[:, None], axis=0, out=sums[1:])
    signs = sums[ends] - sums[starts] > 1e-9
    return (signs.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Weights:
    """How rare a shingle is among all items, whichever pass they are searched in.

    Only shingles that several items hold are listed; all others weigh the same, those of one item and
    those of none.
    """

    def __init__(self, items: int, shared: np.ndarray, held: np.ndarray) -> None:
        order = np.argsort(shared)
        self.shared, self.rare = shared[order], 1.0 + np.log((items + 1.0) / 2.0)
        self.values = 1.0 + np.log((items + 1.0) / (held[order] + 1.0))

    @classmethod
    def of(cls, sequences: list[np.ndarray]) -> Weights:
        known, held = np.unique(np.concatenate([np.unique(s) for s in sequences] or [np.empty(0, np.uint64)]), return_counts=True)
        return cls(len(sequences), known[held > 1], held[held > 1])

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(hashes), self.rare)
        place = np.minimum(np.searchsorted(self.shared, hashes), len(self.shared) - 1)
        return np.where(self.shared[place] == hashes, self.values[place], self.rare)


class ItemIndex:
    """Items with their shingle weights, fingerprints and the multi-index over these."""

    def __init__(self, ids: list, sequences: list[np.ndarray], radius: int = RADIUS, weights: Weights | None = None) -> None:
        self.ids, self.radius = ids, radius
        self.weight = weights if weights is not None else Weights.of(sequences)
        self.known = np.unique(np.concatenate(sequences or [np.empty(0, np.uint64)]))
        self.bags = [self.bag(s) for s in sequences]
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.sizes = {
            int(n): np.unique(np.concatenate([s for s in sequences if len(s) == n])) for n in np.unique(self.lengths)
        }
        self.prints = np.array(
            [fingerprints(s, self.weight(s), np.array([0]), np.array([len(s)]))[0] for s in sequences], np.uint64
        )
        near = [sum(1 << b for b in c) for r in range(radius // BLOCKS + 1) for c in combinations(range(BLOCK_BITS), r)]
        flips = np.array(near, np.uint64)
        self.tables = []
        for block in range(BLOCKS):
            values = (self.prints >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)
            cells = (values[:, None] ^ flips[None, :]).astype(np.int64).ravel()
            items = np.repeat(np.arange(len(ids)), len(flips))
            order = np.argsort(cells, kind="stable")
            self.tables.append((np.searchsorted(cells[order], np.arange((1 << BLOCK_BITS) + 1)), items[order].astype(np.int32)))

    def bag(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds, counts = np.unique(hashes, return_counts=True)
        return kinds, counts, self.weight(kinds)

    def within(self, prints: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
        """(window, item) of all pairs whose fingerprints differ in at most ``radius`` bits.

        With ``size``, only items of so many shingles.
        """
        for k, value in enumerate(prints):
            near = []
            for block, (starts, items) in enumerate(self.tables):
                cell = int(value >> np.uint64(BLOCK_BITS * block)) & ((1 << BLOCK_BITS) - 1)
                near.append(items[starts[cell] : starts[cell + 1]])
            found = np.unique(np.concatenate(near))
            if size is not None:
                found = found[self.lengths[found] == size]
            for item in found[np.bitwise_count(self.prints[found] ^ value) <= self.radius]:
                yield k, int(item)

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Sum of the smaller over sum of the larger weighted counts."""
        kinds, counts, weights = self.bag(window)
        other, other_counts, other_weights = self.bags[item]
        _, left, right = np.intersect1d(kinds, other, assume_unique=True, return_indices=True)
        common = float((np.minimum(counts[left], other_counts[right]) * weights[left]).sum())
        total = float((counts * weights).sum() + (other_counts * other_weights).sum())
        return common / (total - common) if total > common else 1.0

    def search(self, hashes: np.ndarray, least: float) -> dict[int, tuple[float, int]]:
        """Best similarity and its start for every item that some window of one document reaches."""
        best: dict[int, tuple[float, int]] = {}
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        places = np.flatnonzero(self.known[place] == hashes)
        if not len(places):
            return best
        weights = self.weight(hashes)
        running = np.r_[0.0, np.cumsum(weights)]
        for size, own in self.sizes.items():
            # Shingles that no item of this size has count as missed.
            held = np.zeros(len(hashes) + 1)
            of_size = places[np.isin(hashes[places], own)]
            held[of_size + 1] = weights[of_size]
            held = np.cumsum(held)
            length = min(size, len(hashes))
            starts = np.arange(len(hashes) - length + 1)
            full = held[length:] - held[: len(starts)] >= least * (running[length:] - running[: len(starts)]) - 1e-9
            starts = starts[full]
            for cut in range(0, len(starts), 4096):
                s = starts[cut : cut + 4096]
                low, high = s[0], s[-1] + length
                prints = fingerprints(hashes[low:high], weights[low:high], s - low, s - low + length)
                for k, item in self.within(prints, size):
                    value = self.similarity(hashes[s[k] : s[k] + length], item)
                    if value >= least - 1e-9 and value > best.get(item, (0.0, 0))[0]:
                        best[item] = value, int(s[k])
        return best


def _item_weights(items: DataFrame, text_col: str) -> Weights:
    """Weights over all items: their number, and the shingles that several of them hold."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, hashes, owners in shingles(batch.column(0)):
                order = np.lexsort((hashes, owners))
                hashes, owners = hashes[order], owners[order]
                new = np.r_[True, (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])][: len(hashes)]
                with_words = np.r_[True, owners[1:] != owners[:-1]][: len(owners)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes[new].view(np.int64)), pa.array(with_words[new].astype(np.int64))], names=["shingle", "item"]
                )

    found = items.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(distinct, "shingle long, item long")
    held = written(found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.sum("item").alias("items")), "item-shingles")
    # The benchmark's own repetitions: this grows with its items, never with the documents.
    shared = held.where("n > 1").select("shingle", "n").toPandas()
    total = held.agg(F.sum("items")).first()[0] or 0
    return Weights(total, shared["shingle"].to_numpy(np.int64).view(np.uint64), shared["n"].to_numpy(np.float64))


def _items(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list, list[np.ndarray]]]:
    """The items with words, a bounded number at a time."""
    ids, sequences = [], []
    for row in items.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).toLocalIterator():
        for _, _, hashes, _ in shingles(pa.array([row["text"]], pa.string())):
            if len(hashes):
                ids.append(row["id"])
                sequences.append(hashes)
        if len(ids) == ITEMS_PER_PASS:
            yield ids, sequences
            ids, sequences = [], []
    if ids:
        yield ids, sequences


def find_leaks(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    similarity: float = SIMILARITY, radius: int = RADIUS,
) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with ``leaks``: array of (item_id, similarity, start).

    A leak is an item that some window of the item's number of shingles reaches in similarity,
    within the SimHash radius; ``start`` is the window's first word. A document shorter than the
    item is one window. Shingles are weighed by how rare they are among all items, so the passes do
    not change a similarity. Null and empty texts have no leaks, items without words are never found,
    and without items no document has any. Equal items are each reported, and so are repeated rows;
    of windows that tie the first is reported. Item ids are of any type. Texts are searched whole,
    however long, and the rows' own columns stay inside ``row``, so their names cannot clash.
    """
    ship_code(docs.sparkSession)
    place = docs.columns.index(text_col)
    id_field = items.schema[item_id].dataType
    kind = pa.list_(pa.struct([("item_id", to_arrow_type(id_field)), ("similarity", pa.float64()), ("start", pa.int64())]))
    none = F.array().cast(f"array<struct<item_id:{id_field.simpleString()},similarity:double,start:bigint>>")
    found = whole_rows(docs).withColumn("leaks", none)
    weights = _item_weights(items, item_text)
    for ids, sequences in _items(items, item_id, item_text):
        # Bounded by the items of a pass, but for the weights; each worker reads it once.
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex(ids, sequences, radius, weights))
        found = found.mapInArrow(_pass(shared, place, kind, similarity), schema_of(*found.schema.fields))
    return found


def _pass(shared, place, kind, similarity):

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            leaks = batch.column(1).to_pylist()
            for first, rows, hashes, owners in shingles(pc.struct_field(batch.column(0), [place]), WORDS):
                spot = np.minimum(np.searchsorted(index.known, hashes), len(index.known) - 1)
                touched = np.unique(owners[index.known[spot] == hashes])
                cuts = np.searchsorted(owners, np.arange(rows + 1))
                for k in touched.tolist():
                    best = index.search(hashes[cuts[k] : cuts[k + 1]], similarity)
                    leaks[first + k] = leaks[first + k] + [
                        {"item_id": index.ids[i], "similarity": v, "start": s} for i, (v, s) in sorted(best.items())
                    ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(leaks, kind)], names=["row", "leaks"])

    return work


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with their own columns."""
    return find_leaks(docs, items, text_col).where(F.size("leaks") == 0).select("row.*")
