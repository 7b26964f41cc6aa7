"""Removal of byte strings that occur in an earlier document, by suffix sorting.

All strings of ``LENGTH`` bytes of a text are windows. Each window is led by its anchor, the
shortest-hash string of ``KMER`` bytes in it; equal windows have equal anchors at equal places. The
windows that share one anchor form one stretch of text.

1. Anchors meet by hash, and each block of documents learns which of its own occur in several
   documents. A block sends every anchor once, however often it has it.
2. Stretches with such an anchor meet by its hash. Equal stretches are one; where several differ,
   the suffixes that start at their windows are sorted, those with the anchor at the same place together:
   multikey quicksort with characters of eight bytes down to a shallow depth, then the groups that still
   agree are compared to the end, and those that do not agree throughout are ordered by a blind trie.
   Each window learns the smallest document that has it.
3. Each block removes the bytes of windows that a smaller document has.

The text itself is written once, in buckets, and is never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import WHOLE_NUMBERS, column, flat_text, mix, ordered_numbers, partitions_for, steps, written
from wardstat.session import scratch_path, ship_code

LENGTH, KMER = 50, 20
#: Bytes of text in a block, and anchors or stretches that one task takes.
BLOCK_BYTES, RANGE_ANCHORS, RANGE_STRETCHES = 3 << 20, 2_000_000, 250_000
#: Windows whose anchors are found in one step.
STEP_WINDOWS = 1 << 15
#: Bytes that the multikey quicksort looks at before the rest is left to tries.
SHALLOW = 24
#: So many tries at least grow together.
TOGETHER = 64

_SPREAD = LENGTH - KMER + 1
_VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
#: Stands for a missing id: larger than all others, and not smaller than itself.
NO_ID = np.iinfo(np.int64).max


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _leads(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every string of ``KMER`` bytes, and for every window the place of its anchor.

    In steps whose arrays stay in the processor's cache.
    """
    windows = len(data) - LENGTH + 1
    hashes, place = np.empty(len(data) - KMER + 1, np.uint64), np.empty(windows, np.int32 if windows < 1 << 31 else np.int64)
    low = np.uint64(0xFFFFFFFF)
    for begin in range(0, windows, STEP_WINDOWS):
        part = data[begin : min(begin + STEP_WINDOWS, windows) + LENGTH - 1]
        by_size, size = {1: _VALUES[part]}, 1
        while 2 * size <= KMER:
            half = by_size[size]
            by_size[2 * size] = half[:-size] * _power(size) + half[size:]
            size *= 2
        hashed, have = by_size[size], size
        for rest in sorted((s for s in by_size if s < size), reverse=True):
            if have + rest <= KMER:
                keep = len(part) - have - rest + 1
                hashed = hashed[:keep] * _power(rest) + by_size[rest][have : have + keep]
                have += rest
        hashed = mix(hashed)
        hashes[begin : begin + len(hashed)] = hashed
        # Half of the hash above the place: the leftmost of equal hashes leads.
        least, width = (hashed & ~low) | np.arange(len(hashed), dtype=np.uint64), 1
        while width < _SPREAD:
            step = min(width, _SPREAD - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        place[begin : begin + len(least)] = (least & low).astype(place.dtype) + begin
    return hashes, place


def stretches(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, anchor place, first and last window, and row of every stretch of the rows."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < LENGTH:
        return np.empty(0, np.uint64), none, none, none, none
    with np.errstate(over="ignore"):
        hashes, place = _leads(data)
    inside = np.ones(len(place), bool)
    inside[_windows_across(offsets, len(place))] = False
    begins, ends = inside.copy(), inside.copy()
    changes = place[1:] != place[:-1]
    begins[1:] &= changes | ~inside[:-1]
    ends[:-1] &= changes | ~inside[1:]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    anchor = place[first].astype(np.int64)
    # The smallest hashes lead, so they are mixed again to spread over the ranges evenly.
    keys = mix(hashes[anchor] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return keys, anchor, first, last, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(first, offsets)))


def _windows_across(offsets: np.ndarray, windows: int) -> np.ndarray:
    """Windows that begin in one row and end in another."""
    begin, stop = offsets[:-1], np.minimum(offsets[1:], windows)
    first = np.maximum(begin, offsets[1:] - LENGTH + 1)
    count = np.maximum(stop - first, 0)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


class BlindTrie:
    """Orders byte strings of one length; equal strings share a leaf.

    Inner nodes know only the place of the first difference below them. An insertion walks down
    blindly by the bytes at these places, compares with the leaf reached, and enters a node at the
    true first difference.
    """

    def __init__(self) -> None:
        self.root = None  # a leaf is [text, members], a node is (place, {byte: child})

    def insert(self, text: bytes, member: int) -> None:
        if self.root is None:
            self.root = [text, [member]]
            return
        node = self.root
        while isinstance(node, tuple):
            place, children = node
            node = children.get(text[place]) or next(iter(children.values()))
        other = node[0]
        if other == text:
            node[1].append(member)
            return
        split = next(i for i, (a, b) in enumerate(zip(text, other)) if a != b)
        leaf, above, node = [text, [member]], None, self.root
        while isinstance(node, tuple) and node[0] < split:
            above, node = (node, text[node[0]]), node[1][text[node[0]]]
        if isinstance(node, tuple) and node[0] == split:
            node[1][text[split]] = leaf
            return
        entered = (split, {text[split]: leaf, other[split]: node})
        if above is None:
            self.root = entered
        else:
            above[0][1][above[1]] = entered

    def leaves(self) -> Iterator[list[int]]:
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack.extend(child for _, child in sorted(node[1].items(), reverse=True))
            else:
                yield node[1]


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, so that numbers order as the bytes do."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    return np.ndarray((len(text) + 1,), ">u8", padded, strides=(1,))


def multikey_quicksort(text: np.ndarray, places: np.ndarray, order: np.ndarray, first: np.ndarray, shallow: int) -> np.ndarray:
    """Sort ``order`` in place within its groups by the windows' first ``shallow`` bytes; marks where groups begin.

    ``first`` marks the begin of each group on entry. Eight bytes are one character. All groups take a
    step together: each is split by the character of its middle window into those below, those equal and
    those above; the equal ones go on with the next character, the others with the same one again, until
    a part is a single window or agrees in all characters.
    """
    words, first = _words(text), first.copy()
    starts = np.flatnonzero(first)
    sizes = np.diff(np.r_[starts, len(order)])
    depth = np.zeros(len(starts), np.int64)
    while True:
        more = (sizes > 1) & (depth < shallow)
        starts, sizes, depth = starts[more], sizes[more], depth[more]
        if not len(starts):
            return first
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(owner)) + (starts - begin)[owner]
        own = order[at]
        word = words[places[own] + depth[owner]].astype(np.uint64)
        pivot = word[begin + sizes // 2][owner]
        side = (word >= pivot).view(np.int8) + (word > pivot).view(np.int8)
        # Only groups with more than one part move.
        parts = np.add.reduceat((np.diff(side, prepend=side[0]) != 0) & (np.diff(owner, prepend=owner[0]) == 0), begin)
        move = np.flatnonzero(parts[owner] > 0)
        if len(move):
            by = move[np.argsort(owner[move] * 3 + side[move], kind="stable")]
            order[at[move]], side[move] = own[by], side[by]
        new = np.flatnonzero(np.r_[True, (side[1:] != side[:-1]) | (owner[1:] != owner[:-1])])
        first[at[new]] = True
        starts, sizes = at[new], np.diff(np.r_[new, len(side)])
        depth = depth[owner[new]] + 8 * (side[new] == 1)


def sort_windows(text: np.ndarray, places: np.ndarray, groups: np.ndarray | None = None, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the windows at ``places``, and the class of each in that order; equal windows share one.

    ``groups`` numbers windows so that equal ones have the same number; windows are ordered by it first.
    """
    order, first = np.arange(len(places)), np.zeros(len(places), bool)
    first[:1] = True
    if groups is not None:
        order = np.argsort(groups, kind="stable")
        ranked = groups[order]
        first[1:] = ranked[1:] != ranked[:-1]
    first = multikey_quicksort(text, places, order, first, shallow)
    group = np.cumsum(first) - 1
    # Deep: groups that agree to the end stay; the others are ordered by a trie each.
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(group)])
    words, at = _words(text), np.array([*range(shallow, LENGTH - 8, 8), LENGTH - 8])  # words that overlap order as the bytes do
    differs = np.zeros(len(group), bool)
    many = np.flatnonzero(np.repeat(sizes > 1, sizes))
    leader = np.repeat(starts, sizes)
    for low in range(0, len(many), 1 << 18):
        part = many[low : low + (1 << 18)]
        mine, theirs = places[order[part]], places[order[leader[part]]]
        for k in at.tolist():
            differs[part] |= words[mine + k] != words[theirs + k]
    split = np.r_[False, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    mixed = np.isin(starts, leader[differs])
    starts, sizes = starts[mixed], sizes[mixed]
    # As long as enough groups take part, their tries grow together; the rest of the groups are large.
    together = np.sort(sizes)[-TOGETHER] if len(sizes) >= TOGETHER else 0
    small = sizes <= together
    if small.any():
        count = sizes[small]
        begin = np.cumsum(count) - count
        spot = np.repeat(starts[small] - begin, count) + np.arange(int(count.sum()))
        own = order[spot]
        tails = words[places[own][:, None] + at].astype(np.uint64)
        rank = blind_tries(tails, begin, count)
        by = np.argsort(rank, kind="stable")
        order[spot], rank = own[by], rank[by]
        split[spot[1:]] |= rank[1:] != rank[:-1]
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        trie = BlindTrie()
        for member in order[start : start + size].tolist():
            begin = places[member]
            trie.insert(text[begin + shallow : begin + LENGTH].tobytes(), member)
        spot = start
        for members in trie.leaves():
            order[spot : spot + len(members)] = members
            split[spot] = split[spot] or spot > start
            spot += len(members)
    return order, np.cumsum(split)


def blind_tries(texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ranks of texts in the order of their group and, within it, of a blind trie; equal texts share a rank.

    ``texts`` has a row of 64-bit words per text, and the groups are runs of rows. The tries of all groups
    grow together: a round inserts the next text of every group. Inner nodes are like those of
    :class:`BlindTrie`, with bits in place of bytes, so each has two children: rows as ``~row``, or nodes.
    """

    def bit(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        return ((texts[rows, place >> 6] >> (63 - (place & 63)).astype(np.uint64)) & np.uint64(1)).astype(np.int64)

    place = np.zeros(len(texts), np.int64)  # a node has the number of the row that it came with
    children = np.zeros((len(texts), 2), np.int64)
    below = np.zeros(len(texts), np.int64)
    leaf = np.arange(len(texts))
    by_size = np.argsort(-sizes, kind="stable")
    first, left = starts[by_size], sizes[by_size]
    root = ~first
    for turn in range(1, int(left[0]) if len(left) else 0):
        active = int(np.searchsorted(-left, -turn))
        rows, node = first[:active] + turn, root[:active].copy()
        inner = np.flatnonzero(node >= 0)
        while len(inner):
            at = node[inner]
            node[inner] = children[at, bit(rows[inner], place[at])]
            inner = inner[node[inner] >= 0]
        differs = texts[rows] ^ texts[~node]
        word = (differs != 0).argmax(axis=1)
        value = differs[np.arange(active), word]
        leaf[rows] = ~node
        new = np.flatnonzero(value)
        rows, word, value = rows[new], word[new], value[new]
        high = value >> np.uint64(32)
        # 32-bit numbers are exact as floats, whose exponent tells the highest bit.
        split = word * 64 + np.where(high > 0, 32, 64) - np.frexp(np.where(high > 0, high, value).astype(np.float64))[1]
        leaf[rows] = rows
        node, above, side = root[new], np.full(len(new), -1), np.zeros(len(new), np.int64)
        inner = np.flatnonzero((node >= 0) & (place[node] < split))
        while len(inner):
            at = node[inner]
            below[at] += 1
            above[inner], side[inner] = at, bit(rows[inner], place[at])
            node[inner] = children[at, side[inner]]
            inner = inner[(node[inner] >= 0) & (place[node[inner]] < split[inner])]
        own = bit(rows, split)
        place[rows] = split
        children[rows, own], children[rows, 1 - own] = ~rows, node
        below[rows] = np.where(node >= 0, below[node], 1) + 1
        top = above < 0
        root[new[top]] = rows[top]
        children[above[~top], side[~top]] = rows[~top]
    # From the roots down, every node's leaves follow those to its left.
    rank = np.zeros(len(texts), np.int64)
    node, before = root, first.copy()
    while len(node):
        ends = node < 0
        rank[~node[ends]] = before[ends]
        node, before = node[~ends], before[~ends]
        low, high = children[node].T
        node, before = np.r_[low, high], np.r_[before, before + np.where(low >= 0, below[low], 1)]
    return rank[leaf]


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The documents in blocks of whole rows, written once in buckets of block numbers."""
    taken = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            ids = column(batch, "id").fill_null(NO_ID).to_numpy()
            data, offsets = flat_text(column(batch, "text"))
            for first, last in steps(offsets, BLOCK_BYTES):
                part = offsets[first : last + 1]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([number]),
                        "ids": pa.array([ids[first:last].astype("<i8").tobytes()]),
                        "offsets": pa.array([(part - part[0]).astype("<i8").tobytes()]),
                        "data": pa.array([data[part[0] : part[-1]].tobytes()]),
                    }
                )
                number += 1

    return _bucketed(taken.mapInArrow(work, "block long, ids binary, offsets binary, data binary"), "text_blocks")


def _bucketed(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` in buckets of block numbers: tables so written join by block without an exchange."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(partitions_for(df), "block").option("compression", "zstd")
    writer.option("path", scratch_path(spark, label.replace("_", "-"))).saveAsTable(name)
    return spark.table(name)


def _open(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(column(batch, c)[k].as_buffer(), t) for c, t in (("data", np.uint8), ("offsets", "<i8"), ("ids", "<i8")))


def _answers(table: DataFrame, name: str) -> DataFrame:
    """All answers to a block in the order of the ranges; their size follows the block's."""
    return table.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "data"))).alias(name))


def _joined(answers: list[dict] | None) -> bytes:
    return b"".join(a["data"] for a in answers or [])


def _slices(keys: np.ndarray, borders: np.ndarray) -> list[tuple[int, slice]]:
    """The ranges that some of the sorted keys lie in, with their part of the keys.

    Ranges without a key of the block get no record, so records never outnumber keys.
    """
    cuts = np.r_[0, np.searchsorted(keys, borders), len(keys)].tolist()
    return [(r, slice(a, b)) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _ranges(count: int, least: int, most: int) -> np.ndarray:
    """Borders that cut the hashes into about ``count / most`` even ranges."""
    ranges = max(1, -(-count // most), min(least, count // 5000))
    return np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)


class _Candidates:
    """What a block knows of its stretches once it has learned which anchors are shared."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, shared: bytes) -> None:
        keys, anchor, first, last, rows = stretches(data, offsets)
        known, place = np.unique(keys, return_inverse=True)
        bits = np.unpackbits(np.frombuffer(shared, np.uint8), bitorder="little")[: len(known)].astype(bool) if len(known) else np.empty(0, bool)
        taken = np.flatnonzero(bits[place]) if len(known) else np.empty(0, np.int64)
        # Equal stretches of a block are sent once, with their smallest document.
        self.first, self.last, self.rows = first[taken], last[taken], rows[taken]
        seen: dict[tuple, int] = {}
        body = data.tobytes()
        self.number = np.empty(len(taken), np.int64)
        texts, found_keys, before, owner, leads = [], [], [], [], []
        for k, (key, a, f, t, row) in enumerate(zip(keys[taken].tolist(), anchor[taken].tolist(), self.first.tolist(), self.last.tolist(), self.rows.tolist())):
            text = body[f : t + LENGTH]
            entry = seen.setdefault((key, a - f, text), len(texts))
            if entry == len(texts):
                texts.append(text)
                found_keys.append(key)
                before.append(a - f)
                owner.append(ids[row])
                leads.append(f)
            elif ids[row] < owner[entry]:
                owner[entry] = ids[row]
            self.number[k] = entry
        # In the order of the keys, so that each range of keys is one slice.
        self.keys = np.array(found_keys, np.uint64)
        order = np.argsort(self.keys, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number, self.keys = rank[self.number], self.keys[order]
        self.before, self.owner, self.leads = np.array(before, "<u1")[order], np.array(owner, "<i8")[order], np.array(leads, "<i4")[order]
        self.lengths = np.array([len(t) for t in texts], "<u1")[order]


def smallest_owners(keys: np.ndarray, before: np.ndarray, owner: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every stretch the smallest owner of an equal window, and windows per stretch."""
    windows = np.array([len(t) - LENGTH + 1 for t in texts], np.int64)
    # Equal stretches are one.
    seen: dict[tuple, int] = {}
    number = np.array([seen.setdefault(k, len(seen)) for k in zip(keys.tolist(), before.tolist(), texts)], np.int64)
    least = np.full(len(seen), NO_ID, np.int64)
    np.minimum.at(least, number, owner)
    chosen = np.unique(number, return_index=True)[1]
    # An anchor with one stretch needs no sorting: all its windows have the same owners.
    own_keys = keys[chosen]
    _, kind, times = np.unique(own_keys, return_inverse=True, return_counts=True)
    several = np.flatnonzero(times[kind] > 1)
    count = windows[chosen]
    cuts = np.cumsum(count) - count
    answer = np.repeat(least, count)
    if len(several):
        text = np.frombuffer(b"".join(texts[chosen[k]] for k in several.tolist()), np.uint8)
        sizes = count[several] + LENGTH - 1
        begin = np.cumsum(sizes) - sizes
        inner = np.arange(int(count[several].sum())) - np.repeat(np.cumsum(count[several]) - count[several], count[several])
        places = np.repeat(begin, count[several]) + inner
        target = np.repeat(cuts[several], count[several]) + inner
        # Equal windows have their anchor at the same place.
        spot = before[chosen[several]].astype(np.int64)
        groups = np.repeat(kind[several] * LENGTH + spot, count[several]) - inner
        order, group = sort_windows(text, places, groups)
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        best = np.minimum.reduceat(answer[target[order]], starts)
        answer[target[order]] = np.repeat(best, np.diff(np.r_[starts, len(group)]))
    spread = np.repeat(cuts[number], windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    return answer[spread], windows


def _shared_anchors(blocks: DataFrame, partitions: int) -> DataFrame:
    """Per block and range of hashes one bit per distinct anchor: several documents have it."""
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    borders = _ranges(2 * size // _SPREAD, partitions, RANGE_ANCHORS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, offsets, ids = _open(batch, k)
                keys, _, _, _, rows = stretches(data, offsets)
                known, place = np.unique(keys, return_inverse=True)
                parts = _slices(known, borders)
                low, high = np.full(len(known), NO_ID, np.int64), np.full(len(known), np.iinfo(np.int64).min, np.int64)
                np.minimum.at(low, place, ids[rows])
                np.maximum.at(high, place, ids[rows])
                yield pa.RecordBatch.from_pydict(
                    {
                        "range": pa.array([r for r, _ in parts], pa.int64()),
                        "block": pa.array([column(batch, "block")[k].as_py()] * len(parts), pa.int64()),
                        "keys": pa.array([known[p].tobytes() for _, p in parts], pa.binary()),
                        "several": pa.array([np.packbits(low[p] != high[p], bitorder="little").tobytes() for _, p in parts], pa.binary()),
                    }
                )

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(v.as_buffer(), "<u8") for v in table.column("keys")]
        flags = [
            np.unpackbits(np.frombuffer(v.as_buffer(), np.uint8), bitorder="little")[: len(k)] for v, k in zip(table.column("several"), keys)
        ]
        known, place, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = times > 1
        np.logical_or.at(shared, place, np.concatenate(flags).astype(bool))
        cuts = np.cumsum([0, *map(len, keys)])
        # Whole bytes of bits per range cannot be joined, so each bit is a byte that compresses well.
        return pa.table(
            {
                "block": table.column("block"), "range": table.column("range"),
                "data": pa.array([shared[place[a:b]].astype(np.uint8).tobytes() for a, b in zip(cuts, cuts[1:])]),
            }
        )

    sent = blocks.mapInArrow(send, "range long, block long, keys binary, several binary")
    return written(sent.groupBy("range").applyInArrow(answer, "block long, range long, data binary"), "shared-anchors")


def _bits(answers: list[dict]) -> bytes:
    return np.packbits(np.frombuffer(_joined(answers), np.uint8), bitorder="little").tobytes()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``spans`` (start, end of the removed bytes) and ``kept``.

    A byte of the UTF-8 text is removed when it is in a string of ``LENGTH`` bytes that a document
    with a smaller id has as well; strings are judged on the input. ``kept`` is what is left, as
    bytes. Null counts as empty; texts shorter than ``LENGTH`` stay as they are; rows with the same
    id, as repeated rows have, do not remove from each other; a missing id is larger than all others. Ids
    that are not whole numbers are compared in their own order. Texts count whole, however long; other
    columns are not read, so their names cannot clash; an empty table gives an empty result.
    """
    if docs.schema[id_col].dataType.simpleString() not in WHOLE_NUMBERS:
        numbers = ordered_numbers(docs, id_col, "document-numbers")
        taken = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
        found = remove_repeats(taken.join(numbers, "id", "left").select("number", "text"), "number", "text")
        return found.join(numbers, "number", "left").select(F.col("id").alias(id_col), "n_bytes", "spans", "kept")
    ship_code(docs.sparkSession)
    blocks, partitions = _blocks(docs, id_col, text_col), partitions_for(docs)
    shared = _answers(_shared_anchors(blocks, partitions), "shared")
    # About one byte in sixteen leads a stretch, and a stretch is some 66 bytes.
    size = blocks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    borders = _ranges(size // _SPREAD, partitions, RANGE_STRETCHES)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = _Candidates(*_open(batch, k), _bits(column(batch, "shared")[k].as_py()))
                parts = {
                    "first": found.first.astype("<i4"), "last": found.last.astype("<i4"), "rows": found.rows.astype("<i4"),
                    "number": found.number.astype("<i4"), "keys": found.keys, "before": found.before, "owner": found.owner,
                    "leads": found.leads, "lengths": found.lengths,
                }
                values = {name: pa.array([part.tobytes()], pa.binary()) for name, part in parts.items()}
                yield pa.RecordBatch.from_pydict({"block": column(batch, "block").slice(k, 1), **values})

    # Found once; what is sent and what is cut in the end both read it.
    names = ["first", "last", "rows", "number", "keys", "before", "owner", "leads", "lengths"]
    schema = "block long, " + ", ".join(f"`{n}` binary" for n in names)
    found = _bucketed(blocks.join(shared, "block", "left").mapInArrow(find, schema), "stretches")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = {n: np.frombuffer(column(batch, n)[k].as_buffer(), kind) for n, kind in (("keys", "<u8"), ("before", "<u1"), ("owner", "<i8"), ("leads", "<i4"), ("lengths", "<u1"))}
                body = column(batch, "data")[k].as_py()
                texts = [body[f : f + n] for f, n in zip(part["leads"].tolist(), part["lengths"].tolist())]
                parts = _slices(part["keys"], borders)
                yield pa.RecordBatch.from_pydict(
                    {
                        "range": pa.array([r for r, _ in parts], pa.int64()),
                        "block": pa.array([column(batch, "block")[k].as_py()] * len(parts), pa.int64()),
                        **{n: pa.array([part[n][p].tobytes() for _, p in parts], pa.binary()) for n in ("keys", "before", "owner", "lengths")},
                        "texts": pa.array([b"".join(texts[p]) for _, p in parts], pa.binary()),
                    }
                )

    def answer(table: pa.Table) -> pa.Table:
        def flat(name: str, kind: str) -> list[np.ndarray]:
            return [np.frombuffer(v.as_buffer(), kind) for v in table.column(name)]

        keys, lengths = flat("keys", "<u8"), flat("lengths", "<u1")
        body = b"".join(v.as_py() for v in table.column("texts"))
        size = np.concatenate(lengths).astype(np.int64)
        ends = np.cumsum(size)
        texts = [body[b - n : b] for b, n in zip(ends.tolist(), size.tolist())]
        least, windows = smallest_owners(np.concatenate(keys), np.concatenate(flat("before", "<u1")), np.concatenate(flat("owner", "<i8")), texts)
        cuts = np.cumsum([0, *map(len, keys)])
        at = np.r_[0, np.cumsum(windows)][cuts]
        return pa.table(
            {
                "block": table.column("block"), "range": table.column("range"),
                "data": pa.array([_runs(least[a:b]) for a, b in zip(at, at[1:])]),
            }
        )

    sent = blocks.select("block", "data").join(found.select("block", "keys", "before", "owner", "leads", "lengths"), "block").mapInArrow(
        send, "range long, block long, keys binary, before binary, owner binary, lengths binary, texts binary"
    )
    least = written(sent.groupBy("range").applyInArrow(answer, "block long, range long, data binary"), "smallest-owners")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, offsets, ids = _open(batch, k)
                told = [_unruns(a["data"]) for a in column(batch, "least")[k].as_py() or []]
                taken = {n: np.frombuffer(column(batch, n)[k].as_buffer(), kind).astype(np.int64) for n, kind in (("first", "<i4"), ("last", "<i4"), ("rows", "<i4"), ("number", "<i4"), ("lengths", "<u1"))}
                removed = _removed(len(data), ids, taken, np.concatenate(told) if told else np.empty(0, np.int64))
                rows = [_spans(removed[a:b]) for a, b in zip(offsets, offsets[1:])]
                kept = [data[a:b][~removed[a:b]].tobytes() for a, b in zip(offsets, offsets[1:])]
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()),
                        pa.array(np.diff(offsets)), pa.array(rows, kind), pa.array(kept, pa.binary()),
                    ],
                    names=["id", "n_bytes", "spans", "kept"],
                )

    told = blocks.join(found.select("block", "first", "last", "rows", "number", "lengths"), "block").join(_answers(least, "least"), "block", "left")
    out = told.mapInArrow(cut, "id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def _runs(values: np.ndarray) -> bytes:
    """Run lengths and values, as one array of 64-bit numbers."""
    if not len(values):
        return b""
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    return np.stack([np.diff(np.r_[starts, len(values)]), values[starts]]).astype("<i8").tobytes()


def _unruns(data: bytes) -> np.ndarray:
    lengths, values = np.frombuffer(data, "<i8").reshape(2, -1)
    return np.repeat(values, lengths)


def _removed(size: int, ids: np.ndarray, taken: dict[str, np.ndarray], least: np.ndarray) -> np.ndarray:
    """Which bytes of a block are in a window that a smaller document has."""
    count, windows = taken["last"] - taken["first"] + 1, taken["lengths"] - LENGTH + 1
    begin = np.cumsum(windows) - windows
    inner = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    smallest = least[np.repeat(begin[taken["number"]], count) + inner] if len(count) else np.empty(0, np.int64)
    place = np.repeat(taken["first"], count) + inner
    place = place[smallest < np.repeat(ids[taken["rows"]], count)]
    begun = np.bincount(place, minlength=size + LENGTH)
    begun[LENGTH:] -= begun[:-LENGTH].copy()
    return np.cumsum(begun[:size]) > 0


def _spans(removed: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.r_[False, removed, False].astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of what :func:`remove_repeats` returns."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
