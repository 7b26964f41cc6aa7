"""Best-fit packing of tokenised documents with certified bin counts.

Documents are cut into pieces; only their lengths matter for packing. Every partition packs its
pieces by best fit decreasing and compares its number of bins with a lower bound from dual
feasible functions. A partition that meets its bound is done: its bins are as few as they can be.
From the others, well-filled bins are kept and the pieces of the rest are exchanged: they meet in
fewer partitions and are packed again, until all partitions are certified or one is left.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import column, written
from wardstat.session import ship_code

CAPACITY = 1024
#: Id that ends every document.
END_ID = 2
#: Pieces that one packing task takes.
PIECES = 8_000
#: Exchanges at most; what is open after the last one stays as best fit decreasing left it.
ROUNDS = 6
#: Words whose ids a worker remembers.
REMEMBERED = 400_000

# A sequence's number holds the exchange, the partition and the bin.
_TURN_BITS, _BIN_BITS = 56, 24


class Tokens:
    """Ids of texts by a byte-level vocabulary, as little-endian unsigned 32-bit bytes.

    The ids are those of the tokenizer file at ``path``, without special tokens added around a text.
    Where a text holds the string of a special token, the tokenizer itself encodes it. All other texts
    go by the rank file of the same vocabulary, which is faster: its pattern cuts before a single space
    that stands between two visible characters, and cuts never depend on more, so the parts between
    such spaces can be looked up by themselves. Texts with other white space than single spaces and
    line ends inside words go through as a whole. Without a rank file the tokenizer does all.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str = "") -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.encode = None
        if ranks_path is not None:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.other_space = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
        self.known: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return np.asarray(self.encode(text), "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if self.encode is None or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        runs = "  " in text or " \n" in text or "\n " in text or "\n\n" in text
        if runs or text[:1] in " \n" or text[-1:] in " \n" or self.other_space(text):
            return self._bytes(text)
        first, *rest = text.split(" ")
        known, out = self.known, [self._bytes(first)]
        for word in rest:
            ids = known.get(word)
            if ids is None:
                ids = self._bytes(" " + word)
                if len(known) < REMEMBERED:
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


def tokens(vocabulary: str | None = None) -> Tokens:
    """The tokenizer file at ``vocabulary``; by default the public 50k vocabulary with its rank file."""
    import public_tokenizers

    if vocabulary is not None:
        return Tokens(vocabulary)
    return Tokens(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    vocabulary: str | None = None,
) -> DataFrame:
    """Token pieces of every row: ``id, piece, start, length, ids_crc32``.

    A row longer than ``capacity`` ids is cut into full pieces; what is left over comes first. Null
    counts as empty, and an empty text is the end id alone. Each of repeated rows gives its pieces.
    """
    ship_code(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows, numbers, starts, lengths, sums = [], [], [], [], []
            for k, text in enumerate(column(batch, "text")):
                ids = encoder.ids(text.as_py() or "") + end
                count = len(ids) // 4
                first = count % capacity or min(count, capacity)
                at, number = 0, 0
                while at < count:
                    size = first if number == 0 else capacity
                    rows.append(k)
                    numbers.append(number)
                    starts.append(at)
                    lengths.append(size)
                    sums.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    at += size
                    number += 1
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "id").take(pa.array(rows, pa.int32())),
                    pa.array(numbers, pa.int32()),
                    pa.array(starts, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    taken = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return taken.mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """No packing has fewer bins: the largest bound over a family of dual feasible functions.

    For each threshold k, lengths above ``capacity - k`` count as a whole bin, lengths below k as
    nothing, those between as themselves; and for each whole q, a length x counts as
    floor((q + 1) x / capacity) / q, or as x / capacity where (q + 1) x / capacity is whole.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * sizes).sum()) // capacity)
    number, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    for k in range(1, capacity // 2 + 1):
        whole = int(number[-1] - number[capacity - k])
        between = int(weight[capacity - k] - weight[k - 1])
        best = max(best, whole + -(-between // capacity))
    for q in range(1, 101):
        scaled = (q + 1) * sizes
        exact = scaled % capacity == 0
        # In units of 1 / (q * capacity), so that all is whole.
        value = np.where(exact, sizes * q, (scaled // capacity) * capacity)
        best = max(best, -(-int((counts * value).sum()) // (q * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin.

    Pieces go, longest first, into the open bin that they leave the least room in. Bins are kept by
    room; a bit per room that some bin has makes the search one shift.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for k, size in zip(order.tolist(), lengths[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            number = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            number, room, opened = opened, capacity, opened + 1
        bins[k], offsets[k] = number, capacity - room
        left = room - size
        by_room[left].append(number)
        if left:
            rooms |= 1 << left
    return bins, offsets, np.bincount(bins, lengths, opened).astype(np.int64)


def _settler(turn: int, last: bool, capacity: int) -> Callable[[pa.Table], pa.Table]:
    """Packs one partition and says which of its bins are settled."""

    def settle(table: pa.Table) -> pa.Table:
        sizes = table.column("length").to_numpy()
        bins, offsets, fills = best_fit_decreasing(sizes, capacity)
        bound = lower_bound(sizes, capacity)
        # A full bin is as good as can be; the others are if the partition has no more than it needs.
        certified = (fills == capacity) | (len(fills) == bound)
        done = certified | last
        base = (turn << _TURN_BITS) | (table.column("part")[0].as_py() << _BIN_BITS)
        added = {
            "sequence_id": base + bins, "offset": offsets, "round": np.full(len(bins), turn, np.int32), "certified": certified[bins],
            "partition_bins": np.full(len(bins), len(fills)), "partition_bound": np.full(len(bins), bound), "settled": done[bins],
        }
        out = table.select(["id", "piece", "start", "length", "ids_crc32"])
        for name, values in added.items():
            out = out.append_column(name, pa.array(values))
        return out

    return settle


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
    task_pieces: int = PIECES, vocabulary: str | None = None,
) -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` tokens.

    Returns per piece ``id_col, piece, start, length, ids_crc32, sequence_id, offset`` and the
    certificate of its place: ``round``, the exchange in which it was placed, ``partition_bins`` and
    ``partition_bound``, how many bins its partition used then and the least that any packing needs,
    and ``certified``, whether the two are equal or its sequence is full. Only pieces that
    ``ROUNDS`` exchanges did not bring into a certified partition are not certified. Every piece is placed once; a sequence has no
    gap. Null and empty texts are one end token; repeated rows are packed like others; an empty
    table gives an empty result. Columns other than the two named are not read.
    """
    cut = written(pieces(docs, id_col, text_col, capacity, end_id, vocabulary), "pieces")
    id_type = cut.schema["id"].dataType.simpleString()
    named = "piece int, start long, length long, ids_crc32 long, sequence_id long, `offset` long, `round` int, certified boolean, partition_bins long, partition_bound long, settled boolean"
    # Full pieces fill a sequence each and take no part in the packing.
    full = cut.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(0).alias("round"),
        F.lit(True).alias("certified"), F.lit(1).cast("long").alias("partition_bins"), F.lit(1).cast("long").alias("partition_bound"),
    )
    pool = cut.where(F.col("length") < capacity)
    left, turn, placed = pool.count(), 1, []
    while left:
        parts = max(1, -(-left // task_pieces))
        last = parts == 1 or turn == ROUNDS

        dealt = F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(turn)), F.lit(parts))
        result = written(
            pool.withColumn("part", dealt.cast("long")).groupBy("part").applyInArrow(_settler(turn, last, capacity), f"id {id_type}, {named}"),
            "packed",
        )
        placed.append(result.where("settled").drop("settled"))
        pool = result.where("not settled").select("id", "piece", "start", "length", "ids_crc32")
        left, turn = pool.count(), turn + 1
    out = full
    for part in placed:
        out = out.unionByName(part)
    return out.withColumnRenamed("id", id_col)
