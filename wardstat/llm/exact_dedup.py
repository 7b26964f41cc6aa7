"""Exact deduplication by Grace hashing.

Every task of a scan first collapses its own copies, so a group of copies reaches the exchange
once per task (or per ``COLLAPSE_BYTES``), however many rows it has. The exchange brings equal contents together; there each
task runs a Grace hash: records enter an open-addressing table that compares complete contents,
and when its contents exceed the memory given, they are partitioned by further hash bits into
spill files that are worked off one by one.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wardstat.llm.common import column, partitions_for, schema_of, whole_rows, written
from wardstat.session import ship_code

#: Contents, in bytes, that one table may hold before its bucket is partitioned further.
TABLE_BYTES = 64 << 20
#: Spill files per partitioning step.
FAN_OUT = 16
#: Bytes of rows that collapse together: all of a task's, where it reads a split of the usual size.
COLLAPSE_BYTES = 128 << 20

_SPACES = b" \t\n\x0b\x0c\r"


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text without ASCII white space; null counts as empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACES)


class ContentTable:
    """Open addressing with linear probing; equality is equality of complete contents."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.states: list = []
        self.bytes = 0

    def find(self, digest: bytes, content: bytes) -> int:
        """Number of the entry with this content, which is added where it is missing."""
        mask = len(self.slots) - 1
        place = int.from_bytes(digest[:8], "little") & mask
        while (entry := self.slots[place]) >= 0:
            if self.digests[entry] == digest and self.contents[entry] == content:
                return entry
            place = (place + 1) & mask
        entry = self.slots[place] = len(self.contents)
        self.digests.append(digest)
        self.contents.append(content)
        self.states.append(None)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            place = int.from_bytes(digest[:8], "little") & mask
            while self.slots[place] >= 0:
                place = (place + 1) & mask
            self.slots[place] = entry


# A record is (digest, content, members, best, size): the candidates it stands for, the row to
# keep as (-code points, id is null, id, part, slot), and the rows it counts.
def _absorb(table: ContentTable, record: tuple) -> None:
    digest, content, members, best, size = record
    entry = table.find(digest, content)
    state = table.states[entry]
    if state is None:
        table.states[entry] = [list(members), best, size]
    else:
        state[0].extend(members)
        state[1] = min(state[1], best)
        state[2] += size


def grace(records: Iterable[tuple], table_bytes: int, fan_out: int, depth: int = 0) -> Iterator[list]:
    """Groups of equal content as [members, best, size]; at most one table is in memory."""
    table, spill = ContentTable(), None
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for record in records:
            if spill is None:
                _absorb(table, record)
                # Each level uses four bits of the 32-byte digest after those that probe the table.
                if table.bytes > table_bytes and len(table.contents) > 1 and depth < 40:
                    spill = [open(os.path.join(folder, str(k)), "w+b") for k in range(fan_out)]
                    for digest, content, state in zip(table.digests, table.contents, table.states):
                        _spill(spill, depth, (digest, content, *state))
                    table = ContentTable()
            else:
                _spill(spill, depth, record)
        if spill is None:
            yield from table.states
            return
        for file in spill:
            file.seek(0)
            yield from grace(_unspill(file), table_bytes, fan_out, depth + 1)
            file.close()


def _spill(files: list, depth: int, record: tuple) -> None:
    level = hashlib.blake2b(record[0], digest_size=8, salt=depth.to_bytes(8, "little")).digest()
    pickle.dump(record, files[int.from_bytes(level, "little") % len(files)])


def _unspill(file) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def exact_dedup_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    table_bytes: int = TABLE_BYTES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Every row of ``docs`` with what became of it.

    Returns struct ``row`` (the row's own columns, under their own names), ``keep_id``,
    ``group_size``, ``kept`` and ``text_sha256``. Texts are equal when they are after deleting
    ASCII white space; null counts as empty, and all empty texts are one group. The row with the
    most code points stays, then the one with the smallest id (null ids last), then one of them:
    of wholly equal rows exactly one stays. Texts are compared whole, however long, and other columns
    stay inside ``row``, so their names cannot clash. An empty table gives an empty result.
    """
    ship_code(docs.sparkSession)
    packed = whole_rows(docs)
    id_place, text_place = docs.columns.index(id_col), docs.columns.index(text_col)
    id_arrow = to_arrow_type(docs.schema[id_col].dataType)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, slot, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= COLLAPSE_BYTES:
                yield from together(held, part, slot)
                slot, held, size = slot + sum(b.num_rows for b in held), [], 0
        yield from together(held, part, slot)

    def together(held: list[pa.RecordBatch], part: int, slot: int) -> Iterator[pa.RecordBatch]:
        """The rows of several batches with the row that stands for each; only those carry a count."""
        table, found = ContentTable(), []
        for batch in held:
            text_column, id_column = pc.struct_field(batch.column(0), [text_place]), pc.struct_field(batch.column(0), [id_place])
            ids, points = id_column.to_pylist(), pc.fill_null(pc.utf8_length(text_column), 0).to_pylist()
            entries, hexes = [], []
            for k, text in enumerate(text_column.to_pylist()):
                content = normalised(text)
                digest = hashlib.sha256(content).digest()
                entry = table.find(digest, content)
                best = (-points[k], ids[k] is None, 0 if ids[k] is None else ids[k], slot + k)
                state = table.states[entry]
                if state is None:
                    table.states[entry] = [best, 1]
                else:
                    state[0] = min(state[0], best)
                    state[1] += 1
                entries.append(entry)
                hexes.append(digest.hex())
            found.append((batch, id_column, points, entries, hexes, slot))
            slot += batch.num_rows
        chosen = [state[0][3] for state in table.states]
        sizes = {state[0][3]: state[1] for state in table.states}
        for batch, id_column, points, entries, hexes, begin in found:
            slots = range(begin, begin + batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    id_column,
                    pa.array([part] * len(slots), pa.int64()),
                    pa.array(slots, pa.int64()),
                    pa.array([chosen[e] for e in entries], pa.int64()),
                    pa.array([sizes.get(k, 0) for k in slots], pa.int64()),
                    pa.array(points, pa.int64()),
                    pa.array(hexes, pa.string()),
                ],
                names=["row", "id", "part", "slot", "local", "rows", "points", "text_sha256"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    first = written(
        packed.mapInArrow(
            collapse,
            schema_of(
                packed.schema["row"],
                f"id {id_type}, part long, slot long, local long, rows long, points long, text_sha256 string",
            ),
        ),
        "exact-rows",
    )

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for batch in batches:
                columns = [column(batch, c).to_pylist() for c in ("text", "id", "part", "slot", "rows", "points", "text_sha256")]
                for text, ident, part, slot, rows, points, digest in zip(*columns):
                    best = (-points, ident is None, 0 if ident is None else ident, part, slot)
                    yield bytes.fromhex(digest), normalised(text), [(part, slot)], best, rows

        out: list[tuple] = []
        for members, best, size in grace(records(), table_bytes, fan_out):
            keep = None if best[1] else best[2]
            for part, slot in members:
                out.append((part, slot, best[3], best[4], keep, size))
                if len(out) == 20_000:
                    yield _mapping(out)
                    out = []
        if out:
            yield _mapping(out)

    names = ["part", "local", "keep_part", "keep_slot", "keep_id", "group_size"]

    def _mapping(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c)) if i != 4 else pa.array(list(c), id_arrow) for i, c in enumerate(zip(*rows))], names=names)

    candidates = first.where("rows > 0").select(
        F.col("row")[text_col].alias("text"), "id", "part", "slot", "rows", "points", "text_sha256"
    )
    mapping = candidates.repartition(partitions_for(docs), "text_sha256").mapInArrow(
        resolve, f"part long, local long, keep_part long, keep_slot long, keep_id {id_type}, group_size long"
    )
    return first.select("row", "part", "slot", "local", "text_sha256").join(mapping, ["part", "local"]).select(
        "row",
        "keep_id",
        "group_size",
        ((F.col("part") == F.col("keep_part")) & (F.col("slot") == F.col("keep_slot"))).alias("kept"),
        "text_sha256",
    )


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    return exact_dedup_rows(docs, id_col, text_col).where("kept").select("row.*")
