from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import edge
from wardstat.llm import packing


def reference_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_tokenizer(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts += ["", " ", "a  b", "a\tb c", " lead", "trail ", "x\ny z", "x \n y", "a b c", "a　b", "don't we'll 12 34"]
    # The strings of special tokens at the start, in the middle and at the end.
    texts += ["<|endoftext|> x", "a<|endoftext|>b", "a <|endoftext|> b c", "x <|endoftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "<|endoftext"]
    for tokens in (packing.tokens(), packing.tokens(public_tokenizers.path("byte_bpe_50k.json"))):
        assert [np.frombuffer(tokens.ids(t), "<u4").tolist() for t in texts] == reference_ids(texts)
    assert 50256 in np.frombuffer(packing.tokens().ids("a <|endoftext|>"), "<u4")


def test_every_piece_is_packed_once_without_gaps(spark):
    rows = [(i, t) for i, t in edge.ROWS] + [(100 + k, "many words " * (k * 37 % 300)) for k in range(400)]
    df = edge.table(spark, rows)
    found = packing.pack(df, task_pieces=60).collect()
    ids = [np.array([*i, 2], "<u4") for i in reference_ids([t or "" for _, t in rows])]
    want = []
    for (doc, _), tokens in zip(rows, ids):
        first, at, number = len(tokens) % 1024 or min(len(tokens), 1024), 0, 0
        while at < len(tokens):
            size = 1024 if number else first
            want.append((doc, number, at, size, zlib.crc32(tokens[at : at + size].tobytes())))
            at, number = at + size, number + 1
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(want, key=key)
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    # What is not certified is what the last exchange left; partitions never beat their bounds.
    assert all(r.partition_bins >= r.partition_bound for r in found)
    full = {k for k, parts in sequences.items() if sum(n for _, n in parts) == 1024}
    assert all(r.certified == (r.partition_bins == r.partition_bound or r.sequence_id in full) for r in found)
    total = sum(len(i) for i in ids)
    assert len(sequences) <= 1.02 * total / 1024 + 1
    assert packing.pack(edge.empty(spark)).count() == 0


def plain_best_fit_decreasing(lengths, capacity):
    """Longest first, each into the fullest bin that takes it, found by looking at all bins."""
    fills = []
    for size in sorted(lengths, reverse=True):
        fitting = [k for k, fill in enumerate(fills) if fill + size <= capacity]
        if fitting:
            best = max(fitting, key=lambda k: fills[k])
            fills[best] += size
        else:
            fills.append(size)
    return sorted(fills)


def test_best_fit_decreasing_equals_a_plain_one():
    rng = np.random.default_rng(8)
    for high in (40, 200, 600, 1023):
        for n in (0, 1, 7, 150):
            lengths = rng.integers(1, high, n)
            bins, offsets, fills = packing.best_fit_decreasing(lengths)
            assert sorted(fills.tolist()) == plain_best_fit_decreasing(lengths.tolist(), 1024)
            for b in range(len(fills)):
                inside = sorted(zip(offsets[bins == b].tolist(), lengths[bins == b].tolist()))
                assert [o for o, _ in inside] == np.cumsum([0] + [n for _, n in inside])[:-1].tolist()


def test_exchanges_certify(spark):
    rows = [(k, "many words " * (k * 37 % 300 + 1)) for k in range(500)]
    found = packing.pack(edge.table(spark, rows), task_pieces=40).collect()
    assert len({r.sequence_id for r in found if r.certified}) / len({r.sequence_id for r in found}) > 0.5
    assert max(r.round for r in found) > 1


def test_lower_bound_is_never_above_a_packing():
    rng = np.random.default_rng(4)
    for high in (60, 300, 700, 1024):
        for _ in range(20):
            lengths = rng.integers(1, high, 200)
            bins, offsets, fills = packing.best_fit_decreasing(lengths)
            assert packing.lower_bound(lengths) <= len(fills)
            assert fills.max() <= 1024 and fills.sum() == lengths.sum()
    # Items above half need a bin each, which the sum of the lengths does not show.
    assert packing.lower_bound(np.full(10, 513)) == 10
    assert packing.lower_bound(np.full(9, 342)) == 5
    assert packing.lower_bound(np.array([], np.int64)) == 0
