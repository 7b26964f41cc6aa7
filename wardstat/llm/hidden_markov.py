"""A hidden Markov language model over token classes, with exact token counts.

Documents are kept in blocks of bounded size, as token numbers within the block. The distinct
tokens of a block, sorted by hash, are cut into ranges of the hash; a task per range adds up the
counts of all blocks and answers every block with the totals of its tokens. So the only exchanges
carry distinct tokens per block, never text.

A token belongs to a class: frequent tokens to one of their own, others to that of their ending,
unseen ones to one more. States emit classes, and a class emits its tokens by their smoothed
counts. Baum-Welch runs over all training documents, with expected counts summed over partitions;
the scaled forward recursion then gives the exact likelihood of every whole text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import LOWER, NOT_SPACE, column, flat_text, partitions_for, schema_of, span_hashes, steps, word_spans, written
from wardstat.operators.passes import summed_arrays
from wardstat.session import ship_code

#: Bytes of text in a block, and distinct tokens (of all blocks) that one counting task takes.
BLOCK_BYTES, RANGE_TOKENS = 6 << 20, 1_000_000
#: Tokens whose forward values a task holds at a time, unless one block has more.
TOGETHER = 2_000_000
#: Classes by ending, frequent tokens with a class of their own, states, and Baum-Welch passes.
ENDINGS, FREQUENT, STATES, PASSES = 1024, 1000, 8, 6
#: Bytes of an ending.
ENDING_BYTES = 3
#: Weight of the overall class shares in a state's emissions, and of each transition.
EMISSION_PRIOR, TRANSITION_PRIOR = 20.0, 0.5
#: The hash that stands for the end of a text.
END = np.uint64(0)


def tokenise(body: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes in text order with the end of each row, class of the ending, and tokens per row."""
    lowered = LOWER[body]
    starts, ends, rows = word_spans(lowered, part, NOT_SPACE)
    hashes = np.maximum(span_hashes(lowered, starts, ends), np.uint64(1))
    endings = span_hashes(lowered, np.maximum(starts, ends - ENDING_BYTES), ends, salt=9) % np.uint64(ENDINGS)
    count = len(part) - 1
    lengths = np.bincount(rows, minlength=count) + 1
    last = np.cumsum(lengths) - 1
    every = np.full(int(lengths.sum()), END, np.uint64)
    classes = np.zeros(len(every), np.uint16)
    inner = np.ones(len(every), bool)
    inner[last] = False
    every[inner], classes[inner] = hashes, endings
    return every, classes, lengths


def _numbered(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in ascending order, the place of the first of each, and the number of every value."""
    encoded = pa.array(tokens).dictionary_encode()
    found, keys = encoded.indices.to_numpy(), encoded.dictionary.to_numpy()
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    # Numbers are given in order of appearance, so a value is new where its number is the largest yet.
    first = np.flatnonzero(np.diff(np.maximum.accumulate(found), prepend=-1)) if len(found) else np.empty(0, np.int64)
    return keys[order], first[order], rank[found]


def _blocks(docs: DataFrame, id_col: str, text_col: str, training: Column) -> DataFrame:
    """Blocks of documents: per document its id, role and length; tokens as places in ``keys``."""
    taken = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), training.alias("train"))
    id_field = taken.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for batch in batches:
            train = np.array(column(batch, "train").to_pylist(), bool)
            data, offsets = flat_text(column(batch, "text"))
            for first, last in steps(offsets, BLOCK_BYTES):
                part = offsets[first : last + 1]
                every, classes, lengths = tokenise(data[part[0] : part[-1]], part - part[0])
                keys, where, place = _numbered(every)
                learned = np.repeat(train[first:last], lengths)
                counts = np.bincount(place[learned], minlength=len(keys)).astype("<i4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([number]),
                        "ids": pa.array([column(batch, "id").slice(first, last - first).to_pylist()], pa.list_(column(batch, "id").type)),
                        "train": pa.array([train[first:last].tolist()]),
                        "lengths": pa.array([lengths.astype("<i4").tobytes()]),
                        "tokens": pa.array([place.astype("<i4").tobytes()]),
                        "keys": pa.array([keys.tobytes()]),
                        "counts": pa.array([counts.tobytes()]),
                        "endings": pa.array([classes[where].tobytes()]),
                        "distinct": pa.array([len(keys)]),
                    }
                )
                number += 1

    schema = f"block long, ids array<{id_field}>, train array<boolean>, lengths binary, tokens binary, keys binary, counts binary, endings binary, distinct long"
    return written(taken.mapInArrow(work, schema), "token-blocks")


def _totals(blocks: DataFrame) -> DataFrame:
    """Answers of the counting tasks: totals per block and range, class sums, and frequent tokens.

    Rows with ``block`` -1 carry the class ``range`` with its tokens and their number, rows with -2
    a frequent token; a range sends no more than ``FREQUENT`` of these.
    """
    distinct = blocks.agg(F.sum("distinct")).first()[0] or 0
    ranges = max(1, -(-distinct // RANGE_TOKENS), min(partitions_for(blocks), distinct // (50 * FREQUENT)))
    bounds = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, counts, endings = (np.frombuffer(column(batch, c)[k].as_buffer(), t) for c, t in (("keys", "<u8"), ("counts", "<i4"), ("endings", "<u2")))
                cuts = np.r_[0, np.searchsorted(keys, bounds), len(keys)]
                # Ranges without a token of the block get no record, so records never outnumber tokens.
                held = np.flatnonzero(np.diff(cuts))
                parts = [slice(cuts[r], cuts[r + 1]) for r in held]
                yield pa.RecordBatch.from_pydict(
                    {
                        "range": pa.array(held, pa.int64()),
                        "block": pa.array([column(batch, "block")[k].as_py()] * len(held)),
                        "keys": pa.array([keys[p].tobytes() for p in parts]),
                        "counts": pa.array([counts[p].tobytes() for p in parts]),
                        "endings": pa.array([endings[p].tobytes() for p in parts]),
                    }
                )

    def add(table: pa.Table) -> pa.Table:
        number = table.column("range")[0].as_py()
        names = table.column("block").to_pylist()
        keys = [np.frombuffer(v.as_buffer(), "<u8") for v in table.column("keys")]
        counts = [np.frombuffer(v.as_buffer(), "<i4") for v in table.column("counts")]
        endings = [np.frombuffer(v.as_buffer(), "<u2") for v in table.column("endings")]
        known, where, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(known)).astype("<i8")
        ending = np.concatenate(endings)[where] if len(known) else np.empty(0, np.uint16)
        cuts = np.cumsum([0, *map(len, keys)])
        seen = total > 1
        sums, kinds = np.bincount(ending[seen], total[seen], ENDINGS), np.bincount(ending[seen], minlength=ENDINGS)
        top = np.argsort(-total, kind="stable")[:FREQUENT]
        top = top[total[top] > 1]
        # Class ENDINGS counts the tokens seen once.
        sums, kinds = np.r_[sums, np.sum(total == 1)], np.r_[kinds, np.sum(total == 1)]
        held = np.flatnonzero(kinds)
        return pa.table(
            {
                "block": pa.array([*names, *[-1] * len(held), *[-2] * len(top)], pa.int64()),
                "range": pa.array([*[number] * len(names), *held.tolist(), *ending[top].tolist()], pa.int64()),
                "data": pa.array([*[total[place[a:b]].tobytes() for a, b in zip(cuts, cuts[1:])], *[None] * (len(held) + len(top))], pa.binary()),
                "key": pa.array([*[None] * (len(names) + len(held)), *known[top].view(np.int64).tolist()], pa.int64()),
                "total": pa.array([*[None] * len(names), *sums[held].astype(int).tolist(), *total[top].tolist()], pa.int64()),
                "kinds": pa.array([*[None] * len(names), *kinds[held].tolist(), *[None] * len(top)], pa.int64()),
            }
        )

    dealt = blocks.select("block", "keys", "counts", "endings").mapInArrow(deal, "range long, block long, keys binary, counts binary, endings binary")
    answered = dealt.groupBy("range").applyInArrow(add, "block long, range long, data binary, key long, total long, kinds long")
    return written(answered, "token-totals")


@dataclass
class Classes:
    """Smoothed token shares and class shares of the training tokens."""

    tokens: int
    distinct: int
    frequent: np.ndarray  # sorted hashes with a class of their own
    weights: np.ndarray  # by class: endings, frequent tokens, seen at most once
    once: int  # tokens seen once

    @property
    def whole(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)

    @property
    def shares(self) -> np.ndarray:
        return self.weights / self.weights.sum()

    def inside(self, kinds: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Log10 share of each token in its class; half of the last class is the unseen token."""
        usual = np.log10((totals + 0.5) / np.maximum(self.weights[kinds], 0.5))
        new = np.log10(0.5) if self.once else 0.0
        return np.where(totals > 1, usual, np.where(totals == 1, np.log10(0.5 / max(self.once, 1)), new))

    def of(self, keys: np.ndarray, endings: np.ndarray, totals: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.frequent, keys), max(len(self.frequent) - 1, 0))
        own = self.frequent[place] == keys if len(self.frequent) else np.zeros(len(keys), bool)
        return np.where(totals <= 1, ENDINGS + FREQUENT, np.where(own, ENDINGS + place, endings)).astype("<u2")


def _classes(totals: DataFrame) -> Classes:
    sums = totals.where("block = -1").groupBy("range").agg(F.sum("total"), F.sum("kinds")).collect()
    tops = totals.where("block = -2").orderBy(F.desc("total"), "key").limit(FREQUENT).collect()
    weights, once = np.zeros(ENDINGS + FREQUENT + 1), 0
    for ending, total, kinds in sums:
        if ending == ENDINGS:
            once = int(total)
        else:
            weights[ending] = total + 0.5 * kinds
    frequent = np.array([r["key"] for r in tops], np.int64).view(np.uint64)
    order = np.argsort(frequent)
    for rank, k in enumerate(order):
        weights[ENDINGS + rank] = tops[k]["total"] + 0.5
        weights[tops[k]["range"]] -= tops[k]["total"] + 0.5
    weights[-1] = 1.5 * once + 0.5
    # Differences of sums may leave a trace of rounding where a class lost all of its tokens.
    weights = np.where(weights < 0.25, 0.0, weights)
    tokens, distinct = sum(int(r[1]) for r in sums), sum(int(r[2]) for r in sums)
    return Classes(tokens, distinct, frequent[order], weights, once)


def _sequences(blocks: DataFrame, totals: DataFrame, classes: Classes) -> DataFrame:
    """Per block the class of every token, and per document the counts and the base score."""
    answers = totals.where("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "data"))).alias("answers"))
    id_array = blocks.schema["ids"]
    joined = blocks.select("block", "ids", "train", "lengths", "tokens", "keys", "endings").join(answers, "block")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                value = {c: column(batch, c)[k] for c in ("lengths", "tokens", "keys", "endings", "answers")}
                lengths, tokens = np.frombuffer(value["lengths"].as_buffer(), "<i4"), np.frombuffer(value["tokens"].as_buffer(), "<i4")
                keys, endings = np.frombuffer(value["keys"].as_buffer(), "<u8"), np.frombuffer(value["endings"].as_buffer(), "<u2")
                total = np.concatenate([np.frombuffer(a["data"], "<i8") for a in value["answers"].as_py()])
                kind = classes.of(keys, endings, total)
                chance = np.log10((total + 0.5) / classes.whole)
                inside = classes.inside(kind, total)
                starts = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_pydict(
                    {
                        "ids": column(batch, "ids").slice(k, 1),
                        "train": column(batch, "train").slice(k, 1),
                        "lengths": column(batch, "lengths").slice(k, 1),
                        "classes": pa.array([kind[tokens].tobytes()]),
                        "known": pa.array([np.add.reduceat((total[tokens] > 0).astype(np.int64), starts).tolist()]),
                        "base": pa.array([np.add.reduceat(chance[tokens], starts).tolist()]),
                        "inside": pa.array([np.add.reduceat(inside[tokens], starts).tolist()]),
                    }
                )

    schema = schema_of(id_array, "train array<boolean>, lengths binary, classes binary, known array<long>, base array<double>, inside array<double>")
    return written(joined.mapInArrow(work, schema), "class-sequences")


@dataclass
class Chain:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # state by class


@dataclass
class Steps:
    """Sequences with their symbols in order of the step: all first symbols, then all second ones.

    Within a step the longest sequence comes first, so those that go on are a prefix, and every step
    of a recursion works on one slice.
    """

    symbols: np.ndarray
    bounds: np.ndarray  # where each step begins
    member: np.ndarray  # the sequence of each symbol, numbered longest first
    order: np.ndarray  # that number's sequence

    @classmethod
    def of(cls, symbols: np.ndarray, lengths: np.ndarray) -> Steps:
        order = np.argsort(-lengths, kind="stable")
        size, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
        running = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        bounds = np.r_[0, np.cumsum(running)]
        member = np.arange(bounds[-1]) - np.repeat(bounds[:-1], running)
        place = begin[member] + np.repeat(np.arange(len(running)), running)
        return cls(symbols[place], bounds, member, order)


def forward(chain: Chain, steps: Steps, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log10 likelihood of each sequence, and the scaled forward values and scales of each symbol."""
    alphas = np.take(np.ascontiguousarray(chain.emits.T, kind), steps.symbols, axis=0)
    scales = np.empty(len(alphas), kind)
    bounds, ones = steps.bounds.tolist(), np.ones(len(chain.start), kind)
    start, moves = chain.start.astype(kind), chain.moves.astype(kind)
    moved = np.empty((bounds[1] if len(bounds) > 1 else 0, len(start)), kind)
    before = None
    for a, b in zip(bounds, bounds[1:]):
        state, scale = alphas[a:b], scales[a:b]
        if before is None:
            state *= start
        else:
            ahead = moved[: b - a]
            np.matmul(before[: b - a], moves, out=ahead)
            state *= ahead
        np.matmul(state, ones, out=scale)
        state /= scale[:, None]
        before = state
    out = np.empty(len(steps.order))
    out[steps.order] = np.bincount(steps.member, np.log10(scales, dtype=np.float64), len(steps.order))
    return out, alphas, scales


def expected_counts(chain: Chain, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the sequences, and their log10 likelihood."""
    states, kinds = chain.emits.shape
    steps = Steps.of(symbols, lengths)
    # Scaled values lie near one and sums are taken in full, so single precision is enough here.
    likelihood, gammas, scales = forward(chain, steps, np.float32)
    bounds = steps.bounds.tolist()
    # What a symbol adds from behind: its emission over its scale, times the backward value after it.
    behind = np.take(np.ascontiguousarray(chain.emits.T, np.float32), steps.symbols, axis=0)
    behind /= scales[:, None]
    back, moves = np.ascontiguousarray(chain.moves.T, np.float32), np.zeros((states, states))
    beta = np.ones((bounds[1] if len(bounds) > 1 else 0, states), np.float32)
    for t in range(len(bounds) - 2, -1, -1):
        a, b = bounds[t], bounds[t + 1]
        own = beta[: b - a]
        # Forward values turn into posteriors; those of the step before are still forward values.
        gammas[a:b] *= own
        if t:
            ahead = behind[a:b]
            ahead *= own
            begin = bounds[t - 1]
            moves += gammas[begin : begin + b - a].T @ ahead
            # Sequences that end in the step before keep the backward value 1.
            np.matmul(ahead, back, out=own)
    gammas /= np.maximum(gammas @ np.ones(states, np.float32), np.float32(1e-30))[:, None]
    emitted = np.array([np.bincount(steps.symbols, own, kinds) for own in np.ascontiguousarray(gammas.T)])
    starts = gammas[: len(beta)].sum(axis=0, dtype=np.float64)
    return starts, moves * chain.moves, emitted, float(likelihood.sum())


def _symbols(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(column(batch, "lengths")[k].as_buffer(), "<i4").astype(np.int64)
    return np.frombuffer(column(batch, "classes")[k].as_buffer(), "<u2"), lengths


def _together(batch: pa.RecordBatch, training: bool) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Sequences of a batch, several blocks at a time: which blocks, symbols and lengths.

    A recursion takes as many steps as its longest sequence has tokens, so blocks share the steps.
    """
    symbols, lengths, size, first = [], [], 0, 0
    for k in range(batch.num_rows):
        own, counts = _symbols(batch, k)
        if training:
            learned = np.array(column(batch, "train")[k].as_py(), bool)
            own, counts = own[np.repeat(learned, counts)], counts[learned]
        if size and size + len(own) > TOGETHER:
            yield range(first, k), np.concatenate(symbols), np.concatenate(lengths)
            symbols, lengths, size, first = [], [], 0, k
        symbols.append(own)
        lengths.append(counts)
        size += len(own)
    if size:
        yield range(first, batch.num_rows), np.concatenate(symbols), np.concatenate(lengths)


def _learned(shares: np.ndarray, starts: np.ndarray, moves: np.ndarray, emitted: np.ndarray) -> Chain:
    emits = emitted + EMISSION_PRIOR * shares
    moves, starts = moves + TRANSITION_PRIOR, starts + TRANSITION_PRIOR
    return Chain(starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=1, keepdims=True))


def train(sequences: DataFrame, classes: Classes, states: int = STATES, passes: int = PASSES, seed: int = 5) -> Chain:
    """Baum-Welch over all training documents; each pass sums expected counts over the partitions."""
    rng = np.random.default_rng(seed)
    kinds = len(classes.shares)
    tilt = classes.shares * np.exp(rng.normal(0.0, 1.0, (states, kinds)))
    sticky = np.full((states, states), 0.2 / states) + 0.8 * np.eye(states)
    chain = Chain(np.full(states, 1.0 / states), sticky, tilt / tilt.sum(axis=1, keepdims=True))

    def counter(chain: Chain) -> Callable[[pa.RecordBatch], dict[int, np.ndarray]]:
        def work(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
            sums = [np.zeros(states), np.zeros((states, states)), np.zeros((states, kinds)), np.zeros(1)]
            for _, symbols, lengths in _together(batch, training=True):
                *counts, likelihood = expected_counts(chain, symbols, lengths)
                for total, part in zip(sums, [*counts, np.array([likelihood])]):
                    total += part
            return dict(enumerate(sums))

        return work

    taken = sequences.select("train", "lengths", "classes")
    for _ in range(passes):
        sums = summed_arrays(taken, taken.rdd.getNumPartitions(), counter(chain))
        if not sums:
            break
        chain = _learned(classes.shares, sums[0], sums[1].reshape(states, states), sums[2].reshape(states, kinds))
    return chain


def score(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, passes: int = PASSES
) -> DataFrame:
    """One row per row of ``docs``, learned from the rows for which ``training`` holds.

    Returns ``id_col, n_tokens, n_known, train_tokens, base_score, score``. Tokens are runs without
    ASCII white space, A-Z in lower case, and one end per text; they are told apart by a 64-bit
    hash. Below its class a token has its share of the class's tokens, whatever the state. A long text
    costs memory and steps in proportion to its tokens. Null and empty texts are the end alone, repeated rows are each counted and scored, and
    a null condition means not training. Without training rows every token is unseen. An empty
    table gives an empty result.
    """
    ship_code(docs.sparkSession)
    blocks = _blocks(docs, id_col, text_col, F.coalesce(training, F.lit(False)))
    totals = _totals(blocks)
    classes = _classes(totals)
    sequences = _sequences(blocks, totals, classes)
    chain = train(sequences, classes, states, passes)
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks, symbols, lengths in _together(batch, training=False):
                likelihood = forward(chain, Steps.of(symbols, lengths))[0]
                part = batch.slice(blocks.start, len(blocks))
                flat = {c: column(part, c).flatten() for c in ("ids", "known", "base", "inside")}
                yield pa.RecordBatch.from_arrays(
                    [
                        flat["ids"], pa.array(lengths), flat["known"], pa.array(np.full(len(lengths), classes.tokens)),
                        flat["base"], pa.array(likelihood + flat["inside"].to_numpy()),
                    ],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    out = f"id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sequences.mapInArrow(work, out).withColumnRenamed("id", id_col)
