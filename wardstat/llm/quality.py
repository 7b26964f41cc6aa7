"""Document quality by supervised subword embeddings.

Words, word pairs and character n-grams are hashed to learned vectors. A document is the sum of the
averages of its three kinds of features, and a softmax layer turns it into label probabilities.
Training is stochastic gradient descent in numpy with step sizes per vector, on a bounded sample of
labelled rows. As the layer is linear, a trained vector acts on the score by one number, so scoring
a document is an average of numbers looked up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wardstat.llm.common import NOT_SPACE, column, flat_text, mix, schema_of, span_hashes, steps, whole_rows, word_spans
from wardstat.llm.sampling import labelled_sample
from wardstat.session import ship_code

#: Labelled rows that are trained on; with more, those with the smallest id hashes are.
EXAMPLES = 4096
BUCKETS = 1 << 18
DIMENSIONS, EPOCHS, RATE = 16, 4, 0.5
#: Bytes of the character n-grams.
GRAMS = (3, 4, 5)
#: Kinds of features, each averaged by itself.
KINDS = 3

_VALUES = np.random.default_rng(3).integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


def features(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """First row, rows, and per kind the buckets with their rows relative to the first."""
    data, offsets = flat_text(texts)
    for first, last in steps(offsets):
        part = offsets[first : last + 1]
        body, part = data[part[0] : part[-1]], part - part[0]
        starts, ends, rows = word_spans(body, part, NOT_SPACE)
        words = span_hashes(body, starts, ends)
        kinds = [(_bucket(words), rows)]
        with np.errstate(over="ignore"):
            pairs, owners = [], []
            for gap in (1, 2):
                same = rows[gap:] == rows[:-gap] if len(rows) > gap else np.empty(0, bool)
                left, right = words[:-gap][same], words[gap:][same]
                # A word that comes again is one feature whatever the word.
                pairs.append(np.where(left == right, np.uint64(gap) * _STEP, mix(left * np.uint64(3) + right + np.uint64(gap))))
                owners.append(rows[gap:][same])
            kinds.append((_bucket(np.concatenate(pairs)), np.concatenate(owners)))
            kinds.append(_character_grams(body, part))
        yield first, last - first, kinds


def _character_grams(body: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of bytes inside words and across one word end."""
    space = ~NOT_SPACE[body]
    values = _VALUES[np.where(space, np.uint8(32), body)]
    row = np.repeat(np.arange(len(part) - 1), np.diff(part))
    found, owners = [], []
    hashed, inner = values, np.zeros(len(body), bool)
    for size in range(2, max(GRAMS) + 1):
        count = len(body) - size + 1
        if count <= 0:
            break
        # ``inner`` says whether a byte strictly inside the n-gram is a space.
        inner = inner[:count] | space[size - 2 : size - 2 + count] if size > 2 else np.zeros(count, bool)
        hashed = hashed[:count] * _STEP + values[size - 1 :]
        if size in GRAMS:
            good = ~inner & (row[:count] == row[size - 1 :])
            found.append(_bucket(mix(hashed[good])))
            owners.append(row[:count][good])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate(owners)


def _counted(buckets: np.ndarray, rows: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per row its distinct buckets and their share of the row's features."""
    keys, times = np.unique(rows * BUCKETS + buckets, return_counts=True)
    cuts = np.searchsorted(keys, np.arange(count + 1) * BUCKETS)
    for k in range(count):
        part = slice(cuts[k], cuts[k + 1])
        yield keys[part] % BUCKETS, times[part] / max(1, times[part].sum())


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 1) -> tuple[np.ndarray, float]:
    """What each bucket adds to the log odds of label 1, and the log odds of an empty document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0, 1.0, (BUCKETS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    squares = np.full(BUCKETS, 1e-8, np.float32)
    layer, bias = np.zeros((2, DIMENSIONS)), np.zeros(2)
    layer_squares, bias_squares = np.full((2, DIMENSIONS), 1e-8), np.full(2, 1e-8)
    for epoch in range(EPOCHS):
        rate = RATE * (1.0 - epoch / EPOCHS)
        for k in rng.permutation(len(examples)):
            buckets, shares, label = examples[k]
            mean = shares @ vectors[buckets]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            wrong = p / p.sum()
            wrong[label] -= 1.0
            back = wrong @ layer
            grown = np.outer(wrong, mean)
            layer_squares += grown * grown
            layer -= rate * grown / np.sqrt(layer_squares)
            bias_squares += wrong * wrong
            bias -= rate * wrong / np.sqrt(bias_squares)
            squares[buckets] += (shares * shares * float(back @ back) / DIMENSIONS).astype(np.float32)
            vectors[buckets] -= (rate * shares / np.sqrt(squares[buckets]))[:, None].astype(np.float32) * back.astype(np.float32)[None, :] * 0.1
    turn = layer[1] - layer[0]
    return vectors @ turn, float(bias[1] - bias[0])


def fit(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    examples: int = EXAMPLES,
) -> tuple[np.ndarray, float]:
    """Train on at most ``examples`` rows of ``labelled`` (id, 0/1 label), in one task.

    Without labelled rows the model is even: every score is one half.
    """
    ship_code(docs.sparkSession)
    sample = labelled_sample(docs, labelled, id_col, text_col, label_col, examples, "quality-examples")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            ids, labels = column(batch, "id").to_pylist(), column(batch, "label").to_pylist()
            for first, count, kinds in features(column(batch, "text")):
                for k, parts in enumerate(zip(*[_counted(b, r, count) for b, r in kinds])):
                    buckets = np.concatenate([b for b, _ in parts]).astype(np.int32)
                    shares = np.concatenate([s for _, s in parts]).astype(np.float32)
                    rows.append((ids[first + k], buckets, shares, int(labels[first + k])))
        rows.sort(key=lambda r: r[0])
        gains, bias = train([r[1:] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([gains.astype("<f8").tobytes()]), pa.array([bias])], names=["gains", "bias"])

    # The sample is bounded; the model is one row of fixed size.
    gains, bias = sample.repartition(1).mapInArrow(work, "gains binary, bias double").first() or (b"", 0.0)
    return np.frombuffer(bytes(gains), "<f8") if gains else np.zeros(BUCKETS), bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with ``score``, the probability of label 1.

    Null counts as empty, and an empty text gets the score of no features. Repeated rows are each
    scored; an empty table gives an empty result.
    """
    ship_code(docs.sparkSession)
    packed, place = whole_rows(docs), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, bias = shared.value
        for batch in batches:
            odds = np.full(batch.num_rows, bias)
            for first, rows, kinds in features(pc.struct_field(batch.column(0), [place])):
                for buckets, owners in kinds:
                    total = np.bincount(owners, gains[buckets], rows)
                    odds[first : first + rows] += total / np.maximum(np.bincount(owners, minlength=rows), 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500))))], names=["row", "score"]
            )

    return packed.mapInArrow(work, schema_of(packed.schema["row"], "score double"))
