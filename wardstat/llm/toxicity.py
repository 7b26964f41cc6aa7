"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Labelled rows give the examples, and every word of theirs is a term; the frequency of each term is
counted over all documents. Terms that tell the labels apart weigh in full, all others a part, so
that what decides is not drowned by what a text is about. The examples' vectors form an inverted
index in blocks that know the largest weight of each term in each block; the postings of very
frequent terms are kept as dense columns. A document's search bounds its similarity to every block
and looks only into blocks that can still hold one of its k nearest examples, so it returns exactly
these. Their votes, weighted by similarity, are turned into probabilities by a calibration that is
fitted on the examples themselves, each scored without itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstat.llm.common import WORD_BYTE, column, flat_text, schema_of, span_hashes, steps, whole_rows, word_spans, written
from wardstat.operators.passes import summed_arrays
from wardstat.session import ship_code

#: Labelled rows that examples are taken from; with more, those with the smallest id hashes are.
EXAMPLES = 4096
#: Words of the examples that are terms; with more, those in most examples are.
TERMS = 1 << 20
#: What a term needs to tell the labels apart: chi-square with one degree of freedom, and examples.
EVIDENCE, TERM_EXAMPLES = 40.0, 5
#: Share of the examples of one label that must have such a term, so that copies of one text make none.
TERM_SHARE = 0.025
#: Part of its weight that any other term has.
OTHERS = 0.1
NEIGHBOURS = 15
BLOCK = 64
#: Terms whose postings are dense, and blocks that a search looks into first.
DENSE, FIRST = 96, 6
#: Similarity mass that the overall rate counts as when votes are summed.
PRIOR_MASS = 0.25
#: Bytes of the word beginnings that are terms as well where they tell the labels apart.
STEMS = (4, 6, 7)
#: Terms that are counted in one array.
COUNTED = 1 << 14


def terms_of(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes and rows of the words and of the word beginnings, rows relative to the first one given, step by step."""
    data, offsets = flat_text(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    for first, last in steps(offsets):
        part = offsets[first : last + 1]
        body, part = data[part[0] : part[-1]], part - part[0]
        starts, ends, rows = word_spans(body, part, WORD_BYTE)
        hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for size in STEMS:
            longer = ends - starts > size
            hashes.append(span_hashes(body, starts[longer], starts[longer] + size, salt=size))
            owners.append(rows[longer])
        yield first, last - first, span_hashes(body, starts, ends), rows, np.concatenate(hashes), np.concatenate(owners)


def _found(table: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes a sorted table has, and where."""
    if not len(table) or not len(hashes):
        return np.zeros(len(hashes), bool), np.empty(0, np.int64)
    place = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    hit = table[place] == hashes
    return hit, place[hit]


@dataclass
class Vocabulary:
    """Terms: the words first, then the telling beginnings; weights are IDF times the term's part."""

    words: np.ndarray  # sorted hashes
    stems: np.ndarray  # sorted hashes
    weights: np.ndarray

    def __len__(self) -> int:
        return len(self.words) + len(self.stems)

    def counted(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per step its rows, and (row, term, count) of the known terms, by row."""
        for _, rows, hashes, owners, stems, stem_owners in terms_of(texts):
            hit, word = _found(self.words, hashes)
            stem_hit, stem = _found(self.stems, stems)
            owner = np.concatenate([owners[hit], stem_owners[stem_hit]])
            term = np.concatenate([word, stem + len(self.words)]).astype(np.int64)
            keys, counts = np.unique(owner * max(len(self), 1) + term, return_counts=True)
            yield rows, keys // max(len(self), 1), keys % max(len(self), 1), counts

    def vectors(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Terms and weights of each row; weights have length one."""
        for rows, row, term, count in self.counted(texts):
            weight = (1.0 + np.log(np.maximum(count, 1))) * self.weights[term]
            cuts = np.searchsorted(row, np.arange(rows + 1))
            for k in range(rows):
                part = slice(cuts[k], cuts[k + 1])
                norm = np.sqrt(np.sum(weight[part] ** 2))
                yield term[part], weight[part] / norm if norm else weight[part]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of several ranges, one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out))
    return out


def similar_order(vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int) -> np.ndarray:
    """Examples ordered so that similar ones lie in the same block, which tightens its bounds.

    The list is halved until blocks are left, each time along the line between two examples that have
    little in common, moved twice to the middles of the halves.
    """
    sizes = np.array([len(t) for t, _ in vectors], np.int64)
    ends = np.cumsum(sizes)
    term = np.concatenate([t for t, _ in vectors] or [np.empty(0)]).astype(np.int64)
    weight = np.concatenate([w for _, w in vectors] or [np.empty(0)])
    order, stack = np.arange(len(vectors)), [(0, len(vectors))]
    while stack:
        low, high = stack.pop()
        if high - low <= block:
            continue
        part = order[low:high]
        place, owner = _ranges(ends[part] - sizes[part], sizes[part]), np.repeat(np.arange(len(part)), sizes[part])
        t, w = term[place], weight[place]

        def along(line: np.ndarray) -> np.ndarray:
            return np.bincount(owner, w * line[t], len(part))

        def middle(members: np.ndarray) -> np.ndarray:
            return np.bincount(t, w * members[owner], terms) / max(members.sum(), 1)

        first = middle(np.arange(len(part)) == 0)
        other = middle(np.arange(len(part)) == int(np.argmin(along(first))))
        split = low + max(block, (high - low) // 2 // block * block)
        for _ in range(3):
            ranks = np.argsort(along(first - other), kind="stable")
            upper = np.zeros(len(part), bool)
            upper[ranks[split - low :]] = True
            first, other = middle(upper), middle(~upper)
        order[low:high] = part[ranks]
        stack += [(low, split), (split, high)]
    return order


class BlockMaxIndex:
    """Postings by term and block, with the largest weight of each term in each block."""

    def __init__(self, terms: int, vectors: list[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> None:
        self.order = similar_order(vectors, terms, block)
        self.block, self.blocks = block, -(-len(vectors) // block)
        rows = np.concatenate([np.full(len(vectors[e][0]), k, np.int64) for k, e in enumerate(self.order)] or [np.empty(0, np.int64)])
        term = np.concatenate([vectors[e][0] for e in self.order] or [np.empty(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([vectors[e][1] for e in self.order] or [np.empty(0)])
        # The most frequent terms have a column each, all others lists of (row, weight).
        often = np.argsort(-np.bincount(term, minlength=terms), kind="stable")[: min(DENSE, terms)]
        self.column = np.full(terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        own = self.column[term]
        self.dense = np.zeros((max(self.blocks, 1) * block, len(often)))
        self.dense[rows[own >= 0], own[own >= 0]] = weight[own >= 0]
        self.dense = self.dense.reshape(max(self.blocks, 1), block, len(often))
        self.dense_tops = self.dense.max(axis=1)
        rows, term, weight = rows[own < 0], term[own < 0], weight[own < 0]
        by = np.lexsort((rows, term))
        # Postings of a cell lie together; they keep the row's place in its block.
        self.places, self.weights = rows[by] % block, weight[by]
        cell = term[by] * max(self.blocks, 1) + rows[by] // block
        first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
        self.cell_block = cell[first] % max(self.blocks, 1)
        self.cell_first, self.cell_size = first, np.diff(np.r_[first, len(cell)])
        self.cell_top = np.maximum.reduceat(self.weights, first) if len(first) else np.empty(0)
        self.cells = np.searchsorted(cell[first] // max(self.blocks, 1), np.arange(terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest positive cosine and these cosines; equal ones by number."""
        if not len(terms) or not self.blocks:
            return np.empty(0, np.int64), np.empty(0)
        own = self.column[terms]
        often = own >= 0
        query = np.zeros(self.dense.shape[2])
        query[own[often]] = weights[often]
        terms = terms[~often]
        begin = self.cells[terms]
        sizes = self.cells[terms + 1] - begin
        cells, mass = _ranges(begin, sizes), np.repeat(weights[~often], sizes)
        blocks = self.cell_block[cells]
        bounds = self.dense_tops @ query + np.bincount(blocks, mass * self.cell_top[cells], self.blocks)

        def look(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            # Blocks that follow each other are one product, without a copy.
            pieces = np.split(chosen, np.flatnonzero(np.diff(chosen) > 1) + 1) if len(chosen) else []
            total = np.concatenate([self.dense[p[0] : p[-1] + 1].reshape(len(p) * self.block, len(query)) @ query for p in pieces] or [np.empty(0)])
            slot = np.full(self.blocks, -1)
            slot[chosen] = np.arange(len(chosen)) * self.block
            base = slot[blocks]
            inside = np.flatnonzero(base >= 0)
            size = self.cell_size[cells[inside]]
            posts = _ranges(self.cell_first[cells[inside]], size)
            at, value = np.repeat(base[inside], size), np.repeat(mass[inside], size)
            at += self.places[posts]
            value *= self.weights[posts]
            total += np.bincount(at, value, len(total))
            hits = np.flatnonzero(total > 0)
            names = self.order[chosen[hits // self.block] * self.block + hits % self.block]
            keep = names != without
            return names[keep], total[hits][keep]

        ranked = np.argsort(-bounds, kind="stable")
        ranked = ranked[bounds[ranked] > 0.0]
        found, scores = look(np.sort(ranked[:FIRST]))
        least = np.partition(scores, -k)[-k] if len(scores) >= k else 0.0
        # Whatever can still reach the k-th best similarity found so far.
        rest = ranked[FIRST:][bounds[ranked[FIRST:]] >= least - 1e-12]
        if len(rest):
            more, more_scores = look(np.sort(rest))
            found, scores = np.concatenate([found, more]), np.concatenate([scores, more_scores])
        if len(scores) > k:
            close = scores >= np.partition(scores, -k)[-k] - 1e-11
            found, scores = found[close], scores[close]
        best = np.lexsort((found, -np.round(scores, 12)))[:k]
        return found[best], scores[best]


@dataclass
class ToxicityModel:
    vocabulary: Vocabulary
    index: BlockMaxIndex
    labels: np.ndarray
    ids: list
    rate: float
    slope: float = 1.0
    shift: float = 0.0
    empty_score: float = 0.0

    def vote(self, terms: np.ndarray, weights: np.ndarray, without: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        found, scores = self.index.nearest(terms, weights, NEIGHBOURS, without)
        mass = PRIOR_MASS * self.rate + float(scores @ self.labels[found])
        return mass / (PRIOR_MASS + float(scores.sum())), found, scores

    def score(self, terms: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        value, found, scores = self.vote(terms, weights)
        if not len(found):
            return self.empty_score, found, scores
        return float(1.0 / (1.0 + np.exp(-(self.slope * _logit(value) + self.shift)))), found, scores

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Logistic regression of the labels on the votes, each example left out of its own vote."""
        votes = [self.vote(*v, without=k) for k, v in enumerate(vectors)]
        told = np.array([len(found) > 0 for _, found, _ in votes], bool)
        silent = self.labels[~told]
        self.empty_score = float((silent.sum() + self.rate) / (len(silent) + 1.0))
        x, y = _logit(np.array([v for v, _, _ in votes])[told]), self.labels[told]
        if not len(y) or y.min() == y.max():
            return
        w = np.array([1.0, 0.0])
        design = np.column_stack([x, np.ones_like(x)])
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(design @ w, -30, 30)))
            # The penalty keeps the fit finite where the votes separate the labels.
            gradient = design.T @ (p - y) + 1e-2 * (w - [1.0, 0.0])
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        self.slope, self.shift = float(max(w[0], 1e-3)), float(w[1])


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    examples: int = EXAMPLES, terms: int = TERMS,
) -> ToxicityModel:
    """Learn from ``labelled`` (id, 0/1 label), at most ``examples`` of its rows.

    Every word of the examples is a term, up to ``terms`` words. Rows without label, id or document
    are left out; of several labels of an id the largest counts, of several texts the largest; of terms
    that tie at the limit those with the smallest hash stay. Texts are read whole. Without any labelled
    row, and with an empty table, all scores are 0.
    """
    ship_code(docs.sparkSession)
    known = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.dropna().groupBy("id").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(examples)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    # At most ``examples`` ids, so they go to every task.
    sample = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.first("label").alias("label"), F.max("text").alias("text"))
    sample = written(sample, "toxic-examples")

    def example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = column(batch, "label").to_numpy()
            for first, _, hashes, owners, stems, stem_owners in terms_of(column(batch, "text")):
                for found, owner, stem in ((hashes, owners, False), (stems, stem_owners, True)):
                    order = np.lexsort((found, owner))
                    found, owner = found[order], owner[order]
                    new = np.r_[True, (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])][: len(found)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[new].view(np.int64)), pa.array(np.full(int(new.sum()), stem)), pa.array(label[first + owner[new]])],
                        names=["term", "stem", "label"],
                    )

    totals = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    count, positive = totals[0], totals[1] or 0
    rate = positive / count if count else 0.0
    n, p = F.col("n"), F.col("p")
    expected = n * rate
    spread = F.greatest(expected * (1.0 - rate), F.lit(1e-9))
    chi = (p - expected) * (p - expected) / spread
    stats = sample.mapInArrow(example_terms, "term long, stem boolean, label int").groupBy("term", "stem")
    stats = stats.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    common = F.when(p > expected, p >= TERM_SHARE * positive).otherwise(n - p >= TERM_SHARE * (count - positive))
    judged = stats.select("term", "stem", "n", ((n >= TERM_EXAMPLES) & (chi >= EVIDENCE) & common).alias("telling"))
    # At most ``terms`` words, and the beginnings that tell the labels apart.
    found = judged.where(~F.col("stem") | F.col("telling")).orderBy(F.desc("telling"), F.desc("n"), "term").limit(terms).toArrow()
    hashes = found.column("term").to_numpy().view(np.uint64)
    stem, telling = (np.array(found.column(c).to_pylist(), bool) for c in ("stem", "telling"))
    words, stems = np.sort(hashes[~stem]), np.sort(hashes[stem])
    part = np.full(len(hashes), OTHERS)
    part[np.searchsorted(words, hashes[~stem & telling])] = 1.0
    part[len(words) :] = 1.0
    vocabulary = Vocabulary(words, stems, part)

    def frequencies(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        seen = np.zeros(-(-max(len(vocabulary), 1) // COUNTED) * COUNTED)
        for _, _, term, _ in vocabulary.counted(column(batch, "text")):
            seen += np.bincount(term, minlength=len(seen))
        counted = {-1: np.array([float(batch.num_rows)])}
        return counted | dict(enumerate(seen.reshape(-1, COUNTED)))

    counts = summed_arrays(texts.select("text"), 0, frequencies)
    rows = counts.pop(-1, np.zeros(1))[0]
    held = np.concatenate([counts[k] for k in sorted(counts)] or [np.zeros(len(vocabulary))])[: len(vocabulary)]
    vocabulary = Vocabulary(words, stems, part * (1.0 + np.log((rows + 1.0) / (held + 1.0))))

    def example_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = list(vocabulary.vectors(column(batch, "text")))
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "id"), column(batch, "label"),
                    pa.array([t for t, _ in vectors], pa.list_(pa.int64())), pa.array([w for _, w in vectors], pa.list_(pa.float64())),
                ],
                names=["id", "label", "terms", "weights"],
            )

    id_type = sample.schema["id"].dataType.simpleString()
    # At most ``examples`` sparse rows over at most ``terms`` terms.
    schema = f"id {id_type}, label int, terms array<long>, weights array<double>"
    told = sample.mapInArrow(example_vectors, schema).orderBy("id").toArrow()
    vectors = [(t.values.to_numpy(), w.values.to_numpy()) for t, w in zip(told.column("terms"), told.column("weights"))]
    labels, ids = np.array(told.column("label").to_pylist(), float), told.column("id").to_pylist()
    model = ToxicityModel(vocabulary, BlockMaxIndex(len(vocabulary), vectors), labels, ids, rate)
    model.calibrate(vectors)
    return model


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", evidence: int = 3) -> DataFrame:
    """Every row of ``docs`` as struct ``row`` with ``score`` and ``evidence``.

    ``evidence`` lists the nearest examples as (id, similarity, label); of equally near ones the smaller
    ids come first. A text without a word that any example has, an empty and a null text get the rate of
    such examples. Texts are read whole, however long; repeated rows are each scored; an empty table
    gives an empty result; the rows' own columns stay inside ``row``, so their names cannot clash.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    packed = whole_rows(docs)
    text_place = docs.columns.index(text_col)
    id_type = docs.schema[id_col].dataType.simpleString()
    id_arrow = pa.int64() if id_type == "bigint" else pa.string()
    kind = pa.list_(pa.struct([("id", id_arrow), ("similarity", pa.float64()), ("label", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted, seen = shared.value, {}
        named = fitted.ids if id_type == "bigint" else [str(i) for i in fitted.ids]
        for batch in batches:
            scores, lists = [], []
            for terms, weights in fitted.vocabulary.vectors(pc.struct_field(batch.column(0), [text_place])):
                key = hashlib.blake2b(terms.tobytes() + weights.tobytes()).digest()
                if key not in seen:
                    if len(seen) > 20_000:
                        seen.clear()
                    value, found, near = fitted.score(terms, weights)
                    seen[key] = value, [
                        {"id": named[e], "similarity": float(s), "label": int(fitted.labels[e])}
                        for e, s in zip(found[:evidence], near[:evidence])
                    ]
                value, listed = seen[key]
                scores.append(value)
                lists.append(listed)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(lists, kind)], names=["row", "score", "evidence"]
            )

    listed = "bigint" if id_type == "bigint" else "string"
    schema = schema_of(packed.schema["row"], f"score double, evidence array<struct<id:{listed},similarity:double,label:int>>")
    return packed.mapInArrow(work, schema)
