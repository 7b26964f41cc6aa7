"""Latent class analysis: a mixture of independent categorical variables fitted by EM."""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardstat.operators.emstep import TINY, answer_patterns, log_likelihood, weighted_patterns
from wardstat.operators.factors import level_code, level_dictionary
from wardstat.operators.passes import column, matrix
from wardstat.session import materialize, ship_code
from wardstat.sources.tables import FLAGS

# The variables of the class model besides the flags.
DEMOGRAPHICS = ["admission_type", "gender", "age_at_admission"]

MANIFEST = DEMOGRAPHICS + FLAGS

# Patterns that one array step works on, so that its arrays stay in the processor's cache.
BLOCK = 1 << 14
# Fewer patterns than this are not worth a task of their own in a pass, and more are never put in one task.
LEAST_ROWS, TASK_ROWS = 2048, 1 << 20
# Up to so many tasks send their sums straight to the driver; more are added up on the executors first.
DIRECT_TASKS = 64
# Variables are looked up together while they have at most so many different answers.
LEAST_ANSWERS, MOST_ANSWERS = 256, 2048
# Densities below this are summed as logarithms.
FAINT = 1e-250


@dataclass(frozen=True)
class Coding:
    """Variables in use, their observed levels, and how many outcomes each one counts for."""

    variables: list[str]
    levels: list[list]
    outcomes: list[int]

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum([0] + [len(lv) for lv in self.levels])

    def codes(self) -> Column:
        """Level number of each variable in one array; NULL for a value the model has not seen.

        Levels are sorted, so a variable's level is found by its place in a constant array.
        """

        return F.array(*[level_code(v, lv) - 1 for v, lv in zip(self.variables, self.levels)])

    def free_parameters(self, n_classes: int) -> int:
        return n_classes * sum(k - 1 for k in self.outcomes) + n_classes - 1


@dataclass(frozen=True)
class LatentClassModel:
    """Fitted parameters, classes in descending order of their share."""

    coding: Coding
    shares: np.ndarray  # (classes,)
    probs: np.ndarray  # (levels of all variables, classes)
    log_likelihood: float
    n_rows: int
    iterations: int
    converged: bool

    @property
    def n_classes(self) -> int:
        return len(self.shares)

    @property
    def n_parameters(self) -> int:
        return self.coding.free_parameters(self.n_classes)

    @property
    def aic(self) -> float:
        return -2.0 * self.log_likelihood + 2.0 * self.n_parameters

    @property
    def bic(self) -> float:
        return -2.0 * self.log_likelihood + float(np.log(self.n_rows)) * self.n_parameters

    def parameters(self, spark: SparkSession) -> DataFrame:
        """Model size rows: (class, share, variable, level, prob)."""
        starts = self.coding.starts
        rows = [
            (r + 1, float(self.shares[r]), v, str(level), float(self.probs[starts[j] + i, r]))
            for r in range(self.n_classes)
            for j, v in enumerate(self.coding.variables)
            for i, level in enumerate(self.coding.levels[j])
        ]
        return spark.createDataFrame(rows, "class int, share double, variable string, level string, prob double")

    def transform(self, df: DataFrame, posterior: str = "posterior", column: str = "class_assignment") -> DataFrame:
        """Add the class probabilities (array, class 1 first) and the most probable class.

        Rows with a missing or unseen value get NULL in both; equal probabilities go to the
        first class. All in expressions: each value is looked up in its variable's dictionary of
        class log-probabilities, which are summed and normalised by their largest.
        """
        log_probs, log_shares, starts = _logs(self.probs), _logs(self.shares), self.coding.starts

        def answer(j: int, variable: str, levels: list) -> Column:
            value = F.col(f"`{variable}`").cast("bigint" if isinstance(levels[0], int) else "string")
            rows = log_probs[starts[j] : starts[j + 1]].tolist()
            return F.try_element_at(F.map_from_arrays(F.lit(levels), F.lit(rows)), value)

        answers = F.array(*[answer(j, v, lv) for j, (v, lv) in enumerate(zip(self.coding.variables, self.coding.levels))])
        joint = F.aggregate(answers, F.lit(log_shares.tolist()), lambda total, row: F.zip_with(total, row, lambda x, y: x + y))
        scored = df.withColumn(posterior, _let(joint, _normalised))
        best = F.array_position(F.col(posterior), F.array_max(posterior)).cast("int")
        return scored.withColumn(column, best)

    @classmethod
    def from_parameters(cls, params: DataFrame) -> LatentClassModel:
        """The model that a parameter table describes, for scoring; levels compare as text.

        ``params`` has one row per (class, variable, level), as :meth:`parameters` gives them; levels
        that some classes lack have probability zero there.
        """
        rows = params.select("class", "share", "variable", "level", "prob").collect()  # model-sized
        variables = sorted({r.variable for r in rows})
        levels = [sorted({r.level for r in rows if r.variable == v}) for v in variables]
        coding = Coding(variables, levels, [len(lv) for lv in levels])
        place = {(v, lv): int(coding.starts[j]) + i for j, v in enumerate(variables) for i, lv in enumerate(levels[j])}
        n_classes = max(r["class"] for r in rows)
        shares, probs = np.zeros(n_classes), np.zeros((int(coding.starts[-1]), n_classes))
        for r in rows:
            shares[r["class"] - 1] = r.share
            probs[place[r.variable, r.level], r["class"] - 1] = r.prob
        return cls(coding, shares, probs, float("nan"), 0, 0, False)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _normalised(joint: Column) -> Column:
    """Probabilities from an array of logarithms; NULL stays NULL."""

    def shares(raw: Column) -> Column:
        mass = F.aggregate(raw, F.lit(0.0), lambda total, x: total + x)
        return _let(mass, lambda m: F.transform(raw, lambda x: x / m))

    return _let(F.array_max(joint), lambda top: _let(F.transform(joint, lambda x: F.exp(x - top)), shares))


def _logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, TINY))


def _one_hot(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    hot = np.zeros((len(codes), starts[-1]))
    hot[np.arange(len(codes))[:, None], codes + starts[:-1]] = 1.0
    return hot


def _posterior(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalise log joint densities over the last axis; also return the log marginals."""
    top = joint.max(axis=-1, keepdims=True)
    raw = np.exp(joint - top)
    mass = raw.sum(axis=-1, keepdims=True)
    return raw / mass, (np.log(mass) + top)[..., 0]


class Patterns:
    """The distinct response patterns of a table with their frequencies, ready for many passes.

    Rows with equal answers are one weighted pattern, so a pass costs as much as there are
    different patterns. The table is checkpointed (its lineage ends there). Patterns that one task
    can take are sent whole to the tasks of a fit, a task for each start. For single passes, and where
    there are more, they are dealt over the cores and kept as arrays, so that a pass is one job without
    an exchange; a lost executor builds its arrays again from the checkpoint.
    """

    def __init__(self, df: DataFrame, variables: Sequence[str]):
        raw = materialize(answer_patterns(df, variables, "_w"))
        found, rows = raw.agg(F.count(F.lit(1)), F.sum("_w")).first()
        self.n_rows = int(rows or 0)
        if self.n_rows == 0:
            raise ValueError("no complete row to fit a class model to")
        self.coding = _coding(raw, list(variables))
        self.spark = raw.sparkSession
        ship_code(self.spark)
        cores = self.spark.sparkContext.defaultParallelism
        self.in_one_task = found <= TASK_ROWS
        self.partitions = max(min(cores, -(-found // LEAST_ROWS)), -(-found // TASK_ROWS))
        coded = raw.select(self.coding.codes().alias("_codes"), F.col("_w").cast("double").alias("_w"))
        self.packed = _packed(coded.repartition(self.partitions, "_codes"), self.coding)
        starts, block = self.coding.starts, BLOCK

        def parts(rows: Iterator) -> Iterator[_Part]:
            taken = list(rows)
            if taken:
                yield _Part(*_unpacked(taken, starts), starts, block)

        self.parts = self.packed.rdd.mapPartitions(parts).persist(StorageLevel.MEMORY_AND_DISK)

    def release(self) -> None:
        self.parts.unpersist()


def _packed(coded: DataFrame, coding: Coding) -> DataFrame:
    """The patterns as few rows of packed numbers: the levels in as many bytes as they need, and the weights."""
    small = _small(coding.starts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = {"codes": matrix(batch, "_codes").astype(small), "w": column(batch, "_w").astype(np.float64)}
                yield pa.RecordBatch.from_pydict({name: pa.array([v.tobytes()], pa.binary()) for name, v in values.items()})

    return coded.mapInArrow(task, "codes binary, w binary")


def _small(starts: np.ndarray) -> np.dtype:
    return np.min_scalar_type(int(np.diff(starts).max(initial=1)))


def _unpacked(rows: Sequence, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels and weights of the patterns, in an order that does not depend on that of the rows."""
    codes = np.frombuffer(b"".join(codes for codes, _ in rows), _small(starts)).reshape(-1, len(starts) - 1)
    weight = np.frombuffer(b"".join(w for _, w in rows), np.float64)
    order = np.lexsort([*codes.T, codes[:, np.argmax(np.diff(starts))]])
    return codes[order], weight[order]


class _Part:
    """Patterns in one task, with the variables in few groups.

    The different answers to the variables of a group are far fewer than the patterns, so their class
    densities are computed once for each answer, and a pattern's density is a product of one of them
    per group. Its posteriors are added up per answer likewise.
    """

    def __init__(self, codes: np.ndarray, weight: np.ndarray, starts: np.ndarray, block: int):
        self.weight, self.block, self.shape = weight, block, int(starts[-1])
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # levels, answers by 0 or 1, answer of each pattern
        most = min(max(len(weight) // 24, LEAST_ANSWERS), MOST_ANSWERS)
        sizes = np.diff(starts)
        members, answer, first = [], np.zeros(len(weight), np.intp), np.zeros(1, np.intp)

        def close() -> None:
            columns = np.concatenate([np.arange(starts[j], starts[j + 1]) for j in members])
            self.groups.append((columns, _one_hot(codes[first], starts)[:, columns], answer))

        for j in np.argsort(-sizes, kind="stable").tolist():
            own = codes[:, j].astype(np.intp)
            _, at, together = np.unique(answer * sizes[j] + own, return_index=True, return_inverse=True)
            if members and len(at) > most:
                close()
                members = []
                _, at, together = np.unique(own, return_index=True, return_inverse=True)
            members, answer, first = [*members, j], together, at
        close()

    def sums(self, shares: np.ndarray, probs: np.ndarray) -> tuple[float, np.ndarray]:
        """Log-likelihood of the parameters, and the weighted sums of the posteriors per level and class."""
        log_probs, log_shares = _logs(probs), _logs(shares)
        logs = [log_probs[columns].T @ hot.T for columns, hot, _ in self.groups]  # (classes, answers)
        logs[0] += log_shares[:, None]
        tops = [own.max(axis=0) for own in logs]
        tables = [np.exp(own - top) for own, top in zip(logs, tops)]
        found = [np.zeros(table.shape) for table in tables]
        level = 0.0
        for begin in range(0, len(self.weight), self.block):
            answers = [answer[begin : begin + self.block] for _, _, answer in self.groups]
            post, top = tables[0].take(answers[0], axis=1), tops[0].take(answers[0])
            for answer, table, own in zip(answers[1:], tables[1:], tops[1:]):
                post *= table.take(answer, axis=1)
                top += own.take(answer)
            mass = post.sum(axis=0)
            faint = np.flatnonzero(mass < FAINT)  # no class is likely for all groups
            if len(faint):
                joint = sum(own[:, answer[faint]] for own, answer in zip(logs, answers))
                likely, top[faint] = _posterior(joint.T)
                post[:, faint], mass[faint] = likely.T, 1.0
            weight = self.weight[begin : begin + self.block]
            level += weight @ (np.log(mass) + top)
            post *= weight / mass
            for answer, own in zip(answers, found):
                for total, share in zip(own, post):
                    total += np.bincount(answer, share, len(total))
        counts = np.empty((self.shape, len(shares)))
        for own, (columns, hot, _) in zip(found, self.groups):
            counts[columns] = (own @ hot).T
        return float(level), counts


def _coding(raw: DataFrame, variables: list[str]) -> Coding:
    found = level_dictionary(raw, variables)  # model-sized
    used = [v for v in variables if len(found[v]) > 1]  # a constant says nothing about classes

    def outcomes(lv: list) -> int:
        # Whole numbers from 1 up count as codes 1..max, as in the published parameter count.
        return lv[-1] if isinstance(lv[0], int) and lv[0] >= 1 else len(lv)

    return Coding(used, [found[v] for v in used], [outcomes(found[v]) for v in used])


@dataclass
class _Run:
    """One random start for one number of classes."""

    shares: np.ndarray
    probs: np.ndarray
    log_likelihood: float = -np.inf
    iterations: int = 0
    converged: bool = False


def _random_start(coding: Coding, n_classes: int, rng: np.random.Generator) -> _Run:
    blocks = []
    for lv in coding.levels:
        draw = rng.uniform(size=(len(lv), n_classes))
        blocks.append(draw / draw.sum(axis=0))
    return _Run(np.full(n_classes, 1.0 / n_classes), np.concatenate(blocks))


def _update(starts: np.ndarray, level: float, counts: np.ndarray, probs: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood and the parameters that the sums of a pass give; a class without mass keeps its probabilities."""
    mass = counts[starts[0] : starts[1]].sum(axis=0)  # every row answers the first variable once
    fresh = np.where(mass > 0, counts / np.where(mass > 0, mass, 1.0), probs)
    return float(level), mass / mass.sum(), fresh


def _em_pass(patterns: Patterns, params: dict[int, tuple]) -> dict[int, tuple]:
    """One pass for every parameter set: its log-likelihood and its EM update."""
    starts = patterns.coding.starts
    points = list(params.values())

    def work(parts: Iterator[_Part]) -> Iterator[np.ndarray]:
        total = np.zeros(sum(1 + probs.size for _, probs in points))
        for part in parts:
            found = [part.sums(shares, probs) for shares, probs in points]
            total += np.concatenate([np.r_[level, counts.ravel()] for level, counts in found])
        yield total

    sums = patterns.parts.mapPartitions(work)
    summed = sums.reduce(np.add) if patterns.partitions <= DIRECT_TASKS else sums.treeReduce(np.add)
    cuts = np.cumsum([1 + probs.size for _, probs in points])[:-1]
    return {
        i: _update(starts, own[0], own[1:].reshape(probs.shape), probs)
        for own, (i, (_, probs)) in zip(np.split(summed, cuts), params.items())
    }


def _extrapolate(p0: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """Squared extrapolation of an EM sequence (Varadhan and Roland, 2008)."""
    change, bend = p1 - p0, p2 - 2 * p1 + p0
    size = np.linalg.norm(bend)
    if size == 0:
        return p2
    alpha = min(-np.linalg.norm(change) / size, -1.0)
    return p0 - 2 * alpha * change + alpha**2 * bend


def _valid(shares: np.ndarray, probs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shares, probs = np.clip(shares, 0.0, None), np.clip(probs, 0.0, None)
    totals = np.add.reduceat(probs, starts[:-1], axis=0)
    return shares / shares.sum(), probs / np.repeat(totals, np.diff(starts), axis=0)


def _ascent(run: _Run, starts: np.ndarray, max_iter: int, tol: float, accelerate: bool) -> Generator[tuple, tuple, None]:
    """The steps of one start: asks for the pass over a point (shares, probabilities) and is sent what it gives."""

    def ask(shares: np.ndarray, probs: np.ndarray) -> Generator[tuple, tuple, tuple]:
        run.iterations += 1
        return (yield shares, probs)

    while True:
        first = yield from ask(run.shares, run.probs)
        gain = first[0] - run.log_likelihood
        run.log_likelihood = first[0]
        if gain <= tol:
            run.converged = True
        if run.converged or run.iterations >= max_iter:
            return
        if not accelerate:
            _, run.shares, run.probs = first
            continue
        second = yield from ask(*first[1:])
        jump = _valid(
            _extrapolate(run.shares, first[1], second[1]),
            _extrapolate(run.probs, first[2], second[2]),
            starts,
        )
        landed = yield from ask(*jump)
        # Either way the start continues from an EM update, whose likelihood is at least as high.
        run.log_likelihood, run.shares, run.probs = landed if landed[0] >= second[0] else second


def _climb_apart(patterns: Patterns, runs: list[_Run], options: tuple) -> list[_Run]:
    """Every start in a task of its own, which has all patterns: one job, however many steps they take."""
    starts, block = patterns.coding.starts, BLOCK
    context = patterns.spark.sparkContext
    sent = context.broadcast([(bytes(r.codes), bytes(r.w)) for r in patterns.packed.collect()])

    def climb(number: int, run: _Run) -> tuple[int, _Run]:
        part = _Part(*_unpacked(sent.value, starts), starts, block)
        steps = _ascent(run, starts, *options)
        answer = None
        while True:
            try:
                shares, probs = steps.send(answer)
            except StopIteration:
                return number, run
            answer = _update(starts, *part.sums(shares, probs), probs)

    # Starts with most classes take longest, so they begin first.
    longest = sorted(enumerate(runs), key=lambda item: -len(item[1].shares))
    done = dict(context.parallelize(longest, len(longest)).map(lambda item: climb(*item)).collect())
    sent.destroy()
    return [done[i] for i in range(len(runs))]


def _climb_together(patterns: Patterns, runs: list[_Run], options: tuple) -> list[_Run]:
    """All starts advance in the same passes over the patterns, so their number is that of the slowest one."""
    ascents = {i: _ascent(run, patterns.coding.starts, *options) for i, run in enumerate(runs)}
    points = {i: next(steps) for i, steps in ascents.items()}
    while points:
        answers, points = _em_pass(patterns, points), {}
        for i, answer in answers.items():
            try:
                points[i] = ascents[i].send(answer)
            except StopIteration:
                pass
    return runs


def fit_patterns(
    patterns: Patterns,
    class_range: Iterable[int],
    max_iter: int = 7000,
    tol: float = 1e-5,
    n_rep: int = 5,
    seed: int = 1,
    accelerate: bool = True,
) -> list[LatentClassModel]:
    """For every number of classes the best of ``n_rep`` random starts.

    Where one task can take all patterns, every start makes its steps in a task of its own. Where there
    are more, all starts of all models advance in the same pass over the patterns. The steps are the same.

    A start stops when a step gains no more than ``tol``. With ``accelerate`` every two EM steps
    are followed by an extrapolated one, which is kept only if its likelihood is not lower, so
    the likelihood never falls either way.
    """
    rng = np.random.default_rng(seed)
    sizes = list(class_range)
    runs = [_random_start(patterns.coding, k, rng) for k in sizes for _ in range(n_rep)]
    climb = _climb_apart if patterns.in_one_task else _climb_together
    runs = climb(patterns, runs, (max_iter, tol, accelerate)) if runs else runs
    return [_best_model(patterns, runs[m * n_rep : (m + 1) * n_rep]) for m in range(len(sizes))]


def _best_model(patterns: Patterns, runs: list[_Run]) -> LatentClassModel:
    best = max(runs, key=lambda run: run.log_likelihood)
    order = np.argsort(-best.shares, kind="stable")
    return LatentClassModel(
        patterns.coding,
        best.shares[order],
        best.probs[:, order],
        best.log_likelihood,
        patterns.n_rows,
        best.iterations,
        best.converged,
    )


def lca_fit(
    df: DataFrame,
    n_classes: int,
    variables: Sequence[str] = MANIFEST,
    max_iter: int = 7000,
    tol: float = 1e-5,
    n_rep: int = 5,
    seed: int = 1,
    accelerate: bool = True,
) -> LatentClassModel:
    """Fit one class model to the complete rows of ``df``."""
    patterns = Patterns(df, variables)
    try:
        return fit_patterns(patterns, [n_classes], max_iter, tol, n_rep, seed, accelerate)[0]
    finally:
        patterns.release()


@dataclass(frozen=True)
class Selection:
    """Every fitted model and the best one by each criterion."""

    models: list[LatentClassModel]

    @property
    def best_aic(self) -> LatentClassModel:
        return min(self.models, key=lambda m: m.aic)

    @property
    def best_bic(self) -> LatentClassModel:
        return min(self.models, key=lambda m: m.bic)

    @property
    def best_combined(self) -> LatentClassModel:
        return min(self.models, key=lambda m: m.aic + m.bic)

    def metrics(self, spark: SparkSession) -> DataFrame:
        rows = [
            (
                m.n_classes,
                m.n_parameters,
                m.n_rows,
                m.log_likelihood,
                m.aic,
                m.bic,
                m.aic + m.bic,
                m is self.best_aic,
                m is self.best_bic,
                m is self.best_combined,
            )
            for m in self.models
        ]
        return spark.createDataFrame(
            rows,
            "n_classes int, n_parameters int, n_rows bigint, log_likelihood double, aic double, bic double,"
            " aic_plus_bic double, best_aic boolean, best_bic boolean, best_combined boolean",
        )


def lca_select(
    df: DataFrame, class_range: Iterable[int], variables: Sequence[str] = MANIFEST, **options
) -> Selection:
    """Fit one model per number of classes, all in the same passes, and compare them."""
    patterns = Patterns(df, variables)
    try:
        return Selection(fit_patterns(patterns, class_range, **options))
    finally:
        patterns.release()


def compare_parameters(df: DataFrame, tables: Sequence[DataFrame]) -> Selection:
    """Models from parameter tables over the same variables, judged on the complete rows of ``df``."""
    models = [LatentClassModel.from_parameters(t) for t in tables]
    patterns = weighted_patterns(df, models[0].coding.variables)
    judged = []
    for model, table in zip(models, tables):
        level, n_rows = log_likelihood(patterns, table, model.n_classes).first()
        judged.append(replace(model, log_likelihood=level if level is not None else float("nan"), n_rows=n_rows or 0))
    return Selection(judged)
