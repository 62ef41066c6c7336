"""Boosted trees at many cutoffs: one model for each forecast time, trained on what lies before it.

Edges of bins and the residuals' unit are fixed for an epoch of cutoffs, from the rows before
the epoch's first one; a new epoch begins when the training rows have doubled. So nothing in a
model stems from its cutoff or later, and features are binned a few times, not once per model.

Training rows within ``LOCAL_BYTES`` (a proven bound) are broadcast, and tasks fit the cutoffs
dealt to them, all in one job. Beyond that, rows stay in packed chunks, and the trees of all
cutoffs grow together: a job sums the histograms of every wanted (cutoff, leaf) and keeps each
one's best split. How many jobs that takes depends on rounds and depth, not on the number of
cutoffs. Sums of residuals are exact, so both ways give the same trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import trees
from tidemark.functions.expanding import expanding_median
from tidemark.functions.ordered import timeline
from tidemark.functions.ranks import exact_ranks
from tidemark.functions.trees import Model, Settings
from tidemark.operators.walkforward import Walk, open_walk
from tidemark.schemas import DATASET_COLUMNS, FORECAST_COLUMNS, feature_columns
from tidemark.session import stage

LOCAL_BYTES = 32 << 20
#: Rows of a packed chunk, rounds after which scores are written, bytes of histograms that a task gathers.
CHUNK, KEPT_ROUNDS, GATHER = 4096, 10, 64 << 20


@dataclass(frozen=True)
class Epoch:
    """Edges by feature and the unit, from the rows before time number ``start``."""

    start: int
    edges: list[np.ndarray]
    unit: float


def epoch_starts(cutoffs: Sequence[int], rows_before: Sequence[int]) -> list[int]:
    """The cutoffs at which the training rows have doubled since the last such one."""
    starts, held = [], 0
    for c, n in zip(cutoffs, rows_before, strict=True):
        if not starts or n >= 2 * held:
            starts.append(c)
            held = n
    return starts


def _epoch_of(epochs: list[Epoch], cutoff: int) -> int:
    return max(i for i, e in enumerate(epochs) if e.start <= cutoff)


def _columns(batch) -> np.ndarray:
    """Columns of doubles as a matrix, missing as NaN."""
    return np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns]) if batch.num_columns else np.empty((batch.num_rows, 0))


def _local(when, y, x, cutoffs, starts, settings) -> DataFrame:
    """Models by cutoff, from rows that every task may hold."""
    epochs = []
    for start in starts:
        known = [np.sort(c[~np.isnan(c)]) for c in x[when < start].T]
        edges = [np.unique(c[trees.edge_ranks(len(c))]) if len(c) else np.empty(0) for c in known]
        epochs.append(Epoch(start, edges, trees.unit_of(float(np.abs(y[when < start]).max(initial=0)))))
    binned = [np.column_stack([trees.bin_numbers(x[:, i], e) for i, e in enumerate(ep.edges)]) for ep in epochs]

    def one(cutoff: int) -> Model:
        e = _epoch_of(epochs, cutoff)
        mine = when < cutoff
        edges, unit = epochs[e].edges, epochs[e].unit
        known = [c[~np.isnan(c)] for c in x[mine].T]
        fill = np.array([np.searchsorted(edge, np.median(c), "right") if len(c) else 0 for edge, c in zip(edges, known, strict=True)])
        model = Model(edges, fill, trees.mean_of(y[mine], unit))
        return trees.fit(model, binned[e][mine], y[mine], unit, settings)

    return one


def fit_many(rows: DataFrame, names: Sequence[str], cutoffs: Sequence[int], rows_before: Sequence[int], settings: Settings, local_bytes: int = LOCAL_BYTES) -> dict[int, Model]:
    """A model for each cutoff, on the rows with a smaller ``_when``.

    ``rows`` has ``_when`` (number of the row's time), ``_y`` (its target) and the features; it
    is staged. Models have a set number of nodes, so they fit the driver as the cutoffs do.
    """
    cutoffs = sorted(cutoffs)
    starts = epoch_starts(cutoffs, rows_before)
    used = rows.select("_when", "_y", *[F.col(n).cast("double").alias(n) for n in names]).where(F.col("_when") < max(cutoffs))
    if rows_before[-1] * 8 * (len(names) + 2) > local_bytes:
        return _together(used, names, cutoffs, starts, settings)
    table = used.toArrow().combine_chunks()
    matrix = _columns(table.select([1, *range(2, table.num_columns)]))
    order = np.argsort(table.column("_when").to_numpy(), kind="stable")
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((table.column("_when").to_numpy()[order], matrix[order, 0], matrix[order, 1:]))

    def run(batches):
        one = None
        for batch in batches:
            for cutoff in batch.column(0).to_pylist():
                one = one or _local(*shared.value, cutoffs, starts, settings)
                yield pa.RecordBatch.from_arrays([pa.array([cutoff], pa.int64()), pa.array([pickle.dumps(one(cutoff).plain())])], names=["cutoff", "model"])

    dealt = spark.createDataFrame([(int(c),) for c in cutoffs], "cutoff long").repartition(len(cutoffs), "cutoff")
    found = {r["cutoff"]: Model.from_plain(pickle.loads(r["model"])) for r in dealt.mapInArrow(run, "cutoff long, model binary").collect()}
    shared.unpersist()
    return found


# Rows in chunks, the trees of all cutoffs together.

_CHUNKS = "n int, whens binary, y binary, bins binary, scores binary"
_PARTS = "cutoff long, leaf long, counts binary, sums binary"


def _together(rows: DataFrame, names, cutoffs, starts, settings) -> dict[int, Model]:
    spark, p = rows.sparkSession, len(names)
    epochs = []
    for start in starts:
        before = rows.where(F.col("_when") < start)
        found = exact_ranks(before, list(names), trees.edge_ranks)
        largest = before.agg(F.max(F.abs("_y"))).first()[0]
        epochs.append(Epoch(start, [np.unique(found[n]) if found[n] else np.empty(0) for n in names], trees.unit_of(largest or 0.0)))
    chunks = stage(rows.mapInArrow(lambda batches: _packed(batches, epochs), _CHUNKS))
    medians = _medians(rows, names, cutoffs)
    models, units = {}, {}
    for c in cutoffs:
        e = epochs[_epoch_of(epochs, c)]
        fill = np.array([0 if m is None else int(np.searchsorted(edge, m, "right")) for edge, m in zip(e.edges, medians[c], strict=True)])
        models[c], units[c] = Model(e.edges, fill, 0.0), e.unit
    totals = chunks.mapInArrow(lambda b: _totals(b, units), "cutoff long, n long, upper long, lower long")
    for c, n, *parts in totals.groupBy("cutoff").agg(F.sum("n"), F.sum("upper"), F.sum("lower")).collect():
        models[c].base = units[c] * (trees.joined(*parts) / n)
    state = _State(epochs, models, units, p, settings)
    live = set(cutoffs)
    for done in range(settings.rounds):
        if not live:
            break
        if done % KEPT_ROUNDS == 0:
            chunks = stage(chunks.mapInArrow(state.scored, _CHUNKS))
            state = state.after(done)
        growths = {c: trees.Growth(settings) for c in live}
        while True:
            asked = {c: g.wanted() for c, g in growths.items()}
            asked = {c: (tree, missing, node) for c, (tree, missing, node) in asked.items() if missing}
            if not asked:
                break
            shared = spark.sparkContext.broadcast((state, asked))
            parts = chunks.mapInArrow(lambda b, s=shared: s.value[0].tallies(b, s.value[1]), _PARTS)
            merged = parts.groupBy("cutoff", "leaf").applyInArrow(_best(p, settings.least), "cutoff long, leaf long, split binary")
            for c, leaf, split in merged.collect():
                growths[c].learn(leaf, pickle.loads(split))
            shared.unpersist()
        for c, growth in growths.items():
            tree = growth.wanted()[0]
            if tree.feature[0] < 0:
                live.discard(c)
            else:
                models[c].trees.append(trees.scaled(tree, settings.rate * units[c]))
    return models


def _packed(batches, epochs: list[Epoch]):
    """Rows as chunks in order of time; one matrix of bins per epoch."""
    for batch in batches:
        for a in range(0, batch.num_rows, CHUNK):
            part = batch.slice(a, CHUNK)
            when = part.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(when, kind="stable")
            values = _columns(pa.RecordBatch.from_arrays(part.columns[1:], names=part.schema.names[1:]))[order]
            bins = [np.column_stack([trees.bin_numbers(values[:, 1 + i], e) for i, e in enumerate(ep.edges)]) for ep in epochs]
            data = [when[order].astype(np.int64), values[:, 0], np.stack(bins).astype(np.int16)]
            yield _chunk(len(when), *[d.tobytes() for d in data], b"")


def _chunk(n: int, *data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([d], pa.binary()) for d in data]], names=["n", "whens", "y", "bins", "scores"])


def _read(batches, epochs: int, p: int):
    for batch in batches:
        for n, when, y, bins, scores in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield n, np.frombuffer(when, np.int64), np.frombuffer(y), np.frombuffer(bins, np.int16).reshape(epochs, n, p) if p else None, np.frombuffer(scores)


def _totals(batches, units):
    sums: dict[int, list[int]] = {}
    for _, when, y, _, _ in _read(batches, 0, 0):
        whole = {u: [np.r_[0, np.cumsum(part)] for part in trees.halves(trees.residuals(y, 0.0, u))] for u in set(units.values())}
        for c, unit in units.items():
            k = int(np.searchsorted(when, c))
            if k:
                upper, lower = whole[unit]
                sums[c] = [a + int(b) for a, b in zip(sums.get(c, (0, 0, 0)), (k, upper[k], lower[k]), strict=True)]
    if sums:
        columns = [list(sums), *zip(*sums.values(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cutoff", "n", "upper", "lower"])


@dataclass
class _State:
    """What tasks need to go on: models, and how many of their trees the chunks' scores hold."""

    epochs: list[Epoch]
    models: dict[int, Model]
    units: dict[int, float]
    features: int
    settings: Settings
    kept: int = -1

    def after(self, kept: int) -> _State:
        return _State(self.epochs, self.models, self.units, self.features, self.settings, kept)

    def _each(self, when, bins, scores):
        """Per cutoff with training rows in the chunk: their bins and scores up to the last tree."""
        at = 0
        for c, model in self.models.items():
            k = int(np.searchsorted(when, c))
            if not k:
                continue
            own = trees.filled(bins[_epoch_of(self.epochs, c), :k], model.fill)
            held = scores[at : at + k].copy() if self.kept >= 0 else np.full(k, model.base)
            at += k
            for tree in model.trees[max(self.kept, 0) :]:
                tree.add_to(held, own)
            yield c, own, held

    def scored(self, batches):
        """The chunks with scores of all trees so far."""
        for n, when, y, bins, scores in _read(batches, len(self.epochs), self.features):
            held = [s for _, _, s in self._each(when, bins, scores)]
            yield _chunk(n, when.tobytes(), y.tobytes(), bins.tobytes(), np.concatenate(held).tobytes() if held else b"")

    def tallies(self, batches, asked):
        """Histograms of the wanted leaves, summed over the task's chunks."""
        sums: dict = {}

        def flush():
            for (c, leaf), (rows, total) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([leaf], pa.int64()), pa.array([rows.tobytes()]), pa.array([total.tobytes()])], names=["cutoff", "leaf", "counts", "sums"])
            sums.clear()

        size = 24 * self.features * trees.WIDTH
        for _, when, y, bins, scores in _read(batches, len(self.epochs), self.features):
            for c, own, held in self._each(when, bins, scores):
                if c not in asked:
                    continue
                tree, missing, node = asked[c]
                made = trees.histograms(own, tree.place(own), trees.residuals(y[: len(held)], held, self.units[c]), [node[k] for k in missing])
                for k, rows, total in zip(missing, *made, strict=True):
                    before = sums.get((c, k))
                    sums[c, k] = (rows, total) if before is None else (before[0] + rows, before[1] + total)
                if len(sums) * size > GATHER:
                    yield from flush()
        yield from flush()


def _best(features: int, least: int):
    def best(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        shape = features, trees.WIDTH
        rows = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        sums = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("sums"))
        split = trees.best_split(rows.reshape(shape), sums.reshape(2, *shape), least)
        return pa.table({"cutoff": [key[0].as_py()], "leaf": [key[1].as_py()], "split": [pickle.dumps(split)]})

    return best


def _medians(rows: DataFrame, names, cutoffs) -> dict[int, list[float | None]]:
    """Per cutoff the median of each feature's earlier values: of the first row at each time."""
    last = rows.sparkSession.createDataFrame([(int(c),) for c in cutoffs], "_when long").withColumns({n: F.lit(None).cast("double") for n in names})
    marked = rows.select("_when", *names).withColumn("_cut", F.lit(1)).unionByName(last.withColumn("_cut", F.lit(0)))
    line = timeline(marked, (), ["_when", "_cut"]).number("_row")
    line = expanding_median(line, {n: f"_m{i}" for i, n in enumerate(names)}, "_row")
    found = line.frame.where("_cut = 0").select("_when", *[f"_m{i}" for i in range(len(names))]).collect()
    return {r[0]: [None if v is None or np.isnan(v) else v for v in r[1:]] for r in found}


def predicted(rows: DataFrame, names: Sequence[str], models: dict[int, Model], by: str | None = None) -> DataFrame:
    """``rows`` with ``prediction``: of the last model whose cutoff is at most the row's ``by``, or of the only model."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array(sorted(models)), models))
    form = T.StructType([*rows.schema.fields, T.StructField("prediction", T.DoubleType())])
    at = [rows.columns.index(n) for n in names]
    when = rows.columns.index(by) if by else None

    def run(batches):
        cutoffs, own = shared.value
        for batch in batches:
            x = _columns(pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=[str(i) for i in at]))
            pick = np.zeros(len(x), int) if when is None else np.searchsorted(cutoffs, batch.column(when).to_numpy(zero_copy_only=False), "right") - 1
            made = np.empty(len(x))
            for k in np.unique(pick):
                mine = pick == k
                made[mine] = own[int(cutoffs[k])].predict(x[mine])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=form.names)

    return rows.mapInArrow(run, form)


def boosted_over(
    walk: Walk,
    names: Sequence[str],
    refit_every: int = 1,
    model_name: str = "boosted_trees",
    local_bytes: int = LOCAL_BYTES,
    **settings,
) -> DataFrame:
    """The boosted forecasts of an opened walk."""
    if refit_every < 1:
        raise ValueError("refit_every must be at least 1.")
    if walk.min_train_size < 2:
        raise ValueError("Boosted trees require at least two training rows with targets.")
    rows = stage(
        walk.line.frame.select(*DATASET_COLUMNS, *[n for n in names if n not in DATASET_COLUMNS], walk.fold.alias("fold_number"))
        .withColumn("_y", F.col("target_value"))
        .withColumn("_when", F.unix_micros("forecast_timestamp"))
    )
    # Times are bounded by the calendar, so the driver may hold one count for each.
    counted = rows.groupBy("_when").agg(F.count(F.lit(1)), F.count_if(F.col("fold_number") >= 1), F.count_if(F.abs("_y") == float("inf"))).collect()
    times = sorted(map(tuple, counted))
    if any(t[3] for t in times):
        raise ValueError("Boosted trees: targets must be finite.")
    upto = np.cumsum([0, *[t[1] for t in times]])
    before = {t[0]: int(n) for t, n in zip(times, upto, strict=False)}
    starts = [t[0] for t in times if t[2]][::refit_every]
    if starts and before[starts[0]] < walk.min_train_size:
        raise ValueError(f"Only {before[starts[0]]} training rows before the first forecast; min_train_size is {walk.min_train_size}.")
    models = fit_many(rows, names, starts, [before[s] for s in starts], Settings(**settings), local_bytes)
    scored = predicted(rows.where("fold_number >= 1"), names, models, "_when")
    return scored.withColumn("actual", F.col("target_value")).withColumn("model_name", F.lit(model_name)).select(*FORECAST_COLUMNS)


def walk_forward_boosted(
    dataset: DataFrame,
    min_train_size: int = 24,
    features: Sequence[str] | None = None,
    by: Sequence[str] = ("target_id",),
    **options,
) -> DataFrame:
    """Forecast every fold with a model trained before it.

    There is one model for each forecast timestamp, trained on the rows of all targets
    strictly before it; ``refit_every`` keeps a model for that many distinct timestamps.
    ``by`` says which rows count towards ``min_train_size``. A model that would be trained
    on fewer rows than that is an error. ``options`` are those of ``boosted_over`` and
    ``trees.Settings``.
    """
    names = feature_columns(dataset, features)
    return boosted_over(open_walk(dataset, min_train_size, by, names), names, **options)
