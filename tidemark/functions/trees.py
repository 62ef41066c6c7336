"""Boosted regression trees from histograms, grown leaf by leaf: the parts that run inside tasks.

Features are bin numbers, so a split is "bin at most s". Residuals are whole multiples of a
unit, summed in two parts: their sums are exact, and a histogram is the same however its rows are dealt to tasks.
A tree grows best first. ``Growth`` asks for the leaves that it has to know next, is told the
best split of each, and asks again; whoever holds the rows answers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Bins of a feature: at most this many edges, so that a bin number fits a byte.
EDGES = 255
WIDTH = EDGES + 1
#: A residual is rounded to the largest target's power of two times this.
UNIT = 2.0**-52
#: Residuals are summed as two parts, so that sums over any number of rows are exact.
LOW = 26


@dataclass(frozen=True)
class Settings:
    """Fixed values of the boosted model by default: 100 rounds, rate 0.05, 15 leaves of 5 rows or more."""

    rounds: int = 100
    rate: float = 0.05
    leaves: int = 15
    least: int = 5


def edge_ranks(n: int) -> list[int]:
    """Ranks whose values become the edges of a feature with ``n`` training values."""
    return [k * n // EDGES for k in range(EDGES)]


def unit_of(largest: float) -> float:
    return 2.0 ** np.frexp(largest)[1] * UNIT if largest else UNIT


def bin_numbers(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many edges are at most each value; -1 for a missing one."""
    return np.where(np.isnan(values), -1, np.searchsorted(edges, values, "right")).astype(np.int16)


def filled(bins: np.ndarray, fill: np.ndarray) -> np.ndarray:
    """Bins with those of missing values replaced by the bin of the median."""
    return np.where(bins < 0, fill, bins)


@dataclass
class Tree:
    """Nodes as arrays: the feature a node splits by (-1: a leaf), its bin, its left child (the right one follows), its value."""

    feature: list[int] = field(default_factory=lambda: [-1])
    split: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        feature, split, left = (np.array(x) for x in (self.feature, self.split, self.left))
        node = np.zeros(len(bins), np.int64)
        live = np.arange(len(bins)) if feature[0] >= 0 else np.empty(0, np.int64)
        while len(live):
            at = node[live]
            node[live] = left[at] + (bins[live, feature[at]] > split[at])
            live = live[feature[node[live]] >= 0]
        return node

    def add_to(self, scores: np.ndarray, bins: np.ndarray) -> None:
        scores += np.array(self.value)[self.place(bins)]


def halves(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower part of whole numbers."""
    return whole >> LOW, whole & ((1 << LOW) - 1)


def joined(upper, lower) -> int:
    return (int(upper) << LOW) + int(lower)


def histograms(bins: np.ndarray, leaf: np.ndarray, residual: np.ndarray, wanted: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """By wanted leaf, feature and bin: rows, and upper and lower sums of residuals (in units)."""
    number = np.full(max(int(leaf.max(initial=0)), *wanted) + 1, -1)
    number[wanted] = np.arange(len(wanted))
    mine = number[leaf]
    use = np.flatnonzero(mine >= 0)
    features = bins.shape[1]
    cell = ((mine[use, None] * features + np.arange(features)) * WIDTH + bins[use]).ravel()
    size = len(wanted) * features * WIDTH
    rows = np.bincount(cell, minlength=size)
    shape = len(wanted), features, WIDTH
    sums = [np.bincount(cell, np.repeat(part.astype(float), features), size).astype(np.int64).reshape(shape) for part in halves(residual[use])]
    return rows.reshape(shape), np.stack(sums, axis=1)


def best_split(rows: np.ndarray, sums: np.ndarray, least: int) -> tuple | None:
    """Of one leaf: (gain, feature, bin, rows and sum on the left, in all); None if no split gains.

    Of equal gains the first feature and then the lowest bin wins.
    """
    n, total = int(rows[0].sum()), joined(*sums[:, 0].sum(1))
    left, parts = np.cumsum(rows, 1)[:, :-1], np.cumsum(sums, 2)[:, :, :-1]
    held = parts[0] * 2.0**LOW + parts[1]
    right = n - left
    fits = (left >= least) & (right >= least)
    if not fits.any():
        return None
    gain = np.where(fits, held**2 / np.maximum(left, 1) + (total - held) ** 2 / np.maximum(right, 1), -np.inf) - float(total) ** 2 / n
    at = int(gain.argmax())
    feature, split = divmod(at, gain.shape[1])
    # What rounding alone can make of a split without gain does not count.
    if gain[feature, split] <= 1e-12 * (float(total) ** 2 / n):
        return None
    return float(gain[feature, split]), feature, split, int(left[feature, split]), joined(*parts[:, feature, split]), n, total


class Growth:
    """One tree as it grows. Leaves are numbered like a heap: 1 is the root, ``2 k`` and ``2 k + 1`` its children."""

    def __init__(self, settings: Settings):
        self.settings, self.known = settings, {}

    def wanted(self) -> tuple[Tree, list[int], dict[int, int]]:
        """The tree as far as it is known, heap numbers of leaves that must be known next, and the tree's node of each."""
        tree, node, held, born, splits = Tree(), {1: 0}, {}, {1: 0}, 0
        while len(node) < self.settings.leaves:
            ready = [(-self.known[k][0], k) for k in node if self.known.get(k)]
            if not ready:
                break
            _, k = min(ready)
            _, feature, split, rows, total, n, whole = self.known[k]
            at, splits = node.pop(k), splits + 1
            tree.feature[at], tree.split[at], tree.left[at] = feature, split, len(tree.feature)
            for child, size, part in ((2 * k, rows, total), (2 * k + 1, n - rows, whole - total)):
                node[child], held[child], born[child] = len(tree.feature), part / size, splits
                tree.feature.append(-1), tree.split.append(0), tree.left.append(0), tree.value.append(0.0)
        full = len(node) >= self.settings.leaves
        # In a full tree, the leaves of the last split came too late to be split themselves.
        missing = [k for k in node if k not in self.known and not (full and born[k] == splits)]
        for k, at in node.items():
            tree.value[at] = held.get(k, 0.0)
        return tree, missing, node

    def learn(self, leaf: int, split: tuple | None) -> None:
        self.known[leaf] = split


def grow(bins: np.ndarray, residual: np.ndarray, settings: Settings) -> Tree:
    """One tree on rows that are all here."""
    growth = Growth(settings)
    while True:
        tree, missing, node = growth.wanted()
        if not missing:
            return tree
        rows, sums = histograms(bins, tree.place(bins), residual, [node[k] for k in missing])
        for k, r, s in zip(missing, rows, sums, strict=True):
            growth.learn(k, best_split(r, s, settings.least))


@dataclass
class Model:
    """A fitted model: edges and median's bin by feature, mean target, trees with rate and unit multiplied in."""

    edges: list[np.ndarray]
    fill: np.ndarray
    base: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, features: np.ndarray) -> np.ndarray:
        return filled(np.column_stack([bin_numbers(features[:, i], e) for i, e in enumerate(self.edges)]), self.fill)

    def predict(self, features: np.ndarray) -> np.ndarray:
        bins = self.bins(features)
        scores = np.full(len(bins), self.base)
        for tree in self.trees:
            tree.add_to(scores, bins)
        return scores


    def plain(self) -> tuple:
        """The model as lists and numbers only, to be sent from tasks."""
        return [e.tolist() for e in self.edges], self.fill.tolist(), self.base, [(t.feature, t.split, t.left, t.value) for t in self.trees]

    @staticmethod
    def from_plain(held: tuple) -> Model:
        edges, fill, base, found = held
        return Model([np.array(e, float) for e in edges], np.array(fill, np.int64), base, [Tree(*t) for t in found])


def scaled(tree: Tree, factor: float) -> Tree:
    tree.value = [v * factor for v in tree.value]
    return tree


def mean_of(y: np.ndarray, unit: float) -> float:
    return unit * (joined(*(part.sum() for part in halves(residuals(y, 0.0, unit)))) / len(y))


def residuals(y: np.ndarray, scores, unit: float) -> np.ndarray:
    return np.rint((y - scores) / unit).astype(np.int64)


def fit(model: Model, bins: np.ndarray, y: np.ndarray, unit: float, settings: Settings) -> Model:
    """Boost on rows that are all here; a tree without a split ends it."""
    own = filled(bins, model.fill)
    scores = np.full(len(y), model.base)
    for _ in range(settings.rounds):
        tree = grow(own, residuals(y, scores, unit), settings)
        if tree.feature[0] < 0:
            break
        model.trees.append(scaled(tree, settings.rate * unit))
        tree.add_to(scores, own)
    return model
