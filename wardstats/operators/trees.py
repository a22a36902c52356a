"""Cross-validation of regression trees over depths and leaf sizes (SURVEY
§2.7, G9), grown as Spark ML's DecisionTreeRegressor grows them.

Spark ML sends dense statistics (features x bins) of every node from every
partition, so that a tree of some 100,000 nodes costs gigabytes a level. Here
a tree of leaf size m and fold k is grown once, to the largest depth: a tree
of depth d is its first d levels. Statistics of nodes that hold more than
``LOCAL_ROWS`` training rows are summed over all tasks, level by level, and
only cells with rows are sent. Rows of smaller nodes meet in a task each, which
grows all levels below them. The driver holds the nodes above those, some
(training rows / ``LOCAL_ROWS``) per tree.

Thresholds are Spark ML's: at most ``MAX_BINS`` bins a feature, from all
training rows of a fold, or from a sample of ``THRESHOLD_ROWS`` if it has more.
A split maximises the drop of the variance (first feature and threshold of
equal ones); a node without a drop, or of no variance, is a leaf.

Nulls, ties and edge cases: NULL, NaN or infinite features and labels are an
error, as in Spark ML's fits; rows without a fold are left out; a fold without
training or test rows is an error, as in Spark's cross-validation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spark ML's bins, and the rows it takes thresholds from.
MAX_BINS, THRESHOLD_ROWS = 32, 10_000
#: Training rows of a node that one task grows.
LOCAL_ROWS = 20_000
#: Variance below which Spark ML calls a node pure.
EPSILON = 2.0 ** -52


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds between the values: all, or those that
    come closest to equal counts."""
    value, count = np.unique(values, return_counts=True)
    between = (value[:-1] + value[1:]) / 2.0
    if len(between) <= most:
        return between
    stride = len(values) / (most + 1)
    found, target, total = [], stride, np.cumsum(count)
    for i in range(1, len(value)):
        if abs(total[i - 1] - target) < abs(total[i] - target):
            found.append(between[i - 1])
            target += stride
    return np.array(found)


def _variance(stats: np.ndarray) -> np.ndarray:
    n, s, q = stats
    some = np.maximum(n, 1.0)
    return np.where(n > 0, (q - s * s / some) / some, 0.0)


def best_splits(cells: Callable[[int], np.ndarray], widths: list[int], node: np.ndarray | None, leaf: int):
    """Of k nodes: feature (-1: none), bin, and the statistics (count, sum,
    sum of squares) of node, left and right. ``cells(f)`` are the
    statistics of feature f's bins, of shape (3, k, bins)."""
    k = feature = None
    for f, width in enumerate(widths):
        if width < 2:
            continue
        run = cells(f).cumsum(-1)
        left = run[:, :, :-1]
        right = run[:, :, -1:] - left
        if node is None:  # a root's statistics come from its first threshold
            node = left[:, :, 0] + right[:, :, 0]
        if feature is None:
            k = np.arange(node.shape[1])
            whole, top = _variance(node), np.zeros(len(k))
            feature, at, lefts, rights = np.full(len(k), -1), np.zeros(len(k), np.int64), np.zeros((3, len(k))), np.zeros((3, len(k)))
        n = np.maximum(left[0] + right[0], 1.0)
        gain = whole[:, None] - left[0] / n * _variance(left) - right[0] / n * _variance(right)
        gain[(left[0] < leaf) | (right[0] < leaf)] = -np.inf
        best = gain.argmax(1)
        better = gain[k, best] > top
        top[better], feature[better], at[better] = gain[k, best][better], f, best[better]
        lefts[:, better], rights[:, better] = left[:, k, best][:, better], right[:, k, best][:, better]
    if feature is None:
        node = cells(0).sum(-1) if node is None else node
        none = np.zeros_like(node)
        return np.full(node.shape[1], -1), np.zeros(node.shape[1], np.int64), node, none, none
    return feature, at, node, lefts, rights


def grown(bins: np.ndarray, label: np.ndarray, test: np.ndarray, widths: list[int], level: int, node: np.ndarray | None, leaf: int, depths: list[int]) -> dict[int, float]:
    """Grows the subtree of one node from its training rows, to the largest
    depth. Squared errors of its test rows, in trees of each depth from
    ``level`` on."""
    rows, y, tested, truth = bins[~test], label[~test], bins[test], label[test]
    guess, active = np.zeros(len(truth)), np.arange(len(truth))
    at, to = np.zeros(len(y), np.int64), np.zeros(len(truth), np.int64)  # nodes of this level
    k, lost = 1, {}
    while True:
        squares = y * y

        def cells(f: int) -> np.ndarray:
            key, size = at * widths[f] + rows[:, f], k * widths[f]
            return np.stack([np.bincount(key, w, size).reshape(k, -1) for w in (None, y, squares)])

        last = level == max(depths)
        if node is None or not last:
            feature, cut, node, left, right = best_splits(cells, widths, node, leaf)
        guess[active] = (node[1] / np.maximum(node[0], 1.0))[to]
        if level in depths:
            lost[level] = float(((truth - guess) ** 2).sum())
        split = feature >= 0 if not last else np.zeros(k, bool)
        if not split.any():
            break
        # both children of a split node, side by side
        first = 2 * (np.cumsum(split) - 1)
        node = np.stack([left[:, split], right[:, split]], 2).reshape(3, -1)
        stay, go = split[at], split[to]
        rows, y, at = rows[stay], y[stay], at[stay]
        tested, active, to = tested[go], active[go], to[go]
        at = first[at] + (rows[np.arange(len(at)), feature[at]] > cut[at])
        to = first[to] + (tested[np.arange(len(to)), feature[to]] > cut[to])
        guess[active] = (node[1] / np.maximum(node[0], 1.0))[to]
        level += 1
        # pure nodes and those too small to split are leaves
        open_ = (np.abs(_variance(node)) >= EPSILON) & (node[0] >= 2 * leaf)
        number = np.cumsum(open_) - 1
        stay, go = open_[at], open_[to]
        rows, y, at = rows[stay], y[stay], number[at[stay]]
        tested, active, to = tested[go], active[go], number[to[go]]
        node, k = node[:, open_], int(open_.sum())
        if not k:
            if level in depths:
                lost[level] = float(((truth - guess) ** 2).sum())
            break
    rest = float(((truth - guess) ** 2).sum())
    return lost | {d: rest for d in depths if d > level}


class _Tree:
    """The upper nodes of one tree. ``state``: to be split by all tasks
    ('wide'), by one ('local'), or 'done'."""

    def __init__(self, rows: int):
        self.feature, self.cut, self.left, self.level, self.up = [-1], [0], [0], [0], [-1]
        self.stats: list[np.ndarray | None] = [None]
        self.state = ["wide" if rows > LOCAL_ROWS else "local"]

    def split(self, i: int, feature: int, cut: int, node, left, right, leaf: int, depth: int) -> None:
        self.stats[i], self.state[i] = node, "done"
        if feature < 0:
            return
        self.feature[i], self.cut[i], self.left[i] = feature, cut, len(self.feature)
        for child in (left, right):
            closed = self.level[i] + 1 == depth or abs(_variance(child)) < EPSILON or child[0] < 2 * leaf
            for column, x in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.level, self.level[i] + 1), (self.up, i), (self.stats, child)):
                column.append(x)
            self.state.append("done" if closed else "wide" if child[0] > LOCAL_ROWS else "local")

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(x) for x in (self.feature, self.cut, self.left, self.state))

    def guesses(self, depth: int) -> np.ndarray:
        """Of each node, the mean that a tree of that depth answers there;
        NaN where a task has yet to grow it."""
        out = np.full(len(self.state), np.nan)
        for i, (state, level) in enumerate(zip(self.state, self.level)):
            if level > depth:
                out[i] = out[self.up[i]]
            elif state == "done" or level < depth and self.feature[i] >= 0:
                out[i] = self.stats[i][1] / self.stats[i][0]
        return out


def _placed(tree: tuple[np.ndarray, ...], bins: np.ndarray) -> np.ndarray:
    """The node of each row that has no children yet."""
    feature, cut, left, _ = tree
    at, every = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while (inner := feature[at] >= 0).any():
        right = bins[every, np.maximum(feature[at], 0)] > cut[at]
        at = np.where(inner, left[at] + right, at)
    return at


def _packed(bins: np.ndarray) -> pa.Array:
    n, width = bins.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(bins).tobytes())])


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def cross_validated_r2(data: DataFrame, depths: list[int], leaves: list[int], folds: int, seed: int = 42) -> dict[tuple[int, int], list[float]]:
    """R² per fold for each (depth, leaf size). ``data``: label, fold (0 to
    folds - 1) and values (array of doubles)."""
    spark = data.sparkSession
    ordered = sorted(set(depths))
    data = data.filter(F.col("fold").isNotNull()).select("label", "fold", "values", F.monotonically_increasing_id().alias("row")).persist(StorageLevel.MEMORY_AND_DISK)
    finite = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # noqa: E731, NaN ranks above infinity
    good = finite(F.col("label")) & F.forall("values", finite)
    seen = {r["fold"]: r for r in data.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.var_samp("label").alias("v"), F.first(F.size("values")).alias("width"), F.every(good).alias("good")).collect()}
    total = sum(r["n"] for r in seen.values())
    size = [total - (seen[k]["n"] if k in seen else 0) for k in range(folds)]
    fault = next((f"the {'test' if size[k] else 'training'} data of fold {k} is empty" for k in range(folds) if not size[k] or k not in seen), None)
    if fault or not all(r["good"] for r in seen.values()):
        data.unpersist()
        raise ValueError(fault or "a label or feature is NULL, NaN or infinite")
    width = seen[0]["width"]

    cuts: list[list[np.ndarray]] = []
    for k in range(folds):
        part = data.filter(F.col("fold") != k)
        if size[k] > THRESHOLD_ROWS:
            part = part.sample(THRESHOLD_ROWS / size[k], seed)
        drawn = part.select("values").toArrow()["values"].combine_chunks()
        values = drawn.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        cuts.append([thresholds(values[:, f], min(MAX_BINS, size[k]) - 1) for f in range(width)])
    widths = [[len(c) + 1 for c in fold] for fold in cuts]

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            bins = np.stack([np.searchsorted(c, values[:, f]) for fold in cuts for f, c in enumerate(fold)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), _packed(bins)], names=["label", "fold", "row", "bins"])

    binned = data.mapInArrow(bin_, "label double, fold int, row bigint, bins binary").persist(StorageLevel.MEMORY_AND_DISK)
    fits = [(k, leaf) for k in range(folds) for leaf in leaves]
    trees = [_Tree(size[k]) for k, _ in fits]

    def read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(3), folds * width).reshape(-1, folds, width)

    try:
        while any("wide" in t.state for t in trees):
            for r in _level(binned, fits, [t.arrays() for t in trees], [t.stats for t in trees], widths, read).collect():
                trees[r["fit"]].split(r["node"], r["feature"], r["cut"], *(np.array(r[x]) for x in ("stats", "lefts", "rights")), fits[r["fit"]][1], ordered[-1])
        errors = _errors(binned, fits, trees, widths, ordered, read, folds * len(leaves) * total)
        lost = {(r["fit"], r["depth"]): r["lost"] for r in errors.groupBy("fit", "depth").agg(F.sum("lost").alias("lost")).collect()}
    finally:
        binned.unpersist()
        data.unpersist()
    spread = [(seen[k]["v"] or 0.0) * (seen[k]["n"] - 1) for k in range(folds)]
    with np.errstate(divide="ignore", invalid="ignore"):
        return {(d, leaf): [float(1.0 - np.float64(lost.get((i, d), 0.0)) / np.float64(spread[k])) for i, (k, m) in enumerate(fits) if m == leaf] for d in ordered for leaf in leaves}


def _level(binned: DataFrame, fits, trees, stats, widths, read) -> DataFrame:
    """Splits all wide nodes: a row per (fit, node)."""
    wide = [np.flatnonzero(t[3] == "wide") for t in trees]
    known = [{int(i): s[i] for i in w} for w, s in zip(wide, stats)]
    names = ["fit", "node", "feature", "bin", "n", "s", "q"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            label, fold, bins = read(b)
            for i, (k, _) in enumerate(fits):
                if not len(wide[i]):
                    continue
                mine = bins[fold != k, k]
                at = _placed(trees[i], mine)
                number = np.full(len(trees[i][3]), -1)
                number[wide[i]] = np.arange(len(wide[i]))
                some = number[at] >= 0
                at, mine, y = number[at[some]], mine[some], label[fold != k][some]
                for f, w in enumerate(widths[k]):
                    key, size = at * w + mine[:, f], len(wide[i]) * w
                    add = np.stack([np.bincount(key, x, size) for x in (None, y, y * y)])
                    sums[i, f] = sums[i, f] + add if (i, f) in sums else add
        for (i, f), x in sums.items():
            cell = np.flatnonzero(x[0])
            w = widths[fits[i][0]][f]
            full = lambda v: np.full(len(cell), v, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (full(i), wide[i][cell // w].astype(np.int64), full(f), (cell % w).astype(np.int32), *x[:, cell])], names=names)

    def choose(got: pa.Table) -> pa.Table:
        i, node = got["fit"][0].as_py(), got["node"][0].as_py()
        (k, leaf), feature, bin_ = fits[i], got["feature"].to_numpy(), got["bin"].to_numpy()
        sums = np.stack([got[x].to_numpy() for x in ("n", "s", "q")])

        def cells(f: int) -> np.ndarray:
            out = np.zeros((3, 1, widths[k][f]))
            out[:, 0, bin_[feature == f]] = sums[:, feature == f]
            return out

        parent = known[i][node]
        f, cut, own, left, right = best_splits(cells, widths[k], None if parent is None else parent[:, None], leaf)
        return pa.table({"fit": pa.array([i], pa.int32()), "node": [node], "feature": pa.array(f, pa.int32()), "cut": pa.array(cut, pa.int32()), "stats": [own[:, 0].tolist()], "lefts": [left[:, 0].tolist()], "rights": [right[:, 0].tolist()]})

    cells = binned.mapInArrow(count, "fit int, node bigint, feature int, bin int, n double, s double, q double")
    cells = cells.groupBy(*names[:4]).agg(*[F.sum(x).alias(x) for x in names[4:]])
    return cells.groupBy("fit", "node").applyInArrow(choose, "fit int, node bigint, feature int, cut int, stats array<double>, lefts array<double>, rights array<double>")


def _errors(binned: DataFrame, fits, grown_: list[_Tree], widths, depths: list[int], read, volume: int) -> DataFrame:
    """Sums of squared errors of test rows: (fit, depth, lost)."""
    trees = [t.arrays() for t in grown_]
    guesses = [[t.guesses(d) for d in depths] for t in grown_]
    local = [{i: (t.level[i], t.stats[i]) for i, s in enumerate(t.state) if s == "local"} for t in grown_]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(fits), len(depths)))
        for b in batches:
            label, fold, bins = read(b)
            for i, (k, _) in enumerate(fits):
                mine = fold == k
                at = _placed(trees[i], bins[mine, k])
                for j, guess in enumerate(guesses[i]):
                    sums[i, j] += np.nansum((label[mine] - guess[at]) ** 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(fits), dtype=np.int32), len(depths))), pa.array(np.tile(np.array(depths, np.int32), len(fits))), pa.array(sums.ravel())], names=["fit", "depth", "lost"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            label, fold, bins = read(b)
            for i, (k, _) in enumerate(fits):
                at = _placed(trees[i], bins[:, k])
                to = np.flatnonzero(trees[i][3][at] == "local")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), i, np.int32)), pa.array(at[to]), b.column(2).take(pa.array(to)), pa.array(label[to]), pa.array(fold[to] == k), _packed(bins[to, k])], names=["fit", "node", "row", "label", "test", "bins"])

    def grow(got: pa.Table) -> pa.Table:
        i, node = got["fit"][0].as_py(), got["node"][0].as_py()
        (k, leaf), (level, stats) = fits[i], local[i][node]
        got = got.take(pa.array(np.argsort(got["row"].to_numpy())))
        lost = grown(_matrix(got["bins"], len(widths[k])), got["label"].to_numpy(), got["test"].to_numpy().astype(bool), widths[k], level, None if stats is None else stats[:, None], leaf, [d for d in depths if d >= level])
        return pa.table({"fit": pa.array([i] * len(lost), pa.int32()), "depth": pa.array(list(lost), pa.int32()), "lost": pa.array(list(lost.values()), pa.float64())})

    kind = "fit int, depth int, lost double"
    tasks = max(4 * binned.sparkSession.sparkContext.defaultParallelism, volume // (25 * LOCAL_ROWS))
    dealt = binned.mapInArrow(deal, "fit int, node bigint, row bigint, label double, test boolean, bins binary").repartition(tasks, "fit", "node")
    return binned.mapInArrow(answer, kind).unionByName(dealt.groupBy("fit", "node").applyInArrow(grow, kind))
