"""Tree ensembles: all compare modes, missing values, classes and transforms, in Arrow batches and as joins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TESTS = {
    "BRANCH_LEQ": lambda x, t: x <= t, "BRANCH_LT": lambda x, t: x < t, "BRANCH_GTE": lambda x, t: x >= t,
    "BRANCH_GT": lambda x, t: x > t, "BRANCH_EQ": lambda x, t: x == t, "BRANCH_NEQ": lambda x, t: x != t,
}
_MODES = tuple(_TESTS)


@dataclass
class Ensemble:
    """Flat node arrays of all trees. ``mode`` is -1 at leaves, whose weights are rows ``start`` to ``end`` of ``leaf_class`` and ``leaf_weight``."""

    n_features: int
    n_classes: int
    roots: np.ndarray
    feature: np.ndarray
    mode: np.ndarray
    threshold: np.ndarray
    yes: np.ndarray
    no: np.ndarray
    nan_yes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    leaf_class: np.ndarray
    leaf_weight: np.ndarray
    base: np.ndarray
    post: str

    @property
    def positive(self) -> int:
        """The class whose score is the result: the only one that leaves name, in a model of one or two classes, else the second."""
        return 0 if self.n_classes < 3 and not self.leaf_class.any() else 1


def ensemble(nodes: list[tuple], leaves: list[tuple], n_features: int, n_classes: int, base: list[float], post: str) -> Ensemble:
    """From ``(tree, node, feature, mode, threshold, yes, no, nan_yes)`` and ``(tree, node, class, weight)``, in any order."""
    nodes, leaves = sorted(nodes), sorted(leaves)
    place = {(n[0], n[1]): k for k, n in enumerate(nodes)}
    column = lambda k, kind: np.array([n[k] for n in nodes], kind)
    mode = np.array([-1 if n[3] == "LEAF" else _MODES.index(n[3]) for n in nodes], np.int64)
    go = lambda k: np.array([place[n[0], n[k]] if n[3] != "LEAF" else 0 for n in nodes], np.int64)
    at = np.array([place[x[0], x[1]] for x in leaves], np.int64)
    if (mode[at] >= 0).any():
        raise ValueError("a leaf's weight belongs to a branch")
    roots = [k for k, n in enumerate(nodes) if k == 0 or nodes[k - 1][0] != n[0]]
    return Ensemble(
        n_features, n_classes, np.array(roots), column(2, np.int64), mode, column(4, np.float32), go(5), go(6), column(7, bool), np.searchsorted(at, np.arange(len(nodes)), "left"), np.searchsorted(at, np.arange(len(nodes)), "right"),
        np.array([x[2] for x in leaves], np.int64), np.array([x[3] for x in leaves], np.float64), np.array(base or [0.0] * n_classes), post,
    )


def simple(trees: dict) -> Ensemble:
    """From ``base`` and node tables ``(feature, threshold, left, right, value)``: at most goes left as missing does, and a sigmoid."""
    nodes, leaves, most = [], [], 0
    for t, table in enumerate(trees["trees"]):
        for k, (feature, threshold, left, right, value) in enumerate(table):
            nodes.append((t, k, max(feature, 0), "LEAF" if feature < 0 else "BRANCH_LEQ", threshold, left, right, True))
            most = max(most, feature)
            if feature < 0:
                leaves.append((t, k, 0, value))
    return ensemble(nodes, leaves, most + 1, 1, [trees["base"]], "LOGISTIC")


def from_tables(nodes: DataFrame, leaves: DataFrame, ensembles: DataFrame) -> dict[str, list[Ensemble]]:
    """All ensembles of a model's tables by route, seeds in order; what comes to the driver is the model itself."""
    key = ["route", "seed"]
    n = nodes.groupBy(*key).agg(F.collect_list(F.struct("tree", "node", "feature", "mode", "threshold", "yes", "no", "nan_yes")).alias("nodes"))
    m = leaves.groupBy(*key).agg(F.collect_list(F.struct("tree", "node", "class", "weight")).alias("leaves"))
    out: dict[str, list[Ensemble]] = {}
    for r in ensembles.join(n, key).join(m, key).orderBy(*key).collect():
        out.setdefault(r.route, []).append(ensemble([tuple(x) for x in r.nodes], [tuple(x) for x in r.leaves], r.n_features, r.n_classes, list(r.base_values), r.post_transform))
    return out


def _walk(e: Ensemble, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree."""
    at = np.broadcast_to(e.roots, (len(x), len(e.roots))).copy()
    row = np.arange(len(x))[:, None]
    while (inner := e.mode[at] >= 0).any():
        v, t, mode = x[row, e.feature[at]], e.threshold[at], e.mode[at]
        go = np.zeros(at.shape, bool)
        for k, name in enumerate(_MODES):
            if (mine := mode == k).any():
                go |= mine & _TESTS[name](v, t)
        go = np.where(np.isnan(v), e.nan_yes[at], go)
        at = np.where(inner, np.where(go, e.yes[at], e.no[at]), at)
    return at


def predict(e: Ensemble, x: np.ndarray) -> np.ndarray:
    """Scores of rows of single-precision features, the sums in double precision."""
    x = np.asarray(x, np.float32)
    if x.shape[1] < e.n_features:
        raise ValueError(f"vectors have {x.shape[1]} features, the trees expect {e.n_features}")
    weight = np.zeros((len(e.mode), e.n_classes))
    for n in np.flatnonzero(e.mode < 0):
        np.add.at(weight[n], e.leaf_class[e.start[n] : e.end[n]], e.leaf_weight[e.start[n] : e.end[n]])
    score = weight[_walk(e, x)].sum(1) + e.base
    if e.post == "LOGISTIC":
        score = 1 / (1 + np.exp(-score))
    elif e.post == "SOFTMAX":
        score = np.exp(score - score.max(1, keepdims=True))
        score /= score.sum(1, keepdims=True)
    return score[:, e.positive]


def score(rows: DataFrame, e: Ensemble, vec: str = "features", out: str = "raw") -> DataFrame:
    """Add ``out``, the ensemble's score of the array column ``vec``; a null component is missing, as NaN is."""
    shared = rows.sparkSession.sparkContext.broadcast(e)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for s in batches:
            yield pd.Series(predict(model, np.stack(s.to_list()).astype(np.float32)) if len(s) else [], dtype="float64")

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return rows.withColumn(out, F.pandas_udf(of, "double")(F.col(vec)))


def paths(e: Ensemble) -> tuple[list[tuple], list[tuple]]:
    """Trees as tables: what must hold on the way to each leaf ``(leaf, n_tests, feature, mode, threshold, nan_yes, want)``, and leaves without a test."""
    tests, free = [], []
    for root in e.roots.tolist():
        todo = [(root, [])]
        while todo:
            node, way = todo.pop()
            if e.mode[node] < 0:
                tests += [(node, len(way), *t) for t in way]
                free += [(node,)] if not way else []
                continue
            step = (int(e.feature[node]), _MODES[e.mode[node]], float(e.threshold[node]), bool(e.nan_yes[node]))
            todo += [(int(e.yes[node]), [*way, (*step, True)]), (int(e.no[node]), [*way, (*step, False)])]
    return tests, free


def score_by_paths(rows: DataFrame, e: Ensemble, key: str = "id", vec: str = "features", out: str = "raw") -> DataFrame:
    """``(key, out)`` of the same scores by joins: a row is in the leaf all of whose tests hold for it.

    ``key`` tells rows apart. The tables of tests and leaves are the model's own, and broadcast.
    """
    spark = rows.sparkSession
    tests, free = paths(e)
    leaves = [(n, int(c), float(w)) for n in np.flatnonzero(e.mode < 0).tolist() for c, w in zip(e.leaf_class[e.start[n] : e.end[n]], e.leaf_weight[e.start[n] : e.end[n]], strict=True)]
    test = F.broadcast(spark.createDataFrame(tests, "leaf long, n_tests int, feature int, mode string, threshold float, nan_yes boolean, want boolean"))
    leaf = F.broadcast(spark.createDataFrame(leaves, "leaf long, class int, weight double"))
    cells = rows.select(key, F.posexplode(vec).alias("feature", "x")).withColumn("x", F.col("x").cast("float"))
    x, t = F.col("x"), F.col("threshold")
    holds = F.lit(None).cast("boolean")
    for name, of in _TESTS.items():
        holds = F.when(F.col("mode") == name, of(x, t)).otherwise(holds)
    holds = F.when(x.isNull() | F.isnan(x), F.col("nan_yes")).otherwise(holds)
    met = cells.join(test, "feature").where(holds == F.col("want")).groupBy(key, "leaf").agg(F.count(F.lit(1)).alias("n"), F.max("n_tests").alias("of")).where("n = of")
    sums = [F.coalesce(F.sum(F.when(F.col("class") == c, F.col("weight"))), F.lit(0.0)).alias(f"s{c}") for c in range(e.n_classes)]
    got = rows.select(key).join(met.select(key, "leaf").join(leaf, "leaf").groupBy(key).agg(*sums), key, "left")
    always = e.base.copy()
    for (n,) in free:
        np.add.at(always, e.leaf_class[e.start[n] : e.end[n]], e.leaf_weight[e.start[n] : e.end[n]])
    total = [F.coalesce(f"s{c}", F.lit(0.0)) + F.lit(float(always[c])) for c in range(e.n_classes)]
    return got.select(key, _post(total, e).alias(out))


def _post(total: list[Column], e: Ensemble) -> Column:
    mine = total[e.positive]
    if e.post == "LOGISTIC":
        return 1 / (1 + F.exp(-mine))
    if e.post == "SOFTMAX":
        top = F.greatest(*total) if len(total) > 1 else total[0]
        whole = F.exp(total[0] - top)
        for t in total[1:]:
            whole = whole + F.exp(t - top)
        return F.exp(mine - top) / whole
    return mine
