"""Cell classifiers: forests and boosted trees on features, and a grid model trained by structured learning.

Inference on the grid is max-product message passing, an approximation: scores of exact
or quadratic-programming solvers aren't claimed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import DROPPED, UNARY
from .metrics import class_weights, file_macro_f1, macro

STATES = ("EMPTY", "HEADER", "DATA", "TITLE", "OTHER")
#: Forests by name, as (trees, depth, features of a split, least rows of a leaf, bootstrap, features).
FORESTS = {
    "all": (574, 20, "sqrt", 6, False, UNARY),
    "selected": (481, 20, "log2", 7, True, tuple(n for i, n in enumerate(UNARY) if i not in DROPPED)),
}
#: A penalty above this would overflow solvers that scale it to 32 bits.
MOST_PENALTY = 2_000_000


def with_weights(rows: DataFrame, label: str = "y") -> DataFrame:
    """Rows with ``weight``, inverse to their class's frequency (a handful of classes, broadcast)."""
    return rows.join(F.broadcast(class_weights(rows, label=label, classes=len(STATES)).select(label, "weight")), label)


def forest(name: str = "all", trees: int | None = None, depth: int | None = None, label: str = "y", seed: int = 2112) -> Pipeline:
    n, d, split, leaf, bootstrap, columns = FORESTS[name]
    classifier = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", numTrees=trees or n, maxDepth=depth or d, featureSubsetStrategy=split, minInstancesPerNode=leaf, bootstrap=bootstrap, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), classifier])


def boosted(rounds: int = 40, depth: int = 6, label: str = "y", seed: int = 2112, columns: tuple[str, ...] = UNARY) -> Pipeline:
    """Boosted trees, one against the rest; not the same learner as histogram boosting of several classes."""
    rest = OneVsRest(classifier=GBTClassifier(featuresCol="features", maxIter=rounds, maxDepth=depth, seed=seed), featuresCol="features", labelCol=label, weightCol="weight")
    return Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="features"), rest])


def probabilities(scored: DataFrame, states: int = len(STATES)) -> DataFrame:
    """Scored rows with ``p``, an array of ``states`` probabilities; an error if the model has another number of classes."""
    p = vector_to_array(F.col("probability"))
    message = F.concat(F.lit(f"not {states} classes: "), F.size(p).cast("string"))
    return scored.withColumn("p", F.when(F.size(p) == states, p).otherwise(F.raise_error(message).cast("array<double>")))


def clamped(scores: Column, is_empty: Column, penalty: float = 1e6, empty: int = 0) -> Column:
    """An array of class scores: of empty cells all but the empty class lose the penalty, of others the empty class."""
    if penalty > MOST_PENALTY:
        raise ValueError(f"a penalty of {penalty} is above {MOST_PENALTY}")
    return F.transform(scores, lambda s, i: F.when((i == empty) == is_empty, s).otherwise(s - penalty))


def weighted_loss(rows: DataFrame, keys: list[str], y: str = "y", yhat: str = "yhat", weight: str = "weight") -> DataFrame:
    """(keys, loss, most): weights of wrong cells, and of all cells."""
    return rows.groupBy(*keys).agg(F.sum(F.when(F.col(y) != F.col(yhat), F.col(weight)).otherwise(0.0)).alias("loss"), F.sum(weight).alias("most"))


def continuous_loss(rows: DataFrame, keys: list[str], y: str = "y", p: str = "p", weight: str = "weight") -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.col(weight) * (1 - F.get(p, F.col(y)))).alias("loss"))


def max_product(unary: np.ndarray, pair: np.ndarray, edges: np.ndarray, rounds: int = 25, damping: float = 0.5) -> np.ndarray:
    """States of highest approximate max-marginals; unary (nodes, states), pair (edges, states, states), edges (edges, 2)."""
    if not len(edges):
        return unary.argmax(1)
    a, b = edges[:, 0], edges[:, 1]
    ab, ba = np.zeros((len(edges), unary.shape[1])), np.zeros((len(edges), unary.shape[1]))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, b, ab)
        np.add.at(belief, a, ba)
        new_ab = (pair + (belief[a] - ba)[:, :, None]).max(1)
        new_ba = (pair + (belief[b] - ab)[:, None, :]).max(2)
        ab = damping * ab + (1 - damping) * (new_ab - new_ab.max(1, keepdims=True))
        ba = damping * ba + (1 - damping) * (new_ba - new_ba.max(1, keepdims=True))
    belief = unary.copy()
    np.add.at(belief, b, ab)
    np.add.at(belief, a, ba)
    return belief.argmax(1)


@dataclass
class GridModel:
    """Linear potentials of cells (features x states) and of neighbours (features x states x states)."""

    n_unary: int
    n_pair: int
    states: int = len(STATES)
    penalty: float = 1e6
    clamp: bool = True
    w: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.penalty > MOST_PENALTY:
            raise ValueError(f"a penalty of {self.penalty} is above {MOST_PENALTY}")
        if self.w is None:
            self.w = np.zeros(self.n_unary * self.states + self.n_pair * self.states**2)

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        cut = self.n_unary * self.states
        return self.w[:cut].reshape(self.n_unary, self.states), self.w[cut:].reshape(self.n_pair, self.states**2)

    def potentials(self, x: np.ndarray, f: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        u, p = self.parts()
        unary = x @ u
        if self.clamp:
            unary[empty, 1:] -= self.penalty
            unary[~empty, 0] -= self.penalty
        return unary, (f @ p).reshape(-1, self.states, self.states)

    def joint(self, x: np.ndarray, f: np.ndarray, edges: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of features by state, and of neighbour features by pair of states."""
        one = np.eye(self.states)[y]
        two = np.eye(self.states**2)[y[edges[:, 0]] * self.states + y[edges[:, 1]]] if len(edges) else np.zeros((0, self.states**2))
        return np.concatenate([(x.T @ one).reshape(-1), (f.T @ two).reshape(-1)])


def _arrays(nodes: pd.DataFrame, edges: pd.DataFrame, n_pair: int):
    nodes = nodes.sort_values(["r", "c"])
    at = {k: i for i, k in enumerate(zip(nodes["r"], nodes["c"]))}
    pairs = np.array([(at[r, c], at[r2, c2]) for r, c, r2, c2 in zip(edges["r"], edges["c"], edges["r2"], edges["c2"])], np.int64).reshape(-1, 2)
    f = np.stack(edges["f"].to_numpy()) if len(edges) else np.zeros((0, n_pair))
    return nodes, np.stack(nodes["x"].to_numpy()), f, pairs, nodes["is_empty"].to_numpy(bool)


def _by_sheet(nodes: DataFrame, edges: DataFrame):
    """Both tables grouped together by sheet; the edges' columns get new identities, as they may come from the nodes' own table."""
    edges = edges.select(*[F.col(c).alias(f"_{c}") for c in edges.columns]).toDF(*edges.columns)
    return nodes.groupBy(F.col("sheet_id")).cogroup(edges.groupBy(F.col("sheet_id")))


def grid_predict(nodes: DataFrame, edges: DataFrame, model: GridModel) -> DataFrame:
    """(sheet_id, r, c, yhat) from nodes (sheet_id, r, c, x, is_empty) and edges (sheet_id, r, c, r2, c2, f)."""

    def kernel(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"sheet_id": [], "r": [], "c": [], "yhat": []})
        n, x, f, pairs, empty = _arrays(n, e, model.n_pair)
        return pd.DataFrame({"sheet_id": n["sheet_id"].to_numpy(), "r": n["r"].to_numpy(), "c": n["c"].to_numpy(), "yhat": max_product(*model.potentials(x, f, empty), pairs)})

    return _by_sheet(nodes, edges).applyInPandas(kernel, "sheet_id long, r int, c int, yhat int")


def _violations(now: GridModel, cost: np.ndarray):
    """Kernel of a sheet: difference of joint features between its labels and those that violate the margin most, the loss (-1) and a count (-2)."""

    def kernel(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({"i": [], "d": []})
        n, x, f, pairs, empty = _arrays(n, e, now.n_pair)
        y = n["y"].to_numpy(int)
        unary, pair = now.potentials(x, f, empty)
        wrong = np.tile(cost[y][:, None], (1, now.states))
        wrong[np.arange(len(y)), y] = 0
        guess = max_product(unary + wrong, pair, pairs)
        d = now.joint(x, f, pairs, y) - now.joint(x, f, pairs, guess)
        i = np.flatnonzero(d)
        return pd.DataFrame({"i": np.append(i, [-1, -2]), "d": np.append(d[i], [float((cost[y] * (y != guess)).sum()), 1.0])})

    return kernel


def grid_fit(nodes: DataFrame, edges: DataFrame, model: GridModel, weights: dict[int, float] | None = None, rounds: int = 10, c: float = 1.0, sample: float | None = None, validation: tuple[DataFrame, DataFrame] | None = None, patience: int = 3, seed: int = 2112) -> tuple[GridModel, list[dict]]:
    """Structured learning by subgradients: in each round the sheets find the labels that violate their margin most.

    Executors add up the differences of joint features; the driver gets one vector, as
    long as the weights, whatever the data. sample: share of sheets in a round. With
    ``validation`` (nodes with y, edges) the weights of its best macro F1 are kept and
    ``patience`` rounds without a better one end it.
    """
    weights = weights or {}
    cost = np.array([weights.get(k, 1.0) for k in range(model.states)])
    log, best, kept, idle = [], -1.0, model.w.copy(), 0
    for step in range(1, rounds + 1):
        part = nodes if sample is None else nodes.where(F.pmod(F.xxhash64("sheet_id", F.lit(seed + step)), F.lit(1_000_000)) < int(sample * 1_000_000))
        now = GridModel(model.n_unary, model.n_pair, model.states, model.penalty, model.clamp, model.w.copy())

        sums = {r["i"]: r["d"] for r in _by_sheet(part, edges).applyInPandas(_violations(now, cost), "i int, d double").groupBy("i").agg(F.sum("d").alias("d")).collect()}
        sheets = max(1.0, sums.pop(-2, 1.0))
        loss = sums.pop(-1, 0.0)
        gradient = np.zeros_like(model.w)
        for i, d in sums.items():
            gradient[i] = d
        model.w = model.w * (1 - 1 / (step + 1)) + c / (step + 1) * gradient / sheets
        log.append({"round": step, "loss": loss / sheets})
        if validation is not None:
            truth, links = validation
            scored = truth.select("sheet_id", "r", "c", "y").join(grid_predict(truth, links, model), ["sheet_id", "r", "c"])
            f1 = macro(file_macro_f1(scored, "sheet_id")).first()["macro_f1"] or 0.0
            log[-1]["macro_f1"] = f1
            if f1 > best:
                best, kept, idle = f1, model.w.copy(), 0
            else:
                idle += 1
                if idle >= patience:
                    break
    if validation is not None:
        model.w = kept
    return model, log


def save(model: GridModel, spark, path: str) -> None:
    """Weights and flags as one row of Parquet."""
    row = (model.n_unary, model.n_pair, model.states, float(model.penalty), model.clamp, model.w.tolist())
    spark.createDataFrame([row], "n_unary int, n_pair int, states int, penalty double, clamp boolean, w array<double>").write.mode("overwrite").parquet(path)


def load(spark, path: str) -> GridModel:
    r = spark.read.parquet(path).first()
    return GridModel(r["n_unary"], r["n_pair"], r["states"], r["penalty"], r["clamp"], np.array(r["w"]))
