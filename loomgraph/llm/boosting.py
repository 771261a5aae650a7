"""A small gradient-boosted tree classifier, written out as SQL: scoring is an SQL expression.

fitted() takes a table of labelled rows of any size: tasks sum the gradients of their rows by leaf, feature and value, and
only these sums, whose number the features' values bound, reach the driver, which chooses the splits. Boosted.fit is for
rows at hand.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import cut

#: Whole numbers up to this are told apart by the trees; beyond it eight to a doubling are.
EXACT = 64
#: A gradient's unit: sums of whole numbers are the same in any order.
UNIT = 1 << 20


@dataclass
class Tree:
    feature: int = -1
    cut: float = 0.0
    left: "Tree | None" = None
    right: "Tree | None" = None
    value: float = 0.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        low = x[:, self.feature] <= self.cut
        out = np.empty(len(x))
        out[low], out[~low] = self.left.predict(x[low]), self.right.predict(x[~low])
        return out

    def leaves(self) -> list["Tree"]:
        return [self] if self.left is None else self.left.leaves() + self.right.leaves()

    def leaf_sql(self, names: list[str], first: int = 0) -> str:
        """The number of a row's leaf, as in leaves()."""
        if self.left is None:
            return str(first)
        return f"CASE WHEN {names[self.feature]} <= {self.cut:.4f}D THEN {self.left.leaf_sql(names, first)} ELSE {self.right.leaf_sql(names, first + len(self.left.leaves()))} END"

    def sql(self, names: list[str]) -> str:
        if self.left is None:
            return f"{self.value:.6f}D"
        return f"CASE WHEN {names[self.feature]} <= {self.cut:.4f}D THEN {self.left.sql(names)} ELSE {self.right.sql(names)} END"


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, least: float = 4.0) -> Tree:
    """Newton step leaves; splits by gain of the second-order loss; ties go to the earlier feature and lower cut."""
    leaf = Tree(value=rate * float(g.sum() / (h.sum() + 1.0)))
    if depth == 0 or h.sum() < 2 * least / 4:
        return leaf
    best, at = 1e-6, None
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order]), np.cumsum(h[order])
        ok = np.nonzero(v[1:] > v[:-1])[0]
        if not len(ok):
            continue
        gain = cg[ok] ** 2 / (ch[ok] + 1) + (cg[-1] - cg[ok]) ** 2 / (ch[-1] - ch[ok] + 1) - base
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, at = gain[k], (f, float(v[ok[k]] + v[ok[k] + 1]) / 2)
    if at is None:
        return leaf
    low = x[:, at[0]] <= at[1]
    return Tree(at[0], at[1], _grow(x[low], g[low], h[low], depth - 1, rate, least), _grow(x[~low], g[~low], h[~low], depth - 1, rate, least))


class Boosted:
    """Logistic boosting."""

    def __init__(self, trees: int = 20, depth: int = 3, rate: float = 0.3):
        self.n, self.depth, self.rate, self.bias, self.trees = trees, depth, rate, 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        share = min(max(float(y.mean()), 0.01), 0.99)
        self.bias = float(np.log(share / (1 - share)))
        f = np.full(len(y), self.bias)
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            self.trees.append(_grow(x, y - p, p * (1 - p), self.depth, self.rate))
            f += self.trees[-1].predict(x)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + sum(t.predict(x) for t in self.trees))))

    def sql(self, names: list[str]) -> str:
        return f"1D / (1D + exp(-({self.bias:.6f}D + {' + '.join(t.sql(names) for t in self.trees)})))"


def binned(value: Column) -> Column:
    """A whole number from 0 on, from EXACT on its leading four bits: the least number that the trees don't tell from it."""
    v = value.cast("long")
    return F.when(v <= EXACT, v).otherwise(v - F.pmod(v, F.pow(F.lit(2.0), F.length(F.bin(v)) - 4).cast("long")))


def _sums(rows: DataFrame, names: list[str], model: Boosted) -> dict[int, dict[int, np.ndarray]]:
    """Of the last tree's leaves, by feature: (value, gradients, hessians) by ascending value, over all rows (g, h)."""
    each = rows.select(F.expr(model.trees[-1].leaf_sql(names)).alias("leaf"), "g", "h", F.posexplode(F.array(*names)).alias("feature", "value"))
    out: dict[int, dict[int, list]] = {}
    # A row a leaf, feature and value, which binned() keeps to some hundreds.
    for r in each.groupBy("leaf", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
        out.setdefault(r["leaf"], {}).setdefault(r["feature"], []).append((r["value"], r["g"], r["h"]))
    return {k: {f: np.array(sorted(v)) for f, v in of.items()} for k, of in out.items()}


def _split(leaf: Tree, sums: dict[int, np.ndarray], rate: float) -> None:
    """_grow's split of one leaf, from sums; the two new leaves get their Newton steps."""
    total_g, total_h = (float(next(iter(sums.values()))[:, k].sum()) / UNIT for k in (1, 2))
    if total_h < 2.0:
        return
    best, at = 1e-6, None
    for f in sorted(sums):
        v, cg, ch = sums[f][:, 0], np.cumsum(sums[f][:, 1])[:-1] / UNIT, np.cumsum(sums[f][:, 2])[:-1] / UNIT
        if not len(cg):
            continue
        gain = cg**2 / (ch + 1) + (total_g - cg) ** 2 / (total_h - ch + 1) - total_g**2 / (total_h + 1)
        k = int(np.argmax(gain))
        if gain[k] > best:
            # Between exact numbers in the middle; else where the next bin begins, as a bin's numbers go one way.
            best, at = gain[k], (f, float(v[k] + v[k + 1]) / 2 if v[k + 1] <= EXACT else float(v[k + 1]) - 0.5, cg[k], ch[k])
    if at is not None:
        leaf.feature, leaf.cut = at[0], at[1]
        leaf.left, leaf.right = (Tree(value=round(rate * float(g / (h + 1)), 6)) for g, h in ((at[2], at[3]), (total_g - at[2], total_h - at[3])))


def fitted(rows: DataFrame, names: list[str], trees: int = 20, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Boosted.fit for a table: rows (names of binned() whole numbers, y 0 or 1, n: how many rows this one stands for).

    Each level of a tree is one pass over the rows. The sums are of whole numbers, so neither the order of the rows nor
    their partitions change a tree. The rows are few, as equal ones are one. A table without rows gives trees that know nothing.
    """
    model = Boosted(trees, depth, rate)
    n, yes = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.col("n") * F.col("y")), F.lit(0))).first()
    share = min(max(float(yes) / n if n else 0.0, 0.01), 0.99)
    model.bias = round(float(np.log(share / (1 - share))), 6)
    rows = rows.withColumn("f", F.lit(model.bias))
    for _ in range(trees if n else 0):
        # What a row has of the trees so far is written with it, so that an expression holds one tree.
        p = 1 / (1 + F.exp(-F.col("f")))
        units = lambda v: F.round(v * UNIT).cast("long") * F.col("n")
        rows = cut(rows.select(*names, "y", "n", "f", units(F.col("y") - p).alias("g"), units(p * (1 - p)).alias("h")))
        model.trees.append(Tree())
        for level in range(depth):
            sums, leaves = _sums(rows, names, model), model.trees[-1].leaves()
            for k, of in sums.items():
                _split(leaves[k], of, rate)
            if len(model.trees[-1].leaves()) == len(leaves):
                break
        rows = rows.withColumn("f", F.col("f") + F.expr(model.trees[-1].sql(names)))
    model.trees = model.trees or [Tree()]
    return model


def threshold(score: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | None = None) -> float:
    """The lowest score at and above which the share of positives among held-out rows is at least `precision`; n: times of each row."""
    order = np.argsort(-score, kind="stable")
    n = np.ones(len(y)) if n is None else n
    good = np.cumsum((y * n)[order]) / np.cumsum(n[order])
    last = np.append(np.diff(score[order]) != 0, True)
    ok = np.nonzero((good >= precision) & last)[0]
    return float(score[order][ok[-1]]) if len(ok) else 1.1
