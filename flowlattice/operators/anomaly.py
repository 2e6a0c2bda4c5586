"""Anomalies among accounts: an isolation forest (Liu, Ting and Zhou, 2008) over the numeric features.

Trees are grown on the driver from a bounded sample of accounts, chosen by a hash of the account: each from ``TREE_ROWS`` rows,
by random features and random cuts, to a depth of log2 of that.  All accounts are then scored in the engine: the trees
are one constant, and a row's path through each is a fold of column expressions, so no row passes through Python.

An account's score is 2^(-mean path / usual path): above about 0.6 it is set apart by few cuts, at 0.5 it is like the rest.
An extension; thresholds are for people to choose.  Nulls and NaN count as 0.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlattice.functions.columns import number
from flowlattice.operators.features import FEATURES

#: Accounts that trees are grown from at most, rows of a tree, trees, and the seed of their cuts.
SAMPLE, TREE_ROWS, TREES, SEED = 4096, 256, 100, 20_008
#: Features that are no numbers.
TEXT = ("account_id", "bank_name", "bank_id", "entity_id", "entity_name")
NUMERIC = tuple(c for c in FEATURES if c not in TEXT)
_TREE = "array<struct<f:array<int>,cut:array<double>,left:array<int>,path:array<double>>>"


def usual_path(n: int) -> float:
    """The mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grown(rows: np.ndarray, rng: np.random.Generator, depth: int) -> dict[str, list]:
    """A tree as lists by node: feature (-1: a leaf), cut, left child (the right one follows it), path length of a leaf."""
    tree: dict[str, list] = {"f": [], "cut": [], "left": [], "path": []}

    def add() -> int:
        for name, value in (("f", -1), ("cut", 0.0), ("left", 0), ("path", 0.0)):
            tree[name].append(value)
        return len(tree["f"]) - 1

    waiting = [(add(), rows, 0)]
    while waiting:
        node, own, level = waiting.pop()
        low, high = own.min(axis=0), own.max(axis=0)
        free = np.flatnonzero(high > low)
        if level >= depth or len(own) < 2 or not len(free):
            tree["path"][node] = level + usual_path(len(own))
            continue
        f = int(rng.choice(free))
        cut = float(rng.uniform(low[f], high[f]))
        left, right = add(), add()
        tree["f"][node], tree["cut"][node], tree["left"][node] = f, cut, left
        below = own[:, f] <= cut
        waiting += [(left, own[below], level + 1), (right, own[~below], level + 1)]
    return tree


def forest(features: DataFrame) -> list[dict[str, list]]:
    """Trees of a bounded sample of a feature table; the same ones on every run."""
    values = F.array(*(number(features, c) for c in NUMERIC))
    some = features.select("account_id", values.alias("x")).orderBy(F.xxhash64("account_id"), "account_id").limit(SAMPLE).collect()
    rows = np.array([r.x for r in some], np.float64).reshape(-1, len(NUMERIC))
    rng = np.random.default_rng(SEED)
    take = min(TREE_ROWS, len(rows))
    depth = max(1, math.ceil(math.log2(max(take, 2))))
    return [grown(rows[rng.choice(len(rows), take, replace=False)], rng, depth) for _ in range(TREES)] if take else []


def anomaly_scores(features: DataFrame) -> DataFrame:
    """account_id and anomaly_score (0 to 1; null if there was nothing to grow trees from), for every row of a feature table."""
    trees = forest(features)
    if not trees:
        return features.select("account_id", F.lit(None).cast("double").alias("anomaly_score"))
    rows = min(TREE_ROWS, features.count())
    steps = max(1, math.ceil(math.log2(max(rows, 2))))
    made = F.from_json(F.lit(json.dumps(trees)), _TREE)
    x = features.select("account_id", F.array(*(number(features, c) for c in NUMERIC)).alias("x"))

    def path(tree):  # noqa: ANN001, ANN202
        at = lambda name, node: F.get(tree[name], node)
        child = lambda node, _: F.when(at("f", node) < 0, node).otherwise(at("left", node) + F.when(F.get("x", at("f", node)) <= at("cut", node), 0).otherwise(1))
        return at("path", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0), child))

    total = F.aggregate(F.transform(made, path), F.lit(0.0), lambda a, b: a + b)
    usual = usual_path(rows) or 1.0
    return x.select("account_id", F.round(F.pow(F.lit(2.0), -total / F.lit(len(trees) * usual)), 9).alias("anomaly_score"))
