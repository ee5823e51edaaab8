"""Wallets: addresses that transactions show to have one owner, their flows, and outliers."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.core.scratch import Scratch
from webloom.operators.components import connected_components


def input_edges(transactions: DataFrame) -> DataFrame:
    """(src, dst): every input of a transaction with its smallest, as inputs are signed by one owner."""
    rows = transactions.select(F.array_min("inputs").alias("src"), F.explode("inputs").alias("dst"))
    return rows.where("src <> dst")


def clusters(addresses: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """(address, wallet_id): an address with a domain, or that shares inputs with another. The id is
    the wallet's smallest address."""
    known = addresses.where(F.coalesce(F.col("domain"), F.lit("")) != "").select("address").distinct()
    if transactions is None:
        return known.withColumn("wallet_id", F.col("address"))
    linked = connected_components(input_edges(transactions)).select(F.col("node").alias("address"), F.col("component").alias("wallet_id"))
    alone = known.join(linked.select("address"), "address", "left_anti").withColumn("wallet_id", F.col("address"))
    return linked.unionByName(alone)


def flows(members: DataFrame, transactions: DataFrame, id_col: str = "txid") -> DataFrame:
    """(wallet_id, counts and sums of deposits and withdrawals): a transaction counts once for every
    time that one of the wallet's addresses occurs in it; num_distinct_tx counts it once."""
    sides = F.concat(F.coalesce("inputs", F.array()), F.coalesce("outputs", F.array()))
    rows = transactions.select(id_col, "value_usd", "is_deposit", F.explode(sides).alias("address")).join(members, "address")
    each = rows.groupBy("wallet_id", id_col).agg(F.count(F.lit(1)).alias("n"), F.first("value_usd").alias("value_usd"), F.first("is_deposit").alias("is_deposit"))
    n, value = F.col("n"), F.col("n") * F.col("value_usd")
    into = F.col("is_deposit")
    return each.groupBy("wallet_id").agg(
        F.sum(n).alias("num_transactions"),
        F.count(F.lit(1)).alias("num_distinct_tx"),
        F.coalesce(F.sum(F.when(into, n)), F.lit(0)).alias("num_deposits"),
        F.coalesce(F.sum(F.when(~into, n)), F.lit(0)).alias("num_withdrawals"),
        F.coalesce(F.sum(F.when(into, value)), F.lit(0.0)).alias("total_deposits_usd"),
        F.coalesce(F.sum(F.when(~into, value)), F.lit(0.0)).alias("total_withdrawals_usd"),
    )


def wallets(addresses: DataFrame, transactions: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """(wallet_id, size, domains, flows, balance_usd), a row a wallet. members: the clusters, where they
    are known already."""
    members = clusters(addresses, transactions) if members is None else members
    sizes = members.groupBy("wallet_id").agg(F.count(F.lit(1)).alias("size"))
    where = members.join(addresses.where("domain <> ''").select("address", "domain"), "address")
    domains = where.select("wallet_id", "domain").distinct().groupBy("wallet_id").agg(F.array_sort(F.collect_list("domain")).alias("domains"))
    out = sizes.join(domains, "wallet_id", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
    zero = {c: F.lit(0).cast("long") for c in ("num_transactions", "num_distinct_tx", "num_deposits", "num_withdrawals")}
    zero |= {c: F.lit(0.0) for c in ("total_deposits_usd", "total_withdrawals_usd")}
    if transactions is None:
        out = out.withColumns(zero)
    else:
        out = out.join(flows(members, transactions), "wallet_id", "left").withColumns({c: F.coalesce(F.col(c), v) for c, v in zero.items()})
    return out.withColumn("balance_usd", F.col("total_deposits_usd") - F.col("total_withdrawals_usd"))


# -- isolation forest (Liu, Ting and Zhou, 2008) ----------------------------------------------------

TREES, SAMPLE = 100, 256


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, most: int) -> tuple:
    """A tree of x: (rows,) of a leaf, or (feature, cut, below, above)."""
    spread = np.flatnonzero(x.min(axis=0) < x.max(axis=0)) if len(x) else []
    if depth >= most or len(x) <= 1 or not len(spread):
        return (len(x),)
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    left = x[:, f] < cut
    return f, cut, _grow(x[left], rng, depth + 1, most), _grow(x[~left], rng, depth + 1, most)


def _expected(n: np.ndarray | float) -> np.ndarray:
    n = np.asarray(n, float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m, out)


def _depths(tree: tuple, x: np.ndarray, depth: int) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), depth + _expected(tree[0]))
    f, cut, low, high = tree
    left, out = x[:, f] < cut, np.empty(len(x))
    out[left], out[~left] = _depths(low, x[left], depth + 1), _depths(high, x[~left], depth + 1)
    return out


def _sizes(n: int) -> tuple[int, int]:
    """Rows that a tree sees of n, and how deep it grows."""
    size = min(SAMPLE, n)
    return size, int(np.ceil(np.log2(max(size, 2))))


def grown(rows: DataFrame, features: tuple[str, ...], key: str, n: int, seed: int = 42) -> tuple[list[tuple], int]:
    """A forest over `rows`, each tree grown in a task of its own from the SAMPLE rows that come first by the
    tree's own hash. What is collected is the trees, TREES times SAMPLE splits at most.

    A row is handed on only to trees in whose hash it comes early enough to be among four times as many as
    are wanted; that fewer than SAMPLE do so is beyond all odds, and such a tree would only be smaller."""
    size, most = _sizes(n)
    near = F.lit(2.0**64 * min(1.0, 4 * SAMPLE / n) - 2.0**63)
    early = F.filter(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(F.lit(seed), t, F.col(key)).alias("h"))), lambda s: s["h"] <= near)
    drawn = rows.select(F.explode(early).alias("s"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)]).select("s.*", *[f"x{i}" for i in range(len(features))])

    def grow(keys: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        x = sample.sort_values(list(sample.columns[1:])).iloc[:size, 2:].to_numpy(float)
        return pd.DataFrame({"tree": [keys[0]], "grown": [json.dumps(_grow(x, np.random.default_rng((seed, keys[0])), 0, most))]})

    trees = drawn.groupBy("tree").applyInPandas(grow, "tree int, grown string").orderBy("tree").collect()
    return [json.loads(t.grown) for t in trees], size


def anomaly(forest: tuple[list[tuple], int], x: np.ndarray) -> np.ndarray:
    """Score in (0, 1); the higher, the sooner random cuts set a row apart."""
    trees, size = forest
    mean = np.mean([_depths(t, x, 0) for t in trees], axis=0)
    return 2.0 ** (-mean / max(float(_expected(size)), 1e-9))


def _ranked(values: DataFrame, rank: int, ranges: int = 4096) -> float:
    """The value of that rank, from 0, in one column of numbers: counts of ranges, narrowed to the one that holds it."""
    v = F.col(values.columns[0])
    lo, hi = values.agg(F.min(v), F.max(v)).first()
    while lo < hi:
        at = F.floor((v - lo) / F.lit(hi - lo) * ranges)
        found = values.where(v.between(lo, hi)).groupBy(at.alias("at")).agg(F.count(F.lit(1)), F.min(v), F.max(v))
        for _, n, lo, hi in sorted(found.collect()):  # ranges + 1 rows at most
            if rank < n:
                break
            rank -= n
    return float(lo)


def flag_outliers(
    rows: DataFrame, features: tuple[str, ...] = ("size", "total_deposits_usd", "num_transactions"), share: float = 0.05, least: int = 10, key: str = "wallet_id", seed: int = 42
) -> DataFrame:
    """`rows` with is_outlier: the `share` with the highest anomaly score, those above the cut only.

    Each tree sees SAMPLE rows of its own, drawn from all; the cut is that of all rows. Fewer than `least`
    rows are not judged, and rows that are all alike are none of them."""
    scratch = Scratch(rows.sparkSession, "outliers")
    rows = scratch.write(rows, "rows")
    if (n := rows.count()) < least:
        return rows.withColumn("is_outlier", F.lit(False))
    forest = grown(rows, features, key, n, seed)
    shared = rows.sparkSession.sparkContext.broadcast(forest)  # TREES x SAMPLE nodes

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        return pd.Series(anomaly(shared.value, np.stack([c.to_numpy(float) for c in columns], axis=1)))

    out = scratch.write(rows.withColumn("_score", scored(*[F.col(f).cast("double") for f in features])), "scored")
    cut = _ranked(out.select("_score"), int((n - 1) * (1 - share)))  # what lies above this rank lies above the quantile
    return out.withColumn("is_outlier", F.col("_score") > cut).drop("_score")
