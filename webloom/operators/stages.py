"""Stages for pyspark.ml pipelines that Spark does not have: saved and loaded with their parameters, like its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import trigrams


class _Stage(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A stage whose parameters are given by name and are all there is to it."""

    @keyword_only
    def __init__(self, **given):
        super().__init__()
        if given:
            self._set(**given)

    def of(self, name: str):
        return self.getOrDefault(name)


class Tokens(_Stage):
    """Tokens of a text (null is empty): character trigrams; words of two letters or more in lower case; those
    and the pairs of neighbours among them; or the words of a sorted list of names."""

    kind = Param(Params._dummy(), "kind", "trigrams, words, pairs or names", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        kind, text = self.of("kind"), F.col(self.of("inputCol"))
        if kind == "trigrams":
            return df.withColumn(self.of("outputCol"), trigrams(text))
        if kind == "names":
            text = F.array_join(F.array_sort(text), " ")
        low = F.lower(F.coalesce(text, F.lit("")))
        words = F.filter(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.length(x) > 1)
        if kind != "pairs":
            return df.withColumn(self.of("outputCol"), words)
        behind = lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
        both = df.withColumn("_words", words)
        return both.withColumn(self.of("outputCol"), F.concat("_words", F.filter(behind(F.col("_words")), lambda x: x.isNotNull()))).drop("_words")


class LogCounts(_Stage):
    """1 + ln(count) of each count that is not 0. Rows stay sparse."""

    def _transform(self, df: DataFrame) -> DataFrame:
        @F.pandas_udf(VectorUDT())
        def bent(vectors: pd.DataFrame) -> pd.DataFrame:  # type, size, indices, values: how vectors are stored
            with np.errstate(divide="ignore"):
                return vectors.assign(values=[np.where(v > 0, 1.0 + np.log(v), 0.0) for v in vectors["values"]])

        return df.withColumn(self.of("outputCol"), bent(F.unwrap_udt(self.of("inputCol"))))


class BestClass(_Stage):
    """The class whose machine is surest, and its share of all their probabilities; of equals the first. The
    machines' probabilities are the columns inputCol0, inputCol1, ... and the share goes to shareCol."""

    classes = Param(Params._dummy(), "classes", "names of the classes, in the machines' order", TypeConverters.toListString)
    shareCol = Param(Params._dummy(), "shareCol", "column of the share", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.of("classes")
        ps = F.array(*[F.element_at(vector_to_array(F.col(f"{self.of('inputCol')}{i}")), -1) for i in range(len(names))])
        df = df.withColumn("_ps", ps)
        total = F.aggregate("_ps", F.lit(0.0), lambda a, b: a + b)
        best = F.array_position("_ps", F.array_max("_ps")).cast("int")
        out = df.withColumn(self.of("outputCol"), F.element_at(F.array(*map(F.lit, names)), best))
        return out.withColumn(self.of("shareCol"), F.when(total > 0, F.array_max("_ps") / total).otherwise(0.0)).drop("_ps")


class KernelMachine(_Stage):
    """Margins of a radial kernel machine, and probabilities of them: 1 / (1 + exp(slope * margin + shift)).

    vectors holds the support vectors one behind the other, each of `dims` numbers."""

    _list = TypeConverters.toListFloat
    vectors = Param(Params._dummy(), "vectors", "support vectors", _list)
    weights = Param(Params._dummy(), "weights", "their weights, with the sign of their class", _list)
    dims = Param(Params._dummy(), "dims", "numbers of a vector", TypeConverters.toInt)
    bias = Param(Params._dummy(), "bias", "constant of the margin", TypeConverters.toFloat)
    gamma = Param(Params._dummy(), "gamma", "width of the kernel", TypeConverters.toFloat)
    slope = Param(Params._dummy(), "slope", "of the probability", TypeConverters.toFloat)
    shift = Param(Params._dummy(), "shift", "of the probability", TypeConverters.toFloat)
    marginCol = Param(Params._dummy(), "marginCol", "column of the margin", TypeConverters.toString)

    def _transform(self, df: DataFrame) -> DataFrame:
        held = np.array(self.of("vectors")).reshape(-1, max(self.of("dims"), 1))
        weights, bias, gamma = np.array(self.of("weights")), self.of("bias"), self.of("gamma")
        shared = df.sparkSession.sparkContext.broadcast((held, weights))  # as many vectors as were fitted to at most

        @F.pandas_udf("double")
        def margin(vectors: pd.DataFrame) -> pd.Series:  # type, size, indices, values: how vectors are stored
            held, weights = shared.value
            known: dict[bytes, float] = {}  # rows are few distinct sets

            def one(at: np.ndarray | None, values: np.ndarray) -> float:
                x = np.zeros(held.shape[1])
                x[slice(None) if at is None else np.asarray(at, int)] = values
                key = x.tobytes()
                if key not in known:
                    known[key] = float(radial(x[None, :], held, gamma)[0] @ weights + bias) if len(weights) else bias
                return known[key]

            return pd.Series([one(*v) for v in zip(vectors["indices"], vectors["values"], strict=True)], dtype=float)

        out = df.withColumn(self.of("marginCol"), margin(F.unwrap_udt(self.of("inputCol"))))
        return out.withColumn(self.of("outputCol"), 1 / (1 + F.exp(F.lit(self.of("slope")) * F.col(self.of("marginCol")) + F.lit(self.of("shift")))))


def radial(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(squares, 0))


def solved(kernel: np.ndarray, y: np.ndarray, most: np.ndarray, tol: float = 1e-6, max_steps: int = 1_000_000) -> tuple[np.ndarray, float]:
    """(weights, bias) of a kernel machine's dual problem, 0 <= weight <= most, by pairs of weights: the one that
    breaks its condition most, and the one with which that gains most. Equal rows count as one with a larger `most`."""
    a, g = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(max_steps):
        score = -y * g
        up, down = np.where(y > 0, a < most, a > 0), np.where(y > 0, a > 0, a < most)
        if not up.any() or not down.any():
            break
        i = int(np.argmax(np.where(up, score, -np.inf)))
        gap = score[i] - score
        if (gap[down]).max() < tol:
            break
        bend = np.maximum(kernel[i, i] + np.diag(kernel) - 2 * kernel[i], 1e-12)
        j = int(np.argmax(np.where(down & (gap > 0), gap * gap / bend, -np.inf)))
        step = gap[j] / bend[j]  # along +y at i and -y at j
        step = min(step, most[i] - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else most[j] - a[j])
        a[i] += y[i] * step
        a[j] -= y[j] * step
        g += y * step * (kernel[i] - kernel[j])
        for k in (i, j):  # rounding must not leave a weight a hair from its bound
            a[k] = 0.0 if a[k] < 1e-14 * most[k] else most[k] if a[k] > most[k] * (1 - 1e-14) else a[k]
    score = -y * g
    free = (a > 0) & (a < most)
    if free.any():
        bias = float(score[free].mean())
    else:
        up, down = np.where(y > 0, a < most, a > 0), np.where(y > 0, a > 0, a < most)
        ends = [score[up].max()] * up.any() + [score[down].min()] * down.any()
        bias = float(np.mean(ends)) if ends else 0.0
    return a * y, bias


def calibrated(margin: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(slope, shift) of the probability of the class 1 by margins of rows that count n times each: a logistic fit
    to targets drawn in from 0 and 1 (Platt, 1999), by damped Newton steps."""
    above, below = n[y > 0].sum(), n[y < 0].sum()
    target = np.where(y > 0, (above + 1) / (above + 2), 1 / (below + 2))
    slope, shift = 0.0, float(np.log((below + 1) / (above + 1)))

    def loss(s: float, t: float) -> float:
        z = s * margin + t
        return float((n * (np.logaddexp(0, z) - (1 - target) * z)).sum())

    now = loss(slope, shift)
    for _ in range(steps):
        z = slope * margin + shift
        p = 1 / (1 + np.exp(np.clip(z, -500, 500)))
        d, w = n * (target - p), n * p * (1 - p)
        grad = np.array([(d * margin).sum(), d.sum()])
        if np.abs(grad).max() < 1e-9 * max(n.sum(), 1):
            break
        bend = np.array([[(w * margin * margin).sum() + 1e-12, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-12]])
        move, size = np.linalg.solve(bend, grad), 1.0
        while size > 1e-10 and (new := loss(slope - size * move[0], shift - size * move[1])) > now - 1e-12:
            size /= 2
        if size <= 1e-10:
            break
        slope, shift, now = slope - size * move[0], shift - size * move[1], new
    return float(slope), float(shift)
