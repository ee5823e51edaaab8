"""Six classifiers of sites and addresses, as pyspark.ml pipelines.

Each has fit(df) -> PipelineModel and predict(df, model) -> df with its label and confidence columns; a
model of None is an untrained classifier, which answers with its default or heuristic. Models are saved
and loaded as Spark's own directories; nothing is unpickled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.core.scratch import Scratch
from webloom.operators.stages import BestClass, KernelMachine, LogCounts, Tokens, calibrated, radial, solved

# Names and sizes that the classifiers are set up with.
CATEGORIES = ("social_media", "marketplace", "pornography", "indexer", "crypto", "other")
PAGE_FEATURES = ("uses_css", "uses_js", "num_chars", "num_img_tags", "num_button_tags", "num_input_tags", "num_external_urls", "num_crypto_addresses", "num_blacklisted_js")
CONTEXT_FEATURES = ("in_a_tag", "in_url", "in_form", "in_footer", "in_table", "in_list", "in_img", "near_donate", "near_example")
LANGUAGE_TERMS, CATEGORY_TERMS, TEMPLATE_TERMS, TRACKING_TERMS = 10_000, 5_000, 5_000, 2_000
TREES, SMOOTHING, SEED = 100, 0.1, 42
DEPTH = 30  # the deepest that Spark grows
#: Distinct sets of script names that the kernel machine is fitted to at most, those that come first by a
#: hash; its parameters, folds that margins are held out in, and where its weights stop.
FIT_SETS, KERNEL_C, FOLDS = 2_000, 1.0, 5


def top_probability(df: DataFrame, probability: str) -> Column:
    return F.array_max(vector_to_array(F.col(probability)))


def _tfidf(df: DataFrame, terms: int, bend: bool = False) -> tuple[list, DataFrame]:
    """Fitted stages from _grams to features, and the rows with them: counts, or 1 + ln of them, times
    ln((1 + n) / (1 + df)) + 1, and length 1. Rows are sparse throughout."""
    counts = CountVectorizer(inputCol="_grams", outputCol="_counts", vocabSize=terms).fit(df)
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(counts.transform(df))
    stages = [counts, *([LogCounts(inputCol="_counts", outputCol="_bent")] if bend else [])]
    stages.append(ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_bent" if bend else "_counts", outputCol="_weighted"))
    stages.append(Normalizer(inputCol="_weighted", outputCol="features", p=2.0))
    return stages, PipelineModel(stages).transform(df)


# -- language and template: complement naive Bayes ---------------------------------------------------


class _TextBayes:
    """Complement naive Bayes over weighted tokens."""

    def __init__(self, kind: str, terms: int, default: str, names: tuple[str, str]):
        self.kind, self.terms, self.default, self.names = kind, terms, default, names

    def fit(self, df: DataFrame, text: str, label: str) -> PipelineModel:
        tokens = Tokens(inputCol=text, outputCol="_grams", kind=self.kind)
        df = tokens.transform(df.where(F.col(label).isNotNull()))
        index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
        stages, rows = _tfidf(index.transform(df), self.terms)
        bayes = NaiveBayes(modelType="complement", smoothing=SMOOTHING, featuresCol="features", labelCol="_label", probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw").fit(rows)
        back = IndexToString(inputCol="_prediction", outputCol=self.names[0], labels=index.labels)
        return PipelineModel([tokens, *stages, bayes, back])

    def predict(self, df: DataFrame, model: PipelineModel | None, text: str) -> DataFrame:
        label, conf = self.names
        if model is None:
            return df.withColumns({label: F.lit(self.default), conf: F.lit(0.0)})
        out = model.transform(df).withColumn(conf, top_probability(df, "_probability"))
        return out.select(*df.columns, label, conf)


class Language(_TextBayes):
    """Over character trigrams."""

    def __init__(self):
        super().__init__("trigrams", LANGUAGE_TERMS, "unknown", ("language", "language_conf"))


class Template(_TextBayes):
    """Over a text made of 50 selectors, 50 paths and the top terms; words of two letters or more."""

    def __init__(self):
        super().__init__("words", TEMPLATE_TERMS, "unique", ("template_group", "template_conf"))


def template_text(css: Column, paths: Column, terms: Column) -> Column:
    return F.concat_ws(" ", F.array_join(F.slice(css, 1, 50), " "), F.array_join(F.slice(paths, 1, 50), " "), F.array_join(terms, " "))


# -- forests over flags and counts ----------------------------------------------------------------


class _Forest:
    def __init__(self, features: Sequence[str], names: tuple[str, str]):
        self.features, self.names = features, names

    def vector(self, df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.features])))

    def fit(self, df: DataFrame, label: str) -> PipelineModel:
        rows = self.vector(df.where(F.col(label).isNotNull())).withColumn("_label", F.col(label).cast("double"))
        forest = RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=TREES, seed=SEED, featureSubsetStrategy="sqrt", maxDepth=DEPTH, probabilityCol="_probability", predictionCol="_prediction", rawPredictionCol="_raw")
        return PipelineModel([forest.fit(rows)])

    def untrained(self) -> tuple[Column, Column]:
        return F.lit(False), F.lit(0.0)

    def predict(self, df: DataFrame, model: PipelineModel | None) -> DataFrame:
        label, conf = self.names
        if model is None:
            value, share = self.untrained()
            return df.withColumns({label: value, conf: share})
        p = F.element_at(vector_to_array(F.col("_probability")), 2)
        return model.transform(self.vector(df)).withColumn(conf, p).withColumn(label, F.col(conf) > 0.5).select(*df.columns, label, conf)


class Illicitness(_Forest):
    def __init__(self):
        super().__init__(PAGE_FEATURES, ("is_illicit", "illicit_conf"))


class Attribution(_Forest):
    """Of an address's context; untrained, near a word for giving and not near 'example'."""

    def __init__(self):
        super().__init__(CONTEXT_FEATURES, ("attributed", "attributed_conf"))

    def untrained(self):
        claim = F.col("near_donate") & ~F.col("near_example")
        return claim, claim.cast("double")


# -- category: words and pairs of them --------------------------------------------------------------


class Category:
    """A forest for each class; a page's class is the one whose forest is surest."""

    def __init__(self, trees: int = TREES):
        self.trees = trees

    def fit(self, df: DataFrame, text: str, label: str) -> PipelineModel:
        tokens = Tokens(inputCol=text, outputCol="_grams", kind="pairs")
        stages, rows = _tfidf(tokens.transform(df.where(F.col(label).isNotNull())), CATEGORY_TERMS, bend=True)
        rows = Scratch(df.sparkSession, "category").write(rows.select("features", label), "features")
        classes = sorted(r[0] for r in rows.select(label).distinct().collect())  # class names
        for i, c in enumerate(classes):
            forest = RandomForestClassifier(featuresCol="features", labelCol="_label", numTrees=self.trees, seed=SEED, featureSubsetStrategy="sqrt", maxDepth=DEPTH, probabilityCol=f"_p_{i}", predictionCol=f"_y_{i}", rawPredictionCol=f"_r_{i}")
            stages.append(forest.fit(rows.withColumn("_label", (F.col(label) == c).cast("double"))))
        return PipelineModel([tokens, *stages, BestClass(inputCol="_p_", outputCol="category", shareCol="category_conf", classes=classes)])

    def predict(self, df: DataFrame, model: PipelineModel | None, text: str) -> DataFrame:
        if model is None:
            return df.withColumns({"category": F.lit("other"), "category_conf": F.lit(0.0)})
        return model.transform(df).select(*df.columns, "category", "category_conf")


# -- tracking: a kernel machine over script names ----------------------------------------------------


class Tracking:
    """A radial kernel machine over weighted script names, scaled by their deviations over all rows.

    Pages name few distinct sets of scripts, so rows are counted by set and class before anything else; the
    machine is solved over the sets, each with the weight of its rows. Its probability is fitted to margins
    of rows that were held out, in FOLDS folds by a hash of the row."""

    def fit(self, df: DataFrame, calls: str, label: str) -> PipelineModel:
        scratch, tokens = Scratch(df.sparkSession, "tracking"), Tokens(inputCol=calls, outputCol="_grams", kind="names")
        df = df.where(F.col(label).isNotNull())
        fold = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(FOLDS)).cast("int")
        side = F.when(F.col(label).cast("double") > 0, 1).otherwise(-1)
        rows = tokens.transform(df.withColumns({"_fold": fold, "_side": side})).select("_grams", "_side", "_fold")
        stages, rows = _tfidf(scratch.write(rows, "rows"), TRACKING_TERMS)
        seen = rows.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).select("s.variance", "s.count").first()
        n = seen["count"]
        spread = np.sqrt(seen["variance"].toArray() * ((n - 1) / n if n > 1 else 0.0)) if n else np.zeros(0)
        even = ElementwiseProduct(scalingVec=Vectors.dense(1.0 / np.where(spread > 0, spread, 1.0)), inputCol="features", outputCol="_scaled")
        counted = scratch.write(rows.groupBy("_grams", "_side", "_fold").agg(F.count(F.lit(1)).alias("n"), F.first("features").alias("features")), "counted")
        sets = counted.select("_grams").distinct().orderBy(F.xxhash64("_grams"), "_grams").limit(FIT_SETS)
        found = even.transform(counted.join(F.broadcast(sets), "_grams")).select("_scaled", "_side", "_fold", "n").collect()  # 2 * FOLDS * FIT_SETS at most
        machine = _machine(np.array([r["_scaled"].toArray() for r in found]).reshape(len(found), -1), *(np.array([r[c] for r in found]) for c in ("_side", "_fold", "n")))
        return PipelineModel([tokens, *stages, even, machine])

    def predict(self, df: DataFrame, model: PipelineModel | None, calls: str) -> DataFrame:
        if model is None:
            any_call = F.size(calls) > 0
            return df.withColumns({"has_tracking": any_call, "tracking_conf": any_call.cast("double")})
        return model.transform(df).withColumn("has_tracking", F.col("tracking_conf") > 0.5).select(*df.columns, "has_tracking", "tracking_conf")


def _machine(x: np.ndarray, side: np.ndarray, fold: np.ndarray, n: np.ndarray) -> KernelMachine:
    """The machine of rows x of a class (side 1 or -1) and a fold, that count n times each."""
    mean = (n[:, None] * x).sum() / max(n.sum() * x.shape[1], 1)
    spread = (n[:, None] * (x - mean) ** 2).sum() / max(n.sum() * x.shape[1], 1)
    gamma = 1.0 / (x.shape[1] * spread) if spread > 0 else 1.0

    def fitted(mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        rows, where = np.unique(np.column_stack((x[mine], side[mine])), axis=0, return_inverse=True)
        total = np.bincount(where.ravel(), weights=n[mine], minlength=len(rows))
        weights, bias = solved(radial(rows[:, :-1], rows[:, :-1], gamma), rows[:, -1], KERNEL_C * total)
        used = weights != 0
        return rows[used, :-1], weights[used], bias

    held, weights, bias = fitted(np.ones(len(x), bool))
    margin = np.zeros(len(x))
    for f in range(FOLDS):
        mine = fold == f
        rest = fitted(~mine) if len(set(side[~mine])) == 2 else (held, weights, bias)
        if mine.any():
            margin[mine] = radial(x[mine], rest[0], gamma) @ rest[1] + rest[2]
    slope, shift = calibrated(margin, side.astype(float), n.astype(float))
    return KernelMachine(inputCol="_scaled", outputCol="tracking_conf", marginCol="tracking_margin", vectors=held.ravel().tolist(), weights=weights.tolist(), dims=x.shape[1], bias=bias, gamma=float(gamma), slope=slope, shift=shift)


# -- all six together -------------------------------------------------------------------------------


class Classifiers:
    """The six classifiers and their models; what is not trained answers with its default."""

    def __init__(self):
        self.kinds = {"language": Language(), "illicitness": Illicitness(), "category": Category(), "template": Template(), "tracking": Tracking(), "attribution": Attribution()}
        self.models: dict = dict.fromkeys(self.kinds)

    def classify(self, sites: DataFrame, contexts: DataFrame | None = None, key: str = "domain", text: str = "classifier_text") -> DataFrame:
        """`sites` (key, text, PAGE_FEATURES, tracking_calls, template_text) with all verdicts.

        contexts: (key, CONTEXT_FEATURES) of addresses; a site is attributed if one of them is, with
        the largest confidence, and False and 0 without any."""
        k, m = self.kinds, self.models
        out = k["language"].predict(sites, m["language"], text)
        out = k["illicitness"].predict(out, m["illicitness"])
        out = k["category"].predict(out, m["category"], text)
        out = k["tracking"].predict(out, m["tracking"], "tracking_calls")
        out = k["template"].predict(out, m["template"], "template_text")
        if contexts is None:
            return out.withColumns({"has_attribution": F.lit(False), "attribution_conf": F.lit(0.0)})
        a = k["attribution"].predict(contexts, m["attribution"]).groupBy(key).agg(F.bool_or("attributed").alias("has_attribution"), F.max("attributed_conf").alias("attribution_conf"))
        out = out.join(a, key, "left")
        return out.withColumns({"has_attribution": F.coalesce("has_attribution", F.lit(False)), "attribution_conf": F.coalesce("attribution_conf", F.lit(0.0))})

    def save(self, path: str) -> None:
        for name, model in self.models.items():
            if model is not None:
                model.write().overwrite().save(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Classifiers:
        """Models of the folder; those that are not there stay untrained."""
        out = cls()
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        for name in out.kinds:
            at = hadoop(f"{path}/{name}")
            if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
                out.models[name] = PipelineModel.load(f"{path}/{name}")
        return out
