import numpy as np
import pytest
from pyspark.sql import functions as F

from webloom.operators import models


def test_text_and_flag_models_save_and_load(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("domain"), "text", "lang").limit(80)
    c = models.Classifiers()
    lang = c.kinds["language"]
    c.models["language"] = lang.fit(d, "text", "lang")
    flags = spark.range(60).select(F.col("id").alias("domain"), *[(F.col("id") % (k + 2) == 0).alias(f) for k, f in enumerate(models.CONTEXT_FEATURES)])
    c.models["attribution"] = c.kinds["attribution"].fit(flags.withColumn("y", F.col("near_donate") | F.col("in_a_tag")), "y")
    calls = spark.range(40).select(F.col("id").alias("domain"), F.when(F.col("id") % 2 == 0, F.array(F.lit("document.cookie"), F.lit("_ga"))).otherwise(F.array(F.lit("localStorage"))).alias("calls"))
    track = c.kinds["tracking"]
    c.models["tracking"] = track.fit(calls.withColumn("y", F.col("domain") % 2 == 0), "calls", "y")
    kind = c.kinds["category"] = models.Category(trees=5)
    c.models["category"] = kind.fit(d, "text", "lang")
    c.save(f"file://{tmp_path}/m")
    back = models.Classifiers.load(spark, f"file://{tmp_path}/m")
    assert back.models["template"] is None and back.models["illicitness"] is None
    got = lang.predict(d, back.models["language"], "text")
    assert got.where("lang = language").count() > 0.9 * 80 and got.where("language_conf between 0 and 1").count() == 80
    y = c.kinds["attribution"].predict(flags, back.models["attribution"])
    assert y.where("attributed = (near_donate or in_a_tag)").count() > 50
    t = track.predict(calls, back.models["tracking"], "calls")
    assert t.where("has_tracking = (domain % 2 = 0)").count() == 40
    k = kind.predict(d, back.models["category"], "text")
    assert k.where("lang = category").count() > 40 and k.where("category_conf between 0 and 1").count() == 80


def test_untrained(spark):
    df = spark.createDataFrame([(1, ["_ga"], True, False), (2, [], True, True)], "domain long, tracking_calls array<string>, near_donate boolean, near_example boolean")
    rows = {r.domain: r for r in models.Classifiers().classify(df, df, text="domain").collect()}
    assert (rows[1].language, rows[1].is_illicit, rows[1].category, rows[1].template_group) == ("unknown", False, "other", "unique")
    assert rows[1].has_tracking and rows[1].has_attribution and not rows[2].has_tracking and not rows[2].has_attribution


def held_out(df, key="domain"):
    fold = F.crc32(F.col(key).cast("string")) % 4 == 0
    return df.where(~fold), df.where(fold)


def test_language_of_texts_that_were_not_learnt(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id").alias("domain"), "text", "lang")
    train, rest = held_out(d)
    k = models.Language()
    got = k.predict(rest, k.fit(train, "text", "lang"), "text")
    assert got.where("lang = language").count() > 0.95 * rest.count() > 100


def test_illicit_sites_that_were_not_learnt(spark):
    k = models.Illicitness()
    rows = spark.range(400).select(F.col("id").alias("domain"), *[(F.pmod(F.xxhash64(F.lit(f), "id"), F.lit(10))).alias(f) for f in models.PAGE_FEATURES])
    rows = rows.withColumn("y", (F.col("num_crypto_addresses") > 5) | ((F.col("num_img_tags") < 3) & (F.col("uses_js") > 4)))
    train, rest = held_out(rows)
    got = k.predict(rest, k.fit(train, "y"))
    assert got.where("is_illicit = y").count() > 0.9 * rest.count() and got.where("illicit_conf between 0 and 1").count() == rest.count() > 50


def test_templates_that_were_not_learnt(spark):
    kinds = {0: (["div.shop", "a.cart"], ["[document]>html", "[document]>html>table"], ["price", "ship"]), 1: (["p.post"], ["[document]>html>article"], ["blog", "post"]), 2: (["li.row", "ul.index"], ["[document]>ul"], ["link", "list"])}
    rows = [(i, f"t{i % 3}", *(part + [f"x{i}"] for part in kinds[i % 3])) for i in range(120)]
    df = spark.createDataFrame(rows, "domain long, kind string, css array<string>, paths array<string>, terms array<string>")
    df = df.withColumn("text", models.template_text(F.col("css"), F.col("paths"), F.col("terms")))
    train, rest = held_out(df)
    k = models.Template()
    got = k.predict(rest, k.fit(train, "text", "kind"), "text")
    assert got.where("template_group = kind").count() == rest.count() > 15


def plain_machine(x, y, gamma, tol=1e-6):
    """Margins of a kernel machine with a row for each row, by pairs that break their conditions most."""
    k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))
    a, n = np.zeros(len(y)), len(y)
    for _ in range(200_000):
        f = -y * ((y[:, None] * y[None] * k) @ a - 1)
        up = [t for t in range(n) if (a[t] < 1 if y[t] > 0 else a[t] > 0)]
        down = [t for t in range(n) if (a[t] > 0 if y[t] > 0 else a[t] < 1)]
        i, j = max(up, key=lambda t: f[t]), min(down, key=lambda t: f[t])
        if f[i] - f[j] < tol:
            break
        step = min((f[i] - f[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12), 1 - a[i] if y[i] > 0 else a[i], a[j] if y[j] > 0 else 1 - a[j])
        a[i] = min(max(a[i] + y[i] * step, 0), 1)
        a[j] = min(max(a[j] - y[j] * step, 0), 1)
    free = [t for t in range(n) if 1e-9 < a[t] < 1 - 1e-9]
    return k @ (a * y) + np.mean([f[t] for t in free] if free else [f[i], f[j]])


def test_kernel_machine_equals_a_plain_one(spark):
    """Over distinct sets with weights, against a row for each row; margins, saved and loaded too."""
    rng = np.random.default_rng(3)
    names = ["document.cookie", "localstorage", "getbattery", "webkit", "indexeddb"]
    rows = []
    for i in range(90):
        calls = [c for c in names if rng.random() < 0.5]
        rows.append((i, calls, bool(("webkit" in calls) != ("getbattery" in calls)) != (rng.random() < 0.1)))
    df = spark.createDataFrame(rows, "domain long, calls array<string>, y boolean")
    kind = models.Tracking()
    model = kind.fit(df, "calls", "y")
    got = model.transform(df).orderBy("domain").select("_scaled", "tracking_margin", "tracking_conf").collect()
    x, y = np.array([r["_scaled"].toArray() for r in got]), np.array([1 if r[2] else -1 for r in rows])
    want = plain_machine(x, y, 1 / (x.shape[1] * x.var()))
    assert np.abs(np.array([r.tracking_margin for r in got]) - want).max() < 1e-3
    conf = np.array([r.tracking_conf for r in got])
    assert ((conf > 0.5) == (y > 0)).mean() > 0.85 and (np.diff(conf[np.argsort(want)]) >= -1e-6).all()
    train, rest = held_out(spark.createDataFrame([(i, [c for k, c in enumerate(names) if (i * 7919 >> k) % 2], (i * 7919 >> 3) % 2 != (i * 7919 >> 2) % 2) for i in range(400)], df.schema))
    back = kind.predict(rest, kind.fit(train, "calls", "y"), "calls")
    assert back.where("has_tracking = y").count() == rest.count() > 50


def test_category_rows_stay_sparse_and_are_weighed_by_logarithms(spark):
    df = spark.createDataFrame([("aa aa aa bb", "x"), ("bb cc", "y"), (None, "x")], "text string, kind string")
    model = models.Category(trees=2).fit(df, "text", "kind")
    rows = model.transform(df).select("features", "category", "category_conf").collect()
    assert all(type(r.features).__name__ == "SparseVector" for r in rows) and rows[2].features.numNonzeros() == 0
    vocabulary = model.stages[1].vocabulary
    assert sorted(vocabulary) == ["aa", "aa aa", "aa bb", "bb", "bb cc", "cc"]
    idf = {t: np.log(4 / (1 + (2 if t == "bb" else 1))) + 1 for t in vocabulary}
    want = {"aa": (1 + np.log(3)) * idf["aa"], "aa aa": (1 + np.log(2)) * idf["aa aa"], "aa bb": idf["aa bb"], "bb": idf["bb"]}
    size = np.sqrt(sum(v * v for v in want.values()))
    assert {vocabulary[i]: v for i, v in zip(rows[0].features.indices, rows[0].features.values, strict=True)} == pytest.approx({t: v / size for t, v in want.items()})
