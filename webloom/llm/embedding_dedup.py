"""Near-duplicates among embeddings by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned to principal axes, which puts most of each vector's
length into its first dimensions. The leading coordinates of a label with many vectors also lay out a
grid whose cells are as wide as two vectors within the threshold can lie apart, so links only exist
within a cell and between neighbouring ones. Cells are cut into tiles, and only tiles of such cells
meet pairwise in tasks. A task multiplies the leading dimensions first; what the others can still add
is bounded by the product of the suffix norms, and pairs whose bound stays below the threshold are
given up, first by whole blocks, then one by one. The few that are left get an exact cosine in double
precision. Tasks return a number of links for each vector and a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.scratch import Scratch
from webloom.llm.forest import Forest
from webloom.operators.components import connected_components

#: Rows of a tile and of a block within it, and dimensions added at a time.
TILE, BLOCK, CHUNK = 2048, 512, 8
#: A label gets a grid dimension for each power of GRID that its number of tiles reaches, up to GRID_DIMS.
GRID, GRID_DIMS = 8, 3
#: Vectors that the axes are fitted to at most. Any axes give the same result; good ones stop sooner.
FIT_ROWS = 4096
#: Dimensions beyond which vectors are compared along their own axes: the matrix grows with the square.
AXES_DIMS = 2048
#: Rounding allowance of the bounds; the final cosine is computed anew.
SLACK = 1e-9


def principal_axes(vectors: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray | None:
    """Axes (columns, by falling variance) of up to `fit_rows` vectors that come first by a hash; None for
    no vectors or ones of more than AXES_DIMS dimensions."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("embedding")).limit(fit_rows).toPandas()["embedding"]
    if not len(rows):
        return None
    dims = rows.map(len).mode()[0]
    if dims > AXES_DIMS:
        return None
    x = np.stack([r for r in rows if len(r) == dims]).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, axes = np.linalg.eigh(x.T @ x)
    return axes[:, ::-1].copy()


def _prepared(x: np.ndarray, axes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors; the same along the axes; norms of what follows each chunk."""
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = unit @ axes if axes is not None and len(axes) == x.shape[1] else unit
    squares = np.cumsum((turned * turned)[:, ::-1], axis=1)[:, ::-1]
    after = [np.sqrt(squares[:, d]) if d < x.shape[1] else np.zeros(len(x)) for d in range(CHUNK, x.shape[1] + CHUNK, CHUNK)]
    return unit, turned, np.stack(after, axis=1)


def grid_cells(vectors: list, dims: np.ndarray, axes: np.ndarray | None, threshold: float) -> np.ndarray:
    """Cell of each vector along GRID_DIMS axes, 0 along those that its label does not use.

    Unit vectors of cosine t are sqrt(2 - 2 t) apart, and so no further along any axis."""
    width = max(np.sqrt(max(2 - 2 * threshold, 0.0)) * (1 + 1e-6), 1e-3)
    cells = np.zeros((len(vectors), GRID_DIMS), np.int32)
    sizes = np.array([len(v) for v in vectors], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        _, turned, _ = _prepared(np.stack([vectors[i] for i in at]).astype(np.float64), axes)
        n = min(GRID_DIMS, size)
        cells[at, :n] = np.floor(turned[:, :n] / width)
    cells[np.arange(GRID_DIMS)[None, :] >= dims[:, None]] = 0
    return cells


def similar_pairs(a, b, threshold: float, same: bool):
    """Positions (in a, in b) with cosine >= threshold; a, b as from _prepared."""
    (ua, ta, sa), (ub, tb, sb) = a, b
    for i in range(0, len(ta), BLOCK):
        for j in range(i if same else 0, len(tb), BLOCK):
            p = q = product = None
            for c in range(sa.shape[1]):
                d = slice(c * CHUNK, (c + 1) * CHUNK)
                if p is None:  # whole block
                    step = ta[i : i + BLOCK, d] @ tb[j : j + BLOCK, d].T
                    product = step if product is None else product + step
                    alive = product + sa[i : i + BLOCK, c][:, None] * sb[j : j + BLOCK, c][None, :] >= threshold - SLACK
                    n = np.count_nonzero(alive)
                    if n == 0:
                        p = q = np.empty(0, np.int64)
                        break
                    if n * 8 < alive.size:  # few enough to go on one by one
                        p, q = np.nonzero(alive)
                        product = product[p, q]
                else:
                    product = product + np.einsum("ij,ij->i", ta[i + p, d], tb[j + q, d])
                    alive = product + sa[i + p, c] * sb[j + q, c] >= threshold - SLACK
                    p, q, product = p[alive], q[alive], product[alive]
                    if not len(p):
                        break
            if p is None:
                p, q = np.nonzero(alive)
            p, q = p + i, q + j
            if same:
                p, q = p[p < q], q[p < q]
            for at in range(0, len(p), 1 << 15):
                p2, q2 = p[at : at + (1 << 15)], q[at : at + (1 << 15)]
                exact = np.einsum("ij,ij->i", ua[p2], ub[q2]) >= threshold
                if exact.any():
                    yield p2[exact], q2[exact]


def _dealt(classes: DataFrame, axes: np.ndarray | None, threshold: float, tile: int, scratch: Scratch) -> DataFrame:
    """(label, ta, tb, tile, class, copies, embedding): each class once for each pair of tiles that it
    takes part in."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = [np.array(x.as_py()) for x in b.column("embedding")]
            cells = grid_cells(vectors, b.column("dims").to_numpy(), axes, threshold)
            cells = pa.ListArray.from_arrays(np.arange(0, len(vectors) * GRID_DIMS + 1, GRID_DIMS, dtype=np.int32), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "class", "copies", "embedding")), cells], names=["label", "class", "copies", "embedding", "cell"])

    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / tile), F.lit(1)).cast("int")
    dims = F.least(F.floor(F.log(tiles) / F.log(F.lit(float(GRID))) + 1e-9), F.lit(GRID_DIMS)).cast("int")
    labels = scratch.write(classes.groupBy("label").agg(dims.alias("dims")), "labels")
    fields = {f.name: f for f in classes.schema}
    schema = T.StructType([*(fields[c] for c in ("label", "class", "copies", "embedding")), T.StructField("cell", T.ArrayType(T.IntegerType()))])
    rows = classes.join(labels, "label").select("label", "class", "copies", "embedding", "dims").mapInArrow(place, schema)
    rows = scratch.write(rows, "placed")
    # a cell's tiles are numbered on from those of the cells before it, by a window over each label's cells
    cells = scratch.write(rows.groupBy("label", "cell").agg(tiles.alias("tiles")), "cells")
    before = Window.partitionBy("label").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = scratch.write(cells.withColumn("first", F.coalesce(F.sum("tiles").over(before), F.lit(0)).cast("int")), "numbered")
    steps = F.array(*[F.array(*map(F.lit, s)) for s in product((-1, 0, 1), repeat=GRID_DIMS)])
    near = cells.join(labels, "label").select("label", "cell", "first", "tiles", F.explode(F.filter(steps, lambda s: F.forall(F.transform(s, lambda x, i: (x == 0) | (i < F.col("dims"))), lambda ok: ok))).alias("step"))
    near = near.withColumn("next", F.zip_with("cell", "step", lambda c, s: c + s))
    other = cells.select("label", F.col("cell").alias("next"), F.col("first").alias("other_first"), F.col("tiles").alias("other_tiles"))
    partners = near.join(other, ["label", "next"]).groupBy("label", "cell").agg(
        F.first("first").alias("first"), F.first("tiles").alias("tiles"), F.flatten(F.collect_list(F.sequence("other_first", F.expr("other_first + other_tiles - 1")))).alias("others")
    )  # of at most 3 ** GRID_DIMS cells
    partners = scratch.write(partners, "partners")
    rows = rows.join(partners, ["label", "cell"]).withColumn("tile", F.col("first") + F.pmod(F.xxhash64("class"), F.col("tiles").cast("long")).cast("int"))
    rows = rows.select("label", "class", "copies", "embedding", "tile", F.explode("others").alias("other"))
    return rows.withColumns({"ta": F.least("tile", "other"), "tb": F.greatest("tile", "other")})


def similar_groups(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", tile: int = TILE
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two rows link when their labels are equal and not null, their vectors have as many dimensions and
    the cosine is at least `threshold`. A vector that is null, empty, zero or holds a null or
    non-finite number links with nothing, as does a row with a null id. Rows with equal vectors are
    compared as one and counted as many; ids that repeat count as different vectors, each with links of
    its own. component_id is the smallest id reachable, and `kept` marks it. Ids are integers. Vectors
    may be of any length. An empty table gives no rows. Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    clean = ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = scratch.write(rows.withColumn("valid", F.coalesce(clean, F.lit(False))), "rows")
    valid = rows.where("valid")
    # numbered when written, as ids may repeat with other vectors
    classes = valid.groupBy("label", "embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = scratch.write(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    axes = principal_axes(classes)
    dealt = _dealt(classes, axes, threshold, tile, scratch)

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, copies = pdf["class"].to_numpy(), pdf["copies"].to_numpy()
        first = (pdf["tile"] == key[1]).to_numpy()
        dims = pdf["embedding"].map(len).to_numpy()
        forest, links = Forest(len(ids)), np.zeros(len(ids), np.int64)
        same = key[1] == key[2]
        for d in np.unique(dims):
            here, there = np.flatnonzero(first & (dims == d)), np.flatnonzero((dims == d) & (first if same else ~first))
            if not len(here) or not len(there):
                continue
            stack = lambda at: _prepared(np.stack(pdf["embedding"].to_numpy()[at]).astype(np.float64), axes)
            a = stack(here)
            for p, q in similar_pairs(a, a if same else stack(there), threshold, same):
                p, q = here[p], there[q]
                links += np.bincount(p, copies[q], len(ids)).astype(np.int64) + np.bincount(q, copies[p], len(ids)).astype(np.int64)
                forest.link(p, q)
        a, b = forest.star_edges(ids)
        some = links > 0
        edges = pd.DataFrame({"src": a, "dst": b, "n": np.zeros(len(a), np.int64)})
        return pd.concat([edges, pd.DataFrame({"src": ids[some], "dst": ids[some], "n": links[some]})])

    found = scratch.write(dealt.groupBy("label", "ta", "tb").applyInPandas(compare, "src long, dst long, n long"), "found")
    links = found.where("n > 0").groupBy(F.col("src").alias("class")).agg(F.sum("n").alias("links"))
    groups = connected_components(found.where("n = 0")).select(F.col("node").alias("class"), "component")
    final = classes.select("label", "embedding", "class", "rep", "copies").join(links, "class", "left").join(groups, "class", "left")
    final = final.withColumn("component", F.coalesce("component", "class"))
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    final = scratch.write(final.select("label", "embedding", "rep", "component", n_links), "final")
    least = scratch.write(final.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    final = final.join(least, "component").select("label", "embedding", "n_links", "component_id")
    linked = valid.select("id", "label", "embedding").join(final, ["label", "embedding"], "left")
    linked = linked.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
