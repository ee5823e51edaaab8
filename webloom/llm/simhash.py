"""SimHash near-deduplication by tiled exact comparison.

A fingerprint has 64 bits a lane; lane 0 hashes word shingles with XXH64 and further lanes remix its
hash, for a finer estimate. Distinct fingerprints are dealt into tiles by the population counts of their
16-bit words, whose differences add up to no more than the bits that differ: only tiles whose counts can be
within the radius meet, each pair in one task, and there numpy compares them with exclusive-or and bit
counts. Within a task, sub-tiles are skipped by the same counts. A task returns a spanning
forest of its links, never all pairs, so a group of any size costs no more rows than it has members
in each tile pair.

With a similarity, that only finds candidates: what is connected by them is compared shingle by
shingle, in blocks, and only pairs of at least that Jaccard similarity link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.scratch import Scratch
from webloom.llm.forest import Forest
from webloom.llm.memory import in_small_batches, tidy
from webloom.operators.components import connected_components

SEED = 42
#: Rows of a tile: a share of all fingerprints within these bounds, until there are MOST_TILES of that size,
#: and then as many as keep to that number, which bounds the plan. Rows of a sub-tile.
TILE_SHARE, TILE_LEAST, TILE_MOST, MOST_TILES, SUB = 20, 256, 1 << 17, 2048, 512
#: Sets and shingles of a block of the exact comparison, and shingles it has bits for at a time.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 512, 1 << 21, 4096
#: Rows, of 40 bytes at most, that are broadcast at most.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 of each k-word shingle of the text, A-Z lower-cased; fewer words make one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    got = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
    return np.array(got, np.uint64)


def remixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Hashes for a further lane: a 64-bit finaliser over the hash and the lane's number."""
    if lane == 0:
        return h
    x = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(lane)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes give zero."""
    if not len(h):
        return 0
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", distinct: bool = False) -> DataFrame:
    """(id, l0 .. l{lanes-1}) for every row; null and blank texts have fingerprint zero.

    distinct: a shingle counts once however often it occurs, and `digest` tells sets apart."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(f"l{i}", T.LongType()) for i in range(lanes)), *[T.StructField("digest", T.BinaryType())] * distinct])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, digests = np.empty((lanes, b.num_rows), np.uint64), []
            with np.errstate(over="ignore"):
                for i, text in enumerate(b.column(1)):
                    h = shingle_hashes(text.as_py(), k)
                    if distinct:
                        h = np.unique(h)
                        digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    for lane in range(lanes):
                        out[lane, i] = fingerprint(remixed(h, lane))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x.view(np.int64)) for x in out), *[pa.array(digests, pa.binary())] * distinct], names=schema.names)

    return in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tidy(run), schema)


def _words16(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, total: int | None = None, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in b) of rows whose lane 0 differs in at most `radius` bits and, where there
    are more lanes, all lanes together in at most `total`. a, b: uint64 of shape (rows, lanes)."""

    def tiles(x):
        counts = _words16(x[:, 0])
        order = np.lexsort(counts.T[::-1])
        counts = counts[order]
        at = np.arange(0, len(x), SUB)
        lo = np.array([counts[i : i + SUB].min(axis=0) for i in at])
        hi = np.array([counts[i : i + SUB].max(axis=0) for i in at])
        return order, np.ascontiguousarray(x[order]), lo, hi

    if not len(a) or not len(b):
        return
    order_a, a, lo_a, hi_a = tiles(a)
    order_b, b, lo_b, hi_b = (order_a, a, lo_a, hi_a) if same else tiles(b)
    for i in range(len(lo_a)):
        gap = np.maximum(0, np.maximum(lo_b - hi_a[i], lo_a[i] - hi_b)).sum(axis=1)
        x = a[i * SUB : (i + 1) * SUB]
        left = np.ascontiguousarray(x[:, 0])
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            y = b[j * SUB : (j + 1) * SUB]
            p, q = np.nonzero(np.bitwise_count(left[:, None] ^ np.ascontiguousarray(y[:, 0])[None, :]) <= radius)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            if len(p) and a.shape[1] > 1:
                near = np.bitwise_count(x[p] ^ y[q]).sum(axis=1, dtype=np.int64) <= total
                p, q = p[near], q[near]
            if len(p):
                yield order_a[i * SUB + p], order_b[j * SUB + q]


def _cell(fingerprint: str) -> Column:
    """The population counts of a fingerprint's four 16-bit words in one number, below 17 ** 4."""
    words = [F.bit_count(F.shiftrightunsigned(fingerprint, 16 * i).bitwiseAND(0xFFFF)) * 17**i for i in range(4)]
    return sum(words[1:], words[0]).cast("int")


def tile_plan(histogram: list[tuple[int, int]], radius: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """((cell, first tile, tiles) of each cell, partner tiles of each tile), for rows counted by cell.

    Cells are halved along the word whose counts spread most until their rows fit a tile; one cell with more
    rows than that gets several. Partners are tiles in whose boxes counts can be within the radius."""
    cells, rows = np.array([c for c, _ in histogram]), np.array([n for _, n in histogram])
    at = np.stack([cells // 17**i % 17 for i in range(4)], axis=1)
    size = max(min(max(-(-rows.sum() // TILE_SHARE), TILE_LEAST), TILE_MOST), -(-rows.sum() // MOST_TILES))
    plan, boxes, todo = [], [], [np.arange(len(cells))]
    while todo:
        mine = todo.pop()
        lo, hi, n = at[mine].min(axis=0), at[mine].max(axis=0), rows[mine].sum()
        d = int(np.argmax(hi - lo))
        if n <= size or lo[d] == hi[d]:
            tiles = int(-(-n // size))
            plan += [(int(cells[i]), len(boxes), tiles) for i in mine]
            boxes += [(lo, hi)] * tiles
            continue
        along = np.bincount(at[mine, d], weights=rows[mine], minlength=18).cumsum()
        cut = min(max(int(np.searchsorted(along, n / 2)), lo[d]), hi[d] - 1)  # some on either side
        todo += [mine[at[mine, d] > cut], mine[at[mine, d] <= cut]]
    lo, hi = (np.array([box[k] for box in boxes]) for k in (0, 1))
    partners = [np.flatnonzero(np.maximum(0, np.maximum(lo - hi[t], lo[t] - hi)).sum(axis=1) <= radius).tolist() for t in range(len(boxes))]
    return plan, partners


def link_fingerprints(classes: DataFrame, radius: int, total: int | None = None) -> DataFrame:
    """Edges (src, dst) of a spanning forest, per tile pair, of the links among `classes`
    (id long, l0 ..): distinct fingerprints or sets, one row each."""
    spark = classes.sparkSession
    lanes = [c for c in classes.columns if c.startswith("l")]
    histogram = [(r[0], r[1]) for r in classes.groupBy(_cell("l0").alias("cell")).count().collect()]  # 17 ** 4 rows at most
    if not histogram:
        return spark.createDataFrame([], "src long, dst long")
    plan, partners = tile_plan(histogram, radius)
    cells = spark.createDataFrame(plan, "cell int, first int, tiles int")
    meets = spark.createDataFrame(list(enumerate(partners)), "tile int, partners array<int>")
    rows = classes.withColumn("cell", _cell("l0")).join(F.broadcast(cells), "cell")  # 17 ** 4 rows at most
    rows = rows.withColumn("tile", F.col("first") + F.pmod(F.xxhash64("id"), F.col("tiles").cast("long")).cast("int"))
    rows = rows.join(F.broadcast(meets), "tile")  # tiles: 2 * MOST_TILES and one for each cell at most
    rows = rows.select("id", *lanes, "tile", F.explode("partners").alias("other"))
    rows = rows.select(F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "id", *lanes)

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = (pdf["tile"] == key[0]).to_numpy()
        ids = pdf["id"].to_numpy()
        x = np.ascontiguousarray(pdf[lanes].to_numpy(np.int64)).view(np.uint64)
        here, there = np.flatnonzero(first), np.flatnonzero(~first)
        forest = Forest(len(ids))
        same = key[0] == key[1]
        for p, q in close_pairs(x[here], x[here] if same else x[there], radius, total, same):
            forest.link(here[p], here[q] if same else there[q])
        a, b = forest.star_edges(ids)
        return pd.DataFrame({"src": a, "dst": b})

    return rows.groupBy("ta", "tb").applyInPandas(compare, "src long, dst long")


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many members each set of x shares with each of y; sets are arrays of distinct numbers."""
    out = np.zeros((len(x), len(y)), np.int64)
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))

    def entries(sets):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    if not len(both):
        return out
    ends = [(*entries(sets), len(sets)) for sets in (x, y)]
    for first in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - first)
        part = []
        for col, row, n in ends:
            a, z = np.searchsorted(col, (first, first + COLUMNS))
            bits = np.zeros((n, -(-width // 64) * 64), bool)
            bits[row[a:z], col[a:z] - first] = True
            part.append(np.packbits(bits, axis=1).view(np.uint64))
        for i, mine in enumerate(part[0]):
            out[i] += np.bitwise_count(part[1] & mine).sum(axis=1, dtype=np.int64)
    return out


def _small(table: DataFrame) -> DataFrame:
    """A written table of rows of fixed width, broadcast if it has no more than BROADCAST_ROWS: what it is
    joined with holds whole texts, which are shuffled only beyond that."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def similar_links(docs: DataFrame, classes: DataFrame, candidates: DataFrame, k: int, similarity: float, scratch: Scratch) -> DataFrame:
    """Edges (src, dst) of spanning forests of the pairs whose shingle sets have at least that Jaccard
    similarity, among all that `candidates` (src, dst) connect. docs: (id long, text binary); classes:
    (id long, rep long, digest binary), where rep is an id in docs and tells the set with its digest.

    A component that is larger than a block is dealt by the size of the sets: sizes that differ by a
    larger factor than the similarity allows cannot link, so a block meets those of its own and of
    the two neighbouring ranges only."""
    members = connected_components(candidates).select(F.col("node").alias("id"), "component")
    members = scratch.write(members.join(classes, "id").select("id", "component", "rep", "digest"), "members")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)) for t in b.column(3)]
            mine = np.array([xxhash.xxh3_128_digest(s.tobytes()) == d.as_py() for s, d in zip(sets, b.column(2), strict=True)], bool)  # an id may repeat with other texts
            sets = [s for s, ok in zip(sets, mine, strict=True) if ok]
            sizes = np.array([len(s) for s in sets], np.int64)
            ranges = np.floor(np.log(np.maximum(sizes, 1)) / -np.log(similarity)).astype(np.int64) if similarity < 1 else sizes
            kept = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["id", "component"]).filter(pa.array(mine))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sizes), pa.array(ranges), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "component", "n", "range", "shingles"])

    texts = docs.withColumnRenamed("id", "rep").join(_small(members), "rep").select("id", "component", "digest", "text")
    sets = scratch.write(texts.mapInArrow(tidy(shingles), "id long, component long, n long, range long, shingles binary"), "sets")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    ranges = sets.groupBy("component", "range").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"), blocks.alias("blocks"))
    parts = ranges.groupBy("component").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.collect_list(F.struct("range", "blocks")).alias("parts"))  # a text's size has few ranges
    parts = scratch.write(parts.where((F.col("c") > BLOCK_SETS) | (F.col("s") > BLOCK_SHINGLES)).select("component", "parts"), "parts")
    rows = sets.join(parts, "component", "left").withColumn("range", F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.col("range")))
    place = lambda r, i: r * F.lit(1 << 32) + i
    near = F.filter("parts", lambda p: F.abs(p["range"] - F.col("range")) <= 1)
    own = F.filter("parts", lambda p: p["range"] == F.col("range"))[0]["blocks"]
    rows = rows.withColumn("at", place(F.col("range"), F.coalesce(F.pmod(F.xxhash64("id"), own.cast("long")), F.lit(0).cast("long"))))
    others = F.flatten(F.transform(near, lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda i: place(p["range"], i.cast("long")))))
    rows = rows.select("component", "at", "id", "shingles", F.explode(F.coalesce(others, F.array("at"))).alias("other"))
    rows = rows.select("component", F.least("at", "other").alias("ta"), F.greatest("at", "other").alias("tb"), "at", "id", "shingles")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, first, same = pdf["id"].to_numpy(), (pdf["at"] == key[1]).to_numpy(), key[1] == key[2]
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        sizes, forest = np.array([len(s) for s in sets]), Forest(len(ids))
        cut = lambda x: [x[i : i + BLOCK_SETS] for i in range(0, len(x), BLOCK_SETS)]
        for i, a in enumerate(cut(np.flatnonzero(first))):
            for j, b in enumerate(cut(np.flatnonzero(first if same else ~first))):
                if same and j < i:
                    continue
                shared = common([sets[p] for p in a], [sets[p] for p in b])
                p, q = np.nonzero(shared / np.maximum(sizes[a][:, None] + sizes[b][None, :] - shared, 1) >= similarity)
                forest.link(a[p], b[q])
        a, b = forest.star_edges(ids)
        return pd.DataFrame({"src": a, "dst": b})

    return rows.groupBy("component", "ta", "tb").applyInPandas(compare, "src long, dst long")


def near_groups(
    docs: DataFrame, k: int = 3, radius: int = 3, lanes: int = 1, total: int | None = None, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None
) -> DataFrame:
    """(id, component_id, l0 ..) for every row; component_id is the smallest id reachable by links.

    Two rows link when lane 0 of their fingerprints differs in at most `radius` bits and, with more
    lanes, all of them in at most `total`. Null, empty and blank texts have fingerprint zero and link
    like any other. Rows with equal fingerprints are one class, represented by its smallest id, so
    ties and repeated rows cost one comparison. With a similarity, fingerprints are of distinct shingles
    and those links are candidates: two rows link when the Jaccard similarity of their shingle sets is
    at least that, and a class has one set. A null id takes its class's component, and a class
    of null ids only links with nothing and has a null component. Ids are integers.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marks = scratch.write(fingerprints(docs, k, lanes, id_col, text_col, similarity is not None).withColumn("id", F.col("id").cast("long")), "marks")
    names = [f"l{i}" for i in range(lanes)]
    keys = [*names, *["digest"] * (similarity is not None)]
    # numbered when written; a class is told by its number, as ids may repeat with other texts
    classes = marks.groupBy(*keys).agg(F.min("id").alias("rep")).withColumn("class", F.monotonically_increasing_id())
    classes = scratch.write(classes, "classes")
    linked = classes.where("rep is not null").withColumnRenamed("class", "id")
    links = scratch.write(link_fingerprints(linked.select("id", *names), radius, total), "links")
    if similarity is not None:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
        links = scratch.write(similar_links(texts, linked.select("id", "rep", "digest"), links, k, similarity, scratch), "similar")
    found = connected_components(links).select(F.col("node").alias("class"), "component")
    found = scratch.write(classes.join(found, "class", "left").select(*keys, "rep", F.coalesce("component", "class").alias("component")), "found")
    least = scratch.write(found.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    final = scratch.write(found.join(least, "component").select(*keys, "component_id"), "final")
    return marks.join(final, keys, "left").select(F.col("id").alias(id_col), "component_id", *names)


#: For whole documents: sets of five-word shingles that share 0.8. 256 bits of four lanes only find
#: candidates: texts that share 0.8 differ in 39 bits on average, with a deviation of 6, or in 48 when
#: they have four and five shingles; in lane 0 in 10 and 12, with one of 3. The radii lie more than three
#: deviations above that, or two and a half for such short texts. Wider ones chain texts that share less
#: than half into candidate groups that grow faster than the input.
DOCUMENTS = {"k": 5, "radius": 20, "lanes": 4, "total": 64, "similarity": 0.8}


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: int) -> DataFrame:
    """One row of each near_groups component, that with the smallest id, with columns as they were.

    how: as for near_groups, DOCUMENTS by default. Rows that share an id stay or go together: they go
    if each of them has a copy with a smaller id. Rows with a null id stay."""
    groups = near_groups(docs, **(DOCUMENTS | how), id_col=id_col, text_col=text_col)
    gone = groups.groupBy(F.col(id_col).alias("_gone")).agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays")).where("not stays").select("_gone")
    gone = Scratch(docs.sparkSession, "simhash-drop").write(gone, "gone")
    gone = _small(gone)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
