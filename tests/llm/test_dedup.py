import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from webloom.core.scratch import Scratch
from webloom.llm import embedding_dedup, exact_dedup, simhash

WHITE = re.compile(r"[\x20\x09-\x0D]+")
ROWS = [(0, "a b"), (1, "a  b"), (2, "a\t\nb"), (3, None), (4, ""), (5, "x" * 50_000), (6, "x" * 50_000), (7, "é\u00a0b"), (8, "é b"), (9, " "), (None, "a b"), (None, "only null"), (10, "a b"), (10, "a b"), (11, "tie"), (11, "tie"), (12, " lead")]


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("runs", [1000, 2])
def test_exact_groups(spark, runs):
    rows = ROWS + [(100 + i, "hot  text") for i in range(40)]
    docs = spark.createDataFrame([(i, t, "clash", 7) for i, t in rows], "doc_id long, text string, norm string, run int")
    got = exact_dedup.exact_groups(docs, runs=runs).collect()
    assert len(got) == len(rows)
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(WHITE.sub(" ", t or ""), []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept: dict = {}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((x for x in ids if x is not None), default=None)
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}
    out = exact_dedup.deduplicate(docs, runs=runs)
    rows_out = out.collect()
    assert out.columns == docs.columns and sorted(WHITE.sub(" ", r.text or "") for r in rows_out) == sorted(groups)
    assert all(r.doc_id == min((x for x in groups[WHITE.sub(" ", r.text or "")] if x is not None), default=None) for r in rows_out)
    assert {(r.norm, r.run) for r in rows_out} == {("clash", 7)} and exact_dedup.deduplicate(docs.limit(0)).collect() == []
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []


def fingerprint(text, k=3):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_against_brute_force(spark, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(simhash, "TILE_LEAST", 40)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:120]
    rng = random.Random(2)
    for t in texts[:20]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n", "One", "one", "two words", "Two WORDS", texts[0], "É a b", "é a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("l0", F.lit("clash"))
    marks = [fingerprint(t) for t in texts]
    links = [(a, b) for a in range(len(marks)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 3]
    want = components(len(marks), links)
    got = {r.doc_id: (r.l0 & (2**64 - 1), r.component_id) for r in simhash.near_groups(docs).collect()}
    assert got == {i: (marks[i], want[i]) for i in range(len(marks))}
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns and out.count() < len(texts)
    assert simhash.near_groups(docs.limit(0)).collect() == []
    one = spark.createDataFrame([(None, "x y z"), (None, "other words here")], "doc_id long, text string")
    assert [r.component_id for r in simhash.near_groups(one).collect()] == [None, None]


def shingle_set(text, k=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def near_copies(texts):
    """The smallest position that each text reaches by pairs of equal or at least 0.8 similar shingle sets."""
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    return components(len(sets), links)


@pytest.mark.parametrize(("block", "columns"), [(512, 4096), (8, 16)])
def test_near_copies_share_four_fifths(spark, monkeypatch, block, columns):
    import pyarrow.parquet as pq

    monkeypatch.setattr(simhash, "BLOCK_SETS", block)
    monkeypatch.setattr(simhash, "COLUMNS", columns)
    rng = random.Random(3)
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()[:60]
    words = [f"w{i}" for i in range(60)]
    texts.append(" ".join(words))
    for k in range(40):  # one run of changed words, so that similarities lie on both sides of 0.8
        w = list(words)
        at, n = rng.randrange(50), k % 8
        w[at : at + n] = [f"x{k}-{i}" for i in range(n)]
        texts.append(" ".join(w))
    for k in range(30):  # few shingles, and shingles that repeat
        short = [f"s{k}-{i}" for i in range(9)]
        texts += [" ".join(short), " ".join(short[:8]), " ".join(short * 4), " ".join(short * 40)]
    texts += [None, " ", "one two", "One  two", "four words are here", "four words are there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = near_copies(texts)
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, **simhash.DOCUMENTS).collect()}
    assert got == dict(enumerate(want))
    kept = sorted((r.doc_id, r.text) for r in simhash.deduplicate(docs).collect())
    assert kept == [(i, texts[i]) for i in range(len(texts)) if want[i] == i]


def test_near_copies_among_documents(spark):
    """Recall of the candidate radii, and all components, against a comparison of all pairs."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [np.unique(simhash.shingle_hashes((t or "").encode(), 5)) for _, t in rows]
    sizes = np.array([len(s) for s in sets])
    shared = simhash.common(sets, sets)
    a, b = np.nonzero(np.triu(shared / np.maximum(sizes[:, None] + sizes[None, :] - shared, 1) >= 0.8, 1))
    with np.errstate(over="ignore"):
        marks = np.array([[simhash.fingerprint(simhash.remixed(s, lane)) for lane in range(4)] for s in sets], np.uint64)
    bits = np.bitwise_count(marks[a] ^ marks[b]).astype(int)
    found = (bits[:, 0] <= simhash.DOCUMENTS["radius"]) & (bits.sum(axis=1) <= simhash.DOCUMENTS["total"])
    assert len(a) > 50 and found.mean() >= 0.99
    blank = np.flatnonzero(sizes == 0).tolist()
    want = components(len(rows), [*zip(a.tolist(), b.tolist(), strict=True), *((x, blank[0]) for x in blank[1:])])
    got = {r.doc_id: r.component_id for r in simhash.near_groups(docs, **simhash.DOCUMENTS).collect()}
    assert got == {rows[i][0]: rows[c][0] for i, c in enumerate(want)}


@pytest.mark.parametrize(("radius", "lanes", "total"), [(0, 1, None), (3, 1, None), (16, 4, 44)])
def test_close_pairs_skip_nothing(radius, lanes, total):
    rng = np.random.default_rng(radius)
    x = rng.integers(0, 2**64, (700, lanes), dtype=np.uint64)
    x[350:] = x[:350]
    for k in range(lanes):
        x[350:, k] ^= np.uint64(1) << rng.integers(0, 64, 350, dtype=np.uint64)
    d = [np.bitwise_count(x[:, None, k] ^ x[None, :, k]).astype(int) for k in range(lanes)]
    near = (d[0] <= radius) & (total is None or sum(d) <= (total or 0))
    got = {(min(a, b), max(a, b)) for p, q in simhash.close_pairs(x, x, radius, total, True) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)}
    cross = {(a, b) for p, q in simhash.close_pairs(x[:300], x[300:], radius, total) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    assert cross == {(int(a), int(b)) for a, b in zip(*np.nonzero(near[:300, 300:]), strict=True)}


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 12))
    rows, vectors = [], []
    for i in range(150):
        v = base[i % 30] + rng.normal(size=12) * rng.choice([0.0, 0.05, 0.15])
        rows.append((i, [float(np.float32(x)) for x in v], i % 30 % 3, "clash"))
    rows[5] = (5, None, 0, "x")
    rows[6] = (6, [0.0] * 12, 0, "x")
    rows[7] = (7, [float("nan")] * 12, 0, "x")
    rows[8] = (8, [float("inf")] + [1.0] * 11, 0, "x")
    rows[9] = (9, [None] + [1.0] * 11, 0, "x")
    rows[10] = (10, rows[40][1], None, "x")
    rows[11] = (11, [1.0, 2.0], 0, "x")
    rows[12] = (12, [2.0, 4.0], 0, "x")
    rows[13] = (13, [], 0, "x")
    for k in range(14, 20):
        rows[k] = (k, rows[50][1], rows[50][2], "x")
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, links string")
    links = []
    for a in range(len(rows)):
        for b in range(a):
            u, v = rows[a], rows[b]
            if u[2] is None or u[2] != v[2] or not u[1] or not v[1] or len(u[1]) != len(v[1]) or None in u[1] or None in v[1]:
                continue
            x, y = np.float64(u[1]), np.float64(v[1])
            with np.errstate(all="ignore"):
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                    links.append((a, b))
    want = components(len(rows), links)
    for tile in (2048, 16):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.similar_groups(df, tile=tile).collect()}
        assert got == {i: (sum(i in p for p in links), want[i], want[i] == i) for i in range(len(rows))}
    assert len(links) > 100
    assert embedding_dedup.similar_groups(df.limit(0)).collect() == []


@pytest.mark.parametrize("threshold", [0.98, 0.5, -0.2])
def test_grid_loses_no_link(spark, monkeypatch, threshold):
    """Labels with enough tiles use one, two and three dimensions of the grid."""
    monkeypatch.setattr(embedding_dedup, "GRID", 3)
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 6)) * [3, 2, 1, 1, 1, 1]
    rows = [(i, [float(np.float32(x)) for x in base[i % 40] * rng.uniform(0.5, 2) + rng.normal(size=6) * rng.choice([0.02, 0.3])], int(np.searchsorted([12, 60, 180], i, side="right"))) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= threshold) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    want = components(len(rows), [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.similar_groups(df, threshold, tile=4).collect()}
    assert got == {i: (int(near[i].sum()), want[i]) for i in range(len(rows))}


def test_ids_that_repeat_with_other_vectors(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (9, [1.0, 0.01]), (9, [1.0, 0.01]), (7, [-1.0, 0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.similar_groups(df).collect() if r.vec_id is not None)
    assert got == [(5, 0, 5), (5, 2, 5), (7, 0, 7), (9, 2, 5), (9, 2, 5)]


def test_long_vectors(spark):
    v = np.random.default_rng(1).normal(size=20_000).tolist()
    df = spark.createDataFrame([(1, v, 1), (2, [x * 2 for x in v], 1), (3, v[::-1], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted((r.vec_id, r.component_id) for r in embedding_dedup.similar_groups(df).collect()) == [(1, 1), (2, 1), (3, 3)]


@pytest.mark.parametrize("how", [{}, simhash.DOCUMENTS])
def test_simhash_ids_that_repeat_and_long_texts(spark, how):
    a, b, long = (" ".join(f"{s}{i % 997}-{i // 7}" for i in range(n)) for s, n in (("a", 40), ("b", 40), ("l", 300_000)))
    rows = [(5, a), (5, b), (8, b), (9, a), (3, long), (4, long + " end"), (4, long + " end"), (None, a)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, digest string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_groups(docs, **how).collect())
    assert got == [(0, 5), (3, 3), (4, 3), (4, 3), (5, 5), (5, 5), (8, 5), (9, 5)]
    out = simhash.deduplicate(docs, **how)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, r.text[:2]) for r in out.collect()) == [(0, "a0"), (3, "l0"), (5, "a0"), (5, "b0")]


def test_copies_of_a_run():
    assert [exact_dedup.copies_of_a_run(n, 1000) for n in (0, 10, 10**6, 10**8, 5 * 10**10, 10**13)] == [2, 2, 1000, 100_000, 100_000, 10**7]


def test_copies_without_ids_are_spread(spark):
    rows = [(None if i % 2 else 7, "hot text", f"s{i}") for i in range(200)] + [(1, "cold", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = exact_dedup.exact_groups(docs, runs=20).collect()
    assert sorted((r.group_size, r.kept, r.keep_id) for r in got if r.group_size == 1 or r.kept) == [(1, True, 1), (200, True, 7)] and len(got) == 201
    keyed = docs.select(F.col("doc_id").alias("id"), exact_dedup.normalised(F.col("text")).alias("norm"), exact_dedup._spread(docs, "doc_id", "text").alias("spread"))
    runs = exact_dedup._keyed(keyed, 20, Scratch(spark, "test")).where("norm = 'hot text'").groupBy("run").count().collect()
    assert len(runs) > 10 and max(r["count"] for r in runs) < 40


def test_tiles_leave_out_what_cannot_link(monkeypatch):
    """Every two cells within the radius meet, tiles hold their bound, and most pairs of tiles do not meet."""
    monkeypatch.setattr(simhash, "TILE_LEAST", 64)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 1 << 63, 20_000).astype(np.uint64) << np.uint64(1)
    x[:3000] = x[0]
    counts = simhash._words16(x).astype(int)
    cells, n = np.unique(counts @ 17 ** np.arange(4), return_counts=True)
    plan, partners = simhash.tile_plan(list(zip(cells.tolist(), n.tolist(), strict=True)), 3)
    assert [c for c, _, _ in sorted(plan)] == cells.tolist()
    held = np.zeros(len(partners), int)
    tiles = {}
    for cell, first, m in plan:
        tiles[cell] = range(first, first + m)
        held[first] += n[np.searchsorted(cells, cell)] / m
    assert held.max() <= 20_000 / simhash.TILE_SHARE + 1 and len(partners) < 100
    at = np.stack([cells // 17**i % 17 for i in range(4)], axis=1)
    for i in rng.choice(len(cells), 60):
        for j in np.flatnonzero(np.abs(at - at[i]).sum(axis=1) <= 3):
            assert all(b in partners[a] for a in tiles[cells[i]] for b in tiles[cells[j]])
    assert sum(map(len, partners)) < 0.8 * len(partners) ** 2
    assert simhash.tile_plan([(5, 1)], 3) == ([(5, 0, 1)], [[0]])
