"""Link graphs: nodes (id, is_onion) and edges (src, dst, weight, sample_url)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.core.scratch import Scratch
from webloom.functions import urls


def edges_from_links(links: DataFrame) -> DataFrame:
    """(src, dst, weight, sample_url) of links (src, url, seq): a link's host is its dst, how often it
    occurs the weight, the first url the sample. Links without a host are left out; loops stay."""
    rows = links.withColumn("dst", urls.host(F.col("url"))).where("dst <> ''")
    return rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.min_by("url", "seq").alias("sample_url"))


def nodes_of(edges: DataFrame, domains: DataFrame | None = None, suffix: str = ".onion") -> DataFrame:
    """All ends of edges and, if given, all domains, each once."""
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    if domains is not None:
        ids = ids.unionByName(domains.select(F.col("domain").alias("id")))
    return ids.distinct().withColumn("is_onion", urls.is_hidden(F.col("id"), suffix))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, total_degree), unweighted; a loop counts on both sides."""
    sides = edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    sides = sides.unionByName(nodes.select("id", F.lit(0).alias("i"), F.lit(0).alias("o")))
    got = sides.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return got.withColumn("total_degree", F.col("in_degree") + F.col("out_degree"))


def degree_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(degree, n) over hidden nodes of their degree in the whole graph."""
    d = degrees(nodes, edges).join(nodes.where("is_onion").select("id"), "id", "left_semi")
    return d.groupBy(F.col("total_degree").alias("degree")).agg(F.count(F.lit(1)).alias("n"))


def dark_to_regular(edges: DataFrame, suffix: str = ".onion") -> DataFrame:
    """Distinct links from a hidden to a regular node."""
    hidden = lambda c: urls.is_hidden(F.col(c), suffix)
    return edges.where(hidden("src") & ~hidden("dst")).select("src", "dst").distinct()


def reachable(edges: DataFrame, start: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, depth) of nodes that paths from `start` (id) reach, the start itself at depth 0.

    Edges lie by their source, so a round shuffles its front and nothing else of the graph."""
    scratch = Scratch(edges.sparkSession, "reach")
    e = scratch.bucketed(edges.select("src", "dst").where("src <> dst").distinct(), "edges", "src")
    front = scratch.write(start.select("id").distinct().withColumn("depth", F.lit(0)), "front0")
    scratch.append(front, "seen")
    for k in range(1, max_rounds + 1):
        step = e.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = scratch.write(step.join(scratch.table("seen").select("id"), "id", "left_anti").withColumn("depth", F.lit(k)), f"front{k}")
        scratch.drop(f"front{k - 1}")
        if front.isEmpty():
            return scratch.table("seen")
        scratch.append(front, "seen")  # what is known is never written again
    raise RuntimeError(f"reach did not settle in {max_rounds} rounds")


def _spread(ids: DataFrame, edges: DataFrame, pivots: DataFrame, max_rounds: int) -> DataFrame:
    """(id, before, after) of each node: masks of the pivots that reach it, and of those that it reaches.

    pivots: (id, bit), a mask with one bit. Both directions go on in the same rounds, over edges that lie by
    source and by target; the masks lie by node, so a round shuffles what fronts hand on, merged by target."""
    scratch = Scratch(ids.sparkSession, "spread")
    one = edges.select("src", "dst")
    out, into = scratch.bucketed(one, "by-source", "src"), scratch.bucketed(one, "by-target", "dst")
    known = ids.join(pivots, "id", "left").select("id", F.coalesce("bit", F.lit(0).cast("long")).alias("before"))
    moved = F.col("before") != 0
    known = scratch.bucketed(known.select("id", "before", F.col("before").alias("after"), moved.alias("new_before"), moved.alias("new_after")), "masks0", "id")
    none = F.lit(0).cast("long")
    for k in range(1, max_rounds + 1):
        down = out.join(known.where("new_before").select(F.col("id").alias("src"), "before"), "src").select(F.col("dst").alias("id"), "before", none.alias("after"))
        up = into.join(known.where("new_after").select(F.col("id").alias("dst"), "after"), "dst").select(F.col("src").alias("id"), none.alias("before"), "after")
        got = down.unionByName(up).groupBy("id").agg(F.bit_or("before").alias("b"), F.bit_or("after").alias("a"))
        b, a = (F.col(old).bitwiseOR(F.coalesce(new, none)) for old, new in (("before", "b"), ("after", "a")))
        new = known.join(got, "id", "left").select("id", b.alias("before"), a.alias("after"), (b != F.col("before")).alias("new_before"), (a != F.col("after")).alias("new_after"))
        known = scratch.bucketed(new, f"masks{k}", "id", laid=True)
        scratch.drop(f"masks{k - 1}")
        if known.where("new_before or new_after").isEmpty():
            return known.select("id", "before", "after")
    raise RuntimeError(f"a search did not settle in {max_rounds} rounds")


#: Pivots that are searched from at once: bits of a mask.
PIVOTS = 64


def strong_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(id, component) of every node; component is the smallest id in it.

    A round shrinks the graph in two ways. A node without an edge in, or out, is a component of its own and
    goes. A node with a single neighbour before it, or behind it, is merged into that one if a coin, its hash,
    falls so; chains and rings halve, whatever their length. Where too little goes, PIVOTS nodes that a
    hash chooses are searched from, both ways at once: what reaches a pivot and is reached by it is its
    component, and of the rest only edges stay between nodes that the same pivots reach and that reach the same.
    At the end the merged nodes are told, the last ones first: a path through one went through its single
    neighbour, so it is of that one's component if what lies on its other side is, and else of its own.
    """
    scratch = Scratch(nodes.sparkSession, "scc")
    e = scratch.write(edges.select("src", "dst").where("src <> dst").distinct(), "edges0")
    size, merges = e.count(), []
    known = False  # whether a component of more than one node is
    for k in range(1, max_rounds + 1):
        if not size:
            break
        both = scratch.write(_merged_ends(e, _pointers(e, k, scratch)), f"both{k}")
        if not both.where("not gone and (side_src = 1 or side_dst = 2)").isEmpty():
            merges.append(both)
        inner = both.where("not gone").select(F.coalesce("to_src", "src").alias("src"), F.coalesce("to_dst", "dst").alias("dst")).where("src <> dst").distinct()
        e = scratch.write(inner, f"edges{k}")
        scratch.drop(f"edges{k - 1}", f"pointers{k}")
        before, size = size, e.count()
        if size and before - size < before / 16:
            e, known = scratch.write(_split(e, k, scratch, max_rounds), f"split{k}"), True
            size = e.count()
    else:
        raise RuntimeError(f"strong components did not settle in {max_rounds} rounds")
    none = nodes.sparkSession.createDataFrame([], T.StructType([nodes.schema["id"], T.StructField("root", nodes.schema["id"].dataType)]))
    for both in reversed(merges):
        scratch.append(_told(both, scratch.table("found") if known else none), "found")
        known = True
    roots = scratch.table("found") if known else none
    rows = scratch.write(nodes.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "rows")
    least = rows.groupBy("root").agg(F.min("id").alias("component"))
    return rows.join(least, "root").select("id", "component")


def _pointers(e: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(id, side, to): nodes that go (side 0), and those merged into their only neighbour before (1) or behind (2)."""
    ends = e.select(F.col("src").alias("id"), F.col("dst").alias("behind"), F.lit(None).alias("before"))
    ends = ends.unionByName(e.select(F.col("dst").alias("id"), F.lit(None).alias("behind"), F.col("src").alias("before")))
    ends = ends.groupBy("id").agg(F.count("before").alias("n_before"), F.min("before").alias("before"), F.count("behind").alias("n_behind"), F.min("behind").alias("behind"))
    head = lambda c: F.xxhash64(F.lit(k), F.col(c)) % 2 == 0
    side = F.when((F.col("n_before") == 0) | (F.col("n_behind") == 0), 0)
    side = side.when(~head("id") & (F.col("n_before") == 1) & head("before"), 1).when(~head("id") & (F.col("n_behind") == 1) & head("behind"), 2)
    to = F.when(F.col("side") == 1, F.col("before")).when(F.col("side") == 2, F.col("behind"))
    return scratch.write(ends.withColumn("side", side).where("side is not null").select("id", "side", to.alias("to")), f"pointers{k}")


def _merged_ends(e: DataFrame, p: DataFrame) -> DataFrame:
    """Edges with what each end is merged into, and whether an end goes."""
    at = lambda end: p.select(F.col("id").alias(end), F.col("side").alias(f"side_{end}"), F.col("to").alias(f"to_{end}"))
    both = e.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    gone = F.coalesce(F.col("side_src") == 0, F.lit(False)) | F.coalesce(F.col("side_dst") == 0, F.lit(False))
    return both.withColumn("gone", gone)


def _told(both: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, root) of merged nodes that belong with the node they were merged into."""
    kept = both.where("not gone")
    rows = kept.where("side_src = 1").select(F.col("src").alias("id"), F.col("to_src").alias("to"), F.coalesce("to_dst", "dst").alias("other"))
    rows = rows.unionByName(kept.where("side_dst = 2").select(F.col("dst").alias("id"), F.col("to_dst").alias("to"), F.coalesce("to_src", "src").alias("other")))
    at = lambda end: roots.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
    rows = rows.join(at("to"), "to", "left").join(at("other"), "other", "left")
    rows = rows.withColumns({"root_to": F.coalesce("root_to", "to"), "root_other": F.coalesce("root_other", "other")})
    return rows.where("root_to = root_other").select("id", F.col("root_to").alias("root")).distinct()


def _split(e: DataFrame, k: int, scratch: Scratch, max_rounds: int) -> DataFrame:
    """Edges that are left when the components of some pivots are found, and what they tell apart is cut."""
    ids = scratch.write(e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct(), f"ids{k}")
    chosen = ids.orderBy(F.xxhash64(F.lit(k), "id"), "id").limit(PIVOTS).collect()
    pivots = e.sparkSession.createDataFrame([(r.id, (1 << i) - (1 << 64 if i == 63 else 0)) for i, r in enumerate(chosen)], T.StructType([T.StructField("id", ids.schema["id"].dataType), T.StructField("bit", T.LongType())]))
    masks = _spread(ids, e, pivots, max_rounds)  # a written table
    own = F.col("before").bitwiseAND(F.col("after"))
    of_pivot = masks.join(pivots.select("id"), "id", "left_semi").groupBy(own.alias("own")).agg(F.min("id").alias("root"))  # PIVOTS rows
    inside = masks.where(own != 0).select("id", own.alias("own")).join(F.broadcast(of_pivot), "own")
    scratch.append(inside.select("id", "root"), "found")
    rest = masks.where(own == 0)
    at = lambda end: rest.select(F.col("id").alias(end), F.struct("before", "after").alias(f"m_{end}"))
    return e.join(at("src"), "src").join(at("dst"), "dst").where("m_src = m_dst").select("src", "dst")


def largest_component(components: DataFrame) -> DataFrame:
    """One row (component, n): the largest, of equals the smallest id."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1)


def bow_tie(nodes: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(id, part): core (the largest strong component), in, out or tendrils.

    What one node of the core reaches, all of it reaches, so one search each way is enough."""
    scratch = Scratch(nodes.sparkSession, "bowtie")
    c = scratch.write(strong_components(nodes, edges) if components is None else components, "components")
    top = scratch.write(largest_component(c).select("component"), "largest")
    core = c.join(top, "component", "left_semi").select("id", F.lit(True).alias("core"))
    start = top.select(F.col("component").alias("id"), F.lit(1).cast("long").alias("bit"))
    links = edges.select("src", "dst").where("src <> dst").distinct()
    found = _spread(nodes.select("id").distinct(), links, start, max_rounds=10_000)
    part = F.when(F.col("core"), "core").when(F.col("after") != 0, "in").when(F.col("before") != 0, "out").otherwise("tendrils")
    return found.join(core, "id", "left").select("id", part.alias("part"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, triangles, degree, coefficient) of hidden nodes in the undirected graph among them.

    Each edge points from its end of lower degree to that of higher, so a hub is the middle of few
    pairs: no node has more outgoing edges than the root of twice the number of edges."""
    scratch = Scratch(nodes.sparkSession, "triangles")
    hidden = nodes.where("is_onion").select("id").distinct()
    e = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    e = e.join(hidden.withColumnRenamed("id", "a"), "a", "left_semi").join(hidden.withColumnRenamed("id", "b"), "b", "left_semi")
    e = scratch.write(e.select("a", "b"), "edges")
    ends = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id")))
    d = scratch.write(ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    ranked = e.join(d.select(F.col("id").alias("a"), F.col("degree").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("degree").alias("db")), "b")
    up = F.struct("da", "a") < F.struct("db", "b")
    directed = scratch.write(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")), "directed")
    pairs = directed.alias("p").join(directed.alias("q"), F.expr("p.x = q.x and p.y < q.y")).select(F.col("p.x").alias("x"), F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    closed = pairs.join(e, (F.least("y", "z") == e["a"]) & (F.greatest("y", "z") == e["b"]), "left_semi")
    t = closed.select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    rows = hidden.join(d, "id", "left").join(t, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.coalesce("degree", F.lit(0)).alias("degree"))
    both = F.col("degree") * (F.col("degree") - 1)
    return rows.withColumn("coefficient", F.when(both > 0, 2.0 * F.col("triangles") / both).otherwise(0.0))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iter: int = 200, use_weights: bool = True, fixed: int | None = None) -> DataFrame:
    """(id, pagerank) with uniform teleport and dangling mass; weights are normalised by source.

    Stops when ranks move by less than nodes * tol in all; all ranks are 0 if they never do. `fixed`
    runs as many rounds and asks no more."""
    scratch = Scratch(nodes.sparkSession, "pagerank")
    w = edges.groupBy("src", "dst").agg((F.sum("weight") if use_weights else F.lit(1)).cast("double").alias("w"))
    total = w.groupBy("src").agg(F.sum("w").alias("t"))
    w = scratch.bucketed(w.join(total, "src").select("src", "dst", (F.col("w") / F.col("t")).alias("w")), "shares", "src")
    ids = nodes.select("id").distinct().join(w.select(F.col("src").alias("id"), F.lit(True).alias("leads")).distinct(), "id", "left")
    ids = scratch.bucketed(ids.select("id", F.col("leads").isNull().alias("ends")), "ids", "id")
    n, lost = ids.agg(F.count(F.lit(1)), F.count_if("ends")).first()
    if not n:
        return ids.select("id", F.lit(0.0).alias("pagerank"))
    ranks, lost = ids.withColumn("pagerank", F.lit(1.0 / n)), lost / n
    for k in range(1, (fixed or max_iter) + 1):
        # shares lie by source and ranks by node: what is shuffled is what the ranks hand on, summed up before
        got = w.join(ranks.select(F.col("id").alias("src"), "pagerank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") * F.col("w")).alias("got"))
        value = F.lit(alpha) * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)) + F.lit((1 - alpha) / n)
        new = ranks.join(got, "id", "left").select("id", "ends", value.alias("pagerank"), F.abs(value - F.col("pagerank")).alias("moved"))
        ranks = scratch.bucketed(new, f"ranks{k}", "id", laid=True)
        scratch.drop(f"ranks{k - 1}")
        moved, lost = ranks.agg(F.sum("moved"), F.coalesce(F.sum(F.when(F.col("ends"), F.col("pagerank"))), F.lit(0.0))).first()
        if fixed is None and moved < n * tol:
            return ranks.select("id", "pagerank")
    return ranks.select("id", "pagerank") if fixed else ids.select("id", F.lit(0.0).alias("pagerank"))


def node_stats(nodes: DataFrame, edges: DataFrame, top_n: int | None = 100, use_weights: bool = True, parts: DataFrame | None = None, fixed: int | None = None) -> DataFrame:
    """(id, degrees, pagerank, in_bow_tie_core) of the nodes of highest degree; of equals the first id.

    parts: those of bow_tie, where they are known already. fixed: as for pagerank."""
    parts = bow_tie(nodes, edges) if parts is None else parts
    rows = degrees(nodes, edges).join(pagerank(nodes, edges, use_weights=use_weights, fixed=fixed), "id", "left").join(parts, "id", "left")
    rows = rows.select("id", "in_degree", "out_degree", "total_degree", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), F.coalesce(F.col("part") == "core", F.lit(False)).alias("in_bow_tie_core"))
    return rows if top_n is None else rows.orderBy(F.desc("total_degree"), "id").limit(top_n)


def stats(nodes: DataFrame, edges: DataFrame, suffix: str = ".onion", components: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(metric, value): sizes, strong components, clustering, bow-tie parts and links out of the dark.

    components, parts: those of strong_components and bow_tie, where they are known already."""
    scratch = Scratch(nodes.sparkSession, "stats")
    distinct = scratch.write(edges.select("src", "dst").distinct(), "edges")
    c = scratch.write(strong_components(nodes, distinct), "components") if components is None else components
    parts = scratch.write(bow_tie(nodes, distinct, c), "parts") if parts is None else parts
    core = parts.where("part = 'core'").select("id")
    in_core = distinct.join(core.withColumnRenamed("id", "src"), "src", "left_semi").join(core.withColumnRenamed("id", "dst"), "dst", "left_semi")
    count = lambda df, name: df.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(name).alias("metric"), "value")
    out = count(nodes, "nodes").unionByName(count(distinct, "edges"))
    out = out.unionByName(count(nodes.where("is_onion"), "onion_nodes")).unionByName(count(nodes.where("not is_onion"), "web_nodes"))
    out = out.unionByName(count(c.select("component").distinct(), "components")).unionByName(count(in_core, "core_edges"))
    for p in ("core", "in", "out", "tendrils"):
        out = out.unionByName(count(parts.where(F.col("part") == p), p))
    mean = clustering(nodes, distinct).agg(F.when(F.count(F.lit(1)) < 2, 0.0).otherwise(F.avg("coefficient")).alias("value"))
    out = out.unionByName(mean.select(F.lit("clustering").alias("metric"), "value"))
    return out.unionByName(count(dark_to_regular(distinct, suffix), "dark_to_regular"))


def as_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): a line for every node and edge, for a file that readers can stream."""
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "is_onion")).alias("json"))
    return n.unionByName(edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("src", "dst", "weight")).alias("json")))


def document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(json): rows that make one json document {"nodes": [...], "edges": [...]} when read in order, as files
    written of them are. Sorted by ranges, so no task and no row holds the graph."""
    first, link = nodes.agg(F.min("id")).first()[0], edges.agg(F.min(F.struct("src", "dst"))).first()[0]
    comma = lambda at, least: F.when(at == least, "").otherwise(",")
    n = nodes.select(F.lit(1).alias("part"), F.struct(F.col("id").alias("a"), F.lit("").alias("b")).alias("at"), F.concat(comma(F.col("id"), F.lit(first)), F.to_json(F.struct("id", "is_onion"))).alias("json"))
    least = F.struct(F.lit(link and link[0]).alias("src"), F.lit(link and link[1]).alias("dst"))
    e = edges.select(F.lit(3), F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.concat(comma(F.struct("src", "dst"), least), F.to_json(F.struct("src", "dst", "weight"))))
    frame = nodes.sparkSession.createDataFrame([(0, ("", ""), '{"nodes":['), (2, ("", ""), '],"edges":['), (4, ("", ""), "]}")], "part int, at struct<a: string, b: string>, json string")
    return n.union(e).union(frame).orderBy("part", "at").select("json")
