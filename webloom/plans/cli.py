"""Command line over the jobs: python -m webloom COMMAND. Pages are read from a capture, never fetched."""

from __future__ import annotations

import argparse

from webloom.core.session import session
from webloom.operators import seeds as seed_ops
from webloom.operators.models import Classifiers
from webloom.plans import jobs
from webloom.sources import tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="webloom", description=__doc__)
    p.add_argument("--db", required=True, help="folder of the tables")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)
    # Names of commands and switches.
    s = sub.add_parser("seed", help="collect seed names from captured pages")
    s.add_argument("--capture", required=True, help="parquet with columns url and body")
    s.add_argument("--blacklist", required=True, help="text file of names that are never seeds")
    s.add_argument("--output", default="seeds.txt")
    s.add_argument("--sitemap", default="", help="comma-separated urls of sitemaps")
    s.add_argument("--indexers", default="", help="comma-separated urls of lists of names")
    s.add_argument("--search", default="", help="address of a search engine, with {query} in it")
    s.add_argument("--words", default="", help="file of extra words, one a line")
    s.add_argument("--max-queries", type=int, default=30)
    for source in ("sitemap", "indexers", "search"):
        s.add_argument(f"--no-{source}", action="store_true", help=f"leave out --{source}")
    c = sub.add_parser("crawl", help="search captured pages from seeds and analyse them")
    c.add_argument("--seeds", required=True)
    c.add_argument("--pages", required=True, help="parquet of captured pages")
    c.add_argument("--mode", choices=("crawl", "explore"), default="crawl")
    c.add_argument("--max-pages", type=int, default=75)
    c.add_argument("--model-dir")
    k = sub.add_parser("check", help="availability of known domains in a capture")
    k.add_argument("--pages", required=True)
    g = sub.add_parser("graph", help="figures of the link graph")
    g.add_argument("--output")
    g.add_argument("--lines", action="store_true", help="a json line for each node and edge, in place of one json document over all files")
    sub.add_parser("wallets", help="cluster addresses and flag outliers")
    sub.add_parser("report", help="summary of the tables")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(a.master)
    store = tables.Store(spark, a.db)
    show = lambda df: df.show(100, truncate=False)
    if a.command == "seed":
        given = lambda source: "" if getattr(a, f"no_{source}") else getattr(a, source)
        pages = lambda source: spark.createDataFrame([(u,) for u in tables.split_list(given(source))], "url string") if given(source) else None
        listed = seed_ops.names_in(spark.read.text(a.blacklist), "value")
        more = tables.read_words(spark, a.words) if a.words else None
        found = jobs.seed_job(spark.read.parquet(a.capture), listed, pages("sitemap"), pages("indexers"), given("search") or None, more, a.max_queries)
        tables.write_seeds(found, a.output)
    elif a.command == "crawl":
        models = Classifiers.load(spark, a.model_dir) if a.model_dir else None
        show(jobs.crawl_job(store, tables.read_seeds(spark, a.seeds), spark.read.parquet(a.pages), a.mode, a.max_pages, models))
    elif a.command == "check":
        show(jobs.check_job(store, spark.read.parquet(a.pages)))
    elif a.command == "graph":
        out = jobs.graph_job(store)
        show(out["stats"])
        show(out["top"])
        if a.output:
            out["lines" if a.lines else "document"].select("json").write.mode("overwrite").text(a.output)
    elif a.command == "wallets":
        show(jobs.wallets_job(store).where("is_outlier"))
    else:
        for name, df in jobs.report_job(store).items():
            print(name)
            show(df)
    return 0
