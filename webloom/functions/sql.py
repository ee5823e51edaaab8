"""The engine's functions by name, for those who ask in SQL."""

from __future__ import annotations

import regex
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from webloom.functions import addresses, urls

_RUNS = regex.compile(r"[\p{L}\p{N}_]+")
_ADDRESS = regex.compile(addresses.ANY)
_SHAPES = [(name, regex.compile(shape)) for name, shape in addresses.SHAPES]


@udtf(returnType="address string, currency string, pos bigint, context string")
class AddressScan:
    """Each cryptocurrency address of a text once, at its first place: what addresses.scan gives for a row."""

    def eval(self, text: str):
        if not text or not _ADDRESS.search(text):
            return
        seen = set()
        for run in _RUNS.finditer(text):
            found = run[0]
            if found in seen or not _ADDRESS.fullmatch(found):
                continue
            seen.add(found)
            begin = max(run.start() - addresses.WINDOW, 0)
            currency = next(name for name, shape in _SHAPES if shape.fullmatch(found))
            yield found, currency, run.start(), text[begin : run.end() + addresses.WINDOW].lower()


def _quoted(pattern: str) -> str:
    """A string of SQL in which nothing is escaped."""
    quote = '"' if "'" in pattern else "'"
    return f"r{quote}{pattern}{quote}"


def _near(words: str) -> str:
    return f"context rlike {_quoted(f'(^|{addresses.NOT_RUN})({words})($|{addresses.NOT_RUN})')}"


def definitions() -> dict[str, str]:
    """SQL of each function, its name first. All are expressions, which are planned like any other."""
    host = f"lower(btrim(regexp_extract(coalesce(url, ''), {_quoted(urls.HOST)}, 1), '[]'))"
    edge = r"[\p{L}\p{N}_]"
    name = _quoted(rf"(?i)(?<!{edge})(?:[a-z2-7]{{56}}|[a-z2-7]{{16}})\.onion(?!{edge})")
    flags = {k: f"context rlike {_quoted(f'{tag}($|{addresses.NOT_RUN})')}" for k, tag in addresses.TAGS.items()}
    flags |= {"in_url": "contains(context, 'href=')", "near_donate": _near(addresses.GIVING), "near_example": _near("example")}
    struct = ", ".join(f"{k}: boolean" for k in flags)
    return {
        "url_host(url string) returns string": host,
        "is_hidden(domain string) returns boolean": "coalesce(endswith(lower(domain), '.onion'), false)",
        "hidden_names(t string) returns array<string>": f"array_sort(array_distinct(transform(regexp_extract_all(coalesce(t, ''), {name}, 0), x -> lower(x))))",
        "context_flags(context string) " + f"returns struct<{struct}>": "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in flags.items()) + ")",
        "self_attributed(context string) returns boolean": f"{_near(addresses.CLAIMS)} and not {_near('example')}",
    }


def register(spark: SparkSession) -> None:
    """Makes address_scan(text), a table function, and the functions of definitions() known to the session."""
    spark.udtf.register("address_scan", AddressScan)
    for head, body in definitions().items():
        spark.sql(f"create or replace temporary function {head} return {body}")
