"""Cryptocurrency addresses in text, with the context that says whose they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.text import RUN, runs

#: Currency and shape of an address. First characters differ, so no run fits two.
SHAPES = (
    ("bitcoin", "[13][a-km-zA-HJ-NP-Z1-9]{25,34}"),
    ("bitcoin", "bc1[a-zA-HJ-NP-Z0-9]{25,39}"),
    ("ethereum", "0x[a-fA-F0-9]{40}"),
    ("monero", "4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}"),
)
ANY = "|".join(f"(?:{shape})" for _, shape in SHAPES)
WINDOW, SNIPPET = 300, 200

EDGE, NOT_RUN = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
#: Words near an address that claim it for the site, or mark it as an example.
CLAIMS = "donat|our wallet|our address|payment|accept|tip"
GIVING = "donat|pay|send|wallet|tip"
#: Tags looked for around an address.
TAGS = {"in_a_tag": "<a", "in_form": "<form", "in_footer": "<footer", "in_table": "<t[dhr]", "in_list": "<[ou]l", "in_img": "<img"}


def whole_word(text: Column, words: str) -> Column:
    return text.rlike(f"(^|{NOT_RUN})({words})($|{NOT_RUN})")


def currency(token: Column) -> Column:
    return F.coalesce(*[F.when(token.rlike(f"^(?:{shape})$"), F.lit(name)) for name, shape in SHAPES])


def scan(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, address, currency, pos, context): each address once a row, at its first place.

    pos counts code points from 0; context is up to 300 characters either side, lower-cased. A row
    that holds no candidate is left out before its text is split into runs.
    """
    t = F.col(text)
    rows = df.where(t.rlike(f"(?:{ANY})"))
    found = F.array_distinct(F.filter(runs(t), lambda x: x.rlike(f"^(?:{ANY})$")))
    rows = rows.select(*keys, t.alias("_text"), F.explode(found).alias("address"))
    # nearly always the first place where the characters stand is a whole run; the search over runs is for the rest
    rows = rows.withColumn("_at", F.expr("instr(_text, address)"))
    behind = F.substring("_text", F.col("_at") + F.length("address"), F.lit(1))
    whole = ((F.col("_at") == 1) | ~F.substring("_text", F.col("_at") - 1, F.lit(1)).rlike(EDGE)) & ~behind.rlike(EDGE)
    before = F.expr(rf"regexp_extract(_text, concat('(?s)^(.*?{NOT_RUN}|)', address, '(?:{NOT_RUN}|$)'), 1)".replace("\\", "\\\\"))
    pos = F.when(whole, F.col("_at") - 1).otherwise(F.length(before))
    rows = rows.withColumn("pos", pos).withColumn("currency", currency(F.col("address")))
    begin = F.greatest(F.col("pos") - WINDOW, F.lit(0))
    context = F.lower(F.substring(F.col("_text"), begin + 1, F.col("pos") - begin + F.length("address") + WINDOW))
    return rows.select(*keys, "address", "currency", F.col("pos").cast("long").alias("pos"), context.alias("context"))


def self_attributed(context: Column) -> Column:
    return whole_word(context, CLAIMS) & ~whole_word(context, "example")


def context_flags(context: Column) -> dict[str, Column]:
    """The nine flags that attribution is decided by."""
    flags = {name: context.rlike(f"{tag}($|{NOT_RUN})") for name, tag in TAGS.items()}
    flags |= {"in_url": F.contains(context, F.lit("href=")), "near_donate": whole_word(context, GIVING), "near_example": whole_word(context, "example")}
    return flags


def snippet(context: Column) -> Column:
    return F.substring(context, 1, SNIPPET)


__all__ = ["ANY", "CLAIMS", "GIVING", "RUN", "SHAPES", "TAGS", "context_flags", "currency", "scan", "self_attributed", "snippet", "whole_word"]
