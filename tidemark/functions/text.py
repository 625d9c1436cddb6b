"""Text expressions: all native but shorten(), which, unless plain, wraps the standard library."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as str.strip() has it; Java's (?U)\s lacks the four separators.
SPACE = r"[\s\x1c-\x1f]"
#: Characters beyond the width by which shorten() tells where words part; only a longer run of hyphens would hide it.
SHOWN = 1000


def strip(text: Column) -> Column:
    """text without white space of any script at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white texts."""
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def words(text: Column) -> Column:
    """White-space tokens; none for blank texts."""
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(strip(text), rf"(?U){SPACE}+"))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def let(value: Column, use) -> Column:
    """use(value) with value computed once, where lambdas would repeat it for each element."""
    return F.transform(F.array(value), use)[0]


def linearize(*columns: Column) -> Column:
    """Values joined by ' | '; nulls are left out."""
    return F.concat_ws(" | ", *[c.cast("string") for c in columns])


def fill(template: str, **values: Column) -> Column:
    """A str.format template filled natively: {name} from values, {{ and }} as braces."""
    parts: list[Column] = []
    literal, i = "", 0
    while i < len(template):
        two = template[i : i + 2]
        if two in ("{{", "}}"):
            literal, i = literal + two[0], i + 2
        elif template[i] == "{":
            end = template.index("}", i)
            parts += [F.lit(literal), values[template[i + 1 : end]].cast("string")]
            literal, i = "", end + 1
        else:
            literal, i = literal + template[i], i + 1
    return F.concat(*[F.coalesce(p, F.lit("")) for p in [*parts, F.lit(literal)]])


def shorten(text: Column, width: int = 800, plain: bool = False) -> Column:
    """White space collapsed; cut at a word or hyphen so that it fits with ' [...]'.

    Texts that fit stay in the JVM; of longer ones only what may show goes to
    Python, whose textwrap says where words and hyphens part. plain: ASCII white
    space alone parts words, as SQL has it, and all stays in the JVM.
    """
    if plain:
        joined = F.trim(F.regexp_replace(text, r"[\t\n\f\r ]+", " "))
        shown = F.regexp_extract(F.substring(joined, 1, width - 5), "(?s)^(.*) ", 1)
        return F.when(F.length(joined) <= width, joined).when(shown == "", "[...]").otherwise(F.concat(shown, F.lit(" [...]")))

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else textwrap.shorten(t, width, placeholder=" [...]"))

    flat = F.array_join(words(text), " ")
    long = F.length(flat) > width
    return F.when(long, cut(F.when(long, F.substring(flat, 1, width + SHOWN)))).when(text.isNotNull(), flat)


def first_json_array(text: Column) -> Column:
    """From the first '[' to the first ']' after it, trailing commas mended; null without one."""
    found = F.nullif(F.regexp_extract(text, r"(?s)\[.*?\]", 0), F.lit(""))
    return F.regexp_replace(found, r",(\s*[\]}])", "$1")


def lenient_json_array(text: Column) -> Column:
    """From the first '[' to the ']' that closes it, brackets inside strings passed over; null without one.

    Trailing commas are mended only if it isn't JSON as it stands. An automaton
    steps over the text's marks and the stretches between them, so time is
    linear in the text, and no pattern recurses.
    """
    pieces = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\[.*", 0), F.lit(r'(?s)\\.|["\[\]]|[^"\\\[\]]+|\\'), F.lit(0))

    def step(s: Column, piece: Column) -> Column:
        inside = F.when(piece == '"', ~s["inside"]).otherwise(s["inside"])
        depth = s["depth"] + F.when(s["inside"], 0).when(piece == "[", 1).when(piece == "]", -1).otherwise(0)
        end = F.when((s["end"] == 0) & ~s["inside"] & (piece == "]") & (depth == 0), s["at"] + 1).otherwise(s["end"])
        return F.struct((s["at"] + 1).alias("at"), depth.alias("depth"), inside.alias("inside"), end.alias("end"))

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(0).alias("end"))

    def closed(p: Column) -> Column:
        end = F.aggregate(p, start, step)["end"]
        return let(end, lambda e: F.when(e > 0, F.array_join(F.slice(p, 1, F.greatest(e, F.lit(1))), "")))

    def mended(found: Column) -> Column:
        return F.when(F.try_parse_json(found).isNotNull(), found).otherwise(F.regexp_replace(found, r",(\s*[\]}])", "$1"))

    return let(let(pieces, closed), mended)


def parse_arguments(text: Column) -> Column:
    """Tool arguments as JSON text: null gives {}, what isn't JSON is wrapped under _raw."""
    wrapped = F.to_json(F.struct(text.alias("_raw")))
    return F.when(text.isNull(), "{}").when(F.try_parse_json(text).isNull(), wrapped).otherwise(text)
