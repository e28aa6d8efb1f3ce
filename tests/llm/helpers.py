"""Small tables with every awkward row: nulls, blanks, long texts, ties, repeats, clashing column names."""

from __future__ import annotations

import random

PROSE = "the and of to in a is that for it was with erth onst reand thion leau ment ción que der und schen auf".split()


def prose(seed: int, n: int = 120) -> str:
    r = random.Random(seed)
    words = [r.choice(PROSE) + (r.choice(PROSE) if r.random() < 0.6 else "") for _ in range(n)]
    return " ".join(words[:60]).capitalize() + ".\n" + " ".join(words[60:]) + "."


def rows():
    """(doc_id, text, lang, source, n_chars)."""
    out = [(i, prose(i), "en", f"s{i % 3}", 1) for i in range(30)]
    out += [(30, prose(3), "en", "s0", 1), (31, prose(3), "en", "s0", 1)]  # copies of document 3
    out += [(32, prose(4) + " tail", "en", "s1", 1)]  # near 4
    out += [(33, None, "en", "s1", 1), (34, "", "en", "s1", 1), (35, " \n\t ", None, None, None)]
    out += [(None, prose(40), None, None, None), (None, prose(41), "en", "s2", 2), (None, None, None, None, None)]
    out += [(36, prose(50), "fr", "s2", 1)] * 3  # one row three times
    out += [(37, ("word salad number nine " * 12000).strip(), "en", "s0", 1)]  # long
    out += [(38, "a", "xx", "s9", 1), (39, "é 😀 b", "es", "", 1)]
    out += [(40, " ".join(f"{w}%%%" for w in prose(60).split()), "en", "s1", 1)]
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def clashing(spark):
    """The same with further columns that carry names an operator might use inside."""
    from pyspark.sql import functions as F

    names = ["t", "w", "fp", "key", "doc_key", "size", "shard", "root", "node", "__row", "__key", "__draw", "__rate", "target_source", "salt", "part", "u", "v", "n", "k", "y", "kept", "words", "common", "classes", "component_id", "source_size", "target", "copies", "a.b"]
    return docs(spark).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
