"""Text to tokens, dictionaries, n-grams and document-term features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.ordering import rank_by_count, row_numbers

TOKEN = "[a-z]+"


def tokenize(df: DataFrame, text: str, keys: tuple[str, ...], pattern: str = TOKEN) -> DataFrame:
    """(keys, pos, tok): matches of a pattern in the lower-cased text; pos counts from 0."""
    return df.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("pos", "tok"))


def token_lists(df: DataFrame, text: str, keys: tuple[str, ...], pattern: str = TOKEN) -> DataFrame:
    """(keys, toks): the tokens of a text as one array. What concerns neighbours is done inside the row: no token is
    shuffled to meet the one beside it."""
    return df.select(*keys, F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0)).alias("toks"))


def sentences(df: DataFrame, text: str, keys: tuple[str, ...], ends: str = "[^.!?]+", pattern: str = TOKEN) -> DataFrame:
    """(keys, sent, toks): the tokens of each stretch between sentence ends; sent counts from 0."""
    one = df.select(*keys, F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(ends), F.lit(0))).alias("sent", "__s"))
    return token_lists(one, "__s", (*keys, "sent"), pattern)


def _shifted(n: int) -> list[Column]:
    """The array toks from its i-th element on, for i from 0 to n - 1."""
    return [F.col("toks") if i == 0 else F.slice("toks", i + 1, F.greatest(F.size("toks"), F.lit(1))) for i in range(n)]


def dictionary(tokens: DataFrame, column: str = "tok") -> DataFrame:
    """(tok, cnt): how often each token occurs."""
    return tokens.groupBy(column).agg(F.count("*").alias("cnt"))


def first_seen_ids(tokens: DataFrame, order: tuple[str, str], column: str = "tok") -> DataFrame:
    """(tok, cnt, id): ids from 0 by first occurrence in the order of two whole-number columns (a text's key and a place
    below 2**32), which are packed in one number, so that a token's first place is a plain partial minimum."""
    first = F.col(order[0]).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + F.col(order[1]).cast("decimal(11,0)")
    g = tokens.groupBy(column).agg(F.count("*").alias("cnt"), F.min(first).alias("__first"))
    return row_numbers(g, ("__first",), "id").select(column, "cnt", "id")


def trim(dictionary: DataFrame, least: int) -> DataFrame:
    return dictionary.where(F.col("cnt") >= least)


def trim_to_size(dictionary: DataFrame, size: int) -> DataFrame:
    """Tokens at the lowest count threshold that leaves at most `size` of them. The threshold comes from a table of
    counts of counts, which is small whatever the dictionary's size."""
    of_counts = dictionary.groupBy("cnt").agg(F.count("*").alias("n"))
    reach = of_counts.withColumn("kept", F.sum("n").over(Window.orderBy(F.desc("cnt"))))
    least = reach.where(F.col("kept") <= size).agg(F.coalesce(F.min("cnt"), F.lit(2**62)).alias("least"))
    return dictionary.crossJoin(F.broadcast(least)).where("cnt >= least").drop("least")


def union(*dictionaries: DataFrame) -> DataFrame:
    """Counts of equal tokens added."""
    out = dictionaries[0]
    for d in dictionaries[1:]:
        out = out.unionByName(d)
    return out.groupBy("tok").agg(F.sum("cnt").alias("cnt"))


def roll_up(tokens: DataFrame, day: str, month: Column, least: int) -> DataFrame:
    """Counts kept at `least` within a day, then at four times that within a month, then added over all months."""
    daily = tokens.groupBy(day, "tok").agg(F.count("*").alias("cnt")).where(F.col("cnt") >= least)
    monthly = daily.groupBy(month.alias("__month"), "tok").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= 4 * least)
    return monthly.groupBy("tok").agg(F.sum("cnt").alias("cnt"))


def ranked(dictionary: DataFrame) -> DataFrame:
    """(tok, cnt, rank): ids from 0 by falling count, ties by token."""
    return rank_by_count(dictionary, "cnt", ("tok",), "rank").select("tok", "cnt", "rank")


def map_ids(tokens: DataFrame, ids: DataFrame, missing: int = -1) -> DataFrame:
    """Adds the token's id of a dictionary (tok, rank), or `missing`."""
    return tokens.join(ids.select("tok", F.col("rank").alias("id")), "tok", "left").withColumn("id", F.coalesce("id", F.lit(missing).cast("long")))


def ngrams(lists: DataFrame, n: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pos, w1..wn) of token lists: n tokens in a row and the place of the last."""
    zipped = lists.where(F.size("toks") >= n).select(*keys, F.posexplode(F.arrays_zip(*[c.alias(f"w{i + 1}") for i, c in enumerate(_shifted(n))])).alias("__p", "__g"))
    grams = zipped.select(*keys, (F.col("__p") + n - 1).alias("pos"), *[F.col("__g").getField(f"w{i}").alias(f"w{i}") for i in range(1, n + 1)])
    return grams.where(F.col(f"w{n}").isNotNull())


def ngram_counts(lists: DataFrame, n: int) -> DataFrame:
    """(w1..wn, cnt): grams are made inside the row and counted before they are shuffled."""
    names = [f"w{i}" for i in range(1, n + 1)]
    return ngrams(lists, n).groupBy(*names).agg(F.count("*").alias("cnt"))


def doc_term(tokens: DataFrame, ids: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, id, cnt): counts of dictionary tokens in each text; unknown tokens are left out. Tokens are counted by
    text first, so that a common token travels once a text."""
    counted = tokens.groupBy(*keys, "tok").agg(F.count("*").alias("cnt"))
    return counted.join(ids.select("tok", F.col("rank").alias("id")), "tok").select(*keys, "id", "cnt")


def window_pairs(lists: DataFrame, reach: int, own: Column | None = None) -> DataFrame:
    """(centre, context, offset) of tokens at most `reach` apart in one list. `own`, if given, is each centre's own
    reach, from the list's columns and pos."""
    keep = [c for c in lists.columns if c != "toks"]
    names = [f"t{i}" for i in range(reach + 1)]
    zipped = lists.select(*keep, F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in zip(names, _shifted(reach + 1))])).alias("pos", "__z"))
    first = F.col("__z.t0")
    pairs = []
    for o in range(1, reach + 1):
        other = F.col(f"__z.t{o}")
        pairs.append(F.struct(first.alias("centre"), other.alias("context"), F.lit(o).alias("offset"), F.col("pos").alias("at")))
        pairs.append(F.struct(other.alias("centre"), first.alias("context"), F.lit(-o).alias("offset"), (F.col("pos") + o).alias("at")))
    out = zipped.where("__z.t0 is not null").select(*keep, F.explode(F.array(*pairs)).alias("p")).select(*keep, "p.*").where("centre is not null and context is not null")
    if own is not None:
        out = out.withColumnRenamed("at", "pos").where(F.abs("offset") <= own)
    return out.select("centre", "context", "offset")


def window_pair_counts(lists: DataFrame, reach: int) -> DataFrame:
    """(centre, context, cnt): a pair is met both ways equally often, so it is counted once, by its words in order, with a
    single shuffle, and then told both ways."""
    names = [f"t{i}" for i in range(reach + 1)]
    z = lists.select(F.explode(F.arrays_zip(*[c.alias(n) for n, c in zip(names, _shifted(reach + 1))])).alias("z"))
    after = F.array(*[F.col(f"z.t{o}") for o in range(1, reach + 1)])
    one = z.where("z.t0 is not null").select(F.col("z.t0").alias("t"), F.explode(F.array_compact(after)).alias("o"))
    counted = one.groupBy(F.least("t", "o").alias("a"), F.greatest("t", "o").alias("b")).agg(F.count("*").alias("n"))
    way = lambda x, y, n: F.struct(F.col(x).alias("centre"), F.col(y).alias("context"), n.alias("cnt"))
    both = F.when(F.col("a") == F.col("b"), F.array(way("a", "b", 2 * F.col("n")))).otherwise(F.array(way("a", "b", F.col("n")), way("b", "a", F.col("n"))))
    return counted.select(F.explode(both).alias("p")).select("p.*")


def neighbours(lists: DataFrame, keys: tuple[str, ...], back: int = 2) -> DataFrame:
    """(keys, pos, tok, prev1..): each token with those before it in its own text."""
    none = F.lit(None).cast("string")
    before = [F.concat(F.array(*[none] * k), F.col("toks")).alias(f"prev{k}") for k in range(1, back + 1)]
    z = lists.select(*keys, F.posexplode(F.arrays_zip(F.col("toks").alias("tok"), *before)).alias("pos", "z"))
    return z.where("z.tok is not null").select(*keys, "pos", "z.*")


def from_ends(lists: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, pos, tok, from_start, to_end): each token's distance to both ends of its list (a text or a sentence)."""
    z = lists.select(*keys, F.size("toks").alias("__n"), F.posexplode("toks").alias("pos", "tok"))
    return z.select(*keys, "pos", "tok", F.col("pos").cast("long").alias("from_start"), (F.col("__n") - F.col("pos") - 1).cast("long").alias("to_end"))
