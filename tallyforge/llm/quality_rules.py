"""Quality rules by distribution divergence, in column functions only.

Each document's histogram of character classes and of its language's common words is compared with the reference of
its language, by Jensen-Shannon distance (root of the divergence in bits, 0 to 1). References are corpus totals over
every document that passes the base rules, taken twice: the second time without the documents that are far from the
first, so that junk does not bend what it is measured against. A language with at least 1/64 of all words has a reference of its own, so
there are at most 64 of them plus a pooled one for all others: that is the proven bound of what is broadcast. Short
documents are guarded: a histogram of few items strays by chance, so each test needs a minimum length.

All counting happens inside a row, in arrays; only the counts (never a word or a text) are shuffled.

Defined cases: a null or empty text has no words and fails the base rules; a null or unknown language uses the pooled
reference and, having no list of common words, only the character test; repeated rows are judged each; an empty
table gives an empty result; very long texts are handled whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import BLANKS, WORD, cut, let

# The commonest function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "ein", "für"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "las", "un", "por", "con"],
}
#: Characters that the base rules call symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Character classes besides white space and "the rest" (mostly lower-case letters): disjoint.
CLASSES = {"upper": r"\p{Lu}", "digit": r"[0-9]", "symbol": SYMBOLS, "punct": r"""[.,;:!?'"()/_-]""", "beyond_ascii": r"[\x{80}-\x{10FFFF}&&[^\p{Lu}]]"}
#: Base rules: fewest words, largest share (per cent) of repeated ones. Distances are taken from MIN_WORDS words on.
MIN_WORDS, MAX_REPEATED = 50, 50
#: From LONG words on either distance alone rejects.
LONG, MAX_CHAR_DISTANCE, MAX_COMMON_DISTANCE = 100, 0.19, 0.25
#: Below, where a key or a number in the text moves a histogram far, it takes a larger one, or both together.
SHORT_CHAR_DISTANCE, BOTH_CHAR_DISTANCE, BOTH_COMMON_DISTANCE = 0.3, 0.17, 0.2
#: Beyond these distances from a first reference a document is not used for the second one.
ROUGH_CHAR_DISTANCE, ROUGH_COMMON_DISTANCE = 0.2, 0.22
#: A language needs this share of all words for a reference of its own.
OWN_SHARE = 1 / 64


def words_in(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur at least twice among `words`.

    Windows are compared by 64-bit hash. Without an equal pair the answer is 0; else windows are sorted with their
    places, equal neighbours mark places, and the marked windows' union is measured."""

    def windows(ws):
        n = F.size(ws)
        pairs = F.zip_with(F.slice(ws, 1, n - 2), F.slice(ws, 2, n - 2), lambda a, b: F.xxhash64(a, b))
        return F.zip_with(pairs, F.slice(ws, 3, n - 2), lambda p, c: F.xxhash64(p, c))

    def covered(places):
        n = F.size(places)
        gaps = F.zip_with(F.slice(places, 1, n - 1), F.slice(places, 2, n - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(gaps, F.lit(3), lambda acc, g: acc + g)

    def marked(gs):
        placed = F.array_sort(F.transform(gs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def doubles(s):
            n = F.size(s)
            both = F.zip_with(F.slice(s, 1, n - 1), F.slice(s, 2, n - 1), lambda a, b: F.struct((a["g"] == b["g"]).alias("same"), a["i"].alias("x"), b["i"].alias("y")))
            hit = F.transform(F.filter(both, lambda z: z["same"]), lambda z: F.array(z["x"], z["y"]))
            return F.array_sort(F.array_distinct(F.flatten(hit)))

        return let(let(placed, doubles), covered)

    def count(ws):
        return F.when(F.size(ws) < 4, F.lit(0)).otherwise(let(windows(ws), lambda gs: F.when(F.size(F.array_distinct(gs)) == F.size(gs), F.lit(0)).otherwise(marked(gs))))

    return let(words, count)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def _common_list(lang: Column) -> Column:
    out = None
    for code, words in COMMON_WORDS.items():
        a = F.array(*[F.lit(w) for w in words])
        out = F.when(lang == code, a) if out is None else out.when(lang == code, a)
    return out.otherwise(F.array().cast("array<string>"))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", also: list[Column] | None = None) -> DataFrame:
    """Per row: doc_id, lang, the base counts, the two histograms as arrays of counts, and further columns of docs."""
    also = also or []
    names = docs.select(*also).columns if also else []
    t = F.col("t")
    every = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    word_part = let(words_in(t), lambda ws: F.struct(F.size(ws).alias("n"), repeated_words(ws).alias("repeat")))
    found = F.filter(words_in(F.lower(t)), lambda w: w.isin(every))
    common = let(found, lambda ws: F.transform(_common_list(F.col("lang")), lambda c: F.size(F.filter(ws, lambda w: w == c)).cast("long")))
    base = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("t"), *also)
    counted = base.select(
        "doc_id",
        "lang",
        word_part.alias("w"),
        F.length("t").cast("long").alias("chars"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        duplicate_lines(t).cast("long").alias("n_dup_lines"),
        *[F.regexp_count("t", F.lit(p)).cast("long").alias(f"c_{k}") for k, p in CLASSES.items()],
        common.alias("common"),
        *names,
    )
    n_words = F.col("w.n").cast("long")
    rest = F.col("word_chars") - sum((F.col(f"c_{k}") for k in CLASSES), F.lit(0))
    other = F.greatest(n_words - F.aggregate("common", F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return counted.select(
        "doc_id",
        "lang",
        n_words.alias("n_words"),
        "word_chars",
        F.col("c_symbol").alias("n_symbols"),
        "n_dup_lines",
        F.col("w.repeat").cast("long").alias("n_repeat_words"),
        F.array(*[F.col(f"c_{k}") for k in CLASSES], F.col("chars") - F.col("word_chars"), rest).alias("classes"),
        F.concat("common", F.array(other)).alias("common"),
        *names,
    )


def js_distance(p: Column, q: Column) -> Column:
    """Root of the Jensen-Shannon divergence (base 2) of two arrays of counts; null if either has no mass."""

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def term(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    def divergence(pq):
        a = F.transform(p, lambda x: x / pq["p"])
        b = F.transform(q, lambda x: x / pq["q"])
        return F.aggregate(F.zip_with(a, b, lambda x, y: 0.5 * (term(x, y) + term(y, x))), F.lit(0.0), lambda acc, x: acc + x)

    sums = F.struct(total(p).alias("p"), total(q).alias("q"))
    return let(sums, lambda pq: F.when((pq["p"] > 0) & (pq["q"] > 0), F.sqrt(F.greatest(divergence(pq), F.lit(0.0)))))


def references(feats: DataFrame) -> DataFrame:
    """Histograms of the corpus: a row for each language with enough words (ref "=" and its name), and the pooled one
    (ref "*")."""
    n_classes, n_common = len(CLASSES) + 2, max(map(len, COMMON_WORDS.values())) + 1
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"a{i}") for i in range(n_classes)] + [F.sum(F.get("common", F.lit(i))).alias(f"b{i}") for i in range(n_common)]
    by = cut(feats.groupBy("lang").agg(F.sum("n_words").alias("words"), *sums), "quality-languages")
    every = by.agg(F.sum("words")).first()[0] or 0
    own = by.where(F.col("lang").isNotNull() & (F.col("words") >= F.lit(every * OWN_SHARE))).withColumn("ref", F.concat(F.lit("="), "lang"))
    pooled = by.agg(F.lit("*").alias("ref"), *[F.sum(f"a{i}").alias(f"a{i}") for i in range(n_classes)], *[F.lit(None).cast("long").alias(f"b{i}") for i in range(n_common)])
    both = own.drop("lang", "words").unionByName(pooled)
    return both.select(
        "ref",
        F.array(*[F.coalesce(F.col(f"a{i}"), F.lit(0)).cast("double") for i in range(n_classes)]).alias("ref_classes"),
        F.filter(F.array(*[F.col(f"b{i}").cast("double") for i in range(n_common)]), lambda x: x.isNotNull()).alias("ref_common"),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of docs: the base counts, base_failed, both distances (null where a guard holds) and kept."""
    return _judged(docs, key, text, lang, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "common_distance")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows that the rules reject, every column as it was. The rows travel with their counts through
    the one written table, so that nothing is counted twice or joined back."""
    judged = _judged(docs, key, text, lang, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")])
    return judged.where("kept").select("__row.*")


def _judged(docs: DataFrame, key: str, text: str, lang: str, also: list[Column]) -> DataFrame:
    f = features(docs, key, text, lang, also)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    f = cut(f.withColumn("base_failed", failed), "quality-counts")
    passed = f.where(~F.col("base_failed"))
    refs = cut(references(passed), "quality-references")
    char, common = F.coalesce("char_distance", F.lit(0.0)), F.coalesce("common_distance", F.lit(0.0))
    typical = (char <= ROUGH_CHAR_DISTANCE) & (common <= ROUGH_COMMON_DISTANCE)
    refs = cut(references(distances(passed.drop("__row"), refs).where(typical)), "quality-references")
    long = (F.col("n_words") >= LONG) & ((char > MAX_CHAR_DISTANCE) | (common > MAX_COMMON_DISTANCE))
    short = (F.col("n_words") < LONG) & ((char > SHORT_CHAR_DISTANCE) | ((char > BOTH_CHAR_DISTANCE) & (common > BOTH_COMMON_DISTANCE)))
    return distances(f, refs).withColumn("kept", ~F.col("base_failed") & ~(long | short))


def distances(f: DataFrame, refs: DataFrame) -> DataFrame:
    """Adds char_distance and common_distance to counts; null where a length guard holds or there is no list."""
    known = [r["ref"] for r in refs.select("ref").collect()]  # at most 65
    named = F.concat(F.lit("="), "lang")
    joined = f.withColumn("ref", F.when(named.isin(known), named).otherwise(F.lit("*"))).join(F.broadcast(refs), "ref")
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    has_list = (F.size("common") > 1) & (F.size("ref_common") == F.size("common"))
    return joined.select(
        *f.columns,
        F.when(F.col("n_words") >= MIN_WORDS, js_distance(as_double(F.col("classes")), F.col("ref_classes"))).alias("char_distance"),
        F.when((F.col("n_words") >= MIN_WORDS) & has_list, js_distance(as_double(F.col("common")), F.col("ref_common"))).alias("common_distance"),
    )
