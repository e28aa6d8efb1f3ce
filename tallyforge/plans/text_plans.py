"""Dictionaries, n-grams, features and lexers over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import text as X
from tallyforge.operators.ordering import rank_by_count
from tallyforge.plans.catalog import query
from tallyforge.plans.fixtures import SENTENCES, TOKENS, table, token_lists, tokens

DICT = f"{TOKENS}, dic AS (SELECT tok, count(*) AS cnt FROM tok GROUP BY tok), rnk AS (SELECT tok, cnt, row_number() OVER (ORDER BY cnt DESC, tok) - 1 AS rank FROM dic)"


@query("dict_build", f"WITH {TOKENS} SELECT tok, count(*) AS cnt, row_number() OVER (ORDER BY min((doc_id, pos))) - 1 AS id FROM tok GROUP BY tok")
def dict_build(spark, d):
    return X.first_seen_ids(tokens(spark, d), ("doc_id", "pos"))


@query("dict_trim", f"WITH {DICT} SELECT tok, cnt FROM dic WHERE cnt >= 10")
def dict_trim(spark, d):
    return X.trim(X.dictionary(tokens(spark, d)), 10)


@query(
    "dict_trim_to_size",
    f"WITH {DICT}, k AS (SELECT cnt, sum(count(*)) OVER (ORDER BY cnt DESC) AS kept FROM dic GROUP BY cnt) SELECT tok, cnt FROM dic WHERE cnt >= (SELECT min(cnt) FROM k WHERE kept <= 500)",
)
def dict_trim_to_size(spark, d):
    return X.trim_to_size(X.dictionary(tokens(spark, d)), 500)


@query(
    "dict_union",
    f"WITH {TOKENS}, c AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM conversations) SELECT tok, count(*) AS cnt FROM (SELECT tok FROM tok UNION ALL SELECT tok FROM c) GROUP BY tok",
)
def dict_union(spark, d):
    return X.union(X.dictionary(tokens(spark, d)), X.dictionary(tokens(spark, d, "conversations", ("conv_id", "turn"))))


@query(
    "dict_rollup",
    f"""WITH {TOKENS}, s AS (SELECT source, lang, tok FROM tok JOIN documents USING (doc_id)),
dy AS (SELECT source, lang, tok, count(*) AS cnt FROM s GROUP BY ALL HAVING count(*) >= 3),
mo AS (SELECT lang, tok, sum(cnt) AS cnt FROM dy GROUP BY ALL HAVING sum(cnt) >= 12)
SELECT tok, CAST(sum(cnt) AS BIGINT) AS cnt FROM mo GROUP BY tok""",
)
def dict_rollup(spark, d):
    docs = table(spark, d, "documents").withColumn("day", F.struct("source", "lang"))
    return X.roll_up(X.tokenize(docs, "text", ("day",)), "day", F.col("day.lang"), 3)


@query("rank_desc", f"WITH {DICT} SELECT tok, cnt, rank FROM rnk")
def rank_desc(spark, d):
    return X.ranked(X.dictionary(tokens(spark, d))).select("tok", "cnt", "rank")


@query("top_k_dictionary", f"WITH {DICT} SELECT tok, cnt, rank FROM rnk WHERE rank < 100")
def top_k(spark, d):
    dic = X.dictionary(tokens(spark, d)).orderBy(F.desc("cnt"), "tok").limit(100)
    return X.ranked(dic).select("tok", "cnt", "rank")


@query(
    "dict_map",
    f"WITH {DICT}, c AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM conversations) SELECT c.tok, coalesce(rank, -1) AS id, count(*) AS cnt FROM c LEFT JOIN rnk USING (tok) GROUP BY ALL",
)
def dict_map(spark, d):
    ids = X.ranked(X.dictionary(tokens(spark, d)))
    return X.map_ids(X.dictionary(tokens(spark, d, "conversations", ("conv_id", "turn"))), ids).select("tok", "id", "cnt")


@query(
    "oov_semi",
    f"WITH {DICT}, c AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS tok FROM conversations) SELECT tok, count(*) AS cnt FROM c WHERE tok NOT IN (SELECT tok FROM dic WHERE cnt >= 10) GROUP BY tok",
)
def oov_semi(spark, d):
    known = X.trim(X.dictionary(tokens(spark, d)), 10)
    return X.dictionary(tokens(spark, d, "conversations", ("conv_id", "turn"))).join(known.select("tok"), "tok", "left_anti")


@query(
    "known_bigrams_semi",
    f"""WITH {DICT}, g AS (SELECT lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS w1, tok AS w2 FROM tok)
SELECT w1, w2, count(*) AS cnt FROM g WHERE w1 IN (SELECT tok FROM dic WHERE cnt >= 10) AND w2 IN (SELECT tok FROM dic WHERE cnt >= 10) GROUP BY ALL""",
)
def known_bigrams(spark, d):
    """Bigrams of words that the dictionary knows: both are looked up once a bigram, not once an occurrence."""
    known = X.trim(X.dictionary(tokens(spark, d)), 10).select("tok")
    g = X.ngram_counts(token_lists(spark, d), 2)
    return g.join(known.withColumnRenamed("tok", "w1"), "w1", "left_semi").join(known.withColumnRenamed("tok", "w2"), "w2", "left_semi").select("w1", "w2", "cnt")


@query(
    "ngram_map",
    f"""WITH {TOKENS}, g AS (SELECT doc_id, lag(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS w1, tok AS w2 FROM tok),
b AS (SELECT w1, w2, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY ALL),
r AS (SELECT w1, w2, row_number() OVER (ORDER BY c DESC, w1, w2) - 1 AS gram FROM b WHERE c >= 5)
SELECT doc_id, gram, count(*) AS cnt FROM g JOIN r USING (w1, w2) GROUP BY ALL""",
)
def ngram_map(spark, d):
    t = token_lists(spark, d)
    known = X.ngram_counts(t, 2).where("cnt >= 5")
    ids = rank_by_count(known, "cnt", ("w1", "w2"), "gram").select("w1", "w2", "gram")
    own = X.ngrams(t, 2, ("doc_id",)).groupBy("doc_id", "w1", "w2").agg(F.count("*").alias("cnt"))
    return own.join(ids, ["w1", "w2"]).select("doc_id", "gram", "cnt")


for _n in (1, 2, 3):
    _lags = ", ".join([f"lag(tok, {_n - i}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{i}" for i in range(1, _n)] + [f"tok AS w{_n}"])
    _names = ", ".join(f"w{i}" for i in range(1, _n + 1))

    @query(f"ngram_counts_{_n}", f"WITH {TOKENS}, g AS (SELECT {_lags} FROM tok) SELECT {_names}, count(*) AS cnt FROM g WHERE w1 IS NOT NULL GROUP BY ALL")
    def _ngrams(spark, d, n=_n):
        return X.ngram_counts(token_lists(spark, d), n)


@query("doc_term", f"WITH {DICT} SELECT doc_id, rank AS id, count(*) AS cnt FROM tok JOIN rnk USING (tok) WHERE rnk.cnt >= 10 GROUP BY ALL")
def doc_term(spark, d):
    """Features by the dictionary of words seen ten times or more."""
    t = tokens(spark, d)
    return X.doc_term(t, X.ranked(X.trim(X.dictionary(t), 10)), ("doc_id",))


@query(
    "window_pairs",
    f"WITH {TOKENS} SELECT a.tok AS centre, b.tok AS context, count(*) AS cnt FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos - a.pos BETWEEN -2 AND 2 AND b.pos <> a.pos GROUP BY ALL HAVING count(*) >= 3",
)
def window_pairs(spark, d):
    return X.window_pair_counts(token_lists(spark, d), 2).where("cnt >= 3")


@query(
    "window_pairs_narrowed",
    f"""WITH {SENTENCES} SELECT a.tok AS centre, b.tok AS context, count(*) AS cnt FROM stk a JOIN stk b ON a.doc_id = b.doc_id AND a.sent = b.sent AND b.pos <> a.pos
AND abs(b.pos - a.pos) <= 1 + ((a.doc_id + a.sent * 7 + a.pos) * 1103515245 + 12345) % 2147483648 // 65536 % 3 GROUP BY ALL HAVING count(*) >= 3""",
)
def window_pairs_narrowed(spark, d):
    """Pairs within a sentence; each centre draws its own reach from 1 to 3, by a fixed pseudo-random number."""
    seed = (F.col("doc_id") + F.col("sent") * 7 + F.col("pos")) * F.lit(1103515245) + F.lit(12345)
    reach = F.lit(1) + F.floor(F.pmod(seed, F.lit(2147483648)) / 65536) % 3
    return X.window_pairs(X.sentences(table(spark, d, "documents"), "text", ("doc_id",)), 3, reach).groupBy("centre", "context").agg(F.count("*").alias("cnt")).where("cnt >= 3")


@query("cumsum_by_key", f"WITH {SENTENCES} SELECT doc_id, sent, pos, row_number() OVER w - 1 AS from_start, count(*) OVER (PARTITION BY doc_id, sent) - row_number() OVER w AS to_end FROM stk WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos)")
def cumsum_by_key(spark, d):
    """Each token's distance to the start and to the end of its sentence."""
    return X.from_ends(X.sentences(table(spark, d, "documents"), "text", ("doc_id",)), ("doc_id", "sent")).drop("tok")


@query("neighbours", f"WITH {TOKENS} SELECT doc_id, pos, tok, lag(tok, 1) OVER w AS prev1, lag(tok, 2) OVER w AS prev2 FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos)")
def neighbours(spark, d):
    return X.neighbours(token_lists(spark, d), ("doc_id",))


@query("distinct_rows", f"WITH {TOKENS} SELECT DISTINCT doc_id, tok FROM tok")
def distinct_rows(spark, d):
    return tokens(spark, d).select("doc_id", "tok").distinct()


@query("user_counts", 'SELECT user_id AS "user", count(*) AS cnt FROM events GROUP BY 1')
def user_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("user")).agg(F.count("*").alias("cnt"))


#: Marks of feeling by class, longest first: the class table of the tagging query.
FEELINGS = {"happy": ["!!"], "strong": ["***", "###"], "odd": ["%%%", "$$$", "&&&"]}


@query(
    "emoticon_targets",
    r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '!!|\*\*\*|###|%%%|\$\$\$|&&&')) AS mark FROM documents),
c AS (SELECT doc_id, CASE WHEN mark = '!!' THEN 'happy' WHEN mark IN ('***', '###') THEN 'strong' ELSE 'odd' END AS class FROM m)
SELECT doc_id, class, count(*) AS cnt FROM c GROUP BY ALL""",
)
def emoticon_targets(spark, d):
    pattern = "|".join("".join("\\" + c for c in mark) for marks in FEELINGS.values() for mark in marks)
    classes = spark.createDataFrame([(m, k) for k, ms in FEELINGS.items() for m in ms], "mark string, class string")
    found = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("mark"))
    return found.join(F.broadcast(classes), "mark").groupBy("doc_id", "class").agg(F.count("*").alias("cnt"))


_CLASS = "CASE WHEN contains(w, '%%%') OR contains(w, '$$$') OR contains(w, '&&&') THEN 3 WHEN contains(w, '***') OR contains(w, '###') THEN 2 WHEN contains(w, '!!') THEN 1 ELSE 0 END"


@query(
    "emoticon_ngrams",
    rf"""WITH w AS (SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS pos, unnest(l) AS w FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^ \t\n]+') AS l FROM documents)),
c AS (SELECT doc_id, pos, {_CLASS} AS c FROM w), g AS (SELECT doc_id, greatest(c, lag(c) OVER (PARTITION BY doc_id ORDER BY pos)) AS c, lag(c) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM c) SELECT doc_id, c AS class, count(*) AS cnt FROM g WHERE p IS NOT NULL AND c > 0 GROUP BY ALL""",
)
def emoticon_ngrams(spark, d):
    """Bigrams by class of feeling: one inherits the largest class of its words."""
    level = {m: n + 1 for n, marks in enumerate(FEELINGS.values()) for m in marks}

    def of(w):
        out = F.lit(0)
        for m, n in level.items():  # in rising order, so that the largest class found stays
            out = F.when(F.contains(w, F.lit(m)), n).otherwise(out)
        return out

    g = X.ngrams(X.token_lists(table(spark, d, "documents"), "text", ("doc_id",), "[^ \\t\\n]+"), 2, ("doc_id",))
    return g.select("doc_id", F.greatest(of(F.col("w1")), of(F.col("w2"))).alias("class")).where("class > 0").groupBy("doc_id", "class").agg(F.count("*").alias("cnt"))


#: Alternatives of each lexer, long before short where one is a prefix of another.
LEXERS = {
    "tweet": ("documents", "doc_id", "text", r"https?://[^ \t\n<>]+|&[a-z]+;|</?[a-z][a-z0-9]*>|[@#][a-z0-9_]+|[0-9]+\.[0-9]+|[0-9]+|[a-z]+(?:'[a-z]+)?|:-?[()dp]|[.,!?]+"),
    "wiki": ("pages", "page_id", "html", r"\{\{|\}\}|={2,3}|[\[\]|=]|</?[a-z][a-z0-9]*|[0-9]+\.[0-9]+|[0-9]+|[a-z]+|[.,!?]"),
    "trec": ("documents", "doc_id", "text", r"\.[iw]\b|[0-9]+\.[0-9]+|[0-9]+|[a-z]+|[.,!?]"),
}

for _name, (_table, _key, _column, _pattern) in LEXERS.items():

    @query(
        f"src_lex_{_name}",
        f"""WITH t AS (SELECT {_key}, unnest(regexp_extract_all(lower({_column}), '{_pattern.replace("'", "''")}')) AS tok FROM {_table}) SELECT {_key}, tok, count(*) AS cnt FROM t GROUP BY ALL""",
    )
    def _lex(spark, d, table_=_table, key=_key, column=_column, pattern=_pattern):
        return X.tokenize(table(spark, d, table_), column, (key,), pattern).groupBy(key, "tok").agg(F.count("*").alias("cnt"))
