"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import quality_rules as Q
from tallyforge.llm import queries, token_counts
from tests.llm import helpers
from tests.llm.test_operators import WORD, plain_components, plain_counts, plain_fingerprint, plain_targets


def _distance(p, q):
    if not sum(p) or not sum(q):
        return None
    a, b = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (a + b) / 2
    kl = lambda x: float(sum(x[i] * math.log2(x[i] / m[i]) for i in range(len(x)) if x[i] > 0))
    return math.sqrt(max(0.0, (kl(a) + kl(b)) / 2))


def _classes(t):
    upper = sum(c.isupper() for c in t)
    beyond = sum(ord(c) > 127 and not c.isupper() for c in t)
    counts = [upper, len(re.findall("[0-9]", t)), len(re.findall(r"[#*$%&|<>]", t)), len(re.findall(r"""[.,;:!?'"()/_-]""", t)), beyond]
    word_chars = sum(map(len, WORD.findall(t)))
    return [*counts, len(t) - word_chars, word_chars - sum(counts)]


def _common(t, lang):
    words = WORD.findall(t.lower())
    own = [words.count(w) for w in Q.COMMON_WORDS.get(lang, [])]
    return [*own, max(0, len(words) - sum(own))]


def plain_quality(rows):
    """Rows that the rules keep."""
    data = []
    for r in rows:
        t = r[1] or ""
        n, _, _, _, repeat = plain_counts(t)
        data.append({"row": r, "n": n, "failed": n < 50 or 100 * repeat > 50 * n, "classes": _classes(t), "common": _common(t, r[2])})

    def references(some):
        words = collections.Counter()
        for x in some:
            words[x["row"][2]] += x["n"]
        every = sum(words.values())
        out = {None: (np.sum([x["classes"] for x in some], axis=0) if some else np.zeros(7), None)}
        for lang, n in words.items():
            if lang is not None and n >= every * Q.OWN_SHARE:
                own = [x for x in some if x["row"][2] == lang]
                width = max(len(x["common"]) for x in own)
                out[lang] = (np.sum([x["classes"] for x in own], axis=0), np.sum([x["common"] for x in own if len(x["common"]) == width], axis=0))
        return out

    def measured(x, refs):
        classes, _ = refs.get(x["row"][2], refs[None])
        common = refs[x["row"][2]][1] if x["row"][2] in refs else None
        char = _distance(x["classes"], classes) if x["n"] >= Q.MIN_WORDS else None
        word = _distance(x["common"], common) if x["n"] >= Q.MIN_WORDS and common is not None and len(x["common"]) > 1 else None
        return char or 0.0, word or 0.0

    passed = [x for x in data if not x["failed"]]
    refs = references(passed)
    near = [x for x in passed if measured(x, refs)[0] <= Q.ROUGH_CHAR_DISTANCE and measured(x, refs)[1] <= Q.ROUGH_COMMON_DISTANCE]
    refs = references(near)
    kept = []
    for x in passed:
        c, w = measured(x, refs)
        if x["n"] >= Q.LONG:
            strange = c > Q.MAX_CHAR_DISTANCE or w > Q.MAX_COMMON_DISTANCE
        else:
            strange = c > Q.SHORT_CHAR_DISTANCE or (c > Q.BOTH_CHAR_DISTANCE and w > Q.BOTH_COMMON_DISTANCE)
        if not strange:
            kept.append(x["row"])
    return kept


def plain_dedup(rows):
    groups = plain_components([plain_fingerprint(r[1]) for r in rows])
    out = {}
    for r, g in zip(rows, groups):
        rank = (r[0] is None, r[0] or 0)
        if g not in out or rank < out[g][0]:
            out[g] = (rank, r)
    return [r for _, r in out.values()]


def plain_clean(rows, items):
    term = re.compile(r"[^\W_]+")
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    need = [grams(term.findall(t.lower())) for t in items]
    return [r for r in rows if not any(len(n & grams(term.findall((r[1] or "").lower()))) >= 0.8 * len(n) for n in need)]


def plain_mix(rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets, out = plain_targets(sizes), []
    for r in rows:
        rate = targets[r[3]] / sizes[r[3]] if sizes[r[3]] else 0
        parts = [str(r[0])] if r[0] is not None else []
        parts += [hashlib.md5(r[1].encode()).hexdigest()] if r[1] is not None else []
        key = hashlib.md5(":".join(parts).encode()).hexdigest()
        draw = int(hashlib.md5(f"0:{key}".encode()).hexdigest()[:8], 16) / 2**32
        out += [r] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    return out


def plain_tokens(rows):
    t, at, out = token_counts.tokenizer(queries.tokenizer_path("byte_bpe_50k.json")), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 0]
        out.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.fixture()
def folder(spark, tmp_path):
    item = helpers.prose(500, 40)
    more = [(900, helpers.prose(70) + "\n" + item + "\n" + helpers.prose(71), "en", "s0", 1), (901, helpers.prose(3) + " " + helpers.prose(80), "en", "s1", 1)]
    more += [(902, helpers.prose(90), None, None, None), (None, helpers.prose(91) + " " + item, "en", "s2", 1), (None, helpers.prose(92), "en", None, 1)] * 2
    rows = helpers.rows() + more
    spark.createDataFrame(rows, helpers.SCHEMA).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), rows, [item]


def test_each_stage(spark, folder):
    path, rows, items = folder
    docs, plain = spark.read.parquet(f"{path}/documents.parquet"), rows
    same = lambda df, want: collections.Counter(tuple(r) for r in df.collect()) == collections.Counter(want)
    for (_, stage), f in zip(corpus_pipeline.STAGES, (plain_quality, plain_dedup, lambda r: plain_clean(r, items), plain_mix)):
        docs, plain = stage(spark, docs, path), f(plain)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert same(docs, plain)
    assert 900 not in {r[0] for r in plain} and len(plain) > 20
    want = collections.Counter((k, n, c) for k, _, n, c in plain_tokens(plain))
    out = corpus_pipeline.run(spark, path)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out.collect()) == want
    assert out.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == sum(k[1] * n for k, n in want.items())


def test_further_columns_with_clashing_names(spark, folder, tmp_path_factory):
    path, rows, _ = folder
    names = [c for c in helpers.clashing(spark).columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    other = str(tmp_path_factory.mktemp("clashing"))
    more = spark.read.parquet(f"{path}/documents.parquet").select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    more.write.parquet(f"{other}/documents.parquet")
    bench = spark.read.parquet(f"{path}/benchmark.parquet").select("*", F.lit(1).alias("item"), F.lit("x").alias("words"), F.lit(2).alias("doc_id"))
    bench.write.parquet(f"{other}/benchmark.parquet")
    docs, plain = more, spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = stage(spark, docs, other), stage(spark, plain, path)
        assert docs.columns == more.columns
        same = [collections.Counter(tuple(r) for r in d.select("doc_id", "text", "lang", "source", "n_chars").collect()) for d in (docs, plain)]
        assert same[0] == same[1] and sum(same[0].values()) > 20
        assert docs.select(*[f"`{n}`" for n in names]).distinct().collect() == [tuple(range(len(names)))]
    counted = [collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, d).collect()) for d in (path, other)]
    assert counted[0] == counted[1]


def test_empty_documents(spark, tmp_path):
    helpers.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_names_and_order():
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5 and corpus_pipeline.ORACLE_SQL is None
