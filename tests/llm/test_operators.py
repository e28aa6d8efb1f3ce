"""Each operator against a plain version of itself, over awkward rows."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import classifier, decontamination, licenses, mixing, pfor, pii, quality_rules, queries, sharding, simhash, token_counts, token_files
from tallyforge.llm.components import components
from tests.llm import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["plain", "clashing"])
def docs(spark, request):
    return (helpers.docs(spark) if request.param == "plain" else helpers.clashing(spark)).persist()


def key(x):
    return tuple((v is not None, v) for v in x)


# 1 -----------------------------------------------------------------------------------------------------------------


def test_classifier_scores_every_row(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(30)] + [(None, 1), (1, None), (2, 0)], "doc_id long, quality int")
    out = classifier.score_quality(docs, labels).collect()
    assert len(out) == len(helpers.rows())
    assert all(0 <= r["score"] <= 1 for r in out)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def plain_indicators(text):
    """Buckets of a text's features, one feature at a time."""
    data, out = (text or "").encode("utf-8", "surrogatepass"), set()
    bucket = lambda h: (h % 2**32 * 0x9E3779B1) % 2**32 >> 16
    for n in range(1, 5):
        for i in range(len(data) - n + 1):
            h = 0
            for x in data[i : i + n]:
                h = h * 257 + x + 1
            out.add(bucket(h + n * 0x51ED27))
    kind = lambda x: 32 if x in b" \t\n\x0b\x0c\r" else 97 if 97 <= x <= 122 or x > 127 else 65 if 65 <= x <= 90 else 48 if 48 <= x <= 57 else x
    runs = [k for k, _ in itertools.groupby(map(kind, data))]
    for a, b, c, d in zip(runs, runs[1:], runs[2:], runs[3:]):
        out.add(bucket((((a * 263 + b) * 263 + c) * 263 + d) ^ 0xA5A5A5))
    words = data.split()
    same = [a == b for a, b in zip(words, words[1:])]
    for a, b, c in zip(same, same[1:], same[2:]):
        out.add(bucket(a * 4 + b * 2 + c + 0x5A17))
    return sorted(out)


def test_indicators_of_whole_texts_at_any_cut():
    r = random.Random(2)
    texts = [helpers.prose(1), "", None, "a", "ab ab ab ab ab", "a " * 60, " x", "é😀 É", "  .. AA 11\n\n" * 5]
    texts += ["".join(r.choice(("a", "bb ", "B", " ", "7", ".", "\n", "é", "same same ", "x" * 30)) for _ in range(r.randint(1, 120))) for _ in range(60)]
    for t in texts:
        want = plain_indicators(t)
        for step in (1, 2, 3, 5, 8, 64, 1 << 20):
            assert classifier.indicators(t, step).tolist() == want, (t, step)


def test_indicators_of_a_text_of_several_parts():
    t = "".join(f"{w * 300} {w}. " for w in helpers.prose(4, 900).split()) + "9" * (1 << 20) + " Ab" * 7
    assert len(t.encode()) > 2 << 20
    assert classifier.indicators(t).tolist() == classifier.indicators(t, 1 << 30).tolist()


def test_scores_against_plain_arithmetic(spark):
    """Rows, model and scores by plain loops: log-count ratios, unit rows, margins, the curve."""
    rows = [(i, helpers.prose(i, 60) if i % 2 else helpers.prose(i, 60).replace(" ", " $ 9 "), "en", "s", 1) for i in range(60)] + [(60, None, "en", "s", 1), (61, "", "en", "s", 1)]
    labels = [(i, i % 2, 0) for i in range(60)]
    inside = [i for i in range(60) if zlib.crc32(str(i).encode()) % 5]
    feats, y = [plain_indicators(rows[i][1]) for i in inside], np.array([i % 2 for i in inside])
    counts = np.ones((2, classifier.BUCKETS))
    for f, label in zip(feats, y):
        for b in f:
            counts[label, b] += 1
    ratio = np.array([[math.log(x) for x in c / c.sum()] for c in counts])
    ratio = ratio[1] - ratio[0]
    model = classifier.fit([np.array(f) for f in feats], y)
    assert np.allclose(model["ratio"], ratio, atol=1e-6)
    got = {r["doc_id"]: r["score"] for r in classifier.score_quality(spark.createDataFrame(rows, helpers.SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for i, text, *_ in rows:
        own = plain_indicators(text)
        length = math.sqrt(sum(float(model["ratio"][b]) ** 2 for b in own)) or 1.0
        z = model["a"] * (sum(float(model["w"][b]) * float(model["ratio"][b]) / length for b in own) + model["bias"]) + model["b"]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-5)
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(60))


def test_classifier_separates():
    good = [helpers.prose(i) for i in range(60)]
    bad = [" ".join(w + "%%%" for w in helpers.prose(i).split()) for i in range(100, 130)]
    rows = [classifier.indicators(t) for t in good + bad]
    y = np.array([1] * 60 + [0] * 30)
    odd = np.arange(90) % 2 == 1
    m = classifier.fit([rows[i] for i in np.flatnonzero(odd)], y[odd])
    p = np.array([classifier.probability(rows[i], m) for i in np.flatnonzero(~odd)])
    assert ((p >= 0.5) == y[~odd]).mean() > 0.95


def test_classifier_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.score_quality(helpers.docs(spark), none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert {r["score"] for r in classifier.score_quality(helpers.docs(spark), one).collect()} == {1.0}
    assert classifier.score_quality(helpers.empty(spark), none).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(40, 6, replace=False)) for _ in range(30)]
    y = rng.integers(0, 2, 30)
    ratio = rng.normal(size=classifier.BUCKETS)
    w, b = classifier.dual_coordinate_descent(rows, y, ratio, c=0.5, passes=400)
    sign, share = np.where(y > 0, 1, -1), np.array([(y <= 0).mean(), (y > 0).mean()])
    c = 0.5 / (2 * share[y])

    def objective(w, b):
        m = np.array([w[r] @ classifier.scaled(r, ratio) + b for r in rows])
        return 0.5 * (w @ w + b * b) + (c * np.maximum(0, 1 - sign * m)).sum()

    best = objective(w, b)
    for _ in range(200):
        step = np.zeros_like(w)
        step[:40] = rng.normal(size=40) * 0.02
        assert objective(w + step, b + rng.normal() * 0.02) >= best - 1e-3


# 2 -----------------------------------------------------------------------------------------------------------------


def test_shards(spark, docs):
    out = sharding.shard_by_bytes(docs, 7, partitions=5).collect()
    want = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in helpers.rows())
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    ordered = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    ids = [(r["doc_id"] is not None, r["doc_id"]) for r in ordered]
    assert ids == sorted(ids)
    total, before = sum(r["size"] for r in out), 0
    for r in ordered:
        assert r["shard"] == min(6, (2 * before + r["size"]) * 7 // (2 * total))
        before += r["size"]
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert sharding.shard_by_bytes(helpers.empty(spark), 7).count() == 0


# 3 -----------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, radius=3):
    values = list(values)
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(spark, docs):
    rows = helpers.rows()
    fps = [plain_fingerprint(r[1]) for r in rows]
    groups = plain_components(fps)
    least = {g: min((r[0] for r, h in zip(rows, groups) if h == g and r[0] is not None), default=None) for g in groups}
    want = collections.Counter((r[0], f"{f:016x}", least[g]) for r, f, g in zip(rows, fps, groups))
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = [r["doc_id"] for r in kept.collect()]
    assert len(got) == len(set(groups))
    assert collections.Counter(x for x in got if x is not None) == collections.Counter(x for x in least.values() if x is not None)
    assert simhash.near_duplicates(helpers.empty(spark)).count() == 0


def test_links_of_a_dense_cluster(spark):
    r = random.Random(5)
    centre, values = r.getrandbits(64), set()
    while len(values) < 900:
        x = centre
        for _ in range(r.randint(0, 6)):
            x ^= 1 << r.randrange(64)
        values.add(x)
    values |= {r.getrandbits(64) for _ in range(200)}
    values = list(values)
    df = spark.createDataFrame([(simhash._signed(x),) for x in values], "fp long")
    got = {r["node"]: r["root"] for r in components(simhash.links(df, most=100)).collect()}
    mine = collections.defaultdict(set)
    for x in values:
        mine[got.get(simhash._signed(x), simhash._signed(x))].add(x)
    theirs = collections.defaultdict(set)
    for x, g in zip(values, plain_components(values)):
        theirs[g].add(x)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


@pytest.mark.parametrize("blocks", [4, 5, 6, 7])
def test_any_number_of_blocks_loses_no_link(spark, blocks):
    r = random.Random(blocks)
    values = [r.getrandbits(64) for _ in range(60)] + [0, 1, (1 << 64) - 1]
    for base in values[:40]:
        for bits in (1, 2, 3, 3, 3, 4):
            values.append(base ^ sum(1 << i for i in r.sample(range(64), bits)))
    values = sorted(set(values))
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    edges = [(x["u"] % (1 << 64), x["v"] % (1 << 64)) for x in simhash.links(frame, blocks=blocks).collect()]
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[find(u)] = find(v)
    want = plain_components(values)
    got = [find(v) for v in values]
    assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_keys_of_buckets_differ_by_table(spark):
    for blocks in (5, 6, 7):
        row = spark.createDataFrame([(0,)], "fp long").select(*simhash.tables(blocks)).first()
        assert len(set(row)) == len(row) == math.comb(blocks, 3) and max(row) < 1 << 62


def test_hot_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 0.0)
    rows = [(i, "one text in very many copies" if i % 3 else helpers.prose(i), "en", "s", 1) for i in range(2400)]
    frame = spark.createDataFrame(rows, helpers.SCHEMA).repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert len(got) == 2400 and all(got[i] == (1 if i % 3 else i) for i in got)


def test_one_of_hot_repeated_rows_stays(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c d", "x")] * 40 + [(None, None, "y")] * 30 + [(2, "a b c d", "z"), (3, "quite other words here", "w")], "doc_id long, text string, n string")
    want = [(1, "x"), (3, "w"), (None, "y")]
    for few in (simhash.FEW, 5.0):
        monkeypatch.setattr(simhash, "FEW", few)
        assert sorted(((r["doc_id"], r["n"]) for r in simhash.keep_one(df).collect()), key=str) == sorted(want, key=str)


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    p = simhash.pivot_fingerprints()
    assert np.abs(simhash.pivot_table(a, p) - simhash.pivot_table(b, p)).max() <= 3


def test_components_of_a_path(spark):
    n = 300
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "u long, v long")
    assert {r["root"] for r in components(e).collect()} == {0}


def test_components_with_hubs(spark, monkeypatch):
    """Stars, joined hubs and small groups, with hubs of 5 edges or more looked up, against union by hand."""
    from tallyforge.llm import components as module

    monkeypatch.setattr(module, "HUB", 0.0)
    monkeypatch.setattr(module, "FEW", 4)
    r = random.Random(3)
    edges = [(100, i) for i in range(101, 160)] + [(50, i) for i in range(155, 200)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)] + [(-7, 900), (900, 901)]
    root = {x: x for e in edges for x in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = top(u), top(v)
        root[max(a, b)] = min(a, b)
    touched = {x for u, v in edges if u != v for x in (u, v)}
    got = components(spark.createDataFrame(edges * 2, "u long, v long")).collect()
    assert {(x["node"], x["root"]) for x in got} == {(x, top(x)) for x in touched} and len(got) == len(touched)


# 4 -----------------------------------------------------------------------------------------------------------------


def plain_counts(t):
    t = t or ""
    w = WORD.findall(t)
    places = collections.defaultdict(list)
    for i in range(len(w) - 2):
        places[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts(spark, docs):
    out = quality_rules.judge(docs).collect()
    want = collections.Counter((r[0], *plain_counts(r[1])) for r in helpers.rows())
    assert collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in out) == want
    for r in out:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert not next(r for r in out if r["doc_id"] == 40)["kept"]
    assert sum(r["kept"] for r in out) >= 30
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in out if r["kept"])
    assert quality_rules.judge(helpers.empty(spark)).count() == 0
    assert quality_rules.keep(helpers.empty(spark)).count() == 0


def test_js_distance(spark):
    r = random.Random(2)
    pairs = [([float(r.randint(0, 5)) for _ in range(6)], [float(r.randint(0, 5)) for _ in range(6)]) for _ in range(30)] + [([0.0] * 6, [1.0] * 6)]
    for p, q, got in spark.createDataFrame(pairs, "p array<double>, q array<double>").select("p", "q", quality_rules.js_distance(F.col("p"), F.col("q"))).collect():
        if not sum(p) or not sum(q):
            assert got is None
            continue
        a, b = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (a + b) / 2
        kl = lambda x: float(sum(x[i] * math.log2(x[i] / m[i]) for i in range(6) if x[i] > 0))
        assert got == pytest.approx(math.sqrt(max(0.0, (kl(a) + kl(b)) / 2)), abs=1e-7)


# 5 -----------------------------------------------------------------------------------------------------------------

PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 50257, 2**32 - 1])
def test_blocks_round_trip(n, top):
    x = np.random.default_rng(n).integers(0, top, n, dtype=np.uint32)
    x[::17] = top - 1
    starts, data = pfor.encode_blocks(x)
    assert np.array_equal(pfor.decode_blocks(starts, data, n), x)
    assert pfor.read_page(pfor.write_page([1, None], [n, 0], x))[0] == [1, None]


def test_encoder_gives_the_librarys_ids():
    t, e = token_counts.tokenizer(PATH), token_files.Encoder(PATH)
    r = random.Random(3)
    texts = ["a  b", "a\n\nb", " x", "x ", "", None, "hello world\nfoo. bar", "<|endoftext|> a", "don't we'll 12"]
    for letters in (" \n\tab'.é1\xa0　!\r\x85ß😀s", "thé.,'s !?0_ \n-"):
        texts += ["".join(r.choice(letters) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    flat, n = e.many(pa.array(texts, pa.string()))
    at = 0
    for text, k in zip(texts, n):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert flat[at : at + k].tolist() == want == e.ids(text or "").tolist(), repr(text)
        at += k
    assert at == len(flat)


def test_token_files(spark, docs):
    t = token_counts.tokenizer(PATH)
    out = token_files.token_files(docs, PATH).orderBy("start").collect()
    ids = [(r["doc_id"] is not None, r["doc_id"]) for r in out]
    assert ids == sorted(ids)
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    want = collections.Counter()
    for r in helpers.rows():
        x = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want[r[0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == want
    assert token_files.token_files(helpers.empty(spark), PATH).count() == 0


# 6 -----------------------------------------------------------------------------------------------------------------


def test_token_counts(spark, docs):
    path = queries.tokenizer_path("word_bpe_49k.json")
    t = token_counts.tokenizer(path)
    want = collections.Counter((r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in helpers.rows())
    for huge in (token_counts.HUGE, 2000):
        out = token_counts.token_counts(docs, path, huge=huge, chunk=700, overlap=20).collect()
        assert collections.Counter(tuple(r) for r in out) == want
    assert token_counts.token_counts(helpers.empty(spark), path).count() == 0


def test_resynchronisation():
    r = random.Random(4)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        t = token_counts.tokenizer(queries.tokenizer_path(name))
        for text in (helpers.prose(1, 4000), "x" * 5000, "a\n" * 3000, "".join(r.choice("ab é\n1.'’") for _ in range(6000)), "é" * 3000 + " word word", "<|endoftext|>" * 400 + " and so on " * 300):
            for chunk, overlap in ((500, 10), (900, 200)):
                assert token_counts.count_huge(t, text, chunk, overlap) == len(t.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_long_texts_at_shipped_settings(spark, name):
    r = random.Random(9)
    t = token_counts.tokenizer(queries.tokenizer_path(name))
    mixed = "".join(r.choice(("word ", "né ", "12.5 ", "don't ", "\n\n", "x" * 40, " 😀", "İ", "ﬁ ", "a\u0301 ", "<|endoftext|> ")) for _ in range(90_000))
    texts = [helpers.prose(1, 9_000), helpers.prose(2, 60_000), mixed, "y" * 70_000 + " " + helpers.prose(3, 9_000), "\n" * 50_000]
    assert all(len(x) > token_counts.HUGE for x in texts)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(rows, queries.tokenizer_path(name)).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)}


# 7 -----------------------------------------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans():
    r = random.Random(6)
    for letters in ("0123456789.@a-+ ()", "01.@ab", "@a.b1", " 1234567890-+("):
        for _ in range(4000):
            t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert pii.base_spans(t) == plain_spans(t), t


@pytest.fixture(scope="module")
def tagger():
    return pii.default_model()


def test_tagger_on_held_out_spans(tagger):
    hit, want, false = collections.Counter(), collections.Counter(), 0
    labelled = pii.labelled_texts(500, 999)
    alone = pii.tagged_spans(tagger, [t for t, _ in labelled])
    for (text, spans), found, (_, got) in zip(labelled, alone, pii.all_spans(tagger, [t for t, _ in labelled])):
        want.update(x[0] for x in spans)
        hit.update(x[0] for x in spans if x in found)
        false += len(set(got) - set(spans))
    assert set(want) == set(pii.TAGGED) and all(hit[k] >= 0.9 * want[k] for k in want), (hit, want)
    assert false <= 0.02 * sum(want.values())


def test_secrets_are_added_and_base_columns_stay(spark, tagger):
    text = 'call a.b@c.example.org now token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" and go'
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger).first()
    assert r["spans"] == f"email:5:22,secret:{text.index('f3')}:{text.index('f3') + 40}" and r["n_secret"] == 1
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 0, 0, 0)


def test_decoding_against_all_tag_sequences():
    from tallyforge.llm.lstm_crf import Tagger

    m, rng = Tagger(3, hidden=4, seed=2), np.random.default_rng(1)
    m.p["trans"] = rng.standard_normal((3, 3)).astype(np.float32)
    m.p["out"] *= 20
    for _ in range(20):
        x = rng.integers(1, 90, (6, 2))
        e, got = m.emissions(x), m.decode(x)
        for b in range(2):
            score = lambda y: sum(float(e[i, b, y[i]]) for i in range(6)) + sum(float(m.p["trans"][p, q]) for p, q in zip(y, y[1:]))
            best = max(itertools.product(range(3), repeat=6), key=score)
            assert score(got[:, b].tolist()) == pytest.approx(score(best), abs=1e-4)


class RunTagger:
    """Tags every run of letters and digits that a window shows as a secret, however the window cuts it."""

    def decode(self, x):
        out = np.zeros(x.shape, np.int8)
        for j in range(x.shape[1]):
            inside = False
            for i, c in enumerate(x[:, j].tolist()):
                one = chr(c + 31).isalnum() if 0 < c < 96 else False
                out[i, j] = (10 if inside else 9) if one else 0
                inside = one
        return out


def test_windows_are_reconciled_over_the_whole_text():
    r = random.Random(8)
    for _ in range(25):
        words = ["".join(r.choice("0123456789abcdefghij") for _ in range(r.choice((3, 25, 47, 48, 49, 95, 96, 97, 200, 511, 512, 513, 1500, 5000)))) for _ in range(12)]
        text = "".join(w + r.choice((" ", "\n", '"', " . " * 20)) for w in words)
        want = sorted(("secret", m.start(), m.end()) for m in re.finditer("[0-9a-z]+", text) if pii.plausible("secret", m.group()))
        assert all(512 >= e - s >= 20 for _, s, e in want)
        assert sorted(pii.tagged_spans(RunTagger(), [text])[0]) == want


def test_skipped_windows_change_nothing(tagger):
    texts = [t for t, _ in pii.labelled_texts(60, 5)] + [helpers.prose(9, 400), "", "7" * 300, "call (212) 555-0199 " + "word " * 60 + "x@y.example"]
    assert pii.all_spans(tagger, texts) == pii.all_spans(tagger, texts, all_windows=True)


def test_tagger_gradients():
    from tallyforge.llm.lstm_crf import Tagger

    m = Tagger(5, hidden=3, seed=1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(1, 90, (6, 4)), rng.integers(0, 5, (6, 4))
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    _, g = m.gradients(x, y)
    for k, v in m.p.items():
        at = tuple(rng.integers(0, s) for s in v.shape) if k[0] != "x" else (x[0, 0], 2)
        eps, old = 1e-4, v[at]
        v[at] = old + eps
        up, _ = m.gradients(x, y)
        v[at] = old - eps
        down, _ = m.gradients(x, y)
        v[at] = old
        assert g[k][at] == pytest.approx((up - down) / (2 * eps), abs=2e-3)


def test_personal_data(spark, docs, tagger):
    import hashlib

    out = pii.find_personal_data(docs, tagger).collect()
    assert len(out) == len(helpers.rows())
    text = "mail a.b@c.example.org or +1 (614) 555-8001, host 10.0.0.1, card 4111 1111 1111 1111, call (212) 555-0199"
    r = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger).first()
    assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1)
    assert r["base_sha256"] == hashlib.sha256(pii.joined(plain_spans(text)).encode()).hexdigest()
    assert set(pii.joined(plain_spans(text)).split(",")) <= set(r["spans"].split(","))
    assert pii.find_personal_data(helpers.empty(spark), tagger).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------------


def test_search_finds_all_above_the_threshold():
    r = random.Random(7)
    items = [(i, [r.choice(helpers.PROSE) + r.choice(helpers.PROSE) for _ in range(r.randint(3, 40))]) for i in range(60)]
    df = collections.Counter(t for _, w in items for t in set(w))
    index = decontamination.Index(items, df, 60, sum(len(w) for _, w in items) / 60)
    texts = [[r.choice(helpers.PROSE) + r.choice(helpers.PROSE) for _ in range(r.randint(0, 300))] for _ in range(20)] + [items[5][1], []]
    for th in (0.45, 0.2, 0.05):
        want = set()
        for n, words in enumerate(texts):
            for s, e in decontamination.passages(len(words)):
                score = np.zeros(60)
                for t in {index.term_ids[x] for x in words[s:e] if x in index.term_ids}:
                    lo = index.ends[t - 1] if t else 0
                    score[index.docs[lo : index.ends[t]]] += index.weights[lo : index.ends[t]]
                want |= {(n, s, e, int(i)) for i in np.flatnonzero(score >= th)}
        assert {x[:4] for x in decontamination.candidates(index, texts, th)} == want


def test_decontamination(spark, docs):
    item = helpers.prose(500, 40)
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, ""), (None, "x"), (5, "zz top"), (6, helpers.prose(501, 50))], "item_id long, text string")
    extra = spark.createDataFrame([(900, helpers.prose(70) + "\n" + item.upper() + "\n" + helpers.prose(71), "en", "s", 1), (901, " ".join(f"{w}***" for w in (helpers.prose(72, 90) + " " + item).split()), "en", "s", 1), (902, item[: len(item) // 2], "en", "s", 1)], helpers.SCHEMA)
    all_docs = docs.select(*helpers.docs(spark).columns).unionByName(extra)
    found = decontamination.contaminated(all_docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(900, 1), (900, 2), (901, 1), (901, 2)}
    clean = decontamination.drop_contaminated(all_docs, bench)
    assert clean.columns == all_docs.columns and clean.count() == all_docs.count() - 2
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contaminated(docs, none).count() == 0
    assert decontamination.drop_contaminated(docs, none).count() == docs.count()
    assert decontamination.contaminated(helpers.empty(spark), bench).count() == 0


@pytest.mark.parametrize("n", [200, 400, 2000])
def test_long_items_are_found_at_any_place(spark, n):
    r = random.Random(n)
    long = lambda k: " ".join(r.choice(helpers.PROSE) + r.choice(helpers.PROSE) + r.choice(helpers.PROSE) for _ in range(k))
    items = [(i, long(n)) for i in range(4)] + [(9, long(30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(10 * i + j, long(before) + " " + t + " " + long(90), "en", "s", 1) for i, t in items for j, before in enumerate((0, 17, 43, n // 2 + 7))] + [(999, long(3 * n), "en", "s", 1)]
    found = decontamination.contaminated(spark.createDataFrame(docs, helpers.SCHEMA), bench).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == {(10 * i + j, i) for i, _ in items for j in range(4)}
    assert all(x["score"] <= 1 + 1e-9 and x["question_cover"] == x["answer_cover"] == 1 for x in found)


def test_items_with_one_edited_word(spark):
    r = random.Random(3)
    words = lambda k: [r.choice(helpers.PROSE) + r.choice(helpers.PROSE) + r.choice(helpers.PROSE) for _ in range(k)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = [words(n) for n in (15, 22, 38, 59, 130)]
    docs, want = [], set()
    for n, item in enumerate(items):
        cut = len(item) - max(len(item) // 3, 5)
        for at in range(len(item)):
            edited = [*item[:at], "changed", *item[at + 1 :]]
            docs.append((1000 * n + at, " ".join([*words(31), *edited, *words(40)]), "en", "s", 1))
            parts = [slice(0, None)], [slice(0, cut), slice(cut, None)]  # all of it, or the question and the answer
            if any(all(len(grams(item[p]) & grams(edited[p])) >= 0.8 * len(grams(item[p])) for p in way) for way in parts):
                want.add((1000 * n + at, n))
        docs.append((1000 * n + 900, " ".join([*item[:cut], "answer", *item[cut:]]), "en", "s", 1))  # words between the parts
        docs.append((1000 * n + 901, " ".join([*item[:cut], *words(60)]), "en", "s", 1))  # the question only
        want.add((1000 * n + 900, n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(items)], "item_id long, text string")
    frame = spark.createDataFrame(docs, helpers.SCHEMA)
    assert {(x["doc_id"], x["item_id"]) for x in decontamination.contaminated(frame, bench).collect()} == want
    assert decontamination.drop_contaminated(frame, bench).count() == len(docs) - len({d for d, _ in want})


def test_items_in_chunks(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, helpers.prose(i, 60)) for i in range(12)], "item_id long, text string")
    whole = {tuple(r) for r in decontamination.contaminated(docs, bench).select("doc_id", "item_id").collect()}
    monkeypatch.setattr(decontamination, "ITEMS", 5)
    assert {tuple(r) for r in decontamination.contaminated(docs, bench).select("doc_id", "item_id").collect()} == whole
    rounds = decontamination.rounds
    monkeypatch.setattr(decontamination, "rounds", lambda indexes: rounds(indexes, 1))  # a pass over the texts for each index
    assert {tuple(r) for r in decontamination.contaminated(docs, bench).select("doc_id", "item_id").collect()} == whole
    hit = {k for k, _ in whole}
    kept = collections.Counter(r["doc_id"] for r in decontamination.drop_contaminated(docs, bench).collect())
    assert kept == collections.Counter(r[0] for r in helpers.rows() if r[0] not in hit)


def test_copies_of_items_of_every_length(spark):
    """Word for word copies of items of 1 to 2,000 words, each inside another text: every one is found."""
    r = random.Random(31)
    syllables = [a + b for a in helpers.PROSE for b in helpers.PROSE]
    long = lambda k: " ".join(r.choice(syllables) + r.choice(helpers.PROSE) for _ in range(k))
    lengths = [n for n in (1, 2, 3, 4, 5, 6, 8, 12, 20, 47, 48, 49, 64, 65, 96, 128, 129, 200, 220, 250, 300, 400, 600, 1000, 2000) for _ in range(4)]
    items = [(i, f"item{i} {long(n - 1)}".strip()) for i, n in enumerate(lengths)]
    docs = [(i, f"{long(r.randrange(150))} {t} {long(r.randrange(150))}", "en", "s", 1) for i, t in items] + [(5000, long(4000), "en", "s", 1)]
    found = decontamination.contaminated(spark.createDataFrame(docs, helpers.SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == {(i, i) for i, _ in items}


# 9 -----------------------------------------------------------------------------------------------------------------


def best_dice(words, target):
    """Best Dice coefficient of any window, by trying all."""
    best = 0.0
    grams = list(zip(words, words[1:]))
    for i in range(len(grams)):
        for j in range(i + 1, len(grams) + 1):
            best = max(best, licenses.dice(collections.Counter(grams[i:j]), target))
    return best


def test_licence_windows_against_all_windows():
    r = random.Random(8)
    s = licenses.Scanner({"A": ["this work is licensed under the sample public license version three"], "B": ["released under the small license"]})
    vocabulary = "this work is licensed under the sample public license version three released small and or".split()
    for _ in range(150):
        words = [r.choice(vocabulary) for _ in range(10)]
        if r.random() < 0.5:
            words[2:2] = "this work is licensed under the sample license version three".split()
        found = {x[0]: x[2] for x in s.scan(" ".join(words))}
        for name, _, target in s.templates:
            best = best_dice(words, target)
            if name in found:
                assert found[name] <= best + 1e-9
            if best >= s.threshold and name == "A":
                assert "A" in found and found["A"] == pytest.approx(best)


NOTICES = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]


def test_every_template_and_its_near_variants_get_their_own_name():
    s, r = licenses.Scanner(), random.Random(5)
    for name, text in NOTICES:
        words = text.replace("License", "Licence").split() if len(text) < 80 else text.split()
        for _ in range(len(words) // 40):  # one word in forty changed, but none that tells licences apart
            i = r.randrange(1, len(words) - 1)
            near = licenses.normalised(" ".join(words[i - 1 : i + 2]))
            if not licenses.telling(near, 0, len(near)):
                words[i] = "altered"
        lined = "\n * ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9))
        for t in (text, text.upper(), f"{helpers.prose(1)}\n{text}\n{helpers.prose(2)}", f"// {lined}\n"):
            assert [x[0] for x in s.scan(t)] == [name], t
    every = "\n\nsome words between them\n\n".join(t for _, t in NOTICES)
    assert [x[0] for x in s.scan(every)] == [n for n, _ in NOTICES]


def test_words_that_tell_licences_apart():
    s = licenses.Scanner()
    names = lambda t: [x[0] for x in s.scan(t)]
    assert names("the GNU Affero General Public License, version 3") == ["AGPL-3.0"]
    assert names("This work is licensed under the GNU General Public License, version 9.") == ["GPL"]  # no version that is known
    assert names("Licensed under CC BY-NC-SA 4.0.") == ["CC-BY-NC-SA-4.0"] and names("Licensed under CC BY 2.5.") == []
    assert names("SPDX-License-Identifier: Foo") == names("Released under the") == names("the Artistic Licence 1.0") == []


def test_finds_against_the_best_window_of_every_template():
    s, r = licenses.Scanner(), random.Random(12)
    short = [(n, t) for n, t in NOTICES if len(t) < 130]
    for _ in range(60):
        (_, a), (_, b) = r.choice(short), r.choice(short)
        words = f"{helpers.prose(r.randrange(99), 6)} {a} {b}".split()
        del words[r.randrange(len(words))]
        plain = licenses.normalised(" ".join(words))
        found = s.scan(" ".join(words))
        for name, n, d, first, end in found:  # each find is a window with this Dice, and with these telling words
            target = next(b for own, i, b in s.templates if (own, i) == (name, n))
            assert d == pytest.approx(licenses.dice(collections.Counter(licenses.bigrams(plain[first:end])), target)) and d >= s.threshold
            assert licenses.telling(plain, first, end) == s.telling[[x[:2] for x in s.templates].index((name, n))]
        grams = licenses.bigrams(plain)
        for (name, n, target), own in zip(s.templates, s.telling):  # and no window of any template is passed over
            for i in range(len(grams)):
                for j in range(i + 1, min(len(grams), i + 2 * target.total()) + 1):
                    window = collections.Counter(grams[i:j])
                    beside = licenses.telling(plain, max(i - 1, 0), i) | licenses.telling(plain, j + 1, min(j + 2, len(plain)))
                    clear = not (beside & licenses.MODIFIERS or any(w[0].isdigit() for w in beside))
                    if licenses.dice(window, target) >= s.threshold and clear and licenses.telling(plain, i, j + 1) == own:
                        assert any(x[3] < j + 1 and x[4] > i for x in found), (name, n, plain[i : j + 1])


def test_licence_scan(spark, docs):
    text = "Intro words.\nLicensed under CC BY-NC 4.0.\nMore words here.\nReleased*** under*** the*** MIT*** License.***\nlicensed under nothing"
    extra = spark.createDataFrame([(800, text, "en", "s", 1), (None, "THIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.", None, None, None)], helpers.SCHEMA)
    found = licenses.scan_licences(docs.select(*extra.columns).unionByName(extra)).collect()
    assert {(r["doc_id"], r["license"]) for r in found} == {(800, "CC-BY-NC-4.0"), (800, "MIT"), (None, "GPL-3.0")}
    assert licenses.scan_licences(helpers.empty(spark)).count() == 0


# 10 ----------------------------------------------------------------------------------------------------------------


def plain_targets(sizes, weights=(1, 2, 3), most=3.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: float(weights[i % 3]) for i, s in enumerate(names)}
    total, capped = float(sum(sizes.values())), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] or sizes[s] == 0]
        if not over or len(over) == len(free):
            return {s: share.get(s, most * sizes[s]) for s in names} if not over else {s: most * sizes[s] for s in names}
        capped |= set(over)


def test_targets(spark):
    r = random.Random(9)
    for n in (1, 2, 5, 12):
        sizes = {f"s{i}": r.choice([0, 1, 5, 100, 4000]) for i in range(n)} | {None: 7}
        got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert got[s] == pytest.approx(want[s]), (sizes, got, want)


def test_mix(spark, docs, monkeypatch):
    sizes = collections.Counter()
    for r in helpers.rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    targets = plain_targets(sizes)
    out = mixing.copies(docs).collect()
    assert len(out) == len(helpers.rows())
    for r in out:
        assert r["target"] == pytest.approx(targets[r["source"]])
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (math.floor(rate), math.floor(rate) + 1) and r["copies"] <= 3
    emitted = collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect())
    want = collections.Counter()
    for r in out:
        want[r["doc_id"]] += r["copies"]
    assert emitted == +want
    assert mixing.mix(docs).columns == docs.columns
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # the salted join
    assert collections.Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == emitted
    assert sorted(map(str, mixing.copies(docs).collect())) == sorted(map(str, out))
    assert mixing.copies(helpers.empty(spark)).count() == 0 and mixing.mix(helpers.empty(spark)).count() == 0


def test_mix_comes_near_its_targets(spark):
    r = random.Random(10)
    rows = [(i, "w " * r.randint(1, 30), f"s{i % 4}") for i in range(6000)]
    out = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for x in out.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
        assert x["taken"] == pytest.approx(x["t"], rel=0.08)
