"""Benchmark decontamination: BM25 over an inverted index of the test items, searched by block-max WAND.

Every text is cut in overlapping passages, and every passage is a query. A test item's score for a passage is the BM25
sum over their common terms as a share of the item's score for its own text. Items are classed by length, and passages
grow with the class, so that a passage holds nearly all of any copy; what a copy with COVER of the item's shingles may
still lack is bounded for each item, and where that is more than 1 - THRESHOLD, the item's threshold is lower. So one
threshold serves items of any length. Search is safe: it returns every item at or above the threshold. It skips by upper bounds, as WAND does: a
passage whose terms' largest weights don't reach the threshold is dropped; then blocks of items whose block maxima
don't reach it; within the blocks left, cursors over the postings move by pivot. What is retrieved is verified on the
text: the five-word shingles of the words around the passage must cover the item to COVER or more, with words of both
its question (its words but the last third) and its answer (the last third) among them; or they must cover question and
answer each to COVER or more, so that words between the two don't matter. Items with fewer words than a shingle are
compared whole.

The items of a class are indexed in chunks of ITEMS, fewer where they are longer, with document frequencies over all
items. Indexes are sent to the executors in groups of at most BROADCAST bytes (or one index, whose size ITEMS bounds);
the texts are scanned once for each group, so that a benchmark of any size fits. No passage, text or pair is shuffled:
only found (document, item) pairs leave the scan.

Defined cases: very long texts and items of any length are searched whole; null and empty texts hold nothing; a null, empty or wordless item is never found; items with equal texts
are each found; a null document id is carried as null; an empty benchmark finds nothing; repeated rows are each
reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import cut, fresh, small, trimmed

TERM = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
#: Words of a passage and of a step; share of an item's own score from which it is retrieved; share to be covered.
PASSAGE, STEP, THRESHOLD, COVER, SHINGLE = 96, 48, 0.45, 0.8, 5
#: Words of the longest item that is sought in passages of PASSAGE words; both double from class to class.
LONGEST = 64
ITEMS, BLOCK = 1024, 8
#: Bytes of the indexes that are sent to the executors at a time.
BROADCAST = 128 << 20


def terms(text: str | None) -> list[str]:
    return TERM.findall((text or "").lower())


class Index:
    """Postings of a chunk of items, weights as shares of each item's own score, with maxima by block of items.

    The weights of item i are divided by scale[i], which is 1 unless a copy may score less than the threshold."""

    def __init__(self, items: list[tuple[int, list[str]]], df: dict[str, int], n: int, mean: float, passage: int = PASSAGE, threshold: float = THRESHOLD, cover: float = COVER):
        self.passage = passage
        self.scale: list[float] = []
        self.keys = [k for k, _ in items]
        self.words = [w for _, w in items]
        self.term_ids: dict[str, int] = {}
        weights: list[dict[int, float]] = []
        for _, w in items:
            own: dict[int, float] = {}
            for t in set(w):
                tf = w.count(t)
                idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                own[self.term_ids.setdefault(t, len(self.term_ids))] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / mean))
            whole = sum(own.values())
            least = surely_kept(w, {t: own[self.term_ids[t]] / whole for t in set(w)}, passage, cover)
            self.scale.append(max(min(1.0, least / threshold), 1e-6))
            weights.append({t: x / whole / self.scale[-1] for t, x in own.items()})
        by_term: list[list[tuple[int, float]]] = [[] for _ in self.term_ids]
        for i, own in enumerate(weights):
            for t, x in own.items():
                by_term[t].append((i, x))
        self.docs = np.array([i for p in by_term for i, _ in p], np.int64)
        self.weights = np.array([x for p in by_term for _, x in p], np.float64)
        lengths = np.array([len(p) for p in by_term], np.int64)
        self.ends = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(by_term)), lengths)
        self.blocks = max(-(-len(items) // BLOCK), 1)
        #: Largest weight of each term in each block of items; the last row is for words that are not indexed.
        self.block_max = np.zeros((len(by_term) + 1, self.blocks), np.float32)
        np.maximum.at(self.block_max, (owner, self.docs // BLOCK), (self.weights * (1 + 1e-6)).astype(np.float32))
        self.largest = self.block_max.max(axis=1)
        #: The term and block of each posting, rising: where the postings of a term in a block lie is looked up here.
        self.cells = owner * self.blocks + self.docs // BLOCK

    def size(self) -> int:
        """About how many bytes the index has."""
        return self.block_max.nbytes + self.cells.nbytes + self.docs.nbytes + self.weights.nbytes + 100 * (len(self.term_ids) + sum(map(len, self.words)))

    def search(self, ids: np.ndarray, threshold: float, blocks: list[int]) -> list[tuple[int, float]]:
        """Items of the given blocks with a score of at least threshold for a set of terms: block-max WAND."""
        out = []
        for b in blocks:
            cell = ids * self.blocks + b
            begin, end = np.searchsorted(self.cells, cell), np.searchsorted(self.cells, cell, side="right")
            held = end > begin
            own, begin, last = ids[held], begin[held], end[held].tolist()
            # a cursor: item under it, its place, the place where the block ends, the term's maximum in the block
            cursors = [list(c) for c in zip(self.docs[begin].tolist(), begin.tolist(), last, self.block_max[own, b].tolist())]
            while cursors:
                cursors.sort()
                bound, pivot = 0.0, None
                for c in cursors:
                    bound += c[3]
                    if bound >= threshold:
                        pivot = c[0]
                        break
                if pivot is None:
                    break
                score = 0.0
                for c in cursors:
                    if c[0] > pivot:
                        break
                    while c[1] < c[2] and self.docs[c[1]] < pivot:
                        c[1] += 1
                    if c[1] < c[2] and self.docs[c[1]] == pivot:
                        score += float(self.weights[c[1]])
                        c[1] += 1
                    c[0] = int(self.docs[c[1]]) if c[1] < c[2] else -1
                if score >= threshold:
                    out.append((pivot, score))
                cursors = [c for c in cursors if c[0] >= 0]
        return out


def passage_words(item: int) -> int:
    """Words of the passages in which an item of so many words is sought."""
    return PASSAGE << max(0, (-(-item // LONGEST) - 1).bit_length())


def surely_kept(words: list[str], share: dict[str, float], passage: int, cover: float) -> float:
    """Lower bound of an item's score, as a share, for the best passage of a copy with cover of its shingles.

    A term is gone only if all shingles with it are, and a missing shingle takes part in five terms at most. At the
    worst place, half of what an item is longer than a step lies beyond the better of two passages."""
    own = _shingles(words)
    held: dict[str, int] = dict.fromkeys(share, 0)
    for s in own:
        for t in set(s):
            held[t] += 1
    gone = len(own) - math.ceil(cover * len(own) - 1e-9)
    room, kept = SHINGLE * (gone + max(0, -(-(len(words) - passage // 2) // 2))), 1.0
    for t, x in sorted(share.items(), key=lambda i: min(held[i[0]], SHINGLE) / i[1]):
        if room <= 0:
            break
        cost = min(held[t], SHINGLE)
        kept -= x * min(1.0, room / cost)
        room -= cost
    return kept


def passages(n: int, size: int = PASSAGE) -> list[tuple[int, int]]:
    """Word ranges that cover n words: each pair of words at a distance under half a size is together in one."""
    step = size * STEP // PASSAGE
    return [(i, min(i + size, n)) for i in range(0, max(n - size + step, 1), step)] if n else []


def candidates(index: Index, texts: list[list[str]], threshold: float = THRESHOLD) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, end, item, score) of every passage and item at or above the threshold.

    The bounds of all passages of the texts are taken at once; repeats of a term in a passage count once."""
    none = len(index.term_ids)
    get = index.term_ids.get
    ids = np.array([x for w in texts for x in map(get, w, repeat(none))], np.int64)
    begin, spans = 0, []
    for n, w in enumerate(texts):
        spans += [(n, begin, begin + s, begin + e) for s, e in passages(len(w), index.passage)]
        begin += len(w)
    if not spans:
        return
    spans = np.array(spans, np.int64)
    tops = np.concatenate([[0], np.cumsum(index.largest[ids].astype(np.float64))])
    spans = spans[tops[spans[:, 3]] - tops[spans[:, 2]] >= threshold * (1 - 1e-6)]  # repeats counted: an upper bound still
    group = max(4096 * PASSAGE // index.passage, 1)
    for at in range(0, len(spans), group):
        yield from _search_spans(index, ids, spans[at : at + group], threshold)


def _search_spans(index: Index, ids: np.ndarray, spans: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    none = len(index.term_ids)
    sizes = spans[:, 3] - spans[:, 2]
    owner = np.repeat(np.arange(len(spans)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(spans[:, 2], sizes)
    found = ids[place]
    pairs = np.unique((owner * (none + 1) + found)[found < none])
    if not len(pairs):
        return
    owner, term = pairs // (none + 1), pairs % (none + 1)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    ends = np.concatenate([starts[1:], [len(owner)]])
    least = threshold * (1 - 1e-5)
    alive = np.add.reduceat(index.largest[term], starts) >= least
    for s, e in _runs(alive, starts, ends):  # groups of passages whose terms lie side by side
        own = starts[(starts >= s) & (starts < e)]
        bounds = np.add.reduceat(index.block_max[term[s:e]], own - s, axis=0)
        row, block = np.nonzero(bounds >= least)
        for r in np.unique(row).tolist():
            at = int(np.searchsorted(starts, own[r]))
            n, first, begin, end = spans[owner[own[r]]].tolist()
            for item, score in index.search(term[starts[at] : ends[at]], threshold, block[row == r].tolist()):
                yield n, begin - first, end - first, item, score


def _runs(alive: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pairs that belong to passages still alive, neighbours joined."""
    which = np.flatnonzero(alive)
    if not len(which):
        return
    breaks = np.flatnonzero(np.diff(which) > 1)
    for i, j in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(which) - 1]])):
        yield int(starts[which[i]]), int(ends[which[j]])


def _shingles(words: list[str]) -> set[tuple]:
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)} if len(words) >= SHINGLE else {tuple(words)} if words else set()


def coverage(item: list[str], around: list[str]) -> tuple[float, float, float]:
    """Shares of the item's, the question's and the answer's shingles found in a stretch of words.

    The item's is 0 if a part has no word in the stretch."""
    cut = len(item) - max(len(item) // 3, min(len(item), SHINGLE))
    have = _shingles(around)

    def share(part: list[str]) -> float:
        need = _shingles(part)
        if need and len(part) < SHINGLE:  # shorter than a shingle: found as a run of words
            run = len(part)
            return float(any(around[i : i + run] == part for i in range(len(around) - run + 1)))
        return len(need & have) / len(need) if need else 1.0

    words = set(around)
    both = all(not part or not words.isdisjoint(part) for part in (item[:cut], item[cut:]))
    return share(item) if both else 0.0, share(item[:cut]), share(item[cut:])


def build(benchmark: DataFrame, key: str = "item_id", text: str = "text", threshold: float = THRESHOLD, cover: float = COVER) -> Iterator[Index]:
    """Indexes of the items, by class of length and ITEMS at a time; frequencies are those of all items.

    Items are split into terms once, and get their terms' frequencies once, by a join; they are written by chunk, and
    each chunk is read once. The driver holds one chunk."""
    spark = benchmark.sparkSession
    base = benchmark.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where("item is not null and text is not null")

    def split(batches):
        for b in batches:
            w = [terms(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(w, pa.list_(pa.string()))], names=["item", "words"])

    items = base.mapInArrow(split, "item long, words array<string>").where(F.size("words") > 0)
    items = cut(items.withColumn("row", F.monotonically_increasing_id()), "items")
    stats = items.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean")).first()
    if not stats["n"]:
        return
    chunks = -(-stats["n"] // ITEMS)
    each = items.select("row", F.explode(F.array_distinct("words")).alias("t"))
    df = each.groupBy("t").agg(F.count("*").alias("df"))
    counted = each.join(df, "t").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("t", "df"))).alias("df"))
    placed = items.join(counted, "row").withColumn("chunk", F.pmod(F.xxhash64("item", "row"), F.lit(chunks)).cast("int"))
    path = fresh(spark, "items-by-chunk")
    placed.select("chunk", "item", "words", "df").repartition("chunk").write.partitionBy("chunk").parquet(path)
    stored = spark.read.schema("item long, words array<string>, df map<string, bigint>, chunk int").parquet(path)
    for c in range(chunks):
        rows, counts = [], {}
        for r in stored.where(F.col("chunk") == c).toLocalIterator():
            rows.append((r["item"], list(r["words"])))
            counts.update(r["df"])
        rows.sort()
        for size in sorted({passage_words(len(w)) for _, w in rows}):
            same, most = [x for x in rows if passage_words(len(x[1])) == size], max(ITEMS * PASSAGE // size, 1)
            for i in range(0, len(same), most):
                yield Index(same[i : i + most], counts, stats["n"], stats["mean"], size, threshold, cover)


def rounds(indexes: Iterator[Index], most: int = BROADCAST) -> Iterator[list[Index]]:
    """Indexes in groups of at most `most` bytes (or one index): each group is one pass over the texts."""
    group: list[Index] = []
    for i in indexes:
        if group and sum(x.size() for x in group) + i.size() > most:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def passes(df: DataFrame, groups: Iterator[list[Index]], scan: Callable[[DataFrame, list], DataFrame], add: bool) -> DataFrame:
    """scan(df, broadcast indexes) for one group; for several, each pass is written before the next index is sent: the
    results of all are united (add), or each pass reads what the one before it left."""
    sc, spark, found = df.sparkSession.sparkContext, df.sparkSession, []
    group = next(groups, [])
    while True:
        following = next(groups, None)
        shared = [sc.broadcast(i) for i in group]
        out = scan(df, shared)
        if following is None:
            break
        out = cut(out, "decontamination")
        for i in shared:
            i.destroy()
        if add:
            found.append(out)
        else:
            df = out
        group = following
    for x in found:
        out = out.unionByName(x)
    return out


_FOUND = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("question_cover", T.DoubleType()),
        T.StructField("answer_cover", T.DoubleType()),
        T.StructField("first_word", T.LongType()),
    ]
)


def find_in(index: Index, texts: list[list[str]], threshold: float = THRESHOLD, cover: float = COVER) -> list[list[tuple]]:
    """For each text: (item key, score, question cover, answer cover, first word) of each verified item, best passage."""
    best: list[dict[int, tuple]] = [{} for _ in texts]
    for n, s, e, item, score in candidates(index, texts, threshold):
        own, score = index.words[item], score * index.scale[item]
        whole, q, a = coverage(own, texts[n][max(0, s - len(own)) : e + len(own)])
        if (whole >= cover or min(q, a) >= cover) and (item not in best[n] or score > best[n][item][0]):
            best[n][item] = (score, q, a, s)
    return [[(index.keys[i], *v) for i, v in sorted(b.items())] for b in best]


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, cover: float = COVER) -> DataFrame:
    """One row per document row and test item found in it."""

    def scan(narrow: DataFrame, shared: list) -> DataFrame:
        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in small(b, 256):
                    split = [terms(t) for t in part.column("text").to_pylist()]
                    keys = part.column("doc_id").to_pylist()
                    found = [(k, *x) for index in shared for k, own in zip(keys, find_in(index.value, split, threshold, cover)) for x in own]
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))], names=_FOUND.fieldNames())

        return narrow.mapInArrow(run, _FOUND)

    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return passes(narrow, rounds(build(benchmark, item_key, item_text, threshold, cover)), scan, add=True)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that hold a test item; every column as it was. Rows are judged where they are: no join."""

    def scan(kept: DataFrame, shared: list) -> DataFrame:
        @trimmed
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in small(b, 256):
                    split = [terms(t) for t in part.column("__text").to_pylist()]
                    found = [find_in(i.value, split) for i in shared]
                    clean = [not any(f[n] for f in found) for n in range(len(split))]
                    yield part.select(["__row"]).filter(pa.array(clean, pa.bool_()))

        return kept.select("__row", F.col("__row").getField(text).alias("__text")).mapInArrow(run, kept.schema)

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return passes(rows, rounds(build(benchmark, item_key, item_text)), scan, add=False).select("__row.*")
