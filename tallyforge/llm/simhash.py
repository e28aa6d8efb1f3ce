"""SimHash near-duplicates: exact links at 3 or fewer differing bits, found through pivot distance tables.

1. Each text gets its 64-bit fingerprint (majority of the XXH64 bits of its three-word shingles).
2. Only distinct fingerprints go on, so copies cost nothing further. A fingerprint's 64 bits are cut in blocks; two
   fingerprints with at most 3 differing bits agree in all blocks but three at least, so one table for each choice of
   those brings every linked pair together in some bucket: with five blocks ten tables, keys of 25 or 26 bits. The
   number of blocks grows with the number of fingerprints, so that a bucket of unrelated ones stays small.
3. In a bucket, each fingerprint has a row of Hamming distances to many reference fingerprints (pivots). By the
   triangle inequality two fingerprints whose rows differ by more than 3 in any column are not linked: such pairs are
   discarded by the largest coordinate difference, the survivors are verified on the bits themselves.
4. A bucket is searched breadth first, each member against those not reached yet, and gives a spanning forest, never
   its pairs. A bucket over MOST members is dealt to tasks by pairs of chunks, which still meets every pair of members
   and gives the same components; no task holds more than two chunks.
5. Components over the forest edges; each takes the smallest document id among all that carry its fingerprints.

Defined cases: null, empty and blank texts have fingerprint zero and are linked like any other; fewer than three words
make one shingle; a component without any document id has a null id; rows that repeat share a fingerprint; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import cut, over_batches, trimmed
from tallyforge.llm.components import components
from tallyforge.llm.mixing import doc_key

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Numbers of blocks, and the most distinct fingerprints for each: keys have about 26, 32 and 37 bits.
BLOCKS = ((5, 1 << 31), (6, 1 << 37), (7, 1 << 63))
#: A fingerprint that more than this share of all rows carry is looked up without a shuffle; there are at most 1 / HOT.
HOT = 1 / 4096
#: No fingerprint or row that fewer rows carry is hot.
FEW = 1000.0
#: Largest bucket that one task searches whole.
MOST = 2048
PIVOTS = 16
#: Shingles hashed at a time.
STEP = 1 << 16


def fingerprint(text: str | None) -> int:
    """The 64-bit majority fingerprint of a whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lowers A-Z only, splits on ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return majority([[xxhash.xxh64_intdigest(joined, SEED)]])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: 1 - SHINGLE]
    ends, h = ends[SHINGLE - 1 :], xxhash.xxh64_intdigest
    return majority([h(joined[i:j], SEED) for i, j in zip(starts[at : at + STEP].tolist(), ends[at : at + STEP].tolist())] for at in range(0, len(ends), STEP))


def majority(blocks: Iterable[list[int]]) -> int:
    """Bits that are set in more than half of all hashes, which come in blocks."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in blocks:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
    return int(((2 * votes > n).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", also: list | None = None) -> DataFrame:
    """doc_id and fp (a signed long) of each row, with further columns of docs if asked for."""
    extra = [F.col(key).cast("long").alias("doc_id"), *(also or [])]
    chosen = docs.select(*extra, F.col(text).alias("text"))
    schema = T.StructType([f for f in chosen.schema.fields if f.name != "text"] + [T.StructField("fp", T.LongType())])
    names = [f.name for f in schema.fields[:-1]]

    def make():
        def f(b: pa.RecordBatch):
            fp = pa.array([_signed(fingerprint(x)) for x in b.column("text").to_pylist()], pa.int64())
            return {n: b.column(n) for n in names} | {"fp": fp}

        return f

    return over_batches(chosen, schema, make)


def pivot_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """Fixed, well-spread reference fingerprints."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Row i: Hamming distances of fingerprint i to the pivots."""
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def forest(fps: np.ndarray, pivots: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (member, smallest-index root) that span the components of distinct fingerprints under distance <= radius."""
    table, left, edges = pivot_table(fps, pivots), np.arange(len(fps)), []
    while len(left) > 1:
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            at = queue.pop()
            near = np.abs(table[left, 0] - table[at, 0]) <= radius
            for c in range(1, table.shape[1], 5):  # some columns at a time: most pairs go early
                hit = np.flatnonzero(near)
                if not len(hit):
                    break
                gap = np.abs(table[left[hit], c : c + 5] - table[at, c : c + 5]).max(axis=1)
                near[hit[gap > radius]] = False
            hit = np.flatnonzero(near)
            hit = hit[np.bitwise_count(fps[left[hit]] ^ fps[at]) <= radius]
            if len(hit):
                found = left[hit]
                edges += [(int(x), root) for x in found]
                queue += found.tolist()
                keep = np.ones(len(left), bool)
                keep[hit] = False
                left = left[keep]
    return edges


_PAIR = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


@trimmed
def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges of each bucket; rows (bucket, fp) come sorted by bucket. Holds one bucket at a time."""
    pivots = pivot_fingerprints()
    ids, fps = np.empty(0, np.int64), np.empty(0, np.int64)

    def edges_of(ids, fps):
        cuts = np.flatnonzero(np.diff(ids)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(ids)]])
        sizes = ends - starts
        two = starts[sizes == 2]  # most buckets with company: all at once
        a, b = fps[two], fps[two + 1]
        ta, tb = pivot_table(a.view(np.uint64), pivots), pivot_table(b.view(np.uint64), pivots)
        close = np.abs(ta - tb).max(axis=1, initial=0) <= RADIUS
        a, b = a[close], b[close]
        close = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= RADIUS
        u, v = [a[close]], [b[close]]
        for s, e in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
            own = fps[s:e]
            found = np.array(forest(own.view(np.uint64), pivots), np.int64).reshape(-1, 2)
            u.append(own[found[:, 0]])
            v.append(own[found[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    for b in batches:
        ids = np.concatenate([ids, b.column("bucket").to_numpy()])
        fps = np.concatenate([fps, b.column("fp").to_numpy()])
        if len(ids) and ids[0] != ids[-1]:
            last = int(np.searchsorted(ids, ids[-1]))
            yield edges_of(ids[:last], fps[:last])
            ids, fps = ids[last:], fps[last:]
    if len(ids):
        yield edges_of(ids, fps)


def tables(blocks: int) -> list[Column]:
    """A key for each choice of all blocks but RADIUS, of the column fp; the keys of different choices differ."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - RADIUS)):
        key = F.lit(0).cast("long")
        for i in chosen:
            width = ends[i + 1] - ends[i]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", ends[i]).bitwiseAND(F.lit((1 << width) - 1)))
        out.append(key + F.lit(n << 48))
    return out


def blocks_for(fingerprints: int) -> int:
    return next(b for b, most in BLOCKS if fingerprints <= most)


def links(distinct: DataFrame, most: int = MOST, blocks: int = 5) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct fingerprints at RADIUS or fewer bits."""
    keyed = distinct.select("fp", F.explode(F.array(*tables(blocks))).alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    held = keyed.join(sizes, "bucket")
    chunks = F.ceil(F.col("n") / F.lit(most / 2)).cast("int")
    whole = held.where(F.col("n") <= most).select(F.col("bucket"), "fp")
    large = held.where(F.col("n") > most).withColumn("k", chunks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k").cast("long")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pair = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).bitwiseOR(F.lit(1 << 62))
    dealt = whole.unionByName(large.select(pair.alias("bucket"), "fp"))
    sorted_in = dealt.repartition(F.col("bucket")).sortWithinPartitions("bucket")
    return sorted_in.mapInArrow(_search, _PAIR).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    return _near_duplicates(docs, key, text, []).drop("root")


def _near_duplicates(docs: DataFrame, key: str, text: str, also: list) -> DataFrame:
    marked = cut(fingerprints(docs, key, text, also), "simhash")
    least = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("carriers")), "simhash-distinct")
    size = least.agg(F.count("*").alias("distinct"), F.sum("carriers").alias("rows")).first()
    edges = cut(links(least.select("fp"), blocks=blocks_for(size["distinct"])), "simhash-links")
    roots = cut(components(edges), "simhash-roots")
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", "carriers", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = cut(rooted.join(component, "root").select("fp", "carriers", "root", "component_id"), "simhash-components")
    hot = F.col("carriers") > F.lit(max((size["rows"] or 0) * HOT, FEW))
    few = F.broadcast(known.where(hot).select("fp", "root", "component_id"))  # 1 / HOT rows at most
    looked = marked.join(few, "fp", "left").withColumn("is_hot", F.col("root").isNotNull())
    rest = looked.where(~F.col("is_hot")).drop("root", "component_id").join(known.where(~hot).select("fp", "root", "component_id"), "fp")
    out = looked.where("is_hot").unionByName(rest)
    return out.select(*[c for c in marked.columns if c != "fp"], "root", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id; of rows alike in id, the one with the smallest
    fingerprint and text digest; of rows alike in all of these, any one."""
    found = _near_duplicates(docs, key, text, [doc_key(F.col(key), F.col(text)).alias("doc_key")])
    smallest = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    alike = smallest.groupBy("root", "fingerprint", "doc_key").agg(F.count("*").alias("n"))
    first = alike.groupBy("root").agg(F.min(F.struct("fingerprint", "doc_key", "n")).alias("x"))
    first = cut(first.select(F.col("x.doc_key").alias("__key"), F.col("x.n").alias("__n")), "simhash-kept")
    rows = docs.select(doc_key(F.col(key), F.col(text)).alias("__key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    many = F.col("__n") > max(docs.count() * HOT, FEW)
    kept = rows.join(first.where(~many).select("__key"), "__key", "left_semi").dropDuplicates(["__key"])
    repeated = first.where(many).select("__key")  # 1 / HOT rows at most
    if repeated.limit(1).count():
        kept = kept.unionByName(rows.join(F.broadcast(repeated), "__key", "left_semi").dropDuplicates(["__key"]))
    return kept.select("__row.*")
