"""Token ids of whole texts, written in key order as pages of patched frame-of-reference blocks, and read back.

Texts are range-partitioned by key once (long texts and hot keys are no problem of a key: a key's rows are dealt by a
salt after their digest), encoded in order, and written by Spark's own writer as a table of pages: binary payloads of
`tallyforge.llm.pfor` with their partition, number and first position. A page is closed at PAGE ids or more, at the
end of a document. Positions over the whole corpus come from the totals of the partitions, one row each.

Encoding gives the ids that the tokenizers library gives for the whole text. A byte-level model never merges across
its pre-tokens, so a text is cut where a space stands before a character that is no white space, which always is such
a border; pieces met before are taken from bounded caches, new ones are encoded by the library (a word of letters by its model
alone, marks after it by themselves: a run of letters and a run of marks are pre-tokens). A text that holds an
added token's string, or lies in a model of another kind, goes to the library whole.

Defined cases: null and empty texts give the end id alone; a null key sorts first and is kept; rows that repeat are
written each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import pfor
from tallyforge.llm.common import shared_dir, small, trimmed
from tallyforge.llm.token_counts import tokenizer

END = 0
PAGE = 1 << 16
#: Words of letters kept: some 100 MB of a worker at most; a tenth of that for other pieces.
CACHE = 600_000
#: Bytes of text encoded at a time (more only for a single text).
SLICE = 4 << 20

PAGES = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

_CAREFUL = re.compile(r"(?= [^\s\x1c-\x1f])")
#: Text that is not just words with single spaces or line feeds between them (and no other white space anywhere).
_NOT_PLAIN = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Marks that may end a word: a run of them is a pre-token of its own after letters.
_MARKS = ".,;:!?'\")]}*#$%&|-"


class _Kept(dict):
    """A bounded cache: what is missing is made; when full, the young half becomes the old one, which is asked first."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size // 2, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = v
        return v


def _byte_letters() -> dict[int, str]:
    """The printable character by which a byte-level vocabulary writes each byte: its own where Latin-1 prints one,
    else the next free one from 256 on."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174}
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


class Encoder:
    """Ids of texts as unsigned 16- or 32-bit numbers, through bounded caches of pieces."""

    def __init__(self, path: str, size: int = CACHE):
        self.library = tokenizer(path)
        spec = json.loads(self.library.to_str())
        pre = spec.get("pre_tokenizer") or {}
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.cuts = bool(plain) and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.letters, self.model = _byte_letters(), self.library.model
        #: Bytes of the ids: of letters only, of any piece, and of a word with a space before it.
        self.cores = _Kept(self._core, size)
        self.bare = _Kept(self._piece, size // 10)
        self.spaced = _Kept(self._headed, size // 10)

    def _core(self, piece: str) -> bytes:
        """A piece that is one pre-token: straight to the library's model, in its spelling of bytes."""
        spelt = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _piece(self, piece: str) -> bytes:
        core = piece.rstrip(_MARKS)
        if core.lstrip(" ").isalpha() and core.count(" ") <= 1:
            return self.cores[core] + self.bare[piece[len(core) :]] if len(core) < len(piece) else self.cores[core]
        return array(self.code, self.library.encode(piece, add_special_tokens=False).ids).tobytes()

    def _headed(self, piece: str) -> bytes:
        """A word after a space, or after a line feed if it begins with one."""
        return self.bare["\n"] + self.bare[piece[1:]] if piece[0] == "\n" else self._piece(" " + piece)

    def ids(self, text: str) -> np.ndarray:
        """The ids of one whole text."""
        if not text:
            return np.empty(0, self.kind)
        if not self.cuts or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        return np.frombuffer(b"".join(map(self.bare.__getitem__, _CAREFUL.split(text))), self.kind)


    def _pieces(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: all in one array, where each piece's begin, and how many it has.

        A piece is a line feed or a space, then a word. Of most words the letters are one pre-token and the marks after
        them another: both are looked up apart, since far fewer letters than words are new."""
        n, unit = len(values), self.kind.itemsize
        feed = pc.starts_with(values, "\n")
        words = pc.utf8_ltrim(values, characters="\n")
        letters = pc.utf8_rtrim(words, characters=_MARKS)
        simple = pc.utf8_is_alpha(letters).to_numpy(zero_copy_only=False)
        store: list[bytes] = [self.bare["\n"]]
        begin, size = np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64)

        def put(rows: np.ndarray, column: int, found: list[bytes], index: np.ndarray | None = None) -> None:
            own = np.fromiter(map(len, found), np.int64, len(found)) // unit
            at = len(b"".join(store)) // unit + np.cumsum(own) - own
            store[:] = [b"".join([*store, *found])]
            begin[rows, column], size[rows, column] = (at, own) if index is None else (at[index], own[index])

        is_feed = feed.to_numpy(zero_copy_only=False)
        size[is_feed & simple, 0] = len(store[0]) // unit
        spelt = pc.binary_join_element_wise(pc.if_else(feed, pa.scalar("", letters.type), pa.scalar(" ", letters.type)), letters, pa.scalar("", letters.type))
        distinct = spelt.filter(pa.array(simple)).dictionary_encode()
        put(np.flatnonzero(simple), 1, [self.cores[x] for x in distinct.dictionary.to_pylist()], distinct.indices.to_numpy())
        extra = (pc.binary_length(words).to_numpy() - pc.binary_length(letters).to_numpy()).astype(np.int64)
        marked = np.flatnonzero(simple & (extra > 0))
        put(marked, 2, [self.bare[w[-k:]] for w, k in zip(words.take(pa.array(marked)).to_pylist(), extra[marked].tolist())])
        other = np.flatnonzero(~simple)
        put(other, 1, [self.spaced[x] for x in values.take(pa.array(other)).to_pylist()])
        sizes = size.sum(axis=1)
        return _gathered(np.frombuffer(store[0], self.kind), begin.reshape(-1), size.reshape(-1)), np.cumsum(sizes) - sizes, sizes

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, one text after the other, and how many each has.

        Plain texts are cut and their pieces numbered by Arrow, so that each distinct piece is looked up once."""
        counts = np.zeros(len(texts), np.int64)
        odd = np.ones(len(texts), bool)
        if self.cuts and len(texts):
            odd = pc.fill_null(pc.match_substring_regex(texts, _NOT_PLAIN), True).to_numpy(zero_copy_only=False).copy()
            for s in self.special:
                odd |= pc.fill_null(pc.match_substring(texts, s), False).to_numpy(zero_copy_only=False)
        parts: dict[int, np.ndarray] = {int(i): self.ids(texts[int(i)].as_py() or "") for i in np.flatnonzero(odd)}
        for i, x in parts.items():
            counts[i] = len(x)
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return np.concatenate([parts[i] for i in range(len(texts))] or [np.empty(0, self.kind)]), counts
        # a line feed goes to the head of the next piece; each text gets one in front, whose id is dropped again
        none, feed = pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())
        marked = pc.binary_join_element_wise(feed, pc.replace_substring(texts.take(pa.array(plain)).cast(pa.large_string()), "\n", " \n"), none)
        cut = pc.split_pattern(marked, " ")
        pieces = cut.flatten().dictionary_encode()
        flat, at, sizes = self._pieces(pieces.dictionary)
        index = pieces.indices.to_numpy()
        ids = _gathered(flat, at[index], sizes[index])
        ends = np.cumsum(sizes[index])
        first = np.concatenate([[0], ends])[cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()]  # the extra line feeds
        counts[plain] = np.diff(np.concatenate([first, [len(ids)]])) - 1
        keep = np.ones(len(ids), bool)
        keep[first] = False
        ids = ids[keep]
        if not parts:
            return ids, counts
        for i, x in zip(plain.tolist(), np.split(ids, np.cumsum(counts[plain])[:-1])):
            parts[i] = x
        return np.concatenate([parts[i] for i in range(len(texts))]), counts


def _gathered(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of an array one after the other."""
    ends = np.cumsum(size)
    place = np.repeat((begin - (ends - size)).astype(np.int32), size)
    place += np.arange(len(place), dtype=np.int32)
    return flat[place]


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """The encoder of a file, kept for the tasks that follow in the same process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_pages(docs: DataFrame, path: str, out: str, key: str = "doc_id", text: str = "text", end_id: int = END, page: int = PAGE, partitions: int | None = None) -> None:
    """Writes the ids of docs, each document followed by end_id, in ascending key order, as a table of pages at out."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    @trimmed
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        part, number, first = None, 0, 0
        keys, counts, ids, held = [], [], [], 0

        def close():
            payload = pfor.write_page(keys, counts, np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), pa.array([payload], pa.binary())], names=PAGES.fieldNames())

        for b in batches:
            for own in small(b, b.num_rows, SLICE):
                part = own.column("part")[0].as_py()
                flat, n = encoder.many(own.column("text"))
                ends = np.cumsum(n)
                flat = np.insert(flat, ends, end_id)  # each text, then its end
                ends += np.arange(1, len(n) + 1)
                names, begin, row = own.column("key").to_pylist(), 0, 0
                while row < len(n):  # as many whole texts as fill a page
                    stop = min(int(np.searchsorted(ends, begin + page - held)) + 1, len(n))
                    keys += names[row:stop]
                    counts += (n[row:stop] + 1).tolist()
                    ids.append(flat[begin : ends[stop - 1]].copy())  # a view would hold the whole slice
                    held += int(ends[stop - 1]) - begin
                    begin, row = int(ends[stop - 1]), stop
                    if held >= page:
                        yield close()
                        number, first = number + 1, first + held
                        keys, counts, ids, held = [], [], [], 0
            pa.default_memory_pool().release_unused()
        if keys:
            yield close()

    chosen = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(text), F.monotonically_increasing_id()), F.lit(4096)).alias("salt"))
    ordered = chosen.repartitionByRange(n, "key", "salt").sortWithinPartitions("key", "salt")
    pages = ordered.select("key", "text", F.spark_partition_id().alias("part")).mapInArrow(encode, PAGES)
    pages.write.option("compression", "none").parquet(out)


_DOCS = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("local", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])


def read_pages(spark: SparkSession, out: str) -> DataFrame:
    """One row per document of a table of pages: doc_id, start, n_tokens, ids_crc32 (of little-endian 32-bit ids)."""
    pages = spark.read.schema(PAGES).parquet(out)
    totals = pages.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a partition
    sums = np.cumsum([0] + [r["n"] for r in totals]).tolist()
    offsets = spark.createDataFrame([(r["part"], s) for r, s in zip(totals, sums)], "part int, before long")

    @trimmed
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, counts, ids = pfor.read_page(b.column("payload")[i].as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                local = b.column("first")[i].as_py() + ends - counts
                yield pa.RecordBatch.from_arrays([pa.array([b.column("part")[i].as_py()] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(local, pa.int64()), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=_DOCS.fieldNames())

    found = pages.select("part", "first", "payload").mapInArrow(decode, _DOCS)
    return found.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, out: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the pages (under the shared folder unless out says where) and returns what is read back from them."""
    import uuid

    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/tallyforge/{spark.sparkContext.applicationId}/token-pages-{uuid.uuid4().hex}"
    write_pages(docs, path, out, key, text)
    return read_pages(spark, out)
