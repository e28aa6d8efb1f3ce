"""Exact token counts of whole texts, huge ones by overlapping chunks that are spliced where they agree.

A text up to `huge` characters is encoded in one call. A longer one is encoded in chunks that overlap; each call
gives ids with their places in the text. Two neighbouring chunks are spliced at a token boundary inside their overlap that
is proven stable: both encodings have a boundary there, it follows white space that a letter or digit follows (so
that no normalisation or pre-token crosses it), and at least `agree` tokens on either side are the same in both.
If no such place exists the overlap is doubled, up to one call over the rest of the text: the count is always
that of the whole text.

Defined cases: null and empty texts have 0 tokens and 0 bytes; very long texts are counted whole, one without any
stable boundary in one call at last; repeated rows are counted each; an empty table gives an empty result; further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import over_batches

#: Characters beyond which a text is encoded in chunks, the length of a chunk, the first overlap, and the tokens that
#: must agree on either side of a splice. A chunk keeps what one call holds at a time small.
HUGE, CHUNK, OVERLAP, AGREE = 20_000, 16_000, 400, 8

_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process; truncation and padding off."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
        else:
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_file=path)
        _loaded[path] = t
    return _loaded[path]


def count_batch(t, texts: list[str]) -> list[int]:
    if hasattr(t, "encode_batch_fast"):
        return [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    return [len(x) for x in t.encode(texts, num_threads=1)]


class Chunk:
    """The encoding of text[begin:end]: its ids, and the token that starts at a place of the text."""

    def __init__(self, t, text: str, begin: int, end: int):
        self.begin, self.end = begin, min(end, len(text))
        self.encoding = t.encode(text[begin : self.end], add_special_tokens=False)
        self.ids = self.encoding.ids

    def starts(self, at: int) -> int | None:
        """The number of the token that starts at a place of the text, or None."""
        i = self.encoding.char_to_token(at - self.begin)
        return i if i is not None and self.encoding.token_to_chars(i)[0] == at - self.begin else None

    def place(self, i: int) -> int:
        return self.encoding.token_to_chars(i)[0] + self.begin

    def before(self, at: int) -> int:
        """Tokens that start before a place of the text."""
        i = self.starts(at)
        return i if i is not None else sum(s + self.begin < at for s, _ in self.encoding.offsets)


def _stable(text: str, at: int) -> bool:
    """Between white space and a letter or digit, both plain ASCII: no normal form or pre-token spans it."""
    return 0 < at < len(text) and text[at - 1] in " \n" and text[at].isascii() and text[at].isalnum()


def splice(text: str, left: Chunk, right: Chunk, agree: int = AGREE) -> int | None:
    """A position in text where the encodings of two overlapping chunks may be joined, or None: the stable common
    boundary nearest to the middle of the overlap."""
    middle, reach = (right.begin + left.end) // 2, (left.end - right.begin) // 2 + 1
    for d in range(reach + 1):
        for at in (middle - d, middle + d) if d else (middle,):
            if not right.begin <= at < left.end or not _stable(text, at):
                continue
            i, j = left.starts(at), right.starts(at)
            if i is None or j is None or min(i, j, len(left.ids) - i, len(right.ids) - j) < agree:
                continue
            if left.ids[i - agree : i + agree] == right.ids[j - agree : j + agree] and all(left.place(i + k) == right.place(j + k) for k in range(-agree, agree)):
                return at
    return None


def count_huge(t, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, agree: int = AGREE) -> int:
    """The number of tokens of a text that is encoded chunk by chunk."""
    if not hasattr(t, "encode_batch"):
        return len(t.encode(text))  # a sentencepiece model gives no offsets into the text; it is linear in its length
    total, counted_from = 0, 0  # tokens so far; where the held chunk's counting begins
    held = Chunk(t, text, 0, chunk)
    while held.end < len(text):
        wide = overlap
        while True:
            begin = max(held.begin, held.end - wide)
            if begin <= counted_from:  # the overlap has eaten the chunk: encode from its start, twice as far
                held = Chunk(t, text, held.begin, 2 * held.end - held.begin)
                break
            new = Chunk(t, text, begin, begin + max(chunk, 2 * wide))
            at = splice(text, held, new, agree)
            if at is not None and at > counted_from:
                total += held.before(at) - held.before(counted_from)
                counted_from, held = at, new
                break
            wide *= 2
    return total + len(held.ids) - held.before(counted_from)


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens as the library gives for the whole text."""

    def make():
        t = tokenizer(path)

        def f(b: pa.RecordBatch) -> dict[str, pa.Array]:
            texts = [x or "" for x in b.column("text").to_pylist()]
            short = [i for i, x in enumerate(texts) if len(x) <= huge]
            n = [0] * len(texts)
            for i, c in zip(short, count_batch(t, [texts[i] for i in short])):
                n[i] = c
            for i, x in enumerate(texts):
                if len(x) > huge:
                    n[i] = count_huge(t, x, chunk, overlap)
            return {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_tokens": pa.array(n, pa.int64())}

        return f

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"), F.col(text).alias("text"))
    return over_batches(chosen, "doc_id long, n_bytes long, n_tokens long", make)
