"""Personal data: spans by rule, and further spans by a character-level tagger over overlapping windows.

Rules find e-mail addresses, IP addresses, card numbers and phone numbers as leftmost, non-overlapping matches in time
linear in the text. The tagger (bidirectional LSTM with CRF transitions, trained in numpy on labelled spans) reads
windows of WINDOW characters, each shifted by half of it, and adds what the rules miss: secrets (keys and tokens), numbers without a
plus sign, addresses with blanks around the at sign, cards with other separators. Windows are reconciled over the whole
text: a span counts where it lies clear of its window's edges (a wider window is read if it touches one), one that ends
inside a run of letters and digits takes all of the run, duplicates merge, of overlapping ones the longer stays, and
none that overlaps a rule's span is added. A span of any kind must hold a digit or an at sign, have at most LONGEST
characters and pass its kind's check; so a window without digit and at sign can't give a span and is not read, which
changes no result.

Defined cases: null and empty texts have no spans; positions are code points; repeated rows are handled each; an empty
table gives an empty result; one very long text is read window by window in batches of fixed size; further columns,
whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import over_batches
from tallyforge.llm.lstm_crf import Tagger, char_ids

#: Kinds that the rules find.
KINDS = ("email", "ip", "card", "phone")
#: Kinds that the tagger finds, in the order of the result.
TAGGED = (*KINDS, "secret")
WINDOW = 96
#: Characters of the longest value of any kind; what is longer is not one.
LONGEST = 512
#: Size of the tagger in each direction, and its training steps.
HIDDEN, STEPS = 24, 600
#: Windows read at a time.
BATCH = 512

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def is_card(s: str) -> bool:
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def emails(text: str) -> list[Span]:
    """An address is found from its at sign: the run of local characters before it, as far back as the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[Span]:
    """Runs of dotted numbers, taken four at a time from the left."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1 + m.start()
        for i in range(0, len(parts) - 3, 4):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                out.append(("ip", int(ends[i] - len(parts[i])), int(ends[i + 3])))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans by rule, by kind in the order of KINDS, then by start."""
    if not _SIGN.search(text):
        return []
    out = emails(text) + ips(text)
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if is_card(m.group())]
    out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def plausible(kind: str, s: str) -> bool:
    """The check that a tagged span of a kind must pass."""
    if len(s) > LONGEST:
        return False
    d = _digits(s)
    if kind == "email":
        return "@" in s and bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?@\s?[A-Za-z0-9-]+(\s?\.\s?[A-Za-z0-9-]+)+", s))
    if kind == "ip":
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and bool(re.fullmatch(r"[0-9]+(\s?\[?\.\]?\s?[0-9]+){3}", s))
    if kind == "card":
        return is_card(s) and bool(re.fullmatch(r"[0-9][0-9 ./_-]+[0-9]", s))
    if kind == "secret":
        return bool(re.fullmatch(r"[A-Za-z0-9_+/=-]{20,}", s)) and len(d) >= 2 and any(c.isalpha() for c in s) and len(set(s)) >= 8
    return 9 <= len(d) <= 15 and bool(re.fullmatch(r"\+?\(?[0-9][0-9 ().‑/-]+[0-9]", s)) and len(re.findall(r"[0-9]+", s)) >= 3


# Labelled spans ----------------------------------------------------------------------------------------------------


def _word(r: random.Random) -> str:
    return "".join(r.choice(("th", "er", "on", "an", "re", "in", "ed", "nd", "at", "es", "or", "ti", "é", "sch", "ue", "la", "de")) for _ in range(r.randint(1, 4)))


def _some(r: random.Random, letters: str, n: int) -> str:
    return "".join(r.choice(letters) for _ in range(n))


def _value(r: random.Random, kind: str) -> str:
    n = lambda k: _some(r, "0123456789", k)
    if kind == "email":
        name = r.choice((_word(r), f"{_word(r)}.{n(2)}", f"{_word(r)}{r.choice('._-+')}{_word(r)}")).replace("é", "e")
        host = ".".join(_word(r).replace("é", "e") + r.choice(("", n(1))) for _ in range(r.randint(1, 2))) + r.choice((".com", ".org", ".net", ".de", ".fr"))
        return name + r.choice(("@", "@", " @ ")) + host
    if kind == "ip":
        return r.choice((".", ".", "[.]")).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        d = n(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(("", "", " ", "-", ".", "/"))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))
    if kind == "secret":
        hexes, base = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        return r.choice((_some(r, hexes, 40), _some(r, hexes, 40), _some(r, hexes, 32), _some(r, hexes, 64), "AKIA" + _some(r, base[:26] + base[52:], 16), "sk-" + _some(r, base, 32), "ghp_" + _some(r, base, 36), _some(r, base + "+/", 40)))
    a, b, c = n(3), n(3), n(4)
    return r.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{n(2)} {a} {b} {c}", f"+{n(2)} ({a}) {b}-{c}", f"0{a[:2]}/{b} {c}"))


def _quoted(r: random.Random, secret: str) -> tuple[str, str]:
    """What may stand around a secret."""
    mark = r.choice(('"', '"', "'", ""))
    name = r.choice(("token", "token", "key", "api_key", "secret", "password", "auth"))
    return r.choice((f"{name} = ", f"{name} = ", f"{name}=", f"{name}: ", "")) + mark, mark


def _decoy(r: random.Random) -> str:
    n = lambda k: _some(r, "0123456789", k)
    return r.choice((n(r.randint(1, 12)), n(r.randint(1, 12)), f"{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(1)}", f"20{n(2)}-0{n(1)}-1{n(1)}", f"1{n(1)}:{n(2)}", "@" + _word(r), f"${n(3)}.{n(2)}", n(22), f"{n(3)}-{n(4)}", _word(r) + n(2), "".join(_word(r) for _ in range(7)) + n(1), n(30)))


def labelled_texts(count: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Invented texts with their spans: values of each kind, and numbers and marks that are none."""
    r, out = random.Random(seed), []
    for _ in range(count):
        parts, spans, at = [], [], 0
        decorate = r.choice(("", "", "", "", r.choice(("!!", "***", " |", "%%%", "$$$"))))
        for _ in range(r.randint(6, 12)):
            roll = r.random()
            before = after = ""
            if roll < 0.2:
                kind = r.choice(TAGGED)
                v = _value(r, kind)
                if kind == "secret":
                    before, after = _quoted(r, v)
                spans.append((kind, at + len(before), at + len(before) + len(v)))
            else:
                v = _decoy(r) if roll < 0.38 else _word(r)
            v = before + v + after + r.choice(("", "", "", "", ".", ",")) + decorate
            parts.append(v)
            at += len(v) + 1
        out.append((" ".join(parts), spans))
    return out


def tags_of(text: str, spans: list[Span]) -> np.ndarray:
    """0 outside, 1 + 2k at the first character of kind k, 2 + 2k in the rest."""
    y = np.zeros(len(text), np.int8)
    for kind, s, e in spans:
        k = TAGGED.index(kind)
        y[s:e] = 2 + 2 * k
        y[s] = 1 + 2 * k
    return y


def spans_of(tags: np.ndarray) -> list[Span]:
    out, open_ = [], None
    for i, t in enumerate(tags.tolist() + [0]):
        if open_ and t != 2 + 2 * open_[0]:
            out.append((TAGGED[open_[0]], open_[1], i))
            open_ = None
        if t % 2 == 1:
            open_ = ((t - 1) // 2, i)
    return out


def train(labelled: list[tuple[str, list[Span]]], hidden: int = HIDDEN, steps: int = STEPS, length: int = 64, seed: int = 0) -> Tagger:
    """A tagger of the labelled texts, cut into windows of `length` characters."""
    xs, ys = [], []
    for text, spans in labelled:
        x, y = char_ids(text), tags_of(text, spans)
        for i in range(0, max(1, len(x)), length // 2):
            part = np.zeros(length, np.int16)
            tags = np.zeros(length, np.int8)
            part[: len(x[i : i + length])] = x[i : i + length]
            tags[: len(y[i : i + length])] = y[i : i + length]
            xs.append(part)
            ys.append(tags)
    model = Tagger(1 + 2 * len(TAGGED), hidden, seed)
    model.fit(np.array(xs), np.array(ys), steps, seed=seed)
    return model


_models: dict = {}


def default_model(count: int = 6000, seed: int = 11) -> Tagger:
    """The tagger trained on invented labelled texts, once per process; the seed fixes it."""
    if (count, seed) not in _models:
        _models[count, seed] = train(labelled_texts(count, seed))
    return _models[count, seed]


# Decoding ----------------------------------------------------------------------------------------------------------


def tagged_spans(model: Tagger, texts: list[str], all_windows: bool = False) -> list[list[Span]]:
    """What the tagger finds in each text, after checks, before it is held against the rules' spans."""
    half = WINDOW // 2
    todo: list[tuple[int, int]] = []
    for n, t in enumerate(texts):
        if all_windows:
            todo += [(n, i) for i in range(-half // 2, len(t), half)]
        else:
            seen = -1
            for m in _SIGN.finditer(t):
                last = (m.start() + half // 2) // half  # windows k and k - 1 hold this character
                for k in range(max(seen + 1, last - 1), last + 1):
                    if k >= 0:
                        todo.append((n, k * half - half // 2))
                seen = max(seen, last)
    found: list[set] = [set() for _ in texts]
    ids = {n: char_ids(texts[n]) for n in {n for n, _ in todo}}
    for at in range(0, len(todo), BATCH):
        part = todo[at : at + BATCH]
        for (n, i), tags in zip(part, model.decode(_cut(ids, part, WINDOW)).T):
            for kind, s, e in spans_of(tags):
                s, e = s + i, e + i
                if s <= max(i, 0) and i > 0 or e >= i + WINDOW and i + WINDOW < len(texts[n]):
                    s, e = _wider(model, ids[n], kind, s, e)
                s, e = _whole(texts[n], max(s, 0), min(e, len(texts[n])))
                if plausible(kind, texts[n][s:e]):
                    found[n].add((kind, s, e))
    return [_longest(f) for f in found]


def _cut(ids: dict, part: list[tuple[int, int]], width: int) -> np.ndarray:
    x = np.zeros((width, len(part)), np.int16)
    for j, (n, i) in enumerate(part):
        own = ids[n][max(i, 0) : i + width]
        x[max(-i, 0) : max(-i, 0) + len(own), j] = own
    return x


def _wider(model: Tagger, ids: np.ndarray, kind: str, s: int, e: int) -> tuple[int, int]:
    """The span around s to e as windows of growing width see it, until it is clear of the edges."""
    width = 2 * WINDOW
    while True:
        i = max(0, (s + e - width) // 2)
        tags = model.decode(_cut({0: ids}, [(0, i)], width))[:, 0]
        hit = [(a + i, b + i) for k, a, b in spans_of(tags) if k == kind and a + i < e and b + i > s]
        if not hit:
            return s, s
        s2, e2 = hit[0]
        if (s2 > i or i == 0) and (e2 < i + width or i + width >= len(ids)) or e2 - s2 > LONGEST:
            return s2, e2
        width *= 2


def _whole(text: str, s: int, e: int) -> tuple[int, int]:
    """The span with the letters and digits that go on at its ends, as far as makes it longer than any value."""
    while s > 0 and s < e <= s + LONGEST and text[s - 1].isalnum() and text[s].isalnum():
        s -= 1
    while s < e < len(text) and e <= s + LONGEST and text[e].isalnum() and text[e - 1].isalnum():
        e += 1
    return s, e


def _longest(spans: set) -> list[Span]:
    out: list[Span] = []
    for x in sorted(spans, key=lambda x: (x[1] - x[2], x[1], x[0])):
        if all(x[2] <= s or x[1] >= e for _, s, e in out):
            out.append(x)
    return out


def all_spans(model: Tagger, texts: list[str], all_windows: bool = False) -> list[tuple[list[Span], list[Span]]]:
    """For each text: the rules' spans, and all spans; by kind, then start."""
    base = [base_spans(t) for t in texts]
    out = []
    for b, more in zip(base, tagged_spans(model, texts, all_windows)):
        added = [x for x in more if all(x[2] <= s or x[1] >= e for _, s, e in b)]
        out.append((b, sorted(b + added, key=lambda x: (TAGGED.index(x[0]), x[1], x[2]))))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, model: Tagger | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, base spans by kind (counts), their digest, all spans, and the number of secrets."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model())  # some 100 KB

    def make():
        m = shared.value

        def f(b: pa.RecordBatch):
            found = all_spans(m, [x or "" for x in b.column("text").to_pylist()])
            counts = {f"n_{k}": pa.array([sum(x[0] == k for x in base) for base, _ in found], pa.int64()) for k in KINDS}
            digest = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found]
            return {"doc_id": b.column("doc_id"), **counts, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array([joined(x) for _, x in found], pa.string()), "n_secret": pa.array([sum(x[0] == "secret" for x in every) for _, every in found], pa.int64())}

        return f

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return over_batches(chosen, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long", make)
