"""Problem 8: encoding of whole texts with a public byte-level BPE tokenizer.

Pre-tokenisation is vectorised and uses no regular expression.  All texts of an
Arrow batch become one array of code points; a table gives each its class
(letter, number, white space, other).  Boundaries follow from the classes of
neighbours, but for contractions ("'s", "'re"), of which one may begin right
where another ended: whether a candidate is one is a chain of transition
functions x -> base | (adjacent & x), which an associative doubling scan
composes.  The slices between boundaries feed pair merging behind a cache, and
the offsets of the slices are kept, so that ids can be traced and decoded.

Defined results: an empty list of ids for a null and for an empty text; strings
that look like special tokens are ordinary text; lone surrogates become U+FFFD;
repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Texts of so many characters are cut into batches of their own; a text is never cut.
BATCH_CHARS = 4_000_000
#: Distinct slices kept with their ids in each worker.
CACHE_SLICES = 400_000

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space as the tokenizer's pattern has it.
_SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point, from the Unicode categories."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), dtype=np.uint8, count=sys.maxunicode + 1)
    table[_SPACES] = SPACE
    return table


def boundaries(points: np.ndarray, first: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """Where slices begin in ``points`` (code points of all texts, one after another); ``first``: where texts begin."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    cls = (class_table() if table is None else table)[points]
    new_text = np.zeros(n + 1, dtype=bool)
    new_text[first[first < n]] = True
    new_text[n] = True
    starts_text = new_text[:n]
    before = np.empty(n, dtype=np.uint8)
    before[0], before[1:] = OTHER, cls[:-1]
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = (points[:-1] == 0x20) & ~starts_text[1:]
    space = cls == SPACE
    space_before = (before == SPACE) & ~starts_text
    # without contractions: a change of class, but that one blank joins what follows it
    cut = starts_text | (space & ~space_before) | (~space & space_before & ~blank_before) | (~space & ~space_before & (cls != before))
    # the last of several spaces stands apart from the others if something follows
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = ~space[1:]
    cut |= space & space_before & follows & ~new_text[1:]
    _cut_contractions(points, cut, new_text, before, blank_before, starts_text)
    return np.flatnonzero(cut)


def _cut_contractions(points: np.ndarray, cut: np.ndarray, new_text: np.ndarray, before: np.ndarray, blank_before: np.ndarray, starts_text: np.ndarray) -> None:
    n = len(points)
    at = np.flatnonzero(points == 0x27)
    if not len(at):
        return
    padded = np.concatenate([points, np.zeros(3, dtype=points.dtype)])
    ends = np.concatenate([new_text, np.ones(3, dtype=bool)])
    one, two = padded[at + 1], padded[at + 2]
    has_one, has_two = ~ends[at + 1], ~ends[at + 1] & ~ends[at + 2]
    single = np.isin(one, [ord(c) for c in "sdmt"]) & has_one
    double = has_two & (((one == ord("l")) & (two == ord("l"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("r")) & (two == ord("e"))))
    length = np.where(single, 1, np.where(double, 2, 0))
    at, length = at[length > 0], length[length > 0]
    if not len(at):
        return
    base = starts_text[at] | ((before[at] != OTHER) & ~blank_before[at])
    adjacent = np.zeros(len(at), dtype=bool)
    adjacent[1:] = (at[1:] == at[:-1] + 1 + length[:-1]) & ~starts_text[at[1:]]
    # associative scan of the functions x -> base | (adjacent & x)
    b, a, step = base.copy(), adjacent.copy(), 1
    while a.any() and step < len(at):
        nb, na = b.copy(), a.copy()
        nb[step:] = b[step:] | (a[step:] & b[:-step])
        na[step:] = a[step:] & a[:-step]
        na[:step] = False
        b, a, step = nb, na, step * 2
    at, length = at[b], length[b]
    cut[at] = True
    cut[at + 1] = False
    inside = at[length == 2] + 2
    cut[inside] = False
    after = at + 1 + length
    cut[after[after < n]] = True


class BytePairs:
    """Pair merging with ranks; the ids of slices are cached."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.bytes = {v: k for k, v in self.ranks.items()}
        self.cache: dict[str, tuple[int, ...]] = {}

    def ids_of(self, piece: str) -> tuple[int, ...]:
        got = self.cache.get(piece)
        if got is None:
            raw = piece.encode("utf-8", "replace")
            whole = self.ranks.get(raw)
            got = (whole,) if whole is not None else tuple(self._merge(raw))
            if len(self.cache) >= CACHE_SLICES:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = got
        return got

    def _merge(self, raw: bytes) -> list[int]:
        """The pair of lowest rank first, the leftmost of equals; a heap over a linked list keeps long slices near linear."""
        n, ranks = len(raw), self.ranks
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if not alive[i]:
                continue
            j = after[i]
            if j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], after[i] = e, after[j]
            if after[i] < n:
                ahead[after[i]] = i
                k = after[i]
                if (r := ranks.get(raw[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := ahead[i]) >= 0 and (r := ranks.get(raw[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (one more than texts)."""
        flat, lengths, _ = self._encode(texts)
        return flat, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def encode_with_offsets(self, text: str) -> list[tuple[int, int, tuple[int, ...]]]:
        """``(start, end, ids)`` of each slice of a text, in characters."""
        points = _points([text])
        cuts = boundaries(points, np.zeros(1, dtype=np.int64))
        ends = [*cuts[1:].tolist(), len(points)] if len(cuts) else []
        return [(s, e, self.ids_of(text[s:e])) for s, e in zip(cuts.tolist(), ends)]

    def decode(self, ids) -> str:
        return b"".join(self.bytes[int(i)] for i in ids).decode("utf-8", "replace")

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, int]:
        texts = [t or "" for t in texts]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(texts) else np.zeros(0, dtype=np.int64)
        joined = "".join(texts)
        cuts = boundaries(_points([joined]), first[lengths > 0])
        bounds = cuts.tolist()
        bounds.append(len(joined))
        ids_of, cache = self.ids_of, self.cache
        pieces = [joined[s:e] for s, e in zip(bounds, bounds[1:])]
        groups = [cache.get(p) or ids_of(p) for p in pieces]
        counts = np.fromiter(map(len, groups), dtype=np.int64, count=len(groups))
        total = int(counts.sum())
        flat = np.fromiter((i for g in groups for i in g), dtype=np.int32, count=total)
        sums = np.concatenate([[0], np.cumsum(counts)])
        text_ends = np.searchsorted(cuts, first + lengths, side="left")
        text_starts = np.searchsorted(cuts, first, side="left")
        return flat, sums[text_ends] - sums[text_starts], total


def _points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")


_LOADED: dict[int, BytePairs] = {}


def pairs_of(vocabulary: bytes) -> BytePairs:
    """One tokenizer a worker and vocabulary."""
    key = hash(vocabulary)
    if key not in _LOADED:
        _LOADED[key] = BytePairs(vocabulary)
    return _LOADED[key]


def chunks(texts: list, most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many characters together, at least one text each."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > most:
            yield start, k
            start, size = k, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def broadcast_vocabulary(spark, path: str):
    """The vocabulary file (under a megabyte, its size does not depend on the data) is read once, by the driver."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``<id>, ids`` of each document: narrow, one scan, no shuffle."""
    shared = broadcast_vocabulary(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = pairs_of(shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s, e in chunks(texts):
                flat, at = bpe.encode_many(texts[s:e])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), ids], names=[id_column, "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


def count_tokens(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``<id>, n_tokens`` of each document, without moving the ids."""
    return encode(documents, id_column, text_column, vocabulary).select(id_column, F.size("ids").alias("n_tokens"))


def token_lengths(texts: pd.Series, vocabulary: bytes) -> np.ndarray:
    """Number of tokens of each text of a batch."""
    bpe, values, out = pairs_of(vocabulary), texts.tolist(), []
    for s, e in chunks(values):
        _, at = bpe.encode_many(values[s:e])
        out.append(np.diff(at))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
