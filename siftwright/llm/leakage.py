"""Problem 2: evaluation texts leaking into training text.

Each training shard (files of one task up to a bounded size, over as many
batches as that takes) gets an FM-index over words: suffix array by prefix doubling, Burrows-Wheeler
transform, wavelet matrix with rank counts, and sampled suffix positions.  Every
phrase of ``LEAST_WORDS`` consecutive words of every evaluation text whose words
the shard has is searched backwards in all ranges at once; occurrences are located from the samples by
walking backwards; overlapping ones are merged to spans for removal.

Words that no evaluation text has cannot be part of a passage.  They stand for
one separator, and stretches between separators that are shorter than a phrase
are left out: that shortens the index and loses no passage.

Defined results: null, empty and blank contents hold nothing; a passage that
stands several times in a file is one pair with several spans; evaluation texts
of fewer words than a phrase are never found; equal evaluation texts are found
each; repeated files are answered each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: words a passage must have.
LEAST_WORDS = 20
#: Characters of text that one index covers; a file is never divided.
SHARD_CHARS = 6_000_000
#: Characters of evaluation texts that the driver agrees to read and broadcast.
MOST_ITEM_CHARS = 100_000_000
#: Every so many suffix positions one is kept.
SAMPLE_RATE = 8

_WORD = re.compile(r"[^\W_]+")
_ESCAPE = re.compile(r"\\(?:u\{?[0-9A-Fa-f]{4,6}\}?|x[0-9A-Fa-f]{2}|[0-7]{3}|[abefnrtv0])|&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});")


def _unescape(m: re.Match) -> str:
    """What an escape stands for, if a letter or digit, else a blank; as long as the escape was."""
    s = m.group()
    if s[0] == "&":
        c = html.unescape(s)
    elif s[1] in "ux" or len(s) == 4:
        code = int(re.sub(r"[^0-9A-Fa-f]", "", s[2:]), 16) if s[1] in "ux" else int(s[1:], 8)
        c = chr(code) if code < 0x110000 else " "
    else:
        c = " "
    # a letter must stay joined to its neighbours, so it takes the escape's place at the end of blanks only for non-words
    return c if len(c) == 1 and c.isalnum() else " " * len(s)


def normal(text: str) -> str:
    """Lower case, escapes undone."""
    if "\\" in text or "&" in text:
        text = _ESCAPE.sub(_unescape, text)
    return text.lower()


def words(text: str) -> list[str]:
    return _WORD.findall(normal(text))


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; each 0 is an end of its own, the earlier the smaller."""
    n = len(symbols)
    ends = symbols == 0
    rank = symbols.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    # a rank is the slot at which its group begins
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    while True:
        ranked = rank[order]
        tied = np.zeros(n, dtype=bool)
        same = ranked[1:] == ranked[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        if not tied.any():
            return order
        # only ties are sorted again, by what follows after `step`
        slots = np.flatnonzero(tied)
        items = order[slots]
        ahead = items + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((second, rank[items]))
        items, second = items[by], second[by]
        order[slots] = items
        first = rank[items]
        new = np.empty(len(items), dtype=bool)
        new[0] = True
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[items] = slots[np.maximum.accumulate(np.where(new, np.arange(len(items)), 0))]
        step *= 2


class WaveletMatrix:
    """Rank counts of a sequence of symbols, one level a bit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.zeros: list[np.ndarray] = []
        self.count: list[int] = []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            ranks = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(~bit, out=ranks[1:])
            self.zeros.append(ranks)
            self.count.append(int(ranks[-1]))
            now = np.concatenate([now[~bit], now[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` falls after all levels for a symbol; differences of places are ranks."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            zero = self.zeros[k][at]
            at = np.where((symbol >> level) & 1, self.count[k] + at - zero, zero)
        return at


class FMIndex:
    """Backward search over a sequence of symbols in which 0 ends a stretch."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.n = len(symbols)
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]  # before the first stands the last, a 0
        self.matrix = WaveletMatrix(self.bwt, top)
        counts = np.bincount(symbols, minlength=top + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
        self.base = self.matrix.place(np.arange(top + 1), np.zeros(top + 1, dtype=np.int64))
        # positions at the sampling rate are kept, and those after an end, over which no walk may go
        self.kept = np.flatnonzero((order % SAMPLE_RATE == 0) | (self.bwt == 0))
        self.positions = order[self.kept].astype(np.int64)

    def sampled(self, at: np.ndarray) -> np.ndarray:
        """Kept positions of suffixes, -1 for others."""
        slot = np.minimum(np.searchsorted(self.kept, at), len(self.kept) - 1)
        return np.where(self.kept[slot] == at, self.positions[slot], -1)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.matrix.place(symbol, at) - self.base[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (a row of symbols), all phrases at once."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, k]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        dead = np.ones(len(phrases), dtype=bool)
        dead[live] = False
        low[dead] = high[dead] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by walking backwards to a sampled one."""
        at, walked = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        out = self.sampled(at)
        open_ = np.flatnonzero(out < 0)
        while len(open_):
            at[open_] = self.step(self.bwt[at[open_]], at[open_])
            walked[open_] += 1
            got = self.sampled(at[open_])
            hit = got >= 0
            out[open_[hit]] = got[hit] + walked[open_[hit]]
            open_ = open_[~hit]
        return out


class Phrases:
    """All phrases of the evaluation texts, as rows of word numbers; equal phrases once, with all their items."""

    def __init__(self, items: list[tuple[int, str]], least: int = LEAST_WORDS):
        self.least = least
        texts = [(i, words(t)) for i, t in items if t]
        texts = [(i, w) for i, w in texts if len(w) >= least]
        self.number = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}), 1)}
        rows, owners = [], []
        for item, ws in texts:
            ids = np.array([self.number[w] for w in ws], dtype=np.int32)
            windows = np.lib.stride_tricks.sliding_window_view(ids, least)
            rows.append(windows)
            owners.append(np.full(len(windows), item, dtype=np.int64))
        self.top = len(self.number)
        self.rows = np.concatenate(rows) if rows else np.zeros((0, least), dtype=np.int32)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)

    def numbers(self, text: str) -> np.ndarray:
        get = self.number.get
        found = words(text)
        return np.fromiter((get(w, 0) for w in found), dtype=np.int32, count=len(found))


def stretches(numbers: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of known words that are as long as a phrase."""
    zero = np.flatnonzero(numbers == 0)
    bounds = np.concatenate([[-1], zero, [len(numbers)]])
    for k in np.flatnonzero(np.diff(bounds) - 1 >= least).tolist():
        yield int(bounds[k]) + 1, int(bounds[k + 1])


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, int, int, int]]:
    """``(text, item, first word, end word)`` of the passages in the texts of one shard, merged where they overlap."""
    parts, text_of, word_of, starts = [], [], [], []
    size = 0
    for k, text in enumerate(texts):
        if not text or not phrases.top:
            continue
        numbers = phrases.numbers(text)
        for s, e in stretches(numbers, phrases.least):
            parts += [numbers[s:e], np.zeros(1, dtype=np.int32)]
            text_of.append(k)
            word_of.append(s)
            starts.append(size)
            size += e - s + 1
    if not parts:
        return []
    symbols = np.concatenate(parts)
    there = np.bincount(symbols, minlength=phrases.top + 1) > 0
    able = np.flatnonzero(there[phrases.rows].all(axis=1))
    if not len(able):
        return []
    index = FMIndex(symbols, phrases.top)
    low, high = np.zeros(len(phrases.rows), dtype=np.int64), np.zeros(len(phrases.rows), dtype=np.int64)
    low[able], high[able] = index.search(phrases.rows[able])
    hits = np.flatnonzero(high > low)
    if not len(hits):
        return []
    counts = high[hits] - low[hits]
    rows = np.repeat(low[hits] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    at = index.locate(rows)
    run = np.searchsorted(starts, at, side="right") - 1
    text = np.asarray(text_of)[run]
    first = np.asarray(word_of)[run] + at - np.asarray(starts)[run]
    item = np.repeat(phrases.owners[hits], counts)
    order = np.lexsort((first, item, text))
    out: list[tuple[int, int, int, int]] = []
    for t, i, f in zip(text[order].tolist(), item[order].tolist(), first[order].tolist()):
        if out and out[-1][0] == t and out[-1][1] == i and f <= out[-1][3]:
            out[-1] = (t, i, out[-1][2], f + phrases.least)
        else:
            out.append((t, i, f, f + phrases.least))
    return out


def character_spans(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Where stretches of words lie in a text, in characters."""
    plain = _ESCAPE.sub(lambda m: " " * (len(m.group()) - len(r)) + r if (r := _unescape(m)).strip() else r, text)
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in plain)
    at = [m.span() for m in _WORD.finditer(low)]
    return [(at[s][0], at[min(e, len(at)) - 1][1]) for s, e in found if s < len(at)]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Spans in order, those that overlap or touch as one."""
    out: list[list[int]] = []
    for s, e in sorted(map(list, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[list, list[str]]]:
    """Ids and contents of a task's files, in parts of about ``SHARD_CHARS`` characters; a file is never divided."""
    ids, texts, total = [], [], 0
    for pdf in batches:
        for i, text in zip(pdf["id"], pdf["content"]):
            n = len(text)
            if texts and total + n > SHARD_CHARS:
                yield ids, texts
                ids, texts, total = [], [], 0
            ids.append(i)
            texts.append(text)
            total += n
    if texts:
        yield ids, texts


def _passages(files: DataFrame, items: DataFrame, least: int, rows_of: Callable[[list, list[str], dict], pd.DataFrame], schema: str) -> DataFrame:
    """``rows_of(ids, contents, {(file, item): stretches of words})`` of each shard."""
    held_chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if held_chars > MOST_ITEM_CHARS:
        raise ValueError(f"evaluation texts of {held_chars} characters; MOST_ITEM_CHARS is {MOST_ITEM_CHARS}")
    held = [(r[0], r[1]) for r in items.select("item_id", "text").collect()]
    shared = files.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = Phrases(shared.value, least)
        for ids, texts in _shards(batches):
            pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
            for text, item, first, end in search_shard(texts, phrases):
                pairs.setdefault((text, item), []).append((first, end))
            yield rows_of(ids, texts, pairs)

    return files.where(F.length("content") > 0).select("id", "content").mapInPandas(run, schema)


def leaked_passages(files: DataFrame, items: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``id, item_id, words, spans`` for each file of ``files(id, content)`` and item that share a passage.

    Narrow: one scan, no shuffle.  The evaluation texts are a table of checked
    size, which the driver reads and every worker turns into phrases once.
    """

    def rows_of(ids: list, texts: list[str], pairs: dict) -> pd.DataFrame:
        rows = [(ids[t], i, sum(b - a for a, b in w), [list(x) for x in character_spans(texts[t], w)]) for (t, i), w in pairs.items()]
        return pd.DataFrame(rows, columns=["id", "item_id", "words", "spans"])

    return _passages(files, items, least, rows_of, "id bigint, item_id bigint, words int, spans array<array<int>>")


def without_passages(files: DataFrame, items: DataFrame, least: int = LEAST_WORDS, mark: str = "") -> DataFrame:
    """``id, items, spans, content`` of each file with a passage: its items, the spans of all of them merged, and the content with ``mark`` in place of each span."""

    def rows_of(ids: list, texts: list[str], pairs: dict) -> pd.DataFrame:
        found: dict[int, tuple[set, list]] = {}
        for (t, i), w in pairs.items():
            own = found.setdefault(t, (set(), []))
            own[0].add(i)
            own[1].extend(character_spans(texts[t], w))
        rows = []
        for t, (held, spans) in found.items():
            spans, text = merged(spans), texts[t]
            bounds = [0, *[x for span in spans for x in span], len(text)]
            rows.append((ids[t], sorted(held), spans, mark.join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2]))))
        return pd.DataFrame(rows, columns=["id", "items", "spans", "content"])

    return _passages(files, items, least, rows_of, "id bigint, items array<bigint>, spans array<array<int>>, content string")
