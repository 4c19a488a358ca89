"""Problem 9: filling containers of fixed capacity with documents.

Lexical retrieval packing.  Documents are put in order of a min-hash of their
tokens, so that such with much vocabulary in common lie near each other, and cut
into shards of bounded size along that order; each shard has a BM25 inverted
index over tokens.  The largest unused document seeds a container, the index
returns its unused neighbours by score, and these fill the container greedily;
the last of its room (``TAIL``) goes to the largest unused documents that fit,
as the score knows nothing of sizes.

A document is split only if it is larger than a container: into full containers
and one remainder, which is packed like a document.

Defined results: null and empty texts have size 0 and stand in their shard's
last container with 0 tokens; equal sizes and scores are decided by doc_id; repeated texts are
packed each; an empty table gives no rows; a capacity that is null or below 1
is left out; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import tokenizer

#: Documents and characters a shard holds on average at most; the number of shards follows from the table.
SHARD_DOCUMENTS, SHARD_CHARS = 4000, 50_000_000
#: BM25 as published.
K1, B = 1.2, 0.75
#: Below this share of free room the best fit counts, no longer the score.
TAIL = 0.12
#: Terms in more than this share of a shard's documents tell none of them apart and are left out of scores.
COMMON = 0.5
#: Share of the indexed documents still unused below which the index is made anew for them.
SHRINK = 0.7
#: Neighbours that are ranked first; more only as long as a container has room.
FIRST_RANKED = 32
#: Budgets that the driver agrees to read.
MOST_BUDGETS = 1000
#: Modulus of the min-hashes, and two factors of them.
_PRIME, _FACTORS = 2147483647, (1103515245, 69069069)

SCHEMA = "budget_id int, container_id bigint, position int, doc_id bigint, first_token bigint, n_tokens bigint"
_SIZED = "doc_id bigint, size bigint, chars bigint, near bigint, terms array<int>, tf array<int>"


def sized(documents: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, size, chars, near, terms, tf``: tokens, characters, place by min-hash and token frequencies of each document."""
    shared = tokenizer.broadcast_vocabulary(documents.sparkSession, vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer.pairs_of(shared.value)
        for pdf in batches:
            texts = pdf["text"].tolist()
            for s, e in tokenizer.chunks(texts):
                flat, at = bpe.encode_many(texts[s:e])
                flat = flat.astype(np.int64)
                some = np.flatnonzero(np.diff(at))
                near = np.zeros(e - s, dtype=np.int64)
                if len(some):
                    first, second = (np.minimum.reduceat((flat + 1) * f % _PRIME, at[some]) for f in _FACTORS)
                    near[some] = first << 31 | second
                parts = [np.unique(flat[a:b], return_counts=True) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pd.DataFrame({
                    "doc_id": pdf["doc_id"].iloc[s:e].to_numpy(), "size": np.diff(at), "chars": [len(t or "") for t in texts[s:e]], "near": near,
                    "terms": [t.astype(np.int32) for t, _ in parts], "tf": [c.astype(np.int32) for _, c in parts],
                })

    return documents.select("doc_id", "text").mapInPandas(run, _SIZED)


class Index:
    """BM25 inverted index of one shard."""

    def __init__(self, terms: list[np.ndarray], tf: list[np.ndarray]):
        n = len(terms)
        lengths = np.fromiter((t.sum() for t in tf), dtype=np.float64, count=n)
        counts = np.fromiter(map(len, terms), dtype=np.int64, count=n)
        flat = np.concatenate(terms) if n else np.zeros(0, dtype=np.int64)
        freq = np.concatenate(tf).astype(np.float64) if n else np.zeros(0)
        docs = np.repeat(np.arange(n), counts)
        _, self.term = np.unique(flat, return_inverse=True)
        df = np.bincount(self.term) if len(flat) else np.zeros(0, dtype=np.int64)
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / max(lengths.mean() if n else 1.0, 1e-9))
        weight = idf[self.term] * freq * (K1 + 1) / (freq + norm[docs]) if len(flat) else freq
        weight[(df > COMMON * n)[self.term]] = 0
        order = np.argsort(self.term, kind="stable")
        self.rare = df <= COMMON * n
        self.docs, self.weight = docs[order].astype(np.int32), weight[order].astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
        self.own = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.n = n

    def only(self, wanted: np.ndarray) -> Index:
        """The index with the postings of some documents only; their scores stay as they are."""
        kept = wanted[self.docs]
        out = copy(self)
        out.docs, out.weight = self.docs[kept], self.weight[kept]
        out.at = np.concatenate([[0], np.cumsum(kept)])[self.at]
        return out

    def scores(self, doc: int) -> np.ndarray:
        """Score of every document of the shard for the words of one."""
        query = self.term[self.own[doc] : self.own[doc + 1]]
        query = query[self.rare[query]]
        if not len(query):
            return np.zeros(self.n, dtype=np.float32)
        starts, ends = self.at[query], self.at[query + 1]
        counts = ends - starts
        picks = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.bincount(self.docs[picks], weights=self.weight[picks], minlength=self.n)


def by_score(items: np.ndarray, scores: np.ndarray) -> Iterator[int]:
    """Items from the highest score down, equals by their order; only as many are sorted as are asked for."""
    done, wanted = 0, FIRST_RANKED
    while done < len(items):
        wanted = min(wanted, len(items))
        # everything down to the score of the last one wanted, so that equals are not torn apart
        least = scores[np.argpartition(-scores, wanted - 1)[wanted - 1]]
        top = np.flatnonzero(scores >= least)
        ranked = top[np.lexsort((top, -scores[top]))]
        yield from items[ranked[done:]].tolist()
        done, wanted = len(ranked), 8 * max(wanted, len(ranked))


def fill(sizes: np.ndarray, capacity: int, index: Index) -> Iterator[list[int]]:
    """Lists of items, one for each container; every item of 1 to ``capacity`` tokens is in exactly one."""
    unused = sizes > 0
    order = sorted(((int(s), -k) for k, s in enumerate(sizes) if s > 0))
    indexed = len(sizes)
    while order:
        size, k = order[-1]
        seed = -k
        box, room = [], capacity

        def take(item: int) -> None:
            nonlocal room
            box.append(item)
            room -= int(sizes[item])
            unused[item] = False
            del order[bisect_right(order, (int(sizes[item]), -item)) - 1]

        take(seed)
        if room > TAIL * capacity and order and order[0][0] <= room:
            # postings of used documents are dropped from time to time, so that scoring gets cheaper as documents are used up
            if len(order) < SHRINK * indexed:
                index, indexed = index.only(unused), len(order)
            fit = np.flatnonzero(unused & (sizes <= room))
            for item in by_score(fit, index.scores(seed)[fit]):
                if room <= TAIL * capacity:
                    break
                if sizes[item] <= room:
                    take(item)
        while order and order[0][0] <= room:
            take(-order[bisect_right(order, (room, 1)) - 1][1])
        yield box


def pack_shard(first: dict[int, int], ids: np.ndarray, sizes: np.ndarray, terms: list, tf: list, budgets: list[tuple[int, int]]) -> pd.DataFrame:
    """Rows of a shard's containers; ``first`` holds the number of each budget's next container and is moved on."""
    index = Index(terms, tf)
    parts = []
    for budget, capacity in budgets:
        start = number = first[budget]
        out: list[tuple[int, int, int, int, int]] = []
        full, rest = sizes // capacity, sizes % capacity
        # a document as large as a container fills one without being split
        for k in np.flatnonzero(full).tolist():
            for c in range(int(full[k])):
                out.append((number, 0, ids[k], c * capacity, capacity))
                number += 1
        place = 0
        for box in fill(rest, capacity, index):
            out += [(number, p, ids[k], full[k] * capacity, rest[k]) for p, k in enumerate(box)]
            place = len(box)
            number += 1
        # documents without tokens stand in the shard's last container
        empty = np.flatnonzero(sizes == 0).tolist()
        if empty and number == start:
            number += 1
        place = place or int(number - start > 0 and bool(out))
        out += [(number - 1, place + p, ids[k], 0, 0) for p, k in enumerate(empty)]
        first[budget] = number
        parts.append(pd.DataFrame(out, columns=["container_id", "position", "doc_id", "first_token", "n_tokens"]).assign(budget_id=budget))
    return pd.concat(parts, ignore_index=True)[["budget_id", "container_id", "position", "doc_id", "first_token", "n_tokens"]]


def pack(documents: DataFrame, budgets: DataFrame, vocabulary: str = tokenizer.DEFAULT_VOCABULARY, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """Where the tokens of each document go, for each row of ``budgets(budget_id, capacity_tokens)``.

    One row for each stretch of a document in a container.  The text is read
    once; one shuffle brings sizes and terms in order, in which they are cut
    into shards of bounded size, for all budgets at once.  ``budgets`` is a
    parameter table, which the driver reads, and refuses if it is large.
    """
    rows = budgets.select("budget_id", "capacity_tokens").limit(MOST_BUDGETS + 1).collect()
    if len(rows) > MOST_BUDGETS:
        raise ValueError(f"more than {MOST_BUDGETS} budgets")
    caps = [(r.budget_id, r.capacity_tokens) for r in rows if r.capacity_tokens and r.capacity_tokens > 0]
    every = checkpointed(sized(documents, vocabulary))
    n, chars = every.agg(F.count(F.lit(1)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    shards = max(1, -(-n // shard_documents), -(-chars // SHARD_CHARS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[int, int] = {}
        for pdf in _shards(batches, 2 * shard_documents, 2 * SHARD_CHARS):
            # containers of a partition are numbered above its own number
            first = first or {b: int(pdf["part"].iat[0]) << 40 for b, _ in caps}
            pdf = pdf.sort_values("doc_id", kind="stable")
            if caps:
                yield pack_shard(first, pdf["doc_id"].to_numpy(), pdf["size"].to_numpy(), pdf["terms"].tolist(), pdf["tf"].tolist(), caps)

    near = every.repartitionByRange(shards, "near", "doc_id").sortWithinPartitions("near", "doc_id")
    return near.withColumn("part", F.spark_partition_id()).mapInPandas(run, SCHEMA)


def _shards(batches: Iterator[pd.DataFrame], documents: int, chars: int) -> Iterator[pd.DataFrame]:
    """The rows of a partition, which has about as many as a shard should have, in parts that never have more than twice that."""
    held: list[pd.DataFrame] = []
    count = size = 0
    for pdf in batches:
        start = 0
        sizes = pdf["chars"].tolist()
        for k, c in enumerate(sizes):
            if count and (count >= documents or size + c > chars):
                yield pd.concat([*held, pdf.iloc[start:k]], ignore_index=True)
                held, start, count, size = [], k, 0, 0
            count, size = count + 1, size + c
        held.append(pdf.iloc[start:])
    if count:
        yield pd.concat(held, ignore_index=True)
