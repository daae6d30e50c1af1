"""Periodic runs of words, by suffix trees with constant-time common extensions.

A run is a stretch of consecutive words with smallest period q, of at least
``max(min_words, 2 * q)`` words, that no neighbouring word extends keeping period q.
For each text:

* Ukkonen's algorithm builds the suffix tree of its words and that of its words in
  reverse order.
* The Euler tour of a tree, kept as the depth of its shallowest node between two
  neighbouring leaves, under a table of range minima gives the lowest common ancestor of
  two leaves, and so the longest common extension of two places, in constant time:
  forwards from one tree, backwards from the other.
* The tour's order of the leaves is the order of the suffixes. The next smaller suffix,
  and the next greater one, end the longest Lyndon words that begin at a place, for the
  order of the words and its reverse. Every run holds one of them as a root of its period.
* Each such root is extended in both directions; stretches of two periods or more are
  the runs, each once.

A run of ``min_words`` or more words repeats some ``min_words // 2`` consecutive words
within itself, so texts in which no so many words occur twice have none, and no trees are
built for them. This compares hashes; equal hashes only cost the trees.

The work is done text by text inside ``mapInArrow``, without a shuffle, so neither hot
sources nor copies matter. Memory grows with the longest text of a batch: about 1 kB a word
while its trees are built.

Defined results: a null or empty text has no words, no runs and the digest of nothing;
repeated rows are each reported; of equally long runs the first counts, then the one with
the smaller period; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelpool.llm.batches import bounded_batches

MIN_WORDS = 12
Run = tuple[int, int, int]   # start, length, period


class SuffixTree:
    """Ukkonen's suffix tree of ``symbols`` (1, 2, ...), closed by a smallest symbol 0.

    ``rank`` is the place of each suffix in their order; ``extension`` gives the number
    of common symbols from two places on.
    """

    def __init__(self, symbols: list[int], n_symbols: int):
        text = symbols + [0]
        width = n_symbols + 1
        edges, depth, suffix_of = _ukkonen(text, width)
        self.n = len(symbols)
        self._tour(text, edges, np.array(depth), np.array(suffix_of), width)

    def _tour(self, text: list[int], edges: dict[int, int], depth: np.ndarray, suffix_of: np.ndarray, width: int) -> None:
        """Walk the tree in the order of the symbols."""
        n_nodes = len(depth)
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        child = np.fromiter(edges.values(), np.int64, len(edges))
        order = np.argsort(keys)
        keys, child = keys[order], child[order]
        parent = keys // width
        begin = np.searchsorted(parent, np.arange(n_nodes + 1))
        # between a child that isn't its parent's first and the leaf before it, the tour climbs to the parent
        climbs = np.full(n_nodes, -1, np.int64)
        later = np.flatnonzero(parent[1:] == parent[:-1]) + 1
        climbs[child[later]] = depth[parent[later]]
        children, lo, hi = child[::-1].tolist(), (len(child) - begin[1:]).tolist(), (len(child) - begin[:-1]).tolist()
        visited: list[int] = []
        stack = [0]
        while stack:
            node = stack.pop()
            visited.append(node)
            stack += children[lo[node]:hi[node]]
        tour = np.array(visited)
        climb = climbs[tour]
        last = np.maximum.accumulate(np.where(climb >= 0, np.arange(len(tour)), 0))
        at = np.flatnonzero(suffix_of[tour] >= 0)
        leaves = suffix_of[tour[at]]
        shallow = climb[last[at]]
        shallow[0] = 0
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        self.minima = [shallow.astype(np.int32)]
        step = 1
        while 2 * step <= len(shallow):
            before = self.minima[-1]
            self.minima.append(np.minimum(before[:-step], before[step:]))
            step *= 2

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common symbols from the places ``a`` and from ``b`` (a != b) on: the depth of
        the two leaves' lowest common ancestor."""
        lo, hi = self.rank[a], self.rank[b]
        lo, hi = np.minimum(lo, hi) + 1, np.maximum(lo, hi)
        out = np.empty(len(lo), np.int64)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            of = np.flatnonzero(level == k)
            table = self.minima[k]
            out[of] = np.minimum(table[lo[of]], table[hi[of] + 1 - (1 << k)])
        return out


def _ukkonen(text: list[int], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Edges ``node * width + first symbol -> node``, the depth of every inner node, and
    the suffix of every leaf (-1 for inner nodes). The root is node 0."""
    n = len(text)
    edges: dict[int, int] = {}
    first, end, link, depth, suffix_of = [0], [0], [0], [0], [-1]
    node = at = length = pending = suffix = 0   # pending: suffixes to insert; suffix: the next one
    for i, symbol in enumerate(text):
        pending += 1
        unlinked = 0
        while pending:
            if not length:
                at = i
            key = node * width + text[at]
            below = edges.get(key)
            if below is None:
                edges[key] = len(first)
                if unlinked:
                    link[unlinked] = node
                    unlinked = 0
            else:
                size = (i + 1 if end[below] > i else end[below]) - first[below]
                if length >= size:
                    at += size
                    length -= size
                    node = below
                    continue
                if text[first[below] + length] == symbol:
                    length += 1
                    if unlinked:
                        link[unlinked] = node
                    break
                middle = len(first)
                start = first[below]
                first.append(start)
                end.append(start + length)
                link.append(0)
                depth.append(pending - 1)
                suffix_of.append(-1)
                edges[key] = middle
                first[below] = start + length
                edges[middle * width + text[start + length]] = below
                edges[middle * width + symbol] = middle + 1
                if unlinked:
                    link[unlinked] = middle
                unlinked = middle
            first.append(i)
            end.append(n)
            link.append(0)
            depth.append(0)
            suffix_of.append(suffix)
            suffix += 1
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - pending + 1
    return edges, depth, suffix_of


def _next_below(values: list[int]) -> list[int]:
    """The next place of a smaller value, else the length."""
    n = len(values)
    out = [n] * n
    for i in range(n - 2, -1, -1):
        j, v = i + 1, values[i]
        while j < n and values[j] >= v:
            j = out[j]
        out[i] = j
    return out


def find_runs(words: list, min_words: int = MIN_WORDS) -> list[Run]:
    """All runs of a sequence of hashable words, by start, then period."""
    n = len(words)
    if n < max(min_words, 2):
        return []
    number: dict = {}
    symbols = [number.setdefault(w, len(number) + 1) for w in words]
    forward = SuffixTree(symbols, len(number))
    backward = SuffixTree(symbols[::-1], len(number))
    rank = forward.rank[:n]
    place = np.arange(n)
    smaller = np.array(_next_below(rank.tolist()))          # n: the empty suffix is the smallest
    greater = np.array(_next_below((-rank).tolist()))
    start = np.concatenate([place, place[greater < n]])
    nxt = np.concatenate([smaller, greater[greater < n]])
    return _extended(start, nxt, forward, backward, min_words)


def _extended(start: np.ndarray, nxt: np.ndarray, forward: SuffixTree, backward: SuffixTree, min_words: int) -> list[Run]:
    """The runs whose root is one of ``[start, nxt)``."""
    n = forward.n
    period = nxt - start
    right = np.zeros(len(start), np.int64)
    inside = np.flatnonzero(nxt < n)
    right[inside] = forward.extension(start[inside], nxt[inside])
    left = np.zeros(len(start), np.int64)
    inside = np.flatnonzero(start > 0)
    left[inside] = backward.extension(n - start[inside], n - nxt[inside])
    length = left + period + right
    keep = length >= np.maximum(2 * period, min_words)
    found = np.stack([(start - left)[keep], period[keep], length[keep]], axis=1)
    return [(s, m, q) for s, q, m in np.unique(found, axis=0).tolist()]


_GRAM_CODES = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ** 9 | 1) & (1 << 64) - 1 for k in range(64)], np.uint64)


def may_repeat(words: list, min_words: int = MIN_WORDS) -> bool:
    """False only if no ``min_words // 2`` consecutive words occur twice, so that there is no run."""
    gram = max(1, min(min_words // 2, len(_GRAM_CODES)))
    n = len(words) - gram + 1
    if n < 2:
        return False
    codes = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = codes[:n] * _GRAM_CODES[0]
    for k in range(1, gram):
        sums += codes[k:n + k] * _GRAM_CODES[k]
    sums.sort()
    return bool((sums[1:] == sums[:-1]).any())


def kept_words(words: list, runs: list[Run]) -> list:
    """The words outside every run's repetition: a run's first period stays."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if not d]


_COLUMNS = {"n_words": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(),
            "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string()}
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in _COLUMNS.items())


def _row(words: list[bytes], runs: list[Run]) -> tuple:
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    longest = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    start, length, period = longest
    collapsed = b" ".join(kept_words(words, runs))
    return (len(words), len(runs), start, length, period, length and 1000 * length // period,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest(), runs, collapsed)


def run_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS,
               change: Callable[[object, list[bytes]], list[bytes]] | None = None, with_text: bool = False) -> DataFrame:
    """A row per row of ``docs``: id, number of words and runs, the longest run, and digests
    of the list of runs and of the text without repetitions.

    Words are separated by the six ASCII white-space characters. ``change(id, words)``, if
    given, replaces a text's words first. ``with_text`` adds the runs as ``runs`` and the
    text without repetitions as ``collapsed``.
    """
    bounded_batches(docs.sparkSession)
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_SCHEMA}"
    types = dict(_COLUMNS)
    if with_text:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
        types |= {"runs": _RUNS, "collapsed": pa.string()}

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = value.as_buffer().to_pybytes().split() if value.is_valid else []
                if change is not None:
                    words = change(key, words)
                rows.append(_row(words, find_runs(words, min_words) if may_repeat(words, min_words) else []))
            columns = [[r[k] for r in rows] for k in range(len(types))]
            if with_text:
                columns[-2] = [[dict(zip(("start", "length", "period"), run)) for run in runs] for runs in columns[-2]]
                columns[-1] = [c.decode() for c in columns[-1]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types.values())], names=[id_col, *types])

    return docs.select(F.col(id_col), F.col(text).cast("string")).mapInArrow(report, schema)


def periodic_tail(key: object, words: list[bytes]) -> list[bytes]:
    """The stated change of a tenth of the documents: with h = crc32 of the decimal id and
    g = h // 10, where h % 10 is 0 the words from a = g % n on repeat a period of
    1 + (n - a) // (3 + g % 8) words. A null id changes nothing."""
    n = len(words)
    if n == 0 or key is None:
        return words
    g, rest = divmod(zlib.crc32(str(key).encode()), 10)
    if rest:
        return words
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + period] * -(-(n - a) // period))[:n - a]
