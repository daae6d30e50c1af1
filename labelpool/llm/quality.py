"""Quality classifier: histogram gradient-boosted trees over text statistics.

``text_statistics`` turns each whole text into a fixed row of figures, read
from its bytes in array operations. ``fit_quality`` learns trees from a bounded
sample of labelled rows; ``score_quality`` walks the flattened trees with numpy
for every document, in Arrow batches.

Defined results: a null text counts as empty; an empty text has all-zero
statistics and gets the score that the trees give those. Labels that are null
or neither 0 nor 1 take no part in the fit. Without usable labels the score is
0.5 for every text, with a single class it is that class's smoothed share. A
document with several labels counts once for each. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from labelpool.llm.batches import bounded_batches, byte_codes, mix64, segment_hashes, text_slices, words_of

MAX_FIT_ROWS = 32_768   # labelled rows that a fit takes at most

# byte classes: 0 lower, 1 upper, 2 digit, 3 space, 4 line feed, 5 sentence
# mark, 6 other punctuation, 7 bytes of non-ASCII characters, 8 control
_CLASS = np.full(256, 6, dtype=np.uint8)
_CLASS[:32] = 8
_CLASS[127] = 8
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5
_CLASS[128:] = 7
_GAP = np.zeros(256, dtype=bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LINE_GAP = np.zeros(256, dtype=bool)
_LINE_GAP[[10, 13]] = True
_CODES = byte_codes(fold_case=True)

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "lower", "upper", "digit", "space", "line_feed",
    "sentence_mark", "punctuation", "non_ascii", "control", "words_marked", "words_upper", "words_digit",
    "words_bare", "unique_words", "unique_grams", "top_word", "line_words", "unique_lines", "long_word",
]


def _share_distinct(doc: np.ndarray, keys: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys over keys, and the most frequent key's share, by document."""
    distinct, top = np.zeros(n_docs), np.zeros(n_docs)
    count = np.bincount(doc, minlength=n_docs)
    if len(doc):
        bits = np.uint64(max(n_docs - 1, 1).bit_length())
        key = np.sort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (keys >> bits))
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        runs = np.diff(np.append(at, len(key)))
        owner = (key[at] >> (np.uint64(64) - bits)).astype(np.int64)
        distinct = np.bincount(owner, minlength=n_docs).astype(float)
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        top[owner[first]] = np.maximum.reduceat(runs, first)
    has = np.maximum(count, 1)
    return distinct / has, top / has


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text of a slice of whole texts."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, len(STATISTICS)), dtype=np.float32)
    if len(data) == 0:
        return out
    kinds = _CLASS[data]
    owner = np.repeat(np.arange(n), size)
    by_kind = np.bincount(owner * 9 + kinds, minlength=9 * n).reshape(n, 9)
    share = by_kind / np.maximum(size, 1)[:, None]
    starts, lengths, doc = words_of(data, offsets, _GAP)
    n_words = np.bincount(doc, minlength=n)
    has = np.maximum(n_words, 1)
    mean = np.bincount(doc, weights=lengths, minlength=n) / has
    spread = np.sqrt(np.maximum(np.bincount(doc, weights=lengths.astype(float) ** 2, minlength=n) / has - mean ** 2, 0))
    odd, upper, digit, lower = (np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int32)]) for k in (6, 1, 2, 0))
    within = lambda total: total[starts + lengths] - total[starts]
    marked, uppers, digits = within(odd), within(upper), within(digit)
    part = lambda flag: np.bincount(doc[flag], minlength=n) / has
    hashes = segment_hashes(_CODES[data], starts, lengths)
    unique, top = _share_distinct(doc, hashes, n)
    grams = np.zeros(n)
    if len(hashes) >= 3:
        together = doc[2:] == doc[:-2]
        mixed = mix64(hashes[:-2] * np.uint64(3) + mix64(hashes[1:-1] * np.uint64(5) + mix64(hashes[2:])))
        grams, _ = _share_distinct(doc[2:][together], mixed[together], n)
    line_at, line_len, line_doc = words_of(data, offsets, _LINE_GAP)
    n_lines = np.bincount(line_doc, minlength=n)
    lines, _ = _share_distinct(line_doc, segment_hashes(_CODES[data], line_at, line_len), n)
    figures = [
        np.log1p(size), np.log1p(n_words), mean, spread, *(share[:, k] for k in range(9)),
        part(marked > 0), part((uppers > 1) & (within(lower) == 0)), part(digits > 0), part(marked == lengths),
        unique, grams, top, np.log1p(n_words / np.maximum(n_lines, 1)), lines, part(lengths > 20),
    ]
    for k, x in enumerate(figures):
        out[:, k] = x
    return out


@dataclass(frozen=True)
class Trees:
    """Perfect binary trees as arrays: of node i, the children are 2i+1, 2i+2."""

    feature: np.ndarray    # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); a row goes right if above
    leaf: np.ndarray       # (trees, leaves)
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of figures."""
        total = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        inner = self.feature.shape[1]
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(rows), dtype=np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (rows[at_row, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit_trees(rows: np.ndarray, label: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
              bins: int = 64, l2: float = 2.0, least: int = 8) -> Trees:
    """Boost trees on the logistic loss with per-node histograms of gradients.

    Cuts are the quantiles of each figure over the fit's rows. A node that no
    cut improves, or with under ``least`` rows to a side, sends all rows left.
    """
    inner, leaves = 2 ** depth - 1, 2 ** depth
    share = (label.sum() + 0.5) / (len(label) + 1) if len(label) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(label) < 2 * least or label.min() == label.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - label, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, k = 2 ** level - 1, 2 ** level
            local = node - first
            best = np.zeros(k)
            parent = np.bincount(local, grad, k) ** 2 / (np.bincount(local, hess, k) + l2)
            cut_bin = np.full(k, bins)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                key = local * bins + binned[:, f]
                g, h, c = (np.bincount(key, w, k * bins).reshape(k, bins).cumsum(axis=1) for w in (grad, hess, None))
                gl, hl, cl = g[:, :-1], h[:, :-1], c[:, :-1]
                gr, hr, cr = g[:, -1:] - gl, h[:, -1:] - hl, c[:, -1:] - cl
                gain = np.where((cl >= least) & (cr >= least), gl ** 2 / (hl + l2) + gr ** 2 / (hr + l2), -1) - parent[:, None]
                gain = gain[:, :len(cuts[f])]
                at = gain.argmax(axis=1)
                top = gain[np.arange(k), at]
                better = top > best + 1e-9
                best[better] = top[better]
                feature[first:first + k][better] = f
                cut_bin[better] = at[better]
                threshold[first:first + k][better] = cuts[f][at[better]]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut_bin[local])
        at = node - inner
        leaf = -rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + l2)
        raw += leaf[at]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", max_rows: int = MAX_FIT_ROWS) -> Trees:
    """Fit trees on the statistics of the labelled documents.

    At most about ``max_rows`` labelled rows take part, chosen by a hash of
    the id, so the broadcast labels and what the driver gets are bounded.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
    n = usable.count()
    if n > max_rows:
        usable = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(usable), "_id")

    def figures(batches):
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column("_text")):
                yield pa.RecordBatch.from_arrays(
                    [b.column("_label").slice(lo, hi - lo), pa.array(text_statistics(data, offsets).tolist(), pa.list_(pa.float32()))],
                    names=["label", "figures"])

    got = rows.select("_label", "_text").mapInArrow(figures, "label int, figures array<float>").toArrow()
    label_values = got.column("label").to_numpy().astype(float)
    figure_rows = np.array(got.column("figures").to_pylist(), dtype=np.float32).reshape(-1, len(STATISTICS))
    order = np.lexsort((*figure_rows.T, label_values))  # the same trees however Spark orders the rows
    return fit_trees(figure_rows[order], label_values[order])


def score_quality(docs: DataFrame, trees: Trees, text_col: str = "text", out: str = "score") -> DataFrame:
    """Every document with its columns and the trees' probability in ``out``."""
    bounded_batches(docs.sparkSession)
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def scored(batches):
        for b in batches:
            parts = [trees.score(text_statistics(data, offsets)) for _, _, data, offsets in text_slices(b.column(text_col))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score, pa.float64())], names=[*names, out])

    return docs.mapInArrow(scored, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, keep_at: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    A row is held out of the fit if crc32 of its doc_id as text is divisible
    by ``folds``; the id decides nothing else. A null doc_id is not held out.
    """
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    trees = fit_quality(docs, labels.filter(remainder != 0))
    return score_quality(docs.select("doc_id", "text"), trees).select(
        "doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= keep_at).cast("int").alias("predicted"))
