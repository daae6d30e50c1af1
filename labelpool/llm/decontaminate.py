"""Benchmark decontamination by winnowing, in DataFrame operations only.

Words are the maximal runs of characters other than ASCII ones outside a-z and
0-9, after A-Z are lower-cased. Of every ``window`` consecutive words, winnowing
keeps the smallest of the hashes of its ``gram``-word grams, so two texts that
share ``window`` words share a kept hash. Kept hashes of documents and items are
joined; each hit is extended along its diagonal by comparing words, and runs of
at least ``window`` equal words are the result. An item with fewer words is
looked for whole: for each such length that occurs, documents also give the
hashes of all their grams of that length.

Defined results: null and word-less texts have no words and are never hit; items
without words or without an id take no part; items with equal words are compared
once and all their ids are reported; an item_id that occurs with several texts
counts once. Rows of documents that are repeated, or share a doc_id, are judged
row by row (by id and text). An empty benchmark leaves every document clean.
Other columns of either table are neither read nor in the way.

The join is left to Spark's own size check: a small benchmark is broadcast, a
larger one is joined by shuffle, where AQE splits a hash that many documents hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 10
GRAM = 5
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(_WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _range(count: Column) -> Column:
    """0 .. count - 1; empty where count is not positive."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, length: int, tag: int) -> Column:
    return F.transform(_range(F.size(hashes) - (length - 1)),
                       lambda i: F.xxhash64(*(F.get(hashes, i + j) for j in range(length)), F.lit(tag)))


def _kept(grams: Column, span: int, step: int) -> Column:
    """(pos, hash) of the grams that are smallest in some run of ``span``.

    Of equal grams in a row, which are one word said over and over, the first and the last
    stay, and those at multiples of ``step`` (0: no others)."""
    def select(lows: Column) -> Column:
        # the largest of the lows of the runs that hold position i
        top = lambda i: F.greatest(*(F.get(lows, F.greatest(F.lit(0), F.least(i - j, F.size(lows) - 1))) for j in range(span)))
        return F.filter(F.transform(_range(F.when(F.size(lows) > 0, F.size(grams)).otherwise(0)), lambda i: F.when(
            (F.get(grams, i) == top(i)) & ~_between_equals(grams, i, step), F.struct(i.alias("pos"), F.get(grams, i).alias("hash")))), lambda x: x.isNotNull())

    lows = F.transform(_range(F.size(grams) - (span - 1)),
                       lambda i: F.least(*(F.get(grams, i + j) for j in range(span))))
    return _let(lows, select)


def _between_equals(grams: Column, i: Column, step: int) -> Column:
    same = lambda j: F.coalesce(F.get(grams, j) == F.get(grams, i), F.lit(False))
    inner = same(i - 1) & same(i + 1)
    return inner & (i % step != 0) if step else inner


def fingerprints(words: Column, window: int, gram: int, short: list[int], step: int) -> Column:
    """Kept (pos, hash) of a word list, and those of all grams of ``short`` lengths."""
    def of(hashes: Column) -> Column:
        parts = [_let(_grams(hashes, gram, 0), lambda g: _kept(g, window - gram + 1, step))]
        parts += [_let(_grams(hashes, n, n), lambda g: F.transform(g, lambda x, i: F.struct(i.alias("pos"), x.alias("hash")))) for n in short]
        return F.concat(*parts)

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def benchmark_items(bench: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct word lists of the items, with the ids that have them."""
    return (bench.filter(F.col(item_id).isNotNull())
            .select(F.col(item_id).cast("string").alias("id"), word_list(F.col(text)).alias("item_words"))
            .filter(F.size("item_words") > 0)
            .groupBy("item_words").agg(F.collect_set("id").alias("ids"))
            .withColumn("item", F.xxhash64("item_words")).withColumn("m", F.size("item_words")))


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The contaminated documents: id, text_key, spans (start, end in words,
    end exclusive, merged count in n_hit) and the item ids with occurring windows.

    ``text_key`` is the text's xxhash64, so that rows with one id but several
    texts stay apart.
    """
    items = benchmark_items(bench, item_id, item_text)
    short = sorted(r[0] for r in items.filter(F.col("m") < window).select("m").distinct().collect())  # under `window` numbers
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("_text"))
    marks = rows.select("id", "text_key", F.explode(fingerprints(word_list(F.col("_text")), window, gram, short, window)).alias("f")) \
        .select("id", "text_key", F.col("f.pos").alias("pos"), F.col("f.hash").alias("hash"))
    long_marks = items.filter(F.col("m") >= window).select("item", "m", F.explode(fingerprints(F.col("item_words"), window, gram, [], 0)).alias("f"))
    marked = [long_marks] + [items.filter(F.col("m") == n).select("item", "m", F.explode(F.filter(
        fingerprints(F.col("item_words"), window, gram, [n], 0), lambda x: x.pos == 0)).alias("f")) for n in short]
    test = marked[0]
    for more in marked[1:]:
        test = test.unionByName(more)
    test = test.select("item", "m", F.col("f.pos").alias("item_pos"), F.col("f.hash").alias("hash"))

    hits = marks.join(test, "hash").select("id", "text_key", "item", "m", (F.col("pos") - F.col("item_pos")).alias("diagonal"))
    per_doc = hits.groupBy("id", "text_key").agg(F.collect_set(F.struct("item", "m", "diagonal")).alias("found"))

    # extend: cut the document's words along each diagonal and compare them with the item's
    aligned = rows.alias("d").join(per_doc.alias("p"), F.col("d.id").eqNullSafe(F.col("p.id")) & (F.col("d.text_key") == F.col("p.text_key")))
    one_each = aligned.select("d.id", "d.text_key", "found", word_list(F.col("d._text")).alias("words")).dropDuplicates(["id", "text_key"])
    cut = one_each.select("id", "text_key", F.explode(F.transform("found", lambda f: F.struct(
        f.item.alias("item"), f.m.alias("m"), F.greatest(f.diagonal, F.lit(0)).alias("at"), F.greatest(-f.diagonal, F.lit(0)).alias("skip"),
        F.slice("words", F.greatest(f.diagonal, F.lit(0)) + 1,
                F.greatest(F.lit(0), F.least(f.m, F.size("words") - f.diagonal) - F.greatest(-f.diagonal, F.lit(0)))).alias("part")))).alias("c")) \
        .select("id", "text_key", "c.*")
    # the stretches of equal words that hold a window; the mask is made once, wherever the optimiser moves this
    equal = F.array_join(F.transform("part", lambda w, j: F.when(w == F.get("item_words", j + F.col("skip")), "1").otherwise("0")), "")
    least = F.least("m", F.lit(window))
    begins = lambda mask: F.filter(_range(F.length(mask) - least + 1), lambda s: (
        ((s == 0) | (mask.substr(s, F.lit(1)) == "0")) & (mask.substr(s + 1, least) == F.repeat(F.lit("1"), least))))
    stretches = _let(equal, lambda mask: F.transform(begins(mask), lambda s: F.struct(
        (F.col("at") + s).alias("start"), (F.col("at") + s + F.length(F.regexp_extract(mask.substr(s + 1, F.length(mask)), "^1+", 0))).alias("end"))))
    spans = cut.join(items.select("item", "item_words", "ids"), "item").select("id", "text_key", "ids", stretches.alias("spans")) \
        .filter(F.size("spans") > 0)
    return (spans.groupBy("id", "text_key")
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"))
            .withColumn("n_hit", F.expr(
                "aggregate(spans, named_struct('n', 0L, 'upto', 0), (a, x) -> named_struct("
                "'n', a.n + greatest(0, x.end - greatest(x.start, a.upto)), 'upto', greatest(a.upto, x.end))).n")))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no window of any item, columns unchanged."""
    bad = contamination(docs, bench, id_col=id_col, text_col=text_col).select(F.col("id").alias("_bad_id"), F.col("text_key").alias("_bad_key"))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs[text_col]) == bad["_bad_key"]), "left_anti")


def contamination_report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """One row per document: words, hit words, and a digest of the items found."""
    found = contamination(docs, bench)
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(word_list(F.col("text"))).cast("long").alias("n_words"))
    joined = base.join(found.select(F.col("id").alias("_id"), F.col("text_key").alias("_key"), "n_hit", "items"),
                       F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                         F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
