"""Secret scans: fixed patterns and character Markov models, in DataFrame operations.

Base spans come from three patterns. Further spans come from two first-order
Markov models of characters, one of random strings and one of ordinary
identifiers: a token whose log-likelihood ratio speaks for the random model is a
span of kind ``markov``. The models are trained on labelled samples from all
documents: the values of the base spans and digests of tokens count as random,
tokens of the shape of joined words as ordinary; other tokens have no label.

Positions are code points of the whole text, end exclusive. Defined results: a
null or empty text has no spans; a table without tokens gives smoothed models
that flag nothing new; repeated rows and ids are judged row by row; markov spans
never overlap base spans: what a base span leaves of a token is a token of its own
if it is long enough. Finding spans costs time in proportion to a text's length (and
the sort of its spans). Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: the patterns, with what a match must have to count
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ["assign", "access", "hex", "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN_LEAST = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{TOKEN_LEAST},}}"
SMOOTHING = 8.0  # pairs' worth of weight that a character's own frequency has
# shapes that label a token as an ordinary identifier: words joined by case, _ or -, with up
# to three digits behind, or all capitals; a word takes all its letters, one after the other
JOINED_WORD, JOINED_CAPITALS, DIGITS_BEHIND = r"\G[_-]?[A-Z]?[a-z]{2,}+", r"\G[_-]?[A-Z]{2,}+", r"^[0-9]{0,3}$"
PER_CHAR = 0.8   # log-likelihood ratio a character that a span must reach
PART = 32        # matches of a text that are gathered at once
CUT = 1024       # characters of a text that are cut at once
SPAN_TYPE = "array<struct<start:int,kind:int,end:int,value:string>>"
MATCH, PLACE = "struct<start:int,end:int,value:string>", "struct<start:int,end:int>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often its lambdas use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _scan(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """``out(state, item)`` of each of at least one items, ``state`` being that before it.

    Spark copies an aggregate's state with each step, so results are gathered in blocks
    of PART items: first the state before each block, then the results within it."""
    def scanned(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(1), F.size(x), F.lit(PART)), lambda i: F.slice(x, i, PART))
        return _let(blocks, lambda parts: F.flatten(F.zip_with(parts, before(parts), within)))

    def before(parts: Column) -> Column:
        empty = F.struct(start.alias("state"), F.filter(F.array(start), lambda _: F.lit(False)).alias("all"))
        return F.aggregate(parts, empty, lambda acc, part: F.struct(
            F.aggregate(part, acc["state"], step).alias("state"), F.concat(acc["all"], F.array(acc["state"])).alias("all")), lambda acc: acc["all"])

    def within(part: Column, state: Column) -> Column:
        empty = F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("all"))
        return F.aggregate(part, empty, lambda acc, x: F.struct(
            step(acc["state"], x).alias("state"), F.concat(acc["all"], F.array(out(acc["state"], x))).alias("all")), lambda acc: acc["all"])

    return _let(items, scanned)


def _matches(text: Column, pattern: str, value_group: int) -> Column:
    """(start, end, value) of all matches: what lies between them gives the places."""
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    lengths = F.zip_with(between, whole, lambda gap, match: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(match), F.lit(0)).alias("match")))
    places = _scan(lengths, F.lit(0), lambda at, x: at + x["gap"] + x["match"],
                   lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["match"]).alias("end")), PLACE)
    found = F.zip_with(places, values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))
    return F.filter(found, lambda m: m["value"].isNotNull())     # the last part has no match behind it


def _kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Base spans of a text: array of (start, kind, end, value), in that order.

    A cheap test that any match must pass comes before each pattern."""
    none = F.array().cast(SPAN_TYPE)
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")
    assign = F.filter(_matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= LEAST_VALUE)
    access = F.filter(_matches(text, ACCESS, 0), lambda m: F.length(m["value"]) >= LEAST_ACCESS)
    # a maximal run is a match of its own, so shorter ones may be left out here already
    hexes = _matches(text, rf"[0-9a-f]{{{LEAST_HEX},}}", 0)
    return F.array_sort(F.concat(
        F.when(named, _kind(assign, 0)).otherwise(none),
        F.when(text.contains("AKIA"), _kind(access, 1)).otherwise(none),
        F.when(text.rlike(rf"[0-9a-f]{{{LEAST_HEX}}}"), _kind(hexes, 2)).otherwise(none)))


def free_tokens(text: Column, base: Column) -> Column:
    """(start, end, value) of the tokens, and of what base spans leave of one, of
    TOKEN_LEAST characters or more.

    Tokens and base spans are gone through once, by their starts. The state is the
    token, its start and end, and the place in it from which on it is free, which is
    not before the end of any base span so far; each next start ends a piece."""
    tokens = F.when(text.rlike(TOKEN), _matches(text, TOKEN, 0)).otherwise(F.array().cast(f"array<{MATCH}>"))
    state = lambda token, start, end, free, covered: F.struct(
        token.alias("token"), start.alias("start"), end.alias("end"), free.alias("free"), covered.alias("covered"))
    event = lambda start, token, end: F.struct(start.alias("start"), token.alias("token"), end.alias("end"))
    none, last = F.lit(2**31 - 1), F.lit(2**31 - 1)      # a base span is an event without a token

    def step(acc: Column, e: Column) -> Column:
        is_base = e["token"] == none
        covered = F.when(is_base, F.greatest(acc["covered"], e["end"])).otherwise(acc["covered"])
        kept = lambda name, new: F.when(is_base, acc[name]).otherwise(new)
        return state(kept("token", e["token"]), kept("start", e["start"]), kept("end", e["end"]), F.greatest(covered, kept("free", e["start"])), covered)

    def piece(acc: Column, e: Column) -> Column:
        return F.struct(acc["token"].alias("token"), acc["start"].alias("from"), acc["free"].alias("start"), F.least(e["start"], acc["end"]).alias("end"))

    def pieces(found: Column) -> Column:
        events = F.concat(F.transform(found, lambda t, i: event(t["start"], i, t["end"])), F.transform(base, lambda b: event(b["start"], none, b["end"])),
                          F.array(event(last, none, last)))
        cut = _scan(F.sort_array(events), state(*[F.lit(0)] * 5), step, piece, "struct<token:int,from:int,start:int,end:int>")
        long = F.filter(cut, lambda p: p["end"] - p["start"] >= TOKEN_LEAST)
        # tokens are ASCII, and bytes are cut without counting characters
        return _let(F.transform(found, lambda t: t["value"].cast("binary")), lambda values: F.transform(long, lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"),
            F.substr(F.get(values, p["token"]), p["start"] - p["from"] + 1, p["end"] - p["start"]).cast("string").alias("value"))))

    return F.when((F.size(base) == 0) | ~text.rlike(TOKEN), tokens).otherwise(_let(tokens, pieces))


def is_ordinary(token: Column) -> Column:
    """Whether a token has the shape of an identifier: its words, taken off one after the
    other from the beginning, leave nothing or a short number."""
    words, capitals = (F.regexp_replace(token, p, "") for p in (JOINED_WORD, JOINED_CAPITALS))
    return (words.rlike(DIGITS_BEHIND) & (words != token)) | ((capitals == "") & (token != ""))


def _scanned(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows with ``_text``, ``_base`` and ``_free``, each computed once."""
    return docs.withColumn("_text", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_base", base_spans(F.col("_text"))) \
        .withColumn("_free", free_tokens(F.col("_text"), F.col("_base")))


def fit_models(docs: DataFrame, text_col: str = "text") -> list[float]:
    """Log-likelihood ratio of each character pair, row by row of ALPHABET.

    The pairs of all labelled tokens of all documents are counted before the
    shuffle; 2 * 67**2 counts at most reach the driver."""
    rows = _scanned(docs.select(F.col(text_col).alias("text")), "text").select("_base", "_free")
    ordinary = rows.select(F.explode(F.transform(F.filter("_free", lambda t: is_ordinary(t["value"])), lambda t: t["value"])).alias("token")) \
        .withColumn("random", F.lit(0))
    secret = rows.select(F.explode(F.transform("_base", lambda b: b["value"])).alias("token")).withColumn("random", F.lit(1))
    made = ordinary.select(F.explode(F.array(F.md5("token"), F.base64(F.unhex(F.sha1("token"))))).alias("token"), F.lit(1).alias("random"))
    pairs = ordinary.unionByName(secret).unionByName(made).select("random", F.explode(F.expr(
        "transform(sequence(1, greatest(length(token) - 1, 1)), i -> substring(token, i, 2))")).alias("pair")).groupBy("random", "pair").count()
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = [[[0.0] * n for _ in range(n)] for _ in range(2)]
    for r in pairs.filter(F.length("pair") == 2).collect():
        if r.pair[0] in at and r.pair[1] in at:
            counts[r.random][at[r.pair[0]]][at[r.pair[1]]] += r["count"]

    def model(seen: list[list[float]]) -> list[float]:
        """Log of each pair's chance, smoothed by that of its second character."""
        single = [sum(row[b] for row in seen) + 0.5 for b in range(n)]
        chance = [x / sum(single) for x in single]
        return [math.log((row[b] + SMOOTHING * chance[b]) / (sum(row) + SMOOTHING)) for row in seen for b in range(n)]

    return [r - o for r, o in zip(model(counts[1]), model(counts[0]))]


def likelihood_ratio(token: Column, ratio: list[float]) -> Column:
    """Sum of the pairs' ratios over a token of ALPHABET characters."""
    table = F.split(F.lit(",".join(f"{x:.4f}" for x in ratio)), ",").cast("array<double>")
    codes = F.transform(F.regexp_extract_all(token, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    # each character with the one before it: the state holds the sum and the last code
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("last"))
    step = lambda acc, c: F.struct(F.when(acc["last"] < 0, 0.0).otherwise(acc["sum"] + F.get(table, acc["last"] * len(ALPHABET) + c)).alias("sum"), c.alias("last"))
    return F.aggregate(codes, start, step, lambda acc: acc["sum"])


def find_secrets(docs: DataFrame, ratio: list[float] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``_base`` and ``_spans`` (base and markov spans,
    sorted by start and kind)."""
    if ratio is None:
        ratio = fit_models(docs, text_col)
    secret = F.filter("_free", lambda t: likelihood_ratio(t["value"], ratio) >= PER_CHAR * (F.length(t["value"]) - 1))
    return _scanned(docs, text_col).withColumn("_spans", F.array_sort(F.concat("_base", _kind(secret, 3)))).drop("_free")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ratio: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of its text replaced; overlapping ones as one."""
    found = find_secrets(docs, ratio, text_col)
    end = F.lit(2**31 - 1)

    def gaps(spans: Column) -> Column:
        """What lies between the spans, and before and behind them; a span that begins
        in another one has no gap (null) and no mark of its own."""
        ends = F.concat(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))),
                        F.array(F.struct(F.length("_text").alias("start"), end.alias("end"))))
        found = _scan(ends, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.struct(at.alias("start"), s["start"].alias("end")), PLACE)
        return F.filter(found, lambda g: g["start"] <= g["end"])

    def cut(parts: Column) -> Column:
        """The gaps' text: each from the parts of CUT characters that hold it."""
        first = lambda g: F.floor(g["start"] / CUT).cast("int")
        held = lambda g: F.array_join(F.slice(parts, first(g) + 1, F.floor((g["end"] + CUT - 1) / CUT).cast("int") - first(g)), "")
        return F.transform(gaps(F.col("_spans")), lambda g: F.when(g["end"] > g["start"], F.substr(
            held(g), g["start"] - first(g) * CUT + 1, g["end"] - g["start"])).otherwise(""))

    clean = F.array_join(_let(F.regexp_extract_all("_text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), cut), mark)
    return found.withColumn(text_col, F.when(F.size("_spans") > 0, clean).otherwise(F.col(text_col))).drop("_text", "_base", "_spans")


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row per document: counts and a digest of base spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(_joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"))
