"""Periodic runs, chat formatting and whitening against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle_compare
from conftest import SF_SMALL
from labelpool.llm import chat_format, queries, whiten, word_runs
from labelpool.llm.spectral import polar_unitary, symmetric_components


# ------------------------------------------------------------ periodic runs
def brute_runs(words, least=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, 2 * q):
                part = words[i:i + length]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rnd):
    n, k = rnd.randint(0, 60), rnd.choice([1, 2, 3, 6])
    words = [b"w%d" % rnd.randrange(k) for _ in range(n)]
    if n > 5 and rnd.random() < 0.4:
        a = rnd.randrange(n)
        p = 1 + (n - a) // rnd.randint(2, 6)
        words = words[:a] + (words[a:a + p] * n)[:n - a]
    return words


def test_runs_match_brute_force():
    rnd = random.Random(5)
    for _ in range(1500):
        words = random_words(rnd)
        for least in (2, 5, 12):
            want = brute_runs(words, least)
            assert word_runs.find_runs(words, least) == want
            assert word_runs.may_repeat(words, least) or not want


def test_common_extensions_match_brute_force():
    rnd = random.Random(6)
    for _ in range(200):
        s = [rnd.randint(1, 3) for _ in range(rnd.randint(2, 40))]
        tree = word_runs.SuffixTree(s, 3)
        assert tree.rank.tolist() == np.argsort(sorted(range(len(s) + 1), key=lambda i: s[i:])).tolist()
        a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]))
        got = tree.extension(a, b)
        for i, j, e in zip(a.tolist(), b.tolist(), got.tolist()):
            want = 0
            while max(i, j) + want < len(s) and s[i + want] == s[j + want]:
                want += 1
            assert e == want


def test_long_texts_of_one_word_or_period():
    assert word_runs.find_runs([b"x"] * 50_000) == [(0, 50_000, 1)]
    block = [b"%d" % i for i in range(5_000)]
    assert word_runs.find_runs([b"a"] + block * 4 + [b"b"]) == [(1, 20_000, 5_000)]


def _brute_report(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            digest("".join("%d,%d,%d\n" % r for r in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def _sorted(rows):
    return sorted(rows, key=repr)


def test_run_report_of_odd_rows(spark):
    rnd = random.Random(7)
    rows = [(None, None), (None, " "), (3, ""), (4, "\x0b\x0c\u00a0 one\ttwo\r\n\x1cthree"), (5, "same " * 30), (5, "same " * 30), (-7, "a b " * 400)]
    rows += [(10 + i, rnd.choice([" ", "\n", " \t "]).join(w.decode() for w in random_words(rnd))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).withColumn("start", F.lit(1)).repartition(3)
    got = word_runs.run_report(docs, change=word_runs.periodic_tail)
    assert _sorted(tuple(r[c] for c in RUN_COLUMNS) for r in got.collect()) == _sorted(_brute_report(*r) for r in rows)
    assert word_runs.run_report(docs.limit(0)).count() == 0
    full = word_runs.run_report(docs.filter("doc_id = 5"), with_text=True).first()
    assert full.collapsed == "same" and [tuple(r) for r in full.runs] == [(0, 30, 1)]


def test_run_query_on_a_table(spark):
    docs = [r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 3000]
    got = {r.doc_id: tuple(r[c] for c in RUN_COLUMNS) for r in queries.op11_periodic_runs(spark, SF_SMALL).collect()}
    assert len(docs) > 100 and all(got[d.doc_id] == _brute_report(*d) for d in docs)
    assert sum(r[1] > 0 for r in got.values()) > 10


# ------------------------------------------------------------ chat formatting
ODD = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s>", "[\\INST] [\\\\/INST]", "<<SYS>>x<</SYS>>", "<\\</SYS>>", "<<ROLE>>user<</ROLE>><<TEXT>>t<</TEXT>>",
       "", " ", "\n", "<", "[", "<<", "<\\", "[/", "plain", "\u00e9\U0001f600\x00\\", "$1 \\$2", "</S> [inst] < s>"]


def _parse(text):
    """A parser of the grammar of its own: reads one turn after the other."""
    control = re.compile(r"</?s>|\[/?INST\]|<</?(?:SYS|ROLE|TEXT)>>")
    plain = lambda t: re.sub(r"<\\(?=\\*(?:/?s>|</?(?:SYS|ROLE|TEXT)>>))|\[\\(?=\\*/?INST\])", lambda m: m.group()[0], t)
    turns, at = [], 0

    def body(opening, closing):
        nonlocal at
        assert text.startswith(opening, at)
        end = control.search(text, at + len(opening))
        assert end and end.group() == closing
        out, at = text[at + len(opening):end.start()], end.end()
        return plain(out)

    while at < len(text):
        for role, pair in (("system", ("<<SYS>>", "<</SYS>>")), ("user", ("[INST]", "[/INST]")), ("assistant", ("<s>", "</s>"))):
            if text.startswith(pair[0], at):
                turns.append((role, body(*pair)))
                break
        else:
            turns.append((body("<<ROLE>>", "<</ROLE>>"), body("<<TEXT>>", "<</TEXT>>")))
    return turns


def test_every_text_reads_back(spark):
    rnd = random.Random(8)
    roles = ["user", "assistant", "system", "tool", None, "", "a <s> b", "<<ROLE>>", "<\\s>", "User\n"]
    rows = [(c, t, rnd.choice(roles), rnd.choice([None, *ODD]) if rnd.random() < 0.5 else "".join(rnd.choices([*ODD, "<", "/", "s>", "\\", "INST]", "["], k=5)))
            for c in range(150) for t in range(rnd.randint(1, 6))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (900, 1, "user", "b"), (900, 1, "user", "a"), (900, 1, "user", "a"),
             (901, 0, "assistant", "[INST] long </s> " * 40_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2)).repartition(3)
    source = {}
    for c, t, r, x in rows:
        source.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    got = chat_format.read_back(chat_format.format_conversations(df)).collect()
    assert len(got) == len(source)
    for r in got:
        want = [(role, text) for _, role, text in sorted(source[r.conv_id])]
        assert _parse(r.formatted) == want == [(t.role, t.text) for t in r.turns]
        assert r.learned == [text for role, text in want if role == "assistant"]
        assert "".join(s.text for s in r.segments) == r.formatted
        harmless = sum(not re.search(r"<\\*(/?s>|</?(SYS|ROLE|TEXT)>>)|\[\\*/?INST\]", text) for _, text in want)
        assert r.n_escaped >= len(want) - harmless
    assert chat_format.chat_report(df.limit(0)).count() == 0


def test_parser_refuses_what_is_not_in_the_grammar(spark):
    bad = ["x", "[INST]a", "[INST]a</s>", "<s>a</s> <s>b</s>", "<s>a<s>b</s></s>", "<<TEXT>>a<</TEXT>>", "<<ROLE>>a<</ROLE>>",
           "<<ROLE>>a<</ROLE>><s>b</s>", "<<ROLE>>a<</ROLE>>x<<TEXT>>b<</TEXT>>", "<s>a</s>\n", "</s>a<s>"]
    df = spark.createDataFrame([(t,) for t in [*bad, "", "<s></s>"]], "t string")
    out = chat_format.with_turns(df, "t", "turns").collect()
    assert [r.t for r in out if r.turns is not None] == ["", "<s></s>"]


def test_chat_query_matches_sql(spark):
    ok, n, _, detail = oracle_compare.compare(spark, "op12_chat_format", queries.op12_chat_format, queries.ORACLES["op12_chat_format"], SF_SMALL)
    assert ok, detail
    odd = queries.op12_chat_format(spark, SF_SMALL).filter("conv_id = -7").first()
    assert (odd.n_turns, odd.loss_chars, odd.n_escaped) == (2, 21, 2)


# ------------------------------------------------------------ whitening
def test_components_of_odd_matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 40):
        g = rng.standard_normal((n, n))
        q, _ = np.linalg.qr(g)
        for a in (g @ g.T, (q * 10.0 ** -np.linspace(0, 14, n)) @ q.T, (q * np.repeat([5.0, 1.0], [n // 2, n - n // 2])) @ q.T,
                  np.eye(n), np.zeros((n, n)), np.outer(g[0], g[0])):
            values, vectors = symmetric_components(a)
            size = max(np.linalg.norm(a), 1e-300)
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size)
            assert np.linalg.norm(a @ vectors - vectors * values) <= 1e-13 * size
            assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-13)
    sign = polar_unitary(np.diag([3.0, -1e-9, 2.0]))
    assert np.allclose(sign, np.diag([1.0, -1.0, 1.0]))


def _check_whitening(rows, got, width):
    used = [(i, [float(c) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in used])
    n, sums = len(x), x.sum(axis=0)
    covariance = np.atleast_2d(np.cov(x.T.astype(float), bias=True))
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, width)
    assert len(got) == n * k
    deviation = sorted((i, sum((n * int(c) - int(s)) ** 2 for c, s in zip(v, sums))) for (i, _), v in zip(used, x))
    assert sorted((r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    white = (x - x.mean(axis=0)) @ vectors[:, :k] / np.sqrt(np.maximum(values[:k], 1e-300))
    for j in range(k):
        mine = {r.vec_id: r for r in got if r.component == j + 1}
        assert all(r.n == n and abs(r.explained - values[j] / values.sum()) < 1e-9 for r in mine.values())
        if values[j] > 1e-6 * values[0]:
            sign = np.sign(sum(mine[i].whitened * w for (i, _), w in zip(used, white[:, j])))
            assert all(abs(mine[i].whitened - sign * w) < 1e-6 for (i, _), w in zip(used, white[:, j]))
            assert all(r.identity_error < 1e-9 for r in mine.values())
        else:
            assert all(r.whitened is None for r in mine.values())


@pytest.mark.parametrize("width", [1, 3, 12])
def test_whitening_matches_numpy(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, (rng.standard_normal(width) * np.arange(1, width + 1)).tolist()) for i in range(300)]
    rows += [(400, None), (401, [None] * width), (402, [float("nan")] * width), (403, [float("-inf")] + [1.0] * (width - 1)), (404, []), (405, [1.0] * (width + 1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("x")).withColumn("component", F.lit(0)).repartition(5)
    _check_whitening(rows, whiten.whitening_report(df).collect(), width)
    fit = whiten.fit_whitening(df)
    assert whiten.whiten(df, fit, 1).filter("size(whitened) = 1").count() == 300


def test_whitening_of_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    _check_whitening(rows, queries.op13_embedding_whitening(spark, SF_SMALL).collect(), len(rows[0][1]))


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [2.0, 3.0]), (1, [2.0, 3.0])], "vec_id long, embedding array<float>")
    rows = whiten.whitening_report(one).collect()
    assert len(rows) == 4 and all(r.whitened is None and r.identity_error is None and r.deviation == 0 and r.explained == 0 for r in rows)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(10)], "vec_id int, embedding array<double>")
    rows = whiten.whitening_report(line).collect()
    assert {r.component for r in rows if r.whitened is not None} == {1} and all(r.identity_error < 1e-9 for r in rows)
    for empty in (one.limit(0), one.select("vec_id", F.lit(None).cast("array<double>").alias("embedding"))):
        assert whiten.whitening_report(empty).count() == 0
    huge = spark.createDataFrame([(1, [1e300]), (2, [-1e300]), (3, [0.5])], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whiten.whitening_report(huge).collect()].count(None) == 2


def test_exact_deviation_at_the_limit():
    x = np.array([[0.0], [2.0 ** 30], [3037000499.0], [3037000500.0]])
    assert whiten.exact_deviation(x, 1, [0]) == [0, 1 << 60, 3037000499 ** 2, None]
    assert whiten.exact_deviation(x[:2], 7, [5 * 2 ** 30]) == [None, 1 << 62]
