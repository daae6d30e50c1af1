"""Quality, packing, sharding, URLs, pages and vectors against brute force."""

import html
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import oracle_compare
from conftest import SF_MID, SF_SMALL
from labelpool.llm import extract, kd_shards, lsh_search, packing, quality, queries, url_filter
from labelpool.llm.components import connected_components


# ------------------------------------------------------------ quality
def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_MID}/{t}.parquet") for t in ("documents", "labels"))  # 80 held-out labels
    scored = quality.quality_scores(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter("quality is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_without_usable_labels(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "x " * 50_000), (2, "x")], "doc_id long, text string").withColumn("label", F.lit("c"))
    none = spark.createDataFrame([(1, None), (7, 1), (2, 5)], "doc_id long, quality int")
    assert [r.score for r in quality.quality_scores(docs, none).collect()] == [0.5] * 4
    assert quality.quality_scores(docs.limit(0), none).count() == 0
    trees = quality.fit_quality(docs, none)
    assert quality.score_quality(docs, trees).columns == ["doc_id", "text", "label", "score"]


def test_flat_trees_follow_their_cuts():
    rnd = np.random.default_rng(0)
    rows = rnd.random((400, 3)).astype(np.float32)
    label = ((rows[:, 0] > 0.5) ^ (rows[:, 1] > 0.3)).astype(float)
    trees = quality.fit_trees(rows, label, trees=20, depth=3)
    raw = np.full(len(rows), trees.base)
    for i, row in enumerate(rows):
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            raw[i] += leaf[node - len(f)]
    assert np.allclose(trees.score(rows), 1 / (1 + np.exp(-raw)))
    assert np.mean((trees.score(rows) > 0.5) == label) > 0.95


# ------------------------------------------------------------ packing
def test_packing_is_whole(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary_path())
    tok.encode_special_tokens = True
    rnd = random.Random(1)
    rows = [(1, None), (None, ""), (2, " a  b\n\nc \u00e9\U0001f600 don't <|endoftext|> "), (2, "same"), (2, "same"), (3, "long text, " * 3000)]
    rows += [(10 + i, " ".join(rnd.choices(["alpha", "beta", "gamma!", "12", "\n"], k=rnd.randint(0, 900)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("length", F.lit("x")).repartition(4)
    got = packing.pack(docs, queries.vocabulary_path(), with_ids=True).collect()
    sequences = {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0              # full, or a power of two: no padding
    pieces = sorted([(str(r.doc_id), r.start, r.ids, r.doc_tokens) for r in got], key=lambda x: x[:2])
    want = []
    for doc, text in rows:
        want.append((str(doc), tok.encode(text or "", add_special_tokens=False).ids + [0]))
    assert sum(len(p[2]) for p in pieces) == sum(len(w[1]) for w in want)
    for doc in {w[0] for w in want if [x[0] for x in want].count(w[0]) == 1}:
        ids = next(w[1] for w in want if w[0] == doc)
        mine = [p for p in pieces if p[0] == doc]
        assert [x for p in mine for x in p[2]] == ids and all(p[3] == len(ids) for p in mine)
    assert packing.pack(docs.limit(0), queries.vocabulary_path()).count() == 0


# ------------------------------------------------------------ sharding
def test_shards_are_even_and_keep_groups(spark):
    rnd = random.Random(7)
    rows = [(i, "x" * rnd.randint(0, 400), rnd.choice(["en", "de", None]), f"src{rnd.randrange(5)}") for i in range(3000)]
    rows += [(None, None, None, None), (5, "hot" * 50, "en", "s"), (5, "hot" * 50, "en", "s")] + [(9000 + i, "hot" * 50, "en", "s") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("x")).repartition(3)
    got = kd_shards.shard_table(docs).collect()
    assert len(got) == len(rows)
    sizes, slots, homes = {}, {}, {}
    for r in got:
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        homes.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert set(sizes) == set(range(8)) and max(sizes.values()) / min(sizes.values()) < 1.02
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    assert sorted((r.text_crc32, r["size"]) for r in got) == sorted((zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for _, t, _, _ in rows)
    by_bytes = kd_shards.kd_shards(docs, target_bytes=sum(sizes.values()) // 5 + 1).select("shard").distinct().count()
    assert by_bytes == 5


def test_a_group_larger_than_a_shard_is_divided(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('t', id)) AS text", "'en' AS lang", "'s' AS source")
    sizes = [r.s for r in kd_shards.shard_table(docs).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) / min(sizes) < 1.5
    assert kd_shards.shard_table(docs.limit(0)).count() == 0


# ------------------------------------------------------------ URLs
def verdict(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    best = None
    for key, action in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")):
        name, start = key.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(key) > len(best[0])):
            best = (key, action)
    if best:
        return host, path, *best
    return host, path, None, "block" if set(host.split(".")) & set(url_filter.BLOCKED_NAMES) else "allow"


URLS = [None, "", "nothing", "http://NET/", "http://a.net", "x://example.com//de/", "x://example.com/de/?x", "x://a.example.net/en/a/b/c#/", "://org/fr/",
        "http://ads-track.com", "http://net?/", "http://éé.net/x://y", "http:///en/", "http://a..net/", "http://x/" + "a/" * 5000]


def test_cascades_of_small_universes_end():
    rng = np.random.default_rng(1)
    for turn in range(1000):
        n, listed = int(rng.integers(2, 400 if turn % 20 else 20_000)), int(rng.integers(1, 4 if turn % 2 else 40))
        h1, h2 = (rng.integers(-2 ** 63, 2 ** 63 - 1, n) for _ in range(2))
        now, other, levels = np.arange(n) < listed, np.arange(n) >= listed, []
        while now.any():
            bits = np.zeros(url_filter.level_bits(int(now.sum())) // 8, np.int64)
            np.bitwise_or.at(bits, *url_filter._bytes_of(h1[now], h2[now], len(bits) * 8, len(levels)))
            levels.append(bits.astype(np.uint8))
            taken = other.copy()
            taken[other] = url_filter._inside(levels[-1], h1[other], h2[other], len(levels) - 1)
            now, other = taken, now
            assert len(levels) < 20
        assert (url_filter.Cascade(tuple(levels)).contains(h1, h2) == (np.arange(n) < listed)).all()


def test_listed_labels_by_cascade_and_by_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(["bad.example.com", "a.bad", "notbad.com", "", None, "x.y.worse", "bad.worse"])], "page_id long, host string")
    names = spark.createDataFrame([("bad",), ("worse",), ("bad",), ("unseen",)], "name string")
    want = [(0, True), (1, True), (2, False), (3, False), (4, False), (5, True), (6, True)]
    for limit in (url_filter.MAX_BYTES, -1):
        monkeypatch.setattr(url_filter, "MAX_BYTES", limit)
        assert sorted((r.page_id, r.listed) for r in url_filter.with_listed_label(rows, names).collect()) == want
    assert not any(r.listed for r in url_filter.with_listed_label(rows, names.limit(0)).collect())


def test_url_verdicts(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url")
    extra = [(9000 + i // 2, u) for i, u in enumerate(URLS + URLS)]
    rows = pages.unionByName(spark.createDataFrame(extra, "page_id long, url string")).withColumn("host", F.lit("x")).withColumn("rule", F.lit(1))
    got = sorted([tuple(r) for r in url_filter.url_verdicts(rows).collect()], key=str)
    assert got == sorted([(r.page_id, *verdict(r.url)) for r in rows.collect()], key=str)
    assert url_filter.url_verdicts(rows.limit(0)).count() == 0


def test_cascade_is_exact_and_join_agrees(spark, monkeypatch):
    keys = spark.range(6000).selectExpr("xxhash64(id, 1) AS h1", "xxhash64(id, 2) AS h2", "id")
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 6)      # more false positives, so more levels
    cascade = url_filter.build_cascade(keys.filter("id < 500").select("h1", "h2"), keys.select("h1", "h2"))
    assert len(cascade.levels) >= 3
    rows = keys.toPandas()
    assert (cascade.contains(rows.h1.to_numpy(), rows.h2.to_numpy()) == (rows.id < 500).to_numpy()).all()
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    block, allow = (spark.createDataFrame([(k,) for k in ks], "key string") for ks in (["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]))
    one = sorted([tuple(r) for r in url_filter.filter_urls(pages, block, allow).collect()], key=str)
    monkeypatch.setattr(url_filter, "MAX_BYTES", -1)
    assert one == sorted([tuple(r) for r in url_filter.filter_urls(pages, block, allow).collect()], key=str)


def brute_cells(points, a, b, spans):
    """{group: shard} of a k-d tree over (weight, keys, group) points, by sorting them."""
    if b - a == 1 or not points:
        return {g: a for _, _, g in points}
    width = [(max(p[1][k] for p in points) >> 32) - (min(p[1][k] for p in points) >> 32) for k in range(len(spans))]
    dim = max(range(len(spans)), key=lambda k: width[k] / max(spans[k], 1))
    points = sorted(points, key=lambda p: p[1][dim])
    half, upto, left = (b - a) // 2, 0, 0
    goal = sum(p[0] for p in points) * half / (b - a)
    for left, p in enumerate(points):
        upto += p[0]
        if upto >= goal:
            left += upto - goal <= goal - (upto - p[0])
            break
    return brute_cells(points[:left], a, a + half, spans) | brute_cells(points[left:], a + half, b, spans)


def test_shards_are_those_of_a_brute_force_tree(spark):
    """Also of sources that begin alike, which are different values of their dimension."""
    rows = [(i, f"text {i} " + "w " * (i * 7919 % 23), ["en", "fr", None][i % 3], f"https://example.org/{i * 31 % 41:02d}") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sources = {x: k + 1 for k, x in enumerate(sorted({r[3] for r in rows}))}
    keyed = docs.withColumn("h", F.xxhash64("text")).withColumn("tie", F.shiftrightunsigned(F.xxhash64("h", F.lit(0).cast("long")), 32)).collect()
    sizes = {r.doc_id: len(r.text) for r in keyed}
    spans = [2, 40, max(sizes.values()) - min(sizes.values())]
    points = [(sizes[r.doc_id] + 1, [(d << 32) + r.tie for d in ({"en": 1, "fr": 2, None: 0}[r.lang], sources[r.source] - 1, sizes[r.doc_id] - min(sizes.values()))], r.doc_id)
              for r in keyed]
    got = {r.doc_id: r.shard for r in kd_shards.kd_shards(docs, 5).collect()}
    assert got == brute_cells(points, 0, 5, spans)


# ------------------------------------------------------------ pages
def test_article_texts(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    got = {r.page_id: r for r in extract.page_texts(pages.withColumn("text", F.lit("x")).withColumn("host", F.lit("y"))).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_odd_pages(spark):
    rows = [(1, None, None, ""), (2, "", "<p>a &amp; b<p>c", "a & b c"), (3, "http://x/", "", ""),
            (4, "http://x/", "<body><nav>m</nav><div id=main><p>Hello <b>w</b>orld<br>x</div><div class='comments'>no</div><script>if(a<b)</script><footer>f",
             "Hello world x"),
            (5, "http://y/", "<div class=content><h1>T</h1><div class='cookie-notice'>c</div><ul><li>a<li>b</ul><!-- x --> z &lt;p&gt;</div><form>q</form>",
             "T a b z <p>"),
            (6, "http://z/", "a < b <", "a < b <"), (7, "http://w/", "<article></article><footer>f</footer>", ""),
            (8, "http://v/", "<main>" + "<div>" * 500 + "deep", "deep"), (8, "http://v/", "<main>twice</main>", "twice")]
    df = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in extract.page_texts(df).collect())
    assert got == sorted((r[0], r[3]) for r in rows)
    assert extract.page_texts(df.limit(0)).count() == 0


def extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in extract.page_texts(df).collect()}


def test_sibling_slots_all_stay(spark):
    """Heading, lead and story side by side; the story holds most of the text."""
    rows = [(i, f"http://x/{i}", f"<body><h1>title {i}</h1><div class=lead>lead {i} of it</div><div class=story>{f'story{i} ' * 40}</div></body>") for i in range(5)]
    assert extracted(spark, rows) == {i: f"title {i} lead {i} of it " + " ".join([f"story{i}"] * 40) for i in range(5)}
    rows = [(i, f"http://y/{i}", f"<article class=a>first {i}</article><div><article class=b>second {i} {i}</article></div>") for i in range(4)]
    assert extracted(spark, rows) == {i: f"first {i} second {i} {i}" for i in range(4)}


def test_constant_texts_are_template(spark):
    """A box under an unlisted name goes, on all pages or with its element; parts of an
    article stay whatever their names are, and so do repeated paragraphs of some pages."""
    page = "<body><article><h1>t{0}</h1><div class=x1>Sign up <b>now</b>!</div>{1}<p>text {0}</p><section class=related-work>work {0}</section>" \
        "<div class=social-history>history {0}</div>{2}</article></body>"
    rows = [(i, f"http://x/{i}", page.format(i, "<div class=x2><p>Notice</div>" if i < 4 else "", "<p>again" if i % 3 else "")) for i in range(6)]
    want = {i: f"t{i} text {i} work {i} history {i}" + " again" * (i % 3 > 0) for i in range(6)}
    copies = [(100 + i, "http://x/0", rows[0][2]) for i in range(20)]      # copies are one page of the template
    assert extracted(spark, rows + copies) == want | {100 + i: want[0] for i in range(20)}
    # too few pages show no template; a page of constant text alone keeps it
    two = [(i, f"http://y/{i}", f"<article><p>same</p><p>t{i}</p></article>") for i in range(2)]
    same = [(10 + i, f"http://z/{i}", f"<nav>{i}</nav><article><p>same</p></article>") for i in range(4)]
    assert extracted(spark, two + same) == {0: "same t0", 1: "same t1"} | {10 + i: "same" for i in range(4)}


def test_shared_paragraphs_of_articles_stay(spark):
    rows = [(i, f"http://x/{i}", f"<body><nav>m</nav><article><h1>t{i}</h1><p>own {i}</p><p>shared by all</p></article><footer>f</footer></body>") for i in range(12)]
    rows += [(100 + i, f"http://y/{i}", f"<h1>t{i}</h1><div class=story><p>own {i} {i} {i}</p><p>shared by all</p></div>") for i in range(3)]
    assert extracted(spark, rows) == {i: f"t{i} own {i} shared by all" for i in range(12)} | {100 + i: f"t{i} own {i} {i} {i} shared by all" for i in range(3)}


TALK = "<div class=c><span class=w>reader {0}</span><p>said {0} to {1}</p></div>"


def test_comments_inside_articles_go(spark):
    """By a listed name, and as a list of records under no listed name; figures and
    sections of an article, which repeat, too, stay."""
    page = "<article><h1>t{0}</h1><p>" + "word{0} " * 60 + "</p><div class=fig><span class=cap>figure {0}</span></div><div class=fig><span class=cap>second {0}</span></div><p>end {0}</p>{1}</article>"
    named = "<div class=share><a href=x>Tell {0} friends</a></div><div class=comments><p>first {0}</p></div>"
    want = {i: f"t{i} " + " ".join([f"word{i}"] * 60) + f" figure {i} second {i} end {i}" for i in range(4)}
    assert extracted(spark, [(i, f"http://x/{i}", page.format(i, named.format(i))) for i in range(4)]) == want
    talk = [(i, f"http://x/{i}", page.format(i, "<section class=reader-talk><h3>Talk on {0}</h3>".format(i) + "".join(TALK.format(k, i) for k in range(i + 1)) + "</section>")) for i in range(4)]
    assert extracted(spark, talk) == want
    parts = [(i, f"http://x/{i}", f"<article><p>lead {i}</p>" + "".join(f"<div class=part><h2>part {k}</h2><p>text {i} {k}</p></div>" for k in range(i + 2)) + "</article>") for i in range(4)]
    assert extracted(spark, parts) == {i: f"lead {i} " + " ".join(f"part {k} text {i} {k}" for k in range(i + 2)) for i in range(4)}


def test_boxes_beside_the_text_go(spark):
    """Without an article element: a varying box, a list of records, and on a host of two
    pages a notice, all under unlisted names."""
    page = "<body>{2}<h1>title {0}</h1><div class=lead>lead {0}</div><div class=story><p>{1}</p></div><div class=x1>Buy {0} now</div>{3}</body>"
    for pages in (2, 5):
        rows = [(i, f"http://x{pages}/{i}", page.format(i, f"story{i} " * 80, "<div class=x2>Our terms have changed</div>",
                                                       "<div class=reader-talk>" + "".join(TALK.format(k, i) for k in range(1 + i % 3)) + "</div>")) for i in range(pages)]
        assert extracted(spark, rows) == {i: f"title {i} lead {i} " + " ".join([f"story{i}"] * 80) for i in range(pages)}


def test_deep_pages(spark):
    rows = [(i, f"http://x/{i}", "<body>" + "<div class=a>" * 3000 + f"<article><p>deep {i}</p></article>" + "</div>" * 3000) for i in range(3)]
    assert extracted(spark, rows) == {i: f"deep {i}" for i in range(3)}


# ------------------------------------------------------------ vectors
def brute(rows, k):
    out = {}
    for q, x in rows:
        if q % 20 == 0:
            near = sorted({(-float(np.dot(np.float64(x), np.float64(y))), v) for v, y in rows if v != q})[:k]
            out[q] = [v for _, v in near]
    return out


def test_recall_of_the_search(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    want, got = brute(rows, 20), {}
    for r in lsh_search.nearest_vectors(table.withColumn("h", F.lit(1)).withColumn("ids", F.lit("x"))).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    of = dict(rows)
    assert all(abs(s - np.dot(np.float64(of[q]), np.float64(of[v]))) < 1e-12 for q, near in got.items() for _, v, s in near)
    assert all(sorted(x[0] for x in near) == list(range(1, 21)) for near in got.values())
    assert sum(len(set(want[q]) & {x[1] for x in got[q]}) for q in want) / (20 * len(want)) >= 0.9


def test_blocks_of_the_search_change_nothing(spark, monkeypatch):
    rnd = np.random.default_rng(7)
    # a crowd whose blocks many queries visit, and some far from it
    x = np.concatenate([np.eye(12)[0] + rnd.standard_normal((500, 12)) / 20, rnd.standard_normal((300, 12))])
    df = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    found = lambda: sorted(tuple(r) for r in lsh_search.search(df, F.col("vec_id") % 5 == 0, k=10).collect())
    want = found()
    assert len(want) == 160 * 10
    monkeypatch.setattr(lsh_search, "BLOCK", 50)
    monkeypatch.setattr(lsh_search, "QUERY_BLOCK", 16)
    assert [r[:3] for r in found()] == [r[:3] for r in want]
    monkeypatch.setattr(lsh_search, "BROADCAST_ROWS", 0)
    assert [r[:3] for r in found()] == [r[:3] for r in want]


def test_odd_vectors_ties_and_copies(spark):
    good = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [2.0, 0.0]), (8, [0.5, 0.5]), (40, [100.0, 1.0]), (5, [-1.0, 0.0])] + [(100 + i, [1.0, 0.0]) for i in range(1, 60)]
    bad = [(0, [1.0, 0.0]), (4, [0.0, 0.0]), (60, None), (6, [float("nan"), 1.0]), (7, [1.0, None]), (9, [1.0]), (80, []), (None, [1.0, 1.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>")
    got = {}
    for r in lsh_search.nearest_vectors(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(good, 20)
    assert lsh_search.nearest_vectors(df.limit(0)).count() == 0


def test_all_candidates_of_few_and_of_isolated_vectors(spark):
    """Fewer vectors than places: all of them; and a query far from a crowd has a full list."""
    rnd = np.random.default_rng(15)
    for seed, width in enumerate((64, 2, 64)):
        x = rnd.standard_normal((15, width))
        rows = [(20 * i, [float(v) for v in y / np.linalg.norm(y)]) for i, y in enumerate(x)]
        if seed == 2:
            rows += [(1 + 20 * i, [float(v) for v in np.eye(width)[0] + rnd.standard_normal(width) / 400]) for i in range(300)]
            rows += [(20_000, [-1.0] + [0.0] * (width - 1))]
        got = {}
        for r in lsh_search.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = brute(rows, 20)
        assert {q: len(v) for q, v in got.items()} == {q: len(v) for q, v in want.items()}
        assert seed == 2 or got == want


def test_probes_reach_further_where_one_step_does_not_do(monkeypatch):
    rnd = np.random.default_rng(3)
    sample = rnd.standard_normal((300, 16))
    monkeypatch.setattr(lsh_search, "WIDTH", 0.6)
    one, two = (lsh_search.Tables(16, reach=r) for r in (1, 2))
    assert lsh_search._fitted_probes(sample, one, 20) is None
    place = two.project(lsh_search._unit(sample[:5], np.linalg.norm(sample[:5], axis=1)))[:, 0]
    seen = two.probes(place, len(two.steps))
    assert all(len(set(row)) == 5 ** 6 and row[0] == two.code(np.floor(p)) for row, p in zip(seen.tolist(), place))
    assert set(one.probes(place, 729)[0]) < set(seen[0].tolist())


# ------------------------------------------------------------ links, SQL, pipeline
def test_components(spark):
    rnd = random.Random(0)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(500, 500 + i) for i in range(1, 80)] + [(i, i + 1) for i in range(600, 660)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {a: root(a) for a in parent if any(a in e and e[0] != e[1] for e in links)}


def test_queries_match_their_sql(spark):
    con = oracle_compare.duck(SF_SMALL)
    for name, sql in queries.oracle_sql().items():
        ok, rows, _, detail = oracle_compare.compare(spark, name, queries.queries()[name], sql, SF_SMALL, con)
        assert ok and rows, (name, detail)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").cache()
    names = [n for n, _ in p.STAGES]
    assert names == ["quality", "near_duplicates", "decontaminate", "secrets", "packing"]
    assert len(queries.queries()) == 10
    kept = docs
    for name, stage in p.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, SF_SMALL).checkpoint()
        assert kept.columns == docs.columns and 0 < kept.count() <= before, name
    assert kept.join(docs, "doc_id", "left_anti").count() == 0
    assert not kept.filter(F.col("text").rlike(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}")).count()
    pieces = p.run(spark, SF_SMALL)
    assert pieces.select("doc_id").distinct().count() == kept.count()
    empty = docs.limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0
