"""Each operator against brute force on a small table with nulls, empty and long texts, copies, ties and clashing columns."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkprep.llm import exact_dedup, html_extract, license_scan, line_dedup, mixing, packing, quality, sharding, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h long, size long, word int, rank int, pattern string, kept boolean"
WORDS = "the of and der die que les él naïve straße cat dog tree river stone light under over with from".split()


def corpus():
    rnd = random.Random(5)
    sentence = lambda n: " ".join(rnd.choice(WORDS) + rnd.choice(["", "", "s", "ing"]) for _ in range(n))
    shared = sentence(14) + " shared line that many documents hold"
    texts = [None, "", " \t\n", "one", "two words here", "Released under the MIT License.", "x" * 5000]
    for i in range(60):
        lines = [sentence(rnd.randint(5, 25)) for _ in range(rnd.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(rnd.randint(0, len(lines)), ("  " + shared + "\t") if i % 2 else shared.upper())
        texts.append("\n".join(lines))
    texts += [texts[10], texts[10].upper(), texts[11], texts[12] + " end", "*** $$$ " * 80, sentence(3) * 60, sentence(9000)]
    rows = [(i * 7 % 101, t, [None, "en", "de"][i % 3], ["b", "a", None, "c"][i % 4]) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, 2, 3, 4, 5, "p", True) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def got(df):
    return Counter(tuple(r) for r in df.collect())


def simhash_of(text):
    words = [w for w in lowered(text).encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, rows, empty):
    fps = [simhash_of(r[1]) for r in rows]
    label = [r[0] for r in rows]
    ids = list(label)
    for _ in rows:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4 or ids[i] == ids[j]:
                    label[i] = label[j] = min(label[i], label[j])
    assert got(simhash.near_duplicates(docs)) == Counter((i, f"{f:016x}", c) for i, f, c in zip(ids, fps, label))
    assert simhash.near_duplicates(empty).collect() == []


def test_ball_links_find_all_pairs_within_the_radius():
    import numpy as np

    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 63, 150, np.uint64)
    near = simhash.masks_within(3)
    fps = np.unique(np.concatenate([base, base[:80] ^ near[rnd.integers(0, len(near), 80)], base[:80] ^ near[rnd.integers(0, len(near), 80)]]))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    want = simhash.star_components(fps[i], fps[j])
    for places, sub in ((range(6), 0), ([1, 7, 20, 40, 63], 2), (range(9), 3)):
        found = [simhash.bucket_links(fps, b, list(places), sub, 4) for b in range(1 << len(places))]
        have = simhash.star_components(*(np.concatenate([x[k] for x in found]) for k in (0, 1)))
        assert [x.tolist() for x in have] == [x.tolist() for x in want]


def test_ball_links_with_several_blocks_and_buckets_left_out(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(simhash, "BUCKET", 300)
    monkeypatch.setattr(simhash, "BLOCK", 150)
    rnd = np.random.default_rng(4)
    base = np.unique(rnd.integers(0, 1 << 63, 600, np.uint64))
    places = [rnd.choice(64, 1 + i % 4, replace=False) for i in range(len(base))]
    fps = np.unique(np.concatenate([base, base ^ np.array([sum(1 << int(p) for p in x) for x in places], np.uint64)]))
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.ball_links(df, len(fps)).collect()
    pairs = {tuple(sorted((np.int64(r.u).view(np.uint64), np.int64(r.v).view(np.uint64)))) for r in found}
    have = simhash.star_components(*(np.array([p[k] for p in pairs], np.uint64) for k in (0, 1)))
    want = simhash.star_components(fps[i], fps[j])
    assert [x.tolist() for x in have] == [x.tolist() for x in want]


def test_simhash_of_rows_that_share_an_id(spark):
    rnd = random.Random(8)
    a, b = (" ".join(rnd.choice(WORDS) for _ in range(90)) for _ in range(2))
    docs = spark.createDataFrame([(5, a), (5, b), (2, a), (3, b), (None, "x y z"), (None, " ".join(f"q{i}" for i in range(70))), (9, "x y z")], "doc_id long, text string")
    found = Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert found == Counter([(5, 2), (5, 2), (2, 2), (3, 2), (9, 9), (None, 9), (None, None)])


def test_bucket_loads_count_what_is_shipped():
    import numpy as np

    rnd = np.random.default_rng(6)
    codes = rnd.integers(0, 64, 500)
    loads = simhash.bucket_loads(np.bincount(codes, minlength=64), 6, 4)
    assert all(loads[b] == sum(int(c ^ b).bit_count() <= 2 for c in codes) for b in range(64))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {i: 1 for i in range(2, 41)} | {x: 100 for x in range(101, 160)} | {201: 200}


def measures_of(text):
    words = (text or "").encode().split()
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), len(b"".join(words).decode()), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality(docs, rows, empty):
    found = quality.quality(docs).collect()
    base = lambda m: m[0] < 50 or 100 * m[4] > 50 * m[0]
    assert Counter((r.doc_id, *(r[c] for c in quality.BASE), r.base_failed) for r in found) == Counter((r[0], *(m := measures_of(r[1])), base(m)) for r in rows)
    assert not any(r.kept for r in found if r.base_failed or r.n_symbols > r.n_words)
    assert all(r.kept for r in found if not r.base_failed and not r.n_symbols and r.n_dup_lines == 0 and r.n_repeat_words == 0 and r.upper_rate < 200)
    assert quality.quality(empty).collect() == []


def measured_rows(spark, rows):
    """Rows of (lang, source, {measure: value}) as the sketches read them."""
    base = {"n_words": 100, "word_chars": 1000, "n_lines": 10}
    cells = [(lang, source, *((base | x).get(c, 0) for c in quality.COLUMNS)) for lang, source, x in rows]
    return spark.createDataFrame(cells, "lang string, source string, " + ", ".join(f"{c} long" for c in quality.COLUMNS))


def test_quality_limits_follow_exact_quantiles(spark):
    rnd = random.Random(1)
    counts = [rnd.randint(0, 300) for _ in range(1000)]
    found = quality.limits(measured_rows(spark, [("en", "s", {"n_symbols": x}) for x in counts])).where("level = 0").first()
    low, _, high = (sorted(x * 100 for x in counts)[n] for n in (249, 499, 749))
    limit = found.symbol_rate_limit
    assert abs(limit - (high + 16 * (high - low))) <= 0.04 * limit
    assert found.bang_rate_limit == 16 * (10_000 // 100) and found.repeat_rate_limit == 16 * (60_000 // 100)


def test_quality_limits_differ_by_group_and_bear_junk_in_a_quarter(spark):
    rows = [("en", "prose", {"n_symbols": int(i % 5 == 0) * 90}) for i in range(500)] + [("en", "code", {"n_symbols": 10 + i % 10}) for i in range(500)] + [("en", "few", {})] * 20
    found = {r.source: r.symbol_rate_limit for r in quality.limits(measured_rows(spark, rows)).where("level = 0").collect()}
    assert found["prose"] == 1600 and found["code"] > 3000
    words = lambda k, n: " ".join(f"w{k}x{i}" for i in range(n))
    texts = [(i, words(i, 300), "en", "prose") for i in range(200)] + [(1000 + i, words(i, 300) + " #" * (20 + i % 20), "en", "code") for i in range(200)]
    same = words(7, 300) + " #" * 45
    docs = spark.createDataFrame([*texts, (1, same, "en", "prose"), (1, same, "en", "code"), (2, same, "en", "rare")], "doc_id long, text string, lang string, source string")
    verdicts = {(r.doc_id, r.n_symbols, r.symbol_rate_limit): r.kept for r in quality.quality(docs).where("n_symbols = 45").collect()}
    assert sorted(verdicts.values()) == [False, True, True]
    kept = quality.good(docs).collect()
    assert len(kept) == 402 and {r.source for r in kept if r.doc_id < 3 and r.text == same} == {"code", "rare"}


def dedup_lines(rows, least=40, often=5):
    key = lambda x: lowered(x.strip(" \t\n\v\f\r"))
    where = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                where.setdefault(key(line), set()).add(i)
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= often and max(where[key(x)]) != i)]
        yield i, len(lines), len(lines) - len(kept), "\n".join(kept)


def test_line_dedup(docs, rows, empty):
    assert got(line_dedup.line_dedup(docs)) == Counter(dedup_lines(rows))
    bits = line_dedup.line_bitmaps(docs).collect()
    assert sum(64 - bin(b["bits"] & (1 << 64) - 1).count("1") for r in bits for b in r["keep"]) == sum(x[2] for x in dedup_lines(rows))
    assert line_dedup.line_dedup(empty).collect() == []


def test_line_dedup_with_runs_cut_by_document(docs, rows):
    plain = {(r.doc_id, r.mark): r.dropped for r in line_dedup.dropped_bitmaps(docs).collect()}
    assert plain
    for span in (3, 20):
        assert {(r.doc_id, r.mark): r.dropped for r in line_dedup.dropped_bitmaps(docs, span=span).collect()} == plain


def test_line_dedup_streams_one_exchange(spark, docs):
    lines = spark.createDataFrame([(1, 1, 1, 1, 0)], "h1 long, h2 long, doc_id long, mark long, position int")
    plan = line_dedup.streamed(lines, 5, 100)._jdf.queryExecution().executedPlan().toString().split("Exchange rangepartitioning")
    assert len(plan) == 2 and "Exchange" not in plan[0] and plan[0].count("+- Sort") == 1 and "Exchange hash" not in plan[1]


def test_line_dedup_of_long_texts(spark):
    text = lambda i, n: "\n".join(f"line {k} of more than forty code points in all, {'shared' if k % 3 else i}" for k in range(n))
    rows = [(i, text(i, 64_000)) for i in range(5)]
    found = {r.doc_id: (r.n_dropped, r.n) for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).select("doc_id", "n_dropped", F.length("kept_text").alias("n")).collect()}
    assert found == {i: (n, len(kept)) for i, _, n, kept in dedup_lines(rows)}


def test_exact_dedup(docs, rows, empty):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(lowered(t), []).append(i)
    found = exact_dedup.exact_dedup(docs)
    want = Counter((i, max(g := groups[lowered(t)]), len(g), hashlib.sha256(lowered(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert got(found.drop("kept")) == want
    assert got(found.where("kept").select("doc_id", "text_sha256")) == Counter((max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items())
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_directory_doubles_until_buckets_fit():
    counts = {0: 10, 1: 3, 7: 4, 15: 1}
    depth, slots = exact_dedup.directory(counts, capacity=4, max_depth=4)
    assert len(slots) == 1 << depth
    load = Counter()
    for prefix, n in counts.items():
        load[slots[prefix >> (4 - depth)]] += n
    assert all(n <= 4 or own == 4 for (_, own), n in load.items())
    assert exact_dedup.directory({}, 4, 4) == (0, [(0, 0)])


def test_owners_have_ranges_of_keys_and_even_shares(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNED", 1000)
    hashes = spark.range(8000).select(F.xxhash64("id").alias("h"))
    slots, bits, owners = exact_dedup.build_directory(spark, hashes)
    rows = slots.orderBy("slot").collect()
    assert owners == 9 and [r.owner for r in rows] == sorted(r.owner for r in rows) and len({(r.bucket, r.owner) for r in rows}) == len({r.bucket for r in rows})
    held = hashes.join(slots, F.shiftrightunsigned("h", 64 - bits) == slots["slot"])
    by_owner, by_bucket = ([r[1] for r in held.groupBy(c).count().collect()] for c in ("owner", "bucket"))
    assert len(by_owner) == 9 and sum(by_owner) == 8000 and max(by_owner) < 1300 and max(by_bucket) <= 200


def test_exact_dedup_of_many_crowded_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "OWNED", 50)
    monkeypatch.setattr(exact_dedup, "GATHERED", 500)
    rows = [(i, f"Text {i % 700}" if i % 3 else "hot") for i in range(3000)]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == Counter((i, max(g := groups[t]), len(g), i == max(g)) for i, t in rows)


def test_chains_compare_bytes(spark):
    found = exact_dedup.chained(spark.createDataFrame([(1, b"a", [1], 0), (1, b"b", [2], 1), (1, b"a", [3], 2), (2, b"a", [4], 3)], "h long, text binary, ids array<long>, carrier long").coalesce(1))
    assert [(r.h, r.link) for r in found.orderBy("carrier").collect()] == [(1, 0), (1, 1), (1, 0), (2, 0)]


PAGE = """<!DOCTYPE html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>Our fine site</p></header>
<nav><a href='/'>Home</a></nav><div class="cookie-notice"><p>We use cookies and more cookies on this site</p></div>
<article><h1>A  title &amp; more</h1><p>First <b>bold</b>\n text<br>goes on.<p>Short.<script>var a = "</p>";</script><p>Caf&eacute; &#x41;&#66; &copy
<aside><p>See also some other things that we wrote</p></aside><form><p>Your name</p><input></form>
<p class="ad">Buy this now and be happy</p><div id=comments><p>Nice article, I like it very much indeed</p></div></article><footer>&copy; us</footer>"""


def test_html_extract(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", "<p>" + "word " * 5000), (4, "u", "<a href='x"), (5, "u", "<!-- never <p>ends")]
    found = {(r.page_id, r.n_chars): r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(found) == 6
    texts = [r.text for r in found.values()]
    assert "A title & more\nFirst bold text goes on.\nShort.\nCafé AB ©" in texts
    assert texts.count("") == 4 and max(map(len, texts)) == 24999
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_tree_fits_its_table_and_asks_for_text_first():
    x, y = html_extract.labelled()
    tree = html_extract.trained()
    assert sum(html_extract.keep(tree, row) == label for row, label in zip(x.tolist(), y)) >= 0.99 * len(y)
    nodes = [tree]
    for _ in range(html_extract.TEXT_DEPTH):
        nodes = [n for n in nodes if isinstance(n, html_extract.Node)]
        assert nodes and all(html_extract.FEATURES[n.feature] in html_extract.TEXT_FEATURES for n in nodes)
        nodes = [y for n in nodes for y in (n.low, n.high)]


def page_of(rnd):
    """A random page and its article's blocks, in the forms that pages take."""
    words = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    links = lambda n: "".join(f"<li><a href='/{k}'>{words(rnd.randint(1, 3))}</a></li>" for k in range(n))
    kept = [words(rnd.randint(3, 12))] + [words(rnd.choice([2, 8, 30, 60, 120])) for _ in range(rnd.randint(3, 9))]
    between = ["", "", "", f"<aside><p>{words(20)}</p></aside>", f"<div class='ad'>{words(9)}</div>", f"<form><label>{words(2)}</label><input></form>"]
    body = "".join(f"<h1>{x}</h1>" if not i else f"<p>{x}</p>" + rnd.choice(between) for i, x in enumerate(kept))
    after = rnd.choice(["", f"<section id='comments'><h2>{words(2)}</h2><div class='comment'><p>{words(30)}</p></div></section>", f"<div class='related'><ul>{links(4)}</ul></div>"])
    page = f"<body><nav><ul>{links(5)}</ul></nav><div class='ad'>{words(8)}</div><article>{body}{after}</article><footer>{words(9)}</footer></body>"
    return page, kept


def test_html_of_random_pages():
    rnd, tree = random.Random(4), html_extract.trained()
    exact = 0
    for _ in range(300):
        page, kept = page_of(rnd)
        exact += html_extract.main_text(page, tree) == "\n".join(kept)
    assert exact >= 0.97 * 300


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_html_of_the_pages_with_and_without_their_markup(spark):
    tree = html_extract.trained()
    right = kept = wanted = 0
    for row in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect():
        inside = re.search("<article>.*</article>", row.html, re.S)[0]
        article = "\n".join(b.text for b in html_extract.blocks(inside))
        assert html_extract.main_text(row.html, tree) == article
        page = re.sub(r"(</?)(?:article|nav|footer)\b", r"\1div", re.sub(" class=\"[^\"]*\"", "", row.html))
        have, want = Counter(html_extract.main_text(page, tree).split()), Counter(article.split())
        right, kept, wanted = right + sum((have & want).values()), kept + sum(have.values()), wanted + sum(want.values())
    assert right >= 0.99 * kept and right >= 0.99 * wanted


def test_html_names_inside_an_article():
    tree, words = html_extract.trained(), "word " * 60
    page = f"<article><p>One first paragraph of this text stands here.</p><div class='search-results'>{words}</div><p class='alert'>Take care with this</p></article>"
    assert html_extract.main_text(page, tree) == f"One first paragraph of this text stands here.\n{words.strip()}\nTake care with this"
    page = f"<article><p>{words} <span class='ad'>buy <span>this</span> now</span></p><p>{words}</p></article>"
    assert html_extract.main_text(page, tree) == f"{words.strip()}\n{words.strip()}"


def test_html_of_unmatched_tags_takes_linear_time():
    took = []
    for n in (5_000, 40_000):
        began = time.process_time()
        html_extract.blocks("<div>" * n + "</span></b>" * n + "text" + "</section>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.5


def test_html_columns_with_clashing_names(spark):
    rows = [(1, "u", "<p>" + "word " * 30, "x", 7, True)]
    found = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long, kept boolean")).collect()
    assert [(r.page_id, r.n_chars) for r in found] == [(1, 149)]


def test_html_without_article():
    tree = html_extract.trained()
    long = "many words stand here in a row " * 5
    page = f"<div><a>Home</a></div><div><a>News</a></div><h1>The title of this page</h1><p>{long}</p><p>{long}</p><div><a>More</a> <a>Less</a></div>"
    assert html_extract.main_text(page, tree) == f"The title of this page\n{long.strip()}\n{long.strip()}"


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """FTRL-proximal one coordinate at a time, as published; the bias has no L1."""
    import math

    z, n = Counter(), Counter()

    def weight(i):
        shrink = 0 if i == "bias" else l1
        if abs(z[i]) <= shrink:
            return 0.0
        return -(z[i] - math.copysign(shrink, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for features, label in rows:
            at = [*features, "bias"]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for i in at:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_one_coordinate_at_a_time():
    import numpy as np

    rnd = random.Random(9)
    rows = []
    for i in range(120):
        label = int(i % 3 == 0)
        rows.append((np.unique([rnd.randint(0, 30) for _ in range(8)] + [40] * label), label))
    weights, bias = toxicity.train(rows, 6)
    seen = Counter(f for features, _ in rows for f in features.tolist())
    wanted = plain_ftrl([([f for f in features.tolist() if seen[f] >= toxicity.SEEN], label) for features, label in rows], 6, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2)
    assert abs(bias - wanted["bias"]) < 1e-9 and wanted[40] > 0
    assert all(abs(weights[i] - wanted.get(i, 0.0)) < 1e-9 for i in range(50))


def test_toxicity(spark, empty):
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        toxic = i % 4 == 0
        text = [rnd.choice(words) for _ in range(40)] + ([rnd.choice(["idiot", "scum", "moron"]) for _ in range(4)] if toxic else [])
        rows.append((i, " ".join(rnd.sample(text, len(text)))))
        labels += [(i, 1, int(toxic))] + [(i, 1, None)] * (i % 50 == 0)
    rows += [(9000, None), (9001, ""), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(docs, held).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    out = [r for r in found if r.held_out and r.doc_id < 9000]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in out) >= 0.97 * len(out)
    assert toxicity.toxicity(empty, held).collect() == []
    assert {r.score for r in toxicity.toxicity(docs, held.limit(0)).collect()} == {0.5}


def test_toxicity_with_clashing_columns_and_labels_that_repeat(spark):
    rows = [(i, "idiot scum moron here" if i % 3 == 0 else f"fine words w{i % 7} of sense", 0.5, True, 1) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, held_out boolean, toxic int")
    held = spark.createDataFrame([(i, int(i % 3 == 0), "x") for i in range(120)] * 2 + [(None, 1, "x"), (5, None, "x")], "doc_id long, toxic int, text string")
    found = toxicity.toxicity(docs, held).collect()
    assert len(found) == 120 and sum(r.predicted == int(r.doc_id % 3 == 0) for r in found) >= 118


def test_license_scan(docs, rows, spark, empty):
    notice = license_scan.NOTICES[0][1].split()
    more = [(900, "Apache-License,\nVERSION 2 and cc by nc"), (901, " ".join(["so"] + notice[:9] + ["really"] + notice[9:])), (902, "GNU General Public License"), (903, "under the mit licenses")]
    found = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(more, "doc_id long, text string")).collect()}
    assert (found[900].n_base, found[900].first_word, found[900].last_word, found[900].base_labels) == (2, 0, 5, "apache-2,cc-by-nc")
    assert (found[901].labels, found[901].n_base, found[901].first_word) == ("mit", 0, None) and 0.8 <= found[901].score < 1
    assert found[902].labels == found[903].labels == ""
    phrases = [(label, p.encode().split()) for label, p in license_scan.PHRASES]

    def brute(text):
        words = license_scan.words_of((text or "").encode())
        hits = [(i, label) for label, p in phrases for i in range(len(words)) if words[i : i + len(p)] == p]
        return len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[1] for h in hits}))

    assert got(license_scan.license_scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == Counter((r[0], *brute(r[1])) for r in rows)
    assert license_scan.license_scan(empty).collect() == []


def test_license_notices_with_one_word_changed(spark):
    rows, wanted = [], []
    for label, text in license_scan.NOTICES:
        words = [w.decode() for w in license_scan.words_of(text.encode())]
        for k in range(len(words)):
            for put in (["zzz"], ["zzz", words[k]], []):
                rows.append((len(rows), " ".join(["said", "before", *words[:k], *put, *words[k + 1 :], "and", "after"])))
                wanted.append(label)
    found = {r.doc_id: r.labels.split(",") for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert sum(label in found[i] for i, label in enumerate(wanted)) >= 0.95 * len(rows)
    # What else is said of a changed notice is a license of the same words without the one that was changed.
    assert sum(bool(set(found[i]) - {label, ""}) for i, label in enumerate(wanted)) <= 0.02 * len(rows)


def test_license_spans_beside_noise_and_short_phrases(spark):
    notice = license_scan.NOTICES[0][1]
    noise = "person obtaining a copy of this " * 30
    texts = [f"{noise} {notice} {noise}", noise, "licensed under the GNU General Public License, version 2", "licensed under the GNU Affero General Public License, version 3", "under license", "the mit", notice[:40]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = license_scan.license_scan(docs, [*license_scan.PHRASES, ("short", "the MIT"), ("one", "license")])
    assert {r.doc_id: (r.n_base, r.labels) for r in found.collect()} == {0: (0, "mit"), 1: (0, ""), 2: (1, "gpl-2,one"), 3: (1, "agpl-3,one"), 4: (1, "one"), 5: (1, "short"), 6: (0, "")}


TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_tokens_equal_the_tokenizer(rows):
    from tokenizers import Tokenizer

    rnd = random.Random(1)
    parts = ["'", "s", "re", "ll", "d", "ve", " ", "  ", "\n", "\t", "a", "é", "1", "!", "'s", "’", "中", "<|endoftext|>", "\x1c", "²", "ª"]
    texts = [r[1] or "" for r in rows] + ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(5000)]
    own, other = tokens.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    assert [x.tolist() for x in own.encode(texts)] == [x.ids for x in other.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, rows, empty):
    found = packing.pack(docs, TOKENIZER).collect()
    encoder = tokens.Encoder(TOKENIZER)
    want = Counter()
    for i, t, *_ in rows:
        ids = [*encoder.encode([t or ""])[0].tolist(), 0]
        first = (len(ids) - 1) % 2048 + 1
        for k, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first if not k else start + 2048]
            want[i, k, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))] += 1
    assert Counter(tuple(r[:5]) for r in found) == want
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(sequences) <= len(packing.best_fit(dict(Counter(r.length for r in found)), 2048)) + len(found)
    assert len(sequences) == -(-sum(r.length for r in found) // 2048)
    assert packing.pack(empty, TOKENIZER).collect() == []


def test_islands_beat_best_fit_where_it_fails(spark):
    """Three pieces fill a bin exactly, but best fit joins the longest with others; crossover and migration mend that."""
    import numpy as np

    rnd = random.Random(2)
    counts = Counter()
    for _ in range(60):
        a, b = rnd.randint(350, 470), rnd.randint(260, 330)
        counts.update([a, b, 1000 - a - b])
    assert packing.number(packing.best_fit(counts, 1000)) >= 66
    islands = [[packing.best_fit(counts, 1000), *(packing.shuffled_fit(counts, 1000, np.random.default_rng([i, 2])) for _ in range(3))] for i in range(6)]
    first = min(packing.number(x) for island in islands for x in island)
    for k in range(4):
        islands = [packing.evolve(islands[i] + islands[i - 1][:1], counts, 1000, 2 + 1000 * k + i) for i in range(6)]
    assert min(packing.number(x) for island in islands for x in island) < first
    found = packing.solve(spark, dict(counts), 1000)
    assert packing.number(found) <= 62
    held = Counter()
    for pattern, times in found:
        assert sum(pattern) <= 1000
        for n in pattern:
            held[n] += times
    assert held == counts


def test_crossover_keeps_all_pieces():
    import numpy as np

    counts = {1500: 9, 700: 20, 548: 9, 300: 14, 200: 3}
    rnd = np.random.default_rng(0)
    a, b = packing.best_fit(counts, 2048), packing.shuffled_fit(counts, 2048, rnd)
    for _ in range(20):
        child = packing.crossover(a, b, counts, 2048, rnd)
        held = Counter()
        for pattern, times in child:
            assert sum(pattern) <= 2048
            for n in pattern:
                held[n] += times
        assert held == Counter(counts)


def test_sharding(docs, rows, empty):
    found = sharding.shard_rows(docs, 8).collect()
    slim = sorted((r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows)
    assert Counter((r.doc_id, r.text_crc32, r["size"], r.shard, r.slot) for r in found) == Counter((*x, *sharding.place(i, len(slim), 8)) for i, x in enumerate(slim))
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    assert sharding.shard_rows(empty, 8).collect() == []


def test_sharding_numbers_over_ranges(spark, rows, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 20)
    more = [(None, f"text {i % 30}") for i in range(200)] + [(i % 5, f"other {i}") for i in range(150)]
    docs = spark.createDataFrame(more, "doc_id long, text string").repartition(5)
    found = sharding.shard_rows(docs, 8).collect()
    slim = sorted(((i is not None, i, zlib.crc32(t.encode()), len(t) + 1) for i, t in more), key=lambda x: (x[0], x[1] or 0, x[2]))
    assert Counter((r.doc_id, r.text_crc32, r["size"], r.shard, r.slot) for r in found) == Counter((*x[1:], *sharding.place(i, len(slim), 8)) for i, x in enumerate(slim))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_permutation_reaches_each_slot_once(n):
    assert sorted(sharding.place(i, n, 1)[1] for i in range(n)) == list(range(n))


def test_mixing(docs, rows, empty):
    found = mixing.mix(docs).collect()
    size = lambda t: len((t or "").encode().split())
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    names = ["a", "b", "c", None]
    wanted = dict(zip(names, mixing.targets([sizes[n] for n in names], [5, 2, 1, 5], sum(sizes.values()))))
    source = {(i, size(t)): s for i, t, _, s in rows}
    assert Counter((r.doc_id, r["size"], r.source_size, r.target) for r in found) == Counter((i, size(t), sizes[s], float(wanted[s])) for i, t, _, s in rows)
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id, r["size"]]] += r.taken
    # Documents are taken whole: one may be half its size too much or too little.
    longest = {n: max(size(t) for _, t, _, s in rows if s == n) for n in names}
    assert all(abs(taken[n] - wanted[n]) <= longest[n] / 2 for n in names)
    assert got(mixing.mix(docs)) == Counter(tuple(r) for r in found)
    assert mixing.mix(empty).collect() == []


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 else ["a", "b"] if i % 2 else ["b"]) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    found = mixing.mix(docs, F.col("held"), (1, 1)).collect()
    assert abs(sum(r.taken for r in found) - 900) <= 20 and max(r.taken for r in found) <= 30


def test_mixing_in_parts_equals_one_flow(docs, monkeypatch, spark):
    whole = got(mixing.mix(docs))
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 2)
    assert got(mixing.mix(docs)) == whole
    rows = [(i, "w " * (5 + i % 7), [f"s{i % 40}"] if i % 9 else ["x", "y"]) for i in range(400)] + [(1000 + i, "w " * 4, ["y"]) for i in range(9)]
    held = spark.createDataFrame(rows, "doc_id long, text string, held array<string>")
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    parts = got(mixing.mix(held, F.col("held")))
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 100)
    assert got(mixing.mix(held, F.col("held"))) == parts


def test_mixing_of_more_sources_than_the_driver_plans_for(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.lit("some words to take").alias("text"), F.concat(F.lit("s"), F.col("id") % 4500).alias("source"))
    found = mixing.mix(docs).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.sum("taken").alias("taken")).first()
    assert found.n == 9000 and abs(found.taken - found["size"]) <= 0.15 * found["size"]


def test_flow_repeats_only_when_fresh_words_are_short():
    assert mixing.flow([(100, [0]), (20, [1]), (10, [0, 1])], [60, 60]) == [60, 40, 20]
    assert mixing.flow([(100, [0]), (20, [1])], [60, 70]) == [60, 60]
    assert mixing.flow([], []) == []


def test_null_ids(spark):
    long = "a line of more than forty code points that all of these documents hold"
    rows = [(None, long, None, None)] * 2 + [(i, long.upper() if i % 2 else long, "en", "s") for i in range(6)] + [(None, "alone here", "en", "s"), (None, None, None, None)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    dedup = exact_dedup.exact_dedup(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in dedup) == Counter([(i, 5, 8) for i in (None, None, *range(6))] + [(None, None, 1)] * 2)
    assert [r.doc_id for r in dedup if r.kept and r.group_size == 8] == [5]
    lines = Counter((r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(docs).collect())
    assert lines == Counter([(None, 1)] * 2 + [(i, int(i != 5)) for i in range(6)] + [(None, 0)] * 2)
    assert all(r.held_out for r in toxicity.toxicity(docs, spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect() if r.doc_id is None)
    for found in (simhash.near_duplicates(docs), quality.quality(docs), license_scan.license_scan(docs), packing.pack(docs, TOKENIZER), sharding.shard_rows(docs), mixing.mix(docs)):
        assert found.count() == len(rows)
