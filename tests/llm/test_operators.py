"""Operators against brute force, on small tables with awkward rows."""

import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import components, exact_dedup, html_text, language_id, line_dedup, lm_scoring, mixing, near_join, neighbours, packing, store, warc

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_id long, n int, tokens string, key string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def awkward():
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, copies, near copies, clashing columns."""
    rng = random.Random(7)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"W{i}" for i in range(400)]
    base, passage = [rng.choice(vocabulary) for _ in range(120)], [rng.choice(vocabulary) for _ in range(50)]
    texts = [None, "", "  \n\t ", "A", "a", "one two", "... --- !!!", "x" * 20_000, " ".join(rng.choice(vocabulary) for _ in range(6000))]
    for _ in range(60):
        t = list(base)
        for _ in range(rng.choice([0, 0, 1, 3, 6, 9])):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append(" ".join(t[:60]) + "\n" + " ".join(t[60:]))
    for _ in range(40):
        t = [rng.choice(vocabulary) for _ in range(rng.choice([3, 15, 30, 60]))]
        texts.append(" ".join(t[:9]) + "\n" + " ".join(passage) + "\n" + " ".join(t[9:]))
    rows = [(i, t, rng.choice(["en", "de", "fr", None]), rng.choice(["a", "a", "a", "b", None]), None, 1, None, "t", None) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, "nobody knows this one", "en", None, None, 2, 3, None, "k")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/d"
    spark.createDataFrame(awkward(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    got = packing.pack(docs, packing.default_tokenizer()).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    bins = defaultdict(list)
    pieces = Counter()
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.start, r.length, r.ids_crc32] += 1
    want = Counter()
    for row in awkward():
        ids = np.array([*tok.encode(row[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        start, size = 0, len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        while start < len(ids):
            want[row[0], start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            start, size = start + size, 1024
    assert pieces == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r.length for r in got) / 1024) + 1
    assert packing.pack(nothing, packing.default_tokenizer()).count() == 0


def test_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    tok.encode_special_tokens = True
    texts = ["I'm  here\n\n <|endoftext|> x", " 　 é́ß 12³ ½", "日本語 🙂🙂 \t\r\n", "a" * 5000, "'s'S don't", "\x00\x01"]
    for t, ids in zip(texts, packing.ByteBpe(packing.default_tokenizer()).ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing_finds_added_tokens_as_the_library_does(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, f"{end}{end}", f"  \n {end}\n\n x", f"it{end}'s", f"é <|endoftext| > {end[:-1]}", f"<{end}> {'word ' * 700}{end}{'other ' * 700}"]
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        start, size = 0, len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        while start < len(ids):
            want[i, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            start, size = start + size, 1024
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), packing.default_tokenizer()).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got) == want


def test_best_fit_runs():
    rng = random.Random(1)
    for _ in range(50):
        capacity = rng.choice([8, 64])
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        bins, seen = defaultdict(list), defaultdict(list)
        for length, rank, k, first, offset in packing.best_fit_runs(counts, capacity):
            seen[length] += range(rank, rank + k)
            for i in range(k):
                bins[first + i].append((offset, length))
        assert {n: sorted(v) for n, v in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
        assert all(sum(n for _, n in b) <= capacity and len({o for o, _ in b}) == len(b) for b in bins.values())


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).astype(np.float32) * rng.uniform(0.5, 2, size=(400, 1)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(400, None), (420, [0.0] * 16), (440, [float("nan")] * 16), (460, [1.0, None] + [0.0] * 14), (None, [1.0] * 16), (480, [1.0] * 3)]
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    x, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hits += len({i for i, _ in found} & set(np.lexsort((np.arange(400), -s))[:20].tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(v == pytest.approx(s[i], abs=1e-12) for i, v in found)
    assert hits / 400 >= 0.9
    few = neighbours.nearest(spark.createDataFrame(rows[:5], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert neighbours.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<float>").limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_of_doubles_and_repeated_ids(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8)) * (1 + 1e-12)
    rows = [(i // 2 if i < 10 else i, v.tolist(), "clash") for i, v in enumerate(x)]  # ids 0 to 4 are there twice
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row string")
    got = defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 20 == 0, k=59).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    asked = [i for i, r in enumerate(rows) if r[0] % 20 == 0]
    want = defaultdict(list)
    for q in asked:
        order = sorted((-float(x[q] @ x[i]), rows[i][0]) for i in range(60) if i != q)
        want[rows[q][0]] += [(k + 1, i, -s) for k, (s, i) in enumerate(order)]
    assert set(got) == set(want) == {0, 20, 40}
    for q in want:
        a, b = sorted(got[q]), sorted(want[q])
        assert Counter(f[:2] for f in a) == Counter(f[:2] for f in b)
        assert sorted(f[2] for f in a) == pytest.approx(sorted(f[2] for f in b), abs=1e-14)


def test_exact_dedup(docs, nothing):
    groups = defaultdict(list)
    for row in awkward():
        groups[(row[1] or "").translate(LOWER)].append(row[0])
    want = Counter((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = exact_dedup.exact_groups(docs).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_chunks_join_to_the_text(spark):
    texts = ["", "a b. " * 3000, "x" * 10_000, "🙂 é\n" * 2000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    for r in df.collect():
        assert "".join(r.c) == r.text and all(len(c) <= 4096 for c in r.c)


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice">We bake</div><nav><li>Home</ul></nav>
    <article><header><h1>Head &amp; <i>tail</i></h1></header><p>One&nbsp; two<br>three<p>Four<script>var x="</p>";</script><div class=comments><p>First!</div><aside>Ad</aside><ul><li>a<li>b</ul></article><footer>&copy;</footer></body></html>"""
    assert html_text.main_text(page, None) == "Head & tail\nOne two three\nFour\na\nb"
    assert html_text.main_text(None, None) == html_text.main_text("", None) == html_text.main_text("<p> </p>", None) == ""


def test_html_of_any_shape():
    text = html_text.main_text
    assert text("<div>" * 100_000 + "in" + "</div>" * 100_000 + "<p>out", None) == "in\nout"
    assert text("".join(f"<div>{i}" for i in range(1000)) + "".join(f"</div>{i}" for i in range(1000)), None) == "\n".join(map(str, [*range(1000), *range(1000)]))
    deep = "<section>" * 500
    assert text(deep + "a <b>b</b> c<div>d<i> e</i></div>f<nav>off</nav><div></div>g", None) == "a b c\nd e\nf\ng"
    assert text(deep + "<p>one<br>two<p>three" + "</section>" * 500 + "<p>four", None) == "one two\nthree\nfour"
    assert text("<i>" * 50_000 + "x" + "</i>" * 50_000 + "</b>" * 50_000 + "<p>y", None) == "x\ny"
    assert text("<p><button>" + "<div>" * 50_000, None) == ""
    assert text("a<![foo bar]>b<![CDATA[c]]>d<!x><?y><![if !IE]>e<![endif]>", None) == "abde"
    assert text("<p>a&#" + "0" * 6000 + "65;&#" + "9" * 6000 + ";b", None) == "aA\ufffdb"
    assert text("<p>a</div></p></ul><td>b<a href='", None).startswith("a")
    page = "<div>" * 900 + "same" + "</div>" * 900 + "<p>{}</p>"
    shapes = [html_text.page_shape(page.format(i))[0] for i in range(4)]
    template = shapes[0]
    for s in shapes[1:]:
        template = html_text.merge(html_text.bare(template), s)
    assert text(page.format(9), json.loads(json.dumps(html_text.bare(template)))) == "9"


def test_html_of_no_page(spark):
    assert html_text.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_templates(spark):
    rows = [(i, "http://h.example/x", f"<div>Always here</div><p>text {i}</p><p>more</p><div><span>Bye</span></div>") for i in range(6)] + [(6, None, "<p>alone</p>"), (7, "u", None), (8, "http://one.example", "<p>same</p>"), (8, "http://one.example", "<p>same</p>")]
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("template", F.lit(1))).collect())
    assert got == sorted([*((i, f"text {i}\nmore", len(f"text {i}\nmore")) for i in range(6)), (6, "alone", 5), (7, "", 0), (8, "same", 4), (8, "same", 4)])


def test_warc(spark, tmp_path):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u", f"x\r\n\r\n{magic}"), (2, "u\r\nContent-Length: 0", None), (3, None, ""), (4, "u", magic), (5, "u", "é"), (6, "u", "é"), (7, "u", "y" * 300_000), (None, "u", "é"), (9, "u", magic * 3), (5, "u", "é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    df.repartition(3).write.parquet(f"file://{tmp_path}/pages")
    df = spark.read.parquet(f"file://{tmp_path}/pages")
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    want = Counter()
    for payload, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, -(i or 0)))):
            want[i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if k else "response", best if k else None] += 1
    assert Counter(tuple(r) for r in warc.round_trip(spark, df).collect()) == want
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_language(docs, nothing, spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identify(table).collect()}
    truth = {r.doc_id: r.lang for r in table.collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert sum(got[i].lang_pred == truth[i] for i in held) / len(held) >= 0.9
    odd = language_id.identify(docs).collect()
    assert len(odd) == len(awkward()) and all(0 <= r.score <= 1 for r in odd)
    none = {row[0] for row in awkward() if not re.search(r"[^\W\d_]", row[1] or "")}
    assert {r.doc_id for r in odd if r.lang_pred == "und"} == none
    assert language_id.recognised(docs).columns == docs.columns
    assert language_id.identify(nothing).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((row[0], len(WORD.findall(row[1] or ""))) for row in awkward())
    sizes = Counter()
    for row in awkward():
        sizes[row[3]] += len(WORD.findall(row[1] or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight, limit, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {s: 2 * sizes[s] for s in names}, 1.5 * sum(sizes.values())
    target, full = {}, set()
    while True:
        level = (total - sum(limit[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * level > limit[s]}
        if not over:
            break
        full |= over
    target = {sizes[s]: limit[s] if s in full else weight[s] * level for s in names}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source_size]) and r.taken <= 2 * r["size"]
        taken[r.source_size] += r.taken
    assert all(abs(taken[s] - t) <= 60 for s, t in target.items())
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect()))
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.copies for r in got)
    assert mixing.mix(nothing).count() == 0


@pytest.mark.parametrize("scale", [1.0, 0.01, 0.001, 1e-200, 1e200, None])
def test_mixing_draws_by_key(spark, scale):
    rows = [(i if i % 7 else 7, f"{'w ' * (1 + i % 5)}{i % 3}", "ab"[i % 9 == 0]) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    quality = F.lit(scale).cast("double") if scale is None else F.when(F.col("doc_id") % 11 == 0, float("nan")).when(F.col("doc_id") % 13 == 0, -1.0).otherwise((F.col("doc_id") % 4 + 1) * F.lit(scale))
    got = [r.asDict() for r in mixing.mix(table, quality=quality, row=F.monotonically_increasing_id()).collect()]
    h = {r.row_id: r for r in table.select(F.monotonically_increasing_id().alias("row_id"), "source", F.xxhash64(F.lit(7), "doc_id").alias("h"), F.xxhash64("text").alias("tie"), quality.alias("q")).collect()}
    for source in "ab":
        mine = [r | h[r["row_id"]].asDict() for r in got if h[r["row_id"]].source == source]
        for r in mine:
            u, q = (((r["h"] % 2**64) >> 11) + 0.5) / 2**53, r["q"]
            r["key"] = -math.log(u) / q if q is not None and q > 0 else math.inf
        mine.sort(key=lambda r: (r["key"], r["doc_id"], r["tie"], r["row_id"]))
        total = sum(r["size"] for r in mine)
        epochs = int(mine[0]["target"] / total + 1e-12)
        rest, want, i = mine[0]["target"] - epochs * total, [], 0
        while i < len(mine) and mine[i]["size"] <= rest:
            rest, i = rest - mine[i]["size"], i + 1
        more = min(((abs(r["size"] - rest), j) for j, r in enumerate(mine) if j >= i and abs(r["size"] - rest) < rest), default=(0, None))[1]
        want = [epochs + (j < i or j == more) for j in range(len(mine))]
        assert [r["copies"] for r in mine] == want


def test_columns_may_have_names_that_operators_use(spark):
    names = ["_row", "__row", "_copies", "_copy", "_lang_pred", "_lang_score", "row_id"]
    rows = [(i, f"the words of text {i} are here and they are all in one line", "en", "s", *[f"{n}{i}" for n in names]) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    for work in (exact_dedup.kept_rows, near_join.kept_rows, mixing.mixed_rows, line_dedup.clean, language_id.recognised):
        out = work(table)
        assert out.columns == table.columns
        found = out.collect()
        assert found and all(r[n] == f"{n}{r.doc_id}" for r in found for n in names)


def test_lines(docs, nothing):
    order = sorted(enumerate(awkward()), key=lambda e: (e[1][0] is not None, e[1][0] or 0))
    earlier, want = [], Counter()
    for _, row in order:
        lines, removed = (row[1] or "").split("\n"), []
        for k, line in enumerate(lines):
            s = frozenset(words(line))
            if s and any(100 * len(s & t) >= 75 * len(s | t) for t in earlier):
                removed.append(k)
            if s:
                earlier.append(s)
        want[row[0], len(lines), tuple(removed)] += 1
    got = line_dedup.removed_lines(docs).collect()
    assert Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in got) == want
    assert line_dedup.clean(docs).columns == docs.columns
    assert line_dedup.removed_lines(nothing).count() == 0


def test_a_line_that_goes_still_takes_a_later_line_of_its_document(spark, tmp_path):
    """Line 0 of document 1 goes for document 0 and is the only match of the shorter line 1."""
    w = [f"w{i}" for i in range(20)]
    rows = [(0, " ".join([*w, "more"])), (1, " ".join(w) + "\n" + " ".join(w[:15]))]
    path = f"file://{tmp_path}/d"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(path)
    assert {r.doc_id: r.removed for r in line_dedup.removed_lines(spark.read.parquet(path)).collect()} == {0: [], 1: [0, 1]}


def test_lines_are_offered_the_earliest_lines_of_all_parts(spark):
    token = (line_dedup.ALONE + line_dedup.MANY) << 56
    nodes = spark.createDataFrame([(k, 8, 0, 0, (k,), [token]) for k in (3, 9)], "k1 long, n int, mask0 long, mask1 long, at struct<doc_id long>, prefix array<long>")
    nodes = nodes.withColumn("prefix", F.array_repeat(F.element_at("prefix", 1), 3))
    assert (3, 9) in {tuple(r) for r in line_dedup.first_offers(nodes, 75).collect()}


def test_leaders_of_frequent_tokens_are_not_multiplied(spark):
    """A leader row is joined once, not once for each part, and what counts as frequent can follow the input's size."""
    token = (line_dedup.ALONE + line_dedup.MANY) << 56
    nodes = spark.createDataFrame([(k, 8, 0, 0, (k,), [token] * 3) for k in range(40)], "k1 long, n int, mask0 long, mask1 long, at struct<doc_id long>, prefix array<long>")
    offers = line_dedup.first_offers(nodes, 75)
    assert "sequence" not in offers._jdf.queryExecution().analyzed().toString()
    assert sorted(r.b for r in offers.collect()) == list(range(40))
    assert line_dedup.first_offers(nodes, 75, F.lit(line_dedup.ALONE + line_dedup.MANY + 1)).count() == 0


def test_words_are_split_once_for_counting_and_ordering(spark, tmp_path, monkeypatch):
    """A word that one line alone has, however often, is alone; levels cover all counters; the texts are not read again for the order."""
    path = f"file://{tmp_path}/d"
    spark.createDataFrame([(0, "x x x y"), (1, "y z\ny")], "doc_id long, text string").write.parquet(path)
    split, times = line_dedup.split_words, []
    monkeypatch.setattr(line_dedup, "split_words", lambda line: times.append(1) or split(line))
    told = line_dedup.worded(spark.read.parquet(path))
    levels, top = line_dedup.rarity_table(told)
    level = lambda w: F.get("levels", line_dedup.bucket(F.xxhash64(F.lit(w)))).cast("int")
    got = levels.select(F.size("levels"), level("x"), level("y"), level("z")).first()
    assert tuple(got) == (1 << line_dedup.BITS, line_dedup.ALONE, line_dedup.ALONE + 3, line_dedup.ALONE)
    assert top.first()[0] == line_dedup.ALONE + 3
    assert len(times) == 1


def test_entries_meet_without_a_sort(spark):
    nodes = spark.createDataFrame([(k, 8, 0, 0, (k,), [1, 2, 3], True) for k in (3, 9)], "k1 long, n int, mask0 long, mask1 long, at struct<doc_id long>, prefix array<long>, asks boolean")
    plans, write = [], store.table

    def seen(df, label, parts=None):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label, parts)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(store, "table", seen)
        assert {(r.a, r.b) for r in line_dedup.all_offers(nodes, 75).collect()} == {(3, 9)}
    assert all("ShuffledHashJoin" in plan and "SortMergeJoin" not in plan for label, plan in plans if label == "part")


@pytest.mark.parametrize("percent", [75, 90])
def test_rare_tokens_have_one_entry_for_each_role(spark, percent):
    for level, classes in ((line_dedup.RARE - 1, {0}), (line_dedup.RARE, None)):
        rows = [(n, n, 0, 0, None, [(line_dedup.ALONE + level << 56) + i for i in range(n - -(-n * percent // 100) + 1)]) for n in range(1, 100)]
        nodes = spark.createDataFrame(rows, "k1 long, n int, mask0 long, mask1 long, at struct<doc_id long>, prefix array<long>")
        shorter = {(r.n, r.ahead): r.key ^ r.token for r in line_dedup.shorter_entries(nodes, percent).collect()}
        all_longer = [(r.n, r.ahead, r.key ^ r.token) for r in line_dedup.longer_entries(nodes, percent).collect()]
        longer = set(all_longer)
        assert len(longer) == len(all_longer)
        assert {key for _, _, key in longer} == classes if classes else len({key for _, _, key in longer}) > 5
        for n in range(1, 100):
            for m in range(n, min(99, 100 * n // percent) + 1):
                both = -(-(n + m) * percent // (100 + percent))
                assert (m, both, shorter[n, both]) in longer


def test_folded_texts_are_equal_only_if_lower_case_makes_them(spark):
    texts = [c + "x" for c in map(chr, [*range(1, 0x600), 0x1E00, 0x20AC, 0x3042, 0xD55C, 0xFF21, 0x1F600, 0x10400])] + ["A É", "a É", "a é", "ÀB", "àb", "Àb", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", line_dedup.folded(F.col("text")).alias("folded")).collect()
    assert len({r.folded for r in rows}) == len({r.text.translate(LOWER) for r in rows}) == len({(r.folded, r.text.translate(LOWER)) for r in rows})


def test_pairs_of_lines_known_to_go_are_not_verified(spark):
    long3 = "a long, b long, same boolean, count long"
    pairs = spark.createDataFrame([(1, 2, False, 1), (1, 3, False, 1), (3, 2, True, 1)], long3)
    sets = spark.createDataFrame([(k, k, (k, 0, 0)) for k in (1, 2, 3)], "k1 long, k2 long, at struct<doc: long, text_hash: long, pos: int>")
    turned = line_dedup.in_turn(pairs, sets)
    assert sorted((r.a, r.b) for r in turned.collect()) == [(1, 2), (1, 3), (2, 3)]
    known = spark.createDataFrame([(2, 2)], "k1 long, k2 long")
    assert sorted((r.a, r.b) for r in line_dedup.still_open(turned, sets, known).collect()) == [(1, 3), (2, 3)]


@pytest.mark.parametrize("percent", [50, 75, 90, 100])
def test_lines_that_can_match_meet_under_a_key(spark, percent):
    """The last of the tokens that may be the first common one has an entry in either role, and both have the same class."""
    rows = [(n, n, 0, 0, None, list(range(n - -(-n * percent // 100) + 1))) for n in range(1, 100)]
    nodes = spark.createDataFrame(rows, "k1 long, n int, mask0 long, mask1 long, at struct<doc_id long>, prefix array<long>")
    shorter = {(r.n, r.ahead): r.key ^ r.token for r in line_dedup.shorter_entries(nodes, percent).collect()}
    longer = {(r.n, r.ahead, r.key ^ r.token) for r in line_dedup.longer_entries(nodes, percent).collect()}
    for n in range(1, 100):
        for m in range(n, min(99, 100 * n // percent) + 1):
            both = -(-(n + m) * percent // (100 + percent))
            assert (m, both, shorter[n, both]) in longer
    assert len(longer) < 2 * sum(len(r[-1]) for r in rows)


def test_language_model(docs, nothing):
    rows = [(row[0], [*words(row[1]), None]) for row in awkward()]
    held = [i is None or zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    one, two = Counter(), Counter()
    for (_, t), out in zip(rows, held, strict=True):
        if not out:
            one.update(t)
            two.update(zip([0, *t], t, strict=False))
    n, space = sum(one.values()), sum(one.values()) + 0.1 * (len(one) + 1)
    seen = lambda h: one[None] if h == 0 else one[h]
    want = sorted((str(i), out, len(t), sum(one[w] > 0 for w in t), n, round(sum(math.log10((one[w] + 0.1) / space) for w in t), 5), round(sum(math.log10((two[h, w] + 20 * (one[w] + 0.1) / space) / (seen(h) + 20)) for h, w in zip([0, *t], t, strict=False)), 5)) for (i, t), out in zip(rows, held, strict=True))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in lm_scoring.score(docs).collect())
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], abs=2e-5)
    assert lm_scoring.score(nothing).count() == 0


@pytest.mark.parametrize("piece", [1, 3, 4096])
def test_automaton_reads_word_by_word(monkeypatch, piece):
    monkeypatch.setattr(lm_scoring, "PIECE", piece)
    rng = random.Random(piece)
    words, strength = 6, 20.0
    texts = [[rng.randrange(words) for _ in range(rng.choice([1, 2, 9, 40]))] for _ in range(30)]
    c1 = np.array([5.0, 0, 2, 9, 1, 7])  # word 1 was never learned
    p1 = (c1 + 0.1) / (c1.sum() + 0.7)
    start = words + 1
    counts = {(s, w): float(rng.choice([0, 0, 1, 3])) for s in [1, 3, 4, 5, 6, start] for w in (0, 2, 3, 4, 5)}
    state, word = (np.array(x) for x in zip(*counts, strict=True))
    automaton = lm_scoring.Automaton.of_counts(c1, p1, 11.0, state, word, np.array(list(counts.values())), strength)
    want = []
    for text in texts:
        at, total = start, 0.0
        for w in text:
            seen = 11.0 if at == start else c1[at - 1] if at else 0.0
            pair = counts.get((at, w), 0.0)
            total += math.log10((pair + strength * p1[w]) / (seen + strength))
            at = w + 1 if c1[w] else 0
        want.append(total)
    assert automaton.read(np.array(sum(texts, [])), np.array([len(t) for t in texts])) == pytest.approx(want)
    assert len(automaton.read(np.array([], dtype=np.int64), np.array([], dtype=np.int64))) == 0


def test_near_join(docs, nothing):
    sets = []
    for row in awkward():
        w = words(row[1])
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                top[max(root(a), root(b))] = min(root(a), root(b))
    least = defaultdict(list)
    for i, row in enumerate(awkward()):
        least[root(i)].append(row[0])
    want = Counter((row[0], len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None)) for i, row in enumerate(awkward()))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_join.near_groups(docs).collect()) == want
    kept = near_join.kept_rows(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert near_join.near_groups(nothing).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(x, x + 1) for x in range(1000, 1100)]
    top = {x: x for p in pairs for x in p}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect())
    assert all(got[x] == root(x) for a, b in pairs if a != b for x in (a, b))


@pytest.mark.parametrize(
    "work",
    [exact_dedup.kept_rows, near_join.kept_rows, mixing.mixed_rows, line_dedup.removed_lines, line_dedup.clean, lambda d: warc.round_trip(d.sparkSession, d.selectExpr("doc_id AS page_id", "source AS url", "text AS html"))],
    ids=["exact", "near", "mixed", "removed_lines", "clean", "warc"],
)
def test_rows_keep_their_numbers_when_files_are_split_anew(spark, tmp_path, monkeypatch, work):
    path = f"file://{tmp_path}/d"
    spark.createDataFrame(awkward(), SCHEMA).repartition(12).write.parquet(path)
    docs, split, write = spark.read.parquet(path), "spark.sql.files.maxPartitionBytes", store.table
    steady = Counter(tuple(map(str, r)) for r in work(docs).drop("row_id").collect())

    def then_split(df, label, parts=None):
        out = write(df, label, parts)
        if label in {"recipes", "dropped", "sizes", "lines", "responses"}:
            spark.conf.set(split, "1m")  # under the cost of opening a file, so each file is a partition from here on
        return out

    monkeypatch.setattr(store, "table", then_split)
    try:
        assert Counter(tuple(map(str, r)) for r in work(docs).drop("row_id").collect()) == steady
    finally:
        spark.conf.unset(split)


def test_rows_with_letters_stay_where_no_language_can_be_learned(docs):
    kept = language_id.recognised(docs.withColumn("lang", F.lit(None).cast("string")))
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(row[:2] for row in awkward() if re.search(r"[^\W\d_]", row[1] or ""))
