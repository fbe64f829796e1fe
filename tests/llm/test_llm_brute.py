"""Operators that SQL can't express against plain versions, round trips and held-out accuracy."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import decontamination, html_extraction, jaccard_join, packing, quality_classifier, suffix_dedup, toxicity, url_filters
from reelframe.llm.common import connected_components, table
from reelframe.llm.queries import ORACLES, QUERIES
from tests.llm.models import LOWER, WORD, components, without_repeats
from tests.support import assert_same

DOCS = "doc_id long, text string"


def noisy_docs(seed=1):
    """A family of near copies (dense and sparse edits), exact copies, shared passages, and short, empty and null texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    base = [word() for _ in range(80)]
    passage = " ".join(word() for _ in range(60))
    rows, k = [], 100
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
        k += 1
    rows += [(k + i, rows[3][1].upper()) for i in range(5)]
    k += 5
    rows += [(k + i, " ".join(word() for _ in range(r.randint(5, 90))) + "\n" + passage + " ..." * (i % 3)) for i in range(20)]
    k += 20
    rows += [(k, "one two"), (k + 1, "One  two"), (k + 2, ""), (k + 3, None), (k + 4, " \t\n"), (k + 5, passage[:49]), (k + 6, passage[:50]), (k + 7, "é" * 40), (k + 8, "é" * 40 + "x")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_native_queries_equal_their_sql(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_components_of_edges(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 50: 40, 40: 40, 45: 40}


@pytest.mark.parametrize("block", [2_000_000, 1_000, 150])
def test_jaccard_components(spark, block):
    rows = noisy_docs()
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3), block=block)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(rows)


def test_texts_that_share_a_phrase_are_no_family(spark, monkeypatch):
    """Each text is made of passages that it shares with four others, one with each; only the two near copies are compared."""
    words = {i: [f"p{min(x)}_{max(x)}_{k}" for x in ((i, (i + d) % 60) for d in (-2, -1, 1, 2)) for k in range(40)] for i in range(60)}
    words[200] = [*words[7][:-1], "other"]
    rows = [(i, " ".join(w)) for i, w in words.items()]
    families, links = [], jaccard_join.family_links
    monkeypatch.setattr(jaccard_join, "family_links", lambda family, *a, **b: families.append(sorted(r.rep for r in family.collect())) or links(family, *a, **b))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components(rows)
    assert families == [[7, 200]]


def test_blocks_short_and_long(spark):
    """Clusters of near copies about the size from which a block is one family, in few and many tasks."""
    r = np.random.default_rng(5)
    rows = []
    for size in (2, 3, 15, 16, 17, 18, 40):
        base = [f"c{size}_{k}" for k in range(60)]
        rows += [(len(rows) + j, " ".join([*base[: 60 - r.integers(0, 4)], *(f"x{size}_{j}_{k}" for k in range(r.integers(0, 9)))])) for j in range(size)]
    want = components(rows)
    for parts in (1, 3, 50):
        got = jaccard_join.jaccard_components(spark.createDataFrame(rows, DOCS).repartition(parts), block=2_000)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == want


def test_sketches_never_lose_a_link():
    """Bits in which two sketches differ, the wider one folded, are no more than the shingles in which the sets do, and nearly as many as buckets tell for unlike sets."""
    r = np.random.default_rng(6)
    for _ in range(300):
        n, m = r.integers(1, 400, 2)
        both = r.integers(0, min(n, m) + 1)
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:both], r.integers(0, 1 << 63, m - both, dtype=np.uint64)]))
        x, y = (np.frombuffer(v, np.uint8) for v in jaccard_join._sketches(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).to_pylist())
        w = min(len(x), len(y))
        differ = int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, w)) ^ np.bitwise_xor.reduce(y.reshape(-1, w))).sum())
        assert differ <= len(np.setxor1d(a, b))
        assert both or min(n, m) < 50 or 9 * differ > n + m


def _classes(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return [root(i) for i in range(n)]


def _near_sets(r, n, size, drop, add):
    base = np.arange(size, dtype=np.uint64)
    return [np.unique(np.concatenate([np.delete(base, r.integers(0, size, r.integers(0, drop))), r.integers(1000, 1000 + size, r.integers(0, add)).astype(np.uint64)])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "drop", "add"), [(3, 12, 9), (4, 30, 30), (5, 60, 4), (6, 3, 40)])
@pytest.mark.parametrize("sides", [False, True])
def test_walk_over_links(seed, drop, add, sides):
    """Components of the walk against all pairs, for sets alike and less alike, on two sides and with known components."""
    r = np.random.default_rng(seed)
    sets = _near_sets(r, 60, 100, drop, add)
    left, right = (np.arange(60) % 2 == 0, np.arange(60) % 2 == 1) if sides else (np.ones(60, bool),) * 2
    known = np.where(np.arange(60) < 10, 0, np.arange(60))
    same = [(0, i) for i in range(10)]
    want = [(a, b) for a in range(60) for b in range(a) if ((left[a] & right[b]) | (left[b] & right[a])) and 100 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    for component, extra in ((np.arange(60), []), (known, same)):
        found = jaccard_join.linked_sets(sets, left, right, component, 80, 100)
        assert set(found) <= {(a, b) for x in want for a, b in (x, x[::-1])}
        assert _classes(60, found + extra) == _classes(60, want + extra)


def test_walk_over_many_near_copies_is_quick():
    import time

    r = np.random.default_rng(1)
    sets = _near_sets(r, 8000, 100, 12, 9)
    began = time.perf_counter()
    assert len(jaccard_join.linked_sets(sets, np.ones(8000, bool), np.ones(8000, bool), np.arange(8000), 80, 100)) == 7999
    assert time.perf_counter() - began < 5


def test_words_of_one_pattern_differ(spark):
    """A Thue-Morse word and its mirror, which hash alike in any polynomial modulo 2**64."""
    x = "a"
    while len(x) < 1024:
        x += x.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, x), (2, x.translate(str.maketrans("ab", "ba"))), (3, x), (4, "c" * 70_000), (5, "c" * 70_001), (6, "c" * 70_000)], DOCS)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 4}


def test_suffix_dedup(spark):
    rows = noisy_docs(2)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == without_repeats(rows)


def test_refinement_of_windows():
    """Windows of stretches of bytes against a look at all pairs."""
    r = random.Random(8)
    for _ in range(30):
        length = r.randint(28, 60)
        parts = [bytes(r.choice(b"ab") for _ in range(r.randint(length, length + 25))) for _ in range(4)]
        parts += [p[: len(p) // 2] + parts[0][len(p) // 2 :] for p in parts] + [parts[1], parts[2][1:]]
        parts = [p for p in parts if len(p) >= length]
        doc = np.array([r.randint(1, 5) for _ in parts])
        bits = suffix_dedup.repeated_windows(np.frombuffer(b"".join(parts), np.uint8), np.array([len(p) for p in parts]), doc, length)
        for i, p in enumerate(parts):
            for w in range(len(p) - length + 1):
                want = any(doc[j] < doc[i] and p[w : w + length] in q for j, q in enumerate(parts))
                assert bool(int(bits[i]) >> w & 1) == want


def test_suffix_dedup_of_a_common_line(spark):
    """A line of 41 bytes in every text: its common q-grams are the anchors of few texts, not of most, and the result is exact."""
    r = random.Random(12)
    line = "one line of forty-one bytes in every text"
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    rows = [(k, " ".join(word() for _ in range(20)) + "\n" + line + "\n" + " ".join(word() for _ in range(20))) for k in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    packed, _ = suffix_dedup.common_grams(docs)
    data = "".join(t for _, t in rows).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for _, t in rows])
    runs = suffix_dedup.Runs(np.frombuffer(data, np.uint8), offsets, 50, np.unpackbits(packed).view(bool))
    assert np.unique(runs.anchor, return_counts=True)[1].max() <= 64 and len(line) == 41
    plain = suffix_dedup.Runs(np.frombuffer(data, np.uint8), offsets, 50, np.zeros(1 << suffix_dedup.GRAM_BITS, bool))
    assert np.unique(plain.anchor, return_counts=True)[1].max() > 300
    rows += [(1000, rows[5][1][100:190] + rows[7][1][60:130])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == without_repeats(rows)


def test_suffix_dedup_in_pieces(spark, monkeypatch):
    """Long texts are looked at in pieces; their results don't depend on where the pieces end."""
    rows = noisy_docs(3)
    rows = [*rows, (1, " ".join(t or "" for _, t in rows[::2])), (5000, " ".join(t or "" for _, t in rows[1::2])), (5001, "x" * 700), (5002, "x" * 300)]
    common = np.zeros(1 << suffix_dedup.GRAM_BITS, bool)
    data = np.frombuffer(rows[-4][1].encode(), np.uint8)
    whole = suffix_dedup.Runs(data, np.array([0, len(data)]), 50, common)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 333)
    pieces = suffix_dedup.Runs(data, np.array([0, len(data)]), 50, common)
    windows = lambda x: sorted((int(s) + k, int(a)) for s, n, a in zip(x.start, x.count, x.anchor) for k in range(n))
    assert windows(whole) == windows(pieces) and len(pieces.start) > len(whole.start)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, DOCS).repartition(3))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == without_repeats(rows)


def test_suffix_dedup_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got = QUERIES["op9_suffix_array_dedup"](spark, sf)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == without_repeats(docs)


def test_jaccard_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_ngram_jaccard_join"](spark, sf).collect()} == components(docs)


def test_packing_round_trip(spark, sf):
    """Pieces give every document's ids back, sequences are gapless and hardly padded, and the ids are the tokenizers file's."""
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, " a  b\n\n it's <|endoftext|> \x00  "), (-4, "a<|endoftext|>b<|endoftext|><|endoftext|> c"), (-5, "<|endoftext|>"), (-6, "<|endoftext|")], DOCS))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    rows = packing.pack(docs, include_ids=True).collect()
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        parts[r.doc_id].append((r.start, r.ids))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in parts.items()} == want
    padding = 0
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing_of_very_long_white_space(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a" + " " * 1_000_000 + "b", "short <|endoftext|> text", "\n" * 1_000_000 + "<|endoftext|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    parts = defaultdict(list)
    for r in packing.pack(docs, include_ids=True).collect():
        parts[r.doc_id].append((r.start, r.ids))
    want = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for k, t in enumerate(texts)}
    assert {d: [x for _, ids in sorted(p) for x in ids] for d, p in parts.items()} == want


def test_fill_is_the_best_subset():
    r = random.Random(5)
    for _ in range(60):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 5))}
        capacity, sums = r.randint(1, 60), {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums}
        used = packing.fill(counts, capacity)
        assert all(used[k] <= counts[k] for k in used) and sum(k * v for k, v in used.items()) == max(s for s in sums if s <= capacity)


def test_maximal_segments():
    """Against the recursive definition: the best segment first, then left and right of it."""

    def recursive(x, at=0):
        best, where = 0.0, None
        for i in range(len(x)):
            total = 0.0
            for j in range(i, len(x)):
                total += x[j]
                if total > best + 1e-12:
                    best, where = total, (i, j + 1)
        if where is None:
            return []
        i, j = where
        return [*recursive(x[:i], at), (at + i, at + j), *recursive(x[j:], at + j)]

    r = random.Random(9)
    for _ in range(40):
        x = [r.choice([-1.0, -1.0, 2.5, 1.25]) for _ in range(r.randint(1, 14))]
        at = np.array([i for i, v in enumerate(x) if v > 0], int)
        got = [(a, b) for a, b, _ in toxicity.maximal_segments(at, np.array([v for v in x if v > 0]), 1.0)]
        scores = [sum(x[a:b]) for a, b in got]
        assert sorted(scores) == pytest.approx(sorted(sum(x[a:b]) for a, b in recursive(x)))


@pytest.mark.parametrize(("name", "label", "k", "fold"), [("op3_toxicity", "toxic", 5, 0), ("op4_quality_classifier", "quality", 4, 2)])
def test_held_out_accuracy(spark, name, label, k, fold):
    folder = "/root/testdata/sf0.1"
    got = QUERIES[name](spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").toPandas()
    assert set(got["doc_id"].map(lambda d: zlib.crc32(str(d).encode()) % k)) == {fold}
    assert got["score"].between(0, 1).all() and (got["predicted"] == got[label]).mean() > 0.96


def test_html_against_the_page_form(spark, sf):
    import html
    import re

    def plain(source):
        m = re.search(r"<article>(.*?)(</article>|<footer|$)", source or "", re.S)
        body = re.sub(r"</?b>", "", re.sub(r"<br>", " ", re.sub(r"<[a-zA-Z/!][^>]*$", "", m[1]))) if m else ""
        return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in re.split(r"<[^>]*>", body)) if x)

    pages = {r.page_id: plain(r.html) for r in table(spark, sf, "pages").collect()}
    assert {r.page_id: r.text for r in QUERIES["op6_html_extraction"](spark, sf).collect()} == pages


@pytest.mark.parametrize(("names", "marks"), [(False, True), (False, False)])
def test_style_tree_decides_without_names(spark, sf, names, marks):
    """By importance alone, without role and class names and article marks, the given pages come out as with them; so every removal is the tree's."""
    pages = table(spark, sf, "pages")
    want = {r.page_id: r.text for r in QUERIES["op6_html_extraction"](spark, sf).collect()}
    got = {r.page_id: r.text for r in html_extraction.extract_text(pages, names=names, marks=marks).collect()}
    whole = {r.page_id: html_extraction.Page(r.html or "", names=False, marks=False).text({}) for r in pages.collect()}
    removed = sum(len(whole[k]) > len(want[k]) for k in want)
    assert removed >= 0.9 * len(want) and sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_names_are_a_weak_word(spark):
    """A branch called a widget that holds what the site is about stays; an unnamed menu of changing words goes."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    story = {k: " ".join(word() for _ in range(r.randint(20, 400))) for k in range(60)}
    page = lambda k: f"<body><div class='x'><a href='/'>{word()}</a> <a href='/'>{word()}</a></div><div class='widget'><p>{story[k]}</p></div><div>{word()} {word()}</div>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in story]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == story


def test_style_tree_removes_what_a_site_repeats(spark):
    page = lambda k: f"<body><div class='top'>Welcome to our site</div><div class='x'>Story {k} is told here.</div><div class='legal-text'>All rights are ours</div></body>"
    rows = [(k, f"http://h.example/{k}", page(k)) for k in range(12)]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {k: f"Story {k} is told here." for k in range(12)}
    salted = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_rows=-1)
    assert sorted(salted.collect()) == sorted(got.collect())


@pytest.mark.parametrize("wrap", ["<div class='content'>{}</div>", "<article class='post'>{}</article>", "<div><article>{}</article></div>", "<div><div class='a'><section id='b'>{}</section></div></div>"])
def test_style_tree_keeps_a_wrapper_around_changing_text(spark, wrap):
    rows = [(k, f"http://h.example/{k}", "<body>" + wrap.format(f"<p>Story {k} is told here.</p><div class='legal-text'><p>All rights are ours</p></div>")) for k in range(12)]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == {k: f"Story {k} is told here." for k in range(12)}


@pytest.mark.parametrize(("copies", "others"), [(12, 0), (87, 13)])
def test_style_tree_counts_copies_once(spark, copies, others):
    """Copies in other menus, with or without pages of their own text beside them."""
    texts = ["One page, often copied."] * copies + [f"Page {k} of its own." for k in range(others)]
    rows = [(k, f"http://h.example/{k}", f"<body><nav>Menu {k}</nav><div class='content'><p>{text}</p></div>") for k, text in enumerate(texts)]
    got = html_extraction.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5))
    assert {r.page_id: r.text for r in got.collect()} == dict(enumerate(texts))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<body><nav>a</nav><main><h1>T&amp;t</h1><p>x <b>y</b>\n z<p>w<ul><li>i<li>j</ul></main><footer>f</footer>", "T&t\nx y z\nw\ni\nj"),
        ("<article><p>a</p><form>f<p>g</form><aside>s</aside><div class='comments'><p>c</div><p>b<scr", "a\nb"),
        ("<article><header><h1>H</h1></header><p>p<!-- x</p>", "H\np"),
        ("<div id='cookie-notice'>c</div><p>t &lt;b&gt; &#233;", "t <b> é"),
        ("<article><script>if (a < b) '</p>'</script><p>k</p><div hidden>h</div><div role='banner'>r</div>", "k"),
        ("", ""),
        ("plain < text > here", "plain < text > here"),
        ("<article><p class='related work'>a</p><div class='search results'>b</div><p>c <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>", "a\nb\nc x=2"),
        ("<article><section class='comments'><article>c</article></section><p>k</p></article>", "k"),
        ("<form><p>f</p><select><option>o<option>p</select></form><my-tag>w <b>x</b></my-tag>", "w x"),
    ],
)
def test_html_cases(source, want):
    assert html_extraction.Page(source).text({}) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<article><p>a <span class='ad sponsor'>BUY NOW <span>x</span></span> b <a class='share' href='/'>Share this</a></p><p>c</p></article>", "a b\nc"),
        ("<article><p>a <span class='ad'>open<p>b</article>", "a\nb"),
    ],
)
def test_html_cases_with_weak_names(source, want):
    """They go where the host's tree has seen them read alike."""
    page = html_extraction.Page(source)
    assert page.text({n[0]: html_extraction.GOES_WEAK for n in page.nodes if n[2] == html_extraction.WEAK}) == want != page.text({})


def test_leaks_with_exchanged_words(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((30, 20, 7, 3, 0))]
    rows, want = [], set()
    for k in range(60):
        i = k % 4
        w = items[i][1].split()
        if len(w) >= 20:  # up to three words of each thirteen
            for at in range(0, len(w), 13):
                for x in r.sample(range(at, min(at + 13, len(w))), min(3, len(w) - at) if at + 13 <= len(w) else 0):
                    w[x] = word()
        rows.append((k, " ".join([word() for _ in range(40)] + [x.upper() for x in w] + [word() for _ in range(k)])))
        if i < 3:
            want.add((k, i))
    rows += [(k, " ".join(word() for _ in range(100))) for k in range(100, 140)]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontamination.contaminated(docs, bench).collect()} == want
    assert {x.doc_id for x in decontamination.decontaminated(docs, bench).collect()} == {k for k, _ in rows} - {k for k, _ in want}


def leaks_by_hand(docs, items, least=5):
    """(doc, item) pairs by laying every item over every place of every text."""
    name = {}
    code = lambda t: np.array([name.setdefault(w, len(name)) for w in WORD.findall((t or "").translate(LOWER))], int)
    texts, out = [(d, code(t)) for d, t in docs], set()
    for i, t in items:
        own = code(t)
        if len(own) < least:
            continue
        width = min(13, len(own))
        for d, text in texts:
            for shift in range(width - len(own), len(text) - width + 1):
                lo, hi = max(0, -shift), min(len(own), len(text) - shift)
                sums = np.concatenate([[0], np.cumsum(own[lo:hi] == text[shift + lo : shift + hi])])
                if hi - lo >= width and (sums[width:] - sums[:-width]).max() * 13 >= 10 * width:
                    out.add((d, i))
                    break
    return out


def test_leaks_of_short_items(spark):
    """Items of 5 to 14 words with as many words exchanged as the share allows and one more, against laying them by hand."""
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    items = [(n, " ".join(word() for _ in range(n))) for n in range(3, 15)] + [(None, " ".join(word() for _ in range(9)))]
    docs = []
    for _, text in items:
        for exchanged in range(5):
            w = text.split()
            for x in r.sample(range(len(w)), min(exchanged, len(w))):
                w[x] = word()
            docs.append((len(docs), " ".join([word() for _ in range(7)] + w + [word() for _ in range(7)])))
    got = decontamination.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    want = leaks_by_hand(docs, items)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == want and {i for _, i in want} == {*range(5, 15), None}


def test_leaks_on_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    want = leaks_by_hand(docs, items)
    got = QUERIES["op7_benchmark_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    clean = decontamination.decontaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_every_leak_of_ten_in_thirteen_is_seeded():
    from itertools import combinations

    for gone in combinations(range(13), 3):
        assert any(all(s + x not in gone for x in m) for m in decontamination.MASKS for s in range(13 - m[-1]))


def test_url_rules(spark, sf):
    from urllib.parse import urlsplit

    def rule(host, path):
        fit = [(h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit, key=lambda x: len(x[0])) if fit else None

    model = url_filters.url_filter(table(spark, sf, "pages"), url_filters.labelled_urls(spark)).collect()
    for r in model:
        u = urlsplit(r.url)
        assert (r.host, r.path) == (u.netloc.lower(), u.path)
        hit = rule(r.host, r.path)
        assert (r.rule, r.verdict) == hit if hit else r.rule is None and r.verdict == ("block" if r.score >= 0.5 else "allow")
    assert {r.score for r in model if r.rule is None} != {0.5}


def test_url_scores_against_a_plain_loop(spark, sf):
    import math

    import xxhash

    weights, intercept = url_filters.fit_url_model(url_filters.labelled_urls(spark))

    def grams(mark, text):
        text = f"^{text}$"
        return {xxhash.xxh64_intdigest(text[i : i + n].encode(), xxhash.xxh64_intdigest(mark.encode(), 42)) for n in (3, 4, 5) for i in range(len(text) - n + 1)}

    def signed(x):
        return (x - (1 << 64) if x >> 63 else x) % len(weights)

    pages = table(spark, sf, "pages").unionByName(spark.createDataFrame([(-1, None, None), (-2, "x" * 40, None), (-3, "http://" + "long" * 500 + "/é", None)], "page_id long, url string, html string"))
    for r in url_filters.url_filter(pages, url_filters.labelled_urls(spark)).collect():
        plain = 1 / (1 + math.exp(-intercept - sum(float(f"{weights[b]:.6g}") for b in {signed(x) for x in grams("h", r.host) | grams("p", r.path)})))
        assert r.score == pytest.approx(plain, abs=1e-6)


def test_urls_held_out(spark):
    """Names that the labelled table doesn't hold: other pairs of its words are told, ordinary and made-up names left alone."""
    seen = {u for u, _ in url_filters.labelled_table()}
    junk = [f"http://{a}-{b}.example.co/p/{i}" for i, (a, b) in enumerate(zip(url_filters.JUNK_WORDS[::2], url_filters.JUNK_WORDS[-1::-2]))]
    junk += [f"https://www.{w}{i}.example.info/" for i, w in enumerate(url_filters.JUNK_WORDS)]
    plain = [f"http://{a}{b}.example.co/p/{i}" for i, (a, b) in enumerate(zip(url_filters.ORDINARY_WORDS[::2], url_filters.ORDINARY_WORDS[-1::-2]))]
    plain += [f"https://{a}.example.info/x" for a in "kovrantel bishtomp quellarie dunworth ashgrove thornwick merriden oakfield lindenhof bellavoir castelmar prudhoe".split()]
    urls = [(i, u, int(i < len(junk))) for i, u in enumerate(junk + plain)]
    assert not seen & {u for _, u, _ in urls}
    got = {r.page_id: r.verdict for r in url_filters.url_filter(spark.createDataFrame(urls, "page_id long, url string, label int"), url_filters.labelled_urls(spark), rules=()).collect()}
    assert sum(got[i] == "block" for i in range(len(junk))) >= 0.9 * len(junk)
    assert sum(got[i] == "allow" for i in range(len(junk), len(urls))) >= 0.98 * len(plain)


def test_toxicity_at_any_share_of_labels(spark):
    """The model holds whether the labelled sample is mostly clean, balanced or mostly toxic."""
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    held = {r.doc_id: r.toxic for r in labels.where(~train).collect()}
    clean = labels.where("toxic = 0").where(train).orderBy(F.xxhash64("doc_id"))
    for n in (60, 352, 3500):
        model = toxicity.fit_toxicity(docs, labels.where("toxic = 1").unionByName(clean.limit(n)), train)
        got = [(held[r.doc_id], r.predicted) for r in toxicity.score_toxicity(docs, model).where(F.col("doc_id").isin(list(held))).collect()]
        assert sum(p for y, p in got if y) >= 80 and sum(p for y, p in got if not y) <= 20


def test_toxicity_against_plain_loops(spark):
    """Fit and score of 200 texts with dictionaries and all-pairs segments in place of hashes, Spark and the scan."""
    import math

    r = random.Random(6)
    common, bad = [f"w{i}" for i in range(60)], ["nasty", "vile", "rotten"]
    rows = []
    for k in range(200):
        y = int(k % 4 == 0)
        w = [r.choice(common) for _ in range(r.randint(5, 40))]
        for _ in range(r.randint(1, 3) * y):
            w.insert(r.randrange(len(w)), r.choice(bad))
        rows.append((k, " ".join(w), y))
    texts, y = [t.split() for _, t, _ in rows], [x[2] for x in rows]
    lift, surprise, prior, cost = 2.0, 15.0, 2000.0, 0.05
    n_bad, n_other, corpus = sum(y), len(y) - sum(y), sum(map(len, texts))
    scores, rate = {}, {}
    seen = {t: (sum(t in w for w, b in zip(texts, y) if b), sum(t in w for w, b in zip(texts, y) if not b)) for t in {x for w in texts for x in w}}
    total = [sum(v[i] for v in seen.values()) for i in (0, 1)]
    for t, (b, o) in seen.items():
        q = (b + o) / len(texts)
        if b < 3 or b * n_other < lift * o * n_bad or b <= lift * n_bad * q:
            continue
        g = 2 * (b * math.log(b / (n_bad * q)) + ((n_bad - b) * math.log((n_bad - b) / (n_bad * (1 - q))) if b < n_bad else 0))
        if g < surprise:
            continue
        a = prior * sum(w.count(t) for w in texts) / corpus
        up, down = (b + a) / (total[0] + prior - b - a), (o + a) / (total[1] + prior - o - a)
        if up > down:
            scores[t], rate[t] = math.log(up / down), (o + a) / (total[1] + prior)
    assert set(scores) == set(bad)
    low, high = 1e-3, 20.0
    for _ in range(80):
        lam = (low + high) / 2
        low, high = (low, lam) if sum(p * math.exp(lam * scores[t]) for t, p in rate.items()) + (1 - sum(rate.values())) * math.exp(-lam * cost) > 1 else (lam, high)

    def segments(w):
        x = [scores.get(t, -cost) for t in w]
        best = max(((sum(x[i:j]), -i, j) for i in range(len(x)) for j in range(i + 1, len(x) + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        return [*segments(w[: -best[1]]), best[0], *segments(w[best[2] :])]

    found = [segments(w) for w in texts]
    quiet = [lam * max(s) - math.log(max(len(w), 2)) for w, s, b in zip(texts, found, y) if not b and s]
    log_k = sum(quiet) / len(quiet) - 0.5772 if len(quiet) >= 30 else 0.0
    value = np.array([sum(max(0.0, lam * s - log_k - math.log(max(len(w), 2))) for s in f) for w, f in zip(texts, found)])
    weights = toxicity.fit_logistic(np.log1p(value)[:, None], np.array(y))
    docs, labels = spark.createDataFrame([x[:2] for x in rows], DOCS).repartition(3), spark.createDataFrame([(k, b) for k, _, b in rows], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(docs, labels, F.lit(True))
    got = {x.doc_id: (x.score, x.predicted) for x in toxicity.score_toxicity(docs, model).collect()}
    for k, v in enumerate(value):
        plain = 1 / (1 + math.exp(-np.clip(weights[0] + weights[1] * np.log1p(v), -30, 30)))
        assert got[k][0] == pytest.approx(plain, abs=1e-6) and got[k][1] == int(plain >= 0.5)


def test_quality_against_a_plain_loop(spark):
    """Dictionaries, features and calibration of 120 texts with zstandard itself."""
    import zstandard

    r = random.Random(3)
    good = lambda: " ".join(r.choice(("the", "river", "runs", "slowly", "past", "an", "old", "mill", "garden", "stone")) for _ in range(r.randint(5, 300)))
    poor = lambda: "".join(r.choice("!#$%&@xXqQzZ0123456789 ") for _ in range(r.randint(20, 900)))
    rows = [(k, good() if k % 3 else poor(), int(k % 3 > 0)) for k in range(120)]
    docs, labels = spark.createDataFrame([x[:2] for x in rows], DOCS).repartition(4), spark.createDataFrame([(k, b) for k, _, b in rows], "doc_id long, quality int")
    model = quality_classifier.fit_quality(docs, labels, F.lit(True))
    by = {b: [t for _, t, y in rows if y == b] for b in (0, 1)}
    first, second, trained = quality_classifier.dictionaries(by[1][::2], by[0][::2], 114_688)
    assert (model.good, model.bad, model.trained) == (first, second, trained)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT

    def size(data, dictionary):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=kind), write_content_size=False, write_checksum=False)
        return sum(len(c.compress(data[k : k + 1024])) for k in range(0, len(data), 1024))

    def features(text):
        data = text.encode()
        a, b = size(data, first), size(data, second)
        plain = min(1.5, len(zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress(data)) / len(data))
        return (a - b) / max(a, b), plain, np.log1p(len(data)) * plain

    check = [(t, 0) for t in by[0][1::2]] + [(t, 1) for t in by[1][1::2]]
    weights = quality_classifier.fit_logistic(np.array([features(t) for t, _ in check]), np.array([b for _, b in check]))
    got = {x.doc_id: (x.score, x.predicted) for x in quality_classifier.score_quality(docs, model).collect()}
    for k, t, _ in rows:
        plain = 1 / (1 + np.exp(-np.clip(weights[0] + np.array(features(t)) @ weights[1:], -30, 30)))
        assert got[k][0] == pytest.approx(plain, abs=1e-9) and got[k][1] == int(plain >= 0.7)


def test_words_of_long_texts(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long), (2, long)], DOCS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()} == {1: (1, 1), 2: (1, 1)}
    cut = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert cut == {1: 0, 2: len(long)}
    assert WORD.findall(long)[0] == "word"
