"""Source divergence, ranked search and license scans against plain versions, on odd rows and at odd settings."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelframe.llm import license_scan, ranked_search, source_divergence
from reelframe.llm.license_scan import Automaton, Template
from tests.llm.models import LOWER
from tests.llm.test_llm_edges import EXTRA

ALPHA = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
RNG = random.Random(21)
WORDS = ["alpha", "Beta", "gamma", "été", "straße", "ÀB", "x1", "don't", "a", "İ", "日本語", "tie", "toe"]


def prose(n):
    return RNG.choice([" ", ", ", "\n"]).join(RNG.choices(WORDS, weights=range(len(WORDS), 0, -1), k=n))


def frame(spark, rows, kinds):
    df = spark.createDataFrame(rows, kinds)
    for name in (*EXTRA, "item", "value", "rank", "part", "term", "block", "total", "places", "df", "all", "docs", "head"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("extra"))
    return df.repartition(3)


DOCS = [(k, RNG.choice(["en", "de", None]), RNG.choice(["s1", "s2", "s3", "s4", None]), prose(RNG.randrange(0, 40))) for k in range(150)]
DOCS += [(200, "en", "bare", None), (201, "xx", "one", "few words"), (202, "xx", "two", ""), (203, None, None, None), DOCS[3], DOCS[3], (None, "en", "s1", prose(30)), (204, "lone", "only", "alpha " * 50), (205, "en", "s1", "\x00 9 %")]
KINDS = "doc_id long, lang string, source string, text string"


def divergence_of(docs, min_docs, top):
    counts, df, langs = {}, {}, {}
    for _, lang, source, text in docs:
        lang, source, terms = lang or "", source or "", [t.translate(LOWER) for t in ALPHA.findall(text or "")]
        langs.setdefault(lang, {}).setdefault(source, {})
        for t in terms:
            own = langs[lang][source]
            own[t] = own.get(t, 0) + 1
        for t in set(terms):
            df[lang, t] = df.get((lang, t), 0) + 1
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= min_docs)

        def p(own, kept=kept):
            total = sum(own.get(t, 0) for t in kept) + 5 * len(kept)
            return [1 + 10**9 * (own.get(t, 0) + 5) // total for t in kept]

        every = {}
        for own in sources.values():
            for t, n in own.items():
                every[t] = every.get(t, 0) + n
        q, shares = p(every), {s: p(own) for s, own in sources.items()}
        for s, own in sources.items():
            pairs = [(o, sum(abs(a - b) for a, b in zip(shares[s], shares[o]))) for o in sources if o != s]
            terms = [(t, a - b) for t, a, b in zip(kept, shares[s], q) if own.get(t, 0) and a > b]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows[:most])]
    return out


@pytest.mark.parametrize(("min_docs", "top", "width", "tile"), [(5, 3, 4096, 256), (1, 50, 4, 2), (30, 50, 3, 1)])
def test_divergence(spark, min_docs, top, width, tile):
    found = source_divergence.divergence(frame(spark, DOCS, KINDS), min_docs=min_docs, top=top, width=width, tile=tile).collect()
    assert sorted(map(tuple, found)) == sorted(divergence_of(DOCS, min_docs, top))


def test_divergence_of_nothing(spark):
    assert source_divergence.divergence(frame(spark, [], KINDS)).collect() == []


def test_prices_are_exact():
    for total in (5, 30, 10**9 + 7, (1 << 47) + 5, (1 << 48) + 1, 10**16):
        counts = np.array([-1, *(c for c in (0, 1, 7, 10**6, 10**12) if c + 5 <= total)])
        assert source_divergence.price(counts, total).tolist() == [0] + [1 + 10**9 * (c + 5) // total for c in counts[1:].tolist()]


def test_trees_share_nodes_and_price_pairs_once():
    rng = np.random.default_rng(1)
    counts = np.where(rng.random((6, 1024)) < 0.03, rng.integers(0, 4, (6, 1024)), 0)
    counts[1] = counts[0]
    counts[:, 1000:] = -1
    totals = [500, 500, 700, 900, 800, 701]
    pairs = np.array([(a, b) for a in range(6) for b in range(a + 1, 6)])
    values, levels, roots = source_divergence.shared_trees(counts)
    assert roots[0] == roots[1] and sum(len(x[0]) for x in levels) < 6 * 1023 / 2
    found, followed = source_divergence.distances(counts, totals, pairs)
    naive = [sum(abs(source_divergence.price(counts[a], totals[a]) - source_divergence.price(counts[b], totals[b])).tolist()) for a, b in pairs]
    assert found.tolist() == naive and found[0] == 0 and followed < len(pairs) * 2047 / 2


def search_of(docs, items, k):
    terms = [(d, [t.translate(LOWER) for t in TERM.findall(x or "")]) for d, x in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = {}
    for _, t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        asked, rows = [t.translate(LOWER) for t in TERM.findall(text or "")], []
        for d, t in terms:
            m = 25 + 75 * len(t) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in asked if x in t)
            if score > 0:
                rows.append((-score, d is not None, d or 0))
        out += [(item, r + 1, d if some else None, -s) for r, (s, some, d) in enumerate(sorted(rows)[:k])]
    return out


ITEMS = [(k, prose(RNG.randrange(1, 12))) for k in range(12)] + [(90, None), (91, ""), (92, "nowhere"), (None, "tie toe"), (93, "toe toe TOE tie"), (93, "toe toe TOE tie")]
TEXTS = [(d, t) for d, _, _, t in DOCS] + [(300 + k, "tie toe " + "pad " * (k % 3)) for k in range(40)]


@pytest.mark.parametrize(("k", "item_chars", "terms", "segment", "cells"), [(10, 4_000_000, 4096, 4096, 1 << 24), (3, 60, 4, 7, 30), (1, 4_000_000, 3, 50, 1)])
def test_ranked_search(spark, monkeypatch, k, item_chars, terms, segment, cells):
    """Also with many passes, groups of items, segments, and cuts of segments."""
    for name, value in (("ITEM_CHARS", item_chars), ("TERMS", terms), ("SEGMENT", segment), ("CELLS", cells)):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = frame(spark, TEXTS, "doc_id long, text string"), frame(spark, ITEMS, "item_id long, text string")
    found = ranked_search.ranked_search(docs, items, k=k).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(search_of(TEXTS, ITEMS, k), key=repr)


def test_ranked_search_of_nothing(spark):
    docs, items = frame(spark, TEXTS, "doc_id long, text string"), frame(spark, ITEMS, "item_id long, text string")
    assert ranked_search.ranked_search(docs.where("false"), items).collect() == [] == ranked_search.ranked_search(docs, items.where("false")).collect()


@pytest.mark.parametrize("block", [1, 4, 32])
def test_segments_skip_blocks_and_lose_nothing(monkeypatch, block):
    """Skipped or not, the best are those of a full matrix product, ties by id."""
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    rng = np.random.default_rng(block)
    topics = rng.random((8, 60)) ** 6
    which = rng.integers(0, 8, 900)
    impacts = np.where(rng.random((900, 60)) < topics[which], rng.integers(1, 50, (900, 60)), 0).astype(np.int32) * 1000
    docs = np.column_stack([np.ones(900, np.int64), rng.permutation(900)])
    weights = rng.integers(500, 9000, 60)
    group = ranked_search.Group(list(range(20)), np.arange(60), [np.sort(rng.choice(60, 6, False)) for _ in range(20)], [rng.integers(1, 4, 6) for _ in range(20)])
    best, told = ranked_search.Best(20, 10), {"blocks": 0, "skipped": 0, "scored": 0}
    for low in range(0, 900, 300):
        for name, n in ranked_search.search_segment(impacts[low : low + 300], docs[low : low + 300], group, weights, best).items():
            told[name] += n
    for i in range(20):
        scores = impacts[:, group.columns[i]].astype(np.int64) @ (group.repeats[i] * weights[group.columns[i]])
        want = sorted((-s, d) for s, d in zip(scores.tolist(), docs[:, 1].tolist()) if s > 0)[:10]
        assert list(zip((-best.scores[i]).tolist(), best.docs[i][:, 1].tolist())) == want
    assert told["scored"] < 20 * 900 and (told["skipped"] > 0 or block == 32)


def scan_of(text, templates):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for k, t in enumerate(templates):
        pattern = re.compile(license_scan.pattern(license_scan.parsed(t.wording)))
        for at in range(len(words)):
            if pattern.match(" ".join(words[at:]) + " "):
                found.append((t.label, t.base, k, at))
    return len(words), found


MIT = re.sub(r"\[including the next paragraph\]", "", license_scan._GRANT + ", " + license_scan._KEEP)
NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "licensed under the apache licence version 2.0", "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.", "licensed under a CC BY 4.0", "All rights reserved.", "Copyright (c) 2026 Some Body. All rights reserved.", "copyright all rights reserved", MIT, MIT.replace("merge", "mix"), MIT + " " + license_scan._AS_IS,
    "mit license mit license", "the MIT\nLicense", "mit licenses", "xmit license", "general public", "Neither the name of A B C nor", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License",
    license_scan._BSD.replace("[1]", "1").replace("[2]", "2") + " 3 Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software",
    license_scan._BSD.replace("[1]", "").replace("[2]", "b"), "licensed under the terms of the MIT", "MİT LICENSE", "",
]


def test_license_scan(spark):
    rows = [(k, f"{prose(RNG.randrange(5))} {n} {prose(RNG.randrange(5))}") for k, n in enumerate(NOTICES)] + [(100, None), (None, "MIT license"), (101, "word " * 200_000 + "apache license " * 3), (1, NOTICES[1])]
    docs = frame(spark, rows, "doc_id long, text string")
    found = {(r.doc_id, r.n_words, r.first_word): r for r in license_scan.license_scan(docs).collect()}
    assert len(found) == len(rows)
    for doc_id, text in rows:
        if doc_id == 101:
            r = found[101, 200_006, 200_000]
            assert (r.n_base, r.last_word, r.labels) == (3, 200_004, "apache")
            continue
        n, places = scan_of(text, license_scan.TEMPLATES)
        base = [p for p in places if p[1]]
        r = found[doc_id, n, min((p[3] for p in base), default=None)]
        assert (r.n_base, r.last_word) == (len(base), max((p[3] for p in base), default=None))
        assert r.base_labels == ",".join(sorted({p[0] for p in base})) and r.labels == ",".join(sorted({p[0] for p in places}))
        strongest = max((license_scan.mandatory(license_scan.parsed(license_scan.TEMPLATES[p[2]].wording)) for p in places), default=0)
        assert r.score == strongest / (strongest + 2)
    assert license_scan.license_scan(docs.where("false")).collect() == []


def test_whole_licenses_are_told_apart():
    own = Automaton(license_scan.TEMPLATES)

    def labels(text):
        return {p[0] for p in scan_of(text, license_scan.TEMPLATES)[1]}, own

    assert labels(MIT)[0] == {"mit"} == labels(MIT + license_scan._AS_IS)[0] and labels(MIT.replace("merge", "mix"))[0] == set()
    assert labels(license_scan._GRANT + ". " + license_scan._AS_IS)[0] == {"mit-0"}
    assert labels(NOTICES[19])[0] == {"bsd-2-clause", "bsd-3-clause"} and labels(NOTICES[7])[0] == {"all-rights-reserved"} and labels(NOTICES[6])[0] == set()


def test_markup():
    made = Automaton((Template("t", "a [b [c]] {x:1-2} (d|e) [f]"), Template("u", "a b")))

    def read(text):
        return made.places([made.number.get(w, -1) for w in text.split()])

    assert read("a z d") == [(0, 3)] and read("a b z e f") == [(0, 5), (1, 2)] and read("a b c y z d") == [(0, 6), (1, 2)] and read("a d") == [] and read("a b d e") == [(0, 4), (1, 2)] and read("a w x y d") == []
    for bad in ("[a] b", "{x:1-2} b", "a [b", "a b]", ""):
        with pytest.raises((ValueError, IndexError)):
            Automaton((Template("t", bad),))
