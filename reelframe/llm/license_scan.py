"""License scans by template markup.

A template is the wording of a license notice in which `[...]` may be left out, `{name:3-8}` stands for three to eight words of any kind, and `(a|b)`
for one of several words.  Templates are compiled into one automaton over words; a place of a text is accepted where the automaton reads the whole
mandatory wording, word for word.  Tasks look up the words of a batch in the templates' vocabulary, find the places where a template can begin at
all (its first two words), and run the automaton from there alone.  A template has a longest length, so a place costs a bounded number of steps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import table
from reelframe.llm.terms import word_strings
from reelframe.llm.textcodes import chunks


@dataclass(frozen=True)
class Template:
    """`base` templates are the plain phrases whose places are counted."""

    label: str
    wording: str
    base: bool = False


# The wordings of public licenses and of the usual notices.
_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so"""
_KEEP = """subject to the following conditions: The above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
[1] Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
[2] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = "General Public License as published by the Free Software Foundation, either version"
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("mit", f"{_GRANT} {_KEEP} [{_AS_IS}]"),
    Template("mit", "(licensed|released|distributed) under [the terms of] the MIT (license|licence)"),
    Template("x11", f"{_GRANT} {_KEEP} {_AS_IS} Except as contained in this notice, the name of {{holder:1-8}} shall not be used in advertising"),
    Template("mit-0", f"{_GRANT} {_AS_IS}"),
    Template("isc", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("0bsd", f"{_ISC}. THE SOFTWARE IS PROVIDED AS IS"),
    Template("bsd-2-clause", _BSD),
    Template("bsd-3-clause", f"{_BSD} [3] Neither the (name|names) of {{holder:1-10}} nor the names of [its] {{others:0-3}} contributors may be used to endorse or promote products derived from this software"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    Template("apache-2.0", "(licensed|released|distributed) under the [terms of the] Apache (license|licence), version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at [http] [https] www.apache.org/licenses/LICENSE-2.0"),
    Template("gpl-2.0", "(licensed|released|distributed) under [the terms of] the GNU General Public License [version] (2|v2)"),
    Template("gpl-3.0", "(licensed|released|distributed) under [the terms of] the GNU General Public License [version] (3|v3)"),
    Template("gpl-2.0", "(licensed|released|distributed) under [the terms of] the [GNU] GPL [version] (2|v2)"),
    Template("gpl-3.0", "(licensed|released|distributed) under [the terms of] the [GNU] GPL [version] (3|v3)"),
    Template("gpl-2.0-or-later", f"under the terms of the GNU {_GNU} 2 of the License, or at your option any later version"),
    Template("gpl-3.0-or-later", f"under the terms of the GNU {_GNU} 3 of the License, or at your option any later version"),
    Template("lgpl", f"under the terms of the GNU (Lesser|Library) {_GNU} {{number:1-2}} of the License"),
    Template("agpl-3.0", f"under the terms of the GNU Affero {_GNU} 3 of the License"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("cc0-1.0", "(licensed|released|dedicated) under [the] CC0 [1.0]"),
    Template("cc-by-4.0", "licensed under [a] [the] CC BY 4.0"),
    Template("cc-by-sa-4.0", "licensed under [a] [the] CC BY-SA 4.0"),
    Template("cc-by-nc-4.0", "licensed under [a] [the] CC BY-NC 4.0"),
    Template("cc-by-nd-4.0", "licensed under [a] [the] CC BY-ND 4.0"),
    Template("cc-by-nc-sa-4.0", "licensed under [a] [the] CC BY-NC-SA 4.0"),
    Template("cc-by-nc-nd-4.0", "licensed under [a] [the] CC BY-NC-ND 4.0"),
    Template("cc-by-4.0", "licensed under [a] [the] Creative Commons Attribution 4.0"),
    Template("cc-by-sa-4.0", "licensed under [a] [the] Creative Commons Attribution ShareAlike 4.0"),
    Template("cc-by-nc-4.0", "licensed under [a] [the] Creative Commons Attribution NonCommercial 4.0"),
    Template("all-rights-reserved", "copyright {holder:1-8} all rights reserved"),
)
_MARKUP = re.compile(r"(\[)|(\])|\{[a-z]+:(\d+)-(\d+)\}|\(([^()|]+(?:\|[^()|]+)+)\)|([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)")


def parsed(wording: str) -> list[tuple]:
    """("word", words) | ("any", least, most) | ("optional", parts), in order; A-Z count as a-z."""
    stack: list[list[tuple]] = [[]]
    for opened, closed, least, most, words, word in _MARKUP.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in wording)):
        if opened:
            stack.append([])
        elif closed:
            inner = stack.pop()
            stack[-1].append(("optional", inner))
        elif most:
            stack[-1].append(("any", int(least), int(most)))
        else:
            stack[-1].append(("word", tuple(words.split("|")) if words else (word,)))
    if len(stack) != 1 or not stack[0] or stack[0][0][0] != "word":
        raise ValueError(f"a template closes its brackets and begins with a word: {wording[:60]}")
    return stack[0]


def longest(parts: list[tuple]) -> int:
    """Words of the longest text of a template."""
    return sum(p[2] if p[0] == "any" else longest(p[1]) if p[0] == "optional" else 1 for p in parts)


def mandatory(parts: list[tuple]) -> int:
    """Words that every accepted text of a template has."""
    return sum(p[0] == "word" for p in parts)


class Automaton:
    """All templates as one automaton over word numbers; sets of states are made as texts ask for them."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.edges: list[list[tuple[str | None, int]]] = []
        self.free: list[list[int]] = []
        self.final: dict[int, int] = {}
        trees = [parsed(t.wording) for t in templates]
        self.mandatory = [mandatory(t) for t in trees]
        self.longest = max(longest(t) for t in trees)
        starts = []
        for k, tree in enumerate(trees):
            starts.append(self._state())
            self.final[self._chain(tree, starts[-1])] = k
        self.words = sorted({w for own in self.edges for w, _ in own if w is not None})
        self.number = {w: i for i, w in enumerate(self.words)}
        self.sets: dict[frozenset[int], int] = {}
        self.members: list[frozenset[int]] = []
        self.accepts: list[tuple[int, ...]] = []
        self.steps: dict[tuple[int, int], int] = {}
        self._set(starts)
        self.opens = self._openings()

    def _state(self) -> int:
        self.edges.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _chain(self, parts: list[tuple], at: int) -> int:
        """Adds the parts behind state `at`; the state behind them all."""
        for part in parts:
            begin = at
            if part[0] == "word":
                at = self._state()
                self.edges[begin] += [(w, at) for w in part[1]]
            elif part[0] == "any":
                leave = []
                for k in range(part[2]):
                    if k >= part[1]:
                        leave.append(at)
                    at, before = self._state(), at
                    self.edges[before].append((None, at))
                for state in leave:
                    self.free[state].append(at)
            else:
                at = self._chain(part[1], begin)
                self.free[begin].append(at)
        return at

    def _set(self, states) -> int:
        """The number of a set of states with all that are reached from it for free; -1 for none."""
        reached, todo = set(states), list(states)
        while todo:
            new = [s for s in self.free[todo.pop()] if s not in reached]
            reached.update(new)
            todo += new
        key = frozenset(reached)
        if not key:
            return -1
        if key not in self.sets:
            self.sets[key] = len(self.members)
            self.members.append(key)
            self.accepts.append(tuple(sorted({self.final[s] for s in key if s in self.final})))
        return self.sets[key]

    def step(self, state: int, word: int) -> int:
        """The set behind `state` after a word, by its number; -1 stands for a word of no template."""
        found = self.steps.get((state, word))
        if found is None:
            text = self.words[word] if word >= 0 else None
            found = self._set({to for s in self.members[state] for w, to in self.edges[s] if w is None or w == text})
            self.steps[state, word] = found
        return found

    def _openings(self) -> np.ndarray:
        """[first word, next word] of which a place may begin with; the last two columns: another word, and the end of the text."""
        n = len(self.words)
        opens = np.zeros((n + 2, n + 2), bool)
        for a in range(n):
            state = self.step(0, a)
            if state >= 0:
                opens[a, : n + 1] = [self.step(state, b) >= 0 for b in [*range(n), -1]]
                opens[a] |= bool(self.accepts[state])
        return opens

    def places(self, ids: list[int]) -> list[tuple[int, int]]:
        """(template, words) of each template that is accepted from the first of these words on; its longest reading counts."""
        state, best = 0, {}
        for at, word in enumerate(ids):
            state = self.step(state, word)
            if state < 0:
                break
            for k in self.accepts[state]:
                best[k] = at + 1
        return sorted(best.items())


PLACES = "array<struct<label: string, base: boolean, template: int, mandatory: int, start: long, n_words: long>>"


def license_places(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, places): every place of a text where a template is accepted, by its first word (from 0), and its number of words.

    Null and empty texts have no words and no places; a very long text is read whole, in one row; templates that meet at a place, or overlap, are all told;
    repeated rows give repeated results; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    automaton = Automaton(templates)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)  # as large as the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n, vocabulary = len(own.words), pa.array(own.words, pa.large_string())
        for batch in batches:
            counts, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for row, _, data, offsets in chunks(batch):
                words, begins = word_strings(data, offsets)
                counts[row : row + len(begins) - 1] = np.diff(begins)
                ids = pc.index_in(words, value_set=vocabulary).fill_null(-1).to_numpy().astype(np.int64)
                after = np.append(ids[1:], -1)
                after[after < 0] = n
                after[begins[1:][np.diff(begins) > 0] - 1] = n + 1
                known = np.flatnonzero(ids >= 0)
                for at in known[own.opens[ids[known], after[known]]].tolist():
                    d = int(np.searchsorted(begins, at, "right")) - 1
                    span = ids[at : min(at + own.longest, begins[d + 1])].tolist()
                    for k, size in own.places(span):
                        t = own.templates[k]
                        found[row + d].append({"label": t.label, "base": t.base, "template": k, "mandatory": own.mandatory[k], "start": at - int(begins[d]), "n_words": size})
            kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("template", pa.int32()), ("mandatory", pa.int32()), ("start", pa.int64()), ("n_words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(found, kind)], ["doc_id", "n_words", "places"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, n_words long, places {PLACES}")


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """What each text says of its license: counts and places of the plain phrases, the labels of all accepted templates, and a score.

    The score is m / (m + 2) for the m mandatory words of the longest accepted template, 0 without any: a phrase in passing has little, a whole license much.
    Cases as in `license_places`.
    """
    places = license_places(docs, templates).withColumn("base_places", F.filter("places", lambda p: p["base"]))
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda p: p["label"]))), ",")
    starts = F.transform("base_places", lambda p: p["start"])
    strongest = F.coalesce(F.array_max(F.transform("places", lambda p: p["mandatory"])), F.lit(0))
    return places.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels("base_places").alias("base_labels"),
        labels("places").alias("labels"),
        (strongest / (strongest + 2)).alias("score"),
    )


def op13_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def pattern(parts: list[tuple]) -> str:
    """A template as a regular expression over words that each end with a blank."""
    kinds = {
        "word": lambda words: (words[0] if len(words) == 1 else f"(?:{'|'.join(words)})") + " ",
        "any": lambda least, most: f"(?:[^ ]+ ){{{least},{most}}}",
        "optional": lambda inner: f"(?:{pattern(inner)})?",
    }
    return "".join(kinds[p[0]](*p[1:]) for p in parts)


def _oracle(templates: tuple[Template, ...]) -> str:
    found = [(t, mandatory(tree := parsed(t.wording)), f"regexp_matches(s, ' {pattern(tree)}')") for t in templates]
    label = lambda rows: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN {m} THEN '{t.label}' END" for t, _, m in rows) + "], lambda x: x IS NOT NULL))), ',')"
    phrases = [parsed(t.wording) for t in templates if t.base]
    base = " OR ".join("(" + " AND ".join(f"w[i + {k}] = '{p[1][0]}'" for k, p in enumerate(tree)) + ")" for tree in phrases)
    best = ", ".join(f"CASE WHEN {m} THEN {n} ELSE 0 END" for _, n, m in found)
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, list_filter(range(1, len(w) + 1), lambda i: {base}) AS hits FROM d),
m AS (SELECT *, greatest({best}) AS m FROM s)
SELECT doc_id, len(w)::BIGINT AS n_words, len(hits)::BIGINT AS n_base, list_min(hits) - 1 AS first_word, list_max(hits) - 1 AS last_word,
 {label([x for x in found if x[0].base])} AS base_labels, {label(found)} AS labels, m / (m + 2)::DOUBLE AS score FROM m
"""


ORACLE = _oracle(TEMPLATES)
