import re

import pytest

from ipquarry.llm import licenses as L

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    """The contract's base by plain search."""
    w = re.findall(WORD, lower(text))
    places = [(i, label) for phrase, label in L.PHRASES for i in range(len(w)) if w[i : i + len(p := phrase.split())] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    "This work is licensed under the GNU General Public License, version 3.\nfoo", "All rights reserved.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
    "", None, "cc by cc by", "CC-BY", "ccby", "cc  BY.", "ÜCC by", "cc byé", "general public licenses", "all rights\x00reserved all rights reserved all rights reserved", "x " * 30000 + "cc by " + "y " * 30000, "[cc][by]", "cc0by",
]


def test_base_against_plain_search(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, labels string, score int").repartition(3)
    got = {r["doc_id"]: r for r in L.scan(docs).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert L.scan(docs.limit(0)).count() == 0


def test_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in L.QUERIES["op5_license_scan"](spark, "/root/testdata/sf0.001").collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(texts[r["doc_id"]])


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Released under the MIT License.", {"mit-notice"}), ("released under the MIT Licence", set()), ("under the terms of the MIT license", {"mit-notice"}), ("MIT License", set()),
        ("this software is distributed under the MIT license", {"mit-notice"}), ("Licensed under the Apache License, Version 2.0.", {"apache-2.0-notice"}), ("Licensed under the Apache License 2.0", {"apache-2.0-notice"}),
        ("Licensed under the Apache License, Version 1.1", set()), ("under the GNU Lesser General Public License", {"gpl-notice"}), ("licensed under a Creative Commons CC BY-NC-SA 4.0 International License", {"cc-notice"}),
        ("Copyright (c) 2020 Some Body. All rights reserved", {"copyright-notice"}), ("Copyright one two three four five six seven eight nine ten All rights reserved", set()),
        # the grant alone, or with other conditions, isn't the licence
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", set()),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in the Software without restriction, EXCEPT that nobody may sell it", set()),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this font to deal in the font without limits", set()),
    ],
)
def test_templates(text, labels):
    assert {x for _, _, x in L.scan_text(text)["found"]} == labels


def expanded(tokens):
    """Every wording of a parsed template whose replaceable parts are written ?."""
    if not tokens:
        return [[]]
    head, rest = tokens[0], expanded(tokens[1:])
    options = [[head]] if isinstance(head, str) else [[], *(x for branch in head for x in expanded(branch))]
    return [a + b for a in options for b in rest]


def test_automaton_against_expansion():
    import itertools

    automaton = L.Automaton("a [[b|c [[d]]]] e {{2}} f")
    wordings = expanded(["a", [["b"], ["c", [["d"]]]], "e"])
    accepted = {tuple(w) + tuple(x) + ("f",) for w in wordings for n in (1, 2) for x in itertools.product("abcdefz", repeat=n)}
    for n in range(1, 6):
        for text in itertools.product("abcdefz", repeat=n):
            assert (automaton.match([t.encode() for t in text], 0) == n) == (text in accepted)
    for text in accepted:
        assert automaton.match([t.encode() for t in text], 0) >= len(text)


def test_longest_match_and_spans():
    got = L.scan_text("x Licensed under CC BY-NC 4.0 License y licensed under cc by 3")
    assert got["found"] == [(1, 9, "cc-notice"), (10, 15, "cc-notice")]
    assert L.score(got) == pytest.approx(13 / 15)


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "foo one two bar"), (2, "foo bar")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(docs, [("own", "foo {{3}} bar")]).collect()}
    assert got[1]["labels"] == "own" and [tuple(m) for m in got[1]["matches"]] == [("own", 0, 4)]
    assert got[2]["labels"] == "" and got[2]["score"] == 0


MIT = """MIT License

Copyright (c) 2021 Jane Q. Public

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
NAMES
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/."""
GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU NAMEGeneral Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU NAMEGeneral Public License for more details.

You should have received a copy of the GNU NAMEGeneral Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
WHOLE = [
    ("mit-text", MIT), ("isc-text", ISC), ("bsd-2-text", BSD.replace("NAMES", "")), ("bsd-3-text", BSD.replace("NAMES", NAMES)), ("apache-2.0-text", APACHE), ("mpl-2.0-text", MPL),
    ("gpl-text", GNU.replace("NAME", "")), ("lgpl-text", GNU.replace("NAME", "Lesser ")), ("agpl-text", GNU.replace("NAME", "Affero ")),
]


def texts_of(text):
    return {x for _, _, x in L.scan_text(text)["found"] if x.endswith("-text")}


@pytest.mark.parametrize(("label", "text"), WHOLE, ids=[x for x, _ in WHOLE])
def test_whole_licences(label, text):
    assert texts_of(text) == {label}
    assert texts_of("before it, words. " * 50 + text.upper() + " and after it") == {label}
    wording = L.words(text)
    template = dict(L.TEMPLATES)[label]
    fixed = {w.decode() for w in L.words(re.sub(r"\[\[.*?\]\]|\{\{\d+\}\}", " ", template, flags=re.DOTALL))}
    # without any one of the words that stand in mandatory places, or with another in its place, it isn't accepted
    opens = next(a for a, _, x in L.scan_text(text)["found"] if x == label)
    rare = [i for i in range(opens, len(wording)) if wording.count(wording[i]) == 1 and wording[i].decode() in fixed and len(wording[i]) > 5]
    assert len(rare) > 4
    inside = next(b for _, b, x in L.scan_text(text)["found"] if x == label)
    for i in [i for i in rare if i < inside - 12][::3]:
        for other in ([], [b"otherwise", b"altered", b"words"]):
            assert label not in texts_of(b" ".join(wording[:i] + other + wording[i + 1 :])), wording[i]


def pattern(template):
    """The template as a regular expression over words with a space after each, by its own parser."""
    out = []
    for token in re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\||(?:(?!\[\[|\]\]|\{\{|\|).)+", template, re.DOTALL):
        if token == "[[":
            out.append("(?:(?:")
        elif token == "]]":
            out.append("))?")
        elif token == "|":
            out.append(")|(?:")
        elif token.startswith("{{"):
            out.append(rf"(?:[^ ]+ ){{1,{token[2:-2]}}}")
        else:
            out += [re.escape(w) + " " for w in re.findall(WORD, lower(token))]
    return "".join(out)


def plain(text, templates):
    """labels and score by leftmost-longest regular expressions at every place."""
    import regex

    w = re.findall(WORD, lower(text))
    joined = "".join(x + " " for x in w)
    starts = {}
    for x in w:
        starts[sum(len(y) + 1 for y in w[: len(starts)])] = len(starts)
    starts[len(joined)] = len(w)
    covered, labels = set(), set()
    for phrase, label in L.PHRASES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                labels.add(label)
                covered |= set(range(i, i + len(p)))
    for label, template in templates:
        for m in regex.finditer(rf"(?p)(?<![^ ]){pattern(template)}", joined):
            labels.add(label)
            covered |= set(range(starts[m.start()], starts[m.end()]))
    return ",".join(sorted(labels)), len(covered) / len(w) if w else 0.0


def test_labels_and_scores_against_regular_expressions(spark):
    import random

    rng = random.Random(4)
    own = [("one", "a [[b|c [[d]]]] e {{2}} f"), ("two", "[[x]] y [[{{3}}]] z z"), ("three", "cc by {{2}} a [[b]] e"), ("four", "f f")]
    rows = [" ".join(rng.choice("a b c d e f x y z cc by".split()) for _ in range(rng.randrange(0, 60))) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in L.scan(docs, own).collect()}
    for i, t in enumerate(rows):
        labels, score = plain(t, own)
        assert got[i][0] == labels and got[i][1] == pytest.approx(score), t
    every = [t for t, _ in [(x, 0) for x in TEXTS if x and len(x) < 1000]] + [t for _, t in WHOLE]
    for t in every + [" ".join(rng.sample(every, 3)) for _ in range(20)]:
        found = L.scan_text(t)
        labels = ",".join(sorted({x for _, x, _ in found["base"]} | {x for _, _, x in found["found"]}))
        want = plain(t, L.TEMPLATES)
        assert (labels, pytest.approx(L.score(found))) == want, t
