"""License scans: plain phrases, and templates compiled to token automata.

Template markup: ``[[ ... ]]`` is optional wording, which may nest; ``{{n}}`` stands for one to n words of
any kind; all else is mandatory and must match word for word, after A-Z are lower-cased and words are
taken as runs of ASCII letters, digits and characters beyond ASCII. A template becomes an automaton over
words whose states are places in it; optional parts are edges without a word, replaceable parts are
states that any word leads on from, as often as allowed. A text is accepted at a place if the automaton
can end there; the longest acceptance counts. Places to try are found by a run of words that every
match must hold, its anchor, looked up in the whole text by substring search.

score is the share of the document's words that lie in accepted templates or phrases.

Defined results: null texts count as empty and have no words, no labels and score 0; overlapping phrases
and templates each count, words only once; repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ipquarry.llm.common import table, texts, trim

#: Phrase, label.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: The wordings of licences and of the notices that their publishers ask for.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this {{3}} [[and associated documentation files]]
[[(the "{{1}}")]], to deal in the {{1}} without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the {{1}}, and to permit persons to whom the {{1}} is furnished to do so, subject to the
following conditions: The above copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all
copies or substantial portions of the {{1}}. THE {{1}} IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {{8}} BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE {{1}} OR THE USE OR OTHER DEALINGS IN THE {{1}}."""
_ISC = """Permission to use, copy, modify, [[and]] [[or]] distribute this software [[and its documentation]] for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
AND {{8}} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT
SHALL {{8}} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use [[of this software]] in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: [[1|a]] Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. [[2|b]] Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_NAMES = """[[3|c]] Neither the name of {{12}} nor the names of {{3}} contributors may be used to endorse or promote products derived from this
software without specific prior written permission. """
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY {{12}} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {{12}} BE LIABLE FOR ANY DIRECT,
INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY
OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this {{2}} except in compliance with the License. You may
obtain a copy of the License at [[http|https]] www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at [[http|https]] [[www]] mozilla.org/MPL/2.0 [[This Source Code Form is "Incompatible With Secondary Licenses", as defined
by the Mozilla Public License, v. 2.0.]]"""
_GNU = """is free software; you can redistribute it and/or modify it under the terms of the GNU NAME General Public License as published by the Free
Software Foundation, [[either]] version {{2}} of the License[[, or (at your option) any later version|only]]. {{6}} is distributed in the hope
that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See
the GNU NAME General Public License for more details. [[You should have received a copy of the GNU NAME General Public License along with {{4}}
[[If not, see [[http|https]] [[www]] gnu.org/licenses]] ]]"""

#: label, template
TEMPLATES = [
    ("mit-notice", "[[this [[software|work|project|program|code]] is]] [[released|licensed|distributed|available]] under the [[terms of the]] mit license"),
    ("mit-text", _MIT),
    ("isc-text", _ISC),
    ("apache-2.0-notice", 'Licensed under the Apache License, [[Version]] 2.0 [[(the "License")]] [[you may not use this {{2}} except in compliance with the License]] [[You may obtain a copy of the License at {{12}} licenses license 2.0]]'),
    ("apache-2.0-text", _APACHE),
    ("mpl-2.0-text", _MPL),
    ("gpl-notice", "[[this [[work|program|software]] is]] [[licensed|released|distributed]] under the [[terms of the]] gnu [[lesser|affero]] general public license [[as published by the free software foundation]] [[either]] [[version {{1}} [[0]] [[of the license]]]] [[or at your option any later version]]"),
    ("gpl-text", _GNU.replace("NAME ", "")),
    ("lgpl-text", _GNU.replace("NAME", "Lesser")),
    ("agpl-text", _GNU.replace("NAME", "Affero")),
    ("cc-notice", "[[this {{2}} is]] licensed under [[a|the]] [[creative commons]] cc by [[nc]] [[nd|sa]] {{1}} [[0]] [[international|unported]] [[license]]"),
    ("bsd-2-text", _BSD_GRANT + _BSD_WARRANTY),
    ("bsd-3-text", _BSD_GRANT + _BSD_NAMES + _BSD_WARRANTY),
    ("copyright-notice", "copyright [[c]] {{8}} all rights reserved"),
]

_TABLE = bytes(ord(chr(b).lower()) if chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else 0x20 for b in range(256))


def words(text: str | bytes | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(_TABLE).split()


class Automaton:
    """States are numbered; edges: word -> states; any: states that every word leads to; free: without a word."""

    def __init__(self, template: str):
        self.edges: list[dict[bytes, list[int]]] = [{}]
        self.any: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        tokens = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\||(?:(?!\[\[|\]\]|\{\{|\|).)+", template, re.DOTALL)
        self._at, self._tokens = 0, tokens
        self.end, runs = self._sequence(0, True)
        #: The longest run of mandatory words; every match holds it.
        self.anchor = max(runs, key=lambda r: sum(map(len, r)))
        self._closed: dict[frozenset, frozenset] = {}

    def _state(self) -> int:
        self.edges.append({})
        self.any.append([])
        self.free.append([])
        return len(self.edges) - 1

    def _sequence(self, at: int, mandatory: bool) -> tuple[int, list[list[bytes]]]:
        runs: list[list[bytes]] = [[]]
        while self._at < len(self._tokens):
            token = self._tokens[self._at]
            if token in ("]]", "|"):
                break
            self._at += 1
            if token == "[[":
                start, end = at, self._state()
                self.free[start].append(end)
                while True:
                    branch = self._state()
                    self.free[start].append(branch)
                    self.free[self._sequence(branch, False)[0]].append(end)
                    self._at += 1
                    if self._tokens[self._at - 1] == "]]":
                        break
                at = end
                runs.append([])
            elif token.startswith("{{"):
                end = self._state()
                for _ in range(int(token[2:-2])):
                    step = self._state()
                    self.any[at].append(step)
                    self.free[step].append(end)
                    at = step
                at = end
                runs.append([])
            else:
                for word in words(token):
                    step = self._state()
                    self.edges[at].setdefault(word, []).append(step)
                    at = step
                    runs[-1].append(word)
        return at, runs if mandatory else []

    def _reach(self, states: frozenset) -> frozenset:
        if (got := self._closed.get(states)) is None:
            todo, seen = list(states), set(states)
            while todo:
                for s in self.free[todo.pop()]:
                    if s not in seen:
                        seen.add(s)
                        todo.append(s)
            got = self._closed[states] = frozenset(seen)
        return got

    @functools.cached_property
    def longest_before(self) -> int:
        """Most words that can stand before the anchor's first one; more than enough: all a match can hold."""
        return sum(map(len, self.any)) + sum(map(len, self.edges))

    def match(self, items: list[bytes], at: int) -> int:
        """Where the longest match that begins at a word ends (exclusive), or -1."""
        states, best = self._reach(frozenset([0])), -1
        for i in range(at, len(items) + 1):
            if self.end in states:
                best = i
            if i == len(items):
                break
            word, to = items[i], []
            for s in states:
                to += self.edges[s].get(word, ())
                to += self.any[s]
            if not to:
                break
            states = self._reach(frozenset(to))
        return best


@functools.cache
def automata(templates: tuple) -> list[tuple[str, Automaton, bytes]]:
    return [(label, a := Automaton(t), b" " + b" ".join(a.anchor) + b" ") for label, t in templates]


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Numbers of the words at which a phrase, with a space on both sides, begins."""
    out, at, upto, n = [], joined.find(phrase), 0, -1
    while at >= 0:
        n += joined.count(b" ", upto, at + 1)
        upto = at + 1
        out.append(n)
        at = joined.find(phrase, at + 1)
    return out


def scan_text(text, templates: tuple = tuple(TEMPLATES)) -> dict:
    """n_words, base: [(word, label)] of phrases, found: [(first word, end, label)] of templates."""
    items = words(text)
    joined = b" " + b" ".join(items) + b" "
    base = [(i, label, len(phrase.split())) for phrase, label in PHRASES for i in places(joined, b" " + phrase.encode() + b" ")]
    found = []
    for label, automaton, anchor in automata(templates):
        tried, upto = set(), 0
        for i in places(joined, anchor):
            # the earliest begin whose match covers the anchor; a text that was accepted isn't entered again
            for start in range(max(upto, i - automaton.longest_before), i + 1):
                if start in tried:
                    continue
                tried.add(start)
                end = automaton.match(items, start)
                if end > i:
                    found.append((start, end, label))
                    upto = end
                    break
    return {"n_words": len(items), "base": base, "found": found}


def score(got: dict) -> float:
    """Share of the words that lie in what was found."""
    if not got["n_words"]:
        return 0.0
    at = sorted([(i, i + n) for i, _, n in got["base"]] + [(a, b) for a, b, _ in got["found"]])
    covered = end = 0
    for a, b in at:
        covered += max(0, b - max(a, end))
        end = max(end, b)
    return covered / got["n_words"]


def scan(docs: DataFrame, templates=tuple(TEMPLATES)) -> DataFrame:
    """A row for each document: counts, labels and score (see report), and matches: array<struct<label, start, end>> in words."""
    templates = tuple(map(tuple, templates))
    span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shape = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", span)])

    def run(batches):
        for batch in batches:
            trim()
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                got = scan_text(text.as_buffer().to_pybytes(), templates)
                at = [i for i, _, _ in got["base"]]
                own = {label for _, label, _ in got["base"]}
                rows.append({
                    "doc_id": doc_id, "n_words": got["n_words"], "n_base": len(at), "first_word": min(at, default=None), "last_word": max(at, default=None),
                    "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | {x for _, _, x in got["found"]})), "score": score(got),
                    "matches": [{"label": x, "start": a, "end": b} for a, b, x in got["found"]],
                })
            yield pa.RecordBatch.from_pylist(rows, shape)

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long>>")


QUERIES = {"op5_license_scan": lambda spark, sf_dir: scan(table(spark, sf_dir, "documents")).drop("matches")}
ORACLE_SQL: dict[str, str] = {}
