"""Licence scans by template markup.

A template's words are mandatory, save inside ``<<beginOptional>> ... <<endOptional>>`` (may
be absent) and ``<<var;name="...";original="...";match="...">>`` (replaceable: words whose
text, in lower case and parted by single blanks, is what the regular expression ``match``
allows).  Each template is compiled into an automaton over words; it accepts a text in which
its wording stands as consecutive words, from any place on.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, so case,
punctuation and line breaks don't matter; each mandatory word must match exactly.

Score: 1 if a template accepts, 0.5 if only a base phrase stands there, else 0.

Edge cases: a null text is empty; without words all counts are 0, labels are the empty
string and the places null.  Repeated rows get repeated results.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: What the BSD licences share; the third clause stands in between.
_BSD = """Redistribution and use in source and binary forms, with or without modification, are
        permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the
        <<beginOptional>>above<<endOptional>> copyright notice, this list of conditions and the following disclaimer.
        <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions
        and the following disclaimer in the documentation and/or other materials provided with the distribution.
        {third}
        THIS SOFTWARE IS PROVIDED BY <<var;name="holder";original="THE COPYRIGHT HOLDERS AND CONTRIBUTORS";match=".{{1,200}}">> "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
        PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;name="liable";original="THE COPYRIGHT HOLDER OR CONTRIBUTORS";match=".{{1,200}}">> BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
        OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
        LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
        THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""

#: The third clause of BSD-3-Clause, the fourth of BSD-4-Clause.
_NAMES = """<<beginOptional>>{number}<<endOptional>> Neither the name of
        <<var;name="owner";original="the copyright holder";match=".{{1,200}}">> nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission."""

#: The notice that the GNU GPL asks for, of either version.
_GPL = """This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> either version {version} of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
        without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for
        more details. You should have received a copy of the GNU General Public License along with this program"""

#: Licences in full (MIT-grant, BSD, ISC, Unlicense, Zlib), the notices that licences ask for in full (Apache-2.0-notice, GPL
#: or-later, MPL-2.0), and single sentences that name a licence, in template markup, by label.
TEMPLATES = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License");
        you may not use this file except in compliance with the License<<endOptional>>""",
    "CC-BY-NC-4.0": """<<beginOptional>>This work is<<endOptional>> licensed under
        <<beginOptional>>a<<endOptional>> <<beginOptional>>Creative Commons<<endOptional>> CC BY-NC 4.0""",
    "CC-BY-NC-4.0-long": """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        Creative Commons Attribution-NonCommercial 4.0 International License""",
    "GPL-3.0": """<<beginOptional>>This <<var;name="kind";original="work";match=".{1,30}">> is<<endOptional>>
        licensed under the GNU General Public License, version 3 <<beginOptional>>or later<<endOptional>>""",
    "GPL-notice": """This program is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or
        modify it under the terms of the GNU General Public License as published by the Free Software Foundation""",
    "ISC": """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee
        is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name="author";original="THE AUTHOR";match=".{1,100}">> DISCLAIMS ALL WARRANTIES WITH REGARD TO
        THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
        <<var;name="author";original="THE AUTHOR";match=".{1,100}">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "MIT": """Released under <<beginOptional>>the terms of<<endOptional>> the MIT License""",
    "MIT-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of
        <<var;name="software";original="this software and associated documentation files";match=".{1,200}">>
        (the <<var;name="short";original="Software";match=".{1,30}">>), to deal in
        <<var;name="short";original="the Software";match=".{1,30}">> without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of <<var;name="short";original="the Software";match=".{1,30}">>,
        and to permit persons to whom <<var;name="short";original="the Software";match=".{1,30}">> is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of
        <<var;name="short";original="the Software";match=".{1,30}">>.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;name="holder";original="THE AUTHORS OR COPYRIGHT HOLDERS";match=".{1,200}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE""",
    "BSD-2-Clause": _BSD.format(third=""),
    "BSD-3-Clause": _BSD.format(third=_NAMES.format(number="3.")),
    "BSD-4-Clause": _BSD.format(
        third="""<<beginOptional>>3.<<endOptional>> All advertising materials mentioning features or use of this software must display the
        following acknowledgement: This product includes software developed by <<var;name="owner";original="the organization";match=".{1,200}">>. """
        + _NAMES.format(number="4.")
    ),
    "Apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at
        <<beginOptional>>http://<<endOptional>><<beginOptional>>https://<<endOptional>> www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "GPL-2.0-or-later": _GPL.format(version="2"),
    "GPL-3.0-or-later": _GPL.format(version="3"),
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any
        and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
        to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
        EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
        <<beginOptional>>1.<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If
        you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
        <<beginOptional>>2.<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
        <<beginOptional>>3.<<endOptional>> This notice may not be removed or altered from any source distribution""",
}

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
_MARK = re.compile(r"<<(beginOptional|endOptional|var)((?:(?!>>).)*)>>", re.S)


class Words(list):
    """A text's words; knows how many characters stand before each, blanks aside."""

    @cached_property
    def before(self) -> list[int]:
        return [0, *accumulate(len(w.decode("utf-8", "surrogatepass")) for w in self)]

    def characters(self, since: int, to: int) -> int:
        """Of words parted by single blanks."""
        return self.before[to] - self.before[since] + max(to - since - 1, 0)


def words_of(text: str | None) -> Words:
    return Words((text or "").encode("utf-8", "surrogatepass").translate(_WORD).split())


def _rule(fields: str) -> str:
    found = re.search(r'match="([^"]*)"', fields)
    return found[1] if found else ".+"


def parse(template: str) -> list:
    """Nested parts: a word (bytes), ``("optional", parts)`` or ``("any", rule)``."""
    stack: list[list] = [[]]
    at = 0
    for m in [*_MARK.finditer(template), None]:
        stack[-1] += words_of(template[at : m.start() if m else len(template)])
        if m is None:
            break
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) < 2:
                raise ValueError("endOptional without beginOptional")
            part = stack.pop()
            stack[-1].append(("optional", part))
        else:
            stack[-1].append(("any", _rule(m[2])))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


class Region:
    """What a replaceable region allows: its text may be ``fits``, or may become so with more words (``grows``)."""

    def __init__(self, rule: str) -> None:
        found = re.fullmatch(r"\.(\+|\*|\{(\d+),(\d+)\})", rule)
        self.rule = None if found else regex.compile(rule, regex.IGNORECASE)
        if found:  # only the number of characters counts
            self.least = 0 if found[1] == "*" else int(found[2] or 1)
            self.most = int(found[3]) if found[3] else float("inf")

    def look(self, words: Words, since: int, to: int) -> tuple[bool, bool]:
        if self.rule is None:
            size = words.characters(since, to)
            return self.least <= size <= self.most, size < self.most
        text = b" ".join(words[since:to]).decode("utf-8", "surrogatepass")
        m = self.rule.fullmatch(text, partial=True)
        return m is not None and not m.partial, m is not None


class Automaton:
    """Nondeterministic over words.  A thread is a state and, within a region, the place of the region's first word."""

    def __init__(self, parts: list) -> None:
        self.steps: list[dict[bytes, set[int]]] = []  # of each state: word -> next states
        self.skips: list[set[int]] = []  # states that are reached without a word
        self.regions: dict[int, tuple[Region, int]] = {}  # of a region's state: what it allows, and the state behind
        self.last = self._add(parts, self._state())
        if not mandatory(parts):
            raise ValueError("a template needs a mandatory word")

    def _state(self) -> int:
        self.steps.append({})
        self.skips.append(set())
        return len(self.steps) - 1

    def _add(self, parts: list, at: int) -> int:
        for part in parts:
            to = self._state()
            if isinstance(part, bytes):
                self.steps[at].setdefault(part, set()).add(to)
            elif part[0] == "optional":
                self.skips[at].add(to)
                self.skips[self._add(part[1], at)].add(to)
            else:
                inside = self._state()
                self.skips[at].add(inside)
                self.regions[inside] = Region(part[1]), to
            at = to
        return at

    def _closed(self, threads: set[tuple[int, int]], words: list[bytes], at: int) -> set[tuple[int, int]]:
        """The threads that stand before word ``at``, with those that need no word to get there."""
        todo, out = list(threads), set()
        while todo:
            state, since = thread = todo.pop()
            if thread in out:
                continue
            if state in self.regions:
                region, behind = self.regions[state]
                since = at if since < 0 else since
                fits, grows = region.look(words, since, at)
                if grows:
                    out.add((state, since))
                if fits:
                    todo.append((behind, -1))
            else:
                out.add(thread)
                todo += [(s, -1) for s in self.skips[state]]
        return out

    def first(self) -> set[bytes | None]:
        """Words that a match can start with; None: any."""
        threads = self._closed({(0, -1)}, Words(), 0)
        return {w for s, _ in threads for w in self.steps[s]} | ({None} if any(s in self.regions for s, _ in threads) else set())

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the wording stands from place ``at`` on."""
        words = words if isinstance(words, Words) else Words(words)
        threads = self._closed({(0, -1)}, words, at)
        for i in range(at, len(words)):
            moved = {(to, -1) for s, _ in threads for to in self.steps[s].get(words[i], ())}
            moved |= {t for t in threads if t[0] in self.regions}
            threads = self._closed(moved, words, i + 1)
            if (self.last, -1) in threads:
                return True
            if not threads:
                return False
        return False


class Scanner:
    """All templates together; tries a template where one of its possible first words and a rarer word of it stand."""

    def __init__(self, templates: dict[str, str] | None = None) -> None:
        self.automata = {k: Automaton(parse(v)) for k, v in sorted((templates or TEMPLATES).items())}
        self.first = {k: a.first() for k, a in self.automata.items()}
        self.needs = {k: mandatory(parse(v)) for k, v in (templates or TEMPLATES).items()}

    def labels(self, words: list[bytes]) -> list[str]:
        have, out = None, []
        for label, automaton in self.automata.items():
            if have is None:
                have = set(words)
            if not self.needs[label] <= have:
                continue
            first = self.first[label]
            if any(automaton.accepts(words, i) for i, w in enumerate(words) if None in first or w in first):
                out.append(label)
        return out


def mandatory(parts: list) -> set[bytes]:
    return {p for p in parts if isinstance(p, bytes)}


_BASE = {phrase: tuple(phrase.encode().split()) for phrase in BASE}
_LOOK = re.compile(rb" (?=(" + b"|".join(re.escape(p.encode()) for p in BASE) + rb") )")


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(place, phrase) of every base phrase, in order of place."""
    line = b" " + b" ".join(words) + b" "
    out, at, n = [], 0, 0
    for m in _LOOK.finditer(line):
        n += line.count(b" ", at, m.start())
        at = m.start()
        out.append((n, m[1].decode()))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                words = words_of(text)
                places = base_places(words)
                base = {BASE[p] for _, p in places}
                own = scanner.labels(words)
                rows.append((len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(base | set(own))), 1.0 if own else 0.5 if base else 0.0))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def pattern(template: str) -> str:
    """The markup as a regular expression over words that each end in a blank, for the SQL check."""
    out, at = "", 0
    for m in [*_MARK.finditer(template), None]:
        out += "".join(w.decode() + " " for w in words_of(template[at : m.start() if m else len(template)]))
        if m:
            at = m.end()
            out += {"beginOptional": "(?:", "endOptional": ")?"}.get(m[1]) or f"(?:(?:{_rule(m[2])}) )" + "?" * (re.fullmatch(_rule(m[2]), "") is not None)
    return out


def oracle() -> str:
    """DuckDB SQL for scan() with the templates above."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hits = ", ".join(f"CASE WHEN regexp_matches(line, ' {pattern(t)}') THEN '{k}' END" for k, t in sorted(TEMPLATES.items()))
    starts = " ".join(f"WHEN {' AND '.join(f'lead(w, {i}) OVER o = {chr(39)}{w.decode()}{chr(39)}' if i else f'w = {chr(39)}{w.decode()}{chr(39)}' for i, w in enumerate(_BASE[p]))} THEN '{label}'" for p, label in BASE.items())
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
p AS (SELECT r, i, CASE {starts} END AS label FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM p WHERE label IS NOT NULL GROUP BY r),
t AS (SELECT r, doc_id, len(ws) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM d),
m AS (SELECT r, doc_id, n_words, list_filter([{hits}], lambda x: x IS NOT NULL) AS own FROM t)
SELECT m.doc_id, m.n_words::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.ls), ','), '') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), own))), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN b.n_base > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM m LEFT JOIN b USING (r)"""
