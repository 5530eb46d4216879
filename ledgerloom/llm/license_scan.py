"""License scans by template-markup matching.

A template is license wording with marked regions: `<<beginOptional>> ... <<endOptional>>` may be left out, and
`<<var;name=...;words=A-B>>` stands for any A to B words. Each is compiled into an automaton over words; a text
is accepted where an automaton reads all of its mandatory words, in order and with nothing else between them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.words import ALNUM, Words, buffer, filled, slices

#: The base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Templates and their labels: short notices, as they stand at the end of files and pages, and wording of whole licenses.
TEMPLATES = [
    ("mit", "<<beginOptional>>this <<var;name=work;words=1-4>> is<<endOptional>> <<var;name=verb;words=1-2>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;words=1-12>> to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License<<beginOptional>>,<<endOptional>> Version 2.0"),
    ("apache-2", "<<var;name=verb;words=1-2>> under the <<beginOptional>>terms of the<<endOptional>> Apache License, Version 2"),
    ("cc-by-nc", "<<var;name=verb;words=1-2>> under <<beginOptional>>a Creative Commons license<<endOptional>> CC BY-NC <<var;name=version;words=0-2>>"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial <<var;name=version;words=0-3>> License"),
    ("gpl-3", "<<beginOptional>>this <<var;name=work;words=1-4>> is<<endOptional>> licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, <<beginOptional>>either<<endOptional>> version 3"),
    ("bsd-3", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met <<var;name=text;words=0-120>> Neither the name of <<var;name=holder;words=1-12>> nor the names of its contributors may be used to endorse or promote products"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v<<beginOptional>>ersion<<endOptional>> 2.0"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name=software;words=1-12>> (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
        IN NO EVENT SHALL <<var;name=holders;words=1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;name=holder;words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"""),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name=address;words=1-8>>
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
]

_MARK = re.compile(r"<<(.*?)>>")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def text_words(text: str | bytes) -> list[bytes]:
    """Words of a text in lower case, as bytes."""
    return _WORD.findall((text.encode() if isinstance(text, str) else text).lower())


class Automaton:
    """The words a template accepts: `steps[state]` has (word or None for any, next state); `free[state]` has the states reached without a word."""

    def __init__(self, label: str, template: str):
        self.label, self.steps, self.free, self.mandatory = label, [[]], [set()], []
        depth, opened, at = 0, [], 0
        for mark in [*_MARK.finditer(template), None]:
            for word in text_words(template[at : mark.start() if mark else None]):
                self._step(word)
                if not depth:
                    self.mandatory.append(word)
            if mark is None:
                break
            at, kind = mark.end(), mark[1].partition(";")[0]
            if kind == "beginOptional":
                opened.append(len(self.steps) - 1)
                depth += 1
            elif kind == "endOptional":
                self.free[opened.pop()].add(len(self.steps) - 1)
                depth -= 1
            else:
                least, most = map(int, re.search(r"words=(\d+)-(\d+)", mark[1]).groups())
                skips = []
                for i in range(most):
                    if i >= least:
                        skips.append(len(self.steps) - 1)
                    self._step(None)
                for state in skips:
                    self.free[state].add(len(self.steps) - 1)
        self.final = len(self.steps) - 1
        self.anchor = max(self.mandatory, key=len)
        self.before = self._before()
        self.closed = [self._closure(i) for i in range(len(self.steps))]

    def _step(self, word: bytes | None) -> None:
        self.steps[-1].append((word, len(self.steps)))
        self.steps.append([])
        self.free.append(set())

    def _closure(self, state: int) -> frozenset[int]:
        seen, left = {state}, [state]
        while left:
            for x in self.free[left.pop()] - seen:
                seen.add(x)
                left.append(x)
        return frozenset(seen)

    def _before(self) -> int:
        """The most words that may stand before the anchor, over all ways through the template."""
        return max(i for i, s in enumerate(self.steps) if any(w == self.anchor for w, _ in s))

    def read(self, words: list[bytes], start: int) -> int:
        """The furthest state reached by reading from a word on; the last one is `final`."""
        states, best = self.closed[0], 0
        for word in words[start:]:
            if self.final in states:
                return self.final
            states = frozenset().union(*(self.closed[to] for s in states for w, to in self.steps[s] if w is None or w == word))
            if not states:
                return best
            best = max(best, max(states))
        return best

    def share(self, words: list[bytes]) -> float:
        """The largest share of the template's words that is read in a row from some word on, 1 where it accepts. Starts are tried before each anchor word only."""
        tried: set[int] = set()
        best = 0
        for at, word in enumerate(words):
            if word == self.anchor:
                for start in range(max(0, at - self.before), at + 1):
                    if start not in tried:
                        tried.add(start)
                        best = max(best, self.read(words, start))
                        if best == self.final:
                            return 1.0
        return best / self.final

    def found(self, words: list[bytes]) -> bool:
        return self.share(words) == 1.0


def compiled(templates: list[tuple[str, str]]) -> list[Automaton]:
    return [Automaton(*t) for t in templates]


def _columns(texts: pa.Array, phrases: list[tuple[list[bytes], str]], automata: list[Automaton], hint: re.Pattern) -> Iterator[list]:
    for a, b in slices(texts):
        part = texts.slice(a, b - a)
        data, offs = buffer(part)
        counts = Words(data, offs, ALNUM).count
        whole = data.tobytes().lower()
        for i, n in enumerate(counts.tolist()):
            text = whole[offs[i] : offs[i + 1]]
            if not hint.search(text):
                yield [n, 0, None, None, "", "", 0.0]
                continue
            words = text_words(text)
            places, base = [], set()
            for phrase, label in phrases:
                at = [j for j, w in enumerate(words) if w == phrase[0] and words[j : j + len(phrase)] == phrase]
                places += at
                base |= {label} if at else set()
            shares = [(x.share(words), x.label) for x in automata]
            full = {label for share, label in shares if share == 1.0}
            score = max([share for share, _ in shares] + [0.5 if base else 0.0])
            yield [n, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | full)), score]


_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: its words, the places of base phrases, their labels, and those with the templates' labels.

    score is the largest share of a template's wording that stands in a row, 1 where one is accepted, and 0.5 at least
    where a base phrase stands. Null texts count as empty: no words, no labels, no score. Texts of any length are read
    whole; repeated rows, and rows with a null id, are each reported; extra columns are ignored; an empty table gives no
    rows. Each row is read by itself: nothing shuffles.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        own = [(text_words(p), label) for p, label in phrases.items()]
        needed = sorted({max(p, key=len) for p, _ in own} | {x.anchor for x in automata})
        edge = rb"[0-9a-z\x80-\xff]"
        hint = re.compile(rb"(?<!" + edge + rb")(?:" + b"|".join(needed) + rb")(?!" + edge + rb")")
        for batch in batches:
            rows = list(_columns(filled(batch.column(1)), own, automata, hint))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, _SCHEMA)
