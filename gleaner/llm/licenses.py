"""License scans by template-markup matching.

A template is a text with marked regions: ``[[optional words]]`` may be missing, ``{{n}}`` stands for up to n words of
any kind (a name, a year, a replaceable phrase). Templates are compiled to automata over words; a text is accepted where
the mandatory wording stands exactly, with optional regions present or not and replaceable regions filled in any way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.arrow import column, map_arrow, pieces, texts

#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Templates by label: wording of public license texts (-text) and of the notices that refer to them (-notice) (fixed values).
_AS_IS = (
    "[[the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
    "particular purpose and noninfringement in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings in the software]]"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions "
    "of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce "
    "the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
_FREE = (
    "{{4}} is free software you can redistribute it and or modify it under the terms of the gnu {{1}} general public license as published by the free software "
    "foundation either version {{2}} of the license or [[at your option]] any later version [[{{5}} is distributed in the hope that it will be useful but without any "
    "warranty without even the implied warranty of merchantability or fitness for a particular purpose]]"
)
TEMPLATES = {
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of {{12}} to deal in {{4}} without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of {{4}} and to permit persons to whom {{4}} furnished "
    "to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in "
    "all copies or substantial portions of {{4}} " + _AS_IS,
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
    "copyright notice and this permission notice appear in all copies [[the software is provided as is and the author disclaims all warranties with regard to this "
    "software including all implied warranties of merchantability and fitness]]",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-2-clause-text": _BSD,
    "bsd-3-clause-text": _BSD + " [[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the "
    "use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "boost-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    "this license the software to use reproduce display distribute execute and transmit the software",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "apache-2.0-text": "apache license version 2 0 january 2004 [[http www apache org licenses]] terms and conditions for use reproduction and distribution",
    "mpl-2.0-text": "mozilla public license version 2 0 [[{{3}}]] 1 definitions 1 1 contributor means each individual or legal entity that creates contributes to the "
    "creation of or owns covered software",
    "gpl-text": "the gnu general public license is a free copyleft license for software and other kinds of works",
    "mit-notice": "[[this {{3}} is]] released under the [[terms of the]] mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0 [[the license you may not use {{4}} except in compliance with the license you may obtain a copy of "
    "the license at {{10}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
    "warranties or conditions of any kind either express or implied]]",
    "gpl-2.0-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 2",
    "gpl-3.0-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation either]] version 3",
    "gpl-or-later-notice": "this " + _FREE,
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 [[if a copy of the mpl was not distributed with this file you can "
    "obtain one at {{8}}]]",
    "cc-by-notice": "licensed under [[a]] [[the]] [[creative commons]] cc by",
    "cc-by-4.0-notice": "licensed under [[a]] [[the]] creative commons attribution 4 0 [[international]] license",
    "cc0-notice": "to the extent possible under law {{12}} waived all copyright and related or neighboring rights to",
}
#: Bytes of lower-case text: what is not a letter, a digit or beyond ASCII is a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARK = re.compile(r"(\[\[|\]\]|\{\{\d+\}\})")


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass
class Automaton:
    """States are numbers; ``step`` leads on by a word, ``any`` by any word, ``skip`` without one. State 0 begins."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any: list[list[int]] = field(default_factory=lambda: [[]])
    skip: list[list[int]] = field(default_factory=lambda: [[]])
    last: int = 0

    def add(self) -> int:
        self.step.append({}), self.any.append([]), self.skip.append([])
        return len(self.step) - 1

    @staticmethod
    def compile(template: str) -> Automaton:
        out, at, opened = Automaton(), 0, []
        for part in _MARK.split(template):
            if part == "[[":
                opened.append(at)
                continue
            if part == "]]":
                out.skip[opened.pop()].append(at)
                continue
            if part.startswith("{{"):
                entry, ends = at, []
                for _ in range(int(part[2:-2])):
                    new = out.add()
                    out.any[at].append(new)
                    at = new
                    ends.append(at)
                end = out.add()
                for x in (entry, *ends):
                    out.skip[x].append(end)
                at = end
                continue
            for word in words_of(part):
                new = out.add()
                # A state gets one word only; another branch needs a state of its own.
                out.step[at][word] = new
                at = new
        if opened:
            raise ValueError("an optional region is not closed")
        out.last = at
        return out

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for x in self.skip[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return states

    def firsts(self) -> set[bytes]:
        """The words that a match can begin with."""
        begin = self.closed({0})
        if self.last in begin or any(self.any[s] for s in begin):
            raise ValueError("a template must begin with a word of its own")
        return {w for s in begin for w in self.step[s]}

    def match(self, words: list[bytes], start: int) -> int:
        """The end of the longest match that begins at word ``start``, or -1."""
        states, end = self.closed({0}), -1
        for i in range(start, len(words)):
            states = self.closed({t for s in states if (t := self.step[s].get(words[i])) is not None} | {t for s in states for t in self.any[s]})
            if not states:
                break
            if self.last in states:
                end = i + 1
        return end


class Scanner:
    """Phrases and templates, ready for texts."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.phrases = [(b" " + b" ".join(words_of(p)) + b" ", label) for p, label in phrases.items()]
        self.automata = {label: Automaton.compile(t) for label, t in templates.items()}
        self.starts: dict[bytes, list[str]] = {}
        for label, a in self.automata.items():
            for w in sorted(a.firsts()):
                self.starts.setdefault(w, []).append(label)
        # A template can only match where its rarest mandatory words stand; the longest run of them is looked for first.
        self.needles = {label: self._needle(t) for label, t in templates.items()}

    @staticmethod
    def _needle(template: str) -> bytes:
        plain = re.sub(r"\[\[.*?\]\]", "\n", re.sub(r"\{\{\d+\}\}", "\n", template), flags=re.S)
        return max((b" " + b" ".join(words_of(x)) + b" " for x in plain.split("\n")), key=len)

    def scan(self, text: str) -> tuple[int, list[int], list[str], list[tuple[str, int, int]]]:
        """The number of words, the starts of phrases, their labels, and (label, start, end) of template matches."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        places, labels = [], []
        for phrase, label in self.phrases:
            at, before, place = line.find(phrase), 0, 0
            while at >= 0:
                place, before = place + line.count(b" ", before, at), at
                places.append(place)
                labels.append(label)
                at = line.find(phrase, at + 1)
        matches = []
        wanted = {label for label, needle in self.needles.items() if needle in line}
        if wanted:
            for i, w in enumerate(words):
                for label in self.starts.get(w, ()):
                    if label in wanted and (end := self.automata[label].match(words, i)) >= 0:
                        matches.append((label, i, end))
        return len(words), places, labels, matches


SCANNED = "doc_id long, n_words long, places array<long>, phrase_labels array<string>, matches array<struct<label:string,start:long,end:long>>"


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_words, the places (start words) of ``phrases`` with the label
    of each, and the matches of ``templates`` as label and span of words. Null and empty texts have no words; every row
    counts, repeated ones and those without doc_id too; other columns are ignored; an empty table gives an empty result.
    """
    Scanner(phrases, templates)  # a wrong template fails here
    kind = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("places", pa.list_(pa.int64())),
            ("phrase_labels", pa.list_(pa.string())),
            ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for piece in pieces(batches):
            found = [scanner.scan(t) for t in texts(piece)]
            matches = [[{"label": a, "start": b, "end": c} for a, b, c in x[3]] for x in found]
            yield pa.RecordBatch.from_arrays(
                [column(piece, "doc_id"), *(pa.array([x[k] for x in found], kind.field(k + 1).type) for k in range(3)), pa.array(matches, kind.field(4).type)], schema=kind
            )

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, SCANNED)


def license_digest(scanned: DataFrame) -> DataFrame:
    """Per row of :func:`scan_licenses`: counts, first and last place, the labels, and a score: 1 where a template is
    accepted, 0.6 where only a phrase stands, else 0."""
    base = F.array_sort(F.array_distinct("phrase_labels"))
    both = F.array_sort(F.array_distinct(F.concat("phrase_labels", F.col("matches.label"))))
    score = F.when(F.size("matches") > 0, 1.0).when(F.size("places") > 0, 0.6).otherwise(0.0)
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.concat_ws(",", base).alias("base_labels"),
        F.concat_ws(",", both).alias("labels"),
        score.alias("score"),
    )
