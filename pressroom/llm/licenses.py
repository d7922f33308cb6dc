"""Licence statements by sentence rules.

Sentences of a text are normalised (lower case, everything but letters and digits a single space) and
mapped to identifiers of known licence sentences. A licence is recognised where the identifiers of one of
its rules stand in the text in the order of the rule, with at most ``GAP`` other known sentences
between two of them. Of rules that match at the same place the one with most sentences counts.

A sentence ends at a full stop, question or exclamation mark, colon or semicolon before white space, and at
a blank line. As licence lines also stand between other lines without a stop, every line is tried as
a sentence too. A known sentence with a stop inside is known by its parts, which must follow each other
with nothing between them; together they count as one sentence.

Defined results: null and empty texts have no sentence and no licence. Sentences of any length are
read; a licence stated twice has two matches. Repeated rows have a result each. Only ``doc_id`` and ``text``
are looked at.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = 2
# Known licence sentences by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "mit-short": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "reserved": "All rights reserved",
}
# Rules as licence and sentences in order.
RULES = [
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-short", "apache-may-not", "apache-copy", "apache-as-is"]),
    ("Apache-2.0", ["apache-copy", "apache-as-is"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("GPL-3.0", ["gpl3-short"]),
    ("GPL-3.0", ["gpl-redistribute", "gpl-hope"]),
    ("GPL-3.0", ["gpl-redistribute", "gpl-hope", "gpl-copy"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-long"]),
    ("CC-BY-4.0", ["cc-by-short"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-short"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-long"]),
    ("All-rights-reserved", ["reserved"]),
]

_OTHER = re.compile(r"[^a-z0-9]+")
_STOP = re.compile(r"[.!?:;]+(?=\s|\Z)|\n[ \t\r]*\n")
_SIGN = re.compile(r"[A-Za-z0-9]+")
_LINE = re.compile(r"[^\n]+")


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


class Rules:
    """Known sentences and rules, ready to look up."""

    def __init__(self, sentences: dict[str, str], rules: list[tuple[str, list[str]]]) -> None:
        self.ids = {normalise(s): name for name, s in sentences.items()}
        # parts of sentences with stops inside: by their first part, the others in order
        self.parts: dict[str, list[tuple[list[str], str]]] = {}
        for name, s in sentences.items():
            parts = [part for part in map(normalise, _STOP.split(s)) if part]
            if len(parts) > 1:
                self.parts.setdefault(parts[0], []).append((parts[1:], name))
        self.heads = {part.split()[0] for first, others in self.parts.items() for rest, _ in others for part in (first, *rest)}
        self.longest = max(map(len, self.ids), default=0)
        self.by_first: dict[str, list[tuple[str, list[str]]]] = {}
        for licence, order in sorted(rules, key=lambda r: -len(r[1])):
            self.by_first.setdefault(order[0], []).append((licence, order))
        # a text without any of these words has no known sentence: each sentence has its longest one
        words = {max(s.split(), key=len) for s in self.ids if s}
        self.signs = re.compile("|".join(sorted(words)), re.I) if words else None

    def known(self, text: str) -> list[tuple[int, int, str]]:
        """Begin, end and identifier of each known sentence, in order."""
        if self.signs is None or self.signs.search(text) is None:
            return []
        spans, at, found = set(), 0, set()
        for stop in _STOP.finditer(text):
            spans.add((at, stop.start()))
            at = stop.end()
        spans.add((at, len(text)))
        spans.update(m.span() for m in _LINE.finditer(text))
        # sentences that begin at a line within a longer stretch without a stop
        reach = 4 * self.longest + 400
        for a, b in list(spans):
            line = text.find("\n", max(a, b - reach), b)
            while line >= 0:
                spans.add((line + 1, b))
                line = text.find("\n", line + 1, b)
        if self.parts:
            ends: dict[int, list[int]] = {}
            for a, b in spans:
                first = _SIGN.search(text, a, b) if b - a <= reach else None
                if first and first.group().lower() in self.heads:
                    ends.setdefault(first.start(), []).append(b)
            for begin, stops in ends.items():
                for b in stops:
                    for rest, name in self.parts.get(normalise(text[begin:b]), []):
                        stop = self._follow(text, b, rest, ends)
                        if stop is not None:
                            found.add((begin, begin + len(text[begin:stop].rstrip(" \t\r\n.!?:;")), name))
        in_parts = {(b, name) for _, b, name in found}
        for a, b in spans:
            if b - a <= reach:
                name = self.ids.get(normalise(text[a:b]))
                if name is not None:
                    part = text[a:b]
                    end = a + len(part.rstrip(" \t\r\n.!?:;"))
                    if (end, name) not in in_parts:
                        found.add((a + len(part) - len(part.lstrip()), end, name))
        return sorted(found)

    @staticmethod
    def _follow(text: str, at: int, rest: list[str], ends: dict[int, list[int]]) -> int | None:
        """Where the last of the parts ends if they follow from ``at`` on."""
        for part in rest:
            first = _SIGN.search(text, at)
            at = next((b for b in ends.get(first.start(), []) if normalise(text[first.start() : b]) == part), None) if first else None
            if at is None:
                return None
        return at

    def matches(self, text: str | None) -> tuple[int, list[tuple[str, int, int]]]:
        """Known sentences, and licence, begin and end of each match."""
        known = self.known(text or "")
        out, at = [], 0
        while at < len(known):
            took = 1
            for licence, order in self.by_first.get(known[at][2], []):
                place = at
                for name in order[1:]:
                    nearby = range(place + 1, min(place + 2 + GAP, len(known)))
                    place = next((k for k in nearby if known[k][2] == name), None)
                    if place is None:
                        break
                if place is not None:
                    out.append((licence, known[at][0], known[place][1]))
                    took = place - at + 1
                    break
            at += took
        return len(known), out


_KIND = pa.struct([("licence", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def license_scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """``doc_id, n_sentences, matches`` for every row: known sentences, and licences with their place in characters."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Rules(sentences, rules)
        for part in parts:
            found = [ready.matches(t) for t in part.column("text").to_pylist()]
            spans = [[{"licence": x, "start": a, "stop": b} for x, a, b in m] for _, m in found]
            yield pa.record_batch(
                [part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array(spans, pa.list_(_KIND))],
                names=["doc_id", "n_sentences", "matches"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_sentences bigint, matches array<struct<licence: string, start: bigint, stop: bigint>>"
    )


def licence_names(matches: str = "matches"):
    """The different licences of a row, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.col(matches)["licence"])), ",")
