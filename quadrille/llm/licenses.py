"""License scans: phrases, and templates compiled into automata over words."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates, full texts and short notices. ``<<beginOptional>>`` and ``<<endOptional>>`` enclose wording that may be absent;
#: ``<<var;name;least;most>>`` is replaced by so many words; ``<<var;name;x|y z>>`` by one of these. All else is mandatory.
TEMPLATES = {
    "mit-notice": "<<var;verb;released|licensed|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>expat<<endOptional>> mit license",
    "apache-2.0-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2 0",
    "gpl-notice": "<<var;verb;licensed|released|distributed|available>> under the <<beginOptional>>terms of the<<endOptional>> gnu <<beginOptional>><<var;kind;lesser|library|affero>><<endOptional>> general public license <<beginOptional>><<var;word;version|v>><<endOptional>> <<var;number;2|3|2 0|2 1|3 0>>",
    "cc-by-notice": "<<var;verb;licensed|released|distributed|available>> under <<beginOptional>><<var;article;a|the>><<endOptional>> <<var;name;cc by|creative commons attribution>> <<beginOptional>><<var;terms;sa|nc|nd|nc sa|nc nd|sharealike|noncommercial>><<endOptional>> <<beginOptional>>version<<endOptional>> <<var;number;1 0|2 0|2 5|3 0|4 0>> <<beginOptional>><<var;where;international|unported|generic>><<endOptional>> <<beginOptional>>license<<endOptional>>",
    "reserved-notice": "<<var;mark;copyright|copyright c|copr>> <<var;owner;1;12>> all rights reserved",
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        <<beginOptional>>the software<<endOptional>> to deal in the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following
        conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies
        or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall <<var;holder;1;12>> be liable for any claim damages or
        other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in
        the software""",
    "isc": """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;holder;1;12>> disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var;holder;1;12>> be liable for
        any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract
        negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following
        disclaimer in the documentation and or other materials provided with the distribution <<beginOptional>>3<<endOptional>> <<beginOptional>>neither the name of
        <<var;holder;1;12>> nor the names of <<var;whose;its|their|his|other>> contributors may be used to endorse or promote products derived from this software
        without specific prior written permission<<endOptional>> this software is provided by <<var;holder;1;12>> as is and any express or implied warranties
        including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
        <<var;holder;1;12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of
        substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
        liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "apache-2.0": """licensed under the apache license version 2 0 <<beginOptional>>the license<<endOptional>> you may not use this <<var;what;file|work|software>> except
        in compliance with the license you may obtain a copy of the license at <<var;scheme;http|https>> www apache org licenses license 2 0 <<beginOptional>>html<<endOptional>>
        <<beginOptional>>txt<<endOptional>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is
        basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations
        under the license""",
    "gpl": """<<var;what;this program|this library|this software|this file|it>> is free software you can redistribute it and or modify it under the terms of the gnu <<beginOptional>><<var;kind;lesser|library|affero>><<endOptional>>
        general public license as published by the free software foundation either version <<var;number;1;2>> of the license or at your option any later version
        <<var;what;1;4>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for
        a particular purpose see the gnu <<beginOptional>><<var;kind;lesser|library|affero>><<endOptional>> general public license for more details you should have
        received a copy of the gnu <<beginOptional>><<var;kind;lesser|library|affero>><<endOptional>> general public license along with <<var;what;1;4>> if not
        <<beginOptional>>see <<var;scheme;http|https>> www gnu org licenses<<endOptional>> <<beginOptional>>write to the free software foundation inc <<var;address;4;14>><<endOptional>>""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this
        software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize
        copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for
        the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in
        perpetuity of all present and future rights <<var;rights;to this|over this>> software under copyright law the software is provided as is without warranty of any
        kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall
        the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
        software or the use or other dealings in the software <<beginOptional>>for more information please refer to <<var;scheme;http|https>> unlicense org<<endOptional>>""",
}

#: How much a label of either kind says.
PHRASE_WEIGHT, TEMPLATE_WEIGHT = 0.5, 0.9

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKUP = re.compile(r"<<[^>]*>>|[^\s<]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text lower-cased in A-Z: runs of a-z, 0-9 and characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Automaton:
    """A template as a nondeterministic automaton whose steps read a word.

    State i has ``moves[i]``: word (None: any) -> next states, and ``free[i]``: states
    reached without a word.
    """

    def __init__(self, markup: str):
        self.moves: list[list[tuple[bytes | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        at, opened = 0, []
        for token in _MARKUP.findall(markup):
            if token == "<<beginOptional>>":
                opened.append(at)
            elif token == "<<endOptional>>":
                at = self._join([at, opened.pop()])
            elif token.startswith("<<var;"):
                _, _, *rest = token[2:-2].split(";")
                at = self._any(at, int(rest[0]), int(rest[1])) if len(rest) == 2 else self._join([self._words(at, x.split()) for x in rest[0].split("|")])
            else:
                at = self._words(at, [token])
        if opened:
            raise ValueError("an optional region isn't closed")
        self.end = at
        self.start = self._closed({0})
        self.first = {w for s in self.start for w, _ in self.moves[s]}

    def _new(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def _words(self, at: int, words: list[str]) -> int:
        for w in words:
            to = self._new()
            self.moves[at].append((w.encode(), to))
            at = to
        return at

    def _any(self, at: int, least: int, most: int) -> int:
        ends = [at] if least == 0 else []
        for k in range(1, most + 1):
            to = self._new()
            self.moves[at].append((None, to))
            at = to
            if k >= least:
                ends.append(at)
        return self._join(ends)

    def _join(self, states: list[int]) -> int:
        to = self._new()
        for s in states:
            self.free[s].append(to)
        return to

    def _closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def match(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run that starts at word ``at``, or -1."""
        states, found = self.start, -1
        while states:
            if self.end in states:
                found = at
            if at == len(words):
                break
            w = words[at]
            states = self._closed({to for s in states for x, to in self.moves[s] if x is None or x == w})
            at += 1
        return found


@lru_cache(1)
def automata() -> dict[str, Automaton]:
    return {name: Automaton(markup) for name, markup in TEMPLATES.items()}


@lru_cache(1)
def _starts() -> dict[bytes, list[str]]:
    found: dict[bytes, list[str]] = {}
    for name, a in automata().items():
        for w in a.first:
            if w is None:
                raise ValueError(f"{name} must begin with wording")
            found.setdefault(w, []).append(name)
    return found


def scan_text(text: str | None) -> tuple[int, list[int], list[str], list[tuple[str, int, int]]]:
    """(number of words, starts of the phrases, their labels, template matches as (label, start, end) in words)."""
    words = words_of(text)
    present = set(words)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.encode().split()
        if present.issuperset(parts):
            n = len(parts)
            own = [i for i in range(len(words) - n + 1) if words[i] == parts[0] and words[i : i + n] == parts]
            places += own
            labels |= {label} if own else set()
    matches = []
    starts = _starts()
    if not present.isdisjoint(starts):
        for i, w in enumerate(words):
            for name in starts.get(w, ()):
                if (end := automata()[name].match(words, i)) >= 0:
                    matches.append((name, i, end))
    return len(words), sorted(places), sorted(labels), matches


_RESULT = "doc_id long, n_words long, starts array<long>, base_labels array<string>, matches array<struct<label:string,start:long,end:long>>, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, starts, base_labels, matches, score), one for each row.

    starts are all places of the phrases; matches are runs of words that a template
    accepts, the longest from each start: mandatory wording must be there exactly, in
    order. score is 1 minus the product, over distinct labels, of what their weight
    leaves open. Null texts count as empty: no words, empty lists, score 0.
    """
    matches_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = [scan_text(t) for t in batch.column(1).to_pylist()]
            scores = [1 - (1 - PHRASE_WEIGHT) ** len(labels) * (1 - TEMPLATE_WEIGHT) ** len({m[0] for m in matches}) for _, _, labels, matches in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                    pa.array([[{"label": a, "start": b, "end": c} for a, b, c in r[3]] for r in rows], matches_type),
                    pa.array(scores, pa.float64()),
                ],
                ["doc_id", "n_words", "starts", "base_labels", "matches", "score"],
            )

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, _RESULT)
