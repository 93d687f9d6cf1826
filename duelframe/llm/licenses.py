"""License scans: templates with optional and replaceable regions become token automata.

Markup of a template: ``[[words]]`` may be left out, ``{{n}}`` stands for up to n words of any kind, all else is mandatory
wording. The automaton has a state for each place between words; texts are accepted from a start where its mandatory wording
matches exactly. Case and punctuation do not count, as both sides are cut into words the same way.

A statement names its license and is complete in itself ("licensed under the MIT license"). A whole text is accepted only to its
last mandatory word: a license whose continuation was altered does not get its label, only ``<label>-opening`` if the clause that
opens it stands, and a score below 1.

Defined results: a null text is empty, has no words and score 0. Places of base phrases may overlap and each counts.
Repeated rows each get a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, rows_of, slices

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Statements by label.
STATEMENTS = {
    "cc-by": ["[[this work is]] licensed under [[a]] [[the]] creative commons attribution {{6}} license", "licensed under [[a]] [[the]] cc by {{3}}"],
    "cc-by-nc": ["licensed under [[a]] [[the]] cc by nc {{3}}", "creative commons attribution non commercial", "creative commons attribution noncommercial"],
    "cc-by-sa": ["licensed under [[a]] [[the]] cc by sa {{3}}", "creative commons attribution share alike", "creative commons attribution sharealike"],
    "cc0": ["dedicated to the public domain", "licensed under [[a]] [[the]] cc0 {{3}}"],
    "gpl": ["licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation]] [[either]] version {{1}}",
            "you can redistribute it and or modify it under the terms of the gnu general public license"],
    "lgpl": ["under the terms of the gnu lesser general public license"],
    "mit": ["licensed under the mit license", "released under the mit license"],
    "apache-2.0": ["licensed under the apache license version 2 0 [[the license]]", "under the apache license version 2 0"],
    "bsd": ["licensed under the {{3}} bsd license"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0", "subject to the terms of the mozilla public license version 2 0"],
    "copyright": ["copyright [[c]] {{4}} all rights reserved"],
}

# Clauses that open a license, by the label of the license.
OPENINGS = {
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files {{4}} to deal in the software without restriction"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted"],
    "isc": ["permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"],
}

# Whole license texts and notices, by label.
_NO_CLAIM = """be liable for any claim damages or other liability whether in an action of contract tort or otherwise
    arising from out of or in connection with the software or the use or other dealings in the software"""
_AS_IS = """the software is provided as is without warranty of any kind express or implied
    including but not limited to the warranties of merchantability fitness for a particular purpose"""
_ISC_END = """the software is provided as is and {{12}} disclaims all warranties with regard to this software including all implied
    warranties of merchantability and fitness in no event shall {{12}} be liable for any special direct indirect or consequential damages
    or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
    action arising out of or in connection with the use or performance of this software"""
_BSD_TERMS = """provided that the following conditions are met {{1}} redistributions of source code must retain the above copyright notice
    this list of conditions and the following disclaimer {{1}} redistributions in binary form must reproduce the above copyright notice this
    list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"""
_BSD_NAMES = """{{1}} neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from
    this software without specific prior written permission"""
_BSD_END = """this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied
    warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{12}} be liable for any direct
    indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
    loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability
    or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such
    damage"""
TEXTS = {
    "mit": [f"""{OPENINGS["mit"][0]} including without limitation the rights to use copy modify merge publish distribute sublicense and or
        sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions
        the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or
        substantial portions of the software {_AS_IS} and noninfringement in no event shall {{{{12}}}} {_NO_CLAIM}"""],
    "bsl-1.0": [f"""permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the
        software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so
        all subject to the following the copyright notices in the software and this entire statement including the above license grant
        this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all
        derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code
        generated by a source language processor {_AS_IS} title and non infringement in no event shall the copyright holders or anyone
        distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of
        or in connection with the software or the use or other dealings in the software"""],
    "isc": [f"""{OPENINGS["isc"][0]} provided that the above copyright notice and this permission notice appear in all copies {_ISC_END}"""],
    "0bsd": [f"{OPENINGS['isc'][0]} {_ISC_END}"],
    "bsd-2-clause": [f"{OPENINGS['bsd'][0]} {_BSD_TERMS} {_BSD_END}"],
    "bsd-3-clause": [f"{OPENINGS['bsd'][0]} {_BSD_TERMS} {_BSD_NAMES} {_BSD_END}"],
    "zlib": ["""this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
        damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
        commercial applications and to alter it and redistribute it freely subject to the following restrictions {{1}} the origin of this
        software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product
        an acknowledgment in the product documentation would be appreciated but is not required {{1}} altered source versions must be
        plainly marked as such and must not be misrepresented as being the original software {{1}} this notice may not be removed or
        altered from any source distribution"""],
    "unlicense": [f"""this is free and unencumbered software released into the public domain anyone is free to copy modify publish use
        compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non
        commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and
        all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to
        the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all
        present and future rights to this software under copyright law {_AS_IS} and noninfringement in no event shall the authors
        {_NO_CLAIM}"""],
    "apache-2.0": ["""licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at {{8}} unless required by applicable law or agreed to in writing software
        distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
        implied see the license for the specific language governing permissions and limitations under the license"""],
    "gpl-or-later": ["""this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version {{1}} of the license or at your option any later version this
        program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of
        merchantability or fitness for a particular purpose see the gnu general public license for more details"""],
}

#: End of the label of a text of which only the opening clause stands; such a template scores nothing of its own.
OPENS = "-opening"

SPACES = bytes(i if 48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(SPACES).split()


@dataclass(frozen=True)
class Automaton:
    """States 0 to len(steps): ``steps[s]`` is the word that leads from s to s + 1, or None for any; ``skips[s]`` are states reached without a word."""

    label: str
    steps: tuple[bytes | None, ...]
    skips: tuple[tuple[int, ...], ...]
    mandatory: tuple[bool, ...]

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        steps, mandatory, jumps = [], [], []
        for part in re.findall(r"\[\[.*?\]\]|\{\{\d+\}\}|[^\[\]{}]+", template):
            if part.startswith("{{"):
                for _ in range(int(part[2:-2])):
                    jumps.append((len(steps), len(steps) + 1))
                    steps.append(None)
                    mandatory.append(False)
                continue
            words, optional = words_of(part.encode()), part.startswith("[[")
            if optional:
                jumps.append((len(steps), len(steps) + len(words)))
            steps += words
            mandatory += [not optional] * len(words)
        skips = tuple(tuple(b for a, b in jumps if a == s) for s in range(len(steps) + 1))
        return cls(label, tuple(steps), skips, tuple(mandatory))

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for b in self.skips[todo.pop()]:
                if b not in out:
                    out.add(b)
                    todo.append(b)
        return out

    def starts(self) -> set[bytes]:
        """Words with which an accepted text can begin."""
        return {self.steps[s] for s in self.closure({0}) if s < len(self.steps)}

    def match(self, words: list[bytes], at: int) -> tuple[bool, float]:
        """Whether the text from ``at`` is accepted, and the largest share of mandatory words that it reached."""
        need = sum(self.mandatory)
        done = [0]
        for m in self.mandatory:
            done.append(done[-1] + m)
        states, best = self.closure({0}), 0
        while states:
            best = max(best, *(done[s] for s in states))
            if len(self.steps) in states:
                return True, 1.0
            if at == len(words):
                break
            word, at = words[at], at + 1
            states = self.closure({s + 1 for s in states if s < len(self.steps) and self.steps[s] in (None, word)})
        return False, best / max(1, need)


def templates_of(statements: dict[str, list[str]], texts: dict[str, list[str]], openings: dict[str, list[str]]) -> dict[str, list[str]]:
    """Templates by the label that they give."""
    out = {label: list(found) for label, found in statements.items()}
    for label, found in texts.items():
        out.setdefault(label, []).extend(found)
    return out | {label + OPENS: found for label, found in openings.items()}


def compile_templates(templates: dict[str, list[str]]) -> dict[bytes, list[Automaton]]:
    """Automata by the words with which they can begin."""
    out: dict[bytes, list[Automaton]] = {}
    for label, texts in templates.items():
        for text in texts:
            automaton = Automaton.compile(label, text)
            for word in automaton.starts():
                if word is None:
                    raise ValueError(f"{label}: a template can't begin with a replaceable region")
                out.setdefault(word, []).append(automaton)
    return out


def places(words: list[bytes], phrase: tuple[bytes, ...]) -> list[int]:
    out, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if tuple(words[at:at + len(phrase)]) == phrase:
            out.append(at)


def scan(text: bytes, phrases: dict[tuple[bytes, ...], str], automata: dict[bytes, list[Automaton]]) -> dict:
    words = words_of(text)
    kinds = set(words)
    base: dict[str, list[int]] = {}
    for phrase, label in phrases.items():
        if kinds.issuperset(phrase) and (found := places(words, phrase)):
            base.setdefault(label, []).extend(found)
    labels, score = set(base), 0.5 if base else 0.0
    for word in kinds & automata.keys():
        for at in places(words, (word,)):
            whole, opened = set(), set()
            for automaton in automata[word]:
                accepted, share = automaton.match(words, at)
                if automaton.label.endswith(OPENS):
                    opened |= {automaton.label} if accepted else set()
                    continue
                score = max(score, share)
                whole |= {automaton.label} if accepted else set()
            labels |= whole or opened
    starts = [p for found in base.values() for p in found]
    return {"n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(labels)), "score": float(score)}


OUT = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
       "labels": pa.string(), "score": pa.float64()}


def scan_licenses(docs: DataFrame, carry: list[str] | None = None, templates: dict[str, list[str]] | None = None,
                  phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``carry`` (doc_id), the places and labels of base phrases, labels with those of accepted templates, and score.

    The score is the largest share of a template's mandatory words found in order, 1 when it is accepted, and at
    least one half where a base phrase stands.
    """
    carry = carry or ["doc_id"]
    cut = {tuple(words_of(p.encode())): label for p, label in phrases.items()}
    automata = compile_templates(templates_of(STATEMENTS, TEXTS, OPENINGS) if templates is None else templates)

    def run(batches):
        for batch in slices(batches, "text"):
            found = [scan(t, cut, automata) for t in rows_of(batch, "text")]
            yield pa.record_batch([*[column(batch, c) for c in carry], *[pa.array([f[c] for f in found], t) for c, t in OUT.items()]],
                                  names=[*carry, *OUT])
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    kinds += ", n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(*carry, "text").mapInArrow(run, kinds)
