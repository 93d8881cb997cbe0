"""License scans by template-markup matching.

A template is license wording with markup: `<<beginOptional>>..<<endOptional>>` may be left
out, `<<var;min;max>>` stands for min to max arbitrary words.  Templates are compiled into
automata over words; a text is accepted where all mandatory wording follows exactly, unless
the word before it denies it ("not licensed under ...").
Plain phrases (the base rules) are found beside that and always keep their labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import LETTER_SEP, read, slices, spans

#: Fixed by contract.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to
the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of
or in connection with the software or the use or other dealings in the software"""
_OPTIONAL = "<<beginOptional>>%s<<endOptional>>"
_UNDER = f"licensed under {_OPTIONAL % 'the'} {_OPTIONAL % 'terms of the'}"
#: Variants of the creative commons family and of the GNU one, by label.
_CC = {"cc-by": ("by", "attribution"), "cc-by-sa": ("by sa", "attribution sharealike"), "cc-by-nc": ("by nc", "attribution noncommercial"), "cc-by-nd": ("by nd", "attribution noderivatives"), "cc-by-nc-sa": ("by nc sa", "attribution noncommercial sharealike"), "cc-by-nc-nd": ("by nc nd", "attribution noncommercial noderivatives")}
_GNU = {"gpl-notice": "", "lgpl-notice": "lesser", "agpl-notice": "affero"}
#: Public license wording; the markup is ours.
TEMPLATES = (
    ("mit-notice", f"{_UNDER} mit license"),
    ("mit-notice", "released under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> mit license"),
    ("mit-notice", "this <<var;1;4>> is <<beginOptional>>available<<endOptional>> under the mit license"),
    ("apache-2.0", f"{_UNDER} apache license <<beginOptional>>version<<endOptional>> 2 0 <<beginOptional>>the license<<endOptional>>"),
    *((label, f"{_UNDER} gnu {kind} general public license <<beginOptional>>as published by the free software foundation either<<endOptional>> version <<var;1;1>> <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>") for label, kind in _GNU.items()),
    *((label, f"licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc {short} <<var;1;1>> 0 <<beginOptional>>international license<<endOptional>>") for label, (short, _) in _CC.items()),
    *((label, f"licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> creative commons {full} <<var;1;1>> 0 <<beginOptional>>international<<endOptional>> <<beginOptional>>license<<endOptional>>") for label, (_, full) in _CC.items()),
    ("mit-text", f"""<<beginOptional>>mit license<<endOptional>> <<beginOptional>>copyright <<var;0;24>><<endOptional>> permission is hereby granted free of charge to any person obtaining a copy
of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights
to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>>
shall be included in all copies or substantial portions of the software {_WARRANTY}"""),
    ("isc-text", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that
the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var;1;6>> disclaims all warranties with regard
to this software including all implied warranties of merchantability and fitness in no event shall <<var;1;6>> be liable for any special direct indirect or
consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
arising out of or in connection with the use or performance of this software"""),
    ("bsd-text", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution <<beginOptional>><<beginOptional>>3<<endOptional>> neither the name of <<var;1;12>> nor the names of its contributors
may be used to endorse or promote products derived from this software without specific prior written permission<<endOptional>> this software is provided by <<var;1;10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and
fitness for a particular purpose are disclaimed in no event shall <<var;1;12>> be liable for any direct indirect incidental special exemplary or consequential damages
including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of
liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the
possibility of such damage"""),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or
authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law
""" + _WARRANTY.replace("authors or copyright holders", "authors") + " <<beginOptional>>for more information please refer to <<var;1;4>><<endOptional>>"),
    ("zlib-text", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of
this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to
the following restrictions <<beginOptional>>1<<endOptional>> the origin of this software must not be misrepresented you must not claim that you wrote the original software
if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required <<beginOptional>>2<<endOptional>> altered
source versions must be plainly marked as such and must not be misrepresented as being the original software <<beginOptional>>3<<endOptional>> this notice may not be
removed or altered from any source distribution"""),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<var;1;8>>"),
)
DENIALS = frozenset((b"not", b"never", b"no", b"nor", b"neither", b"cannot", b"without"))
#: "not only licensed under" denies nothing; "isn't" is two words, or one where its mark is typographic.
_AFFIRMED = frozenset((b"only", b"just", b"merely", b"least"))
_NT = "n\u2019t".encode()
LOOK_BACK = 6
_BREAK = re.compile(rb"[.!?;:]|\n\s*\n")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"<<(beginOptional|endOptional|var;\d+;\d+)>>")

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


class Automaton:
    """Words in sequence with skips; states are positions, `None` in `words` takes any word."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []
        self.skips: list[tuple[int, int]] = []  # state, state reached without a word
        opened: list[int] = []
        mandatory: list[bytes] = []
        for k, part in enumerate(_MARK.split(template)):
            if k % 2 == 0:
                got = _WORD.findall(part.lower().encode())
                self.words += got
                mandatory += [] if opened else got
            elif part == "beginOptional":
                opened.append(len(self.words))
            elif part == "endOptional":
                self.skips.append((opened.pop(), len(self.words)))
            else:
                least, most = map(int, part.split(";")[1:])
                at = len(self.words)
                self.words += [None] * most
                self.skips += [(at + i, at + most) for i in range(least, most)]
        if opened:
            raise ValueError(f"an optional region is not closed: {template[:60]!r}")
        self.key = max(mandatory, key=len)
        self.first = {self.words[s] for s in self._closed({0}) if s < len(self.words)}

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            s = todo.pop()
            for a, b in self.skips:
                if a == s and b not in states:
                    states.add(b)
                    todo.append(b)
        return states

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest match that begins at word `at`."""
        states, found = self._closed({0}), None
        for i in range(at, len(words) + 1):
            if len(self.words) in states:
                found = i
            if i == len(words):
                break
            word = words[i]
            states = self._closed({s + 1 for s in states if s < len(self.words) and self.words[s] in (None, word)})
            if not states:
                break
        return found

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """Begin and end of all accepted places; a place may be denied all the same."""
        if self.key not in words:
            return
        for i, w in enumerate(words):
            if (w in self.first or None in self.first) and (end := self.match(words, i)) is not None:
                yield i, end


def denied(body: bytes, words: list[re.Match], at: int) -> bool:
    """Whether one of the LOOK_BACK words before word `at`, in its sentence, denies what follows."""
    for i in range(at - 1, max(-1, at - 1 - LOOK_BACK), -1):
        if _BREAK.search(body, words[i].end(), words[i + 1].start()):
            return False
        word, after = words[i][0], words[i + 1][0]
        before = words[i - 1] if i else None
        short = word == b"t" and before is not None and before[0].endswith(b"n") and words[i].start() == before.end() + 1
        if (word in DENIALS and after not in _AFFIRMED) or word.endswith(_NT) or short:
            return True
    return False


def compiled(templates=TEMPLATES) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(text)) for label, text in templates]


def scan(body: bytes, automata, phrases) -> tuple[list[int], set[str], set[str]]:
    """Starts of phrases, their labels, and labels of accepted templates, in lower-cased text."""
    words = _WORD.findall(body)
    starts, base, more = [], set(), set()
    for phrase, label in phrases:
        n = len(phrase)
        i = -1
        while True:
            try:
                i = words.index(phrase[-1], i + 1)
            except ValueError:
                break
            if i >= n - 1 and tuple(words[i - n + 1 : i + 1]) == phrase:
                starts.append(i - n + 1)
                base.add(label)
    places = None
    for label, automaton in automata:
        if label in more:
            continue
        for i, _ in automaton.find(words):
            places = places or list(_WORD.finditer(body))
            if not denied(body, places, i):
                more.add(label)
                break
    return starts, base, more


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `docs`: words, phrase places, labels and a score.

    score is 1 where a template's whole mandatory wording was accepted, 0.5 where only a phrase
    was found, else 0.  Null texts count as empty (0 words, null places, "" labels); null keys
    stay null; repeated rows are scanned each; texts are read whole, however long; empty tables
    give no rows; other columns, whatever their names, are ignored.
    """
    cut = [(tuple(_WORD.findall(p.lower().encode())), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        likely = re.compile(b"|".join(re.escape(w) for w in {a.key for _, a in automata} | {p[-1] for p, _ in cut}))
        for rows, data, offsets in slices(batches, 1):
            counts = np.diff(spans(data, offsets, LETTER_SEP)[2])
            raw = data.tobytes().lower()
            out = []
            for i, doc in enumerate(rows.column(0).to_pylist()):
                body = raw[offsets[i] : offsets[i + 1]]
                starts, base, more = scan(body, automata, cut) if likely.search(body) else ([], set(), set())
                out.append((doc, int(counts[i]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if more else 0.5 if base else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ARROW.types)], schema=_ARROW)

    return docs.selectExpr(f"cast({key} as bigint) doc_id", f"cast({text} as binary) body").mapInArrow(run, SCHEMA)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"op10_license_scan": op10_license_scan}
