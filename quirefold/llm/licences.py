"""Licence scans: pieces of texts against licence templates by the Dice coefficient of their word bigrams.

Pieces are the lines of a text, its paragraphs (runs of lines that are not blank) and the whole text. Two sets of bigrams of
sizes a and b have a Dice coefficient of at most 2 min(a, b) / (a + b), so for a threshold t only templates of sizes from
a t / (2 - t) to a (2 - t) / t are candidates for a piece of size a; and only those that share a bigram with it are compared.

With ``runs``, runs of consecutive sentences and lines are pieces too, whatever parts them: a template of which a text holds
enough bigrams for a run of it to reach the threshold (most texts: none) is compared with all runs that its size allows.
Runs are told apart by their Dice coefficient, and only told where no better match of the same words is.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import pieces, share, shared, spread
from quirefold.session import measured_bytes

LEAST_DICE = 0.8
TEMPLATE_BYTES = 16 << 20
SENTENCE = re.compile(r"(?<=[.!?;:])\s+|\n")
TEXTS = Path(__file__).parent / "licence_texts"
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

# Notices by which works state their licence, and short licences in full.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
     "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
     "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
     "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS "
     "IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
     "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("All-Rights-Reserved", "All rights reserved."),
]


_FREE = ("This {0} is free software{3} you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free "
         "Software Foundation{4} either version {2} of the License, or (at your option) any later version.")
# Notices of the listed licences that the check SQL does not name.
NOTICES = [
    ("GPL-2.0", _FREE.format("program", "General Public License", "2", ";", ";")),
    ("LGPL-2.1", _FREE.format("library", "Lesser General Public License", "2.1", ";", ";")),
    ("LGPL-3.0", _FREE.format("library", "Lesser General Public License", "3", ":", ",")),
    ("AGPL-3.0", _FREE.format("program", "Affero General Public License", "3", ":", ",")),
]


_NETWORK = (
    "13. Remote Network Interaction; Use with the GNU General Public License. Notwithstanding any other provision of this License, if you "
    "modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if "
    "your version supports such interaction) an opportunity to receive the Corresponding Source of your version by providing access to the "
    "Corresponding Source from a network server at no charge, through some standard or customary means of facilitating copying of software. "
)


def all_templates() -> list[tuple[str, str]]:
    """The fixed notices and the full texts of ``licence_texts``, each by its file's name.

    That of AGPL-3.0 is made from GPL-3.0 by its name and section 13, so that it is told from it; it is not the exact text.
    """
    texts = {file.stem: file.read_text("utf-8") for file in sorted(TEXTS.glob("*.txt"))}
    head, _, tail = texts["GPL-3.0"].partition("  13. Use with the GNU Affero General Public License.")
    tail = tail[tail.index("  14. "):]
    head, tail = (re.sub(r"(GNU) (General)", r"\1 Affero \2", x, flags=re.IGNORECASE) for x in (head, tail))
    return [*TEMPLATES, *NOTICES, *texts.items(), ("AGPL-3.0", head + _NETWORK + tail)]


def words_of(text: str) -> list[str]:
    """Normalised words: lower case, letters and digits, version numbers whole; marks and white space part them."""
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def dice(a: set, b: set) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


@dataclass
class Library:
    """Templates ordered by their number of bigrams, with the templates that hold each bigram."""

    names: list[str] = field(default_factory=list)
    sets: list[set] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    holders: dict = field(default_factory=dict)

    @staticmethod
    def of(templates: list[tuple[str, str]]) -> Library:
        made = sorted(((bigrams(words_of(text)), name) for name, text in templates), key=lambda x: (len(x[0]), x[1]))
        made = [(grams, name) for grams, name in made if grams]
        library = Library([n for _, n in made], [g for g, _ in made], [len(g) for g, _ in made])
        for k, (grams, _) in enumerate(made):
            for gram in grams:
                library.holders.setdefault(gram, []).append(k)
        return library

    def match(self, words: list[str], least: float) -> dict[str, float]:
        """Licences whose best template reaches ``least``, with that coefficient."""
        if len(words) < 2 or not self.sizes or self.sizes[0] > (len(words) - 1) * (2 - least) / least:
            return {}
        grams = bigrams(words)
        low = bisect_left(self.sizes, len(grams) * least / (2 - least) - 1e-9)
        high = bisect_right(self.sizes, len(grams) * (2 - least) / least + 1e-9)
        if low >= high:
            return {}
        shared: dict[int, int] = {}
        for gram in grams & self.holders.keys():
            for k in self.holders[gram]:
                if low <= k < high:
                    shared[k] = shared.get(k, 0) + 1
        found: dict[str, float] = {}
        for k, common in shared.items():
            value = 2 * common / (len(grams) + self.sizes[k])
            if value >= least:
                found[self.names[k]] = max(value, found.get(self.names[k], 0.0))
        return found


def units(lines: list[list[str]]) -> Iterator[tuple[int, int, list[str]]]:
    """First and last line (from 1) and the words of every line, every paragraph of several lines, and the whole text.

    A line without words of its own (blank, or marks only) ends a paragraph.
    """
    begin = None
    for k, words in enumerate([*lines, []], 1):
        if words:
            yield k, k, words
            begin = begin or k
        elif begin:
            if k - begin > 1 and (begin > 1 or k <= len(lines)):
                yield begin, k - 1, [w for line in lines[begin - 1:k - 1] for w in line]
            begin = None
    if len(lines) > 1:
        yield 1, len(lines), [w for line in lines for w in line]


def runs_of(grams: list, ends: np.ndarray, template: set, least: float) -> list[tuple[float, int, int]]:
    """Runs of atoms ``(dice, first, last)`` that reach ``least``, the best first, no two of which meet.

    ``grams`` are the text's bigrams and ``ends`` says for each the atom of its first and of its last word. For every last atom
    all first ones are compared: the numbers of different bigrams of the template and of others are kept by first atom.
    """
    size = len(template)
    most = size * (2 / least - 2) + 1e-9  # other bigrams that a run may hold: more can not be made up for
    n = int(ends[-1, 1]) + 1
    common, other = np.zeros(n, np.int32), np.zeros(n, np.int32)
    seen: dict = {}
    found = []
    low = 0
    for k, gram in enumerate(grams):
        first, last = ends[k]
        begin = max(low, seen.get(gram, -1) + 1)  # runs from there on hold the bigram for the first time
        hit = gram in template
        if begin <= first:
            (common if hit else other)[begin:first + 1] += 1
            if not hit:
                while low < last and other[low] > most:
                    low += 1
        seen[gram] = first
        if k + 1 == len(grams) or ends[k + 1, 1] > last:
            some = common[low:last + 1]
            if len(some) and some.max() * (2 - least) + 1e-9 >= size * least:
                values = 2 * some / (some + other[low:last + 1] + size)
                best = len(values) - 1 - int(values[::-1].argmax())  # the shortest of the best
                if values[best] >= least:
                    found.append((float(values[best]), low + best, int(last)))
    found.sort(key=lambda x: (-x[0], x[2] - x[1], x[1]))
    taken, kept = bytearray(n), []
    for value, first, last in found:
        if taken.find(1, first, last + 1) < 0:
            taken[first:last + 1] = b"\1" * (last + 1 - first)
            kept.append((value, first, last))
    return kept


def matching_runs(text: str, words: list[str], library: Library, least: float, known: list[tuple[str, float, int, int]]) -> list[tuple[str, float, int, int]]:
    """Matches of runs of sentences and lines; of those that meet the best stays. A ``known`` match goes before others of its licence."""
    grams = list(zip(words, words[1:]))
    counts: dict[int, int] = {}
    for gram in library.holders.keys() & set(grams):
        for k in library.holders[gram]:
            counts[k] = counts.get(k, 0) + 1
    likely = [k for k, common in counts.items() if common * (2 - least) + 1e-9 >= library.sizes[k] * least]
    if not likely:
        return []
    atoms, lines = [], []
    line, at, atom = 1, 0, 0
    for cut in [*SENTENCE.finditer(text), None]:
        n = len(words_of(text[at:cut.start() if cut else len(text)]))
        if n:
            atoms += [atom] * n
            lines.append(line)
            atom += 1
        if cut:
            line, at = line + cut.group().count("\n"), cut.end()
    ends = np.stack((atoms[:-1], atoms[1:]), 1)
    found = [(value, first, last, library.names[k]) for k in likely for value, first, last in runs_of(grams, ends, library.sets[k], least)]
    places: dict[tuple[int, int], float] = {}
    told = set()
    top = np.zeros(atom)  # the best value that each atom takes part in
    starts = np.array(lines)
    own: dict[str, list[tuple[int, int]]] = {}
    for name, value, first, last in known:
        a, b = np.searchsorted(starts, [first, last + 1])
        top[a:b] = np.maximum(top[a:b], value)
        own.setdefault(name, []).append((a, b))
    for value, first, last, name in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x)):
        if any(a <= last and first < b for a, b in own.get(name, ())):
            continue
        if places.get((first, last)) == value or not top[first:last + 1].max() >= value:
            places[first, last] = value
            top[first:last + 1] = np.maximum(top[first:last + 1], value)
            told.add((name, value, lines[first], lines[last]))
    return list(told)


def scan_text(text: str | None, library: Library, least: float = LEAST_DICE, runs: bool = False) -> list[tuple[str, float, int, int]]:
    """Matches ``(licence, dice, first line, last line)``: of each piece its best licence, several if they are equally good."""
    if not text or not library.sizes:
        return []
    longest = library.sizes[-1] * (2 - least) / least
    found = []
    lines = [words_of(line) for line in text.split("\n")]
    for first, last, words in units(lines):
        # d different words have d - 1 different bigrams at least
        if len(words) - 1 > longest and len(set(words)) - 1 > longest:
            continue
        matches = library.match(words, least)
        best = max(matches.values(), default=0)
        found += [(name, value, first, last) for name, value in matches.items() if value == best]
    if runs:
        found += matching_runs(text, [w for line in lines for w in line], library, least, found)
    return sorted(found, key=lambda x: (x[2], x[3], x[0]))


def scan(
    docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_DICE,
    runs: bool = False,
) -> DataFrame:
    """``(doc_id, matches)`` of every row; matches are structs of licence, dice, first and last line. Null and empty texts have none.

    Equally good licences of a piece are all listed; repeated rows are repeated, further columns are not read, an empty table gives no
    rows, and very long texts are scanned whole, without the pieces that are longer than any template allows. Templates may be a table ``(licence, text)``; it is measured first and must fit ``TEMPLATE_BYTES``.
    """
    if isinstance(templates, DataFrame):
        if measured_bytes(templates) > TEMPLATE_BYTES:
            raise ValueError("licence templates are sent to every task and have to be small")
        templates = [(r["licence"], r["text"]) for r in templates.filter("licence is not null and text is not null").collect()]
    library = share(docs.sparkSession, Library.of(templates))
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    kind = pa.list_(pa.struct([("licence", pa.string()), ("dice", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared(library)
        for batch in pieces(batches):
            found = [[dict(zip(("licence", "dice", "first", "last"), m)) for m in scan_text(x.as_py(), known, least, runs)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "matches"])

    doc_id = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {doc_id}, matches array<struct<licence:string,dice:double,first:int,last:int>>")
