"""License scans by conditional compression: templates as zstandard raw dictionaries, confirmed by wording differences."""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import map_batches, per_worker, text_runs

# Wordings of public licences and of notices that name them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": (
        "Released under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

WORD = re.compile(r"\w++(?:[.+-]++\w++)*+")


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def extended(wording: list[str], words: list[str], most: int) -> tuple[int, int]:
    """(changes, words taken) of the beginning of words that differs least from the wording; most + 1 if all differ more."""
    same = 0
    while same < len(wording) and same < len(words) and wording[same] == words[same]:
        same += 1
    wording, words = wording[same:], words[same:]
    row = [*range(len(words) + 1)]
    for i, word in enumerate(wording, 1):
        before, row = row, [i]
        for j, other in enumerate(words):
            row.append(before[j] if word == other else 1 + min(before[j + 1], row[j]))
        if min(row) > most:
            return most + 1, 0
    changes = min(row)
    return changes, same + row.index(changes)


class Scanner:
    """Finds every wording that differs from a template by few words, and tells what its dictionary saves there.

    A template that may differ by k words is cut into k + 1 pieces, one of which then stands unchanged in every
    statement of it; statements are looked for around each such piece, so it does not matter what surrounds them.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]], most_changes: float) -> None:
        self.templates = [(name, words) for name, texts in templates.items() for text in texts if (words := words_of(text))]
        self.most = [int(most_changes * len(words)) for _, words in self.templates]
        level = 6
        self.plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.given = [
            zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(_spelled(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for _, words in self.templates
        ]
        self.sizes = [len(self.plain.compress(_spelled(words).encode())) for _, words in self.templates]
        #: longest word of a piece -> (its place in the piece, piece, template, the piece's place in the template)
        self.pieces: dict[str, list[tuple[int, list[str], int, int]]] = defaultdict(list)
        for i, (_, words) in enumerate(self.templates):
            n = min(self.most[i] + 1, len(words))
            for x, y in ((len(words) * k // n, len(words) * (k + 1) // n) for k in range(n)):
                longest = max(words[x:y], key=len)
                self.pieces[longest].append((words.index(longest, x) - x, words[x:y], i, x))

    def saved(self, words: list[str], template: int) -> int:
        """Compressed bytes that the template's dictionary saves."""
        data = _spelled(words).encode()
        return len(self.plain.compress(data)) - len(self.given[template].compress(data))

    def saving(self, words: list[str], template: int) -> float:
        """Share of the compressed words that the template's dictionary saves."""
        return self.saved(words, template) / len(self.plain.compress(_spelled(words).encode()))

    def blocks(self, words: list[str]) -> list[tuple[int, int, set[int]]]:
        """(first, last, templates): the stretches where a statement of a template that shares a piece with the text would
        stand, those that overlap as one."""
        regions = []
        for at, word in enumerate(words):
            for place, piece, i, x in self.pieces.get(word, ()):
                first = at - place
                if first >= 0 and words[first : first + len(piece)] == piece:
                    start = first - x - self.most[i]
                    regions.append((max(0, start), min(len(words), start + len(self.templates[i][1]) + 2 * self.most[i]), i))
        out: list[tuple[int, int, set[int]]] = []
        for first, last, i in sorted(regions):
            if out and first < out[-1][1]:
                out[-1] = (out[-1][0], max(last, out[-1][1]), out[-1][2] | {i})
            else:
                out.append((first, last, {i}))
        return out

    def ranked(self, words: list[str], templates: set[int]) -> list[tuple[int, int]]:
        """(bytes that the template saves on the block, template), most first; of equal savings the smaller template's."""
        return sorted(((self.saved(words, i), i) for i in templates), key=lambda x: (-x[0], self.sizes[x[1]], x[1]))

    def matches(self, words: list[str]) -> set[tuple[float, int, int, int, int, int]]:
        """(changed share, -words of the template, template, first, last, changes), overlapping ones too."""
        found = set()
        for at, word in enumerate(words):
            for place, piece, i, x in self.pieces.get(word, ()):
                first = at - place
                if first < 0 or words[first : first + len(piece)] != piece:
                    continue
                wording, most = self.templates[i][1], self.most[i]
                left, taken = extended(wording[:x][::-1], words[max(0, first - x - most) : first][::-1], most)
                last = first + len(piece)
                rest = wording[x + len(piece) :]
                right, more = extended(rest, words[last : last + len(rest) + most], most - left) if left <= most else (0, 0)
                if left + right <= most:
                    found.add(((left + right) / len(wording), -len(wording), i, first - taken, last + more, left + right))
        return found

    def scan(self, text: str, least_saving: float) -> list[tuple[int, int, str, float, int, float, int, int]]:
        """(start, end, licence, saving, changed words, agreement, rank, bytes saved) for each licence statement.

        In each block the templates are ranked by compression. In that order their statements are confirmed by their
        exact word differences: the closest ones first, each where nothing confirmed before stands.
        """
        words = words_of(text)
        if self.pieces.keys().isdisjoint(words):
            return []
        chosen: list[tuple] = []
        for start, end, templates in self.blocks(words):
            block = words[start:end]
            found = sorted(self.matches(block))
            firsts, lasts = [], []  # of what is confirmed, in order
            for rank, (saved, template) in enumerate(self.ranked(block, templates), 1):
                wording = self.templates[template]
                for _, _, i, first, last, changed in found:
                    k = bisect(firsts, first)
                    if i != template or (k and lasts[k - 1] > first) or (k < len(firsts) and firsts[k] < last):
                        continue
                    saving = self.saving(block[first:last], i)
                    if saving >= least_saving:
                        firsts.insert(k, first)
                        lasts.insert(k, last)
                        common = (len(wording[1]) + last - first - changed) // 2
                        chosen.append((start + first, start + last, wording[0], saving, changed, common / len(wording[1]), rank, saved))
        if not chosen:
            return []
        places = [m.span() for m in WORD.finditer(text)]
        return [(places[x][0], places[y - 1][1], *rest) for x, y, *rest in sorted(chosen)]


def _spelled(words: list[str]) -> str:
    return " ".join(words)


def scan_licences(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    least_saving: float = 0.3,
    most_changes: float = 0.25,
) -> DataFrame:
    """(id, start, end, licence, saving, changed_words, agreement, rank, rank_saved, wording): one row for each
    licence statement found.

    A statement is a run of words anywhere in the text, over any number of lines, that differs from a template by at
    most most_changes of the template's words (missing or added; another word counts as both) and of whose compressed
    size the template as zstandard raw dictionary saves at least least_saving. A block, the stretch where statements of the
    templates that share a piece with the text would stand, is compressed with each of these templates as dictionary;
    they are ranked by the bytes saved (rank, rank_saved), and the exact word difference confirms in that order. Of statements that overlap, the one of the higher rank stands, of one
    template the closer one; all others are rows of their own. start and end
    are code points. One narrow stage; only statements leave it. Null and empty texts have none, ids may be null or
    repeated, texts may be of any length. Other columns are not read.
    """
    known = templates or TEMPLATES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_worker(("licences", tuple(known.items()), most_changes), lambda: Scanner(known, most_changes))
        for batch in batches:
            rows, cols = [], [[] for _ in range(9)]
            for row, text in enumerate(t for _, _, texts in text_runs(batch.column(1)) for t in texts):
                for found in scanner.scan(text, least_saving):
                    rows.append(row)
                    for col, value in zip(cols, (*found, text[found[0] : found[1]]), strict=True):
                        col.append(value)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, "start", "end", "licence", "saving", "changed_words", "agreement", "rank", "rank_saved", "wording"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), task, f"`{id_col}` {kind}, start long, end long, licence string, saving double, changed_words long, agreement double, rank long, rank_saved long, wording string")
