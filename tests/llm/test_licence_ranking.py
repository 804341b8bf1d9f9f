"""The licence scan against a plain one that compares every run of words with every template."""

from __future__ import annotations

import random

import zstandard

from evidentia.llm import licences


def distance(a, b):
    """Words missing or added between two lists."""
    row = [*range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b):
            row.append(before[j] if x == y else 1 + min(before[j + 1], row[j]))
    return row[-1]


def compressed(words, given=None):
    extra = {"dict_data": zstandard.ZstdCompressionDict(" ".join(given).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if given else {}
    return len(zstandard.ZstdCompressor(level=6, write_content_size=False, **extra).compress(" ".join(words).encode()))


def test_confirmed_statements_are_real_and_none_is_missed():
    draw = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)]
    for _ in range(60):
        templates = {f"t{k}": (" ".join(draw.choice(vocabulary) for _ in range(draw.randint(6, 14))),) for k in range(3)}
        templates["near"] = (templates["t0"][0].replace("w1", "w2"),)
        words = []
        for _ in range(draw.randint(1, 4)):
            words += [draw.choice(vocabulary) for _ in range(draw.randint(0, 6))]
            piece = draw.choice([*templates.values()])[0].split()
            if draw.random() < 0.5:
                piece[draw.randrange(len(piece))] = draw.choice(vocabulary)
            words += piece
        scanner = licences.Scanner(templates, 0.25)
        got = scanner.scan(" ".join(words), 0.0)
        ends, at = {}, 0
        for i, w in enumerate(words):
            ends[at], ends[at + len(w)] = i, i + 1
            at += len(w) + 1
        spans = [(ends[s], ends[e], name, changed) for s, e, name, _, changed, *_ in got]
        for first, last, name, changed in spans:
            assert changed == distance(templates[name][0].split(), words[first:last]) <= int(0.25 * len(templates[name][0].split()))
        assert all(a[1] <= b[0] for a, b in zip(sorted(spans), sorted(spans)[1:], strict=False))
        # every run of words that some template allows meets something that was confirmed
        for name, (wording,) in templates.items():
            known = wording.split()
            most = int(0.25 * len(known))
            for first in range(len(words)):
                for last in range(first + 1, min(len(words), first + len(known) + most) + 1):
                    if distance(known, words[first:last]) <= most:
                        assert any(first < y and x < last for x, y, *_ in spans)


def test_templates_are_ranked_by_what_they_save():
    mit, bsd = licences.TEMPLATES["MIT"][0], licences.TEMPLATES["BSD"][0]
    scanner = licences.Scanner({"MIT": (mit,), "BSD": (bsd,)}, 0.25)
    words = licences.words_of(f"before {mit} and then {bsd}")
    for first, last, templates in scanner.blocks(words):
        block = words[first:last]
        want = sorted((compressed(block) - compressed(block, scanner.templates[i][1]) for i in templates), reverse=True)
        assert [x for x, _ in scanner.ranked(block, templates)] == want


def test_the_nearer_of_two_alike_templates_wins_by_compression(docs_of):
    gpl = "This program is free software; you may pass it on under the terms of the common public licence, version {} of that licence, and of no other one at all."
    templates = {"two": (gpl.format("two thousand"),), "three": (gpl.format("three hundred"),)}
    text = "x " * 50 + gpl.format("three hundred") + " y" * 50
    (row,) = licences.scan_licences(docs_of([(1, text)]), templates=templates).collect()
    assert (row.licence, row["rank"], row.changed_words) == ("three", 1, 0) and row.rank_saved > 50
