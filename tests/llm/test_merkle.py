"""The Merkle manifest against a plain one, for odd rows, arities, groups and numbers of partitions."""

from __future__ import annotations

import random
import zlib

import pytest

from evidentia.llm import merkle

digest = merkle.digest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    doc, text, lang, source, n = row
    return digest("".join(map(field, (doc, source, lang, n, text))))


def tree_of(nodes, arity):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [digest("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
        levels.append(nodes)
    return levels


def path_of(levels, i, arity):
    out = []
    for nodes in levels[:-1]:
        start = i // arity * arity
        out.append(("".join(nodes[start:i]), "".join(nodes[i + 1 : start + arity])))
        i //= arity
    return out


def plain(rows, arity=2):
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    order = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in groups}
    trees = {g: tree_of([leaf_of(r) for r in order[g]], arity) for g in groups}
    top = tree_of([trees[g][-1][0] for g in groups], arity)
    out = []
    for k, g in enumerate(groups):
        for i, r in enumerate(order[g]):
            steps = path_of(trees[g], i, arity) + path_of(top, k, arity)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            node = leaf_of((*r[:4], r[4] + 1) if bad else r)
            for left, right in steps:
                node = digest(left + node + right)
            root = top[-1][0]
            out.append((r[0], leaf_of(r), trees[g][-1][0], root, digest("".join(a + b for a, b in steps)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "arity", "langs"), [(1, 2, 1), (8, 2, 1), (40, 2, 9), (90, 3, 4), (150, 2, 1), (30, 2, 40)])
def test_manifest_is_the_plain_one(spark, n, arity, langs):
    draw = random.Random(n)
    rows = [(draw.choice([i, i, None, 3]), draw.choice(["x" * i, None, "", "é\n", "x" * 90_000]), draw.choice([None, "", *[f"l{k}" for k in range(langs)]]), draw.choice([None, "s"]), draw.choice([None, i])) for i in range(n)]
    rows += rows[:3] * 2  # repeated rows
    docs = spark.createDataFrame([(*r, 1, "mine") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, at int, leaf string")
    got = sorted([tuple(r) for r in merkle.verified_manifest(docs, arity=arity).collect()], key=str)
    assert got == plain(rows, arity)


def test_merges_in_any_grouping_give_the_same(spark):
    draw, leaves, arity = random.Random(5), {merkle.TOP: 2, 0: 23, 1: 40}, 2
    base = {(t, 0, i): digest(f"{t}.{i}") for t in (0, 1) for i in range(leaves[t])}
    whole = dict(base)
    merkle.merged(whole, leaves, arity)
    assert len(whole) == 1
    for _ in range(5):
        parts = [{} for _ in range(7)]
        for k, v in base.items():
            draw.choice(parts)[k] = v
        while len(parts) > 1:
            draw.shuffle(parts)
            both = parts.pop() | parts.pop()
            merkle.merged(both, leaves, arity)
            parts.append(both)
        assert parts[0] == whole


def test_many_rounds_and_no_rows(spark):
    rows = [(i, f"t{i}", "en" if i % 3 else "de", "s", i) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    proofs = merkle.manifest(merkle.document_leaves(docs), part_rows=4, fan_in=2)  # 25 partitions, five rounds
    assert {(r["who"], r["root"]) for r in proofs.collect()} == {(r[0], r[3]) for r in plain(rows)}
    assert merkle.verified_manifest(docs.limit(0)).collect() == []
