"""The ten operators against brute force, on small inputs with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidentia.llm import components, fingerprints, licences, line_dedup, lm_scores, near_dedup, neighbours, packing, quality, registry, shingles, source_mix, token_counts
from evidentia.llm.common import runs

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, "  \t"), (None, "null id text"), (4, "Ünïcode 漢字 <|endoftext|> don't\x1c"), (5, "word " * 30_000), (6, "twice"), (6, "twice"), (7, "no newline at all" * 2)]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


# --- 10: token counts


def test_counts_are_the_librarys(spark, docs_of):
    df = docs_of(ODD)
    tokenizer = Tokenizer.from_file(BYTES)
    want = Counter((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in ODD)
    got = token_counts.count_tokens(df, BYTES, piece_chars=500).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert token_counts.count_tokens(df.limit(0), BYTES).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é\n\t.,'漢1  <>|")), max_size=80), st.integers(1, 20))
def test_cutting_changes_no_count(text, longest):
    tokenizer = Tokenizer.from_file(BYTES) if not hasattr(test_cutting_changes_no_count, "t") else test_cutting_changes_no_count.t
    test_cutting_changes_no_count.t = tokenizer
    parts = [*token_counts.pieces_of(text, longest)]
    assert "".join(parts) == text
    assert sum(len(x) for x in tokenizer.encode_batch_fast(parts, add_special_tokens=False)) == len(tokenizer.encode(text, add_special_tokens=False))


def test_sentencepiece_files_count_too(docs_of):
    got = token_counts.count_tokens(docs_of([(1, "hello world"), (2, None)]), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.n_tokens > 0 for r in got} == {1: True, 2: False}


# --- 8: packing


def check_packed(rows, docs, capacity):
    tokenizer = Tokenizer.from_file(WORDS)
    want = Counter()
    for key, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[key, piece, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_packing_loses_nothing(docs_of):
    rows = packing.pack(docs_of(ODD), WORDS).collect()
    found = check_packed(rows, ODD, 2048)
    assert len(found) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(docs_of([]), WORDS).count() == 0


def test_packing_the_small_table(documents):
    rows = packing.pack(documents, WORDS, block_pieces=64).collect()
    found = check_packed(rows, [*texts_of(documents).items()], 2048)
    assert len(found) <= 1.03 * sum(r.length for r in rows) / 2048 + 4


def fewest(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i]:
                rooms[k] -= sizes[i]
                go(i + 1, rooms)
                rooms[k] += sizes[i]
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_bin_completion_finds_the_fewest():
    draw = random.Random(3)
    for _ in range(120):
        sizes = [draw.randint(5, 60) for _ in range(draw.randint(1, 8))]
        bins = packing.pack_block(sizes, 100)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
        assert len(bins) == fewest(sorted(sizes, reverse=True), 100)


# --- 6: lines


def deduped(docs):
    lines = {i: (t or "").split("\n") for i, t in docs}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, ls in lines.items():
        for x in ls:
            if len(key(x)) >= 20:
                held[key(x)].add(i)
    return {i: [x for x in ls if not (len(held.get(key(x), ())) >= 3 and i != max(held[key(x)]))] for i, ls in lines.items()}


def test_shared_lines_go(docs_of):
    long = "a line that is long enough é"
    docs = [(1, f"{long}\nown\n{long}"), (2, f"  {long.replace('a line', 'A LINE')}\r\nx"), (3, f"y\n{long}"), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"), (9, "two docs share this line only"), (10, "two docs share this line only"), (11, "É" * 20), (12, "é" * 20), (13, "é" * 20)]
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped, r.size) for r in line_dedup.dedup_lines(docs_of(docs)).collect()}
    want = {i: ("\n".join(ls), len((dict(docs)[i] or "").split("\n")), len((dict(docs)[i] or "").split("\n")) - len(ls), 1) for i, ls in deduped(docs).items()}
    assert got == want
    assert got[1][0] == "own" and got[3][0] == f"y\n{long}" and got[12][2] == 0  # É is not lower-cased


def test_lines_of_odd_rows(docs_of):
    got = line_dedup.dedup_lines(docs_of(ODD)).collect()
    assert len(got) == len(ODD) and sum(r.n_dropped for r in got) == 0
    assert line_dedup.dedup_lines(docs_of([])).count() == 0


# --- 2: mixing


def filled(sizes, weights):
    """Targets by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    left = float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check_mix(rows):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r.size
    want = filled(sizes, (1, 2, 3))
    taken, largest = Counter(), Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-3 * len(rows)


def test_mix_comes_near_its_targets(documents):
    mix = source_mix.mix_sources(documents)
    rows = mix.collect()
    assert len(rows) == 200
    check_mix(rows)
    again = source_mix.mix_sources(documents.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    assert source_mix.mixed_rows(documents, mix).count() == sum(r.copies for r in rows)


def test_mix_of_odd_rows(docs_of):
    draw = random.Random(1)
    docs = [(i, "w " * draw.randint(0, 40), draw.choice(["a", "b", "Z", "é", "tiny"])) for i in range(300) if i % 50] + [(900, "one", None), (901, None, None), (None, "x y", "a"), (7000, "r s t", "b"), (7000, "r s t", "b"), (902, "lone", "tiny2")]
    check_mix(source_mix.mix_sources(docs_of(docs), bucket=8).collect())
    assert source_mix.mix_sources(docs_of([])).count() == 0
    assert [r.taken for r in source_mix.mix_sources(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


# --- 7: near duplicates


def components_of(docs, percent=75):
    sets = {}
    for key, text in docs.items():
        w = (text or "").encode().lower().split()
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k), root(k) == k) for k in keys}


def test_near_duplicates_of_the_small_table(documents):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(documents).collect()}
    assert got == components_of(texts_of(documents))


def test_chains_hot_groups_and_odd_rows(docs_of):
    draw = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    docs = {1: None, 2: "", 3: " \n", 4: "one two", 5: "ONE two", 6: "one  two"}
    for k in range(80):  # copies at all distances from one text, and a chain of small steps
        words = [x if draw.random() > k / 250 else f"n{k}_{i}" for i, x in enumerate(base)]
        docs[100 + k] = " ".join(words)
    chain = [f"c{i}" for i in range(100)]
    for k in range(20):
        docs[300 + k] = " ".join(chain[k * 4 :] + [f"d{i}" for i in range(k * 4)])
    df = docs_of([*docs.items(), (4, "one two"), (None, "one two")])
    got = near_dedup.near_duplicates(df)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect() if r.doc_id is not None} == components_of(docs)
    assert got.count() == len(docs) + 2
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_components_of_shuffled_chains(spark):
    ids = random.Random(11).sample(range(10_000), 1000)
    links = [*zip(ids, ids[1:], strict=False), *((20_000, 20_000 + k) for k in range(1, 50)), (30_000, 30_000)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(ids, min(ids)) | {20_000 + k: 20_000 for k in range(50)} | {30_000: 30_000}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_links_within_are_exact():
    draw = random.Random(2)
    texts = [" ".join(draw.choice("abcd") for _ in range(draw.randint(5, 14))) for _ in range(60)]
    sets = shingles.shingle_sets(texts, 2, shingles.WordHashes())
    every = np.arange(len(sets))
    got = {(i, j) for i, j in near_dedup.links_within(sets, every, every, 75, slab=7) if i < j}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if shingles.linked(sets[i], sets[j], 75)}


def test_signatures_estimate_the_similarity():
    a, b = np.arange(1, 4001, dtype=np.uint64), np.arange(1001, 5001, dtype=np.uint64)
    sig = near_dedup.signatures([a, b], 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08


# --- 3: neighbours


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(450, 16)).astype(np.float32)
    x[200] = x[0]
    x[201] = x[202] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(450)] + [(451, None), (452, [0.0] * 16), (453, [float("nan")] * 16), (454, [1.0] * 3), (None, [1.0] * 16), (455, [None] + [1.0] * 15), (456, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in neighbours.nearest(df, block=64, cell_bytes=3000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 450, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(450), d)) if i != q][:10]
        assert [v for v, _ in got[q]] == want
        assert np.allclose([s for _, s in got[q]], d[want], rtol=1e-12)
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_repeated_rows_are_one_candidate(spark):
    rows = [(0, [0.0, 1.0])] + [(1, [0.0, 1.5])] * 40 + [(i, [0.0, 1.0 + i]) for i in range(2, 30)]
    got = neighbours.nearest(spark.createDataFrame(rows * 2, "vec_id long, embedding array<float>").repartition(5), block=16, cell_bytes=400).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(i, i) for i in range(1, 11)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 40)), rng.normal(size=(60, 40)) * 100
    (ai, s, ae), (bi, t, be) = neighbours.quantised(a), neighbours.quantised(b)
    near = np.sqrt(((ai * s[:, None])[:, None] - (bi * t[:, None])[None]) ** 2 @ np.ones(40))
    true = np.sqrt((((a[:, None] - b[None]) ** 2)).sum(2))
    assert (np.abs(near - true) <= ae[:, None] + be[None] + 1e-9).all()
    assert (neighbours.tile(ai, bi) == ai.astype(int) @ bi.astype(int).T).all()


# --- 4: quality


def test_quality_is_learned_and_read_to_the_end(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.train(docs, labels)
    got = quality.classify(docs, net).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.93
    good = "Is and retitioning ouen the of, nterti thorreou ndernt. Is ndble whst the by for and threea. " * 1500
    junk = " ".join(f"THERTI!! THEAHEBLE!! TISTWH!! ENREON{i}!!" for i in range(40))
    score = net.score([good.encode(), (good + junk).encode(), b"", b"The shor."])
    assert score[0] > 0.7 > score[1] and 0 <= score[2] <= 1
    long = net.score([good.encode()], slab=1 << 12)
    assert abs(long[0] - score[0]) < 1e-3


def test_quality_of_odd_rows(docs_of, spark):
    net = quality.train(docs_of(ODD), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.classify(docs_of(ODD), net).count() == len(ODD)
    kept = quality.classify(docs_of(ODD), net, keep=True)
    assert kept.columns[-2:] == ["__score", "__predicted"] and "score" in kept.columns


def test_gradients():
    net = quality.Network(width=8, stride=4, chunk=4, filters=3, hidden=3, dims=2)
    texts, labels, weight = [b"hello world, this is a text", b"X Y Z" * 9], np.array([1.0, 0.0]), np.ones(2)
    net.weights = {k: v.astype(np.float32) for k, v in net.weights.items()}
    _, grads = net.gradients(texts, labels, weight)
    for name in ("w1", "w2", "w3", "b1"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        keep, step = net.weights[name][at], 1e-2
        loss = []
        for d in (step, -step):
            net.weights[name][at] = keep + d
            loss.append(net.gradients(texts, labels, weight)[0])
        net.weights[name][at] = keep
        assert abs((loss[0] - loss[1]) / (2 * step) - grads[name][at]) < 0.05 * max(0.05, abs(grads[name][at]))


# --- 5: language model


def test_scores_against_plain_counts(documents):
    got = {r.doc_id: r for r in lm_scores.score_documents(documents, batch_chars=60_000, bucket_bytes=100_000).collect()}
    tokens = {i: t.encode().lower().split() + [None] for i, t in texts_of(documents).items()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    one, two, begins = Counter(), Counter(), 0
    for i, t in tokens.items():
        if not held(i):
            one.update(t)
            two.update(zip([b"<s>"] + t, t, strict=False))
            begins += 1
    n, v = sum(one.values()), len(one)
    # the weights follow from the deleted counts; recompute them from a plain histogram
    cells = Counter()
    context = lambda h: begins if h == b"<s>" else one[h]
    for i, t in tokens.items():
        if not held(i):
            for h, w in zip([b"<s>"] + t, t, strict=False):
                c = context(h) - 1
                big, uni = ((two[h, w] - 1) / c if c > 0 else 0.0), (one[w] - 1) / (n - 1)
                b = int(lm_scores.context_bucket(np.array([max(c, 0)]))[0])
                cells[b, int(lm_scores.level(np.array([uni * (v + 1)]))[0]), int(lm_scores.level(np.array([big * (v + 1)]))[0])] += 1
    weights = lm_scores.learn_weights([(*k, m) for k, m in sorted(cells.items())])
    assert np.allclose(weights.sum(1), 1)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(one[w] > 0 for w in t), n, held(i))
        assert math.isclose(r.base_score, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        score = 0.0
        for h, w in zip([b"<s>"] + t, t, strict=False):
            c = context(h)
            lam = weights[int(lm_scores.context_bucket(np.array([c]))[0])]
            score += math.log10(lam[0] / (v + 1) + lam[1] * one[w] / n + lam[2] * (two[h, w] / c if c else 0))
        assert math.isclose(r.score, score, rel_tol=1e-6)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_of_odd_rows(docs_of):
    got = lm_scores.score_documents(docs_of(ODD)).collect()
    assert len(got) == len(ODD) and all(r.score < 0 and r.n_tokens >= 1 for r in got)
    assert lm_scores.score_documents(docs_of([])).count() == 0


# --- 9: fingerprints


def test_fingerprints_and_edits(documents):
    docs = sorted(texts_of(documents).items())
    got = {r.doc_id: r for r in fingerprints.fingerprints(documents, block_docs=13).collect()}
    assert len(got) == len(docs)
    for (i, t), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(t) // 4
        assert got[i].n_chars == len(t) and got[i].edited_text == t[: len(t) - n] + after[:n]
        assert 0 <= got[i].near_next <= 1
        assert fingerprints.read_back(got[i].fingerprint) == fingerprints.fingerprint(t.encode(), 64)
    long = [r for r in got.values() if r.n_chars > 1000]
    assert sorted(r.near_edited for r in long)[len(long) // 10] > 0.4 and sorted(r.near_next for r in long)[len(long) // 2] < 0.1


def test_fingerprints_of_odd_rows(docs_of):
    got = fingerprints.fingerprints(docs_of(ODD)).collect()
    assert len(got) == len(ODD) and {r.fingerprint for r in got if r.n_chars == 0} == {""}
    (only,) = fingerprints.fingerprints(docs_of([(1, "abcdefgh")])).collect()
    assert only.edited_text == "abcdefab"
    assert fingerprints.fingerprints(docs_of([])).count() == 0


def test_syncmers_are_closed():
    text = bytes(random.Random(4).choices(range(97, 123), k=400))
    _, at = fingerprints.syncmers(text)
    with np.errstate(over="ignore"):
        inner = fingerprints._inner(np.frombuffer(text, np.uint8))
    w = fingerprints.K - fingerprints.S + 1
    want = [i for i in range(len(text) - fingerprints.K + 1) if min(inner[i : i + w]) in (inner[i], inner[i + w - 1])]
    assert at.tolist() == want
    shifted, _ = fingerprints.syncmers(b"prefix " + text)
    assert set(fingerprints.syncmers(text)[0]) <= set(shifted)  # context-free


# --- 1: licences


def test_licences_found_and_prose_left_alone(docs_of):
    mit = licences.TEMPLATES["MIT"][1]
    docs = [(1, "x\nReleased under the MIT License.\ny"), (2, "Licensed under CC BY-NC 4.0."), (3, "this licence to talk is wide"), (4, mit.replace(" to deal", "\nto deal")), (5, "Released under the MIT Licence"), (None, None), (6, "z " * 40_000 + "\nThis work is licensed under the GNU General Public License, version 3."), (7, "")]
    got = {(r.doc_id, r.licence): (r.changed_words, r.wording) for r in licences.scan_licences(docs_of(docs)).collect()}
    assert set(got) == {(1, "MIT"), (2, "CC-BY-NC-4.0"), (4, "MIT"), (5, "MIT"), (6, "GPL-3.0")}
    assert got[1, "MIT"] == (0, "Released under the MIT License") and got[5, "MIT"][0] == 1
    assert licences.scan_licences(docs_of([])).count() == 0


def test_licences_of_the_small_table(documents):
    lines = {(i, x) for i, t in texts_of(documents).items() for x in t.split("\n") if "icensed under" in x or "MIT License" in x}
    got = {(r.doc_id, r.start): r.wording for r in licences.scan_licences(documents).collect()}
    assert {i for i, _ in got} == {i for i, _ in lines}


def test_licences_inside_other_text(docs_of):
    mit, bsd, gpl = licences.TEMPLATES["MIT"][0], licences.TEMPLATES["BSD"][0], licences.TEMPLATES["GPL-2.0"][1]
    draw = random.Random(3)
    prose = " ".join("".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(draw.randint(2, 9))) for _ in range(120))
    wrapped = bsd.replace("binary", "\n# binary").replace("provided", "\n# provided")
    docs = {1: f"{prose} {mit} {prose}", 2: f"{prose} {gpl} {prose}", 3: f"{prose}\n{prose} {wrapped} {prose}\n{prose}", 4: f"{mit} {prose} {bsd}", 5: f"{mit} {mit}\n{mit}", 6: prose}
    docs[7] = f"{prose} {gpl.replace('redistribute it', 'share it').replace('either ', '')} {prose}"
    got = defaultdict(list)
    for r in licences.scan_licences(docs_of([*docs.items()])).orderBy("start").collect():
        assert docs[r.doc_id][r.start : r.end] == r.wording
        got[r.doc_id].append((r.licence, r.changed_words))
    assert got == {1: [("MIT", 0)], 2: [("GPL-2.0", 0)], 3: [("BSD", 0)], 4: [("MIT", 0), ("BSD", 0)], 5: [("MIT", 0)] * 3, 7: [("GPL-2.0", 3)]}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=9), st.lists(st.sampled_from("abcdefg"), max_size=25), st.sampled_from([0.0, 0.25, 0.5]))
def test_no_statement_is_missed(wording, words, most_changes):
    def differs(run):
        row = [*range(len(run) + 1)]
        for i, x in enumerate(wording, 1):
            before, row = row, [i]
            for j, y in enumerate(run):
                row.append(before[j] if x == y else 1 + min(before[j + 1], row[j]))
        return row[-1]

    least = min((differs(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)), default=99)
    found = licences.Scanner({"x": (" ".join(wording),)}, most_changes).matches(words)
    assert all(differs(words[first:last]) == changed for _, _, _, first, last, changed in found)
    assert min((m[-1] for m in found), default=99) == (least if least <= most_changes * len(wording) else 99)


# --- shared


@given(st.lists(st.integers(0, 50), max_size=30), st.integers(1, 60))
def test_runs_cover_all(sizes, most):
    parts = [*runs(sizes, most)]
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= most or b - a == 1 or sum(sizes[a : b - 1]) == 0 for a, b in parts)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    mine, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLE_SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert sorted(map(tuple, mine[columns].astype(str).values)) == sorted(map(tuple, theirs[columns].astype(str).values))


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        if name == "near dedup":
            assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, v in components_of(texts_of(before)).items() if v[2])
        if name == "line dedup":
            assert texts_of(after) == {i: "\n".join(ls) for i, ls in deduped(texts_of(before).items()).items()}
        if name == "quality classifier":
            kept = {r.doc_id for r in after.collect()}
            assert sum(q == (i in kept) for i, q in labels.items()) / len(labels) > 0.9
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    check_packed(packed, [(r.doc_id, r.text) for r in before.collect()], 2048)
    digest = hashlib.sha256(str(sorted((r.doc_id, r.piece) for r in corpus_pipeline.run(spark, SF).collect())).encode()).hexdigest()
    assert digest == hashlib.sha256(str(sorted((r.doc_id, r.piece) for r in packed)).encode()).hexdigest()


# --- rows of all kinds


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab é\n\t.,'漢1<>|\x1c\r", "  ", "\n\n", "<|endoftext|>", "the", " word.", "'s"]), max_size=14).map("".join), min_size=1, max_size=3))
def test_chunk_counts_are_the_librarys(texts):
    test = test_chunk_counts_are_the_librarys
    if not hasattr(test, "counter"):
        test.counter, test.plain = token_counts.FileCounter(BYTES), Tokenizer.from_file(BYTES)
        assert test.counter.chunked
    assert test.counter.count(texts) == [len(test.plain.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"abZ éÉß\n\t.,'漢1<>|~\x1cİǅ", "  ", "<|endoftext|>", "don't", " word.", "Word,", "á"]), max_size=12).map("".join), min_size=1, max_size=3))
def test_chunk_ids_are_the_librarys(texts):
    test = test_chunk_ids_are_the_librarys
    if not hasattr(test, "encoder"):
        test.encoder, test.plain = packing.ChunkEncoder(WORDS, most_bytes=4000), Tokenizer.from_file(WORDS)
        assert test.encoder.chunked
    assert [np.frombuffer(x, "<u4").tolist() for x in test.encoder.encode(texts)] == [test.plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_are_given_whole_texts():
    encoder, counter = packing.ChunkEncoder(BYTES), token_counts.FileCounter(WORDS)
    assert not encoder.chunked and not counter.chunked
    texts = ["Hello  world\n\n x", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [Tokenizer.from_file(BYTES).encode(t, add_special_tokens=False).ids for t in texts]
    assert counter.count(texts) == [len(Tokenizer.from_file(WORDS).encode(t, add_special_tokens=False).ids) for t in texts]


def test_bounds_and_dominance_of_bins():
    draw = random.Random(8)
    for _ in range(150):
        sizes = [draw.randint(1, 60) for _ in range(draw.randint(1, 8))]
        assert packing.lower_bound(sizes, 60) <= fewest(sorted(sizes, reverse=True), 60)
    counts = Counter({30: 1, 20: 2, 10: 3})
    found = [f for f in packing.fillings([30, 20, 10], counts, 40) if f]
    assert found[0] == (30, 10) and (10, 10, 10) not in found  # 30 takes the place of the three
    # over some blocks the search needs fewer bins than best-fit decreasing, and never more
    blocks = [[draw.randint(50, 1500) for _ in range(2000)] for _ in range(6)]
    found, fit, bound = ([f(b) for b in blocks] for f in (lambda b: len(packing.pack_block(b, 2048)), lambda b: len(packing.best_fit(sorted(b, reverse=True), 2048)), lambda b: packing.lower_bound(b, 2048)))
    assert all(x <= y <= z for x, y, z in zip(bound, found, fit, strict=True)) and sum(found) < sum(fit)


def test_bin_completion_mends_best_fit_and_leaves_bins_unfilled():
    draw, mended, unfilled = random.Random(12), 0, 0
    for _ in range(4000):
        sizes = sorted((draw.randint(11, 70) for _ in range(9)), reverse=True)
        need = fewest(sizes, 100) if len(packing.best_fit(sizes, 100)) > packing.lower_bound(sizes, 100) else None
        if need is not None and need < len(packing.best_fit(sizes, 100)):
            bins = packing.pack_block(sizes, 100)
            assert len(bins) == need and sorted(i for b in bins for i in b) == list(range(len(sizes)))
            mended, unfilled = mended + 1, unfilled + any(sum(sizes[i] for i in b) + min(sizes) > 100 > sum(sizes[i] for i in b) for b in bins)
    assert mended > 5 and unfilled
    left = [f for f in packing.fillings([9], Counter({9: 1}), 5)]
    assert left == [()]  # what nothing fits is left as it is


def plain_score(net, text):
    """The network's probability, window by window and chunk by chunk."""
    half = net.stride * net.chunk // 2
    n = max(2, -(-len(text) // half))
    data = text + bytes(n * half + net.width - len(text))
    p = {k: v.astype(np.float64) for k, v in net.weights.items()}
    act = [np.maximum(p["table"][np.frombuffer(data[i * net.stride : i * net.stride + net.width], np.uint8)].reshape(-1) @ p["w1"] + p["b1"], 0) for i in range(n * net.chunk // 2)]
    layer = [np.maximum(np.mean(act[k * net.chunk // 2 : k * net.chunk // 2 + net.chunk], axis=0) @ p["w2"] + p["b2"], 0) for k in range(n - 1)]
    return 1 / (1 + math.exp(-(np.max(layer, axis=0) @ p["w3"] + p["b3"][0])))


def test_scores_depend_on_the_text_alone():
    net, draw = quality.Network(), random.Random(6)
    texts = [bytes(draw.choices(range(32, 127), k=draw.choice([0, 1, 31, 32, 33, 64, 65, 320, 321, 1000, 4097]))) for _ in range(40)]
    want = [plain_score(net, t) for t in texts]
    assert np.allclose(net.score(texts), want, atol=1e-5)
    assert np.allclose(net.score(texts[::-1])[::-1], want, atol=1e-5)
    assert np.allclose([net.score([t])[0] for t in texts], want, atol=1e-5)
    for slab in (64, 96, 256, 1024):
        assert np.allclose(net.score(texts, slab=slab), want, atol=1e-5)


def test_scores_of_other_partitionings(documents, spark):
    net = quality.Network()
    got = [{r.doc_id: r.score for r in quality.classify(documents.repartition(n), net).collect()} for n in (1, 7)]
    assert all(abs(got[0][i] - got[1][i]) < 1e-5 for i in got[0])


def test_training_rows_of_repeated_and_conflicting_ids(spark, docs_of):
    docs = docs_of([(1, "a"), (1, "b"), (2, None), (3, "c"), (None, "d")])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    draw = lambda: sorted((r.id, r.label, r.text) for r in quality.training_rows(docs.repartition(3), labels, "doc_id", "text", "quality", 3, 99, 4, 9).collect())
    assert len(draw()) == 3 and draw() == draw()
    every = quality.training_rows(docs, labels, "doc_id", "text", "quality", 99, 99, 4, 9).collect()
    assert sorted((r.id, r.label, r.text) for r in every) == [(1, 0, "a"), (1, 0, "b"), (1, 1, "a"), (1, 1, "b"), (2, 1, "")]


def test_texts_of_one_id_link_all(docs_of):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a), (5, b), (7, a.replace("a39", "x")), (8, b.replace("b39", "y")), (9, "else"), (5, b)]
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    assert got == {5: (5, True), 7: (5, False), 8: (5, False), 9: (9, True)}


def test_a_large_family_loses_no_link(docs_of):
    draw = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    docs = {}
    for k in range(260):
        share = draw.choice([0.02, 0.05, 0.1, 0.3, 0.5])
        docs[k] = " ".join(x if draw.random() > share else f"n{k}_{i}" for i, x in enumerate(base))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs_of([*docs.items()]).repartition(7)).collect()}
    assert got == components_of(docs)


def test_mixed_rows_tell_sources_apart(spark):
    rows = [(1, "t t t", "a"), (1, "t t t", "b"), (1, "t t t", "b"), (2, None, None), (3, "u v", None), (None, "w", "b")] + [(i, "x y z", "ab"[i % 2]) for i in range(10, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumnRenamed("doc_id", "doc_id")
    mix = source_mix.mix_sources(docs)
    want = Counter()
    for r in mix.collect():
        want[r.doc_id, r.source] += r.copies
    got = Counter((r.doc_id, r.source) for r in source_mix.mixed_rows(docs, mix).collect())
    assert got == +want


def test_counts_through_levels_agree(documents):
    score = lambda **k: {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm_scores.score_documents(documents, batch_chars=30_000, **k).collect()}
    assert score() == score(bucket_bytes=20_000, level_bits=2)


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    return context.statusStore().executorList(False).head().totalShuffleWrite()


def test_shuffles_of_counts_stay_in_proportion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(1)
    size = sum(len((r.text or "").encode()) for r in docs.select("text").collect())
    took = []
    for bits, more in ((4, {}), (8, {}), (8, {"level_bits": 4})):
        before = shuffled(spark)
        lm_scores.score_documents(docs, batch_chars=300_000, bucket_bytes=size // 2**bits + 1, **more).count()
        took.append(shuffled(spark) - before)
    assert took[1] < 1.25 * took[0] and took[2] < 1.4 * took[0]


def test_request_rows_grow_with_the_input(documents):
    batches = lm_scores.batches_of(documents, "doc_id", "text", 7, 2, 30_000)
    assert lm_scores.requests_of(batches, 3).count() == 8 * batches.count()


def plain_likeness(x, y, anchors):
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    sample = set(sorted({h for _, h in x} | {h for _, h in y})[:anchors])
    place = {h: at for at, h in y}
    seq = [place[h] for _, h in x if h in sample and h in place]
    best = []
    for i, v in enumerate(seq):
        best.append(1 + max((best[j] for j in range(i) if seq[j] < v), default=0))
    return max(best, default=0) / len(sample)


def test_likeness_and_crowded_ids(docs_of, spark):
    draw = random.Random(4)
    prose = lambda: " ".join("".join(draw.choices("abcdefg", k=5)) for _ in range(draw.randint(1, 60)))
    rows = [(None, prose()) for _ in range(120)] + [(7, prose()) for _ in range(90)] + [(i, prose()) for i in range(100, 160)] + [(150, "same")] * 3
    df = docs_of(rows).repartition(5)
    order = {(r.i, r.t): r.o for r in df.selectExpr("doc_id i", "text t", "xxhash64(text) o").collect()}
    ordered = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], order[r]))
    want = Counter()
    for (i, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        new = fingerprints.edited(t, after)
        marks = [fingerprints.fingerprint(x.encode(), 64) for x in (t, new, after)]
        want[i, new, round(plain_likeness(marks[0], marks[1], 64), 9), round(plain_likeness(marks[0], marks[2], 64), 9)] += 1
    got = fingerprints.fingerprints(df, block_docs=20).collect()
    assert Counter((r.doc_id, r.edited_text, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert max(r["count"] for r in fingerprints.with_next(df, "doc_id", "text", 20, 1000).groupBy("block").count().collect()) < 60


def test_neighbours_of_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [0.0, 1.0], "x"), (0, [9.0, 1.0], "y"), (1, [0.5, 1.0], "z"), (2, [9.5, 1.0], None), (3, [30.0, 1.0], "w")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").selectExpr("*", "score rank", "score query_id")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in neighbours.nearest(df, k=3).orderBy("rank").collect()]
    assert [(g[1], g[2]) for g in got[:2]] == [(1, 1), (2, 2)] and {g[3] for g in got[:2]} == {0.5}


CLASHES = ["size", "hash", "block", "id", "node", "component", "key", "band", "n_lines", "score", "held_out", "taken", "doc", "body", "to", "lent", "copies", "__copies_of"]


def test_clashing_columns_and_odd_rows_everywhere(docs_of, spark, monkeypatch):
    import corpus_pipeline

    labels = spark.createDataFrame([(1, 1), (4, 1), (6, 0)], "doc_id long, quality int")
    monkeypatch.setattr(corpus_pipeline, "read", lambda *_: labels)
    for rows in (ODD, []):
        docs = docs_of(rows).selectExpr("doc_id", "text", "cast(null as string) source", *[f"'c' `{c}`" for c in CLASHES])
        assert licences.scan_licences(docs).count() == 0
        for df in (source_mix.mix_sources(docs), quality.classify(docs, quality.Network()), lm_scores.score_documents(docs), line_dedup.dedup_lines(docs), near_dedup.near_duplicates(docs), fingerprints.fingerprints(docs), token_counts.count_tokens(docs, BYTES)):
            assert df.count() == len(rows)
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, SF)
            assert now.columns == docs.columns, name
            assert now.count() <= 3 * len(rows)
        assert corpus_pipeline.STAGES[2][1](spark, docs, SF).filter("doc_id = 6").count() == (1 if rows else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= len(rows)
