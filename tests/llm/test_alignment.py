"""Token alignment against a plain one that encodes whole texts and walks their bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import alignment

BYTE_FILE, PIECE_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(BYTE_FILE), sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(text):
        """[(A ids, B ids)] of the groups, or None."""
        whole = (" " + (text or "")).encode()
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a, bytes_b = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a], [of_b(i) for i in ids_b]
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        out, x, y, i, j, at = [], 0, 0, 0, 0, ([], [])
        while i < len(ids_a) or j < len(ids_b):
            if j == len(ids_b) or i < len(ids_a) and x + len(bytes_a[i]) <= y + len(bytes_b[j]):
                x += len(bytes_a[i])
                at[0].append(ids_a[i])
                i += 1
            else:
                y += len(bytes_b[j])
                at[1].append(ids_b[j])
                j += 1
            if x == y:
                out.append(at)
                at = ([], [])
        return out

    def rows(texts):
        found = [groups(t) for t in texts]
        links = [Counter((p, q) for g in gs for p in g[0] for q in g[1]) for gs in found]
        count = Counter(pair for x in links for pair in x)
        most = Counter()
        for (p, _), n in count.items():
            most[p] = max(most[p], n)
        out = []
        for gs, x in zip(found, links, strict=True):
            spelt = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in gs)
            out.append((sum(len(g[0]) for g in gs), sum(len(g[1]) for g in gs), len(gs), sum(x.values()), sum(n for k, n in x.items() if count[k] == most[k[0]]), sum(n * count[k] for k, n in x.items()), hashlib.sha256(spelt.encode()).hexdigest() if gs else ""))
        return out

    return rows


def odd_texts(n, seed):
    draw = random.Random(seed)
    bits = ["word", "Wort's", "ünï", "日本語の", "123", "...", " ", "  ", "\n", "\n\n", "\t", "\r\n", " ", "　", " ", "\x1c", "\x85", "​", "<s>", "<|endoftext|>", "<unk>", "<0x41>", "é", "é", "\U0001f600", "'ll", "a", "-", "\x00", "ﬁ", "½", " the", " of", "\x07"]
    return ["".join(draw.choice(bits) for _ in range(draw.randint(1, 12))) for _ in range(n)]


TEXTS = [None, "", " ", "  ", "\n", " \n ", "a", "a ", " a", "a  ", "the cat's 12 mice\nrun  far", "▁", "a ▁b", "x" * 5_000, "the word " * 4_000, "the cat", "the cat", "\ta", "a\t b", "a \tb\n"]


def test_documents_are_the_plain_ones(spark, plain):
    texts = TEXTS + odd_texts(600, 3)
    docs = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, place int").repartition(3)
    for most_hot in (400_000, 50, 1):  # all by broadcast, both ways, all by shuffle
        got = alignment.alignment(docs.drop("doc_id").withColumnRenamed("place", "doc_id").withColumn("row", F.lit(1)).withColumn("pairs", F.lit("x")), BYTE_FILE, PIECE_FILE, most_hot=most_hot).collect()
        assert [tuple(r[c] for c in COLUMNS) for r in sorted(got, key=lambda r: r["doc_id"])] == plain(texts)
    by_null = alignment.alignment(docs, BYTE_FILE, PIECE_FILE).select(*COLUMNS).collect()
    assert sorted(map(tuple, by_null)) == sorted(plain(texts))


def test_words_learnt_in_turns_change_nothing(plain):
    texts = odd_texts(300, 8)
    lexicon = alignment.Lexicon(alignment.Encoders(BYTE_FILE, PIECE_FILE), most_bytes=40_000)  # forgets nearly every time
    want = plain(texts)
    for at in range(0, 300, 10):
        totals, hashes, *_ = lexicon.documents(texts[at : at + 10])
        assert [(*t, h) for t, h in zip(totals.tolist(), hashes, strict=True)] == [(*w[:4], w[6]) for w in want[at : at + 10]]


def test_without_safe_cuts_texts_go_whole(plain):
    lexicon = alignment.Lexicon(alignment.Encoders(BYTE_FILE, PIECE_FILE))
    lexicon.encoders.cuts = False
    texts = TEXTS[2:] + odd_texts(100, 9)
    totals, hashes, *_ = lexicon.documents(texts)
    assert [(*t, h) for t, h in zip(totals.tolist(), hashes, strict=True)] == [(*w[:4], w[6]) for w in plain(texts)]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(docs, BYTE_FILE, PIECE_FILE).collect() == []
