import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from feedloom.llm.packing import best_fit, pack, token_bytes, vocabulary
from llm_help import make, prose  # noqa: F401


def ids(text):
    tokenizer = Tokenizer.from_file(vocabulary())
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


TEXTS = [None, "", "One, two\x1cthree four 's 'S don't", "été İstanbul ΣΣ", "<|endoftext|> x", prose(1, 9000), "a\tb\x0bc\x85d", "你好 123 4",
         "x<|startoftext|>Y<|ENDOFTEXT|>z <|EndOfText|> <|", "(a.b),c's!'t we'LL 'rest' a--b__c É́. ß.ﬁ; x1.5y", "don't.DON'T,\x00a\u3000b. <|endoftext|><|endoftext|>."]


def test_token_bytes_are_those_of_the_tokenizer():
    assert [np.frombuffer(b, "<u4").tolist() for b in token_bytes(TEXTS, vocabulary())] == [ids(t) for t in TEXTS]


def test_best_fit_leaves_no_two_bins_that_fit_together():
    r = np.random.default_rng(1)
    lengths = r.integers(1, 101, 3000)
    bins, offsets, fills = best_fit(lengths, 100)
    assert fills.max() <= 100 and fills.sum() == lengths.sum()
    low = np.sort(fills)
    assert low[0] + low[1] > 100 and len(fills) <= 1.02 * -(-lengths.sum() // 100)
    assert all(lengths[bins == b].sum() == fills[b] for b in range(20))


def check(rows, out, capacity):
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for p in out:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for doc_id, text in rows:
        tokens = ids(text)
        pieces = sorted(by_doc[doc_id], key=lambda p: p.piece)
        assert [p.piece for p in pieces] == list(range(-(-len(tokens) // capacity)))
        for p in pieces:
            part = tokens[p.start:p.start + p.length]
            assert p.start == p.piece * capacity and p.length == len(part)
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    return len(by_sequence)


def test_pieces_and_places_over_many_partitions(make):
    r = random.Random(4)
    rows = [(k, prose(k, r.choice([3, 10, 40, 90, 200]))) for k in range(150)] + [(1000 + k, t) for k, t in enumerate(TEXTS)]
    out = pack(make(rows).repartition(40), capacity=256, fan_in=3).collect()
    check(rows, out, 256)
    fills = defaultdict(int)
    for p in out:
        fills[p.sequence_id] += p.length
    assert sum(f <= 128 for f in fills.values()) <= 1  # of all partitions together
    two = pack(make(rows).coalesce(2), capacity=256).collect()
    whole = best_fit(np.array([p.length for p in two]), 256)[2]  # all pieces packed at once
    assert check(rows, two, 256) <= len(whole) + 2


def test_empty_table_and_one_row(make):
    assert pack(make([])).count() == 0
    only = pack(make([(4, None)])).collect()
    assert [(p.doc_id, p.piece, p.start, p.length, p.offset) for p in only] == [(4, 0, 0, 1, 0)]
