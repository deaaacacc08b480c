import os
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tonewright.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


PLAIN, ENCODER = Tokenizer.from_file(PATH), packing.Encoder(PATH, public_tokenizers.path(packing.RANKS))


def check(frame, length):
    docs = [(r.doc_id, r.text) for r in frame.collect()]
    got = packing.best_fit_packing(frame, PATH, length, public_tokenizers.path(packing.RANKS)).collect()
    plain = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0]
        if len(ids) > length:
            cuts = [0, *range(len(ids) % length or length, len(ids), length)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = {}
    for r in got:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for here in held.values():
        at = 0
        for off, size in sorted(here):
            assert off == at
            at += size
        assert at <= length
    total = sum(r.length for r in got)
    return len(held), -(-total // length)


def test_odd(odd):
    check(odd, 64)
    check(odd, packing.LENGTH)


def test_documents(spark, small):
    used, least = check(spark.read.parquet(os.path.join(small, "documents.parquet")), packing.LENGTH)
    assert used <= 1.05 * least + 1


def test_empty(none):
    assert packing.best_fit_packing(none, PATH).collect() == []


def test_special_strings(spark):
    check(spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>")], "doc_id long, text string"), 16)


WHITE = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", "\u00a0", "\u2003 ", "\x1c", "\x85", "", "a", "Bc", "'s", "12", "é", "漢", "!?", "_", "²", "\U0001f600", "\u0301", "<|endoftext|>", "x" * 70]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(WHITE), max_size=14).map("".join))
def test_ids_are_the_library_s(text):
    want = np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert ENCODER.encode(text) == want and ENCODER.encode(text) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_bins(sizes):
    bins = packing.best_two_fit(np.bincount(sizes, minlength=41), 40)
    assert Counter(x for b in bins for x in b) == Counter(sizes)
    assert all(sum(b) <= 40 for b in bins)


def plain_two_fit(sizes, length):
    """The method on plain lists: open with the longest, fill greedily, then put two for the last one while that fills better."""
    left, bins = sorted(sizes), []
    fits = lambda room: max((x for x in left if x <= room), default=0)
    while left:
        here = [left.pop()]
        while n := fits(length - sum(here)):
            left.remove(n)
            here.append(n)
        while sum(here) < length and len(here) > 1:
            least = here[-1]
            room = length - sum(here) + least
            best = (least, None)
            for first in sorted(set(left)):
                if 2 * first > room:
                    break
                left.remove(first)
                second = fits(room - first)
                left.append(first)
                left.sort()
                if second and first + second > best[0]:
                    best = (first + second, (first, second))
            if not best[1]:
                break
            left.append(here.pop())
            for n in best[1]:
                left.remove(n)
                here.append(n)
            left.sort()
            here[1:] = sorted(here[1:], reverse=True)
        bins.append(here)
    return bins


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_replacement_against_plain_lists(sizes):
    assert packing.best_two_fit(np.bincount(sizes, minlength=41), 40) == plain_two_fit(sizes, 40)


def test_drawn_lengths_fill_their_sequences():
    sizes = np.random.default_rng(3).integers(1, 2049, 20_000)
    bins = packing.best_two_fit(np.bincount(sizes, minlength=2049), 2048)
    assert len(bins) <= 1.01 * -(-sizes.sum() // 2048) + 1


def test_a_long_text(spark):
    text = "Some words that go on and on. " * 350_000
    got = packing.best_fit_packing(spark.createDataFrame([(1, text), (2, "x")], "doc_id long, text string"), PATH, ranks=public_tokenizers.path(packing.RANKS)).collect()
    ids = np.array([*PLAIN.encode(text, add_special_tokens=False).ids, 0], "<u4")
    mine = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 1)
    assert mine == [(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(packing.pieces_of(len(ids), packing.LENGTH))]
