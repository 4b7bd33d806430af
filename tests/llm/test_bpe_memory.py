"""Memory of the BPE workers: a worker's share must depend neither on the texts' kind nor on the stages before."""

import pickle
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pytest

from talkweave.llm import bpe, kernel

MERGES = bpe.load()


def peak(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_the_vocabulary_is_not_built_again_in_a_worker():
    sent = pickle.dumps(MERGES)
    got, mb = peak(lambda: pickle.loads(sent))
    assert mb < 20
    assert got.encode_many([b" several", b"x" * 200]) == MERGES.encode_many([b" several", b"x" * 200])


def test_long_pieces_are_not_cached():
    letters = np.random.default_rng(3).choice(list("一丁我的天好是中"), (400, 300))
    texts = ["".join(x) for x in letters] + ["short words stay", ""]
    fresh = pickle.loads(pickle.dumps(MERGES))
    encoder = bpe.Encoder(fresh)
    for _ in range(2):
        coded = encoder.encode(texts)
        assert [encoder.decode(np.frombuffer(c, np.int32)) for c in coded] == texts
        assert [np.frombuffer(c, np.int32).tolist() for c in coded[:3]] == [MERGES.encode_long(t.encode()) for t in texts[:3]]
    assert set(fresh.cache) == {"short", " words", " stay"}


def test_a_piece_of_many_texts_is_held_once():
    texts = ["some words that come again and again " * 80] * 350  # 1 MB, as a group has
    encoder = bpe.Encoder(pickle.loads(pickle.dumps(MERGES)))
    coded, mb = peak(lambda: encoder.encode(texts))
    assert len(set(coded)) == 1 and encoder.decode(np.frombuffer(coded[0], np.int32)) == texts[0]
    assert mb < 9


def test_freed_memory_goes_back():
    held = Path("/proc/self/smaps_rollup")
    if not held.exists():
        pytest.skip("no such file here")
    now = lambda: int(re.search(r"\nRss:\s+(\d+)", held.read_text())[1]) / 1024
    blocks = [np.ones(1000) for _ in range(20_000)]  # 160 MB in small blocks, some of which stay
    kept = blocks[::1000] + [blocks[-1]]
    del blocks
    before = now()
    kernel.give_back()
    assert now() < before - 80 and all(x.sum() == 1000 for x in kept)
