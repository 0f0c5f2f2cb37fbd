import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftline.llm import packing as P

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def test_chunks_give_the_same_ids(messy):
    rng = random.Random(1)
    texts = [r.text or "" for r in messy.collect()]
    texts += ["a", " a", "a ", "a\nb c.\n\nd", "it's don't I'LL", "x 's", "1,2.3 4a.", "tab\there", "“q” …", "a \nb", "<|endoftext|> x", "é. è, ñ.", "..a ,b", "a,,b..c", "\x01x", "a\r\nb", "x" * 5000]
    texts += ["".join(rng.choice("ab ,.\n'1é!") for _ in range(rng.randrange(40))) for _ in range(500)]
    t = Tokenizer.from_file(PATH)
    got = P.ChunkEncoder(PATH).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_best_fit_is_the_tightest():
    rng = random.Random(2)
    lengths = sorted((rng.randrange(1, 101) for _ in range(400)), reverse=True)
    number, offset = P.best_fit(lengths, 100)
    room = []
    for n, w, o in zip(lengths, number, offset):
        fits = [r for r in room if r >= n]
        if fits:
            assert w < len(room) and room[w] == min(fits) and o == 100 - room[w]
            room[w] -= n
        else:
            assert w == len(room) and o == 0
            room.append(100 - n)


def test_pieces(messy, empty):
    out = P.pack(messy, PATH, window=64, per_bin=10).collect()
    t, docs = Tokenizer.from_file(PATH), [(r.doc_id, r.text) for r in messy.collect()]
    want = defaultdict(int)
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        for s in range(0, len(ids), 64):
            piece = ids[s : s + 64]
            want[i, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += 1
    got = defaultdict(int)
    for r in out:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert got == want
    windows = defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length))
    for spans in windows.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 64
    assert P.pack(empty, PATH).count() == 0


def test_memory_of_other_operators_is_given_back():
    """A task of another operator empties what packing remembers in its worker; one of packing keeps it."""
    from weftline.llm import common

    common.remembered("packing")["x"] = 1
    assert list(common.tidy(iter, "packing")([1])) == [1] and common.remembered("packing") == {"x": 1}
    assert list(common.tidy(iter)([2])) == [2] and common.remembered("packing") == {}
