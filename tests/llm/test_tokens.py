"""Packing, the two token codecs and wavelet files, against the libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
from sievework.llm.packing import pack, pieces_of
from sievework.llm.queries import tokenizer_path
from sievework.llm.sp_codec import Codec, encode_decode
from sievework.llm.tokens import Encoder
from sievework.llm.wavelet import Wavelet, build, read, write

from .conftest import rows


def _library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def _text(r, letters):
    return "".join(r.choice(letters) for _ in range(r.randint(0, 14)))


def test_encoder_equals_library():
    r = random.Random(1)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        own, library = Encoder(tokenizer_path(name)), _library(name)
        for i in range(4000):
            text = _text(r, "aBé.,!' \n\t ́ß1²ǅ漢sİΣ\x1c_-🎉")
            text = text.replace("a", "<|endoftext|>") if i % 9 == 0 else text
            assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_are_binary():
    for n in (1, 2, 3, 2047, 2048, 2049, 6001):
        pieces = pieces_of(n, 2048)
        assert sum(k for _, k in pieces) == n and [s for s, _ in pieces] == np.cumsum([0, *[k for _, k in pieces]])[:-1].tolist()
        assert all(k & (k - 1) == 0 and k <= 2048 for _, k in pieces)


def test_pack(docs, none):
    out = pack(docs, tokenizer_path("word_bpe_49k.json"), 1, 64, with_ids=True).collect()
    library = _library("word_bpe_49k.json")
    ids = [(x[0], [*library.encode(x[1] or "", add_special_tokens=False).ids, 1]) for x in rows()]
    want = Counter((d, s, k, zlib.crc32(np.array(t[s:s + k], "<u4").tobytes()), len(t)) for d, t in ids for s, k in pieces_of(len(t), 64))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    assert sorted(r.sequence_id for r in out) == list(range(len(out))) and {r.offset for r in out} == {0}
    by_number = [r.length for r in sorted(out, key=lambda r: r.sequence_id)]
    assert by_number == sorted(by_number, reverse=True)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in out)
    assert pack(none, tokenizer_path("word_bpe_49k.json"), 1).count() == 0


def test_sentencepiece(docs, none):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    sp, own, r = sentencepiece.SentencePieceProcessor(model_file=path), Codec(path), random.Random(2)
    for _ in range(4000):
        text = _text(r, "aaeestthn  \n\tB.,'é▁<s>漢字🎉\x00ﬁ0 19")
        ids = own.encode(text)
        assert ids.tolist() == sp.encode(text, add_bos=True, add_eos=True) and own.decode(ids).decode() == sp.decode(ids.tolist())
    for _ in range(200):  # words far longer than any piece
        text = "".join(r.choice("etaoinshrdlucmfw") for _ in range(400))
        assert own.encode(text).tolist() == sp.encode(text, add_bos=True, add_eos=True)
    want = Counter()
    for x in rows():
        ids = sp.encode(x[1] or "", add_bos=True, add_eos=True)
        want[x[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += 1
    assert Counter(tuple(x) for x in encode_decode(docs, path).collect()) == want
    assert encode_decode(none, path).count() == 0


def test_wavelet_answers():
    rng = np.random.default_rng(0)
    ids = (rng.zipf(1.3, 20_000) % 50257).astype(np.uint16)
    w = Wavelet(build(ids, [1], [len(ids)], 16))
    assert (w.all() == ids).all()
    for i in rng.integers(0, len(ids), 100).tolist():
        assert w.access(i) == ids[i]
    for token in (1, 2, 77, 50256):
        at = np.flatnonzero(ids == token)
        assert w.count(token) == len(at) and w.count(token, 100, 9000) == ((at >= 100) & (at < 9000)).sum()
        assert all(w.locate(token, j) == at[j] for j in {0, len(at) // 2, len(at) - 1} if 0 <= j < len(at))
    assert not len(Wavelet(build(ids[:0], [], [], 16)).all())


def test_wavelet_files(docs, none, monkeypatch):
    import sievework.llm.wavelet as wavelet

    monkeypatch.setattr(wavelet, "FILE_TOKENS", 300)
    path, library = tokenizer_path("byte_bpe_50k.json"), _library("byte_bpe_50k.json")
    got = read(write(docs, path, 2)).collect()
    ordered = sorted(rows(), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    want, at = [], 0
    for x in ordered:
        ids = np.array([*library.encode(x[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((x[0], at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert read(write(none, path, 2)).count() == 0
