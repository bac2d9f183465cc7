import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import TEXTS, documents, plain, same
from tracklane.llm import packing, rans, token_counts, token_files, tokens
from tracklane.llm.tokens import Encoder

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids():
    t = Tokenizer.from_file(BYTES)
    return [(d, e.ids) for (d, _), e in zip(TEXTS, t.encode_batch([t for _, t in plain(TEXTS)], add_special_tokens=False))]


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_chunked_encoding_is_the_library_s():
    rng = np.random.default_rng(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "1", "²", "!", "é", "\xa0", "<|endoftext|>", "\x1c", "日", ".", "Word"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(3000)]
    e = Encoder(BYTES)
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]


def test_words_are_learned_one_by_one_whatever_is_beside_them():
    e = Encoder(BYTES)
    texts = ["one alpha,\nbeta gämma.\nDelta", "日本 😀 ²", "x\n\ny z", ""]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    assert {" alpha", "beta", " gämma", "Delta"} <= e.words.keys()
    assert list(e.documents(iter([]))) == []


@pytest.mark.parametrize("n", [0, 1, 5, 511, 513, rans.SPAN, rans.SPAN + 1, rans.BLOCK + 7])
def test_coding_round_trip(n):
    x = np.minimum(np.random.default_rng(n).zipf(1.3, n), 50_000).astype(np.uint32)
    table = rans.make_table(x)
    blocks = rans.encode(x, table)
    got = rans.decode(blocks, table)
    assert np.array_equal(np.concatenate(got) if got else x[:0], x)


def test_damage_is_noticed():
    out = io.BytesIO()
    token_files.write_file(out, [None, 3, 3], [1, 0, 4], np.arange(5, dtype=np.uint32))
    good = out.getvalue()
    assert token_files.read_file(io.BytesIO(good)).doc_ids == [None, 3, 3]
    for at in range(0, len(good), 7):
        bad = bytearray(good)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_files.read_file(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        token_files.read_file(io.BytesIO(good[:-1]))


def test_token_files(spark, ids):
    got = token_files.read(token_files.write(documents(spark), BYTES)).orderBy("start").collect()
    assert sorted(map(repr, [(r.doc_id, r.n_tokens, r.ids_crc32) for r in got])) == sorted(map(repr, [(d, len(x) + 1, crc([*x, 0])) for d, x in ids]))
    known = [r.doc_id for r in got if r.doc_id is not None]
    assert [r.doc_id for r in got[:2]] == [None, None] and known == sorted(known)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert token_files.read(token_files.write(documents(spark, []), BYTES)).count() == 0


def test_best_fit_is_the_tightest_window():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 65, 500).tolist()
    placed, used = packing.best_fit(lengths, 64)
    free, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(c, k) for k, c in enumerate(free) if c >= lengths[i]]
        k = min(fits)[1] if fits else len(free)
        if not fits:
            free.append(64)
        free[k] -= lengths[i]
        want[i] = free[k]
    assert used == len(free)
    ends = {}
    for (s, at), n in zip(placed, lengths):
        assert at + n <= 64
        ends[s] = ends.get(s, 0) + n
    assert sorted(ends.values()) == sorted(64 - c for c in free)


def test_packing(spark, ids):
    rows = packing.pack(documents(spark), BYTES, pool=7).collect()
    whole = {}
    for r in rows:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for d, x in ids:
        x = [*x, 1]
        want.setdefault((d, len(x)), []).extend((s, min(2048, len(x) - s), crc(x[s:s + 2048])) for s in range(0, len(x), 2048))
    for k, pieces in whole.items():
        same([(r.start, r.length, r.ids_crc32) for r in pieces], want[k])
    assert whole.keys() == want.keys()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))] and sum(n for _, n in x) <= 2048
    assert packing.pack(documents(spark, []), BYTES).count() == 0


@pytest.mark.parametrize("block", [1, 1 << 23])
def test_counts(spark, block):
    t = Tokenizer.from_file(WORDS)
    want = [(d, len(x.encode()), len(e.ids), len(e.ids) > 2048)
            for (d, x), e in zip(plain(TEXTS), t.encode_batch([x for _, x in plain(TEXTS)], add_special_tokens=False))]
    got = token_counts.count(documents(spark), WORDS, limit=2048)
    same([tuple(r) for r in got.collect()], want)
    assert token_counts.count(documents(spark, []), WORDS).count() == 0


def test_pieces_are_the_library_s():
    rng = np.random.default_rng(4)
    parts = ["a", "B", " ", "\n", "'s", "'", "S", "1", "²", "!", "é", "É", "İ", "Σ", "é", "<|endoftext|>", "<|EndOfText|>", "\x1c", "\x85",
             " ", "日", "_", "½", "ﬁ", "😀", "​", "ß", "ẞ", "Ⅷ", "ª"]
    p = token_counts.Pieces(WORDS)
    texts = ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(3000)]
    for t, e in zip(texts, p.tok.encode_batch(texts, add_special_tokens=False)):
        pieces = [x for c in token_counts.chunks_of(t) for x in p.of_chunk(c)]
        assert (p.count(pieces).sum() if pieces else 0) == len(e.ids)


def test_lines_and_marks_of_distinct_words_are_kept_once():
    """Words are kept without the line ends and marks beside them, so their number does not grow with the neighbours."""
    e = Encoder(BYTES)
    words = ["alpha", "gämma", "Öl", "naïveté", "delta"]
    texts = [f"x {a}{m}\n{b}{m} {b}\n\n{a} \n{b}" if odd else f"x {a}{m}\n{b}{m} {b}\n\n{a} {a}{m}" for a in words for b in words
             for m in ("", ",", "***", '").', "'", "²") for odd in (False, True)]
    texts += ["\nx", "x\n", "a\nb\nc", "a \nb\nc", "a\n\x1cb c\x1c\nd e", "x \x85y\nz", "a\t\nb c", "\n", " \n", "x ıß,\nǅ. ʰ, ª!"]
    for _ in range(2):
        assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.tok.encode_batch(texts, add_special_tokens=False)]
    e = Encoder(BYTES)
    e.encode([f"x {a}{m}\n{b}{m}" for a in words for b in words for m in ("", ",", "***")])
    assert len(e.words) + len(e.heads) + len(e.rest) <= 2 * len(words) + 2 * 3 * len(words) + 2  # before: one for each pair of words


def test_caches_are_bounded_and_ids_stay(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_KEPT", 20)
    e = Encoder(BYTES)
    texts = [f"w{chr(97 + i % 26)}x tä{chr(97 + i % 7)},\nzu{chr(97 + i % 11)}. {i}" for i in range(200)]
    for k in range(0, 200, 5):
        assert [x.tolist() for x in e.encode(texts[k:k + 5])] == [x.ids for x in e.tok.encode_batch(texts[k:k + 5], add_special_tokens=False)]
        assert len(e.words) + len(e.heads) + len(e.rest) < 60
