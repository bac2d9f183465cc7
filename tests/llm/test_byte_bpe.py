import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from tests.llm.cases import TEXTS, documents, plain, same
from tracklane.llm import byte_bpe, queries
from tracklane.llm.byte_bpe import Vocabulary

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=Vocabulary.read(FILE).ranks, special_tokens={})


def ids_of(row):
    return np.frombuffer(row.ids, "<u4").tolist()


def test_whole_table(spark, library):
    more = [(30, "日本語の文章です。" * 40), (31, "x" * 700 + "y"), (32, "  two  spaces \n\n in\x1cside "), (33, "don't we'll 12345 !?"),
            (34, "Zażółć gęślą jaźń"), (35, " "), (36, "a  b  c"), (37, "<|endoftext|>")]
    rows = TEXTS + more
    want = [(d, tuple(library.encode_ordinary(t)), t.encode()) for d, t in plain(rows)]
    got = byte_bpe.decode(byte_bpe.encode(documents(spark, rows), FILE, P.PATTERN, block_chars=30_000), FILE).collect()
    same([(r.doc_id, tuple(ids_of(r)), bytes(r.decoded)) for r in got], want)
    assert all(r.n_tokens == len(ids_of(r)) for r in got)
    none = byte_bpe.decode(byte_bpe.encode(documents(spark, []), FILE, P.PATTERN), FILE)
    assert none.count() == 0


@pytest.mark.parametrize("most", [(300_000, 600_000), (20, 40), (5, 600_000)])
def test_random_texts(spark, library, monkeypatch, most):
    monkeypatch.setattr(byte_bpe, "MAX_CHUNKS", most[0])
    monkeypatch.setattr(byte_bpe, "MAX_WORDS", most[1])
    rng = np.random.default_rng(11)
    parts = ["a", "b", "th", "ing", " ", " ", "  ", "\n", "\t", "'s", "1", "²", "!", "é", "\xa0", "\x1c", "日", ".", "Word", "ß", "\x85", "😀", "़"]
    texts = [(i, "".join(rng.choice(parts, rng.integers(0, 40)))) for i in range(1500)]
    rows = byte_bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), FILE, P.PATTERN, decoded=True, block_chars=3000).collect()
    assert {r.doc_id: ids_of(r) for r in rows} == {i: library.encode_ordinary(t) for i, t in texts}
    assert {r.doc_id: bytes(r.decoded).decode() for r in rows} == dict(texts)


def test_every_character_is_cut_as_the_library_cuts(spark, library):
    texts = [(c, f"a{chr(c)}a {chr(c)} 1{chr(c)}") for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    got = byte_bpe.encode(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), FILE, P.PATTERN).collect()
    wrong = [r.doc_id for r in got if ids_of(r) != library.encode_ordinary(texts_of(r.doc_id))]
    assert not wrong, [hex(c) for c in wrong[:50]]


def test_a_word_is_folded_once_for_all_tasks(spark, library):
    texts = [f"zqxwv{i % 60}kjzx qqzzvv wxyzzy{i % 7}ozq and the word {'zxq' * (i % 5 + 1)}" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ranks = Vocabulary.read(FILE).ranks
    single = {r: k[0] for k, r in ranks.items() if len(k) == 1}
    want = {w.encode() for t in texts for w in regex.findall(P.PATTERN, t)} - ranks.keys()
    rows = byte_bpe.distinct_words(byte_bpe.cut_words(docs, FILE, P.PATTERN, 500), FILE).collect()
    assert sorted(bytes(single[i] for i in w) for r in rows for w in r.words) == sorted(want)
    got = byte_bpe.encode(docs, FILE, P.PATTERN, decoded=True, block_chars=500).collect()
    assert {r.doc_id: ids_of(r) for r in got} == {i: library.encode_ordinary(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("most", [(5, 1 << 25, 300_000), (600_000, 100, 300_000), (600_000, 1 << 25, 3)])
def test_files_end_and_chunks_are_forgotten(tmp_path, library, monkeypatch, most):
    monkeypatch.setattr(byte_bpe, "MAX_WORDS", most[0])
    monkeypatch.setattr(byte_bpe, "MAX_FILE", most[1])
    monkeypatch.setattr(byte_bpe, "MAX_CHUNKS", most[2])
    ranks = Vocabulary.read(FILE).ranks
    cutter = byte_bpe._Cutter(P.PATTERN, "", ranks, str(tmp_path))
    blocks = [["zqxwv kjzx the", "", "zqxwv"], ["kjzx zqxwv", "and qqzzvv"], ["the zxqzxq\n"]]
    full = []
    for b in blocks:
        cutter.block(list(range(len(b))), b)
        full.append(cutter.full())
    assert full == [most[0] < 6 and i > 0 or most[1] < 1000 for i in range(3)]
    rows = list(cutter.close())
    parts = [(raw, byte_bpe._numbers(n).tolist()) for _, _, raw, n in rows]
    words = [raw[sum(n[:i]):sum(n[:i + 1])] for raw, n in parts for i in range(len(n))]
    ids = [naive(w, ranks) for w in words]
    groups = np.frombuffer(b"".join(x["groups"] for x in byte_bpe._blocks(rows[0][0], ["groups"])), np.uint8)
    uniter = byte_bpe._Uniter(np.array(sum(ids, []), "<u4"), np.array(list(map(len, ids))), groups)
    got = []
    for row in byte_bpe._blocks(rows[0][0], byte_bpe.BLOCK.names[:7]):
        values, sizes = uniter.documents(row)
        got += [x.tolist() for x in np.split(values, np.cumsum(sizes)[:-1])]
    assert got == [library.encode_ordinary(t) for b in blocks for t in b]


def texts_of(c):
    return f"a{chr(c)}a {chr(c)} 1{chr(c)}"


def naive(word, ranks):
    parts = [bytes([b]) for b in word]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_merges_by_rank_are_single_merges(spark, monkeypatch):
    """Ranks in any order, where a merge can make a pair of a lower rank, in the short and in the long way."""
    rng = np.random.default_rng(2)
    strings = sorted({bytes(rng.choice(list(b"abc"), rng.integers(2, 6)).tolist()) for _ in range(150)})
    rng.shuffle(strings)
    ranks = {bytes([b]): b for b in range(256)} | {s: 256 + i for i, s in enumerate(strings)}
    vocabulary = Vocabulary(ranks)
    assert byte_bpe.lowering(vocabulary.pairs())
    words = [bytes(rng.choice(list(b"abc"), rng.integers(1, 40)).tolist()) for _ in range(600)]
    df = spark.createDataFrame([([list(w) for w in words],)], "words array<array<int>>")
    want = [naive(w, ranks) for w in words]
    for short in (256, 0):
        monkeypatch.setattr(byte_bpe, "SHORT", short)
        assert df.select(byte_bpe.fold(F.col("words"), vocabulary).alias("ids")).first().ids == want


def test_rank_files(tmp_path):
    bad = tmp_path / "x.tiktoken"
    bad.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        Vocabulary.read(str(bad))


def test_decoding_names_unknown_ids(spark):
    one = spark.createDataFrame([(1, bytearray(np.array([60_000], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    with pytest.raises(Exception, match="has not"):
        byte_bpe.decode(one, FILE).collect()
    assert byte_bpe.decode(one.where("doc_id = 2"), FILE).first().decoded is None


def test_query(spark, library):
    got = {r.doc_id: r for r in queries.op12_byte_bpe_fold(spark, "/root/testdata/sf0.001").collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert got.keys() == docs.keys()
    for doc, text in docs.items():
        ids = library.encode_ordinary(text)
        r = got[doc]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
