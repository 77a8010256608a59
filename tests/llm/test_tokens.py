"""Byte-level BPE and token files against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lumenfold.llm import byte_bpe, common, token_files

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " ", "  ", "a", "a b", "a  b", "a   b ", "\n\n x", "don't we'll 's''s !!'s 'll'll x's're'", "a \n b", "\t'tx", "12 34a5", "　　字 字", "é'd 😀👍🏽'm", "x" * 3000, "ab" * 900 + " " * 90, "<|endoftext|> a", "one two\nThree, four. five"]


def noise(n=600):
    pick = random.Random(5)
    return ["".join(pick.choice("ab's tmdrevl!  \n\t1é 字.,") for _ in range(pick.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    path = common.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    return path, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})


def test_encoding_equals_the_library(library):
    path, lib = library
    code = byte_bpe.coder(path)
    texts = [t or "" for t in TEXTS] + noise()
    for lot in byte_bpe.groups(texts, 500):
        for t, (at, ids) in zip(lot, code.encode(lot)):
            joined = ",".join(ids)
            assert joined == ",".join(map(str, lib.encode_ordinary(t))), repr(t)
            assert code.decode(joined) == t.encode()
            assert at == sorted(at) and (not t or at[0] == 0)


def test_lanes_without_resets_carry_all_states():
    text = "a" * 700 + "1" * 300 + "b"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    first[0] = True
    assert np.flatnonzero(byte_bpe.starts(points, first)).tolist() == [0, 700, 1000]


def test_long_and_short_merging_agree(library):
    code = byte_bpe.coder(library[0])
    for t in ("unbelievable", "ciónciónmente", "aaaaaaaaaaaaaaaaaaaaaa"):
        assert code.merge_short(t.encode()) == code.merge_long(t.encode())


def test_columns(spark, library):
    path, lib = library
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(1, "")], "doc_id long, text string")
    got = byte_bpe.digests(df, path, ["doc_id"]).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        ids = lib.encode_ordinary(TEXTS[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    full = byte_bpe.encode_column(df, path, ["doc_id"])
    back = byte_bpe.decode_column(full, path, ["doc_id"]).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert all(sum(r["piece_ids"]) == r["n_tokens"] == len(r["ids"]) and len(r["offsets"]) == len(r["piece_ids"]) for r in full.collect())
    assert byte_bpe.digests(df.limit(0), path, ["doc_id"]).count() == 0


@pytest.fixture(scope="module")
def untouched():
    """The library's own tokenizer, as it is loaded."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(common.tokenizer_path("byte_bpe_50k.json"))
    return lambda t: np.array(lib.encode(t, add_special_tokens=False).ids, np.uint16).tobytes()


def test_chunks_equal_whole_texts(untouched):
    enc = token_files.ChunkEncoder(common.tokenizer_path("byte_bpe_50k.json"))
    marks = ["<|endoftext|>", "a <|endoftext|>b", " <|endoftext|> ", "<|endoftext|", "x<|endoftext|><|endoftext|>"]
    texts = [t or "" for t in TEXTS] + noise() + marks
    assert untouched("<|endoftext|> a")[:2] == np.uint16(50256).tobytes()
    for t in texts:
        assert enc.encode(t) == untouched(t), repr(t)
    enc.chunks.most = enc.pieces.most = 3  # generations turn over
    for t in texts:
        assert enc.encode(t) == untouched(t), repr(t)
    long = " ".join(noise(400)).replace("  ", " ") * 60
    assert len(long) > 500_000 and enc.encode(long) == untouched(long)


def test_pieces_are_cut_as_the_library_cuts(untouched):
    enc = token_files.ChunkEncoder(common.tokenizer_path("byte_bpe_50k.json"))
    for c in map(chr, [*range(0x250), *range(0x2000, 0x2070), 0x300, 0x3B1, 0x416, 0x661, 0x2167, 0x3000, 0x5B57, 0x1F600]):
        for t in (f"a {c}b", f"x a{c}b1{c}. {c}", f"q {c}{c}'s", f"1 2{c}{c} 3"):
            assert enc.encode(t) == untouched(t), (repr(t), hex(ord(c)))


def test_groups_equal_whole_texts(untouched):
    import pyarrow as pa

    enc = token_files.ChunkEncoder(common.tokenizer_path("byte_bpe_50k.json"))
    pick = random.Random(6)
    mixed = ["".join(pick.choice("abcdzABZ''sstlé\xdfÀ\xd7\xf7\xa0\u3000\u2026\x01\x1c\x85  \n\n\t.,!(1字") for _ in range(pick.randint(0, 40))) for _ in range(4000)]
    plain = ["".join(pick.choice("ab'sté\xd7 \n.,1") for _ in range(pick.randint(0, 9))) for _ in range(4000)]
    texts = TEXTS + mixed + plain + noise() + ["a <|endoftext|>b", None, "\n", "x\n", "\ny", "x.\ny", "x\n y", "x \ny", "don't.\nWe'll,'s"]
    want = [untouched(t or "") + b"\2\0" for t in texts]
    for most in (enc.chunks.most, 3):
        enc.chunks.most = enc.pieces.most = most
        assert enc.encode_all(pa.array(texts), b"\2\0").to_pylist() == want
        assert enc.encode_all(pa.array(texts).slice(7, 900), b"\2\0").to_pylist() == want[7:907]
    enc.plain = False
    assert enc.encode_all(pa.array(texts[:50]), b"\2\0").to_pylist() == want[:50]


def test_distinct_chunks_are_looked_up_once(untouched):
    class Counted(common.Memo):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    enc = token_files.ChunkEncoder(common.tokenizer_path("byte_bpe_50k.json"))
    enc.chunks = Counted(enc.chunks.function, enc.chunks.most, enc.chunks.longest)
    text = "Some words, and some\nmore words. " * 400 + "end"
    for _ in range(2):
        Counted.asked = 0
        assert enc.encode(text) == untouched(text)
        assert 0 < Counted.asked <= 12


def test_length_limited_codes():
    counts = np.zeros(1000, np.int64)
    counts[:40] = [2**min(k, 40) for k in range(40)]
    lengths = token_files.code_lengths(counts, 12)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= 12 and (2.0**-used).sum() <= 1 and (lengths[40:] == 0).all()
    assert (2.0**-used).sum() == 1  # complete
    one = np.zeros(9, np.int64)
    one[4] = 7
    assert token_files.code_lengths(one).tolist() == [0, 0, 0, 0, 1, 0, 0, 0, 0]
    import heapq

    skew = np.array([45, 13, 12, 16, 9, 5])
    heap = list(skew)
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        best += x
        heapq.heappush(heap, x)
    assert int((token_files.code_lengths(skew, 18) * skew).sum()) == best


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 5000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(1, 60000).astype(np.int64) - 1
    lengths = token_files.code_lengths(np.bincount(ids, minlength=1 << 16))
    stream, checks = token_files.pack(ids, lengths, token_files.canonical(lengths))
    assert (token_files.unpack(stream, checks, n, token_files.decode_table(lengths)) == ids).all()


def test_files(spark, untouched):
    path = common.tokenizer_path("byte_bpe_50k.json")
    rows = [(11, "<|endoftext|> a"), (7, "b a"), (3, None), (9, "x" * 500), (3, "again"), (None, "no id")] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tokens = common.spool(token_files.tokenize(docs, path), "tokens")
    lengths = token_files.code_lengths(token_files.id_counts(tokens, 1 << 16))
    index = token_files.write_files(tokens, common.shared_dir(spark, "files"), lengths)
    got = sorted(token_files.read_files(spark, index, lengths).collect(), key=lambda r: r["start"])
    at = 0
    known = sorted((d is not None, d or 0) for d, _ in rows)
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == known
    want = {}
    for d, t in rows:
        want.setdefault(d, []).append(np.append(np.frombuffer(untouched(t or ""), np.uint16), 2).astype("<u4").tobytes())
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        match = next(x for x in want[r["doc_id"]] if zlib.crc32(x) == r["ids_crc32"])
        want[r["doc_id"]].remove(match)
        assert len(match) == 4 * r["n_tokens"]
    none = common.spool(token_files.tokenize(docs.limit(0), path), "tokens")
    empty = token_files.write_files(none, common.shared_dir(spark, "files"), token_files.code_lengths(token_files.id_counts(none, 1 << 16)))
    assert token_files.read_files(spark, empty, lengths).count() == 0
