"""Byte-level BPE by the transducer against the public library, and streams of ids against whole decoding."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex

from reviewlake.llm import bpe_transducer
from reviewlake.llm.bpe_transducer import Encoder, Stream, Tokens, Transducer, decode, encode, encoded_digests, read_ranks

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", None, " ", "  \n\n  x", "it's I'll 'S don't", "a" * 3000, "日本語テキスト。 emoji 👩‍👩‍👧 \x00\x85  end", "<|endoftext|> 123456 ½²٣", "\n" * 500 + "z", "é" * 700, " \t" * 400, "x" * 50 + " " * 50 + "y!?" * 40]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_documents_as_the_library_does(spark, library):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(10**6 + k if k else None, t) for k, t in enumerate([*ODD, "twice", "twice"])], "doc_id long, text string")
    docs = given.unionByName(odd).selectExpr("*", "'clash' AS ids", "1 AS decoded", "2 AS id")
    got = sorted(map(tuple, encoded_digests(docs, PATH, PATTERN).collect()), key=repr)
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    assert encoded_digests(docs.limit(0), PATH, PATTERN).collect() == []


def test_random_bytes_and_full_tables(library, monkeypatch):
    monkeypatch.setattr(bpe_transducer, "STATES", 50)
    monkeypatch.setattr(bpe_transducer, "PAIRS", 50)
    t, some = Transducer(read_ranks(PATH)), random.Random(3)
    for _ in range(1500):
        piece = bytes(some.choice(b"etaoin shrdlu\xc3\xa9\xe6\x97\xa5\x80\n") for _ in range(some.randrange(60)))
        assert t.encode(piece) == tuple(library._core_bpe.encode_single_piece(piece) if piece else ())


def test_small_vocabularies_by_plain_merging():
    """Random ranks, also ones where a token isn't what its bytes merge to."""
    some = random.Random(4)
    for _ in range(60):
        ranks = {bytes([b]): k for k, b in enumerate(b"abc")}
        while len(ranks) < 14:
            a, b = some.choice(list(ranks)), some.choice(list(ranks))
            ranks.setdefault(a + b, len(ranks))
        t = Transducer(ranks)
        for _ in range(60):
            piece = bytes(some.choice(b"abc") for _ in range(some.randrange(1, 14)))
            parts = [piece[k : k + 1] for k in range(len(piece))]
            while len(parts) > 1:
                rank, k = min((ranks.get(parts[k] + parts[k + 1], 99), k) for k in range(len(parts) - 1))
                if rank == 99:
                    break
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert t.encode(piece) == ((ranks[piece],) if piece in ranks else tuple(ranks[p] for p in parts))


def test_both_patterns_cut_alike():
    e, some = Encoder(PATH, PATTERN), random.Random(8)
    for c in map(chr, range(256)):
        for text in (c, f"a{c}", f" {c}1", f"{c}{c} x", f"é {c}\n", f"'{c}"):
            assert e.western.findall(text) == e.pattern.findall(text), repr(text)
    for _ in range(2000):
        text = "".join(chr(some.randrange(256)) if some.random() < 0.5 else some.choice(" \n'stab1²é.") for _ in range(30))
        assert e.western.findall(text) == e.pattern.findall(text)


def test_lookahead_is_bounded():
    t = Transducer(read_ranks(PATH))
    t.encode(b"internationalisation" * 200)
    assert max(len(ids) for _, _, ids in t.states) <= 66


def test_long_texts_are_cut_where_no_piece_goes_on(monkeypatch, library):
    monkeypatch.setattr(bpe_transducer, "AT_ONCE", 7)
    monkeypatch.setattr(bpe_transducer, "PIECES", 5)
    e, whole = Encoder(PATH, PATTERN), library
    assert [x.tolist() for x in e.ids(ODD)] == [whole.encode_ordinary(t or "") for t in ODD]
    for text in filter(None, ODD):
        assert [p for part in e.cuts(text) for p in e.pattern.findall(part)] == regex.findall(PATTERN, text)


def test_streams_hold_back_open_characters():
    tokens, some = Tokens(read_ranks(PATH)), random.Random(5)
    for _ in range(300):
        ids = np.array([some.randrange(256) if some.random() < 0.6 else some.randrange(50_000) for _ in range(some.randrange(40))], np.int64)
        whole = tokens.bytes_of(ids).decode("utf-8", "replace")
        stream, out, at = Stream(tokens), "", 0
        while at < len(ids):
            n = some.randrange(1, 6)
            out += stream.push(ids[at : at + n])
            at += n
            ended = tokens.bytes_of(ids[:at])
            assert out == ended[: len(ended) - len(stream.held)].decode("utf-8", "replace")
        assert out + stream.close() == whole
    with pytest.raises(ValueError):
        Stream(tokens).push(np.array([10**6]))


def test_encode_and_decode_are_a_round_trip(spark):
    texts = [t or "" for t in ODD]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    back = decode(encode(docs, PATH, PATTERN), PATH).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == dict(enumerate(texts))
    nulls = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode(nulls, PATH).first()["decoded"] == ""
