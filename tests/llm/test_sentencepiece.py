import struct
import zlib

import numpy as np
import pytest
import sentencepiece
from corpus_fixtures import ODD, SF, odd_frame

from tidepool.llm import queries as Q
from tidepool.llm import sentencepiece_codec as S

EDGES = ["", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "a \n b", "\n", "\n\n x", "\tx\t", "é漢字\U0001f600", "x" * 500, "▁", "a▁b", "▁▁", "<0x41>", "<s> </s> <unk>", " x", "a\r\nb", "don't  stop   now"]


@pytest.fixture(scope="module")
def pair():
    return S.SentencePieceCodec(Q.SENTENCEPIECE), sentencepiece.SentencePieceProcessor(model_file=Q.SENTENCEPIECE)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_edges_match_reference(pair):
    codec, reference = pair
    got, agree = codec.encode(EDGES)
    for text, raw in zip(EDGES, got, strict=True):
        assert ids(raw) == reference.encode(text), repr(text)
        assert codec.decode(raw) == reference.decode(reference.encode(text)), repr(text)
    assert all(agree)


def test_whole_texts_match_reference(spark, pair):
    codec, reference = pair
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() if r["text"]]
    got, agree = codec.encode(texts)
    assert [ids(x) for x in got] == reference.encode(texts)
    assert all(agree)
    assert [codec.decode(x) for x in got] == texts


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _bytes(number, value):
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _int(number, value):
    return _varint(number << 3) + _varint(value)


def unigram_model(byte_fallback: bool) -> bytes:
    """A small unigram model file, written field by field."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, s, 1) for p, s in (("▁", -3.0), ("a", -4.1), ("b", -4.3), ("c", -4.7), ("ab", -5.0), ("▁a", -4.9), ("▁ab", -6.5), ("bc", -5.7), ("abc", -7.9), ("▁c", -5.25))]
    body = b"".join(_bytes(1, _bytes(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _int(3, k)) for p, s, k in pieces)
    trainer = _int(3, 1) + _int(4, len(pieces)) + _int(35, int(byte_fallback)) + _int(40, 0) + _int(41, 1) + _int(42, 2)
    return body + _bytes(2, trainer) + _bytes(3, _bytes(1, b"identity") + _int(3, 1) + _int(4, 1) + _int(5, 1))


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_scores_match_reference(byte_fallback):
    raw = unigram_model(byte_fallback)
    codec, reference = S.SentencePieceCodec(raw=raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    rng = np.random.default_rng(5)
    texts = ["abc", "a b c", " ab  c ", "abab cc bca", "xyz ab", "", "   "] + ["".join(rng.choice(list("abc  d"), size=rng.integers(1, 40))) for _ in range(200)]
    got, agree = codec.encode(texts)
    assert [ids(x) for x in got] == reference.encode(texts)
    assert all(agree)


def test_merges_are_pairs_of_pieces(pair):
    model = pair[0].model
    live = {p for p, _, _ in model.pieces}
    assert model.model_type == S.BPE and model.byte_fallback and len(model.pieces) == 32000
    assert all(a in live and b in live and a + b in live for a, b in S.merges(model)[:2000])


def test_nothing_compared_is_null(pair):
    codec = S.SentencePieceCodec(Q.SENTENCEPIECE, verify=False)
    assert codec.encode(["a b", ""]) == (pair[0].encode(["a b", ""])[0], [None, None])


def test_parity_sees_whole_texts(pair):
    """A normaliser that does not do what the reference does shows, although every part would agree."""
    codec = S.SentencePieceCodec(Q.SENTENCEPIECE)
    codec.normalise, codec.identity = lambda t: S.MARK + t.lower().replace(" ", S.MARK), False
    assert codec.encode(["all lower", "Not lower"])[1] == [True, False]


def test_small_cache_gives_the_same(pair):
    codec = S.SentencePieceCodec(Q.SENTENCEPIECE, cache=3)
    texts = [f"word{i % 7} again{i % 5} x{i}" for i in range(60)]
    for a in range(0, 60, 4):
        assert codec.encode(texts[a : a + 4]) == pair[0].encode(texts[a : a + 4])
    assert len(codec.cache) < 30


def test_query_and_odd_rows(spark, pair):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = Q.op2_sentencepiece(spark, SF).collect()
    want = {i: (len(e := pair[1].encode(t)), zlib.crc32(np.array(e, "<u4").tobytes()), True, True) for i, t in rows.items()}
    assert len(out) == len(rows) and {r["doc_id"]: (r["n_tokens"], r["ids_crc32"], r["parity"], r["round_trip"]) for r in out} == want
    odd = S.round_trip(odd_frame(spark, ODD), Q.SENTENCEPIECE, ["doc_id", "ids"]).collect()
    assert len(odd) == len(ODD) and all(r["parity"] and r["round_trip"] for r in odd)
    coded = S.encode(odd_frame(spark, ODD), Q.SENTENCEPIECE, ["doc_id", "text"])
    back = S.decode(coded, Q.SENTENCEPIECE, ["doc_id", "text"]).collect()
    assert len(back) == len(ODD) and all(r["decoded"] == (r["text"] or "") for r in back)
    assert S.encode(odd_frame(spark, []), Q.SENTENCEPIECE, ["doc_id"]).count() == 0
