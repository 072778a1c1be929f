import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus_fixtures import ODD, SF, frame, odd_frame
from tokenizers import Tokenizer

from tidepool.llm import packing as P
from tidepool.llm import queries as Q

EDGES = ["", " ", "\n", "a", " a", "a ", "a\n", "\na", "a  b", "a \nb", "a\n b", "\t\ta b", "\ta", "don't we'll 're", "x y  z", "a  b", "é漢字 \U0001f600\n1,234.5", "<|endoftext|> a", "a\r\nb c", "  lead", "trail  ", "w " * 300]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(Q.BYTE_BPE)
    t.encode_special_tokens = True
    return t


def test_cached_ids_equal_whole_text_ids(spark, tokenizer):
    texts = EDGES + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"]]
    for cache in (P.CACHE, 50):
        encoder = P.ByteBpeEncoder(Q.BYTE_BPE, cache)
        got = [x for a in range(0, len(texts), 20) for x in encoder.encode(pa.array(texts[a : a + 20]))]
        assert [x.tolist() for x in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_random_white_space(tokenizer):
    rng = np.random.default_rng(4)
    letters = ["a", "b", " ", "\n", "\t", ".", "'s", "é", "1", "漢", "*", "\xa0", " The", "x,", "\r", "\u3000", "\x1c", "|", "%%"]
    texts = ["".join(rng.choice(letters, size=rng.integers(0, 25))) for _ in range(4000)]
    encoder = P.ByteBpeEncoder(Q.BYTE_BPE, 200)
    got = [x.tolist() for a in range(0, len(texts), 50) for x in encoder.encode(pa.array(texts[a : a + 50]))]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def cut(ids, capacity=2048):
    ids = [*ids, 0]
    first = len(ids) % capacity or capacity if len(ids) > capacity else len(ids)
    return [(0, ids[:first])] + [(a, ids[a : a + capacity]) for a in range(first, len(ids), capacity)]


def check_places(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_pieces(spark, tokenizer):
    rows = Q.op10_best_fit_packing(spark, SF).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = Counter((i, n, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in texts.items() for n, (start, ids) in enumerate(cut(tokenizer.encode(t or "", add_special_tokens=False).ids)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    n = check_places(rows, 2048)
    assert n <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def first_fit_decreasing(lengths, capacity):
    bins = []
    for s in sorted(lengths, reverse=True):
        fit = [i for i, g in enumerate(bins) if g >= s]
        if fit:
            bins[min(fit, key=lambda i: bins[i])] -= s
        else:
            bins.append(capacity - s)
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.choice([7, 30, 100, 2048]))
    lengths = rng.integers(1, capacity + 1, size=rng.integers(1, 800))
    if seed % 3 == 0:
        lengths = np.minimum(capacity, rng.geometric(5 / capacity, size=600))
    if seed % 4 == 0:
        lengths = np.concatenate([lengths, np.full(500, capacity // 2 + 1), np.full(333, max(1, capacity // 5))])
    classes = P.plan(dict(Counter(lengths.tolist())), capacity)
    assert Counter(lengths.tolist()) == sum((Counter({s: count * each}) for count, layout in classes for s, each, _ in layout), Counter())
    for _, layout in classes:
        at = 0
        for s, each, offset in layout:
            assert offset == at
            at += s * each
        assert at <= capacity
        assert sum(each for s, each, _ in layout if 3 * s > capacity) <= 2
    n, best = sum(c for c, _ in classes), first_fit_decreasing(lengths.tolist(), capacity)
    assert n <= 1.05 * best + 1


def test_plan_size_depends_on_capacity_only():
    rng = np.random.default_rng(0)
    small = {int(s): int(n) for s, n in zip(range(1, 2049), rng.integers(1, 50, 2048), strict=True)}
    large = {s: n * 10**9 + s for s, n in small.items()}
    for counts in (small, large):
        classes = P.plan(counts)
        assert len(classes) < 3 * 2048 and sum(len(layout) for _, layout in classes) < 20 * 2048
        assert sum(s * n for s, n in counts.items()) / 2048 <= sum(c for c, _ in classes) <= 1.02 * sum(s * n for s, n in counts.items()) / 2048 + 2


def test_odd_rows_and_round_trip(spark, tokenizer):
    rows = [*ODD, (80, "tick " * 5000)]
    docs = odd_frame(spark, rows)
    pieces = P.token_pieces(docs, Q.BYTE_BPE, capacity=64)
    placed = P.pack(pieces.select("doc_id", "piece", "length"), 64)
    check_places(placed.collect(), 64)
    assert placed.count() == sum(len(cut(tokenizer.encode(t or "", add_special_tokens=False).ids, 64)) for _, t in rows)
    unique = frame(spark, [(i, t) for i, t in rows if i in (1, 2, 3, 4, 7, 8, -9, 80)])
    pieces = P.token_pieces(unique, Q.BYTE_BPE, capacity=64)
    placed = P.pack(pieces.select("doc_id", "piece", "length"), 64)
    tokens = {r["sequence_id"]: r["tokens"] for r in P.sequences(pieces, placed).collect()}
    back = {}
    for r in sorted(placed.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        back.setdefault(r["doc_id"], []).extend(tokens[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]])
    assert {i: tokenizer.decode(x[:-1]) for i, x in back.items()} == {r["doc_id"]: r["text"] or "" for r in unique.collect()}
    assert P.pack_documents(frame(spark, []), Q.BYTE_BPE).count() == 0
