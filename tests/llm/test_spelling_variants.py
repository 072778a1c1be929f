"""Spelling variants against a comparison of all words, written on its own from the rules."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus_fixtures import ODD, SF, frame, odd_frame

from tidepool.llm import common, queries
from tidepool.llm import spelling_variants as V

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def count(rows, plant=None, least=6):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if plant:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % plant == 0:
                    k = h % len(run)
                    run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                found[run] += 1
    return found


def near(a, b):
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, least=5, ratio=5):
    words = {w: n for w, n in counts.items() if n >= least}
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w, n in words.items():
        own = [v for k in (-1, 0, 1) for v in by_size.get(len(w) + k, ()) if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = [n, len(own), words[form[w]] if form[w] else None]
    def root(w):
        return root(form[w]) if form[w] else w
    return sorted((w, form[w], root(w), *rest) for w, rest in out.items())


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_random_words_against_all_comparisons(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abéÿ") for _ in range(rng.randint(6, 8))) for _ in range(500)} | {"a" * k for k in range(6, 12)} | {"aaaabbaaaa", "aaaabaaaa", "aaabbaaaa"}
    text = [(i, " ".join([w.upper() if i % 3 == 0 else w] * rng.choice([1, 4, 5, 6, 30, 31, 200]))) for i, w in enumerate(sorted(words))]
    want = brute(count(text))
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] != w[2] and w[1] for w in want)
    assert got(V.spelling_variants(frame(spark, text))) == want


def test_query_over_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(count(rows, plant=199))
    assert len(want) > 500
    assert got(queries.op13_spelling_variants(spark, SF)) == want


@pytest.mark.parametrize("plant", [None, 3])
def test_odd_rows(spark, plant):
    rows = [*ODD, (20, "Colour COLOUR colour, colour-colour; colour" * 20), (21, "color's À×÷ÿÃ£ " * 9), (22, "color colors " * 200), (None, "color ĀcolorĀ " * 6), (23, "x" * 5000 + " " + ("y" * 3000 + " ") * 6)]
    assert got(V.spelling_variants(odd_frame(spark, rows), letters=5, plant=plant)) == brute(count(rows, plant, 5))
    assert got(V.spelling_variants(frame(spark, []))) == []


def test_tries_number_each_node_once(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(800)})
    df = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i long").repartition(7)
    found = {r["w"]: r for r in V.number_trie(df, "w", ["i"]).collect()}
    assert all(found[w]["rank"] == found[w]["i"] for w in words)
    nodes = {}
    for w in words:
        assert len(found[w]["nodes"]) == len(w) + 1
        for k, x in enumerate(found[w]["nodes"]):
            assert nodes.setdefault(w[:k], x) == x
    assert sorted(nodes.values()) == list(range(len(nodes)))


def test_chains_beyond_one_step(spark):
    words = [("aaaaaa" + "b" * k, 5 ** (k + 1)) for k in range(26)]
    found = {r["word"]: r for r in V.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert all(r["root"] == words[-1][0] for r in found.values()) and found["aaaaaa"]["form"] == "aaaaaab"


def test_checksums_are_those_of_whole_strings():
    words, ids = [b"a", b"colour", "été".encode(), b"z" * 70, b"y" * 64, b"y" * 65], ["", "7", "-123456789"]
    pairs = [(d, w) for d in range(len(ids)) for w in range(len(words))]
    found = V.planted(words, np.array([w for _, w in pairs]), ids, np.array([d for d, _ in pairs]), 1)
    assert found == {i: zlib.crc32(f"{ids[d]}:".encode() + words[w]) for i, (d, w) in enumerate(pairs)}


def test_runs_end_with_their_text():
    texts = pa.array(["", "ab", "cd ef", "Ã£Āéx", "", "\U0001f600gh"])
    runs, doc, starts, ends, raw = common.byte_runs(texts.slice(1), V.letters)
    assert [r.decode() for r in runs.to_pylist()] == ["ab", "cd", "ef", "Ã", "éx", "gh"] and doc.tolist() == [0, 1, 1, 2, 2, 4]
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends, strict=True)] == [r.decode() for r in runs.to_pylist()]
    assert len(common.byte_runs(pa.array([], pa.string()), V.letters)[0]) == 0
