import itertools

import numpy as np
import pytest
import xxhash
from corpus_fixtures import ODD, SF, frame, odd_frame

from tidepool.llm import queries as Q
from tidepool.llm import simhash_dedup as H


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(rows):
    """(id, fingerprint, component id) by comparing all pairs."""
    fps = [brute_fingerprint(t) for _, t in rows]
    return brute_components([i for i, _ in rows], fps)


def brute_components(ids, fps):
    group = list(range(len(fps)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            group[root(i)] = root(j)
    least = {}
    for i in range(len(fps)):
        if ids[i] is not None:
            least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return sorted(((ids[i], f"{fps[i]:016x}", least.get(root(i))) for i in range(len(fps))), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover_every_pair_within_radius(radius):
    rng = np.random.default_rng(radius)
    for positions in (list(range(64)), [3, 5, 8, 9, 20, 33, 34, 40, 41, 50, 60, 61, 62, 63], [7, 9]):
        masks = H.covering_masks(positions, radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        flips = [c for k in range(1, radius + 1) for c in itertools.combinations(positions, k)]
        for c in flips if len(flips) < 4000 else [flips[i] for i in rng.integers(0, len(flips), 4000)]:
            diff = sum(1 << p for p in c)
            assert any(not diff & m for m in masks)


def test_odd_rows(spark):
    rows = [*ODD, (40, "A b C"), (41, "a B c"), (42, "a b"), (43, "É b")]
    assert result(H.near_dedup(odd_frame(spark, rows))) == brute(rows)
    assert H.near_dedup(frame(spark, [])).count() == 0


def test_query_matches_all_pairs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert result(Q.op9_simhash_dedup(spark, SF)) == brute(rows)


@pytest.mark.parametrize("hot", [4096, 5])
def test_dense_groups_and_chains(spark, hot):
    """Fingerprints within and just beyond the radius, in crowded buckets; hot = 5 splits them."""
    rng = np.random.default_rng(2)
    fps, center = [], int(rng.integers(0, 1 << 62))
    for _ in range(150):
        fps.append(center ^ sum(1 << int(b) for b in rng.choice(64, size=rng.integers(0, 4), replace=False)))
    x = 0xDEADBEEF12345678
    for b in range(0, 64, 3):  # a chain whose ends are far apart
        fps.append(x)
        x ^= 7 << b if b < 62 else 1 << 63
    for _ in range(100):
        fps.append(int(rng.integers(0, 1 << 63)) << 1 | 1)
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(H.signed(f),) for f in fps], "fp long")
    roots = {r["u"] & (1 << 64) - 1: r["v"] & (1 << 64) - 1 for r in H.star_components(H.edges(nodes, hot=hot)).collect()}
    want = {int(f, 16): c for _, f, c in brute_components(list(range(len(fps))), fps)}
    sets = {}
    for f in fps:
        sets.setdefault(roots.get(f, f), set()).add(f)
    expect = {}
    for f, c in want.items():
        expect.setdefault(c, set()).add(f)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, expect.values()))


def test_deduplicate(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base + " tail"), (9, base.upper()), (3, base + " tail"), (7, "other text here entirely"), (8, None), (6, "")]
    out = H.deduplicate(odd_frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted({c for _, _, c in brute(rows)})


def test_near_copies_by_component(spark):
    """Recall of near copies by component_id, as the contract's three bits allow: one word of 1,000 replaced 0.93, of 200 about 0.5; other texts stay alone."""
    import random

    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, pairs = [], {1000: [], 200: []}
    for n in pairs:
        for _ in range(100):
            words = [rng.choice(vocabulary) for _ in range(n)]
            edited = list(words)
            edited[rng.randrange(n)] = rng.choice(vocabulary)
            pairs[n].append((len(rows), len(rows) + 1))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited))]
    component = {r["doc_id"]: r["component_id"] for r in H.near_dedup(frame(spark, rows)).collect()}
    recall = {n: sum(component[a] == component[b] for a, b in own) / 100 for n, own in pairs.items()}
    assert recall[1000] > 0.85 and recall[200] > 0.35
    assert all(component[a] == a for own in pairs.values() for a, _ in own)
