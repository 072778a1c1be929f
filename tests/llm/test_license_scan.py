import numpy as np
from corpus_fixtures import ODD, SF, frame, odd_frame

from tidepool.llm import license_scan as S
from tidepool.llm import queries as Q
from tidepool.llm.license_templates import TEMPLATES


def brute_align(template, body):
    """Most matched tokens of any alignment on all diagonals, by the same local rule without a band."""
    return S.align(template, body, -len(template), len(body))


def test_exact_notices_have_their_spans():
    index = S.build_index(TEMPLATES)
    for name, notice in TEMPLATES.items():
        text = f"Some words before é. {notice}\nand some words after it"
        found = S.matches(text, index)
        assert [(m[0], m[4]) for m in found] == [(name, 1.0)]
        start, end = found[0][1:3]
        assert S.tokens(text[start:end]) == S.tokens(notice)


def test_edited_notice_is_found():
    words = TEMPLATES["mit"].split(" ")
    edited = words[:20] + ["really", "truly"] + words[20:60] + words[64:120] + ["CHANGED"] + words[121:]
    text = "x " * 50 + " ".join(edited) + " y" * 50
    found = S.matches(text, S.build_index(TEMPLATES))
    assert [m[0] for m in found] == ["mit"] and 0.9 < found[0][4] < 1
    assert text[found[0][1] : found[0][2]].startswith("Permission is hereby") and text[found[0][1] : found[0][2]].endswith("SOFTWARE")


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(200):
        codes = rng.integers(0, 50, size=rng.integers(1, 40)).astype(np.uint64)
        picked = set(S.winnow(codes, 3))
        assert all(picked & set(range(i, min(i + 3, len(codes)))) for i in range(max(1, len(codes) - 2)))


def test_query_matches_unbanded_alignment(spark):
    """Every template against every text that has any of its words, without index and band."""
    index = S.build_index(TEMPLATES)
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for line in (r["text"] or "").split("\n"):
            body = np.array([index.vocabulary.get(w, 0) for w in S.tokens(line)], dtype=np.int64)
            if np.count_nonzero(body) < 4:
                continue
            best = []
            for t, name in enumerate(index.names):
                if np.isin(body, index.ids[t]).sum() >= S.MIN_COVERAGE * index.lengths[t]:
                    m, first, last = brute_align(index.ids[t], body)
                    if m >= S.MIN_COVERAGE * index.lengths[t] and last - first < 2 * index.lengths[t]:
                        best.append((m, name))
            if best:
                want.add((r["doc_id"], max(best)[1]))
    got = {(r["doc_id"], r["template"]) for r in Q.op6_license_scan(spark, SF).collect()}
    assert got == want and got


def test_odd_rows(spark):
    rows = [*ODD, (60, "Released under the MIT License."), (60, "Released under the MIT License."), (61, "İ Released under the MIT License. " * 500)]
    out = S.scan(odd_frame(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in out) == [60, 60] + [61] * 500
    assert S.scan(frame(spark, [])).count() == 0
    assert S.scan(frame(spark, rows), templates={"own": "one two three four"}).where("doc_id in (1, 5)").count() == 3


def test_long_insertions_and_cuts():
    """10 to 30 tokens put in or taken out mid-way, against the alignment without a band."""
    index = S.build_index(TEMPLATES)
    seen = 0
    for t, name in enumerate(index.names):
        words = S.tokens(TEMPLATES[name])
        if len(words) < 50:
            continue
        half = len(words) // 2
        for n in (10, 12, 17, 20, 30):
            for edited in (words[:half] + [f"new{i}" for i in range(n)] + words[half:], words[: half - n // 2] + words[half + n - n // 2 :]):
                m, first, last = brute_align(index.ids[t], np.array([index.vocabulary.get(w, 0) for w in edited], dtype=np.int64))
                if m < S.MIN_COVERAGE * len(words):
                    continue
                found = S.matches("before " * 40 + " ".join(edited) + " after" * 40, index)
                assert [(f[0], f[3]) for f in found] == [(name, m)], (name, n, found)
                assert found[0][2] - found[0][1] == len(" ".join(edited))
                seen += 1
    assert seen > 20


def test_notice_in_a_gap_is_found_too():
    words = S.tokens(TEMPLATES["mit"])
    text = " ".join(words[:80]) + " x x x x x x x x " + TEMPLATES["bsd-2-clause"] + " y y y y y y y y " + " ".join(words[80:])
    found = S.matches(text, S.build_index(TEMPLATES))
    assert {f[0] for f in found} == {"mit", "bsd-2-clause"}
