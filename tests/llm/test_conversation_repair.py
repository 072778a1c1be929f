"""Repair against a search over all edits, written on its own from the rules."""

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import pytest
from corpus_fixtures import SF
from pyspark.sql import types as T

from tidepool.llm import conversation_repair as R
from tidepool.llm import queries

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def sorted_rows(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
    return sorted(rows, key=key)


def damage(rows):
    out = []
    for c, t, role, text in rows:
        sp = lambda x: " " if x is None else str(x)
        case = zlib.crc32(f"{sp(c)}:{sp(t)}".encode()) % 20
        role, text = sp(role), sp(text)
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(c, t, role, text)] * (2 if case == 3 else 1)
    return out


def brute(rows):
    """One conversation's report by trying every edit, in the least (cost, audit)."""
    rows = sorted_rows(rows)
    turns = {t for _, t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, faults = set(), []
    for _, _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))

    @lru_cache(None)
    def best(i, done, inserted):
        """Least (cost, audit, repaired) of rows i.. after the role initials ``done`` (only what decides what may follow)."""
        options = []
        if i == len(rows):
            if done in ("", "a"):
                options.append((0, "", ()))
        else:
            role, text = rows[i][2], rows[i][3]
            c, a, r = best(i + 1, done, 0)
            options.append((c + 4, "D" + a, r))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 if faults[i] == "truncated" else 0
                for new, price, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if allowed(done, new[:1]):
                        c, a, r = best(i + 1, new[:1], 0)
                        options.append((c + price + extra, edit + a, ((new, text), *r)))
        if inserted < 3:
            for new in ("user", "assistant"):
                if allowed(done, new[0]):
                    c, a, r = best(i, new[0], inserted + 1)
                    options.append((c + 3, "I" + a, ((new, ""), *r)))
        return min(options) if options else (10**9, "", ())

    def allowed(done, new):
        return (done, new) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u"))

    cost, audit, repaired = best(0, "", 0)
    sha = hashlib.sha256("\n".join(f"{role}:{text}" for role, text in repaired).encode()).hexdigest()
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha), repaired


def want(rows, ids=None):
    by = {c: [] for c in ids or ()}
    for r in rows:
        by.setdefault(r[0], []).append((r[0], r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]))
    return sorted(((c, *brute(own)[0]) for c, own in by.items()), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def random_rows(n, seed):
    import random

    rng = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", None], ["Yes.", "No", "", " \n", "What? \t", "a b!", "same.", None, "Long text without end", "é ü ß."]
    rows = []
    for c in range(n):
        for t in range(rng.randint(0, 7)):
            turn = rng.choice([t, t, t, t + 1, None, -t])
            rows += [(c, turn, rng.choice(roles), rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    return rows


def test_random_conversations_against_search(spark):
    rows = random_rows(300, 7)
    assert got(R.digest(spark.createDataFrame(rows, SCHEMA))) == want(rows)


def test_repaired_rows(spark):
    rows = random_rows(60, 3)
    found = {}
    for r in R.repair(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault(r["conv_id"], []).append((r["nth"], r["role"], r["text"]))
    for c in {r[0] for r in rows}:
        own = [(c, t, " " if role is None else role, " " if text is None else text) for i, t, role, text in rows if i == c]
        repaired = brute(own)[1]
        assert [(role, text) for _, role, text in sorted(found.get(c, []))] == list(repaired)
        assert re.fullmatch("(s?(ua)+)?", "".join(role[:1] for role, _ in repaired))


def test_query_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    ids = {r[0] for r in rows}
    assert got(queries.op12_conversation_repair(spark, SF)) == want(damage(rows), ids)


def test_odd_rows(spark):
    """Null ids, turns, roles and texts, ties, a long conversation, conversations whose rows all go, extra columns, an empty table."""
    rows = [(None, None, None, None), (None, 3, "user", "x."), (1, 1, "user", "a."), (1, 1, "user", "a."), (1, 1, "assistant", "b."), *((9, t, ("user", "assistant")[t % 2], "same.") for t in range(700)),
            (4, 5, "sys", "only"), (5, -(1 << 40), "user", "far"), (5, 1 << 40, "assistant", "away")]
    schema = T.StructType([*SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in ("word", "conv", "kind", "digest", "audit", "cost", "at"))])
    wide = spark.createDataFrame([(*r, *["x"] * 7) for r in rows], schema)
    small = [r for r in rows if r[0] != 9]
    found = got(R.digest(wide))
    assert [r for r in found if r[0] != 9] == want(small)
    nine = next(r for r in found if r[0] == 9)
    assert nine[1:7] == (0, 0, 698, 0, 0, 4 * 698) and nine[7] == "KK" + "D" * 698
    empty = spark.createDataFrame([], SCHEMA)
    assert got(R.digest(empty)) == [] and R.repair(empty).count() == 0
    gone = [(c, t, "user", "x") for c in range(40) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    table = spark.createDataFrame(gone, SCHEMA)
    blank = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert gone and got(R.digest(R.damaged(table), table)) == sorted(((c, *blank) for c, *_ in gone), key=repr)


@pytest.mark.parametrize("length", [1, 2, 3])
def test_every_short_word(length):
    """The automaton gives the least cost and audit for every word, whatever it read before."""
    automaton, letters = R.Automaton(), [R.letter(c, f) for f in range(4) for c in range(4)]
    for back in sorted(itertools.product(letters, repeat=length)):
        word = "".join(reversed(back))
        cost, audit, counts = automaton.read(word)
        fresh = R.Automaton()
        assert fresh.read(word) == (cost, audit, counts)
        assert audit.replace("I", "") and len(audit.replace("I", "")) == length
    shared = sum(16**k for k in range(1, length + 1))
    assert automaton.nodes == shared  # each suffix once


def test_conversations_share_suffixes():
    automaton = R.Automaton()
    words = ["BC" * 20, "A" + "BC" * 20, "D" + "BC" * 20]
    for w in sorted(words, key=lambda w: w[::-1]):
        automaton.read(w)
    assert automaton.nodes == 42
