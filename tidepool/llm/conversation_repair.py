"""Repair of conversation structure by a suffix-shared automaton (DAWG) of role and fault signatures.

A row's signature is one letter: its role's class (system, user, assistant, other, by the role's initial) with its first
fault (none, truncated, blank, duplicate). A conversation is the word of its letters by turn.

**Automaton.** Words are minimised from the end: equal words meet in one row, and the distinct ones are sorted by
their reversal, so that words with a common suffix follow each other. A task keeps the path of the last word as a
stack; the next word pops to the common suffix and pushes one node for every further letter. A node (a distinct suffix) thus gets its
cost-to-go and its best audit suffix, for each of the four grammar states, once for all conversations that share it (once a
task along the path at a task's edge). The audit suffix is kept as its first letter with a link: for a node and state each edit
letter leads to one state only, so the least letter among the cheapest edits starts the least cheapest audit.

**Grammar.** Role initials must read ``(s?(ua)+)?``. States: 0 nothing yet, 1 after s, 2 after u, 3 after a; 0 and 3 accept.

**Scale.** Faults need no text in a shuffle: rows are compared by SHA-256 of role and text. Equal rows of one turn collapse map-side. The
letters of a conversation, however long, are put in order by a range sort over (conversation, turn), so a conversation that holds a third of all
rows is sorted by many tasks; they meet only as one character a row, which is the size of its audit. Texts are shuffled once, to
be hashed or returned in order: one sorted stream, row by row, with no conversation held in memory.

Defined results: a null role or text is one space; null turns come first; rows that share a turn go by role, then by
the digest of role and text. An empty role has the class other. A null conversation id is one conversation. Empty tables give empty results; other
columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
CLASSES, FAULTS = "sua", ("none", "truncated", "blank", "duplicate")
_SPACE = " \t\n\x0b\x0c\r"
#: The state that a role of class s, u, a leads to, by state; a class with none is not allowed there.
_NEXT = {0: {0: 1, 1: 2}, 1: {1: 2}, 2: {2: 3}, 3: {1: 2}}
#: The only state that an inserted or re-roled row can lead to.
_OWN = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: Legal neighbours of classes.
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def letter(cls: int, fault: int) -> str:
    return chr(65 + 4 * fault + cls)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, chosen by crc32 of ``conv_id:turn`` modulo 20; nulls become one space."""
    either = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(either("conv_id"), F.lit(":"), either("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", either("role").alias("role"), either("text").alias("text"), case.alias("case")).where("case <> 0")
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _rows(rows: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), digest.alias("digest"))


def _order() -> list[Column]:
    return [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]


def signatures(rows: DataFrame) -> DataFrame:
    """conv and word of every conversation that has rows."""
    own = _rows(rows)
    blank = F.translate("text", _SPACE, "") == ""
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    narrow = own.select("conv", "turn", "role", "digest", cls.alias("cls"), F.when(blank, 2).when(whole, 0).otherwise(1).alias("fault"))
    narrow = narrow.groupBy("conv", "turn", "role", "digest", "cls", "fault").agg(F.count(F.lit(1)).cast("int").alias("times"))
    at = F.struct(F.col("turn").isNotNull(), "turn")
    firsts = narrow.where("fault <> 2").groupBy(F.col("conv").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(at).alias("first"))
    met = narrow.join(firsts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    sign = lambda fault: F.char(65 + 4 * fault + F.col("cls"))
    again = F.repeat(sign(F.lit(3)), F.when(F.col("first").eqNullSafe(at), F.col("times") - 1).otherwise(F.col("times")))
    word = F.when(F.col("fault") == 2, F.repeat(sign(F.lit(2)), F.col("times"))).otherwise(
        F.concat(F.when(F.col("first").eqNullSafe(at), sign(F.col("fault"))).otherwise(""), again))
    ordered = met.select("conv", "turn", "role", "digest", word.alias("word")).repartitionByRange(*_order()).sortWithinPartitions(*_order())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The letters of each conversation's rows in a batch, as one piece."""
        pid, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            code, words = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_pylist(), batch.column(1).to_pylist()
            cuts = [0, *(i for i in range(1, len(code)) if code[i] != code[i - 1]), len(code)]
            out = ["".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cuts[:-1], pa.int64())), pa.array([(pid << 40) + nth + i for i in range(len(out))], pa.int64()), pa.array(out, pa.string())],
                                             names=["conv", "at", "word"])
            nth += len(out)

    found = ordered.select("conv", "word").mapInArrow(pieces, f"conv {ordered.schema['conv'].dataType.simpleString()}, at long, word string")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), "")
    return found.groupBy("conv").agg(joined.alias("word"))


@functools.lru_cache(maxsize=1 << 14)
def node(sign: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], str]:
    """Cost-to-go and first audit letter, by grammar state, of the node that reads ``sign`` and goes on to one with costs ``after``."""
    fault, cls = divmod(ord(sign) - 65, 4)
    paid = TRUNCATED if fault == 1 else 0
    edits: list[dict[str, int]] = []
    for state in range(4):
        own = {"D": DELETE + after[state]}
        if fault < 2:
            if cls in _NEXT[state]:
                own["K"] = KEEP + paid + after[_NEXT[state][cls]]
            own["R"] = REROLE + paid + after[_OWN[state]]
        edits.append(own)
    cost = [min(own.values()) for own in edits]
    for _ in range(2):  # at most two rows are inserted before one
        cost = [min(min(own.values()), INSERT + cost[_OWN[state]]) for state, own in enumerate(edits)]
    choice = ""
    for state, own in enumerate(edits):
        own["I"] = INSERT + cost[_OWN[state]]
        choice += min(e for e, c in own.items() if c == cost[state])
    return tuple(cost), choice


#: Cost-to-go and first letter at the end of a conversation; "." stops.
END = ((0, 2 * INSERT, INSERT, 0), ".II.")


class Automaton:
    """The nodes along one word, from its end; words must come sorted by their reversal to share them."""

    def __init__(self):
        self.word = ""  # reversed
        #: (least cost, costs beyond the least, letters, counts of faults and of illegal neighbours) of the suffix of each length
        self.path = [(0, *END, (0, 0, 0, 0))]
        self.nodes = 0

    def push(self, sign: str) -> None:
        base, after, _, (blank, duplicate, truncated, illegal) = self.path[-1]
        cost, choice = node(sign, after)
        least = min(cost)
        fault, cls = divmod(ord(sign) - 65, 4)
        if self.word and (cls, (ord(self.word[-1]) - 65) % 4) not in _LEGAL:
            illegal += 1
        self.path.append((base + least, tuple(c - least for c in cost), choice, (blank + (fault == 2), duplicate + (fault == 3), truncated + (fault == 1), illegal)))
        self.word += sign
        self.nodes += 1

    def read(self, word: str) -> tuple[int, str, tuple[int, int, int, int]]:
        """Cost, audit and counts (blank, duplicate, truncated, illegal) of a word."""
        back = word[::-1]
        shared, most = 0, min(len(back), len(self.word))
        while shared < most and back[shared] == self.word[shared]:
            shared += 1
        del self.path[shared + 1 :]
        self.word = self.word[:shared]
        for sign in back[shared:]:
            self.push(sign)
        base, beyond, _, counts = self.path[-1]
        state, audit, at = 0, [], len(back)
        while (edit := self.path[at][2][state]) != ".":
            audit.append(edit)
            if edit == "I":
                state = _OWN[state]
            else:
                if edit != "D":
                    state = _OWN[state] if edit == "R" else _NEXT[state][(ord(back[at - 1]) - 65) % 4]
                at -= 1
        return base + beyond[0], "".join(audit), counts


def solve(words: DataFrame) -> DataFrame:
    """word, blank, duplicate, truncated, illegal, cost, audit of every distinct ``word``."""
    back = F.reverse("word")
    ordered = words.select("word").distinct().repartitionByRange(back).sortWithinPartitions(back)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            read = [automaton.read(w) for w in batch.column(0).to_pylist()]
            counts = [[c[i] for _, _, c in read] for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([c for c, _, _ in read], pa.int64()), pa.array([a for _, a, _ in read], pa.string())],
                                             names=["word", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    return ordered.mapInArrow(run, "word string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def plans(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv, word, blank, duplicate, truncated, illegal, cost, audit of every conversation of ``rows``, and of the ``conv_id`` of ``ids``."""
    words = common.reread(signatures(rows), "conversation-words")
    if ids is not None:
        every = ids.select(F.col("conv_id").alias("_id")).distinct()
        words = every.join(words, F.col("_id").eqNullSafe(F.col("conv")), "left").select(F.col("_id").alias("conv"), F.coalesce("word", F.lit("")).alias("word"))
    return words.join(solve(words), "word")


def _in_order(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows by turn; sorted within partitions, a conversation in one of them."""
    report = ["blank", "duplicate", "truncated", "illegal", "cost"]
    own = _rows(rows).select("conv", F.lit(1).alias("kind"), "turn", "role", "digest", "text", *(F.lit(None).cast("long").alias(c) for c in report))
    heads = planned.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), *report)
    first, *rest = _order()
    return heads.unionByName(own).repartition("conv").sortWithinPartitions(first, "kind", *rest).drop("digest")


class _Replay:
    """One conversation's rows as they pass, with the edits of its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserts(self) -> Iterator[str]:
        """Roles of the rows inserted here."""
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = _OWN[self.state]
            yield _ROLE[self.state]

    def row(self, role: str) -> tuple[str, str]:
        """Edit and role of the next row."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = _OWN[self.state]
            role = _ROLE[self.state]
        elif edit == "K":
            self.state = _NEXT[self.state][CLASSES.index(role[:1])]
        return edit, role


def digest(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation."""
    ordered = _in_order(rows, plans(rows, ids))
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list | None = None
        replay, sha, any_, turns, low, high = _Replay(""), hashlib.sha256(), False, 0, None, None

        def add(role: str, text: str) -> None:
            nonlocal any_
            sha.update((("\n" if any_ else "") + role + ":" + text).encode())
            any_ = True

        def close() -> list:
            for role in replay.inserts():
                add(role, "")
            gaps = high - low + 1 - turns if turns else 0
            return [head[0], gaps, *head[1:6], head[6], sha.hexdigest()]

        for batch in batches:
            out = []
            conv, kind, turn, role, text, *report = (c.to_pylist() for c in batch.columns)
            for i, k in enumerate(kind):
                if k == 0:
                    if head is not None:
                        out.append(close())
                    head = [conv[i], *(c[i] for c in report), text[i]]
                    replay, sha, any_, turns, low, high = _Replay(text[i]), hashlib.sha256(), False, 0, None, None
                    continue
                if turn[i] is not None and turn[i] != high:
                    low, high, turns = turn[i] if low is None else low, turn[i], turns + 1
                for inserted in replay.inserts():
                    add(inserted, "")
                edit, own = replay.row(role[i])
                if edit != "D":
                    add(own, text[i])
            yield _batch(out, names, types)
        if head is not None:
            yield _batch([close()], names, types)

    key = ordered.schema["conv"].dataType
    types = [_arrow(key), *[pa.int64()] * 6, pa.string(), pa.string()]
    schema = f"conv {key.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", "conv_id")


def repair(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, nth (from 0, in order), edit (K, R or I), turn, role, text. Inserted rows have no turn and an empty text."""
    ordered = _in_order(rows, plans(rows))
    names = ["conv", "nth", "edit", "turn", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, replay, nth, open_ = None, _Replay(""), 0, False
        for batch in batches:
            out: list[list] = []
            conv, kind, turn, role, text, *_ = (c.to_pylist() for c in batch.columns)
            for i, k in enumerate(kind):
                for inserted in replay.inserts():
                    out.append([conv_id, nth, "I", None, inserted, ""])
                    nth += 1
                if k == 0:
                    conv_id, replay, nth, open_ = conv[i], _Replay(text[i]), 0, True
                    continue
                edit, own = replay.row(role[i])
                if edit != "D":
                    out.append([conv_id, nth, edit, turn[i], own, text[i]])
                    nth += 1
            yield _batch(out, names, types)
        if open_:
            yield _batch([[conv_id, nth + j, "I", None, inserted, ""] for j, inserted in enumerate(replay.inserts())], names, types)

    key = ordered.schema["conv"].dataType
    types = [_arrow(key), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    return ordered.mapInArrow(run, f"conv {key.simpleString()}, nth long, edit string, turn long, role string, text string").withColumnRenamed("conv", "conv_id")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _batch(rows: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
