"""SentencePiece encoding and decoding on the ``tokenizers`` library, verified against ``sentencepiece``.

The model protobuf is read field by field (pieces with scores and types, trainer and normaliser settings) and rebuilt:
the normaliser (its character map, white space rules, the metaspace marker and the dummy prefix), a unigram model with
the piece scores or a BPE model whose merges follow the scores, and byte fallback. The decoder joins pieces, turns byte pieces into bytes
and the marker into spaces.

A text is normalised whole and cut before every metaspace marker that follows another character, if no piece crosses
such a place (checked when the model is read; else texts are encoded whole). Each distinct part is encoded once by a
worker, in multithreaded batches, and kept in a bounded cache of two generations. ``parity`` of a document says whether its ids are
those that ``sentencepiece`` gives for the whole original text; it is null where nothing was compared.

Narrow passes: no shuffle. Defined results: a null text counts as empty: no ids, decoded to the empty text. Repeated rows give
repeated results; other columns are not touched.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MARK = "▁"
#: Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Distinct parts in a generation of a worker's cache (some 0.2 KB each), and threads of a batch.
CACHE, THREADS = 500_000, 2
_BYTE = re.compile(r"<0x([0-9A-F]{2})>\Z")


def fields(buffer: bytes):
    """(number, value) of a protobuf message: ints, 4- and 8-byte strings for fixed fields, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = buffer[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(buffer):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} in a model file")
            size = varint()
        yield tag >> 3, buffer[at : at + size]
        at += size


@dataclass
class SpModel:
    """What encoding and decoding need of a model file."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def parse_model(raw: bytes) -> SpModel:
    """Read the fields of the public model format by their numbers."""
    model = SpModel()
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 35:
                    model.byte_fallback = bool(v)
                elif n == 40:
                    model.unk_id = v
                elif n == 44:
                    model.unk_surface = v.decode()
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    model.unk_id = next((i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN), model.unk_id)
    if model.model_type not in (UNIGRAM, BPE) or not model.escape_whitespaces:
        raise ValueError("only unigram and BPE models that escape white space are supported")
    return model


def merges(model: SpModel) -> list[tuple[str, str]]:
    """Pairs of pieces that join to a piece, best score first, then by the pieces' ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, score, kind in model.pieces:
        if kind == NORMAL and len(piece) > 1:
            found += [(-score, ids[piece[:i]], ids[piece[i:]], piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in ids and piece[i:] in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def build_normalizer(model: SpModel):
    """Character map, white space rules and the marker; the dummy prefix is put on a non-empty text only."""
    from tokenizers import Regex, normalizers

    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    return normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])


def build_tokenizer(model: SpModel):
    """The model on normalised text as a ``tokenizers.Tokenizer``, without normaliser or cutting."""
    from tokenizers import AddedToken, Tokenizer, models

    if model.model_type == UNIGRAM:
        vocabulary = [(p if kind != UNUSED else f"\x00unused{i}", score) for i, (p, score, kind) in enumerate(model.pieces)]
        tokenizer = Tokenizer(models.Unigram(vocabulary, model.unk_id, model.byte_fallback))
    else:
        ids = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        tokenizer = Tokenizer(models.BPE(ids, merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback))
    own = [AddedToken(p, normalized=False, special=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


class SentencePieceCodec:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str | None = None, raw: bytes | None = None, cache: int = CACHE, threads: int = THREADS, verify: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        if raw is None:
            with open(path, "rb") as f:
                raw = f.read()
        self.model = parse_model(raw)
        self.normalizer, self.tokenizer = build_normalizer(self.model), build_tokenizer(self.model)
        live = [p for p, _, kind in self.model.pieces if kind in (NORMAL, USER_DEFINED)]
        self.cuts = not any(MARK in p.lstrip(MARK) for p in live) and not any(kind == USER_DEFINED for _, _, kind in self.model.pieces)
        self.identity = not self.model.charsmap and not self.model.remove_extra_whitespaces and self.model.add_dummy_prefix
        self.surface = [self._surface(i) for i in range(len(self.model.pieces))]
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.limit, self.threads, self.reference = cache, threads, None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)

    def _surface(self, i: int) -> bytes:
        piece, _, kind = self.model.pieces[i]
        if kind == BYTE and (m := _BYTE.match(piece)):
            return bytes([int(m[1], 16)])
        return b"" if kind == CONTROL else self.model.unk_surface.encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        if self.identity:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.normalizer.normalize_str(text) if text else ""

    def _parts(self, normal: str) -> list[str]:
        """Parts that no piece crosses: one before every marker after another character, and around line feeds."""
        if not self.cuts or MARK + MARK in normal:
            return [normal] if normal else []
        head, *rest = normal.split(MARK)
        return ([head] if head else []) + [MARK + w for w in rest]

    def _lookup(self, parts: list[str]) -> list[bytes]:
        """Ids of distinct parts, from the cache or newly encoded."""
        if len(self.cache) > self.limit:
            self.old, self.cache = self.cache, {}
        values = list(map(self.cache.get, parts))
        holes = [i for i, v in enumerate(values) if v is None]
        if holes:
            known = {parts[i]: v for i in holes if (v := self.old.get(parts[i])) is not None}
            self.cache.update(known)
            new = [parts[i] for i in holes if parts[i] not in known]
            for a in range(0, len(new), 8192):
                own = new[a : a + 8192]
                ids = [e.ids for e in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                raw = np.fromiter(itertools.chain.from_iterable(ids), dtype="<u4").tobytes()
                to = [4 * n for n in itertools.accumulate(map(len, ids))]
                self.cache.update(zip(own, map(raw.__getitem__, map(slice, [0, *to[:-1]], to)), strict=True))
            for i in holes:
                values[i] = self.cache[parts[i]]
        return values

    def _whole(self, text: str) -> bytes:
        """Ids of a text that is cut part by part, or not at all."""
        return b"".join(self._lookup(self._parts(self.normalise(text))))

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """Ids (little-endian 32-bit) of every text of a string array without nulls."""
        if not (self.cuts and self.identity) or not len(texts):
            return [self._whole(t) for t in texts.to_pylist()]
        # a marker in the text itself and runs of spaces may be pieces of their own: those texts go one by one
        odd = [pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.starts_with(texts, " "), pc.equal(texts, "")]
        odd = functools.reduce(pc.or_, odd).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.binary_join_element_wise(MARK, pc.replace_substring(texts, " ", " " + MARK), ""), " ")
        at = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        pieces = cut.flatten().dictionary_encode()
        ids, count = common.ragged_take(self._lookup(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pieces.indices.to_numpy())
        raw, ends = ids.tobytes(), (4 * np.cumsum(np.add.reduceat(count, at))).tolist()
        out = list(map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends)))
        for i in np.flatnonzero(odd).tolist():
            out[i] = self._whole(texts[i].as_py())
        return out

    def encode(self, texts: list[str] | pa.Array) -> tuple[list[bytes], list[bool | None]]:
        """Ids (little-endian 32-bit) of every text, and whether the reference gives the same for the whole text."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ids = self.encode_column(column)
        if self.reference is None:
            return ids, [None] * len(ids)
        theirs = self.reference.encode(column.to_pylist(), num_threads=self.threads)
        return ids, [np.array(t, dtype="<u4").tobytes() == i for t, i in zip(theirs, ids, strict=True)]

    def decode(self, ids: bytes) -> str:
        body = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        if self.model.add_dummy_prefix and body.startswith(b" "):
            body = body[1:]
        return body.decode("utf-8", "replace")


_codecs: dict[tuple[str, int, bool], SentencePieceCodec] = {}


def _codec(path: str, threads: int, verify: bool) -> SentencePieceCodec:
    """One codec for a worker process and file."""
    if (path, threads, verify) not in _codecs:
        _codecs[path, threads, verify] = SentencePieceCodec(path, threads=threads, verify=verify)
    return _codecs[path, threads, verify]


def encode(docs: DataFrame, model: str, keep: list[str], text: str = "text", threads: int = THREADS, verify: bool = True) -> DataFrame:
    """The columns ``keep`` with ``ids`` (little-endian 32-bit binary) and ``parity``; ``model`` is a path that tasks can read."""
    clean = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "ids binary, parity boolean"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, same = _codec(model, threads, verify).encode(batch.column(batch.num_columns - 1))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], names=[*batch.schema.names[:-1], "ids", "parity"])

    out = common.map_arrow(clean, clean.columns, schema, run, group=4 << 20)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "ids", "parity")


def round_trip(docs: DataFrame, model: str, keep: list[str], text: str = "text", threads: int = THREADS, verify: bool = True) -> DataFrame:
    """The columns ``keep`` with n_tokens and ids_crc32 of a text's ids, ``parity``, and ``round_trip``: whether decoding them gives the text again.

    One pass: texts go to Python once, and neither they nor their ids come back.
    """
    clean = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec, texts = _codec(model, threads, verify), batch.column(batch.num_columns - 1)
        ids, same = codec.encode(texts)
        back = [codec.decode(i) == t for i, t in zip(ids, texts.to_pylist(), strict=True)]
        found = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], "n_tokens", "ids_crc32", "parity", "round_trip"])

    out = common.map_arrow(clean, clean.columns, schema, run, group=4 << 20)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "ids_crc32", "parity", "round_trip")


def decode(rows: DataFrame, model: str, keep: list[str], ids: str = "ids") -> DataFrame:
    """The columns ``keep`` with ``decoded``, the text of ``ids`` (null ids: the empty text)."""
    clean = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(ids), F.lit(b"")).alias("_ids"))
    schema = ", ".join([*(f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)), "decoded string"])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = _codec(model, THREADS, False)
        texts = [codec.decode(b) for b in batch.column(batch.num_columns - 1).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "decoded"])

    out = common.map_arrow(clean, clean.columns, schema, run)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "decoded")
