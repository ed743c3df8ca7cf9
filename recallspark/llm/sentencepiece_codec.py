"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model protobuf is parsed here; from it are rebuilt the normaliser (character map, white space rules, dummy
prefix, metaspace mark), the model (unigram scores, or BPE merges in the order of the scores), byte fallback and
the decoder. encode_batch works on many threads. Parity with the reference implementation is
verified by parity() and by the tests.
"""

from __future__ import annotations

import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from ..shipping import ship
from .common import batch_rows

#: Where the driver's machines keep the model file; the same path on every executor.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters encoded at once.
SLICE = 1 << 18
#: Threads of a worker's backend, unless RAYON_NUM_THREADS says otherwise: an executor has a worker for each core, and each thread holds memory.
THREADS = 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_as_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        elif kind == 1:
            value, i = data[i : i + 8], i + 8
        elif kind == 2:
            size, i = varint(i)
            value, i = data[i : i + size], i + size
        elif kind == 5:
            value, i = data[i : i + 4], i + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            m.kind, m.byte_fallback, m.whitespace_as_suffix = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
        elif number == 3:
            spec = dict(_fields(value))
            m.charsmap, m.dummy_prefix, m.remove_extra, m.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    if m.kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models are supported")
    if m.whitespace_as_suffix:
        raise ValueError("a metaspace mark at the end of words is not supported")
    return m


def _merges(m: Model) -> list[tuple[str, str]]:
    """The pairs that make each piece, best score first; a piece's own pairs by the ids of their parts."""
    ids = {p: i for i, (p, _, kind) in enumerate(m.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for p, score, kind in m.pieces:
        if kind in (NORMAL, USER_DEFINED, UNUSED):
            pairs = sorted((ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids)
            found += [(-score, ids[p], i, a, b) for i, (_, _, a, b) in enumerate(pairs)]
    return [(a, b) for *_, a, b in sorted(found, key=lambda x: x[:3])]


_WORD = f"{MARK}+[^{MARK}]*|[^{MARK}]+"
_WORD_START = re.compile(f"(?<=[^{MARK}]){MARK}")


def splits_at_marks(m: Model) -> bool:
    """Whether no piece goes on after a word's end, so that words can be encoded apart."""
    return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in m.pieces if kind in (NORMAL, USER_DEFINED))


def build(m: Model) -> Tokenizer:
    unknown = next((i for i, p in enumerate(m.pieces) if p[2] == UNKNOWN), None)
    if m.kind == UNIGRAM:
        t = Tokenizer(models.Unigram([(p, s) for p, s, _ in m.pieces], unknown, m.byte_fallback))
    else:
        t = Tokenizer(models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, _merges(m), unk_token=m.pieces[unknown][0] if unknown is not None else None, fuse_unk=True, byte_fallback=m.byte_fallback))
    steps: list = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if splits_at_marks(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(_WORD), "isolated")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.dummy_prefix else [])])
    return t


class Codec:
    """Encodes and decodes batches on THREADS threads. Nothing is kept from text to text but the backend's own small cache.

    Where no piece goes on after a word's end, a long text is cut between words to chunks of SLICE characters or so, which are encoded and decoded apart.
    """

    def __init__(self, path: str = MODEL) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        with open(path, "rb") as f:
            m = parse_model(f.read())
        self.tokenizer = build(m)
        self.apart = splits_at_marks(m)
        # texts are normalised before they are cut, so the backend's own normaliser must not run again
        normalizer, self.tokenizer.normalizer = self.tokenizer.normalizer, None
        plain = not m.charsmap and not m.remove_extra and m.escape and m.dummy_prefix
        self.normalize = (lambda x: MARK + x.replace(" ", MARK) if x else x) if plain else normalizer.normalize_str
        self.glue = " " if m.dummy_prefix else ""

    def _chunks(self, text: str) -> list[str]:
        x = self.normalize(text)
        if not self.apart or len(x) <= SLICE:
            return [x] if x else []
        out, at = [], 0
        while at < len(x):
            end = _WORD_START.search(x, at + SLICE) if at + SLICE < len(x) else None
            out.append(x[at : end.start() if end else len(x)])
            at += len(out[-1])
        return out

    def encode_chunks(self, texts: list[str]) -> list[list[list[int]]]:
        """The ids of each text's chunks; all texts are held at once, so a slice of them should be given."""
        chunks = [self._chunks(t) for t in texts]
        got = iter(self.tokenizer.encode_batch_fast([c for own in chunks for c in own], add_special_tokens=False))
        return [[next(got).ids for _ in own] for own in chunks]

    def decode_chunks(self, ids: list[list[list[int]]]) -> list[str]:
        """Each text from the ids of its chunks. The decoder takes the dummy prefix off each chunk, which begins with a space all but the first time."""
        got = iter(self.tokenizer.decode_batch([c for own in ids for c in own], skip_special_tokens=False))
        return [self.glue.join([next(got) for _ in own]) for own in ids]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for c in own for i in c] for part in _slices(texts) for own in self.encode_chunks(part)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


_loaded: dict[str, Codec] = {}


def load(path: str = MODEL) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > SLICE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def encode(docs: DataFrame, *, model: str = MODEL, column: str = "text", decoded: bool = False) -> DataFrame:
    """docs with token_ids (null for a null text, empty for an empty one), n_tokens (0 for null), round_trip (whether the decoder gives the
    text back from the ids; null for null) and, if asked for, the decoded text. Columns of docs with these names are replaced; others, of any name, stay.

    Texts are encoded and decoded whole, about SLICE characters at a time; every row by itself, so repeated rows and ties get equal results.
    An empty table gives an empty result.
    """
    ship(docs)
    batch_rows(docs)
    new = ["token_ids", "n_tokens", "round_trip", *(["decoded"] if decoded else [])]
    keep = [c for c in docs.columns if c not in new]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            null = [x is None for x in texts]
            ids: list[np.ndarray] = []
            same, back = [], []
            for part in _slices([x or "" for x in texts]):
                got = codec.encode_chunks(part)
                again = codec.decode_chunks(got)
                same += [a == b for a, b in zip(again, part, strict=True)]
                if decoded:
                    back += again
                ids += [np.fromiter(itertools.chain.from_iterable(own), np.int32) for own in got]
            n = [len(x) for x in ids]  # none for null and empty texts
            ends = np.cumsum([0, *n]).tolist()
            offsets = [None if z else at for z, at in zip(null, ends, strict=False)]
            at = ends[-1]
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]))
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), flat), pa.array(n, pa.int64()), pa.array([None if z else s for z, s in zip(null, same, strict=True)], pa.bool_())]
            if decoded:
                columns.append(pa.array([None if z else b for z, b in zip(null, back, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["row", *new])

    schema = row.select("row").schema.add("token_ids", ArrayType(IntegerType())).add("n_tokens", "long").add("round_trip", "boolean")
    out = row.mapInArrow(run, schema.add("decoded", "string") if decoded else schema)
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *new)


def parity(texts: list[str], path: str = MODEL) -> list[str]:
    """The texts for which ids or decoded text differ from the reference implementation's."""
    import sentencepiece

    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=path), load(path)
    want = theirs.encode(texts, num_threads=1)
    got = ours.encode(texts)
    back = ours.decode(got)
    return [t for t, a, b, c in zip(texts, want, got, back, strict=True) if a != b or theirs.decode(a) != c]
