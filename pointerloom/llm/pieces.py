"""SentencePiece models run by the tokenizers library.

The model file is read as protobuf wire data. From it the tokenizer is rebuilt:
normaliser, space marker and dummy prefix, pieces with their scores (unigram, or
merges in order of scores), byte fallback. Parity with the sentencepiece library
is checked, not assumed.

Where no piece has the marker behind another character, merges never cross the
beginning of a word, so a text is the sequence of its words and a word met
before need not be encoded again. This does not hold for a model with a
character map; it gets whole texts, and so does a unigram model.

In a unigram model a user-defined piece gets the bonus by which sentencepiece always
takes it; pieces that no text may match (controls, bytes, unused ones) are under
names that no text has, and characters without a piece are turned into bytes here.
Sums of scores are in double precision: of ways with equal scores another one than
sentencepiece's, which sums in single precision, may be taken; parity tells such rows.
User-defined pieces of a BPE model, and such as a character map would change, are refused.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointerloom.llm.common import kept, texts_of

MARKER = "▁"
# Fixed values of the model format.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5

MEMO_LIMIT = 800_000
BLOCK = 1_000
# A noncharacter: what no text begins with.
NO_TEXT = "\ufdd0"
# Of the user-defined bonus, and the least value of the best score (fixed values).
BONUS_OFF, LEAST_BEST = 0.1, float(np.finfo(np.float32).tiny)
CHUNK = re.compile(rb" ( *[^ ]*)")


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unk(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel([])
    for field, value in wire_fields(data):
        if field == 1:
            piece = dict(wire_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            model.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(wire_fields(value))
            model.kind = trainer.get(3, UNIGRAM)
            model.byte_fallback = bool(trainer.get(35, 0))
            model.unk_surface = trainer.get(44, b" \xe2\x81\x87 ").decode()
        elif field == 3:
            normal = dict(wire_fields(value))
            model.charsmap = normal.get(2, b"")
            model.dummy_prefix = bool(normal.get(3, 1))
            model.trim_spaces = bool(normal.get(4, 1))
            model.escape_spaces = bool(normal.get(5, 1))
    return model


def merges_of(model: PieceModel) -> list[tuple[str, str]]:
    """All ways to make a piece of two, best score first, as the model prefers them."""
    known = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    found = []
    for piece in known:
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in known and b in known:
                found.append((-model.pieces[known[piece]][1], known[piece], known[a], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def unigram_scores(model: PieceModel) -> list[tuple[str, float]]:
    """Pieces as a text may match them, with the scores the best path is made of."""
    best = max([s for _, s, kind in model.pieces if kind == NORMAL], default=0.0)
    bonus = max(best, LEAST_BEST)
    rows = []
    for at, (piece, score, kind) in enumerate(model.pieces):
        if kind == USER_DEFINED:
            shown = piece.replace(" ", MARKER) if model.escape_spaces else piece
            rows.append((shown, bonus * len(shown.encode()) - BONUS_OFF))
        elif kind == NORMAL:
            rows.append((piece, score))
        else:
            # Zero leaves the least score, which that of unknown characters rests on.
            rows.append((f"{NO_TEXT}{at}", 0.0))
    return rows


def build_tokenizer(model: PieceModel):
    """The tokenizers library's form of the model, with its decoder."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    own = [p for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own and model.kind == BPE:
        raise ValueError("user-defined pieces of a BPE model are not supported")
    if own and model.charsmap:
        mapped = normalizers.Precompiled(model.charsmap).normalize_str
        changed = [p for p in own if mapped(p) != p]
        if changed:
            raise ValueError(f"the character map changes user-defined pieces: {changed}")
    if model.kind == UNIGRAM:
        core = models.Unigram(unigram_scores(model), unk_id=model.unk, byte_fallback=False)
    elif model.kind == BPE:
        core = models.BPE(
            vocab={p: i for i, (p, _, _) in enumerate(model.pieces)},
            merges=merges_of(model),
            unk_token=model.pieces[model.unk][0],
            fuse_unk=True,
            byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" +"), " ")]
    marker = MARKER if model.escape_spaces else " "
    steps += [normalizers.Prepend(marker)] if model.dummy_prefix else []
    steps += [normalizers.Replace(" ", MARKER)] if model.escape_spaces else []
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARKER, " "), decoders.ByteFallback(), decoders.Fuse()]
        + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])
    )
    return tokenizer


class PieceEncoder:
    """Encodes and decodes UTF-8 texts; compares with the sentencepiece library if asked."""

    def __init__(self, path: str, threads: int = 2, verify: bool = False, limit: int = MEMO_LIMIT):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer, self.threads = build_tokenizer(self.model), threads
        self.dtype = np.dtype("<u2" if len(self.model.pieces) <= 1 << 16 else "<u4")
        self.by_words = (
            self.model.kind == BPE
            and not self.model.charsmap
            and self.model.dummy_prefix
            and self.model.escape_spaces
            and any(p == MARKER for p, _, _ in self.model.pieces)
            and not any(MARKER in p.lstrip(MARKER) for p, _, _ in self.model.pieces)
        )
        self.other = None
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.young, self.old, self.odd = limit, {}, {}, set()
        names = [p for p, _, _ in self.model.pieces]
        self.alone = np.array(
            [names.index(MARKER)] if MARKER in names else [], dtype=self.dtype
        ).tobytes()
        self.table = [self._surface(p, kind) for p, _, kind in self.model.pieces]
        self.bytes = {}
        if self.model.kind == UNIGRAM and self.model.byte_fallback:
            kinds = [kind for *_, kind in self.model.pieces]
            self.bytes = {self.table[i][0]: i for i, kind in enumerate(kinds) if kind == BYTE}

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        text = self.model.unk_surface if kind == UNKNOWN else piece
        return text.replace(MARKER, " ").encode()

    def _with_bytes(self, ids: list[int], parts: list[str]) -> list[int]:
        """Ids with the bytes of what no piece stands for."""
        out = []
        for i, part in zip(ids, parts):
            out += [self.bytes[b] for b in part.encode()] if i == self.model.unk else [i]
        return out

    def _coded(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        coded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [c.ids for c in coded]
        if self.bytes:
            unk = self.model.unk
            odd = [k for k, i in enumerate(ids) if unk in i]
            # Only the slower way tells what an unknown piece was.
            full = self.tokenizer.encode_batch([texts[k] for k in odd], add_special_tokens=False)
            for k, c in zip(odd, full):
                ids[k] = self._with_bytes(c.ids, c.tokens)
        same = [True] * len(ids)
        if self.other is not None:
            same = [a == b for a, b in zip(ids, self.other.encode(texts, num_threads=self.threads))]
        return [np.array(i, dtype=self.dtype).tobytes() for i in ids], same

    def words_of(self, text: bytes) -> list[bytes]:
        """Words with the spaces before them but one, which the marker stands for."""
        text = text.replace(MARKER.encode(), b" ")
        if self.model.trim_spaces:
            text = b" ".join(w for w in text.split(b" ") if w)
        if not text:
            return []
        words = text.split(b" ")
        return words if all(words) else CHUNK.findall(b" " + text)

    def _known(self, words: set[bytes]) -> dict[bytes, bytes]:
        if len(self.young) * 2 >= self.limit:
            self.old, self.young = self.young, {}
            self.odd.intersection_update(self.old)
        found, new = {}, []
        for w in words:
            ids = self.young.get(w)
            if ids is None:
                ids = self.old.get(w)
                if ids is None:
                    new.append(w)
                    continue
                self.young[w] = ids
            found[w] = ids
        if new:
            words = [w.decode("utf-8", "replace") for w in new]
            coded, same = self._coded(words)
            for w, ids, equal in zip(new, coded, same):
                # The prefix is not put before nothing, but a last space stands for it.
                found[w] = self.young[w] = ids if w else self.alone
                if not equal:
                    self.odd.add(w)
        return found

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[bool]]:
        """Ids of every text, and whether sentencepiece agreed (true if not asked)."""
        out, same = [], []
        for low in range(0, len(texts), BLOCK):
            block = texts[low : low + BLOCK]
            if not self.by_words:
                ids, equal = self._coded([t.decode("utf-8", "replace") for t in block])
                out, same = out + ids, same + equal
                continue
            parts = [self.words_of(t) for t in block]
            get = self._known(set().union(*parts)).__getitem__
            out += [b"".join(map(get, p)) for p in parts]
            same += [not self.odd or self.odd.isdisjoint(p) for p in parts]
        return out, same

    def decode(self, ids: bytes) -> bytes:
        """The text of ids; bytes that are not UTF-8 together become U+FFFD each."""
        numbers = np.frombuffer(ids, dtype=self.dtype).tolist()
        text = b"".join(map(self.table.__getitem__, numbers))
        if self.model.dummy_prefix and text[:1] == b" ":
            text = text[1:]
        return text.decode("utf-8", "replace").encode()


def piece_tokens(
    docs: DataFrame, path: str, threads: int = 2, verify: bool = True, with_ids: bool = True
) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_crc32, n_chars,
    round_trip, parity`` and the ``ids``; map-only.

    ``n_chars`` counts the decoded text, ``round_trip`` tells whether it is the
    text again, ``parity`` whether sentencepiece gives the same ids. Null texts
    are empty and have no ids. Repeated rows and null ids are rows like any
    other; other columns are ignored.
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, n_chars long, round_trip boolean, "
    schema += "parity boolean" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = lambda: PieceEncoder(path, threads, verify)
        code = kept(("pieces", path, threads, verify), make)
        for batch in batches:
            texts = texts_of(batch, "text")
            coded, same = code.encode(texts)
            arrays = [np.frombuffer(c, dtype=code.dtype) for c in coded]
            decoded = [code.decode(c) for c in coded]
            columns = [
                batch.column("doc_id"),
                pa.array([len(a) for a in arrays], type=pa.int64()),
                pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in arrays], type=pa.int64()),
                pa.array([len(d.decode()) for d in decoded], type=pa.int64()),
                pa.array([a == b for a, b in zip(texts, decoded)], type=pa.bool_()),
                pa.array(same, type=pa.bool_()),
            ]
            if with_ids:
                ids = [a.astype(np.int32) for a in arrays]
                columns.append(pa.array(ids, type=pa.list_(pa.int32())))
            names = [x.split()[0] for x in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"))
    return rows.mapInArrow(run, schema)
