"""Ids of whole texts from a file of the tokenizers library, with words remembered.

Some tokenizers drop white space and never join what it parts. For these the ids
of a text are the ids of its chunks between ASCII white space, one after another,
so a chunk met before need not be encoded again. Others get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from pointerloom.llm.common import kept

#: Bytes of chunks and their ids that a worker remembers, in two generations.
MEMORY_BYTES = 64 << 20
#: What an entry costs beside its bytes.
ENTRY_BYTES = 170
BLOCK = 500
BEYOND_LATIN = "\u0250"

# Letters, then ASCII marks but the apostrophe, which can begin a word of its own.
PLAIN = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-@\[-`{-~]*)")
# The pattern by which the word tokenizer takes its words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level models write each byte.

    Printable Latin-1 stands for itself, other bytes for letters from U+0100 on.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + k) for k, b in enumerate(others)}


def drops_white_space(spec: dict) -> bool:
    """Whether chunks between white space are encoded independently of each other."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, rest = steps[0], steps[1:]
    return (
        first.get("type") == "Split"
        and first.get("pattern") == {"Regex": WORD_PATTERN}
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and all(x.get("type") == "ByteLevel" and not x.get("add_prefix_space") for x in rest)
        and not spec.get("post_processor")
    )


class Words(dict):
    """Ids of chunks; what is missing is taken from the generation before, or encoded."""

    def __init__(self, encode, before: dict):
        super().__init__()
        self.encode, self.before, self.bytes = encode, before, 0

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.encode(chunk)
        self.bytes += len(chunk) + len(ids) + ENTRY_BYTES
        self[chunk] = ids
        return ids


class TextEncoder:
    """Encodes UTF-8 texts; ids come back as little-endian bytes of ``dtype``.

    Chunks are remembered in two generations: what was met since the older one was
    dropped stays, so common words survive and memory is bounded by ``limit`` bytes.
    """

    def __init__(self, path: str, limit: int = MEMORY_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.chunked = drops_white_space(spec)
        steps = (spec.get("normalizer") or {}).get("normalizers") or []
        self.lowers = any(x.get("type") == "Lowercase" for x in steps)
        self.special = [x["content"].encode() for x in spec.get("added_tokens", [])]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.letters = byte_letters()
        self.limit, self.words = limit, Words(self._ids, {})

    def _pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def _parts(self, text: bytes) -> list[bytes]:
        # Case is dropped anyway, but not before a special token's own text is found.
        lowered = text.lower() if self.lowers else text
        if any(x in lowered for x in self.special):
            return text.split()
        return lowered.split()

    def _word(self, word: bytes) -> bytes:
        """Ids of one word of the splitter with nothing to normalise."""
        found = self.tokenizer.model.tokenize(word.decode("latin-1").translate(self.letters))
        return self._pack([t.id for t in found])

    def _ids(self, chunk: bytes) -> bytes:
        """Ids of a chunk; small Latin letters, with or without marks behind, need no splitter.

        Letters must stay letters and the same in lower case: a capital beyond ASCII, or
        one that becomes a letter with a mark of its own, goes the whole way.
        """
        plain = PLAIN.fullmatch(chunk) if self.lowers else None
        if plain:
            letters, marks = plain.groups()
            text = letters.decode("utf-8", "replace")
            if text.isascii() or (text.isalpha() and text.lower() == text and max(text) < BEYOND_LATIN):
                if not marks:
                    return self._word(chunk)
                return self.words[letters] + self.words[marks]
        found = self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False)
        return self._pack(found.ids)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.chunked:
            plain = [t.decode("utf-8", "replace") for t in texts]
            coded = self.tokenizer.encode_batch_fast(plain, add_special_tokens=False)
            return [self._pack(c.ids) for c in coded]
        out = []
        for low in range(0, len(texts), BLOCK):
            if 2 * self.words.bytes >= self.limit:
                self.words.before = {}
                self.words = Words(self._ids, self.words)
            get = self.words.__getitem__
            out += [b"".join(map(get, self._parts(t))) for t in texts[low : low + BLOCK]]
        return out


def encoder(path: str) -> TextEncoder:
    """The encoder of a worker process for a file, kept from task to task."""
    return kept(("encoder", path), lambda: TextEncoder(path))
