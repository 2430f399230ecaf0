"""Token ids of a byte-level BPE file, one dictionary lookup for each pre-token.

A pre-token's ids do not depend on what stands around it, so each distinct pre-token is
encoded once by the tokenizers library and kept in a bounded cache. Texts with characters
outside those whose class is fixed here go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

# Fixed value: characters whose class is known here, and the letters of them; the digits are 0-9, the white space is tab, line ends and space.
PLAIN = re.compile(r"[\t\n\r -~¡§«°±¶·»¿-ɏ‐-―‘-„†-•…€]*")
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
# Fixed value: the byte-level pre-tokenizer's pattern, for these characters.
PIECE = re.compile(rf""" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^{LETTERS}0-9\t\n\r ]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+""")
# Fixed value: printable bytes that the byte-level alphabet keeps as they are.
KEPT = (range(33, 127), range(161, 173), range(174, 256))
CACHE_ENTRIES = 500_000  # of the newer half of a cache; the older half has as many at most
CACHE_CHARS = 64  # longer pre-tokens are not kept


def default_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[int, int]:
    """Byte -> character of the byte-level alphabet: bytes that are not kept follow from 256 on."""
    kept = {b for part in KEPT for b in part}
    rest = [b for b in range(256) if b not in kept]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(rest)}


class Cache(dict):
    """Values made when they are first asked for. When the newer ones are full they become the older ones, which are asked before a value is made again."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key) or self.make(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.entries:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Ids of texts as little-endian bytes, two to an id where the vocabulary allows."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        setup = json.loads(self.tokenizer.to_str())
        pre = setup["pre_tokenizer"] or {}
        self.bytelevel = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not setup["normalizer"] and setup["model"]["type"] == "BPE" and not setup["model"].get("dropout")
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.units = [i.to_bytes(int(self.dtype[-1]), "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.alphabet = byte_alphabet()
        self.cache = Cache(self._piece)

    def pack(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.units[i] for i in ids])

    def plain(self, text: str) -> bool:
        return self.bytelevel and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; a special string is a piece of its own."""
        if not self.bytelevel:
            raise ValueError("pre-tokens can be counted for byte-level BPE files only")
        if self.plain(text):
            return PIECE.findall(text)
        out = []
        for part in self.split.split(text) if self.split else [text]:
            if part in self.special:
                out.append(part)
            elif part:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.special:
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]

    def _piece(self, piece: str) -> bytes:
        units = self.units
        own = "Ġ" + piece[1:] if piece[0] == " " and piece.isascii() and piece[1:].isalnum() else piece.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([units[t.id] for t in self.model.tokenize(own)])

    def ids(self, text: str) -> bytes:
        if self.plain(text):
            return b"".join(map(self.cache.__getitem__, PIECE.findall(text)))
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file, made once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batches: Iterator, path: str, end: int) -> Iterator[tuple]:
    """For each Arrow batch with a text column: the batch, and each text's ids with the end id."""
    own = encoder(path)
    last = own.pack([end])
    for batch in batches:
        yield batch, [own.ids(t) + last for t in batch.column("text").to_pylist()]
