"""Byte-level BPE of whole texts inside tasks.

A text is cut at each space that follows a character other than white space. No pre-token of the
pattern reaches across such a cut, so each word is encoded by itself and kept in a bounded cache;
the words of some megabytes of text that are not known yet are encoded together.
"""

from __future__ import annotations

import array
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex

from vaporlog.llm.rank_queue import PieceEncoder, encode_piece, read_ranks

#: Words (and pre-tokens) that a Python worker keeps. Results do not depend on it.
CACHE_SIZE = 400_000
#: Characters of text that are encoded together, about.
BLOCK = 10_000_000
#: White space before a space: the next pre-token may begin before that space.
UNSAFE = re.compile(r"\s ")
#: Pre-tokens above this many characters are encoded one by one: they hardly repeat.
LONG = 64


def pack_ids(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array.array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def ids_of(packed: bytes) -> np.ndarray:
    """Packed ids as numbers."""
    return np.frombuffer(packed, dtype="<u4")


class Encoder:
    """Texts to packed ids. `one` encodes a text, `many` words that each stand behind a space."""

    def __init__(self, one: Callable[[str], bytes], many: Callable[[list[str]], list[bytes]]) -> None:
        self.one, self.many = one, many
        self.words: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of all texts."""
        cut = [None if UNSAFE.search(text) else text.split(" ") for text in texts]
        needed: set[str] = set()
        for words in cut:
            if words:
                needed.update(words)
        self._learn(needed)
        find, done = self.words.__getitem__, []
        for text, words in zip(texts, cut, strict=True):
            if words is None:
                done.append(self.one(text))
            elif not words[0] and len(words) > 1:  # a leading space belongs to the next word
                done.append(b"".join(map(find, words[1:])))
            else:
                first = self.one(words[0])
                words[0] = ""
                done.append(first + b"".join(map(find, words[1:])))
        return done

    def _learn(self, needed: set[str]) -> None:
        missing = needed.difference(self.words)
        if len(self.words) + len(missing) > CACHE_SIZE:
            self.words = {word: self.words[word] for word in needed if word in self.words}
        plain = [word for word in missing if word and not word[0].isspace() and not word[-1].isspace()]
        if plain:
            self.words.update(zip(plain, self.many(plain), strict=True))
        for word in missing.difference(plain):
            self.words[word] = self.one(" " + word)


def blocks_of(texts: Iterator[str]) -> Iterator[list[str]]:
    """Lists of texts of some megabytes each."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= BLOCK or len(block) >= 16384:
            yield block
            block, size = [], 0
    if block:
        yield block


_encoders: dict[tuple, Encoder | Callable[[str], bytes]] = {}


def rank_queue_encoder(path: str, pattern: str = public_tokenizers.PATTERN) -> Encoder:
    """An encoder by the rank queue; one per worker and rank file."""
    if (path, pattern) not in _encoders:
        ranks, find_pieces = read_ranks(path), regex.compile(pattern).findall
        together = PieceEncoder(ranks)
        known: dict[str, bytes] = {}

        def learn(pieces: list[str]) -> None:
            missing = set(pieces).difference(known)
            if len(known) + len(missing) > CACHE_SIZE:
                known.clear()
                missing = set(pieces)
            short = []
            for piece in missing:
                data = piece.encode("utf-8")
                if data in ranks:
                    known[piece] = pack_ids([ranks[data]])
                elif len(piece) > LONG:
                    known[piece] = pack_ids(encode_piece(data, ranks))
                else:
                    short.append((piece, data))
            if short:
                known.update(zip([p for p, _ in short], together.encode([d for _, d in short]), strict=True))

        def one(text: str) -> bytes:
            return pack_ids([i for piece in find_pieces(text) for i in encode_piece(piece.encode("utf-8"), ranks)])

        def many(words: list[str]) -> list[bytes]:
            pieces = find_pieces(" " + " ".join(words))
            learn(pieces)
            packed = list(map(known.__getitem__, pieces))
            starts = [i for i, piece in enumerate(pieces) if piece[0] == " "]
            return [b"".join(packed[a:b]) for a, b in zip(starts, [*starts[1:], len(pieces)], strict=True)]

        _encoders[path, pattern] = Encoder(one, many)
    return _encoders[path, pattern]


def library_encoder(path: str, special: bool = True) -> Callable[[str], bytes]:
    """A function from a text to packed ids of the tokenizers library, without added special tokens.

    With `special`, strings of the file's special tokens in a text become those tokens, as the library's plain call
    has it; without, they are ordinary text. Where the same vocabulary lies beside the file as ranks, that is
    read: equal ids in a quarter of the time. Texts that hold a special token's string go to the library itself.
    """
    key = (path, special)
    if key not in _encoders:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not special

        def whole(text: str) -> bytes:
            return pack_ids(tokenizer.encode(text, add_special_tokens=False).ids)

        try:
            ranks = read_ranks(path.removesuffix(".json") + ".tiktoken")
        except FileNotFoundError:
            _encoders[key] = whole
        else:
            import tiktoken

            encode = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            ).encode_ordinary
            added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
            found = re.compile("|".join(map(re.escape, added))).search if added and special else None
            _encoders[key] = lambda text: whole(text) if found and found(text) else pack_ids(encode(text))
    return _encoders[key]


def texts_of(column: pa.Array) -> Iterator[str]:
    """Texts of an Arrow column one by one; null is empty."""
    for value in column:
        yield value.as_py() or ""
