"""Byte-pair encoding with a queue of merge ranks, for pre-tokens of any length.

Ranks waiting to be merged are bits of a two-level bitmap; find-first-set gives the lowest.
Each rank has a bucket of positions in a linked list of tokens, leftmost first. An entry whose
token is gone or whose pair has changed since is stale and skipped when it comes up.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np

#: Bits of a rank below the top level of the bitmap.
LOW_BITS = 8
LOW_MASK = (1 << LOW_BITS) - 1


class RankQueue:
    """Buckets of positions by rank."""

    __slots__ = ("top", "blocks", "buckets")

    def __init__(self) -> None:
        self.top = 0
        self.blocks: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            heappush(self.buckets[rank], position)
            return
        self.buckets[rank] = [position]
        block = rank >> LOW_BITS
        self.top |= 1 << block
        self.blocks[block] = self.blocks.get(block, 0) | 1 << (rank & LOW_MASK)

    def push_all(self, rank: int, positions) -> None:
        """Append to a bucket, in any order; for use with pop_all."""
        if rank in self.buckets:
            self.buckets[rank].extend(positions)
            return
        self.buckets[rank] = list(positions)
        block = rank >> LOW_BITS
        self.top |= 1 << block
        self.blocks[block] = self.blocks.get(block, 0) | 1 << (rank & LOW_MASK)

    def pop_all(self) -> tuple[int, list[int]]:
        """The lowest rank and its whole bucket; only while `top` is not 0."""
        top = self.top
        block = (top & -top).bit_length() - 1
        bits = self.blocks[block]
        low = bits & -bits
        rank = block << LOW_BITS | low.bit_length() - 1
        self.blocks[block] = bits ^ low
        if bits == low:
            self.top = top & (top - 1)
        return rank, self.buckets.pop(rank)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; only while `top` is not 0."""
        top = self.top
        block = (top & -top).bit_length() - 1
        bits = self.blocks[block]
        low = bits & -bits
        rank = block << LOW_BITS | low.bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heappop(bucket)
        del self.buckets[rank]
        self.blocks[block] = bits ^ low
        if bits == low:
            self.top = top & (top - 1)
        return rank, bucket[0]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token. A piece that is a token itself is that token.

    A token is known by where it begins; `end` leads to the next one, `before` to the last.
    """
    find = ranks.get
    whole = find(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair = [find(piece[i:i + 2], -1) for i in range(n - 1)]
    pair.append(-1)
    queue = RankQueue()
    push, pop = queue.push, queue.pop
    for i, rank in enumerate(pair):
        if rank >= 0:
            push(rank, i)
    while queue.top:
        rank, i = pop()
        if pair[i] != rank:
            continue
        j = end[i]
        k = end[i] = end[j]
        pair[j] = rank = -1
        if k < n:
            before[k] = i
            rank = find(piece[i:end[k]], -1)
            if rank >= 0:
                push(rank, i)
        pair[i] = rank
        h = before[i]
        if h >= 0:
            rank = find(piece[h:k], -1)
            if rank != pair[h]:
                pair[h] = rank
                if rank >= 0:
                    push(rank, h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def decode_ids(ids, tokens: list[bytes]) -> bytes:
    """The bytes that ids stand for."""
    return b"".join(map(tokens.__getitem__, ids))


class PieceEncoder:
    """The rank queue over many pre-tokens at once.

    One linked list holds all pieces; no pair reaches from one into the next. What comes up for a rank is
    merged in all pieces together, the leftmost place of each; its further places go back into the bucket,
    as a merge can make a pair of lower rank.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.of_byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], "int64")
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.codes = np.array(sorted(pairs), "int64")
        self.pair_ranks = np.array([pairs[code] for code in self.codes.tolist()] + [-1], "int64")

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of what pairs of tokens make together; -1 where that is no token."""
        wanted = left << 32 | right
        at = np.searchsorted(self.codes, wanted)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == wanted, self.pair_ranks[at], -1) if len(self.codes) else np.full(len(at), -1)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of every piece; none is empty."""
        lengths = np.fromiter(map(len, pieces), "int64", len(pieces))
        token = self.of_byte[np.frombuffer(b"".join(pieces), "uint8")]
        n = len(token)
        owner = np.repeat(np.arange(len(pieces)), lengths)
        place = np.arange(n)
        ends = np.cumsum(lengths)
        after, before = place + 1, place - 1
        after[ends - 1] = -1
        before[ends - lengths] = -1
        pair = np.full(n, -1, "int64")
        inner = np.flatnonzero(after >= 0)
        pair[inner] = self.pair_rank(token[inner], token[inner + 1])
        alive = np.ones(n, bool)

        queue = RankQueue()
        buckets = queue.buckets
        ready = np.flatnonzero(pair >= 0)
        ready = ready[np.argsort(pair[ready], kind="stable")]
        levels, starts = np.unique(pair[ready], return_index=True)
        for rank, places in zip(levels.tolist(), np.split(ready, starts[1:]), strict=False):
            queue.push_all(rank, places.tolist())
        while queue.top:
            rank, waiting = queue.pop_all()
            at = np.array(waiting)
            at = at[pair[at] == rank]
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                at = at[np.append(True, at[1:] != at[:-1])]
                whose = owner[at]
                first = np.ones(len(at), bool)
                first[1:] = whose[1:] != whose[:-1]
                if not first.all():
                    queue.push_all(rank, at[~first].tolist())
                    at = at[first]
            gone = after[at]
            then = after[gone]
            token[at], after[at] = rank, then
            alive[gone], pair[gone], pair[at] = False, -1, -1
            inside = then >= 0
            left, right = at[inside], then[inside]
            before[right] = left
            prior = before[at]
            behind = prior >= 0
            lefts, rights = np.concatenate([left, prior[behind]]), np.concatenate([right, at[behind]])
            if len(lefts):
                found = pair[lefts] = self.pair_rank(token[lefts], token[rights])
                useful = found >= 0
                for level, where in zip(found[useful].tolist(), lefts[useful].tolist(), strict=True):
                    if level in buckets:
                        buckets[level].append(where)
                    else:
                        queue.push_all(level, (where,))
        packed = token[alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(np.bincount(owner[alive], minlength=len(pieces)))).tolist()
        return [packed[a:b] for a, b in zip([0, *stops], stops, strict=False)]
