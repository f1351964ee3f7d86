"""Range asymmetric numeral system with a static table, over independent blocks of interleaved lanes.

A block holds at most BLOCK symbols. Symbol i of a block belongs to lane i mod LANES; every lane has a state of its
own, and the lanes of a block share one stream of 32-bit words in the order in which a decoder needs them. Blocks
know nothing of each other, so all blocks of a call are worked on together, one step of all their lanes at a time.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16384
LANES = 32
#: States stay at or above this between symbols.
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)


class Table:
    """Frequencies of symbols 0, 1, ... that add up to a power of two; a symbol that was never counted has none."""

    def __init__(self, freq: np.ndarray) -> None:
        total = int(freq.sum(dtype="uint64"))
        if total < 1 or total & (total - 1) or total > 1 << 30:
            raise ValueError("frequencies must add up to a power of two, at most 2^30")
        self.bits = total.bit_length() - 1
        self.size = len(freq)
        # one more symbol, the whole range, changes no state: it fills up the last step of a block
        self.freq = np.append(freq, total).astype("uint64")
        self.start = np.append(np.cumsum(freq) - freq, 0).astype("uint64")
        self.symbol = np.repeat(np.arange(self.size, dtype="uint32"), freq)

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Scale counts: in proportion, but every counted symbol keeps a place of its own."""
        counts = np.asarray(counts, "uint64")
        seen = int(np.count_nonzero(counts))
        if not seen:
            return cls(np.ones(1, "uint32"))
        total, places = int(counts.sum(dtype=object)), 1 << max(12, seen.bit_length() + 2)
        freq = np.array([max(1, c * places // total) if c else 0 for c in counts.tolist()], "int64")
        over = int(freq.sum()) - places
        for at in np.argsort(-freq, kind="stable").tolist():
            if not over:
                break
            take = min(over, int(freq[at]) - 1) if over > 0 else over
            freq[at] -= take
            over -= take
        return cls(freq.astype("uint32"))


def block_lengths(n: int) -> np.ndarray:
    """Symbols of each block of n symbols."""
    full, rest = divmod(n, BLOCK)
    return np.array([BLOCK] * full + [rest] * (rest > 0), "int64")


def encode(symbols: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """States (blocks x LANES), words, and the number of words of every block."""
    lengths = block_lengths(len(symbols))
    blocks = len(lengths)
    if not blocks:
        return np.empty((0, LANES), "uint64"), np.empty(0, "uint32"), np.empty(0, "int64")
    if int(symbols.max()) >= table.size or not table.freq[symbols].all():
        raise ValueError("a symbol has no frequency")
    steps = -(-int(lengths.max()) // LANES)
    grid = np.full((blocks, steps * LANES), table.size, "uint32")
    for b in range(blocks):
        grid[b, :lengths[b]] = symbols[b * BLOCK:b * BLOCK + lengths[b]]
    grid = np.ascontiguousarray(grid.reshape(blocks, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    bits, room = np.uint64(table.bits), np.uint64(63 - table.bits)
    state = np.full(blocks * LANES, LOW)
    words, lanes = [], []
    for step in range(steps - 1, -1, -1):
        freq, start = table.freq[grid[step]], table.start[grid[step]]
        full = np.flatnonzero(state >= freq << room)
        if len(full):
            words.append(state[full].astype("uint32"))
            lanes.append(full)
            state[full] >>= WORD
        times = state // freq
        state += (times << bits) - times * freq + start
    if not words:
        return state.reshape(blocks, LANES), np.empty(0, "uint32"), np.zeros(blocks, "int64")
    block = np.concatenate(lanes[::-1]) // LANES
    order = np.argsort(block, kind="stable")
    return state.reshape(blocks, LANES), np.concatenate(words[::-1])[order], np.bincount(block, minlength=blocks)


def decode(n: int, states: np.ndarray, words: np.ndarray, counts: np.ndarray, table: Table) -> np.ndarray:
    """The n symbols of blocks as `encode` gives them. A stream that does not end as it began is an error."""
    lengths = block_lengths(n)
    blocks = len(lengths)
    if len(states) != blocks or len(counts) != blocks or int(counts.sum()) != len(words):
        raise ValueError("blocks do not fit the number of symbols")
    if not blocks:
        return np.empty(0, "uint32")
    steps = -(-int(lengths.max()) // LANES)
    out = np.empty((steps, blocks * LANES), "uint32")
    state = states.reshape(-1).astype("uint64")
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    at = np.cumsum(counts) - counts
    stop = at + counts
    words = np.append(words, np.uint32(0)).astype("uint64")
    lane = np.arange(LANES)
    whole = int(lengths.min()) // LANES
    for step in range(steps):
        slot = state & mask
        symbol = table.symbol[slot]
        then = table.freq[symbol] * (state >> bits) + slot - table.start[symbol]
        if step >= whole:  # some block ends here: its other lanes rest
            rest = (lengths[:, None] <= step * LANES + lane).reshape(-1)
            then[rest] = state[rest]
        out[step] = symbol
        short = (then < LOW).reshape(blocks, LANES)
        if short.any():
            places = short.cumsum(axis=1)
            wanted = (at[:, None] + places - 1)[short]
            if int(wanted.max()) >= len(words) - 1:
                raise ValueError("a block ends too early")
            flat = short.reshape(-1)
            then[flat] = then[flat] << WORD | words[wanted]
            at += places[:, -1]
        state = then
    if (state != LOW).any() or (at != stop).any():
        raise ValueError("a block does not end where it began")
    grid = out.reshape(steps, blocks, LANES).transpose(1, 0, 2).reshape(blocks, -1)
    if blocks == 1:
        return grid[0, :n].copy()
    return np.concatenate([grid[:-1, :BLOCK].reshape(-1), grid[-1, :lengths[-1]]])
