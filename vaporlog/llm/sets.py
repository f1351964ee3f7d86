"""Word shingles of whole texts as sorted 64-bit numbers, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)


def mixed(numbers: np.ndarray) -> np.ndarray:
    """Spread unsigned 64-bit numbers evenly; one to one."""
    numbers = (numbers ^ (numbers >> _SHIFT)) * _FACTOR
    numbers = (numbers ^ (numbers >> np.uint64(27))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return numbers ^ (numbers >> _SHIFT)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.lower().split()


def word_numbers(words: list[bytes]) -> np.ndarray:
    """A 64-bit number for each word."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "uint64", len(words))


def shingle_numbers(words: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit number for each run of `length` words, in order."""
    n = len(words) - length + 1
    result = words[:n]
    for i in range(1, length):
        result = mixed(result) + words[i:i + n]
    return mixed(result)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    numbers = np.sort(numbers)
    return numbers[np.append(True, numbers[1:] != numbers[:-1])] if len(numbers) else numbers


def shingle_set(text: bytes, length: int) -> np.ndarray:
    """Sorted distinct shingles; with fewer words the whole sequence is one; without words none."""
    words = words_of(text)
    if not words:
        return np.empty(0, "uint64")
    return distinct(shingle_numbers(word_numbers(words), min(length, len(words))))


def overlap(left: np.ndarray, right: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(left) > len(right):
        left, right = right, left
    if not len(left):
        return 0
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int(np.count_nonzero(right[at] == left))
