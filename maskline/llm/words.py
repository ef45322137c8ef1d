"""Words of many texts at once: places and hashes, with numpy over the bytes."""

from __future__ import annotations

import hashlib
import secrets

import numpy as np

from maskline.llm.anchors import mix
from maskline.llm.common import BLANK_BYTES

NOT_BLANK = np.ones(256, bool)
NOT_BLANK[list(BLANK_BYTES)] = False
#: A to Z as a to z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Longer words are hashed by a digest, all others eight bytes at a time.
LONG = 1024


def key() -> tuple[int, int]:
    """What hashes depend on, drawn at random: nobody can write words that collide for a key not yet drawn. All stages of
    one run must use the same."""
    return secrets.randbits(64) | 1, secrets.randbits(64)


#: For hashes that no result rests on alone, and that must be the same in every run.
FIXED = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Words:
    """Words of texts that stand one after the other in data, from starts on: maximal runs of `part` bytes.

    start and end are byte places, hash is 64 bits of a word's bytes under a key, first holds the eight bytes from its start
    on, and the words of text k are those from of_doc[k] to of_doc[k + 1].
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, part: np.ndarray = NOT_BLANK, key: tuple[int, int] = FIXED):
        word = part[data]
        edge = np.diff(word.astype(np.int8), prepend=0, append=0)
        # A text's end ends a word.
        joint = np.unique(starts[(starts > 0) & (starts < len(word))])
        joint = joint[word[joint - 1] & word[joint]]
        self.start = np.sort(np.concatenate([np.flatnonzero(edge == 1), joint]))
        self.end = np.sort(np.concatenate([np.flatnonzero(edge == -1), joint]))
        self.of_doc = np.searchsorted(self.start, starts)
        factor, seed = np.uint64(key[0]), np.uint64(key[1])
        size = self.end - self.start
        # Eight bytes from each place on; those behind the word are masked.
        eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
        self.first = eight[self.start]
        self.hash = mix(size.astype(np.uint64) ^ seed) * factor
        at = 0
        some = np.flatnonzero(size <= LONG)
        while len(some):
            part = eight[self.start[some] + at]
            left = size[some] - at
            part &= np.where(left < 8, (np.uint64(1) << (8 * np.clip(left, 0, 7)).astype(np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
            self.hash[some] = mix(self.hash[some] ^ part) * factor
            at += 8
            some = some[left > 8]
        for k in np.flatnonzero(size > LONG).tolist():
            word = data[self.start[k] : self.end[k]].tobytes()
            told = hashlib.blake2b(word, digest_size=8, key=key[1].to_bytes(8, "little") + key[0].to_bytes(8, "little")).digest()
            self.hash[k] = np.frombuffer(told, np.uint64)[0]
        self.hash = mix(self.hash)
