"""Anchors of windows: equal windows have the same anchor at the same offset, so only anchors need to be compared first.

Every window of `window` symbols holds window - gram + 1 grams; its anchor is the one with the smallest mixed hash, the
leftmost of equals. What a window holds decides its anchor and nothing else does. Neighbouring windows mostly share an
anchor, so a text has about 2 / (window - gram + 2) anchors per symbol, each for one run of windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Bits of an anchor's sort key that hold its place in a chunk; chunks are at most that long.
PLACE = 26
#: Symbols handled at once: arrays of this length stay in the cache.
CHUNK = 1 << 18
LONGEST = 1 << 20
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: A number for each byte, drawn once by rule.
BYTES = np.random.Generator(np.random.PCG64(20)).integers(0, 2**64, 256, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _A
    return x ^ (x >> np.uint64(29))


def ladder(symbols: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of 1, 2, 4 ... symbols from each place on (the last places of a rung are not of use)."""
    rungs, size = [symbols], 1
    while size * 2 <= longest:
        low = rungs[-1]
        up = mix(low)
        up[:-size] = up[:-size] * _B + low[size:]
        rungs.append(up)
        size *= 2
    return rungs


def hashes(rungs: list[np.ndarray], length: int, places: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Hashes of `length` symbols from each of the places on; a place too near the end has a hash without meaning."""
    n = len(rungs[0])
    where = np.arange(n)[places] if isinstance(places, slice) else places
    found, offset = np.zeros(len(where), np.uint64), 0
    for k in range(length.bit_length() - 1, -1, -1):
        if length >> k & 1:
            found = mix(found) * _B + rungs[k][np.minimum(where + offset, n - 1)]
            offset += 1 << k
    return mix(found)


class Anchors(NamedTuple):
    """Of a chunk: rungs of hashes; for each anchor its document, the runs' first and last window start and the anchor's
    place (all counted within the document), what to add to a place for its place in the chunk, and the hash of the gram."""

    rungs: list[np.ndarray]
    doc: np.ndarray
    first: np.ndarray
    last: np.ndarray
    place: np.ndarray
    base: np.ndarray
    gram: np.ndarray


def chunks(lengths: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """(document, offset, length) pieces such that every window lies in exactly one piece; pieces of a list go together."""
    held: list[tuple[int, int, int]] = []
    total = 0
    for doc in np.flatnonzero(lengths >= window).tolist():
        n, offset = int(lengths[doc]), 0
        while n - offset >= window:
            size = min(n - offset, LONGEST)
            held.append((doc, offset, size))
            total += size
            offset += size - window + 1
            if total >= CHUNK:
                yield held
                held, total = [], 0
    if held:
        yield held


def anchors(symbols: np.ndarray, starts: np.ndarray, window: int, gram: int) -> Iterator[Anchors]:
    """Anchors of documents whose symbols (64-bit numbers) stand one after the other from starts on, chunk by chunk."""
    span = window - gram + 1
    for pieces in chunks(np.diff(starts), window):
        doc, offset, size = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        own = np.concatenate([symbols[starts[d] + o : starts[d] + o + n] for d, o, n in pieces])
        if own.dtype == np.uint8:
            own = BYTES[own]
        rungs = ladder(own, window)
        base = np.cumsum(size) - size
        grams = hashes(rungs, gram)
        # Grams and windows must not run over the end of their piece.
        key = (mix(grams) >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(own), dtype=np.uint64)
        whole = np.zeros(len(own), bool)
        for b, n in zip(base.tolist(), size.tolist(), strict=True):
            key[b + n - gram + 1 : b + n] = np.uint64(2**64 - 1)
            whole[b : b + n - window + 1] = True
        least, width = key, 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :]) if span > width else least
        at = np.flatnonzero(whole)
        chosen = (least[at] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        begins = np.flatnonzero(np.diff(chosen, prepend=-1))
        ends = np.append(begins[1:], len(chosen)) - 1
        place = chosen[begins]
        piece = np.searchsorted(base, place, side="right") - 1
        inside = offset[piece] - base[piece]
        yield Anchors(rungs, doc[piece], at[begins] + inside, at[ends] + inside, place + inside, -inside, grams[place])
