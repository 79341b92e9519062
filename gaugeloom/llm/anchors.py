"""Content-defined anchors: equal byte strings of a fixed width pick equal anchors, wherever they stand."""

from __future__ import annotations

import numpy as np

from gaugeloom.llm.shingles import mix, powers

#: Bytes of a window; of the gram at its anchor. Each window holds WIDTH - GRAM + 1 grams and its anchor is the one of least hash.
WIDTH, GRAM = 50, 20
_rng = np.random.Generator(np.random.PCG64(77))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xA0761D6478BD642F
_INVERSE = pow(_BASE, -1, 2**64)
#: Low bits of the sort key hold the place, falling, so that the last of equal grams is taken.
_PLACE = np.uint64((1 << 24) - 1)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: (text, first window, last window, anchor hash, hash of the run's bytes).

    Windows lie within a text; a run spans the bytes from its first window's start to its last one's end, at
    most 2 * WIDTH - GRAM.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf)
    if n < WIDTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    up = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * powers(_BASE, n))))
    down = powers(_INVERSE, n)
    grams = mix((up[GRAM:] - up[:-GRAM]) * down[: n - GRAM + 1])
    place = np.arange(len(grams), dtype=np.uint64) & _PLACE
    least = (grams & ~_PLACE) | (_PLACE - place)
    many = WIDTH - GRAM + 1
    span = 1
    while 2 * span <= many:  # minima over 2, 4, 8, ... grams, then two that overlap
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < many:
        least = np.minimum(least[: len(least) - (many - span)], least[many - span :])
    begin = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), np.maximum(sizes - WIDTH + 1, 0))
    window = np.arange(len(text)) - np.repeat(np.cumsum(np.maximum(sizes - WIDTH + 1, 0)) - np.maximum(sizes - WIDTH + 1, 0), np.maximum(sizes - WIDTH + 1, 0))
    at = begin[text] + window
    key = least[at]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    s, e = at[first], at[last] + WIDTH
    # the anchor's place within the run tells runs apart that have equal bytes by chance
    whole = mix((up[e] - up[s]) * down[s] + (e - s).astype(np.uint64))
    return text[first], window[first], window[last], mix(key[first] & ~_PLACE), whole
