"""Many Hamming distances at a time from bit planes stored vertically.

A plane holds one bit of 64 candidates per word. A query's planes of differences are added by carry-save adders into
vertical counters, which are compared with the lanes' radii after each slice of planes; words of which all lanes
exceed their radius are abandoned.
"""

from __future__ import annotations

import numpy as np

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bits of the narrowest sketch, planes added between two looks at the radius, units worked on at a time.
LEAST, SLICE, UNITS = 256, 128, 2048


def width_class(radius: np.ndarray) -> np.ndarray:
    """How often the narrowest sketch is doubled for these radii: a radius is a quarter of the bits at most, while sets that
    have nothing in common differ in nearly half of them."""
    return np.ceil(np.log2(np.maximum(4 * np.asarray(radius) / LEAST, 1)) - 1e-9).astype(np.int64)


def parity_sketches(codes: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """(records, bits / 8) bytes: for each record the parity of its codes in each residue class, a bit each.

    An element in one of two sets but not the other changes one bit, so the sketches of two sets never differ in more
    bits than the sets in elements: a distance over a radius proves that the sets differ by more than it.
    """
    out = []
    for low in range(0, len(offsets) - 1, 4096):
        part = offsets[low : low + 4097]
        m = len(part) - 1
        rows = np.repeat(np.arange(m), np.diff(part))
        at = rows * bits + (codes[part[0] : part[-1]] % np.uint64(bits)).astype(np.int64)
        out.append(np.packbits((np.bincount(at, minlength=m * bits).reshape(m, bits) & 1).astype(np.uint8), axis=1, bitorder="little"))
    return np.concatenate(out) if out else np.empty((0, bits // 8), np.uint8)


def folded(sketches: np.ndarray) -> np.ndarray:
    """The same sketches with half as many bits."""
    half = sketches.shape[1] // 2
    return sketches[:, :half] ^ sketches[:, half:]


def vertical(lanes: np.ndarray) -> np.ndarray:
    """(units, 64, k) of 0 and 1 as k planes of one word per unit."""
    packed = np.packbits(lanes.transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")[:, :, 0]


def add(planes: np.ndarray) -> list[np.ndarray]:
    """Vertical counters, lowest bit first, of the number of set bits over the first axis: a tree of carry-save adders."""
    columns: dict[int, list[np.ndarray]] = {0: [planes]}
    out, weight = [], 0
    while weight in columns:
        slab = np.concatenate(columns.pop(weight))
        carries = []
        while len(slab) >= 3:
            third = len(slab) // 3
            a, b, c, rest = slab[:third], slab[third : 2 * third], slab[2 * third : 3 * third], slab[3 * third :]
            ab = a ^ b
            carries.append((a & b) | (ab & c))
            slab = np.concatenate([ab ^ c, rest])
        if len(slab) == 2:
            carries.append((slab[0] & slab[1])[None])
            slab = (slab[0] ^ slab[1])[None]
        out.append(slab[0])
        weight += 1
        if carries:
            columns[weight] = carries
    return out


def plus(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two vertical counters."""
    zero = np.zeros_like(x[0] if x else y[0])
    carry, out = zero, []
    for i in range(max(len(x), len(y))):
        a, b = (x[i] if i < len(x) else zero), (y[i] if i < len(y) else zero)
        ab = a ^ b
        out.append(ab ^ carry)
        carry = (a & b) | (ab & carry)
    return [*out, carry]


def above(counter: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose counter is over their radius (planes, lowest bit first)."""
    zero = np.zeros_like(radius[0])
    over = zero
    for i in range(max(len(counter), len(radius))):
        c, r = (counter[i] if i < len(counter) else zero), (radius[i] if i < len(radius) else zero)
        over = (c & ~r) | (~(c ^ r) & over)
    return over


def stored(sketches: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(bits, words) planes: bit b of the 64 candidates of each word, stored once for all queries."""
    lanes = np.unpackbits(sketches[words], axis=2, bitorder="little")
    return vertical(lanes)


def within(planes: np.ndarray, sketches: np.ndarray, query: np.ndarray, word: np.ndarray, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units and lanes where query and candidate differ in no more bits than the lane's radius.

    planes: as ``stored``; sketches: (records, bits / 8). A unit compares one query with one word of candidates:
    ``query`` and ``word`` say which, ``radii`` (units, 64) has the radius of each lane, negative where there is no
    candidate.
    """
    found_u, found_l = [], []
    most = int(radii.max(initial=0)).bit_length() or 1
    for start in range(0, len(query), UNITS):
        q, w, r = query[start : start + UNITS], word[start : start + UNITS], radii[start : start + UNITS]
        valid = vertical((r >= 0).astype(np.uint8)[:, :, None])[0]
        radius = vertical(((np.maximum(r, 0)[:, :, None] >> np.arange(most)) & 1).astype(np.uint8))
        alive, counter = np.flatnonzero(valid), []
        near = valid[alive]
        for low in range(0, len(planes), SLICE):
            if not len(alive):
                break
            own = np.unpackbits(sketches[q[alive], low // 8 : (low + SLICE) // 8], axis=1, bitorder="little").T
            unlike = planes[low : low + SLICE, w[alive]] ^ (own.astype(np.uint64) * ONES)
            counter = plus(counter, add(unlike)) if counter else add(unlike)
            near = ~above(counter, radius[:, alive]) & valid[alive]
            keep = near != 0
            if not keep.all():
                alive, counter, near = alive[keep], [c[keep] for c in counter], near[keep]
        if len(alive):
            bits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            unit, lane = np.nonzero(bits)
            found_u.append(start + alive[unit])
            found_l.append(lane)
    none = np.empty(0, np.int64)
    return (np.concatenate(found_u), np.concatenate(found_l)) if found_u else (none, none)
