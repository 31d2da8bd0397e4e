"""Line dedup by a segment-partition edit join.

Equal lines are found by their 128-bit hashes.  Among distinct lines, one of
length n within k edits of another, where k grows with n, holds at least one
of the k + 1 segments into which the shorter line is cut, at a place that the
lengths and the number of the segment confine.  The least gram of a segment is
its index key, the least grams of all windows of a line are its probes, and
the keys of a line are among its probes, so that one pass over the text finds
both.  They go to tasks as packed columns, dealt by key; a task sorts them by
key and place, and entries at places that fit, with the same characters around
them as far as the segment reaches, make a candidate pair.  A banded edit
distance, its deltas held in bits, verifies the pairs in tiles, to which each
line is sent once.
A line goes if an equal line or one within k edits stands earlier in the corpus.

Lines are numbered in the order of the corpus.  Most near ones are settled
first, each against the earliest line with which it shares a least gram; the
join of all segments then looks only for pairs whose later line is open.
Counts of characters in classes refuse most candidates before they are verified.
Lines that share much text and are not near must be compared pair by pair: the
pairs of such a group grow with its square, what is shuffled does not.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import WORD_PATTERN, discard, documents, materialise, python_ready, shuffle_partitions

#: A line may have one edit per so many characters of the shorter line.
CHARS_PER_EDIT = 24
#: Least characters whose hash is a key, and the multiplier of that hash.
GRAM, FACTOR = 12, 0x2545F4914F6CDD1D
#: A key has as many characters as its window, less so many at most.
SPARE = 7
#: Passes among which the keys are dealt; each holds so small a part of them in shuffle files.
SHARES = 3
#: Entries that a task is to have about, and matches that it looks at together.
ENTRIES, MATCHES = 1_500_000, 1_000_000
#: Pairs that a tile of a large group has about, pairs that one task verifies about, and pairs collected for one call.
TILE, VERIFIED, TOGETHER = 100_000, 20_000, 10_000
#: Hashes whose least gram in a line lets it meet the earliest line with the same one, before the join of all segments.
SETTLING = 4
#: Classes of characters that are counted, 8 bits each.
CLASSES = 8
#: Pairs of lines verified together, and steps after which those decided are left out.
PAIRS, STEPS = 1024, 16
#: Of fewer pairs for each word of a band, every pair is verified alone.
FEW = 24


def edits_allowed(chars):
    """Edits within which a line of so many characters has near duplicates; grows with the line, without a limit."""
    return chars // CHARS_PER_EDIT


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k, for bands of any width; see :func:`within_all`."""
    if len(a) < len(b):
        a, b = b, a
    gap = len(a) - len(b)
    if gap > k:
        return False
    where = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << (2 * k + 1)) - 1
    plus, minus, edits = full >> k << k, 0, gap
    for j, c in enumerate(b):
        equal = where.get(c, 0)
        equal = (equal >> (j - k) if j >= k else equal << (k - j)) & full
        zero = ((((equal & plus) + plus) ^ plus) | equal | minus) & full
        edits += not zero >> (k + gap) & 1
        if edits > k:
            return False
        more, less = minus | ~(zero | plus) & full, zero & plus
        plus, minus = less | ~(zero >> 1 | more) & full, zero >> 1 & more
    return True


def _matrix(lines: list[str], before: int, width: int, fill: int) -> np.ndarray:
    """Code points of the lines as rows, ``before`` places from the left, ``fill`` elsewhere."""
    out = np.full((len(lines), width), fill, np.uint32)
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(lines)), n)
    out[row, before + np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)] = points
    return out


def _band(a: list[str], b: list[str], k: np.ndarray, bits: int) -> np.ndarray:
    """:func:`within_all` of pairs whose 2 k + 1 diagonals fit in so many bits; no b is longer than its a.

    Bit t of a word after j characters of b stands for j - half + t characters
    of a.  ``plus`` and ``minus`` mark where the distance grows or falls by one
    from the bit below, ``zero`` where it does not grow along the diagonal; the
    edits are counted along the diagonal on which both lines end.
    """
    word, half = np.dtype(f"<u{bits // 8}").type, bits // 2 - 1
    n = np.fromiter(map(len, b), np.int64, len(b))
    gap = np.fromiter(map(len, a), np.int64, len(a)) - n
    steps = int(n.max(initial=0))
    left, right = _matrix(a, half, half + max(map(len, a)) + bits + steps, 0xFFFFFFFF), _matrix(b, 0, steps, 0xFFFFFFFE)
    out, alive, edits = gap <= k, np.arange(len(a)), gap.copy()
    plus, minus = np.full(len(a), (1 << bits) - (1 << half), word), np.zeros(len(a), word)
    diagonal, one = (gap + half).clip(0, bits - 1).astype(word), word(1)
    for j in range(steps):
        if j % STEPS == 0:
            over = edits > k[alive]
            out[alive[over]] = False
            stays = ~over & (n[alive] > j)
            if not stays.all():
                alive, edits, plus, minus, diagonal = alive[stays], edits[stays], plus[stays], minus[stays], diagonal[stays]
                left, right = left[stays], right[stays]
            if not len(alive):
                return out
        same = left[:, j:j + bits] == right[:, j:j + 1]
        equal = np.packbits(same, axis=1, bitorder="little").view(word)[:, 0]
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        edits += ((zero >> diagonal & one) == 0) & (n[alive] > j)
        more, less = minus | ~(zero | plus), zero & plus
        plus, minus = less | ~(zero >> one | more), zero >> one & more
    out[alive[edits > k[alive]]] = False
    return out


def _wide(a: list[str], b: list[str], k: np.ndarray, words: int) -> np.ndarray:
    """:func:`_band` with so many words of 64 bits a pair, the lowest first."""
    bits, half = 64 * words, 32 * words - 1
    n = np.fromiter(map(len, b), np.int64, len(b))
    gap = np.fromiter(map(len, a), np.int64, len(a)) - n
    steps = int(n.max(initial=0))
    left, right = _matrix(a, half, half + max(map(len, a)) + bits + steps, 0xFFFFFFFF), _matrix(b, 0, steps, 0xFFFFFFFE)
    out, alive, edits, one, last = gap <= k, np.arange(len(a)), gap.copy(), np.uint64(1), np.uint64(63)
    start = [((1 << bits) - (1 << half)) >> 64 * w & 0xFFFFFFFFFFFFFFFF for w in range(words)]
    plus, minus = [np.full(len(a), v, np.uint64) for v in start], [np.zeros(len(a), np.uint64) for _ in start]
    diagonal = (gap + half).clip(0, bits - 1)
    for j in range(steps):
        if j % STEPS == 0:
            over = edits > k[alive]
            out[alive[over]] = False
            stays = ~over & (n[alive] > j)
            if not stays.all():
                alive, edits, diagonal, left, right = alive[stays], edits[stays], diagonal[stays], left[stays], right[stays]
                plus, minus = [v[stays] for v in plus], [v[stays] for v in minus]
            if not len(alive):
                return out
            word, bit, every = diagonal // 64, (diagonal % 64).astype(np.uint64), np.arange(len(alive))
        same = left[:, j:j + bits] == right[:, j:j + 1]
        equal = np.packbits(same, axis=1, bitorder="little").view(np.uint64)
        zero, more, carry = [], [], np.zeros(len(alive), np.uint64)
        for w in range(words):
            here = equal[:, w]
            part = here & plus[w]
            total = part + plus[w]
            both = total + carry
            carry = ((total < part) | (both < total)).astype(np.uint64)
            zero.append((both ^ plus[w]) | here | minus[w])
            more.append(minus[w] | ~(zero[w] | plus[w]))
        edits += ((np.stack(zero)[word, every] >> bit & one) == 0) & (n[alive] > j)
        for w in range(words):
            less = zero[w] & plus[w]
            down = zero[w] >> one | (zero[w + 1] << last if w + 1 < words else np.uint64(0))
            plus[w], minus[w] = less | ~(down | more[w]), down & more[w]
    out[alive[edits > k[alive]]] = False
    return out


def within_all(a: list[str], b: list[str], k: np.ndarray) -> np.ndarray:
    """Whether each pair is within its k edits: the diagonal band of the distance table kept as bits, all pairs a step at a time."""
    a, b = map(list, zip(*((x, y) if len(x) >= len(y) else (y, x) for x, y in zip(a, b)))) if len(a) else ([], [])
    out = np.zeros(len(a), bool)
    size = np.fromiter(map(len, a), np.int64, len(a))
    wide = np.select([k <= 3, k <= 7, k <= 15, k <= 31], [8, 16, 32, 64], 0)
    for bits in (8, 16, 32, 64):
        mine = np.flatnonzero(wide == bits)
        mine = mine[np.argsort(size[mine], kind="stable")]
        for begin in range(0, len(mine), PAIRS):
            at = mine[begin:begin + PAIRS]
            out[at] = _band([a[i] for i in at], [b[i] for i in at], k[at], bits)
    words = np.where(wide == 0, (2 * k + 65) // 64, 0)
    for many in np.unique(words[words > 0]).tolist():
        mine = np.flatnonzero(words == many)
        mine = mine[np.argsort(size[mine], kind="stable")]
        together = max(PAIRS // many, 1)
        for begin in range(0, len(mine), together):
            at = mine[begin:begin + together]
            if len(at) >= FEW * many:
                out[at] = _wide([a[i] for i in at], [b[i] for i in at], k[at], many)
            else:
                out[at] = [within(a[i], b[i], int(k[i])) for i in at]
    return out


def bags(lines: list[str]) -> np.ndarray:
    """Per line the numbers of characters of each class modulo 256, side by side in a long."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    kind = (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(61)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(lines)), n) * CLASSES + kind, minlength=len(lines) * CLASSES)
    return (counts % 256).astype(np.uint8).view("<i8")


def _fits(x: str, y: str, k: Column) -> Column:
    """Whether the counts of two lines allow k edits between them; differences wrap around like the counts."""
    apart = F.lit(0)
    for c in range(CLASSES):
        byte = [F.shiftrightunsigned(F.col(v), 8 * c).bitwiseAND(255) for v in (x, y)]
        far = F.abs(byte[0] - byte[1])
        apart = apart + F.least(far, 256 - far)
    return apart <= 2 * k


def _group(k: np.ndarray) -> np.ndarray:
    """Lines with k edits are keyed in groups of k: 1, 2, 3, 4 to 5, 6 to 7, 8 to 11, and so on."""
    part, power = np.frexp(k)
    return 2 * power + (part >= 0.75)


def _window(group: int) -> int:
    """Characters that each of the k + 1 segments of a line in this group has at least."""
    k = int((0.75 if group % 2 else 0.5) * 2 ** (group // 2))
    return CHARS_PER_EDIT * k // (k + 1)


def _grams(points: np.ndarray) -> np.ndarray:
    """Hashes of the GRAM characters from each place on, of three times four."""
    power = [np.uint64(pow(FACTOR, i, 1 << 64)) for i in range(5)]
    h = points.astype(np.uint64)
    for size in (1, 2):
        h = h[:-size] * power[size] + h[size:]
    h = (h[:-8] * power[4] + h[4:-4]) * power[4] + h[8:]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of the ``size`` values from each place on."""
    step = 1
    while 2 * step <= size:
        values, step = best(values[:len(values) - step], values[step:]), 2 * step
    return best(values[:len(values) - (size - step)], values[size - step:])


def _spare(k: np.ndarray) -> np.ndarray:
    """Characters by which the window of a line with k edits is longer than its keys."""
    groups, at = np.unique(_group(np.maximum(k, 1)), return_inverse=True)
    return np.array([min(SPARE, _window(g) - GRAM) for g in groups.tolist()], np.int64)[at]


def _segments(n: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Where a segment of a line of n characters begins."""
    parts = edits_allowed(n) + 1
    return segment * (n // parts) + np.maximum(0, segment - (parts - n % parts))


def _around(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of each of the eight characters before, and from each place on, the nearest in the lowest bits."""
    code = np.zeros(len(points) + 16, np.uint32)
    code[8:-8] = points.astype(np.uint64) * np.uint64(FACTOR) >> np.uint64(62)
    before, behind = np.zeros(len(points), np.uint32), np.zeros(len(points) + 1, np.uint32)
    for t in range(8):
        before |= code[7 - t:7 - t + len(points)] << np.uint32(2 * t)
        behind |= code[8 + t:9 + t + len(points)] << np.uint32(2 * t)
    return before, behind


def keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, at, number, around): all grams that each line looks up; ``number`` is that of the segment they are the key of, from 1, or 0.

    A segment's key is the least gram hash of its window.  A line that holds
    the window anywhere has that gram as the least one of some window, and so
    among those it looks up, which are the least of any of its windows.
    """
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    first, k = np.cumsum(n) - n, edits_allowed(n)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")
    none = np.empty(0, np.int64)
    out = [(none, none.astype(np.uint64), none, none, none.astype(np.uint32))]
    if len(points) >= CHARS_PER_EDIT:
        grams, (before, behind) = _grams(points), _around(points)
        # the shortest line that this one can be near to is so many edits shorter as that one may have
        low, high = _group(np.maximum((n + 1) // (CHARS_PER_EDIT + 1), 1)), _group(np.maximum(k, 1))
        number = np.zeros(len(points), np.int64)
        for group in np.unique(np.concatenate([low, high])).tolist():
            hit = np.flatnonzero((k > 0) & (low <= group) & (group <= high))
            gap = min(SPARE, _window(group) - GRAM)
            chars, wide = _window(group) - gap, gap + 1
            # a gram is told by its first and its last GRAM characters
            hashed = grams
            if chars > GRAM:
                hashed = (grams[:GRAM - chars] * np.uint64(FACTOR) ^ grams[chars - GRAM:]) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            own = hit[high[hit] == group]
            count = k[own] + 1
            row = np.repeat(own, count)
            segment = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            pos = first[row] + _segments(n[row], segment)
            pos = pos + np.argmin(hashed[pos[:, None] + np.arange(wide)], axis=1) if len(pos) else pos
            number[pos] = segment + 1
            size = n[hit] - chars + 1
            row = np.repeat(hit, size)
            place = np.arange(len(row)) + np.repeat(first[hit] - np.cumsum(size) + size, size)
            # lines side by side with zeros between, so that the least gram of a window over an edge is none of theirs
            spot = np.arange(len(row)) + np.repeat(np.arange(1, len(hit) + 1) * gap, size)
            side = np.zeros(len(row) + (len(hit) + 1) * gap, np.uint64)
            side[spot] = hashed[place]
            least_of = _sliding(_sliding(side, wide, np.minimum), wide, np.maximum)
            chosen = np.flatnonzero(least_of[spot - gap] == side[spot])
            pos, row = place[chosen], row[chosen]
            salt = np.uint64(group * 0xD6E8FEB86659FD93 % (1 << 64))
            out.append((row, hashed[pos] ^ salt, pos - first[row], np.where(high[row] == group, number[pos], 0),
                        before[pos] | behind[pos + chars] << np.uint32(16)))
    return tuple(np.concatenate(x) for x in zip(*out))


def nibbles(lines: list[str]) -> np.ndarray:
    """Per line the numbers of characters of each of 16 classes modulo 16, as eight bytes."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    kind = (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(60)).astype(np.int64)
    counts = np.bincount(np.repeat(np.arange(len(lines)), n) * 16 + kind, minlength=len(lines) * 16) % 16
    return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).view("<u8")


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many characters the counts of two lines differ at least, by :func:`nibbles`."""
    x, y = (v.view(np.uint8).reshape(-1, 8) for v in (x, y))
    low, high = (x - y) & 15, ((x >> 4) - (y >> 4)) & 15
    return (np.minimum(low, 16 - low) + np.minimum(high, 16 - high)).sum(axis=1, dtype=np.int64)


def counted(lines: DataFrame) -> DataFrame:
    """(id, line, bag) of (id, line), by :func:`bags`."""
    def run(batches):
        for b in batches:
            yield b.assign(bag=bags(b["line"].tolist()))

    return lines.select("id", "line").mapInPandas(run, "id long, line string, bag long")


#: Columns of a packed row: those of its lines, then those of its entries, each as one value of bytes.
PACKED = {"id": "<i8", "size": "<u4", "open": "u1", "line": "<u2", "key": "<u4", "at": "<u4", "number": "<u4", "around": "<u4"}


def _bytes(values: np.ndarray, kind: str) -> bytes:
    """The values as bytes, all lowest bytes first, as the higher ones are mostly zero and take no room then."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(cells, kind: str) -> np.ndarray:
    """What :func:`_bytes` packed in each of the cells, one after the other."""
    width = np.dtype(kind).itemsize
    return np.concatenate([np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(width, -1).T).ravel().view(kind) for c in cells])


def packed(lines: DataFrame, share: int, buckets: int) -> DataFrame:
    """(bucket, columns of PACKED): entries of the lines (id, line, open) by :func:`keys`, those of this share, dealt by key."""
    def run(batches):
        for b in batches:
            ids, line, free = b["id"].to_numpy(np.int64), b["line"].tolist(), b["open"].to_numpy(np.int64)
            parts = [(np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32))]
            for begin in range(0, len(line), 1000):
                row, key, *rest = keys(line[begin:begin + 1000])
                mine = np.flatnonzero(key % np.uint64(SHARES) == share)
                parts.append((row[mine] + begin, key[mine], *(v[mine] for v in rest)))
            row, key, at, number, around = (np.concatenate(x) for x in zip(*parts))
            n = np.fromiter(map(len, line), np.int64, len(line))
            bucket = (key // np.uint64(SHARES) % np.uint64(buckets)).astype(np.uint16 if buckets < 65536 else np.int64)
            order = np.argsort(row.astype(np.uint16), kind="stable")
            order = order[np.argsort(bucket[order], kind="stable")]
            edges = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1, append=buckets))
            out = []
            for begin, end in zip(edges[:-1], edges[1:]):
                part = order[begin:end]
                new = np.diff(row[part], prepend=-1) > 0
                own, place = row[part][new], np.cumsum(new) - 1
                values = (ids[own], n[own], free[own], place, key[part] >> np.uint64(32), at[part], number[part], around[part])
                out.append((int(bucket[part[0]]), *(_bytes(v, kind) for v, kind in zip(values, PACKED.values()))))
            yield pd.DataFrame(out, columns=["bucket", *PACKED])

    return lines.select("id", "line", "open").mapInPandas(run, "bucket int, " + ", ".join(f"{c} binary" for c in PACKED))


def matches(rows: list[dict]):
    """Arrays (a, b) of ids, a < b, each pair once an array, of lines that the rows of one bucket let be near; b is open."""
    v = {c: _values([r[c] for r in rows], kind) for c, kind in PACKED.items()}
    count = [len(r["id"]) // 8 for r in rows]
    line = v["line"].astype(np.int64) + np.repeat(np.cumsum(count) - count, [len(r["line"]) // 2 for r in rows])
    spot = v["key"].astype(np.uint64) << np.uint64(32) | v["at"]
    order = np.argsort(spot)
    spot, line, at, number, around = spot[order], line[order], v["at"][order].astype(np.int64), v["number"][order].astype(np.int64), v["around"][order]
    size, ids = v["size"].astype(np.int64), v["id"]
    index = np.flatnonzero(number)
    reach = (number[index] - 1).astype(np.uint64)
    begin = np.searchsorted(spot, spot[index] - np.minimum(reach, at[index].astype(np.uint64)))
    many = np.searchsorted(spot, spot[index] + reach, "right") - begin
    index, begin, many = index[many > 1], begin[many > 1], many[many > 1]
    n = size[line[index]]
    k, segment = edits_allowed(n), number[index] - 1
    left = at[index] - _segments(n, segment)
    right = (_spare(k) if len(k) else k) - left
    mask = ((1 << 2 * left) - 1 | ((1 << 2 * right) - 1) << 16).astype(np.uint32)
    # a key with very many matches is looked at a part at a time
    parts = -(-many // MATCHES)
    whole = np.repeat(np.arange(len(many)), parts)
    step = (np.arange(len(whole)) - np.repeat(np.cumsum(parts) - parts, parts)) * MATCHES
    begin, many = begin[whole] + step, np.minimum(many[whole] - step, MATCHES)
    ends = np.cumsum(many)
    done = 0
    while done < len(whole):
        stop = max(int(np.searchsorted(ends, ends[done] - many[done] + MATCHES, "right")), done + 1)
        here = np.repeat(np.arange(done, stop), many[done:stop])
        other = np.arange(len(here)) - np.repeat(np.cumsum(many[done:stop]) - many[done:stop], many[done:stop]) + begin[here]
        at_i = whole[here]
        i = index[at_i]
        x, y = line[i], line[other]
        longer, shift = size[y] - size[x], at[other] - at[i]
        near = (x != y) & (longer >= 0) & (longer <= k[at_i]) & (np.abs(longer - shift) <= k[at_i] - segment[at_i])
        near &= (around[other] ^ around[i]) & mask[at_i] == 0
        x, y = x[near], y[near]
        x, y = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        pair = np.unique((y * len(ids) + x)[v["open"][y] == 1])
        if len(pair):
            yield ids[pair % len(ids)], ids[pair // len(ids)]
        done = stop


def _lists(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The different b in order, and the a of each."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    edges = np.flatnonzero(np.diff(b, prepend=b[:1] - 1)) if len(b) else np.empty(0, np.int64)
    return b[edges], np.split(a, edges[1:])


def candidates(lines: DataFrame, share: int, buckets: int) -> DataFrame:
    """(b, a): per line (id, line, open) packed ids of earlier lines that share a key with it; a line may have several rows."""
    def found(rows):
        for a, b in matches(rows):
            later, earlier = _lists(a, b)
            yield pd.DataFrame({"b": later, "a": [x.tobytes() for x in earlier]})

    def run(batches):
        rows, bucket = [], None
        for batch in batches:
            for r in batch.to_dict("records"):
                if rows and r["bucket"] != bucket:
                    yield from found(rows)
                    rows = []
                bucket = r["bucket"]
                rows.append(r)
        if rows:
            yield from found(rows)

    dealt = packed(lines, share, buckets).repartition(max(buckets, shuffle_partitions(lines.sparkSession)), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInPandas(run, "b long, a binary")


def tiles(lists: DataFrame) -> DataFrame:
    """(tile, id, a): lines that each tile needs, with the earlier lines (packed ids) to compare them with there, if any.

    ``lists`` has (g, b, a, r): lines whose earliest candidate is g, in r parts
    by b and by a; a tile holds one part of each, so that a line goes to as
    many tiles as there are parts and not to as many as it has candidates.
    """
    def run(batches):
        for b in batches:
            out: dict[tuple[int, int], bytes | None] = {}
            for g, later, cell, parts in zip(b["g"].tolist(), b["b"].tolist(), b["a"], b["r"].tolist()):
                a = np.frombuffer(cell, "<i8")
                of = a % parts
                for part in np.unique(of).tolist():
                    tile = hash((g, later % parts, part))
                    own = a[of == part]
                    out[tile, later] = own.tobytes()
                    for x in own.tolist():
                        out.setdefault((tile, x), None)
            yield pd.DataFrame({"tile": [t for t, _ in out], "id": [i for _, i in out], "a": list(out.values())})

    part = F.pmod("b", "r")
    dealt = lists.repartition("g", part).sortWithinPartitions("g", part).select("g", "b", "a", "r")
    return dealt.mapInPandas(run, "tile long, id long, a binary").groupBy("tile", "id").agg(F.max("a").alias("a"))


def verified_tiles(tiles: DataFrame, tasks: int) -> DataFrame:
    """(b): the different lines of (tile, id, a, line) near one of those they are to be compared with."""
    def near(rows):
        text = {i: line for _, i, _, line in rows}
        pairs = [(i, x) for _, i, a, _ in rows if a is not None for x in np.frombuffer(a, "<i8").tolist()]
        place = {i: at for at, i in enumerate(text)}
        line, later = list(text.values()), np.array([b for b, _ in pairs], np.int64)
        n, counts = np.fromiter(map(len, line), np.int64, len(line)), nibbles(line)
        x, y = (np.array([place[pair[side]] for pair in pairs], np.int64) for side in (1, 0))
        k = edits_allowed(np.minimum(n[x], n[y]))
        # an edit changes two counts at most, one where it changes the length
        fits = np.flatnonzero(apart(counts[x], counts[y]) + np.abs(n[x] - n[y]) <= 2 * k)
        x, y, k, later = x[fits], y[fits], k[fits], later[fits]
        near = within_all([line[i] for i in x], [line[i] for i in y], k)
        return pd.DataFrame({"b": np.unique(later[near])})

    def run(batches):
        rows, pairs, last = [], 0, None
        for b in batches:
            for tile, i, a, line in zip(b["tile"].tolist(), b["id"].tolist(), b["a"], b["line"]):
                if tile != last and pairs >= TOGETHER:
                    yield near(rows)
                    rows, pairs = [], 0
                last = tile
                rows.append((tile, i, a, line))
                pairs += 0 if a is None else len(a) // 8
        if pairs:
            yield near(rows)

    return tiles.repartition(tasks, "tile").sortWithinPartitions("tile").mapInPandas(run, "b long").distinct()


def least(lines: list[str]) -> np.ndarray:
    """A row per line of at least GRAM characters, a column per hash: the least gram, apart for each range of lengths."""
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    grams = _grams(np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4"))
    end = np.cumsum(n)
    # grams that reach into the next line count for none
    over = (end[:-1, None] - np.arange(1, GRAM)).ravel()
    out = np.empty((len(lines), SETTLING), np.uint64)
    for c in range(SETTLING):
        mixed = (grams ^ grams >> np.uint64(13 + c)) * np.uint64(0x9E3779B97F4A7C15 + 2 * c)
        mixed[over] = np.uint64(0xFFFFFFFFFFFFFFFF)
        out[:, c] = np.minimum.reduceat(mixed, end - n)
    size = np.frexp(n)[1].astype(np.uint64)[:, None] * np.uint64(SETTLING) + np.arange(SETTLING, dtype=np.uint64)
    return out ^ size * np.uint64(0xD6E8FEB86659FD93)


def least_grams(lines: DataFrame) -> DataFrame:
    """(key, id, n, bag): the keys of :func:`least` of each line (id, line, bag)."""
    def run(batches):
        for b in batches:
            b = b[b["line"].str.len() >= GRAM]
            for begin in range(0, len(b), 1000):
                part = b.iloc[begin:begin + 1000]
                line = part["line"].tolist()
                n = np.fromiter(map(len, line), np.int64, len(line))
                yield pd.DataFrame({"key": least(line).view(np.int64).ravel(), "id": part["id"].to_numpy(np.int64).repeat(SETTLING),
                                    "n": n.repeat(SETTLING), "bag": part["bag"].to_numpy(np.int64).repeat(SETTLING)})

    return lines.select("id", "line", "bag").mapInPandas(run, "key long, id long, n long, bag long")


def verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The different ``b`` of pairs (a, b) of ids whose lines (id, line) are within the allowed number of edits."""
    def run(batches):
        for batch in batches:
            x, y = batch["x"].tolist(), batch["y"].tolist()
            k = edits_allowed(np.fromiter((min(len(v), len(w)) for v, w in zip(x, y)), np.int64, len(x)))
            yield pd.DataFrame({"b": batch["b"].to_numpy(np.int64)[within_all(x, y, k)]})

    wanted = materialise(pairs.select(F.col("a").alias("of")).union(pairs.select("b")).distinct(), "candidate-ids")
    texts = materialise(lines.join(wanted, F.col("id") == F.col("of")).select("of", "line"), "candidate-lines")
    left = pairs.join(texts.select(F.col("of").alias("a"), F.col("line").alias("x")), "a")
    both = left.join(texts.select(F.col("of").alias("b"), F.col("line").alias("y")), "b")
    later = materialise(both.select("b", "x", "y").mapInPandas(run, "b long").distinct(), "near")
    discard(wanted)
    discard(texts)
    return later


def settled(lines: DataFrame) -> DataFrame:
    """(b): ids of lines (id, line, bag) near the earliest line that has one of their least grams; each meets SETTLING lines at most."""
    own = materialise(least_grams(lines), "least-grams")
    first = own.groupBy(F.col("key").alias("of")).agg(F.min(F.struct("id", "n", "bag")).alias("first")).select(
        "of", F.col("first.id").alias("a"), F.col("first.n").alias("m"), F.col("first.bag").alias("seen"))
    k = F.floor(F.least("n", "m") / CHARS_PER_EDIT)
    near = (F.col("key") == F.col("of")) & (F.col("a") < F.col("id")) & (F.abs(F.col("n") - F.col("m")) <= k) & _fits("bag", "seen", k)
    pairs = materialise(own.join(first, near).select("a", F.col("id").alias("b")).distinct(), "settling")
    later = verified(pairs, lines)
    discard(own)
    discard(pairs)
    return later


def near_earlier(lines: DataFrame) -> DataFrame:
    """(b): ids of the distinct lines (id, line) that have one of a smaller id within the allowed number of edits.

    One pass per share of the keys, each written before the next, so that the
    keys of one share at a time lie in shuffle files.  Of the segments of the
    shorter line at least one, say number i, stands whole in the other with at
    most i edits before it and at most k - i behind, which bounds how far both
    its place from the left and that from the right can differ.
    """
    spark = lines.sparkSession
    python_ready(spark)
    lines = materialise(counted(lines.where(F.length("line") >= CHARS_PER_EDIT)), "distinct-lines")
    done = settled(lines)
    marked = materialise(lines.join(done, F.col("id") == F.col("b"), "left").select(
        "id", "line", F.col("b").isNull().cast("int").alias("open")), "marked-lines")
    discard(lines)
    # a third of the places at most has an entry in a line of many segments
    chars = marked.agg(F.sum(F.length("line"))).first()[0] or 0
    buckets = chars // (3 * SHARES * ENTRIES) + 1
    found = None
    for share in range(SHARES):
        part = materialise(candidates(marked, share, buckets), f"candidates-{share}")
        found = part if found is None else found.union(part)

    def join(batches):
        for b in batches:
            a = [np.unique(np.frombuffer(b"".join(cells), "<i8")) for cells in b["a"]]
            yield pd.DataFrame({"g": [int(x[0]) for x in a], "b": b["b"], "n": [len(x) for x in a], "a": [x.tobytes() for x in a]})

    lists = materialise(found.groupBy("b").agg(F.collect_list("a").alias("a")).mapInPandas(
        join, "g long, b long, n long, a binary"), "candidates")
    pairs = lists.groupBy(F.col("g").alias("of")).agg(F.sum("n").alias("n")).select(
        "of", F.ceil(F.sqrt(F.col("n") / TILE)).alias("r"), F.col("n").alias("pairs"))
    total = lists.agg(F.sum("n")).first()[0] or 0
    wanted = materialise(tiles(lists.join(pairs, F.col("g") == F.col("of"))), "wanted-lines")
    texts = wanted.join(marked.select(F.col("id").alias("of"), "line"), F.col("id") == F.col("of")).select("tile", "id", "a", "line")
    later = materialise(verified_tiles(texts, max(total // VERIFIED, shuffle_partitions(spark))), "near")
    discard(marked)
    discard(wanted)
    return done.union(later)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, line): lines with a word, of any length; row finds the document again."""
    return docs.where(F.col("text").isNotNull()).select(
        "doc_id", _row(), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(F.col("line").rlike(WORD_PATTERN))


def _row() -> Column:
    return F.xxhash64("doc_id", "text").alias("row")


def removals(docs: DataFrame) -> DataFrame:
    """(row, exact, near): per document with any, the numbers of the lines that go, equal to or near an earlier line."""
    hashed = [F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), F.col("line")).alias("id2")]
    every = materialise(_occurrences(docs).select("doc_id", "row", "at", *hashed), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "at")
    first = every.groupBy("id", "id2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # numbers that grow with the place; written before anything reads them, as they depend on how rows were dealt
    places = materialise(first, "places")
    first = materialise(places.repartitionByRange("first").sortWithinPartitions("first").withColumn(
        "rank", F.monotonically_increasing_id()), "first")
    discard(places)
    own = first.select(F.col("first.row").alias("r"), F.col("first.at").alias("t"), F.col("rank").alias("id"))
    distinct = _occurrences(docs).select("row", "at", "line").where(F.length("line") >= CHARS_PER_EDIT).join(
        own, (F.col("row") == F.col("r")) & (F.col("at") == F.col("t"))).groupBy("row", "at").agg(
        F.first("id").alias("id"), F.first("line").alias("line"))
    later = materialise(near_earlier(distinct).withColumnRenamed("b", "later"), "later")
    touched = materialise(first.join(later, F.col("rank") == F.col("later"), "left").where(
        (F.col("n") > 1) | F.col("later").isNotNull()).select(
        F.col("id").alias("i"), F.col("id2").alias("i2"), F.col("first.row").alias("r"), F.col("first.at").alias("t"),
        F.col("later").isNotNull().alias("near")), "touched")
    later_copy = (F.col("row") != F.col("r")) | (F.col("at") != F.col("t"))
    gone = every.join(touched, (F.col("id") == F.col("i")) & (F.col("id2") == F.col("i2"))).where(later_copy | F.col("near"))
    return materialise(gone.groupBy("row").agg(
        F.array_sort(F.collect_set(F.when(later_copy, F.col("at")))).alias("exact"),
        F.array_sort(F.collect_set(F.when(~later_copy, F.col("at")))).alias("near")), "removals")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` rows in a struct ``_row`` with the text that stays, n_lines, n_exact and n_near (lines gone).

    Documents stand in the order of doc_id, null last, then of a hash.  Lines
    without a word, null and empty texts stay as they are; shorter lines than
    CHARS_PER_EDIT are compared for equality only; a text of which all lines go becomes empty, its row stays.  Rows that repeat both
    doc_id and text share their lines and so keep them alike.
    """
    gone = removals(docs).select(F.col("row").alias("of"), "exact", "near")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    # the text goes through the shuffle once, inside the row
    joined = docs.select(own, _row()).join(gone, F.col("row") == F.col("of"), "left")
    joined = joined.select("_row", F.col("_row.text").alias("_text"), F.concat("exact", "near").alias("_gone"), F.split("_text", "\n", -1).alias("_lines"),
                           F.coalesce(F.size("exact"), F.lit(0)).alias("n_exact"), F.coalesce(F.size("near"), F.lit(0)).alias("n_near"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    return joined.select(
        "_row", F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(
            F.array_join(F.transform(left, lambda i: F.get("_lines", i)), "\n")).alias("text"),
        F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.greatest("n_exact", F.lit(0)).cast("long").alias("n_exact"), F.greatest("n_near", F.lit(0)).cast("long").alias("n_near"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup over all ``documents``: lines counted and gone, and the text that stays."""
    return dedup_lines(documents(spark, sf_dir)).select("_row.doc_id", "n_lines", "n_exact", "n_near", "text")
