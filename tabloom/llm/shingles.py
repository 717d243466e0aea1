"""Word shingles of whole texts as 64-bit hashes, computed on the buffers of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of text hashed in one go; texts are cut between words only.
PIECE = 1 << 20
_BASE, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
_TABLES: list = []


def _tables():
    """Random numbers for bytes (A-Z as a-z), blanks, powers of the base and of its inverse."""
    import numpy as np

    if not _TABLES:
        random = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        random[65:91] = random[97:123]
        blank = np.zeros(256, bool)
        blank[[32, 9, 10, 11, 12, 13]] = True
        up, down = np.full(PIECE + 1, _BASE, np.uint64), np.full(PIECE + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _TABLES.extend([random, blank, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)])
    return _TABLES


def mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def _piece(u, begins):
    """Hashes and starts of the words of at most PIECE bytes; begins: where texts start, which ends a word."""
    import numpy as np

    random, blank, up, down = _tables()
    inside = ~blank[u]
    edge = np.zeros(len(u) + 1, bool)
    edge[begins], edge[-1] = True, True
    before = np.concatenate([[False], inside[:-1]]) & ~edge[:-1]
    after = np.concatenate([inside[1:], [False]]) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(random[u] * up[: len(u)], dtype=np.uint64)])
    return (sums[ends] - sums[starts]) * down[starts], starts


def _long(u):
    """Word hashes of one text of more than PIECE bytes."""
    import numpy as np

    random, blank, up, _ = _tables()
    at, out = 0, []
    while at < len(u):
        end = min(at + PIECE, len(u))
        if end < len(u):
            gaps = np.flatnonzero(blank[u[at:end]])
            if not len(gaps):
                # One word of more than PIECE bytes: its hash is summed up part by part.
                total, start = 0, at
                while at < len(u):
                    part = u[at : at + PIECE]
                    stop = np.flatnonzero(blank[part])
                    part = part[: stop[0]] if len(stop) else part
                    total += int((random[part] * up[: len(part)]).sum(dtype=np.uint64)) * pow(_BASE, at - start, 1 << 64)
                    at += len(part)
                    if len(stop):
                        break
                out.append(np.array([total & _MASK], np.uint64))
                continue
            end = at + int(gaps[-1]) + 1
        out.append(_piece(u[at:end], [0])[0])
        at = end
    return np.concatenate(out)


def _chunks(column) -> Iterator:
    """(hashes of the lower-cased (A-Z) words of some texts, where each text ends), over an Arrow string column without nulls."""
    import numpy as np

    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    wide = str(column.type).startswith("large")
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    u = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1
        if j <= i:
            h = mix(_long(u[offsets[i] : offsets[i + 1]]))
            yield h, np.array([0, len(h)])
            i += 1
            continue
        base = offsets[i]
        h, starts = _piece(u[base : offsets[j]], offsets[i:j] - base)
        yield mix(h), np.searchsorted(starts, offsets[i : j + 1] - base)
        i = j


def word_hashes(column) -> Iterator:
    for h, cuts in _chunks(column):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield h[a:b]


def shingle_sets(column, size: int) -> Iterator:
    """Per text the sorted distinct hashes of its word shingles; with fewer words of the whole sequence; none without words."""
    import numpy as np

    for h, cuts in _chunks(column):
        n = max(0, len(h) - size + 1)
        rolled = h[:n].copy()
        for k in range(1, size):
            rolled = (rolled ^ (rolled >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + h[k : k + n]
        rolled = mix(rolled)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if b - a >= size:
                s = np.sort(rolled[a : b - size + 1])
                new = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=new[1:])
                yield s[new]
            elif b > a:
                x = b - a
                for w in h[a:b].tolist():
                    x = int(mix(np.array([(x * 0xA0761D6478BD642F + w) & _MASK], np.uint64))[0])
                yield np.array([x], np.uint64)
            else:
                yield h[:0]
