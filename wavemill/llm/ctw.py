"""The context trees behind ``lm``: byte contexts, binary-decomposed symbols, Krichevsky-Trofimov estimates.

A gram is a 64-bit key: the ``depth`` bytes before a byte, the most recent one highest, then the byte itself.
The contexts of length d of sorted grams are thus prefixes of the keys. A byte is eight binary decisions;
the decision after the first b bits belongs to the node (context, b, those bits). A node with n0 zeros and
n1 ones has the KT probability Gamma(n0 + 1/2) Gamma(n1 + 1/2) / (pi Gamma(n0 + n1 + 1)). The weighted
probability of a node is half of it and half of the product over its longer contexts; at full depth it is the
KT probability itself. Given frozen counts, the next bit's probability mixes the estimates (n + 1/2) / (n0 +
n1 + 1) along the contexts: a node counts with the posterior weight of its own half, its longer context with the
rest. A context without counts has no estimate, so a path ends at the longest context with counts.
"""

from __future__ import annotations

import numpy as np

#: Not a byte of any UTF-8 text: it stands before a text (as often as the depth) and once behind it.
EDGE = 0xFF
_LN2 = np.log(2.0)


#: Bytes that must stand before the first gram of some data.
BEFORE = 7


def grams(data: bytes, depth: int) -> np.ndarray:
    """The gram of every byte of ``data`` from place BEFORE on, for a depth of at most 6: read as eight bytes that end there."""
    v = np.ndarray(max(0, len(data) - BEFORE), "<u8", data, strides=(1,)) if len(data) > BEFORE else np.empty(0, np.uint64)
    # the byte itself is the highest of the eight, the bytes before it follow
    out = v & np.uint64(0x00FFFFFFFFFFFFFF)
    out >>= np.uint64(8 * (6 - depth))
    out &= np.uint64(0xFFFFFFFFFFFFFF00)
    out |= v >> np.uint64(56)
    return out


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(keys) else counts


_FEW = 1 << 14
#: ln Gamma(n + 1/2) and ln Gamma(n + 1) of small n.
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_FEW - 1) + 0.5))]) + np.log(np.pi) / 2
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _FEW)))])


def _log_gamma(n: np.ndarray, table: np.ndarray, offset: float) -> np.ndarray:
    """ln Gamma(n + offset) by table, beyond it by Stirling's series."""
    out = table[np.minimum(n, _FEW - 1)]
    large = n >= _FEW
    if large.any():
        z = n[large] + offset
        out[large] = (z - 0.5) * np.log(z) - z + np.log(2 * np.pi) / 2 + 1 / (12 * z) - 1 / (360 * z**3)
    return out


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The natural logarithm of the KT probability of n0 zeros and n1 ones."""
    return _log_gamma(n0, _HALF, 0.5) + _log_gamma(n1, _HALF, 0.5) - np.log(np.pi) - _log_gamma(n0 + n1, _WHOLE, 1.0)


class Level:
    """The nodes of contexts of one length: for each of the eight bits sorted node keys, counts, and after ``weigh`` weights."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.node, self.n0, self.n1 = [], [], []
        for b in range(8):
            k = keys >> np.uint64(8 - b)
            first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
            one = ((keys >> np.uint64(7 - b)) & np.uint64(1)).astype(np.int64) * counts
            n = np.add.reduceat(counts, first) if len(first) else counts
            n1 = np.add.reduceat(one, first) if len(first) else one
            self.node.append(k[first])
            self.n0.append(n - n1)
            self.n1.append(n1)

    def weigh(self, longer: list[np.ndarray] | None) -> None:
        """Sets log_w (weighted probabilities) and own (posterior weights); ``longer`` has the sums over longer contexts."""
        self.log_w, self.own = [], []
        for b in range(8):
            kt = log_kt(self.n0[b], self.n1[b])
            if longer is None:
                self.log_w.append(kt)
                self.own.append(np.ones(len(kt)))
            else:
                self.log_w.append(np.logaddexp(kt, longer[b]) - _LN2)
                self.own.append(np.exp(kt - _LN2 - self.log_w[b]))

    def sums(self, shorter: Level) -> list[np.ndarray]:
        """For every node of the contexts that are one byte shorter the sum of log_w over the longer ones."""
        out = []
        for b in range(8):
            bits = np.uint64(b)
            parent = (self.node[b] >> np.uint64(b + 8) << bits) | (self.node[b] & np.uint64((1 << b) - 1))
            at = np.searchsorted(shorter.node[b], parent)
            out.append(np.bincount(at, self.log_w[b], len(shorter.node[b])))
        return out


def shortened(keys: np.ndarray) -> np.ndarray:
    """The grams without the oldest byte of the context."""
    return (keys >> np.uint64(16) << np.uint64(8)) | (keys & np.uint64(255))


def levels(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[Level]:
    """Weighted levels of context lengths depth, depth - 1, ..., top of all grams whose contexts share their last ``top`` bytes."""
    out: list[Level] = []
    for d in range(depth, top - 1, -1):
        if d < depth:
            keys, counts = counted(shortened(keys), counts)
        level = Level(keys, counts)
        level.weigh(out[-1].sums(level) if out else None)
        out.append(level)
    return out


def mixed_bits(keys: np.ndarray, made: list[Level], above: np.ndarray | None = None) -> np.ndarray:
    """log10 of the probability of each gram, its longest contexts in made[0]; ``above(b, node, one, p)`` mixes in shorter contexts than those of made[-1]."""
    out = np.zeros(len(keys))
    for b in range(8):
        one = ((keys >> np.uint64(7 - b)) & np.uint64(1)).astype(bool)
        p, at = np.full(len(keys), np.nan), keys
        for level in made:
            node = at >> np.uint64(8 - b)
            j = np.searchsorted(level.node[b], node)
            n0, n1 = level.n0[b][j], level.n1[b][j]
            n = n0 + n1
            kt = (np.where(one, n1, n0) + 0.5) / (n + 1.0)
            w = level.own[b][j]
            p = np.where(n == 0, p, np.where(np.isnan(p), kt, w * kt + (1 - w) * p))
            at = shortened(at)
        if above is not None:
            p = above(b, at, one, p)
        out += np.log10(np.where(np.isnan(p), 0.5, p))
    return out
