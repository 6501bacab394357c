"""Linear-chain conditional random fields over many sequences at once, in numpy.

Sequences lie one after another in flat arrays. Each step of a recursion handles the t-th item of
every sequence that is that long, so the Python loop runs over the longest sequence only.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Where the sequences lie: starts in order of falling length, and how many reach step t."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        self.starts = starts[order]
        self.lengths = lengths[order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), side="left") if longest else np.zeros(0, int)

    def at(self, t: int) -> np.ndarray:
        return self.starts[: self.active[t]] + t


def marginals(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False, block: int = 256):
    """Forward-backward over whole sequences. ``emission`` (n, K) and ``trans`` (K, K) are log scores.

    Returns the label marginals (n, K) and, if asked, the expected transition counts (K, K). Sequences are worked on in blocks
    of ``block`` items side by side: the product of a block's transfer matrices carries the sums from block to block, so
    the result is that of the whole chain, while the loops run over one block's items and over the blocks of the longest sequence.
    """
    lengths = np.asarray(lengths, dtype=np.int64)
    k, n = trans.shape[0], len(emission)
    e = np.exp(emission - emission.max(axis=1, keepdims=True)) if n else emission
    a = np.exp(trans - trans.max())
    parts = -(-lengths // block)
    rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    sizes = np.minimum(block, np.repeat(lengths, parts) - rank * block)
    longer = np.repeat(parts > 1, parts)
    lay = Layout(sizes)
    by_size = np.argsort(-sizes, kind="stable")  # the order of the layout
    starts = np.cumsum(sizes) - sizes
    before, after = np.ones((len(sizes), k)), np.ones((len(sizes), k))  # sums that enter each block from its neighbours
    if longer.any():
        own = by_size[longer[by_size]]  # blocks of sequences of several blocks, longest first
        step = np.where((rank[own] > 0)[:, None, None], a, np.eye(k)) * e[starts[own]][:, None, :]
        for t in range(1, int(sizes[own].max())):
            go = np.searchsorted(-sizes[own], -t, side="left")  # the first of them reach item t
            step[:go] = (step[:go] @ a) * e[starts[own[:go]] + t][:, None, :]
            step[:go] /= step[:go].max(axis=(1, 2), keepdims=True)
        slot = np.full(len(sizes), -1)  # only blocks of sequences of several blocks have a transfer matrix
        slot[own] = np.arange(len(own))
        for r in range(1, int(parts.max())):
            at = np.flatnonzero(rank == r)
            now = np.einsum("bi,bij->bj", before[at - 1], step[slot[at - 1]])
            before[at] = now / now.sum(axis=1, keepdims=True)
        for r in range(int(parts.max()) - 1, 0, -1):
            at = np.flatnonzero(rank == r)
            now = np.einsum("bij,bj->bi", step[slot[at]], after[at])
            after[at - 1] = now / now.sum(axis=1, keepdims=True)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.ones(n)
    if n:
        beta[starts[sizes > 0] + sizes[sizes > 0] - 1] = after[sizes > 0]
    for t in range(len(lay.active)):
        idx = lay.at(t)
        if t == 0:
            b = by_size[: len(idx)]
            now = np.where((rank[b] > 0)[:, None], before[b] @ a, 1.0) * e[idx]
        else:
            now = (alpha[idx - 1] @ a) * e[idx]
        total = now.sum(axis=1)
        alpha[idx], scale[idx] = now / total[:, None], total
    for t in range(len(lay.active) - 1, 0, -1):
        idx = lay.at(t)
        beta[idx - 1] = (beta[idx] * e[idx] / scale[idx][:, None]) @ a.T
    out = alpha * beta
    out /= np.maximum(out.sum(axis=1, keepdims=True), 1e-300)
    if not pairs:
        return out
    inner = np.setdiff1d(np.arange(n), np.cumsum(lengths) - lengths)
    x, y = alpha[inner - 1], e[inner] * beta[inner]
    y = y / np.maximum(((x @ a) * y).sum(axis=1, keepdims=True), 1e-300)
    return out, (x.T @ y) * a


def marginal_chunks(emission, n: int, trans: np.ndarray, chunk: int):
    """Label marginals of one chain of any length, chunk by chunk from its end: (first item, marginals (items, K)).

    ``emission`` (a, b) gives the log scores of the items from a to b. The first pass keeps the forward sums that enter each chunk, the
    second takes the chunk's forward sums anew and carries the backward sums, so a chunk is all that is held at once.
    """
    a = np.exp(trans - trans.max())
    starts = range(0, n, chunk)

    def scores(at):
        e = emission(at, min(at + chunk, n))
        return np.exp(e - e.max(axis=1, keepdims=True))

    def forward(e, now):
        out = np.empty_like(e)
        for t in range(len(e)):
            now = (now @ a if now is not None else 1.0) * e[t]
            now = out[t] = now / now.sum()
        return out

    enters, now = [], None
    for at in starts:
        enters.append(now)
        now = forward(scores(at), now)[-1]
    back = np.ones(len(trans))
    for at, now in zip(reversed(starts), reversed(enters)):
        e = scores(at)
        out = forward(e, now)
        for t in range(len(e) - 1, -1, -1):
            out[t] *= back
            out[t] /= out[t].sum()
            back = a @ (e[t] * back)
            back /= back.sum()
        yield at, out


def viterbi(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The best label sequence of each sequence, as one flat array; ties go to the lower label."""
    lay = Layout(lengths)
    best = np.array(emission, dtype=np.float64)
    back = np.zeros(best.shape, dtype=np.int8)
    for t in range(1, len(lay.active)):
        idx = lay.at(t)
        steps = best[idx - 1][:, :, None] + trans[None]
        back[idx] = steps.argmax(axis=1)
        best[idx] += steps.max(axis=1)
    labels = np.zeros(len(best), dtype=np.int8)
    if len(best):
        ends = lay.starts[lay.lengths > 0] + lay.lengths[lay.lengths > 0] - 1
        labels[ends] = best[ends].argmax(axis=1)
        for t in range(len(lay.active) - 1, 0, -1):
            idx = lay.at(t)
            labels[idx - 1] = back[idx, labels[idx]]
    return labels


class Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.rate, self.t = np.zeros(shape), np.zeros(shape), rate, 0

    def step(self, value: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient**2 - self.v)
        value += self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)
