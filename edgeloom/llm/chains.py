"""Forward-backward over many label chains at once.

Sequences of like length are laid side by side, time by time, the longest first, so each step works on an array of the
chains that still run. Sums are rescaled at each step, so no probability underflows however long a chain is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def side_by_side(sequences: list[np.ndarray], cells: int = 150_000, most: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of non-empty sequences: their places in the list, their items (time x chain, padded by 0), chains per time.

    A group has at most `cells` cells, or is one sequence.
    """
    order = sorted((i for i, s in enumerate(sequences) if len(s)), key=lambda i: -len(sequences[i]))
    at = 0
    while at < len(order):
        longest = len(sequences[order[at]])
        own = order[at : at + max(1, min(most, cells // longest))]
        at += len(own)
        items = np.zeros((longest, len(own)), dtype=np.int64)
        for c, i in enumerate(own):
            items[: len(sequences[i]), c] = sequences[i]
        lengths = np.array([len(sequences[i]) for i in own])
        running = np.searchsorted(-lengths, -np.arange(longest), side="left")  # chains with length > t
        yield np.array(own), items, running


def forward(potentials: np.ndarray, running: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward variables (in place of the potentials) and the log of the sum over all paths, per chain."""
    scale = np.ones(potentials.shape[:2])
    now = start
    for t, n in enumerate(running):
        here = potentials[t, :n]
        here *= now if t == 0 else now[:n] @ move
        sums = here.sum(axis=1)
        here /= sums[:, None]
        scale[t, :n] = sums
        now = here
    return scale, np.log(scale).sum(axis=0)


def forward_backward(
    potentials: np.ndarray, running: np.ndarray, start: np.ndarray, move: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each label at each place (0 beyond a chain's end), expected moves, log sum per chain.

    The potentials are overwritten; the posteriors take the place of the forward variables once a step's moves are summed,
    so two arrays of that size are held.
    """
    gamma = potentials.copy()
    scale, log_sum = forward(gamma, running, start, move)
    times, chains, labels = potentials.shape
    beta = np.ones((chains, labels))
    turn = np.ascontiguousarray(move.T)
    moves = np.zeros((labels, labels))
    for t in range(times - 1, -1, -1):
        n = running[t]
        if t + 1 < times:
            m = running[t + 1]
            ahead = potentials[t + 1, :m]  # potential x beta / scale
            beta[:m] = ahead @ turn  # chains that end at t keep ones
            moves += gamma[t, :m].T @ ahead
        gamma[t, :n] *= beta[:n]
        gamma[t, n:] = 0
        potentials[t, :n] *= beta[:n]
        potentials[t, :n] /= scale[t, :n, None]
    return gamma, move * moves, log_sum
