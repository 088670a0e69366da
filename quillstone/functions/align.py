"""The stretch of a text that is most like a short target, by the ratio of difflib's matching blocks.

How many characters two strings share, whatever their order, bounds that ratio from above.  The bounds of all
stretches come from running counts, and stretches are measured in falling order of their bound
until no bound that is left reaches the best ratio.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from difflib import SequenceMatcher

import numpy as np


def shared_share(target: str, text: str) -> np.ndarray:
    """For each stretch of ``text`` as long as ``target`` the share of its characters that the target has too; of a shorter text, for the whole."""
    size, whole = len(target), min(len(target), len(text))
    if not whole:
        return np.zeros(0)
    kinds = {c: i for i, c in enumerate(dict.fromkeys(target))}
    want = np.bincount([kinds[c] for c in target], minlength=len(kinds))
    hits = np.zeros((len(text) + 1, len(kinds)), np.int64)
    for at, c in enumerate(text):
        if c in kinds:
            hits[at + 1, kinds[c]] = 1
    running = hits.cumsum(axis=0)
    inside = running[whole:] - running[: len(text) - whole + 1]
    return 2.0 * np.minimum(inside, want).sum(axis=1) / (size + whole)


def best_stretch(targets: Iterable[str], text: str, first: int = 0, places: int | None = None, rank: Callable[[int, int], tuple] | None = None, least: float = 0.0) -> tuple[float, int, int] | None:
    """(ratio, number of the target, start in ``text``) of the best pair of a target and a stretch as long, of a ratio of ``least`` or more; None without any.

    Starts count from ``first``.  Ratios are compared to ``places`` decimals; of equal ones the pair with the largest ``rank`` (of
    target and start) wins, by default the first target and then the leftmost start.
    """
    rank = rank or (lambda k, at: (-k, -at))
    targets = list(targets)
    table = [(bound, k, at + first) for k, t in enumerate(targets) for at, bound in enumerate(shared_share(t, text[first:]))]
    table.sort(key=lambda row: -row[0])
    rounded = (lambda x: x) if places is None else (lambda x: round(x, places))
    best = None
    for bound, k, at in table:
        if bound < least or best is not None and rounded(bound) < best[0]:
            break
        # The measure isn't symmetric: the target is the first sequence.
        ratio = SequenceMatcher(None, targets[k], text[at : at + len(targets[k])], autojunk=False).ratio()
        found = (rounded(ratio), rank(k, at), k, at)
        if ratio >= least and (best is None or found[:2] > best[:2]):
            best = found
    return best and (best[0], best[2], best[3])
