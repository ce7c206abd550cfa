"""Content-defined reference blocks: the sampled index behind both exact substring operators.

Every window of `width` items picks an anchor: the leftmost of its smallest `gram`-item
fingerprints. Neighbouring windows with one anchor form a block, known by the anchor's and the whole
block's fingerprint. Equal windows pick equal anchors wherever they stand, so two equal windows are
in blocks of the same anchor; equal blocks hold the same windows, and only blocks whose anchor is
shared but whose content differs have to be opened window by window. About 2 / (width - gram + 2)
anchors stand for each item, and that is all that is shuffled for most of a corpus.
"""

from __future__ import annotations

import numpy as np

from promptlens.llm.arrowtext import Prefix, Rolling, U, inside, leftmost_minima, mix


class Blocks:
    """Blocks of a run of rows: row, anchor (fingerprint), mark (fingerprint of the block), place (of the anchor), lo, hi (first and last window)."""

    def __init__(self, values: np.ndarray, prefix: Prefix, first: np.ndarray, width: int, gram: int):
        self.width = width
        at = leftmost_minima(Rolling(values).windows(gram), width - gram + 1)
        ok = np.flatnonzero(inside(first, width)) if len(at) else np.zeros(0, np.int64)
        row = np.searchsorted(first, ok, "right") - 1
        anchor = at[ok]
        new = np.ones(len(ok), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(ok)) - 1 if len(begin) else begin
        self.lo, self.hi, self.row = ok[begin], ok[end], row[begin]
        place = self.place = anchor[begin]
        self.anchor = prefix.slices(place, place + gram)
        self.mark = mix(prefix.slices(self.lo, self.hi + width) + mix((place - self.lo).astype(U)))

    def __len__(self) -> int:
        return len(self.lo)

    def keys(self) -> np.ndarray:
        """One number for (row, anchor, mark)."""
        return mix(self.mark + mix(self.anchor + self.row.astype(U) * U(0x9E3779B97F4A7C15)))

