"""Counts over whole texts, by array operations on a block's bytes."""

from __future__ import annotations

import numpy as np

from offsetlake.llm.blocks import _LOWER, Block, digests, mix, span_hashes, windows

#: The symbols that the quality rules count.
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the flags between consecutive offsets."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def symbols(block: Block) -> np.ndarray:
    return per_document(_SYMBOL[block.data], block.offsets)


def class_bytes(block: Block, table: np.ndarray) -> np.ndarray:
    return per_document(table[block.data], block.offsets)


def word_characters(block: Block) -> np.ndarray:
    """Code points inside words."""
    leads = (block.data & 0xC0) != 0x80
    total = np.concatenate(([0], np.cumsum(leads, dtype=np.int64)))
    return per_document(total[block.end] - total[block.start], block.first)


def repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys their owner has twice or more, and which an earlier place of the owner has already."""
    own = mix(keys ^ mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice, again = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = again[order[1:][same]] = True
    return twice, again


def repeated_window_words(block: Block, hashes: np.ndarray, width: int = 3) -> np.ndarray:
    """Words inside windows of `width` words that the text has twice or more."""
    at, keys = windows(hashes, block.first, width)
    twice, _ = repeats(keys, block.word_document()[at])
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + width, -1)
    return per_document(np.cumsum(edge[:-1]) > 0, block.first)


class Lines:
    """The lines with a word of a block: document, first word, end word; hashes of raw and of normalised lines."""

    def __init__(self, block: Block):
        ends = np.flatnonzero(block.data == 10)
        starts = np.unique(np.concatenate((block.offsets[:-1], ends + 1)))
        starts = starts[starts < len(block.data)]
        # a line ends at its newline or where the next line starts
        nxt = np.append(starts[1:], len(block.data))
        stop = nxt - (block.data[nxt - 1] == 10) if len(starts) else nxt
        first, last = np.searchsorted(block.start, starts), np.searchsorted(block.start, stop)
        some = last > first
        self.start, self.stop, self.first, self.last = starts[some], stop[some], first[some], last[some]
        self.document = np.searchsorted(block.offsets, self.start, side="right") - 1
        self.raw = span_hashes(block.data, self.start, self.stop)

    @staticmethod
    def folded(block: Block) -> np.ndarray:
        """Hash of each word with A-Z folded."""
        return digests(_LOWER[block.data], block.start, block.end, 1)[0]

    def normalised(self, block: Block) -> np.ndarray:
        """Hash of each line's words, A-Z folded; blanks do not count."""
        return span_hashes(self.folded(block), self.first, self.last)
