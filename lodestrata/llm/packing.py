"""Packing (op 5): sum-of-squares online packing of token pieces into windows.

A document's ids and its end id are cut into whole windows and one remainder. A remainder of size s goes to the
fill level h that minimises the change of the sum over levels of squared counts of partially filled windows,
read from an array of counts by level; h = 0 opens a window. Each task packs its own partition, so text is never
shuffled and the state is a few hundred open windows. At the end of a task its open windows are laid end to end
and cut again at the window size, which leaves at most one padded window a task.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; an empty table gives an
empty table. Sequence ids are unique, by partition, not dense.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lodestrata.llm import bpe
from lodestrata.llm.common import text_map

WINDOW = 1024
END_ID = 0


class SumOfSquares:
    """Open windows by fill level. A window is a list of (document, start, ids)."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list] = [[] for _ in range(size + 1)]

    def level_for(self, s: int) -> int:
        """The level whose use for a piece of size s makes the sum of squares least; of equal ones the fullest."""
        top = self.size - s
        n = self.counts
        gain = 2 * (n[s : self.size + 1] - n[: top + 1]) + 2
        gain[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        gain[0] -= 1  # no window of level 0 is counted
        gain[top] -= 2 * n[self.size] + 1  # a full window is not counted
        return top - int(np.argmin(gain[::-1]))

    def place(self, piece: tuple) -> list | None:
        """Put a piece; a window that it fills comes back."""
        s = len(piece[2])
        h = self.level_for(s)
        window = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
        window.append(piece)
        if h + s == self.size:
            return window
        self.open[h + s].append(window)
        self.counts[h + s] += 1
        return None

    def rest(self) -> list[list]:
        """All open windows laid end to end and cut at the window size."""
        out, window, room = [], [], self.size
        for level in reversed(self.open):
            for piece in (p for w in level for p in w):
                doc, start, ids = piece
                while len(ids):
                    window.append((doc, start, ids[:room]))
                    taken = len(window[-1][2])
                    start, ids, room = start + taken, ids[taken:], room - taken
                    if not room:
                        out.append(window)
                        window, room = [], self.size
        if window:
            out.append(window)
        self.__init__(self.size)
        return out


def pack(df: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW, end_id: int = END_ID, folder: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids."""
    schema = f"doc_id {dict(df.dtypes)[doc_id]}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    if with_ids:
        schema += ", ids array<int>"

    def make():
        encoder = bpe.encoder(folder or bpe.tokenizer_folder())
        packer = SumOfSquares(window)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 36

        def rows(windows):
            nonlocal sequence
            out = {n: [] for n in (*names, *(["ids"] if with_ids else []))}
            for w in windows:
                offset = 0
                for (doc, total), start, ids in w:
                    for n, v in zip(names, (doc, start, len(ids), zlib.crc32(ids), total, sequence, offset), strict=True):
                        out[n].append(v)
                    if with_ids:
                        out["ids"].append(ids.astype(np.int32))
                    offset += len(ids)
                sequence += 1
            return out

        def kernel(texts, kept):
            flat, first = encoder.encode(texts)
            full = []
            for i, doc in enumerate(kept[doc_id]):
                ids = np.append(flat[first[i] : first[i + 1]], end_id).astype("<u4")
                key = (doc, len(ids))
                whole = len(ids) - len(ids) % window
                full.extend([(key, at, ids[at : at + window])] for at in range(0, whole, window))
                if whole < len(ids) and (done := packer.place((key, whole, ids[whole:].copy()))):
                    full.append(done)
            return rows(full)

        kernel.finish = lambda: rows(packer.rest())
        return kernel

    return text_map(df, schema, make, text, (doc_id,))
