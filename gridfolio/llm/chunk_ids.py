"""Ids of whole texts from the ids of their chunks, each distinct chunk encoded once per task and bounded cache."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from gridfolio.llm.common import chunks

#: Distinct chunks a worker remembers; some 80 MB. Those long unused are forgotten, which changes no result.
REMEMBERED = 300_000


class ChunkEncoder:
    """``split`` cuts a text into chunks whose ids are independent; ``encode`` gives little-endian 32-bit ids per chunk."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[list[str]], list[bytes]], remembered: int = REMEMBERED, size: int = 2 << 20) -> None:
        self.split, self.encode, self.remembered, self.size = split, encode, remembered, size
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # the generation before; what is used again moves on

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for group in chunks(texts, self.size):
            parts = [self.split(texts[i]) for i in group]
            new = set().union(*parts).difference(self.known)
            if len(self.known) + len(new) > self.remembered // 2:
                self.old, self.known, new = self.known, {}, set().union(*parts)
            again = new.intersection(self.old)
            self.known.update((w, self.old[w]) for w in again)
            names = list(new - again)
            self.known.update(zip(names, self.encode(names), strict=True))
            get = self.known.__getitem__
            out += [b"".join(map(get, p)) for p in parts]
        return out


def id_lists(encoded: list[bytes]) -> pa.ListArray:
    """An Arrow array of id lists, without a Python object per id."""
    ends = np.cumsum([0, *[len(e) // 4 for e in encoded]], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(encoded), "<i4")))
