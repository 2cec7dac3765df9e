"""Packing by Karmarkar-Karp multiway differencing.

Texts are tokenised once, cut into full windows, and what is left of each
document is packed, group by group, into near-equal windows: differencing
merges the partial partitions with the largest imbalances, the fullest window
of one with the emptiest of the other. When a window would exceed the capacity,
the window count rises. A group is a bounded number of documents of one input
partition, so there is no shuffle, memory is bounded and a lost task is redone alone.
What does not fill a window goes on into the next group of the partition.
"""

from __future__ import annotations

import heapq
import re
import struct
import sys
import zlib
from collections.abc import Iterator
from itertools import islice
from operator import itemgetter
from types import ModuleType
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

END = 1
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Pieces of the documents that are cut small, to even out windows.
SMALL = 32
#: Windows of a group that others follow are filled so far; the rest waits for those.
FILL = 0.997
#: Strings on which the short ways of ``Words`` must agree with the tokenizer, if they are to be used.
PROBES = ("Hello World", "it's  A-b c.d?! x", "ÀÉ çà ñandú", "日本語 ß É é 12a 3.5", "a\tb\nc\r\n d\x0be\x0cf", " lead and trail ", "\u00a0x\u2003y", "don't STOP now;;", "aaaaaaaaaaaaaaaaaaaaaaaa", "x_y __z", "😀 ok")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` near-equal parts.

    A partial partition holds only its parts with something in them, largest
    first, each as (sum over the common base, tree of indices); absent parts are 0.
    """
    heap: list[tuple[int, int, list, int]] = []
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        heap.append((-sizes[i], len(heap), [(sizes[i], (i,))], 1))
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    count = len(heap)
    while len(heap) > 1:
        _, _, a, _ = heapq.heappop(heap)
        _, _, b, _ = heapq.heappop(heap)
        if len(a) < len(b):
            a, b = b, a
        free = k - len(a)
        # the fullest parts of b go to the emptiest of a, which are absent first
        out = list(a)
        fits, rest = b[:free], b[free:]
        for j, (s, tree) in enumerate(rest):
            t, other = out[len(a) - 1 - j]
            out[len(a) - 1 - j] = (s + t, (tree, other))
        out += fits
        out.sort(key=itemgetter(0), reverse=True)
        if len(out) == k and out[-1][0]:
            low = out[-1][0]
            out = [(s - low, tree) for s, tree in out]
        # parts at 0 stay, their members count
        heapq.heappush(heap, (-(out[0][0] - (out[-1][0] if len(out) == k else 0)), count, out, 1))
        count += 1
    parts = []
    for _, tree in heap[0][2]:
        flat, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, int):
                flat.append(x)
            else:
                todo.extend(x)
        parts.append(sorted(flat))
    return parts + [[] for _ in range(k - len(parts))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Parts of at most ``capacity``; the count starts at the least possible and rises."""
    total = sum(sizes)
    k = max(1, -(-total // capacity))
    while total:
        parts = differencing(sizes, k)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        k += 1
    return []


class Piece(NamedTuple):
    """``length`` ids of a document from ``start`` on: its id, its bytes."""

    doc: int | None
    data: bytes
    start: int
    length: int

    def row(self, sequence: int, offset: int) -> tuple:
        crc = zlib.crc32(memoryview(self.data)[4 * self.start : 4 * (self.start + self.length)])
        return self.doc, self.start, self.length, crc, len(self.data) // 4, sequence, offset


def cut(docs: list[tuple[int | None, bytes]], capacity: int) -> tuple[list[Piece], list[Piece]]:
    """Full windows and what is left.

    Of the leftovers a few, about a sixteenth of their tokens, are cut into
    pieces of SMALL, without which a handful of long pieces could not fill a
    window evenly.
    """
    full, left = [], []
    for d, x in docs:
        n = len(x) // 4
        full += [Piece(d, x, s, capacity) for s in range(0, n - capacity + 1, capacity)]
        if n % capacity:
            left.append(Piece(d, x, n - n % capacity, n % capacity))
    total, small, out = sum(p.length for p in left), 0, []
    for i, p in enumerate(left):
        if p.length > SMALL and (small < total * (i + 1) / len(left) / 16):
            out += [p._replace(start=p.start + o, length=min(SMALL, p.length - o)) for o in range(0, p.length, SMALL)]
            small += p.length
        else:
            out.append(p)
    return full, out


def whole_windows(pieces: list[Piece], capacity: int) -> tuple[list[Piece], list[Piece]]:
    """The first pieces, as many as fill whole windows, and the rest."""
    room, held = int(sum(p.length for p in pieces) // capacity * capacity * FILL), 0
    for i, p in enumerate(pieces):
        if held + p.length > room:
            return pieces[:i], pieces[i:]
        held += p.length
    return pieces, []


#: Latin letters and then marks: strings whose lower case is the same in every
#: version of Unicode, that NFC keeps, and that the tokenizer splits in two.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,!?;:*&$#%]*)")


def byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the
    others for the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Words(dict):
    """Ids of a white-space-free string, as little-endian bytes; bounded.

    When it is full, the three quarters that came first stay: frequent words are among
    the first to come, most of the others come once. Forms of a word with capitals or
    marks are kept from the second time on that the word is met. LIMIT is under what
    makes a dict double its table, at 699,050."""

    LIMIT = 680_000
    #: Longer strings go to the tokenizer as they are.
    LONGEST = 64

    def __init__(self, tokenizer) -> None:
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.letters = byte_letters()
        self.packs = [struct.Struct(f"<{n}I").pack for n in range(2 * self.LONGEST + 1)]
        self.short = True

    @staticmethod
    def of(path: str) -> Words:
        """One instance for a worker process and tokenizer file, kept between tasks
        in a module of its own: those of this package come anew with each task."""
        import tokenizers

        kept = vars(sys.modules.setdefault("_sluice_worker", ModuleType("_sluice_worker")))
        if path not in kept:
            words = Words(tokenizers.Tokenizer.from_file(path))
            words.short = all(words.ids(t) == words.whole(t) for t in PROBES)
            kept[path] = words
        return kept[path]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def run(self, low: str) -> bytes:
        """A run of lower-case letters: one step of the tokenizer's model."""
        form = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        tokens = self.model.tokenize(form)
        return self.packs[len(tokens)](*[t.id for t in tokens])

    def __missing__(self, word: str) -> bytes:
        if len(word) > self.LONGEST:
            return self.whole(word)
        if m := PLAIN.fullmatch(word):
            low = m[1].lower()
            if low == word:
                ids = self.run(low)
            else:
                met = low in self
                ids = self[low] + (self[m[2]] if m[2] else b"")
                if not met:
                    return ids
        else:
            ids = self.whole(word)
        if len(self) >= self.LIMIT:
            kept = list(islice(self.items(), self.LIMIT * 3 // 4))
            self.clear()
            self.update(kept)
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The tokenizer splits at white space and never looks across it, so a
        text's ids are those of its strings between white space in turn.
        str.split also splits at four control characters that the tokenizer
        keeps; texts with them go to the tokenizer whole, and so do all texts
        if the tokenizer is of another kind."""
        if not self.short or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


def pack(docs: DataFrame, tokenizer_path: str | None, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_docs: int = 400, group_bytes: int = 64 << 20, carry: bool = True) -> DataFrame:
    """One row per piece: SCHEMA.

    A document is its text's ids and END; a null text counts as empty, so it is
    END alone. ``offset`` is gapless from 0 within a sequence. Null ids are
    carried through; repeated rows are packed each; an empty table gives no
    piece; other columns are ignored. ``tokenizer_path`` must exist on executors;
    None asks the public tokenizer files for theirs. Without ``carry`` each group
    closes its last window, so that no sequence holds documents of two groups.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        path = tokenizer_path
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        words = Words.of(path)
        end = np.asarray([END], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        group: list[tuple[int | None, bytes]] = []
        held, waiting = 0, []

        def flush(last: bool) -> pd.DataFrame:
            nonlocal sequence, held, waiting
            full, left = cut(group, capacity)
            left, waiting = waiting + left, []
            if carry and not last:
                left, waiting = whole_windows(left, capacity)
            rows = []
            for part in [[p] for p in full] + [[left[i] for i in w] for w in windows([p.length for p in left], capacity)]:
                at = 0
                for p in part:
                    rows.append(p.row(sequence, at))
                    at += p.length
                sequence += 1
            group.clear()
            held = 0
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
            return pd.DataFrame({n: pd.array(c, dtype="Int64") for n, c in zip(names, columns, strict=True)})

        for b in batches:
            for d, t in zip(b["doc_id"], b["text"], strict=True):
                x = words.ids(t) + end
                group.append((None if pd.isna(d) else int(d), x))
                held += len(x)
                if len(group) >= group_docs or held >= group_bytes:
                    yield flush(False)
        if group or waiting:
            yield flush(True)

    return C.small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), C.whole_text(text_col).alias("text")).mapInPandas(run, SCHEMA)


C.ship(__name__)
