"""Packing tokenised documents into training sequences by minimum bin slack.

Each task packs the documents of its own partition, so nothing is shuffled and nothing but a
bounded buffer of remainders is held. Whole windows of a long document are sequences of their own.
What is left of every document waits in the buffer; a window is filled by its longest remainder and
by the multiset of other lengths that comes closest to the space left. That multiset is found by a
subset-sum program over bits (bit ``s`` of an integer: the sum ``s`` can be reached), each length
added as often as it is there, and the counts are traced back through the kept states. If no
multiset fills the window, one piece is cut to fill it. What is left at the end of a partition goes
into sequences of lengths that are powers of two, so no sequence needs padding.

Defined cases: a null or empty text is the end token alone; equal documents are packed each; a null
id is carried along; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import pick, text_batches, tokenizer_path

WINDOW = 4096
#: Remainders that stay in the buffer while more documents come, so that lengths to choose from abound.
WAITING = 512

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest_multiset(counts: dict[int, int], space: int) -> dict[int, int]:
    """How often to take each length so that the sum comes closest to ``space`` from below.

    ``counts`` has the available lengths and how many there are of each.
    """
    reach, steps, full = 1, [], (1 << (space + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > space:
            continue
        steps.append((length, counts[length], reach))
        left, block = min(counts[length], space // length), 1
        while left > 0:  # 1, 2, 4, ... copies at a time reach every count up to the number there is
            block = min(block, left)
            reach |= (reach << (block * length)) & full
            left, block = left - block, block * 2
        if reach >> space & 1:
            break
    target, taken = reach.bit_length() - 1, {}
    for length, count, before in reversed(steps):
        for k in range(min(count, target // length) + 1):
            if before >> (target - k * length) & 1:
                if k:
                    taken[length] = k
                target -= k * length
                break
    return taken


class Packer:
    """Takes documents, gives pieces: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""

    def __init__(self, first_sequence: int, window: int = WINDOW, waiting: int = WAITING):
        self.next_sequence, self.window, self.waiting = first_sequence, window, waiting
        self.by_length: dict[int, list[tuple]] = {}
        self.pieces = self.tokens = 0  # that wait

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_sequence, offset
            offset += len(ids) // 4
        self.next_sequence += 1

    def _put(self, piece: tuple) -> None:
        self.by_length.setdefault(len(piece[2]) // 4, []).append(piece)
        self.pieces += 1
        self.tokens += len(piece[2]) // 4

    def _take(self, length: int) -> tuple:
        same = self.by_length[length]
        piece = same.pop()
        if not same:
            del self.by_length[length]
        self.pieces -= 1
        self.tokens -= length
        return piece

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        """A document: its ids as little-endian unsigned 32-bit bytes."""
        total, width = len(ids) // 4, self.window * 4
        whole = len(ids) // width * width
        for i in range(0, whole, width):
            yield from self._sequence([(doc_id, i // 4, ids[i : i + width], total)])
        if whole < len(ids):
            self._put((doc_id, whole // 4, ids[whole:], total))
        if self.pieces > self.waiting * 2:
            while self.pieces > self.waiting and self.tokens >= self.window:
                yield from self._fill()

    def _fill(self) -> Iterator[tuple]:
        """One window, full if what waits is enough."""
        chosen = [self._take(max(self.by_length))]
        space = self.window - len(chosen[0][2]) // 4
        for length, k in closest_multiset({n: len(same) for n, same in self.by_length.items()}, space).items():
            chosen += [self._take(length) for _ in range(k)]
            space -= k * length
        if space and self.pieces:  # every piece that waits is longer than the space
            doc_id, start, ids, total = self._take(min(self.by_length))
            chosen.append((doc_id, start, ids[: space * 4], total))
            self._put((doc_id, start + space, ids[space * 4 :], total))
        yield from self._sequence(chosen)

    def finish(self) -> Iterator[tuple]:
        """The rest: full windows, then sequences of falling powers of two."""
        while self.tokens >= self.window:
            yield from self._fill()
        rest = [self._take(max(self.by_length)) for _ in range(self.pieces)][::-1]  # the next one last
        left = sum(len(ids) for _, _, ids, _ in rest) // 4
        while left:
            size, chosen = 1 << (left.bit_length() - 1), []
            left -= size
            while size:
                doc_id, start, ids, total = rest.pop()
                chosen.append((doc_id, start, ids[: size * 4], total))
                if len(ids) > size * 4:
                    rest.append((doc_id, start + size, ids[size * 4 :], total))
                size -= len(chosen[-1][2]) // 4
            yield from self._sequence(chosen)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
    end_id: int = 2, window: int = WINDOW, waiting: int = WAITING,
) -> DataFrame:
    """Pieces of all documents of ``docs`` in sequences of at most ``window`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A sequence id
    holds the number of the partition that packed it, so a task that runs again gives the same ids.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .wordpiece import word_ids

        words = word_ids(path)
        packer = Packer(TaskContext.get().partitionId() << 40, window, waiting)
        types = [pa.int64()] * 7
        names = [f.split()[0] for f in SCHEMA.split(", ")]

        def table(rows: list[tuple]):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows: list[tuple] = []
        for batch in text_batches(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += packer.add(doc_id, words.encode(text or "") + end)
            if len(rows) > 20_000:
                yield table(rows)
                rows = []
        rows += packer.finish()
        if rows:
            yield table(rows)

    return pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)
