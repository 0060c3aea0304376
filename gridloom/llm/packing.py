"""Cost-balanced packing of documents into sequences of bounded length.

A document becomes token ids and one closing id 0. Whole sequences are cut from its front; what is left,
shorter than a sequence, waits in a block. A full block is packed by estimated cost, linear plus quadratic
in a piece's length: pieces in descending order go to the sequence of lowest cost that still has room, and a
piece that fits nowhere is cut at the largest room left. A block has as many sequences as its tokens need, so
it pads less than one sequence. Blocks lie within one input partition: no row is shuffled, a task holds one
block, and a task that is run again gives the same rows.

Defined cases: a null or empty text is the id 0 alone; repeated rows are packed once each; an empty table
gives no row; other columns are ignored; equal lengths go in order of arrival.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from gridloom.llm.workers import lean, remembered

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Characters that both tokenizer libraries are known to split alike; other texts take the slower library.
_COMMON = re.compile("[\t\n\r\x20-\x7e¡-ɏΑ-ωА-яぁ-ゖァ-ヺ一-龥]*")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library; strings of special tokens are ordinary text.

    The ranks of the same file drive tiktoken, which is several times as fast, for texts of common characters.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.path, self._slow = path, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        char_of = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        byte_of = {c: b for b, c in char_of.items()}
        special = {x["content"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if _COMMON.fullmatch(text):
            return self._fast.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_file(self.path)
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids


@remembered
@lru_cache(maxsize=1)
def _loaded(path: str) -> ByteBpe:
    """One for all tasks of a worker."""
    return ByteBpe(path)


def place(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) for pieces shorter than capacity."""
    n = -(-int(lengths.sum()) // capacity)
    room = np.full(n, capacity, dtype=np.int64)
    cost = np.zeros(n)
    out = []

    def put(piece: int, start: int, length: int, at: int) -> None:
        out.append((piece, start, length, at, capacity - int(room[at])))
        room[at] -= length
        cost[at] += linear * length + quadratic * length * length

    for piece in np.argsort(-lengths, kind="stable").tolist():
        start, left = 0, int(lengths[piece])
        while left:
            at = int(np.argmin(np.where(room >= left, cost, np.inf)))
            length = left
            if room[at] < left:  # no sequence holds it whole
                at = int(np.argmax(room))
                length = int(room[at])
            put(piece, start, length, at)
            start += length
            left -= length
    return out


def pack_stream(docs: Iterable[tuple[int, np.ndarray]], capacity: int, block: int, linear: float, quadratic: float, first_id: int) -> Iterator[tuple]:
    """Rows of SCHEMA for (doc_id, ids) in order; holds one block of remainders."""
    sequence = first_id
    waiting: list[tuple[int, int, np.ndarray, int]] = []

    def flush() -> Iterator[tuple]:
        nonlocal sequence
        lengths = np.array([len(x[2]) for x in waiting], dtype=np.int64)
        for piece, start, length, at, offset in place(lengths, capacity, linear, quadratic):
            doc, begin, ids, total = waiting[piece]
            yield doc, begin + start, length, zlib.crc32(ids[start : start + length].tobytes()), total, sequence + at, offset
        sequence += -(-int(lengths.sum()) // capacity)
        waiting.clear()

    for doc, ids in docs:
        whole = len(ids) // capacity * capacity
        for start in range(0, whole, capacity):
            yield doc, start, capacity, zlib.crc32(ids[start : start + capacity].tobytes()), len(ids), sequence, 0
            sequence += 1
        if whole < len(ids):
            waiting.append((doc, whole, ids[whole:].copy(), len(ids)))
            if len(waiting) == block:
                yield from flush()
    if waiting:
        yield from flush()


def cost_balanced_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = 1024, block: int = 2048, linear: float = 1.0, quadratic: float = 1 / 512) -> DataFrame:
    """One row for each piece of each document, columns as in SCHEMA; see the module's text.

    block bounds the remainders that a task holds, tokenizer is a path that every executor has.
    """
    path = tokenizer or default_tokenizer()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        bpe = _loaded(path)

        def encoded():
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = bpe.ids(text.as_py() or "")
                    ids.append(0)
                    yield doc, np.array(ids, dtype="<u4")

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
            rows.clear()
            return made

        for row in pack_stream(encoded(), capacity, block, linear, quadratic, TaskContext.get().partitionId() << 40):
            rows.append(row)
            if len(rows) == 20000:
                yield batch_of()
        if rows:
            yield batch_of()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(lean(run), SCHEMA)
