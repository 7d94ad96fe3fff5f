"""Packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document longer than a sequence gives full sequences at once; what is left of it is packed. Each
row goes to a random group of about ``GROUP`` rows, so a group fits in a task whatever the corpus
holds, and groups are packed on their own. Inside a group, first-fit decreasing asks a tournament
tree of free capacities for the leftmost bin that is large enough. At last the emptiest bins are
taken apart to fill the gaps of the fullest, with cuts where needed: about one bin a group is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back, small_batches
from .token_bpe import PLAIN, byte_letters

LENGTH = 1024
GROUP = 4096
SEED = 17
#: A gap of fewer tokens stays rather than cutting a document for it.
LEAST_CUT = 8
#: The fixed words of the byte-level split.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Ids:
    """Token ids of whole texts as the tokenizers library gives them.

    Plain texts go through the same vocabulary's merges in tiktoken, several times as fast; texts with
    control strings, or with letters that the two libraries might class apart, go to the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in self.specials}
        self.plain = tiktoken.Encoding("plain", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if PLAIN.search(text) or any(s in text for s in self.specials):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.plain.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


@lru_cache(maxsize=1)
def ids_of(path: str) -> Ids:
    return Ids(path)


class Tournament:
    """Free capacities of bins under a tree of maxima."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def take(self, need: int) -> int:
        """The leftmost bin with so much room, which then has less; there is always one."""
        best, i = self.best, 1
        while i < self.leaves:
            i *= 2
            if best[i] < need:
                i += 1
        found = i - self.leaves
        best[i] -= need
        while i > 1:
            i //= 2
            top = max(best[2 * i], best[2 * i + 1])
            if best[i] == top:
                break
            best[i] = top
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in ``lengths``; ties keep their order."""
    tree, bins = Tournament(len(lengths), capacity), []
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        b = tree.take(lengths[k])
        if b == len(bins):
            bins.append([])
        bins[b].append(k)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Moves pieces (item, start, length) of the emptiest bins into the gaps of the fullest."""
    size = lambda b: sum(x[2] for x in b)
    order = sorted(bins, key=size, reverse=True)
    free = [capacity - size(b) for b in order]
    giver = len(order) - 1
    for taker in range(len(order)):
        if free[taker] < LEAST_CUT:
            continue
        while giver > taker and free[taker] >= LEAST_CUT:
            item, start, length = order[giver].pop()
            moved = min(length, free[taker])
            order[taker].append((item, start + length - moved, moved))
            free[taker] -= moved
            if moved < length:
                order[giver].append((item, start, length - moved))
            elif not order[giver]:
                giver -= 1
        if giver <= taker:
            break
    return [b for b in order if b]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, group: int = GROUP, end_id: int = 0, seed: int = SEED, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if ``keep_ids``).

    A row's tokens are its text's ids and ``end_id``; a null text is empty, so every row has a token.
    Each token lies in exactly one piece, and a sequence's pieces follow each other from offset 0.
    Rows are packed each for itself, repeated ids and texts too; ids may be null. An empty table
    gives no pieces. The id keeps its name, or is called doc_id where another column has it. Token ids and
    each row's group are written once before the groups meet, so that a task that is run again deals no row anew.
    """
    small_batches(docs)
    groups = max(1, -(-docs.count() // group))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = ids_of(tokenizer), int(end_id).to_bytes(4, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = [coder.encode(t or "") + last for t in batch.column(1).to_pylist()]
                full = [len(x) // 4 // length * length * 4 for x in found]
                step = 4 * length
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        batch.column(2),
                        pa.array([len(x) // 4 for x in found], pa.int64()),
                        pa.array([x[:f] if keep_ids else np.array([zlib.crc32(x[i : i + step]) for i in range(0, f, step)], "<u4").tobytes() for x, f in zip(found, full, strict=True)], pa.binary()),
                        pa.array([_narrow(x[f:]) for x, f in zip(found, full, strict=True)], pa.binary()),
                    ],
                    names=["id", "g", "n", "full", "rest"],
                )
        give_back()

    def fit(key: tuple, rows: pa.Table) -> pa.Table:
        base, out = key[0].as_py() << 32, [[] for _ in range(7 + keep_ids)]
        ids, totals = rows.column("id").to_pylist(), rows.column("n").to_pylist()
        sequence = 0

        def put(k: int, start: int, data: bytes | None, crc: int, size: int, offset: int) -> None:
            for column, value in zip(out, (ids[k], start, size, crc, totals[k], base + sequence, offset, data), strict=False):
                column.append(value)

        for k, whole in enumerate(rows.column("full")):
            raw = whole.as_py()
            for i in range(totals[k] // length):
                data = raw[4 * length * i : 4 * length * (i + 1)] if keep_ids else None
                put(k, i * length, data, zlib.crc32(data) if keep_ids else int.from_bytes(raw[4 * i : 4 * i + 4], "little"), length, 0)
                sequence += 1
        rest = [_wide(x.as_py()) for x in rows.column("rest")]
        left = [k for k, x in enumerate(rest) if x]
        bins = first_fit_decreasing([len(rest[k]) // 4 for k in left], length)
        for b in fill_gaps([[(left[i], 0, len(rest[left[i]]) // 4) for i in one] for one in bins], length):
            offset = 0
            for k, start, size in b:
                data = rest[k][4 * start : 4 * (start + size)]
                put(k, totals[k] // length * length + start, data, zlib.crc32(data), size, offset)
                offset += size
            sequence += 1
        give_back()
        names = [x.split()[0] for x in PIECE.split(", ")] + ["ids"] * keep_ids
        return pa.table({n: pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, out, strict=True)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.floor(F.rand(seed) * groups).cast("long").alias("g"))
    done = checkpointed(rows.mapInArrow(cut, "id long, g long, n long, full binary, rest binary")).groupBy("g").applyInArrow(fit, PIECE + ", ids binary" * keep_ids)
    return done if id_col.lower() in done.columns else done.withColumnRenamed("doc_id", id_col)


def _narrow(data: bytes) -> bytes:
    """Half the bytes for the way to the group, where all ids allow it; the first byte tells."""
    ids = np.frombuffer(data, "<u4")
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + data


def _wide(data: bytes) -> bytes:
    return np.frombuffer(data, "<u2", offset=1).astype("<u4").tobytes() if data[0] == 2 else data[1:]
