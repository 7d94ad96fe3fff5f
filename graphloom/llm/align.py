"""Cross-tokenizer alignment by byte-owner arrays.

Both tokenizers spell out the same bytes. Repeating each token's index over its bytes gives for every
byte its owner in A and in B; where a pair of neighbouring bytes changes an owner, a new overlap (a link) begins,
and where both owners change at once, a cut between groups.

How many documents hold a pair of ids linked is counted over all of them: tasks count repeated pairs
before anything moves. The pairs that most documents hold, ``MOST`` at most, go back to every task, and
so does the highest count of each id of A, whose number the vocabulary bounds. Occurrences of the other
pairs, none of them frequent, meet their counts in a join. Texts are encoded once: a document's
distinct pairs wait in the shared folder for the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, give_back, names_apart, small_batches
from .packing import Ids
from .token_bpe import PLAIN

#: Pairs that go to every task at most.
MOST = 1 << 20
#: Pairs among which a task counts at a time.
LOOK = 1 << 22
#: What is put before a text, as the second tokenizer does by itself.
LEAD = " "


class Tokenizers:
    """Ids by both vocabularies, the bytes of every id, and ids as text. Control strings inside texts are plain text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = Ids(a_path)
        self.a.library.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * self.a.library.get_vocab_size()
        for i in range(len(self.a_bytes)):
            if self.a.library.id_to_token(i) not in self.a.specials:
                self.a_bytes[i] = self.a.plain.decode_single_token_bytes(i)
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[1:-1], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.parts = [len(self.a_bytes), len(self.a_bytes), len(self.b_bytes)]
        self.text = np.array([f"{i}{end}" for size, ends in ((self.parts[0], ",|"), (self.parts[2], ",;")) for end in ends for i in range(size)], "S")

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both; none where a tokenizer does not spell out the lead and the text, byte by byte."""
        none = np.zeros(0, np.int64)
        if not text:
            return none, none
        whole = LEAD + text
        a = self.a.library.encode(whole, add_special_tokens=False).ids if PLAIN.search(text) else self.a.plain.encode_ordinary(whole)
        b = self.b.encode(text, num_threads=1)
        raw = whole.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return none, none
        return np.array(a, np.int64), np.array(b, np.int64)

    def spelled(self, a: np.ndarray, b: np.ndarray, cuts: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
        of_a, of_b = (np.searchsorted(cuts, np.cumsum(n) - n, "right") for n in (self.a_length[a], self.b_length[b]))
        last_a, last_b = (np.r_[g[1:] != g[:-1], True] for g in (of_a, of_b))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.searchsorted(of_b, of_a, "left")] = a + np.where(last_a, self.parts[0], 0)
        codes[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = b + 2 * self.parts[0] + np.where(last_b, self.parts[2], 0)
        return self.text[codes].tobytes().replace(b"\0", b"")[:-1]


@lru_cache(maxsize=1)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def overlaps(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index in A, index in B of each overlap, the byte offsets of the cuts inside) of tokens with these numbers of bytes."""
    a, b = (np.repeat(np.arange(len(n), dtype=np.int32), n) for n in (a_lengths, b_lengths))
    new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
    starts = np.r_[0, np.flatnonzero(new_a | new_b) + 1] if len(a) else np.zeros(0, np.int64)
    return a[starts], b[starts], np.flatnonzero(new_a & new_b) + 1


def _aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str, id_col: str, keep: bool) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs with how often they are linked."""
    small_batches(docs)
    kinds = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())]
    kinds += [("groups", pa.string())] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_path, b_path)
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for t in batch.column(1):
                a, b = both.encode(t.as_py() or "")
                i, j, cuts = overlaps(both.a_length[a], both.b_length[b])
                groups = both.spelled(a, b, cuts) if len(a) else b""
                pairs, times = np.unique(a[i] * len(both.b_bytes) + b[j], return_counts=True)
                row = (len(a), len(b), len(cuts) + 1 if len(a) else 0, len(i), hashlib.sha256(groups).hexdigest() if len(a) else "", pairs.astype("<u4" if not len(pairs) or pairs[-1] < 1 << 32 else "<i8").tobytes(), times.astype("<u4").tobytes())
                for column, value in zip(out, [*row, groups.decode()][: len(kinds)], strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(out, kinds, strict=True))], names=["id", *(k for k, _ in kinds)])
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    ddl = f"id {rows.schema['id'].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + (", groups string" if keep else "")
    return checkpointed(rows.mapInArrow(run, ddl))


def _read(pairs: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(times, "<u4").astype(np.int64)
    return np.frombuffer(pairs, "<u4" if len(pairs) == len(times) else "<i8").astype(np.int64), n


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold each pair of ids linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for pairs, times in zip(*batch.columns, strict=True):
                held.append(_read(pairs.as_py(), times.as_py())[0])
                if len(held) % 64 == 0 and sum(map(len, held)) >= LOOK:
                    yield counted()
        if held:
            yield counted()
        give_back()

    return checkpointed(aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")))


def _frequent(counts: DataFrame, most: int) -> int:
    """The least power of two so that at most ``most`` pairs have it, or a higher count."""
    level = F.floor(F.log2("n")).cast("int")
    left, least = most, 64
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    return 1 << min(least, 62)


@names_apart("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")
def align_tokens(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", id_col: str = "doc_id", keep: bool = False, most: int = MOST) -> DataFrame:
    """One row per row of ``docs``: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (and groups if ``keep``).

    A, a byte-level vocabulary, encodes a space and the text, B, a piece model that puts that space
    itself, the text; control strings in texts are plain text. Links are the pairs of tokens whose bytes
    overlap; a pair of ids counts the rows that hold it linked (rows that repeat count each). n_best is the number
    of links whose pair has the highest count of all pairs of that id of A, ties included; count_sum adds
    the counts of all links. Null and empty texts, and texts that a vocabulary does not spell out byte
    by byte (B reads U+2581 as a space), have zeros and an empty groups_sha256. Whole texts are read. Other columns of
    ``docs`` are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    base = len(tokenizers(a_path, b_path).b_bytes)
    aligned = _aligned(docs, a_path, b_path, text_col, id_col, keep)
    counts = pair_counts(aligned)
    a_id = F.expr(f"pair div {base}").cast("long")
    highest = checkpointed(counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("top")))
    tops = highest.toArrow()
    best = np.zeros(len(tokenizers(a_path, b_path).a_bytes), np.int64)
    best[tops.column("a").to_numpy()] = tops.column("top").to_numpy()
    least = _frequent(counts, most)
    table = counts.where(F.col("n") >= least).toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    known = spark.sparkContext.broadcast((table.column("pair").to_numpy()[order], table.column("n").to_numpy()[order], best))
    marked = aligned.withColumn("mark", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, n, best = known.value
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for pairs, times in zip(batch.column(1), batch.column(2), strict=True):
                p, t = _read(pairs.as_py(), times.as_py())
                at = np.minimum(np.searchsorted(names, p), max(0, len(names) - 1))
                here = names[at] == p if len(names) else np.zeros(len(p), bool)
                count = n[at[here]]
                row = (int(t[here][count == best[p[here] // base]].sum()), int((count * t[here]).sum()), p[~here], t[~here])
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["mark", "n_best", "count_sum", "rest", "rest_times"])
        give_back()

    seen = checkpointed(marked.select("mark", "pairs", "times").mapInArrow(run, "mark long, n_best long, count_sum long, rest array<long>, rest_times array<long>"))
    seldom = seen.where(F.size("rest") > 0).select("mark", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("mark", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    # Every pair that is not among the frequent ones is in fewer rows than ``least``, so no key of this join is hot.
    met = seldom.join(counts.where(F.col("n") < least), "pair")
    judged = met.withColumn("a", a_id).join(F.broadcast(highest), "a")
    rest = judged.groupBy("mark").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    sums = seen.select("mark", "n_best", "count_sum").join(rest, "mark", "left")
    whole = marked.drop("pairs", "times").join(sums, "mark")
    added = [(F.col(c) + F.coalesce(more, F.lit(0))).alias(c) for c, more in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return whole.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *added, "groups_sha256", *(["groups"] if keep else []))
