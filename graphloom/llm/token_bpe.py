"""BPE encoding by a dynamic program over prefixes, and decoding.

For a word of n symbols the program stores, for every prefix, the last token of that prefix's
encoding. It is unique: of the tokens that end there (an automaton over the vocabulary lists them)
it is the one whose left neighbour, the last token of what comes before it, forms a *compatible*
pair with it, that is, a pair that merging would leave apart. Back-pointers from the full word then
give exactly the ids that merging by rank gives, without merging.

Words repeat, so each worker keeps the encodings of words that it has seen, up to ``CACHE`` of them.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import names_apart, small_batches

CACHE, CACHED_LENGTH = 300_000, 64
#: The fixed words of the tokenizer's own split, as its file states them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts with other than these characters ask the library: Python might normalise or class them otherwise.
PLAIN = re.compile("[^\\t-\\r\\x20-\\x7e\\xa1-\\u024f]")
BLANKS = re.compile(r"\s+")


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Bpe:
    """Encoder of one vocabulary with an end-of-word suffix (or none)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: t for t, i in self.vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        letters = byte_letters()
        self.bytes_to_text = str.maketrans({chr(b): c for b, c in enumerate(letters)})
        # One character per symbol: the last letter of a word, with its suffix, is a letter of its own.
        self.ends = {c: chr(0x10000 + ord(c)) for c in letters}
        self.symbols = {self._packed(t): i for t, i in self.vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges) if a in self.vocab and b in self.vocab and a + b in self.vocab}
        later_first = sorted(self.rank.items(), key=lambda x: -x[1][0])
        self.halves = {new: pair for pair, (_, new) in later_first}
        self.order = {new: r for _, (r, new) in later_first}
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.length: dict[int, int] = {}
        for t, i in self.symbols.items():
            if len(t) == 1 or self._merged(t) == [i]:
                self.automaton.add_word(t, i)
                self.length[i] = len(t)
        self.automaton.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def _packed(self, token: str) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + self.ends.get(body[-1], "\0")
        return token

    def _merged(self, symbols: str) -> list[int]:
        """Merging by rank, as the definition has it. Used on single tokens and on pairs of them."""
        ids = [self.symbols.get(c, -1) for c in symbols]
        while len(ids) > 1:
            best = min(range(len(ids) - 1), key=lambda i: self.rank.get((ids[i], ids[i + 1]), (1 << 40, 0))[0])
            found = self.rank.get((ids[best], ids[best + 1]))
            if found is None:
                break
            pair = (ids[best], ids[best + 1])
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and (ids[i], ids[i + 1]) == pair:
                    out.append(found[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' symbols gives the two tokens again.

        Walks the pair apart from its seam: a merge across the seam that would have come before the
        merges that made the tokens' inner edges rules the pair out.
        """
        key = (left, right)
        answer = self.known.get(key)
        if answer is None:
            a, b, limit, answer = left, right, 1 << 40, True
            while True:
                across = self.rank.get((a, b))
                if across is not None and across[0] < limit:
                    answer = False
                    break
                # Undo the later of the two merges that made the edges at the seam; of one and the
                # same merge the left occurrence came first, so the right one is undone first, and a
                # seam of that very rank would have gone before it.
                left_rank, right_rank = self.order.get(a, -1), self.order.get(b, -1)
                if left_rank < 0 and right_rank < 0:
                    break
                if left_rank > right_rank:
                    limit, a = left_rank, self.halves[a][1]
                else:
                    limit, b = right_rank + 1, self.halves[b][0]
            if len(self.known) > CACHE:
                self.known.clear()
            self.known[key] = answer
        return answer

    def letters(self, text: str) -> str:
        """A word's bytes as printable letters."""
        return text.encode("utf-8").decode("latin-1").translate(self.bytes_to_text)

    def word(self, packed: str) -> list[int]:
        """The ids of one word, given in letters, by the program over its prefixes."""
        if self.suffix:
            packed = packed[:-1] + self.ends[packed[-1]]
        n = len(packed)
        last, length, compatible = [-1] * (n + 1), self.length, self.compatible
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for end, token in self.automaton.iter(packed):
            ending[end + 1].append(token)
        for end in range(1, n + 1):
            for token in ending[end]:
                start = end - length[token]
                if start == 0 or (last[start] >= 0 and compatible(last[start], token)):
                    last[end] = token
                    break
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= length[last[at]]
        return out[::-1]


class Encoder:
    """Whole texts: normalising, splitting and a bounded memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.bpe = Bpe(path)
        self.library = Tokenizer.from_file(path)
        self.split = regex.compile(SPLIT)
        self.specials = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")") if self.bpe.special else None
        self.seen: dict[str, tuple[bytes, str]] = {}

    def words(self, piece: str) -> list[str]:
        """The words of a piece; where Python's letters may not be the library's, by the library, in letters after a zero."""
        if PLAIN.search(piece):
            return ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))]
        return self.split.findall(BLANKS.sub(" ", unicodedata.normalize("NFC", piece)).lower())

    def _word(self, word: str) -> tuple[bytes, str]:
        ids = self.bpe.word(word[1:] if word[0] == "\0" and len(word) > 1 else self.bpe.letters(word))
        found = np.array(ids, "<u4").tobytes(), " ".join(map(self.bpe.names.__getitem__, ids))
        if len(word) <= CACHED_LENGTH:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[word] = found
        return found

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian unsigned 32-bit numbers, and the decoded text.

        The vocabulary has no decoder, so decoding writes the tokens with single spaces between.
        """
        pieces = self.specials.split(text) if self.specials and "<|" in text else [text]
        ids, words, seen, make = [], [], self.seen, self._word
        for k, piece in enumerate(pieces):
            if k % 2:
                i = self.bpe.special[piece]
                ids.append(i.to_bytes(4, "little"))
                words.append(self.bpe.names[i])
                continue
            for w in self.words(piece):
                a, b = seen.get(w) or make(w)
                ids.append(a)
                words.append(b)
        return b"".join(ids), " ".join(words)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@names_apart("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")
def encode_texts(docs: DataFrame, tokenizer: str, text_col: str = "text", id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded if ``keep``).

    Exactly the ids that the vocabulary's library gives without special tokens around the text;
    control strings inside it are single ids, as there. Null and empty texts have no ids and decode to
    nothing. Whole texts are read, whatever their length; rows neither move nor meet.
    """
    small_batches(docs)
    extra = [("ids", pa.binary()), ("decoded", pa.string())] if keep else []
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for text in batch.column(1):
                ids, decoded = coder.encode(text.as_py() or "")
                row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([ids, decoded] if keep else [])]
                for column, value in zip(out[1:], row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out[1:], schema.types[1:], strict=True))], schema=schema)

    ddl = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    done = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)
    return done.withColumnRenamed("id", id_col)
