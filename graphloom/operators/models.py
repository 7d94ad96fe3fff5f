"""Model boundaries: text in, text or triples out, with rules as defaults.

A model is a factory that a worker calls once; what it returns maps a list of texts to a list of as
many results. Empty texts never reach it.
"""

from __future__ import annotations

import re
import signal
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.triples import serialize

Extractor = Callable[[list[str]], list[list[tuple[str, str, str]]]]
Rewriter = Callable[[list[str]], list[str]]
NAME = r"[A-Z][\w'-]*(?: [A-Z][\w'-]*)*"


def rule_extractor() -> Extractor:
    """Capitalised names with one or two lower-case words between them."""
    found = re.compile(rf"({NAME})((?: [a-z]+){{1,2}}) (?={NAME})")
    tail = re.compile(NAME)

    def run(texts: list[str]) -> list[list[tuple[str, str, str]]]:
        return [[(m[1], m[2].strip(), tail.match(text, m.end())[0]) for m in found.finditer(text)] for text in texts]

    return run


def extract(rows: DataFrame, text: str, keys: list[str], factory: Callable[[], Extractor] = rule_extractor, batch: int = 64) -> DataFrame:
    """(keys, t_pos, h, r, t) from texts; another number of results than of texts is an error."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            full = pdf[pdf[text].fillna("").str.strip() != ""]
            for i in range(0, len(full), batch):
                part = full.iloc[i : i + batch]
                results = model(part[text].tolist())
                if len(results) != len(part):
                    raise ValueError("the extractor gave another number of results than of texts")
                out = [(*k, n, *t) for k, ts in zip(part[keys].itertuples(index=False, name=None), results, strict=True) for n, t in enumerate(ts)]
                yield pd.DataFrame(out, columns=[*keys, "t_pos", "h", "r", "t"])

    return rows.select(*keys, text).mapInPandas(run, f"{kinds}, t_pos int, h string, r string, t string")


def identity_resolver() -> Rewriter:
    return list


class Late(BaseException):
    """A call went beyond its time; no handler of ordinary errors inside the model catches it."""


@contextmanager
def time_budget(seconds: float) -> Iterator[None]:
    """Ends what runs inside by Late once the time is over.

    By the process's timer, so on the main thread of a worker, where Spark runs functions. On another thread, or
    where there is no such timer, Late comes when the call has ended. A native call that never returns to the
    interpreter is interrupted only when it does.
    """
    if seconds <= 0:
        raise Late
    began = time.monotonic()
    timed = hasattr(signal, "setitimer") and threading.current_thread() is threading.main_thread()

    def stop(*_) -> None:
        raise Late

    before = signal.signal(signal.SIGALRM, stop) if timed else None
    try:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, seconds)
        yield
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    if time.monotonic() - began > seconds:
        raise Late


def resolved_tokens(tokens: Sequence[str], spans: Sequence[tuple[int, int]], chains: dict[int, list[int]]) -> str:
    """Tokens, each after a space; one that refers to others gives way to them, joined by " and ".

    spans: entities as (first token, end); a representative inside of one stands as the whole entity.
    """
    cover: dict[int, str] = {}
    for a, b in spans:
        for i in range(a, b):
            cover.setdefault(i, " ".join(tokens[a:b]))
    named = lambda i: " and ".join(cover.get(j, tokens[j]) for j in chains[i])
    return "".join(" " + (named(i) if chains.get(i) else x) for i, x in enumerate(tokens))


def resolve(rows: DataFrame, text: str, factory: Callable[[], Rewriter] = identity_resolver, seconds: float = 120.0) -> DataFrame:
    """Replaces a text by its resolved form and adds timed_out; a text that takes longer is interrupted and stays as it was."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields), "timed_out boolean"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            texts, late = [], []
            for x in pdf[text]:
                done, over = x, False
                if isinstance(x, str) and x.strip():
                    try:
                        with time_budget(seconds):
                            done = model([x])[0]
                    except Late:
                        done, over = x, True
                texts.append(done)
                late.append(over)
            yield pdf.assign(**{text: texts, "timed_out": late})

    return rows.mapInPandas(run, schema)


def entities(question: Column) -> Column:
    """The capitalised names in a question, without its first word if that is a question word."""
    bare = F.regexp_replace(question, r"\A(?:Who|What|When|Where|Which|Whose|Whom|Why|How|Is|Are|Was|Were|Did|Does|Do|In|On|The)\b", "")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"({NAME})"), F.lit(1)))


def redact(text: Column, private: Column) -> Column:
    """The default rewrite: each private tail entity gives way to its relation."""
    return F.aggregate(private, text, lambda a, x: F.replace(a, x["t"], F.concat(F.lit("["), x["r"], F.lit("]"))))


def tagged(rows: DataFrame, family: str = "neutral") -> DataFrame:
    return rows.withColumn("tagged", serialize(F.struct("h", "r", "t"), family))
