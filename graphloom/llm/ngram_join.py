"""Near duplicates by the Jaccard similarity of word n-grams: a grouped prefix join, exact.

A document's shingles are 64-bit hashes, ordered by how common they are and then by value; the order
decides speed alone. Two sets of the wanted similarity share a shingle among their first
``n - ceil(t n) + 1``. So:

* documents with one and the same set are one node, and nodes with the same prefix and size one group;
* groups meet in buckets by shingle, and pairs of groups are filtered by size and by where in their
  prefixes the shingle stands;
* what is left is expanded into pairs of nodes. A node carries a parity sketch: a shingle turns over
  one of its bits, so two sketches differ in no more bits than the sets do in shingles, and pairs
  that differ in too many are no links. Of the others a bucket hands on a spanning forest only, the
  likeliest links first, never all pairs;
* these few pairs are verified on the whole sets. Where one fails, its bucket is asked again for
  other pairs between what is not connected yet, until no bucket has any left.

A bucket of more than ``TILE`` nodes is split into chunks, whose pairs are dealt out as separate
work. Nothing is sampled or capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import checkpointed, give_back, join_skewed, names_apart, small_batches

SHINGLE = 3
PERCENT = 90
TILE = 1024
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FOLD = np.frombuffer(LOWER, np.uint8)
GAP = np.isin(np.arange(256), [32, *range(9, 14)])
#: Odd multipliers, and what is left of eight bytes that a word has only some of.
ODD = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word from which on it is hashed by itself.
LONGEST = 64
#: Rows of a bucket from which on they are compared as matrices.
MATRIX = 24
#: Shingles among which a task looks for repeated ones at a time, and the common ones that go to every task at most.
LOOK, COMMON = 1 << 22, 1 << 20
#: Bits of a parity sketch: least and most.
BITS = (128, 8192)
#: Pairs that a part which is not yet connected proposes, after the first round.
PROPOSE = 64
#: Nodes and digests of 16 bytes that go to every task at most.
MANY = 200_000
KEY = ["token", "i", "j"]
NAMES, KINDS = [*KEY, "u", "v"], [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct values, ascending, where each one's run begins in the sorted values)."""
    values = np.sort(values)
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], first


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased, made from its length and its bytes, eight at a time."""
    raw = FOLD[np.frombuffer(text, np.uint8)]
    gap = np.r_[True, GAP[raw], True]
    edges = np.flatnonzero(gap[1:] != gap[:-1])
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(raw) + 1,), "<u8", np.r_[raw, np.zeros(8, np.uint8)], strides=(1,))
    h = lengths.astype(np.uint64) * ODD[0]
    for at in range(0, min(int(lengths.max(initial=0)), LONGEST), 8):
        some = np.flatnonzero(lengths > at)
        h[some] = _mixed(h[some] * ODD[1] ^ (eight[starts[some] + at] & MASKS[np.minimum(lengths[some] - at, 8)]))
    for k in np.flatnonzero(lengths > LONGEST):
        h[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : starts[k] + lengths[k]].tobytes())
    return h


def shingle_set(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, ascending; a shorter text is one shingle, a text without words none."""
    each = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    size = min(words, len(each))
    if not size:
        return each
    h = np.full(len(each) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * ODD[2] + each[k : k + len(h)]
    return _distinct(_mixed(h))[0]


def common_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ascending, and the binary logarithm of their weights) of the commonest shingles, ``COMMON`` at most.

    A weight counts the documents that hold the shingle, over the blocks in which it is repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def repeated() -> pa.RecordBatch:
            total = sum(map(len, held))
            values, first = _distinct(np.concatenate(held))
            counts = np.diff(np.r_[first, total])
            some = counts > 1
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for t in batch.column(0):
                held.append(shingle_set(t.as_py(), words))
                if len(held) % 256 == 0 and sum(map(len, held)) >= LOOK:
                    yield repeated()
        if held:
            yield repeated()
        give_back()

    weights = checkpointed(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.floor(F.log2(F.sum("n"))).cast("int").alias("weight")))
    left, least = COMMON, 64
    for r in sorted(weights.groupBy("weight").count().collect(), reverse=True):
        left -= r["count"]
        if left < 0:
            break
        least = r.weight
    rows = weights.where(F.col("weight") >= least).toArrow()
    order = np.argsort(h := rows.column("h").to_numpy().view(np.uint64))
    return h[order], rows.column("weight").to_numpy()[order].astype(np.uint8)


def parity_sketch(hashes: np.ndarray, bits: tuple[int, int] = BITS) -> bytes:
    """Bits that each hash turns over one of; as many as the next power of two that is not below the set's size, within ``bits``."""
    width = min(max(bits[0], 1 << (len(hashes) - 1).bit_length()), bits[1])
    odd = np.bincount((_mixed(hashes) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def describe(docs: DataFrame, text_col: str, id_col: str, words: int, percent: int, bits: tuple[int, int] = BITS) -> DataFrame:
    """Per row: id, d (the text's digest), n (the set's size), s (the set's key), g (the group's), prefix and sketch."""
    small_batches(docs)
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("d"), F.col(text_col).alias("t"))
    hot, weight = common_shingles(rows.select("t"), words)
    known = docs.sparkSession.sparkContext.broadcast((hot, weight))
    kinds = [("n", pa.int64()), ("s", pa.binary()), ("g", pa.binary()), ("prefix", pa.list_(pa.int64())), ("sketch", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, weight = known.value
        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for t in batch.column(2):
                h = shingle_set(t.as_py(), words)
                n = len(h)
                level = np.zeros(n, np.uint8)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    level = np.where(hot[at] == h, weight[at], 0).astype(np.uint8)
                prefix = h[np.argsort(level, kind="stable")][: n - -(-percent * n // 100) + 1] if n else h
                key = xxhash.xxh3_128_digest(prefix.tobytes() + n.to_bytes(8, "little"))
                for column, value in zip(out, (n, xxhash.xxh3_128_digest(h.tobytes()), key, prefix.view(np.int64), parity_sketch(h, bits) if n else b""), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, (_, t) in zip(out, kinds, strict=True))], names=["id", "d", *(k for k, _ in kinds)])
        give_back()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, d binary, n long, s binary, g binary, prefix array<long>, sketch binary")


def postings(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, near, pos, n, weight, total): the groups that meet others under a token of their prefixes, once each.

    near is a hash of the group; total counts the nodes under the token. A group without another one
    of a size near its own under the token is left out.
    """
    several = checkpointed(nodes.groupBy("g").agg(F.count("*").alias("m")).where("m > 1"))
    groups = rows.select("g", "n", "prefix").dropDuplicates(["g"]).join(_sized(several), "g", "left").select(F.xxhash64("g").alias("near"), "n", F.coalesce("m", F.lit(1)).alias("m"), "prefix")
    # Nodes of one group share their whole prefix: they meet under its first token alone.
    all_ = groups.select("near", "n", "m", F.posexplode("prefix").alias("pos", "token")).select("token", "near", "pos", "n", "m", F.when(F.col("pos") == 0, F.col("m")).otherwise(1).alias("weight"))
    met = all_.groupBy("token").agg(F.sum("weight").alias("least"), F.sum("m").alias("total")).where("least > 1").drop("least")
    return all_.drop("m").join(met, "token")


def near_in_size(met: DataFrame, percent: int) -> DataFrame:
    """The postings whose token has another one of a size that could be linked: sizes of a class, by the logarithm, and of its neighbours."""
    # A little less than the exact width, so that rounding puts no two sizes that could be linked two classes apart.
    classed = met.withColumn("class", F.floor(F.log("n") / math.log(100 / percent) * 0.999999)) if percent < 100 else met.withColumn("class", F.col("n") * 2)
    counts = classed.groupBy("token", "class").agg(F.sum("weight").alias("k"))
    around = counts.select("token", F.explode(F.sequence(F.col("class") - 1, F.col("class") + 1)).alias("class"), "k").groupBy("token", "class").agg(F.sum("k").alias("k")).where("k > 1").drop("k")
    return classed.join(around, ["token", "class"]).drop("class")


def members(met: DataFrame, nodes: DataFrame) -> DataFrame:
    """(token, i, j, c, g, n, pos, s, sketch): the nodes that meet under a token, once for each pair of chunks to compare."""
    near = nodes.select(F.xxhash64("g").alias("near"), "g", "n", "s", "sketch")
    each = met.select("token", "near", "pos", F.ceil(F.col("total") / TILE).cast("int").alias("chunks")).join(near, "near").withColumn("c", F.pmod(F.xxhash64("s"), F.col("chunks")).cast("int"))
    other = each.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return other.select("token", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "c", "g", "n", "pos", "s", "sketch")


def _few(rows: list[tuple], i: int, j: int, percent: int) -> list[tuple[int, int, int]]:
    """candidates() of a few rows."""
    found = []
    sketches = [int.from_bytes(r[4], "little") for r in rows]
    for x, (n_x, pos_x, c_x, g_x, wide_x, _, comp_x) in enumerate(rows):
        for y in range(x):
            n_y, pos_y, c_y, g_y, wide_y, _, comp_y = rows[y]
            if 100 * min(n_x, n_y) < percent * max(n_x, n_y) or comp_x == comp_y or (g_x == g_y and pos_x) or (i != j and c_x == c_y):
                continue
            alpha = -(-percent * (n_x + n_y) // (100 + percent))
            if min(n_x - pos_x, n_y - pos_y) < alpha:
                continue
            a, b, size = sketches[x], sketches[y], 8 * min(len(wide_x), len(wide_y))
            if len(wide_x) != len(wide_y):
                a, b = ((z >> size) ^ (z & ((1 << size) - 1)) if len(w) * 8 > size else z for z, w in ((a, wide_x), (b, wide_y)))
            bits = (a ^ b).bit_count()
            if bits <= n_x + n_y - 2 * alpha:
                found.append((bits, y, x))
    return sorted(found)


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches as rows of words, those of twice ``width`` bytes folded to one half."""
    out = np.zeros((len(sketches), width // 8), np.uint64)
    for row, x in zip(out, sketches, strict=True):
        np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width // 8), axis=0, out=row)
    return out


def candidates(rows: dict[str, np.ndarray], i: int, j: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, differing bits) of the pairs of rows that size, place and sketch leave, the fewest bits first."""
    n, pos, c, g, comp = (rows[k] for k in ("n", "pos", "c", "g", "comp"))
    width = np.array([len(x) for x in rows["sketch"]])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for w in np.unique(width):
        a, b = np.flatnonzero(width == w), np.flatnonzero((width == w) | (width == 2 * w))
        left, right = _folded(rows["sketch"][a], w), _folded(rows["sketch"][b], w)
        for k in range(0, len(a), 128):
            x, y = a[k : k + 128, None], b[None, :]
            both = n[x] + n[y]
            alpha = -(-percent * both // (100 + percent))
            ok = (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])) & (1 + np.minimum(n[x] - pos[x], n[y] - pos[y]) - 1 >= alpha)
            ok &= (comp[x] != comp[y]) & ((g[x] != g[y]) | (pos[x] == 0)) & ((width[y] > w) | (x < y))
            if i != j:
                ok &= c[x] != c[y]
            p, q = np.nonzero(ok)
            for z in range(0, len(p), 1 << 18):
                u, v = p[z : z + (1 << 18)], q[z : z + (1 << 18)]
                bits = np.bitwise_count(left[k + u] ^ right[v]).sum(axis=1, dtype=np.int64)
                xs, ys = a[k + u], b[v]
                near = bits <= both[u, v] - 2 * alpha[u, v]
                found.append((xs[near], ys[near], bits[near]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    x, y, bits = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(bits, kind="stable")
    return x[order], y[order], bits[order]


def spanning(parts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the edges of a spanning forest over ``parts``, the first edges where there is a choice (Boruvka)."""
    label, chosen = parts.copy(), []
    while True:
        u, v = label[x], label[y]
        alive = np.flatnonzero(u != v)
        if not len(alive):
            return np.concatenate(chosen) if chosen else alive
        ends, edges = np.r_[u[alive], v[alive]], np.r_[alive, alive]
        order = np.lexsort((edges, ends))
        first = order[np.r_[True, ends[order][1:] != ends[order][:-1]]]
        taken = np.unique(edges[first])
        chosen.append(taken)
        p, q = u[taken], v[taken]
        up = np.arange(label.max() + 1)
        while True:
            new = up.copy()
            np.minimum.at(new, p, up[q])
            np.minimum.at(new, q, up[p])
            new = new[new]
            if (new == up).all():
                break
            up = new
        label = up[label]


def _nearest(parts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the first ``PROPOSE`` edges of each part."""
    edges = np.r_[np.arange(len(x)), np.arange(len(x))]
    ends = np.r_[parts[x], parts[y]]
    order = np.lexsort((edges, ends))
    sorted_ends = ends[order]
    start = np.flatnonzero(np.r_[True, sorted_ends[1:] != sorted_ends[:-1]]) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return np.unique(edges[order[rank < PROPOSE]])


def proposals(members: DataFrame, percent: int, again: DataFrame | None = None) -> DataFrame:
    """(token, i, j, u, v): pairs of nodes, u < v, that each bucket wants verified.

    members: as buckets() gives them, with comp, the part that is connected already. again: pairs of a
    bucket that have failed.
    """
    columns = ["n", "pos", "c", "g", "sketch", "s", "comp"]
    rows = members.select(*KEY, F.lit(None).cast("binary").alias("v"), *columns)
    if again is not None:
        rows = rows.unionByName(again.select(*KEY, "v", F.col("u").alias("s")), allowMissingColumns=True)
    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY)

    def compare(i: int, j: int, block: list[tuple]) -> list[tuple[bytes, bytes]]:
        tried = {(r[6], r[0]) for r in block if r[0] is not None}
        block = [r[1:] for r in block if r[0] is None]
        if len(block) < 2:
            return []
        s = [r[5] for r in block]
        if len(block) <= MATRIX:
            pairs = [(x, y) for _, x, y in _few(block, i, j, percent)]
        else:
            cells = list(zip(*block, strict=True))
            facts = {k: np.array(cells[at], np.int64) for at, k in enumerate(("n", "pos", "c"))} | {"sketch": np.array(cells[4], object)}
            facts |= {k: np.unique(np.array(cells[at], object), return_inverse=True)[1] for at, k in ((3, "g"), (6, "comp"))}
            x, y, _ = candidates(facts, i, j, percent)
            pairs = list(zip(x.tolist(), y.tolist(), strict=True))
        if tried:
            pairs = [(x, y) for x, y in pairs if (min(s[x], s[y]), max(s[x], s[y])) not in tried]
        if len(pairs) > 1:
            parts = np.unique(np.array([r[6] for r in block], object), return_inverse=True)[1]
            x, y = np.array(pairs).T
            pairs = [pairs[k] for k in (_nearest if tried else spanning)(parts, x, y)]
        return [(min(s[x], s[y]), max(s[x], s[y])) for x, y in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = (0, 0, 0), []
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in range(3)]
            cuts = (np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1).tolist() if len(batch) else []
            facts = list(zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True))
            made: list[tuple] = []
            for a, b in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                here = tuple(int(k[a]) for k in keys) if a < b else key
                if here != key:
                    made.extend((*key, u, v) for u, v in compare(*key[1:], block))
                    key, block = here, []
                block.extend(facts[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), KINDS, strict=True)], names=NAMES) if made else pa.RecordBatch.from_pylist([], schema=pa.schema(list(zip(NAMES, KINDS, strict=True))))
        yield pa.RecordBatch.from_pylist([dict(zip(NAMES, (*key, u, v), strict=True)) for u, v in compare(*key[1:], block)], schema=pa.schema(list(zip(NAMES, KINDS, strict=True))))
        give_back()

    return dealt.mapInArrow(run, "token long, i int, j int, u binary, v binary")


def _sized(keys: DataFrame) -> DataFrame:
    """Keys to join with: to every task if they are ``MANY`` at most, by a shuffle otherwise."""
    return F.broadcast(keys) if keys.count() <= MANY else keys.hint("merge")


def whole_sets(docs: DataFrame, text_col: str, nodes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(s, hashes) of the nodes of ``pairs``, from their texts anew."""
    asked = pairs.select(F.col("u").alias("s")).unionByName(pairs.select(F.col("v").alias("s"))).distinct()
    wanted = checkpointed(nodes.select("s", "d").join(asked, "s"))
    texts = docs.select(F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("d"), F.col(text_col).alias("t"))
    one = texts.join(_sized(wanted), "d").dropDuplicates(["d"]).select("s", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column(1)], pa.binary())], names=["s", "hashes"])
        give_back()

    return one.mapInArrow(run, "s binary, hashes binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, ok) for pairs of nodes; the end with fewer partners brings its set to the other."""
    degree = pairs.select(F.col("u").alias("s")).unionByName(pairs.select(F.col("v").alias("s"))).groupBy("s").agg(F.count("*").alias("partners"))
    counted = pairs.join(degree.select(F.col("s").alias("u"), F.col("partners").alias("pu")), "u").join(degree.select(F.col("s").alias("v"), F.col("partners").alias("pv")), "v")
    hub = F.col("pu") > F.col("pv")
    turned = counted.select("u", "v", F.when(hub, F.col("v")).otherwise(F.col("u")).alias("leaf"), F.when(hub, F.col("u")).otherwise(F.col("v")).alias("hub"))
    both = turned.join(sets.select(F.col("s").alias("leaf"), F.col("hashes").alias("x")), "leaf").join(sets.select(F.col("s").alias("hub"), F.col("hashes").alias("y")), "hub").select("u", "v", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                shared = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=["u", "v", "ok"])
        give_back()

    return both.mapInArrow(run, "u binary, v binary, ok boolean")


def classes(docs: DataFrame, text_col: str, rows: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, comp) for the nodes that are linked to others."""
    met = checkpointed(near_in_size(postings(rows, nodes), percent))
    asked = checkpointed(proposals(members(met, nodes).withColumn("comp", F.col("s")), percent))
    pairs = checkpointed(asked.select("u", "v").distinct())
    sets = checkpointed(whole_sets(docs, text_col, nodes, pairs, words))
    known = checkpointed(verified(pairs, sets, percent))
    failed = None
    while True:
        labels = checkpointed(components(known.where("ok").select("u", "v"), []))
        fresh = checkpointed(asked.join(known.where("not ok").select("u", "v"), ["u", "v"]).select(*KEY, "u", "v"))
        if fresh.isEmpty():
            return labels
        failed = fresh if failed is None else failed.unionByName(fresh)
        open_ = fresh.select(*KEY).distinct()
        tokens = _sized(open_.select("token").distinct())
        there = members(met.join(tokens, "token", "left_semi"), nodes).join(_sized(open_), KEY, "left_semi")
        there = there.join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("comp", F.coalesce("comp", "s"))
        asked = checkpointed(proposals(there, percent, failed.join(_sized(open_), KEY, "left_semi")))
        new = checkpointed(asked.select("u", "v").distinct().join(known.select("u", "v"), ["u", "v"], "left_anti"))
        if not new.isEmpty():
            known = checkpointed(known.unionByName(verified(new, sets, percent)))


@names_apart("n_shingles", "component_id")
def jaccard_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = SHINGLE, percent: int = PERCENT, bits: tuple[int, int] = BITS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id.

    Two documents link when 100 * common >= ``percent`` * united shingles; component_id is the
    smallest id reachable over links, the own id included. A null, empty or blank text has no
    shingles and no links. Rows that repeat an id count each. Null ids are never smallest, unless a
    component has no other. Other columns of ``docs`` are not looked at; an empty table gives an empty result.
    Sets are of 64-bit hashes: that two shingles of a text collide is as likely as one in 2 to the 64 per pair.
    """
    rows = checkpointed(describe(docs, text_col, id_col, words, percent, bits))
    some = rows.where("n > 0")
    nodes = checkpointed(some.select("s", "g", "d", "n", "sketch").dropDuplicates(["s"]))
    own = some.groupBy("s").agg(F.min("id").alias("own"), F.count("*").alias("copies"))
    known = own.join(classes(docs, text_col, some, nodes, words, percent).withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("comp", "s"))
    tops = known.groupBy("root").agg(F.min("own").alias("component"))
    met = join_skewed(some.select("id", "n", "s"), known.join(tops, "root").select("s", "component", "copies"), "s", "copies")
    empty = rows.where("n = 0").select("id", "n", F.col("id").alias("component"))
    return met.select("id", "n", "component").unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
