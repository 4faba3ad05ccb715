"""SimHash fingerprints, linked within a Hamming distance by the generalised pigeonhole principle.

Fingerprint bits that go together are grouped into m parts; part i gets a
threshold t_i >= -1 with sum(t_i) >= k - m + 1, so two fingerprints within k bits
are within t_i in at least one part. Each fingerprint is dealt to the values
within t_i / 2 of its part, where those two meet. A dynamic programme over the parts takes the
thresholds, and m, that cost least by the estimated numbers of candidates and
probes; the estimates come from the bit counts of all fingerprints.

Equal fingerprints are one node, so thousands of exact copies cost one. A
bucket of more than `bucket` nodes is dealt out as a triangle of cells, each of
at most two blocks, so that every pair still meets once; a cell returns a
spanning forest of its links, nearest first, and never all pairs.

Defined cases: null and blank texts have fingerprint zero and are linked like
any other; texts of fewer words than a shingle have their whole sequence as the
one shingle; a null id never names a component unless all its ids are null;
repeated rows are returned as often as they come; an empty table gives an empty
result; other columns are dropped by `fingerprints` and kept by `deduped`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, repeat
from math import acos, comb, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.llm.repeats import bitmap_of
from finscope.llm.shared import appended, mixed, written
from finscope.matching.components import connected_components

BITS = 64
#: Shingles of a text that are hashed at a time.
STRETCH = 1 << 18
#: 64-bit words of a wide fingerprint, and bits of a key that is drawn from it.
WORDS, KEY_BITS = 4, 16
_SALTS = np.array([0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) for i in range(WORDS)], np.uint64)


def shingles(words: list[bytes], width: int):
    """Lists of space-joined shingles, in order; at most STRETCH in a list."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(1, len(words) - width + 1)
    width = min(width, len(words))
    for first in range(0, last, STRETCH):
        a, b = starts[first : min(first + STRETCH, last)].tolist(), ends[first + width - 1 : min(first + STRETCH, last) + width - 1].tolist()
        yield [joined[i:j] for i, j in zip(a, b)]


def fingerprint(text: str | None, width: int, seed: int = 42) -> int:
    """64 bits; bit b is set if it is in over half of the shingles' XXH64."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    votes, n = np.zeros(BITS, np.int64), 0
    for pieces in shingles(words, width):
        h = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), "<u8", len(pieces))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(pieces)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long."""

    def start():
        def work(batch: pa.RecordBatch):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            return [pa.array(np.array([fingerprint(t, width) for t in texts], np.uint64).view(np.int64))]

        return work

    return appended(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "fp long", start).drop("text")


@dataclass(frozen=True)
class Plan:
    """parts: bit numbers of each part; thresholds: of each part, -1 where it isn't probed."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def bit_counts(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """(fingerprints, how often both of two bits are set), over all fingerprints; 64 x 64 sums reach the driver."""

    def work(batches):
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            x = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float32)
            both += np.rint(x.T @ x).astype(np.int64)
            n += len(x)
        cells = np.arange(BITS * BITS)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cells, -1)), pa.array(np.append(both.ravel(), n))], names=["cell", "n"])

    sums = nodes.select("fp").mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    found = {r["cell"]: r["n"] for r in sums}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """m parts of near equal size; each grows by the free bit that correlates most with it."""
    q = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(q * (1 - q), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(q, q)) / np.outer(spread, spread))
    free, parts = list(range(BITS)), []
    for i in range(m):
        part = [free.pop(0)]
        while len(part) < BITS // m + (i < BITS % m):
            part.append(free.pop(int(np.argmax(corr[np.ix_(free, part)].mean(axis=1)))))
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def allocate(n: int, both: np.ndarray, parts, k: int, pair_cost: float = 0.05) -> tuple[tuple[int, ...], float]:
    """Thresholds of least cost (probe rows, plus pair_cost for each candidate pair), by dynamic programming over the parts.

    A pair takes about a hundredth of a row's time; it is weighed higher because
    pairs grow with the square of the input, and rows don't.
    Two values within 2r bits of each other have a common value within r bits of
    each, so thresholds are even: the odd ones below cost the same.
    """
    q = np.diag(both) / max(n, 1)
    agree = q * q + (1 - q) * (1 - q)
    total = k - len(parts) + 1
    best = {-len(parts): (0.0, ())}
    for part in parts:
        near = np.array([1.0])  # chance of each distance within the part
        for b in part:
            near = np.convolve(near, [agree[b], 1 - agree[b]])
        options = [(-1, 0.0)]
        for r in range((min(k, len(part)) + 1) // 2 + 1):
            # Of the values within r bits, how many two fingerprints at each distance have in common.
            shared = [sum(comb(d, i) * comb(len(part) - d, j) for i in range(d + 1) for j in range(r + 1) if max(i, d - i) + j <= r) for d in range(len(near))]
            probes = sum(comb(len(part), j) for j in range(r + 1))
            options.append((2 * r, n * probes + pair_cost * n * n / 2 * float(np.dot(near, shared))))
        new: dict[int, tuple[float, tuple]] = {}
        for used, (cost, chosen) in best.items():
            for t, more in options:
                at = min(used + 1 + t, total)
                if (found := (cost + more, (*chosen, t))) < new.get(at, (float("inf"),)):
                    new[at] = found
        best = new
    cost, chosen = best[total] if total in best else (float("inf"), ())
    return chosen, cost


def plan(n: int, both: np.ndarray, k: int) -> Plan:
    found = []
    for m in range(1, min(k + 2, 12) + 1):
        parts = correlated_parts(n, both, m)
        thresholds, cost = allocate(n, both, parts, k)
        found.append(Plan(parts, thresholds, cost))
    return min(found, key=lambda p: p.cost)


@lru_cache
def _masks(width: int, t: int) -> np.ndarray:
    """All words of `width` bits with at most t set, the empty one first."""
    return np.array([sum(1 << b for b in bits) for j in range(t + 1) for bits in combinations(range(width), j)], np.uint64)


def probes(nodes: DataFrame, chosen: Plan) -> DataFrame:
    """(part, value, fp): a row for each value within half its threshold of the one that a part has."""

    def work(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for i, (bits, t) in enumerate(zip(chosen.parts, chosen.thresholds)):
                if t < 0:
                    continue
                value = np.zeros(len(fp), np.uint64)
                for at, b in enumerate(bits):
                    value |= (fp >> np.uint64(b) & np.uint64(1)) << np.uint64(at)
                masks = _masks(len(bits), t // 2)
                for first in range(0, len(fp), step := max(1, 200_000 // len(masks))):
                    own = fp[first : first + step]
                    near = (value[first : first + step, None] ^ masks).ravel()
                    columns = [np.full(len(near), i, np.int32), near.view(np.int64), np.repeat(own, len(masks)).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "value", "fp"])

    return nodes.select("fp").mapInArrow(work, "part int, value long, fp long")


def dealt(rows: DataFrame, words: list[str], bucket: int) -> DataFrame:
    """rows with `cell`: 0 for a bucket that fits, else its rows are repeated over the cells (s, t), s <= t, of its blocks; words name the fingerprint's columns."""
    sizes = written(rows.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > bucket), "large-buckets")
    if not sizes.limit(1).count():
        return rows.withColumns({"cell": F.lit(0), "block": F.lit(0), "blocks": F.lit(1)})
    out = rows.join(sizes, ["part", "value"], "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1)).cast("int"))
    out = out.withColumn("block", F.pmod(F.xxhash64(*words), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return out.withColumn("other", other).withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")).drop("n", "other")


def spanning(a: np.ndarray, b: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Places, in a and b, of the edges of a spanning forest over n nodes, nearer edges first."""
    label, out = np.arange(n), []
    for t in np.unique(distance):
        e = np.flatnonzero(distance == t)
        while len(e):
            x, y = label[a[e]], label[b[e]]
            apart = x != y
            e, x, y = e[apart], x[apart], y[apart]
            # Every component hangs itself on one with a smaller label, by one edge.
            upper, pick = np.unique(np.maximum(x, y), return_index=True)
            out.append(e[pick])
            up = np.arange(n)
            up[upper] = np.minimum(x, y)[pick]
            while (up != up[up]).any():
                up = up[up]
            label = up[label]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which rows of x and y differ; a row is one word, or several."""
    apart = np.bitwise_count(x ^ y)
    return apart if apart.ndim == 1 else apart.sum(axis=1, dtype=np.uint16)


def cell_links(keys: np.ndarray, fp: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a nearest-first spanning forest of the links within runs of equal keys. Rows are compared with the one d further on, d = 1, 2, ..."""
    n, none = len(fp), np.zeros(0, np.int64)
    found = [(none, none, none.astype(np.uint16))]
    at, d, held = np.arange(n - 1), 1, 0

    def thinned():
        a, b, near = (np.concatenate(x) for x in zip(*found))
        keep = spanning(a, b, near, n)
        return [(a[keep], b[keep], near[keep])]

    while len(at):
        at = at[at + d < n]
        at = at[keys[at] == keys[at + d]]
        likely = at
        if fp.ndim == 2:  # a distance in the first word that no pair within k would have by chance spares the other words
            likely = at[np.bitwise_count(fp[at, 0] ^ fp[at + d, 0]) <= k // WORDS + 10]
        apart = differing(fp[likely], fp[likely + d])
        near = (apart <= k) & (apart > 0)
        if near.any():
            found.append((likely[near], likely[near] + d, apart[near]))
            held += int(near.sum())
        if held > 2_000_000:
            found, held = thinned(), 0
        d += 1
    ((a, b, _),) = thinned()
    return a, b


def links(nodes: DataFrame, k: int, bucket: int = 2048, chosen: Plan | None = None) -> DataFrame:
    """(a, b): some of the pairs within k bits; they connect whatever all of those pairs connect. `nodes` has distinct fp."""
    if chosen is None:
        chosen = plan(*bit_counts(nodes), k)
    return linked(probes(nodes, chosen), ["fp"], k, bucket)


def stars(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what those of a forest over n nodes do: from the first node of each component to each of the others."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, label[a], label[b])
        np.minimum.at(low, label[b], label[a])
        low = low[label]
        while (low != low[low]).any():
            low = low[low]
        if (low == label).all():
            others = np.flatnonzero(label != np.arange(n))
            return label[others], others
        label = low


def linked(rows: DataFrame, words: list[str], k: int, bucket: int, as_stars: bool = False) -> DataFrame:
    """(a, b): first words of the links within k bits, over all words, of rows with the same part and value; a forest of each cell.

    as_stars: instead, links of each component of a cell to its least member, which
    may be further away. A large component has much the same one in all parts, so
    that few of the links are different.
    """
    rows = dealt(rows, words, bucket)
    ordered = rows.repartition("part", "value", "cell").sortWithinPartitions("part", "value", "cell", "block", *words).select("part", "value", "cell", *words)

    def work(batches):
        rest = None

        def found(t):
            part, value, cell = t[:3]
            new = np.concatenate([[True], (part[1:] != part[:-1]) | (value[1:] != value[:-1]) | (cell[1:] != cell[:-1])])
            fp = t[3].view(np.uint64) if len(words) == 1 else np.stack([w.view(np.uint64) for w in t[3:]], axis=1)
            a, b = cell_links(np.cumsum(new), fp, k)
            if as_stars:
                a, b = stars(a, b, len(fp))
            return pa.RecordBatch.from_arrays([pa.array(t[3][a]), pa.array(t[3][b])], names=["a", "b"])

        for batch in batches:
            t = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + len(words))]
            t = t if rest is None else [np.concatenate(x) for x in zip(rest, t)]
            # The last run may go on in the next batch; a run is at most two blocks.
            same = (t[0] == t[0][-1]) & (t[1] == t[1][-1]) & (t[2] == t[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [x[cut:] for x in t]
            if cut:
                yield found([x[:cut] for x in t])
        if rest is not None and len(rest[0]):
            yield found(rest)

    return ordered.mapInArrow(work, "a long, b long").distinct()


def components(prints: DataFrame, k: int = 3, bucket: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id) for rows of (doc_id, fp): component_id is the least doc_id that links reach."""
    prints = written(prints, "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-nodes")
    roots = connected_components(links(nodes, k, bucket))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def wide(text: str | None, width: int) -> np.ndarray:
    """256 bits in four words; each different shingle votes once, with an independent 64-bit hash for each word."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(WORDS, np.uint64)
    h = np.unique(np.concatenate([np.fromiter(map(xxhash.xxh64_intdigest, p), np.uint64, len(p)) for p in shingles(words, width)]))
    votes, step = np.zeros(WORDS * BITS, np.int64), 1 << 13
    for first in range(0, len(h), step):
        own = mixed(h[first : first + step, None] ^ _SALTS).astype("<u8")
        votes += np.unpackbits(own.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * votes > len(h), bitorder="little").view("<u8")


def differing_share(similarity: float) -> float:
    """Expected share of bits in which two sets of this Jaccard similarity differ: their angle over pi."""
    return acos(2 * similarity / (1 + similarity)) / pi


def chances(similarity: float) -> np.ndarray:
    """Chance of each distance between the wide fingerprints of two sets of this similarity."""
    n, p = WORDS * BITS, differing_share(similarity)
    return np.array([comb(n, d) * p**d * (1 - p) ** (n - d) for d in range(n + 1)])


def sampling(similarity: float, recall: float) -> tuple[int, int]:
    """(k, tables): pairs of this similarity are within k bits but for a tenth of what may be lost, and meet in one of the tables and are within k with the stated recall."""
    n, near = WORDS * BITS, chances(similarity)
    k = int(np.argmax(near.cumsum() >= 1 - (1 - recall) / 10))
    meet = np.array([comb(n - d, KEY_BITS) / comb(n, KEY_BITS) for d in range(n + 1)])
    tables = 1
    while float((near * (1 - (1 - meet) ** tables))[: k + 1].sum()) < recall:
        tables += 1
    return k, tables


def sampled(nodes: DataFrame, tables: int) -> DataFrame:
    """(part, value, w0 ...): a row for each table; its value is that of KEY_BITS bits, which are drawn anew for each table."""
    names = [f"w{i}" for i in range(WORDS)]
    rng = np.random.default_rng(42)
    drawn = [rng.choice(WORDS * BITS, KEY_BITS, replace=False) for _ in range(tables)]

    def work(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 4096):
                part = batch.slice(first, 4096)
                words = [part.column(i).to_numpy() for i in range(WORDS)]
                bits = np.unpackbits(np.stack(words, axis=1).astype("<i8").view(np.uint8), axis=1, bitorder="little")
                for i, own in enumerate(drawn):
                    value = np.packbits(np.ascontiguousarray(bits[:, own]), axis=1, bitorder="little").view("<u2")[:, 0].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), i, np.int32)), pa.array(value), *map(pa.array, words)], names=["part", "value", *names])

    return nodes.select(*names).mapInArrow(work, "part int, value long, " + ", ".join(f"{n} long" for n in names))


def prints_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_key, w0 ..., content): words of the wide fingerprint; content is a 128-bit hash of the lower-case words."""

    def start():
        def work(batch: pa.RecordBatch):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            fps = np.array([wide(t, width) for t in texts], np.uint64).reshape(-1, WORDS).view(np.int64)
            return [*(pa.array(np.ascontiguousarray(fps[:, i])) for i in range(WORDS)), pa.array([xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in texts], pa.binary())]

        return work

    return appended(docs, ", ".join(f"w{i} long" for i in range(WORDS)) + ", content binary", start).drop("text")


def shingle_sets(docs: DataFrame, width: int, nodes: DataFrame) -> DataFrame:
    """(content, shingles) for the contents in `nodes`; shingles are 64-bit hashes, each once.

    A bitmap of bounded size spares most other texts the hashing; the join is
    exact with or without it.
    """
    bitmap = bitmap_of(nodes.select(F.xxhash64("content").alias("anchor")))
    rows = docs.select("text_key", "text")

    def start():
        bits = None if bitmap is None else bitmap.value

        def work(batch: pa.RecordBatch):
            contents, sets = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                words = (text or "").encode().lower().split()
                content = xxhash.xxh3_128_digest(b" ".join(words))
                key = xxhash.xxh64_intdigest(content, 42)  # what xxhash64 of Spark gives for these bytes
                wanted = bits is None or bits[(key & (len(bits) * 8 - 1)) >> 3] >> (key & 7) & 1
                contents.append(content if wanted else None)
                own = {xxhash.xxh64_intdigest(p) for pieces in shingles(words, width) for p in pieces} if wanted and words else ()
                sets.append(np.fromiter(own, np.uint64, len(own)).view(np.int64))
            return [pa.array(contents, pa.binary()), pa.array(sets, pa.list_(pa.int64()))]

        return work

    made = appended(rows, "content binary, shingles array<bigint>", start).drop("text", "text_key").where("content IS NOT NULL")
    return made.groupBy("content").agg(F.any_value("shingles").alias("shingles")).join(nodes, "content", "left_semi")


def similar_pairs(blocks: np.ndarray, sets: list[np.ndarray], min_similarity: float) -> list[tuple[int, int]]:
    """Places of pairs of similar sets; they connect whatever all similar pairs connect. Where there are two blocks, only pairs across them count."""
    sizes, across = np.array([len(s) for s in sets]), len(np.unique(blocks)) > 1
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    mark, label, out = np.zeros(len(ids) + 1, np.int32), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, len(sets))
        j = j[(label[j] != label[i]) & (sizes[j] > 0) & (np.minimum(sizes[j], sizes[i]) >= min_similarity * np.maximum(sizes[j], sizes[i]))]
        if across:
            j = j[blocks[j] != blocks[i]]
        if not len(j):
            continue
        mark[own[i]] = 1
        both = np.add.reduceat(mark[np.concatenate([own[x] for x in j])], np.cumsum(sizes[j]) - sizes[j])
        mark[own[i]] = 0
        hits = j[both >= min_similarity * (sizes[i] + sizes[j] - both)]
        met, first = np.unique(label[hits], return_index=True)
        out += [(i, int(x)) for x in hits[first]]
        label[np.isin(label, met)] = label[i]
    return out


def verified(candidates: DataFrame, sets: DataFrame, min_similarity: float, block: int = 1 << 20) -> DataFrame:
    """(u, v): similar pairs that connect whatever all similar pairs do that candidates connect, directly or by others.

    What candidates connect is a family. All its pairs are compared, unless
    similar ones already connect them, so the thinning of candidates loses
    none. A family of more than `block` shingles is dealt out as a triangle of
    cells of two blocks each.
    """
    rows = connected_components(candidates, "u", "v").join(sets, F.col("node") == F.col("content")).select("root", "content", "shingles")
    sizes = rows.groupBy("root").agg(F.sum(F.size("shingles")).alias("n")).withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
    rows = rows.join(sizes.drop("n"), "root").withColumn("block", F.pmod(F.xxhash64("content"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    ordered = rows.repartition("root", "cell").sortWithinPartitions("root", "cell").select("root", "cell", "block", "content", "shingles")

    def work(batches):
        run, held = None, []

        def found():
            pairs = similar_pairs(np.array([h[0] for h in held]), [h[2] for h in held], min_similarity) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([held[p[at]][1] for p in pairs], pa.binary()) for at in (0, 1)], names=["u", "v"])

        for batch in batches:
            lists = batch.column(4)
            flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, (root, cell, own, content) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                if (root, cell) != run:
                    yield found()
                    run, held = (root, cell), []
                held.append((own, content, flat[ends[i] : ends[i + 1]].copy()))
        yield found()

    return ordered.mapInArrow(work, "u binary, v binary")


def deduped(docs: DataFrame, width: int = 5, recall: float = 0.97, min_similarity: float = 0.8, bucket: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first document, by id, of each group of near duplicates.

    Texts of the same words are copies. Others are candidates if their wide
    fingerprints over `width`-word shingles meet in a table and are near enough,
    which a pair of exactly min_similarity does with the chance `recall`, and
    more similar ones do more often. They are linked if the Jaccard similarity of
    their shingles is at least min_similarity; links join groups. Of copies with
    the same id the one with the least text hash stays, and of rows with the
    same id and text one stays; null ids come last.
    """
    keyed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_key": F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    rows = keyed.select(F.col("_id").alias("doc_id"), F.col("_key").alias("text_key"), F.col(text_col).alias("text"))
    prints = written(prints_of(rows, width), "prints")
    words = [f"w{i}" for i in range(WORDS)]
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    texts = written(prints.groupBy("content").agg(*[F.min(w).alias(w) for w in words], F.min(place).alias("first")), "texts")
    k, tables = sampling(min_similarity, recall)
    edges = linked(sampled(texts.select(*words).distinct(), tables), words, k, bucket, as_stars=True).where("a <> b")
    heads = written(texts.groupBy("w0").agg(F.min("content").alias("head")), "heads")
    a, b = heads.select(F.col("w0").alias("a"), F.col("head").alias("u")), heads.select(F.col("w0").alias("b"), F.col("head").alias("v"))
    across = edges.join(a, "a").join(b, "b").select("u", "v")
    within = texts.join(heads, "w0").where("content <> head").select(F.col("content").alias("u"), F.col("head").alias("v"))
    edges = written(across.unionByName(within), "near-edges")
    nodes = written(edges.select(F.explode(F.array("u", "v")).alias("content")).distinct(), "near-nodes")
    sets = written(shingle_sets(rows, width, nodes), "shingle-sets")
    similar = verified(edges, sets, min_similarity)
    roots = connected_components(similar.select("u", "v"), "u", "v")
    named = texts.join(roots, texts["content"] == roots["node"], "left").select("content", "first", F.coalesce("root", "content").alias("root"))
    stay = named.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_key")
    stay = stay.select(F.col("doc_id").alias("s_id"), F.col("text_key").alias("s_key"))
    on = F.col("_id").eqNullSafe(F.col("s_id")) & (F.col("_key") == F.col("s_key"))
    kept = keyed.join(stay.hint("shuffle_hash"), on, "left_semi")
    many = prints.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if many:
        kept = kept.dropDuplicates(["_id", "_key"])
    return kept.select(*docs.columns)
