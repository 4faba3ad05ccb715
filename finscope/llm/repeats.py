"""Windows of a fixed length that occur more than once, found over the whole corpus.

The way, the same for words and for bytes:

1. Each text gives its anchors (see `anchors`); anchors of one place only are
   done with.
2. A bitmap of the repeated anchors, if its size is within a bound, spares the
   shuffle the others; the join that follows is exact with or without it.
3. Equal runs are aggregated before they are shuffled: a passage that a third of
   all documents share is one row a task, and one run with a count.
4. The texts of the different runs, each once, are compared by the operator's own
   method, all runs of an anchor together. Where an anchor has more than `group`
   different runs, they are cut to slices of fewer windows, which are grouped by
   all that the windows of a slice have in common, equal slices are aggregated,
   and the method goes on with those; the last slices are single windows.
5. What was found about each run goes back to the documents that have it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finscope.llm import anchors
from finscope.llm.anchors import PORTION
from finscope.llm.shared import LAST, written  # noqa: F401

RUN = "anchor long, snip long, who long, text_key long, first int, shape int"
PIECE = ["anchor", "snip", "shape", "least", "n", "piece"]
MARKS = "array<struct<first: int, count: int, least: bigint>>"


class Words:
    """Units are words; a text is its words joined by one space."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k

    def units(self, text: str | None) -> list[bytes]:
        return (text or "").encode().split()

    def joined(self, units, first: int, count: int) -> bytes:
        return b" ".join(units[first : first + count])

    def step(self, units: list[bytes], first: int) -> int:
        """Windows from `first` on that go in one part: as many as half a portion of bytes holds, one at least."""
        most = PORTION // 8
        sizes = np.cumsum(np.fromiter(map(len, units[first : first + most]), np.int64))
        return max(1, int(np.searchsorted(sizes, PORTION // 2)))

    def values(self, parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(buffer, hash of each unit, units of each part, start and end of each unit in the buffer)."""
        buffer = b" ".join(parts)
        raw = np.frombuffer(buffer, np.uint8)
        space = np.flatnonzero(raw == 32)
        start, end = np.concatenate([[0], space + 1]), np.concatenate([space, [len(raw)]])
        s = anchors.sums(anchors.BYTE[raw])
        h = anchors.mixed(anchors.span(s, start, end, start) + (end - start).astype(np.uint64))
        return buffer, h, np.array([p.count(b" ") + 1 for p in parts]), start, end


class Bytes:
    """Units are the bytes of the text's UTF-8 form."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k

    def units(self, text: str | None) -> bytes:
        return (text or "").encode()

    def joined(self, units, first: int, count: int) -> bytes:
        return units[first : first + count]

    def step(self, units: bytes, first: int) -> int:
        return PORTION // 2

    def values(self, parts: list[bytes]):
        buffer = b"".join(parts)
        raw = np.frombuffer(buffer, np.uint8)
        at = np.arange(len(raw))
        return buffer, anchors.BYTE[raw], np.array(list(map(len, parts))), at, at + 1


def _portions(texts, unit):
    """Lists of (row, first unit, part of the text), about PORTION bytes in all; a long text is cut into parts that share what a window covers."""
    held, size = [], 0
    for row, text in enumerate(texts):
        units = unit.units(text)
        first, windows = 0, len(units) - unit.length + 1
        while first < windows:
            step = unit.step(units, first)
            part = unit.joined(units, first, min(step, windows - first) + unit.length - 1)
            if held and size + len(part) > PORTION:
                yield held
                held, size = [], 0
            held.append((row, first, part))
            size += len(part) + 1
            first += step
    if held:
        yield held


def run_rows(docs: DataFrame, unit, bitmap=None) -> DataFrame:
    """A row for each run: its anchor, a hash of what it covers, and where it is; shape holds its windows and the anchor's place in it."""

    def work(batches):
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for held in _portions((x.as_py() for x in batch.column(2)), unit):
                buffer, values, sizes, start, end = unit.values([p for _, _, p in held])
                stop = np.cumsum(sizes)
                h = anchors.grams(values, unit.k)
                a, n, p = anchors.runs(h, np.repeat(stop, sizes), unit.k, unit.length)
                anchor = h[p]
                if bits is not None:
                    keep = bits[(anchor & np.uint64(len(bits) * 8 - 1)) >> np.uint64(3)] >> (anchor & np.uint64(7)).astype(np.uint8) & 1 > 0
                    a, n, p, anchor = a[keep], n[keep], p[keep], anchor[keep]
                part = np.searchsorted(stop, a, side="right")
                rows = np.array([r for r, _, _ in held])[part]
                first = a - (stop - sizes)[part] + np.array([f for _, f, _ in held])[part]
                cover = zip(start[a].tolist(), end[a + n - 2 + unit.length].tolist())
                snip = np.fromiter((xxhash.xxh3_64_intdigest(buffer[x:y]) for x, y in cover), np.uint64, len(a))
                shape = (n << 16 | p - a).astype(np.int32)
                columns = [pa.array(anchor.view(np.int64)), pa.array(snip.view(np.int64)), pa.array(ids[rows]), pa.array(keys[rows]), pa.array(first.astype(np.int32)), pa.array(shape)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "snip", "who", "text_key", "first", "shape"])

    return docs.select("who", "text_key", "text").mapInArrow(work, RUN)


def bitmap_of(keys: DataFrame, limit_bytes: int = 1 << 23):
    """A broadcast bitmap of the low bits of `anchor`, or None where limit_bytes would leave fewer than four bits a key.

    It is made in pieces of 64 KB on the executors; the driver gets no keys.
    """
    n = keys.count()
    size = min(1 << max(10, (12 * n).bit_length()), 8 * limit_bytes)
    if size < 4 * n:
        return None
    piece = min(size, 1 << 19)

    def work(batches):
        chunk, bits = None, None
        for batch in batches:
            chunks, at = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for c in np.unique(chunks):
                if c != chunk:
                    if bits is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])
                    chunk, bits = int(c), np.zeros(piece, bool)
                bits[at[chunks == c]] = True
        if bits is not None:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    low = keys.selectExpr(f"(anchor & {size - 1}L) DIV {piece}L AS chunk", f"anchor & {piece - 1}L AS bit").distinct()
    out = np.zeros(size // 8, np.uint8)
    for r in low.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(work, "chunk long, bits binary").collect():
        first = r["chunk"] * piece // 8
        out[first : first + piece // 8] = np.frombuffer(r["bits"], np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out)


def candidates(docs: DataFrame, unit, across: bool) -> DataFrame:
    """The runs whose anchor is in two documents of different id (across), or at any two places."""
    rows = run_rows(docs, unit)
    if across:
        seen = rows.groupBy("anchor").agg(F.min("who").alias("a"), F.max("who").alias("b")).where("a < b")
    else:
        seen = rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    repeated = written(seen.select("anchor"), "anchors")
    return written(run_rows(docs, unit, bitmap_of(repeated)).join(repeated, "anchor", "left_semi"), "runs")


def distinct_runs(cand: DataFrame) -> DataFrame:
    """One row for each different run: who has it first, how often it occurs, and one place of it."""
    out = cand.groupBy("anchor", "snip").agg(F.min(F.struct("who", "text_key", "first", "shape")).alias("at"), F.count("*").alias("n"))
    return written(out.select("anchor", "snip", "at", F.col("at.who").alias("least"), "n"), "distinct-runs")


def run_texts(docs: DataFrame, runs: DataFrame, unit) -> DataFrame:
    """(anchor, snip, shape, least, n, piece): each of the runs with its text. Docs and places meet by document, so no text is repeated."""
    by_doc = runs.groupBy(F.col("at.who").alias("who"), F.col("at.text_key").alias("text_key")).agg(F.collect_list(F.struct("anchor", "snip", "at.first", "at.shape", "least", "n")).alias("want"))
    # doc_id is taken along only so that the shuffle of the texts is the one that `found_by_document` uses again.
    met = docs.join(by_doc.hint("shuffle_hash"), ["who", "text_key"]).select("text", "want", "doc_id")

    def work(batches):
        for batch in batches:
            want = batch.column(1)
            ends, flat = want.offsets.to_pylist(), want.flatten()
            field = lambda name: flat.field(name)
            first, counts = field("first").to_pylist(), (np.asarray(field("shape")) // (1 << 16) - 1 + unit.length).tolist()
            pieces, at = [], ends[0]
            for i, end in enumerate(ends[1:]):
                units = unit.units(batch.column(0)[i].as_py())
                pieces += [unit.joined(units, first[j - ends[0]], counts[j - ends[0]]) for j in range(at, end)]
                at = end
            yield pa.RecordBatch.from_arrays([*map(field, PIECE[:-1]), pa.array(pieces, pa.binary())], names=PIECE)

    return met.mapInArrow(work, "anchor long, snip long, shape int, least long, n long, piece binary")


def marks_array(owner: np.ndarray, index: np.ndarray, least: np.ndarray, runs: int) -> pa.Array:
    """For each run the stretches of its repeated windows, (first, count, least): windows `index` of runs `owner`, in order; those of one stretch have the same least."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (index[1:] != index[:-1] + 1) | (least[1:] != least[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(owner)))
    fields = [pa.array(index[at].astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(least[at].astype(np.int64))]
    offsets = np.searchsorted(owner[at], np.arange(runs + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, names=["first", "count", "least"]))


def by_group(pieces: DataFrame, method, chunk: int = 1 << 19) -> DataFrame:
    """(anchor, snip, marks): method(groups, shapes, least, n, pieces) on some whole groups at a time, about `chunk` bytes of text; it returns the arguments of `marks_array`."""
    ordered = pieces.select(*PIECE).repartition("anchor").sortWithinPartitions("anchor", "snip")

    def work(batches):
        held, size = [], 0

        def done():
            anchor, snip, shape, least, n, piece = zip(*held)
            groups = np.cumsum(np.concatenate([[0], np.diff(np.array(anchor)) != 0]))
            found = marks_array(*method(groups, np.array(shape), np.array(least), np.array(n), list(piece)), len(held))
            return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(snip, pa.int64()), found], names=["anchor", "snip", "marks"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > chunk and row[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(row)
                size += len(row[-1])
        if held:
            yield done()

    return ordered.mapInArrow(work, f"anchor long, snip long, marks {MARKS}")


def sliced(pieces: DataFrame, unit, width: int) -> DataFrame:
    """Slices of runs: windows whose starts are at most `width` apart, counted from the anchor so that equal windows are in slices of the same number.

    run and run_snip name the run, shift is the slice's first window in it; the
    other columns are those of a run. The slice's own `anchor` is made of all
    that its windows have in common, so slices meet only where that is equal.
    """
    names = ["run", "run_snip", "shift", *PIECE]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def work(batches):
        for batch in batches:
            for anchor, snip, shape, least, n, piece in zip(*(c.to_pylist() for c in batch.columns)):
                units, windows, place, out = unit.units_of_piece(piece), shape >> 16, shape & 0xFFFF, []
                for number in range((place - windows + 1) // width, place // width + 1):
                    first, last = max(0, place - (number + 1) * width + 1), min(windows - 1, place - number * width)
                    own = unit.joined(units, first, last - first + unit.length)
                    core = unit.joined(units, place - number * width, unit.length - width + 1)
                    key = xxhash.xxh3_64_intdigest(core, (anchor ^ number * 0x9E3779B97F4A7C15) & LAST) - (1 << 63)
                    out.append((anchor, snip, first, key, xxhash.xxh3_64_intdigest(own) - (1 << 63), (last - first + 1) << 16 | place - first, least, n, own))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return pieces.select(*PIECE).mapInArrow(work, "run long, run_snip long, shift int, anchor long, snip long, shape int, least long, n long, piece binary")


def marks_of(runs: DataFrame, pieces: DataFrame, unit, method, group: int, widths: list[int]) -> DataFrame:
    """(anchor, snip, marks) of all runs. Groups of over `group` different runs go on as slices of widths[0] windows, and so on; a slice of one window shares its group with none but equals."""
    hot = runs.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > group)
    if not widths or not hot.limit(1).count():
        return by_group(pieces, method)
    hot = written(hot.select("anchor", F.lit(True).alias("hot")), "hot-anchors")
    flagged = written(pieces.join(hot, "anchor", "left"), "pieces")
    parts = written(sliced(flagged.where("hot"), unit, widths[0]), "slices")
    each = parts.groupBy("anchor", "snip").agg(F.min("least").alias("least"), F.sum("n").alias("n"), F.any_value("shape").alias("shape"), F.any_value("piece").alias("piece"))
    each = written(each, "different-slices")
    told = written(marks_of(each, each, unit, method, group, widths[1:]).where(F.size("marks") > 0), "slice-marks")
    moved = F.transform("marks", lambda m: F.struct((m["first"] + F.col("shift")).alias("first"), m["count"].alias("count"), m["least"].alias("least")))
    back = parts.select("run", "run_snip", "shift", "anchor", "snip").join(told, ["anchor", "snip"]).select("run", "run_snip", moved.alias("marks"))
    back = back.groupBy("run", "run_snip").agg(F.flatten(F.collect_list("marks")).alias("marks"))
    return by_group(flagged.where("hot IS NULL"), method).unionByName(back.select(F.col("run").alias("anchor"), F.col("run_snip").alias("snip"), "marks"))


Words.units_of_piece = staticmethod(lambda piece: piece.split(b" "))
Bytes.units_of_piece = staticmethod(lambda piece: piece)


#: A stretch of windows is one number: where it starts, and its length in the lowest bits.
STRETCH_BITS = 20


def marked_places(cand: DataFrame, marks: DataFrame, keep=None) -> DataFrame:
    """(who, text_key, found): the stretches of repeated windows of each run of cand; keep tells which marks count.

    The marks are a table by themselves, so Spark can split an anchor and run
    that very many places have.
    """
    met = cand.join(written(marks.where(F.size("marks") > 0), "marks"), ["anchor", "snip"])
    counted = F.filter("marks", keep) if keep else F.col("marks")
    packed = F.transform(counted, lambda m: F.shiftleft((F.col("first") + m["first"]).cast("long"), STRETCH_BITS).bitwiseOR(m["count"].cast("long")))
    return met.select("who", "text_key", packed.alias("found")).where(F.size("found") > 0)


def stretches(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of all that was found in a text."""
    return found >> STRETCH_BITS, found & ((1 << STRETCH_BITS) - 1)


def found_by_document(docs: DataFrame, found: DataFrame, finish, fields: str) -> DataFrame:
    """docs, each with what was found in it: `finish` gets the text and an array of stretches, and returns a tuple of the `fields`."""
    from pyspark.sql.types import StructType

    by_doc = found.groupBy("who", "text_key").agg(F.flatten(F.collect_list("found")).alias("found"))
    met = docs.join(by_doc.hint("shuffle_hash"), ["who", "text_key"], "left").select("doc_id", "text", F.coalesce("found", F.array().cast("array<bigint>")).alias("found"))
    made = StructType.fromDDL(fields)

    def work(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(made)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                ends, flat = part.column(2).offsets.to_pylist(), np.asarray(part.column(2).flatten(), dtype=np.int64)
                rows = [finish(t, flat[a - ends[0] : b - ends[0]]) for t, a, b in zip(part.column(1).to_pylist(), ends, ends[1:])]
                columns = [pa.array(list(c), k.type) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k.type) for k in kinds]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", *made.names])

    return met.mapInArrow(work, StructType([docs.schema["doc_id"], *made.fields]))
