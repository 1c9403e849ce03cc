"""Operator 7, exact substring dedup over a prefix-free parsing of the corpus.

Every 400-byte string that starts in two places is found, wherever the places are, and the bytes that such
strings cover are removed.

Parsing. A rolling hash of 16 bytes runs over each text. The trigger of a start s is the smallest hash among the
256 positions from s on (leftmost of equals). It depends on the string alone, so equal strings have their
triggers at equal offsets, and the starts that share a trigger are one run. A run is an entry of the dictionary:
the bytes left of its trigger (a phrase whose suffixes begin its strings) and the bytes from the trigger on (what
the parse goes on with). All its strings have 145 bytes in common, its core.

Dictionary. Runs of equal bytes are one entry with a count. An entry that occurs again needs no order: each of its
strings is repeated. An entry whose core occurs in no other one has none that is. What is left are the entries at
the ends of matches.

Order. These entries are sorted twice within their core: by the bytes left of the trigger, read backwards (the
suffix array of the dictionary, each group of equal phrase suffixes being an interval), and by the bytes from the
trigger on (the suffix array of the parse). The common bytes with the neighbours in either order are the LCP
arrays. The string with l bytes left of the trigger is repeated if another entry shares l bytes there and 400 - l
on the right. No entry shares more than the nearest in an order, which bounds l from both sides; a neighbour that
shares enough on both sides settles all l between. Only what the two orders leave open is merged string by string
in corpus order, that is, grouped by core and string.

Both sorts are by range on keys that are all different, so a core that very many texts hold is spread over tasks;
the first and last entry of a range, whose neighbours are elsewhere, count as open. Counts are sums with map-side
combine. No group is ever collected. Keys of decisions have 128 bits: (core, entry) and (core, string).

Defined results: null text counts as empty; texts under 400 bytes lose nothing; equal texts of 400 bytes or more
lose everything; rows that repeat count as places of their own; an empty table gives no rows; other columns are
not read. The doc_id may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, only, release, slices, texts_of

LENGTH, GRAM, SPAN = 400, 16, 256
CORE = LENGTH - SPAN + 1

#: Keys that the driver samples a range to find the ranges of a sort; they hold up to half a kilobyte each.
SAMPLE = {"spark.sql.execution.rangeExchange.sampleSizePerPartition": "16"}

_hash = xxhash.xxh3_64_intdigest
_ROW = ["doc_id", "text_hash"]


def _signed(xs: list[int]) -> pa.Array:
    return pa.array(np.array(xs, np.uint64).view(np.int64))


def triggers(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigger, first start and last start of each run of starts, in order."""
    n = len(raw)
    if n < LENGTH:
        none = np.empty(0, np.int64)
        return none, none, none
    eight = np.ndarray((n - 7,), "<u8", raw, 0, (1,))
    x = eight[:-8] * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x += eight[8:]
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x &= np.uint64(0xFFFFFFFF00000000)
    x |= np.arange(len(x), dtype=np.uint64)
    width = 1
    while width < SPAN:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    at = (x[: n - LENGTH + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(at[1:] != at[:-1]) + 1
    low = np.concatenate(([0], new))
    return at[low], low, np.concatenate((new - 1, [n - LENGTH]))


def parse(raw: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """Trigger, first and last start, core key and entry key of each run."""
    for a, low, high in zip(*(x.tolist() for x in triggers(raw))):
        yield a, low, high, _hash(raw[a : a + CORE]), _hash(raw[low : high + LENGTH], (a - low) << 16 | (a - high))


def shared(x: bytes, y: bytes) -> int:
    """Bytes that x and y have in common at their beginning."""
    n = min(len(x), len(y))
    return n - ((int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])).bit_length() + 7) // 8


def _texts(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def _parsed(rows: DataFrame) -> DataFrame:
    """doc_id, text_hash, core, entry, places: the distinct runs of each row; and one with null keys a row, with size and sha."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in slices(batches, limit=4 << 20):
            out: tuple[list, ...] = ([], [], [], [], [])
            own: tuple[list, ...] = ([], [], [], [])
            for doc_id, h, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts_of(batch)):
                seen: dict[tuple[int, int], int] = {}
                for _, _, _, core, entry in parse(raw):
                    seen[core, entry] = seen.get((core, entry), 0) + 1
                for (core, entry), places in seen.items():
                    for column, value in zip(out, (doc_id, h, core, entry, places)):
                        column.append(value)
                for column, value in zip(own, (doc_id, h, len(raw), hashlib.sha256(raw).hexdigest())):
                    column.append(value)
            m, k = len(out[0]), len(own[0])
            none = lambda kind, n: pa.nulls(n, kind)
            names = ["doc_id", "text_hash", "core", "entry", "places", "n_bytes", "sha"]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), _signed(out[2]), _signed(out[3]), pa.array(out[4], pa.int32()), none(pa.int64(), m), none(pa.string(), m)], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(own[0], pa.int64()), pa.array(own[1], pa.int64()), none(pa.int64(), k), none(pa.int64(), k), none(pa.int32(), k), pa.array(own[2], pa.int64()), pa.array(own[3])], names=names)

    return rows.mapInArrow(run, "doc_id long, text_hash long, core long, entry long, places int, n_bytes long, sha string")


def _matched(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """rows (doc_id, text_hash, text) that have a list, with it."""
    return rows.alias("x").join(lists.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.text_hash") == F.col("y.text_hash"))).select("x.doc_id", "x.text_hash", "text", *[f"y.{c}" for c in lists.columns if c not in _ROW])


_ENTRY = "core long, doc_id long, text_hash long, at long, least int, most int, asks boolean, left binary, right binary"


def _entries(rows: DataFrame) -> DataFrame:
    """The dictionary's entries listed in `wanted`: their place, the least and most bytes of a string left of the
    trigger, whether they occur once, the bytes left of the trigger (backwards) and those from it on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            out: list[tuple] = []
            for doc_id, h, raw, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), texts_of(batch), batch.column("wanted").to_pylist()):
                once = {(w["core"] % (1 << 64), w["entry"] % (1 << 64)): w["n"] == 1 for w in wanted}
                for a, low, high, core, entry in parse(raw):
                    if (asks := once.pop((core, entry), None)) is not None:
                        out.append((core, doc_id, h, a, a - high, a - low, asks, raw[low:a][::-1], raw[a : high + LENGTH]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([_signed([x[0] for x in out]), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds, 1))], names=[x.split()[0] for x in _ENTRY.split(", ")])

    return rows.mapInArrow(run, _ENTRY)


_RANGES = "array<struct<lo:int,hi:int>>"


def _neighbours(entries: DataFrame, by: str) -> DataFrame:
    """entries with the most bytes that another one of the core shares on the side `by`, and the ranges of l that
    the neighbours in that order settle (after those that are settled already)."""
    other = "right" if by == "left" else "left"
    own = entries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict | None = None  # the row before, not given out yet; its neighbour before it is known
        for batch in slices(batches, "right", 4 << 20):
            done = []
            for row in batch.to_pylist():
                row["settled"] = list(row.get("settled") or ())
                row["far"] = LENGTH if last is None else -1  # beyond the range's first row anything may stand
                if last is not None:
                    if last["core"] == row["core"]:
                        one, two = shared(last[by], row[by]), shared(last[other], row[other])
                        left, right = (one, two) if by == "left" else (two, one)
                        for x in (last, row):
                            x["far"] = max(x["far"], one)
                            if LENGTH - right <= left and x["asks"]:
                                x["settled"].append({"lo": LENGTH - right, "hi": left})
                    done.append(last)
                last = row
            yield table(done)
        if last is not None:
            last["far"] = LENGTH
            yield table([last])

    def table(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{c: r[c] for c in own} | {"settled": r["settled"], f"{by}_shared": r["far"]} for r in rows], schema)

    kinds = {"core": pa.int64(), "doc_id": pa.int64(), "text_hash": pa.int64(), "at": pa.int64(), "asks": pa.bool_(), "left": pa.binary(), "right": pa.binary()}
    ranges = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    schema = pa.schema([*((c, kinds.get(c, pa.int32())) for c in own if c != "settled"), ("settled", ranges), (f"{by}_shared", pa.int32())])
    order = ["core", by, other]
    spec = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema if f.name != "settled"), f"settled {_RANGES}", f"{by}_shared int"])
    own = [c for c in own if c != "settled"]
    return entries.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, spec)


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entry that asks: the ranges of l that are repeated, and the first and last l that neither order decides."""
    for batch in batches:
        found, lo, hi = [], [], []
        for x in batch.select(["least", "most", "left_shared", "right_shared", "settled"]).to_pylist():
            first, last = max(x["least"], LENGTH - x["right_shared"]), min(x["most"], x["left_shared"])
            sure = [{"lo": a, "hi": b} for s in x["settled"] if (a := max(first, s["lo"])) <= (b := min(last, s["hi"]))]
            left = set(range(first, last + 1)).difference(*(range(s["lo"], s["hi"] + 1) for s in sure))
            found.append(sure)
            lo.append(min(left, default=None))
            hi.append(max(left, default=None))
        ranges = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("core", "doc_id", "text_hash", "at")] + [pa.array(found, ranges), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["core", "doc_id", "text_hash", "at", "sure", "lo", "hi"])


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per entry and l from lo to hi: the place of that string and its key."""
    for batch in slices(batches, "right", 1 << 20):
        out: list[tuple] = []
        for x in batch.to_pylist():
            raw = x["left"][::-1] + x["right"]
            m = len(x["left"])
            for n in range(max(x["lo"], x["least"]), min(x["hi"], x["most"]) + 1):
                out.append((x["core"], x["doc_id"], x["text_hash"], x["at"] - n, x["asks"], _hash(raw[m - n : m - n + LENGTH], n)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)), _signed([x[5] for x in out])], names=["core", "doc_id", "text_hash", "start", "asks", "string"])


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Sizes (doc_id, text_hash, n_bytes, sha: a row per document), whole runs (keys of entries per document), other
    repeated strings (spans of starts per document), and the tables that the last two read."""
    rows = _texts(docs)
    parsed = materialise(_parsed(rows), "parse")
    sizes = parsed.where("n_bytes is not null").select(*_ROW, "n_bytes", "sha")
    runs = parsed.where("core is not null").select(*_ROW, "core", "entry", "places")

    # tables of their own, so that the joins with them can split a core that very many texts hold
    often = materialise(runs.groupBy("core").agg(F.sum("places").alias("n")).where("n > 1").select("core"), "cores")
    found = materialise(runs.join(often, "core"), "repeated-cores")
    entries = found.groupBy("core", "entry").agg(F.sum("places").alias("n"), F.min(F.struct(*_ROW)).alias("place"))
    entries = materialise(entries.select("core", "entry", "n", "place.*"), "dictionary")
    whole = entries.where("n > 1").select("core", "entry")
    known = materialise(found.drop("places").join(whole, ["core", "entry"], "left_semi"), "whole-runs")
    release(often, found)
    wholes = known.groupBy(*_ROW).agg(F.collect_set(F.struct("core", "entry")).alias("wholes"))

    # one place stands for each entry of the cores where some entry occurs once
    unclear = materialise(entries.where("n = 1").select("core").distinct(), "unclear")
    wanted = entries.join(unclear, "core", "left_semi").groupBy(*_ROW).agg(F.collect_list(F.struct("core", "entry", "n")).alias("wanted"))
    edges = materialise(_entries(_matched(rows, wanted)), "entries")
    release(entries, unclear)
    left = materialise(_neighbours(edges, "left"), "dictionary-order", SAMPLE)
    both = materialise(_neighbours(left, "right").drop("left", "right").where("asks").mapInArrow(_open, f"core long, doc_id long, text_hash long, at long, sure {_RANGES}, lo int, hi int"), "parse-order", SAMPLE)
    release(left)

    limits = both.where("lo is not null").groupBy("core").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    limits = materialise(limits, "open")
    strings = materialise(edges.join(limits, "core").mapInArrow(_strings, "core long, doc_id long, text_hash long, start long, asks boolean, string long"), "strings")
    release(edges, limits)
    again = strings.groupBy("core", "string").agg(F.count("*").alias("n")).where("n > 1").select("core", "string")
    single = strings.where("asks").join(again, ["core", "string"], "left_semi")

    spans = both.select(*_ROW, "at", F.explode("sure").alias("s")).select(*_ROW, (F.col("at") - F.col("s.hi")).alias("first"), (F.col("at") - F.col("s.lo")).alias("final"))
    spans = spans.union(single.select(*_ROW, F.col("start").alias("first"), F.col("start").alias("final")))
    return sizes, wholes, spans.groupBy(*_ROW).agg(F.collect_set(F.struct("first", "final")).alias("spans")), [known, both, strings]


def _kept(raw: bytes, wholes: list[dict] | None, spans: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the removed runs of a text."""
    n = len(raw)
    edge = np.zeros(n + 1, np.int32)
    if wholes:
        keys = {(x["core"] % (1 << 64), x["entry"] % (1 << 64)) for x in wholes}
        for _, low, high, core, entry in parse(raw):
            if (core, entry) in keys:
                edge[low] += 1
                edge[high + LENGTH] -= 1
    for s in spans or ():
        edge[s["first"]] += 1
        edge[s["final"] + LENGTH] -= 1
    gone = np.cumsum(edge) > 0
    turn = np.flatnonzero(np.diff(np.concatenate(([False], gone))))
    return turn[::2], turn[1::2]


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed (spans of bytes), kept_text (binary: a cut may part a character), kept_sha256, for the
    documents that lose bytes; and the same with null removed and kept_text for all others."""
    sizes, wholes, spans, used = repeats(docs)
    same = F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.text_hash") == F.col("y.text_hash"))
    lists = wholes.alias("x").join(spans.alias("y"), same, "full").select(F.coalesce("x.doc_id", "y.doc_id").alias("doc_id"), F.coalesce("x.text_hash", "y.text_hash").alias("text_hash"), "wholes", "spans")
    lists = materialise(lists, "lists")
    release(*used)
    touched = _matched(_texts(docs), lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=4 << 20):
            cut, left = [], []
            for raw, whole, span in zip(texts_of(batch), batch.column("wholes").to_pylist(), batch.column("spans").to_pylist()):
                starts, ends = (x.tolist() for x in _kept(raw, whole, span))
                cut.append([{"start": s, "end": e} for s, e in zip(starts, ends)])
                left.append(b"".join(raw[e:s] for e, s in zip([0, *ends], [*starts, len(raw)])))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            n = _lengths(batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, pa.array(cut, kind), pa.array(left, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in left])], names=["doc_id", "n_bytes", "removed", "kept_text", "kept_sha256"])

    schema = "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept_text binary, kept_sha256 string"
    changed = touched.mapInArrow(run, schema)
    rest = sizes.alias("x").join(lists.select(*_ROW).alias("y"), same, "left_anti")
    rest = rest.select("doc_id", "n_bytes", F.lit(None).cast("array<struct<start:long,end:long>>").alias("removed"), F.lit(None).cast("binary").alias("kept_text"), F.col("sha").alias("kept_sha256"))
    return changed.unionByName(rest)


def _lengths(batch: pa.RecordBatch) -> pa.Array:
    """Bytes of each text of a batch."""
    return pa.array([len(x) for x in texts_of(batch)], pa.int64())


def digest(cut: DataFrame) -> DataFrame:
    """dedup()'s rows as doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    gone = F.aggregate(F.coalesce("removed", F.array().cast("array<struct<start:long,end:long>>")), F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])
    return cut.select("doc_id", "n_bytes", gone.alias("n_removed"), F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_spans"), "kept_sha256")
