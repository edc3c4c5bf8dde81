"""Removal of repeated word windows, found by recompression.

Every text is parsed in rounds. A round first names runs of equal symbols, then draws a bit for every
symbol name and names all pairs whose bits are 0 and 1. Names are fingerprints of what they stand for,
so they are the same in every text and task without any exchange. Whether a symbol arises depends on
a short stretch of words around it; where that stretch repeats, the symbol repeats. Every window of
words is given the best symbol whose stretch it covers, which is a function of the window alone:
equal windows meet under the same name. Neighbouring windows of one symbol travel as one row with
their fingerprints. Names that occur once need no more; equal rows settle all their windows at once;
only rows that share a name without being equal are compared window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from opslog.llm import arrays
from opslog.session import stage

WINDOW = 20
ROUNDS = 2
#: Words that the stretch of a symbol has at least on either side.
MARGIN = 3
#: Bytes of a window's fingerprint; its name has eight more.
MARK = 6
#: Rows that a task looks at together before they are shuffled, and different rows of a name among
#: them from which on it sends the windows of that name one by one.
BUFFER = 100_000
MANY = 8
FAR = np.int64(1 << 40)
SEGMENT, COVER, SINGLE, OPEN = 0, 1, 2, 3


def _beside(lo, hi, row):
    """The stretch of the symbols before and after; none beyond a text's ends."""
    before, after = np.full(len(lo), -FAR), np.full(len(lo), FAR)
    same = row[1:] == row[:-1]
    before[1:][same] = lo[:-1][same]
    after[:-1][same] = hi[1:][same]
    return before, after


def parse(words: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Symbols named in each round: name, first and last word of the stretch that fixes them.

    ``words`` are fingerprints of all words, ``row`` the text of each.
    """
    symbol, at = words, np.arange(len(words))
    lo, hi = at, at + 1
    for turn in range(ROUNDS):
        before, after = _beside(lo, hi, row)
        head = np.append(True, (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1]))
        heads = np.flatnonzero(head)
        size = np.diff(np.append(heads, len(symbol)))
        tails = heads + size - 1
        lo, hi = before[heads], after[tails]
        run = size > 1
        symbol, row = symbol[heads], row[heads]
        symbol = np.where(run, arrays.mix(symbol + size.astype(np.uint64) * np.uint64(2 * turn + 3)), symbol)
        bit = (arrays.mix(symbol ^ np.uint64(1000 + turn)) & np.uint64(1)).astype(bool)
        join = np.append(~bit[:-1] & bit[1:] & (row[1:] == row[:-1]), False)
        left = np.flatnonzero(join)
        made = arrays.mix(arrays.mix(symbol[left]) + symbol[left + 1])
        yield made, lo[left], hi[left + 1]
        # what did not join depends on the neighbours too
        before, after = _beside(lo, hi, row)
        lo, hi = before, after
        lo[left], hi[left] = before[left], after[left + 1]
        symbol = symbol.copy()
        symbol[left] = made
        keep = np.ones(len(symbol), bool)
        keep[left + 1] = False
        symbol, row, lo, hi = symbol[keep], row[keep], lo[keep], hi[keep]


def anchors(words: np.ndarray, first: np.ndarray, window: int, other: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For every window: its start, its name, its fingerprint, and which occurrence of a symbol names it.

    ``first`` bounds the texts; a window without a symbol has occurrence -1. Names go by ``words``, fingerprints by
    ``other``, unrelated hashes of the words, so two different words with one hash do not make windows equal.
    """
    count = np.diff(first)
    starts = arrays.ragged(first[:-1], np.maximum(count - window + 1, 0))
    spans = arrays.Spans(words)
    marks = (spans if other is None else arrays.Spans(other, 3)).of(starts, starts + window)
    row = np.repeat(np.arange(len(count)), count)
    best = np.full(len(words) + 1, -1)
    names = [np.empty(0, np.uint64)]
    total = 0
    margin = min(MARGIN, max((window - 2) // 2, 0))
    for level, (made, lo, hi) in enumerate(parse(words, row)):
        if level == 0:
            lo, hi = lo - margin + 1, hi + margin - 1
        text = row[np.clip(lo, 0, len(words) - 1)]
        inside = (lo >= first[text]) & (hi <= first[text + 1]) & (lo >= 0) & (hi - lo <= window)
        made, lo, hi = made[inside], lo[inside], hi[inside]
        name = arrays.mix(spans.of(lo, hi) + arrays.mix(made + np.uint64(level)))
        order = np.argsort(name, kind="stable")
        name, lo, hi = name[order], lo[order], hi[order]
        least = np.maximum(hi - window, first[text[inside][order]])
        each = np.maximum(lo - least + 1, 0)
        # later ones overwrite: higher rounds win, then greater names, then those further right
        best[arrays.ragged(least, each)] = np.repeat(np.arange(len(name)) + total, each)
        names.append(name)
        total += len(name)
    names = np.concatenate(names)
    chosen = best[starts]
    named = np.where(chosen >= 0, names[chosen] if total else 0, arrays.mix(marks + np.uint64(7)))
    return starts, named.astype(np.uint64), marks, chosen


def _mark_bytes(marks: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(marks.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :MARK])


def segments(data: np.ndarray, at: np.ndarray, window: int):
    """Rows for a piece of texts: text, first window, number of windows, name; and all fingerprints."""
    starts, ends, first = arrays.word_slices(data, at)
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, np.uint64), np.empty(0, np.uint64)
    words, other = (arrays.hashes(data, starts, ends, seed) for seed in (0, 1))
    begin, name, marks, symbol = anchors(words, first, window, other)
    text = np.searchsorted(first, begin, "right") - 1
    new = np.ones(len(begin), bool)
    # windows of one row never repeat each other: they see one occurrence at different places
    new[1:] = (symbol[1:] != symbol[:-1]) | (symbol[1:] < 0) | (begin[1:] != begin[:-1] + 1)
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(begin)))
    return text[heads], begin[heads] - first[text[heads]], size, name[heads], marks


ROW = "part long, kind int, name long, doc {k}, start int, marks binary"


def _rows(part, kind, name, doc, start, marks) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(part), pa.array(np.broadcast_to(np.int32(kind), len(part)).copy()), pa.array(name), doc,
         pa.array(start.astype(np.int32)), marks], names=["part", "kind", "name", "doc", "start", "marks"])


def _pack(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts * MARK)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(_mark_bytes(values))])


def _send(doc: pa.Array, start, size, name, marks, window: int):
    """What a buffer of rows sends on; rows stand in no order, ``marks`` has the windows of each in turn."""
    order_of = pc.rank(doc, tiebreaker="dense").to_numpy().astype(np.int64)
    where = np.cumsum(size) - size
    whole = arrays.Spans(marks).of(where, where + size)
    order = np.lexsort((start, order_of, whole, name))
    n, w, d, s = name[order], whole[order], order_of[order], start[order]
    head = np.append(True, (n[1:] != n[:-1]) | (w[1:] != w[:-1]))
    lead = np.maximum.accumulate(np.where(head, np.arange(len(n)), 0))
    again = (d != d[lead]) | (s != s[lead])
    rest, firsts = order[again], order[head]
    yield _covers(doc, start, size, rest, window)
    names, group = np.unique(name[firsts], return_inverse=True)
    busy = np.bincount(group)[group] > MANY
    calm, hot = firsts[~busy], firsts[busy]
    flat = marks[arrays.ragged(where[calm], size[calm])]
    yield _rows(arrays.signed(name[calm]), SEGMENT, arrays.signed(name[calm]), doc.take(pa.array(calm)), start[calm],
                _pack(flat, size[calm]))
    if len(hot):
        opened = names[np.bincount(group) > MANY]
        yield _rows(arrays.signed(opened), OPEN, arrays.signed(opened), pa.nulls(len(opened), doc.type),
                    np.zeros(len(opened), int), pa.nulls(len(opened), pa.binary()))
        owner = np.repeat(hot, size[hot])
        flat = marks[arrays.ragged(where[hot], size[hot])] & np.uint64((1 << 8 * MARK) - 1)
        spot = start[owner] + arrays.ragged(np.zeros(len(hot), int), size[hot])
        order = np.lexsort((spot, order_of[owner], flat, name[owner]))
        owner, flat, spot = owner[order], flat[order], spot[order]
        head = np.append(True, (name[owner][1:] != name[owner][:-1]) | (flat[1:] != flat[:-1]))
        one = np.ones(int(head.sum()), int)
        yield _rows(arrays.signed(arrays.mix(name[owner[head]] + flat[head])), SINGLE, arrays.signed(name[owner[head]]),
                    doc.take(pa.array(owner[head])), spot[head], _pack(flat[head], one))
        lead = np.maximum.accumulate(np.where(head, np.arange(len(owner)), 0))
        again = (order_of[owner] != order_of[owner[lead]]) | (spot != spot[lead])
        yield _covers(doc, spot, np.ones(len(spot), int), np.flatnonzero(again), window, owner)


def _covers(doc, start, size, rows, window, owner=None) -> pa.RecordBatch:
    """Words ``start`` to the length in ``name`` are to go."""
    length = size[rows] + window - 1
    who = doc.take(pa.array(rows if owner is None else owner[rows]))
    part = arrays.signed(arrays.mix(arrays.mix(start[rows].astype(np.uint64)) + np.arange(len(rows)).astype(np.uint64)))
    return _rows(part, COVER, length.astype(np.int64), who, start[rows], pa.nulls(len(rows), pa.binary()))


def _emit(docs: DataFrame, window: int, kind: str) -> DataFrame:
    """Parse texts and send their rows, a bounded buffer at a time."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrays.BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush():
            doc = pa.concat_arrays([x[0] for x in held])
            for batch in _send(doc, *(np.concatenate([x[i] for x in held]) for i in range(1, 5)), window):
                yield from arrays.slices(batch)

        for batch in batches:
            data, at = arrays.buffers(batch.column(1))
            for a, b in arrays.pieces(at):
                text, start, size, name, marks = segments(data[at[a]:at[b]], at[a:b + 1] - at[a], window)
                if len(text):
                    held.append((batch.column(0).take(pa.array(text + a)), start, size, name, marks))
                    rows += len(text)
                if rows >= BUFFER:
                    yield from flush()
                    held, rows = [], 0
        if rows:
            yield from flush()
        held.clear()
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, ROW.format(k=kind))


def _settle(rows: DataFrame, window: int, kind: str) -> DataFrame:
    """Within a name: equal rows settle at once; unequal ones send the windows of their first.

    The rows come sorted, an OPEN row before the others of its name, and are read as a stream. A name's first row waits until the name ends
    or shows another row.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = marks = doc = start = waits = None
        opened = False
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            through = np.flatnonzero((kinds == COVER) | (kinds == SINGLE))
            if len(through):
                yield batch.take(pa.array(through))
            mine = np.flatnonzero((kinds == SEGMENT) | (kinds == OPEN))
            own = batch.take(pa.array(mine))
            covers, singles = [], []
            for k, n, d, s, m in zip(*(own.column(i).to_pylist() for i in range(1, 6))):
                if n != name:
                    name, marks, waits, opened = n, None, None, False
                if k == OPEN:
                    opened = True
                    continue
                if m == marks:
                    if (d, s) != (doc, start):
                        covers.append((len(m) // MARK + window - 1, d, s))
                    continue
                if marks is not None:
                    opened = True
                    if waits:
                        singles.append(waits)
                        waits = None
                marks, doc, start = m, d, s
                if opened:
                    singles.append((n, d, s, m))
                else:
                    waits = (n, d, s, m)
            doc_type = own.schema.field("doc").type
            if covers:
                length, who, begin = zip(*covers)
                yield _rows(np.zeros(len(who), np.int64), COVER, np.array(length), pa.array(who, doc_type),
                            np.array(begin), pa.nulls(len(who), pa.binary()))
            for n, d, s, m in singles:
                parts = [m[i:i + MARK] for i in range(0, len(m), MARK)]
                yield _rows(np.zeros(len(parts), np.int64), SINGLE, np.full(len(parts), n, np.int64),
                            pa.array([d] * len(parts), doc_type), s + np.arange(len(parts)), pa.array(parts, pa.binary()))

    return rows.mapInArrow(run, ROW.format(k=kind))


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Word ranges covered by a window that also starts earlier: ``key``, ``start``, ``end`` (words).

    Earlier is a smaller key, or the same key and an earlier start. Ranges may overlap.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.where(F.col(key).isNotNull()).select(
        F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    rows = _emit(source, window, kind).repartition("part").sortWithinPartitions(
        "part", "name", F.desc("kind"), "marks", "doc", "start")
    settled = stage(_settle(rows, window, kind).drop("part"), "settled")
    single = settled.where(F.col("kind") == SINGLE).select("name", "marks", "doc", "start")
    first = single.groupBy("name", "marks").agg(
        F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = single.join(first.select("name", "marks", "first"), ["name", "marks"]).where(
        F.struct("doc", "start") != F.col("first"))
    return settled.where(F.col("kind") == COVER).select(
        F.col("doc").alias(key), "start", (F.col("start") + F.col("name")).cast("int").alias("end")
    ).union(later.select("doc", "start", (F.col("start") + window).cast("int")))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_removed`` and ``kept``, the words that stay, one space between.

    Words are what spaces and the controls 9 to 13 leave, unchanged. A word goes if a window of
    ``window`` words covers it that also starts earlier; windows are judged on the input. Columns named
    in ``carry`` are kept as the fields of a column ``row``, whatever their names.

    Edge cases: a null text, or one without words, has no words and an empty ``kept``; texts of fewer
    words than a window stay whole; rows that repeat a key are one document and get the same ranges;
    a row without a key stays whole and lends nothing; other columns are ignored; an empty table
    gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    ranges = repeated(docs, key, text, window).groupBy(F.col(key).alias("_doc")).agg(
        F.collect_list(F.struct("start", "end")).alias("_ranges"))
    extra = ["row"] if carry else []
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"),
                       *([F.struct(*carry).alias("row")] if carry else []))
    joined = rows.join(ranges, F.col("key") == F.col("_doc"), "left").select(
        "key", "text", F.col("_ranges.start").alias("a"), F.col("_ranges.end").alias("b"), *extra)

    def run(batch: pa.RecordBatch):
        data, at = arrays.buffers(batch.column(1))
        sides = [batch.column(2), batch.column(3)]
        for a, b in arrays.pieces(at):
            own = data[at[a]:at[b]]
            starts, ends, first = arrays.word_slices(own, at[a:b + 1] - at[a])
            edge = np.zeros(len(starts) + 1, np.int64)
            for side, sign in zip(sides, (1, -1)):
                cut = side.slice(a, b - a)
                spot = pc.list_flatten(cut).to_numpy(zero_copy_only=False).astype(np.int64)
                of = pc.list_parent_indices(cut).to_numpy(zero_copy_only=False)
                np.add.at(edge, np.minimum(first[of] + spot, first[of + 1]), sign)
            gone = np.cumsum(edge)[:-1] > 0
            removed = arrays.row_sums(gone, first)
            stay = np.flatnonzero(~gone)
            size = ends[stay] - starts[stay]
            # every kept word and one space after it, but for the last of a text
            pieces = np.append(own, np.uint8(32))
            index = arrays.ragged(starts[stay], size + 1)
            close = np.cumsum(size + 1) - 1
            index[close] = len(own)
            count = arrays.row_sums(size + 1, np.searchsorted(stay, first))
            out = pieces[index]
            full = count > 0
            keep = np.ones(len(out), bool)
            keep[(np.cumsum(count) - 1)[full]] = False
            out = out[keep]
            offsets = np.concatenate([[0], np.cumsum(count - full)]).astype(np.int32)
            kept = pa.Array.from_buffers(pa.string(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(np.diff(first)), pa.array(removed), kept,
                 *(c.slice(a, b - a) for c in batch.columns[4:])], names=["key", "n_words", "n_removed", "kept", *extra])

    schema = f"key {kind}, n_words long, n_removed long, kept string"
    if carry:
        schema += f", row {rows.schema['row'].dataType.simpleString()}"
    return arrays.map_batches(joined, run, schema).withColumnRenamed("key", key)
