"""Terms of texts in Arrow: tokens, bigrams and counts of a batch of documents at once, and their way through a shuffle.

A task cuts, counts and packs some millions of characters at a time.  What is shuffled are not single postings but packs:
all different terms of a bucket in one string of bytes, and arrays of numbers beside it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import constants as K

#: Characters of text that are cut, and rows that are packed, at a time.
CHARS, ROWS = 4_000_000, 1_000_000
#: Buckets for each task that reads packs, so that tasks are even.
BUCKETS = 4


def slices(batch: pa.RecordBatch, column: str, budget: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `budget` bytes in the strings of `column`, one row at least."""
    lists = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(lists.flatten()), 0))
    ends = np.cumsum(np.bincount(np.asarray(pc.list_parent_indices(lists)), weights=sizes, minlength=len(lists)))
    start = 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + budget, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of about `rows` rows."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield _whole(waiting)
            waiting, n = [], 0
    if n:
        yield _whole(waiting)


def _whole(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays([b.column(i) for b in batches]) for i in range(batches[0].num_columns)], schema=batches[0].schema)


def terms(texts: pa.ListArray, stops: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The terms of rows of lower-cased texts, each with its row: tokens without outer punctuation and stop-words, and
    pairs of neighbours among those of one text."""
    cut = pc.ascii_split_whitespace(texts.flatten())
    text = np.asarray(pc.list_parent_indices(cut))
    words = pc.ascii_trim(cut.flatten(), characters=K.PUNCTUATION)
    keep = np.asarray(pc.invert(pc.is_in(words, value_set=pa.array(["", *stops], pa.string()))))
    words, text = words.filter(pa.array(keep)), text[keep]
    row = np.asarray(pc.list_parent_indices(texts))[text]
    if len(words) < 2:
        return words, row
    near = text[1:] == text[:-1]
    pairs = pc.binary_join_element_wise(words[:-1].filter(pa.array(near)), words[1:].filter(pa.array(near)), " ")
    return pa.concat_arrays([words, pairs]), np.concatenate([row, row[1:][near]])


def counts(texts: pa.ListArray, stops: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(different terms; and of each different pair of row and term: row, place of the term among them, times)."""
    found, row = terms(texts, stops)
    coded = found.dictionary_encode()
    n = max(len(coded.dictionary), 1)
    pair, times = np.unique(row * n + np.asarray(coded.indices), return_counts=True)
    return coded.dictionary, pair // n, pair % n, times


def postings(columns: list[str], stops: list[str]) -> Callable:
    """(term, columns, tf) of rows (texts, columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "texts"):
                names, row, term, times = counts(part.column("texts"), stops)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(term)), *[part.column(c).take(take) for c in columns], pa.array(times)], ["term", *columns, "tf"])

    return run


def _bytes(names: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, sizes) of strings, from the first string on."""
    offsets = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
    data = np.frombuffer(names.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0], np.diff(offsets)


def _eight(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The eight bytes of each string from `starts` on as a number, zeros behind `sizes` of them."""
    padded = np.r_[data, np.zeros(8, np.uint8)]
    out = np.zeros(len(starts), np.uint64)
    for i in range(8):
        out = out << np.uint64(8) | np.where(sizes > i, padded[starts + i], 0).astype(np.uint64)
    return out


def _buckets(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, first: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each string, by its size, first and last bytes: few share these, and those are only kept together."""
    last = _eight(data, starts + np.maximum(sizes - 8, 0), np.minimum(sizes, 8))
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) ^ last) * np.uint64(0xD6E8FEB86659FD93) + sizes.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _packs(names: pa.Array, term: np.ndarray, columns: dict[str, pa.Array], buckets: int) -> pa.RecordBatch:
    """(bucket, terms, sizes, k, columns): for each bucket its different terms, one behind the other, with their sizes and
    the numbers k of their rows, and the rows' columns in that order.  Like terms stand together, as they compress."""
    raw = _bytes(names)
    first = _eight(*raw)
    bucket = _buckets(*raw, first, buckets)
    order = np.lexsort((first, bucket))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    k = np.bincount(place[term], minlength=len(order)).astype(np.int32)
    take = pa.array(np.argsort(place[term], kind="stable"))
    names, bucket = names.take(pa.array(order)), bucket[order]
    data, starts, sizes = _bytes(names)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
    ends = lambda n: pa.array(np.r_[0, np.cumsum(n)][np.r_[first, len(bucket)]].astype(np.int32))
    of_terms, of_rows = ends(np.ones(len(bucket), np.int64)), ends(k)
    told = {"bucket": pa.array(bucket[first]), "terms": pa.Array.from_buffers(pa.binary(), len(first), [None, ends(sizes).buffers()[1], pa.py_buffer(np.ascontiguousarray(data))])}
    lists = {"sizes": pa.ListArray.from_arrays(of_terms, pa.array(sizes.astype(np.int32))), "k": pa.ListArray.from_arrays(of_terms, pa.array(k))}
    return pa.RecordBatch.from_pydict(told | lists | {c: pa.ListArray.from_arrays(of_rows, v.take(take)) for c, v in columns.items()})


def _named(names: pa.Array, term: np.ndarray, columns: dict[str, pa.Array], label: str, buckets: int) -> pa.RecordBatch:
    """Packs in which the few values of the column `label` are listed in `names`, and rows have their places there."""
    coded = columns[label]
    coded = coded if pa.types.is_dictionary(coded.type) else coded.dictionary_encode(null_encoding="encode")
    packs = _packs(names, term, columns | {label: pa.array(np.asarray(coded.indices).astype(np.int32))}, buckets)
    return packs.append_column("names", pa.array([coded.dictionary.to_pylist()] * packs.num_rows, pa.list_(pa.string())))


def _unpacked(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], label: str) -> tuple | None:
    """All rows of a task's packs: its different terms; the place of each row's term among them; the rows' columns; the
    values of `label`; and the place of each row's among them."""
    packs = [b for b in batches if b.num_rows]
    if not packs:
        return None
    flat = lambda c: pa.concat_arrays([b.column(c).flatten() for b in packs])
    data = b"".join(x for b in packs for x in b.column("terms").to_pylist())
    offsets = np.r_[0, np.cumsum(np.asarray(flat("sizes")), dtype=np.int64)]
    strings = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    coded = strings.dictionary_encode()
    term = np.repeat(np.asarray(coded.indices).astype(np.int64), np.asarray(flat("k")))
    sizes = lambda c: np.concatenate([np.asarray(pc.list_value_length(b.column(c))) for b in packs])
    values, listed = flat("names").dictionary_encode(null_encoding="encode"), sizes("names")
    first = np.repeat(np.cumsum(listed) - listed, sizes(label))
    place = np.asarray(values.indices)[first + np.asarray(flat(label))]
    return coded.dictionary, term, {c: flat(c) for c in columns if c != label}, values.dictionary, place


def _parts(n: int, most: int = 100_000) -> Iterator[slice]:
    for at in range(0, n, most):
        yield slice(at, at + most)


def packed_classes(stops: list[str], buckets: int) -> Callable:
    """Packs of (class, n): documents of each class with a term, of rows (texts, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "texts"):
                names, row, term, _ = counts(part.column("texts"), stops)
                if not len(names):
                    continue
                classes = part.column("class").dictionary_encode(null_encoding="encode")
                c = len(classes.dictionary)
                pair, n = np.unique(term * c + np.asarray(classes.indices)[row], return_counts=True)
                yield _named(names, pair // c, {"class": pa.DictionaryArray.from_arrays(pa.array(pair % c), classes.dictionary), "n": pa.array(n.astype(np.int32))}, "class", buckets)

    return run


def summed_classes(more_than: int) -> Callable:
    """(term, class, a) of such packs: documents of each class with a term, of terms in more than `more_than` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _unpacked(batches, ("n",), "class")) is None:
            return
        names, term, rows, classes, place = found
        c = len(classes)
        pair, at = np.unique(term * c + place, return_inverse=True)
        a = np.bincount(at, weights=np.asarray(rows["n"])).astype(np.int64)
        df = np.bincount(pair // c, weights=a, minlength=len(names))
        keep = df[pair // c] > more_than
        pair, a = pair[keep], a[keep]
        for some in _parts(len(pair)):
            yield pa.RecordBatch.from_arrays([names.take(pa.array(pair[some] // c)).cast(pa.string()), classes.take(pa.array(pair[some] % c)), pa.array(a[some])], ["term", "class", "a"])

    return run


def _pressed(packs: pa.RecordBatch, fixed: dict[str, str]) -> pa.RecordBatch:
    """Such packs with terms, sizes, k and the columns `fixed` (with numpy's types) of each in one compressed string of
    bytes, numbers byte by byte: first bytes of all, then second ones.  Columns of other types stay beside it."""
    codec, columns = pa.Codec("zstd", compression_level=1), {"sizes": "i4", "k": "i4"} | fixed
    flat = {c: packs.column(c).flatten() for c in columns}
    known = {c: np.asarray(v.is_valid()) if v.null_count else None for c, v in flat.items()}
    told = {c: np.ascontiguousarray(np.asarray(v.fill_null(0) if v.null_count else v), t) for (c, v), t in zip(flat.items(), columns.values(), strict=True)}
    ends = {c: np.r_[0, np.cumsum(np.asarray(pc.list_value_length(packs.column(c))))] for c in columns}
    out = []
    for r, words in enumerate(packs.column("terms").to_pylist()):
        parts, head = [], [len(words)]
        for c, v in told.items():
            a, b = ends[c][r], ends[c][r + 1]
            parts.append(v[a:b].view(np.uint8).reshape(b - a, -1).T.tobytes())
            if known[c] is not None:
                parts.append(known[c][a:b].tobytes())
            head += [b - a, known[c] is not None]
        raw = b"".join([words, *parts])
        out.append(np.array([len(raw), *head], np.int32).tobytes() + codec.compress(raw, asbytes=True))
    rest = [c for c in packs.schema.names if c not in columns and c not in ("bucket", "terms")]
    return pa.RecordBatch.from_arrays([packs.column("bucket"), pa.array(out, pa.binary()), *[packs.column(c) for c in rest]], ["bucket", "pack", *rest])


def _loosened(batches: Iterator[pa.RecordBatch], fixed: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The packs that were pressed."""
    codec, columns = pa.Codec("zstd"), {"sizes": "i4", "k": "i4"} | fixed
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, found = [], {c: [] for c in columns}
        for pressed in batch.column("pack"):
            data, at = pressed.as_buffer(), 4 * (2 + 2 * len(columns))
            size, n, *head = np.frombuffer(data.slice(0, at), np.int32).tolist()
            raw = codec.decompress(data.slice(at), size, asbytes=True)
            terms.append(raw[:n])
            for (c, t), many, nulls in zip(columns.items(), head[::2], head[1::2], strict=True):
                width = np.dtype(t).itemsize
                v = np.ascontiguousarray(np.frombuffer(raw, np.uint8, many * width, n).reshape(width, many).T).reshape(-1).view(t)
                n += many * width
                mask = ~np.frombuffer(raw, bool, many, n) if nulls else None
                n += many if nulls else 0
                found[c].append(pa.array(v, mask=mask))
        lists = {c: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in v])].astype(np.int32)), pa.concat_arrays(v)) for c, v in found.items()}
        rest = {c: batch.column(c) for c in batch.schema.names if c not in ("bucket", "pack")}
        yield pa.RecordBatch.from_pydict({"terms": pa.array(terms, pa.binary())} | lists | rest)


def packed_postings(columns: list[str], stops: list[str], buckets: int, fixed: dict[str, str]) -> Callable:
    """Pressed packs of (columns, tf): postings of rows (texts, columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "texts"):
                names, row, term, times = counts(part.column("texts"), stops)
                if len(names):
                    take = pa.array(row)
                    yield _pressed(_named(names, term, {c: part.column(c).take(take) for c in columns} | {"tf": pa.array(times)}, "split", buckets), fixed)

    return run


def packed_rows(columns: list[str], buckets: int, fixed: dict[str, str]) -> Callable:
    """Pressed packs of rows (term, columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches):
            coded = batch.column("term").dictionary_encode()
            yield _pressed(_named(coded.dictionary, np.asarray(coded.indices), {c: batch.column(c) for c in columns}, "split", buckets), fixed)

    return run


def frequencies(columns: list[str], fixed: dict[str, str]) -> Callable:
    """The rows (term, columns) of such packs, with df: documents of the same split that have the term (tf above 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (found := _unpacked(_loosened(batches, fixed), tuple(columns), "split")) is None:
            return
        names, term, rows, splits, place = found
        group = term * len(splits) + place
        times = np.bincount(group, weights=np.asarray(rows["tf"]) > 0).astype(np.int64)
        for some in _parts(len(term)):
            own = [splits.take(pa.array(place[some])) if c == "split" else rows[c].slice(some.start, some.stop - some.start) for c in columns]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(term[some])).cast(pa.string()), *own, pa.array(times[group[some]])], ["term", *columns, "df"])

    return run
