"""Substring dedup by Rabin-Karp hashes of every window of words, counted in Spark.

1. Each task hashes every window of its texts. Of a window that several documents of one slice hold, only
   the smallest document is sent on; the others are known to repeat a smaller one.
2. Hashes are dealt by value to parts. A part finds the smallest document of each hash and answers only to
   documents whose window starts in a smaller one.
3. Answers are gathered by document and meet the texts by id. Repeated windows are merged into maximal intervals of words.

Hashes travel as packed arrays, one row for each slice and part, 7 bytes a window. A passage that a third of all
documents hold costs one entry for each slice. Windows are told apart by 59-bit hashes.

A null text has no words. A null id counts as larger than all others. Rows that share an id don't repeat each other.
Texts of any length are read whole. An empty table gives an empty result. Input columns are kept, but for
one named like a column made here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from methmix.llm.common import stored, table, without
from methmix.llm.registry import query
from methmix.llm.words import slices, split_words, text_bytes, window_hashes, word_hashes
from methmix.session import fits_broadcast

WINDOW = 13
# Text bytes that one part's hashes come from, about 6 bytes of text for one hash.
BYTES_PER_PART = 8_000_000
# Windows are told apart by 59 bits: a hash divided by the number of parts, 8 at least, then takes 7 bytes.
DROPPED_BITS = 5
KEPT_BYTES = 7
LEAST_PARTS = 8
PIECES = 8
LAST_ID = np.iinfo(np.int64).max


def _windows(words: np.ndarray, window: int) -> np.ndarray:
    return window_hashes(words, window) >> np.uint64(DROPPED_BITS)


def _ids(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return np.array([LAST_ID if v is None else v for v in batch.column(column).to_pylist()], np.int64)


def _first_windows(batch: pa.RecordBatch, id_col: str, text_col: str, window: int):
    """Ids, and the smallest document of each window in it, as (hash, place); the others as (hash, place)."""
    ids = _ids(batch, id_col)
    hashes, places = [], []
    for place, data in enumerate(text_bytes(batch, text_col)):
        found = np.unique(_windows(word_hashes(data), window))
        hashes.append(found)
        places.append(np.full(len(found), place, np.int32))
    hashes, places = np.concatenate(hashes), np.concatenate(places)
    order = np.lexsort((ids[places], hashes))
    hashes, places = hashes[order], places[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    # Rows with the smallest id of the hash are all first; the rest repeats a smaller document.
    smallest = ids[places[np.flatnonzero(new)]][np.cumsum(new) - 1] if len(hashes) else ids[:0]
    first = ids[places] == smallest
    return ids, (hashes[first], places[first]), (hashes[~first], places[~first])


def _packed(keys: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(key, bytes of its hashes) for each distinct key."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys, hashes = keys[order], hashes[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    for start, stop in zip(starts, np.r_[starts[1:], len(keys)]):
        yield keys[start], hashes[start:stop].tobytes()


# One row for each slice and part: hashes by document, `counts` of them for each of `ids`. Answers have whole hashes.
SENT = "part int, answer boolean, ids binary, counts binary, hashes binary"
SENT_ARROW = pa.schema([("part", pa.int32()), ("answer", pa.bool_()), ("ids", pa.binary()), ("counts", pa.binary()),
                        ("hashes", pa.binary())])
REPEATS_ARROW = pa.schema([("doc", pa.int64()), ("repeats", pa.binary())])
REPEATS_ROWS = 2_000


def _to_arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _answers(docs: np.ndarray, hashes: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows, dealt by document."""
    part = docs % parts
    order = np.lexsort((docs, part))
    docs, hashes, part = docs[order], hashes[order], part[order]
    bounds = np.searchsorted(part, np.arange(parts + 1))
    for at in np.flatnonzero(np.diff(bounds)):
        some = slice(bounds[at], bounds[at + 1])
        ids, counts = np.unique(docs[some], return_counts=True)
        yield _to_arrow([(int(at), True, ids.tobytes(), counts.astype(np.int32).tobytes(), hashes[some].tobytes())], SENT_ARROW)


def _unpacked(held: list[tuple[bytes, bytes, bytes]], unpack) -> tuple[np.ndarray, np.ndarray]:
    """Documents and hashes of the rows of a part."""
    docs = np.concatenate([np.repeat(np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)) for i, c, _ in held])
    return docs, np.concatenate([unpack(h) for _, _, h in held])


def narrow(hashes: np.ndarray) -> bytes:
    """The low seven bytes of each value; the eighth is 0."""
    return hashes.view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()


def wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEPT_BYTES, 8), np.uint8)
    out[:, :KEPT_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEPT_BYTES)
    return out.view(np.uint64).ravel()


def _send(id_col: str, text_col: str, window: int, parts: int):
    """Windows for the parts, and answers for those known to be repeats."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            ids, (hashes, places), (more, more_places) = _first_windows(batch, id_col, text_col, window)
            part = (hashes % np.uint64(parts)).astype(np.int32)
            order = np.lexsort((places, part))
            hashes, places, part = hashes[order], places[order], part[order]
            bounds = np.searchsorted(part, np.arange(parts + 1))
            for at in np.flatnonzero(np.diff(bounds)):
                some = slice(bounds[at], bounds[at + 1])
                docs, counts = np.unique(places[some], return_counts=True)
                yield _to_arrow([(int(at), False, ids[docs].tobytes(), counts.astype(np.int32).tobytes(),
                                  narrow(hashes[some] // np.uint64(parts)))], SENT_ARROW)
            yield from _answers(ids[more_places], more, parts)
    return task


def _answer(parts: int):
    """For each part of a task: the windows of documents that start in a smaller one."""
    def finish(part: int, held: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        all_docs, all_hashes = _unpacked(held, wide)
        held.clear()
        # Sorting needs several times the memory of what is sorted, so a part is done in pieces.
        piece = (all_hashes & np.uint64(PIECES - 1)).astype(np.uint8)
        for at in range(PIECES):
            docs, hashes = all_docs[piece == at], all_hashes[piece == at]
            if not len(hashes):
                continue
            order = np.argsort(hashes, kind="stable")
            hashes, docs = hashes[order], docs[order]
            starts = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
            smallest = np.repeat(np.minimum.reduceat(docs, starts), np.diff(np.r_[starts, len(hashes)]))
            later = docs > smallest
            found.append((docs[later], hashes[later] * np.uint64(parts) + np.uint64(part)))
        yield from _answers(np.concatenate([d for d, _ in found]), np.concatenate([h for _, h in found]), parts)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            answers = batch.column("answer")
            yield batch.filter(answers)
            for part, answer, *row in zip(*(column.to_pylist() for column in batch.columns)):
                if not answer:
                    held.setdefault(part, []).append(tuple(row))
        while held:
            yield from finish(*held.popitem())
    return task


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repeated windows of each document in one row."""
    held: dict[int, list] = {}
    for batch in batches:
        for part, _, *row in zip(*(column.to_pylist() for column in batch.columns)):
            held.setdefault(part, []).append(tuple(row))
    while held:
        docs, hashes = _unpacked(held.popitem()[1], lambda data: np.frombuffer(data, np.uint64))
        rows = [(int(doc), data) for doc, data in _packed(docs, hashes)]
        for at in range(0, len(rows), REPEATS_ROWS):
            yield _to_arrow(rows[at:at + REPEATS_ROWS], REPEATS_ARROW)


def repeated_windows(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """_doc, _repeats (packed hashes): windows that also start in a document with a smaller id."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = size // BYTES_PER_PART + LEAST_PARTS
    sent = docs.select(id_col, text_col).mapInArrow(_send(id_col, text_col, window, parts), SENT)
    answers = sent.repartition(parts, "part").mapInArrow(_answer(parts), SENT)
    found = answers.repartition(parts, "part").mapInArrow(_gather, "doc long, repeats binary")
    return stored(found.select(F.col("doc").alias("__llm_doc"), F.col("repeats").alias("__llm_repeats")), "repeats")


def merged(flags: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal [start, end) intervals of the words that flagged windows cover."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > window)
    return list(zip(at[np.r_[0, gap + 1]].tolist(), (at[np.r_[gap, len(at) - 1]] + window).tolist()))


def _intervals(words: np.ndarray, repeats: bytes, window: int) -> list[tuple[int, int]]:
    return merged(np.isin(_windows(words, window), np.frombuffer(repeats, np.uint64)), window)


def with_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with _repeats, the packed hashes of its repeated windows (null if none)."""
    repeats = repeated_windows(docs, window, id_col, text_col)
    keyed = docs.withColumn("__llm_doc", F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(LAST_ID))))
    touched = repeats.select("__llm_doc")
    if not fits_broadcast(touched):
        return keyed.join(repeats, "__llm_doc", "left").drop("__llm_doc")
    # Texts without repeats, most of the corpus, stay where they are.
    touched = F.broadcast(touched)
    some = keyed.join(touched, "__llm_doc", "left_semi").join(repeats, "__llm_doc")
    none = keyed.join(touched, "__llm_doc", "left_anti").withColumn("__llm_repeats", F.lit(None).cast("binary"))
    return some.unionByName(none).drop("__llm_doc")


def _mapped(docs: DataFrame, text_col: str, window: int, make, added: str, dropped: list[str]) -> DataFrame:
    """`docs` with columns made from (text bytes, intervals) in place of `dropped` and _repeats."""
    keep = [f for f in docs.schema.fields if f.name not in [*dropped, "__llm_repeats"]]
    names = [c.strip().split()[0] for c in added.split(",")] if "<" not in added else ["intervals"]
    kinds = T.StructType.fromDDL(added)
    schema = T.StructType(keep + kinds.fields)
    arrow = to_arrow_schema(kinds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            rows = [make(data, _intervals(word_hashes(data), r, window) if r else [])
                    for data, r in zip(text_bytes(batch, text_col), batch.column("__llm_repeats").to_pylist())]
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + made,
                                             names=[f.name for f in keep] + names)
    return docs.mapInArrow(task, schema)


def removal_intervals(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with intervals array<struct<start, end>>: the words to remove, end excluded."""
    docs = without(docs, ("intervals",))
    return _mapped(with_repeats(docs, window, id_col, text_col), text_col, window, lambda data, found: (
        [{"start": a, "end": b} for a, b in found],), "intervals array<struct<start:bigint,end:bigint>>", [])


def cut_words(data: bytes, found: list[tuple[int, int]]) -> bytes:
    """The text without the words of the intervals and the white space behind each of them."""
    if not found:
        return data
    starts, ends, place = [a for a, _ in found], [b for _, b in found], 0
    bounds = {}
    wanted = set(starts) | set(ends)
    for place, match in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", data)):
        if place in wanted:
            bounds[place] = match.start()
    out, at = [], 0
    for start, end in found:
        out.append(data[at:bounds[start]])
        at = bounds.get(end, len(data))
    return b"".join([*out, data[at:]])


def cut_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated words cut from `text_col`; a null text stays null."""
    columns = docs.columns
    source = docs.withColumn("__llm_null", F.col(text_col).isNull())
    cut = _mapped(with_repeats(source, window, id_col, text_col), text_col, window,
                  lambda data, found: (cut_words(data, found).decode(),), "__llm_cut string", [])
    return cut.withColumn(text_col, F.when(~F.col("__llm_null"), F.col("__llm_cut"))).select(*columns)


def _digest(data: bytes, found: list[tuple[int, int]]) -> tuple[int, int, str]:
    words = [w for part in split_words(data) for w in part]
    kept, at = [], 0
    for start, end in found:
        kept += words[at:start]
        at = end
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


@query("op4_substring_dedup", sql="""
    WITH w AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
    ), windows AS (
        SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
    ), first AS (SELECT k, min(doc_id) AS m FROM windows GROUP BY k),
    gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (k) WHERE doc_id > m
    ), words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
    kept AS (
        SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n
        FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
    )
    SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
        sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)
""")
def op4_substring_dedup(spark, sf_dir):
    """Windows of 13 words over whole texts; digests of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _mapped(with_repeats(docs, WINDOW), "text", WINDOW, _digest,
                   "n_words bigint, n_removed bigint, kept_sha256 string", ["text"])
