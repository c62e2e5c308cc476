"""MinHash near-dedup by a signature-coordinate inverted join.

1. A text's shingles become 64 minima of hashes. Texts with equal shingle sets form a class; only classes go on.
2. The first 32 minima are index coordinates. If two sets are alike in SIMILARITY or more, at least MATCHES of
   these agree but for a chance under 3 in 100,000 at the threshold itself; so it is enough to post a class under
   the 32 - MATCHES + 1 coordinate-value pairs that are rarest (prefix), and to skip the long lists. How rare
   a pair is comes from a count-min table of fixed size; it decides cost, not results.
3. Within a list, collisions are counted on four bits of all 64 minima; pairs under LEAST_COLLISIONS are dropped.
   A list hands on a spanning forest of its collisions, mostly stars around small members: fewer pairs
   than members, however large the list. Lists of more than CHUNK postings, counted exactly, are split into chunks, and
   every two chunks of a list are compared.
4. The pairs are confirmed on full shingle sets and joined to components; unconfirmed, they tie classes to
   families. Any two classes that collided lie in one family. In a family of several components, the members outside its
   largest component are compared with all others on full sets, chunk by chunk, so no link is lost.

Null and empty texts have no shingles and no links. A null id counts as larger than all others. Rows that share an
id share its fate only if their texts do. Texts of any length are read whole. An empty table gives an empty result.
Only id and text are read, so extra columns do not matter; `drop_near_duplicates` keeps them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methmix.llm.common import free_name, stored, table
from methmix.llm.components import components
from methmix.llm.registry import query
from methmix.llm.words import mixed, slices, text_bytes, window_hashes, word_hashes
from methmix.session import broadcast_if_small, fits_broadcast

SIMILARITY = 80  # of 100
COORDINATES = 64
INDEXED = 32
MATCHES = 15
PREFIX = INDEXED - MATCHES + 1
LEAST_COLLISIONS = 38
COUNT_BITS = 18
COUNT_BLOCKS = 16
CHUNK = 4096
FAMILY_CHUNK = 1000
LAST_ID = np.iinfo(np.int64).max

_draw = np.random.default_rng(7)
_FACTORS = (_draw.integers(0, 2**31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_SHIFTS = _draw.integers(0, 2**32, COORDINATES, dtype=np.uint32)[:, None]


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the `width`-word shingles of a text, A-Z lowered; fewer words make one shingle."""
    words = word_hashes(data.lower())
    return np.unique(window_hashes(words, min(width, len(words)))) if len(words) else words


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima (uint32)."""
    low = np.full((COORDINATES, 1), 0xFFFFFFFF, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        hashed = x[None, at:at + 4096] * _FACTORS + _SHIFTS
        # A second step: minima of one multiplication alone would favour neighbouring values.
        hashed ^= hashed >> np.uint32(15)
        hashed *= np.uint32(0x2C1B3C6D)
        low = np.minimum(low, hashed.min(axis=1, keepdims=True))
    return low[:, 0]


def set_digests(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums that tell shingle sets apart."""
    one, two = mixed(shingles), mixed(shingles ^ np.uint64(0x5851F42D4C957F2D))
    return int(one.sum(dtype=np.uint64).view(np.int64)), int(two.sum(dtype=np.uint64).view(np.int64))


SIGNATURES = "id long, digest long, n_shingles long, cls long, check long, minima binary"
SIGNATURES_ARROW = pa.schema([("id", pa.int64()), ("digest", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("check", pa.int64()),
                              ("minima", pa.binary())])


def _ids(batch: pa.RecordBatch) -> list[int]:
    return [LAST_ID if v is None else v for v in batch.column(0).to_pylist()]


def _sign(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, batch_text):
            rows = []
            for id_, digest, data in zip(_ids(batch), batch.column("digest").to_pylist(), text_bytes(batch, batch_text)):
                shingles = shingle_set(data, width)
                if len(shingles):
                    rows.append((id_, digest, len(shingles), *set_digests(shingles), signature(shingles).tobytes()))
                else:
                    rows.append((id_, digest, 0, None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SIGNATURES_ARROW)],
                                             schema=SIGNATURES_ARROW)
    batch_text = "text"
    return task


def _keys(minima: np.ndarray) -> np.ndarray:
    """One 64-bit key for each index coordinate and its value; rows are classes."""
    return (np.arange(INDEXED, dtype=np.uint64) << np.uint64(32)) | minima[:, :INDEXED].astype(np.uint64)


def _minima(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys) >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def list_sizes(classes: DataFrame) -> np.ndarray:
    """Count-min table: 2^COUNT_BITS upper bounds of list lengths, whatever the size of the corpus."""
    width = (1 << COUNT_BITS) // COUNT_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            total += np.bincount(_buckets(_keys(_minima(batch))).ravel(), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(COUNT_BLOCKS), pa.int32()),
                                          "counts": [part.tobytes() for part in total.reshape(COUNT_BLOCKS, width)]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[block] = sums.get(block, 0) + np.frombuffer(counts, np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()),
                                              "counts": [v.tobytes() for v in sums.values()]})

    kind = "block int, counts binary"
    rows = (classes.select("minima").mapInArrow(count, kind).repartition(COUNT_BLOCKS, "block").mapInArrow(add, kind).collect())
    total = np.zeros((COUNT_BLOCKS, width), np.int64)
    for row in rows:
        total[row["block"]] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(total.ravel(), 2**31 - 1).astype(np.int32)


POSTINGS = "key long, chunk long, node long, n long, sketch binary"


def _post(sizes, limit: int):
    """Every class under its PREFIX rarest keys; chunk is 1 in lists that may be long, else 0."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = sizes.value
        for batch in batches:
            minima = _minima(batch)
            keys = _keys(minima)
            counts = lengths[_buckets(keys)]
            order = np.lexsort((keys, counts))[:, :PREFIX]
            keys, counts = np.take_along_axis(keys, order, 1), np.take_along_axis(counts, order, 1)
            node = batch.column("cls").to_numpy()
            low = (minima & np.uint32(15)).astype(np.uint8)
            sketch = (low[:, ::2] | (low[:, 1::2] << np.uint8(4))).tobytes()
            step = COORDINATES // 2
            sketches = pa.array([sketch[i * step:(i + 1) * step] for i in range(len(node))], pa.binary())
            rows = pa.array(np.repeat(np.arange(len(node)), PREFIX))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), pa.array((counts > limit).ravel().astype(np.int64)), pa.array(node).take(rows),
                 batch.column("n_shingles").take(rows), sketches.take(rows)],
                names=["key", "chunk", "node", "n", "sketch"])
    return task


def collisions(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many of the 64 four-bit minima agree, for all rows of `left` (a, 4) with all of `right` (b, 4): uint64."""
    differ = left[:, None, :] ^ right[None, :, :]
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    differ &= np.uint64(0x1111111111111111)
    return COORDINATES - np.bitwise_count(differ).sum(axis=2, dtype=np.int16)


def alike(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Collision counts of (sizes, sketches), 0 where sizes or collisions rule a pair out."""
    found = collisions(left[1], right[1])
    small, large = np.minimum(left[0][:, None], right[0]), np.maximum(left[0][:, None], right[0])
    found[(small * 100 < large * SIMILARITY) | (found < LEAST_COLLISIONS)] = 0
    return found


def _lists(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """The chunks of two or more members among the rows of a task."""
    held = list(batches)
    if not held:
        return
    held = pa.Table.from_batches(held)
    data = {c: held.column(c).to_numpy() for c in columns}
    data["sketch"] = np.frombuffer(b"".join(held.column("sketch").to_pylist()), np.uint64).reshape(-1, COORDINATES // 16)
    order = np.lexsort((data["node"], data["chunk"], data["key"]))
    key, chunk = data["key"][order], data["chunk"][order]
    starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])])
    stops = np.r_[starts[1:], len(order)]
    for start, stop in zip(starts[stops - starts > 1], stops[stops - starts > 1]):
        rows = order[start:stop]
        yield {name: values[rows] for name, values in data.items()}


PAIRS = "u long, v long"
PAIRS_ARROW = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def _pair_batch(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], schema=PAIRS_ARROW)


def forest(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger, smaller place) that connect what a symmetric boolean matrix connects, one for each place at most.

    From the smallest place not reached yet, each place is tied to the one it was first reached from.
    """
    todo = np.ones(len(found), bool)
    ends, starts = [], []
    for root in range(len(found)):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            at = queue.pop(0)
            new = np.flatnonzero(found[at] & todo)
            if len(new):
                todo[new] = False
                queue += new.tolist()
                ends.append(np.maximum(new, at))
                starts.append(np.minimum(new, at))
    none = [np.empty(0, np.int64)]
    return np.concatenate(ends or none), np.concatenate(starts or none)


def _first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the collisions in each list."""
    u, v, held = [], [], 0
    for data in _lists(batches, ["key", "chunk", "node", "n"]):
        node, own = data["node"], (data["n"], data["sketch"])
        found = np.concatenate([alike((own[0][at:at + 256], own[1][at:at + 256]), own) > 0 for at in range(0, len(node), 256)])
        larger, smaller = forest(found)
        u.append(node[larger])
        v.append(node[smaller])
        held += len(larger)
        if held > 50_000:
            yield _pair_batch(u, v)
            u, v, held = [], [], 0
    if u:
        yield _pair_batch(u, v)


def _family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For the guests of each chunk, a link to each foreign component that has a member alike."""
    held: dict[tuple[int, int], list[tuple]] = {}
    for batch in batches:
        for family, chunk, *row in zip(*(column.to_pylist() for column in batch.columns)):
            held.setdefault((family, chunk), []).append(tuple(row))
    for rows in held.values():
        homes = [r for r in rows if r[3]]
        if not homes:
            continue
        nodes = np.array([r[0] for r in homes])
        components_ = np.array([r[1] for r in homes])
        sets = [np.frombuffer(r[4], np.uint64) for r in homes]
        sizes = np.array([len(x) for x in sets])
        shingles, owners = np.concatenate(sets), np.repeat(np.arange(len(homes)), sizes)
        order = np.argsort(shingles, kind="stable")
        shingles, owners = shingles[order], owners[order]
        u, v = [], []
        for node, component, guest, _, data in rows:
            if not guest:
                continue
            own = np.frombuffer(data, np.uint64)
            low, high = np.searchsorted(shingles, own, "left"), np.searchsorted(shingles, own, "right")
            counts = high - low
            at = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            shared = np.bincount(owners[at], minlength=len(homes))
            linked = (100 * shared >= SIMILARITY * (len(own) + sizes - shared)) & (components_ != component)
            # One link for each foreign component joins it as well as all of them.
            _, first = np.unique(components_[linked], return_index=True)
            other = nodes[linked][first]
            u.append(np.maximum(other, node))
            v.append(np.minimum(other, node))
        if u:
            yield _pair_batch(u, v)


def _sets(width: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [shingle_set(data, width) for data in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_pydict({"node": pa.array([set_digests(s)[0] for s in sets], pa.int64()),
                                              "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})
    return task


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = np.zeros(batch.num_rows, bool)
        for row in range(batch.num_rows):
            # One pair at a time: a batch of pairs of long texts is large enough as it is.
            both = np.concatenate([np.frombuffer(batch.column(c)[row].as_buffer(), np.uint64) for c in ("a", "b")])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            good[row] = 100 * shared >= SIMILARITY * (len(both) - shared)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(good))


def class_sets(nodes: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the classes in `nodes` (cls), read again from the text of one document of each."""
    ids = stored(classes.join(nodes, "cls").select("id").distinct(), "ends")
    ids = F.broadcast(ids) if fits_broadcast(ids) else ids
    # A row that shares its id with a class's document but has another set is a class that no pair names.
    sets = docs.join(ids, "id", "left_semi").select("text").mapInArrow(_sets(width), "node long, shingles binary")
    return stored(sets.dropDuplicates(["node"]), "shingle-sets")


def confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are alike. `docs` has id and text."""
    ends = pairs.select(F.col("u").alias("cls")).unionByName(pairs.select(F.col("v").alias("cls"))).distinct()
    sets = class_sets(ends, docs, classes, width)
    return (pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
            .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
            .select("u", "v", "a", "b").mapInArrow(_confirm, PAIRS))


def chunked(postings: DataFrame) -> DataFrame:
    """`postings` with lists of more than CHUNK rows dealt to chunks, and a row for each pair of chunks that it meets in."""
    long = stored(postings.filter("chunk > 0").groupBy("key").agg(F.count(F.lit(1)).alias("members"))
                  .filter(F.col("members") > CHUNK)
                  .select("key", F.ceil(F.col("members") / CHUNK).cast("bigint").alias("chunks")), "long-lists")
    placed = postings.join(broadcast_if_small(long), "key", "left").withColumn(
        "own", F.pmod(F.xxhash64("node", "key"), F.coalesce("chunks", F.lit(1).cast("bigint"))))
    others = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), lambda other: other != F.col("own"))
    pairs = F.transform(others, lambda other: F.least("own", other) * F.col("chunks") + F.greatest("own", other))
    zero = F.array(F.lit(0).cast("bigint"))
    # Two chunks meet with all their members, so those of one chunk are compared there, too.
    return placed.withColumn("chunk", F.explode(F.when(F.col("chunks").isNull(), zero).otherwise(pairs))).select(
        "key", "chunk", "node", "n", "sketch")


def link_classes(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, component) of every class that is linked with another one; ids are class digests."""
    lengths = list_sizes(classes)
    sizes = classes.sparkSession.sparkContext.broadcast(lengths)
    postings = classes.select("cls", "n_shingles", "minima").mapInArrow(_post(sizes, CHUNK), POSTINGS)
    if lengths.max() > CHUNK:
        postings = chunked(postings)
    pairs = stored(postings.repartition("key", "chunk").mapInArrow(_first_pairs, PAIRS).distinct(), "pairs")
    links = stored(confirmed(pairs, docs, classes, width), "links")
    parts = stored(components(links), "parts")
    families = components(pairs)
    members = (families.select(F.col("id").alias("node"), F.col("component").alias("family"))
               .join(parts.withColumnRenamed("id", "node"), "node", "left")
               .withColumn("component", F.coalesce("component", "node")))
    members = stored(members, "members")
    open_ = stored(
        members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("family").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("all"))
        # The only pair of a family of two has been compared.
        .filter("all > top.c AND all > 2")
        .select("family", F.col("top.component").alias("top"), F.ceil(F.col("all") / FAMILY_CHUNK).cast("int").alias("chunks")),
        "open-families")
    guests = members.join(open_, "family")
    sets = class_sets(guests.select(F.col("node").alias("cls")).distinct(), docs, classes, width)
    placed = (
        guests.join(sets, "node").withColumn("guest", F.col("component") != F.col("top"))
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
        .withColumn("chunk", F.explode(F.when(F.col("guest"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("own"))))
        .select("family", "chunk", "node", "component", "guest", (F.col("chunk") == F.col("own")).alias("home"), "shingles"))
    more = placed.repartition("family", "chunk").mapInArrow(_family_links, PAIRS).distinct()
    return components(stored(links.unionByName(more), "links"))


def _grouped(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, digest (of the text), n_shingles and first, the smallest (id, digest) of its group, of every row of `docs`."""
    plain = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(LAST_ID))).alias("id"),
                        F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("digest"))
    signed = stored(plain.mapInArrow(_sign(width), SIGNATURES), "signatures")
    own = F.struct("id", "digest")
    classes = stored(signed.filter("n_shingles > 0").groupBy("cls", "check", "n_shingles")
                     .agg(F.min(own).alias("first"), F.first("minima").alias("minima")), "classes")
    linked = link_classes(classes.withColumn("id", F.col("first.id")), plain.drop("digest"), width)
    grouped = classes.join(linked.withColumnRenamed("id", "cls"), "cls", "left").withColumn(
        "component", F.coalesce("component", "cls"))
    smallest = grouped.groupBy("component").agg(F.min("first").alias("first"))
    by_class = stored(grouped.select("cls", "component").join(smallest, "component").select("cls", "first"), "class-components")
    return (signed.select("id", "digest", "n_shingles", "cls").join(by_class, "cls", "left")
            .select("id", "digest", "n_shingles", F.coalesce("first", own).alias("first")))


def near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id (the smallest id of its group), kept."""
    null_id = F.lit(int(LAST_ID))
    return _grouped(docs, width, id_col, text_col).select(
        F.nullif("id", null_id).alias("id"), "n_shingles", F.nullif("first.id", null_id).alias("component_id"),
        (F.col("id") == F.col("first.id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` of each group: that with the smallest id, of several with this id that with the smallest digest of its text.

    Rows equal in id and text are one; rows that only share the id are judged by their own texts.
    """
    found = stored(_grouped(docs, width, id_col, text_col).select("id", "digest", (F.struct("id", "digest") == F.col("first")).alias("kept")),
                   "judged")
    names = [free_name(docs, "_id"), free_name(docs, "_digest")]
    keyed = docs.withColumns({names[0]: F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(LAST_ID))), names[1]: F.xxhash64(F.col(text_col))})
    gone = stored(found.filter(~F.col("kept")).select(F.col("id").alias(names[0]), F.col("digest").alias(names[1])).distinct(), "gone")
    # Beyond the size that may be broadcast, texts are shuffled by id and digest.
    left = keyed.join(broadcast_if_small(gone), names, "left_anti")
    again = stored(found.filter("kept").groupBy(F.col("id").alias(names[0]), F.col("digest").alias(names[1]))
                   .agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "repeated")
    if not again.isEmpty():
        repeated = broadcast_if_small(again)
        left = left.join(repeated, names, "left_anti").unionByName(left.join(repeated, names, "left_semi").dropDuplicates(names))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op1_minhash_near_dedup", sql="""
    WITH RECURSIVE w AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws
            ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS shingle FROM w
    ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    ids AS (SELECT shingle, row_number() OVER () AS k FROM (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1)),
    shared AS (SELECT s.doc_id, k, n FROM s JOIN ids USING (shingle) JOIN n USING (doc_id)),
    links AS (
        SELECT a.doc_id AS u, b.doc_id AS v FROM shared a JOIN shared b ON a.k = b.k AND a.doc_id <> b.doc_id
            AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
    ), reach AS (
        SELECT doc_id, doc_id AS c FROM documents
        UNION SELECT l.u, r.c FROM reach r JOIN links l ON l.v = r.doc_id
    ), smallest AS (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d JOIN smallest USING (doc_id) LEFT JOIN n USING (doc_id)
""")
def op1_minhash_near_dedup(spark, sf_dir):
    """Shingles of two words, Jaccard similarity 0.8 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2).withColumnRenamed("id", "doc_id")
