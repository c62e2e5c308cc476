"""Resampling of documents towards a target distribution, by hashed features and a distributed quickselect.

1. Features, runs of words, fall into hash buckets. One pass over each side counts its buckets; an array holds the gain
   of every bucket, the logarithm of how much more frequent it is in the target.
2. A second pass over the documents looks the gains up. A document's weight is their floored mean; noise made from a
   digest of its id turns the largest scores into a random draw by weight, the same in every run.
3. The draw is bounded by its k-th key (score from the largest on, id, features, row). Quickselect finds it: random rows
   of what is left give pivots, one aggregation counts the keys before and at each of them, and the interval that holds the
   k-th is left. No more than the pivots reach the driver. Only winners are sorted, by ranges, and ranked.

A null or empty text has no features and weight 0. Texts of any length are read whole. Equal scores go by the smaller id, a null
id last and drawn like an empty one; repeated rows each take part. An empty table gives an empty result, and an empty
target gives gains towards no text. Only id and text are read; extra columns don't matter and are not returned.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methmix.llm.common import stored, table
from methmix.llm.registry import query
from methmix.llm.words import slices, split_words, text_bytes

BUCKETS = 10_000
LONGEST = 1          # words of the longest feature
LEAST_WORDS = 20     # documents with fewer are not drawn
PERCENT = 10
SALT = "2024:"
PIVOTS = 15
# What is left is written again once it is so many times smaller than what was written last.
SHRINK = 4
PARTITION_BITS = 33  # of the numbers that Spark gives to rows, those within a partition

# Letters and digits below 0x80 are kept, A-Z lowered; bytes from 0x80 on belong to letters, too.
NORMAL = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def feature_hashes(data: bytes, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words and crc32 of all runs of 1 to `longest` words, piece by piece of a text."""
    before: list[bytes] = []
    for words in split_words(data.translate(NORMAL)):
        yield len(words), np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        if longest > 1:
            joined = before + words
            for n in range(2, longest + 1):
                # Runs that end in this piece.
                runs = [b" ".join(joined[at:at + n]) for at in range(max(0, len(before) - n + 1), len(joined) - n + 1)]
                yield 0, np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs))
            before = joined[1 - longest:]


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How often a feature of `texts` (text) falls into each bucket; `buckets` sums reach the driver."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            found = [hashes % buckets for data in text_bytes(batch, "text") for _, hashes in feature_hashes(data, longest)]
            if found:
                total += np.bincount(np.concatenate(found), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    sums = texts.select("text").mapInArrow(task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for bucket, n in sums.collect():
        counts[bucket] = n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier a bucket is in the target, one count added to each."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
                     for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """`docs` (id, text) as id, n_words, n_features, weight."""
    buckets = len(gain)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = np.zeros((3, batch.num_rows), np.int64)
            for place, data in enumerate(text_bytes(batch, "text")):
                for words, hashes in feature_hashes(data, longest):
                    made[:, place] += words, len(hashes), gain[hashes % buckets].sum()
            made[2] //= np.maximum(made[1], 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(row, pa.int64()) for row in made)],
                                             names=["id", "n_words", "n_features", "weight"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(task, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_: Column, salt: str) -> Column:
    """Thousandths of standard Gumbel noise from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


KEY = ("back", "none", "id", "n_features", "row")


def before(row, kind: str) -> str:
    """SQL for whether a key comes before that of `row`, whose id is of type `kind`."""
    text = str(row["id"]).replace("\\", "\\\\").replace("'", "\\'")
    last = f"(n_features < {row['n_features']} OR (n_features = {row['n_features']} AND row < {row['row']}))"
    value = f"CAST('{text}' AS {kind})"
    ids = f"none AND {last}" if row["none"] else f"NOT none AND (id < {value} OR (id = {value} AND {last}))"
    return f"(back < {row['back']} OR (back = {row['back']} AND ({'NOT none OR ' if row['none'] else ''}{ids})))"


def same_key(row) -> str:
    return f"row = {row['row']}"


def kth_key(rows: DataFrame, k: int):
    """The k-th smallest key (k from 1) of `rows`, a stored table with the columns KEY, no two of them with the same `row`."""
    kind = rows.schema["id"].dataType.simpleString()
    active, written, turn = rows, None, 0
    while True:
        turn += 1
        pivots = sorted(active.select(*KEY).orderBy(F.rand(turn)).limit(PIVOTS).collect(),
                        key=lambda r: (r["back"], r["none"], () if r["none"] else (r["id"],), r["n_features"], r["row"]))
        # Keys fall between pivots (even places) or on one (odd places).
        cases = [f"WHEN {before(p, kind)} THEN {2 * i} WHEN {same_key(p)} THEN {2 * i + 1}" for i, p in enumerate(pivots)]
        place = F.expr(f"CASE {' '.join(cases)} ELSE {2 * len(pivots)} END")
        counts = dict(active.groupBy(place.alias("place")).agg(F.count(F.lit(1))).collect())
        size, upto = sum(counts.values()), 0
        written = size if written is None else written
        for found in sorted(counts):
            if upto + counts[found] >= k:
                break
            upto += counts[found]
        if found % 2:
            return pivots[found // 2]
        k -= upto
        if found < 2 * len(pivots):
            active = active.filter(before(pivots[found // 2], kind))
        if found:
            passed = pivots[found // 2 - 1]
            active = active.filter(f"NOT ({before(passed, kind)} OR {same_key(passed)})")
        if counts[found] * SHRINK <= written:
            active, written = stored(active, "quickselect"), counts[found]


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with rank, from 1 without gaps in `order`: sorted by ranges, numbered within each, and set off by their sizes."""
    placed = stored(rows.orderBy(*order).withColumn("__llm_place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__llm_place", PARTITION_BITS)
    sizes = placed.groupBy(part.alias("__llm_part")).agg(F.count(F.lit(1)).alias("__llm_n"))
    # One row per range, as many as the session has shuffle partitions.
    starts = sizes.select("__llm_part", (F.sum("__llm_n").over(Window.orderBy("__llm_part")) - F.col("__llm_n")).alias("__llm_start"))
    inside = F.col("__llm_place").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1))
    return (placed.withColumn("__llm_part", part).join(F.broadcast(starts), "__llm_part")
            .withColumn("rank", F.col("__llm_start") + inside + 1).drop("__llm_place", "__llm_part", "__llm_start"))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST,
                        least_words: int = LEAST_WORDS, salt: str = SALT, id_col: str = "doc_id", text_col: str = "text",
                        target_col: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank of every row of `docs`; rank is null where it is not drawn.

    Of the documents with `least_words` words, `percent` of 100 are drawn, rounded down.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    source = bucket_counts(docs, buckets, longest)
    gain = gains(source, bucket_counts(target.select(F.col(target_col).alias("text")), buckets, longest))
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise(F.col("id"), salt))
    rows = stored(scored.withColumns({"back": -F.col("score"), "none": F.col("id").isNull(), "row": F.monotonically_increasing_id()}),
                  "resample-scores")
    able = f"n_words >= {int(least_words)}"
    wanted = rows.filter(able).count() * percent // 100
    shown = ["id", "n_features", "weight", "score"]
    if not wanted:
        return rows.select(*shown, F.lit(None).cast("bigint").alias("rank"))
    last = kth_key(rows.filter(able), wanted)
    drawn = f"{able} AND ({before(last, rows.schema['id'].dataType.simpleString())} OR {same_key(last)})"
    winners = ranked(rows.filter(drawn).select(*KEY, "weight", "score"), list(KEY))
    return winners.select(*shown, "rank").unionByName(rows.filter(f"NOT ({drawn})").select(*shown, F.lit(None).cast("bigint").alias("rank")))


def drawn_documents(docs: DataFrame, drawn: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of `docs` whose id `importance_resample` has drawn, all columns kept; ids that repeat are drawn together."""
    return docs.join(drawn.filter("rank IS NOT NULL").select(F.col("id").alias(id_col)).distinct(), id_col, "left_semi")


@query("op13_importance_resample", sql=r"""
    WITH codes AS (
        SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
            FROM range(256) r(i))
    ), lowered AS (
        SELECT 'd' AS side, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        UNION ALL SELECT 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
    ), words AS (
        SELECT side, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM lowered
    ), digits AS (
        SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM words)
    ), hashed AS (
        SELECT word, xor(list_reduce([4294967295::BIGINT] || [('0x' || substr(h, 2 * i + 1, 2))::BIGINT FOR i IN range(len(h) // 2)],
                   lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
        FROM digits, codes
    ), counted AS (
        SELECT bucket, count(*) FILTER (side = 'd')::DOUBLE AS s, count(*) FILTER (side = 'b')::DOUBLE AS t
        FROM words JOIN hashed USING (word) GROUP BY bucket
    ), totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counted),
    gain AS (
        SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS g FROM counted, totals
    ), weighed AS (
        SELECT doc_id, count(*) AS n, sum(g)::BIGINT AS g FROM words JOIN hashed USING (word) JOIN gain USING (bucket)
        WHERE side = 'd' GROUP BY doc_id
    ), scored AS (
        SELECT d.doc_id, coalesce(n, 0) AS n_features,
               coalesce(CASE WHEN g >= 0 THEN g // n ELSE -((n - 1 - g) // n) END, 0) AS weight,
               floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
        FROM documents d LEFT JOIN weighed USING (doc_id)
    ), placed AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id) AS place,
               count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored
    )
    SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, (weight + noise)::BIGINT AS score,
           CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END::BIGINT AS rank
    FROM placed
""")
def op13_importance_resample(spark, sf_dir):
    found = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")
