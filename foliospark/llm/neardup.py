"""Problem 1: groups of records that differ by small edits, without comparing all pairs.

A text becomes a signature of ``SEGMENTS * SEGMENT`` positions (the least value of as many hash
orders over its five-character runs). The signature is cut into a few segments; two alike texts
have, in at least one segment, at most one position that differs. Every segment therefore is
indexed once per wildcard position, under a key of the segment number, the wildcard and the other
positions, and texts are joined on equal keys. Each joined pair is verified on the whole texts.

Why positions and not single bits: at an alikeness of 0.7 some 15 % of the bits of a bit
signature differ, so segments in which at most one bit differs would have under ten bits and
select nothing. The variant scheme is the same, over symbols of 32 bits.

A pair of alikeness j shares a key of one segment with probability j**7 + 7 * j**6 * (1 - j), which
at 0.7 is 0.33; over 18 segments a pair at the threshold is missed with probability below 0.001,
at 0.75 below 0.00003. Pairs below the threshold never come out, since each is verified exactly.

Copies are one text: signatures, keys and verification are per distinct text, so a group of
copies costs one text, however large it is. The index is moved once, into as many partitions as its
size asks for, and sorted; texts of one key then follow each other, and pairs come from runs of
equal keys. A run longer than ``HOT`` (a segment that boilerplate shares) is not paired at all: its texts,
whatever their keys, are joined exactly by their rarest runs instead (``_pairs_of_hot``): two sets at
least as alike as the threshold have one of the few rarest elements of each in common, and those are
not boilerplate. No task holds a run, nothing is capped, and no link is lost by it.

Defined cases: null texts and texts without a run of five characters belong to no pair; redelivered
rows count once; ids of equal texts pair with alikeness 1; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .arrow import map_rows

RUN = 5
THRESHOLD = 0.7
SEGMENTS, SEGMENT = 18, 7
SEED = 20_240_607
#: Texts of one key from which they are joined by their rarest runs instead.
HOT = 256
#: Rows of the index in one partition.
PARTITION_ROWS = 1_500_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def squeeze(text: str) -> str:
    """The text without whitespace."""
    return "".join(text.split())


def run_hashes(squeezed: str, run: int = RUN) -> np.ndarray:
    """64-bit hashes of the runs of ``run`` consecutive code points, each once, in order."""
    points = np.frombuffer(squeezed.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - run + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    value = np.zeros(n, dtype=np.uint64)
    for i in range(run):  # a code point has 21 bits: three to a word, mixed, then the rest
        value = (value + points[i : i + n]) * _M1
        value ^= value >> np.uint64(29)
    value *= _M2
    value ^= value >> np.uint64(32)
    return np.unique(value)


def hash_orders(size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``size`` permutations of the 32-bit integers."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 32, size, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray, orders: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least image of the set under each order."""
    factor, offset = orders
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(factor), np.uint32(0xFFFFFFFF))
    for start in range(0, len(low), 512):  # long texts a block at a time
        block = low[start : start + 512, None] * factor + offset
        np.minimum(best, block.min(axis=0), out=best)
    return best


def variant_keys(sign: np.ndarray, segments: int = SEGMENTS, segment: int = SEGMENT) -> np.ndarray:
    """A 64-bit key for each segment and wildcard position."""
    parts = sign.reshape(segments, segment).astype(np.uint64)
    mixed = (parts + (np.arange(segment, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * _M1
    mixed = (mixed ^ (mixed >> np.uint64(31))) * _M2
    mixed ^= mixed >> np.uint64(33)
    keys = mixed.sum(axis=1, dtype=np.uint64)[:, None] - mixed  # all positions but the wildcard
    tag = np.arange(segments * segment, dtype=np.uint64).reshape(segments, segment) * np.uint64(0x632BE59BD9B4E019)
    keys = (keys ^ tag) * _M1
    return (keys ^ (keys >> np.uint64(32))).reshape(-1)


def _digest(squeezed: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(squeezed.encode("utf-8", "surrogatepass"))


def _fields(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """A row per record field with text to compare: digest of the squeezed text, field, record."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for row_id, *texts in rows:
            if row_id is None:
                continue
            for f, text in enumerate(texts):
                if text and len(squeezed := squeeze(text)) >= RUN:
                    yield _digest(squeezed), f, row_id

    return map_rows(df.select(id_col, *fields), run, "digest binary, field int, row_id bigint")


def _signed(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """As ``_fields``, with the variant keys where the text occurs first in its partition."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        orders = hash_orders(SEGMENTS * SEGMENT)
        seen: set[bytes] = set()
        for row_id, *texts in rows:
            if row_id is None:
                continue
            for f, text in enumerate(texts):
                if text and len(squeezed := squeeze(text)) >= RUN:
                    digest, keys = _digest(squeezed), None
                    if digest not in seen:
                        seen.add(digest)
                        keys = variant_keys(signature(run_hashes(squeezed), orders)).view(np.int64).tolist()
                    yield digest, row_id * len(fields) + f, keys

    return map_rows(df.select(id_col, *fields), run, "digest binary, text_id bigint, keys array<bigint>", flush=2048)


def _texts(df: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """The squeezed texts again, with their digest."""

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for texts in rows:
            for text in dict.fromkeys(texts):
                if text and len(squeezed := squeeze(text)) >= RUN:
                    yield _digest(squeezed), squeezed

    return map_rows(df.select(*fields), run, "digest binary, body string", flush=1024)


def _verify(pairs: DataFrame, threshold: float) -> DataFrame:
    """Exact alikeness of the two bodies of each row; rows come grouped by the first text."""
    per_mille = round(threshold * 1000)

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        last, runs = None, set()
        for text_a, text_b, body_a, body_b in rows:
            if text_a != last:
                last, runs = text_a, {body_a[i : i + RUN] for i in range(len(body_a) - RUN + 1)}
            if min(len(body_a), len(body_b)) < RUN:
                continue
            other = {body_b[i : i + RUN] for i in range(len(body_b) - RUN + 1)}
            common = len(runs & other)
            if 1000 * common >= per_mille * (len(runs) + len(other) - common):
                yield text_a, text_b, common / (len(runs) + len(other) - common)

    return map_rows(pairs.select("text_a", "text_b", "body_a", "body_b"), run, "text_a bigint, text_b bigint, alike double")


def _paired(index: DataFrame) -> DataFrame:
    """text_a < text_b of each run of equal keys, repeatedly where texts share several; of hot runs, text_a alone.

    ``index`` is sorted by key and text within its partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], names=["text_a", "text_b"])

        keys, ids, hot = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), None
        for batch in batches:
            keys, ids = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([ids, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            lengths = np.diff(np.concatenate([starts, [len(keys)]]))
            heavy = (lengths > HOT) | (keys[starts] == hot) if hot is not None else lengths > HOT
            open_heavy = bool(heavy[-1])  # the last run may go on: a hot one is handed on, any other kept back
            hot = keys[-1] if open_heavy else None
            of_heavy = np.repeat(heavy, lengths)
            if heavy.any():
                yield made(ids[of_heavy])
            done = len(keys) if open_heavy else starts[-1]
            k, i = keys[:done][~of_heavy[:done]], ids[:done][~of_heavy[:done]]
            for apart in range(1, HOT):
                same = np.flatnonzero(k[apart:] == k[:-apart])
                if not len(same):
                    break
                yield made(i[same], i[same + apart])
            keys, ids = (keys[:0], ids[:0]) if open_heavy else (keys[done:], ids[done:])
        for apart in range(1, len(keys)):
            yield made(ids[:-apart], ids[apart:])

    return index.mapInArrow(run, "text_a bigint, text_b bigint")


def _pairs_of_hot(bodies: DataFrame, per_mille: int) -> DataFrame:
    """text_a < text_b among the given texts: a superset of the pairs at least ``per_mille`` alike, exactly.

    The runs of a text are ordered by how few of the texts have them. Sets of a and b elements with at least
    o in common share one of the first a - o + 1 of the one and the first b - o + 1 of the other, and o is at
    least the threshold's share of either size.
    """

    def run(rows: Iterable[tuple]) -> Iterator[tuple]:
        for text_id, body in rows:
            runs = run_hashes(body).view(np.int64).tolist()
            for gram in runs:
                yield text_id, gram, len(runs)

    grams = map_rows(bodies.select("text_id", "body"), run, "text_id bigint, gram bigint, n int", flush=16384)
    counts = grams.groupBy("gram").agg(F.count("*").alias("texts"))
    rank = F.row_number().over(Window.partitionBy("text_id").orderBy("texts", "gram"))  # one text's runs
    least = F.ceil(F.col("n") * per_mille / 1000)
    rare = grams.join(counts, "gram").withColumn("rank", rank).filter((F.col("rank") <= F.col("n") - least + 1) & (F.col("texts") > 1))
    rare = cut_lineage(rare.select("gram", "text_id", "n"))
    a, b = rare.toDF("gram", "text_a", "n_a"), rare.toDF("gram", "text_b", "n_b")
    alike = (F.least("n_a", "n_b") * 1000 >= F.greatest("n_a", "n_b") * per_mille) & (F.col("text_a") < F.col("text_b"))
    return a.join(b, "gram").filter(alike).select("text_a", "text_b").distinct()


def _bodies(df: DataFrame, id_col: str, fields: list[str], named: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_id, body of the wanted texts, written once."""
    wanted = named.join(wanted, "text_id", "left_semi").select("digest", "text_id")
    return cut_lineage(_texts(df, id_col, fields).join(wanted, "digest").dropDuplicates(["text_id"]).select("text_id", "body"))


def near_duplicates(df: DataFrame, id_col: str, fields: list[str], threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``.

    ``members``: text_id, field (name), row_id; one row per record field, text_id naming the class of
    equal texts. ``links``: text_a < text_b, alike; one row per pair of different texts at least
    ``threshold`` alike.
    """
    number = F.col("row_id") * len(fields) + F.col("field")
    listed = cut_lineage(_fields(df, id_col, fields))
    named = listed.groupBy("digest").agg(F.min(number).alias("text_id"))
    label = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("field") + 1)
    members = listed.join(named, "digest").select("text_id", label.alias("field"), "row_id").distinct()
    # one shuffle brings the copies of a text together and keeps the keys of one of them
    classes = _signed(df, id_col, fields).groupBy("digest").agg(F.min("text_id").alias("text_id"), F.first("keys", ignorenulls=True).alias("keys"))
    partitions = max(df.sparkSession.sparkContext.defaultParallelism, -(-listed.count() * SEGMENTS * SEGMENT // PARTITION_ROWS))
    index = classes.select(F.explode("keys").alias("key"), "text_id").repartition(partitions, "key").sortWithinPartitions("key", "text_id")
    found = cut_lineage(_paired(index).distinct())
    pairs, hot = found.filter("text_b is not null"), found.filter("text_b is null").select(F.col("text_a").alias("text_id"))
    ends = pairs.select(F.col("text_a").alias("text_id")).union(pairs.select("text_b"))
    bodies = _bodies(df, id_col, fields, named, ends.union(hot).distinct())
    if not hot.isEmpty():
        pairs = pairs.union(_pairs_of_hot(bodies.join(hot, "text_id", "left_semi"), round(threshold * 1000))).distinct()
    both = pairs.join(bodies.select(F.col("text_id").alias("text_b"), F.col("body").alias("body_b")), "text_b").join(
        bodies.select(F.col("text_id").alias("text_a"), F.col("body").alias("body_a")), "text_a"
    )
    return members, _verify(both.sortWithinPartitions("text_a"), threshold)


def near_duplicate_pairs(df: DataFrame, id_col: str, fields: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """field_name, result_a < result_b: every pair of records whose field is at least ``threshold`` alike.

    This form spells out the pairs within classes of copies too, as the problem's statement asks.
    """
    members, links = near_duplicates(df, id_col, fields, threshold)
    copies = members.groupBy("text_id", "field").count().filter("count > 1").select("text_id").distinct()
    classes = links.select("text_a", "text_b").union(copies.select(F.col("text_id").alias("text_a"), F.col("text_id").alias("text_b")))
    left = members.select(F.col("text_id").alias("text_a"), F.col("field").alias("field_name"), F.col("row_id").alias("row_a"))
    right = members.select(F.col("text_id").alias("text_b"), F.col("field").alias("field_name"), F.col("row_id").alias("row_b"))
    found = classes.join(left, "text_a").join(right, ["text_b", "field_name"])
    found = found.filter((F.col("text_a") != F.col("text_b")) | (F.col("row_a") < F.col("row_b"))).filter("row_a <> row_b")
    return found.select("field_name", F.least("row_a", "row_b").alias("result_a"), F.greatest("row_a", "row_b").alias("result_b"))


def near_duplicate_classes(df: DataFrame, id_col: str, fields: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """field, row_id, class_id, copies, links: one row per record field that has any text to compare.

    ``class_id`` names the texts equal to this one but for whitespace, ``copies`` counts them in the
    same field, ``links`` counts the different texts (of either field) at least ``threshold`` alike.
    """
    members, links = near_duplicates(df, id_col, fields, threshold)
    ends = links.select(F.col("text_a").alias("text_id")).union(links.select(F.col("text_b").alias("text_id")))
    degree = ends.groupBy("text_id").agg(F.count("*").alias("links"))
    copies = members.groupBy("text_id", "field").agg(F.count("*").alias("copies"))
    joined = members.join(copies, ["text_id", "field"]).join(degree, "text_id", "left")
    return joined.select("field", "row_id", F.col("text_id").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_links(df: DataFrame, id_col: str, fields: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """class_a < class_b, alike: the pairs of different texts, by the ids that ``near_duplicate_classes`` gives their copies."""
    _, links = near_duplicates(df, id_col, fields, threshold)
    return links.select(F.col("text_a").alias("class_a"), F.col("text_b").alias("class_b"), F.round("alike", 6).alias("alike"))
