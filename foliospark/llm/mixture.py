"""Problem 7: a mixture of sources at target shares, cut into shuffled shards.

Sizes are tokens of a public tokenizer. The total is the largest at which every named source that
has documents can hold its share without repeating a document more often than allowed; each such
source gets ``share * total`` tokens. A source without documents can't be reached: it is reported
with its shortfall and the others keep the ratio of their shares.

A source's documents lie end to end in a random order (its hash of seed, copy and id), copy after
copy, and the line is cut into blocks. A keyed bijection over the block numbers (a Feistel network)
permutes the blocks; documents follow the block they begin in, and lie end to end again.

The exact block counts of all sources are divided among the output shards by a splitting tree: at
each node a multivariate-hypergeometric draw gives the left half its blocks of every source, the
rest goes right, so every shard gets what a global shuffle would give it and no block is lost or
drawn twice. A shard takes the next blocks of the permuted line due to it: what it holds of a source
differs from the quota drawn by less than one document at either end. Documents are shuffled within
their shard only. ``shard_report`` gives quota and size of every shard and source.

Scale: shards have a fixed size, so their number grows with the mixture; small mixtures are divided
too (``LEAST_SHARDS``). No table of the shards is shared: a node's draw is seeded by its place in the
tree, so every worker walks the same tree from nothing but the sources' block counts. Draws are exact
for any count of 64 bits. Positions on a line come from sums over buckets, of which there are as
many as the data needs, and a running sum within each bucket; no task ever holds a source. The driver
sees one row for each source.

Defined cases: documents with a null source, of sources not named, and without tokens are left out
(reported sizes count tokens); a negative share counts as zero and a null one too; ``max_repeats``
null or below one means a source is not used; empty tables give an empty mixture and a report of
zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .tokenizer import VOCABULARY, VOCABULARY_DIR, encode_ids

SEED = 20_240_607
#: Tokens of a block and of an output shard; parameters of the caller. A shard is sorted by one task.
BLOCK_TOKENS = 2_048
SHARD_TOKENS = 16_000_000
#: Shards of a mixture too small to fill that many.
LEAST_SHARDS = 16
#: Counts up to which the library draws hypergeometric numbers itself.
LIBRARY_COUNTS = 1_000_000_000
ROUNDS = 4
#: Documents that one bucket of a source's line should hold.
BUCKET_DOCUMENTS = 20_000


@dataclass(frozen=True)
class Quota:
    """What one source gives: all its documents ``whole`` times and the line's first ``rest`` tokens."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    whole: int
    rest: int
    blocks: int


def quotas(targets: list[tuple[str, float, int]], available: dict[str, int], block: int = BLOCK_TOKENS) -> list[Quota]:
    """The largest mixture in which every source with documents holds its share."""
    usable = {s: available.get(s, 0) * (r if s is not None else 0) for s, share, r in targets if share > 0 and r > 0}
    total = min((usable[s] / share for s, share, r in targets if usable.get(s, 0) > 0), default=0)
    found = []
    for source, share, repeats in targets:
        have = available.get(source, 0)
        wanted = int(share * total + 1e-9) if usable.get(source, 0) > 0 else 0
        whole, rest = divmod(min(wanted, have * max(repeats, 0)), have) if have else (0, 0)
        found.append(Quota(source, share, repeats, have, whole, rest, -(-(whole * have + rest) // block)))
    return found


def draw(rng: np.random.Generator, counts: np.ndarray, size: int) -> np.ndarray:
    """Colours of ``size`` balls drawn without replacement from ``counts`` of each colour; exact for any counts.

    Beyond the library's range every ball is first taken by a coin of the right bias, which leaves all
    sets of one size equally likely; then the few too many are put back, or the few missing drawn,
    as distinct balls chosen evenly.
    """
    total = int(counts.sum())
    if total < LIBRARY_COUNTS:
        return rng.multivariate_hypergeometric(counts, size, method="marginals")
    taken = rng.binomial(counts, size / total)
    missing = size - int(taken.sum())
    pool = counts - taken if missing > 0 else taken
    ends = np.cumsum(pool)
    balls = np.empty(0, dtype=np.int64)
    while len(balls) < abs(missing):
        more = rng.integers(0, int(ends[-1]), abs(missing) - len(balls))
        balls = np.unique(np.concatenate([balls, more]))
    changed = np.bincount(np.searchsorted(ends, balls, side="right"), minlength=len(counts))
    return taken + changed if missing > 0 else taken - changed


class SplittingTree:
    """Divides blocks of several sources among shards; nodes are drawn when first visited."""

    def __init__(self, blocks: list[int], shards: int, seed: int = SEED):
        self.blocks, self.shards, self.seed = np.array(blocks, dtype=np.int64), shards, seed
        self.drawn: dict[tuple[int, int], np.ndarray] = {}

    def left(self, first: int, last: int, counts: np.ndarray) -> np.ndarray:
        """Blocks of each source for the left half of the shards first..last-1."""
        node = first, last
        if node not in self.drawn:
            size = int(counts.sum()) * ((first + last) // 2 - first) // (last - first)
            self.drawn[node] = draw(np.random.default_rng((self.seed, first, last)), counts, size)
        return self.drawn[node]

    def quotas(self) -> np.ndarray:
        """Blocks of each source in each shard: shape (shards, sources), columns summing to ``blocks``."""
        out = np.zeros((self.shards, len(self.blocks)), dtype=np.int64)
        nodes = [(0, self.shards, self.blocks)]
        while nodes:
            first, last, counts = nodes.pop()
            if last - first == 1:
                out[first] = counts
                continue
            left, middle = self.left(first, last, counts), (first + last) // 2
            nodes += [(first, middle, left), (middle, last, counts - left)]
        return out

    def shards_of(self, source: np.ndarray, turn: np.ndarray) -> np.ndarray:
        """The shard of each block, given its source's number and its place in the permuted line."""
        out = np.zeros(len(turn), dtype=np.int32)
        nodes = [(0, self.shards, self.blocks, np.arange(len(turn)), turn.astype(np.int64))]
        while nodes:  # only nodes with rows below them are visited
            first, last, counts, rows, at = nodes.pop()
            if last - first == 1:
                out[rows] = first
                continue
            left, middle = self.left(first, last, counts), (first + last) // 2
            here = at < left[source[rows]]
            if here.any():
                nodes.append((first, middle, left, rows[here], at[here]))
            if not here.all():
                right = rows[~here]
                nodes.append((middle, last, counts - left, right, at[~here] - left[source[right]]))
        return out


def permuted(number: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed bijection of 0..size-1: a Feistel network over the next even power of two, walked until inside."""
    half = np.uint64(max(1, ((size - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.default_rng((SEED, key)).integers(0, 1 << 63, ROUNDS, dtype=np.uint64)

    def network(x: np.ndarray) -> np.ndarray:
        high, low = x >> half, x & mask
        for k in keys:
            mixed = (low + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            high, low = low, high ^ (mixed >> np.uint64(32)) & mask
        return high << half | low

    out = network(number.astype(np.uint64))
    while (outside := out >= size).any():  # the network's domain is less than four times as large
        out[outside] = network(out[outside])
    return out.astype(np.int64)


def _placed(df: DataFrame, keys: list[str], bucket: Column, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: the tokens before each row among the rows of its keys, by bucket and then ``order``."""
    df = df.withColumn("bucket", bucket)
    sums = df.groupBy(*keys, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_tokens").over(before), F.lit(0))).drop("bucket_tokens")
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return df.withColumn("inner", inner).join(sums, [*keys, "bucket"]).withColumn(out, F.col("bucket_start") + F.col("inner")).drop("bucket", "bucket_start", "inner")


def _line(sized: DataFrame, quotas_df: DataFrame, buckets: int) -> DataFrame:
    """Every copy of every document that may be used, with its place on its copy's part of the line."""
    copies = sized.join(F.broadcast(quotas_df), "source")  # one row a source
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("whole")))).filter("copy < whole or rest > 0")
    copies = copies.withColumn("order", F.xxhash64(F.lit(SEED), "copy", "doc_id"))
    # the bucket is a prefix of the order, so that buckets lie in order too
    bucket = F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * buckets).cast("bigint")
    return _placed(copies, ["source", "copy"], bucket, ["order", "doc_id"], "place")


def token_sizes(documents: DataFrame, name: str = VOCABULARY, directory: str = VOCABULARY_DIR) -> DataFrame:
    """doc_id, source, n_tokens of every document."""
    return encode_ids(documents, "text", ["doc_id", "source"], "n_tokens", name, directory, counts_only=True)


def _plan(documents: DataFrame, targets: DataFrame, block: int) -> tuple[DataFrame, list[Quota], int]:
    named = targets.groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats")).orderBy("source")
    wanted = [(r["source"], max(0.0, r["share"] or 0.0), r["repeats"] or 0) for r in named.collect() if r["source"] is not None]
    sized = documents.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")  # the targets' table names the sources
    sized = cut_lineage(token_sizes(sized).filter("n_tokens > 0 and doc_id is not null"))
    held = {r["source"]: (r["tokens"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    buckets = max(1, -(-max((docs for _, docs in held.values()), default=0) // BUCKET_DOCUMENTS))
    return sized, quotas(wanted, {s: t for s, (t, _) in held.items()}, block), buckets


def _chosen(sized: DataFrame, given: list[Quota], buckets: int) -> DataFrame:
    spark = sized.sparkSession
    rows = [(q.source, q.whole, q.rest, q.available, i) for i, q in enumerate(q for q in given if q.blocks)]
    line = _line(sized, spark.createDataFrame(rows, "source string, whole int, rest bigint, available bigint, number int"), buckets)
    # the last copy gives the documents that begin and end within the rest; all but one document's worth
    return line.filter("copy < whole or place + n_tokens <= rest")


_LINE = "source string, number int, doc_id bigint, copy int, n_tokens int"


def _on_line(df: DataFrame, at: Column, made: str, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``made``, worked out from each row's source number and ``at``, beside the columns of the line."""
    kept = [part.split(" ")[0] for part in _LINE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, place = batch.column(1).to_numpy(), batch.column(len(kept)).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(work(number, place))], names=[*kept, made.split(" ")[0]])

    return df.select(*kept, at.cast("bigint").alias("at")).mapInArrow(run, f"{_LINE}, {made}")


def _sharded(documents: DataFrame, targets: DataFrame, shards: int | None, block: int) -> tuple[DataFrame, SplittingTree, list[Quota]]:
    """The chosen copies with their shard, the tree and the sources' quotas."""
    sized, given, buckets = _plan(documents, targets, block)
    used = [q for q in given if q.blocks]
    blocks = [q.blocks for q in used]
    tree = SplittingTree(blocks, shards or max(LEAST_SHARDS, -(-sum(blocks) * block // SHARD_TOKENS)))

    def turns(number: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for i in np.unique(number):
            rows = number == i
            out[rows] = permuted(np.minimum(at[rows] // block, blocks[i] - 1), blocks[i], int(i))
        return out

    def shard(number: np.ndarray, at: np.ndarray) -> np.ndarray:
        return tree.shards_of(number, np.minimum(at // block, tree.blocks[number] - 1))

    chosen = _chosen(sized, given, buckets)
    turned = _on_line(chosen, F.col("copy") * F.col("available") + F.col("place"), "turn bigint", turns)
    width = max(1, -(-max(blocks, default=1) // buckets))
    again = _placed(turned, ["source"], F.floor(F.col("turn") / width), ["turn", "copy", "doc_id"], "place")
    return _on_line(again, F.col("place"), "shard int", shard), tree, used


def mixture(documents: DataFrame, targets: DataFrame, shards: int | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """shard, position, source, doc_id, copy, n_tokens: the mixture, each shard in its shuffled order.

    Without ``shards`` there are as many as hold ``SHARD_TOKENS`` each, and at least ``LEAST_SHARDS``.
    """
    sharded, *_ = _sharded(documents, targets, shards, block)
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(SEED + 1), "source", "copy", "doc_id"), "source", "doc_id", "copy")
    return sharded.withColumn("position", F.row_number().over(order) - 1).select("shard", "position", "source", "doc_id", "copy", "n_tokens")


def shard_report(documents: DataFrame, targets: DataFrame, shards: int | None = None, block: int = BLOCK_TOKENS) -> DataFrame:
    """shard, source, quota_tokens, tokens, documents: what the tree drew for each shard and what the shard holds.

    ``tokens`` differs from ``quota_tokens`` by less than one document at either end of the shard's part of the
    line; the last shard with blocks of a source also lacks the part of the last block that no document filled.
    """
    sharded, tree, used = _sharded(documents, targets, shards, block)
    held = sharded.groupBy("shard", "number").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("documents"))
    names = documents.sparkSession.createDataFrame([(i, q.source) for i, q in enumerate(used)], "number int, source string")

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotas = tree.quotas() if batch.num_rows else np.zeros((0, len(used)), dtype=np.int64)
            shard, number = np.nonzero(quotas)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(number.astype(np.int32)), pa.array(quotas[shard, number] * block)], names=["shard", "number", "quota_tokens"]
            )

    quota = documents.sparkSession.range(1 if used else 0, numPartitions=1).mapInArrow(drawn, "shard int, number int, quota_tokens bigint")
    joined = quota.join(held, ["shard", "number"], "left").join(F.broadcast(names), "number")  # a row a source
    return joined.select("shard", "source", "quota_tokens", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"))


def shares_reached(documents: DataFrame, targets: DataFrame, block: int = BLOCK_TOKENS) -> DataFrame:
    """A row for each named source: what it has, gives and reaches, and whether that is its target.

    reached_share is of the mixture's real size; short_tokens is what it lacks of target_share of the
    size planned; most_copies is how often its most repeated document occurs.
    """
    sized, given, buckets = _plan(documents, targets, block)
    spark = documents.sparkSession
    chosen = _chosen(sized, given, buckets)
    per_source = chosen.groupBy("source").agg(
        F.sum("n_tokens").alias("reached_tokens"), F.count("*").alias("documents_used"), (F.max("copy") + 1).alias("most_copies")
    )
    planned = max((q.whole * q.available + q.rest) / q.target_share for q in given if q.target_share) if any(q.blocks for q in given) else 0.0
    table = spark.createDataFrame(
        [(q.source, q.target_share, q.max_repeats, q.available, int(q.target_share * planned + 1e-6)) for q in given],
        "source string, target_share double, max_repeats int, available_tokens bigint, planned_tokens bigint",
    )
    joined = table.join(F.broadcast(per_source), "source", "left").na.fill(0, ["reached_tokens", "documents_used", "most_copies"])
    joined = joined.withColumn("all_tokens", F.sum("reached_tokens").over(Window.partitionBy(F.lit(1))))  # a row a source
    share = F.when(F.col("all_tokens") > 0, F.col("reached_tokens") / F.col("all_tokens")).otherwise(F.lit(0.0))
    return joined.select(
        "source", "target_share", "max_repeats", "available_tokens", "documents_used", "most_copies", "reached_tokens",
        share.alias("reached_share"), F.greatest(F.col("planned_tokens") - F.col("reached_tokens"), F.lit(0)).alias("short_tokens"),
        (F.col("reached_tokens") > 0).alias("reachable"),
    )
