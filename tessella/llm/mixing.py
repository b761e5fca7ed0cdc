"""Selections in which every source has its target share of all tokens, evenly interleaved.

Tokens are counted once and kept in the shared checkpoint folder. Each source's
documents are put in a fixed random order, and a running sum of their tokens, taken in
two levels so that no task sees a whole source, says which documents fill the source's
quota, after how many passes over it. The quota is cut into blocks. Block i of a
source with n of N blocks may not start before slot i * N / n and has to be over by
slot (i + 1) * N / n; serving the earliest deadline first keeps every prefix within less
than one block of every target share (Pfair scheduling).

See Baruah, Cohen, Plaxton and Varvel, "Proportionate progress" (1996).
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Mapping
from functools import lru_cache
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.runs import by_bytes
from tessella.session import reliable_checkpoint, spread

#: Sources that may be named, so that what the driver holds is bounded.
MAX_SOURCES = 100_000
#: Blocks into which a selection is cut at most, and documents of mean size in a block at least. So many
#: blocks are put in order in some minutes by one task; at 100 TB of text a block is then 0.4 million tokens.
MAX_BLOCKS, BLOCK_DOCUMENTS = 1 << 26, 8
#: Blocks whose order is broadcast; that of more is joined by a shuffle.
BROADCAST_BLOCKS = 1 << 16
#: Documents of a source in one bucket of the running sum, about; and bits of the bucket's number at most.
BUCKET_DOCUMENTS, BUCKET_BITS = 20_000, 20


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def default_tokenizer() -> tuple[str, str]:
    """Path and pattern of a public byte-level vocabulary, where its package is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def count_tokens(df: DataFrame, text: str, tokenizer: tuple[str, str] | None = None, name: str = "n_tokens") -> DataFrame:
    """``df`` with ``name``, the number of tokens of ``text``, in place of ``text``; a null text has none.

    ``tokenizer`` is the path of a vocabulary in tiktoken's rank format, readable on every
    executor, and the pattern that cuts texts into words.
    """
    path, pattern = tokenizer or default_tokenizer()
    others = [c for c in df.columns if c != text]
    if name in others:
        raise ValueError(f"there is a column {name} already")
    schema = T.StructType([*(df.schema[c] for c in others), T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            for part in by_bytes(batch, "__text"):
                sizes = [len(encode(t)) if t else 0 for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int64())], names=schema.names)

    return spread(df.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").alias("__text"))).mapInArrow(run, schema)


def apportion(shares: Mapping[str, float], blocks: int) -> dict[str, int]:
    """``blocks`` dealt out by largest remainder, and at least one, of which there must be enough, to every source."""
    exact = {s: w * blocks for s, w in shares.items()}
    dealt = {s: int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (dealt[s] - exact[s], s))[: blocks - sum(dealt.values())]:
        dealt[s] += 1
    for s in [s for s, n in dealt.items() if n == 0]:
        dealt[max(dealt, key=lambda s: (dealt[s], s))] -= 1
        dealt[s] = 1
    return dealt


def pfair(blocks: Mapping[str, int]) -> Iterator[tuple[str, int]]:
    """(source, block) for each slot, earliest deadline first among blocks that are released."""
    total = sum(blocks.values())
    names = sorted(s for s, n in blocks.items() if n)
    waiting = [(0, k, 0) for k in range(len(names))]  # release, source, block
    ready: list[tuple[int, int, int]] = []  # deadline, source, block
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // blocks[names[k]]), k, i))
        deadline, k, i = heapq.heappop(ready)
        assert deadline > slot
        yield names[k], i
        if i + 1 < blocks[names[k]]:
            heapq.heappush(waiting, ((i + 1) * total // blocks[names[k]], k, i + 1))


def _slots(spark: SparkSession, blocks: Mapping[str, int]) -> DataFrame:
    """(__s, __block, slot) in a stream from one task, so that neither the driver nor the task holds the list."""
    held = dict(blocks)
    schema = T.StructType([T.StructField("__s", T.StringType()), T.StructField("__block", T.IntegerType()), T.StructField("slot", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not sum(batch.num_rows for batch in batches):
            return
        order, first = pfair(held), 0
        while part := list(islice(order, 1 << 14)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in part], pa.string()), pa.array([i for _, i in part], pa.int32()), pa.array(range(first, first + len(part)), pa.int32())], names=schema.names
            )
            first += len(part)

    slots = spark.range(1, numPartitions=1).mapInArrow(run, schema)
    return F.broadcast(slots) if sum(held.values()) <= BROADCAST_BLOCKS else slots


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    total_tokens: int | None = None,
    tokenizer: tuple[str, str] | None = None,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """A selection of documents in which each source has its share of the tokens, and what was reached.

    ``targets`` holds source, target_share and max_repeats. Sources that are not named, or
    named with share 0, give nothing; shares of sources without a token are spread over
    the others in proportion. The selection holds ``total_tokens``, or the most for which
    every source can reach its share with no document used more than max_repeats times,
    whichever is less. A source's documents are used up before any is used again.

    The selection has a row per use: ``doc_id``, ``source``, use_no from 1 on, n_tokens,
    slot (the place of its block among all blocks) and place (tokens of the source
    before it). The report has a row per named source: target_share, share (with absent
    sources spread), max_repeats, n_documents, available_tokens, selected_tokens,
    actual_share and most_uses. A source deviates from its share by half a document at
    most. Null sources and null or empty texts take no part; repeated rows are documents
    of their own; a null max_repeats is 1 and one below 1 excludes the source. An empty
    table gives an empty selection.
    """
    spark = df.sparkSession
    named = targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()
    if len(named) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goals = {r["source"]: (float(r["target_share"] or 0), 1 if r["max_repeats"] is None else int(r["max_repeats"])) for r in named if r["source"] is not None}
    if len(goals) < sum(r["source"] is not None for r in named) or any(w < 0 for w, _ in goals.values()):
        raise ValueError("a source is named twice or has a negative share")
    listed = spark.createDataFrame([(s,) for s, (w, k) in goals.items() if w > 0 and k > 0], "__s string")
    rows = df.select(F.col(f"`{doc_id}`").alias("__d"), F.col(f"`{source}`").alias("__s"), F.col(f"`{text}`").alias("__t"))
    rows = rows.join(F.broadcast(listed), "__s", "left_semi")  # at most MAX_SOURCES names
    counted = count_tokens(rows, "__t", tokenizer, "__n").where("__n > 0").withColumn("__o", F.xxhash64("__d", F.lit(seed)))
    counted = reliable_checkpoint(counted)

    held = {r["__s"]: (r["n"], r["docs"]) for r in counted.groupBy("__s").agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("docs")).collect()}
    weight = sum(goals[s][0] for s in held)
    share = {s: goals[s][0] / weight for s in held}
    most = min((held[s][0] * goals[s][1] / share[s] for s in held), default=0)
    total = most if total_tokens is None else min(most, total_tokens)
    docs = sum(d for _, d in held.values())
    mean = sum(n for n, _ in held.values()) / docs if docs else 1
    blocks = apportion(share, min(MAX_BLOCKS, max(len(held), int(total / (BLOCK_DOCUMENTS * mean))))) if held else {}

    bits = min(BUCKET_BITS, max(0, max((d for _, d in held.values()), default=0) // BUCKET_DOCUMENTS).bit_length())
    placed = counted.withColumn("__b", F.shiftrightunsigned(F.col("__o") + F.lit(0), 64 - bits) if bits else F.lit(0).cast("long"))
    before = placed.groupBy("__s", "__b").agg(F.sum("__n").alias("__sum"))
    before = before.select("__s", "__b", (F.sum("__sum").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__sum")).alias("__before"))  # at most 2**BUCKET_BITS rows a source
    within = Window.partitionBy("__s", "__b").orderBy("__o", "__d", "__n").rowsBetween(Window.unboundedPreceding, 0)
    start = placed.withColumn("__upto", F.sum("__n").over(within)).join(before, ["__s", "__b"]).withColumn("__start", F.col("__before") + F.col("__upto") - F.col("__n"))
    plan = spark.createDataFrame(
        [(s, held[s][0], goals[s][1], float(share[s] * total), blocks[s]) for s in held], "__s string, __held long, __most int, __quota double, __blocks int"
    )
    uses = (
        start.join(F.broadcast(plan), "__s")  # at most MAX_SOURCES rows
        .withColumn("__use", F.explode(F.sequence(F.lit(0), F.least(F.col("__most") - 1, F.floor(F.col("__quota") / F.col("__held")).cast("int")))))
        .withColumn("place", F.col("__start") + F.col("__use") * F.col("__held"))
        .withColumn("__middle", F.col("place") + F.col("__n") / 2)
        .where("__middle <= __quota")
        .withColumn("__block", F.least(F.floor(F.col("__middle") * F.col("__blocks") / F.col("__quota")).cast("int"), F.col("__blocks") - 1))
    )
    selection = uses.join(_slots(spark, blocks), ["__s", "__block"]).select(
        F.col("__d").alias(doc_id), F.col("__s").alias(source), (F.col("__use") + 1).alias("use_no"), F.col("__n").alias("n_tokens"), "slot", "place"
    )
    reached = selection.groupBy(F.col(source).alias("__r")).agg(F.sum("n_tokens").alias("selected_tokens"), F.max("use_no").alias("most_uses"))
    table = [(s, w, share.get(s, 0.0), k, *(held.get(s, (0, 0))[::-1])) for s, (w, k) in goals.items()]
    report = spark.createDataFrame(table, "source string, target_share double, share double, max_repeats int, n_documents long, available_tokens long")
    report = report.join(reached, F.col("source") == F.col("__r"), "left").drop("__r").fillna(0, ["selected_tokens", "most_uses"])
    return selection, report.withColumn("actual_share", F.try_divide(F.col("selected_tokens").cast("double"), F.sum("selected_tokens").over(Window.partitionBy(F.lit(1)))))
