"""Mixing sources to target weights."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.session import materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the byte-level vocabularies of 50,257 tokens split a text before merging.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 100_000  # digests whose count a task remembers, so that a text copied very often is counted once per task


def counter(path: str, pieces: str = PIECES) -> Callable[[list[str]], list[int]]:
    """Counts tokens by a public vocabulary: ranks (``.tiktoken``, split by ``pieces``) or a tokenizer's own description (``.json``). Special tokens are ordinary text."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding(os.path.basename(path), pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    count, known = counter(path), {}
    for b in batches:
        copies, texts = b.column("copy_of").to_pylist(), b.column("text")
        first = {c: i for i, c in enumerate(copies) if c not in known}
        new = list(first)
        for c in range(0, len(new), 256):
            part = new[c : c + 256]
            known.update(zip(part, count(texts.take(pa.array([first[x] for x in part])).to_pylist())))
        n = [known[c] for c in copies]
        if len(known) > KEPT:
            known = {}
        yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "source", "copy_of")), pa.array(n, pa.int64())], ["doc_id", "source", "copy_of", "n_tokens"])


def sized_texts(documents: DataFrame, tokenizer: str = TOKENIZER, goal: DataFrame | None = None) -> DataFrame:
    """``doc_id, source, n_tokens``: one record per distinct text, counted in tokens of a public tokenizer.

    The record with the smallest id stands for all copies of its text, so that no text can
    be used more often than its record. Sources are compared without outer spaces and in
    lower case. Null and empty texts have no tokens and are left out. Only a digest of each
    text is shuffled.

    With a ``goal`` (``source, target_share, max_repeats``, a row per source) copies in other
    sources, or in none, are left out first. Of the copies left, those in sources that may be
    used (share and cap above zero) come first, then the smallest id: a text that several such
    sources share belongs to the source of its smallest id among them.
    """
    rows = spread(documents).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.trim("source")).alias("source"), F.sha2(F.col("text"), 256).alias("copy_of"), F.col("text").alias("text")
    ).where("text is not null and text <> '' and doc_id is not null")
    usable = F.lit(True)
    if goal is not None:
        rows = rows.join(goal.select("source"), "source", "left_semi")
    counted = rows.mapInArrow(partial(_count, path=tokenizer), "doc_id long, source string, copy_of string, n_tokens long")
    if goal is not None:
        counted = counted.join(goal, "source")
        usable = F.coalesce((F.col("target_share") > 0) & (F.col("max_repeats") > 0), F.lit(False))
    first = F.min(F.struct((~usable).alias("unused"), "doc_id", "source", "n_tokens")).alias("t")
    return counted.groupBy("copy_of").agg(first).select("t.doc_id", "t.source", "t.n_tokens").where("n_tokens > 0")


def water_fill(sizes: dict[str, float], targets: dict[str, float], caps: dict[str, float], total: float | None = None) -> dict[str, float]:
    """Epochs (repeats, with a fraction) per source so that the shares come as near the targets as the caps allow.

    Sources that would need more than their cap are clamped to it; what they cannot give is
    shared out among the others in proportion to their targets, until nothing overflows.
    ``total`` defaults to the size of all sources with a target; if the caps do not allow it,
    everything is used as often as allowed. Sources of no size or target get nothing.
    """
    live = {s: t for s, t in targets.items() if t and t > 0 and sizes.get(s, 0) > 0 and caps.get(s, 0) > 0}
    left = min(sum(sizes[s] for s in live) if total is None else total, sum(caps[s] * sizes[s] for s in live))
    epochs = dict.fromkeys(targets, 0.0)
    while live and left > 0:
        weight = sum(live.values())
        over = [s for s, t in live.items() if left * t / weight >= caps[s] * sizes[s] * (1 - 1e-12)]
        if not over:
            return epochs | {s: left * t / weight / sizes[s] for s, t in live.items()}
        for s in over:
            epochs[s] = float(caps[s])
            left -= caps[s] * sizes[s]
            del live[s]
    return epochs


def mix(documents: DataFrame, targets: DataFrame, *, total_tokens: float | None = None, seed: int = 42, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The chosen records with their repeats, and the shares reached.

    ``targets`` has ``source, target_share, max_repeats`` (a row per source; a source given twice
    keeps its largest share and smallest cap). First result: ``doc_id, source, n_tokens, repeats``; a
    record is used ``floor(epochs)`` times, and once more if a seeded hash of its id falls
    below the fraction left. Second: ``source, target_share, size_tokens, epochs, tokens,
    share`` for every source with a target (share 0 where there is nothing to take). Only one
    number per source comes to the driver.
    """
    goal = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("source is not null").groupBy("source").agg(
        F.max("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats")
    )
    goal = materialize(goal, "targets")  # so that its size is known to the joins
    sized = materialize(sized_texts(documents, tokenizer, goal), "sized")
    sums = goal.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("size")), "source", "left").collect()
    sizes = {r.source: float(r["size"] or 0) for r in sums}
    epochs = water_fill(sizes, {r.source: float(r.target_share or 0) for r in sums}, {r.source: float(r.max_repeats or 0) for r in sums}, total_tokens)
    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [(r.source, float(r.target_share or 0), int(sizes[r.source]), epochs[r.source]) for r in sums], "source string, target_share double, size_tokens long, epochs double"
    )
    chance = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    whole = F.floor("epochs").cast("int")
    chosen = (
        sized.join(plan.select("source", "epochs"), "source")
        .withColumn("repeats", whole + F.when(chance < F.col("epochs") - whole, 1).otherwise(0))
        .where("repeats > 0")
        .select("doc_id", "source", "n_tokens", "repeats")
    )
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"))
    shares = plan.join(used, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    everything = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over a row per target
    shares = shares.withColumn("_all", everything).select(
        "source", "target_share", "size_tokens", "epochs", "tokens", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0).alias("share")
    )
    return chosen, shares
