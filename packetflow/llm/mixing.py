"""Mixing sources to target weights (p8).

Tokens are counted once per document with a public tokenizer; shares are set by capped water-filling: a source whose
target needs more than max_repeats passes over its documents is clamped there and the weight it cannot carry goes to the
others in proportion to theirs, until nothing exceeds its cap. Every document is then taken floor(passes) times and, for
the fraction, once more when the seeded hash of its id falls below the source's cut; the cut is set so that the tokens
taken meet the target to within one hash bucket. Only per-source totals and cuts reach the driver.

Results for odd input: spellings of a source that differ in case, spaces or hyphens are one source; documents of a null or
unlisted source are in no mixture (copies 0); empty and null texts have 0 tokens; a listed source without documents is
reported with share 0; when all sources are clamped the mixture is smaller than asked for; repeated document ids are
treated alike; an empty documents table gives a report of zeros.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from packetflow.session import cut_lineage

SEED, BUCKETS = 20, 65_536


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def source_name(c: Column) -> Column:
    """One spelling per source."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s_-]+|[\s_-]+$", ""), r"[\s_-]+", "_")


def token_counts(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens bigint) of whole texts under the vocabulary file (ranks of a byte-level BPE)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            b["n_tokens"] = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.text]
            yield b[["doc_id", "source", "n_tokens"]]

    return documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").mapInPandas(run, "doc_id bigint, source string, n_tokens bigint")


def water_fill(tokens: dict[str, float], shares: dict[str, float], most: dict[str, float], total: float) -> dict[str, float]:
    """Tokens each source is to give: proportional to its share, none above most passes over its own tokens."""
    cap = {s: max(0.0, tokens.get(s, 0.0) * most[s]) for s in shares}
    give, open_ = {}, {s for s in shares if shares[s] > 0}
    give |= {s: 0.0 for s in shares if s not in open_}
    left = total
    while open_:
        weight = math.fsum(shares[s] for s in open_)
        over = sorted(s for s in open_ if left * shares[s] / weight > cap[s])
        if not over:
            give |= {s: left * shares[s] / weight for s in open_}
            break
        for s in over:
            give[s] = cap[s]
            open_.remove(s)
        left = total - math.fsum(give.values())
    return give


def _weights(source_weights: DataFrame) -> dict[str, tuple[float, float]]:
    """source -> (share, repeats); the table is one row per source and checked to be small."""
    rows = source_weights.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10,000 sources")
    return {r.s: (r.target_share or 0.0, r.max_repeats or 0) for r in rows if r.s}


def mixture(documents: DataFrame, source_weights: DataFrame, total: float | None = None, seed: int = SEED, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, n_tokens, copies int) of every document, and the report of shares; total: tokens wanted, by default those of the listed sources once."""
    spark = documents.sparkSession
    weights = _weights(source_weights)
    bucket = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(BUCKETS)).cast("int")
    counted = cut_lineage(token_counts(documents, vocabulary).withColumn("bucket", bucket))
    listed = counted.filter(F.col("source").isin(*weights)) if weights else counted.limit(0)
    per_bucket = listed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
    totals = {r.source: (r.n, r.docs) for r in per_bucket.groupBy("source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    tokens = {s: float(n) for s, (n, _) in totals.items()}
    give = water_fill(tokens, {s: w for s, (w, _) in weights.items()}, {s: m for s, (_, m) in weights.items()}, total if total is not None else math.fsum(tokens.values()))
    passes = {s: give[s] / tokens[s] if tokens.get(s) else 0.0 for s in weights}
    whole = {s: min(math.floor(p + 1e-9), weights[s][1]) for s, p in passes.items()}
    rest = {s: max(0.0, give[s] - whole[s] * tokens.get(s, 0.0)) if whole[s] < weights[s][1] else 0.0 for s in weights}

    cuts: dict[str, int] = {}
    if rest and tokens:
        need = spark.createDataFrame([(s, float(r)) for s, r in rest.items()], "source string, need double")
        upto = F.sum("n").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        reached = per_bucket.join(need, "source").withColumn("upto", upto).filter(F.col("upto") <= F.col("need"))
        cuts = {r.source: r.cut for r in reached.groupBy("source").agg(F.max("bucket").alias("cut")).collect()}
    pick = lambda values, default: F.coalesce(*[F.when(F.col("source") == s, F.lit(v)) for s, v in values.items()], F.lit(default)) if values else F.lit(default)
    extra = F.when(F.col("bucket") <= pick({s: int(c) for s, c in cuts.items() if rest[s] > 0}, -1), 1).otherwise(0)
    taken = counted.select("doc_id", "source", "n_tokens", (pick({s: int(w) for s, w in whole.items()}, 0) + F.when(pick({s: 1 for s in weights}, 0) == 1, extra).otherwise(0)).cast("int").alias("copies"))

    reached = taken.filter("copies > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    plan = spark.createDataFrame(
        [(s, float(w), int(m), int(totals.get(s, (0, 0))[0]), int(totals.get(s, (0, 0))[1]), float(passes[s]), bool(give[s] >= m * tokens.get(s, 0.0) - 1e-6)) for s, (w, m) in sorted(weights.items())],
        "source string, target_share double, max_repeats int, source_tokens bigint, documents bigint, passes double, capped boolean",
    )
    report = plan.join(reached, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    all_tokens = report.agg(F.sum("mixed_tokens").alias("all_tokens"))
    # One row per listed source beside one row of their total.
    report = report.join(F.broadcast(all_tokens), F.lit(True)).withColumn("reached_share", F.coalesce(F.try_divide("mixed_tokens", "all_tokens"), F.lit(0.0))).drop("all_tokens")
    return taken, report
