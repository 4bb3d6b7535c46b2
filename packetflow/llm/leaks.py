"""Evaluation passages in training documents (p7).

Greedy string tiling. Windows of SEED words of the passages are the shared-token seeds; a Karp-Rabin pass over each
document finds where they occur, seeds grow to maximal matches, and the longest match that does not overlap an earlier
one is marked again and again. Marked words of the passage, with gaps of a word or two between neighbouring tiles of the
same order, are its coverage; from COVERAGE on the document leaks the item. Because tiles are matched one by one,
passages whose sentences were put in another order are found as well.

Words of standard sentences are no one's own wording: windows that many passages share, or that more than a set share of
all texts carries (counted over the whole corpus first), are left out of coverage and of the words to be covered. Texts
count once however many documents repeat them, and a text that may carry a passage's share of own words is no evidence
against that passage's windows, so neither copies nor frequent leaks make a passage standard.

The passages are a stated query set; they are broadcast in blocks of bounded size. Each block reads the texts once; only
those in which a window was seen are kept and tiled. No text is shuffled and nothing is collected but the counts of
passage windows.

Results for odd input: null and empty texts leak nothing; texts are read whole, however long; passages without own
words cannot leak; an empty table on either side gives no rows; repeated rows give the same pair once.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from packetflow.llm.words import Hasher, words
from packetflow.session import cut_lineage

SEED, COVERAGE = 4, 0.25
#: A window is standard when at least this many passages or this share of the texts (and this many) carry it.
STANDARD_PASSAGES, STANDARD_SHARE, STANDARD_DOCUMENTS = 4, 0.005, 8
#: Words between two tiles that count as altered, not as missing.
BRIDGE_PASSAGE, BRIDGE_TEXT = 2, 4
BLOCK_ITEMS = 5_000


class Passages:
    """Word codes of a block of passages and an index of their seed windows."""

    def __init__(self, items: list[tuple[int, str]], hasher: Hasher):
        self.ids = [i for i, _ in items]
        self.codes = [hasher.codes(words(p)) for _, p in items]
        self.windows = [hasher.windows(c, SEED) for c in self.codes]
        at = [(n, k) for n, w in enumerate(self.windows) for k in range(len(w))]
        keys = np.concatenate(self.windows) if at else np.empty(0, np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.where = np.unique(keys), [at[i] for i in order]
        self.first = np.searchsorted(keys[order], self.keys, "left")
        self.last = np.searchsorted(keys[order], self.keys, "right")

    def hits(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of windows that are seeds, and which."""
        if not len(self.keys) or not len(windows):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        i = np.minimum(np.searchsorted(self.keys, windows), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[i] == windows)
        return found, i[found]

    def own(self, standard: np.ndarray) -> list[np.ndarray]:
        """Per passage, which words are its own: not inside a standard window."""
        out = []
        for codes, w in zip(self.codes, self.windows):
            mine = np.ones(len(codes), bool)
            for k in np.flatnonzero(np.isin(w, standard)):
                mine[k : k + SEED] = False
            out.append(mine)
        return out


def tiles(passage: np.ndarray, text: np.ndarray, seeds: list[tuple[int, int]], least: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in passage, start in text, length), longest first, none overlapping on either side."""
    heap, seen = [], set()
    for p, t in seeds:
        if (p, t) in seen:
            continue
        while p and t and passage[p - 1] == text[t - 1]:
            p, t = p - 1, t - 1
        n = 0
        while p + n < len(passage) and t + n < len(text) and passage[p + n] == text[t + n]:
            seen.add((p + n, t + n))
            n += 1
        heapq.heappush(heap, (-n, p, t))
    used_p, used_t = np.zeros(len(passage), bool), np.zeros(len(text), bool)
    found = []
    while heap:
        n, p, t = heapq.heappop(heap)
        free = ~(used_p[p : p - n] | used_t[t : t - n])
        if free.all():
            used_p[p : p - n] = used_t[t : t - n] = True
            found.append((p, t, -n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= least:
                heapq.heappush(heap, (-int(b - a), p + int(a), t + int(a)))
    return found


def coverage(found: list[tuple[int, int, int]], own: np.ndarray) -> float:
    """Share of a passage's own words inside tiles or in small gaps between tiles that follow each other in both."""
    total = int(own.sum())
    if not total:
        return 0.0
    covered = np.zeros(len(own), bool)
    last = None
    for p, t, n in sorted(found):
        covered[p : p + n] = True
        if last and 0 <= p - last[0] <= BRIDGE_PASSAGE and 0 <= t - last[1] <= BRIDGE_TEXT:
            covered[last[0] : p] = True
        last = (p + n, t + n)
    return float((covered & own).sum()) / total


def _may_leak(starts: set[int], own: np.ndarray, threshold: float) -> bool:
    """Whether seeds at these starts of a passage can come to the threshold of its own words."""
    reach = np.zeros(len(own), bool)
    for p in starts:
        reach[p : p + SEED] = True
    # Bridges add at most BRIDGE_PASSAGE words to each SEED words of tiles.
    return (reach & own).sum() * (1 + BRIDGE_PASSAGE / SEED) >= threshold * own.sum()


def shared_windows(passages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of so many different passages that they are standard, and those of several; passages of the same words are one."""
    hasher = Hasher()
    different = {c.tobytes(): np.unique(hasher.windows(c, SEED)) for c in (hasher.codes(words(p)) for p in passages)}
    keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *different.values()]), return_counts=True)
    return keys[n >= STANDARD_PASSAGES], keys[(n > 1) & (n < STANDARD_PASSAGES)]


def _sightings(documents: DataFrame, items, shared, threshold: float) -> DataFrame:
    """(doc_id, text, body, seen array<struct<key, stray>>): windows of a block's passages in each text, and whether none of
    these passages may leak there; text is a code of the words, body the text itself where anything was seen.

    What several passages share does not make a leak here, unless it is most of a passage.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        hasher = Hasher()
        index = Passages(items.value, hasher)
        standard, several = shared.value
        usual, signed = np.isin(index.keys, standard), index.keys.view(np.int64).tolist()
        own = [s if 2 * s.sum() >= o.sum() else o for o, s in zip(index.own(standard), index.own(np.concatenate([standard, several])))]
        for b in batches:
            names, bodies, seen = [], [], []
            for text in b.text:
                codes = hasher.read(text)
                names.append(xxhash.xxh64_intdigest(codes.tobytes()) - 2**63)
                _, which = index.hits(hasher.windows(codes, SEED))
                at = {k: index.where[index.first[k] : index.last[k]] for k in np.unique(which[~usual[which]]).tolist()}
                starts: dict[int, set[int]] = defaultdict(set)
                for places in at.values():
                    for n, p in places:
                        starts[n].add(p)
                leaked = {n for n, found in starts.items() if _may_leak(found, own[n], threshold)}
                seen.append([{"key": signed[k], "stray": not any(n in leaked for n, _ in places)} for k, places in at.items()])
                bodies.append(text if at else None)
            yield pd.DataFrame({"doc_id": b.doc_id, "text": names, "body": bodies, "seen": seen})

    return documents.select("doc_id", "text").filter("text <> ''").mapInPandas(run, "doc_id bigint, text bigint, body string, seen array<struct<key: bigint, stray: boolean>>")


def frequent_windows(sightings: list[DataFrame]) -> np.ndarray:
    """Windows that more than a set share of all different texts carries without leaking a passage."""
    if not sightings:
        return np.empty(0, np.uint64)
    n_texts = sightings[0].select("text").distinct().count()
    seen = None
    for part in sightings:
        part = part.select("text", F.explode("seen").alias("s")).select("text", "s.key", "s.stray")
        seen = part if seen is None else seen.unionByName(part)
    counts = seen.groupBy("text", "key").agg(F.bool_and("stray").alias("stray")).filter("stray").groupBy("key").agg(F.count("*").alias("n"))
    found = [r.key for r in counts.filter(F.col("n") >= max(STANDARD_DOCUMENTS, STANDARD_SHARE * n_texts)).collect()]  # windows of the passages
    return np.array(found, np.int64).view(np.uint64)


def _block_leaks(sightings: DataFrame, items, standard, threshold: float) -> DataFrame:
    """Tiling of the texts in which windows of the block were seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher()
        index = Passages(items.value, hasher)
        usual = np.isin(index.keys, standard.value)
        own = index.own(standard.value)
        for b in batches:
            out = []
            for doc_id, text in zip(b.doc_id, b.body):
                codes = hasher.read(text)
                at, which = index.hits(hasher.windows(codes, SEED))
                rare = ~usual[which]
                if not rare.any():
                    continue
                seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for t, k in zip(at[rare].tolist(), which[rare].tolist()):
                    for n, p in index.where[index.first[k] : index.last[k]]:
                        seeds[n].append((p, t))
                for n, found in seeds.items():
                    if not _may_leak({p for p, _ in found}, own[n], threshold):
                        continue
                    share = coverage(tiles(index.codes[n], codes, found), own[n])
                    if share >= threshold:
                        out.append((doc_id, index.ids[n], share))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "coverage"])

    return sightings.filter("body is not null").select("doc_id", "body").mapInPandas(run, "doc_id bigint, item_id int, coverage double")


def leaks(documents: DataFrame, eval_items: DataFrame, threshold: float = COVERAGE) -> DataFrame:
    """(doc_id, item_id, coverage): every document that carries a passage, in whole or in part."""
    rows = eval_items.filter("item_id is not null and passage <> ''").select("item_id", "passage").distinct().orderBy("item_id", "passage").toLocalIterator()
    passages = [(r.item_id, r.passage) for r in rows]
    context = documents.sparkSession.sparkContext
    blocks = [context.broadcast(passages[i : i + BLOCK_ITEMS]) for i in range(0, len(passages), BLOCK_ITEMS)]
    found = None
    if blocks:
        standard, several = shared_windows([p for _, p in passages])
        shared = context.broadcast((standard, several))
        # One pass over all texts for each block; what follows reads only texts in which something was seen.
        sightings = [cut_lineage(_sightings(documents, items, shared, threshold)) for items in blocks]
        usual = context.broadcast(np.concatenate([standard, frequent_windows(sightings)]))
        for items, seen in zip(blocks, sightings):
            part = _block_leaks(seen, items, usual, threshold)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id int, coverage double")
    return found.groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage"))


def found_leaks(documents: DataFrame, eval_items: DataFrame) -> DataFrame:
    return leaks(documents, eval_items).select("doc_id", "item_id")
