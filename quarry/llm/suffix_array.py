"""Suffix-array dedup: removal of byte strings that already start in an earlier document, by prefix doubling.

Positions are ranked by the first bytes that follow them; at each step the pair (rank at p, rank at p + offset) gives
the rank by twice as many bytes; positions whose rank is unique are dropped, as no longer string from there repeats,
and the steps end once the threshold of WINDOW bytes is reached: equal ranks then are equal strings, and those after the
one in the smallest document go. Spark deals the positions into ranges of their rank, which the tasks sort; the first
range sort is by GRAM bytes and holds sampled positions only, chosen so that every string of WINDOW bytes has one at
a place that its bytes alone decide (see `repeats`), for sorting every position of a corpus at every step would write
several times the corpus to disk at each.

`doubled` is the plain form on all positions, with a Spark sort by key at each offset. Its results are the same (tests hold
them against each other), but it shuffles 50 bytes for each byte of text (README), so it is for small tables.

Null and empty texts have nothing to remove; a text shorter than WINDOW bytes loses nothing; rows that share a doc_id,
or lack one, are documents in the order of (doc_id, null first, then text). A very long text is hashed in one task; in a run
of one byte, whose positions all tie, the contexts that are equal are compared once. Other columns aren't read. An empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import repeats
from quarry.llm.common import store
from quarry.llm.words import PLACE, mix

WINDOW, GRAM = 50, 24
SPEC = repeats.Spec("bytes", WINDOW, GRAM, earlier=True)


def doubling(data: np.ndarray, at: np.ndarray, length: int, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (indices into `at`) whose `length` bytes, with the same group, start at another place too, and their ranks.

    data: bytes; at: starts, each with `length` bytes after it.
    """
    n = len(data)
    rank = np.zeros(n + 8, np.uint64)
    for k in range(8):  # the first eight bytes are their own rank
        rank[: n - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    rank, known, left = mix(rank[:n]), 8, np.arange(len(at))
    at = at.copy()
    while True:
        offset = min(known, length - known)
        if offset:
            paired = rank * PLACE[0]
            paired[: n - offset] += rank[offset:]
            rank, known = mix(paired), known + offset
        own = mix(rank[at] + group)
        order = np.argsort(own, kind="stable")
        s = own[order]
        same = s[1:] == s[:-1]
        twin = np.zeros(len(s), bool)
        twin[1:] |= same
        twin[:-1] |= same
        keep = order[twin]
        left, at, group = left[keep], at[keep], group[keep]
        if known >= length or not len(left):
            return left, (own[keep] if len(left) else np.zeros(0, np.uint64))


def refine(spec, h, doc, start, size, known, lead, raw):
    """Intervals of the contexts' windows that also start in a smaller document."""
    base = np.cumsum(size) - size
    count = np.maximum(0, np.minimum(size - spec.window, lead) - np.maximum(0, lead + spec.gram - spec.window) + 1)
    low = np.maximum(0, lead + spec.gram - spec.window)
    which = np.repeat(np.arange(len(size)), count)
    place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    # windows that meet have the anchor at the same place
    group = mix(h[which] * PLACE[3] + (lead[which] - place).astype(np.uint64))
    left, rank = doubling(raw, base[which] + place, spec.window, group)
    if not len(left):
        return (np.zeros(0, np.int64),) * 3
    owner = doc[which[left]]
    order = np.lexsort((owner, rank))
    new = np.diff(rank[order], prepend=~rank[order][:1]) != 0
    least = owner[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    gone = np.sort(left[order][owner[order] > least])
    if not len(gone):
        return (np.zeros(0, np.int64),) * 3
    # runs of windows of one context are one interval
    cut = np.flatnonzero((np.diff(gone, prepend=-2) != 1) | (np.diff(which[gone], prepend=-1) != 0))
    a, b = gone[cut], gone[np.append(cut[1:], len(gone)) - 1]
    w = which[a]
    return doc[w], start[w] + place[a], start[w] + place[b] + spec.window


def doubled(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """(doc_id, place) of every place whose `length` bytes also start at another place: prefix doubling of all positions.

    Ranks are names of byte strings, first of 8 bytes. At each offset positions meet the rank at their place plus the offset,
    the pairs are sorted by Spark and named anew, and those whose pair is unique are dropped. A position whose partner was
    dropped goes with it.
    """
    names = ["doc_id", "place", "rank"]

    def start(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
                n = max(0, len(data) - 7)
                rank = np.zeros(n, np.uint64)
                for k in range(8):
                    rank |= data[k : k + n].astype(np.uint64) << np.uint64(8 * k)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(rank.view(np.int64))], names=names)

    def survivors(df: DataFrame) -> DataFrame:
        twice = df.groupBy("rank").count().filter("count > 1").select("rank")
        return store(df.join(twice, "rank", "left_semi").select(*names), "ranks")

    ranked, known = survivors(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(start, "doc_id long, place int, rank long")), 8
    while known < length:
        offset = min(known, length - known)
        after = ranked.select("doc_id", (F.col("place") - offset).alias("place"), F.col("rank").alias("next"))
        pairs = ranked.join(after, ["doc_id", "place"]).select("doc_id", "place", F.xxhash64("rank", "next").alias("rank"))
        ranked, known = survivors(pairs), known + offset
    return ranked.select("doc_id", "place")


def _result(doc, data, gone, _):
    runs = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
    kept = data[~gone].tobytes()
    return doc, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept


def dedup(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `keep`, the remaining bytes."""
    d, names, buckets = repeats.keyed(docs)
    found = repeats.find(d, SPEC, buckets, refine)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")
    return repeats.named(repeats.finish(found, SPEC, _result, schema), names)
