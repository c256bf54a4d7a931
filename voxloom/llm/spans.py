"""Problem 9: long spans that stand word for word in more than one record.

Tokens are characters; a span counts from `min_chars` tokens on.  Three steps:

1. Anchors. Of every window of min_chars tokens the k-mer with the least hash is kept, so
   equal spans keep equal k-mers; about one position in 17 is. A count by hash tells the
   repeated ones, and only texts that hold one go on.
2. De Bruijn edges. Around repeated anchors every min_chars-mer is an edge between its
   first and last (min_chars-1)-mer. One aggregate by edge tells the edges of several
   records and whether all occurrences come from one edge before; a join with that edge
   tells whether the path branches between them. Repeated nonbranching paths compact to
   one unitig: in each record, the run of edges since the last one that starts a path.
3. Verification. The source coordinates of each unitig occurrence are cut out of the text
   itself, and occurrences count as the same span only if those characters are equal.

Nothing is paired before verification, and a unitig in a third of all records is only ever
aggregated, never gathered: keys that hot are joined where their rows are. Pairs of the
records of one span are made block against block, so that no task has more than
PAIR_BLOCK records a side. Null texts and texts under min_chars share nothing; rows of
one doc_id are one record; a null doc_id is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.base import join_counted
from voxloom.sources.scratch import Scratch

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Characters hashed at a time; a longer text still is one piece.
CHUNK_CHARS = 1 << 20
#: Records of a span that one task pairs with as many others.
PAIR_BLOCK = 2000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive tokens, by joining hashes of doubled lengths."""
    if len(codes) < k:
        return np.empty(0, np.uint64)
    power = _mixed(codes.astype(np.uint64) + np.uint64(1))
    out, have, length = None, 0, 1
    with np.errstate(over="ignore"):
        while True:
            if k & length:
                if out is None:
                    out, have = power, length
                else:
                    n = len(codes) - have - length + 1
                    out = out[:n] * np.uint64(pow(_BASE, length, 1 << 64)) + power[have : have + n]
                    have += length
            if have == k:
                return _mixed(out)
            power = power[:-length] * np.uint64(pow(_BASE, length, 1 << 64)) + power[length:]
            length *= 2


def _sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every w consecutive values, by doubling."""
    have = 1
    while have * 2 <= w:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[: len(x) - (w - have)], x[w - have :]) if have < w else x


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array, and where each begins (with the end last)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.cumsum([0, *map(len, texts)])


def anchors(codes: np.ndarray, starts: np.ndarray, k: int, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, position in the joined array and hash of each kept k-mer."""
    w = min_chars - k + 1
    h = window_hashes(codes, k)
    if len(h) < w:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    least = _sliding(h, w, np.minimum)
    text_of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    whole = text_of[: len(least)] == text_of[min_chars - 1 :]  # the window lies within one text
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(least)] = np.where(whole, least, np.uint64(0))
    at = np.flatnonzero(h == _sliding(padded, w, np.maximum))
    at = at[h[at] != 0]
    return text_of[at], at, h[at]


def _chunks(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK_CHARS):
            n += len(texts[j])
            j += 1
        yield ids[i:j], texts[i:j]
        i = j


def _anchor_rows(k: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _chunks(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                codes, starts = _joined(texts)
                text, _, h = anchors(codes, starts, k, min_chars)
                both = np.unique(np.stack([h.view(np.int64), text.astype(np.int64)]), axis=1) if len(h) else np.empty((2, 0), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(np.asarray(ids, np.int64)[both[1]])], names=["h", "doc_id"])

    return run


def _edge_rows(k: int, min_chars: int):
    """Edges around the repeated anchors of each text, with the edge before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[np.ndarray, ...]] = []
            size = 0
            for doc, text, keep in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "anchors"))):
                codes, starts = _joined([text])
                _, at, h = anchors(codes, starts, k, min_chars)
                at = at[np.isin(h.view(np.int64), np.asarray(keep, np.int64))]
                edges = window_hashes(codes, min_chars).view(np.int64)
                near = np.zeros(len(edges) + 1, np.int32)
                np.add.at(near, np.maximum(at - (min_chars - k), 0), 1)
                np.add.at(near, np.minimum(at + 1, len(edges)), -1)
                pos = np.flatnonzero(np.cumsum(near[:-1]) > 0)
                before = np.where(pos > 0, edges[np.maximum(pos - 1, 0)], 0)
                out.append((np.full(len(pos), doc, np.int64), pos.astype(np.int32), edges[pos], before))
                size += len(pos)
                if size > CHUNK_CHARS:
                    yield _edge_batch(out)
                    out, size = [], 0
            yield _edge_batch(out)

    return run


def _edge_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, t) for t in (np.int64, np.int32, np.int64, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc_id", "pos", "e", "before"])


def shared_spans(docs: DataFrame, min_chars: int = 64, k: int = 32) -> DataFrame:
    """Occurrences of repeated unitigs: `doc_id, start, n_chars, span_id, span`.

    docs: `doc_id BIGINT, text STRING`. `span_id` is equal for equal spans only; every
    span of at least min_chars that two records share is covered by equal occurrences.
    """
    if not 0 < k <= min_chars:
        raise ValueError("anchors must not be longer than spans")
    scratch = Scratch(docs.sparkSession)
    texts = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars)).select("doc_id", "text")
    kept = scratch.save(texts.mapInArrow(_anchor_rows(k, min_chars), "h long, doc_id long"), "anchors")
    repeated = scratch.save(kept.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "repeated")
    held = join_counted(kept, repeated, ["h"], kept.count())
    by_doc = held.groupBy("doc_id").agg(F.collect_set("h").alias("anchors"))
    candidates = scratch.save(texts.join(by_doc, "doc_id"), "candidates")
    scratch.drop("anchors")

    edges = scratch.save(candidates.mapInArrow(_edge_rows(k, min_chars), "doc_id long, pos int, e long, before long"), "edges")
    nodes = edges.groupBy("e").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.min("before").alias("b"), F.max("before").alias("b2"))
    nodes = scratch.save(nodes.where("lo <> hi").select("e", "n", F.when(F.col("b") == F.col("b2"), F.col("b")).alias("b")), "nodes")
    ahead = nodes.select(F.col("e").alias("b"), F.col("n").alias("bn"))
    paths = nodes.join(ahead, "b", "left").select("e", "n", F.expr("coalesce(bn <> n, true)").alias("begins"))
    paths = scratch.save(paths, "paths")
    found = join_counted(edges.select("doc_id", "pos", "e"), paths, ["e"], edges.count())
    run = Window.partitionBy("doc_id").orderBy("pos")
    found = found.withColumn("begins", F.col("begins") | F.coalesce(F.lag("pos").over(run) != F.col("pos") - 1, F.lit(True)))
    found = found.withColumn("at", F.max(F.when(F.col("begins"), F.col("pos"))).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    unitigs = found.groupBy("doc_id", "at").agg((F.count("*") + (min_chars - 1)).cast("int").alias("n_chars"), F.min_by("e", "pos").alias("head"))
    cut = scratch.save(unitigs.join(candidates.select("doc_id", "text"), "doc_id").select("doc_id", F.col("at").alias("start"), "n_chars", "head", F.expr("substring(text, at + 1, n_chars)").alias("span")), "cut")
    for name in ("repeated", "candidates", "edges", "nodes", "paths"):
        scratch.drop(name)
    verified = cut.groupBy("head", "span").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    verified = verified.where("lo <> hi").select("head", "span", "n", F.xxhash64(F.lit(0), "span").alias("span_id"))
    verified = scratch.save(verified, "verified")
    return join_counted(cut, verified, ["head", "span"], cut.count()).select("doc_id", "start", "n_chars", "span_id", "span")


def sharing_pairs(spans: DataFrame) -> DataFrame:
    """`doc_a, doc_b`: pairs of records with a span in common; spans are compared by their characters.

    The records of a span are split into blocks of about PAIR_BLOCK, and every two blocks
    meet in a group of their own.
    """
    scratch = Scratch(spans.sparkSession)
    held = scratch.save(spans.select("doc_id", "span_id", "span").distinct(), "held")
    sizes = scratch.save(held.groupBy("span_id", "span").agg(F.count("*").alias("n")), "sizes")
    blocks = F.ceil(F.col("n") / PAIR_BLOCK)
    mine = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    held = join_counted(held, sizes, ["span_id", "span"], held.count()).withColumn("blocks", blocks).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    met = held.select("doc_id", "span_id", "span", "mine", other)
    met = met.select("doc_id", "span_id", "span", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    a, b = met.alias("a"), met.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("span_id", "low", "high", "span")]
    # two records of one block meet in the group of that block only
    apart = (F.col("a.mine") != F.col("b.mine")) | (F.col("a.low") == F.col("a.high"))
    pairs = a.join(b, same[0] & same[1] & same[2] & same[3] & apart & (F.col("a.doc_id") < F.col("b.doc_id")))
    return pairs.select(F.col("a.doc_id").alias("doc_a"), F.col("b.doc_id").alias("doc_b")).distinct()


def shared_parts(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """`doc_id, n_chars, shared_chars, shared_share, passages`: every record, and how much of it stands elsewhere.

    Overlapping occurrences are merged to passages (start, length). A record with null
    text has null counts.
    """
    run = Window.partitionBy("doc_id").orderBy("start", "n_chars")
    ends = spans.select("doc_id", "start", "n_chars").distinct().withColumn("end", F.col("start") + F.col("n_chars"))
    ends = ends.withColumn("reach", F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1)))
    ends = ends.withColumn("part", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(run))
    parts = ends.groupBy("doc_id", "part").agg(F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"))
    parts = parts.groupBy("doc_id").agg(F.sum("length").alias("shared"), F.array_sort(F.collect_list(F.struct("start", "length"))).alias("passages"))
    sized = docs.select("doc_id", F.length("text").alias("n_chars"))
    return sized.join(parts, "doc_id", "left").select(
        "doc_id",
        "n_chars",
        F.when(F.col("n_chars").isNotNull(), F.coalesce("shared", F.lit(0))).cast("long").alias("shared_chars"),
        F.when(F.col("n_chars") > 0, F.coalesce("shared", F.lit(0)) / F.col("n_chars")).alias("shared_share"),
        F.coalesce("passages", F.array().cast("array<struct<start:int,length:int>>")).alias("passages"),
    )
