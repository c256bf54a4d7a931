"""Problem 7: texts packed whole into containers of fixed capacity, in the corpus' mixture.

Every source is a queue, in order of a hash. The queues are cut into buckets of bounded
size so that each bucket gets the same share of every queue, to within one text: running
token sums by source, at two levels, are the deficits carried over the buckets. Buckets
are packed independently. For every window of containers, deficit round-robin credits each
queue with its share of the window and takes texts from its head while the credit covers
half of the next one, so deficits are signed and carried from window to window, and
scarce sources last to the end of the bucket. The window's texts are packed best-fit
decreasing; texts of containers left too empty go back to their queues and are owed again.
The last window of a bucket is not packed: it joins those of the neighbours in a bucket of
the next level, level by level, so only the very last window takes what is left.

A text over the capacity is cut into full containers and a rest.  Null and empty texts
take no room and are assigned to no container. Rows of one doc_id count once; an empty
table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.sources.scratch import Scratch

#: Tokens of a bucket: what one task packs in memory. Containers of a window, and how full one must be to be closed early.
BUCKET_TOKENS, WINDOW, CLOSED = 4_000_000, 256, 0.995
#: Buckets whose last windows are packed together at the next level: about as much as one bucket.
FAN_IN = 8
#: Texts of a source whose sizes are summed by one task.
BLOCK_TEXTS = 50_000

PACKED = "bucket long, container int, win int, position int, doc_id long, piece int, source string, tokens long"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers of indices into sizes: largest first, each where the least room is left."""
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(rooms, (sizes[i], -1))
        if at == len(rooms):
            rooms_left, c = capacity, len(out)
            out.append([])
        else:
            rooms_left, c = rooms.pop(at)
        out[c].append(i)
        insort(rooms, (rooms_left - sizes[i], c))
    return out


def pack(items: list[tuple], capacity: int, last: bool, containers: int = WINDOW) -> tuple[list[list[tuple[int, tuple]]], list[tuple]]:
    """Closed containers, each a list of (window, item), and the items left over.

    items: (doc_id, piece, source, tokens), in queue order; containers: those of a window.
    """
    queues: dict[str, deque] = {}
    for x in items:
        queues.setdefault(x[2], deque()).append(x)
    whole = {s: sum(x[3] for x in q) for s, q in sorted(queues.items())}
    windows = max(1, round(sum(whole.values()) / (containers * capacity)))
    got = dict.fromkeys(whole, 0)
    closed: list[list[tuple[int, tuple]]] = []
    for window in range(windows):
        over = window == windows - 1
        if over and not last:
            break
        taken: list[tuple] = []
        for s, q in queues.items():
            owed = whole[s] * (window + 1) / windows
            while q and (over or owed - got[s] >= q[0][3] / 2):
                got[s] += q[0][3]
                taken.append(q.popleft())
        boxes = best_fit([x[3] for x in taken], capacity)
        full = boxes if over else [b for b in boxes if sum(taken[i][3] for i in b) >= CLOSED * capacity]
        kept = {i for b in full for i in b}
        closed += [[(window, taken[i]) for i in b] for b in full]
        for i in range(len(taken) - 1, -1, -1):
            if i not in kept:
                queues[taken[i][2]].appendleft(taken[i])
                got[taken[i][2]] -= taken[i][3]
    return closed, [x for q in queues.values() for x in q]


def _bucketed(items: DataFrame, totals: dict[str, int], n: int, buckets: int) -> DataFrame:
    """Adds `bucket`: each gets 1/buckets of every source's tokens, to within one text."""
    blocks = max(1, -(-n // BLOCK_TEXTS))
    at = items.withColumn("o", F.xxhash64("doc_id", "piece"))
    at = at.withColumn("block", F.least(F.floor((F.col("o") / float(1 << 64) + 0.5) * blocks), F.lit(blocks - 1)))
    sums = at.groupBy(F.coalesce("source", F.lit("")).alias("s"), F.col("block").alias("b")).agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"))
    inside = F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("o", "doc_id", "piece").rowsBetween(Window.unboundedPreceding, 0))
    met = at.withColumn("run", inside).join(sums, (F.coalesce("source", F.lit("")) == F.col("s")) & (F.col("block") == F.col("b")))
    whole = F.create_map(*[F.lit(x) for s, t in totals.items() for x in (s, t)])  # a row per source
    middle = F.col("run") + F.col("ahead") - F.col("tokens") / 2
    bucket = F.least(F.floor(middle / whole[F.col("s")] * buckets), F.lit(buckets - 1))
    return met.select("doc_id", "piece", "source", "tokens", bucket.alias("bucket"))


def _level(items: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Pack `bucket, doc_id, piece, source, tokens`; rows with a null container are left over."""

    containers = WINDOW

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["o", "doc_id", "piece"])
        pool = list(zip(rows.doc_id.tolist(), rows.piece.tolist(), rows.source.fillna("").tolist(), rows.tokens.tolist()))
        closed, rest = pack(pool, capacity, last, containers)
        out = [(key[0], c, w, p, x[0], x[1], x[2] or None, x[3]) for c, box in enumerate(closed) for p, (w, x) in enumerate(box)]
        out += [(key[0], None, None, None, x[0], x[1], x[2] or None, x[3]) for x in rest]
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in PACKED.split(", ")])
        return frame.astype({"container": "Int32", "win": "Int32", "position": "Int32"})

    return items.withColumn("o", F.xxhash64("doc_id", "piece")).groupBy("bucket").applyInPandas(run, PACKED)


def pack_texts(sized: DataFrame, capacity: int) -> DataFrame:
    """`container_id, window_id, position, doc_id, piece, piece_start, source, tokens` for `doc_id, source, tokens`."""
    scratch = Scratch(sized.sparkSession)
    sized = scratch.save(sized.where("tokens > 0").select("doc_id", "source", "tokens"), "sized")
    seen = sized.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum("tokens").alias("t"), F.sum(F.ceil(F.col("tokens") / capacity)).alias("n"))
    totals = {r.s: (r.t, r.n) for r in seen.collect()}  # a row per source
    buckets = max(1, -(-sum(t for t, _ in totals.values()) // BUCKET_TOKENS))
    n = F.ceil(F.col("tokens") / capacity)
    pieces = sized.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    size = F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * capacity).cast("long")
    pieces = pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), "source", size.alias("tokens"))
    if buckets == 1:
        rest = pieces.withColumn("bucket", F.lit(0).cast("long"))
    else:
        rest = _bucketed(pieces, {s: t for s, (t, _) in totals.items()}, sum(k for _, k in totals.values()), buckets)
    levels = []
    level = 0
    while True:
        packed = scratch.save(_level(rest, capacity, buckets == 1), f"level-{level}")
        levels.append(packed.where("container is not null").withColumn("level", F.lit(level)))
        if buckets == 1:
            break
        buckets = -(-buckets // FAN_IN)
        rest = packed.where("container is null").select("doc_id", "piece", "source", "tokens", F.floor(F.col("bucket") / FAN_IN).alias("bucket"))
        level += 1
    scratch.drop("sized")
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.select(
        F.concat_ws("-", "level", "bucket", "container").alias("container_id"),
        F.concat_ws("-", "level", "bucket", "win").alias("window_id"),
        "position",
        "doc_id",
        "piece",
        (F.col("piece").cast("long") * capacity).alias("piece_start"),
        "source",
        "tokens",
    )


def window_report(packed: DataFrame) -> DataFrame:
    """`window_id, source, tokens, share, target_share, window_deviation`: what each window holds of each source.

    The target is the source's share of all packed tokens; the deviation of a window is
    half the sum of the differences of all shares, those of sources it lacks included.
    """
    held = packed.groupBy("window_id", "source").agg(F.sum("tokens").alias("tokens"))
    all_of = packed.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.sum("tokens").alias("t"))
    target = all_of.select("s", (F.col("t") / F.sum("t").over(Window.partitionBy(F.lit(0)))).alias("target_share"))  # a row per source
    window = Window.partitionBy("window_id")
    met = held.withColumn("share", F.col("tokens") / F.sum("tokens").over(window)).join(F.broadcast(target), F.coalesce("source", F.lit("")) == F.col("s"))
    off = F.sum(F.abs(F.col("share") - F.col("target_share"))).over(window) + 1 - F.sum("target_share").over(window)
    return met.select("window_id", "source", "tokens", "share", "target_share", (off / 2).alias("window_deviation"))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least number of containers possible, and the share of room left empty."""
    boxes = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    t, c = F.coalesce(F.sum("t"), F.lit(0)), F.count("*")
    return boxes.agg(
        c.alias("containers"), t.alias("tokens"), F.ceil(t / capacity).alias("least_containers"), (1 - t / (c * capacity)).alias("empty_share"),
        F.max("t").alias("fullest"), F.coalesce(F.sum("n"), F.lit(0)).alias("pieces"),
    )
