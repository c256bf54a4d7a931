"""Problem 1: items over a limit, cut into overlapping pieces at natural boundaries.

Lengths are code points.  A piece other than the first repeats the last `overlap`
characters of the piece before it, and counts them towards the limit.  Boundaries are, in
order of preference, the ends of lines and sentences, then of clauses and words, then any
character; the lower kinds are offered only inside a stretch that no piece could span
otherwise, so a piece ends at a line or sentence wherever there is one within reach.

Dynamic programming over the boundaries of the whole item finds the cuts of least penalty
and size imbalance. An item of up to SEGMENT_CHARS characters is one row. A longer scene
stands in segments that end at line ends, and the same optimum is found in parallel: the
only thing that one segment tells the next is where the last cut before its end is, and
that is one of the few boundaries (ports) within a piece's reach of it. Each segment gives
the least cost from every port before it to every port at its end; such matrices compose
by (min, +), FAN_IN at a time, level by level; then the ports of the best path are handed
down the levels, and each segment cuts itself between its two.

Null texts and items within the limit give no piece but themselves: null gives none, the
empty text one empty piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.sources.scratch import Scratch

#: Costs of a cut. Squared relative deviation from the even size is added; it is below 1 for a piece.
LINE_COST, SENTENCE_COST, CLAUSE_COST, CHARACTER_COST = 0.0, 0.25, 1e3, 1e6
NATURAL = re.compile(r"[。！？…；」』]+\n?|\n")
CLAUSE = re.compile(r"[，、：,.;:!?）)】》\s]+")
#: Characters that must stay with the one before them.
JOINED = re.compile("[\u0300-\u036f\u200c\u200d\u20d0-\u20ff\u3099\u309a\ufe00-\ufe0f\U000e0100-\U000e01ef]")
#: A longer scene stands in segments of about this many characters, each a bounded value in one row.
SEGMENT_CHARS = 200_000
#: Matrices that are composed by one task.
FAN_IN = 32
#: Lines of a scene that are summed together before the running offsets are.
BLOCK_LINES = 4096

PIECES = "item_kind string, item_id string, segment long, piece_index int, start long, end long, overlap int, cut string, longest_unbroken int, text string"


def longest_unbroken(text: str) -> int:
    """Length of the longest stretch without an end of a line or sentence."""
    last, most = 0, 0
    for m in NATURAL.finditer(text):
        most, last = max(most, m.start() - last), m.end()
    return max(most, len(text) - last)


def choices(text: str, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a piece may end, and what each costs."""
    ends = [(m.end(), LINE_COST if m[0][-1] == "\n" else SENTENCE_COST) for m in NATURAL.finditer(text)]
    if not ends or ends[-1][0] != len(text):
        ends.append((len(text), LINE_COST))
    out: list[tuple[int, float]] = []
    last = 0
    for end, cost in ends:
        if end - last > reach:
            inner = [(m.end(), CLAUSE_COST) for m in CLAUSE.finditer(text, last, end) if m.end() < end]
            at = last
            for stop, price in [*inner, (end, cost)]:
                if stop - at > reach:
                    marks = {m.start() for m in JOINED.finditer(text, at, stop)}
                    free = [p for p in range(at + 1, stop) if p not in marks]
                    # a run of marks longer than a piece leaves a hole: there any position will do
                    holes = [(x, y) for x, y in zip([at, *free], [*free, stop]) if y - x > reach] if marks else []
                    out += sorted([(p, CHARACTER_COST) for p in free] + [(p, CHARACTER_COST) for x, y in holes for p in range(x + 1, y)])
                out.append((stop, price))
                at = stop
        else:
            out.append((end, cost))
        last = end
    return np.array([p for p, _ in out], np.int64), np.array([c for _, c in out])


def _forward(at: np.ndarray, cost: np.ndarray, entries: np.ndarray, allowed: int, reach: int, even: float) -> tuple[np.ndarray, np.ndarray]:
    """Least cost of a path from each entry to each choice, and the choice before on it (-1: the entry itself)."""
    m, width = len(at), len(entries)
    direct = at[:, None] - entries[None, :]
    best = np.where(direct <= allowed, ((direct - even) / even) ** 2, np.inf)
    back = np.full((m, width), -1, np.int64)
    low = np.searchsorted(at, at - reach)
    for j in range(m):
        i = low[j]
        if i < j:
            ways = best[i:j] + (((at[j] - at[i:j] - even) / even) ** 2)[:, None]
            k = ways.argmin(axis=0)
            found = ways[k, np.arange(width)]
            better = found < best[j]
            best[j, better], back[j, better] = found[better], k[better] + i
        best[j] += cost[j]
    return best, back


def _path(back: np.ndarray, j: int, entry: int = 0) -> list[int]:
    out = []
    while j >= 0:
        out.append(j)
        j = int(back[j, entry])
    return out[::-1]


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, float]]:
    """Ends of the pieces and the cost of each cut; the first piece may be `limit` long, the others `limit - overlap`."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n, reach = len(text), limit - overlap
    if n <= limit:
        return [(n, LINE_COST)]
    at, cost = choices(text, reach)
    cost[-1] = LINE_COST
    _, back = _forward(at, cost, np.zeros(1, np.int64), limit, reach, n / -(-n // reach))
    return [(int(at[j]), float(cost[j])) for j in _path(back, len(at) - 1)]


def _name(cost: float) -> str:
    return "line" if cost == LINE_COST else "sentence" if cost == SENTENCE_COST else "clause" if cost == CLAUSE_COST else "character"


def split_items(items: DataFrame, limit: int, overlap: int) -> DataFrame:
    """Pieces of `item_kind, item_id, text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for kind, item, text in zip(*(batch.column(c).to_pylist() for c in ("item_kind", "item_id", "text"))):
                unbroken, last = longest_unbroken(text), 0
                for k, (end, cost) in enumerate(cuts(text, limit, overlap)):
                    start = max(0, last - overlap)
                    rows.append((kind, item, 0, k, last, end, last - start, _name(cost), unbroken, text[start:end]))
                    last = end
                if len(rows) >= 2000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return items.select("item_kind", "item_id", "text").mapInArrow(run, PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * 10
    types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in PIECES.split(", ")])


def scene_sizes(lines: DataFrame, at_least: int) -> DataFrame:
    """`item_id, total` of scenes whose lines, each with a line break, are over `at_least + 1` characters long."""
    kept = lines.where("item_id is not null and text is not null")
    return kept.groupBy("item_id").agg(F.sum(F.length("text").cast("long") + 1).alias("total")).where(F.col("total") - 1 > at_least)


def scene_segments(lines: DataFrame, totals: DataFrame, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """`item_id, total, segment, base, text`: the lines of scenes, joined by line breaks into bounded segments that end at line ends.

    lines: `item_id, pos, text`; a null position comes first.  Offsets are running sums at
    two levels, over blocks of lines and within a block, so a scene with a third of all
    lines is summed in parallel and never gathered into one task.
    """
    sized = lines.where("item_id is not null and text is not null").select("item_id", F.coalesce("pos", F.lit(-1)).alias("pos"), "text", (F.length("text").cast("long") + 1).alias("n"))
    sized = sized.join(totals, "item_id").withColumn("block", (F.col("pos") / BLOCK_LINES).cast("long"))
    sums = sized.groupBy("item_id", "block").agg(F.sum("n").alias("s"))
    before = Window.partitionBy("item_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("item_id", "block", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("item_id", "block").orderBy("pos", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("run", F.coalesce(F.sum("n").over(within), F.lit(0))).join(sums, ["item_id", "block"])
    placed = placed.withColumn("offset", F.col("run") + F.col("ahead")).withColumn("last", F.col("offset") + F.col("n") == F.col("total"))
    placed = placed.withColumn("segment", (F.col("offset") / segment_chars).cast("long"))
    placed = placed.withColumn("line", F.when(F.col("last"), F.col("text")).otherwise(F.concat("text", F.lit("\n"))))
    whole = F.expr("array_join(transform(array_sort(collect_list(struct(offset, line))), x -> x.line), '')")
    return placed.groupBy("item_id", "total", "segment").agg(F.min("offset").alias("base"), whole.alias("text"))


def _pack(m: np.ndarray) -> bytes:
    return np.asarray(m, np.float64).tobytes()


def _compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return np.stack([(row[:, None] + b).min(axis=0) for row in a])


CHOSEN = "item_id string, total long, segment long, base long, size long, at array<long>, cost array<double>"
MATRIX = "item_id string, segment long, height int, width int, m binary"
PORTS = "item_id string, segment long, entry int, exit int"


def _choice_rows(reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for item, total, segment, base, text in zip(rows.item_id, rows.total, rows.segment, rows.base, rows.text):
                at, cost = choices(text, reach)
                out.append((item, total, segment, base, len(text), (at + base).tolist(), cost.tolist()))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in CHOSEN.split(", ")])

    return run


class _Segment:
    """A segment between its ports: the boundaries before it that a piece can begin at, and those that the next one can."""

    def __init__(self, row, limit: int, overlap: int) -> None:
        self.reach = limit - overlap
        n = row.total - 1
        self.even = n / -(-n // self.reach)
        self.at, self.cost = np.asarray(row.at, np.int64), np.array(row.cost, float)
        first = row.base == 0
        self.allowed = limit if first else self.reach
        ahead = [] if row.ahead is None else row.ahead
        self.entries = np.zeros(1, np.int64) if first else np.array(ahead, np.int64)
        end = row.base + row.size
        if end == n:
            self.cost[-1] = LINE_COST
            self.passing, self.exits = np.empty(0, np.int64), np.array([len(self.at) - 1])
        else:
            self.passing = np.flatnonzero(self.entries > end - self.reach) if not first else np.empty(0, np.int64)
            self.exits = np.flatnonzero(self.at > end - self.reach)

    def solve(self) -> tuple[np.ndarray, np.ndarray]:
        return _forward(self.at, self.cost, self.entries, self.allowed, self.reach, self.even)

    def matrix(self) -> np.ndarray:
        """Entries by exits; an entry still within reach at the end is an exit of its own."""
        best, _ = self.solve()
        still = np.full((len(self.entries), len(self.passing)), np.inf)
        still[self.passing, np.arange(len(self.passing))] = 0.0
        return np.concatenate([still, best[self.exits].T], axis=1)

    def between(self, entry: int, exit_: int) -> tuple[int, list[tuple[int, float]]]:
        """Where the first piece begins, and the cuts up to the exit."""
        if exit_ < len(self.passing):
            return int(self.entries[entry]), []
        _, back = self.solve()
        path = _path(back, int(self.exits[exit_ - len(self.passing)]), entry)
        return int(self.entries[entry]), [(int(self.at[j]), float(self.cost[j])) for j in path]


def _long_scenes(segments: DataFrame, limit: int, overlap: int, scratch: Scratch, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of scenes that stand in several segments: the optimum over the whole scene."""
    reach = limit - overlap
    segments = scratch.save(segments, "segments")
    chosen = scratch.save(segments.mapInPandas(_choice_rows(reach), CHOSEN), "chosen")
    # ports before a segment lie in the last one, or, if that is shorter than a piece, in the last two
    order = Window.partitionBy("item_id").orderBy("segment")
    near = F.filter("at", lambda p: p > F.col("base") + F.col("size") - 2 * reach)
    met = chosen.select("item_id", "segment", "base", near.alias("near"))
    none = F.array().cast("array<long>")
    met = met.withColumn("two", F.concat(F.coalesce(F.lag("near", 2).over(order), none), F.coalesce(F.lag("near", 1).over(order), none)))
    met = met.select("item_id", "segment", F.filter("two", lambda p: p > F.col("base") - reach).alias("ahead"))
    ready = scratch.save(chosen.join(met, ["item_id", "segment"]), "ready")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [(r.item_id, r.segment, _Segment(r, limit, overlap).matrix()) for r in rows.itertuples()]
            yield pd.DataFrame([(i, s, *m.shape, _pack(m)) for i, s, m in found], columns=["item_id", "segment", "height", "width", "m"])

    def read(rows: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(r.m, np.float64).reshape(r.height, r.width) for r in rows.sort_values("segment").itertuples()]

    def composed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        whole, *rest = read(rows)
        for m in rest:
            whole = _compose(whole, m)
        return pd.DataFrame([(key[0], key[1], *whole.shape, _pack(whole))], columns=["item_id", "segment", "height", "width", "m"])

    levels = [scratch.save(ready.mapInPandas(matrices, MATRIX), "level-0")]
    most = levels[0].agg(F.max("segment")).first()[0] or 0
    while most > 0:
        group = F.floor(F.col("segment") / fan_in)
        up = levels[-1].groupBy("item_id", group.alias("group")).applyInPandas(composed, MATRIX)
        levels.append(scratch.save(up, f"level-{len(levels)}"))
        most //= fan_in

    def handed_down(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """The ports of the best path through the segments of a group, given those of the group."""
        ms, numbers = read(rows), sorted(rows.segment)
        entry, last = int(known.entry.iloc[0]), int(known.exit.iloc[0])
        costs = [ms[0][entry]]
        for m in ms[1:]:
            costs.append((costs[-1][:, None] + m).min(axis=0))
        exits = [last]
        for k in range(len(ms) - 1, 0, -1):
            exits.append(int((costs[k - 1] + ms[k][:, exits[-1]]).argmin()))
        exits = exits[::-1]
        return pd.DataFrame({"item_id": key[0], "segment": numbers, "entry": [entry, *exits[:-1]], "exit": exits})

    ports = levels[-1].select("item_id", "segment", F.lit(0).alias("entry"), F.lit(0).alias("exit"))
    for i in range(len(levels) - 2, -1, -1):
        below = levels[i].withColumn("group", F.floor(F.col("segment") / fan_in))
        ports = below.groupBy("item_id", "group").cogroup(ports.groupBy("item_id", "segment")).applyInPandas(handed_down, PORTS)
        ports = scratch.save(ports, f"ports-{i}")

    # the text a first piece may begin in, and its overlap
    tail = F.expr(f"right(text, {2 * limit})")
    texts = segments.select("item_id", "segment", "text", tail.alias("tail"))
    two = F.concat(F.coalesce(F.lag("tail", 2).over(order), F.lit("")), F.coalesce(F.lag("tail", 1).over(order), F.lit("")))
    texts = texts.select("item_id", "segment", "text", two.alias("before"))
    work = ready.join(ports, ["item_id", "segment"]).join(texts, ["item_id", "segment"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.itertuples():
                start, ends = _Segment(r, limit, overlap).between(r.entry, r.exit)
                text, base, unbroken = r.before + r.text, r.base - len(r.before), longest_unbroken(r.text)
                for k, (end, cost) in enumerate(ends):
                    repeat = min(overlap, start)
                    rows.append(("scene", r.item_id, r.segment, k, start, end, repeat, _name(cost), unbroken, text[start - repeat - base : end - base]))
                    start = end
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    return work.mapInPandas(cut, PIECES)


def oversized_pieces(paragraphs: DataFrame, paragraph_limit: int, scene_limit: int, overlap: int, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Pieces of every line over paragraph_limit and every scene over scene_limit.

    paragraphs: `paragraph_id, scene_id, paragraph_index, text`, one row per line. Pieces of
    an item come in order of `segment, piece_index`.
    """
    scratch = Scratch(paragraphs.sparkSession)
    long_lines = paragraphs.where(F.length("text") > paragraph_limit).select(F.lit("paragraph").alias("item_kind"), F.col("paragraph_id").alias("item_id"), "text")
    lines = paragraphs.select(F.col("scene_id").alias("item_id"), F.col("paragraph_index").alias("pos"), "text")
    totals = scratch.save(scene_sizes(lines, scene_limit), "totals")
    short = scene_segments(lines, totals.where(F.col("total") - 1 <= segment_chars), segment_chars + 1)
    short = short.select(F.lit("scene").alias("item_kind"), "item_id", "text")
    out = split_items(long_lines, paragraph_limit, overlap).unionByName(split_items(short, scene_limit, overlap))
    longer = totals.where(F.col("total") - 1 > segment_chars)
    if longer.isEmpty():
        return out
    return out.unionByName(_long_scenes(scene_segments(lines, longer, segment_chars), scene_limit, overlap, scratch))


def oversized_items(pieces: DataFrame, paragraph_limit: int) -> DataFrame:
    """The items that had to be cut: `item_kind, item_id`, with kind `unbroken` for lines without a boundary within the limit."""
    items = pieces.groupBy("item_kind", "item_id").agg(F.count("*").alias("pieces"), F.max("longest_unbroken").alias("u")).where("pieces > 1")
    unbroken = (F.col("item_kind") == "paragraph") & (F.col("u") > paragraph_limit)
    kinds = F.when(unbroken, F.array("item_kind", F.lit("unbroken"))).otherwise(F.array("item_kind"))
    return items.select(F.explode(kinds).alias("item_kind"), "item_id")
