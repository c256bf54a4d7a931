"""Problem 2: typed values mapped to the entry of a reference list that they mean.

Every way to write a reference entry (parts in either order, given name, family name with
a form of address, initial, epithet, readings in Latin letters) is a key; keys of one kind
stand in a BK-tree under the unrestricted Damerau-Levenshtein distance, a true metric, so
the triangle inequality prunes every subtree that can't hold a key within the threshold.
Each search returns all keys within it; the nearest entry wins, and a value that is
equally near to two entries means neither of them.

Keys are made by the executors, entry by entry. A list within BROADCAST_KEYS goes to every
task as one index and the values are mapped where they are, without a shuffle. A longer
list is cut into shards of that size: distinct values meet every shard in large blocks, so
that building a shard's trees is a small part of searching them, and the winners of the
shards merge. A result carries all that decides between entries (the rank of its kind of
key, distance, and whether it is the entry's own name), so both forms give the same.

Titles come from the reference list. What people write for a status beside its own name is
a table too (`wordings`); beyond it, a value means the one status whose name stands in it
as a word, or the one whose gloss holds it.

Null values give no row; values that mean nothing, also blank ones, give `none`.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.llm.base import small_or_shuffled
from voxloom.llm.names import Name, distance, letters, parse, undecorated
from voxloom.sources.scratch import Scratch

BROADCAST_KEYS = 200_000
#: Distinct values that one task searches for in a shard.
BLOCK_VALUES = 65_536
KEYS = "kind string, key string, entry string"
#: Forms of address that follow a family name.
FAMILY_ADDRESS = ("先生", "小姐", "卿", "家的那位", "女士", "夫人")
# What people write for an entry of the status list, where its name and gloss don't say so; the default of `wordings`.
WORDINGS = {
    "known": ("已知", "identified", "confirmed", "身份已确认"),
    "mystery": ("mysterious", "谜之人物", "神秘身份", "神秘人物"),
    "npc": ("路人", "路人甲"),
    "npc_group": ("npcs", "npcgrp", "group of npcs", "众人", "群众", "路人们", "群体"),
    "ambiguous": ("ambiguity", "歧义", "有歧义", "多名候选人", "两人都有可能"),
    "unknown": ("未知", "不明", "不知道谁说的", "不知道是谁"),
    "review": ("to be reviewed", "待复核", "等待复核", "需复核", "待审核"),
}


class Tree:
    """BK-tree over keys; each key holds the entries it stands for."""

    def __init__(self) -> None:
        self.entries: dict[str, set[str]] = {}
        self.children: dict[str, dict[int, str]] = {}
        self.far: dict[str, int] = {}
        self.root: str | None = None

    def add(self, key: str, entry: str) -> None:
        if key in self.entries:
            self.entries[key].add(entry)
            return
        self.entries[key] = {entry}
        self.children[key] = {}
        if self.root is None:
            self.root = key
            return
        at = self.root
        while True:
            d = distance(key, at)
            if d not in self.children[at]:
                self.children[at][d] = key
                self.far[at] = max(d, self.far.get(at, 0))
                return
            at = self.children[at][d]

    def within(self, key: str, radius: int) -> list[tuple[int, str]]:
        """(distance, key) of every key within radius."""
        if key in self.entries and radius == 0:
            return [(0, key)]
        if self.root is None or radius == 0:
            return []
        out, stack = [], [self.root]
        while stack:
            at = stack.pop()
            most = self.far.get(at, 0) + radius  # beyond it no child can be near
            d = distance(key, at, most)
            if d > most:
                continue
            if d <= radius:
                out.append((d, at))
            stack += [child for e, child in self.children[at].items() if d - radius <= e <= d + radius]
        return out

    def nearest(self, key: str, radius: int) -> tuple[int, set[str]] | None:
        """Least distance and the entries at it."""
        if key in self.entries:
            return 0, self.entries[key]
        found = self.within(key, radius)
        if not found:
            return None
        least = min(d for d, _ in found)
        return least, set().union(*(self.entries[k] for d, k in found if d == least))


def name_keys(name: Name) -> Iterator[tuple[str, str]]:
    """(kind, key) of every way to write a person's full name."""
    if name.kind == "full" and len(name.parts) == 2:
        g, f = name.parts
        yield "name", g + f
        yield "name", f + g
        yield "name", letters(g) + letters(f)
        yield "name", letters(f) + letters(g)
        yield "given", g
        yield "family", f
        yield "given", letters(g)
        yield "family", letters(f)
        yield "initial", f"{letters(g[0])} {letters(f)}"
        yield "initial", f"{letters(g)[0]} {letters(f)}"
    elif name.kind == "full":
        yield "name", name.joined
        yield "name", letters(name.joined)
    elif name.kind == "single":
        yield "given", name.joined
        yield "given", letters(name.joined)
    elif name.kind == "epithet":
        yield "epithet", name.joined


def person_keys(entries: list[tuple[str, str, list[str], list[str]]]) -> list[tuple[str, str, str]]:
    """(kind, key, entry) of a list of persons (id, name, aliases, titles); an alias of several persons stands for none."""
    keys: set[tuple[str, str, str]] = set()
    for entry, display, aliases, titles in entries:
        keys |= {("title", undecorated(t), "") for t in titles or [] if t and undecorated(t)}
        for value in [display, *(aliases if aliases is not None else [])]:
            if (name := parse(value)) is not None:
                keys |= {(kind, key.casefold(), entry) for kind, key in name_keys(name)}
    return sorted(keys)


def status_key(value: str) -> str:
    """Letters and digits only, in lower case: blanks, dots and hyphens don't tell statuses apart."""
    return "".join(c for c in undecorated(value).casefold() if c.isalnum())


def status_keys(entries: list[tuple[str, str, str]], wordings: dict[str, tuple[str, ...]] = WORDINGS) -> list[tuple[str, str, str]]:
    """(kind, key, entry) of `status_id, speaker_status, gloss`: the entry itself ranks before its other wordings, these before parts."""
    keys: set[tuple[str, str, str]] = set()
    for entry, status, gloss in entries:
        if not status:
            continue
        keys |= {("status", status_key(status), entry), ("word", status_key(status), entry)}
        keys |= {("wording", status_key(w), entry) for w in (*wordings.get(status, ()), gloss or status)}
        whole = status_key(gloss or "")
        keys |= {("part", whole[i:j], entry) for i in range(len(whole)) for j in range(i + 2, len(whole) + 1)}
        keys |= {("part", status_key(status)[:n], entry) for n in range(3, len(status_key(status)))}
    return sorted(keys)


def keys_of(entries: DataFrame, how: str) -> DataFrame:
    """`kind, key, entry` of a reference list, made where its rows are. how: "person" (id, name, aliases, titles) or "status" (id, status, gloss)."""
    of = person_keys if how == "person" else status_keys

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = of([tuple(x.tolist() if hasattr(x, "tolist") else x for x in r) for r in rows.itertuples(index=False, name=None)])
            yield pd.DataFrame(found, columns=["kind", "key", "entry"])

    first = entries.columns[0]
    return entries.where(F.col(first).isNotNull()).mapInPandas(run, KEYS).distinct()


class Index:
    """One tree per kind of key."""

    def __init__(self, keys: list[tuple[str, str, str]]) -> None:
        self.trees: dict[str, Tree] = defaultdict(Tree)
        self.titles = tuple(sorted((k for kind, k, _ in keys if kind == "title"), key=lambda t: (-len(t), t)))
        for kind, key, entry in keys:
            if kind != "title":
                self.trees[kind].add(key, entry)

    def _try(self, kind: str, key: str, radius: int, rank: int, own: int = 0) -> list[tuple[int, int, int, str]]:
        found = self.trees[kind].nearest(key.casefold(), radius)
        return [(rank, found[0], own, e) for e in sorted(found[1])] if found else []

    def person(self, value: str) -> list[tuple[int, int, int, str]]:
        """(rank, distance, 0, entry) of the best kind of key that has the value within its threshold."""
        name = parse(value, self.titles)
        if name is None or name.kind == "role":
            return []
        key = name.joined
        han = all(c >= "㐀" for c in key)
        if name.kind == "epithet":
            return self._try("epithet", key, 0, 0)
        if name.kind == "initial":
            a, b = name.parts
            short, rest = (a, b) if len(a) == 1 else (b, a)
            return self._try("initial", f"{letters(short)} {letters(rest)}", 0, 0)
        if name.kind == "full":
            return self._try("name", key if han else letters(key), 1 if len(key) >= 5 else 0, 0)
        plain = key if han else letters(key)
        ways = [("family", 0), ("given", 0)] if name.honorific in FAMILY_ADDRESS[2:4] else [("given", 0), ("family", 0)] if name.honorific in FAMILY_ADDRESS else [("given", 0)]
        for rank, (kind, radius) in enumerate(ways):
            if found := self._try(kind, plain, radius, rank):
                return found
        if len(plain) >= 5 and (found := self._try("name", plain, 1, 2)):
            return found
        return self._try("given", plain, 1, 3) if len(plain) >= 4 else []

    def status(self, value: str) -> list[tuple[int, int, int, str]]:
        """(rank, distance, 1 for another wording, entry) of the best kind of key; own names rank before wordings as near."""
        key = status_key(value)
        if not key:
            return []
        for rank, kind in enumerate(("status", "wording")):
            if found := self._try(kind, key, 0, rank):
                return found
        radius = 0 if len(key) < 3 or any(c >= "㐀" for c in key) and len(key) < 4 else 1 if len(key) < 7 else 2
        if found := self._try("status", key, radius, 2) + self._try("wording", key, radius, 2, 1):
            least = min(x[:3] for x in found)
            return [x for x in found if x[:3] == least]
        words = {status_key(w) for w in re.split(r"[\s/,;:]+", undecorated(value)) if status_key(w)}
        if found := [x for w in sorted(words) for x in self._try("word", w, 0, 3)]:
            return found
        return self._try("part", key, 0, 4)


def _winner(found: list[tuple[int, int, int, str]]) -> str | None:
    entries = {x[-1] for x in found}
    return next(iter(entries)) if len(entries) == 1 else None


def map_values(values: DataFrame, keys: DataFrame, how: str, broadcast_keys: int = BROADCAST_KEYS, block: int = BLOCK_VALUES) -> DataFrame:
    """Adds `ref_id` to values (`value STRING`, other columns kept): the entry meant, or `none`.

    A column of that name is replaced, rows with a null value are left out. keys: `kind,
    key, entry` (see `keys_of`); without any, nothing is meant. how: "person" or "status".
    """
    spark = values.sparkSession
    scratch = Scratch(spark)
    values = values.drop("ref_id").where("value is not null")
    keys = scratch.save(keys.select("kind", "key", "entry"), "keys")
    n = keys.count()
    if n <= broadcast_keys:
        shared = spark.sparkContext.broadcast([tuple(r) for r in keys.collect()])  # at most broadcast_keys rows
        scratch.drop("keys")

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            search = getattr(Index(shared.value), how)
            for rows in batches:
                yield rows.assign(ref_id=[_winner(search(v)) or "none" for v in rows.value])

        # few bytes and much work a row: each distinct value once, spread over all cores whatever the bytes are
        distinct = values.select("value").distinct().repartition(2 * spark.sparkContext.defaultParallelism)
        meant = scratch.save(distinct.mapInPandas(near, "value string, ref_id string"), "meant")
        return values.join(small_or_shuffled(meant, scratch.bytes("meant")), "value").select(*values.columns, "ref_id")

    shards = -(-n // broadcast_keys)
    every_shard = F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))
    # all keys of an entry stand in one shard; titles are needed in each
    own = F.array(F.pmod(F.xxhash64("entry"), F.lit(shards)))
    parts = keys.withColumn("shard", F.explode(F.when(F.col("kind") == "title", every_shard).otherwise(own)))
    distinct = scratch.save(values.select("value").distinct(), "values")
    blocks = max(1, -(-distinct.count() // block))
    asked = distinct.withColumn("block", F.pmod(F.xxhash64("value"), F.lit(blocks))).withColumn("shard", F.explode(every_shard))
    held = parts.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def search_shard(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        search = getattr(Index(list(zip(held.kind, held.key, held.entry))), how)
        return pd.DataFrame([(v, *x) for v in rows.value for x in search(v)], columns=["value", "rank", "distance", "own", "entry"])

    held = held.select(F.col("shard").alias("s"), F.col("block").alias("b"), "kind", "key", "entry")
    won = asked.groupBy("shard", "block").cogroup(held.groupBy("s", "b")).applyInPandas(search_shard, "value string, rank int, distance int, own int, entry string")
    # a shard's winners and those of the others: the best of all, if it is one
    best = won.groupBy("value", "rank", "distance", "own").agg(F.min("entry").alias("e"), F.max("entry").alias("e2"))
    best = best.groupBy("value").agg(F.min(F.struct("rank", "distance", "own", "e", "e2")).alias("x"))
    one = best.where("x.e = x.e2").select("value", F.col("x.e").alias("ref_id"))
    return values.join(one, "value", "left").select(*values.columns, F.coalesce("ref_id", F.lit("none")).alias("ref_id"))
