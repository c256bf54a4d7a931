"""Problem 3: records that name the same person under different spellings.

Full names are sets of q-grams of their letters (foreign syllables by their reading, so
both scripts meet). Grams are ordered rare first over all names; two names whose weighted
Jaccard similarity reaches CANDIDATE share a gram of their prefixes, which is what joins
them within a volume, and pairs that don't reach it are dropped. The rest is verified by
soft weighted token similarity: parts are matched in either order, a matched part counts
by the share of its syllables or letters that agree, weighted by its rarity, and the sum
must reach VERIFIED. So a rare given name counts for more than the family name that
relatives share, and a slip in the one weighs more than in the other. Two spellings of a
part that several records of the volume use each are two names, not slips, and agree in
nothing; nor do parts in ideographs that aren't equal.

Epithets link by equality. A given name or an initial with a family name links to the one
person of the volume it can stand for, be it a part of the full name or a name that a
record gives beside the full one, and to nobody if there are several. Links chain:
connected components make the groups.

Records of different volumes never link, a record named by role words only links to
nobody; null names and null or empty alias lists are skipped; null ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxloom.llm.components import connected_components
from voxloom.llm.names import READINGS, distance, is_foreign, letters, parse
from voxloom.sources.scratch import Scratch

CANDIDATE, VERIFIED = 0.2, 0.75
#: Least similarity of two names that are both written without a sign between their parts, as no rarity tells which part differs.
UNPARTED = 0.8
FORMS = "id string, volume string, kind string, a string, b string"


def units(part: str) -> str:
    """A part as its comparable units: readings of foreign syllables, blank-separated, or plain letters."""
    foreign = bool(part) and is_foreign(part) and all(c >= "㐀" for c in part)
    return " ".join(READINGS.get(c, c) for c in part) if foreign else letters(part)


def _tight(part: str) -> str:
    return part.replace(" ", "")


def _is_native(part: str) -> bool:
    """Written with ideographs that are not foreign syllables."""
    return " " not in part and any(c >= "㐀" for c in part)


def forms_of(names: list[str]) -> set[tuple[str, str, str]]:
    """(kind, a, b) of every name of a record; a and b as units."""
    out: set[tuple[str, str, str]] = set()
    for value in names:
        name = parse(value)
        if name is None or name.kind == "role":
            continue
        if name.kind == "epithet":
            out.add(("epithet", name.joined, ""))
        elif name.kind == "initial":
            x, y = name.parts
            short, rest = (x, y) if len(x) == 1 else (y, x)
            out.add(("initial", letters(short), _tight(units(rest))))
        elif name.kind == "single":
            word = name.joined
            out.add(("single", _tight(units(word)), ""))
            if word[0] == "阿" and len(word) >= 4:
                out.add(("single", _tight(units(word[1:])), ""))
        else:
            whole = name.parts[0]
            if len(name.parts) == 1 and len(whole) <= 5 and "㐀" <= whole[0]:  # family and given name without a sign between
                parts = [units(whole[:-2]), units(whole[-2:])]
            else:
                parts = [units(p) for p in name.parts]
            if len(parts) > 2:
                parts = [parts[0], "".join(_tight(p) for p in parts[1:])]
            parts.sort()
            out.add(("full", parts[0], parts[1] if len(parts) > 1 else ""))
    return out


def stand_ins(a: str, b: str) -> set[tuple[str, str, str]]:
    """(kind, a, b) of the shorter names that can stand for a full name."""
    out: set[tuple[str, str, str]] = set()
    if b:
        for x, y in ((a, b), (b, a)):
            out.add(("single", _tight(x), ""))
            out.add(("initial", x.split(" ")[0] if " " in x else x[0], _tight(y)))
            out.add(("initial", x[0], _tight(y)))
    else:
        syllables = a.split(" ")
        for n in range(2, len(syllables) - 1):
            out.add(("single", "".join(syllables[:n]), ""))
    return out


def _agreement(x: str, y: str) -> float:
    """Share of the syllables or letters of two parts that agree; parts in ideographs agree as a whole or not at all."""
    if x == y or _tight(x) == _tight(y):
        return 1.0
    if _is_native(x) or _is_native(y):
        return 0.0
    if " " in x and " " in y:
        p, q = x.split(" "), y.split(" ")
        code = {s: chr(0xE000 + i) for i, s in enumerate(sorted({*p, *q}))}
        return max(0.0, 1 - distance("".join(map(code.get, p)), "".join(map(code.get, q))) / max(len(p), len(q)))
    x, y = _tight(x), _tight(y)
    # a slip takes a letter, and a syllable has about two
    return max(0.0, 1 - 2 * distance(x, y) / max(len(x), len(y)))


class Parts:
    """Rarity of a part, and how many records of the volume use it."""

    def __init__(self, weight: dict[str, float], support: dict[str, int]) -> None:
        self.weight, self.support = weight, support

    def match(self, x: str, y: str) -> tuple[float, float]:
        """Weight of a matched part, and how far it agrees."""
        w = max(self.weight[x], self.weight.get(y, 0.0))
        share = _agreement(x, y)
        two_names = share < 1 and self.support[x] > 1 and self.support.get(y, 1) > 1
        return w, 0.0 if two_names else share


def _soft(matched: list[tuple[float, float]]) -> float:
    return sum(w * s for w, s in matched) / sum(w for w, _ in matched)


def similarity(a1: str, b1: str, a2: str, b2: str, parts: Parts) -> float:
    """Soft weighted token similarity of two full names; a name without a sign between its parts is split where the other is."""
    if not b1 and not b2:
        share = _agreement(a1, a2)
        return share if share >= UNPARTED else 0.0
    if b1 and b2:
        return max(_soft([parts.match(p, r), parts.match(q, s)]) for p, q, r, s in ((a1, b1, a2, b2), (a1, b1, b2, a2)))
    (x, y), whole = ((a1, b1), a2) if b1 else ((a2, b2), a1)
    best = 0.0
    cut = " " if " " in whole else ""
    units_of = lambda t: t.split(" ") if cut else list(_tight(t))
    tokens = units_of(whole)
    for p, q in ((x, y), (y, x)):
        for at in (len(units_of(p)) + i for i in (-1, 0, 1)):
            if 0 < at < len(tokens):
                best = max(best, _soft([parts.match(p, cut.join(tokens[:at])), parts.match(q, cut.join(tokens[at:]))]))
    return best


def _forms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = [(i, v, *f) for i, v, names in zip(rows.id, rows.volume, rows.names) for f in sorted(forms_of([x for x in names if x]))]
        yield pd.DataFrame(out, columns=["id", "volume", "kind", "a", "b"])


def _stand_ins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = [(c, v, *f) for c, v, a, b in zip(rows.component, rows.volume, rows.a, rows.b) for f in sorted(stand_ins(a, b))]
        yield pd.DataFrame(out, columns=["component", "volume", "kind", "a", "b"])


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for r in batches:
        keep = []
        for a1, b1, a2, b2, *known in zip(*(r[c] for c in ("a1", "b1", "a2", "b2", "wa1", "wb1", "wa2", "wb2", "sa1", "sb1", "sa2", "sb2"))):
            names = (a1, b1, a2, b2)
            keep.append(similarity(*names, Parts(dict(zip(names, known[:4])), dict(zip(names, known[4:])))) >= VERIFIED)
        yield r.loc[keep, ["f1", "f2"]]


def similar_full_names(full: DataFrame, uses: DataFrame, scratch: Scratch) -> DataFrame:
    """`f1, f2`: verified pairs of `f, volume, a, b`, distinct full names; uses: `volume, p, s`, the records that use a part, in any script."""
    key = F.regexp_replace(F.concat("a", "b"), " ", "")
    q = F.when(key.rlike("[\\x{3400}-\\x{9fff}]"), 2).otherwise(3)
    grams = full.withColumn("key", key).withColumn("q", q).select("f", "volume", F.explode(F.expr("array_distinct(transform(sequence(1, greatest(length(key) - q + 1, 1)), i -> substring(key, i, q)))")).alias("g"))
    n = full.count()
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    weighed = grams.join(df, "g").withColumn("w", F.log(1 + F.lit(n) / F.col("df")))
    sets = weighed.groupBy("f", "volume").agg(F.array_sort(F.collect_list(F.struct("df", "g", "w"))).alias("gs"), F.sum("w").alias("all"))
    sets = scratch.save(sets.select("f", "volume", "all", F.transform("gs", lambda x: F.struct(x["g"].alias("g"), x["w"].alias("w"))).alias("gs")), "sets")
    # grams rare first, as long as what stands before them leaves room for the similarity
    placed = sets.select("f", "volume", "all", F.posexplode("gs").alias("i", "x"), "gs")
    ahead = F.aggregate(F.slice("gs", F.lit(1), F.col("i")), F.lit(0.0), lambda z, x: z + x["w"])
    prefix = placed.where(ahead <= (1 - CANDIDATE) * F.col("all")).select("f", "volume", F.col("x.g").alias("g"), "all")
    prefix = scratch.save(prefix, "prefix")
    x, y = prefix.alias("x"), prefix.alias("y")
    # a pair can reach the similarity only if neither set outweighs the other by more than its inverse
    size = (F.col("x.all") >= CANDIDATE * F.col("y.all")) & (F.col("y.all") >= CANDIDATE * F.col("x.all"))
    met = x.join(y, (F.col("x.volume") == F.col("y.volume")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.f") < F.col("y.f")) & size)
    pairs = met.select(F.col("x.f").alias("f1"), F.col("y.f").alias("f2")).distinct()
    tight = lambda c: F.regexp_replace(c, " ", "")
    rare = full.select(F.explode(F.array(tight("a"), tight("b"))).alias("p")).groupBy("p").agg(F.log(1 + F.lit(n) / F.count("*")).alias("w"))
    known = scratch.save(uses.join(rare, "p"), "parts")
    of = lambda c: known.select("volume", F.col("p").alias(f"t{c}"), F.col("w").alias(f"w{c}"), F.col("s").alias(f"s{c}"))
    weighty = full.withColumn("ta", tight("a")).withColumn("tb", tight("b")).join(of("a"), ["volume", "ta"]).join(of("b"), ["volume", "tb"])
    weighty = weighty.join(sets.select("f", "gs", "all"), "f")
    columns = ("f", "a", "b", "wa", "wb", "sa", "sb", "gs", "all")
    weighty = scratch.save(weighty.select(*columns), "weighty")
    one = lambda i: weighty.select(*[F.col(c).alias(f"{c}{i}") for c in columns])
    met = pairs.join(one(1), "f1").join(one(2), "f2")
    common = F.aggregate(F.filter("gs1", lambda x: F.array_contains(F.col("gs2.g"), x["g"])), F.lit(0.0), lambda z, x: z + x["w"])
    met = met.withColumn("common", common).where(F.col("common") >= CANDIDATE * (F.col("all1") + F.col("all2") - F.col("common")))
    return met.drop("gs1", "gs2", "all1", "all2", "common").mapInPandas(_verify, "f1 string, f2 string")


def link_names(records: DataFrame) -> DataFrame:
    """`id, person` for `id, volume, names ARRAY<STRING>`; records that name nobody are left out."""
    scratch = Scratch(records.sparkSession)
    node = lambda tag, *cols: F.concat_ws("|", F.lit(tag), *cols)
    named = records.where("id is not null").select("id", F.coalesce("volume", F.lit("")).alias("volume"), F.filter(F.coalesce("names", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("names"))
    forms = scratch.save(named.mapInPandas(_forms, FORMS), "forms")
    own = node("r", "id")
    full = scratch.save(forms.where("kind = 'full'").select(node("f", "volume", "a", "b").alias("f"), "volume", "a", "b").distinct(), "full")
    used = forms.where("kind = 'full'").select("volume", "id", F.explode(F.transform(F.array("a", "b"), lambda c: F.regexp_replace(c, " ", ""))).alias("p")).distinct()
    similar = scratch.save(similar_full_names(full, used.groupBy("volume", "p").agg(F.count("*").alias("s")), scratch), "similar")
    to_full = forms.where("kind = 'full'").select(own.alias("x"), node("f", "volume", "a", "b").alias("y"))
    to_epithet = forms.where("kind = 'epithet'").select(own.alias("x"), node("e", "volume", "a").alias("y"))
    first = to_full.unionByName(to_epithet).unionByName(similar.select(F.col("f1").alias("x"), F.col("f2").alias("y")))
    groups = scratch.save(connected_components(first, "x", "y"), "groups")

    shorter = full.join(groups, full.f == groups.node).select("component", "volume", "a", "b").mapInPandas(_stand_ins, "component string, volume string, kind string, a string, b string")
    # a record's other names stand for it as well
    own_full = to_full.select(F.substring("x", 3, 1 << 30).alias("id"), F.col("y").alias("node")).join(groups, "node").select("id", "component").distinct()
    beside = forms.where("kind in ('single', 'initial')").join(own_full, "id").select("component", "volume", "kind", "a", "b")
    meant = shorter.unionByName(beside).groupBy("volume", "kind", "a", "b").agg(F.min("component").alias("c"), F.max("component").alias("c2"))
    # a record that has a full name of its own needs no shorter one
    lacking = forms.where("kind in ('single', 'initial')").join(forms.where("kind = 'full'").select("id").distinct(), "id", "left_anti")
    met = lacking.join(meant, ["volume", "kind", "a", "b"], "left")
    alone = met.where("c is null").select(own.alias("x"), node("s", "volume", "kind", "a", "b").alias("y"))
    placed = met.where("c = c2").select(own.alias("x"), F.col("c").alias("y"))
    every = first.unionByName(groups.select(F.col("node").alias("x"), F.col("component").alias("y"))).unionByName(alone).unionByName(placed)
    people = connected_components(scratch.save(every.distinct(), "links"), "x", "y")
    for name in ("forms", "full", "sets", "prefix", "parts", "weighty", "similar", "groups", "links"):
        scratch.drop(name)
    return people.where("node like 'r|%'").select(F.substring("node", 3, 1 << 30).alias("id"), F.col("component").alias("person"))


def linked_pairs(people: DataFrame) -> DataFrame:
    """`id_a, id_b`: all pairs of records of one person, the smaller id first."""
    a, b = people.alias("a"), people.alias("b")
    return a.join(b, (F.col("a.person") == F.col("b.person")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
