"""Problem 6: text that reads the same, brought to one form.

A code point is *unstable* if the NFC quick check doesn't answer "yes" for it, if it is a
combining mark, invisible, a full- or half-width form, a kind of blank, a compatibility
ideograph or radical, or if it is in the look-alike table.  Only unstable segments are
rewritten and spliced into the text between them, which is copied as it is: runs of code
points with a form of their own first, then runs that the quick check leaves open, each
with the one stable character before it, as a mark may compose with it.

Runs of full stops that are whole ellipses in half width become ellipses, as the character
database decomposes them. Letter case, accents, simplified and traditional forms, and other punctuation stay apart.
Kana that look like an ideograph become the ideograph unless a kana stands next to them;
a Greek or Cyrillic word that has a letter without a Latin twin is left in its script.

Null gives null, empty text gives empty text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxloom.sources.scratch import Scratch

# Look-alike letters and signs, and what they are taken for.
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανιοκρυχγϲϹ", "ABEZHIKMNOPTYXaviokpuxycC"))
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеорсухѕіјһԁԛԝѵүӏ", "ABESIJKMHOPCTYXYGQWaeopcyxsijhdqwvyl"))
ARMENIAN = dict(zip("օսհոՕՍ", "ouhnOU"))
CHEROKEE = dict(zip("ᎪᏴᏟᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCEGHJKLMPRSTVWZ"))
LATIN_SIGNS = dict(zip("ɡɑıꞮ", "gaiI"))
KANA = dict(zip("エカタロニハトチオヌノミメムー", "工力夕口二八卜千才又丿三乂厶一"))
SIGNS = {
    "⋯": "…", "•": "·", "‧": "·", "∙": "·", "⋅": "·", "・": "·", "･": "·", "ꞏ": "·",
    "―": "—", "─": "—", "‐": "-", "‑": "-", "−": "-",
    "∶": ":", "⁄": "/", "∕": "/", "∗": "*", "〜": "~", "∼": "~",
}
# Radicals that have no decomposition in the character database, with the ideograph of the same shape.
RADICALS = dict(zip("⺁⺄⺅⺇⺈⺉⺋⺌⺍⺎⺏⺐⺑⺒⺓⺔⺕⺖⺗⺘⺙⺛⺜⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺪⺫⺬⺭⺮⺯⺰⺱⺲⺳⺶⺷⺹⺺⺻⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "厂乙亻几刀刂㔾小小兀尣尢𡯂巳幺彑彐忄㣺扌攵旡日月歹母民氵氺灬爫爫丬牛犭王疋罒示礻竹糹纟罒罓㓁𦍌羊耂肀聿肉臼艹艹艹虎衤覀西见角𧢲讠贝𧾷车辶辶辶阝钅長镸长门𨸏阝雨青韦页风飞食𩙿饣𩠐马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀"))
_TWINS = {**GREEK, **CYRILLIC, **ARMENIAN, **CHEROKEE, **LATIN_SIGNS}
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufff8\U000e0000-\U000e0fff"
BLANKS = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"

#: Decompositions of the character database that read the same: width, and letters of mathematics.
SAME_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<vertical>", "<font>")
#: Code points with a compatibility decomposition that looks the same: Roman numerals and radicals.
SAME_SHAPE = ((0x2160, 0x2180), (0x2E80, 0x2FE0))
#: Ranges that may hold unstable code points; everything outside is stable by its block.
SCANNED = ((0x0080, 0x3400), (0xA640, 0xABFF), (0xF900, 0x11FFF), (0x16AF0, 0x16B3F), (0x1BC90, 0x1BCAF), (0x1D160, 0x1D800), (0x1E000, 0x1E95F), (0x2F800, 0x2FA20))


def _fold_one(ch: str) -> str | None:
    """The form a single code point is rewritten to before composition, None if it has none."""
    if ch in SIGNS:
        return SIGNS[ch]
    if ch in RADICALS:
        return RADICALS[ch]
    kind, _, rest = unicodedata.decomposition(ch).partition(" ")
    if kind in SAME_TAGS or (kind == "<compat>" and any(a <= ord(ch) < b for a, b in SAME_SHAPE)):
        out = "".join(chr(int(x, 16)) for x in rest.split())
        return SIGNS.get(out, out)
    return None


#: For the JVM's check: unstable signs that are in most texts, and the ranges that most characters are in, none of them unstable.
_COMMON, _STABLE = "，！？：；", r"\x{0}-\x{7F}\x{4E00}-\x{9FFF}。、「」『』《》…—“”‘’"


@lru_cache(maxsize=1)
def _tables() -> tuple[dict[str, str], re.Pattern[str], re.Pattern[str], str]:
    """The rewriting table, the patterns of the two kinds of segments, and the class of unstable code points for the JVM."""
    invisible, blank = re.compile(f"[{INVISIBLE}]"), re.compile(f"[{BLANKS}]")
    fold: dict[int, str] = {}
    unstable: set[int] = set()
    seconds: set[int] = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for a, b in SCANNED:
        for cp in range(a, b):
            ch = chr(cp)
            parts = unicodedata.decomposition(ch).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                seconds.add(int(parts[1], 16))
            if invisible.match(ch):
                fold[cp] = ""
            elif blank.match(ch):
                fold[cp] = " "
            elif (to := _fold_one(ch)) is not None and to != ch:
                fold[cp] = to
            elif unicodedata.combining(ch) or unicodedata.normalize("NFC", ch) != ch:
                unstable.add(cp)
    for cp in range(0xE0000, 0xE1000):
        fold[cp] = ""
    unstable |= {c for c in seconds if c > 0x7F}
    single, open_ = _classes(set(fold))[0], _classes(unstable)[0]
    twins = {cp for a, b in ((0x370, 0x530), (0x1F00, 0x2000)) for cp in range(a, b) if unicodedata.normalize("NFD", chr(cp))[0] in _TWINS}
    every = unstable | set(fold) | twins | {ord(c) for c in (*_TWINS, *KANA)}
    return {chr(k): v for k, v in fold.items()}, re.compile(f"[{single}]"), re.compile(f"[^{open_}\n]?[{open_}]+"), f"[{_COMMON}]|(?=[^{_STABLE}])[{_classes(every)[1]}]|[.]{{3}}"


def _classes(points: set[int]) -> tuple[str, str]:
    """The code points as ranges of a character class, for Python and for Java."""
    runs: list[list[int]] = []
    for cp in sorted(points):
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    ends = [(re.escape(chr(a)), re.escape(chr(b)), f"\\x{{{a:X}}}-\\x{{{b:X}}}") for a, b in runs]
    return "".join(f"{a}-{b}" for a, b, _ in ends), "".join(x for *_, x in ends)


_FOREIGN = (("Ͱ", "֏"), ("Ꭰ", "ᏽ"), ("ἀ", "῿"))
_DOTS = re.compile(r"(?<!\.)(?:\.{3})+(?!\.)")
_TWIN = re.compile("[" + "".join(f"{a}-{b}" for a, b in _FOREIGN) + "".join(LATIN_SIGNS) + "]")
_LETTER = r"(?:[^\W\d_]|[̀-ͯ])*"
_TWIN_WORD = re.compile(_LETTER + _TWIN.pattern + _LETTER)
_KANA_RUN = re.compile("[" + "".join(KANA) + "]+")
_LATIN = re.compile("[A-Za-zÀ-ɏ]")


def _letters(m: re.Match[str]) -> str:
    word = m[0]
    foreign = any(c not in _TWINS and any(a <= c <= b for a, b in _FOREIGN) for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    if foreign and not _LATIN.search(word):
        return word
    return unicodedata.normalize("NFC", "".join(_TWINS.get(c, c) for c in unicodedata.normalize("NFD", word)))


def _is_kana(c: str) -> bool:
    return "ぁ" <= c <= "ヿ" and c != "・" and c not in KANA


def _kana(text: str) -> str:
    def one(m: re.Match[str]) -> str:
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if (before and _is_kana(before)) or (after and _is_kana(after)):
            return m[0]
        if set(m[0]) == {"ー"}:
            return m[0]
        return "".join(KANA[c] for c in m[0])

    return _KANA_RUN.sub(one, text)


def canonical(text: str | None) -> str | None:
    """One form for all texts that read the same."""
    if not text:
        return text
    if text.isascii():
        return _DOTS.sub(lambda m: "…" * (len(m[0]) // 3), text)
    fold, single, segment, _ = _tables()
    text = single.sub(lambda m: fold[m[0]], text)
    text = _DOTS.sub(lambda m: "…" * (len(m[0]) // 3), text)
    if not unicodedata.is_normalized("NFC", text):  # the quick check
        text = segment.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)
    if _TWIN.search(text):
        text = _TWIN_WORD.sub(_letters, text)
    if _KANA_RUN.search(text):
        text = _kana(text)
    return text


@F.pandas_udf(T.StringType())
def _canonical_udf(s: pd.Series) -> pd.Series:
    return s.map(canonical, na_action="ignore")


def canonical_column(text: Column) -> Column:
    """`canonical` as a column; stable texts pass the quick check in the JVM and skip Python."""
    unstable = text.rlike(_tables()[3])
    return F.when(unstable, _canonical_udf(F.when(unstable, text))).otherwise(text)


def same_reading_pairs(rows: DataFrame, salts: int = 16) -> DataFrame:
    """Pairs of items whose texts differ in code points but have one canonical form.

    rows: `item_kind STRING, item_id STRING, text STRING`, one row per item.  Null texts
    pair with nothing; texts equal code point by code point aren't a pair.  Forms are
    compared once per distinct text, and only then expanded to the items that have them,
    over `salts` shares of each form's items, so that a text stored a million times is
    never gathered in one task.
    """
    scratch = Scratch(rows.sparkSession)
    forms = rows.where(F.col("text").isNotNull()).select("item_kind", "item_id", "text", canonical_column(F.col("text")).alias("canon"))
    # two hashes of a text, so that no two different texts of a form are taken for one
    of_text = F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.length("text"))
    forms = scratch.save(forms.select("item_kind", "item_id", "text", "canon", F.xxhash64("item_kind", "canon").alias("k"), of_text.alias("v")), "forms")
    several = forms.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("k")
    members = scratch.save(forms.join(several, "k", "left_semi"), "members")
    scratch.drop("forms")
    kinds = members.select("item_kind", "k", "canon", "text").distinct()
    a, b = kinds.alias("a"), kinds.alias("b")
    variants = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.item_kind") == F.col("b.item_kind")) & (F.col("a.canon") == F.col("b.canon")) & (F.col("a.text") < F.col("b.text")))
    variants = variants.select(F.col("a.item_kind").alias("item_kind"), F.col("a.text").alias("ta"), F.col("b.text").alias("tb"))
    salted = members.select("item_kind", "item_id", "text", F.pmod(F.xxhash64("item_id"), F.lit(salts)).alias("salt"))
    every = F.explode(F.array(*[F.lit(i).cast("long") for i in range(salts)]))
    left = variants.withColumn("salt", every).join(salted.withColumnsRenamed({"text": "ta", "item_id": "ia"}), ["item_kind", "ta", "salt"]).drop("salt", "ta")
    both = left.withColumn("salt", every).join(salted.withColumnsRenamed({"text": "tb", "item_id": "ib"}), ["item_kind", "tb", "salt"])
    return both.where("ia <> ib").select("item_kind", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
