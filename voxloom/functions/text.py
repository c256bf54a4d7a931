"""Cleaning, predicates and counts over text, as column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as a class that Java and RE2 both read, word lists, and patterns of the text format.
WS = r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NAME_EDGE = "：:，,。 .「」『』【】[]()（）"
CHAPTER_TITLE = "^(?:序幕|终幕|尾声|后记|第[一二三四五六七八九十百零〇0-9]+[幕章话卷])$"
DECORATION = r"^[─\-—=＊*·\t-\r\x20\x{3000}]+$"
BREAK_TITLE = "插图"
QUOTE = "「([^」]*)」"
GENERIC_NAMES = (
    "中间人 交易者 同行 商人 小毛头 市井无赖 年轻人 年轻商人 开店者 情报贩子 提议者 新手 旅行商人 旅行商人亲戚 经验丰富的商人 行商人 老板 小的 男子 女人 "
    "店员 女店员 店老板 骑士 农夫 马夫 采购人员 商行代表 行长 丰收之神 贤狼 神秘少女 咱 汝"
).split()
SELF_PRONOUNS = "咱 汝 俺 吾 吾辈 妾身 在下 小生 本座 本王 朕 老身 奴家 鄙人 贫道".split()
LOW_SIGNAL_NAMES = "咱 汝 你 我 他 她 它 我们 他们 她们".split()
LOW_SIGNAL_TITLES = "中间人 交易者 同行 商人 小毛头 小的 市井无赖 年轻人 开店者 情报贩子 提议者 新手 旅行商人 旅行商人亲戚 行商人 老板 贵族".split()
LOW_SIGNAL_MARKERS = "嗯 呃 啊 唔 喔 哦 呵呵 哈哈 糟糕 抱歉 没问题 说的也是 那么 算了 好的 谢谢".split()
GROUP_NPC = "非重要角色 路人 路人角色 路人甲 普通路人 村民 村民们 村民群体 群众 人群 众人 旁观者 小村落的村民".split()
GROUP_NPC_WORDS = "村民群体 村民们 路人 非重要角色 群众 人群 众人".split()
STATUSES = ("known", "mystery", "npc", "ambiguous", "review")
IMPORTANCE = ("minor", "medium", "major")
JSON_SIGNS = '{}[]":,'


def any_of(c: Column, words: list[str]) -> Column:
    """Whether the text contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def clean_text(c: Column) -> Column:
    """White space collapsed to one space, ends stripped; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, WS + "+", " ")), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def clean_name(c: Column) -> Column:
    """Stripped, then without outer punctuation and brackets."""
    return F.btrim(strip(F.coalesce(c, F.lit(""))), F.lit(NAME_EDGE))


def slug(c: Column) -> Column:
    """Runs of characters that aren't letters, digits or underscores become one underscore."""
    s = F.btrim(F.regexp_replace(clean_text(c), r"[^\p{L}\p{N}_]+", "_"), F.lit("_"))
    return F.when(s == "", "unknown").otherwise(s)


def safe_model(c: Column) -> Column:
    return slug(F.translate(c, ":/", "__"))


def truncate(c: Column, n: int) -> Column:
    t = clean_text(c)
    return F.when(F.length(t) > n, F.concat(F.left(t, F.lit(n - 1)), F.lit("…"))).otherwise(t)


def unique_strings(values: Column, limit: int | None = None) -> Column:
    """Cleaned non-empty strings, first occurrence kept; null is the empty list."""
    cleaned = F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), clean_text), lambda x: x != ""))
    return F.slice(cleaned, 1, limit) if limit is not None else cleaned


def safe_double(c: Column, default: float) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(default))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def clean_status(c: Column) -> Column:
    t = clean_text(c)
    return F.when(t.isin(*STATUSES), t).otherwise("review")


def join_field(old: Column, new: Column, most: int = 12) -> Column:
    """' / '-joined parts; a new part is appended once, the last `most` are kept."""
    parts = F.filter(F.transform(F.split(old, " / "), F.trim), lambda x: x != "")
    both = F.when(F.array_contains(parts, new), parts).otherwise(F.array_append(parts, new))
    kept = F.slice(both, F.greatest(F.lit(1), F.size(both) - (most - 1)), F.lit(most))
    return F.when(new == "", old).when(old == "", new).otherwise(F.array_join(kept, " / "))


def is_safe_key(c: Column) -> Column:
    return (F.length(c) > 1) & ~c.isin(*GENERIC_NAMES)


def is_related(a: Column, b: Column) -> Column:
    """Equal names, or both of three characters or more and one ends with the other."""
    return is_safe_key(a) & is_safe_key(b) & ((a == b) | ((F.length(a) >= 3) & (F.length(b) >= 3) & (F.endswith(a, b) | F.endswith(b, a))))


def is_useful_marker(c: Column) -> Column:
    """A speech marker worth keeping when characters are discovered."""
    short = (F.length(c) <= 8) & ~c.rlike('[。！？!?；;：:“”"「」『』]') & ~c.isin(*GENERIC_NAMES)
    return (c != "") & (c.isin(*SELF_PRONOUNS) | (short & ~(c.rlike("[你您我他她它]") & (F.length(c) > 4))))


def is_usable_marker(c: Column) -> Column:
    """A speech marker that may decide who speaks."""
    plain = F.length(c).between(2, 4) & ~c.isin(*LOW_SIGNAL_MARKERS) & ~c.rlike("[。！？!?；;：:，、,.…「」『』“”\"']") & c.rlike("[A-Za-z0-9一-鿿]")
    return c.isin(*SELF_PRONOUNS) | plain


def name_appears(name: Column, text: Column) -> Column:
    return (F.length(name) > 1) & ~name.isin(*LOW_SIGNAL_NAMES) & F.contains(text, name)


def is_group_npc(c: Column) -> Column:
    return c.isin(*GROUP_NPC) | any_of(c, GROUP_NPC_WORDS)


def parent_scene(c: Column) -> Column:
    return F.regexp_replace(c, "-r[0-9]+$", "")


def chunk_number(c: Column) -> Column:
    return F.coalesce(F.regexp_extract(c, "-r([0-9]+)$", 1).try_cast("int"), F.lit(0))


def importance_level(c: Column) -> Column:
    return F.when(c == "major", 2).when(c == "medium", 1).otherwise(0)


def merge_importance(old: Column, new: Column) -> Column:
    level = F.greatest(importance_level(F.coalesce(old, F.lit("minor"))), importance_level(F.coalesce(new, F.lit("minor"))))
    return F.element_at(F.array(*map(F.lit, IMPORTANCE)), level + 1)


def vote_key(entity: Column, status: Column, display: Column) -> Column:
    shown = clean_text(display)
    return F.coalesce(F.nullif(clean_text(entity), F.lit("")), F.concat(clean_status(status), F.lit(":"), F.when(shown == "", "unknown").otherwise(shown)))


def _count(c: Column, others: str) -> Column:
    return F.length(F.regexp_replace(c, others, ""))


def character_counts(c: Column) -> dict[str, Column]:
    """Ideographs, ASCII letters and digits, spaces, JSON punctuation, others."""
    han, ascii_, space = _count(c, "[^一-鿿]"), _count(c, "[^A-Za-z0-9]"), _count(c, f"[^{WS[1:]}")
    signs = _count(c, r'[^{}\[\]":,]')
    return {"han": han, "ascii": ascii_, "space": space, "signs": signs, "other": F.length(c) - han - ascii_ - signs}


def mystery_id(scene: Column, name: Column) -> Column:
    return F.left(F.concat(F.lit("mystery_"), slug(scene), F.lit("_"), slug(name)), F.lit(160))


def evidence_id(v: Column) -> Column:
    """What a piece of evidence (VARIANT) points at: an object's text, paragraph or dialogue, else the value itself."""
    first = F.coalesce(*[F.nullif(clean_text(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")) for k in ("text", "paragraph_id", "dialogue_id")])
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    return F.coalesce(F.when(is_object, first).otherwise(clean_text(F.try_variant_get(v, "$", "string"))), F.lit(""))


def estimate_tokens(c: Column) -> Column:
    """Tokens by character class: 1.6 an ideograph, 0.4 an ASCII letter or digit, 0.2 a space, 0.6 any other; rounded up."""
    n = character_counts(c)
    tenths = 16 * n["han"] + 4 * n["ascii"] + 2 * n["space"] + 6 * (F.length(c) - n["han"] - n["ascii"] - n["space"])
    return F.ceil(tenths / 10).cast("int")


def budget_status(tokens: Column, target: int, hard: int) -> Column:
    return F.when(tokens > hard, "over_limit").when(tokens > target, "near_limit").otherwise("ok")


def is_title(c: Column) -> Column:
    return c.rlike(CHAPTER_TITLE)


def is_break(c: Column) -> Column:
    return (c == BREAK_TITLE) | c.rlike(DECORATION)


def is_structural(c: Column) -> Column:
    return is_break(c) | is_title(c) | c.isin("序", "幕", "终", "第")


def outside_quote(text: Column, start: Column, end: Column) -> Column:
    """The paragraph without [start, end), bounds clamped, white space collapsed."""
    n = F.length(text)
    a = F.least(F.greatest(start, F.lit(0)), n)
    b = F.least(F.greatest(end, a), n)
    return clean_text(F.concat(F.substring(text, F.lit(1), a), F.substring(text, b + 1, n)))


def dialogue_kind(text: Column, start: Column, end: Column) -> Column:
    return F.when(outside_quote(text, start, end) == "", "standalone").otherwise("inline")
