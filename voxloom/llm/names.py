"""Names as people type them, taken apart: decoration, honorifics, order, script."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from voxloom.llm.unify import canonical

# Readings of the syllables used to write foreign names.
READINGS = dict(x.split(":") for x in (
    "乌:wu 乔:qiao 伦:lun 伯:bo 佩:pei 克:ke 兰:lan 内:nei 凯:kai 利:li 加:jia 劳:lao 勒:le 南:nan 卡:ka 卢:lu 厄:e 古:gu 史:shi 吉:ji "
    "哈:ha 图:tu 坎:kan 坦:tan 基:ji 塔:ta 塞:sai 夏:xia 多:duo 奇:qi 奈:nai 奎:kui 奥:ao 妮:ni 姆:mu 威:wei 娜:na 宁:ning 安:an 密:mi "
    "尔:er 尼:ni 巴:ba 布:bu 希:xi 帕:pa 库:ku 弗:fu 德:de 恩:en 戈:ge 托:tuo 拉:la 提:ti 斯:si 施:shi 普:pu 曼:man 杜:du 杰:jie 林:lin "
    "查:cha 格:ge 桑:sang 梅:mei 森:sen 欧:ou 比:bi 汉:han 沃:wo 法:fa 泰:tai 洛:luo 海:hai 温:wen 特:te 玛:ma 珀:po 琳:lin 琼:qiong "
    "瑞:rui 瑟:se 瓜:gua 瓦:wa 皮:pi 盖:gai 福:fu 科:ke 穆:mu 简:jian 米:mi 索:suo 纳:na 缪:miu 罗:luo 肯:ken 舍:she 艾:ai 芬:fen 苏:su "
    "若:ruo 莉:li 莎:sha 莫:mo 莱:lai 菲:fei 萨:sa 蒂:di 蒙:meng 薇:wei 西:xi 让:rang 诺:nuo 贝:bei 赫:he 达:da 迪:di 里:li 金:jin "
    "门:men 阿:a 隆:long 雷:lei 霍:huo 露:lu 马:ma 麦:mai 齐:qi"
).split())
# Characters written for a syllable of the same sound.
READINGS |= dict(x.split(":") for x in (
    "丽:li 蜜:mi 姬:ji 季:ji 蓝:lan 妲:da 咖:ka 可:ke 嗯:en 朵:duo 礼:li 喏:nuo 柯:ke 帝:di 荷:he 酥:su 蛤:ha 惜:xi 佛:fu 鹿:lu 撒:sa 她:ta 那:na "
    "丝:si 忒:te 分:fen 鲁:lu 菈:la 歌:ge 洁:jie 蕊:rui 其:qi 蕾:lei 琦:qi 按:an 霏:fei 伊:yi 茜:xi 奴:nu 耶:ye 亚:ya 丹:dan 维:wei 修:xiu 墨:mo 的:de 爱:ai 来:lai 木:mu 纱:sha 笛:di"
).split())
# Traditional forms that occur in names, and their simplified forms.
SIMPLE = dict(zip(
    "喬倫蘭凱勞盧圖爾內寧納繆薩讓貝達門馬麥齊簡羅萊蘇蓋瑪瓊歐漢溫諾烏傑庫隴頓賓費韋黃鷹澤倉葉櫻條鳥靜雲瀨鳴動長霧島風間優陽誠紗輝楓鈴蓮結潔來愛麗樹曉實彥黑確認謎個說誰複難義團隊見習魔騎書記鍊煉師",
    "乔伦兰凯劳卢图尔内宁纳缪萨让贝达门马麦齐简罗莱苏盖玛琼欧汉温诺乌杰库陇顿宾费韦黄鹰泽仓叶樱条鸟静云濑鸣动长雾岛风间优阳诚纱辉枫铃莲结洁来爱丽树晓实彦黑确认谜个说谁复难义团队见习魔骑书记炼炼师",
))
# Words that stand for a part in a scene rather than for a person.
ROLES = frozenset("路人 神秘人 少女 队长 男声 女声 侍女 士兵甲 士兵乙 大叔 老人 旅人 声音 猎人 魔女 村长 少年 村民 老板娘 卫兵 那家伙 商人 骑士 旁白 作者 全体 众人 群众 路人甲 路人乙 女子 男子 女人 男人 老妇 老者 孩子 店主 士兵 我 他 她 它 某人".split())
HONORIFICS = ("家的那位", "先生", "小姐", "阁下", "前辈", "殿下", "大人", "老师", "女士", "陛下", "同学", "夫人", "酱", "君", "卿")
TITLES = ("守门官", "见习魔女", "骑士长", "宫廷书记", "副团长", "炼金师")
LATIN_TITLE = re.compile(r"^(?:dr|mr|mrs|ms|prof|lady|lord|sir|miss|master)\b\.?\s+", re.I)

_ASIDE = re.compile(r"\s*(?:\([^()]*\)|→.*|/\s.*|\[[^\[\]]*\])\s*$")
_EDGE = " \t\n\"'“”「」『』[]【】<>《》。,、!?~…:;·="
_HAN = re.compile("[㐀-䶿一-鿿々]")
EPITHET = re.compile(r"^[㐀-鿿]{1,4}[的之][㐀-鿿]{3,}$")


@dataclass(frozen=True)
class Name:
    """kind: full, single, initial, epithet, role. parts as typed; joined: all parts, order as typed."""

    kind: str
    parts: tuple[str, ...]
    honorific: str = ""
    turned: bool = False  # "Family, Given"

    @property
    def joined(self) -> str:
        return "".join(self.parts)


def simplified(text: str) -> str:
    return "".join(SIMPLE.get(c, c) for c in text)


@lru_cache(maxsize=1 << 16)
def letters(part: str) -> str:
    """Lower-case letters without accents; foreign-name syllables by their reading, other ideographs as they are."""
    plain = "".join(c for c in unicodedata.normalize("NFD", part.casefold()) if not unicodedata.combining(c) and (c.isalnum()))
    return "".join(READINGS.get(c, c) for c in plain) if is_foreign(plain) else plain


def is_foreign(part: str) -> bool:
    """Ideographs written for the sounds of a foreign name: all of two, or all but one in every four of a longer part."""
    han = [c for c in part if _HAN.match(c)]
    unknown = sum(c not in READINGS for c in han)
    return unknown == 0 if len(han) < 3 else 4 * unknown <= len(han) + 1


def undecorated(value: str) -> str:
    """Canonical simplified text without quotes, asides and outer punctuation."""
    text = simplified(canonical(value)).strip(_EDGE)
    while (less := _ASIDE.sub("", text).strip(_EDGE)) != text and less:
        text = less
    return text


@lru_cache(maxsize=1 << 16)
def parse(value: str | None, titles: tuple[str, ...] = ()) -> Name | None:
    """The name in a typed value, None if there is nothing to read; titles before a name, longest first, are left out."""
    if not value:
        return None
    text = undecorated(value)
    if not text:
        return None
    if text in ROLES:
        return Name("role", (text,))
    if EPITHET.match(text):
        return Name("epithet", (text.replace("之", "的", 1),))
    text = LATIN_TITLE.sub("", text)
    for t in titles or TITLES:
        if text.startswith(t) and len(text) > len(t) + 1:
            text = text[len(t) :].lstrip(" ·")
    honorific = ""
    if _HAN.search(text):
        for h in HONORIFICS:
            if text.endswith(h) and len(text) >= len(h) + 2:
                text, honorific = text[: -len(h)].rstrip(" ·"), h
                break
    if text in ROLES:
        return Name("role", (text,))
    turned = "," in text
    parts = [p for p in re.split(r"[\s·=_,/\-]+", text) if p.strip(". ")]
    if len(parts) == 1 and not _HAN.search(text):
        parts = [p for p in re.split(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", parts[0]) if p]
    if turned and len(parts) == 2:
        parts = parts[::-1]
    if not parts:
        return None
    plain = [p.strip(".") for p in parts]
    if len(plain) >= 2:
        short = [len(p) == 1 and (p in READINGS or not _HAN.match(p)) for p in plain]
        if any(short) and not all(short):
            return Name("initial", tuple(plain), honorific, turned)
        return Name("full", tuple(plain), honorific, turned)
    word = plain[0]
    if _HAN.search(word):
        sounds = all(c in READINGS for c in word)
        if (is_foreign(word) and len(word) >= 6) or (not sounds and len(word) in (3, 4, 5)):
            return Name("full", (word,), honorific)
    return Name("single", (word,), honorific)


def distance(a: str, b: str, most: int = 1 << 30) -> int:
    """Damerau-Levenshtein distance with adjacent transpositions, unrestricted, so that it is a metric; above `most`, most + 1."""
    if a == b:
        return 0
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not set(a) & set(b):
        return min(max(len(a), len(b)), most + 1)
    far = len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        match = 0
        before, row = rows[-1], [far, i]
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                match = j
                least = before[j]
            else:
                least = min(before[j], row[j], before[j + 1]) + 1
            jump = rows[k][m] + i - k + j - m - 1
            row.append(jump if jump < least else least)
        last[x] = i
        rows.append(row)
    return min(rows[-1][-1], most + 1)
