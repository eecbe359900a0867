"""Comparison keys of titles and subtitles that need Unicode normalisation, as Arrow-batched functions.

Two kinds of subtitle key exist on purpose: the identity key selects an episode, the scoring key only grades one that is
already selected.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F

# Small vowels of katakana that keys write large.
SMALL_VOWELS = str.maketrans("ァィゥェォ", "アイウエオ")
# Signs that titles and subtitles are merely decorated with.
TITLE_SIGNS = "-‐‑‒–—―.・･/\\:;,_~〜()[]{}「」『』【】〈〉《》<>\"'`“”‘’"
SUBTITLE_SIGNS = "-‐‑‒–—―\"'`“”‘’「」『』【】[]［］"
# Kanji of season numbers.
SEASON_KANJI = dict(zip("一二三四五六七八九十", range(1, 11), strict=True))
# Spaces of Unicode.
SPACES = "\t\n\x0b\x0c\r \x85\xa0             　"

_SPACE_RUN = re.compile("[" + SPACES + "]+")
_READING = re.compile(r"(?<=\w)[(（《〈]([ぁ-ゖァ-ヺー・\s　]+)[)）》〉]")
_YEAR = re.compile(r"[(（]\s*(?:19|20)\d\d(?:年版|年)?\s*[)）]")
_KATAKANA_DASH = re.compile(r"(?<=[ァ-ヺヽ-ヿㇰ-ㇿｦ-ｯｱ-ﾝ])[―—](?=[ァ-ヺヽ-ヿㇰ-ㇿｦ-ｯｱ-ﾝ])")
_SEASONS = [
    re.compile(r"第\s*(\d+)\s*(?:期|シーズン|シリーズ)"),
    re.compile(r"(\d+)(?:st|nd|rd|th)\s*season"),
    re.compile(r"season\s*(\d+)"),
    re.compile(r"シーズン\s*(\d+)"),
]
_EDGE_LABEL = re.compile(r"^(?:第?\s*\d+\s*話|#\s*\d+|ep(?:isode)?\.?\s*\d+|コミュ\d+|life[. ]*(?:\d+|max(?:imum)?)(?:\s*vs\s*power[. ]*max(?:imum)?)?)", re.IGNORECASE)
_READING_GAP = re.compile(r"(?<=\w)[\s\u3000]+(?=[（(][ァ-ヺー・･\s\u3000]{6,}[）)])")
_JOINER = re.compile(r"(?<=[\d%％])[-‐‑‒–—―]|[-‐‑‒–—―](?=[\d%％])")
# Decorations of subtitles, and characters that are written in two ways.
DECORATIONS = frozenset("!?.。~〜～〰…♡♥")
FOLDED = str.maketrans("＆&／寶寳貳貮〇◯", "///宝宝弐弐○○")
# A subtitle that two services spell differently.
SLIPS = {"なにが起きてもおかしくないのでは!!?": "なにが起きてもおかしくはないのでは!!?"}
# Subtitles as recorded and as listed.
ORTHOGRAPHY = [
    ("やがて雨は止んで", "やがて雨はやんで"),
    ("初めての鉱物採集", "はじめての鉱物採集"),
    ("るらちゃんはちやほやされたい", "るらちゃんはチヤホヤされたい"),
    ("イケイケゴーゴー夏休み", "いけいけゴーゴー夏休み"),
    ("ラ・ソレイユヘ", "ラ・ソレイユへ"),
    ("俺たちの戦いはこれからだ", "俺達の戦いはこれからだ"),
    ("柏田さんと太田君と海", "柏田さんと太田くんと海"),
    ("魔物の町の住人達", "魔物の町の住人たち"),
    ("街角ギャラクシー☆彡", "街角ギャラクシー"),
    ("『自由』を", "自由"),
    ("ビーナスライン／シェルター", "ビーナスライン・シェルター"),
    ("呪館 JUKAN", "呪館"),
    ("Chiidren's Echelon", "Children's Echelon"),
    ("生の代償、死の贖い", "生の代償、死の償い"),
    ("無限の——— —アンリミテッド／レイズ・デッド—", "無限の残骸 アンリミテッド／レイズ・デッド"),
    ("プリステラ攻防戦リザルト", "プリステラ攻略戦リザルト"),
    ("思い残した記憶って、なに？", "思い出した記憶って、なに？"),
    ("魔王と勇者、勧めに従い遊園地に行く", "魔王と勇者、勤めに従い遊園地に行く"),
    ("暗黒部室", "暗黒部屋"),
    ("脳汁ブシャー", "脳汁プシャー"),
    ("デスゲーム挑まれたけどクソゲーだった", "デスゲーム挑まれたけど・・・"),
    ("オプション解放おめでとうございます", "オプション開放おめでとうございます"),
    ("天才と凡才", "天才と凡人"),
    ("バン・ブ・クルセイダーズ", "BUMP-BOO-CRUSADERS"),
    ("飯田橋の登竜 復讐のピピ", "飯田橋の昇竜 ～復讐のピピ～"),
    ("晴天の霹靂", "青天の霹靂"),
    ("スパイ昇格試験", "スパイ昇級試験"),
    ("個人的にはラブコメ希望", "個人的にはラブコメ展開希望"),
    ("体育会実行委員", "体育祭実行委員"),
    ("雪侍と昴", "雪待と昴"),
    ("坊ちゃんとアリスと二人だけの歌", "坊ちゃんとアリスの二人だけの歌"),
    ("俺はひょっとして、最終話で負けヒロインの横にいるポッと出のモブキャラなのだろうか", "俺はひょっとして、最終話でヒロインの横にいるポッと出のモブキャラなのだろうか"),
    ("集う物達", "集う者達"),
    ("水着で１日", "水着の1日"),
    ("つながるものの", "つながるもの"),
]


_REMEMBERED: dict[str, dict] = {}


def trim(s: str) -> str:
    return s.strip(SPACES)


def collapse(s: str) -> str:
    return _SPACE_RUN.sub(" ", s)


def normalise(s: str) -> str:
    """Compatibility form with detached voicing marks joined again, and small vowels of katakana written large."""
    s = unicodedata.normalize("NFKC", s)
    s = s.replace(" ゙", "゙").replace(" ゚", "゚")
    return unicodedata.normalize("NFC", s.translate(SMALL_VOWELS))


def repair_dashes(s: str) -> str:
    """A dash between katakana is a prolonged sound."""
    return _KATAKANA_DASH.sub("ー", s)


def search_key(s: str) -> str:
    """For searching: corner brackets and parentheses are blanks, readings in double angle brackets are gone."""
    s = re.sub(r"《[^》]*》|≪[^≫]*≫", " ", s)
    return collapse(trim(normalise(re.sub(r"[『』()（）]", " ", s))))


def without_readings(s: str) -> str:
    """Readings in kana alone behind the word that they belong to are left out; other parentheses stay."""
    return _READING.sub("", s)


def title_key(s: str) -> str:
    """Equal for titles that differ in presentation; letters and numbers, seasons among them, are kept."""
    s = repair_dashes(normalise(_YEAR.sub("", s))).lower()
    s = re.sub("第([" + "".join(SEASON_KANJI) + "])期", lambda m: f"第{SEASON_KANJI[m[1]]}期", s)
    for form in _SEASONS:
        s = form.sub(r"\1期", s)
    s = re.sub(r"(?<!\d)1期\s*$", "", s)
    return "".join(c for c in s if c not in SPACES and c not in TITLE_SIGNS)


def subtitle_key(s: str) -> str:
    s = search_key(without_readings(s)).lower()
    return "".join(c for c in s if c not in SPACES and c not in SUBTITLE_SIGNS)


def identity_key(s: str) -> str:
    """The key that selects an episode: no label before the subtitle, no exclamation at its end."""
    key = subtitle_key(s)
    key = SLIPS.get(key, key)
    m = _EDGE_LABEL.match(key)
    return re.sub(r"・(?=[前後]編$)", "", key[m.end() :] if m else key).rstrip("!?")


def joiner_dashes(s: str) -> str:
    """A dash beside a number or a percent sign is a prolonged sound."""
    return _JOINER.sub("ー", s)


def scoring_key(s: str) -> str:
    """The key that grades a selected episode: known spellings, decorations and accents of Latin letters do not count."""
    s = _READING_GAP.sub("", s).replace("一日", "1日")
    for written, meant in ORTHOGRAPHY:
        s = s.replace(written, meant)
    s = joiner_dashes(re.sub("・{2,}", "", s).replace("』『", "／").replace("」「", "／"))
    out, latin = [], False
    for ch in unicodedata.normalize("NFD", subtitle_key(s)):
        if unicodedata.category(ch) == "Mn":
            if latin:
                continue
        else:
            latin = "a" <= ch <= "z" or "\u00c0" <= ch < "\u0250"
        out.append(ch)
    key = unicodedata.normalize("NFC", "".join(out)).translate(FOLDED)
    key = "".join(c for c in key if c not in DECORATIONS and unicodedata.category(c) != "Cf")
    m = _EDGE_LABEL.match(key)
    return key[m.end() :] if m else key


def shorten(s: str, most: int) -> str:
    """At most ``most`` bytes of UTF-8, with an ellipsis where something is cut; never half a character."""
    raw = s.encode("utf-8")
    if len(raw) <= most:
        return s
    if most < 3:
        return ""
    return raw[: most - 3].decode("utf-8", errors="ignore").rstrip(SPACES) + "…"


def column(key: Callable[[str], str], returns: str = "string"):
    """A key as a function of columns; null stays null, and each worker remembers recent texts."""
    name = key.__name__

    @F.pandas_udf(returns)
    def of(texts: pd.Series) -> pd.Series:
        known = _REMEMBERED.setdefault(name, {})
        if len(known) > 50_000:
            known.clear()
        out = []
        for t in texts:
            if t is not None and t not in known:
                known[t] = key(t)
            out.append(None if t is None else known[t])
        return pd.Series(out, dtype=object)

    return of
