"""Text that looks the same, brought to one form.

Texts are exploded to positioned code points, joined with a broadcast table of decompositions and look-alikes, their
combining marks ordered by class, recomposed, and the strings rebuilt. The table covers width, precomposed letters,
ligatures, voicing marks, blanks and invisible characters of all Unicode, from Python's character database, and the
look-alikes below. Case, size of kana, accents, voicing, punctuation and the presence of a blank are kept.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.session import checkpointed

# Letters that look like another letter, as (letters, the letters they are taken for).
LOOKALIKES = [
    # Cyrillic
    ("АВЕКМНОРСТХЅІЈҮԌԚԜѴ", "ABEKMHOPCTXSIJYGQWV"),
    ("аеорсухѕіјһԁԛԝѵӏ", "aeopcyxsijhdqwvl"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϺ", "ABEZHIKMNOPTYXCM"),
    ("αγιονρυϲϳ", "ayiovpucj"),
    # Latin letters of other uses
    ("ɑɡıȷ", "agij"),
    # Coptic
    ("ⲀⲂⲤⲈⲎⲒⲔⲘⲚⲞⲢⲦⲨⲬ", "ABCEHIKMNOPTYX"),
    # Lisu
    ("ꓐꓑꓓꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓤꓥꓦ", "BPDGKJCZFMNLSRꓤΛV"),
    # Armenian
    ("ՕՍօհոսց", "OUohnug"),
    # Cherokee
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏃᏆᏔᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYZIWSLCPKB"),
    # Kana and kanji
    ("一卜口力夕二工八へ", "ートロカタニエハヘ"),
]
#: Code points without any look, besides those of category Cf.
INVISIBLE = [0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
KEPT_TAGS = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Code points, as ranges, in which a text without mapped ones may lie to count as its own form at once.
PLAIN_BLOCKS = [(0x20, 0x7E), (0xA1, 0xFF), (0x2010, 0x2027), (0x2030, 0x203E), (0x2190, 0x27BF), (0x3001, 0x3096), (0x30A1, 0x30FF), (0x3400, 0x9FFF)]


def _lookalikes() -> dict[str, str]:
    out: dict[str, str] = {}
    for a, b in LOOKALIKES:
        if len(a) != len(b):
            raise AssertionError((a, b))
        out |= dict(zip(a, b, strict=True))
    return out


@lru_cache(maxsize=1)
def character_map() -> dict[str, str]:
    """Every code point that does not stand for itself, and the decomposed code points that it stands for."""
    same = _lookalikes()
    gone = {chr(c) for c in INVISIBLE}

    def expand(ch: str) -> str:
        if ch == "\t" or unicodedata.category(ch) == "Zs":
            return " "
        if ch in gone or unicodedata.category(ch) == "Cf":
            return ""
        if ch in "゛゜":
            return "゙" if ch == "゛" else "゚"
        d = unicodedata.decomposition(ch).split()
        if d and d[0].startswith("<"):
            target = [chr(int(x, 16)) for x in d[1:]]
            letters = d[0] == "<compat>" and all(unicodedata.category(t)[0] == "L" for t in target)
            if d[0] not in KEPT_TAGS and not letters:
                return ch
            return "".join(expand(t) for t in target)
        if d:
            return "".join(expand(chr(int(x, 16))) for x in d)
        return same.get(ch, ch)

    out = {}
    # the other planes hold no mapped character
    for c in [*range(0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE1000)]:
        ch = chr(c)
        if 0xAC00 <= c < 0xD7A4:
            out[ch] = unicodedata.normalize("NFD", ch)  # Hangul syllables have their letters by rule
        elif ch in same or ch in gone or ch in "\t゛゜" or unicodedata.category(ch) in ("Cf", "Zs") or unicodedata.decomposition(ch):
            to = expand(ch)
            if to != ch:
                out[ch] = to
    return out


@lru_cache(maxsize=1)
def _by_code() -> dict[int, str]:
    return {ord(a): b for a, b in character_map().items()}


def jamo(ch: str) -> int:
    """Place of a Hangul letter among those that compose: from 0 for leading ones, from 100 for vowels, from 200 for trailing ones; -1 for others."""
    c = ord(ch)
    return c - 0x1100 if 0x1100 <= c < 0x1113 else 100 + c - 0x1161 if 0x1161 <= c < 0x1176 else 200 + c - 0x11A7 if 0x11A8 <= c < 0x11C3 else -1


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Canonical pairs (letter and mark) and the letter that they compose to."""
    out = {}
    for c in range(0xC0, 0x30000):
        ch = chr(c)
        d = unicodedata.decomposition(ch).split()
        if len(d) == 2 and not d[0].startswith("<"):
            pair = chr(int(d[0], 16)) + chr(int(d[1], 16))
            if unicodedata.normalize("NFC", pair) == ch and unicodedata.combining(pair[1]):
                out[pair] = ch
    return out


@lru_cache(maxsize=1)
def plain_pattern() -> str:
    """Matches texts that are their own form as every character of them is: no mapped one, no mark."""
    mapped = character_map()
    runs: list[list[int]] = []
    for low, high in PLAIN_BLOCKS:
        for c in range(low, high + 1):
            ch = chr(c)
            if unicodedata.combining(ch) or unicodedata.normalize("NFC", mapped.get(ch, ch)) != ch:
                continue
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "^[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]*$"


def skeleton(text: str) -> str:
    """The form of one text, composed, as ``unify_texts`` gives it: for keys made inside other operators' functions."""
    return unicodedata.normalize("NFC", text.translate(_by_code()))


def _character_table(spark: SparkSession) -> DataFrame:
    """(ch, parts ARRAY<STRUCT<c, ccc, j>>) of mapped characters, combining marks and Hangul letters; some 21,000 rows, fixed by Unicode."""
    table = dict(character_map())
    for c in [*range(0x300, 0x1E95B), *range(0x1100, 0x1200)]:
        ch = chr(c)
        if (unicodedata.combining(ch) or jamo(ch) >= 0) and ch not in table:
            table[ch] = ch
    rows = [(k, [(c, unicodedata.combining(c), jamo(c)) for c in v]) for k, v in sorted(table.items())]
    return spark.createDataFrame(rows, "ch string, parts array<struct<c:string,ccc:int,j:int>>")


def _composition_table() -> Column:
    """Letters that marks compose, by mark and letter; the marks of kana come first, as they are looked for most."""
    by_mark: dict[str, dict[str, str]] = {"\u3099": {}, "\u309a": {}}
    for pair, whole in sorted(compositions().items()):
        by_mark.setdefault(pair[1], {})[pair[0]] = whole
    bases_of = lambda bases: ", ".join(f"'{a}', '{b}'" for a, b in bases.items())
    return F.expr("map(" + ", ".join(f"'{mark}', map({bases_of(bases)})" for mark, bases in by_mark.items()) + ")")


def _marks_composed(letter: Column, lookup: Column) -> Column:
    """The string of a letter and its marks, as an array of (c, ccc) ordered by class.

    The state keeps the letter, the marks that did not compose with it, and the class of the last of these: a mark
    composes unless an equal or higher class stands between.
    """
    zero = F.struct(F.lit("").alias("open"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, p: Column) -> Column:
        composed = F.when((acc["open"] != "") & (acc["last"] < p["ccc"]), lookup[p["c"]][acc["open"]])
        first = F.struct(p["c"].alias("open"), F.lit("").alias("rest"), F.lit(0).alias("last"))
        joined = F.struct(composed.alias("open"), acc["rest"].alias("rest"), acc["last"].alias("last"))
        left = F.struct(acc["open"].alias("open"), F.concat(acc["rest"], p["c"]).alias("rest"), p["ccc"].alias("last"))
        return F.when(p["ccc"] == 0, first).when(composed.isNotNull(), joined).otherwise(left)

    return F.aggregate(letter, zero, step, lambda acc: F.concat(acc["open"], acc["rest"]))


def _syllable(letter: Column) -> Column:
    """The string of an array that begins with a leading Hangul letter and a vowel: one syllable, and what follows it."""
    trailing = F.when((F.size(letter) > 2) & (F.try_element_at(letter, F.lit(3))["j"] >= 200), F.try_element_at(letter, F.lit(3))["j"] - 200).otherwise(0)
    code = F.lit(0xAC00) + (letter[0]["j"] * 21 + letter[1]["j"] - 100) * 28 + trailing
    whole = F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")
    rest = F.slice(letter, F.when(trailing > 0, 4).otherwise(3), F.size(letter))
    return F.concat(whole, F.array_join(F.transform(rest, lambda x: x["c"]), ""))


def _recomposed(points: Column) -> Column:
    """The string of an array of (c, ccc, j): cut into letters with their marks, the marks sorted by class, then composed.

    Every step is linear in the text: a letter is a slice of it, the letters are joined once.
    """
    lookup = _composition_table()

    def joins(i: Column) -> Column:
        """A mark joins any letter, a vowel of Hangul its leading letter, a trailing letter its vowel."""
        j, before = points[i]["j"], points[i - 1]["j"]
        return (points[i]["ccc"] > 0) | ((j >= 100) & ((j < 200) & before.between(0, 99) | (j >= 200) & before.between(100, 199)))

    def one(letter: Column) -> Column:
        hangul = (letter[0]["j"] >= 0) & (letter[0]["j"] < 100) & letter[1]["j"].between(100, 199)
        plain = ~F.exists(letter, lambda x: x["ccc"] > 0)
        pair = (F.size(letter) == 2) & (letter[1]["ccc"] > 0) & (letter[0]["ccc"] == 0)
        # stable in its class: the place goes before the character
        by_class = F.transform(F.array_sort(F.transform(letter, lambda x, i: F.struct(x["ccc"].alias("ccc"), i.alias("i"), x["c"].alias("c")))), lambda x: F.struct(x["c"].alias("c"), x["ccc"].alias("ccc")))
        return (
            F.when(F.size(letter) == 1, letter[0]["c"])
            .when(pair, F.coalesce(lookup[letter[1]["c"]][letter[0]["c"]], F.concat(letter[0]["c"], letter[1]["c"])))
            .when(hangul & plain, _syllable(letter))
            .when(plain, F.array_join(F.transform(letter, lambda x: x["c"]), ""))
            .otherwise(_marks_composed(by_class, lookup))
        )

    def joined(starts: Column) -> Column:
        until = lambda k: F.coalesce(F.try_element_at(starts, k + 1), F.size(points))
        letters = F.transform(F.sequence(F.lit(1), F.size(starts)), lambda k: F.slice(points, starts[k - 1] + 1, until(k) - starts[k - 1]))
        return F.array_join(F.transform(letters, one), "")

    starts = F.filter(F.sequence(F.lit(0), F.size(points) - 1), lambda i: F.when(i == 0, True).otherwise(~joins(i)))
    return F.transform(F.array(starts), joined)[0]  # an array of one, so that the starts are found once


def unify_texts(texts: DataFrame, column: str = "text") -> DataFrame:
    """(text, form) for every distinct non-null text of ``column``: ``form`` is equal for texts that look the same.

    Blank and empty texts are texts as any other; texts of invisible characters alone get the empty form. Marks are
    canonically ordered and composed, single Hangul letters too (a syllable with marks in it keeps its letters). Texts are
    whole, of any length: one text's characters are the largest thing a task holds. Characters travel with 128 bits of
    their text's hash, the text itself with its first character alone, so that the shuffle is linear in the text.
    """
    spark = texts.sparkSession
    distinct = texts.select(F.col(f"`{column}`").alias("text")).where("text is not null").distinct()
    plain = distinct.where(F.col("text").rlike(plain_pattern())).select("text", F.col("text").alias("form"))
    odd = distinct.where(~F.col("text").rlike(plain_pattern())).withColumn("h1", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))
    points = odd.select("h1", "h2", "text", F.posexplode(F.split("text", "")).alias("pos", "ch"))
    points = points.select("h1", "h2", F.when(F.col("pos") == 0, F.col("text")).alias("text"), "pos", "ch")
    table = F.broadcast(_character_table(spark))
    mapped = points.join(table, "ch", "left")
    parts = F.when(F.col("parts").isNull(), F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.lit(-1).alias("j")))).otherwise(F.col("parts"))
    # one row a character goes into the shuffle: invisible ones as empty arrays, so that no text is lost
    gathered = mapped.groupBy("h1", "h2").agg(F.max("text").alias("text"), F.array_sort(F.collect_list(F.struct("pos", parts.alias("p")))).alias("a"))
    flat = gathered.select("text", F.flatten(F.transform("a", lambda x: x["p"])).alias("points"))
    odd_ones = F.exists("points", lambda x: (x["ccc"] > 0) | (x["j"] >= 100))
    straight = F.array_join(F.transform("points", lambda x: x["c"]), "")
    form = F.when(odd_ones, _recomposed(F.col("points"))).otherwise(straight)
    return plain.unionByName(flat.select("text", form.alias("form")))


def lookalike_classes(records: DataFrame) -> DataFrame:
    """(tbl, id, text, form, class_id) for every record(tbl, id, text) with a text; class_id is a hash of tbl and form.

    Null texts have no look and no row; all other rows are kept, repeated rows too.
    """
    forms = unify_texts(records, "text")
    joined = records.select("tbl", "id", "text").where("text is not null").join(forms, "text")
    return joined.select("tbl", "id", "text", "form", F.xxhash64("tbl", "form").alias("class_id"))


def lookalike_pairs(records: DataFrame) -> DataFrame:
    """(tbl, id_a, id_b), id_a < id_b, distinct: records of one table that look the same but are different strings.

    Blank texts (of blanks and invisible characters alone) are left out. Only classes that have two spellings reach the join; their members
    are written down and paired across spellings, which is the size of the result itself.
    """
    forms = unify_texts(records, "text").where(~F.col("form").rlike(r"^\s*$"))
    spelt = records.select("tbl", "text").where("text is not null").distinct().join(forms, "text")
    several = spelt.groupBy("tbl", "form").agg(F.count("*").alias("n"), F.collect_list("text").alias("texts")).where("n > 1")
    members = checkpointed(several.select("tbl", "form", F.explode("texts").alias("text")).join(records.select("tbl", "text", "id").where("id is not null").distinct(), ["tbl", "text"]))
    a = members.select("tbl", "form", F.col("text").alias("ta"), F.col("id").alias("a"))
    b = members.select("tbl", "form", F.col("text").alias("tb"), F.col("id").alias("b"))
    pairs = a.join(b, ["tbl", "form"]).where("ta <> tb and a < b")
    return pairs.select("tbl", F.col("a").cast("long").alias("id_a"), F.col("b").cast("long").alias("id_b")).distinct()
