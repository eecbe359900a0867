"""Linking recordings to the catalogue, fail-closed: exactly one episode, or none and the reasons.

Stages are set-oriented: titles are matched once for each distinct title, evidence is a long table of (recording, episode,
tier), tiers are counted and decided in one expression. What stays open is asked again among continuations and specials of
the title, then proved from the schedule of its day, then from the history's own recording.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import columns as C
from linkloom.functions import subtitles as S
from linkloom.functions import text as T
from linkloom.functions.names import parsed
from linkloom.operators import resolution as R
from linkloom.session import checkpointed

#: Points of the evidence; together they are the confidence.
WORK, EPISODE, SUBTITLE, PARTLY, AIRED, PROOF = 40, 30, 20, 10, 10, 90


@dataclass(frozen=True)
class LinkOptions:
    """What a run is asked for: the least confidence of a link, and where organised files go (None: beside the source)."""

    confidence: int = 90
    output: str | None = None


#: Tiers of episode evidence in order, and whether two candidates in one veto the rest.
TIERS = [
    ("zero", True),
    ("label and subtitle", True),
    ("number and subtitle", True),
    ("place and subtitle", False),
    ("subtitle", False),
    ("fraction", True),
    ("label", True),
    ("number", True),
    ("local number", True),
    ("cour offset", True),
    ("final", True),
]
#: Tiers that need more than a number, as works beyond the title itself may only answer so.
STRICT = ["label and subtitle", "number and subtitle", "place and subtitle", "subtitle"]
#: Ways of proof by schedule and history.
PROOFS = ["schedule", "trusted channel", "corroborated schedule", "shared cour", "history"]

# What a continuation of a title, or a special of it, begins with behind the title (as a key).
CONTINUATION = "(?:第?[0-9]+(?:期|クール(?:目)?)|season[0-9]+|[0-9]+(?:st|nd|rd|th)(?:season|シーズン)|シーズン[0-9]+|part[0-9]+|netflixオリジナル|tv放送)"
SPECIAL = "(?:ova|oad|特別編|special)"
COUR = "(?:第?([0-9]+)クール(?:目)?)"


def parse_recordings(files: DataFrame, path: str = "path", broadcast: bool = False) -> DataFrame:
    """files with a record id (rec) and the fields of their names beside all other columns."""
    return files.withColumn("__p", parsed(broadcast)(path)).select(*files.columns, "__p.*")


def work_keys(works: DataFrame) -> DataFrame:
    """(work_id, title, k, season_name, media, tid, listed_tid, declared) of works; tid is null where it is no positive number."""
    tid = F.trim("syobocal_tid").try_cast("int")
    return works.select(
        F.col("id").alias("work_id"), "title", T.column(T.title_key)("title").alias("k"), "season_name", "media", F.when(tid > 0, tid).alias("tid"), F.coalesce(F.trim("syobocal_tid") != "", F.lit(False)).alias("listed_tid"), F.col("episodes_count").alias("declared")
    )


def episode_keys(works: DataFrame, episodes: DataFrame) -> DataFrame:
    """(episode_id, work_id, n, label, fraction, zero, place, local, final, episode_title, sub, part): what an episode may be known by.

    label is the number that its label says, place the rank that a special has by its sort key (in a complete list by
    counting), local its number in a list that counts on from an earlier part, final whether it is its work's last one.
    """
    said = F.trim(C.narrow(F.col("number_text")))
    blank = F.coalesce(said == "", F.lit(True))
    zero = lambda c: F.coalesce(F.lower(F.trim(C.narrow(F.col(c)))).rlike("^life[. ]*0+(?: |$)"), F.lit(False))
    e = episodes.select(
        F.col("id").alias("episode_id"),
        "work_id",
        C.episode_number(F.col("number"), F.col("number_text"), F.col("sort_number")).alias("n"),
        C.label_number(F.col("number_text")).alias("label"),
        C.fractional_label(F.col("number_text")).alias("fraction"),
        ((F.col("number") == 0) & zero("number_text") & zero("title")).alias("zero"),
        blank.alias("blank"),
        F.coalesce(said.isin("最終話", "最終回"), F.lit(False)).alias("says_final"),
        F.col("number").isNull().alias("numberless"),
        F.col("sort_number").alias("sort"),
        F.col("title").alias("episode_title"),
        T.column(T.identity_key)("title").alias("sub"),
        T.column(T.scoring_key)("title").alias("part"),
    )
    special = F.col("numberless") & ~F.col("blank") & F.col("label").isNull() & F.col("fraction").isNull()
    e = checkpointed(e.withColumn("special", special))
    listed = e.groupBy("work_id").agg(F.count("*").alias("listed"))
    whole = works.join(listed, "work_id").where("declared > 0 and listed >= declared").select("work_id", (F.col("listed") == F.col("declared")).alias("exact"))
    counted = e.where(F.col("n").isNotNull() & (F.col("blank") | F.col("label").isNotNull()))
    numbers = R.final_number(counted, "work_id", "n").select("work_id", "final", F.col("members"))
    tops = counted.groupBy("work_id").agg(F.max("n").alias("top"), F.max("sort").alias("top_sort")).join(numbers, "work_id")
    named = R.unique_or_null(e.where("says_final"), ["work_id"], "episode_id", out="named", count="names").join(e.where("says_final").groupBy("work_id").agg(F.max("sort").alias("named_sort")), "work_id")
    highest = R.unique_or_null(counted.join(tops.select("work_id", F.col("top").alias("n")), ["work_id", "n"]), ["work_id"], "episode_id", out="highest").select("work_id", "highest")
    # a label that says so holds where the numbers before it have no gap; without one, the only greatest number
    proven = F.col("final").isNotNull() & (F.col("named_sort") > F.col("top_sort"))
    last = whole.join(named, "work_id", "left").join(tops, "work_id", "left").join(highest, "work_id", "left")
    last = last.select("work_id", F.when(F.coalesce("names", F.lit(0)) == 0, F.col("highest")).when(proven, F.col("named")).alias("episode_id"), F.when(F.coalesce("names", F.lit(0)) > 0, F.col("top") + 1).alias("final_n")).where("episode_id is not null")
    local = R.local_ordinals(counted.where("sort > 0"), "work_id", "sort", "n", ["episode_id"]).select("episode_id", "local")
    ranks = R.ordinals(e.join(whole.where("exact").select("work_id"), "work_id", "left_semi"), "work_id", "sort", ["episode_id", "special"]).where("special").select("episode_id", F.col("ordinal").alias("rank"))
    out = e.join(last.drop("work_id"), "episode_id", "left").join(last.select("episode_id", F.lit(True).alias("is_last")), "episode_id", "left").join(local, "episode_id", "left").join(ranks, "episode_id", "left")
    places = F.array_distinct(F.array_compact(F.array(F.when(F.col("special"), F.col("sort")), F.col("rank"))))
    return out.select("episode_id", "work_id", F.coalesce("n", "final_n").alias("n"), "label", "fraction", "zero", places.alias("places"), "local", F.coalesce("is_last", F.lit(False)).alias("final"), "episode_title", "sub", "part")


def catalogue_keys(works: DataFrame, episodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    w = work_keys(works)
    return w, episode_keys(w, episodes)


def candidate_works(records: DataFrame, works: DataFrame) -> DataFrame:
    """(rec, work_id): works of a recording's title, narrowed to the season of its date, or to the year that its title names, where that leaves just one."""
    titles = records.select("work_title").where("work_title is not null").distinct().select(F.col("work_title").alias("id"), F.col("work_title").alias("exact"), T.column(T.title_key)("work_title").alias("k"))
    found = R.tiered_match(titles, works.select(F.col("work_id").alias("id"), F.col("title").alias("exact"), "k")).select(F.col("id").alias("work_title"), F.col("right_id").alias("work_id"))
    pairs = records.select("rec", "work_title", "recorded_date").join(found, "work_title").join(works.select("work_id", "season_name"), "work_id")
    year = C.title_year(F.col("work_title"))
    told = F.coalesce(F.concat(year.cast("string"), F.lit("-")), C.season_of(F.col("recorded_date")))
    counted = pairs.withColumn("fits", F.coalesce(F.startswith(F.lower("season_name"), told), F.lit(False)))
    seasons = counted.groupBy("rec").agg(F.count_if("fits").alias("n"))
    return counted.join(seasons, "rec").where((F.col("n") != 1) | F.col("fits")).select("rec", "work_id")


def further_works(records: DataFrame, works: DataFrame, begins: str, remakes: bool) -> DataFrame:
    """(rec, work_id): works whose title goes on behind the recording's with ``begins``; with ``remakes`` also equal titles that name a year.

    Each work is cut before its first and its last such word, so this is one join on keys.
    """
    cut = F.array_distinct(F.array(F.regexp_extract("k", f"^(.+?){begins}.*$", 1), F.regexp_extract("k", f"^(.+){begins}.*$", 1)))
    bases = works.select("work_id", F.explode(cut).alias("k")).where("k <> ''")
    if remakes:
        bases = bases.unionByName(works.where(C.title_year(F.col("title")).isNotNull()).select("work_id", "k"))
    asked = records.select("rec", T.column(T.title_key)("work_title").alias("k")).where("k <> ''")
    return asked.join(bases, "k").select("rec", "work_id").distinct()


def episode_evidence(records: DataFrame, pairs: DataFrame, episodes: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """(rec, episode_id, work_id, tier): every way in which an episode of a candidate work answers a recording.

    Pairs arise from keys that both have (a number, a subtitle, a fraction, the last episode), not from whole lists. With
    ``works``, a number beyond the longest list of the candidates is counted on in a part that its title calls a cour.
    """
    key = lambda sign, c: F.concat(F.lit(sign), c.cast("string"))
    blank = F.coalesce(F.length("sub"), F.lit(0)) == 0
    wants_last = F.coalesce(F.col("final_episode"), F.lit(False)) & (blank | F.col("sub").isin(*sorted(S.GENERIC_FINALS)))
    r = records.select("rec", "episode_number", "episode_label", "sub", wants_last.alias("wants_last")).join(pairs, "rec")
    r = r.withColumn("keys", F.array_compact(F.array(key("n", F.col("episode_number")), F.when(~blank, key("s", F.col("sub"))), key("f", F.col("episode_label")), F.when(F.col("wants_last"), "z"))))
    e = episodes.select("work_id", "episode_id", "n", "label", "fraction", "zero", "places", "local", "final", F.col("sub").alias("esub"))
    known = F.concat(
        F.array(key("n", F.col("n")), key("n", F.col("label")), key("n", F.col("local")), F.when(F.length("esub") > 0, key("s", F.col("esub"))), key("f", F.col("fraction")), F.when(F.col("final"), "z")),
        F.transform("places", lambda p: key("n", p)),
    )
    e = e.withColumn("ekeys", F.array_distinct(F.array_compact(known))).withColumn("key", F.explode("ekeys"))
    j = r.withColumn("key", F.explode("keys")).join(e, ["work_id", "key"]).where(F.element_at(F.array_intersect("keys", "ekeys"), 1) == F.col("key"))
    same = (F.length("sub") > 0) & (F.col("sub") == F.col("esub"))
    asked, lone = F.col("episode_number"), F.col("episode_label").isNull()  # a fractional label is answered by itself alone
    conditions = {
        "zero": F.col("zero") & same & asked.isNotNull(),
        "label and subtitle": (F.col("label") == asked) & same,
        "number and subtitle": (F.col("n") == asked) & same,
        "place and subtitle": F.array_contains("places", asked) & same & F.col("n").isNull(),
        "subtitle": same & lone & F.col("n").isNotNull(),
        "fraction": F.col("episode_label") == F.col("fraction"),
        "label": F.col("label") == asked,
        "number": F.col("n") == asked,
        "local number": F.col("local") == asked,
        "final": F.col("final") & F.col("wants_last") & asked.isNull() & lone,
    }
    tiers = F.array_compact(F.array(*[F.when(conditions[t], t) for t, _ in TIERS if t in conditions]))
    out = j.select("rec", "work_id", "episode_id", F.explode(tiers).alias("tier"))
    if works is None:
        return out
    # the longest list of several candidates, and what a cour beside it counts from its end
    sizes = episodes.groupBy("work_id").agg(F.count("*").alias("size"), F.max("n").alias("top"))
    family = records.where("episode_number is not null").select("rec", "episode_number").join(pairs, "rec").join(sizes, "work_id").join(works.select("work_id", "k"), "work_id")
    base = family.groupBy("rec").agg(F.max_by(F.struct("work_id", "top"), F.struct("size", -F.col("work_id"))).alias("b"), F.count("*").alias("works")).where("works > 1")
    cours = family.join(base, "rec").where((F.col("work_id") != F.col("b.work_id")) & F.col("k").rlike(COUR) & (F.col("episode_number") > F.col("b.top")))
    beyond = cours.select("rec", "work_id", (F.col("episode_number") - F.col("b.top")).alias("n")).join(episodes.select("work_id", "n", "episode_id"), ["work_id", "n"])
    return out.unionByName(beyond.select("rec", "work_id", "episode_id", F.lit("cour offset").alias("tier")))


def local_day(ms: Column) -> Column:
    """The day of UTC+9 in which an instant lies."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((ms + 9 * 3_600_000) / 86_400_000).cast("int"))


def schedule_proof(records: DataFrame, works: DataFrame, pairs: DataFrame, episodes: DataFrame, programs: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """(rec, episode_id, work_id, tier): dated recordings whose episode the schedule of their day proves.

    'schedule': all clean rows of the work on that day agree on one count, which names one episode. 'trusted channel': the
    rows of one channel do, where two marks (day, number) of ``direct``(recorded_date, subtitle, episode_id) are each aired by it alone.
    'corroborated schedule': on a day of doubtful rows alone, two channels or more tell one count and the episode's title.
    No subtitle of these rows, nor that of the name, may contradict the title. A candidate work that proves nothing, although
    it has clean rows on the day or no place in the schedule, vetoes the others; one that proves another number than the
    name tells is no answer. programs(tid, count, t, deleted, warn), and for all but the first way channel_id and subtitle.
    """
    wide = {"channel_id", "subtitle"} <= set(programs.columns)
    rows = programs.where(~F.col("deleted") & (F.col("count") > 0)).withColumn("day", local_day(F.col("t")))
    if not wide:
        rows = rows.withColumn("channel_id", F.lit(None).cast("int")).withColumn("subtitle", F.lit(None).cast("string"))
    # plans are cut here and below: each is read several times, and one plan of all would fill the driver
    rows = checkpointed(rows.select("tid", "day", "count", "channel_id", F.nullif(F.trim("subtitle"), F.lit("")).alias("subtitle"), "warn"))
    clean = rows.where(~F.col("warn"))
    tids = works.select("work_id", "tid")
    titles = episodes.where("n is not null").select("work_id", "n", "episode_id", F.nullif(F.trim("episode_title"), F.lit("")).alias("title"))
    one = R.unique_or_null(titles, ["work_id", "n"], "episode_id").where("value is not null").select("work_id", "n", F.col("value").alias("episode_id"))
    one = one.join(titles.select("episode_id", "title"), "episode_id")

    def named(agreed: DataFrame, against: DataFrame, tier: str) -> DataFrame:
        """The episode of each agreed (work_id, tid, day, n), without those that a subtitle of the rows contradicts."""
        told = agreed.join(one, ["work_id", "n"])
        if tier == "corroborated schedule":
            told = told.where("title is not null")
        wrong = told.where("title is not null").join(against.where("subtitle is not null").select("work_id", "day", "subtitle").distinct(), ["work_id", "day"])
        wrong = wrong.where(S.relation()("title", "subtitle") < 2).select("work_id", "day").distinct()
        return told.join(wrong, ["work_id", "day"], "left_anti").select("work_id", "day", "n", "episode_id", "title", F.lit(tier).alias("tier"))

    of_work = clean.join(tids, "tid")
    told = named(R.unanimous(of_work, ["work_id", "tid", "day"], "count", F.lit(True)).where("value is not null").withColumnRenamed("value", "n"), of_work, "schedule")
    if wide:
        if direct is not None:
            sure = direct.where("recorded_date is not null").select(F.col("recorded_date").alias("day"), "subtitle", "episode_id").join(one, "episode_id")
            sure = sure.where(F.coalesce(S.relation()("title", "subtitle"), F.lit(0)) >= 0).select("work_id", "day", "n", "title").distinct().join(tids, "work_id")
            aired = sure.join(clean.where("channel_id > 0").select("tid", "day", F.col("count").alias("n"), "channel_id", F.col("subtitle").alias("said")), ["tid", "day", "n"])
            aired = aired.where(F.coalesce(S.relation()("title", "said"), F.lit(3)) >= 2)
            marks = R.unique_or_null(aired, ["work_id", "day", "n"], "channel_id", distinct=True).where("value is not null").withColumnRenamed("value", "channel_id")
            trusted = checkpointed(R.anchors(marks, "work_id", ["day", "n"], "channel_id", ["day"]).select("work_id", F.col("witness").alias("channel_id")))
            own = of_work.join(trusted, ["work_id", "channel_id"])
            told = told.unionByName(named(R.unanimous(own, ["work_id", "tid", "day"], "count", F.lit(True)).where("value is not null").withColumnRenamed("value", "n"), own, "trusted channel"))
        doubted = R.corroborated(rows, ["tid", "day"], "count", "channel_id", F.col("warn"), "subtitle").select("tid", "day", F.col("value").alias("n")).join(tids, "tid")
        told = told.unionByName(named(doubted, rows.where("warn").join(tids, "tid"), "corroborated schedule"))
    # (work, day) has one answer a tier; the first tier that has one counts
    rank = F.when(F.col("tier") == "schedule", 0).when(F.col("tier") == "trusted channel", 1).otherwise(2)
    told = told.groupBy("work_id", "day").agg(F.min_by(F.struct("n", "episode_id", "title", "tier"), rank).alias("b"))
    asked = records.where("recorded_date is not null").select("rec", F.col("recorded_date").alias("day"), "episode_number", "subtitle").join(pairs, "rec").join(tids, "work_id")
    usable = clean.select("tid", "day").distinct().withColumn("usable", F.lit(True))
    every = asked.join(usable, ["tid", "day"], "left").join(told, ["work_id", "day"], "left")
    proved = F.col("b").isNotNull() & (F.coalesce(S.relation()(F.col("b.title"), F.col("subtitle")), F.lit(3)) >= 2)
    every = every.withColumn("proved", proved)
    fits = F.col("proved") & (F.col("episode_number").isNull() | (F.col("episode_number") == F.col("b.n")))
    veto = ~F.col("proved") & (F.col("tid").isNull() | F.coalesce("usable", F.lit(False)))
    answer = R.cross_group(every.withColumn("fits", fits).withColumn("veto", veto), ["rec"], F.col("fits"), F.col("veto"), "b").where("value is not null")
    return answer.select("rec", "value.episode_id", "value.tier").join(episodes.select("episode_id", "work_id"), "episode_id")


def shared_cour_proof(records: DataFrame, works: DataFrame, pairs: DataFrame, episodes: DataFrame, programs: DataFrame) -> DataFrame:
    """(rec, episode_id, work_id): episodes of a later cour that the schedule airs under the id of the first.

    For dated names without a number: all candidate works are the title itself or numbered cours of it, their lists are
    complete and share no number, they name one schedule id together and a cour names none; all clean rows of the day tell
    one number and the title of its episode, which is one of a cour without an id.
    """
    base = T.column(T.title_key)("work_title")
    asked = records.where("recorded_date is not null and episode_number is null and episode_label is null").select("rec", F.col("recorded_date").alias("day"), "subtitle", base.alias("base"))
    family = asked.join(pairs, "rec").join(works.select("work_id", "k", "tid", "listed_tid", "declared"), "work_id").join(episodes.groupBy("work_id").agg(F.count("*").alias("listed"), F.count("n").alias("numbered")), "work_id", "left")
    is_base = F.col("k") == F.col("base")
    cour = F.regexp_extract(F.regexp_replace(F.col("k"), F.lit("^.*?(?=" + COUR + "$)"), F.lit("")), "^" + COUR + "$", 1).try_cast("int")
    later = F.startswith("k", F.col("base")) & (F.regexp_replace("k", COUR + "$", "") == F.col("base")) & (cour >= 2)
    sound = (is_base & F.col("tid").isNotNull() | ~is_base & later) & (F.col("tid").isNotNull() | ~F.col("listed_tid")) & (F.col("declared") > 0) & (F.col("listed") == F.col("declared")) & (F.col("numbered") == F.col("listed"))
    fit = family.groupBy("rec").agg(F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"), F.count_if(is_base).alias("bases"), F.count_if(~F.col("listed_tid")).alias("without"), F.countDistinct("tid").alias("tids"), F.min("tid").alias("shared"), F.count("*").alias("works"))
    fit = fit.where("sound and bases = 1 and without > 0 and tids = 1 and works > 1").select("rec", "shared")
    numbers = family.join(fit, "rec").select("rec", "day", "subtitle", "shared", "work_id", "listed_tid").join(episodes.select("work_id", "n", "episode_id", "episode_title"), "work_id")
    apart = R.disjoint(numbers, "rec", "n").where("disjoint").select("rec")
    rows = programs.where(~F.col("deleted") & ~F.col("warn") & (F.col("count") > 0)).select(F.col("tid").alias("shared"), local_day(F.col("t")).alias("day"), F.col("count").alias("n"), F.col("subtitle").alias("said"))
    agreed = rows.groupBy("shared", "day").agg(F.min("n").alias("n"), F.countDistinct("n").alias("kinds"), F.collect_set(F.coalesce("said", F.lit(""))).alias("said")).where("kinds = 1")
    named = numbers.join(apart, "rec", "left_semi").where(~F.col("listed_tid")).join(agreed, ["shared", "day", "n"]).withColumn("said", F.explode("said"))
    told = named.groupBy("rec", "work_id", "episode_id").agg(F.bool_and(F.coalesce(S.relation()("episode_title", "said") == 3, F.lit(False)) & (F.coalesce(S.relation()("episode_title", "subtitle"), F.lit(3)) >= 2)).alias("good")).where("good")
    return R.unique_or_null(told, ["rec"], "episode_id").where("value is not null").select("rec", F.col("value").alias("episode_id")).join(episodes.select("episode_id", "work_id"), "episode_id")


def history_proof(records: DataFrame, works: DataFrame, pairs: DataFrame, episodes: DataFrame, programs: DataFrame, history: DataFrame, channels: DataFrame) -> DataFrame:
    """(rec, episode_id, work_id): files whose own recording in the history airs exactly as a row of the schedule.

    history(id, channel_id, start_at, end_at, name, video_files), channels(channel_id, history_id), programs also with t_end.
    The file's stem and day name one recording; that has one candidate work; rows of this work on the recording's channel,
    with the same start and end, tell one count with a subtitle, which names one titled episode. Doubtful rows count where
    the recording's name itself tells number and subtitle. Numbers and subtitles of file, recording and row must not contradict.
    """
    suffix = "\\.(?:mp4|ts|mkv|m4v|m2ts)$"
    stem = lambda c: F.regexp_replace(C.plain_key(F.regexp_extract(c, "[^/]*$", 0)), suffix, "")
    files = records.where("recorded_date is not null").select("rec", "path", F.col("recorded_date").alias("day"), "episode_number", "subtitle").withColumn("stem", stem(F.col("path"))).where("stem <> ''")
    listed = history.select("id", F.explode("video_files").alias("v"), "channel_id", "start_at", "end_at", "name").withColumn("stem", stem(F.col("v.filename"))).withColumn("day", local_day(F.col("start_at")))
    listed = listed.select("id", "stem", "day", "channel_id", "start_at", "end_at", "name").distinct()
    found = files.join(listed, ["stem", "day"])
    lone = R.unique_or_null(found, ["rec"], "id", distinct=True).where("value is not null").select("rec")
    found = parse_recordings(found.join(lone, "rec", "left_semi").select("rec", "day", "channel_id", "start_at", "end_at", F.col("episode_number").alias("file_n"), F.col("subtitle").alias("file_sub"), F.concat("name", F.lit(".ts")).alias("name")).distinct(), "name", True)
    number, clash = R.agree_or_conflict(F.col("file_n"), F.col("episode_number"))
    found = found.where(~F.coalesce(clash, F.lit(False))).withColumn("number", number)
    home = R.unique_or_null(channels.where("history_id is not null and channel_id is not null"), ["history_id"], "channel_id", distinct=True).where("value is not null")
    found = found.join(home.select(F.col("history_id").alias("channel_id"), F.col("value").alias("ch")), "channel_id")
    single = R.unique_or_null(pairs, ["rec"], "work_id").where("value is not null").select("rec", F.col("value").alias("work_id"))
    asked = found.join(single, "rec").join(works.where("tid is not null").select("work_id", "tid"), "work_id")
    rows = programs.where(~F.col("deleted")).select("tid", F.col("channel_id").alias("ch"), F.col("t").alias("start_at"), F.col("t_end").alias("end_at"), "count", F.nullif(F.trim("subtitle"), F.lit("")).alias("said"), "warn")
    aired = asked.join(rows, ["tid", "ch", "start_at", "end_at"])
    spoken = F.col("number").isNotNull() & F.col("subtitle").isNotNull()
    sound = (F.col("count") > 0) & F.col("said").isNotNull() & (F.col("number").isNull() | (F.col("number") == F.col("count")))
    per = aired.groupBy("rec", "work_id").agg(F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"), F.min("warn").alias("doubtful"), F.bool_and(spoken).alias("spoken"))
    per = per.where("sound and (not doubtful or spoken)").select("rec", "doubtful")
    used = aired.join(per, "rec").where(F.col("warn") == F.col("doubtful"))
    agreed = R.unanimous(used, ["rec", "work_id"], "count", F.lit(True)).where("value is not null").select("rec", "work_id", F.col("value").alias("n"))
    one = R.unique_or_null(episodes, ["work_id", "n"], "episode_id").where("value is not null and n is not null").select("work_id", "n", F.col("value").alias("episode_id"))
    told = agreed.join(one, ["work_id", "n"]).join(episodes.select("episode_id", "episode_title"), "episode_id").join(used.select("rec", "said", "subtitle", "file_sub"), "rec")
    fits = (S.relation()("episode_title", "said") >= 2) & (F.coalesce(S.relation()("episode_title", "subtitle"), F.lit(3)) >= 2) & (F.coalesce(S.relation()("episode_title", "file_sub"), F.lit(3)) >= 2)
    good = told.groupBy("rec", "episode_id", "work_id").agg(F.bool_and(F.coalesce(fits, F.lit(False))).alias("good")).where("good")
    return good.select("rec", "episode_id", "work_id")


def combine_records(file: DataFrame, other: DataFrame) -> DataFrame:
    """``file`` records with what ``other``(rec, and the fields of a name) adds: fields that both tell must agree, else the record is refused.

    Titles agree by key, numbers and labels as they are, subtitles by identity; a date is the file's, or the other's.
    """
    keys = {"work_title": T.column(T.title_key), "subtitle": T.column(T.identity_key)}
    fields = ["work_title", "episode_number", "episode_label", "subtitle", "recorded_date"]
    b = other.select("rec", *[F.col(f).alias(f"__{f}") for f in fields])
    j = file.join(b, "rec", "left")
    clashes = []
    for f in fields[:4]:
        key = keys.get(f, lambda c: F.col(c))
        clashes.append(F.when(F.coalesce(key(f) != key(f"__{f}"), F.lit(False)), F.lit(f)))
    wrong = F.array_join(F.array_compact(F.array(*clashes)), ", ")
    j = j.withColumn("__wrong", wrong)
    bad = F.col("__wrong") != ""
    merged = {f: F.coalesce(F.col(f), F.col(f"__{f}")) for f in fields}
    error = F.coalesce("error", F.when(bad, F.concat(F.lit("file and broadcast differ: "), "__wrong")))
    kind = F.coalesce("error_kind", F.when(bad, F.lit("conflict")))
    return j.withColumns(merged | {"error": error, "error_kind": kind}).select(*file.columns)


def select_records(records: DataFrame, selections: DataFrame) -> DataFrame:
    """``records`` with title, number and subtitle replaced where a fixed table of verified broadcasts has them.

    selections(title, number, day, work_title, episode_number, subtitle): a title (by its key), the number that its name
    tells (0: none) and the day name one row; the table is refused beyond a size that is fixed by hand.
    """
    keyed = T.column(T.title_key)
    dim = selections.select(keyed("title").alias("__k"), F.coalesce("number", F.lit(0)).alias("__n"), F.col("day").alias("__d"), "work_title", "episode_number", "subtitle").where("__k <> '' and __d is not null").dropDuplicates(["__k", "__n", "__d"])
    asked = F.col("episode_label").isNull() & F.col("error").isNull()
    rows = records.withColumns({"__k": F.when(asked, keyed("work_title")), "__n": F.coalesce("episode_number", F.lit(0)), "__d": F.col("recorded_date")})
    return R.override(rows, dim, ["__k", "__n", "__d"], ["work_title", "episode_number", "subtitle"]).select(*records.columns)


def link(files: DataFrame, works: DataFrame, episodes: DataFrame, programs: DataFrame, options: LinkOptions = LinkOptions(), broadcasts: DataFrame | None = None, history: DataFrame | None = None, channels: DataFrame | None = None, taken: DataFrame | None = None, selections: DataFrame | None = None) -> DataFrame:
    """(rec, path, status, strategy, work_id, episode_id, confidence, reasons, target) of every file(rec, path).

    status is 'linked', 'below' (under the asked confidence), 'open' (no or several answers) or 'refused' (the name cannot
    tell one episode, or contradicts the broadcast in the file). reasons are in a fixed order. target is where the file
    would go; copies of one target are numbered by path. Nothing is moved: this is a plan, the same on every run.

    programs(tid, count, t, deleted, warn); trusted channels, corroborated rows and shared cours are asked for where it has
    channel_id and subtitle. ``broadcasts``(rec, name, recorded_date) are the broadcasts read from the files themselves,
    ``history`` and ``channels`` as in ``history_proof``. Copies are numbered behind those of ``taken``(target) from earlier runs.
    ``selections`` as in ``select_records``.
    """
    w, e = catalogue_keys(works, episodes)
    w, e = checkpointed(w), checkpointed(e)
    # parsed once, matched once: what follows reads these again and again
    records = parse_recordings(files.select("rec", "path"))
    if broadcasts is not None:
        told = parse_recordings(broadcasts.select("rec", F.concat("name", F.lit(".ts")).alias("name"), F.col("recorded_date").alias("day")), "name", True).where("error is null")
        records = combine_records(records, told.withColumn("recorded_date", F.coalesce("recorded_date", "day")))
    if selections is not None:
        records = select_records(records, selections)
    records = checkpointed(records.withColumns({"sub": T.column(T.identity_key)("subtitle"), "part": T.column(T.scoring_key)("subtitle")}))
    good = records.where("error is null")
    pairs = checkpointed(candidate_works(good, w))
    evidence = checkpointed(episode_evidence(good, pairs, e, w))
    picked = R.priority_tiers(evidence, ["rec"], "tier", "episode_id", TIERS).withColumnRenamed("value", "episode_id")
    direct = picked.where("episode_id is not null").select("rec", "episode_id", "tier")
    # beyond the title itself: continuations and remakes, then specials, which must answer with a subtitle
    wider = [("continuation", CONTINUATION, True), ("special", SPECIAL, False)]
    for name, begins, remakes in wider:
        left = good.join(direct.select("rec"), "rec", "left_anti").where("length(sub) > 0")
        more = pairs.join(left.select("rec"), "rec", "left_semi").unionByName(further_works(left, w, begins, remakes)).distinct()
        answers = R.priority_tiers(episode_evidence(left, more, e).where(F.col("tier").isin(STRICT)), ["rec"], "tier", "episode_id", TIERS)
        direct = direct.unionByName(answers.where("value is not null").select("rec", F.col("value").alias("episode_id"), F.concat(F.lit(f"{name}: "), "tier").alias("tier")))
    direct = checkpointed(direct)
    left = good.join(direct.select("rec"), "rec", "left_anti")
    proved = checkpointed(schedule_proof(left, w, pairs, e, programs, direct.join(good.select("rec", "recorded_date", "subtitle"), "rec")).select("rec", "episode_id", "tier"))
    further = []
    if {"channel_id", "subtitle"} <= set(programs.columns):
        numberless = left.where("episode_number is null")
        cours = pairs.join(numberless.select("rec"), "rec", "left_semi").unionByName(further_works(numberless, w, COUR.replace("([0-9]+)", "[0-9]+"), False)).distinct()
        further.append(("shared cour", lambda rest: shared_cour_proof(rest, w, cours, e, programs)))
    if history is not None and channels is not None:
        further.append(("history", lambda rest: history_proof(rest, w, pairs, e, programs, history, channels)))
    for name, prove in further:
        rest = left.join(proved.select("rec"), "rec", "left_anti")
        # the tier is added after the plan is cut: a constant in a checkpoint loses its column in later plans
        proved = proved.unionByName(checkpointed(prove(rest).select("rec", "episode_id")).withColumn("tier", F.lit(name)))
    return _plan(files, records, pairs, picked, direct.unionByName(proved), w, e, programs, options, taken)


def _plan(files: DataFrame, records: DataFrame, pairs: DataFrame, picked: DataFrame, answers: DataFrame, w: DataFrame, e: DataFrame, programs: DataFrame, options: LinkOptions, taken: DataFrame | None) -> DataFrame:
    """The answers with their confidence, reasons and targets."""
    chosen = answers.join(e, "episode_id").join(w.select("work_id", "title", F.col("tid").alias("wtid")), "work_id")
    aired = programs.where(~F.col("deleted")).select(F.col("tid").alias("wtid"), F.col("count").alias("n"), local_day(F.col("t")).alias("recorded_date")).distinct().withColumn("aired", F.lit(True))
    full = records.join(chosen.select("rec", "work_id", "episode_id", "tier", "title", "wtid", "n", "fraction", "episode_title"), "rec", "left").join(aired, ["wtid", "n", "recorded_date"], "left")
    related = S.relation()("episode_title", "subtitle")
    points = F.when(F.coalesce(related, F.lit(1)) >= 1, SUBTITLE).when(related == 0, PARTLY).otherwise(0)
    full = full.withColumn("points", points)
    found = F.col("episode_id").isNotNull()
    sure = F.when(F.col("tier").isin(PROOFS), PROOF).otherwise(F.least(F.lit(100), WORK + EPISODE + F.col("points") + F.when(F.coalesce("aired", F.lit(False)), AIRED).otherwise(0)))
    vetoes = picked.where("episode_id is null").select("rec", F.col("reason").alias("veto"))
    works_seen = pairs.groupBy("rec").agg(F.count("*").alias("works"))
    told = full.join(vetoes, "rec", "left").join(works_seen, "rec", "left").withColumn("confidence", F.when(found, sure).otherwise(0))
    status = F.when(F.col("error").isNotNull(), "refused").when(~found, "open").when(F.col("confidence") < options.confidence, "below").otherwise("linked")
    reasons = F.array_compact(
        F.array(
            F.col("error"),
            F.when(F.col("error").isNull(), F.concat(F.lit("candidate works: "), F.coalesce("works", F.lit(0)).cast("string"))),
            F.when(~found, F.col("veto")),
            F.when(found, F.concat(F.lit("by "), "tier")),
            F.when(found & (F.col("points") == 0) & ~F.col("tier").isin(PROOFS), "subtitles differ"),
            F.when(F.coalesce("aired", F.lit(False)), "aired on the day"),
        )
    )
    told = told.withColumns({"status": status, "reasons": reasons})
    title = C.path_component(F.col("title"))
    label = F.coalesce(F.col("fraction"), F.col("n").cast("string"), F.col("episode_label"), F.col("episode_number").cast("string"))
    said = C.path_component(F.coalesce(F.nullif(F.trim("episode_title"), F.lit("")), F.col("subtitle")))
    ext = F.coalesce(F.nullif(F.regexp_extract("path", "(\\.[^./]*)$", 1), F.lit("")), F.lit(".mp4"))
    folder = F.lit(options.output) if options.output else F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]*$", 1), "/duplicate$", "")
    fitted = _fit_name()(title, label, said, ext)
    home = F.when(F.endswith(folder, F.concat(F.lit("/"), title)), folder).otherwise(F.concat(folder, F.lit("/"), title))
    ready = (F.col("status") == "linked") & label.isNotNull() & (title != "")
    placed = told.withColumn("base", F.when(ready, F.concat(home, F.lit("/"), fitted)))
    claims = placed.where("base is not null")
    if taken is None:
        copies = R.number_duplicates(claims, "base", ["path", "rec"], "rec")
    else:
        base_of = F.regexp_replace("target", "/duplicate/([^/]*) \\([0-9]+\\)(\\.[^./]*)$", "/$1$2")
        copies = R.free_copies(claims, taken.where("target is not null").select(base_of.alias("base")), "base", ["path", "rec"], "rec")
    numbered = claims.join(copies.select("rec", "copy"), "rec")
    stem = F.regexp_extract("base", "^(.*)/([^/]*)(\\.[^./]*)$", 2)
    target = F.when(F.col("copy") == 0, F.col("base")).otherwise(F.concat(F.regexp_extract("base", "^(.*)/[^/]*$", 1), F.lit("/duplicate/"), stem, F.lit(" ("), F.col("copy").cast("string"), F.lit(")"), F.regexp_extract("base", "(\\.[^./]*)$", 1)))
    targets = numbered.select("rec", target.alias("target"))
    return placed.join(targets, "rec", "left").select("rec", "path", "status", F.col("tier").alias("strategy"), "work_id", "episode_id", "confidence", "reasons", "target")


def _fit_name():
    """<title> #<label> 「<subtitle>」<ext> within 255 bytes: the subtitle is cut first, then the title."""
    @F.pandas_udf("string")
    def name(titles: pd.Series, labels: pd.Series, subtitles: pd.Series, exts: pd.Series) -> pd.Series:
        out = []
        for t, n, s, x in zip(titles, labels, subtitles, exts, strict=True):
            if t is None or n is None:
                out.append(None)
                continue
            if s:
                head, tail = f"{t} #{n} 「", f"」{x}"
                room = 255 - len(head.encode()) - len(tail.encode())
                short = T.shorten(s, room) if room > 0 else ""
                if short:
                    out.append(head + short + tail)
                    continue
            tail = f" #{n}{x}"
            out.append(T.shorten(t, 255 - len(tail.encode())) + tail)
        return pd.Series(out, dtype=object)

    return name


def sidecars(linked: DataFrame, works: DataFrame, episodes: DataFrame) -> DataFrame:
    """(target, nfo): the XML that describes each linked file; only whole numbered episodes have one."""
    e = episodes.select(F.col("id").alias("episode_id"), F.col("title").alias("episode_title"), C.episode_number(F.col("number"), F.col("number_text"), F.col("sort_number")).alias("n"))
    w = works.select(F.col("id").alias("work_id"), F.col("title").alias("show"))
    rows = linked.where("target is not null").join(e, "episode_id").join(w, "work_id").where("n is not null")
    body = F.struct(F.col("episode_title").alias("title"), F.col("show").alias("showtitle"), F.lit(1).alias("season"), F.col("n").alias("episode"), F.col("episode_id").cast("string").alias("uniqueid"))
    return rows.select(F.regexp_replace("target", "\\.[^./]*$", ".nfo").alias("target"), F.to_xml(body, {"rowTag": "episodedetails"}).alias("nfo"))
