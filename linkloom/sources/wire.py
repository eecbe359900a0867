"""Landed answers of the three services as tables: catalogue JSON, schedule XML, history JSON.

Every reader takes a table of whole documents (one a row) and says beside its rows whether they are whole, as an
incomplete list proves nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The field names of the answers.
WORK = "struct<annictId:int,title:string,media:string,titleKana:string,syobocalTid:int,seasonName:string,seasonYear:int,episodesCount:int,watchersCount:int,episodes:struct<pageInfo:struct<hasNextPage:boolean>,edges:array<struct<node:struct<annictId:int,number:string,numberText:string,sortNumber:int,title:string>>>>>"
SEARCH = f"struct<data:struct<searchWorks:struct<pageInfo:struct<hasNextPage:boolean>,edges:array<struct<node:{WORK}>>>>,errors:array<struct<message:string>>>"
HISTORY = "struct<total:int,records:array<struct<id:bigint,channelId:bigint,startAt:bigint,endAt:bigint,name:string,description:string,extended:string,rawExtended:map<string,string>,isRecording:boolean,isEncoding:boolean,videoFiles:array<struct<filename:string>>>>>"
PROGRAMS = "struct<ProgItems:struct<ProgItem:array<struct<PID:int,TID:int,ChID:int,Count:int,StTime:string,EdTime:string,SubTitle:string,STSubTitle:string,Deleted:int,Warn:int>>>,Result:struct<Code:int,Message:string>>"
CHANNELS = "struct<ChItems:struct<ChItem:array<struct<ChID:int,ChName:string>>>,Result:struct<Code:int,Message:string>>"


def search_results(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Works and episodes of nested search answers(body). whole is false where a page follows, the answer has errors, or ids of a list are invalid or come twice.

    A work that several answers hold counts once. Numbers may be written as numbers or as strings.
    """
    parsed = answers.select(F.from_json("body", SEARCH).alias("a"))
    top = parsed.select(F.explode("a.data.searchWorks.edges.node").alias("w"), (~F.col("a.data.searchWorks.pageInfo.hasNextPage") & (F.coalesce(F.size("a.errors"), F.lit(0)) <= 0)).alias("whole"))
    top = top.where("w.annictId > 0").dropDuplicates(["w"])
    season = F.when(F.col("w.seasonYear") > 0, F.concat_ws("-", "w.seasonYear", F.lower("w.seasonName")))
    works = top.select(F.col("w.annictId").alias("id"), F.col("w.title").alias("title"), F.lower("w.media").alias("media"), season.alias("season_name"), F.col("w.syobocalTid").cast("string").alias("syobocal_tid"), F.col("w.episodesCount").alias("episodes_count"), "whole").dropDuplicates(["id"])
    ids = F.col("w.episodes.edges.node.annictId")
    sound = F.forall(ids, lambda i: F.coalesce(i > 0, F.lit(False))) & (F.size(F.array_distinct(ids)) == F.size(ids))
    nested = top.select(F.col("w.annictId").alias("work_id"), F.explode("w.episodes.edges.node").alias("e"), (~F.col("w.episodes.pageInfo.hasNextPage") & sound).alias("whole"))
    number = F.col("e.number").try_cast("double")
    episodes = nested.select(F.col("e.annictId").alias("id"), "work_id", number.alias("number"), (F.col("e.number").isNotNull() & number.isNull()).alias("malformed"), F.col("e.numberText").alias("number_text"), F.col("e.sortNumber").alias("sort_number"), F.col("e.title").alias("title"), "whole")
    return works, episodes.dropDuplicates(["id"])


def schedule_rows(answers: DataFrame) -> DataFrame:
    """Rows of schedule answers(tid, body): foreign is true where a row belongs to another tid than was asked.

    Times without a zone are in UTC+9. An answer that says "not found" (404) is empty, not wrong.
    """
    parsed = answers.select("tid", F.from_xml("body", PROGRAMS).alias("a"))
    rows = parsed.select(F.col("tid").alias("asked"), F.explode("a.ProgItems.ProgItem").alias("p"))
    instant = lambda c: F.to_timestamp(F.concat(F.col(c), F.lit(" +09:00")), "yyyy-MM-dd HH:mm:ss XXX")
    text = F.coalesce(F.nullif(F.trim("p.SubTitle"), F.lit("")), F.col("p.STSubTitle"))
    return rows.select(F.col("p.PID").alias("pid"), F.col("p.TID").alias("tid"), F.col("p.ChID").alias("channel_id"), F.col("p.Count").alias("count"), instant("p.StTime").alias("started_at"), instant("p.EdTime").alias("ended_at"), text.alias("subtitle"), (F.col("p.Deleted") != 0).alias("deleted"), (F.col("p.Warn") != 0).alias("warn"), (F.col("p.TID") != F.col("asked")).alias("foreign"))


def schedule_channels(answers: DataFrame) -> DataFrame:
    return answers.select(F.explode(F.from_xml("body", CHANNELS)["ChItems"]["ChItem"]).alias("c")).select(F.col("c.ChID").alias("channel_id"), F.col("c.ChName").alias("name")).where("channel_id > 0").distinct()


def history_records(answers: DataFrame) -> DataFrame:
    """Records of history answers(search, body), pages of one search together; whole says whether the search is complete:
    every page names the same total, ids are unique, and as many records came as were promised."""
    parsed = answers.select("search", F.from_json("body", HISTORY).alias("a"))
    pages = parsed.groupBy("search").agg(F.countDistinct("a.total").alias("totals"), F.max("a.total").alias("total"))
    records = parsed.select("search", F.explode("a.records").alias("r"))
    counts = records.groupBy("search").agg(F.count("*").alias("n"), F.countDistinct("r.id").alias("ids"))
    whole = counts.join(pages, "search").select("search", ((F.col("totals") == 1) & (F.col("n") == F.col("total")) & (F.col("ids") == F.col("n"))).alias("whole"))
    r = F.col("r")
    out = records.join(whole, "search")
    return out.select("search", r["id"].alias("id"), r["channelId"].alias("channel_id"), r["startAt"].alias("start_at"), r["endAt"].alias("end_at"), r["name"].alias("name"), r["description"].alias("description"), r["extended"].alias("extended"), r["rawExtended"].alias("raw_extended"), r["isRecording"].alias("is_recording"), r["isEncoding"].alias("is_encoding"), r["videoFiles"].alias("video_files"), "whole")


# The field names of paged answers.
PAGED = {
    "works": "id:int,title:string,title_kana:string,media:string,media_text:string,season_name:string,season_name_text:string,released_on:string,syobocal_tid:string,episodes_count:int,watchers_count:int",
    "episodes": "id:int,number:string,number_text:string,sort_number:int,title:string",
    "programs": "id:int,started_at:string,is_rebroadcast:boolean,channel:struct<id:int,name:string>,work:struct<id:int,title:string>,episode:struct<id:int,number:string,number_text:string,title:string>",
}


def paged_answers(answers: DataFrame, name: str) -> DataFrame:
    """Rows of the pages of ``name`` ('works', 'episodes', 'programs'), answers(search, body), with what is wrong about their search.

    refused is null where every page names the same total, as many rows came, all have a positive id and none comes twice;
    else 'invalid', 'duplicate', 'total' or 'incomplete'. Rows of a refused search prove nothing. A search whose pages can't be
    read, or that has no rows, has one row without an id.
    """
    parsed = answers.select("search", F.from_json("body", f"struct<{name}:array<struct<{PAGED[name]}>>,total_count:int>").alias("a"))
    items = F.coalesce(F.col(f"a.{name}"), F.array())
    per = parsed.withColumn("n", F.size(items)).groupBy("search").agg(F.countDistinct("a.total_count").alias("totals"), F.max("a.total_count").alias("total"), F.sum("n").alias("n"), F.bool_and(F.coalesce(F.col("a.total_count").isNotNull(), F.lit(False))).alias("read"))
    rows = parsed.select("search", F.explode_outer(F.col(f"a.{name}")).alias("r"))
    ids = rows.groupBy("search").agg(F.countDistinct("r.id").alias("ids"), F.count_if(F.coalesce(F.col("r.id") > 0, F.lit(False))).alias("valid"))
    refused = F.when(~F.col("read") | (F.col("totals") != 1), "total").when(F.col("valid") < F.col("n"), "invalid").when(F.col("ids") < F.col("n"), "duplicate").when(F.col("n") != F.col("total"), "incomplete")
    state = per.join(ids, "search").select("search", refused.alias("refused"))
    out = rows.join(state, "search").select("search", "r.*", "refused")
    return out.where("id is not null or refused is not null").distinct()


def works_of_pages(answers: DataFrame) -> DataFrame:
    return paged_answers(answers, "works")


def episodes_of_pages(answers: DataFrame) -> DataFrame:
    """Episodes of the works that are the searches: work_id is the search, numbers may be written as numbers or as strings."""
    rows = paged_answers(answers, "episodes")
    number = F.col("number").try_cast("double")
    return rows.select("id", F.col("search").cast("int").alias("work_id"), number.alias("number"), "number_text", "sort_number", "title", F.coalesce("refused", F.when(F.col("number").isNotNull() & number.isNull(), "invalid")).alias("refused"))


def programs_between(answers: DataFrame, since: str, until: str) -> DataFrame:
    """Programmes of the pages that begin inside the open interval, instants with any offset."""
    rows = paged_answers(answers, "programs").withColumn("started_at", F.to_timestamp("started_at"))
    return rows.where((F.col("started_at") > F.lit(since).cast("timestamp")) & (F.col("started_at") < F.lit(until).cast("timestamp")))


def first_answering(first: DataFrame, second: DataFrame, search: str = "search") -> DataFrame:
    """Rows of ``first``, and of ``second`` for the searches that ``first`` has refused or has nothing for."""
    good = first.where("refused is null")
    return good.unionByName(second.join(good.select(search).distinct(), search, "left_anti"))
