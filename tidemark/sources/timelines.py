"""Timelines as nested documents: sequences of tracks of clips, built from relational tables and taken apart again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import fresh_folder

#: A document's elements; names with _ in front are attributes. Times are ticks of the rate.
SCHEMA = (
    "_id string, name string, rate struct<timebase:int,ntsc:boolean>, "
    "files struct<file:array<struct<_id:string,path:string,duration:bigint>>>, "
    "media struct<track:array<struct<_index:int,_kind:string,clip:array<struct<_id:string,_file:string,name:string,start:bigint,end:bigint,in:bigint>>>>>"
)
#: White space is part of a name, and no text stands for null.
READ = {"rowTag": "sequence", "attributePrefix": "_", "ignoreSurroundingSpaces": "false", "nullValue": "\u0001", "mode": "FAILFAST"}
WRITE = {"rowTag": "sequence", "attributePrefix": "_"}


@dataclass
class Timelines:
    """sequences (sequence_id, name, timebase, ntsc), tracks (sequence_id, track, kind), clips (sequence_id, track, clip_id, file_id,
    name, t0, t1, t_in) and files (sequence_id, file_id, path, duration); ids are strings, tracks whole numbers."""

    sequences: DataFrame
    tracks: DataFrame
    clips: DataFrame
    files: DataFrame


def _refused(rows: DataFrame) -> None:
    """Stops if a row has a ``fault``: a document that refers to what isn't there can't be read again."""
    if lost := rows.where("fault IS NOT NULL").first():
        raise ValueError(f"{lost['fault']}: {lost.asDict()}")


def _fault(sequences: Column, tracks: Column, clips: Column, files: Column) -> Column:
    """What is wrong with one sequence, or null: null or repeated ids, and references to what isn't there.

    ``sequences`` is how many have its id; tracks are structs with track, clips with clip_id, file_id and track, files with file_id."""
    found = []
    for rows, c, what in ((tracks, "track", "track"), (clips, "clip_id", "clip"), (files, "file_id", "file")):
        found.append(F.when((F.size(rows) > 0) & (F.col("sequence_id").isNull() | F.exists(rows[c], lambda i: i.isNull())), f"a {what} without an id"))
        found.append(F.when(F.size(F.array_distinct(rows[c])) < F.size(rows), f"a {what} that comes twice"))
        found.append(F.when((F.size(rows) > 0) & (sequences == 0), f"a {what} of no sequence"))
    found.insert(0, F.when((sequences > 0) & F.col("sequence_id").isNull(), "a sequence without an id"))
    found.insert(1, F.when(sequences > 1, "a sequence that comes twice"))
    found.append(F.when(F.size(F.array_except(clips["track"], tracks["track"])) > 0, "a clip on no track"))
    used = F.filter(clips["file_id"], lambda f: f.isNotNull())
    found.append(F.when(F.size(F.array_except(used, files["file_id"])) > 0, "a clip of no file"))
    return F.coalesce(*found)


def _gathered(t: Timelines) -> DataFrame:
    """A row for each sequence id of any of the tables: ``sequences``, ``tracks`` with their ``clips``, ``files``, each in order, and ``fault``. Written once, so what is checked is what is used."""
    spark = t.sequences.sparkSession
    clip = F.struct("t0", "clip_id", "file_id", "name", "t1", "t_in").alias("clip")
    laid = t.tracks.select("sequence_id", "track", F.struct("kind").alias("own")).unionByName(t.clips.select("sequence_id", "track", clip), allowMissingColumns=True)
    laid = laid.groupBy("sequence_id", "track").agg(F.collect_list("own").alias("own"), F.sort_array(F.collect_list("clip")).alias("clips"))
    track = F.struct("track", "own", "clips").alias("track")
    parts = laid.select("sequence_id", track).unionByName(t.sequences.select("sequence_id", F.struct("name", "timebase", "ntsc").alias("sequence")), allowMissingColumns=True)
    parts = parts.unionByName(t.files.select("sequence_id", F.struct("file_id", "path", "duration").alias("file")), allowMissingColumns=True)
    whole = parts.groupBy("sequence_id").agg(F.collect_list("sequence").alias("sequences"), F.sort_array(F.collect_list("track")).alias("tracks"), F.sort_array(F.collect_list("file")).alias("files"))
    tracks = F.flatten(F.transform("tracks", lambda x: F.transform(x["own"], lambda _: F.struct(x["track"].alias("track")))))
    clips = F.flatten(F.transform("tracks", lambda x: F.transform(x["clips"], lambda c: F.struct(c["clip_id"].alias("clip_id"), c["file_id"].alias("file_id"), x["track"].alias("track")))))
    whole = whole.withColumn("fault", _fault(F.size("sequences"), tracks, clips, F.col("files")))
    path = fresh_folder(spark, "gathered")
    whole.write.parquet(path)
    return spark.read.schema(whole.schema).parquet(path)


def check(t: Timelines) -> None:
    """Refuses null or repeated ids, and tracks, clips and files that refer to what isn't there."""
    _refused(_gathered(t).select("sequence_id", "fault"))


def documents(t: Timelines) -> DataFrame:
    """(``sequence_id``, ``document``): one well-formed document for each sequence, after ``check``. Tracks are in order of number, clips of ``t0`` and id, files of id."""
    whole = _gathered(t)
    _refused(whole.select("sequence_id", "fault"))
    some = lambda items, f: F.when(F.size(items) > 0, F.transform(items, f))
    clip = lambda c: F.struct(c["clip_id"].alias("_id"), c["file_id"].alias("_file"), c["name"].alias("name"), c["t0"].alias("start"), c["t1"].alias("end"), c["t_in"].alias("in"))
    track = lambda x: F.struct(x["track"].alias("_index"), x["own"][0]["kind"].alias("_kind"), some(x["clips"], clip).alias("clip"))
    file = lambda f: F.struct(f["file_id"].alias("_id"), f["path"].alias("path"), f["duration"].alias("duration"))
    own = F.col("sequences")[0]
    body = F.struct(
        F.col("sequence_id").alias("_id"), own["name"].alias("name"), F.struct(own["timebase"].alias("timebase"), own["ntsc"].alias("ntsc")).alias("rate"),
        F.struct(some(F.col("files"), file).alias("file")).alias("files"), F.struct(some(F.col("tracks"), track).alias("track")).alias("media"),
    )
    return whole.select("sequence_id", F.to_xml(body, WRITE).alias("document"))


def tables(docs: DataFrame, document: str = "document") -> Timelines:
    """The tables that ``documents`` were built from. A document that isn't well-formed, or has other types, stops the read; so do references to what isn't there.

    Each document is read once, and checked by itself; what was read is a table in the shared folder."""
    s = docs.select(F.from_xml(F.col(document), SCHEMA, READ).alias("s")).select("s.*").withColumnRenamed("_id", "sequence_id")
    none = lambda c, like: F.coalesce(c, F.array().cast(like))
    tracks = none(F.transform("media.track", lambda x: F.struct(x["_index"].alias("track"))), "array<struct<track:int>>")
    clips = F.transform("media.track", lambda x: F.coalesce(F.transform(x["clip"], lambda c: F.struct(c["_id"].alias("clip_id"), c["_file"].alias("file_id"), x["_index"].alias("track"))), F.array().cast("array<struct<clip_id:string,file_id:string,track:int>>")))
    clips = none(F.flatten(clips), "array<struct<clip_id:string,file_id:string,track:int>>")
    files = none(F.transform("files.file", lambda f: F.struct(f["_id"].alias("file_id"))), "array<struct<file_id:string>>")
    s = s.withColumn("fault", _fault(F.lit(1), tracks, clips, files))
    path = fresh_folder(docs.sparkSession, "read")
    s.write.parquet(path)
    s = docs.sparkSession.read.schema(s.schema).parquet(path)
    _refused(s.select("sequence_id", "fault"))
    _refused(s.groupBy("sequence_id").count().where("count > 1").select("sequence_id", F.lit("a sequence that comes twice").alias("fault")))
    tracks = s.select("sequence_id", F.explode("media.track").alias("t"))
    clips = tracks.select("sequence_id", F.col("t._index").alias("track"), F.explode("t.clip").alias("c"))
    files = s.select("sequence_id", F.explode("files.file").alias("f"))
    return Timelines(
        s.select("sequence_id", "name", "rate.timebase", "rate.ntsc"), tracks.select("sequence_id", F.col("t._index").alias("track"), F.col("t._kind").alias("kind")),
        clips.select("sequence_id", "track", F.col("c._id").alias("clip_id"), F.col("c._file").alias("file_id"), "c.name", F.col("c.start").alias("t0"), F.col("c.end").alias("t1"), F.col("c.in").alias("t_in")),
        files.select("sequence_id", F.col("f._id").alias("file_id"), "f.path", "f.duration"),
    )
