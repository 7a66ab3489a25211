"""Timeline documents: a round trip of several, hard names, and what is refused."""

import pytest

from tidemark.sources import timelines
from tidemark.sources.timelines import Timelines

SEQUENCES = [("a", "one & <two>", 25, False), ("b", "  spaces  ", 30, True), ("empty", None, None, None)]
TRACKS = [("a", 1, "video"), ("a", 2, "audio"), ("b", 1, None)]
CLIPS = [("a", 1, "c1", "f1", "x \"y\" 'z'", 0, 10, 5), ("a", 1, "c0", "f1", "ünï 🙂", 10, 20, None), ("a", 2, "c2", None, None, 3, 4, 0), ("b", 1, "c1", "f1", "null", -5, 0, 0)]
FILES = [("a", "f1", "/p q/r&s.mov", 100), ("b", "f1", None, None), ("b", "unused", "u", 1)]


def build(spark, sequences=SEQUENCES, tracks=TRACKS, clips=CLIPS, files=FILES):
    return Timelines(
        spark.createDataFrame(sequences, "sequence_id string, name string, timebase int, ntsc boolean"), spark.createDataFrame(tracks, "sequence_id string, track int, kind string"),
        spark.createDataFrame(clips, "sequence_id string, track int, clip_id string, file_id string, name string, t0 long, t1 long, t_in long"),
        spark.createDataFrame(files, "sequence_id string, file_id string, path string, duration long"),
    )


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark):
    built = build(spark)
    docs = timelines.documents(built)
    assert docs.count() == 3 and all(r.document.startswith("<sequence") for r in docs.collect())
    back = timelines.tables(docs)
    for name in ("sequences", "tracks", "clips", "files"):
        assert rows(getattr(back, name)) == rows(getattr(built, name)), name


@pytest.mark.parametrize("changed,said", [
    ({"clips": [*CLIPS, ("a", 9, "c9", None, None, 0, 1, 0)]}, "on no track"), ({"clips": [*CLIPS, ("a", 1, "c9", "lost", None, 0, 1, 0)]}, "of no file"), ({"tracks": [*TRACKS, ("z", 1, None)]}, "of no sequence"),
    ({"clips": [*CLIPS, CLIPS[0]]}, "comes twice"), ({"sequences": [*SEQUENCES, (None, None, 1, True)]}, "without an id"),
])
def test_missing_references_are_refused(spark, changed, said):
    with pytest.raises(ValueError, match=said):
        timelines.documents(build(spark, **changed))


def test_a_broken_document_is_refused(spark):
    with pytest.raises(Exception, match="MALFORMED"):
        rows(timelines.tables(spark.createDataFrame([("<sequence _id='a'><name>x</sequence>",)], "document string")).clips)


@pytest.mark.parametrize("inner,said", [
    ("<media><track index='1'><clip id='c' file='lost'/></track></media>", "of no file"), ("<media><track index='1'/><track index='1'/></media>", "track that comes twice"),
    ("<media><track index='1'><clip id='c'/></track><track index='2'><clip id='c'/></track></media>", "clip that comes twice"), ("<files><file id='f'/><file/></files>", "file without an id"),
])
def test_documents_with_lost_references_are_refused(spark, inner, said):
    with pytest.raises(ValueError, match=said):
        timelines.tables(spark.createDataFrame([(f"<sequence id='a'>{inner}</sequence>",)], "document string"))


def test_each_document_is_read_once(spark):
    """What was read is a table: no plan of the four parses XML again, and few jobs check them."""
    docs = timelines.documents(build(spark))
    tracker, group = spark.sparkContext.statusTracker(), "read-once"
    spark.sparkContext.setJobGroup(group, group)
    back = timelines.tables(docs)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(tracker.getJobIdsForGroup(group)) <= 6
    for name in ("sequences", "tracks", "clips", "files"):
        assert "from_xml" not in getattr(back, name)._jdf.queryExecution().optimizedPlan().toString(), name
