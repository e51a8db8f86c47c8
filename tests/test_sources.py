from spanloom.sources import subtitles as S


def test_srt_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([("m", 0.5, 2.25, "Hello"), ("m", 3661.001, 3662.0, "two\nlines")], "media_id string, t0 double, t1 double, text string")
    text = S.to_srt(cues).first().srt
    assert text == "1\n00:00:00,500 --> 00:00:02,250\nHello\n\n2\n01:01:01,001 --> 01:01:02,000\ntwo\nlines\n"
    (tmp_path / "a.srt").write_text(text.replace("\n", "\r\n"))
    back = S.read_cues(spark, str(tmp_path / "a.srt")).orderBy("t0").collect()
    assert [(r.t0, r.t1, r.text) for r in back] == [(0.5, 2.25, "Hello"), (3661.001, 3662.0, "two\nlines")]


def test_vtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text("WEBVTT\n\n00:01.000 --> 00:02.500 align:start\nHi there\n\nNOTE nothing\n\n1:00:00.000 --> 1:00:01.000\nBye\n")
    got = S.read_cues(spark, str(tmp_path / "a.vtt")).orderBy("t0").collect()
    assert [(r.t0, r.t1, r.text) for r in got] == [(1.0, 2.5, "Hi there"), (3600.0, 3601.0, "Bye")]


def test_ass(spark, tmp_path):
    (tmp_path / "a.ass").write_text("[Events]\nDialogue: 0,0:00:01.50,0:00:02.75,Default,Ann,0,0,0,,{\\i1}Well,{\\i0} yes\\Nno\n")
    got = S.read_ass(spark, str(tmp_path / "a.ass")).collect()
    assert [(r.t0, r.t1, r.speaker, r.text) for r in got] == [(1.5, 2.75, "Ann", "Well, yes\nno")]
