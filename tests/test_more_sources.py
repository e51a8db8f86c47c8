import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom.operators import frames as R
from spanloom.providers import provide
from spanloom.sources import audio, subtitles
from spanloom.sources.history import History


def test_wav_frames(spark, tmp_path):
    x = np.concatenate([np.zeros(1600), 0.5 * np.ones(3200), np.zeros(1600)])
    (tmp_path / "a.wav").write_bytes(audio.to_wav(x, 16000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    f = audio.read_frames(spark, str(tmp_path)).cache()
    assert f.count() == 40
    (v,) = R.voiced(f, ["media_id"], 0.1, 5, 3).collect()
    assert (v.k0, v.k1, round(v.t0, 3), round(v.t1, 3)) == (10, 29, 0.1, 0.3)
    quiet = R.runs_where(f, ["media_id"], F.col("rms") < 0.1, 2)
    lengths = f.groupBy("media_id").agg(F.max("t1").alias("seconds"))
    (s,) = R.inverted(quiet, lengths, ["media_id"], 0.05).collect()
    assert (round(s.p0, 3), round(s.p1, 3)) == (0.1, 0.3)
    info = {r.media_id.rsplit("/", 1)[1]: (r.seconds, r.channels, r.error is None) for r in audio.read_info(spark, str(tmp_path)).collect()}
    assert info == {"a.wav": (0.4, 1, True), "bad.wav": (None, None, False)}


def test_pcm_24_bit():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(3)
        w.setframerate(8000)
        for v in (-(2**22), 2**22 - 1):
            w.writeframes(int(v).to_bytes(3, "little", signed=True) * 2)
    x, rate = audio.pcm(out.getvalue())
    assert rate == 8000
    assert np.allclose(x, [-0.5, 0.5], atol=1e-6)


def test_history(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"), "id string, status string, at long, n long", ["id"])
    assert h.read().count() == 0
    row = lambda *r: spark.createDataFrame([r], "id string, status string, at long, n long")
    h.upsert(row("a", "running", 1, 0))
    h.upsert(row("b", "completed", 2, 0))
    h.update(F.col("status") == "running", status=F.lit("failed"))
    assert sorted((r.id, r.status) for r in h.read().collect()) == [("a", "failed"), ("b", "completed")]
    h.count_up(row("b", "completed", 3, 0), "n")
    h.count_up(row("b", "completed", 4, 0), "n")
    assert [(r.id, r.at, r.n) for r in h.page("at", 1).collect()] == [("b", 4, 2)]
    assert [r.id for r in h.page("at", 5, offset=1).collect()] == ["a"]
    h.delete(F.col("at") < 2)
    assert [r.id for r in h.read().collect()] == ["b"]
    h.rollback()
    assert sorted(r.id for r in h.read().collect()) == ["a", "b"]
    assert [r.id for r in h.newest(["status"], "at", F.col("status") == "completed").collect()] == ["b"]


def test_vtt_and_ass_round_trip(spark, tmp_path):
    cues = spark.createDataFrame([("m", 0.5, 2.25, "Ann", "Hi, there\nyou"), ("m", 3661.0, 3662.5, None, "two")], "media_id string, t0 double, t1 double, speaker string, text string")
    (tmp_path / "a.ass").write_text(subtitles.to_ass(cues).first()["ass"])
    got = subtitles.read_ass(spark, str(tmp_path / "a.ass")).orderBy("t0").collect()
    assert [(r.t0, r.t1, r.speaker, r.text) for r in got] == [(0.5, 2.25, "Ann", "Hi, there\nyou"), (3661.0, 3662.5, None, "two")]
    (tmp_path / "a.vtt").write_text(subtitles.to_vtt(cues).first().vtt)
    got = subtitles.read_cues(spark, str(tmp_path / "a.vtt")).orderBy("t0").collect()
    assert [(r.t0, r.t1, r.text) for r in got] == [(0.5, 2.25, "[Ann] Hi, there\nyou"), (3661.0, 3662.5, "two")]


def test_words(spark, tmp_path):
    word = {"id": "1", "text": "a", "speaker": "s", "onset": 0.0, "offset": 0.5}
    (tmp_path / "ok.json").write_text(json.dumps({"words": [word]}))
    assert [(r.id, r.offset) for r in subtitles.read_words(spark, str(tmp_path / "ok.json")).collect()] == [("1", 0.5)]
    (tmp_path / "bad.json").write_text(json.dumps({"words": [word, word]}))
    with pytest.raises(Exception, match="repeated"):
        subtitles.read_words(spark, str(tmp_path / "bad.json")).collect()


def test_provider_failures(spark):
    def factory():
        def model(pdf: pd.DataFrame) -> pd.DataFrame:
            if (pdf.x == 3).any():
                raise ValueError("three")
            return pd.DataFrame({"id": pdf.id, "y": pdf.x * 2})

        return model

    rows = spark.createDataFrame([(i, i) for i in range(6)], "id long, x long").coalesce(1)
    got = {r.id: (r.y, r.error) for r in provide(rows, factory, "y long", "id").collect()}
    assert got == {i: (2 * i, None) if i != 3 else (None, "ValueError: three") for i in range(6)}
