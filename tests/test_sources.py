import io
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxloom.sources import binary, formats, json_utts, scores, sinks


def test_two_column(spark, tmp_path):
    (tmp_path / "a").write_text("  u1\t some  text \nu2\nu3 x\n")
    rows = {r.uttid: r.value for r in formats.read_two_column(spark, str(tmp_path / "a")).collect()}
    assert rows == {"u1": "some  text", "u2": "", "u3": "x"}
    with pytest.raises(Exception, match="no value"):
        formats.read_two_column(spark, str(tmp_path / "a"), need_value=True).collect()
    (tmp_path / "b").write_text("u1 a\nu1 b\n")
    with pytest.raises(ValueError, match="occurs 2 times"):
        formats.read_two_column(spark, str(tmp_path / "b"))
    (tmp_path / "c").write_text("u1 a\n\nu2 b\n")
    with pytest.raises(Exception, match="blank line"):
        formats.read_two_column(spark, str(tmp_path / "c"), unique=False).collect()


def test_sequences_fail_on_double_blanks(spark, tmp_path):
    (tmp_path / "s").write_text("u1 1,2,3\n")
    assert formats.read_sequences(spark, str(tmp_path / "s"), "csv_int").first().value == [1, 2, 3]
    (tmp_path / "t").write_text("u1 1  2\n")
    with pytest.raises(Exception):
        formats.read_sequences(spark, str(tmp_path / "t"), "text_int").collect()
    with pytest.raises(ValueError):
        formats.parse_sequence(F.col("x"), "text")


def test_rttm(spark):
    lines = ["SPEAKER f 1 0 10 <NA> <NA> s2 <NA>", "SPEAKER f 1 5 3 <NA> <NA> s1 <NA>", "SPEAKER f 1 11 4 <NA> <NA> s2 <NA>", "END f <NA> 14 <NA> <NA> <NA> <NA> <NA>", "SPEAKER g 1 0 4 <NA> <NA> s9 <NA>"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    out = {(r.utt, r.spk): (r.n_samples, r.spk_index, [tuple(a) for a in r.active]) for r in formats.rttm_labels(formats.parse_rttm(df)).collect()}
    assert out == {("f", "s2"): (14, 0, [(0, 14)]), ("f", "s1"): (14, 1, [(5, 9)])}  # g has no END, so no length
    with pytest.raises(Exception, match="nine fields"):
        formats.parse_rttm(spark.createDataFrame([("SPEAKER f 1",)], "value string")).collect()


def test_report(spark):
    text = "noise\nSpeaker sentences 0: A #utts: 2\nid: (A-u1)\nScores: (#C #S #D #I) 5 1 2 3\nREF: a b\nHYP: a c\nid: (A-u2)\nScores: (#C #S #D #I) 1 0 0 0\nREF: x\nHYP: x"
    df = spark.createDataFrame(list(enumerate(text.split("\n"))), "n int, value string")
    rows = [(r.id, r.ref, r.hyp, tuple(r.s)) for r in formats.parse_report(df, ["n"]).withColumn("s", formats.parse_scores(F.col("scores"))).orderBy("record").collect()]
    assert rows == [("(A-u1)", "a b", "a c", (5, 1, 2, 3)), ("(A-u2)", "x", "x", (1, 0, 0, 0))]


def test_wav_npy_ark(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(struct.pack("<6h", 0, 16384, -32768, 1, 2, 3))
    r = binary.read_wav(spark, str(tmp_path / "a.wav")).first()
    assert r.rate == 8000 and r.samples[0] == [0.0, -1.0, 2 / 32768] and r.samples[1][0] == 0.5
    np.save(tmp_path / "x.npy", np.arange(6).reshape(2, 3))
    r = binary.read_npy(spark, str(tmp_path / "x.npy")).first()
    assert r.shape == [2, 3] and r["values"] == [0, 1, 2, 3, 4, 5]
    buf = io.BytesIO()
    buf.write(b"m \0BFM \4" + struct.pack("<i", 2) + b"\4" + struct.pack("<i", 2) + np.array([1, 2, 3, 4], "<f4").tobytes())
    buf.write(b"v \0BDV \4" + struct.pack("<i", 3) + np.array([1.5, 2, 3], "<f8").tobytes())
    buf.write(b"i \0B\4" + struct.pack("<i", 2) + b"\4" + struct.pack("<i", 7) + b"\4" + struct.pack("<i", 8))
    (tmp_path / "f.ark").write_bytes(buf.getvalue())
    rows = {r.uttid: (r.shape, r["values"]) for r in binary.read_ark(spark, str(tmp_path / "f.ark")).collect()}
    assert rows == {"m": ([2, 2], [1, 2, 3, 4]), "v": ([3], [1.5, 2, 3]), "i": ([2], [7, 8])}
    assert binary.read_typed(spark, str(tmp_path / "f.ark"), "ark", shape_only=True).columns == ["uttid", "shape"]


def test_random_and_unknown_types(spark, tmp_path):
    (tmp_path / "shape").write_text("u1 2,3\nu2 0\n")
    read = lambda: {r.uttid: r.value for r in binary.read_typed(spark, str(tmp_path / "shape"), "rand_int_3_9").collect()}
    first = read()
    assert first == read() and len(first["u1"]) == 6 and all(3 <= v < 9 for v in first["u1"]) and first["u2"] == []
    with pytest.raises(ValueError):
        binary.read_typed(spark, "x", "hdf5")


MUSIC = """<score-partwise><part id="P1"><measure number="1"><attributes><divisions>2</divisions></attributes><direction><sound tempo="60"/></direction>
<note><pitch><step>A</step><octave>4</octave></pitch><duration>2</duration><lyric><text>la</text></lyric></note>
<note><pitch><step>A</step><octave>4</octave></pitch><duration>2</duration></note>
<note><rest/><duration>1</duration></note><note><rest/><duration>1</duration></note>
<note><pitch><step>C</step><alter>1</alter><octave>5</octave></pitch><duration>2</duration><lyric><text>do</text></lyric></note>
<note><rest/><duration>4</duration></note></measure></part></score-partwise>"""


def test_scores(spark, tmp_path):
    assert scores.parse_musicxml(MUSIC) == (60, [(0.0, 2.0, "la", 69), (2.0, 3.0, "P", 0), (3.0, 4.0, "do", 73)])
    (tmp_path / "m.xml").write_text(MUSIC)
    assert [n.midi for n in scores.read_musicxml(spark, str(tmp_path / "m.xml")).first().notes] == [69, 0, 73]
    (tmp_path / "s.json").write_text(json.dumps({"tempo": 100, "item_list": ["st"], "note": [[0, 0.5, "la", 60, "l_a"]]}))
    r = scores.read_score_json(spark, str(tmp_path / "s.json")).first()
    assert r.tempo == 100 and tuple(r.notes[0]) == (0.0, 0.5, "la", 60, "l_a")


def test_json_utts(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"utts": {"u1": {"input": [{"name": "input1", "feat": "f.ark:1", "shape": [3, 2]}], "output": [], "utt2spk": "s"}}}))
    utts = json_utts.read_json_utts(spark, str(tmp_path / "d.json"))
    payload = spark.createDataFrame([("f.ark:1", [1.0])], "feat string, x array<double>")
    assert [(r.uttid, r.name, r.x) for r in json_utts.join_payloads(utts, payload).collect()] == [("u1", "input1", [1.0])]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([("u1", "x y"), ("u2", "")], "uttid string, value string")
    b = spark.createDataFrame([("u1", "s")], "uttid string, value string")
    with pytest.raises(ValueError, match="do not fit"):
        sinks.write_datadir({"text": a, "spk": b}, str(tmp_path / "d"))
    sinks.write_datadir({"text": a}, str(tmp_path / "d"))
    assert {r.uttid: r.value for r in formats.read_two_column(spark, str(tmp_path / "d/text")).collect()} == {"u1": "x y", "u2": ""}
    arrays = spark.createDataFrame([("u1", [1.0, 2.0])], "uttid string, x array<double>")
    sinks.copy_feats(arrays, str(tmp_path / "p"), "x", [lambda df: df.withColumn("x", F.transform("x", lambda v: v * 2))])
    assert spark.read.parquet(str(tmp_path / "p")).first().asDict() == {"uttid": "u1", "x": [2.0, 4.0], "x_length": 2}
    assert sinks.markdown_table(b) == "|uttid|value|\n|---|---|\n|u1|s|\n"
    sinks.write_json_records(spark.createDataFrame([("u", (1,))], "k string, r struct<a:int>"), str(tmp_path / "j"), "k", "r")
    assert spark.read.text(str(tmp_path / "j")).first().value == '{"k":"u","r":{"a":1}}'
