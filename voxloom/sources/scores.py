"""Music scores: JSON score files, and MusicXML reduced to notes."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "struct<st:double, et:double, lyric:string, midi:int, phns:string>"
SCORE = f"struct<tempo:int, item_list:array<string>, note:array<array<string>>>"


def read_score_json(spark: SparkSession, path: str) -> DataFrame:
    """(path, tempo, item_list, notes): notes of [start, end, lyric, midi, phones] as structs."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", SCORE, {"mode": "FAILFAST"}).alias("s"))
    note = lambda n: F.struct(n[0].cast("double").alias("st"), n[1].cast("double").alias("et"), n[2].alias("lyric"), n[3].cast("double").cast("int").alias("midi"), n[4].alias("phns"))
    return rows.select("path", "s.tempo", "s.item_list", F.transform("s.note", note).alias("notes"))


def score_json(tempo: Column, items: Column, notes: Column) -> Column:
    """A score as JSON; note fields in the order of the file format."""
    flat = F.transform(notes, lambda n: F.array(n["st"].cast("string"), n["et"].cast("string"), n["lyric"], n["midi"].cast("string"), n["phns"]))
    return F.to_json(F.struct(tempo.alias("tempo"), items.alias("item_list"), flat.alias("note")))


def parse_musicxml(text: str) -> tuple[int, list[tuple[float, float, str, int]]]:
    """(tempo, notes (start, end, lyric, midi)) of the first part, in seconds.

    A note without lyric that repeats the pitch before it prolongs that note (its lyric becomes
    a dash where the pitch differs); consecutive rests (midi 0, lyric P) are one, and a rest at
    the end is dropped. Chords keep their first note. The last tempo mark counts; without one
    it is 120.
    """
    root = ElementTree.fromstring(text)
    step = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
    tempos = [float(e.get("tempo")) for e in root.iter("sound") if e.get("tempo")] + [float(e.text) for e in root.iter("per-minute") if e.text]
    tempo = int(tempos[-1]) if tempos else 120
    part = root.find("part")
    notes: list[list] = []
    at, divisions = 0.0, 1.0
    for e in part.iter() if part is not None else ():
        if e.tag == "divisions":
            divisions = float(e.text)
        if e.tag != "note" or e.find("chord") is not None or e.find("grace") is not None:
            continue
        length = float(e.findtext("duration", "0")) / divisions * 60 / tempo
        p, lyric = e.find("pitch"), e.findtext("lyric/text")
        midi = 0 if p is None else 12 * (int(p.findtext("octave")) + 1) + step[p.findtext("step")] + int(float(p.findtext("alter", "0")))
        if notes and notes[-1][3] == midi and (midi == 0 or not lyric):
            notes[-1][1] = at + length
        else:
            notes.append([at, at + length, "P" if midi == 0 else lyric or "—", midi])
        at += length
    if notes and notes[-1][3] == 0:
        notes.pop()
    return tempo, [tuple(n) for n in notes]


#: Names of the twelve semitones as step and alteration.
_STEPS = [("C", 0), ("C", 1), ("D", 0), ("D", 1), ("E", 0), ("F", 0), ("F", 1), ("G", 0), ("G", 1), ("A", 0), ("A", 1), ("B", 0)]


def musicxml(tempo: int, notes: list[tuple[float, float, str, int]]) -> str:
    """A score of one part: notes (start, end, lyric, midi) in seconds, their lengths to an eighth of a beat and a sixteenth at least.

    A midi of 0 is a rest. Divisions are 16 a beat, so that every length is a whole number.
    """
    root = ElementTree.Element("score-partwise", version="3.1")
    names = ElementTree.SubElement(ElementTree.SubElement(root, "part-list"), "score-part", id="P1")
    ElementTree.SubElement(names, "part-name").text = "voice"
    measure = ElementTree.SubElement(ElementTree.SubElement(root, "part", id="P1"), "measure", number="1")
    ElementTree.SubElement(ElementTree.SubElement(measure, "attributes"), "divisions").text = "16"
    ElementTree.SubElement(ElementTree.SubElement(measure, "direction"), "sound", tempo=str(tempo))
    for st, et, lyric, midi in notes:
        note = ElementTree.SubElement(measure, "note")
        if midi:
            pitch = ElementTree.SubElement(note, "pitch")
            step, alter = _STEPS[midi % 12]
            ElementTree.SubElement(pitch, "step").text = step
            if alter:
                ElementTree.SubElement(pitch, "alter").text = str(alter)
            ElementTree.SubElement(pitch, "octave").text = str(midi // 12 - 1)
        else:
            ElementTree.SubElement(note, "rest")
        beats = max(int(8 * (et - st) * tempo / 60 + 0.5) / 8, 1 / 16)
        ElementTree.SubElement(note, "duration").text = str(int(beats * 16))
        if midi and lyric:
            ElementTree.SubElement(ElementTree.SubElement(note, "lyric"), "text").text = lyric
    return ElementTree.tostring(root, encoding="unicode")


def score_xml(tempo: Column, notes: Column) -> Column:
    """A MusicXML text of arrays of (st, et, lyric, midi)."""

    @F.pandas_udf("string")
    def run(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or b is None else musicxml(int(a), [(x["st"], x["et"], x["lyric"], int(x["midi"])) for x in b]) for a, b in zip(t, n)])

    return run(tempo, notes)


def read_musicxml(spark: SparkSession, path: str) -> DataFrame:
    """(path, tempo, notes) of MusicXML files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for p, v in zip(b["path"], b["value"]):
                tempo, notes = parse_musicxml(v)
                out.append((p, tempo, [dict(zip(("st", "et", "lyric", "midi"), n)) for n in notes]))
            yield pd.DataFrame(out, columns=["path", "tempo", "notes"])

    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return rows.mapInPandas(run, "path string, tempo int, notes array<struct<st:double,et:double,lyric:string,midi:int>>")
