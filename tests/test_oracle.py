"""Every core query with SQL gives what DuckDB gives; the others run and give rows."""

import re
from collections import Counter

import pytest

from voxloom.registry import collect

QUERIES, ORACLE = collect()


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, same):
    same(QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


SMALL = "/root/testdata/sf0.001"


def texts_of(spark):
    from voxloom.plans.relation_queries import texts

    return {r.uttid: (r.text, r.lang) for r in texts(spark, SMALL, "lang").collect()}


def test_whole_tables_of_events_and_orders(spark, tables):
    n, seconds = tables.execute("SELECT count(*), sum(1 + event_id % 7) FROM events").fetchone()
    assert [tuple(r) for r in QUERIES["decoding_times"](spark, SMALL).collect()] == [(float(seconds), n)]
    orders = tables.execute("SELECT o_orderkey, c_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey").fetchall()
    assert Counter(map(tuple, QUERIES["two_column_join"](spark, SMALL).collect())) == Counter(orders)


def test_text_queries_over_all_languages(spark):
    t = {u: x for u, (x, _) in texts_of(spark).items() if x is not None}
    assert {r.uttid: r.text for r in QUERIES["cleaned_text"](spark, SMALL).collect()} == {u: re.sub("[ \t\n\r]+", " ", re.sub(r"\[[^\]]*\]|<[^>]*>", "", x.upper())).strip(" ") for u, x in t.items()}
    got = {r.uttid: (r.line, r.stripped, r.bare) for r in QUERIES["normalised_trn"](spark, SMALL).collect()}
    assert got == {u: (re.sub(" +", " ", x.upper()).replace("((", "(") + f" ({u})", re.sub(" +", " ", re.sub("[()▁]", "", x)).strip(" "), re.sub(r"[!-/:-@\[-`{-~]", "", x)) for u, x in t.items()}
    words = {u: [w for w in re.split("[ \t\n\r]+", x) if w] for u, x in t.items()}
    assert {tuple(r) for r in QUERIES["occurrence_numbers"](spark, SMALL).collect()} == {(u, w, i + 1, ws[:i].count(w)) for u, ws in words.items() for i, w in enumerate(ws)}
    stm = {r.uttid: r.line for r in QUERIES["stm_lines"](spark, SMALL).collect()}
    from voxloom.plans.relation_queries import segments, speakers

    timed = {r.uttid for r in segments(spark, SMALL).filter("recid is not null and endtime > starttime").collect()}
    assert set(stm) == set(t) & timed & {r.uttid for r in speakers(spark, SMALL).collect()}
    assert all(line.endswith(" " + t[u].upper()) for u, line in stm.items())


def test_report_of_all_texts(spark):
    t = {u: x for u, x in texts_of(spark).items() if x[0] is not None}
    got = {r.id: (r.speaker, r.hyp, r.ref, r.c) for r in QUERIES["report_records"](spark, SMALL).collect() if r.id in t}
    own = lambda x: x.lstrip(" \t\n\r\x0b\f").rstrip(" ")
    assert got == {u: (lang, own(x), own(x.upper()), len(x)) for u, (x, lang) in t.items()}


def char_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_of_all_pairs(spark):
    from voxloom.plans.scoring_queries import versions

    pairs = {r.uttid: (r.ref, r.hyp) for r in versions(spark, SMALL).collect()}
    got = {r.uttid: r.edits for r in QUERIES["char_edits"](spark, SMALL).collect()}
    strip = lambda x: x.replace(" ", "")
    assert got == {u: None if a is None or b is None else 0 if a == b else char_distance(strip(a), strip(b)) for u, (a, b) in pairs.items()}


def test_word_edits_of_long_pairs(spark, tmp_path):
    a = [f"w{i}" for i in range(300)]
    b = [f"x{i}" if i % 3 == 0 else w for i, w in enumerate(a)][:280]
    rows = [("u", " ".join(a), 2), ("u", " ".join(b), 1)]
    spark.createDataFrame(rows, "uttid string, text string, loaded_at int").write.parquet(f"{tmp_path}/utt_text.parquet")
    assert [tuple(r) for r in QUERIES["word_edits"](spark, str(tmp_path)).collect()] == [("u", 300, char_distance(a, b))]
    assert [(r.edits, r.length) for r in QUERIES["wer_micro"](spark, str(tmp_path)).collect()] == [(char_distance(a, b), 300)]
