"""Queries on tokens, vocabularies, cleaning, JSON and emitted text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxloom.functions import text as T
from voxloom.functions import vocabulary as V
from voxloom.plans.relation_queries import CHAR_SHAPES, SEGMENTS, SPEAKERS, TEXTS, TRAIN_SHAPES, segments, shape_sql, shapes, speakers, texts
from voxloom.session import read_table

QUERIES, ORACLE = {}, {}
W = "list_filter(regexp_split_to_array({c}, '[ \\t\\n\\r]+'), lambda x: x <> '')"
WORDS = W.format(c="text")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(f"WITH {TEXTS} SELECT uttid, array_to_string(list_transform(regexp_extract_all(text, '(?s)(<noise>|<unk>|\\[laughter\\]|.)', 1), lambda t: CASE WHEN t = ' ' THEN '<space>' ELSE t END), '|') AS tokens FROM txt WHERE text IS NOT NULL")
def char_tokens(s, d):
    """Characters, with tags kept whole."""
    t = T.char_tokens(F.col("text"), ["<noise>", "<unk>", "[laughter]"])
    return texts(s, d).filter("text is not null").select("uttid", F.array_join(t, "|").alias("tokens"))


@query(f"WITH {TEXTS} SELECT uttid, {WORDS} AS words, len(string_split(text, ',')) AS n_fields FROM txt WHERE text IS NOT NULL")
def word_tokens(s, d):
    """White-space words, and fields of an explicit delimiter (empty ones kept)."""
    return texts(s, d).filter("text is not null").select("uttid", T.words(F.col("text")).alias("words"), F.size(T.delimited(F.col("text"), ",")).cast("bigint").alias("n_fields"))


@query(f"WITH {TEXTS} SELECT uttid, text FROM txt WHERE text IS NOT NULL")
def text_round_trip(s, d):
    """T5: characters joined again."""
    return texts(s, d).filter("text is not null").select("uttid", T.tokens_to_text(T.char_tokens(F.col("text"))).alias("text"))


@query(
    f"WITH {TEXTS}, c AS (SELECT uttid, list_transform(regexp_extract_all(text, '(?s)(.)', 1), lambda t: CASE WHEN t = ' ' THEN '<space>' ELSE t END) AS t FROM txt WHERE text IS NOT NULL) SELECT uttid, array_to_string(list_transform(range(0, CAST(ceil(len(t) / 2) AS BIGINT)), lambda i: array_to_string(t[2 * i + 1 : 2 * i + 2], '')), ' ') AS tokens FROM c"
)
def char_pairs(s, d):
    """Groups of two characters."""
    t = T.grouped_chars(F.col("text"), 2)
    return texts(s, d).filter("text is not null").select("uttid", F.array_join(t, " ").alias("tokens"))


@query(
    f"WITH {TEXTS}, w AS (SELECT uttid, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) AS pos FROM txt WHERE text IS NOT NULL), c AS (SELECT token, count(*) AS n, min(struct_pack(u := uttid, p := pos)) AS first FROM w GROUP BY token HAVING count(*) > 2), r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, first) AS r FROM c) SELECT token, n, r + 1 AS id FROM r WHERE r <= 498 UNION ALL SELECT '<blank>', NULL, 0 UNION ALL SELECT '<unk>', NULL, 1"
)
def vocabulary_by_count(s, d):
    """Counts above a cutoff, ties in the order of first sight, symbols inserted."""
    return V.by_count(texts(s, d), "uttid", T.words(F.col("text")), cutoff=2, size=500, symbols=[("<blank>", 0), ("<unk>", 1)]).select("token", "n", "id")


@query(
    f"WITH {TEXTS}, w AS (SELECT unnest({WORDS}) AS token FROM txt WHERE text IS NOT NULL), c AS (SELECT token, count(*) AS n FROM w WHERE token NOT IN ('<sos>', '<eos>', '<unk>') GROUP BY token HAVING count(*) > 1), r AS (SELECT token FROM c ORDER BY n DESC, token LIMIT 1000) SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM r UNION ALL SELECT '<unk>', 1"
)
def vocabulary_sorted(s, d):
    """The most frequent tokens in code-point order, ids from 2."""
    return V.sorted_tokens(texts(s, d), T.words(F.col("text")), cutoff=1, size=1000).select("token", "id")


@query(
    "WITH w AS (SELECT lang, unnest(" + WORDS + ") AS token FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), c AS (SELECT lang, token, count(*) AS n FROM w GROUP BY ALL HAVING count(*) > 1) SELECT lang, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM c) WHERE rank <= 50"
)
def word_vocab_topk(s, d):
    """The 50 most frequent words of each language."""
    return V.top_by_group(read_table(s, d, "documents").filter("lang is not null"), "lang", T.words(F.col("text")), cutoff=1, k=50)


_IDS = f"voc AS (SELECT token, row_number() OVER (ORDER BY token) + 1 AS id FROM (SELECT token FROM (SELECT unnest({WORDS}) AS token FROM txt WHERE text IS NOT NULL) WHERE token NOT IN ('<sos>', '<eos>', '<unk>') GROUP BY token HAVING count(*) > 1 ORDER BY count(*) DESC, token LIMIT 1000))"


@query(
    f"WITH {TEXTS}, {_IDS}, w AS (SELECT uttid, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) AS pos FROM txt WHERE text IS NOT NULL) SELECT uttid, list(coalesce(id, 1) ORDER BY pos) AS ids FROM w LEFT JOIN voc USING (token) GROUP BY uttid"
)
def token_ids_oov(s, d):
    """Words as ids, unknown ones as 1."""
    t = texts(s, d)
    vocab = V.sorted_tokens(t, T.words(F.col("text")), cutoff=1, size=1000)
    return V.token_ids(t, "uttid", T.words(F.col("text")), vocab, unknown=1).select("uttid", "ids")


@query(
    f"WITH {TEXTS}, {_IDS}, w AS (SELECT unnest({WORDS}) AS token FROM txt WHERE text IS NOT NULL) SELECT count(*) AS n_tokens, count(*) FILTER (WHERE id IS NULL AND token <> '<unk>') AS n_oovs FROM w LEFT JOIN voc USING (token)"
)
def token_and_oov_counts(s, d):
    """A7."""
    t = texts(s, d)
    vocab = V.sorted_tokens(t, T.words(F.col("text")), cutoff=1, size=1000)
    return V.oov_counts(t, T.words(F.col("text")), vocab)


@query(
    f"WITH {TEXTS}, c AS (SELECT DISTINCT uttid, unnest(regexp_extract_all(lower(text), '[a-z]')) AS label FROM txt WHERE text <> ''), n AS (SELECT label, count(*) AS k FROM c GROUP BY label UNION ALL SELECT '<eos>', count(*) FROM txt WHERE text <> '') SELECT label, k / sum(k) OVER () AS share FROM n"
)
def label_distribution(s, d):
    """Every label counted once an utterance, the end label with every utterance."""
    t = texts(s, d).filter("text <> ''")
    return V.label_distribution(t, F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0)))


#: Upper case as in the Unicode tables of Java, of which DuckDB has the single letters only.
UPPER = "replace(upper({c}), 'ß', 'SS')"


@query(f"WITH {TEXTS} SELECT uttid, trim(regexp_replace(regexp_replace({UPPER.format(c='text')}, '\\[[^\\]]*\\]|<[^>]*>', '', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM txt WHERE text IS NOT NULL")
def cleaned_text(s, d):
    """A chain of cleaners."""
    return texts(s, d).filter("text is not null").select("uttid", T.clean(F.col("text"), ["upper", "no_tags", "whitespace"]).alias("text"))


@query()
def english_cleaned(s, d):
    """English texts spelled out for speech (numbers are read as words; tested on fixed texts)."""
    return texts(s, d, "lang").filter("text is not null").select("uttid", F.when(F.col("lang") == "ja", T.clean(F.col("text"), ["jaconv"])).otherwise(T.clean(F.col("text"), ["tacotron"])).alias("text"))


@query(
    """
WITH spoken(sign, name) AS (VALUES ('0', '영'), ('1', '일'), ('2', '이'), ('3', '삼'), ('4', '사'), ('5', '오'), ('6', '육'), ('7', '칠'), ('8', '팔'), ('9', '구'),
  ('A', '에이'), ('B', '비'), ('C', '씨'), ('D', '디'), ('E', '이'), ('F', '에프'), ('G', '지'), ('H', '에이치'), ('I', '아이'), ('J', '제이'), ('K', '케이'), ('L', '엘'), ('M', '엠'),
  ('N', '엔'), ('O', '오'), ('P', '피'), ('Q', '큐'), ('R', '알'), ('S', '에스'), ('T', '티'), ('U', '유'), ('V', '브이'), ('W', '더블유'), ('X', '엑스'), ('Y', '와이'), ('Z', '지')),
c AS (SELECT recid, unnest(regexp_extract_all(trim(recid), '(?s).')) AS c, generate_subscripts(regexp_extract_all(trim(recid), '(?s).'), 1) AS i FROM wav_scp WHERE recid IS NOT NULL)
SELECT recid, string_agg(coalesce(name, c), '' ORDER BY i) AS spelled FROM c LEFT JOIN spoken ON sign = CASE WHEN c BETWEEN 'a' AND 'z' THEN upper(c) ELSE c END GROUP BY recid"""
)
def hangul_spelled(s, d):
    """Digits and letters spelled in Hangul."""
    return read_table(s, d, "wav_scp").select("recid", T.korean_clean(F.col("recid")).alias("spelled"))


@query(f"WITH {TEXTS} SELECT uttid, regexp_replace(regexp_replace({UPPER.format(c='text')}, ' +', ' ', 'g'), '\\(\\(', '(', 'g') || ' (' || uttid || ')' AS line, trim(regexp_replace(regexp_replace(text, '[()▁]', '', 'g'), ' +', ' ', 'g')) AS stripped, regexp_replace(text, '[!-/:-@\\[-`{{-~]', '', 'g') AS bare FROM txt WHERE text IS NOT NULL")
def normalised_trn(s, d):
    """Trn lines, stripped marks, no punctuation."""
    c = F.col("text")
    return texts(s, d).filter("text is not null").select("uttid", F.concat(T.normalise_trn(c), F.lit(" ("), "uttid", F.lit(")")).alias("line"), T.strip_marks(c).alias("stripped"), T.without_punctuation(c).alias("bare"))


@query(
    "WITH k AS (SELECT DISTINCT uttid, string_split_regex(uttid, '[-_]') AS f FROM segments WHERE regexp_matches(uttid, '^[a-z]+-s[0-9]+-r[0-9]+_[0-9]+_[0-9]+_[0-9]+$')) SELECT uttid, f[1] AS corpus, f[2] AS spk, (f[4]::BIGINT // 100) || '.' || printf('%02d', f[4]::BIGINT % 100) AS st, (f[5]::BIGINT // 100) || '.' || printf('%02d', f[5]::BIGINT % 100) AS et FROM k"
)
def parsed_utterance_keys(s, d):
    """Fields of utterance ids; hundredths as seconds."""
    f = T.key_fields(F.col("uttid"))
    rows = read_table(s, d, "segments").filter(F.col("uttid").rlike("^[a-z]+-s[0-9]+-r[0-9]+_[0-9]+_[0-9]+_[0-9]+$")).select("uttid").distinct()
    return rows.select("uttid", F.get(f, 0).alias("corpus"), F.get(f, 1).alias("spk"), T.hundredths(F.get(f, 3)).alias("st"), T.hundredths(F.get(f, 4)).alias("et"))


@query(
    f"WITH {shape_sql('a', TRAIN_SHAPES)}, {TEXTS}, {SPEAKERS} SELECT uttid, to_json(struct_pack(input := [struct_pack(name := 'input1', shape := a.shape)], output := [struct_pack(name := 'target1', text := text)], utt2spk := spk)) AS json FROM a JOIN txt USING (uttid) JOIN spk USING (uttid) WHERE text IS NOT NULL"
)
def utterance_json(s, d):
    """The nested record of each utterance as JSON."""
    a = shapes(s, d, TRAIN_SHAPES).join(texts(s, d).filter("text is not null"), "uttid").join(speakers(s, d), "uttid")
    record = F.struct(F.array(F.struct(F.lit("input1").alias("name"), "shape")).alias("input"), F.array(F.struct(F.lit("target1").alias("name"), "text")).alias("output"), F.col("spk").alias("utt2spk"))
    return a.select("uttid", F.to_json(record, {"ignoreNullFields": "false"}).alias("json"))


@query(f"WITH {shape_sql('a', TRAIN_SHAPES)}, {TEXTS} SELECT uttid, text, a.shape[1] AS ilen, 'target1' AS name FROM a JOIN txt USING (uttid) WHERE text IS NOT NULL")
def parsed_utterance_json(s, d):
    """Utterance records read back from JSON with a declared schema."""
    from voxloom.sources.json_utts import RECORD

    r = F.from_json("json", RECORD)
    made = utterance_json_any(s, d).select("uttid", r.alias("r"))
    return made.select("uttid", F.get(F.col("r.output"), 0)["text"].alias("text"), F.get(F.get(F.col("r.input"), 0)["shape"], 0).alias("ilen"), F.get(F.col("r.output"), 0)["name"].alias("name"))


def utterance_json_any(s, d):
    a = shapes(s, d, TRAIN_SHAPES).join(texts(s, d).filter("text is not null"), "uttid")
    record = F.struct(F.array(F.struct(F.lit("input1").alias("name"), "shape")).alias("input"), F.array(F.struct(F.lit("target1").alias("name"), "text")).alias("output"))
    return a.select("uttid", F.to_json(record).alias("json"))


@query("SELECT uttid, filename, shape[1] AS length, len(shape) AS dims FROM shape_file WHERE shape IS NOT NULL AND len(shape) > 0")
def parsed_shapes(s, d):
    """Shapes written as text and parsed again."""
    c = F.concat(F.lit("["), F.array_join("shape", ", "), F.lit("]"))
    rows = read_table(s, d, "shape_file").filter("size(shape) > 0").select("uttid", "filename", T.parse_shape(c).alias("p"))
    return rows.select("uttid", "filename", F.element_at("p", 1).alias("length"), F.size("p").cast("bigint").alias("dims"))


@query(
    f"WITH {TEXTS}, {_IDS}, w AS (SELECT uttid, unnest({WORDS}) AS token, generate_subscripts({WORDS}, 1) AS pos FROM txt WHERE text IS NOT NULL) SELECT uttid, string_agg(CASE WHEN id IS NULL THEN '<unk>' ELSE token END, ' ' ORDER BY pos) AS text FROM w LEFT JOIN voc USING (token) GROUP BY uttid"
)
def ids_to_text(s, d):
    """Ids back to tokens."""
    t = texts(s, d)
    vocab = V.sorted_tokens(t, T.words(F.col("text")), cutoff=1, size=1000)
    return V.ids_to_text(V.token_ids(t, "uttid", T.words(F.col("text")), vocab, unknown=1), "uttid", "ids", vocab)


@query(f"WITH {TEXTS}, w AS (SELECT uttid, {WORDS} AS w FROM txt WHERE text IS NOT NULL) SELECT uttid, array_to_string(list_prepend('<sos>', w), ' ') AS input, array_to_string(list_append(w, '<eos>'), ' ') AS target FROM w")
def bigram_shift(s, d):
    """Shifted pairs for language models."""
    return texts(s, d).filter("text is not null").select("uttid", T.bigram_shift(T.words(F.col("text"))).alias("b")).select("uttid", F.array_join("b.input", " ").alias("input"), F.array_join("b.target", " ").alias("target"))


@query(f"WITH {TEXTS}, c AS (SELECT uttid, regexp_extract_all(text, '(?s)(.)', 1) AS c FROM txt WHERE text IS NOT NULL) SELECT uttid, array_to_string(list_filter(list_filter(c, lambda v, i: i = 1 OR v <> c[i - 1]), lambda v: v <> ' '), '') AS collapsed FROM c")
def collapsed_chars(s, d):
    """Immediate repeats and blanks dropped."""
    c = F.regexp_extract_all("text", F.lit("(?s)(.)"), F.lit(1))
    return texts(s, d).filter("text is not null").select("uttid", F.array_join(T.collapse_repeats(c, [" "]), "").alias("collapsed"))


@query(f"WITH {TEXTS}, w AS (SELECT uttid, {WORDS} AS w FROM txt WHERE text IS NOT NULL) SELECT uttid, array_to_string(list_transform(w, lambda x: CASE WHEN x IN ('the', 'a', 'and') THEN '' ELSE x END), ' ') AS excluded, array_to_string(list_transform(w, lambda x: CASE WHEN x IN ('the', 'a', 'and') THEN x ELSE '<UNK>' END), ' ') AS included FROM w")
def word_filter(s, d):
    """Words excluded, or all but the listed made unknown."""
    v = ["the", "a", "and"]
    return texts(s, d).filter("text is not null").select("uttid", T.filter_words(F.col("text"), v, True).alias("excluded"), T.filter_words(F.col("text"), v, False).alias("included"))


@query(f"WITH {SPEAKERS} SELECT spk, list(uttid ORDER BY uttid) AS utts FROM spk GROUP BY spk")
def speaker_to_utterances(s, d):
    """The utterances of each speaker in one list."""
    return speakers(s, d).groupBy("spk").agg(F.array_sort(F.collect_list("uttid")).alias("utts"))


@query(
    f"WITH {TEXTS}, {SPEAKERS}, {SEGMENTS} SELECT uttid, recid || ' 1 ' || spk || ' ' || (((CAST(round(starttime * 1000) AS BIGINT) + 5) // 10) // 100) || '.' || printf('%02d', ((CAST(round(starttime * 1000) AS BIGINT) + 5) // 10) % 100) || ' ' || (((CAST(round(endtime * 1000) AS BIGINT) + 5) // 10) // 100) || '.' || printf('%02d', ((CAST(round(endtime * 1000) AS BIGINT) + 5) // 10) % 100) || ' ' || {UPPER.format(c='text')} AS line FROM txt JOIN spk USING (uttid) JOIN seg USING (uttid) WHERE text IS NOT NULL AND recid IS NOT NULL AND endtime > starttime"
)
def stm_lines(s, d):
    """K7: stm lines."""
    from voxloom.sources.formats import stm_line

    rows = texts(s, d).filter("text is not null").join(speakers(s, d), "uttid").join(segments(s, d), "uttid").filter("recid is not null and endtime > starttime")
    return rows.select("uttid", stm_line("recid", "spk", "starttime", "endtime", "text").alias("line"))
