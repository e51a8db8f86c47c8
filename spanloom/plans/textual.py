"""Queries for text functions over documents, conversations and part names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..sources.tables import spans, table
from .registry import query


@query(r"""SELECT doc_id, length(regexp_replace(text, '[ \n]', '', 'g')) AS chars, len(regexp_extract_all(text, '[^\t\n\x0B\f\r ]+')) AS words, len(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?')) AS numbers,
CASE WHEN len(regexp_extract_all(text, '[A-Za-z]')) > 0 THEN 'latin' ELSE 'other' END AS script FROM documents""")
def text_profile(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.display_chars(t).cast("long").alias("chars"), tx.count_words(t).cast("long").alias("words"), F.size(tx.numbers(t)).cast("long").alias("numbers"), tx.script(t).alias("script"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+|[\x{4E00}-\x{9FFF}]') AS t FROM documents)
SELECT doc_id, coalesce(len(list_filter(list_zip(t[1:-2], t[2:]), lambda p: p[1] = p[2])) > 0, false) AS repeats FROM t""")
def token_repetition(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(tx.repeats_token(F.col("text")), F.lit(False)).alias("repeats"))


@query(r"""WITH u AS (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$'), lambda x: trim(x)), lambda x: x <> '') AS u FROM conversations)
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS piece, u[i] AS utterance FROM (SELECT *, unnest(range(1, len(u) + 1)) AS i FROM u)""")
def cue_utterances(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(tx.utterances(F.col("text"))).alias("piece", "utterance"))


@query(r"""WITH n AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_type ORDER BY p_name, p_partkey) AS b FROM part), x AS (SELECT *, regexp_replace(lower(a), '[^\p{L}\p{N}]', '', 'g') AS ba, regexp_replace(lower(b), '[^\p{L}\p{N}]', '', 'g') AS bb FROM n WHERE b IS NOT NULL)
SELECT p_partkey, CASE WHEN a = b THEN 'same' WHEN ba = bb THEN 'punctuation' WHEN 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) > 0.5 THEN 'rewording' ELSE 'other' END AS edit FROM x""")
def text_edit_class(spark, d):
    n = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("a"), F.lead("p_name").over(W.partitionBy("p_type").orderBy("p_name", "p_partkey")).alias("b"))
    return n.where("b IS NOT NULL").select("p_partkey", tx.edit_class(F.col("a"), F.col("b")).alias("edit"))


@query("""WITH {S}, f AS (SELECT media_id, speaker, min(t0) AS t0 FROM s GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY media_id ORDER BY t0, speaker) - 1 AS n FROM f)
SELECT media_id, speaker, chr(CAST(65 + n % 26 AS INTEGER)) AS letter FROM r""")
def speaker_letters(spark, d):
    first = spans(spark, d).groupBy("media_id", "speaker").agg(F.min("t0").alias("t0"))
    n = F.dense_rank().over(W.partitionBy("media_id").orderBy("t0", "speaker")) - 1
    return first.withColumn("n", n).select("media_id", "speaker", tx.letters(F.col("n")).alias("letter"))


@query()
def cue_wrap(spark, d):
    """Lines of at most 42 characters wrap once, at the middle (tests hold it against a loop)."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(tx.utterances(F.col("text"))).alias("piece", "u"))
    return c.select("conv_id", "turn", "piece", tx.wrap_middle(F.col("u"), 42).alias("lines"))


@query(r"""WITH c AS (SELECT conv_id, turn, text, (turn % 5) / CAST(5 AS DOUBLE) AS ns, -(turn % 3) * CAST(0.75 AS DOUBLE) AS lp FROM conversations), b AS (SELECT *, regexp_replace(lower(text), '[\s\p{P}]', '', 'g') AS bare FROM c)
SELECT conv_id, turn, CASE WHEN bare = '' THEN 'empty' WHEN bare IN ('字幕志愿者', '中文字幕志愿者', '感谢观看', '感谢收看', 'thanksforwatching') THEN 'training phrase' WHEN ns >= 0.6 AND lp < -1 THEN 'no speech' END AS fault FROM b""")
def segment_filter(spark, d):
    k = F.col("turn")
    fault = tx.segment_fault(F.col("text"), (k % 5) / 5.0, -(k % 3) * 0.75, F.lit(None).cast("double"))
    return table(spark, d, "conversations").select("conv_id", "turn", fault.alias("fault"))


@query(r"""WITH c AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'One ' || text WHEN 1 THEN 'two  small words' WHEN 2 THEN 'Three!' WHEN 3 THEN text || ' lesti, SUZY' ELSE text END AS t FROM conversations WHERE text IS NOT NULL),
n AS (SELECT *, regexp_extract(t, '(?i)^(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)\s+[\pL\pN_]', 1) AS w, len(regexp_extract_all(t, '\S+')) AS few FROM c),
m AS (SELECT *, MAP {'one': '1.', 'two': '2.', 'three': '3.'}[lower(w)] AS no, MAP {'one': '1.', 'two': '2.', 'three': '3.'}[lower(rtrim(trim(t), '.,!?;:'))] AS alone, trim(substr(t, length(w) + 1)) AS rest FROM n),
r AS (SELECT conv_id, turn, t, CASE WHEN w <> '' AND (regexp_matches(rest, '^\p{Lu}') OR few <= 6) THEN no || ' ' || rest WHEN alone IS NOT NULL AND few = 1 THEN alone || substr(t, length(rtrim(t, '.,!?;:')) + 1) ELSE t END AS x FROM m),
f AS (SELECT conv_id, turn, t, array_to_string(list_transform(regexp_extract_all(x, '\S+'), lambda w: CASE lower(rtrim(w, '.,')) WHEN 'lesti' THEN CASE WHEN regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}') THEN 'LESTIE' ELSE 'Lestie' END || regexp_extract(w, '([.,]*)$', 1)
WHEN 'suzy' THEN CASE WHEN regexp_matches(w, '\p{Lu}') AND NOT regexp_matches(w, '\p{Ll}') THEN 'SUSIE' ELSE 'Susie' END || regexp_extract(w, '([.,]*)$', 1) ELSE w END), ' ') AS x FROM r)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '\S') THEN CASE WHEN regexp_matches(x, '[\pL\pN]$') THEN x || '.' ELSE x END ELSE t END AS text FROM f""")
def normalized_texts(spark, d):
    k, t = F.col("turn") % 5, F.col("text")
    said = F.when(k == 0, F.concat(F.lit("One "), t)).when(k == 1, "two  small words").when(k == 2, "Three!").when(k == 3, F.concat(t, F.lit(" lesti, SUZY"))).otherwise(t)
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", tx.normalized(said).alias("text"))
