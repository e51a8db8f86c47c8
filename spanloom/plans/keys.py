"""Queries on keys of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as ky
from ..sources.tables import table
from .registry import query


@query("""SELECT event_id, sha256('{"a":' || CAST(json(props) AS VARCHAR) || ',"kind":"' || event_type || '","z":[' || event_id || ',null]}') AS fingerprint FROM events""")
def json_fingerprints(spark, d):
    """The same record with its fields in two orders has one fingerprint."""
    e, i = table(spark, d, "events"), F.col("event_id").cast("string")
    one = F.concat(F.lit('{ "kind": "'), "event_type", F.lit('", "a": '), "props", F.lit(', "z": ['), i, F.lit(", null] }"))
    two = F.concat(F.lit('{"z":['), i, F.lit(',null],"a":'), "props", F.lit(',"kind":"'), "event_type", F.lit('"}'))
    return e.select("event_id", F.when(F.col("event_id") % 2 == 0, ky.fingerprint(one)).otherwise(ky.fingerprint(two)).alias("fingerprint"))


@query("""SELECT doc_id, sha256('{"extra":{"lang":' || coalesce('"' || lang || '"', 'null') || '},"fields":{"artifact":"text","duration":' || coalesce(CAST(n_chars AS VARCHAR), 'null') || ',"input":"' || sha256(text) || '","version":"key-v1"}}') AS key FROM documents WHERE text IS NOT NULL""")
def result_keys(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", ky.result_key({"input": F.sha2("text", 256), "artifact": F.lit("text")}, F.col("n_chars"), {"lang": F.col("lang")}).alias("key"))
