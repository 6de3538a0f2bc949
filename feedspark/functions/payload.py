"""Column expressions of the enrich and decode jobs.

Each function returns a Column (or a DataFrame projection) built from
built-in functions only, so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CLASSIFY_PREFIX_CHARS

PAYLOAD_SCHEMA = ("struct<id:string,title:string,summary:string,body:string,"
                  "tags:array<string>,topic:string>")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nullif_empty(c) -> Column:
    c = _c(c)
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def body_fallback(body="body", text="text") -> Column:
    """B1: body if the field is present, else text, else '' (presence, not truthiness)."""
    return F.coalesce(_c(body), _c(text), F.lit(""))


def classifier_input(title="title", body="body", prefix: int = CLASSIFY_PREFIX_CHARS) -> Column:
    """B2: title + ' ' + the first ``prefix`` characters of body."""
    return F.concat(_c(title), F.lit(" "), F.substring(_c(body), 1, prefix))


def payload_struct(id_="id", title="title", body="body", topic="topic", summary=None) -> Column:
    """The six-field document; summary is '' unless given (it never is)."""
    summ = F.lit("") if summary is None else F.coalesce(_c(summary), F.lit(""))
    return F.struct(
        _c(id_).cast("string").alias("id"), _c(title).alias("title"), summ.alias("summary"),
        F.coalesce(_c(body), F.lit("")).alias("body"),
        F.array(_c(topic)).alias("tags"), _c(topic).alias("topic"),
    )


def encode_payload(id_="id", title="title", body="body", topic="topic") -> Column:
    """JSON text of the document."""
    return F.to_json(payload_struct(id_, title, body, topic))


def bare_fields_json(*names: str) -> Column:
    """JSON of the entry's own fields (what a producer without ``data`` wrote)."""
    return F.to_json(F.struct(*[F.col(n) for n in names]))


def decode_payload_fanout(data="data", bare: Column | None = None) -> Column:
    """Parse ``data`` if truthy, else the entry's own fields."""
    src = F.coalesce(nullif_empty(data), bare) if bare is not None else nullif_empty(data)
    return F.from_json(src, PAYLOAD_SCHEMA)


def decode_payload_feed(data="data", bare: Column | None = None) -> Column:
    """Like B4, but a payload that is not JSON fails the job."""
    src = F.coalesce(nullif_empty(data), bare) if bare is not None else nullif_empty(data)
    return F.from_json(src, PAYLOAD_SCHEMA, {"mode": "FAILFAST"})


def decode_payload_topic(data="data") -> tuple[Column, Column, Column]:
    """(is_bare, parsed, raw): missing ``data`` = bare fields; anything that is no JSON object
    (not JSON, or a number, string or array) = raw string."""
    d = _c(data)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(d)).startswith("OBJECT"), F.lit(False))
    return d.isNull(), F.when(is_object, F.from_json(d, PAYLOAD_SCHEMA)), F.when(d.isNotNull() & ~is_object, d)


def payload_fields(data="data") -> Column:
    """All keys of a JSON object as text, those outside the six fields included; NULL for anything else."""
    d = _c(data)
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(d)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.from_json(d, "map<string,string>"))


def doc_identity(id_="id", entry_id="entry_id") -> Column:
    """The document id as a string; a NULL or empty id falls back to the log entry id."""
    return F.coalesce(nullif_empty(_c(id_).cast("string")), _c(entry_id))


def route_topic(topic="topic") -> Column:
    """Name of the topic log an enriched document goes to."""
    return F.concat(F.lit("topic:"), _c(topic))
