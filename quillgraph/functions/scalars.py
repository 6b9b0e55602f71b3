"""Scalar functions: names, keys, hashes, ids, quotes, retry arithmetic.

Native columns wherever Spark has the operation; Unicode normalisation and
canonical JSON go through Arrow-batched functions.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Fixed values.
CHUNK_VERSION, UNIT_SEPARATOR = "1", "\x1f"
QUOTE_LIMIT, ELLIPSIS = 500, "…"
DOCUMENT_SUMMARY_VERSION = "document-summary-v1"
NAMESPACE_URL = uuid.NAMESPACE_URL
CHUNK_NAMESPACE = str(uuid.uuid5(NAMESPACE_URL, "quillgraph:chunk:v1"))
LOCK_PREFIX = b"quillgraph:pipeline_runs:dataset:"
GLOBAL_LOCK = -1


def _each(f):
    return lambda s: s.map(lambda x: None if x is None else f(x))


# --- X01-X03: Unicode-aware names ---------------------------------------------------------


def identity_text(value: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", value).split()).casefold()


def predicate_text(value: str) -> str:
    folded = unicodedata.normalize("NFKC", value).strip().casefold()
    return re.sub(r"\W+", "_", re.sub(r"[\s-]+", "_", folded)).strip("_")


def slug_text(value: str) -> str:
    plain = unicodedata.normalize("NFKD", value.strip()).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


@pandas_udf(T.StringType())
def _identity(s: pd.Series) -> pd.Series:
    return _each(identity_text)(s)


@pandas_udf(T.StringType())
def _predicate(s: pd.Series) -> pd.Series:
    return _each(predicate_text)(s)


@pandas_udf(T.StringType())
def _slug(s: pd.Series) -> pd.Series:
    return _each(slug_text)(s)


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def canonical_entity_key(entity_type: Column, name: Column) -> Column:
    """``type:name`` of both normalised; null where one is blank."""
    t, n = _identity(entity_type), _identity(name)
    return F.when((F.length(t) > 0) & (F.length(n) > 0), F.concat(t, F.lit(":"), n))


def ascii_entity_key(entity_type: Column, name: Column) -> Column:
    """X01 for ASCII input, without leaving the JVM."""
    norm = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), r"[\s\x1c-\x1f]+", " "))
    return F.when((F.length(norm(entity_type)) > 0) & (F.length(norm(name)) > 0), F.concat(norm(entity_type), F.lit(":"), norm(name)))


def relation_predicate(c: Column) -> Column:
    """Conservative snake case."""
    return _predicate(c)


def ascii_predicate(c: Column) -> Column:
    """X02 for ASCII input."""
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[\s-]+", "_"), r"\W+", "_"), "^_+|_+$", "")


def dataset_slug(c: Column) -> Column:
    """Null where nothing is left."""
    return F.when(F.length(_slug(c)) > 0, _slug(c))


# --- X04-X06, X11, X12: text ---------------------------------------------------------------


def reference_quote(c: Column, limit: int = QUOTE_LIMIT) -> Column:
    """White space collapsed; longer quotes end in an ellipsis."""
    one = F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))
    return F.when(F.length(one) <= limit, one).otherwise(F.concat(F.rtrim(F.substring(one, 1, limit - 1)), F.lit(ELLIPSIS)))


def folded_type(c: Column) -> Column:
    """X05."""
    return F.lower(F.trim(c))


def entity_text(name: Column) -> Column:
    """What is embedded of an entity."""
    return F.trim(name)


def relation_text(source: Column, predicate: Column, description: Column, target: Column) -> Column:
    """What is embedded of a relation."""
    said = F.when(F.length(F.trim(F.coalesce(description, F.lit("")))) > 0, F.concat(F.trim(predicate), F.lit(": "), F.trim(description))).otherwise(F.trim(predicate))
    return F.concat(F.trim(source), F.lit("-›"), said, F.lit("-›"), F.trim(target))


def literal_parts(text: Column, aliases: Column, evidence: Column | None = None) -> Column:
    """X11: every alias, and the evidence, stands in the text as it is."""
    ok = F.forall(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.contains(text, a))
    return ok if evidence is None else ok & F.contains(text, evidence)


def first_mention(text: Column, name: Column, aliases: Column) -> Column:
    """struct(surface_text, start_char, end_char) of the first of name and aliases that occurs; offsets null if none does."""
    found = F.transform(F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>"))), lambda a: F.struct(a.alias("a"), (F.call_function("locate", a, text) - 1).alias("at")))
    hit = F.try_element_at(F.filter(found, lambda x: x["at"] >= 0), F.lit(1))
    return F.struct(F.coalesce(hit["a"], name).alias("surface_text"), hit["at"].alias("start_char"), (hit["at"] + F.length(hit["a"])).alias("end_char"))


# --- X13-X17, X25: hashes and ids --------------------------------------------------------------


def chunk_hash(text: Column) -> Column:
    """X13."""
    return F.sha2(F.concat(F.lit(CHUNK_VERSION + UNIT_SEPARATOR), text), 256)


def uuid5(namespace: Column | str, name: Column) -> Column:
    """Name-based UUID, as native text operations. ``namespace`` is UUID text."""
    ns = F.lit(namespace) if isinstance(namespace, str) else namespace
    h = F.sha1(F.concat(F.unhex(F.regexp_replace(ns, "-", "")), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def chunk_id(document_id: Column, generation: Column, ordinal: Column, sha: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat_ws(":", document_id, generation.cast("string"), ordinal.cast("string"), sha))


def document_summary_id(document_id: Column, generation: Column) -> Column:
    return uuid5(document_id, F.concat_ws(":", F.lit("document-summary"), generation.cast("string"), F.lit(DOCUMENT_SUMMARY_VERSION)))


def dataset_summary_id(dataset_id: Column, generation: Column) -> Column:
    return uuid5(dataset_id, F.concat_ws(":", F.lit("dataset-summary"), generation.cast("string")))


def compact_json(payload: object, *, ascii_only: bool) -> str:
    return json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)


@pandas_udf(T.StringType())
def _payload_hash(s: pd.Series) -> pd.Series:
    return _each(lambda x: hashlib.sha256(compact_json(json.loads(x), ascii_only=False).encode()).hexdigest())(s)


def payload_hash(json_text: Column) -> Column:
    """sha256 of the compact JSON with sorted keys, characters as they are."""
    return _payload_hash(json_text)


@pandas_udf(T.StringType())
def _step_hash(d: pd.Series, s: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else hashlib.sha256(compact_json({"definition_id": a, "input": json.loads(b)}, ascii_only=True).encode()).hexdigest() for a, b in zip(d, s, strict=True)])


def step_input_hash(definition_id: Column, json_text: Column) -> Column:
    """As X15 with escaped characters, in an envelope with the step's definition."""
    return _step_hash(definition_id, json_text)


def config_fingerprint(settings: dict) -> str:
    """sha256 of the settings; URLs lose credentials and queries, secrets are left out."""
    from urllib.parse import urlsplit, urlunsplit

    def clean(v):
        if isinstance(v, str) and "://" in v:
            u = urlsplit(v)
            return urlunsplit((u.scheme, u.hostname + (f":{u.port}" if u.port else "") if u.hostname else "", u.path, "", ""))
        return v

    kept = {k: clean(v) for k, v in settings.items() if not re.search(r"key|secret|password|token$", k)}
    return hashlib.sha256(compact_json(kept, ascii_only=True).encode()).hexdigest()


def lock_key(dataset_id: Column) -> Column:
    """63 bits of a prefixed sha256; kept for parity of arbitration keys, nothing here takes locks."""
    digest = F.sha2(F.concat(F.lit(bytearray(LOCK_PREFIX)), F.unhex(F.regexp_replace(dataset_id, "-", ""))), 256)
    high = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").bitwiseAND(0x7FFFFFFF)
    return F.shiftleft(high, 32) + F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint")


# --- X19, X23, X24, X27, X29, X32, X33 ---------------------------------------------------------------


def rrf_score(*ranks: Column, k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over the ranks that are there."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.lit(1.0) / (F.lit(k) + r), F.lit(0.0))
    return out


def backoff_seconds(attempt: Column, jitter: Column, *, base: float = 1.0, cap: float = 60.0) -> Column:
    """X23."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0)))) + jitter


def attempts_left(attempt: Column, most: int = 5) -> Column:
    return attempt < most


def heartbeat_seconds(stale_after: Column) -> Column:
    """X24."""
    return F.least(F.lit(30.0), F.greatest(F.lit(0.25), stale_after * F.lit(1.0 / 3.0)))


MARKER_VERSION = "degree-v1"


def importance_marker(properties: Column) -> Column:
    """struct(feedback_weight, centrality_weight) of a valid marker in JSON properties, else null.

    A weight is valid if it is a JSON number (not true, false or text) from 0 to 1.
    """
    v = F.try_parse_json(properties)
    get = lambda path, t: F.try_variant_get(v, path, t)
    number = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
    a, b = get("$.importance.feedback_weight", "double"), get("$.importance.centrality_weight", "double")
    ok = (get("$.importance.version", "string") == MARKER_VERSION) & number("$.importance.feedback_weight") & number("$.importance.centrality_weight") & a.between(0, 1) & b.between(0, 1)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(a.alias("feedback_weight"), b.alias("centrality_weight")))


def with_importance_marker(feedback: Column, centrality: Column) -> Column:
    """The marker as JSON."""
    return F.to_json(F.struct(F.struct(F.lit(MARKER_VERSION).alias("version"), feedback.alias("feedback_weight"), centrality.alias("centrality_weight")).alias("importance")))


REFERENCES = "struct<items:array<struct<source_id:string,document_id:string,chunk_id:string,chunk_ordinal:int,score:double>>>"


def parse_references(c: Column) -> Column:
    """Array of reference structs; bad JSON or a missing list is empty, items without any id are skipped."""
    items = F.from_json(c, REFERENCES)["items"]
    empty = F.array().cast(REFERENCES[len("struct<items:") : -1])
    return F.filter(F.coalesce(items, empty), lambda x: x["chunk_id"].isNotNull() | x["document_id"].isNotNull() | x["source_id"].isNotNull())


def write_references(items: Column) -> Column:
    return F.to_json(F.struct(items.alias("items")))


def source_name(name: Column, fallback: Column) -> Column:
    """X32."""
    return F.coalesce(F.when(F.length(F.trim(name)) > 0, F.trim(name)), fallback)


def document_metadata(metadata: Column, session_id: Column) -> Column:
    """A map with the session id put in where there is one."""
    extra = F.when(session_id.isNotNull(), F.create_map(F.lit("session_id"), session_id)).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(metadata, lambda k, _: (k != "session_id") | session_id.isNull()), extra)


def valid_extraction(x: Column, text: Column) -> Column:
    """X33 with X11: ids unique, ends exist and differ, confidences in [0, 1], nothing blank, parts literal."""
    e, r = x["entities"], x["relations"]
    ids = F.transform(e, lambda v: v["local_id"])
    filled = lambda c: F.length(F.trim(c)) > 0
    ok = F.size(F.array_distinct(ids)) == F.size(ids)
    ok &= F.forall(e, lambda v: filled(v["local_id"]) & filled(v["name"]) & filled(v["type"]) & v["confidence"].between(0, 1) & F.forall(v["aliases"], lambda a: F.contains(text, a)))
    ok &= F.forall(r, lambda v: F.array_contains(ids, v["source_local_id"]) & F.array_contains(ids, v["target_local_id"]) & (v["source_local_id"] != v["target_local_id"]) & filled(v["predicate"]) & v["confidence"].between(0, 1) & F.contains(text, v["evidence"]))
    return F.coalesce(ok, F.lit(False))
