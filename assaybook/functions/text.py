"""Plain text, hashes, cursors, labels and strict JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaybook.functions.rfc3339 import valid

FORBIDDEN = r"[\x00-\x08\x0A-\x1F\x7F<>]"
MAX_OBSERVATION, MAX_FRAME = 65_536, 1_048_576


def plain_text_valid(s: Column) -> Column:
    return ~s.rlike(FORBIDDEN)


def first_forbidden(s: Column) -> Column:
    """Byte offset of the first forbidden character; null if there is none."""
    return F.when(s.rlike(FORBIDDEN), F.octet_length(F.split(s, FORBIDDEN, 2)[0]))


def content_hash(*fields: Column) -> Column:
    """SHA-256 of length-prefixed fields, absent ones told apart from empty ones."""
    parts = [F.when(f.isNull(), F.lit("-;")).otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"), F.lit(";"))) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def address_set_hash(addresses: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(addresses)), "\n"), 256)


def local_id(resource: Column, txid: Column) -> Column:
    return F.concat_ws(":", resource, txid)


def is_txid(s: Column) -> Column:
    return s.rlike(r"\A[0-9a-f]{64}\z")


CURSOR = r"\A\+?([0-9]+):((?:[0-9a-f]{64})?)(?::m:([0-9a-f]{64}))?\z"
_MOST_HEIGHT = (1 << 64) - 1


def cursor_encode(height: Column, txid: Column, mempool: Column | None = None) -> Column:
    base = F.concat(height.cast("string"), F.lit(":"), txid)
    return base if mempool is None else F.when(mempool.isNull(), base).otherwise(F.concat(base, F.lit(":m:"), mempool))


def cursor_parse(s: Column) -> Column:
    """``struct(height, txid, mempool)``; null if the text is no cursor. A height may have leading zeros, a txid may be empty."""
    part = lambda n: F.regexp_extract(s, CURSOR, n)
    height = F.regexp_replace(part(1), r"\A0+(?=[0-9])", "").try_cast("decimal(38,0)")
    fits = s.rlike(CURSOR) & F.coalesce(height <= F.lit(str(_MOST_HEIGHT)).cast("decimal(38,0)"), F.lit(False))
    return F.when(fits, F.struct(height.cast("decimal(20,0)").alias("height"), part(2).alias("txid"), F.nullif(part(3), F.lit("")).alias("mempool")))


def strict_object(s: Column, required: list[str], optional: list[str] | None = None) -> Column:
    """Whether the text is one JSON object with all required and no unknown or repeated keys."""
    keys = F.json_object_keys(s)
    known = F.array(*[F.lit(k) for k in [*required, *(optional or [])]])
    has_all = F.size(F.array_intersect(keys, F.array(*[F.lit(k) for k in required]))) == len(required) if required else F.lit(True)
    return F.coalesce(F.try_parse_json(s).isNotNull() & keys.isNotNull() & has_all & (F.size(F.array_except(keys, known)) == 0), F.lit(False))


# The outcome vocabulary, bare and with a body.
BARE_OUTCOMES = ("not_fetched", "unavailable", "reauth_required", "revoked", "gone", "sca_required")
KEYED_OUTCOMES = {"fetched": ("page_empty", "BOOLEAN"), "stale": ("as_of", "STRING"), "rate_limited": ("retry_after_ms", "BIGINT")}


def outcome_kind(raw: Column) -> Column:
    """Kind of a bare string, or of an object of one outcome whose body has its one field; null if it is neither."""
    value = F.try_parse_json(raw)
    shape = F.schema_of_variant(value)
    bare = F.when(shape == "STRING", F.try_variant_get(value, "$", "string"))
    out = F.when(bare.isin(*BARE_OUTCOMES), bare)
    right = {
        "fetched": F.lit(True),
        "stale": valid(F.try_variant_get(value, "$.stale.as_of", "string")),
        "rate_limited": F.try_variant_get(value, "$.rate_limited.retry_after_ms", "bigint") >= 0,
    }
    for kind, (field, kind_of) in KEYED_OUTCOMES.items():
        out = out.when((shape == f"OBJECT<{kind}: OBJECT<{field}: {kind_of}>>") & F.coalesce(right[kind], F.lit(False)), F.lit(kind))
    return out


def outcome_label(kind: Column, as_of: Column) -> Column:
    return F.when(kind == "stale", F.concat(F.lit("stale:"), as_of)).otherwise(kind)


def http_outcome(status: Column) -> Column:
    """What a provider's status means: 404 is an answer, that there is nothing there."""
    return F.when(status == 200, F.lit("fetched")).when(status == 404, F.lit("not_found")).when(status == 429, F.lit("rate_limited")).otherwise(F.lit("unavailable"))


def corpus_name(path: Column) -> Column:
    return F.replace(F.ltrim(path, F.lit("/")), F.lit("/"), F.lit("_"))


def describe(delta: Column) -> Column:
    """What a transaction did to a wallet."""
    return F.when(delta > 0, F.lit("received")).when(delta < 0, F.lit("sent")).otherwise(F.lit("self-transfer"))


def observation_bytes(observation: Column) -> Column:
    return F.octet_length(F.to_json(observation))
