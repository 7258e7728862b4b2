"""JSON encoding of messages, with strict decoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlog import schema as S
from partlog.functions.keys import _col

_TEXT_FIELDS = ("key", "payload")
_INT_FIELDS = ("sequence", "partition", "ts")

NOT_JSON = "not a JSON value"
NOT_A_MESSAGE = "JSON value is not a message"


#: What a strict parser takes; names that come twice are left to ``_by_name``.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns through a generator, below which no filter is pushed.

    A filter on a parsed column would otherwise be rewritten into one that parses the
    text again for every reference.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _parsed(df: DataFrame, raw: str) -> DataFrame:
    """Add ``_sound`` (one JSON value and nothing else), ``_void`` and ``_fields``.

    An object is read as the list of its entries, in the order of the text and with repeated
    names.  Text after the value goes unnoticed there; inside brackets, it is an error or a
    second element, unless it closes the bracket, and text with a closing bracket must
    therefore also parse inside an object.
    """
    text = _col(raw).cast("string")
    inside = F.concat(F.lit("["), text, F.lit("]"))
    boxed = F.json_object_keys(F.concat(F.lit('{"m":'), text, F.lit("}")))
    closed = ~F.contains(text, F.lit("]")) | boxed.isNotNull()
    alone = (F.json_array_length(inside) == 1) & closed
    entries = F.map_entries(F.from_json(text, "map<string,variant>", _STRICT))
    df = _once(df, _entries=entries, _alone=F.coalesce(alone, F.lit(False)))
    other = F.when(F.col("_entries").isNull(), F.try_variant_get(F.try_parse_json(inside), "$[0]", "variant"))
    df = _once(df, _other=other)
    return _once(
        df,
        _sound=F.col("_alone") & (F.col("_entries").isNotNull() | F.col("_other").isNotNull()),
        _void=F.coalesce(F.is_variant_null("_other"), F.lit(False)),
    ).transform(_by_name)


def _by_name(df: DataFrame) -> DataFrame:
    """Add ``_fields``, the value of each field, and ``_clash``.

    Names count without case, as a decoder matches them.  Of several values of one name the
    last one that is not null counts; all of them must have the field's type.
    """
    entries = F.coalesce("_entries", F.array().cast("array<struct<key:string,value:variant>>"))
    df = _once(df, _names=F.transform(entries, lambda e: F.lower(e["key"])))
    names = F.col("_names")
    repeated = F.size(F.array_distinct(names)) < F.size(names)
    fields, clash = [], F.lit(False)
    for name in (*_TEXT_FIELDS, *_INT_FIELDS):
        given = _given(entries, name)
        last = F.get(given, F.size(given) - 1)["value"]
        only = F.get(entries, F.array_position(names, name).cast("int") - 1)["value"]
        fields.append(F.when(repeated, last).otherwise(only).alias(name))
        clash = clash | ~_all_are(given, "STRING" if name in _TEXT_FIELDS else "BIGINT")
    found = F.when(F.col("_entries").isNotNull(), F.struct(*fields))
    return _once(df, _fields=found, _clash=F.when(repeated, clash).otherwise(False))


def _given(entries: Column, name: str) -> Column:
    return F.filter(entries, lambda e: (F.lower(e["key"]) == name) & ~F.is_variant_null(e["value"]))


def _all_are(entries: Column, kind: str) -> Column:
    return F.forall(entries, lambda e: F.schema_of_variant(e["value"]) == kind)


def _is_message() -> Column:
    """Top level is an object or null, and every field is absent, null or of its type."""
    fields = F.col("_fields")

    def typed(name: str, wanted: str) -> Column:
        return _absent(fields[name]) | (F.schema_of_variant(fields[name]) == wanted)

    ok = fields.isNotNull() & ~F.col("_clash")
    for name in _TEXT_FIELDS:
        ok = ok & typed(name, "STRING")
    for name in _INT_FIELDS:
        ok = ok & typed(name, "BIGINT")
    # A partition beyond 32 bits does not fit the column.
    partition = fields["partition"]
    ok = ok & (_absent(partition) | F.try_variant_get(partition, "$", "int").isNotNull())
    return F.col("_sound") & (F.col("_void") | ok)


def _field(name: str, type_name: str, default) -> Column:
    got = F.try_variant_get(F.col("_fields")[name], "$", type_name)
    return F.coalesce(got, F.lit(default).cast(type_name)).alias(name)


def decode_messages(
    df: DataFrame, raw: str = "data", hold: Callable[[DataFrame], DataFrame] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split raw JSON rows into decoded messages and rejected rows.

    Decoded rows get the message columns in place of ``raw``; absent or null fields
    are '' or 0.  Rejected rows keep every column and get ``error``.  Whatever uses either
    decodes the text again, unless ``hold`` keeps the decoded rows, such as in a table.
    """
    parsed = _parsed(df, raw)
    others = [c for c in df.columns if c != raw and c not in S.MESSAGE.names]
    fields = [
        _field("key", "string", ""),
        _field("sequence", "bigint", 0),
        _field("payload", "string", ""),
        _field("partition", "int", 0),
        _field("ts", "bigint", 0),
    ]
    error = F.when(F.col("_sound"), F.lit(NOT_A_MESSAGE)).otherwise(F.lit(NOT_JSON))
    if hold is None:
        good = parsed.where(_is_message()).select(*others, *fields)
        return good, parsed.where(~_is_message()).select(*df.columns, error.alias("error"))
    kept = [F.col(c).alias(f"_of_{k}") for k, c in enumerate(df.columns)]
    why = F.when(_is_message(), F.lit(None)).otherwise(error)
    judged = parsed.select(*kept, why.alias("_error"), *fields)
    text = f"_of_{df.columns.index(raw)}"  # kept for rejected rows only
    held = hold(judged.withColumn(text, F.when(F.col("_error").isNotNull(), F.col(text))))
    given = {c: F.col(f"_of_{k}").alias(c) for k, c in enumerate(df.columns)}
    good = held.where(F.col("_error").isNull()).select(*[given[c] for c in others], *S.MESSAGE.names)
    bad = held.where(F.col("_error").isNotNull()).select(*given.values(), F.col("_error").alias("error"))
    return good, bad


def encode_messages(df: DataFrame, out: str = "data") -> DataFrame:
    """Replace the message columns by their JSON text; NULLs become '' or 0."""
    fields = []
    for f in S.MESSAGE.fields:
        default = F.lit("") if f.name in _TEXT_FIELDS else F.lit(0).cast(f.dataType)
        value = F.col(f.name).cast(f.dataType) if f.name in df.columns else default
        fields.append(F.coalesce(value, default).alias(f.name))
    others = [c for c in df.columns if c not in S.MESSAGE.names]
    return df.select(*others, F.to_json(F.struct(*fields)).alias(out))
