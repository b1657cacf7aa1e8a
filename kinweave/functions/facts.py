"""Exact numbers, payload facts, keys, digests and display forms, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST_NUMBER = 128
SAFE_FLOAT = 2**53 - 1
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def convert_integral(kind: Column, text: Column) -> Column:
    """An exact 64-bit integer from a value's kind (none, bool, int, str, decimal, float, list, object) and its text.

    Struct (value, error); one of eight error codes, or neither value nor error for none.
    """
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    special = F.lower(t).rlike(r"^[+-]?(inf|infinity|s?nan\d*)$")
    numeric = t.rlike(NUMBER)
    exact = F.expr("null").cast("decimal(38,10)")
    exact = F.when(numeric, t.cast("string")).try_cast("decimal(38,10)")
    size = F.abs(F.when(numeric, t).try_cast("double"))
    whole = F.coalesce(exact == F.floor(exact), size >= 1e27)
    fits = F.coalesce((exact >= F.lit("-9223372036854775808").cast("decimal(38,10)")) & (exact <= F.lit("9223372036854775807").cast("decimal(38,10)")), F.lit(False))
    decimal = F.when(special, "non_finite").when(~numeric, "malformed").when(~whole, "non_integral").when(~fits, "out_of_range")
    error = (
        F.when(kind == "none", None).when(kind == "bool", "boolean")
        .when(kind == "int", F.when(~fits, "out_of_range"))
        .when(kind == "decimal", decimal)
        .when(kind == "str", F.when(F.length(text) > LONGEST_NUMBER, "string_too_long").otherwise(decimal))
        .when(kind == "float", F.when(special, "non_finite").when(~whole, "non_integral").when(size > SAFE_FLOAT, "unsafe_float"))
        .otherwise("unsupported_type")
    )
    value = F.when((kind != "none") & error.isNull(), exact.try_cast("decimal(20,0)").try_cast("bigint"))
    return F.struct(value.alias("value"), error.alias("error"))


def key_of(*parts: Column) -> Column:
    """An injective key of several texts: each with its length in front."""
    return F.concat(F.lit("sv1:"), *(F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts))


def canonical_json(**fields: Column) -> Column:
    """JSON text with sorted keys and no blanks, of string columns; null fields are null."""
    quoted = lambda x: F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))
    inner = F.concat_ws(",", *(F.concat(F.lit(f'"{k}":'), quoted(fields[k])) for k in sorted(fields)))
    return F.concat(F.lit("{"), inner, F.lit("}"))


def digest(text: Column, length: int = 64) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def payload_fact(payload: Column, field: str, nested: str = "deal") -> Column:
    """A field of a JSON text, at the top or else in a nested object; struct (present, value).

    A key that is present with null counts as present, so a later place does not replace it.
    """
    v = F.try_parse_json(payload)
    top, inner = F.try_variant_get(v, f"$.{field}", "string"), F.try_variant_get(v, f"$.{nested}.{field}", "string")
    keys = lambda path: F.coalesce(F.json_object_keys(F.get_json_object(payload, path)), F.array().cast("array<string>"))
    at_top, at_inner = F.array_contains(keys("$"), field), F.array_contains(keys(f"$.{nested}"), field)
    return F.struct((at_top | at_inner).alias("present"), F.when(at_top, top).otherwise(inner).alias("value"))


#: Currencies that amounts are read in, and the names that a deal's fields go by, first name first.
CURRENCIES = ("SGD", "USD", "MYR")
FIELDS = {
    "amount": ("amount", "opportunity", "OPPORTUNITY"),
    "currency": ("currency", "currency_id", "CURRENCY_ID"),
    "assigned": ("ASSIGNED_BY_ID", "assigned_by_id"),
    "contacts": ("CONTACT_IDS", "CONTACT_ID"),
}


def json_kind(v: Column) -> Column:
    """The type of a variant: object, array, string, boolean, integer, number, null; null where there is no value."""
    kind = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null").when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(kind.isNotNull(), "number")
    )


def first_field(v: Column, names: tuple[str, ...], nested: str = "deal") -> Column:
    """The first of some keys that an object has, then that a nested object has. A key that holds null is had."""
    return F.coalesce(*(F.try_variant_get(v, f"$.{prefix}{n}", "variant") for prefix in ("", f"{nested}.") for n in names))


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def payload_facts(payload: Column) -> Column:
    """Facts of a deal's JSON text: struct (amount_state, amount_value, currency_status, currency, assigned_known, contact_count).

    No text: all missing. A text that is no JSON object: invalid. Zero amounts are 'zero'; negative, endless, grouped ('1,000') and
    boolean ones are invalid. Currencies are three letters.
    """
    v = F.try_parse_json(payload)
    whole = F.coalesce(json_kind(v) == "object", F.lit(False))
    amount, currency, assigned, contacts = (first_field(v, FIELDS[f]) for f in FIELDS)
    blank = lambda x: x.isNull() | F.is_variant_null(x) | F.coalesce((json_kind(x) == "string") & (as_text(x) == ""), F.lit(False))
    text = F.trim(as_text(amount))
    plain = F.when(text.rlike(r"^[+-]?(\d[\d_]*\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))
    number = F.when(json_kind(amount) == "string", plain).when(json_kind(amount).isin("integer", "number"), F.try_variant_get(amount, "$", "double"))
    fine = F.coalesce((number >= 0) & (number < float("inf")), F.lit(False))
    state = F.when(blank(amount), "missing").when(~fine, "invalid").when(number == 0, "zero").otherwise("known")
    code = F.upper(F.trim(as_text(currency)))
    letters = F.coalesce((json_kind(currency) == "string") & code.rlike(r"^\p{L}{3}$"), F.lit(False))
    status = F.when(blank(currency), "missing").when(~letters, "invalid").when(code.isin(*CURRENCIES), "supported").otherwise("unsupported")
    simple = lambda x: json_kind(x).isin("string", "integer", "boolean")
    known = ~blank(assigned) & simple(assigned) & ~as_text(assigned).isin("0", "false")
    listed = F.filter(F.try_variant_get(contacts, "$", "array<variant>"), lambda x: simple(x) & (F.trim(as_text(x)) != ""))
    single = simple(contacts) & (F.trim(as_text(contacts)) != "") & (as_text(contacts) != "0")
    count = F.when(json_kind(contacts) == "array", F.size(listed)).when(F.coalesce(single, F.lit(False)), 1).otherwise(0)
    absent = F.when(payload.isNull(), "missing").otherwise("invalid")
    return F.struct(
        F.when(whole, state).otherwise(absent).alias("amount_state"), F.when(whole & fine, number).alias("amount_value"),
        F.when(whole, status).otherwise(absent).alias("currency_status"), F.when(whole & letters, code).alias("currency"),
        F.coalesce(whole & known, F.lit(False)).alias("assigned_known"), F.when(whole, count).otherwise(0).alias("contact_count"),
    )


def parse_timestamp(text: Column) -> Column:
    """A moment from ISO text that states its offset; texts without one are null."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def band(value: Column, edges: list[float], names: list[str]) -> Column:
    """names[i] for values up to edges[i]; the last name beyond all, 'missing' for null."""
    out = F.when(value.isNull(), "missing")
    for edge, name in zip(edges, names, strict=False):
        out = out.when(value <= edge, name)
    return out.otherwise(names[-1])


def display_date(at: Column) -> Column:
    return F.date_format(at, "dd MMM yyyy")


def display_datetime(at: Column, zone: str = "UTC") -> Column:
    """A moment in a display zone, on a clock of twelve hours; empty for null. The session's zone is taken to be UTC."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "dd MMM yyyy, hh:mm a"), F.lit(""))


def display_percent(x: Column) -> Column:
    """A share as a whole percentage; halves go to the even number."""
    return F.concat(F.bround(x * 100, 0).cast("long").cast("string"), F.lit("%"))


def display_dob(dob: Column, today: Column, most_years: int = 130) -> Column:
    """struct (text, invalid): a dash where there is none; the text as it stands, flagged, where it is no date, in the future or too old."""
    d = F.when(dob.rlike(r"^\d{4}-\d{2}-\d{2}$"), dob.try_cast("date"))
    fine = F.coalesce((d <= today) & (F.year(d) >= F.year(today) - most_years), F.lit(False))
    none = dob.isNull() | (dob == "")
    return F.struct(F.when(none, "—").when(fine, display_date(d)).otherwise(dob).alias("text"), (~none & ~fine).alias("invalid"))


def ordered_digest(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One digest of a table that depends on its order by key: row digests by block, then blocks in order.

    Blocks keep each hashed text small; the last step folds one row for each block of 4096 rows.
    """
    row = digest(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns)))
    ranged = rows.select(F.col(key).alias("k"), row.alias("d")).withColumn("block", F.floor(F.col("k") / 4096))
    blocks = ranged.groupBy("block").agg(digest(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "")).alias("d"), F.count("*").alias("n"))
    return blocks.agg(digest(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), "")).alias("digest"), F.sum("n").alias("rows"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two passes hold equal multisets of rows, by counts and sums of row hashes: one small row, no sort."""
    cols = sorted(a.columns)
    side = lambda df: df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64(F.lit(1), *cols).cast("decimal(38,0)")).alias("t"))
    return side(a).alias("a").join(side(b).alias("b"), F.lit(True)).select((F.expr("a.n = b.n") & F.expr("a.s <=> b.s") & F.expr("a.t <=> b.t")).alias("equal"))
