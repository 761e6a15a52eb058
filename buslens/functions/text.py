"""Numbers, records and frames as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def float_text_sql(x: str, special: bool = True) -> str:
    """SQL for the shortest decimal text of a DOUBLE, plain between 1e-4 and 1e16.

    Spark prints 1.712057096123E9 where capture files hold 1712057096.123.
    ``special`` also spells infinities and NaN as the files do; leave it off
    for values that cannot be either, the generated code is then smaller.
    """
    text = f"CAST({x} AS STRING)"

    def plain(decimal: str) -> str:
        # Without trailing zeros, keeping one decimal place.
        return rf"regexp_replace(CAST(CAST({x} AS {decimal}) AS STRING), r'(\.\d\d*?)0+$', '$1')"

    # 1.0E16 becomes 1e+16 and 1.5E-5 becomes 1.5e-05.
    signed = rf"regexp_replace(regexp_replace({text}, r'\.0E', 'E'), r'E(\d)', 'E+$1')"
    scientific = rf"lower(regexp_replace({signed}, r'E([+-])(\d)$', 'E$10$2'))"
    spelled = (
        f" WHEN isnan({x}) THEN 'nan' WHEN {x} = double('Infinity') THEN 'inf'"
        f" WHEN {x} = double('-Infinity') THEN '-inf'"
    )
    return (
        f"CASE{spelled if special else ''} WHEN NOT contains({text}, 'E') THEN {text}"
        f" WHEN abs({x}) >= 1e7D AND abs({x}) < 1e16D THEN {plain('DECIMAL(26,9)')}"
        f" WHEN abs({x}) >= 1e-4D AND abs({x}) < 1e-3D THEN {plain('DECIMAL(22,21)')}"
        f" ELSE {scientific} END"
    )


def clock_time(ts: Column) -> Column:
    """``HH:MM:SS.mmm`` in the session time zone, milliseconds truncated."""
    return F.date_format(ts, "HH:mm:ss.SSS")


def frame_line(
    number: Column, ts: Column, can_id: Column, dlc: Column, data_hex: Column,
    signal_texts: Column | None = None,
) -> Column:
    """One console line per frame.

    ``signal_texts`` is an array of ``name=value`` strings; a null or empty one
    leaves the signals part out.
    """
    count = number.cast("string")
    padded = F.when(F.length(count) < 5, F.lpad(count, 5, " ")).otherwise(count)
    shown_id = F.when(F.length(can_id) < 4, F.lpad(can_id, 4, " ")).otherwise(can_id)
    line = F.concat(
        F.lit("["), padded, F.lit("] "), clock_time(ts),
        F.lit(" | ID: "), shown_id,
        F.lit(" | DLC: "), dlc.cast("string"),
        F.lit(" | Data: "), data_hex,
    )
    if signal_texts is None:
        return line
    signals = F.concat(F.lit(" | Signals: "), F.array_join(signal_texts, " | "))
    return F.concat(line, F.when(F.size(signal_texts) > 0, signals).otherwise(F.lit("")))


def json_string(text: Column) -> Column:
    """Text as a quoted and escaped JSON string."""
    wrapped = F.to_json(F.struct(text.alias("x")))
    inside = F.substr(wrapped, F.lit(6), F.length(wrapped) - 6)
    return F.when(text.isNotNull(), inside)


def json_number_sql(text: str) -> str:
    """SQL turning printed numbers into JSON that keeps whole floats floats.

    Parsed as JSON, 28.0 would become the exact number 28, but 28.0E0 a DOUBLE.
    Infinities and NaN, which JSON lacks, become strings.
    """
    return (
        f"CASE WHEN endswith({text}, '.0') THEN concat({text}, 'E0')"
        f" WHEN {text} IN ('nan', 'inf', '-inf') THEN concat('\"', {text}, '\"') ELSE {text} END"
    )


def json_safe(value: Column, data_type) -> Column:
    """Rewrite a column so ``to_json`` prints it as the capture files do.

    BINARY becomes lower-case hex, also inside arrays, maps and structs;
    numbers, booleans, strings and nulls stay; everything else becomes text.
    """
    kind = data_type.typeName()
    if kind == "binary":
        return F.lower(F.hex(value))
    if kind == "array":
        return F.transform(value, lambda x: json_safe(x, data_type.elementType))
    if kind == "map":
        return F.transform_values(value, lambda k, v: json_safe(v, data_type.valueType))
    if kind == "struct":
        fields = [json_safe(value[f.name], f.dataType).alias(f.name) for f in data_type.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if kind in ("byte", "short", "integer", "long", "float", "double", "string", "boolean",
                "void", "variant"):
        return value
    return value.cast("string")
