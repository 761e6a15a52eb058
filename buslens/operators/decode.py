"""Decode signals from payloads with a broadcast catalogue.

Three output shapes, none of which moves a frame:

* ``signals_long``  one row per (frame, signal): the frame joins the catalogue
  row of every signal of its message, and the rest is plain arithmetic.
* ``decode``        one row per frame with a ``parsed`` map.
* ``frames_wide``   one row per frame with one column per signal.

Rules common to all: lookup by numeric ID alone; a signal that ends beyond the
bytes present is left out; a message with selectors yields its plain signals,
selectors that are themselves selected, and the signals of the selected values,
at any depth; a selected selector with a value nobody defined voids the whole
frame; a truncated selector leaves out what depends on it. A message that the
catalogue check refused is decoded like an unknown one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from buslens.functions.bits import (
    complete_sql, json_sql, label_sql, number_text_sql, raw_sql, text_sql, value_sql,
)
from buslens.functions.payload import big_endian_word, swap_bytes
from buslens.scale import BROADCAST_BYTES, lookup_join
from buslens.schemas import BASE_COLUMNS
from buslens.sources.catalogue import Catalogue, Traits

_SIGNAL_FIELDS = [
    "signal", "position", "is_le", "end_bit", "first", "shift", "mask", "sign_shift", "kind",
    "scale", "offset", "mux_value", "choices", "is_integer", "is_long_integer",
    "signal_json", "choices_json",
]
# Size of a slot of the wide form that another message fills.
SLOT_BYTES = 8
PARSED_TYPE = "map<string,struct<value:double,label:string>>"
TEXTS_TYPE = "array<struct<signal:string,text:string,is_label:boolean>>"
LONG_COLUMNS = ["capture_id", "seq", "timestamp", "can_id_dec", "signal", "value", "label"]


def _with_words(frames: DataFrame) -> DataFrame:
    """The first 8 bytes as two 64-bit words and the payload's length in bits, computed once per frame."""
    return frames.withColumns(
        {
            "_be": big_endian_word(F.col("data")),
            "_bits": F.length("data") * 8,
        }
    ).withColumn("_le", swap_bytes(F.col("_be")))


def _with_selection(df: DataFrame, traits: Traits) -> DataFrame:
    """Evaluate the selectors of the frame's message.

    ``_sel_raw`` is the value of the only selector, null unless complete, and
    ``_sel_raws`` those of all of them where messages have several; ``_void``
    marks a frame with a selected selector whose value is not defined.
    """
    if not traits.muxed:
        return df.withColumns({"_sel_raw": F.lit(None).cast("bigint"), "_void": F.lit(False)})
    if traits.nested:
        raws = F.expr(f"transform(sels, s -> CASE WHEN {complete_sql('s.')} THEN {raw_sql('s.', traits.far)} END)")
        lost = f"""coalesce(exists(sels, s -> {_path_holds('s.')}
            AND NOT coalesce(array_contains(s.values, get(_sel_raws, s.at)), true)), false)"""
        return df.withColumn("_sel_raws", raws).withColumn("_void", F.expr(lost))
    selected = F.expr(f"CASE WHEN {complete_sql('sel.')} THEN {raw_sql('sel.', traits.far)} END")
    void = F.expr("coalesce(NOT array_contains(sel_values, _sel_raw), false)")
    return df.withColumn("_sel_raw", selected).withColumn("_void", void)


def _path_holds(s: str) -> str:
    """All selectors on the way to the signal have the values that lead to it."""
    return f"coalesce(forall({s}path, p -> get(_sel_raws, p.at) = p.value), false)"


def _chosen(s: str, traits: Traits) -> str:
    """The signal is complete and, if multiplexed, selected."""
    if not traits.muxed:
        return complete_sql(s)
    if traits.nested:
        return f"{complete_sql(s)} AND {_path_holds(s)}"
    return f"{complete_sql(s)} AND ({s}mux_value IS NULL OR coalesce({s}mux_value = _sel_raw, false))"


def _selectors(traits: Traits) -> list[str]:
    """Columns of the catalogue that hold the selectors of a message."""
    if not traits.muxed:
        return []
    return ["sels"] if traits.nested else ["sel", "sel_values"]


def _label(s: str, raw: str, traits: Traits) -> str:
    return label_sql(s, raw) if traits.labelled else "CAST(NULL AS STRING)"


def _only_known(frames: DataFrame, known: Column | None) -> DataFrame:
    return frames if known is None else frames.where(known)


def _fields(traits: Traits) -> list[str]:
    return [*_SIGNAL_FIELDS, "path"] if traits.nested else _SIGNAL_FIELDS


def signals_long(
    frames: DataFrame,
    catalogue: Catalogue | None,
    signals: list[str] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per decoded signal of every frame.

    ``signals`` restricts the result; the IDs that carry them become a literal
    filter which reaches the scan. ``keep`` lists the frame columns to carry.
    """
    keep = keep if keep is not None else LONG_COLUMNS[:4]
    if catalogue is None:
        nothing = frames.where(F.lit(False)).select(*keep)
        return nothing.withColumns(
            {c: F.lit(None).cast(t) for c, t in (("signal", "string"), ("value", "double"), ("label", "string"))}
        )
    traits = catalogue.traits
    wanted = catalogue.decodable().where(F.col("signal").isNotNull())
    if signals is not None:
        wanted = wanted.where(F.col("signal").isin(signals))
    table = wanted.select(F.col("message_id").alias("can_id_dec"), *_selectors(traits), *_fields(traits))
    needed = list(dict.fromkeys([*keep, "can_id_dec", "data"]))
    known = _only_known(frames, catalogue.known_ids(signals)).select(*needed)
    rows = lookup_join(_with_words(known), table, ["can_id_dec"], "inner", small_fits=catalogue.small)
    rows = _with_selection(rows, traits).where(f"NOT _void AND {_chosen('', traits)}")
    return rows.withColumn("_raw", F.expr(raw_sql("", traits.far))).select(
        *keep,
        "signal",
        F.expr(value_sql("", "_raw", traits.kinds)).alias("value"),
        F.expr(_label("", "_raw", traits)).alias("label"),
    )


def decode(frames: DataFrame, catalogue: Catalogue | None) -> DataFrame:
    """Add ``parsed``: null (unknown or undecodable), empty or filled map."""
    if catalogue is None:
        return frames.withColumn("parsed", F.lit(None).cast(PARSED_TYPE))

    traits = catalogue.traits
    value = value_sql("s.layout.", "s.raw", traits.kinds)
    cell = f"named_struct('value', {value}, 'label', {_label('s.layout.', 's.raw', traits)})"
    return _per_frame(
        frames, catalogue, "parsed",
        lambda sigs: f"map_from_entries(transform({sigs}, s -> struct(s.layout.signal, {cell})))",
    )


def signal_texts(frames: DataFrame, catalogue: Catalogue | None) -> DataFrame:
    """Add ``texts``: the decoded signals in order, as printed text.

    A label where the value table has one, an exact integer for integer
    signals, else the shortest decimal text. Same three states as ``parsed``.
    """
    if catalogue is None:
        return frames.withColumn("texts", F.lit(None).cast(TEXTS_TYPE))

    traits = catalogue.traits
    value = value_sql("s.layout.", "s.raw", traits.kinds)
    text = text_sql("s.layout.", "s.raw", f"({value})", traits)
    is_label = f"{_label('s.layout.', 's.raw', traits)} IS NOT NULL"
    entry = f"named_struct('signal', s.layout.signal, 'text', {text}, 'is_label', {is_label})"
    return _per_frame(frames, catalogue, "texts", lambda sigs: f"transform({sigs}, s -> {entry})")


def signals_json(frames: DataFrame, catalogue: Catalogue | None) -> DataFrame:
    """Add ``parsed_json``: the decoded signals as one JSON object, or null."""
    if catalogue is None:
        return frames.withColumn("parsed_json", F.lit(None).cast("string"))
    traits = catalogue.traits
    value = value_sql("s.layout.", "s.raw", traits.kinds)
    number = number_text_sql("s.layout.", "s.raw", f"({value})", traits)

    def build(sigs: str) -> str:
        # The number text is used more than once, so it gets a step of its own.
        numbers = f"transform({sigs}, s -> named_struct('layout', s.layout, 'raw', s.raw, 'number', {number}))"
        member = f"concat(s.layout.signal_json, ':', {json_sql('s.layout.', 's.raw', 's.number', traits)})"
        return f"concat('{{', array_join(transform({numbers}, s -> {member}), ','), '}}')"

    return _per_frame(frames, catalogue, "parsed_json", build)


def _per_frame(frames: DataFrame, catalogue: Catalogue, name: str, build) -> DataFrame:
    """Left-join one catalogue row per message and build a column from it."""
    traits = catalogue.traits
    fields = ", ".join(_fields(traits))
    # Plain signals come before multiplexed ones, each in catalogue order. The
    # comparator leaves out the layouts, whose maps do not compare.
    key = "struct({0}.muxed, {0}.position, {0}.signal)"
    left, right = key.format("a"), key.format("b")
    listed = f"""array_sort(
        collect_list(struct(mux_value IS NOT NULL AS muxed, position, signal, struct({fields}) AS layout))
          FILTER (WHERE signal IS NOT NULL),
        (a, b) -> CASE WHEN {left} < {right} THEN -1 WHEN {left} > {right} THEN 1 ELSE 0 END)"""
    messages = catalogue.decodable().groupBy(F.col("message_id").alias("can_id_dec")).agg(
        F.expr(f"transform({listed}, s -> s.layout)").alias("_sigs"), *[F.first(c).alias(c) for c in _selectors(traits)]
    )
    rows = lookup_join(_with_words(frames), messages, ["can_id_dec"], "left", small_fits=catalogue.small)
    rows = _with_selection(rows, traits)
    chosen = (
        f"transform(filter(_sigs, s -> {_chosen('s.', traits)}),"
        f" s -> named_struct('layout', s, 'raw', {raw_sql('s.', traits.far)}))"
    )
    built = F.expr(f"CASE WHEN _sigs IS NOT NULL AND NOT _void THEN {build(chosen)} END")
    return rows.withColumn(name, built).select(*frames.columns, name)


def frames_wide(
    frames: DataFrame,
    catalogue: Catalogue | None,
    keep: list[str] | None = None,
    as_text: bool = False,
) -> DataFrame:
    """Base columns plus one column per expected signal, sorted by name.

    The broadcast row of a message holds one layout per column, so each cell is
    one expression; nothing is exploded or pivoted. ``as_text`` gives printed
    values (labels included), otherwise cells are numbers.
    """
    keep = keep if keep is not None else list(BASE_COLUMNS)
    names = catalogue.names() if catalogue is not None else []
    check_wide_names(frames, keep, names)
    if not names:
        return frames.select(*keep)
    slots = [f"_s{i}" for i in range(len(names))]
    traits = catalogue.traits
    layout = F.struct(*_fields(traits)[1:])
    cells = [
        F.first(F.when(F.col("signal") == name, layout), ignorenulls=True).alias(slot)
        for name, slot in zip(names, slots)
    ]
    messages = catalogue.decodable().groupBy(F.col("message_id").alias("can_id_dec")).agg(
        *cells, *[F.first(c).alias(c) for c in _selectors(traits)]
    )
    needed = list(dict.fromkeys([*keep, "can_id_dec", "data"]))
    words = _with_words(frames.select(*needed))
    # A message's row has a slot for every column, so the table is larger than the catalogue.
    slots_fit = catalogue.small and len(names) * len(catalogue.message_set()) * SLOT_BYTES <= BROADCAST_BYTES
    rows = lookup_join(words, messages, ["can_id_dec"], "left", small_fits=slots_fit)
    rows = _with_selection(rows, traits)
    # One projection per step, so that no step repeats the work of the one before.
    raws = {
        f"_r{i}": F.expr(f"CASE WHEN NOT _void AND {_chosen(f'{slot}.', traits)} THEN {raw_sql(f'{slot}.', traits.far)} END")
        for i, slot in enumerate(slots)
    }
    values = {
        f"_v{i}": F.expr(value_sql(f"{slot}.", f"_r{i}", traits.kinds)) for i, slot in enumerate(slots)
    }
    rows = rows.withColumns(raws).withColumns(values)

    def cell(i: int) -> Column:
        return F.expr(text_sql(f"{slots[i]}.", f"_r{i}", f"_v{i}", traits)) if as_text else F.col(f"_v{i}")

    return rows.select(*keep, *[cell(i).alias(name) for i, name in enumerate(names)])


def check_wide_names(frames: DataFrame, keep: list[str], names: list[str]) -> None:
    """Refuse column names that would overwrite each other."""
    sensitive = frames.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    seen: dict[str, str] = {}
    for name in [*keep, *names]:
        key = name if sensitive else name.lower()
        if key in seen:
            raise ValueError(
                f"column {name!r} clashes with {seen[key]!r} in the wide form; rename the signal,"
                " use the long form, or set spark.sql.caseSensitive if only case differs"
            )
        seen[key] = name
