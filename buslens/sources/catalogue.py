"""The signal catalogue: which bits of which message carry which signal."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from buslens.functions.bits import ALL_KINDS, KIND_FLOAT32, KIND_FLOAT64, KIND_INT, KIND_UNSIGNED64
from buslens.functions.text import json_string
from buslens.scale import fits_broadcast, lookup_join, materialise
from buslens.schemas import CATALOGUE

log = logging.getLogger(__name__)

# A catalogue above this many rows is joined by shuffle instead of broadcast.
CATALOGUE_ROWS = 50_000
# Names and IDs of a checked catalogue are small enough to keep as literals.
LITERAL_IDS = 5_000
# Problems that a message to the user names.
NAMED_PROBLEMS = 10
# Fields of a layout that cut a selector out of the payload.
SELECTOR_LAYOUT = ["is_le", "end_bit", "first", "shift", "mask", "sign_shift"]


@dataclass(frozen=True)
class Traits:
    """Features that occur in a catalogue; all of them unless checked."""

    kinds: frozenset[int] = ALL_KINDS
    muxed: bool = True
    labelled: bool = True
    integers: bool = True
    long_integers: bool = True
    far: bool = True  # signals beyond the first 8 bytes
    nested: bool = True  # messages with several selectors, or with one below another
    broken: bool = True  # messages that cannot be decoded


@dataclass(frozen=True)
class Catalogue:
    """A checked catalogue.

    ``signals`` has one prepared row per signal. ``small`` tells whether its
    size was checked against the broadcast bounds; only then are
    ``ids_by_signal`` filled and the table broadcast. ``traits`` say which
    features occur, so that plans carry no code for the others. ``problems``
    lists why messages cannot be decoded: their frames decode to nothing, as
    those of unknown messages do, and all others are not affected.
    """

    signals: DataFrame
    small: bool
    ids_by_signal: dict[str, list[int]]
    traits: Traits
    problems: DataFrame | None = None

    def decodable(self) -> DataFrame:
        """The signals of the messages without problems."""
        return self.signals.where(~F.col("is_broken")) if self.traits.broken else self.signals

    def names(self) -> list[str]:
        """Sorted distinct signal names, the columns of the wide form."""
        if self.small:
            return sorted(self.ids_by_signal)
        names = expected_signals(self).limit(CATALOGUE_ROWS + 1).collect()
        if len(names) > CATALOGUE_ROWS:
            raise ValueError("too many signals for one column each; use the long form")
        return sorted(row.signal for row in names)

    def message_set(self) -> set[int]:
        """IDs of all messages of a small catalogue that carry signals."""
        return {i for ids in self.ids_by_signal.values() for i in ids}

    def known_ids(self, signals: list[str] | None = None) -> Column | None:
        """A filter on ``can_id_dec`` for the messages that carry the given signals (default all).

        It names the IDs, or their range where they are many; a large catalogue gives none.
        """
        if not self.small:
            return None
        names = self.ids_by_signal if signals is None else signals
        ids = sorted({i for name in names for i in self.ids_by_signal.get(name, [])})
        if len(ids) <= LITERAL_IDS:
            return F.col("can_id_dec").isin(ids)
        return F.col("can_id_dec").between(ids[0], ids[-1])


def load_catalogue(spark: SparkSession, path: str | None, fmt: str = "parquet", strict: bool = False) -> Catalogue | None:
    """Read a stored catalogue.

    A missing or malformed catalogue switches decoding off instead of failing
    the run; anything else that goes wrong while reading, such as a lost
    executor, is raised. A message with a wrong layout voids its own frames;
    with ``strict`` it raises ValueError.
    """
    if not path:
        return None
    try:
        table = _read(spark, path, fmt)
        table.write.format("noop").mode("overwrite").save()
    except Exception as error:
        if not _unreadable(error):
            raise
        log.warning("no signal catalogue from %s: %s", path, str(error).splitlines()[0])
        return None
    return prepare_catalogue(table, strict)


# What Spark says of a table that is absent or cannot be parsed.
UNREADABLE = ("[PATH_NOT_FOUND", "[UNABLE_TO_INFER_SCHEMA", "[MALFORMED_", "[CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def _unreadable(error: Exception) -> bool:
    """Whether the table itself is at fault."""
    return any(text in str(error) for text in UNREADABLE)


def _read(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    if fmt not in ("csv", "json"):
        return spark.read.schema(CATALOGUE).format(fmt).load(path)
    # Text formats know text keys only; in CSV the value table is JSON in one cell.
    labels = {"json": "map<string,string>", "csv": "string"}[fmt]
    fields = [f"{f.name} {labels if f.name == 'choices' else f.dataType.simpleString()}" for f in CATALOGUE.fields]
    reader = spark.read.schema(", ".join(fields)).option("mode", "FAILFAST")
    if fmt == "json":
        table = reader.json(path)
    else:
        table = reader.option("header", True).option("escape", '"').csv(path)
        table = table.withColumn("choices", F.from_json("choices", "map<string,string>"))
    return table.withColumn("choices", F.col("choices").cast("map<bigint,string>"))


def prepare_catalogue(table: DataFrame, strict: bool = False) -> Catalogue:
    """Check a catalogue and precompute the shifts, masks and selector paths of every signal.

    The result is written out once, so that plans using it only scan it. Messages
    that cannot be decoded are listed in ``problems``; with ``strict`` they raise
    ValueError instead.
    """
    prepared = materialise(_prepare(table), "catalogue", keep=True)
    # What is broadcast is the prepared table, which may be much larger than its input.
    small = fits_broadcast(prepared, CATALOGUE_ROWS)
    if small:
        # One partition spares later plans the shuffles of grouping it by message.
        prepared = prepared.coalesce(1)
    ids: dict[str, list[int]] = {}
    traits = Traits()
    broken = prepared.where(F.col("problem").isNotNull())
    problems = broken.select("message_id", "message_name", "signal", "problem")
    some = problems.orderBy("message_id", "signal", "problem").limit(NAMED_PROBLEMS).collect()
    if some and strict:
        raise ValueError("bad signal catalogue: " + "; ".join(row.problem for row in some))
    if some:
        log.warning("messages that cannot be decoded: %s", "; ".join(row.problem for row in some))
    if small:
        known = F.col("signal").isNotNull() & F.col("message_id").isNotNull()
        check = prepared.agg(
            F.collect_set(F.when(known, F.struct("signal", "message_id"))).alias("pairs"),
            F.collect_set("kind").alias("kinds"),
            F.max(F.size("sels") > 0).alias("muxed"),
            F.max(F.col("choices").isNotNull()).alias("labelled"),
            F.max("is_integer").alias("integers"),
            F.max("is_long_integer").alias("long_integers"),
            F.max(F.col("end_bit") > 64).alias("far"),
            F.max((F.size("sels") > 1) | (F.size("path") > 1)).alias("nested"),
            F.max("is_broken").alias("broken"),
        ).first()
        for signal, message_id in check.pairs:
            ids.setdefault(signal, []).append(message_id)
        traits = Traits(
            frozenset(check.kinds), bool(check.muxed), bool(check.labelled), bool(check.integers),
            bool(check.long_integers), bool(check.far), bool(check.nested), bool(check.broken),
        )
    signals = prepared.where(F.col("message_id").isNotNull()).drop("problem")
    return Catalogue(signals, small, ids, traits, problems)


def _prepare(table: DataFrame) -> DataFrame:
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CATALOGUE.fields]
    start, length = F.col("start_bit"), F.col("bit_length")
    scale, offset = F.col("scale"), F.col("offset")
    is_le = F.col("byte_order") == "le"
    sawtooth = F.lit(8) * F.floor(start / 8).cast("int") + (F.lit(7) - start % 8) + length
    with_defaults = {
        "value_type": F.coalesce("value_type", F.lit("int")),
        "is_signed": F.coalesce("is_signed", F.lit(False)),
        "scale": F.coalesce("scale", F.lit(1.0)),
        "offset": F.coalesce("offset", F.lit(0.0)),
        "position": F.coalesce("position", "start_bit"),
        "is_le": is_le,
        "end_bit": F.when(is_le, start + length).otherwise(sawtooth),
    }
    kind = (
        F.when(F.col("value_type") == "float32", KIND_FLOAT32)
        .when(F.col("value_type") == "float64", KIND_FLOAT64)
        .when((length == 64) & ~F.col("is_signed"), KIND_UNSIGNED64)
        .otherwise(KIND_INT)
    )
    whole = (
        ~F.col("value_type").isin("float32", "float64")
        & (scale == F.floor(scale)) & (F.abs(scale) < 1e17)
        & (offset == F.floor(offset)) & (F.abs(offset) < 1e17)
        & F.coalesce("is_integer", F.lit(True))
    )
    # Integers a DOUBLE holds exactly print from the value; others need decimals.
    short = (length <= 32) & (F.abs(scale) <= 2**16) & (F.abs(offset) <= 2**50)
    layout = {
        "shift": F.when(is_le, start - 8 * F.col("first")).otherwise(F.lit(64) - F.col("end_bit") + 8 * F.col("first")),
        "mask": F.call_function("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(64) - length),
        "sign_shift": F.when(F.col("is_signed"), F.lit(64) - length).otherwise(F.lit(0)),
        "kind": kind,
        "is_integer": whole,
        "is_long_integer": whole & ~short,
        # Names and labels as JSON strings, so that no frame has to escape them.
        "signal_json": json_string(F.col("signal")),
        "choices_json": F.transform_values("choices", lambda raw, label: json_string(label)),
    }
    # The byte from which 8 bytes hold the signal, or all but the rest of a ninth.
    lowest = F.when(is_le, start).otherwise(F.col("end_bit") - length)
    first = F.when(F.col("end_bit") <= 64, F.lit(0)).otherwise(F.floor(lowest / 8).cast("int"))
    prepared = table.select(*columns).withColumns(with_defaults).withColumn("first", first).withColumns(layout)
    checked = _with_selectors(prepared).withColumn("problem", _problem())
    # Unusable rows of a message make the others unsafe: which of them a frame has cannot be told.
    voids = F.max(F.col("problem").isNotNull()).over(Window.partitionBy("message_id"))
    return checked.withColumn("is_broken", voids).drop("copies", "endless", "loose")


def _with_selectors(t: DataFrame) -> DataFrame:
    """The selectors of each signal's message, and the path of selector values that leads to the signal.

    ``sels`` has one entry per selector of the message, by name: its layout, the
    values that signals are defined for, and its own path. A path is a list of
    (selector, value); a frame has the signal if all of them hold. ``sel`` and
    ``sel_values`` repeat the first selector for messages that have one only.
    """
    message = Window.partitionBy("message_id")
    pairs = F.collect_set(F.when(F.col("mux_signal").isNotNull(), F.struct("mux_signal", "mux_value"))).over(message)
    steps = F.collect_set(F.when(F.col("signal").isNotNull(), F.struct("signal", "mux_signal", "mux_value"))).over(message)
    named = t.withColumns(
        {
            "_pairs": pairs,
            "_steps": F.filter(steps, lambda s: s["mux_signal"].isNotNull()),
            "_names": F.array_sort(F.collect_set("mux_signal").over(message)),
            "copies": F.count("signal").over(Window.partitionBy("message_id", "signal")),
        }
    )
    # Up the tree, one selector a step; no path is longer than there are selectors.
    walk = F.expr(
        """aggregate(
          sequence(1, size(_names) + 1),
          named_struct('at', mux_signal, 'value', mux_value, 'path', CAST(array() AS array<struct<at:int,value:bigint>>)),
          (w, k) -> CASE WHEN w.at IS NULL THEN w ELSE named_struct(
            'at', get(filter(_steps, s -> s.signal = w.at), 0).mux_signal,
            'value', get(filter(_steps, s -> s.signal = w.at), 0).mux_value,
            'path', concat(w.path, array(named_struct('at', CAST(array_position(_names, w.at) - 1 AS int), 'value', w.value)))) END)"""
    )
    walked = named.withColumn("_walk", walk).withColumns(
        {
            "path": F.col("_walk.path"),
            # A selector left over is one that is its own ancestor.
            "endless": F.col("_walk.at").isNotNull(),
        }
    )
    at = F.array_position("_names", F.col("signal")) - 1
    values = F.transform(F.filter("_pairs", lambda p: p["mux_signal"] == F.col("signal")), lambda p: p["mux_value"])
    own = F.struct(at.cast("int").alias("at"), *SELECTOR_LAYOUT, F.array_sort(values).alias("values"), "path")
    sels = F.array_sort(F.collect_set(F.when(F.array_contains("_names", F.col("signal")), own)).over(message))
    listed = walked.withColumn("sels", sels)
    return listed.withColumns(
        {
            "sel": F.get("sels", F.lit(0)),
            "sel_values": F.get("sels", F.lit(0))["values"],
            "loose": F.col("mux_signal").isNotNull() & ~F.exists("sels", lambda s: F.get("_names", s["at"]) == F.col("mux_signal")),
        }
    ).drop("_pairs", "_steps", "_names", "_walk")


def _problem() -> Column:
    """Why a catalogue row cannot be decoded; null for a good row."""
    message = F.coalesce(F.col("message_id").cast("string"), F.lit("?"))
    name = F.concat(message, F.lit("."), F.coalesce("signal", F.lit("")))
    has_signal = F.col("signal").isNotNull()
    start, length = F.col("start_bit"), F.col("bit_length")

    def bad(condition: Column, text: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.concat(name, F.lit(": " + text)))

    return F.coalesce(
        bad(F.col("message_id").isNull(), "no message ID"),
        bad(has_signal & (start.isNull() | length.isNull() | (start < 0)), "no start or length"),
        bad(has_signal & ~length.between(1, 64), "length outside 1 to 64"),
        bad(has_signal & F.coalesce(~F.col("byte_order").isin("le", "be"), F.lit(True)), "byte order is not le or be"),
        bad(has_signal & ~F.col("value_type").isin("int", "float32", "float64"), "unknown value type"),
        bad((F.col("value_type") == "float32") & (length != 32), "float32 needs 32 bits"),
        bad((F.col("value_type") == "float64") & (length != 64), "float64 needs 64 bits"),
        bad(F.col("copies") > 1, "signal defined twice"),
        bad(F.col("mux_signal").isNull() != F.col("mux_value").isNull(), "half a multiplexer"),
        bad(F.col("loose"), "selector is not a signal"),
        bad(F.col("endless"), "selectors select each other"),
    )


def expected_signals(catalogue: Catalogue) -> DataFrame:
    """Distinct signal names over all messages."""
    return catalogue.signals.where(F.col("signal").isNotNull()).select("signal").distinct()


def message_info(catalogue: Catalogue) -> DataFrame:
    """One row per message: name, signal names in order, cycle time."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("signal").isNotNull(), F.struct("position", "signal"))))
    return catalogue.signals.groupBy("message_id").agg(
        F.max("message_name").alias("message_name"),
        F.transform(ordered, lambda s: s["signal"]).alias("signals"),
        F.max("cycle_time_ms").alias("cycle_time_ms"),
    )


def info_for_ids(ids: DataFrame, catalogue: Catalogue | None) -> DataFrame:
    """Message info for a table with ``can_id_dec``; unknown IDs get nulls."""
    if catalogue is None:
        return ids.withColumns(
            {
                "message_name": F.lit(None).cast("string"),
                "signals": F.lit(None).cast("array<string>"),
                "cycle_time_ms": F.lit(None).cast("int"),
            }
        )
    info = message_info(catalogue).withColumnRenamed("message_id", "can_id_dec")
    return lookup_join(ids, info, ["can_id_dec"], "left", small_fits=catalogue.small)
