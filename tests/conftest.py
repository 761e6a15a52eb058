from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from buslens.schemas import CATALOGUE, RAW_FRAME  # noqa: E402
from buslens.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def raw_row(seq, timestamp, can_id, data=b"", capture="c1", dlc=None, extended=None, remote=False, error=False):
    """A raw frame with the usual flags."""
    dlc = len(data) if dlc is None and data is not None else dlc
    extended = can_id is not None and can_id > 0x7FF if extended is None else extended
    return (capture, seq, timestamp, can_id, dlc, data, extended, remote, error)


@pytest.fixture
def make_raw(spark):
    return lambda *rows: spark.createDataFrame(list(rows), RAW_FRAME)


def signal_row(message, signal, start=0, length=8, order="le", signed=False, scale=1.0, offset=0.0, **more):
    """A catalogue row with the usual defaults."""
    row = {
        "message_id": message, "message_name": f"M{message}", "cycle_time_ms": None, "signal": signal,
        "start_bit": start, "bit_length": length, "byte_order": order, "is_signed": signed, "scale": scale,
        "offset": offset, "unit": None, "position": None, "value_type": "int", "mux_signal": None,
        "mux_value": None, "choices": None, "is_integer": None,
    }
    row.update(more)
    return tuple(row[name] for name in CATALOGUE.fieldNames())


@pytest.fixture
def make_catalogue(spark):
    from buslens.sources.catalogue import prepare_catalogue

    return lambda *rows: prepare_catalogue(spark.createDataFrame(list(rows), CATALOGUE))
