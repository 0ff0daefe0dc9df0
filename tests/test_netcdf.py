"""NetCDF classic files: what is written is read, by hand-made headers too."""

import struct

import numpy as np
import pytest

from stormspan.sources import netcdf


def test_round_trip_of_a_file():
    made = netcdf.encode({"time": 0, "lat": 2, "lon": 3, "bnds": 2}, {
        "lat": netcdf.Variable(("lat",), {}, np.array([50.0, 52.5])),
        "lon": netcdf.Variable(("lon",), {"units": "degrees"}, np.array([0.0, 1.5, 3.0], np.float32)),
        "time": netcdf.Variable(("time",), {"units": "days since 2000-02-28", "calendar": "360_day"}, np.arange(4, dtype=np.int32)),
        "time_bnds": netcdf.Variable(("time", "bnds"), {}, np.zeros((4, 2))),
        "psl": netcdf.Variable(("time", "lat", "lon"), {"units": "Pa", "scale_factor": 0.5, "add_offset": 100.0, "missing_value": -9.0}, np.where(np.arange(24).reshape(4, 2, 3) == 7, -9, np.arange(24).reshape(4, 2, 3)).astype(np.int16)),
    })
    found = netcdf.parse(made)
    assert found["lat"].values.tolist() == [50.0, 52.5] and found["lon"].attributes == {"units": "degrees"}
    assert netcdf.main_variable(found, None) == "psl"
    values = found["psl"].unpacked()
    assert np.isnan(values[1, 0, 1]) and np.nansum(values) == sum(100 + 0.5 * k for k in range(24) if k != 7)
    assert netcdf.dates(found["time"].values, "days since 2000-02-28", "360_day") == ["20000228", "20000229", "20000230", "20000301"]


def test_one_record_variable_has_no_padding():
    made = netcdf.encode({"time": 0}, {"t": netcdf.Variable(("time",), {}, np.arange(5, dtype=np.int16))})
    assert netcdf.parse(made)["t"].values.tolist() == [0, 1, 2, 3, 4]


def test_offsets_of_64_bits():
    """CDF-2: the same header with long offsets."""
    name = struct.pack(">i", 1) + b"x\0\0\0"
    head = b"CDF\x02" + struct.pack(">iii", 0, 10, 1) + name + struct.pack(">i", 2) + struct.pack(">ii", 0, 0) + struct.pack(">ii", 11, 1) + name + struct.pack(">ii", 1, 0) + struct.pack(">ii", 0, 0)
    head += struct.pack(">iiq", 6, 16, len(head) + 16)
    assert netcdf.parse(head + struct.pack(">dd", 1.5, -2.0))["x"].values.tolist() == [1.5, -2.0]


def test_times():
    assert netcdf.dates([0, 23.9, 24], "hours since 1999-12-31 00:00") == ["19991231", "19991231", "20000101"]
    assert netcdf.dates([0, 1], "days since 2000-02-28", "noleap") == ["20000228", "20000301"]
    assert netcdf.dates([0, 1], "days since 2000-02-28 12:00:00") == ["20000228", "20000229"]
    for units, calendar in (("months since 2000-01-01", "standard"), ("days since 2000-01-01", "julian")):
        with pytest.raises(ValueError):
            netcdf.dates([0], units, calendar)
    with pytest.raises(ValueError):
        netcdf.parse(b"HDF file")
    two = {n: netcdf.Variable(("time",), {}, np.zeros(1)) for n in ("a", "b")}
    with pytest.raises(ValueError, match="name one"):
        netcdf.main_variable(two, None)


def test_fields(spark, tmp_path):
    for member in ("0000", "1113"):
        made = netcdf.encode({"time": 0, "latitude": 2, "longitude": 1}, {
            "latitude": netcdf.Variable(("latitude",), {}, np.array([1.0, 2.0])), "longitude": netcdf.Variable(("longitude",), {}, np.array([5.0])),
            "time": netcdf.Variable(("time",), {"units": "days since 2001-01-30", "calendar": "360_day"}, np.arange(2.0)),
            "pr": netcdf.Variable(("time", "latitude", "longitude"), {"units": "kg m-2 s-1"}, np.arange(4.0).reshape(2, 2, 1)),
        })
        (tmp_path / f"{member}.nc").write_bytes(made)
    got = sorted(tuple(r) for r in netcdf.read_fields(spark, [str(tmp_path)]).where("member = '1113'").collect())
    assert got == [("1113", "pr", "kg m-2 s-1", "20010130", 1.0, 5.0, 0.0), ("1113", "pr", "kg m-2 s-1", "20010130", 2.0, 5.0, 1.0), ("1113", "pr", "kg m-2 s-1", "20010201", 1.0, 5.0, 2.0), ("1113", "pr", "kg m-2 s-1", "20010201", 2.0, 5.0, 3.0)]
