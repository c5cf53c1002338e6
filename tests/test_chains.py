"""Ingestion chains on literal fields: orientation, units, steps, what is derived and dropped, members and their statistics."""

import datetime as dt

import pytest

from isobarn.operators import derive
from isobarn.sources import catalog, chains

RUN = dt.datetime(2024, 1, 1)
SCHEMA = "variable string, run_time timestamp, x int, y int, member int, valid_time timestamp, value double"


def _rows(fields, x=3, y=5, member=0):
    return [(name, RUN, x, y, member, RUN + dt.timedelta(hours=h), None if v is None else float(v)) for name, values in fields.items() for h, v in enumerate(values, 1)]


def _got(found, member=0):
    out = {}
    for r in found.orderBy("valid_time").collect():
        if r.member == member:
            out.setdefault(r.variable, []).append(r.value)
    return out


def test_sums_means_and_derived_variables(spark):
    raw = spark.createDataFrame(_rows({"tot_prec": [1, 1.5, None, 3.5], "aswdir_s": [100, 150, 200, 250], "aswdifd_s": [10, 20, 30, 40], "t_2m": [280.15] * 4, "not_mapped": [1]}), SCHEMA)
    found = chains.ingest(raw, "dwd_icon")
    assert {r.location_id for r in found.collect()} == {5 * 2879 + 3}
    got = _got(found)
    assert got["precipitation"] == [1, 0.5, 1.0] and got["direct_radiation"] == [100, 200, 300, 400] and got["diffuse_radiation"] == [10, 30, 50, 70]
    assert got["shortwave_radiation"] == [110, 230, 350, 470] and got["temperature_2m"] == pytest.approx([7.0] * 4) and "not_mapped" not in got


def test_fields_are_turned_to_the_order_of_the_grid(spark):
    raw = spark.createDataFrame(_rows({"TMP:2 m above ground": [273.15]}, x=0, y=0), SCHEMA)
    assert [r.location_id for r in chains.ingest(raw, "ncep_gfs025").collect()] == [720 * 1440 + 720]  # north first, from Greenwich


def test_members_and_their_statistics(spark):
    raw = spark.createDataFrame([r for m in (0, 1, 2) for r in _rows({"2t": [273.15 + m], "tp": [0.001 * m]}, member=m)], SCHEMA)
    found = chains.ingest(raw, "ecmwf_ifs025_ensemble")
    assert _got(found, 2)["precipitation"] == pytest.approx([2.0]) and _got(found, -1)["temperature_2m"] == pytest.approx([1.0]) and _got(found, -2)["precipitation"] == pytest.approx([1.0])


def test_inputs_that_are_not_stored_go(spark):
    raw = spark.createDataFrame(_rows({"U10M": [3], "V10M": [4]}), SCHEMA)
    assert _got(chains.ingest(raw, "geosphere_arome_austria")).keys() == {"wind_speed_10m", "wind_direction_10m"}
    assert chains.ingest(raw.limit(0), "geosphere_arome_austria").count() == 0


def test_chains_name_what_there_is():
    for domain, chain in chains.CHAINS.items():
        names = {n for v in catalog.vocabularies_of(domain) for n, _ in catalog.fields(v).values()}
        assert catalog.domain_of(domain).grid and set(chain.instant) <= names
        assert all(catalog.known(n) for n in (*chain.accumulated, *chain.averaged))
        assert any(derive.chosen(o, names, dataset=chain.rules) for o in chain.derived) or not chain.derived
