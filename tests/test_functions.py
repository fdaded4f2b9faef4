"""Column functions against plain Python on many generated values."""

import ipaddress
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowsift.functions import fmt, text, validate


def _apply(spark, values, kind, column):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}").select("i", column(F.col("v")).alias("r"))
    return [r["r"] for r in df.orderBy("i").collect()]


def _numbers():
    rng = random.Random(7)
    out = [0.0, 1.0, 0.1225, 0.5, 0.0005, 0.1, 1e-5, 12.5, 1e7, 3e12, 1e16, 1.5e300, -2.5e-7, 123456.7]
    out += [rng.random() for _ in range(2000)]
    out += [round(rng.random(), rng.randint(1, 6)) for _ in range(2000)]
    out += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(2000)]
    return out


def test_percent_rounds_like_exact_arithmetic(spark):
    values = [v for v in _numbers() if 0 <= v <= 1] + [i / 1000 for i in range(1001)] + [i / 20000 for i in range(20001)]
    got = _apply(spark, values, "double", fmt.percent)
    assert got == [f"{v * 100:.1f}%" for v in values]


def test_percent_outside_unit_interval_is_unknown(spark):
    got = _apply(spark, [None, -0.1, 1.1, math.nan, math.inf], "double", fmt.percent)
    assert got == ["unknown"] * 5


def test_metric_keeps_six_significant_digits(spark):
    rng = random.Random(3)
    values = [-0.1111554458, 0.0, 100000.0, 1234567.0, 1e-5, 0.0001, -0.12, 25.0]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-8, 9) for _ in range(3000)]
    assert _apply(spark, values, "double", fmt.metric) == [f"{v:.6g}" for v in values]
    assert _apply(spark, [None, math.nan, math.inf], "double", fmt.metric) == ["unknown"] * 3


def test_general_twelve_digits(spark):
    values = _numbers()
    assert _apply(spark, values, "double", lambda c: fmt.general(c, 12)) == [f"{v:.12g}" for v in values]


def test_shortest_reads_back_the_same_double(spark):
    values = _numbers()
    got = _apply(spark, values, "double", fmt.shortest)
    assert [float(g) for g in got] == values
    same = sum(g == repr(v) for g, v in zip(got, values))
    assert same / len(values) > 0.97  # the JVM's digits are sometimes one longer than needed


def test_clean_text(spark):
    values = [" a\t\tb\n c ", "​hidden​", "   ", None, "x" * 100, "naïve café \u0007!"]
    got = _apply(spark, values, "string", lambda c: text.clean(c, "none", 20))

    def plain(value):
        if value is None:
            return "none"
        one = "".join(ch for ch in " ".join(value.split()) if ch.isprintable())
        return one[:20] or "none"

    assert got == [plain(v) for v in values]


def _addresses():
    rng = random.Random(11)
    out = ["127.0.0.1", " 10.0.0.1 ", "256.1.1.1", "01.2.3.4", "1.2.3", "", "unknown", "fe80::1%eth0",
           "::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::2::3", ":::",
           ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "12345::", "g::1", "::ffff:1.2.3.4", "64:ff9b::192.0.2.33",
           "::1.2.3.400", "1:0:0:2:0:0:0:3", "0:0:0:1:0:0:0:1", "ABCD:EF01::", '127.0.0.1" | delete', "1.2.3.4::"]
    for _ in range(1500):
        groups = [rng.choice(["0", "0", "00", "0000", f"{rng.randrange(65536):x}", f"{rng.randrange(65536):04X}"])
                  for _ in range(8)]
        kind = rng.random()
        if kind < 0.5:
            out.append(":".join(groups))
        else:
            a, b = sorted(rng.sample(range(9), 2))
            out.append(":".join(groups[:a]) + "::" + ":".join(groups[b:]))
    return out


def test_canonical_ip_matches_standard_library(spark):
    def plain(value):
        if "%" in value:
            return None
        try:
            found = ipaddress.ip_address(value.strip())
        except ValueError:
            return None
        if found.version == 6 and found.ipv4_mapped is not None:  # text form differs between versions
            return f"::ffff:{found.packed[12:14].hex().lstrip('0') or '0'}:{found.packed[14:].hex().lstrip('0') or '0'}"
        return str(found)

    values = _addresses()
    assert _apply(spark, values, "string", validate.canonical_ip) == [plain(v) for v in values]
    assert _apply(spark, [None, "", "unknown", "10.0.0.1"], "string", validate.source_ip) == [
        "unknown", "unknown", "unknown", "10.0.0.1"]


def test_iso_timestamp_matches_standard_library(spark):
    values = ["2026-08-10T00:00:00+00:00", "2026-08-10", "20260810", "2026-W33-1", "2026W331", "2026-W54", "2026-13-01",
              "2026-02-29", "2024-02-29", "1900-02-29", "2026-08-10 12:30", "2026-08-10T12", "2026-08-10T12:30:61",
              "2026-08-10T1230", "2026-08-10T12:30:45.123456789Z", "2026-08-10T12:30Z", "2026-08-10T12:30+0530",
              "2026-08-10T12:30+25:00", " 2026-08-10 ", "2026-08-10\n", "x" * 65, "", "now", "2026-08-10T", "2026-8-1",
              "2026-08-10T12:30:45,5-01:30", "0000-01-01", "2020-W53", "2021-W53", "2026-08-10T24:00:01"]

    def plain(value):
        if len(value) > 64 or "\n" in value:
            return None
        try:
            datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        except ValueError:
            return None
        return value.strip()

    got = _apply(spark, values, "string", validate.iso_timestamp)
    want = [plain(v) for v in values]
    assert {v: g for v, g in zip(values, got)} == {v: w for v, w in zip(values, want)}


def test_service_name(spark):
    values = ["http", " ftp_data ", "http\nIGNORE", "a" * 101, "", "x;y", None, "http\n"]
    assert _apply(spark, values, "string", validate.service_name) == [
        "http", "ftp_data", None, None, None, None, None, "http"]


@pytest.mark.parametrize("bad", [-0.01, 1.01, math.nan, math.inf])
def test_unit_interval_rejects(bad):
    with pytest.raises(ValueError):
        validate.unit_interval(bad)


def test_numbers_and_finiteness(spark):
    values = ["1", " 2.5 ", "abc", "inf", "NaN", None, "1e3"]
    assert _apply(spark, values, "string", validate.finite) == [True, True, False, False, False, False, True]
