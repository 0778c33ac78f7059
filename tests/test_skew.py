"""Per-key ordered results with hot keys, against brute force."""

import datetime
import random

import pytest

from keyfold.operators import skew

from .conftest import rows

T0 = datetime.datetime(2026, 1, 1)


def brute(data):
    out, by = [], {}
    for k, o, v, t in data:
        if k is not None and o is not None:
            by.setdefault(k, []).append((o, v, t))
    for k, x in by.items():
        x.sort(key=lambda r: r[0])
        pairs = list(zip(x, x[1:], strict=False))
        pauses = [int((b[2] - a[2]).total_seconds() * 1e6) for a, b in pairs if a[2] and b[2]]
        out.append((k, len(x), x[0][0], x[-1][0], sum(a[1] != b[1] for a, b in pairs), max(pauses, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_against_brute_force(spark, chunk):
    rng = random.Random(chunk)
    data = []
    for o in range(1500):
        key = rng.choices([b"hot", b"warm", b"", None, bytes([rng.randint(0, 255)])], [6, 2, 1, 1, 2])[0]
        data.append((key, o, rng.choice([None, b"", b"a", b"b"]), None if rng.random() < 0.05 else T0 + datetime.timedelta(seconds=o + rng.randint(-20, 20))))
    data.append((b"hot", None, b"a", T0))
    shuffled = rng.sample(data, len(data))
    df = spark.createDataFrame(
        [(None if k is None else bytearray(k), o, None if v is None else bytearray(v), t, 1) for k, o, v, t in shuffled],
        "key binary, o bigint, v binary, t timestamp_ntz, n_rows int",
    )
    got = skew.ordered_key_stats(df, "key", "o", "v", "t", chunk_rows=chunk)
    assert rows(got, "key", "n_rows", "first_order", "last_order", "changes", "longest_pause_us") == brute(data)


def test_empty_and_heavy(spark):
    df = spark.createDataFrame([], "key binary, o bigint, v binary, t timestamp")
    assert skew.ordered_key_stats(df, "key", "o", "v", "t").count() == 0
    stats = spark.createDataFrame([("a", 2), ("b", 1), ("c", 97)], "key string, n_rows bigint")
    assert rows(skew.heavy_keys(stats, "key", 100)) == [("a", 2), ("c", 97)]


def test_numbers_are_exact(spark):
    df = spark.createDataFrame([(i % 3 == 0, i) for i in range(999)], "k boolean, o bigint")
    got = skew.number_rows(skew.ordered_blocks(df, "o"), "k", "o")
    want = {}
    for i in range(999):
        want[i] = sum(1 for j in range(i) if (j % 3 == 0) == (i % 3 == 0))
    assert {r.o: r.row_no for r in got.collect()} == want
