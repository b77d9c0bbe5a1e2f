"""Random small tables with many equal and missing values, against plain loops over all pairs."""

import math
import random
from datetime import date, datetime, timedelta

import pytest

from seapoint import (
    CHLOROPHYLL,
    TEMPERATURE,
    WAVES,
    chlorophyll_latest,
    temperature_series,
    wave_gate,
)
from seapoint.schemas import OBSERVATIONS, REQUESTS

DAY = date(2026, 8, 12)
HOUR = timedelta(hours=1)


def km(lat1, lon1, lat2, lon2):
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2
    h += math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


@pytest.fixture(scope="module")
def requests():
    rnd = random.Random(5)
    rows = []
    for n in range(300):
        first = rnd.randrange(24)
        rows.append(
            (n, rnd.uniform(-0.1, 0.35), rnd.uniform(-0.1, 0.35), DAY + timedelta(rnd.randrange(4)))
            + (first, rnd.randrange(first, 24))
        )
    return rows + [(1000 + n, *row[1:]) for n, row in enumerate(rows[:50])]


def grid(product, step, levels, values):
    rnd = random.Random(step)
    rows = []
    for i in range(5):
        for j in range(5):
            for n in range(-5 * 24 // step, 6 * 24 // step):
                time = datetime(2026, 8, 12) + n * step * HOUR
                for depth in levels:
                    # Ragged on purpose: some coordinates are absent, many have no value.
                    if rnd.random() < 0.8:
                        value = rnd.choice(values)
                        rows.append(
                            (product.dataset_id, product.variable, time, depth, i / 12, j / 12, value)
                        )
    return rows


def box(request, rows, first, last):
    _, lat, lon = request[:3]
    return [
        (t, d, la, lo, v, km(lat, lon, la, lo))
        for *_, t, d, la, lo, v in rows
        if lat - 0.05 <= la <= lat + 0.05 and lon - 0.05 <= lo <= lon + 0.05 and first <= t <= last
    ]


def window(request):
    start = datetime.combine(request[3], datetime.min.time()) + 5 * HOUR
    return start + request[4] * HOUR, start + (request[5] + 1) * HOUR - timedelta(seconds=1)


def run(spark, operator, requests, rows):
    readings = operator(
        spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(rows, OBSERVATIONS)
    ).collect()
    assert len(readings) == len(requests)
    return {r.request_id: r for r in readings}


def test_waves(spark, requests):
    rows = grid(WAVES, 3, [None], [0.5, 1.0, 1.5, 2.0, None, math.nan])
    readings = run(spark, wave_gate, requests, rows)
    statuses = set()
    for request in requests:
        usable = [
            (-v, d, la, lo, t)
            for t, _, la, lo, v, d in box(request, rows, *window(request))
            if v is not None and v == v and d <= 6.5
        ]
        r = readings[request[0]]
        got = (r.significant_wave_height_m, r.cell_lat, r.cell_lon, r.max_time_utc)
        best = min(usable, default=None)
        assert got == ((-best[0], *best[2:]) if best else (None,) * 4)
        statuses.add(r.status)
    assert len(statuses) == 3


def test_chlorophyll(spark, requests):
    rows = grid(CHLOROPHYLL, 24, [None], [0.5, 1.0, None, None, None, math.nan])
    readings = run(spark, chlorophyll_latest, requests, rows)
    statuses = set()
    for request in requests:
        end = datetime.combine(request[3], datetime.min.time()) + 29 * HOUR - timedelta(seconds=1)
        usable = [
            (end - t, d, la, lo, v, t)
            for t, _, la, lo, v, d in box(request, rows, end - 72 * HOUR, end)
            if v is not None and v == v and d <= 6.5
        ]
        r = readings[request[0]]
        best = min(usable, default=None)
        got = (r.cell_lat, r.cell_lon, r.value_mg_m3, r.time_utc)
        assert got == (best[2:] if best else (None,) * 4)
        statuses.add(r.status)
    assert len(statuses) == 3


def test_series(spark, requests):
    rows = grid(TEMPERATURE, 6, [0.5, 1.5, 6.0], [20.0, 21.0, None, None, math.nan])
    readings = run(spark, temperature_series, requests, rows)
    statuses = set()
    for request in requests:
        start, end = window(request)
        found = [
            row
            for row in box(request, rows, start - 3 * HOUR, end + 3 * HOUR)
            if row[1] <= 5.0
        ]
        level = min((row[1] for row in found), default=None)
        native = {row[0] for row in found if start <= row[0] <= end}
        usable = [
            (t, la, lo, v, d)
            for t, depth, la, lo, v, d in found
            if depth == level and v is not None and v == v and d <= 6.5
        ]
        cells = {}
        for t, la, lo, v, d in usable:
            if start <= t <= end:
                cells.setdefault((d, la, lo), []).append((t, v))
        outside = [
            (start - t if t < start else t - end, t > end, t, d, la, lo, v)
            for t, la, lo, v, d in usable
            if not start <= t <= end
        ]
        r = readings[request[0]]
        got = [(s.time_utc, s.value_celsius) for s in r.samples]
        if cells:
            cell, samples = min(cells.items(), key=lambda c: (-len(c[1]), c[0]))
            assert got == sorted(samples) and (r.cell_lat, r.cell_lon) == cell[1:]
            assert r.status == "valida_en_ventana" and r.depth_m_actual == level
        elif outside:
            best = min(outside)
            assert got == [(best[2], best[6])] and (r.cell_lat, r.cell_lon) == best[4:6]
            assert r.status == "valida_cercana_en_tiempo"
        else:
            assert got == [] and r.status == "sin_datos" and r.depth_m_actual is None
        covered = len(got) if cells else 0
        assert r.n_native_times_in_window == len(native)
        assert (r.n_samples, r.n_missing_samples) == (len(got), len(native) - covered)
        assert r.coverage_fraction == (covered / len(native) if native else None)
        statuses.add(r.status)
    assert len(statuses) == 3
