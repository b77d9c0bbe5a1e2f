"""Many small cases in one job: each case gets days of its own, so no case sees another's rows."""

from datetime import date, datetime, timedelta

from seapoint.schemas import OBSERVATIONS, REQUESTS

LAT, LON = -12.471, -76.790
NEAR, FAR, OUT = -76.75, -76.833333, -76.900
CELL_LAT = -12.5
NAN = float("nan")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


class Cases:
    """Collects cases around ``day``; every case is shifted by ten more days."""

    def __init__(self, product, day: str):
        self.product, self.day = product, date.fromisoformat(day)
        self.requests, self.rows, self.names = [], [], []

    def add(self, name, cells, times=None, hours=(0, 23), lat=LAT, depth=None):
        """``cells``: {(lat, lon) or lon: [values by time]}, or a list of full rows."""
        shift = timedelta(days=10 * len(self.names))
        self.names.append(name)
        number = len(self.names)
        self.requests.append((number, lat, LON, self.day + shift, *hours))
        for place, values in cells.items():
            cell_lat, cell_lon = place if isinstance(place, tuple) else (CELL_LAT, place)
            for time, value in zip(times, values, strict=True):
                for level, added in depth or ((None, 0.0),):
                    self.rows.append(
                        (
                            self.product.dataset_id,
                            self.product.variable,
                            time + shift,
                            level,
                            cell_lat,
                            cell_lon,
                            None if value is None else value + added,
                        )
                    )
        return self

    def run(self, spark, operator):
        """{case: reading}, with the shift taken back from every date and time."""
        readings = operator(
            spark.createDataFrame(self.requests, REQUESTS),
            spark.createDataFrame(self.rows, OBSERVATIONS),
        ).collect()
        assert len(readings) == len(self.names)
        return {
            self.names[r.request_id - 1]: _shifted(
                r.asDict(recursive=True), timedelta(days=10 * (r.request_id - 1))
            )
            for r in readings
        }


def _shifted(value, shift):
    if isinstance(value, dict):
        return {k: _shifted(v, shift) for k, v in value.items()}
    if isinstance(value, list):
        return [_shifted(v, shift) for v in value]
    return value - shift if isinstance(value, date) else value
