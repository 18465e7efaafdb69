"""Time the sequential rules, one record at a time in one process, on the
sensor readings of a folder: the yardstick for the detector queries."""

import sys
import time
from pathlib import Path

import duckdb

root = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(root), str(root / "tests")]

import sequential  # noqa: E402

from tidewatch.plans import oracles  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    for key in ("sensor_id", "location"):
        body = f"SELECT {key}, list(value ORDER BY timestamp, id) FROM sensors GROUP BY 1"
        groups = db.execute(oracles.with_views(oracles.SENSORS, body)).fetchall()
        for rule in (sequential.zscore, sequential.moving_average):
            started = time.perf_counter()
            rows = sum(len(rule(values)) for _, values in groups)
            spent = time.perf_counter() - started
            print(f"{rule.__name__:15} by {key:10} {rows} rows {spent:7.2f} s {rows / spent:10.0f} rows/s")


if __name__ == "__main__":
    main()
