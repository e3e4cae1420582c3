"""Downloads of reference tables; a file that is there is kept unless forced."""

from __future__ import annotations

import csv
from pathlib import Path
from urllib.request import urlopen

#: Where the publisher offers the station tables, and what its extracts are called.
STATIONS_URL = "https://data.ny.gov/resource/5f5g-n3cz.csv?$limit=1000"
STATIONS_INDIVIDUAL_URL = "https://data.ny.gov/resource/39hk-dx4f.csv?$limit=1000"
CSV_PATTERN = "data/*_Subway_Origin-Destination_Ridership_Estimate__2025_*.csv"


def fetch_csv(url: str, out: str, force: bool = False) -> int | None:
    """Store the CSV file of ``url`` at ``out``; returns its number of rows, or None if it was kept."""
    path = Path(out)
    if path.exists() and not force:
        return None
    with urlopen(url) as response:  # noqa: S310
        content = response.read()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    with path.open(newline="", encoding="utf-8-sig") as f:
        return max(0, sum(1 for _ in csv.reader(f)) - 1)
