"""Regions served by default. Ids, boxes and centres."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Region:
    id: str
    name: str
    state: str
    box: tuple[float, float, float, float]  # west, south, east, north
    center: tuple[float, float]  # lng, lat
    zoom: float


REGIONS = (
    Region("nyc", "New York City", "NY", (-74.259, 40.477, -73.7, 40.917), (-73.985, 40.728), 12.0),
    Region("philadelphia", "Philadelphia", "PA", (-75.28, 39.867, -74.955, 40.138), (-75.1652, 39.9526), 12.5),
    Region("boston", "Boston", "MA", (-71.191, 42.227, -70.986, 42.42), (-71.0789, 42.3601), 12.5),
)
