"""Ranking settings: an immutable value for each query, read from and written to JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

MAX_CONFIG_CHARS = 1_000_000


@dataclass(frozen=True)
class RankingConfig:
    """What decides a ranking. ``from_dict({})`` gives the values for missing keys, ``default()`` the shipped ones."""

    rx_gain_dbi: float = 6.0
    sensitivity_dbm: float = -95.0
    bands: dict[str, list[tuple[float, float]]] = field(default_factory=dict)
    band_priority: dict[str, int] = field(default_factory=lambda: {"VHF": 0, "UHF": 1, "FM": 2})
    distance_classes: list[tuple[str, float, float]] = field(default_factory=list)
    distance_priority: dict[str, int] = field(default_factory=dict)
    sort_order: list[tuple[str, bool]] = field(
        default_factory=lambda: [("band_priority", True), ("distance_priority", True), ("received_power_dbm", False)]
    )
    default_radius_km: float = 80
    default_limit: int = 20

    @classmethod
    def from_dict(cls, raw: dict) -> RankingConfig:
        made = cls()
        rx, ranking, search = raw.get("receiver", {}), raw.get("ranking", {}), raw.get("search", {})
        found = {
            "rx_gain_dbi": float(rx.get("rx_antenna_gain_dbi", made.rx_gain_dbi)),
            "sensitivity_dbm": float(rx.get("sensitivity_dbm", made.sensitivity_dbm)),
            "bands": {b: [(float(lo), float(hi)) for lo, hi in r] for b, r in raw.get("broadcast_bands", {}).items()},
            "band_priority": dict(ranking.get("band_priority", made.band_priority)),
            "distance_classes": [
                (c["label"], float(c["min_km"]), float("inf") if c["max_km"] is None else float(c["max_km"])) for c in ranking.get("distance_classes", [])
            ],
            "distance_priority": dict(ranking.get("distance_priority", {})),
            "sort_order": [(r["field"], bool(r.get("ascending", True))) for r in ranking["sort_order"]] if "sort_order" in ranking else made.sort_order,
            "default_radius_km": search.get("default_radius_km", made.default_radius_km),
            "default_limit": int(search.get("default_limit", made.default_limit)),
        }
        return cls(**found)

    def to_dict(self) -> dict:
        return {
            "receiver": {"rx_antenna_gain_dbi": self.rx_gain_dbi, "sensitivity_dbm": self.sensitivity_dbm},
            "broadcast_bands": {b: [list(x) for x in r] for b, r in self.bands.items()},
            "ranking": {
                "band_priority": self.band_priority,
                "distance_classes": [{"label": n, "min_km": lo, "max_km": None if hi == float("inf") else hi} for n, lo, hi in self.distance_classes],
                "distance_priority": self.distance_priority,
                "sort_order": [{"field": f, "ascending": a} for f, a in self.sort_order],
            },
            "search": {"default_radius_km": self.default_radius_km, "default_limit": self.default_limit},
        }

    @classmethod
    def load(cls, path: str | Path) -> RankingConfig:
        return cls.from_dict(json.loads(Path(path).read_text()))

    def save(self, path: str | Path) -> None:
        """Write as JSON; what would not read back is refused before anything is written."""
        text = json.dumps(self.to_dict(), indent=2)
        if len(text) > MAX_CONFIG_CHARS:
            raise ValueError(f"a configuration may have {MAX_CONFIG_CHARS} characters at most")
        self.from_dict(json.loads(text))
        Path(path).write_text(text)

    @classmethod
    def default(cls) -> RankingConfig:
        # The shipped settings.
        return cls(
            rx_gain_dbi=6.0,
            sensitivity_dbm=-120.0,
            bands={"FM": [(87.8, 108.0)], "VHF": [(174.0, 216.0)], "UHF": [(470.0, 608.0)]},
            band_priority={"VHF": 0, "UHF": 1, "FM": 2},
            distance_classes=[("Too Close", 0.0, 8.0), ("Ideal", 8.0, 30.0), ("Good", 30.0, 60.0), ("Far", 60.0, float("inf"))],
            distance_priority={"Ideal": 0, "Good": 1, "Far": 2, "Too Close": 3},
            sort_order=[("band_priority", True), ("score", False)],
            default_radius_km=80,
            default_limit=100,
        )


SOURCES = ("us", "ca", "au")


def check_request(lat: float, lon: float, radius_km: int = 0, limit: int = 0, altitude_m: float = 0, source: str = "auto") -> str:
    """Bounds of a request; returns the source in lower case or raises ``ValueError``."""
    for name, value, low, high in (("lat", lat, -90, 90), ("lon", lon, -180, 180), ("radius_km", radius_km, 0, 300), ("limit", limit, 0, 200), ("altitude_m", altitude_m, 0, float("inf"))):
        if not low <= value <= high:
            raise ValueError(f"{name} must lie between {low} and {high}")
    source = source.lower()
    if source not in (*SOURCES, "auto"):
        raise ValueError(f"source must be auto or one of {', '.join(SOURCES)}")
    return source


def check_measurement(m: dict) -> None:
    """Bounds of one measurement."""
    if not 0 < m["freq_mhz"] < 10_000:
        raise ValueError("freq_mhz must lie between 0 and 10000, exclusive")
    if m.get("obw_fraction") is not None and not 0 <= m["obw_fraction"] <= 1:
        raise ValueError("obw_fraction must lie between 0 and 1")
