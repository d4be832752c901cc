"""A service of systems for tests: it answers by the request's filters, page by page, and notes what it sent."""

import json
from pathlib import Path


def node(i, mhz, subtype, callsign="W"):
    return {
        "id": f"s{i}", "licence": {"type": "Broadcasting", "subtype": subtype},
        "devices": [{"callsign": f"{callsign}{i}", "frequency": mhz, "eirp": 100.0, "location": {"name": "n", "state": "SC", "geom": {"string": f"POINT(-82.4 {34 + i / 1000})"}}}],
    }


class Service:
    """Systems of the file in the option ``held``, as (subtype, mhz, radius) rows; every page that is sent is noted below ``noted``."""

    def __init__(self, options):
        self.rows, self.noted, self.failing = json.loads(Path(options["held"]).read_text()), Path(options["noted"]), options.get("failing", "")

    def send(self, part, cursor, page_size):
        r = part.request
        if r.subtype == self.failing and cursor:
            raise TimeoutError("no answer")
        fit = [(i, *row) for i, row in enumerate(self.rows) if r.subtype in (None, row[0]) and (r.low_mhz or 0) <= row[1] <= (r.high_mhz or 1e9) and row[2] <= r.radius_km]
        left = [row for row in fit if row[0] > int(cursor or -1)]
        page = left[:page_size]
        (self.noted / f"{part.request_no}-{part.subtype_no}-{cursor or 0}-{len(page)}").touch()
        edges = [{"cursor": str(i), "node": node(i, mhz, subtype)} for i, subtype, mhz, _ in page]
        return {"data": {"systems": {"edges": edges, "pageInfo": {"hasNextPage": len(left) > len(page)}}}}


def known_ground(lats, lons):
    return [None if la < 0 else la * 10 for la in lats][: max(0, len(lats) - 1)]


def broken(lats, lons):
    raise OSError("no network")
