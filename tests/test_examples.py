"""Whole readings of published example requests and of adversarial ones.

The table gives the diameter, the length, the types with their strength, material,
finish and residue; whatever isn't given must be absent."""

import pytest

from fastenlake import vocab
from fastenlake.functions.parse import read_request

IN, MM, FT = "in", "mm", "ft"
# Request -> what it says
EXAMPLES = [
    ("M8 flat washer", "M8", None, 1, "flat_washer"),
    ("5/16 hex nut", "5/16", None, 1, "hex_nut"),
    ("1/2 inch hex nut", "1/2", None, 1, "hex_nut"),
    ("M6 hex nuts", "M6", None, 1, "hex_nut"),
    ("SHCS 7/16 x 2-1/2", "7/16", (2.5, IN, 63.5), 1, "socket_head_cap_screw"),
    ("1/2 rod 6 foot", "1/2", (6, FT, 1828.8), 1, "threaded_rod"),
    ("HHB 3/4-10 x 5/8", "3/4", (0.625, IN, 15.875), 1, "hex_cap_screw tap_bolt"),
    ("lock washer 5/8", "5/8", None, 1, "lock_washer"),
    ("M8 x 16 hex cap screw", "M8", (16, MM, 16), 1, "hex_cap_screw"),
    ("M16 threaded rod 60mm", "M16", (60, MM, 60), 1, "threaded_rod"),
    ("5/8 flat washer", "5/8", None, 1, "flat_washer"),
    ("M12 x 50mm button socket", "M12", (50, MM, 50), 1, "button_socket_cap_screw"),
    ("#8-32 lock washer", "#8", None, 1, "lock_washer"),
    ("1/4-20 x 3/4 hex cap screw zinc", "1/4", (0.75, IN, 19.05), 1, "hex_cap_screw", {"finish": "zinc"}),
    ("M4 x 16mm socket head cap screw", "M4", (16, MM, 16), 1, "socket_head_cap_screw"),
    ("3/8 lag screw 1 inch", "3/8", (1, IN, 25.4), 1, "lag_screw"),
    ("M5 x 30 threaded rod", "M5", (30, MM, 30), 1, "threaded_rod"),
    ("7/16-14 phillips pan machine screw 1-1/4", "7/16", (1.25, IN, 31.75), 1, "pan_machine_screw"),
    ("5/16-18 flat washer", "5/16", None, 1, "flat_washer"),
    ("M10 x 60mm lag screw", "M10", (60, MM, 60), 1, "lag_screw"),
    ("M8 x 50mm BHCS", "M8", (50, MM, 50), 1, "button_socket_cap_screw"),
    ("3/4-10 tap bolt 5/8", "3/4", (0.625, IN, 15.875), 1, "tap_bolt"),
    ("M12 hex nut", "M12", None, 1, "hex_nut"),
    ("1/2-13 x 3 lag screw", "1/2", (3, IN, 76.2), 1, "lag_screw"),
    ("M6 x 50mm tap bolt", "M6", (50, MM, 50), 1, "tap_bolt"),
    ("#10-24 x 1/2 threaded rod", "#10", (0.5, IN, 12.7), 1, "threaded_rod"),
    ("5/8-11 x 3/8 lag screw", "5/8", (0.375, IN, 9.525), 1, "lag_screw"),
    ("M16 x 8mm pan head machine screw", "M16", (8, MM, 8), 1, "pan_machine_screw"),
    ("3/8-16 x 4 hex bolt", "3/8", (4, IN, 101.6), 1, "hex_cap_screw tap_bolt"),
    ("M4 hex nut", "M4", None, 1, "hex_nut"),
    ("M8 x 50mm button socket cap screw alloy black oxide", "M8", (50, MM, 50), 1, "button_socket_cap_screw", {"material": "alloy", "finish": "black_oxide"}),
    ("brass hex nut 1/2-13", "1/2", None, 1, "hex_nut", {"material": "brass"}),
    ("the same washers as last time", None, None, 0.6, "flat_washer lock_washer", {"residue": ["the", "as"]}),
]
ADVERSARIAL = [
    ("12 millimeter hex nut", "M12", None, 1, "hex_nut"),
    ("M8 x 3/4 hex cap screw", "M8", (0.75, IN, 19.05), 1, "hex_cap_screw"),
    ("hex nutt", None, None, 0.9, "hex_nut"),
    ("socket haed cap screw", None, None, 0.9, "socket_head_cap_screw"),
    ("HHB 3/4-10 x 5/8", "3/4", (0.625, IN, 15.875), 1, "hex_cap_screw tap_bolt"),
    ("M8 hex nut nylon insert", "M8", None, 1, "hex_nut", {"residue": ["nylon", "insert"]}),
    ("grade 8 1/2-13 hex nut", "1/2", None, 1, "hex_nut", {"residue": ["grade", "8"]}),
    ("brass hex nut 1/2-13", "1/2", None, 1, "hex_nut", {"material": "brass"}),
    ("please quote 200 pcs of M8 x 50 BHCS black oxide", "M8", (50, MM, 50), 1, "button_socket_cap_screw", {"finish": "black_oxide"}),
]


@pytest.mark.parametrize("case", EXAMPLES + ADVERSARIAL, ids=lambda c: c[0])
def test_reads_as_published(case):
    query, nominal, length, strength, types, *more = case
    more = more[0] if more else {}
    got = read_request(query)
    thread = next(({"system": s, "nominal": n, "mm": mm, "known": True, "pitch": p} for n, s, p, mm in vocab.DIAMETERS if n == nominal), None)
    assert (got["diameter"] and {**got["diameter"], "pitch": got["pitch"]}) == thread and (thread or got["pitch"] is None)
    assert got["length"] == (length and dict(zip(("value", "unit", "mm"), length, strict=True)))
    assert got["type"] == [{"value": t, "strength": strength} for t in types.split()]
    for a in ("material", "finish"):
        assert got[a] == (more.get(a) and {"value": more[a], "strength": 1})
    assert got["standard"] is None and got["residue"] == more.get("residue", [])
    assert got["intent"] == ("last time" if "last time" in query else None)
