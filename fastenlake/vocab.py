"""The closed vocabularies of fastener descriptions and requests, and the engine's parameters."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

# --- Fixed values (attribute vocabularies) ---

PRODUCT_TYPES = "hex_cap_screw socket_head_cap_screw button_socket_cap_screw pan_machine_screw lag_screw tap_bolt threaded_rod hex_nut flat_washer lock_washer".split()
MATERIAL_FAMILY = {"steel": "steel", "ss_18_8": "stainless", "ss_316": "stainless", "ss_a2": "stainless", "brass": "brass", "alloy": "alloy"}
FINISH_FAMILY = {"zinc": "zinc_family", "yellow_zinc": "zinc_family", "mech_zinc": "zinc_family", "hdg": "hdg", "plain": "plain", "black_oxide": "black_oxide"}
STANDARDS = ["ASME B18.2.1", "DIN 912", "DIN 933", "ISO 7380", "IFI 111", "ASTM A307", "CLASS 8"]
THREAD_SYSTEMS = ["metric", "imperial", "number"]
#: nominal, system, pitch (millimetres, or threads per inch), millimetres
DIAMETERS = [
    ("1/4", "imperial", "20", 6.35), ("5/16", "imperial", "18", 7.9375), ("3/8", "imperial", "16", 9.525), ("7/16", "imperial", "14", 11.1125),
    ("1/2", "imperial", "13", 12.7), ("5/8", "imperial", "11", 15.875), ("3/4", "imperial", "10", 19.05), ("M4", "metric", "0.7", 4.0),
    ("M5", "metric", "0.8", 5.0), ("M6", "metric", "1.0", 6.0), ("M8", "metric", "1.25", 8.0), ("M10", "metric", "1.5", 10.0),
    ("M12", "metric", "1.75", 12.0), ("M16", "metric", "2.0", 16.0), ("#8", "number", "32", 4.1656), ("#10", "number", "24", 4.826),
]
ATTRIBUTES = ["diameter", "pitch", "length", "type", "material", "finish", "standard"]
STATUSES = ["unique", "ambiguous", "none", "history", "unparsed"]
MATERIAL_NAMES = {"steel": "steel", "ss_18_8": "18-8 SS", "ss_316": "316 SS", "ss_a2": "A2 SS", "brass": "brass", "alloy": "alloy", "stainless": "stainless"}
FINISH_NAMES = {"zinc": "zinc", "yellow_zinc": "yellow zinc", "mech_zinc": "mech zinc", "hdg": "hot-dip galvanized", "plain": "plain", "black_oxide": "black oxide", "zinc_family": "zinc"}
INTENT_PHRASES = ["what we always get", "previous order", "like before", "last time", "reorder", "usual", "again", "same"]
STANDARD_BODIES = ["din", "iso", "asme", "astm", "ansi", "ifi"]
PROTECTED_CODES = "ss zn hdg din iso nut hex lag ifi astm asme pln yel btn soc scr".split()
#: SKU codes: type, material, finish
SKU_TYPES = {"HEX": "hex_cap_screw", "SOC": "socket_head_cap_screw", "BTN": "button_socket_cap_screw", "PAN": "pan_machine_screw", "LAG": "lag_screw", "TAP": "tap_bolt", "ROD": "threaded_rod", "NUT": "hex_nut", "WASH": "flat_washer", "LOCK": "lock_washer"}
SKU_MATERIALS = {"ST": "steel", "88": "ss_18_8", "36": "ss_316", "A2": "ss_a2", "BR": "brass", "AL": "alloy"}
SKU_FINISHES = {"ZC": "zinc", "YZ": "yellow_zinc", "MZ": "mech_zinc", "HG": "hdg", "PL": "plain", "BO": "black_oxide"}

# --- Fixed values (request language) ---

UNIT_WORDS = {"inch": "in", "inches": "in", "in.": "in", "in": "in", "foot": "ft", "feet": "ft", "ft": "ft", "millimeter": "mm", "millimeters": "mm", "millimetre": "mm", "millimetres": "mm", "mm": "mm"}
FRACTIONS = {"¼": "1/4", "½": "1/2", "¾": "3/4", "⅜": "3/8", "⅝": "5/8"}
NUMBER_WORDS = ["#", "no.", "no", "number"]
PLURALS = {"nuts": "nut", "washers": "washer", "screws": "screw", "bolts": "bolt", "rods": "rod", "studs": "stud"}
QUANTITY_WORDS = ["pcs", "pc", "pieces", "piece", "ea", "each", "qty"]
NOISE_WORDS = ["please", "quote", "need", "want"]
SPELLINGS = {"hex": "hx", "screw": "scr", "socket": "soc", "button": "btn", "phillips": "phil", "machine": "mach", "washer": "wshr"}

# --- Parameters ---


@dataclass(frozen=True)
class Config:
    """Every tunable of the engine.  The lexicon's strengths and the strength of a
    corrected word are parameters too, and take effect wherever a config is passed."""

    # The defaults of all parameters
    epsilon: float = 0.02
    kappa: float = 3.0
    tau_days: float = 180.0
    k: float = 5.0
    alpha: float = 1.0
    w_sku: float = 2.0
    sibling_credit: float = 0.5
    family_credit: float = 0.8
    fuzzy_strength: float = 0.9
    short_form: float = 0.9
    weak: float = 0.7
    generic: float = 0.6
    ambiguous: float = 0.5
    distant: float = 0.4
    label_high: float = 0.8
    label_medium: float = 0.35
    labels_provisional: bool = False
    backoff: tuple[str, ...] = ("standard", "materialFinishFamily", "approximateLength", "dropLength")
    length_tolerance: float = 0.25
    tie_tolerance: float = 1e-9
    lexical_cap: float = 0.4
    lexical_unique_gap: float = 0.01
    history_confidence: float = 0.7
    history_decay: float = 0.8
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    default_limit: int = 3
    max_limit: int = 10


DEFAULT = Config()


def spelled(phrase: str) -> list[str]:
    """The phrase in every mix of written-out and short words."""
    return [" ".join(p) for p in product(*[[w, SPELLINGS[w]] if w in SPELLINGS else [w] for w in phrase.split()])]


def lexicon(c: Config = DEFAULT) -> dict[str, tuple[str, tuple[tuple[str, float], ...]]]:
    """phrase -> (attribute, ((value, strength), ...)); of equal phrases the later one holds."""
    out: dict[str, tuple[str, tuple[tuple[str, float], ...]]] = {}

    def put(attribute: str, phrases: str, *values: str, strength: float = 1.0, spell: bool = False) -> None:
        for phrase in phrases.split(", "):
            for p in spelled(phrase) if spell else [phrase]:
                out[p] = (attribute, tuple((v, strength) for v in values))

    # Phrases of each product type, first those with short spellings
    put("type", "hex cap screw", "hex_cap_screw", spell=True)
    put("type", "hex nut", "hex_nut", spell=True)
    put("type", "socket head cap screw", "socket_head_cap_screw", spell=True)
    put("type", "button socket cap screw", "button_socket_cap_screw", spell=True)
    put("type", "phillips pan machine screw", "pan_machine_screw", spell=True)
    put("type", "lag screw, hex hd lag screw", "lag_screw", spell=True)
    put("type", "flat washer", "flat_washer", spell=True)
    put("type", "lock washer", "lock_washer", spell=True)
    put("type", "tap bolt", "tap_bolt", spell=True)
    put("type", "threaded rod, full thread rod", "threaded_rod", spell=True)
    put("type", "shcs, socket head, soc head, socket cap screw, allen head, allen bolt", "socket_head_cap_screw")
    put("type", "bhcs, button head, button socket, button cap screw, btn", "button_socket_cap_screw")
    put("type", "hhcs, hex head cap screw", "hex_cap_screw")
    put("type", "pan head machine screw, pan head, phil pan, pms", "pan_machine_screw")
    put("type", "lag, lag bolt, hex lag", "lag_screw")
    put("type", "tap screw, full thread hex bolt", "tap_bolt")
    put("type", "rod, all thread, allthread, atr", "threaded_rod")
    put("type", "nut, finished hex nut, hn", "hex_nut")
    put("type", "fw", "flat_washer")
    put("type", "lw, split washer, spring washer, split lock washer", "lock_washer")
    put("type", "hhb, hex bolt, hex head bolt", "hex_cap_screw", "tap_bolt")
    put("type", "hex screw", "hex_cap_screw", strength=c.family_credit)
    put("type", "washer", "flat_washer", "lock_washer", strength=c.generic)
    put("type", "machine screw", "pan_machine_screw", strength=c.generic)
    put("type", "cap screw", "hex_cap_screw", "socket_head_cap_screw", "button_socket_cap_screw", strength=c.ambiguous)
    put("type", "stud", "threaded_rod", strength=c.ambiguous)
    out["bolt"] = ("type", (("hex_cap_screw", c.ambiguous), ("tap_bolt", c.ambiguous), ("lag_screw", c.distant)))
    put("unknown", "carriage bolt, eye bolt, u bolt, j bolt, shoulder bolt, square head bolt, wing nut, acorn nut, lock nut")
    # materials
    put("material", "steel", "steel")
    put("material", "18-8 ss, 18-8, 304, ss 304", "ss_18_8")
    put("material", "316 ss, 316, a4", "ss_316")
    put("material", "a2 ss, a2", "ss_a2")
    put("material", "brass", "brass")
    put("material", "alloy steel, alloy", "alloy")
    put("material", "stainless, ss, inox", "stainless", strength=c.family_credit)
    # finishes
    put("finish", "zinc, zn, zinc plated, zp", "zinc")
    put("finish", "yellow zinc, yel zinc, yellow zn, yel zn, yz", "yellow_zinc")
    put("finish", "yellow", "yellow_zinc", strength=c.short_form)
    put("finish", "mech zinc, mech zn, mechanical zinc", "mech_zinc")
    put("finish", "hdg, hot dip, hot dipped, galvanized, galv", "hdg")
    put("finish", "plain, pln, bare, uncoated", "plain")
    put("finish", "black oxide, blk oxide", "black_oxide")
    put("finish", "black", "black_oxide", strength=c.weak)
    # standards
    for phrases, name in (("asme b18.2.1, b18.2.1", "ASME B18.2.1"), ("din 912, din912", "DIN 912"), ("din 933, din933", "DIN 933"), ("iso 7380, iso7380", "ISO 7380"), ("ifi 111, ifi111", "IFI 111"), ("astm a307, a307", "ASTM A307"), ("class 8", "CLASS 8")):
        put("standard", phrases, name)
    return out
