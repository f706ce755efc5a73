"""Laws of the request language over rendered catalog attributes."""

from hypothesis import given, settings
from hypothesis import strategies as st

from fastenlake import vocab
from fastenlake.functions import text as tx
from fastenlake.functions.parse import read_description, read_request
from fastenlake.plans import bridge

KINDS = st.integers(0, len(bridge.PHRASES) - 1)
NOISE = st.sampled_from(["please quote", "need", "want 20 pcs of", "qty 5", "100 ea"])
LENGTHS = {"metric": [(f"{n}mm", float(n)) for n in bridge.METRIC_LENGTHS], "imperial": [(f'{t}"', mm) for t, mm in bridge.INCH_LENGTHS]}
LENGTHS["number"] = LENGTHS["imperial"]


@st.composite
def items(draw):
    nominal, system, pitch, _ = draw(st.sampled_from(vocab.DIAMETERS))
    kind = draw(KINDS)
    size = draw(st.sampled_from([None, *LENGTHS[system]]))
    material, finish = draw(st.sampled_from([*zip(bridge.MATERIALS, vocab.MATERIAL_FAMILY, strict=True)])), draw(st.sampled_from([*zip(bridge.FINISHES, vocab.FINISH_FAMILY, strict=True)]))
    return {"nominal": nominal, "pitch": pitch, "kind": kind, "size": size, "material": material, "finish": finish}


def facts(spec):
    return (spec["diameter"]["nominal"], spec["diameter"]["known"], spec["length"] and spec["length"]["mm"], [t["value"] for t in spec["type"]], spec["material"]["value"], spec["finish"]["value"], spec["residue"])


def wanted(i):
    return (i["nominal"], True, i["size"] and i["size"][1], [vocab.PRODUCT_TYPES[i["kind"]]], i["material"][1], i["finish"][1], [])


def said(i, phrases=bridge.PHRASES):
    return " ".join([i["nominal"], *(["x", i["size"][0]] if i["size"] else []), phrases[i["kind"]], i["material"][0], i["finish"][0]])


@settings(max_examples=300, deadline=None, derandomize=True)
@given(items(), st.booleans(), NOISE)
def test_a_rendered_item_reads_back(i, upper, noise):
    text = said(i)
    assert facts(read_request(text.upper() if upper else text)) == wanted(i)
    assert facts(read_request(f"{noise} {text}")) == wanted(i)
    assert facts(read_request(said(i, bridge.SHORT))) == wanted(i)  # abbreviations say the same
    assert facts(read_description(text)) == wanted(i)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(items(), st.sampled_from(["gizmo", "frobnicate", "qqq"]))
def test_an_unknown_word_changes_the_residue_only(i, word):
    plain, more = read_request(said(i)), read_request(f"{said(i)} {word}")
    assert more["residue"] == [word] and facts(more)[:-1] == facts(plain)[:-1]


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(alphabet="MmxX×0123456789/-#\"'½ ,.abnutwshei\t ", max_size=40))
def test_any_text_is_read(text):
    words, _ = tx.cleaned(text)
    canonical = " ".join(w.text for w in words)
    spec = read_request(text)
    assert all(0 <= w.start < w.end <= len(text) for w in words)
    assert set(spec["residue"]) <= {w.text for w in words}
    assert all(q in text for q in spec["evidence"].values() if q) or spec["pitch"] is not None
    assert isinstance(canonical, str)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_distance_laws(a, b, c):
    d = tx.osa_distance
    assert d(a, b) == d(b, a) and (d(a, b) == 0) == (a == b)
    assert abs(len(a) - len(b)) <= d(a, b) <= max(len(a), len(b))
    assert d(a + c, b + c) <= d(a, b)
    for most in range(4):
        assert d(a, b, most) == (d(a, b) if d(a, b) <= most else most + 1)
