"""Functions, colour spaces and facsimile codes, against values by hand and the other way round."""

import random

import numpy as np
import pytest

from folioscan.functions import ccitt, colour
from folioscan.functions.pdf_functions import execute, parse_function
from folioscan.functions.pdf_fixture import stream
from folioscan.sources.pdf_bytes import Dict, Hex, Name


def one(f, *x):
    return [round(float(v), 6) for v in parse_function(f)(np.array([x], float))[0]]


def test_sampled():
    f = stream(bytes([0, 255, 128, 64]), FunctionType=0, Domain=[0, 1], Range=[0, 1, 0, 1], Size=[2], BitsPerSample=8)
    assert one(f, 0) == [0, 1] and one(f, 1) == [round(128 / 255, 6), round(64 / 255, 6)] and one(f, 0.5) == [round(64 / 255, 6), round(159.5 / 255, 6)] and one(f, 7) == one(f, 1)
    f = stream(bytes([0, 10, 20, 30]), FunctionType=0, Domain=[0, 1, 0, 1], Range=[0, 255], Size=[2, 2], BitsPerSample=8)
    assert [one(f, *x) for x in ((0, 0), (1, 0), (0, 1), (1, 1), (0.5, 0.5))] == [[0], [10], [20], [30], [15]]
    f = stream(b"\x5a", FunctionType=0, Domain=[0, 1], Range=[0, 15], Size=[2], BitsPerSample=4, Encode=[1, 0], Decode=[0, 30])
    assert one(f, 0) == [15] and one(f, 1) == [10]
    f = stream(b"", FunctionType=0, Domain=[0, 1], Range=[0, 1], Size=[2], BitsPerSample=12)
    assert one(f, 0.3) == [0]


def test_exponential_and_stitching():
    f = Dict(FunctionType=2, Domain=[0, 1], C0=[1, 0], C1=[0, 1], N=2)
    assert one(f, 0.5) == [0.75, 0.25] and one(Dict(FunctionType=2, Domain=[0, 1], N=1), 0.25) == [0.25]
    g = Dict(FunctionType=3, Domain=[0, 1], Bounds=[0.5], Encode=[0, 1, 1, 0], Functions=[Dict(FunctionType=2, Domain=[0, 1], N=1), Dict(FunctionType=2, Domain=[0, 1], N=2)])
    assert [one(g, x)[0] for x in (0, 0.25, 0.5, 0.75, 1)] == [0, 0.5, 1, 0.25, 0]
    assert parse_function(g)(np.array([[0.25], [0.75], [0.5]])).round(6).tolist() == [[0.5], [0.25], [1.0]]
    assert one([f, f], 0.5) == [0.75, 0.25, 0.75, 0.25]


@pytest.mark.parametrize("code, stack, want", [
    ("add 2 mul", [1, 2], [6]), ("exch sub", [1, 5], [4]), ("3 1 roll", [1, 2, 3], [3, 1, 2]), ("3 -1 roll", [1, 2, 3], [2, 3, 1]), ("2 copy", [1, 2], [1, 2, 1, 2]), ("1 index", [1, 2], [1, 2, 1]),
    ("dup 0.5 gt {pop 1} {pop 0} ifelse", [0.7], [1]), ("dup 0.5 gt {pop 1} if", [0.2], [0.2]), ("7 2 idiv -7 2 idiv 7 3 mod", [], [3, -3, 1]), ("90 sin 0 cos 1 0 atan", [], [1, 1, 90]), ("4 sqrt 100 log 2 3 exp", [], [2, 2, 8]),
    ("true false or not", [], [False]), ("6 3 and 6 3 or 6 3 xor", [], [2, 7, 5]), ("1 3 bitshift 8 -2 bitshift", [], [8, 2]), ("2.5 round -2.5 truncate 2.1 ceiling -2.1 floor abs neg", [], [3, -2, 3, -3]), ("1 0 div 5 cvr 5.7 cvi", [], [0, 5, 5]),
])
def test_calculator(code, stack, want):
    f = stream(b"{" + code.encode() + b"}", FunctionType=4, Domain=[-100, 100] * max(1, len(stack)), Range=[-1000, 1000] * len(want))
    got = parse_function(f)(np.array([stack or [0]], float))[0]
    assert got.tolist() == pytest.approx([float(x) for x in want])


def test_damaged_functions():
    for bad in (7, Dict(FunctionType=2), Dict(FunctionType=9, Domain=[0, 1]), stream(b"{ 1", FunctionType=4, Domain=[0, 1], Range=[0, 1]), Dict(FunctionType=3, Domain=[0, 1], Functions=[], Bounds=[], Encode=[]), stream(b"", FunctionType=0, Domain=[0, 1], Size=[2], BitsPerSample=8)):
        with pytest.raises(ValueError):
            parse_function(bad)
    for bad in (["add"], ["nosuch"], [["1"]], ["5", "copy"]):
        with pytest.raises(ValueError):
            execute(bad, [])
    assert one(stream(b"{pop pop pop}", FunctionType=4, Domain=[0, 1], Range=[1, 2]), 0.5) == [1]


def test_colours():
    rgb = lambda cs, *c, **k: [round(float(x), 4) for x in colour.to_rgb(cs, [c], **k)[0]]
    assert rgb("DeviceGray", 0.3) == [0.3] * 3 and rgb("DeviceRGB", 0.1, 2, -1) == [0.1, 1, 0] and rgb("DeviceCMYK", 0.1, 0.2, 0.3, 0.5) == [0.4, 0.3, 0.2]
    assert min(rgb([Name("Lab"), Dict()], 100, 0, 0)) > 0.999 and rgb([Name("Lab"), Dict()], 0, 0, 0) == [0, 0, 0]
    red = rgb([Name("Lab"), Dict()], 53.24, 80.09, 67.2)
    assert red[0] > 0.98 and red[1] < 0.2 and red[2] < 0.2
    indexed = [Name("Indexed"), Name("DeviceRGB"), 1, Hex(b"000000ff8000")]
    assert rgb(indexed, 1) == [1, 0.502, 0] and rgb(indexed, 5) == [1, 1, 1]
    tint = Dict(FunctionType=2, Domain=[0, 1], C0=[0, 0, 0, 0], C1=[0, 1, 1, 0], N=1)
    assert rgb([Name("Separation"), Name("Spot"), Name("DeviceCMYK"), tint], 0.5) == [1, 0.5, 0.5]
    assert rgb([Name("ICCBased"), stream(b"", N=4)], 0, 0, 0, 1) == [0, 0, 0] and rgb([Name("ICCBased"), 7], 0.2) == [0.2] * 3
    assert rgb("Own", 0.5, resources=Dict(ColorSpace=Dict(Own=[Name("Separation"), Name("Spot"), Name("DeviceCMYK"), tint]))) == [1, 0.5, 0.5] and rgb("Own", 0.5) == [0.5] * 3
    assert [colour.components(x) for x in ("DeviceGray", "RGB", "DeviceCMYK", [Name("Lab")], [Name("ICCBased"), Dict(N=4)], [Name("DeviceN"), [1, 2, 3]], [], 7)] == [1, 3, 4, 3, 4, 3, 1, 1]
    assert [colour.device_model(x) for x in ("G", [Name("Indexed"), Name("DeviceCMYK")], "CalRGB", [Name("DeviceRGB")], None)] == ["gray", "cmyk", None, "rgb", None]
    assert colour.default_defined("rgb", Dict(ColorSpace=Dict(DefaultRGB=[Name("CalRGB")]))) and not colour.default_defined("cmyk", Dict())


def lines(rng, columns, n):
    out = []
    for _ in range(n):
        changes = sorted(rng.sample(range(0, columns), rng.randint(0, min(8, columns - 1)) // 2 * 2))
        out.append(changes)
    return out


def packed(changes, columns):
    row = [0] * columns
    for s, e in zip(changes[::2], changes[1::2]):
        row[s:e] = [1] * (e - s)
    return np.packbits(row).tobytes()


@pytest.mark.parametrize("columns", [8, 37, 1728, 6000])
def test_facsimile(columns):
    rng = random.Random(columns)
    rows = lines(rng, columns, 12)
    rows += [rows[-1], rows[-1], []]
    want = b"".join(packed(r, columns) for r in rows)
    for group4 in (True, False):
        got = ccitt.decode_ccitt(ccitt.encode_ccitt(rows, columns, group4), -1 if group4 else 0, columns, black_is_1=True)
        assert got == want
    data = ccitt.encode_ccitt(rows, columns)
    assert ccitt.decode_ccitt(data, -1, columns, len(rows)) == ccitt.decode_ccitt(data, -1, columns)
    assert len(ccitt.decode_ccitt(data[: len(data) // 2], -1, columns, len(rows))) == len(want)
    for bad in (b"", b"\0\0"):
        with pytest.raises(ValueError):
            ccitt.decode_ccitt(bad, -1, columns)


def test_codes_are_free_of_prefixes():
    for table in (*ccitt.RUNS, ccitt.MODES):
        codes = sorted(table)
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
    assert [len(t) for t in ccitt.RUNS] == [104, 104]
