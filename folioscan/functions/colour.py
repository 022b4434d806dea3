"""Colour spaces: their components, their model, and colours in red, green and blue, over arrays of many colours."""

from __future__ import annotations

import numpy as np

from folioscan.functions.pdf_functions import parse_function

MAX_DEPTH = 16
GRAY, RGB, CMYK = {"DeviceGray", "G", "CalGray"}, {"DeviceRGB", "RGB", "CalRGB"}, {"DeviceCMYK", "CMYK"}
_XYZ = np.array([[3.1338561, -1.6168667, -0.4906146], [-0.9787684, 1.9161415, 0.0334540], [0.0719453, -0.2289914, 1.4052427]])
_D50 = np.array([0.9642, 1.0, 0.8249])


def device_model(cs: object, get=lambda x: x) -> str | None:
    """gray, rgb or cmyk of a device space, also below an indexed one."""
    cs = get(cs)
    head = get(cs[0]) if isinstance(cs, list) and cs else cs
    if isinstance(cs, list) and head in ("Indexed", "I"):
        return device_model(cs[1], get) if len(cs) > 1 else None
    known = {"DeviceGray": "gray", "DeviceRGB": "rgb", "DeviceCMYK": "cmyk"} | ({"G": "gray", "RGB": "rgb", "CMYK": "cmyk"} if not isinstance(cs, list) else {})
    return known.get(head) if isinstance(head, str) else None


def named_space(name: str, resources: object, get=lambda x: x) -> object:
    """The space that resources give a name; None without."""
    spaces = get(resources.get("ColorSpace")) if isinstance(resources, dict) else None
    return get(spaces.get(name)) if isinstance(spaces, dict) else None


def default_defined(model: str, resources: object, get=lambda x: x) -> bool:
    """Whether resources name a space to use instead of a device model."""
    return named_space({"gray": "DefaultGray", "rgb": "DefaultRGB", "cmyk": "DefaultCMYK"}[model], resources, get) is not None


def components(cs: object, get=lambda x: x) -> int:
    """How many numbers a colour has; 1 where it isn't known."""
    cs = get(cs)
    head = get(cs[0]) if isinstance(cs, list) and cs else cs
    if not isinstance(head, str):
        return 1
    if head in RGB or isinstance(cs, list) and head == "Lab":
        return 3
    if head in CMYK:
        return 4
    if isinstance(cs, list) and len(cs) > 1:
        second = get(cs[1])
        if head == "ICCBased" and isinstance(second, dict) and isinstance(n := get(second.get("N")), int):
            return n
        if head == "DeviceN" and isinstance(second, list):
            return len(second)
    return 1


def cmyk_to_rgb(c: np.ndarray) -> np.ndarray:
    return 1 - np.minimum(1, c[:, :3] + c[:, 3:4])


def lab_to_rgb(c: np.ndarray) -> np.ndarray:
    """From L*, a*, b* under D50, with the transfer of sRGB."""
    y = (c[:, 0] + 16) / 116
    t = np.stack([y + c[:, 1] / 500, y, y - c[:, 2] / 200], axis=1)
    d = 6 / 29
    linear = np.clip((_D50 * np.where(t > d, t**3, 3 * d * d * (t - 4 / 29))) @ _XYZ.T, 0, 1)
    return np.clip(np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * np.power(linear, 1 / 2.4) - 0.055), 0, 1)


def _unknown(c: np.ndarray) -> np.ndarray:
    """The first component as a gray; without any, the middle one."""
    v = np.clip(c[:, :1], 0, 1) if c.shape[1] else np.full((len(c), 1), 0.5)
    return np.repeat(v, 3, axis=1)


def to_rgb(cs: object, colours: object, resources: object = None, get=lambda x: x, decoded=lambda s: s.raw or b"", depth: int = 0) -> np.ndarray:
    """Colours, a row each, in red, green and blue from 0 to 1. A space that can't be read takes the first component
    for a gray."""
    c, cs = np.asarray(colours, float), get(cs)
    c = c.reshape(len(c), -1)
    more = {"resources": resources, "get": get, "decoded": decoded, "depth": depth + 1}
    head = get(cs[0]) if isinstance(cs, list) and cs else cs
    if depth > MAX_DEPTH or not isinstance(head, str):
        return _unknown(c)
    if head in GRAY:
        return _unknown(c)
    if head in RGB:
        return np.clip(c[:, :3], 0, 1) if c.shape[1] >= 3 else _unknown(c)
    if head in CMYK:
        return cmyk_to_rgb(c) if c.shape[1] >= 4 else _unknown(c)
    if not isinstance(cs, list):
        named = named_space(head, resources, get)
        return to_rgb(named, c, **more) if named is not None else _unknown(c)
    if head == "Lab":
        return lab_to_rgb(c) if c.shape[1] >= 3 else _unknown(c)
    if head == "ICCBased":
        model = {1: "DeviceGray", 3: "DeviceRGB", 4: "DeviceCMYK"}.get(components(cs, get))
        return to_rgb(model, c, **more) if len(cs) > 1 and isinstance(get(cs[1]), dict) and model else _unknown(c)
    if head in ("Indexed", "I") and len(cs) >= 4 and c.shape[1]:
        base, table = get(cs[1]), get(cs[3])
        if isinstance(table, dict):
            try:
                table = decoded(table)
            except ValueError:
                return _unknown(c)
        raw = getattr(table, "value", table)
        n = components(base, get)
        if not isinstance(raw, bytes):
            return _unknown(c)
        entries = np.frombuffer(raw[: len(raw) // n * n], np.uint8).reshape(-1, n) / 255
        at = np.trunc(c[:, 0]).astype(int)
        ok, out = (at >= 0) & (at < len(entries)), _unknown(c)
        if ok.any():
            out[ok] = to_rgb(base, entries[at[ok]], **more)
        return out
    if head in ("Separation", "DeviceN") and len(cs) >= 4:
        try:
            return to_rgb(cs[2], parse_function(cs[3], get, decoded)(c), **more)
        except (ValueError, TypeError):
            return _unknown(c)
    return _unknown(c)
