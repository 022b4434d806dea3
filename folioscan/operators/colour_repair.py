"""Repairs of colour and resources: default spaces for device colours, spaces of too many colorants, unused entries."""

from __future__ import annotations

import numpy as np

from folioscan.functions import colour
from folioscan.functions.pdf_functions import parse_function
from folioscan.operators.font_repair import usage_of
from folioscan.sources.pdf_bytes import Dict, Name, tokenize_content

CATEGORIES = tuple("ColorSpace ExtGState Font Pattern Properties Shading XObject".split())
MAX_ENTRIES, MAX_COLORANTS = 4095, 8
_PAINT = {"gray": "g", "rgb": "rg", "cmyk": "k"}


def _resources(e, d: Dict, inherit: bool) -> Dict:
    """The resources of a page or a form, made its own."""
    at, r = d, None
    while isinstance(at, Dict) and r is None:
        r = e.get(at.get("Resources"))
        at = e.get(at.get("Parent")) if inherit else None
    if not isinstance(r, Dict):
        r = Dict()
    if not isinstance(e.get(d.get("Resources")), Dict):
        r = d["Resources"] = Dict(r)
    return r


def intents(e) -> set[str]:
    """The device models that an output intent covers."""
    out: set[str] = set()
    found = e.get(e.catalog.get("OutputIntents"))
    for i in found if isinstance(found, list) else []:
        p = e.get((e.get(i) or {}).get("DestOutputProfile")) if isinstance(e.get(i), Dict) else None
        if isinstance(p, Dict):
            out |= {3: {"gray", "rgb"}, 4: {"gray", "cmyk"}, 1: {"gray"}}.get(e.get(p.get("N")), set())
    return out


def default_spaces(e, profile) -> None:
    """Pages and forms that use a device model without an intent get a default space of it; profile makes the bytes of
    one of a model."""
    missing = [m for m in ("rgb", "cmyk") if m not in intents(e)]
    shared: dict[str, list] = {}

    def space(m: str) -> list:
        if m not in shared:
            s = Dict(N=3 if m == "rgb" else 4)
            e.set_body(s, profile(m))
            shared[m] = [Name("ICCBased"), e.add(s)]
        return shared[m]

    for d in list(e.dicts()):
        page = d.get("Type") == "Page"
        if page or d.is_stream and d.get("Subtype") == "Form" or d.is_stream and d.get("PatternType") == 1:
            r = _resources(e, d, page)
            spaces = e.get(r.get("ColorSpace"))
            spaces = spaces if isinstance(spaces, Dict) else Dict()
            for m in missing:
                spaces.setdefault("DefaultRGB" if m == "rgb" else "DefaultCMYK", space(m))
            if spaces:
                r["ColorSpace"] = spaces


def _too_many(e, cs: object) -> bool:
    cs = e.get(cs)
    return isinstance(cs, list) and len(cs) > 3 and e.get(cs[0]) == "DeviceN" and isinstance(n := e.get(cs[1]), list) and len(n) > MAX_COLORANTS


def _in_alternate(e, cs: list, colours: np.ndarray) -> np.ndarray:
    return np.clip(parse_function(cs[3], e.get, e.body)(colours), 0, 1)


def colorants(e, write) -> None:
    """Colours in spaces of too many colorants become those that their tint functions give in the alternate space: in
    content, and in the samples of images. A space whose function can't be read stays. write makes a stream of
    operators."""
    for d in list(e.dicts()):
        if d.is_stream and d.get("Subtype") == "Image" and _too_many(e, d.get("ColorSpace")) and e.get(d.get("BitsPerComponent")) == 8:
            cs = e.get(d["ColorSpace"])
            n = len(e.get(cs[1]))
            try:
                raw = e.body(d)
                samples = np.frombuffer(raw[: len(raw) // n * n], np.uint8).reshape(-1, n) / 255
                e.set_body(d, np.rint(_in_alternate(e, cs, samples) * 255).astype(np.uint8).tobytes())
            except (ValueError, TypeError):
                continue
            d["ColorSpace"] = cs[2]
            d.pop("Decode", None)
    for d in list(e.dicts()):
        page = d.get("Type") == "Page"
        if not page and not (d.is_stream and d.get("Subtype") == "Form"):
            continue
        r = _resources(e, d, page)
        spaces = e.get(r.get("ColorSpace"))
        bad = {k: e.get(v) for k, v in spaces.items() if _too_many(e, v)} if isinstance(spaces, Dict) else {}
        if not bad:
            continue
        c = e.get(d.get("Contents")) if page else d
        try:
            for s in [e.get(x) for x in c] if isinstance(c, list) else [c]:
                if isinstance(s, Dict) and s.is_stream:
                    e.set_body(s, write(_recoloured(e, tokenize_content(e.body(s)), bad)))
        except (ValueError, TypeError):
            continue
        for k in bad:
            spaces.pop(k)
        for k, cs in bad.items():
            if colour.device_model(cs[2], e.get) is None:
                spaces[f"Alternate{k}"] = cs[2]


def _recoloured(e, ops: list, bad: dict[str, list]) -> list:
    """Operators that set a space or a colour of a bad one, in its alternate."""
    out, now, saved = [], {False: None, True: None}, []
    for op, operands in ops:
        stroke = op in ("CS", "SC", "SCN")
        if op == "q":
            saved.append(dict(now))
        elif op == "Q" and saved:
            now = saved.pop()
        if op in ("cs", "CS"):
            now[stroke] = operands[0] if operands and operands[0] in bad else None
            if now[stroke] is None:
                out.append((op, operands))
            elif colour.device_model(bad[now[stroke]][2], e.get) is None:
                out.append((op, [Name(f"Alternate{now[stroke]}")]))
            continue
        if op in ("sc", "scn", "SC", "SCN") and now[stroke] is not None:
            cs = bad[now[stroke]]
            values = [round(float(x), 4) for x in _in_alternate(e, cs, np.array([operands], float))[0]]
            m = colour.device_model(cs[2], e.get)
            paint = _PAINT[m] if m else op.lower()
            out.append((paint.upper() if stroke else paint, values))
            continue
        out.append((op, operands))
    return out


def prune(e) -> None:
    """Dictionaries of resources with too many entries lose those that no content names, as many as are too many."""
    names = usage_of(e).names
    used: dict[int, set[str]] = {}
    for d in list(e.dicts()):
        for category in CATEGORIES:
            if isinstance(sub := e.get(d.get(category)), Dict) and id(d) in names:
                used.setdefault(id(sub), set()).update(n for c, n in names[id(d)] if c == category)
    for d in list(e.dicts()):
        for category in CATEGORIES:
            sub = e.get(d.get(category))
            if isinstance(sub, Dict) and (over := len(sub) - MAX_ENTRIES) > 0:
                for k in [k for k in sub if k not in used.get(id(sub), ())][:over]:
                    sub.pop(k)
