"""What the content of a file's pages uses: codes of fonts, forms, and which fonts are ever visible.

Pages, forms and appearances are replayed once a file, with the states that q and Q save. Fonts and forms are known by
the identity of their dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from folioscan.sources.pdf_bytes import Dict, Document, Hex, Name

#: Forms within forms.
MAX_FORMS = 24


@dataclass
class Usage:
    """codes by font, CIDs by descendant font (None where the map of codes isn't the identity); the visible fonts; the
    forms that a page or an appearance reaches; the resources that any content names, by category."""

    codes: dict[int, set[int]] = field(default_factory=dict)
    cids: dict[int, set[int] | None] = field(default_factory=dict)
    visible: set[int] = field(default_factory=set)
    forms: set[int] = field(default_factory=set)
    names: dict[int, set[tuple[str, str]]] = field(default_factory=dict)

    def invisible_only(self, font: Dict) -> bool:
        k = id(font)
        return (k in self.codes or k in self.cids) and k not in self.visible


def page_dicts(d: Document) -> Iterator[tuple[Dict, Dict]]:
    """Each page with the resources it has or inherits, in order."""
    seen, todo = set(), [(d.path("Root", "Pages"), Dict())]
    while todo:
        v, inherited = todo.pop()
        v = d.resolve(v)
        if not isinstance(v, Dict) or id(v) in seen:
            continue
        seen.add(id(v))
        r = d.resolve(v.get("Resources"))
        r = r if isinstance(r, Dict) else inherited
        if v.get("Type") == "Page":
            yield v, r
        kids = d.resolve(v.get("Kids"))
        todo += [(k, r) for k in (reversed(kids) if isinstance(kids, list) else ())]


def shown_bytes(op: str, operands: list) -> bytes:
    """The bytes of an operator that shows text."""
    if op == "TJ":
        items = operands[0] if operands and isinstance(operands[0], list) else []
    else:
        items = operands[-1:]
    return b"".join(x.value if isinstance(x, Hex) else bytes(x) for x in items if isinstance(x, bytes))


def appearances(d: Document, page: Dict) -> Iterator[Dict]:
    """The normal appearance streams of a page's annotations."""
    annots = d.resolve(page.get("Annots"))
    for a in annots if isinstance(annots, list) else []:
        a = d.resolve(a)
        ap = d.resolve(a.get("AP")) if isinstance(a, Dict) else None
        n = d.resolve(ap.get("N")) if isinstance(ap, Dict) else None
        if isinstance(n, Dict):
            for s in [n] if n.is_stream else [d.resolve(x) for x in n.values()]:
                if isinstance(s, Dict) and s.is_stream:
                    yield s


def content_usage(d: Document, ops_of: Callable[[Dict], list]) -> Usage:
    """The usage of all pages; ops_of gives the operators of a stream."""
    out = Usage()

    def resource(resources: Dict, category: str, name: object) -> object:
        group = d.resolve(resources.get(category))
        if isinstance(group, Dict) and isinstance(name, str):
            out.names.setdefault(id(resources), set()).add((category, str(name)))
            return d.resolve(group.get(name))
        return None

    def show(font: object, raw: bytes, visible: bool) -> None:
        if not isinstance(font, Dict):
            return
        if font.get("Subtype") == "Type0":
            kids = d.resolve(font.get("DescendantFonts"))
            child = d.resolve(kids[0]) if isinstance(kids, list) and kids else None
            if isinstance(child, Dict):
                if d.resolve(font.get("Encoding")) in ("Identity-H", "Identity-V"):
                    if (held := out.cids.setdefault(id(child), set())) is not None:
                        held.update(int.from_bytes(raw[k : k + 2], "big") for k in range(0, len(raw) - 1, 2))
                else:
                    out.cids[id(child)] = None
                if visible:
                    out.visible.add(id(child))
        out.codes.setdefault(id(font), set()).update(raw)
        if visible:
            out.visible.add(id(font))

    def replay(streams: list[Dict], resources: Dict, inside: tuple[int, ...], start: tuple[object, int]) -> None:
        state, saved = start, []
        for s in streams:
            for op, operands in ops_of(s):
                if op == "q":
                    saved.append(state)
                elif op == "Q":
                    state = saved.pop() if saved else state
                elif op == "Tf" and operands:
                    state = (resource(resources, "Font", operands[0]), state[1])
                elif op == "Tr" and operands and isinstance(operands[0], int):
                    state = (state[0], operands[0])
                elif op in ("Tj", "TJ", "'", '"'):
                    show(state[0], shown_bytes(op, operands), state[1] != 3)
                elif op == "gs" and operands:
                    g = resource(resources, "ExtGState", operands[0])
                    f = d.resolve(g.get("Font")) if isinstance(g, Dict) else None
                    if isinstance(f, list) and f:
                        state = (d.resolve(f[0]), state[1])
                elif op in ("cs", "CS", "sh") and operands:
                    resource(resources, "Shading" if op == "sh" else "ColorSpace", operands[0])
                elif op in ("scn", "SCN") and operands and isinstance(operands[-1], Name):
                    resource(resources, "Pattern", operands[-1])
                elif op in ("BDC", "DP") and len(operands) > 1:
                    resource(resources, "Properties", operands[1])
                elif op == "Do" and operands:
                    x = resource(resources, "XObject", operands[0])
                    if isinstance(x, Dict) and x.get("Subtype") == "Form" and id(x) not in inside and len(inside) < MAX_FORMS:
                        out.forms.add(id(x))
                        own = d.resolve(x.get("Resources"))
                        replay([x], own if isinstance(own, Dict) else resources, (*inside, id(x)), state)

    for page, resources in page_dicts(d):
        c = d.resolve(page.get("Contents"))
        streams = [c] if isinstance(c, Dict) else [d.resolve(x) for x in c] if isinstance(c, list) else []
        replay([s for s in streams if isinstance(s, Dict) and s.is_stream], resources, (), (None, 0))
        for s in appearances(d, page):
            out.forms.add(id(s))
            own = d.resolve(s.get("Resources"))
            replay([s], own if isinstance(own, Dict) else Dict(), (id(s),), (None, 0))
    return out
