"""Functions that files carry (sampled, exponential, stitching, calculator), over arrays of many inputs at once."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np

#: From a matrix of inputs, a row each, to one of outputs.
Function = Callable[[np.ndarray], np.ndarray]
#: Stitched functions within functions; nested procedures; values on a calculator's stack.
MAX_DEPTH, MAX_STACK = 16, 100


def _pairs(v: object, get) -> np.ndarray | None:
    v = get(v)
    if not isinstance(v, list) or len(v) % 2:
        return None
    return np.array([float(get(x)) for x in v]).reshape(-1, 2)


def _scale(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From the ranges a to the ranges b; a range of no width gives the start."""
    width = a[:, 1] - a[:, 0]
    share = np.divide(x - a[:, 0], width, out=np.zeros_like(x), where=width != 0)
    return b[:, 0] + share * (b[:, 1] - b[:, 0])


def parse_function(f: object, get=lambda x: x, decoded=lambda s: s.raw or b"", depth: int = 0) -> Function:
    """The function of a dictionary or a stream; an array of functions gives their outputs together. What can't be
    read is a ValueError. Inputs are kept in the domain and outputs in the range, where one is stated."""
    f = get(f)
    if depth > MAX_DEPTH:
        raise ValueError("functions too deep")
    if isinstance(f, list):
        parts = [parse_function(x, get, decoded, depth + 1) for x in f]
        return lambda x: np.hstack([p(x) for p in parts])
    if not isinstance(f, dict):
        raise ValueError("no function")
    domain, out_range, kind = _pairs(f.get("Domain"), get), _pairs(f.get("Range"), get), get(f.get("FunctionType"))
    if domain is None:
        raise ValueError("a function without a domain")
    if kind == 0:
        inner = _sampled(f, domain, out_range, get, decoded)
    elif kind == 2:
        c0, c1, n = (np.array([float(get(x)) for x in get(f.get(k)) or d]) if k != "N" else float(get(f.get(k, 1))) for k, d in (("C0", [0]), ("C1", [1]), ("N", None)))
        inner = lambda x: c0 + np.power(x[:, :1], n) * (c1 - c0)
    elif kind == 3:
        inner = _stitching(f, domain, get, decoded, depth)
    elif kind == 4:
        inner = _calculator(decoded(f), len(domain), out_range)
    else:
        raise ValueError(f"no function of type {kind}")

    def run(x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        if x.shape[1] != len(domain):
            raise ValueError("a wrong number of inputs")
        y = inner(np.clip(x, domain[:, 0], domain[:, 1]))
        return np.clip(y, out_range[:, 0], out_range[:, 1]) if out_range is not None else y

    return run


def _sampled(f: dict, domain: np.ndarray, out_range: np.ndarray | None, get, decoded) -> Function:
    """Linear between the samples of a grid in all dimensions."""
    size, bits = [int(get(x)) for x in get(f.get("Size")) or []], get(f.get("BitsPerSample"))
    if out_range is None or len(size) != len(domain) or bits not in (1, 2, 4, 8, 12, 16, 24, 32) or min(size, default=0) < 1 or len(size) > 8:
        raise ValueError("a damaged table of samples")
    outputs, total = len(out_range), math.prod(size)
    encode = e if (e := _pairs(f.get("Encode"), get)) is not None else np.array([[0, s - 1] for s in size], float)
    decode = d if (d := _pairs(f.get("Decode"), get)) is not None else out_range
    raw, need = decoded(f), total * outputs * bits
    raw = raw[: (need + 7) // 8].ljust((need + 7) // 8, b"\0")
    if bits in (8, 16, 32):
        table = np.frombuffer(raw, f">u{bits // 8}")[: total * outputs].astype(float)
    else:
        table = np.unpackbits(np.frombuffer(raw, np.uint8))[:need].reshape(-1, bits) @ (2.0 ** np.arange(bits - 1, -1, -1))
    table = table.reshape(total, outputs)  # the first input varies fastest
    stride, most = np.cumprod([1, *size[:-1]]), np.array(size) - 1
    full = np.tile([0.0, 2.0**bits - 1], (outputs, 1))

    def run(x: np.ndarray) -> np.ndarray:
        e = np.clip(_scale(x, domain, encode), 0, most)
        low = np.floor(e).astype(int)
        part = e - low
        out = np.zeros((len(x), outputs))
        for corner in range(1 << len(size)):
            up = np.array([corner >> i & 1 for i in range(len(size))])
            weight = np.prod(np.where(up, part, 1 - part), axis=1)
            out += weight[:, None] * table[np.minimum(low + up, most) @ stride]
        return _scale(out, full, decode)

    return run


def _stitching(f: dict, domain: np.ndarray, get, decoded, depth: int) -> Function:
    parts = [parse_function(x, get, decoded, depth + 1) for x in get(f.get("Functions")) or []]
    bounds, encode = [float(get(x)) for x in get(f.get("Bounds")) or []], _pairs(f.get("Encode"), get)
    if not parts or len(bounds) != len(parts) - 1 or encode is None or len(encode) < len(parts):
        raise ValueError("a damaged list of functions")
    edges = np.array([domain[0, 0], *bounds, domain[0, 1]])

    def run(x: np.ndarray) -> np.ndarray:
        which = np.searchsorted(bounds, x[:, 0], "right")
        out = None
        for k, part in enumerate(parts):
            at = np.flatnonzero(which == k)
            if len(at):
                y = part(_scale(x[at], edges[None, k : k + 2], encode[None, k]))
                out = np.zeros((len(x), y.shape[1])) if out is None else out
                out[at] = y
        return np.zeros((len(x), 1)) if out is None else out

    return run


def _program(tokens: list[str], depth: int = 0) -> list:
    """A procedure's items up to its brace; tokens is consumed from its end."""
    if depth > MAX_DEPTH:
        raise ValueError("procedures too deep")
    out: list = []
    while tokens:
        t = tokens.pop()
        if t == "}":
            return out
        out.append(_program(tokens, depth + 1) if t == "{" else t)
    raise ValueError("a procedure without its end")


_TWO = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b if b else 0.0, "exp": lambda a, b: a**b if a > 0 or b == int(b) and (a or b > 0) else 0.0,
    "idiv": lambda a, b: math.trunc(a / b) if b else 0, "mod": lambda a, b: math.fmod(a, b) if b else 0, "atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360,
    "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b,
    "bitshift": lambda a, b: int(a) << int(b) if b >= 0 else int(a) >> int(-b),
}
_LOGIC = {"and": (lambda a, b: a & b), "or": (lambda a, b: a | b), "xor": (lambda a, b: a ^ b)}
_ONE = {
    "abs": abs, "neg": lambda a: -a, "ceiling": math.ceil, "floor": math.floor, "round": lambda a: math.floor(a + 0.5), "truncate": math.trunc, "cvi": math.trunc, "cvr": float, "sqrt": lambda a: math.sqrt(max(a, 0)),
    "sin": lambda a: math.sin(math.radians(a)), "cos": lambda a: math.cos(math.radians(a)), "ln": lambda a: math.log(a) if a > 0 else 0.0, "log": lambda a: math.log10(a) if a > 0 else 0.0,
    "not": lambda a: not a if isinstance(a, bool) else ~int(a),
}


def execute(program: list, stack: list) -> None:
    """Runs a procedure on a stack; too few operands, or a word that isn't known, is a ValueError."""
    try:
        k = 0
        while k < len(program):
            t = program[k]
            k += 1
            if len(stack) > MAX_STACK:
                raise ValueError("too many values")
            if isinstance(t, list):
                more = program[k] if k < len(program) else None
                if more == "if":
                    k += 1
                    if stack.pop():
                        execute(t, stack)
                elif isinstance(more, list) and program[k + 1 : k + 2] == ["ifelse"]:
                    k += 2
                    execute(t if stack.pop() else more, stack)
                else:
                    raise ValueError("a procedure without a condition")
            elif t in _TWO or t in _LOGIC:
                b, a = stack.pop(), stack.pop()
                if t in _LOGIC and not (isinstance(a, bool) and isinstance(b, bool)):
                    a, b = int(a), int(b)
                stack.append((_TWO.get(t) or _LOGIC[t])(a, b))
            elif t in _ONE:
                stack.append(_ONE[t](stack.pop()))
            elif t in ("true", "false"):
                stack.append(t == "true")
            elif t == "pop":
                stack.pop()
            elif t == "dup":
                stack.append(stack[-1])
            elif t == "exch":
                stack[-2:] = [stack[-1], stack[-2]]
            elif t == "copy":
                n = int(stack.pop())
                if not 0 <= n <= len(stack):
                    raise ValueError("too few values")
                stack += stack[len(stack) - n :]
            elif t == "index":
                n = int(stack.pop())
                if not 0 <= n < len(stack):
                    raise ValueError("too few values")
                stack.append(stack[-1 - n])
            elif t == "roll":
                j, n = int(stack.pop()), int(stack.pop())
                if not 0 <= n <= len(stack):
                    raise ValueError("too few values")
                if n:
                    part = stack[-n:]
                    stack[-n:] = part[-(j % n) :] + part[: n - j % n] if j % n else part
            else:
                stack.append(float(t) if re.search(r"[.eE]", t) else int(t))
    except (IndexError, OverflowError) as x:
        raise ValueError(str(x)) from None


def _calculator(code: bytes, inputs: int, out_range: np.ndarray | None) -> Function:
    text = re.sub(r"%[^\r\n]*", " ", code.decode("latin-1"))
    tokens = re.findall(r"[{}]|[^\s{}]+", text)[::-1]
    if out_range is None or not tokens or tokens.pop() != "{":
        raise ValueError("a damaged calculator")
    program, outputs = _program(tokens), len(out_range)

    def run(x: np.ndarray) -> np.ndarray:
        # equal inputs are calculated once
        rows, back = np.unique(x, axis=0, return_inverse=True)
        out = np.zeros((len(rows), outputs))
        for i, row in enumerate(rows.tolist()):
            stack: list = [*row]
            try:
                execute(program, stack)
                out[i] = [float(v) for v in stack[-outputs:]] if len(stack) >= outputs else 0.0
            except ValueError:
                pass  # stays 0, which the range then bounds
        return out[back.reshape(-1)]

    return run
