"""A fitted model as an ONNX graph, written as protocol buffers without a library."""

from __future__ import annotations

import ast
import struct
from itertools import product

import numpy as np

from riskloom.errors import SerializationError
from riskloom.sources.pmml import POINTS, spline_values

# fixed values: field numbers and type codes of the ONNX format
_FLOAT, _INT64, _IR, _OPSET = 1, 7, 8, 13


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(tag: int, n: int) -> bytes:
    return _varint(tag << 3) + _varint(n)


def _bytes(tag: int, data: bytes | str) -> bytes:
    data = data.encode() if isinstance(data, str) else data
    return _varint(tag << 3 | 2) + _varint(len(data)) + data


def _tensor(name: str, values: np.ndarray) -> bytes:
    kind, dtype = (_INT64, "<i8") if values.dtype.kind == "i" else (_FLOAT, "<f4")
    dims = b"".join(_number(1, d) for d in values.shape)
    return dims + _number(2, kind) + _bytes(8, name) + _bytes(9, values.astype(dtype).tobytes())


def _value(name: str, kind: int, shape: tuple) -> bytes:
    dims = b"".join(_bytes(1, _number(1, d) if isinstance(d, int) else _bytes(2, d)) for d in shape)
    return _bytes(1, name) + _bytes(2, _bytes(1, _number(1, kind) + _bytes(2, dims)))


class Graph:
    """Nodes, constants, inputs and outputs."""

    def __init__(self, name: str):
        self.name, self.nodes, self.constants = name, [], []
        self.inputs, self.outputs, self.count = [], [], 0

    def node(self, op: str, *inputs: str, out: str | None = None, **attributes: int | float) -> str:
        self.count += 1
        out = out or f"t{self.count}"
        body = b"".join(_bytes(1, i) for i in inputs) + _bytes(2, out) + _bytes(3, f"n{self.count}") + _bytes(4, op)
        for key, v in attributes.items():
            value = _number(3, v) + _number(20, 2) if isinstance(v, int) else _varint(2 << 3 | 5) + struct.pack("<f", v) + _number(20, 1)
            body += _bytes(5, _bytes(1, key) + value)
        self.nodes.append(body)
        return out

    def constant(self, values: np.ndarray | float) -> str:
        self.count += 1
        name = f"c{self.count}"
        array = np.asarray(values)
        self.constants.append(_tensor(name, array.astype(np.int64) if array.dtype.kind == "i" else array.astype(np.float32)))
        return name

    def input(self, name: str, kind: int, shape: tuple) -> str:
        self.inputs.append(_value(name, kind, shape))
        return name

    def model(self) -> bytes:
        graph = b"".join(_bytes(1, n) for n in self.nodes) + _bytes(2, self.name) + b"".join(_bytes(5, c) for c in self.constants)
        graph += b"".join(_bytes(11, i) for i in self.inputs) + b"".join(_bytes(12, o) for o in self.outputs)
        return _number(1, _IR) + _bytes(2, "riskloom") + _bytes(7, graph) + _bytes(8, _bytes(1, "") + _number(2, _OPSET))


def _finish(g: Graph, model, eta: str) -> bytes:
    """The inverse link, and the output named prediction."""
    op = {"identity": "Identity", "log": "Exp", "logit": "Sigmoid", "inverse": "Reciprocal"}[model.link.name]
    g.node(op, eta, out="prediction")
    g.outputs.append(_value("prediction", _FLOAT, ("n", 1)))
    return g.model()


def scoring_graph(model) -> bytes:
    """From the design X (without its intercept) to the prediction."""
    first = int(model.spec.intercept)
    g = Graph("scoring")
    x = g.input("X", _FLOAT, ("n", len(model.names) - first))
    eta = g.node("MatMul", x, g.constant(model.fit.beta[first:].reshape(-1, 1)))
    if first:
        eta = g.node("Add", eta, g.constant(np.array([model.fit.beta[0]])))
    return _finish(g, model, eta)


def full_graph(model, points: int = POINTS) -> tuple[bytes, dict[str, list[str]]]:
    """(graph over raw inputs, the levels that each factor's integer codes number).

    Numbers are float inputs and factors int64 codes, each of shape (n, 1); a code past the last
    level stands for any other. A term that has no such form raises, as nothing may be left out.
    """
    g = Graph("full")
    eta = g.constant(np.array([[model.fit.beta[0] if model.spec.intercept else 0.0]]))
    levels: dict[str, list[str]] = {}
    made: dict[str, str] = {}
    parts: list[str] = []

    def raw(name: str, kind: int) -> str:
        if name not in made:
            made[name] = g.input(name, kind, ("n", 1))
        return made[name]

    def spline(term, of) -> str:
        """A spline as lines between points: of() makes one number of each point's basis."""
        at = raw(term.variables[0], _FLOAT)
        low, high = term.state["knots"][0], term.state["knots"][-1]
        values = of(spline_values(term, np.linspace(low, high, points)))
        beyond = of(spline_values(term, np.array([2 * low - high, 2 * high - low])))
        at = g.node("Div", g.node("Sub", at, g.constant(np.array([low]))), g.constant(np.array([(high - low) / (points - 1)])))
        inside = g.node("Min", g.node("Max", at, g.constant(np.array([0.0]))), g.constant(np.array([float(points - 1)])))
        floor = g.node("Min", g.node("Floor", inside), g.constant(np.array([float(points - 2)])))
        index = g.node("Cast", floor, to=_INT64)
        left = g.node("Gather", g.constant(values[:-1]), index)
        slope = g.node("Gather", g.constant(np.diff(values)), index)
        part = g.node("Add", left, g.node("Mul", slope, g.node("Sub", inside, floor)))
        # outside its range a B-spline is 0 and a natural spline goes on in a line
        zero, last = g.constant(np.array([0.0])), g.constant(np.array([float(points - 1)]))
        under, over = g.node("Less", at, zero), g.node("Less", last, at)
        if term.kind == "bs":
            ends = [zero, zero]
        else:
            line = lambda near, far, from_: g.node("Add", g.constant(np.array([near])), g.node("Mul", g.constant(np.array([(far - near) / (points - 1)])), from_))
            ends = [line(values[0], beyond[0], g.node("Sub", zero, at)), line(values[-1], beyond[1], g.node("Sub", at, last))]
        return g.node("Where", under, ends[0], g.node("Where", over, ends[1], part))

    def formula(node: ast.AST) -> str:
        if isinstance(node, ast.Name):
            return raw(node.id, _FLOAT)
        if isinstance(node, ast.Constant):
            return g.constant(np.array([float(node.value)]))
        if isinstance(node, ast.UnaryOp):
            inner = formula(node.operand)
            return g.node("Neg", inner) if isinstance(node.op, ast.USub) else inner
        return g.node({ast.Add: "Add", ast.Sub: "Sub", ast.Mult: "Mul", ast.Div: "Div", ast.Pow: "Pow"}[type(node.op)], formula(node.left), formula(node.right))

    def columns(term) -> list[str]:
        """A node for each design column of a term."""
        x = term.variables[0] if term.variables else ""
        if term.kind == "linear":
            return [raw(x, _FLOAT)]
        if term.kind == "expression":
            return [formula(ast.parse(term.options["expr"].strip(), mode="eval").body)]
        if term.kind == "categorical":
            chosen = term.options.get("levels")
            own = [str(v) for v in chosen] if chosen else term.state["levels"]
            if levels.setdefault(x, own) != own:
                raise SerializationError(f"{x!r} is coded in two ways")
            return [g.node("Cast", g.node("Equal", raw(x, _INT64), g.constant(np.array([k]))), to=_FLOAT) for k in range(0 if chosen else 1, len(own))]
        if term.kind in ("bs", "ns"):
            n = len(term.columns())
            return [spline(term, lambda v, k=k: v[:, k]) for k in range(n)]
        if term.kind == "interaction":
            out = []
            for combo in product(*[columns(p) for p in term.parts]):
                node = combo[0]
                for other in combo[1:]:
                    node = g.node("Mul", node, other)
                out.append(node)
            return out
        raise SerializationError(f"the term {term.name!r} has no ONNX form here")

    for term, a, b in model.spec.slices():
        beta, x = model.fit.beta[a:b], term.variables[0] if term.variables else ""
        if term.kind == "linear":
            parts.append(g.node("Mul", raw(x, _FLOAT), g.constant(np.array([beta[0]]))))
        elif term.kind == "categorical":
            own = [str(v) for v in term.options["levels"]] if term.options.get("levels") else term.state["levels"]
            values = beta if term.options.get("levels") else np.concatenate([[0.0], beta])
            if levels.setdefault(x, own) != own:
                raise SerializationError(f"{x!r} is coded in two ways")
            parts.append(g.node("Gather", g.constant(np.append(values, 0.0)), _code(g, raw(x, _INT64), len(own))))
        elif term.kind in ("bs", "ns"):
            parts.append(spline(term, lambda v: v @ beta))
        elif term.kind in ("target_encoding", "frequency_encoding") and len(term.variables) == 1:
            te = term.kind == "target_encoding"
            rows = term.state["stats"].orderBy("level").collect()
            w, prior = float(term.options.get("prior_weight", 1.0)), term.state.get("prior", 0.0)
            own = [r["level"] for r in rows]
            if levels.setdefault(x, own) != own:
                raise SerializationError(f"{x!r} is coded in two ways")
            values = [(r["total"] + prior * w) / (r["size"] + w) if te else r["n"] / term.state["largest"] for r in rows] + [prior if te else 0.0]
            parts.append(g.node("Gather", g.constant(np.array(values) * beta[0]), _code(g, raw(x, _INT64), len(own))))
        else:
            for node, v in zip(columns(term), beta, strict=True):
                parts.append(g.node("Mul", node, g.constant(np.array([v]))))
    if model.offset:
        o = raw(model.offset, _FLOAT)
        parts.append(g.node("Log", o) if model.is_exposure else o)
    for p in parts:
        eta = g.node("Add", eta, p)
    return _finish(g, model, eta), levels


def _code(g: Graph, code: str, n: int) -> str:
    """Codes below 0 or past the last level become n."""
    known = g.node("And", g.node("Less", code, g.constant(np.array([n]))), g.node("Greater", code, g.constant(np.array([-1]))))
    return g.node("Where", known, code, g.constant(np.array([n])))
