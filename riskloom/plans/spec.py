"""A model as a dictionary of terms, compiled to design columns.

Order of columns: Intercept, main effects, splines, target encodings, frequency encodings,
interactions, expressions, constraints, chosen-level indicators.
"""

from __future__ import annotations

import ast
import difflib
from dataclasses import asdict, dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.errors import ValidationError
from riskloom.operators import encoding as enc
from riskloom.operators import splines as sp
from riskloom.operators.factors import level

#: The keys that each type of term may have.
KEYS = {
    "linear": {"type", "variable", "monotonicity"},
    "categorical": {"type", "variable", "levels"},
    "bs": {"type", "variable", "df", "k", "degree", "monotonicity", "knots", "boundary_knots"},
    "ns": {"type", "variable", "df", "k", "knots", "boundary_knots"},
    "target_encoding": {"type", "variable", "variables", "prior_weight", "n_permutations"},
    "frequency_encoding": {"type", "variable", "variables"},
    "expression": {"type", "expr", "monotonicity"},
}
_GROUPS = ("linear", "categorical", "spline", "target_encoding", "frequency_encoding", "interaction", "expression", "constraint", "levels")


def expression(text: str) -> Column:
    """Arithmetic on columns and numbers: + - * / ** and parentheses; nothing else is accepted."""

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Name):
            return F.col(node.id).cast("double")
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(float(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -walk(node.operand) if isinstance(node.op, ast.USub) else walk(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = walk(node.left), walk(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Div):
                return a / b
            if isinstance(node.op, ast.Pow):
                return F.pow(a, b)
        raise ValidationError(f"cannot use {ast.dump(node)[:60]} in the expression {text!r}")

    try:
        return walk(ast.parse(text.strip(), mode="eval"))
    except SyntaxError as e:
        raise ValidationError(f"cannot read the expression {text!r}") from e


@dataclass
class Term:
    """One term and, after fit(), what it learnt."""

    kind: str
    name: str
    variables: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)
    parts: list[Term] = field(default_factory=list)
    state: dict = field(default_factory=dict)

    @property
    def group(self) -> str:
        if self.kind in ("linear", "expression") and self.options.get("monotonicity"):
            return "constraint"
        if self.kind in ("bs", "ns"):
            return "spline"
        if self.kind == "categorical" and self.options.get("levels"):
            return "levels"
        return self.kind

    @property
    def sign(self) -> int:
        return {"increasing": 1, "decreasing": -1}.get(self.options.get("monotonicity") or "", 0)

    @property
    def is_smooth(self) -> bool:
        return self.kind == "bs" and self.options.get("k") is not None

    def fit(self, df: DataFrame, y: str, exposure: Column | None) -> None:
        """Learn levels, knots or encodings from df."""
        x = self.variables[0] if self.variables else None
        if self.kind == "bs":
            n = self.options.get("k") or self.options.get("df") or 5
            self.state["knots"] = sp.bs_knots(df, F.col(x), n, self.options.get("degree", 3), self.options.get("boundary_knots"), self.options.get("knots"))
            self.state["n"] = len(self.state["knots"]) - self.options.get("degree", 3) - 1
        elif self.kind == "ns":
            n = self.options.get("k") or self.options.get("df") or 4
            self.state["knots"] = sp.ns_knots(df, F.col(x), n, self.options.get("boundary_knots"), self.options.get("knots"))
            self.state["n"] = n
        elif self.kind == "target_encoding":
            stats, prior = enc.target_stats(df, enc.interaction_key(*map(F.col, self.variables)), F.col(y), exposure)
            self.state |= {"prior": prior, "stats": stats}
        elif self.kind == "frequency_encoding":
            stats, largest = enc.frequency_stats(df, enc.interaction_key(*map(F.col, self.variables)))
            self.state |= {"largest": largest, "stats": stats}
        for p in self.parts:
            p.fit(df, y, exposure)

    def columns(self) -> list[tuple[str, Column]]:
        """Names and Columns of the design; encodings are read from the column that prepared() adds."""
        x = self.variables[0] if self.variables else None
        if self.kind == "linear":
            sign = {1: "pos", -1: "neg"}.get(self.sign)
            return [(f"{sign}({x})" if sign else x, F.col(x).cast("double"))]
        if self.kind == "expression":
            name = f"I({self.options['expr']})"
            sign = {1: "pos", -1: "neg"}.get(self.sign)
            return [(f"{sign}({name})" if sign else name, expression(self.options["expr"]))]
        if self.kind == "categorical":
            own = level(F.col(x))
            if self.options.get("levels"):
                return [(f"{x}[{v}]", F.when(own == str(v), 1.0).otherwise(0.0)) for v in self.options["levels"]]
            return [(f"{x}[T.{v}]", F.when(own == v, 1.0).otherwise(0.0)) for v in self.state["levels"][1:]]
        if self.kind == "bs":
            basis = sp.bs_basis(F.col(x), self.state["knots"], self.options.get("degree", 3))[1:]
            sign = {1: "+", -1: "-"}.get(self.sign, "")
            names = sp.smooth_names(x, self.state["n"], sign) if self.is_smooth else sp.bs_names(x, self.state["n"])
            return list(zip(names, basis, strict=True))
        if self.kind == "ns":
            n = self.state["n"]
            return list(zip(sp.ns_names(x, n), sp.ns_basis(F.col(x), self.state["knots"], n - 1), strict=True))
        if self.kind in ("target_encoding", "frequency_encoding"):
            short = "TE" if self.kind == "target_encoding" else "FE"
            return [(f"{short}({':'.join(self.variables)})", F.col(self.encoded))]
        out = []
        for combo in product(*[p.columns() for p in self.parts]):
            value = combo[0][1]
            for _, c in combo[1:]:
                value = value * c
            out.append((":".join(n for n, _ in combo), value))
        return out

    def knots(self) -> dict | None:
        """What a fitted spline term has learnt: its boundary, interior knots, degree and number of functions."""
        if self.kind not in ("bs", "ns") or "knots" not in self.state:
            return None
        degree = self.options.get("degree", 3) if self.kind == "bs" else 3
        outer = degree + 1 if self.kind == "bs" else 1
        all_ = self.state["knots"]
        return {"variable": self.variables[0], "type": self.kind, "degree": degree, "functions": self.state["n"], "boundary": (all_[0], all_[-1]), "interior": all_[outer:-outer]}

    @property
    def encoded(self) -> str:
        return f"_{self.kind}_{'_'.join(self.variables)}"

    def prepared(self, df: DataFrame, training: dict | None) -> DataFrame:
        """df with the column of an encoding; in training target encodings are ordered statistics."""
        for p in self.parts:
            df = p.prepared(df, training)
        if self.encoded in df.columns:
            return df
        if self.kind == "target_encoding":
            key = enc.interaction_key(*map(F.col, self.variables))
            weight = float(self.options.get("prior_weight", 1.0))
            if training:
                orders = enc.permutations(training["row_id"], int(self.options.get("n_permutations", 4)), training["seed"])
                return enc.target_ordered(df, key, F.col(training["y"]), orders, self.state["prior"], weight, training["exposure"], self.encoded)
            return enc.target_apply(df, key, self.state["stats"], self.state["prior"], weight, self.encoded)
        if self.kind == "frequency_encoding":
            return enc.frequency_apply(df, enc.interaction_key(*map(F.col, self.variables)), self.state["stats"], self.state["largest"], self.encoded)
        return df


def _term(name: str, spec: dict) -> Term:
    kind = spec.get("type")
    if kind not in KEYS:
        near = difflib.get_close_matches(str(kind), KEYS, 1)
        raise ValidationError(f"term {name!r} has the unknown type {kind!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    for key in spec:
        if key not in KEYS[kind]:
            near = difflib.get_close_matches(key, KEYS[kind], 1)
            raise ValidationError(f"term {name!r} has the unknown key {key!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
    if spec.get("monotonicity") not in (None, "increasing", "decreasing"):
        raise ValidationError(f"term {name!r}: monotonicity is 'increasing' or 'decreasing'")
    if kind == "expression":
        text = spec.get("expr", name)
        expression(text)
        return Term(kind, name, sorted({n.id for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Name)}), {"expr": text} | {k: v for k, v in spec.items() if k == "monotonicity"})
    variables = list(spec.get("variables") or [spec.get("variable", name)])
    return Term(kind, name, variables, {k: v for k, v in spec.items() if k not in ("type", "variable", "variables")})


def _interaction(spec: dict) -> list[Term]:
    """The terms of one interaction: mains if asked for, and the product or the joint encoding."""
    spec = dict(spec)
    main, te, fe = spec.pop("include_main", False), spec.pop("target_encoding", False), spec.pop("frequency_encoding", False)
    options = {k: spec.pop(k) for k in ("prior_weight", "n_permutations") if k in spec}
    if len(spec) < 2:
        raise ValidationError("an interaction has at least two variables")
    if te and fe:
        raise ValidationError("an interaction is target-encoded or frequency-encoded, not both")
    parts = [_term(n, s) for n, s in spec.items()]
    out = list(parts) if main else []
    names = [p.variables[0] for p in parts]
    if te or fe:
        out.append(Term("target_encoding" if te else "frequency_encoding", ":".join(names), names, options))
    else:
        out.append(Term("interaction", ":".join(names), names, {}, [_term(n, s) for n, s in spec.items()]))
    return out


@dataclass
class ModelSpec:
    """The terms of a model in the order of its design columns."""

    response: str
    terms: list[Term]
    intercept: bool = True

    @classmethod
    def parse(cls, response: str, terms: dict[str, dict], interactions: list[dict] | None = None, intercept: bool = True) -> ModelSpec:
        found = [_term(n, s) for n, s in terms.items()]
        for i in interactions or []:
            for t in _interaction(i):
                if t.kind == "interaction" or all((t.kind, t.variables) != (f.kind, f.variables) for f in found):
                    found.append(t)
        order = {g: k for k, g in enumerate(_GROUPS)}
        order["categorical"] = order["linear"]  # main effects stay in the order they are given
        return cls(response, sorted(found, key=lambda t: order[t.group]), intercept)

    def _fit_levels(self, df: DataFrame) -> None:
        """The sorted levels of all factors, in one pass; each level is a column of the design."""
        parts = [p for t in self.terms for p in (t, *t.parts) if p.kind == "categorical" and not p.options.get("levels")]
        names = sorted({p.variables[0] for p in parts})
        if names:
            found = dict(zip(names, df.agg(*[F.collect_set(level(F.col(x))) for x in names]).first(), strict=True))
            for p in parts:
                p.state["levels"] = sorted(found[p.variables[0]])

    def fit(self, df: DataFrame, exposure: Column | None = None) -> ModelSpec:
        self._fit_levels(df)
        for t in self.terms:
            t.fit(df, self.response, exposure)
        return self

    def columns(self) -> list[tuple[str, Column]]:
        out = [("Intercept", F.lit(1.0))] if self.intercept else []
        for t in self.terms:
            out += t.columns()
        return out

    def names(self) -> list[str]:
        return [n for n, _ in self.columns()]

    def slices(self) -> list[tuple[Term, int, int]]:
        """Each term with the first and last position of its columns."""
        at, out = int(self.intercept), []
        for t in self.terms:
            n = len(t.columns())
            out.append((t, at, at + n))
            at += n
        return out

    def design(self, df: DataFrame, training: dict | None = None) -> DataFrame:
        """df with the design as an array column _x."""
        for t in self.terms:
            df = t.prepared(df, training)
        return df.withColumn("_x", F.array(*[c.cast("double") for _, c in self.columns()]))

    def inputs(self) -> list[str]:
        """The columns that scoring reads."""
        return sorted({v for t in self.terms for v in t.variables})

    def state(self) -> dict:
        """Everything that scoring needs, as plain values; encodings as lists of levels."""

        def plain(t: Term) -> dict:
            out = asdict(Term(t.kind, t.name, t.variables, t.options))
            out["state"] = {k: [list(r) for r in v.collect()] if k == "stats" else v for k, v in t.state.items()}
            out["parts"] = [plain(p) for p in t.parts]
            return out

        return {"response": self.response, "intercept": self.intercept, "terms": [plain(t) for t in self.terms]}

    @classmethod
    def from_state(cls, spark, state: dict) -> ModelSpec:
        def term(d: dict) -> Term:
            own = dict(d["state"])
            if "stats" in own:
                kinds = "level string, total double, size double" if d["kind"] == "target_encoding" else "level string, n long"
                own["stats"] = spark.createDataFrame([tuple(r) for r in own["stats"]], kinds)
            return Term(d["kind"], d["name"], d["variables"], d["options"], [term(p) for p in d["parts"]], own)

        return cls(state["response"], [term(t) for t in state["terms"]], state["intercept"])
