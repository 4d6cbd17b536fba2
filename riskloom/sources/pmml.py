"""A fitted model as a PMML 4.4 GeneralRegressionModel."""

from __future__ import annotations

import ast
from xml.etree import ElementTree as ET

import numpy as np

from riskloom.errors import SerializationError
from riskloom.operators import splines as sp

NAMESPACE = "http://www.dmg.org/PMML-4_4"
#: Points of the piecewise-linear copy of a spline.
POINTS = 200
_DISTRIBUTION = {"gaussian": "normal", "poisson": "poisson", "quasipoisson": "poisson", "binomial": "binomial", "quasibinomial": "binomial", "gamma": "gamma", "negbinomial": "negbin", "tweedie": "tweedie"}
_FUNCTIONS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "pow"}


def _field(name: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in name)


def spline_values(term, x: np.ndarray) -> np.ndarray:
    """The basis columns of a spline term at x."""
    if term.kind == "bs":
        return sp.bs_basis_np(x, term.state["knots"], term.options.get("degree", 3))[:, 1:]
    return sp.ns_basis_np(x, term.state["knots"], term.state["n"] - 1)


def _apply(node: ast.AST) -> ET.Element:
    if isinstance(node, ast.Name):
        return ET.Element("FieldRef", field=node.id)
    if isinstance(node, ast.Constant):
        out = ET.Element("Constant", dataType="double")
        out.text = repr(float(node.value))
        return out
    if isinstance(node, ast.UnaryOp):
        out = ET.Element("Apply", function="-")
        zero = ET.SubElement(out, "Constant", dataType="double")
        zero.text = "0.0"
        out.append(_apply(node.operand))
        return out if isinstance(node.op, ast.USub) else _apply(node.operand)
    out = ET.Element("Apply", function=_FUNCTIONS[type(node.op)])
    out.extend([_apply(node.left), _apply(node.right)])
    return out


def to_pmml(model) -> str:
    """The XML text; predictors of interactions share a parameter in the PPMatrix."""
    root = ET.Element("PMML", version="4.4", xmlns=NAMESPACE)
    ET.SubElement(root, "Header", description="generalized linear model")
    data = ET.SubElement(root, "DataDictionary")
    derived = ET.SubElement(root, "TransformationDictionary")
    glm = ET.SubElement(
        root, "GeneralRegressionModel", functionName="regression", modelType="generalizedLinear", targetVariableName=model.spec.response,
        distribution=_DISTRIBUTION[model.family.name], linkFunction=model.link.name,
    )
    if model.family.name == "negbinomial":
        glm.set("distParameter", repr(float(model.family.parameter)))
    if model.offset:
        glm.set("offsetVariable", f"log_{_field(model.offset)}" if model.is_exposure else model.offset)
    mining = ET.SubElement(glm, "MiningSchema")
    parameters, factors = ET.SubElement(glm, "ParameterList"), ET.Element("FactorList")
    covariates, pairs, values = ET.Element("CovariateList"), ET.Element("PPMatrix"), ET.Element("ParamMatrix")
    fields: dict[str, str] = {}
    made: set[str] = set()
    listed: set[str] = set()

    def need(name: str, kind: str) -> None:
        fields.setdefault(name, kind)

    def predictor(name: str, parameter: str, value: str, factor: bool = False) -> None:
        if name not in listed:
            listed.add(name)
            ET.SubElement(factors if factor else covariates, "Predictor", name=name)
        ET.SubElement(pairs, "PPCell", value=value, predictorName=name, parameterName=parameter)

    def transform(name: str, body: ET.Element) -> None:
        if name not in made:
            made.add(name)
            ET.SubElement(derived, "DerivedField", name=name, optype="continuous", dataType="double").append(body)

    def column(term, k: int, parameter: str) -> None:
        """The predictors of a term's k-th column."""
        x = term.variables[0] if term.variables else ""
        if term.kind == "linear":
            need(x, "double")
            predictor(x, parameter, "1")
        elif term.kind == "categorical":
            need(x, "string")
            levels = term.options.get("levels") or term.state["levels"][1:]
            predictor(x, parameter, str(levels[k]), factor=True)
        elif term.kind in ("bs", "ns"):
            need(x, "double")
            low, high = term.state["knots"][0], term.state["knots"][-1]
            grid = np.linspace(low, high, POINTS)
            name = f"{_field(x)}_{term.kind}_{k + 1}"
            # outside its range a B-spline is 0 and a natural spline goes on in a line, on which two of its points lie
            body = ET.Element("NormContinuous", field=x, outliers="asMissingValues", mapMissingTo="0") if term.kind == "bs" else ET.Element("NormContinuous", field=x, outliers="asIs")
            if term.kind == "ns":
                grid = np.concatenate([[2 * low - high], np.linspace(low, high, POINTS - 2), [2 * high - low]])
            for a, b in zip(grid, spline_values(term, grid)[:, k], strict=True):
                ET.SubElement(body, "LinearNorm", orig=repr(float(a)), norm=repr(float(b)))
            transform(name, body)
            predictor(name, parameter, "1")
        elif term.kind in ("target_encoding", "frequency_encoding"):
            if len(term.variables) != 1:
                raise SerializationError("PMML has no encoding of several factors together")
            need(x, "string")
            te = term.kind == "target_encoding"
            w, prior = float(term.options.get("prior_weight", 1.0)), term.state.get("prior", 0.0)
            body = ET.Element("MapValues", outputColumn="value", dataType="double", defaultValue=repr(float(prior) if te else 0.0))
            ET.SubElement(body, "FieldColumnPair", field=x, column="level")
            rows = ET.SubElement(body, "InlineTable")
            for r in term.state["stats"].orderBy("level").collect():
                row = ET.SubElement(rows, "row")
                ET.SubElement(row, "level").text = r["level"]
                ET.SubElement(row, "value").text = repr((r["total"] + prior * w) / (r["size"] + w) if te else r["n"] / term.state["largest"])
            name = f"{_field(x)}_{'te' if te else 'fe'}"
            transform(name, body)
            predictor(name, parameter, "1")
        elif term.kind == "expression":
            for v in term.variables:
                need(v, "double")
            name = f"expr_{_field(term.options['expr'])}"
            transform(name, _apply(ast.parse(term.options["expr"].strip(), mode="eval").body))
            predictor(name, parameter, "1")
        else:
            sizes = [len(p.columns()) for p in term.parts]
            for p, i in zip(term.parts, np.unravel_index(k, sizes), strict=True):
                column(p, int(i), parameter)

    at = 0
    for term, first, last in [(None, 0, int(model.spec.intercept)), *model.spec.slices()]:
        for k in range(first, last):
            parameter = f"p{at}"
            ET.SubElement(parameters, "Parameter", name=parameter, label=model.names[at])
            ET.SubElement(values, "PCell", parameterName=parameter, beta=repr(float(model.fit.beta[at])), df="1")
            if term is not None:
                column(term, k - first, parameter)
            at += 1
    if model.offset:
        need(model.offset, "double")
        if model.is_exposure:
            body = ET.Element("Apply", function="ln")
            ET.SubElement(body, "FieldRef", field=model.offset)
            transform(f"log_{_field(model.offset)}", body)
    for name, kind in [(model.spec.response, "double"), *fields.items()]:
        ET.SubElement(data, "DataField", name=name, optype="categorical" if kind == "string" else "continuous", dataType=kind)
        ET.SubElement(mining, "MiningField", name=name, usageType="target" if name == model.spec.response else "active")
    data.set("numberOfFields", str(len(fields) + 1))
    for part in (factors, covariates, pairs, values):
        glm.append(part)
    ET.indent(root)
    return ET.tostring(root, encoding="unicode", xml_declaration=True)
