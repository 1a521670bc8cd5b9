"""Mutation specs: a set of constraints compiled to one expression that names every violation of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.patterns import METERS

SPEC = (
    "id string, operation string, target_kinds array<string>, expected_meters array<string>, allowed_side_effect_meters array<string>, "
    "selector struct<extensions array<string>, has_incoming_edge string, has_outgoing_edge string>, "
    "edit struct<path string, new_path string, old string, text string, line_contains string>, "
    "skip_conditions struct<require_env array<string>, require_files array<string>, require_optional_engines array<string>>"
)
# Fixed values.
NODE_KINDS = [
    "file", "directory", "doc", "user_story", "adr", "idr", "rule", "command", "concept", "claim", "metric", "test", "evidence",
    "generated_artifact", "code_symbol", "endpoint", "data_model",
]
EDGE_KINDS = [
    "contains", "mentions", "defines", "suggests", "describes", "verifies", "supports", "generates", "supersedes", "depends_on",
    "implements", "expects", "contradicts", "mirrors", "invalidates",
]
ENGINES = ["callsite_blast_radius", "dead_code"]
PLACEHOLDERS = {"${target_id}": "target", "${target_path}": "target", "${target_label}": "target", "${target_dir}": "target", "${target_base}": "target", "${target_ext}": ".txt"}
#: The field of ``edit`` that an operation needs.
NEEDS = {"replace_text": "old", "append_text": "text", "remove_file": None, "rename_file": "new_path", "add_file": "path", "remove_line_containing": "line_contains", "backdate_head": None}
RESERVED = [".git", ".tessera"]


def inside(path: Column, reserved: list[str] = RESERVED) -> Column:
    """Whether a path stays in the repository and out of the reserved folders."""
    path = F.regexp_replace(path, r"^\s+|\s+$", "")
    clean = P.clean(path)
    return (path != "") & ~path.startswith("/") & ~clean.isin(".", "..") & ~clean.startswith("../") & ~F.element_at(F.split(clean, "/"), 1).isin(reserved)


def _filled(path: Column) -> Column:
    for name, value in PLACEHOLDERS.items():
        path = F.replace(path, F.lit(name), F.lit(value))
    return path


def _each(label: str, values: Column, good) -> Column:
    bad = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: ~F.coalesce(good(x), F.lit(False)))
    return F.transform(bad, lambda x: F.concat(F.lit(label + ":"), F.coalesce(x, F.lit(""))))


def _one(label: str, bad: Column, value: Column | None = None) -> Column:
    text = F.lit(label) if value is None else F.concat(F.lit(label + ":"), F.coalesce(value, F.lit("")))
    return F.when(F.coalesce(bad, F.lit(False)), F.array(text)).otherwise(F.array().cast("array<string>"))


def constraints(reserved: list[str] = RESERVED) -> list[Column]:
    """Arrays of violations, each as a name, with the value it is about after a colon."""
    c = F.col
    given = lambda name: F.coalesce(c(name), F.lit("")) != ""
    kinds = F.coalesce(F.size("target_kinds"), F.lit(0))
    return [
        _one("missing_id", ~given("id")),
        _one("duplicate_id", given("id") & (c("_same") > 1), c("id")),
        _one("operation", ~F.coalesce(c("operation").isin(list(NEEDS)), F.lit(False)), c("operation")),
        _one("no_target_kinds", ~c("operation").eqNullSafe("backdate_head") & (kinds <= 0)),
        _each("target_kind", c("target_kinds"), lambda x: x.isin(NODE_KINDS)),
        _each("expected_meter", c("expected_meters"), lambda x: x.isin(METERS)),
        _each("allowed_meter", c("allowed_side_effect_meters"), lambda x: x.isin(METERS)),
        *[_one(f"{way}_edge", given(f"selector.has_{way}_edge") & ~c(f"selector.has_{way}_edge").isin(EDGE_KINDS), c(f"selector.has_{way}_edge")) for way in ("incoming", "outgoing")],
        _each("extension", c("selector.extensions"), lambda x: x.startswith(".")),
        _each("env", c("skip_conditions.require_env"), lambda x: F.regexp_replace(x, r"\s", "") != ""),
        _each("required_file", c("skip_conditions.require_files"), lambda x: inside(x, reserved)),
        _each("engine", c("skip_conditions.require_optional_engines"), lambda x: x.isin(ENGINES)),
        *[_one(f"edit_{name}", given(f"edit.{name}") & ~inside(_filled(c(f"edit.{name}")), reserved), c(f"edit.{name}")) for name in ("path", "new_path")],
        *[_one(f"no_edit_{name}", (c("operation") == operation) & ~given(f"edit.{name}")) for operation, name in NEEDS.items() if name],
    ]


def violations(specs: DataFrame, reserved: list[str] = RESERVED) -> DataFrame:
    """The specs with an array of all their violations, in the order of the constraints; empty: valid."""
    same = F.count(F.lit(1)).over(Window.partitionBy("id"))
    return specs.withColumn("_same", same).withColumn("violations", F.concat(*constraints(reserved))).drop("_same")


def valid(specs: DataFrame) -> DataFrame:
    """The specs, or an error that names the first few invalid ones."""
    wrong = violations(specs).where(F.size("violations") > 0).select("id", "violations").limit(10).collect()
    if wrong:
        raise ValueError("; ".join(f"{r['id'] or 'a spec'}: {', '.join(r['violations'])}" for r in wrong))
    return specs
