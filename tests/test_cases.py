"""Cases of one plan against single runs, and cycles against a plain simulation."""

from pyspark.sql import functions as F

from tessera.operators import cases
from tessera.operators import evaluation as E
from tessera.operators import meters as M
from tessera.operators import rules as R
from tessera.operators import snapshot as S

FILES = {"docs/a.md": "# A\ntext one\n", "docs/b.md": "# B\n- must x\n", "web/a.ts": "const a = 1\n// note\n", "web/b.ts": "x\ny keep\nz drop\n", "data/x.json": "{}"}
RULES = [
    {"id": "r1", "when": ["web/*.ts"], "expect_any": ["docs/*.md"], "severity": "error", "message": "m", "suggested_commands": []},
    {"id": "r2", "when": ["**/*.json", "docs/a.md"], "expect_any": ["none"], "severity": "warn", "message": "m", "suggested_commands": []},
]
CASES = [
    ("replace", "replace_text", "docs/a.md", {"old": "# A", "new": "# Z"}), ("first", "replace_text", "web/b.ts", {"old": "p", "new": "q"}), ("absent", "replace_text", "docs/a.md", {"old": "nothing", "new": "q"}),
    ("noop", "append_text", "web/a.ts", {"text": "// more"}), ("removed", "remove_file", "docs/b.md", {}), ("renamed", "rename_file", "web/a.ts", {"new_path": "docs/new.md"}),
    ("added", "add_file", "data/y.json", {"content": "1"}), ("line", "remove_line_containing", "web/b.ts", {"text": "drop"}), ("lost", "append_text", "no/file.md", {"text": "x"}),
]


def test_cases_equal_single_runs(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, body string")
    names = [c.split()[0] for c in cases.EDITS.split(", ")]
    edits = spark.createDataFrame([tuple({"case_id": c, "operation": o, "path": p, **e}.get(n) for n in names) for c, o, p, e in CASES], cases.EDITS)
    found = {r.case_id: r for r in cases.evaluate(files, edits, RULES).collect()}
    base = S.take(files).cache()
    assert set(found) == {c[0] for c in CASES}
    for name, operation, path, edit in CASES:
        now = S.take(E.mutate(files, operation, path, **edit)).cache()
        changed = S.diff(base, now).cache()
        kinds = {r.change_type: r.n for r in S.tally(changed).collect()}
        one = M.semantic_movement(base, now).first()
        broken = R.evaluate(changed.select("path"), RULES).count()
        r = found[name]
        assert {k: r[k] for k in ("added", "removed", "semantic_changed", "semantic_noop") if r[k]} == kinds, name
        assert (r.documents, r.semantic, r.semantic_score, r.broken) == (one.total, one.semantic, one.score, broken), name
        assert r.active == [m for m, on in (("semantic_movement", one.score > 0), ("required_edge_breakage", broken > 0)) if on]


def verdict_of(mutation, number):
    """What a mutation gives in a cycle: misses of two kinds, a skip, or a hit."""
    if number == 1:
        return "hit", []
    return {"m2": ("false_negative", ["a"]), "m4": ("skipped", []), "m5": ("false_negative", ["b"]), "m6": ("false_negative", ["b"])}.get(mutation, ("hit", ["a"]))


def test_cycles_reproduce_a_plain_simulation(spark):
    specs = [f"m{i}" for i in range(8)]
    asked = []

    def run(chosen, number):
        rows = [(r.mutation_id, *verdict_of(r.mutation_id, number)) for r in chosen.orderBy("place").collect()]
        asked.append([r[0] for r in rows])
        df = spark.createDataFrame(rows, "mutation_id string, classification string, expected array<string>")
        return df.select("mutation_id", "classification", "expected", F.array().cast("array<string>").alias("actual"), *[F.lit("x").alias(c) for c in ("operation", "target_kind", "target_path")], F.lit("").alias("error"))

    done = cases.cycles(spark.createDataFrame([(m, i) for i, m in enumerate(specs)], "mutation_id string, place long"), run, 4, 7)
    order, wanted = list(specs), []
    for number in range(4):
        if wanted:
            found = [(m, *verdict_of(m, number - 1)) for m in wanted[-1]]
            keys = {r.key: r.mutations for r in done[number - 1][2].collect()}
            groups = {}
            for m, c, e in found:
                if c not in ("hit", "skipped"):
                    groups.setdefault(tuple(e), []).append(m)
            by_size = sorted(groups.values(), key=lambda g: (-len(g), next(k for k, v in keys.items() if v == sorted(g))))
            first = [m for g in by_size for m in sorted(g)] + [m for m, c, _ in found if c in ("skipped", "errored")]
            first = list(dict.fromkeys(first))
            order = first + [m for m in order if m not in first] if first else order[7 % 8 :] + order[: 7 % 8]
        wanted.append(order[:7])
    assert asked == wanted and wanted[1][:4] == ["m5", "m6", "m2", "m4"] and wanted[2] != wanted[1]
