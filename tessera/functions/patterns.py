"""Patterns and word lists that decide what counts as what.

Written for Java's engine so that they mean what RE2 means: (?dm) for lines, explicit
white space, and look-around over [0-9A-Za-z_] for ASCII word bounds."""

S = r"[ \t\n\f\r]"
B_BEFORE, B_AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"

TYPED_ID = B_BEFORE + r"((US|ADR|IDR)-[0-9]{3})" + B_AFTER
BARE_ID = r"((US|ADR|IDR)-[0-9]{3})"
ID_LINE = rf"(?dm)^id:{S}*((US|ADR|IDR)-[0-9]{{3}}){S}*$"
RELATION_LINE = rf"(?dm)^(supersedes|contradicts|mirrors|invalidates|implements):{S}*(.+?){S}*$"
FIRST_HEADING = rf"(?dm)^#{S}+(.+)$"
HEADING = rf"(?dm)^(#+){S}+(.+)$"
TITLE = rf"(?dm)^title:{S}*(.+?){S}*$"
LINK = rf"\[[^\]]*\]\(([^) \t\n\f\r#]+)(?:#[^)]*)?\)"
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
BULLET = rf"(?dm)^{S}*[-*+]{S}+(.+)$"
EVIDENCE = r"^docs/evidence/([^/]+)/"
IMPLEMENTS = rf"(?i){B_BEFORE}implements{B_AFTER}[ \t\n\f\r:@\-]*{B_BEFORE}((?:US|ADR|IDR)-[0-9]{{3}}){B_AFTER}"
GO_IMPLEMENTS = rf"(?i){B_BEFORE}implements{B_AFTER}[ \t\n\f\r:\-]*{B_BEFORE}((?:US|ADR|IDR)-[0-9]{{3}}){B_AFTER}"
QUOTED_NAME = "[\"'`]([A-Za-z_][A-Za-z0-9_]*)[\"'`]"
QUOTED_PATH = "[\"'`]([^\"'` \\t\\n\\f\\r]+)[\"'`]"
PATH_EXTENSION = r"\.[A-Za-z][A-Za-z0-9]{0,4}$"
BACKTICKS = "(?s)`[^`]*`"

TS_EXPORTS = {
    "function": rf"(?dm)^{S}*export{S}+(?:default{S}+)?(?:async{S}+)?function{S}+([0-9A-Za-z_]+)",
    "class": rf"(?dm)^{S}*export{S}+(?:default{S}+)?(?:abstract{S}+)?class{S}+([0-9A-Za-z_]+)",
    "interface": rf"(?dm)^{S}*export{S}+interface{S}+([0-9A-Za-z_]+)",
    "type": rf"(?dm)^{S}*export{S}+type{S}+([0-9A-Za-z_]+)",
    "enum": rf"(?dm)^{S}*export{S}+(?:const{S}+)?enum{S}+([0-9A-Za-z_]+)",
    "const": rf"(?dm)^{S}*export{S}+const{S}+([A-Za-z_$][0-9A-Za-z_$]*)",
    "let": rf"(?dm)^{S}*export{S}+let{S}+([A-Za-z_$][0-9A-Za-z_$]*)",
    "var": rf"(?dm)^{S}*export{S}+var{S}+([A-Za-z_$][0-9A-Za-z_$]*)",
}
TS_IMPORTS = [rf"(?dm)^{S}*import{B_AFTER}[^\n;]*?from{S}*['\"]([^'\"]+)['\"]", rf"(?dm)^{S}*import{S}*['\"]([^'\"]+)['\"]"]
TS_ENDPOINT = rf"{B_BEFORE}[0-9A-Za-z_]+\.(get|post|put|delete|patch|head|options){S}*\({S}*[`'\"](/[^`'\"]*)[`'\"]{S}*,"
TS_ANY_EXPORT = rf"^{S}*export{S}+(?:default{S}+)?(?:async{S}+)?(?:(?:abstract{S}+)?class|interface|type|(?:const{S}+)?enum|function|const|let|var){S}+([A-Za-z_$][0-9A-Za-z_$]*)"

PY_SYMBOLS = {
    "def": rf"(?dm)^(?:async{S}+)?def{S}+([A-Za-z_][0-9A-Za-z_]*){S}*\(",
    "class": rf"(?dm)^class{S}+([A-Za-z_][0-9A-Za-z_]*){S}*[:(]",
    "const": rf"(?dm)^([A-Z][A-Z0-9_]*){S}*(?::{S}*[^=]+)?={S}*[^=]",
}
PY_FROM_IMPORT = rf"(?dm)^{S}*from{S}+([.0-9A-Za-z_]+){S}+import{B_AFTER}"
PY_DECORATOR = rf"(?dm)^{S}*@[0-9A-Za-z_]+\.(get|post|put|delete|patch|head|options|route){S}*\(([^)]*)\)"
PY_ROUTE_PATH = rf"^{S}*[\"'](/[^\"']*)[\"']"
PY_ROUTE_METHODS = rf"methods{S}*={S}*\[([^\]]+)\]"
PY_ANY_DEF = rf"^(?:async{S}+)?(?:def|class){S}+([A-Za-z_][0-9A-Za-z_]*)"

SCHEMA_ENTITIES = {
    ".sql": rf"(?idm)^{S}*CREATE(?:{S}+OR{S}+REPLACE)?{S}+(?:MATERIALIZED{S}+VIEW|TABLE|VIEW|TYPE){S}+(?:IF{S}+NOT{S}+EXISTS{S}+)?(?:[A-Za-z0-9_]+\.)?[\"`]?([A-Za-z_][A-Za-z0-9_]*)[\"`]?",
    ".proto": rf"(?dm)^{S}*(?:message|enum|service){S}+([A-Za-z_][A-Za-z0-9_]*)",
    ".graphql": rf"(?dm)^{S}*(?:type|input|interface|enum|union){S}+([A-Za-z_][A-Za-z0-9_]*)",
    ".gql": rf"(?dm)^{S}*(?:type|input|interface|enum|union){S}+([A-Za-z_][A-Za-z0-9_]*)",
}

MAKE_NAMES = ["Makefile", "makefile", "GNUmakefile"]
MAKE_TARGET = rf"^([A-Za-z0-9_./+\-]+)::?(?:{S}|$)"
MAKE_ASSIGN = rf"^[A-Za-z0-9_.\-]+{S}*(?::=|\?=|\+=|!=|=)"
SHELL_EXTENSIONS = [".sh", ".bash", ".zsh"]
SHELL_NAMES = ["sh", "bash", "zsh"]

CLAIM_VERBS = ["must", "should", "shall", "requires", "require", "ensures", "ensure", "guarantees", "guarantee", "cannot", "will"]
FIXTURE_DIRS = ["scenarios/", "fixtures/", "testdata/", "golden/", "eval/"]
FRONTEND = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json"]
MARKDOWN = [".md", ".markdown"]
CODE_KINDS = [".go", ".ts", ".tsx", ".js", ".jsx", ".py", ".sql", ".rb", ".rs", ".java", ".kt"]
C_STYLE = [".ts", ".tsx", ".js", ".jsx", ".java", ".kt", ".rs", ".sql"]
HASH_STYLE = [".py", ".rb"]
METRIC_DIRS = ["rill/metrics/", "metrics/"]

#: Edge weights of the neighborhood meter; every other kind weighs 0.
EDGE_WEIGHTS = {"contains": 0.5, "mentions": 1.0, "defines": 3.0, "suggests": 1.0}
#: Edges that carry support between concepts or claims and artifacts.
SUPPORT_EDGES = ["mentions", "defines", "describes", "verifies", "supports", "generates", "expects", "implements", "depends_on"]
SUPPORT_KINDS = ["test", "evidence", "endpoint", "generated_artifact"]
MOVEMENT_METERS = ["neighborhood_drift", "semantic_movement", "blast_radius", "staleness"]
METERS = [
    "required_edge_breakage", "trace_coverage", "neighborhood_drift", "semantic_movement", "path_loss", "claim_support", "blast_radius",
    "staleness", "contradiction", "stale_decision_links", "broken_implements_chains", "dependency_cycles", "orphan_endpoints",
    "unimplemented_stories", "broken_links", "unknown_id_references", "stale_tests", "truth_alignment", "orphaned_metric_aliases",
    "dangling_imports", "callsite_blast_radius", "dead_code",
]
