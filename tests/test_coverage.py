"""COVERAGE.md says the truth: every function that a row names is reached from the queries that it names, by the calls in the source."""

import ast
import re
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
FILES = [p for p in (ROOT / "loomwork").rglob("*.py") if "llm" not in p.parts]


def names_by_function() -> dict[str, set[str]]:
    """Names that occur in each function, class or table of the library (equal names are taken together)."""
    out: dict[str, set[str]] = {}
    for path in FILES:
        for node in ast.parse(path.read_text()).body:
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                keys = [node.name]
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                keys = [t.id for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name)]
            else:
                continue
            found = {n.attr if isinstance(n, ast.Attribute) else n.id for n in ast.walk(node) if isinstance(n, (ast.Attribute, ast.Name))}
            for key in keys:
                out.setdefault(key, set()).update(found)
    return out


def reached(start: str, calls: dict[str, set[str]]) -> set[str]:
    seen, todo = set(), [start]
    while todo:
        for name in calls.get(todo.pop(), ()):
            if name in calls and name not in seen:
                seen.add(name)
                todo.append(name)
    return seen


def rows() -> list[tuple[str, list[str], list[str]]]:
    out = []
    for line in (ROOT / "COVERAGE.md").read_text().split("## Entry points")[0].splitlines():
        cells = [c.strip() for c in line.strip("|").split("|")]
        if line.startswith("|") and len(cells) == 3 and re.match(r"[A-Z]+\d", cells[0]):
            quoted = lambda c: re.findall(r"`([\w.*]+)", c)
            out.append((cells[0], [f.rpartition(".")[2] for f in quoted(cells[1])], quoted(cells[2])))
    return out


def test_named_queries_reach_named_functions():
    calls, queries, missing = names_by_function(), entry.queries(), []
    for ids, functions, named in rows():
        own = [q for n in named for q in queries if q == n or (n.endswith("*") and q.startswith(n[:-1]))]
        seen = set().union(*(reached(q, calls) for q in own)) if own else set()
        known = [f for f in functions if f in calls]
        if own:
            missing += [(ids, f) for f in known if f not in seen]
    assert missing == []


def test_named_queries_and_tests_exist():
    tests = "".join(p.read_text() for p in (ROOT / "tests").glob("*.py"))
    for ids, _, named in rows():
        for n in named:
            assert n in entry.queries() or f"def {n}(" in tests or any(q.startswith(n.rstrip("*")) for q in entry.queries()), (ids, n)
