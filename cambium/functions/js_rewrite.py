"""Rewrites of JavaScript text: canonical names, mappings, rendering of approved names, and formatting."""

from __future__ import annotations

from cambium.functions.js_analysis import FUNCTIONS, Bindings, hash64
from cambium.functions.js_parser import Node, Tree, parse


def shape(tree: Tree) -> str:
    """A hash of the syntax without comments, spaces and optional semicolons."""
    parts = []
    for n in tree.root.walk():
        if n.kind in ("comment", ";"):
            continue
        parts.append(n.kind if n.children else f"{n.kind} {tree.of(n)}")
    return str(hash64(*parts))


def occurrences(tree: Tree, b: Bindings) -> list[tuple[Node, int]]:
    """(node, symbol) of every place that spells a bound name, in order."""
    found = [(n, b.by_node[id(n)]) for n in tree.root.walk() if id(n) in b.by_node and n.kind in ("identifier", "shorthand_property_identifier", "shorthand_property_identifier_pattern")]
    return sorted(found, key=lambda x: x[0].start)


def canonical_names(tree: Tree, b: Bindings) -> dict[int, str]:
    """Symbol to canonical name: fn_<shape>[_n] for functions, class_n, param_n and var_n otherwise. Names that the text
    uses without binding them, and names already given, are skipped. Imports and exported names keep theirs."""
    used = {tree.of(n) for n, _, _, symbol, _ in b.references if symbol is None}
    fixed = {s for n, _, how, s, _ in b.references if how == "export" and s is not None}
    for n in tree.root.walk():
        if n.kind == "export_statement" and "declaration" in n.fields:
            fixed |= {b.by_node[id(x)] for x in n.fields["declaration"].walk() if id(x) in b.bound and b.symbols[b.by_node[id(x)]].scope == 0}
    fixed |= {k for k, s in enumerate(b.symbols) if s.kind == "import"}
    used |= {b.symbols[k].name for k in fixed}
    out, counts = {k: b.symbols[k].name for k in fixed}, dict.fromkeys(("param", "var", "class"), 0)
    for k, s in enumerate(b.symbols):
        if k in fixed:
            continue
        if s.kind == "function":
            f = s.node.parent
            base = f"fn_{hash64(*[n.kind for n in f.walk()]) % 65535:x}" if f is not None and f.kind in FUNCTIONS else "fn_0"
            name, n = base, 1
            while name in used:
                name, n = f"{base}_{n}", n + 1
        else:
            kind = {"class": "class", "parameter": "param"}.get(s.kind, "var")
            while True:
                name = f"{kind}_{counts[kind]}"
                counts[kind] += 1
                if name not in used:
                    break
        used.add(name)
        out[k] = name
    return out


def rename(tree: Tree, b: Bindings, names: dict[int, str]) -> str:
    """The text with bound names replaced; shorthand properties and unaliased import or export names keep their keys."""
    out, at, text = [], 0, tree.text
    for n, s in occurrences(tree, b):
        if s not in names or n.start < at:
            continue
        old, new = tree.of(n), names[s]
        if n.kind != "identifier":
            new = f"{old}: {new}" if old != new else new
        elif n.parent is not None and n.parent.kind in ("import_specifier", "export_specifier") and "alias" not in n.parent.fields and old != new:
            new = f"{old} as {new}" if n.parent.kind == "import_specifier" else f"{new} as {old}"
        out += [text[at : n.start], new]
        at = n.end
    return "".join([*out, text[at:]])


HEADER = "# first_line:column last_line:column type scope original canonical new"


def canonicalize(text: str) -> tuple[str, list[tuple]]:
    """(renamed text, mapping rows (first_line, first_col, last_line, last_col, type, scope, original, canonical, new))."""
    tree = parse(text)
    b = Bindings(tree)
    names = canonical_names(tree, b)
    rows: dict[int, list[int]] = {}
    for n, s in occurrences(tree, b):
        rows.setdefault(s, [n.start, n.start])[1] = n.start
    place = lambda at: (tree.line(at), tree.column(at))
    kind = {"function": "func", "parameter": "param"}
    made = [(*place(first), *place(last), kind.get(b.symbols[s].kind, "var"), b.symbols[s].scope, b.symbols[s].name, names[s], names[s]) for s, (first, last) in rows.items()]
    return rename(tree, b, names), sorted(made)


def mapping_text(rows: list[tuple]) -> str:
    return "\n".join([HEADER, *[f"{a}:{b} {c}:{d} {kind} {scope} {old} {canon} {new}" for a, b, c, d, kind, scope, old, canon, new in rows]]) + "\n"


def read_mapping(text: str) -> dict[str, str]:
    """Canonical to new name, of lines with six fields or more; comments and blank lines are skipped."""
    out = {}
    for line in text.splitlines():
        fields = line.split()
        if line.startswith("#") or len(fields) < 6:
            continue
        out[fields[5]] = fields[6] if len(fields) > 6 else fields[4]
    return out


def apply_mapping(text: str, names: dict[str, str]) -> str:
    tree = parse(text)
    b = Bindings(tree)
    return rename(tree, b, {k: names[s.name] for k, s in enumerate(b.symbols) if s.name in names})


class RenderError(ValueError):
    pass


def render(text: str, edits: list[tuple[int, int, str, str]]) -> str:
    """Replaces byte spans (start, end, spelling, name). Every span must hold its spelling, none may overlap, and the
    result must parse."""
    raw, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for start, end, spelling, name in sorted(edits):
        if start < at:
            raise RenderError(f"edits overlap at byte {start}")
        if raw[start:end] != spelling.encode("utf-8", "surrogatepass"):
            raise RenderError(f"bytes {start} to {end} do not spell {spelling!r}")
        out += [raw[at:start], name.encode()]
        at = end
    made = b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
    parse(made)
    return made


_TIGHT_BEFORE = {")", "]", ",", ";", ".", "?.", ":", "optional_chain", "arguments", "formal_parameters", "++", "--"}
_TIGHT_AFTER = {"(", "[", ".", "?.", "!", "~", "...", "optional_chain", "++", "--", "#"}
_WHOLE = {"string", "template_string", "regex", "number"}


def pretty(text: str) -> str:
    """The text with one statement a line and two spaces a level. A form that would change the syntax is given back as it
    was."""
    tree = parse(text)
    lines: list[str] = []
    current: list[str] = []
    depth = 0
    last: Node | None = None

    def end_line() -> None:
        nonlocal last
        if current:
            lines.append("  " * depth + "".join(current).strip())
        current.clear()
        last = None

    def put(n: Node, tight: bool) -> None:
        nonlocal last
        if current and not tight:
            current.append(" ")
        current.append(tree.of(n))
        last = n

    def block(n: Node) -> None:
        nonlocal depth, last
        put(n.children[0], False)
        end_line()
        depth += 1
        for c in n.children[1:-1]:
            visit(c, False)
            if n.kind in ("switch_body", "class_body") or c.named:
                end_line()
        end_line()
        depth -= 1
        put(n.children[-1], True)

    def visit(n: Node, tight: bool) -> None:
        if n.kind == "comment":
            put(n, False)
            if tree.of(n)[:2] != "/*":  # it ends with its line
                end_line()
            return
        if n.kind in _WHOLE or not n.children:
            put(n, tight)
            return
        if n.kind in ("statement_block", "class_body", "switch_body") and len(n.children) > 2:
            block(n)
            return
        for k, c in enumerate(n.children):
            before = n.children[k - 1] if k else None
            close = tight if k == 0 else c.kind in _TIGHT_BEFORE and not (c.kind == ":" and n.kind == "ternary_expression") or before is not None and before.kind in _TIGHT_AFTER
            if k and n.kind in ("unary_expression", "update_expression") and not (before and before.kind.isalpha()):
                close = not (last is not None and tree.of(last) in ("+", "-") and tree.of(c)[:1] in ("+", "-"))
            visit(c, close)

    try:
        for c in tree.root.children:
            visit(c, False)
            end_line()
    except RecursionError:  # an expression of thousands of terms
        return text
    made = "\n".join(lines) + ("\n" if lines else "")
    try:
        return made if shape(parse(made)) == shape(tree) else text
    except ValueError:
        return text
