"""Tables of one JavaScript file: declarations, nodes, scopes, symbols, references, calls and binding-resolved tokens."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from cambium.functions.js_parser import Node, Tree, parse, steady

# Kinds that hash with their text, whose children's order doesn't matter, and what adds nothing to a parent.
LITERALS = {"string", "number", "true", "false", "null", "undefined", "regex", "string_fragment"}
UNORDERED = {"object", "object_pattern", "named_imports", "export_clause"}
SILENT = {";", ",", "(", ")", "{", "}", "[", "]"}
TIMERS = {100, 200, 500, 1000, 2000, 5000}
PATTERNS = {"parenthesized_expression", "object_pattern", "array_pattern", "pair_pattern", "rest_pattern", "assignment_pattern", "object_assignment_pattern"}
FUNCTIONS = {"function_declaration", "function_expression", "arrow_function", "method_definition", "generator_function", "generator_function_declaration"}
NAMES = {"identifier", "shorthand_property_identifier", "shorthand_property_identifier_pattern"}


def hash64(*parts: str) -> int:
    """A signed 64-bit hash of a list of texts: the first eight bytes, least first, of the SHA-256 over each behind its length."""
    h = hashlib.sha256()
    for p in parts:
        b = p.encode("utf-8", "surrogatepass")
        h.update(len(b).to_bytes(8, "little") + b)
    return int.from_bytes(h.digest()[:8], "little", signed=True)


def digest_id(domain: str, *parts: object) -> str:
    """SHA-256 (hex) over a domain and parts, each behind its length; nothing for None. Equals hashing.digest_id."""
    h = hashlib.sha256()
    for p in (domain, *parts):
        b = b"" if p is None else str(p).encode("utf-8", "surrogatepass")
        h.update(len(b).to_bytes(8, "little"))
        h.update(b)
    return h.hexdigest()


def structural_hashes(tree: Tree, root: Node) -> list[int]:
    """Hashes of all subtrees, each from its own shape: identifiers lose their spelling, literals keep their text."""
    found: set[int] = set()
    done: dict[int, int] = {}
    stack = [(root, False)]
    while stack:
        n, ready = stack.pop()
        if not ready:
            stack.append((n, True))
            stack.extend((c, False) for c in n.children if c.kind != "comment")
            continue
        if n.kind in LITERALS:
            parts = [tree.of(n)]
        elif n.kind == "identifier":
            parts = ["<name>"]
        else:
            parts = [str(done[id(c)]) for c in n.children if c.kind != "comment" and c.kind not in SILENT]
            if n.kind in UNORDERED:
                parts.sort()
        done[id(n)] = hash64(n.kind, *parts)
        found.add(done[id(n)])
    return sorted(found)


@dataclass
class Scope:
    kind: str
    parent: int | None
    depth: int
    start: int
    end: int
    names: dict[str, list[int]] = field(default_factory=dict)


@dataclass
class Symbol:
    name: str
    kind: str
    scope: int
    node: Node


class Bindings:
    """Scopes, symbols and resolved references of a tree."""

    def __init__(self, tree: Tree):
        self.tree = tree
        self.scopes = [Scope("global", None, 0, 0, len(tree.text))]
        self.symbols: list[Symbol] = []
        self.references: list[tuple[Node, int, str, int | None, str]] = []  # node, scope, role, symbol, resolution
        self.by_node: dict[int, int] = {}
        self.bound: set[int] = set()
        self.scope_of: dict[int, int] = {}
        self._declare(tree.root)
        self._refer(tree.root, 0)

    def _open(self, kind: str, parent: int, n: Node) -> int:
        self.scopes.append(Scope(kind, parent, self.scopes[parent].depth + 1, n.start, n.end))
        self.scope_of[id(n)] = len(self.scopes) - 1
        return len(self.scopes) - 1

    def _bind(self, n: Node, kind: str, scope: int) -> None:
        name = self.tree.of(n)
        own = self.scopes[scope].names.setdefault(name, [])
        merges = {"variable", "function"} if kind in ("variable", "function") else {"parameter"} if kind == "parameter" else set()
        for s in own:  # legal redeclarations are one symbol; a function's kind wins
            if self.symbols[s].kind in merges:
                if kind == "function":
                    self.symbols[s].kind = kind
                self.bound.add(id(n))
                self.by_node[id(n)] = s
                return
        self.symbols.append(Symbol(name, kind, scope, n))
        own.append(len(self.symbols) - 1)
        self.bound.add(id(n))
        self.by_node[id(n)] = len(self.symbols) - 1

    def _pattern(self, n: Node, kind: str, scope: int) -> None:
        if n.kind in ("identifier", "shorthand_property_identifier_pattern"):
            self._bind(n, kind, scope)
        elif n.kind in ("assignment_pattern", "object_assignment_pattern"):
            self._pattern(n.fields["left"], kind, scope)
        elif n.kind == "pair_pattern":
            self._pattern(n.fields["value"], kind, scope)
        elif n.kind in ("object_pattern", "array_pattern", "rest_pattern"):
            for c in n.children:
                if c.named:
                    self._pattern(c, kind, scope)

    def _hoist(self, scope: int) -> int:
        while self.scopes[scope].kind not in ("function", "global"):
            scope = self.scopes[scope].parent or 0
        return scope

    def _declare(self, root: Node) -> None:
        stack = [(root, 0)]
        while stack:
            n, scope = stack.pop()
            inner, k = scope, n.kind
            if k in FUNCTIONS:
                inner = self._open("function", scope, n)
                name = n.fields.get("name")
                if name is not None and name.kind == "identifier":
                    self._bind(name, "function", scope if k.endswith("_declaration") else inner)
                params = n.fields.get("parameters")
                for p in params.children if params else ():
                    if p.named:
                        self._pattern(p, "parameter", inner)
                if "parameter" in n.fields:
                    self._pattern(n.fields["parameter"], "parameter", inner)
            elif k in ("class_declaration", "class_expression"):
                inner = self._open("class", scope, n)
                if "name" in n.fields:
                    self._bind(n.fields["name"], "class", scope if k == "class_declaration" else inner)
            elif k in ("variable_declaration", "lexical_declaration"):
                kind = "variable" if k == "variable_declaration" else self.tree.of(n.children[0])
                for d in n.all("variable_declarator"):
                    self._pattern(d.fields["name"], kind, self._hoist(scope) if kind == "variable" else scope)
            elif k == "for_in_statement":
                inner = self._open("loop", scope, n)
                word = next((c.kind for c in n.children if c.kind in ("var", "let", "const")), None)
                if word:
                    kind = "variable" if word == "var" else word
                    self._pattern(n.fields["left"], kind, self._hoist(inner) if word == "var" else inner)
            elif k == "for_statement":
                inner = self._open("loop", scope, n)
            elif k == "catch_clause":
                inner = self._open("catch", scope, n)
                if "parameter" in n.fields:
                    self._pattern(n.fields["parameter"], "catch", inner)
            elif k == "class_static_block":
                inner = self._open("function", scope, n)
            elif k == "statement_block" and (n.parent is None or n.parent.kind not in FUNCTIONS | {"catch_clause", "class_static_block"}):
                inner = self._open("block", scope, n)
            elif k == "switch_body":
                inner = self._open("block", scope, n)
            elif k == "import_statement":
                for c in n.walk():
                    if c.kind == "import_specifier":
                        self._bind(c.fields.get("alias") or c.fields["name"], "import", scope)
                    elif c.kind == "namespace_import" or c.kind == "import_clause":
                        for x in c.all("identifier"):
                            self._bind(x, "import", scope)
                continue
            stack.extend((c, inner) for c in reversed(n.children))

    def _refer(self, root: Node, scope: int) -> None:
        stack = [(root, scope)]
        while stack:
            n, scope = stack.pop()
            inner = self.scope_of.get(id(n), scope)
            if n.kind in ("identifier", "shorthand_property_identifier", "shorthand_property_identifier_pattern") and id(n) not in self.bound and self._lexical(n):
                symbol, resolution = self._resolve(self.tree.of(n), scope)
                self.references.append((n, scope, role(n), symbol, resolution))
                if symbol is not None:
                    self.by_node[id(n)] = symbol
            stack.extend((c, inner) for c in reversed(n.children))

    @staticmethod
    def _lexical(n: Node) -> bool:
        p = n.parent
        while p is not None:
            if p.kind == "import_statement":
                return False
            if p.kind == "export_specifier" and p.fields.get("alias") is n:
                return False
            if p.kind == "export_statement" and "source" in p.fields:
                return False
            if p.kind not in ("import_clause", "named_imports", "import_specifier", "export_specifier", "export_clause", "namespace_import", "namespace_export", "parenthesized_expression"):
                return True
            p = p.parent
        return True

    def _resolve(self, name: str, scope: int | None) -> tuple[int | None, str]:
        while scope is not None:
            if found := self.scopes[scope].names.get(name):
                return (found[0], "resolved") if len(found) == 1 else (None, "ambiguous")
            scope = self.scopes[scope].parent
        return None, "unresolved"


def _is_target(container: Node, n: Node) -> bool:
    while n is not container:
        p = n.parent
        if p is None or p.kind not in PATTERNS | {"update_expression"} and p is not container or p.kind in ("member_expression", "subscript_expression"):
            return False
        n = p
    return True


def role(n: Node) -> str:
    """How a reference uses its name: write, read_write, call, construct, export or read."""
    p = n.parent
    while p is not None:
        left = p.fields.get("left")
        hit = left is not None and left.start <= n.start and n.end <= left.end and (left is n or _is_target(left, n))
        if p.kind in ("assignment_expression", "for_in_statement") and hit:
            return "write"
        if p.kind == "augmented_assignment_expression" and hit or p.kind == "update_expression" and _is_target(p, n):
            return "read_write"
        if p.kind not in PATTERNS:  # a target lies behind patterns only
            break
        p = p.parent
    current = n
    while (p := current.parent) is not None:
        if p.kind == "call_expression" and p.fields.get("function") is current:
            return "call"
        if p.kind == "new_expression" and p.fields.get("constructor") is current:
            return "construct"
        if p.kind == "export_specifier" and p.fields.get("name") is current:
            return "export"
        if p.kind not in PATTERNS:
            break
        current = p
    return "read"


def unwrapped(n: Node) -> Node:
    while n.kind == "parenthesized_expression":
        n = next(c for c in n.children if c.named and c.kind != "comment")
    return n


def first_argument(args: Node | None) -> Node | None:
    return next((c for c in args.children if c.named and c.kind != "comment"), None) if args is not None and args.kind == "arguments" else None


def string_value(tree: Tree, n: Node) -> str:
    inner = tree.of(n)[1:-1]
    return inner.replace('\\"', '"').replace("\\'", "'").replace("\\\\", "\\")


def member_path(tree: Tree, n: Node) -> str:
    parts = []
    while n.kind == "member_expression":
        parts.append(tree.of(n.fields["property"]))
        n = n.fields["object"]
    return ".".join([tree.of(n), *reversed(parts)])


def evidence(tree: Tree, root: Node) -> tuple[list[str], list[tuple[str, str]], list[tuple[str | None, str, str | None]]]:
    """Strings, tagged constants and API calls of a subtree that say what it does."""
    strings, constants, calls = [], [], []
    for n in root.walk():
        if n.kind == "string" or n.kind == "string_fragment" and n.parent is not None and n.parent.kind == "template_string":
            value = string_value(tree, n) if n.kind == "string" else tree.of(n)
            if len(value.encode()) > 2 and not value.isspace():
                strings.append(value)
        elif n.kind == "number":
            text = tree.of(n)
            if text.isascii() and text.isdigit():
                value = int(text)
                if value in TIMERS:
                    constants.append(("duration", text))
                elif value > 100:
                    constants.append(("number", str(value)))
            else:
                try:
                    float(text)
                    constants.append(("float", text))
                except ValueError:
                    pass
        elif n.kind == "regex":
            constants.append(("regex", tree.of(n)))
        elif n.kind == "call_expression":
            f = n.fields["function"]
            if f.kind == "member_expression":
                obj, method = member_path(tree, f.fields["object"]), tree.of(f.fields["property"])
            elif f.kind == "identifier":
                obj, method = None, tree.of(f)
            else:
                continue
            if len(method.encode()) <= 2 and method not in ("fs", "os"):
                continue
            first = first_argument(n.fields["arguments"])
            value = None if first is None else string_value(tree, first) if first.kind == "string" else tree.of(first) if first.kind == "number" else None
            calls.append((obj, method, value))
    return strings, constants, calls


def signature(tree: Tree, n: Node, kind: str) -> str:
    """A declaration's outward shape. Formats are fixed values."""
    if kind == "function":
        params = sum(c.kind in ("identifier", "formal_parameters") for c in n.fields["parameters"].children)
        stmts = sum(c.kind not in ("{", "}", ";") for c in n.fields["body"].children)
        return f"function(params:{params},stmts:{stmts})"
    if kind == "class":
        body = n.fields["body"]
        return f"class(methods:{len(body.all('method_definition'))},fields:{len(body.all('field_definition'))})"
    if kind == "import":
        return f"import from {tree.of(n.fields['source'])}"
    if kind == "export":
        if "declaration" in n.fields:
            return "export declaration"
        return f"export {len(n.fields['clause'].all('export_specifier'))} items" if "clause" in n.fields else "export"
    v = n.fields["value"]
    if v.kind == "number":
        return f"var=number:{tree.of(v)}"
    if v.kind == "string":
        return f"var=string:len{len(tree.of(v).encode())}"
    if v.kind in ("true", "false"):
        return f"var=bool:{v.kind}"
    if v.kind == "array":
        return f"var=array:len{len(v.children)}"
    if v.kind == "object":
        return f"var=object:props{len(v.all('pair'))}"
    if v.kind in ("arrow_function", "function"):
        return f"var=function:params{len(v.fields['parameters'].children) if 'parameters' in v.fields else int('parameter' in v.fields)}"
    return f"var={v.kind}"


def declarations(tree: Tree) -> list[tuple[str, str, Node]]:
    """(name, kind, node) of top-level declarations: functions and classes wherever they are met, variables with a plain
    name and a value at top level, imports, and exports (an exported declaration counts as itself). What is inside a
    matched declaration isn't searched; other nodes only as the root's or as their parent's first child."""
    found = []
    stack = [(tree.root, True)]
    while stack:
        n, top = stack.pop()
        if n.kind in ("function_declaration", "class_declaration"):
            found.append((tree.of(n.fields["name"]), n.kind.split("_")[0], n))
        elif n.kind in ("variable_declaration", "lexical_declaration") and top:
            for d in n.all("variable_declarator"):
                if "value" in d.fields and d.fields["name"].kind == "identifier":
                    found.append((tree.of(d.fields["name"]), "variable", d))
        elif n.kind == "import_statement":
            found.append((f"import@{tree.line(n.start) - 1}", "import", n))
        elif n.kind == "export_statement":
            if "declaration" in n.fields:
                stack.append((n.fields["declaration"], top))
            else:
                found.append((f"export@{tree.line(n.start) - 1}", "export", n))
        else:
            kids = n.children if n.kind == "program" else n.children[:1]
            stack.extend((c, top) for c in reversed(kids))
    return found


def tokens(tree: Tree, bindings: Bindings, root: Node) -> list[tuple[str, str, int | None, bool, int]]:
    """(tag, text, symbol, local, line) in order: brackets of syntax, literals, strings, and names by what they bind."""
    out: list[tuple[str, str, int | None, bool, int]] = []
    first = tree.line(root.start)
    if root.kind == "variable_declarator" and root.parent is not None:
        out.append(("literal", f"declaration {tree.of(root.parent.children[0])}", None, False, 0))
    stack: list[Node | tuple[str, int]] = [root]
    while stack:
        n = stack.pop()
        if isinstance(n, tuple):
            out.append((n[0], "", None, False, n[1]))
            continue
        line, text = tree.line(n.start) - first, tree.of(n)
        if n.kind in ("comment", "hash_bang_line"):
            continue
        if n.kind == "string":
            out.append(("string", text, None, False, line))
        elif n.kind == "string_fragment":
            out.append(("string", text, None, False, line))
        elif n.kind in NAMES and (s := bindings.by_node.get(id(n))) is not None:
            at = bindings.symbols[s].node
            if n.kind != "identifier" or n.parent is not None and n.parent.kind in ("import_specifier", "export_specifier") and "alias" not in n.parent.fields:
                out.append(("literal", f"key {text}", None, False, line))
            out.append(("binding", text, s, root.start <= at.start and at.end <= root.end, line))
        elif not n.children:
            if n.kind != ";":  # a statement ends with or without it
                out.append(("literal", f"{n.kind} {text}", None, False, line))
        else:
            out.append(("open", n.kind, None, False, line))
            stack.append(("close", tree.line(n.end) - first))
            stack.extend(reversed(n.children))
    return out


#: Kinds that hold a declaration together.
CONTAINERS = FUNCTIONS | {"class_declaration", "class_expression", "variable_declarator", "import_statement", "catch_clause", "for_in_statement"}


def container(n: Node) -> Node:
    while n.parent is not None and n.kind not in CONTAINERS:
        n = n.parent
    return n


def ancestors(n: Node, most: int) -> list[str]:
    out = []
    while (n := n.parent) is not None and len(out) < most:
        out.append(n.kind)
    return out


SCOPES = ["global", "function", "block", "class", "loop", "catch"]
#: Fixed value: ancestors that are told of a declaration.
ANCESTORS = 6
ROLES = ["read", "write", "read_write", "call", "construct", "export"]


def flags(n: Node) -> int:
    """Bits: named, beside the syntax (comments). Texts with errors or missing parts are rejected, so two more bits are 0."""
    return int(n.named) | 2 * (n.kind == "comment")


class Ids:
    """Identities that hold no spelling and no span. A node's comes from its parent's, its place there, kind and flags."""

    def __init__(self, order: list[Node]):
        self.of_node: dict[int, str] = {}
        for n in order:
            self.of_node[id(n)] = digest_id("node", None if n.parent is None else self.of_node[id(n.parent)], n.ordinal, n.kind, flags(n))

    def symbol(self, s: Symbol) -> str:
        return digest_id("symbol", self.of_node[id(s.node)], s.kind)

    def reference(self, n: Node, how: str) -> str:
        return digest_id("reference", self.of_node[id(n)], how)


def outline(text: str) -> list[tuple[int, str]]:
    """(node, line of text) for each node: its kind, where it starts (0-based line and column), the field it fills, and the
    text of a short leaf, indented by depth."""
    tree = parse(text)
    rows, depth, field_of = [], {}, {}
    for k, n in enumerate(tree.root.walk()):
        depth[id(n)] = 0 if n.parent is None else depth[id(n.parent)] + 1
        for name, c in n.fields.items():
            field_of[id(c)] = name
        said = f' => "{tree.of(n)}"' if not n.children and n.end - n.start < 50 else ""
        name = f"{field_of[id(n)]}=" if id(n) in field_of else ""
        rows.append((k, f"{'  ' * depth[id(n)]}{name}{n.kind} [{tree.line(n.start) - 1}:{tree.column(n.start)}]{said}"))
    return rows


def analyze(text: str, limit: int = 1 << 28, which: list[str] | None = None) -> dict[str, list[tuple]]:
    """All tables of one file, or those of `which`; spans are UTF-8 bytes.

    Nodes stand in pre-order, scopes by (depth, start, end, kind), references by the symbol they resolve to and then by
    place (those without one last), calls by place.
    """
    if len(text) > limit:
        raise ValueError(f"source is longer than {limit}")
    with steady():
        return _tables(parse(text), which)


def _tables(tree: Tree, which: list[str] | None) -> dict[str, list[tuple]]:
    b = Bindings(tree)
    order = list(tree.root.walk())
    number = {id(n): k for k, n in enumerate(order)}
    wanted = set(which or ("nodes", "scopes", "symbols", "references", "calls", "declarations"))
    ids = Ids(order) if wanted - {"declarations"} else None
    out: dict[str, list[tuple]] = {}
    if "nodes" in wanted:
        out["nodes"] = [(k, ids.of_node[id(n)], None if n.parent is None else number[id(n.parent)], n.ordinal, n.kind, tree.byte(n.start), tree.byte(n.end), n.named, flags(n)) for k, n in enumerate(order)]
    if "declarations" in wanted:
        out["declarations"] = _declarations(tree, b)
    if "occurrences" in wanted:
        out["occurrences"] = [(b.by_node[id(n)], tree.byte(n.start), tree.byte(n.end)) for n in order if id(n) in b.by_node and n.kind in NAMES]
    if not wanted - {"nodes", "declarations", "occurrences"}:
        return out

    placed = sorted(range(len(b.scopes)), key=lambda k: (b.scopes[k].depth, b.scopes[k].start, b.scopes[k].end, SCOPES.index(b.scopes[k].kind), k))
    row_of = {k: row for row, k in enumerate(placed)}
    scopes, scope_ids = [], []
    for row, k in enumerate(placed):
        s = b.scopes[k]
        parent = None if s.parent is None else row_of[s.parent]
        span = (tree.byte(s.start), tree.byte(s.end))
        scope_ids.append(digest_id("scope", None if parent is None else scope_ids[parent], s.kind, s.depth, *span))
        scopes.append((row, scope_ids[row], parent, s.kind, s.depth, *span, [] if parent is None else [scopes[parent][3], *scopes[parent][7]]))

    held = sorted(range(len(b.references)), key=lambda k: (b.references[k][3] is None, b.references[k][3] or 0, b.references[k][0].start, b.references[k][0].end, ROLES.index(b.references[k][2])))
    references, ranges, ref_of = [], {}, {}
    for row, k in enumerate(held):
        n, scope, how, symbol, resolution = b.references[k]
        ref_of[id(n)] = row
        if symbol is not None:
            first, count = ranges.get(symbol, (row, 0))
            ranges[symbol] = (first, count + 1)
        references.append((row, ids.reference(n, how), number[id(n)], row_of[scope], tree.of(n), how, symbol, resolution, tree.byte(n.start), tree.byte(n.end)))
    at = 0
    symbols = []
    for k, s in enumerate(b.symbols):
        first, count = ranges.get(k, (at, 0))
        at = first + count
        box = container(s.node)
        symbols.append((k, ids.symbol(s), s.name, s.kind, row_of[s.scope], number[id(s.node)], first, count, number[id(box)], ancestors(box, ANCESTORS)))

    calls = []
    for n in order:
        if n.kind in ("call_expression", "new_expression"):
            callee = unwrapped(n.fields.get("function") or n.fields["constructor"])
            kind, ref, target, prop = "dynamic", None, None, None
            if callee.kind in ("identifier", "shorthand_property_identifier"):
                ref = ref_of.get(id(callee))
                target = references[ref][6] if ref is not None else None
                kind = "construct" if n.kind == "new_expression" else "direct"
            elif callee.kind == "member_expression":
                kind, prop = "member", tree.of(callee.fields["property"])
                ref = ref_of.get(id(unwrapped(callee.fields["object"])))
            first = first_argument(n.fields.get("arguments"))
            said = None if first is None else string_value(tree, first) if first.kind == "string" else tree.of(first) if first.kind == "number" else None
            made = digest_id("call", ids.of_node[id(n)], kind, None if ref is None else references[ref][1], None if target is None else symbols[target][1], prop)
            calls.append((len(calls), made, number[id(n)], kind, tree.of(callee), ref, target, prop, said))
    return out | {"scopes": scopes, "symbols": symbols, "references": references, "calls": calls}


#: Fixed value: characters of a line that a report shows.
SNIPPET = 200


def snippet(tree: Tree, at: int) -> str:
    """The line around a place without its margins, at most SNIPPET characters and an ellipsis."""
    start = tree.text.rfind("\n", 0, at) + 1
    end = tree.text.find("\n", at)
    line = tree.text[start : len(tree.text) if end < 0 else end].strip()
    return line[:SNIPPET] + "…" if len(line) > SNIPPET else line


def _declarations(tree: Tree, b: Bindings) -> list[tuple]:
    decl_of: dict[int, int] = {}
    found = declarations(tree)
    for k, (_, kind, n) in enumerate(found):
        name = n.fields.get("name")
        if kind in ("function", "class", "variable") and name is not None and id(name) in b.by_node:
            decl_of.setdefault(b.by_node[id(name)], k)
    decls = []
    for k, (name, kind, n) in enumerate(found):
        shape = structural_hashes(tree, n.fields["value"] if kind == "variable" else n)
        marks = [(tag, text, None if s is None else (s if local else decl_of.get(s)), local, line) for tag, text, s, local, line in tokens(tree, b, n)]
        strings, constants, calls = evidence(tree, n) if kind in ("function", "variable") else ([], [], [])
        own = b.by_node.get(id(n.fields["name"])) if "name" in n.fields else None
        dense: dict[int, int] = {}
        plain = []
        for tag, text, s, local, line in marks:
            if tag == "binding" and local and s == own:
                plain.append((tag, "self", None, line))
            elif tag == "binding" and local:
                plain.append((tag, f"local {dense.setdefault(s, len(dense))}", None, line))
            elif tag == "binding":
                plain.append((tag, f"outer {text}", s, line))
            else:
                plain.append((tag, text, None, line))
        decls.append((k, name, kind, n.kind, signature(tree, n, kind), tree.line(n.start), tree.line(n.end), tree.byte(n.start), tree.byte(n.end), shape, plain, strings, [f"{t} {v}" for t, v in constants], [(f"{o or ''}.{m}", a) for o, m, a in calls], sum(c.kind != "comment" for c in n.walk()), snippet(tree, n.start), tree.of(n)))
    return decls
