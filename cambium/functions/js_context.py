"""What surrounds each symbol of a file: its container's shape, how it is used, and where it stands."""

from __future__ import annotations

import hashlib

import numpy as np

from cambium.functions.js_analysis import ROLES, Bindings, Ids, container, first_argument, hash64, unwrapped
from cambium.functions.js_parser import Node, parse, steady
from cambium.functions.sourcemap import positions

#: Kinds that may become one another between versions.
KIND_CLASS = {"function": "callable", "class": "type", "import": "import", "parameter": "parameter", "variable": "value", "let": "value", "const": "value", "catch": "value"}


def _votes(features: list[int]) -> np.ndarray:
    """For each of 64 bits how many features set it, less how many don't."""
    raw = np.array(features, np.int64).view(np.uint8).reshape(-1, 8)
    return 2 * np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64) - len(features)


def _bits(votes: np.ndarray) -> int:
    """A tie sets the bit."""
    return int(np.packbits(votes >= 0, bitorder="little").view(np.int64)[0])


def vote(features: list[int]) -> int:
    """Similarity hash of 64-bit features; ties set the bit."""
    return _bits(_votes(features))


def _fingerprints(root: Node) -> dict[int, tuple[str, int, int]]:
    """For each node, by identity: digest of its kinds, similarity hash of its parts' kinds, and size."""
    out: dict[int, tuple[str, int, int]] = {}
    counters: dict[int, np.ndarray] = {}
    own_votes: dict[tuple[str, ...], np.ndarray] = {}
    stack = [(root, False)]
    while stack:
        n, ready = stack.pop()
        kids = [c for c in n.children if c.kind != "comment"]
        if not ready:
            stack.append((n, True))
            stack.extend((c, False) for c in kids)
            continue
        kinds = ("shape", n.kind, *[c.kind for c in kids])
        if kinds not in own_votes:
            own_votes[kinds] = _votes([hash64(*kinds)])
        total, size = own_votes[kinds].copy(), 1
        digest = hashlib.sha256(n.kind.encode())
        for c in kids:
            d, _, s = out[id(c)]
            digest.update(bytes.fromhex(d))
            size += s
            total += counters.pop(id(c))
        counters[id(n)] = total
        out[id(n)] = (digest.hexdigest(), _bits(total), size)
    return out


COLUMNS = "symbol_ix int, symbol_id string, name string, kind_class string, scope_kind string, depth int, shape string, shape_hash bigint, context_hash bigint, size int, roles array<int>, features array<bigint>, gen_line int, gen_column int"


def contexts(text: str) -> list[tuple]:
    """Rows of COLUMNS, one a symbol."""
    with steady():
        return _contexts(text)


def _contexts(text: str) -> list[tuple]:
    tree = parse(text)
    b = Bindings(tree)
    ids = Ids(list(tree.root.walk()))
    prints = _fingerprints(tree.root)
    uses: dict[int, list[tuple[Node, str, str]]] = {}
    for n, _, how, symbol, resolution in b.references:
        if symbol is not None:
            uses.setdefault(symbol, []).append((n, how, resolution))
    incoming: dict[int, set[str]] = {}
    for n in tree.root.walk():
        if n.kind in ("call_expression", "new_expression"):
            callee = unwrapped(n.fields.get("function") or n.fields["constructor"])
            if callee.kind == "identifier" and (s := b.by_node.get(id(callee))) is not None:
                incoming.setdefault(s, set()).add("construct" if n.kind == "new_expression" else "direct")
    rows = []
    offsets = [tree.byte(s.node.start) for s in b.symbols]
    places = positions(text, offsets)
    of_box: dict[int, set[int]] = {}
    for k, s in enumerate(b.symbols):
        box = container(s.node)
        shape, shape_hash, size = prints[id(box)]
        roles = [0] * len(ROLES)
        found = {hash64("kind", s.kind)}
        for n, how, resolution in uses.get(k, ()):
            roles[ROLES.index(how)] += 1
            found.add(hash64("use", how, n.parent.kind if n.parent else ""))
            found.add(hash64("resolution", resolution))
            found.add(hash64("target kind", KIND_CLASS[s.kind]))
            if how == "call" and n.parent is not None and first_argument(n.parent.fields.get("arguments")) is not None:
                found.add(hash64("called with", str(sum(c.named and c.kind != "comment" for c in n.parent.fields["arguments"].children))))
        found |= {hash64("called by", kind) for kind in incoming.get(k, ())}
        scope, up = s.scope, 0
        while scope is not None and up < 6:
            found.add(hash64("scope", str(up), b.scopes[scope].kind))
            scope, up = b.scopes[scope].parent, up + 1
        if id(box) not in of_box:
            own = of_box[id(box)] = set()
            up, n = 0, box.parent
            while n is not None and up < 6:
                own.add(hash64("ancestor", str(up), n.kind))
                up, n = up + 1, n.parent
            if box.parent is not None:
                own.add(hash64("place", str(min(box.ordinal, 15))))
            for n in box.walk():
                if n.kind in ("string", "number", "property_identifier"):
                    own.add(hash64(n.kind, tree.of(n)))
        features = sorted(found | of_box[id(box)])
        rows.append((k, ids.symbol(s), s.name, KIND_CLASS[s.kind], b.scopes[s.scope].kind, b.scopes[s.scope].depth, shape, shape_hash, vote(features), size, roles, features, *places[k]))
    return rows
