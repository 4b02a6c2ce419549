"""One Python file to fact rows: syntax nodes, scopes, imports, functions, control flow, instructions in SSA form, and the
local part of every analysis. Pure Python, run once a file inside ``tables.facts``; nothing here knows of Spark.

A function is lowered to blocks of instructions over numbered values. Locals are stored and loaded by name first; pruned phis
are then placed on the iterated dominance frontier, and names renamed along the dominator tree.
"""

from __future__ import annotations

import ast
import builtins
import itertools
import operator
import symtable
import warnings
from dataclasses import dataclass, field

#: Deeper syntax is not followed; a fixed bound of the analysis.
DEEPEST = 200
#: Longer constants count as unknown; a fixed bound of the analysis.
LONGEST_CONSTANT = 64
ENTRY = 0


@dataclass
class Instr:
    op: str
    result: int | None
    args: list[tuple[str, int, str, int]]  # role, position, name, value
    text: str
    line: int
    col: int
    const: object = None


@dataclass
class Block:
    id: int
    instrs: list[Instr] = field(default_factory=list)
    succs: list[tuple[int, str]] = field(default_factory=list)
    closed: bool = False


@dataclass
class Function:
    name: str
    kind: str
    owner: str
    line: int
    params: list[tuple[str, str, str]]  # name, kind, symbol of the annotation
    decorators: list[str]
    blocks: list[Block] = field(default_factory=list)


def dotted(node: ast.AST) -> str:
    """Dotted name of a Name or Attribute chain, else ''."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Call):
        inner = dotted(node.func)
        return ".".join([inner, *reversed(parts)]) if inner else ""
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def imported(node: ast.Import | ast.ImportFrom, module: str, is_package: bool) -> list[tuple[str, str]]:
    """(bound name, symbol) of an import; a relative one that leaves the top package binds nothing."""
    if isinstance(node, ast.Import):
        return [(a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0]) for a in node.names]
    base = node.module or ""
    if node.level:
        package = module.split(".") if is_package else module.split(".")[:-1]
        if node.level - 1 > len(package) or not package:
            return []
        base = ".".join([*package[: len(package) - node.level + 1], *([base] if base else [])])
    return [(a.asname or a.name, f"{base}.{a.name}" if base else a.name) for a in node.names]


def children(node: ast.AST) -> list[ast.AST]:
    """ast.iter_child_nodes as a list, at half its cost."""
    out, held = [], node.__dict__
    for name in node._fields:
        x = held.get(name)
        if isinstance(x, list):
            out += [c for c in x if isinstance(c, ast.AST)]
        elif isinstance(x, ast.AST):
            out.append(x)
    return out


def walk(node: ast.AST) -> list[ast.AST]:
    """ast.walk as a list."""
    out = [node]
    for n in out:
        out += children(n)
    return out


def too_deep(tree: ast.AST) -> bool:
    """Whether some node lies deeper than DEEPEST, without recursion."""
    level = [tree]
    for _ in range(DEEPEST):
        level = [c for n in level for c in children(n)]
        if not level:
            return False
    return True


class Module:
    """A parsed file: its symbols and lowered functions."""

    def __init__(self, module: str, is_package: bool, tree: ast.Module):
        self.module, self.is_package, self.tree = module, is_package, tree
        self.functions: list[Function] = []
        self.symbols: dict[str, str] = {}
        self.imports: list[tuple[str, str, int]] = []
        rebound: dict[str, int] = {}
        for node in self._top(tree.body):
            for name, symbol, line in self._bound(node):
                rebound[name] = rebound.get(name, 0) + 1
                if symbol:
                    self.symbols[name] = symbol
                    if isinstance(node, (ast.Import, ast.ImportFrom)):
                        self.imports.append((name, symbol, line))
        for node in walk(tree):
            if isinstance(node, ast.Global):
                for name in node.names:
                    rebound[name] = rebound.get(name, 0) + 1
        for name, times in rebound.items():
            if times > 1 and name in self.symbols and not self.symbols[name].startswith(module + "."):
                # the same import on both arms of a try stays known by its last arm; a name also assigned does not
                if times > sum(n == name for n, _, _ in self.imports):
                    del self.symbols[name]
        self.defined = {n.name for n in tree.body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}
        self.taken: dict[str, int] = {}

    def _top(self, body):
        for node in body:
            yield node
            for name in ("body", "orelse", "finalbody"):
                if isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                    yield from self._top(getattr(node, name, []) or [])
            if isinstance(node, ast.Try):
                for h in node.handlers:
                    yield from self._top(h.body)

    def _bound(self, node):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            return [(n, s, node.lineno) for n, s in imported(node, self.module, self.is_package)]
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return [(node.name, f"{self.module}.{node.name}", node.lineno)]
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name) and isinstance(node.value, ast.Call):
            return [(node.targets[0].id, self.resolve(dotted(node.value.func)), node.lineno)]  # an instance of what it calls
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, (ast.AnnAssign, ast.AugAssign, ast.For)) else []
        return [(t.id, "", node.lineno) for x in targets for t in ast.walk(x) if isinstance(t, ast.Name)]

    def resolve(self, name: str) -> str:
        """Canonical symbol of a dotted name written at module level, else ''."""
        head, _, rest = name.partition(".")
        symbol = self.symbols.get(head, "")
        return f"{symbol}.{rest}" if symbol and rest else symbol

    def unique(self, base: str) -> str:
        name, n = base, 2
        while name in self.taken:
            name, n = f"{base}__{n}", n + 1
        self.taken[name] = 1
        return name

    def lower(self) -> None:
        Lower(self, Function("<module>", "module", "", 1, [], [])).body(self.tree.body)


class Lower:
    """Blocks and instructions of one function."""

    def __init__(self, module: Module, function: Function, outer: "Lower | None" = None, local: set[str] | None = None):
        self.m, self.f, self.outer = module, function, outer
        self.f.name = module.unique(function.name)
        module.functions.append(function)
        self.locals = local or set()
        self.nonlocals: set[str] = set()
        self.globals: set[str] = set()
        self.n, self.hidden = 0, 0
        self.loops: list[tuple[int, int]] = []
        self.handlers: list[list[int]] = []
        self.now = self.block()
        for k, (name, kind, symbol) in enumerate(function.params):
            self.store(name, self.emit("param", [], name, None, symbol))

    # -- blocks and instructions

    def block(self) -> Block:
        made = Block(len(self.f.blocks))
        self.f.blocks.append(made)
        for targets in self.handlers[-1:]:
            made.succs += [(t, "exception") for t in targets]
        return made

    def emit(self, op: str, args=(), text: str = "", node: ast.AST | None = None, const: object = None, result: bool = True) -> int:
        value = self.n if result else None
        self.n += result
        self.now.instrs.append(Instr(op, value, list(args), text, getattr(node, "lineno", self.f.line), getattr(node, "col_offset", 0) + 1, const))
        return value if result else -1

    def go(self, target: Block, kind: str = "jump") -> None:
        if not self.now.closed:
            self.now.succs.append((target.id, kind))
            if kind == "jump":
                self.emit("jump", [], str(target.id), None, None, False)
                self.now.closed = True

    def branch(self, test: ast.AST, then: Block, other: Block) -> None:
        value = self.ev(test)
        if not self.now.closed:
            self.emit("branch", [("test", 0, "", value)], f"{then.id}|{other.id}", test, None, False)
            self.now.succs += [(then.id, "then"), (other.id, "else")]
            self.now.closed = True

    def store(self, name: str, value: int) -> None:
        if name in self.globals or (self.f.kind == "module" and self.outer is None and name in self.globals):
            self.emit("set_global", [("value", 0, "", value)], name, None, None, False)
        elif name in self.nonlocals:
            self.emit("set_nonlocal", [("value", 0, "", value)], name, None, None, False)
        else:
            self.emit("store", [("value", 0, "", value)], name, None, None, False)

    def fresh(self) -> str:
        self.hidden += 1
        return f"%{self.hidden}"

    # -- expressions

    def load(self, name: str, node: ast.AST) -> int:
        if name in self.locals or name.startswith("%"):
            return self.emit("load", [], name, node)
        symbol = self.m.symbols.get(name, "")
        return self.emit("symbol", [], symbol, node) if symbol else self.emit("symbol", [], f"builtins.{name}", node) if name in BUILTINS else self.emit("global", [], name, node)

    def ev(self, e: ast.AST | None) -> int:
        if e is None:
            return self.emit("const", [], "None", None, None)
        return getattr(self, f"ev_{type(e).__name__}", self.unknown)(e)

    def unknown(self, e: ast.AST) -> int:
        parts = [self.ev(c) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr)]
        return self.emit("unknown", [("part", k, "", v) for k, v in enumerate(parts)], type(e).__name__, e)

    def many(self, op: str, role: str, parts: list, text: str, node: ast.AST) -> int:
        return self.emit(op, [("unpacked" if isinstance(p, ast.Starred) else role, k, "", self.ev(p.value if isinstance(p, ast.Starred) else p)) for k, p in enumerate(parts)], text, node)

    def ev_Constant(self, e):
        return self.emit("const", [], repr(e.value), e, e.value)

    def ev_Name(self, e):
        return self.load(e.id, e)

    def ev_Attribute(self, e):
        return self.emit("get_attr", [("object", 0, "", self.ev(e.value))], e.attr, e)

    def ev_Subscript(self, e):
        o = self.ev(e.value)
        return self.emit("get_item", [("object", 0, "", o), ("key", 1, "", self.ev(e.slice))], "", e)

    def ev_Slice(self, e):
        return self.many("build_slice", "part", [x for x in (e.lower, e.upper, e.step) if x], "", e)

    def ev_BinOp(self, e):
        left = self.ev(e.left)
        return self.emit("binary", [("left", 0, "", left), ("right", 1, "", self.ev(e.right))], type(e.op).__name__, e)

    def ev_UnaryOp(self, e):
        return self.emit("unary", [("operand", 0, "", self.ev(e.operand))], type(e.op).__name__, e)

    def ev_BoolOp(self, e):
        return self.many("bool_op", "operand", e.values, type(e.op).__name__, e)

    def ev_Compare(self, e):
        values = [self.ev(x) for x in (e.left, *e.comparators)]
        made = [self.emit("compare", [("left", 0, "", a), ("right", 1, "", b)], type(o).__name__, e) for a, b, o in zip(values, values[1:], e.ops)]
        return made[0] if len(made) == 1 else self.emit("bool_op", [("operand", k, "", v) for k, v in enumerate(made)], "And", e)

    def ev_Call(self, e):
        callee = self.ev(e.func)
        args = [("callee", 0, "", callee)]
        for k, a in enumerate(e.args):
            args.append(("unpacked", k, "*", self.ev(a.value)) if isinstance(a, ast.Starred) else ("arg", k, "", self.ev(a)))
        for k, w in enumerate(e.keywords):
            args.append(("keyword", k, w.arg, self.ev(w.value)) if w.arg else ("unpacked", k, "**", self.ev(w.value)))
        return self.emit("call", args, dotted(e.func), e)

    def ev_List(self, e):
        return self.many("build_list", "element", e.elts, "", e)

    def ev_Tuple(self, e):
        return self.many("build_tuple", "element", e.elts, "", e)

    def ev_Set(self, e):
        return self.many("build_set", "element", e.elts, "", e)

    def ev_Dict(self, e):
        args = []
        for k, (key, value) in enumerate(zip(e.keys, e.values)):
            if key is not None:
                args.append(("key", k, "", self.ev(key)))
            args.append(("element" if key is not None else "unpacked", k, "", self.ev(value)))
        return self.emit("build_dict", args, "", e)

    def ev_JoinedStr(self, e):
        return self.many("build_string", "part", [p.value if isinstance(p, ast.FormattedValue) else p for p in e.values], "", e)

    def ev_FormattedValue(self, e):
        return self.ev(e.value)

    def ev_Starred(self, e):
        return self.ev(e.value)

    def ev_NamedExpr(self, e):
        value = self.ev(e.value)
        self.store(e.target.id, value)
        return value

    def ev_Await(self, e):
        return self.emit("await", [("value", 0, "", self.ev(e.value))], "", e)

    def ev_Yield(self, e):
        return self.emit("yield", [("value", 0, "", self.ev(e.value))], "", e)

    ev_YieldFrom = ev_Yield

    def ev_IfExp(self, e):
        then, other, after, name = self.block(), self.block(), self.block(), self.fresh()
        self.branch(e.test, then, other)
        for block, part in ((then, e.body), (other, e.orelse)):
            self.now = block
            self.store(name, self.ev(part))
            self.go(after)
        self.now = after
        return self.load(name, e)

    def ev_Lambda(self, e):
        return self.nested(e, f"lambda_{e.lineno}_{e.col_offset + 1}", "lambda", e.args, [ast.Return(e.body, lineno=e.lineno, col_offset=e.col_offset)], [])

    def comprehension(self, e, op: str, parts: list):
        made = self.emit(op, [], "", e)
        keep = self.fresh()
        self.store(keep, made)

        def inside(k: int) -> None:
            if k == len(e.generators):
                values = [self.ev(p) for p in parts]
                self.emit("set_item", [("object", 0, "", self.load(keep, e)), *(("value", i, "", v) for i, v in enumerate(values))], "", e, None, False)
                return
            g = e.generators[k]
            self.locals |= {n.id for n in ast.walk(g.target) if isinstance(n, ast.Name)}

            def body() -> None:
                skip = None
                for test in g.ifs:
                    then = self.block()
                    skip = skip or self.block()
                    self.branch(test, then, skip)
                    self.now = then
                inside(k + 1)
                if skip:
                    self.go(skip)
                    self.now = skip

            self.loop(g.target, g.iter, body, [], e)

        inside(0)
        return self.load(keep, e)

    def ev_ListComp(self, e):
        return self.comprehension(e, "build_list", [e.elt])

    def ev_SetComp(self, e):
        return self.comprehension(e, "build_set", [e.elt])

    def ev_GeneratorExp(self, e):
        return self.comprehension(e, "build_list", [e.elt])

    def ev_DictComp(self, e):
        return self.comprehension(e, "build_dict", [e.key, e.value])

    # -- statements

    def body(self, statements: list) -> None:
        self.statements(statements)
        if not self.now.closed:
            self.emit("return", [("value", 0, "", self.ev(None))], "", None, None, False)
            self.now.closed = True

    def statements(self, statements: list) -> None:
        for s in statements:
            if self.now.closed:
                self.now = self.block()
            getattr(self, f"st_{type(s).__name__}", self.other)(s)

    def other(self, s) -> None:
        for c in ast.iter_child_nodes(s):
            if isinstance(c, ast.expr):
                self.ev(c)

    def assign(self, target: ast.AST, value: int) -> None:
        if isinstance(target, ast.Name):
            self.store(target.id, value)
        elif isinstance(target, ast.Attribute):
            o = self.ev(target.value)
            self.emit("set_attr", [("object", 0, "", o), ("value", 0, "", value)], target.attr, target, None, False)
        elif isinstance(target, ast.Subscript):
            o, k = self.ev(target.value), self.ev(target.slice)
            self.emit("set_item", [("object", 0, "", o), ("key", 0, "", k), ("value", 0, "", value)], "", target, None, False)
        elif isinstance(target, ast.Starred):
            self.assign(target.value, value)
        else:
            for k, part in enumerate(target.elts):
                key = self.emit("const", [], repr(k), target, k)
                self.assign(part, self.emit("get_item", [("object", 0, "", value), ("key", 1, "", key)], "", target))

    def st_Assign(self, s):
        value = self.ev(s.value)
        for t in s.targets:
            self.assign(t, value)

    def st_AnnAssign(self, s):
        if s.value is not None:
            self.assign(s.target, self.ev(s.value))

    def st_AugAssign(self, s):
        load = ast.copy_location(ast.parse(ast.unparse(s.target), mode="eval").body, s.target)
        left = self.ev(load if not isinstance(load, ast.Name) else ast.copy_location(ast.Name(load.id, ast.Load()), s.target))
        self.assign(s.target, self.emit("binary", [("left", 0, "", left), ("right", 1, "", self.ev(s.value))], type(s.op).__name__, s))

    def st_Expr(self, s):
        self.ev(s.value)

    def st_Return(self, s):
        self.emit("return", [("value", 0, "", self.ev(s.value))], "", s, None, False)
        self.now.closed = True

    def st_Raise(self, s):
        args = [("value", k, "", self.ev(x)) for k, x in enumerate((s.exc, s.cause)) if x]
        self.emit("raise", args, "", s, None, False)
        self.now.closed = True

    def st_Assert(self, s):
        self.emit("assert", [("test", 0, "", self.ev(s.test))], "", s, None, False)

    def st_Pass(self, s):
        pass

    def st_Global(self, s):
        self.globals |= set(s.names)

    def st_Nonlocal(self, s):
        self.nonlocals |= set(s.names)

    def st_Delete(self, s):
        for t in s.targets:
            if isinstance(t, ast.Attribute):
                self.emit("del_attr", [("object", 0, "", self.ev(t.value))], t.attr, s, None, False)
            elif isinstance(t, ast.Subscript):
                self.emit("del_item", [("object", 0, "", self.ev(t.value)), ("key", 0, "", self.ev(t.slice))], "", s, None, False)

    def st_Import(self, s):
        for name, symbol in imported(s, self.m.module, self.m.is_package):
            self.store(name, self.emit("import", [], symbol, s))

    st_ImportFrom = st_Import

    def st_If(self, s):
        then, other, after = self.block(), self.block(), self.block()
        self.branch(s.test, then, other)
        for block, part in ((then, s.body), (other, s.orelse)):
            self.now = block
            self.statements(part)
            self.go(after)
        self.now = after

    def st_While(self, s):
        head, inside, other, after = self.block(), self.block(), self.block(), self.block()
        self.go(head)
        self.now = head
        self.branch(s.test, inside, other)
        self.loops.append((head.id, after.id))
        self.now = inside
        self.statements(s.body)
        self.go(head)
        self.loops.pop()
        self.now = other
        self.statements(s.orelse)
        self.go(after)
        self.now = after

    def loop(self, target, iterable, body, orelse: list, node) -> None:
        source = self.emit("get_iter", [("object", 0, "", self.ev(iterable))], "", node)
        head, inside, other, after = self.block(), self.block(), self.block(), self.block()
        self.go(head)
        self.now = head
        item = self.emit("for_next", [("iterator", 0, "", source)], f"{inside.id}|{other.id}", node)
        head.succs += [(inside.id, "body"), (other.id, "exit")]
        head.closed = True
        self.loops.append((head.id, after.id))
        self.now = inside
        self.assign(target, item)
        body()
        self.go(head)
        self.loops.pop()
        self.now = other
        self.statements(orelse)
        self.go(after)
        self.now = after

    def st_For(self, s):
        self.loop(s.target, s.iter, lambda: self.statements(s.body), s.orelse, s)

    st_AsyncFor = st_For

    def st_Break(self, s):
        if self.loops:
            self.go(self.f.blocks[self.loops[-1][1]])

    def st_Continue(self, s):
        if self.loops:
            self.go(self.f.blocks[self.loops[-1][0]])

    def st_With(self, s):
        held = []
        for item in s.items:
            manager = self.ev(item.context_expr)
            value = self.emit("with_enter", [("manager", 0, "", manager)], "", s)
            held.append(manager)
            if item.optional_vars is not None:
                self.assign(item.optional_vars, value)
        self.statements(s.body)
        if not self.now.closed:
            for manager in reversed(held):
                self.emit("with_exit", [("manager", 0, "", manager)], "", s, None, False)

    st_AsyncWith = st_With

    def st_Try(self, s):
        after, other = self.block(), self.block()
        caught = [self.block() for _ in s.handlers]
        self.handlers.append([b.id for b in caught])
        inside = self.block()
        self.go(inside)
        self.now = inside
        self.statements(s.body)
        self.handlers.pop()
        self.go(other)
        self.now = other
        self.statements(s.orelse)
        self.go(after)
        for block, h in zip(caught, s.handlers):
            self.now = block
            kinds = [("type", 0, "", self.ev(h.type))] if h.type else []
            value = self.emit("catch", kinds, "", h)
            if h.name:
                self.store(h.name, value)
            self.statements(h.body)
            self.go(after)
        self.now = after
        self.statements(s.finalbody)

    st_TryStar = st_Try

    def st_Match(self, s):
        subject, after = self.ev(s.subject), self.block()
        for case in s.cases:
            then, other = self.block(), self.block()
            test = self.pattern(case.pattern, subject)
            if case.guard is not None:
                test = self.emit("bool_op", [("operand", 0, "", test), ("operand", 1, "", self.ev(case.guard))], "And", case.guard)
            self.emit("branch", [("test", 0, "", test)], f"{then.id}|{other.id}", case.pattern, None, False)
            self.now.succs += [(then.id, "then"), (other.id, "else")]
            self.now.closed = True
            self.now = then
            self.statements(case.body)
            self.go(after)
            self.now = other
        self.go(after)
        self.now = after

    def pattern(self, p, subject: int) -> int:
        """Value of the condition under which the pattern fits; its names are bound."""
        tests = []
        if isinstance(p, ast.MatchValue):
            tests.append(self.emit("compare", [("left", 0, "", subject), ("right", 1, "", self.ev(p.value))], "Eq", p))
        elif isinstance(p, ast.MatchSingleton):
            tests.append(self.emit("compare", [("left", 0, "", subject), ("right", 1, "", self.emit("const", [], repr(p.value), p, p.value))], "Is", p))
        elif isinstance(p, ast.MatchOr):
            tests.append(self.emit("bool_op", [("operand", k, "", self.pattern(x, subject)) for k, x in enumerate(p.patterns)], "Or", p))
        else:
            inner = list(getattr(p, "patterns", [])) + list(getattr(p, "kwd_patterns", [])) + ([p.pattern] if getattr(p, "pattern", None) is not None else [])
            if isinstance(p, ast.MatchClass):
                tests.append(self.emit("call", [("callee", 0, "", self.emit("symbol", [], "builtins.isinstance", p)), ("arg", 0, "", subject), ("arg", 1, "", self.ev(p.cls))], "isinstance", p))
            whole = isinstance(p, (ast.MatchAs, ast.MatchStar))
            for x in inner:
                tests.append(self.pattern(x, subject if whole else self.emit("get_item", [("object", 0, "", subject)], "", p)))
            for name in (getattr(p, "name", None), getattr(p, "rest", None)):
                if name:
                    self.store(name, subject)
        return tests[0] if len(tests) == 1 else self.emit("bool_op", [("operand", k, "", t) for k, t in enumerate(tests)], "And", p) if tests else self.emit("const", [], "True", p, True)

    # -- definitions

    def nested(self, node, name: str, kind: str, args: ast.arguments, body: list, decorators: list) -> int:
        owner = self.f.name[: -len(".<body>")] if self.f.kind == "class" else ""
        base = "" if self.f.kind == "module" else f"{owner or self.f.name}."
        params = [(a.arg, k, self.m.resolve(dotted(a.annotation)) if a.annotation is not None else "") for k, xs in (
            ("positional", args.posonlyargs + args.args), ("variadic", [args.vararg] if args.vararg else []), ("keyword", args.kwonlyargs), ("keywords", [args.kwarg] if args.kwarg else [])) for a in xs]
        inner = bound_names(args, body)
        free = sorted((read_names(body) - inner) & (self.locals if self.f.kind not in ("module", "class") else set()))
        params += [(n, "captured", "") for n in free]
        captured = [("captured", k, n, self.load(n, node)) for k, n in enumerate(free)]
        defaults = [("default", k, "", self.ev(d)) for k, d in enumerate([*args.defaults, *[d for d in args.kw_defaults if d]])]
        f = Function(base + name, kind, owner, node.lineno, params, [self.m.resolve(dotted(d)) or dotted(d) for d in decorators])
        Lower(self.m, f, self, inner | set(free)).body(body)
        return self.emit("make_function", captured + defaults, f.name, node)

    def st_FunctionDef(self, s):
        kind = "async" if isinstance(s, ast.AsyncFunctionDef) else "method" if self.f.kind == "class" else "function"
        value = self.nested(s, s.name, kind, s.args, s.body, s.decorator_list)
        for d in s.decorator_list:
            value = self.emit("call", [("callee", 0, "", self.ev(d)), ("arg", 0, "", value)], dotted(d), d)
        self.store(s.name, value)

    st_AsyncFunctionDef = st_FunctionDef

    def st_ClassDef(self, s):
        bases = [("base", k, "", self.ev(b)) for k, b in enumerate(s.bases)]
        outer = "" if self.f.kind == "module" else f"{self.f.name.removesuffix('.<body>')}."
        f = Function(f"{outer}{s.name}.<body>", "class", "", s.lineno, [], [self.m.resolve(dotted(b)) or dotted(b) for b in s.bases])
        Lower(self.m, f, self, bound_names(None, s.body)).body(s.body)
        self.store(s.name, self.emit("make_class", bases, s.name, s))


BUILTINS = frozenset(dir(builtins))


def _own(body: list):
    """Nodes of a body without those inside nested functions and classes."""
    stack = list(body)
    while stack:
        n = stack.pop()
        yield n
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            stack += [*n.decorator_list, *(n.args.defaults if not isinstance(n, ast.ClassDef) else n.bases)]
        elif not isinstance(n, ast.Lambda):
            stack += children(n)


def bound_names(args: ast.arguments | None, body: list) -> set[str]:
    """Names that a function's own body binds, its parameters among them."""
    out = {a.arg for a in [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]} if args else set()
    declared = set()
    for n in _own(body):
        if isinstance(n, ast.Name) and isinstance(n.ctx, (ast.Store, ast.Del)):
            out.add(n.id)
        elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            out.add(n.name)
        elif isinstance(n, (ast.Import, ast.ImportFrom)):
            out |= {a.asname or a.name.split(".")[0] for a in n.names}
        elif isinstance(n, ast.ExceptHandler) and n.name:
            out.add(n.name)
        elif isinstance(n, (ast.MatchAs, ast.MatchStar)) and n.name:
            out.add(n.name)
        elif isinstance(n, ast.MatchMapping) and n.rest:
            out.add(n.rest)
        elif isinstance(n, (ast.Global, ast.Nonlocal)):
            declared |= set(n.names)
    return out - declared


def read_names(body: list) -> set[str]:
    return {n.id for s in body for n in walk(s) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)}


# -- SSA

def dominators(succs: list[list[int]]) -> tuple[list[int], list[int | None]]:
    """Reverse postorder of the reachable blocks, and immediate dominators (None if unreachable; the entry's own is itself)."""
    order, seen, stack = [], {ENTRY}, [(ENTRY, iter(succs[ENTRY]))]
    while stack:
        node, rest = stack[-1]
        for nxt in rest:
            if nxt not in seen:
                seen.add(nxt)
                stack.append((nxt, iter(succs[nxt])))
                break
        else:
            order.append(node)
            stack.pop()
    order.reverse()
    place = {b: k for k, b in enumerate(order)}
    preds: list[list[int]] = [[] for _ in succs]
    for b in order:
        for s in succs[b]:
            preds[s].append(b)
    idom: list[int | None] = [None] * len(succs)
    idom[ENTRY] = ENTRY
    changed = True
    while changed:
        changed = False
        for b in order[1:]:
            new = None
            for p in preds[b]:
                if idom[p] is not None:
                    if new is None:
                        new = p
                    else:
                        x, y = p, new
                        while x != y:
                            while place[x] > place[y]:
                                x = idom[x]
                            while place[y] > place[x]:
                                y = idom[y]
                        new = x
            if idom[b] != new:
                idom[b], changed = new, True
    return order, idom


def ssa(f: Function) -> tuple[list[int], list[int | None]]:
    """Replace loads and stores of names by values, with pruned phis; values are numbered anew from 0. Unreachable blocks lose
    their instructions."""
    succs = [list(dict.fromkeys(t for t, _ in b.succs)) for b in f.blocks]
    order, idom = dominators(succs)
    reached = set(order)
    preds: list[list[int]] = [[] for _ in succs]
    for b in order:
        for s in succs[b]:
            preds[s].append(b)
    frontier: list[set[int]] = [set() for _ in succs]
    for b in order:
        if len(preds[b]) > 1 or b == ENTRY and preds[b]:
            for p in preds[b]:
                while p != idom[b] or (b == ENTRY and p != ENTRY):
                    frontier[p].add(b)
                    if p == idom[p]:
                        break
                    p = idom[p]
    uses: list[set[str]] = [set() for _ in succs]
    defs: list[set[str]] = [set() for _ in succs]
    for b in order:
        for i in f.blocks[b].instrs:
            if i.op == "load" and i.text not in defs[b]:
                uses[b].add(i.text)
            elif i.op == "store":
                defs[b].add(i.text)
    live: list[set[str]] = [set(u) for u in uses]
    work = list(order)
    while work:
        b = work.pop()
        new = uses[b] | (set().union(*(live[s] for s in succs[b])) - defs[b] if succs[b] else set())
        if new != live[b]:
            live[b] = new
            work += preds[b]
    phis: list[dict[str, Instr]] = [{} for _ in succs]
    where: dict[str, list[int]] = {}
    for b in order:
        for name in defs[b]:
            where.setdefault(name, []).append(b)
    for name, blocks in where.items():
        work, placed = list(blocks), set()
        while work:
            for t in frontier[work.pop()]:
                if t not in placed and name in live[t]:
                    placed.add(t)
                    phis[t][name] = Instr("phi", 0, [], name, f.line, 1)
                    work.append(t)
    children: list[list[int]] = [[] for _ in succs]
    for b in order[1:]:
        children[idom[b]].append(b)
    count = 0
    alias: dict[int, int] = {}

    def number() -> int:
        nonlocal count
        count += 1
        return count - 1

    state: list[tuple[int, dict[str, int]]] = [(ENTRY, {})]
    out_env: dict[int, dict[str, int]] = {}
    undefined: dict[str, Instr] = {}
    while state:
        b, env = state.pop()
        env = dict(env)
        kept: list[Instr] = []
        for name, phi in phis[b].items():
            phi.result = number()
            env[name] = phi.result
        for i in f.blocks[b].instrs:
            if i.op == "store":
                env[i.text] = alias[i.args[0][3]]
                continue
            if i.op == "load":
                if i.text not in env:
                    if i.text not in undefined:
                        undefined[i.text] = Instr("undefined", number(), [], i.text, i.line, i.col)
                    env[i.text] = undefined[i.text].result
                alias[i.result] = env[i.text]
                continue
            i.args = [(r, p, n, alias[v]) for r, p, n, v in i.args]
            if i.result is not None:
                old, i.result = i.result, number()
                alias[old] = i.result
            kept.append(i)
        f.blocks[b].instrs = kept
        out_env[b] = env
        state += [(c, env) for c in reversed(children[b])]
    for b in order:
        for name, phi in phis[b].items():
            for p in preds[b]:
                value = out_env[p].get(name)
                if value is None:
                    if name not in undefined:
                        undefined[name] = Instr("undefined", number(), [], name, f.line, 1)
                    value = undefined[name].result
                phi.args.append(("input", p, "", value))
        f.blocks[b].instrs[:0] = phis[b].values()
    f.blocks[ENTRY].instrs[:0] = undefined.values()
    for b in range(len(f.blocks)):
        if b not in reached:
            f.blocks[b].instrs = []
    return order, idom


# -- values

_FOLD = {"Add": operator.add, "Sub": operator.sub, "Mult": operator.mul, "Div": operator.truediv, "FloorDiv": operator.floordiv, "Mod": operator.mod, "BitXor": operator.xor, "BitOr": operator.or_, "BitAnd": operator.and_}
_COMPARE = {"Eq": operator.eq, "NotEq": operator.ne, "Lt": operator.lt, "LtE": operator.le, "Gt": operator.gt, "GtE": operator.ge, "Is": lambda a, b: a is b or type(a) is type(b) and a == b, "IsNot": lambda a, b: not (a is b or type(a) is type(b) and a == b), "In": lambda a, b: a in b, "NotIn": lambda a, b: a not in b}
_UNARY = {"USub": operator.neg, "UAdd": operator.pos, "Invert": operator.invert, "Not": operator.not_}
_PLAIN = (int, float, bool, str, bytes, type(None))
TOP = object()


def constants(f: Function, order: list[int]) -> tuple[dict[int, object], set[tuple[int, int]]]:
    """Conditional constant propagation: value -> constant or TOP (no entry: never computed), and the executable edges."""
    value: dict[int, object] = {}
    edges: set[tuple[int, int]] = {(-1, ENTRY)}
    kinds = {b: f.blocks[b].succs for b in order}
    changed = True

    def meet(old: object, new: object) -> object:
        if old is _NONE:
            return new
        return old if new is _NONE or (old is not TOP and new is not TOP and type(old) is type(new) and old == new) else TOP

    while changed:
        changed = False
        for b in order:
            if not any(t == b for _, t in edges):
                continue
            truth: object = TOP
            for i in f.blocks[b].instrs:
                args = [value.get(v, _NONE) for _, _, _, v in i.args]
                if i.op == "const":
                    new = i.const if isinstance(i.const, _PLAIN) else TOP
                elif i.op == "phi":
                    new = _NONE
                    for (_, p, _, v) in i.args:
                        if (p, b) in edges:
                            new = meet(new, value.get(v, _NONE))
                elif i.op in ("binary", "compare", "unary") and all(isinstance(a, _PLAIN) for a in args):
                    new = _folded(i, args)
                elif i.op == "branch":
                    truth = args[0]
                    continue
                else:
                    new = TOP
                if i.result is not None:
                    old = value.get(i.result, _NONE)
                    new = meet(old, new)
                    if new is not _NONE and (old is _NONE or new is TOP and old is not TOP):
                        value[i.result], changed = new, True
            for t, kind in kinds[b]:
                if kind in ("then", "else") and isinstance(truth, _PLAIN) and bool(truth) != (kind == "then"):
                    continue
                if kind in ("then", "else") and truth is _NONE:
                    continue
                if (b, t) not in edges:
                    edges.add((b, t))
                    changed = True
    return value, edges


class _None:
    pass


_NONE = _None()


def _folded(i: Instr, args: list) -> object:
    try:
        if i.op == "unary":
            return _UNARY[i.text](args[0])
        if i.op == "compare":
            return _COMPARE[i.text](*args)
        if i.text == "Mult" and any(isinstance(a, (str, bytes)) for a in args) or i.text not in _FOLD:
            return TOP
        if i.text == "Mod" and isinstance(args[0], (str, bytes)):
            return TOP
        return _FOLD[i.text](*args)
    except Exception:  # what an operation would raise, it denotes nothing known
        return TOP


def classes(m: Module) -> list[tuple[str, int, list[str]]]:
    """(dotted name in the module, line, symbols of its bases) of every class of a file; '' where a base is no name."""
    out, stack = [], [(m.tree, "")]
    while stack:
        node, inside = stack.pop()
        for child in children(node):
            if isinstance(child, ast.ClassDef):
                written = [dotted(b.value if isinstance(b, ast.Subscript) else b) for b in child.bases if not isinstance(b, ast.Starred)]
                out.append((inside + child.name, child.lineno, [m.resolve(w) or (f"builtins.{w}" if hasattr(builtins, w) else "") for w in written]))
            named = isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef))
            stack.append((child, f"{inside}{child.name}." if named else inside))
    return out


INF = float("inf")


def ranges(f: Function, order: list[int], known: dict[int, object]) -> dict[int, tuple[float, float]]:
    """Intervals of numeric values, at a fixpoint; phis jump to infinity on a side that still grows after three rounds. What would
    move for very long is left unknown."""
    out: dict[int, tuple[float, float]] = {}
    unknown: set[int] = set()

    def numeric(c: object) -> bool:
        return isinstance(c, (int, float)) and not isinstance(c, bool) and c == c

    def times(a: float, b: float) -> float:
        return 0.0 if a == 0 or b == 0 else a * b

    for round_ in itertools.count():
        before = dict(out)
        for b in order:
            for i in f.blocks[b].instrs:
                if i.result is None or i.result in unknown:
                    continue
                c = known.get(i.result)
                args = [out.get(v) for _, _, _, v in i.args]
                new = None
                if numeric(c):
                    try:
                        new = (float(c), float(c))
                    except OverflowError:
                        new = (-INF, INF)
                elif i.op == "binary" and None not in args:
                    (a, b2), (c2, d) = args
                    if i.text == "Add":
                        new = (a + c2, b2 + d)
                    elif i.text == "Sub":
                        new = (a - d, b2 - c2)
                    elif i.text == "Mult":
                        ends = [times(x, y) for x in (a, b2) for y in (c2, d)]
                        new = (min(ends), max(ends))
                    elif i.text in ("Div", "FloorDiv", "Mod"):
                        new = (-INF, INF)
                elif i.op == "call" and i.text in ("len", "abs"):
                    new = (0.0, INF)
                elif i.op == "call" and i.text in ("int", "float", "round"):
                    new = (-INF, INF)
                elif i.op == "call" and i.text == "ord":
                    new = (0.0, float(0x10FFFF))
                elif i.op == "phi":
                    have = [x for x in args if x]
                    if have and (len(have) == len(args) or round_ == 0):
                        new = (min(x[0] for x in have), max(x[1] for x in have))
                        old = before.get(i.result)
                        if old and round_ >= 3:
                            new = (old[0] if new[0] >= old[0] else -INF, old[1] if new[1] <= old[1] else INF)
                if new is not None and new[0] == new[0] and new[1] == new[1]:
                    out[i.result] = new
                elif i.result in out and new is None:
                    del out[i.result]
        if out == before:
            return out
        if round_ >= 16 + 4 * len(order):  # each further round takes a value away
            moved = {v for v in out.keys() | before.keys() if out.get(v) != before.get(v)}
            unknown |= moved
            for v in moved:
                out.pop(v, None)


_SITES = {"build_list": "list", "build_tuple": "tuple", "build_set": "set", "build_dict": "dict", "call": "call", "with_enter": "context", "catch": "exception", "yield": "sent", "global": "global", "symbol": "symbol", "make_function": "function", "make_class": "class", "param": "parameter"}
_MUTATORS = frozenset("append add insert extend update setdefault appendleft push put".split())


def points_to(f: Function, order: list[int]) -> tuple[set[tuple[int, int]], set[tuple[int, str, int]]]:
    """(value, object) and (object, field, object): flow-insensitive, objects named by the value that makes them; fields are
    'elements' and 'attributes'. Stores only add."""
    to: dict[int, set[int]] = {}
    heap: dict[tuple[int, str], set[int]] = {}
    instrs = [i for b in order for i in f.blocks[b].instrs]
    callee = {i.result: i for i in instrs if i.op == "get_attr"}
    changed = True

    def add(target: set[int], more: set[int]) -> None:
        nonlocal changed
        if not more <= target:
            target |= more
            changed = True

    while changed:
        changed = False
        for i in instrs:
            have = {v: to.get(v, set()) for _, _, _, v in i.args}
            if i.result is not None and i.op in _SITES:
                add(to.setdefault(i.result, set()), {i.result})
            if i.op in ("phi", "await", "get_iter"):
                for _, _, _, v in i.args:
                    add(to.setdefault(i.result, set()), have[v])
            elif i.op.startswith("build_") and i.op in _SITES:
                for r, _, _, v in i.args:
                    if r == "element":
                        add(heap.setdefault((i.result, "elements"), set()), have[v])
            elif i.op in ("get_item", "get_attr", "for_next"):
                name = "attributes" if i.op == "get_attr" else "elements"
                for o in have[i.args[0][3]]:
                    add(to.setdefault(i.result, set()), heap.get((o, name), set()))
            elif i.op in ("set_item", "set_attr"):
                name = "attributes" if i.op == "set_attr" else "elements"
                for o in have[i.args[0][3]]:
                    for r, _, _, v in i.args[1:]:
                        if r == "value":
                            add(heap.setdefault((o, name), set()), have[v])
            elif i.op == "call" and i.args[0][3] in callee and callee[i.args[0][3]].text in _MUTATORS:
                for o in to.get(callee[i.args[0][3]].args[0][3], set()):
                    for r, _, _, v in i.args[1:]:
                        add(heap.setdefault((o, "elements"), set()), have[v])
    return {(v, o) for v, os in to.items() for o in os}, {(o, n, x) for (o, n), xs in heap.items() for x in xs}


def value_symbols(f: Function, order: list[int], module: str) -> dict[int, str]:
    """Canonical symbols of values: imports, definitions and builtins, their attributes, and what calling or entering them gives."""
    out: dict[int, str] = {}
    owner = f"{module}.{f.owner}" if f.owner else ""
    first = f.params[0][0] if f.params and owner and "builtins.staticmethod" not in f.decorators and "staticmethod" not in f.decorators else None
    for _ in range(3):
        before = len(out)
        for b in order:
            for i in f.blocks[b].instrs:
                if i.result is None:
                    continue
                base = out.get(i.args[0][3], "") if i.args else ""
                if i.op in ("symbol", "import"):
                    out[i.result] = i.text
                elif i.op == "param":
                    symbol = owner if i.text == first else i.const
                    if symbol:
                        out[i.result] = symbol
                elif i.op == "make_function":
                    out[i.result] = f"{module}.{i.text}"
                elif i.op == "make_class":
                    out[i.result] = f"{module}.{i.text}"
                elif i.op == "get_attr" and base:
                    out[i.result] = f"{base}.{i.text}"
                elif i.op in ("call", "get_item", "with_enter", "await") and base:
                    out[i.result] = base
                elif i.op == "phi":
                    found = {out[v] for _, _, _, v in i.args if v in out}
                    if len(found) == 1:
                        out[i.result] = found.pop()
        if len(out) == before:
            break
    return out


def leading_text(made: dict[int, Instr], value: int, depth: int = 32) -> tuple[str, bool]:
    """The constant text that a value begins with, through + and formatted strings, and whether it is the whole value."""
    i = made.get(value)
    if i is None or not depth:
        return "", False
    if i.op == "const" and isinstance(i.const, str):
        return i.const, True
    parts = [v for _, _, _, v in i.args] if i.op == "build_string" or i.op == "binary" and i.text == "Add" else []
    text = ""
    for v in parts:
        more, whole = leading_text(made, v, depth - 1)
        text += more
        if not whole:
            return text, False
    return text, bool(parts)


def parsed(text: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


def compiles(text: str) -> None:
    """Raises what the making of a file's scopes would."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        symtable.symtable(text, "<file>", "exec")


def scopes(text: str) -> list[tuple[int, int, str, str, int, list[tuple[str, str]]]]:
    """(scope, parent, kind, name, line, [(name, resolution)]) of a file, from the outermost scope inwards."""
    out = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        stack = [(symtable.symtable(text, "<file>", "exec"), -1)]
    while stack:
        table, parent = stack.pop(0)
        me = len(out)
        names = [(s.get_name(), "parameter" if s.is_parameter() else "imported" if s.is_imported() else "free" if s.is_free() else "declared_global" if s.is_declared_global() else "local" if s.is_local() else "global") for s in table.get_symbols()]
        out.append((me, parent, str(getattr(table.get_type(), "value", table.get_type())), table.get_name(), table.get_lineno(), sorted(names)))
        stack += [(c, me) for c in table.get_children()]
    return out
