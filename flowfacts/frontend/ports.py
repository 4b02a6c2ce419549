"""What reaches what inside one function: from its in-ports (parameters, results of calls, fields read, sources) to its out-ports
(what it returns, arguments of calls, fields written). Calls join the two elsewhere, so paths between functions stay short."""

from __future__ import annotations

from .lower import _MUTATORS, Function, Instr

#: Operations whose result holds what their operands hold. A comparison holds nothing of them.
PASSING = frozenset("binary unary bool_op build_list build_tuple build_set build_dict build_string build_slice phi await yield get_attr get_item get_iter for_next with_enter catch make_function unknown".split())


#: String methods that tell their object to be of a harmless form where they hold; fixed names.
VALIDATORS = frozenset(("isalnum", "isalpha", "isdecimal", "isdigit", "isidentifier", "isnumeric", "isupper"))
#: Calls whose truth tells their second argument to match a pattern that is written out.
MATCHERS = frozenset(("re.fullmatch",))


def guards(f: Function, order: list[int], idom: list[int | None]) -> dict[int, list[tuple[int, bool]]]:
    """For every block the (test value, truth) of the branches above it, along its dominators, that are passed on one side only."""
    succs = {b: [t for t, _ in f.blocks[b].succs] for b in order}
    reach: dict[tuple[int, int], set[int]] = {}

    def reached(start: int, avoiding: int) -> set[int]:
        if (start, avoiding) not in reach:
            seen, stack = set(), [start]
            while stack:
                b = stack.pop()
                if b != avoiding and b not in seen:
                    seen.add(b)
                    stack += succs.get(b, [])
            reach[start, avoiding] = seen
        return reach[start, avoiding]

    tests = {b: (f.blocks[b].instrs[-1].args[0][3], *(t for k in ("then", "else") for t, kind in f.blocks[b].succs if kind == k)) for b in order if f.blocks[b].instrs and f.blocks[b].instrs[-1].op == "branch"}
    out: dict[int, list[tuple[int, bool]]] = {}
    for b in order:
        found, up = [], b
        while up != idom[up]:
            up = idom[up]
            if up in tests and len(tests[up]) == 3:
                value, then, other = tests[up]
                a, c = b in reached(then, up), b in reached(other, up)
                if a != c:
                    found.append((value, a))
        out[b] = found
    return out


def proven(made: dict[int, Instr], symbols: dict[int, str], test: int, truth: bool) -> set[int]:
    """Values that a test of a known truth shows to be one of a few constants, or of a harmless form."""
    i = made.get(test)
    if i is None:
        return set()
    args = [v for _, _, _, v in i.args]

    def fixed(v: int) -> bool:
        x = made.get(v)
        return x is not None and (x.op == "const" or x.op in ("build_list", "build_tuple", "build_set") and bool(x.args) and all(fixed(w) for _, _, _, w in x.args))

    if i.op == "unary" and i.text == "Not":
        return proven(made, symbols, args[0], not truth)
    if i.op == "bool_op" and truth == (i.text == "And"):
        return set().union(*(proven(made, symbols, v, truth) for v in args))
    if i.op == "compare" and (i.text, truth) in (("Eq", True), ("NotEq", False)):
        return {a for a, b in (args, args[::-1]) if fixed(b)}
    if i.op == "compare" and (i.text, truth) in (("In", True), ("NotIn", False)) and fixed(args[1]) and made[args[1]].op != "const":
        return {args[0]}
    if i.op == "call" and truth:
        callee = made.get(args[0])
        if callee is not None and callee.op == "get_attr" and callee.text in VALIDATORS:
            return {callee.args[0][3]}
        if symbols.get(args[0]) in MATCHERS and len(args) > 2 and fixed(args[1]):
            return {args[2]}
    return set()


#: Attributes and methods whose truth means that the caller may do what follows; fixed names of web frameworks.
ALLOWING = frozenset("is_authenticated is_staff is_superuser is_admin has_perm has_perms has_module_perms has_permission has_role can".split())


def allows(made: dict[int, Instr], test: int, truth: bool) -> str:
    """The name by which a test of a known truth tells that someone may do what follows; '' if it doesn't."""
    i = made.get(test)
    if i is None:
        return ""
    args = [v for _, _, _, v in i.args]
    if i.op == "unary" and i.text == "Not":
        return allows(made, args[0], not truth)
    if i.op == "bool_op" and truth == (i.text == "And"):
        return next((name for v in args if (name := allows(made, v, truth))), "")
    if i.op == "call" and truth and args:
        return allows(made, args[0], truth)
    return i.text if i.op == "get_attr" and truth and i.text in ALLOWING else ""


def allowed_calls(f: Function, order: list[int], idom: list[int | None]) -> list[tuple[int, str]]:
    """(call, name) of the calls that are made only after a test that someone may."""
    if not any(i.op == "branch" for b in order for i in f.blocks[b].instrs):
        return []
    made = {i.result: i for b in order for i in f.blocks[b].instrs if i.result is not None}
    above = guards(f, order, idom)
    found = {b: next((name for t, truth in tests if (name := allows(made, t, truth))), "") for b, tests in above.items()}
    return [(i.result, found[b]) for b in order if found.get(b) for i in f.blocks[b].instrs if i.op == "call"]


def flows(f: Function, order: list[int], idom: list[int | None], symbols: dict[int, str], sources: tuple[str, ...]) -> list[tuple[str, int, str, str, int, int, str, bool]]:
    """(in kind, in number, in name, out kind, out call, out position, out name, guarded) of a function in SSA form.

    guarded: a branch above the call, passed on one side only, tests what flows. A flow to a call that meets nothing but values
    shown to be harmless above it is left out.

    In: param (index), result (call), field (class.attribute), source (value, symbol). Out: return, arg (call, position, keyword
    or ''; position -1 is the object whose method is called), field.
    """
    ahead: dict[int, set[int]] = {}
    ports_in: list[tuple[str, int, str, int]] = []
    ports_out: dict[int, list[tuple[str, int, int, str]]] = {}
    made = {i.result: i for b in order for i in f.blocks[b].instrs if i.result is not None}
    own = next((i.result for i in made.values() if i.op == "param" and f.owner and f.params and i.text == f.params[0][0]), None)
    index = {name: k for k, (name, _, _) in enumerate(f.params)}

    def edge(a: int, b: int) -> None:
        ahead.setdefault(a, set()).add(b)

    for b in order:
        for i in f.blocks[b].instrs:
            if i.op == "param":
                ports_in.append(("param", index[i.text], "", i.result))
            elif i.op in PASSING:
                for _, _, _, v in i.args:
                    edge(v, i.result)
            if i.op == "get_attr" and i.args[0][3] == own:
                ports_in.append(("field", 0, f"{f.owner}.{i.text}", i.result))
            if i.op == "call":
                ports_in.append(("result", i.result, "", i.result))
                for role, pos, name, v in i.args:
                    if role == "callee":
                        method = made.get(v)
                        if method is not None and method.op == "get_attr":
                            o = method.args[0][3]
                            ports_out.setdefault(o, []).append(("arg", i.result, -1, ""))
                            if method.text in _MUTATORS:
                                for r, _, _, x in i.args[1:]:
                                    edge(x, o)
                    else:
                        ports_out.setdefault(v, []).append(("arg", i.result, pos if role == "arg" else -2, name))
            elif i.op == "return":
                ports_out.setdefault(i.args[0][3], []).append(("return", 0, 0, ""))
            elif i.op in ("set_attr", "set_item"):
                o = i.args[0][3]
                for role, _, _, v in i.args[1:]:
                    if role == "value":
                        edge(v, o)
                        if o == own and i.op == "set_attr":
                            ports_out.setdefault(v, []).append(("field", 0, 0, f"{f.owner}.{i.text}"))
            symbol = symbols.get(i.result, "") if i.result is not None else ""
            if symbol and i.op in ("symbol", "get_attr", "call", "param"):
                for s in sources:
                    if symbol == s or symbol.startswith(s + "."):
                        base = symbols.get(i.args[0][3], "") if i.args else ""
                        if i.op == "call" or not (base == s or base.startswith(s + ".")):
                            ports_in.append(("source", i.result, symbol, i.result))
                        break
    block = {i.result: b for b in order for i in f.blocks[b].instrs if i.op == "call"}
    above = guards(f, order, idom) if any(i.op == "branch" for b in order for i in f.blocks[b].instrs) else {}
    safe = {b: set().union(*(proven(made, symbols, t, truth) for t, truth in found)) if found else set() for b, found in above.items()}

    def reached(start: int, without: set[int]) -> set[int]:
        seen, stack = ({start}, [start]) if start not in without else (set(), [])
        while stack:
            for nxt in ahead.get(stack.pop(), ()):
                if nxt not in seen and nxt not in without:
                    seen.add(nxt)
                    stack.append(nxt)
        return seen

    out = []
    for kind, number, name, value in ports_in:
        whole = reached(value, set())
        tested: dict[int, bool] = {}
        for v in sorted(whole):
            for o in ports_out.get(v, ()):
                at = block.get(o[1]) if o[0] == "arg" else None
                if at is not None and safe.get(at) and v not in reached(value, safe[at]):
                    continue
                if at is not None and at not in tested:
                    tested[at] = any(_depends(made, t, whole) for t, _ in above.get(at, ()))
                out.append((kind, number, name, *o, tested.get(at, False)))
    return list(dict.fromkeys(out))


def _depends(made: dict[int, Instr], test: int, values: set[int]) -> bool:
    """Whether a test's value is computed from one of the values."""
    seen, stack = set(), [test]
    while stack:
        v = stack.pop()
        if v in values:
            return True
        if v not in seen and v in made:
            seen.add(v)
            stack += [w for _, _, _, w in made[v].args]
    return False
