"""One template file to items: what it prints and calls, in order, and what its text does to the place in the markup it begins in.

A place in the markup is one of a few states. Text moves from state to state, a printed value stays where it is and is harmless
in some states only. So a run of text and values is a function of states, and a page is the composition of such functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

#: Where inside a tag: between attributes, in an attribute's name, before a plain, address or dangerous value, in one in double or
#: single quotes, in one without quotes.
INSIDE = ("between", "name", "before plain", "before address", "before code", '" plain', '" address', '" code', "' plain", "' address", "' code", "bare")
#: Elements whose content is code. (That of title and textarea is read as other text is.)
RAW = ("script", "style")
STATES = ("text", "comment", *RAW, *(f"{i}|{tag}" for tag in ("", *RAW) for i in INSIDE))
NUMBER = {s: n for n, s in enumerate(STATES)}
#: Bit of a value that is not escaped where it stands; the bits below are states.
BAD = 1 << 62
#: States in which an escaped value is harmless.
HARMLESS = frozenset(n for s, n in NUMBER.items() if s in ("text", "comment") or s.split("|")[0] in ('" plain', "' plain"))
#: Attributes that hold addresses. Fixed values of HTML.
ADDRESSES = frozenset("action background cite classid codebase data formaction href icon longdesc manifest ping poster src srcset usemap xlink:href".split())
#: Beginnings of an address after which nothing changes what kind of address it is.
SETTLED = re.compile(r"\s*(?:https?://|mailto:|tel:|[/?#.]|[A-Za-z0-9_-]+/)", re.I)

#: Tags that print nothing unescaped and call nothing, filters that keep or make values escaped, and libraries that have none but
#: such. Names of Django's own.
TAGS = frozenset("if elif else endif for empty endfor with endwith load csrf_token now url trans translate blocktrans blocktranslate endblocktrans endblocktranslate plural spaceless endspaceless firstof cycle resetcycle ifchanged endifchanged "
                 "regroup widthratio templatetag static get_static_prefix get_media_prefix lorem endblock autoescape endautoescape get_current_language get_available_languages language endlanguage localize endlocalize".split())
DEEPER = frozenset("if for with ifchanged".split())
HIGHER = frozenset("endif endfor endwith endifchanged".split())
UNSAFE_FILTERS = frozenset("safe safeseq".split())
FILTERS = frozenset("add addslashes capfirst center cut date default default_if_none dictsort dictsortreversed divisibleby escape escapejs filesizeformat first floatformat force_escape get_digit iriencode join json_script last length length_is linebreaks linebreaksbr "
                    "linenumbers ljust lower make_list phone2numeric pluralize pprint random rjust slice slugify stringformat striptags time timesince timeuntil title truncatechars truncatechars_html truncatewords truncatewords_html unordered_list upper urlencode urlize urlizetrunc wordcount wordwrap yesno localize unlocalize intcomma".split())
LIBRARIES = frozenset("static i18n l10n tz cache humanize".split())

PIECE = re.compile(r"\{\{(?P<value>.*?)\}\}|\{%(?P<tag>.*?)%\}|\{#.*?#\}")
CONSTANT = re.compile(r"""^(?:"([^"]*)"|'([^']*)')$""")
VERBATIM = re.compile(r"\{%\s*end(?:comment|verbatim)\s*%\}")


def _begun(tag: str) -> str:
    return tag if tag in RAW else ""


@lru_cache(maxsize=100_000)
def moved(state: int, text: str) -> int:
    """The state after a text. What is cut inside an attribute's name counts as dangerous."""
    name, at = STATES[state], 0
    where, _, tag = name.partition("|")
    if name in ("text", "comment", *RAW):
        where, tag = name, ""
    address = ""
    while at < len(text):
        if where == "text":
            found = re.compile(r"<!--|<(/?)([A-Za-z][^\s/>]*)").search(text, at)
            if not found:
                return NUMBER["text"]
            at = found.end()
            where, tag = ("comment", "") if found[0] == "<!--" else ("between", "" if found[1] else _begun(found[2].lower()))
        elif where == "comment" or where in RAW:
            found = (re.compile("-->") if where == "comment" else re.compile(f"</{where}(?=[\\s/>])", re.I)).search(text, at)
            if not found:
                return NUMBER[where]
            at, where, tag = found.end(), "text" if where == "comment" else "between", ""
        elif where == "between":
            found = re.compile(r"[\s/]*(>|=?[^\s=>/]+)?").match(text, at)
            at = found.end()
            if found[1] == ">":
                where, tag = tag or "text", ""
            elif found[1]:
                own = found[1].lower()
                equal = re.compile(r"\s*=\s*").match(text, at)
                if at == len(text):
                    where = "name"
                elif equal:
                    at, where = equal.end(), "before code" if own.startswith("on") or own in ("style", "srcdoc") else "before address" if own in ADDRESSES else "before plain"
        elif where == "name":
            found = re.compile(r"[^\s=>/]*\s*(=)?\s*").match(text, at)
            at, where = found.end(), "before code" if found[1] else "between"
        elif where.startswith("before "):
            found = re.compile(r"\s*([\"'>])?").match(text, at)
            at = found.end()
            if found[1] == ">":
                where, tag = tag or "text", ""
            elif found[1]:
                where, address = f"{found[1]} {where[7:]}", ""
            elif at < len(text):
                where = "bare"
        elif where == "bare":
            found = re.compile(r"[^\s>]*").match(text, at)
            at = found.end()
            if at < len(text):
                where = "between"
        else:
            end = text.find(where[0], at)
            if where.endswith("address") and SETTLED.match(text[at : end if end >= 0 else len(text)]):
                where = f"{where[0]} plain"
            if end < 0:
                return NUMBER[f"{where}|{tag}"]
            at, where = end + 1, "between"
    return NUMBER[where if where in ("text", "comment", *RAW) else f"{where}|{tag}"]


def printed(expression: str) -> bool:
    """Whether an expression's value is escaped when it is printed: no filter that marks it safe, none that is not known."""
    bare = re.sub(r"\"[^\"]*\"|'[^']*'", "x", expression)
    filters = [f.split(":")[0].strip() for f in bare.split("|")[1:]]
    return all(f in FILTERS and f not in UNSAFE_FILTERS for f in filters)


class Run:
    """A run of text and values: the state and harm from each state it may begin in."""

    def __init__(self) -> None:
        self.now: list[tuple[int, bool]] = [(n, False) for n in range(len(STATES))]
        self.empty = True

    def text(self, text: str) -> None:
        if text:
            self.empty = False
            to = {s: moved(s, text) for s in {s for s, _ in self.now}}
            self.now = [(to[s], bad) for s, bad in self.now]

    def value(self, escaped: bool) -> None:
        self.empty = False
        self.now = [(s, bad or not escaped or s not in HARMLESS) for s, bad in self.now]

    def function(self) -> list[int]:
        return [1 << s | (BAD if bad else 0) for s, bad in self.now]


def items(text: str | None) -> Iterator[dict]:
    """The items of a file: block (that it stands in, '' for none), place, kind, ref, optional, f.

    kind: 'run' (f is its function), 'block' and 'super' (ref is a block), 'include' and 'extends' (ref is a template's name).
    What can't be read (a tag, filter or library that is not known, a name that is no constant, escaping that is turned off, a
    null text) is a run that harms from every state. Comments and verbatim text are read to their end.
    """
    blocks, runs, places, depth, verbatim = [""], {"": Run()}, {"": 0}, 0, None

    def flush() -> Iterator[dict]:
        own = blocks[-1]
        if not runs[own].empty:
            yield emit("run", "", runs[own].function())
        runs[own] = Run()

    def emit(kind: str, ref: str, f: list[int] | None = None) -> dict:
        own = blocks[-1]
        places[own] += 1
        return {"block": own, "place": places[own], "kind": kind, "ref": ref, "optional": depth > 0, "f": f}

    def run() -> Run:
        return runs[blocks[-1]]

    if text is None:
        run().value(False)
        text = ""
    at = 0
    while at <= len(text):
        found = PIECE.search(text, at)
        run().text(text[at : found.start() if found else len(text)])
        if not found:
            break
        at = found.end()
        if found["value"] is not None:
            if found["value"].strip() == "block.super" and blocks[-1]:
                yield from flush()
                yield emit("super", blocks[-1])
            else:
                run().value(printed(found["value"]))
        words = (found["tag"] or "").split()
        if not words:
            continue
        tag, rest = words[0], words[1:]
        if tag in ("comment", "verbatim"):
            end = VERBATIM.search(text, at)
            if tag == "verbatim":
                run().text(text[at : end.start() if end else len(text)])
            at = end.end() if end else len(text) + 1
        elif tag in ("include", "extends"):
            name = CONSTANT.match(rest[0]) if rest else None
            yield from flush()
            if name and (tag == "include" or blocks == [""]):
                yield emit(tag, name[1] if name[1] is not None else name[2])
            else:
                run().value(False)
        elif tag == "block":
            if len(rest) != 1 or rest[0] in places:
                run().value(False)
            if rest:
                yield from flush()
                yield emit("block", rest[0])
                blocks.append(rest[0])
                runs.setdefault(rest[0], Run())
                places.setdefault(rest[0], 0)
        elif tag == "endblock":
            yield from flush()
            if len(blocks) > 1:
                blocks.pop()
        elif tag not in TAGS or (tag == "load" and not set(rest[rest.index("from") + 1 :] if "from" in rest else rest) <= LIBRARIES) or (tag == "autoescape" and rest != ["on"]):
            run().value(False)
        elif tag in ("firstof", "cycle", "trans", "translate"):
            run().value(all(printed(w) for w in rest))
        depth = max(0, depth + (tag in DEEPER) - (tag in HIGHER))
    yield from flush()
    while len(blocks) > 1:
        blocks.pop()
        yield from flush()
