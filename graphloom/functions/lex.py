"""Facts from TypeScript and C# source by token streams.

Comments and strings are told apart first, so nothing inside them is mistaken for
code.  What cannot be known without evaluating code (computed specifiers, joined
URLs, route constants) gives no fact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import dealt

_COMMENT = r"(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))"
_TS = re.compile(_COMMENT + r"""|(?P<s>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<t>`(?:\\.|[^`\\])*`)|(?P<i>[A-Za-z_$][\w$]*)|(?P<n>\d[\w.]*)|(?P<p>=>|\.\.\.|[^\s\w])""", re.S)
_CS = re.compile(_COMMENT + r"""|(?P<s>[$]?@"(?:""|[^"])*"|[$]?"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])+')|(?P<t>\Z(?!\Z))|(?P<i>[A-Za-z_]\w*)|(?P<n>\d[\w.]*)|(?P<p>=>|[^\s\w])""", re.S)
VERBS = ("get", "post", "put", "patch", "delete")
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Token(NamedTuple):
    kind: str  # s string, t template, i identifier, n number, p sign
    text: str
    at: int


class Endpoint(NamedTuple):
    url: str
    method: str
    action: str | None
    strategy: str


@lru_cache(maxsize=4)
def tokens(source: str, language: str) -> list[Token]:
    """Not to be changed: all that is read from a file shares its tokens."""
    pattern = _CS if language == "csharp" else _TS
    return [Token(m.lastgroup, m[0], m.start()) for m in pattern.finditer(source) if m.lastgroup != "c" and m[0]]


def literal(token: Token) -> str | None:
    """The value of a string or template without parameters."""
    if token.kind == "s":
        body = token.text.lstrip("$@")[1:-1]
        return body.replace('""', '"') if token.text.lstrip("$").startswith("@") else re.sub(r"\\(.)", r"\1", body)
    return token.text[1:-1] if token.kind == "t" else None


def closing(ts: list[Token], i: int) -> int:
    """Index of the sign that closes the one at i, or the end."""
    depth = 0
    for j in range(i, len(ts)):
        if ts[j].kind == "p":
            depth += (ts[j].text in _PAIRS) - (ts[j].text in _PAIRS.values())
            if depth == 0:
                return j
    return len(ts)


def split(ts: list[Token]) -> list[list[Token]]:
    """Tokens cut at commas outside of brackets."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in ts:
        if t.kind == "p":
            depth += (t.text in _PAIRS) - (t.text in _PAIRS.values())
            if t.text == "," and depth == 0:
                out.append([])
                continue
        out[-1].append(t)
    return [x for x in out if x]


def module_references(source: str) -> list[tuple[str, str, int]]:
    """(specifier, kind, position): imports and re-exports are static, import() of a literal is dynamic."""
    ts, out = tokens(source, "typescript"), []
    for i, t in enumerate(ts):
        if t.kind != "i" or t.text not in ("import", "export") or (i and ts[i - 1].text == "."):
            continue
        rest = ts[i + 1 :]
        if t.text == "import" and rest and rest[0].kind == "s":
            out.append((literal(rest[0]), "static", t.at))
        elif t.text == "import" and rest and rest[0].text == "(":
            inner = rest[1 : closing(rest, 0)]
            if len(inner) == 1 and inner[0].kind in "st" and "${" not in inner[0].text:
                out.append((literal(inner[0]), "dynamic", t.at))
        else:
            for a, b in zip(rest, rest[1:], strict=False):
                if a.text == "from" and b.kind == "s":
                    out.append((literal(b), "static", t.at))
                    break
                if a.kind == "s" or a.text in (";", "=", "(", "function", "class", "const", "let", "import"):
                    break
    return out


def test_cases(source: str) -> int:
    """Calls of it and test, also by their only, skip, todo, concurrent and each forms."""
    ts, n = tokens(source, "typescript"), 0
    for i, t in enumerate(ts):
        if t.kind == "i" and t.text in ("it", "test") and not (i and ts[i - 1].text == "."):
            j = i + 1
            while j + 1 < len(ts) and ts[j].text == "." and ts[j + 1].text in ("only", "skip", "todo", "concurrent", "each"):
                j += 2
            n += j < len(ts) and ts[j].text == "("
    return n


def url_bindings(ts: list[Token]) -> dict[str, str]:
    """Names bound to a literal that starts with /api."""
    out = {}
    for a, eq, v in zip(ts, ts[1:], ts[2:], strict=False):
        if a.kind == "i" and eq.text in ("=", ":") and (value := literal(v)) and value.startswith("/api") and "${" not in value:
            out.setdefault(a.text, value)
    return out


def resolved_url(ts: list[Token], bound: dict[str, str]) -> str | None:
    """A literal, a bound name or a template of such; parameters become {}."""
    if len(ts) == 3 and ts[0].text == "this" and ts[1].text == ".":
        ts = ts[2:]
    if len(ts) != 1:
        return None
    if ts[0].kind == "i":
        return bound.get(ts[0].text)
    value = literal(ts[0])
    if value is None:
        return None
    if ts[0].kind == "t":
        value = re.sub(r"\$\{(?:this\.)?([^}]*)\}", lambda m: bound.get(m[1].strip(), "{}"), value)
    return value if value.startswith("/api") else None


def exported_bindings(source: str) -> list[tuple[str, str]]:
    """(name, value) of exported constants of a module that are bound to a literal that starts with /api; of a name the last."""
    ts, out, depth = tokens(source, "typescript"), {}, 0
    for i, t in enumerate(ts):
        if t.kind == "p":
            depth += (t.text in _PAIRS) - (t.text in _PAIRS.values())
        elif depth == 0 and t.text == "export" and i + 1 < len(ts) and ts[i + 1].text in ("const", "let", "var"):
            end = i + 2
            inner = 0
            while end < len(ts) and not (inner == 0 and (ts[end].text == ";" or ts[end].text == "export")):
                inner += (ts[end].text in _PAIRS) - (ts[end].text in _PAIRS.values())
                end += 1
            for part in split(ts[i + 2 : end]):
                at = next((k for k, x in enumerate(part) if x.text == "="), None)
                if part[0].kind == "i" and at and at + 1 < len(part) and (value := literal(part[at + 1])) and value.startswith("/api") and (at + 2 == len(part) or part[at + 2].text != "+"):
                    out[part[0].text] = value
    return list(out.items())


def named_imports(source: str) -> list[tuple[str, str, str]]:
    """(specifier, exported name, local name) of the names that import statements take from a module."""
    ts, out = tokens(source, "typescript"), []
    for i, t in enumerate(ts):
        if t.text != "import" or t.kind != "i" or i and ts[i - 1].text == ".":
            continue
        begin = next((j for j in range(i + 1, min(i + 5, len(ts))) if ts[j].text == "{"), None)
        if begin is None:
            continue
        end = closing(ts, begin)
        if end + 2 < len(ts) and ts[end + 1].text == "from" and ts[end + 2].kind == "s":
            for part in split(ts[begin + 1 : end]):
                names = [x.text for x in part if x.kind == "i"]
                names = names[1:] if names[:1] == ["type"] and len(names) > 1 and names[1] != "as" else names
                if names:
                    out.append((literal(ts[end + 2]), names[0], names[2] if len(names) > 2 and names[1] == "as" else names[0]))
    return out


_PREFIX = re.compile(r"""\(\s*/(?P<pattern>(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\n\[])+)/[a-z]*\s*,\s*(['"`])(?P<to>/api/v\d+/)\2\s*,?\s*\)""")


def version_prefix(source: str) -> str | None:
    """The first /api/vN/ that a replacement puts in the place of a pattern that speaks of api."""
    ts = tokens(source, "typescript")
    for before, t, after in zip(ts, ts[1:], ts[2:], strict=False):
        if before.text == "." and t.text == "replace" and after.text == "(" and (m := _PREFIX.match(source, after.at)) and "api" in m["pattern"]:
            return m["to"]
    return None


#: Names of base addresses, and hooks and calls that say that a component behaves.
BASE_NAMES = ("baseUrl", "baseURL", "BASE_URL", "authenticationUrl")
BEHAVIOUR_HOOKS = ("useState", "useEffect", "useMemo", "useCallback", "useReducer", "useRef", "useQuery", "useMutation", "useForm", "useNavigate", "useParams", "useSearchParams")
BEHAVIOUR_CALLS = ("request", "get", "post", "put", "patch", "delete")
BEHAVIOURS = ("hooks", "handlers", "async", "api/service/repository calls", "state updates", "side effects")


def behaviours(source: str) -> list[str]:
    """What a front file does besides showing, in a fixed order."""
    ts, found = tokens(source, "typescript"), set()
    for name, _ in calls(source):
        if name in BEHAVIOUR_HOOKS:
            found.add("hooks")
        if re.match(r"set[A-Z]", name):
            found.add("state updates")
        if name in BEHAVIOUR_CALLS:
            found.add("api/service/repository calls")
    for i, t in enumerate(ts):
        if t.kind != "i":
            continue
        if t.text == "await" or t.text == "async" and i + 1 < len(ts) and ts[i + 1].text not in (":", ",", "=", ")", "."):
            found.add("async")
        elif t.text in BROWSER_NAMES:
            found.add("side effects")
        elif t.text == "apiClient" or re.search(r"(?:[Rr]epository|[Ss]ervice)\Z", t.text):
            found.add("api/service/repository calls")
        elif re.match(r"(?:handle|on)[A-Z]", t.text) and i and ts[i - 1].text in ("const", "let", "var", ",") and _is_arrow(ts, i + 1):
            found.add("handlers")
    return [b for b in BEHAVIOURS if b in found]


def _is_arrow(ts: list[Token], i: int) -> bool:
    """Whether what is assigned after a name at i - 1 is an arrow function."""
    end = i
    while end < len(ts) and ts[end].text not in ("=", ";", ","):
        end = closing(ts, end) + 1 if ts[end].text in _PAIRS else end + 1
    j = end + 1
    if end >= len(ts) or ts[end].text != "=" or j >= len(ts):
        return False
    j += ts[j].text == "async"
    if j < len(ts) and ts[j].text == "(":
        j = closing(ts, j) + 1
        while j < len(ts) and ts[j].text not in ("=>", ";", ",", "="):  # a type of the result
            j = closing(ts, j) + 1 if ts[j].text in _PAIRS else j + 1
        return j < len(ts) and ts[j].text == "=>"
    return j + 1 < len(ts) and ts[j].kind == "i" and ts[j + 1].text == "=>"


def open_endpoints(source: str) -> list[Endpoint]:
    """Calls whose address begins with a name that the file does not bind; the name stands as ${name} in the url."""
    ts = tokens(source, "typescript")
    bound = url_bindings(ts)
    names = {local for _, _, local in named_imports(source)} | set(BASE_NAMES)
    opened = {n: f"/api\x00{n}\x01" for n in names if n not in bound}
    found = [e for e in _calls_of_api(ts, bound | opened) if "\x00" in e.url]
    return [e._replace(url=re.sub(r"(?:/api)?\x00(\w+)\x01", r"${\1}", e.url)) for e in found]


def _properties(ts: list[Token]) -> dict[str, list[Token]]:
    if not ts or ts[0].text != "{":
        return {}
    return {p[0].text: p[2:] for p in split(ts[1 : closing(ts, 0)]) if len(p) > 2 and p[1].text == ":"}


def _method(ts: list[Token] | None, default: str) -> str | None:
    if not ts:
        return default
    value = literal(ts[0]) if len(ts) == 1 else None
    return value.upper() if value and value.lower() in VERBS else None


def frontend_endpoints(source: str) -> list[Endpoint]:
    """Calls of the API, the first of each (method, url); ANY only where the url has no method of its own."""
    ts = tokens(source, "typescript")
    found = _calls_of_api(ts, url_bindings(ts))
    own = {e.url for e in found if e.method != "ANY"}
    kept = {(e.url, e.method): e for e in reversed(found) if e.method != "ANY" or e.url not in own}
    return [e for e in found if kept.get((e.url, e.method)) is e]


def _calls_of_api(ts: list[Token], bound: dict[str, str]) -> list[Endpoint]:
    found = []
    for i, t in enumerate(ts):
        if t.kind != "i":
            continue
        j = i + 1
        if j < len(ts) and ts[j].text == "<":  # type arguments
            depth, j = 1, j + 1
            while j < len(ts) and depth and ts[j].text not in (";", ")"):
                depth += (ts[j].text == "<") - (ts[j].text == ">")
                j += 1
        if j >= len(ts) or ts[j].text != "(":
            continue
        args = split(ts[j + 1 : closing(ts, j)])
        if not args:
            continue
        of_this = i >= 2 and ts[i - 1].text == "." and ts[i - 2].text == "this"
        free = not (i and ts[i - 1].text == ".")
        name, verb, props = t.text, t.text.lower().replace("del", "delete") if t.text == "del" else t.text.lower(), _properties(args[0])
        url = resolved_url(args[0], bound)
        if name == "fetch" and free and url:
            method, how = _method(_properties(args[1]).get("method") if len(args) > 1 else None, "GET"), "fetch"
        elif of_this and url and (verb in VERBS or verb.startswith("request")):
            method, how = verb.upper() if verb in VERBS else "ANY", "instance-methods"
        elif free and url and verb in VERBS:
            method, how = verb.upper(), "free-functions"
        elif "url" in props and (name == "request" or "method" in props):
            url, method, how = resolved_url(props["url"], bound), _method(props.get("method"), "ANY"), "request-objects" if name == "request" else "object-arguments"
        elif len(args) > 1 and (method := _method(args[0], "")):
            url, how = resolved_url(args[1], bound), "positional-methods"
        else:
            continue
        if url and method:
            found.append(Endpoint(url, method, None, how))
    return found


def _attribute(ts: list[Token], i: int) -> tuple[str, list[Token], int]:
    """Name and arguments of the attribute that opens at i, and where it ends."""
    end = closing(ts, i)
    inner = ts[i + 1 : end]
    return inner[0].text if inner else "", inner[2:-1] if len(inner) > 2 and inner[1].text == "(" else [], end


def type_declarations(source: str) -> list[tuple[str, str, list[str]]]:
    """(kind, name, base types) of C# classes, interfaces, records and structs."""
    ts, out = tokens(source, "csharp"), []
    for i, t in enumerate(ts[:-1]):
        if t.kind == "i" and t.text in ("class", "interface", "record", "struct") and ts[i + 1].kind == "i" and ts[i + 1].text not in ("class", "struct"):
            j, depth = i + 2, 0
            while j < len(ts) and not (depth == 0 and ts[j].text in (":", "{", ";")):
                depth += (ts[j].text in ("(", "<")) - (ts[j].text in (")", ">"))
                j += 1
            bases = []
            if j < len(ts) and ts[j].text == ":":
                k = j + 1
                while k < len(ts) and ts[k].text not in ("{", ";", "where"):
                    k += 1
                depth, fresh = 0, True
                for b in ts[j + 1 : k]:
                    depth += (b.text in ("(", "<")) - (b.text in (")", ">"))
                    if b.text == "," and depth == 0:
                        fresh = True
                    elif fresh and b.kind == "i":
                        bases.append(b.text)
                        fresh = False
                    elif b.text == "." and depth == 0:
                        bases.pop()
                        fresh = True
            out.append((t.text, ts[i + 1].text, bases))
    return out


def controller_endpoints(source: str) -> list[Endpoint]:
    """Actions of controllers with literal routes."""
    ts, out, route = tokens(source, "csharp"), [], None
    i = 0
    pending: list[tuple[str, str]] = []
    while i < len(ts):
        t = ts[i]
        if t.text == "[" and (i == 0 or ts[i - 1].text in ("]", "{", "}", ";", ")") or ts[i - 1].kind != "i"):
            name, args, i = _attribute(ts, i)
            value = literal(args[0]) if len(args) == 1 else None
            if name == "Route":
                route = value
            elif name.startswith("Http") and name[4:].lower() in VERBS and (value is not None or not args):
                pending.append((name[4:].upper(), value or ""))
        elif t.text == "class":
            if not (i + 1 < len(ts) and ts[i + 1].text.endswith("Controller")):
                route = None
        elif t.kind == "i" and pending and i + 1 < len(ts) and ts[i + 1].text == "(":
            for verb, part in pending if route is not None else []:
                out.append(Endpoint("/" + "/".join(x.strip("/") for x in (route, part) if x), verb, t.text, "controller"))
            pending = []
        i += 1
    return out


def db_sets(source: str) -> list[tuple[str, str]]:
    """(entity, property) of DbSet properties."""
    ts = tokens(source, "csharp")
    return [(ts[i + 2].text, ts[i + 4].text) for i in range(len(ts) - 4) if ts[i].text == "DbSet" and ts[i + 1].text == "<" and ts[i + 3].text == ">" and ts[i + 4].kind == "i"]


def table_name(source: str) -> str | None:
    """The literal of ToTable("name")."""
    ts = tokens(source, "csharp")
    return next((literal(ts[i + 2]) for i in range(len(ts) - 2) if ts[i].text == "ToTable" and ts[i + 1].text == "(" and ts[i + 2].kind == "s"), None)


_REQUEST = re.compile(r"(Query|Command)\Z")


def dispatched_requests(source: str) -> list[str]:
    """Distinct names that end in Query or Command of types that are created or that parameters have, in order."""
    ts, found = tokens(source, "csharp"), []
    for i, t in enumerate(ts[:-1]):
        if t.kind != "i" or not _REQUEST.search(t.text):
            continue
        created = i and ts[i - 1].text == "new" and ts[i + 1].text in ("(", "{", "<")
        # A parameter: a type, a name, and then the next one or the end, within the brackets of a declaration.
        opened = i and ts[i - 1].text in ("(", ",", "]", "in", "ref", "this")
        parameter = opened and ts[i + 1].kind == "i" and i + 2 < len(ts) and ts[i + 2].text in (",", ")", "=")
        if created or parameter:
            found.append(t.text)
    return list(dict.fromkeys(found))


#: Signs and words after which, and signs and words before which, any is no type but a name.
_NAMED_BEFORE = (".", "function", "class", "const", "let", "var", "new", "import", "export", "interface", "enum", "namespace", "get", "set", "return", "await", "typeof")
_NAMED_AFTER = (":", "(", ".", "?.", "++", "--", "+", "-", "*", "/")


def any_types(source: str) -> list[tuple[str, int]]:
    """(how it is written, position) of each any that stands for a type: after a colon, as, an equals sign of a type,
    an arrow of a function type, keyof, extends or a bar, as an argument, a default or an assertion.

    Type aliases and type parameters are told from values by what opens them.
    """
    ts, out = tokens(source, "typescript"), []
    typed = _typed_places(ts)
    for i, t in enumerate(ts):
        if t.text != "any" or t.kind != "i" or not i:
            continue
        before, after = ts[i - 1], ts[i + 1].text if i + 1 < len(ts) else ""
        if before.text in _NAMED_BEFORE or after in _NAMED_AFTER and not (after == ":" and "?" in (x.text for x in ts[max(0, i - 12) : i]) and i in typed):
            continue
        if before.text in ("as", "satisfies"):
            out.append(("as any" if before.text == "as" else ": any", t.at))
        elif before.text == "<" and i > 1 and ts[i - 2].text == "Array":
            out.append(("Array<any>", t.at))
        elif before.text == "<" and after == ">" and (i < 2 or ts[i - 2].kind == "p") and not (i + 2 < len(ts) and ts[i + 2].text == "("):
            out.append(("<any>", t.at))
        elif before.text in (":", "<", "|", "&", "keyof", "extends", "is", "readonly", "infer") or i in typed:
            out.append((": any", t.at))
    return out


def _typed_places(ts: list[Token]) -> set[int]:
    """Indices of tokens in the right side of a type alias, between angle brackets that hold types, and in a type after a colon."""
    out: set[int] = set()
    for i, t in enumerate(ts):
        if t.kind == "i" and t.text == "type" and i + 1 < len(ts) and ts[i + 1].kind == "i" and (not i or ts[i - 1].text in (";", "}", "export", "declare", "{", ")") or ts[i - 1].kind in "sin"):
            out.update(range(i + 2, _end_of_type(ts, i + 2)))
        elif t.text == "<" and i and ts[i - 1].kind == "i":
            depth = 0
            for j in range(i, len(ts)):
                depth += (ts[j].text == "<") - (ts[j].text == ">")
                if depth == 0:
                    out.update(range(i + 1, j))
                    break
                if ts[j].text in (";", "&&", "||") or ts[j].kind == "n":
                    break
        elif t.text == ":" and i and (ts[i - 1].kind == "i" or ts[i - 1].text in (")", "?", "]")):
            end = _end_of_type(ts, i + 1, in_list=True)
            if any(x.text == "=>" for x in ts[i + 1 : end]) and ts[i + 1].text == "(" or ts[i + 1 : i + 2] and ts[i + 1].text == "[":
                # A function type, or a tuple: (a: any) => any, [any, string]; a value would hold no bare any.
                out.update(range(i + 1, end))
    return out


def _end_of_type(ts: list[Token], i: int, in_list: bool = False) -> int:
    """Index after a type that begins at i: at a semicolon, at a bracket that closes more than it opened, at what begins a statement."""
    depth = 0
    for j in range(i, len(ts)):
        text = ts[j].text
        depth += (text in ("(", "[", "{", "<")) - (text in (")", "]", "}", ">"))
        if depth < 0 or depth == 0 and (text == ";" or in_list and text in (",", "=") or ts[j].kind == "i" and text in ("const", "let", "var", "export", "import", "function", "class", "interface", "type") and j > i + 1):
            return j
    return len(ts)


def route_shape(source: str) -> list[tuple[str, int]]:
    """(what, last position) of things that a route file should leave to others."""
    ts, out = tokens(source, "typescript"), {}
    for i, t in enumerate(ts):
        after = ts[i + 1].text if i + 1 < len(ts) else ""
        if t.kind == "i" and t.text == "lazy" and after == "(":
            out["lazy()"] = t.at
        elif t.kind == "i" and t.text in ("Suspense", "RequirePermission", "AccessDenied"):
            out[t.text] = t.at
        elif t.text == "React" and after == "." and i + 2 < len(ts) and ts[i + 2].text == "ComponentType":
            out["React.ComponentType"] = t.at
        elif after == ":" and (t.text == "permission" or t.kind == "s" and literal(t) == "permission") and i and ts[i - 1].text in ("{", ","):
            out["permission in route config"] = t.at
    return list(out.items())


def thick_controller(source: str) -> list[tuple[str, int]]:
    """(what, last position) of things that a controller should leave to handlers."""
    ts, out = tokens(source, "csharp"), {}
    for i, t in enumerate(ts):
        after = ts[i + 1].text if i + 1 < len(ts) else ""
        if t.kind != "i":
            continue
        if t.text in ("_dbContext", "DbContext") or t.text == "Set" and after == "<":
            out["direct persistence access"] = t.at
        elif t.text == "SaveChangesAsync" and after == "(":
            out["direct save changes"] = t.at
        elif t.text in ("for", "foreach", "while") and after == "(":
            out["loop in controller action"] = t.at
        elif t.text == "if" and after == "(":
            end = closing(ts, i + 1) + 1
            end = closing(ts, end) if end < len(ts) and ts[end].text == "{" else next((j for j in range(end, len(ts)) if ts[j].text == ";"), len(ts))
            if sum(x.text == "await" for x in ts[i:end]) >= 2:
                out["branch with multiple awaits"] = t.at
    return list(out.items())


def calls(source: str) -> Iterator[tuple[str, int]]:
    """(name, position) of each call; of a call on an object the last name.  Definitions are no calls."""
    ts = tokens(source, "typescript")
    for i, t in enumerate(ts):
        if t.kind != "i" or t.text in ("if", "for", "while", "switch", "catch", "return") or i and ts[i - 1].text in ("function", "new"):
            continue
        j = i + 1
        if j < len(ts) and ts[j].text == "<":
            depth = 0
            while j < len(ts) and ts[j].text not in (";", "{", ")"):
                depth += (ts[j].text == "<") - (ts[j].text == ">")
                j += 1
                if not depth:
                    break
        if j < len(ts) and ts[j].text == "(":
            end = closing(ts, j) + 1
            if not (end < len(ts) and ts[end].text == "{" and (not i or ts[i - 1].text in ("{", ",", "}", ";", "async", "get", "set", "*"))):
                yield t.text, t.at


#: Names whose calls, or whose mere use, say that a view does more than show.
STATE_HOOKS = ("useState", "useEffect", "useMemo", "useCallback", "useReducer", "useRef")
ROUTING_HOOKS = ("useNavigate", "useParams", "useSearchParams", "useLocation")
ACCESS_CALLS = ("fetch", "request", "get", "post", "put", "patch", "delete")
BROWSER_NAMES = ("window", "document", "location", "localStorage", "sessionStorage")


def view_signals(source: str) -> list[tuple[str, int]]:
    """(what, first position) of what a view entry should leave to a hook."""
    found: list[tuple[int, str]] = []
    for name, at in calls(source):
        if name in STATE_HOOKS:
            found.append((at, "React orchestration hook"))
        elif name in ROUTING_HOOKS:
            found.append((at, "routing hook"))
        elif name in ACCESS_CALLS:
            found.append((at, "API/service/repository access"))
    for t in tokens(source, "typescript"):
        if t.kind == "i" and t.text == "apiClient":
            found.append((t.at, "API/service/repository access"))
        elif t.kind == "i" and t.text in BROWSER_NAMES:
            found.append((t.at, "browser side effect"))
    first: dict[str, int] = {}
    for at, what in sorted(found):
        first.setdefault(what, at)
    return list(first.items())


_NAMESPACE = re.compile(r"\A[A-Za-z_]\w*(?: \. [A-Za-z_]\w*)*\Z")


def using_namespaces(source: str) -> list[tuple[str, int]]:
    """(namespace, position) of using directives, static and aliased ones included; using statements are none."""
    ts, out = tokens(source, "csharp"), []
    for i, t in enumerate(ts):
        if t.kind != "i" or t.text != "using" or i and ts[i - 1].text not in (";", "{", "}", "]", "global"):
            continue
        end = next((j for j in range(i + 1, len(ts)) if ts[j].text in (";", "(", "{")), len(ts))
        part = [x.text for x in ts[i + 1 : end]]
        if end == len(ts) or ts[end].text != ";":
            continue
        part = part[1:] if part[:1] == ["static"] else part[2:] if part[1:2] == ["="] else part
        if _NAMESPACE.match(" ".join(part)):
            out.append(("".join(part), t.at))
    return out


def constructor_dependencies(source: str) -> list[str]:
    """Type names of the parameters of constructors, primary ones included; of a generic type its name."""
    ts, out, owners = tokens(source, "csharp"), {}, set()
    for i, t in enumerate(ts[:-1]):
        if t.kind == "i" and t.text in ("class", "record", "struct") and ts[i + 1].kind == "i":
            owners.add(ts[i + 1].text)
    for i, t in enumerate(ts[:-1]):
        if t.kind != "i" or t.text not in owners or ts[i + 1].text != "(" or not i or ts[i - 1].text in ("new", ".", "record"):
            continue
        end = closing(ts, i + 1)
        if ts[i - 1].text in ("class", "struct") or ts[i - 1].text in ("public", "internal", "protected", "private"):
            for part in _parameters(ts[i + 2 : end]):
                names = [x for x in part if x.kind == "i" and x.text not in ("this", "in", "ref", "out", "params")]
                if len(names) >= 2:
                    out[names[0].text] = None
    return list(out)


def _parameters(ts: list[Token]) -> list[list[Token]]:
    """Parameters, cut at commas outside of brackets of all kinds."""
    out: list[list[Token]] = [[]]
    depth = 0
    for t in ts:
        depth += (t.text in ("(", "[", "{", "<")) - (t.text in (")", "]", "}", ">"))
        if t.text == "," and depth == 0:
            out.append([])
        else:
            out[-1].append(t)
    return [x for x in out if x]


def injected_types(source: str) -> list[tuple[str, str, list[str]]]:
    """(name, type as written without line breaks, names in its type arguments) of the parameters of constructors,
    once for each way of writing it; names begin with a capital."""
    ts, out, owners = tokens(source, "csharp"), {}, set()
    for i, t in enumerate(ts[:-1]):
        if t.kind == "i" and t.text in ("class", "record", "struct") and ts[i + 1].kind == "i":
            owners.add(ts[i + 1].text)
    for i, t in enumerate(ts[:-1]):
        if t.kind != "i" or t.text not in owners or ts[i + 1].text != "(" or not i or ts[i - 1].text not in ("class", "struct", "public", "internal", "protected", "private"):
            continue
        for part in _parameters(ts[i + 2 : closing(ts, i + 1)]):
            while part and part[0].text == "[":
                part = part[closing(part, 0) + 1 :]
            part = [x for x in part if x.text not in ("this", "in", "ref", "out", "params")]
            end = next((k for k, x in enumerate(part) if x.text == "="), len(part))
            kind = part[: end - 1]
            if end < 2 or part[end - 1].kind != "i" or not kind:
                continue
            generic = next((k for k, x in enumerate(kind) if x.text == "<"), None)
            plain = [x for x in kind[:generic] if x.kind == "i"]
            if plain and plain[-1].text[:1].isupper():
                written = " ".join(source[kind[0].at : kind[-1].at + len(kind[-1].text)].split())
                arguments = list(dict.fromkeys(x.text for x in kind[generic:] if x.kind == "i")) if generic is not None else []
                out[plain[-1].text, written] = arguments
    return [(name, written, arguments) for (name, written), arguments in out.items()]


def semantics(source: str, path: str) -> list[str]:
    """Which of data-context, request-handler and marker-interface a C# file is."""
    ts, declared = tokens(source, "csharp"), type_declarations(source)
    stem = re.sub(r"\.cs\Z", "", path.rsplit("/", 1)[-1])
    generic = {a.text for a, b in zip(ts, ts[1:], strict=False) if a.kind == "i" and b.text == "<"}
    out = []
    if "DbSet" in generic or any("DbContext" in bases for _, _, bases in declared):
        out.append("data-context")
    if "IRequestHandler" in generic or re.search(r"(?:Command|Query)Handler\Z", stem):
        out.append("request-handler")
    if re.match(r"I[A-Z]", stem) and any(kind == "interface" and name == stem for kind, name, _ in declared):
        out.append("marker-interface")
    return out


def mentions(source: str) -> list[tuple[str, str, int]]:
    """(how, name, position) of every name that may be that of an entity or of its collection: set for type arguments of
    Set, repository for those of repositories, each at its last place; member for parts of an access by a dot, at its
    last place; name for any identifier, at its first.  Using directives and namespaces say nothing."""
    ts, strong, weak = tokens(source, "csharp"), {}, {}
    i = 0
    while i < len(ts):
        t = ts[i]
        after = ts[i + 1].text if i + 1 < len(ts) else ""
        if t.text in ("using", "namespace") and after != "(" and (not i or ts[i - 1].text in (";", "{", "}", "]", "global")):
            end = next((j for j in range(i, len(ts)) if ts[j].text in (";", "{", "=")), len(ts))
            i = end + 1
            continue
        if t.kind == "i":
            weak.setdefault(t.text, t.at)
            if after == "<":
                how = "set" if t.text == "Set" else "repository" if t.text in ("IRepository", "IReadRepository", "Repository") else None
                depth = 0
                for j in range(i + 1, len(ts)):
                    depth += (ts[j].text == "<") - (ts[j].text == ">")
                    if depth == 0 or ts[j].text in (";", "{"):
                        break
                    if how and ts[j].kind == "i":
                        strong[how, ts[j].text] = t.at
            before = ts[i - 1].text if i else ""
            optional = before == "." and i > 1 and ts[i - 2].text == "?"
            if not optional and (before == "." or after == "."):
                strong["member", t.text] = t.at
        i += 1
    return [(how, name, at) for (how, name), at in strong.items()] + [("name", name, at) for name, at in weak.items()]


def property_types(source: str) -> list[tuple[str, str]]:
    """(owner, type name) of public properties: every type that a property's declaration names."""
    ts, out, owner = tokens(source, "csharp"), [], None
    for i, t in enumerate(ts):
        if t.kind == "i" and t.text in ("class", "record") and i + 1 < len(ts):
            owner = ts[i + 1].text
        elif t.text == "public" and owner:
            j = i + 1
            while j < len(ts) and ts[j].text not in ("{", "(", ";", "=", "class", "record"):
                j += 1
            if j + 1 < len(ts) and ts[j].text == "{" and ts[j + 1].text in ("get", "init", "set"):
                out += [(owner, x.text) for x in ts[i + 1 : j - 1] if x.kind == "i"]
    return out


def configured_entity(source: str) -> str | None:
    """T of IEntityTypeConfiguration<T>."""
    ts = tokens(source, "csharp")
    return next((ts[i + 2].text for i in range(len(ts) - 2) if ts[i].text == "IEntityTypeConfiguration" and ts[i + 1].text == "<"), None)


def facts_of(path: str, content: str, architecture: bool = False) -> Iterator[tuple[str, str | None, str | None]]:
    """(fact, name, value) of one file, by its extension; those for architecture rules only if asked for."""
    if re.search(r"\.[mc]?[jt]sx?\Z", path):
        line = lambda at: str(content.count("\n", 0, at) + 1)
        for specifier, kind, at in module_references(content):
            yield f"import:{kind}", specifier, line(at)
        for evidence, at in any_types(content):
            yield "any", evidence, line(at)
        for evidence, at in route_shape(content):
            yield "route-shape", evidence, line(at)
        if architecture:
            for what, at in view_signals(content):
                yield "view-signal", what, line(at)
            for name in dict.fromkeys(name for name, _ in calls(content)):
                yield "calls", name, None
        for e in frontend_endpoints(content):
            yield "endpoint", e.url, e.method
        opened = open_endpoints(content)
        for e in opened:
            yield "endpoint:open", e.url, e.method
        for name, value in url_bindings(tokens(content, "typescript")).items() if opened else ():
            yield "binds-url", name, value
        for name, value in exported_bindings(content):
            yield "exports-url", name, value
        for specifier, exported, local in named_imports(content):
            yield "import-name", specifier, f"{exported} {local}"
        if prefix := version_prefix(content):
            yield "version-prefix", prefix, None
        for what in behaviours(content):
            yield "behaviour", what, None
        if n := test_cases(content):
            yield "test-cases", None, str(n)
    elif path.endswith(".cs"):
        for kind, name, bases in type_declarations(content):
            yield f"declares:{kind}", name, ",".join(bases)
        for e in controller_endpoints(content):
            yield "action", e.url, f"{e.method} {e.action}"
        for entity, name in db_sets(content):
            yield "db-set", entity, name
        if (name := table_name(content)) is not None:
            yield "table", name, configured_entity(content)
        for name, written, arguments in injected_types(content):
            yield "injects", name, f"{written}\n{','.join(arguments)}"
        for what in semantics(content, path):
            yield "semantics", what, None
        for how, name, at in mentions(content):
            yield f"mentions:{how}", name, str(at)
        for owner, name in property_types(content):
            yield "property", name, owner
        for evidence, at in thick_controller(content):
            yield "thick-controller", evidence, str(content.count("\n", 0, at) + 1)
        for name, at in using_namespaces(content) if architecture else ():
            yield "using", name, str(content.count("\n", 0, at) + 1)
        for name in dispatched_requests(content):
            yield "sends", name, None


def facts(files: DataFrame, architecture: bool = False) -> DataFrame:
    """path, fact, ordinal, name, value for ``files(path, content)``; files without content give none.

    With ``architecture`` also view-signal, calls and using, which the architecture rules need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, f, i, n, v) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if c for i, (f, n, v) in enumerate(facts_of(p, c, architecture))]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["path", "fact", "ordinal", "name", "value"])

    return dealt(files.filter(F.col("path").isNotNull()).select("path", "content")).mapInArrow(run, "path string, fact string, ordinal int, name string, value string")
