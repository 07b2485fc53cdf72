"""Declarations, syntax events and wiring of C# files.

A file is read as tokens; declarations are recognised by their shape, bodies are skipped by their
brackets and then scanned for events. Code with errors gives what can be recognised.
"""

from __future__ import annotations

from .lexing import Source

MODIFIERS = {
    "public", "private", "protected", "internal", "static", "abstract", "sealed", "virtual", "override", "async", "readonly", "const", "extern", "unsafe", "new", "partial", "volatile",
    "required", "file", "fixed", "ref",
}
_PARAMETER = {"this", "ref", "out", "in", "params", "scoped", "readonly"}
_TYPES = {"class", "struct", "interface", "record", "enum"}
_NO_CALL = {
    "if", "while", "for", "foreach", "switch", "catch", "using", "lock", "return", "typeof", "sizeof", "default", "checked", "unchecked", "fixed", "when", "new", "await", "throw", "in", "is",
    "as", "and", "or", "not", "case", "else", "do", "yield", "base", "this", "stackalloc", "out", "ref", "var",
}
#: Registration methods and the lifetime that each gives, and texts that a file with wiring holds (fixed values).
_LIFETIMES = {
    "AddSingleton": "Singleton", "AddScoped": "Scoped", "AddTransient": "Transient",
    "TryAddSingleton": "Singleton", "TryAddScoped": "Scoped", "TryAddTransient": "Transient",
}
_MARKERS = ["AddSingleton", "AddScoped", "AddTransient", "TryAdd", "GetRequiredService", "GetService", "ServiceDescriptor", "Lazy<"]


class _File:
    def __init__(self, text: str):
        self.s = Source(text, "cs")
        self.types: list[dict] = []
        self.usings: list[str] = []
        self.aliases: dict[str, str] = {}
        self.events: list[dict] = []
        self.registrations: list[dict] = []
        self.namespace: str | None = None
        self.wired = any(m in text for m in _MARKERS)

    # -- declarations

    def container(self, i: int, end: int, ns: str | None, nested: bool, owner: dict | None) -> None:
        s = self.s
        while i < end:
            begin = i
            while s.is_(i, "["):
                i = s.after(i)
            if owner is None and (s.is_(i, "using") or (s.is_(i, "global") and s.is_(i + 1, "using"))):
                i = self.using(i, end)
                continue
            if s.is_(i, "namespace"):
                k = i + 1
                while s.name(k) or s.is_(k, ".", "::"):
                    k += 1
                name = s.between(i + 1, k)
                self.namespace = self.namespace or name
                whole = f"{ns}.{name}" if ns else name
                if s.is_(k, "{"):
                    self.container(k + 1, min(end, s.match[k]), whole, nested, None)
                    i = s.after(k)
                else:
                    ns, i = whole, k + 1
                continue
            modifiers = []
            while s.name(i) in MODIFIERS and not (s.is_(i, "new", "ref", "fixed", "file", "required", "partial") and s.is_(i + 1, "(", ".", ";", "=")):
                modifiers.append(s.name(i))
                i += 1
            word = s.name(i)
            if word in _TYPES and s.name(i + 1):
                i = self.type(begin, i, end, ns, nested, modifiers)
            elif word == "delegate":
                i = self.until(i, end)
            elif owner is not None:
                i = self.member(begin, i, end, modifiers, owner)
            else:
                i = max(i, begin) + 1 if not s.is_(i, "{", "(") else s.after(i)

    def until(self, i: int, end: int) -> int:
        """Behind the `;` that ends what stands at i."""
        while i < end and not self.s.is_(i, ";"):
            i = self.s.after(i) if self.s.is_(i, "(", "[", "{") else i + 1
        return i + 1

    def using(self, i: int, end: int) -> int:
        s = self.s
        k = i + 2 if s.is_(i, "global") else i + 1
        stop = self.until(k, end)
        if s.is_(k, "static") or s.is_(k, "("):
            return stop
        if s.is_(k + 1, "="):
            self.aliases[s.name(k) or ""] = s.between(k + 2, stop - 1)
        elif (target := s.between(k, stop - 1)) and target not in self.usings:
            self.usings.append(target)
        return stop

    def type(self, begin: int, i: int, end: int, ns, nested: bool, modifiers: list[str]) -> int:
        s = self.s
        word = s.name(i)
        if word == "record" and s.is_(i + 1, "class", "struct"):
            word, i = f"record {s.name(i + 1)}", i + 1
        name = s.name(i + 1) or ""
        k = i + 2
        if s.is_(k, "<"):
            k = s.angle(k) or k + 1
        shown = [m for m in modifiers if m in ("static", "abstract", "sealed")]
        out = {
            "name": name, "kind": _kind(shown, word), "keyword": " ".join([*shown, word]), "base_types": None, "start_line": s.line(s.tokens[begin].start), "line_count": 1, "is_nested": nested,
            "enum_values": None, "namespace": ns, "members": [],
        }
        self.types.append(out)
        primary = None
        if s.is_(k, "("):
            primary, k = (k, s.after(k)), s.after(k)
        if s.is_(k, ":"):
            bases, k = self.bases(k + 1, end)
            out["base_types"] = None if word == "enum" else bases
        while k < end and not s.is_(k, "{", ";"):
            k = s.after(k) if s.is_(k, "(", "[") else k + 1
        stop = s.after(k)
        if s.is_(stop, ";") and s.is_(k, "{"):
            stop += 1
        out["line_count"] = s.line(s.tokens[min(stop, len(s.tokens)) - 1].start) - out["start_line"] + 1
        if primary:
            types = self.parameters(primary[0])
            self.add(out, name, "Constructor", name, f"{name}({types})", primary[0], primary[1])
        if s.is_(k, "{"):
            close = min(s.match[k], end)
            if word == "enum":
                out["enum_values"] = self.enum_values(k + 1, close)
            else:
                self.container(k + 1, close, ns, True, out)
        out["members"].sort(key=lambda m: m.pop("_order"))
        return stop

    def bases(self, i: int, end: int) -> tuple[list[str], int]:
        s, out, start = self.s, [], i
        while i < end and not s.is_(i, "{", ";", "where"):
            if s.is_(i, ","):
                out.append((start, i))
                start = i + 1
            i = (s.angle(i) or i + 1) if s.is_(i, "<") else s.after(i) if s.is_(i, "(", "[") else i + 1
        out.append((start, i))
        texts = []
        for a, b in out:
            cut = next((k for k in range(a, b) if s.is_(k, "(") and k > a), b)  # arguments of a base constructor
            texts.append(s.between(a, cut))
        return [t for t in texts if t], i

    def enum_values(self, i: int, end: int) -> str | None:
        s, names, fresh = self.s, [], True
        while i < end:
            if s.is_(i, "[", "("):
                i = s.after(i)
                continue
            if fresh and s.name(i):
                names.append(s.name(i))
                fresh = False
            fresh = fresh or s.is_(i, ",")
            i += 1
        return ", ".join(names) or None

    def type_end(self, i: int) -> int:
        """Behind the type that begins at i; i itself if there is none."""
        s, k = self.s, i
        if s.is_(k, "ref"):
            k += 1
        if s.is_(k, "("):
            k = s.after(k)
        elif s.name(k):
            k += 1
            while True:
                if s.is_(k, "<") and (after := s.angle(k)):
                    k = after
                elif s.is_(k, ".", "::") and s.name(k + 1):
                    k += 2
                else:
                    break
        else:
            return i
        while s.is_(k, "?", "*") or (s.is_(k, "[") and all(s.is_(j, ",") for j in range(k + 1, s.match[k]))):
            k = s.after(k) if s.is_(k, "[") else k + 1
        return k

    def parameters(self, i: int) -> str:
        s, types, k, end = self.s, [], i + 1, self.s.match[i]
        while k < end:
            while s.is_(k, "["):
                k = s.after(k)
            while s.name(k) in _PARAMETER:
                k += 1
            stop = self.type_end(k)
            types.append(s.between(k, stop))
            while k < end and not s.is_(k, ","):
                k = (s.angle(k) or k + 1) if s.is_(k, "<") else s.after(k) if s.is_(k, "(", "[", "{") else k + 1
            k += 1
        return ", ".join(types)

    def add(self, owner: dict, name: str, kind: str, returns: str, signature: str, begin: int, stop: int) -> None:
        s = self.s
        start = s.line(s.tokens[begin].start)
        group = {"Property": 0, "Field": 1, "Constructor": 2, "Event": 3, "Method": 4}[kind]
        types = signature[signature.find("(") :] if kind in ("Constructor", "Method") else ""
        owner["members"].append({
            "name": name, "kind": kind, "return_type": returns, "signature": signature, "start_line": start, "line_count": s.line(s.tokens[min(stop, len(s.tokens)) - 1].start) - start + 1,
            "_order": (group, name, types, s.tokens[begin].start),
        })

    def body(self, i: int, end: int) -> int:
        """Behind a member's body, expression or `;` at i."""
        s = self.s
        while i < end and not s.is_(i, "{", ";", "=>"):
            i = s.after(i) if s.is_(i, "(", "[") else i + 1
        return s.after(i) if s.is_(i, "{") else self.until(i, end)

    def member(self, begin: int, i: int, end: int, modifiers: list[str], owner: dict) -> int:
        s, where = self.s, owner["name"]
        if s.is_(i, ";", "}"):
            return i + 1
        if s.is_(i, "~") or s.is_(i, "implicit", "explicit"):
            return self.body(i, end)
        if s.is_(i, "event"):
            after = self.type_end(i + 1)
            kind = s.between(i + 1, after)
            k = after
            while s.is_(k + 1, "."):
                k += 2
            stop = s.after(k + 1) if s.is_(k + 1, "{") else self.until(k, end)
            for name in [s.name(k)] if s.is_(k + 1, "{") else self.declared(k, stop):
                self.add(owner, name or "", "Event", kind, f"event {kind} {name}", begin, stop)
            return stop
        if s.name(i) == where and s.is_(i + 1, "("):
            stop = self.body(s.after(i + 1), end)
            types = self.parameters(i + 1)
            self.add(owner, where, "Constructor", where, f"{where}({types})", begin, stop)
            self.scan(s.after(i + 1), stop, where, f"{where}(ctor)", False)
            return stop
        after = self.type_end(i)
        if after == i:
            return i + 1 if not s.is_(i, "(", "[", "{") else s.after(i)
        kind, k = s.between(i, after), after
        while s.name(k) and (s.is_(k + 1, ".") or (s.is_(k + 1, "<") and s.is_(s.angle(k + 1) or -1, "."))):  # an interface's name in front
            k = (s.angle(k + 1) if s.is_(k + 1, "<") else k + 1) + 1
        name = s.name(k)
        if name in ("operator", "this") or name is None:
            return self.body(k, end)
        k += 1
        open_ = (s.angle(k) or k) if s.is_(k, "<") else k
        if s.is_(open_, "("):
            stop = self.body(s.after(open_), end)
            types = self.parameters(open_)
            self.add(owner, name, "Method", kind, f"{kind} {name}({types})", begin, stop)
            if "async" in modifiers and kind == "void":
                self.event("async-method", k - 1, where, name)
            self.scan(s.after(open_), stop, where, name, False)
            return stop
        if s.is_(k, "{", "=>"):
            stop = s.after(k) if s.is_(k, "{") else self.until(k, end)
            if s.is_(stop, "=") and s.is_(k, "{"):
                stop = self.until(stop, end)
            self.add(owner, name, "Property", kind, f"{kind} {name}", begin, stop)
            self.scan(k, stop, where, f"{name}(property)", False)
            return stop
        stop = self.until(k, end)
        for one in self.declared(k - 1, stop):
            self.add(owner, one, "Field", kind, f"{kind} {one}", begin, stop)
        self.event("field", begin, where, name, is_public="public" in modifiers, is_fixed="const" in modifiers or "readonly" in modifiers)
        if self.wired and kind.startswith(("Lazy<", "System.Lazy<")):
            self.lazy(kind, k, stop, where, begin)
        self.scan(k, stop, where, "(file-level)", False)
        return stop

    def declared(self, i: int, stop: int) -> list[str]:
        """Names of a declaration list."""
        s, names = self.s, [self.s.name(i) or ""]
        while i < stop:
            if s.is_(i, ",") and s.name(i + 1):
                names.append(s.name(i + 1))
            i = (s.angle(i) or i + 1) if s.is_(i, "<") else s.after(i) if s.is_(i, "(", "[", "{") else i + 1
        return names

    # -- events of bodies

    def event(self, kind: str, at: int, owner: str | None, member: str | None, name: str | None = None, **more) -> None:
        s = self.s
        line = s.line(s.tokens[at].start)
        self.events.append({"kind": kind, "line": line, "name": name, "enclosing_type": owner, "enclosing_member": member, **more})

    def scan(self, i: int, end: int, owner: str, member: str, in_finally: bool) -> None:
        s = self.s
        end = min(end, len(s.tokens))
        while i < end:
            word = s.name(i)
            if word == "finally" and s.is_(i + 1, "{"):
                self.scan(i + 2, min(s.match[i + 1], end), owner, member, True)
                i = s.after(i + 1)
                continue
            if word == "catch":
                k, caught = i + 1, None
                if s.is_(k, "("):
                    caught = s.between(k + 1, self.type_end(k + 1))
                    k = s.after(k)
                if s.is_(k, "when") and s.is_(k + 1, "("):
                    k = s.after(k + 1)
                if s.is_(k, "{"):
                    self.event("catch", i, owner, member, caught, is_empty=s.match[k] == k + 1)
            elif word == "throw":
                statement = not s.is_(i - 1, "=>", "??", "?", ":") or s.is_(i - 2, "default")
                made = s.between(i + 2, self.type_end(i + 2)) if s.is_(i + 1, "new") else None
                if statement:
                    self.event("throw", i, owner, member, made, in_finally=in_finally)
            elif word and word not in _NO_CALL and not s.is_(i - 1, "new"):
                after = s.angle(i + 1) if s.is_(i + 1, "<") else i + 1
                if after and s.is_(after, "(") and not self.creates(i):
                    if self.local_function(i, after):
                        stop = self.body(s.after(after), end)
                        self.scan(s.after(after), stop, owner, word, in_finally)
                        i = stop
                        continue
                    access = s.is_(i - 1, ".", "?.")
                    self.event("call", i, owner, member, word, is_access=access, receiver=s.name(i - 2) if access else None)
                    if self.wired:
                        self.wiring(i, after, owner, member)
            i += 1

    def creates(self, i: int) -> bool:
        """Whether the name ends a qualified `new A.B(`."""
        while self.s.is_(i - 1, ".", "::") and self.s.name(i - 2):
            i -= 2
        return self.s.is_(i - 1, "new")

    def local_function(self, i: int, open_: int) -> bool:
        s = self.s
        before = s.name(i - 1)
        typed = (before and before not in _NO_CALL - {"var"} and before not in ("static", "async")) or s.is_(i - 1, ">", "]", "?")
        return bool(typed) and s.is_(s.after(open_), "{", "=>", "where")

    # -- wiring

    def arguments(self, open_: int) -> list[tuple[int, int]]:
        s, out, k, end = self.s, [], open_ + 1, self.s.match[open_]
        start = k
        while k < end:
            if s.is_(k, ","):
                out.append((start, k))
                start = k + 1
            k = (s.angle(k) or k + 1) if s.is_(k, "<") else s.after(k) if s.is_(k, "(", "[", "{") else k + 1
        return [*out, (start, min(end, len(s.tokens)))] if start < end else out

    def type_arguments(self, i: int, after: int) -> list[str]:
        s, out, k = self.s, [], i + 2
        if not s.is_(i + 1, "<"):
            return out
        start = k
        while k < after - 1:
            if s.is_(k, ","):
                out.append(s.between(start, k))
                start = k + 1
            k = (s.angle(k) or k + 1) if s.is_(k, "<") else s.after(k) if s.is_(k, "(", "[") else k + 1
        return [*out, s.between(start, after - 1)]

    def edge(self, at: int, owner, member, kind, service, impl, lifetime, confidence) -> None:
        conditional = self.conditional(at)
        if conditional and confidence == "Resolved":
            confidence = "Partial"
        line = self.s.line(self.s.tokens[at].start)
        self.registrations.append({"kind": kind, "service": service, "impl": impl, "lifetime": lifetime, "start_line": line, "confidence": confidence, "enclosing_type": owner, "enclosing_member": member, "conditional": conditional})

    def conditional(self, at: int) -> bool:
        """Whether an if, else, switch or conditional expression stands around the token."""
        s = self.s
        for open_, close in s.match.items():
            if open_ < at < close and s.is_(open_, "{"):
                k = open_ - 1
                if s.is_(k, "else") or (s.is_(k, ")") and s.is_(s.match[k] - 1, "if", "switch")):
                    return True
        k = at
        while k > 0 and not s.is_(k, ";", "{", "}"):
            if s.is_(k, "if", "else", "?"):
                return True
            k -= 1
        return False

    def made(self, a: int, b: int) -> tuple[str | None, str]:
        """The type that a factory or instance gives, and how sure that is."""
        s = self.s
        news = [k for k in range(a, b) if s.is_(k, "new") and s.name(k + 1)]
        kinds = {s.between(k + 1, self.type_end(k + 1)) for k in news}
        return (kinds.pop(), "Resolved") if len(kinds) == 1 else (None, "Dynamic")

    def wiring(self, i: int, open_: int, owner, member) -> None:
        s, name = self.s, self.s.name(i)
        types, args = self.type_arguments(i, open_), self.arguments(open_)
        if name in ("GetRequiredService", "GetService") and len(types) == 1:
            self.edge(i, owner, member, "LocatorConsume", types[0], None, None, "Partial")
        elif name in ("Replace", "Add", "TryAddEnumerable") and args and s.is_(args[0][0], "ServiceDescriptor"):
            self.descriptor(i, args[0], owner, member, "DiReplace" if name == "Replace" else "DiGeneric")
        elif name in _LIFETIMES and len(types) == 2:
            self.edge(i, owner, member, "DiGeneric", types[0], types[1], _LIFETIMES[name], "Resolved")
        elif name in _LIFETIMES and len(types) == 1:
            if not args:
                self.edge(i, owner, member, "DiGeneric", types[0], types[0], _LIFETIMES[name], "Resolved")
            else:
                factory = any(s.is_(k, "=>") for k in range(*args[0]))
                impl, sure = self.made(*args[0])
                self.edge(i, owner, member, "DiFactory" if factory else "DiInstance", types[0], impl, _LIFETIMES[name], sure)
        elif name in _LIFETIMES and not types and args:
            if s.is_(args[0][0], "typeof"):
                named = [s.between(a + 2, b - 1) for a, b in args if s.is_(a, "typeof")]
                self.edge(i, owner, member, "DiOpenGeneric", named[0], named[1] if len(named) > 1 else named[0], _LIFETIMES[name], "Resolved")
            elif s.is_(args[0][0], "new"):
                impl, sure = self.made(*args[0])
                self.edge(i, owner, member, "DiInstance", impl, impl, _LIFETIMES[name], sure)

    def descriptor(self, i: int, arg: tuple[int, int], owner, member, kind: str) -> None:
        s, (a, b) = self.s, arg
        made = next((k for k in range(a, b) if s.name(k) in ("Singleton", "Scoped", "Transient", "Describe")), None)
        if made is None:
            return
        life = None if s.is_(made, "Describe") else s.name(made)
        types = self.type_arguments(made, s.angle(made + 1) or made + 1) if s.is_(made + 1, "<") else [s.between(k + 2, s.match[k + 1]) for k in range(made, b) if s.is_(k, "typeof")]
        service, impl = (types + [None, None])[:2]
        self.edge(i, owner, member, kind, service, impl, life, "Resolved" if impl else "Dynamic")

    def lazy(self, kind: str, i: int, stop: int, owner, begin: int) -> None:
        """A field Lazy<I> whose initialiser constructs something else than the Lazy itself."""
        s = self.s
        news = [s.between(k + 1, self.type_end(k + 1)) for k in range(i, stop) if s.is_(k, "new") and s.name(k + 1)]
        found = [n for n in news if not n.startswith(("Lazy", "System.Lazy"))]
        if found:
            self.edge(begin, owner, "(file-level)", "LegacyNew", kind[kind.index("<") + 1 : -1], found[0], None, "Resolved")


def _kind(modifiers: list[str], word: str) -> str:
    if word in ("interface", "enum", "struct"):
        return word.capitalize()
    if word.startswith("record"):
        return "RecordStruct" if "struct" in word else "Record"
    return next((f"{m.capitalize()}Class" for m in ("static", "abstract", "sealed") if m in modifiers), "Class")


def parse(text: str) -> dict:
    """namespace, usings, aliases, types (with members), events and registrations of a C# text."""
    f = _File(text)
    f.container(0, len(f.s.tokens), None, False, None)
    return {"namespace": f.namespace, "usings": f.usings, "aliases": f.aliases, "types": f.types, "events": f.events, "registrations": f.registrations}
