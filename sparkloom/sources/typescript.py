"""Declarations, syntax events, imports and uses of TypeScript files."""

from __future__ import annotations

import re

from .lexing import Source

_MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "declare", "override", "accessor", "get", "set"}
_NO_CALL = {"if", "while", "for", "switch", "catch", "return", "typeof", "function", "await", "new", "import", "super", "throw", "in", "of", "instanceof", "void", "delete", "yield", "case", "do", "else", "constructor"}
_WORDS = {"class", "interface", "enum", "type", "function", "const", "let", "var", "namespace", "module", "export", "import", "abstract", "declare", "async", "default"}


class _File:
    def __init__(self, text: str):
        self.s = Source(text, "ts")
        self.types: list[dict] = []
        self.events: list[dict] = []
        self.imports: list[dict] = []

    def line(self, i: int) -> int:
        return self.s.line(self.s.tokens[min(i, len(self.s.tokens) - 1)].start)

    def add(self, begin: int, stop: int, name: str, kind: str, keyword: str, ns, members=(), values=None) -> None:
        start = self.line(begin)
        self.types.append({
            "name": name, "kind": kind, "keyword": keyword, "base_types": None, "start_line": start, "line_count": self.line(stop - 1) - start + 1, "is_nested": False, "enum_values": values,
            "namespace": ns, "members": list(members),
        })

    def statement_end(self, i: int, end: int) -> int:
        """Behind a statement: its `;`, or the line's end where nothing is open and nothing goes on."""
        s = self.s
        while i < end:
            if s.is_(i, ";"):
                return i + 1
            k = s.after(i) if s.is_(i, "(", "[", "{") else i + 1
            if k < end and self.line(k) > self.line(k - 1) and not self.goes_on(k - 1, k):
                return k
            i = k
        return min(i, end)

    def goes_on(self, a: int, b: int) -> bool:
        s = self.s
        return (s.tokens[a].kind == "punct" and s.tokens[a].text not in (")", "]", "}")) or (s.tokens[b].kind == "punct" and s.tokens[b].text not in ("{", "}", "@", "[", "("))

    def container(self, i: int, end: int, ns) -> None:
        s = self.s
        while i < end:
            begin = i
            while s.is_(i, "@"):
                i += 2
                i = s.after(i) if s.is_(i, "(") else i
            exported = begin if s.is_(i, "export") else None
            if exported is not None:
                if s.is_(i + 1, "default"):
                    self.event("export", i, text="export default")
                i += 1
            while s.is_(i, "default", "declare"):
                i += 1
            start = i
            while s.is_(i, "abstract", "async"):
                i += 1
            word, name = s.name(i), s.name(i + 1)
            if s.is_(i, "import") and not s.is_(i + 1, "("):
                i = self.read_import(i, end)
            elif word == "class" and (name or s.is_(i + 1, "{")):
                i = self.block(start, i, end, ns, "AbstractClass" if s.is_(start, "abstract") else "Class", "abstract class" if s.is_(start, "abstract") else "class")
            elif word == "interface" and name:
                i = self.block(start, i, end, ns, "Interface", "interface")
            elif (word == "enum" or (word == "const" and s.is_(i + 1, "enum"))) and name:
                k = i + 2 if word == "enum" else i + 3
                stop = s.after(k)
                self.add(start, stop, s.name(k - 1) or "", "Enum", "enum", ns, values=self.enum_values(k))
                i = stop
            elif word == "type" and name and s.is_(i + 2, "=", "<"):
                stop = self.statement_end(i, end)
                self.add(start, stop, name, "TypeAlias", "type", ns)
                i = stop
            elif word == "function" and (name or s.is_(i + 1, "*")):
                k = i + 2 if s.is_(i + 1, "*") else i + 1
                stop = self.function_end(k, end)
                self.add(start, stop, s.name(k) or "(anonymous)", "Function", "function", ns)
                i = stop
            elif word in ("const", "let", "var") and (name or s.is_(i + 1, "{", "[")):
                i = self.variables(i, end, ns, "var" if word == "var" else "const")
            elif word in ("namespace", "module") and (name or (i + 1 < end and s.tokens[i + 1].kind == "string")):
                k = i + 1
                while k < end and not s.is_(k, "{", ";"):
                    k += 1
                inner = s.between(i + 1, k).strip("\"'")
                if s.is_(k, "{"):
                    self.container(k + 1, min(end, s.match[k]), f"{ns}.{inner}" if ns else inner)
                i = s.after(k)
            else:
                i = max(self.statement_end(i, end), begin + 1)

    def function_end(self, i: int, end: int) -> int:
        s = self.s
        while i < end and not s.is_(i, "{", ";"):
            i = s.after(i) if s.is_(i, "(", "[") else i + 1
            if i < end and s.is_(i - 1, ")") and self.line(i) > self.line(i - 1) and not s.is_(i, "{", ":"):
                return i
        return s.after(i)

    def variables(self, i: int, end: int, ns, keyword: str) -> int:
        s, stop, k = self.s, self.statement_end(i, end), i + 1
        begin = k
        while k <= stop:
            if k == stop or s.is_(k, ",", ";"):
                if s.name(begin) and begin < k:
                    self.add(begin, k, s.name(begin) or "", "Variable", keyword, ns)
                begin = k + 1
            k = s.after(k) if s.is_(k, "(", "[", "{") else (s.angle(k) or k + 1) if s.is_(k, "<") else k + 1
        return stop

    def enum_values(self, i: int) -> str | None:
        s, names, k = self.s, [], i + 1
        while k < s.match.get(i, i):
            if s.tokens[k].kind in ("name", "string") and (k == i + 1 or s.is_(k - 1, ",")):
                names.append(s.tokens[k].text.strip("\"'"))
            k = s.after(k) if s.is_(k, "(", "[", "{") else k + 1
        return ", ".join(names) or None

    def block(self, begin: int, i: int, end: int, ns, kind: str, keyword: str) -> int:
        s = self.s
        name = s.name(i + 1) or "(anonymous)"
        k = i + 1
        while k < end and not s.is_(k, "{"):
            k = (s.angle(k) or k + 1) if s.is_(k, "<") else s.after(k) if s.is_(k, "(", "[") else k + 1
        stop = s.after(k)
        self.add(begin, stop, name, kind, keyword, ns, self.members(k, kind == "Interface") if s.is_(k, "{") else ())
        return stop

    def members(self, open_: int, interface: bool) -> list[dict]:
        s, out, i, end = self.s, [], open_ + 1, min(self.s.match[open_], len(self.s.tokens))
        while i < end:
            begin = i
            while s.is_(i, "@"):
                i += 2
                i = s.after(i) if s.is_(i, "(") else i
            while s.name(i) in _MODIFIERS and not s.is_(i + 1, "(", ":", "=", ";", "?", ",", "!", "<"):
                i += 1
            i += s.is_(i, "*")
            if i >= end or s.is_(i, ";", ","):
                i += 1
                continue
            if s.is_(i, "[", "{"):
                i = self.statement_end(i, end)
                continue
            name, k = s.tokens[i].text.strip("\"'"), i + 1
            while s.is_(k, "?", "!"):
                k += 1
            if s.is_(k, "<"):
                k = s.angle(k) or k
            if s.is_(k, "("):
                stop = self.function_end(k, end)
                close = s.after(k)
                returns = self.annotation(close, stop)
                signature = f"{name}{_one_line(s.between(k, close))}{_one_line(returns)}"
                kind = "Constructor" if name == "constructor" and not interface else "Method"
            else:
                stop = self.statement_end(k, end) if not s.is_(k, ",") else k + 1
                returns = self.annotation(k, stop)
                signature, kind = name + returns, "Property" if interface else "Field"
            stop = min(max(stop, i + 1), end)
            start = self.line(begin)
            last = stop - 1 if s.is_(stop - 1, ";", ",") and stop - 1 > i else stop
            out.append({"name": name, "kind": kind, "return_type": returns.lstrip(": "), "signature": signature, "start_line": start, "line_count": self.line(max(last, i + 1) - 1) - start + 1})
            i = stop
        return out

    def annotation(self, i: int, end: int) -> str:
        s = self.s
        if not s.is_(i, ":"):
            return ""
        k = i + 1
        while k < end and not s.is_(k, "=", ";", ",") and not (s.is_(k, "{") and k > i + 1 and not s.is_(k - 1, "|", "&", "=>", ":")):
            k = (s.angle(k) or k + 1) if s.is_(k, "<") else s.after(k) if s.is_(k, "(", "[", "{") else k + 1
        return s.between(i, min(k, end))

    def read_import(self, i: int, end: int) -> int:
        s, stop = self.s, self.statement_end(i, end)
        line, k = self.line(i), i + 1
        module = next((t.text.strip("\"'") for t in s.tokens[i:stop] if t.kind == "string"), "")
        if s.is_(k, "type") and not s.is_(k + 1, "from", ","):
            k += 1
        while k < stop and not s.is_(k, "from", ";"):
            name = s.name(k)
            if s.is_(k, "*") and s.is_(k + 1, "as"):
                self.imports.append({"name": s.name(k + 2), "module": module, "line": line})
                k += 3
            elif s.is_(k, "{"):
                close = s.match[k]
                j = k + 1
                while j < close:
                    j += s.is_(j, "type") and not s.is_(j + 1, ",", "}", "as")
                    local = j + 2 if s.is_(j + 1, "as") else j
                    if s.name(local):
                        self.imports.append({"name": s.name(local), "module": module, "line": line})
                    j = local + 2
                k = close + 1
            elif name and s.is_(k + 1, "="):
                self.imports.append({"name": name, "module": s.between(k + 2, stop).rstrip(";"), "line": line})
                break
            else:
                if name:
                    self.imports.append({"name": name, "module": module, "line": line})
                k += 1
        return stop

    # -- events

    def event(self, kind: str, at: int, name: str | None = None, **more) -> None:
        self.events.append({"kind": kind, "line": self.line(at), "name": name, **more})

    def scan(self) -> None:
        s = self.s
        for i, t in enumerate(s.tokens):
            if t.kind != "name":
                continue
            if t.text in ("style", "className") and s.is_(i + 1, "=") and s.is_(i + 2, "{") and not s.is_(i - 1, ".", "const", "let", "var"):
                value = s.tokens[i + 3] if i + 3 < len(s.tokens) else None
                shape = "object" if value and value.text == "{" else "template_string" if value and value.kind == "template" else "other"
                self.event("jsx_attr", i, t.text, text=shape)
            elif t.text == "any" and s.is_(i - 1, ":", "<", "|", "&", ",", "as", "=>", "=", "(") and not s.is_(i + 1, ":", "=", "("):
                if not (s.is_(i - 1, ",", "(", "=", "=>") and not s.is_(i + 1, ">", "[", ",", ";", ")", "|", "&")):
                    self.event("predefined_type", i, text="any")
            if t.text not in _NO_CALL and not s.is_(i - 1, "function", "new"):
                after = s.angle(i + 1) if s.is_(i + 1, "<") else i + 1
                if after and s.is_(after, "(") and not self.declares(i, after):
                    access = s.is_(i - 1, ".", "?.")
                    self.event("call", i, t.text, is_access=access, receiver=s.name(i - 2) if access else None)
        for c in s.comments:
            if re.search(r"@ts-(ignore|nocheck|strict-ignore)", c.text):
                self.events.append({"kind": "comment", "line": s.line(c.start), "name": None, "text": c.text})

    def declares(self, i: int, open_: int) -> bool:
        """Whether the name with its parameter list declares a method."""
        s, k = self.s, self.s.after(open_)
        if s.is_(k, "{"):
            return not s.is_(i - 1, ".", "?.", "=", "return", "(", ",", "=>", "!", "await")
        return s.is_(k, ":") and s.is_(i - 1, "{", "}", ";", *_MODIFIERS) and not s.is_(i - 1, "?")

    def uses(self) -> dict[str, int]:
        """The first line of each identifier that is used as a value, a type or an element."""
        s, out = self.s, {}
        ranges = [(t["start_line"], t["name"]) for t in self.types]
        imported = {(m["line"]) for m in self.imports}
        for i, t in enumerate(s.tokens):
            if t.kind != "name" or t.text in _WORDS or s.is_(i - 1, ".", "?."):
                continue
            line = s.line(t.start)
            if line in imported or (line, t.text) in ranges or (s.is_(i + 1, ":") and s.is_(i - 1, "{", ",")):
                continue
            out.setdefault(t.text, line)
        return out


def _one_line(text: str) -> str:
    return re.sub(r"\s+", " ", text)


def parse(text: str) -> dict:
    """types (with members), events, imports and uses of a TypeScript text."""
    f = _File(text)
    if f.s.tokens:
        f.container(0, len(f.s.tokens), None)
    f.scan()
    spans = [(t["start_line"], t["start_line"] + t["line_count"], t["name"], t["members"]) for t in f.types]
    for e in f.events:
        around = [x for x in spans if x[0] <= e["line"] < x[1]]
        e["enclosing_type"] = max(around, key=lambda x: x[0])[2] if around else None
        inner = [m for x in around for m in x[3] if m["start_line"] <= e["line"] < m["start_line"] + m["line_count"]]
        e["enclosing_member"] = max(inner, key=lambda m: m["start_line"])["name"] if inner else e["enclosing_type"] or "(file-level)"
    return {"namespace": None, "usings": [], "aliases": {}, "types": f.types, "events": f.events, "registrations": [], "imports": f.imports, "uses": f.uses()}
