"""Entities of source code in ten languages, by a scanner of tokens that knows comments, strings and nesting.

A file is cut into tokens, of which comments and the insides of strings are none. A stack of scopes follows brackets of
all kinds; the words of a scope since its last statement, its head, say at an opening brace or the end of a statement
what is declared there. The rules of a language are words in a table; markup has a reader of its own. Broken code gives
the entities that can still be told.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.sources.tables import spread

SCHEMA = "path string, language string, name string, entity_type string, parent_entity string, line_start int, line_end int"
#: Entities that are handed on at a time.
_ROWS = 50_000


@dataclass(frozen=True)
class Syntax:
    """What differs between the languages with braces."""

    types: dict[str, str]  # word that declares a type or a scope: entity type
    functions: str = ""  # word that declares a function; without one, a name before parentheses and a body is one
    strings: str = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
    lines: bool = False  # statements may end with their line
    imports: frozenset[str] = frozenset()
    values: frozenset[str] = frozenset()  # words that declare constants and variables of a file
    preprocessor: bool = False
    signatures: bool = False  # methods without a body count
    properties: bool = False
    nested_comments: bool = False
    templates: bool = False


_QUOTED, _CHAR = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\\n])'|'\\[^'\n]*'"
_C = {"struct": "struct", "union": "union", "enum": "enum"}
_JS = dict(functions="function", strings=r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', lines=True, imports=frozenset({"import"}), templates=True)
LANGUAGES = {
    "javascript": Syntax({"class": "class"}, **_JS),
    "typescript": Syntax({"class": "class", "interface": "interface", "enum": "enum", "namespace": "namespace", "type": "type"}, **_JS),
    "java": Syntax({"class": "class", "interface": "interface", "enum": "enum", "record": "class"}, strings=rf'"""[\s\S]*?"""|{_QUOTED}|{_CHAR}', imports=frozenset({"import", "package"}), signatures=True),
    "csharp": Syntax({"class": "class", "interface": "interface", "enum": "enum", "struct": "struct", "record": "class", "namespace": "namespace"}, strings=rf'"""[\s\S]*?"""|\$?@\$?"(?:""|[^"])*"|\$?{_QUOTED}|{_CHAR}', imports=frozenset({"using"}), signatures=True, properties=True),
    "go": Syntax({"type": "type"}, "func", strings=rf"`[^`]*`|{_QUOTED}|{_CHAR}", lines=True, imports=frozenset({"import", "package"}), values=frozenset({"var", "const"})),
    "rust": Syntax({"struct": "struct", "enum": "enum", "trait": "trait", "impl": "impl", "mod": "module", "union": "union"}, "fn", strings=rf'b?r(?P<hashes>#*)"[\s\S]*?"(?P=hashes)|b?{_QUOTED}|{_CHAR}', imports=frozenset({"use"}), values=frozenset({"const", "static"}), nested_comments=True),
    "c": Syntax(_C, strings=rf"{_QUOTED}|{_CHAR}", preprocessor=True),
    "cpp": Syntax({**_C, "class": "class", "namespace": "namespace"}, strings=rf'R"(?P<mark>\w*)\([\s\S]*?\)(?P=mark)"|{_QUOTED}|{_CHAR}', preprocessor=True),
}
_CLASS_LIKE = frozenset({"class", "interface", "enum", "struct", "union", "trait", "impl"})
#: Words before parentheses that name no function: in all languages, and in some.
_CONTROL = frozenset("if else for while do switch case catch return throw try finally new sizeof await yield assert".split())
_MORE_CONTROL = {"java": frozenset({"synchronized"}), "csharp": frozenset("lock foreach when unsafe using fixed checked unchecked".split()), "javascript": frozenset({"with"}), "typescript": frozenset({"with"})}
_GROUPS = frozenset({"import", "type", "var", "const"})
_WORD = r"[^\W\d][\w$]*|[$@#][\w$]*"


@dataclass
class Scope:
    kind: str
    name: str | None = None
    row: int | None = None  # its entity
    head: list[str] = field(default_factory=list)
    start: int = 0  # line where the head begins


def tokens(text: str, s: Syntax) -> Iterator[tuple[str, str, int]]:
    """(kind, text, line) of words, strings, preprocessor lines, operators, and ends of lines where these count."""
    pieces = [r"(?P<comment>//[^\n]*)", r"(?P<block>/\*)", rf"(?P<string>{s.strings})", rf"(?P<word>{_WORD})", r"(?P<number>\d[\w.]*)", r"(?P<line>\n)", r"(?P<space>[^\S\n]+)", r"(?P<op>=>|->|::|[\s\S])"]
    if s.preprocessor:
        pieces.insert(0, r"(?P<pre>^[ \t]*#(?:\\\r?\n|/\*[\s\S]*?\*/|[^\n])*)")
    if s.templates:
        pieces.insert(0, r"(?P<template>`)")
    pattern, at, line, last = re.compile("|".join(pieces), re.M), 0, 1, ""
    while at < len(text):
        m = pattern.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "block":
            end = _comment_end(text, at, s.nested_comments)
        elif kind == "template":
            kind, end = "string", _template_end(text, at)
        elif s.templates and m[0] == "/" and (last in "(,=:[!&|?{};+-*%<>~^" or last in ("return", "typeof", "case", "=>")):
            r = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*").match(text, at)
            if r:
                kind, end = "string", r.end()
        if kind in ("string", "word", "number", "pre", "op") or kind == "line" and s.lines:
            yield kind, text[at:end], line
            last = text[at:end] if kind != "line" else last
        line += text.count("\n", at, end)
        at = end


def _comment_end(text: str, at: int, nested: bool) -> int:
    depth, at = 1, at + 2
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 0 if m[0] == "/*" and not nested else 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _template_end(text: str, at: int) -> int:
    """Behind a template string, whose inserted code may hold templates again."""
    open_, i = ["`"], at + 1
    while i < len(text) and open_:
        c = text[i]
        if c == "\\":
            i += 1
        elif open_[-1] == "`" and c == "$" and text[i + 1 : i + 2] == "{":
            open_.append("{")
            i += 1
        elif c == "`":
            open_.pop() if open_[-1] == "`" else open_.append("`")
        elif open_[-1] == "{" and c in "{}":
            open_.append("{") if c == "{" else open_.pop()
        i += 1
    return i


def _with_next(toks: Iterator[tuple[str, str, int]]) -> Iterator[tuple[tuple[str, str, int], tuple[str, str, int] | None]]:
    """Every token; with ends of lines, the next token that is none."""
    held = []
    for x in toks:
        if x[0] == "line":
            held.append(x)
            continue
        for y in held:
            yield y, x
        held = []
        yield x, None
    for y in held:
        yield y, None


def _is_word(t: str) -> bool:
    return bool(re.fullmatch(_WORD, t)) and t[0] not in "@#"


def _without_angles(head: list[str]) -> list[str]:
    out, depth = [], 0
    for t in head:
        depth += (t == "<") - (t == ">" and depth > 0)
        if not depth and t != ">":
            out.append(t)
    return out


class _Reader:
    def __init__(self, language: str):
        self.language, self.s, self.rows = language, LANGUAGES[language], []
        self.control = _CONTROL | _MORE_CONTROL.get(language, frozenset())
        self.stack = [Scope("file")]

    def add(self, name: str, kind: str, start: int, end: int, parent: str | None = None) -> int:
        parent = parent or next((x.name for x in reversed(self.stack) if x.name), None)
        self.rows.append([name, kind, parent, start, end])
        return len(self.rows) - 1

    def group(self) -> str | None:
        """The word before an open bracket that groups declarations, as in Go."""
        if self.language == "go" and self.stack[-1].kind == "()" and len(self.stack[-2].head) == 1 and self.stack[-2].head[0] in _GROUPS:
            return self.stack[-2].head[0]
        return None

    def around(self) -> Scope:
        """The nearest scope that is no bracket."""
        return next(x for x in reversed(self.stack) if x.kind not in ("()", "[]"))

    def read(self, text: str) -> list[list]:
        s, end = self.s, 1
        for (kind, t, line), nxt in _with_next(tokens(text, s)):
            top = self.stack[-1]
            end = line + t.count("\n")
            if kind == "pre":
                m = re.match(r'\s*#\s*(include|define)\s*(?:[<"]([^>"]+)[>"]|(\w+))', t)
                if m:
                    self.add(m[2] or m[3], m[1], line, end)
            elif kind == "line":
                if top.head and top.kind != "[]" and (top.kind != "()" or self.group()) and self._ends_line(top.head[-1], nxt):
                    self.statement(line)
            elif t in ("(", "["):
                self.stack.append(Scope(t + ("]" if t == "[" else ")"), start=line))
            elif t in (")", "]"):
                if len(self.stack) > 1 and top.kind == ("()" if t == ")" else "[]"):
                    words = [w for w in top.head if _is_word(w)]
                    if self.group() and top.head:
                        self.statement(line)
                    self.stack.pop()
                    self.put(f"{top.kind} {words[-1] if words else ''}", line)
            elif t == "{":
                self.open(line)
            elif t == "}":
                self.close(end)
            elif t == ";" and top.kind not in ("()", "[]"):
                self.statement(end)
            elif t == "," and top.head[-1:] == ["{}"] and top.kind in ("()", "[]", "value"):
                top.head = []  # an element is over; lists may have many
            else:
                self.put(t, line)
        if self.stack[-1].head:
            self.statement(end)
        for x in self.stack:
            if x.row is not None:
                self.rows[x.row][4] = end
        return self.rows

    def put(self, t: str, line: int) -> None:
        top = self.stack[-1]
        if not top.head:
            top.start = line
        top.head.append(t)

    def _ends_line(self, last: str, nxt: tuple | None) -> bool:
        done = last[:2] in ("()", "[]") or last[0] in "\"'`" or re.fullmatch(r"[\w$@#]+[\w.$]*", last) is not None
        if self.language == "go" or nxt is None:
            return done
        return done and nxt[0] in ("word", "string", "number") and nxt[1] not in ("extends", "implements", "from", "in", "of", "instanceof", "as")

    def open(self, line: int) -> None:
        top = self.stack[-1]
        head, start = top.head, top.start if top.head else line
        found = self.declared(head, True)
        scope = Scope("block")
        if found:
            name, kind, parent = found
            scope = Scope(kind, name, self.add(name, kind, start, line, parent))
        elif self.language == "java" and "new" in head and head[-1].startswith("() "):
            scope = Scope("class", start=start)  # without a name
        elif head[:1] == ["typedef"]:
            scope = Scope("typedef", start=start)
        elif head[:1] == ["import"] or head[:1] == ["export"] and "=" not in head and len(head) == 1 or head[:1] == ["use"] or head[-1:] == ["::"]:
            scope = Scope("names", start=start)
        elif "=" in head or head[-1:] == [":"] or self.stack[-1].kind in ("()", "[]"):
            scope = Scope("value", start=start)
        if scope.kind not in ("names", "value", "typedef"):
            top.head = []
        self.stack.append(scope)

    def close(self, line: int) -> None:
        while len(self.stack) > 1 and self.stack[-1].kind in ("()", "[]"):  # brackets that were left open
            self.stack.pop()
        if len(self.stack) == 1:
            self.stack[0].head = []
            return
        top = self.stack[-1]
        if top.head and top.kind not in ("names", "value"):
            self.statement(line)
        self.stack.pop()
        if top.row is not None:
            self.rows[top.row][4] = line
        outer = self.stack[-1]
        if top.kind == "typedef":
            outer.head, outer.start = ["typedef"], top.start
        elif top.kind == "value":
            outer.head.append("{}")

    def statement(self, line: int) -> None:
        top = self.stack[-1]
        head, start, top.head = top.head, top.start, []
        if found := self.declared(head, False):
            name, kind, parent = found
            self.add(name, kind, start, line, parent)

    def declared(self, head: list[str], body: bool) -> tuple[str, str, str | None] | None:
        """(name, entity type, parent if it is told) of what a head declares."""
        s, words = self.s, [t for t in head if t not in ("export", "default", "pub", "declare", "abstract")]
        while words and (words[0].startswith("@") or words[0].startswith(("() ", "[] "))):  # annotations and attributes
            words = words[1:]
        if words[:1] == ["#"]:
            words = words[2:]
        if group := self.group():
            words = [group, *words]
        if not words:
            return None
        first, around = words[0], self.around()
        resource = first == "using" and (words[1:2] and words[1].startswith("()") or "=" in words and words[2:3] != ["="])
        if first in s.imports and not resource:
            if body:
                return None
            words = words[2:] if words[2:3] == ["="] else words
            quoted = [w for w in words if w[0] in "\"'`"]
            name = quoted[-1].strip("\"'`") if quoted else "".join(w for w in words[1:] if w not in ("static", "from"))
            return (name, "package" if first == "package" else "import", None) if name and not name.startswith("()") else None
        if first in s.values and not body and (around.kind == "file" or self.language == "rust") and first not in ("fn",) and s.functions not in words:
            names = [w for w in words[1:] if _is_word(w) and w != "mut"]
            return (names[0], "const" if first in ("const", "static") else "variable", None) if names and around.kind in ("file", "module") else None
        if first == "typedef":
            names = [w for w in words[1:] if _is_word(w)]
            return (names[-1], "type", None) if names and not body else None
        plain = _without_angles(words)
        return self._function(plain, body, around) or self._type(plain, body)

    def _type(self, words: list[str], body: bool) -> tuple[str, str, str | None] | None:
        for i, w in enumerate(words):
            kind = self.s.types.get(w)
            if kind is None or "=" in words[:i] or i and words[i - 1] in (".", "::"):
                continue
            if w == "impl":
                rest = words[words.index("for") + 1 :] if "for" in words else words[i + 1 :]
                rest = rest[: rest.index("where")] if "where" in rest else rest
                names = [x for x in rest if _is_word(x)]
                return (names[-1], kind, None) if names and body else None
            names = [x for x in words[i + 1 :] if _is_word(x)]
            if w == "enum" and names[:1] in (["class"], ["struct"]):
                names = names[1:]
            if not names or names[0] in ("extends", "implements"):
                before = words[:i]
                return (before[before.index("=") - 1], kind, None) if body and "=" in before else None
            if self.language == "go":
                kind = {"struct": "struct", "interface": "interface"}.get(names[1] if len(names) > 1 else "", "type")
                return (names[0], kind, None) if body == (kind != "type") else None
            if w == "type":
                return (names[0], kind, None) if "=" in words else None
            if body or w == "mod" or self.language == "rust" and w == "struct" or self.language == "csharp" and w == "namespace" or self.language in ("java", "csharp") and w == "record":
                name = names[0]
                if w == "namespace":
                    name = "".join(x for x in words[i + 1 :] if _is_word(x) or x in (".", "::"))
                return name, kind, None
            return None
        return None

    def _function(self, words: list[str], body: bool, around: Scope) -> tuple[str, str, str | None] | None:
        s = self.s
        kind = "method" if around.kind in _CLASS_LIKE else "function"
        calls = [i for i, w in enumerate(words) if w.startswith("() ")]
        if s.functions:
            if s.functions in words and (at := words.index(s.functions)) >= 0 and not any(w in s.types for w in words[:at]):
                rest = words[at + 1 :]
                receiver = rest[0][3:] if self.language == "go" and len(rest) > 2 and rest[0].startswith("() ") and _is_word(rest[1]) else None
                named = next((w for w in rest[1 if receiver else 0 :] if not w.startswith("*")), "")
                if _is_word(named):
                    return (named, "method" if receiver else kind, receiver) if body else None
                before = words[:at]
                return (before[before.index("=") - 1], kind, None) if body and "=" in before and _is_word(before[before.index("=") - 1]) else None
            if self.language in ("go", "rust"):
                return None
            if "=>" in words and "=" in words and words.index("=") < words.index("=>"):
                names = [w for w in words[: words.index("=")] if _is_word(w) or w == ":"]
                names = names[: names.index(":")] if ":" in names else names
                last = words[-1] == "=>"
                return (names[-1], "arrow_function", None) if names and (body == last or not body and "{}" not in words[words.index("=>") + 1 : words.index("=>") + 2]) else None
            if around.kind == "class" and body and calls and "=" not in words[: calls[0]] and calls[0] and _is_word(words[calls[0] - 1].lstrip("#") or "#"):
                name = words[calls[0] - 1]
                return None if name in self.control else (name, "constructor" if name == "constructor" else "method", None)
            return None
        arrow = words.index("=>") if "=>" in words else len(words)
        if "=" in words[:arrow] and "operator" not in words or words[0] in self.control or self.stack[-1].kind in ("()", "[]"):
            return None
        calls = [i for i in calls if i < arrow]
        at = next((i for i in calls if i and (_is_word(words[i - 1]) or "operator" in words[:i]) and words[i - 1] not in self.control and not (i > 1 and words[i - 2] in ("new", "@"))), None)
        if s.properties and at is None and not calls and around.kind in _CLASS_LIKE and (body or arrow < len(words)) and not any(w in s.types for w in words):
            names = [w for w in words[:arrow] if _is_word(w)]
            return (names[-1], "property", None) if len(names) > 1 else None
        if at is None or words[-1] == "->" or not s.preprocessor and any(w in s.types for w in words[: at - 1]):
            return None  # in C a type's word may stand before what a function returns
        if not body and not (s.signatures and around.kind in _CLASS_LIKE and (at > 1 or around.name == words[at - 1])) and arrow == len(words):
            return None
        if not body and arrow == len(words) and (words[at - 2] in (".", "::") if at > 1 else True):
            return None
        if around.kind in ("function", "method", "constructor", "block"):
            return None
        op = words.index("operator") if "operator" in words[:at] else None
        name = "".join(words[op:at]) if op is not None else words[at - 1]
        front = op if op is not None else at - 1
        if front and words[front - 1] == "~":
            name, front = "~" + name, front - 1
        owner = words[front - 2] if front > 1 and words[front - 1] == "::" else None
        holder = owner or (around.name if around.kind in _CLASS_LIKE else None)
        if not owner and around.kind == "file" and front == 0 and not body:
            return None
        return name, "constructor" if holder == name else "method" if holder else kind, owner


class _Markup(HTMLParser):
    """Elements of a page, with the lines of their tags."""

    def __init__(self):
        super().__init__()
        self.rows, self.open, self.tags = [], [], Counter()

    def handle_starttag(self, tag, attrs):
        self.rows.append([tag, {"script": "script_element", "style": "style_element"}.get(tag, "element"), self.open[-1][0] if self.open else None, self.getpos()[0], self.getpos()[0] + self.get_starttag_text().count("\n")])
        if tag not in ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"):
            self.open.append((tag, len(self.rows) - 1))
            self.tags[tag] += 1

    def handle_endtag(self, tag):
        if self.tags[tag]:
            while True:
                t, i = self.open.pop()
                self.tags[t] -= 1
                self.rows[i][4] = max(self.rows[i][4], self.getpos()[0])
                if t == tag:
                    return

    def handle_decl(self, decl):
        self.rows.append([decl.split()[-1] if decl.split() else decl, "doctype", None, self.getpos()[0], self.getpos()[0]])

    def handle_comment(self, data):
        self.rows.append([" ".join(data.split())[:50], "comment", self.open[-1][0] if self.open else None, self.getpos()[0], self.getpos()[0] + data.count("\n")])


def _styles(text: str) -> list[list]:
    """Rules, at-rules, keyframes and imports of a style sheet."""
    rows: list[list] = []
    stack: list[int] = []
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    clean = re.sub(r"/\*[\s\S]*?(?:\*/|$)", blank, text)
    strings = re.sub(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', lambda m: "_" * len(m[0]), clean)
    start, line = 0, 1
    for m in re.finditer(r"[{};\n]", strings):
        c = m[0]
        if c == "\n":
            line += 1
            continue
        raw = clean[start : m.start()]
        head = " ".join(raw.split())
        begin = line - raw.lstrip().count("\n") if head else line
        parent = rows[stack[-1]][0] if stack else None
        if c == "{" or c == ";" and head.startswith("@"):
            word = head[1:].split(" ")[0].split("(")[0] if head.startswith("@") else ""
            if word == "import":
                rows.append([re.sub(r"url\(|[\"')]", "", head[7:]).strip().split(" ")[0], "import", parent, begin, line])
            elif word.endswith("keyframes"):
                rows.append([head.split()[-1], "keyframes", parent, begin, line])
            elif word:
                rows.append([word, "media_query" if word == "media" else "at_rule", parent, begin, line])
            else:
                rows.append([head, "rule_set", parent, begin, line])
            if c == "{":
                stack.append(len(rows) - 1)
        elif c == "}" and stack:
            rows[stack.pop()][4] = line
        start = m.end()
    for i in stack:
        rows[i][4] = line
    return rows


def scan(text: str, language: str) -> list[list]:
    """[name, entity type, parent, first line, last line] of the entities of a file, in the order of their heads; none of unknown languages. Time grows with the text, however long it is."""
    if "\0" in text:  # no source code
        return []
    if language == "html":
        page = _Markup()
        page.feed(text)
        page.close()
        return page.rows
    if language == "css":
        return _styles(text)
    return _Reader(language).read(text) if language in LANGUAGES else []


def code_entities(files: DataFrame) -> DataFrame:
    """The entities of files (path, language, content), Python's by syntax trees, those of ten other languages by the scanner.

    Null contents and languages have none. Lines count from 1. Files are dealt anew, as a table of small ones is read by few tasks.
    """
    from lorespark.operators.extraction import python_entities

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [*[pa.string()] * 5, pa.int32(), pa.int32()]
        for b in batches:
            rows = ((p.as_py(), x.as_py(), *r) for p, x, t in zip(*b.columns, strict=True) for r in scan(t.as_py() or "", x.as_py()))
            while some := list(islice(rows, _ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], names)

    files = spread(files, 0, "path")
    others = files.filter("language <> 'python'").select("path", "language", "content").mapInArrow(run, SCHEMA)
    python = python_entities(files.filter("language = 'python'")).withColumn("language", F.lit("python"))
    return others.unionByName(python.select(*others.columns))
