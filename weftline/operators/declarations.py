"""Declarations of one source text, over its masked code: scopes, parents, members and chunks.

Types and functions are found by the patterns of their language in the masked code, members of a type also by their place: a
name with parameters directly inside a type's brackets, with a body, an arrow or a semicolon after it, needs no modifier. Ends
are those of the brackets that belong together, of the indentation, or of the statement; a declaration's parent is the
innermost type, or implementation of one, around it. Texts may be long: what a declaration asks of the text before it is looked
up in sorted places.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from weftline.operators.lexing import Brackets, mask

_TYPE_WORDS = ("class", "interface", "struct", "record", "enum", "trait", "protocol", "module", "object", "type", "extension", "impl")
_KIND = {"trait": "interface", "protocol": "interface", "module": "class", "object": "class", "type": "class"}
#: Words that no type or function is called by, whatever stands after them.
_NEVER = frozenset("if for foreach while switch catch return using lock fixed sizeof typeof nameof new elif except with and or not in when guard where else do try throw await yield case super this base function class delete void default match unless until synchronized static_assert alignas decltype defined get set init".split())
_INDENTED = ("python", "ruby")
_MEMBER = re.compile(r"(~?[A-Za-z_$#][\w$]*[?!]?)\s*(?:<[^;(){}]*>\s*)?\(")
_ASSIGNED = re.compile(r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?(?:function\b|(?:<[^;(){}]*>\s*)?\([^;{}]*?\)\s*(?::[^=;{}()]+)?=>|[\w$]+\s*=>)")
_PROPERTY = re.compile(r"([\w$#]+)\s*(?::[^=;{}]+)?=\s*(?:async\s*)?(?:function\b|\([^;{}]*?\)\s*(?::[^=;{}()]+)?=>|[\w$]+\s*=>)")
_IMPLEMENTED = {"rust": re.compile(r"\bimpl\b\s*(?:<[^{};]*?>\s*)?(?:[^{};]*?\bfor\s+)?&?(?:'\w+\s+)?([\w:]+)[^{};]*\{"), "swift": re.compile(r"\bextension\s+([\w.]+)[^{};]*\{")}
_RECEIVER = re.compile(r"func\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)")
_QUALIFIED = re.compile(r"(\w+)\s*(?:<[^<>]*>)?\s*::\s*~?$")


@dataclass
class Declaration:
    name: str
    kind: str
    at: int
    end: int
    signature: str
    head: int
    modifiers: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    body: int = -1
    owner: str = ""

    @property
    def callable(self) -> bool:
        return self.kind == "function"


def _innermost(spans: list[tuple[int, int, object]]) -> tuple[list[int], list]:
    """(places, values) of a step function: from each place on, the value of the last of ``spans`` (first place, place past the end, value) that holds it; None if none does."""
    order, k, held = sorted(range(len(spans)), key=lambda i: spans[i][0]), 0, []
    places, values = sorted({x for a, b, _ in spans for x in (a, b)}), []
    for at in places:
        while k < len(order) and spans[order[k]][0] <= at:
            heapq.heappush(held, -order[k])
            k += 1
        while held and spans[-held[0]][1] <= at:
            heapq.heappop(held)
        values.append(spans[-held[0]][2] if held else None)
    return places, values


def _at(steps: tuple[list[int], list], at: int) -> object:
    k = bisect.bisect_right(steps[0], at) - 1
    return steps[1][k] if k >= 0 else None


class Source:
    """One text with its masked code, brackets and declarations in the order of their places."""

    def __init__(self, text: str, language: str, types: str, functions: str, modifiers: frozenset[str]) -> None:
        self.text, self.language, self.modifiers = text, language, modifiers
        self.code = mask(text, language)
        self.brackets = Brackets(self.code)
        self.feeds = [m.start() for m in re.finditer("\n", text)]
        self.stops = [m.start() for m in re.finditer("[;{}]", self.code)]
        self.scopes: list[tuple[int, int, str]] = []
        self.found: dict[int, Declaration] = {}
        for m in re.finditer(types, self.code):
            if not self._forward(m):
                self._add(m.start(1), m.end(1), "type")
        rx = _IMPLEMENTED.get(language)
        for m in rx.finditer(self.code) if rx else ():
            self.scopes.append((m.end() - 1, self.brackets.close[m.end() - 1], re.split(r"::|\.", m[1])[-1]))
        for m in re.finditer(functions, self.code):
            if m[1] not in _NEVER and not self._inside_parentheses(m.start(1)):
                self._add(m.start(1), m.end(1), "function")
        if language in ("typescript", "javascript"):
            for m in _ASSIGNED.finditer(self.code):
                self._add(m.start(1), m.end(1), "function", arrow=m.end())
        if language not in _INDENTED:
            self._members()
        self.declarations = sorted(self.found.values(), key=lambda d: d.at)

    def _forward(self, m: re.Match[str]) -> bool:
        """Whether a match of the types' pattern declares nothing: a constraint, a template parameter, a type named in front of its use."""
        name = m[1]
        if name in _NEVER or self._inside_parentheses(m.start(1)):
            return True
        if self.language in ("cpp", "c"):
            stop = re.compile(r"[;{(=]").search(self.code, m.end(1))
            return re.compile(r"\s*[>,]").match(self.code, m.end(1)) is not None or stop is None or stop[0] != "{"
        return False

    def _inside_parentheses(self, at: int) -> bool:
        k = self.brackets.around(at)
        return k >= 0 and self.code[k] != "{"

    def _line(self, at: int) -> int:
        k = bisect.bisect_left(self.feeds, at)
        return self.feeds[k - 1] + 1 if k else 0

    def _statement(self, at: int) -> int:
        """Where the statement around a place begins, past the last bracket or semicolon before it."""
        k = bisect.bisect_left(self.stops, at)
        return self.stops[k - 1] + 1 if k else 0

    def _after(self, at: int) -> int:
        """Past a name's type parameters and parameters."""
        code = self.code
        m = re.compile(r"\s*(?:<[^;(){}]*>|\[[^;(){}]*\])?\s*").match(code, at)
        at = m.end() if m else at
        while at < len(code) and code[at] == "(":
            at = min(len(code), self.brackets.close[at] + 1)
            more = re.compile(r"\s*(?=\()").match(code, at) if self.language == "scala" else None
            at = more.end() if more else at
        return at

    def _head(self, name_end: int, kind: str) -> int:
        """Where a declaration's header ends: before its body, arrow or semicolon."""
        code = self.code
        at = self._after(name_end)
        if self.language in _INDENTED:
            for m in re.compile(r"[([{:]" if self.language == "python" else r"[;\n]").finditer(code, at):
                if m.start() >= at:
                    if m[0] in ":;\n":
                        return m.start()
                    at = self.brackets.close[m.start()]
            return len(code)
        stop = {"go": r"\{|$", "scala": r"[{\n]|=(?![=>])", "swift": r"[{;]|\n\s*(?!\{)" if kind == "function" else r"[{;]"}.get(self.language, r"[{;]|=>" if kind == "type" or self.language not in ("typescript", "javascript") else r"[{;]|=>|\n(?=\s*\w)")
        for m in re.compile(stop, re.M).finditer(code, at):
            if self.language in ("go", "typescript") and m[0] == "{" and re.search(r"(?:interface|struct|:|[|&])\s*$", code[at : m.start()]) and kind == "function":
                continue
            return m.start()
        return len(code)

    def _end(self, line: int, head: int) -> tuple[int, int]:
        """(end of the declaration, its opening bracket or -1)."""
        code = self.code
        if self.language in _INDENTED:
            return self._indented(line, head), -1
        m = re.compile(r"\s*(\{|=>|=|;)").match(code, head)
        if m is None:
            return head, -1
        if m[1] == "{":
            return min(len(code), self.brackets.close[m.end() - 1] + 1), m.end() - 1
        if m[1] == ";":
            return (m.end(), -1) if "\n" not in m[0] or self.language in ("csharp", "java") else (head, -1)
        return self._expression(m.end())

    def _expression(self, at: int) -> tuple[int, int]:
        """The end of what stands after an arrow or an equals sign."""
        code = self.code
        m = re.compile(r"\s*\{").match(code, at)
        if m:
            return min(len(code), self.brackets.close[m.end() - 1] + 1), m.end() - 1
        first = re.compile(r"\s*").match(code, at).end()
        stop = re.compile(r"[([{;\n})\]]")
        at = first
        while (m := stop.search(code, at)) is not None:
            if m[0] in "([{":
                at = min(len(code), self.brackets.close[m.start()] + 1)
                continue
            if m[0] == "\n" and (self.language in ("csharp", "java") or re.compile(r"\s*[.?:&|+]").match(code, m.end())):
                at = m.end()
                continue
            return (m.end() if m[0] == ";" else m.start()), -1
        return len(code), -1

    def _indented(self, line: int, head: int) -> int:
        """The end of a block by indentation; lines inside brackets or masked text count as part of it, and Ruby's ``end`` too."""
        code = self.code
        indent = re.compile(r"[ \t]*").match(code, line).end() - line
        at, last = code.find("\n", head), head
        if self.language == "ruby" and code[head : head + 1] == ";":
            closed = re.compile(r"[^\n]*\bend\b").match(code, head)
            if closed:
                return closed.end()
        while at >= 0:
            end = code.find("\n", at + 1)
            end = len(code) if end < 0 else end
            row = code[at + 1 : end]
            if self.brackets.around(at + 1) > line:
                last = end if row.strip() else last
            elif self.text[at + 1 : end].strip() and (row.strip() or len(self.text[at + 1 : end]) - len(self.text[at + 1 : end].lstrip()) > indent):
                deep = len(row) - len(row.lstrip(" \t")) if row.strip() else indent + 1
                closes = self.language == "ruby" and deep == indent and re.match(r"end\b", row.strip()) is not None
                if deep < indent or (deep == indent and not closes):
                    break
                last = at + 1 + len(row.rstrip())
                if closes:
                    break
            at = end if end < len(code) else -1
        return last

    def _add(self, start: int, name_end: int, kind: str, arrow: int = -1) -> None:
        if start in self.found:
            return
        code, text = self.code, self.text
        line = self._line(start)
        head = self._head(name_end, kind) if arrow < 0 else arrow - 2 if code[arrow - 2 : arrow] == "=>" else arrow
        if arrow >= 0 and code[arrow - 2 : arrow] == "=>":
            end, body = self._expression(arrow)
        elif arrow >= 0:
            head = self._head(arrow, "function")
            end, body = self._end(line, head)
        else:
            end, body = self._end(line, head)
        own = line if self.language in _INDENTED else max(line, self._statement(start))
        words = re.findall(r"[\w$]+", code[own:start])
        word = next((w for w in reversed(words) if w in _TYPE_WORDS), "class")
        if kind == "type" and self.language == "go":
            after = re.compile(r"\s*(?:\[[^\]]*\])?\s*(struct|interface)").match(code, name_end)
            word = after[1] if after else "class"
        d = Declaration(text[start:name_end], "function" if kind == "function" else _KIND.get(word, word), start, end, " ".join(text[own:head].split()), head, [w for w in words if w in self.modifiers], body=body)
        if kind == "type":
            d.bases = self._bases(name_end, head)
            if body >= 0:
                self.scopes.append((body, self.brackets.close[body], d.name))
            elif self.language in _INDENTED:
                self.scopes.append((head, end, d.name))
        if self.language == "go" and kind == "function" and (m := _RECEIVER.match(code, line)):
            d.owner = m[1]
        if self.language == "cpp" and kind == "function" and (m := _QUALIFIED.search(code[own:start])):
            d.owner = m[1]
        while line > 0:
            prior = text.rfind("\n", 0, line - 1) + 1
            row = text[prior : line - 1].strip()
            if not (re.match(r"\[\w|@\w|#\[", row) and code[prior : line - 1].strip()):
                break
            d.attributes.insert(0, row)
            line = prior
        self.found[start] = d

    def _bases(self, name_end: int, head: int) -> list[str]:
        code = self.code
        if self.language == "go":
            return []
        rest = code[name_end:head]
        if self.language != "ruby":
            rest = re.sub(r"^\s*(?:<[^{};]*?>(?!\s*[,>])|\[[^\]]*\])", "", rest)
        if self.language in ("csharp", "java", "scala"):
            rest = re.sub(r"^\s*\([^()]*\)", "", rest)
        named = re.search(r"(?:(?<!:):(?!:)|\bextends\b|\bimplements\b|\bwith\b|<|\()(.*)", rest, re.S)
        if not named or (self.language != "ruby" and named[0].startswith("<")):
            return []
        listed = re.sub(r"\bwhere\b.*" if self.language in ("csharp", "rust", "swift") else r"\0", " ", named[1], flags=re.S)
        listed = re.sub(r"\b(?:extends|implements|with|public|private|protected|virtual)\b", " ", listed)
        if self.language == "python":
            listed = re.sub(r"\w+\s*=\s*[^,()]+", " ", listed)
        return re.findall(r"[A-Za-z_][\w.]*(?:<[^<>]*>)?", re.sub(r"\([^()]*\)", " ", listed) if self.language in ("csharp", "scala") else listed)

    def _members(self) -> None:
        """Functions directly inside a type's brackets that need no keyword or modifier."""
        code, bodies = self.code, {s: (e, n) for s, e, n in self.scopes}
        if self.language in ("rust", "scala", "php", "go"):
            return  # their functions always have a keyword
        for m in _MEMBER.finditer(code):
            scope = self.brackets.around(m.start(1))
            if scope not in bodies or m[1] in _NEVER or m.start(1) in self.found:
                continue
            opened = m.end() - 1
            begins, last = max(self._statement(m.start(1)), scope + 1), m.start(1) - 1
            while last >= begins and code[last].isspace():
                last -= 1
            if last >= begins and code[last] in ",(":
                continue
            before = code[begins : last + 1]
            before = re.sub(r"^(?:\s*(?:\[[^\]]*\]|@[\w.]+(?:\s*\([^()]*\))?))+", "", before).strip()
            name = bodies[scope][1]
            if "=" in before or before.endswith((".", ",", "(", "@", "new", "return", ":")) and not before.endswith(("public:", "private:", "protected:")):
                continue
            constructor = m[1].lstrip("~") == name or (self.language == "swift" and m[1] in ("init",))
            script = self.language in ("typescript", "javascript")
            if not (before or constructor or script):
                continue
            after = re.compile(r"\s*(?:(?:const|noexcept|override|final|volatile|mutable|throws\s+[\w.,\s]+|rethrows|async|&&?)\s*)*(?:->\s*[\w:<>,*& ]+|:\s*[^;{}=]+?(?=\s*[;{\n]|\s*=>)|where\s[^;{}]+)?\s*(\{|=>|;|=\s*(?:0|default|delete)\s*;)").match(code, min(len(code), self.brackets.close[opened] + 1))
            if after is None or (after[1] == ";" and self.language == "javascript") or (script and after[1] == ";" and "\n" in after[0]):
                continue
            self._add(m.start(1), m.end(1), "function")
        if self.language in ("typescript", "javascript"):
            for m in _PROPERTY.finditer(code):
                if self.brackets.around(m.start(1)) in bodies and m.start(1) not in self.found:
                    self._add(m.start(1), m.end(1), "function", arrow=m.end())

    def parent(self, d: Declaration) -> str:
        """The innermost type, or implementation of one, around a declaration."""
        if d.owner:
            return d.owner
        return _at(self._types, d.at) or ""

    @cached_property
    def _types(self) -> tuple[list[int], list]:
        return _innermost([(a + 1, b, name) for a, b, name in sorted(self.scopes) if a + 1 < b])

    @cached_property
    def _callables(self) -> tuple[list[int], list]:
        return _innermost([(d.head, d.end, d) for d in self.declarations if d.callable and d.head < d.end])

    def caller(self, at: int) -> Declaration | None:
        """The innermost function around a place, its header left out."""
        return _at(self._callables, at)

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.feeds, at) + 1

    def chunks(self, least: int = 3) -> Iterator[tuple[int, int, str, str]]:
        """AST-04: (first line, last line, kind, text) of the declarations of ``least`` lines or more, once each."""
        rows, seen = self.text.split("\n"), set()
        for d in self.declarations:
            key = self.line(d.at), self.line(max(d.at, d.end - 1)), d.kind
            if key[1] - key[0] + 1 >= least and key not in seen:
                seen.add(key)
                yield (*key, "\n".join(rows[key[0] - 1 : key[1]]))
