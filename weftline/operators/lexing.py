"""Lexical structure of source text in 13 languages: what is code, and which brackets belong together.

An automaton with a stack of states walks a text: code, comments (nested where the language nests them), strings with their
escapes, raw and verbatim strings, here-documents, regular expressions, and the code inside interpolated strings. `mask` blanks
all that is no code, so that what reads it sees no bracket or keyword of a string or a comment, at unchanged places.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

_OPENERS, _CLOSERS = "([{", {")": "(", "]": "[", "}": "{"}


@dataclass(frozen=True)
class Text:
    """A kind of string: how it starts, what ends it, its escapes, and what brings code into it."""

    start: str
    end: str = ""
    escape: str = "\\"
    lines: bool = False
    code: str = ""


@dataclass(frozen=True)
class Lexicon:
    line: tuple[str, ...] = ("//",)
    block: tuple[str, str] | None = ("/*", "*/")
    nested: bool = False
    texts: tuple[Text, ...] = ()
    regex: bool = False
    heredoc: str = ""


_DOUBLE, _SINGLE = Text('"', '"'), Text("'", "'")
_CHARACTER = Text(r"'(?:\\(?:u\{[^}\n]*\}|[^\n])[^'\n]{0,8}|[^\\'\n])'")
_SCRIPT = Lexicon(texts=(Text("`", "`", lines=True, code="${"), _DOUBLE, _SINGLE), regex=True)
LEXICONS = {
    "csharp": Lexicon(texts=(Text(r'(?P<codes>\$*)(?P<fence>"{3,})', escape="", lines=True), Text(r'(?:\$@|@\$)"', '"', '"', True, "{"), Text('@"', '"', '"', True), Text(r'\$"', '"', code="{"), _DOUBLE, _CHARACTER)),
    "typescript": _SCRIPT,
    "javascript": _SCRIPT,
    "python": Lexicon(("#",), None, texts=tuple(Text(f"{p}{q}", q, lines=len(q) == 3, code=c) for q in ('"""', "'''", '"', "'") for p, c in ((r"\b(?i:f|fr|rf)", "{"), (r"(?:\b(?i:r|b|u|br|rb))?", "")))),
    "go": Lexicon(texts=(Text("`", "`", "", True), _DOUBLE, _CHARACTER)),
    "rust": Lexicon(nested=True, texts=(Text(r'\bb?r(?P<fence>#*)"', escape="", lines=True), Text('"', '"', lines=True), _CHARACTER)),
    "java": Lexicon(texts=(Text('"""', '"""', lines=True), _DOUBLE, _CHARACTER)),
    "cpp": Lexicon(texts=(Text(r'\b(?:u8|[uUL])?R"(?P<fence>[^()\\\s"]{0,16})\(', escape="", lines=True), _DOUBLE, Text(r"(?<![0-9A-Fa-f])'", "'"))),
    "c": Lexicon(texts=(_DOUBLE, _SINGLE)),
    "php": Lexicon(("//", "#(?!\\[)"), texts=(Text('"', '"', lines=True), Text("'", "'", lines=True)), heredoc=r"<<<[ \t]*(['\"]?)(\w+)\1"),
    "ruby": Lexicon(("#",), None, texts=(Text('"', '"', lines=True, code="#{"), Text("'", "'", lines=True), Text("`", "`", lines=True)), regex=True, heredoc=r"<<[~-](['\"`]?)(\w+)\1"),
    "swift": Lexicon(nested=True, texts=(Text(r'(?P<fence>#+)"', escape="", lines=True), Text('"""', '"""', lines=True, code="\\("), Text('"', '"', code="\\("))),
    "scala": Lexicon(nested=True, texts=(Text(r'\b[a-z]\w*"""', '"""', "", True, "${"), Text('"""', '"""', "", True), Text(r'\b[a-z]\w*"', '"', code="${"), _DOUBLE, _CHARACTER)),
}
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+*%<>~^-]|\b(?:return|typeof|case|in|of|delete|void|throw|new|do|else|and|or|not|if|unless|when|while))\s*$")


def _openers(lexicon: Lexicon) -> re.Pattern[str]:
    parts = [f"(?P<line>{'|'.join(lexicon.line)})"]
    if lexicon.block:
        parts.append(f"(?P<block>{re.escape(lexicon.block[0])})")
    if lexicon.heredoc:
        parts.append(f"(?P<here>{lexicon.heredoc.replace('(', '(?P<quote>', 1).replace('(' + chr(92) + 'w+)', '(?:' + chr(92) + 'w+)').replace(chr(92) + '1', '(?P=quote)')})")
    for i, t in enumerate(lexicon.texts):
        parts.append(f"(?P<t{i}>{re.sub(r'[?]P<(codes|fence)>', '?:', t.start)})")
    if lexicon.regex:
        parts.append("(?P<regex>/)")
    parts.append(r"(?P<bracket>[{}()])")
    return re.compile("|".join(parts))


_COMPILED = {name: _openers(x) for name, x in LEXICONS.items()}


def _inside(text: str, at: int, t: Text, close: str, code: str) -> tuple[int, bool]:
    """From inside a string: where its end, or the code inside it, begins; whether it is code."""
    stops = [re.escape(close)]
    if t.escape == "\\":
        stops.append(r"\\(?s:.)")
    elif t.escape:
        stops.append(re.escape(t.escape * 2))
    if code:
        if code == "{":
            stops.append(r"\{\{")
        stops.append(re.escape(code))
    if not t.lines:
        stops.append("\n")
    # What is longer, or an escape, comes first: a doubled quote before the quote, an interpolation before the escape it looks like.
    order = ([re.escape(code)] if code.startswith("\\") else []) + stops[1:] + stops[:1]
    for m in re.compile("|".join(f"(?:{s})" for s in order)).finditer(text, at):
        if m[0] == "\n":
            return m.start(), False
        if m[0] == close:
            return m.end(), False
        if code and m[0] == code:
            return m.end(), True
    return len(text), False


def mask(text: str, language: str) -> str:
    """``text`` with blanks for everything that is no code: comments, strings with their quotes, regular expressions. Line feeds stay."""
    lexicon, rx = LEXICONS[language], _COMPILED[language]
    out, kept, at, n = [], 0, 0, len(text)
    # Strings that code was entered from: (kind, its end, what brings code in, brackets open since).
    stack: list[tuple[Text, str, str, int]] = []
    waiting: list[str] = []

    def blank(start: int, end: int) -> None:
        nonlocal kept
        out.append(text[kept:start])
        out.append(re.sub(r"[^\n]", " ", text[start:end]))
        kept = end

    if language == "php" and "<?" in text:
        at = text.index("<?")
        blank(0, at)
    if language == "ruby":
        text_ = re.sub(r"(?ms)^=begin\b.*?(?:^=end\b[^\n]*|\Z)", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
        if text_ != text:
            return mask(text_, language)
    while at < n:
        m = rx.search(text, at)
        if waiting:
            line_end = text.find("\n", at)
            if line_end >= 0 and (m is None or m.start() > line_end):
                end = re.compile(rf"^[ \t]*{waiting.pop(0)}\b", re.M).search(text, line_end + 1)
                stop = end.end() if end else n
                blank(line_end, stop)
                at = stop
                continue
        if m is None:
            break
        which, start = m.lastgroup, m.start()
        if which == "line":
            end = text.find("\n", start)
            at = n if end < 0 else end
            if language == "php" and (end := text.find("?>", start, at)) >= 0:
                at = end
            blank(start, at)
        elif which == "block":
            opener, closer = lexicon.block
            if lexicon.nested:
                depth, at = 1, m.end()
                while depth and at < n:
                    step = re.compile(f"{re.escape(opener)}|{re.escape(closer)}").search(text, at)
                    if step is None:
                        at = n
                        break
                    depth += 1 if step[0] == opener else -1
                    at = step.end()
            else:
                end = text.find(closer, m.end())
                at = n if end < 0 else end + len(closer)
            blank(start, at)
        elif which == "here":
            waiting.append(re.match(lexicon.heredoc, m[0])[2])
            at = m.end()
            blank(start, at)
        elif which == "regex":
            found = _REGEX.match(text, start)
            before = "".join(x[-80:] for x in out[-4:])[-80:] + text[max(kept, start - 80) : start]
            if found and _BEFORE_REGEX.search(before.rstrip(" \t")):
                at = found.end()
                blank(start, at)
            else:
                at = m.end()
        elif which == "bracket":
            at = m.end()
            if stack:
                t, close, code, depth = stack[-1]
                pair = ("(", ")") if code.endswith("(") else ("{", "}")
                if m[0] == pair[0]:
                    stack[-1] = (t, close, code, depth + 1)
                elif m[0] == pair[1]:
                    if depth:
                        stack[-1] = (t, close, code, depth - 1)
                    else:
                        stack.pop()
                        at, entered = _inside(text, m.end(), t, close, code)
                        if entered:
                            stack.append((t, close, code, 0))
                        blank(start, at)
        else:
            t = lexicon.texts[int(which[1:])]
            parts = re.match(t.start, text[start : m.end()])
            groups = parts.groupdict() if parts else {}
            close, code = t.end, t.code
            if "fence" in groups:
                close = {"csharp": groups["fence"], "rust": '"' + groups["fence"], "swift": '"' + groups["fence"], "cpp": f"){groups['fence']}\""}[language]
                code = "{" * len(groups.get("codes") or "")
            if not close:  # a character: the pattern is all of it
                at = m.end()
                blank(start, at)
                continue
            at, entered = _inside(text, m.end(), t, close, code)
            if entered:
                stack.append((t, close, code, 0))
            blank(start, at)
    out.append(text[kept:])
    return "".join(out)


class Brackets:
    """Which brackets of masked code belong together. A closing bracket without its opening one is left out; one left open ends with the text."""

    def __init__(self, code: str) -> None:
        self.close: dict[int, int] = {}
        self.places: list[int] = []
        self.inner: list[int] = []
        stack: list[int] = []
        for m in re.finditer(r"[()\[\]{}]", code):
            if m[0] in _OPENERS:
                stack.append(m.start())
            else:
                depth = next((k for k in range(len(stack) - 1, max(-1, len(stack) - 40), -1) if code[stack[k]] == _CLOSERS[m[0]]), None)
                if depth is None:
                    continue
                self.close[stack[depth]] = m.start()
                del stack[depth:]
            self.places.append(m.start())
            self.inner.append(stack[-1] if stack else -1)
        for i in stack:
            self.close.setdefault(i, len(code))

    def around(self, at: int) -> int:
        """The innermost bracket that is open before ``at``; -1 if none."""
        k = bisect.bisect_left(self.places, at) - 1
        return self.inner[k] if k >= 0 else -1
