"""Marks of one source text: definitions with their spans, calls, bindings and imports, each with the definition around it.

A helper for tasks: tokens by one pattern a family of languages (comments and strings are
tokens of their own, so nothing inside them counts), blocks by braces or indentation.
"""

from __future__ import annotations

import re

_NAME, _NUMBER = r"[A-Za-z_$][\w$]*", r"\d[\w.]*"
_QUOTED = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_TAIL = rf"|(?P<name>{_NAME})|(?P<number>{_NUMBER})|(?P<line>\n)|(?P<sign>=>|->|::|\?\.|[^\s])"
_SLASHED = r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_PYTHON = r"(?P<comment>\#[^\n]*)|(?P<string>[rRbBuUfF]{0,2}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|" + f"{_QUOTED}|{_SINGLE}))"
#: Pattern of each family of languages.
PATTERNS = {
    "python": re.compile(_PYTHON + _TAIL, re.S),
    "script": re.compile(f"{_SLASHED}|(?P<string>{_QUOTED}|{_SINGLE}|`(?:\\\\.|[^`\\\\])*`?)" + _TAIL, re.S),
    "rust": re.compile(r"(?P<comment>//[^\n]*|/\*)" + f"|(?P<string>b?r(?P<fence>\\#*)\"[\\s\\S]*?(?:\"(?P=fence)|\\Z)|b?\"(?:\\\\.|[^\"\\\\])*\"?|'(?:\\\\[^']*|[^\\\\'])')|(?P<life>'{_NAME})" + _TAIL, re.S),
    "plain": re.compile(f"{_SLASHED}|(?P<string>{_QUOTED}|{_SINGLE}|`[^`]*`?)" + _TAIL, re.S),
}
FAMILY = {"python": "python", "javascript": "script", "typescript": "script", "rust": "rust", "go": "plain", "java": "plain", "kotlin": "plain", "csharp": "plain", "swift": "plain", "c": "plain", "cpp": "plain"}
#: Words that open definitions, and words before a bracket that call nothing (fixed values).
CLASSES = {"class", "struct", "trait", "interface", "enum", "impl"}
FUNCTIONS = {"function", "fn", "func", "fun", "def"}
PUBLIC = {"export", "pub", "public"}
NOT_CALLS = CLASSES | FUNCTIONS | {"if", "for", "while", "switch", "return", "catch", "elif", "with", "assert", "not", "and", "or", "in", "is", "new", "match", "await", "yield", "lambda", "typeof", "import", "from", "except", "del", "raise", "throw", "else", "do", "super", "using", "lock", "when", "guard", "print", "async"}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n])+/[a-z]*")


def tokens_of(text: str, family: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, text, start, line, column) of names, numbers, strings, signs and line ends; comments are dropped."""
    out, at, line, begin, pattern = [], 0, 1, 0, PATTERNS[family]
    while m := pattern.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "fence":
            kind = "string"
        if kind == "comment" and m[0] == "/*":  # comments of this family nest
            depth = 1
            while depth and (n := re.compile(r"/\*|\*/").search(text, at)):
                depth, at = depth + (1 if n[0] == "/*" else -1), n.end()
            at = len(text) if depth else at
        if kind == "sign" and m[0] == "/" and family == "script" and (not out or out[-1][1] in "(,=:[!&|?{};\n" or out[-1][1] in ("return", "=>")) and (n := _REGEX.match(text, m.start())):
            kind, at = "comment", n.end()
        whole = text[m.start() : at]
        if kind not in ("comment", "life"):
            out.append((kind, whole, m.start(), line, m.start() - begin))
        if (k := whole.count("\n")):
            line, begin = line + k, m.start() + whole.rindex("\n") + 1
    return out


def _closing(t: list, i: int) -> int:
    """Place behind the bracket that closes the one at ``i``."""
    depth = 0
    for k in range(i, len(t)):
        depth += t[k][1] in ("(", "[", "{")
        depth -= t[k][1] in (")", "]", "}")
        if not depth:
            return k + 1
    return len(t)


def _imports(t: list, i: int, family: str, word: str, language: str) -> list[tuple[str, list[str]]]:
    """Modules that the statement at ``i`` names, with 'local=exported' of the names it takes."""
    stop = next((k for k in range(i + 1, len(t)) if t[k][1] == ";" or (t[k][0] == "line" and not _open(t, i, k))), len(t))
    part = [x for x in t[i + 1 : stop] if x[0] != "line"]
    words = [x[1] for x in part]

    def pairs(ws: list[str]) -> list[str]:
        return [f"{g[2] or g[1]}={g[1]}" for g in re.finditer(rf"({_NAME})(?: as ({_NAME}))?(?: ,|$| \}})", " ".join(w for w in ws if w not in ("(", ")", "{", "type")))]

    strings = [x[1].strip("'\"`") for x in part if x[0] == "string"]
    if family == "python":
        if word == "from" and "import" in words:
            k = words.index("import")
            return [("".join(words[:k]), pairs(words[k + 1 :]))]
        return [(m.split("=")[1], [m]) for m in [f"{g[2] or g[1].replace(' ', '')}={g[1].replace(' ', '')}" for g in re.finditer(rf"({_NAME}(?: \. {_NAME})*)(?: as ({_NAME}))?", " ".join(words))]] if word == "import" else []
    if family == "script":
        if not strings:
            return []
        k = words.index("from") if "from" in words else 0
        head = [f"{words[0]}=default"] if k and part[0][0] == "name" and words[0] not in ("type",) else []
        if "*" in words[:k] and "as" in words[:k]:
            head.append(f"{words[words.index('as') + 1]}=*")
        return [(strings[-1], head + (pairs(words[words.index("{") + 1 : k]) if "{" in words[:k] else []))]
    if family == "rust":
        path = "".join(words).split("{")[0].rstrip(":")
        return [(path, [])] if path else []
    if language == "go":
        return [(s, []) for s in strings]
    return [("".join(words), [])] if words and "(" not in words and "=" not in words else []


def _open(t: list, i: int, k: int) -> bool:
    """Whether a bracket opened after ``i`` is still open at ``k``."""
    return sum((x[1] in ("(", "{", "[")) - (x[1] in (")", "}", "]")) for x in t[i:k]) > 0


def marks(text: str, language: str) -> list[tuple]:
    """(kind, name, receiver, scope, start, stop, line, extra) of a text.

    Kinds: class, function, method (name; receiver: the class; extra: 'public' if it is exported),
    call and new (name, receiver), ref (a name that is used, once a scope), bind (name = new object of
    type receiver), import (name: the module; extra: local=exported), export (name; receiver: the
    module it is taken from; extra: the exported name). scope is the start of the innermost
    definition around, -1 outside all."""
    family = FAMILY.get(language)
    if family is None:
        return []
    t = tokens_of(text, family)
    out: list[list] = []
    stack: list[tuple[int, int]] = []  # open definitions: place in out, depth or indentation
    pending: tuple[list, int] | None = None  # a head whose body has not begun, and its bracket depth
    depth = brackets = indent = ended = 0
    taken: set[int] = set()  # tokens that name a definition
    used: set[tuple[int, str]] = set()

    def close(end: int) -> None:
        out[stack.pop()[0]][5] = end

    def define(kind: str, i: int, owner: str | None, public: bool) -> list:
        inside = out[stack[-1][0]] if stack else None
        if kind == "function" and owner is None and inside is not None and inside[0] == "class":
            owner = inside[1]
        taken.add(i)
        row = ["method" if owner else kind, t[i][1], owner, inside[4] if inside else -1, t[i][2], len(text), t[i][3], ["public"] if public else []]
        out.append(row)
        return row

    text_at = lambda k: t[k][1] if 0 <= k < len(t) else ""
    is_name = lambda k: 0 <= k < len(t) and t[k][0] == "name"
    i = -1
    while (i := i + 1) < len(t):
        kind, w, at, line, column = t[i]
        first = i == 0 or t[i - 1][0] == "line"
        if kind == "line":
            continue
        last, ended = ended, at + len(w)
        if family == "python" and first and not brackets:
            indent = column
            while stack and stack[-1][1] >= indent:
                close(last)
        if w in ("(", "["):
            brackets += 1
        elif w in (")", "]"):
            brackets = max(0, brackets - 1)
        elif w == "{" and family != "python":
            depth += 1
            if pending and brackets == pending[1]:
                stack.append((out.index(pending[0]), depth))
                pending = None
        elif w == "}" and family != "python":
            if stack and stack[-1][1] == depth:
                close(at + 1)
            depth = max(0, depth - 1)
        elif w == ";" and pending and brackets == pending[1]:
            pending[0][5], pending = at, None
        if kind != "name":
            continue
        before = [text_at(k) for k in range(max(0, i - 4), i)]
        public = bool(PUBLIC & set(before)) and not {";", "}", "{"} & set(before[next((k for k, b in enumerate(before) if b in PUBLIC), 0) :])
        scope = out[stack[-1][0]][4] if stack else -1
        if family == "python":
            if w in ("def", "class") and is_name(i + 1):
                define("class" if w == "class" else "function", i + 1, None, not stack and not text_at(i + 1).startswith("_"))
                stack.append((len(out) - 1, indent))
        elif w in CLASSES and is_name(i + 1) or w == "impl":
            k = i + 1
            if w == "impl":  # the type follows 'for', or comes first
                body = next((x for x in range(k, len(t)) if text_at(x) in ("{", ";")), len(t))
                names = [x for x in range(k, body) if t[x][0] == "name"]
                after = [x for x in names if text_at(x - 1) == "for"]
                k = (after or names or [k])[0]
            if is_name(k):
                pending = (define("class", k, None, public), brackets)
        elif w in FUNCTIONS and (is_name(i + 1) or text_at(i + 1) in ("(", "*")):
            k, owner = i + 1 + (text_at(i + 1) == "*"), None
            if text_at(k) == "(" and w == "func":  # a method with its receiver first
                end = _closing(t, k)
                owner = next((t[x][1] for x in range(end - 1, k, -1) if t[x][0] == "name"), None)
                k = end
            if is_name(k):
                pending = (define("function", k, owner, public or (language == "go" and t[k][1][0].isupper())), brackets)
            elif w == "function" and text_at(i - 1) == "=" and is_name(i - 2):
                pending = (define("function", i - 2, None, bool(PUBLIC & set(text_at(x) for x in range(i - 6, i - 1)))), brackets)
        elif family == "script" and text_at(i + 1) == "=" and text_at(i - 1) in ("const", "let", "var"):
            k = i + 2 + (text_at(i + 2) == "async")
            end = _closing(t, k) if text_at(k) == "(" else k + 1
            if text_at(end) == "=>":
                row = define("function", i, None, public)
                if text_at(end + 1) == "{":
                    pending = (row, brackets)
                else:
                    row[5] = next((t[x][2] for x in range(end, len(t)) if t[x][0] == "line" or text_at(x) == ";"), len(text))
        elif text_at(i + 1) == "(" and i not in taken and stack and out[stack[-1][0]][0] == "class" and stack[-1][1] == depth and not brackets and w not in NOT_CALLS:
            end = _closing(t, i + 1)
            rest = [text_at(x) for x in range(end, min(end + 12, len(t)))]
            body = next((x for x in rest if x in ("{", ";", "}", "=")), "")
            if body == "{":
                pending = (define("function", i, None, public), brackets)
        call = text_at(i + 1) == "(" or (text_at(i + 1) == "?." and text_at(i + 2) == "(")
        if w in ("import", "from", "use", "using") and first and not (w == "from" and family != "python"):
            for module, names in _imports(t, i, family, w, language):
                out.append(["import", module, None, scope, at, at, line, names])
        elif w == "require" and call and i + 2 < len(t) and t[i + 2][0] == "string":
            out.append(["import", t[i + 2][1].strip("'\"`"), None, scope, at, at, line, [f"{text_at(i - 2)}=*"] if text_at(i - 1) == "=" and is_name(i - 2) else []])
        elif w == "export" and family == "script" and first:
            stop = next((k for k in range(i, len(t)) if text_at(k) in (";", "}") or (t[k][0] == "line" and "{" not in [text_at(x) for x in range(i, k)])), len(t))
            if text_at(i + 1) == "{":
                module = t[stop + 2][1].strip("'\"`") if text_at(stop + 1) == "from" and stop + 2 < len(t) else None
                body = " ".join(t[x][1] for x in range(i + 2, stop) if t[x][0] != "line")
                for g in re.finditer(rf"({_NAME})(?: as ({_NAME}))?(?: ,|$)", body):
                    out.append(["export", g[1], module, scope, at, at, line, [g[2] or g[1]]])
            elif text_at(i + 1) == "*" and text_at(i + 2) == "from":
                out.append(["export", "*", t[i + 3][1].strip("'\"`") if i + 3 < len(t) else None, scope, at, at, line, ["*"]])
            elif text_at(i + 1) == "default":
                names = [t[k][1] for k in range(i + 2, min(i + 6, len(t))) if t[k][0] == "name" and t[k][1] not in ("async", "function", "class")]
                out.append(["export", names[0] if names else "default", None, scope, at, at, line, ["default"]])
        elif call and i not in taken and (w not in NOT_CALLS or text_at(i - 1) in (".", "::", "?.")):
            dotted = text_at(i - 1) in (".", "::", "?.")
            out.append(["new" if text_at(i - 1) == "new" else "call", w, text_at(i - 2) if dotted and is_name(i - 2) else None, scope, at, at, line, []])
            k = i - 1 - (text_at(i - 1) == "new")
            if w[0].isupper() and not dotted and text_at(k) == "=" and is_name(k - 1):
                bound = k - 1
                member = text_at(bound - 1) == "."  # self.x = Foo()
                out.append(["bind", text_at(bound), w, scope, at, at, line, ["member"] if member else []])
        elif not call and i not in taken and w not in NOT_CALLS and (scope, w) not in used:
            used.add((scope, w))
            out.append(["ref", w, None, scope, at, at, line, []])
    while stack:
        close(len(text))
    return [tuple(r) for r in out]
