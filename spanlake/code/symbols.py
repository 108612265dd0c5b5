"""The names of a piece of code: what declares them, what imports them, and where
they stand otherwise: as members of a receiver, as option keys of a call, called,
as types. Brackets are matched once; all else looks at a token's neighbours.

Evidence only; whether a name is one's own is decided by operators/symbols.py,
or in a row by decide().
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from spanlake.code.lexer import Token, tokens

# Words that declare the name after them, with its role.
DECLARES = {
    **dict.fromkeys("class interface struct enum trait record protocol impl object extension union module_class".split(), "class"),
    **dict.fromkeys("def function func fn fun sub proc defp defmacro procedure".split(), "function"),
    **dict.fromkeys("const let var val my local dim mut".split(), "variable"),
    **dict.fromkeys("namespace package module mod defmodule".split(), "namespace"),
    "type": "class", "typedef": "class", "typealias": "class",
}
# Words that may stand between a declaring word and its name, or before a type.
MODIFIERS = set(
    "abstract async const constexpr data default explicit export extern final inline inner internal lateinit mut mutable native open override partial private protected pub public readonly ref sealed static "
    "suspend synchronized transient unsafe unsigned signed virtual volatile let var val class get set void_ new_".split()
)
# Words of control and literals, which are never names or types.
WORDS = set(
    "and as assert async await begin break case catch continue default defer del delete do done elif else elseif elsif end endif esac except extends false finally fi for foreach from global go goto if implements import in "
    "instanceof is lambda loop match new nil None none nonlocal not null of or otherwise pass raise require rescue return select self super switch then this throw throws true True False try typeof undefined unless until use "
    "using when where while with yield guard template typename php export package typeof sizeof print echo include extern operator void cls range static public private protected internal final abstract override readonly virtual volatile const let var val "
    "function func fn fun def class interface struct enum trait impl type namespace module mod mut pub crate unsafe dyn ref out params get set init constructor".split()
)
# Types that come with languages; a name after one is declared.
TYPES = set("void int uint long ulong short ushort byte sbyte char bool boolean double float decimal string object dynamic auto size_t ssize_t i8 i16 i32 i64 u8 u16 u32 u64 f32 f64 usize isize str String Integer Boolean any unknown never number".split())
ROLES = ("class", "function", "constant", "property", "variable", "parameter", "namespace")
#: Languages whose parameters have their types first, and whose statements may declare by type.
TYPED = {"java", "csharp", "c", "cpp", "dart", "objectivec", "d", "groovy", "haxe", "php", "unknown"}
MEMBER = {".", "?.", "::"}
#: Languages in which -> is a member's sign, and not that of a result.
ARROWS = {"c", "cpp", "php", "perl", "objectivec"}
_OPEN, _CLOSE = {"(", "[", "{"}, {")": "(", "]": "[", "}": "{"}


@dataclass
class Evidence:
    name: str
    language: str
    first: int
    role: str = "variable"
    declared: bool = False
    imported: bool = False
    receivers: set[str] = field(default_factory=set)
    options: set[str] = field(default_factory=set)
    uses: int = 0


class Reader:
    """The names of one region."""

    def __init__(self, code: str, language: str, offset: int = 0):
        self.language, self.offset = language, offset
        self.all = tokens(code, language)
        self.t = [x for x in self.all if x.kind not in ("comment",)]
        self.found: dict[str, Evidence] = {}
        self.values: dict[str, str] = {}
        self.member = MEMBER | {"->"} if language in ARROWS else MEMBER
        self.match, self.opener = self._brackets()
        self.seen: set[int] = set()

    # ---- structure

    def _brackets(self) -> tuple[dict[int, int], list[int]]:
        """Each bracket's partner, and for each token the bracket it is directly in (-1: none)."""
        match, opener, stack = {}, [], []
        for i, x in enumerate(self.t):
            if x.kind == "sign" and x.text in _CLOSE:
                while stack and self.t[stack[-1]].text != _CLOSE[x.text] and any(self.t[k].text == _CLOSE[x.text] for k in stack[-8:]):
                    stack.pop()
                if stack and self.t[stack[-1]].text == _CLOSE[x.text]:
                    match[stack[-1]] = i
                    match[i] = stack.pop()
            opener.append(stack[-1] if stack else -1)
            if x.kind == "sign" and x.text in _OPEN:
                stack.append(i)
        return match, opener

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "name" and self.t[i].text not in WORDS

    def begins(self, i: int) -> bool:
        """Whether a statement begins at a token."""
        before = self.text(i - 1)
        if before in ("$", "@", "#") and self.t[i - 1].kind == "sign":
            return self.begins(i - 1)
        return i == 0 or before in (";", "{", "}", "do", "then", "else", "begin") or self.t[i - 1].kind == "line" or before == ":" and self.text(i - 2) in (")", "else", "try") or before in MODIFIERS and self.begins(i - 1)

    def led(self, i: int, *signs: str) -> bool:
        """Whether one of these signs, or a line's end, is before a token."""
        return self.text(i - 1) in signs or i > 0 and self.t[i - 1].kind == "line"

    def close(self, i: int) -> int:
        return self.match.get(i, len(self.t))

    def parts(self, i: int) -> list[list[int]]:
        """What stands between the commas directly within a bracket."""
        out, now, k = [], [], i + 1
        end = self.close(i)
        while k < end:
            if self.text(k) == "," and self.t[k].kind == "sign":
                out.append(now)
                now = []
            elif self.t[k].kind != "line":
                now.append(k)
            k = self.close(k) + 1 if self.text(k) in _OPEN and self.t[k].kind == "sign" and self.close(k) < end and now[-1:] == [k] and self._skips(now, k) else k + 1
        return [*out, now]

    @staticmethod
    def _skips(now: list[int], k: int) -> bool:
        """An opening bracket within a part stands for all it holds, but not one that begins it."""
        return now[0] != k

    # ---- evidence

    def _of(self, i: int) -> Evidence:
        name = self.t[i].text
        if name not in self.found:
            self.found[name] = Evidence(name, self.language, self.offset + self.t[i].start)
        return self.found[name]

    def declare(self, i: int, role: str) -> None:
        if not self.is_name(i) or self.text(i) in TYPES or self.text(i) == "$":
            return
        e = self._of(i)
        if role in ("variable", "property") and re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Z]{3,}", e.name):
            role = "constant"
        if not e.declared:
            e.declared, e.role = True, role
        self.seen.add(i)

    def bring(self, i: int) -> None:
        if self.is_name(i):
            self._of(i).imported = True
            self.seen.add(i)

    def root(self, i: int) -> int:
        """The first token of the chain that ends before the sign of a member at i: a.b(c)[d].e -> a."""
        k = i
        while True:
            k -= 1
            if self.text(k) in (")", "]"):
                k = self.match.get(k, -1)
                if k <= 0 or not (self.is_name(k - 1) or self.text(k - 1) in (")", "]")):
                    return -1
                continue
            if not (0 <= k < len(self.t)) or self.t[k].kind != "name":
                return -1
            if self.text(k - 1) not in self.member:
                return k
            k -= 1
            k += self.text(k) not in self.member and 1 or 0
            if self.t[k - 1].kind == "line":
                k -= 1

    def head(self, k: int) -> str:
        """The name a chain begins with, and what that one was made from, and so on."""
        name, known = self.text(k), set()
        while name in self.values and name not in known:
            known.add(name)
            name = self.values[name]
        return name

    def statement_end(self, i: int) -> int:
        own = self.opener[i] if i < len(self.t) else -1
        last = self.close(own) if own >= 0 else len(self.t)
        while i < last and self.text(i) != ";" and self.t[i].kind != "line":
            i = self.close(i) + 1 if self.text(i) in _OPEN and self.t[i].kind == "sign" else i + 1
        return min(i, len(self.t))

    # ---- declarations

    def parameters(self, i: int) -> None:
        """Of the brackets at i."""
        parts = [p for p in self.parts(i) if p]
        go = self.language == "go" and any(sum(self.is_name(k) or self.text(k) in TYPES for k in p) > 1 for p in parts)
        for p in parts:
            names = [k for k in p if self.t[k].kind == "name" and self.text(k) not in ("self", "this", "mut", "final", "const", "ref", "out", "params", "readonly", "private", "public", "protected", "val", "var")]
            stop = next((n for n, k in enumerate(p) if self.text(k) in (":", "=", "?") and n), len(p))
            typed = [k for k in names if k in p[:stop]]
            if not typed:
                continue
            if self.text(p[0]) in ("{", "["):
                for k in range(p[0] + 1, self.close(p[0])):
                    if self.is_name(k) and self.text(k + 1) != ":" and self.text(k - 1) not in ("=", ".", *MEMBER):
                        self.declare(k, "parameter")
            elif self.language == "go":
                if go:
                    self.declare(typed[0], "parameter")
            elif stop < len(p) and self.text(p[stop]) in (":", "?") or self.language in ("python", "ruby", "javascript", "typescript", "kotlin", "rust", "scala"):
                self.declare(typed[-1] if self.language == "swift" else typed[0], "parameter")
            elif len(typed) > 1 or self.language == "php" or self.text(typed[0] - 1) in ("$", "&", "*") or all(len(q) == 1 for q in parts):
                self.declare(typed[-1], "parameter")

    def keyword(self, i: int) -> None:
        """What the declaring word at i declares."""
        role, k = DECLARES[self.text(i)], i + 1
        if self.text(i) in ("object", "type", "my", "local", "module", "package", "record", "sub", "dim", "union", "extension") and not self.begins(i):
            return
        while self.text(k) in MODIFIERS or self.text(k) in ("*", "&", "class", "function", "struct"):
            k += 1
        if role == "function" and self.text(k) == "(" and self.language in ("go", "unknown") and self.is_name(self.close(k) + 1):
            self.parameters(k)
            k = self.close(k) + 1
        if role == "namespace":
            while self.is_name(k):
                self.declare(k, role)
                k += 2 if self.text(k + 1) in self.member | {"\\"} else len(self.t)
            return
        if role == "variable":
            return self.variables(k)
        if self.text(k) == "<":
            k = self.angle(k)
        while self.text(k + 1) in self.member and self.is_name(k + 2):
            k += 2
        self.declare(k, role)
        k += 1
        if self.text(k) == "<":
            k = self.angle(k)
        elif self.text(k) == "[" and self.language in ("go", "scala", "python"):
            k = self.close(k) + 1
        if self.text(k) == "(" and not (role == "class" and self.language in ("python", "ruby")):
            self.parameters(k)
        elif role == "function" and self.text(k) == "=" and self.text(k + 1) == "(":
            self.parameters(k + 1)
        if role == "class":
            self.members(k, self.text(i), self.text(self._named(i)))

    def _named(self, i: int) -> int:
        return next((k for k in range(i + 1, min(i + 6, len(self.t))) if self.is_name(k)), i)

    def angle(self, k: int) -> int:
        """After the angle brackets that open at k."""
        depth = 0
        for n in range(k, min(k + 60, len(self.t))):
            depth += {"<": 1, ">": -1, ">>": -2}.get(self.text(n), 0)
            if depth <= 0:
                return n + 1
        return k + 1

    def variables(self, k: int) -> None:
        """let a = 1, b; const { c, d: e } = f; val (g, h) = i; const int j = 2."""
        while k < len(self.t):
            if self.text(k) in _OPEN:
                for n in range(k + 1, self.close(k)):
                    if self.is_name(n) and self.text(n + 1) != ":" and self.text(n - 1) not in self.member | {"="}:
                        self.declare(n, "variable")
                k = self.close(k) + 1
            elif self.t[k].kind == "name" and self.t[k + 1 : k + 2] and self.is_name(k + 1) and self.text(k + 1) not in ("in", "of"):
                k += 1  # a type
                continue
            elif self.is_name(k):
                self.declare(k, "variable")
                at = k + 1
                if self.text(at) == ":":
                    at = next((n for n in range(at, min(at + 40, len(self.t))) if self.text(n) in ("=", ";", ",") or self.t[n].kind == "line"), at)
                if self.text(at) == "=" and self.is_name(at + 1):
                    self.values.setdefault(self.text(k), self.text(at + 1))
                k += 1
            else:
                return
            own = self.opener[k - 1]
            while k < len(self.t) and not (self.opener[k] == own and self.text(k) in (",", ";")) and self.t[k].kind != "line" and self.opener[k] >= own and not self.text(k) in ("in", "of"):
                k = self.close(k) + 1 if self.text(k) in _OPEN and self.t[k].kind == "sign" else k + 1
            if self.text(k) != ",":
                return
            k += 1
            while k < len(self.t) and self.t[k].kind == "line":
                k += 1

    def members(self, k: int, word: str, owner: str) -> None:
        """What the braces of a class hold; k is after its name."""
        while k < len(self.t) and self.text(k) not in ("{", ";", "}") and not (self.text(k) in DECLARES and self.text(k) not in ("struct", "interface", "enum", "class")) and not (self.t[k].kind == "line" and self.language in ("python", "ruby")):
            k = self.close(k) + 1 if self.text(k) in ("(", "[") else k + 1
        if self.text(k) != "{":
            return
        for n in range(k + 1, self.close(k)):
            if self.opener[n] != k or not self.is_name(n):
                continue
            after = self.text(n + 1)
            if word == "enum" and self.led(n, "{", ",") and after in (",", "=", "(", "}", ";", "\n"):
                self.declare(n, "constant")
            elif self.language == "go" and self.t[n - 1].kind == "line" and (self.t[n + 1].kind == "name" or after in ("*", "[", "(")):
                self.declare(n, "function" if after == "(" else "property")
            elif after == "(" and (self.begins(n) or self.text(n - 1) == "*") and self.text(self.close(n + 1) + 1) in ("{", ":", "=>", ";"):
                if self.text(n) != owner:
                    self.declare(n, "function")
                self.parameters(n + 1)
            elif after in (":", "?", "!", "=") and (self.begins(n) or self.text(n - 1) in (",", "(")) or after == ";" and self.begins(n):
                self.declare(n, "property")

    def typed(self, i: int) -> None:
        """A type and a name: List<String> names =, int[] sizes;, Order load(int id) {."""
        first = self.text(i)
        if first not in TYPES and (first in WORDS or not self.is_name(i)) or self.text(i - 1) in self.member or self.text(i - 1) in ("new", "return", "throw", "case", "goto", "import", "use", "using", "package", "namespace", "else"):
            return
        k = i + 1
        while self.text(k) in self.member and self.t[k + 1 : k + 2] and self.t[k + 1].kind == "name":
            k += 2
        if self.text(k) == "<":
            k = self.angle(k)
        while self.text(k) == "[" and self.close(k) <= k + 2:
            k = self.close(k) + 1
        while self.text(k) in ("*", "&", "?", "&&", "const", "$", "..."):
            k += 1
        if not self.is_name(k) or k == i + 1 and self.t[i].end == self.t[k].start:
            return
        after, inside = self.text(k + 1), self.text(self.opener[i]) if self.opener[i] >= 0 else ""
        if after == "(" and inside != "(":
            then = self.text(self.close(k + 1) + 1)
            if then in ("{", "=>", "throws", "const", "override", "noexcept", "where", ";") or self.t[self.close(k + 1) + 1 : self.close(k + 1) + 2] and self.t[self.close(k + 1) + 1].kind == "line" and self.text(self.close(k + 1) + 2) == "{":
                self.declare(k, "function")
                self.parameters(k + 1)
        elif after in ("=", ";", ":", "{") and inside != "(" and self.begins(i) or inside == "(" and after in ("=", ":", ";") and self.text(i - 1) in ("(", ";", "final", "const"):
            of = self.opener[i]
            field_ = of >= 0 and inside == "{" and self._class_body(of)
            self.declare(k, "property" if field_ else "variable")
            if after == "=" and self.is_name(k + 2):
                self.values.setdefault(self.text(k), self.text(k + 2))

    def _class_body(self, brace: int) -> bool:
        k = brace - 1
        while k >= 0 and self.text(k) not in (";", "{", "}", ")"):
            if self.text(k) in ("class", "interface", "struct", "record", "enum", "trait", "object"):
                return True
            k -= 1
        return False

    def assigned(self, i: int) -> None:
        """a = 1, a, b = c, a := 1, a: int = 1, self.a = 1, $a = 1, @a = 1, A.b = 1 (nothing)."""
        k, names = i, []
        while True:
            while self.text(k) in ("$", "@") and self.t[k].kind == "sign":
                k += 1
            if not self.is_name(k) and self.text(k) not in ("self", "this"):
                return
            if self.text(k) in ("self", "this"):
                if self.text(k + 1) in self.member and self.is_name(k + 2) and self.text(k + 3) in ("=", ":", ":="):
                    self.declare(k + 2, "property")
                return
            names.append(k)
            k += 1
            if self.text(k) != ",":
                break
            k += 1
        at = k
        if self.text(at) == ":" and len(names) == 1 and self.language in ("python", "unknown", "typescript"):
            if self.language != "python" and self.opener[i] >= 0:
                return
            at = next((n for n in range(at, min(at + 40, len(self.t))) if self.text(n) == "=" or self.t[n].kind == "line"), at)
            if self.text(at) != "=" and self.language != "python":
                return
        elif self.text(at) not in ("=", ":=", "<-"):
            return
        for n in names:
            self.declare(n, "property" if self.text(n - 1) == "@" else "variable")
        if len(names) == 1 and self.is_name(at + 1):
            self.values.setdefault(self.text(names[0]), self.text(at + 1))

    def loops(self, i: int) -> None:
        """for a, b in, foreach (var a in, for (T a : b), with a as b, except E as e, catch (E e), a, b := range."""
        word = self.text(i)
        if word in ("for", "foreach"):
            k = i + 1 + (self.text(i + 1) == "(")
            names = []
            for n in range(k, min(k + 16, len(self.t))):
                if self.text(n) in ("in", "of", ":", ":="):
                    for x in names if self.text(n) != ":" else names[-1:]:
                        self.declare(x, "variable")
                    return
                if self.text(n) in (";", "{", "=") or self.t[n].kind == "line":
                    return
                if self.is_name(n) and self.text(n) not in TYPES:
                    names.append(n)
        elif word == "as" and self.language == "php":
            for n in range(i + 1, self.close(self.opener[i]) if self.opener[i] >= 0 else i + 1):
                self.declare(n, "variable")
        elif word == "as" and self.is_name(i + 1) and self.text(i + 2) in (":", ",", ")") and self.language in ("python", "php", "unknown", "csharp"):
            self.declare(i + 1, "variable")
        elif word == "catch" and self.text(i + 1) == "(":
            inside = [k for k in range(i + 2, self.close(i + 1)) if self.is_name(k)]
            if inside:
                self.declare(inside[0] if self.language == "kotlin" or len(inside) == 1 else inside[-1], "variable")

    def lambdas(self, i: int) -> None:
        """(a, b) =>, a =>, (a) ->, |a, b|, { a, b -> and lambda a, b:"""
        x = self.text(i)
        if x == "=>" or x == "->" and self.language in ("java", "kotlin", "coffeescript", "groovy", "unknown"):
            if self.text(i - 1) == ")" and self.text(self.match.get(i - 1, 0) - 1) not in ("fn", "func", "def"):
                self.parameters(self.match.get(i - 1, i))
            elif x == "=>" and (k := self._result(i)) > 0:
                self.parameters(self.match.get(k, k))
            elif self.is_name(i - 1) and self.text(i - 2) not in self.member and self.language not in ("rust", "php", "perl", "ruby", "scala") and (x == "=>" or self.language == "java" or self.text(i - 2) in ("{", ",")):
                k = i - 1
                while self.is_name(k):
                    self.declare(k, "parameter")
                    k -= 2 if self.text(k - 1) == "," and self.language == "kotlin" else len(self.t)
        elif x == "|" and self.language in ("rust", "ruby", "crystal") and self.text(i - 1) in ("(", "{", "do", "move", ",", "="):
            k = i + 1
            while k < len(self.t) and self.text(k) != "|" and self.t[k].kind != "line":
                if self.is_name(k) and self.text(k - 1) in ("|", ",", "&", "(", "mut"):
                    self.declare(k, "parameter")
                k += 1
        elif x == "lambda":
            k = i + 1
            while k < len(self.t) and self.text(k) != ":" and self.t[k].kind != "line":
                if self.is_name(k) and self.text(k - 1) in ("lambda", ",", "*", "**"):
                    self.declare(k, "parameter")
                k += 1

    def _result(self, i: int) -> int:
        """The bracket before the result's type of an arrow, as in (a: b): c =>; else -1."""
        for k in range(i - 1, max(i - 24, 1), -1):
            if self.text(k) == ":" and self.text(k - 1) == ")":
                return k - 1
            if self.text(k) in (";", "{", "=", ",") or self.t[k].kind == "line":
                break
        return -1

    # ---- imports

    def imports(self, i: int) -> int:
        """The import at i, if there is one; where it ends. Names from relative places are one's own."""
        word, end = self.text(i), self.statement_end(i)
        if word == "include" and self.text(i - 1) == "#":
            self._listed(i + 1, end, self.text(i + 1)[:1] == '"')
            return end
        if not self.begins(i):
            return i
        if word == "from" and self.language in ("python", "unknown"):
            at = next((k for k in range(i, end) if self.text(k) == "import"), None)
            if at is None:
                return i
            if self.text(at + 1) == "(":
                end = self.close(at + 1)
            own = self.text(i + 1) == "." or self.text(i + 1) == "..."
            for k in range(i + 1, at):
                if self.is_name(k):
                    (self.declare(k, "namespace") if own else self.bring(k))
            self._listed(at + 1, end, own)
        elif word == "import":
            if self.text(i + 1) == "(" and self.language == "go":
                end = self.close(i + 1)
            strings = [x.text.strip("'\"`") for x in self.t[i:end] if x.kind == "string"]
            own = bool(strings) and strings[-1].startswith((".", "@/", "~/"))
            if any(self.text(k) == "{" for k in range(i, end)):
                end = max(end, self.statement_end(self.close(next(k for k in range(i, end) if self.text(k) == "{"))))
                strings = [x.text.strip("'\"`") for x in self.t[i:end] if x.kind == "string"]
                own = bool(strings) and strings[-1].startswith((".", "@/", "~/"))
            self._listed(i + 1, end, own)
            if self.language == "go":
                self._paths(strings)
        elif word in ("using", "use") and self.text(i + 1) != "(":
            own = self.text(i + 1) in ("crate", "self", "super")
            self._listed(i + 1, end, own)
        else:
            return i
        return end

    def _listed(self, k: int, end: int, own: bool) -> None:
        for n in range(k, end):
            if self.is_name(n):
                if own:
                    self.declare(n, "class" if self.text(n)[:1].isupper() else "function")
                else:
                    self.bring(n)

    def _paths(self, paths: list[str]) -> None:
        for p in paths:
            name = re.sub(r"[^\w].*$", "", p.rsplit("/", 1)[-1])
            if name:
                e = self.found.setdefault(name, Evidence(name, self.language, self.offset))
                e.imported = True

    def required(self, i: int) -> None:
        """const a = require('b'), const { c, d } = require('b')."""
        if self.text(i + 1) != "(" or self.t[i + 2 : i + 3] and self.t[i + 2].kind != "string":
            return
        own = self.text(i + 2).strip("'\"`").startswith(".")
        k = i - 1
        if self.text(k) != "=" or own:
            return
        if self.text(k - 1) == "}":
            for n in range(self.match.get(k - 1, k - 1) + 1, k - 1):
                self.bring(n)
        else:
            self.bring(k - 1)

    # ---- all of it

    def read(self) -> dict[str, Evidence]:
        i = 0
        while i < len(self.t):
            i = max(self.imports(i), i) if self.t[i].kind == "name" and self.text(i) in ("import", "from", "using", "use", "include") else i
            if i >= len(self.t):
                break
            x = self.t[i]
            if x.kind == "name" and self.text(i - 1) not in self.member:
                if x.text in DECLARES:
                    self.keyword(i)
                elif x.text in ("for", "foreach", "as", "catch"):
                    self.loops(i)
                elif x.text == "lambda":
                    self.lambdas(i)
                elif x.text == "require":
                    self.required(i)
            if self.t[i].kind in ("name", "sign") and self.begins(i) and (self.t[i].kind == "name" or x.text in ("$", "@")):
                self.assigned(i)
            if x.kind == "name" and self.language in TYPED:
                self.typed(i)
            if x.kind == "sign" and x.text in ("=>", "->", "|"):
                self.lambdas(i)
            i += 1
        for e in self.found.values():  # what is imported is declared nowhere else
            e.declared = e.declared and not e.imported
        for i, x in enumerate(self.t):
            if x.kind == "name" and (self.is_name(i) or self.text(i - 1) in self.member):
                self.used(i)
        return self.found

    def used(self, i: int) -> None:
        if self.text(i) in TYPES or self.text(i) in WORDS or self.text(i) in MODIFIERS and (self.text(i + 1) in DECLARES or self.text(i + 1) in MODIFIERS):
            return
        e = self._of(i)
        e.uses += 1
        before, after = self.text(i - 1), self.text(i + 1)
        if before in self.member:
            k = self.root(i - 1)
            name = self.head(k) if k >= 0 and (self.is_name(k) or self.text(k) in ("self", "this", "super")) else ""
            if name and name not in ("self", "this", "super"):
                e.receivers.add(name)
            elif name:
                e.receivers.add("self")
            else:
                e.receivers.add("?")
            role = "function" if after == "(" else "property"
        elif after in (":", "=") and i not in self.seen and self.opener[i] >= 0 and (callee := self._callee(i, after)):
            e.options.add(callee)
            role = "property"
        elif before in ("new", "extends", "implements", "instanceof", "class") or after == "::" or e.name[:1].isupper() and (after in ("(", "<", ".", "{") or before in (":", "->") or self.is_name(i + 1)):
            role = "class"
        elif after == "(":
            role = "function"
        else:
            role = "constant" if re.fullmatch(r"[A-Z][A-Z0-9_]{2,}", e.name) else "variable"
        if not e.declared and ROLES.index(role) < ROLES.index(e.role) or e.uses == 1 and not e.declared:
            e.role = role

    def _callee(self, i: int, after: str) -> str:
        """What is called with an object that has this key, or with this named argument."""
        k = self.opener[i]
        if after == ":" and self.text(k) == "{" and self.led(i, "{", ","):
            k = self.opener[k]
        elif not (after == "=" and self.language in ("python", "ruby", "kotlin", "csharp", "php", "unknown") and self.led(i, "(", ",")):
            return ""
        if k < 1 or self.text(k) != "(" or self.t[k - 1].kind != "name":
            return ""
        root = self.root(k)
        return self.head(root) if root >= 0 else ""


def evidence(code: str, language: str = "unknown", offset: int = 0) -> list[Evidence]:
    """What a region says of each of its names, by first place."""
    return sorted(Reader(code, language, offset).read().values(), key=lambda e: (e.first, e.name))


def merged(regions: list[list[Evidence]]) -> dict[str, Evidence]:
    """The evidence of a text's regions together: a declaration anywhere holds everywhere."""
    out: dict[str, Evidence] = {}
    for found in regions:
        for e in found:
            m = out.get(e.name)
            if m is None:
                out[e.name] = e
                continue
            if e.declared and not m.declared:
                m.role, m.declared = e.role, True
            m.imported |= e.imported
            m.receivers |= e.receivers
            m.options |= e.options
            m.uses += e.uses
    return out


STEPS = ("reserved", "declared", "imported", "lexicon", "receiver", "option", "verdict", "fallback", "undeclared")


def decide(names: dict[str, Evidence], lexicon: Callable[[str, str], bool], fallback: set[str], reserved: set[str]) -> dict[str, tuple[str, str]]:
    """name -> (role, the step that decided). declared and undeclared names are one's own."""
    library = {n for n, e in names.items() if e.imported or not e.declared and lexicon(e.language, n)}

    def foreign(receiver: str, language: str) -> bool:
        return receiver in library or receiver not in names and lexicon(language, receiver)

    out = {}
    for n, e in names.items():
        step = (
            "reserved" if n in reserved or n.startswith("__")
            else "declared" if e.declared
            else "imported" if e.imported
            else "lexicon" if lexicon(e.language, n)
            else "receiver" if any(foreign(r, e.language) for r in e.receivers)
            else "option" if any(foreign(o, e.language) for o in e.options)
            else "fallback" if n in fallback
            else "undeclared"
        )
        out[n] = (e.role, step)
    return out
