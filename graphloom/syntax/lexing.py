"""Tokens of ten languages.

A token has a kind (`i` for a name, `n` for a number or a literal word, `s` for a text, a reserved word or a sign for
itself), its spelling, whether it is the first on its line, and the offset at which it ends. Texts may hold expressions (templates, interpolations,
markup elements): those are tokenised in place and handed to the parser as streams of their own.
"""

from __future__ import annotations

import re


class Bad(Exception):
    """The text is not of the language."""


class Tokens:
    """Parallel lists; three empty kinds close them, so that a parser may look ahead."""

    __slots__ = ("kinds", "words", "fresh", "places")

    def __init__(self):
        self.places: list[int] = []
        self.kinds: list[str] = []
        self.words: list[str] = []
        self.fresh: list[bool] = []

    def close(self) -> Tokens:
        self.kinds += ["", "", "", ""]
        self.words += ["", "", "", ""]
        self.fresh += [True] * 4
        return self


# The reserved words of each language.
RESERVED = {
    "java": "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try void volatile while",
    "csharp": "abstract as base break case catch checked class const continue default delegate do else enum event explicit extern finally fixed for foreach goto if implicit in interface internal is lock namespace new operator out override params private protected public readonly ref return sealed sizeof stackalloc static struct switch this throw try typeof unchecked unsafe using virtual void volatile while",
    "javascript": "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with",
    "c": "auto break case const continue default do else enum extern for goto if inline register restrict return sizeof static struct switch typedef union volatile while _Atomic _Alignas _Alignof _Generic _Noreturn _Static_assert _Thread_local",
    "cpp": "alignas alignof asm auto break case catch class concept const consteval constexpr constinit const_cast continue co_await co_return co_yield decltype default delete do dynamic_cast else enum explicit export extern for friend goto if inline mutable namespace new noexcept operator private protected public register reinterpret_cast requires return sizeof static static_assert static_cast struct switch template this thread_local throw try typedef typeid typename union using virtual volatile while",
    "go": "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var",
    "rust": "as break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while async await abstract become box do final macro override priv typeof unsized virtual yield try",
    "kotlin": "as break class continue do else for fun if in interface is object package return super this throw try typealias val var when while",
    "swift": "as associatedtype break case catch class continue default defer deinit do else enum extension fallthrough fileprivate for func guard if import in init inout internal is let operator precedencegroup private protocol public repeat rethrows return self Self static struct subscript super switch throw throws try typealias var where while",
}
RESERVED["typescript"] = RESERVED["javascript"]
#: Words that stand for values, and the names of built-in types.
LITERALS = {"java": "true false null", "csharp": "true false null", "javascript": "true false null", "typescript": "true false null", "cpp": "true false nullptr", "rust": "true false", "kotlin": "true false null", "swift": "true false nil"}
PRIMITIVES = {
    "java": "boolean byte char double float int long short",
    "csharp": "bool byte char decimal double float int long object sbyte short string uint ulong ushort",
    "c": "char double float int long short signed unsigned void _Bool _Complex",
    "cpp": "bool char char8_t char16_t char32_t double float int long short signed unsigned void wchar_t",
}
_NAMES = {
    "java": r"(?:[^\W\d]|\$)[\w$]*", "csharp": r"@?[^\W\d]\w*", "javascript": r"#?(?:[^\W\d]|\$)[\w$]*", "rust": r"(?:r#)?[^\W\d]\w*", "kotlin": r"[^\W\d]\w*|`[^`\n]+`", "swift": r"[^\W\d]\w*|\$\d+|\$[^\W\d]\w*|`[^\W\d]\w*`",
}
_NAMES["typescript"] = _NAMES["javascript"]
_SUFFIX = {"java": "[lLfFdD]?", "csharp": "[uUlLfFdDmM]{0,2}", "javascript": "n?", "typescript": "n?", "c": "[uUlLfFjJ]{0,3}", "cpp": r"(?:[uUlLfFzZ]{0,3}|_\w+|s|ms|us|ns|h|min)", "go": "i?", "rust": "(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?", "kotlin": "[uU]?[lLfF]?", "swift": ""}
_FRACTION = {"rust": r"\.(?:\d[\d_]*|(?![\w.]))", "kotlin": r"\.\d[\d_]*", "swift": r"\.\d[\d_]*", "cpp": r"\.[\d']*", "csharp": r"\.\d[\d_]*", "javascript": r"\.(?![.\w])|\.\d[\d_]*", "java": r"\.(?!\.)[\d_]*", "c": r"\.\d*", "go": r"\.[\d_]*"}
_FRACTION["typescript"] = _FRACTION["javascript"]
_SIGNS = {
    "java": r"\.\.\.|->|::|\+\+|--|&&|\|\||<<=|<<|[-+*/%&|^!=<]=|>=|[-+*/%&|^~!=<>?:;,.@]",
    "csharp": r"=>|->|::|\+\+|--|&&|\|\||\?\?=|\?\?|\?\.(?!\d)|\.\.|<<=|<<|[-+*/%&|^!=<]=|>=|[-+*/%&|^~!=<>?:;,.@]",
    "javascript": r"\.\.\.|=>|===|!==|\+\+|--|&&=|&&|\|\|=|\|\||\?\?=|\?\?|\?\.(?!\d)|\*\*=|\*\*|<<=|<<|[-+*/%&|^!=<]=|>=|[-+*/%&|^~!=<>?:;,.@]",
    "c": r"\.\.\.|->|\+\+|--|&&|\|\||<<=|<<|[-+*/%&|^!=<]=|>=|[-+*/%&|^~!=<>?:;,.]",
    "cpp": r"\.\.\.|->\*|->|::|\.\*|\+\+|--|&&|\|\||<=>|<<=|<<|[-+*/%&|^!=<]=|>=|[-+*/%&|^~!=<>?:;,.]",
    "go": r"\.\.\.|:=|<-|\+\+|--|&&|\|\||&\^=|&\^|<<=|<<|[-+*/%&|^!=<]=|>=|[-+*/%&|^!=<>:;,.~]",
    "rust": r"\.\.\.|\.\.=|\.\.|=>|->|::|&&|\|\||<<=|<<|[-+*/%&|^!=<]=|>=|[-+*/%&|^!=<>?:;,.@#$~]",
    "kotlin": r"\.\.<|\.\.|->|::|===|!==|\+\+|--|&&|\|\||!!|\?\.|\?:|[-+*/%!=<]=|>=|[-+*/%!=<>?:;,.@&#]",
    "swift": r"\.\.\.|\.\.<|->|===|!==|&&|\|\||\?\?|<<=|<<|&[-+*]|[-+*/%&|^!=<~]=|>=|[-+*/%&|^~!=<>?:;,.@#\\]",
}
_SIGNS["typescript"] = _SIGNS["javascript"]
_QUOTED = r'"(?:[^"\\\n]|\\[^\n])*"'
_CHAR = r"'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{1,8}|U[\da-fA-F]{8}|x[\da-fA-F]{1,4}|[0-7]{1,3}|[^\n]))'"
#: Literals without expressions in them.
_TEXTS = {
    "java": rf'"""(?s:(?:[^\\]|\\.)*?)"""|{_QUOTED}|{_CHAR}',
    "csharp": rf'"""(?s:.*?)"""+|@"(?:[^"]|"")*"|{_QUOTED}(?:u8)?|{_CHAR}',
    "javascript": r'"(?:[^"\\\n]|\\(?s:.))*"|\'(?:[^\'\\\n]|\\(?s:.))*\'',
    "c": r'(?:u8|[uUL])?"(?:[^"\\\n]|\\(?s:.))*"|[uUL]?\'(?:[^\'\\\n]|\\.)+\'',
    "cpp": r'(?:u8|[uUL])?R"(?P<mark>[^()\\\s]*)\((?s:.*?)\)(?P=mark)"|(?:u8|[uUL])?"(?:[^"\\\n]|\\(?s:.))*"(?:_?[a-z]+\b)?|(?:u8|[uUL])?\'(?:[^\'\\\n]|\\.)+\'',
    "go": r"`[^`]*`|" + _QUOTED + r"|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|[^\n]))'",
    "rust": r'(?:b|c)?r(?P<mark>#*)"(?s:.*?)"(?P=mark)|[bc]?"(?:[^"\\]|\\(?s:.))*"|b?\'(?:[^\'\\\n]|\\(?:u\{[\da-fA-F_]+\}|x[\da-fA-F]{2}|[^\n]))\'',
    "kotlin": _CHAR,
    "swift": r"/(?!)",
}
_TEXTS["typescript"] = _TEXTS["javascript"]
#: Literals that may hold expressions: how they begin.
_HOLED = {"javascript": "`", "typescript": "`", "kotlin": r'"""|"', "swift": r'#*"""|#*"', "csharp": r'\$+"""|\$@"|@\$"|\$"'}
_NESTED = ("rust", "kotlin", "swift")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*")
_TAG = re.compile(r"<(?:(?P<close>/)\s*)?(?P<tag>[A-Za-z_$][\w.:$-]*)?\s*")
_ATTRIBUTE = re.compile(r"\s*(?:[A-Za-z_$][\w:.$-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|(?P<hole>\{)))?|(?P<spread>\{\s*\.\.\.))")
_TAG_END = re.compile(r"\s*(/?)>")
_CHILD = re.compile(r"[<{>}]")
_NOTE = re.compile(r"/\*|\*/")
#: After these a slash divides and an angle bracket compares.
_OPERAND_END = frozenset(["i", "n", "s", ")", "]", "}", "this", "super", "++", "--"])


class Lexer:
    def __init__(self, name: str):
        self.name = name
        self.words = {w: w for w in RESERVED[name].split()} | dict.fromkeys(LITERALS.get(name, "").split(), "n") | dict.fromkeys(PRIMITIVES.get(name, "").split(), "prim")
        self.go, self.script = name == "go", name in ("javascript", "typescript")
        self.members = name in ("javascript", "typescript", "swift")
        line = r"//(?:[^\n\\]|\\(?s:.))*" if name in ("c", "cpp") else r"//[^\n]*"
        digits = r"\d[\d_']*" if name in ("cpp",) else r"\d[\d_]*"
        hexa = r"[\da-fA-F_']" if name == "cpp" else r"[\da-fA-F_]"
        number = rf"(?:0[xX]{hexa}+(?:\.{hexa}*)?(?:[pP][-+]?\d+)?|0[bB][01_']+|0[oO][0-7_]+|{digits}(?:{_FRACTION[name]})?(?:[eE][-+]?\d[\d_]*)?" + ("" if name in ("rust", "swift", "kotlin") else r"|\.\d[\d_]*(?:[eE][-+]?\d+)?") + rf"){_SUFFIX[name]}(?!\w)"
        if name == "kotlin":
            number += r"|\.\d[\d_]*(?:[eE][-+]?\d+)?[fF]?(?!\w)"
        extra = ""
        if name == "rust":
            extra = r"|(?P<life>'[^\W\d]\w*(?!'))"
        if self.script:
            extra = r"|(?P<bang>\A#![^\n]*)"
        if name == "swift":
            extra = r"|(?P<pound>#[^\W\d]\w*)"
        if name in ("kotlin", "swift"):
            extra += r"|(?P<bang>\A#![^\n]*)"
        holed = rf"|(?P<holed>{_HOLED[name]})" if name in _HOLED else ""
        self.match = re.compile(
            rf"[ \t\f\v\xa0]*(?:(?P<nl>\n)|(?P<name>{_NAMES.get(name, r'[^\W\d]\w*')})|(?P<line>{line})|(?P<block>/\*)|(?P<number>{number})|(?P<bracket>[()\[\]{{}}])|(?P<text>{_TEXTS[name]}){extra}{holed}|(?P<sign>{_SIGNS[name]})|(?P<end>\Z))"
            if name not in ("cpp", "c", "rust")
            else rf"[ \t\f\v\xa0]*(?:(?P<nl>\n)|(?P<text>{_TEXTS[name]})|(?P<name>{_NAMES.get(name, r'[^\W\d]\w*')})|(?P<line>{line})|(?P<block>/\*)|(?P<number>{number})|(?P<bracket>[()\[\]{{}}]){extra}|(?P<sign>{_SIGNS[name]})|(?P<end>\Z))",
            re.M,
        ).match
        self.holes: list[Tokens] = []
        self.last: tuple[str | None, tuple | None] = (None, None)

    def run(self, text: str) -> tuple[Tokens, list[Tokens]]:
        """The tokens of a text and those of the expressions within its literals; those of the last text are kept, as languages
        that share a lexer meet a text one after the other. Parsers do not change them."""
        if self.last[0] is text:
            return self.last[1]
        self.holes = []
        tokens, _ = self._lex(text, 0, "")
        self.last = text, (tokens, self.holes)
        return self.last[1]

    def opening(self, text: str, least: int) -> tuple[Tokens, bool]:
        """The tokens up to the first semicolon or closing brace outside all brackets that comes after `least` tokens, and
        whether the text ends there or before."""
        self.holes = []
        tokens, at = self._lex(text, 0, "", least)
        return tokens, at >= len(text)

    def first(self, text: str, n: int = 2) -> Tokens:
        """The first n tokens."""
        self.holes = []
        return self._lex(text, 0, "", 0, n)[0]

    def _lex(self, text: str, at: int, until: str, least: int = 0, most: int = 0) -> tuple[Tokens, int]:
        """Tokens up to the end, or up to the bracket `until` that none of them opened (offset after it)."""
        match, words, go, members = self.match, self.words, self.go, self.members
        out = Tokens()
        kinds, spelled, fresh, places = out.kinds, out.words, out.fresh, out.places
        n, depth, new = len(text), 0, True
        while True:
            m = match(text, at)
            if m is None:
                raise Bad
            kind = m.lastgroup
            at = m.end()
            if kind == "name":
                w = m["name"]
                kinds.append("i" if members and kinds and kinds[-1] in (".", "?.") and w not in ("self", "init") else words.get(w, "i"))
                spelled.append(w)
            elif kind == "nl":
                if go and kinds and kinds[-1] in _GO_END and not new:
                    kinds.append(";")
                    spelled.append("\n")
                    fresh.append(False)
                    places.append(at)
                new = True
                continue
            elif kind == "sign":
                w = m["sign"]
                if self.script and (w == "/" or w == "/=" or w == "<") and self._operand_next(kinds, spelled, new):
                    start = at - len(w)
                    end = self._regex(text, start) if w != "<" else self._element(text, start)
                    if end:
                        kinds.append("s")
                        spelled.append(w)
                        fresh.append(new)
                        at, new = end, False
                        places.append(at)
                        continue
                if least and w == ";" and not depth and len(kinds) >= least:
                    kinds.append(w)
                    spelled.append(w)
                    fresh.append(new)
                    return out.close(), at
                if w == ">" and text.startswith((">", "="), at):
                    kinds.append(w)
                    spelled.append(">>")
                else:
                    kinds.append(w)
                    spelled.append(w)
                    if until and not depth and w == ":" and self.name == "csharp":
                        return self._format(text, at, out)
            elif kind == "bracket":
                w = m["bracket"]
                if until:
                    if w in "([{":
                        depth += 1
                    elif depth:
                        depth -= 1
                    elif w == until:
                        return out.close(), at
                    else:
                        raise Bad
                kinds.append(w)
                spelled.append(w)
                if least:
                    depth += 1 if w in "([{" else -1
                    if depth < 0:
                        raise Bad
                    if w == "}" and not depth and len(kinds) > least:
                        fresh.append(new)
                        return out.close(), at
            elif kind == "line" or kind == "bang":
                continue
            elif kind == "number":
                kinds.append("n")
                spelled.append("0")
            elif kind == "text" or kind == "mark":
                kinds.append("s")
                spelled.append(m["text"])
            elif kind == "block":
                start, at = at, self._comment(text, at)
                if text.find("\n", start, at) >= 0:
                    if go and kinds and kinds[-1] in _GO_END and not new:
                        kinds.append(";")
                        spelled.append("\n")
                        fresh.append(False)
                        places.append(at)
                    new = True
                continue
            elif kind == "holed":
                at = self._holed(text, at, m["holed"])
                kinds.append("s")
                spelled.append(m["holed"])
            elif kind == "life":
                kinds.append("life")
                spelled.append(m["life"])
            elif kind == "pound":
                kinds.append("i")
                spelled.append(m["pound"])
            elif kind == "end":
                if until:
                    raise Bad
                if go and kinds and kinds[-1] in _GO_END:
                    kinds.append(";")
                    spelled.append("\n")
                    fresh.append(False)
                    places.append(at)
                return out.close(), n
            fresh.append(new)
            new = False
            places.append(at)
            if most and len(kinds) >= most:
                return out.close(), at

    def _comment(self, text: str, at: int) -> int:
        if self.name in _NESTED:
            depth = 1
            for m in _NOTE.finditer(text, at):
                depth += 1 if m[0] == "/*" else -1
                if not depth:
                    return m.end()
            raise Bad
        end = text.find("*/", at)
        if end < 0:
            raise Bad
        return end + 2

    def _hole(self, text: str, at: int, until: str) -> int:
        k = len(self.holes)
        tokens, at = self._lex(text, at, until)
        self.holes.insert(k, tokens)
        return at

    def _format(self, text: str, at: int, out: Tokens) -> tuple[Tokens, int]:
        """An interpolation's format, which is plain text."""
        for part in (out.kinds, out.words):
            part.pop()
        end = text.find("}", at)
        if end < 0 or text.find("\n", at, end) >= 0 or text.find('"', at, end) >= 0:
            raise Bad
        return out.close(), end + 1

    def _holed(self, text: str, at: int, opened: str) -> int:
        stop, hole, until, plain = _holed_form(self.name, opened)
        if self.name == "swift" and opened.strip("#") == '"' and text.startswith('""', at) and not opened.startswith("#"):
            at += 2
        while True:
            m = stop.search(text, at)
            if m is None:
                raise Bad
            at = m.end()
            if m.lastgroup == "hole":
                at = self._hole(text, at, until)
            elif m.lastgroup == "end":
                return at
            elif m.lastgroup == "bad":
                raise Bad

    def _operand_next(self, kinds: list[str], spelled: list[str], new: bool) -> bool:
        if not kinds:
            return True
        last = kinds[-1]
        if last == "}":
            return new
        if last == "i":
            return spelled[-1] in ("await", "yield", "of", "async")
        if last == ")":
            depth = 0
            for k in range(len(kinds) - 1, -1, -1):
                if kinds[k] == ")":
                    depth += 1
                elif kinds[k] == "(":
                    depth -= 1
                    if not depth:
                        return k > 0 and kinds[k - 1] in ("if", "while", "for", "with")
            return False
        return last not in _OPERAND_END

    def _regex(self, text: str, at: int) -> int:
        m = _REGEX.match(text, at)
        return m.end() if m else 0

    def _element(self, text: str, start: int) -> int:
        """The end of a markup element, or 0 if none begins here."""
        known = len(self.holes)
        try:
            return self._markup(text, start)
        except Bad:
            del self.holes[known:]
            return 0

    def _markup(self, text: str, at: int) -> int:
        names: list[str] = []
        while True:
            m = _TAG.match(text, at)
            if m is None or not names and m["close"]:
                raise Bad
            at, tag = m.end(), m["tag"] or ""
            if m["close"]:
                if names.pop() != tag or not text.startswith(">", at):
                    raise Bad
                at += 1
            else:
                while not (end := _TAG_END.match(text, at)):
                    a = _ATTRIBUTE.match(text, at)
                    if a is None or a.end() == at or not tag:
                        raise Bad
                    at = a.end()
                    if a["hole"] or a["spread"]:
                        at = self._hole(text, at, "}")
                at = end.end()
                if not end[1]:
                    names.append(tag)
            if not names:
                return at
            while True:  # the text between tags
                k = _CHILD.search(text, at)
                if k is None or k[0] in ">}":
                    raise Bad
                at = k.start()
                if k[0] == "<":
                    break
                blank = re.compile(r"\{\s*(?:/\*(?s:.*?)\*/\s*)*\}").match(text, at)
                at = blank.end() if blank else self._hole(text, at + 1, "}")


_GO_END = frozenset(["i", "n", "s", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_FORMS: dict[tuple[str, str], tuple] = {}


def _holed_form(name: str, opened: str) -> tuple:
    """What to search for within a literal: the hole's begin, the end, what may not come; and the hole's closing bracket."""
    if (name, opened) in _FORMS:
        return _FORMS[name, opened]
    if name in ("javascript", "typescript"):
        form = (r"\\(?s:.)|(?P<hole>\$\{)|(?P<end>`)", "}")
    elif name == "kotlin":
        form = (r'(?P<hole>\$\{)|(?P<end>"""+)', "}") if opened == '"""' else (r'\\[^\n]|(?P<hole>\$\{)|(?P<end>")|(?P<bad>\n)', "}")
    elif name == "swift":
        marks = opened.rstrip('"')
        quote = re.escape(opened[len(marks) :] + marks)
        more = "" if opened.endswith('"""') else r"|(?P<bad>\n)"
        form = (rf"(?P<hole>\\{marks}\()|(?P<end>{quote}){more}" if marks else rf"(?P<hole>\\\()|\\(?s:.)|(?P<end>{quote}){more}", ")")
    elif '"""' in opened:
        braces = r"\{" * opened.count("$")
        form = (rf'(?P<hole>{braces})|(?P<end>"""+)', "}")
    elif "@" in opened:
        form = (r'\{\{|\}\}|""|(?P<hole>\{)|(?P<end>")|(?P<bad>\})', "}")
    else:
        form = (r'\\[^\n]|\{\{|\}\}|(?P<hole>\{)|(?P<end>")|(?P<bad>[\n}])', "}")
    _FORMS[name, opened] = (re.compile(form[0]), None, form[1], None)
    return _FORMS[name, opened]
