"""Rust. What stands in a macro's brackets is any balanced text, as the language defines."""

from __future__ import annotations

from graphloom.syntax.base import Bad, Parser

_BLOCKS = frozenset(["if", "match", "loop", "while", "for", "unsafe", "{"])
_STARTS = frozenset(["i", "n", "s", "(", "[", "{", "-", "!", "*", "&", "&&", "|", "||", "self", "Self", "super", "crate", "::", "<", "if", "match", "loop", "while", "for", "unsafe", "move", "async", "return", "break", "continue", "life", "..", "..=", "const"])
_PATH = frozenset(["i", "self", "Self", "super", "crate"])


class Rust(Parser):
    LANGUAGE = "rust"
    BINARY = Parser.BINARY
    TERNARY = False

    def __init__(self, tokens):
        super().__init__(tokens)
        self.no_struct = False

    # ------------------------------------------------------------ paths and types

    def path(self, in_type: bool):
        K = self.K
        if K[self.p] == "<":
            self.p += 1
            self.type()
            if self.ok("as"):
                self.path(True)
            self.need(">")
            self.need("::")
        else:
            self.ok("::")
        while True:
            if K[self.p] not in _PATH:
                raise Bad
            self.p += 1
            if in_type and K[self.p] == "<":
                self.generic_args()
            elif in_type and K[self.p] == "(" and K[self.p - 1] == "i":
                self.p += 1
                self.listed(self.type, ")", ",", True)
                if self.ok("->"):
                    self.type()
            if K[self.p] != "::":
                return
            if K[self.p + 1] == "<":
                self.p += 1
                self.generic_args()
                if K[self.p] != "::":
                    return
            if K[self.p + 1] not in _PATH:
                return
            self.p += 1

    def generic_args(self):
        self.need("<")
        self.listed(self._generic_arg, ">", ",", True)

    def _generic_arg(self):
        K = self.K
        if self.ok("life"):
            return
        if K[self.p] == "i" and K[self.p + 1] == "=":
            self.p += 2
            return self.type()
        if K[self.p] == "i" and K[self.p + 1] == ":":
            self.p += 2
            return self.bounds()
        if K[self.p] in ("n", "s"):
            self.p += 1
        elif K[self.p] == "-":
            self.p += 1
            self.need("n")
        elif K[self.p] == "{":
            self.block()
        else:
            self.type()
            if self.ok("="):
                self.type()

    def type(self):
        K = self.K
        t = K[self.p]
        if t in ("&", "&&"):
            self.p += 1
            self.ok("life")
            self.ok("mut")
            return self.type()
        if t == "*":
            self.p += 1
            if not self.ok("const"):
                self.need("mut")
            return self.type()
        if t == "(":
            self.p += 1
            return self.listed(self.type, ")", ",", True)
        if t == "[":
            self.p += 1
            self.type()
            if self.ok(";"):
                self.expr()
            return self.need("]")
        if t == "!":
            self.p += 1
            return
        if t in ("impl", "dyn"):
            self.p += 1
            return self.bounds()
        if t == "for":
            self.p += 1
            self.generics()
            return self.type()
        if t in ("fn", "unsafe", "extern"):
            self.ok("unsafe")
            if self.ok("extern"):
                self.ok("s")
            self.need("fn")
            self.need("(")
            self.listed(self._fn_type_param, ")", ",", True)
            if self.ok("->"):
                self.type()
            return
        if t == "i" and self.V[self.p] == "_":
            self.p += 1
            return
        self.path(True)
        if K[self.p] == "!" and K[self.p + 1] in ("(", "[", "{"):
            self.p += 1
            self.p = self.ends[self.p] + 1

    def _fn_type_param(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] == ":":
            self.p += 2
        if not self.ok("..."):
            self.type()

    def bounds(self):
        """Traits and lifetimes joined by plus signs; may be empty before what ends them."""
        K = self.K
        while True:
            if K[self.p] == "life":
                self.p += 1
            elif K[self.p] == "(":
                self.p += 1
                self.bounds()
                self.need(")")
            elif K[self.p] in ("?", "for", "::", "~", "<") or K[self.p] in _PATH:
                self.ok("~") and self.need("const")
                self.ok("?")
                if self.ok("for"):
                    self.generics()
                self.path(True)
            else:
                return
            if not self.ok("+"):
                return

    def generics(self):
        self.need("<")
        self.listed(self._generic, ">", ",", True)

    def _generic(self):
        self.attributes()
        if self.ok("const"):
            self.name()
            self.need(":")
            self.type()
            if self.ok("="):
                self._generic_arg()
            return
        if not self.ok("life"):
            self.name()
        if self.ok(":"):
            self.bounds()
        if self.ok("="):
            self.type()

    def where(self):
        if self.ok("where"):
            while self.K[self.p] not in ("{", ";", "="):
                if self.ok("for"):
                    self.generics()
                if not self.ok("life"):
                    self.type()
                self.need(":")
                self.bounds()
                if not self.ok(","):
                    return

    def attributes(self, inner: bool = False):
        K = self.K
        while K[self.p] == "#" and (K[self.p + 1] == "[" or inner and K[self.p + 1] == "!" and K[self.p + 2] == "["):
            self.p += 1
            self.ok("!")
            end = self.ends[self.p]
            if K[self.p + 1] not in _PATH | {"unsafe", "::", "type"}:
                raise Bad
            self.p = end + 1

    # ------------------------------------------------------------ patterns

    def pattern(self):
        self.ok("|")
        while True:
            self.one_pattern()
            if not self.ok("|"):
                return

    def one_pattern(self):
        K = self.K
        t = K[self.p]
        if t in ("&", "&&"):
            self.p += 1
            self.ok("mut")
            return self.one_pattern()
        if t in ("ref", "mut"):
            self.ok("ref")
            self.ok("mut")
            self.name()
            if self.ok("@"):
                self.one_pattern()
            return
        if t == "(":
            self.p += 1
            return self.listed(self.pattern, ")", ",", True)
        if t == "[":
            self.p += 1
            return self.listed(self.pattern, "]", ",", True)
        if t in ("..", "..="):
            self.p += 1
            if K[self.p] in ("n", "s", "-") or K[self.p] in _PATH:
                self._bound()
            return
        if t == "i" and K[self.p + 1] == "@":
            self.p += 2
            return self.one_pattern()
        if t in ("n", "s", "-"):
            self._bound()
        elif t == "const" and K[self.p + 1] == "{":
            self.p += 1
            self.block()
        else:
            self.path(False)
            if self.ok("("):
                return self.listed(self.pattern, ")", ",", True)
            if K[self.p] == "{":
                self.p += 1
                return self.listed(self._field_pattern, "}", ",", True)
            if K[self.p] == "!" and K[self.p + 1] in ("(", "["):
                self.p = self.ends[self.p + 1] + 1
                return
        if K[self.p] in ("..=", "..", "..."):
            self.p += 1
            if K[self.p] in ("n", "s", "-") or K[self.p] in _PATH:
                self._bound()

    def _bound(self):
        if self.ok("-"):
            self.need("n")
        elif not (self.ok("n") or self.ok("s")):
            self.path(False)

    def _field_pattern(self):
        self.attributes()
        if self.ok(".."):
            return
        if self.K[self.p + 1] == ":" and self.K[self.p] in ("i", "n"):
            self.p += 2
            return self.pattern()
        self.ok("ref")
        self.ok("mut")
        self.name()

    # ------------------------------------------------------------ expressions

    def joint(self, kind):
        if kind == "as":
            self.p += 1
            self.type()
            return 2
        if kind in ("..", "..="):
            self.p += 1
            if self.K[self.p] in _STARTS and not (self.K[self.p] == "{" and self.no_struct):
                return 1
            return 2
        return 0

    def assignable(self):
        return self.K[self.p - 1] not in ("n", "s") or self.K[self.p - 1] == "n" and self.K[self.p - 2] == "."

    def counts(self, form, start):
        return True

    def inside(self, f, *args):
        old, self.no_struct = self.no_struct, False
        f(*args)
        self.no_struct = old

    def head(self):
        """A condition, without struct literals."""
        old, self.no_struct = self.no_struct, True
        self.expr()
        self.no_struct = old

    def unary(self):
        K = self.K
        while True:
            t = K[self.p]
            if t in ("-", "!", "*"):
                self.p += 1
            elif t in ("&", "&&"):
                self.p += 1
                if self.is_word("raw") and K[self.p + 1] in ("const", "mut"):
                    self.p += 2
                self.ok("mut")
            else:
                break
        if t in ("..", "..="):
            self.p += 1
            if K[self.p] in _STARTS and not (K[self.p] == "{" and self.no_struct):
                self.unary()
            return
        self.primary(t)
        self.postfix()

    def primary(self, t):
        K = self.K
        if t in ("n", "s"):
            self.p += 1
        elif t in _PATH or t in ("::", "<"):
            self.path(False)
            if K[self.p] == "!" and K[self.p + 1] in ("(", "[", "{"):
                self.p = self.ends[self.p + 1] + 1
            elif K[self.p] == "{" and not self.no_struct:
                self.p += 1
                self.inside(self.listed, self._field, "}", ",", True)
        elif t == "(":
            self.p += 1
            self.inside(self.listed, self.expr, ")", ",", True)
        elif t == "[":
            self.p += 1
            self.inside(self._array)
        elif t == "{":
            self.inside(self.block)
        elif t in ("|", "||", "move") or t == "async" and (K[self.p + 1] in ("|", "||") or K[self.p + 1] == "move" and K[self.p + 2] in ("|", "||")) or t == "static" and K[self.p + 1] in ("|", "||", "move"):
            self.closure()
        elif t == "if":
            self._if()
        elif t == "match":
            self._match()
        elif t in ("loop", "while", "for"):
            self._loop()
        elif t == "life":
            self.p += 1
            self.need(":")
            if K[self.p] == "{":
                self.inside(self.block)
            else:
                self._loop()
        elif t in ("unsafe", "const") and K[self.p + 1] == "{":
            self.p += 1
            self.inside(self.block)
        elif t == "async":
            self.p += 1
            self.ok("move")
            self.inside(self.block)
        elif t in ("return", "break"):
            self.p += 1
            if t == "break":
                self.ok("life")
            if K[self.p] in _STARTS and not (K[self.p] == "{" and self.no_struct):
                self.expr()
        elif t == "continue":
            self.p += 1
            self.ok("life")
        elif t == "let":  # within a condition
            self.p += 1
            self.pattern()
            self.need("=")
            self._scrutinee()
        else:
            raise Bad

    def _scrutinee(self):
        """What a pattern is held against: up to a lazy boolean operator."""
        while True:
            self.unary()
            t = self.K[self.p]
            if t in self.BINARY and t not in ("&&", "||"):
                if t == ">" and self.V[self.p] == ">>":
                    self._shifts()
                else:
                    self.p += 1
            elif t == "as":
                self.p += 1
                self.type()
                return
            elif t in ("..", "..="):
                self.p += 1
                if self.K[self.p] == "{":
                    return
            else:
                return

    def _field(self):
        self.attributes()
        if self.ok(".."):
            if self.K[self.p] != "}":
                self.expr()
            return
        if not self.ok("n"):
            self.name()
        elif self.K[self.p] != ":":
            raise Bad
        if self.ok(":"):
            self.expr()

    def _array(self):
        if self.ok("]"):
            return
        self.expr()
        if self.ok(";"):
            self.expr()
            return self.need("]")
        if self.ok("]"):
            return
        self.need(",")
        self.listed(self.expr, "]", ",", True)

    def closure(self):
        self.ok("static")
        self.ok("async")
        self.ok("move")
        if not self.ok("||"):
            self.need("|")
            while not self.ok("|"):
                self.one_pattern()
                if self.ok(":"):
                    self.type()
                if self.K[self.p] != "|":
                    self.need(",")
        if self.ok("->"):
            self.type()
            if self.K[self.p] != "{":
                raise Bad
        self.expr()

    def _if(self):
        self.need("if")
        self.head()
        self.inside(self.block)
        if self.ok("else"):
            if self.K[self.p] == "if":
                self._if()
            else:
                self.inside(self.block)

    def _match(self):
        self.need("match")
        self.head()
        self.need("{")
        self.inside(self._arms)

    def _arms(self):
        K = self.K
        self.attributes(True)
        while not self.ok("}"):
            self.attributes()
            self.pattern()
            if self.ok("if"):
                self.expr()
            self.need("=>")
            if K[self.p] == "{":
                self.block()
                if K[self.p] in (".", "?") or K[self.p] in self.BINARY and K[self.p] not in ("&", "-", "*", "|", "&&", "||", "<"):
                    self.postfix()
                    if K[self.p] in self.BINARY:
                        self.p += 1
                        self.expr()
                    if K[self.p] != "}":
                        self.need(",")
                    continue
                self.ok(",")
                continue
            start = self.p
            self.expr()
            if K[self.p] != "}" and not self.ok(",") and not (K[start] in _BLOCKS and K[self.p - 1] == "}"):
                raise Bad

    def _loop(self):
        t = self.K[self.p]
        self.p += 1
        if t == "while":
            self.head()
        elif t == "for":
            self.pattern()
            self.need("in")
            self.head()
        elif t != "loop":
            raise Bad
        self.inside(self.block)

    def postfix(self):
        K = self.K
        while True:
            t = K[self.p]
            if t == ".":
                self.p += 1
                if K[self.p] in ("await", "n"):
                    self.p += 1
                else:
                    self.name()
                    if K[self.p] == "::":
                        self.p += 1
                        self.generic_args()
                        if K[self.p] != "(":
                            raise Bad
            elif t == "(":
                if K[self.p - 1] in ("n", "s"):
                    raise Bad
                self.calls()
                self.p += 1
                self.inside(self.listed, self.expr, ")", ",", True)
            elif t == "[":
                self.p += 1
                self.inside(self.expr)
                self.need("]")
            elif t == "?":
                self.p += 1
            else:
                return

    # ------------------------------------------------------------ statements

    def block(self):
        self.need("{")
        self.attributes(True)
        K = self.K
        while not self.ok("}"):
            if self.ok(";"):
                continue
            self.statement()

    def statement(self):
        K = self.K
        at = self.p
        self.attributes()
        t = K[self.p]
        if t == "let":
            self.p += 1
            self.pattern()
            if self.ok(":"):
                self.type()
            if self.ok("="):
                self.expr()
                if self.ok("else"):
                    self.block()
            return self.need(";")
        if self.at_item():
            self.p = at
            return self.item()
        if t in _BLOCKS or t == "life" or t in ("async", "const") and K[self.p + 1] == "{" or t == "async" and K[self.p + 1] == "move" and K[self.p + 2] == "{":
            self.primary(t)
            if K[self.p] not in (".", "?"):
                self.ok(";")
                return
            self.postfix()
            self._rest()
        else:
            if t in _PATH and K[self.p + 1] == "!" and K[self.p + 2] == "{" or t == "i" and K[self.p + 1] == "!" and K[self.p + 2] == "i" and K[self.p + 3] == "{":
                self.path(False)
                self.p += 1
                self.ok("i")
                self.p = self.ends[self.p] + 1
                if K[self.p] not in (".", "?"):
                    self.ok(";")
                    return
                self.postfix()
                self._rest()
                return
            self.expr()
            if K[self.p] != "}":
                self.need(";")

    def _rest(self):
        """What follows an expression that began as a block and went on."""
        t = self.K[self.p]
        if t in self.BINARY or t in self.ASSIGN:
            self.p += 1
            self.expr()
        elif t in ("as", "..", "..="):
            self.joint(t)
        if self.K[self.p] != "}":
            self.need(";")

    # ------------------------------------------------------------ items

    def at_item(self) -> bool:
        K, k = self.K, self.p
        t = K[k]
        if t in ("fn", "struct", "enum", "trait", "impl", "mod", "use", "static", "type", "pub", "extern"):
            return not (t == "static" and K[k + 1] in ("|", "||", "move"))
        if t == "unsafe":
            return K[k + 1] in ("fn", "impl", "trait", "extern", "mod")
        if t == "async":
            return K[k + 1] in ("fn", "unsafe")
        if t == "const":
            return K[k + 1] in ("i", "fn", "unsafe", "async", "extern", "mut")
        if t == "i" and K[k + 1] == "i":
            return self.V[k] in ("union", "auto") or self.V[k] == "macro_rules"
        return t == "i" and self.V[k] == "macro_rules" and K[k + 1] == "!"

    def visibility(self):
        if self.ok("pub") and self.K[self.p] == "(" and (self.K[self.p + 1] in ("crate", "self", "super", "in")):
            self.p += 1
            self.ok("in")
            self.path(False)
            self.need(")")

    def item(self):
        """An item; what it defines is known by its keyword."""
        K = self.K
        self.attributes()
        first = k = self.p
        if K[k] == "pub":
            k += 1
            if K[k] == "(":
                k = self.ends[k] + 1
        while K[k] in ("async", "unsafe", "extern", "s") or K[k] == "const" and K[k + 1] in ("fn", "unsafe", "async", "extern"):
            k += 1
        kind = {"fn": "callable", "struct": "type", "enum": "type", "trait": "type", "mod": "scope"}.get(K[k])
        if kind and K[k + 1] == "i":
            self.opens(self.V[k + 1])
            self._item()
            return self.closes(kind, k + 1, first)
        if K[k] == "impl":
            end = k
            while K[end] not in ("{", ";", "where", "") and not (K[end] == "for" and K[end + 1] != "<"):
                end += 1
            start = end + 1 if K[end] == "for" else k + 1 if K[k + 1] != "<" else (self.angle(k + 1) or k + 2)
            while K[start] in ("&", "life", "mut", "::", "dyn"):
                start += 1
            while K[start] in _PATH and K[start + 1] == "::" and K[start + 2] in _PATH:
                start += 2
            self.opens(self.V[start])
            self._item()
            if K[end] == "for":
                base = end - 1
                while base > k and K[base] != "i":
                    base -= 1
                self.found.append(("implements", base, base, base, ".".join(self.inside_of)))
            self.inside_of.pop()
            return
        self._item()

    def _item(self):
        K = self.K
        self.visibility()
        if self.is_word("default") and K[self.p + 1] in ("fn", "impl", "unsafe", "async", "const", "type"):
            self.p += 1
        t = K[self.p]
        if t == "use":
            first = self.p
            self.p += 1
            self._use()
            self.found.append(("import", self.p - 1, first + 1, self.p - 1, ""))
            return self.need(";")
        if t == "mod" or t == "unsafe" and K[self.p + 1] == "mod":
            self.ok("unsafe")
            self.p += 1
            self.name()
            if self.ok(";"):
                return
            self.need("{")
            self.attributes(True)
            while not self.ok("}"):
                self.item()
            return
        if t in ("struct", "enum") or t == "i" and self.V[self.p] == "union" and K[self.p + 1] == "i":
            self.p += 1
            self.name()
            if K[self.p] == "<":
                self.generics()
            if t == "enum":
                self.where()
                self.need("{")
                return self.listed(self._variant, "}", ",", True)
            if K[self.p] == "(":
                self.p += 1
                self.listed(self._tuple_field, ")", ",", True)
                self.where()
                return self.need(";")
            self.where()
            if self.ok(";"):
                return
            self.need("{")
            return self.listed(self._named_field, "}", ",", True)
        if t == "type":
            self.p += 1
            self.name()
            if K[self.p] == "<":
                self.generics()
            if self.ok(":"):
                self.bounds()
            self.where()
            if self.ok("="):
                self.type()
                self.where()
            return self.need(";")
        if t == "static" or t == "const" and K[self.p + 1] in ("i", "mut") :
            self.p += 1
            self.ok("mut")
            self.name()
            if self.ok(":"):
                self.type()
            elif t == "static" or K[self.p] != "=":
                raise Bad
            if self.ok("="):
                self.expr()
            return self.need(";")
        if t == "extern" and K[self.p + 1] == "crate":
            self.p += 2
            if not self.ok("self"):
                self.name()
            if self.ok("as"):
                self.name()
            return self.need(";")
        if t == "trait" or t in ("unsafe", "i") and (K[self.p + 1] == "trait" or K[self.p + 2] == "trait"):
            self.ok("unsafe")
            self.word("auto")
            self.need("trait")
            self.name()
            if K[self.p] == "<":
                self.generics()
            if self.ok(":"):
                self.bounds()
            self.where()
            return self._associated()
        if t == "impl" or t == "unsafe" and K[self.p + 1] == "impl":
            self.ok("unsafe")
            self.p += 1
            if K[self.p] == "<" and self.tries(self.generics):
                pass
            self.ok("const")
            self.ok("!")
            self.type()
            if self.ok("for"):
                self.type()
            self.where()
            return self._associated()
        if t == "i" and K[self.p + 1] in ("!", "::"):
            return self._macro()
        while K[self.p] in ("const", "async", "unsafe", "extern"):
            if self.ok("extern"):
                self.ok("s")
                if K[self.p] == "{":
                    self.p += 1
                    while not self.ok("}"):
                        self.item()
                    return
            else:
                self.p += 1
        self.need("fn")
        self.name()
        if K[self.p] == "<":
            self.generics()
        self.need("(")
        self.listed(self._param, ")", ",", True)
        if self.ok("->"):
            self.type()
        self.where()
        if not self.ok(";"):
            self.block()

    def _macro(self):
        self.path(False)
        self.need("!")
        self.ok("i")
        t = self.K[self.p]
        if t not in ("(", "[", "{"):
            raise Bad
        self.p = self.ends[self.p] + 1
        if t != "{":
            self.need(";")

    def _use(self):
        K = self.K
        self.ok("::")
        while True:
            if self.ok("*"):
                return
            if self.ok("{"):
                return self.listed(self._use, "}", ",", True)
            if K[self.p] not in _PATH:
                raise Bad
            self.p += 1
            if not self.ok("::"):
                break
        if self.ok("as"):
            self.name()

    def _variant(self):
        self.attributes()
        self.visibility()
        self.name()
        if self.ok("("):
            self.listed(self._tuple_field, ")", ",", True)
        elif self.ok("{"):
            self.listed(self._named_field, "}", ",", True)
        if self.ok("="):
            self.expr()

    def _tuple_field(self):
        self.attributes()
        self.visibility()
        self.type()

    def _named_field(self):
        self.attributes()
        self.visibility()
        self.name()
        self.need(":")
        self.type()

    def _associated(self):
        self.need("{")
        self.attributes(True)
        while not self.ok("}"):
            self.item()

    def _param(self):
        self.attributes()
        K = self.K
        if self.ok("..."):
            return
        at = self.p
        if self.ok("&"):
            self.ok("life")
        self.ok("mut")
        if self.ok("self"):
            if self.ok(":"):
                self.type()
            return
        self.p = at
        self.one_pattern()
        if K[self.p] == ":":
            self.p += 1
            if not self.ok("..."):
                self.type()
        else:
            raise Bad

    @staticmethod
    def begins(kinds, words, fresh):
        t = kinds[0]
        return t in ("#", ";", "fn", "struct", "enum", "trait", "impl", "mod", "use", "static", "type", "pub", "extern", "unsafe", "async", "const") or t == "i" and (kinds[1] in ("!", "::") or words[0] in ("union", "auto", "default"))

    def top(self):
        self.attributes(True)
        while self.K[self.p]:
            if self.ok(";"):
                continue
            self.item()

