"""Swift."""

from __future__ import annotations

from graphloom.syntax.base import Bad, Parser

_MODIFIERS = frozenset("open final override mutating nonmutating lazy weak unowned required convenience indirect prefix postfix infix dynamic optional async nonisolated isolated distributed consuming borrowing package".split())
_RESERVED_MODIFIERS = frozenset(["public", "private", "fileprivate", "internal", "static", "class"])
_DECLARES = frozenset(["let", "var", "func", "class", "struct", "enum", "protocol", "extension", "init", "deinit", "subscript", "typealias", "associatedtype", "operator", "import", "case", "precedencegroup"])
_ACCESSORS = frozenset("get set willSet didSet _read _modify unsafeAddress".split())
_SIGNS = frozenset(["+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "==", "!=", "<", ">", "<=", ">=", "<<", "??", "===", "!==", "...", "..<", "~=", "!", "~", "&+", "&-", "&*", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", "++", "--", "=", "?"])
_STARTS = frozenset(["i", "n", "s", "(", "[", "{", "self", "Self", "super", "-", "+", "!", "~", ".", "&", "if", "switch", "try", "#", "\\", "...", "..<", "init", "@"])


class Swift(Parser):
    LANGUAGE = "swift"
    PREFIX = frozenset(["!", "-", "+", "~", "&", "..<", "..."])
    BINARY = frozenset(["+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "==", "!=", "<", ">", "<=", ">=", "<<", "??", "===", "!==", "...", "..<", "~=", "&+", "&-", "&*"])
    ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<="])
    ANGLED = frozenset(["i", ",", ".", "?", "!", "[", "(", "->", "&", "Self", "self", ":", "@", "throws", "...", "inout"])

    def __init__(self, tokens):
        super().__init__(tokens)
        self.no_closure = False

    # ------------------------------------------------------------ types

    def attributes(self):
        K = self.K
        while K[self.p] == "@" and K[self.p + 1] == "i":
            self.p += 2
            while K[self.p] == "." and K[self.p + 1] == "i":
                self.p += 2
            if K[self.p] == "<" and self.angle(self.p):
                self.type_args()
            if K[self.p] == "(" and not self.N[self.p]:
                self.p = self.ends[self.p] + 1

    def type(self):
        K, V = self.K, self.V
        self.attributes()
        while K[self.p] == "inout" or K[self.p] == "i" and V[self.p] in ("some", "any", "borrowing", "consuming", "sending", "__owned", "__shared") and K[self.p + 1] in ("i", "(", "[", "self", "Self"):
            self.p += 1
        t = K[self.p]
        if t in ("i", "Self"):
            while True:
                self.p += 1
                if K[self.p] == "<":
                    self.type_args()
                if K[self.p] == "." and (K[self.p + 1] == "i" or K[self.p + 1] == "Self"):
                    self.p += 1
                else:
                    break
        elif t == "[":
            self.p += 1
            self.type()
            if self.ok(":"):
                self.type()
            self.need("]")
        elif t == "(":
            self.p += 1
            self.listed(self._tuple_type, ")")
        else:
            raise Bad
        while K[self.p] in ("?", "!", "?.") and not self.N[self.p] or K[self.p] == "??":
            if K[self.p] == "?." and K[self.p + 1] == "i":
                self.p += 1
                self.name()
                continue
            if K[self.p] == "!" and K[self.p + 1] in ("i", "n"):
                break
            if K[self.p] == "??" and K[self.p + 1] in _STARTS:
                break
            self.p += 1
        if K[self.p] == "." and self.V[self.p + 1] in ("Type", "Protocol"):
            self.p += 2
        if K[self.p] == "->" or (self.is_word("async") or K[self.p] in ("throws", "rethrows")) and self._arrow_ahead():
            if K[self.p - 1] != ")":
                raise Bad
            self.effects()
            self.need("->")
            return self.type()
        if K[self.p] == "&":
            self.p += 1
            return self.type()
        if K[self.p] == "..." and K[self.p + 1] in (")", ",", "="):
            self.p += 1

    def _arrow_ahead(self) -> bool:
        k = self.p
        while self.K[k] == "throws" or self.K[k] == "i" and self.V[k] == "async":
            k += 1
            if self.K[k] == "(" and self.K[k - 1] == "throws":
                k = self.ends[k] + 1
        return self.K[k] == "->"

    def effects(self):
        while True:
            if self.ok("throws"):
                if self.K[self.p] == "(":
                    self.p += 1
                    self.type()
                    self.need(")")
            elif not (self.ok("rethrows") or self.word("async") or self.word("reasync")):
                return

    def _tuple_type(self):
        K = self.K
        if K[self.p] == "i" and (K[self.p + 1] == ":" or K[self.p + 1] == "i" and K[self.p + 2] == ":"):
            while not self.ok(":"):
                self.p += 1
        self.type()
        if self.ok("="):
            self.expr()

    def type_args(self):
        self.need("<")
        self.listed(self.type, ">", empty=False)

    def generics(self):
        self.need("<")
        self.listed(self._generic, ">", empty=False)

    def _generic(self):
        self.attributes()
        self.word("each")
        if not self.ok("let"):
            self.name()
        else:
            self.name()
        if self.ok(":"):
            self.type()

    def where(self):
        if self.ok("where"):
            while True:
                self.type()
                if not self.ok(":"):
                    self.need("==")
                self.type()
                if not self.ok(","):
                    return

    # ------------------------------------------------------------ expressions

    def joint(self, kind):
        if self.N[self.p] and kind not in ("as", "is"):
            return 0
        if kind == "is":
            self.p += 1
            self.type()
            return 2
        if kind == "as":
            self.p += 1
            if not self.ok("?"):
                self.ok("!")
            self.type()
            return 2
        return 0

    def expr(self):
        """A sign at a line's begin goes on only if it stands apart from its operand."""
        K, N = self.K, self.N
        form, plain = 0, True
        while True:
            self.unary()
            while True:
                t = K[self.p]
                if t in self.BINARY:
                    if t in ("...",) and K[self.p + 1] in (")", "]", ",", "}", ":", "") or t == "..." and N[self.p + 1]:
                        self.p += 1  # an open range
                        form = 1
                        continue
                    if t == ">" and self.V[self.p] == ">>":
                        if not self._shifts():
                            form = 2
                            break
                    elif t == "&" and N[self.p]:
                        return form
                    else:
                        self.p += 1
                    form, plain = max(form, 1), False
                    break
                if t in self.ASSIGN:
                    if not plain or not self.assignable():
                        raise Bad
                    self.p += 1
                    form = 2
                    break
                if t == "?" and K[self.p + 1] in _STARTS and K[self.p + 1] != "." or t == "?" and self._ternary():
                    self.p += 1
                    self.middle()
                    self.need(":")
                    form, plain = max(form, 1), True
                    break
                more = self.joint(t)
                if not more:
                    return form
                form, plain = max(form, 1), False

    def _ternary(self) -> bool:
        return self.K[self.p + 1] == "."

    def middle(self):
        self.expr()

    def inside(self, f, *args):
        old, self.no_closure = self.no_closure, False
        f(*args)
        self.no_closure = old

    def unary(self):
        K, V = self.K, self.V
        while True:
            t = K[self.p]
            if t in self.PREFIX:
                self.p += 1
            elif t == "try":
                self.p += 1
                if not self.ok("?"):
                    self.ok("!")
            elif t == "i" and V[self.p] in ("await", "consume", "copy", "each", "any", "repeat") and K[self.p + 1] in _STARTS - {"(", "[", ".", "-", "{"} and not self.N[self.p + 1] or t == "i" and V[self.p] == "await" and K[self.p + 1] in ("(", "["):
                self.p += 1
            else:
                break
        if t in ("i", "n", "s", "self", "Self", "super"):
            self.p += 1
            if t == "i" and V[self.p - 1].startswith("#") and V[self.p - 1] in ("#if", "#endif", "#else", "#elseif"):
                raise Bad
        elif t == "(":
            self.p += 1
            self.inside(self.listed, self._tuple_item, ")", ",", True)
        elif t == "[":
            self.p += 1
            self.inside(self._array)
        elif t == "{":
            self.inside(self.closure)
        elif t == ".":
            self.p += 1
            if not (self.ok("init") or self.ok("self")):
                if K[self.p] != "i" and not K[self.p].isalpha():
                    raise Bad
                self.p += 1
        elif t == "if":
            self._if()
            return
        elif t == "switch":
            self._switch()
            return
        elif t == "\\":
            self.p += 1
            if K[self.p] in ("i", "Self"):
                self.type()
            while K[self.p] in (".", "?.", "[", "?", "!"):
                if self.ok("["):
                    self.listed(self._argument, "]")
                elif K[self.p] in ("?", "!"):
                    self.p += 1
                else:
                    self.p += 1
                    if not self.ok("self"):
                        self.name()
            return
        elif t == "init":
            self.p += 1
        else:
            raise Bad
        self.postfix()

    def _tuple_item(self):
        K = self.K
        if (K[self.p] == "i" or K[self.p].isalpha()) and K[self.p + 1] == ":":
            self.p += 2
        if K[self.p] in _SIGNS and K[self.p + 1] in (")", ","):
            self.p += 1
            return
        if K[self.p] in ("let", "var"):
            return self.pattern()
        self.expr()

    def _array(self):
        if self.ok("]"):
            return
        if self.ok(":"):
            return self.need("]")
        self.listed(self._element, "]", ",", True)

    def _element(self):
        self.expr()
        if self.ok(":"):
            self.expr()

    def _argument(self):
        K = self.K
        if (K[self.p] == "i" or K[self.p].isalpha() and K[self.p] not in ("n", "s")) and K[self.p + 1] == ":":
            self.p += 2
        if K[self.p] in _SIGNS and K[self.p + 1] in (")", ","):
            self.p += 1
            return
        if K[self.p] in ("let", "var"):
            return self.pattern()
        self.expr()

    def closure(self):
        self.need("{")
        at = self.p
        if not self.tries(self._closure_head):
            self.p = at
        self.statements()

    def _closure_head(self):
        K = self.K
        self.attributes()
        if self.ok("["):
            self.listed(self._capture, "]")
        if K[self.p] == "(":
            self.p += 1
            self.listed(self._closure_param, ")")
        else:
            while K[self.p] == "i":
                self.p += 1
                if not self.ok(","):
                    break
        self.effects()
        if self.ok("->"):
            self.type()
        self.need("in")

    def _capture(self):
        if (self.is_word("weak") or self.is_word("unowned")) and self.K[self.p + 1] in ("i", "self", "("):
            self.p += 1
            if self.ok("("):
                self.name()
                self.need(")")
        if not self.ok("self"):
            self.name()
        if self.ok("="):
            self.expr()

    def _closure_param(self):
        self.attributes()
        self.name()
        self.ok("i")
        if self.ok(":"):
            self.type()

    def postfix(self):
        K, N = self.K, self.N
        while True:
            t = K[self.p]
            if t in (".", "?."):
                if t == "?." and N[self.p]:
                    return
                self.p += 1
                if K[self.p] == "n" or K[self.p] == "i" or K[self.p] in ("init", "self"):
                    self.p += 1
                elif K[self.p].isalpha() and K[self.p] != "s":
                    self.p += 1
                else:
                    raise Bad
            elif N[self.p]:
                return
            elif t == "(":
                if K[self.p - 1] == "n":
                    raise Bad
                self.calls()
                self.p += 1
                self.inside(self.listed, self._argument, ")", ",", True)
            elif t == "[":
                if K[self.p - 1] == "n":
                    raise Bad
                self.p += 1
                self.inside(self.listed, self._argument, "]", ",", True)
            elif t == "!" and K[self.p + 1] != "=":
                self.p += 1
            elif t == "?" and (K[self.p + 1] in (".", "[", "(", ")", ",", "!", "?", "=", "]", "}", "??", ";", "") or N[self.p + 1]) and not (K[self.p + 1] in (".", "[", "(") and self._ternary_ahead()):
                self.p += 1
            elif t == "{" and not self.no_closure and K[self.p - 1] in ("i", ")", ">", "]", "!", "?", "init"):
                if self._accessor_block():
                    return
                self.inside(self.closure)
                while K[self.p] == "i" and K[self.p + 1] == ":" and K[self.p + 2] == "{":
                    self.p += 2
                    self.inside(self.closure)
            elif t == "<" and (end := self.angle(self.p)) and K[end] in ("(", ".", ")", "{", "]", ",", "?", "!") and self.V[end - 1] != ">>":
                self.type_args()
            else:
                return

    def _accessor_block(self) -> bool:
        """Whether a block after a variable's value observes it."""
        return self.K[self.p + 1] == "i" and self.V[self.p + 1] in ("willSet", "didSet") and self.K[self.p + 2] in ("{", "(")

    def _ternary_ahead(self) -> bool:
        """Whether a question mark before a dot or bracket asks: a colon follows on the same level of the line."""
        k = self.p + 1
        while True:
            t = self.K[k]
            if t in ("(", "[", "{"):
                k = self.ends[k]
            elif t == ":":
                return True
            elif t in (")", "]", "}", ",", ";", "", "=") or k > self.p + 1 and self.N[k] and t not in (".", "?.", "?"):
                return False
            k += 1

    # ------------------------------------------------------------ patterns

    def pattern(self):
        K = self.K
        t = K[self.p]
        if t in ("let", "var"):
            self.p += 1
            self.pattern()
        elif t == "(":
            self.p += 1
            self.listed(self._sub_pattern, ")")
        elif t == "is":
            self.p += 1
            self.type()
            return
        elif t == "." or t == "i" and K[self.p + 1] in (".", "("):
            self.ok("i")
            while self.ok("."):
                if K[self.p] != "i" and not K[self.p].isalpha():
                    raise Bad
                self.p += 1
            if K[self.p] == "(":
                self.p += 1
                self.listed(self._sub_pattern, ")")
            if K[self.p] not in (":", ",", "=", "where", ")", "?", "as", "in"):
                raise Bad
        elif t == "i" and K[self.p + 1] in (":", ",", "=", "where", ")", "?", "in", "as"):
            self.p += 1
        else:
            self.binary_only()
        self.ok("?")
        if self.ok("as"):
            self.type()

    def binary_only(self):
        while True:
            self.unary()
            if self.K[self.p] in self.BINARY:
                if self.K[self.p] == "..." and self.K[self.p + 1] in (":", ",", ")"):
                    self.p += 1
                    return
                self.p += 1
            elif self.K[self.p] == "as" or self.K[self.p] == "is":
                self.p += 1
                self.type()
                return
            else:
                return

    def _sub_pattern(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] == ":":
            self.p += 2
        at = self.p
        if not self.tries(self._pattern_closed):
            self.p = at
            self.expr()

    def _pattern_closed(self):
        self.pattern()
        if self.K[self.p] not in (",", ")"):
            raise Bad

    # ------------------------------------------------------------ statements

    def block(self):
        old, self.no_closure = self.no_closure, False
        self.need("{")
        self.statements()
        self.no_closure = old

    def statements(self):
        K = self.K
        while True:
            while self.ok(";"):
                pass
            if self.ok("}"):
                return
            self.statement()
            if K[self.p] not in (";", "}") and not self.N[self.p]:
                raise Bad

    def conditions(self):
        K = self.K
        old, self.no_closure = self.no_closure, True
        while True:
            if K[self.p] in ("let", "var") and K[self.p + 1] in ("i", "(", "self"):
                self.p += 1
                if not self.ok("self"):
                    self.pattern()
                if self.ok(":"):
                    self.type()
                if self.ok("="):
                    self.expr()
            elif self.ok("case"):
                self.pattern()
                if self.ok(":"):
                    self.type()
                self.need("=")
                self.expr()
            elif self.is_word("#available") or self.is_word("#unavailable"):
                self.p += 1
                self.p = self.ends[self.p] + 1 if K[self.p] == "(" else self._raise()
            else:
                if self.expr() == 2:
                    raise Bad
            if not self.ok(","):
                break
        self.no_closure = old

    def _raise(self):
        raise Bad

    def _if(self):
        self.need("if")
        self.conditions()
        self.block()
        if self.ok("else"):
            if self.K[self.p] == "if":
                self._if()
            else:
                self.block()

    def _switch(self):
        K = self.K
        self.need("switch")
        old, self.no_closure = self.no_closure, True
        self.expr()
        self.no_closure = False
        self.need("{")
        while not self.ok("}"):
            self.attributes()
            if self.ok("case"):
                while True:
                    self.pattern()
                    if self.ok("where"):
                        self.expr()
                    if not self.ok(","):
                        break
            else:
                self.need("default")
            self.need(":")
            empty = True
            while K[self.p] not in ("case", "default", "}") and not (K[self.p] == "@" and self.V[self.p + 1] == "unknown"):
                empty = False
                if self.ok(";"):
                    continue
                self.statement()
                if K[self.p] not in (";", "}", "case", "default") and not self.N[self.p]:
                    raise Bad
            if empty:
                raise Bad
        self.no_closure = old

    def statement(self):
        K, V = self.K, self.V
        t = K[self.p]
        if t == "i" and K[self.p + 1] == ":" and K[self.p + 2] in ("for", "while", "repeat", "if", "switch", "do"):
            self.p += 2
            t = K[self.p]
        if t == "if":
            return self._if()
        if t == "guard":
            self.p += 1
            self.conditions()
            self.need("else")
            return self.block()
        if t == "for":
            self.p += 1
            self.ok("try")
            self.word("await")
            self.ok("case")
            self.pattern()
            if self.ok(":"):
                self.type()
            self.need("in")
            old, self.no_closure = self.no_closure, True
            self.expr()
            if self.ok("where"):
                self.expr()
            self.no_closure = old
            return self.block()
        if t == "while":
            self.p += 1
            self.conditions()
            return self.block()
        if t == "repeat":
            self.p += 1
            self.block()
            self.need("while")
            self.expr()
            return
        if t == "switch":
            return self._switch()
        if t == "do":
            self.p += 1
            self.effects()
            self.block()
            while self.ok("catch"):
                old, self.no_closure = self.no_closure, True
                while K[self.p] != "{":
                    self.pattern()
                    if self.ok("where"):
                        self.expr()
                    if not self.ok(","):
                        break
                self.no_closure = old
                self.block()
            return
        if t == "defer":
            self.p += 1
            return self.block()
        if t == "return":
            self.p += 1
            if not self.N[self.p] and K[self.p] not in (";", "}"):
                self.expr()
            return
        if t == "throw":
            self.p += 1
            self.expr()
            return
        if t in ("break", "continue"):
            self.p += 1
            if K[self.p] == "i" and not self.N[self.p]:
                self.p += 1
            return
        if t == "fallthrough":
            self.p += 1
            return
        if self.declares():
            return self.declaration()
        self.expr()

    # ------------------------------------------------------------ declarations

    def declares(self) -> bool:
        K, k = self.K, self.p
        while True:
            t = K[k]
            if t == "@" and K[k + 1] == "i":
                k += 2
                while K[k] == "." and K[k + 1] == "i":
                    k += 2
                if K[k] == "<":
                    k = self.angle(k) or k
                if K[k] == "(" and not self.N[k]:
                    k = self.ends[k] + 1
            elif t == "class" and K[k + 1] in ("func", "var", "let", "subscript", "override", "final", "private", "public", "internal"):
                k += 1
            elif t in _DECLARES:
                if t == "init":
                    return K[k + 1] in ("(", "?", "!", "<") and self.in_type
                return t != "case" or self.in_type
            elif t in _RESERVED_MODIFIERS or t == "i" and self.V[k] in _MODIFIERS and (K[k + 1] in _DECLARES or K[k + 1] in _RESERVED_MODIFIERS or K[k + 1] in ("i", "@", "(")):
                k += 1
                if K[k] == "(" and self.K[k + 1] == "i" and K[k + 2] == ")":
                    k += 3
                elif K[k] == "(":
                    return False
            elif t == "i" and self.V[k] in ("actor", "macro") and K[k + 1] == "i" and not self.N[k + 1]:
                return True
            else:
                return False

    in_type = False

    def modifiers(self):
        K = self.K
        while True:
            t = K[self.p]
            if t == "@":
                self.attributes()
            elif t == "class" and K[self.p + 1] in ("func", "var", "let", "subscript", "override", "final", "private", "public", "internal"):
                self.p += 1
            elif t in _RESERVED_MODIFIERS and t != "class" or t == "i" and self.V[self.p] in _MODIFIERS:
                self.p += 1
                if K[self.p] == "(":
                    self.p = self.ends[self.p] + 1
            else:
                return

    def declaration(self):
        K, first = self.K, self.p
        self.modifiers()
        t, name = K[self.p], self.p + 1
        if t == "init":
            name = self.p
        kind = "callable" if t in ("func", "init") else "type" if t in ("class", "struct", "enum", "protocol", "extension") or t == "i" and self.V[self.p] == "actor" else ""
        if kind and (K[name] == "i" or t == "init"):
            while t == "extension" and K[name + 1] == "." and K[name + 2] == "i":
                name += 2
            self.opens(self.V[name])
            self._declaration()
            return self.closes("scope" if t == "extension" else kind, name, first)
        self._declaration()
        if t == "import":
            self.found.append(("import", self.p - 1, name, self.p - 1, "*"))

    def _declaration(self):
        K = self.K
        t = K[self.p]
        self.p += 1
        if t == "import":
            if K[self.p] in ("class", "struct", "enum", "protocol", "func", "var", "let", "typealias"):
                self.p += 1
            self.dotted()
        elif t in ("let", "var"):
            self._variables()
        elif t == "func":
            if K[self.p] == "i":
                self.p += 1
            else:
                if K[self.p] not in _SIGNS:
                    raise Bad
                while K[self.p] in _SIGNS and not (K[self.p] == "<" and K[self.p + 1] == "i"):
                    self.p += 1
            if K[self.p] == "<":
                self.generics()
            self.params()
            self.effects()
            if self.ok("->"):
                self.type()
            self.where()
            if K[self.p] == "{":
                self.body()
        elif t in ("init", "deinit"):
            if t == "init":
                if not self.ok("?"):
                    self.ok("!")
                if K[self.p] == "<":
                    self.generics()
                self.params()
                self.effects()
                self.where()
            if K[self.p] == "{":
                self.body()
        elif t == "subscript":
            if K[self.p] == "<":
                self.generics()
            self.params()
            self.need("->")
            self.type()
            self.where()
            self.accessors()
        elif t in ("typealias", "associatedtype"):
            self.name()
            if K[self.p] == "<":
                self.generics()
            if self.ok(":"):
                self._inherits()
            if self.ok("="):
                self.type()
            elif t == "typealias":
                raise Bad
            self.where()
        elif t in ("class", "struct", "enum", "protocol", "extension") or t == "i" and self.V[self.p - 1] == "actor":
            if t == "extension":
                self.type()
            else:
                self.name()
                if K[self.p] == "<":
                    self.generics()
            if self.ok(":"):
                self._inherits()
            self.where()
            self.members()
        elif t == "case":
            while True:
                self.name()
                if K[self.p] == "(":
                    self.p += 1
                    self.listed(self._tuple_type, ")", ",", True)
                if self.ok("="):
                    self.expr()
                if not self.ok(","):
                    break
        elif t == "operator":
            while K[self.p] in _SIGNS:
                self.p += 1
            if self.ok(":"):
                self.name()
        elif t == "precedencegroup":
            self.name()
            self.p = self.ends[self.p] + 1 if K[self.p] == "{" else self._raise()
        else:
            raise Bad

    def _inherits(self):
        while True:
            if not self.ok("class"):
                self.ok("~")
                base = self.p
                self.type()
                self.found.append(("inherits", base, base, base, ".".join(self.inside_of)))
            if not self.ok(","):
                return

    def _variables(self):
        K = self.K
        while True:
            if K[self.p] == "(":
                self.p += 1
                self.listed(self._sub_pattern, ")")
            else:
                self.name()
            if self.ok(":"):
                self.type()
            if self.ok("="):
                old, self.no_closure = self.no_closure, False
                self.expr()
                self.no_closure = old
            if K[self.p] == "{" and not self.N[self.p]:
                self.accessors()
            if not self.ok(","):
                return

    def accessors(self):
        K, V = self.K, self.V
        if K[self.p] != "{":
            return
        k = self.p + 1
        while K[k] == "@" or K[k] in ("private", "public", "internal", "fileprivate") or K[k] == "i" and V[k] in ("mutating", "nonmutating"):
            k += 2 if K[k] == "@" else 1
        if K[k] == "i" and V[k] in _ACCESSORS and (K[k + 1] in ("{", "(", "}", "throws", "i") or self.N[k + 1]) and not (K[k + 1] == "(" and V[k] in ("get",)):
            self.p += 1
            while not self.ok("}"):
                self.modifiers()
                if K[self.p] != "i" or V[self.p] not in _ACCESSORS:
                    raise Bad
                self.p += 1
                if self.ok("("):
                    self.name()
                    self.need(")")
                self.effects()
                if K[self.p] == "{":
                    self.body()
                self.ok(";")
        else:
            self.body()

    def body(self):
        old, self.in_type = self.in_type, False
        self.block()
        self.in_type = old

    def members(self):
        K = self.K
        old, self.in_type = (self.in_type, self.no_closure), True
        self.no_closure = False
        self.need("{")
        while True:
            while self.ok(";"):
                pass
            if self.ok("}"):
                break
            if self.is_word("#warning") or self.is_word("#error"):
                self.p = self.ends[self.p + 1] + 1
                continue
            if not self.declares() and not (K[self.p] == "deinit"):
                raise Bad
            self.declaration()
            if K[self.p] not in (";", "}") and not self.N[self.p]:
                raise Bad
        self.in_type, self.no_closure = old

    def params(self):
        self.need("(")
        self.listed(self._param, ")", ",", True)

    def _param(self):
        K = self.K
        self.attributes()
        if K[self.p] != "i" and not K[self.p].isalpha() or K[self.p] in ("n", "s", "let", "var"):
            raise Bad
        self.p += 1
        if K[self.p] == "i":
            self.p += 1
        self.need(":")
        self.type()
        if self.ok("="):
            self.expr()

    @staticmethod
    def begins(kinds, words, fresh):
        return not (kinds[0] == "import" and kinds[1] in ("s", "{", "(", "*")) and kinds[0] not in ("#", "n", ")", "}", "else", "case", "catch")

    def top(self):
        K = self.K
        while K[self.p]:
            if self.ok(";"):
                continue
            self.statement()
            if K[self.p] not in (";", "") and not self.N[self.p]:
                raise Bad

    def hole(self):
        self.expr()
        while self.ok(","):
            self.name()
            self.need(":")
            self.expr()
