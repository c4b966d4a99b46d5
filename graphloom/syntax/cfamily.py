"""C and C++. Directives are gone (see conditionals.py); macros in capitals may stand as calls of their own."""

from __future__ import annotations

from graphloom.syntax.base import PLAIN, Bad, Parser

_STORAGE = frozenset("auto register static extern typedef inline const volatile restrict _Noreturn _Thread_local _Atomic mutable thread_local virtual explicit friend constexpr consteval constinit".split())
_ELABORATED = frozenset(["struct", "union", "enum", "class"])
_CAST = frozenset(["i", "n", "s", "(", "!", "~", "-", "+", "*", "&", "sizeof", "this", "++", "--", "new", "static_cast", "::", "[", "_Alignof", "alignof", "prim", "{"])
_OPERATORS = frozenset("+ - * / % ^ & | ~ ! = < > += -= *= /= %= ^= &= |= << <<= == != <= >= <=> && || ++ -- , ->* ->".split())
_AFTER_TEMPLATE = frozenset(["(", "::", "{", ")", ",", ";", ">", "]", "}", "&&", "||", "...", ""])


class C(Parser):
    LANGUAGE = "c"
    CPP = False
    PREFIX = frozenset(["!", "~", "+", "-", "++", "--", "*", "&", "&&"])
    ANGLED = frozenset()
    NO_TARGET = frozenset(["n", "s"])

    # ------------------------------------------------------------ types and declarators

    def attributes(self):
        """Attributes of compilers and, in brackets, of the standard."""
        K = self.K
        while True:
            if K[self.p] == "i" and self.V[self.p] in ("__attribute__", "__declspec", "__asm__", "asm") and K[self.p + 1] == "(":
                self.p = self.ends[self.p + 1] + 1
            elif K[self.p] == "[" and K[self.p + 1] == "[":
                self.p += 2
                self.listed(self._attribute, "]")
                self.need("]")
            elif K[self.p] in ("alignas", "_Alignas"):
                self.p += 1
                self.need("(")
                if not self.tries(self._type_id_closed):
                    self.expr()
                    self.need(")")
            else:
                return

    def _attribute(self):
        self.p += self.K[self.p] in ("i", "const", "noreturn")
        if self.K[self.p] == "::":
            self.p += 1
            self.name()
        if self.K[self.p] == "(":
            self.p = self.ends[self.p] + 1

    def _type_id_closed(self):
        self.type_id()
        self.need(")")

    def specifiers(self) -> bool:
        """Storage, qualifiers and the type; whether the type came with a body."""
        K = self.K
        typed = seen = False
        bodied = False
        while True:
            t = K[self.p]
            if t in _STORAGE and not (t == "auto" and self.CPP and typed):
                if t == "explicit" and K[self.p + 1] == "(":
                    self.p = self.ends[self.p + 1]
                if t == "auto" and self.CPP:
                    typed = True
                if t == "extern" and K[self.p + 1] == "s":
                    self.p += 1
                if t == "_Atomic" and K[self.p + 1] == "(":
                    self.p += 2
                    self.type_id()
                    self.need(")")
                    typed = True
                    seen = True
                    continue
                self.p += 1
                seen = True
            elif t == "prim":
                if typed and not self._prim_typed:
                    raise Bad
                self.p += 1
                typed = seen = self._prim_typed = True
            elif t in _ELABORATED:
                if typed or t == "class" and not self.CPP:
                    raise Bad
                bodied = self.elaborated()
                typed = seen = True
            elif t == "typename" and self.CPP:
                self.p += 1
                self.qualified()
                typed = seen = True
            elif t == "decltype" and self.CPP and not typed:
                self.p += 1
                self.need("(")
                if not self.ok("auto"):
                    self.exprs()
                self.need(")")
                while self.ok("::"):
                    self.name()
                typed = seen = True
            elif not typed and (t == "i" or t == "::" and self.CPP):
                if t == "i" and self.V[self.p] in ("__attribute__", "__declspec", "__extension__", "__inline", "__inline__", "__restrict", "__restrict__", "__volatile__", "__const"):
                    if K[self.p + 1] == "(":
                        self.attributes()
                    else:
                        self.p += 1
                    continue
                if K[self.p] == "i" and K[self.p + 1] == "i" and self.is_macro(self.p) and K[self.p + 2] in ("i", "*", "&"):  # an export macro before the type
                    self.p += 1
                    seen = True
                    continue
                self.qualified()
                typed = seen = True
            elif t == "[" and K[self.p + 1] == "[" or t in ("alignas", "_Alignas") or t == "i" and self.V[self.p] in ("__attribute__", "__declspec"):
                self.attributes()
            else:
                break
        self._prim_typed = False
        if not seen or not typed and not (K[self.p] in ("*", "i")):
            raise Bad
        if not typed:
            raise Bad
        return bodied

    _prim_typed = False

    def is_macro(self, at: int) -> bool:
        w = self.V[at]
        return len(w) > 2 and w == w.upper() and any(c.isalpha() for c in w)

    def qualified(self):
        """A name, with scopes and template arguments in C++."""
        self.name()

    def elaborated(self) -> bool:
        K, start = self.K, self.p
        kind = K[self.p]
        self.p += 1
        if kind == "enum" and self.CPP and not self.ok("class"):
            self.ok("struct")
        self.attributes()
        named = K[self.p] == "i"
        if K[self.p] == "i" and K[self.p + 1] == "i" and self.is_macro(self.p) and self.CPP:
            self.p += 1
        if named or K[self.p] == "::":
            self.qualified()
            if self.CPP and self.is_word("final"):
                self.p += 1
        if self.CPP and K[self.p] == ":" and self._body_ahead():
            self.p += 1
            if kind == "enum":
                self.type_id()
            else:
                self.bases()
        if K[self.p] == "{":
            own = start + 1
            if named:
                while K[own] != "i" or self.CPP and K[own + 1] == "i" and self.is_macro(own):
                    own += 1
                self.opens(self.V[own])
            if kind == "enum":
                self.p += 1
                self.listed(self._enumerator, "}", ",", True)
            else:
                self.members()
            if named:
                self.closes("type", own, start)
            return True
        if not named:
            raise Bad
        return False

    def _body_ahead(self) -> bool:
        k = self.p
        while self.K[k] not in ("{", ";", "", "=", ")"):
            k = self.ends[k] + 1 if self.K[k] in ("(", "[") else k + 1
        return self.K[k] == "{"

    def bases(self):
        raise Bad

    def _enumerator(self):
        self.name()
        self.attributes()
        if self.ok("="):
            self.expr()

    def members(self):
        self.need("{")
        while not self.ok("}"):
            self.member()

    def member(self):
        K = self.K
        if self.ok(";"):
            return
        if K[self.p] == "_Static_assert":
            return self._assertion()
        bodied = self.specifiers()
        if self.ok(";"):
            if not bodied and K[self.p - 2] != "}":
                raise Bad
            return
        while True:
            if K[self.p] != ":":
                self.declarator(False)
            if self.ok(":"):
                self.expr()
            self.attributes()
            if not self.ok(","):
                break
        self.need(";")

    def _assertion(self):
        self.p += 1
        self.need("(")
        self.expr()
        if self.ok(","):
            self.need("s")
        self.need(")")
        self.need(";")

    def pointers(self):
        K = self.K
        while K[self.p] == "*" or self.CPP and K[self.p] in ("&", "&&") or K[self.p] in ("const", "volatile", "restrict", "_Atomic") or K[self.p] == "i" and self.V[self.p] in ("__restrict", "__restrict__", "__const"):
            self.p += 1

    def declarator(self, abstract: bool, function_name: bool = False):
        """Pointers, a name (or none, if abstract) and what follows it; parentheses hold a declarator or parameters."""
        K = self.K
        self.attributes()
        self.pointers()
        self.attributes()
        if self.CPP:
            self.ok("...")
        t = K[self.p]
        if t == "i" or t == "::" and self.CPP or t in ("operator", "~") and self.CPP:
            self.declared_name()
        elif t == "(" and (K[self.p + 1] in ("*", "^", "&", "&&", "(") or K[self.p + 1] == "i" and (not abstract or K[self.p + 2] in ("*", "::") and self.CPP) and self.tries(self._inner_ahead)):
            self.p += 1
            if K[self.p] == "i":
                self.word("__stdcall")
            self.declarator(abstract)
            self.need(")")
        elif not abstract:
            raise Bad
        self.suffixes(abstract)

    def _inner_ahead(self):
        """Only to look: a parenthesised declarator closes after its name."""
        at = self.p
        self.need("(")
        self.word("__stdcall")
        if self.CPP and self.K[self.p] == "i" and self.K[self.p + 1] == "::":
            self.name()
            self.need("::")
        self.declarator(False)
        self.need(")")
        self.p = at

    def declared_name(self):
        self.name()

    def suffixes(self, abstract: bool):
        K = self.K
        while True:
            t = K[self.p]
            if t == "[" and K[self.p + 1] != "[":
                self.p += 1
                while K[self.p] in ("static", "const", "restrict", "volatile"):
                    self.p += 1
                if K[self.p] == "*" and K[self.p + 1] == "]":
                    self.p += 1
                if not self.ok("]"):
                    self.expr()
                    self.need("]")
            elif t == "(" and self.tries(self.params):
                self.after_params()
            else:
                self.attributes()
                return

    def after_params(self):
        self.attributes()

    def params(self):
        K = self.K
        self.need("(")
        if K[self.p] == "prim" and self.V[self.p] == "void" and K[self.p + 1] == ")":
            self.p += 2
            return
        if self.ok(")"):
            return
        while True:
            if self.ok("..."):
                return self.need(")")
            self.param()
            if self.ok(")"):
                return
            if self.CPP and self.ok("..."):
                return self.need(")")
            self.need(",")

    def param(self):
        self.specifiers()
        self.declarator(True)

    def type_id(self):
        self.specifiers()
        self.declarator(True)
        if self.K[self.p - 1] == "i" and self.K[self.p - 2] in ("*", "&", "&&") and self.K[self.p - 1] == "i":
            raise Bad

    # ------------------------------------------------------------ expressions

    def exprs(self):
        self.expr()
        while self.ok(","):
            self.expr()

    def middle(self):
        if self.K[self.p] != ":":
            self.exprs()

    def unary(self):
        K = self.K
        while K[self.p] in self.PREFIX:
            self.p += 1
        t = K[self.p]
        if t == "(":
            if self.tries(self.cast):
                return self.initializer(False) if K[self.p] == "{" else self.unary()
            self.p += 1
            if K[self.p] == "{":  # a statement as an expression
                self.block()
            else:
                self.exprs()
            self.need(")")
        elif t == "sizeof" or t in ("_Alignof", "alignof"):
            self.p += 1
            if self.CPP and K[self.p] == "...":
                self.p += 1
            if K[self.p] == "(" and self.tries(self._type_in_parens):
                if K[self.p] == "{":
                    self.initializer(False)
                return
            return self.unary()
        elif not self.primary(t):
            raise Bad
        self.postfix()

    def primary(self, t: str) -> bool:
        K = self.K
        if t == "i":
            self.qualified()
        elif t == "n":
            self.p += 1
        elif t == "s":
            self.p += 1
            while K[self.p] == "s" or K[self.p] == "i" and (K[self.p + 1] == "s" or self.is_macro(self.p) or self.V[self.p].startswith("PRI")):
                self.p += 1
        elif t == "_Generic":
            self.p += 1
            self.need("(")
            self.expr()
            while self.ok(","):
                if not self.ok("default"):
                    self.type_id()
                self.need(":")
                self.expr()
            self.need(")")
        else:
            return False
        return True

    def _type_in_parens(self):
        self.need("(")
        self.type_id()
        self.need(")")

    def cast(self):
        at = self.p
        self.need("(")
        plain = self.K[self.p] == "i" and self.K[self.p + 1] == ")"
        self.type_id()
        self.need(")")
        n = self.K[self.p]
        if n not in _CAST or plain and n in ("-", "+", "*", "&", "(", "++", "--", "["):
            raise Bad
        if n == "{" and self.K[at - 1] in ("if", "while", "for", "switch", "i", ")"):
            raise Bad

    def postfix(self):
        K = self.K
        while True:
            t = K[self.p]
            if t in (".", "->"):
                self.p += 1
                self.member_name()
            elif t == "(":
                if K[self.p - 1] in ("n", "s"):
                    raise Bad
                self.calls()
                self.args()
            elif t == "[":
                self.p += 1
                self.subscript()
                self.need("]")
            elif t in ("++", "--"):
                if K[self.p - 1] in ("n", "s"):
                    raise Bad
                self.p += 1
            elif not self.more_postfix(t):
                return

    def subscript(self):
        self.exprs()

    def more_postfix(self, t: str) -> bool:
        return False

    def member_name(self):
        self.name()

    def args(self):
        self.p += 1
        self.listed(self.argument, ")")

    def argument(self):
        """A macro may take a type."""
        K = self.K
        if K[self.p] in ("prim", "struct", "const", "enum", "union", "unsigned") or K[self.p] == "i" and K[self.p + 1] == "*" and K[self.p + 2] in (",", ")", "*"):
            return self.type_id()
        self.expr()

    def initializer(self, designated: bool = True):
        self.need("{")
        self.listed(self._initial, "}", ",", True)

    def _initial(self):
        K = self.K
        named = False
        while K[self.p] == "." and K[self.p + 1] == "i" or K[self.p] == "[" and K[self.ends[self.p] + 1] in ("=", ".", "["):
            named = True
            if self.ok("."):
                self.name()
            else:
                self.p += 1
                self.expr()
                if self.ok("..."):
                    self.expr()
                self.need("]")
        if named:
            if not (self.CPP and K[self.p] == "{"):
                self.need("=")
        elif K[self.p] == "i" and K[self.p + 1] == ":" and K[self.p + 2] != ":":
            self.p += 2
        self.value()

    def value(self):
        if self.K[self.p] == "{":
            self.initializer()
        else:
            self.expr()

    # ------------------------------------------------------------ declarations

    def declared(self):
        """The head of a declaration up to its first declarator: only where one of these follows."""
        if self.K[self.p] == "i" and self.K[self.p + 1] in ("(", "=", ".", "->", "++", "--", "+=", "-=", "[", ";", "<<") and not self.V[self.p].startswith("__"):
            raise Bad
        bodied = self.specifiers()
        if self.K[self.p] == ";":
            if not bodied and self.K[self.p - 2] not in _ELABORATED:
                raise Bad
            return
        self.declarator(False, True)
        if self.K[self.p] not in ("=", ";", ",", "{", ":", "(") or self.K[self.p] == ":" and not self._colon_ok():
            raise Bad
        if self.K[self.p] == "(" and not self.CPP:
            raise Bad

    def _colon_ok(self) -> bool:
        return False

    def declaration(self, local: bool):
        """After the head of the first declarator."""
        K = self.K
        if self.ok(";"):
            return
        while True:
            if self.ok("="):
                self.value()
            elif self.CPP and K[self.p] == "{" and K[self.p - 1] != ")":
                self.initializer()
            elif self.CPP and K[self.p] == "(":
                self.args()
            self.attributes()
            if not self.ok(","):
                break
            self.declarator(False)
        self.need(";")

    def statement(self):
        K = self.K
        t = K[self.p]
        handler = self.STATEMENTS.get(t)
        if handler:
            return handler(self)
        if t == "i" and K[self.p + 1] == ":" and K[self.p + 2] != ":":
            self.p += 2
            if K[self.p] != "}":
                self.statement()
            return
        if t == "[" and K[self.p + 1] == "[":
            self.attributes()
            return self.statement()
        if self.special(t):
            return
        if self.tries(self.declared):
            return self.local()
        if t == "i" and K[self.p + 1] == "(" and self.is_macro(self.p) and K[self.ends[self.p + 1] + 1] != ";" and self.N[self.ends[self.p + 1] + 1]:
            self.p += 1
            return self.args()
        self.exprs()
        self.need(";")

    def local(self):
        if self.K[self.p] == "{" and self.K[self.p - 1] == ")" and not self.CPP:
            return self.block()
        self.declaration(True)

    def special(self, t: str) -> bool:
        return False

    def block(self):
        self.need("{")
        while not self.ok("}"):
            self.statement()

    def condition(self):
        self.need("(")
        self.exprs()
        self.need(")")

    def _block(self):
        self.block()

    def _empty(self):
        self.p += 1

    def _if(self):
        self.p += 1
        if self.CPP:
            self.ok("constexpr")
            if self.ok("!") or self.K[self.p] == "consteval":
                self.need("consteval")
                self.block()
                if self.ok("else"):
                    self.statement()
                return
        self.condition()
        self.statement()
        if self.ok("else"):
            self.statement()

    def _while(self):
        self.p += 1
        self.condition()
        self.statement()

    def _do(self):
        self.p += 1
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def _for(self):
        self.p += 1
        self.need("(")
        if not self.ok(";"):
            if self.CPP and self.ranged():
                return self.statement()
            if self.tries(self.declared):
                self.declaration(True)
            else:
                self.exprs()
                self.need(";")
        if self.K[self.p] != ";":
            self.exprs()
        self.need(";")
        if self.K[self.p] != ")":
            self.exprs()
        self.need(")")
        self.statement()

    def ranged(self) -> bool:
        return False

    def _switch(self):
        self.p += 1
        self.condition()
        self.statement()

    def _case(self):
        self.p += 1
        self.expr()
        if self.ok("..."):
            self.expr()
        self.need(":")
        if self.K[self.p] != "}":
            self.statement()

    def _default(self):
        self.p += 1
        self.need(":")
        if self.K[self.p] != "}":
            self.statement()

    def _return(self):
        self.p += 1
        if self.K[self.p] != ";":
            if self.CPP:
                self.value()
                while self.ok(","):
                    self.expr()
            else:
                self.exprs()
        self.need(";")

    def _jump(self):
        self.p += 1
        self.need(";")

    def _goto(self):
        self.p += 1
        if not self.ok("*"):
            self.name()
        else:
            self.expr()
        self.need(";")

    def _bad(self):
        raise Bad

    STATEMENTS = {"{": _block, ";": _empty, "if": _if, "while": _while, "do": _do, "for": _for, "switch": _switch, "case": _case, "default": _default, "return": _return, "break": _jump, "continue": _jump, "goto": _goto, "else": _bad, "_Static_assert": lambda self: self._assertion()}

    def external(self):
        """A declaration or definition at the top."""
        K = self.K
        if self.ok(";"):
            return
        if K[self.p] == "_Static_assert":
            return self._assertion()
        if K[self.p] == "i" and K[self.p + 1] == "(" and (self.is_macro(self.p) or self.V[self.p] in ("__asm__", "asm")):
            self.p += 1
            self.args()
            self.ok(";")
            return
        first = self.p
        if not self.tries(self.declared):
            raise Bad
        if K[self.p] == "{" and K[self.p - 1] == ")":
            name = self.named(first)
            self.opens(self.V[name])
            self.block()
            return self.closes("callable", name, first)
        self.declaration(False)

    def named(self, first: int) -> int:
        """The token that names the function whose head, from `first` on, has just been read."""
        k = first
        while self.K[k] != "(" or self.K[k - 1] != "i" or self.V[k - 1].startswith("__"):
            if k >= self.p:
                return first
            k += 1
        return k - 1

    @staticmethod
    def begins(kinds, words, fresh):
        return kinds[0] not in ("s", "n", "(", ")", "{", "}", "if", "for", "while", "return", ".", "+", "-", "*", "=", "!") and not (kinds[0] == "i" and kinds[1] in ("=", ".", "{", "[", "s", "n", "+=", "}", ")", ","))

    def top(self):
        while self.K[self.p]:
            self.external()


class Cpp(C):
    LANGUAGE = "cpp"
    CPP = True
    BINARY = Parser.BINARY | {"<=>", "->*", ".*"}
    ANGLED = frozenset(["i", "prim", ",", ".", "&", "&&", "[", "(", "::", "*", "n", "s", "const", "volatile", "struct", "class", "typename", "template", "...", "auto", "unsigned", "sizeof", "+", "-", "decltype", "=", "|", "==", "{", "!", "enum", "operator"])

    def __init__(self, tokens):
        super().__init__(tokens)
        self.in_type = False

    # ------------------------------------------------------------ names

    def qualified(self):
        K = self.K
        self.ok("::")
        while True:
            self.ok("template")
            self.name()
            self._template()
            if K[self.p] == "::" and K[self.p + 1] in ("i", "template"):
                self.p += 1
            else:
                return

    def _template(self):
        """Template arguments; in an expression only if what follows shows that the angle bracket opened some."""
        if self.K[self.p] == "<" and (end := self.angle(self.p)) and (self.in_type or self.K[end] in _AFTER_TEMPLATE):
            at = self.p
            if not self.tries(self.template_args):
                self.p = at

    def template_args(self):
        self.need("<")
        self.listed(self._template_arg, ">")

    def _template_arg(self):
        if not self.tries(self._type_arg):
            self.binary_free()
        self.ok("...")

    def _type_arg(self):
        self.type_id()
        self.ok("...")
        if self.K[self.p] not in (",", ">"):
            raise Bad
        self.p -= self.K[self.p - 1] == "..."

    def binary_free(self):
        """An expression in which no bare angle bracket closes anything."""
        self.unary()
        while self.K[self.p] in self.BINARY and self.K[self.p] != ">":
            self.p += 1
            self.unary()

    def declared_name(self):
        K = self.K
        self.ok("::")
        while True:
            if self.ok("~"):
                return self.name()
            if self.ok("operator"):
                return self._operator()
            self.name()
            if K[self.p] == "<" and self.angle(self.p):
                self.template_args()
            if K[self.p] == "::":
                self.p += 1
                if self.ok("*"):
                    self.pointers()
                    if K[self.p] == "i":
                        self.p += 1
                    return
            else:
                return

    def _operator(self):
        K = self.K
        t = K[self.p]
        if t in ("(", "["):
            self.p += 1
            self.need(")" if t == "(" else "]")
        elif t in ("new", "delete"):
            self.p += 1
            if self.ok("["):
                self.need("]")
        elif t in _OPERATORS:
            while K[self.p] == ">" and self.V[self.p] == ">>":
                self.p += 1
            self.p += 1
        elif t == "s":
            self.p += 1
            self.ok("i")
        elif t == "co_await":
            self.p += 1
        else:  # a conversion
            self.specifiers()
            self.pointers()

    def member_name(self):
        self.ok("template")
        if self.ok("~"):
            return self.name()
        if self.ok("operator"):
            return self._operator()
        self.qualified()

    # ------------------------------------------------------------ expressions

    def assignable(self):
        return self.K[self.p - 1] not in ("n", "s", "this")

    def expr(self):
        if self.K[self.p] == "throw":
            self.p += 1
            if self.K[self.p] not in (";", ")", ",", ":", "}"):
                self.expr()
            return PLAIN
        if self.K[self.p] == "co_yield":
            self.p += 1
        form = super().expr()
        if self.K[self.p] == "{" and self.K[self.p - 1] == "=":
            self.initializer()
        return form

    def unary(self):
        K = self.K
        if K[self.p] == "{" and K[self.p - 1] in self.ASSIGN | {"?", ":"}:
            return self.initializer()
        if K[self.p] == "throw":
            self.expr()
            return
        super().unary()

    def primary(self, t):
        K = self.K
        if self.in_type:
            return self.untyped(self.primary, t)
        if t == "...":  # a fold
            self.p += 1
            if K[self.p - 2] == "(" and K[self.p] in self.BINARY:
                self.p += 1
                self.unary()
                return True
            return K[self.p - 2] in self.BINARY and (K[self.p] in self.BINARY or K[self.p] == ")")
        if t in ("i", "::"):
            if t == "::" and K[self.p + 1] in ("new", "delete"):
                self.p += 1
                return self.primary(K[self.p])
            self.qualified()
            if K[self.p] == "::" and K[self.p + 1] in ("operator", "~"):
                self.p += 1
                self.declared_name()
            if K[self.p] == "s" and self.is_macro(self.p - 1):
                self.p += 1
            return True
        if t == "prim" or t in ("typename", "auto", "decltype"):
            if t == "decltype":
                self.p += 1
                self.need("(")
                self.exprs()
                self.need(")")
            elif t == "prim":
                while self.ok("prim"):
                    pass
            else:
                self.ok("typename")
                if not self.ok("auto"):
                    self.qualified()
            if self.ok("::"):
                self.qualified()
            if K[self.p] not in ("(", "{"):
                raise Bad
            return True
        if t == "this":
            self.p += 1
            return True
        if t in ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast"):
            self.p += 1
            self.need("<")
            self.type_id()
            self.need(">")
            self.need("(")
            self.exprs()
            self.need(")")
            return True
        if t in ("typeid", "noexcept"):
            self.p += 1
            self.need("(")
            if not self.tries(self._type_id_closed):
                self.exprs()
                self.need(")")
            return True
        if t == "new":
            self.p += 1
            if K[self.p] == "(":
                if not self.tries(self._new_in_parens):
                    self.args()
                    self._new_type()
            else:
                self._new_type()
            if K[self.p] == "(":
                self.args()
            elif K[self.p] == "{":
                self.initializer()
            return True
        if t == "delete":
            self.p += 1
            if self.ok("["):
                self.need("]")
            self.unary()
            return True
        if t in ("co_await",):
            self.p += 1
            self.unary()
            return True
        if t == "[":
            self.lambda_()
            return True
        if t == "requires":
            self.p += 1
            if K[self.p] == "(":
                self.params()
            self.need("{")
            while not self.ok("}"):
                self._requirement()
            return True
        if t == "operator":
            self.p += 1
            self._operator()
            return True
        return super().primary(t)

    def untyped(self, f, *args):
        old, self.in_type = self.in_type, False
        try:
            return f(*args)
        finally:
            self.in_type = old

    def _new_in_parens(self):
        self.need("(")
        self.type_id()
        self.need(")")
        if self.K[self.p] in ("i", "prim"):
            raise Bad

    def _new_type(self):
        self.specifiers()
        self.pointers()
        while self.K[self.p] == "[":
            self.p += 1
            if not self.ok("]"):
                self.expr()
                self.need("]")

    def _requirement(self):
        if self.ok("typename"):
            self.qualified()
        elif self.ok("requires"):
            self.expr()
        elif self.K[self.p] == "{":
            self.p += 1
            self.expr()
            self.need("}")
            self.ok("noexcept")
            if self.ok("->"):
                self.type_id()
        else:
            self.expr()
        self.need(";")

    def lambda_(self):
        K = self.K
        self.need("[")
        self.listed(self._capture, "]")
        if K[self.p] == "<":
            self.template_params()
        if K[self.p] == "(":
            self.params()
        self.attributes()
        while K[self.p] in ("mutable", "constexpr", "static", "noexcept", "consteval"):
            self.p += 1
            if K[self.p - 1] == "noexcept" and K[self.p] == "(":
                self.args()
        if self.ok("->"):
            self.type_id()
        if self.ok("requires"):
            self.unary()
        self.block()

    def _capture(self):
        K = self.K
        if K[self.p] in ("=", "&") and K[self.p + 1] in (",", "]"):
            self.p += 1
            return
        if self.ok("*"):
            return self.need("this")
        if self.ok("this"):
            return
        self.ok("&")
        self.ok("...")
        self.name()
        self.ok("...")
        if self.ok("="):
            self.expr()
        elif K[self.p] == "{":
            self.initializer()

    def more_postfix(self, t):
        if t == "{" and self.K[self.p - 1] in ("i", ">", "prim", ")") and self._braces_ok():
            self.initializer()
            return True
        if t == "..." and self.K[self.p + 1] in (")", ",", "}", "+", "-", "*", "&&", "||", "&", "|", "<<"):
            self.p += 1
            if self.K[self.p] in self.BINARY:
                self.p += 1
                if self.K[self.p] == "...":
                    self.p += 1
                else:
                    self.unary()
            return True
        return False

    def _braces_ok(self) -> bool:
        """A braced initialiser after a name; not the body of what was read as a condition or head."""
        if self.K[self.p - 1] == ")":
            return False
        return True

    def argument(self):
        if self.K[self.p] == "{":
            self.initializer()
        elif self.K[self.p] == "..." and self.K[self.p + 1] in self.BINARY:
            self.p += 2
            self.expr()
        else:
            K = self.K
            if K[self.p] in ("prim", "const", "struct", "class") and self.tries(self._type_argument):
                return
            self.expr()
        self.ok("...")

    def _type_argument(self):
        self.type_id()
        if self.K[self.p] not in (",", ")"):
            raise Bad

    def subscript(self):
        if self.K[self.p] == "{":
            self.initializer()
        else:
            self.exprs()

    # ------------------------------------------------------------ declarations

    def after_params(self):
        K = self.K
        while True:
            self.attributes()
            t = K[self.p]
            if t in ("const", "volatile", "&", "&&", "noexcept"):
                self.p += 1
                if t == "noexcept" and K[self.p] == "(":
                    self.args()
            elif t == "throw":
                self.p += 1
                self.need("(")
                self.listed(self.type_id, ")")
            elif t == "i" and self.V[self.p] in ("override", "final"):
                self.p += 1
            elif t == "->":
                self.p += 1
                self.type_id()
            elif t == "requires":
                self.p += 1
                self._constraint()
            elif t == "i" and self.is_macro(self.p) and K[self.p + 1] in (";", "{"):
                self.p += 1
            else:
                return

    def _constraint(self):
        while True:
            if self.K[self.p] in ("(", "requires"):
                self.unary()
            else:
                self.typed(self.qualified)
                if self.K[self.p] == "(":
                    self.args()
            if self.K[self.p] in ("&&", "||"):
                self.p += 1
            else:
                return

    def param(self):
        self.attributes()
        self.ok("this")
        self.specifiers()
        self.declarator(True)
        if self.ok("="):
            self.value()

    def base_of(self) -> int:
        """The name of the type whose bases are being read."""
        k = self.p
        while k > 0 and self.K[k] not in ("struct", "class", "union"):
            k -= 1
        return k + 1 if self.K[k + 2] != "i" or not self.is_macro(k + 1) else k + 2

    def bases(self):
        while True:
            while self.K[self.p] in ("public", "private", "protected", "virtual"):
                self.p += 1
            base = self.p
            self.typed(self.qualified)
            self.found.append(("inherits", base, base, base, ".".join([*self.inside_of, self.V[self.base_of()]])))
            self.ok("...")
            if not self.ok(","):
                return

    def template_params(self):
        self.need("<")
        self.listed(self._template_param, ">")

    def _template_param(self):
        K = self.K
        if K[self.p] == "template":
            self.p += 1
            self.template_params()
        if K[self.p] in ("typename", "class") and K[self.p + 1] in ("i", ",", ">", "=", "..."):
            self.p += 1
            self.ok("...")
            self.ok("i")
            if self.ok("="):
                self.type_id()
            return
        self.specifiers()
        self.ok("...")
        self.declarator(True)
        if self.ok("="):
            if not self.tries(self._type_arg):
                self.binary_free()

    def template_head(self):
        while self.ok("template"):
            if self.K[self.p] == "<":
                self.template_params()
                if self.ok("requires"):
                    self._constraint()

    def declared(self):
        K = self.K
        if K[self.p] in ("this", "return", "new", "delete", "throw", "case", "else"):
            raise Bad
        at = self.p
        super().declared()
        self.declared_at = at

    def typed(self, f, *args):
        """Within a type every angle bracket opens template arguments."""
        old, self.in_type = self.in_type, True
        try:
            return f(*args)
        finally:
            self.in_type = old

    def specifiers(self):
        """Constructors, destructors and conversions have no type: see constructor."""
        return self.typed(super().specifiers)

    def _colon_ok(self):
        return True

    def constructor(self) -> bool:
        """Whether a constructor, destructor or conversion begins here, after its modifiers."""
        K, k = self.K, self.p
        while K[k] in ("explicit", "inline", "constexpr", "virtual", "friend", "static") or K[k] == "i" and K[k + 1] == "i" and self.is_macro(k):
            k += 1
            if K[k - 1] == "explicit" and K[k] == "(":
                k = self.ends[k] + 1
        if K[k] == "~" and K[k + 1] == "i" or K[k] == "operator":
            self.p = k
            return True
        if K[k] == "::":
            k += 1
        last, start = "", k
        while K[k] == "i":
            w = self.V[k]
            k += 1
            if K[k] == "<":
                k = self.angle(k)
                if not k:
                    return False
            if K[k] == "(" and (w == last or last == "" and not self.is_macro(start) and K[self.ends[k] + 1] in ("{", ":", ";", "noexcept", "=", "requires", "try")):
                self.p = start
                return True
            if K[k] != "::":
                return False
            last = w
            k += 1
            if K[k] == "~" or K[k] == "operator" and K[k + 1] not in _OPERATORS and K[k + 1] not in ("(", "["):
                self.p = start
                return True
        return False

    def function_rest(self):
        """Initialisers of members, then a body, or what stands in its place."""
        K = self.K
        if self.ok(";"):
            return
        if self.ok("="):
            if not (self.ok("default") or self.ok("delete")):
                self.need("n")
            return self.need(";")
        tried = self.ok("try")
        if self.ok(":"):
            while True:
                self.qualified()
                if K[self.p] == "{":
                    self.initializer()
                else:
                    if K[self.p] != "(":
                        raise Bad
                    self.args()
                self.ok("...")
                if not self.ok(","):
                    break
        self.block()
        if tried:
            self._handlers()

    def declare(self, member: bool):
        """A declaration after its template head and attributes."""
        K = self.K
        at = self.p
        if self.constructor():
            if self.tries(self._constructor_head):
                name = self.named(at)
                self.opens(self._scoped(name))
                self.function_rest()
                return self.closes("callable", name, at)
        self.p = at
        if member and self.tries(self._field):
            return self._fields()
        if not self.tries(self.declared):
            raise Bad
        self._after_declared(member)

    def _after_declared(self, member: bool):
        K = self.K
        if K[self.p - 1] != "i" and K[self.p] in ("{", ":", "=") or K[self.p] in ("{", ":") and self._function_before():
            if K[self.p] == "{" and not self._function_before():
                return self.declaration(not member)
            if K[self.p] == "=" and K[self.p + 1] not in ("default", "delete", "n") or K[self.p] == "=" and not self._function_before():
                return self.declaration(not member)
            name = self.named(self.declared_at)
            self.opens(self._scoped(name))
            first = self.declared_at
            self.function_rest()
            return self.closes("callable", name, first)
        if K[self.p] == ":":
            raise Bad
        self.declaration(not member)

    declared_at = 0

    def _scoped(self, name: int) -> str:
        """A name with the scopes that stand before it."""
        k = name
        while self.K[k - 1] == "::" and self.K[k - 2] == "i":
            k -= 2
        return ".".join(self.V[j] for j in range(k, name + 1, 2))

    def _function_before(self) -> bool:
        """Whether the declarator just read ended with parameters."""
        k = self.p - 1
        while k > 0 and self.K[k] not in (")", ";", "}", "=", "{"):
            k -= 1
        return self.K[k] == ")"

    def _constructor_head(self):
        self.declared_name()
        self.params()
        self.after_params()

    def _field(self):
        self.specifiers()
        if self.K[self.p] != ":":
            self.pointers()
            self.name()
        if self.K[self.p] != ":" or self.K[self.p + 1] == ":":
            raise Bad
        self.need(":")
        self.expr()
        if self.K[self.p] not in (";", ",", "="):
            raise Bad

    def _fields(self):
        if self.ok("="):
            self.expr()
        while self.ok(","):
            self.declarator(False)
            if self.ok(":"):
                self.expr()
        self.need(";")

    def member(self):
        K = self.K
        if self.ok(";"):
            return
        if K[self.p] in ("public", "private", "protected") and K[self.p + 1] in (":", "i"):
            self.p += 1
            self.ok("i")
            return self.need(":")
        if K[self.p] == "i" and K[self.p + 1] == "(" and self.is_macro(self.p) and K[self.ends[self.p + 1] + 1] not in ("{", ":"):
            self.p += 1
            self.args()
            self.ok(";")
            return
        if self.common():
            return
        self.declare(True)

    def common(self) -> bool:
        """What may stand in classes, namespaces and at the top alike."""
        K = self.K
        t = K[self.p]
        if t == "using":
            self.p += 1
            if self.ok("namespace"):
                self.ok("::")
                self.dotted("::")
            elif self.ok("enum"):
                self.qualified()
            elif K[self.p] == "i" and K[self.p + 1] in ("=", "["):
                self.name()
                self.attributes()
                self.need("=")
                self.type_id()
            else:
                while True:
                    self.ok("typename")
                    self.qualified()
                    if K[self.p] == "::" and K[self.p + 1] == "operator":
                        self.p += 2
                        self._operator()
                    self.ok("...")
                    if not self.ok(","):
                        break
            self.need(";")
            return True
        if t == "static_assert":
            self._assertion()
            return True
        if t == "template":
            self.template_head()
            if self.common():
                return True
            if K[self.p] == "concept":
                self.p += 1
                self.name()
                self.need("=")
                self.expr()
                self.need(";")
                return True
            self.ok("friend")
            self.declare(True) if K[self.p] != "struct" and K[self.p] != "class" else self._classed()
            return True
        if t == "friend":
            self.p += 1
            if K[self.p] in ("class", "struct") and K[self.p + 1] in ("i", "::"):
                self.p += 1
                self.qualified()
                self.need(";")
                return True
            if K[self.p] == "i" and self.tries(self._friend_type):
                return True
            self.declare(True)
            return True
        return False

    def _friend_type(self):
        self.qualified()
        self.need(";")

    def _classed(self):
        at = self.p
        if not self.tries(self.declared):
            self.p = at
            raise Bad
        self._after_declared(False)

    def special(self, t):
        K = self.K
        if t in ("using", "static_assert"):
            return self.common()
        if t == "namespace" and K[self.p + 1] == "i" and K[self.p + 2] == "=":
            self.p += 3
            self.qualified()
            self.need(";")
            return True
        if t == "try":
            self.p += 1
            self.block()
            self._handlers()
            return True
        if t == "co_return":
            self._return()
            return True
        if t in ("auto", "const") and self.tries(self._binding):
            if K[self.p] == "=":
                self.p += 1
                self.value()
            elif K[self.p] == "{":
                self.initializer()
            else:
                self.args()
            self.need(";")
            return True
        return False

    def _binding(self):
        """The head of a structured binding."""
        while self.K[self.p] in ("const", "static", "constexpr"):
            self.p += 1
        self.need("auto")
        self.pointers()
        self.need("[")
        self.listed(self.name, "]", empty=False)
        if self.K[self.p] not in ("=", ":", "{", "("):
            raise Bad

    def _handlers(self):
        if self.K[self.p] != "catch":
            raise Bad
        while self.ok("catch"):
            self.need("(")
            if not self.ok("..."):
                self.specifiers()
                self.declarator(True)
            self.need(")")
            self.block()

    def local(self):
        self.declaration(True)

    def condition(self):
        """With a declaration or an initialiser before it, as the case may be."""
        self.need("(")
        if self.K[self.p] in ("auto", "const") and self.tries(self._binding):
            self.need("=")
            self.value()
            if self.ok(";"):
                self.exprs()
            return self.need(")")
        if self.tries(self._declared_condition):
            self.value()
            if self.ok(";"):
                self.exprs()
        else:
            self.exprs()
            if self.ok(";"):
                if self.tries(self._declared_condition):
                    self.value()
                else:
                    self.exprs()
        self.need(")")

    def _declared_condition(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] in ("(", "=", ".", "->", "++", "--", "[", ";", ")"):
            raise Bad
        self.specifiers()
        self.pointers()
        self.name()
        if self.K[self.p] == "{":
            return
        self.need("=")

    def ranged(self):
        at = self.p
        if self.tries(self._ranged):
            self.value()
            self.need(")")
            return True
        self.p = at
        return False

    def _ranged(self):
        if not self.tries(self._binding):
            self.specifiers()
            self.pointers()
            self.name()
        self.need(":")

    def external(self):
        K = self.K
        if self.ok(";"):
            return
        t = K[self.p]
        if t in ("namespace", "inline") and (t == "namespace" or K[self.p + 1] == "namespace"):
            self.ok("inline")
            self.p += 1
            self.attributes()
            first = self.p
            if K[self.p] == "i":
                self.name()
                while self.ok("::"):
                    self.ok("inline")
                    self.name()
                if self.ok("="):
                    self.qualified()
                    return self.need(";")
            self.opens(".".join(self.V[k] for k in range(first, self.p) if K[k] == "i"))
            self.braced()
            self.inside_of.pop()
            return
        if t == "extern" and K[self.p + 1] == "s" and K[self.p + 2] == "{":
            self.p += 2
            return self.braced()
        if t == "extern" and K[self.p + 1] == "template":
            self.p += 1
            t = "template"
        if t == "i" and K[self.p + 1] == "(" and (self.is_macro(self.p) or self.V[self.p] == "asm") and K[self.ends[self.p + 1] + 1] != ":":
            self.p += 1
            self.args()
            if K[self.p] == "{":
                return self.block()
            self.ok(";")
            return
        if self.common():
            return
        self.attributes()
        self.declare(False)

    def braced(self):
        self.need("{")
        while not self.ok("}"):
            self.external()
