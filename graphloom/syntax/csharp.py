"""C#."""

from __future__ import annotations

from graphloom.syntax.base import Bad, Parser

_MODIFIERS = frozenset("public private protected internal static readonly abstract virtual override sealed extern unsafe volatile new const fixed ref".split())
_SOFT = frozenset("async partial required file".split())
_CAST = frozenset(["i", "n", "s", "(", "!", "~", "this", "base", "new", "prim", "typeof", "default", "sizeof", "checked", "unchecked", "stackalloc", "delegate"])
#: After a closed angle bracket these show that it closed type arguments of a name in an expression.
_AFTER_GENERIC = frozenset(["(", ")", "]", "}", ":", ";", ",", ".", "?", "?.", "==", "!=", "|", "^", "&&", "||", "&", "[", "::", "{", ""])
_COMPARES = frozenset(["<", ">", "<=", ">=", "==", "!="])
_OVERLOADS = frozenset(["+", "-", "!", "~", "++", "--", "*", "/", "%", "&", "|", "^", "<<", "==", "!=", "<", ">", "<=", ">=", "n"])


class CSharp(Parser):
    LANGUAGE = "csharp"
    SHIFT = 3
    BINARY = Parser.BINARY | {"??", ".."}
    PREFIX = frozenset(["!", "~", "+", "-", "++", "--", "&", "*", "^", "..", "throw"])
    ANGLED = frozenset(["i", "prim", ",", ".", "?", "[", "(", "::", "*", "void", "in", "out"])
    NO_TARGET = Parser.NO_TARGET | {"this", "base"}

    # ------------------------------------------------------------ types

    def type(self, nullable: bool = True):
        K = self.K
        self.ok("ref")
        if not self.ok("prim"):
            if self.ok("void"):
                if K[self.p] != "*":
                    raise Bad
            elif K[self.p] == "(":
                self.p += 1
                self.listed(self._tuple_item, ")", empty=False)
            else:
                self.named()
        while True:
            t = K[self.p]
            if t == "[" and K[self.p + 1] in ("]", ","):
                self.p += 1
                while self.ok(","):
                    pass
                self.need("]")
            elif t == "*" or t == "?" and nullable:
                self.p += 1
            else:
                return

    def _tuple_item(self):
        self.type()
        self.ok("i")

    def named(self):
        K = self.K
        self.name()
        if K[self.p] == "::":
            self.p += 1
            self.name()
        while True:
            if K[self.p] == "<" and self.angle(self.p):
                self.type_args()
            if K[self.p] == "." and K[self.p + 1] == "i":
                self.p += 2
            else:
                return

    def type_args(self):
        self.need("<")
        if self.K[self.p] in (",", ">"):
            while self.ok(","):
                pass
            return self.need(">")
        self.listed(self.type, ">", empty=False)

    def types(self):
        self.type()
        while self.ok(","):
            self.type()

    def type_params(self):
        self.need("<")
        self.listed(self._type_param, ">", empty=False)

    def _type_param(self):
        self.attributes()
        if not self.ok("in"):
            self.ok("out")
        self.name()

    def constraints(self):
        while self.is_word("where") and self.K[self.p + 1] == "i" and self.K[self.p + 2] == ":":
            self.p += 3
            while True:
                if self.ok("new"):
                    self.need("(")
                    self.need(")")
                elif self.ok("class") or self.ok("struct"):
                    self.ok("?")
                elif not self.ok("default"):
                    self.type()
                if not self.ok(","):
                    break

    def attributes(self):
        K = self.K
        while K[self.p] == "[":
            self.p += 1
            if K[self.p] in ("i", "return", "event") and K[self.p + 1] == ":":
                self.p += 2
            self.listed(self._attribute, "]", ",", True, False)

    def _attribute(self):
        self.named()
        if self.K[self.p] == "(":
            self.p += 1
            self.listed(self._attribute_arg, ")")

    def _attribute_arg(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] in ("=", ":"):
            self.p += 2
        self.expr()

    # ------------------------------------------------------------ expressions

    def joint(self, kind):
        if kind == "is":
            self.p += 1
            self.pattern()
            return 2
        if kind == "as":
            self.p += 1
            self.type(False)
            if self.K[self.p] == "?" and self.K[self.p + 1] in (")", ";", ",", "]", "}", "??"):
                self.p += 1
            return 2
        return 0

    def pattern(self):
        while True:
            self.one_pattern()
            if not (self.word("and") or self.word("or")):
                return

    def one_pattern(self):
        K, V = self.K, self.V
        while self.word("not"):
            pass
        t = K[self.p]
        if t in _COMPARES:
            self.p += 1
            return self._constant()
        if t == "[":
            self.p += 1
            self.listed(self._slice_pattern, "]", ",", True)
            self.ok("i")
            return
        if t == "{":
            self.properties()
            self._designation()
            return
        if t == "(":
            self.p += 1
            self.listed(self._sub_pattern, ")", empty=False)
            if K[self.p] == "{":
                self.properties()
            self._designation()
            return
        if t == "i" and V[self.p] == "var":
            self.p += 1
            if not self.ok("i"):
                self.need("(")
                self.listed(self.name, ")")
            return
        if t in ("i", "prim"):
            at = self.p
            if self.tries(self.type, False):
                if K[self.p] == "{":
                    self.properties()
                    return self._designation()
                if K[self.p] == "(" and t == "i":
                    self.p += 1
                    if self.tries(self.listed, self._sub_pattern, ")"):
                        if K[self.p] == "{":
                            self.properties()
                        return self._designation()
                elif K[self.p] == "i" and V[self.p] not in ("and", "or", "when"):
                    self.p += 1
                    return
                elif K[self.p] not in ("+", "-", "*", "/", "<<", "."):
                    return
            self.p = at
        self._constant()

    def _designation(self):
        if self.K[self.p] == "i" and self.V[self.p] not in ("and", "or", "when"):
            self.p += 1

    def _slice_pattern(self):
        if self.ok(".."):
            if self.K[self.p] in (",", "]"):
                return
        self.pattern()

    def _sub_pattern(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] == ":":
            self.p += 2
        self.pattern()

    def properties(self):
        self.need("{")
        self.listed(self._property, "}", ",", True)

    def _property(self):
        self.dotted()
        self.need(":")
        self.pattern()

    def _constant(self):
        self.unary()
        while self.K[self.p] in ("+", "-", "*", "/", "%", "<<", "|", "&"):
            self.p += 1
            self.unary()

    def unary(self):
        K, V = self.K, self.V
        while True:
            t = K[self.p]
            if t == ".." and K[self.p + 1] in ("]", ")", ","):
                self.p += 1
                return
            if t in self.PREFIX:
                self.p += 1
            elif t == "i" and V[self.p] == "await" and K[self.p + 1] in _CAST:
                self.p += 1
            else:
                break
        p = self.p
        if t == "i":
            w = V[p]
            if K[p + 1] == "=>":
                self.p += 2
                return self.lambda_body()
            if w == "async" and K[p + 1] in ("i", "(", "delegate", "static"):
                if K[p + 1] == "i" and K[p + 2] == "=>" or K[p + 1] == "(" and K[self.ends[p + 1] + 1] == "=>" or K[p + 1] in ("delegate", "static"):
                    self.p += 1
                    return self.unary()
            if w == "from" and K[p + 1] in ("i", "prim") and (K[p + 2] == "in" or K[p + 2] == "i" and K[p + 3] == "in"):
                return self.query()
            self.p += 1
            if K[self.p] == "::":
                self.p += 1
                self.name()
            self._generic()
        elif t in ("n", "s", "this", "base"):
            self.p += 1
        elif t == "prim":
            self.p += 1
            if K[self.p] not in (".", "?", "[") and K[self.p] not in (")", ","):
                raise Bad
            if K[self.p] != ".":
                raise Bad
        elif t == "(":
            if K[self.ends[p] + 1] == "=>":
                self.params(True)
                self.need("=>")
                return self.lambda_body()
            if self.tries(self.cast):
                return self.unary()
            self.p += 1
            self.listed(self.argument, ")", empty=False)
        elif t == "static":
            self.p += 1
            return self.unary()
        elif t == "new":
            self.creator()
        elif t in ("typeof", "sizeof"):
            self.p += 1
            self.need("(")
            if not (self.K[self.p] == "void" and self.ok("void")):
                self.type()
            self.need(")")
        elif t == "default":
            self.p += 1
            if self.ok("("):
                self.type()
                self.need(")")
        elif t in ("checked", "unchecked"):
            self.p += 1
            self.need("(")
            self.expr()
            self.need(")")
        elif t == "stackalloc":
            self.p += 1
            if K[self.p] != "[":
                self.type(False)
            self.need("[")
            if not self.ok("]"):
                self.expr()
                self.need("]")
            if K[self.p] == "{":
                self.array()
        elif t == "delegate":
            self.p += 1
            if K[self.p] == "(":
                self.params()
            self.block()
            return
        elif t == "[":
            self.p += 1
            self.listed(self._collected, "]", ",", True)
            if K[self.p] == "(" and K[self.ends[self.p] + 1] == "=>":
                return self.unary()
        else:
            raise Bad
        self.postfix()

    def _collected(self):
        self.ok("..")
        self.expr()

    def _generic(self):
        if self.K[self.p] == "<" and (end := self.angle(self.p)) and self.K[end] in _AFTER_GENERIC and self.V[end - 1] != ">>":
            self.type_args()

    def cast(self):
        self.need("(")
        prim = self.K[self.p] == "prim"
        self.type()
        self.need(")")
        if self.K[self.p] not in _CAST and not (prim and self.K[self.p] in ("-", "+", "&", "*")):
            raise Bad
        if self.K[self.p] == "i" and self.V[self.p] in ("and", "or", "when"):
            raise Bad

    def lambda_body(self):
        if self.K[self.p] == "{":
            self.block()
        else:
            self.ok("ref")
            self.expr()

    def postfix(self):
        K = self.K
        while True:
            t = K[self.p]
            if t in (".", "?.", "->"):
                self.p += 1
                if t == "?." and K[self.p] == "[":
                    raise Bad
                self.name()
                self._generic()
            elif t == "(":
                if K[self.p - 1] in ("n", "s"):
                    raise Bad
                self.calls()
                self.args()
            elif t == "[":
                self.p += 1
                self.listed(self.argument, "]", empty=False)
            elif t == "?" and K[self.p + 1] == "[" and K[self.ends[self.p + 1] + 1] != ":":
                self.p += 1
            elif t in ("++", "--"):
                if K[self.p - 1] in ("n", "s"):
                    raise Bad
                self.p += 1
            elif t == "!" and K[self.p + 1] not in ("i", "n", "s", "("):
                self.p += 1
            elif t == "switch":
                self.p += 1
                self.need("{")
                self.listed(self._arm, "}", ",", True)
            elif t == "i" and self.V[self.p] == "with" and K[self.p + 1] == "{":
                self.p += 1
                self.initializer()
            else:
                return

    def _arm(self):
        self.pattern()
        if self.word("when"):
            self.guard()
        self.need("=>")
        self.expr()

    def guard(self):
        """An expression before an arrow: no lambda."""
        self.K, kept = self.K, self.K
        at = self.p
        depth = 0
        while depth or kept[at] not in ("=>", ":", ""):
            if kept[at] in ("(", "[", "{"):
                at = self.ends[at]
            at += 1
        if kept[at] == "":
            raise Bad
        sign, kept[at] = kept[at], ";"
        try:
            self.expr()
        finally:
            kept[at] = sign
        if self.p != at:
            raise Bad

    def args(self):
        self.p += 1
        self.listed(self.argument, ")")

    def argument(self):
        K = self.K
        if K[self.p] == "i" and K[self.p + 1] == ":" and K[self.p + 2] != ":":
            self.p += 2
        if K[self.p] in ("ref", "in"):
            self.p += 1
            return self.expr()
        if self.ok("out"):
            if self.tries(self._out):
                return
            return self.expr()
        if K[self.p] in ("i", "prim") and self.tries(self._deconstructed):
            return
        self.expr()

    def _out(self):
        self.type()
        self.name()
        if self.K[self.p] not in (",", ")"):
            raise Bad

    def _deconstructed(self):
        """`var x` or a typed name within a tuple that is taken apart."""
        self.type()
        self.name()
        if self.K[self.p] not in (",", ")") or self.V[self.p - 1] in ("and", "or") or not self._tuple_target():
            raise Bad

    def _tuple_target(self) -> bool:
        k = self.p
        while self.K[k] != ")":
            if self.K[k] in ("(", "[", "{"):
                k = self.ends[k]
            if not self.K[k]:
                return False
            k += 1
        return self.K[k + 1] in ("=", "in", ")", ",")

    def creator(self):
        self.need("new")
        K = self.K
        if K[self.p] == "{":
            return self.initializer()
        if K[self.p] == "(":
            self.args()
        elif K[self.p] == "[":
            self.p += 1
            while self.ok(","):
                pass
            self.need("]")
            return self.array()
        else:
            self._created_type()
            if K[self.p] == "(":
                self.args()
            elif K[self.p] == "[":
                self.p += 1
                self.listed(self.expr, "]", empty=False)
                while K[self.p] == "[" and K[self.p + 1] in ("]", ","):
                    self.p += 1
                    while self.ok(","):
                        pass
                    self.need("]")
            elif K[self.p] != "{":
                raise Bad
        if K[self.p] == "{":
            self.initializer()

    def _created_type(self):
        K = self.K
        if not self.ok("prim"):
            self.named()
        if K[self.p] == "?":
            self.p += 1
        while K[self.p] == "[" and K[self.p + 1] in ("]", ","):
            self.p += 1
            while self.ok(","):
                pass
            self.need("]")

    def initializer(self):
        self.need("{")
        self.listed(self._initial, "}", ",", True)

    def _initial(self):
        if self.K[self.p] == "{":
            return self.initializer()
        if self.K[self.p] == "[" and self.K[self.ends[self.p] + 1] == "=":
            self.p += 1
            self.listed(self.expr, "]", empty=False)
            self.need("=")
        elif self.K[self.p] == "i" and self.K[self.p + 1] == "=":
            self.p += 2
        if self.K[self.p] == "{":
            return self.initializer()
        self.expr()

    def array(self):
        self.need("{")
        self.listed(self._array_item, "}", ",", True)

    def _array_item(self):
        if self.K[self.p] == "{":
            self.array()
        else:
            self.expr()

    def query(self):
        def source():
            if not (self.K[self.p] == "i" and self.K[self.p + 1] == "in"):
                self.type()
            self.name()
            self.need("in")
            self.expr()

        self.p += 1
        source()
        while True:
            if self.word("from"):
                source()
            elif self.word("let"):
                self.name()
                self.need("=")
                self.expr()
            elif self.word("where"):
                self.expr()
            elif self.word("join"):
                source()
                if not self.word("on"):
                    raise Bad
                self.expr()
                if not self.word("equals"):
                    raise Bad
                self.expr()
                if self.word("into"):
                    self.name()
            elif self.word("orderby"):
                while True:
                    self.expr()
                    if not self.word("ascending"):
                        self.word("descending")
                    if not self.ok(","):
                        break
            elif self.word("select") or self.word("group"):
                self.expr()
                if self.word("by"):
                    self.expr()
                if self.word("into"):
                    self.name()
                    continue
                return
            else:
                raise Bad

    # ------------------------------------------------------------ statements

    def block(self):
        self.need("{")
        while not self.ok("}"):
            self.statement()

    def condition(self):
        self.need("(")
        self.expr()
        self.need(")")

    def statement(self):
        K, V = self.K, self.V
        t = K[self.p]
        handler = self.STATEMENTS.get(t)
        if handler:
            return handler(self)
        if t == "i":
            w, n = V[self.p], K[self.p + 1]
            if n == ":" and K[self.p + 2] != ":":
                self.p += 2
                return self.statement()
            if w == "yield" and n in ("return", "break"):
                self.p += 1
                return self.statement()
            if w == "await" and n in ("foreach", "using"):
                self.p += 1
                return self.statement()
            if w == "var" and n == "(":
                self.p += 2
                self.listed(self._names, ")")
                self.need("=")
                self.expr()
                return self.need(";")
            if w == "async" and n != "=" and self.tries(self._function_head):
                return self._function()
        if self.tries(self.declared):
            return self.declarators()
        if self.tries(self._function_head):
            return self._function()
        start = self.p
        if not self.counts(self.expr(), start) and not self.is_await(start):
            raise Bad
        self.need(";")

    def _names(self):
        if self.ok("("):
            return self.listed(self._names, ")")
        self.name()

    def is_await(self, start):
        return self.K[start] == "i" and self.V[start] == "await"

    def declared(self):
        if self.K[self.p] == "i" and self.V[self.p] in ("await", "return", "yield") and self.K[self.p + 1] != "=":
            raise Bad
        self.type()
        if self.K[self.p] != "i" or self.K[self.p + 1] not in ("=", ";", ",", "in"):
            raise Bad

    def _function_head(self):
        while self.K[self.p] in ("static", "unsafe", "extern") or self.is_word("async"):
            self.p += 1
        if not self.ok("void"):
            self.type()
        self.name()
        if self.K[self.p] == "<" and self.angle(self.p):
            self.type_params()
        if self.K[self.p] != "(" or self.K[self.ends[self.p] + 1] not in ("{", "=>") and not (self.K[self.ends[self.p] + 1] == "i" and self.V[self.ends[self.p] + 1] == "where"):
            raise Bad

    def _function(self):
        self.params()
        self.constraints()
        self.body()

    def body(self, bodied: bool = True):
        if self.K[self.p] == "{":
            self.block()
        elif self.ok("=>"):
            self.ok("ref")
            self.expr()
            self.need(";")
        elif bodied:
            raise Bad
        else:
            self.need(";")

    def declarators(self):
        while True:
            self.name()
            if self.ok("="):
                self.ok("ref")
                self._array_item()
            if not self.ok(","):
                break
        self.need(";")

    def _block(self):
        self.block()

    def _empty(self):
        self.p += 1

    def _if(self):
        self.p += 1
        self.condition()
        self.embedded()
        if self.ok("else"):
            self.embedded()

    def embedded(self):
        self.statement()

    def _while(self):
        self.p += 1
        self.condition()
        self.embedded()

    def _do(self):
        self.p += 1
        self.embedded()
        self.need("while")
        self.condition()
        self.need(";")

    def _for(self):
        self.p += 1
        self.need("(")
        if not self.ok(";"):
            if self.tries(self.declared):
                self.declarators()
            else:
                self.exprs()
                self.need(";")
        if self.K[self.p] != ";":
            self.expr()
        self.need(";")
        if self.K[self.p] != ")":
            self.exprs()
        self.need(")")
        self.embedded()

    def exprs(self):
        while True:
            start = self.p
            if not self.counts(self.expr(), start) and not self.is_await(start):
                raise Bad
            if not self.ok(","):
                return

    def _foreach(self):
        self.p += 1
        self.need("(")
        if self.is_word("var") and self.K[self.p + 1] == "(":
            self.p += 2
            self.listed(self._names, ")")
        elif self.K[self.p] == "(" and self.K[self.ends[self.p] + 1] == "in":
            self.unary()
        else:
            self.ok("readonly")
            self.type()
            self.name()
        self.need("in")
        self.expr()
        self.need(")")
        self.embedded()

    def _switch(self):
        self.p += 1
        self.need("(")
        self.listed(self.argument, ")", empty=False)
        self.need("{")
        while not self.ok("}"):
            if self.ok("case"):
                self._label()
            else:
                self.need("default")
                self.need(":")
            while self.K[self.p] not in ("case", "}") and not (self.K[self.p] == "default" and self.K[self.p + 1] == ":"):
                self.statement()

    def _label(self):
        at = self.p
        if not self.tries(self._case_pattern):
            self.p = at
            self.expr()
            self.need(":")

    def _case_pattern(self):
        self.pattern()
        if self.word("when"):
            self.guard()
        self.need(":")

    def _try(self):
        self.p += 1
        self.block()
        done = False
        while self.ok("catch"):
            done = True
            if self.ok("("):
                self.type()
                self.ok("i")
                self.need(")")
            if self.word("when"):
                self.condition()
            self.block()
        if self.ok("finally"):
            done = True
            self.block()
        if not done:
            raise Bad

    def _return(self):
        self.p += 1
        if self.K[self.p] != ";":
            self.ok("ref")
            self.expr()
        self.need(";")

    def _throw(self):
        self.p += 1
        if self.K[self.p] != ";":
            self.expr()
        self.need(";")

    def _jump(self):
        self.p += 1
        self.need(";")

    def _goto(self):
        self.p += 1
        if self.ok("case"):
            self.expr()
        elif not self.ok("default"):
            self.name()
        self.need(";")

    def _using(self):
        self.p += 1
        if self.K[self.p] == "(":
            self.p += 1
            self._resource()
            self.need(")")
            return self.embedded()
        if not self.tries(self.declared):
            raise Bad
        self.declarators()

    def _resource(self):
        if self.tries(self.declared):
            while True:
                self.name()
                self.need("=")
                self.expr()
                if not self.ok(","):
                    return
        self.expr()

    def _lock(self):
        self.p += 1
        self.need("(")
        self._resource()
        self.need(")")
        self.embedded()

    def _checked(self):
        if self.K[self.p + 1] == "{":
            self.p += 1
            return self.block()
        self.exprs()
        self.need(";")

    def _const(self):
        self.p += 1
        if not self.tries(self.declared):
            raise Bad
        self.declarators()

    def _attributed(self):
        """A local function's attributes."""
        at = self.p
        if self.tries(self.attributes) and self.tries(self._function_head):
            return self._function()
        self.p = at
        raise Bad

    def _static(self):
        if not self.tries(self._function_head):
            raise Bad
        self._function()

    def _bad(self):
        raise Bad

    STATEMENTS = {
        "{": _block, ";": _empty, "if": _if, "while": _while, "do": _do, "for": _for, "foreach": _foreach, "switch": _switch, "try": _try, "return": _return, "throw": _throw, "break": _jump, "continue": _jump, "goto": _goto, "using": _using, "lock": _lock, "fixed": _lock,
        "checked": _checked, "unchecked": _checked, "unsafe": _checked, "const": _const, "[": _attributed, "static": _static, "void": _static, "else": _bad, "case": _bad, "catch": _bad, "finally": _bad, "class": _bad, "namespace": _bad,
    }

    # ------------------------------------------------------------ declarations

    def params(self, loose: bool = False):
        self.need("(")
        self.listed(self._loose_param if loose else self.param, ")")

    def _loose_param(self):
        if self.K[self.p] == "i" and self.K[self.p + 1] in (",", ")"):
            self.p += 1
        else:
            self.param()

    def param(self):
        self.attributes()
        while self.K[self.p] in ("ref", "out", "in", "params", "this", "readonly") or self.is_word("scoped") and self.K[self.p + 1] in ("i", "ref"):
            self.p += 1
        self.type()
        self.name()
        if self.ok("="):
            self.expr()

    def modifiers(self):
        K = self.K
        while K[self.p] in _MODIFIERS or K[self.p] == "i" and self.V[self.p] in _SOFT and K[self.p + 1] not in ("=", ";", "(", ",", ".", "=>"):
            self.p += 1

    def at_type(self) -> bool:
        K = self.K
        return K[self.p] in ("class", "struct", "interface", "enum", "delegate") or self.is_word("record") and K[self.p + 1] in ("i", "class", "struct") and (K[self.p + 2] in ("(", "{", "<", ":", ";", "i"))

    def type_decl(self):
        K, first = self.K, self.p
        if K[first] == "delegate":
            return self._type_decl()
        name = first + 1 + (K[first] == "i" and K[first + 1] in ("class", "struct"))
        self.opens(self.V[name])
        self._type_decl()
        self.closes("type", name, first)

    def _type_decl(self):
        K = self.K
        t = K[self.p]
        self.p += 1
        if t == "delegate":
            if not self.ok("void"):
                self.type()
            self.name()
            if K[self.p] == "<":
                self.type_params()
            self.params()
            self.constraints()
            return self.need(";")
        if t == "i" and not self.ok("class"):
            self.ok("struct")
        self.name()
        if t == "enum":
            if self.ok(":"):
                self.type()
            self.need("{")
            self.listed(self._enumerated, "}", ",", True)
            self.ok(";")
            return
        if K[self.p] == "<":
            self.type_params()
        if K[self.p] == "(":
            self.params()
        if self.ok(":"):
            while True:
                base = last = self.p
                while K[last + 1] == "." and K[last + 2] == "i":
                    last += 2
                self.type()
                self.found.append(("inherits", last, base, last, ".".join(self.inside_of)))
                if K[self.p] == "(":
                    self.args()
                if not self.ok(","):
                    break
        self.constraints()
        if self.ok(";"):
            return
        self.need("{")
        while not self.ok("}"):
            self.member()
        self.ok(";")

    def _enumerated(self):
        self.attributes()
        self.name()
        if self.ok("="):
            self.expr()

    def member(self):
        K = self.K
        self.attributes()
        start = self.p
        self.modifiers()
        if self.at_type():
            return self.type_decl()
        t = K[self.p]
        if t == "~" or t == "i" and K[self.p + 1] == "(":
            self.ok("~")
            name = self.p
            self.opens(self.V[name])
            self.name()
            self.params()
            if self.ok(":"):
                if not self.ok("base"):
                    self.need("this")
                if K[self.p] != "(":
                    raise Bad
                self.args()
            self.body(False)
            return self.closes("callable", name, start)
        if t in ("implicit", "explicit"):
            self.p += 1
            self.need("operator")
            self.type()
            self.params()
            return self.body(False)
        if self.ok("event"):
            self.type()
            if K[self.p + 1] in ("=", ";", ","):
                return self.declarators()
            self.member_name()
            return self.accessors()
        if not self.ok("void") or K[self.p] == "*":
            if K[self.p - 1] == "void":
                self.p -= 1
            self.type()
        if self.ok("operator"):
            if K[self.p] not in _OVERLOADS:
                raise Bad
            while K[self.p] == ">" and self.V[self.p] == ">>":
                self.p += 1
            self.p += 1
            self.params()
            return self.body(False)
        if K[self.p] == "this" or K[self.p] == "i" and K[self.p + 1] == "." and self._indexer():
            while not self.ok("this"):
                self.p += 1
            self.need("[")
            self.listed(self.param, "]", empty=False)
            return self.accessors()
        if K[self.p] == "i" and K[self.p + 1] in ("=", ";", ",", "["):
            if K[self.p + 1] == "[":
                self.p += 1
                self.need("[")
                self.expr()
                self.need("]")
                return self.need(";")
            return self.declarators()
        self.member_name()
        if K[self.p] in ("{", "=>"):
            return self.accessors()
        name = self.p - 1
        while K[name] != "i":
            name -= 1
        if K[self.p - 1] == ">":
            depth = 0
            for name in range(self.p - 1, 0, -1):
                depth += (K[name] == ">") - (K[name] == "<")
                if not depth:
                    break
            name -= 1
        self.opens(self.V[name])
        self.params()
        self.constraints()
        self.body(False)
        self.closes("callable", name, start)

    def _indexer(self) -> bool:
        k = self.p
        while self.K[k] == "i" and self.K[k + 1] == ".":
            k += 2
        return self.K[k] == "this"

    def member_name(self):
        """A name, after an interface's name or not, with type parameters or not."""
        K = self.K
        self.name()
        while True:
            if K[self.p] == "<":
                if not self.tries(self.type_params):
                    self.type_args()
            if K[self.p] == ".":
                self.p += 1
                self.name()
            else:
                return

    def accessors(self):
        if self.ok("=>"):
            self.ok("ref")
            self.expr()
            return self.need(";")
        self.need("{")
        while not self.ok("}"):
            self.attributes()
            self.modifiers()
            if not (self.word("get") or self.word("set") or self.word("init") or self.word("add") or self.word("remove")):
                raise Bad
            self.body(False)
        if self.ok("="):
            self._array_item()
            self.need(";")

    def usings(self):
        K = self.K
        while K[self.p] == "using" and K[self.p + 1] != "(" or self.is_word("global") and K[self.p + 1] == "using" or K[self.p] == "extern" and self.is_word("alias", 1):
            if self.ok("extern"):
                self.p += 1
                self.name()
                self.need(";")
                continue
            at = self.p
            self.word("global")
            self.p += 1
            if self.ok("static"):
                self.named()
            elif K[self.p] == "i" and K[self.p + 1] == "=":
                self.p += 2
                self.type()
            else:
                first = self.p
                self.dotted()
                if K[self.p] != ";":
                    self.p = at
                    return
                self.found.append(("import", self.p - 1, first, self.p - 1, "*"))
            self.need(";")

    def top(self):
        self.space("")

    def space(self, until: str):
        K = self.K
        self.usings()
        while K[self.p] == "[" and K[self.p + 1] == "i" and self.V[self.p + 1] in ("assembly", "module") and K[self.p + 2] == ":":
            end = self.ends[self.p]
            self.attributes_once()
            if self.p != end + 1:
                raise Bad
        while K[self.p] != until:
            if not K[self.p]:
                raise Bad
            if self.ok("namespace"):
                self.dotted()
                if self.ok(";"):
                    self.usings()
                    continue
                self.need("{")
                self.space("}")
                self.need("}")
                self.ok(";")
                continue
            at = self.p
            self.attributes()
            self.modifiers()
            if self.at_type():
                self.type_decl()
            elif until:
                raise Bad
            else:
                self.p = at
                self.statement()

    def attributes_once(self):
        self.need("[")
        self.p += 2
        self.listed(self._attribute, "]", ",", True, False)

    def hole(self):
        self.expr()
        if self.ok(","):
            self.expr()
