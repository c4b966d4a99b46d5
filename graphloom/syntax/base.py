"""What the parsers share: a cursor over tokens, brackets matched in advance, expressions as operands and operators.

The parsers are predictive: which construct begins is decided by looking ahead over tokens, brackets are skipped by the
table of their ends, and angle brackets by a scan that judges each of them once. So a text of n tokens costs O(n), and a
text of another language fails at its first foreign token. Precedence is not needed to tell valid from invalid, so an
expression is a sequence of operands joined by operators; only assignments look back at what they assign to.
"""

from __future__ import annotations

from graphloom.syntax.lexing import Bad, Lexer, Tokens

PLAIN, JOINED, ASSIGNED = 0, 1, 2
ASSIGN = frozenset(["=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", "&&=", "||=", "??=", "**=", "&^="])
BINARY = frozenset(["+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "==", "!=", "<", ">", "<=", ">=", "<<"])
CLOSES = {"(": ")", "[": "]", "{": "}"}


class Parser:
    """One text of one language; `parse` raises Bad unless the whole of it is valid."""

    LANGUAGE = ""
    PREFIX = frozenset(["!", "~", "+", "-", "++", "--"])
    BINARY = BINARY
    ASSIGN = ASSIGN
    #: Kinds that may stand between the angle brackets of type arguments.
    ANGLED = frozenset(["i", "prim", ",", ".", "?", "&", "[", "(", "::", "*", "n", "s"])
    #: Kinds that cannot be assigned to.
    NO_TARGET = frozenset(["n", "s", "++", "--"])
    TERNARY = True
    #: Angle brackets of the longest shift.
    SHIFT = 2

    def __init__(self, tokens: Tokens):
        self.K, self.V, self.N = tokens.kinds, tokens.words, tokens.fresh
        self.p = self.far = 0
        self.ends = self._brackets()
        self.angles: dict[int, int] = {}
        #: What a walker wants to know, in the order of its end: (kind, name token, first token, last token, container).
        self.found: list[tuple[str, int, int, int, str]] = []
        self.inside_of: list[str] = []

    # ------------------------------------------------------------ facts

    def opens(self, name: str) -> None:
        """What is defined from here on is contained in this name."""
        self.inside_of.append(name)

    def closes(self, kind: str, name: int, first: int) -> None:
        """The definition of the innermost name ends with the last token read."""
        own = self.inside_of.pop()
        self.found.append((kind, name, first, self.p - 1, ".".join([*self.inside_of, own])))

    def calls(self) -> None:
        """A call of the dotted name that has just been read, its opening parenthesis being next."""
        K, q = self.K, self.p - 1
        if K[q] != "i":
            return
        while K[q - 1] in (".", "::", "?.", "->") and K[q - 2] in ("i", "this", "self", "Self", "super", "crate"):
            q -= 2
        if K[q - 1] in (".", "?.", "->", "::") or K[q - 1] in ("func", "fn", "fun", "function", "new") and K[q - 1] != "new":
            return
        self.found.append(("call", self.p - 1, q, self.p - 1, ".".join(self.inside_of)))

    def _brackets(self) -> dict[int, int]:
        ends, stack = {}, []
        for k, t in enumerate(self.K):
            if t in ("(", "[", "{"):
                stack.append(k)
            elif t in (")", "]", "}"):
                if not stack or CLOSES[self.K[stack[-1]]] != t:
                    raise Bad
                ends[stack.pop()] = k
        if stack:
            raise Bad
        return ends

    # ------------------------------------------------------------ cursor

    def need(self, kind: str) -> None:
        if self.K[self.p] != kind:
            raise Bad
        self.p += 1

    def ok(self, kind: str) -> bool:
        if self.K[self.p] == kind:
            self.p += 1
            return True
        return False

    def word(self, spelling: str) -> bool:
        """A name with a meaning of its own in this place."""
        if self.K[self.p] == "i" and self.V[self.p] == spelling:
            self.p += 1
            return True
        return False

    def is_word(self, spelling: str, ahead: int = 0) -> bool:
        return self.K[self.p + ahead] == "i" and self.V[self.p + ahead] == spelling

    def name(self) -> None:
        if self.K[self.p] != "i":
            raise Bad
        self.p += 1

    def dotted(self, by: str = ".") -> None:
        self.name()
        while self.K[self.p] == by and self.K[self.p + 1] == "i":
            self.p += 2

    def listed(self, item, close: str, sep: str = ",", trailing: bool = False, empty: bool = True) -> None:
        """Items between separators up to and with the closing kind; the opening one has been read."""
        if self.ok(close):
            if not empty:
                raise Bad
            return
        while True:
            item()
            if self.ok(close):
                return
            self.need(sep)
            if trailing and self.ok(close):
                return

    def tries(self, f, *args) -> bool:
        """Whether f succeeds from here; if not, nothing was read. Only for short constructs without bodies."""
        at, known, depth = self.p, len(self.found), len(self.inside_of)
        try:
            f(*args)
            return True
        except Bad:
            if self.p > self.far:
                self.far = self.p
            self.p = at
            del self.found[known:], self.inside_of[depth:]
            return False

    def angle(self, at: int) -> int:
        """Index after the bracket that closes the angle bracket at `at` if only what types hold lies between; else 0."""
        if (known := self.angles.get(at)) is not None:
            return known
        K, stack, k = self.K, [], at
        while True:
            t = K[k]
            if t == "<":
                if k in self.angles and k != at and not self.angles[k]:
                    break
                stack.append(k)
            elif t == ">":
                self.angles[stack.pop()] = k + 1
                if not stack:
                    return k + 1
            elif t in ("(", "[", "{") and t in self.ANGLED:
                k = self.ends[k]
            elif t not in self.ANGLED:
                break
            k += 1
        for s in stack:
            self.angles[s] = 0
        return 0

    # ------------------------------------------------------------ expressions

    def expr(self) -> int:
        """Operands joined by operators; PLAIN for a single operand, JOINED, or ASSIGNED if it assigns."""
        K = self.K
        form, plain = PLAIN, True
        binary, assign = self.BINARY, self.ASSIGN
        while True:
            self.unary()
            t = K[self.p]
            if t in binary:
                if t == ">" and self.V[self.p] == ">>":
                    if not self._shifts():
                        if not plain:
                            raise Bad
                        form = ASSIGNED
                        continue
                else:
                    self.p += 1
                form, plain = max(form, JOINED), False
            elif t in assign:
                if not plain or not self.assignable():
                    raise Bad
                form = ASSIGNED
                self.p += 1
            elif t == "?" and self.TERNARY:
                self.p += 1
                self.middle()
                self.need(":")
                form, plain = max(form, JOINED), True
            else:
                more = self.joint(t)
                if not more:
                    return form
                form = max(form, JOINED)
                plain = False
                if more == 2 and not self._joined_on():
                    return form

    def _shifts(self) -> bool:
        """The signs of a shift, read from single angle brackets; False if it assigns."""
        n = 1
        while self.V[self.p] == ">>" and self.K[self.p] == ">":
            self.p += 1
            n += self.K[self.p] == ">"
        if n > self.SHIFT:
            raise Bad
        if self.K[self.p] == ">":
            self.p += 1
            return True
        if self.K[self.p] == ">=":
            self.p += 1
            return False
        raise Bad

    def _joined_on(self) -> bool:
        """After an operator whose right side is a type: another operator goes on, anything else ends the expression."""
        while True:
            t = self.K[self.p]
            if t in self.BINARY:
                if t == ">" and self.V[self.p] == ">>":
                    self._shifts()
                else:
                    self.p += 1
                return True
            if t == "?" and self.TERNARY:
                self.p += 1
                self.middle()
                self.need(":")
                return True
            more = self.joint(t)
            if more == 1:
                return True
            if not more:
                return False

    def joint(self, kind: str) -> int:
        """Read further operators: 1 if an operand follows, 2 if the right side has been read, 0 if there is none."""
        return 0

    def middle(self) -> None:
        self.expr()

    def assignable(self) -> bool:
        return self.K[self.p - 1] not in self.NO_TARGET

    def unary(self) -> None:
        raise NotImplementedError

    def counts(self, form: int, start: int) -> bool:
        """Whether an expression may stand as a statement: it assigns, calls, counts or creates."""
        return form == ASSIGNED or self.K[start] in ("++", "--") or form == PLAIN and self.K[self.p - 1] in (")", "++", "--", "}")

    # ------------------------------------------------------------ whole texts

    @staticmethod
    def begins(kinds: list[str], words: list[str], fresh: list[bool]) -> bool:
        """Whether a valid text may begin with these two tokens; never false for one that is."""
        return True

    def parse(self) -> None:
        self.top()
        if self.p != len(self.K) - 4:
            raise Bad

    def top(self) -> None:
        raise NotImplementedError

    def hole(self) -> None:
        """The expression of a hole in a literal."""
        self.expr()

    def parse_hole(self) -> None:
        self.hole()
        if self.p != len(self.K) - 4:
            raise Bad


#: Tokens after which the opening of a foreign text is judged first, and the kinds that a parser may look ahead.
OPENING, AHEAD = 8, 5


def refused(parser: type[Parser], lexer: Lexer, text: str) -> bool:
    """Whether the text's first statements show already that it is not of the language.

    The opening ends at a semicolon or closing brace outside all brackets, where every look ahead ends too. Only an error
    that lies, with all alternatives that were tried, well before that end counts: what follows cannot mend it.
    """
    p = None
    try:
        first = lexer.first(text)
        if first.kinds[0] and not parser.begins(first.kinds, first.words, first.fresh):
            return True
        tokens, whole = lexer.opening(text, OPENING)
        p = parser(tokens)
        p.parse()
    except Bad:
        return p is None or not whole and max(p.p, p.far) < len(p.K) - 4 - AHEAD
    except (RecursionError, IndexError):
        pass
    return False


def valid(parser: type[Parser], lexer: Lexer, text: str) -> bool:
    try:
        tokens, holes = lexer.run(text)
        parser(tokens).parse()
        for h in holes:
            parser(h).parse_hole()
        return True
    except (Bad, RecursionError, IndexError):  # a look ahead past the end finds nothing valid there
        return False
