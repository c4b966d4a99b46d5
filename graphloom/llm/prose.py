"""The prose of a document: text without code, tables, links, markup, logs and front matter, and its language."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n(?s:.*?)(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", re.M)
_HTML = re.compile(r"<!--(?s:.*?)-->|<(script|style|pre|code)\b(?s:.*?)</\1\s*>|</?[A-Za-z][^<>\n]*>")
_IMAGE_OR_LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"\n]*\")?\)")
_REFERENCE = re.compile(r"^[ \t]*\[[^\]\n]+\]:[^\n]*$", re.M)
_URL = re.compile(r"(?:https?|ftp)://\S+|\bwww\.\S+")
_MAIL = re.compile(r"(?<!\S)\S+@\S+\.\w{2,}")
_CODE_SPAN = re.compile(r"(`+)(?!`)[^\n]*?[^`]\1(?!`)|`[^`\n]*`")
_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t][^\n]*$|^[^\n]*\n[ \t]*(?:={3,}|-{3,})[ \t]*$", re.M)
_TABLE = re.compile(r"^[ \t]*\|.*$|^[^\n|]*\|[^\n|]*\|[^\n]*$", re.M)
_BULLET = re.compile(r"^[ \t]*(?:[-*+•]|\d{1,3}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?|^[ \t]*(?:>[ \t]?)+", re.M)
_LOG = re.compile(r"^(?:\W*\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\W*\d\d:\d\d:\d\d|\W*(?:DEBUG|INFO|WARN(?:ING)?|ERROR|TRACE|FATAL)\b.*\w=)[^\n]*$", re.M)
_INDENTED = re.compile(r"(?:(?:^|\n)[ \t]*\n|\A)((?:(?: {4}|\t)[^\n]*(?:\n|\Z))+)")
_CODE_LINE = re.compile(
    r"^[ \t]*(?:[{}()\[\];]+[,;]?|(?:import|from|package|using|use|include|#include|export|public|private|protected|static|const|let|var|def|async def|class|func|fn|fun|return|pub|namespace|@\w+|elif|else:)\b[^\n]*|[^\n]*[;{}][ \t]*|[^\n]*(?:[-=]>|:=|==|\+=|&&|\|\|)[^\n]*|[\w.\[\]]+ = [^\n]*|(?:if|for|while|else|elif)\b[^\n]*[:{][ \t]*|//[^\n]*|/?\*+/?[^\n]*;|\$ [^\n]*|\"{3}[^\n]*)$",
    re.M,
)
#: Lines that are code wherever they stand, and the marks that show it on the others.
_SURE_CODE = re.compile(r"[ \t]*(?:[{}()\[\];]+[,;]?[ \t]*$|//|\$ |\"{3}|/?\*+/?[^\n]*;|#include\b)")
_CODE_MARK = re.compile(r"[^\W\d]\w*[(\[]|[=<>{}]|::|[^\W\d]\w+\.[^\W\d]\w+|&&|\|\||^[ \t]*@\w|^[ \t]*(?:import|from|include|use|export)\s+[\"'][^\"'\n]+[\"'];?[ \t]*$|^[ \t]*from\s+[\w.]+\s+import\b|^[ \t]*import\s+\w+\s+as\s+\w+[ \t]*$")
_BARE_IMPORT = re.compile(r"[ \t]*(?:import|package|using|use|include|namespace)[ \t]+\w+[ \t]*$")
_OPERATOR = re.compile(r"[-=]>|:=|[={}]|&&|\|\||\w\(")
_QUOTED = re.compile(r"\"[^\"\n]*\"|(?<!\w)'[^'\n]*'(?!\w)|[ \t](?:#|//)[ \t].*$")
_PLAIN = re.compile(r"[\"'“‘(\[]*[^\W\d_](?:[^\W_]|['’-])*[\"'”’)\].,;:!?…]*")
_EMPHASIS = re.compile(r"\*\*|__|~~|[*_](?:(?<!\w[*_])(?=\w)|(?<=\w[*_])(?!\w))")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LETTER = re.compile(r"[^\W\d_]")
_BLANK_LINES = re.compile(r"\n[ \t]*\n")
#: The same for texts in ASCII and lower case, for which smaller classes do.
_ASCII_WORD, _ASCII_LETTER, _ASCII_END = re.compile(r"[a-z]+(?:['-][a-z]+)*"), re.compile(r"[a-z]"), re.compile(r"[.!?\x00](?:[.!?]*[\"')\]]*(?=[\s\x00]|$)|(?<=\x00))")
#: A line that looks like code holds one of these signs, begins so or ends with a colon; only such lines meet _CODE_LINE.
_HINT = re.compile(r"[;{}=&|>]")
_HINT_FIRST = re.compile(r"[ \t]*(?:[()\[\]\"/$@*]|#include\b|(?:import|from|package|using|use|include|export|public|private|protected|static|const|let|var|def|async|class|func|fn|fun|return|pub|namespace|elif|else)\b)")
#: Abbreviations whose full stop ends no sentence, at the end of what stands before it.
_ABBREVIATED = re.compile(r"(?i)(?:^|[\s(\[])(?:e\.\s?g|i\.\s?e|cf|viz|etc|vs|fig|sec|def|thm|eq|no|vol|pp?|ch|approx|resp|dr|mr|mrs|ms|st|al|[a-z])$")
_ASIDE = re.compile(r"\((?:e\.\s?g\.|i\.\s?e\.|cf\.|viz\.|see\b)[^()\n\x00]*\)")
#: A sentence ends with its mark, or with its block, which a null sign closes.
_END = re.compile(r"[.!?…\x00](?:[.!?…]*[\"'”’)\]]*(?=[\s\x00]|$)|(?<=\x00))")
#: The commonest function words of English and of languages that are told from it.
_ENGLISH = frozenset("the a an of and to in is it that this be are was for with on as by or not from at which its but has have will can you we they their each if so than then no when what how do does only any some such may should who while where after before all one two use these those there into over under between until unless because since although".split())
_FOREIGN = frozenset(
    "der die das und ist ein eine nicht mit den dem des im auf für sich wird werden wenn bitte sie wir zu von bei oder auch nach le la les des une est et dans pour que qui sur avec pas ne vous nous il elle ce cette sont par au aux du el los las un una es y en por para con no que se del su como pero más il lo gli che di e è per non con una sono de het een van niet zijn met voor op o os um uma não com são não".split()
) - _ENGLISH
#: Function words that are no words of code.
_TELLING = _ENGLISH - frozenset("a and or not is in as for from if then while with use do this".split())


def _reads(line: str) -> bool:
    """Whether a line that looks like code is a line of English: mostly plain words, with function words or many of them."""
    said = _QUOTED.sub(" ", line)
    tokens = said.split()
    plain = [x for x in tokens if _PLAIN.fullmatch(x)]
    if len(plain) < 3 or len(plain) < 0.7 * len(tokens):
        return False
    telling = sum(_WORD.search(x)[0].lower() in _TELLING for x in plain)
    return telling >= 2 or (telling == 1 or len(plain) >= 6) and not _OPERATOR.search(said)


def code_lines(lines: list[str], known: dict[str, bool] | None = None) -> set[int]:
    """Which lines are code: those with code punctuation that do not read as English, and such as lead with a mere keyword
    beside them or in a paragraph of their own kind; never a line of a paragraph whose neighbours are prose.

    `known` keeps which lines look like code, for texts whose lines are judged more than once.
    """
    code, runs = set(), []
    known = {} if known is None else known
    for k, line in enumerate(lines):
        looks = known.get(line)
        if looks is None:
            looks = known[line] = bool((_HINT.search(line) or _HINT_FIRST.match(line) or line.rstrip().endswith(":")) and _CODE_LINE.match(line))
        if not looks:
            continue
        if _SURE_CODE.match(line):
            code.add(k)
        elif not _reads(line):
            if _CODE_MARK.search(_QUOTED.sub(lambda m: m[0] if m[0][0] in "\"'" else "", line)):
                code.add(k)
            elif runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
    if runs:
        filled = [k for k, line in enumerate(lines) if line.strip()]
        place = {k: i for i, k in enumerate(filled)}
    for run in runs + runs[::-1]:
        before = filled[place[run[0]] - 1] if place[run[0]] else None
        after = filled[place[run[-1]] + 1] if place[run[-1]] + 1 < len(filled) else None
        alone = before != run[0] - 1 and after != run[-1] + 1
        near = before in code or after in code
        if run[0] - 1 in code or run[-1] + 1 in code or alone and (len(run) > 1 or near and _BARE_IMPORT.match(lines[run[0]])):
            code.update(run)
    return code


def unfenced(text: str) -> str:
    """One kind of line ends, without fenced code."""
    text = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    return _FENCE.sub("\n\n", text) if "```" in text or "~~~" in text else text


def strip_markup(text: str, known: dict[str, bool] | None = None) -> str:
    """The running text of an unfenced text, one paragraph or list item a line. Expressions run only where they can match."""
    if "<" in text:
        text = _HTML.sub(" ", text)
    if "\n    " in text or "\n\t" in text or text.startswith(("    ", "\t")):
        text = _INDENTED.sub("\n\n", text)
    text = _LOG.sub("", text)
    if "|" in text:
        text = _TABLE.sub("", text)
    if "#" in text or "---" in text or "===" in text:
        text = _HEADING.sub("\n", text)
    if "]:" in text:
        text = _REFERENCE.sub("", text)
    if "[" in text:
        text = _IMAGE_OR_LINK.sub(r"\1", text)
    if "://" in text or "www." in text:
        text = _URL.sub(" ", text)
    if "@" in text:
        text = _MAIL.sub(" ", text)
    if "`" in text:
        text = _CODE_SPAN.sub(" ", text)
    text = _BULLET.sub("\n\n", text)
    lines = text.split("\n")
    if code := code_lines(lines, known):
        text = "\n".join("" if k in code else line for k, line in enumerate(lines))
    return _EMPHASIS.sub("", text) if "*" in text or "_" in text or "~~" in text else text


def words_and_sentences(running: str) -> tuple[list[str], int]:
    """The words of running text in lower case, and its number of sentences; an unfinished list item or paragraph is one too."""
    blocks = (" ".join(block.split()) for block in _BLANK_LINES.split(running.lower()))
    text = "\x00".join(filter(None, blocks))
    if "(" in text:
        text = _ASIDE.sub(" ", text)
    word, letter, end = (_ASCII_WORD, _ASCII_LETTER, _ASCII_END) if text.isascii() else (_WORD, _LETTER, _END)
    n = start = 0
    for m in end.finditer(text):
        at = m.start()
        if m[0] == "." and text[at - 1 : at].isalpha() and _ABBREVIATED.search(text, max(start, at - 8), at):
            continue
        if letter.search(text, start, at):
            n += 1
        start = m.end()
    if letter.search(text, start):
        n += 1
    return word.findall(text), n


#: Endings by which English shows where function words are few.
_ENDINGS = re.compile(r"(?:tion|tions|ness|ment|ments|ity|ities|ing|ous|ical|ally|able|ible|ship|ward|less|ence|ance|ency|ancy|ism|ed|ly|es|al|ic|ive|ary|ate|ates|sis|thm|thms)$")


def is_english(counts: dict[str, int]) -> bool:
    """Whether marks of English (function words, and half as much endings) are as many as in prose and outnumber foreign ones."""
    total = sum(counts.values())
    least = sum(map(counts.get, _ENGLISH & counts.keys()))  # function words alone decide most texts
    if total and least >= 0.15 * total and least > 2 * sum(map(counts.get, _FOREIGN & counts.keys())) and all(map(str.isascii, counts)):
        return True
    ours = others = letters = 0.0
    for w, n in counts.items():
        a, b, c = _marks(w)
        ours, others, letters = ours + a * n, others + b * n, letters + c * n
    return total > 0 and ours >= 0.15 * total and ours > 2 * others and letters <= 0.15 * total


@lru_cache(1 << 16)
def _marks(word: str) -> tuple[float, int, int]:
    """How much a word marks English, whether it marks another language, whether it has letters beyond ASCII."""
    low = word.lower()
    ours, others = low in _ENGLISH, low in _FOREIGN
    return (1.0 if ours else 0.5 if not others and _ENDINGS.search(low) else 0.0), int(others), int(not low.isascii())


def is_source(unfenced_text: str, known: dict[str, bool] | None = None) -> bool:
    """Whether a text is a source file or a log rather than a document with some: a fifth of the lines outside fences."""
    lines = unfenced_text.split("\n")
    code = code_lines(lines, known)
    logs = _LOG.search(unfenced_text) is not None
    marked = len(code) + (sum(k not in code and _LOG.match(x) is not None for k, x in enumerate(lines)) if logs else 0)
    return marked >= 3 and marked >= 0.2 * sum(1 for x in lines if x and not x.isspace())


def prose_counts(text: str | None, least: int) -> tuple[dict[str, int], int] | None:
    """How often each word stands in a document with at least so many words of English prose, and its number of sentences;
    None for any other text."""
    if not text:
        return None
    body, known = unfenced(text), {}
    if is_source(body, known):
        return None
    words, n = words_and_sentences(strip_markup(body, known))
    if len(words) < least:
        return None
    counts = Counter(words)
    return (counts, n) if is_english(counts) else None
