"""Which places of a LaTeX text are no prose, and where its flow is broken."""

from __future__ import annotations

import re

#: Environments whose content is formula, code or bibliography.
OPAQUE = frozenset(
    "math displaymath equation equation* align align* alignat alignat* eqnarray eqnarray* gather gather* multline multline* flalign flalign* "
    "array tikzpicture verbatim lstlisting thebibliography filecontents filecontents* comment".split()
)
#: Environments that take an argument which is no prose.
WITH_ARGUMENT = frozenset("otherlanguage otherlanguage* tabular tabular* tabularx minipage wrapfigure multicols list".split())
#: Commands, with the number of technical arguments after them; further arguments are prose.
TECHNICAL = {
    **dict.fromkeys(
        "cite citep citet citealp citeauthor citeyear nocite ref eqref pageref autoref cref Cref label input include subfile includegraphics usepackage "
        "RequirePackage documentclass documentstyle bibliography bibliographystyle bibitem url selectlanguage foreignlanguage pagestyle thispagestyle vspace vspace* "
        "hspace hspace* color textcolor href hypersetup graphicspath hyphenation inputenc fontsize linespread addbibresource theoremstyle pagenumbering".split(),
        1,
    ),
    **dict.fromkeys("setlength addtolength setcounter addtocounter newtheorem newtheorem* DeclareMathOperator DeclareMathOperator* newlength rule".split(), 2),
    **dict.fromkeys("newcommand newcommand* renewcommand renewcommand* providecommand providecommand* let".split(), 2),
    **dict.fromkeys("newenvironment newenvironment* renewenvironment".split(), 3),
}
#: Commands whose argument starts a flow of its own.
ASIDE = frozenset("footnote footnotetext thanks caption title author date section section* subsection subsection* subsubsection chapter paragraph marginpar item".split())

TOKEN = re.compile(r"%[^\n]*|\\[a-zA-Z]+\*?|\\.|\$\$?|[{}]|\n[ \t\r]*\n", re.S)
FORMULA = re.compile(r"\\.|\$\$?|\n[ \t\r]*\n", re.S)
CLOSING = {c: re.compile(re.escape(c) + r"|\n[ \t\r]*\n") for c in (r"\)", r"\]")}
BODY = re.compile(r"\{|\n[ \t\r]*\n")
GAP = re.compile(r"[ \t]*")
WITHIN = {o: re.compile(r"\\.|%[^\n]*|\n[ \t\r]*\n|[" + re.escape(o + c) + "]", re.S) for o, c in ("{}", "[]")}
STAR = re.compile(r"\\[a-zA-Z@]+|\\.", re.S)


def _group(text: str, at: int, opening: str, closing: str) -> int:
    """End of the balanced group that opens at ``at``; the end of its paragraph if it isn't closed."""
    depth = 0
    for match in WITHIN[opening].finditer(text, at):
        token = match.group()
        if token == opening:
            depth += 1
        elif token == closing:
            depth -= 1
            if not depth:
                return match.end()
        elif token[0] == "\n":
            return match.start()
    return len(text)


def _options(text: str, at: int) -> int:
    """Past the bracketed options at ``at``."""
    while at < len(text) and text[at] == "[":
        at = _group(text, at, "[", "]")
    return at


def _arguments(text: str, at: int, count: int) -> int:
    """Past up to ``count`` technical arguments, each a group or a command, with options between."""
    for _ in range(count):
        at = _options(text, at)
        place = GAP.match(text, at).end()
        if place < len(text) and text[place] == "{":
            at = _group(text, place, "{", "}")
        elif place < len(text) and text[place] == "\\" and (name := STAR.match(text, place)):
            at = name.end()
        else:
            break
    return at


def not_prose(text: str) -> tuple[list[int], list[int], list[int]]:
    """(begins, ends, breaks): the stretches that are comment, formula, bibliography or command with its technical
    arguments, in order and not overlapping, and the places where another flow of text begins or ends."""
    begins: list[int] = []
    ends: list[int] = []
    breaks: list[int] = []
    asides: list[int] = []  # depths of open braces at which an aside ends
    depth = 0
    at = 0
    clear = 0  # no brace opens before this place
    search = TOKEN.search

    while match := search(text, at):
        start, at = match.span()
        token = text[start:at]
        sign = token[0]
        if sign == "{":
            depth += 1
            continue
        if sign == "}":
            if asides and asides[-1] == depth:
                asides.pop()
                breaks.append(start)
            depth = max(0, depth - 1)
            continue
        if sign == "\n":
            breaks.append(start)
            at -= 1  # the last line end may begin another break
            continue
        if sign == "%":
            pass
        elif sign == "$":
            at = _formula(text, at, token)
        elif token in (r"\(", r"\["):
            at = _closed(text, at, r"\)" if token == r"\(" else r"\]")
        elif token[1:2].isalpha():
            name = token[1:]
            if name in ("begin", "end"):
                breaks.append(start)
                close = _arguments(text, at, 1)
                environment = text[at:close].strip().strip("{}").strip()
                at = _options(text, close)
                if name == "begin" and environment in OPAQUE:
                    stop = text.find("\\end{" + environment + "}", at)
                    at = len(text) if stop < 0 else stop
                elif name == "begin" and environment in WITH_ARGUMENT:
                    at = _arguments(text, at, 1)
            elif name == "def":
                if at >= clear:  # past the macro's name and parameters; a body is sought within the paragraph
                    body = BODY.search(text, at)
                    clear = len(text) if not body else body.start() if body.group() != "{" else at
                    at = _group(text, body.start(), "{", "}") if body and body.group() == "{" else at
            elif name in ASIDE:
                breaks.append(start)
                at = _options(text, at)
                if at < len(text) and text[at] == "{":
                    depth += 1
                    asides.append(depth)
                    at += 1
            elif name in TECHNICAL:
                at = _options(text, _arguments(text, at, TECHNICAL[name]))
            else:
                at = _options(text, at)
        begins.append(start)
        ends.append(at)
    return begins, ends, breaks


def _formula(text: str, at: int, sign: str) -> int:
    """Past the formula that ``sign`` opened before ``at``; it ends with its paragraph at the latest."""
    for match in FORMULA.finditer(text, at):
        token = match.group()
        if token[0] == "$":
            return match.end() if token == sign or sign == "$$" else match.start() + 1
        if token[0] == "\n":
            return match.start()
    return len(text)


def _closed(text: str, at: int, closing: str) -> int:
    """Past ``closing``; a formula that isn't closed ends with its paragraph."""
    match = CLOSING[closing].search(text, at)
    return len(text) if not match else match.end() if match.group() == closing else match.start()
