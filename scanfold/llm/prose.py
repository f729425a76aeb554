"""English prose in mixed documents: which lines are prose, where sentences end, what their words are."""

from __future__ import annotations

import re

# The commonest words that carry English grammar, and those of neighbouring languages that aren't English words.
ENGLISH = frozenset(
    "the a an and or but if of to in on at by for with from as is are was were be been it its this that these those you your we our they their he his she her i my me not no do does did "
    "can could will would should must may might have has had when while because although so which who what whose where than then there here too also only now all any each every some such "
    "into upon over under after before until unless since once".split()
)
OTHER = frozenset(
    "le la les des du une un et est dans pour que qui sur avec par sans au aux ce cette ces el los las del una y en con por para sin se su al lo es como der die das den dem ein eine einen "
    "einer und ist nicht mit von zu im auf für ohne nach jede jeden jeder il gli di della che per non sono o os as uma do da em na no het een van op te".split()
) - ENGLISH - {"do", "no", "as"}
ABBREVIATIONS = frozenset("e.g i.e approx no vs etc cf fig al dr mr mrs ms st inc ltd co dept est resp ca p pp vol sec eq ref".split())

MANY = 2  # sentence ends by which a line is a paragraph

_break = re.compile(r"\r\n|\r|\n| | |\x85")
_fence = re.compile(r"^\s*(?:```|~~~)")
_bullet = re.compile(r"^\s*(?:[*+•‣–-]|\d{1,3}[.)]|[a-z][.)]|>+|//+|#(?=\s[a-z])|/\*+|\*/|<!--|--)\s+")
_heading = re.compile(r"^\s{0,3}#{1,6}\s")
_codeish = re.compile(r"[{}<>=\[\]|\\`$@~^]|\w\(|\);|::|->|&&|https?://|www\.|\w/\w+/\w|^\s*[\w.-]+:\s*\S*$|^\s*[\w-]+:\s|\w;\s*$|\w_\w")
_signs = re.compile(r"[{}<>=\[\]|\\`$@~^_(:;/&]|->|www\.")
_span = re.compile(r"`[^`]*`|\]\([^)\s]*\)|\[(?=[^\]]*\]\()|(?:https?://|www\.)\S*[\w/]")
_item = re.compile(r"\bv\d+(?:\.\d+)+\s*$")
_word = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+(?:['’-][A-Za-zÀ-ÖØ-öø-ÿ]+)*")
_stop = re.compile(r"[.!?]+[\"')\]”’]*(?=\s|$)")
_joined = re.compile(r"[,;]\s+(?:and|or|but)\s+(?=[A-Z][a-z]*\s)|(?:;|\s[–—-])\s+(?=[A-Z][a-z]*\s)")


def _without_code(paragraph: str) -> str:
    """The sentences of a paragraph on one line that hold no code, once its code spans and links are taken out."""
    bare = _span.sub(" ", paragraph)
    return " ".join(s.strip() for s in _split(bare) if not (_signs.search(s) and _codeish.search(s)))


def _blocks(text: str) -> list[str]:
    """Runs of prose lines; each is a text in which sentences can be looked for."""
    lines = _break.split(text)
    out: list[str] = []
    run = ""
    fenced = False
    front = lines[0].strip() == "---" and any(x.strip() == "---" for x in lines[1:])
    for n, line in enumerate(lines):
        if front:
            front = n == 0 or line.strip() != "---"
            continue
        if _fence.match(line):
            fenced = not fenced
            line = ""
        elif fenced:
            continue
        bare = _bullet.sub("", line, count=2)
        text_part = bare.strip()
        if len(_stop.findall(text_part)) >= MANY and _signs.search(text_part):
            text_part = _without_code(text_part)
        if not text_part or _heading.match(line) or (_signs.search(text_part) and _codeish.search(text_part)) or _item.search(text_part):
            if run:
                out.append(run)
            run = ""
            continue
        goes_on = bool(run) and text_part[0].islower() and not run.rstrip().endswith((".", "!", "?"))
        if run and (goes_on or (bare == line and run.rstrip()[-1:] in ".!?\"')")):
            run += " " + text_part
        elif run and run.rstrip()[-1:] in ".!?\"')":
            run += " " + text_part
        else:
            if run:
                out.append(run)
            run = text_part
    if run:
        out.append(run)
    return out


def _split(block: str) -> list[str]:
    out, at = [], 0
    for m in _stop.finditer(block):
        head = block[at : m.start()]
        if m.group()[0] == "." and head.rsplit(None, 1)[-1:] and head.rsplit(None, 1)[-1].lower().strip("(\"'") in ABBREVIATIONS:
            continue
        out.append(block[at : m.end()])
        at = m.end()
    out.append(block[at:])
    return [p for s in out for p in _joined.split(s) if p.strip()]


def is_english(words: list[str]) -> bool:
    """Three words or more with English grammar words, more of them than of other languages'."""
    if len(words) < 3:
        return False
    english = len([w for w in words if w in ENGLISH])
    other = len([w for w in words if w in OTHER])
    return english > other and english * 9 >= len(words)


def sentences(text: str) -> list[list[str]]:
    """The English sentences of a text, each as its words in lower case.

    Headings, fenced and plain code, configuration, links, front matter and lists of names aren't prose; a
    bulleted, quoted or commented line that reads as a sentence is. A line break ends a sentence unless
    the next line goes on in lower case. Points of abbreviations and versions end none, and sentences
    strung together by commas count singly.
    """
    out = []
    for block in _blocks(text):
        for s in _split(block):
            words = _word.findall(s.lower())
            if is_english(words):
                out.append(words)
    return out
