"""Kinds of lines in a flattened notebook: prose, code, list, table, junk; whole texts, line by line in the context of their block.

A block is a stretch of lines without blank line or cell mark. Lines with a plain sign (a table's cells, a trace, encoded bytes) are told alone; short
entries are a list only in company. Prose is told by the shape of its sentences and, as one feature more, by function words of four languages; a row of words that has
neither is shuffled text.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Function words of the four languages; a natural sentence of some length holds at least one.
COMMON = {
    "en": "the a an of to and in is that it for on with as was were be by this these those every each our one at from or but not so if when while because although there been has have had which who what how many are its their his her they we you i can will would than then into out only also more most some such no all any after before once again under over near inside nobody",
    "de": "der die das den dem des ein eine einer eines einem einen und ist in zu von mit nicht es auf für sich auch als an wie aber weil bevor man noch gibt wir sie er ihr jede jeder jedes diese dieser dieses wird war sind hat werden kann nach bei aus oder wenn dass nur",
    "es": "el la los las un una unos unas de y en que es se no por con para como su al lo del cada esta este estas estos pero más si cuando porque aunque antes después sobre entre sin ya hay fue ser son tiene puede nuestra nuestro",
    "fr": "le la les un une des de du et en est que qui ne pas dans pour par sur avec ce cette ces chaque notre mais plus si quand parce bien avant après d'être elle il on nous vous au aux sont être a été comme avec sans son sa ses leur y se c'est n'est qu'il s'il l'on d'un d'une",
}
FUNCTION = frozenset(w for ws in COMMON.values() for w in ws.split())

MARK = re.compile(r"(?:In \[[ \d*]*\]:|Out\[[ \d*]*\]:|# %%.*|`{3,}\s*\w*)\s*$")
CODE_MARK = re.compile(r"(?:In \[[ \d*]*\]:|# %%\s*$|`{3,}\s*(?!text|output|markdown|md|txt|html|csv|console|log)\w+\s*$)")
BULLET = re.compile(r"\s*(?:[-*+•·–—▪◦‣>]|\(?\d{1,4}[.):]|\[[ xX✓]?\]|\(?[a-zA-Z][.)]|v?\d+(?:\.\d+)+)\s+(?:\[[ xX]\]\s+)?(.*)$")
WORDS = re.compile(r"(?<!\w)[^\W\d_]+(?:'[^\W\d_]+)?(?!\w)")
TRACE = re.compile(r"Traceback \(most recent call last\)|^\s*(?:File \".*\", line \d+|Cell In\[\d+\], line \d+|-{2,}> ?\d+ |\.{3} \d+ more|at [\w.$]+\(.*\)|Stacktrace:|\[\d+\] \w+.* at |ERROR: |Error in |Caused by: |[A-Z]\w*(?:Error|Exception|Warning|Mismatch|Fault|Interrupt|Missing|Failure|Overflow): )")
PROGRESS = re.compile(r"\d{1,3}%\s*\|.*\||\b\d+%\|[█▏▎▍▌▋▊▉# ]*|[█▓▒░]{3,}|^\s*(?:Epoch|Step|Batch|Iteration|iter)\b.*\d+/\d+|\b\d+/\d+ \[[=>.\s]{4,}\]|it/s\b|ETA[: ]")
HEX = re.compile(r"^\s*(?:0x)?[0-9a-fA-F]{6,16}:?\s+(?:[0-9a-fA-F]{2,4}\s+){3,}|^(?:[0-9a-fA-F]{2}\s+){7,}[0-9a-fA-F]{2}\s*|^(?:\\x[0-9a-fA-F]{2}){6,}")
ENCODED = re.compile(r"data:[\w./+-]+;base64|[A-Za-z0-9+/_=-]{48,}")
RULE = re.compile(r"^\s*(?:([^\w\s])\1{7,}\s*)+$|^\s*(?:[-=_*#~.+]\s?){10,}$")
MINIFIED = re.compile(r"function\(\w*\)\{|[;{}]\w+[=(][^\s]{6,}[;{}]\S*[;{}]")
HTML_CELL = re.compile(r"</?(?:table|thead|tbody|tr|td|th)\b", re.I)
CSV = re.compile(r"^\s*(?:\"[^\"]*\"|'[^']*'|[^\s,;\"']*)(?:[;,](?:\"[^\"]*\"|'[^']*'|[^\s,;\"']*)){2,}\s*$")
QUOTED_CSV = re.compile(r"^\s*\"[^\"]*\"(?:[;,\t]\"[^\"]*\")+\s*$")
GAPS = re.compile(r"\S(?: {2,}|\t)(?=\S)")
ODD = re.compile("[\ufffd\u00c2\u00c3\u00a9\u00b6\u20ac\u2122\u00a4\u00a6\u00ac\u00a2\u00a3\u00a5\u00a7\u0153]|\u00e2(?=[^a-z])")  # what wrongly decoded bytes look like
CODE = re.compile(r"\w\(.*\)\s*(?:[{:;,]|$)|\w\S*\s(?:=|<-|:=|\+=|\|>)\s|^\s*(?:def|for|while|if|elif|else|import|from|return|class|function|using|library|end|try|except|with)\b.*[:({;]?$(?<=[:({;)\]])|^\s*@\w|^\s*return \S+$|\w\$\w|;\s*$|[})]\s*$(?<=[({\[].[})])")
#: Letters that carry a syllable: a to y and every Latin letter built on one of them.
VOWELS = frozenset("aeiouyæœøı") | {chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0].lower() in "aeiouy"}
LAST_LATIN = "\u024f"
#: What ends a sentence, and an end of one followed by the beginning of the next.
ENDS = ".!?…。！？"
NEXT = re.compile(r"[^\W\d_]{2,}[.!?…][\"'»”)]* +[\"'«“(¿¡]*[^\W\d_a-z]")


PLAIN = re.compile(r"[^|\t<>{};&\\█%=$@`]+")
CODE_HINT = re.compile(r"[()=;{}\[\]@$]|^\s*(?:return|import|from|end|else|try)\b")


def function_words(words: list[str]) -> int:
    return sum(map(FUNCTION.__contains__, words))


def garbled(line: str, words: list[str], fn: int) -> bool:
    """Mojibake, or words that cannot be spoken."""
    n = len(line)
    if n >= 8 and not line.isascii() and len(ODD.findall(line)) > 0.12 * n:
        return True
    if fn:
        return False
    long = [w for w in words if len(w) >= 2 and w[0] <= LAST_LATIN]  # other scripts write syllables in their own way
    return len(long) >= 3 and sum(map(VOWELS.isdisjoint, long)) > 0.6 * len(long)


def begins(text: str) -> bool:
    """Whether the first letter begins a sentence: a capital, or a letter of a script that has none."""
    first = next((c for c in text if c.isalpha()), "a")
    return not first.islower()


def shaped(text: str, n_words: int) -> bool:
    """Whether a text has the shape of sentences in whatever language: a beginning and an end, or an end with a beginning after it; several words, or a script without blanks between words."""
    text = text.rstrip("\"'»”)")
    if not text or not PLAIN.fullmatch(text):
        return False
    if n_words >= 4 and (NEXT.search(text) or text[-1] in ENDS and begins(text)):
        return True
    return text[-1] in ENDS and sum(c > "\u2e80" for c in text) >= 6


def line_kind(line: str) -> str:
    """What a line says about itself: junk, trace, table, cells, item, sentence, entry, words, odd or code."""
    s = line.strip()
    words = WORDS.findall(s.lower())
    n_words = len(words)
    fn = function_words(words)
    first = s[0]
    if fn > 1 and n_words >= 5 and fn >= 0.15 * n_words and first.isupper() and s[-1] in ".!?:" and PLAIN.fullmatch(s):
        if "Error" not in s and "Traceback" not in s:
            return "sentence"
    if TRACE.search(line):
        return "trace"
    if ("%" in s or "█" in s or "/" in s) and PROGRESS.search(s):
        return "junk"
    if first == "+" and s[-1] == "+" and set(s) <= set("+-=:"):
        return "table"
    if RULE.match(s) or HEX.match(s):
        return "junk"
    if "<" in s and HTML_CELL.search(s):
        return "table"
    spaces = s.count(" ")
    if len(s) >= 48 and ENCODED.search(s) and ("base64" in s or len(max(ENCODED.findall(s), key=len)) > 0.4 * len(s)):
        return "junk"
    if len(s) >= 24 and MINIFIED.search(s) and spaces < 0.12 * len(s):
        return "junk"
    if "|" in s and (first == "|" and s[-1] == "|" and s.count("|") > 2 or s.count(" | ") >= 2):
        return "table"
    if s.endswith("\\\\") and "&" in s or first == '"' and QUOTED_CSV.match(s):
        return "table"
    if garbled(s, words, fn):
        return "junk"
    m = BULLET.match(line)
    if m and m[1]:
        n = len(WORDS.findall(m[1]))
        said = fn >= 2 and n >= 6 or (m[1].rstrip().endswith((".", "!", "?")) and n >= 5)
        return "sentence" if said else "item" if n <= 8 else "words"
    if CODE_HINT.search(line) and not (fn >= 2 and n_words >= 6) and CODE.search(line):
        return "code"
    gaps = len(GAPS.findall(s))
    if "\t" in s or gaps >= 2:
        return "table"
    if not fn and ("," in s or ";" in s) and CSV.match(s):
        return "cells"
    if gaps == 1 and not fn:
        return "cells"
    if fn and n_words >= 3 and fn >= 0.1 * n_words:
        return "sentence"
    if s.count(",") >= 2 and not fn and all(len(p.split()) <= 3 for p in s.split(",")):
        return "item"
    if not words:
        return "odd"
    if shaped(s, n_words):
        return "sentence"
    if n_words <= 6 and len(s) <= 60 and s[-1] not in ".!?":
        return "entry"
    return "words"


_short_line_kind = lru_cache(maxsize=32_768)(line_kind)  # marks, frames and heads recur; the bound keeps a worker's memory fixed


def kinds_of(text: str) -> dict[str, int]:
    """Characters of the text (line ends included) by kind: prose, code, list, table, junk, other (marks, blank lines, headings)."""
    total = dict.fromkeys(("prose", "code", "list", "table", "junk", "other"), 0)
    block: list[str] = []
    code, held = False, True  # inside a code cell; whether it goes on after a blank line

    def flush() -> None:
        if block:
            for k, n in _block(block, code).items():
                total[k] += n
            block.clear()

    for line in text.split("\n"):
        if not line.strip():
            flush()
            total["other"] += len(line) + 1
            code = code and held  # only a fence or a cell mark keeps a code cell open over a blank line
        elif line[0] in "IO#`" and MARK.match(line):
            flush()
            total["other"] += len(line) + 1
            code = bool(CODE_MARK.match(line))
            held = not line.startswith("In [")
        else:
            block.append(line)
    flush()
    total["other"] -= 1  # the last line has no line end
    return total


def _block(lines: list[str], code: bool) -> dict[str, int]:
    out = dict.fromkeys(("prose", "code", "list", "table", "junk", "other"), 0)
    n = len(lines)
    size = [len(x) + 1 for x in lines]
    if code:
        for x, c in zip(lines, size):
            hard = len(x) >= 48 and (ENCODED.search(x) or MINIFIED.search(x) and x.count(" ") < 0.12 * len(x)) or HEX.match(x)
            out["junk" if hard else "code"] += c
        return out
    kinds = [_short_line_kind(x) if len(x) < 120 else line_kind(x) for x in lines]
    # A trace takes its block: the lines between its frames are the code they show.
    if "trace" in kinds:
        first = kinds.index("trace")
        for i in range(first, n):
            if kinds[i] not in ("table",):
                kinds[i] = "junk"
    # The same line again and again is machine output.
    for i in range(1, n):
        if lines[i] == lines[i - 1] and kinds[i] not in ("table", "cells"):
            kinds[i] = kinds[i - 1] = "junk"
    # Lines of a paragraph that as a whole begins and ends like sentences are prose, wherever they were broken.
    if n > 1 and "words" in kinds and all(k in ("words", "sentence", "entry") for k in kinds):
        whole = " ".join(map(str.strip, lines))
        if begins(whole) and whole.rstrip("\"'»”)")[-1:] in tuple(ENDS) and PLAIN.fullmatch(whole):
            kinds = ["sentence"] * n
    count = {k: kinds.count(k) for k in set(kinds)}
    entries = count.get("entry", 0) + count.get("item", 0)
    cells = count.get("cells", 0) + count.get("table", 0)
    for i, k in enumerate(kinds):
        c = size[i]
        if k == "junk":
            out["junk"] += c
        elif k == "table" or (k == "cells" and cells >= 2):
            out["table"] += c
        elif k == "item":
            out["list"] += c
        elif k == "sentence":
            out["prose"] += c
        elif k == "code":
            out["code"] += c
        elif k in ("entry", "cells"):
            heading = lines[i].lstrip().startswith("#")
            if heading:
                out["other"] += c
            elif cells >= 2 and i == 0:
                out["table"] += c  # a table's head
            elif entries >= 3 or n >= 3 and entries == n:
                out["list"] += c
            elif n == 1 and len(lines[i].split()) >= 4:
                out["junk"] += c
            else:
                out["other"] += c
        elif k == "words":
            heading = lines[i].lstrip().startswith("#")
            out["other" if heading else "junk"] += c
        elif k == "odd":
            out["table" if cells >= 2 else "junk" if len(lines[i].strip()) > 3 else "other"] += c
        else:
            out["other"] += c
    return out
