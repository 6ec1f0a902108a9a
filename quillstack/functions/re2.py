"""Regular expressions of the linear-time dialect (RE2) as patterns for Spark's engine. What means something else there is translated; what the dialect lacks is refused."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import SparkSession

#: Fixed values of the dialect: names of classes in brackets, and what they are for Java.
CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "xdigit": "XDigit",
}
SPACE = r"\t\n\f\r "
MOST = 1000
_COUNT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_GROUP = re.compile(r"\(\?(?:(P?)<(\w+)>|([imsU]*(?:-[imsU]+)?)([:)]))")


class Unsupported(ValueError):
    pass


class _Pattern:
    def __init__(self, pattern: str):
        self.text, self.at, self.out = pattern, 0, []
        #: Whether ^ and $ are about lines, for each open group.
        self.lines = [False]
        self.atom = self.quantified = False

    def refuse(self, what: str) -> Unsupported:
        return Unsupported(f"{what} in the pattern {self.text!r}")

    def emit(self, java: str, atom: bool = True) -> None:
        self.out.append(java)
        self.atom, self.quantified = atom, False

    def translate(self) -> str:
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "\\":
                self.emit(self.escape(inside=False))
            elif c == "[":
                self.emit(self.bracket())
            elif c == "(":
                self.group()
            elif c == ")":
                if len(self.lines) == 1:
                    raise self.refuse("a ) without (")
                self.lines.pop()
                self.at += 1
                self.emit(")")
            elif c == "|":
                self.at += 1
                self.emit("|", atom=False)
            elif c in "^$":
                self.at += 1
                ends = {"^": r"(?:\A|(?<=\n))", "$": r"(?=\n|\z)"} if self.lines[-1] else {"^": r"\A", "$": r"\z"}
                self.emit(f"(?:{ends[c]})")
            elif c in "*+?" or c == "{" and _COUNT.match(self.text, self.at):
                self.repeat(c)
            else:
                self.at += 1
                self.emit("\\" + c if c in "{}]" else c)
        if len(self.lines) > 1:
            raise self.refuse("a ( without )")
        return "".join(self.out)

    def repeat(self, c: str) -> None:
        if not self.atom or self.quantified:
            raise self.refuse("a repetition of nothing or of a repetition")
        stop = self.at + 1
        if c == "{":
            found = _COUNT.match(self.text, self.at)
            low, high = int(found[1]), int(found[2] or found[1])
            if max(low, high) > MOST or high < low:
                raise self.refuse("a repetition count out of range")
            stop = found.end()
        if self.text[stop : stop + 1] == "?":
            stop += 1
        self.out.append(self.text[self.at : stop])
        self.at, self.quantified = stop, True

    def group(self) -> None:
        if self.text[self.at + 1 : self.at + 2] != "?":
            self.lines.append(self.lines[-1])
            self.at += 1
            return self.emit("(", atom=False)
        found = _GROUP.match(self.text, self.at)
        if not found:
            raise self.refuse("look-around, an atomic group or another group that is not supported")
        self.at = found.end()
        _, name, flags, end = found.groups()
        if name is not None:  # names of groups play no part in matching
            self.lines.append(self.lines[-1])
            return self.emit("(", atom=False)
        on, _, off = flags.partition("-")
        lines = ("m" in on or self.lines[-1]) and "m" not in off
        kept = "".join(f for f in on if f in "is") + ("-" if set(off) & set("is") else "") + "".join(f for f in off if f in "is")
        if end == ":":
            self.lines.append(lines)
            return self.emit(f"(?{kept}:", atom=False)
        self.lines[-1] = lines
        return self.emit(f"(?{kept})" if kept else "", atom=False)

    def escape(self, inside: bool) -> str:
        """The escape at the place, past which it moves."""
        found = re.compile(r"\\(?:(Q)(.*?)(?:\\E|\Z)|([pP])(\w|\{\^?\w+\})|x\{([0-9A-Fa-f]+)\}|x([0-9A-Fa-f]{2})|(0[0-7]{0,2}|[1-7][0-7]{1,2})|(.))", re.S).match(self.text, self.at)
        if not found:
            raise self.refuse("an open escape")
        self.at = found.end()
        quoted, text, kind, name, wide, short, octal, one = found.groups()
        if quoted:
            return "".join(re.sub(r"([^\w\s])", r"\\\1", c) for c in text)
        if kind:
            name = name.strip("{}")
            kind = {"p": "P", "P": "p"}[kind] if name.startswith("^") else kind
            name = name.lstrip("^")
            return f"\\{kind}{{{name if len(name) < 3 else 'Is' + name}}}"
        if wide or short or octal:
            return f"\\x{{{int(wide or short, 16) if not octal else int(octal, 8):x}}}"
        if one == "s":
            return SPACE if inside else f"[{SPACE}]"
        if one == "S":
            return f"[^{SPACE}]"
        if one == "v":
            return r"\x0B"
        if one in "bB" and not inside:
            return r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))" if one == "b" else r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"
        if one in "dDwWaftnr" or one in "Az" and not inside:
            return "\\" + one
        if one.isascii() and one.isalnum():
            raise self.refuse(f"the escape \\{one}")
        return "\\" + one if one.isascii() and not one.isspace() and one != "_" else one

    def bracket(self) -> str:
        self.at += 1
        out, first = ["["], True
        if self.text[self.at : self.at + 1] == "^":
            out.append("^")
            self.at += 1
        while self.at < len(self.text):
            c = self.text[self.at]
            if c == "]" and not first:
                self.at += 1
                return "".join([*out, "]"])
            first = False
            named = re.compile(r"\[:(\^?)(\w+):\]").match(self.text, self.at)
            if named:
                if named[2] not in CLASSES and named[2] != "word":
                    raise self.refuse(f"the class {named[0]}")
                self.at = named.end()
                out.append((r"\W" if named[1] else r"\w") if named[2] == "word" else f"\\{'P' if named[1] else 'p'}{{{CLASSES[named[2]]}}}")
            elif c == "\\":
                many = re.compile(r"\\[dDsSwWpP]").match(self.text, self.at)
                if many and len(out) > 1 and out[-1] == "-" and out[-2] not in ("[", "^"):
                    raise self.refuse("a range that ends in a class")
                out.append(self.escape(inside=True))
                if many and re.compile(r"-[^\]]").match(self.text, self.at):
                    raise self.refuse("a range that begins with a class")
            else:
                self.at += 1
                out.append("\\" + c if c in "[]&^" else c)
        raise self.refuse("a [ without ]")


def java(pattern: str) -> str:
    """The pattern for Java's engine: . stops at a line feed alone, and (?i) is about all letters. What that engine refuses (unknown classes, ranges from high to low) is refused here, before any row is read."""
    made = "(?du)" + _Pattern(pattern).translate()
    if (session := SparkSession.getActiveSession()) is not None:
        try:
            session._jvm.java.util.regex.Pattern.compile(made)
        except IllegalArgumentException as e:
            raise ValueError(f"{pattern!r}: {str(e).splitlines()[0]}") from None
    return made
