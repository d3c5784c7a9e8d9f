"""Text helpers: regular expressions written for RE2, numbers in the exposition format."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


# POSIX classes of RE2 and how Java spells them.
POSIX = {
    "alnum": "\\p{Alnum}", "alpha": "\\p{Alpha}", "ascii": "\\p{ASCII}", "blank": "\\p{Blank}", "cntrl": "\\p{Cntrl}", "digit": "\\p{Digit}",
    "graph": "\\p{Graph}", "lower": "\\p{Lower}", "print": "\\p{Print}", "punct": "\\p{Punct}", "space": "\\p{Space}", "upper": "\\p{Upper}",
    "word": "\\w", "xdigit": "\\p{XDigit}",
}
CATEGORIES = frozenset("C L M N P S Z Cc Cf Co Cs Ll Lm Lo Lt Lu Mc Me Mn Nd Nl No Pc Pd Pe Pf Pi Po Ps Sc Sk Sm So Zl Zp Zs".split())
SPACE = "\\t\\n\\f\\r "
_REPEAT = re.compile(r"\{(\d+)(?:,(\d*))?\}")
_NAMED = re.compile(r"\(\?P?<[A-Za-z_0-9]+>")
_FLAGS = re.compile(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])")


def _literal(char: str) -> str:
    return char if char.isalnum() or char in "_ " or ord(char) > 127 else "\\" + char


class _Translation:
    """One pass over an RE2 pattern; ``out`` collects what Java is given."""

    def __init__(self, pattern: str):
        self.pattern, self.at, self.out = pattern, 0, ["(?d)"]
        self.lines = [False]  # whether (?m) holds, per open group

    def fail(self, what: str) -> ValueError:
        return ValueError(f"unsupported in a pattern: {what} at {self.at} of {self.pattern!r}")

    def ahead(self, text: str) -> bool:
        return self.pattern.startswith(text, self.at)

    def escape(self, in_class: bool) -> str:
        """What stands for the escape that begins here."""
        if self.at + 1 >= len(self.pattern):
            raise self.fail("a backslash at the end")
        char = self.pattern[self.at + 1]
        self.at += 2
        if char in "dDwWfnrta":
            return "\\" + char
        if char == "s":
            return SPACE if in_class else f"[{SPACE}]"
        if char == "S":
            return f"[^{SPACE}]"
        if char == "v":
            return "\\x0B"
        if char in "bBAz" and not in_class:
            return "\\" + char
        if char in "pP":
            found = re.compile(r"\{\^?[A-Za-z_]+\}|[A-Z]").match(self.pattern, self.at)
            if found is None:
                raise self.fail("a class without a name")
            self.at = found.end()
            name = found[0].strip("{}")
            if name.startswith("^"):
                name, char = name[1:], "P" if char == "p" else "p"
            return f"\\{char}{{{name if name in CATEGORIES else 'Is' + name}}}"
        if char == "x":
            found = re.compile(r"\{[0-9A-Fa-f]{1,6}\}|[0-9A-Fa-f]{2}").match(self.pattern, self.at)
            if found is None:
                raise self.fail("a hexadecimal escape")
            self.at = found.end()
            return "\\x" + found[0]
        if char.isdigit():
            found = re.compile(r"[0-7]{1,3}").match(self.pattern, self.at - 1)
            if found is None or char != "0" and len(found[0]) < 2:
                raise self.fail("a back reference")
            self.at = found.end()
            return f"\\x{{{int(found[0], 8):x}}}"
        if char.isalnum():
            raise self.fail(f"\\{char}")
        return _literal(char)

    def quoted(self) -> str:
        """The text between ``\\Q`` and ``\\E``, or the end."""
        end = self.pattern.find("\\E", self.at + 2)
        text = self.pattern[self.at + 2 : end if end >= 0 else None]
        self.at = end + 2 if end >= 0 else len(self.pattern)
        return "".join(map(_literal, text))

    def char_class(self) -> None:
        self.out.append("[")
        self.at += 1
        if self.ahead("^"):
            self.out.append("^")
            self.at += 1
        first = True
        while first or not self.ahead("]"):
            if self.at >= len(self.pattern):
                raise self.fail("a class that is not closed")
            posix = re.compile(r"\[:(\^?)(\w+):\]").match(self.pattern, self.at)
            if posix:
                if posix[2] not in POSIX:
                    raise self.fail(f"class {posix[0]}")
                spelled = POSIX[posix[2]]
                self.out.append("\\" + spelled[1].swapcase() + spelled[2:] if posix[1] else spelled)
                self.at = posix.end()
            elif self.ahead("\\Q"):
                self.out.append(self.quoted())
            elif self.ahead("\\"):
                self.out.append(self.escape(in_class=True))
            else:
                char = self.pattern[self.at]
                self.out.append(char if char == "-" else _literal(char))
                self.at += 1
            first = False
        self.out.append("]")
        self.at += 1

    def group(self) -> None:
        named, flags = _NAMED.match(self.pattern, self.at), _FLAGS.match(self.pattern, self.at)
        if named:
            self.out.append("(")
            self.lines.append(self.lines[-1])
            self.at = named.end()
        elif flags:
            if "U" in flags[1] + (flags[2] or ""):
                raise self.fail("(?U)")
            lines = "m" in flags[1] or self.lines[-1] and "m" not in (flags[2] or "")
            if flags[3] == ":":
                self.lines.append(lines)
            else:
                self.lines[-1] = lines
            self.out.append(flags[0])
            self.at = flags.end()
        elif self.ahead("(?"):
            raise self.fail(self.pattern[self.at : self.at + 4])
        else:
            self.out.append("(")
            self.lines.append(self.lines[-1])
            self.at += 1

    def repeat(self) -> None:
        found = _REPEAT.match(self.pattern, self.at)
        if self.ahead("{") and not found:
            self.out.append("\\{")
            self.at += 1
            return
        if found and max(int(n) for n in found.groups() if n) > 1000:
            raise self.fail("a repetition beyond 1000")
        text = found[0] if found else self.pattern[self.at]
        self.at += len(text)
        if self.ahead("?"):
            text += "?"
            self.at += 1
        if self.at < len(self.pattern) and (self.pattern[self.at] in "*+?" or _REPEAT.match(self.pattern, self.at)):
            raise self.fail("a repetition of a repetition")
        self.out.append(text)

    def run(self) -> str:
        while self.at < len(self.pattern):
            char = self.pattern[self.at]
            if self.ahead("\\Q"):
                self.out.append(self.quoted())
            elif char == "\\":
                self.out.append(self.escape(in_class=False))
            elif char == "[":
                self.char_class()
            elif char == "(":
                self.group()
            elif char in "*+?{":
                self.repeat()
            else:
                if char == ")":
                    if len(self.lines) == 1:
                        raise self.fail("a closing bracket too many")
                    self.lines.pop()
                self.out.append("\\z" if char == "$" and not self.lines[-1] else char)
                self.at += 1
        if len(self.lines) > 1:
            raise self.fail("a group that is not closed")
        return "".join(self.out)


def java_regex(pattern: str) -> str:
    """Spell an RE2 pattern so that Spark's regex functions read it the same way; what RE2 has not is an error.

    Only ``\\n`` ends a line, ``$`` does not match before a final line break, names of groups are left out, and what Java
    reads in a class that RE2 does not (nested classes, intersections) is taken literally.
    """
    return _Translation(pattern).run()


def exposition_number(value: Column) -> Column:
    """A double in the shortest form the text exposition uses (``1``, ``0.5``, ``1.5e+06``)."""
    text = value.cast("string")
    digits = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "E.*", ""), r"^-|\.0$", ""), r"\.", "")
    mantissa = F.regexp_replace(F.regexp_replace(digits, "^0+", ""), "0+$", "")
    magnitude = F.floor(F.log10(F.abs(value)))
    # log10 may be off by one next to a power of ten, so compare with the power itself
    power = F.pow(F.lit(10.0), magnitude)
    exponent = (
        F.when(F.abs(value) >= power * 10, magnitude + 1)
        .when(F.abs(value) < power, magnitude - 1)
        .otherwise(magnitude)
    ).cast("int")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    fraction = F.when(F.length(mantissa) > 1, F.concat(F.lit("."), F.substring(mantissa, 2, 400))).otherwise(F.lit(""))
    scientific = F.concat(
        sign, F.left(mantissa, F.lit(1)), fraction, F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(exponent).cast("string"), 2, "0"),
    )
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), mantissa)
    plain = F.regexp_replace(text, r"\.0$", "")
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(value), F.lit("NaN"))
        .when(value == float("inf"), F.lit("+Inf"))
        .when(value == float("-inf"), F.lit("-Inf"))
        .when(value == 0, F.lit("0"))
        .when((exponent < -4) | (exponent >= 6), scientific)
        .when(exponent < 0, small)
        .otherwise(plain)
    )
