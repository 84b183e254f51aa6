"""JavaScript regex semantics on Java (Spark) and RE2 (oracle SQL).

Three JavaScript details differ from Java's regex engine and matter here:

* ``\\s`` (and ``String.prototype.trim``) include NBSP, BOM and the other
  Unicode spaces; Java's ``\\s`` is ASCII only.
* ``\\b`` is an ASCII word boundary in JavaScript; Java 17's ``\\b`` also
  treats accented letters as word characters.
* ``/i`` without the ``u`` flag folds ASCII case only, as Java's ``(?i)``.

:func:`to_java` rewrites ``\\s`` and ``\\b`` into explicit classes and
look-arounds; :func:`to_re2` keeps RE2's ASCII ``\\b`` and spells out the
space class with ``\\x{...}`` escapes.
"""

from __future__ import annotations

from collections.abc import Iterable

# The JavaScript whitespace set (WhiteSpace + LineTerminator).
JS_SPACE_JAVA = r"\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
JS_SPACE_RE2 = (r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
                r"\x{202F}\x{205F}\x{3000}\x{FEFF}")
_WORD = "A-Za-z0-9_"
JAVA_ASCII_BOUNDARY = (f"(?:(?<![{_WORD}])(?=[{_WORD}])"
                       f"|(?<=[{_WORD}])(?![{_WORD}]))")


def _is_word(ch: str) -> bool:
    return ch.isascii() and (ch.isalnum() or ch == "_")


def _boundary(js: str, i: int, boundary: str) -> str:
    """``\\b`` at ``js[i]``.  Next to a literal word character one side of the
    boundary is known, so one look-around suffices (same matches, much less
    work per position).  RE2 keeps its own ASCII ``\\b``."""
    if boundary == r"\b":
        return boundary
    nxt = js[i + 2] if i + 2 < len(js) else ""
    if _is_word(nxt):
        return f"(?<![{_WORD}])"
    if _ends_with_word(js[:i]):
        return f"(?![{_WORD}])"
    return boundary


def _split_alternatives(body: str) -> list[str]:
    parts, depth, cur, i = [], 0, "", 0
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            cur += body[i:i + 2]
            i += 2
            continue
        if c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if c == "|" and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
        i += 1
    return parts + [cur]


def _ends_with_word(prefix: str) -> bool:
    """True when every match of ``prefix`` must end with an ASCII word char
    (conservative: False when unsure)."""
    if not prefix:
        return False
    if prefix.endswith("?") and not prefix.endswith("\\?"):
        body = prefix[:-1]
        atom_start = _last_atom_start(body)
        if atom_start is None:
            return False
        return _ends_with_word(body[atom_start:]) and _ends_with_word(body[:atom_start])
    if prefix.endswith(")") and not prefix.endswith("\\)"):
        start = _last_atom_start(prefix)
        if start is None:
            return False
        inner = prefix[start + 1:-1]
        if inner.startswith("?:"):
            inner = inner[2:]
        elif inner.startswith("?"):
            return False
        return all(_ends_with_word(a) for a in _split_alternatives(inner))
    if len(prefix) >= 2 and prefix[-2] == "\\":
        return prefix[-1] in "dw"
    if prefix[-1] in "]*+}|":
        return False
    return _is_word(prefix[-1])


def _last_atom_start(body: str) -> int | None:
    """Start index of the last atom of ``body`` (a group, an escape or a char)."""
    if not body:
        return None
    if body.endswith(")") and not body.endswith("\\)"):
        depth = 0
        for j in range(len(body) - 1, -1, -1):
            if body[j] == ")" and (j == 0 or body[j - 1] != "\\"):
                depth += 1
            elif body[j] == "(" and (j == 0 or body[j - 1] != "\\"):
                depth -= 1
                if depth == 0:
                    return j
        return None
    if len(body) >= 2 and body[-2] == "\\":
        return len(body) - 2
    if body[-1] in "]*+}":
        return None
    return len(body) - 1


def _translate(js: str, space: str, boundary: str) -> str:
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(js):
        c = js[i]
        if c == "\\" and i + 1 < len(js):
            n = js[i + 1]
            if n == "s":
                out.append(space if in_class else f"[{space}]")
            elif n == "S":
                if in_class:
                    raise ValueError(r"\S inside a class is not supported")
                out.append(f"[^{space}]")
            elif n == "b" and not in_class:
                out.append(_boundary(js, i, boundary))
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def to_java(js: str) -> str:
    """A JavaScript pattern body as a Java pattern with the same matches."""
    return _translate(js, JS_SPACE_JAVA, JAVA_ASCII_BOUNDARY)


def to_re2(js: str) -> str:
    """A JavaScript pattern body as an RE2 pattern (DuckDB oracles)."""
    return _translate(js, JS_SPACE_RE2, r"\b")


def any_of(patterns: Iterable[str], ignore_case: bool = True,
           dialect: str = "java") -> str:
    """One alternation that matches when any pattern matches.

    An empty list yields a pattern that never matches, as ``[].some()`` is
    false.
    """
    conv = to_java if dialect == "java" else to_re2
    parts = [f"(?:{conv(p)})" for p in patterns]
    if not parts:
        return "(?!)" if dialect == "java" else "[^\\x00-\\x{10FFFF}]"
    body = "|".join(parts)
    return f"(?i:{body})" if ignore_case else body


def js_trim_pattern(dialect: str = "java") -> str:
    space = JS_SPACE_JAVA if dialect == "java" else JS_SPACE_RE2
    return f"^[{space}]+|[{space}]+$"


def js_space_run(dialect: str = "java") -> str:
    space = JS_SPACE_JAVA if dialect == "java" else JS_SPACE_RE2
    return f"[{space}]+"


def _literal_runs(alt: str) -> list[str] | None:
    """Literal character runs every match of one alternative must contain
    (None when the alternative has top-level structure this does not read)."""
    runs: list[str] = []
    cur = ""
    i = 0
    while i < len(alt):
        c = alt[i]
        nxt = alt[i + 1] if i + 1 < len(alt) else ""
        if c == "\\" and nxt:
            lit = nxt if (not nxt.isalnum()) else None
            q = alt[i + 2] if i + 2 < len(alt) else ""
            i += 2
            if lit is None:  # \s \d \b \w ...
                runs.append(cur)
                cur = ""
                if q in ("?", "*", "+"):
                    i += 1
                continue
        elif c in "([":
            close = ")" if c == "(" else "]"
            depth, j = 0, i
            while j < len(alt):
                if alt[j] == "\\":
                    j += 2
                    continue
                if alt[j] == c:
                    depth += 1
                elif alt[j] == close:
                    depth -= 1
                    if depth == 0:
                        break
                j += 1
            runs.append(cur)
            cur = ""
            i = j + 1
            if i < len(alt) and alt[i] in "?*+":
                i += 1
            continue
        elif c in ".^$":
            runs.append(cur)
            cur = ""
            i += 1
            if i < len(alt) and alt[i] in "?*+":
                i += 1
            continue
        elif c in "?*+{|)":
            return None
        else:
            lit = c
            q = nxt
            i += 1
        if q in ("?", "*"):
            runs.append(cur)
            cur = ""
            i += 1
        elif q == "+":
            cur += lit
            runs.append(cur)
            cur = ""
            i += 1
        elif q == "{":
            return None
        else:
            cur += lit
    runs.append(cur)
    return [r for r in runs if r]


def required_literals(js: str) -> list[str] | None:
    """One lower-case ASCII literal per top-level alternative of a
    case-insensitive JavaScript pattern, such that every match contains the
    literal of its alternative; None when some alternative has none.  A
    ``contains`` test on the lower-cased text is then a necessary condition
    for the regex, and a cheap gate in front of it."""
    out = []
    for alt in _split_alternatives(js):
        runs = _literal_runs(alt)
        if not runs:
            return None
        best = max(runs, key=len)
        if not best.isascii():
            return None
        out.append(best.lower())
    return out
