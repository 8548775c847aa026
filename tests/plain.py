"""Plain definitions, line by line, to hold operators against."""

import re


def cased(replacement: str, original: str) -> str:
    if len(original) > 1 and original == original.upper():
        return replacement.upper()
    return replacement[:1].upper() + replacement[1:] if original[:1] == original[:1].upper() else replacement


def rewritten(line: str, fixes: list[tuple[str, str]]) -> str:
    """Each (word, replacement) in turn, on whole words in any case; a later word may match what an earlier one put in."""
    for word, replacement in fixes:
        line = re.sub(rf"\b{re.escape(word)}\b", lambda m, r=replacement: cased(r, m[0]), line, flags=re.IGNORECASE | re.ASCII)
    return line


def markdown_kept(text: str) -> list[str]:
    """The lines of a Markdown text, with what is no prose blanked at equal length, by a walk over the lines."""
    gone = lambda m: " " * len(m[0])
    out, until = [], None
    for i, line in enumerate(text.split("\n")):
        bare = line.strip()
        mark = re.match("`{3,}|~{3,}", bare)
        if until:
            ended = bare.startswith(until) if until[0] in "`~" else until in line if until == "-->" else line.rstrip() == until
            out.append("")
            until = None if ended else until
        elif (i == 0 and bare == "---") or mark or (bare.startswith("<!--") and "-->" not in line):
            out.append("")
            until = mark[0] if mark else "-->" if bare.startswith("<!--") else "---"
        else:
            out.append(re.sub("`[^`]*`", gone, re.sub("<!--.*?-->", gone, line)))
    return out
