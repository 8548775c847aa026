"""Column expressions on words, tokens and paths. All are built-in, so they stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as web scripting languages define it; Java's \s lacks the Unicode spaces.
SPACES = r"\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: A class of many ranges is asked range by range, so most characters are told by one range of ASCII before.
SPACE, INK = f"[[^!-~]&&[{SPACES}]]", f"[!-~[^{SPACES}]]"
#: The same as characters.
WHITE = " \t\n\x0b\f\r\u00a0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: An ASCII word boundary, which Java's \b is not.
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: An address starts where its token does: any other start would find no more, and cost a token the square of its length.
NOISE = rf"https?://{INK}+|www\.{INK}+|(?<!{INK}){INK}+@{INK}+|0[xX][0-9a-fA-F]+"
#: White space that is not in ASCII, and one look at what may be some. A class of many ranges is asked range by range, which is slow.
WIDE_SPACE, PERHAPS_WIDE = r"[\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]", r"[\x{1680}-\x{FFFF}]"
HEX_RUN = rf"{BEFORE}[0-9a-fA-F]{{8,}}{AFTER}"
DIRECTIVE = rf"(?i){BEFORE}spellcheck:(off|on|disable-line|disable-next-line){AFTER}"


def trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(WHITE))


def strip_noise(line: Column) -> Column:
    """Addresses, e-mails and hexadecimal runs give way to a space. Lines that cannot hold any skip the patterns."""
    may = line.contains("@") | line.contains("http") | line.contains("www.") | line.contains("0x") | line.contains("0X")
    plain = F.when(may, F.regexp_replace(line, NOISE, " ")).otherwise(line)
    return F.when(line.rlike("[0-9a-fA-F]{8}"), F.regexp_replace(plain, HEX_RUN, " ")).otherwise(plain)


def odd_space(line: Column) -> Column:
    """Whether a text has white space but for spaces and line feeds. Texts without any are cut at a character, which is much faster than a pattern."""
    plain = reduce(Column.__or__, [line.contains(c) for c in "\t\x0b\f\r"])
    wide = (line.contains("\u00a0") | line.rlike(PERHAPS_WIDE)) & line.rlike(WIDE_SPACE)
    return plain | ((F.octet_length(line) > F.length(line)) & wide)


def tokens(line: Column) -> Column:
    """The non-empty tokens between white space."""
    cut = lambda value, pattern: F.array_remove(F.split(value, pattern, -1), "")
    return F.when(odd_space(line), cut(line, f"{SPACE}+")).otherwise(cut(F.replace(line, F.lit("\n"), F.lit(" ")), " "))


def clean_word(token: Column) -> Column:
    """ASCII word characters and apostrophes only. Most tokens have no others and are not made anew. Java's \\w is of ASCII, and one look into a table."""
    return F.when(token.rlike(r"\A[\w']*\z"), token).otherwise(F.regexp_replace(token, r"[^\w']+", ""))


def split_identifiers(token: Column) -> Column:
    """Sub-words at separators and at case changes."""
    return F.array_remove(F.split(token, r"[_\-/.]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"), "")


def word_form(token: Column) -> Column:
    """Letters, digits and inner separators."""
    return F.regexp_replace(F.regexp_replace(token, "[^A-Za-z0-9'_-]", ""), r"^[-']+|[-']+\z", "")


def group_key(form: Column) -> Column:
    return F.translate(F.lower(form), "-_'", "")


def alphanumeric(form: Column) -> Column:
    return F.regexp_replace(form, "[^A-Za-z0-9]", "")


def match_case(replacement: Column, original: Column) -> Column:
    """The replacement in the case pattern of the original."""
    capital = F.concat(F.upper(F.substring(replacement, 1, 1)), F.substring(replacement, 2, 1 << 20))
    first = F.substring(original, 1, 1)
    return F.when((F.length(original) > 1) & (original == F.upper(original)), F.upper(replacement)).when(first == F.upper(first), capital).otherwise(replacement)


def is_vocabulary_word(word: Column) -> Column:
    return word.rlike(r"\A[a-z]{2,24}\z")


def is_suggestable(word: Column) -> Column:
    return word.rlike(r"\A[a-z][a-z']+\z")


def deletions(word: Column, depth: int) -> Column:
    """The word and all variants with up to `depth` characters deleted."""
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(w.substr(F.lit(1), i - 1), w.substr(i + 1, F.length(w))))
    out, level = F.array(word), F.array(word)
    for _ in range(depth):
        level = F.array_distinct(F.flatten(F.transform(level, cut)))
        out = F.concat(out, level)
    return F.array_distinct(out)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """The last dot and what follows, lower-cased; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(name, r".(\.[^.]*)\z", 1))


def is_markdown_path(path: Column) -> Column:
    return path.rlike(r"(?i)\.(md|markdown|mdx)\z")


def comma_list(value: Column) -> Column:
    return F.filter(F.transform(F.split(value, ","), trim), lambda w: w != "")
