"""Text columns: markup to plain text, redaction, folding and the matching form of a text.

Everything is a native column expression except the Unicode normal forms, which Spark SQL lacks;
these two are small Arrow UDFs. They take a batch in slices and hand on each slice when it is done, so a Python
worker holds the batch as Arrow has it and the objects of a few texts, however many texts a batch has.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as the source format defines it (Java's \s is ASCII only).
SPACES = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The named entities that are decoded; all others stay as they are.
NAMED_ENTITIES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "nbsp": " ", "quot": '"'}


def trim_text(value: Column) -> Column:
    """Trim every kind of white space at both ends, before a next-line mark (U+0085) that ends the text too.

    The pattern looks at every character; only texts with such a mark need it, as `$` also stands before the mark.
    """
    odd = F.regexp_replace(value, f"^[{SPACES}]+|[{SPACES}]+$", "")
    return F.when(F.endswith(value, F.lit("\u0085")), odd).otherwise(F.btrim(value, F.lit(SPACES)))


def trimmed_or_null(value: Column) -> Column:
    return F.nullif(trim_text(value), F.lit(""))


# ---------------------------------------------------------------- markup


def _code_point(number: Column) -> Column:
    """The character of a code point, or null when there is none to write."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return F.when(valid, char)


def decode_entities(value: Column) -> Column:
    """Decode entities in one pass, so that `&amp;lt;` gives `&lt;` and nothing is decoded twice."""

    def piece(part: Column, index: Column) -> Column:
        result = F.concat(F.lit("&"), part)
        for name, char in NAMED_ENTITIES.items():
            token = f"{name};"
            result = F.when(part.startswith(token), F.concat(F.lit(char), F.substring(part, len(token) + 1, 2**31 - 1))).otherwise(
                result
            )
        number = F.regexp_extract(part, r"^#0*([0-9]{1,7});", 1)
        hexa = F.regexp_extract(part, r"^#[xX]0*([0-9a-fA-F]{1,6});", 1)
        tail = F.regexp_replace(part, r"^#[xX]?[0-9a-fA-F]+;", "")
        point = F.coalesce(
            F.try_to_number(F.nullif(number, F.lit("")), F.lit("9999999")).cast("long"),
            F.conv(F.nullif(hexa, F.lit("")), 16, 10).cast("long"),
        )
        decoded = _code_point(point)
        result = F.when(part.startswith("#") & decoded.isNotNull(), F.concat(decoded, tail)).otherwise(result)
        return F.when(index == 0, part).otherwise(result)

    return F.array_join(F.transform(F.split(value, "&"), piece), "")


def _where(text: Column, marks: tuple[str, ...], step: Callable[[Column], Column]) -> Column:
    """A step for the texts that hold one of some marks. The text is a variable, so steps may follow each other."""
    held = lambda t: reduce(or_, (F.contains(t, F.lit(m)) for m in marks))
    return F.transform(F.array(text), lambda t: F.when(held(t), step(t)).otherwise(t))[0]


def _without_tags(value: Column) -> Column:
    text = F.regexp_replace(value, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", "")
    text = F.regexp_replace(text, r"(?i)<(?:br|/p|/li|/div|/h[1-6])\s*/?>", "\n")
    return F.regexp_replace(text, r"<[^>]*>", "")


def html_to_text(value: Column) -> Column:
    """Plain text of a markup fragment: block ends become lines, at most one blank line is kept.

    A pattern is tried on texts that hold what it needs, which a look at the bytes tells, and never replaces
    something by itself.
    """
    text = _where(value, ("<",), _without_tags)
    text = _where(text, ("&",), decode_entities)
    text = _where(text, ("\r",), lambda t: F.regexp_replace(t, r"\r\n?", "\n"))
    text = _where(text, ("\t", "  "), lambda t: F.regexp_replace(t, r"\t[\t ]*| [\t ]+", " "))
    text = _where(text, (" \n", "\n "), lambda t: F.regexp_replace(t, r" \n ?|\n ", "\n"))
    text = _where(text, ("\n\n\n",), lambda t: F.regexp_replace(t, r"\n{3,}", "\n\n"))
    return trim_text(text)


def redact_text(value: Column, limit: int | None = None) -> Column:
    """Replace addresses, mails and phone numbers by tags; the sampling variant also trims and cuts."""
    # Patterns and tags.
    text = F.regexp_replace(value, f"(?i)https?://[^{SPACES}]+", "[URL]")
    text = F.regexp_replace(text, r"(?i)[\w.+-]+@[\w.-]+\.[a-z]{2,}", "[EMAIL]")
    text = F.regexp_replace(text, r"(?:\+33|0)[\d .()-]{8,}", "[TÉLÉPHONE]")
    if limit is not None:
        text = F.substring(trim_text(text), 1, limit)
    return text


def safe_url(value: Column) -> Column:
    """A well-formed http(s) address, else null."""
    protocol = F.lower(F.try_parse_url(value, F.lit("PROTOCOL")))
    host = F.try_parse_url(value, F.lit("HOST"))
    return F.when(protocol.isin("http", "https") & host.isNotNull(), value)


# ---------------------------------------------------------------- folding


#: Texts that are Python objects at once.
SLICE = 128


def slices(batch: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """The columns of a batch in short slices."""
    for start in range(0, len(batch[0]), SLICE):
        yield tuple(column.slice(start, SLICE) for column in batch)


def _folded(batches: Iterator[pa.Array], fold: Callable[[str], str]) -> Iterator[pa.Array]:
    for batch in batches:
        for (part,) in slices((batch,)):
            yield pa.array([t if t is None else t.lower() if t.isascii() else fold(t) for t in part.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _nfkd_lower(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _folded(batches, lambda t: unicodedata.normalize("NFKD", t).lower())


@F.arrow_udf(T.StringType())
def _nfkc_lower(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _folded(batches, lambda t: unicodedata.normalize("NFKC", t).lower())


def fold_phrase(value: Column) -> Column:
    """Accent-free lower-case words padded with one space, for whole-phrase containment."""
    text = F.regexp_replace(_nfkd_lower(value), r"\p{M}+", "")
    text = F.regexp_replace(text, r"[^\p{L}\p{N}+#.]+", " ")
    return F.concat(F.lit(" "), F.trim(text), F.lit(" "))


def folded_phrase(phrase: str) -> str:
    """The same folding for one phrase of a vocabulary."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", phrase).lower() if unicodedata.category(c)[0] != "M")
    words = "".join(c if unicodedata.category(c)[0] in "LN" or c in "+#." else " " for c in bare)
    return f" {' '.join(words.split())} "


def fold_excerpt(value: Column) -> Column:
    """Letters and digits only, for containment of quoted excerpts."""
    return F.regexp_replace(F.regexp_replace(_nfkd_lower(value), r"\p{M}+", ""), r"[^\p{L}\p{N}]+", "")


def folded_words(value: Column) -> Column:
    """Words of letters and digits, without case and marks, in order."""
    plain = F.regexp_replace(F.regexp_replace(_nfkd_lower(value), r"\p{M}+", ""), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda word: word != "")


def content_fingerprint(title: Column, description: Column) -> Column:
    """Hash of the text alone, blind to case, compatibility forms and spacing."""
    text = _nfkc_lower(F.concat(title, F.lit("\n"), description))
    return F.sha2(F.regexp_replace(text, f"[{SPACES}]+", " "), 256)


# ---------------------------------------------------------------- matching form

# In the marked form a run of white space holding a line end is "\n" instead of " ", and sentence
# marks which only appear by folding (an ellipsis is three dots) are small-form look-alikes. Both are
# one character each, so that positions equal those of the plain form.
_SOFT = {".": "\u2024", "!": "\ufe57", "?": "\ufe56", ";": "\ufe54"}
SOFT_MARKS = "".join(_SOFT.values())
# The rules cut texts at this character, so the marked form never holds it itself.
SEPARATOR, _SEPARATOR_TWIN = "\u0001", "\ufdd0"
MATCH_TYPE = T.StructType(
    [
        T.StructField("marked", T.StringType()),
        T.StructField(
            "shifts",
            T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("source", T.IntegerType())])),
        ),
    ]
)


@lru_cache(maxsize=1)
def _folding() -> tuple[dict[int, str], re.Pattern, re.Pattern]:
    """Folding of each code point of the basic plane, the characters that lower case alone does not fold,
    and the places where a text must be folded one character at a time."""
    table = {c: chr(c).lower() for c in range(ord("A"), ord("Z") + 1)}
    for code in range(0x80, 0x10000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        folded = unicodedata.normalize("NFKC", char).lower()
        folded = "".join("'" if c in "’‘`" else c for c in folded)
        if char not in _SOFT:
            folded = "".join(_SOFT.get(c, c) for c in folded)
        if folded != char:
            table[code] = folded
    table[ord("`")] = "'"
    table[ord(SEPARATOR)] = _SEPARATOR_TWIN
    table.update({ord(c): "\n" if c in "\n\r" else " " for c in SPACES})

    def fold(char: str) -> str:
        return table.get(ord(char), char)

    # U+03A3 lower-cases by its neighbours in a string, so it is always handled alone.
    alone = [c for c, folded in table.items() if len(folded) != 1 or len(chr(c).lower()) != 1 or fold(chr(c).lower()) != folded]
    alone = {*alone, 0x3A3}
    special = [c for c in table if c not in alone and chr(c).lower() == chr(c) and table[c] != chr(c)]
    classes = ("".join(map(re.escape, map(chr, sorted(codes)))) for codes in (special, alone))
    special_class, alone_class = classes
    return table, re.compile(f"[{special_class}]"), re.compile(f"[{SPACES}]{{2,}}|[{alone_class}]")


def _match_form(text: str):
    """Folded text with the sparse list of places where its offset to the source changes.

    Stretches between runs of white space and growing characters keep their length and are folded at
    once; only the few places in between are handled one by one.
    """
    table, special, uneven = _folding()
    out, shifts, length, expected, position, spaced = [], [], 0, 0, 0, False

    def emit(piece: str, source: int):
        nonlocal length, expected, spaced
        if not piece:
            return
        if source != expected:
            shifts.append((length, source))
        out.append(piece)
        length += len(piece)
        expected = source + len(piece)
        spaced = piece[-1] in " \n"

    def emit_space(mark: str, source: int):
        if not spaced:
            emit(mark, source)
        elif mark == "\n":
            out[-1] = out[-1][:-1] + mark

    def emit_even(start: int, end: int):
        piece = special.sub(lambda m: table[ord(m.group())], text[start:end].lower())
        if piece[:1] in (" ", "\n"):
            emit_space(piece[0], start)
            start, piece = start + 1, piece[1:]
        emit(piece, start)

    for place in uneven.finditer(text):
        if place.start() > position:
            emit_even(position, place.start())
        found = place.group()
        if len(found) > 1:
            emit_space("\n" if "\n" in found or "\r" in found else " ", place.start())
        else:
            for unit in table[ord(found)]:
                if unit == " ":
                    emit_space(unit, place.start())
                else:
                    emit(unit, place.start())
        position = place.end()
    if position < len(text):
        emit_even(position, len(text))
    return "".join(out), shifts


def listed(rows: list[list | None], fields: dict[str, pa.DataType]) -> pa.Array:
    """Lists of tuples as an array of lists of structs, built by column."""
    ends, flat = [0], []
    for row in rows:
        flat += row or ()
        ends.append(len(flat))
    columns = zip(*flat) if flat else [()] * len(fields)
    values = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], list(fields))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([row is None for row in rows], pa.bool_()))


def match_array(forms: list[tuple]) -> pa.Array:
    """Matching forms (marked, shifts) as an array of `MATCH_TYPE`."""
    shifts = listed([shifts for _, shifts in forms], {"at": pa.int32(), "source": pa.int32()})
    return pa.StructArray.from_arrays([pa.array([marked for marked, _ in forms], pa.string()), shifts], ["marked", "shifts"])


@F.arrow_udf(MATCH_TYPE)
def match_form(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        for (part,) in slices((batch,)):
            yield match_array([(None, None) if t is None else _match_form(t) for t in part.to_pylist()])


def plain_form(marked: Column) -> Column:
    """The matching text itself: marks of the marked form replaced by what they stand for."""
    return F.translate(marked, "\n" + SOFT_MARKS + _SEPARATOR_TWIN, " " + "".join(_SOFT) + SEPARATOR)


def source_offset(shifts: Column, position: Column) -> Column:
    """Source offset (in characters) of a position in the matching text."""
    last = F.array_max(F.filter(shifts, lambda s: s["at"] <= position))
    return F.when(last.isNull(), position).otherwise(last["source"] + position - last["at"])
