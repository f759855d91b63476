"""Technology mentions: alias hits per text in Arrow batches, then a native choice among the hits."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlens.functions.text import MATCH_TYPE, SEPARATOR, _match_form, _SEPARATOR_TWIN, _SOFT, listed, match_array, slices
from offerlens.rules import technology_rules

FIELDS = ("title", "description", "experienceLabel")
HITS = T.ArrayType(
    T.StructType(
        [
            T.StructField("shorter", T.IntegerType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("slug", T.StringType()),
            T.StructField("field", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)
_PLAIN = {ord("\n"): " ", ord(_SEPARATOR_TWIN): SEPARATOR, **{ord(soft): mark for mark, soft in _SOFT.items()}}


_MARKS = re.compile("[" + "".join(map(chr, _PLAIN)) + "]")


def _unmarked(marked: str) -> str:
    return _MARKS.sub(lambda m: _PLAIN[ord(m.group())], marked)


def _plain(text: str) -> str:
    return _unmarked(_match_form(text)[0])


@lru_cache(maxsize=1)
def _automaton():
    """All aliases in one automaton, so that a text is read once whatever the size of the vocabulary."""
    rules, found = technology_rules(), {}
    for rule in rules["technologies"]:
        signals = [_plain(s) for s in rule.get("context_signals", [])]
        exclusions = [_plain(s) for s in rule.get("exclusions", [])]
        for aliases, needed in ((rule["aliases"], False), (rule.get("context_aliases", []), True)):
            for alias in aliases:
                found.setdefault(_plain(alias), []).append((rule["slug"], len(alias), signals if needed else None, exclusions))
    automaton = ahocorasick.Automaton()
    for alias, entries in found.items():
        automaton.add_word(alias, (alias, entries))
    automaton.make_automaton()
    exact = [
        (rule["slug"], len(alias), re.compile(rf"(?<![^\W_]){re.escape(alias)}(?![^\W_])"))
        for rule in rules["technologies"]
        for alias in rule.get("exact_case_aliases", [])
    ]
    return automaton, exact, rules["context_window"]


def _word_char(char: str) -> bool:
    return unicodedata.category(char)[0] in "LN"


def _hits(text: str, marked: str, shifts: list, field: int) -> list[tuple]:
    """Hits of one text, with offsets into the source."""
    automaton, exact, window = _automaton()
    plain = _unmarked(marked)
    places = [at for at, _ in shifts]

    def source(position: int) -> int:
        i = bisect_right(places, position) - 1
        return position if i < 0 else shifts[i][1] + position - shifts[i][0]

    hits = []
    for last, (alias, entries) in automaton.iter(plain):
        start, end = last - len(alias) + 1, last + 1
        if (start and _word_char(plain[start - 1])) or (end < len(plain) and _word_char(plain[end])):
            continue
        context = None
        for slug, size, signals, exclusions in entries:
            if signals is not None or exclusions:
                context = context or plain[max(0, start - window) : end + window]
                if any(x in context for x in exclusions) or (signals is not None and not any(s in context for s in signals)):
                    continue
            hits.append((-size, source(start), slug, field, source(end - 1) + 1))
    for slug, size, pattern in exact:
        match = pattern.search(text)
        if match:
            hits.append((-size, match.start(), slug, field, match.end()))
    return hits


FORMS = T.StructType([*[T.StructField(f, MATCH_TYPE) for f in FIELDS], T.StructField("salary", MATCH_TYPE), T.StructField("hits", HITS)])
_HIT_TYPES = {"shorter": pa.int32(), "start": pa.int32(), "slug": pa.string(), "field": pa.int32(), "end": pa.int32()}


@F.arrow_udf(FORMS)
def text_forms(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Matching forms of the texts of an offer, and alias hits as (minus alias length, start, slug, field, end).

    The columns are title, description, experience label and salary label; only the last has a null form for a null.
    """
    for batch in batches:
        for *texts, salary in slices(batch):
            values = [[t or "" for t in column.to_pylist()] for column in texts]
            forms = [[_match_form(t) for t in column] for column in values]
            hits = [
                [hit for field, text in enumerate(row) for hit in _hits(text, *forms[field][i], field)] for i, row in enumerate(zip(*values))
            ]
            salaries = [(None, None) if t is None else _match_form(t) for t in salary.to_pylist()]
            yield pa.StructArray.from_arrays([*map(match_array, forms), match_array(salaries), listed(hits, _HIT_TYPES)], FORMS.names)


def selected_hits(hits: Column) -> Column:
    """The longest alias wins, one hit per technology, no overlap within a field; then in reading order."""
    empty = F.array().cast(HITS)

    def choose(chosen: Column, hit: Column) -> Column:
        clash = F.exists(
            chosen,
            lambda c: (c["slug"] == hit["slug"])
            | ((c["field"] == hit["field"]) & (hit["start"] < c["end"]) & (hit["end"] > c["start"])),
        )
        return F.when(clash, chosen).otherwise(F.concat(chosen, F.array(hit)))

    # Only the first hit of a technology per field can matter beyond clashes, hits are few per text.
    chosen = F.aggregate(F.array_sort(hits), empty, choose)
    ordered = F.array_sort(F.transform(chosen, lambda c: F.struct(c["field"], c["start"], c["slug"], c["end"])))
    return ordered


def technology_slugs(selected: Column) -> Column:
    return F.array_sort(F.transform(selected, lambda c: c["slug"]))
