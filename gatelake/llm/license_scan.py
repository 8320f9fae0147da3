"""Licence scans: fuzzy search for short notices.

A notice of n characters that may take k edits is cut into k + 1 pieces; any match within k edits holds one piece
unchanged (pigeonhole). One automaton finds the pieces in the normalised text, and the regex library's bounded-error
matching verifies the text around each hit and gives the span.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that must stand word for word.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Short notices and the edits each may take.
NOTICES = (
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 4),
    ("licensed under the apache license version 2 0", "apache-2", 3),
    ("gnu general public license version 3", "gpl-3", 2),
    ("gnu general public license version 2", "gpl-2", 2),
    ("gnu lesser general public license version 3", "lgpl-3", 2),
    ("gnu lesser general public license version 2 1", "lgpl-2.1", 2),
    ("gnu affero general public license version 3", "agpl-3", 2),
    ("redistribution and use in source and binary forms with or without modification", "bsd", 4),
    ("mozilla public license version 2 0", "mpl-2", 2),
    ("permission to use copy modify and or distribute this software for any purpose", "isc", 4),
    ("this is free and unencumbered software released into the public domain", "unlicense", 4),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1),
    ("licensed under cc by nd 4 0", "cc-by-nd", 1),
    ("licensed under cc by 4 0", "cc-by", 1),
    ("creative commons attribution noncommercial", "cc-by-nc", 2),
    ("creative commons attribution sharealike", "cc-by-sa", 2),
)

#: Every byte below 0x80 that is neither digit nor letter becomes a space, A-Z become a-z, the rest stays.
TABLE = bytes(b if b >= 0x80 or 48 <= b < 58 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in range(256))

SPANS = "doc_id long, n_words long, base array<struct<word:long,label:string>>, spans array<struct<word:long,words:long,label:string,edits:int,likeness:double,text:string>>"


@lru_cache(maxsize=4)
def _searcher(notices: tuple[tuple[str, str, int], ...]):
    seeds: dict[str, list[tuple[int, int]]] = {}
    for i, (notice, _, k) in enumerate(notices):
        cuts = [round(j * len(notice) / (k + 1)) for j in range(k + 2)]
        for a, b in zip(cuts, cuts[1:]):
            seeds.setdefault(notice[a:b], []).append((i, a))
    find = ahocorasick.Automaton()
    for seed, where in seeds.items():
        find.add_word(seed, (len(seed), where))
    find.make_automaton()
    return find, [regex.compile(rf"(?e)(?<= )(?:{regex.escape(notice, literal_spaces=True)}){{e<={k}}}(?= )") for notice, _, k in notices]


def scan(text: bytes, notices=NOTICES, base=BASE) -> tuple[int, list[tuple[int, str]], list[tuple[int, int, str, int, float, str]]]:
    """Words, base places (word, label) and the notices' spans (word, words, label, edits, likeness, text) of one text.

    Spans that overlap give way to the one with fewer edits a character, then the earlier, then the longer one.
    """
    words = text.translate(TABLE).split()
    line = b" " + b" ".join(words) + b" "
    places: list[tuple[int, str]] = []
    gaps = None  # where words begin, found once a text has a place or a span
    for phrase, label in base:
        at, what = -1, b" " + phrase.encode() + b" "
        while (at := line.find(what, at + 1)) >= 0:
            gaps = _spaces(line) if gaps is None else gaps
            places.append((bisect_left(gaps, at), label))
    find, patterns = _searcher(notices)
    norm = line.decode("utf-8", "replace")
    tried, found = set(), set()
    for end, (size, where) in find.iter(norm):
        for i, offset in where:
            notice, label, k = notices[i]
            start = end + 1 - size - offset
            if (i, start) in tried:
                continue
            tried.add((i, start))
            # One more character on both sides than a match can reach, so both of its ends are seen to be ends of words.
            lo = max(0, start - k - 1)
            if m := patterns[i].search(norm[lo : start + len(notice) + k + 1]):
                edits = sum(m.fuzzy_counts)
                found.add((edits / len(notice), lo + m.start(), m.start() - m.end(), label, edits))
    if not found:
        return len(words), sorted(places), []
    spans, starts, ends = [], [], []
    gaps = [m.start() for m in regex.finditer(" ", norm)]
    for share, a, minus, label, edits in sorted(found):
        b = a - minus
        at = bisect_left(starts, b)  # the spans taken so far are apart, so only the last one that starts before b can reach into this one
        if at and ends[at - 1] > a:
            continue
        starts.insert(at, a)
        ends.insert(at, b)
        first = bisect_left(gaps, a)
        spans.append((first - 1, bisect_left(gaps, b) - first + 1, label, edits, 1 - share, norm[a:b]))
    return len(words), sorted(places), sorted(spans)


def _spaces(line: bytes) -> list[int]:
    return [m.start() for m in regex.finditer(b" ", line)]


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, base=BASE) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, the base places and the verified spans of the notices.

    Texts are read whole; A-Z are lower-cased and words are runs of digits, letters and all characters beyond ASCII. A
    null or empty text has no words and no spans. Of notices that overlap, the one with fewer edits a character stays, of
    equal ones the earlier, then the longer, then the first label. Very long texts and words cost time in proportion to
    their length and to their seeds. Repeated rows give repeated results, other columns (also of clashing names) are not
    read, an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for batch in batches:
            got = [scan(t or b"", notices, base) for t in batch.column(1).to_pylist()]
            kind = kind or pa.schema([
                ("doc_id", batch.schema.field(0).type), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))),
                ("spans", pa.list_(pa.struct([("word", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("edits", pa.int32()), ("likeness", pa.float64()), ("text", pa.string())]))),
            ])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _, _ in got], pa.int64()),
                pa.array([[{"word": w, "label": x} for w, x in p] for _, p, _ in got], kind.field(2).type),
                pa.array([[dict(zip(("word", "words", "label", "edits", "likeness", "text"), s)) for s in spans] for _, _, spans in got], kind.field(3).type),
            ], schema=kind)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, SPANS)
