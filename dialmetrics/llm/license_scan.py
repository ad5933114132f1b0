"""License scans by conditional compression.

The words around each cue, as many on both sides as the longest template can span,
form the candidate blocks; lines do not matter, so a notice may be wrapped or stand
behind comment marks. In a block, a window slides for each template over as many words
as its wording may span; where the window holds ``MIN_SHARE`` of the template's words,
the words of template and window are aligned, and the span is kept if enough of them
agree in order. The text of that span alone, its lines joined, is compressed by itself
and with every template as zstandard raw-content dictionary; templates are ranked by how
many bytes they save, so other text around a notice does not count. The winner has
the most agreeing words less those that differ; among equals, the first in rank. The result tells which words are
missing and which were put in between.

Every template has a cue, and no wording that is confirmed reaches further from it than
a block does. Whole texts are scanned; a block longer than ``BLOCK_WORDS`` words is
scored in pieces that overlap by the longest span.

Defined results: null and empty texts give no row; a text that repeats a notice
gives a row for each place; repeated rows give repeated results; an empty table
gives an empty table.
"""

from __future__ import annotations

import bisect
import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import need

# Public licence notices (name, wording), in natural order.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the software without restriction."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, "
                     "are permitted provided that the copyright notice is retained."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated this work to the public domain."),
    ("all-rights-reserved", "All rights reserved."),
)
CUES = ("licens", "licenc", "permission is", "copyright", "public domain", "rights reserved")
BLOCK_WORDS = 1024
MIN_SAVED = 0.2         # least share of the span's compressed bytes that a template saves
MIN_SHARE = 0.8         # least share of equal words, of the template and of the span it covers
LEVEL = 3

WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
GAP = r"[\W_]+"          # between the words of a cue: a line's end, comment marks
CUE = re.compile("|".join(GAP.join(map(re.escape, c.split())) for c in CUES), re.IGNORECASE)
BREAK = re.compile(r"\s*\n[\W_]*")


def blocks(text: str, found: list[tuple[str, int, int]], reach: int) -> Iterator[tuple[int, int]]:
    """Ranges of the ``found`` words that lie within ``reach`` words of a cue."""
    starts, n = [a for _, a, _ in found], len(found)
    runs: list[list[int]] = []
    for m in CUE.finditer(text):
        a = max(0, bisect.bisect_right(starts, m.start()) - 1 - reach)
        b = min(n, bisect.bisect_left(starts, m.end()) + reach)
        if runs and a <= runs[-1][1]:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    for a, b in runs:
        while b - a > BLOCK_WORDS + reach:
            yield a, a + BLOCK_WORDS + reach
            a += BLOCK_WORDS
        yield a, b


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), *m.span()) for m in WORD.finditer(text)]


class Scanner:
    """The templates, each as a dictionary of a compressor."""

    def __init__(self, templates=TEMPLATES, level: int = LEVEL):
        flags = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**flags)
        self.templates = []
        for name, wording in templates:
            raw = zstandard.ZstdCompressionDict(wording.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.templates.append((name, [w for w, _, _ in words(wording)],
                                   zstandard.ZstdCompressor(dict_data=raw, **flags)))
        self.bags = [Counter(want) for _, want, _ in self.templates]
        self.spans = [math.ceil(len(want) / MIN_SHARE) for _, want, _ in self.templates]
        self.reach = max(self.spans)

    def ranked(self, block: bytes) -> list[tuple[float, int]]:
        """(share of bytes saved, template) of those that save enough, best first."""
        block = block.lower()
        alone = len(self.plain.compress(block))
        saved = [((alone - len(c.compress(block))) / alone, i) for i, (_, _, c) in enumerate(self.templates)]
        return sorted((x for x in saved if x[0] >= MIN_SAVED), key=lambda x: (-x[0], x[1]))

    def windows(self, have: list[str], template: int) -> Iterator[tuple[int, int]]:
        """Ranges of words that hold enough of the template's words in any order: the best of each stretch."""
        bag, span = self.bags[template], self.spans[template]
        least, held, equal = math.ceil(MIN_SHARE * len(self.templates[template][1]) - 1e-9), Counter(), 0
        best = None
        for end, w in enumerate(have, 1):
            if w in bag:
                held[w] += 1
                equal += held[w] <= bag[w]
            if end > span and (old := have[end - 1 - span]) in bag:
                equal -= held[old] <= bag[old]
                held[old] -= 1
            if equal >= least:
                if best is None or equal > best[0]:
                    best = equal, max(0, end - span), end
            elif best is not None:
                yield best[1:]
                best = None
        if best is not None:
            yield best[1:]

    def confirm(self, found: list[tuple[str, int, int]], template: int) -> dict | None:
        """How the block's words differ from the template's; None where too few agree."""
        want = self.templates[template][1]
        have = [w for w, _, _ in found]
        parts = [m for m in difflib.SequenceMatcher(None, want, have, autojunk=False).get_matching_blocks() if m.size]
        if not parts:
            return None

        def fit(i: int, j: int) -> tuple[float, int]:
            equal = sum(m.size for m in parts[i:j])
            return equal / (len(want) + parts[j - 1].b + parts[j - 1].size - parts[i].b - equal), equal

        # words that agree by chance before or behind the notice are left out
        i, j = max(((i, j) for i in range(len(parts)) for j in range(i + 1, len(parts) + 1)), key=lambda x: fit(*x))
        parts, equal = parts[i:j], fit(i, j)[1]
        if equal < MIN_SHARE * len(want):
            return None
        first, last = parts[0].b, parts[-1].b + parts[-1].size
        if equal < MIN_SHARE * (last - first):
            return None
        in_want = {i for m in parts for i in range(m.a, m.a + m.size)}
        in_have = {i for m in parts for i in range(m.b, m.b + m.size)}
        missing = [w for i, w in enumerate(want) if i not in in_want]
        extra = [have[i] for i in range(first, last) if i not in in_have]
        return {"words": (first, last), "start": found[first][1], "end": found[last - 1][2],
                "similarity": equal / (len(want) + len(extra)), "missing": " ".join(missing),
                "extra": " ".join(extra), "score": equal - len(missing) - len(extra)}

    def scan(self, text: str) -> list[dict]:
        """All notices of a text, by place."""
        every, out = words(text), []
        have = [w for w, _, _ in every]
        for a, b in blocks(text, every, self.reach):
            todo = [(a, b)]
            while todo:     # what lies before and after a winner is scored again: a block may hold several
                x, y = todo.pop()
                ranks: dict[tuple, dict] = {}
                won = []
                for t in range(len(self.templates)):
                    for i, j in self.windows(have[x:y], t):
                        if (c := self.confirm(every[x + i:x + j], t)) is None:
                            continue
                        span = c["start"], c["end"]
                        if span not in ranks:
                            piece = BREAK.sub(" ", text[slice(*span)]).encode()
                            ranks[span] = {k: (r, saved) for r, (saved, k) in enumerate(self.ranked(piece), 1)}
                        if t in ranks[span]:
                            won.append((-c["score"], ranks[span][t][0], c["start"], t, x + i, c, ranks[span][t][1]))
                if not won:
                    continue
                _, rank, _, t, at, c, saved = min(won, key=lambda z: z[:4])
                out.append((c["score"], {
                    "start": c["start"], "end": c["end"], "license": self.templates[t][0], "rank": rank, "saved": saved,
                    "similarity": c["similarity"], "missing": c["missing"], "extra": c["extra"],
                    "exact": not c["missing"] and not c["extra"]}))
                todo += [(x, at + c["words"][0]), (at + c["words"][1], y)]
        # pieces overlap: what one of them cut is whole in the other
        kept, ends, starts = [], [], []
        for _, r in sorted(out, key=lambda r: (-r[0], r[1]["start"])):
            k = bisect.bisect_left(starts, r["start"])
            if (k == 0 or ends[k - 1] <= r["start"]) and (k == len(starts) or r["end"] <= starts[k]):
                starts.insert(k, r["start"])
                ends.insert(k, r["end"])
                kept.append(r)
        return sorted(kept, key=lambda r: r["start"])


SCHEMA = ("doc_id long, notice int, start long, end long, license string, rank int, saved double, "
          "similarity double, missing string, extra string, exact boolean")


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """A row for each notice in ``doc_id, text``; offsets are code points."""
    need(docs, "doc_id", "text")
    cue = F.col("text").rlike(f"(?iu){CUE.pattern}")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for n, r in enumerate(scanner.scan(text.as_py())):
                    rows.append({"doc_id": doc_id, "notice": n} | r)
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("doc_id", pa.int64()), ("notice", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                ("license", pa.string()), ("rank", pa.int32()), ("saved", pa.float64()),
                ("similarity", pa.float64()), ("missing", pa.string()), ("extra", pa.string()),
                ("exact", pa.bool_())]))

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .where(cue).mapInArrow(scan, SCHEMA))
