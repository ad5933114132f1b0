"""Fill-in-the-middle over seekable compressed frames.

``store`` keeps a text as independent zstandard frames of at most ``FRAME_UNITS``
code points, with the cumulative number of units at the end of each frame. Any
span of units can then be taken without the rest of the text:

* ``span`` passes frames that lie inside the span on as they are, compressed,
  and decompresses only the (at most two) frames that a cut goes through;
* ``transform`` cuts prefix, middle and suffix that way and puts the frames in
  the order of the form, with the sentinels as frames of their own;
* ``restore`` finds the sentinels in the output by a scan that holds one frame,
  and takes the three spans back in the order of the text;
* ``sha256`` streams the frames in order and holds one of them at a time.

Every step is a map over rows (no shuffle, nothing to the driver), and a lost
task repeats only its own rows. A row costs its compressed frames plus one
decompressed frame; the text itself is held once, when ``store`` cuts it.

Cuts and forms come from ``sha256(seed:doc_id)`` alone, so reruns agree.

Defined results: null and empty texts have no frames, zero units and the form
plain; so has a text that holds a sentinel. A null doc_id hashes as the empty
text. Repeated rows are transformed each, in the same way; texts of any length
are cut by the same rule; an empty table gives an empty table. Other columns
pass; a column that bears the name of a result is replaced by the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import need

FRAME_UNITS = 32_768
LEVEL = 1
SLICE_ROWS = 256            # rows worked on at a time
SEED = "1"
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20          # of 100: plain from the one, suffix first below the other

FRAMES = T.StructType([T.StructField("ends", T.ArrayType(T.LongType(), False)),
                       T.StructField("data", T.ArrayType(T.BinaryType(), False))])
ARROW_FRAMES = pa.struct([("ends", pa.list_(pa.int64())), ("data", pa.list_(pa.binary()))])


# ---- frames of one text: lists of (units, compressed bytes)

class Codec:
    """Compressor and decompressor of a task."""

    def __init__(self, frame_units: int = FRAME_UNITS):
        self.units = frame_units
        self._out, self._in = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    def frame(self, text: str) -> tuple[int, bytes]:
        return len(text), self._out.compress(text.encode())

    def text(self, frame: bytes) -> str:
        return self._in.decompress(frame).decode()

    def cut(self, text: str) -> list[tuple[int, bytes]]:
        return [self.frame(text[a:a + self.units]) for a in range(0, len(text), self.units)]

    def span(self, frames: list[tuple[int, bytes]], first: int, last: int) -> list[tuple[int, bytes]]:
        """Frames of the units ``first`` to ``last`` (exclusive); only frames with a cut inside are opened."""
        out, at = [], 0
        for units, data in frames:
            a, b = max(first - at, 0), min(last - at, units)
            if a < b:
                out.append((units, data) if (a, b) == (0, units) else self.frame(self.text(data)[a:b]))
            at += units
        return out

    def find(self, frames: list[tuple[int, bytes]], marks: Iterable[str]) -> dict[str, int]:
        """The first unit of each mark's first place; a mark may lie across frames."""
        found, left, at, tail = {}, list(marks), 0, ""
        keep = max(map(len, left)) - 1
        for units, data in frames:
            here = tail + self.text(data)
            for m in [m for m in left if m in here]:
                found[m] = at - len(tail) + here.index(m)
                left.remove(m)
            if not left:
                break
            tail, at = here[-keep:], at + units
        return found

    def sha256(self, frames: list[tuple[int, bytes]]) -> str:
        h = hashlib.sha256()
        for _, data in frames:
            h.update(self._in.decompress(data))
        return h.hexdigest()


def to_row(frames: list[tuple[int, bytes]]) -> dict:
    ends, at = [], 0
    for units, _ in frames:
        at += units
        ends.append(at)
    return {"ends": ends, "data": [d for _, d in frames]}


def from_row(row: dict | None) -> list[tuple[int, bytes]]:
    if row is None:
        return []
    return [(b - a, d) for a, b, d in zip([0, *row["ends"]], row["ends"], row["data"], strict=False)]


# ---- the transformation of one text

def plan(doc_id: int | None, n: int, seed: str = SEED) -> tuple[int, int, bool, bool]:
    """Both cuts (units from the start), whether the draw says plain, and whether the suffix comes first."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return a, b, h3 % 100 >= PLAIN_FROM, h4 % 100 < SPM_BELOW


def arrange(codec: Codec, frames: list[tuple[int, bytes]], doc_id: int | None, seed: str = SEED):
    """Form, units of prefix and middle, and the frames of the output."""
    n = sum(u for u, _ in frames)
    a, b, plain, suffix_first = plan(doc_id, n, seed)
    if plain or not n or codec.find(frames, SENTINELS):
        return "plain", None, None, frames
    prefix, middle, suffix = codec.span(frames, 0, a), codec.span(frames, a, b), codec.span(frames, b, n)
    p, s, m = (codec.frame(x) for x in SENTINELS)
    if suffix_first:
        return "spm", a, b - a, [s, *suffix, p, *prefix, m, *middle]
    return "psm", a, b - a, [p, *prefix, s, *suffix, m, *middle]


def rebuild(codec: Codec, output: list[tuple[int, bytes]], form: str) -> list[tuple[int, bytes]]:
    """The text's frames, from the output and its form alone."""
    if form == "plain":
        return output
    at = codec.find(output, SENTINELS)
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    spans = {first: codec.span(output, at[first] + len(first), at[second]),
             second: codec.span(output, at[second] + len(second), at[MIDDLE]),
             MIDDLE: codec.span(output, at[MIDDLE] + len(MIDDLE), sum(u for u, _ in output))}
    return spans[PREFIX] + spans[MIDDLE] + spans[SUFFIX]


# ---- the jobs

def _map(df: DataFrame, added: list[tuple[str, pa.DataType, T.DataType]], work, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` without ``drop`` plus the columns that ``work(table)`` gives for a slice of rows."""
    kept = df.drop(*[n for n, _, _ in added if n not in drop])      # a clashing column is replaced
    rest = [c for c in kept.columns if c not in drop]
    schema = T.StructType([kept.schema[c] for c in rest] + [T.StructField(n, t) for n, _, t in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(first, SLICE_ROWS)
                columns = work(part, state)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in rest] + [pa.array(v, t) for v, (_, t, _) in zip(columns, added, strict=True)],
                    names=rest + [n for n, _, _ in added])

    return kept.mapInArrow(run, schema)


def _codec(state: dict, units: int = FRAME_UNITS) -> Codec:
    return state.setdefault("codec", Codec(units))


def store(docs: DataFrame, text: str = "text", out: str = "frames", frame_units: int = FRAME_UNITS) -> DataFrame:
    """``docs`` with the text replaced by its frames (``ends``: cumulative units, ``data``: zstandard)."""
    need(docs, text)

    def work(part, state):
        codec = _codec(state, frame_units)
        return [[to_row(codec.cut(t.as_py() or "")) for t in part.column(text)]]

    return _map(docs, [(out, ARROW_FRAMES, FRAMES)], work, (text,))


def take(stored: DataFrame, first: str, last: str, frames: str = "frames", out: str = "taken") -> DataFrame:
    """``stored`` plus the text of the units from ``first`` to ``last`` (exclusive), by opening the frames there only."""
    need(stored, frames, first, last)

    def work(part, state):
        codec = _codec(state)
        rows = zip(part.column(frames), part.column(first), part.column(last), strict=True)
        return [["".join(codec.text(d) for _, d in codec.span(from_row(f.as_py()), a.as_py() or 0, b.as_py() or 0))
                 for f, a, b in rows]]

    return _map(stored, [(out, pa.string(), T.StringType())], work)


def transform(stored: DataFrame, frames: str = "frames", out: str = "output", seed: str = SEED) -> DataFrame:
    """``stored`` plus ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and the output's frames."""
    need(stored, "doc_id", frames)

    def work(part, state):
        codec, columns = _codec(state), [[], [], [], [], []]
        for i, f in zip(part.column("doc_id"), part.column(frames), strict=True):
            held = from_row(f.as_py())
            form, prefix, middle, output = arrange(codec, held, i.as_py(), seed)
            for column, value in zip(columns, (sum(u for u, _ in held), form, prefix, middle, to_row(output)), strict=True):
                column.append(value)
        return columns

    return _map(stored, [("n", pa.int64(), T.LongType()), ("form", pa.string(), T.StringType()),
                         ("prefix_chars", pa.int64(), T.LongType()), ("middle_chars", pa.int64(), T.LongType()),
                         (out, ARROW_FRAMES, FRAMES)], work)


def restore(transformed: DataFrame, output: str = "output", out: str = "restored") -> DataFrame:
    """``transformed`` plus the frames of the text that its output and form give back."""
    need(transformed, output, "form")

    def work(part, state):
        codec = _codec(state)
        return [[to_row(rebuild(codec, from_row(f.as_py()), form.as_py()))
                 for f, form in zip(part.column(output), part.column("form"), strict=True)]]

    return _map(transformed, [(out, ARROW_FRAMES, FRAMES)], work)


def with_text(stored: DataFrame, frames: str, out: str = "text") -> DataFrame:
    """``stored`` plus the whole text of its frames."""
    need(stored, frames)

    def work(part, state):
        codec = _codec(state)
        return [["".join(codec.text(d) for _, d in from_row(f.as_py())) for f in part.column(frames)]]

    return _map(stored, [(out, pa.string(), T.StringType())], work)


def with_sha256(stored: DataFrame, of: dict[str, str]) -> DataFrame:
    """``stored`` plus the sha256 (lowercase hex) of the UTF-8 texts, streamed frame by frame; ``of``: result by frames."""
    need(stored, *of)

    def work(part, state):
        codec = _codec(state)
        return [[codec.sha256(from_row(f.as_py())) for f in part.column(frames)] for frames in of]

    return _map(stored, [(out, pa.string(), T.StringType()) for out in of.values()], work)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns for ``doc_id, text``."""
    both = restore(transform(store(docs.select("doc_id", "text"))))
    both = with_sha256(both, {"output": "output_sha256", "restored": "restored_sha256"})
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


# The same for DuckDB: code points by length and substring, the draws from the digest's hex groups.
ORACLE_SQL = f"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), h AS (
  SELECT doc_id, t, n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
      WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1, n - b) AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p"""
