"""Fill-in-the-middle: texts cut into prefix, middle and suffix at line ends and put together in another order.

All texts of an Arrow batch lie one after the other in one byte buffer. A scan of it finds the line ends and with them
the two cuts of every text. Each piece moves as a whole, so a difference array that is zero except where a piece begins
describes the move of the batch: its running sum is the displacement of every byte, and one numpy scatter writes the
outputs (the markers go into the gaps). The way back finds the markers in an output, builds the displacement of the
pieces in the same way, and gathers.

No row depends on another one, so there is no shuffle. The displacements of ``BLOCK`` bytes exist at a time, whatever
the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import sliced

BLOCK = 1 << 20
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
FORMS = np.array([PLAIN, PSM, SPM])
_MARK = len(PREFIX)


def draws(doc_id: Column, seed: int) -> Column:
    """The first four 8-digit groups of the hex sha256 of ``<seed>:<doc_id>`` as unsigned integers; null counts as ''."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(df: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 7, rate: int = 100,
                   spm_rate: int = 50) -> DataFrame:
    """All columns of ``df``, and n (lines), form, prefix_chars, middle_chars (code points) and output.

    A text is rearranged if a draw of its id falls below ``rate`` percent, and then in suffix-first order (spm) if
    another falls below ``spm_rate`` percent, else prefix-first (psm). Empty texts and texts that hold a marker are
    plain: the output is the text and the counts are null. A null text is an empty one. The draws depend on the id
    alone, so repeated rows have equal results; rows with a null id draw alike. Input columns named like an output
    column are replaced; an empty table gives an empty one.
    """
    own = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kept = [c for c in df.columns if c not in own]
    source = df.select(*(F.col(c) for c in kept), F.coalesce(df[text], F.lit("")).alias("_text"),
                       draws(df[doc_id], seed).alias("_draws"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("n", T.LongType()),
                           T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
                           T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            data, ends = buffer(batch.column(len(kept)))
            drawn = batch.column(len(kept) + 1).flatten().to_numpy().reshape(-1, 4)
            n, form, cuts = choose(data, ends, drawn, rate, spm_rate)
            prefix, middle = piece_chars(data, ends, cuts)
            plain = form == 0
            out, out_ends = arrange(data, ends, form, cuts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)], pa.array(n), pa.array(FORMS[form]), pa.array(prefix, mask=plain),
                 pa.array(middle, mask=plain), strings(out, out_ends)], names=schema.names)

    return source.mapInArrow(run, schema)


def restored(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """All columns of ``df`` and ``out``, the text that ``output`` was made of, from output and form alone.

    Null where output or form is null, and where a psm or spm output does not hold each marker once in its order.
    A column named like ``out`` is replaced; repeated rows stay.
    """
    kept = [c for c in df.columns if c != out]
    source = df.select(*(F.col(c) for c in kept), df[output].alias("_output"), df[form].alias("_form"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            outputs, forms = batch.column(len(kept)), batch.column(len(kept) + 1)
            data, ends = buffer(outputs.fill_null(""))
            names = forms.fill_null("").to_numpy(zero_copy_only=False)
            kind = sum(i * (names == f) for i, f in enumerate(FORMS)).astype(np.int64)
            back, back_ends, whole = rebuild(data, ends, kind)
            whole &= outputs.is_valid().to_numpy(zero_copy_only=False) & np.isin(names, FORMS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], strings(back, back_ends, whole)],
                                             names=schema.names)

    return source.mapInArrow(run, schema)


# ------------------------------------------------------------------- one batch

def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and n + 1 offsets that end them."""
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1, offset=8 * texts.offset)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[ends[0]:ends[-1]] if raw else np.zeros(0, dtype=np.uint8)
    return data, ends - ends[0]


def strings(data: np.ndarray, ends: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The string array of texts that lie one after the other; rows that are not ``valid`` are null."""
    mask = None if valid is None or valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little"))
    whole = pa.Array.from_buffers(pa.large_string(), len(ends) - 1,
                                  [mask, pa.py_buffer(np.ascontiguousarray(ends)), pa.py_buffer(data)])
    return whole.cast(pa.string())


def markers(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, letter and first byte of every marker that lies in one text."""
    at = np.flatnonzero(data[:max(0, len(data) - 2)] == PREFIX[0])
    letter = data[at + 1]
    at = at[(data[at + 2] == PREFIX[2]) & np.isin(letter, [PREFIX[1], SUFFIX[1], MIDDLE[1]])]
    row = np.searchsorted(ends, at, side="right") - 1
    inside = at + _MARK <= ends[row + 1]
    at, row = at[inside], row[inside]
    return row, data[at + 1], at


def choose(data: np.ndarray, ends: np.ndarray, drawn: np.ndarray, rate: int, spm_rate: int):
    """Lines, form (index into ``FORMS``) and the two cuts (byte positions) of every text."""
    first, last = ends[:-1], ends[1:]
    line_ends = np.flatnonzero(data == 10)
    low, high = np.searchsorted(line_ends, first), np.searchsorted(line_ends, last)
    full = last > first
    tail = full.copy()
    tail[full] = data[last[full] - 1] != 10
    n = high - low + tail
    picks = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)

    def after(units: np.ndarray) -> np.ndarray:
        inner = np.where(units > 0, low + units - 1, 0)
        by_line = line_ends[np.minimum(inner, len(line_ends) - 1)] + 1 if len(line_ends) else np.zeros_like(first)
        return np.where(units == 0, first, np.where(units <= high - low, by_line, last))

    marked = np.zeros(len(first), dtype=bool)
    marked[markers(data, ends)[0]] = True
    plain = ~full | marked | (drawn[:, 2] % 100 >= rate)
    form = np.where(plain, 0, np.where(drawn[:, 3] % 100 < spm_rate, 2, 1))
    return n.astype(np.int64), form, (after(picks[:, 0]), after(picks[:, 1]))


def piece_chars(data: np.ndarray, ends: np.ndarray, cuts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every prefix and middle."""
    points = np.column_stack([ends[:-1], *cuts]).ravel()  # ascending
    before, seen = np.zeros(len(points), dtype=np.int64), 0
    for lo in range(0, len(data) + 1, BLOCK):
        sums = np.zeros(min(BLOCK, len(data) - lo) + 1, dtype=np.int64)
        np.cumsum((data[lo:lo + BLOCK] & 0xC0) != 0x80, out=sums[1:])
        a, b = np.searchsorted(points, [lo, lo + BLOCK])
        before[a:b] = seen + sums[points[a:b] - lo]
        seen += sums[-1]
    before = before.reshape(-1, 3)
    return before[:, 1] - before[:, 0], before[:, 2] - before[:, 1]


def displacements(starts: np.ndarray, shifts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first byte, place of each byte after its shift) of every block of ``size`` bytes.

    ``shifts[i]`` holds from byte ``starts[i]`` (ascending; of equal ones, the last counts) to the next start.
    """
    steps, carry = np.diff(shifts, prepend=0), 0
    for lo in range(0, size, BLOCK):
        hi = min(lo + BLOCK, size)
        moved = np.zeros(hi - lo, dtype=np.int64)
        a, b = np.searchsorted(starts, [lo, hi])
        np.add.at(moved, starts[a:b] - lo, steps[a:b])
        moved[0] += carry
        np.cumsum(moved, out=moved)
        carry = moved[-1]
        yield lo, moved + np.arange(lo, hi)


def arrange(data: np.ndarray, ends: np.ndarray, form: np.ndarray, cuts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of all texts, one after the other, and their offsets."""
    first, last, (a, b) = ends[:-1], ends[1:], cuts
    out_ends = np.concatenate([[0], np.cumsum(last - first + 3 * _MARK * (form > 0))]).astype(np.int64)
    at, prefix, suffix = out_ends[:-1], a - first, last - b
    psm = form == 1
    lead = np.where(psm, prefix, suffix)             # bytes of the piece that comes first
    second, third = at + _MARK + lead, at + 2 * _MARK + prefix + suffix   # where the next markers go
    to_prefix = np.where(psm, at + _MARK, second + _MARK)
    to_suffix = np.where(psm, second + _MARK, at + _MARK)
    shifts = np.column_stack([to_prefix - first, third + _MARK - a, to_suffix - b])
    shifts[form == 0] = (at - first)[form == 0][:, None]
    out = np.empty(out_ends[-1], dtype=np.uint8)
    for lo, place in displacements(np.column_stack([first, a, b]).ravel(), shifts.ravel(), len(data)):
        out[place] = data[lo:lo + len(place)]
    cut = form > 0
    for mark, spots in ((PREFIX, np.where(psm, at, second)), (SUFFIX, np.where(psm, second, at)), (MIDDLE, third)):
        out[spots[cut][:, None] + np.arange(_MARK)] = np.frombuffer(mark, dtype=np.uint8)
    return out, out_ends


def rebuild(data: np.ndarray, ends: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts behind the outputs, their offsets, and which outputs are whole (others come back empty)."""
    first, last = ends[:-1], ends[1:]
    row, letter, at = markers(data, ends)
    spot, whole = {}, form == 0
    once = np.ones(len(first), dtype=bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        mine = letter == mark[1]
        once &= np.bincount(row[mine], minlength=len(first)) == 1
        spot[mark] = first.copy()
        spot[mark][row[mine]] = at[mine]
    p, s, m = spot[PREFIX], spot[SUFFIX], spot[MIDDLE]
    psm = form == 1
    lead, follow = np.where(psm, p, s), np.where(psm, s, p)
    cut = (form > 0) & once & (lead == first) & (follow > lead) & (m > follow)
    whole = whole | cut
    begin = np.column_stack([p + _MARK, m + _MARK, s + _MARK])           # prefix, middle, suffix in the output
    end = np.column_stack([np.where(psm, s, m), last, np.where(psm, m, p)])
    plain = form == 0
    begin[plain], end[plain] = first[plain][:, None], np.column_stack([last, first, first])[plain]
    begin[~whole], end[~whole] = 0, 0
    sizes = end - begin
    piece_starts = np.concatenate([[0], np.cumsum(sizes.ravel())[:-1]]).reshape(-1, 3) if len(first) else sizes
    back_ends = np.concatenate([[0], np.cumsum(sizes.sum(axis=1))]).astype(np.int64)
    back = np.empty(back_ends[-1], dtype=np.uint8)
    for lo, place in displacements(piece_starts.ravel(), (begin - piece_starts).ravel(), len(back)):
        back[lo:lo + len(place)] = data[place]
    return back, back_ends, whole
