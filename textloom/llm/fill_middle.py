"""Fill-in-the-middle examples, cut by a table-driven automaton over the bytes of a text.

A text is a sequence of units, each a run of blanks (possibly empty) and the run of other
characters behind it; blanks at the end are a unit of their own. Two places between units
cut a text into prefix, middle and suffix, which are written in one of two orders behind
the marks <P>, <S>, <M>. Which texts are cut, where and in which order follows from a hash of
a seed and the document's id alone.

One automaton reads UTF-8: its states know whether a blank, a character, the start of a
mark or the rest of a multi-byte character was read, and its transitions say where a
character begins, where a unit ends and where a mark is complete. Texts are laid out in
lanes of LANE bytes that advance side by side, one table lookup a byte for all lanes; as
any three bytes fix the state, each lane starts three bytes early. The first pass counts
the transitions of each lane, which gives units, characters and marks of every text. The
second pass runs only through the lanes in which a cut lies and finds its byte.

Scale: one narrow pass, no shuffle, linear in the text; a task holds one Arrow batch (at most
1,000 rows or 8 MB, or one longer text) and a few times its bytes.

Defined results: a null or empty text has no units, is plain and stays as it is; a text that
holds a mark is plain; a null id counts as an empty one; repeated rows give repeated
results; other input columns are ignored. Bytes that are no UTF-8 count as a character each,
a character cut short as one.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import map_batches, sha256_hex

#: The marks, the seed, and the shares in percent of cut texts and of the order <S><P><M> among them.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 42
CUT_SHARE, SPM_SHARE = 50, 80
#: Bytes of a lane; below 1,024, since three counts share 32 bits.
LANE = 128
#: So many bytes fix the state, whatever it was.
SYNC = 3

BLANK, WORD, OPENED, NAMED, REST1, REST2, REST3 = range(7)
CLASSES = 16
BEGINS, ENDS, MARKS = 1, 1 << 10, 1 << 20


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every byte: blank, <, the mark's letter, >, other ASCII, leads of 2 to 4 bytes, continuation, filling."""
    of = np.full(256, 4, np.uint8)
    of[[0x20, *range(0x09, 0x0E)]] = 0
    of[ord("<")], of[ord(">")] = 1, 3
    of[[ord(c) for c in "PSM"]] = 2
    of[0xC0:0xE0], of[0xE0:0xF0], of[0xF0:0xF8], of[0x80:0xC0] = 5, 6, 7, 8
    of[0xF8:0xFF], of[0xFF] = 4, 9
    return of


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, counts) by state * CLASSES + class; a count of 1 for each kind of event, in its own bits."""
    after, counts = np.zeros(7 * CLASSES, np.uint8), np.zeros(7 * CLASSES, np.int32)
    for state in range(7):
        for kind in range(10):
            at = state * CLASSES + kind
            if kind == 9:  # filling behind a text
                after[at] = state
            elif kind == 8 and state >= REST1:  # inside a character
                after[at] = WORD if state == REST1 else state - 1
            else:
                read = WORD if state >= REST1 else state
                after[at] = {0: BLANK, 1: OPENED, 2: NAMED if read == OPENED else WORD, 5: REST1, 6: REST2, 7: REST3}.get(kind, WORD)
                counts[at] = BEGINS + (ENDS if kind == 0 and read != BLANK else 0) + (MARKS if kind == 3 and read == NAMED else 0)
    return after, counts


class Lanes:
    """Texts of a batch side by side: each starts a lane of its own and takes as many as it needs."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts], np.int64)
        per_text = np.maximum(1, -(-self.lengths // LANE))
        self.first = np.concatenate(([0], np.cumsum(per_text)))
        filled = b"".join(t.ljust(int(n) * LANE, b"\xff") for t, n in zip(texts, per_text, strict=True))
        of = classes()[np.frombuffer(filled, np.uint8)].reshape(-1, LANE)
        early = np.full((len(of), SYNC), 9, np.uint8)
        early[1:] = of[:-1, -SYNC:]
        early[self.first[:-1]] = 9
        self.bytes = np.hstack((early, of))

    def states(self, lanes: np.ndarray | slice) -> tuple[np.ndarray, np.ndarray]:
        """The lanes' bytes by column, and the states they start from."""
        after, _ = transitions()
        rows = np.ascontiguousarray(self.bytes[lanes].T)
        state = np.zeros(rows.shape[1], np.uint8)
        for column in rows[:SYNC]:
            state = after[state * np.uint8(CLASSES) + column]
        return rows[SYNC:], state

    def count(self) -> np.ndarray:
        """First pass: (lane, kind of event) -> number."""
        after, counts = transitions()
        rows, state = self.states(slice(None))
        total = np.zeros(rows.shape[1], np.int32)
        for column in rows:
            at = state * np.uint8(CLASSES) + column
            total += counts[at]
            state = after[at]
        return np.column_stack((total & 1023, total >> 10 & 1023, total >> 20)).astype(np.int64)

    def find(self, lanes: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Second pass: byte within the lane of its nth end of a unit (from 1), and the characters before that byte."""
        after, counts = transitions()
        rows, state = self.states(lanes)
        place, before = np.zeros(len(lanes), np.int64), np.zeros(len(lanes), np.int64)
        seen = np.zeros(len(lanes), np.int32)
        for k, column in enumerate(rows):
            at = state * np.uint8(CLASSES) + column
            c = counts[at]
            hit = (c & ENDS != 0) & ((seen >> 10 & 1023) == nth - 1)
            place[hit], before[hit] = k, seen[hit] & 1023
            seen += c
            state = after[at]
        return place, before


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def arranged(texts: list[bytes], ids: list[int | None], seed: int, cut_share: int, spm_share: int) -> list[tuple]:
    """(n, form, prefix characters, middle characters, output) of each text."""
    lanes = Lanes(texts)
    per_lane = lanes.count()
    upto = np.vstack((np.zeros((1, 3), np.int64), np.cumsum(per_lane, axis=0)))
    totals = upto[lanes.first[1:]] - upto[lanes.first[:-1]]
    units = np.where(lanes.lengths > 0, totals[:, 1] + 1, 0)
    drawn = [draws(i, seed) for i in ids]
    plain = (units == 0) | (totals[:, 2] > 0) | np.array([h[2] % 100 >= cut_share for h in drawn], bool)
    cut = np.flatnonzero(~plain)
    picked = np.array([sorted((drawn[i][0] % (int(units[i]) + 1), drawn[i][1] % (int(units[i]) + 1))) for i in cut], np.int64).reshape(-1, 2)
    places, chars = np.zeros((len(cut), 2), np.int64), np.zeros((len(cut), 2), np.int64)
    for side in range(2):
        k = picked[:, side]
        whole = k == units[cut]
        places[whole, side], chars[whole, side] = lanes.lengths[cut[whole]], totals[cut[whole], 0]
        inner = np.flatnonzero((k > 0) & ~whole)
        first = lanes.first[cut[inner]]
        wanted = upto[first, 1] + k[inner]  # the end of a unit that the text's lanes count as their k-th
        lane = np.searchsorted(upto[:, 1], wanted, "left") - 1
        at, before = lanes.find(lane, wanted - upto[lane, 1])
        places[inner, side] = (lane - first) * LANE + at
        chars[inner, side] = upto[lane, 0] - upto[first, 0] + before
    out: list[tuple] = [(int(n), "plain", None, None, text) for n, text in zip(units, texts, strict=True)]
    for i, (a, b), (ca, cb) in zip(cut.tolist(), places.tolist(), chars.tolist(), strict=True):
        text, spm = texts[i], drawn[i][3] % 100 < spm_share
        head, middle, tail = text[:a], text[a:b], text[b:]
        joined = SUFFIX + tail + PREFIX + head + MIDDLE + middle if spm else PREFIX + head + SUFFIX + tail + MIDDLE + middle
        out[i] = (int(units[i]), "spm" if spm else "psm", ca, cb - ca, joined)
    return out


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, cut_share: int = CUT_SHARE, spm_share: int = SPM_SHARE) -> DataFrame:
    """One row per input row: (id, n, form, prefix_chars, middle_chars, output); form is plain, psm or spm."""
    kind = df.schema[id_col].dataType.simpleString()

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
        n, form, prefix, middle, output = zip(*arranged(texts, b.column(0).to_pylist(), seed, cut_share, spm_share), strict=True)
        columns = [b.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).view(pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(df.select(id_col, text_col), per_batch, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text behind an output: its parts, which hold no marks, in their first order."""
    parts = F.split(output, "<[PSM]>", 4)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def fill_digest(df: DataFrame) -> DataFrame:
    """fill_in_middle() with hashes in place of the texts."""
    made = fill_in_middle(df)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha256_hex(F.col("output")).alias("output_sha256"), sha256_hex(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
