"""Secret scans by multipart credential linking.

A credential has parts: an access identifier, a secret and an endpoint. Strong parts
(assignments of secrets, access keys, long hex runs) are reported wherever they stand.
Weak parts (account names, mixed-case random-looking runs, URLs) are reported only when a
complementary part, strong or weak, lies within the same scope: beside it, at most `scope`
characters between the two. Parts that overlap are one string and never complete each other.
The parts of a text are joined as sorted intervals in one sweep.

Defined results: a null text counts as empty; positions are code points, end exclusive;
texts are scanned whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import map_batches

KINDS = ("assign", "access", "hex", "ident", "random", "endpoint")
STRONG = KINDS[:3]
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
IDENT = re.compile(r"""(?:user_?name|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.I | re.A)
RANDOM = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?")
#: Which kinds complete a weak part of each kind.
COMPLETED_BY = {"ident": ("assign", "hex", "random"), "random": ("access", "ident", "endpoint"), "endpoint": ("assign", "hex", "random")}
#: Code points that may lie between two parts of one credential.
SCOPE = 200


def strong_parts(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the parts that stand on their own."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def weak_parts(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates that do not overlap a strong part."""
    found = [(m.start(), m.end(), "ident") for m in IDENT.finditer(text)]
    for m in RANDOM.finditer(text):
        run = m.group()
        if re.search("[0-9]", run) and re.search("[A-Z]", run) and re.search("[a-z]", run):
            found.append((m.start(), m.end(), "random"))
    if "://" in text:
        found += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if not found or not strong:
        return found
    spans = sorted((s, e) for s, e, _ in strong)
    starts, reach, most = [s for s, _ in spans], [], 0
    for _, e in spans:
        reach.append(most := max(most, e))
    return [w for w in found if not ((k := bisect_left(starts, w[1])) and reach[k - 1] > w[0])]


def linked(weak: list[tuple[int, int, str]], parts: list[tuple[int, int, str]], scope: int) -> list[tuple[int, int, str]]:
    """The weak parts that have a complementary part beside them within scope: an interval semi-join.

    Of each kind the part that ends last before a weak part and the one that starts first
    behind it are the nearest beside it; sorted ends and starts tell both by binary search."""
    by_kind = {kind: (sorted(s for s, _, k in parts if k == kind), sorted(e for _, e, k in parts if k == kind)) for kind in KINDS}

    def near(w: tuple[int, int, str], kind: str) -> bool:
        starts, ends = by_kind[kind]
        behind, before = bisect_left(starts, w[1]), bisect_right(ends, w[0])
        return (behind < len(starts) and starts[behind] <= w[1] + scope) or (before > 0 and ends[before - 1] >= w[0] - scope)

    return [w for w in weak if any(near(w, kind) for kind in COMPLETED_BY[w[2]])]


def scan(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(strong parts, linked weak parts), each by start, then kind."""
    text = text or ""
    order = lambda p: (p[0], KINDS.index(p[2]))
    strong = sorted(strong_parts(text), key=order)
    weak = weak_parts(text, strong)
    return strong, sorted(linked(weak, strong + weak, scope), key=order) if weak else []


def render(parts: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(parts, key=lambda p: (p[0], KINDS.index(p[2]))))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per input row: counts of the strong kinds, base_spans and spans (strong and linked weak)."""
    id_type = df.schema[id_col].dataType

    def per_batch(b: pa.RecordBatch) -> pa.RecordBatch:
        counts: dict[str, list[int]] = {k: [] for k in STRONG}
        base, spans = [], []
        for text in b.column(1).to_pylist():
            strong, weak = scan(text, scope)
            for k in STRONG:
                counts[k].append(sum(p[2] == k for p in strong))
            base.append(hashlib.sha256(render(strong).encode()).hexdigest())
            spans.append(render(strong + weak))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in STRONG), pa.array(base), pa.array(spans)], names=[id_col, *(f"n_{k}" for k in STRONG), "base_sha256", "spans"])

    return map_batches(df.select(id_col, text_col), per_batch, f"`{id_col}` {id_type.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
