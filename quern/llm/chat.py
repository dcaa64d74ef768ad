"""Chat formatting by incremental black-box rendering.

A template is any function from a list of {role, text} to a string. Successive turn prefixes are rendered;
what a prefix adds to the one before it is that turn's piece, and a second rendering with a probe in the
place of the turn's text shows where in the piece the text lies. A template whose longer output does not
begin with the shorter one, or whose piece does not hold the text between the probe's surroundings, rewrites
history; its turns are marked ``rewritten`` and carry no loss. Every prefix of a conversation is rendered,
at a cost that grows with the square of its turns, unless the template is declared local
(``template.local = True``): a turn's piece then depends on that turn alone, and long conversations are rendered
in windows that share a few turns, whose pieces must agree.

Rows are dealt by conversation and sorted by turn, and stream through a worker, which holds one window of
turns, or a conversation where the template is not local. Order: turn (nulls first), then role, then text. Nulls: a null text or role is empty, a null
conv_id is a conversation of its own. Repeated rows are turns of their own; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

PIECES = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("position", T.LongType()),
        T.StructField("role", T.StringType()),
        T.StructField("piece", T.StringType()),
        T.StructField("text_start", T.LongType()),
        T.StructField("text_end", T.LongType()),
        T.StructField("loss", T.BooleanType()),
        T.StructField("rewritten", T.BooleanType()),
    ]
)
DIGEST = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("rewrites_history", T.BooleanType()),
    ]
)
#: Turns of a window, and turns that two windows share.
WINDOW, SHARED = 32, 4
_PROBE = "\ue000probe\ue001"

_OPEN, _CLOSE = "<|im_start|>", "<|im_end|>"
_PIECE = re.compile(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left in the result: each gets one more backslash inside."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def marked_turns(turns: list[Turn]) -> str:
    """The default template: marked turns, control strings inside texts escaped."""
    return "".join(f"{_OPEN}{escape_role(role)}\n{escape(text)}{_CLOSE}\n" for role, text in turns)


marked_turns.local = True


def read_piece(piece: str) -> Turn:
    """Role and text back from a piece of ``marked_turns``."""
    m = _PIECE.fullmatch(piece)
    return unescape_role(m[1]), unescape(m[2])


def _pieces(turns: list[Turn], template: Template) -> list[tuple[str, int, int, bool]]:
    """(piece, text start, text end, rewritten) of the turns, by rendering prefixes."""
    out = []
    before = ""
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        probed = template([*turns[: k - 1], (turns[k - 1][0], _PROBE)])
        if not now.startswith(before):
            out.append((now, 0, 0, True))
        else:
            piece = now[len(before) :]
            head, mark, tail = probed[len(before) :].partition(_PROBE)
            whole = probed.startswith(before) and mark and len(piece) >= len(head) + len(tail) and piece.startswith(head) and piece.endswith(tail)
            out.append((piece, len(head), len(piece) - len(tail), False) if whole else (piece, 0, 0, True))
        before = now
    return out


def locate(turns: Iterator[Turn], template: Template, window: int = WINDOW, shared: int = SHARED) -> Iterator[tuple[str, str, int, int, bool]]:
    """(role, piece, text start, text end, rewritten) of each turn under a local template; at most a window of turns is held."""
    held: list[Turn] = []
    last: list[tuple] = []
    turns = iter(turns)
    first = True
    while True:
        fresh = [t for _, t in zip(range(window - len(held)), turns)]
        if not fresh:
            return
        now = held + fresh
        got = _pieces(now, template)
        # The first shared turn opens the window and may look different there; those after it must agree.
        if not first and got[1 : len(held)] != last[1:]:
            raise ValueError("the template is declared local but looks back")
        yield from ((r, *g) for (r, _), g in zip(fresh, got[len(held) :], strict=True))
        held, last, first = now[-shared:], got[-shared:], False
        if len(now) < window:
            return


def _located(turns: Iterator[Turn], template: Template) -> Iterator[tuple]:
    if getattr(template, "local", False):
        yield from locate(turns, template)
    else:
        whole = list(turns)
        yield from ((r, *g) for (r, _), g in zip(whole, _pieces(whole, template), strict=True))


def format_turns(df: DataFrame, template: Template = marked_turns, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn in order: conv_id, position, role, piece, text_start, text_end (in the piece), loss, rewritten.

    The pieces of a conversation, joined, are its formatted text. Rows stay dealt by conversation and sorted.
    """
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for conv, group in groupby(stream, key=lambda x: x[0]):
            for k, (role, piece, start, end, rewritten) in enumerate(_located(((r, t) for _, r, t in group), template)):
                out.append((conv, k, role, piece, start, end, role in loss_roles and not rewritten, rewritten))
                if len(out) >= 1000:
                    yield _batch(out, PIECES)
                    out = []
        if out:
            yield _batch(out, PIECES)

    return dealt.mapInArrow(run, PIECES)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)


def digest(pieces: DataFrame) -> DataFrame:
    """Per conversation what can be read back from the pieces of ``format_turns`` under the default template.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_history. ``pieces``
    must come straight from ``format_turns`` (dealt by conversation, sorted).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out: list[tuple] = []
        for conv, group in groupby(stream, key=lambda x: x[0]):
            turns, loss, n, chars, under, rewrites = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
            for _, _, _, piece, start, end, masked, rewritten in group:
                role, text = read_piece(piece)
                turns.update(f"{role}\n{text}\n".encode())
                n, chars, rewrites = n + 1, chars + len(piece), rewrites or rewritten
                if masked:
                    plain = unescape(piece[start:end])
                    loss.update(plain.encode())
                    under += len(plain)
            out.append((conv, n, turns.hexdigest(), under, loss.hexdigest(), chars, rewrites))
            if len(out) >= 1000:
                yield _batch(out, DIGEST)
                out = []
        if out:
            yield _batch(out, DIGEST)

    return pieces.mapInArrow(run, DIGEST)
