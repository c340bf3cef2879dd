"""Chat formatting with typed content parts.

A message has a role and either a text or an ordered list of typed parts (text, image, audio, document).  A visitor
flattens the parts: text is escaped, every other part becomes a placeholder ``<|image|>``, ``<|audio|>`` or
``<|document|>`` in its place, with a record of the attachment it stands for and of the number of tokens it
expands to.  The template writes ``<|turn|>role`` LF text ``<|end|>`` LF for each turn.

Control strings inside texts are escaped reversibly: after the first character of a control string, and after any
backslashes that already follow it there, one more backslash is put, and reading back takes one away.  So
``[INST]`` becomes ``[\\INST]`` and ``[\\INST]`` becomes ``[\\\\INST]``; all other text stays as it is.

The output is one row per turn, in ``(conversation, place)`` order the formatted conversation when joined, with the
span of the loss mask in code points of the piece and the piece's offset in the conversation.  A conversation is
never put together in one row: its rows pass through a task one Arrow batch at a time, so one that holds a third of
all rows needs time there but no memory.

Defined cases: null text and null parts are empty; a null role is the empty role; rows are in the order of (turn, role,
text), null first, so repeated rows stay and agree between reruns; a null conversation id is a conversation
of its own; a part of unknown type is an error; empty tables give empty results; further columns pass through, and an
input column named like an output column is replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's marks and the marks of common other templates.
TURN, END = "<|turn|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = [TURN, END, *PLACEHOLDERS.values(), "<s>", "</s>", "[INST]", "[/INST]", "<SYS>>", "</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]

PART = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("ref", T.StringType()),
        T.StructField("width", T.LongType()),
        T.StructField("height", T.LongType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("pages", T.LongType()),
    ]
)
ATTACHMENT = T.StructType(
    [T.StructField("place", T.LongType()), T.StructField("type", T.StringType()), T.StructField("ref", T.StringType()), T.StructField("char_start", T.LongType()), T.StructField("n_tokens", T.LongType())]
)


def _pattern(rest_prefix: str) -> re.Pattern:
    by_first: dict[str, list[str]] = {}
    for c in CONTROLS:
        if c[0] in c[1:] or any(c[0] in other[1:] for other in CONTROLS):
            raise ValueError(f"control string {c!r}: a first character inside another control string can't be escaped")
        by_first.setdefault(c[0], []).append(re.escape(c[1:]))
    # only the first character (and, for reading, one backslash) is consumed, so neighbours don't hide each other
    return re.compile("|".join(f"{re.escape(a)}{rest_prefix}(?=\\\\*(?:{'|'.join(rest)}))" for a, rest in by_first.items()))


_ESCAPE, _UNESCAPE = _pattern(""), _pattern(r"\\")
_FIRSTS = {c[0] for c in CONTROLS}


def escape(text: str) -> str:
    """``text`` without any control string."""
    return _ESCAPE.sub(lambda m: m.group() + "\\", text) if any(c in text for c in _FIRSTS) else text


def unescape(text: str) -> str:
    """The inverse of ``escape``."""
    return _UNESCAPE.sub(lambda m: m.group()[0], text) if "\\" in text else text


@dataclass
class Visitor:
    """Flattens parts in order; ``size_*`` give the tokens a placeholder expands to (parameters of the model)."""

    patch: int = 28  # pixels a side of an image patch that becomes one token
    audio_rate: float = 25.0  # tokens a second
    page_tokens: int = 576  # tokens a document page
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)
    length: int = 0

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        method = getattr(self, f"visit_{kind}", None)
        if method is None:
            raise ValueError(f"unknown content part {kind!r}")
        method(part)

    def _add(self, s: str) -> None:
        self.pieces.append(s)
        self.length += len(s)

    def _attach(self, kind: str, part: dict, n: int) -> None:
        self.attachments.append({"place": len(self.attachments), "type": kind, "ref": part.get("ref"), "char_start": self.length, "n_tokens": n})
        self._add(PLACEHOLDERS[kind])

    def visit_text(self, part: dict) -> None:
        self._add(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda v: max(1, math.ceil((v or 0) / self.patch))
        self._attach("image", part, side(part.get("width")) * side(part.get("height")))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0.0) * self.audio_rate)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens)


def merge_escapes(parts: list[dict]) -> list[dict]:
    """Neighbouring text parts as one, so that a control string split over two of them is escaped too."""
    out: list[dict] = []
    for p in parts:
        if (p.get("type") or "text") == "text" and out and (out[-1].get("type") or "text") == "text":
            out[-1] = {"type": "text", "text": (out[-1].get("text") or "") + (p.get("text") or "")}
        else:
            out.append(p)
    return out


OUT = [
    T.StructField("place", T.LongType()),
    T.StructField("formatted", T.StringType()),
    T.StructField("char_offset", T.LongType()),
    T.StructField("loss_start", T.LongType()),
    T.StructField("loss_end", T.LongType()),
    T.StructField("attachments", T.ArrayType(ATTACHMENT)),
    T.StructField("expanded_tokens", T.LongType()),
]


def _ordered(df: DataFrame, conv: str, *by: str) -> DataFrame:
    return df.repartition(F.col(conv)).sortWithinPartitions(F.col(conv), *by)


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, loss_roles=("assistant",), keep: list[str] | None = None, **sizes) -> DataFrame:
    """One row per turn: ``conv``, the columns in ``keep`` (default: all others but the text and parts) and OUT."""
    names = {f.name for f in OUT}
    keep = [c for c in (keep if keep is not None else df.columns) if c not in {conv, text, parts} | names]
    cols = [conv, *keep]
    work = df.select(*[F.col(c) for c in cols], F.coalesce(F.col(role), F.lit("")).alias("__role"), F.col(turn).alias("__turn"), F.coalesce(F.col(text), F.lit("")).alias("__text"), *([F.col(parts).alias("__parts")] if parts else []))
    work = _ordered(work, conv, "__turn", "__role", "__text")

    def run(batches):
        at, place, offset = object(), 0, 0
        for batch in batches:
            g = lambda n: batch.column(batch.schema.get_field_index(n))
            convs, roles, texts = g(conv).to_pylist(), g("__role").to_pylist(), g("__text").to_pylist()
            lists = g("__parts").to_pylist() if parts else [None] * len(convs)
            out: dict[str, list] = {f.name: [] for f in OUT}
            for c, r, t, ps in zip(convs, roles, texts, lists):
                if c != at:
                    at, place, offset = c, 0, 0
                v = Visitor(**sizes)
                v._add(f"{TURN}{escape_role(r)}\n")
                start = v.length
                for p in merge_escapes([p for p in ps if p is not None]) if ps is not None else [{"type": "text", "text": t}]:
                    v.visit(p)
                end = v.length
                v._add(f"{END}\n")
                lossy = r in loss_roles
                row = (place, "".join(v.pieces), offset, start if lossy else None, end if lossy else None, v.attachments, sum(a["n_tokens"] for a in v.attachments))
                for f, x in zip(OUT, row):
                    out[f.name].append(x)
                place, offset = place + 1, offset + v.length
            yield pa.RecordBatch.from_arrays(
                [g(c) for c in cols] + [pa.array(out[f.name], _arrow(f.dataType)) for f in OUT], [*cols, *out]
            )

    return work.mapInArrow(run, T.StructType([*[df.schema[c] for c in cols], *OUT]))


def escape_role(role: str) -> str:
    """A role on one line: control strings escaped, backslashes and line ends as \\\\ and \\n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n")) if role.strip("abcdefghijklmnopqrstuvwxyz_") else role


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)) if "\\" in role else role


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def read_piece(piece: str) -> tuple[str, str]:
    """(role, text) of one formatted turn; placeholders stay in the text."""
    if not piece.startswith(TURN) or not piece.endswith(f"{END}\n"):
        raise ValueError("not a formatted turn")
    head, _, rest = piece[len(TURN) :].partition("\n")
    return unescape_role(head), unescape(rest[: -len(END) - 1])


SUMMARY = [
    T.StructField("n_turns", T.LongType()),
    T.StructField("turns_sha256", T.StringType()),
    T.StructField("loss_chars", T.LongType()),
    T.StructField("loss_sha256", T.StringType()),
    T.StructField("formatted_chars", T.LongType()),
]


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Per conversation what the formatted turns hold, read from the output alone: see SUMMARY."""
    key_type = _arrow(formatted.schema[conv].dataType)
    work = _ordered(formatted.select(conv, "place", "formatted", "loss_start", "loss_end"), conv, "place")

    def run(batches):
        at, state = None, None

        def result(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], key_type), *[pa.array([r[1][i] for r in rows], _arrow(f.dataType)) for i, f in enumerate(SUMMARY)]], [conv, *[f.name for f in SUMMARY]]
            )

        for batch in batches:
            done = []
            for c, piece, start, end in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if state is None or c != at:
                    if state is not None:
                        done.append((at, state.row()))
                    at, state = c, _State()
                state.add(piece, start, end)
            if done:
                yield result(done)
        if state is not None:
            yield result([(at, state.row())])

    return work.mapInArrow(run, T.StructType([formatted.schema[conv], *SUMMARY]))


class _State:
    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        role, text = read_piece(piece)
        self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learnt = unescape(piece[start:end])
            self.loss.update(learnt.encode())
            self.loss_chars += len(learnt)
        self.n, self.chars = self.n + 1, self.chars + len(piece)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every conversation, and one that says control strings, formatted and read back."""
    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(convs.unionByName(extra), keep=["turn"]))


def oracle() -> str:
    firsts: dict[str, list[str]] = {}
    for c in CONTROLS:
        firsts.setdefault(c[0], []).append(re.escape(c[1:]))
    # each control string (with its backslashes) grows by one character
    grown = " + ".join(f"len(regexp_extract_all(text, '{re.escape(a)}\\\\*({'|'.join(rest)})'))" for a, rest in firsts.items())
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(TURN)} + length(role) + 1 + length(text) + {grown} + {len(END)} + 1)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
