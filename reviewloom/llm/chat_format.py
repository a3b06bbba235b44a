"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text. Successive prefixes of a
conversation are rendered and consecutive outputs compared: where an output
continues the one before, what is new is the turn's span. The place of the
turn's text in it comes from rendering the same prefix with a probe character as
the last text. A template whose output does not continue the previous one
rewrites history; such conversations are flagged, and their spans are located in
the final output instead, by probing each turn in place. The loss mask covers the
texts of assistant turns.

The built-in template is reversible: control strings inside texts are escaped,
and :func:`read_back` recovers the turns from the output alone.

Nulls and odd input: a null text is empty, a null role the empty role; rows with a
null conversation id belong to none, so each is a conversation of one turn, its id
null; a null turn sorts first. Rows of the
same turn, repeated rows included, are all kept, ordered by role, then text. An
empty table gives an empty result. Other columns are not read. Texts of any
length are rendered whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

#: Stands for a text while its place is looked for; from a private use area.
PROBE = "\U000f5eed"
#: Control strings of the built-in template.
BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
ROLE, ROLE_END = "<role>", "</role>"
#: Opens an escape; escaped are this character and the first one of every control string.
ESCAPE = "\\"
_PLAIN = {"\\": "\\", "l": "<", "b": "["}


def escape(text: str) -> str:
    """Without any control string, as none of their first characters is left."""
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, i = [], 0
    while (j := text.find(ESCAPE, i)) >= 0:
        out += [text[i:j], _PLAIN[text[j + 1]]]
        i = j + 2
    return "".join([*out, text[i:]])


def instruct_template(turns: Sequence[Turn]) -> str:
    """User turns in ``[INST]``, assistant turns closed by ``</s>``, any other role named."""
    out = [BOS]
    for role, text in turns:
        if role == "user":
            out.append(f"{OPEN} {escape(text)} {CLOSE}")
        elif role == "assistant":
            out.append(f" {escape(text)} {EOS}")
        else:
            out.append(f"{ROLE}{escape(role)}{ROLE_END} {escape(text)} {EOS}")
    return "".join(out)


def read_back(output: str) -> list[Turn]:
    """The turns of an output of :func:`instruct_template`, parsed from the output alone."""
    if not output.startswith(BOS):
        raise ValueError("not an output of this template")
    turns, at = [], len(BOS)
    while at < len(output):
        if output.startswith(OPEN, at):
            end = output.index(f" {CLOSE}", at)
            turns.append(("user", unescape(output[at + len(OPEN) + 1 : end])))
            at = end + 1 + len(CLOSE)
            continue
        role = "assistant"
        if output.startswith(ROLE, at):
            stop = output.index(ROLE_END, at)
            role = unescape(output[at + len(ROLE) : stop])
            at = stop + len(ROLE_END)
        end = output.index(f" {EOS}", at)
        turns.append((role, unescape(output[at + 1 : end])))
        at = end + 1 + len(EOS)
    return turns


@dataclass
class Formatted:
    output: str
    #: For each turn, where its text lies in the output, or None if the template does not show it whole.
    spans: list[tuple[int, int] | None]
    rewrites_history: bool


def _last_text(template: Template, turns: Sequence[Turn], k: int, output: str) -> tuple[int, int] | None:
    """Where the text of turn ``k`` lies in ``output``, the rendering of ``turns``."""
    probe = PROBE
    while any(probe in t or probe in r for r, t in turns):
        probe += PROBE
    probed = template([*turns[:k], (turns[k][0], probe), *turns[k + 1 :]])
    at = probed.find(probe)
    if at < 0:
        return None
    tail = len(probed) - at - len(probe)
    head_same = output[:at] == probed[:at]
    tail_same = output[len(output) - tail :] == probed[len(probed) - tail :] if tail else True
    return (at, len(output) - tail) if head_same and tail_same and at + tail <= len(output) else None


def render(template: Template, turns: Sequence[Turn]) -> Formatted:
    """Output, text spans and whether the template rewrites what it has rendered before."""
    spans: list[tuple[int, int] | None] = []
    before = output = template([])
    rewrites = False
    for k in range(len(turns)):
        output = template(turns[: k + 1])
        if not output.startswith(before):
            rewrites = True
            break
        spans.append(_last_text(template, turns[: k + 1], k, output))
        # A text can't lie in what earlier turns had rendered.
        if spans[-1] is not None and spans[-1][0] < len(before):
            spans[-1] = None
        before = output
    if rewrites:
        output = template(turns)
        spans = [_last_text(template, turns, k, output) for k in range(len(turns))]
    return Formatted(output, spans, rewrites)


def turns_digest(turns: Sequence[Turn]) -> str:
    h = hashlib.sha256()
    for role, text in turns:
        h.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def format_conversations(
    df: DataFrame,
    template: Template = instruct_template,
    keys: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"),
) -> DataFrame:
    """One row for each conversation: (id, output, spans, loss, rewrites_history).

    ``spans`` has role, start and end (code points) of each turn's text in the
    output, ``loss`` those of the assistant's; both null where the template does
    not show a text whole. A conversation is rendered by one task, as a template
    may look at all of its turns.
    """
    conv, turn, role, text = keys
    turns = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("n"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    # Rows without an id are told apart, so that they are no hot key.
    alone = F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("alone")
    rows = df.groupBy(F.col(conv).alias("id"), alone).agg(turns.alias("turns")).drop("alone")
    id_type = df.schema[conv].dataType.simpleString()
    span = "array<struct<role: string, start: long, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # A few conversations at a time: outputs are as long as their texts.
            for k in range(b.num_rows):
                done = render(template, said := [(t["role"], t["text"]) for t in b.column(1)[k].as_py()])
                all_spans = [{"role": r, "start": s[0] if s else None, "end": s[1] if s else None} for (r, _), s in zip(said, done.spans, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(k, 1),
                        pa.array([done.output]),
                        pa.array([all_spans], span_type),
                        pa.array([[s for s in all_spans if s["role"] == "assistant"]], span_type),
                        pa.array([done.rewrites_history]),
                    ],
                    ["id", "output", "spans", "loss", "rewrites_history"],
                )

    span_type = pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return rows.mapInArrow(run, f"id {id_type}, output string, spans {span}, loss {span}, rewrites_history boolean").withColumnRenamed("id", conv)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What can be read back from outputs of :func:`instruct_template` and their loss masks."""
    id_type = formatted.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for output, loss, rewrites in zip(b.column(1), b.column(2), b.column(3), strict=True):
                out = output.as_py()
                turns = read_back(out)
                masked = "".join(unescape(out[s["start"] : s["end"]]) for s in loss.as_py())
                rows.append((len(turns), turns_digest(turns), len(masked), hashlib.sha256(masked.encode("utf-8", "surrogatepass")).hexdigest(), len(out), rewrites.as_py()))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names)

    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    out = formatted.select(id_col, "output", "loss", "rewrites_history").mapInArrow(
        run, f"id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
    )
    return out.withColumnRenamed("id", id_col)
