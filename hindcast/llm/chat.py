"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Prefixes of a conversation are
rendered one turn longer each time; what the longer output adds is the turn's span. A template that
changes what it had written before is noticed (``rewrites``). Where the text stands inside a span
is found by rendering the last turn once more around a probe. Texts are escaped before rendering,
so control strings in them cannot end a turn, and come back unchanged.

The output is a table of runs: up to ``run_turns`` turns of one conversation with the formatted
text, the spans of its turns and of the loss mask. Long conversations are several runs, so no task
ever holds a whole conversation. A run knows the first turn of its conversation and the whole run
before; whether the template looks back further than one turn is tested at every border between
runs (``looks_back``), and the run is then formatted after all the context that it knows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
# All control strings of the template begin with one of these, or with the escape itself.
CONTROL = re.compile(r"[\\<\[]")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PROBE = "probe"
SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("run", pa.int64()), ("first_turn", pa.int64()),
    ("formatted", pa.string()), ("roles", pa.list_(pa.string())),
    ("turn_starts", pa.list_(pa.int64())), ("turn_ends", pa.list_(pa.int64())),
    ("text_starts", pa.list_(pa.int64())), ("text_ends", pa.list_(pa.int64())),
    ("loss", pa.list_(pa.bool_())), ("rewrites", pa.bool_()), ("looks_back", pa.bool_())])
RUNS = (
    "conv_id long, run long, first_turn long, formatted string, roles array<string>, "
    "turn_starts array<long>, turn_ends array<long>, text_starts array<long>, "
    "text_ends array<long>, loss array<boolean>, rewrites boolean, looks_back boolean"
)
# Runs handed back at a time; more of either closes a batch.
BATCH_CHARS, BATCH_RUNS = 4_000_000, 1000


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def inst_template(turns: Turns) -> str:
    """``<s>``, then ``[INST] user [/INST]``, ``assistant</s>``, ``[SYS] ...`` for other roles."""
    out = ["<s>"]
    for role, text in turns:
        if role == "user":
            out.append(f"[INST] {text} [/INST]")
        elif role == "assistant":
            out.append(f" {text}</s>")
        else:
            out.append(f"[ROLE {role}] {text} [/ROLE]")
    return "".join(out)


def render_run(turns: Turns, context: Turns, template: Callable[[Turns], str]) -> dict:
    """Format ``turns`` after ``context``: text, spans, and whether the template rewrites history.

    With context, the output of the context alone is left out of the text.
    """
    shown = [(escape(r), escape(t)) for r, t in context]
    begin = before = template(shown) if shown else ""
    offset, rewrites = len(begin), False
    starts, ends, text_starts, text_ends = [], [], [], []
    for role, text in turns:
        role, text = escape(role), escape(text)
        after = template([*shown, (role, text)])
        probe = template([*shown, (role, PROBE)])
        shown.append((role, text))
        if not after.startswith(before):
            rewrites = True
        starts.append(len(before) - offset)
        ends.append(len(after) - offset)
        at = probe.find(PROBE, len(before) if probe.startswith(before) else 0)
        tail = len(probe) - at - len(PROBE) if at >= 0 else 0
        if at >= 0 and after[at:len(after) - tail] == text:
            text_starts.append(at - offset)
            text_ends.append(len(after) - tail - offset)
        else:  # the template alters the text or drops it: no span, hence no loss
            text_starts.append(ends[-1])
            text_ends.append(ends[-1])
            rewrites = rewrites or text != ""
        before = after
    return {"formatted": before[offset:], "turn_starts": starts, "turn_ends": ends,
            "text_starts": text_starts, "text_ends": text_ends, "rewrites": rewrites}


def added(context: Turns, turns: Turns, template: Callable[[Turns], str]) -> str | None:
    """What ``turns`` add to the output of ``context``; None if they change it."""
    shown = [(escape(r), escape(t)) for r, t in [*context, *turns]]
    begin = template(shown[:len(context)]) if context else ""
    out = template(shown)
    return out[len(begin):] if out.startswith(begin) else None


def render_after(turns: Turns, head: Turns, previous: Turns, template: Callable[[Turns], str]) -> dict:
    """Format a run after the run before it; ``head`` is what is known of still earlier turns.

    The turn before is context enough for a template that looks back by one turn at most. It does so
    here if the run's text is the same after all known turns, and if that of the run's later turns is
    the same after nothing but the run's first turn. If not, ``looks_back`` is true and the run is
    formatted after all known turns: right if what the template looks at is among them, as in the
    second run of a conversation, which knows all that came before it.
    """
    known = [*head, *previous]
    near = added(previous[-1:], turns, template)
    looks_back = near is None or near != added(known, turns, template) or (
        added(turns[:1], turns[1:], template)
        != added([*known, *turns[:1]], turns[1:], template))
    row = render_run(turns, known if looks_back else previous[-1:], template)
    return row | {"looks_back": looks_back}


def format_conversations(
    conversations: DataFrame, template: Callable[[Turns], str] = inst_template,
    run_turns: int = 64,
) -> DataFrame:
    """Runs of all conversations (conv_id, turn, role, text).

    Turns stand in the order of (turn with NULL first, role, text); repeated rows are repeated
    turns. NULL role and text are empty strings; rows without conv_id form one conversation with
    that id. Rows are dealt by conversation, sorted in the JVM, which spills, and streamed: Python holds
    two runs of one conversation at a time. A template that looks back over more than one border
    between runs, past the first turn, at something that alters no turn of the run between, is not
    noticed; all other looks back by more than a turn set ``looks_back``.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, chars = [], 0
        for row in _runs(batches, template, run_turns):
            out.append(row)
            chars += len(row["formatted"])
            if chars > BATCH_CHARS or len(out) >= BATCH_RUNS:
                yield pa.RecordBatch.from_pylist(out, SCHEMA)
                out, chars = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, SCHEMA)

    return rows.select("conv_id", "role", "text").mapInArrow(formatted, RUNS)


def _runs(batches: Iterator[pa.RecordBatch], template, run_turns: int) -> Iterator[dict]:
    """Formatted runs of sorted rows (conv_id, role, text)."""
    conv, run = None, 0
    head: Turns = []
    previous: Turns = []
    turns: Turns = []

    def finished() -> dict:
        if run == 0:
            row = render_run(turns, [], template) | {"looks_back": False}
        else:
            row = render_after(turns, head if run > 1 else [], previous, template)
        return row | {"conv_id": conv, "run": run, "first_turn": run * run_turns,
                      "roles": [r for r, _ in turns],
                      "loss": [r == "assistant" for r, _ in turns]}

    for batch in batches:
        for own, role, text in zip(*(column.to_pylist() for column in batch.columns)):
            if turns and (own != conv or len(turns) == run_turns):
                yield finished()
                head = head or turns[:1]
                previous, turns, run = turns, [], run + 1
                if own != conv:
                    head, previous, run = [], [], 0
            conv = own
            turns.append((role, text))
    if turns:
        yield finished()


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the runs: turns, digests of all turns and of the loss, lengths.

    Runs are dealt by conversation, sorted, and streamed through the digests one by one.
    """
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "run")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def row(s):
            return pa.RecordBatch.from_arrays([
                pa.array([s["conv_id"]], pa.int64()), pa.array([s["n"]], pa.int64()),
                pa.array([s["turns"].hexdigest()]), pa.array([s["loss_chars"]], pa.int64()),
                pa.array([s["loss"].hexdigest()]), pa.array([s["chars"]], pa.int64()),
                pa.array([s["runs"]], pa.int64()), pa.array([s["rewrites"]], pa.bool_()),
                pa.array([s["looks_back"]], pa.bool_()),
            ], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                      "formatted_chars", "n_runs", "rewrites", "looks_back"])

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or state["conv_id"] != r["conv_id"]:
                    if state is not None:
                        yield row(state)
                    state = {"conv_id": r["conv_id"], "n": 0, "turns": hashlib.sha256(),
                             "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "runs": 0,
                             "rewrites": False, "looks_back": False}
                text = r["formatted"]
                state["chars"] += len(text)
                state["runs"] += 1
                state["rewrites"] |= r["rewrites"]
                state["looks_back"] |= r["looks_back"]
                for role, a, b, loss in zip(r["roles"], r["text_starts"], r["text_ends"],
                                            r["loss"]):
                    own = unescape(text[a:b])
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
                    if loss:
                        state["loss"].update(own.encode("utf-8", "surrogatepass"))
                        state["loss_chars"] += len(own)
        if state is not None:
            yield row(state)

    return rows.mapInArrow(
        digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
        "loss_sha256 string, formatted_chars long, n_runs long, rewrites boolean, "
        "looks_back boolean")
