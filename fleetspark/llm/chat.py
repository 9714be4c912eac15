"""Brings raw transcripts into one canonical form: a hidden Markov model finds who speaks in which line.

Lines are observed; hidden is whose turn a line belongs to, and whether it begins it. A state emits a speaker marker or none
("User:", "### Assistant", "[system]", "Q:" ...), whether a blank line stands before, how long the line is and whether it
ends in a question mark; a transcript marks its speakers throughout or not at all. Transitions between turns and the make-up of lines are counted in all conversations with known
roles; what markers look like is fixed. The Viterbi path gives the turns, markers are taken off, and turns are rendered as

    <|im_start|>role
    text<|im_end|>

with "<|" inside texts written as "< |". Counting shuffles sums only. A transcript that is given as one text is parsed whole.

Conversations are decoded whole, however long. Their rows are dealt out in ranges of their order, so that a long one, or one of
many repeated turns, is spread over tasks, and cut into slices of at most ``PART_TURNS`` rows. Of a conversation with several slices, each slice gives a
max-plus matrix: the best score from every state of its first line to every state of its last. The matrices, walked in order,
give the states in which each slice begins and ends; the slices are then decoded between those. Logarithms are multiples of
2^-24, so sums are exact and the path's score is the same wherever cuts lie.

``chat_report`` has a row for each slice, by ``part`` from 0. A turn belongs to the slice it begins in; its text may go on in the
next one. Rows joined in order are the conversation's result: ``rendered`` as it stands, ``n_turns`` by sum, ``roles`` by
list. A slice ends as well where turn div ``PART_TURNS`` changes.
Only where turns repeat so often that a slice's numbers hold more than ``PART_TURNS`` rows does the place of cuts follow the tasks.

Defined results: a null or blank transcript has no turns; null texts are empty turns and do not show in a transcript; rows
without a conversation id are left out of counts and are transcripts of their own; turns of equal number are ordered by role
and text, null turns come first; an unknown role counts as user; of equally likely paths any may be taken.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from fleetspark import session
from fleetspark.llm.keys import mapped

ROLES = ["system", "user", "assistant"]
PART_TURNS = 512
#: Of a text, the characters by which rows are dealt out.
ORDER_CHARS = 256
#: Names that speakers go by.
NAMES = {
    "system": ["system", "context", "instruction", "instructions"],
    "user": ["user", "human", "question", "q", "customer", "prompter"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "agent", "model"],
}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
_NAME = "|".join(sorted(ROLE_OF, key=len, reverse=True))
MARKER = re.compile(
    rf"\s*(?:#{{1,6}}\s*(?P<head>{_NAME})\s*:?\s*$|#{{1,6}}\s*(?P<hash>{_NAME})\s*:\s*|[\[(<]\|?(?P<box>{_NAME})\|?[\])>]\s*:?\s*"
    rf"|\*\*(?P<bold>{_NAME})\s*:?\s*\*\*\s*:?\s*|(?P<plain>{_NAME})\s*[:>]\s+|(?P<alone>{_NAME})\s*:\s*$)", re.IGNORECASE)

#: Fixed values, for transcripts that mark their speakers and for others: how often a line that begins a turn has a marker,
#: how often that is another speaker's, how often a line inside a turn seems to have one; how often a blank line stands before
#: either.
STYLES = {"marked": (0.98, 1e-6, 0.0005, 0.5, 0.2), "bare": (0.01, 1e-6, 0.01, 0.9, 0.05)}
#: Lines of each state that are counted as if they were like all lines.
LIKE_ALL = 100
#: Upper ends of the classes of line length.
LENGTHS = [40, 120, 400]


def marker_of(line: str) -> tuple[str | None, int]:
    """Role of the speaker that a line is marked with, and the length of the marker."""
    m = MARKER.match(line)
    return (ROLE_OF[m.group(m.lastgroup).lower()], m.end()) if m else (None, 0)


def line_class(line: Column | str):
    """Class of length, twice as many for questions: as a number, or as a column."""
    if isinstance(line, str):
        return 2 * sum(len(line) > x for x in LENGTHS) + line.rstrip().endswith("?")
    size = sum((F.when(F.length(line) > x, 1).otherwise(0) for x in LENGTHS), F.lit(0))
    return 2 * size + F.rtrim(line).endswith("?").cast("int")


CLASSES = 2 * (len(LENGTHS) + 1)


def exact(x):
    """The nearest multiple of 2^-24: sums of such numbers are exact."""
    return np.round(x * 2**24) / 2**24


def shown_lines(transcript: str | None) -> list[tuple[int, str]]:
    """Place and text of each line that holds something."""
    return [(i, line) for i, line in enumerate((transcript or "").split("\n")) if line.strip()]


@dataclass
class Model:
    """Logarithms. States are 0 to 2, a role's first line, and 3 to 5, a further line of it."""

    start: np.ndarray
    step: np.ndarray
    lines: np.ndarray

    def emission(self, line: str, blank: bool, style: str) -> np.ndarray:
        marked, other, marked_inside, blank_before, blank_inside = STYLES[style]
        role, _ = marker_of(line)
        out = self.lines[:, line_class(line)].copy()
        for i, name in enumerate(ROLES):
            first = 1 - marked - 2 * other if role is None else marked if role == name else other
            inside = 1 - marked_inside if role is None else marked_inside / 3
            out[i] += exact(math.log(first) + math.log(blank_before if blank else 1 - blank_before))
            out[3 + i] += exact(math.log(inside) + math.log(blank_inside if blank else 1 - blank_inside))
        return out

    def path(self, lines: list[tuple[int, str]], style: str, first: int | None = None, last: int | None = None) -> tuple[float, list[int]]:
        """Log probability and states of the most likely path, between two states if they are given."""
        begin = self.start if first is None else np.where(np.arange(6) == first, 0.0, -np.inf)
        score, back = begin + self.emission(lines[0][1], True, style), []
        for k in range(1, len(lines)):
            ways = score[:, None] + self.step
            best = ways.argmax(0)
            back.append(best)
            score = ways[best, range(6)] + self.emission(lines[k][1], lines[k][0] > lines[k - 1][0] + 1, style)
        states = [int(score.argmax()) if last is None else last]
        for best in back[::-1]:
            states.append(int(best[states[-1]]))
        return float(score[states[0]]), states[::-1]

    def chain(self, lines: list[tuple[int, str]], style: str) -> np.ndarray:
        """Log probability of the best path from each state of the first line to each of the last."""
        ways = np.where(np.eye(6) > 0, 0.0, -np.inf) + self.emission(lines[0][1], True, style)
        for k in range(1, len(lines)):
            ways = (ways[:, :, None] + self.step).max(1) + self.emission(lines[k][1], lines[k][0] > lines[k - 1][0] + 1, style)
        return ways

    def ends(self, chains: list[np.ndarray]) -> tuple[str, list[tuple[int, int]]]:
        """Of slices in order, with their matrices in each style: the likelier style, the states each slice begins and ends in."""
        best = None
        for s, style in enumerate(STYLES):
            before = [self.start]
            for ways in chains[:-1]:
                before.append((((before[-1][:, None] + ways[s]).max(0))[:, None] + self.step).max(0))
            score = (before[-1][:, None] + chains[-1][s]).max()
            if best is None or score > best[0]:
                best = score, s, style, before
        _, s, style, before = best
        out: list[tuple[int, int]] = []
        for k in range(len(chains) - 1, -1, -1):
            ways = before[k][:, None] + chains[k][s]
            if out:
                ways = ways + self.step[:, out[-1][0]]
            first, last = divmod(int(ways.argmax()), 6)
            out.append((first, last))
        return style, out[::-1]

    def turns(self, transcript: str | None) -> list[tuple[str, str]]:
        """(role, text) of each turn, by the most likely path in the more likely style."""
        lines = shown_lines(transcript)
        if not lines:
            return []
        _, states = max((self.path(lines, style) for style in STYLES), key=lambda x: x[0])
        return [(role, text.strip()) for role, text in gathered(lines, states)]


def gathered(lines: list[tuple[int, str]], states: list[int]) -> list[tuple[str, str]]:
    """(role, text) of the turns of a path; the first is what goes on from before if the path begins inside a turn."""
    out: list[tuple[str, list[str]]] = []
    for k, (state, (i, line)) in enumerate(zip(states, lines, strict=True)):
        if state < 3:
            out.append((ROLES[state], [line[marker_of(line)[1]:]]))
        elif not out:
            out.append((ROLES[state % 3], [line]))
        else:
            out[-1][1].extend([""] * (i - lines[k - 1][0] - 1) + [line])
    return [(role, "\n".join(part)) for role, part in out]


def render(turns: list[tuple[str, str]]) -> str:
    """The canonical form."""
    return "".join(f"<|im_start|>{role}\n{text.replace('<|', '< |')}<|im_end|>\n" for role, text in turns)


def fit(conversations: DataFrame) -> Model:
    """Counts over all of ``conversations`` (conv_id, turn, role, text), one added to each; the make-up of a state's lines is
    drawn to that of all lines, so that few or odd lines do not outweigh markers. Only sums by role and class of line come to
    the driver."""
    turns = conversations.where("conv_id is not null and turn is not null").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), known_role().alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    lines = (turns.select("role", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("at", "line"))
             .groupBy("role", F.least("at", F.lit(1)).alias("later"), line_class(F.col("line")).alias("class")).agg(F.count("*").alias("n")).collect())
    first = (turns.groupBy("conv_id").agg(F.min(F.struct("turn", "role")).alias("first")).groupBy(F.col("first.role").alias("role"))
             .agg(F.count("*").alias("n")).collect())
    # rows of one turn are summed before they meet those of the next: a turn has as many rows as there are roles
    per_turn = turns.groupBy("conv_id", "turn", "role").agg(F.count("*").cast("double").alias("n"))
    after = per_turn.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next"), F.col("n").alias("m"))
    pairs = per_turn.join(after, ["conv_id", "turn"]).groupBy("role", "next").agg(F.sum(F.col("n") * F.col("m")).alias("n")).collect()
    at = {r: i for i, r in enumerate(ROLES)}
    count = np.ones((6, CLASSES))
    for r in lines:
        count[at[r["role"]] + 3 * r["later"], r["class"]] += r["n"]
    begin, follow = np.ones(3), np.ones((3, 3))
    for r in first:
        begin[at[r["role"]]] += r["n"]
    for r in pairs:
        follow[at[r["role"]], at[r["next"]]] += r["n"]
    follow /= follow.sum(1, keepdims=True)
    # a further line follows a line as often as there are further lines
    firsts, further = count[:3].sum(1), count[3:].sum(1)
    stay = further / (firsts + further)
    count += LIKE_ALL * count.sum(0) / count.sum()
    step = np.zeros((6, 6))
    for i in range(3):
        for state in (i, 3 + i):
            step[state, 3 + i] = stay[i]
            step[state, :3] = (1 - stay[i]) * follow[i]
    with np.errstate(divide="ignore"):
        return Model(*map(exact, (np.log(np.append(begin / begin.sum(), [0, 0, 0])), np.log(step), np.log(count / count.sum(1, keepdims=True)))))


def known_role() -> Column:
    role = F.lower(F.trim("role"))
    return F.when(role.isin(*ROLES), role).otherwise("user")


def format_transcripts(transcripts: DataFrame, model: Model, text: str = "transcript") -> DataFrame:
    """``transcripts`` and turns (role, text), rendered, n_turns; columns of these names are replaced."""
    transcripts = transcripts.drop("turns", "rendered", "n_turns")
    names, at = transcripts.columns, transcripts.columns.index(text)
    shape = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.turns(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[{"role": r, "text": t} for r, t in turns] for turns in found], shape),
                 pa.array([render(t) for t in found], pa.string()), pa.array([len(t) for t in found], pa.int64())], [*names, "turns", "rendered", "n_turns"])

    turn = ArrayType(StructType().add("role", "string").add("text", "string"))
    out = StructType(list(transcripts.schema.fields)).add("turns", turn).add("rendered", "string").add("n_turns", "long")
    return mapped(transcripts, rows, out.names, out)


def slice_text(model: Model, transcript: str, style: str, first: int, last: int, goes_on: bool, after_name: bool) -> tuple[list[str], str]:
    """Roles of the turns that begin in a slice, and its rendered text; ``goes_on``: the last turn does in the next slice;
    ``after_name``: what goes on from the slice before is a speaker's name only, so far."""
    lines = shown_lines(transcript)
    turns = gathered(lines, model.path(lines, style, first, last)[1])
    trailing = "\n" * (transcript.count("\n") - lines[-1][0])
    out = []
    for k, (role, text) in enumerate(turns):
        inside, open_end = k == 0 and first >= 3, goes_on and k == len(turns) - 1
        if inside:
            text = text.lstrip() if after_name else "\n\n" + "\n" * lines[0][0] + text
        else:
            text = text.lstrip()
        text = (text + trailing if text and open_end else text.rstrip() if not open_end else "").replace("<|", "< |")
        out.append(("" if inside else f"<|im_start|>{role}\n") + text + ("" if open_end else "<|im_end|>\n"))
    return [role for role, _ in turns[first >= 3:]], "".join(out)


def conversation_slices(conversations: DataFrame, model: Model, marked, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, at, whole, true_roles, transcript, chains, named: slices of conversations, in order by ``at``. Turns in order, each
    written by ``marked`` (a function of role and text columns), a blank line between; empty turns do not show. A row without an
    id is on its own. A slice that may be one of several has its matrices, and whether its last line is a speaker's name only."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), known_role().alias("role"),
        F.trim(F.coalesce("text", F.lit("")), F.lit(" \t\r\n")).alias("text"))
    turns = turns.withColumn("part", F.expr(f"turn div {part_turns}"))
    # rows of one part stay together, unless turns that repeat make them many: then they are dealt out by all of their order. Equal
    # rows are as well: where the order by text is told by its first characters, any number may follow
    many = (turns.where("conv_id is not null").groupBy(F.col("conv_id").alias("many_id"), F.col("part").alias("many_part"))
            .agg(F.count("*").alias("n")).where(F.col("n") > part_turns).select("many_id", "many_part", F.lit(True).alias("many")))
    turns = turns.join(many, (F.col("conv_id") == F.col("many_id")) & F.col("part").eqNullSafe(F.col("many_part")), "left").select(
        "conv_id", "part", "turn", "role", "text", marked(F.col("role"), F.col("text")).alias("line"), F.left("text", F.lit(ORDER_CHARS)).alias("begins"),
        (F.length("text") > ORDER_CHARS).alias("long"), (F.col("conv_id").isNull() | F.coalesce("many", F.lit(False))).alias("many"))
    turns = turns.withColumn("spread", F.when(F.col("many") & (~F.col("long") | F.col("conv_id").isNull()), F.monotonically_increasing_id()))
    order = ["turn", "role", "begins", "long", "spread"]
    ordered = (turns.repartitionByRange("conv_id", "part", *(F.when(F.col("many"), F.col(c)) for c in order))
               .sortWithinPartitions("conv_id", "part", *order, "text").select("conv_id", "part", "role", "text", "line"))
    shape = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("whole", pa.bool_()), ("true_roles", pa.list_(pa.string())),
                       ("transcript", pa.string()), ("chains", pa.list_(pa.float64())), ("named", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, out = TaskContext.get().partitionId() << 32, []
        part, rows_in, roles, texts = None, 0, [], []
        conv, first_conv, slices = None, True, 0

        def end_slice(whole):
            nonlocal at, rows_in, roles, texts, slices
            transcript = "\n\n".join(texts)
            lines = [] if whole else shown_lines(transcript)
            chains = np.concatenate([model.chain(lines, s).ravel() for s in STYLES]).tolist() if lines else None
            out.append((conv, at, whole, roles, transcript, chains, bool(lines) and not lines[-1][1][marker_of(lines[-1][1])[1]:].strip()))
            at, rows_in, roles, texts, slices = at + 1, 0, [], [], slices + 1

        def batch_of():
            found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)
            out.clear()
            return found

        for batch in batches:
            for new_conv, new_part, role, text, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows_in and (new_conv is None or new_conv != conv):
                    end_slice(conv is None or not first_conv and slices == 0)
                    first_conv, slices = False, 0
                elif rows_in and (new_part != part or rows_in == part_turns):
                    end_slice(False)
                conv, part, rows_in = new_conv, new_part, rows_in + 1
                if text:
                    roles.append(role)
                    texts.append(line)
            if out:
                yield batch_of()
        if rows_in:
            end_slice(conv is None)
            yield batch_of()

    return ordered.mapInArrow(rows, "conv_id bigint, at bigint, whole boolean, true_roles array<string>, transcript string, chains array<double>, named boolean")


def slice_ends(slices: DataFrame, model: Model) -> DataFrame:
    """at, part, style, first, last, goes_on, after_name of the slices that are not whole conversations: part from 0, and what
    their neighbours tell of them. Only matrices are gathered by conversation."""
    shape = pa.schema([("at", pa.int64()), ("part", pa.int64()), ("style", pa.string()), ("first", pa.int32()), ("last", pa.int32()),
                       ("goes_on", pa.bool_()), ("after_name", pa.bool_())])

    def walked(found: pa.Table) -> pa.Table:
        rows = sorted(zip(found["at"].to_pylist(), found["chains"].to_pylist(), found["named"].to_pylist(), strict=True), key=lambda r: r[0])
        some = [k for k, r in enumerate(rows) if r[1]]
        told = {}
        if some:
            style, ends = model.ends([np.array(rows[k][1]).reshape(len(STYLES), 6, 6) for k in some])
            for n, (k, (first, last)) in enumerate(zip(some, ends, strict=True)):
                told[k] = (style, first, last, n + 1 < len(ends) and ends[n + 1][0] >= 3, n > 0 and rows[some[n - 1]][2] and ends[n - 1][1] < 3)
        out = [(r[0], k, *told.get(k, (None, None, None, False, False))) for k, r in enumerate(rows)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return slices.where("not whole").select("conv_id", "at", "chains", "named").groupBy("conv_id").applyInArrow(
        lambda found: walked(found), "at bigint, part bigint, style string, first int, last int, goes_on boolean, after_name boolean")


def written(role: Column, text: Column) -> Column:
    """How transcripts of many origins write a turn; the style follows from the conversation's id. One style in five has no
    markers."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(5))
    short = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("Context")
    return (F.when(style == 0, F.concat(F.initcap(role), F.lit(": "), text))
            .when(style == 1, F.concat(F.lit("### "), F.when(role == "user", "Human").otherwise(F.initcap(role)), F.lit(":\n"), text))
            .when(style == 2, F.concat(short, F.lit(": "), text))
            .when(style == 3, F.concat(F.lit("["), role, F.lit("] "), text)).otherwise(text))


def chat_report(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, n_turns, roles found and true, rendered, of every slice of every conversation written as a transcript."""
    model = fit(conversations)
    slices = session.cut(conversation_slices(conversations, model, written, part_turns))
    placed = slices.drop("chains", "named").join(slice_ends(slices, model), "at", "left").select(
        "conv_id", F.coalesce("part", F.lit(0)).cast("long").alias("part"), "true_roles", "whole", "transcript", "style", "first", "last", "goes_on", "after_name")
    shape = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("n_turns", pa.int64()), ("roles", pa.string()),
                       ("true_roles", pa.string()), ("rendered", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, part, true_roles, whole, transcript, *ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if whole:
                    turns = model.turns(transcript)
                    roles, rendered = [role for role, _ in turns], render(turns)
                else:
                    roles, rendered = slice_text(model, transcript, *ends) if ends[0] else ([], "")
                out.append((conv, part, len(roles), ",".join(roles), ",".join(true_roles), rendered))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), shape, strict=True)], schema=shape)

    return placed.mapInArrow(rows, "conv_id bigint, part bigint, n_turns bigint, roles string, true_roles string, rendered string")
