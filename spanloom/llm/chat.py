"""Chat formatting: transcripts to canonical turns.

A hidden Markov model over the lines of a transcript recovers who speaks: its states are the roles, each at
the first line or a later line of a turn, its observations a line's speaker marker, whether it follows a blank
line, asks a question, its length class and whether it opens the transcript. Transition and emission
tables are counted on labelled turns (add-one). Viterbi finds the likeliest roles, for many transcripts side by
side, a step of all of them at a time.

A transcript is one row, or several rows that hold its parts in order, so that a conversation of any length needs no
task of its own: max-plus products are associative, so every part gives the best score for each pair of entry and
exit states (36 numbers), a scan over the parts of a transcript fixes the states between them, and each part is then
decoded on its own. The result is that of the whole transcript.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage_table

ROLES = ("system", "user", "assistant")
#: Fixed: speaker markers and the role that they hint at.
MARKERS = {
    "system": ("system", "sys", "instructions"),
    "user": ("user", "human", "q", "question", "customer", "me"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "model", "agent"),
}
#: Turns of one conversation that make a part of a transcript.
TURNS_PER_PART = 256
#: Lines that are decoded side by side, padding included.
CELLS = 1 << 18
_MARK = re.compile(r"\s*(?:\[|<\|?|\*\*|#+\s*)?([A-Za-z]{1,12})(?:\]|\|?>|\*\*)?\s*[:>](?:\*\*)?\s*", re.A)
_HINT = {word: 1 + i for i, role in enumerate(ROLES) for word in MARKERS[role]}
_ASKS = re.compile(r"\?\s*$")
#: Observation features and their sizes; an observation is their mixed-radix number.
SIZES = {"marker": 4, "blank": 2, "ask": 2, "length": 4, "opens": 2}
N_STATES, N_OBS = 2 * len(ROLES), 128


def marker_of(line: str) -> tuple[int, int]:
    """0 without a marker, else 1 + the index of the role that it hints at; and where the text after it begins."""
    m = _MARK.match(line)
    hint = _HINT.get(m[1].lower(), 0) if m else 0
    return hint, m.end() if hint else 0


def observe(text: str | None, opens: bool = True) -> tuple[list[int], np.ndarray]:
    """The numbers of the non-blank lines of a transcript (or of a part that doesn't open one), and their observations."""
    at, codes, blank = [], [], 0
    for i, line in enumerate((text or "").split("\n")):
        if not line.strip():
            blank = 1
            continue
        size = len(line)
        length = (size >= 40) + (size >= 120) + (size >= 400)
        codes.append((((marker_of(line)[0] * 2 + blank) * 2 + (_ASKS.search(line) is not None)) * 4 + length) * 2 + (opens and i == 0))
        at.append(i)
        blank = 0
    return at, np.array(codes, np.int64)


def _labelled_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a batch of labelled transcripts (part, text, roles, sizes, lead): (p, s, o, n) of a line's state before (-1 start,
    -2 unknown), state, and observation."""
    for b in batches:
        found = []
        for part, text, roles, sizes, lead in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at, codes = observe(text, not part)
            starts = lead + np.cumsum([0, *sizes[:-1]])
            turn = np.searchsorted(starts, at, side="right") - 1
            turn = np.maximum(turn, 0)
            state = 2 * np.array(roles, np.int64)[turn] + (starts[turn] != at)
            if len(state):
                found.append(np.stack([np.append(-2 if part else -1, state[:-1]), state, codes]))
        if found:
            rows, n = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(r) for r in rows), pa.array(n)], ["p", "s", "o", "n"])


def learn(labelled: DataFrame) -> dict:
    """The model from labelled transcripts (as_transcripts). States: 2 * role + (0: first line of its turn, 1: later).
    Counts only: what comes to the driver has fixed size. Without any line the default model."""
    small_batches(labelled.sparkSession)
    counts = labelled.select("part", "text", "roles", "sizes", "lead").mapInArrow(_labelled_counts, "p bigint, s bigint, o bigint, n bigint")
    rows = counts.groupBy("p", "s", "o").agg(F.sum("n").alias("n")).collect()  # at most 8 * 6 * 128
    if not rows:
        return default_model()
    trans, start = np.ones((N_STATES, N_STATES)), np.ones(N_STATES)
    tables = {f: np.ones((N_STATES, size)) for f, size in SIZES.items()}
    for r in rows:
        if r.p >= 0:
            trans[r.p, r.s] += r.n
        elif r.p == -1:
            start[r.s] += r.n
        for f, value in zip(SIZES, np.unravel_index(r.o, tuple(SIZES.values())), strict=True):
            tables[f][r.s, value] += r.n
    # a later line stays in its turn; a transcript starts with a first line
    for p in range(N_STATES):
        for s in range(1, N_STATES, 2):
            if p // 2 != s // 2:
                trans[p, s] = 1e-9
    start[1::2] = 1e-9
    return _model(start, trans, tables)


def _model(start: np.ndarray, trans: np.ndarray, tables: dict[str, np.ndarray]) -> dict:
    """Logarithms of the shares; emissions as one table of states by observations."""
    at = np.unravel_index(np.arange(N_OBS), tuple(SIZES.values()))
    emit = sum(np.log(t / t.sum(axis=1, keepdims=True))[:, at[i]] for i, t in enumerate(tables.values()))
    return {"start": np.log(start / start.sum()), "trans": np.log(trans / trans.sum(axis=1, keepdims=True)), "emit": emit.T.copy()}


def default_model() -> dict:
    """A model without training data: markers are trusted, roles alternate."""
    trans = np.full((N_STATES, N_STATES), 1e-9)
    for p in range(N_STATES):
        for s in range(0, N_STATES, 2):
            trans[p, s] = 0.02 if p // 2 == s // 2 or s == 0 else 0.2
        trans[p, p // 2 * 2 + 1] = 0.5
    tables = {f: np.ones((N_STATES, size)) for f, size in SIZES.items()}
    for s in range(N_STATES):
        tables["marker"][s] = [0.97, 0.01, 0.01, 0.01] if s % 2 else [0.2, 0.02, 0.02, 0.02]
        if s % 2 == 0:
            tables["marker"][s, 1 + s // 2] = 0.74
    return _model(np.array([0.3, 1e-9, 0.6, 1e-9, 0.1, 1e-9]), trans, tables)


def _side_by_side(seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Groups of sequences of like length, longest first: their indexes, padded observations, and how many reach each step."""
    order = sorted((i for i in range(len(seqs)) if len(seqs[i])), key=lambda i: -len(seqs[i]))
    while order:
        longest = len(seqs[order[0]])
        group, order = order[: max(1, CELLS // longest)], order[max(1, CELLS // longest) :]
        size = np.array([len(seqs[i]) for i in group])
        codes = np.zeros((len(group), longest), np.int64)
        for row, i in enumerate(group):
            codes[row, : size[row]] = seqs[i]
        yield group, codes, np.array([(size > t).sum() for t in range(longest)])


def viterbi(seqs: list[np.ndarray], model: dict, before: list[int | None] | None = None, last: list[int | None] | None = None) -> list[np.ndarray]:
    """The best states of each sequence of observations, after state ``before`` (None: a transcript's start) and ending in
    state ``last`` (None: the best). Ties: the lowest state."""
    out = [np.empty(0, np.int64) for _ in seqs]
    trans, emit = model["trans"], model["emit"]
    for group, codes, reach in _side_by_side(seqs):
        entry = np.stack([model["start"] if before is None or before[i] is None else trans[before[i]] for i in group])
        dp = entry + emit[codes[:, 0]]
        back = np.zeros((codes.shape[1], len(group), N_STATES), np.int8)
        for t in range(1, codes.shape[1]):
            n = reach[t]
            step = dp[:n, :, None] + trans
            back[t, :n] = step.argmax(axis=1)
            dp[:n] = step.max(axis=1) + emit[codes[:n, t]]
        size = [len(seqs[i]) for i in group]
        path = np.zeros(codes.shape, np.int64)
        end = dp.argmax(axis=1)
        for row, i in enumerate(group):
            path[row, size[row] - 1] = end[row] if last is None or last[i] is None else last[i]
        for t in range(codes.shape[1] - 1, 0, -1):
            n = reach[t]
            path[:n, t - 1] = back[t, np.arange(n), path[:n, t]]
        for row, i in enumerate(group):
            out[i] = path[row, : size[row]]
    return out


def transfers(seqs: list[np.ndarray], model: dict) -> list[np.ndarray | None]:
    """Best score of each sequence from each state before it (row 6: a transcript's start) to each state at its end; None
    of an empty one."""
    out: list[np.ndarray | None] = [None] * len(seqs)
    trans, emit = model["trans"], model["emit"]
    for group, codes, reach in _side_by_side(seqs):
        m = np.concatenate((trans, model["start"][None]))[None] + emit[codes[:, 0]][:, None]
        for t in range(1, codes.shape[1]):
            n = reach[t]
            m[:n] = (m[:n, :, :, None] + trans).max(axis=2) + emit[codes[:n, t]][:, None]
        for row, i in enumerate(group):
            out[i] = m[row]
    return out


def _transfer_rows(model: dict):
    def run(batches):
        for b in batches:
            seqs = [observe(t, not p)[1] for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            m = [None if x is None else x.ravel().tolist() for x in transfers(seqs, model)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.list_(pa.float64()))], ["_id", "part", "m"])

    return run


def _scan(kind: str):
    def scan(key, frame):
        """The states between the parts of a transcript: a Viterbi over parts, 42 numbers for each. Parts without lines pass
        their state on."""
        frame = frame.sort_values("part").reset_index(drop=True)
        dp, back = None, []
        for m in frame["m"]:
            if m is None:
                back.append(None)
                continue
            m = np.array(m).reshape(N_STATES + 1, N_STATES)
            if dp is None:
                dp = m[N_STATES]
                back.append("start")
            else:
                step = dp[:, None] + m[:N_STATES]
                back.append(step.argmax(axis=0))
                dp = step.max(axis=0)
        state = None if dp is None else int(dp.argmax())
        before, last = [], []
        for b in reversed(back):
            last.append(state)
            if b is not None and not isinstance(b, str):
                state = int(b[state])
            elif b is not None:
                state = None
            before.append(state)
        return pd.DataFrame({"_id": [key[0]] * len(frame), "part": frame["part"], "before": pd.array(before[::-1], "Int32"), "last": pd.array(last[::-1], "Int32")})

    return scan, f"_id {kind}, part bigint, before int, last int"


_LINES = "array<struct<line:int,body:string,role:string,first:int>>"
_PIECES = "array<struct<first:int,role:string,content:string>>"


def _decoded(model: dict, pieces: bool):
    """Rows (_id, part, text, before, last) to (_id, part, out): lines with their roles, or pieces of turns."""

    def run(batches):
        for b in batches:
            parts, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            seen = [observe(t, not p) for p, t in zip(parts, texts, strict=True)]
            paths = viterbi([codes for _, codes in seen], model, b.column(3).to_pylist(), b.column(4).to_pylist())
            out = []
            for text, (at, _), states in zip(texts, seen, paths, strict=True):
                lines = (text or "").split("\n")
                rows = [(i, lines[i], ROLES[s // 2], int(s % 2 == 0)) for i, s in zip(at, states.tolist(), strict=True)]
                if not pieces:
                    out.append([dict(zip(("line", "body", "role", "first"), r, strict=True)) for r in rows])
                    continue
                turns = []
                for _, body, role, first in rows:
                    if first:
                        turns.append((1, role, [body[marker_of(body)[1] :].strip(" ")]))
                    elif turns:
                        turns[-1][2].append(body.strip(" "))
                    else:
                        turns.append((0, role, [body.strip(" ")]))
                out.append([{"first": f, "role": r, "content": "\n".join(c)} for f, r, c in turns])
            kind = [("first", pa.int32()), ("role", pa.string()), ("content", pa.string())] if pieces else [("line", pa.int32()), ("body", pa.string()), ("role", pa.string()), ("first", pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct(kind)))], ["_id", "part", "out"])

    return run


def _decode(transcripts: DataFrame, model: dict | None, id_col: str, text_col: str, part_col: str | None, pieces: bool) -> tuple[DataFrame, DataFrame | None]:
    """(_id, part, out) of the transcripts of one part, and of those of several (None if there are none)."""
    small_batches(transcripts.sparkSession)
    model = model or default_model()
    part = F.coalesce(F.col(part_col).cast("bigint"), F.lit(0)) if part_col else F.lit(0).cast("bigint")
    df = transcripts.select(F.col(id_col).alias("_id"), part.alias("part"), F.col(text_col).alias("text"))
    kind = df.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, part bigint, out {_PIECES if pieces else _LINES}"
    none = F.lit(None).cast("int")
    run = lambda x: x.mapInArrow(_decoded(model, pieces), schema)
    if part_col is None:
        return run(df.select("*", none.alias("before"), none.alias("last"))), None
    long_ = stage_table(df.filter("part <> 0").select(F.col("_id").alias("_long")).distinct())
    if long_.isEmpty():
        return run(df.select("*", none.alias("before"), none.alias("last"))), None
    same = F.col("_id").eqNullSafe(F.col("_long"))
    alone = run(df.join(long_, same, "left_anti").select("*", none.alias("before"), none.alias("last")))
    several = stage_table(df.join(long_, same, "left_semi"))
    scan, scanned = _scan(kind)
    ends = several.mapInArrow(_transfer_rows(model), f"_id {kind}, part bigint, m array<double>").groupBy("_id").applyInPandas(scan, scanned)
    ends = ends.select(F.col("_id").alias("_e"), F.col("part").alias("_p"), "before", "last")
    ready = several.join(ends, F.col("_id").eqNullSafe(F.col("_e")) & (F.col("part") == F.col("_p"))).select("_id", "part", "text", "before", "last")
    return alone, run(ready)


def recover_roles(transcripts: DataFrame, model: dict | None = None, id_col: str = "id", text_col: str = "text", part_col: str | None = None) -> DataFrame:
    """A row for each non-blank line of every transcript: id_col, part, line (in its part), body, role, first (a turn
    begins here). ``part_col`` numbers the parts of a transcript, from 0.

    Null and blank transcripts have no lines; other columns are not carried; without part_col each row is a transcript
    of its own, also of a repeated or null id; with it, rows of one id (null too) are one transcript, whose parts must
    be told apart by their numbers; an empty table gives no rows."""
    alone, several = _decode(transcripts, model, id_col, text_col, part_col, False)
    df = alone if several is None else alone.union(several)
    return df.select(F.col("_id").alias(id_col), "part", F.explode("out").alias("x")).select(id_col, "part", "x.*")


def turns(transcripts: DataFrame, model: dict | None = None, id_col: str = "id", text_col: str = "text", part_col: str | None = None) -> DataFrame:
    """Canonical turns: id_col, turn (from 0), role, content (markers removed, lines joined), rendered
    (``<|role|>\\ncontent\\n<|end|>``). Nulls, blanks, repeats: as in recover_roles."""
    alone, several = _decode(transcripts, model, id_col, text_col, part_col, True)
    df = alone.select("_id", F.posexplode("out").alias("turn", "x")).select("_id", F.col("turn").cast("bigint").alias("turn"), "x.role", "x.content")
    if several is not None:
        pieces = stage_table(several.select("_id", "part", F.posexplode("out").alias("k", "x")).select("_id", "part", "k", "x.*"))
        # pieces that don't begin a turn continue that of the part before
        begun = pieces.groupBy("_id", "part").agg(F.sum("first").alias("begun"), F.min("first").alias("whole"))
        earlier = F.coalesce(F.sum("begun").over(Window.partitionBy("_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        begun = begun.select(F.col("_id").alias("_b"), F.col("part").alias("_p"), earlier.alias("earlier"), "whole")
        placed = pieces.join(begun, F.col("_id").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p")))
        turn = F.greatest(F.lit(0).cast("bigint"), F.col("earlier") + F.col("k") + F.col("whole") - 1)
        merged = placed.withColumn("turn", turn).groupBy("_id", "turn").agg(
            F.min_by("role", F.struct("part", "k")).alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "k", "content"))), lambda x: x["content"]), "\n").alias("content")
        )
        df = df.union(merged)
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>"))
    return df.select(F.col("_id").alias(id_col), "turn", "role", "content", rendered.alias("rendered"))


def as_transcripts(conversations: DataFrame, turns_per_part: int = TURNS_PER_PART) -> DataFrame:
    """Raw transcripts of a table of turns, in parts of so many turn numbers: id, part, text, and for learning the roles and
    sizes (lines) of the turns and the number of lines before them (lead). Per conversation one of several marker styles, and every fifth turn (by hash) without
    a marker, as logs have them. Blank lines part the turns of two styles.

    Turns of equal number are in order of their marked text, then role; a null turn counts as 0, a null or unknown role as user;
    a part grows beyond turns_per_part rows only if turn numbers repeat in a conversation."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    names = F.create_map(*[x for r, m in MARKERS.items() for x in (F.lit(r), F.array(*[F.lit(v) for v in m[:3]]))])
    name = F.coalesce(F.get(F.try_element_at(names, F.col("role")), F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(3)).cast("int")), F.lit("user"))
    mark = F.when(style == 0, F.concat(F.initcap(name), F.lit(": "))).when(style == 1, F.concat(name, F.lit("> "))).when(style == 2, F.concat(F.lit("["), F.upper(name), F.lit("]: "))).otherwise(F.concat(F.lit("**"), F.initcap(name), F.lit(":** ")))
    mark = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(5)) == 0, F.lit("")).otherwise(mark)
    text = F.concat(mark, F.coalesce("text", F.lit("")))
    known = F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.coalesce("role", F.lit("user"))) - 1
    role = F.when(known < 0, ROLES.index("user")).otherwise(known).cast("int")
    part = F.floor(F.coalesce("turn", F.lit(0)) / turns_per_part).cast("bigint")
    rows = conversations.select("conv_id", style.alias("style"), part.alias("part"), "turn", text.alias("t"), role.alias("r"))
    grouped = rows.groupBy("conv_id", "part").agg(F.first("style").alias("style"), F.array_sort(F.collect_list(F.struct("turn", "t", "r"))).alias("ts"))
    gap = F.when(F.col("style") % 2 == 0, 2).otherwise(1)
    # a later part of a style with blank lines begins with one
    lead = F.when((F.col("part") > 0) & (F.col("style") % 2 == 0), F.lit("\n")).otherwise(F.lit(""))
    joined = F.expr(r"array_join(transform(ts, x -> x.t), if(style % 2 = 0, '\n\n', '\n'))")
    sizes = F.transform("ts", lambda x: (F.size(F.split(x["t"], "\n")) + gap - 1).cast("int"))
    first = F.when(F.length(lead) > 0, 1).otherwise(0).cast("int")
    return grouped.select(
        F.col("conv_id").alias("id"), "part", F.concat(lead, joined).alias("text"), F.transform("ts", lambda x: x["r"]).alias("roles"), sizes.alias("sizes"), first.alias("lead"),
    )


def op1_chat_hmm(spark, sf_dir):
    from .common import table

    transcripts = stage_table(as_transcripts(table(spark, sf_dir, "conversations")))
    learned = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 4 != 2, F.lit(True))
    found = turns(transcripts, learn(transcripts.filter(learned)), part_col="part")
    return found.select(F.col("id").alias("conv_id"), "turn", "role", "content", "rendered")
