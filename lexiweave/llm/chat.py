"""Chat formatting: roles of transcript lines by a hidden Markov model, and canonical rendering of turns.

A state is a role and whether a line begins a turn or goes on with one. A line is observed as the role that a speaker marker at its
start names (none, or a name that is no role), whether it is blank, whether it ends in a question mark, how it starts (list, code,
quotation, plain), and in a transcript without any marker also as what its first word is (one of WORDS hashes). Start, transition and emission
probabilities are counted over all labelled turns, in Spark, each as it is written with a marker and without one: transcripts with markers are
decoded by the former, those without by the latter. What is gathered are the counts, whose number is fixed. The Viterbi path then says
where turns begin and whose they are. `parse` does so for a transcript as it is, `parse_transcripts` for a column of them.

Turns are range-sorted by conversation and place, and cut into blocks of BLOCK turns at most, whatever ties there are. In max-plus
arithmetic a block of lines is one matrix over states; the matrices of a conversation are chained from its start, which gives the
states at the blocks' borders, and then blocks are decoded on their own. So no task holds more text than a block.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions, stored, trimmed

#: Canonical roles, other names for them, and how transcripts mark a speaker.
ROLES = ("system", "user", "assistant", "tool")
ALIASES = {"human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user", "bot": "assistant", "ai": "assistant", "gpt": "assistant", "model": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant", "function": "tool", "observation": "tool", "instruction": "system", "developer": "system"}
STYLES = ("{}: ", "### {}:\n", "<|{}|>\n", "[{}] ", "**{}:** ", "{}> ")
_MARKER = re.compile(r"^\s{0,3}(?:#{1,6}\s*([A-Za-z]{1,20})\s*:?\s*$|<\|(?:im_start\|>\s*)?([a-z]{1,20})\|?>?\s?|\[([A-Za-z]{1,20})\]:?\s|\*\*([A-Za-z]{1,20}):?\*\*:?\s?|([A-Za-z]{1,20})\s?[:>](?:\s|$))")
#: Turns of a block, and hashes of first words.
BLOCK, WORDS = 256, 64
#: Parts of conversations: a part's roles are learned from the others.
FOLDS = 2
BEGINS, GOES_ON, START = 0, len(ROLES), 2 * len(ROLES)
STATES = START + 1
MARKERS = len(ROLES) + 2
SYMBOLS = MARKERS * 2 * 2 * 4


def canonical(role: str | None) -> int:
    """Number of a role, -1 where it is none."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) if name in ROLES else -1


def marker(line: str) -> tuple[int, str, bool]:
    """What a line's marker names (0 none, 1 to 4 a role, 5 anything else), the line without a marker of a role, and whether
    it is of a kind that has a line of its own."""
    m = _MARKER.match(line)
    if not m:
        return 0, line, False
    role = canonical(next(g for g in m.groups() if g))
    return (role + 1, line[m.end() :], m.lastindex <= 2) if role >= 0 else (MARKERS - 1, line, False)


def symbol(line: str) -> int:
    named, rest, _ = marker(line)
    plain = rest.strip()
    start = 1 if re.match(r"(?:[-*+•]|\d+[.)])\s", plain) else 2 if plain.startswith(("```", "    ", "def ", "class ", "import ", "{", "<")) else 3 if plain.startswith((">", '"', "“", "«")) else 0
    return ((named * 2 + (not plain)) * 2 + plain.endswith("?")) * 4 + start


def word(line: str) -> int:
    """A hash of a line's first word, without its marker; 0 where there is none."""
    first = marker(line)[1].split(None, 1)
    return 1 + zlib.crc32(first[0].lower().encode()) % (WORDS - 1) if first else 0


def as_lines(role: str | None, text: str | None, style: int) -> list[str]:
    """A turn as a transcript has it: the marker before its text; none where the role is not known."""
    name = (role or "").strip()
    head = STYLES[style % len(STYLES)].format(name.lower() if style % len(STYLES) == 2 else name[:1].upper() + name[1:]) if canonical(role) >= 0 else ""
    return (head + (text or "")).split("\n")


def _style(conv) -> int:
    return zlib.crc32(str(conv).encode())


class Model:
    """Log probabilities: moves between states, and symbols (and first words, if they count) in states. bare: for transcripts without markers."""

    def __init__(self, moves: np.ndarray, emits: np.ndarray, words: np.ndarray | None = None, bare: Model | None = None):
        self.moves, self.emits, self.words, self.bare = moves, emits, words, bare

    @classmethod
    def counted(cls, first: dict, follow: dict, inside: dict, emits: dict, words: dict | None = None, plain: dict | None = None) -> Model:
        """From counts: roles of first turns, pairs of roles, (role, further lines), (state, symbol), (state, word), and (state, symbol) of
        lines without their markers; something is added to all that can be."""
        n = len(ROLES)
        moves = np.full((STATES, STATES), -np.inf)
        start = np.array([first.get(r, 0) + 1.0 for r in range(n)])
        moves[START, :n] = np.log(start / start.sum())
        for r in range(n):
            pairs = np.array([follow.get((r, q), 0) + 1.0 for q in range(n)])
            turns, more = inside.get(r, (0, 0))
            on = (more + 1.0) / (more + turns + 2.0)
            for kind in (BEGINS, GOES_ON):
                moves[kind + r, GOES_ON + r] = np.log(on)
                moves[kind + r, :n] = np.log((1 - on) * pairs / pairs.sum())
        table = np.full((STATES, SYMBOLS), 0.02)
        for (state, sym), k in emits.items():
            table[state, sym] += k
        # what marks do before any is counted: a turn's marker names its role
        for r in range(n):
            table[BEGINS + r].reshape(MARKERS, -1)[r + 1] += 1.0
            table[BEGINS + r].reshape(MARKERS, -1)[0] += 0.05
            table[GOES_ON + r].reshape(MARKERS, -1)[0] += 1.0
            table[GOES_ON + r].reshape(MARKERS, -1)[MARKERS - 1] += 0.5
        said = np.full((STATES, WORDS), 1.0)
        for (state, w), k in (words or {}).items():
            said[state, w] += k
        share = lambda x: np.log(x / x.sum(axis=1, keepdims=True))
        alone = np.full((STATES, SYMBOLS), 0.02)
        for (state, sym), k in (plain or {}).items():
            alone[state, sym] += k
        return cls(moves, share(table), None, cls(moves, share(alone), share(said)))

    def seen(self, observed: tuple[int, int]) -> np.ndarray:
        """Log probability of a line's symbol, and of its word where that counts, in each state."""
        return self.emits[:, observed[0]] if self.words is None else self.emits[:, observed[0]] + self.words[:, observed[1]]

    def matrix(self, symbols: list[tuple[int, int]]) -> np.ndarray:
        """Best log probability of the lines from each state before them to each state at their end."""
        out = np.full((STATES, STATES), -np.inf)
        np.fill_diagonal(out, 0.0)
        for s in symbols:
            out = (out[:, :, None] + self.moves[None]).max(axis=1) + self.seen(s)
        return out

    def decode(self, symbols: list[tuple[int, int]], before: int, after: int | None) -> list[int]:
        """States of the lines on the best path from the state before them, to a last state if one is given; ties go to lower numbers."""
        best = np.full(STATES, -np.inf)
        best[before] = 0.0
        back = []
        for s in symbols:
            steps = best[:, None] + self.moves
            back.append(steps.argmax(axis=0))
            best = steps.max(axis=0) + self.seen(s)
        state = int(best.argmax()) if after is None else after
        path = []
        for b in reversed(back):
            path.append(state)
            state = int(b[state])
        return path[::-1]


def observed(line: str) -> tuple[int, int]:
    return symbol(line), word(line)


def _fold(conv) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(FOLDS)).cast("int")


def _counts(ordered: DataFrame) -> list:
    """Rows (fold, kind, a, b, c, n) of all that models are made of, from the turns in order; their number is bounded."""

    def lines(batches):
        for batch in batches:
            table: dict[tuple, int] = {}

            def add(*key):
                table[key] = table.get(key, 0) + 1

            for conv, role, text, fold, before in zip(*(c.to_pylist() for c in batch.columns)):
                r = canonical(role)
                if before is not None and r >= 0:
                    add(fold, "turn", before, r, 0)
                if r < 0:
                    continue
                for k, line in enumerate(as_lines(role, text, _style(conv))):
                    add(fold, "symbol", r, int(k > 0), symbol(line))
                    add(fold, "word", r, int(k > 0), word(line))
                for k, line in enumerate((text or "").split("\n")):
                    add(fold, "plain", r, int(k > 0), symbol(line))
            rows = [(*k, n) for k, n in table.items()]
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, types)], names=["fold", "kind", "a", "b", "c", "n"])

    rows = ordered.select("conv_id", "role", "text", _fold("conv_id").alias("fold"), "before")
    return rows.mapInArrow(lines, "fold int, kind string, a int, b int, c int, n long").groupBy("fold", "kind", "a", "b", "c").agg(F.sum("n").alias("n")).collect()


def _model(counts: list) -> Model:
    first, follow, inside, emits, words, plain = {}, {}, {}, {}, {}, {}

    def add(table, key, n):
        table[key] = table.get(key, 0) + n

    for c in counts:
        a, b, n = c["a"], c["b"], c["n"]
        state = (GOES_ON if b else BEGINS) + a
        if c["kind"] == "turn" and a == FIRST:
            add(first, b, n)
        elif c["kind"] == "turn" and a >= 0:
            add(follow, (a, b), n)
        elif c["kind"] == "symbol":
            add(emits, (state, c["c"]), n)
            turns, more = inside.get(a, (0, 0))
            inside[a] = (turns, more + n) if b else (turns + n, more)
        elif c["kind"] == "plain":
            add(plain, (state, c["c"]), n)
        elif c["kind"] == "word":
            add(words, (state, c["c"]), n)
    return Model.counted(first, follow, inside, emits, words, plain)


#: What stands for the role before a conversation's first turn, and for one that is not known.
FIRST, UNKNOWN = -1, -2
ORDERED = "conv_id string, turn long, role string, text string, block long, before int"


def _ordered(turns: DataFrame, n: int) -> DataFrame:
    """Turns in order, with the block of each and the number of the role before it (FIRST, UNKNOWN, or null where a range begins)."""

    def number(batches):
        from pyspark import TaskContext

        block, held, last, role_before = TaskContext.get().partitionId() << 32, 0, None, None
        begun = False
        for batch in batches:
            blocks, befores = [], []
            for conv, role in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                new = not begun or conv is None or conv != last
                if begun and (new or held >= BLOCK):
                    block, held = block + 1, 0
                # whether a range goes on with the conversation before it is seen afterwards
                befores.append(None if not begun and conv is not None else FIRST if new else role_before)
                begun, last, held = True, conv, held + 1
                role_before = canonical(role) if canonical(role) >= 0 else UNKNOWN
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(blocks, pa.int64()), pa.array(befores, pa.int32())], names=[c.split()[0] for c in ORDERED.split(", ")])

    order = ["conv_id", "turn", "role", "text", "_at"]
    ranged = turns.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    out = stored(ranged.drop("_at").mapInArrow(number, ORDERED), "turns", compact=True)
    # the first and last turn of each range: at most two rows for each
    part = F.shiftrightunsigned("block", 32)
    edges = out.groupBy(part.alias("part")).agg(F.max_by(F.struct("conv_id", "role"), F.struct("block", "turn", "role", "text")).alias("last"), F.max(F.when(F.col("before").isNull(), F.col("conv_id"))).alias("first")).orderBy("part").collect()
    known, previous = [], None
    for e in edges:
        goes_on = previous is not None and e["first"] is not None and previous["conv_id"] == e["first"]
        known.append((e["part"], (canonical(previous["role"]) if canonical(previous["role"]) >= 0 else UNKNOWN) if goes_on else FIRST))
        previous = e["last"]
    if not known:
        return out
    fixed = F.broadcast(turns.sparkSession.createDataFrame(known, "part long, _before int"))
    return out.withColumn("part", part.cast("long")).join(fixed, "part").withColumn("before", F.coalesce("before", "_before")).select(*[c.split()[0] for c in ORDERED.split(", ")])


def train(turns: DataFrame) -> Model:
    """Counts over all turns with a known role, of conv_id, turn, role, text."""
    return _model(_counts(_ordered(_plain(turns), partitions(turns))))


def _plain(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))


def parse(transcript: str | None, model: Model | None = None) -> list[tuple[str, str]]:
    """(role, text) of the turns of a transcript, markers taken off; without a model what markers say. An empty one has none."""
    if not transcript:
        return []
    model = model or Model.counted({}, {}, {}, {})
    lines, out = transcript.split("\n"), []
    if not any(0 < marker(x)[0] < MARKERS - 1 for x in lines):
        model = model.bare
    skip = False
    for line, state in zip(lines, model.decode([observed(x) for x in lines], START, None)):
        role = state % len(ROLES)
        if state < GOES_ON or not out:
            named, rest, alone = marker(line)
            own = named - 1 == role
            out.append([ROLES[role], [rest if own else line]])
            skip = own and alone and not rest
        elif skip:
            out[-1][1], skip = [line], False
        else:
            out[-1][1].append(line)
    return [(role, "\n".join(text)) for role, text in out]


TURNS = "array<struct<role:string,text:string>>"


def parse_transcripts(df: DataFrame, column: str, model: Model | None = None, into: str = "turns") -> DataFrame:
    """Adds the turns (role, text) of a column of transcripts; null has null, an empty one none."""
    from pyspark.sql.functions import arrow_udf

    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(TURNS)
    def run(texts):
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        return pa.array([None if t is None else [{"role": r, "text": x} for r, x in parse(t, shared.value)] for t in texts.to_pylist()], kind)

    return df.withColumn(into, run(F.col(column)))


def render(lines: list[str], states: list[int], open_: bool = False) -> str:
    """Canonical turns of decoded lines: <|role|>, a line feed, the text without its marker, <|end|> and a line feed.

    open_: the first lines may go on with a turn that began before them.
    """
    out: list[str] = []
    for line, state in zip(lines, states):
        role = state % len(ROLES)
        if state < GOES_ON or not out and not open_:
            named, rest, alone = marker(line)
            if out:
                out.append("<|end|>\n")
            out.append(f"<|{ROLES[role]}|>\n")
            own = named - 1 == role
            out.append(rest if own else line)
            # a marker that fills its line is followed by the text
            skip = own and alone and not rest
            continue
        out.append(line if out and skip else f"\n{line}")
        skip = False
    return "".join(out) + "<|end|>\n"


OUT = "conv_id string, turn long, role string, role_pred string, n_turns long, rendered string"


def format_turns(turns: DataFrame, model: Model | None = None) -> DataFrame:
    """Turns (conv_id, turn, role, text) written as transcripts, parsed again, and rendered: a row for each row.

    role_pred is the role that the parser finds for the turn's first line, n_turns how many turns begin in its lines, rendered
    what they make. Where no model is given each conversation is parsed by what the others' folds teach. A turn without a known role has no
    marker. Null text is empty; null turn numbers come first, turns that tie come in the order of role and text; each row
    without conv_id is a conversation of its own.
    """
    bounded_batches(turns.sparkSession)
    n = partitions(turns)
    blocked = _ordered(_plain(turns), n)
    if model is None:
        counts = _counts(blocked)
        models = [_model([c for c in counts if c["fold"] != k]) for k in range(FOLDS)]
    else:
        models = [model] * FOLDS
    shared = turns.sparkSession.sparkContext.broadcast(models)
    blocked = blocked.select("conv_id", "block", "turn", "role", "text", _fold("conv_id").alias("fold"))
    dealt = lambda df: df.repartition(n, "block").sortWithinPartitions("block", "turn", "role", "text")

    def groups(batches, key_of):
        key, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if key_of(row) != key:
                    if rows:
                        yield rows
                    key, rows = key_of(row), []
                rows.append(row)
        if rows:
            yield rows

    def seen(rows):
        return [[observed(x) for x in as_lines(r[3], r[4], _style(r[0]))] for r in rows]

    def matrices(batches):
        for rows in groups(batches, lambda r: r[1]):
            m = shared.value[rows[0][5]].matrix([s for x in seen(rows) for s in x])
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.string()), pa.array([rows[0][1]], pa.int64()), pa.array([m.tobytes()])], names=["conv_id", "block", "m"])

    def borders(batches):
        for rows in groups(batches, lambda r: r[0]):
            best = np.full(STATES, -np.inf)
            best[START] = 0.0
            back = []
            for _, _, raw in rows:
                steps = best[:, None] + np.frombuffer(raw).reshape(STATES, STATES)
                back.append(steps.argmax(axis=0))
                best = steps.max(axis=0)
            state, out = int(best.argmax()), []
            for (_, block, _), b in zip(reversed(rows), reversed(back)):
                out.append((block, int(b[state]), state))
                state = int(b[state])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["block", "before", "after"])

    def decode(batches):
        for rows in groups(batches, lambda r: r[1]):
            conv = rows[0][0]
            syms = seen(rows)
            before = START if rows[0][6] is None else rows[0][6]
            states = shared.value[rows[0][5]].decode([s for x in syms for s in x], before, rows[0][7])
            out, at = [], 0
            for r, x in zip(rows, syms):
                own = states[at : at + len(x)]
                at += len(x)
                begins = sum(s < GOES_ON for s in own)
                out.append((conv, r[2], r[3], ROLES[own[0] % len(ROLES)], begins, render(as_lines(r[3], r[4], _style(conv)), own)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()))], names=["conv_id", "turn", "role", "role_pred", "n_turns", "rendered"])

    # Conversations of one block need no borders; of others there is a small matrix for each block.
    long_ = stored(blocked.where("conv_id is not null").groupBy("conv_id").agg(F.min("block").alias("a"), F.max("block").alias("b")).where("a <> b").select("conv_id"), "long")
    if long_.isEmpty():
        ready = blocked.select("*", F.lit(None).cast("long").alias("before"), F.lit(None).cast("long").alias("after"))
    else:
        several = blocked.join(long_, "conv_id", "left_semi").select(*blocked.columns)
        made = dealt(several).mapInArrow(matrices, "conv_id string, block long, m binary")
        known = stored(made.repartition(n, "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(borders, "block long, before long, after long"), "borders")
        ready = blocked.join(known, "block", "left").select(*blocked.columns, "before", "after")
    return dealt(ready).mapInArrow(lambda batches: trimmed(decode(batches)), OUT)
