"""Structure repair of conversations: the cheapest edits that give `(s?(ua)+)?`, an optional system row and then pairs of user and assistant.

A conversation is searched depth first by branch and bound. A node is (rows read, state of the grammar); its branches are Delete,
Insert, Keep and Rerole. The stack is explicit; a lower bound of the suffix (faults that cost something whatever is done, and
disjoint neighbours of which one must change) cuts a branch that cannot beat the incumbent (cost, audit); a table per node holds the best
prefix that reached it, and worse prefixes end there. When the stack is empty the incumbent is proved best.

Long conversations are searched in stretches of STRETCH rows: a stretch has a best (cost, audit) for each pair of states at its ends,
and the best way through all stretches is put together from these. An insert belongs to the row after it, so of two ways no audit is the beginning of the
other, and their order is that of their first difference.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.session import cut

ROLES = ("user", "assistant")
SPACE = r"\x20\x09-\x0D"
#: Costs of the edits. A row that is kept or reroled although its text breaks off costs one more.
DELETE, INSERT, REROLE, BROKEN = 3, 2, 2, 1
#: States: nothing read, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a reroled or inserted row leads.
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
COMPLETE = (START, ASSISTANT)
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: A way to another state at the end of a stretch that costs this much more than the cheapest is never needed: inserts and one delete make up for it.
SPARE = 2 * INSERT + DELETE
STRETCH = 64
#: Stretches whose best ways a worker remembers.
MEMORY = 50_000


class Bounds:
    """What the rows from a place on cost at least, after a state.

    Every row costs what it costs by itself; a row of another role, or of the system unless it is the first, must change. Between two
    neighbours of the other rows these take turns, so their number must be odd or even; else a neighbour changes, a row comes between (2)
    or one of them goes (1 more than to rerole it, nothing where its text breaks off). Pairs that share no row add up.
    """

    def __init__(self, rows: str, last: bool) -> None:
        n = len(rows)
        self.rows, self.last, self.base, self.systems = rows.lower(), last, [0] * (n + 1), [False] * (n + 1)
        #: From a place on: the next row that may stay, how many must change before it, and whether one of those breaks off.
        self.next, self.between, self.free = [n] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        self.pairs = [0] * (n + 1)
        for i in range(n - 1, -1, -1):
            row, broken = self.rows[i], rows[i].isupper()
            self.base[i] = self.base[i + 1] + (DELETE if row == "x" else REROLE * (row in "os") + BROKEN * broken)
            self.systems[i] = self.systems[i + 1] or row == "s"
            self.next[i], self.between[i], self.free[i] = self.next[i + 1], self.between[i + 1], self.free[i + 1]
            if row in "os":
                self.between[i], self.free[i] = self.between[i] + 1, self.free[i] or broken
            elif row != "x":
                self.next[i], self.between[i], self.free[i] = i, 0, False
            self.pairs[i] = self.pairs[i + 1]
            if row in "ua":
                self.pairs[i] = max(self.pairs[i], self._with(AFTER[row], i + 1))

    def _with(self, state: int, i: int) -> int:
        """The pairs from i on, the first of them the state and the next row that may stay, or the end."""
        j, k = self.next[i], self.between[i]
        for _ in range(2 - k % 2 if k else 0):
            state = TURN[state]
        if j == len(self.rows):
            together, rest = not self.last or state in COMPLETE, 0
        else:
            together, rest = (state, self.rows[j]) in FOLLOWS, self.pairs[j + 1]
        return rest + (0 if together or self.free[i] else DELETE - REROLE if k else INSERT)

    def at(self, i: int, state: int) -> int:
        if state == START and self.systems[i]:
            return self.base[i] - REROLE + self.pairs[i]  # one system row may stay
        return self.base[i] + max(self.pairs[i], self._with(state, i))


def search(rows: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
    """The best (cost, audit) from the entry state through all rows, by the state at the end; of a last stretch one way, under START.

    Rows are s, u, a or o (another role), in capitals where the text breaks off, x where the row must be deleted.
    """
    n, bounds = len(rows), Bounds(rows, last)
    incumbents: dict[int, tuple[int, str]] = {}
    best: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        known = best[i].get(state)
        if known is not None and known <= (cost, audit):
            continue
        if incumbents:
            least = cost + bounds.at(i, state)
            if last:
                top, found = incumbents[START]
                if least > top or (least == top and audit > found[:len(audit)]):
                    continue
            elif least > min(c for c, _ in incumbents.values()) + SPARE:
                continue
        best[i][state] = cost, audit
        ways = []
        if i < n:
            row = rows[i]
            ways.append((i + 1, state, cost + DELETE, audit + "D"))
            if row != "x":
                broken = BROKEN * row.isupper()
                kept = FOLLOWS.get((state, row.lower()))
                if kept is not None:
                    ways.append((i + 1, kept, cost + broken, audit + "K"))
                ways.append((i + 1, TURN[state], cost + REROLE + broken, audit + "R"))
        elif not last or state in COMPLETE:
            end = START if last else state
            if end not in incumbents or (cost, audit) < incumbents[end]:
                incumbents[end] = cost, audit
        if i < n or (last and state not in COMPLETE):
            ways.append((i, TURN[state], cost + INSERT, audit + "I"))
        # The most promising way is on top of the stack.
        ways.sort(key=lambda way: (way[2] + bounds.at(way[0], way[1]), way[3]), reverse=True)
        stack.extend(ways)
    return incumbents


class Repairer:
    """The best edits of whole conversations; what was found for a stretch is remembered."""

    def __init__(self) -> None:
        self.known: dict[tuple[str, int, bool], dict[int, tuple[int, str]]] = {}

    def _stretch(self, rows: str, entry: int, last: bool) -> dict[int, tuple[int, str]]:
        key = rows, entry, last
        if key not in self.known:
            if len(self.known) >= MEMORY:
                self.known.clear()
            self.known[key] = search(rows, entry, last)
        return self.known[key]

    def repair(self, rows: str, stretch: int = STRETCH) -> tuple[int, str]:
        """(cost, audit)."""
        # By state: cost, place of the audit among those of the other states, the audit as links.
        live: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}
        for start in range(0, max(1, len(rows)), stretch):
            last = start + stretch >= len(rows)
            ways: dict[int, tuple[int, int, str, tuple | None]] = {}
            for state, (cost, place, link) in live.items():
                for end, (more, audit) in self._stretch(rows[start:start + stretch], state, last).items():
                    way = cost + more, place, audit, link
                    if end not in ways or way[:3] < ways[end][:3]:
                        ways[end] = way
            order = sorted(ways, key=lambda end: ways[end][1:3])
            live = {end: (ways[end][0], order.index(end), (ways[end][3], ways[end][2])) for end in order}
        cost, _, link = live[START]
        parts = []
        while link is not None:
            link, part = link
            parts.append(part)
        return cost, "".join(reversed(parts))


def facts(conversation: Column, turn: Column, role: Column, text: Column, present: Column) -> list[Column]:
    """What the edits depend on, computed before rows move: no text is among it."""
    initial = F.substring(role, 1, 1)
    blank = ~text.rlike(f"[^{SPACE}]")
    broken = ~text.rlike(rf"[.!?][{SPACE}]*\z")
    return [conversation.alias("_conv"), turn.alias("_turn"), role.alias("_role"), sameness(role, text).alias("_same"), present.alias("_present"), initial.alias("_initial"),
            F.when(blank, "b").when(broken, "t").otherwise("").alias("_fault")]


def sameness(role: Column, text: Column) -> Column:
    """Equal for equal role and text."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


#: Order of a conversation's rows; equal turns by role, then by a digest of role and text.
ORDER = ["_turn", "_role", "_same"]


def _runs(column: pa.Array) -> Iterator[tuple[object, int, int]]:
    """(value, start, stop) of equal neighbours."""
    values = column.to_pylist()
    start = 0
    for i in range(1, len(values) + 1):
        if i == len(values) or values[i] != values[start]:
            yield values[start], start, i
            start = i


class _Tally:
    """One conversation while its rows pass."""

    def __init__(self, name: object) -> None:
        self.name, self.rows, self.seen = name, [], set()
        self.first = self.latest = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, turn: int | None, same: bytes, initial: str, fault: str) -> None:
        if turn is not None:
            self.turns += self.latest is None or turn != self.latest
            self.first = turn if self.first is None else self.first
            self.latest = turn
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        again = same in self.seen
        self.seen.add(same)
        if fault == "b":
            self.blank += 1
        elif again:
            self.duplicate += 1
        elif fault:
            self.truncated += 1
        code = initial if initial in ("s", "u", "a") else "o"
        self.rows.append("x" if fault == "b" or again else code.upper() if fault else code)

    def row(self, repairer: Repairer) -> tuple:
        cost, audit = repairer.repair("".join(self.rows))
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.turns
        return self.name, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _shaped(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present_col: str | None) -> list[Column]:
    text = lambda c: F.coalesce(F.col(c), F.lit(" "))
    present = F.coalesce(F.col(present_col), F.lit(False)) if present_col else F.lit(True)
    return facts(F.col(conv_col), F.col(turn_col).cast("long"), text(role_col), text(text_col), present)


def audits(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present_col: str | None = None) -> DataFrame:
    """Per conversation: its id, `gaps`, `blank`, `duplicate`, `truncated`, `illegal`, `cost` and `audit`.

    A conversation's rows stand by turn, nulls first, equal turns by role and then by the MD5 of role and text. A null role or text counts as one space.
    Rows are counted by their first fault: blank, equal role and text before, broken off. `gaps` counts the turns that lack between the first and the last,
    `illegal` the neighbours other than system-user, user-assistant and assistant-user, by initials; a role without one goes with nothing. A row whose `present_col` is not true
    only names its conversation; one without other rows has zeros and an empty audit. A null id is an id. Only the named columns are read.

    Rows pass in order, sorted by Spark. Of a conversation a task holds a letter and a digest per row, never a text.
    """
    key = rows.schema[conv_col].dataType.simpleString()
    laid = rows.select(*_shaped(rows, conv_col, turn_col, role_col, text_col, present_col)).repartition("_conv").sortWithinPartitions("_conv", *ORDER)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, tally = Repairer(), None
        schema = None
        for batch in batches:
            schema = pa.schema([pa.field("_conv", batch.schema.field("_conv").type), *[pa.field(n, pa.int64()) for n in NUMBERS], pa.field("audit", pa.string())])
            turn, same, present, initial, fault = (batch.column(c).to_pylist() for c in ("_turn", "_same", "_present", "_initial", "_fault"))
            out = []
            for name, start, stop in _runs(batch.column("_conv")):
                if tally is None or tally.name != name:
                    if tally is not None:
                        out.append(tally.row(repairer))
                    tally = _Tally(name)
                for i in range(start, stop):
                    if present[i]:
                        tally.add(turn[i], same[i], initial[i], fault[i])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if tally is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(tally.row(repairer), schema, strict=True)], schema=schema)

    found = laid.mapInArrow(judge, f"_conv {key}, {', '.join(f'{n} long' for n in NUMBERS)}, audit string")
    return found.withColumnRenamed("_conv", conv_col)


def repaired(rows: DataFrame, found: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
             present_col: str | None = None) -> DataFrame:
    """The conversations as `audits` (called on the same rows) repairs them: id, `position` (from 0), `turn`, `role`, `text` and `edit` (K, R or I).

    Inserted rows have no turn and an empty text. All rows of a conversation come from one partition, one after the other in order. A conversation's
    audit precedes its rows, so rows are written as they pass.
    """
    key = rows.schema[conv_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(" ")).alias("_text")
    own = rows.select(*_shaped(rows, conv_col, turn_col, role_col, text_col, present_col), text)
    own = own.filter("_present").select("_conv", "_turn", "_role", "_same", "_text", F.lit(None).cast("string").alias("_audit"))
    plans = found.select(F.col(conv_col).alias("_conv"), F.lit(None).cast("long").alias("_turn"), F.lit("").alias("_role"), F.lit(None).cast("binary").alias("_same"),
                         F.lit("").alias("_text"), F.col("audit").alias("_audit"))
    laid = own.unionByName(plans).repartition("_conv").sortWithinPartitions("_conv", F.col("_audit").isNull(), *ORDER).drop("_same")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, audit, at, state, position = None, "", 0, START, 0
        schema = None

        def inserted(out: list) -> None:
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                state = TURN[state]
                out.append((name, position, None, ROLES[state - USER], "", "I"))
                at, position = at + 1, position + 1

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = pa.schema([("_conv", batch.schema.field("_conv").type), ("position", pa.int64()), ("_turn", pa.int64()), ("_role", pa.string()),
                                ("_text", pa.string()), ("edit", pa.string())])
            out: list = []
            convs, turns, roles, texts, plans_ = (batch.column(c).to_pylist() for c in ("_conv", "_turn", "_role", "_text", "_audit"))
            for i, plan in enumerate(plans_):
                if plan is not None:
                    inserted(out)
                    name, audit, at, state, position = convs[i], plan, 0, START, 0
                    continue
                inserted(out)
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                state = AFTER[roles[i][0]] if edit == "K" else TURN[state]
                out.append((name, position, turns[i], roles[i] if edit == "K" else ROLES[state - USER], texts[i], edit))
                position += 1
            if out:
                yield batch_of(out)
        out = []
        inserted(out)
        if out:
            yield batch_of(out)

    done = laid.mapInArrow(apply, f"_conv {key}, position long, _turn long, _role string, _text string, edit string")
    return done.select(F.col("_conv").alias(conv_col), "position", F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text"), "edit")


def digests(fixed: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Id and `repaired_sha256` of each conversation in the rows of `repaired`: SHA-256 of `role:text`, joined by newlines, row by row as they pass."""
    key = fixed.schema[conv_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha, kind = None, None, None
        for batch in batches:
            kind = batch.schema.field(0).type
            out = []
            convs, places, roles, texts = (batch.column(i).to_pylist() for i in range(4))
            for conv, place, role, text in zip(convs, places, roles, texts, strict=True):
                if place == 0:
                    if sha is not None:
                        out.append((name, sha.hexdigest()))
                    name, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out])], names=["_conv", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([name], kind), pa.array([sha.hexdigest()])], names=["_conv", "repaired_sha256"])

    return fixed.select(conv_col, "position", "role", "text").mapInArrow(digest, f"_conv {key}, repaired_sha256 string").withColumnRenamed("_conv", conv_col)


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults by a checksum of id and turn: `present` is false for rows that are dropped; nulls count as one space."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind"))
    changed = F.when(F.col("_kind").isin(0, 1), "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return marked.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"),
                         (F.col("_kind") != 0).alias("present"), twice.alias("_copy")).drop("_copy")


def repair(rows: DataFrame, present_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows); the audits are written once, both are read from them."""
    found = cut(audits(rows, present_col=present_col))
    return found, repaired(rows, found, present_col=present_col)
