"""Repair of the turn structure of conversations by the cheapest edits.

A conversation is well formed if the initials of its roles read ``(s?(ua)+)?``: nothing, or an optional
system turn and pairs of user and assistant.  Four states tell how far a prefix has come: nothing yet
(""), after a system turn, after a user turn, after an assistant turn.  A forward Viterbi pass over the
turns carries for each state the least (cost, audit string).  A layer is closed by four insert
transitions, which suffice as each leads to one state and costs something.  What the audit strings of all
states begin with is settled: it is taken off and the repaired text goes into its digest, so neither
grows with the conversation unless its states disagree for long.

Rows are shuffled once, by conversation, and come sorted to the pass; a conversation is the unit, as its
digest is one sequence, but it is streamed, never gathered.

Null texts and roles: one space (so blank, and no role of the grammar).  Null turns come first and don't
count for gaps; rows with a null conversation id are one conversation.  Rows of one turn: by role, then
text.  Repeated rows are duplicates like any other.  Texts of any length are single values.  Other columns
are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.llm.common import slices, table

SPACE = r"\x20\x09-\x0D"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The state that a role of this initial leads to.
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: The state that an inserted or renamed turn leads to; there is only one.
FILL = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}
#: Price of Keep, Rerole, Delete and Insert, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, STAYS = 0, 2, 3, 2, 1
#: After so many turns the settled part is taken off.
SETTLE = 64

COLUMNS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Repair:
    """The pass over one conversation."""

    def __init__(self) -> None:
        self.best: dict[str, tuple[int, str]] = {"": (0, "")}
        self._close(self.best)
        self.rows: deque[tuple[str, str]] = deque()
        self.settled: list[str] = []
        self.state, self.digest, self.n = "", hashlib.sha256(), 0

    @staticmethod
    def _close(best: dict[str, tuple[int, str]]) -> None:
        """Turns inserted behind this layer."""
        for state in ("", "s", "u", "a"):
            if state in best:
                cost, audit = best[state]
                found = (cost + INSERT, audit + "I")
                best[FILL[state]] = min(best.get(FILL[state], found), found)

    def add(self, role: str, text: str, fault: int) -> None:
        self.rows.append((role, text))
        stays, layer = STAYS * (fault == TRUNCATED), {}
        for state, (cost, audit) in self.best.items():
            found = [(state, cost + DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                found.append((FILL[state], cost + REROLE + stays, "R"))
                if (state, role[:1]) in STEP:
                    found.append((STEP[state, role[:1]], cost + KEEP + stays, "K"))
            for to, price, letter in found:
                layer[to] = min(layer.get(to, (price, audit + letter)), (price, audit + letter))
        self._close(layer)
        # what begins with nothing or a system turn can be had from the other states at most so much dearer
        least = min(layer["a"][0], layer["u"][0] + INSERT)
        for state, more in (("", DELETE), ("s", 0)):
            if state in layer and layer[state][0] > least + more:
                del layer[state]
        self.best = layer
        if len(self.rows) >= SETTLE and len(self.rows) % SETTLE == 0:
            self._settle()

    def _settle(self) -> None:
        same = os.path.commonprefix([audit for _, audit in self.best.values()])
        if same:
            self._apply(same)
            self.best = {s: (cost, audit[len(same) :]) for s, (cost, audit) in self.best.items()}

    def _apply(self, letters: str) -> None:
        self.settled.append(letters)
        for letter in letters:
            role, text = ("", "") if letter == "I" else self.rows.popleft()
            if letter == "D":
                continue
            if letter == "K":
                self.state = STEP[self.state, role[:1]]
            else:
                self.state = FILL[self.state]
                role = ROLE[self.state]
            self.digest.update(f"{chr(10) if self.n else ''}{role}:{text}".encode())
            self.n += 1

    def close(self) -> tuple[int, str, str]:
        """cost, audit, digest of the repaired conversation."""
        cost, audit = min(self.best[s] for s in ("", "a") if s in self.best)
        self._apply(audit)
        return cost, "".join(self.settled), self.digest.hexdigest()


class Report:
    """The row of one conversation, turn by turn."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.repair = conv_id, Repair()
        self.low = self.high = None
        self.turns = self.illegal = 0
        self.faults = [0] * 4
        self.before: str | None = None

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.repair.add(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, *self.repair.close())


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy, gone: rows damaged by the checksum of their place; dropped ones are marked."""
    none = F.lit(" ")
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), none), F.lit(":"), F.coalesce(F.col("turn").cast("string"), none))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"), (F.crc32(place) % 20).alias("h"))
    h = F.col("h")
    text = F.when(h <= 1, "").when(h == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"), (h == 0).alias("gone"))


def _fault(seen: Column) -> Column:
    text = F.col("text")
    return F.when(~text.rlike(f"[^{SPACE}]"), BLANK).when(seen, DUPLICATE).when(~text.rlike(rf"[.!?][{SPACE}]*\z"), TRUNCATED).otherwise(FINE)


def repair_structure(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows as damage() gives them: counts of faults, the cheapest edits, the digest of the result.

    Rows marked gone only make their conversation appear.
    """
    order = [F.col("turn").asc_nulls_first(), "copy"]
    same = Window.partitionBy("conv_id", "gone", "role", "_text").orderBy(*order)
    # one shuffle: the window over texts and the sort both live in the conversation's partition
    marked = rows.repartition("conv_id").withColumn("_text", F.sha2("text", 256)).withColumn("fault", _fault(F.row_number().over(same) > 1))
    sorted_ = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Report | None = None
        done: list[tuple] = []
        for batch in batches:
            for part in slices(batch):
                for conv_id, turn, role, text, fault, gone in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if now is None or now.conv_id != conv_id:
                        if now is not None:
                            done.append(now.row())
                        now = Report(conv_id)
                    if not gone:
                        now.add(turn, role, text, fault)
                if done:
                    yield _batch(done)
                    done = []
        if now is not None:
            yield _batch([now.row()])

    return sorted_.select("conv_id", "turn", "role", "text", "fault", "gone").mapInArrow(run, COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in COLUMNS.split(", ")])


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_structure(damage(table(spark, sf_dir, "conversations")))


def _least(*found: str) -> str:
    return f"least({', '.join(found)})"


def _plus(state: str, price: str, letter: str) -> str:
    """A state's key, eight digits of cost and the audit, with an edit added; null stays null."""
    return f"lpad(cast(cast(left({state}, 8) as bigint) + {price} as varchar), 8, '0') || substring({state}, 9) || '{letter}'"


def _sql() -> str:
    # of the layer below: what reaches each state by an edit of this row, before inserts
    stays = "(case when fault = 3 then 1 else 0 end)"

    def may(key: str, initials: str | None = None) -> str:
        role = f" and i in ({initials})" if initials else ""
        return f"case when fault not in (1, 2){role} then {key} end"

    def rows(s: str) -> str:
        return may(_plus(s, f"2 + {stays}", "R"))

    z = _plus("z", "3", "D")
    s = _least(_plus("s", "3", "D"), may(_plus("z", stays, "K"), "'s'"))
    u = _least(_plus("u", "3", "D"), *(rows(x) for x in "zsa"), *(may(_plus(x, stays, "K"), "'u'") for x in "zsa"))
    a = _least(_plus("a", "3", "D"), rows("u"), may(_plus("u", stays, "K"), "'a'"))
    return rf"""
with recursive places as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as place
  from conversations),
hashed as (
  select *, xor(list_reduce(list_transform(range(1, length(place) + 1), lambda k: cast(ascii(substring(place, k, 1)) as bigint)),
    lambda c, b: list_reduce(range(0, 8), lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)),
    cast(4294967295 as bigint)), 4294967295) % 20 as h
  from places),
damaged as (
  select conv_id, turn, case when h = 4 then 'user' else role end as role,
    case when h = 1 then '' when h = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, copy
  from hashed cross join (values (0), (1)) t(copy)
  where h <> 0 and (copy = 0 or h = 3)),
marked as (
  select *, left(role, 1) as i,
    row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 1
      when row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 then 2
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 3 else 0 end as fault
  from damaged),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) as illegal
  from (select *, lag(i) over (partition by conv_id order by n) || i as pair from marked)
  group by conv_id),
layers as (
  select conv_id, 0 as n, '00000000' as z, cast(null as varchar) as s, '00000002I' as u, '00000004II' as a
  from (select distinct conv_id from conversations)
  union all
  select conv_id, n, z, s, u2, least(a1, {_plus("u2", "2", "I")})
  from (select *, least(u1, {_plus("a1", "2", "I")}) as u2
    from (select conv_id, n, z, s, u1, least(a0, {_plus("u1", "2", "I")}) as a1
      from (select conv_id, n, z, s, a0, least(u0, {_plus("z", "2", "I")}, {_plus("s", "2", "I")}) as u1
        from (select l.conv_id, m.n, {z} as z, {s} as s, {u} as u0, {a} as a0
          from layers l join marked m on m.conv_id is not distinct from l.conv_id and m.n = l.n + 1) q0) q1) q2) q3),
best as (
  select conv_id, least(z, a) as k from layers l
  where n = (select coalesce(max(n), 0) from marked m where m.conv_id is not distinct from l.conv_id)),
letters as (
  select conv_id, j, substring(k, 8 + j, 1) as e,
    length(replace(substring(k, 9, j), 'I', '')) as n
  from (select conv_id, k, unnest(range(1, length(k) - 7)) as j from best)),
kept as (
  select l.conv_id, l.j, l.e, m.role, m.text, m.i = 's' and l.e = 'K' as first
  from letters l left join marked m on m.conv_id is not distinct from l.conv_id and m.n = l.n and l.e <> 'I'
  where l.e <> 'D'),
turns as (
  select conv_id, j, case when e = 'K' then role
      when row_number() over w % 2 = case when max(cast(first as int)) over (partition by conv_id) = 1 then 0 else 1 end then 'user' else 'assistant' end
    || ':' || case when e = 'I' then '' else text end as line
  from kept window w as (partition by conv_id order by j)),
whole as (select conv_id, string_agg(line, chr(10) order by j) as text from turns group by conv_id)
select b.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate,
  coalesce(c.truncated, 0) as truncated, coalesce(c.illegal, 0) as illegal, cast(left(b.k, 8) as bigint) as cost,
  substring(b.k, 9) as audit, sha256(coalesce(w.text, '')) as repaired_sha256
from best b left join counts c on c.conv_id is not distinct from b.conv_id left join whole w on w.conv_id is not distinct from b.conv_id
"""


OP11_SQL = _sql()
