"""Repair of conversations' structure by a dynamic program over a grammar of their rows.

A row becomes a symbol of its role and fault. Pairs of neighbouring symbols that are frequent in all
conversations become rules (Re-Pair, in rounds); a symbol is a matrix of the cheapest edits from one
state of the wanted structure to another, and a rule is the min-plus product of its two symbols'
matrices, evaluated once, bottom-up. An edit's record is a rope: rules share those of their parts.
Cheapest records of equal cost never stand in each other's beginning, as each row has one letter and
insertions cost, so the ASCII-least record of parts makes the ASCII-least record of the whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import checkpointed, lookup, small_batches, table

#: One of so many rows is damaged in each of the ways below, by the checksum of its place.
WAYS = 20
DROPPED, EMPTIED, UNSTOPPED, REPEATED, REROLED = range(5)
#: What edits cost; a truncated row that stays costs more.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after a system row, after a user's, after an assistant's. What a role leads to, and the states in which a conversation may end.
STATES, START, ENDS = range(4), 0, (0, 3)
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: A row that must go; rows that may stay are the initial of their role, `o` for others, a capital if truncated.
GOES, OTHER = "x", "o"
SYMBOLS = "xsuaoSUAO"
#: Rules at most, rounds, rules of a round; a round that would replace less than this share of all symbols isn't made.
RULES, ROUNDS, PER_ROUND, GAIN = 1_024, 16, 96, 0.01
#: The first code point of rules.
BASE = 0x4E00
#: Results of whole conversations that a task remembers, each of at most so many symbols.
HELD, HELD_SIZE = 20_000, 64
#: Rows of an output batch.
ROWS = 4_096
Batches = Iterator[pa.RecordBatch]
_PRIME, _FACTOR = (1 << 61) - 1, 1_000_003


@dataclass(frozen=True, eq=False)
class Rope:
    """A text as a letter, or as two others; `power` is the factor to the power of its size."""

    size: int
    hash: int
    power: int
    letter: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        return Rope(self.size + other.size, (self.hash * other.power + other.hash) % _PRIME, self.power * other.power % _PRIME, "", self, other)

    def __str__(self) -> str:
        out, rest = [], [self]
        while rest:
            x = rest.pop()
            if x.left is not None:
                rest += [x.right, x.left]
            else:
                out.append(x.letter)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """Equal parts are passed over by their hashes."""
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.size == y.size and x.hash == y.hash):
                continue
            if x.size == y.size == 1:
                return x.letter < y.letter
            if x.size >= y.size and x.left is not None:
                a += [x.right, x.left]
                b.append(y)
            elif y.left is not None:
                a.append(x)
                b += [y.right, y.left]
            else:
                return x.size < y.size
        return bool(b)


EMPTY = Rope(0, 0, 1)
LETTERS = {c: Rope(1, ord(c), _FACTOR, c) for c in "DIKR"}
#: (cost, record); a matrix has them by (state before, state after).
Edit = tuple[int, Rope]
Matrix = dict[tuple[int, int], Edit]


def _better(matrix: Matrix, key: tuple[int, int], edit: Edit) -> None:
    if key not in matrix or edit[0] < matrix[key][0] or (edit[0] == matrix[key][0] and edit[1] < matrix[key][1]):
        matrix[key] = edit


def product(a: Matrix, b: Matrix) -> Matrix:
    """Of each pair of states the cheapest way over any state between, of equal cost the ASCII-least record."""
    out: Matrix = {}
    for (i, k), (cost, record) in a.items():
        for j in STATES:
            if (k, j) in b:
                more, then = b[k, j]
                known = out.get((i, j))
                if known is None or cost + more <= known[0]:
                    _better(out, (i, j), (cost + more, record + then))
    return out


def inserted() -> Matrix:
    """Any number of insertions: a way that comes back to its state is never cheaper than none."""
    out: Matrix = {(i, i): (0, EMPTY) for i in STATES}
    for _ in STATES:
        for (i, k), (cost, record) in list(out.items()):
            _better(out, (i, NEXT[k][WANTED[k][0]]), (cost + INSERT, record + LETTERS["I"]))
    return out


def of_symbol(symbol: str) -> Matrix:
    """One row, with insertions before it."""
    out: Matrix = {(i, i): (DELETE, LETTERS["D"]) for i in STATES}
    if symbol != GOES:
        stays = TRUNCATED if symbol.isupper() else 0
        for i in STATES:
            if symbol.lower() in NEXT[i]:
                _better(out, (i, NEXT[i][symbol.lower()]), (stays, LETTERS["K"]))
            _better(out, (i, NEXT[i][WANTED[i][0]]), (REROLE + stays, LETTERS["R"]))
    return product(inserted(), out)


class Grammar:
    """Rules (pairs of symbols, in order), and the matrix of every symbol."""

    def __init__(self, rules: Iterable[str] = ()) -> None:
        self.rules: list[tuple[str, str]] = []
        self.matrices = {s: of_symbol(s) for s in SYMBOLS}
        self.after = inserted()
        for pair in rules:
            self.add(pair)

    def add(self, pair: str) -> None:
        name = chr(BASE + len(self.rules))
        self.rules.append((pair, name))
        self.matrices[name] = product(self.matrices[pair[0]], self.matrices[pair[1]])

    def packed(self, symbols: str) -> str:
        for pair, name in self.rules:
            if pair in symbols:
                symbols = symbols.replace(pair, name)
        return symbols

    def solve(self, symbols: str) -> tuple[int, str]:
        """(cost, record) of the cheapest edits."""
        row: Matrix = {(START, START): (0, EMPTY)}
        for s in self.packed(symbols):
            row = product(row, self.matrices[s])
        last = product(row, self.after)
        out: Matrix = {}
        for end in ENDS:
            if (START, end) in last:
                _better(out, (START, START), last[START, end])
        return out[START, START][0], str(out[START, START][1])


def _pairs(grammar: Grammar) -> Callable[[Batches], Batches]:
    """(pair, n): pairs of neighbouring symbols in packed sequences, those of a run counted without overlap."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            found: Counter = Counter()
            for symbols in batch.column("symbols"):
                packed = grammar.packed(symbols.as_py())
                before = False
                for a, b in zip(packed, packed[1:]):  # noqa: B905
                    before = a == b and not (before and a == last)  # noqa: F821
                    last = a
                    if a != b or before:
                        found[a + b] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["pair", "n"])

    return run


def grammar_of(sequences: DataFrame, rules: int = RULES, rounds: int = ROUNDS, per_round: int = PER_ROUND) -> Grammar:
    """Rules for the sequences (symbols): each round counts all pairs and takes the most frequent ones that share no symbol's side, so that none overlaps another. Counts that come to the driver are those of pairs of symbols."""
    grammar = Grammar()
    for _ in range(rounds):
        counts = sequences.mapInArrow(_pairs(grammar), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        found = sorted(((r["n"], r["pair"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))
        total = sum(n for n, _ in found)
        chosen: list[str] = []
        firsts, seconds, gained = set(), set(), 0
        for n, pair in found:
            if len(chosen) < per_round and len(grammar.rules) + len(chosen) < rules and pair[0] not in seconds and pair[1] not in firsts:
                chosen.append(pair)
                firsts.add(pair[0])
                seconds.add(pair[1])
                gained += n
        if not chosen or gained < GAIN * total:
            break
        for pair in chosen:
            grammar.add(pair)
    return grammar


def damaged(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, copies) of every row, nulls read as one space: by the checksum of its place dropped (0 copies), emptied, without stops, twice, or said by the user."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat_ws(":", spaced(id_col), spaced(turn_col))) % WAYS
    text = F.when(way == EMPTIED, "").when(way == UNSTOPPED, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    return rows.select(
        F.col(id_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.when(way == REROLED, "user").otherwise(spaced(role_col)).alias("role"),
        text.alias("text"),
        F.when(way == DROPPED, 0).when(way == REPEATED, 2).otherwise(1).alias("copies"),
    )


def _keyed(rows: DataFrame) -> DataFrame:
    """With a 128-bit key of conversation, role and text, by which rows of one turn and role are ordered too."""
    whole = F.concat(F.col("conv").isNull().cast("string"), F.coalesce(F.col("conv").cast("string"), F.lit("")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("key", F.unhex(F.md5(whole)))


#: Nulls come first.
_ORDER = ["turn", "role", "key"]


def _marked(rows: DataFrame) -> DataFrame:
    """Rows without their texts: whether each is blank, truncated, or said before (at an earlier turn; those of the same turn stand together)."""
    light = rows.select("conv", "turn", "role", "copies", "key", (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    place = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    said = light.where("copies > 0").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    return lookup(light, checkpointed(said, small=True), ["key"], "n", how="left").withColumn("again", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")


def _sequences(kind: str) -> Callable[[Batches], Batches]:
    """(conv, gaps, blank, duplicate, truncated, illegal, symbols) of each conversation from its rows in order; of a conversation only its symbols are held."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "symbols"]

    def told(conv, rows: Iterable[tuple]) -> tuple:
        turns, first, last, turn_before = 0, None, None, None
        blank = duplicate = truncated = illegal = 0
        symbols, before, key_before = [], None, None
        for turn, role, copies, key, is_blank, is_truncated, again in rows:
            for _ in range(copies):
                if turn is not None:
                    turns += turn != turn_before
                    first = turn if first is None else first
                    last = turn_before = turn
                initial = role[:1]
                if before is not None:
                    illegal += before + initial not in ("su", "ua", "au")
                before = initial
                fault = "blank" if is_blank else "duplicate" if again or key == key_before else "truncated" if is_truncated else None
                key_before = key
                blank += fault == "blank"
                duplicate += fault == "duplicate"
                truncated += fault == "truncated"
                symbol = initial if initial in ("s", "u", "a") else OTHER
                symbols.append(GOES if fault in ("blank", "duplicate") else symbol.upper() if fault else symbol)
        return conv, 0 if first is None else last - first + 1 - turns, blank, duplicate, truncated, illegal, "".join(symbols)

    def run(batches: Batches) -> Batches:
        columns = ["turn", "role", "copies", "key", "blank", "truncated", "again"]
        rows = chain.from_iterable(zip(b.column("conv").to_pylist(), zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True) for b in batches)
        yield from _batched((told(conv, own) for conv, own in _runs(rows)), names, kind)

    return run


def _runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conversation, its rows as a stream) of rows (conversation, row) in order."""
    rest = next(rows, None)
    while rest is not None:
        conv, ended = rest[0], False

        def own():
            nonlocal rest, ended
            while rest is not None and rest[0] == conv:  # noqa: B023
                yield rest[1]
                rest = next(rows, None)
            ended = True

        stream = own()
        yield conv, stream
        for _ in stream:
            pass


def _batched(found: Iterator[tuple], names: list[str], kind: str) -> Batches:
    schema = _schema(names, kind)
    held: list[tuple] = []
    size = 0
    for row in found:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == ROWS or size > 1 << 22:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


_TEXTS = {"symbols", "audit", "repaired_sha256", "role", "text", "edit"}


def _schema(names: list[str], kind: str) -> pa.Schema:
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
    return pa.schema([(n, types[kind] if n == "conv" else pa.string() if n in _TEXTS else pa.int64()) for n in names])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _solved(grammar: Grammar) -> Callable[[Batches], Batches]:
    """cost and audit in place of symbols."""

    def run(batches: Batches) -> Batches:
        short = lru_cache(HELD)(grammar.solve)
        for batch in batches:
            found = [short(s) if len(s) <= HELD_SIZE else grammar.solve(s) for s in batch.column("symbols").to_pylist()]
            rest = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, rest), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], [*rest, "cost", "audit"])

    return run


def edited(audit: str, rows: Iterable[tuple]) -> Iterator[tuple]:
    """(edit, turn, role, text) of what stands after the edits, in order; rows are (turn, role, text, copies)."""
    letters, state = iter(audit), START
    each = ((turn, role, text) for turn, role, text, copies in rows for _ in range(copies))
    for letter in letters:
        turn, role, text = (None, None, "") if letter == "I" else next(each)
        if letter != "D":
            role = role if letter == "K" else WANTED[state]
            state = NEXT[state][role[0]]
            yield letter, turn, role, text


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _replayed(kind: str, whole: bool) -> Callable[[Batches], Batches]:
    """Of rows in order, a conversation's figures and audit before its own: the digest of what stands after the edits with the figures, or (whole) those rows themselves. No more than a row is held."""
    names = ["conv", "place", "edit", "turn", "role", "text"] if whole else ["conv", *FIGURES, "audit", "repaired_sha256"]

    def told(batches: Batches) -> Iterator[tuple]:
        columns = ["turn", "role", "text", "copies", "figures"]
        rows = chain.from_iterable(zip(b.column("conv").to_pylist(), zip(*(b.column(c).to_pylist() for c in columns), strict=True), strict=True) for b in batches)
        for conv, own in _runs(rows):
            *_, audit, _, figures = next(own)
            kept = edited(audit, (r[:4] for r in own))
            if whole:
                yield from ((conv, i, *row) for i, row in enumerate(kept))
                continue
            digest, between = hashlib.sha256(), b""
            for _, _, role, text in kept:
                digest.update(between + role.encode() + b":" + text.encode())
                between = b"\n"
            yield (conv, *(figures[c] for c in FIGURES), audit, digest.hexdigest())

    def run(batches: Batches) -> Batches:
        yield from _batched(told(batches), names, kind)

    return run


def repair(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Of rows (conv, turn, role, text, copies): (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, or (whole) what stands after the edits: (conv, place, edit, turn, role, text).

    Null conversations are one. Rows stand by turn, nulls first, then by role and a 128-bit key of
    their content, so that equal rows stand together. A conversation of which no row is left (0
    copies) has zeros and an empty audit; an empty table gives an empty result. Texts may be of any
    length and are moved once. A conversation's rows pass through one task in order, as a digest of
    them does, but only its symbols and its audit, a letter a row, are ever held.
    """
    small_batches(rows.sparkSession)
    rows = _keyed(rows.select("conv", F.col("turn").cast("long").alias("turn"), "role", "text", F.col("copies").cast("int").alias("copies")))
    kind = rows.schema["conv"].dataType.simpleString()
    lines = _marked(rows).repartition("conv").sortWithinPartitions("conv", *_ORDER)
    told = checkpointed(lines.mapInArrow(_sequences(kind), f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, symbols string"))
    grammar = grammar_of(told.select("symbols").distinct())
    solved = told.mapInArrow(_solved(grammar), f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
    heads = solved.select("conv", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("copies"), F.lit(None).cast("binary").alias("key"), F.struct(*FIGURES).alias("figures"))
    both = rows.where("copies > 0").withColumn("figures", F.lit(None).cast(heads.schema["figures"].dataType)).unionByName(heads)
    ordered = both.repartition("conv").sortWithinPartitions("conv", F.col("figures").isNull(), *_ORDER)
    out = f"conv {kind}, place long, edit string, turn long, role string, text string" if whole else f"conv {kind}, {', '.join(f'{c} long' for c in FIGURES)}, audit string, repaired_sha256 string"
    return ordered.select("conv", "turn", "role", "text", "copies", "figures").mapInArrow(_replayed(kind, whole), out)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations"))).withColumnRenamed("conv", "conv_id")


def _oracle() -> str:
    add = lambda s, cost, letter, line: f"case when {s} is null then null else {{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 't': {line.format(s=s)}}} end"
    line = lambda role, text: "list_append({s}.t, " + f"{role} || ':' || {text})"
    ins = {0: "'user'", 1: "'user'", 2: "'assistant'", 3: "'user'"}
    one = lambda s, i: add(s, 5, "I", line(ins[i], "''"))
    pair = lambda s: f"case when {s} is null then null else {{'c': {s}.c + 10, 'a': {s}.a || 'II', 't': list_append(list_append({s}.t, 'user:'), 'assistant:')}} end"
    closed = f"s0 as e0, s1 as e1, list_min([s2, {one('s0', 0)}, {one('s1', 1)}, {one('s3', 3)}]) as e2, list_min([s3, {one('s2', 2)}, {pair('s0')}, {pair('s1')}]) as e3"
    gone = lambda s: add(s, 2, "D", "{s}.t")
    stay = lambda s, i, role: f"case when not goes and initial = '{role}' then {add(s, 'more', 'K', line('role', 'text'))} end"
    turned = lambda s, i: f"case when not goes then {add(s, '(1 + more)', 'R', line(ins[i], 'text'))} end"
    steps = {
        "s0": gone("e0"),
        "s1": f"list_min([{gone('e1')}, {stay('e0', 0, 's')}])",
        "s2": "list_min([" + ", ".join([gone("e2"), *(f(f"e{i}", i, *r) for i in (0, 1, 3) for f, r in ((stay, "u"), (turned, "")))]) + "])",
        "s3": f"list_min([{gone('e3')}, {stay('e2', 2, 'a')}, {turned('e2', 2)}])",
    }
    state = "struct(c bigint, a varchar, t varchar[])"
    return rf"""
with recursive crc as (
  select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as tab from range(256) t(i)
), summed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: ascii(x)::bigint)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 as way
  from conversations, crc
), kept as (
  select conv_id, turn, case when way = 4 then 'user' else role end as role, case when way = 1 then '' when way = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from summed, range(2) t(copy) where way <> 0 and (copy = 0 or way = 3)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i, left(role, 1) as initial,
         not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') as cut
  from kept
), said as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again from placed
), lines as materialized (
  select *, blank or again as goes, case when not blank and not again and cut then 5 else 0 end as more, not blank and not again and cut as truncated,
         i > 1 and (lag(initial) over (partition by conv_id order by i) || initial) not in ('su', 'ua', 'au') as illegal
  from said
), figures as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, count(*) filter (truncated) as truncated, count(*) filter (illegal) as illegal from lines group by conv_id
), states(conv_id, i, s0, s1, s2, s3) as (
  select conv_id, 0::bigint, {{'c': 0, 'a': '', 't': cast([] as varchar[])}}::{state}, null::{state}, null::{state}, null::{state} from (select distinct conv_id from conversations)
  union all
  select conv_id, i, {", ".join(f"{e} as {s}" for s, e in steps.items())}
  from (select {closed}, l.* from states s join lines l on l.conv_id is not distinct from s.conv_id and l.i = s.i + 1)
), ends as (
  select conv_id, list_min([e0, e3]) as best from (select conv_id, {closed} from (select * from states qualify row_number() over (partition by conv_id order by i desc) = 1))
)
select e.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
       best.c as cost, best.a as audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) as repaired_sha256
from ends e left join figures f on f.conv_id is not distinct from e.conv_id
"""


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLE_SQL = {"op13_conversation_repair": _oracle()}
