"""Repair of conversation structure by error-correcting Earley parsing.

A weighted grammar says which roles may follow each other; its error productions delete a row, give it another role or insert an
empty one. Items of the chart keep their least (cost, audit), the audit being the letters of the edits so far, so the completed chart
yields the cheapest repair, of equal ones the one whose audit is least.

The grammar is left-linear: whatever goes before a row is summed up by one of four symbols that span all of it. So a
conversation of any length is parsed in stretches:

1. Rows are ordered by range partitioning over (conversation, turn, role, text) and numbered; equal rows are spread, as their order
   doesn't matter. ``STRETCH`` successive numbers are a stretch. A row is a duplicate unless it is the first of its role and text.
2. Each stretch gets a chart, from every symbol that may go before it; only letters and costs leave it.
3. Per conversation the charts' ends are joined in order. Audits of different ends never begin with one another, so their order
   is kept as a rank and nothing is compared twice.
4. The letters go back to their stretches, and rows are repaired in order, a stretch at a time.

So one conversation with a third of all rows is spread over tasks; what meets in one place is its letters, and, for ``digests`` only,
its texts as a stream through one hash. Null roles and texts are one space, null turns come first, rows with a null id are one
conversation. Rows of equal turn go by role, then by the first ``HEAD`` characters of their text, then by a hash of it. An empty table
has no conversations; other columns play no part.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirechart.llm import kernels as K
from wirechart.llm.shared import TEXTS, stored

#: Rows of a stretch as a power of two; characters of a text that order rows of one turn and role.
STRETCH, HEAD = 9, 200
#: What may go before a row, and the letter of each edit's kind.
STATES = ("begun", "opened", "asked", "answered")
ANY = "*"
#: Left side, right side, cost, letter of the audit: the role grammar (s?(ua)+)?, then its error productions.
PRODUCTIONS = (
    ("conversation", ("begun",), 0, ""),
    ("conversation", ("answered",), 0, ""),
    ("opened", ("begun", "system"), 0, ""),
    ("asked", ("begun", "user"), 0, ""),
    ("asked", ("opened", "user"), 0, ""),
    ("asked", ("answered", "user"), 0, ""),
    ("answered", ("asked", "assistant"), 0, ""),
    ("system", ("s",), 0, "K"),
    ("user", ("u",), 0, "K"),
    ("assistant", ("a",), 0, "K"),
    ("user", (ANY,), 1, "R"),
    ("assistant", (ANY,), 1, "R"),
    ("user", (), 5, "I"),
    ("assistant", (), 5, "I"),
    *((x, (x, ANY), 2, "D") for x in STATES),
)
#: What a truncated row costs unless it is deleted.
TRUNCATED = 5
#: Items whose first symbol spans all rows so far, by that symbol: (left side, awaited symbol, cost, letter).
_ITEMS = {x: [(left, right[1], cost, letter) for left, right, cost, letter in PRODUCTIONS if len(right) == 2 and right[0] == x] for x in STATES}
#: The same where the awaited symbol may be an empty row: (left side, cost, letters).
_EMPTY = {left: (cost, letter) for left, right, cost, letter in PRODUCTIONS if not right}
_INSERTS = {x: [(left, cost + _EMPTY[awaited][0], _EMPTY[awaited][1] + letter) for left, awaited, cost, letter in items if awaited in _EMPTY] for x, items in _ITEMS.items()}
_WHOLE = [(right[0], cost, letter) for left, right, cost, letter in PRODUCTIONS if left == "conversation"]


@functools.lru_cache(1024)
def _completed(initial: str, fault: str) -> dict[str, tuple[int, str]]:
    """The least (cost, letter) of each symbol that one row completes; faults: b(lank) and d(uplicate) rows must go, t(runcated) ones cost more if they stay."""
    out = {ANY: (0, "")}
    for left, right, cost, letter in PRODUCTIONS:
        if len(right) == 1 and right[0] in (initial, ANY) and fault not in ("b", "d"):
            value = (cost + TRUNCATED * (fault == "t"), letter)
            out[left] = min(value, out.get(left, value))
    return out


class Chart:
    """Earley's chart over rows (initial of the role, fault).

    Every column predicts the same symbols, so the items begun in it are the same too: what a row completes of them is found
    once for each kind of row. Only the items begun before the first row differ; their values are those of the symbols in
    ``spans``, which span all rows so far.
    """

    def __init__(self, seed: str = "begun"):
        self.ends: dict = {}  # symbols that span all rows so far, by a last edit that used up a row
        self._close({seed: (0, "")})

    def _close(self, values: dict) -> None:
        """Complete by insertions in a new column until no symbol gets a lesser value."""
        self.spans = dict(values)
        agenda = list(values)
        while agenda:
            symbol = agenda.pop()
            cost, audit = self.spans[symbol]
            for left, more, letters in _INSERTS[symbol]:
                value = (cost + more, audit + letters)
                if left not in self.spans or value < self.spans[left]:
                    self.spans[left] = value
                    agenda.append(left)

    def scan(self, initial: str, fault: str) -> None:
        """One more row."""
        row, ends = _completed(initial, fault), {}
        for symbol, (cost, audit) in self.spans.items():
            for left, awaited, more, letter in _ITEMS[symbol]:
                if awaited in row:
                    paid, edit = row[awaited]
                    value = (cost + more + paid, audit + edit + letter)
                    if left not in ends or value < ends[left]:
                        ends[left] = value
        self.ends = ends
        self._close(ends)

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest way to complete the conversation here."""
        return min((self.spans[x][0] + cost, self.spans[x][1] + letter) for x, cost, letter in _WHOLE if x in self.spans)


#: What completing a conversation costs that ends with each symbol.
_TAILS = {x: Chart(x).result() for x in STATES}


def repaired(state: str, audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, letter) of what an audit's letters leave of the rows (role, text), from a symbol on."""
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        wanted = "assistant" if state == "asked" else "user"
        yield (role if letter == "K" else wanted), text, letter
        state = "opened" if letter == "K" and state == "begun" and role[:1] == "s" else "answered" if state == "asked" else "asked"


_SPAN = "`from` int, `to` int, cost bigint, audit string"
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")
_LEGAL = {"su", "ua", "au"}


def _grouped(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[tuple, list]]:
    """Rows of successive equal values in the first columns, across batches."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and row[:columns] != key:
                yield key, held
                held = []
            key = row[:columns]
            held.append(row)
    if held:
        yield key, held


@K.frugal
def _charted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From (stretch, conv_id, number, initial, fault) in order: what each stretch has of a conversation, with its chart's ends."""
    out: list[tuple] = []
    before = None
    for (stretch, conv), rows in _grouped(batches, 2):
        spans = []
        for i, seed in enumerate(STATES if stretch != before else STATES[:1]):  # only a stretch's first conversation may have begun earlier
            chart = Chart(seed)
            for row in rows:
                chart.scan(row[3], row[4])
            spans += [{"from": i, "to": STATES.index(x), "cost": c, "audit": a} for x, (c, a) in chart.ends.items()]
        before, faults, initials = stretch, [r[4] for r in rows], [r[3] for r in rows]
        illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
        out.append((conv, stretch, initials[0], initials[-1], len(rows), *(faults.count(x) for x in "bdt"), illegal, spans))
        if len(out) >= 1000:
            yield _batch(out, schema)
            out = []
    yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


@K.frugal
def _joined(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From stretches in order per conversation: a row with the letters and first symbol of each, and one of the whole (stretch null)."""
    out: list[tuple] = []
    key, ends, counts, last, places = None, {}, [], "", []

    def finish():
        cost, _, state, tail = min((ends[x][0] + _TAILS[STATES[x]][0], ends[x][1], x, _TAILS[STATES[x]][1]) for x in ends)
        link, letters = ends[state][2], []
        while link:
            link, begun, audit = link
            letters.append((begun, audit))
        letters.reverse()
        letters[-1] = (letters[-1][0], letters[-1][1] + tail)
        for place, (begun, audit) in zip(places, letters):
            out.append((*key, place, begun, audit, None, *[None] * len(_COUNTS)))
        out.append((*key, None, None, "".join(x for _, x in letters), cost, *counts))

    for batch in batches:
        for conv, stretch, first, final, *own, spans in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (conv,):
                if key:
                    finish()
                    if len(out) >= 1000:
                        yield _batch(out, schema)
                        out.clear()
                key, ends, counts, places = (conv,), {0: (0, 0, None)}, [0] * len(_COUNTS), []
            elif last + first not in _LEGAL:
                counts[-1] += 1
            counts = [a + b for a, b in zip(counts, own)]
            best: dict = {}
            for x in spans:
                if x["from"] in ends:
                    cost, rank, link = ends[x["from"]]
                    way = (cost + x["cost"], rank, x["audit"], (link, x["from"], x["audit"]))
                    if x["to"] not in best or way[:3] < best[x["to"]][:3]:
                        best[x["to"]] = way
            order = {x: i for i, x in enumerate(sorted(best, key=lambda x: best[x][1:3]))}
            ends = {x: (way[0], order[x], way[3]) for x, way in best.items()}
            places.append(stretch)
            last = final
    if key:
        finish()
    yield _batch(out, schema)


@K.frugal
def _mended(batches: Iterator[pa.RecordBatch], schema: pa.Schema, digest: bool) -> Iterator[pa.RecordBatch]:
    """From a stretch's letters, then its rows, in order: repaired rows, or the hash of each conversation's ``role:text`` lines."""
    out: list[tuple] = []
    key, sha, lines = None, None, 0
    for (conv, stretch), rows in _grouped(batches, 2):
        if digest and key != (conv,):
            if key:
                out.append((*key, sha.hexdigest()))
            key, sha, lines = (conv,), hashlib.sha256(), 0
        (_, _, _, _, _, _, state, audit), *own = rows
        for place, (role, text, letter) in enumerate(repaired(STATES[state], audit, ((r[4], r[5]) for r in own))):
            if digest:
                sha.update((f"\n{role}:{text}" if lines else f"{role}:{text}").encode())
                lines += 1
            else:
                out.append((conv, stretch, place, role, text, letter))
        if len(out) >= 1000:
            yield _batch(out, schema)
            out = []
    if key:
        out.append((*key, sha.hexdigest()))
    yield _batch(out, schema)


def _ends_with(column: str, characters: str) -> Column:
    return functools.reduce(Column.__or__, (F.col(column).endswith(x) for x in characters))


class Repair:
    """The repair of conversations(conv_id, turn, role, text): ``summaries``, ``turns`` and ``digests`` of it."""

    def __init__(self, rows: DataFrame):
        self.kind = dict(rows.dtypes)["conv_id"]
        text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
        rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.monotonically_increasing_id() % 1024).alias("salt"))
        order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.substring("text", 1, HEAD), F.xxhash64("text")]
        rows = rows.repartitionByRange(*order, "salt").sortWithinPartitions(*order)
        same = F.md5(F.concat_ws(":", F.length("role"), "role", "text"))
        # most texts end with a letter or mark, which decides; only where white space ends one it is searched
        spaced = (F.col("text") == "") | _ends_with("text", " \t\n\v\f\r")
        blank = spaced & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
        ended = F.when(spaced, F.col("text").rlike("[.!?][\\x20\\x09-\\x0D]*\\z")).otherwise(_ends_with("text", ".!?"))
        # what the charts need of a text is found here, where it is at hand, so that they needn't read it
        facts = [same.alias("same"), F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), ended.alias("ended")]
        self.rows = stored(rows.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("number"), *facts), "turns", TEXTS)
        self.rows = self.rows.withColumn("stretch", F.shiftright("number", STRETCH))
        self.parsed = stored(self._parsed(), "repairs")

    def _arrow(self, ddl: str) -> tuple[str, pa.Schema]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        ddl = f"conv_id {self.kind}, {ddl}"
        return ddl, to_arrow_schema(StructType.fromDDL(ddl))

    def _facts(self) -> DataFrame:
        """Per row stretch, conv_id, number, initial and fault, dealt by stretch."""
        firsts = self.rows.groupBy("conv_id", "same").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("first"))
        facts = self.rows.select("stretch", "conv_id", "number", "initial", "blank", "ended").join(firsts, "number", "left")
        fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("ended"), "").otherwise("t")
        return facts.select("stretch", "conv_id", "number", "initial", fault.alias("fault")).repartition("stretch")

    def _parsed(self) -> DataFrame:
        facts = self._facts().sortWithinPartitions("stretch", "number")
        ddl, schema = self._arrow("stretch bigint, first string, last string, " + ", ".join(f"`{c}` bigint" for c in _COUNTS) + f", spans array<struct<{_SPAN.replace(' int', ': int').replace(' bigint', ': bigint').replace(' string', ': string')}>>")
        charts = facts.mapInArrow(lambda it: _charted(it, schema), ddl)
        whole, form = self._arrow("stretch bigint, state int, audit string, cost bigint, " + ", ".join(f"`{c}` bigint" for c in _COUNTS))
        return charts.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(lambda it: _joined(it, form), whole)

    def _merged(self, by: str) -> DataFrame:
        letters = self.parsed.where("stretch is not null").selectExpr("conv_id", "stretch", "0 as kind", "cast(null as bigint) as number", "cast(null as string) as role", "cast(null as string) as text", "state", "audit")
        rows = self.rows.selectExpr("conv_id", "stretch", "1 as kind", "number", "role", "text", "cast(null as int) as state", "cast(null as string) as audit")
        return letters.unionByName(rows).repartition(by).sortWithinPartitions("conv_id", "stretch", "kind", "number")

    def summaries(self) -> DataFrame:
        """Per conversation: conv_id, rows n, faults blank, duplicate, truncated and illegal (pairs of roles), cost and audit of its repair."""
        return self.parsed.where("stretch is null").select("conv_id", *_COUNTS, "cost", "audit")

    def turns(self) -> DataFrame:
        """The repaired rows: conv_id, role, text, letter of the edit; ``stretch`` and ``place`` are their order."""
        ddl, schema = self._arrow("stretch bigint, place int, role string, text string, letter string")
        return self._merged("stretch").mapInArrow(lambda it: _mended(it, schema, False), ddl)

    def digests(self) -> DataFrame:
        """Per conversation the SHA-256 of its repaired ``role:text`` lines; each conversation's texts pass through one task as a stream."""
        ddl, schema = self._arrow("repaired_sha256 string")
        return self._merged("conv_id").mapInArrow(lambda it: _mended(it, schema, True), ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults by the checksum of conversation and turn; nulls of role and text are one space."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.where("fault <> 0").withColumns({"text": text, "role": F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))).select("conv_id", "turn", "role", "text")


def gaps(rows: DataFrame) -> DataFrame:
    """Per conversation, how many turns between its least and greatest are missing."""
    found = rows.groupBy("conv_id").agg(F.max("turn").alias("most"), F.min("turn").alias("least"), F.count_distinct("turn").alias("n"))
    return found.select("conv_id", F.coalesce((F.col("most") - F.col("least") + 1 - F.col("n")).cast("bigint"), F.lit(0)).alias("gaps"))
