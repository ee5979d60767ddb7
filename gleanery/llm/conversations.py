"""Repair of conversation structure by least edits.

A conversation is legal if the initials of its roles read (s?(ua)+)?. Rows are kept, given another role or deleted, and empty turns
inserted, at least cost; of equally cheap repairs the one whose edits read least in ASCII wins. Hash-partitioned batches of whole
conversations each run one recursive DuckDB query: a recursion advances one turn in all conversations of the batch at once and keeps, for
each state of the grammar, the minimum cost and its audit.

Why the least audit of each state is enough: two audits of the same rows, the same state and the same cost are never one the prefix of
the other, as the longer one would end in insertions that the other has not paid for; so what follows can't change their order.

A conversation of more than `longest` rows is never met by one task as a whole before its digest: its rows are sorted by range into
partitions of any length, cut into blocks, solved from every state that a block may start in, and the blocks' results are folded in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import maybe_broadcast, small_batches, written

#: Costs of the edits, of a truncated row that stays, and the grammar (state, initial) -> state; it may end in 0 and 3.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS, STATES = (0, 3), range(4)
SPACE = r"\x20\x09-\x0D"

#: Rows of a conversation that one batch takes whole, and of a block of a longer one.
LONGEST = 512
#: Bytes of rows in a batch, but for the end of its last conversation.
BATCH_BYTES = 16 << 20

COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def inserted(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, edits) after no, one and two insertions; more are never cheapest, as a state is met again by then."""
    out = [(state, 0, "")]
    for _ in range(2):
        out += [(GRAMMAR[s, r], c + INSERT, e + "I") for s, c, e in out[-2:] for r in "ua" if (s, r) in GRAMMAR]
    return out


def steps(initial: str, kind: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> the least (cost, edits) by which a row of this initial passes: `gone` must be deleted, `cut` costs more."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    more = TRUNCATED if kind == "cut" else 0
    for before in STATES:
        for s, c, e in inserted(before):
            ways = [(s, DELETE, "D")]
            if kind != "gone":
                ways += [(GRAMMAR[s, initial], KEEP + more, "K")] if (s, initial) in GRAMMAR else []
                ways += [(GRAMMAR[s, r], REROLE + more, "R") for r in "ua" if (s, r) in GRAMMAR]
            for after, cost, edit in ways:
                best[before, after] = min(best.get((before, after), (1 << 30, "")), (c + cost, e + edit))
    return best


def closing() -> dict[int, tuple[int, str]]:
    """State -> the least (cost, edits) by which it may end."""
    return {s: min((c, e) for t, c, e in inserted(s) if t in ENDS) for s in STATES}


#: All steps as rows (initial, kind, before, after, cost, edits); `-` stands for every other initial.
STEPS = [(i, k, a, b, c, e) for i in "sua-" for k in ("fine", "cut", "gone") for (a, b), (c, e) in sorted(steps(i, k).items())]
STEP_VALUES = ", ".join(f"('{i}','{k}',{a},{b},{c},'{e}')" for i, k, a, b, c, e in STEPS)

#: Over `own` (block, first, spot from 1, initial, kind): the least cost and audit from each state at a block's start to each at its end.
#: The first block of a conversation starts in state 0 alone.
RECURSION = f"""
WITH RECURSIVE steps(initial, kind, before, after, cost, edits) AS (VALUES {STEP_VALUES}),
best(block, start, spot, state, cost, audit) AS (
  SELECT block, s, 0, s, 0::BIGINT, '' FROM (SELECT block, first FROM own WHERE spot = 1), range(4) starts(s) WHERE s = 0 OR NOT first
  UNION ALL
  SELECT b.block, b.start, r.spot, t.after, min(b.cost + t.cost), arg_min(b.audit || t.edits, (b.cost + t.cost, b.audit || t.edits))
  FROM best b JOIN own r ON r.block = b.block AND r.spot = b.spot + 1 JOIN steps t ON t.initial = r.initial AND t.kind = r.kind AND t.before = b.state
  GROUP BY b.block, b.start, r.spot, t.after
)
SELECT block, start, state, cost, audit FROM best JOIN (SELECT block, max(spot)::BIGINT AS spot FROM own GROUP BY block) USING (block, spot)
"""

#: What else is known of a block, in a form that can be added up: counts, and what stands at its ends.
SUMMARY = """
SELECT block, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (spot > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(DISTINCT turn) AS turns, min(turn) AS low, max(turn) AS high,
  arg_min(ini, spot) AS head, arg_max(ini, spot) AS tail
FROM (SELECT *, lag(ini, 1, '') OVER (PARTITION BY block ORDER BY spot) || ini AS pair FROM own) GROUP BY block
"""


class Fold:
    """Joins the results of a conversation's blocks, given in order."""

    def __init__(self) -> None:
        self.ends: dict[int, tuple[int, str]] = {0: (0, "")}
        self.n = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": 0}
        self.low = self.high = self.tail = None

    def add(self, ends: Iterable[tuple[int, int, int, str]], about: dict) -> None:
        found: dict[int, tuple[int, str]] = {}
        for start, state, cost, audit in ends:
            if start in self.ends:
                way = (self.ends[start][0] + cost, self.ends[start][1] + audit)
                found[state] = min(found.get(state, way), way)
        self.ends = found
        for k in self.n:
            self.n[k] += about[k]
        if self.tail is not None:
            self.n["illegal"] += self.tail + about["head"] not in ("su", "ua", "au")
        self.tail = about["tail"]
        if about["low"] is not None:
            self.n["turns"] -= self.high == about["low"]
            self.low, self.high = about["low"] if self.low is None else self.low, about["high"]

    def result(self) -> tuple:
        """The values of COUNTS."""
        cost, audit = min((c + more, a + e) for s, (c, a) in self.ends.items() for more, e in [closing()[s]])
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.n["turns"], 2**63 - 1)
        return (gaps, self.n["blank"], self.n["duplicate"], self.n["truncated"], self.n["illegal"], cost, audit)


def turns_of(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit makes of the rows (role, text) of a conversation, deleted ones included."""
    edits, n, system = iter(audit), 0, 0

    def due() -> str:
        return ("user", "assistant")[(n - system) % 2]

    for role, text in rows:
        while (edit := next(edits)) == "I":
            yield edit, due(), ""
            n += 1
        if edit == "K" and n == 0:
            system = int(role[:1] == "s")
        yield edit, due() if edit == "R" else role, text
        n += edit != "D"
    for edit in edits:
        yield edit, due(), ""
        n += 1


class Digest:
    """sha256 of the turns `role:text` that stay, joined by newlines, taken one by one."""

    def __init__(self) -> None:
        self.sum, self.any = hashlib.sha256(), False

    def add(self, edit: str, role: str, text: str) -> None:
        if edit != "D":
            self.sum.update(f"{chr(10) * self.any}{role}:{text}".encode())
            self.any = True


def solved(rows: pa.Table) -> dict[int, tuple[list, dict]]:
    """Block -> (ends, about) by the recursive query; `rows` has the columns block, first, spot, turn, ini, initial, kind, fault."""
    con = duckdb.connect(config={"threads": "1", "memory_limit": "512MB"})
    try:
        con.register("given", rows)
        con.execute("CREATE TEMP TABLE own AS SELECT * FROM given")
        found: dict[int, tuple[list, dict]] = {r["block"]: ([], r) for r in con.sql(SUMMARY).to_arrow_table().to_pylist()}
        for block, *way in con.execute(RECURSION).fetchall():
            found[block][0].append(tuple(way))
        return found
    finally:
        con.close()


def damaged(df: DataFrame) -> DataFrame:
    """Damages the rows (conv_id, turn, role, text) by a checksum of conversation and turn: a twentieth each is dropped, emptied, robbed of
    its closing marks, repeated beside itself, or made the user's. Nulls of role and text become one space. Of a dropped row a row with `gone` stays, so that
    its conversation is known."""
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), as_text("role").alias("role"), as_text("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", (F.col("code") == 0).alias("gone"), F.expr("CASE WHEN code <> 0 THEN turn END").alias("turn"),
        F.expr("CASE code WHEN 0 THEN '' WHEN 4 THEN 'user' ELSE role END").alias("role"),
        F.expr("CASE code WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END").alias("text"),
        F.explode(F.expr("CASE code WHEN 3 THEN array(1, 2) ELSE array(1) END")).alias("copy")).drop("copy")


def _plain(df: DataFrame) -> DataFrame:
    """Rows as the repair takes them; a column `gone` marks rows that only name their conversation."""
    gone = F.col("gone") if "gone" in df.columns else F.lit(False)
    return df.select("conv_id", gone.alias("gone"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def _judged(df: DataFrame, seen: Column) -> DataFrame:
    """Adds each row's first fault, and its initial and kind for the steps."""
    fault = (F.when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(seen, "duplicate")
             .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated").otherwise("none"))
    return df.withColumn("fault", fault).withColumn("ini", F.substring("role", 1, 1)).withColumns({
        "initial": F.expr("CASE WHEN ini IN ('s', 'u', 'a') THEN ini ELSE '-' END"),
        "kind": F.expr("CASE WHEN fault IN ('blank', 'duplicate') THEN 'gone' WHEN fault = 'truncated' THEN 'cut' ELSE 'fine' END")})


LIGHT = ["turn", "ini", "initial", "kind", "fault"]


def _batches(rows: list[tuple], columns: list[tuple[str, str]], kind: pa.DataType) -> list[pa.RecordBatch]:
    """Rows as record batches; `kind` is the type of conv_id."""
    schema = pa.schema([(n, kind if n == "conv_id" else pa.int64() if t == "long" else pa.string()) for n, t in columns])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema).to_batches()


def _whole(with_turns: bool, columns: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that repairs a stretch of conversations, sorted, each of which starts at place 1."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            starts = [i for i, p in enumerate(batch.column("place").to_pylist()) if p == 1]
            if starts and sum(b.nbytes for b in held) + batch.nbytes >= BATCH_BYTES:
                yield pa.Table.from_batches([*held, batch.slice(0, starts[-1])])
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            ids, places, gone, roles, texts = (t.column(c).to_pylist() for c in ("conv_id", "place", "gone", "role", "text"))
            blocks, k = [], -1
            for p in places:
                k += p == 1
                blocks.append(k)
            own = t.select(LIGHT).append_column("block", pa.array(blocks, pa.int64())).append_column("spot", t.column("place").cast(pa.int64())).append_column("first", pa.array([True] * len(blocks)))
            found = solved(own.filter(pa.array([not g for g in gone])))
            out, i = [], 0
            while i < len(blocks):
                j = i + 1
                while j < len(blocks) and blocks[j] == blocks[i]:
                    j += 1
                fold, digest = Fold(), Digest()
                if blocks[i] in found:
                    fold.add(*found[blocks[i]])
                result = fold.result()
                for n, turn in enumerate(turns_of(result[-1], ((roles[x], texts[x]) for x in range(i, j) if not gone[x]))):
                    digest.add(*turn)
                    if with_turns:
                        out.append((ids[i], n, *turn))
                if not with_turns:
                    out.append((ids[i], *result, digest.sum.hexdigest()))
                i = j
            yield from _batches(out, columns, t.schema.field("conv_id").type)

    return repair


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solves blocks of long conversations: rows (conv_id, block, first, spot, ...) sorted by block and spot; one row of results per block."""
    held: list[pa.RecordBatch] = []
    keys_of = lambda t: list(zip(t.column("conv_id").to_pylist(), t.column("block").to_pylist(), strict=True))

    def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = keys_of(t)
        heads = [i for i, k in enumerate(keys) if not i or k != keys[i - 1]]
        sizes = [j - i for i, j in zip(heads, [*heads[1:], len(keys)], strict=True)]
        own = t.select([*LIGHT, "first"]).append_column("block", pa.array([b for b, n in enumerate(sizes) for _ in range(n)], pa.int64()))
        found = solved(own.append_column("spot", pa.array([i + 1 for n in sizes for i in range(n)], pa.int64())))
        rows = {"conv_id": t.column("conv_id").take(pa.array(heads)), "spot": t.column("spot").take(pa.array(heads)),
                "ends": pa.array([[dict(zip(("start", "state", "cost", "audit"), e, strict=True)) for e in found[b][0]] for b in range(len(heads))], ENDS_TYPE),
                "about": pa.array([{k: found[b][1][k] for k in ABOUT} for b in range(len(heads))], ABOUT_TYPE)}
        yield from pa.table(rows).to_batches()

    for batch in batches:
        held.append(batch)
        t = pa.Table.from_batches(held)
        if t.nbytes >= BATCH_BYTES:
            keys = keys_of(t)
            cut = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)
            if cut:
                yield from done(t.slice(0, cut))
                held = t.slice(cut).to_batches()
    if held and (t := pa.Table.from_batches(held)).num_rows:
        yield from done(t)


ABOUT = {"blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "turns": "long", "low": "long", "high": "long", "head": "string", "tail": "string"}
ABOUT_TYPE = pa.struct([(k, pa.int64() if v == "long" else pa.string()) for k, v in ABOUT.items()])
ENDS_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("state", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))
BLOCK_SCHEMA = ("spot long, ends array<struct<start:long,state:long,cost:long,audit:string>>, about struct<" + ",".join(f"{k}:{v}" for k, v in ABOUT.items()) + ">")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds blocks, sorted by conversation and place, into one row per conversation."""
    run: int | None = None
    fold, who = Fold(), None

    def row(schema: pa.Schema) -> pa.RecordBatch:
        values = [[who], *[[x] for x in fold.result()]]
        names = ["conv_id", *[c.split(" ")[0] for c in COUNTS.split(", ")]]
        return pa.record_batch([pa.array(v, schema.field("conv_id").type if n == "conv_id" else pa.string() if n == "audit" else pa.int64()) for n, v in zip(names, values, strict=True)], names=names)

    schema = None
    for batch in batches:
        schema = batch.schema
        for r in batch.to_pylist():
            if run is not None and r["conv_id"] != who:
                yield row(schema)
                fold = Fold()
            run, who = 1, r["conv_id"]
            fold.add([(e["start"], e["state"], e["cost"], e["audit"]) for e in r["ends"]], r["about"])
    if run is not None:
        yield row(schema)


def _told(with_turns: bool, columns: list[tuple[str, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that takes, in order, a row with each long conversation's audit (place -1) and its rows, and gives its turns or their digest."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.null()

        def rows_of() -> Iterator[dict]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv_id").type
                yield from batch.select(["conv_id", "place", "role", "text"]).to_pylist()

        rows, out = rows_of(), []
        ahead = next(rows, None)

        def own() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while (ahead := next(rows, None)) is not None and ahead["place"] >= 0:
                yield ahead["role"], ahead["text"]

        while ahead is not None:
            head, digest = ahead, Digest()
            for n, turn in enumerate(turns_of(head["text"], own())):
                digest.add(*turn)
                if with_turns:
                    out.append((head["conv_id"], n, *turn))
                    if len(out) >= 4096:
                        yield from _batches(out, columns, kind)
                        out = []
            if not with_turns:
                out.append((head["conv_id"], digest.sum.hexdigest()))
        if out:
            yield from _batches(out, columns, kind)

    return tell


def _solve(df: DataFrame, with_turns: bool, longest: int) -> DataFrame:
    spark = df.sparkSession
    small_batches(spark)
    name = df.schema["conv_id"].dataType.simpleString()
    turn_columns = [("conv_id", name), ("place", "long"), ("edit", "string"), ("role", "string"), ("text", "string")]
    count_columns = [("conv_id", name), *[tuple(c.split(" ")) for c in COUNTS.split(", ")], ("repaired_sha256", "string")]
    columns = turn_columns if with_turns else count_columns
    ddl = ", ".join(f"{n} {t}" for n, t in columns)
    rows = _plain(df)

    # texts are not read for this
    long_ids = written(rows.where("NOT gone").groupBy("conv_id").count().where(F.col("count") > longest).select(F.col("conv_id").alias("id"), F.lit(True).alias("is_long")), "long-conversations")
    n_long = long_ids.count()
    if n_long:
        rows = rows.join(maybe_broadcast(long_ids, n_long), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
        long_rows, rows = rows.where("is_long").drop("is_long"), rows.where("is_long IS NULL").drop("is_long")

    # one exchange by conversation serves both windows and the batches
    near = rows.repartition("conv_id").withColumn("copy", F.expr("row_number() OVER (PARTITION BY conv_id, gone, role, text ORDER BY turn)"))
    near = _judged(near, F.col("copy") > 1).withColumn("place", F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY gone, turn, role, text, copy)"))
    near = near.select("conv_id", "place", "gone", *LIGHT, "role", "text")
    out = near.mapInArrow(_whole(with_turns, columns), ddl)
    if not n_long:
        return out

    keys = ["conv_id", "turn", "role", "text", "copy"]
    ordered = (long_rows.where("NOT gone").withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
               .drop("copy").withColumn("place", F.monotonically_increasing_id()).withColumn("same", F.sha2(F.concat_ws("\0", "role", "text"), 256)))
    ordered = written(ordered, "long-turns")
    firsts = ordered.groupBy("conv_id", "same").agg(F.min("place").alias("earliest")).withColumnsRenamed({"conv_id": "id", "same": "as"})
    light = _judged(ordered.join(firsts, F.col("conv_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("as"))), F.col("place") > F.col("earliest"))
    heads = ordered.groupBy("conv_id").agg(F.min("place").alias("head")).withColumnRenamed("conv_id", "id")
    block = lambda place: F.expr(f"{place} div {longest}")
    light = light.drop("id").join(maybe_broadcast(heads, n_long), F.col("conv_id").eqNullSafe(F.col("id"))).select(
        "conv_id", block("place").alias("block"), (block("place") == block("head")).alias("first"), F.col("place").alias("spot"), *LIGHT)
    solved_blocks = light.repartition("block").sortWithinPartitions("block", "spot").mapInArrow(_blocks, f"conv_id {name}, {BLOCK_SCHEMA}")
    audits = solved_blocks.repartition("conv_id").sortWithinPartitions("conv_id", "spot").mapInArrow(_folded, f"conv_id {name}, {COUNTS}")
    audits = written(audits, "long-audits")
    stream = ordered.select("conv_id", "place", "role", "text").unionByName(audits.select("conv_id", F.lit(-1).cast("long").alias("place"), F.lit("").alias("role"), F.col("audit").alias("text")))
    own = turn_columns if with_turns else [("conv_id", name), ("repaired_sha256", "string")]
    told = stream.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_told(with_turns, own), ", ".join(f"{n} {t}" for n, t in own))
    if not with_turns:
        told = told.withColumnRenamed("conv_id", "id").join(audits, F.col("conv_id").eqNullSafe(F.col("id"))).select(*[n for n, _ in columns])
    return out.unionByName(told)


def repair(df: DataFrame, longest: int = LONGEST) -> DataFrame:
    """One row per conversation of `df` (conv_id, turn, role, text; further columns are ignored, `gone` marks rows that only name their
    conversation): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows are taken by turn, nulls first, then role and text. Null roles and texts are one space; a null conv_id is a conversation of its own; rows equal
    in all of it are duplicates after the first. A role that starts with none of s, u, a (empty ones included) can't be kept. A conversation without rows but `gone` ones
    has zeros, an empty audit and the digest of nothing; an empty table gives an empty table. `longest` changes the plan, not the result.
    """
    return _solve(df, False, longest)


def repaired_turns(df: DataFrame, longest: int = LONGEST) -> DataFrame:
    """The turns that `repair` makes, deleted ones included: conv_id, place (from 0), edit (one of K, R, D, I), role, text."""
    return _solve(df, True, longest)


#: The checksum of an ASCII text `k` in DuckDB's SQL, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda x, y: list_reduce(list_prepend(xor(x, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, n: xor(v >> 1, 3988292384 * (v & 1)))))"""

#: The query in DuckDB's SQL, over whole conversations.
ORACLE_SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations
), coded AS (SELECT *, {_CRC} % 20 AS code FROM given),
hurt AS (
  SELECT conv_id, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM coded, range(2) copies(n) WHERE code <> 0 AND (n = 0 OR code = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS spot FROM hurt
), own AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^{SPACE}]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY spot) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][{SPACE}]*$') THEN 'truncated' ELSE 'none' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY spot) || left(role, 1) AS pair
  FROM placed
), states AS (SELECT * FROM (VALUES ('', 's', 's'), ('', 'u', 'u'), ('s', 'u', 'u'), ('u', 'a', 'a'), ('a', 'u', 'u')) x(before, ini, after)),
held AS (
  SELECT before AS state, after, 5 AS cost, 'I' AS edits FROM states WHERE ini <> 's'
  UNION ALL SELECT s, s, 0, '' FROM (VALUES (''), ('s'), ('u'), ('a')) x(s)
  UNION ALL SELECT a.before, b.after, 10, 'II' FROM states a JOIN states b ON a.after = b.before WHERE a.ini <> 's' AND b.ini <> 's'
), ways AS (
  SELECT o.conv_id, o.spot, h.state AS before, coalesce(s.after, h.after) AS after, h.edits || e.edit AS edits,
    h.cost + e.cost + CASE WHEN e.edit <> 'D' AND o.fault = 'truncated' THEN 5 ELSE 0 END AS cost
  FROM own o CROSS JOIN held h CROSS JOIN (VALUES ('K', 0), ('R', 1), ('D', 2)) e(edit, cost)
  LEFT JOIN states s ON s.before = h.after AND e.edit <> 'D' AND (s.ini = o.ini OR (e.edit = 'R' AND s.ini <> 's'))
  WHERE e.edit = 'D' OR (s.after IS NOT NULL AND o.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR s.ini = o.ini))
), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS spot, '' AS state, 0::BIGINT AS cost, '' AS audit FROM own
  UNION ALL
  SELECT b.conv_id, w.spot, w.after, min(b.cost + w.cost), arg_min(b.audit || w.edits, (b.cost + w.cost, b.audit || w.edits))
  FROM best b JOIN ways w ON w.conv_id IS NOT DISTINCT FROM b.conv_id AND w.spot = b.spot + 1 AND w.before = b.state GROUP BY b.conv_id, w.spot, w.after
), ended AS (
  SELECT conv_id, min(b.cost + h.cost) AS cost, arg_min(b.audit || h.edits, (b.cost + h.cost, b.audit || h.edits)) AS audit
  FROM best b JOIN (SELECT conv_id, max(spot) AS spot FROM own GROUP BY 1) USING (conv_id, spot) JOIN held h ON h.state = b.state AND h.after IN ('', 'a') GROUP BY conv_id
), pieces AS (
  SELECT conv_id, n AS spot, cut[n] AS edits FROM (SELECT conv_id, regexp_extract_all(audit, 'I*[KRD]|I+$') AS cut FROM ended), LATERAL (SELECT unnest(range(1, len(cut) + 1)) AS n)
), letters AS (
  SELECT conv_id, p.spot, i, substr(edits, i, 1) AS edit, role, text FROM pieces p LEFT JOIN own USING (conv_id, spot), LATERAL (SELECT unnest(range(1, len(edits) + 1)) AS i)
), turns AS (
  SELECT *, row_number() OVER w AS n, max(edit = 'K' AND left(role, 1) = 's') OVER (PARTITION BY conv_id) AS system FROM letters WHERE edit <> 'D' WINDOW w AS (PARTITION BY conv_id ORDER BY spot, i)
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (n + system::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY n)) AS sha FROM turns GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM own GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""
