"""Operator 13, conversation structure repair: the cheapest edits that give legal roles, by a rank-compressed dynamic programme.

A layer of the programme stands behind each row and has four states: nothing yet, behind ``s``, behind ``u``, behind ``a``. A row is
passed by a macro edit, a run of insertions and then one edit of the row. Its code is ``I..I`` and the edit's initial; no code
begins another (the last letter alone is no ``I``), so audits of as many rows compare as their codes do, one by one. A layer
keeps no audit: it has each state's cost, the rank of its audit among the layer's, and a pointer to the state before. Ranks of
the next layer come from (rank before, code). Audits are put together once, backwards from the cheapest end.

Rows go through two sorted streams, the first without texts (edits), the second with them (repaired turns). A task holds one
pointer a row; an audit, like the digest of a repaired conversation, is one value of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.base import written

#: States of a layer, by the initial of the last role (fixed order); an audit may end in START or ASSISTANT.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What may follow a state, and the state that it leads to.
FOLLOWS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What edits cost, and an undeleted truncated row beside them.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
#: Insertions in a row: more of them would come back to a state that the run has passed.
RUN = 2
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"

Layer = tuple[tuple[int | None, ...], tuple[int, ...]]
FIRST: Layer = ((0, None, None, None), (0, 0, 0, 0))


def expected(state: int) -> str:
    """The one role that insertions and new roles can give behind a state."""
    return ROLES[next(role for role in FOLLOWS[state] if role in ROLES)]


def _runs(state: int) -> Iterator[tuple[int, int]]:
    """How many insertions, and the state that they lead to."""
    yield 0, state
    for n in range(1, RUN + 1):
        state = FOLLOWS[state][expected(state)[0]]
        yield n, state


@lru_cache(1 << 16)
def step(layer: Layer, initial: str, fault: str) -> tuple[Layer, int, tuple]:
    """The layer behind a row of that role's initial and fault; what its costs have been lowered by; each state's pointer (state, code)."""
    costs, ranks = layer
    best: dict[int, tuple] = {}
    for state, cost in enumerate(costs):
        if cost is None:
            continue
        for n, at in _runs(state):
            edits = [("D", at)]
            if fault not in ("blank", "duplicate"):
                if initial in FOLLOWS[at]:
                    edits.append(("K", FOLLOWS[at][initial]))
                edits.append(("R", FOLLOWS[at][expected(at)[0]]))
            for edit, to in edits:
                paid = cost + n * COSTS["I"] + COSTS[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
                found = (paid, ranks[state], "I" * n + edit, state)
                best[to] = min(best.get(to, found), found)
    low = min(found[0] for found in best.values())
    order = {key: i for i, key in enumerate(sorted({(rank, code) for _, rank, code, _ in best.values()}))}
    costs = tuple(best[s][0] - low if s in best else None for s in range(4))
    ranks = tuple(order[best[s][1:3]] if s in best else 0 for s in range(4))
    return (costs, ranks), low, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


class Audit:
    """The programme over one conversation: rows one by one, then the cost and the audit."""

    def __init__(self):
        self.layer, self.lowered, self.pointers = FIRST, 0, []

    def row(self, initial: str, fault: str) -> None:
        self.layer, low, pointer = step(self.layer, initial, fault)
        self.lowered += low
        self.pointers.append(pointer)

    def end(self) -> tuple[int, str]:
        costs, ranks = self.layer
        ends = [(c + n * COSTS["I"], ranks[s], "I" * n, s) for s, c in enumerate(costs) if c is not None for n, at in _runs(s) if at in (START, ASSISTANT)]
        cost, _, last, state = min(ends)
        codes = [last]
        for pointer in reversed(self.pointers):
            state, code = pointer[state]
            codes.append(code)
        return cost + self.lowered, "".join(reversed(codes))


def key_of(column: str) -> Column:
    """A number as text, a null as one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(turns: DataFrame) -> DataFrame:
    """conv (conv_id as text, null: one space), turn, role, text of all rows after the damage that crc32(conv:turn) % 20 picks.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 gives it the role user; other rows stay.
    Null roles and texts become one space.
    """
    rows = turns.select(key_of("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), F.concat_ws(":", key_of("conv_id"), key_of("turn")).alias("_key"), key_of("role").alias("role"), key_of("text").alias("text"))
    kind = F.crc32("_key") % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return rows.select("conv", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def _light(rows: DataFrame) -> DataFrame:
    """Rows without texts: conv, turn, role, digest, n (equal rows), blank, truncated, again (equal role and text seen at an earlier turn).

    Equal rows are counted before they meet. Only what stands at several turns of a conversation is joined back.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    rows = rows.select("conv", "turn", "role", F.md5("text").alias("digest"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    rows = rows.groupBy("conv", "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.groupBy("conv", "role", "digest").agg(F.min(when).alias("first"), F.count("*").alias("turns")).where("turns > 1").drop("turns")
    return rows.join(firsts, ["conv", "role", "digest"], "left").withColumn("again", F.coalesce(F.col("first") < when, F.lit(False))).drop("first")


#: Turns that a task hands on at once, and their bytes.
OUT_ROWS, OUT_BYTES = 4096, 4 << 20
_EDITS = {"conv": "string", "gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string"}
_LEGAL_PAIRS = {"su", "ua", "au"}


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple]]]:
    """The rows of each conversation (the first column) as they come; none is held."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda row: row[0])


def _arrow(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, k in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))


def _out(rows: Iterator[tuple], columns: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """The rows as batches of bounded size."""
    kept, size = [], 0
    for row in rows:
        kept.append(row)
        size += len(row[-1])
        if len(kept) >= OUT_ROWS or size >= OUT_BYTES:
            yield _arrow(kept, columns)
            kept, size = [], 0
    if kept:
        yield _arrow(kept, columns)


def _audited(conv: str, rows: Iterator[tuple]) -> tuple:
    """A row of ``_EDITS``. The conversation's marker, a row without a role, is passed over."""
    programme, faults, illegal, before = Audit(), dict.fromkeys(("blank", "duplicate", "truncated", ""), 0), 0, None
    low = high = None
    n_turns = 0
    for _, turn, role, n, blank, truncated, again in rows:
        if role is None:
            continue
        if turn is not None and turn != high:
            low, high, n_turns = turn if low is None else low, turn, n_turns + 1
        for copy in range(n):
            fault = "blank" if blank else "duplicate" if again or copy else "truncated" if truncated else ""
            faults[fault] += 1
            illegal += before is not None and before + role[:1] not in _LEGAL_PAIRS
            before = role[:1]
            programme.row(before if before in ("s", "u", "a") else "", fault)
    return conv, high - low + 1 - n_turns if n_turns else 0, faults["blank"], faults["duplicate"], faults["truncated"], illegal, *programme.end()


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _out((_audited(conv, rows) for conv, rows in _conversations(batches)), _EDITS)


def repaired_turns(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """role and text of each turn after the edits of ``audit``."""
    state = START
    for edit in audit:
        role, text = (expected(state), "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = expected(state) if edit == "R" else role
        state = FOLLOWS[state][role[:1]]
        yield role, text


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[tuple[str, str]]]]:
    """Each conversation's turns after its edits; the row with the audit comes before the others."""
    for conv, rows in _conversations(batches):
        audit = next(rows)[1]
        yield conv, repaired_turns(audit, ((role, text) for _, _, role, text in rows))


_TURNS = {"conv": "string", "number": "long", "role": "string", "text": "string"}
_DIGESTS = {"conv": "string", "repaired_sha256": "string"}


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _out(((conv, i, *turn) for conv, turns in _repaired(batches) for i, turn in enumerate(turns)), _TURNS)


def _digest(turns: Iterator[tuple[str, str]]) -> str:
    digest = hashlib.sha256()
    for i, (role, text) in enumerate(turns):
        digest.update(f"{chr(10) if i else ''}{role}:{text}".encode())
    return digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _out(((conv, _digest(turns)) for conv, turns in _repaired(batches)), _DIGESTS)


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {k}" for c, k in columns.items())


def edits(turns: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``_EDITS`` for every conversation of ``turns``; ``rows`` are those to repair (conv, turn, role, text)."""
    light = _light(rows)
    marks = turns.select(key_of("conv_id").alias("conv")).distinct()
    both = light.unionByName(marks, allowMissingColumns=True)
    ordered = both.repartition("conv").sortWithinPartitions("conv", F.col("role").isNotNull(), F.asc_nulls_first("turn"), "role", "digest")
    return ordered.select("conv", "turn", "role", F.col("n").cast("long"), "blank", "truncated", "again").mapInArrow(_audits, _ddl(_EDITS))


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows (conv, audit, role, text), in one partition."""
    both = rows.unionByName(audits.select("conv", "audit"), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", F.md5("text")).select("conv", "audit", "role", "text")


def _conv_id() -> Column:
    return F.when(F.col("conv") != " ", F.col("conv")).cast("long").alias("conv_id")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv_id, number (from 0), role, text: the turns after the edits of ``edits``."""
    return _with_audits(rows, audits).mapInArrow(_turns, _ddl(_TURNS)).select(_conv_id(), "number", "role", "text")


def repair(turns: DataFrame) -> DataFrame:
    """Damages all conversations (``damaged``), repairs them and tells what was wrong: one row for each conv_id of ``turns``.

    ``turns`` has conv_id, turn, role, text; other columns are not read. Rows of a null conv_id are one conversation. Rows go by
    turn (nulls first); ties go by role and by the text's MD5, and equal rows are alike. Equal rows at one turn and rows whose role
    and text stand at an earlier turn are duplicates. Null and empty texts are blank rows. A role that begins with none of
    s, u, a cannot be kept. A conversation without rows has zeros, an empty audit and the digest of nothing; an empty table gives
    an empty table.
    """
    rows = damaged(turns)
    found = written(edits(turns, rows), "audits")
    digests = _with_audits(rows, found).mapInArrow(_digests, _ddl(_DIGESTS))
    return found.join(digests, "conv").select(_conv_id(), *[c for c in _EDITS if c != "conv"], "repaired_sha256")


def _inserted(state: int, n: int) -> Iterator[str]:
    """The roles of ``n`` insertions behind a state."""
    for _ in range(n):
        yield expected(state)
        state = FOLLOWS[state][expected(state)[0]]


def oracle_sql() -> str:
    """DuckDB SQL for ``repair``: CRC-32 by recursion over bytes, the programme by recursion over rows with whole audits and texts."""
    moves = []
    for state in range(4):
        for n, at in _runs(state):
            told = "".join(f" || chr(10) || '{role}:'" for role in _inserted(state, n))
            paid, run = COSTS["I"] * n, "I" * n
            moves.append((state, paid + COSTS["D"], run + "D", at, "true", f"''{told}"))
            for initial, to in FOLLOWS[at].items():
                moves.append((state, paid + COSTS["K"], run + "K", to, f"initial = '{initial}' AND kept", f"''{told} || chr(10) || role || ':' || text"))
            to = FOLLOWS[at][expected(at)[0]]
            moves.append((state, paid + COSTS["R"], run + "R", to, "kept", f"''{told} || chr(10) || '{expected(at)}:' || text"))
    cases = "\n        UNION ALL ".join(
        f"SELECT d.conv, d.rn, {to} AS state, s.cost + {paid}{'' if code.endswith('D') else ' + late'} AS cost, s.audit || '{code}' AS audit, s.told || {told} AS told FROM p s JOIN d ON d.conv = s.conv AND d.rn = s.rn + 1 WHERE s.state = {state} AND {held}"
        for state, paid, code, to, held, told in moves
    )
    ends = " UNION ALL ".join(
        f"SELECT conv, rn, cost + {COSTS['I'] * n} AS cost, audit || '{'I' * n}' AS audit, told" + "".join(f" || chr(10) || '{role}:'" for role in _inserted(state, n)) + f" AS told FROM p WHERE state = {state}"
        for state in range(4)
        for n, at in _runs(state)
        if at in (START, ASSISTANT)
    )
    return f"""
    WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
    tab AS (SELECT i, c FROM bits WHERE k = 8),
    o AS (SELECT coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
    r AS (SELECT DISTINCT key, 0 AS pos, CAST(4294967295 AS BIGINT) AS c FROM o UNION ALL SELECT key, pos + 1, xor(tab.c, r.c >> 8) FROM r JOIN tab ON tab.i = xor(r.c, ascii(substr(key, pos + 1, 1))) & 255 WHERE pos < length(key)),
    h AS (SELECT key, xor(c, 4294967295) % 20 AS kind FROM r WHERE pos = length(key)),
    g AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM o JOIN h USING (key) CROSS JOIN range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, md5(text)) AS rn FROM g),
    f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY rn) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY rn) || substr(role, 1, 1) AS pair FROM n),
    d AS MATERIALIZED (SELECT conv, rn, role, text, substr(role, 1, 1) AS initial, fault NOT IN ('blank', 'duplicate') AS kept, CASE WHEN fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS late FROM f),
    p AS (SELECT DISTINCT conv, CAST(0 AS BIGINT) AS rn, 0 AS state, 0 AS cost, '' AS audit, '' AS told FROM o
        UNION ALL SELECT conv, rn, state, b.cost, b.audit, b.told FROM (SELECT conv, rn, state, min(struct_pack(cost := cost, audit := audit, told := told)) AS b FROM ({cases}) GROUP BY 1, 2, 3)),
    e AS (SELECT conv, min(struct_pack(cost := cost, audit := audit, told := told)) AS b FROM (SELECT *, max(rn) OVER (PARTITION BY conv) AS last FROM ({ends})) WHERE rn = last GROUP BY 1),
    c AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
    SELECT CASE WHEN conv <> ' ' THEN CAST(conv AS BIGINT) END AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(substr(b.told, 2)) AS repaired_sha256 FROM e LEFT JOIN c USING (conv)
    """
