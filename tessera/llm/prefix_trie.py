"""Prefix trie of conversations, with subtree figures by heavy-path decomposition.

A conversation's turns are numbered, its sequence is rebuilt (the first turns of the base conversation, then its own), and every
prefix gets a key: the sum of hashes of (place, role, text) over the prefix, 122 bits. Equal keys are one node. A node's heavy
child is the one with the most members, so at most log2(members) light edges lie above any node. Running along a conversation,
the last light node above gives each node its heavy path, and the number of light nodes above the path's level. Totals of whole paths go
to the paths that they hang from, one level a round, deepest first; a path's nodes then get their subtrees' sums as
suffix sums along the path, over each node's own figure and the totals of the light paths that hang from it.

Neither a long conversation nor a long path nor a node of many members is ever gathered: what runs along them (numbers, keys, heavy
paths, suffix sums, lists of members) is a ``scan``. It sorts by range, runs within each range in its task, and carries
on what a range leaves open from a few numbers a range.

Defined cases: a null role or text is empty, a null turn comes first; turns of one number stand in the order of role and
text; repeated rows are turns each; rows of a null conv_id belong to no conversation and are left out; ids below zero take
their base and remainder as Spark's % does, towards zero; an empty table has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialise

FAMILY, HEAD = 5, 9
MASK = (1 << 61) - 1
KEY, PARENT, PATH = ["s1", "s2"], ["p1", "p2"], ["q1", "q2"]
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
#: Characters of a list of members that are handed on in one row, but for the last ids; a batch holds up to 10,000 of them.
PIECE = 4_000


def masked(c: Column) -> Column:
    return c.bitwiseAND(F.lit(MASK))


def numbers(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def new_groups(columns: list[np.ndarray], last: tuple | None) -> np.ndarray:
    """Whether each row begins another group than the row before it; ``last``: the group of the row before the batch."""
    new = np.zeros(len(columns[0]), bool)
    for k, c in enumerate(columns):
        new[1:] |= c[1:] != c[:-1]
        new[0] |= last is None or c[0] != last[k]
    return new


def scan(rows: DataFrame, group: list[str], order: list, sums: list[str], keep: list[str], flag: str | None = None, kept: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all long, ``group`` among them) of the rows, with running figures in order within their group.

    ``x_sum``, for x of ``sums``: the sum of x up to and with the row, modulo 2^61. ``x_last``, for x of ``kept``: x at the last
    row up to and with this one where ``flag`` is 1, and 0 before any. ``order`` may name columns of any type."""
    kept = kept or []
    made = [*(f"{x}_sum" for x in sums), *([f"{x}_last" for x in kept] + ["seen"] if flag else [])]
    out = [*keep, *made, "range", "mark"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        last: tuple | None = None
        carry = [0] * len(made)

        def border(mark: int) -> pa.RecordBatch:
            """A row that says which group the range begins (1) or ends (2) with, and its figures so far."""
            at = dict(zip(group, last, strict=True))
            values = [*(int(at.get(c, 0)) for c in keep), *(carry if mark == 2 else [0] * len(made)), number, mark]
            return pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in values], out)

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = numbers(batch, group)
            new = new_groups(groups, last)
            begins = last is None
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))  # where the row's group begins in the batch
            goes_on = np.cumsum(new) == 0  # rows of the group that the batch before ended with
            columns: list[np.ndarray] = []
            for x in sums:
                v = numbers(batch, [x])[0]
                total = v.cumsum()
                total = total - (total - v)[first]
                columns.append(np.where(goes_on, total + carry[len(columns)], total) & MASK)
            if flag:
                marked = np.maximum.accumulate(np.where(numbers(batch, [flag])[0] != 0, np.arange(len(new)), -1))
                seen = marked >= first
                for x in kept:
                    v = np.where(seen, numbers(batch, [x])[0][marked], 0)
                    columns.append(np.where(goes_on & ~seen, carry[len(columns)], v))
                columns.append(np.where(goes_on & ~seen, carry[len(columns)], seen.astype(np.int64)))
            carry, last = [int(c[-1]) for c in columns], tuple(g[0 if begins else -1] for g in groups)
            if begins:
                yield border(1)
                last = tuple(g[-1] for g in groups)
            more = [*columns, np.full(len(new), number), np.zeros(len(new), np.int64)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, pa.int64()) for c in more)], out)
        if last is not None:
            yield border(2)

    needed = list(dict.fromkeys([*keep, *sums, *kept, *([flag] if flag else [])]))
    ordered = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).select(*needed)
    table = materialise(ordered.mapInArrow(run, ", ".join(f"{c} long" for c in out)), "scan")
    taken = taken_over(table.where("mark > 0").collect(), group, made)  # two rows for each range
    result = table.where("mark = 0")
    if taken:
        names = ["range", *group, *(f"{c}_before" for c in made)]
        result = result.join(F.broadcast(table.sparkSession.createDataFrame(taken, ", ".join(f"{c} long" for c in names))), ["range", *group], "left")
        for x in sums:
            result = result.withColumn(f"{x}_sum", masked(F.col(f"{x}_sum") + F.coalesce(f"{x}_sum_before", F.lit(0))))
        for x in kept if flag else []:
            result = result.withColumn(f"{x}_last", F.when(F.col("seen") == 1, F.col(f"{x}_last")).otherwise(F.coalesce(f"{x}_last_before", F.lit(0))))
    return result.select(*keep, *[c for c in made if c != "seen"])


def taken_over(borders: list, group: list[str], made: list[str]) -> list[tuple]:
    """For each range whose first group began before it: the range, the group, and the group's figures up to it."""
    first = {r.range: tuple(r[c] for c in group) for r in borders if r.mark == 1}
    final = {r.range: r for r in borders if r.mark == 2}
    out, open_group, open_figures = [], None, {}
    for k in sorted(first):
        ends, figures = tuple(final[k][c] for c in group), {c: final[k][c] for c in made}
        if first[k] == open_group:
            out.append((k, *open_group, *(open_figures[c] for c in made)))
            if ends == open_group:  # the group fills the range
                for c in made:
                    if c.endswith("_sum"):
                        figures[c] = (figures[c] + open_figures[c]) & MASK
                    elif not final[k]["seen"]:
                        figures[c] = open_figures[c]
        open_group, open_figures = ends, figures
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, place (from 1), s1, s2, p1, p2 (keys of the prefix up to the turn and before it), bytes, last; and the conversations (conv, turns)."""
    said = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    said = said.withColumn("digest", digest).select(
        "*", *(F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(x) for x, at in (("x1", 1), ("x2", 17))),
        F.octet_length("text").cast("long").alias("bytes"), F.lit(1).cast("long").alias("pos"), F.monotonically_increasing_id().alias("tie"),
    )
    own = scan(said, ["conv"], ["turn", "role", "text", "tie"], ["pos"], ["conv", "x1", "x2", "bytes"]).withColumnRenamed("pos_sum", "pos")
    lengths = own.groupBy("conv").agg(F.count("*").alias("n"))
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD
    convs = lengths.select("conv", "n", head.alias("head"), (F.col("conv") - F.col("conv") % FAMILY).alias("base"))
    convs = convs.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    convs = convs.withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    convs = materialise(convs.withColumn("turns", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "conversations")
    # at most HEAD - 1 turns of a base for each of its FAMILY conversations
    shared = own.where(F.col("pos") < HEAD).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "taken", "turns"), "base").where("pos <= taken").withColumn("place", F.col("pos"))
    kept = own.join(convs.select("conv", "head", "taken", "turns"), "conv").where("pos > head").withColumn("place", F.col("pos") - F.col("head") + F.col("taken"))
    columns = ["conv", "place", "x1", "x2", "bytes", "turns"]
    rows = shared.select(*columns).unionByName(kept.select(*columns))
    rows = rows.withColumn("g1", masked(F.xxhash64("x1", "place", F.lit(1)))).withColumn("g2", masked(F.xxhash64("x2", "x1", "place")))
    rows = rows.withColumn("last", (F.col("place") == F.col("turns")).cast("long"))
    rows = scan(rows, ["conv"], ["place"], ["g1", "g2"], ["conv", "place", "bytes", "last", "g1", "g2"])
    rows = rows.withColumnsRenamed({"g1_sum": "s1", "g2_sum": "s2"}).withColumn("p1", masked(F.col("s1") - F.col("g1"))).withColumn("p2", masked(F.col("s2") - F.col("g2")))
    return rows.drop("g1", "g2"), convs.select("conv", "turns")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes: s1, s2, depth, n, conv, bytes, p1, p2, n_children, parent (0 for the root), light."""
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy(*KEY).agg(
        F.max("place").alias("depth"), F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )
    root = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).where("n > 0")
    root = root.select(zero.alias("s1"), zero.alias("s2"), zero.alias("depth"), "n", "conv", zero.alias("bytes"), F.lit(-1).cast("long").alias("p1"), F.lit(-1).cast("long").alias("p2"))
    nodes = materialise(nodes.unionByName(root), "nodes")
    below = nodes.where("depth > 0").groupBy(*PARENT).agg(F.count("*").alias("n_children"), F.max(F.struct("n", *KEY)).alias("heavy"))
    below = materialise(below.select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), "n_children", F.col("heavy.s1").alias("h1"), F.col("heavy.s2").alias("h2")), "below")
    above = nodes.select(*KEY, F.col("conv").alias("parent")).join(below.drop("n_children"), KEY).withColumnsRenamed({"s1": "p1", "s2": "p2"})
    light = F.coalesce(((F.col("s1") != F.col("h1")) | (F.col("s2") != F.col("h2"))).cast("long"), zero)
    nodes = nodes.join(above, PARENT, "left").join(below.select(*KEY, "n_children"), KEY, "left")
    children, parent = F.coalesce("n_children", zero).alias("n_children"), F.coalesce("parent", zero).alias("parent")
    return materialise(nodes.select(*KEY, "depth", "n", "conv", "bytes", *PARENT, children, parent, light.alias("light")), "trie")


def heavy_paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with level and q1, q2 (key of the path's top): the last light node along a conversation, the root if there is none."""
    marked = rows.select("conv", "place", *KEY).join(nodes.select(*KEY, "light", F.col("conv").alias("owner")), KEY)
    along = scan(marked, ["conv"], ["place"], ["light"], ["conv", "place", *KEY, "owner"], "light", KEY)
    along = along.where("conv = owner").select(*KEY, F.col("light_sum").alias("level"), F.col("s1_last").alias("q1"), F.col("s2_last").alias("q2"))
    zero = F.lit(0).cast("long")
    return materialise(nodes.drop("light").join(along, KEY, "left").na.fill(0, ["level", *PATH]).withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("bytes") + zero), "paths")


def hanging(nodes: DataFrame) -> DataFrame | None:
    """p1, p2, leaves_below, saved_below: totals of the light paths that hang from each node; None if there are none.

    One round a level, deepest first; there are at most log2(conversations) of them."""
    paths = nodes.groupBy(*PATH).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"), F.max("level").alias("level"))
    tops = nodes.where("depth > 0 AND s1 = q1 AND s2 = q2").select(*PATH, *PARENT)
    of_parent = nodes.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("q1").alias("u1"), F.col("q2").alias("u2"))
    paths = materialise(paths.join(tops, PATH).join(of_parent, PARENT), "path_sums")
    totals, up = [], None
    for level in range(paths.agg(F.max("level")).first()[0] or 0, 0, -1):
        now = paths.where(F.col("level") == level)
        if up is not None:
            now = now.join(up, PATH, "left")
            now = now.withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        now = materialise(now.select(*PARENT, "u1", "u2", "leaves", "saved"), "totals")
        up = now.groupBy(F.col("u1").alias("q1"), F.col("u2").alias("q2")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        totals.append(now)
    if not totals:
        return None
    every = totals[0]
    for t in totals[1:]:
        every = every.unionByName(t)
    return every.groupBy(*PARENT).agg(F.sum("leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))


def member_digests(ends: DataFrame) -> DataFrame:
    """s1, s2, ends_sha256 over the comma-joined ids (conv) of each key, ascending.

    A range's tasks write the short lists that lie inside it as digests, the others in pieces, which are hashed in order of ranges:
    SHA-256 has to run along a list, but nothing of it is held."""
    names = [*KEY, "range", "piece", "text", "whole"]
    schema = "s1 long, s2 long, range int, piece int, text string, whole boolean"

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        key, said, piece, begins = None, "", 0, True
        rows: list[tuple] = []

        def close(ends_range: bool) -> None:
            if piece or begins or ends_range:
                rows.append((*key, number, piece, said, False))
            else:
                rows.append((*key, number, 0, hashlib.sha256(said.encode()).hexdigest(), True))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]
            out = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, convs = numbers(batch, [*KEY, "conv"])
            cuts = [*np.flatnonzero(new_groups([a, b], None)).tolist(), len(a)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                now = (int(a[x]), int(b[x]))
                if now != key:
                    if key is not None:
                        close(False)
                        begins = False
                    key, said, piece = now, "", 0
                for at in range(x, y, 400):
                    more = ",".join(map(str, convs[at : min(at + 400, y)].tolist()))
                    said = f"{said},{more}" if said else more
                    if len(said) > PIECE:
                        rows.append((*key, number, piece, said, False))
                        said, piece = "", piece + 1
            yield flush()
        if key is not None:
            close(True)
        yield flush()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, empty = None, None, True
        for batch in batches:
            done = []
            for s1, s2, text in zip(*(batch.column(c).to_pylist() for c in (*KEY, "text")), strict=True):
                if (s1, s2) != key:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha, empty = (s1, s2), hashlib.sha256(), True
                if text:
                    sha.update(text.encode() if empty else f",{text}".encode())
                    empty = False
            yield digests(done)
        yield digests([(*key, sha.hexdigest())] if key is not None else [])

    def digests(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) if done else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], [*KEY, "ends_sha256"])

    order = [*KEY, "conv"]
    table = materialise(ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(written, schema), "ends")
    open_lists = table.where("NOT whole").repartition(*KEY).sortWithinPartitions(*KEY, "range", "piece")
    return table.where("whole").select(*KEY, F.col("text").alias("ends_sha256")).unionByName(open_lists.mapInArrow(hashed, "s1 long, s2 long, ends_sha256 string"))


def report(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(turns)
    nodes = heavy_paths(rows, trie(rows, convs))
    below = hanging(nodes)
    if below is not None:
        nodes = nodes.join(below.withColumnsRenamed({"p1": "s1", "p2": "s2"}), KEY, "left")
        nodes = nodes.withColumn("leaf", F.col("leaf") + F.coalesce("leaves_below", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("saved_below", F.lit(0)))
    keep = [*PATH, *KEY, "depth", "n", "conv", "parent", "n_children"]
    summed = scan(nodes.withColumn("up", -F.col("depth")), PATH, ["up"], ["leaf", "saved"], keep)
    zero = F.lit(0).cast("long")
    ends = rows.where("last = 1").select(*KEY, "conv").unionByName(convs.where("turns = 0").select(zero.alias("s1"), zero.alias("s2"), "conv"))
    return summed.join(member_digests(ends), KEY, "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("leaf_sum").alias("n_leaves"),
        F.col("saved_sum").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"),
    )


#: The same for DuckDB, with whole prefixes as keys; made for small tables.
SQL = f"""
WITH said AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT c, c - c % {FAMILY} AS base, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) ELSE xor(r >> 1, 3988292384 * (r & 1)) END)) % {HEAD} AS head
  FROM (SELECT DISTINCT c FROM said)),
built AS (
  SELECT v.c, 0 AS part, pos, role, text FROM convs v JOIN said s ON s.c = v.base AND pos <= head
  UNION ALL SELECT v.c, 1, pos, role, text FROM convs v JOIN said s ON s.c = v.c AND pos > head),
paths AS (SELECT c, coalesce(list({{'r': role, 't': text}} ORDER BY part, pos) FILTER (WHERE pos IS NOT NULL), []) AS p FROM convs LEFT JOIN built USING (c) GROUP BY c),
prefixes AS (SELECT c, p, p[1:d] AS k, d FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM paths)),
nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE len(p) = d), '')) AS ends
  FROM prefixes GROUP BY k, d),
children AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n - 1) * octet_length(encode(k[d].t)) ELSE 0 END AS saved
  FROM nodes LEFT JOIN children USING (k, d)),
subtrees AS (
  SELECT k[1:j] AS k, j AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM own) GROUP BY ALL)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(o.n AS BIGINT) AS n_convs, CAST(o.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN subtrees s ON o.k = s.k AND o.d = s.d LEFT JOIN nodes u ON o.d > 0 AND u.d = o.d - 1 AND u.k = o.k[1:o.d - 1]
"""
