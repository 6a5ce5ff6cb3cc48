"""A trie of conversation prefixes by van Emde Boas recursion: in log2(longest) rounds, whatever the conversations' lengths.

Sequences of turns are cut at half their depth. Equal upper halves get one name; the upper halves form the upper trie, and
the lower halves hang as forests below the names of what stands above them. Both are cut again, all parts of a round at
once, until single turns are left: then every turn knows the name of the prefix before it. Going back up, a round adds the
totals of the lower forests to the nodes above the cut they hang from.

Names are 128 bits of SHA-256 over the name above and the half's contents, so that naming needs no exchange and a prefix
that a third of all conversations share is no hot key: members are counted by partial sums. Texts are read once, for their
digest and length, and are not shuffled. Only nodes of two or more members take part in the rounds upward; a prefix of one
conversation is a chain with one leaf and nothing to save.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillprint.session import settle, ship_package

#: The name of the prefix without turns.
ROOT = bytes(16)
#: Conversation ids that are joined to one piece of text before a group's digest is taken.
PIECE = 1024


def _digest(*parts: Column) -> Column:
    joined = parts[0] if len(parts) == 1 else F.concat(*parts)
    return F.substring(F.unhex(F.sha2(joined, 256)), 1, 16)


def order_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, key, chars``: the turns of each conversation from 0 by ``turn``, null first.

    ``key`` stands for role and text (null is empty), ``chars`` are the code points of the text. Rows of equal turn come in
    the order of their keys, so repeated rows follow each other. Rows without ``conv_id`` take no part.
    Rows are sorted over all tasks by conversation and turn, so that one very long conversation is many tasks' work; each
    task numbers its own, and the few conversations that go on in the next task get an offset.
    """
    ship_package(conversations.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.char_length(text).cast("bigint").alias("chars"))

    def number(batches):
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            local = np.arange(len(ids)) - np.repeat(starts, np.diff(starts, append=len(ids)))
            if last == ids[0]:
                local[:starts[1] if len(starts) > 1 else len(ids)] += seen
            last, seen = ids[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(local), batch.column(2),
                 batch.column(3)], ["conv_id", "part", "local", "key", "chars"])

    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("key").asc()]
    numbered = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        number, "conv_id bigint, part int, local bigint, key binary, chars bigint"), "trie-turns")
    sizes = numbered.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most one conversation goes on from a task to the next: fewer rows than tasks
    offsets = sizes.withColumn("offset", F.sum("n").over(own)).where(F.col("offset").isNotNull()).drop("n")
    return numbered.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("local") + F.coalesce("offset", F.lit(0))).alias("pos"), "key", "chars")


def rebuild(turns: DataFrame, family: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """All conversation ids, and the turns after each conversation c took the beginning of conversation ``c - c % family``.

    With h = crc32(decimal c) % ``heads``: the first h turns of that conversation (all if it has fewer, none if it is
    absent), then c's own turns after its first h.
    """
    key = F.col("conv_id")
    h = F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(heads))
    base = key - key % family
    first = (turns.where((key % family == 0) & (F.col("pos") < heads - 1)).groupBy(key.alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "chars"))).alias("head")))
    ids = turns.groupBy("conv_id").agg(F.max("pos").alias("last"))
    taken = (ids.withColumn("base", base).join(first, "base")
             .select("conv_id", F.inline(F.slice("head", F.lit(1), h.cast("int")))))
    kept = (turns.where(F.col("pos") >= h).withColumn("base", base)
            .join(first.select("base", F.size("head").cast("bigint").alias("there")), "base", "left")
            .select("conv_id", (F.col("pos") - h + F.least(h, F.coalesce("there", F.lit(0)))).alias("pos"), "key", "chars"))
    return ids.select("conv_id"), taken.union(kept)


def name_prefixes(turns: DataFrame, rounds: int) -> DataFrame:
    """``conv_id, pos, parent, name, chars``: for every turn the names of the prefixes before and with it.

    Bottom up, neighbouring stretches of equal length are joined to stretches of twice the length; top down, a stretch is
    cut at half its length, and its lower half hangs below the name of the upper one. Every depth is a cut in one round, the
    one behind the last turn too (so a conversation counts as one place longer), and gets its name there.
    """
    stretches = [turns.select("conv_id", F.col("pos").alias("j"), "key")]
    for _ in range(1, rounds):
        half = F.struct("j", "key")
        joined = (stretches[-1].groupBy("conv_id", F.shiftright("j", 1).alias("up"))
                  .agg(F.min(half).alias("left"), F.max(half).alias("right"), F.count(F.lit(1)).alias("n"))
                  .where(F.col("n") == 2)
                  .select("conv_id", F.col("up").alias("j"), _digest(F.col("left.key"), F.col("right.key")).alias("key")))
        stretches.append(settle(joined, "trie-stretches"))
    lasts = turns.groupBy("conv_id").agg(F.max("pos").alias("last"))
    parts = lasts.select("conv_id", "last", F.lit(0).cast("bigint").alias("j"), F.lit(ROOT).alias("root"))
    for k in range(rounds - 1, -1, -1):
        upper = parts.select("conv_id", "last", (F.col("j") * 2).alias("j"), "root")
        # the lower half is there if the conversation reaches the cut; then the upper half is whole
        halves = stretches[k].where(F.col("j") % 2 == 0)
        cut = upper.where(F.col("last") + 1 >= (F.col("j") + 1) * (1 << k)).join(halves, ["conv_id", "j"])
        lower = cut.select("conv_id", "last", (F.col("j") + 1).alias("j"),
                           _digest(F.col("root"), F.col("key")).alias("root"))
        parts = settle(upper.union(lower), "trie-parts")
    before = parts.select("conv_id", F.col("j").alias("pos"), F.col("root").alias("parent"))
    behind = parts.select("conv_id", (F.col("j") - 1).alias("pos"), F.col("root").alias("name"))
    return (turns.select("conv_id", "pos", "chars").join(before, ["conv_id", "pos"]).join(behind, ["conv_id", "pos"])
            .select("conv_id", "pos", "parent", "name", "chars"))


def graft(values: DataFrame, paths: DataFrame, rounds: int) -> DataFrame:
    """``values`` with ``saved`` and ``leaves`` summed over each node's subtree.

    ``values``: ``name, conv_id, pos, parent, parent_conv, saved, leaves`` of the nodes of two or more members, with what
    belongs to the node itself; ``pos`` is the place of its last turn, ``conv_id`` its smallest member.
    ``paths``: ``conv_id, pos, name`` of the smallest members. After round k a node holds the sum over its part of 2 ** k
    turns: the totals of the forests below the part's middle go to the nodes between its top and that middle.
    """
    for k in range(1, rounds + 1):
        half = 1 << (k - 1)
        hung = (values.where(F.col("pos") % (1 << k) == half)
                .groupBy(F.col("parent_conv").alias("conv_id"), F.shiftright("pos", k).alias("part"))
                .agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")))
        above = paths.where(F.col("pos").bitwiseAND(half) == 0).withColumn("part", F.shiftright("pos", k))
        added = (above.join(hung, ["conv_id", "part"]).groupBy("name")
                 .agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves")))
        values = settle(values.join(added, "name", "left").select(
            "name", "conv_id", "pos", "parent", "parent_conv",
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves")), "trie-totals")
    return values


def ends(rows: DataFrame) -> DataFrame:
    """``name, ends_sha256``: the SHA-256 of each name's conversation ids, ascending, with commas between.

    Ids are sorted over all tasks and joined to pieces where they lie. A digest is one pass over its pieces, which come
    sorted and are not held: so a name that a third of all conversations end at costs its task time, not memory.
    """
    ship_package(rows.sparkSession)

    def join(batches):
        for batch in batches:
            names, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, s = [], 0
            for e in range(1, len(ids) + 1):
                if e == len(ids) or names[e] != names[s] or e - s == PIECE:
                    out.append((names[s], ids[s], ",".join(map(str, ids[s:e]))))
                    s = e
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (
                pa.binary(), pa.int64(), pa.string()))] if out else [pa.array([], pa.binary()), pa.array([], pa.int64()),
                                                                     pa.array([], pa.string())], ["name", "first", "piece"])

    def take(batches):
        current, state = None, None
        for batch in batches:
            names, digests = [], []
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(2)):
                if name != current:
                    if current is not None:
                        names.append(current)
                        digests.append(state.hexdigest())
                    current, state = name, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(piece.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())],
                                             ["name", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([state.hexdigest()])],
                                             ["name", "ends_sha256"])

    pieces = rows.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(
        join, "name binary, first bigint, piece string")
    return pieces.repartition("name").sortWithinPartitions("name", "first").mapInArrow(
        take, "name binary, ends_sha256 string")


def prefix_trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct beginning of a conversation, the empty one included.

    ``ids`` are all conversations (``conv_id``), those without turns too; ``turns`` are ``conv_id, pos, key, chars`` with
    places from 0 without gaps. Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``. Without conversations there are no nodes.
    """
    turns = settle(turns, "trie-rebuilt")
    longest = (turns.agg(F.max("pos")).first()[0] or 0) + 1
    rounds = longest.bit_length()
    members = settle(name_prefixes(turns, rounds), "trie-members")
    found = settle(members.groupBy("name").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.min("parent").alias("parent"),
        F.min("pos").alias("pos"), F.min("chars").alias("chars")), "trie-found")
    all_ids = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    below = found.groupBy(F.col("parent").alias("name")).agg(
        F.count(F.lit(1)).alias("n_children"), F.sum((F.col("n") == 1).cast("bigint")).alias("single"))
    children, single = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("n_children", "single"))
    leaves = single + (children == 0).cast("bigint")
    deeper = found.where("pos > 0").join(found.select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv")),
                                         "parent")
    top = found.where("pos = 0").crossJoin(F.broadcast(all_ids.select(F.col("conv_id").alias("parent_conv"))))
    nodes = settle(deeper.unionByName(top).join(below, "name", "left").select(
        "name", "conv_id", "n", "parent", "parent_conv", "pos", children.alias("n_children"), leaves.alias("leaves"),
        ((F.col("n") - 1) * F.col("chars")).alias("saved")), "trie-nodes")

    shared = nodes.where("n > 1")
    deepest = shared.groupBy("conv_id").agg(F.max("pos").alias("deepest"))
    paths = settle(members.join(deepest, "conv_id").where(F.col("pos") <= F.col("deepest")).select(
        "conv_id", "pos", "name"), "trie-paths")
    totals = graft(shared.select("name", "conv_id", "pos", "parent", "parent_conv", "saved", "leaves"), paths, rounds)

    last = members.groupBy("conv_id").agg(F.max_by("name", "pos").alias("name"))
    ended = ends(ids.join(last, "conv_id", "left").select(F.coalesce("name", F.lit(ROOT)).alias("name"), "conv_id"))
    whole = totals.where("pos = 0").agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
                                        F.coalesce(F.sum("leaves"), F.lit(0)).alias("leaves"))
    root = (all_ids.where("n > 0").crossJoin(F.broadcast(whole))
            .join(F.broadcast(below.where(F.col("name") == F.lit(ROOT))), F.lit(True), "left")
            .select(F.lit(ROOT).alias("name"), "conv_id", F.lit(0).cast("bigint").alias("depth"),
                    F.lit(None).cast("bigint").alias("parent_conv_id"), F.col("n").alias("n_convs"),
                    children.alias("n_children"), (F.col("leaves") + leaves).alias("n_leaves"),
                    F.col("saved").alias("saved_tokens")))
    rest = nodes.drop("saved").join(totals.select("name", "saved", F.col("leaves").alias("below")), "name", "left").select(
        "name", "conv_id", (F.col("pos") + 1).alias("depth"), F.col("parent_conv").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), "n_children", F.coalesce("below", F.lit(1).cast("bigint")).alias("n_leaves"),
        F.coalesce("saved", F.lit(0).cast("bigint")).alias("saved_tokens"))
    return rest.unionByName(root).join(ended, "name", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))


def digest(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations. Other columns of the table are not read."""
    ids, turns = rebuild(order_turns(conversations))
    return prefix_trie(ids, turns)


def digest_sql() -> str:
    """The same by lists of whole prefixes: every conversation's every beginning, and every pair of node and ancestor."""
    crc = ("xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), "
           "lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
           "lambda d, z: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT)")
    return f"""
WITH keyed AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS key
  FROM conversations WHERE conv_id IS NOT NULL),
original AS (
  SELECT conv_id, list(struct_pack(key := key, chars := length(text)) ORDER BY turn NULLS FIRST, key) AS turns
  FROM keyed GROUP BY conv_id),
cut AS (SELECT *, {crc} % 6 AS h FROM original),
rebuilt AS (
  SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns
  FROM cut c LEFT JOIN original b ON b.conv_id = c.conv_id - c.conv_id % 100),
prefixes AS (
  SELECT conv_id, d, len(turns) AS n, CASE WHEN d > 0 THEN turns[d].chars ELSE 0 END AS chars,
         array_to_string(list_transform(turns[1:d], lambda t: t.key), '') AS path
  FROM rebuilt, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (
  SELECT path, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY path),
children AS (
  SELECT substr(path, 1, 32 * (depth - 1)::BIGINT) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
below AS (
  SELECT substr(path, 1, 32 * d::BIGINT) AS path, sum((n_convs - 1) * chars) AS saved,
         count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM known, unnest(range(0, depth + 1)) AS u(d) GROUP BY 1)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, b.leaves AS n_leaves,
       b.saved::BIGINT AS saved_tokens, k.ends_sha256
FROM known k JOIN below b USING (path)
LEFT JOIN nodes p ON k.depth > 0 AND p.path = substr(k.path, 1, 32 * (k.depth - 1)::BIGINT)"""
