"""A trie of conversation prefixes, family by family.

Conversations that share a base id are a family. A family's rows meet in one task, as a sorted
stream: its conversations are rebuilt, and its own small trie is built of them. Only the
combined nodes of families are shuffled and merged by the digest of their path. What is asked of whole
subtrees goes the same way back: each merged node is handed to the family of its smallest member, a
second stream adds these values up within each family, from the deepest nodes to the root, and the
families' sums are added by node. So no step is repeated for each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read

#: Conversations that may share a base, and the most turns that are taken from it, plus one.
FAMILY, HEADS = 5, 9
#: Nodes of one family that a task holds before it hands them on.
HELD = 50_000
#: Conversations whose ids are joined to one piece of text before a node's digest reads them.
PIECE = 4096
_ROOT = bytes(16)
_NODE = "base long, digest binary, parent binary, depth long, bytes long, n long, conv long, ends array<long>"
_ARROW = pa.schema([("base", pa.int64()), ("digest", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("bytes", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()), ("ends", pa.list_(pa.int64()))])


class _Family:
    """The trie of one family: per path digest its parent, depth, bytes, members, least member, ends."""

    def __init__(self, base: int):
        self.base, self.head, self.nodes = base, [], {}

    def start(self, conv: int, shared: int) -> None:
        self.conv, self.shared, self.own, self.path, self.depth = conv, shared, 0, _ROOT, 0
        self._visit(_ROOT, None, 0)
        if conv != self.base:
            for digest, size in self.head[:shared]:
                self._step(digest, size)

    def turn(self, digest: bytes, size: int) -> None:
        if self.conv == self.base:
            if len(self.head) < HEADS - 1:
                self.head.append((digest, size))
            self._step(digest, size)
        elif self.own >= self.shared:
            self._step(digest, size)
        self.own += 1

    def end(self) -> None:
        if self.path not in self.nodes:  # handed on meanwhile
            self.nodes[self.path] = [self.parent, self.depth, self.size, 0, self.conv, []]
        self.nodes[self.path][5].append(self.conv)

    def _step(self, digest: bytes, size: int) -> None:
        parent, self.path = self.path, hashlib.sha256(self.path + digest).digest()[:16]
        self.depth += 1
        self._visit(self.path, parent, size)

    def _visit(self, path: bytes, parent: bytes | None, size: int) -> None:
        self.size, self.parent = size, parent
        node = self.nodes.get(path)
        if node is None:
            self.nodes[path] = [parent, self.depth, size, 1, self.conv, []]
        else:
            node[3] += 1
            node[4] = min(node[4], self.conv)

    def rows(self) -> list[tuple]:
        out = [(self.base, d, p, depth, size, n, conv, ends) for d, (p, depth, size, n, conv, ends) in self.nodes.items()]
        self.nodes = {}
        return out


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns by family, conversation (the base first) and turn -> combined nodes of each family."""
    family, out = None, []

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    for b in batches:
        for base, conv, shared, digest, size in zip(*(b.column(c).to_pylist() for c in ("base", "conv", "shared", "digest", "bytes")), strict=True):
            if family is None or family.base != base:
                if family:
                    family.end()
                    out += family.rows()
                family = _Family(base)
                family.start(conv, shared)
            elif family.conv != conv:
                family.end()
                family.start(conv, shared)
            family.turn(digest, size)
            if len(family.nodes) >= HELD:
                out += family.rows()
            if len(out) >= HELD:
                yield batch(out)
                out = []
    if family:
        family.end()
        out += family.rows()
    if out:
        yield batch(out)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of families and the values handed to them, deepest first -> sums over the family's subtrees.

    A family has at most as many nodes of one depth as conversations, so what is held is small.
    """
    base = depth = None
    here: dict[bytes, list] = {}  # digest -> parent, leaves, saved: the nodes of this depth
    above: dict[bytes, list[int]] = {}  # what they hand to their parents

    def close(out: list[tuple]) -> dict[bytes, list[int]]:
        up: dict[bytes, list[int]] = {}
        for digest, (parent, leaves, saved) in here.items():
            if leaves or saved:
                out.append((digest, leaves, saved))
                if parent is not None:
                    sums = up.setdefault(parent, [0, 0])
                    sums[0] += leaves
                    sums[1] += saved
        return up

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["digest", "leaves", "saved"])

    for b in batches:
        out: list[tuple] = []
        for row_base, row_depth, digest, parent, leaves, saved in zip(*(b.column(c).to_pylist() for c in ("base", "depth", "digest", "parent", "leaves", "saved")), strict=True):
            if (row_base, row_depth) != (base, depth):
                above = close(out)
                if row_base != base:
                    above = {}
                base, depth, here = row_base, row_depth, {}
            node = here.get(digest)
            if node is None:
                node = here[digest] = [parent, *above.pop(digest, (0, 0))]
            node[1] += leaves
            node[2] += saved
        if out:
            yield batch(out)
    out = []
    close(out)
    if out:
        yield batch(out)


def _join_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of id lists in order -> SHA-256 of each node's whole list."""
    at, state = None, None
    for b in batches:
        done: list[tuple] = []
        for digest, piece in zip(b.column("digest").to_pylist(), b.column("piece").to_pylist(), strict=True):
            if digest != at:
                if state:
                    done.append((at, state.hexdigest()))
                at, state = digest, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], ["digest", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def shared_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its base."""
    return (F.crc32(conv.cast("string")) % HEADS).cast("long")


def prefix_trie(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation is rebuilt of the first turns of its base's conversation (the id less its
    remainder by FAMILY; 0 to HEADS - 1 turns, by the CRC-32 of its id) and its own later turns. A node is a
    distinct run of first turns, from the textless root; equal turns are equal in role and text, told by
    SHA-256. Turns stand by turn number, nulls first, ties by the SHA-256 of role and text, so that
    repeated rows are repeated turns. A null role or text is empty. Rows without a conversation
    id take no part. An empty table gives an empty result; other columns are ignored.

    Texts are replaced by digests before the first shuffle. A conversation may have any number of
    turns: its family streams through a task, which hands nodes on as they get many; ids that end at
    one node are joined in pieces of bounded size, and only the pieces are read in order.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    turns = rows.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text"))
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    conv = F.col("conv")
    turns = turns.select(base_of(conv).alias("base"), "conv", "turn", shared_turns(conv).alias("shared"), F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length("text").cast("long").alias("bytes"))
    turns = turns.repartition("base").sortWithinPartitions("base", F.col("conv") != F.col("base"), "conv", F.asc_nulls_first("turn"), "digest")
    family = materialize(turns.select("base", "conv", "shared", "digest", "bytes").mapInArrow(_build, _NODE))

    # a node's parent, depth and bytes follow from its digest
    merged = materialize(family.where("n > 0").groupBy("digest", "parent", "depth", "bytes").agg(F.min("conv").alias("conv"), F.sum("n").alias("n")))
    children = merged.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "digest")
    parents = merged.select(F.col("digest").alias("parent"), F.col("conv").alias("parent_conv"))
    nodes = merged.join(children, "digest", "left").join(parents, "parent", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes)

    handed = nodes.select(base_of(conv).alias("base"), "depth", "digest", "parent", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("bytes")).alias("saved"))
    own = family.where("n > 0").select("base", "depth", "digest", "parent", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    stream = own.union(handed).repartition("base").sortWithinPartitions("base", F.desc("depth"))
    sums = stream.mapInArrow(_add_up, "digest binary, leaves long, saved long").groupBy("digest").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    ends = family.select("digest", F.explode("ends").alias("end"))
    pieces = ends.groupBy("digest", F.floor(F.col("end") / PIECE).alias("at")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("end")), lambda x: x.cast("string")), ",").alias("piece"))
    digests = pieces.repartition("digest").sortWithinPartitions("digest", "at").select("digest", "piece").mapInArrow(_join_digests, "digest binary, ends_sha256 string")

    out = nodes.join(sums, "digest").join(digests, "digest", "left")
    empty = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", empty)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read(spark, sf_dir, "conversations"))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i,
    length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS turn, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, c - c % 5 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, o: CASE WHEN o >= 0 THEN xor(s, o) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END), 4294967295::BIGINT) % 9 AS h
  FROM (SELECT DISTINCT c FROM t)
), rebuilt AS (
  SELECT crc.c, t.turn, t.bytes, 0 AS part, t.i FROM crc JOIN t ON t.c = crc.base AND t.i <= crc.h
  UNION ALL SELECT crc.c, t.turn, t.bytes, 1, t.i FROM crc JOIN t ON t.c = crc.c AND t.i > crc.h
), steps AS (
  SELECT c, row_number() OVER o AS depth, bytes, sha256(string_agg(strlen(turn) || ':' || turn, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS node
  FROM rebuilt WINDOW o AS (PARTITION BY c ORDER BY part, i)
), paths AS (
  SELECT c, 0 AS depth, 0 AS bytes, 'root' AS node FROM crc UNION ALL SELECT * FROM steps
), linked AS (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY depth) AS parent, lead(node) OVER (PARTITION BY c ORDER BY depth) IS NULL AS last FROM paths
), nodes AS (
  SELECT node, parent, depth, bytes, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
  FROM linked GROUP BY node, parent, depth, bytes
), children AS (
  SELECT parent, count(*) AS n FROM nodes GROUP BY parent
), valued AS (
  SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children ON children.parent = nodes.node
), sums AS (
  SELECT a.node, count(*) FILTER (WHERE w.n_children = 0) AS n_leaves, CAST(sum((w.n_convs - 1) * w.bytes) AS BIGINT) AS saved_tokens
  FROM valued w JOIN paths a ON a.c = w.conv_id AND a.depth <= w.depth GROUP BY a.node
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.node = v.node LEFT JOIN nodes p ON p.node = v.parent
"""
