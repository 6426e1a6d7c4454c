"""Prefix trie of rebuilt conversations, merged family first.

A family is the conversations of one base id (c - c % 20).  Turns travel as a
digest, a number and two longs, never as text.  One shuffle brings a family
together in order, its base first; a task streams through it, keeps the base's
first three turns, rebuilds every conversation and gathers the family's own
small trie.  Only those nodes are shuffled again, and merged over all families.

What depends on the subtree needs no walk over levels.  A node is owned by its
smallest member, and what a conversation owns is the end of its path.  So the
tokens saved below a node are, over its members without the owner, the words
above what each of them owns, less the words above the node; and its leaves are
those that its members own.  Each family needs just two numbers a conversation.

Ids that end at a node are hashed in order: families are disjoint and ascending
ranges of ids, so their sorted pieces are laid out by range, joined into chunks,
and one stream of chunks a node goes through SHA-256 (which has no parallel
form), in memory of one chunk.

Defined results: rows with a null conv_id are no conversation and are dropped; a
null turn comes first, and rows of one conversation with equal turns are in
order of their digests (equal rows repeat); null role or text is empty;
c % 20 keeps the sign of c, so ids from -19 to 19 share base 0; an empty table
has no nodes.  Only the four named columns are read, so others may have any
name.  Texts may have any length: they are digested and counted before anything
is moved.  A long conversation is read as a stream; a family's trie is handed on
in parts once it has ``MAX_NODES`` nodes.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import shuffle_parts, stored

FAMILY = 20
PREFIX = 4  # h is crc32(id) % PREFIX, so a base lends PREFIX - 1 turns at most
MAX_NODES = 100_000  # of a family's trie in a task before its nodes are handed on
CHUNK = 1 << 20  # characters of joined ids in one row
ROOT = b"\0" * 16
NODES = "base long, key binary, parent binary, depth long, words long, above long, members array<long>, ends array<long>"


def turns(conversations: DataFrame) -> DataFrame:
    """(base, conv_id, turn, digest, words): what is needed of each row."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    c = F.col("conv_id").cast("long")
    return conversations.filter(c.isNotNull()).select((c - c % FAMILY).alias("base"), c.alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), words.alias("words"))


class _Family:
    """The trie of one family while its turns stream by."""

    def __init__(self, base: int):
        self.base = base
        self.lent: list[tuple[bytes, int]] = []
        self.nodes: dict[bytes, list] = {}
        self.ends: dict[bytes, list] = {}

    def begin(self, conv: int) -> None:
        self.conv, self.seen, self.keep = conv, 0, zlib.crc32(b"%d" % conv) % PREFIX
        self.at, self.depth, self.above = ROOT, 0, 0
        self._node(ROOT, None, 0, 0)
        if conv != self.base:
            for digest, words in self.lent[: self.keep]:
                self._down(digest, words)

    def turn(self, digest: bytes, words: int) -> None:
        if self.conv == self.base:
            if self.seen < PREFIX - 1:
                self.lent.append((digest, words))
            self._down(digest, words)
        elif self.seen >= self.keep:
            self._down(digest, words)
        self.seen += 1

    def end(self) -> None:
        last = self.last
        self.ends.setdefault(self.at, [last[0], last[1], last[2], last[3], []])[4].append(self.conv)

    def _down(self, digest: bytes, words: int) -> None:
        key = hashlib.blake2b(self.at + digest, digest_size=16).digest()
        self.depth += 1
        self._node(key, self.at, words, self.above)
        self.at, self.above = key, self.above + words

    def _node(self, key: bytes, parent: bytes | None, words: int, above: int) -> None:
        self.last = parent, self.depth, words, above
        node = self.nodes.get(key)
        if node is None:
            node = self.nodes[key] = [*self.last, []]
        node[4].append(self.conv)

    def rows(self, done: bool):
        out = [(self.base, k, *v, []) for k, v in self.nodes.items()]
        self.nodes = {}
        if done:
            out += [(self.base, k, *v[:4], [], sorted(v[4])) for k, v in self.ends.items()]
        return out


def _families(batches, limit: int):
    """Turns of whole families, each in order, to the nodes of the families' tries."""
    family, out = None, []

    def batch():
        cols = list(zip(*out))
        out.clear()
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["base", "key", "parent", "depth", "words", "above", "members", "ends"])

    for b in batches:
        for base, conv, digest, words in zip(*(b.column(i).to_pylist() for i in range(4))):
            if family is None or family.base != base:
                if family:
                    family.end()
                    out += family.rows(True)
                family = _Family(base)
                family.begin(conv)
            elif family.conv != conv:
                family.end()
                family.begin(conv)
            family.turn(digest, words)
            if len(family.nodes) >= limit:
                out += family.rows(False)
            if len(out) >= 10_000:
                yield batch()
    if family:
        family.end()
        out += family.rows(True)
    if out:
        yield batch()


def family_nodes(conversations: DataFrame, limit: int = MAX_NODES) -> DataFrame:
    """The nodes of every family's trie, with the members and the ended ids of that family."""
    t = turns(conversations)
    rows = t.repartition(F.col("base")).sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return rows.select("base", "conv_id", "digest", "words").mapInArrow(lambda batches: _families(batches, limit), NODES)


def _chunks(batches, limit: int):
    """Neighbouring pieces of one node's ids joined into longer ones."""
    key, first, parts, size = None, None, [], 0

    def row():
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "first": pa.array([first], pa.int64()), "said": pa.array([",".join(parts)], pa.string())})

    for b in batches:
        for k, f, said in zip(*(b.column(i).to_pylist() for i in range(3))):
            if k != key or size > limit:
                if parts:
                    yield row()
                key, first, parts, size = k, f, [], 0
            parts.append(said)
            size += len(said) + 1
    if parts:
        yield row()


def _digests(batches):
    """Chunks of each node in order to the digest of all its ids."""
    key, sha = None, None

    def row():
        return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": pa.array([sha.hexdigest()], pa.string())})

    for b in batches:
        for k, said in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            if k != key:
                if sha:
                    yield row()
                key, sha = k, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(said.encode())
    if sha:
        yield row()


def end_digests(nodes: DataFrame, limit: int = CHUNK) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end."""
    said = F.array_join(F.col("ends").cast("array<string>"), ",")
    pieces = nodes.filter(F.size("ends") > 0).select("key", F.col("ends")[0].alias("first"), said.alias("said"))
    parts = shuffle_parts(nodes.sparkSession)
    laid = pieces.repartitionByRange(parts, "key", "first").sortWithinPartitions("key", "first")
    chunks = stored(laid.mapInArrow(lambda batches: _chunks(batches, limit), "key binary, first long, said string"), "ends")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def conversation_trie(conversations: DataFrame, max_nodes: int = MAX_NODES, chunk: int = CHUNK) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    own_nodes = stored(family_nodes(conversations, max_nodes), "families")
    merged = own_nodes.groupBy("key").agg(
        F.min(F.array_min("members")).alias("conv_id"),
        F.sum(F.size("members").cast("long")).alias("n_convs"),
        F.sum(F.size("ends").cast("long")).alias("n_ends"),
        *[F.min(c).alias(c) for c in ("parent", "depth", "words", "above")],
    )
    merged = stored(merged, "merged")
    facts = merged.select("key", "conv_id", (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    tagged = stored(own_nodes.filter(F.size("members") > 0).join(facts, "key").select("base", "key", "members", "depth", "above", "conv_id", "leaf"), "tagged")

    # by conversation: the words above what it owns (all, if nothing), and whether it owns a leaf
    owned = tagged.filter(F.array_contains("members", F.col("conv_id"))).select("base", F.col("conv_id").alias("m"), "depth", F.col("above").alias("w"), F.col("leaf").cast("long").alias("leaf"))
    whole = own_nodes.select("base", F.explode("ends").alias("m"), (F.col("depth") + 1).alias("depth"), (F.col("above") + F.col("words")).alias("w"), F.lit(0).cast("long").alias("leaf"))
    each = owned.union(whole).groupBy("base", "m").agg(F.min(F.struct("depth", "w")).alias("top"), F.max("leaf").alias("leaf"))
    facts = each.groupBy("base").agg(F.map_from_entries(F.collect_list(F.struct("m", F.struct(F.col("top.w").alias("w"), "leaf")))).alias("of"))

    def total(field: str):
        return F.aggregate("others", F.lit(0).cast("long"), lambda s, m: s + F.element_at("of", m)[field])

    others = F.filter("members", lambda m: m != F.col("conv_id"))
    part = tagged.join(facts, "base").withColumn("others", others)
    mine = F.coalesce(F.element_at("of", F.when(F.array_contains("members", F.col("conv_id")), F.col("conv_id")))["leaf"], F.lit(0).cast("long"))
    sums = part.select("key", (total("w") - F.size("others") * F.col("above")).alias("saved"), (total("leaf") + mine).alias("leaves")).groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))

    children = merged.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    out = merged.join(sums, "key").join(children, "key", "left").join(end_digests(own_nodes, chunk), "key", "left")
    # every conversation is below the root, whose children would all meet at one key
    root = merged.filter("parent is null").first()
    above = merged.filter("depth > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = stored(out, "nodes")
    deep = out.filter("depth > 1").join(above, "parent")
    flat = out.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root.conv_id if root else None).cast("long")))
    return deep.select(*flat.columns).union(flat).select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def oracle() -> str:
    """DuckDB SQL for the same rows, by comparing every prefix."""
    return f"""
WITH turns AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
lent AS (
  SELECT *, CAST((list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda e, i: xor(e >> 1, CAST(3988292384 AS BIGINT) * (e & 1)))) & 3) AS INT) AS low
  FROM turns),
rebuilt AS (
  SELECT a.conv_id, coalesce(b.own[1:3 - a.low], []) || a.own[4 - a.low:] AS seq
  FROM lent a LEFT JOIN turns b ON b.conv_id = a.conv_id - a.conv_id % {FAMILY}),
steps AS (
  SELECT conv_id, len(seq) AS size, unnest(range(0, len(seq) + 1)) AS depth, seq FROM rebuilt),
paths AS (
  SELECT conv_id, depth, depth = size AS ended, sha256(CAST(to_json(seq[1:depth]) AS VARCHAR)) AS key,
    CASE WHEN depth > 0 THEN sha256(CAST(to_json(seq[1:depth - 1]) AS VARCHAR)) END AS parent,
    CASE WHEN depth > 0 THEN len(regexp_extract_all(seq[depth].t, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words
  FROM steps),
nodes AS (
  SELECT key, min(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
  FROM paths GROUP BY key),
kids AS (SELECT parent AS key, count(*) AS n FROM nodes GROUP BY parent),
below AS (
  SELECT DISTINCT a.key AS top, b.key FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
sums AS (
  SELECT b.top AS key, sum((n.n_convs - 1) * n.words) AS saved, count(*) FILTER (k.n IS NULL) AS leaves
  FROM below b JOIN nodes n ON n.key = b.key LEFT JOIN kids k ON k.key = b.key GROUP BY b.top)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.key = n.key LEFT JOIN kids k ON k.key = n.key LEFT JOIN nodes p ON p.key = n.parent"""
