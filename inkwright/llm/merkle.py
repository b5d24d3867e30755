"""Operator 12, a Merkle manifest of a dataset by merging sparse forests."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from hashlib import sha256
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialize
from .ranges import plan_ranges

#: Leaves of a first fragment, and fragments that one task merges. A fragment of consecutive leaves
#: holds some 2 * arity * log(leaves) unresolved nodes, whatever it stands for.
CHUNK, FAN = 2048, 64
#: Rows in a range of the order.
RANGE_ROWS = 1_000_000
#: The tree over the subroots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Node(NamedTuple):
    """A node's place: its tree (the number of the group, or TOP), level from the leaves, index in the level."""

    tree: int
    level: int
    index: int


def width(leaves: int, level: int, arity: int) -> int:
    """Nodes of a level: known from the number of leaves alone, so that a run's arity is known too."""
    for _ in range(level):
        leaves = -(-leaves // arity)
    return leaves


@dataclass
class Forest:
    """Unresolved nodes of a sparse forest, a monoid under ``merge``.

    nodes: hash of each node whose run of siblings isn't complete. sizes: leaves of each tree met,
    TOP included. As soon as all siblings of a run are there, their parent takes their place; the
    last node of a group's tree becomes a leaf of TOP. Merging is associative and commutative, and
    the empty forest is neutral. parents: if kept, the parent of each node resolved here.
    """

    arity: int = 2
    nodes: dict[Node, str] = field(default_factory=dict)
    sizes: dict[int, int] = field(default_factory=dict)
    parents: dict[Node, Node] | None = None
    seen: dict[Node, str] | None = None
    widths: dict[tuple[int, int], int] = field(default_factory=dict)

    def width(self, tree: int, level: int) -> int:
        key = self.sizes[tree], level
        if key not in self.widths:
            self.widths[key] = width(*key, self.arity)
        return self.widths[key]

    def run(self, node: Node) -> range:
        """Indexes of the node and its siblings."""
        first = node.index - node.index % self.arity
        return range(first, min(first + self.arity, self.width(node.tree, node.level)))

    def up(self, node: Node) -> Node | None:
        """The place of the parent; None for the root."""
        if self.width(node.tree, node.level) > 1:
            return Node(node.tree, node.level + 1, node.index // self.arity)
        return None if node.tree == TOP else Node(TOP, 0, node.tree)

    def add(self, node: Node, value: str) -> None:
        while True:
            self.nodes[node] = value
            if self.seen is not None:
                self.seen[node] = value
            parent = self.up(node)
            if parent is None:
                return
            if parent.tree == node.tree:
                siblings = [Node(node.tree, node.level, i) for i in self.run(node)]
                if not all(s in self.nodes for s in siblings):
                    return
                value = digest_of(self.nodes.pop(s) for s in siblings)
            else:  # a subroot is its group's leaf in TOP, with the same hash
                siblings = [node]
                del self.nodes[node]
            if self.parents is not None:
                self.parents |= dict.fromkeys(siblings, parent)
            node = parent

    def merge(self, other: Forest) -> Forest:
        out = Forest(self.arity, dict(self.nodes), self.sizes | other.sizes, widths=self.widths)
        for node, value in other.nodes.items():
            out.add(node, value)
        return out


class Way(NamedTuple):
    """From a node to the root: siblings' hashes in order, and the hash of the group's subroot once it is passed."""

    proof: str
    subroot: str | None


def ways(forest: Forest, nodes: Iterable[Node], outer: dict[Node, Way]) -> dict[Node, Way]:
    """The way of each node, for a forest that kept parents and all hashes seen; outer: of its unresolved nodes."""
    known = dict(outer)

    def way(node: Node) -> Way:
        path = []
        while node not in known:
            path.append(node)
            node = forest.parents[node]
        for n in reversed(path):
            above, parent = known[node], node
            if parent.tree == n.tree:
                proof = "".join(forest.seen[Node(n.tree, n.level, i)] for i in forest.run(n) if i != n.index)
                known[n] = Way(proof + above.proof, above.subroot)
            else:
                known[n] = Way(above.proof, forest.seen[n])
            node = n
        return known[node]

    return {n: way(n) for n in nodes}


def fold(leaf: str, tree: int, index: int, leaves: int, trees: int, proof: str, arity: int = 2) -> str:
    """The root that a leaf and the hashes of its siblings give, by its place alone."""
    at, value = 0, leaf
    for size, i in ((leaves, index), (trees, tree)):
        while size > 1:
            k = i % arity
            n = min(arity, size - (i - k))
            siblings = [proof[at + 64 * j : at + 64 * (j + 1)] for j in range(n - 1)]
            at += 64 * (n - 1)
            value = digest_of([*siblings[:k], value, *siblings[k:]])
            i, size = i // arity, -(-size // arity)
    return value


def fold_all(shown: Iterable[str], places: Iterable[Node], leaves: Iterable[int], trees: int, proofs: Iterable[str], arity: int = 2) -> list[str]:
    """The root that each shown leaf gives with its own proof. No leaf is taken on trust, so that a wrong
    proof fails for a row that nobody tampered with, too."""
    return [fold(v, p.tree, p.index, n, trees, w, arity) for v, p, n, w in zip(shown, places, leaves, proofs)]


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 in lower-case hex of the fields: "-" for null, else UTF-8 bytes, ":" and the value."""
    shown = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in shown]).cast("binary"), 256)


NODE = "tree int, level int, index bigint, leaves bigint, trees bigint, hash string"


def _trees(df: DataFrame, group: str) -> DataFrame:
    """Number, first row and rows of each group in the order of the groups; groups may be many."""
    plan = plan_ranges(df.withColumn("__one", F.lit(1).cast("long")), [group], "__one", RANGE_ROWS)
    return plan.prefix(df.withColumn("__one", F.lit(1).cast("long")), "__before", "tree").withColumn("tree", F.col("tree").cast("int")).drop("__rid", "__one", "__before")


def prove(df: DataFrame, leaf: Column, claim: Column | None = None, key: str = "doc_id", group: str = "lang", arity: int = 2, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """key, leaf, subroot, root, proof, folded_root for every row of df.

    leaf: a row's hash, in hex. The leaves of a group stand in ascending order of the key (nulls
    first; rows of one key by leaf, then by place); while several nodes remain, each ``arity``
    consecutive ones become their digest. The subroots, in ascending order of the group (null first,
    by code point), give the root in the same way. proof: the hashes of the other members of a
    node's run, level by level up to the root, from left to right. folded_root: the root that the
    row's ``claim`` (another hash; null or absent: the leaf) gives with its proof.

    Consecutive leaves form fragments, each a Forest of unresolved nodes; fragments are merged
    ``fan`` at a time, until one forest with the root alone is left. The way back down gives every
    fragment the proofs of its unresolved nodes. Groups are cut like all other rows, so a hot group
    or key is as many fragments as any rows of that number; no task holds more than ``chunk`` leaves
    or ``fan`` fragments, and only the root reaches the driver. An empty table gives no rows. Very
    long texts are hashed where they are read; only hashes move. Extra columns play no part. df is
    read once.
    """
    rows = materialize(df.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("leaf"), (F.lit(None).cast("string") if claim is None else claim).alias("claim"), F.monotonically_increasing_id().alias("i"), F.lit(1).cast("long").alias("one")), "merkle-rows")
    order = ["group", "key", "leaf", "i"]
    plan = plan_ranges(rows, order, "one", RANGE_ROWS, min_ranges=32)
    placed = materialize(plan.prefix(rows, "before", "at").drop("before", "__rid", "one", "i"), "merkle-placed")
    groups = placed.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("leaves"))
    groups = materialize(_trees(groups, "group"), "merkle-groups")
    trees = groups.count()
    of = groups.withColumnRenamed("group", "g")
    leaves = placed.join(of, F.col("group").eqNullSafe(F.col("g"))).select("key", "leaf", "claim", "tree", (F.col("at") - F.col("first")).alias("index"), "leaves", F.floor(F.col("at") / chunk).alias("part"))
    leaves = materialize(leaves, "merkle-leaves")

    def forest_of(tables, keep: bool = False) -> tuple[Forest, list[Node]]:
        forest = Forest(arity, sizes={TOP: trees}, parents={} if keep else None, seen={} if keep else None)
        places = []
        for t in tables:
            cols = [t.column(c).to_pylist() for c in ("tree", "level", "index", "leaves", "hash")]
            for tree, level, index, n, value in zip(*cols):
                if tree != TOP:
                    forest.sizes[tree] = n
                places.append(Node(tree, level, index))
                forest.add(places[-1], value)
        return forest, places

    def merge_group(group_key, table):
        import pyarrow as pa

        forest, _ = forest_of([table])
        out = [(group_key[0].as_py(), n.tree, n.level, n.index, forest.sizes[n.tree], h) for n, h in forest.nodes.items()]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("part", "tree", "level", "index", "leaves", "hash"), zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()))})

    fragment = "part bigint, tree int, level int, index bigint, leaves bigint, hash string"
    as_nodes = leaves.select("part", "tree", F.lit(0).alias("level"), "index", "leaves", F.col("leaf").alias("hash"))
    up = [materialize(as_nodes.groupBy("part").applyInArrow(merge_group, fragment), "merkle-up")]
    while up[-1].agg(F.max("part")).first()[0]:
        wider = up[-1].withColumn("part", F.floor(F.col("part") / fan))
        up.append(materialize(wider.groupBy("part").applyInArrow(merge_group, fragment), "merkle-up"))
    top = up[-1].select("hash").first()
    root = top[0] if top else None

    def outer_of(table) -> dict[Node, Way]:
        cols = [table.column(c).to_pylist() for c in ("tree", "level", "index", "proof", "subroot")]
        return {Node(*x[:3]): Way(*x[3:]) for x in zip(*cols)}

    def descend(inner, outer):
        import pyarrow as pa

        forest, places = forest_of([inner], keep=True)
        found = ways(forest, places, outer_of(outer))
        parts = inner.column("part")
        proofs, subroots = ([found[p][k] for p in places] for k in (0, 1))
        return pa.table({"part": parts, "tree": inner.column("tree"), "level": inner.column("level"), "index": inner.column("index"), "proof": pa.array(proofs, pa.string()), "subroot": pa.array(subroots, pa.string())})

    way = "part bigint, tree int, level int, index bigint, proof string, subroot string"
    down = up[-1].select("part", "tree", "level", "index", F.lit("").alias("proof"), F.lit(None).cast("string").alias("subroot"))
    for lower in reversed(up[:-1]):
        wider = lower.withColumn("wide", F.floor(F.col("part") / fan))
        down = materialize(wider.groupBy("wide").cogroup(down.groupBy("part")).applyInArrow(descend, way), "merkle-down")

    def finish(inner, outer):
        import pyarrow as pa
        import pyarrow.compute as pc

        named = inner.append_column("level", pa.array([0] * len(inner), pa.int32())).append_column("hash", inner.column("leaf"))
        forest, places = forest_of([named], keep=True)
        found = ways(forest, places, outer_of(outer))
        proofs, subroots = ([found[p][k] for p in places] for k in (0, 1))
        shown = pc.coalesce(inner.column("claim"), inner.column("leaf")).to_pylist()
        folded = fold_all(shown, places, inner.column("leaves").to_pylist(), trees, proofs, arity)
        return pa.table({"key": inner.column("key"), "leaf": inner.column("leaf"), "subroot": pa.array(subroots, pa.string()), "root": pa.array([root] * len(inner), pa.string()), "proof": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string())})

    kind = dict(leaves.dtypes)["key"]
    out = leaves.groupBy("part").cogroup(down.groupBy("part")).applyInArrow(finish, f"key {kind}, leaf string, subroot string, root string, proof string, folded_root string")
    drop_scratch(rows, placed, groups)
    return out.withColumnRenamed("key", key)


def digest(df: DataFrame, key: str = "doc_id", arity: int = 2) -> DataFrame:
    """The manifest of documents, checked against a copy in which some rows' n_chars are one more.

    Where 7 divides the CRC-32 of the decimal key, the copy differs, unless n_chars is null. A null
    key, or a null in any other field, is hashed as "-".
    """
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % 7 == 0
    cols = {f: F.col(f) for f in FIELDS}
    changed = leaf_hash(*(cols | {"n_chars": F.col("n_chars") + 1}).values())
    claim = F.when(hit & F.col("n_chars").isNotNull(), changed)
    found = prove(df, leaf_hash(*cols.values()), claim, key, arity=arity)
    return found.select(key, "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_H = " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in FIELDS)
_T = _H.replace("n_chars", "(n_chars + bump)")
#: Levels are folded one by one; a node carries its group's number and the level's width.
ORACLE_SQL = f"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
marked AS (SELECT *, CASE WHEN xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 7 = 0 THEN 1 ELSE 0 END AS bump FROM documents, crc_table),
rows_ AS (SELECT doc_id, lang, sha256({_H}) AS leaf, sha256({_T}) AS claim FROM marked),
langs AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM rows_ GROUP BY lang),
leaves AS (SELECT r.doc_id, r.leaf, r.claim, l.tree, l.n, row_number() OVER (PARTITION BY l.tree ORDER BY r.doc_id NULLS FIRST, r.leaf) - 1 AS i FROM rows_ r JOIN langs l ON r.lang IS NOT DISTINCT FROM l.lang),
nodes AS (SELECT tree, 0 AS level, i, n, leaf AS h FROM leaves
 UNION ALL SELECT tree, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY tree, level, i // 2),
subroots AS (SELECT tree, h AS subroot, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, tree AS i, n, subroot AS h FROM subroots
 UNION ALL SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2),
root AS (SELECT h AS root FROM tops WHERE n = 1),
steps AS (SELECT l.tree, l.i AS leaf_at, n.level, n.h, n.i % 2 AS right_ FROM leaves l JOIN nodes n ON n.tree = l.tree AND n.n > 1 AND n.i = xor(l.i >> n.level, 1)
 UNION ALL SELECT l.tree, l.i, 100 + t.level, t.h, t.i % 2 FROM leaves l JOIN tops t ON t.n > 1 AND t.i = xor(l.tree >> t.level, 1)),
proofs AS (SELECT tree, leaf_at, string_agg(h, '' ORDER BY level) AS proof FROM steps GROUP BY tree, leaf_at),
levels AS (SELECT l.tree, l.i AS leaf_at, n.level, s.h, s.right_ FROM leaves l JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) n ON n.tree = l.tree LEFT JOIN steps s ON s.tree = l.tree AND s.leaf_at = l.i AND s.level = n.level
 UNION ALL SELECT l.tree, l.i, 100 + n.level, s.h, s.right_ FROM leaves l CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) n LEFT JOIN steps s ON s.tree = l.tree AND s.leaf_at = l.i AND s.level = 100 + n.level),
folds AS (SELECT tree, leaf_at, list_reduce(list_concat([{{'h': any_value(claim), 'r': 0::BIGINT}}], list({{'h': coalesce(h, ''), 'r': coalesce(right_, 1)::BIGINT}} ORDER BY level) FILTER (WHERE level IS NOT NULL)), lambda a, b: {{'h': sha256(CASE WHEN b.r = 1 THEN a.h || b.h ELSE b.h || a.h END), 'r': 0::BIGINT}}).h AS folded_root
 FROM (SELECT l.tree, l.i AS leaf_at, l.claim, v.level, v.h, v.right_ FROM leaves l LEFT JOIN levels v ON v.tree = l.tree AND v.leaf_at = l.i) GROUP BY tree, leaf_at)
SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.folded_root, f.folded_root = root.root AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree CROSS JOIN root LEFT JOIN proofs p ON p.tree = l.tree AND p.leaf_at = l.i JOIN folds f ON f.tree = l.tree AND f.leaf_at = l.i
"""
