"""A Merkle manifest of a table: one digest for all rows, and for each row the proof that it is part of it.

Rows are leaves. The leaves of a group, in order, are a tree, and the roots of the groups are the leaves of
one more tree. A fragment is a sparse forest: some nodes, keyed by tree, level and index, whose parents cannot
be told yet. The sizes of all trees are known, so it is known how many nodes each run of siblings has, also the
last one of a level. Whenever a run is complete, its parent takes its place. Merging forests is associative and
commutative, so partitions, rounds and retries may come in any order and give the same nodes.

Leaves in order are cut into fragments as they are read, so of each only about two nodes a level are left. Fragments
that lie side by side are merged in rounds, ``FAN`` of them in a task, until one round can hold all that is left;
that round's nodes, at most some thousands, give the root by ``treeReduce``. Every round keeps which siblings a node met and
under which node it ended. Read downwards from the last round, these tables give each row its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: The tree over the roots of the groups.
TOP = -1
#: Leaves under the nodes that a task of the first round meets, and by how much that grows from round to round.
WIDTH, FAN = 1 << 20, 64
#: Rows of a fragment.
ROWS = 1 << 13
#: What a task tells of a node: its siblings' digests, the root of its group if it got there, and the node that it ended under. Of a node
#: ``at`` is the place of its first leaf in the whole table, and ``size`` the number of leaves of its tree.
CLIMBED = "path binary, subroot binary, top_tree long, top_level int, top_i long, top_digest binary, top_at long, top_size long"
CLIMBED_NAMES = [c.split()[0] for c in CLIMBED.split(", ")]
CLIMBED_TYPES = [pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
Key = tuple[int, int, int]
TOPS = ["tree", "level", "i", "digest", "at", "size"]


def field(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two rows give one text; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def node(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


@cache
def height(size: int, arity: int) -> int:
    """Levels above the leaves of a tree of ``size`` leaves; a lone leaf is its own root."""
    n = 0
    while size > 1:
        size, n = -(-size // arity), n + 1
    return n


def run(size: int, level: int, i: int, arity: int) -> range:
    """The indices of a node and its siblings."""
    n = -(-size // arity**level)
    return range(i - i % arity, min(i - i % arity + arity, n))


class Forest:
    """Nodes without a parent, by tree, level and index.

    ``up`` has for every child that got a parent the parent's key and the other children's digests; ``roots`` the root of every
    group that got into the upper tree.
    """

    def __init__(self, groups: int, arity: int) -> None:
        self.groups, self.arity = groups, arity
        self.nodes: dict[Key, tuple[bytes, int, int]] = {}
        self.up: dict[Key, tuple[Key, bytes]] = {}
        self.roots: dict[int, bytes] = {}

    def add(self, tree: int, level: int, i: int, digest: bytes, at: int, size: int) -> None:
        """Adds a node and all parents that this completes. A node that is there already changes nothing."""
        nodes = self.nodes
        while (tree, level, i) not in nodes and (tree, level, i) not in self.up:
            nodes[tree, level, i] = digest, at, size
            if level == height(size, self.arity):
                if tree == TOP:
                    return
                del nodes[tree, level, i]
                self.up[tree, level, i], self.roots[tree] = ((TOP, 0, tree), b""), digest
                tree, level, i, size = TOP, 0, tree, self.groups
                continue
            keys = [(tree, level, j) for j in run(size, level, i, self.arity)]
            if not all(k in nodes for k in keys):
                return
            found = [nodes.pop(k) for k in keys]
            digests, at = [d for d, _, _ in found], found[0][1]
            level, i = level + 1, i // self.arity
            for j, k in enumerate(keys):
                self.up[k] = (tree, level, i), b"".join(digests[:j] + digests[j + 1 :])
            digest = node(digests)

    def merge(self, other: Forest) -> Forest:
        for key, (digest, at, size) in other.nodes.items():
            self.add(*key, digest, at, size)
        return self

    def climb(self, key: Key, known: dict[Key, tuple[bytes, Key]]) -> tuple[bytes, Key]:
        """The siblings' digests from a node to the one without a parent that it is under, and that one's key."""
        if key in self.nodes:
            return b"", key
        if key not in known:
            above, others = self.up[key]
            path, top = self.climb(above, known)
            known[key] = others + path, top
        return known[key]

    def climbed(self, keys: list[Key]) -> list[pa.Array]:
        """For each node what :data:`CLIMBED` says."""
        known: dict[Key, tuple[bytes, Key]] = {}
        rows = []
        for key in keys:
            path, top = self.climb(key, known)
            rows.append((path, self.roots.get(key[0]), *top, *self.nodes[top]))
        columns = list(zip(*rows)) or [[]] * len(CLIMBED_TYPES)
        return [pa.array(c, t) for c, t in zip(columns, CLIMBED_TYPES)]


def ordered(leaves: DataFrame, group: str, by: list[str], scratch: Scratch) -> tuple[DataFrame, int, int]:
    """``leaves`` with their ``tree`` (the group's place, nulls first), ``i`` in it, its ``size``, and ``at``, their place in all; rows and groups in all.

    Rows are sorted in ranges, which rows that are alike in all of ``by`` don't hold together, and numbered behind the ranges before them.
    """
    n = leaves.count()
    shuffled = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-n // (1 << 21)), min(-(-n // (1 << 13)), shuffled), 1)
    order = [group, *by, "_tie"]
    # Rows that are alike may stand in any order, as they are the same leaf.
    tied = leaves.withColumn("_tie", F.monotonically_increasing_id())
    d = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_tie")
    row = F.monotonically_increasing_id()
    d = scratch.table(d.withColumns({"_part": F.shiftright(row, 33), "_row": row.bitwiseAND(F.lit((1 << 33) - 1))}), "ordered")
    runs = d.groupBy("_part", group).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    # A group has one row a range here, and so has the table of ranges, so that one task can add them up.
    here = Window.partitionBy(group).orderBy("_part")
    before = F.coalesce(F.sum("_n").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumns({"_before": before, "size": F.sum("_n").over(Window.partitionBy(group)), "_new": F.when(F.row_number().over(here) == 1, 1).otherwise(0)})
    runs = scratch.table(runs, "runs")
    sofar = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = runs.groupBy("_part").agg(F.sum("_n").alias("_rows"), F.sum("_new").alias("_groups"))
    ranges = ranges.select("_part", *[F.coalesce(F.sum(c).over(sofar), F.lit(0)).alias(to) for c, to in (("_rows", "_at"), ("_groups", "_trees"))])
    place = F.sum("_new").over(Window.partitionBy("_part").orderBy("_first")) - 1
    runs = runs.withColumn("_place", place).join(ranges, "_part")
    runs = runs.select("_part", F.col(group).alias("_group"), "_first", "_before", "size", "_at", (F.col("_trees") + F.col("_place")).alias("tree"))
    found = d.join(runs, (d["_part"] == runs["_part"]) & d[group].eqNullSafe(runs["_group"])).drop(runs["_part"])
    i, at = F.col("_row") - F.col("_first") + F.col("_before"), F.col("_at") + F.col("_row")
    found = found.withColumns({"i": i, "at": at}).select(*leaves.columns, "tree", "i", "size", "at")
    # In order also where the join dealt the rows anew, so that fragments hold neighbours.
    return found.sortWithinPartitions("at"), n, runs.agg(F.max("tree")).first()[0] + 1 if n else 0


def _leaves(groups: int, arity: int, rows: int, keep: list[str]):
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                forest = Forest(groups, arity)
                tree, i, digest, at, size = (b[c].to_pylist() for c in ("tree", "i", "leaf", "at", "size"))
                for row in zip(tree, [0] * len(tree), i, digest, at, size):
                    forest.add(*row)
                names = [*keep, *CLIMBED_NAMES]
                yield pa.RecordBatch.from_arrays([b[c] for c in keep] + forest.climbed([(t, 0, k) for t, k in zip(tree, i)]), names)

    return climb


def _merged(groups: int, arity: int):
    def climb(batches: pa.Table) -> pa.Table:
        forest, rows = Forest(groups, arity), batches.select(TOPS).to_pylist()
        for r in rows:
            forest.add(*r.values())
        found = forest.climbed([(r["tree"], r["level"], r["i"]) for r in rows])
        return pa.table([batches[c] for c in TOPS[:3]] + found, names=TOPS[:3] + CLIMBED_NAMES)

    return climb


def _fragment(groups: int, arity: int):
    def gather(rows: Iterator) -> Iterator[Forest]:
        forest = Forest(groups, arity)
        for r in rows:
            forest.add(*r)
        # What is known of the nodes below is not asked for here.
        forest.up.clear()
        yield forest

    return gather


def tops(climbed: DataFrame) -> DataFrame:
    """The nodes that rows ended under, one row each."""
    return climbed.select(*[F.col(f"top_{c}").alias(c) for c in TOPS]).distinct()


def prove(leaves: DataFrame, group: str, by: list[str], arity: int = 2, width: int = WIDTH, fan: int = FAN, rows: int = ROWS) -> tuple[DataFrame, bytes | None]:
    """``leaves`` with ``tree``, ``i``, ``size``, ``groups``, ``subroot`` and ``path``, and the root of all (None for no rows).

    ``leaves`` has ``leaf``, a digest. Within each ``group`` the leaves stand in order of ``by``, nulls first, and groups by their value, a null
    first, strings by bytes. ``path`` has the digests of a leaf's siblings, level by level up to the root of all, left to right.
    The parameters don't change results, only how much a task meets.
    """
    spark, scratch = leaves.sparkSession, Scratch(leaves.sparkSession, "merkle")
    found, n, groups = ordered(leaves, group, by, scratch)
    keep = [c for c in leaves.columns if c != group] + ["tree", "i", "size"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(keep).schema)
    climbed = scratch.table(found.mapInArrow(_leaves(groups, arity, rows, keep), f"{types}, {CLIMBED}"), "leaves")
    if not n:
        return climbed.select(*keep, F.lit(groups).cast("long").alias("groups"), "subroot", "path"), None
    rounds, nodes = [], scratch.table(tops(climbed), "nodes")
    while True:
        one = nodes.groupBy(F.floor(F.col("at") / width).alias("_task")).applyInArrow(_merged(groups, arity), f"tree long, level int, i long, {CLIMBED}")
        rounds.append(scratch.table(one, "round"))
        if width >= n:
            break
        width, nodes = width * fan, scratch.table(tops(rounds[-1]), "nodes")
    whole = nodes.select(TOPS).rdd.mapPartitions(_fragment(groups, arity)).treeReduce(Forest.merge)
    ((root, _, _),) = whole.nodes.values()
    above = None
    for r in reversed(rounds):
        here = r.select(*[F.col(c).alias(f"_{c}") for c in TOPS[:3]], F.col("path").alias("_path"), F.col("subroot").alias("_subroot"), *[f"top_{c}" for c in TOPS[:3]])
        if above is not None:
            here = _upwards(here, above)
        above = scratch.table(here.select(*[F.col(f"_{c}").alias(f"top_{c}") for c in TOPS[:3]], F.col("_path").alias("more"), F.col("_subroot").alias("later")), "above")
    rows_up = climbed.select(*keep, F.col("path").alias("_path"), F.col("subroot").alias("_subroot"), *[f"top_{c}" for c in TOPS[:3]])
    out = _upwards(rows_up, above)
    return out.select(*keep, F.lit(groups).cast("long").alias("groups"), F.col("_subroot").alias("subroot"), F.col("_path").alias("path")), root


def _upwards(rows: DataFrame, above: DataFrame) -> DataFrame:
    """``rows`` with what their uppermost nodes' rows in ``above`` add. Few nodes; Spark broadcasts them as long as they are small."""
    d = rows.join(above, [f"top_{c}" for c in TOPS[:3]])
    return d.withColumns({"_path": F.concat("_path", "more"), "_subroot": F.coalesce("_subroot", "later")}).drop("more", "later")


def fold(leaf: bytes, path: bytes, tree: int, i: int, size: int, groups: int, arity: int = 2) -> bytes:
    """The root that follows from a leaf, its place and its siblings' digests."""
    at, digest = 0, leaf
    for size, i in ((size, i), (groups, tree)):
        for level in range(height(size, arity)):
            own = run(size, level, i, arity)
            others = [path[at + 32 * k : at + 32 * k + 32] for k in range(len(own) - 1)]
            at += 32 * len(others)
            k = i - own[0]
            digest, i = node([*others[:k], digest, *others[k:]]), i // arity
    return digest


def _verified(arity: int, keep: list[str]):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b[c].to_pylist() for c in ("claimed", "path", "tree", "i", "size", "groups")]
            folded = [fold(*row, arity) for row in zip(*columns)]
            proof = [hashlib.sha256(p.hex().encode()).digest() for p in columns[1]]
            yield pa.RecordBatch.from_arrays([b[c] for c in keep] + [pa.array(proof, pa.binary()), pa.array(folded, pa.binary())], [*keep, "proof", "folded"])

    return check


#: What op13 hashes of a row, in this order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(docs: DataFrame, arity: int = 2, **how: int) -> DataFrame:
    """For each row of ``documents`` its leaf, the root of its language and of all, the digest of its proof, and whether what is claimed of it holds.

    Where 7 divides the CRC-32 of the doc_id in decimal, one character too many is claimed. Rows: doc_id, lang, leaf, subroot, root, proof_sha256,
    folded_root, verified; digests in lower-case hex. Rows that repeat each get their row; those of one doc_id stand in order of their leaves,
    null doc_ids first. A null doc_id is never tampered with, and a null n_chars stays. An empty table has no rows. Other columns are not read.
    """
    values = [F.col(c) for c in FIELDS]
    # As a decimal the largest number can grow too.
    more = [F.col(c) if c != "n_chars" else F.col(c).cast("decimal(20,0)") + 1 for c in FIELDS]
    bent = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 0, F.lit(False))
    scratch = Scratch(docs.sparkSession, "leaves")
    leaves = scratch.table(docs.select("doc_id", "lang", leaf(values).alias("leaf"), F.when(bent, leaf(more)).alias("bent")), "leaves")
    found, root = prove(leaves.withColumn("own_lang", F.col("lang")), "lang", ["doc_id", "leaf"], arity, **how)
    keep = ["doc_id", "own_lang", "leaf", "subroot"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(keep).schema)
    found = found.withColumn("claimed", F.coalesce("bent", "leaf"))
    found = found.mapInArrow(_verified(arity, keep), f"{types}, proof binary, folded binary")
    text = lambda c: F.lower(F.hex(c))
    whole = F.lit(root.hex() if root else None).cast("string")
    out = found.select("doc_id", F.col("own_lang").alias("lang"), text("leaf").alias("leaf"), text("subroot").alias("subroot"), whole.alias("root"), text("proof").alias("proof_sha256"), text("folded").alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
