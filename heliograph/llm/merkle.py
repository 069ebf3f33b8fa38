"""A Merkle manifest of a dataset: leaf digests of rows, one tree per group, one tree over the groups, and proofs.

All trees are built by one associative operation on sparse forests.  A fragment of a tree
holds digests keyed by (level, index).  As the number of a tree's leaves is known, so is
the number of children of every node: three, or fewer for the last one of a level.  Merging
fragments unites their nodes, and whenever all children of a node are there, the node takes
their place.  Tasks make a fragment of the leaves they read, in whatever order those come,
and a tree reduction merges ``FAN`` fragments at a time until none is left open; what is
open of contiguous leaves is a few nodes a level.

Leaves are numbered by ranges (``operators.ranks``), so no task holds a group.  For the
proofs they are dealt in slices of 3**``levels`` consecutive leaves, each of which is the
subtree of one node; the nodes from that level up come out of the reduction as a table,
and every slice is joined with the few of them that its proofs pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliograph.llm.tables import read, tidy
from heliograph.operators.ranks import numbered
from heliograph.storage import Scratch, join_checked

ARITY = 3
#: Slices are by default subtrees of so many levels: 3**8 = 6,561 leaves.
SLICE = 8
#: So many fragments are merged at a time.
FAN = 16


def hashed(digests: Sequence[bytes]) -> bytes:
    """The digest of digests, which are concatenated as lowercase hex."""
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def width(n: int, level: int) -> int:
    """The number of nodes on a level of a tree of n leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


def depth(n: int) -> int:
    """The level of the root of a tree of n leaves: a lone leaf is a root."""
    level = 0
    while n > 1:
        n, level = -(-n // ARITY), level + 1
    return level


class Forest:
    """A fragment of one tree: the digests of nodes whose parent isn't complete yet."""

    def __init__(self, n: int, note: int):
        self.widths, self.note = [n], note
        while n > 1:
            n = -(-n // ARITY)
            self.widths.append(n)
        self.open: dict[tuple[int, int], bytes] = {}
        self.closed: list[tuple[int, int, bytes]] = []  # nodes from level ``note`` up that a parent has replaced

    def add(self, level: int, index: int, digest: bytes) -> None:
        """Put a node in; every run of siblings that becomes complete turns into its parent."""
        self.open[level, index] = digest
        while level + 1 < len(self.widths):
            first = index - index % ARITY
            run = [(level, i) for i in range(first, min(first + ARITY, self.widths[level]))]
            if not all(r in self.open for r in run):
                return
            digests = [self.open.pop(r) for r in run]
            if level >= self.note:
                self.closed += [(*r, d) for r, d in zip(run, digests, strict=True)]
            level, index = level + 1, index // ARITY
            self.open[level, index] = hashed(digests)

    @property
    def whole(self) -> bool:
        return (len(self.widths) - 1, 0) in self.open


_NODE = "tree string, n long, fragment long, level int, idx long, digest binary, live boolean"


def _rows(forests: dict[tuple[str, int], Forest], fragment: int) -> pa.RecordBatch:
    """Nodes as rows; those still to be merged are live."""
    out = [(*key, fragment, *at, d, not f.whole) for key, f in forests.items() for at, d in f.open.items()]
    out += [(*key, fragment, level, i, d, False) for key, f in forests.items() for level, i, d in f.closed]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_()]
    cols = zip(*out, strict=True) if out else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["tree", "n", "fragment", "level", "idx", "digest", "live"])


def _planted(note: int):
    """A fragment of the leaves (tree, n, rank, digest) that a task reads; whole trees leave it at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fragment, forests = context.partitionId() if context else 0, {}
        for batch in batches:
            done = {}
            for tree, n, rank, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                forest = forests.get((tree, n)) or forests.setdefault((tree, n), Forest(n, note))
                forest.add(0, rank, digest)
                if forest.whole:
                    done[tree, n] = forests.pop((tree, n))
            if done:
                yield _rows(done, fragment)
        yield _rows(forests, fragment)

    return run


def _merged(note: int):
    """One fragment of up to FAN fragments of a tree."""

    def run(group: pa.Table) -> pa.Table:
        tree, n, fragment = (group[c][0].as_py() for c in ("tree", "n", "fragment"))
        forest = Forest(n, note)
        for level, i, digest in zip(*(group[c].to_pylist() for c in ("level", "idx", "digest")), strict=True):
            forest.add(level, i, digest)
        return pa.Table.from_batches([_rows({(tree, n): forest}, fragment)])

    return run


def grown(leaves: DataFrame, scratch: Scratch, name: str, note: int = SLICE) -> DataFrame:
    """(tree, n, level, idx, digest): every tree's root and all nodes from level ``note`` up, of leaves (tree, n, rank, digest)."""
    nodes = scratch.table(leaves.select("tree", "n", "rank", "digest").mapInArrow(tidy(_planted(note)), _NODE), f"{name}0")
    rounds = [nodes]
    while (last := rounds[-1].where("live").agg(F.max("fragment")).first()[0]) is not None:
        if last == 0 and len(rounds) > 1:
            raise ValueError("the leaves of a tree are not numbered from 0 without a gap")
        live = rounds[-1].where("live").withColumn("fragment", F.floor(F.col("fragment") / FAN).cast("long"))
        merged = live.select("tree", "n", "fragment", "level", "idx", "digest").groupBy("tree", "n", "fragment").applyInArrow(_merged(note), _NODE)
        rounds.append(scratch.table(merged, f"{name}{len(rounds)}"))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.where("not live").select("tree", "n", "level", "idx", "digest")


def _levels(n: Column) -> Column:
    """``depth`` of n as an expression."""
    return sum(((n > F.lit(ARITY**k)).cast("int") for k in range(39)), F.lit(0))


def _roots(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("level") == _levels(F.col("n"))).select("tree", F.col("digest").alias("subroot"))


def _proofs(n: int, base: int, digests: list[bytes], above: dict[tuple[int, int], bytes], slice_levels: int) -> Iterator[bytes]:
    """The siblings of each leaf of a slice, level by level up to the tree's root, concatenated."""
    top, levels = depth(n), [digests]
    low = min(slice_levels, top)
    for _ in range(low):
        row = levels[-1]
        levels.append([hashed(row[i : i + ARITY]) for i in range(0, len(row), ARITY)])
    index, higher = base // ARITY**slice_levels, []
    for level in range(slice_levels, top):  # on these levels the slice is one node
        first = index - index % ARITY
        higher += [above[level, i] for i in range(first, min(first + ARITY, width(n, level))) if i != index]
        index //= ARITY
    tail = b"".join(higher)
    held: list[tuple[int, bytes]] = [(-1, b"")] * low

    def upward(level: int, i: int) -> bytes:
        """From a node on ``level`` up; a node's is kept for its neighbours."""
        if level >= low:
            return tail
        if held[level][0] != i:
            first = i - i % ARITY
            own = b"".join(d for k, d in enumerate(levels[level][first : first + ARITY], first) if k != i)
            held[level] = (i, own + upward(level + 1, i // ARITY))
        return held[level][1]

    for i in range(len(digests)):
        yield upward(0, i)


#: What ``proved`` adds to its rows.
_ADDED = {"proof": pa.binary(), "subroot": pa.binary(), "upper_rank": pa.int64(), "upper_n": pa.int64(), "root": pa.binary()}


def _proved(slice_levels: int):
    """A slice's rows with their proofs; the other side is one row with the nodes that these pass above the slice."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("rank")
        beside = right.to_pylist()[0]
        above = {(x["level"], x["idx"]): x["digest"] for x in beside["above"] or ()}
        upper = beside["upper_proof"]
        proofs = [p + upper for p in _proofs(left["n"][0].as_py(), left["rank"][0].as_py(), left["digest"].to_pylist(), above, slice_levels)]
        out = left.drop_columns(["slice"])
        for name, kind in _ADDED.items():
            out = out.append_column(name, pa.array(proofs if name == "proof" else [beside[name]] * len(proofs), kind))
        return out

    return run


def proved(leaves: DataFrame, nodes: DataFrame, scratch: Scratch, name: str, upper: DataFrame | None = None, levels: int = SLICE) -> DataFrame:
    """``leaves`` plus proof, subroot (of their tree), upper_rank, upper_n and root.

    ``leaves`` has tree (not null), n, rank, digest and whatever else; ``nodes`` is what
    ``grown`` made of it, noting as many ``levels``.  ``proof`` holds the digests of the siblings, 32 bytes each, level
    by level up to the root and left to right within a level.  ``upper`` (tree, rank, n,
    proof, root) says where each tree's root stands in a tree above and leads proofs on.
    """
    powers = F.array(*(F.lit(ARITY**k).cast("long") for k in range(39)))
    dealt = leaves.withColumn("slice", F.floor(F.col("rank") / F.lit(ARITY**levels)).cast("long"))
    slices = scratch.table(dealt.select("tree", "n", "slice").distinct(), f"{name}_slices")
    passed = slices.withColumn("levels", _levels(F.col("n"))).where(F.col("levels") > levels)
    passed = passed.withColumn("level", F.explode(F.sequence(F.lit(levels), F.col("levels") - 1))).withColumn("power", F.element_at(powers, F.col("level") - levels + 1))
    passed = passed.withColumn("node", F.expr("slice div power")).withColumn("first", F.expr(f"node - node % {ARITY}"))
    passed = passed.withColumn("idx", F.explode(F.expr(f"sequence(first, first + {ARITY - 1})"))).where("idx <> node")
    above = passed.select("tree", "slice", "level", "idx").join(nodes.drop("n"), ["tree", "level", "idx"])
    above = above.groupBy("tree", "slice").agg(F.collect_list(F.struct("level", "idx", "digest")).alias("above"))
    tops = _roots(nodes)
    if upper is None:
        tops = tops.select("*", F.lit(0).cast("long").alias("upper_rank"), F.lit(1).cast("long").alias("upper_n"), F.lit(b"").alias("upper_proof"), F.col("subroot").alias("root"))
    else:
        tops = tops.join(upper.select("tree", F.col("rank").alias("upper_rank"), F.col("n").alias("upper_n"), F.col("proof").alias("upper_proof"), "root"), "tree")
    beside = join_checked(slices.drop("n").join(above, ["tree", "slice"], "left"), scratch.table(tops, f"{name}_tops"), "tree")
    kinds = [T.StructField(c, T.LongType() if k == pa.int64() else T.BinaryType()) for c, k in _ADDED.items()]
    return dealt.groupBy("tree", "slice").cogroup(beside.groupBy("tree", "slice")).applyInArrow(_proved(levels), T.StructType([*leaves.schema.fields, *kinds]))


def leaf_of(fields: Sequence[Column]) -> Column:
    """The digest of a row's fields: ``-`` for a null, else its length in UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.unhex(F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256))


def manifest(docs: DataFrame, *, row_id: str = "doc_id", group: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), keep: dict[str, Column] | None = None, levels: int = SLICE) -> DataFrame:
    """One row per row of ``docs``: its id, the columns ``keep``, and its place in the manifest.

    leaf, subroot and root are binary; rank of n leaves of the group, group_rank of n_groups
    groups; proof: the siblings' digests from the leaf over the subroot to the root.

    Within a group leaves ascend by id, nulls first; rows alike in id by their leaf.  Groups
    ascend bytewise, null first.  ``levels`` bounds a task's slice, 3**levels leaves, and has
    no part in the result.  Repeated rows are leaves of their own.  Columns that are
    not named take no part, whatever they are called.  An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession, "manifest")
    kept = keep or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))  # orders as the group does
    own = docs.select(F.col(row_id).alias("id"), tree.alias("tree"), leaf_of([F.col(f) for f in fields]).alias("digest"), F.struct(F.lit(0).alias("__"), *(c.alias(k) for k, c in kept.items())).alias("kept"), F.monotonically_increasing_id().alias("row"))
    leaves = numbered(scratch.table(own, "own"), ["tree"], ["id", "digest", "row"], size="n").drop("row")
    leaves = scratch.table(leaves, "leaves")
    scratch.drop("own")
    nodes = grown(leaves, scratch, "rows", levels)
    groups = scratch.table(_roots(nodes), "groups")
    groups = numbered(groups, [], ["tree"], size="n").select(F.lit("").alias("tree"), "n", "rank", F.col("subroot").alias("digest"), F.col("tree").alias("group"))
    groups = scratch.table(groups, "ranked")
    upper = proved(groups, grown(groups, scratch, "groups", levels), scratch, "group", None, levels)
    upper = scratch.table(upper.select(F.col("group").alias("tree"), "rank", "n", "proof", "root"), "upper")
    rows = proved(leaves, nodes, scratch, "row", upper, levels)
    return rows.select(F.col("id").alias(row_id), *(F.col("kept")[k].alias(k) for k in kept), F.col("digest").alias("leaf"), "rank", "n", F.col("upper_rank").alias("group_rank"), F.col("upper_n").alias("n_groups"), "subroot", "root", "proof")


def fold(digest: bytes, proof: bytes, *places: tuple[int, int]) -> bytes:
    """The root that a leaf and its siblings lead to; ``places``: (rank, n) in each tree passed."""
    at = 0
    for rank, n in places:
        while n > 1:
            first = rank - rank % ARITY
            near = min(ARITY, n - first) - 1
            run = [proof[at + 32 * k : at + 32 * k + 32] for k in range(near)]
            at += 32 * near
            run.insert(rank - first, digest)
            digest, rank, n = hashed(run), rank // ARITY, -(-n // ARITY)
    return digest


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        cols = [batch.column(names.index(c)).to_pylist() for c in ("folds", "proof", "rank", "n", "group_rank", "n_groups")]
        out = [None if d is None else fold(d, p, (r, n), (gr, gn)) for d, p, r, n, gr, gn in zip(*cols, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*names, "folded"])


def folded(rows: DataFrame, leaf: Column) -> DataFrame:
    """A manifest's rows plus ``folded``: the root that ``leaf``, a digest, leads to by the row's proof."""
    rows = rows.withColumn("folds", leaf)
    return rows.mapInArrow(tidy(_folded), T.StructType([*rows.schema.fields, T.StructField("folded", T.BinaryType())])).drop("folds")


def op12_merkle_manifest(spark, sf_dir):
    """Leaf, subroot, root and proof of every document, and what a text without its line ends folds to."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    struck = F.coalesce(struck & F.contains("text", F.lit("\n")), F.lit(False))
    other = leaf_of([*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), F.replace(F.col("text"), F.lit("\n"), F.lit(""))])
    rows = folded(manifest(docs, keep={"tampered": F.when(struck, other)}), F.coalesce("tampered", "leaf"))
    text = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", *(text(c).alias(c) for c in ("leaf", "subroot", "root")), F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


#: CRC-32 of an id's decimal digits, bit by bit (reflected polynomial 0xEDB88320).
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda r, k: xor(r // 2, (r % 2) * 3988292384)))"""
#: The two kinds of trees are built alike: nodes(tree, lvl, idx, n, h) upwards from the leaves, and for each node its siblings.
_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_FIELDS} || coalesce(strlen(text) || ':' || text, '-') AS plain,
    {_FIELDS} || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-') AS struck, xor(4294967295::BIGINT, {_CRC}) % 2 = 0 AS even
  FROM documents
), leaves AS (
  SELECT doc_id, tree, sha256(plain) AS leaf, CASE WHEN even THEN sha256(struck) ELSE sha256(plain) END AS bent,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, sha256(plain)) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
  FROM rows
), nodes AS (
  SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT tree, lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, idx // 3
), tops AS (
  SELECT tree AS grp, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS lvl, idx, n, subroot AS h FROM tops
  UNION ALL
  SELECT lvl + 1, idx // 3, (any_value(n) + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_nodes WHERE n > 1 GROUP BY lvl, idx // 3
), low_runs AS (
  SELECT tree, lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
), top_runs AS (
  SELECT lvl, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM upper_nodes WHERE n > 1 GROUP BY ALL
), climb AS (
  SELECT tree, doc_id, leaf, 0 AS lvl, idx, n, '' AS proof, bent AS x FROM leaves
  UNION ALL
  SELECT c.tree, c.doc_id, c.leaf, c.lvl + 1, c.idx // 3, (c.n + 2) // 3,
    c.proof || array_to_string(r.hs[: c.idx % 3] || r.hs[c.idx % 3 + 2 :], ''), sha256(array_to_string(r.hs[: c.idx % 3] || [c.x] || r.hs[c.idx % 3 + 2 :], ''))
  FROM climb c JOIN low_runs r ON c.tree = r.tree AND c.lvl = r.lvl AND c.idx // 3 = r.run
), upward AS (
  SELECT c.doc_id, c.leaf, t.subroot, 0 AS lvl, t.idx, t.n, c.proof, c.x FROM climb c JOIN tops t ON c.tree = t.grp WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.lvl + 1, c.idx // 3, (c.n + 2) // 3,
    c.proof || array_to_string(r.hs[: c.idx % 3] || r.hs[c.idx % 3 + 2 :], ''), sha256(array_to_string(r.hs[: c.idx % 3] || [c.x] || r.hs[c.idx % 3 + 2 :], ''))
  FROM upward c JOIN top_runs r ON c.lvl = r.lvl AND c.idx // 3 = r.run
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified
FROM upward, (SELECT h AS root FROM upper_nodes WHERE n = 1) WHERE n = 1
"""
