"""Merkle manifest of a table: aligned blocks of leaves are folded where they meet, block roots go through the same again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_table, numbered

#: Nodes that fold into one, and levels in a block: 2 ** 12 leaves meet in a task at most.
ARITY, HEIGHT = 2, 12


def digest_of(text: bytes) -> bytes:
    """Lowercase hex SHA-256, as bytes."""
    return hashlib.sha256(text).hexdigest().encode()


def leaf_of(*values: Column) -> Column:
    """Digest of values in order: `-` for null, else the UTF-8 byte count, a colon and the value."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in said]).cast("binary"), 256)


def fold_block(digests: list[bytes], levels: int, arity: int = ARITY) -> tuple[bytes, list[list[bytes]]]:
    """Digest of the subtree over a block's digests, `levels` high, and for each leaf the siblings met on the way up.

    Postorder: a node's children are visited first; on the way back each child's
    leaves get the other children as their next siblings.
    """
    count = [len(digests)]
    for _ in range(levels):
        count.append(-(-count[-1] // arity))
    paths: list[list[bytes]] = [[] for _ in digests]

    def visit(level: int, k: int) -> bytes:
        if not level:
            return digests[k]
        own = range(k * arity, min((k + 1) * arity, count[level - 1]))
        kids = [visit(level - 1, c) for c in own]
        if len(kids) > 1:
            below = arity ** (level - 1)
            for i, c in enumerate(own):
                others = kids[:i] + kids[i + 1 :]
                for leaf in range(c * below, min((c + 1) * below, len(digests))):
                    paths[leaf] += others
        return digest_of(b"".join(kids))

    return visit(levels, 0), paths


def climb(digest: bytes, at: int, n: int, siblings: Iterator[bytes], arity: int = ARITY) -> bytes:
    """Root over n nodes from the one at `at` and its siblings."""
    while n > 1:
        begin = at - at % arity
        run = [digest if k == at else next(siblings) for k in range(begin, min(begin + arity, n))]
        digest, at, n = digest_of(b"".join(run)), at // arity, -(-n // arity)
    return digest


def depth(n: int, arity: int = ARITY) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def _traverse(nodes: DataFrame, keep: list[str], arity: int, height: int) -> tuple[DataFrame, DataFrame]:
    """One traversal of (grp, at, n, digest, *keep): its nodes with `up`, their block, and `path`, their siblings inside it; and the block roots."""
    size = arity**height
    cols = ["grp", "at", "n", "digest", *keep]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        n = t["n"][0].as_py()
        root, paths = fold_block([d.encode() for d in t["digest"].to_pylist()], min(height, depth(n, arity)), arity)
        up = t["up"].to_pylist()
        whole = {c: [None] for c in keep} | {"grp": [t["grp"][0].as_py()], "at": [up[0]], "n": [-(-n // size)], "digest": [root.decode()], "up": [-1], "path": [b""]}
        own = t.append_column("path", pa.array([bytes.fromhex(b"".join(p).decode()) for p in paths], pa.binary()))
        return pa.concat_tables([own, pa.table({c: pa.array(whole[c], own.schema.field(c).type) for c in own.column_names})])

    blocks = nodes.select(*cols, F.expr(f"at div {size}").alias("up"))
    done = as_table(blocks.groupBy("grp", "up").applyInArrow(run, blocks.withColumn("path", F.lit(b"")).schema), "merkle")
    return done.where("up >= 0"), done.where("up < 0").select("grp", "at", "n", "digest")


def _tree(nodes: DataFrame, keep: list[str], arity: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Traversals from the leaves to one node for each group, in order, and those nodes (grp, digest)."""
    passes = []
    while (nodes.agg(F.max("n").alias("n")).first()["n"] or 0) > 1 or not passes:
        done, nodes = _traverse(nodes, keep, arity, height)
        passes.append(done)
        keep = []
    return passes, nodes.select("grp", "digest")


def _down(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first traversal's nodes with their whole path: above (grp, path, ...) is what the groups' last nodes have on top."""
    for k, level in enumerate(reversed(passes)):
        over = above.withColumnRenamed("path", "rest")
        if not k:  # one node is left in each group: its number is 0
            over = over.withColumn("up", F.lit(0).cast("long"))
        own = level if k == len(passes) - 1 else level.select("grp", F.col("at"), "up", "path")
        met = own.join(over, ["grp", "up"]).withColumn("path", F.concat("path", "rest")).drop("rest", "up")
        above = met if k == len(passes) - 1 else met.withColumnRenamed("at", "up")
    return above


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), claimed: dict[str, Column] | None = None, arity: int = ARITY, height: int = HEIGHT) -> DataFrame:
    """(doc_id, grp, at, n, leaf, claimed, path, subroot, group_at, groups, root) for every row of df.

    Leaves are digests of `fields`; those of a group ascend by id, and while
    several nodes remain every `arity` consecutive ones fold into their digest.
    The groups' last nodes, null first and then bytewise, fold into the root
    likewise.  `path` holds a leaf's siblings from its run to the root, 32 bytes
    each.  `claimed` is the leaf of the same row with other values for some fields
    (expressions over df); without it the leaf.

    A null id comes first in its group; rows with one id are ordered by their leaf,
    equal rows as they were read.  Null and empty fields differ.  Columns that are
    no fields are ignored; an empty table has no rows and no root.
    """
    values = {f: F.col(f) for f in fields}
    told = as_table(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"),  # null first, then bytewise
            leaf_of(*values.values()).alias("digest"),
            leaf_of(*(values | (claimed or {})).values()).alias("claimed"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "leaves",
    )
    leaves = numbered(told, "grp", ["grp", "doc_id", "digest", "row"])
    passes, subroots = _tree(leaves, ["doc_id", "claimed"], arity, height)
    subroots = as_table(subroots.select(F.lit(0).alias("all"), "grp", "digest"), "subroots")
    tops = as_table(numbered(subroots, "all", ["all", "grp"]).select(F.lit("").alias("grp"), "at", "n", "digest", F.col("grp").alias("of")), "tops")
    over, root = _tree(tops, ["of"], arity, height)
    named = root.select("grp", F.lit(b"").alias("path"), F.col("digest").alias("root"))
    above = _down(over, named).select(F.col("of").alias("grp"), F.col("digest").alias("subroot"), F.col("at").alias("group_at"), F.col("n").alias("groups"), "path", "root")
    return _down(passes, above).withColumnRenamed("digest", "leaf")


def verified(found: DataFrame, arity: int = ARITY) -> DataFrame:
    """found with proof_sha256, the digest of the siblings as hex text; folded_root, from the claimed leaf and the siblings; and whether that is the root."""
    schema = found.schema.simpleString()[7:-1] + ",proof_sha256:string,folded_root:string,verified:boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            proofs, roots = [], []
            cols = (b[c].to_pylist() for c in ("path", "claimed", "at", "n", "group_at", "groups"))
            for path, leaf, at, n, group_at, groups in zip(*cols, strict=True):
                text = path.hex().encode()
                siblings = iter([text[k : k + 64] for k in range(0, len(text), 64)])
                proofs.append(digest_of(text).decode())
                roots.append(reduce(lambda d, x: climb(d, *x, siblings, arity), ((at, n), (group_at, groups)), leaf.encode()).decode())
            good = [a == r for a, r in zip(b["root"].to_pylist(), roots, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(proofs, pa.string()), pa.array(roots, pa.string()), pa.array(good, pa.bool_())], names=[*b.schema.names, "proof_sha256", "folded_root", "verified"])

    return found.mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
