"""Merkle manifest of a table, and membership proofs by descending a content-addressed DAG.

Each row is a leaf: the SHA-256 of its columns, each written with its length.  The leaves of a group, in the order
of their ids, are hashed in runs of eight until one node, the group's subroot, remains; the subroots are hashed in
the same way to the root.

1. Leaves get their rank by a range partitioning that is stored once; only the row count of each slice is summed.
2. Every level is one grouped aggregation over runs of eight.  A level's nodes go to the store as records
   ``digest -> children``; equal subtrees are one record.
3. Requests for leaves descend from the root.  At each level the nodes reached so far are looked up in the store by
   digest, the next digit of the ranks selects a child, and the children that are not selected are appended to the
   path.  Requests with the same leading digits share one row until they part, so a level costs as many rows as it
   has nodes, and the whole descent little more than the last level.
4. A path runs from the root to the leaf; reversed, its segments fold the leaf up to the root again.

Everything is made of DataFrame operations; the driver sees only the number of leaves in the largest group.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attemptlab.llm.common import stored

FAN_BITS = 3              # eight children per node
FAN = 1 << FAN_BITS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Tree:
    """``tops`` (grp, digest, height) and, for each height from 1, the records (digest, children)."""

    tops: DataFrame
    store: list[DataFrame]


@dataclass
class Manifest:
    """``leaves`` (grp, pos, n, leaf and carried columns), the groups' trees and the tree over the subroots.

    ``groups`` has (grp, pos, n, digest, height): the subroots with their rank among the groups.
    """

    leaves: DataFrame
    groups: DataFrame
    inner: Tree
    outer: Tree


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 in lower-case hex of the values in order: ``-`` for null, else byte count, ``:`` and the value."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[part(c) for c in columns]), 256)


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, the rank within ``grp`` from 0, and ``n``, the group's rows; equal rows in any order.

    Rows are dealt by ranges of (grp, order), a running number breaks ties, so that neither one large group nor many
    equal rows meet in one task.  Only the counts of the slices are summed across tasks.
    """
    keys = ["grp", *order, "tie"]
    dealt = (rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys)
             .sortWithinPartitions(*keys).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    placed = stored(dealt, name).withColumn("slice", F.shiftright("at", 33))
    slices = placed.groupBy("grp", "slice").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("lo"))
    whole = Window.partitionBy("grp")
    before = whole.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = slices.select("grp", "slice", F.sum("rows").over(whole).alias("n"),
                           (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("lo")).alias("shift"))
    return placed.join(shifts, ["grp", "slice"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "slice", "shift")


def _tree(nodes: DataFrame, name: str) -> Tree:
    """Levels over ``nodes`` (grp, pos, n, digest) until each group has one node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    tops, store = [nodes.where("n = 1").select("grp", "digest", F.lit(0).alias("height"))], []
    while most > 1:
        up = stored(nodes.where("n > 1")
                    .groupBy("grp", F.shiftright("pos", FAN_BITS).alias("pos"),
                             F.ceil(F.col("n") / FAN).cast("long").alias("n"))
                    .agg(F.array_sort(F.collect_list(F.struct("pos", "digest")))["digest"].alias("children"))
                    .withColumn("digest", F.sha2(F.array_join("children", ""), 256)), f"{name}-level")
        store.append(up.groupBy("digest").agg(F.first("children").alias("children")))
        tops.append(up.where("n = 1").select("grp", "digest", F.lit(len(store)).alias("height")))
        nodes, most = up, -(-most // FAN)
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return Tree(out, store)


def build_manifest(docs: DataFrame, columns: list[str], id_col: str = "doc_id", group_col: str = "lang",
                   carry: dict[str, Column] | None = None) -> Manifest:
    """Manifest of all rows: ``columns`` make the leaf, rows of a ``group_col`` ascend by ``id_col``.

    Null groups are one group, before all others; groups are in the order of their UTF-8 bytes.  A null id comes
    first in its group; repeated ids are leaves of their own, in the order of their digests, and repeated equal rows
    are equal leaves.  An empty table has no leaves and no root.  ``carry`` names further columns that stay with the
    leaves; other columns of ``docs`` don't matter, whatever their names.
    """
    extra = carry or {}
    rows = stored(docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("")).alias("grp"),
        F.col(id_col).alias("id"), leaf_digest([F.col(c) for c in columns]).alias("leaf"),
        *[c.alias(k) for k, c in extra.items()]), "merkle-leaves")
    leaves = stored(_ranked(rows, ["id", "leaf"], "merkle-ranked"), "merkle-placed")
    inner = _tree(leaves.select("grp", "pos", "n", F.col("leaf").alias("digest")), "merkle")
    subroots = inner.tops.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest", "height")
    groups = stored(_ranked(subroots, ["name"], "merkle-groups"), "merkle-subroots")
    return Manifest(leaves, groups, inner, _tree(groups.select("grp", "pos", "n", "digest"), "merkle-top"))


def _unselected(children: Column, digit: Column) -> Column:
    """Path segment: the digests left and right of the child that the digit selects."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
                    F.array_join(F.slice(children, digit + 2, F.lit(FAN)), "").alias("right"))


def _descend(front: DataFrame, records: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One level down: every child of the nodes in ``front`` (or those ``wanted``, by grp and pos) with its path."""
    down = (front.join(records, "digest")
            .select(*[c for c in front.columns if c not in ("digest", "pos", "path")], "path", "children",
                    F.col("pos").alias("above"), F.posexplode("children").alias("digit", "digest"))
            .withColumn("pos", F.shiftleft("above", FAN_BITS) + F.col("digit"))
            .withColumn("path", F.concat("path", F.array(_unselected(F.col("children"), F.col("digit")))))
            .drop("children", "above", "digit"))
    return down if wanted is None else down.join(wanted, ["grp", "pos"], "left_semi")


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """Leaves with ``subroot``, ``root`` and ``path``, an array of (left, right) segments from the root to the leaf.

    ``requests`` (a subset of ``manifest.leaves``) restricts the descent to the nodes above them; by default all
    leaves are requested.
    """
    asked = manifest.leaves if requests is None else requests
    prefixes = None if requests is None else asked.select("grp", "pos")
    empty = F.array().cast("array<struct<left:string,right:string>>")
    front = manifest.outer.tops.select("grp", F.lit(0).cast("long").alias("pos"), "digest",
                                       F.col("digest").alias("root"), empty.alias("path"))
    for records in reversed(manifest.outer.store):
        front = _descend(front, records)
    groups = manifest.groups.select("pos", F.col("name").alias("name"), "height")
    reached = (front.drop("grp").join(groups, "pos")
               .select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "digest", "root",
                       F.col("digest").alias("subroot"), "height", "path"))
    if prefixes is not None:
        reached = reached.join(prefixes.select("grp").distinct(), "grp", "left_semi")
    store, now = manifest.inner.store, None
    for height in range(len(store), 0, -1):
        enter = reached.where(F.col("height") == height)
        now = enter if now is None else now.unionByName(enter)
        if height > 1:
            wanted = None if prefixes is None else prefixes.select(
                "grp", F.shiftright("pos", FAN_BITS * (height - 1)).alias("pos")).distinct()
            now = _descend(now, store[height - 1], wanted)
    # the last level is read by the requests themselves, so that a path is carried once per node and not per leaf
    lone = reached.where("height = 0").withColumn("children", F.array("digest"))
    last = lone if now is None else now.join(store[0], "digest").unionByName(lone)
    last = last.select("grp", F.col("pos").alias("node"), "subroot", "root", "path", "children")
    own = asked.withColumn("node", F.shiftright("pos", FAN_BITS)).withColumn("digit", (F.col("pos") % FAN).cast("int"))
    return (own.join(last, ["grp", "node"])
            .withColumn("path", F.when(F.col("n") == 1, F.col("path")).otherwise(
                F.concat("path", F.array(_unselected(F.col("children"), F.col("digit"))))))
            .drop("node", "digit", "children"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all unselected digests from the leaf's level up to the root, left to right."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(F.reverse(path), leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def verified_leaves(docs: DataFrame, columns: list[str], claims: Column, id_col: str = "doc_id",
                    group_col: str = "lang") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of ``docs``.

    ``claims`` is the leaf digest to be verified (null: the row's own leaf).  Nulls, repeated rows and empty tables
    as in ``build_manifest``.
    """
    proofs = prove(build_manifest(docs, columns, id_col, group_col, carry={"claim": claims}))
    return (proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                          fold(F.coalesce("claim", "leaf"), F.col("path")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def lowered(text: Column) -> Column:
    """A text with A-Z in lower case."""
    return F.translate(text, UPPER, LOWER)


def _oracle(levels: int = 8) -> str:
    """DuckDB SQL of ``op11_merkle_manifest``: levels written out one by one, for at most 8 ** ``levels`` rows a group."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")

    def digest(text: str) -> str:
        parts = ", ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in
                          [f"CAST({text if c == 'text' else c} AS VARCHAR)" for c in columns])
        return f"sha256(concat({parts}))"

    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    # CRC-32 of the digits of doc_id, byte by byte and bit by bit
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
           "lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), "
           "lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))")
    ctes = [f"""l AS (SELECT doc_id, lang, {digest('text')} AS leaf,
  CASE WHEN {crc} % 3 = 0 THEN {digest(lower)} ELSE {digest('text')} END AS claim,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)""",
            "n0 AS (SELECT coalesce('=' || lang, '') AS grp, pos, leaf AS digest FROM l)"]

    def level(src: str, dst: str) -> list[str]:
        """Siblings of each node within its run, and the next level; a single node stays as it is."""
        run = "PARTITION BY grp, pos // 8 ORDER BY pos"
        return [f"""{src}s AS MATERIALIZED (SELECT grp, pos, digest,
  CASE WHEN count(*) OVER (PARTITION BY grp) = 1 THEN 0 ELSE 1 END AS open,
  coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
  coalesce(string_agg(digest, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM {src})""",
                f"""{dst} AS (SELECT grp, pos // 8 AS pos, CASE WHEN max(open) = 0 THEN any_value(digest)
  ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM {src}s GROUP BY grp, pos // 8)"""]

    for h in range(levels):
        ctes += level(f"n{h}", f"n{h + 1}")
    ctes.append(f"""t0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, digest FROM n{levels})""")
    ctes.append(f"names AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS top, digest AS subroot FROM n{levels})")
    for h in range(levels):
        ctes += level(f"t{h}", f"t{h + 1}")
    prev = "j"
    ctes.append("""j AS (SELECT doc_id, leaf, l.pos, top, names.grp AS name, subroot, '' AS proof, claim AS folded
  FROM l JOIN names ON names.grp = coalesce('=' || lang, ''))""")
    for part, key, where in (("n", "pos", "s.grp = p.name"), ("t", "top", "true")):
        for h in range(levels):
            now = f"j{part}{h}"
            ctes.append(f"""{now} AS (SELECT doc_id, leaf, p.pos, top, name, subroot, proof || lft || rgt AS proof,
  CASE WHEN open = 1 THEN sha256(lft || folded || rgt) ELSE folded END AS folded
  FROM {prev} p JOIN {part}{h}s s ON {where} AND s.pos = p.{key} // {8 ** h})""")
            prev = now
    return (f"WITH {', '.join(ctes)}\nSELECT doc_id, leaf, subroot, t.digest AS root, sha256(proof) AS proof_sha256,\n"
            f"  folded AS folded_root, folded = t.digest AS verified FROM {prev} CROSS JOIN t{levels} t")


ORACLE = _oracle()
