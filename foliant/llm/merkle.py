"""A Merkle manifest of a dataset: one tree a source, one tree over the sources.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else its length in
UTF-8 bytes, ``:`` and its value. Level by level every 16 consecutive nodes of a
tree (of the last run fewer, even one) become the digest of their hex texts, until
one node is left. Leaves of a source ascend by ``doc_id``, sources by their bytes,
null first.

Texts are read once: leaves are written before they are dealt into ranges of
(source, doc_id), sorted there and written again; the sizes of the ranges place every leaf. Blocks of ``16 ** k`` leaves are then
reduced wherever they are, and each block stays packed in one row of a written
table. The driver sees only block roots: it builds the top of all trees from
them and broadcasts it, and tasks cut each block's path to the root out of it,
finish the proofs of the block's rows and fold every row along its own.

``k`` is the least from 3 for which at most ``TOP_NODES`` blocks are full, so a task
holds ``16 ** k`` leaves and the driver ``TOP_NODES`` nodes and one a source. Sources
and ranges are counted on the driver: more than ``MAX_SOURCES`` sources are an error.

Nulls are values of their own, sources and ids alike (ids: first). Rows with one
source and id are ordered by leaf; equal rows have equal leaves and a proof
each. Empty tables give an empty manifest; texts are hashed whole, in the JVM;
columns other than the fields are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fits, small_batches, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, BITS = 16, 4
#: Full blocks that the driver's tree may have, sources it may have, and rows of a range.
TOP_NODES, MAX_SOURCES, RANGE_ROWS = 1 << 18, 1 << 20, 1_000_000
LOW_BITS = 33


def leaf(*values: Column) -> Column:
    """The digest (32 bytes) of a row's fields."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# A tree's levels: nodes of 32 bytes, one after the other ------------------------


def level_up(nodes: bytes) -> bytes:
    return b"".join(hashlib.sha256(nodes[i : i + 32 * FAN].hex().encode()).digest() for i in range(0, len(nodes), 32 * FAN))


def levels(nodes: bytes, steps: int | None = None) -> list[bytes]:
    """All levels up to the root, or those of so many steps."""
    out = [nodes]
    while len(out) <= steps if steps is not None else len(out[-1]) > 32:
        out.append(level_up(out[-1]))
    return out


def path(tree: list[bytes], at: int) -> list[tuple[str, str]]:
    """What stands left and right of a leaf's ancestors in their runs, below the last level."""
    out = []
    for nodes in tree[:-1]:
        first = at // FAN * FAN
        out.append((nodes[32 * first : 32 * at].hex(), nodes[32 * (at + 1) : 32 * (first + FAN)].hex()))
        at //= FAN
    return out


def fold(node: str, siblings: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings lead to."""
    for left, right in siblings:
        node = h(left + node + right)
    return node


@dataclass
class Top:
    """The upper part of all trees: for each source the levels above its blocks, and those over the sources."""

    groups: list[list[bytes]]
    over: list[bytes]

    def suffix(self, group: int, block: int) -> tuple[list[tuple[str, str]], str, str]:
        """A block's path up to the root, its source's root, and the root."""
        own = self.groups[group]
        return path(own, block) + path(self.over, group), own[-1].hex(), self.over[-1].hex()


# Spark ---------------------------------------------------------------------------

PACKED = "group int, block long, ids array<long>, leaves binary, shown array<binary>, root binary"
OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"


def placed(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """``rows`` with the number of their source (``group``) and their place in it, and the sources' sizes."""
    spark = rows.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    # Copies of one row may be many, so their number parts them; they are alike, so any order of theirs will do.
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "_n")]
    dealt = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    kept = stage(spark, dealt.drop("_n").withColumn("_at", F.monotonically_increasing_id()), "merkle-ranges")
    part = F.shiftright("_at", LOW_BITS).alias("_part")
    runs = kept.groupBy(part, "source").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    if not fits(runs.select("source").distinct(), MAX_SOURCES):
        raise ValueError(f"more than {MAX_SOURCES} sources")
    lookup, sizes, last = [], [], ()
    for r in sorted(runs.collect(), key=lambda r: (r["source"] is not None, (r["source"] or "").encode(), r["_part"])):
        if last != (r["source"],):
            last = (r["source"],)
            sizes.append(0)
        lookup.append((r["_part"], r["source"], len(sizes) - 1, sizes[-1] - r["first"]))
        sizes[-1] += r["n"]
    known = spark.createDataFrame(lookup, "_p long, _s string, group int, _shift long")
    if len(lookup) <= 200_000:
        known = F.broadcast(known)
    joined = kept.withColumn("_part", part).join(known, (F.col("_part") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_s")))
    return joined.select("group", (F.col("_at") + F.col("_shift")).alias("place"), "doc_id", "leaf", "shown"), sizes


def blocks(rows: DataFrame, sizes: list[int], k: int) -> DataFrame:
    """A row for each block of a source: its leaves in their order, and what they reduce to."""
    size = FAN**k
    alone = rows.sparkSession.sparkContext.broadcast(bytes(n <= size for n in sizes))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        group, block = (k_.as_py() for k_ in key)
        t = t.sort_by("place")
        nodes = b"".join(t.column("leaf").to_pylist())
        root = levels(nodes, None if alone.value[group] else k)[-1]
        columns = {"group": [group], "block": [block], "ids": [t.column("doc_id").to_pylist()], "leaves": [nodes], "shown": [t.column("shown").to_pylist()], "root": [root]}
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.binary())
        return pa.table({n: pa.array(c, kind) for (n, c), kind in zip(columns.items(), kinds, strict=True)})

    keyed = rows.withColumn("block", F.floor(F.col("place") / size))
    return keyed.groupBy("group", "block").applyInArrow(pack, PACKED)


def top_of(packed: DataFrame, groups: int) -> Top:
    """The upper trees, from the roots of all blocks."""
    roots: list[list[tuple[int, bytes]]] = [[] for _ in range(groups)]
    for group, block, root in packed.select("group", "block", "root").collect():
        roots[group].append((block, bytes(root)))
    trees = [levels(b"".join(r for _, r in sorted(found))) for found in roots]
    return Top(trees, levels(b"".join(t[-1] for t in trees)))


def manifest(docs: DataFrame, shown: Column | None = None, paths: bool = False, k: int | None = None) -> DataFrame:
    """Each row's leaf, proof and roots: ``(doc_id, leaf, subroot, root, proof_sha256, folded_root)``.

    ``folded_root`` is computed from the row's siblings and the leaf that ``shown``
    (32 bytes, an expression over ``docs``) presents for it, or where that is null
    or not given its own. ``proof_sha256`` is the digest of the siblings' hex texts.
    With ``paths`` the siblings come as ``path``, an array of ``(left, right)`` a level.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select("source", "doc_id", leaf(*(F.col(f) for f in FIELDS)).alias("leaf"), (F.lit(None).cast("binary") if shown is None else shown).alias("shown"))
    ordered, sizes = placed(stage(spark, rows, "merkle-leaves"))
    out = OUT + (", path array<struct<left:string,right:string>>" if paths else "")
    if not sizes:
        return spark.createDataFrame([], out)
    k = k or next(k for k in range(3, 16) if sum(n // FAN**k for n in sizes) <= TOP_NODES)
    packed = stage(spark, blocks(ordered, sizes, k), "merkle-blocks")
    top = spark.sparkContext.broadcast(top_of(packed, len(sizes)))
    alone = [n <= FAN**k for n in sizes]

    def finish(batches):
        for b in batches:
            for group, block, ids, nodes, shown_ in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                above, subroot, root = top.value.suffix(group, block)
                tree = levels(nodes, None if alone[group] else k)
                for start in range(0, len(ids), 4096):  # a batch of rows
                    made = []
                    for at in range(start, min(len(ids), start + 4096)):
                        own = nodes[32 * at : 32 * at + 32].hex()
                        siblings = path(tree, at) + above
                        proof = h("".join(left + right for left, right in siblings))
                        folded = fold(own if shown_[at] is None else shown_[at].hex(), siblings)
                        made.append((ids[at], own, subroot, root, proof, folded, *([[{"left": x, "right": y} for x, y in siblings]] if paths else [])))
                    kinds = [pa.int64(), *[pa.string()] * 5] + ([pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))] if paths else [])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), kinds, strict=True)], names=[*(x.split()[0] for x in OUT.split(", ")), *(["path"] if paths else [])])

    return packed.select("group", "block", "ids", "leaves", "shown").mapInArrow(finish, out)


def folded(leaf_hex: Column, siblings: Column) -> Column:
    """The root that a leaf (hex) and a ``path`` column lead to, for holders of a manifest with paths."""
    return F.aggregate(siblings, leaf_hex, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampering(docs: DataFrame) -> DataFrame:
    """The manifest, and whether each row's root is found again where every fifth row (by its id) shows a text in lower case."""
    lowered = leaf(*(F.translate(F.col(f), UPPER, LOWER) if f == "text" else F.col(f) for f in FIELDS))
    found = manifest(docs, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


# DuckDB --------------------------------------------------------------------------


def _field(name: str) -> str:
    v = f"cast({name} as varchar)"
    return f"coalesce(cast(octet_length(encode({v})) as varchar) || ':' || {v}, '-')"


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text; ``crc_table`` must be in the FROM clause."""
    codes = f"list_transform(string_split({text}, ''), lambda x: cast(ascii(x) as bigint))"
    return f"xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


CRC_TABLE = """crc_table as (select list(list_reduce(list_prepend(n, range(8)), lambda c, i: xor(c >> 1, 3988292384 * (c & 1))) order by n) as t
  from (select unnest(range(256)) as n))"""


def _tree(name: str, source: str, key: str, steps: int) -> str:
    """CTEs ``name_l`` of each level's nodes: whether the level is reduced, and what stands left and right in a run."""
    out = [f"{name}_0 as ({source})"]
    for step in range(steps):
        own = f"{name}_{step}"
        side = lambda frame: f"coalesce(string_agg(node, '') over (partition by {key}, pos // 16 order by pos rows between {frame}), '')"  # noqa: E731, B023
        out.append(f"""{own}s as (select *, count(*) over (partition by {key}) > 1 as more,
  {side("unbounded preceding and 1 preceding")} as lefts, {side("1 following and unbounded following")} as rights from {own})""")
        out.append(f"""{name}_{step + 1} as (select {key}, pos // 16 as pos, case when bool_or(more) then sha256(string_agg(node, '' order by pos)) else max(node) end as node
  from {own}s group by {key}, pos // 16)""")
    return ",\n".join(out)


def _climb(steps: int, name: str, key: str, at: str) -> tuple[str, str]:
    """Joins along a path, and the siblings' text."""
    joins, proof = "", []
    for step in range(steps):
        s = f"{name}{step}"
        joins += f"\n  join {name}_{step}s {s} on {s}.{key} is not distinct from {at}.{key} and {s}.pos = {at}.pos // {16**step}"
        proof.append(f"case when {s}.more then {s}.lefts || {s}.rights else '' end")
    return joins, " || ".join(proof)


def _oracle(steps: int = 5, over: int = 3) -> str:
    shown = ", ".join(_field(f) for f in FIELDS)
    lowered = ", ".join(_field(f"translate(text, '{UPPER}', '{LOWER}')" if f == "text" else f) for f in FIELDS)
    joins, proof = _climb(steps, "own", "g", "l")
    joins2, proof2 = _climb(over, "all", "one", "p")
    folds, at, last = "", "shown", "climbed"
    for tree, n in (("own", steps), ("all", over)):
        for step in range(n):
            folds += f",\n{tree}_fold_{step} as (select * exclude ({at}), case when {tree}{step}_more then sha256({tree}{step}_l || {at} || {tree}{step}_r) else {at} end as f_{tree}_{step} from {last})"
            at, last = f"f_{tree}_{step}", f"{tree}_fold_{step}"
    own_columns = ", ".join(f"own{i}.more as own{i}_more, own{i}.lefts as own{i}_l, own{i}.rights as own{i}_r" for i in range(steps))
    all_columns = ", ".join(f"all{i}.more as all{i}_more, all{i}.lefts as all{i}_l, all{i}.rights as all{i}_r" for i in range(over))
    return f"""
with {CRC_TABLE},
hashed as (select doc_id, source, sha256(concat({shown})) as node,
  case when {crc32_sql("cast(doc_id as varchar)")} % 5 = 0 then sha256(concat({lowered})) end as other from documents, crc_table),
leafs as (select doc_id, other, node, dense_rank() over (order by source nulls first) - 1 as g,
  row_number() over (partition by source order by doc_id nulls first, node) - 1 as pos from hashed),
{_tree("own", "select g, pos, node from leafs", "g", steps)},
{_tree("all", f"select 0 as one, g as pos, node from own_{steps}", "one", over)},
placed as (select 0 as one, g as pos, node from own_{steps}),
climbed as (select l.doc_id, l.node as leaf, p.node as subroot, r.node as root, sha256({proof} || {proof2}) as proof_sha256, coalesce(l.other, l.node) as shown,
  {own_columns}, {all_columns}
  from leafs l join placed p on p.pos = l.g cross join (select node from all_{over}) r{joins}{joins2}){folds}
select doc_id, leaf, subroot, root, proof_sha256, {at} as folded_root, {at} = root as verified from {last}
"""


#: Trees of up to 16 ** 5 leaves a source and 16 ** 3 sources.
ORACLE = _oracle()
