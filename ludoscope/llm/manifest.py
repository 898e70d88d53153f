"""Merkle manifest of a dataset by time-forward processing.

Leaves of a tree (one for each language) ascend by id; runs of :data:`FAN` consecutive nodes
become their digest, level by level, and what remains of each tree is a leaf of the root's tree.

A node's label is its level and place, so children come before their parents. Nodes are
processed in the order of their labels, and each sends its digest forward to its parent
through a priority queue ordered by label. The queue is external: messages inside a band of
:data:`BAND` levels wait in the heap of the task that sweeps a block of at most FAN**BAND
consecutive nodes; messages to a later band are written to the shared folder, dealt by block
and read when its time comes. The reversed sweep goes from the root's band down and sends each
node the suffix of its proof: the siblings from its parent's run up to the root. So no task holds
more than one block, whatever a tree's size, and each round has FAN**BAND times fewer nodes.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, written

#: Nodes of a run, and levels that one task climbs: 8**4 = 4,096 nodes a block.
FAN, BAND = 8, 4

Label = tuple[int, int]
#: What a proof has above a node: left siblings, right siblings, and the rest; None at the root.
Suffix = tuple[str, str, "Suffix"] | None


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of texts put together."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """A value so that no two rows give the same text: ``-`` for null, else its number of
    UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: Sequence[Column]) -> Column:
    """The digest of a row's values, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(c) for c in columns)), 256))


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


# -- one block, in one task -------------------------------------------------------------


def forward(nodes: Sequence[str], levels: int) -> tuple[str, dict[Label, list[str]]]:
    """Climbs ``levels`` levels from consecutive nodes, the first of which begins a run. The
    digest at the top, and by each inner node's label the digests of its children."""
    queue = [((1, i // FAN), i, d) for i, d in enumerate(nodes)]  # in order, so already a heap
    children: dict[Label, list[str]] = {}
    top = nodes[0]
    while levels and queue:
        label = queue[0][0]
        own = children[label] = []
        while queue and queue[0][0] == label:
            own.append(heapq.heappop(queue)[2])
        top = digest(*own)
        level, place = label
        if level < levels:
            heapq.heappush(queue, ((level + 1, place // FAN), place, top))
    return top, children


def backward(children: dict[Label, list[str]], levels: int, suffix: Suffix) -> list[Suffix]:
    """From the top of a block down to its nodes: the suffix of each node's proof."""
    if not levels:
        return [suffix]
    queue: list[tuple[Label, Suffix]] = [((-levels, 0), suffix)]
    found: list[Suffix] = []
    while queue:
        (level, place), above = heapq.heappop(queue)  # labels are negated: parents come first
        own = children[-level, -place]
        for i in reversed(range(len(own))):  # so nodes are found from the last to the first
            below = ("".join(own[:i]), "".join(own[i + 1 :]), above)
            if level == -1:
                found.append(below)
            else:
                heapq.heappush(queue, ((level + 1, place * FAN - i), below))
    return found[::-1]


def folded(node: str, suffix: Suffix) -> str:
    """The root that a node and the siblings of its proof give."""
    while suffix is not None:
        left, right, suffix = suffix
        node = digest(left, node, right)
    return node


def siblings(suffix: Suffix) -> list[str]:
    """The siblings of a proof, level by level, those of a level as one text."""
    out = []
    while suffix is not None:
        left, right, suffix = suffix
        out.append(left + right)
    return out


# -- all blocks --------------------------------------------------------------------------


def placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Adds ``at``, a row's place in its tree from 0, and ``total``, the tree's rows. Rows are
    dealt by ranges of (tree, order) and sorted; only the number of rows in each range goes
    on, so no task sees a whole tree. Equal rows are dealt by a number of their own."""
    ranged = rows.withColumn("__own", F.monotonically_increasing_id()).repartitionByRange(tree, *order, "__own").sortWithinPartitions(tree, *order, "__own")
    numbered = written(ranged.drop("__own").withColumn("__row", F.monotonically_increasing_id()), "manifest-ranges").withColumn("__part", F.shiftrightunsigned("__row", 33))
    parts = numbered.groupBy(tree, "__part").agg(F.count("*").alias("__n"), F.min("__row").alias("__first"))
    whole = Window.partitionBy(tree)  # as many rows as ranges
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(tree, "__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("total"))
    got = numbered.join(starts, [tree, "__part"]).withColumn("at", F.col("__before") + F.col("__row") - F.col("__first"))
    return got.drop("__part", "__row", "__first", "__before")


def _left(level: int) -> Column:
    """Nodes of a tree at a level."""
    return F.expr(f"(total + {FAN**level - 1}L) div {FAN**level}L")


def _levels(total: int, level: int, band: int) -> int:
    """Levels that are climbed from ``level`` inside its band: up to where one node remains."""
    n, up = -(-total // FAN**level), 0
    while n > 1 and up < band:
        n, up = -(-n // FAN), up + 1
    return up


def sweep_up(nodes: DataFrame, band: int = BAND) -> tuple[list[DataFrame], DataFrame]:
    """From ``tree, total, at, digest`` (others are kept): the nodes at which each band begins,
    and ``tree, total, digest`` of what remains of each tree."""

    def climb(level: int):
        def one(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("at")
            total = int(own["total"].iloc[0])
            top, _ = forward([d.hex() for d in own["digest"]], _levels(total, level, band))
            return pd.DataFrame({"tree": [own["tree"].iloc[0]], "total": [total], "at": [own["at"].iloc[0] // FAN**band], "digest": [bytes.fromhex(top)]})

        return one

    bands, tops, level = [nodes], [nodes.where(_left(0) == 1)], 0
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > FAN**level:
        block = F.expr(f"at div {FAN**band}").alias("block")
        waiting = bands[-1].where(_left(level) > 1).select("tree", "total", "at", "digest", block)
        got = written(waiting.groupBy("tree", "block").applyInPandas(climb(level), "tree string, total long, at long, digest binary"), "manifest-queue")
        level += band
        bands.append(got)
        tops.append(got.where(_left(level) == 1))
    return bands, reduce(DataFrame.union, (t.select("tree", "total", "digest") for t in tops))


_SUFFIX = "tree string, block long, subroot string, root string, lefts array<string>, rights array<string>"
_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>"


def _linked(lefts: Sequence[str], rights: Sequence[str]) -> Suffix:
    suffix: Suffix = None
    for left, right in zip(reversed(list(lefts)), reversed(list(rights))):
        suffix = (left, right, suffix)
    return suffix


def sweep_down(bands: list[DataFrame], starts: DataFrame, proofs: bool | None = None, band: int = BAND) -> DataFrame:
    """From ``tree, total, subroot, root, lefts, rights`` at what remains of each tree down to
    the nodes that :func:`sweep_up` began with. Those get their suffixes, under their
    ``name`` as a tree; with ``proofs`` given, they are leaves (``doc_id``, ``changed``) and
    get their proofs checked, the siblings themselves only if it is true."""

    def sweep(level: int, last: bool):
        def one(own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            own, above = own.sort_values("at"), above.iloc[0]
            levels = _levels(int(own["total"].iloc[0]), level, band)
            nodes = [d.hex() for d in own["digest"]]
            suffixes = backward(forward(nodes, levels)[1], levels, _linked(above["lefts"], above["rights"]))
            if last and proofs is not None:
                out = []
                for doc, node, changed, suffix in zip(own["doc_id"], nodes, own["changed"], suffixes):
                    proof = siblings(suffix)
                    root = folded(changed.hex() if changed is not None else node, suffix)
                    out.append((doc, node, above["subroot"], above["root"], digest(*proof), root, root == above["root"], proof if proofs else None))
                got = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"])
                return got.astype({"doc_id": "Int64"})
            parts = [(siblings_of(s, 0), siblings_of(s, 1)) for s in suffixes]
            trees = own["name"] if last else own["tree"]
            return pd.DataFrame({"tree": trees.to_numpy(), "block": 0 if last else own["at"].to_numpy(), "subroot": nodes if last else above["subroot"], "root": above["root"], "lefts": [p[0] for p in parts], "rights": [p[1] for p in parts]})

        return one

    delivered: DataFrame | None = None
    for b in reversed(range(max(len(bands) - 1, 1))):
        level, last = b * band, b == 0
        here = _left(level + band) == 1
        first = starts.where(here if last else here & (_left(level) > 1)).select("tree", F.lit(0).cast("long").alias("block"), "subroot", "root", "lefts", "rights")
        above = first if delivered is None else first.union(delivered)
        own = (bands[b] if last else bands[b].where(_left(level) > 1)).withColumn("block", F.expr(f"at div {FAN**band}"))
        pairs = own.groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))
        delivered = pairs.applyInPandas(sweep(level, last), _PROVED if last and proofs is not None else _SUFFIX)
        if not last:
            delivered = written(delivered, "manifest-suffixes")
    return delivered


def siblings_of(suffix: Suffix, side: int) -> list[str]:
    """The left (0) or right (1) siblings of a proof, level by level."""
    out = []
    while suffix is not None:
        out.append(suffix[side])
        suffix = suffix[2]
    return out


def prove(docs: DataFrame, columns: Sequence[str], tree: str = "lang", id_col: str = "doc_id", changed: Column | None = None, proofs: bool = False, band: int = BAND) -> DataFrame:
    """Digests of all rows up to one root, and each row's proof checked against it.

    ``columns`` are the values of a leaf in order; ``changed`` is the digest of what a row is
    checked as where it was tampered with, null elsewhere. Returns ``doc_id, leaf, subroot,
    root, proof_sha256, folded_root, verified``, and with ``proofs`` the siblings of each level.

    Null values count as such in a digest; a null id comes first in its tree, a null tree
    first among trees, which are ordered by their UTF-8 bytes. Rows of one id are ordered by
    their digests; equal rows are leaves of their own with equal digests. A tree of one leaf is
    that leaf. Texts may be empty or of any length; other columns are left alone; an empty
    table gives no rows.
    """
    named = F.coalesce(F.concat(F.lit("1"), F.col(tree)), F.lit("0"))
    none = F.lit(None).cast("binary")
    rows = docs.select(named.alias("tree"), F.col(id_col).cast("long").alias("doc_id"), leaf([F.col(c) for c in columns]).alias("digest"), (none if changed is None else changed).alias("changed"))
    leaves = written(placed(written(rows, "manifest-leaves"), "tree", ["doc_id", "digest"]), "manifest-placed")
    bands, tops = sweep_up(leaves, band)
    trees = written(placed(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("total").alias("leaves"), "digest"), "tree", ["name"]), "manifest-trees")
    over, root = sweep_up(trees, band)
    none_above = F.array().cast("array<string>")
    starts = root.select("tree", "total", F.lit("").alias("subroot"), F.lower(F.hex("digest")).alias("root"), none_above.alias("lefts"), none_above.alias("rights"))
    below = sweep_down(over, starts, band=band)
    below = written(below.join(trees.select(F.col("name").alias("tree"), F.col("leaves").alias("total")), "tree"), "manifest-suffixes")
    got = sweep_down(bands, below, proofs, band)
    return got if proofs else got.drop("proof")


def prove_tampered(docs: DataFrame, band: int = BAND) -> DataFrame:
    """:func:`prove` for documents, of which those whose id's crc32 is divisible by 3 are
    checked with the A-Z of their texts in lower case."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = leaf([lowered(F.col(c)) if c == "text" else F.col(c) for c in columns])
    return prove(docs, columns, changed=F.when(remainder("doc_id", 3) == 0, tampered), band=band)


# -- the same in SQL -----------------------------------------------------------------------


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII letters in DuckDB's SQL, bit by bit."""
    bits = "[0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]"
    byte = f"list_reduce(list_concat([xor(c, b)], {bits}), lambda x, y: xor(x >> 1, (x & 1) * 3988292384::UBIGINT))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ord(substr({text}, i, 1))::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), lambda c, b: {byte}), 4294967295::UBIGINT)"


def _tree_sql(name: str, levels: int) -> str:
    """CTEs from ``{name}0`` (t, i, h, m: tree, place, digest, nodes of the tree): each level's
    nodes with their left and right siblings, up to ``{name}{levels}``, where one remains."""
    out = []
    for k in range(levels):
        run = f"OVER (PARTITION BY t, i // {FAN} ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}s{k} AS (SELECT *, CASE WHEN m > 1 THEN coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l, CASE WHEN m > 1 THEN coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r FROM {name}{k}), "
            f"{name}{k + 1} AS (SELECT t, i // {FAN} AS i, CASE WHEN m > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE max(h) END AS h, (m + {FAN - 1}) // {FAN} AS m FROM {name}{k} GROUP BY t, i // {FAN}, m)"
        )
    return ", ".join(out)


def _fold_sql(start: str, name: str, levels: int, tree: str, place: str) -> str:
    """CTEs that fold ``f`` and lengthen ``p`` of ``start`` by the siblings of each level."""
    out, now = [], start
    for k in range(levels):
        new = f"{start}_{name}{k}"
        out.append(f"{new} AS (SELECT a.* REPLACE (CASE WHEN s.m > 1 THEN sha256(s.l || a.f || s.r) ELSE a.f END AS f, a.p || s.l || s.r AS p) FROM {now} a JOIN {name}s{k} s ON s.t = a.{tree} AND s.i = a.{place} // {FAN**k})")
        now = new
    return ", ".join(out)


def tampered_sql(levels: int = 9, above: int = 3) -> str:
    """:func:`prove_tampered` in DuckDB's SQL, for trees of up to 8**levels leaves and 8**above languages."""

    def value(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR) || ':' || ({c}::VARCHAR), '-')"

    def row(text: str) -> str:
        return f"sha256({' || '.join(value(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = f"translate(text, '{upper}', '{upper.lower()}')"
    return (
        f"WITH d AS (SELECT doc_id, coalesce('1' || lang, '0') AS t, {row('text')} AS leaf, CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0 THEN {row(changed)} END AS other FROM documents), "
        "g AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS m FROM d), "
        f"x0 AS (SELECT t, i, leaf AS h, m FROM g), {_tree_sql('x', levels)}, "
        f"z AS (SELECT t AS lang, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS j, count(*) OVER () AS m FROM x{levels}), "
        f"y0 AS (SELECT 0 AS t, j AS i, subroot AS h, m FROM z), {_tree_sql('y', above)}, "
        f"a AS (SELECT g.doc_id, g.leaf, z.subroot, y.h AS root, g.t, g.i, z.j, 0 AS o, coalesce(g.other, g.leaf) AS f, '' AS p FROM g JOIN z ON z.lang = g.t, y{above} y), "
        f"{_fold_sql('a', 'x', levels, 't', 'i')}, {_fold_sql(f'a_x{levels - 1}', 'y', above, 'o', 'j')} "
        f"SELECT doc_id, leaf, subroot, root, sha256(p) AS proof_sha256, f AS folded_root, f = root AS verified FROM a_x{levels - 1}_y{above - 1}"
    )
