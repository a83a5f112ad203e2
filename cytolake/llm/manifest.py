"""Merkle manifest of a dataset: a node store in files, built level by level, and proofs by merge-scans over it.

Each source's leaves are a tree, and the roots of these trees, by source, are the leaves of the top tree. Leaves are sorted
over all tasks and numbered, task by task; every 16 consecutive ones are a row of level 0, a folder of Parquet, sorted by
coordinate (tree, node). Each level is made from the one before and is a sixteenth of it, so a store takes a fifteenth more
than its leaves. Proofs go down the levels: a level's rows meet their parents' proofs by coordinate in a merge join, so a row
travels with 16 children at most, whatever a source's share of the rows is.

Digests are lowercase hexadecimal text, also where they are hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, written

#: Children of a node.
WIDTH = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(**instead: Column) -> Column:
    """The digest of a row's fields, each framed by its length, so that no two rows have the same input. `instead` replaces fields."""

    def framed(name: str) -> Column:
        value = instead.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(framed, FIELDS)).cast("binary"), 256)


def _joined(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, "").cast("binary"), 256)


def _numbered(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Adds i, a row's place in its tree by `order` (nulls first), and n, the tree's rows. Rows that are equal in `order` must be equal; of a stored table, they may be many.

    Rows are sorted by range into files. What tasks hold of a tree is counted, and these counts are summed up: one row for
    each task and tree that meet, and no task sorts or counts a tree.
    """
    rows = rows.withColumn("row", F.monotonically_increasing_id())  # so that equal rows are no one task's
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order], F.col("row")]
    run = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row").withColumn("at", F.monotonically_increasing_id()), path)
    run = run.withColumn("task", F.shiftright("at", 33))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = run.groupBy("tree", "task").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("first"))
    held = held.select("tree", "task", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return run.join(held, ["tree", "task"]).withColumn("i", F.col("at") + F.col("shift")).drop("at", "shift", "task")


def _level(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes (tree, n, i, and what they hold) as rows of WIDTH: tree, n, node (their parent's place) and kids, in order."""
    kid = F.struct("i", *[c for c in nodes.columns if c not in ("tree", "n", "i")])
    runs = nodes.groupBy("tree", "n", F.expr(f"i div {WIDTH}").alias("node")).agg(F.array_sort(F.collect_list(kid)).alias("kids"))
    return written(runs.sortWithinPartitions("tree", "node"), path)


def build(rows: DataFrame, order: list[str], path: str) -> tuple[list[DataFrame], DataFrame]:
    """The levels of a store for rows (tree, digest and others), and the top of each tree: tree, digest, level.

    Leaves stand by `order`. While a tree has several nodes, every WIDTH consecutive ones become one; a lone leaf is its tree's top.
    """
    levels = [_level(_numbered(rows, order, f"{path}/leaves"), f"{path}/level=0")]
    most = levels[0].agg(F.max("n")).first()[0] or 1
    while most > 1:
        done = levels[-1].where("n > 1")
        nodes = done.select("tree", F.expr(f"(n - 1) div {WIDTH} + 1").alias("n"), F.col("node").alias("i"), _joined(F.col("kids.digest")).alias("digest"))
        levels.append(_level(nodes, f"{path}/level={len(levels)}"))
        most = -(-most // WIDTH)
    tops = [t.where("n = 1").select("tree", F.col("kids")[0]["digest"].alias("digest"), F.lit(k).alias("level")) for k, t in enumerate(levels)]
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, top


def proofs(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Every leaf of the levels with its steps up to the root, and what `above` carries.

    `above` (tree, level, steps, and others): what comes after a tree's top, which is on that level. A step is the text of
    the siblings to the left and that of those to the right.
    """
    carried = [c for c in above.columns if c not in ("tree", "level")]
    known = None
    for k in range(len(levels) - 1, -1, -1):
        parents = above.where(F.col("level") == k).select("tree", F.lit(0).cast("long").alias("node"), *carried)
        if known is not None:
            parents = parents.unionByName(known.select("tree", F.col("i").alias("node"), *carried))
        met = levels[k].join(parents.hint("merge"), ["tree", "node"])
        each = met.select("tree", "n", "kids.digest", *carried, F.posexplode("kids").alias("j", "kid"))
        left, right = F.array_join(F.slice("digest", 1, F.col("j")), ""), F.array_join(F.slice("digest", F.col("j") + 2, WIDTH), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        steps = F.when(F.col("n") > 1, F.concat(step, "steps")).otherwise(F.col("steps"))
        known = each.select("tree", steps.alias("steps"), *[c for c in carried if c != "steps"], "kid.*")
    return known


def folded(start: Column, steps: str = "steps") -> Column:
    """The root that follows from a leaf's digest and its steps."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def with_proofs(docs: DataFrame, path: str, claims: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, digest (the leaf), steps, subroot and root of every row, and what `claims` makes of the rows. The node store is left under `path`.

    A source's leaves ascend by doc_id, null first, then by digest; a null source is a source of its own and comes first.
    Nulls are told from empty values. Repeated rows are leaves of their own. An empty table has no rows and no root.
    Columns other than the five fields are not covered.
    """
    claims = claims or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null before all others, and these by their bytes
    rows = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("digest"), *[c.alias(n) for n, c in claims.items()])
    levels, tops = build(written(rows, f"{path}/rows"), ["doc_id", "digest"], f"{path}/sources")
    tops = written(tops, f"{path}/tops")
    upper, root = build(tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest", F.col("level").alias("height")), ["of"], f"{path}/top")
    none = F.array().cast("array<struct<left: string, right: string>>")
    subroots = proofs(upper, root.select("tree", "level", none.alias("steps"), F.col("digest").alias("root")))
    above = subroots.select(F.col("of").alias("tree"), F.col("height").alias("level"), "steps", F.col("digest").alias("subroot"), "root")
    return proofs(levels, written(above, f"{path}/above")).select("doc_id", "digest", "steps", "subroot", "root", *claims)


def tampered() -> Column:
    """A text whose A-Z are lower-cased where 5 divides the checksum of doc_id in decimal; a null doc_id has none."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    return F.when(h % 5 == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))


def check_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's proof, and what it says of a possibly tampered row.

    A tampered row without A-Z in its text is the original one, and so verified.
    """
    path = scratch(docs.sparkSession, "manifest")
    # where the text is not tampered with, the claim is the leaf and need not be stored
    claim = F.nullif(leaf(text=tampered()), leaf())
    found = with_proofs(docs, path, {"claim": claim})
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    told = found.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        folded(F.coalesce("claim", "digest")).alias("folded_root"),
    )
    return written(told.withColumn("verified", F.col("folded_root") == F.col("root")), f"{path}/checked")


# -- SQL ---------------------------------------------------------------------------------------------------------

#: Levels of the SQL: it holds for 16^6 rows of a source and 16^3 sources.
_LEVELS, _TOP = 6, 3


def _levels_sql(name: str, count: int) -> str:
    """name0 (tree, i, n, d) and the levels above it. A tree with one node passes it on."""
    out = []
    for k in range(count):
        out.append(f"{name}r{k} AS (SELECT tree, i // 16 AS i, n, list(d ORDER BY i) AS ds FROM {name}{k} GROUP BY tree, i // 16, n)")
        out.append(f"{name}{k + 1} AS (SELECT tree, i, (n + 15) // 16 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d FROM {name}r{k})")
    return ", ".join(out)


def _climb_sql(name: str, rows: str, place: str, tree: str, level: int) -> str:
    """One step up: proof gains the siblings, h is folded. place and tree are the columns of `rows` that say where a row's leaf is."""
    mine = f"CAST({place} // {16**level} % 16 AS INTEGER)"
    left, right = f"array_to_string(ds[1:{mine}], '')", f"array_to_string(ds[{mine} + 2:], '')"
    return f"SELECT p.* EXCLUDE (proof, h), CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, CASE WHEN n > 1 THEN sha256({left} || h || {right}) ELSE h END AS h FROM {rows} p JOIN {name}r{level} r ON r.tree = p.{tree} AND r.i = {place} // {16 ** (level + 1)}"


def _sql() -> str:
    frame = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(frame(text if f == "text" else f) for f in FIELDS) + ")"
    table = "(SELECT list(list_reduce(list_concat([b], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) FROM (SELECT unnest(range(256)) AS b))"
    digits = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], {digits}), lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1])))"
    parts = [
        f"crc AS (SELECT {table} AS t)",
        f"docs AS (SELECT *, CASE WHEN {crc} % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS other FROM documents, crc)",
        f"rows AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {row('text')} AS leaf, {row('other')} AS claim FROM docs)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM rows)",
        "a0 AS (SELECT tree, i, n, leaf AS d FROM placed)",
        _levels_sql("a", _LEVELS),
        f"subs AS (SELECT tree AS source, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS m FROM a{_LEVELS})",
        "b0 AS (SELECT '' AS tree, k AS i, m AS n, subroot AS d FROM subs)",
        _levels_sql("b", _TOP),
        f"p0 AS (SELECT doc_id, leaf, p.tree, p.i AS place, s.k, '' AS top, subroot, (SELECT d FROM b{_TOP}) AS root, '' AS proof, claim AS h FROM placed p JOIN subs s ON s.source = p.tree)",
    ]
    at = 0
    for name, tree, place, count in (("a", "tree", "p.place", _LEVELS), ("b", "top", "p.k", _TOP)):
        for level in range(count):
            parts.append(f"p{at + 1} AS ({_climb_sql(name, f'p{at}', place, tree, level)})")
            at += 1
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM p{at}"


SQL = _sql()
