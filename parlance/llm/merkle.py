"""A Merkle manifest of a dataset, with a proof per row.

A row's leaf is the SHA-256 of its fields, each with its length in front.  Per language, leaves in the
order of their ids are hashed in pairs, level by level, to one subroot; the subroots, in the order of
their languages, to the root.  A node without a partner is hashed alone.

1. Leaves get their place in their language by a range sort (``common.numbered``), so a language with
   most of the rows is ordered by many tasks.
2. Places are cut into aligned blocks of 2**``LEVELS``.  A block is one row that holds each of its
   levels as one string of concatenated hexadecimal digests; fixed-width substrings of a level are
   hashed to the next one.  Block roots are the nodes of the next tier, which is cut into blocks
   again, until a language is a single block; the subroots make a tree of the same kind.
3. On the way down a block receives the path of its root and gives each of its nodes the substrings
   beside it, level by level, before that path.  A step is ``l`` or ``r`` (the side of the sibling)
   and its digest, or ``n`` where there is none.  ``folded`` hashes a leaf along its steps.

Blocks have at most 1,024 rows and about 0.3 MB, tiers shrink by that factor, and joins between tiers
go by (language, block).  One number per tree reaches the driver, the size of its largest group.

Null fields are ``-``, null ids and null languages come first.  Rows with equal ids are ordered by
their leaves; equal rows are leaves of their own with proofs of their own.  Empty texts are fields of
length 0.  A single row is its own subroot and root with the proof of no siblings.  An empty table
gives an empty result.  Columns other than doc_id, source, lang, n_chars and text are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import numbered, stored

#: Levels of a block; digits of a digest.
LEVELS = 10
WIDTH = 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows are tampered with for the check where this divides the CRC-32 of their id.
TAMPER = 7


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, and the leaf of the same row with n_chars changed (null where it is not)."""
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER == 0
    return docs.select(
        "doc_id",
        "lang",
        leaf_of(*[F.col(c) for c in FIELDS]).alias("h"),
        F.when(hit & F.col("n_chars").isNotNull(), leaf_of(*changed)).alias("tampered"),
        F.monotonically_increasing_id().alias("tie"),
    )


def _levels() -> Column:
    """The levels of a block, lowest first, each the concatenated digests of its nodes."""
    parents = f"""cast(array_join(transform(
        sequence(0, cast((octet_length(element_at(acc, -1)) - 1) div {2 * WIDTH} AS int)),
        i -> sha2(substring(element_at(acc, -1), i * {2 * WIDTH} + 1, {2 * WIDTH}), 256)), '') AS binary)"""
    many = "shiftright(count + shiftleft(1L, j) - 1, j) > 1"
    return F.expr(
        f"""aggregate(sequence(0, {LEVELS - 1}),
              array(cast(array_join(transform(items, x -> x.h), '') AS binary)),
              (acc, j) -> IF({many}, concat(acc, array({parents})), acc))"""
    )


def _steps() -> str:
    """SQL of the steps of node ``i`` inside its block."""
    beside = "(shiftright(i, j) ^ 1)"
    return f"""transform(slice(sequence(0, size(levels) - 1), 1, size(levels) - 1), j ->
        IF({beside} * {WIDTH} < octet_length(levels[j]),
           concat(IF(shiftright(i, j) % 2 = 1, 'l', 'r'),
                  cast(substring(levels[j], {beside} * {WIDTH} + 1, {WIDTH}) AS string)),
           'n'))"""


ROOT = "cast(element_at(levels, -1) AS string)"


def ascend(nodes: DataFrame, keys: list[str], payload: list[str]) -> list[DataFrame]:
    """The tiers of blocks over ``nodes`` (keys, pos, count, h and payload), lowest first."""
    most, tiers = nodes.agg(F.max("count")).first()[0] or 0, []
    while True:
        blocks = nodes.groupBy(*keys, "count", F.shiftright("pos", LEVELS).alias("block")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "h", *payload))).alias("items")
        )
        tiers.append(stored(blocks.withColumn("levels", _levels()), "merkle"))
        if most <= 1 << LEVELS:
            return tiers
        most = math.ceil(most / (1 << LEVELS))
        above = F.shiftright(F.col("count") + F.lit((1 << LEVELS) - 1), LEVELS)
        nodes = tiers[-1].select(*keys, F.col("block").alias("pos"), above.alias("count"), F.expr(ROOT).alias("h"))
        payload = []


def descend(tiers: list[DataFrame], keys: list[str], above: DataFrame | None, payload: list[str]) -> DataFrame:
    """keys, payload, h, steps to the top and the other columns of ``above`` for every node.

    ``above`` has the steps of every key's root (keys, steps and what all its nodes share); without
    it the steps end at the root itself, which becomes the column ``root``.
    """
    for at, blocks in reversed(list(enumerate(tiers))):
        if above is None:
            met = blocks.withColumns({"upper": F.array().cast("array<string>"), "root": F.expr(ROOT)})
            shared = ["root"]
        else:
            on = ["block", *keys] if "block" in above.columns else keys
            shared = [c for c in above.columns if c not in (*on, "steps")]
            above = above.select(*[F.col(c).alias(f"_{c}") for c in on], F.col("steps").alias("upper"), *shared)
            same = F.lit(True)
            for c in on:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            met = blocks.join(above, same)
        names = ["h", *payload] if at == 0 else ["h"]
        fields = ", ".join(f"x.{c} AS {c}" for c in ["pos", *names])
        nodes = F.expr(f"transform(items, (x, i) -> struct({fields}, concat({_steps()}, upper) AS steps))")
        exploded = met.select(*keys, *shared, F.explode(nodes).alias("x"))
        if at:
            above = exploded.select(*keys, *shared, F.col("x.pos").alias("block"), "x.steps")
        else:
            return exploded.select(*keys, *shared, *[F.col(f"x.{c}") for c in names], "x.steps")
    raise AssertionError("a tree has at least one tier")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf, subroot, root, steps and the leaf after tampering (or null) of every row."""
    placed = numbered(stored(leaves(docs), "leaves"), ["doc_id", "h", "tie"], ["lang"], "leaves")
    tiers = ascend(placed, ["lang"], ["doc_id", "tampered"])
    subroots = tiers[-1].select("lang", F.expr(ROOT).alias("h"))
    top = ascend(numbered(subroots, ["lang"], label="subroots"), [], ["lang"])
    paths = descend(top, [], None, ["lang"]).withColumnRenamed("h", "subroot")
    return descend(tiers, ["lang"], paths, ["doc_id", "tampered"]).withColumnRenamed("h", "leaf")


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps lead to."""

    def up(node, step):
        side, beside = F.substring(step, 1, 1), F.substring(step, 2, WIDTH)
        both = F.when(side == "l", F.concat(beside, node)).when(side == "r", F.concat(node, beside)).otherwise(node)
        return F.sha2(both.cast("binary"), 256)

    return F.aggregate(steps, leaf, up)


def proof_digest(steps: Column) -> Column:
    siblings = F.array_join(F.transform(steps, lambda s: F.substring(s, 2, WIDTH)), "")
    return F.sha2(siblings.cast("binary"), 256)


def merkle(docs: DataFrame) -> DataFrame:
    """The manifest checked against rows of which some were tampered with."""
    rows = manifest(docs).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("steps")).alias("proof_sha256"),
        folded(F.coalesce("tampered", "leaf"), F.col("steps")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    enc = lambda c, add="": f"coalesce(strlen(({c}{add})::VARCHAR) || ':' || ({c}{add})::VARCHAR, '-')"
    leaf = lambda add: "sha256(" + " || ".join(enc(c, add if c == "n_chars" else "") for c in FIELDS) + ")"
    tree = lambda name, start, key: f"""{name} AS (
      SELECT {key} AS k, 0 AS lvl, idx, h, size FROM {start}
      UNION ALL
      SELECT k, lvl + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), max((size + 1) // 2)
      FROM {name} WHERE size > 1 GROUP BY k, lvl, idx // 2)"""  # noqa: E731
    steps = lambda nth, name: f"""
      SELECT r.rid, {nth} AS nth, t.lvl,
             CASE WHEN s.h IS NULL THEN 'n' WHEN (r.i{nth} >> t.lvl) % 2 = 1 THEN 'l' || s.h ELSE 'r' || s.h END AS step
      FROM rows r JOIN (SELECT DISTINCT k, lvl FROM {name} WHERE size > 1) t ON t.k IS NOT DISTINCT FROM r.k{nth}
      LEFT JOIN {name} s ON s.k IS NOT DISTINCT FROM r.k{nth} AND s.lvl = t.lvl AND s.idx = xor(r.i{nth} >> t.lvl, 1)"""  # noqa: E731
    return f"""
    WITH RECURSIVE hashed AS (
      SELECT row_number() OVER () AS rid, doc_id, lang, {leaf('')} AS h, {leaf(' + 1')} AS changed,
             list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
               lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END) AS crc
      FROM documents),
    leaves AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS idx,
             count(*) OVER (PARTITION BY lang) AS size
      FROM hashed),
    {tree('tree', 'leaves', 'lang')},
    sub AS (
      SELECT k AS lang, h, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS idx, count(*) OVER () AS size
      FROM tree WHERE size = 1),
    {tree('top', 'sub', '0')},
    rows AS (
      SELECT rid, doc_id, l.h AS leaf, sub.h AS subroot, CASE WHEN xor(crc, 4294967295) % {TAMPER} = 0 THEN changed ELSE l.h END AS seen,
             l.lang AS k0, l.idx AS i0, 0 AS k1, sub.idx AS i1
      FROM leaves l JOIN sub ON sub.lang IS NOT DISTINCT FROM l.lang),
    steps AS ({steps(0, 'tree')} UNION ALL {steps(1, 'top')}),
    paths AS (SELECT rid, list(step ORDER BY nth, lvl) AS steps FROM steps GROUP BY rid),
    done AS (
      SELECT doc_id, leaf, subroot, (SELECT h FROM top WHERE size = 1) AS root,
             sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
             list_reduce(list_prepend(seen, coalesce(steps, [])),
               lambda a, s: sha256(CASE s[1] WHEN 'l' THEN s[2:] || a WHEN 'r' THEN a || s[2:] ELSE a END)) AS folded_root
      FROM rows LEFT JOIN paths USING (rid))
    SELECT *, folded_root = root AS verified FROM done"""


SQL = _sql()
