"""Operator 4, exact dedup by deterministic block naming, in DataFrame functions only.

A normalised text (A-Z lower-cased, UTF-8) is cut into blocks of fixed size. The distinct blocks are sorted and
numbered: that integer is the block's name. Then adjacent names are paired, distinct pairs get names in the
same way, and so on until each document has one name. At each level equal names mean equal content by
induction, so no two different texts ever share an identity: no hash decides. A hash only finds a block's name
without moving its content twice; where one hash stands for two blocks, those blocks are named by content.

Blocks and pairs are made distinct before the shuffle, so a block that a third of all rows share travels once a
task. Name tables hold a row for each name, so joins with them never multiply rows, and AQE splits hot keys.

Defined results: null text counts as empty and equals ""; an empty text is one empty block; rows with the same
doc_id and text are one document to keep (dedup() returns one of them); a null doc_id is smaller than any
other; an empty table gives no rows; other columns are not read by the names, and dedup() keeps them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, materialise

BLOCK = 4096
_NONE = -1  # the missing right half of an odd pair; names are not negative but for blocks of a shared hash


def _blocks(raw: Column, size: int) -> Column:
    last = F.greatest(F.ceil(F.octet_length(raw) / F.lit(size)).cast("int"), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _numbered(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sort distinct keys and number them; the table is written, so the numbers are fixed from then on."""
    return materialise(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()).drop("block"), name)


def block_names(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, sha (of the normalised text), n_rows (rows of both), level, name: the identity is (level, name)."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", ascii_lower(F.col("text")).cast("binary").alias("raw"))
    cut = raw.select("doc_id", F.sha2("raw", 256).alias("sha"), _blocks(F.col("raw"), block).alias("blocks"))

    blocks = cut.select(F.explode("blocks").alias("block")).select(F.xxhash64("block").alias("hash"), "block")
    names = _numbered(blocks.distinct(), ["hash", "block"], "blocks")
    shared = names.groupBy("hash").count().where("count > 1").select("hash")
    hashes = cut.select("doc_id", "sha", F.transform("blocks", lambda b: F.xxhash64(b)).alias("hashes"))
    base = materialise(hashes.groupBy("doc_id", "sha", "hashes").agg(F.count("*").alias("n_rows")), "documents")
    rows = base.select("doc_id", "sha", "n_rows", F.size("hashes").alias("left"), F.posexplode("hashes").alias("pos", "hash"))
    if shared.isEmpty():
        rows = rows.join(names, "hash").drop("hash")
    else:  # two blocks of one hash: these few are looked up by content, with names of their own
        few = materialise(blocks.join(shared, "hash", "left_semi").distinct(), "shared")
        own = few.sortWithinPartitions("hash", "block").withColumn("name", -2 - F.monotonically_increasing_id())
        own = materialise(own, "shared-names")
        odd = cut.select("doc_id", "sha", F.posexplode("blocks").alias("pos", "block")).withColumn("hash", F.xxhash64("block"))
        odd = odd.join(shared, "hash", "left_semi").distinct().join(own, ["hash", "block"]).select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), F.col("pos").alias("p"), F.col("name").alias("odd"))
        plain = names.join(shared, "hash", "left_anti")
        rows = rows.join(plain, "hash", "left").drop("hash")
        rows = rows.join(odd, rows.doc_id.eqNullSafe(odd.d) & (rows.sha == odd.s) & (rows.pos == odd.p), "left")
        rows = rows.withColumn("name", F.coalesce("name", "odd")).drop("d", "s", "p", "odd")

    rows, level, done = materialise(rows, "names-0"), 0, []
    longest = base.agg(F.max(F.size("hashes"))).head()[0] or 1
    while True:
        done.append(rows.where("left = 1").select("doc_id", "sha", "n_rows", F.lit(level).alias("level"), "name"))
        if longest <= 1:
            break
        half = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = rows.where("left > 1").groupBy("doc_id", "sha", "n_rows", "left", F.shiftright("pos", 1).alias("pos"))
        pairs = pairs.agg(F.max(half[0]).alias("a"), F.coalesce(F.max(half[1]), F.lit(_NONE)).alias("b"))
        pairs = materialise(pairs, f"pairs-{level + 1}")
        named = _numbered(pairs.select("a", "b").distinct(), ["a", "b"], f"pair-names-{level + 1}")
        rows = pairs.join(named, ["a", "b"]).select("doc_id", "sha", "n_rows", F.ceil(F.col("left") / 2).cast("int").alias("left"), "pos", "name")
        longest, level = (longest + 1) // 2, level + 1
        if longest > 1:
            rows = materialise(rows, f"names-{level}")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    named = materialise(block_names(docs, block), "identities")
    size = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("n_rows").alias("group_size"))
    size = materialise(size, "groups")  # as a table of its own, so that the join below can split a hot group
    rows = named.join(size, ["level", "name"])
    rows = rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("n_rows"))).alias("copy")).drop("copy")


def dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the row with the largest doc_id, once."""
    sha, key = fresh(docs, "sha"), fresh(docs, "key")
    named = groups(docs, block).where("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(f"{sha}2")).distinct()
    own = docs.withColumn(sha, F.sha2(ascii_lower(F.col("text").cast("string")).cast("binary"), 256))
    own = own.join(named, own["doc_id"].cast("long").eqNullSafe(named[key]) & (own[sha] == named[f"{sha}2"]), "left_semi")
    return own.dropDuplicates(["doc_id", sha]).select(*[own[f"`{c}`"] for c in docs.columns])
